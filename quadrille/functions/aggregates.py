"""The reducers: each is a plain aggregate, so it works in a group-by and over a window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Empty-input choices, in one place: a sum is 0, a product 1.
EMPTY_SUM, EMPTY_PRODUCT = 0.0, 1.0


def _log(x: Column) -> Column:
    """Unguarded logarithm: -inf at 0, NaN below."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def _double(x: Column) -> Column:
    return x.cast("double")


#: (value, time) -> aggregate. first, last and change are ordered by time and keep nulls.
REDUCERS: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda x, t: F.coalesce(F.sum(_double(x)), F.lit(EMPTY_SUM)),
    "mean": lambda x, t: F.avg(_double(x)),
    "last": lambda x, t: F.max_by(x, t),
    "first": lambda x, t: F.min_by(x, t),
    "min": lambda x, t: F.min(x),
    "max": lambda x, t: F.max(x),
    "count": lambda x, t: F.count(x),
    "median": lambda x, t: F.median(_double(x)),
    "std": lambda x, t: F.stddev_samp(_double(x)),
    "var": lambda x, t: F.var_samp(_double(x)),
    "prod": lambda x, t: F.coalesce(F.product(_double(x)), F.lit(EMPTY_PRODUCT)),
    "compound": lambda x, t: F.coalesce(F.product(_double(x) + 1), F.lit(EMPTY_PRODUCT)) - 1,
    "geomean": lambda x, t: F.exp(F.avg(_log(_double(x)))),
    "skew": lambda x, t: F.skewness(_double(x)),
    "kurtosis": lambda x, t: F.kurtosis(_double(x)),
    "range": lambda x, t: F.max(_double(x)) - F.min(_double(x)),
    "change": lambda x, t: F.max_by(_double(x), t) - F.min_by(_double(x), t),
}


def over(name: str, x: Column, t: Column, window) -> Column:
    """The reducer over a window that holds a whole group."""
    plain = {
        "sum": lambda: F.coalesce(F.sum(_double(x)).over(window), F.lit(EMPTY_SUM)),
        "prod": lambda: F.coalesce(F.product(_double(x)).over(window), F.lit(EMPTY_PRODUCT)),
        "compound": lambda: F.coalesce(F.product(_double(x) + 1).over(window), F.lit(EMPTY_PRODUCT)) - 1,
        "geomean": lambda: F.exp(F.avg(_log(_double(x))).over(window)),
        "range": lambda: F.max(_double(x)).over(window) - F.min(_double(x)).over(window),
        "change": lambda: F.max_by(_double(x), t).over(window) - F.min_by(_double(x), t).over(window),
    }
    return plain[name]() if name in plain else REDUCERS[name](x, t).over(window)
