"""The primitives: arity, axis, how far a change reaches, and lowering to Columns.

One table drives checking, lowering, change propagation and discovery. A lowering takes the
call's operands as Columns (literals of window, quantile and unit positions raw) and the frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PanelError
from ..operators import periods
from . import aggregates, scalar

TS, XS, CELL, MODEL = "time-series", "cross-sectional", "elementwise", "model"
#: Reach of a change: rows ahead are given by the second argument, or its predecessor; all rows ahead; all rows.
LAG, WINDOW, AHEAD, ENTITY_WIDE, NONE = "lag", "window", "ahead", "entity", "none"


@dataclass(frozen=True)
class Frame:
    """Where a window call works: the panel's index and the group of a cross-section."""

    by: str | None = None

    @property
    def time(self) -> Column:
        return F.col("time")

    @property
    def series(self):
        return Window.partitionBy("entity").orderBy("time")

    @property
    def whole(self):
        return Window.partitionBy("entity")

    @property
    def past(self):
        return self.series.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def section(self):
        return Window.partitionBy("time", *([F.col(f"`{self.by}`")] if self.by else []))


@dataclass(frozen=True)
class Op:
    low: int
    high: int
    axis: str
    summary: str
    lower: Callable[[list, Frame], Column] | None = None
    reach: str = NONE
    raw: tuple[int, ...] = ()  # positions of literals that stay Python values


def _whole(v, what: str, least: int = 1) -> int:
    if isinstance(v, bool) or not isinstance(v, int | float) or v != int(v) or v < least:
        raise PanelError("E-ARG-LITERAL", f"{what} must be a whole literal of at least {least}, got {v!r}")
    return int(v)


def _share(v) -> float:
    if isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 1:
        raise PanelError("E-ARG-LITERAL", f"a quantile must be a literal between 0 and 1, got {v!r}")
    return float(v)


def _last(f: Frame, n: int):
    return f.series.rowsBetween(-(n - 1), 0)


def _full(x: Column, value: Column, n: int, f: Frame) -> Column:
    """Only where the last n rows are all there."""
    return F.when(F.count(x).over(_last(f, n)) == n, value)


_ROLL = {"mean": "avg", "sum": "sum", "std": "stddev_samp", "var": "var_samp", "max": "max", "min": "min"}


def _roll(kind: str):
    def lower(a: list, f: Frame) -> Column:
        x, n = a[0].cast("double"), a[1]
        if isinstance(n, str):
            raise PanelError("E-INTERNAL", "duration windows are lowered by the planner")
        n = _whole(n, "a window")
        return _full(x, F.call_function(_ROLL[kind], x).over(_last(f, n)), n, f)

    return lower


def duration_window(kind: str, column: str, span: str) -> Column:
    """roll_* over the calendar span (t - span, t] of a column that is already in the panel."""
    frame = f"RANGE BETWEEN CAST('{periods.interval(span)} -1 microseconds' AS INTERVAL) PRECEDING AND CURRENT ROW"
    return F.expr(f"{_ROLL[kind]}(CAST(`{column}` AS DOUBLE)) OVER (PARTITION BY entity ORDER BY time {frame})")


def _position(q: float, n: Column) -> Column:
    """1-based nearest rank of quantile q among n sorted values."""
    return F.round(F.lit(q) * (n - 1)).cast("int") + 1


def _roll_quantile(a: list, f: Frame) -> Column:
    x, n, q = a[0].cast("double"), _whole(a[1], "a window"), _share(a[2])
    ordered = F.sort_array(F.collect_list(x).over(_last(f, n)))
    return _full(x, F.try_element_at(ordered, _position(q, F.lit(n))), n, f)


def section_quantile(x: Column, q: float, f: Frame) -> Column:
    """Nearest-rank quantile of a cross-section, by row numbers instead of a collected list."""
    x = x.cast("double")
    place = F.row_number().over(f.section.orderBy(x.asc_nulls_last()))
    return F.max(F.when((place == _position(q, F.count(x).over(f.section))) & x.isNotNull(), x)).over(f.section)


def _rank(a: list, f: Frame) -> Column:
    x = a[0]
    ties = Window.partitionBy("time", *([F.col(f"`{f.by}`")] if f.by else []), x)
    return F.when(x.isNotNull(), F.rank().over(f.section.orderBy(x.asc_nulls_last())) + (F.count(x).over(ties) - 1) / 2)


def _zscore(a: list, f: Frame) -> Column:
    x = a[0].cast("double")
    return scalar.divide(x - F.avg(x).over(f.section), F.stddev_samp(x).over(f.section))


def _winsorize(a: list, f: Frame) -> Column:
    p = _share(a[1])
    return scalar.clamp(a[0].cast("double"), section_quantile(a[0], p, f), section_quantile(a[0], 1 - p, f))


def _decay(a: list, f: Frame) -> Column:
    n = _whole(a[1], "a window")
    x = a[0].cast("double")
    total = sum(((F.lag(x, k).over(f.series) if k else x) * (n - k) for k in range(n)), F.lit(0.0))
    return total / (n * (n + 1) / 2)


def _staged(a: list, f: Frame) -> Column:
    raise PanelError("E-INTERNAL", "exponential weights are lowered by the planner")


#: Sums over n rows are combined from at most this many sums over n / FAN rows.
FAN = 8


def ewm(df: DataFrame, x: Column, span, spread: bool, name: str) -> DataFrame:
    """The panel with the exponentially weighted mean or deviation of x as another column.

    Weights are (1-alpha)^age with age in rows; rows too old to matter in double precision are left out. The sums over
    the last rows are made of lags of sums over fewer rows, level by level, so that a row costs the logarithm of its
    window and no list of it is held.
    """
    if isinstance(span, bool) or not isinstance(span, int | float) or span < 1:
        raise PanelError("E-ARG-LITERAL", f"a span must be a literal of at least 1, got {span!r}")
    keep = 1 - 2 / (span + 1)
    own = [F.col(f"`{c}`") for c in df.columns]
    df, x = df.select("*", x.cast("double").alias(f"{name}_x")), F.col(f"{name}_x")
    if keep == 0:
        return df.select(*own, F.when(x.isNotNull(), F.lit(0.0) if spread else x).alias(name))
    # no offset beyond an int; no series is as long
    rows = min(math.ceil(math.log(1e-17) / math.log(keep)) + 1, 2**31 - 1)
    # weights, weighted values; their squared weights and weighted squares
    first = {"w": F.lit(1.0), "s": x} | ({"v": F.lit(1.0), "q": x * x} if spread else {})
    fade = {k: keep * keep if k == "v" else keep for k in first}
    part = lambda k, age: F.col(f"`{name}_{k}{age}`")
    df = df.select("*", *[F.when(x.isNotNull(), c).otherwise(0.0).alias(f"{name}_{k}0") for k, c in first.items()])
    size = 1
    while size < rows:
        ages = [size * i for i in range(1, min(FAN, math.ceil(rows / size)))]
        df = df.select("*", *[F.lag(part(k, 0), age, 0.0).over(Frame().series).alias(f"{name}_{k}{age}") for age in ages for k in first])
        df = df.select(*own, x, *[sum((part(k, age) * fade[k] ** age for age in ages), part(k, 0)).alias(f"{name}_{k}0") for k in first])
        size *= len(ages) + 1
    w, s = part("w", 0), part("s", 0)
    mean = s / w
    if spread:
        biased = F.greatest(part("q", 0) / w - mean * mean, F.lit(0.0))
        rest = w * w - part("v", 0)
        mean = F.when(rest <= 1e-12, F.lit(0.0)).otherwise(F.sqrt(biased * w * w / rest))
    return df.select(*own, F.when(x.isNotNull(), mean).alias(name))


def _so_far(agg: str):
    def lower(a: list, f: Frame) -> Column:
        x = a[0].cast("double")
        return F.when(x.isNotNull(), F.call_function(agg, x).over(f.past) if agg != "product" else F.product(x).over(f.past))

    return lower


def _resample(a: list, f: Frame) -> Column:
    bucket = periods.truncate(f.time, periods.DURATION[a[1]])
    return aggregates.over(a[2], a[0], f.time, Window.partitionBy("entity", bucket))


def _section(agg: str):
    return lambda a, f: F.call_function(agg, a[0].cast("double")).over(f.section)


def _cell(g: Callable[[Column], Column]):
    return lambda a, f: g(a[0].cast("double"))


def _guard(bad: Callable[[Column], Column], g: Callable[[Column], Column]):
    return lambda a, f: scalar.guarded(a[0], bad(a[0].cast("double")), g(a[0].cast("double")))


OPS: dict[str, Op] = {
    "lag": Op(2, 2, TS, "value n rows earlier", lambda a, f: F.lag(a[0], _whole(a[1], "a lag", 0)).over(f.series), LAG, (1,)),
    **{f"roll_{k}": Op(2, 2, TS, f"rolling {k} over n rows or a duration", _roll(k), WINDOW, (1,)) for k in _ROLL},
    "roll_quantile": Op(3, 3, TS, "rolling nearest-rank quantile", _roll_quantile, WINDOW, (1, 2)),
    "roll_median": Op(
        2, 2, TS, "rolling median",
        lambda a, f: _full(a[0], F.percentile(a[0].cast("double"), F.lit(0.5)).over(_last(f, _whole(a[1], "a window"))), int(a[1]), f), WINDOW, (1,),
    ),
    "roll_skew": Op(
        2, 2, TS, "rolling population skewness",
        lambda a, f: _full(a[0], F.skewness(a[0].cast("double")).over(_last(f, _whole(a[1], "a window"))), int(a[1]), f), WINDOW, (1,),
    ),
    "ewm_mean": Op(2, 2, TS, "exponentially weighted mean of a span", _staged, AHEAD, (1,)),
    "ewm_std": Op(2, 2, TS, "exponentially weighted deviation of a span", _staged, AHEAD, (1,)),
    "decay_linear": Op(2, 2, TS, "linearly decaying mean over n rows", _decay, WINDOW, (1,)),
    "resample": Op(3, 3, TS, "reduce each period of a frequency, repeated on its rows", _resample, ENTITY_WIDE, (1, 2)),
    "asof": Op(1, 1, TS, "last known value", lambda a, f: F.last(a[0], ignorenulls=True).over(f.past), AHEAD),
    "ttm": Op(1, 1, TS, "trailing year, by the field's kind", None, AHEAD),
    "trailing": Op(2, 2, TS, "trailing window, by the field's kind", None, AHEAD, (1,)),
    **{f"to_{k}": Op(1, 2, TS, f"resample to {k}, by the field's kind", None, ENTITY_WIDE, (1,)) for k in ("annual", "quarterly", "monthly", "daily")},
    "cummax": Op(1, 1, TS, "maximum so far", _so_far("max"), AHEAD),
    "cumsum": Op(1, 1, TS, "sum so far", _so_far("sum"), AHEAD),
    "cumprod": Op(1, 1, TS, "product so far", _so_far("product"), AHEAD),
    "cummin": Op(1, 1, TS, "minimum so far", _so_far("min"), AHEAD),
    "ts_mean": Op(1, 1, TS, "mean of the whole series", lambda a, f: F.avg(a[0].cast("double")).over(f.whole), ENTITY_WIDE),
    "ts_std": Op(1, 1, TS, "sample deviation of the whole series", lambda a, f: F.stddev_samp(a[0].cast("double")).over(f.whole), ENTITY_WIDE),
    "ts_min": Op(1, 1, TS, "minimum of the whole series", lambda a, f: F.min(a[0].cast("double")).over(f.whole), ENTITY_WIDE),
    "zscore": Op(1, 1, XS, "standardised within the period and group", _zscore),
    "rank": Op(1, 1, XS, "ascending rank with mean ties", _rank),
    "winsorize": Op(2, 2, XS, "clipped to the quantiles p and 1-p", _winsorize, NONE, (1,)),
    "xs_mean": Op(1, 1, XS, "group mean", _section("avg")),
    "xs_median": Op(1, 1, XS, "group median", _section("median")),
    "xs_sum": Op(1, 1, XS, "group sum", lambda a, f: F.coalesce(F.sum(a[0].cast("double")).over(f.section), F.lit(aggregates.EMPTY_SUM))),
    "xs_frac": Op(1, 1, XS, "share of the group where true", lambda a, f: F.avg(a[0].cast("boolean").cast("double")).over(f.section)),
    "xs_std": Op(1, 1, XS, "group sample deviation", _section("stddev_samp")),
    "xs_var": Op(1, 1, XS, "group sample variance", _section("var_samp")),
    "xs_min": Op(1, 1, XS, "group minimum", _section("min")),
    "xs_max": Op(1, 1, XS, "group maximum", _section("max")),
    "xs_count": Op(1, 1, XS, "non-null values in the group", lambda a, f: F.count(a[0]).over(f.section)),
    "xs_quantile": Op(2, 2, XS, "group nearest-rank quantile", lambda a, f: section_quantile(a[0], _share(a[1]), f), NONE, (1,)),
    "count": Op(1, 99, CELL, "number of true flags; null if any is null", lambda a, f: scalar.flags(a, False)),
    "count_true": Op(1, 99, CELL, "number of true flags; null is false", lambda a, f: scalar.flags(a, True)),
    "erf": Op(1, 1, CELL, "error function, within 1.5e-7", lambda a, f: scalar.erf(a[0])),
    "norm_ppf": Op(1, 1, CELL, "inverse normal distribution function", lambda a, f: scalar.norm_ppf(a[0])),
    "sqrt": Op(1, 1, CELL, "square root; null below 0", _guard(lambda x: x < 0, F.sqrt)),
    "abs": Op(1, 1, CELL, "absolute value", lambda a, f: F.abs(a[0])),
    "log": Op(1, 1, CELL, "natural logarithm; null at 0 and below", _guard(lambda x: x <= 0, F.ln)),
    "exp": Op(1, 1, CELL, "exponential", _cell(F.exp)),
    **{k: Op(1, 1, CELL, s, _cell(getattr(F, k))) for k, s in (("sin", "sine"), ("cos", "cosine"), ("tan", "tangent"), ("asin", "arc sine"), ("acos", "arc cosine"), ("atan", "arc tangent"))},
    "floor": Op(1, 1, CELL, "whole number below", _cell(lambda x: F.floor(x).cast("double"))),
    "ceil": Op(1, 1, CELL, "whole number above", _cell(lambda x: F.ceil(x).cast("double"))),
    "round": Op(1, 1, CELL, "nearest whole number", _cell(lambda x: scalar.ROUND(x, 0).cast("double"))),
    "clamp": Op(3, 3, CELL, "clipped to literal bounds", lambda a, f: scalar.clamp(a[0].cast("double"), F.lit(float(a[1])), F.lit(float(a[2]))), NONE, (1, 2)),
    "min": Op(2, 2, CELL, "lesser of two, skipping nulls", lambda a, f: F.least(*a)),
    "max": Op(2, 2, CELL, "greater of two, skipping nulls", lambda a, f: F.greatest(*a)),
    "year": Op(1, 1, CELL, "calendar year", lambda a, f: F.year(a[0])),
    "month": Op(1, 1, CELL, "calendar month", lambda a, f: F.month(a[0])),
    "quarter": Op(1, 1, CELL, "calendar quarter", lambda a, f: F.quarter(a[0])),
    "day": Op(1, 1, CELL, "day of the month", lambda a, f: F.dayofmonth(a[0])),
    "truncate": Op(2, 2, CELL, "start of the duration bucket", lambda a, f: periods.truncate(a[0], a[1]), NONE, (1,)),
    "datediff": Op(2, 3, CELL, "whole units between two instants", lambda a, f: periods.whole_units(a[0], a[1], a[2] if len(a) > 2 else "days"), NONE, (2,)),
    "weighted_score": Op(0, 0, MODEL, "weighted mean of the model's scores"),
}
