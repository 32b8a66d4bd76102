"""Elementwise functions and operators as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ties of round() go to the even neighbour.
ROUND = F.bround


def number(x: Column) -> Column:
    return x.cast("double")


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(number(a), number(b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; null for a null or zero divisor."""
    a, b = number(a), number(b)
    return F.when(b.isNull() | (b == 0), F.lit(None)).otherwise((a % b + b) % b)


def power(a: Column, b: Column) -> Column:
    """NaN becomes null."""
    return F.nullif(F.pow(number(a), number(b)), F.lit(float("nan")))


def guarded(x: Column, bad: Column, value: Column) -> Column:
    return F.when(bad, F.lit(None).cast("double")).otherwise(value)


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    """Null stays null, although least and greatest skip nulls."""
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, lo), hi))


def flags(args: list[Column], null_is_false: bool) -> Column:
    each = [(F.coalesce(a.cast("boolean"), F.lit(False)) if null_is_false else a.cast("boolean")).cast("int") for a in args]
    return reduce(lambda a, b: a + b, each)


# Coefficients of the rational error function (7.1.26 of the Handbook of Mathematical Functions).
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Coefficients of Acklam's inverse normal distribution function.
_PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_PPF_LOW = 0.02425


def _horner(coefficients, x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def erf(x: Column) -> Column:
    x = number(x)
    t = 1 / (1 + _ERF_P * F.abs(x))
    series = _horner((*reversed(_ERF_A), 0.0), t)
    return F.signum(x) * (1 - series * F.exp(-x * x))


def norm_ppf(p: Column) -> Column:
    p = number(p)

    def tail(q: Column) -> Column:
        r = F.sqrt(-2 * F.ln(q))
        return _horner(_PPF_C, r) / _horner((*_PPF_D, 1.0), r)

    q = p - 0.5
    centre = q * _horner(_PPF_A, q * q) / _horner((*_PPF_B, 1.0), q * q)
    return (
        F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf")))
        .when(p < _PPF_LOW, tail(p)).when(p > 1 - _PPF_LOW, -tail(1 - p)).otherwise(centre)
    )
