"""Calendar arithmetic on period-end instants (timestamp_ntz)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PanelError

# The duration of each frequency.
DURATION = {"annual": "1y", "quarterly": "3mo", "monthly": "1mo", "weekly": "1w", "daily": "1d", "hourly": "1h", "minute": "1m"}
_UNITS = {"y": "year", "mo": "month", "w": "week", "d": "day", "h": "hour", "m": "minute"}
_PARTS = re.compile(r"(\d+)(y|mo|w|d|h|m)")
#: The label of a period is its last day, so a day is taken off the next period's start. For hours and
#: minutes this moves the label a day back; kept for equal labels.
LABEL_BACK = "1 day"


def parse_duration(text: str) -> tuple[int, str]:
    m = _PARTS.fullmatch(text) if isinstance(text, str) else None
    if not m or int(m.group(1)) < 1:
        raise PanelError("E-DURATION", f"bad duration {text!r}; expected such as 1y, 3mo, 1w, 1d, 1h or 1m")
    return int(m.group(1)), _UNITS[m.group(2)]


def interval(text: str) -> str:
    n, unit = parse_duration(text)
    return f"{n} {unit}"


def truncate(t: Column, text: str) -> Column:
    """The start of the duration bucket that holds t; weeks start on Monday."""
    n, unit = parse_duration(text)
    t = t.cast("timestamp_ntz")
    if unit == "year" and n > 1:
        n, unit = 12 * n, "month"
    if n == 1:
        return F.date_trunc(unit, t).cast("timestamp_ntz")
    if unit == "month":
        months = F.year(t) * 12 + F.month(t) - 1
        first = months - F.pmod(months, F.lit(n))
        return F.make_date(F.floor(first / 12).cast("int"), F.pmod(first, F.lit(12)) + 1, F.lit(1)).cast("timestamp_ntz")
    if unit == "week":
        return _floor(t, F.lit("1970-01-05").cast("timestamp_ntz"), 7 * 86400 * n)
    return _floor(t, F.lit("1970-01-01").cast("timestamp_ntz"), n * {"day": 86400, "hour": 3600, "minute": 60}[unit])


def _floor(t: Column, origin: Column, seconds: int) -> Column:
    past = F.timestamp_diff("SECOND", origin, F.date_trunc("second", t).cast("timestamp_ntz"))
    return F.timestamp_add("SECOND", past - F.pmod(past, F.lit(seconds).cast("long")), origin).cast("timestamp_ntz")


def period_end(t: Column, frequency: str) -> Column:
    """The label of the period of the given frequency that holds t."""
    step = DURATION[frequency]
    n, unit = parse_duration(step)
    return (truncate(t, step) + F.expr(f"INTERVAL {n} {unit}") - F.expr(f"INTERVAL {LABEL_BACK}")).cast("timestamp_ntz")


def whole_units(a: Column, b: Column, unit: str) -> Column:
    """a - b in whole units, truncated toward zero."""
    units = {"days": "DAY", "hours": "HOUR", "minutes": "MINUTE", "seconds": "SECOND"}
    if unit not in units:
        raise PanelError("E-DURATION", f"datediff unit must be days, hours, minutes or seconds, got {unit!r}")
    return F.timestamp_diff(units[unit], b.cast("timestamp_ntz"), a.cast("timestamp_ntz"))
