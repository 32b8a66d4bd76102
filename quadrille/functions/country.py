"""Country codes to ISO 3166 alpha-3; the table is the Java runtime's."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Codes in use that the runtime's table lacks.
EXTRA = {"XK": "XKX"}


def _iso(locale) -> dict[str, str]:
    return {c: locale("", c).getISO3Country() for c in locale.getISOCountries()}


def to_iso3(code: str | None) -> str | None:
    """Alpha-2 or alpha-3, any case, to alpha-3; None if unknown."""
    c = (code or "").strip().upper()
    known = _known()
    return known.get(c)


@lru_cache(maxsize=1)
def _known() -> dict[str, str]:
    pairs = _iso(SparkSession.active()._jvm.java.util.Locale) | EXTRA
    return pairs | {v: v for v in pairs.values()}


def iso3(code: Column) -> Column:
    """The same for a column, as a constant map."""
    pairs = F.create_map(*[F.lit(x) for pair in _known().items() for x in pair])
    return F.try_element_at(pairs, F.upper(F.trim(code)))
