"""Column names of qualified fields: `freq.` before, `@entity` or `#source` after the dotted path."""

from __future__ import annotations

from ..plans.nodes import FREQUENCIES

ENTITY, TIME, GLOBAL = "entity", "time", "*"
DATE_PREFIX = "__date:"
VIEWS = "views"


def encode(column: str, frequency: str | None = None, entity: str | None = None, source: str | None = None) -> str:
    name = f"{frequency}.{column}" if frequency else column
    if entity is not None:
        return f"{name}@{entity}"
    return f"{name}#{source}" if source is not None else name


def decode(name: str) -> tuple[str | None, str, str | None, str | None]:
    """(frequency, column, entity, source)."""
    base, at, entity = name.partition("@")
    base, mark, source = base.partition("#")
    first, _, rest = base.partition(".")
    if first in FREQUENCIES and "." in rest:
        return first, rest, entity if at else None, source if mark else None
    return None, base, entity if at else None, source if mark else None


def canonical(name: str) -> str:
    return decode(name)[1]


def date_column(name: str) -> str:
    return DATE_PREFIX + name


def is_date(name: str) -> bool:
    return name.startswith(DATE_PREFIX)
