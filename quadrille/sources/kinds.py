"""The vocabulary: fields and their kinds. Core fields win over registered ones."""

from __future__ import annotations

from .names import VIEWS

# The core fields, all of kind meta.
CORE = {name: "meta" for name in ("meta.sector", "meta.exchange", "meta.market_cap", "meta.is_active", "meta.country")}
_TEXT = {"meta.sector", "meta.exchange", "meta.country"}

# How each kind is reduced to a coarser period.
AGG_OF_KIND = {
    "flow": "sum", "per_share": "sum", "rate": "mean", "ratio": "mean", "return": "compound",
    "stock": "last", "level": "last", "price": "last", "index": "last", "meta": "last",
}
STOCK_LIKE = {"stock", "level", "price", "index"}
UNREPEATABLE = {"flow", "return", "per_share"}

_registered: dict[str, str] = {}


def register_fields(kinds: dict[str, str]) -> None:
    _registered.update(kinds)


def forget_fields() -> None:
    _registered.clear()


def vocabulary() -> dict[str, str]:
    return _registered | CORE


def is_field(column: str) -> bool:
    return column in CORE or column in _registered or column.startswith(VIEWS + ".")


def kind_of(column: str) -> str | None:
    if column.startswith(VIEWS + "."):
        return "level"
    return CORE.get(column) or _registered.get(column)


def null_type(column: str) -> str:
    """The SQL type of a missing column."""
    if column in _TEXT:
        return "string"
    return "boolean" if column == "meta.is_active" else "double"
