"""The source contract."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class LoadRequest:
    fields: frozenset[str]
    frequency: str
    periods: tuple[int, int] | None = None
    entities: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Capabilities:
    frequency: str = "annual"
    frequencies: tuple[str, ...] = ()
    period_range: tuple[int, int] | None = None
    forms: tuple[str, ...] = ()
    provides_meta: bool = False
    provenance: str = ""
    entity_dim: str = "entity"
    bridge_field: str = ""
    pit: bool = False
    #: whether entity is always the global one; None: ask the data
    is_global: bool | None = None

    @property
    def served(self) -> tuple[str, ...]:
        return self.frequencies or (self.frequency,)


@dataclass(frozen=True)
class FieldInfo:
    field: str
    available: bool = True
    strategy: str = ""
    note: str = ""
    aligns_on: str | None = None


class DataSource(ABC):
    """A panel provider. load() returns entity, time, the fields, and any `__date:*` columns."""

    def __init__(self, spark: SparkSession, options: dict | None = None):
        self.spark, self.options = spark, options or {}

    @abstractmethod
    def load(self, request: LoadRequest) -> DataFrame: ...

    @abstractmethod
    def available_fields(self, frequency: str | None = None) -> set[str]: ...

    def capabilities(self) -> Capabilities:
        return Capabilities()

    def describe_field(self, field: str) -> FieldInfo | None:
        return None

    def entities(self) -> list[str] | None:
        return None

    def freshness_token(self) -> str | None:
        return None

    def changed_since(self, cursor: str | None) -> DataFrame | None:
        """(entity, time) cells that changed after the cursor; None if unknown."""
        return None

    def close(self) -> None:
        return None
