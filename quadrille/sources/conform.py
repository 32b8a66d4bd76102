"""The panel contract of a source's frame, checked on the schema alone."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PanelError, PanelWarning
from .kinds import null_type, vocabulary
from .names import ENTITY, TIME, VIEWS, is_date

_TEMPORAL = {"date", "timestamp", "timestamp_ntz"}


def conform(panel: DataFrame, fields: set[str], strict: bool, name: str = "") -> DataFrame:
    """Missing index columns are an error; other deviations are errors if strict, else warned of and mended."""
    missing = [c for c in (ENTITY, TIME) if c not in panel.columns]
    if missing:
        raise PanelError("E-SOURCE-PANEL", f"source {name!r} lacks {missing}")
    kinds = {f.name: f.dataType.simpleString() for f in panel.schema.fields}
    known = vocabulary()
    admitted = [c for c in panel.columns if c in (ENTITY, TIME) or c in known or is_date(c) or c.startswith(VIEWS + ".")]
    absent = sorted(f for f in fields if f not in kinds)
    extra = sorted(set(panel.columns) - set(admitted))
    untimely = sorted(c for c in panel.columns if (c == TIME or is_date(c)) and kinds[c] not in _TEMPORAL)
    problems = [f"{what} {which}" for what, which in (("lacks", absent), ("has unknown", extra), ("has untimely", untimely)) if which]
    if problems and strict:
        raise PanelError("E-SOURCE-PANEL", f"source {name!r} " + "; ".join(problems))
    for p in problems:
        warnings.warn(f"W-SOURCE-PANEL source {name!r} {p}", PanelWarning, stacklevel=3)
    columns = [F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if (c == TIME or is_date(c)) and kinds[c] in _TEMPORAL else F.col(f"`{c}`") for c in admitted]
    return panel.select(*columns, *[F.lit(None).cast(null_type(f)).alias(f) for f in absent])


def assert_conforms(source, fields: set[str], frequency: str | None = None, expect_rows: bool = True) -> DataFrame:
    """For adapter tests: what the source loads has the index, the fields, and unique rows."""
    from .base import LoadRequest

    df = conform(source.load(LoadRequest(frozenset(fields), frequency or source.capabilities().frequency)), set(fields), True, type(source).__name__)
    keys = [ENTITY, TIME, *[c for c in df.columns if is_date(c)]]
    assert df.groupBy(*[F.col(f"`{k}`") for k in keys]).count().filter("count > 1").isEmpty(), "rows are not unique"
    assert not expect_rows or not df.isEmpty(), "no rows"
    return df
