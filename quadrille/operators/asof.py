"""Backward as-of join: one exchange, no pairs.

Both sides are put one under the other and each left row takes the last right row at or before it in
its key's order. The whole right row is carried, so a null in it stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.names import TIME


def asof_join(left: DataFrame, right: DataFrame, on: str, keys: list[str], values: list[str], left_on: str = TIME, ties: str | None = None) -> DataFrame:
    """left with `values` of the latest right row of its keys with right.on <= left.left_on.

    ties: among right rows with equal `on`, the greatest of this column counts as latest.
    """
    q = lambda c: F.col(f"`{c}`")
    kept = left.columns
    order = q(ties) if ties and ties in right.columns else F.lit(None).cast("timestamp_ntz")
    row = F.struct(*[q(c).alias(f"v{i}") for i, c in enumerate(values)])
    empty = F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType)
    mine = left.select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], q(left_on).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("timestamp_ntz").alias("__tie"), F.struct(*[q(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("__left"), empty.alias("__right"))
    theirs = right.filter(q(on).isNotNull()).select(*[q(k).alias(f"__k{i}") for i, k in enumerate(keys)], q(on).alias("__at"), F.lit(0).alias("__side"), order.alias("__tie"), F.lit(None).cast(mine.schema["__left"].dataType).alias("__left"), row.alias("__right"))
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = mine.unionByName(theirs).withColumn("__found", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    return seen.select(*[F.col(f"__left.c{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"__found.v{i}").alias(c) for i, c in enumerate(values)])


def asof_global(left: DataFrame, right: DataFrame, on: str, values: list[str], left_on: str = TIME, ties: str | None = None) -> DataFrame:
    """The same without keys: the distinct instants of the left side meet the series, then join back.

    The number of instants is that of the calendar, so one window over instants and series is small
    however many entities there are.
    """
    q = lambda c: F.col(f"`{c}`")
    instants = left.select(q(left_on)).distinct()
    found = asof_join(instants.withColumn("__one", F.lit(0)), right.withColumn("__one", F.lit(0)), on, ["__one"], values, left_on, ties)
    return left.join(found.drop("__one"), left_on, "left")
