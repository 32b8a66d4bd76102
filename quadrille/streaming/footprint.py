"""Which output cells a change of input cells can reach, as DataFrames of (entity, time).

A lag of k reaches k rows ahead, a window of n rows n - 1, cumulative and calendar windows all rows
ahead, whole-series operators the whole entity, and cross-sections the whole group at that
time. A cell that the panel does not hold widens to its entity or its period.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import AHEAD, ENTITY_WIDE, LAG, OPS, TS, WINDOW, XS
from ..plans import nodes as N

CELL = ["entity", "time"]


@dataclass
class Index:
    """The panel's cells with each row's place in its series, and the group columns."""

    cells: DataFrame

    @staticmethod
    def of(panel: DataFrame, by: set[str]) -> Index:
        place = F.row_number().over(Window.partitionBy("entity").orderBy("time"))
        return Index(panel.select("entity", "time", *[F.col(f"`{b}`") for b in sorted(by) if b in panel.columns], place.alias("__n")))

    def entity(self, cells: DataFrame) -> DataFrame:
        return self.cells.join(cells.select("entity").distinct(), "entity", "left_semi").select(CELL).union(cells).distinct()

    def ahead(self, cells: DataFrame, reach: int | None) -> DataFrame:
        """reach None: to the end."""
        known = self.cells.join(cells, CELL, "left_semi").select("entity", "__n")
        lost = cells.join(self.cells, CELL, "left_anti").select("entity").distinct()
        if reach is None:
            first = known.groupBy("entity").agg(F.min("__n").alias("__from"))
            found = self.cells.join(first, "entity").filter("__n >= __from").select(CELL)
        else:
            spread = known.select("entity", F.explode(F.sequence(F.col("__n"), F.col("__n") + reach)).alias("__n")).distinct()
            found = self.cells.join(spread, ["entity", "__n"], "left_semi").select(CELL)
        whole = self.cells.join(lost, "entity", "left_semi").select(CELL)
        return found.union(whole).union(cells).distinct()

    def group(self, cells: DataFrame, by: str | None) -> DataFrame:
        if by is None or by not in self.cells.columns:
            hit = cells.select("time").distinct()
            return self.cells.join(hit, "time", "left_semi").select(CELL).union(cells).distinct()
        g = F.col(f"`{by}`")
        keys = self.cells.join(cells, CELL, "left_semi").select("time", g.alias("__g")).distinct()
        own = self.cells.withColumn("__g", g)
        found = own.alias("a").join(keys.alias("b"), (F.col("a.time") == F.col("b.time")) & F.col("a.__g").eqNullSafe(F.col("b.__g")), "left_semi").select("entity", "time")
        lost = cells.join(self.cells, CELL, "left_anti").select("time").distinct()
        return found.union(self.cells.join(lost, "time", "left_semi").select(CELL)).union(cells).distinct()


def reach_of(e: N.Call) -> int | None:
    """Rows ahead; None: to the end."""
    kind = OPS[e.name].reach
    n = e.args[1].value if len(e.args) > 1 and isinstance(e.args[1], N.Literal) else None
    if kind in (LAG, WINDOW) and isinstance(n, int) and not isinstance(n, bool):
        return n if kind == LAG else max(n - 1, 0)
    return None


class Footprint:
    """dirty: the cells that changed, for every field of the sources that changed; fields: those fields."""

    def __init__(self, index: Index, dirty: dict[str, DataFrame], names: dict[str, object]):
        self.index, self.dirty, self.names, self.memo = index, dirty, names, {}

    def of(self, e: object) -> DataFrame | None:
        if e not in self.memo:
            self.memo[e] = self._of(e)
        return self.memo[e]

    def _of(self, e: object) -> DataFrame | None:
        match e:
            case N.Field():
                return self.dirty.get(e.column)
            case N.Name():
                inner = self.names.get(e.name)
                return None if inner is None else self.of(inner)
        parts = [c for x in N.children(e) if (c := self.of(x)) is not None]
        if not parts:
            return None
        cells = parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).distinct()
        if not (isinstance(e, N.Call) and e.name in OPS):
            return cells
        op = OPS[e.name]
        if op.axis == XS:
            return self.index.group(cells, ".".join(e.by) if e.by else None)
        if op.axis == TS:
            return self.index.entity(cells) if op.reach == ENTITY_WIDE else self.index.ahead(cells, reach_of(e) if op.reach != AHEAD else None)
        return cells


def footprint(decl: N.Model | N.Signal, dirty: dict[str, DataFrame], index: Index) -> DataFrame | None:
    """Cells of the declaration's outputs to compute anew; None if there are none."""
    if isinstance(decl, N.Signal):
        return Footprint(index, dirty, {}).of(decl.expr)
    names = {s.name: s.expr for s in decl.statements if isinstance(s, N.Assign) and s.expr is not None}
    f = Footprint(index, dirty, names)
    tops = [s.expr if s.expr is not None else N.Name(s.name) for s in decl.statements if isinstance(s, N.Assign) and s.export]
    tops += [c for s in decl.statements if isinstance(s, N.Score) for _, c in s.cases]
    found = [c for e in tops if (c := f.of(e)) is not None]
    return reduce(DataFrame.union, found).distinct() if found else None


def replace_rows(stored: DataFrame, fresh: DataFrame, cells: DataFrame) -> DataFrame:
    """stored with the rows of `cells` taken from fresh."""
    columns = [F.col(f"`{c}`") for c in stored.columns]
    kept = stored.join(cells, CELL, "left_anti").select(columns)
    return kept.unionByName(fresh.join(cells, CELL, "left_semi").select(columns))
