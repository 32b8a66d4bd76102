"""Tracked views: built once, served until stale, recomputed where their inputs changed.

The result of an incremental refresh equals a full build, cell for cell.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import PanelError
from ..plans import lower
from ..plans import nodes as N
from ..plans.needs import bound_universe, root_chain, scoped_needs
from ..sources.base import Capabilities, DataSource, LoadRequest
from ..sources.config import Config, Spec
from ..sources.loader import Session, load_panel
from ..sources.names import ENTITY, TIME, VIEWS, canonical
from .footprint import Index, footprint, replace_rows
from .store import Manifest, ViewStore, view_columns

#: Entities up to which a refresh scopes its load; beyond it the load is whole and only the merge is scoped.
SCOPED_ENTITIES = 10_000


def recipe_of(decl: N.Model | N.Signal, program: N.Program) -> str:
    """A hash of what is computed, whatever its name."""
    chain = tuple(root_chain(bound_universe(decl, program), program))
    body = (decl.universe, decl.frequency, decl.expr if isinstance(decl, N.Signal) else (decl.on_missing, decl.statements))
    return hashlib.sha256(N.text_of((type(decl).__name__, chain, body)).encode()).hexdigest()[:16]


def config_key(config: Config) -> str:
    sources = sorted((n, s.driver, repr(sorted(s.options.items(), key=lambda x: x[0]))) for n, s in config.sources.items() if n != "__views")
    return hashlib.sha256(repr((sources, sorted(config.precedence.items()), config.periods, config.strict, config.pit)).encode()).hexdigest()[:16]


def groups_of(decl: N.Model | N.Signal) -> set[str]:
    return {".".join(x.by) for e in N.expressions(decl) for x in N.walk(e) if isinstance(x, N.Call) and x.by}


def group_hashes(panel: DataFrame, by: set[str]) -> dict[str, str]:
    """A hash of each group column's members, by one aggregate."""
    names = sorted(b for b in by if b in panel.columns)
    if not names:
        return {}
    row = panel.agg(*[F.sum(F.xxhash64("entity", "time", F.col(f"`{b}`")).cast("decimal(38,0)")).alias(f"h{i}") for i, b in enumerate(names)], F.count("*").alias("n")).first()
    return {b: f"{row[i]}:{row['n']}" for i, b in enumerate(names)}


class ViewSource(DataSource):
    """Stored views as `views.*` fields. options.store is a ViewStore."""

    @property
    def store(self) -> ViewStore:
        return self.options["store"]

    def _holding(self, fields) -> list[Manifest]:
        names = sorted({f.split(".")[1] for f in fields if f.startswith(VIEWS + ".")})
        return [m for n in names if (m := self.store.manifest(n)) is not None]

    def available_fields(self, frequency: str | None = None) -> set[str]:
        return {c for n in self.store.list() for c in self.store.manifest(n).columns}

    def load(self, request: LoadRequest) -> DataFrame:
        frames = [self.store.read(m.name).select(ENTITY, TIME, *[f"`{c}`" for c in m.columns if c in request.fields]) for m in self._holding(request.fields)]
        df = reduce(lambda a, b: a.join(b, [ENTITY, TIME], "full"), frames)
        return df if request.entities is None else df.filter(F.col(ENTITY).isin(list(request.entities)))

    def capabilities(self) -> Capabilities:
        frequency = next((m.frequency for n in self.store.list() if (m := self.store.manifest(n)) and m.frequency), "annual")
        return Capabilities(frequency, N.FREQUENCIES, provenance="views", is_global=False)

    def freshness_token(self) -> str | None:
        return ",".join(self.store.manifest(n).fingerprint for n in self.store.list())


def with_views(config: Config, store: ViewStore) -> Config:
    """The config with the store as a source of `views.*`."""
    return Config(
        config.sources | {"__views": Spec("quadrille.streaming.views.ViewSource", {"store": store})},
        config.precedence | {VIEWS: ["__views"]}, config.periods, config.strict, config.pit, config.providers, config.path,
    )


class ViewManager:
    def __init__(self, spark: SparkSession, config: Config, store: ViewStore):
        self.spark, self.plain, self.store = spark, config, store
        self.config = with_views(config, store)

    # what a view rests on

    def deps(self, decl: N.Model | N.Signal, program: N.Program) -> set[str]:
        """Views named by the declaration's `views.*` fields."""
        parts = (canonical(f).split(".") for f in scoped_needs(decl, program).fields)
        return {p[1] for p in parts if len(p) >= 2 and p[0] == VIEWS}

    def _reaches(self, target: str, names: set[str], program: N.Program) -> bool:
        seen, work = set(), list(names)
        while work:
            n = work.pop()
            if n == target:
                return True
            if n in seen:
                continue
            seen.add(n)
            d = program.named(n)
            if d is not None:
                work += self.deps(d, program)
            elif (m := self.store.manifest(n)) is not None:
                work += m.deps
        return False

    def _fingerprints(self, names) -> dict[str, str]:
        return {n: m.fingerprint if (m := self.store.manifest(n)) is not None else "" for n in sorted(names)}

    def _tokens(self) -> dict[str, str | None]:
        with Session(self.spark, self.plain) as sources:
            return {n: sources[n].freshness_token() for n in self.plain.sources}

    def stale(self, decl: N.Model | N.Signal, program: N.Program) -> bool:
        m = self.store.manifest(decl.name)
        return m is None or not self._same(m, decl, program) or self._tokens() != m.freshness

    def _same(self, m: Manifest, decl, program) -> bool:
        return m.recipe == recipe_of(decl, program) and m.config == config_key(self.plain) and self._fingerprints(m.deps) == m.deps

    # building

    def panel(self, decl, program, entities: list[str] | None = None) -> DataFrame:
        n = scoped_needs(decl, program)
        return load_panel(self.spark, self.config, n.fields, decl.frequency, entities, n.aligns)

    def compute(self, decl, program, panel: DataFrame) -> tuple[DataFrame, Manifest]:
        out = lower.run(decl, program, panel)
        exports = tuple(out.columns[2:])
        kind = "signal" if isinstance(decl, N.Signal) else "model"
        columns = view_columns(kind, decl.name, exports)
        frame = out.select(ENTITY, TIME, *[F.col(f"`{e}`").alias(c) for e, c in zip(exports, columns, strict=True)])
        return frame, Manifest(
            decl.name, kind, exports, columns, recipe_of(decl, program), config_key(self.plain), self._tokens(),
            group_hashes(panel, groups_of(decl)), self._fingerprints(self.deps(decl, program)), decl.frequency,
            built_at=dt.datetime.now(dt.UTC).isoformat(),
        )

    def build(self, decl, program) -> DataFrame:
        self.store.write(decl.name, *self.compute(decl, program, self.panel(decl, program)))
        return self.store.read(decl.name)

    def materialise(self, program: N.Program) -> list[str]:
        """Build every stale tracked view; the names of those that were."""
        todo = [d for d in program.decls if isinstance(d, N.Model | N.Signal) and d.track and self.stale(d, program)]
        for d in todo:
            self.build(d, program)
        return [d.name for d in todo]

    # serving

    def serve(self, decl, program, entities: list[str] | None = None) -> DataFrame:
        """The view, fresh. A request for some entities is computed and never stored."""
        deps = self.deps(decl, program)
        if self._reaches(decl.name, deps, program):
            raise PanelError("E-VIEW-CYCLE", f"view {decl.name!r} refers to itself")
        for n in sorted(deps):
            if (d := program.named(n)) is not None:
                self.serve(d, program)
        if entities is not None:
            return self.compute(decl, program, self.panel(decl, program, entities))[0]
        m = self.store.manifest(decl.name)
        if m is None or not self._same(m, decl, program):
            return self.build(decl, program)
        dirty = self.changes(m)
        if dirty is None:
            return self.build(decl, program)
        return self.refresh(decl, program, m, dirty) if dirty else self.store.read(decl.name)

    def changes(self, m: Manifest) -> dict[str, DataFrame] | None:
        """Changed cells of each field since the manifest; {} if nothing changed, None if unknown."""
        dirty: dict[str, DataFrame] = {}
        with Session(self.spark, self.plain) as sources:
            for name in self.plain.sources:
                src, cursor = sources[name], m.freshness.get(name)
                cells = src.changed_since(cursor)
                if cells is None:
                    if src.freshness_token() != cursor:
                        return None
                    continue
                cells = cells.select(F.col(ENTITY).cast("string").alias(ENTITY), F.col(TIME).cast("timestamp_ntz").alias(TIME)).distinct()
                if cells.isEmpty():
                    continue
                for f in {f for q in src.capabilities().served for f in src.available_fields(q)}:
                    dirty[f] = dirty[f].union(cells).distinct() if f in dirty else cells
        return dirty

    def refresh(self, decl, program, m: Manifest, dirty: dict[str, DataFrame]) -> DataFrame:
        """Recompute and merge the cells that the changes reach."""
        by = groups_of(decl)
        panel = self.panel(decl, program)
        if len(by) >= 2 or group_hashes(panel, by) != m.groups:
            return self.build(decl, program)
        cells = footprint(decl, dirty, Index.of(panel, by))
        if cells is None:
            return self.store.read(decl.name)
        cells = cells.persist()
        try:
            touched = [r[0] for r in cells.select(ENTITY).distinct().limit(SCOPED_ENTITIES + 1).collect()]
            if not touched:
                return self.store.read(decl.name)
            # cross-sections need their whole groups, which the footprint holds
            fresh, manifest = self.compute(decl, program, panel)
            if len(touched) <= SCOPED_ENTITIES:
                fresh = fresh.join(F.broadcast(cells.select(ENTITY).distinct()), ENTITY, "left_semi")
            self.store.write(decl.name, replace_rows(self.store.read(decl.name), fresh, cells), manifest)
        finally:
            cells.unpersist()
        return self.store.read(decl.name)


def follow(stream: DataFrame, manager: ViewManager, decl, program: N.Program, absorb: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Keep a view fresh behind a stream of changed rows: absorb() puts each micro-batch into the sources,
    then the view is served again. Batches may repeat after a failure, so absorb must be idempotent."""

    def batch(rows: DataFrame, _: int) -> None:
        absorb(rows)
        manager.serve(decl, program)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
