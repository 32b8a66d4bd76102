"""From requested columns to one panel: routing, fetching, coordinates, alignment, coalescing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PanelError
from ..functions.registry import OPS, Frame
from ..operators.align import Loaded, align, finest
from ..plans import nodes as N
from .base import DataSource, LoadRequest
from .config import Config, source_class
from .conform import conform
from .names import ENTITY, GLOBAL, TIME, date_column, decode, encode, is_date


@dataclass(frozen=True)
class Request:
    frequency: str | None
    field: str
    column: str  # as the expressions name it
    entity: str | None = None
    source: str | None = None


def request_of(column: str) -> Request:
    frequency, name, entity, source = decode(column)
    return Request(frequency, name, column, entity, source)


class Session:
    """Sources of a config, made once and closed at the end."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.made = spark, config, {}

    def __getitem__(self, name: str) -> DataSource:
        if name not in self.made:
            spec = self.config.sources[name]
            self.made[name] = source_class(spec.driver)(self.spark, spec.options)
        return self.made[name]

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        for s in self.made.values():
            s.close()


class Routing:
    """Which sources serve each request, in order of precedence."""

    def __init__(self, config: Config, columns: set[str], sources: Session):
        self.config, self.sources = config, sources
        self.order = list(dict.fromkeys([*config.precedence["default"], *(s for k in sorted(config.precedence) if k != "default" for s in config.precedence[k]), *config.sources]))
        self._fields: dict[tuple[str, str], set[str]] = {}
        self.requested = {request_of(c) for c in columns}
        self.bridges = {
            caps.bridge_field
            for r in self.requested
            for s in self.serving(r)
            if (caps := sources[s].capabilities()).entity_dim != ENTITY and caps.bridge_field
        }
        self.pending = sorted(self.requested | {request_of(b) for b in self.bridges}, key=lambda r: r.column)

    def chain(self, r: Request) -> list[str]:
        if r.source is not None:
            if r.source not in self.config.sources:
                raise PanelError("E-PIN-SOURCE-UNKNOWN", f"'@ {r.source}' pins an undeclared source; declared are {sorted(self.config.sources)}")
            return [r.source]
        return self.config.precedence.get(r.field.split(".", 1)[0], self.config.precedence["default"])

    def serves(self, name: str, r: Request) -> bool:
        caps = self.sources[name].capabilities()
        frequency = r.frequency or caps.frequency
        if frequency not in caps.served:
            return False
        key = (name, frequency)
        if key not in self._fields:
            self._fields[key] = self.sources[name].available_fields(frequency=frequency)
        return r.field in self._fields[key]

    def serving(self, r: Request) -> list[str]:
        return [s for s in self.chain(r) if self.serves(s, r)]

    def coalesced(self, r: Request) -> bool:
        """Served by several sources, cell by cell."""
        found = self.serving(r)
        if r.entity is not None or r.source is not None or r.column in self.bridges or len(found) < 2:
            return False
        dims = sorted({self.sources[s].capabilities().entity_dim for s in found})
        if len(dims) > 1:
            raise PanelError("E-COALESCE-DIM-MIXED", f"{r.field!r} comes from sources of dimensions {dims}; pin one source")
        return True

    def unserved(self) -> list[PanelError]:
        out = []
        for r in self.pending:
            if self.serving(r):
                continue
            if r.source is not None:
                out.append(PanelError("E-PIN-UNSERVED", f"'@ {r.source}' pins a source that does not provide {r.field!r}" + (f" at {r.frequency}" if r.frequency else "")))
            elif r.frequency is not None:
                out.append(PanelError("E-FREQ-UNAVAILABLE", f"no source provides {r.field!r} at {r.frequency}"))
            elif r.column not in self.bridges:
                out.append(PanelError("E-FIELD-UNSERVED", f"no source provides {r.field!r}"))
        return out


def coverage(spark: SparkSession, config: Config, columns: set[str]) -> list[PanelError]:
    """What no source can serve, without loading anything."""
    with Session(spark, config) as sources:
        return Routing(config, columns, sources).unserved()


def _coordinate(e: object, dates: set[str]) -> Column:
    match e:
        case N.Name():
            c = date_column(e.name)
            if c not in dates:
                have = sorted(d.removeprefix(date_column("")) for d in dates)
                raise PanelError("E-ALIGN-UNKNOWN", f"@align names date column {e.name!r}; the source has {have or 'none'}")
            return F.col(f"`{c}`")
        case N.Call() if e.name in OPS:
            op = OPS[e.name]
            return op.lower([a.value if i in op.raw and isinstance(a, N.Literal) else _coordinate(a, dates) for i, a in enumerate(e.args)], Frame())
        case N.Literal():
            return F.lit(e.value)
    raise PanelError("E-ALIGN-EXPR", "@align takes only temporal functions over date columns")


def _dates_in(e: object) -> set[str]:
    return {date_column(x.name) for x in N.walk(e) if isinstance(x, N.Name)}


def load_panel(
    spark: SparkSession, config: Config, columns: set[str], target: str | None = None,
    entities: list[str] | None = None, aligns: dict[str, object] | None = None,
) -> DataFrame:
    """The panel with the requested physical columns. Sources are loaded lazily; only a global series,
    a pinned entity and missing coordinates are looked up in the data."""
    with Session(spark, config) as sources:
        return _load(config, columns, target, entities, aligns or {}, sources)


def _load(config: Config, columns: set[str], target: str | None, entities: list[str] | None, aligns: dict, sources: Session) -> DataFrame:
    route = Routing(config, columns, sources)
    for problem in route.unserved():
        raise problem
    pins = {r.entity for r in route.requested if r.entity}
    if entities is not None:
        entities = sorted({*entities, *pins})
    tags: dict[str, list[str]] = {}
    fetches: dict[tuple[str, str], dict[str, Request]] = {}
    for r in route.pending:
        serving = route.serving(r)
        many = route.coalesced(r)
        if many:
            tags[r.column] = [encode(r.field, r.frequency, source=s) for s in serving]
        for s in serving if many else serving[:1]:
            frequency = r.frequency or sources[s].capabilities().frequency
            name = encode(r.field, r.frequency, source=s) if many else r.column
            have = fetches.setdefault((s, frequency), {})
            if name not in have or r.column < have[name].column:  # a plain reference's coordinate over a pinned one's
                have[name] = r
    loaded: list[Loaded] = []
    for s in route.order:
        for (owner, frequency), wanted in sorted(fetches.items()):
            if owner == s:
                loaded += _fetch(sources[s], s, frequency, wanted, config, entities, aligns)
    if not loaded:
        raise PanelError("E-SOURCE-EMPTY", "no source provides the requested fields")
    plain = len(loaded) == 1 and target is None and not loaded[0].coordinates and not tags
    if plain and loaded[0].is_global is not True and not (loaded[0].is_global is None and _all_global(loaded[0].panel)):
        panel = loaded[0].panel
    else:
        panel = align(loaded, target or finest([x.freq for x in loaded]))
    asked = {r.column for r in route.requested}
    drop = {t for names in tags.values() for t in names} - asked
    merged = {c: F.coalesce(*[F.col(f"`{t}`") for t in names]) for c, names in tags.items()}
    if tags:
        keep = [c for c in panel.columns if c not in drop and c not in merged]
        panel = panel.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(c) for c, v in sorted(merged.items())])
    if config.periods is not None:
        first, last = config.periods  # a range of time, which reaches a scan's statistics
        panel = panel.filter((F.col(TIME) >= _new_year(first)) & (F.col(TIME) < _new_year(last + 1)))
    return panel


def _new_year(year: int):
    return F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")


def _all_global(panel: DataFrame) -> bool:
    seen = panel.agg(F.count(F.when(F.col(ENTITY) == GLOBAL, 1)).alias("g"), F.count("*").alias("n")).first()
    return seen.n > 0 and seen.g == seen.n


def _fetch(src: DataSource, name: str, frequency: str, wanted: dict[str, Request], config: Config, entities: list[str] | None, aligns: dict) -> list[Loaded]:
    caps = src.capabilities()
    naive = config.pit == "naive" or src.options.get("pit") == "naive"
    scope = tuple(entities) if entities is not None and caps.entity_dim == ENTITY else None
    fields = {r.field for r in wanted.values()}
    panel = conform(src.load(LoadRequest(frozenset(fields), frequency, config.periods, scope)), fields, config.strict, name)
    dates = {c for c in panel.columns if is_date(c)}
    out = []

    def known_by(r: Request) -> str | None:
        info = None if naive else src.describe_field(r.field)
        c = date_column(info.aligns_on) if info is not None and info.aligns_on else None
        return c if c in dates else None

    plain = {t: r for t, r in sorted(wanted.items()) if r.entity is None}
    if plain:
        coordinates = {t: c for t, r in plain.items() if (c := known_by(r))}
        own = {t: aligns[r.column] for t, r in plain.items() if r.column in aligns and not naive}
        carried = sorted(set(coordinates.values()) | {d for e in own.values() for d in _dates_in(e)} & dates)
        df = panel.select(ENTITY, TIME, *[F.col(f"`{r.field}`").alias(t) for t, r in plain.items()], *[F.col(f"`{d}`") for d in carried])
        for t, e in own.items():
            c = date_column(f"__align__{t}")
            df = df.withColumn(c, _coordinate(e, dates))
            kind = df.schema[c].dataType.simpleString()
            if kind not in ("date", "timestamp", "timestamp_ntz"):
                raise PanelError("E-ALIGN-DTYPE", f"@align for {t!r} must give a datetime, not {kind}")
            df = df.withColumn(c, F.col(f"`{c}`").cast("timestamp_ntz"))
            coordinates[t] = c
        out.append(Loaded(df, frequency, caps.entity_dim, coordinates, caps.bridge_field, caps.is_global))
    for t, r in sorted(wanted.items()):
        if r.entity is not None:  # a pinned entity is a global series
            one = panel.filter(F.col(ENTITY) == r.entity)
            if one.isEmpty():
                raise PanelError("E-ENTITY-UNKNOWN", f"entity {r.entity!r} has no rows for {r.field!r} in source {name!r}")
            c = known_by(r)
            df = one.select(F.lit(GLOBAL).alias(ENTITY), TIME, F.col(f"`{r.field}`").alias(t), *([F.col(f"`{c}`")] if c else []))
            out.append(Loaded(df, frequency, ENTITY, {t: c} if c else {}, "", True))
    return out
