import datetime as dt
import random

import pytest

from quadrille.errors import PanelError
from quadrille.plans import lower
from quadrille.plans.macros import prepare
from quadrille.sources.builtin import FrameSource, from_rows
from quadrille.sources.config import config_of
from quadrille.streaming.store import ParquetStore
from quadrille.streaming.views import ViewManager

DATA: dict = {}


class Versioned(FrameSource):
    """A source whose cells change, with a changefeed unless it is switched off."""

    def frame(self):
        return from_rows(self.spark, list(DATA["rows"].values()))

    def freshness_token(self):
        return str(DATA["version"])

    def changed_since(self, cursor):
        if not DATA["feed"]:
            return None
        cells = [k for v, k in DATA["log"] if v > int(cursor or 0)]
        return self.spark.createDataFrame(cells, "entity string, time timestamp_ntz")


def reset(feed=True):
    rows = {}
    rnd = random.Random(5)
    for e, s in (("A", "Tech"), ("B", "Tech"), ("C", "Energy"), ("D", "Energy")):
        for y in range(2015, 2023):
            t = dt.datetime(y, 12, 31)
            rows[e, t] = {"entity": e, "time": t, "income.revenue": float(rnd.randrange(1, 90)), "income.cogs": float(rnd.randrange(1, 90)), "meta.sector": s}
    DATA.update(rows=rows, version=0, log=[], feed=feed)


def change(entity, year, value, field="income.revenue"):
    key = (entity, dt.datetime(year, 12, 31))
    DATA["rows"][key][field] = value
    DATA["version"] += 1
    DATA["log"].append((DATA["version"], key))


def manager(spark, tmp_path):
    config = config_of({"sources": {"v": {"driver": f"{__name__}.Versioned"}}, "precedence": {"default": ["v"]}})
    return ViewManager(spark, config, ParquetStore(spark, {"dir": f"file://{tmp_path}/views"}))


def cells(df):
    return sorted(map(tuple, df.collect()), key=str)


PROGRAMS = [
    "track signal s = lag(income.revenue, 2)", "track signal s = roll_sum(income.revenue, 3)", "track signal s = cumsum(income.revenue)", "track signal s = ts_mean(income.revenue)",
    "track signal s = zscore(income.revenue) by meta.sector", "track signal s = rank(income.revenue)", "track signal s = zscore(yoy(income.revenue)) by meta.sector",
    "track model s { a = roll_mean(income.revenue, 2) / income.cogs score g weight 1 { 1 if a > 1 else 0 } export a export t = weighted_score() }",
    "track signal s = income.revenue - xs_mean(lag(income.cogs, 1))",
]


@pytest.mark.parametrize("text", PROGRAMS)
def test_incremental_equals_full(spark, tmp_path, text):
    reset()
    m, p = manager(spark, tmp_path), prepare(text)
    decl = p.named("s")
    m.serve(decl, p)
    rnd = random.Random(text)
    for _ in range(2):
        for _ in range(2):
            change(rnd.choice("ABCD"), rnd.randrange(2015, 2023), float(rnd.randrange(1, 99)), rnd.choice(["income.revenue", "income.cogs"]))
        calls = []
        build = m.build
        m.build = lambda *a: calls.append(1) or build(*a)  # noqa: B023
        got = cells(m.serve(decl, p))
        m.build = build
        assert not calls, "a full build"
        full, _ = m.compute(decl, p, m.panel(decl, p))
        assert got == cells(full)


def test_staleness(spark, tmp_path):
    reset()
    m = manager(spark, tmp_path)
    p = prepare("track signal s = income.revenue")
    assert m.materialise(p) == ["s"] and m.materialise(p) == []
    version = m.store.manifest("s").version
    m.serve(p.named("s"), p)
    assert m.store.manifest("s").version == version
    renamed = prepare("track signal s = income.revenue + 0")
    m.serve(renamed.named("s"), renamed)
    assert m.store.manifest("s").version != version
    DATA["feed"] = False
    change("A", 2020, 1.0)
    assert m.stale(renamed.named("s"), renamed)
    assert ("A", dt.datetime(2020, 12, 31), 1.0) in cells(m.serve(renamed.named("s"), renamed))


def test_regrouping_rebuilds(spark, tmp_path):
    reset()
    m, p = manager(spark, tmp_path), prepare("track signal s = zscore(income.revenue) by meta.sector")
    m.serve(p.named("s"), p)
    change("B", 2018, "Energy", "meta.sector")
    full, _ = m.compute(p.named("s"), p, m.panel(p.named("s"), p))
    assert cells(m.serve(p.named("s"), p)) == cells(full)


def test_views_of_views(spark, tmp_path):
    reset()
    m = manager(spark, tmp_path)
    p = prepare("track model rating { export score = yoy(income.revenue) } track signal top = rank(views.rating.score)")
    first = cells(m.serve(p.named("top"), p))
    assert m.store.list() == ["rating", "top"]
    change("C", 2019, 500.0)
    second = cells(m.serve(p.named("top"), p))
    assert first != second
    scoped = m.serve(p.named("top"), p, ["A"])
    assert {r[0] for r in cells(scoped)} == {"A"}
    cyclic = prepare("track signal a = views.b track signal b = views.a")
    with pytest.raises(PanelError, match="E-VIEW-CYCLE"):
        m.serve(cyclic.named("a"), cyclic)


def test_store(spark, tmp_path):
    with pytest.raises(PanelError, match="E-PROVIDER-OPTIONS"):
        ParquetStore(spark, {})
    s = ParquetStore(spark, {"dir": f"file://{tmp_path}/v"})
    assert s.list() == [] and s.read("x") is None and s.delete("x") is False
    for bad in ("../x", "a b", ""):
        with pytest.raises(PanelError, match="E-VIEW-NAME"):
            s.manifest(bad)


def test_store_keeps_what_is_being_read(spark, tmp_path):
    """A version is there until the next but one, and a draft that was never named counts for nothing."""
    from quadrille.streaming.store import Manifest

    s = ParquetStore(spark, {"dir": f"file://{tmp_path}/v"})
    reset()
    m, p = manager(spark, tmp_path), prepare("track signal s = cumsum(income.revenue)")
    m.serve(p.named("s"), p)
    some = m.store.manifest("s")
    assert isinstance(some, Manifest)
    s.write("x", spark.range(1), some)
    first = s.read("x")
    s.write("x", spark.range(2), some)
    assert first.count() == 1 and s.read("x").count() == 2
    (tmp_path / "v" / "x" / "draft-dead").write_text("{")
    s.write("x", spark.range(3), some)
    assert s.read("x").count() == 3 and len(s._manifests("x")) == 2 and s.list() == ["x"]


def test_follow_a_stream(spark, tmp_path):
    from quadrille.streaming.views import follow

    reset()
    m, p = manager(spark, tmp_path), prepare("track signal s = cumsum(income.revenue)")
    m.serve(p.named("s"), p)
    spark.createDataFrame([("A", 2016, 77.0)], "entity string, year int, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, year int, value double").parquet(str(tmp_path / "in"))

    def absorb(rows):
        for r in rows.collect():
            change(r.entity, r.year, r.value)

    follow(stream, m, p.named("s"), p, absorb, str(tmp_path / "ck")).awaitTermination()
    full = lower.run(p.named("s"), p, m.panel(p.named("s"), p))
    assert [r[2] for r in cells(m.store.read("s"))] == [r[2] for r in cells(full)]
