import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import chat, decontaminate, jaccard, queries, warc
from quadrille.llm.common import text_blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})

# 7


def plain_components(rows, n, p):
    """(n_shingles, component) of each (id, text), by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and 100 * inter >= p * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=12, most=7):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rnd.choice(vocabulary) for _ in range(60)]
    rows, i = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([2, 5, 12, 30, 80, 250, 900]))]
        if rnd.random() < 0.4:
            base += shared
        for _ in range(rnd.randrange(1, most)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, len(words) // 30])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((i := i + 1, rnd.choice([" ", "\n", "\t "]).join(w.upper() if rnd.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize(("seed", "n", "p"), [(1, 3, 90), (2, 5, 80), (3, 3, 60), (4, 1, 95)])
def test_components_against_all_pairs(spark, seed, n, p):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n, p).collect()}
    assert got == plain_components(rows, n, p)


def test_chains_in_a_large_group(spark, monkeypatch):
    """A chain of near copies whose ends are far apart: no centre links all, so tiles must."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    rnd = random.Random(9)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = list(words)
        for _ in range(2):
            words[rnd.randrange(len(words))] = f"u{rnd.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 3, 90).collect()}
    assert got == plain_components(rows, 3, 90)


@pytest.mark.parametrize("crowd", [4, 64])
def test_pairs_of_many_tiles_come_once(spark, monkeypatch, crowd):
    """Copies a little too far apart share many tiles; a pair of them is a candidate of few groups."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rows = [(i, " ".join(f"u{k}" if k % 17 == i else f"w{k}" for k in range(289))) for i in range(17)]  # any two: 68 words differ, 64 may
    seen = []

    def counted(*given, plain=jaccard.tiles):
        out = plain(*given)
        seen.append((out.count(), out.select("x", "y").distinct().count()))
        return out

    monkeypatch.setattr(jaccard, "tiles", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 1, 80).collect()}
    assert got == plain_components(rows, 1, 80)
    assert sum(b for _, b in seen) > 30 and all(a <= 6 * b for a, b in seen), seen


def test_only_sets_that_bitmaps_leave_are_stored(spark, monkeypatch):
    """Sets that share parts but differ clearly stand on disk as bitmaps alone; those of pairs that may link are made again."""
    texts = {i: [f"c{j}" for j in range(6000)] + [f"d{i}x{j}" for j in range(2000)] for i in range(12)}
    texts[12], texts[13] = texts[0][:-10], texts[1][:-10]
    rows = [(i, " ".join(x)) for i, x in texts.items()] + [(0, "another text of this id"), (0, " ".join(texts[0])), (None, " ".join(texts[2][:-10]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    active, made = [], []

    def counted(df, name, *given, plain=jaccard.stored):
        out = plain(df, name, *given)
        if name == "payload":
            active.append(out.count())
        if "shingles" in out.columns:
            made.append({r.node for r in out.select("node").collect()})
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(df, 1, 80).collect()}
    assert got == {(i, len(x)): i for i, x in texts.items()} | {(12, 7990): 0, (13, 7990): 1, (0, 5): 0, (None, 7990): 2}
    assert active[-1] == 15 and made and len(set().union(*made)) == 6, (active, made)


def test_brief_bitmaps_of_large_sets():
    """Folded bitmaps tell large sets that have nothing in common apart, and one that has few bits hides no others."""
    texts = [" ".join(f"{c}{i}" for i in range(5000)) for c in "ab"]
    out = next(jaccard._payload_task(5, 80)(iter([pa.record_batch([pa.array(texts)], names=["text"])])))
    size, brief = out.column(1).to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in out.column(3)]
    assert not jaccard.may_link(size[0], brief[0], size[1], brief[1], 80)

    sets = [np.arange(1, 2001, dtype=np.uint64) * np.uint64(7919) + np.uint64(i * 10**9) for i in range(2)] + [np.arange(1, 1700, dtype=np.uint64)]
    bits = [jaccard.bitmap(x, 80) for x in sets]
    columns = {"sig": [5] * 4, "tile": [0] * 4, "side": [3] * 4, "node": [1, 2, 3, 4], "label": [1, 2, 3, 4], "size": [2000, 2000, 1699, 2000]}
    table = pa.record_batch([*(pa.array(x) for x in columns.values()), pa.array([x.tobytes() for x in (bits[0], bits[1], jaccard.fold(bits[2], 1), bits[0])], pa.binary())], names=[*columns, "bits"])
    found = {(x, y) for b in jaccard._tile_task(80, False)(iter([table])) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert (1, 4) in found and not found & {(1, 2), (2, 4)}


def test_rows_of_a_large_group(spark, monkeypatch):
    """Rows dealt out for a group of many blocks grow less than with its square, and all pairs of components meet."""
    monkeypatch.setattr(jaccard, "TILE", 4)

    def dealt(members):
        rows = spark.createDataFrame([(1, i, i, 0, members) for i in range(members)], "sig long, node long, label long, main long, all long")
        bits = spark.createDataFrame([(i, 100, bytes(8)) for i in range(members)], "node long, size long, brief binary")
        with monkeypatch.context() as m:
            m.setattr(jaccard, "_tile_task", lambda p, nearest: lambda batches: (pa.record_batch([pa.array([b.num_rows]), pa.array([0]), pa.array([0])], names=["x", "y", "more"]) for b in batches))
            count = sum(r.x for r in jaccard.tiles(rows, bits, 90, False).collect())
        return count, {(r.x, r.y) for r in jaccard.tiles(rows, bits, 90, False).collect()}

    (few, _), (many, pairs) = dealt(16), dealt(256)
    assert many <= 80 * few, (few, many)
    assert pairs == {(i, j) for j in range(256) for i in range(j)}


def test_without_broadcasts(spark, monkeypatch):
    from quadrille.llm import common

    monkeypatch.setattr(common, "BROADCAST_IDS", -1)
    monkeypatch.setattr(common, "BROADCAST_STRATA", -1)
    monkeypatch.setattr(jaccard, "EDGES_A_TASK", -1)
    rows = corpus(7)
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in rows], "doc_id long, text string, kind string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 3, 90).collect()}
    assert got == plain_components(rows, 3, 90)
    ids = common.sample_ids(df, "doc_id", ["kind"], 3).collect()
    assert sorted(r.kind for r in ids) == ["a"] * 3 + ["b"] * 3


def test_sweep_deletes(spark, tmp_path):
    from quadrille.llm import common

    common.stored(spark.range(3).toDF("a"), "kept")
    path = common._written[-1]
    assert spark.read.parquet(path).count() == 3
    common.sweep(spark)
    import os

    assert not os.path.exists(path.removeprefix("file:")) and not common._written


def test_keys_find_every_link():
    """Sets that differ as much as the threshold allows share a key, also when parts are empty."""
    rng = np.random.default_rng(1)
    for p in (60, 80, 90, 95):
        bands = jaccard.Bands(p)
        for _ in range(300):
            size = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 2**63, size, np.int64).astype(np.uint64))
            keep = rng.permutation(a)[: max(1, int(len(a) * rng.uniform(p / 100 - 0.05, 1)))]
            b = np.unique(np.concatenate((keep, rng.integers(0, 2**63, int(rng.integers(0, 4)), np.int64).astype(np.uint64))))
            if not jaccard.links(a, b, p) or np.array_equal(a, b):
                continue
            nodes = jaccard.node_of([a, b])
            keys, owner = jaccard.signatures([a, b], nodes, bands)
            assert set(keys[owner == nodes[0]].tolist()) & set(keys[owner == nodes[1]].tolist()), (p, len(a), len(b))
            assert jaccard.may_link(len(a), jaccard.bitmap(a, p), len(b), jaccard.bitmap(b, p), p)


def test_packed_keys():
    rng = np.random.default_rng(2)
    for n in (1, 7, 3000):
        sig = np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64))
        node, hot = rng.integers(0, 50, n).astype(np.uint64) * np.uint64(1 << 58), rng.random(n) < 0.3
        for centre in (None, node[::-1].copy()):
            back = jaccard.unpacked(jaccard.packed(jaccard.Keys(sig, node, hot, centre)))
            assert np.array_equal(back.sig, sig) and np.array_equal(back.node, node) and np.array_equal(back.hot, hot)
            assert back.centre is None if centre is None else np.array_equal(back.centre, centre)


def test_star_over_blobs(monkeypatch):
    """Keys keep their members and their centre however they are cut in blobs, and however little is held."""
    rnd = random.Random(3)
    rows = sorted({(rnd.randrange(12), rnd.randrange(1, 40)) for _ in range(120)})
    want = {}
    for s, n in rows:
        want.setdefault(s, []).append(n)
    for step, held in ((1, 1), (2, 3), (5, 1 << 20), (200, 1)):
        monkeypatch.setattr(jaccard, "BUCKET_ROWS", held)

        def batches(step=step):
            shuffled = rnd.sample(rows, len(rows))
            for low, high in ((0, 6), (6, 12)):
                mine = [r for r in shuffled if low <= r[0] < high]
                for a in range(0, len(mine), step):
                    sig, node = np.array(sorted(mine[a : a + step]), np.uint64).T
                    blob = jaccard.packed(jaccard.Keys(sig, node, np.zeros(len(sig), bool)))
                    yield pa.record_batch([pa.array([low]), pa.array([blob], pa.binary())], names=["bucket", "keys"])

        got = {r for b in jaccard._star_task(batches()) for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)}
        for s, ns in want.items():
            mine = [(n, c) for t, n, c in got if t == s]
            assert {n for n, _ in mine} == (set(ns) if len(ns) > 1 else set())
            if len(ns) > 1:  # all hang together with the least
                reached = {min(ns)}
                for _ in ns:
                    reached |= {n for n, c in mine if c in reached} | {c for n, c in mine if n in reached}
                assert reached == set(ns)


def test_repeated_and_missing_ids(spark):
    """Near copies link whatever else stands under their ids, and rows without an id link too."""
    import corpus_pipeline as cp

    rnd = random.Random(4)
    text = lambda: [f"x{rnd.randrange(10**6)}" for _ in range(150)]
    rows, near = [], {}
    for i in range(0, 40, 2):
        words = text()
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words[:-1], "other"])), (i, " ".join(text())), (i + 1, " ".join(text()))]
        near[i + 1] = i
    bridge = text()
    # two rows that link only over one without an id
    middle = [*text()[:4], *bridge[4:]]
    rows += [(100, " ".join(bridge)), (None, " ".join(middle)), (101, " ".join([*middle[:-4], *text()[:4]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df, 3, 90).collect()]
    assert len(got) == len(rows)
    for odd, even in near.items():
        assert sorted(c for i, c in got if i == odd) == [even, odd]
    assert {c for i, c in got if i is None or i >= 100} == {100}
    docs = df.selectExpr("doc_id", "text", "'en' lang", "'a' source", "1L n_chars")
    kept = sorted((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect())
    lost = {t for i, t in rows if t.endswith(" other")} | {t for i, t in rows if i is None or i == 101}
    assert kept == sorted((i, t) for i, t in rows if t not in lost)


def test_jaccard_edges(edge_docs, no_docs):
    rows = jaccard.jaccard_components(edge_docs, 3, 90).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1 and by[2].n_shingles == 10
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (3, 4, 5)) and by[9].n_shingles == 1
    assert jaccard.jaccard_components(no_docs, 3, 90).count() == 0


# 3


def test_leaks(spark):
    item = "A train travels 60 km in 3 hours at a steady speed; how far will the train of Mr Jones travel in 12 hours if it keeps 60 km as before?"
    other = item.replace("60", "75").replace("12", "7").replace("3 hours", "5 hours").replace("Jones", "Brown")
    torn = item.replace("travels 60 km", "travels 75 km")
    docs = [
        (1, f"Some words first. {item} And then some more of them."), (2, f"intro\n{other}"), (3, f"intro\n{torn}"), (4, "A train travels far and no item of the kind stands in this text at all."), (5, None), (6, ""),
        (7, " ".join(f"filler{i}" for i in range(20_000)) + " " + item), (1, f"Some words first. {item} And then some more of them."),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, item), (10, "short one here now"), (11, None), (12, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 9): False, (2, 9): True, (7, 9): False}


def test_leaks_over_displacements(spark):
    """A word put in, and a value of more words, split a copy in alignments that are too small alone."""
    item = "A train travels from Boston at noon and keeps a steady speed on all of its way"
    cut = "A train travels from Boston at noon and then keeps a steady speed on all of its way"
    docs = [(1, f"Some words first. {cut}"), (2, item.replace("Boston", "New York")), (3, "A train travels from Boston, they said, and that was all of it.")]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: r.reparameterised for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: False, 2: True}


def test_leaks_of_numbers_and_short_items(spark):
    """Items that are mostly values, or of few words, are found where they stand verbatim."""
    items = [(1, "Compute 12 + 7 * 3 - 4"), (2, "Add 1 2 3 4 5 6 7 8 9 10 11 now"), (3, "Define entropy"), (4, "")]
    docs = [(i, f"Some words first. {t} And more of them.") for i, t in items[:3]] + [(9, "compute 13 + 7 * 3 - 4 and add 2 3 1 5 4 7 6 9 8 11 10 now; define it")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_leaks_without_broadcast(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    first = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == first and first
    flat = lambda t: " ".join(t.split())
    items = [(r.item_id, flat(r.text)) for r in bench.collect()]
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in flat(r.text)}
    assert exact <= {(d, i) for d, i, *_ in first}


def test_leak_edges(edge_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(edge_docs, bench).collect()} == {1, 2}
    assert decontaminate.leaks(no_docs, bench).count() == 0
    assert decontaminate.leaks(edge_docs, bench.limit(0)).count() == 0


# 4


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nWhich one is  BEST?\nI wonder"), (1, 1, "assistant", "> which one is best? i wonder\n\nThe first."), (1, 2, "user", "Unrelated."),
        (1, 3, "user", "On Monday someone wrote:\n> The first.\n> > which one is best? I wonder\nWhy?"), (1, 4, "assistant", ">nothing of the kind\nOk"), (1, 5, "user", None), (1, 6, "user", ""),
        (2, 0, "user", "The first."), (2, 1, "user", ">The first.\n>The second.\nno"), (2, 2, "user", "The first."), (2, 3, "user", "> The first.\nyes"), (None, None, None, "> x"), (2, 3, "user", "> The first.\nyes"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, key string")
    got = sorted(((r.conv_id, r.turn, r.text, r.parent_turn, r.root_turn, r.depth) for r in chat.conversations(df).collect()), key=str)
    assert (1, 1, "The first.", 0, 0, 1) in got and (1, 3, "Why?", 1, 0, 2) in got and (1, 4, "Ok", None, 4, 0) in got
    assert (1, 5, None, None, 5, 0) in got and (1, 6, "", None, 6, 0) in got and (2, 1, "no", 0, 0, 1) in got
    assert got.count((2, 3, "yes", 2, 2, 1)) == 2 and (None, None, "", None, None, 0) in got and len(got) == len(rows)
    assert chat.conversations(df.limit(0)).count() == 0


def test_nested_and_partial_quotes(spark):
    """A quote of a quote, of one line of a paragraph, and of more than was said."""
    rows = [
        (1, 0, "Where is the key?\nIt was on the table."), (1, 1, "> Where is the key?\nIn the drawer."), (1, 2, ">> Where is the key?\nNot there."), (1, 3, "Where is the key?"),
        (1, 4, ">> It was on the table.\nI see."), (1, 5, "> In the drawer.\n> It was on the table.\n> and so on\nNo."), (1, 6, ">>> not there.\n>> nothing\nHm."),
    ]
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.parent_turn for r in chat.conversations(df).collect()}
    # 2 and 4 quote what was said in 0: by way of 1, and directly, as nobody had quoted that line
    assert got == {0: None, 1: 0, 2: 1, 3: None, 4: 0, 5: 0, 6: 2}


def test_long_messages(spark):
    import time

    lines = "\n".join(f"{'> ' * (i % 3)}line {i}" for i in range(100_000))
    df = spark.createDataFrame([(1, 0, "u", lines), (1, 1, "u", "> line 99999\nyes")], "conv_id long, turn long, role string, text string")
    start = time.time()
    got = {r.turn: (r.parent_turn, len(r.text)) for r in chat.conversations(df).collect()}
    assert got[1] == (0, 3) and got[0][1] > 300_000 and time.time() - start < 60


def test_long_reply_chain_and_sql(spark, monkeypatch):
    import duckdb
    import pandas as pd

    from quadrille.llm.sql import CHAT_SQL

    monkeypatch.setattr(chat, "TURNS", 3)
    rnd = random.Random(6)
    rows = [(c, 0, "user", f"start of {c}") for c in range(3)]
    for c in range(3):
        for t in range(1, 40):
            to = rnd.choice([t - 1, rnd.randrange(t)])
            source = next(r for r in rows if r[0] == c and r[1] == to)[3].split("\n")[-1]
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice([f"> {source}\n\nreply {t}", f">  {source.upper()}\nreply {t}", f"reply {t} alone", f"On day {t} x wrote:\n>> deep\n> {source}\nreply {t}", f"> > {source}\n>> more\nreply {t}\nand on"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    sql = con.sql(CHAT_SQL)
    want = sorted((tuple(r) for r in sql.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in sql.columns) for r in chat.conversations(df).collect()), key=str)
    assert got == want and max(r[-1] for r in got) >= 5


def test_chat_uses_no_python(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "> a\nb")], "conv_id long, turn long, role string, text string")
    plan = chat.conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5


def test_archives(spark, tmp_path):
    pages = [
        (1, "http://a/ 1", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "tricky\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\né語" * 3), (6, "http://f", "y" * 300_000),
        (2, "http://b", "<p>x</p>"), (None, "http://n", "only"), (9, "http://g", "<p>x</p>"),
    ]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    got = [tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = i is not None and i != last[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    warc.write_archives(df, f"file://{tmp_path}/w")
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("*.gz")))
    assert raw.count(b"WARC-Type: ") == 3 * len(pages) and raw.startswith(b"WARC/1.1\r\n")
    captures = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w"))
    assert captures.count() == len(pages) and captures.filter("size(requests) <> 1 or size(responses) <> 1 or size(metadata) <> 1 or size(others) > 0").count() == 0
    assert captures.filter("responses[0].payload_bytes = 300000").first().responses[0].block == b"y" * 300_000


def test_archives_without_broadcast(spark, monkeypatch):
    from quadrille.llm import common

    pages = spark.createDataFrame([(i, "u", f"same{i % 3}") for i in range(12)] + [(4, "u", "same1")] * 3, "page_id long, url string, html string")
    want = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_IDS", -1)
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", -1)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == want and len(want) == 15


def plain_record(kind, name, block, *partners, length=None):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *[f"WARC-Concurrent-To: <{p}>" for p in partners], f"Content-Length: {len(block) if length is None else length}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_assembly_in_any_direction(spark, tmp_path, monkeypatch):
    """As crawlers write them: the response names the request, metadata the response; chains; repeated headers; many members."""
    body = b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe not text \r\n\r\n end"
    one = [
        plain_record("warcinfo", "info", b"software: x\r\n"), plain_record("request", "q1", b"GET /"), plain_record("response", "r1", body, "q1"), plain_record("metadata", "m1", b"a: 1", "r1"),
        plain_record("response", "bad", b"lost", length="many"), plain_record("response", "r2", b"HTTP/1.1 200 OK\r\n\r\n", "q2", "m2"), plain_record("request", "q2", b"GET /2"),
        plain_record("metadata", "m2", b"b: 2"), plain_record("metadata", "m3", b"b: 3", "m2"),
    ]
    two = [plain_record("response", "r4", body), plain_record("conversion", "c4", b"text", "r4"), plain_record("resource", "alone", b""), plain_record("request", "cut", b"GET", length=99)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (tmp_path / "b.warc").write_bytes(b"".join(two))
    records = warc.read_records(spark, f"file://{tmp_path}").cache()
    for small in (jaccard.EDGES_A_TASK, -1):
        monkeypatch.setattr(jaccard, "EDGES_A_TASK", small)
        rows = warc.assemble(records).collect()
        got = {tuple(tuple(r.record_id.strip("<>") for r in c[k]) for k in ("requests", "responses", "metadata", "others")) for c in rows}
        assert got == {(("q1",), ("r1",), ("m1",), ()), (("q2",), ("r2",), ("m2", "m3"), ()), ((), ("r4",), (), ("c4",)), ((), ("alone",), (), ())}
        assert len(rows) == 4 and [c.responses[0].block for c in rows if c.requests and c.requests[0].record_id == "<q1>"] == [b"\xff\xfe not text \r\n\r\n end"]
    records.unpersist()


# all


def test_queries_match_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        rel = con.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        assert sorted((tuple(r) for r in rel.fetchall()), key=str) == sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=str), name


def test_pipeline(spark):
    import corpus_pipeline as cp
    from quadrille.llm.bpe import Codec

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = plain_components(list(texts.items()), 5, 80)
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {i for i in texts if groups[i][1] == i and not any(b in " ".join(texts[i].split()) for b in bench)}
    assert set(rows) == kept
    codec = Codec(*queries.tokenizer())
    for i in sorted(rows)[:40]:
        text = "".join(codec.decode(rows[i].ids))
        assert rows[i].n_tokens == len(rows[i].ids) and ("@mail" not in text or "@mail" not in texts[i])


def test_pipeline_stages_keep_columns(spark, edge_docs):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert {"doc_id", "ids", "n_tokens"} <= set(cp.STAGES[-1][1](spark, docs, sf).columns)
    assert cp.near_duplicates(spark, docs, sf).filter("doc_id = 1").count() == 1


def test_blocks_hold_whole_rows():
    texts = ["a" * 10, None, "", "b" * 100, "c"]
    blocks = list(text_blocks(pa.array(texts, pa.string()), 16))
    assert sum(map(len, blocks)) == 5 and [b.first for b in blocks][0] == 0
    assert b"".join(b.buf.tobytes() for b in blocks) == b"a" * 10 + b"b" * 100 + b"c"
