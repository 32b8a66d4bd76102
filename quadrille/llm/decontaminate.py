"""Benchmark decontamination by template canonicalisation.

Words are reduced to templates: words with a digit, names (capitalised inside a sentence) and
units after a number become typed placeholders, the rest is lowered and freed of punctuation. Windows of W
template words are hash-joined with those of the benchmark. Matches of a document and an item at
one displacement form an alignment, and so do those at neighbouring displacements (at most the item's words
apart, one from the next), between which words were put in or left out. Its slots (what stood behind the
placeholders) must be consistent: some document value faces an item value wherever that stands. An alignment
whose windows cover at least `coverage` of the item's words is a leak, re-parameterised if slot values differ.

Windows with more placeholders than words are joined by their words instead, values and all. Items shorter than
W words are one window of their own length, joined by its words and, from MIN_WORDS words on, by its template. If the benchmark's windows are few (BROADCAST_WINDOWS),
their hashes go to every task and only hits are sent; otherwise all windows are joined.

Defined results: null and empty texts match nothing; items of fewer than MIN_WORDS words match only themselves;
repeated rows give the same single row per (doc_id, item_id); empty tables give an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U, Block, Index, checkpoint, frugal, mix, ship, text_blocks, window_hashes, word_hashes, words

W = 8
MIN_WORDS = 4
BROADCAST_WINDOWS = 2_000_000

NUMBER, NAME, UNIT = (np.uint64(0xF00D000000000000 + k) for k in (1, 2, 3))

# Words that count as units of measure.
UNITS = """mm cm m km mi ft in yd mg g kg t lb lbs oz ml l gal s sec min h hr hrs ms hz khz mhz ghz w kw v a j kj cal kcal
meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams
kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days
week weeks month months year years dollar dollars cent cents euro euros percent degree degrees""".split()

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n:"]] = True


def _unit_keys() -> np.ndarray:
    text = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    s, e, _ = words(Block(0, text, np.array([0, len(text)])))
    return np.sort(word_hashes(text, s, e))


_UNIT_KEYS = _unit_keys()


def template(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template keys, raw keys, rows) of the words of a block; a placeholder's raw key is its slot value."""
    buf = block.buf
    keep = _ALNUM[buf] | SPACE[buf]
    place = np.flatnonzero(keep)
    plain = buf[keep]
    b = Block(0, plain, np.concatenate(([0], np.cumsum(keep)))[block.off])
    s, e, row = words(b)
    if not len(s):
        z = np.zeros(0, np.uint64)
        return z, z, row
    raw = word_hashes(LOWER[plain], s, e)
    digits = np.concatenate(([0], np.cumsum((plain >= 48) & (plain <= 57))))
    number = digits[e] > digits[s]
    second = plain[np.minimum(s + 1, len(plain) - 1)]
    title = (plain[s] >= 65) & (plain[s] <= 90) & (e - s > 1) & ((second >= 97) & (second <= 122) | (second >= 128))
    breaks = np.concatenate(([0], np.cumsum(_BREAK[buf])))
    inside = np.zeros(len(s), bool)
    inside[1:] = (row[1:] == row[:-1]) & (breaks[place[s[1:]]] == breaks[place[e[:-1] - 1]])
    after = np.zeros(len(s), bool)
    after[1:] = number[:-1] & (row[1:] == row[:-1])
    key = np.where(after & np.isin(raw, _UNIT_KEYS), UNIT, raw)
    key = np.where(title & inside, NAME, key)
    return np.where(number, NUMBER, key), raw, row


def windows(key: np.ndarray, raw: np.ndarray, row: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(first words, hashes, whether exact) of the windows of n words of one row: of templates where at least half are
    words, of the words themselves elsewhere and for all windows of fewer than W words."""
    if len(key) < n:
        return []
    slots = np.concatenate(([0], np.cumsum(np.isin(key, (NUMBER, NAME, UNIT)))))
    whole = row[n - 1 :] == row[: len(row) - n + 1]
    light = (2 * (slots[n:] - slots[:-n]) <= n) & (n >= MIN_WORDS)
    at, exact = np.flatnonzero(whole & light), np.flatnonzero(whole & ~light if n == W else whole)
    return [(at, mix(window_hashes(key, n)[at] + U(n)), False), (exact, mix(window_hashes(raw, n)[exact] + U(n + (1 << 32))), True)]


def _emit(ids: pa.Array, found: list[tuple[np.ndarray, ...]], key: np.ndarray, raw: np.ndarray, extra: bool, start: np.ndarray) -> pa.RecordBatch:
    """Rows id, hash, pos, slots (and the slots' positions, words of the window and of the text, for items)."""
    at = np.concatenate([f[0] for f in found])
    h = np.concatenate([f[1] for f in found])
    n = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
    row = np.concatenate([f[3] for f in found])
    pos = np.concatenate([f[4] for f in found])
    is_slot = np.isin(key, (NUMBER, NAME, UNIT))
    before = np.concatenate(([0], np.cumsum(is_slot)))
    values = raw[is_slot].view(np.int64)
    exact = np.concatenate([np.full(len(f[0]), f[5]) for f in found])
    first, count = before[at], np.where(exact, 0, before[at + n] - before[at])  # an exact window needs no slots compared
    offsets = np.concatenate(([0], np.cumsum(count)))
    take = np.repeat(first - offsets[:-1], count) + np.arange(offsets[-1])
    slots = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[take]))
    cols = [ids.take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(pos), slots]
    names = ["id", "hash", "pos", "slots"]
    if extra:
        places = np.flatnonzero(is_slot)[take] - np.repeat(start[row], count)
        cols += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places)), pa.array(n), pa.array(np.diff(start)[row])]
        names += ["places", "length", "n_words"]
    return pa.record_batch(cols, names=names)


def _item_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in text_blocks(batch.column(1)):
            key, raw, row = template(block)
            ids = batch.column(0).slice(block.first, len(block))
            size = np.bincount(row, minlength=len(block))
            start = np.concatenate(([0], np.cumsum(size)))
            found = []
            for n in {W, *size[(size > 0) & (size < W)].tolist()}:
                for at, h, exact in windows(key, raw, row, n):
                    own = (size[row[at]] >= W) if n == W else (size[row[at]] == n)
                    at, h = at[own], h[own]
                    found.append((at, h, n, row[at], at - start[row[at]], exact))
            if not found:
                continue
            yield _emit(ids, found, key, raw, True, start)


def _doc_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lengths = shared.value
        index = Index(hashes) if hashes is not None else None
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                key, raw, row = template(block)
                size = np.bincount(row, minlength=len(block))
                start = np.concatenate(([0], np.cumsum(size)))
                found = []
                for n in lengths:
                    for at, h, exact in windows(key, raw, row, n):
                        if index is not None:
                            hit = index.find(h) >= 0
                            at, h = at[hit], h[hit]
                        found.append((at, h, n, row[at], at - start[row[at]], exact))
                if any(len(f[0]) for f in found):
                    yield _emit(batch.column(0).slice(block.first, len(block)), found, key, raw, False, start)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, coverage, reparameterised) of documents that hold a benchmark item."""
    spark = docs.sparkSession
    ship(spark)
    items = checkpoint(
        benchmark.selectExpr("cast(item_id as long) item_id", "text").distinct()
        .mapInArrow(frugal(_item_task), "id long, hash long, pos long, slots array<long>, places array<long>, length long, n_words long")
        .withColumnsRenamed({"id": "item_id", "pos": "item_pos", "slots": "item_slots"})
    )
    few = items.count() <= BROADCAST_WINDOWS
    hashes = np.asarray(items.select("hash").distinct().toArrow().column(0)).view(np.uint64) if few else None
    lengths = [r.length for r in items.select("length").distinct().collect()]
    shared = spark.sparkContext.broadcast((hashes, lengths))
    hits = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(_doc_task(shared)), "id long, hash long, pos long, slots array<long>").withColumnRenamed("id", "doc_id")
    met = checkpoint(
        hits.join(items, "hash")
        .select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "length", "n_words", "slots", "item_slots", "places")
        .distinct()
    )
    # alignments: each displacement alone, and runs of displacements at most an item's words apart
    by_shift = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    shifts = (
        met.groupBy("doc_id", "item_id", "shift").agg(F.max("n_words").alias("n"))
        .withColumn("apart", (F.col("shift") - F.lag("shift").over(by_shift) > F.col("n")).cast("int"))
        .select("doc_id", "item_id", "shift", F.coalesce(F.sum("apart").over(by_shift), F.lit(0)).alias("at"))
    )
    met = met.withColumn("joined", F.lit(False)).withColumn("at", F.col("shift")).unionByName(
        met.join(shifts, ["doc_id", "item_id", "shift"]).withColumn("joined", F.lit(True))
    )
    group = ["doc_id", "item_id", "joined", "at"]
    cover = (
        met.select(*group, "n_words", F.explode(F.sequence(F.col("item_pos"), F.col("item_pos") + F.col("length") - 1)).alias("word")).distinct()
        .groupBy(*group).agg((F.count("*") / F.max("n_words")).alias("coverage"))
    )
    faced = met.select(*group, F.explode(F.arrays_zip("item_slots", "slots", "places")).alias("z")).select(
        *group, F.col("z.item_slots").alias("a"), F.col("z.slots").alias("b"), F.col("z.places").alias("place")
    ).distinct()
    places = faced.select(*group, "a", "place").distinct().groupBy(*group, "a").agg(F.count("*").alias("all"))
    slots = (
        faced.groupBy(*group, "a", "b").agg(F.count("*").alias("n")).groupBy(*group, "a")
        .agg(F.max("n").alias("most"), F.coalesce(F.max(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
        .join(places, [*group, "a"])
        .groupBy(*group)
        .agg(F.max((F.col("most") < F.col("all")).cast("int")).alias("torn"), F.max((F.col("same") < F.col("all")).cast("int")).alias("changed"))
    )
    return (
        cover.filter(F.col("coverage") >= coverage)
        .join(slots, group, "left")
        .filter(F.coalesce("torn", F.lit(0)) == 0)
        .groupBy("doc_id", "item_id")
        .agg(F.max("coverage").alias("coverage"), (F.min(F.coalesce("changed", F.lit(0))) == 1).alias("reparameterised"))
    )
