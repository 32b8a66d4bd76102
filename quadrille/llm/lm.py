"""Language-model scoring with a weighted backoff automaton.

Counts of all n-grams up to `order` of the training corpus, each text followed by one end token, are the
automaton: a history that was seen is a state, an n-gram an arc to the state of its last words. With c(h) and c(hw) the counts
of a history and of the same with a word, the arc weighs (c(hw) + mu p) / (c(h) + mu), and the failure arc to the history without
its first word mu / (c(h) + mu), p being the word's probability there; so each state's
probabilities sum to one. The start state (no history) gives (c(w) + 1) / (N + V + 1). One pass from left to right carries the
state and adds log10 weights; it is vectorised over a batch, since a state depends on the last order - 1 words only.

Nothing is cut off, and no table is held whole anywhere. n-grams are hashed to 56 bits, of which ranges are
buckets; a task counts in sorted runs and sends for each bucket one packed blob (key differences and counts byte
by byte). Documents are stored in batches of about BATCH bytes; a batch asks each bucket for the counts of its distinct n-grams,
the bucket's task merges what was counted and answers in the same order, and the answers meet their batch
again: the slice of the automaton that this batch can reach. Blobs are one row a bucket and run, so no n-gram is hot.
Buckets are worked on in SLICES parts, one after another, so that the disk holds one part's exchange at a time.
Counts are a DataFrame that can be stored; the union of two (of equal order and buckets) counts both corpora. Where
the training texts are among those to score, score_within() lets what a batch asks also bring what it counts.

Defined results: null, empty and blank texts are the end token alone; words never seen have the
start state's weight for count zero; with an empty training set all words are such; repeated
rows get equal scores; a null id stays null; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, Block, bucket_of, frugal, mix, planes, release, ship, small_batches, stored, text_blocks, unplanes, window_hashes, word_hashes, words

#: Pseudo-count of the shorter history in each state.
MU = 4.0
#: Bytes of text in a batch.
BATCH = 2 << 20
#: n-grams counted in a task before they are sent, and bytes of training text for which there is a bucket.
HELD = 1 << 21
BUCKET_BYTES = 1 << 21
KEY_BITS = 56
#: Parts of the buckets that are exchanged one after another.
SLICES = 2
#: The end token's key; words' hashes are 64-bit values other than this with near certainty.
END = np.uint64(0x0E0D0E0D0E0D0E0D)
ROW = "bucket long, kind int, batch long, data binary"


def sequence(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of the tokens of a block: the words of each text, then its end token."""
    s, e, row = words(block)
    h = word_hashes(LOWER[block.buf], s, e)
    per_row = np.bincount(row, minlength=len(block))
    rows = np.repeat(np.arange(len(block)), per_row + 1)
    key = np.full(len(rows), END)
    key[np.arange(len(h)) + row] = h
    return key, rows


def grams(key: np.ndarray, rows: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length n, (last tokens, keys) of the n-grams within rows; the lowest two bits of a key are n - 1."""
    out = []
    for n in range(1, order + 1):
        at = np.flatnonzero(rows[n - 1 :] == rows[: len(rows) - n + 1]) + n - 1
        h = mix(window_hashes(key, n)[at - n + 1] + U(n))
        out.append((at, h >> U(66 - KEY_BITS) << U(2) | U(n - 1)))
    return out


def packed(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted keys, and their counts."""
    return np.array([len(keys)], np.int64).tobytes() + planes(np.diff(keys, prepend=U(0))) + (b"" if counts is None else planes(counts))


def unpacked(data: memoryview) -> tuple[np.ndarray, np.ndarray | None]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    steps, at = unplanes(data, 8, n)
    return np.cumsum(steps, dtype=np.uint64), unplanes(data, at, n)[0] if at < len(data) else None


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    of = bucket_of(keys, KEY_BITS, buckets)
    cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(of[a]), slice(a, b)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 256):
        bucket, kind, batch, data = zip(*rows[a : a + 256], strict=True)
        yield pa.record_batch([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(batch, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "kind", "batch", "data"])


def _count_task(order: int, buckets: int):
    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        yield from _rows([(k, 0, 0, packed(keys[part], counts[part])) for k, part in by_bucket(keys, buckets)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                held += [k for _, k in grams(*sequence(block), order)]
                size += sum(map(len, held[-order:]))
                if size > HELD:
                    yield from sent(held)
                    held, size = [], 0
        if size:
            yield from sent(held)

    return run


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for block in text_blocks(batch.column(1), BATCH):
            ids, trains = (batch.column(k).slice(block.first, len(block)).to_pylist() for k in (0, 2))
            lists = [pa.array([x], pa.list_(k)) for x, k in ((ids, pa.int64()), (trains, pa.bool_()), (np.diff(block.off), pa.int64()))]
            yield pa.record_batch([pa.array([number]), *lists, pa.array([block.buf.tobytes()], pa.binary())], names=["batch", "ids", "trains", "sizes", "data"])
            number += 1


def _block(sizes: pa.Scalar, data: pa.Scalar) -> Block:
    return Block(0, np.frombuffer(data.as_buffer(), np.uint8), np.concatenate(([0], np.cumsum(sizes.values.to_numpy()))))


def _inside(keys: np.ndarray, part: int, buckets: int) -> np.ndarray:
    """Which keys are in a part of the buckets."""
    of = bucket_of(keys, KEY_BITS, buckets)
    return (of >= part * buckets // SLICES) & (of < (part + 1) * buckets // SLICES)


def _request_task(order: int, buckets: int, part: int):
    """What each batch asks for, with the counts of its own training texts if it has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, trains, sizes, data in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
                key, rows = sequence(_block(sizes, data))
                trained = np.asarray(trains.values)
                every, counted = [], []
                for at, k in grams(key, rows, order):
                    inside = _inside(k, part, buckets)
                    every.append(k[inside])
                    counted.append(every[-1][trained[rows[at[inside]]]])
                keys = np.unique(np.concatenate(every))
                counts = None
                if trained.any():
                    counts = np.zeros(len(keys), np.int64)
                    known, n = np.unique(np.concatenate(counted), return_counts=True)
                    counts[np.searchsorted(keys, known)] = n
                yield from _rows([(k, 1, number, packed(keys[cut], None if counts is None else counts[cut])) for k, cut in by_bucket(keys, buckets)])

    return run


def _answer_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of buckets: the counts that each batch asked for; as batch -1, each bucket's tokens and words."""

    def answered(bucket: int, parts: list[tuple], asked: list[tuple]) -> pa.RecordBatch:
        keys, counts = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.uint64)), *parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        if len(keys):
            keys, counts = keys[first], np.add.reduceat(counts, first)
        word = ((keys & U(3)) == 0) & (counts > 0)
        rows = [(-1, bucket, None, int(counts[word].sum()), int(word.sum()))]
        for number, want in asked:
            got = np.zeros(len(want), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                got = np.where(keys[at] == want, counts[at], 0)
            rows.append((number, bucket, np.array([len(want)], np.int64).tobytes() + planes(got), None, None))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["batch", "bucket", "data", "tokens", "types"])

    now, parts, asked = None, [], []
    for batch in batches:
        for bucket, kind, number, data in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
            if bucket != now:
                if now is not None:
                    yield answered(now, parts, asked)
                now, parts, asked = bucket, [], []
            keys, counts = unpacked(memoryview(data.as_buffer()))
            if counts is not None:
                parts.append((keys, counts))
            if kind == 1:
                asked.append((number, keys))
    if now is not None:
        yield answered(now, parts, asked)


def traverse(key: np.ndarray, rows: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], tokens: int, types: int, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """(start weight, weight) of each token, as log10. found: for each length, last tokens and counts of the n-grams."""
    own = (found[0][1] + 1.0) / (tokens + 1.0 * (types + 1))
    p, ends_here = own.copy(), found[0][1]
    for at, count in found[1:]:
        history = ends_here[at - 1]  # the count of the history, which ends a token before
        p[at] = (count + mu * p[at]) / (history + mu)
        ends_here = np.zeros(len(key))
        ends_here[at] = count
    return np.log10(own), np.log10(p)


def _score_task(order: int, tokens: int, types: int, mu: float):
    def scored(ids: pa.Scalar, sizes: pa.Scalar, data: pa.Scalar, parts: list[np.ndarray]) -> pa.RecordBatch:
        block = _block(sizes, data)
        n = len(block)
        key, rows = sequence(block)
        own = grams(key, rows, order)
        _, back = np.unique(np.concatenate([k for _, k in own]), return_inverse=True)
        counts = np.concatenate([np.zeros(0), *parts])[back]
        cuts = np.cumsum([0, *(len(k) for _, k in own)])
        found = [(at, counts[a:b]) for (at, _), a, b in zip(own, cuts, cuts[1:], strict=False)]
        base, full = traverse(key, rows, found, tokens, types, mu)
        total = lambda w: np.bincount(rows, w, n)
        return pa.record_batch(
            [ids.values, pa.array(np.bincount(rows, minlength=n)), pa.array(total(found[0][1] > 0).astype(np.int64)), pa.array(np.full(n, tokens)), pa.array(total(base)), pa.array(total(full))],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for kind, ids, sizes, data in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
                if kind == 0:
                    if now:
                        yield scored(*now, parts)
                    now, parts = (ids, sizes, data), []
                else:
                    view = memoryview(data.as_buffer())
                    parts.append(unplanes(view, 8, int(np.frombuffer(view, np.int64, 1)[0]))[0])
        if now:
            yield scored(*now, parts)

    return run


@dataclass
class Counts:
    """Counted n-grams up to a length, as packed rows (bucket, kind, batch, data)."""

    rows: DataFrame | None
    order: int
    buckets: int


def _buckets(texts: DataFrame, column: str) -> int:
    size = texts.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return min(int(size) // BUCKET_BYTES + 16, 1 << 17)


def train(texts: DataFrame, order: int = 3) -> Counts:
    """Counts of a DataFrame whose first column is the text; order is at most 4. Lazy: store `rows` to score often."""
    ship(texts.sparkSession)
    column = texts.columns[0]
    buckets = _buckets(texts, column)
    return Counts(texts.select(column).mapInArrow(frugal(_count_task(order, buckets)), ROW), order, buckets)


def score(docs: DataFrame, counts: Counts, mu: float = MU) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs(doc_id, text), stored."""
    return _scored(docs.selectExpr("cast(doc_id as long) doc_id", "text", "false trains"), counts, mu)


def score_within(docs: DataFrame, trains: Column, order: int = 3, mu: float = MU) -> DataFrame:
    """The same, learning from those rows of docs for which `trains` is true."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(trains, F.lit(False)).alias("trains"))
    return _scored(rows, Counts(None, order, _buckets(docs, "text")), mu)


def _scored(rows: DataFrame, counts: Counts, mu: float) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    texts = stored(rows.mapInArrow(frugal(_pack_task), "batch long, ids array<long>, trains array<boolean>, sizes array<long>, data binary"), "texts", "zstd")
    parts = []
    for part in range(SLICES):
        parts.append(_answers(texts, counts, part))
        release(spark)
    answers = reduce(DataFrame.unionByName, parts)
    total = answers.filter("batch = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    met = texts.select("batch", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("bucket"), "ids", "sizes", "data").unionByName(
        answers.filter("batch >= 0").select("batch", F.lit(1).alias("kind"), "bucket", "data"), allowMissingColumns=True
    )
    met = met.repartition("batch").sortWithinPartitions("batch", "kind", "bucket").select("kind", "ids", "sizes", "data")
    with small_batches(spark, 256):
        kinds = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return stored(met.mapInArrow(_score_task(counts.order, int(total.n), int(total.v), mu), kinds), "scores")


def _answers(texts: DataFrame, counts: Counts, part: int) -> DataFrame:
    """(batch, bucket, data, tokens, types) of a part, stored. A function of its own, so that nothing refers to its exchange afterwards."""
    spark = texts.sparkSession
    rows = texts.select("batch", "trains", "sizes", "data").mapInArrow(frugal(_request_task(counts.order, counts.buckets, part)), ROW)
    if counts.rows is not None:
        low, high = (k * counts.buckets // SLICES for k in (part, part + 1))
        rows = rows.unionByName(counts.rows.filter((F.col("bucket") >= low) & (F.col("bucket") < high)))
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    with small_batches(spark, 256):
        return stored(dealt.mapInArrow(frugal(_answer_task), "batch long, bucket long, data binary, tokens long, types long"), "answers", "zstd")
