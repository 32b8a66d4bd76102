"""Quality rules: document statistics, and gradient-boosted trees over them.

Trees are grown level by level on quantised statistics in numpy, with second-order gains, and
flattened into node arrays; scoring walks all rows through all trees at once. Chosen
statistics are monotone: more symbols, repeats or duplicate lines never raise the score.

Training takes at most `max_rows` labelled documents, chosen by a hash of the id. Every other
count covers the whole text of every document.

Defined results: null, empty and blank texts have zero words and fail the base rules; without labelled rows
the verdict is the base rules' alone; repeated rows get equal verdicts; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Block, frugal, sample_ids, ship, text_blocks, window_hashes, word_hashes, words

# The characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCT = np.zeros(256, bool)
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words_log", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "distinct", "lines", "closers"]
#: Direction in which each statistic may move the score; 0 is free.
MONOTONE = [0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0]


def statistics(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of each row: int64 (rows, 5) and float (rows, 11)."""
    n = len(block)
    buf, off = block.buf, block.off
    s, e, row = words(block)
    h = word_hashes(buf, s, e)
    per_row = np.bincount(row, minlength=n)
    at = np.concatenate(([0], np.cumsum(per_row)))

    def total(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(mask)))
        return run[off[1:]] - run[off[:-1]]

    lead = (buf & 0xC0) != 0x80  # the first byte of a code point
    chars = total(lead & ~SPACE[buf])
    symbols, upper, digits, punct = (total(k[buf]) for k in (SYMBOLS, UPPER, DIGIT, PUNCT))
    breaks = np.flatnonzero(buf == 10)
    grams = window_hashes(h, 3)
    dup, rep, distinct, lines, closers = (np.zeros(n, np.int64) for _ in range(5))
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b == a:
            continue
        distinct[i] = len(np.unique(h[a:b]))
        p, q = off[i], off[i + 1]
        inner = breaks[np.searchsorted(breaks, p) : np.searchsorted(breaks, q)]
        start = np.concatenate(([p], inner + 1))
        end = np.concatenate((inner, [q]))
        first = np.searchsorted(s, start)
        has = (first < len(s)) & (np.append(s, q)[first] < end)
        ls, le = start[has], end[has]
        lines[i] = len(ls)
        if len(ls) > 1:
            dup[i] = len(ls) - len(np.unique(word_hashes(buf[p:q], ls - p, le - p)))
        closers[i] = np.isin(buf[le - 1], (33, 46, 63)).sum()
        if b - a >= 3:
            _, back, count = np.unique(grams[a : b - 2], return_inverse=True, return_counts=True)
            again = np.flatnonzero(count[back] > 1)
            if len(again):
                hit = np.zeros(b - a, bool)
                for k in range(3):
                    hit[again + k] = True
                rep[i] = hit.sum()
    w = np.maximum(per_row, 1)
    c = np.maximum(chars, 1)
    ln = np.maximum(lines, 1)
    features = np.stack(
        [np.log1p(per_row), chars / w, symbols / c, dup / ln, rep / w, upper / c, digits / c, punct / c, distinct / w, np.log1p(w / ln), closers / ln],
        axis=1,
    )
    return np.stack([per_row, chars, symbols, dup, rep], axis=1).astype(np.int64), features


@dataclass
class Trees:
    """Flattened trees: node i of a tree is an inner node while feature[i] >= 0."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality 1; all rows go through all trees together."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f >= 0, self.left[at] + right, at)
        return 1.0 / (1.0 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1 under the MONOTONE constraints."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(x.shape[1])], axis=1)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), base)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node(v: float) -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(0)
        value.append(v)
        return len(feature) - 1

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, w = y - p, np.maximum(p * (1 - p), 1e-6)
        root = node(0.0)
        roots.append(root)
        work = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while work:
            at, rows, lo, hi, level = work.pop()
            gs, ws = g[rows].sum(), w[rows].sum()
            own = float(np.clip(gs / (ws + l2), lo, hi))
            value[at] = rate * own
            best = (1e-3, -1, 0, 0.0, 0.0)
            if level < depth and len(rows) >= 8:
                for j, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(cut) + 1))[:-1]
                    wl = np.cumsum(np.bincount(b, w[rows], len(cut) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
                    vl = np.clip(gl / (wl + l2), lo, hi)
                    vr = np.clip((gs - gl) / (ws - wl + l2), lo, hi)
                    gain = (gl * vl - 0.5 * (wl + l2) * vl**2) + ((gs - gl) * vr - 0.5 * (ws - wl + l2) * vr**2)
                    gain -= gs * own - 0.5 * (ws + l2) * own**2
                    good = (nl >= 4) & (len(rows) - nl >= 4)
                    if MONOTONE[j]:
                        good &= MONOTONE[j] * (vr - vl) >= 0
                    gain = np.where(good, gain, -np.inf)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            _, j, k, vl, vr = best
            if j < 0:
                margin[rows] += value[at]
                continue
            feature[at], threshold[at] = j, float(cuts[j][k])
            left[at] = node(0.0)
            node(0.0)
            goes = binned[rows, j] <= k
            mid = (vl + vr) / 2
            bounds = ((lo, hi), (lo, hi)) if not MONOTONE[j] else (((mid, hi), (lo, mid)) if MONOTONE[j] < 0 else ((lo, mid), (mid, hi)))
            work.append((left[at], rows[goes], *bounds[0], level + 1))
            work.append((left[at] + 1, rows[~goes], *bounds[1], level + 1))
    inner = np.array(feature)
    values = np.where(inner >= 0, 0.0, np.array(value))
    return Trees(inner, np.array(threshold), np.array(left), values, np.array(roots), base, depth)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Trees | None:
    """From docs(doc_id, text) and labels(doc_id, quality)."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = sample_ids(known.withColumn("_all", F.lit(0)), "doc_id", ["_all"], max_rows).select("doc_id")
    picked = known.join(F.broadcast(ids), "doc_id", "left_semi")
    rows = measure(docs.filter("text is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality"), None, ["quality"])
    got = rows.select("quality", "features").collect()
    if len({r.quality for r in got}) < 2:
        return None
    x = np.array([r.features for r in got])
    y = np.array([float(r.quality == 1) for r in got])
    order = np.lexsort((*x.T[::-1], y))  # the same trees whatever order the rows came in
    return grow(x[order], y[order])


def measure(docs: DataFrame, model: Trees | None, keep: list[str] | tuple = ()) -> DataFrame:
    """doc_id, kept columns, the base counts, features and the model's probability (null without one)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            base, feats = [np.zeros((0, 5), np.int64)], [np.zeros((0, len(FEATURES)))]
            for block in text_blocks(batch.column(1)):
                b, f = statistics(block)
                base.append(b)
                feats.append(f)
            base, feats = np.concatenate(base), np.concatenate(feats)
            p = trees.score(feats) if trees is not None and len(feats) else np.zeros(len(feats))
            yield pa.record_batch(
                [batch.column(0), *[batch.column(2 + i) for i in range(len(keep))], *[pa.array(base[:, i]) for i in range(5)]]
                + [pa.array(list(feats), pa.list_(pa.float64())), pa.array(p, mask=np.full(len(p), trees is None))],
                names=["doc_id", *keep, *BASE, "features", "probability"],
            )

    kinds = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in keep)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}" + ", ".join(f"{k} long" for k in BASE)
    return docs.select("doc_id", "text", *keep).mapInArrow(frugal(run), schema + ", features array<double>, probability double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 6000) -> DataFrame:
    """doc_id, base counts, base_failed, probability and kept of each row."""
    rows = measure(docs, train(docs, labels, max_rows))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", *BASE, failed.alias("base_failed"),
        (~failed & (F.coalesce("probability", F.lit(1.0)) >= threshold)).alias("kept"), "probability",
    )
