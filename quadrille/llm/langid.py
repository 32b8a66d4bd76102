"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of its training text. A text is cut greedily into the
longest phrases that occur in that training text; the fewer phrases, normalised by the size
of the training text, the nearer the language. Automata work on UTF-8 bytes with A-Z
lowered; transitions are dense arrays over the commonest bytes, so all texts of a block are
parsed by all languages in lock step, segment by segment of SEGMENT bytes, whole texts.

Training takes at most `docs_per_lang` documents of each language, at most `bytes_per_doc` characters
of each and `bytes_per_lang` bytes together, chosen by a hash of the id; nothing else is bounded.

Defined results: null text or text without a letter is `und` with score 0; equal counts go to
the language first in order; a corpus without labelled rows gives `und` throughout; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, frugal, sample_ids, ship, text_blocks

SEGMENT = 512
ALPHABET = 64
#: Nats that a surplus phrase counts for in the score.
SHARPNESS = 0.5


def normalised(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters lowered (A-Z and the Latin-1 capitals); each run of other ASCII bytes becomes one space."""
    out = LOWER[buf]
    if len(out) > 1:
        tail = out[1:]
        tail[(buf[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 32
    other = (out < 128) & ((out < 97) | (out > 122))
    out[other] = 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(other[1:] & other[:-1])
    keep[off[:-1][off[:-1] < len(out)]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # byte -> class; class 0 occurs in no training text
    step: np.ndarray  # state * classes + class -> state, or -1; a last state without arcs follows unknown bytes
    roots: np.ndarray
    weight: np.ndarray  # bits of a phrase: log2 of the training size

    def phrases(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each language (rows) in each text (columns) of a block."""
        n = len(off) - 1
        buf, off = normalised(buf, off)
        cuts = [np.arange(a, b, SEGMENT) for a, b in zip(off[:-1], off[1:], strict=True)]
        row = np.repeat(np.arange(n), [len(c) for c in cuts])
        out = np.zeros((len(self.langs), n))
        if not len(row):
            return out
        begin = np.concatenate(cuts)
        size = np.minimum(off[row + 1] - begin, SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size, row = begin[order], size[order], row[order]
        classes = self.code.max() + 1
        code = self.code[buf]
        state = np.repeat(self.roots[:, None], len(row), axis=1)
        count = np.ones((len(self.langs), len(row)), np.int32)
        fresh = self.step[(self.roots[:, None] * classes) + np.arange(classes)]
        fresh = np.where(fresh < 0, len(self.step) // classes - 1, fresh)  # the last state goes nowhere
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        for t in range(size[0]):
            k = alive[t]
            c = code[begin[:k] + t]
            to = self.step[state[:, :k] * classes + c]
            dead = to < 0
            if t:
                count[:, :k] += dead
            state[:, :k] = np.where(dead, fresh[:, c], to)
        for i in range(len(self.langs)):
            out[i] = np.bincount(row, count[i], n)
        return out


def build(texts: dict[str, bytes]) -> Model:
    langs = sorted(texts)
    lowered = {k: normalised(np.frombuffer(texts[k], np.uint8), np.array([0, len(texts[k])]))[0] for k in langs}
    counts = sum((np.bincount(lowered[k], minlength=256) for k in langs), np.zeros(256, np.int64))
    common = [b for b in np.argsort(-counts, kind="stable")[: ALPHABET - 1] if counts[b]]
    code = np.zeros(256, np.int64)
    code[common] = np.arange(1, len(common) + 1)
    classes = len(common) + 1
    parts, roots, total = [], [], 0
    for k in langs:
        seq = code[lowered[k]]
        nxt = suffix_automaton(seq.tolist())
        dense = np.full((len(nxt), classes), -1, np.int32)
        rows = np.repeat(np.arange(len(nxt)), [len(x) for x in nxt])
        keys = np.fromiter((c for x in nxt for c in x), np.int64, len(rows))
        vals = np.fromiter((v for x in nxt for v in x.values()), np.int64, len(rows))
        dense[rows, keys] = vals + total
        dense[:, 0] = -1
        parts.append(dense.ravel())
        roots.append(total)
        total += len(nxt)
    sizes = np.array([max(len(lowered[k]), 2) for k in langs], float)
    parts.append(np.full(classes, -1, np.int32))
    return Model(langs, code, np.concatenate(parts), np.array(roots, np.int64), np.log2(sizes))


def train(labelled: DataFrame, docs_per_lang: int = 100, bytes_per_doc: int = 2000, bytes_per_lang: int = 24_000) -> Model | None:
    """From rows (doc_id, text, lang); null languages are left out.

    Of each language at most docs_per_lang documents are taken, in the order of a hash of the id, and of each a
    piece that starts at a place given by that hash, so short that all of them fit in bytes_per_lang together.
    """
    rows = labelled.filter("lang is not null and text is not null")
    ids = sample_ids(rows, "doc_id", ["lang"], docs_per_lang).select("doc_id")
    room = F.greatest(F.length("text") - bytes_per_doc, F.lit(0)) + 1
    got = (
        rows.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
        .select("lang", "doc_id", F.substring("text", (F.pmod(F.xxhash64("doc_id"), room) + 1).cast("int"), F.lit(bytes_per_doc)).alias("text"))
        .collect()
    )
    pieces: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.doc_id, r.text)):
        pieces.setdefault(r.lang, []).append(r.text.encode())
    texts: dict[str, bytes] = {}
    for lang, parts in pieces.items():
        left = bytes_per_lang
        out = []
        for i, part in enumerate(sorted(parts, key=len)):  # what short ones leave goes to the longer
            out.append(part[: max(left // (len(parts) - i) - 1, 1)])
            left -= len(out[-1]) + 1
        if b"".join(out).strip():
            texts[lang] = b"\n".join(out)
    return build(texts) if texts else None


def has_letter(text: bytes) -> bool:
    b = np.frombuffer(text, np.uint8)
    low = b | 32
    if ((low >= 97) & (low <= 122)).any():
        return True
    return bool((b >= 128).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(texts: pa.Array, model: Model | None) -> tuple[list[str], list[float], list[float | None]]:
    """(language, score, phrases per byte) of each text."""
    lang, score, rate = [], [], []
    for block in text_blocks(texts):
        count = model.phrases(block.buf, block.off) if model else None
        for i in range(len(block)):
            a, b = block.off[i], block.off[i + 1]
            if model is None or not has_letter(block.buf[a:b].tobytes()):
                lang.append("und")
                score.append(0.0)
                rate.append(None)
                continue
            cost = count[:, i] * model.weight
            best = int(np.argmin(cost))
            gap = (cost - cost[best]) / model.weight[best]
            lang.append(model.langs[best])
            score.append(float(1.0 / np.exp(-SHARPNESS * np.minimum(gap, 1400.0)).sum()))
            rate.append(float(count[best, i] / (b - a)))
    return lang, score, rate


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, phrases_per_byte) of each row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for batch in batches:
            lang, score, rate = predict(batch.column(1), use)
            yield pa.record_batch(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                names=["doc_id", "lang_pred", "score", "phrases_per_byte"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(frugal(run), f"doc_id {kind}, lang_pred string, score double, phrases_per_byte double")


def accepted(docs: DataFrame, model: Model | None, lang_col: str = "lang") -> DataFrame:
    """The rows of docs that have a language, a missing lang_col filled; other columns pass through unread."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at, to = docs.columns.index("text"), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for batch in batches:
            lang = predict(batch.column(at), use)[0]
            keep = pa.array([x != "und" for x in lang], pa.bool_())
            filled = pc.coalesce(batch.column(to), pa.array(lang, pa.string()))
            columns = [filled if i == to else batch.column(i) for i in range(batch.num_columns)]
            yield pa.record_batch(columns, names=batch.schema.names).filter(keep)

    return docs.mapInArrow(frugal(run), docs.schema)
