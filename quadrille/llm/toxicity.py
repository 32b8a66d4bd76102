"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A text is cut into segments of SEGMENT words. A segment is the bag of its words and of the
byte n-grams (3 to 6, with word marks) of those words, each hashed to a row of an embedding
table; the mean of the rows goes through a linear softmax. Embeddings and softmax are
trained together. Toxic remarks are spread through a toxic text, or stand together in one passage of it. So a text scores as the
greater of two: its segment at rank 1 + SHARE of its segments, most toxic first (the most toxic one of a short text, while
in a long one a chance likeness does not decide); and the least toxic segment of its most toxic run
of RUN segments, whatever the length of the text. In training the leading segments of a
toxic text carry its label, chosen anew each epoch, and every segment of the others carries theirs.

The softmax of a mean is linear in the rows, so scoring needs one number a row: the table
is projected once, and whole texts are scored with gathers and running sums. Misspelt words
share most n-grams with their models.

Training takes whole labelled texts, at most `per_class` of each class in the order of a hash of the id, those of them that fit in
`chars` characters together; scoring reads whole texts.

Defined results: null, empty and blank texts are scored by the bias alone, as an empty bag; without
labels of both classes every score is 0; repeated rows get equal scores; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U, Block, frugal, mix, sample_ids, ship, text_blocks, word_hashes, words

SEGMENT = 8
#: A text scores as the segment at this share from its most toxic one.
SHARE = 0.05
#: Neighbouring segments that make a passage.
RUN = 3
NGRAMS = (3, 4, 5, 6)
ROWS = 1 << 17
DIM = 12
#: Share of a bag that a training step sees.
KEEP = 0.7


def bags(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table rows, segment of each, text of each segment); segments are numbered through the block."""
    buf = LOWER[block.buf]
    punct = (buf < 128) & ((buf < 48) | ((buf > 57) & (buf < 97)) | (buf > 122))
    keep = ~punct | np.isin(buf, (32, 9, 10, 11, 12, 13))
    off = np.concatenate(([0], np.cumsum(keep)))[block.off]
    b = Block(block.first, buf[keep], off)
    s, e, row = words(b)
    per_row = np.bincount(row, minlength=len(block))
    first = np.concatenate(([0], np.cumsum(per_row)))[:-1]
    per_text = -(-per_row // SEGMENT)
    base = np.concatenate(([0], np.cumsum(per_text)))
    seg_of_word = base[row] + (np.arange(len(s)) - first[row]) // SEGMENT
    text_of_seg = np.repeat(np.arange(len(block)), per_text)
    mask = U(ROWS - 1)
    rows = [(word_hashes(b.buf, s, e) & mask).astype(np.int32)]
    segs = [seg_of_word.astype(np.int32)]
    # the words one after another, each between two marks
    size = e - s + 2
    at = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(len(s)), size)
    pos = np.arange(at[-1]) - at[word]
    marked = np.where((pos == 0) | (pos == size[word] - 1), 1, b.buf[np.clip(s[word] + pos - 1, 0, max(len(b.buf) - 1, 0))] if len(b.buf) else 0)
    marked = marked.astype(np.uint64)
    code = np.zeros(len(marked), np.uint64)
    for k in range(max(NGRAMS)):
        n = k + 1
        if len(marked) < n:
            break
        code = (code[: len(marked) - k] << U(8)) | marked[k:]
        if n in NGRAMS:
            inside = pos[: len(code)] + n <= size[word[: len(code)]]
            rows.append((mix(code[inside] + U(n << 48)) & mask).astype(np.int32))
            segs.append(seg_of_word[word[: len(code)][inside]].astype(np.int32))
    return np.concatenate(rows), np.concatenate(segs), text_of_seg


def leading(logit: np.ndarray, text: np.ndarray, n_texts: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(value of each text's segment at rank 1 + share, -inf without one; which segments lead up to it)."""
    order = np.lexsort((-logit, text))
    size = np.bincount(text, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    at = (size * share).astype(np.int64)
    value = np.full(n_texts, -np.inf)
    has = size > 0
    value[has] = logit[order[(first + at)[has]]]
    leads = np.zeros(len(logit), bool)
    leads[order] = np.arange(len(logit)) - first[text[order]] <= at[text[order]]
    return value, leads


def pooled(logit: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """The value of each text, -inf without a segment."""
    value, _ = leading(logit, text, n_texts, SHARE)
    if len(logit) >= RUN:
        least = np.lib.stride_tricks.sliding_window_view(logit, RUN).min(axis=1)
        whole = text[: len(least)] == text[RUN - 1 :]
        np.maximum.at(value, text[: len(least)][whole], least[whole])
    return value


@dataclass
class Model:
    weight: np.ndarray  # of each table row: its embedding through the softmax, as a log odds
    bias: float

    def scores(self, block: Block) -> np.ndarray:
        rows, segs, text = bags(block)
        out = np.full(len(block), self.bias)
        if len(text):
            total = np.bincount(segs, self.weight[rows], len(text))
            logit = total / np.maximum(np.bincount(segs, minlength=len(text)), 1) + self.bias
            low = pooled(logit, text, len(block))
            out = np.where(np.isfinite(low), low, out)
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Scale and shift of a ridge logistic fit of y on x, by Newton steps."""
    unit = x.std() or 1.0
    z = np.stack([x / unit, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        w += np.linalg.solve(h, z.T @ (y - p) - 0.1 * w)
    return float(w[0] / unit), float(w[1])


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 6, rate: float = 0.02, seed: int = 7) -> Model | None:
    """Embeddings (ROWS, DIM) and a two-way softmax, by adaptive gradient steps on segments."""
    if len(set(toxic.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.005, (ROWS, DIM))
    soft = rng.normal(0, 0.3, (DIM, 2))
    bias = np.zeros(2)
    rows, segs, texts_of, at = [], [], [], 0
    for block in text_blocks(pa.array(texts, pa.string()), 1 << 17):
        r, s, t = bags(block)
        order = np.argsort(s, kind="stable")
        rows.append(r[order])
        segs.append(s[order] + np.int32(at))
        texts_of.append(t + block.first)
        at += len(t)
    rows, segs, text = np.concatenate(rows), np.concatenate(segs), np.concatenate(texts_of)
    bounds = np.searchsorted(segs, np.arange(at + 1))
    count = np.maximum(np.diff(bounds), 1)
    label = toxic[text].astype(int)
    # every fifth text is kept from training, to place the cut where unseen texts part
    apart = np.arange(len(toxic)) % 5 == 4
    if min((apart & (toxic == c)).sum() for c in (0, 1)) < 5:
        apart[:] = False
    used = ~apart[text]
    seen_t, seen_s, seen_b = np.full(ROWS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    # start: one dimension holds each row's shrunken log ratio of its rate in toxic segments to
    # the overall rate, and the softmax the logistic scale for it
    df, df_toxic = np.zeros(ROWS), np.zeros(ROWS)
    for lo in range(0, at, 4096):
        hi = min(lo + 4096, at)
        a, z = bounds[lo], bounds[hi]
        pair = np.unique(rows[a:z].astype(np.int64) * 4096 + (segs[a:z] - lo))
        row, seg = pair // 4096, lo + pair % 4096
        df += np.bincount(row, used[seg], ROWS)
        df_toxic += np.bincount(row, label[seg] * used[seg], ROWS)
    share = label[used].mean()
    ratio = np.log((df_toxic + 3 * share) / (share * (df + 3)))
    table[:, 0] += ratio
    mean = np.bincount(segs, ratio[rows], at) / count
    scale, shift = _logistic(mean[used], label[used])
    soft[0] = (-scale / 2, scale / 2)
    bias[:] = (-shift / 2, shift / 2)
    logit = mean * scale + shift
    for epoch in range(epochs):
        tops = used & (label == 1) & leading(logit, text, len(toxic), 2 * SHARE)[1]
        negative = np.flatnonzero(used & (label == 0))
        most = 20 * max(int(tops.sum()), 500)
        if len(negative) > most:
            hard = negative[np.argsort(-logit[negative], kind="stable")[: most // 2]]
            negative = np.union1d(hard, rng.choice(negative, most // 2, replace=False))
        positive = np.flatnonzero(tops)
        use = np.concatenate((positive, negative))
        w_pos = len(negative) / max(len(positive), 1) / 4
        rng.shuffle(use)
        for part in np.array_split(use, max(1, len(use) // 64)):
            flat = np.concatenate([rows[bounds[i] : bounds[i + 1]] for i in part])
            own = np.repeat(np.arange(len(part)), count[part])
            kept = rng.random(len(flat)) < KEEP  # dropped rows make the others carry a misspelt word
            kept[np.concatenate(([0], np.cumsum(count[part])[:-1]))] = True
            flat, own = flat[kept], own[kept]
            size = np.bincount(own, minlength=len(part))
            mean = np.add.reduceat(table[flat], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0) / size[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = p.copy()
            err[np.arange(len(part)), label[part]] -= 1
            err *= np.where(label[part] == 1, max(1.0, w_pos), 1.0)[:, None] / len(part)
            g_soft, g_bias = mean.T @ err, err.sum(axis=0)
            g_rows = (err @ soft.T / size[:, None])[own]
            uniq, back = np.unique(flat, return_inverse=True)
            g = np.zeros((len(uniq), DIM))
            np.add.at(g, back, g_rows)
            seen_t[uniq] += (g**2).mean(axis=1)
            table[uniq] -= rate * g / np.sqrt(seen_t[uniq])[:, None]
            seen_s += g_soft**2
            seen_b += g_bias**2
            soft -= rate * g_soft / np.sqrt(seen_s)
            bias -= rate * g_bias / np.sqrt(seen_b)
        weight = table @ (soft[:, 1] - soft[:, 0])
        logit = np.bincount(segs, weight[rows], at) / count + bias[1] - bias[0]
    best = pooled(logit, text, len(toxic))
    best = np.where(np.isfinite(best), best, bias[1] - bias[0])
    # the cut becomes a log odds of log(0.3 / 0.7)
    seen, truth = (best[apart], toxic[apart]) if apart.any() else (best, toxic)
    grid = np.unique(np.concatenate(([seen.min() - 1], seen, [seen.max() + 1])))
    mids = (grid[1:] + grid[:-1]) / 2
    wrong = [(seen[truth == 1] < c).mean() + 4 * (seen[truth == 0] >= c).mean() for c in mids]  # a clean text wrongly marked counts four times
    flat = mids[np.flatnonzero(np.isclose(wrong, min(wrong)))]
    shift = np.log(0.3 / 0.7) - (flat.min() + flat.max()) / 2
    return Model(weight, float(bias[1] - bias[0] + shift))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 800, chars: int = 4_000_000) -> Model | None:
    """From docs(doc_id, text) and labels(doc_id, toxic)."""
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = sample_ids(known, "doc_id", ["toxic"], per_class)
    rows = docs.filter("text is not null").join(F.broadcast(ids), "doc_id")
    sizes = rows.groupBy("doc_id", "toxic").agg(F.sum(F.length("text")).alias("n"), F.xxhash64("doc_id").alias("place")).collect()
    left, chosen = {}, []
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        share = left.setdefault(r.toxic, chars // 2)
        if r.n <= share:
            left[r.toxic] -= r.n
            chosen.append(r.doc_id)
    got = rows.filter(F.col("doc_id").isin(chosen)).select("doc_id", "text", "toxic").collect() if chosen else []
    got.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in got], np.array([int(r.toxic == 1) for r in got])) if got else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for batch in batches:
            parts = [use.scores(b) if use is not None else np.zeros(len(b)) for b in text_blocks(batch.column(1), 1 << 18)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate([np.zeros(0), *parts]))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {kind}, score double")
