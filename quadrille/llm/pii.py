"""Personal data: exact base patterns, and a skip-chain conditional random field over them.

Base spans are regular matches with a check each. The field labels the words that hold a digit
or an `@`: neighbours share chain potentials, and words that repeat or resemble an earlier one
share skip potentials, however far apart, so a document's mentions of one thing agree. Weights are
learned by pseudo-likelihood, the base spans being the labels, with features dropped at random
so that neighbours and repeats carry what a shape alone does not show; marginals come from
loopy message passing over all documents of a block at once. Repeats are linked in order of
place, so edges grow with words, not with pairs. Words that the field is sure of and no base span
covers become added spans of the same kinds.

Training takes at most `max_docs` documents with a candidate word, chosen by a hash of the id.

Defined results: null counts as empty text; texts without a digit or `@` have no span; repeated
rows get equal spans; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, sample_ids, ship

KINDS = ["email", "ip", "card", "phone"]
SURE = 0.95
ROUNDS = 8
#: Characters of the texts whose graphs are worked on together; a longer text is worked on alone.
TOGETHER = 1 << 21

# The base patterns. Repeats are possessive where that cannot change a match.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# words with a digit or @; tried at the start of each word only, without going back
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_EDGE = "\"'()[]{}<>,;:!?*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in code points; leftmost and non-overlapping within a kind."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    end = 0
    for m in _AT.finditer(text):
        a = m.start()
        while a > end and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < m.start():
            out[0].append((a, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = digits_of(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(digits_of(m.group())) <= 15:
                out[3].append(m.span())
    return out


def features(word: str, before: bool, after: bool) -> list[int]:
    """Indices of the features of a word; before and after: whether neighbours are candidates too."""
    core = word.strip(_EDGE).rstrip(".")
    d = digits_of(core)
    n = len(d)
    rest = len(core) - n
    dots = core.count(".")
    quads = core.split(".")
    is_quad = dots == 3 and all(q and digits_of(q) == q for q in quads)
    f = [0]
    f.append(1 + (n > 0) + (n > 1) + (n > 3) + (n > 7) + (n > 11) + (n > 15) + (n > 19))
    f.append(9 + min(dots, 4))
    f += [14] * ("@" in core) + [15] * core.startswith("+") + [16] * word.startswith("(") + [17] * ("-" in core)
    f += [18] * (rest == 0) + [19] * any(c.isalpha() for c in core) + [20] * is_quad
    f += [21] * (is_quad and all(len(q) <= 3 and int(q) <= 255 for q in quads))
    f += [22] * (16 <= n <= 19 and luhn(d)) + [23] * ("@" in core and "." in core.rpartition("@")[2])
    f += [24] * before + [25] * after + [26] * (len(core) > 24)
    return f


N_FEATURES = 27


@dataclass
class Graph:
    """The candidate words of several texts and what they share."""

    text: list[int]
    spans: list[tuple[int, int]]
    feats: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph(texts: list[str | None]) -> Graph:
    owner, spans, feats, chain, skip = [], [], [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        found = [m.span() for m in _CANDIDATE.finditer(text)]
        if not found:
            continue
        base = len(spans)
        near = [b - 1 <= k + 3 and not text[k:b].strip(" ") for (_, k), (b, _) in zip(found, found[1:], strict=False)]
        last: dict[tuple, int] = {}
        for j, (a, b) in enumerate(found):
            word = text[a:b]
            feats.append(features(word, j > 0 and near[j - 1], j < len(near) and near[j]))
            owner.append(i)
            spans.append((a, b))
            if j and near[j - 1]:
                chain.append((base + j - 1, base + j))
            core = word.strip(_EDGE).rstrip(".").lower()
            d = digits_of(core)
            keys = [("same", core)]
            if len(d) >= 7:
                keys += [("digits", d), ("like", d[:6], len(d) // 2)]
            elif "@" in core:
                keys.append(("local", core.partition("@")[0]))
            to = {last[k] for k in keys if k in last}
            skip += [(t, base + j) for t in to]
            for k in keys:
                last[k] = base + j
    x = np.zeros((len(spans), N_FEATURES), bool)
    for i, f in enumerate(feats):
        x[i, f] = True
    edges = lambda e: np.array(e, np.int64).reshape(-1, 2)
    return Graph(owner, spans, x, edges(chain), edges(skip))


def labels_of(g: Graph, base: list[list[list[tuple[int, int]]]]) -> np.ndarray:
    """0, or 1 + the kind of the base span that covers most of each word."""
    y = np.zeros(len(g.spans), np.int64)
    ends = [[[e for _, e in spans] for spans in kinds] for kinds in base]
    for k, (i, (a, b)) in enumerate(zip(g.text, g.spans, strict=True)):
        best = 0
        for kind, spans in enumerate(base[i]):
            for at in range(bisect_right(ends[i][kind], a), len(spans)):
                s, e = spans[at]
                if s >= b:
                    break
                cover = min(b, e) - max(a, s)
                if cover > best:
                    best, y[k] = cover, kind + 1
    return y


@dataclass
class Field:
    unary: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels), earlier by later
    skip: np.ndarray  # (labels, labels), symmetric

    def unaries(self, g: Graph) -> np.ndarray:
        parts = [g.feats[a : a + (1 << 16)].astype(float) @ self.unary for a in range(0, len(g.feats), 1 << 16)]
        return np.concatenate([np.zeros((0, self.unary.shape[1])), *parts])

    def marginals(self, g: Graph) -> np.ndarray:
        k = self.unary.shape[1]
        own = self.unaries(g)
        n_chain = len(g.chain)
        ends = np.concatenate((g.chain, g.skip))
        if not len(ends):
            return _softmax(own)
        a, b = ends[:, 0], ends[:, 1]
        source, target = np.concatenate((a, b)), np.concatenate((b, a))
        back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
        # messages of the chain and of the skip edges, onwards and back
        cuts = np.cumsum([0, n_chain, len(g.skip), n_chain, len(g.skip)])
        weights = [np.exp(w) for w in (self.chain, self.skip, self.chain.T, self.skip.T)]
        message = np.zeros((len(source), k))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            for lo, hi, w in zip(cuts, cuts[1:], weights, strict=False):
                out[lo:hi] = out[lo:hi] @ w
            new = np.log(out)
            new -= new.max(axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        belief = own.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return p / p.sum(axis=1, keepdims=True) if len(z) else p


def fit(texts: list[str], steps: int = 400, rate: float = 0.3, drop: float = 0.15, seed: int = 3) -> Field:
    """Weights by pseudo-likelihood: each label given its features and its neighbours' labels."""
    k = len(KINDS) + 1
    rng = np.random.default_rng(seed)
    g = graph(texts)
    y = labels_of(g, [base_spans(t) for t in texts])
    field = Field(np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k)))
    n = len(y)
    if not n:
        return field
    seen = [np.full(w.shape, 1e-6) for w in (field.unary, field.chain, field.skip)]
    for _ in range(steps):
        x = g.feats * (rng.random(g.feats.shape) >= drop)
        z = x @ field.unary
        (ca, cb), (sa, sb) = g.chain.T, g.skip.T
        np.add.at(z, cb, field.chain[y[ca]])
        np.add.at(z, ca, field.chain[:, y[cb]].T)
        np.add.at(z, sb, field.skip[y[sa]])
        np.add.at(z, sa, field.skip[y[sb]])
        err = _softmax(z)
        err[np.arange(n), y] -= 1
        grads = [x.T @ err, np.zeros((k, k)), np.zeros((k, k))]
        np.add.at(grads[1], y[ca], err[cb])
        np.add.at(grads[1].T, y[cb], err[ca])
        np.add.at(grads[2], y[sa], err[sb])
        np.add.at(grads[2], y[sb], err[sa])
        grads[2] = (grads[2] + grads[2].T) / 2
        for w, s, d in zip((field.unary, field.chain, field.skip), seen, grads, strict=True):
            d = d / n + 1e-4 * w
            s += d**2
            w -= rate * d / np.sqrt(s)
    return field


def find(texts: list[str | None], field: Field | None) -> list[tuple[list, list]]:
    """(base spans of each kind, added (kind, start, end)) of each text."""
    base = [base_spans(t) if t else [[], [], [], []] for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = [[[e for _, e in spans] for spans in kinds] for kinds in base]

    def met(i: int, a: int, b: int) -> bool:
        for kind, spans in enumerate(base[i]):
            at = bisect_right(ends[i][kind], a)
            if at < len(spans) and spans[at][0] < b:
                return True
        return False

    if field is not None:
        g = graph(texts)
        p = field.marginals(g)
        for j in np.flatnonzero(p[:, 1:].max(axis=1) >= SURE) if len(p) else ():
            i, (a, b) = g.text[j], g.spans[j]
            kind = int(p[j, 1:].argmax())
            word = texts[i][a:b]
            a += len(word) - len(word.lstrip(_EDGE))
            b -= len(word) - len(word.rstrip(_EDGE + "."))
            if a < b and not met(i, a, b):
                mine = added[i]
                if mine and mine[-1][0] == kind and texts[i][mine[-1][2] : a].strip(" ") == "":
                    mine[-1] = (kind, mine[-1][1], b)
                else:
                    mine.append((kind, a, b))
    return list(zip(base, added, strict=True))


def together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most TOGETHER characters, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (size + n > TOGETHER or i - start >= 256):
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind; overlapping spans are replaced together."""
    if not spans:
        return text
    out, end = [], 0
    whole: list[list[int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if whole and a < whole[-1][2]:
            whole[-1][2] = max(whole[-1][2], b)
        else:
            whole.append([k, a, b])
    for k, a, b in whole:
        out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = b
    return "".join(out) + text[end:]


def train(docs: DataFrame, max_docs: int = 1500) -> Field:
    """From docs(doc_id, text), which need no labels."""
    rows = docs.filter(F.col("text").rlike("[0-9@]"))
    ids = sample_ids(rows.select("doc_id").withColumn("_all", F.lit(0)), "doc_id", ["_all"], max_docs).select("doc_id").distinct()
    got = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text").collect()
    return fit([r.text for r in sorted(got, key=lambda r: (r.doc_id, r.text))])


def detect(docs: DataFrame, field: Field | None) -> DataFrame:
    """Each row of docs with base counts and digest, all spans, and the redacted text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for whole in batches:
            everything = whole.column(1).to_pylist()
            for start, stop in together(everything):
                batch, texts = whole.slice(start, stop - start), everything[start:stop]
                counts, digests, spans, clean = [], [], [], []
                for text, (base, added) in zip(texts, find(texts, use), strict=True):
                    own = [(k, a, b) for k, s in enumerate(base) for a, b in s]
                    counts.append([len(s) for s in base])
                    digests.append(hashlib.sha256(said(own).encode()).hexdigest())
                    spans.append(said(own + added))
                    clean.append(redacted(text, own + added))
                yield pa.record_batch(
                    [batch.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]]
                    + [pa.array(x, pa.string()) for x in (digests, spans, clean)],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        frugal(run), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    )


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """docs with redacted text; other columns pass through each task unread."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for whole in batches:
            everything = whole.column(at).to_pylist()
            for start, stop in together(everything):
                batch, texts = whole.slice(start, stop - start), everything[start:stop]
                clean = [
                    redacted(t, [(k, s, e) for k, spans in enumerate(base) for s, e in spans] + added)
                    for t, (base, added) in zip(texts, find(texts, use), strict=True)
                ]
                columns = [pa.array(clean, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
                yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(frugal(run), docs.schema)
