"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

The merges of a rank file are compiled on demand into a deterministic transducer over
bytes, with the last emitted token in a register. Every prefix of the input has one BPE encoding, and
adjacent tokens of an encoding are pairs that re-encode to themselves, so the last token at
each position follows from the tokens that end there and the last tokens before them. A state holds
the positions of the pending bytes where a longer token might still start, each with the
encoding up to it; tokens on which all of these agree are emitted. Only a token that starts
at the first pending byte looks at the register, so an arc has two forms. No token is longer than the longest of the vocabulary, which bounds the
lookahead. States and arcs are made when first met and dropped together when there are
too many; that changes speed only.

Defined results: null counts as empty text, which has no tokens; nothing is treated as a
special token; equal rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import frugal, kept, ship

MAX_STATES = 300_000
MAX_PIECES = 300_000
MAX_PAIRS = 300_000
#: Places for marks of pieces met once; two pieces that share one are only remembered sooner.
MET = 1 << 22


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Transducer:
    """bytes of one piece -> token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.packed = {r: r.to_bytes(4, "little") for r in ranks.values()}
        # a trie of the vocabulary: node * 256 + byte -> node, and the token that ends at a node
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                to = self.trie.get(node << 8 | byte)
                if to is None:
                    to = self.trie[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = rank
        self._single: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self._ids: dict[bytes, int] = {}
        self._states: list[bytes] = []
        self._heads: list[int] = []
        self._sizes = array("I")
        self._ends: list[bytes] = []
        self._arcs: dict[int, list] = {}
        self._state(((0, 0, ()),), 0)

    def merge(self, text: bytes) -> list[int]:
        """The defining procedure, for short strings: merge the lowest rank, leftmost first."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _reached(self, token: int) -> bool:
        known = self._single.get(token)
        if known is None:
            known = self._single[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _adjacent(self, a: int, b: int) -> bool:
        known = self._pairs.get(a << 32 | b)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            known = self._pairs[a << 32 | b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _state(self, live: tuple, size: int) -> int:
        """live: the positions of the pending bytes where a token may start, each with its node of
        the trie and the encoding up to it as (end, token) pairs; size: how many bytes are pending.
        States are many and opened when an arc is made only, so they are kept as packed numbers."""
        flat = array("I")
        for start, node, chain in live:
            flat.extend((start, node, len(chain)))
            for link in chain:
                flat.extend(link)
        key = flat.tobytes()
        known = self._ids.get(key)
        if known is None:
            known = self._ids[key] = len(self._states)
            self._states.append(key)
            self._heads.append(live[0][1] if live[0][0] == 0 else -1)
            self._sizes.append(size)
            # the last live position is the end of what is pending
            self._ends.append(b"".join([self.packed[t] for _, t in live[-1][2]]))
        return known

    def _opened(self, state: int) -> tuple[list[tuple], int]:
        """(live, size) of a state."""
        flat = array("I", self._states[state])
        live, at = [], 0
        while at < len(flat):
            start, node, links = flat[at : at + 3]
            at += 3
            live.append((start, node, tuple([(flat[k], flat[k + 1]) for k in range(at, at + 2 * links, 2)])))
            at += 2 * links
        return live, self._sizes[state]

    def _entry(self, state: int, byte: int) -> list:
        """[the token from the first pending byte to this one or -1, arc if it may follow the last
        emitted token, arc otherwise]; arcs are made when first taken."""
        node = self._heads[state]  # of a token from the first pending byte, -1 if none goes on
        to = self.trie.get(node << 8 | byte) if node >= 0 else None
        token = self.token_at[to] if to is not None else -1
        entry = self._arcs[state << 8 | byte] = [token if token >= 0 and self._reached(token) else -1, None, None]
        return entry

    def _arc(self, state: int, byte: int, first: int) -> tuple[int, bytes, int]:
        """(next state, ids to emit, last of them or -1); first: the token of the entry, -1 if it may not end here."""
        live, size = self._opened(state)
        n = size + 1
        still = []
        ending = None
        for start, node, chain in live:
            node = self.trie.get(node << 8 | byte)
            if node is None:
                continue
            if ending is None:
                if start == 0:
                    ending = ((n, first),) if first >= 0 else None
                else:
                    token = self.token_at[node]
                    if token >= 0 and self._reached(token) and self._adjacent(chain[-1][1], token):
                        ending = (*chain, (n, token))
            still.append((start, node, chain))
        still.append((n, 0, ending))
        if not still[0][0]:
            return self._state(tuple(still), n), b"", -1
        head = still[0][2]
        settled = len(head)
        for _, _, chain in still:
            k = 0
            while k < settled and k < len(chain) and chain[k] == head[k]:
                k += 1
            settled = k
        if not settled:
            return self._state(tuple(still), n), b"", -1
        cut, last = head[settled - 1]
        out = b"".join([self.packed[t] for _, t in head[:settled]])
        rest = tuple([(q - cut, node, tuple([(e - cut, t) for e, t in c[settled:]])) for q, node, c in still])
        return self._state(rest, n - cut), out, last

    def encode(self, piece: bytes) -> bytes:
        """The ids as little-endian 32-bit integers. A piece that is a token stays whole."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        if len(self._states) > self.max_states:
            self._clear()
        state, last, out, arcs = 0, -1, b"", self._arcs.get
        for byte in piece:
            entry = arcs(state << 8 | byte) or self._entry(state, byte)
            first = entry[0]
            if first >= 0 and (last < 0 or self._adjacent(last, first)):
                arc = entry[1]
                if arc is None:
                    arc = entry[1] = self._arc(state, byte, first)
            else:
                arc = entry[2]
                if arc is None:
                    arc = entry[2] = self._arc(state, byte, -1)
            state, said, emitted = arc
            if emitted >= 0:
                out += said
                last = emitted
        return out + self._ends[state]


class Pieces(dict):
    """Encoded pieces by text, from the second time that they are met (most are met once), in two generations:
    when the young one is full it becomes the old."""

    def __init__(self, transducer: Transducer, most: int = MAX_PIECES):
        super().__init__()
        self.transducer, self.most, self.old, self.met = transducer, most, {}, bytearray(MET)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
            at = hash(piece) % MET
            if not self.met[at]:
                self.met[at] = 1
                return ids
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
                self.met = bytearray(MET)
            self[piece] = ids
        return ids


class Utf8Machine:
    """Incremental UTF-8: state is the bytes of an unfinished character, three at most."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 + (lead >= 0xE0) + (lead >= 0xF0)
                if lead < 0xF8 and need > back:
                    cut = len(data) - back
                break
            if lead < 0x80:
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Encoder and streaming decoder of one rank file and splitting pattern."""

    def __init__(self, ranks: str | dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        """ranks: a table, or the path of its file. The bounds are of memory; they change speed only."""
        self.transducer = Transducer(load_ranks(ranks) if isinstance(ranks, str) else ranks, max_states)
        self.pieces = Pieces(self.transducer, max_pieces)
        self.split = regex.compile(pattern).findall

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""

    def decode_bytes(self, ids: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
        get = self.transducer.bytes_of.__getitem__
        for a in range(0, len(ids), 4 * chunk):
            yield b"".join(map(get, np.frombuffer(ids[a : a + 4 * chunk], "<u4").tolist()))

    def decode(self, ids: Iterable[int] | bytes) -> Iterator[str]:
        """Text as soon as its characters are complete."""
        ids = ids if isinstance(ids, bytes) else np.asarray(list(ids), "<u4").tobytes()
        machine = Utf8Machine()
        for part in self.decode_bytes(ids):
            yield machine.feed(part)
        yield machine.close()


def shared_codec(spark: SparkSession, path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> Callable[[], Codec]:
    """What gives a task its codec: ranks are read by the driver and broadcast; states and pieces live in a worker until
    it has a task of another operator."""
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(path))

    def make() -> Codec:
        gc.set_threshold(200_000, 50, 100)  # states and pieces hold no cycles, so full collections are made rare
        return kept(("codec", path, pattern, max_states, max_pieces), lambda: Codec(ranks.value, pattern, max_states, max_pieces))

    return make


def _texts(column: pa.Array) -> Iterator[str | None]:
    for a in range(0, len(column), 256):
        yield from column.slice(a, 256).to_pylist()


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES
) -> DataFrame:
    """(id, ids array<int>) of each row."""
    make = shared_codec(docs.sparkSession, path, pattern, max_states, max_pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = make()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [np.frombuffer(use.encode(t), "<i4") for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(frugal(run, keeps=True), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of token ids; null ids give empty text."""
    make = shared_codec(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = make()
        for batch in batches:
            texts = ["".join(use.decode(ids or [])) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(frugal(run, keeps=True), f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each text, decode the ids, and return counts and digests of both."""
    make = shared_codec(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = make()
        for batch in batches:
            count, a, b = [], [], []
            for text in _texts(batch.column(1)):
                ids = use.encode(text)
                machine, said = Utf8Machine(), hashlib.sha256()
                for part in use.decode_bytes(ids):
                    said.update(machine.feed(part).encode())
                said.update(machine.close().encode())
                count.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(said.hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        frugal(run, keeps=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
