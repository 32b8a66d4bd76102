"""N-gram Jaccard join over whole texts, exact, with bounded groups.

Sets of word shingles become nodes (equal sets are one node, so copies are never
expanded). Sizes are cut into bands whose ratio is the threshold, so linked sets lie
in one band or in neighbours. Within a band sets that link differ in at most k
shingles; shingles are hashed into k + 1 + e parts, so more than e parts agree and,
unless a set leaves more than e parts empty, one of them is not empty. The content of
a part is the key of a tile. Sets with more than e empty parts also meet through pairs
of empty parts. Tiles first link each member to one centre (linear). Those that this leaves in several
components are gathered into groups: like sets share most of their tiles, and a group holds each of
them once instead of once a tile. Large groups link their members to a few further centres (linear each time); only where
that leaves a group in several components are members of different components compared, block by block: parity
bitmaps bound the overlap from above (each differing bit needs a shingle in one set only), and what survives is
decided by exact intersection of the sorted arrays. Bitmaps of all members are stored; sets, which are many times
larger, are made again from the texts of those few members that have a surviving pair.

Keys travel packed: a task sorts what it holds and sends, for each range of keys (a bucket), one blob of key
differences and positions in a list of nodes, a third of the bytes of single rows. Buckets are as many as their
expected size asks for, so that one fits in a task at any input size.

Sets are compared by 64-bit shingle hashes, and equal sets are one node by a 64-bit hash of their content.

Defined results: null, empty or blank texts have no set, link with nothing and are
their own component; texts with fewer than n words have their whole sequence as
one shingle; repeated rows share a component; rows of one id with different texts are nodes of their own, each with its
own links, and a component's id is the least id of all its rows; rows without an id link too, and a component
that has no other rows has a null id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, U, Block, bucket_of, checkpoint, compact, discard, frugal, if_small, mix, planes, release, ship, small_batches, stored, text_blocks, unplanes, window_hashes, word_hashes, words

#: Occurrences of one key within a task's block from which its rows are spread out.
LOCAL_HOT = 8
#: Rounds of further centres in groups of more than CROWD members; what they leave apart is compared, as are smaller groups.
CENTRES = 5
CROWD = 64
#: Distinct edges that one task may contract.
EDGES_A_TASK = 500_000
#: Members of a group that are compared as one block; blocks of larger groups grow with the square root.
TILE = 4096
#: Least and most 64-bit words of the folded bitmaps that travel with members. Half as wide as the whole ones, they tell large
#: sets apart too; pairs that they let pass meet the whole bitmaps before their sets are fetched.
BRIEF, WIDE = 16, 512
#: (key, node) rows held in a task before they are pre-aggregated and sent, and rows that a bucket should have.
HELD_ROWS = 1 << 20
BUCKET_ROWS = 1 << 20
#: Bits of a key that are sent.
KEY_BITS = 48


def shingle_sets(block: Block, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    buf = LOWER[block.buf]
    s, e, row = words(block)
    h = word_hashes(buf, s, e)
    per_row = np.bincount(row, minlength=len(block))
    at = np.concatenate(([0], np.cumsum(per_row)))
    grams = window_hashes(h, n)
    out = []
    for i in range(len(block)):
        a, b = at[i], at[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], int(b - a)) ^ U(int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit id of each set, by content."""
    out = np.zeros(len(sets), np.uint64)
    for i, x in enumerate(sets):
        out[i] = np.bitwise_xor.reduce(mix(x + U(0x51ED270B))) if len(x) else 0
    sizes = np.array([len(x) for x in sets], np.uint64)
    return mix(out + sizes * U(0x9E3779B97F4A7C15))


class Bands:
    """Size bands for a threshold of p percent. Tasks share one object, so that all cut sets alike."""

    def __init__(self, p: int):
        self.p, self.lo, self.hi = p, [1], [max(1, 100 // p)]
        # spare parts in percent of k: so many that few sets, even the smallest that meet in a band, leave as many empty
        per_k, low = 2 * (100 - p) / (100 + p), (p / 100) ** 2
        shares = (s for s in range(5, 100) if 1.25 * (1 + s / 100) * math.exp(-low / (per_k * (1 + s / 100))) <= s / 100)
        self.share = next(shares, 100)

    def upto(self, size: int) -> None:
        while self.hi[-1] < size * 100 // self.p + 1:
            lo = self.hi[-1] + 1
            self.lo.append(lo)
            self.hi.append(max(lo, lo * 100 // self.p))

    def parts(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of parts, spare parts e) of each band; 0 parts where no two different sets link."""
        hi = np.array(self.hi)[band]
        k = (100 - self.p) * 2 * hi // (100 + self.p)
        e = 4 + k * self.share // 100
        return np.where(k > 0, k + 1 + e, 0), e


def signatures(sets: list[np.ndarray], nodes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(keys, nodes): the tiles that each set belongs to."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if not len(sizes) or not sizes.max():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bands.upto(int(sizes.max()))
    own = np.searchsorted(np.array(bands.lo), np.maximum(sizes, 1), "right") - 1
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    inner = mix(flat ^ U(0xA5A5F00DCAFE1234))
    keys, owners = [], []
    for shift in (0, 1):
        band = own + shift
        m, spare = bands.parts(band)
        m = np.where(sizes > 0, m, 0)
        base = np.concatenate(([0], np.cumsum(m)))
        if not base[-1]:
            continue
        live = m[row] > 0
        r = row[live]
        part = ((mix(flat[live] + band[r].astype(np.uint64) * U(0xC2B2AE3D27D4EB4F)) >> U(32)) * m[r].astype(np.uint64)) >> U(32)
        where = base[r] + part.astype(np.int64)
        acc = np.zeros(base[-1], np.uint64)
        np.add.at(acc, where, inner[live])
        full = np.bincount(where, minlength=base[-1]) > 0
        owner = np.repeat(np.arange(len(sets)), m)
        number = np.arange(base[-1]) - base[owner]
        tag = band[owner].astype(np.uint64) * U(1 << 32) + number.astype(np.uint64)
        sig = mix(acc ^ mix(tag + U(77)))
        keys.append(sig[full])
        owners.append(nodes[owner[full]])
        void = np.bincount(owner[~full], minlength=len(sets))
        for i in np.flatnonzero(void > spare):
            gaps = number[base[i] : base[i + 1]][~full[base[i] : base[i + 1]]].astype(np.uint64)
            a, b = np.triu_indices(len(gaps), 1)
            pair = (gaps[a] << U(24)) + gaps[b]
            keys.append(mix(mix(pair + U(0xE0E0)) ^ (U(int(band[i])) + U(1))))
            owners.append(np.full(len(a), nodes[i]))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *keys]), np.concatenate([none, *owners])


def bitmap(shingles: np.ndarray, p: int) -> np.ndarray:
    """Parity bitmap: each shingle toggles a bit; as many bits as sixteen times the allowed difference."""
    k = (100 - p) * 2 * len(shingles) // (100 + p)
    bits = 64
    while bits < 16 * k and bits < 1 << 17:
        bits *= 2
    at = (mix(shingles ^ U(0xB17)) & U(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def fold(x: np.ndarray, width: int) -> np.ndarray:
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def links(a: np.ndarray, b: np.ndarray, p: int) -> bool:
    """Exact: 100 * intersection >= p * union."""
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * inter >= p * (len(a) + len(b) - inter)


def may_link(na: int, ba: np.ndarray, nb: int, bb: np.ndarray, p: int) -> bool:
    if 100 * min(na, nb) < p * max(na, nb):
        return False
    w = min(len(ba), len(bb))
    differ = int(np.bitwise_count(fold(ba, w) ^ fold(bb, w)).sum())
    return (100 + p) * differ <= (100 - p) * (na + nb)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets_task(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids = [], []
            for block in text_blocks(batch.column(1)):
                sets = shingle_sets(block, n)
                sizes.append(np.array([len(x) for x in sets], np.int64))
                ids.append(node_of(sets))
            if sizes:
                size, node = np.concatenate(sizes), np.concatenate(ids)
                yield pa.record_batch(
                    [batch.column(0), pa.array(size), pa.array(node.view(np.int64), mask=size == 0)],
                    names=["doc_id", "n_shingles", "node"],
                )

    return run


@dataclass
class Keys:
    """(key, node) rows; a centre is another node of the key that links for it, and hot a node that is such a centre."""

    sig: np.ndarray
    node: np.ndarray
    hot: np.ndarray
    centre: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.sig)

    def take(self, at: np.ndarray) -> Keys:
        return Keys(self.sig[at], self.node[at], self.hot[at], None if self.centre is None else self.centre[at])


def packed(rows: Keys) -> bytes:
    """Rows in the order of their keys: differences of keys and positions of nodes, byte by byte in planes of equal weight."""
    own = rows.node if rows.centre is None else np.concatenate((rows.node, rows.centre))
    nodes, place = np.unique(own, return_inverse=True)
    head = np.array([len(rows), len(nodes), rows.centre is not None], np.int64).tobytes()
    return b"".join((head, nodes.tobytes(), np.packbits(rows.hot).tobytes(), planes(np.diff(rows.sig, prepend=U(0))), planes(place)))


def unpacked(data: bytes | memoryview) -> Keys:
    n, m, given = (int(x) for x in np.frombuffer(data, np.int64, 3))
    at = 24
    nodes = np.frombuffer(data, np.uint64, m, at)
    at += 8 * m
    hot = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
    at += (n + 7) // 8

    steps, at = unplanes(data, at, n)
    sig = np.cumsum(steps, dtype=np.uint64)
    node = nodes[unplanes(data, at, 2 * n if given else n)[0].astype(np.int64)]
    return Keys(sig, node[:n], hot, node[n:] if given else None)


def _keys_task(n: int, p: int, buckets: int):
    bands = Bands(p)

    def blobs(rows: Keys, of: np.ndarray, first: int) -> Iterator[tuple[int, bytes]]:
        cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield first + int(of[a]), packed(rows.take(slice(a, b)))

    def sent(keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node = np.concatenate(keys) >> U(64 - KEY_BITS), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[keep], node[keep]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(starts, len(key)))
        group = np.repeat(np.arange(len(starts)), count)
        crowded = count[group] > LOCAL_HOT
        # of a crowd all but the first are dealt out by node and have the first as centre, which goes where the key goes
        centre = node[starts[group]]
        away = crowded & (centre != node)
        found = list(blobs(Keys(key[~away], node[~away], crowded[~away]), bucket_of(key[~away], KEY_BITS, buckets), 0)) if not away.all() else []
        if away.any():
            rows, of = Keys(key[away], node[away], crowded[away], centre[away]), bucket_of(node[away], 64, buckets)
            order = np.argsort(of, kind="stable")
            found += blobs(rows.take(order), of[order], buckets)
        for a in range(0, len(found), 256):
            part = found[a : a + 256]
            yield pa.record_batch([pa.array([k for k, _ in part], pa.int64()), pa.array([d for _, d in part], pa.binary())], names=["bucket", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        seen: set[int] = set()
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                sets = shingle_sets(block, n)
                ids = node_of(sets)
                fresh = []
                for i, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if len(seen) > 1 << 18:
                    seen.clear()
                k, v = signatures([sets[i] for i in fresh], ids[fresh], bands)
                keys.append(k)
                nodes.append(v)
                held += len(k)
                if held > HELD_ROWS:
                    yield from sent(keys, nodes)
                    keys, nodes, held = [], [], 0
        if held:
            yield from sent(keys, nodes)

    return run


def stars(rows: Keys) -> tuple[Keys, Keys]:
    """(members with their centre, of keys with several nodes or a hot one; one row a key to go on with)."""
    order = np.lexsort((~rows.hot, rows.node, rows.sig))
    rows = rows.take(order)
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows.sig[1:] != rows.sig[:-1]) | (rows.node[1:] != rows.node[:-1])
    rows = rows.take(keep)
    starts = np.flatnonzero(np.concatenate(([True], rows.sig[1:] != rows.sig[:-1])))
    count = np.diff(np.append(starts, len(rows)))
    lives = (count > 1) | np.logical_or.reduceat(rows.hot, starts)
    group = np.repeat(np.arange(len(starts)), count)
    take = lives[group]
    first = rows.take(starts)
    return Keys(rows.sig[take], rows.node[take], rows.hot[take], first.node[group[take]]), Keys(first.sig, first.node, lives)


def _star_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: members of keys with two nodes or more, each with a centre.

    What is held is cut down to a row a key whenever it grows past four buckets' worth, so that a key with
    any number of nodes is no matter; the node that stands for it may then be given twice.
    """

    def sent(rows: Keys) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows), 1 << 16):
            part = [x[a : a + (1 << 16)].view(np.int64) for x in (rows.sig, rows.node, rows.centre)]
            yield pa.record_batch([pa.array(x) for x in part], names=["sig", "node", "centre"])

    def joined(parts: list[Keys]) -> Keys:
        return Keys(*(np.concatenate([getattr(x, k) for x in parts]) for k in ("sig", "node", "hot")))

    held: list[Keys] = []
    size, last = 0, None
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = unpacked(memoryview(data.as_buffer()))
            if rows.centre is not None:
                yield from sent(rows)
                continue
            if held and (bucket != last or size > 4 * BUCKET_ROWS):
                out, rest = stars(joined(held))
                yield from sent(out)
                held = [rest] if bucket == last else []
                size = len(rest) if held else 0
                size -= min(size, 3 * BUCKET_ROWS)  # many keys are no reason to do so at each blob
            held.append(rows)
            size, last = size + len(rows), bucket
    if held:
        yield from sent(stars(joined(held))[0])


def _payload_task(n: int, p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                sets = shingle_sets(block, n)
                bits = [bitmap(x, p) for x in sets]
                yield pa.record_batch(
                    [
                        _signed(node_of(sets)),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([x.tobytes() for x in bits], pa.binary()),
                        pa.array([fold(x, min(max(BRIEF, len(x) // 2), WIDE)).tobytes() for x in bits], pa.binary()),
                    ],
                    names=["node", "size", "bits", "brief"],
                )

    return run


def _shingles_task(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                sets = shingle_sets(block, n)
                yield pa.record_batch([_signed(node_of(sets)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])

    return run


def _screen_task(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, nx, bx, ny, by = (batch.column(i) for i in range(6))
            nx, ny = np.asarray(nx), np.asarray(ny)
            view = lambda c, i: np.frombuffer(c[i].as_buffer(), np.uint64)
            mask = pa.array([may_link(nx[i], view(bx, i), ny[i], view(by, i), p) for i in range(batch.num_rows)], pa.bool_())
            yield pa.record_batch([x.filter(mask), y.filter(mask)], names=["x", "y"])

    return run


def _exact_task(p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, ax, ay = (batch.column(i) for i in range(4))
            mask = pa.array([links(np.frombuffer(ax[i].as_buffer(), np.uint64), np.frombuffer(ay[i].as_buffer(), np.uint64), p) for i in range(batch.num_rows)], pa.bool_())
            yield pa.record_batch([x.filter(mask), y.filter(mask)], names=["x", "y"])

    return run


def _tile_task(p: int, nearest: bool):
    """Sorted rows of groups: pairs (x, y) of different components, one of them from the left side, that may
    link. nearest: for each row only the other whose bitmap differs least; `more` says that there were others."""

    def pairs(side: np.ndarray, node: np.ndarray, label: np.ndarray, size: np.ndarray, bits: list[np.ndarray]):
        width = np.array([len(b) for b in bits])
        # of each width that occurs: the bitmaps as wide or wider, folded to it, and where each stands
        flat = {w: (np.stack([fold(b, w) for b in bits if len(b) >= w]), np.cumsum(width >= w) - 1) for w in np.unique(width).tolist()}
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        for i in left:
            j = right[label[right] != label[i]]
            j = j[(100 * np.minimum(size[j], size[i]) >= p * np.maximum(size[j], size[i]))]
            if len(j):
                both, differ = np.minimum(width[j], width[i]), np.zeros(len(j), np.int64)
                for w, (x, place) in flat.items():
                    at = both == w
                    if at.any():
                        differ[at] = np.bitwise_count(x[place[j[at]]] ^ x[place[i]]).sum(axis=1, dtype=np.int64)
                near = (100 + p) * differ <= (100 - p) * (size[j] + size[i])
                j, differ = j[near], differ[near]
                more = nearest and len(j) > 1
                for k in j[np.argsort(differ, kind="stable")[:1]] if more else j:
                    yield min(node[i], node[k]), max(node[i], node[k]), more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch:
            sig, tile = (np.asarray(t.column(c)) for c in ("sig", "tile"))
            cut = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (tile[1:] != tile[:-1]), [True])))
            side, node, label, size = (np.asarray(t.column(c)) for c in ("side", "node", "label", "size"))
            bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in t.column("bits")]
            out = {(x, y, sig[a] if more else None) for a, b in zip(cut[:-1], cut[1:], strict=True) for x, y, more in pairs(side[a:b], node[a:b], label[a:b], size[a:b], bits[a:b])}
            return pa.record_batch([pa.array([q[k] for q in out], pa.int64()) for k in range(3)], names=["x", "y", "more"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            sig, tile = np.asarray(t.column("sig")), np.asarray(t.column("tile"))
            last = np.flatnonzero((sig != sig[-1]) | (tile != tile[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = t.slice(cut)
            if cut:
                yield work(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield work(rest)

    return run


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) of a graph that is known to be small: the root of each node, by union-find."""
    parent: dict = {}
    kind = pa.int64()

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    if nodes:
        yield pa.record_batch([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over edges (x, y).

    At most EDGES_A_TASK distinct edges are contracted in one task. More are contracted by alternating
    stars: rounds grow with the logarithm of a component's diameter; each works on distinct edges with
    map-side aggregation and ends in a reliable checkpoint.
    """
    e = checkpoint(edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).filter("a <> b").distinct())
    if e.count() <= EDGES_A_TASK:
        kind = e.schema["a"].dataType.simpleString()
        return compact(e.coalesce(1).mapInArrow(frugal(_contract), f"node {kind}, root {kind}"))
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = checkpoint(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return compact(e.unionByName(e.select(F.col("b").alias("a"), "b")).distinct()).select(F.col("a").alias("node"), F.col("b").alias("root"))


def tiles(rows: DataFrame, payload: DataFrame, p: int, nearest: bool) -> DataFrame:
    """(x, y, more): pairs of nodes of one group but different components whose bitmaps allow a link; more is
    the group where a node had further candidates that were left out.

    Rows are (sig, node, label, main, all). Only nodes outside a group's main component are compared with the
    others: blocks of nodes meet each block of the group once, and most groups are one block.
    """
    blocks = F.ceil(F.sqrt(F.col("all") / TILE)).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    side = F.when(F.col("label") != F.col("main"), 1).otherwise(0)
    each = F.sequence(F.lit(0), blocks - 1)
    # a node stands left in its block's row of tiles and right in its column; where they cross, or alone, once
    place = F.when(blocks == 1, F.array(F.struct(F.lit(0).alias("tile"), (side + 2).alias("side")))).otherwise(
        F.concat(
            F.transform(F.when(side == 1, each).otherwise(F.array().cast("array<int>")), lambda j: F.struct((mine * blocks + j).alias("tile"), F.lit(1).alias("side"))),
            F.transform(each, lambda i: F.struct((i * blocks + mine).alias("tile"), F.lit(2).alias("side"))),
        )
    )
    return (
        rows.join(payload.select("node", "size", F.col("brief").alias("bits")), "node").withColumn("at", F.explode(place))
        .select("sig", F.col("at.tile").alias("tile"), F.col("at.side").alias("side"), "node", "label", "size", "bits")
        .repartition("sig", "tile").sortWithinPartitions("sig", "tile")
        .mapInArrow(frugal(_tile_task(p, nearest)), "x long, y long, more long")
    )


def memberships(text: DataFrame, n: int, p: int, buckets: int) -> DataFrame:
    """(sig, node, centre) of the tiles that hold two nodes or more. A function of its own, so that nothing
    refers to its large exchange afterwards."""
    keys = text.select("text").mapInArrow(frugal(_keys_task(n, p, buckets)), "bucket long, keys binary")
    dealt = keys.repartition("bucket").sortWithinPartitions("bucket")
    with small_batches(text.sparkSession, 256):
        return stored(dealt.mapInArrow(frugal(_star_task), "sig long, node long, centre long"), "members", "zstd")


def node_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node) of each row of docs(doc_id, text), stored."""
    ship(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession, 1000):
        return stored(text.mapInArrow(frugal(_sets_task(n)), "doc_id long, n_shingles long, node long"), "sets")


def with_node(docs: DataFrame, n: int) -> DataFrame:
    """docs and each row's node, null for a row without a set; other columns pass through unread."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for block in text_blocks(batch.column(at)):
                sets = shingle_sets(block, n)
                found.append(np.stack([node_of(sets).view(np.int64), [len(x) for x in sets]], axis=1))
            node = np.concatenate(found)
            yield pa.record_batch([*batch.columns, pa.array(node[:, 0], mask=node[:, 1] == 0)], names=[*batch.schema.names, "_node"])

    kept = docs.select(docs.columns)
    return kept.mapInArrow(frugal(run), StructType([*kept.schema.fields, StructField("_node", LongType())]))


def jaccard_components(docs: DataFrame, n: int = 5, p: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text).

    Documents link when 100 * intersection >= p * union of their n-word shingle sets.
    """
    sets = node_sets(docs, n)
    first = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    root = node_components(docs, sets, n, p)
    low = root.join(first, "node").groupBy("root").agg(F.min("rep").alias("low"))
    found = root.join(low, "root").select("node", "low")
    known = first.join(found, "node", "left").select("node", F.coalesce("low", "rep").alias("low"))
    return sets.join(known, "node", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def node_components(docs: DataFrame, sets: DataFrame, n: int, p: int) -> DataFrame:
    """(node, root) of the nodes that link with others; sets are the docs' node_sets()."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles"), F.count("*").alias("rows")).first()
    expected = 2 * (2 * (100 - p) / (100 + p) * (1 + Bands(p).share / 100) * total.shingles + 5 * total.rows)
    members = memberships(text, n, p, int(min(expected // BUCKET_ROWS + 16, 1 << 24)))
    release(spark)
    star = members.filter("node <> centre").select(F.least("node", "centre").alias("x"), F.greatest("node", "centre").alias("y")).distinct()
    star = compact(star)
    active = compact(
        star.select(F.col("x").alias("node")).union(star.select(F.col("y").alias("node"))).distinct()
        .join(first, "node").select(F.col("rep").alias("doc_id"), "node")
    )

    def texts(at: DataFrame) -> DataFrame:
        """Rows of the first ids of these active nodes, and those without an id; what else the rows hold is left out by its node."""
        ids = at.filter("doc_id is not null").select("doc_id").distinct()
        found = text.join(if_small(ids), "doc_id", "left_semi").select("text")
        if not at.filter("doc_id is null").isEmpty():
            found = found.unionByName(text.filter("doc_id is null").select("text"))
        return found

    with small_batches(spark):
        payload = stored(texts(active).mapInArrow(frugal(_payload_task(n, p)), "node long, size long, bits binary, brief binary"), "payload")
    repeated = payload.count() > active.count()  # ids stand in several rows
    if repeated:
        payload = stored(payload.join(if_small(active.select("node")), "node", "left_semi").dropDuplicates(["node"]), "payload")

    def ends(pairs: DataFrame) -> DataFrame:
        return if_small(pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct())

    def joined(pairs: DataFrame, body: DataFrame) -> DataFrame:
        columns = [k for k in body.columns if k != "node"]
        side = lambda c: body.select(F.col("node").alias(c), *[F.col(k).alias(k + c) for k in columns])
        both = [k + c for c in "xy" for k in columns]
        return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", *both)

    def screened(pairs: DataFrame, bits: str) -> DataFrame:
        # only what the pairs need is exchanged
        body = payload.select("node", "size", bits).join(ends(pairs), "node", "left_semi")
        return compact(joined(pairs, body).mapInArrow(frugal(_screen_task(p)), "x long, y long"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that link: folded bitmaps first, then whole ones, then the sets themselves."""
        kept = screened(pairs, "brief")
        with small_batches(spark):
            kept = screened(kept, "bits")
            if kept.isEmpty():
                return kept
            nodes = ends(kept)
            found = texts(active.join(nodes, "node", "left_semi")).mapInArrow(frugal(_shingles_task(n)), "node long, shingles binary")
            if repeated:
                found = found.join(nodes, "node", "left_semi").dropDuplicates(["node"])
            sets = stored(found, "shingles")
            out = compact(joined(kept, sets).mapInArrow(frugal(_exact_task(p)), "x long, y long"))
            discard(sets)
            return out

    def apart(near: DataFrame, held: DataFrame) -> DataFrame:
        """(sig, node, label, main, all) of those tiles or groups among `held` that still hold several components. The
        only pair of a tile of two is that of a member and its centre, which has been compared. Those that have
        the same member of least hash become one group, called by it; groups have different ones, and stay."""
        label = components(near)
        rows = held.select("sig", "node").join(if_small(label), "node", "left").select("sig", "node", F.coalesce("root", "node").alias("label"))
        ends = rows.groupBy("sig").agg(
            F.min("label").alias("main"), F.max("label").alias("other"), F.count("*").alias("all"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("home")
        )
        kept = rows.join(ends.filter("main <> other and all > 2").select("sig", "home"), "sig")
        group = stored(kept.select(F.col("home").alias("sig"), "node", "label").distinct(), "group")
        ends = group.groupBy("sig").agg(F.min("label").alias("main"), F.count("*").alias("all"))
        out = stored(group.join(if_small(ends), "sig"), "apart")
        discard(group)
        release(spark)
        return out

    tested = star
    near = linked(star)
    rows = apart(near, members)
    discard(members)
    for turn in range(CENTRES):
        # another centre for what is still apart: linear, and most of a large group falls together
        large = rows.filter(F.col("all") > CROWD)
        centre = large.groupBy("sig").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("c"))
        pairs = large.join(centre, "sig").filter("label <> c.label").select(
            F.least("node", "c.node").alias("x"), F.greatest("node", "c.node").alias("y")
        )
        pairs = compact(pairs.distinct().join(tested, ["x", "y"], "left_anti"))
        found = linked(pairs)
        near, tested = near.unionByName(found), tested.unionByName(pairs)
        poor = found.count() * 20 <= pairs.count()
        if not poor:
            before, rows = rows, apart(near, rows)
            discard(before)
        else:
            break
    # the nearest of each node first; then, where a node had others, all that are still apart
    more = compact(tiles(rows, payload, p, True))
    near = near.unionByName(linked(compact(more.select("x", "y").distinct().join(tested, ["x", "y"], "left_anti"))))
    open_ = more.filter("more is not null").select(F.col("more").alias("sig")).distinct()
    left = apart(near, rows.join(open_, "sig", "left_semi"))
    tested = tested.unionByName(more.select("x", "y").distinct())
    last = compact(tiles(left, payload, p, False).select("x", "y").distinct().join(tested, ["x", "y"], "left_anti"))
    near = near.unionByName(linked(last))
    return components(near)
