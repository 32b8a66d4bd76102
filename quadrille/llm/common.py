"""Shared pieces: vectorised words over Arrow text, hashing, checkpoints, worker paths.

Everything that looks at text works on the UTF-8 bytes of an Arrow column in
blocks of about a megabyte of whole rows, so memory is bounded by the block or by
the longest single text, and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BLOCK_BYTES = 1 << 20
#: Strata, and ids or other rows of a few numbers, that may be broadcast; beyond it they are joined.
BROADCAST_STRATA = 100_000
ROWS_A_TASK = 50_000
BROADCAST_IDS = 2_000_000
_written: list[str] = []

# Word separators of every operator here are space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES)
        have = np.full(size, U(base))
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 23:
            _powers[base] = have
    return have


@dataclass
class Block:
    """Whole rows of a batch: rows first..first+len-1, their bytes and offsets."""

    first: int
    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


def text_blocks(column: pa.Array, target: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of whole rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + target, "right")) - 1
        b = min(max(b, a + 1), n)
        yield Block(a, data[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; words end with their row."""
    n = len(block.buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = ~SPACE[block.buf]
    head = np.zeros(n + 1, bool)
    head[block.off] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | head[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | head[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(block.off, s, "right") - 1


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal bytes have equal hashes in every process."""
    n = len(buf)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + U(1)) * _power_table(_BASE, n)[:n], out=pre[1:])
    h = (pre[e] - pre[s]) * _power_table(_BASE_INV, n + 1)[s]
    return mix(h ^ ((e - s).astype(np.uint64) * U(_MULT)))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of each n successive values (across rows too: mask after)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        acc = mix(acc ^ h[k : len(h) - n + 1 + k]) * U(_MULT) + U(k + 1)
    return mix(acc)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, in planes of equal weight, as wide as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes | memoryview, at: int, count: int) -> tuple[np.ndarray, int]:
    """(numbers, where they end) of planes at a place in data."""
    width = data[at]
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, count * width, at + 1).reshape(width, count).T
    return wide.view(np.uint64).ravel(), at + 1 + count * width


def bucket_of(x: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Which of equal ranges of numbers of so many bits each number is in."""
    return ((x >> U(bits - 32)) * U(buckets) >> U(32)).astype(np.int64)


class Index:
    """Positions of keys in a sorted key array; -1 where absent. A hash table in numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2))))
        order = np.argsort(keys >> U(64 - self.bits), kind="stable")
        self.keys, self.at = keys[order], order.astype(np.int32)
        bucket = (self.keys >> U(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(bucket, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.start).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        bucket = (keys >> U(64 - self.bits)).astype(np.int64)
        a, b = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero(a < b)
        for k in range(self.most):
            if not len(todo):
                break
            spot = a[todo] + k
            same = self.keys[spot] == keys[todo]
            out[todo[same]] = self.at[spot[same]]
            todo = todo[~same & (spot + 1 < b[todo])]
        return out


#: Whole texts in an Arrow batch, unless the user has set their number: batches stand in the memory of both processes.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_A_BATCH = 2000


#: What a worker keeps from one task to the next of the same operator. Only functions of this module may touch it: tasks
#: travel with copies of the globals that they name.
_kept: dict = {}


def kept(key: tuple, build: Callable[[], object]) -> object:
    """What this worker has under the key, built if it has not."""
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def forget() -> None:
    _kept.clear()


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which its worker, which waits for other tasks, gives memory back; what an operator that
    keeps a cache has left in the worker goes when another operator's task begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        try:
            yield from task(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run


#: Workers of these operators make many large arrays for a short time: their allocators are told to give memory back.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and set their allocators up unless the user has."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    if spark.sparkContext.getConf().get(ARROW_ROWS) is None and spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, TEXTS_A_BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where unset and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quadrille-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def compact(df: DataFrame) -> DataFrame:
    """A checkpoint, read by a task for each ROWS_A_TASK rows: few rows make few shuffle files later."""
    df = checkpoint(df)
    return df.coalesce(df.count() // ROWS_A_TASK + 1)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write once as Parquet in the shared folder and read it back, columns prunable."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string")) % n


@contextmanager
def small_batches(spark: SparkSession, rows: int = 200) -> Iterator[None]:
    """Fewer rows in an Arrow batch, for what is run inside: rows that may be large each."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored frame that is not read again."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files whose frames are gone; it waits for the collector otherwise."""
    for _ in range(2):  # Python's references reach the JVM a little later
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def if_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, of a few numbers each, are at most BROADCAST_IDS."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def sweep(spark: SparkSession) -> None:
    """Delete what this driver's operators stored; call it when their results are no longer read."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which sweep() will delete."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_ids(rows: DataFrame, id_col: str, strata: list[str], per_stratum: int) -> DataFrame:
    """At most per_stratum ids of each stratum, in the order of a hash of the id.

    Reads only the id and the strata; the result is bounded by parameter, so it may be broadcast.
    A threshold on the hash, from each stratum's count, leaves about twice the wanted rows before
    they are ranked, whatever the number of tasks.
    """
    from pyspark.sql import Window

    scale = 1 << 20
    size = checkpoint(rows.groupBy(*strata).agg(F.count("*").alias("_size")))
    if size.count() <= BROADCAST_STRATA:  # else the rows would be dealt out by stratum, of which one may be large
        size = F.broadcast(size)
    few = F.pmod(F.xxhash64(F.col(id_col)), F.lit(scale)) * F.col("_size") < (2 * per_stratum + 64) * scale
    w = Window.partitionBy(*strata).orderBy(F.xxhash64(F.col(id_col)), F.col(id_col))
    return (
        rows.select(id_col, *strata)
        .join(size, strata)
        .filter(few)
        .withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= per_stratum)
        .drop("_rank", "_size")
    )
