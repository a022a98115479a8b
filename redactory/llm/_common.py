"""Shared parts: storage in the cluster's shared folder, word hashing over Arrow buffers, bucketed blobs, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay under this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

#: While a table is written: nothing reads its shuffle files again once it is there, and workers get small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
U64 = np.uint64
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}
_written: list[tuple[SparkSession, str]] = []
_tables: dict[str, str] = {}


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all is one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return the table read back: this cuts the lineage durably.

    With `by` it is dealt by that column into as many buckets as there are shuffle partitions: joins by the column don't shuffle it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        if by is None:
            df.write.options(**options).parquet(path)
        else:
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            _tables[path] = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
            df.repartition(n, by).write.options(**options).option("path", path).bucketBy(n, by).format("parquet").saveAsTable(_tables[path])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path) if by is None else spark.table(_tables[path])
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)
        _written.remove((df.sparkSession, df._stored_at))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more, rather than when the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the gateway may already be gone at exit
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(df: DataFrame, *measures: Column) -> DataFrame:
    """df with a broadcast hint if its measured size allows it, else as it is (df must be cheap to read: a stored table).

    measures: the lengths of what has no fixed width; other columns count 16 bytes a row, with 32 for the row itself."""
    size = F.count("*") * (32 + 16 * len(df.columns))
    for m in measures:
        size = size + F.coalesce(F.sum(m), F.lit(0))
    return F.broadcast(df) if df.agg(size).first()[0] <= BROADCAST_BYTES else df


def buckets(spark: SparkSession, factor: int = 4) -> int:
    """Buckets for blob exchanges: a multiple of the shuffle partitions, so that they follow the cluster's sizing."""
    return max(8, factor * int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- workers


def _give_back() -> None:
    """Free memory that the allocators keep goes back to the system: an idle worker would hold it while others work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        return


def lean(f):
    """f, for mapInArrow or applyInArrow, giving memory back at the end of a task or of a large group."""

    def table(t: pa.Table) -> pa.Table:
        out = f(t)
        if t.nbytes > 4 << 20:
            _give_back()
        return out

    def run(batches):
        if isinstance(batches, pa.Table):
            return table(batches)
        return stream(batches)

    def stream(batches):
        try:
            yield from f(batches)
        finally:
            _give_back()

    return run


# ---------------------------------------------------------------- words


def parts(batch: pa.RecordBatch, text: int = 1, size: int = 4 << 20):
    """The batch in slices of about `size` bytes of text, which bounds the memory in use; a longer text is a slice of its own."""
    _, offs = text_buffer(batch.column(text))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + size, side="right")) - 1)
        yield batch.slice(row, to - row)
        row = to


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them (nulls as empty), without a copy where possible."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)


def spans(buf: np.ndarray, offs: np.ndarray, gaps: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ (or of what lies between other gaps), and each row's offsets in them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~gaps[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(name: str, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if name not in _POWERS or len(_POWERS[name][0]) < n:
        size = max(n, _BLOCK + 1)

        def row(b: int) -> np.ndarray:
            out = np.full(size, b, dtype=U64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _POWERS[name] = (row(base), row(pow(base, -1, 1 << 64)))
    return _POWERS[name]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes; in blocks, so that the memory in use is bounded by the longest word."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = powers("bytes", _BASE, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum((buf[lo:hi].astype(U64) + U64(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def hashed(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column and each row's offsets in them."""
    buf, offs = text_buffer(col)
    if lower:
        buf = lower_ascii(buf)
    starts, ends, rows = spans(buf, offs)
    return word_hashes(buf, starts, ends), rows


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of `size` consecutive word hashes from each position on (also across rows: callers cut)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, size, U64)
    for j in range(size):
        out += words[j : j + n] * U64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    return mix(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """As shingle_hashes, in time that doesn't depend on `size`: polynomial prefix sums over the word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers("words", 0xA0761D6478BD642F, len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n] + U64(size))


def shingle_sets(col: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row with fewer words has its whole sequence as one, one without words none."""
    words, rows = hashed(col, lower=True)
    all_ = shingle_hashes(words, size)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(all_[a : b - size + 1]))
        else:
            out.append(shingle_hashes(words[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


# ---------------------------------------------------------------- blobs


def by_bucket(keys: np.ndarray, n: int, *columns: np.ndarray):
    """(bucket, keys, *columns) for each bucket of the keys that has any, in order."""
    if not len(keys):
        return
    b = ((keys >> U64(17)) % U64(n)).astype(np.uint16 if n <= 1 << 16 else np.uint32)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    parts = [np.split(x[order], cuts) for x in (keys, *columns)]
    for i, at in enumerate(np.concatenate(([0], cuts))):
        yield (int(b[at]), *(p[i] for p in parts))


def joined(col: pa.ChunkedArray, dtype) -> np.ndarray:
    """The binary values of a column, one after the other, as one array."""
    buf, _ = text_buffer(col)
    return np.frombuffer(buf.tobytes(), dtype)


def groups(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array, and its length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int = 0):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a > b:
            a, b = b, a
        self.up[b] = a
        return a


def flattened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges a-b as (member, smallest member of its component): fewer edges with the same components."""
    ids, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    forest = Forest(len(ids))
    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist()):
        forest.union(x, y)
    roots = np.array([forest.find(i) for i in range(len(ids))], np.int64)
    keep = roots != np.arange(len(ids))
    return ids[keep], ids[roots[keep]]


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges(a, b) with a != b; component is the smallest node reached.

    Alternating large-star and small-star steps over edges from a larger to a smaller node, until every node has one
    smaller neighbour and that has none. Steps join only the nodes that have to move: those minima are pre-aggregated,
    stored and, if small, broadcast; else both sides of the join are plain exchanges, of which Spark splits a node with
    very many neighbours. All is written to the shared folder, so a lost executor costs one step. An empty table gives an
    empty table."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), name)
    for _ in range(rounds):
        moved = False
        up = edges.groupBy("a").agg(F.min("b").alias("m")).join(edges.select(F.col("b").alias("a")).distinct(), "a").toDF("b", "m")
        jump = stored(up, name)
        if not jump.isEmpty():
            moved = True
            new = stored(edges.join(sized(jump), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), name)
            forget(edges)
            edges = new
        fork = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).where("m < x").drop("x"), name)
        if not fork.isEmpty():
            moved = True
            pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
            both = F.when(F.col("m").isNull(), F.array(pair("a", "b"))).otherwise(F.array(pair("a", "m"), pair("b", "m")))
            new = stored(edges.join(sized(fork), "a", "left").select(F.inline(both)).where("a != b").distinct(), name)
            forget(edges)
            edges = new
        forget(jump, fork)
        if not moved:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def crc_mod(col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % mod
