"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of some documents, in ascending order of their ids, in blocks of 256. Of a block its minimum is
subtracted, and what is left is packed at a width that nine of ten values fit; the high bits of the others stand in an
exception list. The start of each block is indexed, so that a document is read without unpacking the blocks before it.
Layout (little-endian): the magic, five int64 (documents, ids, blocks, packed words, exceptions), document ids int64, their
counts int64, block starts in words int64 (one more than blocks), block minima uint32, widths uint8, exceptions of each
block uint16, exceptions' positions uint8 (padded to 8), exceptions' high parts uint32 (padded to 8), packed words uint64.

Files are rows of a Parquet table in the cluster's shared folder, cut at `file_ids` ids: the texts are range-partitioned by
id, so each task writes whole files of its own range and holds one file in memory. Nulls and empty texts have the end id
alone. Rows of a repeated id stand side by side, in an order
that their texts give. Rows without an id are dropped, extra columns ignored. An
empty table gives no file and an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm._common import lean, sized, stored
from redactory.llm.tokens import encoded, vocabulary

MAGIC = b"PFOR-01\n"
BLOCK = 256
SHARE = 0.9


def _lanes(width: int):
    """For each of 64 values: its word, its shift, and whether it runs over into the next word."""
    for i in range(64):
        word, shift = divmod(i * width, 64)
        yield i, word, np.uint64(shift), shift + width > 64


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as rows of `width` words."""
    out = np.zeros((len(values), width), np.uint64)
    for i, word, shift, over in _lanes(width):
        out[:, word] |= values[:, i] << shift
        if over:
            out[:, word + 1] |= values[:, i] >> (np.uint64(64) - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i, word, shift, over in _lanes(width):
        x = words[:, word] >> shift
        if over:
            x |= words[:, word + 1] << (np.uint64(64) - shift)
        out[:, i] = x & mask
    return out


def write_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    n = -(-len(ids) // BLOCK)
    blocks = np.zeros((n, BLOCK), np.uint32)
    if n:
        blocks.reshape(-1)[: len(ids)] = ids
        blocks.reshape(-1)[len(ids) :] = ids[-1]
    low = blocks.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = blocks - low[:, None]
    fit = np.partition(rest, int(BLOCK * SHARE), axis=1)[:, int(BLOCK * SHARE)] if n else low
    widths = np.ceil(np.log2(fit.astype(np.float64) + 1)).astype(np.uint8)
    high = np.where(widths[:, None] < 32, rest >> np.minimum(widths, 31)[:, None].astype(np.uint32), np.uint32(0))
    where, pos = np.nonzero(high)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(widths.astype(np.int64) * (BLOCK // 64), out=starts[1:])
    packed = np.zeros(int(starts[-1]), np.uint64)
    for w in np.unique(widths).tolist():
        if w:
            own = np.flatnonzero(widths == w)
            bits = (rest[own].astype(np.uint64) & np.uint64((1 << w) - 1)).reshape(-1, 64)
            packed[(starts[own][:, None] + np.arange(w * (BLOCK // 64))).reshape(-1)] = pack(bits, w).reshape(-1)
    head = np.array([len(doc_ids), len(ids), n, len(packed), len(pos)], np.int64)
    parts = [head, doc_ids.astype(np.int64), counts.astype(np.int64), starts, low, widths, np.bincount(where, minlength=n).astype(np.uint16), pos.astype(np.uint8), high[where, pos], packed]
    return MAGIC + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in parts)


class TokenFile:
    """A file's documents and ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.at, self.data = 8, data
        docs, self.n_ids, n, words, n_high = self._take(np.int64, 5).tolist()
        self.doc_ids, self.counts = self._take(np.int64, docs), self._take(np.int64, docs)
        self.starts, self.low, self.widths = self._take(np.int64, n + 1), self._take(np.uint32, n), self._take(np.uint8, n)
        self.n_high = np.concatenate(([0], np.cumsum(self._take(np.uint16, n), dtype=np.int64)))
        self.pos, self.high, self.words = self._take(np.uint8, n_high), self._take(np.uint32, n_high), self._take(np.uint64, words)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))

    def _take(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes + (-out.nbytes % 8)
        return out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop; only their blocks are unpacked."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, -(-stop // BLOCK)
        widths, out = self.widths[a:b], np.zeros((b - a, BLOCK), np.uint64)
        for w in np.unique(widths).tolist():
            if w:
                own = np.flatnonzero(widths == w)
                words = self.words[(self.starts[a:b][own][:, None] + np.arange(w * (BLOCK // 64))).reshape(-1)]
                out[own] = unpack(words.reshape(-1, w), w).reshape(-1, BLOCK)
        lo, hi = self.n_high[a], self.n_high[b]
        row = np.repeat(np.arange(b - a), np.diff(self.n_high[a : b + 1]))
        out[row, self.pos[lo:hi]] |= self.high[lo:hi].astype(np.uint64) << widths[row].astype(np.uint64)
        out += self.low[a:b, None]
        return out.reshape(-1)[start - a * BLOCK : stop - a * BLOCK].astype(np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.offsets[i]), int(self.offsets[i + 1]))


def _write(path: str, end_id: int, file_ids: int):
    def run(batches):
        docs: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def file():
            nonlocal size
            d, c, i = (np.concatenate(x) for x in (docs, counts, held))
            docs.clear(), counts.clear(), held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([int(d[0])]), pa.array([int(d[-1])]), pa.array([len(i)], pa.int64()), pa.array([write_file(d, c, i)], pa.binary())], names=["first_id", "last_id", "n_ids", "content"])

        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            for a, b, tokens, at in encoded(batch.column(1), path, end_id):
                docs.append(ids[a:b]), counts.append(np.diff(at)), held.append(tokens)
                size += len(tokens)
                if size >= file_ids:
                    yield file()
        if docs:
            yield file()

    return run


_FILE = "first_id long, last_id long, n_ids long, content binary"


def write_files(documents: DataFrame, path: str | None = None, end_id: int = 1, file_ids: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The files, as rows of a stored table: (first_id, last_id, n_ids, content), each with `before`: the ids of all files before it."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    files = stored(ordered.mapInArrow(lean(_write(path or vocabulary(), end_id, file_ids)), _FILE).withColumn("part", F.monotonically_increasing_id()), "token-files", compression="none")
    # the upper bits of `part` are the range's number; there are as many ranges as shuffle partitions
    files = files.withColumn("range", F.shiftright("part", 33))
    before, known = 0, []
    for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect():
        known.append((r["range"], before))
        before += r["n"]
    ranges = files.sparkSession.createDataFrame(known, "range long, above long")
    inner = F.sum("n_ids").over(Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    order = files.select("range", "part", "n_ids").withColumn("inner", F.coalesce(inner, F.lit(0).cast("long")))
    order = order.join(F.broadcast(ranges), "range").select("part", (F.col("above") + F.col("inner")).alias("before"))
    return files.drop("range").join(sized(stored(order, "token-files-order")), "part")


def _read(batches):
    for batch in batches:
        for content, before in zip(batch.column(0), batch.column(1).to_pylist()):
            f = TokenFile(content.as_py())
            crc = []
            step = 256
            for a in range(0, len(f.doc_ids), step):  # some documents at a time
                b = min(a + step, len(f.doc_ids))
                lo = int(f.offsets[a])
                view = memoryview(f.ids(lo, int(f.offsets[b])).tobytes())
                crc += [zlib.crc32(view[4 * (x - lo) : 4 * (y - lo)]) for x, y in zip(f.offsets[a:b].tolist(), f.offsets[a + 1 : b + 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids), pa.array(f.offsets[:-1] + before), pa.array(f.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files' bytes."""
    return files.select("content", "before").mapInArrow(lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")
