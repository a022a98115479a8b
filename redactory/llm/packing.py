"""Best-fit packing of documents into sequences, hierarchically.

Pieces are dealt evenly to nodes of about `node_items` and packed there by best fit, longest first; bins that are nearly full
(at most `slack` free) are done. The others go up a tree, where a bin is an item of its own size and best fit is repeated:
at each level as many nodes as their number asks for, an eighth of those below at least, so that no node grows with the
input. The tree ends at one node, or when a level has merged fewer than one in `gain` of its bins: those left are full
enough that no others fit. No bin is closed before. Ties go by size, id and piece.

Only documents longer than `length` are cut. Nulls and empty texts are pieces of the end id alone. Rows of a repeated id are
pieces of their own (told apart by their checksums only), and no node gets more of them than of others. Rows without an id are dropped, extra columns ignored. An empty
table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import lean, stored, text_buffer
from redactory.llm.tokens import encoded, vocabulary

FAN_IN = 8
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_TYPE = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i8"), ("ids_crc32", "<i8")])
_LEVEL = f"{_PIECE}, sequence_id long, `offset` long, bin binary"


def _pieces(path: str, end_id: int, length: int):
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            for a, b, tokens, at in encoded(batch.column(1), path, end_id):
                view = memoryview(tokens.tobytes())
                n = np.diff(at)
                count = -(-n // length)
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * length
                size = np.minimum(length, n[doc] - start)
                lo = at[doc] + start
                crc = [zlib.crc32(view[4 * x : 4 * (x + k)]) for x, k in zip(lo.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][doc]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions: longest first, each into the fullest bin it fits (a bit set of the residuals finds it)."""
    bins: list[list[int]] = []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            k = at[left].pop()
            if not at[left]:
                free &= ~(1 << left)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        left -= size
        if left:
            at[left].append(k)
            free |= 1 << left
    return bins


def _level(level: int, capacity: int, slack: int):
    """Packs the bins of a node: rows of the pieces that are done, and rows of bins to carry on."""

    def run(t: pa.Table) -> pa.Table:
        node = t["node"][0].as_py()
        buf, offs = text_buffer(t["bin"])
        items = np.frombuffer(buf.tobytes(), _PIECE_TYPE)
        offs = offs // _PIECE_TYPE.itemsize
        used = np.add.reduceat(items["length"], offs[:-1])
        order = np.lexsort((items["piece"][offs[:-1]], items["doc_id"][offs[:-1]], -used))
        bins = [[order[i] for i in b] for b in best_fit(used[order].tolist(), capacity)]
        full = np.array([int(used[b].sum()) for b in bins])
        done = full >= capacity - slack
        rows, seq, off, carry = [], [], [], []
        for k, b in enumerate(bins):
            own = np.concatenate([items[offs[i] : offs[i + 1]] for i in b])
            if done[k]:
                rows.append(own)
                seq.append(np.full(len(own), (level << 57) | (node << 26) | k, np.int64))
                off.append(np.cumsum(own["length"]) - own["length"])
            else:
                carry.append(own.tobytes())
        rows = np.concatenate([np.zeros(0, _PIECE_TYPE), *rows])
        none = len(carry)
        column = lambda x, kind: pa.concat_arrays([pa.array(np.ascontiguousarray(x), kind), pa.nulls(none, kind)])
        out = {f: column(rows[f], pa.int32() if f == "piece" else pa.int64()) for f in _PIECE_TYPE.names}
        out["sequence_id"] = column(np.concatenate([np.zeros(0, np.int64), *seq]), pa.int64())
        out["offset"] = column(np.concatenate([np.zeros(0, np.int64), *off]), pa.int64())
        out["bin"] = pa.concat_arrays([pa.nulls(len(rows), pa.binary()), pa.array(carry, pa.binary())])
        return pa.table(out)

    return run


def _single(batches):
    for batch in batches:
        rows = np.zeros(batch.num_rows, _PIECE_TYPE)
        for i, f in enumerate(_PIECE_TYPE.names):
            rows[f] = np.asarray(batch.column(i))
        size = _PIECE_TYPE.itemsize
        data = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])
        yield pa.RecordBatch.from_arrays([data], names=["bin"])


def _opened(batches):
    """The pieces of bins as they are left: each bin is a sequence."""
    for batch in batches:
        buf, offs = text_buffer(batch.column(0))
        items = np.frombuffer(buf.tobytes(), _PIECE_TYPE)
        offs = offs // _PIECE_TYPE.itemsize
        ends = np.cumsum(items["length"])
        n = np.diff(offs)
        offset = ends - items["length"] - np.repeat(np.append(0, ends)[offs[:-1]], n)
        columns = [pa.array(np.ascontiguousarray(items[f])) for f in _PIECE_TYPE.names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(np.asarray(batch.column(1)), n)), pa.array(offset)], names=[*_PIECE_TYPE.names, "sequence_id", "offset"])


def pack(documents: DataFrame, length: int = 4096, path: str | None = None, end_id: int = 1, slack: int = 16, node_items: int = 20_000, gain: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): see the module's text."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    pieces = stored(docs.mapInArrow(lean(_pieces(path or vocabulary(), end_id, length)), _PIECE), "packing-pieces")
    bins, n = pieces.mapInArrow(lean(_single), "bin binary"), pieces.count()
    out, level, nodes = None, 0, max(1, -(-n // node_items))
    while True:
        # dealt by content and place in the table, so that repeated rows spread as well
        dealt = bins.withColumn("node", F.pmod(F.xxhash64("bin", F.monotonically_increasing_id()), F.lit(nodes)))
        got = stored(dealt.groupBy("node").applyInArrow(lean(_level(level, length, slack)), _LEVEL), "packing-level")
        done = got.where("bin is null").drop("bin")
        out = done if out is None else out.unionByName(done)
        bins, before, n = got.where("bin is not null").select("bin"), n, got.where("bin is not null").count()
        level += 1
        if nodes == 1 or (before - n) * gain < before:
            rest = bins.withColumn("sequence_id", F.lit(level << 57) + F.monotonically_increasing_id())
            return out.unionByName(rest.mapInArrow(lean(_opened), f"{_PIECE}, sequence_id long, `offset` long"))
        nodes = max(-(-n // node_items), -(-nodes // FAN_IN), 1)


