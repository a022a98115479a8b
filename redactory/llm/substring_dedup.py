"""Substring dedup by level-wise doubling over word windows.

A word is removed if a window of `window` words covers it whose word sequence also starts in a document with a smaller id.
Levels double the length that is looked up: for windows of 50 words 7, 13, 25 and 50. At each level a window that is still
a candidate looks up the least hash of the shorter windows within it, which equal windows have in common (neighbours share
it, so at the first level about one position in twenty is shuffled); if that occurs in one document alone, the window leaves.
Only documents with candidates go on to the level of twice the length, until none survives or the length is that of the
window itself: then its whole word sequence, by 128 bits, decides. Windows meet by bucket, as arrays; of a window that many
documents of a part hold, the smallest alone goes on, and the rest are settled on the spot, so a passage that every document
has costs one entry a part.

Texts are dealt by id once and stored in buckets, so no level and not the removal shuffles them again: what is found comes to them.
They are taken in parts of a few megabytes, which bounds a task's memory; a longer text is a part of its own. Groups that
meet are buckets of hashes; their number follows the shuffle partitions.

Words are [^\\x20\\x09-\\x0D]+, unchanged. Null, empty and short texts lose nothing. Repeated rows of one id with one text are
one document; rows of one id with different texts each keep a row of their own in the result, and none of them is a smaller
document than another. Rows without an id are dropped, extra columns ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import U64, buckets, by_bucket, forget, groups, hashed, joined, lean, mix, parts, sized, spans, stored, text_buffer, window_hashes

_TOLD = "doc_id long, key long"
_DEAL = "bucket int, kind int, keys binary, more binary, docs binary, pos binary"


def levels(window: int) -> list[int]:
    """Lengths, each at most twice the one before, the last the window itself."""
    out = [window]
    while out[0] > 7:
        out.insert(0, -(-out[0] // 2))
    return out


def sliding_min(a: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` consecutive values, in log(size) passes."""
    step = 1
    while step * 2 <= size:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    rest = size - step
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def squeezed(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words' bytes, each with a space behind it unless it ends its row, and the offset of each row in them."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    data = buf.copy()
    last = np.zeros(len(buf) + 1, bool)
    last[offs] = True
    behind = ends[~last[ends]]
    data[behind] = 32
    keep[behind] = True
    at = np.zeros(len(offs), np.int64)
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        at[i + 1] = at[i] + np.count_nonzero(keep[a:b])
    return data[keep].tobytes(), at


def _texts(data: bytes, at: np.ndarray) -> list[memoryview]:
    view = memoryview(data)
    return [view[a : b - 1 if b > a and data[b - 1] == 32 else b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _digests(data: bytes, at: np.ndarray) -> list[str]:
    return [hashlib.sha256(x).hexdigest() for x in _texts(data, at)]


def _anchors(words: np.ndarray, rows: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every full window its start, and the least hash of the windows of `length` words within it."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least = sliding_min(window_hashes(words, length), window - length + 1)
    ends = rows[1:]
    row = np.searchsorted(ends, np.arange(len(least)), side="right")
    start = np.flatnonzero(np.arange(len(least)) + window <= ends[row])  # its row still has `window` words from there
    return start, least[start]


def _candidates(batch: pa.RecordBatch, words: np.ndarray, rows: np.ndarray, window: int, before: int | None) -> np.ndarray:
    """Starts of the windows whose look-up at the level before was repeated; all of them at the first level."""
    if before is None:
        return _anchors(words, rows, window, window)[0]
    start, least = _anchors(words, rows, window, before)
    at = np.searchsorted(start, rows)
    live = np.zeros(len(start), bool)
    keys = batch.column(2)
    for i in range(batch.num_rows):
        live[at[i] : at[i + 1]] = np.isin(least[at[i] : at[i + 1]], np.asarray(keys[i].values, np.int64).view(U64))
    return start[live]


def _row(bucket: int, keys: bytes, docs: bytes, many: bytes, ids=None, n=None, sha=None) -> pa.RecordBatch:
    long = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([keys], pa.binary()), pa.array([docs], pa.binary()), pa.array([many], pa.binary()), pa.array([ids], long), pa.array([n], long), pa.array([sha], pa.list_(pa.string()))], names=["bucket", "keys", "docs", "many", "ids", "n", "sha"])


_LEVEL = "bucket int, keys binary, docs binary, many binary, ids array<long>, n array<long>, sha array<string>"


def _tags(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """31 bits of each text, in the upper half of a position: tells apart the texts of one id."""
    view = memoryview(np.ascontiguousarray(buf))
    return np.array([zlib.crc32(view[a:b]) >> 1 for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], np.int64) << 32


def _level(window: int, length: int, before: int | None, n_buckets: int):
    """Look-ups of the candidates at `length`, by bucket; the first level also tells of each row its words and their digest."""

    def run(batches):
        for whole in batches:
            for batch in parts(whole):
                ids = np.asarray(batch.column(0), np.int64)
                buf, offs = text_buffer(batch.column(1))
                words, rows = hashed(batch.column(1))
                if before is None:
                    starts, ends, _ = spans(buf, offs)
                    yield _row(-1, b"", b"", b"", ids.tolist(), np.diff(rows).tolist(), _digests(*squeezed(buf, offs, starts, ends)))
                    del starts, ends
                if len(words) < window:
                    continue
                start = _candidates(batch, words, rows, window, before)
                least = sliding_min(window_hashes(words, length), window - length + 1)[start]
                docs = ids[np.searchsorted(rows[1:], start, side="right")]
                new = np.ones(len(start), bool)
                new[1:] = (least[1:] != least[:-1]) | (docs[1:] != docs[:-1])
                keys, docs = least[new], docs[new]
                order = np.lexsort((docs, keys))
                keys, docs = keys[order], docs[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
                keys, docs = keys[new], docs[new]
                cut = groups(keys)
                many = np.repeat(np.diff(cut), np.diff(cut)) > 1
                first = np.zeros(len(keys), bool)
                first[cut[:-1]] = True
                yield _row(-2, keys[many].tobytes(), docs[many].tobytes(), b"")
                keep = ~many | first
                for b, k, d, m in by_bucket(keys[keep], n_buckets, docs[keep], many[keep].astype(np.uint8)):
                    yield _row(b, k.tobytes(), d.tobytes(), m.tobytes())

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """(doc_id, key) of the keys that two documents have; those that a part combined (`many`) have been told already."""
    keys, docs, many = joined(t["keys"], U64), joined(t["docs"], np.int64), joined(t["many"], np.uint8)
    order = np.lexsort((docs, keys))
    keys, docs, many = keys[order], docs[order], many[order].astype(bool)
    cut = groups(keys)
    low, high = docs[cut[:-1]], docs[cut[1:] - 1]
    live = np.repeat((np.add.reduceat(many, cut[:-1]) > 0) | (low != high), np.diff(cut)) & ~many
    return pa.table({"doc_id": docs[live], "key": keys[live].view(np.int64)})


def _settled(batches):
    for batch in batches:
        c = pa.chunked_array
        yield pa.RecordBatch.from_arrays([pa.array(joined(c([batch.column(1)]), np.int64)), pa.array(joined(c([batch.column(0)]), np.int64))], names=["doc_id", "key"])


def _verdict(keys: np.ndarray, more: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by the 128 bits of the key and by document, and whether a smaller document has the key."""
    order = np.lexsort((pos, docs, more, keys))
    keys, more, docs = keys[order], more[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])
    cut = np.append(np.flatnonzero(new), len(keys))
    return order, docs > np.repeat(docs[cut[:-1]], np.diff(cut))


def _last_level(window: int, before: int, n_buckets: int):
    def run(batches):
        for whole in batches:
            for batch in parts(whole):
                ids = np.asarray(batch.column(0), np.int64)
                words, rows = hashed(batch.column(1))
                if len(words) < window:
                    continue
                start = _candidates(batch, words, rows, window, before)
                doc = np.searchsorted(rows[1:], start, side="right")
                keys, docs, pos = window_hashes(words, window)[start], ids[doc], start - rows[doc] + _tags(*text_buffer(batch.column(1)))[doc]
                more = window_hashes(mix(words ^ U64(0xA5A5A5A5A5A5A5A5)), window)[start]
                order, later = _verdict(keys, more, docs, pos)
                keys, more, docs, pos = keys[order], more[order], docs[order], pos[order]
                none = np.zeros(0, U64)
                yield _deal(-1, 1, none, none, *_runs(docs[later], pos[later]))
                for b, k, m, d, p in by_bucket(keys[~later], n_buckets, more[~later], docs[~later], pos[~later]):
                    yield _deal(b, 0, k, m, d, p)

    return run


def _deal(bucket: int, kind: int, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=["bucket", "kind", "keys", "more", "docs", "pos"])


def _runs(docs: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive positions: the documents, and start and length side by side."""
    order = np.lexsort((pos, docs))
    docs, pos = docs[order], pos[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (pos[1:] != pos[:-1] + 1)
    at = np.flatnonzero(new)
    return docs[at], np.stack((pos[at], np.diff(np.append(at, len(docs)))), axis=1).astype(np.int64).reshape(-1)


def _later(t: pa.Table) -> pa.Table:
    keys, more, docs, pos = joined(t["keys"], U64), joined(t["more"], U64), joined(t["docs"], np.int64), joined(t["pos"], np.int64)
    order, later = _verdict(keys, more, docs, pos)
    return _run_table(*_runs(docs[order][later], pos[order][later]))


def _run_table(docs, runs) -> pa.Table:
    return pa.table({"doc_id": docs, "start": runs[0::2], "length": runs[1::2]})


def _told(batches):
    for batch in batches:
        c = pa.chunked_array
        yield from _run_table(joined(c([batch.column(0)]), np.int64), joined(c([batch.column(1)]), np.int64)).to_batches()


def _removed(window: int, texts: bool):
    def run(batches):
        for whole in batches:
            for batch in parts(whole):
                buf, offs = text_buffer(batch.column(1))
                starts, ends, rows = spans(buf, offs)
                n = np.diff(rows)
                gone = np.zeros(len(starts) + 1, np.int64)
                found, tags = batch.column(2), _tags(buf, offs)
                for i in range(len(n)):
                    values = found[i].values
                    a, k = (np.asarray(values.field(f), np.int64) for f in ("start", "length"))
                    a, k = a[own := a >> 32 == tags[i] >> 32] & 0xFFFFFFFF, k[own]
                    np.add.at(gone, rows[i] + np.minimum(a, n[i]), 1)
                    np.add.at(gone, rows[i] + np.minimum(a + k + window - 1, n[i]), -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept = np.zeros(len(keep) + 1, np.int64)
                np.cumsum(keep, out=kept[1:])
                sha = _digests(*squeezed(buf, offs, starts, ends))
                data, out = squeezed(buf, offs, starts[keep], ends[keep])
                columns = [batch.column(0), pa.array(sha), pa.array(n - np.diff(kept[rows])), pa.array(_digests(data, out))]
                if texts:
                    columns.append(pa.array([bytes(x).decode() for x in _texts(data, out)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sha", "n_removed", "kept_sha256", "kept"][: len(columns)])

    return run


def substring_dedup(documents: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), with texts=True also kept: the text of a document that lost words, else null."""
    if window < 2:
        raise ValueError("window must be at least 2")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    docs = stored(docs, "substring-texts", by="doc_id", compression="zstd")
    n = buckets(documents.sparkSession)
    lengths = levels(window)
    if len(lengths) == 1:
        lengths.insert(0, -(-window // 2))
    some, before, info, live = docs, None, None, None
    for length in lengths[:-1]:
        dealt = stored(some.mapInArrow(lean(_level(window, length, before, n)), _LEVEL), f"substring-{length}", compression="lz4")
        info = dealt if info is None else info
        found = dealt.where("bucket >= 0").select("bucket", "keys", "docs", "many").groupBy("bucket").applyInArrow(lean(_repeated), _TOLD)
        found = found.union(dealt.where("bucket = -2").select("keys", "docs").mapInArrow(lean(_settled), _TOLD))
        old, live = live, stored(found.groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "substring-live", compression="lz4")
        forget(*[x for x in (old, None if dealt is info else dealt) if x is not None])
        some = docs.join(sized(live.hint("shuffle_hash"), F.size("keys") * 8), "doc_id").select("doc_id", "text", "keys")
        before = length
    last = stored(some.mapInArrow(lean(_last_level(window, before, n)), _DEAL), "substring-last", compression="lz4")
    runs = last.where("kind = 0").select("bucket", "keys", "more", "docs", "pos").groupBy("bucket").applyInArrow(lean(_later), "doc_id long, start long, length long")
    runs = runs.union(last.where("kind = 1").select("docs", "pos").mapInArrow(lean(_told), "doc_id long, start long, length long"))
    runs = stored(runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("runs")), "substring-runs", compression="lz4")
    forget(last, live)
    rows = info.where("bucket = -1").select(F.explode(F.arrays_zip("ids", "n", "sha")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.n").alias("n_words"), F.col("x.sha").alias("sha"))
    out = "doc_id long, sha string, n_removed long, kept_sha256 string" + ", kept string" * texts
    some = docs.join(sized(runs.hint("shuffle_hash"), F.size("runs") * 16), "doc_id")
    removed = some.select("doc_id", "text", "runs").mapInArrow(lean(_removed(window, texts)), out).dropDuplicates(["doc_id", "sha"])
    both = rows.dropDuplicates(["doc_id", "sha"]).join(removed, ["doc_id", "sha"], "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *["kept"] * texts)
