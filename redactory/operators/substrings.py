"""Substring joins of many texts with many values, without a pair for every two that share a common piece."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.sources.shared import apart, kept, spread

#: Counters of pieces: no table of them has more rows, so they may be broadcast.
BUCKETS = 1 << 16
#: Bits of the table that says which keys of pieces may be those of values.
MARKS = 1 << 24


def _pieces(rows: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """(column, piece, bucket): all distinct pieces of the sizes that each text holds."""
    cut = lambda n: F.when(F.length(column) >= n, F.transform(F.sequence(F.lit(1), F.length(column) - (n - 1)), lambda i: F.substring(F.col(column), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    out = rows.select(column, F.explode(F.array_distinct(F.flatten(F.array(*map(cut, sizes))))).alias("piece"))
    return out.withColumn("bucket", _bucket(F.col("piece")))


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS))


def _in_buckets(pieces: DataFrame, of: DataFrame) -> DataFrame:
    """Only pieces of the buckets of `of`: common ones that nobody asks for are not shuffled."""
    return pieces.join(F.broadcast(of.select("bucket").distinct()), "bucket", "left_semi")


def holding(texts: DataFrame, values: DataFrame, want: str = "text", size: int = 5, hot: int = 1000) -> DataFrame:
    """texts(text), values(value), both distinct and cheap to read: the texts that hold a value, with want="value" the values that lie in a text, or with
    want="pairs" (text, value) of all that do.

    A text holds a value only if it holds the value's rarest piece of `size` characters. Pieces are counted in `BUCKETS`
    counters (no count is too low), a value one of whose pieces is nowhere leaves at once, and texts and values meet by
    these pieces; then the exact test. Values whose rarest piece is in more than `hot` texts, or is that of more than `hot`
    values, and values shorter than a piece meet texts by all of themselves instead: as pieces as long as they are, by equality. So the
    rows made by a key are bounded by hot * hot, and large groups cost a row for each text. Null and empty values lie nowhere."""
    values = values.where("value <> ''")
    long = _pieces(values, "value", [size])
    counts = _pieces(texts, "text", [size]).groupBy("bucket").agg(F.count("*").alias("n"))
    rarest = long.join(F.broadcast(counts), "bucket", "left").groupBy("value").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece", "bucket")).alias("r")).where("r.n > 0").select("value", "r.*")
    rarest = kept(rarest, "rarest-pieces")
    choices = rarest.groupBy("piece").agg(F.count("*").alias("m"))
    busy = choices.where(F.col("m") > hot).select("piece")
    cold = rarest.where(F.col("n") <= hot).join(apart(busy), "piece", "left_anti")
    whole = rarest.where(F.col("n") > hot).select("value").union(rarest.where(F.col("n") <= hot).join(apart(busy), "piece", "left_semi").select("value")).union(values.where(F.length("value") < size))
    whole = kept(whole.withColumn("bucket", _bucket(F.col("value"))), "whole-pieces")
    pairs = _in_buckets(_pieces(texts, "text", [size]), cold).join(apart(cold.select("piece", "value")), "piece").where(F.col("text").contains(F.col("value")))
    columns = ["text", "value"] if want == "pairs" else [want]
    found = pairs.select(*columns)
    if sizes := sorted(r[0] for r in whole.select(F.length("value")).distinct().collect()):  # as many as there are lengths
        held = _in_buckets(_pieces(texts, "text", sizes), whole)
        if want == "pairs":
            found = found.union(held.join(apart(whole.select(F.col("value").alias("piece"))), "piece").select("text", F.col("piece").alias("value")))
        elif want == "text":
            found = found.union(held.join(apart(whole.select(F.col("value").alias("piece"))), "piece", "left_semi").select("text"))
        else:
            found = found.union(whole.join(apart(held.select(F.col("piece").alias("value")).distinct()), "value", "left_semi").select("value"))
    return found.distinct()


#: Characters of a text that a window takes, at least; so many segments are put together before they are cut.
WINDOW, SEGMENTS = 1024, 1024


def text_windows(texts: DataFrame, longest: int) -> DataFrame:
    """(doc_id, text): lower-case texts cut so that what is no longer than `longest` lies whole in a window."""
    own = max(WINDOW, longest)
    rows = texts.where("text is not null").select("doc_id", F.lower("text").alias("t"))
    cuts = rows.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.greatest(F.length("t") - 1, F.lit(0)), F.lit(own))).alias("k"))
    return cuts.select("doc_id", F.substring("t", F.col("k") + 1, F.lit(own + max(longest - 1, 0))).alias("text"))


def segment_windows(segments: DataFrame, longest: int) -> DataFrame:
    """text_windows of the texts that segments (doc_id, seg_ord, text) are, joined in order: a row for some segments is what is summed up in one task."""
    own = max(WINDOW, longest)
    joined = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "text"))), lambda x: x["text"]), ""))
    parts = kept(segments.where("text is not null").groupBy("doc_id", F.floor(F.col("seg_ord") / SEGMENTS).alias("part")).agg(joined.alias("t")), "joined-segments")
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select("doc_id", "part", F.coalesce(F.sum(F.length("t").cast("long")).over(before), F.lit(0)).alias("at"))
    at, end = F.col("at"), F.col("at") + F.greatest(F.length("t") - 1, F.lit(0))
    first = lambda x: F.floor(x / own)
    # a part gives each window what it has of it, and what the window before needs of this one's beginning
    cuts = parts.join(apart(sums), ["doc_id", "part"]).select("doc_id", "at", "t", F.explode(F.sequence(F.greatest(first(at) - 1, F.lit(0)), first(end))).alias("k"))
    low = F.greatest(F.col("k") * own - F.col("at"), F.lit(0)).cast("int")
    high = ((F.col("k") + 1) * own + max(longest - 1, 0) - F.col("at")).cast("int")
    pieces = cuts.select("doc_id", "k", "at", F.substring("t", low + 1, F.greatest(high - low, F.lit(0))).alias("t"))
    texts = pieces.groupBy("doc_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "").alias("text"))
    return texts.select("doc_id", "text")


def _marked(keys: DataFrame) -> bytes:
    """Bits of a table of fixed size, set for what the keys come to: what is not marked is no key."""
    bit = F.pmod("key", F.lit(MARKS)) + 1  # these functions count from 1
    rows = keys.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(MARKS // 8)
    for bucket, bits in rows.collect():  # as many as the table has blocks
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = bits
    return bytes(out)


def _pieces_of(texts: list[str], doc: np.ndarray, sizes: int):
    """(size, rows, places, keys): places in each text, from 1, at which a piece of the size starts, with the piece's key; sizes that are powers of two, up to `sizes`.

    A piece's hash is made of those of its halves; the key is made of it, its size and its document."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(points.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[row] - place
    mixed = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h, size = mixed(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while size <= sizes and h.size:
        some = np.flatnonzero(left[: h.size] >= size)
        keys = mixed(mixed(h[some] + np.uint64(size)) ^ doc.view(np.uint64)[row[some]])
        yield size, row[some], place[some] + 1, (keys ^ (keys >> np.uint64(32))).view(np.int64)
        h = mixed(mixed(h[:-size]) * np.uint64(0x94D049BB133111EB) + h[size:])
        size *= 2


def _some(batches, column: str):
    """Stretches of batches whose texts have about a million characters, or are one text."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.utf8_length(batch.column(column)).cast(pa.int64())))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
            yield batch.slice(a, b - a)
            a = b


def lying(values: DataFrame, windows: DataFrame) -> DataFrame:
    """values (doc_id, value), distinct, that lie in a window (window, doc_id, text) of their document; both cheap to read.

    A value is looked up by a piece more than half as long as itself, a power of two: of its pieces that which the fewest values have. Only
    keys of pieces and their places are shuffled, of windows those that a table of fixed size has marked as some value's; the exact test follows
    where a window has the piece. Values that share all their pieces with many others meet each other's places, so only such groups
    cost more than their rows. No side of a join goes to the driver."""
    longest = values.agg(F.max(F.length("value"))).first()[0] or 0
    if not longest:
        return values.limit(0)
    most = 1 << (longest.bit_length() - 1)

    def cut(batches):
        for b in _some(batches, "value"):
            texts, doc, number = b.column("value").to_pylist(), np.asarray(b.column("doc"), np.int64), np.asarray(b.column("number"), np.int64)
            own = np.array([1 << (len(x).bit_length() - 1) for x in texts], np.int64)
            for size, row, place, key in _pieces_of(texts, doc, most):
                here = own[row] == size
                if here.any():
                    yield pa.RecordBatch.from_arrays([pa.array(number[row[here]]), pa.array(key[here]), pa.array(place[here].astype(np.int32))], names=["number", "key", "place"])

    numbered = kept(spread(values.where("value <> ''"), "doc_id", "value").withColumn("number", F.monotonically_increasing_id()), "numbered-values")
    pieces = kept(numbered.select("number", "value", F.xxhash64("doc_id").alias("doc")).mapInArrow(cut, "number long, key long, place int"), "pieces-of-values")
    shared = pieces.groupBy("key").agg(F.count("*").alias("n"))
    chosen = pieces.join(apart(shared), "key").groupBy("number").agg(F.min(F.struct("n", "key", "place")).alias("c")).select("number", "c.key", "c.place")
    chosen = kept(chosen, "chosen-pieces")
    marks = values.sparkSession.sparkContext.broadcast(_marked(chosen))

    def found(batches):
        bits = np.frombuffer(marks.value, np.uint8)
        for b in _some(batches, "text"):
            texts, doc, window = b.column("text").to_pylist(), np.asarray(b.column("doc"), np.int64), np.asarray(b.column("window"), np.int64)
            for _, row, place, key in _pieces_of(texts, doc, most):
                at = key & (MARKS - 1)
                here = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(window[row[here]]), pa.array(key[here]), pa.array(place[here].astype(np.int32))], names=["window", "key", "at"])

    there = spread(windows.select("window", "text", F.xxhash64("doc_id").alias("doc")), "window").mapInArrow(found, "window long, key long, at int")
    hits = there.join(apart(chosen), "key").select("window", "number", (F.col("at") + 1 - F.col("place")).alias("at")).where("at >= 1")
    hits = hits.join(apart(numbered.select("number", F.col("doc_id").alias("of"), "value")), "number")
    return hits.join(apart(windows), "window").where((F.col("doc_id") == F.col("of")) & (F.substring("text", F.col("at"), F.length("value")) == F.col("value"))).select("doc_id", "value").distinct()
