"""N-gram Jaccard join: components of documents whose word-shingle sets reach a Jaccard similarity.

T-occurrence search in the DivideSkip manner. A pair with sets of n and m shingles links if it shares at least
ceil(t * (n + m) / (1 + t)) of them, which is at least T = ceil(t * n). So for a set of n its L < T longest inverted lists are
left out of the merge: the short ones are merged and counted, what occurs in T - L of them at least is a candidate, and the
long lists are only probed, by binary search, for the candidates. Spark's part:

1. `screened`: of each set the smallest hashes (the prefix that must hold `l` common ones with any partner) are dealt by
   bucket, as arrays; a document of whose prefix too few hashes occur elsewhere has no partner and leaves. Hashes that
   repeat within a part are combined before the shuffle, so that a very common one costs one entry a part.
2. Equal sets collapse to one node with their smallest document.
3. The nodes of the remaining shingles are counted by bucket, but for a bounded table of the most frequent ones, whose
   counts are told to all tasks. Each set is ordered by these counts, what no other has first: its prefix in this order
   has no shared shingle unless three quarters of the set are shared.
4. Nodes that share a shingle of their prefixes form blocks (connected by stars, never by pairs).
5. Blocks are searched in memory. A block above `block_shingles` is split: its chunks alone, then the representatives of
   the chunks' components (unless these are too many themselves, then nothing is skipped below), then what is not in the
   largest component against every chunk. Pairs that are connected already are not compared, so groups of near copies
   cost about one comparison a document.

Texts are taken in parts of a few megabytes, and the numbers of buckets and groups follow the bytes that meet in them.
Shingles are told apart by 64 bits: a collision changes an overlap by one, in fewer than one of 10**12 comparisons.

Nulls, empty and blank texts have empty sets, link with nothing and are their own component. A text with fewer words than
`size` has one shingle, its whole sequence. Repeated rows of one id are one document, linked by any of its texts, with the
size of its largest set. Extra columns are ignored. An empty table gives an empty table. Null ids are dropped.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import U64, Forest, buckets, by_bucket, components, flattened, forget, groups, joined, lean, mix, parts, shingle_sets, sized, stored

#: At most so many of the most frequent shingles get a rank of their own (16 bytes each).
RANKED = 1 << 20
#: Bytes that may meet in a bucket or group before there are more of them.
GROUP_BYTES = 128 << 20


def _needed(n: int, m: int, num: int, den: int) -> int:
    """The smallest overlap o with den * o >= num * (n + m - o)."""
    return -(-num * (n + m) // (num + den))


def _slack(n: int) -> int:
    return n // 20 + 1


_SCREENED = "bucket int, keys binary, docs binary, many binary, ids array<long>, n array<long>, live array<long>, sig array<binary>"


def _screen(size: int, num: int, den: int, n_buckets: int):
    long, binary = pa.list_(pa.int64()), pa.list_(pa.binary())

    def run(batches):
        for whole in batches:
            for batch in parts(whole):
                sets = shingle_sets(batch.column(1), size)
                ids = np.asarray(batch.column(0), np.int64)
                heads = [s[: min(len(s), len(s) - (-(-num * len(s) // den)) + _slack(len(s)))] for s in sets]
                keys = np.concatenate([np.zeros(0, U64), *heads])
                docs = np.repeat(np.arange(len(sets)), [len(h) for h in heads])
                sigs, n = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [len(s) for s in sets]
                del heads, sets
                order = np.argsort(keys, kind="stable")
                keys, docs = keys[order], docs[order]
                at = groups(keys)
                twice = np.repeat(np.diff(at), np.diff(at)) > 1
                live = np.bincount(docs[twice], minlength=len(n))
                # a hash that repeats here goes on once, marked, which tells the others that it lives
                first = np.zeros(len(keys), bool)
                first[at[:-1]] = True
                keep = ~twice | first
                dealt = list(by_bucket(keys[keep], n_buckets, ids[docs][keep], twice[keep].astype(np.uint8)))
                rows = [(-1, None, None, None), *((b, k.tobytes(), d.tobytes(), m.tobytes()) for b, k, d, m in dealt)]
                none = [None] * len(dealt)
                columns = [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))]
                columns += [pa.array([x, *none], kind) for x, kind in ((ids.tolist(), long), (n, long), (live.tolist(), long), (sigs, binary))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCREENED.split(", ")])

    return run


def _alive(t: pa.Table) -> pa.Table:
    keys, docs, many = joined(t["keys"], U64), joined(t["docs"], np.int64), joined(t["many"], np.uint8)
    order = np.argsort(keys, kind="stable")
    at = groups(keys[order])
    docs, many = docs[order], many[order].astype(bool)
    weight = np.add.reduceat(np.where(many, 2, 1), at[:-1])
    ids, n = np.unique(docs[np.repeat(weight > 1, np.diff(at)) & ~many], return_counts=True)
    return pa.table({"doc_id": ids, "live": n.astype(np.int64)})


def screened(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n) of all documents, and (doc_id, n, sig) of the texts that may have a partner; both are stored."""
    deal = stored(docs.mapInArrow(lean(_screen(size, num, den, buckets(docs.sparkSession))), _SCREENED), "ngram-deal", compression="lz4")
    info = deal.where("bucket < 0").select(F.explode(F.arrays_zip("ids", "n", "live", "sig")).alias("x")).select(F.col("x.ids").alias("doc_id"), "x.n", "x.live", "x.sig")
    more = deal.where("bucket >= 0").select("bucket", "keys", "docs", "many").groupBy("bucket").applyInArrow(lean(_alive), "doc_id long, live long")
    more = more.groupBy("doc_id").agg(F.sum("live").alias("more"))
    both = info.groupBy("doc_id", "sig").agg(F.max("n").alias("n"), F.max("live").alias("live")).join(more, "doc_id", "left")
    texts = stored(both.select("doc_id", "n", "sig", (F.col("live") + F.coalesce("more", F.lit(0))).alias("live")), "ngram-known")
    forget(deal)
    # a partner of a set of n has at least ceil(t * n) shingles, and so a slack of at least this
    may = texts.where((F.col("n") > 0) & (F.col("live") >= F.floor(F.ceil(F.col("n") * num / den) / 20) + 1))
    return texts, may.select("doc_id", "n", "sig")


def _sets(size: int):
    def run(batches):
        for whole in batches:
            for batch in parts(whole):
                sets = [s.tobytes() for s in shingle_sets(batch.column(1), size)]
                sigs = [blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["rep", "sig", "n", "shingles"])

    return run


def _repeats(batches):
    for batch in batches:
        keys, n = np.unique(joined(pa.chunked_array([batch.column(0)]), U64), return_counts=True)
        keep = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["key", "n"])


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent shingles, at most RANKED, by key; counts within batches of one are left out.

    These are told to the tasks rather than shuffled, so that none of the shuffled ones has very many documents."""
    counts = sets.select("shingles").mapInArrow(lean(_repeats), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = stored(counts.where("n >= 256"), "ngram-counts")
    steps = sorted(((r["k"], r["count"]) for r in counts.select(F.floor(F.log2("n")).alias("k")).groupBy("k").count().collect()), reverse=True)
    least, total = 64, 0
    for k, n in steps:
        if total + n > RANKED:
            break
        least, total = k, total + n
    got = counts.where(F.floor(F.log2("n")) >= least).toArrow()
    keys, n = np.asarray(got["key"], np.int64).view(U64), np.asarray(got["n"], np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


_OWN = "bucket int, kind int, keys binary, docs binary, df binary"


def _blobs(kind: int, rows) -> pa.RecordBatch:
    out = [(b, *(x.tobytes() for x in parts)) for b, *parts in rows]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([kind] * len(out), pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3))], names=["bucket", "kind", "keys", "docs", "df"])


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, sizes and all shingles of rows (node, n, shingles)."""
    return np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.int64), joined(pa.chunked_array([batch.column(2)]), U64)


def _is_hot(order, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = order
    if not len(keys):
        return np.zeros(len(s), bool), np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return keys[at] == s, counts[at]


def _deal_rare(order, n_buckets: int):
    def run(batches):
        for batch in batches:
            ids, n, s = _opened(batch)
            hot, _ = _is_hot(order.value, s)
            docs = np.repeat(ids, n)
            yield pa.RecordBatch.from_arrays(_pair(by_bucket(s[~hot], n_buckets, docs[~hot])), names=["bucket", "keys", "docs"])

    return run


def _pair(rows) -> list[pa.Array]:
    out = [(b, k.tobytes(), d.tobytes()) for b, k, d in rows]
    return [pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2))]


def _owned(docs: np.ndarray, n_buckets: int, *columns: np.ndarray):
    for b, _, d, *rest in by_bucket(mix(docs.view(U64)), n_buckets, docs, *columns):
        yield b, d, *rest


def _tell_rare(n_buckets: int):
    """To the owners of the documents: the shingles that two documents have, and how many have them."""

    def run(t: pa.Table) -> pa.Table:
        keys, docs = joined(t["keys"], U64), joined(t["docs"], np.int64)
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        at = groups(keys)
        df = np.repeat(np.diff(at), np.diff(at)).clip(max=2**31 - 1).astype(np.int32)  # for their order
        live = df > 1
        keys, docs, df = keys[live], docs[live], df[live]
        order = np.argsort(docs, kind="stable")
        return pa.Table.from_batches([_blobs(0, ((b, k, d, f) for b, d, k, f in _owned(docs[order], n_buckets, keys[order], df[order])))])

    return run


def _tell_hot(order, n_buckets: int):
    """To the owners: the documents' sizes, and which of the most frequent shingles they have."""

    def run(batches):
        for batch in batches:
            ids, n, s = _opened(batch)
            hot, df = _is_hot(order.value, s)
            yield _blobs(1, ((b, np.zeros(0, U64), d, m) for b, d, m in _owned(ids, n_buckets, n.astype(np.int32))))
            docs = np.repeat(ids, n)[hot]
            yield _blobs(0, ((b, k, d, f) for b, d, k, f in _owned(docs, n_buckets, s[hot], df[hot].clip(max=2**31 - 1).astype(np.int32))))

    return run


def _heads(num: int, den: int, n_buckets: int):
    """Of each document of an owner the rarest shingles that another document has, as far as they are in its prefix."""

    def run(t: pa.Table) -> pa.Table:
        sizes = np.asarray(t["kind"]) == 1
        info, t = t.filter(pa.array(sizes)), t.filter(pa.array(~sizes))
        ids, n = joined(info["docs"], np.int64), joined(info["df"], np.int32).astype(np.int64)
        order = np.argsort(ids)
        ids, n = ids[order], n[order]
        keys, docs, df = joined(t["keys"], U64), joined(t["docs"], np.int64), joined(t["df"], np.int32)
        doc = np.searchsorted(ids, docs)
        # what no other document has comes first in the order; the prefix has n - ceil(t * n) + 1
        room = -(-num * n // den)
        take = np.bincount(doc, minlength=len(ids)) - room + 1
        near = take[doc] > 0
        keys, doc, df = keys[near], doc[near], df[near]
        order = np.lexsort((keys, df, doc))
        keys, doc = keys[order], doc[order]
        at = groups(doc)
        rank = np.arange(len(doc)) - np.repeat(at[:-1], np.diff(at))
        keep = rank < take[doc]
        keys, doc = keys[keep], doc[keep]
        return pa.Table.from_batches([_blobs(2, by_bucket(keys, n_buckets, ids[doc], n[doc].astype(np.int32)))])

    return run


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(bucket, keys, docs, df): documents by the shared shingles in their prefixes, rarest first; df holds the documents' sizes."""
    spark = sets.sparkSession
    total = sets.agg(F.sum("n")).first()[0] or 0
    n = max(buckets(spark, 1), -(-16 * total // GROUP_BYTES))  # both ways: buckets of shingles by buckets of documents
    sets = sets.select("node", "n", "shingles")
    order = spark.sparkContext.broadcast(frequent(sets))
    rare = sets.mapInArrow(lean(_deal_rare(order, n)), "bucket int, keys binary, docs binary").groupBy("bucket").applyInArrow(lean(_tell_rare(n)), _OWN)
    told = rare.union(sets.mapInArrow(lean(_tell_hot(order, n)), _OWN))
    return told.groupBy("bucket").applyInArrow(lean(_heads(num, den, n)), _OWN).drop("kind")


def _stars(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        keys, docs, n = joined(t["keys"], U64), joined(t["docs"], np.int64), joined(t["df"], np.int32).astype(np.int64)
        order = np.lexsort((docs, n, keys))
        keys, docs, n = keys[order], docs[order], n[order]
        near = (keys[1:] == keys[:-1]) & (den * n[:-1] >= num * n[1:])  # sizes too far apart can't link, nor can those beyond
        centre = np.maximum.accumulate(np.where(np.concatenate(([True], ~near)), np.arange(len(docs)), 0)) if len(docs) else np.zeros(0, np.int64)
        keep = centre != np.arange(len(docs))
        a, b = flattened(docs[keep], docs[centre[keep]])
        return pa.table({"a": a, "b": b})

    return run


# ---------------------------------------------------------------- within a block


def longest_lists(lengths: np.ndarray, t: int) -> int:
    """How many of the longest lists are probed rather than merged: fewer than t, and fewer the longer the longest is."""
    return max(0, min(t - 1, int(t / (0.01 * math.log2(max(2, int(lengths.max()))) + 1))))


class Index:
    """Inverted lists of sorted positions, one after the other; a set is its lists' numbers, shortest list first."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        keys, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(sets)), sizes)
        self.lists = doc[np.argsort(codes, kind="stable")]
        self.begin = np.concatenate(([0], np.cumsum(counts)))
        self.codes = codes[np.lexsort((codes, counts[codes], doc))]
        self.rows = np.concatenate(([0], np.cumsum(sizes)))

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.rows[i] : self.rows[i + 1]]

    def part(self, code: int, lo: int, hi: int) -> np.ndarray:
        """Positions from lo to hi of a list."""
        x = self.lists[self.begin[code] : self.begin[code + 1]]
        return x[np.searchsorted(x, lo) : np.searchsorted(x, hi)]


def divide_skip(sets: list[np.ndarray], num: int, den: int, label: list[int] | None = None, query: list[bool] | None = None) -> list[int]:
    """Component of each set (the position of its first member) under links of Jaccard similarity >= num / den.

    label: sets of one label count as connected beforehand. query: only pairs with a query on one side are compared. Of a
    component the member with most hits is probed first, and the others only if that one doesn't link."""
    forest = Forest(len(sets))
    if label is not None:
        first: dict[int, int] = {}
        for i, x in enumerate(label):
            forest.union(i, first.setdefault(x, i))
    if not sets:
        return []
    turn = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    sizes = np.array([len(sets[i]) for i in turn], np.int64)
    index = Index([sets[i] for i in turn])
    at = np.array(turn)
    root = np.array([forest.find(i) for i in turn])
    for i, n in enumerate(sizes.tolist()):
        if not n or (query is not None and not query[turn[i]]):
            continue
        # sizes from t * n on; without queries each set asks those before it, which are no larger
        t = -(-num * n // den)
        lo = int(np.searchsorted(sizes, t))
        hi = i if query is None else int(np.searchsorted(sizes, den * n // num, side="right"))
        codes = index.of(i)
        skipped = longest_lists(index.begin[codes + 1] - index.begin[codes], t)
        short, long = codes[: n - skipped].tolist(), codes[n - skipped :].tolist()
        merged = np.concatenate([index.part(c, lo, hi) for c in short]) if short else np.zeros(0, np.int64)
        merged = merged[root[merged] != root[i]]
        if not len(merged):
            continue
        found, hits = np.unique(merged, return_counts=True)
        # a partner of m shingles shares `need` of them, of which at most `skipped` are in the long lists
        need = -(-num * (n + sizes[found]) // (num + den))
        keep = hits >= np.maximum(1, need - skipped)
        found, hits, need = found[keep], hits[keep], need[keep]
        order = np.lexsort((found, -hits, root[found]))
        found, hits, need = found[order], hits[order], need[order]
        head = np.ones(len(found), bool)
        head[1:] = root[found[1:]] != root[found[:-1]]
        for now in (head, ~head):
            now = now & (root[found] != root[i])
            some, total = found[now], hits[now].copy()
            if not len(some):
                continue
            for c in long:
                x = index.lists[index.begin[c] : index.begin[c + 1]]
                total += x[np.minimum(np.searchsorted(x, some), len(x) - 1)] == some
            for j in some[total >= need[now]].tolist():
                a, b = int(root[i]), int(root[j])
                if a != b:
                    forest.union(at[i], at[j])
                    root[(root == a) | (root == b)] = min(a, b)
    return [int(forest.find(i)) for i in range(len(sets))]


def _join_groups(num: int, den: int):
    """Of each part in a group: edges (a, b) from a document to one of its component."""

    def run(t: pa.Table) -> pa.Table:
        part = np.asarray(t["part"], np.int64)
        order = np.lexsort((np.asarray(t["node"], np.int64), part))
        t, part = t.take(pa.array(order)), part[order]
        at = groups(part)
        rep = np.asarray(t["rep"], np.int64)
        labels, queries = np.asarray(t["label"], np.int64), np.asarray(t["query"])
        column = t["shingles"].combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), U64) for x in column]
        a, b = [], []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            ask = queries[lo:hi].tolist()
            # a node that comes both as member and as query is one, by its label
            root = np.array(divide_skip(sets[lo:hi], num, den, labels[lo:hi].tolist(), ask if not all(ask) else None))
            x, y = rep[lo:hi], rep[lo:hi][root]
            a.append(x[x != y])
            b.append(y[x != y])
        return pa.table({"a": np.concatenate([np.zeros(0, np.int64), *a]), "b": np.concatenate([np.zeros(0, np.int64), *b])})

    return run


def _run(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows: grp, part, node, rep, shingles, label, query."""
    return rows.groupBy("grp").applyInArrow(lean(_join_groups(num, den)), "a long, b long")


def block_links(sets: DataFrame, num: int, den: int, block_shingles: int) -> DataFrame:
    """Edges (a, b) between documents with the same components as all links within blocks; sets: node, rep, n, shingles, block."""
    spark = sets.sparkSession
    sizes = stored(sets.groupBy("block").agg(F.sum("n").alias("total")), "ngram-sizes")
    facts = sizes.agg(F.sum("total"), F.max("total")).first()
    sets = sets.join(sized(sizes), "block")
    plain = dict(label=F.col("node"), query=F.lit(True))
    n_groups = max(buckets(spark), -(-8 * (facts[0] or 0) // GROUP_BYTES))
    row = ["node", "rep", "shingles", "label", "query"]
    small = sets.where(F.col("total") <= block_shingles).withColumns(plain).select(F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("string").alias("grp"), F.col("block").alias("part"), *row)
    links = _run(small, num, den)
    if (facts[1] or 0) <= block_shingles:
        return links
    cut = lambda c: F.pmod(F.xxhash64("node"), F.ceil(F.col(c) / block_shingles))
    whole = F.lit(0).cast("long").alias("part")
    large = sets.where(F.col("total") > block_shingles).withColumn("chunk", cut("total"))
    alone = large.withColumns(plain).select(F.concat_ws(":", "block", "chunk").alias("grp"), whole, *row)
    inner = stored(_run(alone, num, den), "ngram-inner")
    # an edge leads from a document to its component's first; the others stand for their components
    heads = large.join(sized(stored(inner.select(F.col("a").alias("rep")).distinct(), "ngram-inner")), "rep", "left_anti")
    count = stored(heads.groupBy("block").agg(F.sum("n").alias("heads")), "ngram-heads").where(F.col("heads") <= block_shingles)
    top = heads.join(sized(count), "block").withColumns(plain).select(F.concat_ws(":", "block", F.lit("h")).alias("grp"), whole, *row)
    inner = stored(inner.union(_run(top, num, den)), "ngram-inner")
    label = stored(components(inner, "ngram-label").toDF("rep", "label"), "ngram-label")
    large = large.select("block", "chunk", "total", "node", "rep", "n", "shingles").join(sized(label), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    by = stored(large.groupBy("block", "label").agg(F.sum("n").alias("w")), "ngram-by")
    best = stored(by.groupBy("block").agg(F.max_by("label", F.struct("w", "label")).alias("most"), F.sum("w").alias("all"), F.max("w").alias("w")).where("all > w"), "ngram-best")
    large = large.join(sized(best), "block")
    asked = F.ceil((F.col("all") - F.col("w")) / block_shingles)
    held = large.select("block", "chunk", "node", "rep", "shingles", "label", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), asked - 1)).alias("ask"))
    rest = large.where("label != most").withColumn("ask", F.pmod(F.xxhash64("node", F.lit(1)), asked)).select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / block_shingles) - 1)).alias("chunk"), "node", "rep", "shingles", "label", F.lit(True).alias("query"), "ask")
    cross = held.unionByName(rest).select(F.concat_ws(":", "block", "chunk", "ask", F.lit("x")).alias("grp"), whole, *row)
    return links.union(inner).union(_run(cross, num, den))


def ngram_join(documents: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id): see the module's text. percent: the least Jaccard similarity, in hundredths."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    num, den = percent, 100
    known, may = screened(docs, size, num, den)
    # stored, so that both sides of the join are plain exchanges, of which Spark splits a hot signature's
    nodes = stored(may.groupBy("sig").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")
    twins = stored(may.join(sized(nodes), "sig").where("doc_id != rep").select("doc_id", "rep"), "ngram-twins")
    reps = stored(nodes.select(F.col("rep").alias("doc_id")).distinct(), "ngram-reps")
    sets = docs.join(sized(reps), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lean(_sets(size)), "rep long, sig binary, n long, shingles binary")
    sets = stored(sets.join(sized(nodes), ["sig", "rep"]).dropDuplicates(["sig", "rep"]).select("node", "rep", "n", "shingles"), "ngram-sets")
    forget(reps)
    stars = prefixes(sets, num, den).groupBy("bucket").applyInArrow(lean(_stars(num, den)), "a long, b long")
    blocks = stored(components(stars, "ngram-blocks").toDF("node", "block"), "ngram-blocks")
    links = block_links(sets.join(sized(blocks), "node"), num, den, block_shingles)
    found = components(links.union(twins), "ngram-found").toDF("doc_id", "component")
    forget(sets, nodes, blocks, twins)
    known = known.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    return known.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
