"""Ranked lexical search by block-max pruning.

1. `totals`: the number of documents with terms and of all terms, from the texts.
2. `build`: each part of the texts is put in an order in which documents alike are neighbours, and cut into blocks of ranges of
   it (`block_docs` documents, or fewer if they hold many terms). A block is
   a row of the forward index: its documents, and for each of its terms the documents that hold it with their counts, and
   the largest impact of the term in the block. The index is written to the cluster's shared folder.
3. `search`: of the queries' terms alone, the document frequencies are summed over the blocks. A block's bound for a query is
   the sum of the weights times the largest impacts. Of each query the blocks with the highest bounds are scored first: the
   k-th best of their documents is a threshold. Then every task takes its blocks in the order of their bounds, scores
   them while the bound reaches the threshold, which its own k best raise, and tells those; the best k of all are the result.
   Blocks below the threshold are left unread: they can't hold any of the result, which is exact.

Scores are integers: a term's weight times its impact (tf and length), summed over the query's terms with repeats; see `impacts`
and `weights`. Terms are told apart by 64 bits of hash.

Queries are taken in groups whose terms are counted before they are sent to the tasks (`GROUP_TERMS`); each group reads the
index once. Nothing of the documents is sent to the driver but one threshold a query and the frequencies of its terms.

Terms are the maximal matches of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with ASCII letters in lower case. Null texts have none; a document
or query without terms is never found and finds nothing. Rows without an id are no documents or queries. Each row of a
repeated doc_id is a document; the rows of a repeated item_id with different texts are one query with the terms of all. Extra
columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm._common import forget, groups, lean, lower_ascii, parts, spans, stored, text_buffer, word_hashes

#: Terms of queries (with repeats) that are sent to the tasks at once, about.
GROUP_TERMS = 200_000
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a string column, as signed numbers, and each row's offsets in them."""
    buf, offs = text_buffer(col)
    starts, ends, rows = spans(buf, offs, _GAPS)
    return word_hashes(lower_ascii(buf), starts, ends).view(np.int64), rows


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What `tf` occurrences in a document of `n` terms count, of `docs` documents with `terms` terms."""
    m = 75 + (25 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _documents(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")


def totals(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms with repeats."""

    def run(batches):
        docs = terms = 0
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            n = np.diff(spans(buf, offs, _GAPS)[2])
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        yield pa.record_batch([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])

    told = _documents(documents, id_col, text_col).select("text").mapInArrow(lean(run), "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return told[0] or 0, told[1] or 0


_BLOCK = "block long, docs binary, terms binary, holders binary, tops binary, at binary, tf binary, m binary"
_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def _alike(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """An order of documents in which those with the same most frequent term are neighbours, by their lengths: blocks of such have lower bounds."""
    n = np.diff(rows)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    at = np.flatnonzero(new)
    term, own, tf = hashes[order[at]], doc[order[at]], np.diff(np.append(at, len(order)))
    best = np.lexsort((term, tf, own))
    top = np.zeros(len(n), np.int64)
    top[own[best]] = term[best]  # the last of a document is the most frequent one
    return np.lexsort((n, top))


def _blocks(batch: pa.RecordBatch, docs: int, terms: int, block_docs: int, block_terms: int) -> Iterator[tuple]:
    """The blocks of some documents: ids; terms, how many documents hold each and its largest impact; those documents and the counts; lengths as m."""
    ids = np.asarray(batch.column(0), np.int64)
    hashes, rows = _terms(batch.column(1))
    n = np.diff(rows)
    alike = _alike(hashes, rows)
    ids, n = ids[alike], n[alike]
    hashes = hashes[np.repeat(rows[alike] - (np.cumsum(n) - n), n) + np.arange(len(hashes))]
    rows = np.append(0, np.cumsum(n))
    a = 0
    while a < len(ids):
        b = min(a + block_docs, max(a + 1, int(np.searchsorted(rows, rows[a] + block_terms, side="right")) - 1), len(ids))
        own = hashes[rows[a] : rows[b]]
        if len(own):
            doc = np.repeat(np.arange(b - a), n[a:b])
            order = np.lexsort((doc, own))
            term, doc = own[order], doc[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
            cut = np.append(np.flatnonzero(new), len(term))
            term, doc, tf = term[new], doc[new], np.diff(cut)
            m = 75 + (25 * n[a:b] * docs) // terms
            worth = impacts(tf, n[a:b][doc], docs, terms)
            cut = groups(term)
            yield ids[a:b], term[cut[:-1]], np.diff(cut).astype(np.uint16), np.maximum.reduceat(worth, cut[:-1]).astype(np.int32), doc.astype(np.uint16), tf.astype(np.int32), m
        a = b


def build(documents: DataFrame, stats: tuple[int, int], block_docs: int = 8, block_terms: int = 1 << 18, part: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The forward index, written to the shared folder. Documents without terms are left out."""
    if not 0 < block_docs < 1 << 16:
        raise ValueError("a block has at most 65,535 documents")

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in parts(batch, size=part):
                rows = []
                for x in _blocks(some, *stats, block_docs, block_terms):
                    rows.append((number, *(y.tobytes() for y in x)))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if not k else pa.binary()) for k in range(len(_NAMES))], names=_NAMES)

    return stored(_documents(documents, id_col, text_col).mapInArrow(lean(run), _BLOCK), "ranked-index", compression="zstd")


class Queries:
    """A group of queries: for each entry (query, term) how often the query has the term; sent to the tasks."""

    def __init__(self, items: np.ndarray, terms: np.ndarray):
        self.items, query = np.unique(items, return_inverse=True)
        self.terms, term = np.unique(terms, return_inverse=True)
        pair, self.times = np.unique(query.reshape(-1) * len(self.terms) + term.reshape(-1), return_counts=True)
        self.query, self.term = pair // len(self.terms), pair % len(self.terms)
        self.begin = np.searchsorted(self.query, np.arange(len(self.items)))
        self.worth: np.ndarray | None = None

    def weigh(self, df: np.ndarray, docs: int) -> None:
        """worth: the weight of each entry, with repeats."""
        self.worth = weights(df, docs)[self.term] * self.times

    def places(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of our terms that a block has, and their places there."""
        mine = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
        at = np.flatnonzero(self.terms[mine] == own)
        return mine[at], at

    def bounds(self, own: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """No document of the block scores higher."""
        top = np.zeros(len(self.terms), np.int64)
        mine, at = self.places(own)
        top[mine] = tops[at]
        return np.add.reduceat(self.worth * top[self.term], self.begin)


def _column(batch: pa.RecordBatch, name: str, i: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


class _Postings:
    """A block's documents and postings, read once however many queries score it."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.docs, self.terms = _column(batch, "docs", i, np.int64), _column(batch, "terms", i, np.int64)
        self.cut = np.concatenate(([0], np.cumsum(_column(batch, "holders", i, np.uint16), dtype=np.int64)))
        self.at, tf = _column(batch, "at", i, np.uint16), _column(batch, "tf", i, np.int32).astype(np.int64)
        self.worth = (1_000_000_000 * tf) // (1000 * tf + 12 * _column(batch, "m", i, np.int64)[self.at])

    def scores(self, q: Queries, query: int) -> np.ndarray:
        """Of each document of the block."""
        entry = slice(q.begin[query], q.begin[query + 1] if query + 1 < len(q.begin) else len(q.term))
        term, worth = q.terms[q.term[entry]], q.worth[entry]
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        ok = self.terms[at] == term
        first, n = self.cut[at[ok]], self.cut[at[ok] + 1] - self.cut[at[ok]]
        own = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.zeros(len(self.docs), np.int64)
        np.add.at(out, self.at[own], np.repeat(worth[ok], n) * self.worth[own])
        return out


class _Best:
    """The k best documents of each query that a task has seen; ties go to the smaller id."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.scores, self.docs = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.least = np.maximum(least, 1)  # scores of 0 are no result

    def add(self, query: int, scores: np.ndarray, docs: np.ndarray) -> None:
        ok = scores >= self.least[query]
        if ok.any():
            s, d = np.append(self.scores[query], scores[ok]), np.append(self.docs[query], docs[ok])
            first = np.lexsort((d, -s))[: self.k]
            self.scores[query], self.docs[query] = s[first], d[first]
            if len(first) == self.k:
                self.least[query] = max(self.least[query], int(s[first[-1]]))

    def rows(self, q: Queries) -> pa.RecordBatch:
        n = [len(x) for x in self.docs]
        return pa.record_batch([pa.array(np.repeat(q.items, n)), pa.array(np.concatenate(self.docs)), pa.array(np.concatenate(self.scores))], names=["item_id", "doc_id", "score"])


def _first_k(found: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best of each query; those of each part first, so that no key gathers all."""
    best = lambda w: F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))
    part = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    part = part.withColumn("rank", best(Window.partitionBy("item_id", "part"))).where(F.col("rank") <= k)
    return part.withColumn("rank", best(Window.partitionBy("item_id"))).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for some in parts(batch):
                terms, rows = _terms(some.column(1))
                yield pa.record_batch([pa.array(np.repeat(np.asarray(some.column(0), np.int64), np.diff(rows))), pa.array(terms)], names=["item_id", "term"])

    items = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    return stored(items.mapInArrow(lean(run), "item_id long, term long"), "ranked-queries")


def _frequencies(index: DataFrame, q: Queries) -> np.ndarray:
    """In how many documents each of the queries' terms occurs; each task sums up its blocks first."""

    def run(batches):
        df = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                mine, at = q.places(_column(batch, "terms", i, np.int64))
                df[mine] += _column(batch, "holders", i, np.uint16)[at]
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(len(q.terms), np.int64)
    for term, df in index.select("terms", "holders").mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def _seeds(index: DataFrame, q: Queries, first: int) -> dict[int, list[int]]:
    """For each block that is among the `first` with the highest bounds of some query those queries."""

    def run(batches):
        number, bound = [np.zeros(0, np.int64)] * len(q.items), [np.zeros(0, np.int64)] * len(q.items)
        for batch in (b for b in batches if b.num_rows):
            blocks = np.asarray(batch.column(0), np.int64)
            all_ = np.stack([q.bounds(_column(batch, "terms", i, np.int64), _column(batch, "tops", i, np.int32)) for i in range(batch.num_rows)], axis=1)
            for query in np.flatnonzero(all_.max(axis=1) > 0).tolist():
                b, x = np.append(bound[query], all_[query]), np.append(number[query], blocks)
                best = np.lexsort((x, -b))[:first]
                bound[query], number[query] = b[best], x[best]
        n = [len(x) for x in number]
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(np.concatenate(number)), pa.array(np.concatenate(bound))], names=["item_id", "doc_id", "score"])

    out: dict[int, list[int]] = {}
    for query, block in _first_k(index.select("block", "terms", "tops").mapInArrow(lean(run), "item_id long, doc_id long, score long").where("score > 0"), first).select("item_id", "doc_id").collect():
        out.setdefault(block, []).append(query)
    return out


def _scored(index: DataFrame, q: Queries, k: int, least: np.ndarray, only: dict[int, list[int]] | None = None) -> DataFrame:
    """(item_id, doc_id, score) of each task's k best documents, from the blocks whose bounds reach what is asked for; only: of these blocks for these queries."""

    def run(batches):
        best = _Best(len(q.items), k, least)
        for batch in (b for b in batches if b.num_rows):
            if only is not None:
                todo = [(i, query) for i, block in enumerate(batch.column("block").to_pylist()) for query in only.get(block, [])]
                bound = None
            else:
                bound = np.stack([q.bounds(_column(batch, "terms", i, np.int64), _column(batch, "tops", i, np.int32)) for i in range(batch.num_rows)])
                block, query = np.nonzero(bound >= best.least)
                order = np.argsort(-bound[block, query], kind="stable")
                todo = list(zip(block[order].tolist(), query[order].tolist()))
            opened: dict[int, _Postings] = {}
            for i, query in todo:
                if bound is not None and bound[i, query] < best.least[query]:
                    continue
                if i not in opened:
                    opened[i] = _Postings(batch, i)
                best.add(query, opened[i].scores(q, query), opened[i].docs)
        yield best.rows(q)

    if only is not None:  # no more blocks than the queries of a group times `first`
        index = index.join(F.broadcast(index.sparkSession.createDataFrame([(x,) for x in only], "block long")), "block", "left_semi")
    return index.mapInArrow(lean(run), "item_id long, doc_id long, score long")


def search(index: DataFrame, stats: tuple[int, int], queries: DataFrame, k: int = 20, first: int = 32, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each query the k documents with the highest scores above 0, equal ones by ascending doc_id."""
    entries = _query_terms(queries, id_col, text_col)
    n = entries.count()
    found = None
    for group in range(-(-n // GROUP_TERMS)):
        own = entries.where(F.pmod(F.xxhash64("item_id"), F.lit(-(-n // GROUP_TERMS))) == group).toArrow()
        if not own.num_rows:
            continue
        q = Queries(np.asarray(own["item_id"], np.int64), np.asarray(own["term"], np.int64))
        q.weigh(_frequencies(index, q), stats[0])
        least = np.zeros(len(q.items), np.int64)
        if seeds := _seeds(index, q, first):
            names = {x: i for i, x in enumerate(q.items.tolist())}
            scores = _first_k(_scored(index, q, k, least, seeds), k).where(F.col("rank") == k)
            for item, score in scores.select("item_id", "score").collect():
                least[names[item]] = score
        more = stored(_first_k(_scored(index, q, k, least), k), "ranked-found")
        found = more if found is None else found.unionByName(more)
    forget(entries)
    return found if found is not None else index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def ranked_search(documents: DataFrame, queries: DataFrame, k: int = 20, block_docs: int = 8, first: int = 32) -> DataFrame:
    """Index all documents and search them for all queries."""
    stats = totals(documents)
    index = build(documents, stats, block_docs)
    out = search(index, stats, queries, k, first)
    forget(index)
    return out
