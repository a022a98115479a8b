"""Language-model scoring by deleted interpolation of trigram, bigram, unigram and uniform estimates.

The probability of a token w after (t, u) is l3 * c(t, u, w) / c(t, u) + l2 * c(u, w) / c(u) + l1 * c(w) / N + l0 / (V + 1), with
weights of their own for each bucket of context frequency (powers of two of c(t, u), or of c(u) where (t, u) is new). The weights
come from expectation-maximisation on held-out counts: each training token is held out in turn by taking itself off its
counts. What enters is a histogram over (bucket, quantised estimates), of a bounded size whatever the corpus is. The first
token of a text has no trigram.

Counts are exact and of the whole training set. Texts become chunks of word numbers, stored once. Each chunk asks for the
counts of its distinct words and bigrams by 64-bit hash: the requests, with the chunk's own counts added up, meet by
bucket, and each gets the totals back in its own order. Then it asks for its trigrams, but for those of which one of the two
bigrams occurs in no other chunk: their counts are its own. So what moves is one entry per chunk and distinct n-gram, a
very common one costs no more than that, and no task or driver holds a table of all. Counts travel as bytes, with what
doesn't fit in one behind; totals have 64 bits.

Tokens: words [^\\x20\\x09-\\x0D]+ with ASCII letters in lower case, then one end. Before the first word stands an end, too.
Null and empty texts are an end alone. Repeated rows are documents of their own; rows without an id are dropped; extra
columns are ignored. An empty table gives an empty table; without training rows all counts are 0.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import U64, buckets, by_bucket, forget, hashed, lean, mix, parts, release, stored, text_buffer

END = U64(0x5851F42D4C957F2D)
PART_BYTES = 3 << 20
_REQUEST = "chunk string, kind int, bucket int, keys binary, counts binary"
_CHUNK = "chunk string, ids binary, lens binary, learn binary, words binary, tokens binary"
#: Estimates are quantised to so many steps per factor of two for the weights.
FINE, STEPS, CLASSES = 2, 64, 24
#: Bytes of requests that may meet in a bucket before there are more of them.
GROUP_BYTES = 128 << 20


def packed(counts: np.ndarray) -> bytes:
    """A byte for each count; those from 255 on follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(U64).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, offset=n)
    return out


def _chunks(held_out: Callable[[int], bool]):
    def run(batches):
        for whole in batches:
            for batch in parts(whole, size=PART_BYTES):
                ids = np.asarray(batch.column(0), np.int64)
                h, rows = hashed(batch.column(1), lower=True)
                n = np.diff(rows) + 1
                tokens = np.full(len(h) + len(ids), END, U64)
                tokens[np.arange(len(h)) + np.repeat(np.arange(len(ids)), n - 1)] = h
                codes, words = pd.factorize(tokens)
                learn = np.array([not held_out(i) for i in ids.tolist()], np.uint8)
                blobs = [x.tobytes() for x in (ids, n.astype(np.int64), learn, words)] + [zstandard.compress(codes.astype(np.uint32).tobytes(), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([x], pa.binary()) for x in blobs)], names=[x.split()[0] for x in _CHUNK.split(", ")])

    return run


def _each(batch: pa.RecordBatch):
    """Its rows, of which one at a time is in memory as Python values."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class Chunk:
    """A chunk's rows, and its distinct words and bigrams, and trigrams once they are asked for."""

    def __init__(self, row: dict):
        get = lambda k, kind: np.frombuffer(row[k], kind)
        self.ids, self.lens, self.learn = get("ids", np.int64), get("lens", np.int64), get("learn", np.uint8)
        self.words, self.tokens = get("words", U64), np.frombuffer(zstandard.decompress(row["tokens"]), np.uint32).astype(np.int64)
        self.rows = np.concatenate(([0], np.cumsum(self.lens)))
        self.learned = np.repeat(self.learn, self.lens).astype(bool)
        end = np.flatnonzero(self.words == END)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.rows[:-1]] = end[0] if len(end) else 0
        self.before = before
        self.pair_codes, pairs = pd.factorize(before * len(self.words) + self.tokens)
        self.pairs = mix(self.words[pairs // len(self.words)] * U64(0x9FB21C651E98DF25) + self.words[pairs % len(self.words)])

    def own(self, codes: np.ndarray, n: int, learned: np.ndarray | None = None) -> np.ndarray:
        """Counts of n-grams in its training rows."""
        return np.bincount(codes[self.learned if learned is None else learned], minlength=n)

    def triples(self, pairs: np.ndarray) -> np.ndarray:
        """Trigrams of the tokens that aren't first in their row; `pairs` has the bigrams' totals. Sets third (the positions), triple_codes
        and triple_own, and `ask`: which of the trigrams another chunk may have. Returns their hashes."""
        third = np.ones(len(self.tokens), bool)
        third[self.rows[:-1]] = False
        self.third = np.flatnonzero(third)
        first, last = self.pair_codes[self.third - 1], self.pair_codes[self.third]
        self.triple_codes, found = pd.factorize(first * len(self.words) + self.tokens[self.third])
        where = np.empty(len(found), np.int64)
        where[self.triple_codes] = np.arange(len(self.third))
        self.triple_own = self.own(self.triple_codes, len(found), self.learned[self.third])
        shared = pairs > self.own(self.pair_codes, len(self.pairs))
        self.ask = shared[first[where]] & shared[last[where]]
        return mix(self.pairs[first[where]] * U64(0xD1B54A32D192ED03) + self.words[self.tokens[self.third[where]]])


def _requests(chunk: str, asked, n_buckets: int) -> pa.RecordBatch:
    """asked: kind, keys and the chunk's own counts."""
    out = [(kind, b, k.tobytes(), packed(n)) for kind, keys, counts in asked for b, k, n in by_bucket(keys, n_buckets, counts)]
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.string()), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary())))], names=["chunk", "kind", "bucket", "keys", "counts"])


def _ask(n_buckets: int):
    """For words and bigrams."""

    def run(batches):
        for batch in batches:
            for row in _each(batch):
                c = Chunk(row)
                yield _requests(row["chunk"], ((0, c.words, c.own(c.tokens, len(c.words))), (1, c.pairs, c.own(c.pair_codes, len(c.pairs)))), n_buckets)

    return run


def _ask_triples(n_buckets: int):
    def run(batches):
        for batch in batches:
            for row in _each(batch):
                c = Chunk(row)
                keys = c.triples(_totals(row, 1, c.pairs, n_buckets))
                yield _requests(row["chunk"], ((2, keys[c.ask], c.triple_own[c.ask]),), n_buckets)

    return run


def _add(t: pa.Table) -> pa.Table:
    """Totals for each request of a bucket, in its order, with how many distinct learned keys and tokens the bucket has."""
    kb, ko = text_buffer(t["keys"])
    keys = np.frombuffer(kb.tobytes(), U64)
    cut = (ko // 8).tolist()
    codes, unique = pd.factorize(keys)
    total = np.zeros(len(unique), np.int64)
    for x, a, b in zip(t["counts"], cut[:-1], cut[1:]):
        np.add.at(total, codes[a:b], unpacked(x.as_py(), b - a))
    seen, sums = [0] * t.num_rows, [0] * t.num_rows
    seen[0], sums[0] = int((total > 0).sum()), int(total.sum())
    blobs = [packed(total[codes[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
    return pa.table({"chunk": t["chunk"], "kind": t["kind"], "bucket": t["bucket"], "totals": pa.array(blobs, pa.binary()), "distinct": pa.array(seen, pa.int64()), "sum": pa.array(sums, pa.int64())})


def _totals(row: dict, kind: int, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The answers to a chunk's requests of a kind, for its keys."""
    total = np.zeros(len(keys), np.int64)
    got = {x["bucket"]: x["totals"] for x in row["answers"] if x["kind"] == kind}
    for b, _, at in by_bucket(keys, n_buckets, np.arange(len(keys))):
        total[at] = unpacked(got[b], len(at))
    return total


class Counted(Chunk):
    """A chunk with, of each token: its context's count, the bigram's, that of the bigram before it and the trigram's."""

    def __init__(self, row: dict, n_buckets: int):
        super().__init__(row)
        self.total = _totals(row, 0, self.words, n_buckets)
        pairs = _totals(row, 1, self.pairs, n_buckets)
        keys = self.triples(pairs)
        triples = self.triple_own.copy()
        triples[self.ask] = _totals(row, 2, keys[self.ask], n_buckets)
        self.one, self.context, self.two = self.total[self.tokens], self.total[self.before], pairs[self.pair_codes]
        self.context2, self.three = np.zeros_like(self.tokens), np.zeros_like(self.tokens)
        self.context2[self.third], self.three[self.third] = self.two[self.third - 1], triples[self.triple_codes]

    def estimates(self, at, off: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The bucket of the context, and the trigram, bigram and unigram estimates, with `off` taken off all counts."""
        one, context, two = self.one[at] - off, self.context[at] - off, self.two[at] - off
        context2, three = np.maximum(self.context2[at] - off, 0), np.maximum(self.three[at] - off, 0)
        bucket = np.where(context2 > 0, CLASSES + _class(context2), _class(context))
        return bucket, [three / np.maximum(context2, 1), two / np.maximum(context, 1), one / max(n - off, 1)]


def _class(c: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency."""
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), CLASSES - 1).astype(np.int64)


def _step(p: np.ndarray) -> np.ndarray:
    """Quantised -log2 p; the last step is for 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-FINE * np.log2(np.maximum(p, 1e-300))), STEPS - 2), STEPS - 1).astype(np.int64)


def _histogram(n_buckets: int, n: int):
    def run(batches):
        for batch in batches:
            for row in _each(batch):
                c = Counted(row, n_buckets)
                key, estimates = c.estimates(c.learned, 1, n)  # each token off its own counts
                for p in estimates:
                    key = key * STEPS + _step(p)
                key, m = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(m.astype(np.int64))], names=["key", "m"])

    return run


def learned_weights(keys: np.ndarray, m: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """Rows of (trigram, bigram, unigram, uniform) weights by bucket, by expectation-maximisation over the histogram."""
    value = lambda s: np.where(s == STEPS - 1, 0.0, 2.0 ** (-s / FINE))
    cls, steps = keys // STEPS**3, [value(keys // STEPS**k % STEPS) for k in (2, 1, 0)]
    p = np.stack((*steps, np.full(len(keys), 1 / (v + 1))), axis=1)
    w = np.tile(np.array([0.3, 0.3, 0.3, 0.1]), (2 * CLASSES, 1))
    w[:CLASSES, 0] = w[0, 1] = 0  # no context, no estimate
    w /= w.sum(axis=1, keepdims=True)
    least = 1e-3 * (w > 0)
    for _ in range(rounds):
        post = p * w[cls]
        post *= (m / np.maximum(post.sum(axis=1), 1e-300))[:, None]
        w = np.stack([np.bincount(cls, post[:, k], minlength=2 * CLASSES) for k in range(4)], axis=1) + least
        w /= w.sum(axis=1, keepdims=True)
    return w


def _told(asked: DataFrame, name: str) -> DataFrame:
    told = asked.groupBy("kind", "bucket").applyInArrow(lean(_add), "chunk string, kind int, bucket int, totals binary, distinct long, sum long")
    return stored(told, name, compression="zstd")


def _with_answers(chunks: DataFrame, told: DataFrame) -> DataFrame:
    """Made anew for each use rather than stored: it is as large as both tables."""
    return chunks.join(told.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "totals")).alias("answers")), "chunk")


_SCORE = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(n_buckets: int, n: int, v: int, weights: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in _each(batch):
                c = Counted(row, n_buckets)
                base = np.log10((c.total + 0.5) / (n + 0.5 * (v + 1)))[c.tokens]
                bucket, estimates = c.estimates(slice(None), 0, n)
                w = weights[bucket]
                p = w[:, 3] / (v + 1)
                for k, x in enumerate(estimates):
                    p += w[:, k] * x
                cut = c.rows[:-1]
                out = [c.ids, c.learn.astype(bool), c.lens, np.add.reduceat((c.one > 0).astype(np.int64), cut), np.add.reduceat(base, cut), np.add.reduceat(np.log10(p), cut)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[x.split()[0] for x in _SCORE.split(", ")])

    return run


def score(documents: DataFrame, held_out: Callable[[int], bool], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); held_out says by id which rows not to learn from."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    chunks = stored(docs.mapInArrow(lean(_chunks(held_out)), _CHUNK), "lm-chunks")
    requests = chunks.agg(F.sum(F.octet_length("words") + F.octet_length("tokens") * 4)).first()[0] or 0
    n_buckets = max(buckets(spark), -(-requests // GROUP_BYTES))
    told = _told(chunks.mapInArrow(lean(_ask(n_buckets)), _REQUEST), "lm-told")
    release(spark)
    facts = told.where("kind = 0").agg(F.sum("distinct"), F.sum("sum")).first()
    v, n = int(facts[0] or 0), int(facts[1] or 0)
    more = _told(_with_answers(chunks, told.where("kind = 1")).mapInArrow(lean(_ask_triples(n_buckets)), _REQUEST), "lm-told")
    release(spark)
    both = _with_answers(chunks, told.union(more))
    found = stored(both.mapInArrow(lean(_histogram(n_buckets, n)), "key long, m long").groupBy("key").agg(F.sum("m").alias("m")), "lm-histogram")
    rows = found.toArrow()
    forget(found)
    release(spark)
    weights = learned_weights(np.asarray(rows["key"], np.int64), np.asarray(rows["m"], np.float64), v)
    out = both.mapInArrow(lean(_scores(n_buckets, n, v, weights)), _SCORE)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def crc_fold(mod: int, held: int) -> Callable[[int], bool]:
    """Holds out the ids whose crc32 as text, modulo mod, is `held`."""
    return lambda i: zlib.crc32(str(i).encode()) % mod == held
