"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, modulo 2**bits, of its words (runs of letters and digits, ASCII letters in lower
case), pairs of neighbours, and pairs with one word between. The fit goes over at most `sample` labelled rows, those with the
least hash of their id, a bounded number whatever the table's size; it runs in one task, with a learning rate for each
coordinate and L1 regularisation, and gives a sparse list of weights, which is what is broadcast. Scoring takes every text.

Null and empty texts score the bias alone. Labels of an id that are not the same count as the greatest; null labels and ids are
left out; without any label every score is 0.5. Repeated rows are scored each. Extra columns stay
unused. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import U64, lean, lower_ascii, mix, spans, text_buffer, word_hashes

_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[65:91] = _GAPS[97:123] = _GAPS[128:] = False
PART_BYTES = 2 << 20


def features(col: pa.Array, bits: int):
    """For parts of a column: its rows' range, hashed features, and the row of each."""
    buf, offs = text_buffer(col)
    row = 0
    while row < len(offs) - 1:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + PART_BYTES, side="right")) - 1)
        part = lower_ascii(buf[offs[row] : offs[to]])
        starts, ends, rows = spans(part, offs[row : to + 1] - offs[row], _GAPS)
        h = word_hashes(part, starts, ends)
        doc = np.repeat(np.arange(to - row), np.diff(rows))
        found, own = [h], [doc]
        for gap, salt in ((1, 0x8CB92BA72F3D8DD7), (2, 0xAAAAAAAAAAAAAAAB)):
            if len(h) > gap:
                same = doc[gap:] == doc[:-gap]
                found.append(mix(h[:-gap] * U64(salt) + h[gap:])[same])
                own.append(doc[gap:][same])
        yield row, to, (np.concatenate(found) >> U64(64 - bits)).astype(np.int64), np.concatenate(own)
        row = to


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al., 2013) for log loss over binary features; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def _fit(bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float):
    def run(batches):
        rows: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, found, doc in features(batch.column(1), bits):
                order = np.argsort(doc, kind="stable")
                at = np.searchsorted(doc[order], np.arange(b - a + 1))
                for i in range(b - a):
                    rows.append((ids[a + i], labels[a + i], np.unique(found[order[at[i] : at[i + 1]]]).astype(np.int32)))
        rows.sort(key=lambda r: (mix(np.array([r[0]], np.int64).view(U64))[0], r[0]))
        model = Ftrl(1 << bits, alpha, beta, l1, l2)
        for _ in range(epochs):
            for _, label, at in rows:
                model.learn(at, label)
        w = model.weights(np.arange((1 << bits) + 1))
        at = np.append(np.flatnonzero(w[:-1]), 1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["feature", "weight"])

    return run


def fit(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = 16_000, bits: int = 20, epochs: int = 4, alpha: float = 0.6, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and weights (the bias last) learned from the rows of labels for which `learn` holds.

    sample bounds the rows of the fit. Without any, the bias alone is left, at 0: every score is 0.5 then."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")  # at most `sample` rows of 12 bytes
    out = rows.repartition(1).mapInArrow(lean(_fit(bits, epochs, alpha, beta, l1, l2)), "feature long, weight double").toArrow()
    at, w = np.asarray(out["feature"], np.int64), np.asarray(out["weight"], np.float64)
    return (at, w) if len(at) else (np.array([1 << bits]), np.zeros(1))


def _score(weights, bits: int):
    def run(batches):
        at, w = weights.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at[:-1]] = w[:-1]
        for batch in batches:
            scores = np.full(batch.num_rows, float(w[-1]))
            for a, b, found, doc in features(batch.column(1), bits):
                hit = np.flatnonzero(dense[found])
                key = np.unique(doc[hit] * (1 << bits) + found[hit])  # each feature of a text once
                scores[a:b] += np.bincount(key >> bits, dense[key & ((1 << bits) - 1)].astype(np.float64), minlength=b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(scores))], names=["doc_id", "score"])

    return run


def score(documents: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    held = documents.sparkSession.sparkContext.broadcast(weights)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_score(held, bits)), "doc_id long, score double")


def _keep(weights, bits: int, threshold: float, text: int):
    def run(batches):
        score = _score(weights, bits)
        for batch in batches:
            probe = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text)], names=["doc_id", "text"])
            scores = np.concatenate([np.zeros(0), *(np.asarray(x.column(1)) for x in score([probe]))])
            yield batch.filter(pa.array(scores < threshold))

    return run


def clean(documents: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = 0.3, bits: int = 20, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that score below the threshold."""
    held = documents.sparkSession.sparkContext.broadcast(weights)
    return documents.mapInArrow(lean(_keep(held, bits, threshold, documents.columns.index(text_col))), documents.schema)
