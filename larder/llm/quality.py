"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - s) with one linear score s shared by all
grades and ordered thresholds. s is the mean weight of a document's hashed
text features: words, word shapes (first and last characters by class, length)
and repetition marks. The fitted model gives the expected grade and the tail
probability P(grade >= k) for selection.

Training uses a bounded, documented sample of graded documents, whole texts;
their sparse features are computed in Spark. Scoring covers every whole text.

Defined results: null and empty texts have no features, so s = 0; null grades
are ignored; a document graded more than once takes its lowest grade; repeated
documents give repeated rows; without graded rows nothing is rejected
(tail probability 1); other columns are kept or ignored as stated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import text as X

BITS = 16
MAX_ROWS = 8000  # bound of the graded sample
EPOCHS, BATCH, RATE, DECAY, SEED, SCALE = 12, 64, 0.1, 1e-5, 5, 30.0

_SHIFT = np.uint64(64 - BITS)
#: letters by case, digits, other bytes (of non-ASCII letters) as lower case, punctuation as itself
_KIND = np.arange(256, dtype=np.uint64)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 3


def grade(labels: DataFrame) -> DataFrame:
    """Graded ratings from the label table: 0 low quality, 1 good but toxic, 2 good."""
    g = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(g).alias("grade")))


def features(part: X.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a slice (word, shape and repetition of each word) and the row of each."""
    w = part.words()
    row = w.row
    if not len(row):
        return np.zeros(0, np.int64), row
    h = w.hashes
    a, z = part.data[w.starts], part.data[w.ends - 1]
    y = part.data[np.maximum(w.ends - 2, w.starts)]
    size = np.minimum(w.ends - w.starts, 15).astype(np.uint64)
    shape = X.mix(((_KIND[a] * np.uint64(256) + _KIND[z]) * np.uint64(256) + _KIND[y]) * np.uint64(16) + size + np.uint64(1 << 40))
    again = np.zeros(len(h), np.uint64)
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again[1:] += same
    again[:-1] += np.uint64(2) * same
    mark = X.mix(again + np.uint64(1 << 50))
    return (np.concatenate([h, shape, mark]) >> _SHIFT).astype(np.int64), np.concatenate([row] * 3)


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, vals = [], []
        for part in X.slices(b.column(1)):
            f, row = features(part)
            key, n = np.unique(row.astype(np.int64) << BITS | f, return_counts=True)
            total = np.maximum(np.bincount(row, minlength=part.n), 1)
            r = key >> BITS
            edges = np.searchsorted(r, np.arange(part.n + 1))
            v = (n / total[r]).astype(np.float32)
            for i in range(part.n):
                at = slice(edges[i], edges[i + 1])
                ids.append((key[at] & ((1 << BITS) - 1)).astype(np.int32).tobytes())
                vals.append(v[at].tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(vals, pa.binary())],
                                         names=["grade", "ids", "vals"])


class Model:
    """Shared weights and ordered thresholds for grades 0 .. k."""

    def __init__(self, grades: int) -> None:
        self.grades = grades
        self.w = np.zeros(1 << BITS)
        self.theta = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> "Model":
        """Adagrad on the negative log likelihood; thresholds stay ordered."""
        rng = np.random.default_rng(SEED)
        acc_w, acc_t = np.full(len(self.w), 1e-2), np.full(len(self.theta), 1e-2)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                pick = [rows[i] for i in order[lo:lo + BATCH]]
                ids = np.concatenate([r[1] for r in pick])
                vals = np.concatenate([r[2] for r in pick]) * SCALE
                own = np.repeat(np.arange(len(pick)), [len(r[1]) for r in pick])
                y = np.array([r[0] for r in pick])
                s = np.bincount(own, vals * self.w[ids], minlength=len(pick))
                # cumulative probabilities with P(grade <= -1) = 0 and P(grade <= top) = 1
                cum = np.concatenate([np.zeros((len(y), 1)), 1 / (1 + np.exp(-(self.theta[None] - s[:, None]))), np.ones((len(y), 1))], 1)
                slope = cum * (1 - cum)
                at = np.arange(len(y))
                p = np.maximum(cum[at, y + 1] - cum[at, y], 1e-9)
                ds = (slope[at, y + 1] - slope[at, y]) / p / len(y)
                dt = np.zeros((len(y), self.grades + 1))
                dt[at, y + 1] -= slope[at, y + 1] / p / len(y)
                dt[at, y] += slope[at, y] / p / len(y)
                uniq, inv = np.unique(ids, return_inverse=True)
                g = np.bincount(inv, vals * ds[own]) + DECAY * self.w[uniq]
                acc_w[uniq] += g * g
                self.w[uniq] -= RATE * g / np.sqrt(acc_w[uniq])
                gt = dt.sum(0)[1:-1]
                acc_t += gt * gt
                self.theta = np.maximum.accumulate(self.theta - RATE * gt / np.sqrt(acc_t))
        return self

    def tails(self, part: X.Slice) -> np.ndarray:
        """P(grade >= k) for k = 1 .. top, a row per document."""
        f, row = features(part)
        n = np.maximum(np.bincount(row, minlength=part.n), 1)
        s = SCALE * np.bincount(row, self.w[f], minlength=part.n) / n
        return 1 / (1 + np.exp(self.theta[None] - s[:, None]))


def train(docs: DataFrame, graded: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Model | None:
    """Fit on at most about ``max_rows`` graded documents; None without any."""
    n = graded.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("grade")), F.lit(1 << 20)) / float(1 << 20)
    sample = F.broadcast(graded.select("doc_id", "grade").filter(draw < max_rows / n))  # bounded by max_rows
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
            .select(F.col("grade").cast("int"), "text").mapInArrow(_sparse_rows, "grade int, ids binary, vals binary").collect())
    if not rows:
        return None
    data = sorted((r["grade"], bytes(r["ids"]), bytes(r["vals"])) for r in rows)
    return Model(max(2, data[-1][0] + 1)).fit(
        [(g, np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for g, i, v in data], epochs)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for b in batches:
            t = [m.tails(p) if m else np.ones((p.n, 1)) for p in X.slices(b.column(0).field("text"))]
            if t:
                t = np.concatenate(t)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t.sum(1)), pa.array(list(t), pa.list_(pa.float64()))],
                                                 names=["row", "expected_grade", "tail"])
    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row`` (the input row as a struct), expected_grade and tail (P(grade >= k) for k = 1 ..)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("expected_grade", T.DoubleType()),
                           T.StructField("tail", T.ArrayType(T.DoubleType()))])
    return docs.select(F.struct("*").alias("row")).mapInArrow(_score(shared), schema)


def accepted(at_least: int = 1, probability: float = 0.5) -> Column:
    return F.element_at("tail", at_least) >= probability


def quality(docs: DataFrame, labels: DataFrame, at_least: int = 1, probability: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail probability of ``at_least`` and the selection."""
    m = train(docs, grade(labels))
    return score(docs.select("doc_id", "text"), m).select(
        F.col("row.doc_id").alias("doc_id"), "expected_grade", F.element_at("tail", at_least).alias("p_tail"),
        F.element_at("tail", -1).alias("p_top"), accepted(at_least, probability).alias("selected"))


def keep_accepted(docs: DataFrame, labels: DataFrame, at_least: int = 1, probability: float = 0.5) -> DataFrame:
    """All columns of the documents that the classifier accepts."""
    return score(docs, train(docs, grade(labels))).filter(accepted(at_least, probability)).select("row.*")
