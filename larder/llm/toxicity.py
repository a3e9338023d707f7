"""Toxicity: a convolutional text classifier in numpy.

Words (lower-case, letters and digits) hash to buckets with an embedding row;
filters of several widths slide over them, each keeps its largest response in
the document, and a logistic layer scores those maxima. Every labelled document
is learnt from, whole: vocabulary and presence counts are sums over all of them,
and each pass goes over shards of bounded size, whose tasks descend from the same
parameters; Spark sums what the shards changed, in whole numbers, so that no order
of tasks shows in the model. The driver holds the parameters only.
Scoring runs over every whole text in Arrow batches. Per-language decision
thresholds are calibrated on a fold of the labelled rows that the passes leave
out, on all rows of the fold, and reported beside the score; the score itself
depends on the text alone.

Defined results: null and empty texts get the score of an empty document;
null labels are ignored; repeated label rows of a document count once (its
largest label); repeated documents give repeated rows; without any labelled
row every score is 0; other columns are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import text as X
from larder.llm.phrases import PAIR_BITS, _bit_table, _has

BUCKET_BITS = 22
WIDTHS = (1, 2, 3)
FILTERS, DIM, PAD = 8, 8, 3
#: Documents and words of a shard, and bytes of a word, about.
SHARD_DOCS, SHARD_WORDS, WORD_BYTES = 8192, 1 << 22, 6
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.05, 11
MIN_DOCS = 3
#: Steps of a change as it is summed, and of a score as thresholds are looked for.
STEPS, LEVELS = 1 << 24, 1 << 16
#: Positives that a language needs for a threshold of its own.
MIN_POSITIVE = 10

_TOKENS = "doc_id long, lang string, ids binary"
_COUNTS = "bucket int, pos long, neg long"
#: An embedding row (its number, DIM values, their accumulator), or from -1 down a run of the other parameters.
_CHANGES = "key int, " + ", ".join(f"v{i} long" for i in range(DIM + 1))

_SHIFT = np.uint64(64 - BUCKET_BITS)


def _buckets(part: X.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of a slice, and the word offsets of its rows."""
    w = part.lower().words(X.ALNUM)
    return (w.hashes >> _SHIFT).astype(np.int32), w.first


def _token_rows(shared):
    """Token buckets of the rows whose slot is set in the shared bit table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            b = b.filter(pa.array(_has(table, b.column(3).to_numpy())))
            for part in X.slices(b.column(2)):
                ids, first = _buckets(part)
                rows = b.slice(part.first, part.n)
                out = [ids[first[i]:first[i + 1]].tobytes() for i in range(part.n)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.binary())], names=["doc_id", "lang", "ids"])
    return run


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) for x in column]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a bucket."""
    for b in batches:
        y = np.asarray(b.column(0)) > 0
        docs = [np.unique(d) for d in _ids(b.column(1))]
        at, inv = np.unique(np.concatenate([*docs, np.zeros(0, np.int32)]), return_inverse=True)
        n = np.bincount(inv, minlength=len(at))
        pos = np.bincount(inv, np.repeat(y, [len(d) for d in docs]), len(at)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pos), pa.array(n - pos)], names=["bucket", "pos", "neg"])


def _layout(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows laid out with PAD empty tokens after each: (embedding rows, start, window count of each row)."""
    n = np.diff(first)
    start = first[:-1] - first[0] + PAD * np.arange(len(n))
    out = np.zeros(int(n.sum() + PAD * len(n)), np.int64)
    at = np.arange(first[0], first[-1])
    out[at - first[0] + PAD * np.repeat(np.arange(len(n)), n)] = ids[at]
    return out, start, np.maximum(n, 1)


class Model:
    """Embedding rows by bucket, filters by width, one logistic layer."""

    def __init__(self, vocab: np.ndarray, odds: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.vocab = vocab  # sorted buckets; row i + 1 is bucket vocab[i], row 0 is padding and unseen words
        # the first dimension starts at the smoothed log-odds of a row's presence
        self.E = (rng.standard_normal((len(vocab) + 1, DIM)) * 0.05).astype(np.float32)
        self.E[1:, 0] = np.clip(odds, -4, 4) / 2
        self.E[0] = 0
        self.W = {w: (rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        self.b = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.u = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.acc = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.dense().items()}
        self.acc_e = np.full(len(self.E), 1e-2, np.float32)
        self.thresholds: dict[str, float] = {}
        self._row: np.ndarray | None = None

    def dense(self) -> dict:
        """The parameters beside the embedding rows (the arrays themselves)."""
        return {"u": self.u, "c": self.c, **{("W", w): self.W[w] for w in WIDTHS}, **{("b", w): self.b[w] for w in WIDTHS}}

    def flat(self) -> np.ndarray:
        """Those parameters and their accumulators in rows of DIM + 1."""
        v = np.concatenate([x.ravel() for x in (*self.dense().values(), *self.acc.values())]).astype(np.float64)
        return np.append(v, np.zeros(-len(v) % (DIM + 1))).reshape(-1, DIM + 1)

    def move(self, change: np.ndarray) -> None:
        at = 0
        for x in (*self.dense().values(), *self.acc.values()):
            x += change.ravel()[at:at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def part(self, rows: np.ndarray) -> "Model":
        """A copy that holds only these embedding rows (row 0 among them, first)."""
        m = copy.copy(self)
        m.E, m.acc_e, m._row = self.E[rows], self.acc_e[rows], None
        m.W, m.b, m.acc = ({k: v.copy() for k, v in x.items()} for x in (self.W, self.b, self.acc))
        m.u, m.c = self.u.copy(), self.c.copy()
        return m

    def __getstate__(self):
        return {**self.__dict__, "_row": None}

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        if self._row is None:
            self._row = np.zeros(1 << BUCKET_BITS, np.int32)
            self._row[self.vocab] = np.arange(1, len(self.vocab) + 1)
        return self._row[buckets]

    def responses(self, tokens: np.ndarray) -> dict[int, np.ndarray]:
        x = self.E[tokens]
        out = {}
        for w in WIDTHS:
            n = len(tokens) - w + 1
            y = x[:n] @ self.W[w][0]
            for j in range(1, w):
                y += x[j:j + n] @ self.W[w][j]
            out[w] = y
        return out

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        tokens, start, count = _layout(self.rows(ids), first)
        edges = np.stack([start, start + count], 1).ravel()
        h = []
        for w, y in self.responses(np.concatenate([tokens, np.zeros(PAD, np.int64)])).items():
            top = np.maximum.reduceat(y, edges, axis=0)[::2]
            h.append(np.maximum(top + self.b[w], 0))
        return 1 / (1 + np.exp(-(np.concatenate(h, 1).astype(np.float64) @ self.u + self.c[0])))

    def descend(self, docs: list[np.ndarray], labels: np.ndarray, seed: int) -> "Model":
        """One pass of Adagrad on log loss, in random order; docs are arrays of embedding rows."""
        params, acc, acc_e = self.dense(), self.acc, self.acc_e
        order = np.random.default_rng(seed).permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
            tokens, start, count = _layout(np.concatenate([docs[i] for i in pick]), first)
            best, h = {}, []
            for w, y in self.responses(np.concatenate([tokens, np.zeros(PAD, np.int64)])).items():
                best[w] = np.stack([s + y[s:s + n].argmax(0) for s, n in zip(start, count, strict=True)])
                h.append(y[best[w], np.arange(FILTERS)] + self.b[w])
            z = np.concatenate(h, 1)
            a = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-(a @ self.u + self.c[0])))
            err = ((p - labels[pick]) / len(pick)).astype(np.float32)
            grads = {"u": a.T @ err, "c": err.sum(keepdims=True)}
            dz = err[:, None] * self.u[None] * (z > 0)
            rows, parts = [], []
            for k, w in enumerate(WIDTHS):
                d = dz[:, k * FILTERS:(k + 1) * FILTERS]
                grads["b", w] = d.sum(0)
                gw = np.zeros_like(self.W[w])
                for j in range(w):
                    t = np.concatenate([tokens, np.zeros(PAD, np.int64)])[best[w] + j]
                    gw[j] = np.einsum("bfd,bf->df", self.E[t], d)
                    rows.append(t.ravel())
                    parts.append((d[:, :, None] * self.W[w][j].T[None]).reshape(-1, DIM))
                grads["W", w] = gw
            for key, g in grads.items():
                acc[key] += g * g
                params[key] -= RATE * g / np.sqrt(acc[key])
            uniq, inv = np.unique(np.concatenate(rows), return_inverse=True)
            g = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(g, inv, np.concatenate(parts))
            acc_e[uniq] += (g * g).sum(1)
            self.E[uniq] -= RATE * g / np.sqrt(acc_e[uniq])[:, None]
            self.E[0] = 0
        return self


def _learn(shared, epoch: int):
    """A shard's pass (its rows are one partition) from the shared parameters: what it changed, in STEPS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(i, d.tobytes(), y) for b in batches
                for i, y, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _ids(b.column(2)), strict=True)]
        if not rows:
            return
        rows.sort()
        m: Model = shared.value
        docs = [m.rows(np.frombuffer(d, np.int32)) for _, d, _ in rows]
        edges = np.cumsum([0] + [len(d) for d in docs])
        used, local = np.unique(np.concatenate([np.zeros(1, np.int32), *docs]), return_inverse=True)
        own = m.part(used)
        own.descend([local[1 + i:1 + j] for i, j in zip(edges[:-1], edges[1:], strict=True)], np.array([y for _, _, y in rows], np.float64), SEED + epoch)
        moved = np.column_stack([own.E - m.E[used], own.acc_e - m.acc_e[used]]).astype(np.float64)
        hit = np.flatnonzero(moved.any(axis=1))
        other = own.flat() - m.flat()
        key = np.concatenate([used[hit], -1 - np.arange(len(other))]).astype(np.int32)
        step = np.rint(np.concatenate([moved[hit], other]) * STEPS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(step[:, i]) for i in range(DIM + 1)]],
                                         names=["key", *[f"v{i}" for i in range(DIM + 1)]])
    return run


def labelled(docs: DataFrame, labels: DataFrame, condition: str) -> DataFrame:
    """Every labelled document of which the SQL condition allows to learn, as token buckets. A
    partition is a shard: as many are dealt by doc_id as keep it at about SHARD_DOCS labelled
    documents and SHARD_WORDS words. Buckets are taken before the join, so no text is shuffled;
    a bit table of the labelled ids' hash slots (8 MB at any input size) leaves out most other
    documents. A wrongly set bit costs work, never a row."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
           .dropna().filter(condition).groupBy("doc_id").agg(F.max("label").alias("label")))
    n_lab = lab.count()
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()
    words = (size["bytes"] or 0) / WORD_BYTES * min(1.0, n_lab / max(size["n"], 1))
    n = int(max(1, -(-n_lab // SHARD_DOCS), -(-words // SHARD_WORDS)))
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << PAIR_BITS)).cast("int").alias("slot")
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(lab.select(slot), PAIR_BITS))
    tokens = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                          F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL").select("*", slot)
              .mapInArrow(_token_rows(shared), _TOKENS))
    return (tokens.join(lab.hint("merge"), "doc_id")
            .select("doc_id", "label", "ids", F.coalesce("lang", F.lit("")).alias("lang"), calibrate.alias("calibrate")).repartition(n, "doc_id"))


def thresholds(scored: DataFrame) -> dict[str, float]:
    """Threshold of the best F1 of all rows (label, lang, score) under "" and of each language
    with MIN_POSITIVE positives: the middle between two neighbouring scores, cut between
    LEVELS levels of the score. 0.5 without both labels."""
    level = F.floor(F.col("score") * LEVELS).cast("int")
    both = F.explode(F.when(F.col("lang") == "", F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.col("lang"))))
    bins = (scored.groupBy("lang", level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"),
                                                             F.min("score").alias("low"), F.max("score").alias("high"))
            .withColumn("lang", both).groupBy("lang", "level").agg(F.sum("n").alias("n"), F.sum("y").alias("y"),
                                                                   F.min("low").alias("low"), F.max("high").alias("high")))
    down = Window.partitionBy("lang").orderBy(F.desc("level"))  # at most LEVELS + 1 rows
    whole = Window.partitionBy("lang")
    cuts = bins.select("lang", "level", F.coalesce((F.col("low") + F.lead("high").over(down)) / 2, "low").alias("cut"),
                       F.sum("y").over(down).alias("tp"), F.sum("n").over(down).alias("said"), F.sum("y").over(whole).alias("y"), F.sum("n").over(whole).alias("n"))
    best = (cuts.groupBy("lang", "y", "n").agg(F.max(F.struct((2 * F.col("tp") / (F.col("said") + F.col("y"))).alias("f1"), "level", "cut")).alias("b"))
            .filter((F.col("lang") == "") | (F.col("y") >= MIN_POSITIVE)))
    return {r["lang"]: r["b"]["cut"] if 0 < r["y"] < r["n"] else 0.5 for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, condition: str = "true", epochs: int = EPOCHS) -> Model | None:
    """Fit on all labelled documents but the calibration fold (on that, where there is no
    other), and calibrate a threshold per language on it; None without labels."""
    sc = docs.sparkSession.sparkContext
    tokens = labelled(docs, labels, condition).persist(StorageLevel.DISK_ONLY)
    sizes = {r["calibrate"]: r for r in tokens.groupBy("calibrate").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).collect()}
    if not sizes:
        tokens.unpersist()
        return None
    size = sizes.get(False) or sizes[True]
    fit = tokens.filter(F.col("calibrate") == size["calibrate"]).select("doc_id", "label", "ids")
    counts = (fit.select("label", "ids").mapInArrow(_presence, _COUNTS).groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .filter(F.col("pos") + F.col("neg") >= MIN_DOCS).toArrow().sort_by("bucket"))  # a row per bucket: at most 2^BUCKET_BITS
    pos, neg = (counts.column(c).to_numpy() + 1 for c in ("pos", "neg"))
    m = Model(counts.column("bucket").to_numpy(), np.log(pos / (size["y"] + 2)) - np.log(neg / (size["n"] - size["y"] + 2)))
    # the mean of the shards that changed a row
    mean = [(F.sum(f"v{i}") / (F.count(F.lit(1)) * F.lit(float(STEPS)))).cast("float").alias(f"v{i}") for i in range(DIM + 1)]
    for epoch in range(epochs):
        shared = sc.broadcast(m)
        moved = fit.mapInArrow(_learn(shared, epoch), _CHANGES).groupBy("key").agg(*mean).toArrow().sort_by("key")
        shared.destroy()
        key, step = moved.column("key").to_numpy(), np.column_stack([moved.column(f"v{i}").to_numpy() for i in range(DIM + 1)])
        m.move(step[key < 0][::-1])
        m.E[key[key >= 0]] += step[key >= 0, :DIM]
        m.acc_e[key[key >= 0]] += step[key >= 0, DIM]
    if True in sizes:
        shared = sc.broadcast(m)
        m.thresholds = thresholds(tokens.filter("calibrate").select("label", "lang", "ids").mapInArrow(_held_scores(shared), "label int, lang string, score double"))
        shared.destroy()
    tokens.unpersist()
    return m


def _held_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.slice(lo, 64)
                docs = _ids(part.column(2))
                s = shared.value.score(np.concatenate(docs), np.cumsum([0] + [len(d) for d in docs]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s)], names=["label", "lang", "score"])
    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for b in batches:
            s = [m.score(*_buckets(p)) if m else np.zeros(p.n) for p in X.slices(b.column(2))]
            if s:
                t = [m.thresholds.get(x or "", m.thresholds.get("", 0.5)) if m else 0.5 for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(s)), pa.array(t, pa.float64())],
                                                 names=["doc_id", "score", "lang_threshold"])
    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score in [0, 1], predicted (score >= 0.5), the threshold of the
    document's language and ``flagged`` under it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = (docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
           .mapInArrow(_score(shared), "doc_id long, score double, lang_threshold double"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn(
        "flagged", F.col("score") >= F.col("lang_threshold"))
