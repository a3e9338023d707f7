"""Embeddings and exact cosine top-k retrieval.

Top-k is exact and never materialises query x item pairs. Two forms give the same
rows: one that leaves out clusters by the triangle inequality (a stored collection,
:func:`pivot_clusters` and :func:`vector_top_k_pruned`), and a plain one: a grid of query
blocks and collection chunks is scored cell by cell in tiles of bounded size,
each cell keeps its best k rows per query, and a final shuffle ranks at most
``chunks x k`` candidates per query. Ties are cut by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.parallel import spread

DEFAULT_DIM = 64
#: Scores held at a time while a cell is scored (4 MB of single precision), rows of a step, and rows after which the k best are cut anew.
TILE_SCORES, STEP_ROWS, BATCH_ROWS = 1 << 20, 1024, 8192
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def l2_normalize(v: Column) -> Column:
    """Unit-length vector (zero vectors stay zero), computed in double."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    # the norm goes in as a list of one: written into the function of the elements, it is summed anew for each of them
    unit = F.element_at(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n))), 1)
    return F.coalesce(unit, d)


def token_buckets(text: Column | str, dim: int = DEFAULT_DIM) -> Column:
    """Hash bucket (CRC-32 mod dim) of every word of the whole text (JVM side)."""
    t = F.col(text) if isinstance(text, str) else text
    tokens = F.filter(F.split(F.lower(t), TOKEN_SPLIT), lambda s: F.length(s) > 0)
    return F.transform(tokens, lambda s: F.pmod(F.crc32(s), F.lit(dim)).cast("int"))


def _bincount_udf(dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def bincount_normalized(buckets: pd.Series) -> pd.Series:
        # one bincount for the whole Arrow batch: cell = row * dim + bucket
        arrs = [np.asarray(b if b is not None else [], dtype=np.int64) for b in buckets]
        n = len(arrs)
        lengths = np.fromiter((len(a) for a in arrs), dtype=np.int64, count=n)
        flat = np.concatenate(arrs) if n else np.empty(0, dtype=np.int64)
        cells = np.repeat(np.arange(n, dtype=np.int64) * dim, lengths) + flat
        c = np.bincount(cells, minlength=n * dim).astype(np.float64).reshape(n, dim)
        norms = np.sqrt(np.einsum("ij,ij->i", c, c))
        c = c / np.where(norms > 0, norms, 1.0)[:, None]
        return pd.Series(list(c))
    return bincount_normalized


def hashed_embedding(text: Column | str, dim: int = DEFAULT_DIM) -> Column:
    """H1 offline provider: hashed bag of words over the whole text, L2
    normalised. Tokens and hashes are computed in the JVM; the per-row bucket
    histogram is one ``np.bincount`` in an Arrow-batched pandas UDF."""
    return _bincount_udf(dim)(token_buckets(text, dim))


def embed_texts(df: DataFrame, text_col: str, *, provider: Callable[[list[str]], list[list[float]]] | None = None,
                batch: int = 10, on_error: str = "zero", dim: int = DEFAULT_DIM,
                out_col: str = "embedding", partitions: int | None = None) -> DataFrame:
    """Add an embedding column.

    Without ``provider`` the hashed bag-of-words expression is used (no Python).
    With one, texts go to it in batches of ``batch`` inside Arrow-batched
    ``mapInPandas`` tasks; a failing batch yields zero vectors
    (``on_error='zero'``) or drops its rows (``'skip'``).
    """
    if provider is None:
        return spread(df, partitions).withColumn(out_col, hashed_embedding(text_col, dim))
    if on_error not in ("zero", "skip"):
        raise ValueError("on_error must be 'zero' or 'skip'")
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out, keep = [], []
            texts = pdf[text_col].fillna("").tolist()
            for i in range(0, len(texts), batch):
                chunk = texts[i:i + batch]
                try:
                    vecs = [list(map(float, v)) for v in provider(chunk)]
                    if len(vecs) != len(chunk):
                        raise ValueError("provider returned a wrong number of vectors")
                    out.extend(vecs)
                    keep.extend([True] * len(chunk))
                except Exception:  # noqa: BLE001 - provider failures are data, not job failures
                    out.extend([[0.0] * dim] * len(chunk))
                    keep.extend([on_error == "zero"] * len(chunk))
            pdf = pdf.assign(**{out_col: out})
            yield pdf[keep] if on_error == "skip" else pdf
    return spread(df, partitions).mapInPandas(run, schema)


def _marked(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a table with few marks: eight places are looked at together."""
    flat = table.ravel()
    if flat.size % 8:
        place = np.flatnonzero(flat)
    else:
        word = np.flatnonzero(flat.view(np.uint64) != 0)
        i, j = np.nonzero(flat.reshape(-1, 8)[word])
        place = word[i] * 8 + j
    return np.divmod(place, table.shape[1])


class _Best:
    """The best k rows of a stream for each query of a block.

    Rows come in the order of their ids, batch by batch, and are read in steps. A product of
    matrices of single precision leaves out rows that are below the k-th best so far by more than
    its rounding errors; the scores of the others are computed in double. A row counts only if its
    score, rounded, is above the k-th best (an equal one has a higher id and loses). Only where a
    score lies so near to a rounding border that the order of summing may show, it is summed again
    in index order. So neither batches nor tiles show in a score or in a cut.

    Queries of one filter value stand together and meet the rows of that value (None: all)."""

    def __init__(self, q: np.ndarray, asked: list | None, k: int, digits: int):
        groups: dict = {}
        for i, f in enumerate([None] * len(q) if asked is None else asked):
            groups.setdefault(f, []).append(i)
        self.order = np.concatenate([np.zeros(0, np.int64), *groups.values()]).astype(np.int64)
        ends = np.cumsum([0] + [len(g) for g in groups.values()])
        self.groups = [(f, ends[i], ends[i + 1]) for i, f in enumerate(groups)]
        self.q, self.k, self.digits = q[self.order], k, digits
        self.q32 = self.q.astype(np.float32)
        self.score, self.row = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        self.seen = 0
        self.tile = max(1, TILE_SCORES // STEP_ROWS)
        room = max(TILE_SCORES, BATCH_ROWS, self.tile * max(STEP_ROWS, 256, 4 * k))
        self.scores, self.marks = np.empty(room, np.float32), np.empty(room, bool)  # filled anew in each step

    def add(self, v: np.ndarray, kinds: np.ndarray | None) -> None:
        """Rows (unit vectors) and their filter values."""
        single = v.astype(np.float32)
        for f, start, end in self.groups:
            at = None if f is None else np.flatnonzero(kinds == f)
            rows, rows32 = (v, single) if at is None else (v[at], single[at])
            for first in range(0, len(rows), BATCH_ROWS):
                some = slice(first, min(first + BATCH_ROWS, len(rows)))
                number = np.arange(some.start, some.stop) if at is None else at[some]
                for lo in range(start, end, self.tile):
                    self._meet(lo, min(lo + self.tile, end), rows[some], rows32[some], number + self.seen)
        self.seen += len(v)

    def _meet(self, start: int, end: int, v: np.ndarray, v32: np.ndarray, number: np.ndarray) -> None:
        """A tile of queries and a batch of rows. Queries that do not have k rows yet read a few rows, then
        the others at once; what is best in each of many groups of them is a floor of the k-th best."""
        lo = 0
        if np.isneginf(self.score[start:end, -1]).any():
            lo = min(max(256, 4 * self.k), len(v))
            self._take(start, end, number, [self._near(start, end, v[:lo], v32[:lo], 0, True)])
            some = max(1, self.scores.size // max(1, len(v) - lo))
            for at in range(start, end, some):
                if lo < len(v):
                    self._take(at, min(at + some, end), number, [self._near(at, min(at + some, end), v[lo:], v32[lo:], lo, True)])
        else:
            self._take(start, end, number, [self._near(start, end, v[i:i + STEP_ROWS], v32[i:i + STEP_ROWS], i, False)
                                            for i in range(0, len(v), STEP_ROWS)])

    def _near(self, start: int, end: int, v: np.ndarray, v32: np.ndarray, lo: int, new: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query of the tile, row, score) of the rows that are above the k-th best."""
        q, top_s, k = self.q[start:end], self.score[start:end], self.k
        scale = 10.0 ** self.digits
        doubt = 8 * q.shape[1] * np.finfo(np.float64).eps * scale  # rounding errors of a score, in units of the last digit
        margin = (q.shape[1] + 4) * 2.0 ** -23  # rounding errors of a single precision score of unit vectors, twice
        shape = len(q), len(v)
        s, near = (x[:shape[0] * shape[1]].reshape(shape) for x in (self.scores, self.marks))
        np.matmul(self.q32[start:end], v32.T, out=s)
        floor = top_s[:, -1] + (0.5 - doubt) / scale
        if new and shape[1] > k:
            groups = max(64, 4 * k)
            each = shape[1] // groups
            best = s[:, :each * groups].reshape(len(q), each, groups).max(axis=1) if each > 1 else s
            kth = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
            floor = np.fmax(floor, kth.astype(np.float64) - margin - 2 * (1 + doubt) / scale)
        np.greater(s, (floor - margin).astype(np.float32)[:, None], out=near)
        some = np.flatnonzero(near.any(axis=1))
        near, tied = near[some], np.zeros(0, np.int64)
        count = np.count_nonzero(near, axis=1)
        if count.sum() > 2 * k * len(q):
            many = count > max(shape[1] // 32, 8 * k)
            tied, some, near = some[many], some[~many], near[~many]
        at, row = _marked(near)
        at = some[at]
        score = np.einsum("ij,ij->i", q[at], v[row])
        if len(tied):  # many rows about as good as the k-th best: a product in double for these queries
            double = q[tied] @ v.T
            i, j = _marked(double > floor[tied][:, None])
            at, row, score = np.concatenate([at, tied[i]]), np.concatenate([row, j]), np.concatenate([score, double[i, j]])
        above = score > floor[at]
        at, row, score = at[above], row[above], score[above]
        unsure = np.flatnonzero(np.abs(score * scale - np.floor(score * scale) - 0.5) <= doubt)
        for i in range(0, len(unsure), 1 << 15):
            u = unsure[i:i + (1 << 15)]
            score[u] = np.cumsum(v[row[u]] * q[at[u]], axis=1)[:, -1]
        return at, row + lo, np.round(score, self.digits) + 0.0

    def _take(self, start: int, end: int, number: np.ndarray, found: list) -> None:
        """Cut the best rows so far and the ones found to the best k of each query."""
        at, row, score = (np.concatenate(x) for x in zip(*found))
        if len(at):
            top_s, top_r = self.score[start:end], self.row[start:end]
            own = np.unique(at)
            at = np.concatenate([at, np.repeat(own, self.k)])
            score, number = np.concatenate([score, top_s[own].ravel()]), np.concatenate([number[row], top_r[own].ravel()])
            order = np.lexsort((number, -score, at))
            first = order[np.searchsorted(at[order], own)[:, None] + np.arange(self.k)]
            top_s[own], top_r[own] = score[first], number[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, number of the row in the stream, score) of the best rows."""
        q, i = np.nonzero(~np.isneginf(self.score))
        return self.order[q], self.row[q, i], self.score[q, i]


def _cell_top_k(qm: np.ndarray, qf, m: np.ndarray, ids: np.ndarray, fv, k: int, digits: int):
    """Best k rows of a row chunk for each query of a block: (query, row, score).

    Queries of one filter value meet the rows of that value; scores are computed in tiles
    of about TILE_SCORES. A score does not depend on how rows meet in a tile, and equal
    scores are cut by id."""
    norms = np.linalg.norm(m, axis=1)
    order = np.argsort(ids, kind="stable")
    best = _Best(qm, qf, k, digits)
    best.add((m / np.where(norms > 0, norms, 1.0)[:, None])[order], None if fv is None else fv[order])
    q, row, score = best.rows()
    return q, order[row], score


def _vectors(col: pa.ListArray) -> np.ndarray:
    """The matrix of a column of lists of one length, from its buffer."""
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    if not len(col) or (lengths != lengths[0]).any():  # a null has no length, it differs from itself
        raise ValueError("vectors must not be null and must have one length")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Cell, whether they are queries, and rows of each run of a batch."""
    cell, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cell", "_asks"))
    ends = np.append(np.flatnonzero((np.diff(cell) != 0) | (asks[1:] != asks[:-1])) + 1, len(cell))
    lo = 0
    for hi in ends:
        if hi > lo:
            yield int(cell[lo]), bool(asks[lo]), batch.slice(lo, hi - lo)
        lo = hi


def vector_top_k(queries: DataFrame, collection: DataFrame, *, k: int, id_col: str = "vec_id",
                 vec_col: str = "embedding", query_vec_col: str = "embedding",
                 filter_col: str | None = None, query_filter_col: str | None = None,
                 block_rows: int = 131072, chunk_rows: int = 524288, digits: int = 10) -> DataFrame:
    """Exact cosine top-k of every query over the collection.

    ``queries``: query_id + vector (+ optional filter value; null = no filter).
    Returns query_id, <id_col>, score (double, rounded to ``digits``), rank
    (1 = best; ties by id). Queries are hashed into blocks and the collection
    into chunks of about ``block_rows`` and ``chunk_rows``. A (block, chunk) cell is a
    partition: its queries come first and are held, its rows follow in the order of their
    ids as Arrow batches, so that the k-th best of a query falls behind early and few
    rows come near it. Neither side passes through the driver; a task holds the queries
    of a block, the ids of a chunk and a batch of vectors. The sizes change the layout
    only, never the rows.
    """
    spark = collection.sparkSession
    n_q, n_c = queries.count(), collection.count()
    nb, nc = max(1, -(-n_q // block_rows)), max(1, -(-n_c // chunk_rows))
    # at least two cells a core; a row is copied to each block, a query to each chunk, in which it finds its k-th best anew
    cells = min(2 * spark.sparkContext.defaultParallelism, -(-n_q * n_c // (1 << 20)))
    layouts = [(b, max(nc, -(-cells // b))) for b in range(nb, max(nb, cells) + 1)]
    nb, nc = min(layouts, key=lambda x: x[0] * n_c + 4 * x[1] * n_q)
    types = {"_q": queries.schema["query_id"].dataType, "_qf": queries.schema[query_filter_col].dataType if query_filter_col else T.StringType(),
             "_i": collection.schema[id_col].dataType, "_cf": collection.schema[filter_col].dataType if filter_col else T.StringType()}
    null = lambda c: F.lit(None).cast(types[c]).alias(c)
    copies = lambda n, at: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)).alias("_cell")
    block, chunk = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("query_id", nb), (id_col, nc)))
    q = queries.select(copies(nc, lambda c: block * nc + c), F.lit(True).alias("_asks"), F.col("query_id").alias("_q"), null("_i"),
                       l2_normalize(F.col(query_vec_col)).alias("_v"),
                       F.col(query_filter_col).alias("_qf") if query_filter_col else null("_qf"), null("_cf"))
    c = collection.select(copies(nb, lambda b: b * nc + chunk), F.lit(False).alias("_asks"), null("_q"), F.col(id_col).alias("_i"),
                          F.col(vec_col).cast("array<double>").alias("_v"),
                          null("_qf"), F.col(filter_col).alias("_cf") if filter_col else null("_cf"))
    dealt = q.union(c).repartitionById(nb * nc, "_cell").sortWithinPartitions("_cell", F.desc("_asks"), "_i")
    schema = T.StructType([T.StructField("query_id", types["_q"]), T.StructField(id_col, types["_i"]), T.StructField("score", T.DoubleType())])
    asks_some = bool(query_filter_col)

    def hits(best: _Best, asked: list, met: list) -> pa.RecordBatch:
        q, row, score = best.rows()
        take = lambda arrays, at: pa.concat_arrays(arrays).take(pa.array(at))
        return pa.RecordBatch.from_arrays([take(asked, q), take(met, row), pa.array(score)], names=schema.names)

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asked, met, best = None, [], [], [], None
        for batch in it:
            for cell, asks, rows in _runs(batch):
                if cell != now:
                    if met and best:
                        yield hits(best, asked, met)
                    now, held, asked, met, best = cell, [], [], [], None
                if asks:
                    held.append((_vectors(rows.column("_v")), rows.column("_qf").to_pylist() if asks_some else None))
                    asked.append(rows.column("_q"))
                    continue
                if not asked:  # rows that no query meets
                    continue
                if best is None:
                    best = _Best(np.concatenate([v for v, _ in held]), [f for _, fs in held for f in fs] if asks_some else None, k, digits)
                    held = []
                v = _vectors(rows.column("_v"))
                norms = np.linalg.norm(v, axis=1)
                best.add(v / np.where(norms > 0, norms, 1.0)[:, None],
                         rows.column("_cf").to_numpy(zero_copy_only=False) if filter_col else None)
                met.append(rows.column("_i"))
        if met and best:
            yield hits(best, asked, met)

    cand = dealt.mapInArrow(search, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Most pivots of a pruned search, and the angle added for rounding to its bounds.
PIVOTS, ANGLE_SLACK = 1024, 1e-6


def _unit(col: pd.Series) -> np.ndarray:
    m = np.vstack(col.map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n > 0, n, 1.0)[:, None]


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def pivot_clusters(collection: DataFrame, path: str, *, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 256) -> DataFrame:
    """Write the collection by nearest pivot (``_cl``; -1 for zero vectors) to ``path`` and
    return the clusters: _cl, pivot, radius (largest angle to the pivot), n.

    Pivots are at most PIVOTS vectors in a pseudo-random order of their ids (a top-k, the
    same in every run), so their matrix is of bounded size; they are shipped to the tasks.
    Which vectors they are changes the work of a search, never its rows."""
    spark = collection.sparkSession
    first = (collection.select(id_col, F.col(vec_col).alias("v")).filter(F.col("v").isNotNull())
             .orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(min(pivots, PIVOTS)).collect())
    matrix = _unit(pd.Series([r["v"] for r in first])) if first else np.zeros((0, 1))
    matrix = np.unique(matrix[np.linalg.norm(matrix, axis=1) > 0], axis=0)
    shared = spark.sparkContext.broadcast(matrix)
    schema = T.StructType(collection.schema.fields + [T.StructField("_cl", T.IntegerType()), T.StructField("_ang", T.DoubleType())])

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf[pdf[vec_col].notna()]
            if len(pdf):
                m = _unit(pdf[vec_col])
                zero = np.linalg.norm(m, axis=1) == 0
                a = np.where(zero[:, None], 0.0, _angles(m, shared.value)) if len(shared.value) else np.zeros((len(m), 1))
                cl = a.argmin(axis=1)
                yield pdf.assign(_cl=np.where(zero, -1, cl).astype(np.int32), _ang=a[np.arange(len(m)), cl])
    collection.mapInPandas(assign, schema).write.mode("overwrite").parquet(path)
    stats = spark.read.parquet(path).groupBy("_cl").agg(F.max("_ang").alias("radius"), F.count(F.lit(1)).alias("n"))
    pivot_rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "_cl int, pivot array<double>")
    return stats.join(pivot_rows, "_cl", "left")


def vector_top_k_pruned(queries: DataFrame, clustered: DataFrame, clusters: DataFrame, *, k: int, id_col: str = "vec_id",
                        vec_col: str = "embedding", query_vec_col: str = "embedding", filter_col: str | None = None,
                        query_filter_col: str | None = None, block_rows: int = 4096, chunk_rows: int = 16384, digits: int = 10) -> DataFrame:
    """E7 / H2 / H3 exact cosine top-k (rows as :func:`vector_top_k`) that leaves out clusters.

    No vector of a cluster is nearer to a query than its angle to the pivot less the
    cluster's radius. A query first visits its clusters in the order of these bounds until
    they hold k vectors (of its filter value, where it has one); the k-th score found is a
    floor, and then it visits every other cluster whose bound reaches that floor. A visit
    is a row; clusters are met by key in chunks and query blocks of bounded size. ``scored`` is the
    number of vectors in the clusters that the query visited.
    """
    from larder.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(clustered.sparkSession)
    clusters = clusters.checkpoint(eager=True)
    table = clusters.collect()  # a row per pivot: at most PIVOTS + 1
    rank = {r["_cl"]: i for i, r in enumerate(table)}
    shared = clustered.sparkSession.sparkContext.broadcast((
        np.array([r["pivot"] if r["pivot"] is not None else [] for r in table if r["_cl"] >= 0], dtype=np.float64),
        np.array([r["_cl"] for r in table if r["_cl"] >= 0], np.int64), np.array([r["radius"] for r in table if r["_cl"] >= 0])))
    has_filter = bool(query_filter_col)
    q = queries.select("query_id", F.col(query_vec_col).alias("_qv"), (F.col(query_filter_col) if has_filter else F.lit(None).cast("string")).alias("_qf"))
    fields = [f for f in q.schema.fields]

    def bounds(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, cl, radius = shared.value
        for pdf in it:
            pdf = pdf[pdf["_qv"].notna()]
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                m = _unit(part["_qv"])
                near = np.maximum(_angles(m, pivots) - radius - ANGLE_SLACK, 0.0) if len(cl) else np.zeros((len(m), 0))
                near[np.linalg.norm(m, axis=1) == 0] = 0.0  # a zero query scores 0 everywhere
                both, c = np.cos(near), cl
                if -1 in rank:  # zero vectors score 0
                    both, c = np.column_stack([both, np.ones(len(m))]), np.append(cl, -1)
                yield pd.DataFrame({"query_id": part["query_id"].repeat(len(c)).to_numpy(), "_qf": part["_qf"].repeat(len(c)).to_numpy(),
                                    "_cl": np.tile(c, len(part)).astype(np.int32), "_bound": both.ravel()})
    by = {f.name: f for f in fields}
    every = q.mapInPandas(bounds, T.StructType([by["query_id"], by["_qf"], T.StructField("_cl", T.IntegerType()), T.StructField("_bound", T.DoubleType())]))
    # vectors of the query's filter value in each cluster
    if has_filter:
        held = clustered.groupBy("_cl", F.col(filter_col).alias("_fv")).agg(F.count(F.lit(1)).alias("_held"))
        some = every.filter("_qf IS NOT NULL").join(held, [every["_cl"] == held["_cl"], every["_qf"] == held["_fv"]]).select(every["*"], "_held")
        every = some.unionByName(every.filter("_qf IS NULL").join(clusters.select("_cl", F.col("n").alias("_held")), "_cl").select(*some.columns))
    else:
        every = every.join(clusters.select("_cl", F.col("n").alias("_held")), "_cl")
    every = every.join(clusters.select("_cl", "n"), "_cl")
    order = Window.partitionBy("query_id").orderBy(F.desc("_bound"), "_cl")  # at most PIVOTS + 1 rows a query
    before = F.coalesce(F.sum("_held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = every.withColumn("_early", before < k).checkpoint(eager=True)
    schema = T.StructType([by["query_id"], T.StructField(id_col, clustered.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def cell(qp: pd.DataFrame, cp: pd.DataFrame) -> pd.DataFrame:
        if qp.empty or cp.empty:
            return pd.DataFrame({"query_id": [], id_col: [], "score": []})
        stack = lambda col: np.vstack(col.map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
        at_q, at_c, score = _cell_top_k(stack(qp["_qv"]), [x if pd.notna(x) else None for x in qp["_qf"]] if has_filter else None, stack(cp[vec_col]),
                                        cp[id_col].to_numpy(), cp[filter_col].to_numpy() if filter_col else None, k, digits)
        return pd.DataFrame({"query_id": qp["query_id"].to_numpy()[at_q], id_col: cp[id_col].to_numpy()[at_c], "score": score})

    def visit(visits: DataFrame) -> DataFrame:
        # cells of bounded size: a cluster's vectors in chunks, the queries that visit it in blocks
        size = visits.groupBy("_cl").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("_nb"), F.ceil(F.max("n") / F.lit(chunk_rows)).alias("_nc"))
        copies = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
        left = (visits.select("query_id", "_cl").join(size, "_cl").join(q.withColumn("_qv", l2_normalize(F.col("_qv"))), "query_id")
                .withColumn("_b", F.pmod(F.xxhash64("query_id"), F.col("_nb"))).withColumn("_c", copies("_nc")))
        right = (clustered.select("_cl", id_col, vec_col, *([filter_col] if filter_col else [])).join(size, "_cl")
                 .withColumn("_c", F.pmod(F.xxhash64(id_col), F.col("_nc"))).withColumn("_b", copies("_nb")))
        return (left.select("query_id", "_qv", "_qf", "_cl", "_b", "_c").groupBy("_cl", "_b", "_c")
                .cogroup(right.drop("_nb", "_nc").groupBy("_cl", "_b", "_c")).applyInPandas(cell, schema))

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    best = lambda df: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    early = best(visit(every.filter("_early"))).drop("rank").checkpoint(eager=True)
    floor = early.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("_floor"))
    late = every.filter(~F.col("_early")).join(floor, "query_id", "left").filter(
        F.col("_floor").isNull() | (F.col("_bound") >= F.col("_floor") - F.lit(2 * 10.0 ** -digits))).checkpoint(eager=True)
    scored = every.filter("_early").select("query_id", "n").unionByName(late.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("scored"))
    return best(early.unionByName(visit(late))).join(scored, "query_id")


def vector_top_k_partitioned(queries: DataFrame, path: str, *, k: int, filter_col: str, query_filter_col: str, id_col: str = "vec_id",
                             vec_col: str = "embedding", query_vec_col: str = "embedding", block_rows: int = 4096, chunk_rows: int = 16384,
                             digits: int = 10) -> DataFrame:
    """H3 exact cosine top-k (rows as :func:`vector_top_k`) over a collection that
    :func:`vector_collection_write` stored at ``path``, partitioned by ``filter_col``.

    Queries meet the vectors of their own filter value only: cells are blocks and chunks
    within a value, and dynamic partition pruning by the values asked for keeps the folders of
    all others unread. Queries without a filter meet the whole collection by the plain form."""
    from larder.session import ensure_checkpoint_dir
    spark = queries.sparkSession
    stored = spark.read.parquet(path)
    q = queries.select("query_id", l2_normalize(F.col(query_vec_col)).alias("_qv"), F.col(query_filter_col).alias("_v")).filter("_v IS NOT NULL")
    asked = q.groupBy("_v").agg(F.count(F.lit(1)).alias("_nq"))
    sizes = f"{ensure_checkpoint_dir(spark).rstrip('/')}/asked-values-{uuid.uuid4().hex}"
    asked.write.parquet(f"{sizes}/asked")
    # written tables have a known size, so that the planner can broadcast them where they are small; a filter makes them a pruning side
    asked = spark.read.parquet(f"{sizes}/asked").filter("_nq > 0")
    held = stored.select(F.col(filter_col).alias("_v")).join(asked, "_v").groupBy("_v", "_nq").agg(F.count(F.lit(1)).alias("_n"))
    grid = lambda n, rows: F.ceil(F.col(n) / F.lit(rows)).cast("long")
    held.select("_v", grid("_nq", block_rows).alias("_nb"), grid("_n", chunk_rows).alias("_nc")).write.parquet(f"{sizes}/grid")
    layout = spark.read.parquet(f"{sizes}/grid").filter("_nb > 0 AND _nc > 0")
    copies = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = q.join(layout, "_v").withColumn("_b", F.pmod(F.xxhash64("query_id"), F.col("_nb"))).withColumn("_c", copies("_nc"))
    right = (stored.select(id_col, vec_col, F.col(filter_col).alias("_v")).join(layout, "_v")
             .withColumn("_c", F.pmod(F.xxhash64(id_col), F.col("_nc"))).withColumn("_b", copies("_nb")))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField(id_col, stored.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def cell(qp: pd.DataFrame, cp: pd.DataFrame) -> pd.DataFrame:
        if qp.empty or cp.empty:
            return pd.DataFrame({"query_id": [], id_col: [], "score": []})
        stack = lambda col: np.vstack(col.map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
        at_q, at_c, score = _cell_top_k(stack(qp["_qv"]), None, stack(cp[vec_col]), cp[id_col].to_numpy(), None, k, digits)
        return pd.DataFrame({"query_id": qp["query_id"].to_numpy()[at_q], id_col: cp[id_col].to_numpy()[at_c], "score": score})

    cand = left.select("query_id", "_qv", "_v", "_b", "_c").groupBy("_v", "_b", "_c").cogroup(
        right.select(id_col, vec_col, "_v", "_b", "_c").groupBy("_v", "_b", "_c")).applyInPandas(cell, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    hits = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    free = queries.filter(F.col(query_filter_col).isNull())
    if not free.take(1):
        return hits
    return hits.unionByName(vector_top_k(free, stored, k=k, id_col=id_col, vec_col=vec_col, query_vec_col=query_vec_col,
                                         block_rows=block_rows, chunk_rows=chunk_rows, digits=digits))


def category_centroids(collection: DataFrame, *, category_col: str = "category",
                       vec_col: str = "embedding") -> DataFrame:
    """Mean vector per category (bounded: one row per category, dim values)."""
    ex = collection.select(category_col, F.posexplode(vec_col).alias("pos", "v"))
    per = ex.groupBy(category_col, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return (per.groupBy(category_col)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("_pv"))
            .select(F.col(category_col), F.transform("_pv", lambda s: s["v"]).alias(vec_col)))


def vector_collection_write(df: DataFrame, path: str, *, partition_by: str | None = None,
                            mode: str = "overwrite") -> None:
    """Write id + vector + payload as Parquet (drop and recreate), optionally
    partitioned (by category / deal type) so filtered searches prune files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def vector_upsert(collection: DataFrame, changes: DataFrame, *, id_col: str = "vec_id") -> DataFrame:
    """Keyed upsert = changed rows + old rows whose id is not changed."""
    return changes.unionByName(collection.join(changes.select(id_col), id_col, "left_anti"),
                               allowMissingColumns=True)


def foreach_batch_sink(df: DataFrame, send: Callable[[list[dict]], None], *, batch: int = 100) -> None:
    """Push rows to an external store from every partition in batches."""
    def part(rows):
        buf = []
        for r in rows:
            buf.append(r.asDict(recursive=True))
            if len(buf) >= batch:
                send(buf)
                buf = []
        if buf:
            send(buf)
    df.foreachPartition(part)


def index_incremental(collection: DataFrame, changes: DataFrame, products: DataFrame, *,
                      text: Callable[[DataFrame], Column], dim: int = DEFAULT_DIM) -> DataFrame:
    """H5: apply product change messages (create / update / delete) to a
    vector collection. The last action per product wins; creates and updates
    are re-embedded from the current product row, deletes are removed."""
    w = Window.partitionBy("product_id").orderBy(F.desc("msg_seq"))
    last = changes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    ups = (last.filter(F.col("action").isin("create", "update")).select("product_id")
           .join(products, "product_id", "inner"))
    fresh = ups.select(F.col("product_id").alias("vec_id"), "category",
                       hashed_embedding(text(ups), dim).alias("embedding"))
    kept = collection.join(last.select(F.col("product_id").alias("vec_id")), "vec_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
