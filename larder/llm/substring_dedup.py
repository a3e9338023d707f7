"""Substring deduplication by a hash join of blocks and windows.

Reference blocks: in every window of ``window`` words the k-gram of smallest
hash is the anchor, and neighbouring windows with the same anchor form a block
(13 to about 20 words), so equal windows always lie in blocks of equal anchor.
All blocks of the corpus are indexed by anchor. A block equal to a block of a
document with a smaller id is a duplicate as a whole; where a block differs but
its anchor is indexed, all its windows are looked up, one by one, in the index
of the windows of such blocks. This takes the place of a relative Lempel-Ziv
parse, which would have to meet every document with every block: there is no
left-to-right factoring, and ``n_factors`` counts the runs of removed words,
not factors with a source. The removed words are those of all windows that an
earlier document holds.

One shuffle deals the block hashes by anchor. Anchors that hold a large share
of all blocks (found in a bounded sample, counted over all documents) do not
take part in it; their few rows of statistics are broadcast. Texts are
shuffled once, by document, and read by two stages.

Defined results: null and empty texts have no words; a null doc_id is never
smaller than another one and nothing of it is removed; rows of equal doc_id
are not references of each other; repeated rows give repeated rows; a word run
shorter than the window is never removed; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import text as X

WINDOW, GRAM = 13, 5
#: At most HOT_KEYS anchors are treated as hot; they are looked for in every SAMPLE-th document (by hash).
HOT_KEYS, SAMPLE, SALTS = 512, 64, 64

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


class Blocks:
    """Blocks of a slice: anchor ``key``, content ``seg``, windows ``a .. b`` and row of each."""

    def __init__(self, w: X.Words, window: int = WINDOW, gram: int = GRAM) -> None:
        self.words, self.window = w, window
        at, g = w.grams(gram)
        dense = np.full(len(w.starts), _MAX)
        dense[at] = g
        self.win, self.win_hash = w.grams(window)
        best = dense[self.win]
        off = np.zeros(len(best), np.int64)
        for t in range(1, window - gram + 1):
            c = dense[self.win + t]
            less = c < best
            best[less] = c[less]
            off[less] = t
        pos = self.win + off
        new = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]])) if len(pos) else np.zeros(0, np.int64)
        self.lo, self.hi = new, np.append(new[1:], len(pos)) if len(pos) else new  # ranges of windows
        self.key = best[new]
        a, b = self.win[self.lo], self.win[self.hi - 1] if len(pos) else new
        self.seg = X.span_hashes(w.hashes, a, b + window) + X.mix((pos[new] - a).astype(np.uint64) + np.uint64(99)) if len(pos) else self.key
        self.row = np.searchsorted(w.first, a, "right") - 1

    def window_rows(self) -> np.ndarray:
        return np.repeat(self.row, self.hi - self.lo)


class Hot:
    """Statistics of the hot anchors over all documents."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        self.least = np.zeros(len(keys), np.int64)
        self.shared = np.zeros(len(keys), bool)
        self.pure = np.zeros(len(keys), bool)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is hot, index) of each key."""
        if not len(self.keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, at


def _blocks(batches: Iterator[pa.RecordBatch], pick) -> Iterator[pa.RecordBatch]:
    """Rows (key, seg, id) of the blocks that ``pick`` selects by key."""
    for b in batches:
        ids = b.column(0)
        known = np.asarray(ids.is_valid())
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for part in X.slices(b.column(1)):
            bl = Blocks(part.words())
            ok = known[part.first + bl.row] & pick(bl.key)
            if ok.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bl.key[ok].view(np.int64)), pa.array(bl.seg[ok].view(np.int64)), pa.array(ids[part.first + bl.row[ok]])],
                    names=["key", "seg", "id"])


def _cold_blocks(shared):
    return lambda batches: _blocks(batches, lambda key: ~shared.value.find(key)[0])


def _all_blocks(batches):
    return _blocks(batches, lambda key: np.ones(len(key), bool))


def _hot_stats(shared):
    """Per batch and hot key: smallest and largest id and block, so few rows are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, lambda key: shared.value.find(key)[0]):
            key, seg, ids = (b.column(i).to_numpy() for i in range(3))
            order = np.argsort(key, kind="stable")
            key, seg, ids = key[order], seg[order], ids[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at])] + [pa.array(f.reduceat(v, at)) for v in (ids, seg) for f in (np.minimum, np.maximum)],
                names=["key", "id0", "id1", "seg0", "seg1"])
    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by (key, seg, id) to replies (id, seg, whole): ``whole`` if an equal
    block is in a document of smaller id; otherwise, for the first document of each of
    several blocks of one anchor, the windows are to be looked up."""
    def replies(key, seg, ids):
        n = len(key)
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_seg = new_key | np.concatenate([[True], seg[1:] != seg[:-1]])
        kg, sg = np.cumsum(new_key) - 1, np.cumsum(new_seg) - 1
        least = ids[np.flatnonzero(new_seg)][sg]
        whole = ids > least
        ks = np.flatnonzero(new_key)
        mixed = (np.add.reduceat(new_seg.astype(np.int64), ks) > 1) & (np.minimum.reduceat(ids, ks) < np.maximum.reduceat(ids, ks))
        out = whole | (new_seg & mixed[kg]) if n else whole
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(seg[out]), pa.array(whole[out])], names=["id", "seg", "whole"])

    left = [np.zeros(0, np.int64)] * 3
    for b in batches:
        cols = [np.concatenate([c, b.column(i).to_numpy()]) for i, c in enumerate(left)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last key may go on in the next batch
        if cut:
            yield from replies(*(c[:cut] for c in cols))
        left = [c[cut:] for c in cols]
    if len(left[0]):
        yield from replies(*left)


def _member(rows: np.ndarray, values: np.ndarray, lists: pa.Array, first: int, n: int) -> np.ndarray:
    """Whether each value is in the list of its row."""
    part = lists.slice(first, n)
    flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(flat):
        return np.zeros(len(values), bool)
    code = lambda r, v: X.mix(v + X.mix(r.astype(np.uint64) + np.uint64(3)))
    return np.isin(code(rows, values), code(np.repeat(np.arange(n), size), flat))


def _open_windows(shared):
    """Windows (key, win, id, salt) of the blocks whose windows are to be looked up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        for b in batches:
            known = np.asarray(b.column(0).is_valid())
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for part in X.slices(b.column(1)):
                bl = Blocks(part.words())
                is_hot, at = hot.find(bl.key)
                open_ = _member(bl.row, bl.seg, b.column(3), part.first, part.n)
                if len(hot.keys):
                    open_ |= is_hot & hot.shared[at] & ~hot.pure[at]
                open_ &= known[part.first + bl.row]
                if open_.any():
                    size = bl.hi - bl.lo
                    pick = np.repeat(open_, size)
                    own = ids[part.first + np.repeat(bl.row, size)[pick]]
                    salt = np.where(np.repeat(is_hot, size)[pick], own % SALTS, 0).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(bl.key, size)[pick].view(np.int64)), pa.array(bl.win_hash[pick].view(np.int64)),
                         pa.array(own), pa.array(salt)], names=["key", "win", "id", "salt"])
    return run


def _factor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        names = ["doc_id", "n_words", "n_removed", "n_factors", "kept"]
        for b in batches:
            cols: list[list] = [[], [], [], []]
            known = np.asarray(b.column(0).is_valid())
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for part in X.slices(b.column(1)):
                w = part.words()
                bl = Blocks(w)
                whole = _member(bl.row, bl.seg, b.column(2), part.first, part.n)
                if len(hot.keys):
                    is_hot, at = hot.find(bl.key)
                    whole |= is_hot & hot.shared[at] & hot.pure[at] & (ids[part.first + bl.row] > hot.least[at])
                dup = np.repeat(whole, bl.hi - bl.lo)
                dup |= _member(bl.window_rows(), bl.win_hash, b.column(4), part.first, part.n)
                dup &= known[part.first + bl.window_rows()]
                gone = X.covered(len(w.starts), bl.win[dup], bl.window)
                removed = X.row_sums(gone, w.first)
                starts = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
                starts[w.first[:-1][w.counts > 0]] |= gone[w.first[:-1][w.counts > 0]]
                cols[0] += w.counts.tolist()
                cols[1] += removed.tolist()
                cols[2] += X.row_sums(starts, w.first).tolist()
                for i in range(part.n):
                    words = part.row_bytes(i).split()
                    if removed[i]:
                        words = [x for x, g in zip(words, gone[w.first[i]:w.first[i + 1]].tolist(), strict=True) if not g]
                    cols[3].append(b" ".join(words))
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=names)
    return run


def _hot_anchors(src: DataFrame) -> Hot:
    """The most frequent anchors of a hash sample of the documents, then their
    statistics over all documents. At most HOT_KEYS rows come to the driver."""
    sample = src.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    rows = (sample.mapInArrow(_all_blocks, "key long, seg long, id long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 8").orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect())
    hot = Hot(np.array([r["key"] for r in rows], np.int64).view(np.uint64))
    if len(hot.keys):
        stats = (src.mapInArrow(_hot_stats(src.sparkSession.sparkContext.broadcast(hot)), "key long, id0 long, id1 long, seg0 long, seg1 long")
                 .groupBy("key").agg(F.min("id0").alias("id0"), F.max("id1").alias("id1"), F.min("seg0").alias("seg0"), F.max("seg1").alias("seg1")))
        for r in stats.collect():
            k = int(np.searchsorted(hot.keys, np.array([r["key"]], np.int64).view(np.uint64))[0])
            hot.least[k], hot.shared[k], hot.pure[k] = r["id0"], r["id0"] < r["id1"], r["seg0"] == r["seg1"]
    return hot


def remove_duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors (maximal duplicate spans) and kept
    (the words left, joined by one space)."""
    src = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_hot_anchors(src))
    blocks = src.mapInArrow(_cold_blocks(shared), "key long, seg long, id long")
    replies = (blocks.repartition("key").sortWithinPartitions("key", "seg", "id")
               .mapInArrow(_resolve, "id long, seg long, whole boolean")
               .groupBy("id").agg(F.collect_list(F.when(F.col("whole"), F.col("seg"))).alias("whole"),
                                  F.collect_list(F.when(~F.col("whole"), F.col("seg"))).alias("open")))
    parsed = src.join(replies, "id", "left").select("id", "text", "whole", "open")
    windows = (parsed.mapInArrow(_open_windows(shared), "key long, win long, id long, salt int")
               .repartition("key", "win", "salt"))  # read twice from one exchange: for the index and for the look-up
    index = (windows.groupBy("key", "win").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max("salt").alias("top"))
             .filter("least < most").select("key", "win", "least", F.explode(
                 F.when(F.col("top") > 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")))
    found = (windows.join(index, ["key", "win", "salt"]).filter("id > least")
             .groupBy("id").agg(F.collect_set("win").alias("wins")))
    return (parsed.join(found, "id", "left").select("id", "text", "whole", "open", "wins")
            .mapInArrow(_factor(shared), "doc_id long, n_words long, n_removed long, n_factors long, kept binary"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_words, n_removed, kept_sha256, n_factors."""
    return remove_duplicate_spans(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_factors")
