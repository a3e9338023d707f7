"""Alignment of two tokenizers' tokens by shared byte offsets, divide and conquer.

Tokens of both vocabularies tile the same bytes (a space and the text). An
interval is divided at the offset nearest to its middle at which a token of
each ends: candidates are taken from the middle outwards and looked up among
the other side's ends by bisection; both halves are treated in the same way,
and an interval without a shared cut is a leaf group. All intervals of a level
are handled together as arrays.

Every A-B token pair of a group is a link. The distinct pairs of each document
are written once with their multiplicity; a pair's count (documents that hold
it) is a grouped count. Counts come back to the documents by two joins: pairs
that make up more than 1/``HOT_SHARE`` of all (document, pair) rows, fewer than
``HOT_SHARE`` by arithmetic, are broadcast; all others meet by a shuffle in
which no key holds more than that share.

Defined results: a null or empty text, or one whose joined tokens of either
side differ from space and text (control marks of a vocabulary inside it), has
no tokens: zeros and an empty digest; rows of equal doc_id are documents of
their own and are all counted; null doc_ids stay null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import skew as S
from larder.llm import tokens as K

#: documents are aligned together up to this many characters
GROUP_CHARS = 1 << 18
HOT_SHARE = 1 << 18
_ALIGNED = ("row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs array<long>, times array<long>")


def _outwards(lo: np.ndarray, hi: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, candidate) at distances reach .. 2 * reach from the middle, inside [lo, hi)."""
    mid = (lo + hi) // 2
    far = np.maximum(2 * reach, 1)
    a, b = np.maximum(lo, mid - far + 1), np.minimum(hi, mid + far)
    # [a, mid - reach] and [mid + reach, b): at reach 0 the middle alone
    left = np.maximum(0, np.minimum(mid - reach + 1, hi) - a)
    right = np.where(reach > 0, np.maximum(0, b - np.maximum(mid + reach, lo)), 0)
    count = left + right
    which = np.repeat(np.arange(len(lo)), count)
    k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, np.where(k < left[which], a[which] + k, mid[which] + reach[which] + k - left[which])


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of the A tokens at whose end a group closes, ascending. ``first`` are the
    first A tokens of the documents (and the total); a document's last token always closes."""
    lo, hi = first[:-1], first[1:] - 1
    cuts = [hi[hi >= lo]]
    lo, hi = lo[hi > lo], hi[hi > lo]
    while len(lo):  # one level: each interval finds the shared end nearest to its middle
        cut = np.full(len(lo), -1)
        open_, reach = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        while len(open_):
            which, cand = _outwards(lo[open_], hi[open_], reach)
            end = a_ends[cand]
            hit = np.flatnonzero(b_ends[np.searchsorted(b_ends, end)] == end)
            which, cand = which[hit], cand[hit]
            away = np.abs(cand - (lo[open_] + hi[open_])[which] // 2)
            order = np.lexsort((cand, away, which))
            which, cand = which[order], cand[order]
            lead = np.flatnonzero(np.diff(which, prepend=-1))
            cut[open_[which[lead]]] = cand[lead]
            reach = np.maximum(2 * reach, 1)
            left = (cut[open_] < 0) & (reach <= (hi[open_] - lo[open_] + 1) // 2)
            open_, reach = open_[left], reach[left]
        lo, hi, cut = lo[cut >= 0], hi[cut >= 0], cut[cut >= 0]
        cuts.append(cut)
        lo, hi = np.concatenate([lo, cut + 1]), np.concatenate([cut, hi])
        lo, hi = lo[hi > lo], hi[hi > lo]
    return np.sort(np.concatenate(cuts))


def group_edges(a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of every group, each with the total at the end."""
    cut = shared_cuts(a_ends, b_ends, first)
    return np.concatenate([[0], cut + 1]), np.concatenate([[0], np.searchsorted(b_ends, a_ends[cut]) + 1])


def _links(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id) of every link."""
    na, nb = np.diff(ga), np.diff(gb)
    n = na * nb
    group = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    i = k // nb[group]
    return group, a[ga[group] + i], b[gb[group] + k - i * nb[group]]


class _Decimals:
    """Decimal digits of token ids as bytes, each with a place for the separator behind it."""

    def __init__(self, n: int) -> None:
        shown = [str(i).encode() for i in range(n)]
        self.length = np.array([len(s) + 1 for s in shown], np.int64)
        self.digits = np.frombuffer(b"".join(s.ljust(len(shown[-1]) + 1) for s in shown), np.uint8).reshape(n, -1)

    def lines(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of ``a1,a2|b1;a3|b2;``, byte edge behind every group)."""
        na, nb = np.diff(ga), np.diff(gb)
        ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(gb[:-1], na)] = a
        ids[np.arange(len(b)) + np.repeat(ga[1:], nb)] = b
        sep[ga[1:] + gb[:-1] - 1] = ord("|")
        sep[ga[1:] + gb[1:] - 1] = ord(";")
        length = self.length[ids]
        ends = np.cumsum(length)
        cells = self.digits[ids]
        cells[np.arange(len(ids)), length - 1] = sep
        return cells[np.arange(cells.shape[1]) < length[:, None]], ends[ga[1:] + gb[1:] - 1]


def _joined(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def _align(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, model = shared.value
        A, B = K.ByteBpe(spec, plain_specials=True), K.PieceBpe(model)
        decimals = _Decimals(max(len(A.bytes), len(B.bytes)))
        bits = len(B.bytes).bit_length()
        wide = len(A.bytes).bit_length() + bits

        def aligned(docs: list[tuple]) -> pa.RecordBatch:
            empty = np.zeros(0, np.int64)
            toks = []
            for _, _, text in docs:
                a, b = empty, empty
                if text:
                    raw = b" " + text.encode()
                    a, b = A.ids(" " + text).astype(np.int64), B.ids(text).astype(np.int64)
                    if _joined(A.bytes, a) != raw or _joined(B.bytes, b) != raw:
                        a, b = empty, empty
                toks.append((a, b))
            n_a, n_b = np.array([len(t[0]) for t in toks]), np.array([len(t[1]) for t in toks])
            a, b = np.concatenate([t[0] for t in toks]), np.concatenate([t[1] for t in toks])
            first = np.concatenate([[0], np.cumsum(n_a)])
            n_groups, n_links = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            digest = [""] * len(docs)
            pairs, times, edges = empty, empty, np.zeros(len(docs) + 1, np.int32)
            if len(a):
                ga, gb = group_edges(np.cumsum(A.sizes[a]), np.cumsum(B.sizes[b]), first)
                row = np.searchsorted(first, ga[:-1], "right") - 1
                n_groups = np.bincount(row, minlength=len(docs))
                group, x, y = _links(a, b, ga, gb)
                key = np.sort(row[group] << wide | x << bits | y)
                lead = np.flatnonzero(np.diff(key, prepend=-1))
                times = np.diff(np.append(lead, len(key)))
                key = key[lead]
                owner, pairs = key >> wide, key & ((1 << wide) - 1)
                edges = np.searchsorted(owner, np.arange(len(docs) + 1)).astype(np.int32)
                n_links = np.bincount(row[group], minlength=len(docs))
                data, behind = decimals.lines(a, b, ga, gb)
                last = np.cumsum(n_groups)
                at = 0
                for i in np.flatnonzero(n_groups).tolist():
                    end = int(behind[last[i] - 1])
                    digest[i] = hashlib.sha256(data[at:end - 1].tobytes()).hexdigest()
                    at = end
            lists = lambda v: pa.ListArray.from_arrays(pa.array(edges), pa.array(v, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.int64()),
                 *(pa.array(v, pa.int64()) for v in (n_a, n_b, n_groups, n_links)), pa.array(digest), lists(pairs), lists(times)],
                names=[f.split()[0] for f in _ALIGNED.split(", ")])

        serial, held, size = 0, [], 0
        for batch in batches:
            for doc, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                held.append(((part << 33) + serial, doc, text))
                serial += 1
                size += len(text or "") + 1
                if size >= GROUP_CHARS:
                    yield aligned(held)
                    held, size = [], 0
        if held:
            yield aligned(held)
    return run


def align(docs: DataFrame, byte_bpe: str = K.BYTE_BPE, piece_bpe: str = K.PIECE_BPE) -> DataFrame:
    """One row per document: row_id, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and
    its distinct linked pairs (A id above the bits of B's vocabulary size) with their multiplicity."""
    with open(byte_bpe, encoding="utf-8") as f, open(piece_bpe, "rb") as g:  # 2 MB, shipped to the tasks
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(_align(shared), _ALIGNED)


def pair_counts(aligned: DataFrame, bits: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no pair of its A id has more)."""
    n = S.write_table(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    a = F.shiftright("pair", bits).alias("a")
    top = n.groupBy(a).agg(F.max("n").alias("top"))  # a row per id of A's vocabulary
    return n.select("pair", "n", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def cross_tokenizer_alignment(docs: DataFrame, byte_bpe: str = K.BYTE_BPE, piece_bpe: str = K.PIECE_BPE) -> DataFrame:
    """Digests of every document's groups and its links weighed by the corpus-wide counts."""
    with open(piece_bpe, "rb") as f:
        bits = len(K.PieceBpe(f.read()).bytes).bit_length()
    aligned = S.write_table(align(docs, byte_bpe, piece_bpe), "aligned")
    counts = S.write_table(pair_counts(aligned, bits), "pair-bests")
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > rows // HOT_SHARE + 1  # fewer than HOT_SHARE pairs can hold so large a share
    each = aligned.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row_id", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    hot_pairs = F.broadcast(counts.filter(hot))
    near = each.join(hot_pairs, "pair").groupBy("row_id").agg(*sums)
    far = each.join(hot_pairs, "pair", "left_anti").join(counts.filter(~hot), "pair").groupBy("row_id").agg(*sums)
    both = near.unionByName(far).groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(both, "row_id", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
