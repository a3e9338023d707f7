"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles; two link when their Jaccard similarity is
at least 0.9 (an integer comparison). Equal sets are one class.

Routing: two linked sets differ in at most k shingles, so when the shingles
are dealt into more than k parts by hash, some part is equal. The hash of each
part's shingles is a key; classes that share a key meet in the block of the
key's smallest class. Parts are counted so that an equal part that is not
empty exists (a set with more empty parts than allowed also sends those), and
sets near the border of a size step send the keys of both steps. A key covers
several shingles, so a common passage alone does not bring texts together.

Search: in a block, the inverted lists of a query's shingles are split as in
DivideSkip. Short lists are merged and counted; candidates that can still
reach the required overlap T are then probed in the long lists by binary
search. Candidates already connected with the query are skipped, and a block
reports a star per component, never its pairs. Blocks above ``BLOCK_BYTES``
are searched as a grid of chunk pairs, so memory is bounded at any group size.

Defined results: null and empty texts have no shingles and are alone; fewer
words than a shingle are one shingle; rows of equal text are one class; a null
doc_id belongs to its class but is no component's id unless the class has no
other, and such a class takes part in no search; an empty table gives an empty
result; other columns are kept or not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import skew as S
from larder.llm import text as X
from larder.llm.components import components

SHINGLE = 3
#: similarity as a ratio of integers
NUM, DEN = 90, 100
BLOCK_BYTES = 1 << 20
LONG_LIST = 64  # inverted lists above this length may be probed instead of merged
HOT_KEYS, SAMPLE = 512, 64
_STEP = 1.35


def max_difference(total: int, num: int = NUM, den: int = DEN) -> int:
    """Largest symmetric difference of two linked sets whose sizes add up to ``total``."""
    return total * (den - num) // (den + num)


class Ladder:
    """Size steps; sets of step v are dealt into parts[v] parts, of which spare[v] may be empty."""

    def __init__(self, num: int = NUM, den: int = DEN, top: int = 1 << 31) -> None:
        self.num, self.den = num, den
        low = 1
        while max_difference(2 * low, num, den) < 1:
            low += 1
        lows = [low]
        while lows[-1] < top:
            lows.append(max(lows[-1] + 1, int(lows[-1] * _STEP)))
        self.lows = np.array(lows, np.int64)
        k = np.array([max_difference(2 * (b - 1), num, den) for b in lows[1:]] + [0], np.int64)
        self.spare = 1 + (k + 1) // 100
        self.parts = k + 1 + self.spare

    def steps(self, n: np.ndarray) -> list[np.ndarray]:
        """Own step of each size, and the next one where a partner may be in it (-1: none)."""
        own = np.searchsorted(self.lows, n, "right") - 1
        up = np.where(n * self.den >= self.num * self.lows[np.minimum(own + 1, len(self.lows) - 1)], own + 1, -1)
        return [own, up]


def shingle_sets(part: X.Slice, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice, sorted inside each row, and the offsets of the rows."""
    w = part.lower().words()
    at, g = w.grams(width)
    row = np.searchsorted(w.first, at, "right") - 1
    few = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(few):
        g = np.concatenate([g, X.span_hashes(w.hashes, w.first[few], w.first[few + 1])])
        row = np.concatenate([row, few])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])])
        g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(part.n + 1))


def set_hashes(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    out = []
    for salt in (1, 2):
        acc = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(X.mix(g + np.uint64(salt)), out=acc[1:])
        out.append(X.mix(acc[first[1:]] - acc[first[:-1]] + np.diff(first).astype(np.uint64)))
    return out[0], out[1]


def part_keys(g: np.ndarray, first: np.ndarray, rows: np.ndarray, steps: np.ndarray, ladder: Ladder) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the parts of ``rows``, each dealt as its step says."""
    rows = rows[steps[rows] >= 0]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    step = steps[rows]
    m, n = ladder.parts[step], first[rows + 1] - first[rows]
    base = np.concatenate([[0], np.cumsum(m)])
    pick = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    h = X.mix(g[pick] + np.uint64(77))
    flat = np.repeat(base[:-1], n) + (h % np.repeat(m, n).astype(np.uint64)).astype(np.int64)
    total = np.zeros(int(base[-1]), np.uint64)
    np.add.at(total, flat, X.mix(h))
    empty = np.bincount(flat, minlength=len(total)) == 0
    own = np.repeat(np.arange(len(rows)), m)
    part = np.arange(len(total)) - base[:-1][own]
    few = np.bincount(own[empty], minlength=len(rows)) <= ladder.spare[step]
    send = ~(empty & few[own])
    key = X.mix(total + X.mix((step[own] * (1 << 32) + part).astype(np.uint64) + np.uint64(5)))
    return rows[own[send]], key[send]


def _sketch(ladder: Ladder, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, h1s, h2s, rows, keys = [], [], [], [], []
            seen: set[tuple[int, int]] = set()
            for part in X.slices(b.column(1)):
                g, first = shingle_sets(part, width)
                n = np.diff(first)
                h1, h2 = set_hashes(g, first)
                lead = []
                for i, k in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if k not in seen:  # of equal sets in a batch only the first sends keys
                        seen.add(k)
                        lead.append(i)
                for steps in ladder.steps(n):
                    r, k = part_keys(g, first, np.array(lead, np.int64), steps, ladder)
                    rows.append(r + part.first)
                    keys.append(k)
                ns.append(n)
                h1s.append(h1)
                h2s.append(h2)
            if not ns:
                continue
            row, key = np.concatenate(rows), np.concatenate(keys)
            order = np.argsort(row, kind="stable")
            offs = np.searchsorted(row[order], np.arange(len(b) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(key[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(ns).astype(np.int64)), pa.array(np.concatenate(h1s).view(np.int64)),
                 pa.array(np.concatenate(h2s).view(np.int64)), lists], names=["id", "n", "h1", "h2", "keys"])
    return run


def t_occurrence(sets: list[np.ndarray], num: int = NUM, den: int = DEN, long_list: int = LONG_LIST,
                 skip: tuple[int, int] | None = None) -> list[int]:
    """Component root of each set under the links among ``sets`` (sorted hash arrays).

    Sets are queried in order of size against those before them. ``skip=(a, b)``:
    only pairs between the first a and the other b sets are of interest."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    rank = np.empty(len(sets), np.int64)
    rank[order] = np.arange(len(sets))
    side = (np.arange(len(sets)) >= skip[0])[order] if skip else None
    size = size[order]
    # inverted lists over ranks: one sorted array, list of a shingle = lists[start:stop]
    owner = np.repeat(rank, [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.lexsort((owner, values))
    lists, values = owner[at], values[at]
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    stops = np.append(new[1:], len(values))
    vocab = values[new]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q in range(1, len(sets)):
        n = int(size[q])
        if not n:
            continue
        low = int(np.searchsorted(size, -(-num * n // den)))  # smaller sets cannot link
        if low >= q:
            continue
        need = lambda m: -(-num * (n + m) // (den + num))  # noqa: E731  overlap required with a set of size m
        least = int(need(int(size[low])))
        own = np.searchsorted(vocab, sets[order[q]])
        a, z = new[own], stops[own]
        length = z - a
        if (length > 1).sum() < least:
            continue
        # DivideSkip: the longest lists, fewer than T of them, are probed
        by = np.argsort(length, kind="stable")
        n_long = min(least - 1, int((length > long_list).sum()))
        short, long = by[:len(by) - n_long], by[len(by) - n_long:]
        merged = np.concatenate([lists[a[k]:z[k]] for k in short]) if len(short) else np.zeros(0, np.int64)
        merged = merged[(merged >= low) & (merged < q)]
        count = np.bincount(merged - low, minlength=q - low)
        cand = np.flatnonzero(count >= max(1, least - n_long)) + low
        if side is not None:
            cand = cand[side[cand] != side[q]]
        mine = find(q)
        cand = np.array([c for c in cand.tolist() if find(c) != mine], np.int64)
        got, wanted = count[cand - low], need(size[cand])
        for i, k in enumerate(long[::-1] if len(cand) else ()):
            own_list = lists[a[k]:z[k]]
            p = np.minimum(np.searchsorted(own_list, cand), len(own_list) - 1)
            got = got + (own_list[p] == cand)
            alive = got + (n_long - 1 - i) >= wanted
            if not alive.all():
                cand, got, wanted = cand[alive], got[alive], wanted[alive]
                if not len(cand):
                    break
        for c in cand[got >= wanted].tolist():
            x, y = find(q), find(c)
            root[max(x, y)] = min(x, y)
    return [int(order[find(int(r))]) for r in rank]


def _search(num: int, den: int, width: int, long_list: int):
    """Rows sorted by (hub, ci, cj, chunk): links (u, v) of each cell as stars."""
    def solve(cell, nodes):
        ids = [x[0] for x in nodes]
        first = sum(x[1] == cell[1] for x in nodes)
        skip = (first, len(nodes) - first) if cell[1] != cell[2] else None
        roots = t_occurrence([x[2] for x in nodes], num, den, long_list, skip)
        return [(ids[i], ids[r]) for i, r in enumerate(roots) if ids[i] != ids[r]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes = None, []
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            out: list[tuple[int, int]] = []
            for part in X.slices(b.column(7)):
                g, offs = shingle_sets(part, width)
                h1, h2 = set_hashes(g, offs)
                for i in range(part.n):
                    j = part.first + i
                    if cols[5][j] != h1[i].view(np.int64) or cols[6][j] != h2[i].view(np.int64):
                        continue  # another text under the same doc_id
                    now = (cols[0][j], cols[1][j], cols[2][j])
                    if now != cell:
                        if len(nodes) > 1:
                            out += solve(cell, nodes)
                        cell, nodes = now, []
                    nodes.append((int(cols[4][j]), cols[3][j], g[offs[i]:offs[i + 1]].copy()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])
        if len(nodes) > 1 and (out := solve(cell, nodes)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])
    return run


def _hubs(keys: DataFrame) -> DataFrame:
    """(node, hub): each class and the smallest class with which it shares a key.
    The most frequent keys of a hash sample take no part in the shuffle by key;
    their hubs, counted over all rows, are broadcast."""
    hot = (keys.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
           .filter("n > 8").orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key"))
    hot = S.write_table(hot, "hot-keys")
    rest = keys.join(F.broadcast(hot), "key", "left_anti")
    per_key = Window.partitionBy("key")
    cold = rest.withColumn("hub", F.min("node").over(per_key)).select("node", "hub")
    heavy = keys.join(F.broadcast(hot), "key")
    least = heavy.groupBy("key").agg(F.min("node").alias("hub"))  # at most HOT_KEYS rows
    return cold.unionByName(heavy.join(F.broadcast(least), "key").select("node", "hub")).filter("node <> hub").distinct()


def _cells(members: DataFrame, block_bytes: int) -> DataFrame:
    """Members with the block cells they belong to: one cell for most blocks, and
    all pairs of chunks for a block whose sets exceed ``block_bytes``."""
    per_hub = S.write_table(members.groupBy("hub").agg(F.count(F.lit(1)).alias("w"), F.ceil(F.sum(F.col("n") * 8) / block_bytes).alias("chunks")), "blocks")
    chunk = F.pmod(F.xxhash64("h1", "h2"), F.col("chunks")).cast("int")
    return (S.salted_join(members, per_hub, ["hub"], S.hottest(per_hub, ["hub"], "w"), "h2").withColumn("chunk", chunk)
            .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
            .select("hub", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk",
                    F.col("rep").alias("id"), "h1", "h2"))


def link_components(docs: DataFrame, num: int = NUM, den: int = DEN, width: int = SHINGLE,
                    block_bytes: int = BLOCK_BYTES, long_list: int = LONG_LIST) -> DataFrame:
    """One row per input row: id, n (distinct shingles), h1, h2 (hashes of the set) and
    component_id, the smallest doc_id reachable by links."""
    src = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sketch = S.write_table(src.mapInArrow(_sketch(Ladder(num, den), width), "id long, n long, h1 long, h2 long, keys array<long>"),
                           "shingle-sketch")
    classes = S.write_table(sketch.filter("n > 0").groupBy("h1", "h2")
                            .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("w")), "classes")
    edges = S.write_table(_hubs(sketch.filter(F.size("keys") > 0).select(F.col("h1").alias("node"), F.explode("keys").alias("key"))), "hubs")
    members = (edges.unionByName(edges.select(F.col("hub").alias("node"), "hub").distinct())
               .join(classes.filter("rep is not null").select(F.col("h1").alias("node"), "h2", "rep", "n"), "node")
               .select("hub", F.col("node").alias("h1"), "h2", "rep", "n"))
    cells = _cells(members, block_bytes)
    links = (src.join(cells, "id").select("hub", "ci", "cj", "chunk", "id", "h1", "h2", "text")
             .repartition("hub", "ci", "cj").sortWithinPartitions("hub", "ci", "cj", "chunk", "id")
             .mapInArrow(_search(num, den, width, long_list), "u long, v long"))
    labels = components(links)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "w", F.coalesce("component", "rep").alias("component_id"))
    named = S.write_table(named, "named-classes")
    rows = sketch.select("id", "n", "h1", "h2")
    return (S.salted_join(rows.filter("n > 0"), named, ["h1", "h2"], S.hottest(named, ["h1", "h2"], "w"), "id")
            .select("id", "n", "h1", "h2", "component_id")
            .unionByName(rows.filter("n = 0").withColumn("component_id", F.col("id"))))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_shingles, component_id."""
    return link_components(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, width: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """All columns of the documents that are the smallest doc_id of their component
    under shingles of ``width`` words and similarity ``num / den``.
    Rows without a doc_id stay; rows of equal doc_id stay or go together."""
    gone = (link_components(docs, num, den, width).filter(F.coalesce(F.col("component_id") != F.col("id"), F.lit(False)))
            .select(F.col("id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
