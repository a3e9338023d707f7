"""Packing of tokenised documents into windows by multiway differencing.

Every document becomes the ids of its text and an end id. Stretches that fill a
window are windows of their own; the rests go to pools of at most
``POOL_WINDOWS`` windows' tokens, one after the other as a partition is read.
A pool is divided by Karmarkar-Karp differencing: every rest starts as a
partition of its own with one filled window, and the two partitions of the
largest imbalance are merged, the fullest window of one with the emptiest of
the other, until one is left. Its windows are near equal. An eighth of the rests
is cut by halving beforehand (large pieces leave an imbalance that small ones
fill). Where the fullest window passes the capacity, twice as many are cut, and
when all are, the window count rises.

One pass over the table in its own partitions, nothing is shuffled or
collected, and a task holds one pool. A window's id is the partition's number
and a counter, so a task that runs again gives the same windows.

Defined results: a null or empty text is a document of its end id; rows of
equal doc_id are documents of their own; null doc_ids stay null; an empty table
has no windows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import tokens as K

WINDOW = 2048
POOL_WINDOWS = 64
#: tokens a window may stay short on average in a full pool
SLACK = 4
#: rests below this many tokens are differenced in bundles of at most twice as many
BUNDLE = 32
_PIECES = ("doc_id long, start long, input_ids array<int>, doc_tokens long, sequence_id long, `offset` long, padded_length long")
_DIGESTS = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, padded_length long")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Items by window: Karmarkar-Karp differencing of the sizes into k windows."""
    # a window's content is a node: an item (its number) or a pair of nodes; -1 is an empty window
    pairs: list[tuple[int, int]] = []
    n = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        fill, node = np.zeros(k, np.int64), np.full(k, -1)
        fill[0], node[0] = s, i
        heap.append((-s, i, fill, node))
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    for step in range(n, 2 * n - 1):
        _, _, fill, node = heapq.heappop(heap)
        _, _, other, there = heapq.heappop(heap)
        fill, there = fill + other[::-1], there[::-1]
        both = np.flatnonzero((node >= 0) & (there >= 0))
        joined = np.where(node < 0, there, node)
        joined[both] = n + len(pairs) + np.arange(len(both))
        pairs += zip(node[both].tolist(), there[both].tolist(), strict=True)
        order = np.argsort(-fill, kind="stable")
        fill = fill[order]
        heapq.heappush(heap, (-int(fill[0] - fill[-1]), step, fill - fill[-1], joined[order]))
    out: list[list[int]] = []
    for c in heap[0][3].tolist():
        stack, own = [c] if c >= 0 else [], []
        while stack:
            c = stack.pop()
            if c < n:
                own.append(c)
            else:
                stack += pairs[c - n][::-1]
        out.append(own)
    return out


def halves(size: int) -> list[int]:
    """Sizes of a rest cut in half again and again, down to one token."""
    out = []
    while size > 1:
        out.append(size - size // 2)
        size //= 2
    return out + [size] * (size > 0)


def divide(sizes: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (rest, start in it, length) for rests shorter than a window.

    As few windows as the tokens need; rests are cut, more of them each time, until the
    fullest window holds, and when every rest is cut, the window count rises.
    """
    total = sum(sizes)
    k = max(1, -(-total // window))
    share = 1 / 8  # of the rests is cut; large and small items together difference to an even result
    while True:
        items: list[list[tuple[int, int, int]]] = []
        bundle: list[tuple[int, int, int]] = []
        held, taken = 0, 0.0
        for i, n in enumerate(sizes):
            taken += share
            if n < BUNDLE:
                bundle.append((i, 0, n))
                held += n
                if held >= BUNDLE:
                    items.append(bundle)
                    bundle, held = [], 0
                continue
            if taken >= 1.0:
                taken -= 1.0
                at = 0
                for part in halves(n):
                    items.append([(i, at, part)])
                    at += part
            else:
                items.append([(i, 0, n)])
        if bundle:
            items.append(bundle)
        weight = [sum(p[2] for p in it) for it in items]
        windows = differencing(weight, k)
        if max((sum(weight[i] for i in w) for w in windows), default=0) <= window:
            return [[p for i in w for p in items[i]] for w in windows if w]
        if share < 1.0:
            share = min(1.0, 2 * share)
        else:
            k += 1


class Packer:
    """Windows of one partition: ``add`` documents, each call yields (ids by piece) of closed windows."""

    def __init__(self, partition: int, window: int, pool_windows: int) -> None:
        self.window, self.limit = window, pool_windows * (window - min(SLACK, window // 256))
        self.next = partition << 33
        self.rests: list[tuple[int | None, int, np.ndarray, int]] = []
        self.held = 0

    def _emit(self, pieces: list[tuple[int | None, int, np.ndarray, int]]) -> Iterator[tuple]:
        at, size = 0, sum(len(p[2]) for p in pieces)
        padded = size if size & (size - 1) == 0 else self.window
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.next, at, padded
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        n, full = len(ids), len(ids) // self.window * self.window
        for a in range(0, full, self.window):
            yield from self._emit([(doc, a, ids[a:a + self.window], n)])
        if full < n:
            room = self.limit - self.held
            first = min(n - full, room)
            self.rests.append((doc, full, ids[full:full + first], n))
            self.held += first
            if self.held == self.limit:  # the rest that reaches the pool's limit is cut there
                yield from self.close()
                if full + first < n:
                    self.rests.append((doc, full + first, ids[full + first:], n))
                    self.held = n - full - first

    def close(self) -> Iterator[tuple]:
        for w in divide([len(r[2]) for r in self.rests], self.window):
            yield from self._emit([(self.rests[i][0], self.rests[i][1] + a, self.rests[i][2][a:a + n], self.rests[i][3]) for i, a, n in w])
        self.rests, self.held = [], 0


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    doc, start, ids, total, seq, offset, padded = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), lists, pa.array(total, pa.int64()),
                                       pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), pa.array(padded, pa.int64())], schema=schema)


def _pack(shared, end_id: int, window: int, pool_windows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("input_ids", pa.list_(pa.int32())), ("doc_tokens", pa.int64()),
                            ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64())])
        tok = K.ByteBpe(shared.value, plain_specials=False)
        end = np.array([end_id], np.int32)
        packer, rows, held = None, [], 0
        for b in batches:
            for doc, text, part in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if packer is None:
                    packer = Packer(part, window, pool_windows)
                for piece in packer.add(doc, np.concatenate([tok.ids(text.as_py() or ""), end])):
                    rows.append(piece)
                    held += len(piece[2])
                if held >= 1 << 18:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if packer is not None:
            rows += packer.close()
        if rows:
            yield _batch(rows, schema)
    return run


def pack(docs: DataFrame, tokenizer: str = K.BYTE_BPE, end_id: int = 1, window: int = WINDOW,
         pool_windows: int = POOL_WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), input_ids,
    doc_tokens, sequence_id, offset (its place in the window), and padded_length (the
    window's length with padding: the window size, or its own where that is a power of two)."""
    with open(tokenizer, encoding="utf-8") as f:  # 2 MB, shipped to the tasks
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(_pack(shared, end_id, window, pool_windows), _PIECES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(2)
        offs, values = ids.offsets.to_numpy(), ids.values.to_numpy()
        crc = [zlib.crc32(values[a:z].astype("<u4").tobytes()) for a, z in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64()),
                                          *(b.column(i) for i in range(3, 7))],
                                         names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])


def packed_digests(packed: DataFrame) -> DataFrame:
    """Pieces with length and CRC-32 of their ids (little-endian, 32 bits each) in place of the ids."""
    return packed.mapInArrow(_digests, _DIGESTS)
