"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the normalised word sequences of the test items. Document
words are streamed through it and the longest suffix that occurs in any item
is tracked at every position. A match of at least ``window`` words (or a whole
shorter item) makes its words hit; a document whose hit words reach the
coverage limit is contaminated.

The walk restarts at the root wherever a pair of adjacent words is in no item,
so these places are found with array operations first and only the runs
between them, if long enough to hold a window, are walked word by word.

Items are test data of bounded size. They are shipped in blocks of at most
about ``block_bytes`` of text, one automaton per block; documents pass through
the blocks one after the other without a shuffle.

Defined results: null and empty texts have no words and no hits; null items
and items without words have no window; items of equal text are all reported;
repeated documents give repeated rows; an empty benchmark gives no hits; an
empty document table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import text as X

WINDOW = 13
COVERAGE = 20
BLOCK_BYTES = 1 << 20

_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())),
                       T.StructField("items", T.ArrayType(T.StringType()))])


def item_words(text: str | None) -> list[bytes]:
    for part in X.slices(pa.array([text or ""])):
        low = part.lower()
        w = low.words(X.ALNUM)
        return [low.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    return []


class Automaton:
    """Generalised suffix automaton over word ids, with the items that own each window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.vocab: dict[bytes, int] = {}
        pairs: set[tuple[int, int]] = set()
        seqs = []
        for item, text in items:
            seq = [self.vocab.setdefault(w, len(self.vocab)) for w in item_words(text)]
            if seq:
                seqs.append((item, seq))
                pairs.update(zip(seq, seq[1:], strict=False))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        self.least = min([window, *(len(s) for _, s in seqs)])
        self.owners: dict[int, set[str]] = {}     # state that holds a window -> items
        self.short: dict[int, list[tuple[int, str]]] = {}  # state -> (length, item) of shorter items
        for item, seq in seqs:
            v = 0
            for i, c in enumerate(seq):
                v = self.next[v][c]
                if i + 1 >= window:
                    self.owners.setdefault(self._holder(v, window), set()).add(item)
            if len(seq) < window:
                self.short.setdefault(self._holder(v, len(seq)), []).append((len(seq), item))
        # array forms for finding runs
        words = list(self.vocab)
        h = _word_hashes(words)
        order = np.argsort(h)
        self.word_hash, self.word_id = h[order], np.arange(len(words))[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[h >> np.uint64(48)] = True
        self.pair = np.array(sorted(a * len(words) + b for a, b in pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, ln = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if ln[q] == ln[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        ln.append(ln[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if ln[q] == ln[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _holder(self, v: int, length: int) -> int:
        """Suffix state of v whose lengths include ``length``."""
        while self.link[v] >= 0 and self.len[self.link[v]] >= length:
            v = self.link[v]
        return v

    def walk(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match ending there)."""
        v = n = 0
        for i, c in enumerate(seq):
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if c in self.next[v]:
                v = self.next[v][c]
                n += 1
            else:
                v = n = 0
            yield i, v, n

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans inside windows, and the items whose windows occur."""
        spans, items = [], set()
        for i, v, n in self.walk([self.vocab.get(w, -1) for w in words]):
            if n >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                items |= self.owners[self._holder(v, self.window)]
            if self.short and n:
                u = v
                while u > 0:
                    for length, item in self.short.get(u, ()):
                        if length <= n:
                            spans.append((i + 1 - length, i + 1))
                            items.add(item)
                    u = self.link[u]
        return spans, items

    def runs(self, w: X.Words) -> Iterator[tuple[int, int]]:
        """Word ranges of one row whose words and adjacent pairs all occur in the items."""
        h = w.hashes
        ids = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(48)])
        if not len(maybe):
            return
        at = np.minimum(np.searchsorted(self.word_hash, h[maybe]), len(self.word_hash) - 1)
        ok = self.word_hash[at] == h[maybe]
        ids[maybe[ok]] = self.word_id[at[ok]]
        known = ids >= 0
        joined = known[:-1] & known[1:]
        joined[w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < len(h))] - 1] = False
        cand = np.flatnonzero(joined)
        code = ids[cand] * len(self.vocab) + ids[cand + 1]
        if len(self.pair):
            at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            joined[cand[self.pair[at] != code]] = False
        else:
            joined[:] = False
        # a run starts at a known word not joined to the one before
        starts = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        stops = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        long = stops - starts >= self.least
        yield from zip(starts[long].tolist(), stops[long].tolist(), strict=True)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    return X.span_hashes(X._BYTE[np.frombuffer(b"".join(words), np.uint8)], starts, ends)


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: Automaton = shared.value
        for b in batches:
            n_words, hits, items = [], b.column(2).to_pylist(), b.column(3).to_pylist()
            for part in X.slices(b.column(0).field("text")):
                low = part.lower()
                w = low.words(X.ALNUM)
                n_words.append(w.counts)
                if not auto.vocab or not len(w.starts):
                    continue
                found: dict[int, tuple[set[int], set[str]]] = {}
                for a, z in auto.runs(w):
                    seq = [low.data[s:e].tobytes() for s, e in zip(w.starts[a:z], w.ends[a:z], strict=True)]
                    spans, owners = auto.match(seq)
                    if spans:
                        row = int(np.searchsorted(w.first, a, "right")) - 1
                        own = found.setdefault(row, (set(), set()))
                        for s, e in spans:
                            own[0].update(range(a + s - int(w.first[row]), a + e - int(w.first[row])))
                        own[1].update(owners)
                for row, (at, owners) in found.items():
                    i = part.first + row
                    hits[i] = sorted(at | set(hits[i] or ()))
                    items[i] = sorted(owners | set(items[i] or ()))
            if len(b):
                counts = pa.array(np.concatenate(n_words).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), counts, pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    names=["row", "n_words", "hits", "items"])
    return run


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the whole input row as a struct), n_words, hits (sorted word
    positions inside windows; null: none), items (sorted ids as strings; null: none)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, math.ceil(total / block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = docs.select(F.struct("*").alias("row"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in _FOUND])
    schema = T.StructType([T.StructField("row", docs.schema), *_FOUND])
    for k in range(blocks):
        # at most about block_bytes of test items reach the driver at a time
        rows = sorted((r["item"] or "", r["text"] or "") for r in items.filter(F.col("block") == k).collect())
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(Automaton(rows, window))), schema)
    return out


def _n_hit() -> Column:
    return F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).cast("long")


def _contaminated(coverage: int) -> Column:
    return (_n_hit() > 0) & (coverage * _n_hit() >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Contract rows: n_words, n_hit, n_items, items_sha256 and ``contaminated``
    (hit words times ``coverage`` reach the number of words)."""
    hit = find_hits(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return hit.select(F.col("row.doc_id").alias("doc_id"), "n_words", _n_hit().alias("n_hit"),
                      F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                      _contaminated(coverage).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of the documents under the coverage limit, unchanged."""
    return find_hits(docs, benchmark, window, block_bytes).filter(~_contaminated(coverage)).select("row.*")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, hits = b.column(1), b.column(2).to_pylist()
        out: dict[int, str] = {}
        for part in X.slices(texts):
            if any(hits[part.first:part.first + part.n]):
                w = part.lower().words(X.ALNUM)
                for i in range(part.n):
                    if got := hits[part.first + i]:
                        keep = np.ones(len(part.data), bool)
                        at = np.array(got) + w.first[i]
                        for k, p in enumerate(at):
                            # a run of hit words is cut with the characters between them
                            end = w.starts[p + 1] if k + 1 < len(at) and at[k + 1] == p + 1 else w.ends[p]
                            keep[w.starts[p]:end] = False
                        a, z = part.edges[i], part.edges[i + 1] - 1
                        out[part.first + i] = part.data[a:z][keep[a:z]].tobytes().decode()
        if out:
            texts = pa.array([out.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), texts, b.column(3)], names=["doc_id", "text", "n_removed"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents under the coverage limit with their matched spans cut out, as
    (doc_id, text, n_removed); documents over it are dropped."""
    hit = find_hits(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    ok = hit.filter(~_contaminated(coverage)).select("row.doc_id", "row.text", "hits", _n_hit().alias("n_removed"))
    return ok.mapInArrow(_cut, "doc_id long, text string, n_removed long")
