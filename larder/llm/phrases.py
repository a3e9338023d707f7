r"""Phrase collocations by weighted acyclic automata over word sequences.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\x0A-\x0D]`` and those
into words ``[^\x20\x09]+``. At every word a window of up to five words starts;
it ends with its piece, or in front of a word with which it is too rare for any phrase.
The windows of a shard, sorted and counted, are a count transducer whose states
are prefixes: a state's weight, the number of windows that pass it, is the
number of occurrences of that phrase. Shards ship their transducers as sorted
weighted strings; Spark deals them out by ranges of prefixes, and each range is
read in order while the union's states are built: a state is extended as long
as windows share its prefix, weights of equal strings add up, and it is closed
for good behind its last window. Only the states open at the two ends of a range
can go on in the neighbouring range; those are summed once more. So a phrase or
word that a third of all windows starts with is split over tasks like any other.

Part counts are looked up by composing: a transducer from each candidate to the
parts of its cuts meets the count transducer, as one join of parts with the
counted phrases (hot parts salted).

Windows are cut by four bit tables: one of the hashes of words that occur ``least``
times, three of the hash slots that two, three and four neighbouring words reach as often
(1 MB and three times 8 MB at any input size). A wrongly set bit costs work, never a row; on
an input so large that all slots are set, windows end at rare words and pieces.

A frequent window is in nearly every shard, so the rows shipped are about the shards times
the frequent windows, and both would grow with the input if each split of it were a shard.
So a core's splits go through one task, which ships when ``SHARD`` says so or at its end:
the rows grow with the frequent windows alone, the memory stays that of one shard.

Defined results: null texts are empty, a null ``lang`` is ``und``; repeated rows
and rows of equal or null doc_id all count; an empty table gives an empty result;
phrases of equal score and count rank by their UTF-8 bytes; other columns are
not read. All counts are exact; products are decimals of 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import skew as S
from larder.llm import text as X

LONGEST = 5
LEAST = 100
TOP = 2000
SLOT_BITS, PAIR_BITS = 23, 26
#: windows of a shard's transducer
SHARD = 1 << 20
#: longest run of words with a bit table of its own
LEVELS = 4
#: slots of runs of words counted together in a task
PAIRS = 1 << 21
_ID_BITS = 20

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_WORD = X.byte_class(separators=b" \t" + _SEPARATORS)
_BREAK = X.byte_class(words=_SEPARATORS)
_WORDS = "lang string, word string, slot int, n long"
_SLOT_COUNTS = "slot int, n long"
_WINDOWS = "lang string, path string, n long"


def _pieces(part: X.Slice) -> tuple[X.Words, np.ndarray]:
    """Words of lower-cased texts, and the number of each word's piece in the slice."""
    part = part.lower()
    words = part.words(_WORD)
    breaks = np.cumsum(_BREAK[part.data])
    return words, breaks[words.starts]


def _distinct(words: X.Words) -> tuple[np.ndarray, list[bytes]]:
    """(number of each word, the distinct words)."""
    size = words.ends - words.starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    body = np.zeros(len(words.part.data) + 1, np.int8)
    body[words.starts] += 1
    body[words.ends] -= 1
    data = words.part.data[np.cumsum(body[:-1]).astype(bool)]
    arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    d = arr.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def _slots(words: X.Words, lang: np.ndarray) -> np.ndarray:
    return (X.mix(words.hashes ^ lang) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32)


def _run_slots(words: X.Words, lang: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Slots of the runs of ``size`` words that start at ``at``."""
    h = words.hashes
    x = h[at] + lang[at]
    for k in range(1, size):
        x = X.mix(x) + h[at + k]
    return (X.mix(x) & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int32)


def _has(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return X.mix(np.array([zlib.crc32(x.encode()) for x in langs], np.uint64) + np.uint64(1))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b.column(0).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        salt = _lang_hashes(names)
        for part in X.slices(b.column(1), 1 << 20):
            words, _ = _pieces(part)
            if not len(words.starts):
                continue
            own = code[part.first + words.row]
            number, shown = _distinct(words)
            key, at, n = np.unique(own.astype(np.int64) << 32 | number, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names).take(pa.array(key >> 32)), pa.array(shown, pa.binary()).take(pa.array(key & 0xFFFFFFFF)).cast(pa.string()),
                 pa.array(_slots(words, salt[own])[at]), pa.array(n.astype(np.int64))], names=["lang", "word", "slot", "n"])


def _usable(words: X.Words, piece: np.ndarray, salt: np.ndarray, common: np.ndarray) -> np.ndarray:
    """First words of pairs inside a piece of which both words may be frequent enough."""
    use = _has(common, _slots(words, salt))
    return np.flatnonzero(use[:-1] & use[1:] & (piece[1:] == piece[:-1]))


def _runs(words: X.Words, piece: np.ndarray, salt: np.ndarray, common: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """First words of the runs of two, three ... words that may be frequent enough by the
    tables of these sizes; last, of those a word longer whose both parts may be."""
    found, start = [], _usable(words, piece, salt, common)
    for size, table in enumerate(tables, 2):
        start = start[_has(table, _run_slots(words, salt, start, size))]
        found.append(start)
        start = start[:-1][np.diff(start) == 1]
    return [*found, start]


def _count_slots(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the slots of pairs of words; with tables, of runs a word longer than the last table's of which both parts are in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, *tables = (np.frombuffer(t, np.uint8) for t in shared.value)
        held: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], names=["slot", "n"])

        for b in batches:
            langs = b.column(0).dictionary_encode()
            salts = _lang_hashes(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)]
            for part in X.slices(b.column(1)):
                words, piece = _pieces(part)
                salt = salts[part.first + words.row]
                held.append(_run_slots(words, salt, _runs(words, piece, salt, common, tables)[-1], len(tables) + 2))
                if sum(map(len, held)) >= PAIRS:
                    yield batch()
        if held:
            yield batch()
    return run


class Shard:
    """Count transducer of a task's windows: new windows are united with the counted ones
    when they are as many (at a quarter of ``SHARD`` first, at ``SHARD`` at the latest), and
    all are shipped when that leaves too many."""

    def __init__(self) -> None:
        self.word: dict[bytes, int] = {}
        self.lang: dict[str, int] = {}
        self.rows: list[np.ndarray] = []  # language, then words (0: none)
        self.counts: list[np.ndarray] = []
        self.n = self.united = 0

    def add(self, lang: np.ndarray, windows: np.ndarray) -> None:
        self.rows.append(np.column_stack([lang, windows]))
        self.counts.append(np.ones(len(lang), np.int64))
        self.n += len(lang)

    def full(self) -> bool:
        if self.n >= min(SHARD, max(SHARD // 4, 2 * self.united)):
            self._unite()
            self.united = self.n
        return self.united > SHARD * 3 // 4 or len(self.word) >= (1 << _ID_BITS) - SHARD // 4

    def _unite(self, rank: np.ndarray | None = None) -> None:
        """One row per distinct window, sorted by language and words (by number, or by ``rank``)."""
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        w = rows if rank is None else np.column_stack([rows[:, 0], rank[rows[:, 1:]]])
        pack = lambda *cols: np.bitwise_or.reduce([w[:, c].astype(np.int64) << i * _ID_BITS for i, c in enumerate(cols)])
        head, tail = pack(3, 2, 1), pack(5, 4, 0)
        at = np.lexsort((pack(5, 4), head, w[:, 0]))
        head, tail = head[at], tail[at]
        lead = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])]))
        self.rows, self.counts = [rows[at[lead]]], [np.add.reduceat(counts[at], lead)]
        self.n = len(lead)

    def close(self) -> Iterator[pa.RecordBatch]:
        """All distinct windows with their counts, sorted by language and words; the shard starts anew."""
        shown = pa.array([w.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if w.find(b"\x00") >= 0 or w.find(b"\x01") >= 0 else w
                          for w in self.word], pa.binary())
        order = pc.sort_indices(shown).to_numpy()
        rank = np.zeros(len(shown) + 1, np.int32)  # 0 is no word
        rank[order + 1] = np.arange(1, len(shown) + 1)
        self._unite(rank)
        langs = pa.array(list(self.lang))
        rows, counts = self.rows[0], self.counts[0]
        self.__init__()
        for k in range(0, len(rows), 1 << 16):
            part = rows[k:k + (1 << 16)]
            cols = [shown.take(pa.array(part[:, c] - 1, mask=part[:, c] == 0)) for c in range(1, LONGEST + 1)]
            path = pc.binary_join_element_wise(*cols, b"\x00", null_handling="skip")
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(part[:, 0])), path.cast(pa.string()), pa.array(counts[k:k + (1 << 16)])],
                                             names=["lang", "path", "n"])


def _windows(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, *tables = (np.frombuffer(t, np.uint8) for t in shared.value)
        shard = Shard()
        for b in batches:
            langs = b.column(0).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            salts = _lang_hashes(names)
            for part in X.slices(b.column(1)):
                words, piece = _pieces(part)
                own = code[part.first + words.row]
                salt = salts[own]
                runs = _runs(words, piece, salt, common, tables)[:-1]
                start = runs[0]
                if not len(start):
                    continue
                # a window goes on as long as each run of neighbouring words of it is usable
                size = np.zeros(len(piece), np.int64)
                for k, first in enumerate(runs, 2):
                    size[first] = k
                joined = np.zeros(len(piece) + 1, bool)
                joined[runs[-1]] = True
                ends = np.flatnonzero(~joined)
                size[runs[-1]] += ends[np.searchsorted(ends, runs[-1])] - runs[-1] - 1
                left = np.minimum(size[start], LONGEST)
                use = np.zeros(len(piece), bool)
                use[start] = use[start + 1] = True
                number, shown = _distinct(words)
                needed = np.zeros(len(shown), bool)
                needed[number[use]] = True
                local = np.zeros(len(shown), np.int32)
                for i in np.flatnonzero(needed).tolist():
                    local[i] = shard.word.setdefault(shown[i], len(shard.word)) + 1
                word = np.append(np.where(use, local[number], 0), np.zeros(LONGEST, np.int32)).astype(np.int32)
                windows = np.stack([np.where(left > k, word[start + k], 0) for k in range(LONGEST)], axis=1)
                mine = np.array([shard.lang.setdefault(x, len(shard.lang)) for x in names], np.int32)
                shard.add(mine[own[start]], windows)
                if shard.full():
                    yield from shard.close()
        if shard.n:
            yield from shard.close()
    return run


class Union:
    """Union of sorted count transducers over one range of prefixes, read in order.
    ``feed`` and ``finish`` return closed states (lang, path, weight) that reach
    ``least``, or that may go on beyond the range's ends (any weight)."""

    def __init__(self, least: int) -> None:
        self.least = least
        self.open: list[tuple | None] = [None] * (LONGEST + 1)  # by depth: (lang, words, weight, at the range's start)
        self.begun = False

    def feed(self, b: pa.RecordBatch) -> list[tuple[str, str, int]]:
        n = b.column(2).to_numpy()
        langs = b.column(0).dictionary_encode()
        split = pc.split_pattern(b.column(1), "\x00")
        edges, flat = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        size = np.diff(edges)
        shown = flat.dictionary.to_pylist()
        names = langs.dictionary.to_pylist()
        m = np.full((len(n), LONGEST + 1), -1, np.int64)
        m[:, 0] = langs.indices.to_numpy(zero_copy_only=False)
        ids = flat.indices.to_numpy(zero_copy_only=False)
        for k in range(LONGEST):
            has = size > k
            m[has, k + 1] = ids[edges[:-1][has] - edges[0] + k]
        new = np.ones((len(n), LONGEST + 1), bool)
        new[1:] = np.logical_or.accumulate(m[1:] != m[:-1], axis=1)
        closed = []

        def state(row: int, depth: int) -> tuple[str, tuple[str, ...]]:
            return names[m[row, 0]], tuple(shown[i] for i in m[row, 1:depth + 1].tolist())

        for d in range(2, LONGEST + 1):
            at = np.flatnonzero(new[:, d] & (size >= d))
            before = self.open[d]
            if not len(at):
                continue  # the open state stays open: its successor, if any, is compared by name
            weight = np.add.reduceat(np.where(size >= d, n, 0), at)
            lang, words = state(int(at[0]), d)
            start = not self.begun and at[0] == 0
            if before is not None:
                if before[:2] == (lang, words):
                    weight[0] += before[2]
                    start = before[3]
                else:
                    closed.append((before, d))
            for i in np.flatnonzero(weight[:-1] >= self.least).tolist():
                if i or not start:
                    closed.append(((*state(int(at[i]), d), int(weight[i]), False), d))
            if start and len(at) > 1:
                closed.append(((lang, words, int(weight[0]), True), d))
            lang, words = state(int(at[-1]), d)
            self.open[d] = (lang, words, int(weight[-1]), start and len(at) == 1)
        self.begun = True
        return [(x[0], "\x00".join(x[1]), x[2]) for x, _ in closed if x[3] or x[2] >= self.least]

    def finish(self) -> list[tuple[str, str, int]]:
        return [(x[0], "\x00".join(x[1]), x[2]) for x in self.open if x is not None]


def _union(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(states: list[tuple]) -> pa.RecordBatch:
            lang, path, n = zip(*states, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(path, pa.string()), pa.array(n, pa.int64())],
                                              names=["lang", "path", "n"])
        union = Union(least)
        for b in batches:
            if len(b) and (states := union.feed(b)):
                yield batch(states)
        if states := union.finish():
            yield batch(states)
    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, slot and n of every word."""
    return S.write_table(_rows(docs).mapInArrow(_count_words, _WORDS).groupBy("lang", "word")
                         .agg(F.max("slot").alias("slot"), F.sum("n").alias("n")), "word-counts")


def _bit_table(slots: DataFrame, bits: int) -> bytes:
    """Bit table of the column ``slot``, put together from its blocks of 4 KB."""
    blocks = (slots.groupBy(F.shiftright("slot", 15).alias("block"))
              .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767).cast("long")).alias("bits")).collect())
    table = bytearray(1 << (bits - 3))
    for r in blocks:
        table[r["block"] << 12:(r["block"] + 1) << 12] = r["bits"]
    return bytes(table)


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, path (words joined by U+0000, which is escaped inside words) and f of all
    phrases of two to ``LONGEST`` words that occur ``least`` times or more."""
    spark, rows = docs.sparkSession, _rows(docs)
    common = _bit_table(words.filter(F.col("n") >= least), SLOT_BITS)
    tables = [common]
    while len(tables) < LEVELS:
        slots = (rows.mapInArrow(_count_slots(spark.sparkContext.broadcast(tuple(tables))), _SLOT_COUNTS)
                 .groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
        tables.append(_bit_table(slots, PAIR_BITS))
    shared = spark.sparkContext.broadcast(tuple(tables))
    cores = spark.sparkContext.defaultParallelism
    shards = S.write_table(rows.coalesce(cores).mapInArrow(_windows(shared), _WINDOWS), "shard-windows")
    ranges = shards.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    states = ranges.mapInArrow(_union(least), _WINDOWS)
    return S.write_table(states.groupBy("lang", "path").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "phrase-counts")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    words = word_counts(docs)
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    escaped = F.replace(F.replace("word", F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    phrases = phrase_counts(docs, words, least)
    counted = phrases.unionByName(words.filter(F.col("n") >= least).select("lang", escaped.alias("path"), F.col("n").alias("f")))

    # a phrase inside a longer one that is as frequent: it is inside one that is a word longer, too
    w = F.split("path", "\x00")
    piece = lambda a, n: F.array_join(F.slice(w, a, n), "\x00")
    inner = F.explode(F.array(piece(F.lit(1), F.size(w) - 1), piece(F.lit(2), F.size(w) - 1)))
    longer = phrases.filter(F.size(w) > 2).select("lang", inner.alias("path"), "f").groupBy("lang", "path").agg(F.max("f").alias("most"))
    kept = (phrases.join(longer, ["lang", "path"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("f")))
            .select("lang", "path", F.col("f").alias("a")))

    cut = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.struct(
        k.alias("k"), F.array(piece(F.lit(1), k), piece(k + 1, F.size(w) - k)).alias("parts")))
    parts = (kept.select("lang", "path", "a", F.explode(cut).alias("c"))
             .select("lang", F.col("path").alias("whole"), "a", "c.k", F.posexplode("c.parts").alias("side", "path")))
    parts = S.write_table(parts, "phrase-parts")
    hot = S.hottest(parts.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("uses")), ["lang", "path"], "uses")
    found = S.salted_join(parts, counted, ["lang", "path"], hot, "whole")
    by_cut = found.groupBy("lang", "whole", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"),
                                                          F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    # exact whole numbers: counts stay under 10^17, the dividend under 10^37
    scored = by_cut.join(total, "lang").select("lang", "whole", "a", "k", "l", "r", F.col("total").alias("n"), F.expr(
        "cast(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(total as decimal(17,0)) as decimal(38,0)) "
        "div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))").alias("score"))
    best = scored.groupBy("lang", "whole", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    shown = best.select("lang", F.replace(F.replace(F.translate("whole", "\x00", " "), F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))
                        .alias("phrase"), "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (shown.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
