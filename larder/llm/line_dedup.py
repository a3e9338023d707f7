"""Line deduplication by windows of neighbouring lines.

A window reaches from a line that holds words to the next one that does, with
the blank lines between them; its hash rolls over the hashes of its lines, and
every window of every document is looked up in the whole corpus. Of equal
windows the first (smallest doc_id, text hash, position) stays and the others
are removed after a comparison of their bytes. Windows overlap by a line, so
each repeated run of two or more word lines is found and goes from its first
to its last line, whatever its neighbours are. The first and the last window of
a document have a second form with the blank lines at the document's edge, so
an exact copy goes as a whole. A single repeated line stays.

Work moves as small rows (hash, document, position); window bytes are read only
for hashes that occur twice or more.

Defined results: null and empty texts have no window and stay; rows of equal
doc_id and equal text are the same document and are treated alike; null
doc_ids sort first; a document whose words are all removed is dropped by
:func:`deduplicate_lines`; an empty table gives an empty result; other columns
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import skew as S
from larder.llm import text as X

_NEWLINE = X.byte_class(separators=b"\n")


class Lines:
    """Lines of a slice: byte spans, hashes, and ``first[i]:first[i + 1]`` for row i."""

    def __init__(self, part: X.Slice) -> None:
        self.part = part
        self.ends = np.flatnonzero(~_NEWLINE[part.data])
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.first = np.searchsorted(self.starts, part.edges)
        words = np.concatenate([[0], np.cumsum(X.PLAIN[part.data])])
        self.full = words[self.ends] > words[self.starts]
        self.hashes = X.span_hashes(X._BYTE[part.data], self.starts, self.ends)

        self._windows: tuple[np.ndarray, ...] | None = None

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, position in the row, first line, end line) of all windows, by row and position."""
        if self._windows is None:
            at = np.flatnonzero(self.full)
            row = np.searchsorted(self.first, at, "right") - 1
            same = np.flatnonzero(row[1:] == row[:-1])
            row, a, z = row[same], at[same], at[same + 1] + 1
            edge = np.flatnonzero(row[1:] != row[:-1])
            head = np.concatenate([[0], edge + 1])[:len(row)]
            tail = np.concatenate([edge, [len(row) - 1]])[:len(row)]
            head, tail = head[a[head] > self.first[row[head]]], tail[z[tail] < self.first[row[tail] + 1]]
            a, z = np.concatenate([a, self.first[row[head]], a[tail]]), np.concatenate([z, z[head], self.first[row[tail] + 1]])
            row = np.concatenate([row, row[head], row[tail]])
            order = np.lexsort((z, a, row))
            row, a, z = row[order], a[order], z[order]
            pos = np.arange(len(row)) - np.searchsorted(row, row)
            self._windows = row, pos, a, z
        return self._windows

    def shared_chunks(self, i: int) -> Iterator[tuple[int, int, int]]:
        """(position, first line, end line) of row i's windows, which may be removed."""
        row, pos, a, z = self.windows()
        own = slice(*np.searchsorted(row, [i, i + 1]))
        yield from zip(pos[own].tolist(), a[own].tolist(), z[own].tolist(), strict=True)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, pos, h1, h2 = [], [], [], []
        for part in X.slices(b.column(2)):
            lines = Lines(part)
            r, k, a, z = lines.windows()
            rows.append(r + part.first)
            pos.append(k)
            h1.append(X.span_hashes(lines.hashes, a, z))
            h2.append(X.span_hashes(X.mix(lines.hashes + np.uint64(7)), a, z))
        if rows:
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(pos).astype(np.int32)),
                 pa.array(np.concatenate(h1).view(np.int64)), pa.array(np.concatenate(h2).view(np.int64))],
                names=["id", "th", "pos", "h1", "h2"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted windows of each document."""
    names = ["id", "th", "pos", "h1", "h2", "first", "body"]
    for b in batches:
        wanted = b.column(3).to_pylist()
        take: list[int] = []
        cols: list[list] = [[] for _ in names[2:]]
        for part in X.slices(b.column(2).field("text")):
            lines = Lines(part)
            row, _, a, z = lines.windows()
            own = np.searchsorted(row, np.arange(part.n))
            for i in range(part.n):
                for w in wanted[part.first + i]:
                    k = own[i] + w["pos"]
                    take.append(part.first + i)
                    body = part.data[lines.starts[a[k]]:lines.ends[z[k] - 1]].tobytes()
                    for c, v in zip(cols, (w["pos"], w["h1"], w["h2"], w["first"], body), strict=True):
                        c.append(v)
        if take:
            at = pa.array(take)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.binary())], names=names)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, drop = b.column(0).field("text"), b.column(1).to_pylist()
        n_lines, n_removed = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        new: dict[int, str] = {}
        left = np.zeros(len(b), bool)
        for part in X.slices(text):
            lines = Lines(part)
            n_lines[part.first:part.first + part.n] = np.diff(lines.first)
            row, _, a, z = lines.windows()
            own = np.searchsorted(row, np.arange(part.n))
            for i in range(part.n):
                keep = np.ones(lines.first[i + 1] - lines.first[i], bool)
                if gone := drop[part.first + i]:
                    for k in own[i] + np.array(gone):
                        keep[a[k] - lines.first[i]:z[k] - lines.first[i]] = False
                    at = np.flatnonzero(keep) + lines.first[i]
                    new[part.first + i] = b"\n".join(part.data[lines.starts[j]:lines.ends[j]].tobytes() for j in at).decode()
                    n_removed[part.first + i] = int((~keep).sum())
                left[part.first + i] = bool((keep & lines.full[lines.first[i]:lines.first[i + 1]]).any())
        clean = pa.array([new.get(i, t) for i, t in enumerate(text.to_pylist())], pa.string()) if new else text.cast(pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), clean, pa.array(n_lines), pa.array(n_removed), pa.array(left)],
                                         names=["row", "clean_text", "n_lines", "n_removed_lines", "has_words"])


def clean_lines(docs: DataFrame) -> DataFrame:
    """``row`` (the input row as a struct), clean_text, n_lines, n_removed_lines
    and has_words (words are left), for every row."""
    src = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text").cast("string")
    src = src.select(F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(text, F.lit(0)).alias("th"), "row")

    occ = src.select("id", "th", text.alias("text")).mapInArrow(_occurrences, "id long, th long, pos int, h1 long, h2 long")
    where = F.struct(F.col("id").isNotNull().alias("known"), "id", "th", "pos")
    # repeated windows: combined map-side, so a window in a third of all documents is one row per task
    rep = S.write_table(occ.groupBy("h1", "h2").agg(F.min(where).alias("lead"), F.max(where).alias("tail"),
                                                    F.count(F.lit(1)).alias("n"))
                        .filter("lead <> tail").select("h1", "h2", "lead", "n"), "repeated-windows")
    hot = S.hottest(rep, ["h1", "h2"], "n")
    found = S.salted_join(occ, rep, ["h1", "h2"], hot, "th").select(
        "id", "th", "pos", "h1", "h2", where.eqNullSafe(F.col("lead")).alias("first"))
    wanted = found.groupBy("id", "th").agg(F.collect_set(F.struct("pos", "h1", "h2", "first")).alias("wanted"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
    # both joins with the documents shuffle the same columns, so Spark reuses one exchange
    bodies = (src.join(wanted, same(src, wanted)).select(src["id"], src["th"], src["row"], wanted["wanted"])
              .mapInArrow(_bodies, "id long, th long, pos int, h1 long, h2 long, first boolean, body binary"))
    lead = bodies.filter("first").groupBy("h1", "h2").agg(F.first("body").alias("lead_body"))
    gone = (S.salted_join(bodies.filter("not first"), lead, ["h1", "h2"], hot, "th").filter(F.col("body") == F.col("lead_body"))
            .groupBy("id", "th").agg(F.collect_set("pos").alias("drop")))
    out = src.join(gone, same(src, gone), "left").select("row", "drop")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("clean_text", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_removed_lines", T.LongType()),
                           T.StructField("has_words", T.BooleanType())])
    return out.mapInArrow(_rebuild, schema)


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """All columns of the documents with repeated windows removed from ``text``
    (``n_chars``, where there is one, is that of the new text). Documents left
    without a word by the removal are dropped."""
    out = clean_lines(docs).filter((F.col("n_removed_lines") == 0) | F.col("has_words"))
    changed = F.col("n_removed_lines") > 0
    new = {"text": F.col("clean_text"),
           "n_chars": F.when(changed, F.length("clean_text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c)
                        for c in docs.columns])


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines and the digest of the kept text."""
    return clean_lines(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed_lines",
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))
