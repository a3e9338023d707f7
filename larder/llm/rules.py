"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements
and one long of failure bits; a policy is a named mask over these bits, so
policies are applied, compared and ablated with bitwise operations and plain
aggregates, without reading the texts again.

Defined results: a null or empty text has no words, all measurements 0, and
fails ``few_words``; a null ``doc_id`` stays null; repeated rows give repeated
rows; an empty table gives an empty ledger; columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import skew as S
from larder.llm import text as X

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
_SYMBOLS = X.byte_class(words=b"#*$%&|<>")
_UPPER = X.byte_class(words=bytes(range(65, 91)))
_NEWLINE = X.byte_class(separators=b"\n")

#: rule -> SQL condition under which a document fails it; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeat_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "dup_lines": "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines",
    "short_mean_word": "word_chars < 2 * n_words",
    "long_mean_word": "word_chars > 15 * n_words",
    "shouting": "10 * n_upper > 5 * word_chars",
}
#: policy version -> the rules whose failure drops a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeat_words"),
    "v1": ("few_words", "repeat_words", "symbols", "dup_lines", "short_mean_word", "long_mean_word", "shouting"),
}


def mask_of(rules: tuple[str, ...], catalogue: dict[str, str] = RULES) -> int:
    names = list(catalogue)
    return sum(1 << names.index(r) for r in rules)


def _measure_slice(part: X.Slice) -> list[np.ndarray]:
    words = part.words()
    n = words.counts
    data = part.data
    inside = X.PLAIN[data]
    lead = (data & 0xC0) != 0x80  # first byte of a code point
    chars = X.row_sums(inside & lead, part.edges)
    symbols = X.row_sums(_SYMBOLS[data], part.edges)
    upper = X.row_sums(_UPPER[data], part.edges)

    # lines: byte spans between line feeds (a row's closing line feed ends its last line)
    ends = np.flatnonzero(~_NEWLINE[data])
    starts = np.concatenate([[0], ends[:-1] + 1])
    word_bytes = np.concatenate([[0], np.cumsum(inside)])
    full = word_bytes[ends] > word_bytes[starts]
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(part.edges, starts, "right") - 1
    _, again = X.repeated(X.span_hashes(X._BYTE[data], starts, ends), row)
    lines = np.bincount(row, minlength=part.n)
    dup = np.bincount(row[again], minlength=part.n)

    at, grams = words.grams(5)
    owner = words.row
    twice, _ = X.repeated(grams, owner[at])
    cover = X.covered(len(owner), at[twice], 5)
    rep = np.bincount(owner[cover], minlength=part.n)
    return [n, chars, symbols, dup, rep, lines, upper]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [_measure_slice(s) for s in X.slices(b.column(1))]
        if got:
            cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """One row of measurements per document, over whole texts."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, _SCHEMA)


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Measurements plus ``fail_bits``: bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for i, cond in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


def fails(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(led: DataFrame, version: str, policies: dict[str, tuple[str, ...]] = POLICIES,
                 rules: dict[str, str] = RULES) -> DataFrame:
    """Ledger with ``kept`` under one policy version."""
    return led.withColumn("kept", ~fails(mask_of(policies[version], rules))).withColumn("policy", F.lit(version))


def ablation(led: DataFrame, version: str, policies: dict[str, tuple[str, ...]] = POLICIES,
             rules: dict[str, str] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, documents that only it drops,
    and documents kept with the policy and without this rule. One aggregate
    over the distinct failure masks; no rows without documents."""
    return _ablate(mask_counts(led), version, policies, rules)


def mask_counts(led: DataFrame) -> DataFrame:
    """Documents of each failure mask: at most 2 to the number of rules rows."""
    return led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))


def ablations(led: DataFrame, policies: dict[str, tuple[str, ...]] = POLICIES, rules: dict[str, str] = RULES) -> DataFrame:
    """:func:`ablation` of every policy version, with ``policy``, over one reading of the ledger."""
    counts = S.write_table(mask_counts(led), "failure-masks")
    parts = [_ablate(counts, version, policies, rules).withColumn("policy", F.lit(version)) for version in policies]
    return functools.reduce(DataFrame.unionByName, parts)


def _ablate(counts: DataFrame, version: str, policies: dict[str, tuple[str, ...]], rules: dict[str, str]) -> DataFrame:
    names, mask = policies[version], mask_of(policies[version], rules)
    per_mask = counts.select(F.col("fail_bits").alias("bits"), F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("m"), "n")
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of((r,), rules)).cast("long").alias("bit"))
                               for r in names])).alias("r")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    bit = F.col("r.bit")
    return (per_mask.select("m", "n", rows).groupBy(F.col("r.rule").alias("rule"))
            .agg(count(F.col("m").bitwiseAND(bit) != 0).alias("n_failed"),
                 count(F.col("m") == bit).alias("n_only_this"),
                 count(F.col("m") == 0).alias("n_kept"),
                 count((F.col("m") == 0) | (F.col("m") == bit)).alias("n_kept_without")))


def quality_rules(docs: DataFrame, version: str = "v1") -> DataFrame:
    """Contract rows: the four base measurements, ``base_failed`` and ``kept``
    (false if the base fails, else the policy's verdict), with the ledger's bits."""
    out = apply_policy(ledger(docs), version)
    base = fails(mask_of(POLICIES["base"]))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "fail_bits", "n_lines", "n_upper")
