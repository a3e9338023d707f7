"""Corpus pipeline over ``documents``: each stage calls one operator of
``larder.llm`` and works on all that its predecessor kept.

All stages but the last return the columns of ``documents``; the last returns
each document's rate with its token count, domain and posteriors. Empty tables
give empty results; the operators' docstrings state the other special cases.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larder.llm import decontam, line_dedup, mixing, ngram_join, quality
from larder.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose P(grade >= 1) is under one half go. Null and empty texts have no
    features and are judged by the thresholds alone; repeated rows stay or go together; a document graded
    more than once takes its lowest grade; without graded rows nothing goes."""
    return quality.keep_accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: runs of lines that an earlier document holds go; so do documents that this leaves without
    words. Null and empty texts stay; of equal runs the first by (doc_id, null first; text hash; position)
    stays; rows of equal doc_id and text are one document and are treated alike."""
    return line_dedup.deduplicate_lines(docs.select(*COLUMNS))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, with its contract's shingles and threshold: of each group the smallest doc_id stays.
    Null and empty texts are alone and stay; rows of equal doc_id stay or go together; rows without a
    doc_id stay."""
    return ngram_join.keep_one_of_each(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose benchmark passages reach the coverage limit go. Null and empty texts
    have no hits and stay; repeated rows stay or go together; an empty benchmark removes nothing."""
    return decontam.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a rate for each document, so that the languages reach their token weights. Null and
    empty texts have no tokens and the prior as posterior; a document labelled twice takes its smallest
    domain; repeated rows give repeated rows; without a usable domain every rate is 1."""
    return mixing.mix(docs, mixing.language_domains(docs, table(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
]

#: SQL cannot express the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet under the
    shared checkpoint folder and read again, which also cuts the lineage."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(path := f"{root}/{k}")
        docs = spark.read.parquet(path)
    return docs
