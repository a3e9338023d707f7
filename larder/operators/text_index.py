"""Substring search over a written trigram index.

The index has one row per (field, trigram, document) of the lower-cased texts, in
Parquet partitioned by a hash of the trigram, so a search reads the few files of
its own trigrams. Documents that hold all trigrams of the term in one field are
candidates (a superset of the matches: their postings are counted per field and
document), and only candidates are read in full and verified with ``contains`` or
``like``. Terms that give no trigram scan all rows; the rows found are the same
either way.

A posting list may hold any share of all documents: postings are counted by
(field, document), never gathered per trigram.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
#: Folders of the index; a trigram lies in one of them.
FOLDERS = 64


def _grams(text: Column) -> Column:
    """Distinct trigrams of a text (empty under three characters)."""
    n = F.length(text)
    at = F.when(n >= GRAM, F.sequence(F.lit(1), n - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))


def _folder(gram: Column) -> Column:
    return F.pmod(F.crc32(gram), F.lit(FOLDERS)).cast("int")


def write_index(docs: DataFrame, path: str, *, key: str, fields: list[str]) -> None:
    """Postings of the fields' trigrams. Null texts have none; a row with a null key
    can't be found again and has none either. Rows of equal key share their postings."""
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("text")) for f in fields]))
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), texts.alias("t")).filter("t.text IS NOT NULL")
    postings = rows.select("key", "t.field", F.explode(_grams(F.col("t.text"))).alias("gram")).withColumn("folder", _folder(F.col("gram")))
    # a folder is written by several tasks, so a frequent trigram is not one task's work
    (postings.repartition(F.col("folder"), F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("folder", "gram", "field", "key")
     .write.mode("overwrite").partitionBy("folder").parquet(path))


def literals(pattern: str, *, like: bool) -> list[str]:
    """The strings that every match holds: the whole term, or the parts of a LIKE
    pattern between its wildcards (an escaped character is a literal)."""
    if not like:
        return [pattern]
    parts, now = [], ""
    for escaped, wild, plain in re.findall(r"\\(.)|([%_])|(.)", pattern, flags=re.S):
        if wild:
            parts.append(now)
            now = ""
        else:
            now += escaped or plain
    return [p for p in [*parts, now] if p]


def candidates(spark: SparkSession, path: str, *, term: str, like: bool = False, fields: list[str] | None = None) -> DataFrame | None:
    """Keys of the documents that hold all trigrams of the (lower-case) term in one
    field; None where the term gives no trigram."""
    grams = sorted({s[i:i + GRAM] for s in literals(term, like=like) for i in range(len(s) - GRAM + 1)})
    if not grams:
        return None
    # folders are given as values, so the scan is pruned when it is planned
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    found = spark.read.parquet(path).filter(F.col("folder").isin(folders) & F.col("gram").isin(grams))
    if fields is not None:
        found = found.filter(F.col("field").isin(fields))
    hits = found.select("key", "field", "gram").distinct().groupBy("key", "field").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("n") == len(grams)).select("key").distinct()


def matching(docs: DataFrame, path: str, *, key: str, fields: list[str], term: str, like: bool = False) -> DataFrame:
    """Rows in which a field holds the term (any case): all rows of ``docs`` for which
    ``contains`` (or ``like``, with ``%`` around the term) is true for one of the fields.
    ``docs`` must be the indexed table, or a part of it."""
    low = term.lower()
    test = (lambda c: F.lower(c).like(f"%{low}%")) if like else (lambda c: F.lower(c).contains(F.lit(low)))
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(test(F.col(f).cast("string")), F.lit(False))
    keys = candidates(docs.sparkSession, path, term=low, like=like, fields=fields)
    if keys is not None:
        docs = docs.join(keys, docs[key] == keys["key"], "left_semi")
    return docs.filter(hit)
