"""Keyed upserts that rewrite only the buckets they touch.

A store is a Parquet folder partitioned by a hash bucket of its id (the bucket
column's name carries the bucket count). An upsert reads the buckets of the changed
ids, writes the merged rows to the shared checkpoint folder and then replaces just these
partitions by dynamic partition overwrite; every other file stays as it is. The last
change of an id wins. A deleted id stays as a tombstone row, so that a bucket whose rows
all go is replaced too. Applying the same changes again gives the same rows, so a
repeated micro-batch, or one cut off in the middle, is mended by running it again.

Changes without an id are ignored. One writer at a time (the store has no locks).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir

BUCKETS = 256
_NAME = "bucket_of_{}"


def _write(df: DataFrame, path: str, bucket: str) -> None:
    (df.repartition(F.col(bucket)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(bucket).parquet(path))


def _bucket(id_col: str, n: int):
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("int")


def create_store(df: DataFrame, path: str, *, id_col: str, buckets: int = BUCKETS) -> None:
    """Write a new store of rows with unique, non-null ids; ``path`` must be new or empty."""
    rows = df.filter(F.col(id_col).isNotNull()).withColumn("deleted", F.lit(False))
    _write(rows.withColumn(_NAME.format(buckets), _bucket(id_col, buckets)), path, _NAME.format(buckets))


def _raw(spark: SparkSession, path: str) -> tuple[DataFrame, str, int]:
    df = spark.read.parquet(path)
    name = next(c for c in df.columns if re.fullmatch(_NAME.format(r"\d+"), c))
    return df, name, int(name.rsplit("_", 1)[1])


def read_store(spark: SparkSession, path: str, *, ids: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """Live rows of a store; with ``ids`` only those, read from their buckets."""
    df, name, n = _raw(spark, path)
    if ids is not None:
        wanted = ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
        df = df.filter(F.col(name).isin(_touched(wanted, id_col, n))).join(wanted, id_col, "left_semi")
    return df.filter(~F.col("deleted")).drop("deleted", name)


def _touched(changes: DataFrame, id_col: str, n: int) -> list[int]:
    return sorted(r[0] for r in changes.select(_bucket(id_col, n)).distinct().collect())  # at most n numbers


def upsert_store(spark: SparkSession, path: str, changes: DataFrame, *, id_col: str, seq_col: str, delete_col: str | None = None) -> list[int]:
    """Apply changes (the store's columns, ``seq_col`` for their order, ``delete_col`` true for
    deletes) and return the buckets that were rewritten. Columns that a change
    lacks become null; other columns of the changes are not stored."""
    stored, name, n = _raw(spark, path)
    gone = F.coalesce(F.col(delete_col), F.lit(False)) if delete_col else F.lit(False)
    order = Window.partitionBy(id_col).orderBy(F.desc(seq_col))
    last = (changes.filter(F.col(id_col).isNotNull()).withColumn("_rn", F.row_number().over(order)).filter("_rn = 1")
            .withColumn("deleted", gone).withColumn(name, _bucket(id_col, n)))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    last.select(*[F.col(c).cast(f.dataType).alias(c) if c in last.columns else F.lit(None).cast(f.dataType).alias(c)
                  for c, f in ((f.name, f) for f in stored.schema.fields)]).write.parquet(f"{root}/last")
    last = spark.read.parquet(f"{root}/last")
    buckets = sorted(r[0] for r in last.select(name).distinct().collect())  # at most n numbers
    if not buckets:
        return []
    kept = stored.filter(F.col(name).isin(buckets)).join(last.select(id_col), id_col, "left_anti").select(*stored.columns)
    kept.unionByName(last).write.parquet(f"{root}/merged")
    _write(spark.read.parquet(f"{root}/merged"), path, name)
    return buckets
