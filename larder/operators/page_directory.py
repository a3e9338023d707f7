"""E2 by directory: deep pages that read only the partitions that hold them.

A table is written once, range-partitioned by its sort keys, with a directory of
row counts and running totals per partition. A page is then found in the directory
and read from the one or few partitions it touches; offset paging
(:func:`larder.operators.catalog.paginate`) would sort the whole table for each.

The sort keys must end in a unique one (an id), so that pages are stable and no run
of equal keys exceeds a partition. Nulls sort as in Spark: first ascending, last
descending. Pages behind the end, and pages of an empty table, have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "_part"


def _order(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.asc(name) if ascending else F.desc(name) for name, ascending in keys]


def write_page_directory(df: DataFrame, path: str, keys: list[tuple[str, bool]], *, rows_per_part: int = 1_000_000) -> None:
    """Write ``df`` sorted by ``keys`` ((column, ascending), composite allowed) below ``path``:
    ``rows`` in about count / rows_per_part range partitions, and their ``directory``."""
    parts = max(1, -(-df.count() // rows_per_part))
    (df.repartitionByRange(parts, *_order(keys)).withColumn(PART, F.spark_partition_id())
     .write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows"))
    df.limit(0).write.mode("overwrite").parquet(f"{path}/empty")  # keeps the schema of an empty table
    spark = df.sparkSession
    counts = spark.createDataFrame([], f"{PART} int, n long")
    if parts > 1 or df.take(1):
        counts = (spark.read.schema(f"{PART} int").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
                  .groupBy(PART).agg(F.count(F.lit(1)).alias("n")))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition, not per row
    (counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/directory"))


def page_parts(spark: SparkSession, path: str, *, page: int, size: int) -> list[tuple[int, int]]:
    """(partition, its first row's place) of the partitions that hold rows of the page; at most
    ``size`` of them."""
    lo, hi = (page - 1) * size, page * size
    d = spark.read.parquet(f"{path}/directory").filter((F.col("first") < hi) & (F.col("first") + F.col("n") > lo))
    return sorted((r[PART], r["first"]) for r in d.collect())


def read_page(spark: SparkSession, path: str, keys: list[tuple[str, bool]], *, page: int, size: int) -> DataFrame:
    """A page with the columns of :func:`paginate`: total_count, page, page_size, total_pages,
    has_next, has_previous."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    parts = page_parts(spark, path, page=page, size=size)
    rows = spark.read.parquet(f"{path}/empty")
    if parts:
        rows = (spark.read.schema(rows.schema).parquet(*[f"{path}/rows/{PART}={p}" for p, _ in parts])
                .orderBy(*_order(keys)).offset((page - 1) * size - parts[0][1]).limit(size))
    total = spark.read.parquet(f"{path}/directory").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    total_pages = F.ceil(total / F.lit(size)).cast("bigint")
    return (rows.withColumn("total_count", total).withColumn("page", F.lit(page)).withColumn("page_size", F.lit(size))
            .withColumn("total_pages", total_pages).withColumn("has_next", F.lit(page) < total_pages)
            .withColumn("has_previous", F.lit(page > 1)))
