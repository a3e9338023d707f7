"""Sources and sinks (A1-A3, A9): JDBC tables, table writes, JSON catalogues
and queue-message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Catalogue file schemas (products.json / deals.json records).
PRODUCT_JSON_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("slug", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("category_slug", T.StringType()),
    T.StructField("subcategory", T.StringType()), T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()), T.StructField("unit", T.StringType()),
    T.StructField("weight", T.StringType()), T.StructField("sku", T.StringType()),
    T.StructField("is_organic", T.BooleanType()), T.StructField("is_store_brand", T.BooleanType()),
    T.StructField("is_available", T.BooleanType()), T.StructField("description", T.StringType()),
    T.StructField("tags", T.StringType()),
])
DEAL_JSON_SCHEMA = T.StructType([
    T.StructField("product_sku", T.StringType()), T.StructField("deal_type", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("discount_percent", T.IntegerType()), T.StructField("discount_amount", T.DoubleType()),
    T.StructField("buy_quantity", T.IntegerType()), T.StructField("get_quantity", T.IntegerType()),
    T.StructField("start_date", T.StringType()), T.StructField("end_date", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
])
# Queue messages.
PRODUCT_MESSAGE_SCHEMA = T.StructType([T.StructField("ProductId", T.StringType()),
                                       T.StructField("Action", T.StringType())])
ORDER_MESSAGE_SCHEMA = T.StructType([T.StructField("OrderId", T.StringType()),
                                     T.StructField("NewStatus", T.StringType()),
                                     T.StructField("UserId", T.StringType()),
                                     T.StructField("MessageId", T.StringType())])


def jdbc_load(spark: SparkSession, url: str, table: str, *, user: str | None = None,
              password: str | None = None, driver: str | None = None,
              partition: tuple[str, int, int, int] | None = None, fetchsize: int = 10000) -> DataFrame:
    """A1: one table by (quoted) name. ``partition`` = (column, lower, upper,
    num_partitions) turns the single-connection scan into parallel range
    scans, the only way a large table is read by more than one task."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f'"{table}"').option("fetchsize", fetchsize)
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            r = r.option(k, v)
    if partition:
        col, lo, hi, n = partition
        r = (r.option("partitionColumn", col).option("lowerBound", lo)
             .option("upperBound", hi).option("numPartitions", n))
    return r.load()


def table_write(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "overwrite",
                fallback: str | None = "parquet", partition_by: list[str] | None = None) -> str:
    """A2: write a result table; when the requested format's data source is
    not installed (e.g. Delta without its jars) fall back to ``fallback``.
    Every other error propagates. Returns the format written."""
    def write(f: str) -> None:
        w = df.write.mode(mode).format(f)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.save(path)
    try:
        write(fmt)
        return fmt
    except Exception as e:  # noqa: BLE001 - narrowed below
        missing = "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find data source" in str(e)
        if fallback is None or fallback == fmt or not missing:
            raise
        write(fallback)
        return fallback


def json_catalog_load(spark: SparkSession, path: str, schema: T.StructType, *, multiline: bool = False) -> DataFrame:
    """A3: read catalogue JSON with an explicit schema (no inference pass).
    JSON lines (default) split across tasks; ``multiline=True`` reads files
    that hold one JSON array each (one task per file)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def queue_source(spark: SparkSession, path: str | None, schema: T.StructType, *, fmt: str = "json",
                 max_files_per_trigger: int | None = None, options: dict[str, str] | None = None,
                 rejects: bool = False) -> DataFrame:
    """Queue messages as a stream of JSON text files (one message per line),
    or of another source with a ``value`` column such as Kafka (``fmt="kafka"``,
    servers and topic in ``options``, no path). The text is parsed with
    ``from_json``; messages that do not parse, or lack the first field, go to
    the stream of ``rejects=True`` (their text in ``value``)."""
    r = spark.readStream.format("text" if fmt == "json" else fmt).options(**(options or {}))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = (r.load(path) if path else r.load()).select(F.col("value").cast("string").alias("value"))
    parsed = raw.select("value", F.from_json("value", schema).alias("m"))
    good = F.col("m").isNotNull() & F.col(f"m.{schema.fields[0].name}").isNotNull()
    return parsed.filter(~F.coalesce(good, F.lit(False))).select("value") if rejects else parsed.filter(good).select("m.*")
