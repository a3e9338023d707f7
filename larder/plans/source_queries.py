"""Registered source / sink round trips (A2, A3, A6); rows-only checks.

They write under the session's shared checkpoint folder (set from
``spark.checkpoint.dir``; a local scratch folder only when it is unset)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.functions.text import slug_pipeline, unit_weight_from_name
from larder.operators import vectors as V
from larder.plans.registry import register
from larder.plans.sqlkit import avg_round
from larder.session import ensure_checkpoint_dir
from larder.sources import io
from larder.sources.views import RetailModel

# category_stats oracle plus the format that was written (Parquet: Delta is not installed)
ANALYTICS_ORACLE_WITH_FORMAT = f"""
SELECT c.category, count(*) AS product_count,
  {avg_round('p.price')} AS avg_price,
  CAST(min(p.price) AS DOUBLE) AS min_price, CAST(max(p.price) AS DOUBLE) AS max_price,
  round(stddev_samp(CAST(p.price AS DOUBLE)), 2) AS price_stddev,
  CAST(sum(CASE WHEN p.is_organic THEN 1 ELSE 0 END) AS BIGINT) AS organic_count,
  CAST(sum(CASE WHEN p.is_store_brand THEN 1 ELSE 0 END) AS BIGINT) AS store_brand_count,
  'parquet' AS format
FROM products p JOIN categories c ON p.category = c.category
GROUP BY c.category"""


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("json_catalog_roundtrip", """
SELECT category, count(*) AS products, round(sum(CAST(price AS DOUBLE)), 2) AS price_sum
FROM products GROUP BY category""")
def q_json_catalog_roundtrip(spark, d):
    """A3: products exported as products.json records and read back with the schema."""
    p = RetailModel(spark, d).products
    uw = unit_weight_from_name("name")
    recs = p.select("name", slug_pipeline("name").alias("slug"), "category", F.lower("category").alias("category_slug"),
                    F.split_part("name", F.lit(" "), F.lit(2)).alias("subcategory"), "brand",
                    F.col("price").cast("double").alias("price"), uw["unit"].alias("unit"),
                    uw["weight"].alias("weight"), "sku", "is_organic", "is_store_brand", "is_available",
                    "description", "tags")
    path = _scratch(spark, "products-json")
    recs.write.mode("overwrite").json(path)
    back = io.json_catalog_load(spark, path, io.PRODUCT_JSON_SCHEMA)
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("products"),
                                        F.round(F.sum("price"), 2).alias("price_sum"))


@register("table_write_roundtrip", ANALYTICS_ORACLE_WITH_FORMAT)
def q_table_write_roundtrip(spark, d):
    """A2: category statistics written (Delta requested, Parquet fallback) and read back."""
    from larder.operators.analytics import category_stats
    m = RetailModel(spark, d)
    path = _scratch(spark, "category-stats")
    fmt = io.table_write(category_stats(m.products, m.categories), path, fmt="delta")
    return spark.read.format(fmt).load(path).withColumn("format", F.lit(fmt))


@register("vector_collection_roundtrip", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, category FROM vectors""")
def q_vector_collection_roundtrip(spark, d):
    """Vectors written as a category-partitioned collection and read back whole
    (a filter on the category would prune to its partition)."""
    v = RetailModel(spark, d).vectors
    path = _scratch(spark, "vectors")
    V.vector_collection_write(v, path, partition_by="category")
    back = spark.read.parquet(path)
    return back.select("vec_id", F.size("embedding").alias("dim"), "category")
