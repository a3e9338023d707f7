"""Catalogue and deal aggregations (notebook analytics and staff counts).

All aggregations are plain ``groupBy().agg()``: Spark plans a partial
(map-side) aggregate before the shuffle, so a hot category or brand costs one
row per partition on the wire, never one row per product.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flag_count(c: str) -> Column:
    return F.sum(F.when(F.col(c), 1).otherwise(0)).cast("bigint")


def products_in_categories(prod: DataFrame, cat: DataFrame) -> DataFrame:
    """Products inner-joined to their category row (dimension side is tiny;
    AQE turns the join into a broadcast from the measured size)."""
    return prod.join(cat.select("category", F.col("slug").alias("category_slug"),
                                "display_order", F.col("is_active").alias("category_active")),
                     "category", "inner")


def category_stats(prod: DataFrame, cat: DataFrame) -> DataFrame:
    """Per category count, avg/min/max price (2 dp), sample stddev,
    organic and store-brand counts, ordered by category."""
    return (products_in_categories(prod, cat)
            .groupBy("category")
            .agg(F.count(F.lit(1)).alias("product_count"),
                 F.round(F.avg("price"), 2).alias("avg_price"),
                 F.round(F.min("price"), 2).alias("min_price"),
                 F.round(F.max("price"), 2).alias("max_price"),
                 F.round(F.stddev_samp("price"), 2).alias("price_stddev"),
                 _flag_count("is_organic").alias("organic_count"),
                 _flag_count("is_store_brand").alias("store_brand_count"))
            .orderBy("category"))


def brand_frequency(prod: DataFrame, *, k: int = 30) -> DataFrame:
    """Non-null brands with product count and avg price; top k by count
    (brand breaks ties so the cut is deterministic)."""
    return (prod.filter(F.col("brand").isNotNull())
            .groupBy("brand")
            .agg(F.count(F.lit(1)).alias("product_count"),
                 F.round(F.avg("price"), 2).alias("avg_price"))
            .orderBy(F.desc("product_count"), F.asc("brand"))
            .limit(k))


def price_histogram(prod: DataFrame, *, width: int = 5) -> DataFrame:
    """D3: bucket = floor(price / width) * width, count per bucket."""
    return (prod.withColumn("price_bucket",
                            (F.floor(F.col("price") / F.lit(width)) * F.lit(width)).cast("bigint"))
            .groupBy("price_bucket").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("price_bucket"))


def deal_stats(deals: DataFrame) -> DataFrame:
    """Active-flag deals by type: count and avg discount (1 dp, nulls ignored)."""
    return (deals.filter(F.col("is_active"))
            .groupBy("deal_type")
            .agg(F.count(F.lit(1)).alias("deal_count"),
                 F.round(F.avg("discount_percent"), 1).alias("avg_discount_pct"))
            .orderBy("deal_type"))


def deals_by_category(deals: DataFrame, prod: DataFrame, cat: DataFrame) -> DataFrame:
    """D5 (over C2): deal x product x category, by category and deal type."""
    joined = (deals.join(prod.select("product_id", "category", "price"), "product_id", "inner")
              .join(cat.select("category"), "category", "inner"))
    return (joined.groupBy("category", "deal_type")
            .agg(F.count(F.lit(1)).alias("deal_count"),
                 F.round(F.avg("price"), 2).alias("avg_product_price"),
                 F.round(F.avg("discount_percent"), 1).alias("avg_discount"))
            .orderBy("category", "deal_type"))


def deal_conversion(items: DataFrame) -> DataFrame:
    """One scan for item count, items with a deal and the rate in percent.
    An empty input yields a null rate, never a division by zero."""
    return (items.agg(F.count(F.lit(1)).alias("total_items"),
                      F.count("deal_id").alias("deal_items"))
            .withColumn("conversion_pct",
                        F.try_divide(F.lit(100.0) * F.col("deal_items"),
                                     F.col("total_items").cast("double"))))


def revenue_impact(items: DataFrame, deals: DataFrame) -> DataFrame:
    """D7 (over C3): items left-joined to their deal, grouped by deal type with
    the no-deal rows as their own (null) group. Items are summed by deal first,
    so the items without one (most) are a single row of the join."""
    per_deal = items.groupBy("deal_id").agg(F.count(F.lit(1)).alias("n"), F.count("line_total").alias("priced"),
                                            F.sum("line_total").alias("total"))
    joined = per_deal.join(deals.select("deal_id", "deal_type"), "deal_id", "left")
    mean = F.try_divide(F.sum("total"), F.sum("priced"))  # six digits first, like avg() of DECIMAL(_, 2)
    return (joined.groupBy("deal_type")
            .agg(F.sum("n").alias("items_sold"),
                 F.round(F.sum("total"), 2).alias("total_revenue"),
                 F.round(F.round(mean, 6), 2).alias("avg_item_revenue"))
            .orderBy(F.asc_nulls_first("deal_type")))


def _available_in_category(prod: DataFrame, cat: DataFrame, category: str | None) -> DataFrame:
    p = products_in_categories(prod, cat).filter(F.col("is_available"))
    if category is not None:
        p = p.filter(F.col("category") == F.lit(category))
    return p


def count_products(prod: DataFrame, cat: DataFrame, *, category: str | None = None,
                   brand: str | None = None, organic: bool = False) -> DataFrame:
    """Available products, optionally by category name, brand substring
    (case-insensitive LIKE) and organic flag."""
    p = _available_in_category(prod, cat, category)
    if brand:
        p = p.filter(F.lower("brand").like(f"%{brand.lower()}%"))
    if organic:
        p = p.filter(F.col("is_organic"))
    return p.agg(F.count(F.lit(1)).alias("count"))


def count_deals(deals: DataFrame, *, as_of: datetime, deal_type: str | None = None) -> DataFrame:
    """Active deals that have not ended at ``as_of``, optionally of one type."""
    d = deals.filter(F.col("is_active") & (F.col("end_date") > F.lit(as_of)))
    if deal_type:
        d = d.filter(F.col("deal_type") == F.lit(deal_type))
    return d.agg(F.count(F.lit(1)).alias("count"))


def list_categories(cat: DataFrame, prod: DataFrame) -> DataFrame:
    """Active categories with their available-product count.
    The availability test belongs to the join, so empty categories count 0:
    products are pre-aggregated per category first, then left-joined."""
    counts = (prod.filter(F.col("is_available"))
              .groupBy("category").agg(F.count(F.lit(1)).alias("product_count")))
    return (cat.filter(F.col("is_active"))
            .join(counts, "category", "left")
            .select(F.col("category").alias("name"), "slug", "display_order",
                    F.coalesce("product_count", F.lit(0)).cast("bigint").alias("product_count"))
            .orderBy("display_order"))


def list_brands(prod: DataFrame, cat: DataFrame, *, category: str | None = None) -> DataFrame:
    """Brands of available products by product count; ``brand_total`` is
    the number of brands (the answer shows 15 and "...and N more")."""
    p = _available_in_category(prod, cat, category).filter(F.col("brand").isNotNull())
    counts = p.groupBy("brand").agg(F.count(F.lit(1)).alias("product_count"))
    # A one-row aggregate attached as a scalar subquery (no join, no shuffle).
    total = counts.agg(F.count(F.lit(1))).scalar()
    return (counts.withColumn("brand_total", total)
            .orderBy(F.desc("product_count"), F.asc("brand")))


def deal_summary(deals: DataFrame, *, as_of: datetime) -> DataFrame:
    """Live deals by type: count, avg discount (1 dp), by count desc, with
    the grand total on every row."""
    by_type = (deals.filter(F.col("is_active") & (F.col("end_date") > F.lit(as_of)))
               .groupBy("deal_type")
               .agg(F.count(F.lit(1)).alias("cnt"),
                    F.round(F.avg("discount_percent"), 1).alias("avg_discount")))
    total = by_type.agg(F.sum("cnt").cast("bigint")).scalar()
    return by_type.withColumn("total", total).orderBy(F.desc("cnt"), F.asc("deal_type"))


def top_tags(prod: DataFrame, cat: DataFrame, *, category: str | None = None,
             k: int = 15) -> DataFrame:
    """The whole tags string as the group key ("subcategories"), top k."""
    p = _available_in_category(prod, cat, category).filter(F.col("tags").isNotNull())
    return (p.groupBy("tags").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.desc("cnt"), F.asc("tags")).limit(k))


def tag_frequency(prod: DataFrame) -> DataFrame:
    """D13 variant: single tags after splitting the comma list."""
    return (prod.filter(F.col("tags").isNotNull())
            .select(F.explode(F.split("tags", ",")).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.desc("cnt"), F.asc("tag")))


def catalog_counts(prod: DataFrame) -> DataFrame:
    """Products per category."""
    return prod.groupBy("category").agg(F.count(F.lit(1)).alias("product_count")).orderBy("category")


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per named table with its row count (union of aggregates)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
