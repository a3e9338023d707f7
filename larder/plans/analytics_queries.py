"""Registered notebook analytics and staff count queries."""

from __future__ import annotations

from larder.operators import analytics as A
from larder.plans.registry import register
from larder.plans.sqlkit import avg_round
from larder.session import AS_OF, AS_OF_SQL
from larder.sources.views import RetailModel


@register("category_stats", f"""
SELECT c.category, count(*) AS product_count,
  {avg_round('p.price')} AS avg_price,
  CAST(min(p.price) AS DOUBLE) AS min_price, CAST(max(p.price) AS DOUBLE) AS max_price,
  round(stddev_samp(CAST(p.price AS DOUBLE)), 2) AS price_stddev,
  CAST(sum(CASE WHEN p.is_organic THEN 1 ELSE 0 END) AS BIGINT) AS organic_count,
  CAST(sum(CASE WHEN p.is_store_brand THEN 1 ELSE 0 END) AS BIGINT) AS store_brand_count
FROM products p JOIN categories c ON p.category = c.category
GROUP BY c.category ORDER BY c.category""")
def q_category_stats(spark, d):
    m = RetailModel(spark, d)
    return A.category_stats(m.products, m.categories)


@register("brand_frequency", f"""
SELECT brand, count(*) AS product_count, {avg_round('price')} AS avg_price
FROM products WHERE brand IS NOT NULL
GROUP BY brand ORDER BY product_count DESC, brand LIMIT 30""")
def q_brand_frequency(spark, d):
    return A.brand_frequency(RetailModel(spark, d).products, k=30)


@register("price_histogram", """
SELECT CAST((CAST(round(price * 100) AS BIGINT) // 500) * 5 AS BIGINT) AS price_bucket, count(*) AS count
FROM products GROUP BY 1 ORDER BY 1""")
def q_price_histogram(spark, d):
    return A.price_histogram(RetailModel(spark, d).products, width=5)


@register("deal_stats", f"""
SELECT deal_type, count(*) AS deal_count, {avg_round('discount_percent', 2, 1)} AS avg_discount_pct
FROM deals WHERE is_active GROUP BY deal_type ORDER BY deal_type""")
def q_deal_stats(spark, d):
    return A.deal_stats(RetailModel(spark, d).deals)


@register("deals_by_category", f"""
SELECT c.category, d.deal_type, count(*) AS deal_count,
  {avg_round('p.price')} AS avg_product_price,
  {avg_round('d.discount_percent', 2, 1)} AS avg_discount
FROM deals d JOIN products p ON d.product_id = p.product_id
JOIN categories c ON p.category = c.category
GROUP BY c.category, d.deal_type ORDER BY 1, 2""")
def q_deals_by_category(spark, d):
    m = RetailModel(spark, d)
    return A.deals_by_category(m.deals, m.products, m.categories)


@register("deal_conversion", """
SELECT count(*) AS total_items, count(deal_id) AS deal_items,
  CASE WHEN count(*) = 0 THEN NULL ELSE (100.0 * count(deal_id)) / CAST(count(*) AS DOUBLE) END AS conversion_pct
FROM order_items""")
def q_deal_conversion(spark, d):
    return A.deal_conversion(RetailModel(spark, d).order_items)


@register("revenue_impact", f"""
SELECT d.deal_type, count(*) AS items_sold, CAST(sum(i.line_total) AS DOUBLE) AS total_revenue,
  {avg_round('i.line_total')} AS avg_item_revenue
FROM order_items i LEFT JOIN deals d ON i.deal_id = d.deal_id
GROUP BY d.deal_type ORDER BY d.deal_type NULLS FIRST""")
def q_revenue_impact(spark, d):
    m = RetailModel(spark, d)
    return A.revenue_impact(m.order_items, m.deals)


@register("count_products", """
SELECT count(*) AS count FROM products p JOIN categories c ON p.category = c.category
WHERE p.is_available""")
def q_count_products(spark, d):
    m = RetailModel(spark, d)
    return A.count_products(m.products, m.categories)


@register("count_products_filtered", """
SELECT count(*) AS count FROM products p JOIN categories c ON p.category = c.category
WHERE p.is_available AND c.category = 'PROMO' AND lower(p.brand) LIKE '%brand#1%' AND p.is_organic""")
def q_count_products_filtered(spark, d):
    m = RetailModel(spark, d)
    return A.count_products(m.products, m.categories, category="PROMO", brand="Brand#1", organic=True)


@register("count_deals", f"""
SELECT count(*) AS count FROM deals WHERE is_active AND end_date > {AS_OF_SQL}""")
def q_count_deals(spark, d):
    return A.count_deals(RetailModel(spark, d).deals, as_of=AS_OF)


@register("count_deals_weekly", f"""
SELECT count(*) AS count FROM deals
WHERE is_active AND end_date > {AS_OF_SQL} AND deal_type = 'WeeklyDeal'""")
def q_count_deals_weekly(spark, d):
    return A.count_deals(RetailModel(spark, d).deals, as_of=AS_OF, deal_type="WeeklyDeal")


@register("list_categories", """
SELECT c.category AS name, c.slug, c.display_order, count(p.product_id) AS product_count
FROM categories c LEFT JOIN products p ON c.category = p.category AND p.is_available
WHERE c.is_active GROUP BY c.category, c.slug, c.display_order ORDER BY c.display_order""")
def q_list_categories(spark, d):
    m = RetailModel(spark, d)
    return A.list_categories(m.categories, m.products)


@register("list_brands", """
WITH b AS (
  SELECT p.brand, count(*) AS product_count FROM products p JOIN categories c ON p.category = c.category
  WHERE p.is_available AND p.brand IS NOT NULL GROUP BY p.brand)
SELECT brand, product_count, (SELECT count(*) FROM b) AS brand_total
FROM b ORDER BY product_count DESC, brand""")
def q_list_brands(spark, d):
    m = RetailModel(spark, d)
    return A.list_brands(m.products, m.categories)


@register("deal_summary", f"""
WITH t AS (
  SELECT deal_type, count(*) AS cnt, {avg_round('discount_percent', 2, 1)} AS avg_discount
  FROM deals WHERE is_active AND end_date > {AS_OF_SQL} GROUP BY deal_type)
SELECT deal_type, cnt, avg_discount, (SELECT CAST(sum(cnt) AS BIGINT) FROM t) AS total
FROM t ORDER BY cnt DESC, deal_type""")
def q_deal_summary(spark, d):
    return A.deal_summary(RetailModel(spark, d).deals, as_of=AS_OF)


@register("top_tags", """
SELECT p.tags, count(*) AS cnt FROM products p JOIN categories c ON p.category = c.category
WHERE p.is_available AND p.tags IS NOT NULL
GROUP BY p.tags ORDER BY cnt DESC, p.tags LIMIT 15""")
def q_top_tags(spark, d):
    m = RetailModel(spark, d)
    return A.top_tags(m.products, m.categories)


@register("top_tags_in_category", """
SELECT p.tags, count(*) AS cnt FROM products p JOIN categories c ON p.category = c.category
WHERE p.is_available AND p.tags IS NOT NULL AND c.category = 'LARGE'
GROUP BY p.tags ORDER BY cnt DESC, p.tags LIMIT 15""")
def q_top_tags_in_category(spark, d):
    m = RetailModel(spark, d)
    return A.top_tags(m.products, m.categories, category="LARGE")


@register("tag_frequency", """
SELECT tag, count(*) AS cnt FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM products WHERE tags IS NOT NULL)
GROUP BY tag ORDER BY cnt DESC, tag""")
def q_tag_frequency(spark, d):
    return A.tag_frequency(RetailModel(spark, d).products)


@register("catalog_counts", """
SELECT category, count(*) AS product_count FROM products GROUP BY category ORDER BY category""")
def q_catalog_counts(spark, d):
    return A.catalog_counts(RetailModel(spark, d).products)


@register("table_counts", """
SELECT 'products' AS table_name, count(*) AS row_count FROM products
UNION ALL SELECT 'categories', count(*) FROM categories
UNION ALL SELECT 'deals', count(*) FROM deals
UNION ALL SELECT 'order_items', count(*) FROM order_items
UNION ALL SELECT 'shop_orders', count(*) FROM shop_orders
UNION ALL SELECT 'stores', count(*) FROM stores
UNION ALL SELECT 'vectors', count(*) FROM vectors""")
def q_table_counts(spark, d):
    m = RetailModel(spark, d)
    return A.table_counts({"products": m.products, "categories": m.categories, "deals": m.deals,
                           "order_items": m.order_items, "shop_orders": m.orders,
                           "stores": m.stores, "vectors": m.vectors})
