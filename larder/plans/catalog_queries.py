"""Registered catalogue queries (B1-B6, B9, B11-B14, B16, C5, C6, C11, E1-E6,
F15, A4, A5, A10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.functions.text import clock_time, day_name
from larder.operators import catalog as C
from larder.operators import page_directory as P
from larder.plans.deal_queries import title_sql
from larder.plans.registry import register
from larder.plans.sqlkit import doubles
from larder.session import AS_OF, AS_OF_SQL, ensure_checkpoint_dir
from larder.sources.views import RetailModel

_PAGE_COLS = ["total_count", "page", "page_size", "total_pages", "has_next", "has_previous"]


def _paged_sql(body: str, order: str, cols: str, page: int, size: int) -> str:
    return f"""
WITH f AS ({body}), t AS (SELECT count(*) AS n FROM f)
SELECT {cols}, t.n AS total_count, {page} AS page, {size} AS page_size,
  CAST(ceil(t.n / {size}) AS BIGINT) AS total_pages,
  {page} < CAST(ceil(t.n / {size}) AS BIGINT) AS has_next, {str(page > 1).upper()} AS has_previous
FROM f, t ORDER BY {order} LIMIT {size} OFFSET {(page - 1) * size}"""


_AVAILABLE_JOINED = ("SELECT p.* FROM products p JOIN categories c ON p.category = c.category "
                     "WHERE p.is_available")


@register("products_filtered_page", doubles(_paged_sql(
    _AVAILABLE_JOINED + " AND p.category = 'PROMO' AND p.brand IS NOT NULL"
    " AND contains(lower(p.brand), 'brand#2')",
    "price DESC, product_id", "product_id, name, sku, price, brand", 2, 10), "price"))
def q_products_filtered_page(spark, d):
    """B1-B4 + E1 (price_desc) + E2 (page 2 of 10)."""
    m = RetailModel(spark, d)
    p = C.find_products(m.products, m.categories, m.deals, as_of=AS_OF,
                        category="PROMO", brand="Brand#2")
    page = C.paginate(p, order=C.product_sort("price_desc"), page=2, size=10)
    return page.select("product_id", "name", "sku", "price", "brand", *_PAGE_COLS)


@register("products_organic_price_asc", doubles(_paged_sql(
    _AVAILABLE_JOINED + " AND p.is_organic", "price, product_id",
    "product_id, name, price", 1, 25), "price"))
def q_products_organic_price_asc(spark, d):
    m = RetailModel(spark, d)
    p = C.find_products(m.products, m.categories, m.deals, as_of=AS_OF, organic=True)
    return C.paginate(p, order=C.product_sort("price_asc"), page=1, size=25).select(
        "product_id", "name", "price", *_PAGE_COLS)


@register("products_page_directory", doubles(_paged_sql(
    "SELECT * FROM products", "category, price DESC, product_id", "product_id, category, name, price", 14, 12), "price"))
def q_products_page_directory(spark, d):
    """E2 by directory: page 14 of the whole catalogue by category, falling price and id, from a sorted copy."""
    keys = [("category", True), ("price", False), ("product_id", True)]
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/product-pages-{uuid.uuid4().hex}"
    P.write_page_directory(RetailModel(spark, d).products, path, keys, rows_per_part=500)
    return P.read_page(spark, path, keys, page=14, size=12).select("product_id", "category", "name", "price", *_PAGE_COLS)


@register("products_deals_only", doubles(_paged_sql(
    _AVAILABLE_JOINED + f""" AND EXISTS (SELECT 1 FROM deals d WHERE d.product_id = p.product_id
      AND d.is_active AND d.end_date > {AS_OF_SQL})""",
    "name, product_id", "product_id, name, price", 3, 20), "price"))
def q_products_deals_only(spark, d):
    """C5 dealsOnly, default (name) sort, page 3."""
    m = RetailModel(spark, d)
    p = C.find_products(m.products, m.categories, m.deals, as_of=AS_OF, deals_only=True)
    return C.paginate(p, order=C.product_sort(None), page=3, size=20).select(
        "product_id", "name", "price", *_PAGE_COLS)


@register("product_search", _paged_sql(
    """SELECT * FROM products WHERE is_available AND (contains(lower(name), 'blue')
       OR contains(lower(description), 'blue') OR (brand IS NOT NULL AND contains(lower(brand), 'blue'))
       OR (tags IS NOT NULL AND contains(lower(tags), 'blue')))""",
    "name, product_id", "product_id, name", 1, 30))
def q_product_search(spark, d):
    """Substring search, by name, first page."""
    p = C.product_search(RetailModel(spark, d).products, term="Blue")
    return C.paginate(p, order=[F.asc("name"), F.asc("product_id")], page=1, size=30).select(
        "product_id", "name", *_PAGE_COLS)


@register("product_search_ranked", _paged_sql(
    """SELECT p.*, CASE WHEN lower(p.name) LIKE '%ro%' THEN 0 ELSE 1 END AS name_rank
       FROM products p JOIN categories c ON p.category = c.category
       WHERE p.is_available AND (lower(p.name) LIKE '%ro%' OR lower(p.description) LIKE '%ro%'
         OR lower(coalesce(p.brand, '')) LIKE '%ro%' OR lower(coalesce(p.tags, '')) LIKE '%ro%')""",
    "name_rank, name, product_id", "product_id, name, name_rank", 2, 40))
def q_product_search_ranked(spark, d):
    """LIKE search, name hits first, page 2 of 40."""
    m = RetailModel(spark, d)
    p = C.product_search_ranked(m.products, m.categories, term="ro")
    return C.paginate(p, order=C.ranked_order(), page=2, size=40).select(
        "product_id", "name", "name_rank", *_PAGE_COLS)


def _indexed(spark, d):
    """The model and a trigram index of its whole catalogue, in the shared checkpoint folder."""
    m = RetailModel(spark, d)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/product-trigrams-{uuid.uuid4().hex}"
    C.index_products_text(m.products, path)
    return m, path


_FOUND = """SELECT product_id, name FROM products WHERE is_available AND (contains(lower(name), '{t}')
  OR contains(lower(description), '{t}') OR (brand IS NOT NULL AND contains(lower(brand), '{t}'))
  OR (tags IS NOT NULL AND contains(lower(tags), '{t}')))"""


@register("product_search_index", _FOUND.format(t="blue") + """
UNION ALL """ + _FOUND.format(t="brand#13") + """
UNION ALL """ + _FOUND.format(t="no such words") + """
UNION ALL """ + _FOUND.format(t="r "))
def q_product_search_index(spark, d):
    """B5 over the trigram index, all hits of four terms (one too short for a trigram, one without a hit)."""
    m, index = _indexed(spark, d)
    out = None
    for term in ("Blue", "brand#13", "No such words", "R "):
        hits = C.product_search(m.products, term=term, index=index).select("product_id", "name")
        out = hits if out is None else out.unionByName(hits)
    return out


@register("product_search_ranked_index", """
SELECT p.product_id, p.name, CASE WHEN lower(p.name) LIKE '%wid%by%and_2%' THEN 0 ELSE 1 END AS name_rank
FROM products p JOIN categories c ON p.category = c.category
WHERE p.is_available AND (lower(p.name) LIKE '%wid%by%and_2%' OR lower(p.description) LIKE '%wid%by%and_2%'
  OR lower(coalesce(p.brand, '')) LIKE '%wid%by%and_2%' OR lower(coalesce(p.tags, '')) LIKE '%wid%by%and_2%')
UNION ALL
SELECT p.product_id, p.name, CASE WHEN lower(p.name) LIKE '%d r_d%' THEN 0 ELSE 1 END AS name_rank
FROM products p JOIN categories c ON p.category = c.category
WHERE p.is_available AND (lower(p.name) LIKE '%d r_d%' OR lower(p.description) LIKE '%d r_d%'
  OR lower(coalesce(p.brand, '')) LIKE '%d r_d%' OR lower(coalesce(p.tags, '')) LIKE '%d r_d%')""")
def q_product_search_ranked_index(spark, d):
    """B6 over the trigram index, all hits of two patterns with wildcards."""
    m, index = _indexed(spark, d)
    hits = [C.product_search_ranked(m.products, m.categories, term=t, index=index).select("product_id", "name", "name_rank")
            for t in ("wid%by%AND_2", "d r_d")]
    return hits[0].unionByName(hits[1])


@register("products_by_brand_index", doubles(_AVAILABLE_JOINED.replace("p.*", "p.product_id, p.name, p.price, p.brand")
                                             + " AND p.brand IS NOT NULL AND contains(lower(p.brand), 'and#2')", "price"))
def q_products_by_brand_index(spark, d):
    """B3 over the trigram index: all available products whose brand holds the text."""
    m, index = _indexed(spark, d)
    p = C.find_products(m.products, m.categories, m.deals, as_of=AS_OF, brand="AND#2", index=index)
    return p.select("product_id", "name", "price", "brand")


@register("products_by_slug", _paged_sql(
    "SELECT p.* FROM products p WHERE p.is_available AND p.category IN "
    "(SELECT category FROM categories WHERE slug = 'standard')",
    "name, product_id", "product_id, name", 1, 20))
def q_products_by_slug(spark, d):
    """Products of one category slug, first page by name."""
    m = RetailModel(spark, d)
    p = C.products_by_slug(m.products, m.categories, slug="standard")
    return C.paginate(p, order=C.product_sort("name"), page=1, size=20).select(
        "product_id", "name", *_PAGE_COLS)


@register("products_by_unknown_slug", """
SELECT product_id, name FROM products WHERE is_available AND category IN
  (SELECT category FROM categories WHERE slug = 'no-such-slug')""")
def q_products_by_unknown_slug(spark, d):
    m = RetailModel(spark, d)
    return C.products_by_slug(m.products, m.categories, slug="no-such-slug").select("product_id", "name")


@register("lookup_by_id", doubles("""
SELECT product_id, name, sku, price FROM products
WHERE product_id IN (SELECT product_id FROM order_items WHERE deal_id IS NOT NULL)""", "price"))
def q_lookup_by_id(spark, d):
    """B12 batch form: products looked up by the ids referenced from deal lines."""
    m = RetailModel(spark, d)
    keys = m.order_items.filter(F.col("deal_id").isNotNull())
    return C.lookup_by_id(m.products, keys, "product_id").select("product_id", "name", "sku", "price")


@register("first_active_deal", f"""
SELECT product_id, deal_id, deal_type, strftime(end_date, '%Y-%m-%d %H:%M:%S') AS end_date FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY end_date, deal_id) AS rn
  FROM deals WHERE is_active AND end_date > {AS_OF_SQL}) WHERE rn = 1""")
def q_first_active_deal(spark, d):
    return C.first_active_deal(RetailModel(spark, d).deals, as_of=AS_OF).select(
        "product_id", "deal_id", "deal_type", "end_date")


@register("products_without_deal", f"""
SELECT product_id, sku FROM products p WHERE is_available AND NOT EXISTS (
  SELECT 1 FROM deals d WHERE d.product_id = p.product_id AND d.is_active AND d.end_date > {AS_OF_SQL})""")
def q_products_without_deal(spark, d):
    m = RetailModel(spark, d)
    return C.products_without_deal(m.products, m.deals, as_of=AS_OF).select("product_id", "sku")


@register("product_view_flat", doubles(f"""
WITH fd AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY end_date, deal_id) AS rn
  FROM deals WHERE is_active AND end_date > {AS_OF_SQL}) WHERE rn = 1)
SELECT p.product_id, p.name, p.category, p.price, p.sku, p.is_available,
  fd.deal_id AS deal_deal_id, fd.deal_type AS deal_deal_type,
  CASE WHEN fd.deal_id IS NULL THEN NULL WHEN fd.deal_type = 'BOGO' THEN 'Buy One Get One Free'
       WHEN fd.deal_type = 'WeeklyDeal' THEN CAST(CAST(fd.discount_percent AS INT) AS VARCHAR) || '% Off This Week'
       ELSE 'Today Only: ' || CAST(CAST(fd.discount_percent AS INT) AS VARCHAR) || '% Off' END AS deal_title,
  CAST(fd.discount_percent AS DOUBLE) AS deal_discount_percent,
  strftime(fd.end_date, '%Y-%m-%d %H:%M:%S') AS deal_end_date
FROM products p JOIN categories c ON p.category = c.category LEFT JOIN fd ON p.product_id = fd.product_id""", "price"))
def q_product_view_flat(spark, d):
    """B14 flattened: product with its first live deal's fields (null when none)."""
    m = RetailModel(spark, d)
    return C.product_view(m.products, m.categories, m.deals, as_of=AS_OF, nested=False).select(
        "product_id", "name", "category", "price", "sku", "is_available", "deal_deal_id",
        "deal_deal_type", "deal_title", "deal_discount_percent", "deal_end_date")


@register("product_view", f"""
WITH fd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY end_date, deal_id) AS rn
  FROM deals WHERE is_active AND end_date > {AS_OF_SQL}) WHERE rn = 1)
SELECT p.product_id, p.name, CAST(p.price AS DOUBLE) AS price, CASE WHEN fd.deal_id IS NULL THEN NULL ELSE concat_ws('|', CAST(fd.deal_id AS VARCHAR),
  fd.deal_type, {title_sql('fd.deal_type', 'fd.discount_percent')}, CAST(fd.discount_percent AS VARCHAR), strftime(fd.end_date, '%Y-%m-%d')) END AS active_deal
FROM products p LEFT JOIN fd ON p.product_id = fd.product_id""")
def q_product_view(spark, d):
    """B14 nested: ``active_deal`` struct (shown as text) or null."""
    m = RetailModel(spark, d)
    a = F.col("active_deal")
    shown = F.when(a.isNotNull(), F.concat_ws("|", a["id"].cast("string"), a["deal_type"], a["title"], a["discount_percent"].cast("string"),
                                              F.date_format(a["end_date"], "yyyy-MM-dd"))).alias("active_deal")
    return C.product_view(m.products, m.categories, m.deals, as_of=AS_OF).select(
        "product_id", "name", "price", shown)


def _price_sql(order: str, category: str | None, k: int) -> str:
    cat = f" AND c.category = '{category}'" if category else ""
    return f"""
SELECT p.product_id, p.name, p.sku, p.price, c.category, p.brand
FROM products p JOIN categories c ON p.category = c.category
WHERE p.is_available{cat} ORDER BY p.price {order}, p.product_id LIMIT {k}"""


@register("cheapest_products", doubles(_price_sql("ASC", None, 5), "price"))
def q_cheapest_products(spark, d):
    m = RetailModel(spark, d)
    return C.cheapest_products(m.products, m.categories, k=5)


@register("cheapest_in_category", doubles(_price_sql("ASC", "ECONOMY", 5), "price"))
def q_cheapest_in_category(spark, d):
    m = RetailModel(spark, d)
    return C.cheapest_products(m.products, m.categories, category="ECONOMY", k=5)


@register("most_expensive_products", doubles(_price_sql("DESC", None, 5), "price"))
def q_most_expensive_products(spark, d):
    m = RetailModel(spark, d)
    return C.most_expensive_products(m.products, m.categories, k=5)


@register("products_under_price", doubles("""
WITH f AS (SELECT p.product_id, p.name, p.sku, p.price, p.brand, c.category
  FROM products p JOIN categories c ON p.category = c.category
  WHERE p.is_available AND p.price < 905 AND c.category = 'LARGE')
SELECT f.*, (SELECT count(*) FROM f) AS total FROM f ORDER BY price, product_id LIMIT 10""", "price"))
def q_products_under_price(spark, d):
    m = RetailModel(spark, d)
    return C.products_under_price(m.products, m.categories, max_price=905, category="LARGE", k=10)


@register("store_brand_products", doubles("""
SELECT p.product_id, p.name, p.sku, p.price, p.brand, c.category,
  (SELECT count(*) FROM products WHERE is_available AND is_store_brand) AS total
FROM products p JOIN categories c ON p.category = c.category
WHERE p.is_available AND p.is_store_brand AND c.category = 'MEDIUM'
ORDER BY p.name, p.product_id LIMIT 10""", "price"))
def q_store_brand_products(spark, d):
    m = RetailModel(spark, d)
    return C.store_brand_products(m.products, m.categories, category="MEDIUM", k=10)


@register("random_sample_k", """
SELECT product_id, name FROM products WHERE is_available
ORDER BY md5('42:' || CAST(product_id AS VARCHAR)), product_id LIMIT 15""")
def q_random_sample_k(spark, d):
    p = RetailModel(spark, d).products.filter("is_available").select("product_id", "name")
    return C.random_sample_k(p, key="product_id", seed=42, k=15)


@register("name_dedupe", """
SELECT product_id, category, name FROM (
  SELECT *, row_number() OVER (PARTITION BY category, lower(trim(name)) ORDER BY product_id) AS rn
  FROM products) WHERE rn = 1""")
def q_name_dedupe(spark, d):
    return C.name_dedupe(RetailModel(spark, d).products).select("product_id", "category", "name")


@register("nearest_stores", """
SELECT store_id, name, store_number,
  CAST(abs(latitude - CAST(28.0 AS DECIMAL(10,7))) + abs(longitude - CAST(-81.95 AS DECIMAL(10,7))) AS DOUBLE) AS distance
FROM stores WHERE is_open""")
def q_nearest_stores(spark, d):
    """Every open store with its L1 distance from one point, nearest first."""
    return C.nearest_stores(RetailModel(spark, d).stores, lat=28.0, lng=-81.95).select(
        "store_id", "name", "store_number", "distance")


@register("nearest_stores_top5", """
SELECT store_id, name,
  CAST(abs(latitude - CAST(28.0 AS DECIMAL(10,7))) + abs(longitude - CAST(-81.95 AS DECIMAL(10,7))) AS DOUBLE) AS distance
FROM stores WHERE is_open ORDER BY distance, store_id LIMIT 5""")
def q_nearest_stores_top5(spark, d):
    return C.nearest_stores(RetailModel(spark, d).stores, lat=28.0, lng=-81.95, k=5).select(
        "store_id", "name", "distance")


# Incoming catalogue batch derived from part: skus shifted by 1000 collide with
# existing products of the same type; large sizes carry an unknown slug.
_INCOMING_PRODUCTS = """
SELECT p_partkey AS seq,
  CASE WHEN p_size > 45 THEN 'gone-' || lower(p_type) ELSE lower(p_type) END AS category_slug,
  p_name || ' ' || CAST(p_size AS STRING) AS name,
  concat(upper(substr(p_type, 1, 3)), '-', CASE WHEN length(CAST((p_partkey + 1000) AS STRING)) >= 6 THEN CAST((p_partkey + 1000) AS STRING) ELSE lpad(CAST((p_partkey + 1000) AS STRING), 6, '0') END) AS sku,
  CAST(p_retailprice AS DECIMAL(10,2)) AS price
FROM {part}"""


@register("bulk_insert_products", doubles(f"""
WITH inc AS ({_INCOMING_PRODUCTS.format(part='part').replace('AS STRING', 'AS VARCHAR')}),
m AS (SELECT inc.*, c.category FROM inc JOIN categories c ON inc.category_slug = c.slug),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY seq) AS rn FROM m) WHERE rn = 1)
SELECT sku, name, category, price FROM f WHERE sku NOT IN (SELECT sku FROM products)""", "price"))
def q_bulk_insert_products(spark, d):
    """A4: map slug, drop unknown slugs, first per sku, skip existing skus."""
    m = RetailModel(spark, d)
    incoming = spark.sql(_INCOMING_PRODUCTS, part=m.table("part"))
    return C.bulk_insert_products(m.products, incoming, m.categories).select("sku", "name", "category", "price")


_INCOMING_DEALS = """
SELECT p_partkey AS seq, concat(upper(substr(p_type, 1, 3)), '-', CASE WHEN length(CAST((p_partkey * 2) AS STRING)) >= 6 THEN CAST((p_partkey * 2) AS STRING) ELSE lpad(CAST((p_partkey * 2) AS STRING), 6, '0') END) AS product_sku,
  'WeeklyDeal' AS deal_type, CAST(20 + p_size % 5 * 5 AS DECIMAL(5,2)) AS discount_percent
FROM {part}"""


@register("bulk_insert_deals", f"""
WITH inc AS ({_INCOMING_DEALS.format(part='part').replace('AS STRING', 'AS VARCHAR')})
SELECT inc.seq, inc.product_sku, p.product_id, inc.deal_type, CAST(inc.discount_percent AS DOUBLE) AS discount_percent
FROM inc JOIN products p ON inc.product_sku = p.sku""")
def q_bulk_insert_deals(spark, d):
    """A5: deals keyed by product sku; unmatched skus dropped."""
    m = RetailModel(spark, d)
    incoming = spark.sql(_INCOMING_DEALS, part=m.table("part"))
    return C.bulk_insert_deals(m.deals, incoming, m.products).select(
        "seq", "product_sku", "product_id", "deal_type", "discount_percent")


@register("store_hours", """
SELECT s.store_id, t.d AS day_of_week,
  (['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'])[t.d + 1] AS day,
  '7:00 AM' AS open_time, '10:00 PM' AS close_time
FROM stores s, range(7) t(d) WHERE s.is_open""")
def q_store_hours(spark, d):
    """A10 + F8: default hours expanded per open store and weekday, formatted."""
    s = RetailModel(spark, d).stores.filter("is_open")
    h = C.store_hours_expand(s)
    return h.select("store_id", F.col("day_of_week").cast("bigint").alias("day_of_week"),
                    day_name("day_of_week").alias("day"),
                    clock_time("open_minutes").alias("open_time"),
                    clock_time("close_minutes").alias("close_time"))


@register("open_stores", """
SELECT store_id, store_number, (SELECT string_agg(d || ' ' || (['Sunday','Monday','Tuesday','Wednesday','Thursday','Friday','Saturday'])[d + 1]
  || ' 7:00 AM-10:00 PM', ', ' ORDER BY d) FROM range(7) t(d)) AS hours FROM stores WHERE is_open""")
def q_open_stores(spark, d):
    """Open stores with their nested, day-sorted hours (shown as text)."""
    s = RetailModel(spark, d).stores
    day = lambda h: F.concat(h["day_of_week"].cast("string"), F.lit(" "), h["day"], F.lit(" "), h["open_time"], F.lit("-"), h["close_time"])
    return C.open_stores(s, C.store_hours_expand(s)).select(
        "store_id", "store_number", F.array_join(F.transform("hours", day), ", ").alias("hours"))


@register("products_with_category", """
SELECT p.product_id, p.name, c.category, c.slug AS category_slug, c.display_order
FROM products p JOIN categories c ON p.category = c.category""")
def q_products_with_category(spark, d):
    """Products with their category row (inner equi join)."""
    from larder.operators.analytics import products_in_categories
    m = RetailModel(spark, d)
    return products_in_categories(m.products, m.categories).select(
        "product_id", "name", "category", "category_slug", "display_order")


@register("category_product_count", """
SELECT c.category, c.slug, c.display_order, coalesce(n.cnt, 0) AS product_count
FROM categories c LEFT JOIN (SELECT category, count(*) AS cnt FROM products WHERE is_available GROUP BY category) n
  ON c.category = n.category
WHERE c.is_active""")
def q_category_product_count(spark, d):
    """Active categories by display order with their available-product
    count (pre-aggregated, then left-joined; empty categories count 0)."""
    from larder.operators.analytics import list_categories
    m = RetailModel(spark, d)
    return list_categories(m.categories, m.products).select(
        F.col("name").alias("category"), "slug", "display_order", "product_count")


@register("category_by_slug", """
SELECT category, slug, display_order FROM categories WHERE slug = 'promo' AND is_active""")
def q_category_by_slug(spark, d):
    """Category by slug, only when active (an unknown or inactive slug -> empty)."""
    c = RetailModel(spark, d).categories
    return c.filter((F.col("slug") == "promo") & F.col("is_active")).select("category", "slug", "display_order")


@register("lookup_orders_by_id", """
SELECT order_id, user_id, status, CAST(total AS DOUBLE) AS total FROM shop_orders
WHERE order_id IN (SELECT order_id FROM order_items WHERE deal_id IS NOT NULL)""")
def q_lookup_orders_by_id(spark, d):
    """B12 batch form for orders: orders looked up by the ids of their deal lines."""
    m = RetailModel(spark, d)
    keys = m.order_items.filter(F.col("deal_id").isNotNull())
    return C.lookup_by_id(m.orders, keys, "order_id").select("order_id", "user_id", "status", "total")


@register("lookup_deals_by_id", """
SELECT deal_id, product_id, deal_type FROM deals WHERE deal_id IN (SELECT deal_id FROM order_items)""")
def q_lookup_deals_by_id(spark, d):
    """B12 batch form for deals: deals referenced by order lines."""
    m = RetailModel(spark, d)
    return C.lookup_by_id(m.deals, m.order_items.filter(F.col("deal_id").isNotNull()), "deal_id").select(
        "deal_id", "product_id", "deal_type")


# Customer locations around the stores (derived from the customer keys).
_USER_POINTS = """
SELECT c_custkey AS point_id,
  CAST(CAST(27.8 AS DECIMAL(10,7)) + CAST((c_custkey * 13) % 100 AS DECIMAL(5,0)) * CAST(0.0047 AS DECIMAL(6,4)) AS DECIMAL(10,7)) AS lat,
  CAST(CAST(-82.2 AS DECIMAL(10,7)) + CAST((c_custkey * 29) % 100 AS DECIMAL(5,0)) * CAST(0.0061 AS DECIMAL(6,4)) AS DECIMAL(10,7)) AS lng
FROM {customer}"""


@register("nearest_stores_batch", f"""
WITH pts AS ({_USER_POINTS.format(customer='customer')}),
d AS (SELECT pts.point_id, s.store_id,
  CAST((abs(pts.lat - s.latitude) + abs(pts.lng - s.longitude)) * 10000000 AS BIGINT) AS distance_e7
  FROM pts, stores s WHERE s.is_open),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance_e7, store_id) AS rank FROM d)
SELECT point_id, store_id, distance_e7, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def q_nearest_stores_batch(spark, d):
    """E6 batch form: the 3 nearest open stores of every customer location."""
    m = RetailModel(spark, d)
    pts = spark.sql(_USER_POINTS, customer=m.table("customer"))
    return C.nearest_stores_cells(pts, m.stores, k=3)
