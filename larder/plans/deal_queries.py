"""Registered deal queries (B7, B8, B10, B15, C2, C7, C13, I6-I8, I12 deals)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.text import deal_text, iso_timestamp
from larder.operators import deals as D
from larder.operators.catalog import paginate
from larder.plans.registry import register
from larder.session import AS_OF, AS_OF_SQL
from larder.sources.views import RetailModel

# Title / description texts per deal type in SQL (oracle side).
_TITLE_SQL = """CASE WHEN {t} = 'BOGO' THEN 'Buy One Get One Free'
  WHEN {t} = 'WeeklyDeal' THEN CAST(CAST({p} AS INT) AS VARCHAR) || '% Off This Week'
  ELSE 'Today Only: ' || CAST(CAST({p} AS INT) AS VARCHAR) || '% Off' END"""
_DESC_SQL = """CASE WHEN {t} = 'BOGO' THEN 'Buy one ' || {n} || ' and get one free!'
  WHEN {t} = 'WeeklyDeal' THEN 'Save ' || CAST(CAST({p} AS INT) AS VARCHAR) || '% on ' || {n} || ' this week only!'
  ELSE 'Flash deal! Save ' || CAST(CAST({p} AS INT) AS VARCHAR) || '% on ' || {n} || ' today only.' END"""


def title_sql(t="deal_type", p="discount_percent"):
    return _TITLE_SQL.format(t=t, p=p)


def desc_sql(t="deal_type", p="discount_percent", n="name"):
    return _DESC_SQL.format(t=t, p=p, n=n)


@register("active_deals_page", f"""
WITH f AS (SELECT * FROM deals WHERE is_active AND end_date > {AS_OF_SQL}), t AS (SELECT count(*) AS n FROM f)
SELECT deal_id, deal_type, strftime(end_date, '%Y-%m-%d %H:%M:%S') AS end_date, t.n AS total_count, 2 AS page, 25 AS page_size,
  CAST(ceil(t.n / 25) AS BIGINT) AS total_pages, 2 < CAST(ceil(t.n / 25) AS BIGINT) AS has_next,
  TRUE AS has_previous
FROM f, t ORDER BY end_date, deal_id LIMIT 25 OFFSET 25""")
def q_active_deals_page(spark, d):
    """Live deals by end date, page 2 of 25."""
    a = D.active_deals(RetailModel(spark, d).deals, as_of=AS_OF)
    return paginate(a, order=D.active_deal_order(), page=2, size=25).select(
        "deal_id", "deal_type", "end_date", "total_count", "page", "page_size",
        "total_pages", "has_next", "has_previous")


@register("deals_by_type_bogo", f"""
SELECT deal_id, product_id, strftime(end_date, '%Y-%m-%d %H:%M:%S') AS end_date FROM deals
WHERE is_active AND end_date > {AS_OF_SQL} AND deal_type = 'BOGO'""")
def q_deals_by_type_bogo(spark, d):
    """The BOGO list (unpaged)."""
    return D.deals_by_type(RetailModel(spark, d).deals, as_of=AS_OF, deal_type="BOGO").select(
        "deal_id", "product_id", "end_date")


@register("expiring_deals", f"""
SELECT d.deal_id, {title_sql('d.deal_type', 'd.discount_percent')} AS title, d.deal_type,
  strftime(d.end_date, '%Y-%m-%d %H:%M:%S') AS end_date,
  p.name AS product_name, p.sku
FROM deals d JOIN products p ON d.product_id = p.product_id
WHERE d.is_active AND d.end_date BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + INTERVAL '23 hours 59 minutes 59 seconds'
ORDER BY d.end_date, d.deal_id LIMIT 20""")
def q_expiring_deals(spark, d):
    """Deals ending today, with product name and sku."""
    m = RetailModel(spark, d)
    return D.expiring_deals(m.deals, m.products, as_of=AS_OF, k=20)


@register("deal_view", """
SELECT d.deal_id, d.deal_type, CAST(d.discount_percent AS DOUBLE) AS discount_percent,
  p.name AS product_name, CAST(p.price AS DOUBLE) AS product_price, c.category
FROM deals d JOIN products p ON d.product_id = p.product_id JOIN categories c ON p.category = c.category""")
def q_deal_view(spark, d):
    """Deal with product name, price and category."""
    m = RetailModel(spark, d)
    return D.deal_view(m.deals, m.products, m.categories).select(
        "deal_id", "deal_type", "discount_percent", "product_name", "product_price", "category")


DEAL_TEXT_SQL = f"""
SELECT d.deal_id,
  'Deal: ' || {title_sql('d.deal_type', 'd.discount_percent')} || chr(10) || 'Type: ' || d.deal_type || chr(10) ||
  'Product: ' || coalesce(p.name, 'Unknown') || chr(10) || 'Category: ' || coalesce(p.category, 'Unknown') || chr(10) ||
  'Price: ' || printf('$%.2f', coalesce(p.price, 0)) || chr(10) ||
  'Description: ' || {desc_sql('d.deal_type', 'd.discount_percent', 'p.name')} AS text
FROM deals d LEFT JOIN products p ON d.product_id = p.product_id"""


@register("deal_text", DEAL_TEXT_SQL)
def q_deal_text(spark, d):
    """C13 + F12: deal document text with product defaults."""
    m = RetailModel(spark, d)
    j = D.deal_text_join(D.with_deal_text(m.deals, m.products), m.products)
    return j.select("deal_id", deal_text("title", "deal_type", "product_name", "category",
                                         "price", "description").alias("text"))


@register("deal_expire", f"""
SELECT deal_id,
  CASE WHEN deal_type = 'DailyDeal' AND end_date < {AS_OF_SQL} AND is_active THEN FALSE ELSE is_active END AS is_active,
  CASE WHEN deal_type = 'DailyDeal' AND end_date < {AS_OF_SQL} AND is_active THEN '2001-08-02 00:00:00' END AS updated_at
FROM deals""")
def q_deal_expire(spark, d):
    """I6 + I13: expire ended daily deals, stamp only the changed rows."""
    return D.deal_expire(RetailModel(spark, d).deals, as_of=AS_OF).select("deal_id", "is_active", "updated_at")


@register("deal_rotation", f"""
WITH ex AS (
  SELECT product_id, CASE WHEN deal_type = 'DailyDeal' AND end_date < {AS_OF_SQL} AND is_active THEN FALSE
    ELSE is_active END AS is_active, end_date FROM deals),
el AS (SELECT p.product_id, p.name, md5('7:' || CAST(p.product_id AS VARCHAR)) AS h FROM products p
  WHERE p.is_available AND p.product_id NOT IN
    (SELECT product_id FROM ex WHERE is_active AND end_date > {AS_OF_SQL})),
pk AS (SELECT * FROM el ORDER BY h, product_id LIMIT 15),
pc AS (SELECT *, ([25, 30, 35, 40, 50])[CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 5 AS INT) + 1] AS pct FROM pk)
SELECT product_id, 'DailyDeal' AS deal_type, 'Today Only: ' || CAST(pct AS VARCHAR) || '% Off' AS title,
  'Flash deal! Save ' || CAST(pct AS VARCHAR) || '% on ' || name || ' today only.' AS description,
  CAST(pct AS DOUBLE) AS discount_percent, '2001-08-02 00:00:00' AS start_date,
  '2001-08-03 05:00:00' AS end_date, TRUE AS is_active
FROM pc""")
def q_deal_rotation(spark, d):
    """Expire, then 15 seeded new daily deals for products without one."""
    m = RetailModel(spark, d)
    return D.deal_rotation(m.deals, m.products, as_of=AS_OF, seed=7, k=15)


@register("deal_assignment", """
WITH r AS (SELECT product_id, sku, name, md5('11:' || CAST(product_id AS VARCHAR)) AS h FROM products
  ORDER BY h, product_id LIMIT 365),
n AS (SELECT *, row_number() OVER (ORDER BY h, product_id) AS rank,
  CAST('0x' || substr(h, 9, 8) AS BIGINT) % 1000 AS pick FROM r)
SELECT product_id, sku AS product_sku, name, CAST(rank AS INTEGER) AS rank,
  CASE WHEN rank <= 200 THEN 'BOGO' WHEN rank <= 350 THEN 'WeeklyDeal' ELSE 'DailyDeal' END AS deal_type,
  CASE WHEN rank <= 200 THEN NULL WHEN rank <= 350 THEN CAST(([20, 25, 30, 35, 40])[pick % 5 + 1] AS DOUBLE)
       ELSE CAST(([25, 30, 35, 40, 45, 50])[pick % 6 + 1] AS DOUBLE) END AS discount_percent,
  CASE WHEN rank <= 200 THEN '2001-07-31 00:00:00' WHEN rank <= 350 THEN '2001-08-01 00:00:00'
       ELSE '2001-08-02 00:00:00' END AS start_date,
  CASE WHEN rank <= 200 THEN '2001-08-14 00:00:00' WHEN rank <= 350 THEN '2001-08-08 00:00:00'
       ELSE '2001-08-03 00:00:00' END AS end_date,
  TRUE AS is_active,
  CASE WHEN rank <= 200 THEN 'Buy One Get One Free'
       WHEN rank <= 350 THEN CAST(([20, 25, 30, 35, 40])[pick % 5 + 1] AS VARCHAR) || '% Off This Week'
       ELSE 'Today Only: ' || CAST(([25, 30, 35, 40, 45, 50])[pick % 6 + 1] AS VARCHAR) || '% Off' END AS title,
  CASE WHEN rank <= 200 THEN 1 END AS buy_quantity, CASE WHEN rank <= 200 THEN 1 END AS get_quantity
FROM n""")
def q_deal_assignment(spark, d):
    """I8: disjoint seeded BOGO / weekly / daily assignment (200 / 150 / 15)."""
    return D.deal_assignment(RetailModel(spark, d).products, as_of=AS_OF, seed=11)


@register("deal_assignment_shares", """
WITH c AS (SELECT count(*) AS n FROM products),
k AS (SELECT n * 606 // 10000 AS b, n * 455 // 10000 AS w, n * 45 // 10000 AS d FROM c),
r AS (SELECT product_id, sku, md5('23:' || CAST(product_id AS VARCHAR)) AS h,
  row_number() OVER (ORDER BY md5('23:' || CAST(product_id AS VARCHAR)), product_id) AS rank FROM products),
x AS (SELECT r.*, k.*, CAST('0x' || substr(h, 9, 8) AS BIGINT) % 1000 AS pick FROM r, k WHERE rank <= b + w + d)
SELECT product_id, sku AS product_sku, CASE WHEN rank <= b THEN 'BOGO' WHEN rank <= b + w THEN 'WeeklyDeal' ELSE 'DailyDeal' END AS deal_type,
  CASE WHEN rank <= b THEN NULL WHEN rank <= b + w THEN CAST(([20, 25, 30, 35, 40])[pick % 5 + 1] AS DOUBLE)
       ELSE CAST(([25, 30, 35, 40, 45, 50])[pick % 6 + 1] AS DOUBLE) END AS discount_percent,
  CASE WHEN rank <= b THEN '2001-08-14 00:00:00' WHEN rank <= b + w THEN '2001-08-08 00:00:00' ELSE '2001-08-03 00:00:00' END AS end_date
FROM x""")
def q_deal_assignment_shares(spark, d):
    """I8 by shares of the whole catalogue, cut by hash histograms."""
    out = D.deal_assignment_shares(RetailModel(spark, d).products, as_of=AS_OF, seed=23)
    return out.select("product_id", "product_sku", "deal_type", "discount_percent", "end_date")


# Change feed derived from part: small sizes update, size 2 deletes, size 3 creates.
_DEAL_CHANGES = """
SELECT p_partkey * 10 AS deal_id, 1 AS change_seq, 'update' AS op, p_partkey AS product_id,
  'WeeklyDeal' AS deal_type, CAST(45 AS DECIMAL(5,2)) AS discount_percent,
  CAST(DATE '2001-08-02' AS TIMESTAMP) AS start_date, CAST(DATE '2001-08-20' AS TIMESTAMP) AS end_date,
  TRUE AS is_active
FROM {part} WHERE p_size = 1
UNION ALL
SELECT p_partkey * 10, 2, 'delete', NULL, NULL, NULL, NULL, NULL, NULL FROM {part} WHERE p_size = 2
UNION ALL
SELECT p_partkey * 10 + 5, 1, 'create', p_partkey, 'DailyDeal', CAST(30 AS DECIMAL(5,2)),
  CAST(DATE '2001-08-02' AS TIMESTAMP), CAST(DATE '2001-08-03' AS TIMESTAMP), TRUE
FROM {part} WHERE p_size = 3"""


@register("deal_upsert", f"""
WITH ch AS ({_DEAL_CHANGES.format(part='part')}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY change_seq DESC) AS rn FROM ch) WHERE rn = 1),
j AS (SELECT coalesce(t.deal_id, l.deal_id) AS deal_id, t.deal_type IS NOT NULL AS ex, l.op,
  t.product_id AS t_product_id, t.deal_type AS t_deal_type, t.discount_percent AS t_discount_percent,
  t.start_date AS t_start_date, t.end_date AS t_end_date, t.is_active AS t_is_active,
  l.product_id, l.deal_type, l.discount_percent, l.start_date, l.end_date, l.is_active
  FROM deals t FULL OUTER JOIN l ON t.deal_id = l.deal_id)
SELECT deal_id,
  CASE WHEN (ex AND op = 'update') OR (NOT ex AND op = 'create') THEN product_id ELSE t_product_id END AS product_id,
  CASE WHEN (ex AND op = 'update') OR (NOT ex AND op = 'create') THEN deal_type ELSE t_deal_type END AS deal_type,
  CAST(CASE WHEN (ex AND op = 'update') OR (NOT ex AND op = 'create') THEN discount_percent ELSE t_discount_percent END AS DOUBLE) AS discount_percent,
  strftime(CASE WHEN (ex AND op = 'update') OR (NOT ex AND op = 'create') THEN start_date ELSE t_start_date END, '%Y-%m-%d %H:%M:%S') AS start_date,
  strftime(CASE WHEN (ex AND op = 'update') OR (NOT ex AND op = 'create') THEN end_date ELSE t_end_date END, '%Y-%m-%d %H:%M:%S') AS end_date,
  CASE WHEN ex AND op = 'delete' THEN FALSE
       WHEN (ex AND op = 'update') OR (NOT ex AND op = 'create') THEN is_active ELSE t_is_active END AS is_active,
  CASE WHEN (ex AND op IN ('update', 'delete')) OR (NOT ex AND op = 'create') THEN '2001-08-02 00:00:00' END AS updated_at
FROM j WHERE ex OR op = 'create'""")
def q_deal_upsert(spark, d):
    """I12 + I13: apply a create / update / soft-delete feed to the deals."""
    m = RetailModel(spark, d)
    changes = spark.sql(_DEAL_CHANGES, part=m.table("part"))
    return D.deal_upsert(m.deals, changes, as_of=AS_OF)


@register("deal_iso_end", """
SELECT deal_id, strftime(end_date, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS end_iso FROM deals""")
def q_deal_iso_end(spark, d):
    """end date as ISO-8601 with offset."""
    return RetailModel(spark, d).deals.select("deal_id", iso_timestamp("end_date").alias("end_iso"))
