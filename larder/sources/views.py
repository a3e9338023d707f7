"""Retail model over the driver's tables.

The driver tables are TPC-H-like; the retail model (products, categories,
deals, order items, orders, stores, cart events, chat turns, vectors) is
derived from them by arithmetic that runs identically in Spark SQL and in
DuckDB. The same text is the fixture definition for both engines: Spark runs
it with the scanned DataFrames bound to the ``{table}`` placeholders, the
oracle inlines it as CTEs over the pre-registered views.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from larder.sources.tables import load_table

# Fixture definitions of the retail views (shared by both engines).
VIEW_SQL: dict[str, str] = {
    "products": """
SELECT p_partkey AS product_id, p_type AS category, p_name AS name,
  concat(p_name, ' by ', p_brand) AS description,
  CASE WHEN p_partkey % 25 = 0 THEN NULL ELSE p_brand END AS brand,
  CAST(p_retailprice AS DECIMAL(10,2)) AS price,
  concat(upper(substr(p_type, 1, 3)), '-', CASE WHEN length(CAST(p_partkey AS STRING)) >= 6 THEN CAST(p_partkey AS STRING) ELSE lpad(CAST(p_partkey AS STRING), 6, '0') END) AS sku,
  p_partkey % 20 <> 0 AS is_available, p_partkey % 8 = 0 AS is_organic,
  p_brand = 'Brand#1' AS is_store_brand,
  CASE WHEN p_partkey % 30 = 0 THEN NULL
       ELSE concat(lower(p_type), ',', split_part(p_name, ' ', 2)) END AS tags
FROM {part}""",
    "categories": """
SELECT p_type AS category, lower(p_type) AS slug,
  CAST(row_number() OVER (ORDER BY p_type) AS INT) AS display_order,
  p_type <> 'SMALL' AS is_active
FROM (SELECT DISTINCT p_type FROM {part}) t""",
    "deals": """
SELECT p_partkey * 10 AS deal_id, p_partkey AS product_id,
  CASE WHEN p_partkey % 27 = 0 THEN 'BOGO' WHEN p_partkey % 27 = 9 THEN 'WeeklyDeal' ELSE 'DailyDeal' END AS deal_type,
  CASE WHEN p_partkey % 27 = 0 THEN NULL ELSE CAST(20 + 5 * (p_size % 5) AS DECIMAL(5,2)) END AS discount_percent,
  CAST(DATE '2001-08-02' + CAST(p_partkey % 13 - 10 AS INT) AS TIMESTAMP) AS start_date,
  CAST(DATE '2001-08-02' + CAST(p_partkey % 13 - 3 AS INT) AS TIMESTAMP) AS end_date,
  p_partkey % 11 <> 0 AS is_active
FROM {part} WHERE p_partkey % 9 = 0
UNION ALL
SELECT p_partkey * 10 + 1, p_partkey, 'WeeklyDeal', CAST(15 AS DECIMAL(5,2)),
  CAST(DATE '2001-08-01' AS TIMESTAMP), CAST(DATE '2001-08-09' AS TIMESTAMP), TRUE
FROM {part} WHERE p_partkey % 45 = 0""",
    "order_items": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS line_total,
  CASE WHEN l_discount >= 0.05 AND l_partkey % 9 = 0 THEN l_partkey * 10 END AS deal_id
FROM {lineitem}""",
    "shop_orders": """
SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'P' THEN 'Preparing' WHEN 'O' THEN 'Pending' ELSE 'Delivered' END AS status,
  CAST(o_totalprice AS DECIMAL(12,2)) AS total
FROM {orders}""",
    "stores": """
SELECT s_suppkey AS store_id, s_name AS name, concat('1', CASE WHEN length(CAST(s_suppkey AS STRING)) >= 5 THEN CAST(s_suppkey AS STRING) ELSE lpad(CAST(s_suppkey AS STRING), 5, '0') END) AS store_number,
  CAST(CAST(27.8 AS DECIMAL(10,7)) + CAST((s_suppkey * 37) % 100 AS DECIMAL(5,0)) * CAST(0.005 AS DECIMAL(5,3)) AS DECIMAL(10,7)) AS latitude,
  CAST(CAST(-82.2 AS DECIMAL(10,7)) + CAST((s_suppkey * 53) % 100 AS DECIMAL(5,0)) * CAST(0.006 AS DECIMAL(5,3)) AS DECIMAL(10,7)) AS longitude,
  s_suppkey % 10 <> 0 AS is_open
FROM {supplier}""",
    "cart_events": """
SELECT event_id, concat('s', CAST(user_id AS STRING)) AS session_id, ts AS event_ts,
  CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'add' WHEN 'signup' THEN 'set'
       WHEN 'error' THEN 'remove' ELSE 'checkout' END AS op,
  (event_id * 7919) % 7 AS product_id,
  CAST(CASE WHEN event_type IN ('view', 'click') THEN 1 + event_id % 3
            WHEN event_type = 'signup' THEN event_id % 4 END AS INT) AS quantity
FROM {events}""",
    "chat_turns": """
SELECT conv_id, turn, role, text,
  1704067200 + conv_id * 3600 + turn * CASE WHEN conv_id % 5 = 0 THEN 10800 ELSE 300 END AS ts_s
FROM {conversations}""",
    "vectors": """
SELECT vec_id, embedding, concat('c', CAST(label AS STRING)) AS category FROM {embeddings}""",
    # Users of the shop: the customers (no password column is carried).
    "users": """
SELECT c_custkey AS user_id, concat(lower(replace(c_name, '#', '')), '@example.com') AS email,
  c_name AS display_name, CAST(c_nationkey AS BIGINT) AS preferred_store_id
FROM {customer}""",
    "store_details": """
SELECT s_suppkey AS store_id, concat(CAST(s_suppkey AS STRING), ' Market St') AS address, n_name AS city, 'FL' AS state,
  CAST(33800 + s_suppkey AS STRING) AS zip_code,
  concat('(863) 555-', CASE WHEN length(CAST(s_suppkey AS STRING)) >= 4 THEN CAST(s_suppkey AS STRING) ELSE lpad(CAST(s_suppkey AS STRING), 4, '0') END) AS phone
FROM {supplier} s JOIN {nation} n ON n_nationkey = s_nationkey""",
    # Half of the chat sessions are anonymous.
    "chat_sessions": """
SELECT concat('c', CAST(conv_id AS STRING)) AS session_token, CASE WHEN conv_id % 2 = 0 THEN conv_id + 1 END AS user_id
FROM (SELECT DISTINCT conv_id FROM {conversations}) t""",
}

_VIEW_SOURCES = {
    "products": ("part",), "categories": ("part",), "deals": ("part",),
    "order_items": ("lineitem",), "shop_orders": ("orders",), "stores": ("supplier",),
    "cart_events": ("events",), "chat_turns": ("conversations",), "vectors": ("embeddings",),
    "users": ("customer",), "store_details": ("supplier", "nation"), "chat_sessions": ("conversations",),
}


def oracle_with_views(sql: str) -> str:
    """Prefix an oracle query with the retail views it names, as CTEs."""
    import re
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = []
    for v in used:
        body = VIEW_SQL[v].format(**{t: t for t in _VIEW_SOURCES[v]})
        ctes.append(f"{v} AS ({body}\n)")
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class RetailModel:
    """Lazily built retail DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        srcs = {t: self.table(t) for t in _VIEW_SOURCES[name]}
        return self.spark.sql(VIEW_SQL[name], **srcs)

    @cached_property
    def products(self) -> DataFrame:
        return self.view("products")

    @cached_property
    def categories(self) -> DataFrame:
        return self.view("categories")

    @cached_property
    def deals(self) -> DataFrame:
        return self.view("deals")

    @cached_property
    def order_items(self) -> DataFrame:
        return self.view("order_items")

    @cached_property
    def orders(self) -> DataFrame:
        return self.view("shop_orders")

    @cached_property
    def stores(self) -> DataFrame:
        return self.view("stores")

    @cached_property
    def cart_events(self) -> DataFrame:
        return self.view("cart_events")

    @cached_property
    def chat_turns(self) -> DataFrame:
        return self.view("chat_turns")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.view("vectors")

    @cached_property
    def users(self) -> DataFrame:
        return self.view("users")
