"""Registered data-quality queries (K1-K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.text import order_number, slug_api, unit_weight_from_name
from larder.operators import quality as Q
from larder.operators.catalog import store_hours_expand
from larder.operators.deals import with_deal_text
from larder.plans.deal_queries import desc_sql, title_sql
from larder.plans.registry import register
from larder.plans.text_queries import unit_sql, weight_sql
from larder.sources.views import RetailModel


@register("dq_unique", """
SELECT 'category_slug_unique' AS rule, 'categories' AS table_name, count(*) AS violations
  FROM (SELECT slug FROM categories WHERE slug IS NOT NULL GROUP BY slug HAVING count(*) > 1)
UNION ALL SELECT 'category_name_unique', 'categories', count(*)
  FROM (SELECT category FROM categories WHERE category IS NOT NULL GROUP BY category HAVING count(*) > 1)
UNION ALL SELECT 'product_sku_unique', 'products', count(*)
  FROM (SELECT sku FROM products WHERE sku IS NOT NULL GROUP BY sku HAVING count(*) > 1)
UNION ALL SELECT 'product_slug_unique', 'products', count(*)
  FROM (SELECT s FROM (SELECT trim(replace(replace(replace(replace(lower(name), '&', 'and'), '''', ''), ' ', '-'), '--', '-'), '-') AS s FROM products)
        WHERE s IS NOT NULL GROUP BY s HAVING count(*) > 1)
UNION ALL SELECT 'store_number_unique', 'stores', count(*)
  FROM (SELECT store_number FROM stores WHERE store_number IS NOT NULL GROUP BY store_number HAVING count(*) > 1)
UNION ALL SELECT 'user_email_unique', 'users', count(*)
  FROM (SELECT email FROM users WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1)
UNION ALL SELECT 'order_number_unique', 'shop_orders', count(*)
  FROM (SELECT n FROM (SELECT 'ORD-' || strftime(created_at, '%Y%m%d') || '-' || upper(substr(md5(CAST(order_id AS VARCHAR)), 1, 4)) AS n
        FROM shop_orders) GROUP BY n HAVING count(*) > 1)
UNION ALL SELECT 'session_token_unique', 'chat_sessions', count(*)
  FROM (SELECT session_token FROM chat_sessions GROUP BY session_token HAVING count(*) > 1)""")
def q_dq_unique(spark, d):
    """K1: unique keys (slug, name, sku, product slug, store number, email, order number, session token)."""
    m = RetailModel(spark, d)
    return Q.union_all([
        Q.dq_unique(m.categories, "categories", "slug", "category_slug_unique"),
        Q.dq_unique(m.categories, "categories", "category", "category_name_unique"),
        Q.dq_unique(m.products, "products", "sku", "product_sku_unique"),
        Q.dq_unique(m.products, "products", slug_api("name"), "product_slug_unique"),
        Q.dq_unique(m.stores, "stores", "store_number", "store_number_unique"),
        Q.dq_unique(m.users, "users", "email", "user_email_unique"),
        Q.dq_unique(m.orders, "shop_orders", order_number(F.col("created_at").cast("timestamp"), "order_id"),
                    "order_number_unique"),
        Q.dq_unique(m.view("chat_sessions"), "chat_sessions", "session_token", "session_token_unique"),
    ])


_FK = [
    ("product_category_fk", "products", "category", "categories", "category"),
    ("deal_product_fk", "deals", "product_id", "products", "product_id"),
    ("item_order_fk", "order_items", "order_id", "shop_orders", "order_id"),
    ("item_product_fk", "order_items", "product_id", "products", "product_id"),
    ("item_deal_fk", "order_items", "deal_id", "deals", "deal_id"),
    ("order_user_fk", "shop_orders", "user_id", "users", "user_id"),
    ("user_store_fk", "users", "preferred_store_id", "stores", "store_id"),
    ("cart_product_fk", "cart_events", "product_id", "products", "product_id"),
    ("order_store_fk", "order_stores", "store_id", "stores", "store_id"),
    ("hours_store_fk", "store_hours", "store_id", "stores", "store_id"),
    ("session_user_fk", "chat_sessions", "user_id", "users", "user_id"),
    ("message_session_fk", "chat_messages", "session_token", "chat_sessions", "session_token"),
]
# An order is delivered from its user's preferred store.
_FK_CTES = """WITH order_stores AS (SELECT o.order_id, u.preferred_store_id AS store_id FROM shop_orders o JOIN users u USING (user_id)),
store_hours AS (SELECT store_id, d AS day_of_week FROM stores, range(7) t(d)),
chat_messages AS (SELECT 'c' || conv_id AS session_token, turn FROM chat_turns)
"""


@register("dq_foreign_keys", _FK_CTES + "\nUNION ALL ".join(
    f"SELECT '{r}' AS rule, '{ct}' AS table_name, count(*) AS violations FROM {ct} c "
    f"WHERE c.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pt} p WHERE p.{pk} = c.{fk})"
    for r, ct, fk, pt, pk in _FK))
def q_dq_foreign_keys(spark, d):
    """K2: foreign keys (nullable ones only checked when set)."""
    m = RetailModel(spark, d)
    hours = store_hours_expand(m.stores)
    order_stores = m.orders.join(m.users.select("user_id", F.col("preferred_store_id").alias("store_id")), "user_id")
    messages = m.chat_turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_token"))
    sessions = m.view("chat_sessions")
    children = {"products": m.products, "deals": m.deals, "order_items": m.order_items, "shop_orders": m.orders, "users": m.users,
                "cart_events": m.cart_events, "order_stores": order_stores, "store_hours": hours, "chat_sessions": sessions,
                "chat_messages": messages}
    parents = {"categories": m.categories, "products": m.products, "shop_orders": m.orders, "deals": m.deals, "users": m.users,
               "stores": m.stores, "chat_sessions": sessions}
    return Q.dq_foreign_keys(children, parents, _FK)


# Columns that the rules read besides those of the retail views; per table the DuckDB
# text and, in _frames, the library's own functions.
_TABLE_SQL = {
    "products": f"(SELECT *, trim(replace(replace(replace(replace(lower(name), '&', 'and'), '''', ''), ' ', '-'), '--', '-'), '-') AS slug, "
                f"{unit_sql('name')} AS unit, {weight_sql('name')} AS weight FROM products) t",
    "categories": "categories",
    "deals": f"(SELECT d.*, {title_sql('d.deal_type', 'd.discount_percent')} AS title, "
             f"{desc_sql('d.deal_type', 'd.discount_percent', 'p.name')} AS description FROM deals d LEFT JOIN products p USING (product_id)) t",
    "stores": "(SELECT s.*, d.* EXCLUDE (store_id) FROM stores s JOIN store_details d USING (store_id)) t",
    "users": "users",
    "shop_orders": "(SELECT *, 'ORD-' || strftime(created_at, '%Y%m%d') || '-' || upper(substr(md5(CAST(order_id AS VARCHAR)), 1, 4)) AS order_number FROM shop_orders) t",
    "order_items": "order_items",
    "chat_sessions": "chat_sessions",
    "chat_turns": "chat_turns",
}


def _frames(m: RetailModel) -> dict:
    uw = unit_weight_from_name("name")
    deals = with_deal_text(m.deals, m.products)
    return {"products": m.products.withColumn("slug", slug_api("name")).withColumn("unit", uw["unit"]).withColumn("weight", uw["weight"]),
            "categories": m.categories, "deals": deals, "stores": m.stores.join(m.view("store_details"), "store_id"), "users": m.users,
            "shop_orders": m.orders.withColumn("order_number", order_number(F.col("created_at").cast("timestamp"), "order_id")),
            "order_items": m.order_items, "chat_sessions": m.view("chat_sessions"), "chat_turns": m.chat_turns}


# Maximum lengths, (precision, scale) of numbers and required columns per table.
_LENGTHS = {
    "products": [("name", 200), ("slug", 200), ("description", 1000), ("brand", 100), ("unit", 20), ("weight", 50), ("sku", 50), ("tags", 500)],
    "categories": [("category", 100), ("slug", 100)],
    "deals": [("title", 200), ("description", 500), ("deal_type", 20)],
    "stores": [("name", 200), ("store_number", 10), ("address", 300), ("city", 100), ("state", 2), ("zip_code", 10), ("phone", 20)],
    "users": [("email", 256), ("display_name", 100)],
    "shop_orders": [("order_number", 20), ("status", 20)],
    "chat_sessions": [("session_token", 100)],
    "chat_turns": [("role", 20)],
}
_NUMBERS = {
    "products": [("price", 10, 2)],
    "deals": [("discount_percent", 5, 2)],
    "stores": [("latitude", 10, 7), ("longitude", 10, 7)],
    "shop_orders": [("total", 10, 2)],
    "order_items": [("line_total", 10, 2)],
}
_REQUIRED = {
    "products": ["name", "slug", "category", "price", "sku", "is_available"],
    "categories": ["category", "slug"],
    "deals": ["product_id", "title", "start_date", "end_date"],
    "stores": ["name", "store_number", "address", "city", "state", "zip_code"],
    "users": ["email", "display_name"],
    "shop_orders": ["user_id", "order_number", "created_at", "total"],
    "order_items": ["order_id", "product_id", "quantity", "line_total"],
    "chat_sessions": ["session_token"],
    "chat_turns": ["conv_id", "role", "text"],
}


def _count_sql(table: str, rule: str, cond: str) -> str:
    return (f"SELECT '{rule}' AS rule, '{table}' AS table_name, "
            f"CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM {_TABLE_SQL[table]}")


def _len_sql() -> str:
    parts = [_count_sql(t, f"{c}_max_{n}", f"length({c}) > {n}") for t, cols in _LENGTHS.items() for c, n in cols]
    parts += [_count_sql(t, f"{c}_decimal_{p}_{k}", f"abs({c}) >= {10 ** (p - k)} OR {c} <> round({c}, {k})")
              for t, cols in _NUMBERS.items() for c, p, k in cols]
    return "\nUNION ALL ".join(parts)


@register("dq_lengths", _len_sql())
def q_dq_lengths(spark, d):
    """K3: maximum lengths and numeric precision (one scan per table)."""
    parts = []
    for t, df in _frames(RetailModel(spark, d)).items():
        rules = {f"{c}_max_{n}": Q.too_long(c, n) for c, n in _LENGTHS.get(t, [])}
        rules |= {f"{c}_decimal_{p}_{k}": Q.bad_number(c, p, k) for c, p, k in _NUMBERS.get(t, [])}
        parts.append(Q.row_rules(df, t, rules))
    return Q.union_all(parts)


def _domain_sql() -> str:
    def one_of(c: str, xs: list[str]) -> str:
        return f"{c} IS NULL OR {c} NOT IN ({', '.join(repr(x) for x in xs)})"
    parts = [_count_sql("deals", "deal_type_enum", one_of("deal_type", Q.DEAL_TYPES)),
             _count_sql("shop_orders", "order_status_enum", one_of("status", Q.ORDER_STATUSES)),
             _count_sql("chat_turns", "chat_message_length", "text IS NULL OR length(text) < 1 OR length(text) > 2000")]
    parts += [_count_sql(t, f"{c}_required", f"{c} IS NULL") for t, cols in _REQUIRED.items() for c in cols]
    return "\nUNION ALL ".join(parts)


@register("dq_domains", _domain_sql())
def q_dq_domains(spark, d):
    """K4: enum domains, required columns, chat message 1-2000 characters."""
    lo, hi = Q.CHAT_MESSAGE_CHARS
    own = {"deals": {"deal_type_enum": F.col("deal_type").isNull() | ~F.col("deal_type").isin(*Q.DEAL_TYPES)},
           "shop_orders": {"order_status_enum": F.col("status").isNull() | ~F.col("status").isin(*Q.ORDER_STATUSES)},
           "chat_turns": {"chat_message_length": F.col("text").isNull() | (F.length("text") < lo) | (F.length("text") > hi)}}
    return Q.union_all([Q.row_rules(df, t, own.get(t, {}) | {f"{c}_required": F.col(c).isNull() for c in _REQUIRED[t]})
                        for t, df in _frames(RetailModel(spark, d)).items()])
