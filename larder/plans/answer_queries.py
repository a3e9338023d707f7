"""Registered answer-building queries.

Questions are the user turns of the conversations (whole texts). The three
collections (products, deals, stores) are embedded with the hashed
bag-of-words provider, so questions and documents share one vector space.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import routing as R
from larder.functions.text import deal_description, deal_text, deal_title, product_text_pipeline, \
    store_text, unit_weight_from_name
from larder.operators import answers as A
from larder.operators import vectors as V
from larder.operators.parallel import wide
from larder.plans.registry import register
from larder.plans.deal_queries import DEAL_TEXT_SQL, title_sql
from larder.plans.routing_queries import _staff_sql
from larder.plans.sqlkit import avg_round, embedding_ctes, micro, micro_text
from larder.plans.text_queries import PRODUCT_TEXT_SQL, STORE_TEXT_SQL, unit_sql
from larder.session import AS_OF, AS_OF_SQL, ensure_checkpoint_dir
from larder.sources.views import RetailModel


def _questions(m: RetailModel):
    return (m.chat_turns.filter(F.col("role") == "user")
            .select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "conv_id", "turn", "text"))


def _stores(m: RetailModel):
    sup = m.table("supplier").select(F.col("s_suppkey").alias("store_id"), "s_nationkey")
    nat = m.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city"))
    return (m.stores.join(sup, "store_id").join(nat, "s_nationkey")
            .withColumn("address", F.concat(F.col("store_id").cast("string"), F.lit(" Market St")))
            .withColumn("state", F.lit("FL"))
            .withColumn("zip_code", F.format_string("%05d", F.lit(33800) + F.col("store_id")))
            .withColumn("phone", F.concat(F.lit("(863) 555-"), F.format_string("%04d", "store_id"))))


def _depths(questions, audience: str):
    """Per query_id, the most products, deals and stores that a retrieval plan (G8) under it takes.
    Without a row: every question under it is answered without retrieval (G7, for staff G4)."""
    plan = questions.withColumn("intent", R.classify_intent("text")).withColumn("plan", R.retrieval_plan("intent", audience=audience))
    asked = (R.with_staff_route(questions, "text").filter("type = 'rag'") if audience == "staff"
             else R.with_scenario(questions, "text").filter(~F.coalesce(F.col("skip_rag"), F.lit(False))))
    return (plan.select("query_id", "plan.*").groupBy("query_id").agg(*[F.max(k).alias(k) for k in ("k_products", "k_deals", "k_stores")])
            .join(asked.select("query_id"), "query_id", "left_semi"))


def _hits(spark, m: RetailModel, audience: str | None = None):
    """Questions and their hits in the three collections. With an ``audience``, a collection is
    searched for the questions whose retrieval plan takes hits from it; without, for all."""
    ensure_checkpoint_dir(spark)
    q = _questions(m)
    if audience:
        q = q.join(_depths(q, audience), "query_id", "left")
    q = q.withColumn("embedding", V.hashed_embedding("text")) \
        .withColumn("cat_filter", R.detect_category("text")).withColumn("deal_filter", R.detect_deal_type("text"))
    q = q.checkpoint(eager=True)  # embedded once, read by the searches of three collections
    asking = lambda k: q.filter(F.col(k) > 0) if audience else q
    cores = spark.sparkContext.defaultParallelism
    p = m.products.withColumn("unit", unit_weight_from_name("name")["unit"])
    pcoll = wide(p, cores).select(F.col("product_id").alias("vec_id"), "category", V.hashed_embedding(product_text_pipeline(
        "name", "category", F.split_part("name", F.lit(" "), F.lit(2)), "brand", "price", "description", "tags",
        "is_organic", "is_store_brand")).alias("embedding"))
    ph = (V.vector_top_k(asking("k_products"), pcoll, k=10, filter_col="category", query_filter_col="cat_filter")
          .join(p.select(F.col("product_id").alias("vec_id"), "sku", "name", "price", "unit", "category",
                         "is_organic", "brand"), "vec_id"))
    d = (m.deals.filter(F.col("is_active") & (F.col("end_date") > F.lit(AS_OF)))
         .join(p.select("product_id", F.col("name").alias("product_name"), F.col("sku").alias("product_sku"),
                        "category", "price"), "product_id")
         .withColumn("title", deal_title("deal_type", "discount_percent")))
    dcoll = wide(d, cores).select(F.col("deal_id").alias("vec_id"), "deal_type", V.hashed_embedding(deal_text(
        "title", "deal_type", "product_name", "category", "price",
        deal_description("deal_type", "discount_percent", "product_name"))).alias("embedding"))
    dh = (V.vector_top_k(asking("k_deals"), dcoll, k=8, filter_col="deal_type", query_filter_col="deal_filter")
          .join(d.select(F.col("deal_id").alias("vec_id"), "title", "product_name", "deal_type", "discount_percent",
                         "product_sku"), "vec_id"))
    s = _stores(m)
    scoll = wide(s, cores).select(F.col("store_id").alias("vec_id"), V.hashed_embedding(store_text(
        "name", "address", "city", "state", "zip_code", "phone", "store_number")).alias("embedding"))
    sh = V.vector_top_k(asking("k_stores"), scoll, k=5).join(
        s.select(F.col("store_id").alias("vec_id"), "name", "address", "city", "state", "zip_code", "phone"), "vec_id")
    return q.drop("k_products", "k_deals", "k_stores"), ph, dh, sh


def _top_sql(docs: str, k: int, where: str = "TRUE") -> str:
    """Best k of a collection for each question: score in ten digits, ties by id."""
    return (f"(SELECT query_id, vec_id, rank FROM (SELECT q.id AS query_id, x.id AS vec_id, row_number() OVER (PARTITION BY q.id "
            f"ORDER BY round(list_inner_product(q.embedding, x.embedding), 10) DESC, x.id) AS rank "
            f"FROM (SELECT * FROM eq JOIN questions USING (id)) q, (SELECT * FROM {docs}) x WHERE {where}) WHERE rank <= {k})")


_HITS_SQL = f"""questions AS (SELECT conv_id || ':' || turn AS id, text, {R.sql_detect_category("lower(text)")} AS cat,
  {R.sql_first_match("lower(text)", R.DEAL_TYPE_RULES)} AS kind FROM chat_turns WHERE role = 'user'),
{embedding_ctes("questions", "eq")},
pdocs AS (SELECT product_id AS id, {PRODUCT_TEXT_SQL} AS text FROM products),
{embedding_ctes("pdocs", "ep")},
live AS (SELECT d.*, p.name, p.sku FROM deals d JOIN products p USING (product_id) WHERE d.is_active AND d.end_date > {AS_OF_SQL}),
ddocs AS (SELECT deal_id AS id, text FROM ({DEAL_TEXT_SQL}) WHERE deal_id IN (SELECT deal_id FROM live)),
{embedding_ctes("ddocs", "ed")},
sdocs AS (SELECT store_id AS id, text FROM ({STORE_TEXT_SQL})),
{embedding_ctes("sdocs", "es")},
ph AS {_top_sql("ep JOIN products ON product_id = id", 10, "q.cat IS NULL OR q.cat = x.category")},
dh AS {_top_sql("ed JOIN live ON deal_id = id", 8, "q.kind IS NULL OR q.kind = x.deal_type")},
sh AS {_top_sql("es", 5)}"""

_CONTEXT_SQL = f"""
WITH {_HITS_SQL},
p AS (SELECT query_id, string_agg('- ' || name || ' | $' || printf('%.2f', CAST(price AS DOUBLE)) || '/' || {unit_sql("name")} || ' | ' || category
  || CASE WHEN is_organic THEN ' | Organic' ELSE '' END || CASE WHEN coalesce(brand, '') <> '' THEN ' | ' || brand ELSE '' END, chr(10) ORDER BY rank) AS block
  FROM ph JOIN products ON product_id = vec_id WHERE rank <= 8 GROUP BY query_id),
d AS (SELECT query_id, string_agg('- ' || {title_sql()} || ': ' || name || ' (' || deal_type || ')'
  || CASE WHEN coalesce(discount_percent, 0) <> 0 THEN ' — ' || CAST(discount_percent AS INT) || '% off' ELSE '' END, chr(10) ORDER BY rank) AS block
  FROM dh JOIN live ON deal_id = vec_id WHERE rank <= 5 GROUP BY query_id),
s AS (SELECT query_id, string_agg('- ' || s_name || ': ' || s_suppkey || ' Market St, ' || n_name || ', FL ' || printf('%05d', 33800 + s_suppkey)
  || ' | Phone: (863) 555-' || printf('%04d', s_suppkey), chr(10) ORDER BY rank) AS block
  FROM sh JOIN supplier ON s_suppkey = vec_id JOIN nation ON n_nationkey = s_nationkey WHERE rank <= 3 GROUP BY query_id)
SELECT id AS query_id, coalesce(nullif(concat_ws(chr(10), '=== Available Products ===' || chr(10) || p.block,
  chr(10) || '=== Current Deals ===' || chr(10) || d.block, chr(10) || '=== Store Locations ===' || chr(10) || s.block), ''),
  'No relevant products found in our catalog.') AS context
FROM questions LEFT JOIN p ON p.query_id = id LEFT JOIN d ON d.query_id = id LEFT JOIN s ON s.query_id = id"""


@register("build_context", _CONTEXT_SQL)
def q_build_context(spark, d):
    """Context block per question from the top product / deal / store hits."""
    m = RetailModel(spark, d)
    q, ph, dh, sh = _hits(spark, m)
    return A.build_context(q, ph, dh, sh)


@register("hit_deal_type", f"""
WITH {_HITS_SQL}
SELECT ph.query_id, CAST(ph.rank AS INTEGER) AS rank, p.sku, (SELECT min_by(live.deal_type, dh.rank) FROM dh JOIN live ON deal_id = dh.vec_id
  WHERE dh.query_id = ph.query_id AND live.sku = p.sku) AS deal_type
FROM ph JOIN products p ON p.product_id = ph.vec_id WHERE ph.rank <= 5""")
def q_hit_deal_type(spark, d):
    """Deal type of the best retrieved deal on each of the first 5 product hits."""
    m = RetailModel(spark, d)
    _, ph, dh, _ = _hits(spark, m)
    return A.hit_deal_type(ph, dh).select("query_id", "rank", "sku", "deal_type")


@register("chat_batch")
def q_chat_batch(spark, d):
    """G7 + G8 + G9 + G10 + G12 + C12: the customer flow over all user turns."""
    m = RetailModel(spark, d)
    q, ph, dh, sh = _hits(spark, m, "customer")
    return A.chat_batch(q.drop("embedding"), m.chat_turns, ph, dh, sh)


@register("build_messages_staff", """
WITH t AS (SELECT *, lag(ts_s) OVER (PARTITION BY conv_id ORDER BY ts_s, turn) AS prev FROM chat_turns WHERE role IN ('user', 'assistant')),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts_s - prev > 7200 THEN 1 ELSE 0 END) OVER (
  PARTITION BY conv_id ORDER BY ts_s, turn ROWS UNBOUNDED PRECEDING) AS sess FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sess ORDER BY turn) AS pos FROM s),
q AS (SELECT conv_id || ':' || turn AS query_id, * FROM p WHERE role = 'user')
SELECT query_id, CAST(2 + least(10, pos - 1) AS INTEGER) AS message_count,
  coalesce((SELECT string_agg(h.role || ': ' || h.text, chr(10) ORDER BY h.pos) FROM p h
            WHERE h.conv_id = q.conv_id AND h.sess = q.sess AND h.pos < q.pos AND h.pos >= q.pos - 10), '') AS history,
  'Based on the following product data:' || chr(10) || chr(10) || 'No relevant products found in our catalog.'
    || chr(10) || chr(10) || 'Staff question (manager): ' || text || ' You are speaking to a store manager.' AS user_message
FROM q""")
def q_build_messages_staff(spark, d):
    """G10 staff variant: staff prompt, manager suffix, last 10 turns of history."""
    m = RetailModel(spark, d)
    q = _questions(m).withColumn("context", F.lit(A.NO_CONTEXT))
    hist = A.history_window(m.chat_turns).select("conv_id", "turn", "history")
    msgs = A.build_messages(q.join(hist, ["conv_id", "turn"], "left"), prompt=A.STAFF_SYSTEM_PROMPT,
                            staff_role="manager")
    inner = F.slice("messages", F.lit(2), F.size("messages") - 2)
    return msgs.select("query_id", F.size("messages").alias("message_count"),
                       F.concat_ws("\n", F.transform(inner, lambda x: F.concat_ws(": ", x["role"], x["content"]))).alias("history"),
                       F.element_at("messages", -1)["content"].alias("user_message"))


def _flow_sql(plan: dict[str, tuple[int, int, int]]) -> str:
    """Context, references and history length of each question under a retrieval plan, written
    apart from the Spark flow: blocks of lines cut by the smaller of plan and context limit."""
    cap = lambda i, most: ("CASE qq.intent " + " ".join(f"WHEN '{k}' THEN {min(v[i], most)}" for k, v in plan.items() if k != "other")
                           + f" ELSE {min(plan['other'][i], most)} END")
    return f"""{_HITS_SQL},
qq AS (SELECT conv_id || ':' || turn AS id, conv_id, turn, text, {R.sql_classify_intent("lower(text)")} AS intent FROM chat_turns WHERE role = 'user'),
p AS (SELECT query_id, string_agg('- ' || name || ' | $' || printf('%.2f', CAST(price AS DOUBLE)) || '/' || {unit_sql("name")} || ' | ' || category
  || CASE WHEN is_organic THEN ' | Organic' ELSE '' END || CASE WHEN coalesce(brand, '') <> '' THEN ' | ' || brand ELSE '' END, chr(10) ORDER BY rank) AS block
  FROM ph JOIN qq ON qq.id = query_id JOIN products ON product_id = vec_id WHERE rank <= {cap(0, 8)} GROUP BY query_id),
d AS (SELECT query_id, string_agg('- ' || {title_sql()} || ': ' || name || ' (' || deal_type || ')'
  || CASE WHEN coalesce(discount_percent, 0) <> 0 THEN ' — ' || CAST(discount_percent AS INT) || '% off' ELSE '' END, chr(10) ORDER BY rank) AS block
  FROM dh JOIN qq ON qq.id = query_id JOIN live ON deal_id = vec_id WHERE rank <= {cap(1, 5)} GROUP BY query_id),
s AS (SELECT query_id, string_agg('- ' || s_name || ': ' || s_suppkey || ' Market St, ' || n_name || ', FL ' || printf('%05d', 33800 + s_suppkey)
  || ' | Phone: (863) 555-' || printf('%04d', s_suppkey), chr(10) ORDER BY rank) AS block
  FROM sh JOIN qq ON qq.id = query_id JOIN supplier ON s_suppkey = vec_id JOIN nation ON n_nationkey = s_nationkey WHERE rank <= {cap(2, 3)} GROUP BY query_id),
refs AS (SELECT ph.query_id, string_agg(p.sku || coalesce(':' || (SELECT min_by(live.deal_type, dh.rank) FROM dh JOIN live ON deal_id = dh.vec_id
    WHERE dh.query_id = ph.query_id AND live.sku = p.sku AND dh.rank <= {cap(1, 8)}), ''), ',' ORDER BY ph.rank) AS products
  FROM ph JOIN qq ON qq.id = ph.query_id JOIN products p ON p.product_id = ph.vec_id WHERE ph.rank <= {cap(0, 5)} GROUP BY ph.query_id),
ctx AS (SELECT qq.*, coalesce(nullif(concat_ws(chr(10), '=== Available Products ===' || chr(10) || p.block,
    chr(10) || '=== Current Deals ===' || chr(10) || d.block, chr(10) || '=== Store Locations ===' || chr(10) || s.block), ''),
    'No relevant products found in our catalog.') AS context, coalesce(refs.products, '') AS products
  FROM qq LEFT JOIN p ON p.query_id = id LEFT JOIN d ON d.query_id = id LEFT JOIN s ON s.query_id = id LEFT JOIN refs ON refs.query_id = id),
said AS (SELECT *, list_filter(string_split(context, chr(10)), lambda x: starts_with(x, '- ')) AS ls FROM ctx),
told AS (SELECT *, CASE WHEN len(ls) > 0 THEN 'Here is what I found:' || chr(10) || array_to_string(ls[1:3], chr(10)) ELSE context END AS generated FROM said),
spoken AS (SELECT *, lag(ts_s) OVER (PARTITION BY conv_id ORDER BY ts_s, turn) AS prev FROM chat_turns WHERE role IN ('user', 'assistant')),
sess AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts_s - prev > 7200 THEN 1 ELSE 0 END) OVER (
  PARTITION BY conv_id ORDER BY ts_s, turn ROWS UNBOUNDED PRECEDING) AS no FROM spoken),
hist AS (SELECT conv_id, turn, CAST(2 + least(10, row_number() OVER (PARTITION BY conv_id, no ORDER BY turn) - 1) AS INTEGER) AS message_count FROM sess)"""


def _refs():
    return F.array_join(F.transform("products", lambda p: F.concat(p["sku"], F.coalesce(F.concat(F.lit(":"), p["deal_type"]), F.lit("")))), ",")


@register("chat_batch_flat", f"""
WITH {_flow_sql(R.CUSTOMER_PLAN)},
u AS (SELECT *, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS q FROM told),
k AS (SELECT *, {R.sql_scenario_name("q")} AS scenario, coalesce({R.sql_scenario_skip("q")}, FALSE) AS skip, {R.sql_scenario_message("q")} AS message FROM u)
SELECT k.id AS query_id, intent, scenario, CASE WHEN skip THEN 'custom' ELSE 'template' END AS model,
  CASE WHEN skip THEN message ELSE coalesce(message || chr(10) || chr(10), '') || generated END AS response,
  CASE WHEN skip THEN '' ELSE products END AS products, message_count
FROM k JOIN hist USING (conv_id, turn)""")
def q_chat_batch_flat(spark, d):
    """The customer flow, its product references as one text."""
    m = RetailModel(spark, d)
    q, ph, dh, sh = _hits(spark, m, "customer")
    out = A.chat_batch(q.drop("embedding"), m.chat_turns, ph, dh, sh)
    return out.select("query_id", "intent", "scenario", "model", "response", _refs().alias("products"), "message_count")


@register("staff_chat", f"""
WITH {_flow_sql(R.STAFF_PLAN)},
route AS (WITH {_staff_sql()})
SELECT told.id AS query_id, coalesce(action, 'rag') AS action, CASE WHEN action IS NULL THEN intent END AS intent,
  CASE WHEN action IS NULL THEN 'template' ELSE 'db_direct' END AS model, CASE WHEN action IS NULL THEN generated END AS generated,
  CASE WHEN action IS NULL THEN md5('Based on the following product data:' || chr(10) || chr(10) || context || chr(10) || chr(10)
    || 'Staff question (manager): ' || text || ' You are speaking to a store manager.') END AS prompt_md5,
  CASE WHEN action IS NULL THEN products ELSE '' END AS products, CASE WHEN action IS NULL THEN message_count ELSE 0 END AS message_count
FROM told JOIN hist USING (conv_id, turn) JOIN route USING (conv_id, turn)""")
def q_staff_chat(spark, d):
    """G12, staff form, asked by a manager (the texts of catalogue answers are staff_answer_catalog's)."""
    m = RetailModel(spark, d)
    q, ph, dh, sh = _hits(spark, m, "staff")
    out = A.staff_chat_batch(q.drop("embedding"), m.chat_turns, ph, dh, sh, m.products, m.categories, m.deals, as_of=AS_OF, staff_role="Manager")
    return out.select("query_id", "action", "intent", "model", F.when(F.col("action") == "rag", F.col("response")).alias("generated"),
                      F.md5("prompt").alias("prompt_md5"), _refs().alias("products"), "message_count")


@register("staff_answer")
def q_staff_answer(spark, d):
    """Every user turn routed as a staff question and answered from the catalogue."""
    m = RetailModel(spark, d)
    qs = _questions(m).select(F.col("query_id").alias("question_id"), "text")
    return A.staff_answer(qs, m.products, m.categories, m.deals, as_of=AS_OF)


@register("index_stores", f"""WITH docs AS (SELECT store_id AS id, text FROM ({STORE_TEXT_SQL})),
{embedding_ctes("docs", "e")}
SELECT id AS vec_id, store_number, {micro()} AS embedding FROM e JOIN stores ON store_id = id""")
def q_index_stores(spark, d):
    """H4 (stores): store text -> hashed embedding -> collection rows (vectors as text)."""
    s = _stores(RetailModel(spark, d))
    docs = s.select(F.col("store_id").alias("vec_id"), "store_number",
                    store_text("name", "address", "city", "state", "zip_code", "phone", "store_number").alias("text"))
    return V.embed_texts(docs, "text").select("vec_id", "store_number", micro_text("embedding"))


@register("index_deals", f"""WITH docs AS (SELECT deal_id AS id, text FROM ({DEAL_TEXT_SQL})),
{embedding_ctes("docs", "e")}
SELECT id AS vec_id, deal_type, sku AS product_sku, {micro()} AS embedding FROM e JOIN deals d ON deal_id = id LEFT JOIN products p ON p.product_id = d.product_id""")
def q_index_deals(spark, d):
    """H4 (deals): deal text (product fields joined, defaults for unknown
    products) -> hashed embedding, partitioned by deal type (vectors as text)."""
    m = RetailModel(spark, d)
    dl = (m.deals.join(m.products.select("product_id", F.col("name").alias("product_name"),
                                         F.col("sku").alias("product_sku"), "category", "price"), "product_id", "left")
          .withColumn("title", deal_title("deal_type", "discount_percent")))
    docs = dl.select(F.col("deal_id").alias("vec_id"), "deal_type", "product_sku", deal_text(
        "title", "deal_type", "product_name", "category", "price",
        deal_description("deal_type", "discount_percent", F.coalesce("product_name", F.lit("Unknown")))).alias("text"))
    return V.embed_texts(docs, "text").select("vec_id", "deal_type", "product_sku", micro_text("embedding"))


@register("persist_messages")
def q_persist_messages(spark, d):
    """I5 + F17: message rows persisted for every answered user turn (rows-only)."""
    from larder.operators.sessions import persist_messages
    m = RetailModel(spark, d)
    q, ph, dh, sh = _hits(spark, m, "customer")
    out = A.chat_batch(q.drop("embedding"), m.chat_turns, ph, dh, sh)
    return persist_messages(out, q)


# Staff questions of the reference's own tests (one per action).
STAFF_EXAMPLES = [
    "How many products do we carry?", "How many organic products are there?", "How many BOGO deals are active?",
    "Total weekly deals?", "What deals are expiring today?", "Show me all categories",
    "What are the cheapest fresh products?", "Most expensive meat products?", "Show products under $5 in beverages",
    "What brands do we carry in deli?", "Show me our private label products", "Give me a deal summary",
    "What subcategories do we have in baby?", "A customer is asking about meal planning suggestions",
]


@register("staff_answer_examples")
def q_staff_answer_examples(spark, d):
    """G11 over the whole catalogue: every action handler answers its example
    question from the full product / deal / category tables (rows-only)."""
    m = RetailModel(spark, d)
    qs = spark.createDataFrame(list(enumerate(STAFF_EXAMPLES)), "question_id long, text string")
    return A.staff_answer(qs, m.products, m.categories, m.deals, as_of=AS_OF)


def _calls_sql(products: str, deals: str) -> str:
    """Routed staff calls over all categories, brands, deal types and price steps of the
    catalogue (the same text in both engines)."""
    none = {"category": "CAST(NULL AS STRING)", "brand": "CAST(NULL AS STRING)", "organic_only": "false",
            "deal_type": "CAST(NULL AS STRING)", "cap": "CAST(NULL AS BIGINT)"}

    def call(action: str, source: str = "", **cols: str) -> str:
        return (f"SELECT '{action}' AS action, " + ", ".join(f"{cols.get(c, v)} AS {c}" for c, v in none.items())
                + (f" FROM {source}" if source else ""))
    cats = f"(SELECT DISTINCT category FROM {products}) t"
    parts = [call(a) for a in ("expiring_deals", "list_categories", "deal_summary", "count_deals", "count_products")]
    for a in ("cheapest_products", "most_expensive_products", "store_brand_products", "list_brands", "list_subcategories"):
        parts += [call(a), call(a, cats, category="category")]
    parts += [call("count_products", cats, category="category"), call("count_products", cats, category="category", organic_only="true"),
              call("count_products", f"(SELECT DISTINCT category, lower(brand) AS b FROM {products} WHERE brand IS NOT NULL) t",
                   category="category", brand="b"),
              call("count_products", f"(SELECT DISTINCT substr(lower(brand), 2, 5) AS b FROM {products} WHERE brand IS NOT NULL) t",
                   brand="b", organic_only="true"),
              call("count_deals", f"(SELECT DISTINCT deal_type AS dt FROM {deals}) t", deal_type="dt"),
              call("products_under_price", f"(SELECT DISTINCT CAST(ceil(price / 20) * 20 AS BIGINT) AS c FROM {products}) t", cap="c"),
              call("products_under_price", f"(SELECT DISTINCT category, CAST(ceil(price / 20) * 20 AS BIGINT) AS c FROM {products}) t",
                   category="category", cap="c")]
    body = " UNION ALL ".join(parts)
    key = "concat_ws(':', action, category, brand, CAST(organic_only AS STRING), deal_type, CAST(cap AS STRING))"
    return f"SELECT {key} AS question_id, q.*, CAST(cap AS DOUBLE) AS max_price FROM ({body}) q"


_UNIT = "CASE WHEN product_id % 3 = 0 THEN 'lb' ELSE 'each' END"
_IN = "CASE WHEN c.category IS NULL THEN '' ELSE ' in ' || c.category END"
_OF = "(c.category IS NULL OR a.category = c.category)"


def _pick(line: str, order: str, n: int, where: str = "TRUE") -> str:
    """Lines of the first n available products of a call's category, each after a newline."""
    return (f"coalesce((SELECT string_agg(chr(10) || {line}, '' ORDER BY {order}) FROM "
            f"(SELECT * FROM avail a WHERE {_OF} AND {where} ORDER BY {order} LIMIT {n}) s), '')")


_PRICED = "' — $' || printf('%.2f', CAST(price AS DOUBLE)) || '/' || unit || ' [' || sku || ']'"
_LINE = f"'- ' || name || CASE WHEN coalesce(brand, '') <> '' THEN ' (' || brand || ')' ELSE '' END || {_PRICED}"


def _grouped(col: str, extra: str = "''") -> str:
    return (f"(SELECT coalesce(string_agg(chr(10) || '- ' || v || ' — ' || n || ' products', '' ORDER BY n DESC, v) FILTER (r <= 15), '') || {extra} "
            f"FROM (SELECT {col} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {col}) AS r FROM avail a "
            f"WHERE {_OF} AND {col} IS NOT NULL GROUP BY {col}) s)")


_STAFF_ORACLE = f"""
WITH calls AS ({_calls_sql("products", "deals")}),
avail AS (SELECT *, {_UNIT} AS unit FROM products WHERE is_available),
live AS (SELECT * FROM deals WHERE is_active AND end_date > {AS_OF_SQL}),
ending AS (SELECT d.*, p.name, p.sku FROM deals d JOIN products p USING (product_id) WHERE d.is_active
  AND d.end_date BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + INTERVAL '23 hours 59 minutes 59 seconds' ORDER BY end_date, deal_id LIMIT 20),
kinds AS (SELECT deal_type, count(*) AS n, {avg_round('discount_percent', digits=1)} AS pct FROM live GROUP BY deal_type),
answered AS (SELECT question_id, action, CASE action
 WHEN 'count_products' THEN 'We carry **' || (SELECT count(*) FROM avail a WHERE {_OF} AND (c.brand IS NULL OR contains(lower(a.brand), c.brand))
   AND (NOT c.organic_only OR a.is_organic)) || '** ' || coalesce(nullif(concat_ws(' ', CASE WHEN c.organic_only THEN 'organic' END,
   'in ' || c.category, 'from ' || c.brand), ''), 'total') || ' products.'
 WHEN 'count_deals' THEN 'We have **' || (SELECT count(*) FROM live l WHERE c.deal_type IS NULL OR l.deal_type = c.deal_type) || '** '
   || coalesce(c.deal_type, 'active') || ' deals right now.'
 WHEN 'expiring_deals' THEN coalesce((SELECT '**' || count(*) || ' deals expiring today:**' || string_agg(chr(10) || '- ' || name || ' (' || sku
   || ') — ' || {title_sql()} || ' (' || deal_type || ')', '' ORDER BY end_date, deal_id) FROM ending HAVING count(*) > 0), 'No deals expiring today.')
 WHEN 'list_categories' THEN '**Categories:**' || (SELECT string_agg(chr(10) || '- ' || category || ' — '
   || (SELECT count(*) FROM avail a WHERE a.category = k.category) || ' products', '' ORDER BY display_order) FROM categories k WHERE is_active)
 WHEN 'deal_summary' THEN '**Active deals: ' || (SELECT count(*) FROM live) || ' total**' || (SELECT string_agg(chr(10) || '- ' || deal_type || ': ' || n
   || ' deals' || CASE WHEN coalesce(pct, 0) <> 0 THEN ', avg ' || pct || '% off' ELSE '' END, '' ORDER BY n DESC, deal_type) FROM kinds)
 WHEN 'cheapest_products' THEN '**Cheapest products' || {_IN} || ':**' || {_pick(_LINE, 'price, product_id', 5)}
 WHEN 'most_expensive_products' THEN '**Most Expensive products' || {_IN} || ':**' || {_pick(_LINE, 'price DESC, product_id', 5)}
 WHEN 'store_brand_products' THEN '**Store brand products' || {_IN} || ' (' || (SELECT count(*) FROM avail WHERE is_store_brand) || ' total, showing '
   || (SELECT least(10, count(*)) FROM avail a WHERE {_OF} AND is_store_brand) || '):**' || {_pick("'- ' || name || " + _PRICED, 'name, product_id', 10, 'is_store_brand')}
 WHEN 'products_under_price' THEN '**' || (SELECT count(*) FROM avail a WHERE {_OF} AND a.price < c.cap) || ' products under $' || c.cap || '.00' || {_IN}
   || ' (showing ' || (SELECT least(10, count(*)) FROM avail a WHERE {_OF} AND a.price < c.cap) || '):**' || {_pick(_LINE, 'price, product_id', 10, 'a.price < c.cap')}
 WHEN 'list_brands' THEN '**' || (SELECT count(DISTINCT brand) FROM avail a WHERE {_OF}) || ' brands' || {_IN} || ':**' || {_grouped('brand', "CASE WHEN count(*) > 15 THEN chr(10) || '  ...and ' || (count(*) - 15) || ' more' ELSE '' END")}
 WHEN 'list_subcategories' THEN '**Top product tags' || {_IN} || ':**' || {_grouped('tags')} END AS answer FROM calls c)
SELECT * FROM answered"""


@register("staff_brand_rows", """
WITH a AS (SELECT p.category, p.brand FROM products p JOIN categories c ON c.category = p.category WHERE p.is_available AND p.brand IS NOT NULL),
n AS (SELECT category, brand, count(*) AS product_count FROM a GROUP BY category, brand
      UNION ALL SELECT NULL, brand, count(*) FROM a GROUP BY brand)
SELECT category, brand, product_count FROM n""")
def q_staff_brand_rows(spark, d):
    """The data rows of list_brands, over the catalogue and for each category (all of them, the text lists 15)."""
    m = RetailModel(spark, d)
    calls = spark.sql("""SELECT coalesce(category, '*') AS question_id, 'list_brands' AS action, category, CAST(NULL AS STRING) AS brand, false AS organic_only,
        CAST(NULL AS STRING) AS deal_type, CAST(NULL AS DOUBLE) AS max_price FROM (SELECT DISTINCT category FROM {p} UNION ALL SELECT NULL)""", p=m.products)
    out = A.staff_answer_calls(calls, m.products, m.categories, m.deals, as_of=AS_OF)
    rows = F.explode(F.from_json("data", "array<struct<brand:string,product_count:bigint>>")).alias("x")
    return out.select(F.when(F.col("question_id") != "*", F.col("question_id")).alias("category"), rows).select("category", "x.*")


@register("staff_answer_catalog", _STAFF_ORACLE)
def q_staff_answer_catalog(spark, d):
    """Every action for every category, brand, deal type and price step of the catalogue."""
    m = RetailModel(spark, d)
    calls = spark.sql(_calls_sql("{products}", "{deals}"), products=m.products, deals=m.deals)
    prod = m.products.withColumn("unit", F.expr(_UNIT))
    return A.staff_answer_calls(calls, prod, m.categories, m.deals, as_of=AS_OF).select("question_id", "action", "answer")
