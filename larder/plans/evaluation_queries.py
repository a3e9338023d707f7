"""Registered evaluation queries (D17, D19-D22) over whole chat turns and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.routing import classify_intent, sql_classify_intent, sql_scenario_skip
from larder.operators import evaluation as E
from larder.plans.registry import register
from larder.sources.views import RetailModel

# Golden prompt cases (question, must contain, must not contain).
GOLDEN_CASES = [
    ("What baby products are on BOGO?", ["bogo", "buy one", "baby"], ["store location", "hours"]),
    ("Where is the nearest store?", ["store", "lakeland"], []),
    ("What are today's daily deals?", ["deal", "today", "%"], []),
    ("Do you have organic milk?", ["organic", "$"], []),
    ("How much is ground beef?", ["beef", "$"], ["store", "location"]),
    ("What's the weather like today?", ["grocer"], ["temperature", "forecast"]),
]
# Prompt A/B test queries with expected keywords, and the variants.
AB_QUERIES = [
    ("What baby products are on BOGO?", ["bogo", "baby", "$"]),
    ("Find me organic vegetables", ["organic", "vegetable", "$"]),
    ("I need coffee for the week", ["coffee", "$"]),
    ("What store is closest to Winter Haven?", ["winter haven", "store"]),
    ("Recommend ingredients for tacos", ["$"]),
]
VARIANTS = ["A_baseline", "B_structured", "C_persona"]


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]::VARCHAR[]"


def _golden_values_sql() -> str:
    rows = ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}', {_sql_list(a)}, {_sql_list(b)})"
                     for i, (q, a, b) in enumerate(GOLDEN_CASES))
    return f"(VALUES {rows}) AS g(case_id, question, must_contain, must_not_contain)"


def _ab_values_sql() -> str:
    rows = ", ".join(f"({i}, '{q.replace(chr(39), chr(39) * 2)}', {_sql_list(k)})" for i, (q, k) in enumerate(AB_QUERIES))
    return f"(VALUES {rows}) AS a(query_id, query, expected_keywords)"


def _answers(m: RetailModel):
    """Assistant turns are the answers under evaluation (whole texts)."""
    return m.chat_turns.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))


@register("latency_percentiles", """
WITH t AS (SELECT event_type AS stage, value * 100.0 AS latency_ms FROM events),
s AS (SELECT stage, count(*) AS n, avg(latency_ms) AS mean, median(latency_ms) AS p50,
  list_sort(list(latency_ms)) AS xs FROM t GROUP BY stage)
SELECT stage, n, round(mean, 6) AS mean, round(p50, 6) AS p50,
  round(xs[CAST(floor(n * 0.95) AS BIGINT) + 1], 6) AS p95, round(xs[CAST(floor(n * 0.99) AS BIGINT) + 1], 6) AS p99,
  xs[CAST(floor(n * 0.95) AS BIGINT) + 1] < 30000 AS passed FROM s""")
def q_latency_percentiles(spark, d):
    """p50 / p95 / p99 (reference index rule) and mean per event stage."""
    ev = RetailModel(spark, d).table("events")
    t = ev.select(F.col("event_type").alias("stage"), (F.col("value") * 100.0).alias("latency_ms"))
    out = E.latency_percentiles(t, threshold_ms=30000.0)
    return out.select("stage", "n", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"),
                      F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"), "passed")


@register("golden_regression", f"""
WITH a AS (SELECT conv_id, turn, text AS response, conv_id % 6 AS case_id FROM chat_turns WHERE role = 'assistant'),
j AS (SELECT a.*, g.question,
  list_filter(g.must_contain, lambda kw: NOT contains(lower(a.response), lower(kw))) AS missing,
  list_filter(g.must_not_contain, lambda kw: contains(lower(a.response), lower(kw))) AS unwanted
  FROM a JOIN {_golden_values_sql()} ON a.case_id = g.case_id)
SELECT conv_id, turn, question, array_to_string(missing, '|') AS missing, array_to_string(unwanted, '|') AS unwanted,
  len(missing) = 0 AND len(unwanted) = 0 AS passed FROM j""")
def q_golden_regression(spark, d):
    """Golden keyword checks on every assistant answer (case by conversation)."""
    m = RetailModel(spark, d)
    schema = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("question", T.StringType()),
                           T.StructField("must_contain", T.ArrayType(T.StringType())),
                           T.StructField("must_not_contain", T.ArrayType(T.StringType()))])
    cases = spark.createDataFrame([(i, q, a, b) for i, (q, a, b) in enumerate(GOLDEN_CASES)], schema)
    ans = _answers(m).withColumn("case_id", F.col("conv_id") % len(GOLDEN_CASES))
    out = E.golden_regression(ans, cases)
    return out.select("conv_id", "turn", "question", F.array_join("missing", "|").alias("missing"),
                      F.array_join("unwanted", "|").alias("unwanted"), "passed")


def _scored(spark, m: RetailModel):
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query", T.StringType()),
                           T.StructField("expected_keywords", T.ArrayType(T.StringType()))])
    qs = spark.createDataFrame([(i, q, k) for i, (q, k) in enumerate(AB_QUERIES)], schema)
    ans = (_answers(m).withColumn("query_id", F.col("conv_id") % len(AB_QUERIES))
           .withColumn("variant_order", (F.col("conv_id") % len(VARIANTS)).cast("int"))
           .withColumn("variant", F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), F.col("variant_order") + 1)))
    return E.response_score(ans.join(qs, "query_id", "inner"))


_SCORED_SQL = f"""
a AS (SELECT conv_id, turn, text AS response, conv_id % 5 AS query_id, CAST(conv_id % 3 AS INTEGER) AS variant_order,
  (['A_baseline', 'B_structured', 'C_persona'])[conv_id % 3 + 1] AS variant FROM chat_turns WHERE role = 'assistant'),
j AS (SELECT a.*, q.expected_keywords FROM a JOIN {_ab_values_sql()} ON a.query_id = q.query_id),
s AS (SELECT *,
  CASE WHEN len(expected_keywords) > 0 THEN CAST(len(list_filter(expected_keywords, lambda kw: contains(lower(response), lower(kw)))) AS DOUBLE)
    / CAST(len(expected_keywords) AS DOUBLE) ELSE 1.0 END AS keyword_score,
  contains(response, '$') AS has_price,
  (contains(lower(response), 'bogo') OR contains(lower(response), 'deal') OR contains(lower(response), 'off')
   OR contains(lower(response), 'save') OR contains(lower(response), '% off')) AS has_deal,
  length(response) < 1000 AS is_concise,
  length(response) - length(replace(response, '$', '')) >= 1 AS has_products,
  length(response) AS response_length FROM j),
sc AS (SELECT *, keyword_score * 0.4 + (CASE WHEN has_price THEN 1.0 ELSE 0.0 END) * 0.2
  + (CASE WHEN has_deal THEN 1.0 ELSE 0.0 END) * 0.15 + (CASE WHEN is_concise THEN 1.0 ELSE 0.0 END) * 0.1
  + (CASE WHEN has_products THEN 1.0 ELSE 0.0 END) * 0.15 AS composite_score FROM s)"""


@register("response_score", f"""WITH {_SCORED_SQL.replace('AS q(', 'AS q(').replace(') AS a(query_id', ') AS q(query_id')}
SELECT conv_id, turn, variant, round(keyword_score, 9) AS keyword_score, has_price, has_deal, is_concise, has_products,
  response_length, round(composite_score, 9) AS composite_score FROM sc""")
def q_response_score(spark, d):
    """Composite response score of every assistant answer."""
    out = _scored(spark, RetailModel(spark, d))
    return out.select("conv_id", "turn", "variant", F.round("keyword_score", 9).alias("keyword_score"),
                      "has_price", "has_deal", "is_concise", "has_products",
                      F.col("response_length").cast("bigint").alias("response_length"),
                      F.round("composite_score", 9).alias("composite_score"))


@register("variant_comparison", f"""WITH {_SCORED_SQL.replace(') AS a(query_id', ') AS q(query_id')},
v AS (SELECT variant, variant_order, avg(composite_score) AS avg_composite, avg(keyword_score) AS avg_keyword,
  avg(CASE WHEN has_price THEN 1.0 ELSE 0.0 END) AS price_mention_rate,
  avg(CASE WHEN has_deal THEN 1.0 ELSE 0.0 END) AS deal_mention_rate FROM sc GROUP BY variant, variant_order),
b AS (SELECT max(avg_composite) AS best FROM v),
f AS (SELECT min(variant_order) AS first FROM v, b WHERE v.avg_composite = b.best)
SELECT variant, round(avg_composite, 6) AS avg_composite, round(avg_keyword, 6) AS avg_keyword,
  round(price_mention_rate, 6) AS price_mention_rate, round(deal_mention_rate, 6) AS deal_mention_rate,
  variant_order = f.first AND b.best > 0 AS is_winner FROM v, b, f""")
def q_variant_comparison(spark, d):
    """Prompt-variant averages and the winner."""
    out = E.variant_comparison(_scored(spark, RetailModel(spark, d)))
    return out.select("variant", *[F.round(c, 6).alias(c) for c in
                                   ("avg_composite", "avg_keyword", "price_mention_rate", "deal_mention_rate")],
                      "is_winner")


@register("chat_metrics_intents", f"""
SELECT {sql_classify_intent('lower(text)')} AS intent, count(*) AS requests
FROM chat_turns WHERE role = 'user' GROUP BY 1""")
def q_chat_metrics_intents(spark, d):
    """Requests by intent."""
    t = RetailModel(spark, d).chat_turns.filter(F.col("role") == "user")
    return t.groupBy(classify_intent("text").alias("intent")).agg(F.count(F.lit(1)).alias("requests"))


@register("chat_metrics_latency", """
WITH b AS (SELECT unnest(['0.5', '1.0', '2.0', '3.0', '5.0', '10.0', '30.0', '+Inf']) AS le,
                  unnest([0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 30.0, 'inf'::DOUBLE]) AS bound)
SELECT b.le, (SELECT count(*) FROM events e WHERE e.value <= b.bound) AS count FROM b""")
def q_chat_metrics_latency(spark, d):
    """Cumulative latency histogram (seconds) of the event stream."""
    ev = RetailModel(spark, d).table("events")
    return E.latency_histogram(ev, value="value")


RETRIEVED_BOUNDS = [0.0, 1.0, 3.0, 5.0, 10.0, 20.0]


@register("chat_metrics_retrieved", f"""
WITH u AS (SELECT {sql_classify_intent('lower(text)')} AS intent,
  coalesce({sql_scenario_skip("regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')")}, FALSE) AS skip
  FROM chat_turns WHERE role = 'user'),
n AS (SELECT CASE WHEN skip THEN 0 WHEN intent = 'store_info' THEN 8 WHEN intent = 'deal_inquiry' THEN 13 ELSE 13 END AS retrieved FROM u),
b AS (SELECT unnest(['0.0', '1.0', '3.0', '5.0', '10.0', '20.0', '+Inf']) AS le,
             unnest([0.0, 1.0, 3.0, 5.0, 10.0, 20.0, 'inf'::DOUBLE]) AS bound)
SELECT b.le, (SELECT count(*) FROM n WHERE n.retrieved <= b.bound) AS count FROM b""")
def q_chat_metrics_retrieved(spark, d):
    """Cumulative histogram of documents retrieved per request (the
    retrieval plan's products + deals + stores; scenario answers retrieve none)."""
    from larder.functions import routing as R
    t = RetailModel(spark, d).chat_turns.filter(F.col("role") == "user").select("text")
    t = R.with_scenario(R.with_intent(t, "text"), "text")
    plan = R.retrieval_plan("intent")
    n = t.select(F.when(F.coalesce("skip_rag", F.lit(False)), F.lit(0))
                 .otherwise(plan["k_products"] + plan["k_deals"] + plan["k_stores"]).alias("retrieved"))
    return E.latency_histogram(n, value="retrieved", bounds=RETRIEVED_BOUNDS)


@register("chat_metrics_embed_status", """
SELECT CASE WHEN len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda s: length(s) > 0)) > 0
            THEN 'ok' ELSE 'empty' END AS status, count(*) AS requests
FROM documents GROUP BY 1""")
def q_chat_metrics_embed_status(spark, d):
    """Embedding requests by status over all documents (a text without
    any word yields a zero vector: status 'empty')."""
    from larder.operators.vectors import token_buckets
    docs = RetailModel(spark, d).table("documents")
    st = F.when(F.size(token_buckets("text")) > 0, F.lit("ok")).otherwise(F.lit("empty"))
    return docs.groupBy(st.alias("status")).agg(F.count(F.lit(1)).alias("requests"))
