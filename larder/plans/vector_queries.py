"""Registered vector queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.functions.text import product_text_pipeline
from larder.operators import bucket_store as B
from larder.operators import vectors as V
from larder.operators.evaluation import retrieval_quality
from larder.plans.registry import register
from larder.plans.sqlkit import embedding_ctes, micro, micro_text
from larder.plans.text_queries import PRODUCT_TEXT_SQL
from larder.session import ensure_checkpoint_dir
from larder.sources.views import RetailModel

_CENTROIDS_SQL = """
ex AS (SELECT category, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM vectors),
cd AS (SELECT category, pos, avg(CAST(v AS DOUBLE)) AS v FROM ex GROUP BY category, pos),
cen AS (SELECT category, list(v ORDER BY pos) AS cv FROM cd GROUP BY category)"""


def _topk_sql(k: int, filtered: bool) -> str:
    where = "WHERE x.category = cen.category" if filtered else ""
    return f"""WITH {_CENTROIDS_SQL},
s AS (SELECT cen.category AS query_id, x.vec_id,
        list_cosine_similarity(cen.cv, CAST(x.embedding AS DOUBLE[])) AS score FROM cen, vectors x {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def _centroid_queries(m: RetailModel):
    return V.category_centroids(m.vectors).withColumnRenamed("category", "query_id") \
        .withColumn("query_filter", F.col("query_id"))


@register("vector_top_k", _topk_sql(5, False))
def q_vector_top_k(spark, d):
    """Exact cosine top-5 of each category centroid over all vectors."""
    m = RetailModel(spark, d)
    hits = V.vector_top_k(_centroid_queries(m), m.vectors, k=5)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _stored_clusters(spark, m: RetailModel):
    """The collection by pivots in the shared checkpoint folder, and its clusters."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vector-clusters-{uuid.uuid4().hex}"
    clusters = V.pivot_clusters(m.vectors, path)
    return spark.read.parquet(path), clusters


@register("vector_top_k_pruned", _topk_sql(5, False))
def q_vector_top_k_pruned(spark, d):
    """H2 / E7 by pivot clusters: the same rows as vector_top_k."""
    m = RetailModel(spark, d)
    stored, clusters = _stored_clusters(spark, m)
    hits = V.vector_top_k_pruned(_centroid_queries(m), stored, clusters, k=5)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@register("filtered_top_k_pruned", _topk_sql(5, True))
def q_filtered_top_k_pruned(spark, d):
    """H3 by pivot clusters: the same rows as filtered_top_k."""
    m = RetailModel(spark, d)
    stored, clusters = _stored_clusters(spark, m)
    hits = V.vector_top_k_pruned(_centroid_queries(m), stored, clusters, k=5, filter_col="category", query_filter_col="query_filter")
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@register("filtered_top_k_partitioned", _topk_sql(5, True).replace("FROM cen, vectors x WHERE", "FROM cen, vectors x WHERE cen.category >= 'c3' AND"))
def q_filtered_top_k_partitioned(spark, d):
    """H3 by partition pruning: the collection is stored by category, the queries ask for some of them."""
    m = RetailModel(spark, d)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vector-partitions-{uuid.uuid4().hex}"
    V.vector_collection_write(m.vectors, path, partition_by="category")
    hits = V.vector_top_k_partitioned(_centroid_queries(m).filter("query_id >= 'c3'"), path, k=5, filter_col="category", query_filter_col="query_filter")
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@register("vector_top_k_ties", """
WITH v AS (SELECT vec_id, category, list_transform(embedding[1:6], lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS e FROM vectors),
q AS (SELECT category AS query_id, arg_min(e, vec_id) AS qe FROM v GROUP BY category),
s AS (SELECT q.query_id, v.vec_id, round(list_cosine_similarity(qe, e), 10) AS score FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40""")
def q_vector_top_k_ties(spark, d):
    """H2 on vectors of six signs: most scores are equal, so the cut is by id."""
    v = RetailModel(spark, d).vectors
    sign = F.transform(F.slice("embedding", 1, 6), lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    v = v.select("vec_id", "category", sign.alias("embedding"))
    q = v.groupBy(F.col("category").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return V.vector_top_k(q, v, k=40).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@register("filtered_top_k", _topk_sql(5, True))
def q_filtered_top_k(spark, d):
    """H3: top-5 with a payload equality filter (the query's own category)."""
    m = RetailModel(spark, d)
    hits = V.vector_top_k(_centroid_queries(m), m.vectors, k=5, filter_col="category",
                          query_filter_col="query_filter")
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@register("retrieval_quality", f"""WITH {_CENTROIDS_SQL},
s AS (SELECT cen.category AS query_id, x.vec_id, x.category AS hit_category,
        list_cosine_similarity(cen.cv, CAST(x.embedding AS DOUBLE[])) AS score FROM cen, vectors x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
h AS (SELECT r.query_id, r.hit_category, p.sku FROM r LEFT JOIN products p ON p.product_id = r.vec_id WHERE rank <= 5),
cs AS (SELECT v.category AS query_id, v.category AS expected_category,
         (SELECT substr(p.sku, 1, 4) FROM products p WHERE p.product_id = min(v.vec_id)) AS expected_prefix
       FROM vectors v GROUP BY v.category),
pc AS (SELECT cs.query_id, cs.expected_category, cs.expected_prefix,
  coalesce(avg(CASE WHEN h.hit_category = cs.expected_category THEN 1.0 ELSE 0.0 END), 0.0) AS precision,
  coalesce(bool_or(h.hit_category = cs.expected_category), FALSE) AS category_hit,
  coalesce(bool_or(starts_with(h.sku, cs.expected_prefix)), FALSE) AS sku_hit,
  count(h.query_id) AS retrieved_count
  FROM cs LEFT JOIN h ON cs.query_id = h.query_id GROUP BY cs.query_id, cs.expected_category, cs.expected_prefix)
SELECT query_id, expected_category, expected_prefix, round(precision, 6) AS precision, category_hit, sku_hit,
  retrieved_count, CASE WHEN category_hit AND sku_hit THEN 'PASS' ELSE 'FAIL' END AS status,
  round((SELECT avg(precision) FROM pc), 6) AS avg_precision,
  round((SELECT avg(CASE WHEN category_hit THEN 1.0 ELSE 0.0 END) FROM pc), 6) AS category_accuracy,
  (SELECT avg(precision) FROM pc) >= 0.7 AND (SELECT avg(CASE WHEN category_hit THEN 1.0 ELSE 0.0 END) FROM pc) >= 0.8 AS gates_pass
FROM pc""")
def q_retrieval_quality(spark, d):
    """Precision / category hit / sku-prefix hit of centroid retrieval,
    with the averaged gates (0.7 precision, 0.8 category accuracy)."""
    m = RetailModel(spark, d)
    hits = V.vector_top_k(_centroid_queries(m), m.vectors, k=5)
    hits = (hits.join(m.vectors.select("vec_id", F.col("category").alias("hit_category")), "vec_id")
            .join(m.products.select(F.col("product_id").alias("vec_id"), "sku"), "vec_id", "left"))
    first = m.vectors.groupBy("category").agg(F.min("vec_id").alias("vec_id"))
    cases = (first.join(m.products.select(F.col("product_id").alias("vec_id"), "sku"), "vec_id", "left")
             .select(F.col("category").alias("query_id"), F.col("category").alias("expected_category"),
                     F.substring("sku", 1, 4).alias("expected_prefix")))
    out = retrieval_quality(hits, cases)
    return out.select("query_id", "expected_category", "expected_prefix", F.round("precision", 6).alias("precision"),
                      "category_hit", "sku_hit", "retrieved_count", "status",
                      F.round("avg_precision", 6).alias("avg_precision"),
                      F.round("category_accuracy", 6).alias("category_accuracy"), "gates_pass")


@register("vector_upsert", """
WITH ch AS (SELECT vec_id, embedding, category || '-moved' AS category FROM vectors WHERE category = 'c3'),
u AS (SELECT * FROM ch UNION ALL SELECT v.* FROM vectors v WHERE v.vec_id NOT IN (SELECT vec_id FROM ch))
SELECT category, count(*) AS n FROM u GROUP BY category""")
def q_vector_upsert(spark, d):
    """Keyed upsert of re-labelled vectors into the collection."""
    v = RetailModel(spark, d).vectors
    ch = v.filter(F.col("category") == "c3").withColumn("category", F.concat("category", F.lit("-moved")))
    return V.vector_upsert(v, ch).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def _product_doc(p):
    return product_text_pipeline("name", "category", F.split_part("name", F.lit(" "), F.lit(2)), "brand",
                                 "price", "description", "tags", "is_organic", "is_store_brand")


_PRODUCT_DOCS = f"docs AS (SELECT product_id AS id, {PRODUCT_TEXT_SQL} AS text FROM products)"


@register("index_products", f"""WITH {_PRODUCT_DOCS},
{embedding_ctes("docs", "e")}
SELECT id AS vec_id, category, sku, {micro()} AS embedding FROM e JOIN products ON product_id = id""")
def q_index_products(spark, d):
    """H4 / H1: product text -> hashed embedding -> collection rows (vectors as text)."""
    p = RetailModel(spark, d).products
    docs = p.select(F.col("product_id").alias("vec_id"), "category", "sku", _product_doc(p).alias("text"))
    return V.embed_texts(docs, "text").select("vec_id", "category", "sku", micro_text("embedding"))


@register("index_incremental", f"""WITH {_PRODUCT_DOCS},
{embedding_ctes("docs", "e")}
SELECT id AS vec_id, category, {micro()} AS embedding FROM e JOIN products ON product_id = id
WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 2)""")
def q_index_incremental(spark, d):
    """H5: product change messages applied to the product collection (vectors as text)."""
    m = RetailModel(spark, d)
    p = m.products
    coll = p.select(F.col("product_id").alias("vec_id"), "category",
                    V.hashed_embedding(_product_doc(p)).alias("embedding"))
    part = m.table("part")
    changes = part.select(F.col("p_partkey").alias("product_id"),
                          F.when(F.col("p_size") <= 2, "delete").when(F.col("p_size") <= 6, "update")
                          .otherwise("keep").alias("action"),
                          F.col("p_size").alias("msg_seq")).filter(F.col("action") != "keep")
    return V.index_incremental(coll, changes, p, text=_product_doc).withColumn("embedding", micro_text("embedding"))


@register("bucket_store_upsert", """
SELECT vec_id, category, CASE WHEN vec_id % 10 = 1 THEN 'changed' ELSE 'stored' END AS state FROM vectors WHERE vec_id % 10 <> 2
UNION ALL SELECT vec_id + 10000000, category, 'new' FROM vectors WHERE vec_id % 100 = 3""")
def q_bucket_store_upsert(spark, d):
    """A7 on a bucketed store: a whole collection is stored, then updates, deletes and new ids are applied to it."""
    v = RetailModel(spark, d).vectors.select("vec_id", "category")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bucket-store-{uuid.uuid4().hex}"
    B.create_store(v.withColumn("state", F.lit("stored")), path, id_col="vec_id", buckets=16)
    changes = (v.filter("vec_id % 10 = 1").select("vec_id", "category", F.lit("changed").alias("state"), F.lit(2).alias("seq"), F.lit(False).alias("gone"))
               .unionByName(v.filter("vec_id % 10 = 1").select("vec_id", "category", F.lit("earlier").alias("state"), F.lit(1).alias("seq"), F.lit(True).alias("gone")))
               .unionByName(v.filter("vec_id % 10 = 2").select("vec_id", "category", F.lit("x").alias("state"), F.lit(1).alias("seq"), F.lit(True).alias("gone")))
               .unionByName(v.filter("vec_id % 100 = 3").select((F.col("vec_id") + 10000000).alias("vec_id"), "category", F.lit("new").alias("state"),
                                                                F.lit(1).alias("seq"), F.lit(False).alias("gone"))))
    B.upsert_store(spark, path, changes, id_col="vec_id", seq_col="seq", delete_col="gone")
    return B.read_store(spark, path).select("vec_id", "category", "state")
