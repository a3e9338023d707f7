"""Trigram index, store cells and pruned vector search against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.operators import catalog as C
from larder.operators import text_index as X
from larder.sources.views import RetailModel

ROWS = [(1, "Blue Widget", "a blue WIDGET by X", None, "red,blue"), (2, "ab", None, "Ab", ""), (3, "100% a_b", "50%_off\\now", "B&B", None),
        (4, "Straße ÉCLAIR", "naïve 日本語テキスト", "É", "日本"), (5, "aaaa", "aaa aaaa", "AAA", "a,a"), (5, "aaaa", "other", "AAA", "a,a"),
        (None, "blue without id", "blue", None, None), (6, None, None, None, None), (7, "x" * 5000 + "blue" + "y" * 5000, "", "", "")]
SCHEMA = "product_id long, name string, description string, brand string, tags string, is_available boolean, key long, n long, gram string, field string, folder int"


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    df = spark.createDataFrame([(*r, True, 1, 2, "g", "f", 3) for r in ROWS], SCHEMA).repartition(3).cache()
    path = str(tmp_path_factory.mktemp("index") / "trigrams")
    C.index_products_text(df, path)
    return df, path


def test_search_through_the_index_finds_the_same_rows(shop):
    df, path = shop
    known = df.filter("product_id IS NOT NULL").coalesce(1)  # a row without an id can't be looked up
    rows = lambda d: sorted(map(str, d.select("product_id", "name", "description").collect()))
    for term in ("BLUE W", "ab", "aaaa", "éclair", "xxblueyy"):
        assert rows(C.product_search(known, term=term, index=path)) == rows(C.product_search(known, term=term))
    cats = df.sparkSession.createDataFrame([("c", "c", 1, True)], "category string, slug string, display_order int, is_active boolean")
    with_cat = known.withColumn("category", F.lit("c"))
    for pattern in ("blue%by", "\\%_off", "a_a"):
        assert rows(C.product_search_ranked(with_cat, cats, term=pattern, index=path)) == rows(C.product_search_ranked(with_cat, cats, term=pattern))


def test_literals_of_like_patterns():
    assert X.literals("a%b_c", like=True) == ["a", "b", "c"]
    assert X.literals("a\\%b\\_c%", like=True) == ["a%b_c"]
    assert X.literals("%_", like=True) == [] and X.literals("a%b", like=False) == ["a%b"]


def test_index_search_reads_only_its_folders_and_verifies_only_candidates(spark, tmp_path):
    prod = RetailModel(spark, SF_SMALL).products
    path = str(tmp_path / "trigrams")
    C.index_products_text(prod, path)
    found = X.candidates(spark, path, term="brand#13", fields=["brand"])
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [folder" in plan and "In(gram" in plan
    brands = prod.filter(F.lower("brand").contains("brand#13")).count()
    assert brands == found.count() < prod.count() / 5
    assert C.product_search(prod, term="brand#13", index=path).count() == C.product_search(prod, term="brand#13").count() > 0


def brute_stores(pts, st, k):
    return {(p, r): (s, d) for p, a, b in pts if a is not None and b is not None for r, (d, s) in enumerate(sorted(
        (abs(round(a * 1e7) - round(x * 1e7)) + abs(round(b * 1e7) - round(y * 1e7)), i) for i, x, y, o in st if o and x is not None)[:k], 1)}


@pytest.mark.parametrize("levels,k", [(16, 4), (3, 1)])
def test_store_cells_equal_brute_force(spark, monkeypatch, levels, k):
    monkeypatch.setattr(C, "LEVELS", levels)
    rng = np.random.default_rng(levels)
    st = [(int(i), round(float(a), 1), round(float(b), 1), bool(i % 5)) for i, (a, b) in enumerate(rng.uniform(-3, 3, (150, 2)))]
    st += [(1000 + i, 1.5, 1.5, True) for i in range(60)] + [(2000 + i, 1.5 + i * 1e-7, 1.5, True) for i in range(30)]  # one place, one street
    st += [(3000, 170.0, -80.0, True), (3001, None, 1.0, True)]
    pts = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-4, 4, (40, 2)))]
    pts += [(100, 1.5, 1.5), (101, 179.9, 89.9), (102, -179.9, -89.9), (103, None, 0.0), (104, 0.0, 0.0)]
    stores = spark.createDataFrame(st, "store_id long, latitude double, longitude double, is_open boolean")
    points = spark.createDataFrame(pts, "point_id long, lat double, lng double")
    got = {(r.point_id, r["rank"]): (r.store_id, r.distance_e7) for r in C.nearest_stores_cells(points, stores, k=k).collect()}
    assert got == brute_stores(pts, st, k)


def test_store_cells_with_few_or_no_stores(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0)], "point_id long, lat double, lng double")
    one = spark.createDataFrame([(7, 5.0, 5.0, True), (8, 5.0, 5.0, False)], "store_id long, latitude double, longitude double, is_open boolean")
    got = sorted(map(tuple, C.nearest_stores_cells(points, one, k=3).collect()))
    assert got == [(1, 7, 100_000_000, 1), (2, 7, 100_000_000, 1)]
    assert C.nearest_stores_cells(points, one.filter("false"), k=3).count() == 0
    assert C.nearest_stores_cells(points.filter("false"), one, k=3).count() == 0


def test_pruned_top_k_equals_the_plain_form_and_scores_little(spark, tmp_path):
    from larder.operators import vectors as V
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + 0.02 * rng.normal(size=12)).tolist(), f"c{i % 3}") for i in range(2000)]
    rows += [(5000 + i, [0.0] * 12, "c0") for i in range(3)] + [(6000 + i, rows[0][1], "c1") for i in range(6)]  # zero vectors, ties
    coll = spark.createDataFrame(rows, "vec_id long, embedding array<double>, category string").repartition(4)
    asked = [(i, (centres[i] + 0.02 * rng.normal(size=12)).tolist(), None if i % 2 else f"c{i % 4}") for i in range(12)]
    asked += [(90, rows[0][1], "c1"), (91, rows[0][1], None), (92, [0.0] * 12, None)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, f string")
    path = str(tmp_path / "clusters")
    clusters = V.pivot_clusters(coll, path, pivots=120)
    stored = spark.read.parquet(path)
    assert stored.count() == len(rows)
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())
    for filters in ({}, {"filter_col": "category", "query_filter_col": "f"}):
        got = V.vector_top_k_pruned(queries, stored, clusters, k=7, block_rows=5, chunk_rows=30, **filters).cache()
        assert key(got) == key(V.vector_top_k(queries, coll, k=7, **filters))
        share = {r.query_id: r.scored / len(rows) for r in got.select("query_id", "scored").distinct().collect()}
        near = [share[q] for q, _, f in asked if q < 90 and (f is None or not filters)]
        assert sum(near) / len(near) < 0.3


def test_assignment_by_shares_is_exact_to_the_row(spark):
    from datetime import datetime, timezone
    from larder.operators import deals as D
    now = datetime(2001, 8, 2, tzinfo=timezone.utc)
    prod = lambda n: spark.range(n).select(F.col("id").alias("product_id"), F.lit("s").alias("sku"), F.lit("n").alias("name"))
    n = 500_000
    got = D.deal_assignment_shares(prod(n), as_of=now, seed=5, shares=(606, 455, 45))
    rows = {r.deal_type: (r.n, r.ids) for r in got.groupBy("deal_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("product_id").alias("ids")).collect()}
    assert rows == {t: (n * x // 10_000,) * 2 for t, x in (("BOGO", 606), ("WeeklyDeal", 455), ("DailyDeal", 45))}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange SinglePartition" not in plan
    # the same products as the ranked form
    few = D.deal_assignment_shares(prod(1000), as_of=now, seed=5, shares=(1000, 505, 9))
    ranked = D.deal_assignment(prod(1000), as_of=now, seed=5, counts=(100, 50, 0))
    key = lambda df: sorted((r.product_id, r.deal_type, r.title, r.end_date) for r in df.collect())
    assert key(few) == key(ranked)
    assert D.deal_assignment_shares(prod(0), as_of=now, seed=5).count() == 0
    assert D.deal_assignment_shares(prod(10), as_of=now, seed=5).count() == 0
    assert D.deal_assignment_shares(prod(10), as_of=now, seed=5, shares=(10_000, 0, 0)).count() == 10
