"""The retail views reproduce the fixture facts documented for sf0.01."""

from pyspark.sql import functions as F

from conftest import SF_CHECK
from larder.session import AS_OF
from larder.sources.views import RetailModel, oracle_with_views


def test_deal_and_cart_view_counts(spark):
    m = RetailModel(spark, SF_CHECK)
    d = m.deals
    assert d.count() == 268
    live = F.col("is_active") & (F.col("end_date") > F.lit(AS_OF))
    assert d.filter(live).count() == 185
    assert d.filter(F.col("is_active") & ~(F.col("end_date") > F.lit(AS_OF))).count() == 62
    assert d.filter(~F.col("is_active")).count() == 21
    ops = {r.op: r["count"] for r in m.cart_events.groupBy("op").count().collect()}
    assert ops == {"add": 3988, "set": 2017, "remove": 2014, "checkout": 1981}
    assert [r.category for r in m.categories.filter(~F.col("is_active")).collect()] == ["SMALL"]


def test_oracle_view_prefix():
    sql = oracle_with_views("WITH x AS (SELECT * FROM products) SELECT count(*) FROM x")
    assert sql.startswith("WITH products AS (") and "x AS (SELECT * FROM products)" in sql
    rec = oracle_with_views("WITH RECURSIVE r(n) AS (SELECT 1) SELECT * FROM r, deals")
    assert rec.startswith("WITH RECURSIVE deals AS (")
