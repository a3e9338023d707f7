"""Bucketed upserts: rows, rewritten files, repeated batches, the stream sink."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.operators import bucket_store as B
from larder.sources import io
from larder.sources.views import RetailModel
from larder.streaming import jobs as J


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, ns in os.walk(path) for n in ns if n.endswith(".parquet")}


def rows(spark, path):
    return sorted(map(tuple, B.read_store(spark, path).select("id", "v").collect()))


def test_upsert_rewrites_only_touched_buckets(spark, scratch):
    path = os.path.join(scratch, "store")
    B.create_store(spark.range(400).select("id", F.lit("a").alias("v")), path, id_col="id", buckets=32)
    before = files(path)
    schema = "id long, v string, seq int, gone boolean, other int"
    ch = spark.createDataFrame([(5, "old", 1, False, 0), (5, "new", 2, None, 0), (7, None, 1, True, 0), (9000, "born", 1, False, 0),
                                (8, "back", 2, False, 0), (8, None, 1, True, 0), (None, "no id", 9, False, 0)], schema)
    touched = B.upsert_store(spark, path, ch, id_col="id", seq_col="seq", delete_col="gone")
    want = sorted([(i, {5: "new", 8: "back"}.get(i, "a")) for i in range(400) if i != 7] + [(9000, "born")])
    assert rows(spark, path) == want and 1 <= len(touched) <= 4
    after = files(path)
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert {int(f.split("bucket_of_32=")[1].split("/")[0]) for f in changed} == set(touched)
    assert len(before.keys() & after.keys()) == 32 - len(touched)
    assert B.upsert_store(spark, path, ch, id_col="id", seq_col="seq", delete_col="gone") == touched
    assert rows(spark, path) == want
    some = B.read_store(spark, path, ids=spark.createDataFrame([(5,), (7,), (None,)], "id long"), id_col="id")
    assert [tuple(r) for r in some.select("id", "v").collect()] == [(5, "new")]
    assert B.upsert_store(spark, path, ch.filter("false"), id_col="id", seq_col="seq") == []


def test_a_bucket_may_lose_all_rows(spark, scratch):
    path = os.path.join(scratch, "store")
    B.create_store(spark.range(3).select("id", F.lit("a").alias("v")), path, id_col="id", buckets=1)
    gone = spark.range(3).select("id", F.lit(1).alias("seq"), F.lit(True).alias("gone"))
    B.upsert_store(spark, path, gone, id_col="id", seq_col="seq", delete_col="gone")
    assert rows(spark, path) == []


def test_stream_sink_on_a_bucketed_store(spark, scratch):
    from larder.functions.text import product_text_pipeline
    m = RetailModel(spark, SF_SMALL)
    path, store = os.path.join(scratch, "q"), os.path.join(scratch, "store")
    os.makedirs(path)
    with open(os.path.join(path, "m.json"), "w") as f:
        for pid, act in [(1, "Create"), (2, "Update"), (3, "Delete"), (2, "Delete"), (10 ** 9, "Update")]:
            f.write(json.dumps({"ProductId": str(pid), "Action": act}) + "\n")
    text = lambda df: product_text_pipeline("name", "category", F.lit(""), "brand", "price", "description", "tags", "is_organic", "is_store_brand")
    start = m.vectors.select("vec_id", "category", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id between 2 and 60")
    B.create_store(start, store, id_col="vec_id", buckets=8)
    q = io.queue_source(spark, path, io.PRODUCT_MESSAGE_SCHEMA).writeStream.foreachBatch(J.bucket_index_writer(store, m.products, text))
    q.option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start().awaitTermination(300)
    ids = sorted(r.vec_id for r in B.read_store(spark, store).collect())
    assert ids == [1, *range(4, 61)]
