"""Sources and sinks: table write with format fallback, JSON catalogue load,
vector collection write and keyed upsert, queue parsing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from larder.operators import vectors as V
from larder.sources import io


def test_table_write_falls_back_only_for_missing_source(spark, scratch):
    df = spark.range(5)
    assert io.table_write(df, f"{scratch}/t1", fmt="delta") == "parquet"
    assert spark.read.parquet(f"{scratch}/t1").count() == 5
    with pytest.raises(Exception):
        io.table_write(df, f"{scratch}/t1", fmt="parquet", mode="error")  # other errors propagate


def test_json_catalog_load(spark, scratch):
    recs = [{"name": "Organic Fuji Apple", "sku": "FRE-0001", "price": 1.99, "category": "Fresh",
             "category_slug": "fresh", "is_organic": True},
            {"name": "Spring Water", "sku": "BEV-0001", "price": 4.99, "category": "Beverages",
             "category_slug": "beverages", "is_organic": False}]
    with open(f"{scratch}/products.json", "w") as f:
        json.dump(recs, f)
    df = io.json_catalog_load(spark, f"{scratch}/products.json", io.PRODUCT_JSON_SCHEMA, multiline=True)
    assert df.count() == 2 and df.filter("is_organic").first().sku == "FRE-0001"
    assert df.schema == io.PRODUCT_JSON_SCHEMA


def test_vector_collection_write_and_upsert(spark, scratch):
    coll = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")],
                                 "vec_id long, embedding array<double>, category string")
    V.vector_collection_write(coll, f"{scratch}/c", partition_by="category")
    assert {"category=a", "category=b"} <= set(os.listdir(f"{scratch}/c"))
    ch = spark.createDataFrame([(2, [0.5, 0.5], "a"), (3, [1.0, 1.0], "b")],
                               "vec_id long, embedding array<double>, category string")
    up = {r.vec_id: r.category for r in V.vector_upsert(coll, ch).collect()}
    assert up == {1: "a", 2: "a", 3: "b"}


def test_foreach_batch_sink_batches(spark, scratch):
    out = f"{scratch}/sent"
    os.makedirs(out)

    def send(rows):
        with open(os.path.join(out, f"{os.getpid()}-{rows[0]['id']}.json"), "w") as f:
            json.dump([r["id"] for r in rows], f)
    V.foreach_batch_sink(spark.range(250).repartition(2), send, batch=100)
    sent = []
    for name in os.listdir(out):
        with open(os.path.join(out, name)) as f:
            b = json.load(f)
            assert len(b) <= 100
            sent.extend(b)
    assert sorted(sent) == list(range(250))
