"""Chat metrics as a stream against the batch metrics."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.functions import routing as R
from larder.operators import evaluation as E
from larder.operators.vectors import token_buckets
from larder.sources.views import RetailModel
from larder.streaming import metrics as M

SCHEMA = "ts timestamp, text string, latency double"


def run(spark, scratch, requests, files, name):
    src = os.path.join(scratch, name)
    lo, hi = requests.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    part = F.coalesce(F.floor((F.unix_seconds("ts") - lo) * files / (hi - lo + 1)), F.lit(0))
    for i in range(files):
        requests.filter(part == i).orderBy(F.xxhash64("text", "latency")).coalesce(1).write.parquet(f"{src}/{i:02d}")
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    out = os.path.join(scratch, name + "-out")
    (M.chat_metrics_stream(stream, window="1 hour").writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", os.path.join(scratch, name + "-ck")).trigger(availableNow=True).start().awaitTermination(300))
    return M.metric_totals(spark.read.parquet(out))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def batch(requests):
    """The batch metrics over the same requests, each by its own path."""
    r = R.with_scenario(R.with_intent(requests, "text"), "text")
    plan = R.retrieval_plan("intent")
    n = r.select(F.when(F.coalesce("skip_rag", F.lit(False)), F.lit(0))
                 .otherwise(plan["k_products"] + plan["k_deals"] + plan["k_stores"]).alias("n"))
    status = F.when(F.size(token_buckets("text")) > 0, F.lit("ok")).otherwise(F.lit("empty")).alias("status")
    return {"intents": requests.groupBy(R.classify_intent("text").alias("intent")).agg(F.count(F.lit(1)).alias("requests")),
            "latency": E.latency_histogram(requests, value="latency"),
            "retrieved": E.latency_histogram(n, value="n", bounds=M.RETRIEVED_BOUNDS),
            "embed_status": requests.groupBy(status).agg(F.count(F.lit(1)).alias("requests"))}


def with_closer(spark, requests):
    """A request far behind the others, whose window stays open and is not written."""
    end = requests.agg(F.max("ts")).first()[0] + timedelta(hours=3)
    return requests.unionByName(spark.createDataFrame([(end, "closer", 0.1)], SCHEMA))


def test_totals_of_all_windows_equal_the_batch(spark, scratch):
    turns = RetailModel(spark, SF_SMALL).chat_turns.filter(F.col("role") == "user")
    req = turns.select(F.timestamp_seconds("ts_s").alias("ts"), "text",
                       (F.pmod(F.xxhash64("text", "ts_s"), F.lit(4000)) / 100).alias("latency"))
    got, want = run(spark, scratch, with_closer(spark, req), 4, "turns"), batch(req)
    for name in want:
        assert rows(got[name]) == rows(want[name]), name
    assert got["intents"].count() > 1


def test_nulls_bounds_and_empty_texts(spark, scratch):
    t = datetime(2024, 1, 1)
    data = [(t, None, 0.5), (t, "", 1.0), (t, "...", None), (t + timedelta(hours=5), "any deals on milk?", 30.0),
            (t + timedelta(hours=5), "any deals on milk?", 30.1), (t + timedelta(hours=5), "any deals on milk?", 30.1)]
    req = spark.createDataFrame(data, SCHEMA)
    lost = spark.createDataFrame([(None, "no time", 1.0)], SCHEMA)
    got, want = run(spark, scratch, with_closer(spark, req.unionByName(lost)), 2, "edges"), batch(req)
    for name in want:
        assert rows(got[name]) == rows(want[name]), name
    assert dict(rows(got["latency"]))["30.0"] == 3 and dict(rows(got["latency"]))["+Inf"] == 6
    empty = M.metric_totals(M.chat_metrics_stream(spark.createDataFrame([], SCHEMA)))
    assert set(rows(empty["latency"])) == {(str(b), 0) for b in E.LATENCY_BOUNDS} | {("+Inf", 0)}
    assert empty["intents"].count() == 0 and empty["embed_status"].count() == 0
