"""The list-state history stream against the batch forms, on shuffled late input."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.operators import sessions as S
from larder.sources.views import RetailModel
from larder.streaming import carts, history

SCHEMA = "conv_id long, turn int, ts timestamp, role string, content string"


@pytest.fixture()
def map_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, carts.STATE_PROVIDER)
    yield
    spark.conf.set(key, before)


def run_stream(spark, scratch, rows, files, name):
    src = os.path.join(scratch, name)
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3000))  # up to 50 minutes late
    rows = rows.withColumn("_at", F.coalesce(F.ntile(files).over(Window.orderBy(arrival)), F.lit(1))).cache()
    for i in range(1, files + 1):
        rows.filter(F.col("_at") == i).drop("_at").orderBy(F.xxhash64("turn", F.lit(7))).coalesce(1).write.parquet(f"{src}/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = (history.chat_history_stream(stream).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, name + "-ck")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    return spark.table(name).collect()


def expected(spark, rows):
    """(conv, turn) -> (opened, stored, turns and contents of the prompt) by the batch sessions and their last messages."""
    t = rows.filter("conv_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts_s", F.unix_seconds("ts"))
    by = {}
    for r in sorted(S.chat_session_state(t).collect(), key=lambda r: (r.conv_id, r.ts_s, r.turn)):
        by.setdefault((r.conv_id, r.session_no), []).append((r.turn, r.content))
    out = {}
    for (conv, _), ms in by.items():
        for i, (turn, _) in enumerate(ms):
            out[conv, turn] = (i == 0, min(i + 1, S.HISTORY_KEEP), ms[max(0, i + 1 - S.HISTORY_TO_PROMPT):i + 1])
    return out


def test_history_stream_equals_batch(spark, scratch, map_state):
    t0 = datetime(2024, 1, 1)
    rows = [(9001, i, t0 + timedelta(minutes=5 * i), "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(40)]
    rows += [(9002, 0, t0, "user", "a"), (9002, 1, t0 + timedelta(seconds=7200), "user", "b"), (9002, 2, t0 + timedelta(seconds=14401), "user", None),
             (9003, 0, t0, None, "same time"), (9003, 1, t0, "user", "tie"), (None, 0, t0, "user", "no conversation"), (9004, 0, None, "user", "no time")]
    model = RetailModel(spark, SF_SMALL).chat_turns.filter("conv_id < 25").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), F.timestamp_seconds("ts_s").alias("ts"), "role", F.col("text").alias("content"))
    every = spark.createDataFrame(rows, SCHEMA).unionByName(model)
    want = expected(spark, every)
    end = every.agg(F.max("ts")).first()[0]
    closer = spark.createDataFrame([(-1, 0, end + timedelta(hours=9), "user", "x")], SCHEMA)  # moves the watermark behind the last message
    got = run_stream(spark, scratch, every.unionByName(closer), 6, "history")
    assert {(r.conv_id, r.turn): (r.opened, r.stored, [(m.turn, m.content) for m in r.history]) for r in got} == want
    assert len(got) == len(want)
    # the newest prompt of a conversation in one session is its last n of the batch form
    last = {r.turn for r in S.history_last_n(spark.createDataFrame(rows, SCHEMA).filter("conv_id = 9001")).collect()}
    assert last == {m.turn for r in got if r.conv_id == 9001 and r.turn == 39 for m in r.history}
