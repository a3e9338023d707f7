"""Streaming jobs against their batch twins (availableNow triggers, memory sinks)."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.operators import orders as O
from larder.sources import io
from larder.sources.views import RetailModel
from larder.streaming import jobs as J


def _split_by_time(spark, df, path, ts="event_ts", parts=4):
    """Write a table as several time-ordered parquet files (one per quantile)."""
    b = df.withColumn("_part", F.ntile(parts).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(ts, "event_id")))
    for i in range(1, parts + 1):
        b.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("overwrite").parquet(f"{path}/part{i}")
    return [f"{path}/part{i}" for i in range(1, parts + 1)]


def _run(q_df, name, mode="append"):
    q = (q_df.writeStream.format("memory").queryName(name).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return q


def test_cart_stream_matches_batch_twin(spark, scratch):
    ev = RetailModel(spark, SF_SMALL).cart_events
    files = _split_by_time(spark, ev, f"{scratch}/in")
    src = os.path.join(scratch, "stream")
    os.makedirs(src)
    for i, f in enumerate(files):  # drop files into the stream folder in time order
        os.rename(f, os.path.join(src, f"p{i}"))
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    _run(J.cart_state_stream(stream), "cart_snapshots")
    rows = spark.table("cart_snapshots").collect()
    last = {}
    for r in rows:
        last[r.session_id] = max(last.get(r.session_id, 0), r.snapshot_seq)
    final = [r for r in rows if r.snapshot_seq == last[r.session_id]]
    expired = {r.session_id for r in final if r.expired}
    got = {(r.session_id, r.product_id, r.quantity) for r in final
           if r.product_id is not None and r.session_id not in expired}
    batch = O.cart_state(O.expiry_resets(ev, ttl_seconds=24 * 3600))
    want = {(r.session_id, r.product_id, r.quantity) for r in batch.collect() if r.session_id not in expired}
    assert got == want
    assert len(want) > 0


def test_event_windows_and_late_data(spark, scratch):
    ev = RetailModel(spark, SF_SMALL).table("events")
    files = _split_by_time(spark, ev.withColumnRenamed("ts", "event_ts"), f"{scratch}/in", parts=3)
    src = os.path.join(scratch, "stream")
    os.makedirs(src)
    for i, f in enumerate(files):
        os.rename(f, os.path.join(src, f"p{i}"))
    schema = ev.withColumnRenamed("ts", "event_ts").schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    _run(J.event_windows(stream, ts="event_ts"), "ev_windows")
    got = spark.table("ev_windows")
    # windows are emitted once the watermark has passed them: every emitted
    # window must equal the batch count of that window
    batch = (ev.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type")
             .agg(F.count(F.lit(1)).alias("events"))
             .select(F.col("w.start").alias("window_start"), "event_type", "events"))
    diff = got.select("window_start", "event_type", "events").exceptAll(batch)
    assert got.count() > 0
    assert diff.count() == 0


def test_order_notifications_dedupe(spark, scratch):
    path = os.path.join(scratch, "orders_q")
    os.makedirs(path)
    msgs = [{"OrderId": "o1", "NewStatus": "Confirmed", "UserId": "u1", "MessageId": "a"},
            {"OrderId": "o1", "NewStatus": "Confirmed", "UserId": "u1", "MessageId": "a"},   # redelivery
            {"OrderId": "o1", "NewStatus": "Delivering", "UserId": "u1", "MessageId": "b"},
            {"OrderId": "o1", "NewStatus": "Confirmed", "UserId": "u1", "MessageId": "c"},   # taken again
            {"OrderId": None, "NewStatus": "Delivered", "UserId": "u2", "MessageId": "d"}]   # null payload key
    with open(os.path.join(path, "m1.json"), "w") as f:
        for m in msgs:
            f.write(json.dumps(m) + "\n")
        f.write("not json\n")
    q = io.queue_source(spark, path, io.ORDER_MESSAGE_SCHEMA).withColumn("received_at", F.current_timestamp())
    _run(J.order_notifications(q), "notes")
    rows = sorted((r.OrderId, r.NewStatus) for r in spark.table("notes").collect())
    assert rows == [("o1", "Confirmed"), ("o1", "Confirmed"), ("o1", "Delivering")]
    _run(io.queue_source(spark, path, io.ORDER_MESSAGE_SCHEMA, rejects=True), "rejected")
    assert spark.table("rejected").count() == 2  # the null order and the line that is no JSON


def test_chat_sessions_stream(spark, scratch):
    t = RetailModel(spark, SF_SMALL).chat_turns.withColumn("ts", F.timestamp_seconds("ts_s"))
    t.write.parquet(f"{scratch}/turns")
    stream = spark.readStream.schema(t.schema).parquet(f"{scratch}/turns")
    _run(J.chat_sessions_stream(stream), "chat_sessions")
    got = spark.table("chat_sessions")
    from larder.operators.sessions import chat_session_state
    batch = chat_session_state(RetailModel(spark, SF_SMALL).chat_turns)
    # sessions closed before the final watermark are emitted; all must match the batch twin
    want = batch.groupBy("conv_id", "session_no").agg(F.count(F.lit(1)).alias("messages"),
                                                     F.min("ts_s").alias("start"))
    g = {(r.conv_id, int(r.session_start.timestamp()), r.messages) for r in got.collect()}
    w = {(r.conv_id, r.start, r.messages) for r in want.collect()}
    assert g and g <= w


def test_index_updates_foreach_batch(spark, scratch):
    from larder.functions.text import product_text_pipeline
    m = RetailModel(spark, SF_SMALL)
    path = os.path.join(scratch, "qmsgs")
    os.makedirs(path)
    with open(os.path.join(path, "m.json"), "w") as f:
        for i, (pid, act) in enumerate([(1, "Create"), (2, "Update"), (3, "Delete"), (2, "Delete")]):
            f.write(json.dumps({"ProductId": str(pid), "Action": act}) + "\n")
    q = io.queue_source(spark, path, io.PRODUCT_MESSAGE_SCHEMA)

    def text(df):
        return product_text_pipeline("name", "category", F.lit(""), "brand", "price", "description", "tags",
                                     "is_organic", "is_store_brand")
    coll = os.path.join(scratch, "collection")
    w = J.index_updates_writer(coll, m.products, text)
    s = q.writeStream.foreachBatch(w).trigger(availableNow=True).start()
    s.awaitTermination(300)
    out = J.latest_collection(spark, coll)
    ids = sorted(r.vec_id for r in out.collect())
    assert ids == [1]


def test_late_events_dropped_in_stream_only(spark, scratch):
    """Events behind the watermark are dropped by the stream (append mode), the
    batch twin counts them: the difference is exactly the late rows. Each file
    arrives in its own availableNow run on the same checkpoint, so the
    watermark of one trigger applies to the next."""
    from datetime import datetime, timedelta
    schema = "event_id long, event_ts timestamp, event_type string, value double"
    t0 = datetime(2024, 1, 1, 12, 0)
    on_time = [(i, t0 + timedelta(minutes=10 * i), "click", 1.0) for i in range(12)]      # 12:00 .. 13:50
    late = [(100, t0 + timedelta(minutes=5), "click", 1.0)]                             # 12:05, arrives later
    closer = [(200, t0 + timedelta(hours=5), "click", 1.0)]                            # moves the watermark on
    src, out, ck = (os.path.join(scratch, x) for x in ("stream", "out", "ck"))
    for i, batch in enumerate([on_time, late, closer]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        q = (J.event_windows(stream, ts="event_ts", window="1 hour", lateness="10 minutes")
             .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(300)
    got = {r.window_start: r.events for r in spark.read.parquet(out).collect()}
    assert got[t0] == 6                      # the 12:05 event came after the watermark passed 13:00
    batch = spark.createDataFrame(on_time + late + closer, schema)
    want = batch.filter((F.col("event_ts") >= t0) & (F.col("event_ts") < t0 + timedelta(hours=1))).count()
    assert want == 7
