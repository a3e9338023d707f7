"""Structured Streaming jobs (I1-I3, I11, I14, H5 stream forms).

Each job is a function from a streaming DataFrame to a streaming DataFrame
(or a ``foreachBatch`` writer), so callers pick source, trigger and sink.
Event times arrive as TIMESTAMP_NTZ in the driver tables; watermarks need
TIMESTAMP, so they are cast first (session time zone UTC).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CART_TTL_MS = 24 * 3600 * 1000
CHAT_SESSION_GAP = "2 hours"

CART_OUTPUT = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("snapshot_seq", T.LongType()),
    T.StructField("product_id", T.LongType()), T.StructField("quantity", T.LongType()),
    T.StructField("expired", T.BooleanType()), T.StructField("last_write", T.TimestampType()),
])
CART_STATE = T.StructType([T.StructField("items", T.StringType()), T.StructField("last_write_ms", T.LongType()),
                           T.StructField("seq", T.LongType())])


def with_event_time(df: DataFrame, col: str = "event_ts") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def _fold_cart(items: dict[int, int], last_ms: int | None, events: pd.DataFrame) -> tuple[dict[int, int], int | None]:
    """Apply one key's events in (time, id) order; a gap over the TTL empties
    the cart before the event (I2: only writes extend the lifetime)."""
    for ts, op, pid, qty in events[["_ms", "op", "product_id", "quantity"]].itertuples(index=False):
        if last_ms is not None and ts - last_ms > CART_TTL_MS:
            items = {}
        pid = None if pd.isna(pid) else int(pid)
        q = None if pd.isna(qty) else int(qty)
        if op == "add":
            items[pid] = items.get(pid, 0) + q
        elif op == "set":
            if pid in items:
                if q <= 0:
                    del items[pid]
                else:
                    items[pid] = q
        elif op == "remove":
            items.pop(pid, None)
        elif op in ("clear", "checkout"):
            items = {}
        last_ms = int(ts)
    return items, last_ms


def _cart_rows(key: str, items: dict[int, int], seq: int, last_ms: int | None, expired: bool) -> pd.DataFrame:
    lw = pd.to_datetime(last_ms, unit="ms") if last_ms is not None else None
    if not items:
        return pd.DataFrame({"session_id": [key], "snapshot_seq": [seq], "product_id": [None],
                             "quantity": [0], "expired": [expired], "last_write": [lw]})
    pids = sorted(items)
    return pd.DataFrame({"session_id": [key] * len(pids), "snapshot_seq": [seq] * len(pids),
                         "product_id": pids, "quantity": [items[p] for p in pids],
                         "expired": [expired] * len(pids), "last_write": [lw] * len(pids)})


def _cart_update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sid = key[0]
    if state.hasTimedOut:
        items_json, last_ms, seq = state.get
        state.remove()
        yield _cart_rows(sid, {}, seq + 1, last_ms, True)
        return
    if state.exists:
        items_json, last_ms, seq = state.get
        items = {int(k): v for k, v in json.loads(items_json).items()}
    else:
        items, last_ms, seq = {}, None, 0
    batch = pd.concat(list(pdfs), ignore_index=True)
    batch["_ms"] = batch["event_ts"].astype("datetime64[us]").astype("int64") // 1000
    batch = batch.sort_values(["_ms", "event_id"], kind="stable")
    items, last_ms = _fold_cart(items, last_ms, batch)
    seq += 1
    state.update((json.dumps({str(k): v for k, v in items.items()}), last_ms, seq))
    state.setTimeoutTimestamp(last_ms + CART_TTL_MS)
    yield _cart_rows(sid, items, seq, last_ms, False)


def cart_state_stream(events: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """I1 + I2 stream: per session cart state machine with event-time expiry.

    Emits a full cart snapshot per touched session and micro-batch
    (``snapshot_seq`` increases); a cart not written for 24 h of event time
    is dropped once the watermark passes and an ``expired`` row is emitted.
    Events later than ``lateness`` behind the watermark are dropped by Spark
    (the batch twin in :mod:`larder.operators.orders` sees them all)."""
    ev = with_event_time(events).withWatermark("event_ts", lateness)
    return (ev.groupBy("session_id")
            .applyInPandasWithState(_cart_update, CART_OUTPUT, CART_STATE, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def event_windows(events: DataFrame, *, window: str = "1 hour", lateness: str = "10 minutes",
                  key: str = "event_type", ts: str = "ts") -> DataFrame:
    """Tumbling event-time counts and value sums per key with a lateness
    bound (append mode emits each window once, after the watermark passes)."""
    ev = with_event_time(events, ts).withWatermark(ts, lateness)
    return (ev.groupBy(F.window(ts, window).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key,
                    "events", "value_sum"))


def chat_sessions_stream(turns: DataFrame, *, gap: str = CHAT_SESSION_GAP, lateness: str = "10 minutes") -> DataFrame:
    """I3 stream: chat sessions as session windows (a message more than the
    gap after the previous one opens a new session)."""
    t = turns.withWatermark("ts", lateness)
    return (t.groupBy(F.session_window("ts", gap).alias("s"), "conv_id")
            .agg(F.count(F.lit(1)).alias("messages"))
            .select("conv_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "messages"))


def order_notifications(messages: DataFrame, *, lateness: str = "1 hour", message_id: str = "MessageId") -> DataFrame:
    """Order status messages -> one notification row per message. Redeliveries
    (equal message id inside the lateness bound) are dropped; a status that an
    order takes again is a message of its own. Rows without an id all stay."""
    m = messages.withWatermark("received_at", lateness).withColumn(
        "_id", F.coalesce(message_id, F.expr("uuid()"))).dropDuplicatesWithinWatermark(["_id"])
    return m.select("OrderId", "UserId", "NewStatus", "received_at",
                    F.concat(F.lit("Your order is now "), F.col("NewStatus"), F.lit(".")).alias("notification"))


def latest_collection(spark, collection_path: str) -> DataFrame | None:
    """Newest version of a versioned collection folder (``v=<n>`` partitions)."""
    from pyspark.errors import AnalysisException
    try:
        df = spark.read.parquet(collection_path)
    except AnalysisException:
        return None
    newest = df.agg(F.max("v")).first()[0]
    return df.filter(F.col("v") == newest).drop("v")


def index_updates_writer(collection_path: str, products: DataFrame, text):
    """H5 stream sink: ``foreachBatch`` function applying each micro-batch of
    product messages to the vector collection. Each batch writes a new
    version folder named by its batch id (re-running a batch rewrites the
    same folder, so the sink is idempotent); readers take the newest one."""
    from larder.operators.vectors import index_incremental

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = latest_collection(spark, collection_path)
        if current is None:
            current = spark.createDataFrame([], "vec_id bigint, category string, embedding array<double>")
        if "msg_seq" not in batch.columns:  # arrival order inside the micro-batch
            batch = batch.withColumn("msg_seq", F.monotonically_increasing_id())
        changes = batch.select(F.col("ProductId").cast("bigint").alias("product_id"),
                               F.lower("Action").alias("action"), F.col("msg_seq"))
        out = index_incremental(current, changes, products, text=text)
        out.write.mode("overwrite").parquet(f"{collection_path}/v={batch_id + 1}")
    return write


def bucket_index_writer(path: str, products: DataFrame, text):
    """H5 stream sink on a bucketed store (:mod:`larder.operators.bucket_store`, id ``vec_id``): a
    micro-batch of product messages rewrites the buckets of its products, not the collection.
    The last message of a product wins, by ``msg_seq`` or, without one, by arrival order; an
    update of a product that is unknown to ``products`` changes nothing."""
    from larder.operators.bucket_store import upsert_store
    from larder.operators.vectors import hashed_embedding

    def write(batch: DataFrame, batch_id: int) -> None:
        if "msg_seq" not in batch.columns:
            batch = batch.withColumn("msg_seq", F.monotonically_increasing_id())
        last = batch.filter(F.lower("Action").isin("create", "update", "delete")).groupBy(F.col("ProductId").cast("bigint").alias("product_id")).agg(
            F.max(F.struct("msg_seq", F.lower("Action").alias("action"))).alias("m")).select("product_id", "m.*")
        fresh = last.filter("action <> 'delete'").select("product_id", "msg_seq").join(products, "product_id")
        ups = fresh.select(F.col("product_id").alias("vec_id"), "category", hashed_embedding(text(fresh)).alias("embedding"),
                           "msg_seq", F.lit(False).alias("_gone"))
        outs = last.filter("action = 'delete'").select(F.col("product_id").alias("vec_id"), "msg_seq", F.lit(True).alias("_gone"))
        upsert_store(batch.sparkSession, path, ups.unionByName(outs, allowMissingColumns=True), id_col="vec_id", seq_col="msg_seq", delete_col="_gone")
    return write


def checkpoint_location(spark, name: str) -> str:
    """Stream checkpoint folder under the cluster's shared checkpoint folder
    (``spark.checkpoint.dir``), so a restarted query resumes its offsets and
    state after executor or driver loss."""
    from larder.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
