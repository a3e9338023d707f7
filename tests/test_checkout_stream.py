"""Checkouts as a stream against the batch form, on shuffled late input."""

import os
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.operators import orders as O
from larder.sources.views import RetailModel
from larder.streaming import carts as C
from larder.streaming import checkouts as K

SCHEMA = "event_id long, session_id string, event_ts timestamp, op string, product_id long, quantity int"


@pytest.fixture()
def map_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, C.STATE_PROVIDER)
    yield
    spark.conf.set(key, before)


def write_files(events, src, files):
    """Events in files of neighbouring arrival times, up to 50 minutes late, each shuffled."""
    late = F.unix_seconds("event_ts") + F.pmod(F.xxhash64("event_id"), F.lit(3000))
    lo, hi = events.agg(F.min(late), F.max(late)).first()
    at = F.coalesce(F.floor((late - F.lit(lo)) * files / F.lit(hi - lo + 1)), F.lit(0))
    for i in range(files):
        events.filter(at == i).orderBy(F.xxhash64("event_id", F.lit(1))).coalesce(1).write.parquet(f"{src}/{i:03d}")


def run(spark, scratch, events, prod, files, owners=None):
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    write_files(events, src, files)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    tagged = K.checkout_stream(stream, prod)
    q = (tagged.writeStream.foreachBatch(K.checkout_writer(out)).outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    return K.read_checkouts(spark, out, tagged.schema, owners=owners), out, tagged.schema


def rows(df, *drop):
    """Rows as text in a set with counts; times without a zone."""
    cols = sorted(c for c in df.columns if c not in drop)
    cast = [F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if "timestamp" in t else
            F.col(c).cast("decimal(18,2)").cast("string").alias(c) if t.startswith("decimal") else F.col(c).cast("string").alias(c)
            for c, t in df.dtypes if c in cols]
    return sorted(tuple(str(x) for x in r) for r in df.select(*cast).select(*cols).collect())


def closer(spark, ev):
    """An event that moves the watermark behind the last one."""
    end = ev.agg(F.max("event_ts")).first()[0]
    return spark.createDataFrame([(10 ** 9, "closer", end + timedelta(minutes=63), "add", 1, 1)], SCHEMA)


def test_stream_equals_batch_on_the_tables(spark, scratch, map_state):
    m = RetailModel(spark, SF_SMALL)
    ev = m.cart_events.filter(F.crc32("session_id") % 6 == 0).select(
        "event_id", "session_id", F.col("event_ts").cast("timestamp").alias("event_ts"), "op", "product_id", F.col("quantity").cast("int").alias("quantity"))
    owners = m.users.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), "user_id",
                            F.col("preferred_store_id").alias("store_id"))
    (orders, items, rejects), _, _ = run(spark, scratch, ev.unionByName(closer(spark, ev)), m.products, 5, owners)
    want = O.create_order(ev, m.products, owners=owners)
    assert rows(orders) == rows(want[0]) and orders.count() > 0
    assert rows(items) == rows(want[1]) and items.count() > 0
    assert rows(rejects) == rows(want[2], "epoch") and rejects.count() > 0


def hand_made(spark):
    t = datetime(2024, 1, 1)
    s = lambda sec: t + timedelta(seconds=sec)
    ev = [  # several checkouts in one minute; events of one time are ordered by id
        (1, "a", s(1), "add", 1, 2), (2, "a", s(1), "checkout", None, None), (3, "a", s(1), "add", 1, 5), (4, "a", s(2), "add", 2, 1),
        (5, "a", s(3), "checkout", None, None), (6, "a", s(4), "checkout", None, None),
        # set, remove and clear; a set of an absent product; a set without a quantity
        (10, "b", s(10), "add", 1, 1), (11, "b", s(70), "set", 1, 4), (12, "b", s(71), "set", 2, 9), (13, "b", s(80), "add", 2, 1),
        (14, "b", s(81), "remove", 2, None), (15, "b", s(82), "set", 1, None), (16, "b", s(200), "checkout", None, None),
        (17, "b", s(210), "add", 2, 3), (18, "b", s(220), "clear", None, None), (19, "b", s(230), "checkout", None, None),
        # only unknown products; a product without a price beside one with
        (20, "c", s(5), "add", 99, 1), (21, "c", s(6), "checkout", None, None), (22, "c", s(7), "add", 3, 2), (23, "c", s(8), "add", 1, 1),
        (24, "c", s(9), "checkout", None, None),
        # a gap over the TTL empties the cart; one of exactly the TTL does not
        (30, "d", s(0), "add", 1, 1), (31, "d", s(86401), "checkout", None, None), (32, "e", s(0), "add", 1, 1), (33, "e", s(86400), "checkout", None, None),
        # a write just before the TTL runs out keeps the cart, an event without effect too
        (40, "f", s(0), "add", 1, 1), (41, "f", s(86390), "look", None, None), (42, "f", s(2 * 86390), "checkout", None, None),
        # no session
        (50, None, s(3), "add", 1, 1), (51, None, s(4), "checkout", None, None)]
    prod = spark.createDataFrame([(1, "milk", Decimal("2.99"), "A-1"), (2, "tea", Decimal("40.00"), "A-2"), (3, "gift", None, "A-3")],
                                 "product_id long, name string, price decimal(10,2), sku string")
    return spark.createDataFrame(ev, SCHEMA), prod


def test_hand_made_sessions_equal_the_batch(spark, scratch, map_state):
    ev, prod = hand_made(spark)
    (orders, items, rejects), _, _ = run(spark, scratch, ev.unionByName(closer(spark, ev)), prod, 4)
    want = O.create_order(ev, prod)
    assert rows(orders) == rows(want[0]) and rows(items) == rows(want[1])
    assert rows(rejects) == rows(want[2], "epoch")
    assert {r.order_id for r in orders.collect()} == {2, 5, 16, 24, 33, 42}
    assert {r.order_id for r in rejects.collect()} == {6, 19, 21, 31, 51}
    assert {(r.product_id, r.quantity) for r in items.filter("order_id = 16").collect()} == {(1, 4)}


def test_checkout_without_a_time_and_a_repeated_batch(spark, scratch, map_state):
    ev, prod = hand_made(spark)
    lost = spark.createDataFrame([(60, "a", None, "checkout", None, None), (61, "a", None, "add", 1, 7)], SCHEMA)
    (orders, items, rejects), out, schema = run(spark, scratch, ev.unionByName(lost).unionByName(closer(spark, ev)), prod, 2)
    assert {(r.order_id, r.created_at, r.reason) for r in rejects.collect() if r.order_id >= 60} == {(60, None, K.NO_TIME)}
    before = rows(orders), rows(items), rows(rejects)
    last = max(int(d.split("=")[1]) for d in os.listdir(out) if d.startswith("batch="))
    # the same batch again, as after a lost driver: its folder is replaced, no row is doubled
    again = spark.read.option("basePath", f"{out}/batch={last}").schema(schema).parquet(f"{out}/batch={last}")
    K.checkout_writer(out)(spark.createDataFrame(again.select(*schema.names).collect(), schema), last)
    assert tuple(rows(x) for x in K.read_checkouts(spark, out, schema)) == before


def test_price_of_three_decimals_is_refused(spark):
    ev, prod = hand_made(spark)
    with pytest.raises(ValueError):
        K.checkout_stream(ev, prod.withColumn("price", F.col("price").cast("decimal(12,3)")))
