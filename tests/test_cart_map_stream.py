"""The map-state cart stream against the batch replay, on shuffled late input."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.operators import orders as O
from larder.sources.views import RetailModel
from larder.streaming import carts as C
from larder.streaming.jobs import CART_TTL_MS

SCHEMA = "event_id long, session_id string, event_ts timestamp, op string, product_id long, quantity int"


def sequential(events, last=None):
    """(cart, last write) by folding sorted events one by one."""
    cart = {}
    for ms, _, op, p, q in sorted(events):
        if last is not None and ms - last > CART_TTL_MS:
            cart = {}
        if op == "add":
            cart[p] = cart.get(p, 0) + q
        elif op == "set" and p in cart:
            cart[p] = q
            if q <= 0:
                del cart[p]
        elif op == "remove":
            cart.pop(p, None)
        elif op in ("clear", "checkout"):
            cart = {}
        last = ms
    return cart, last


def test_closed_form_equals_the_fold_in_any_order_and_any_cut():
    rnd = random.Random(8)
    for _ in range(400):
        n = rnd.randrange(1, 25)
        gap = rnd.choice([1000, CART_TTL_MS // 3])
        ms, events = 0, []
        for i in range(n):
            ms += rnd.randrange(0, 2 * gap)
            op = rnd.choice(["add", "add", "add", "set", "set", "remove", "clear", "checkout"])
            events.append((ms, i, op, C.WHOLE if op in ("clear", "checkout") else rnd.randrange(3), rnd.randrange(-1, 4) if op == "set" else rnd.randrange(1, 4)))
        want, last_want = sequential(events)
        cart, last = {}, None
        cuts = sorted(rnd.sample(range(n + 1), min(2, n)))
        for a, z in zip([0, *cuts], [*cuts, n], strict=True):
            part = events[a:z]
            if not part:
                continue
            rnd.shuffle(part)
            r = C.Replay(last)
            for step in (r.first_pass, r.second_pass):
                for e_ms, i, op, p, q in part:
                    step(p, [(e_ms, i, op, q)])
                if step == r.first_pass:
                    r.close_first_pass()
            new = {p: r.quantity(p, cart.get(p)) for p in set(cart) | {e[3] for e in part if e[3] != C.WHOLE}}
            cart, last = {p: q for p, q in new.items() if q is not None}, r.last_write
        assert (cart, last) == (want, last_want)


@pytest.fixture()
def map_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, C.STATE_PROVIDER)
    yield
    spark.conf.set(key, before)


def run_stream(spark, scratch, events, files, name):
    """Events in ``files`` files of neighbouring times, each shuffled, an hour of disorder between them."""
    src = os.path.join(scratch, name)
    late = F.unix_seconds("event_ts") + F.pmod(F.xxhash64("event_id"), F.lit(3000))  # arrival: up to 50 minutes late
    lo, hi = events.agg(F.min(late), F.max(late)).first()
    for i in range(files):
        at = F.floor((late - F.lit(lo)) * files / F.lit(hi - lo + 1))
        events.filter(at == i).orderBy(F.xxhash64("event_id", F.lit(1))).coalesce(1).write.parquet(f"{src}/{i:03d}")
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src))
    q = (C.cart_map_stream(stream).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, name + "-ck")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    last = {}
    rows = spark.table(name).collect()
    for r in rows:
        last[r.session_id] = max(last.get(r.session_id, 0), r.snapshot_seq)
    return rows, [r for r in rows if r.snapshot_seq == last[r.session_id]]


def test_map_state_stream_equals_batch_replay(spark, scratch, map_state):
    ev = RetailModel(spark, SF_SMALL).cart_events
    ev = ev.filter(F.crc32("session_id") % 6 == 0).select(
        "event_id", "session_id", F.col("event_ts").cast("timestamp").alias("event_ts"), "op", "product_id", F.col("quantity").cast("int").alias("quantity"))
    end = ev.agg(F.max("event_ts")).first()[0]
    closer = spark.createDataFrame([(10 ** 9, "closer", "add", 1, 1)], "event_id long, session_id string, op string, product_id long, quantity int")
    closer = closer.withColumn("event_ts", F.lit(end) + F.expr("INTERVAL 63 MINUTES"))  # moves the watermark behind the last event
    every = ev.unionByName(closer).cache()
    rows, final = run_stream(spark, scratch, every, 5, "map_carts")
    expired = {r.session_id for r in final if r.expired}
    got = {(r.session_id, r.product_id, r.quantity) for r in final if r.product_id is not None}
    batch = O.cart_state(O.expiry_resets(ev, ttl_seconds=24 * 3600)).collect()
    assert got == {(r.session_id, r.product_id, r.quantity) for r in batch if r.session_id not in expired} and got
    # expired carts are those whose last write lies more than the TTL behind the final watermark
    mark = closer.first()["event_ts"].timestamp() - 3600
    stale = {r.session_id for r in ev.groupBy("session_id").agg(F.max("event_ts").alias("t")).collect() if r.t.timestamp() + 24 * 3600 < mark}
    assert expired == stale  # none in this table; the next test has some


def test_one_session_with_null_fields(spark, scratch, map_state):
    from datetime import datetime, timedelta
    t = datetime(2024, 1, 1)
    rows = [(i, "s", t + timedelta(minutes=i % 50, seconds=i % 7), "add", i % 3, 1) for i in range(200)]
    rows += [(500, None, t, "add", 1, 1), (501, "s", t + timedelta(minutes=20, seconds=30), "clear", None, None),
             (502, "e", t, "add", 5, 2), (503, "z", t + timedelta(hours=3), "add", 1, 1), (504, "z", t + timedelta(hours=60), "add", 1, 1)]
    ev = spark.createDataFrame(rows, SCHEMA)
    _, final = run_stream(spark, scratch, ev, 1, "one_session")
    by = {(r.session_id, r.product_id): (r.quantity, r.expired) for r in final}
    assert by[("e", None)] == (0, True) and by[("s", None)] == (0, True)
    snapshots = [r for r in spark.table("one_session").collect() if r.session_id == "s" and not r.expired]
    want, _ = sequential([(int((ts - t).total_seconds() * 1000), i, op, p, q) for i, s, ts, op, p, q in rows if s == "s"])
    assert {r.product_id: r.quantity for r in snapshots if r.snapshot_seq == max(x.snapshot_seq for x in snapshots)} == want


def test_a_write_in_the_slice_where_the_ttl_ends_keeps_the_cart(spark, scratch, map_state):
    from datetime import datetime, timedelta
    t = datetime(2024, 1, 1)
    at = lambda h, s: t + timedelta(hours=h, seconds=s)
    # the watermark of the first file (24 h 40 s) lies behind the TTL of x (24 h 30 s), but before the end of the slice that holds its second write
    files = [[(1, "x", at(0, 30), "add", 1, 1), (2, "x", at(24, 20), "add", 1, 1), (3, "y", at(25, 40), "add", 2, 1)],
             [(4, "y", at(26, 0), "add", 2, 1)]]
    src = os.path.join(scratch, "in")
    for i, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    C.cart_map_stream(stream).writeStream.format("memory").queryName("ttl_slice").option(
        "checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start().awaitTermination(300)
    got = [r for r in spark.table("ttl_slice").collect() if r.session_id == "x"]
    assert not any(r.expired for r in got)
    last = max(got, key=lambda r: r.snapshot_seq)
    assert (last.product_id, last.quantity) == (1, 2)
