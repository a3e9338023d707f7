"""The skew-safe rewrites must equal their straightforward forms."""

from datetime import datetime, timedelta


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators.evaluation import latency_percentiles
from larder.operators.orders import previous_ts, running_count

T0 = datetime(2024, 1, 1)


def _events(spark, rows):
    return spark.createDataFrame(
        [(i, k, T0 + timedelta(minutes=m), f) for i, (k, m, f) in enumerate(rows)],
        "event_id long, part string, event_ts timestamp, flag boolean")


events_st = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 600), st.booleans()),
                     min_size=1, max_size=60)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events_st)
def test_running_count_and_previous_ts_equal_plain_windows(spark, rows):
    df = _events(spark, rows)
    w = Window.partitionBy("part").orderBy("event_ts", "event_id")
    plain = (df.withColumn("want_before", F.coalesce(F.sum(F.col("flag").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("want_prev", F.lag("event_ts").over(w)))
    got = running_count(df, part="part", ts="event_ts", tie="event_id", flag=F.col("flag"), bucket_seconds=3600)
    got = previous_ts(got, part="part", ts="event_ts", tie="event_id", name="prev", bucket_seconds=3600)
    j = plain.join(got.select("event_id", "before", "prev"), "event_id").collect()
    assert len(j) == len(rows)
    for r in j:
        assert r.before == r.want_before
        assert r.prev == r.want_prev


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]),
                          st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False) | st.sampled_from([0.0, 1.5, 2.0])),
                min_size=1, max_size=80))
def test_select_ranks_equals_sorting(spark, rows):
    df = spark.createDataFrame(rows, "stage string, latency_ms double")
    out = {r.stage: r for r in latency_percentiles(df, threshold_ms=0.0).collect()}
    for stage in {s for s, _ in rows}:
        xs = sorted(v for s, v in rows if s == stage)
        n = len(xs)
        r = out[stage]
        assert r.n == n
        assert r.p95 == xs[int(n * 0.95)] and r.p99 == xs[int(n * 0.99)]
        mid = (xs[(n - 1) // 2] + xs[n // 2]) / 2
        assert abs(r.p50 - mid) <= 1e-9 * max(1.0, abs(mid))


def test_cart_state_with_one_hot_product_equals_a_fold(spark):
    import random
    from larder.operators.orders import cart_state
    rnd = random.Random(3)
    rows, carts = [], {}
    for i in range(4000):
        s, p = ("hot", 1) if rnd.random() < 0.9 else (f"s{rnd.randrange(20)}", rnd.randrange(4))
        op = rnd.choices(["add", "set", "remove", "clear"], [90, 6, 2, 2])[0]
        q = rnd.randrange(0, 4)
        rows.append((i, s, T0 + timedelta(seconds=i // 3), op, None if op == "clear" else p, q))
        cart = carts.setdefault(s, {})
        if op == "add":
            cart[p] = cart.get(p, 0) + q
        elif op == "clear":
            cart.clear()
        elif op == "remove" or q <= 0:
            cart.pop(p, None)
        elif p in cart:
            cart[p] = q
    df = spark.createDataFrame(rows, "event_id long, session_id string, event_ts timestamp, op string, product_id long, quantity int")
    out = cart_state(df)
    assert {(r.session_id, r.product_id): r.quantity for r in out.collect()} == {(s, p): q for s, c in carts.items() for p, q in c.items()}
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()  # hot keys are dealt over tasks


def test_null_keys_and_null_times_are_kept(spark):
    rows = [(1, "a", T0, 1), (2, "a", None, 1), (3, None, T0, 1), (4, None, T0 + timedelta(days=3), 1), (5, None, None, 1),
            (6, "a", T0 + timedelta(days=9), 1)]
    df = spark.createDataFrame(rows, "event_id long, part string, event_ts timestamp, f int")
    got = running_count(df, part="part", ts="event_ts", tie="event_id", flag=F.lit(True))
    got = previous_ts(got, part="part", ts="event_ts", tie="event_id", name="prev")
    assert {r.event_id: (r.before, r.prev) for r in got.collect()} == {
        1: (1, None), 2: (0, None), 6: (2, T0), 3: (1, None), 4: (2, T0), 5: (0, None)}
    from larder.operators.sessions import chat_session_state
    turns = spark.createDataFrame([(1, 0, 0), (1, 1, 100), (None, 0, 50), (None, 1, 60), (2, 0, None)], "conv_id long, turn long, ts_s long")
    out = chat_session_state(turns).collect()
    assert len(out) == 5 and {(r.conv_id, r.turn): r.session_no for r in out}[(None, 1)] == 1


def test_expiry_resets_equal_a_scan_of_sorted_events(spark):
    """Gaps from one row per session and slice, against every neighbouring pair of events."""
    import random
    from datetime import datetime, timedelta
    from larder.operators.orders import expiry_resets
    rnd = random.Random(5)
    t = datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["a", "b", None]), t + timedelta(seconds=rnd.choice([rnd.randrange(200), rnd.randrange(40000)]), microseconds=rnd.choice([0, 1])),
             rnd.choice(["add", "checkout"]), 1, 1) for i in range(300)] + [(900, "a", None, "add", 1, 1), (901, "z", t, "add", 1, 1)]
    ev = spark.createDataFrame(rows, "event_id long, session_id string, event_ts timestamp, op string, product_id long, quantity int")
    for ttl in (0, 1, 7, 60, 61, 600):
        want = []
        for s in {r[1] for r in rows}:
            own = sorted((r[2], r[0]) for r in rows if r[1] == s and r[2] is not None)
            want += [(s or "", ts, i - 0.5) for (prev, _), (ts, i) in zip(own, own[1:]) if (ts - prev).total_seconds() > ttl]
        out = expiry_resets(ev, ttl_seconds=ttl)
        clears = [(r.session_id or "", r.event_ts, r.event_id) for r in out.filter("op = 'clear'").collect()]
        assert sorted(clears) == sorted(want) and want
        assert out.count() == len(rows) + len(want)
