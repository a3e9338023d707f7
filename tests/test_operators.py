"""Operator behaviour on small hand-made fixtures (the shop test fixture:
2 categories, 4 products with one soft-deleted, one live and one expired
deal, one store), plus brute-force checks of the scale-oriented rewrites."""

from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import analytics as A
from larder.operators import catalog as C
from larder.operators import deals as D
from larder.operators import evaluation as E
from larder.operators import orders as O
from larder.operators import vectors as V

AS_OF = datetime(2026, 4, 12, 12, 0, 0)


@pytest.fixture(scope="module")
def shop(spark):
    cat = spark.createDataFrame([("Fresh", "fresh", 1, True), ("Beverages", "beverages", 2, True)],
                                "category string, slug string, display_order int, is_active boolean")
    prod = spark.createDataFrame([
        (1, "Fresh", "Organic Fuji Apple", "Crisp apples", "Nature's Best", Decimal("1.99"), "FRE-0001", True, True, False,
         "fruit,organic,apple"),
        (2, "Fresh", "Banana Bundle", "Ripe bananas", None, Decimal("2.49"), "FRE-0002", True, False, False, None),
        (3, "Beverages", "Spring Water 24-Pack", "Pure water", "Crystal Clear", Decimal("4.99"), "BEV-0001", True,
         False, False, None),
        (4, "Fresh", "Expired Lettuce", "Old lettuce", None, Decimal("1.49"), "FRE-0003", False, False, False, None),
    ], "product_id long, category string, name string, description string, brand string, price decimal(10,2), "
       "sku string, is_available boolean, is_organic boolean, is_store_brand boolean, tags string")
    deals = spark.createDataFrame([
        (10, 1, "DailyDeal", Decimal("25.00"), AS_OF - timedelta(days=1), AS_OF + timedelta(days=1), True),
        (20, 2, "WeeklyDeal", Decimal("10.00"), AS_OF - timedelta(days=10), AS_OF - timedelta(days=1), False),
    ], "deal_id long, product_id long, deal_type string, discount_percent decimal(5,2), start_date timestamp, "
       "end_date timestamp, is_active boolean")
    return cat, prod, deals


def test_soft_deleted_hidden_and_filters(shop):
    cat, prod, deals = shop
    p = C.find_products(prod, cat, deals, as_of=AS_OF)
    assert p.count() == 3
    assert C.find_products(prod, cat, deals, as_of=AS_OF, category="Fresh").count() == 2
    assert C.find_products(prod, cat, deals, as_of=AS_OF, organic=True).count() == 1
    only = C.find_products(prod, cat, deals, as_of=AS_OF, deals_only=True).collect()
    assert [r.name for r in only] == ["Organic Fuji Apple"]
    assert C.find_products(prod, cat, deals, as_of=AS_OF, brand="crystal").count() == 1


def test_paging_flags(shop):
    cat, prod, deals = shop
    p = C.find_products(prod, cat, deals, as_of=AS_OF)
    p1 = C.paginate(p, order=C.product_sort("name"), page=1, size=2).collect()
    p2 = C.paginate(p, order=C.product_sort("name"), page=2, size=2).collect()
    assert len(p1) == 2 and len(p2) == 1
    assert p1[0].total_count == 3 and p1[0].total_pages == 2
    assert p1[0].has_next and not p1[0].has_previous
    assert not p2[0].has_next and p2[0].has_previous


def test_search_case_insensitive_and_blank(shop):
    _, prod, _ = shop
    assert [r.name for r in C.product_search(prod, term="APPLE").collect()] == ["Organic Fuji Apple"]
    with pytest.raises(ValueError):
        C.product_search(prod, term="  ")


def test_unknown_slug_empty(shop):
    cat, prod, _ = shop
    assert C.products_by_slug(prod, cat, slug="nope").count() == 0
    assert C.products_by_slug(prod, cat, slug="beverages").count() == 1


def test_product_view_deal_attached_or_null(shop):
    cat, prod, deals = shop
    v = {r.product_id: r.active_deal for r in C.product_view(prod, cat, deals, as_of=AS_OF).collect()}
    assert v[1] is not None and v[1].deal_type == "DailyDeal" and v[1].title == "Today Only: 25% Off"
    assert v[2] is None  # expired and inactive deal is not attached


def test_deal_expire_and_rotation(shop):
    _, prod, deals = shop
    later = AS_OF + timedelta(days=2)
    ex = {r.deal_id: r for r in D.deal_expire(deals, as_of=later).collect()}
    assert ex[10].is_active is False and ex[10].updated_at == later
    assert ex[20].updated_at is None
    new = D.deal_rotation(deals, prod, as_of=later, seed=1, k=15).collect()
    assert sorted(r.product_id for r in new) == [1, 2, 3]   # available products without a live deal
    assert all(r.end_date == datetime(2026, 4, 15, 5, 0) for r in new)
    assert all(int(r.discount_percent) in D.ROTATION_PCTS for r in new)


def _cart(spark, rows):
    return spark.createDataFrame(
        [(i, "s1" if len(r) == 3 else r[3], AS_OF + timedelta(seconds=i), r[0], r[1], r[2]) for i, r in enumerate(rows)],
        "event_id long, session_id string, event_ts timestamp, op string, product_id long, quantity int")


def _state(df):
    return {(r.session_id, r.product_id): r.quantity for r in O.cart_state(df).collect()}


def test_cart_rules(spark):
    # add increments, set replaces, set on absent is ignored, set <= 0 removes
    ev = _cart(spark, [("add", 1, 2), ("add", 1, 3), ("set", 2, 5), ("add", 3, 1), ("set", 3, 4),
                       ("add", 2, 1), ("set", 2, 0)])
    assert _state(ev) == {("s1", 1): 5, ("s1", 3): 4}
    ev = _cart(spark, [("add", 1, 2), ("clear", None, None), ("add", 3, 1), ("remove", 3, None), ("add", 3, 2)])
    assert _state(ev) == {("s1", 3): 2}
    # independent sessions
    ev = _cart(spark, [("add", 1, 1, "a"), ("add", 1, 2, "b"), ("clear", None, None, "a")])
    assert _state(ev) == {("b", 1): 2}


def _fold_reference(events):
    """Plain sequential fold used as the brute-force twin."""
    carts = {}
    for op, pid, q, sid in events:
        c = carts.setdefault(sid, {})
        if op == "add":
            c[pid] = c.get(pid, 0) + q
        elif op == "set" and pid in c:
            if q <= 0:
                del c[pid]
            else:
                c[pid] = q
        elif op == "remove":
            c.pop(pid, None)
        elif op in ("clear", "checkout"):
            carts[sid] = {}
    return {(s, p): q for s, c in carts.items() for p, q in c.items()}


def test_cart_closed_form_matches_fold(spark):
    rng = np.random.default_rng(7)
    ops = ["add", "add", "set", "remove", "clear", "checkout"]
    evs = []
    for _ in range(400):
        op = ops[rng.integers(len(ops))]
        pid = int(rng.integers(4))
        q = int(rng.integers(-1, 4)) if op == "set" else int(rng.integers(1, 4))
        evs.append((op, pid, q, f"s{rng.integers(3)}"))
    df = _cart(spark, [(o, p, q, s) for o, p, q, s in evs])
    assert _state(df) == _fold_reference(evs)


def test_cart_totals_tax_and_fee(spark, shop):
    _, prod, _ = shop
    small = _cart(spark, [("add", 1, 2), ("add", 2, 1)])           # 2 x 1.99 + 2.49 = 6.47
    lines = O.cart_lines(O.cart_state(small), prod)
    t = O.cart_totals(lines, O.cart_state(small), small).first()
    assert t.subtotal == Decimal("6.47") and t.tax == Decimal("0.45") and t.delivery_fee == Decimal("5.99")
    big = _cart(spark, [("add", 3, 8)])                               # 39.92 >= 35: free delivery
    t = O.cart_totals(O.cart_lines(O.cart_state(big), prod), O.cart_state(big), big).first()
    assert t.delivery_fee == Decimal("0.00") and t.tax == Decimal("2.79")
    empty = _cart(spark, [("add", 1, 1), ("clear", None, None)])
    t = O.cart_totals(O.cart_lines(O.cart_state(empty), prod), O.cart_state(empty), empty).first()
    assert t.item_count == 0 and t.total == Decimal("0.00") and t.delivery_fee == Decimal("0.00")
    unknown = _cart(spark, [("add", 99, 1)])                          # stored line, unknown product
    t = O.cart_totals(O.cart_lines(O.cart_state(unknown), prod), O.cart_state(unknown), unknown).first()
    assert t.item_count == 0 and t.subtotal == Decimal("0.00") and t.delivery_fee == Decimal("5.99")
    with_deal = O.cart_lines(O.cart_state(small), prod, shop[2], as_of=AS_OF)
    assert {r.product_id: r.active_deal_type for r in with_deal.collect()} == {1: "DailyDeal", 2: None}


def test_tax_rounds_half_even(spark):
    df = spark.createDataFrame([(1, Decimal("9.50")), (2, Decimal("1.50"))], "order_id long, line_total decimal(12,2)")
    tax = {r.order_id: r.tax for r in O.order_totals(df).collect()}
    assert tax == {1: Decimal("0.66"), 2: Decimal("0.10")}


def test_create_order_and_empty_cart_reject(spark, shop):
    _, prod, _ = shop
    ev = _cart(spark, [("add", 1, 2), ("add", 3, 1), ("checkout", None, None), ("checkout", None, None)])
    orders, items, rejects = O.create_order(ev, prod)
    o = orders.collect()
    assert len(o) == 1 and o[0].subtotal == Decimal("8.97") and o[0].status == "Pending"
    assert o[0].order_number.startswith("ORD-20260412-")
    assert items.count() == 2 and rejects.count() == 1


def test_order_status_any_transition(spark):
    orders = spark.createDataFrame([(1, "Pending"), (2, "Pending")], "order_id long, status string")
    ev = spark.createDataFrame([(1, 1, "Confirmed"), (1, 2, "Delivered"), (1, 3, "Pending"), (9, 1, "Cancelled")],
                               "order_id long, event_seq long, new_status string")
    out = {r.order_id: (r.status, r.updated_at) for r in O.order_status_apply(orders, ev, as_of=AS_OF).collect()}
    assert out == {1: ("Pending", None), 2: ("Pending", None)}


def test_latency_percentiles_index_rule(spark):
    vals = [float(v) for v in range(1, 11)]
    df = spark.createDataFrame([("s", v) for v in vals], "stage string, latency_ms double")
    r = E.latency_percentiles(df, threshold_ms=100).first()
    assert r.p50 == 5.5 and r.p95 == 10.0 and r.p99 == 10.0 and r.passed   # index int(10*0.95)=9 -> max


def test_vector_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    coll = rng.normal(size=(300, 16))
    qs = rng.normal(size=(7, 16))
    cdf = spark.createDataFrame([(i, v.tolist(), f"c{i % 3}") for i, v in enumerate(coll)],
                                "vec_id long, embedding array<double>, category string").repartition(5)
    qdf = spark.createDataFrame([(i, v.tolist(), f"c{i % 3}" if i % 2 else None) for i, v in enumerate(qs)],
                                "query_id long, embedding array<double>, f string")
    for filtered, blk in ((False, 3), (True, 3), (False, 4096), (True, 4096)):
        got = V.vector_top_k(qdf, cdf, k=4, filter_col="category" if filtered else None,
                             query_filter_col="f" if filtered else None, block_rows=blk, chunk_rows=blk * 20)
        got = {(r.query_id, r.rank): r.vec_id for r in got.collect()}
        cn = coll / np.linalg.norm(coll, axis=1)[:, None]
        for qi, q in enumerate(qs):
            s = cn @ (q / np.linalg.norm(q))
            if filtered and qi % 2:
                s = np.where(np.arange(len(coll)) % 3 == qi % 3, s, -np.inf)
            best = np.argsort(-s, kind="stable")[:4]
            assert [got[(qi, r + 1)] for r in range(4)] == [int(b) for b in best]


def test_vector_top_k_ties_do_not_depend_on_layout(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 16))
    rows = [(int(i), base[i % 4].tolist()) for i in rng.permutation(200)]
    qdf = spark.createDataFrame([(i, (base[i] + 0.01).tolist()) for i in range(4)], "query_id long, embedding array<double>")
    for parts, blk, chunk, tile in ((1, 4096, 16384, 1 << 21), (3, 2, 64, 100), (16, 1, 10, 7)):
        monkeypatch.setattr(V, "TILE_SCORES", tile)
        cdf = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = V.vector_top_k(qdf, cdf, k=5, block_rows=blk, chunk_rows=chunk).collect()
        assert {(r.query_id, r.rank): r.vec_id for r in got} == {(q, r + 1): q + 4 * r for q in range(4) for r in range(5)}


def test_cell_top_k_sums_few_of_many_tied_rows(monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.integers(0, 2, (5, 16)).astype(float)[rng.integers(0, 5, 9000)]  # thousands of ties at any place
    v[::7] += rng.integers(0, 3, (len(v[::7]), 16))
    q = rng.integers(0, 3, (20, 16)).astype(float)
    q /= np.linalg.norm(q, axis=1)[:, None]
    ids, kinds = rng.permutation(9000).astype(str).astype(object), np.array(["a", "b", "c"], object)[rng.integers(0, 3, 9000)]
    asked = [None, "a", "b", "none"] * 5
    summed = []
    cumsum = np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda x, axis=None: (summed.append(len(x)) if axis == 1 else None, cumsum(x, axis=axis))[1])
    for tile in (V.TILE_SCORES, 20_000):
        monkeypatch.setattr(V, "TILE_SCORES", tile)
        at, row, score = V._cell_top_k(q, asked, v.copy(), ids, kinds, 6, 10)
        unit = v / np.where(np.linalg.norm(v, axis=1) > 0, np.linalg.norm(v, axis=1), 1)[:, None]
        for i, f in enumerate(asked):
            exact = np.round(cumsum(unit * q[i], axis=1)[:, -1], 10)
            ok = [j for j in range(9000) if f is None or kinds[j] == f]
            best = sorted(ok, key=lambda j: (-exact[j], ids[j]))[:6]
            got = sorted(((-s, ids[r], r) for a, r, s in zip(at, row, score) if a == i))
            assert [(r, -s) for s, _, r in got] == [(j, exact[j]) for j in best]
    assert sum(summed) < 9000  # of 20 queries times thousands of equal scores


def test_cell_top_k_single_precision_only_leaves_out(monkeypatch):
    rng = np.random.default_rng(11)
    v = rng.integers(0, 4, (6000, 24)).astype(float)
    v[1::3] = v[::3] * rng.integers(1, 5, (2000, 1))  # equal directions
    v[2::3] = v[::3] + 1e-8 * rng.random((2000, 24))  # scores that single precision cannot tell apart
    q = rng.integers(0, 3, (64, 24)) * (rng.random((64, 24)) < 0.5).astype(float)
    q[0], q[1] = 0, np.eye(24)[3]  # all rows tied; very many tied
    q /= np.where(np.linalg.norm(q, axis=1) > 0, np.linalg.norm(q, axis=1), 1)[:, None]
    ids = rng.permutation(6000)
    wide = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: (wide.append(len(a[1])), einsum(*a))[1])
    at, row, score = V._cell_top_k(q, None, v.copy(), ids, None, 5, 10)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for i in range(64):
        exact = np.round(np.cumsum(unit * q[i], axis=1)[:, -1], 10) + 0.0
        best = np.lexsort((ids, -exact))[:5]
        got = sorted((-s, ids[r]) for a, r, s in zip(at, row, score) if a == i)
        assert got == [(-exact[j], ids[j]) for j in best]
    assert 0 < sum(wide) < 64 * 6000 / 20  # the scores computed in double


def test_a_stream_of_rows_sums_few_scores_in_double(monkeypatch):
    rng = np.random.default_rng(13)
    v, q = rng.random((16384, 24)), rng.random((50, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    q /= np.linalg.norm(q, axis=1)[:, None]
    wide = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *a: (wide.append(len(a[1])), einsum(*a))[1])
    at, row, score = V._cell_top_k(q, None, v.copy(), np.arange(16384), None, 10, 10)
    assert sum(wide) < 50 * 45  # 94 a query where a few rows were read first and the steps grew
    for i in range(50):
        exact = np.round(v @ q[i], 10)
        best = np.lexsort((np.arange(16384), -exact))[:10]
        assert [r for _, r in sorted((-s, r) for a, r, s in zip(at, row, score) if a == i)] == list(best)


def test_best_rows_of_a_stream_hold_for_any_batches_tiles_and_depths(monkeypatch):
    rng = np.random.default_rng(17)
    v = rng.integers(0, 3, (3000, 12)).astype(float)  # many ties
    v[:40] = 0
    v /= np.where(np.linalg.norm(v, axis=1) > 0, np.linalg.norm(v, axis=1), 1)[:, None]
    q = np.vstack([np.zeros((1, 12)), rng.integers(0, 3, (9, 12))]).astype(float)
    q /= np.where(np.linalg.norm(q, axis=1) > 0, np.linalg.norm(q, axis=1), 1)[:, None]
    kinds, asked = np.array(["a", "b", None], object)[rng.integers(0, 3, 3000)], [None, "a", "b", "none", None] * 2
    for k, tile, step, batch, cut in ((1, 1 << 20, 1024, 8192, 3000), (7, 300, 100, 500, 900), (400, 50, 64, 64, 1000), (5000, 1 << 12, 1024, 8192, 1700)):
        for name, value in (("TILE_SCORES", tile), ("STEP_ROWS", step), ("BATCH_ROWS", batch)):
            monkeypatch.setattr(V, name, value)
        best = V._Best(q, asked, k, 10)
        for lo in range(0, 3000, cut):
            best.add(v[lo:lo + cut], kinds[lo:lo + cut])
        at, row, score = best.rows()
        for i, f in enumerate(asked):
            exact = np.round(np.cumsum(v * q[i], axis=1)[:, -1], 10) + 0.0
            want = sorted((-exact[j], j) for j in range(3000) if f is None or kinds[j] == f)[:k]
            assert sorted((-s, r) for a, r, s in zip(at, row, score) if a == i) == want


def test_vector_top_k_meets_every_row_in_cells_of_small_batches(spark):
    rng = np.random.default_rng(19)
    base = rng.integers(0, 3, (900, 8)).astype(float)
    ids, kinds = [f"v{i % 880:04d}" for i in range(900)], [None if i % 7 == 0 else f"c{i % 3}" for i in range(900)]  # ids that come twice
    coll = spark.createDataFrame(list(zip(ids, base.tolist(), kinds)), "vec_id string, embedding array<double>, category string").repartition(3)
    asks = [(f"q{i % 18}", rng.integers(0, 3, 8).astype(float).tolist(), None if i % 4 == 0 else f"c{i % 4}") for i in range(20)]  # queries, too
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=-1, keepdims=True) > 0, np.linalg.norm(m, axis=-1, keepdims=True), 1)
    want = {}
    for name, e, f in asks:
        s = np.round(np.cumsum(unit(base) * unit(np.array(e)), axis=1)[:, -1], 10) + 0.0
        want.setdefault(name, []).extend(sorted((-s[j], ids[j]) for j in range(900) if f is None or kinds[j] == f)[:6])
    want = sorted((q, r + 1, i, -s) for q, hits in want.items() for r, (s, i) in enumerate(sorted(hits)[:6]))
    queries = spark.createDataFrame(asks, "query_id string, embedding array<double>, f string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for block, chunk in ((4, 100), (7, 5000), (5000, 64)):
            got = V.vector_top_k(queries, coll, k=6, filter_col="category", query_filter_col="f", block_rows=block, chunk_rows=chunk)
            assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want
        empty = coll.filter("vec_id = 'none'")
        assert V.vector_top_k(queries, empty, k=6).count() == 0 and V.vector_top_k(queries.filter("f = 'none'"), coll, k=6).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_questions_are_embedded_once(spark, tmp_path):
    from larder.plans.answer_queries import _hits
    from larder.sources.views import RetailModel
    spark.createDataFrame([(1, 0, "user", "any BOGO deals on ring or bolt?"), (1, 1, "assistant", "yes"), (2, 0, "user", None)],
                          "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(9 * i, f"hot {w}", "Brand#2", "SMALL", i, 5.0 + i) for i, w in enumerate(("ring", "bolt", "gear"))],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "Supplier#1", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "LAKELAND")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    q, ph, dh, sh = _hits(spark, RetailModel(spark, str(tmp_path)))
    assert "ArrowEvalPython" not in q._jdf.queryExecution().executedPlan().toString()
    assert {r.query_id: r["count"] for r in ph.groupBy("query_id").count().collect()} == {"1:0": 3, "2:0": 3}
    assert {r.query_id: r["count"] for r in sh.groupBy("query_id").count().collect()} == {"1:0": 1, "2:0": 1}


def _chat_tables(spark, d):
    said = ["where is your store?", "any bogo deals on ring?", "what is ring?", "track my order", "how many products do you have?", None]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(said)] + [(7, None, "user", "track my order"), (7, None, "user", "store hours?")],
                          "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(9 * i, f"hot {w}", "Brand#2", "SMALL", i, 5.0 + i) for i, w in enumerate(("ring", "bolt", "gear"))],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(1, "Supplier#1", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(0, "LAKELAND")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")


def test_collections_are_searched_for_the_questions_that_take_hits(spark, tmp_path, monkeypatch):
    from larder.operators import answers as Ans
    from larder.plans import answer_queries as AQ
    from larder.sources.views import RetailModel
    _chat_tables(spark, str(tmp_path))
    m = RetailModel(spark, str(tmp_path))
    asked, splits = [], []
    search = AQ.V.vector_top_k

    def spy(q, coll, **kw):
        asked.append({r.query_id for r in q.select("query_id").collect()})
        splits.append(coll.rdd.getNumPartitions())
        return search(q, coll, **kw)
    monkeypatch.setattr(AQ.V, "vector_top_k", spy)
    rows = lambda df: sorted(map(str, df.collect()))
    every = AQ._hits(spark, m)
    assert all(x == {"0:0", "1:0", "2:0", "3:0", "4:0", "5:0", "7"} for x in asked)
    assert splits[0] >= spark.sparkContext.defaultParallelism  # one file of products, embedded by all cores
    for audience, flow in (("customer", lambda q, *h: Ans.chat_batch(q.drop("embedding"), m.chat_turns, *h)),
                           ("staff", lambda q, *h: Ans.staff_chat_batch(q.drop("embedding"), m.chat_turns, *h, m.products, m.categories, m.deals,
                                                                        as_of=AQ.AS_OF, staff_role="manager"))):
        asked.clear()
        hits = AQ._hits(spark, m, audience)
        products, _, stores = asked
        assert stores == {"0:0", "7"}
        assert ("3:0" if audience == "customer" else "4:0") not in products and {"0:0", "1:0", "2:0", "5:0", "7"} <= products
        assert rows(flow(*hits)) == rows(flow(*every))


def test_l2_normalize_sums_the_norm_once_a_row(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, None],), ([0.1, 0.2, 0.3],)]
    out = spark.createDataFrame(rows, "v array<double>").select(V.l2_normalize(F.col("v")).alias("u"))
    n = float(np.sqrt(0.1 * 0.1 + 0.2 * 0.2 + 0.3 * 0.3))
    assert [r.u for r in out.collect()] == [[0.6, 0.8], [0.0, 0.0], None, [1.0, None], [0.1 / n, 0.2 / n, 0.3 / n]]
    assert str(V.l2_normalize(F.col("v"))).lower().count("aggregate(") == 1  # the sum of squares, once a row



def test_wide_numbers_keep_their_digits(spark):
    import duckdb
    from larder.sources.views import VIEW_SQL
    part = spark.createDataFrame([(k, "STANDARD X", "n", "b", "m", 1, "c", 1.0, "t") for k in (7, 999_999, 1_000_000, 10_000_001)],
                                 "p_partkey long, p_type string, p_name string, p_brand string, p_mfgr string, p_size int, p_container string, p_retailprice double, p_comment string")
    got = sorted(r.sku for r in spark.sql(VIEW_SQL["products"], part=part).select("sku").collect())
    assert got == ["STA-000007", "STA-1000000", "STA-10000001", "STA-999999"]
    assert duckdb.sql("SELECT printf('%06d', 1000000)").fetchall()[0][0] == "1000000"


def test_upserts_keep_other_columns_and_stamps(spark):
    from datetime import datetime, timezone
    from larder.operators import deals as D
    from larder.operators import orders as O
    old, now = datetime(2000, 1, 1, tzinfo=timezone.utc), datetime(2001, 8, 2, tzinfo=timezone.utc)
    t = spark.createDataFrame([(1, "Fresh", "A", 1.0, "x", None, True, old, "note", "kept-slug"), (2, "Fresh", "B", 2.0, "x", "FRE-000002", True, old, "n2", "b")],
                              "product_id long, category string, name string, price double, brand string, sku string, is_available boolean, updated_at timestamp, description string, slug string")
    ch = spark.createDataFrame([(2, "update", "Fresh", "B two", 3.0, "y", 1, "new text"), (3, "create", "Fresh", "C", 1.0, "z", 1, None)],
                               "product_id long, op string, category string, name string, price double, brand string, change_seq int, description string")
    got = {r.product_id: r for r in O.product_upsert(t, ch, None, as_of=now).collect()}
    assert got[1].updated_at == got[1].updated_at and got[1].description == "note" and got[1].slug == "kept-slug" and got[1].sku is None
    assert got[1].updated_at.year < 2001 and got[2].updated_at.year == 2001 and got[2].description == "new text" and got[2].slug == "b-two"
    assert got[3].sku == "FRE-000003"
    d = spark.createDataFrame([(1, 1, None, 5.0, old, now, True, "extra", old)], "deal_id long, product_id long, deal_type string, discount_percent double, start_date timestamp, end_date timestamp, is_active boolean, note string, updated_at timestamp")
    none = spark.createDataFrame([], "deal_id long, product_id long, deal_type string, discount_percent double, start_date timestamp, end_date timestamp, is_active boolean, op string, change_seq int")
    row = D.deal_upsert(d, none, as_of=now).first()
    assert row.note == "extra" and row.updated_at.year < 2001


def test_ranks_with_one_value_in_most_rows(spark):
    df = spark.createDataFrame([("s", 5.0)] * 900 + [("s", float(v)) for v in range(100)], "stage string, latency_ms double")
    r = E.latency_percentiles(df, threshold_ms=100).first()
    want = sorted([5.0] * 900 + [float(v) for v in range(100)])
    assert r.p50 == (want[499] + want[500]) / 2 and r.p95 == want[950] and r.p99 == want[990]


def test_embed_texts_provider_errors(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(25)], "id long, text string").coalesce(1)

    def flaky(texts):
        if any(t.endswith("13") for t in texts):
            raise RuntimeError("provider down")
        return [[1.0, 0.0] for _ in texts]
    zero = V.embed_texts(df, "text", provider=flaky, batch=10, dim=2).collect()
    failed = {r.id for r in zero if r.embedding == [0.0, 0.0]}
    assert len(zero) == 25 and 13 in failed and 1 <= len(failed) <= 10   # only the failing batch
    skip = V.embed_texts(df, "text", provider=flaky, batch=10, on_error="skip", dim=2).collect()
    assert 15 <= len(skip) < 25 and 13 not in {r.id for r in skip}
    h = V.embed_texts(df, "text").first().embedding
    assert len(h) == V.DEFAULT_DIM and abs(sum(x * x for x in h) - 1.0) < 1e-9


def test_category_stats_on_fixture(shop):
    cat, prod, _ = shop
    r = {x.category: x for x in A.category_stats(prod, cat).collect()}
    assert r["Fresh"].product_count == 3 and r["Fresh"].organic_count == 1
    assert r["Fresh"].avg_price == Decimal("1.99")


def test_keyset_page_equals_offset_page(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "product_id")
    offset_page = [r.product_id for r in df.orderBy("product_id").offset(500).limit(20).collect()]
    keyset = [r.product_id for r in C.keyset_page(df, key="product_id", after=499, size=20).collect()]
    assert keyset == offset_page
    desc = [r.product_id for r in C.keyset_page(df, key="product_id", after=500, size=3, descending=True).collect()]
    assert desc == [499, 498, 497]


def test_cart_expiry_matches_fold_with_ttl(spark):
    rng = np.random.default_rng(11)
    rows, t = [], AS_OF
    for i in range(300):
        t = t + timedelta(hours=float(rng.choice([0.5, 3.0, 30.0], p=[0.6, 0.3, 0.1])))
        op = ["add", "add", "set", "remove", "clear"][rng.integers(5)]
        rows.append((i, f"s{rng.integers(3)}", t, op, int(rng.integers(4)),
                     int(rng.integers(0, 4)) if op == "set" else int(rng.integers(1, 4))))
    df = spark.createDataFrame(rows, "event_id long, session_id string, event_ts timestamp, op string, "
                                     "product_id long, quantity int")
    got = {(r.session_id, r.product_id): r.quantity
           for r in O.cart_state(O.expiry_resets(df, ttl_seconds=24 * 3600)).collect()}
    carts, last = {}, {}
    for _, sid, ts, op, pid, q in rows:
        if sid in last and (ts - last[sid]).total_seconds() > 24 * 3600:
            carts[sid] = {}
        c = carts.setdefault(sid, {})
        if op == "add":
            c[pid] = c.get(pid, 0) + q
        elif op == "set" and pid in c:
            if q <= 0:
                del c[pid]
            else:
                c[pid] = q
        elif op == "remove":
            c.pop(pid, None)
        elif op == "clear":
            carts[sid] = {}
        last[sid] = ts
    want = {(s, p): q for s, c in carts.items() for p, q in c.items()}
    assert got == want


def test_hashed_embedding_equals_python_twin(spark):
    import re
    import zlib
    texts = ["Organic Fuji Apple by Nature's Best", "", "Éclair au café, café!", "x " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.embedding for r in V.embed_texts(df, "text", dim=16).collect()}
    for i, t in enumerate(texts):
        c = np.zeros(16)
        for tok in re.split(r"[^\w]+|_", t.lower()):
            if tok:
                h = zlib.crc32(tok.encode("utf-8"))
                c[h % 16] += 1
        n = np.linalg.norm(c)
        want = c / n if n > 0 else c
        assert np.allclose(got[i], want), t


def test_build_messages_keeps_last_ten_history_turns(spark):
    from larder.operators import answers as Ans
    turns = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}", 60 * t) for t in range(13)]
                                  + [(2, 0, "system", "s", 0), (2, 1, "user", "old", 10), (2, 2, "user", "new", 10 + 7201),
                                     (2, 3, "assistant", "a", 7300), (2, 4, "user", "last", 7400)],
                                  "conv_id long, turn long, role string, text string, ts_s long")
    gap = {r.turn: [m.content for m in r.history] for r in Ans.history_window(turns).filter("conv_id = 2").collect()}
    assert gap == {1: [], 2: [], 3: ["new"], 4: ["new", "a"]}   # an expired session and system turns leave no history
    turns = turns.filter("conv_id = 1")
    h = Ans.history_window(turns).withColumn("query_id", F.col("turn")).withColumn("context", F.lit("ctx"))
    msgs = {r.turn: r.messages for r in Ans.build_messages(h).collect()}
    assert [m.content for m in msgs[12][1:-1]] == [f"m{t}" for t in range(2, 12)]   # 10 most recent
    assert [m.content for m in msgs[3][1:-1]] == ["m0", "m1", "m2"]                  # short history kept whole
    assert msgs[0][0].role == "system" and len(msgs[0]) == 2
    assert msgs[12][-1].content.endswith("Customer question: m12")


def _hits(spark):
    ph = spark.createDataFrame(
        [(1, r, f"SKU-{r}", f"Product {r}", 4.02 if r == 1 else 1.0, "lb" if r == 1 else "each", "Fresh",
          r == 1, "Green Acres" if r == 1 else None) for r in range(1, 13)],
        "query_id long, rank int, sku string, name string, price double, unit string, category string, "
        "is_organic boolean, brand string")
    dh = spark.createDataFrame([(1, 1, "30% Off This Week", "Product 1", "WeeklyDeal", 30.0, "SKU-1"),
                                (1, 2, "Buy One Get One Free", "Product 2", "BOGO", None, "SKU-2")],
                               "query_id long, rank int, title string, product_name string, deal_type string, "
                               "discount_percent double, product_sku string")
    sh = spark.createDataFrame([(1, 1, "Main Street", "1 Main St", "Springfield", "FL", "33801", "(555) 010-0101")],
                               "query_id long, rank int, name string, address string, city string, state string, "
                               "zip_code string, phone string")
    return ph, dh, sh


def test_build_context_layout(spark):
    from larder.operators import answers as Ans
    ph, dh, sh = _hits(spark)
    qs = spark.createDataFrame([(1,), (2,)], "query_id long")
    ctx = {r.query_id: r.context for r in Ans.build_context(qs, ph, dh, sh).collect()}
    c = ctx[1]
    assert c.startswith("=== Available Products ===\n- Product 1 | $4.02/lb | Fresh | Organic | Green Acres\n")
    assert sum(1 for ln in c.split("\n") if ln.startswith("- Product")) == 8            # at most 8 products
    assert "\n\n=== Current Deals ===\n- 30% Off This Week: Product 1 (WeeklyDeal) — 30% off\n" in c
    assert "- Buy One Get One Free: Product 2 (BOGO)\n" in c                            # no percent for BOGO
    assert c.endswith("\n\n=== Store Locations ===\n- Main Street: 1 Main St, Springfield, FL 33801 | Phone: (555) 010-0101")
    assert ctx[2] == "No relevant products found in our catalog."


def test_chat_batch_scenarios_and_refs(spark):
    from larder.operators import answers as Ans
    ph, dh, sh = _hits(spark)
    qs = spark.createDataFrame([(1, 7, 0, "show me fresh fruit"), (2, 8, 0, "track my order please")],
                               "query_id long, conv_id long, turn long, text string")
    turns = qs.select("conv_id", "turn", F.lit("user").alias("role"), F.col("turn").alias("ts_s"), "text")
    out = {r.query_id: r for r in Ans.chat_batch(qs, turns, ph, dh, sh).collect()}
    a = out[1]
    assert a.intent == "product_search" and a.scenario is None and a.model == "template"
    assert a.response.startswith("Here is what I found:\n- Product 1 | $4.02/lb")
    assert [(p.sku, p.deal_type) for p in a.products] == [("SKU-1", "WeeklyDeal"), ("SKU-2", "BOGO"),
                                                          ("SKU-3", None), ("SKU-4", None), ("SKU-5", None)]
    b = out[2]
    assert b.scenario == "order_tracking" and b.model == "custom" and b.products == []
    assert b.response.startswith("I appreciate your interest in tracking your order!")


def test_cart_expiry_report(spark):
    t = AS_OF
    ev = spark.createDataFrame([
        (1, "a", t, "add", 1, 2),                                  # a: last write at t, expires t+24h
        (2, "b", t + timedelta(hours=10), "add", 2, 1),            # b: emptied later, not reported
        (3, "b", t + timedelta(hours=11), "remove", 2, None),
        (4, "c", t + timedelta(hours=30), "add", 3, 4),            # c: last write at t+30h
    ], "event_id long, session_id string, event_ts timestamp, op string, product_id long, quantity int")
    out = {r.session_id: r for r in O.cart_expiry(ev).collect()}
    assert set(out) == {"a", "c"}
    assert out["a"].items == 2 and out["a"].expired_at_end                # t+24h < t+30h (stream end)
    assert out["c"].lines == 1 and not out["c"].expired_at_end
    assert out["a"].expires_at == t + timedelta(hours=24)


def test_nearest_stores_batch_any_layout(spark, monkeypatch):
    from larder.operators import catalog as C
    rng = np.random.default_rng(1)
    st = [(int(i), round(float(a), 1), round(float(b), 1), bool(i % 5)) for i, (a, b) in enumerate(rng.uniform(0, 3, (120, 2)))]
    stores = spark.createDataFrame(st, "store_id long, latitude double, longitude double, is_open boolean")
    pts = [(int(i), round(float(a), 1), round(float(b), 1)) for i, (a, b) in enumerate(rng.uniform(0, 3, (40, 2)))]
    points = spark.createDataFrame(pts, "point_id long, lat double, lng double")
    want = {(p, r): s for p, a, b in pts for r, (_, s) in enumerate(sorted(
        (round((abs(a - x) + abs(b - y)) * 1e7), i) for i, x, y, o in st if o)[:4], 1)}
    for block, chunk, tile in ((4096, 4096, 1 << 20), (7, 9, 5)):
        monkeypatch.setattr(C, "CELL_DISTANCES", tile)
        got = C.nearest_stores_batch(points, stores, k=4, block_rows=block, chunk_rows=chunk).collect()
        assert {(r.point_id, r["rank"]): r.store_id for r in got} == want
    assert C.nearest_stores_batch(points, stores.filter("false"), k=4).count() == 0


def test_foreign_keys_share_one_join(spark):
    from larder.operators import quality as Q
    items = spark.createDataFrame([(1, 10)] * 500 + [(2, None), (99, 10), (99, 77), (None, 78)], "order_id long, deal_id long")
    empty = items.filter("false")
    orders = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "order_id long, slug string")
    deals = spark.createDataFrame([(10,)], "deal_id int")
    rel = [("item_order", "items", "order_id", "orders", "order_id"), ("item_deal", "items", "deal_id", "deals", "deal_id"),
           ("none_order", "empty", "order_id", "orders", "order_id")]
    got = {tuple(r) for r in Q.dq_foreign_keys({"items": items, "empty": empty}, {"orders": orders, "deals": deals}, rel).collect()}
    assert got == {("item_order", "items", 2), ("item_deal", "items", 2), ("none_order", "empty", 0)}
    numbers = spark.createDataFrame([(0.25,), (0.255,), (1e8,), (None,)], "x double")
    assert numbers.filter(Q.bad_number("x")).count() == 2
