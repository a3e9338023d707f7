"""Carts and orders as batch replays of event tables (C9, C10, D14, D16, I1,
I9, I10, I12 products, B17).

Cart semantics per (session, product), in event order:
  add q      -> present, quantity += q (starts at q when absent)
  set q      -> absent stays absent; present: q <= 0 removes, else quantity = q
  remove     -> absent
  clear / checkout (whole session) -> every product absent

Instead of folding events one by one, the final state has a closed form that
needs only aggregates: let R be the last reset (remove, non-positive set, or a
session-wide clear/checkout) and S the last positive set after R. The product
is present iff some add follows R; its quantity is S.q (when an add lies
between R and S, i.e. the set found the item present) plus the adds after
max(R, S). Both steps are a ``groupBy`` with partial aggregation; in the join
between them the adds of the heaviest (session, product) keys are dealt over
many tasks, so no hot session lands whole in one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.text import order_number, plus_minutes
from larder.operators.skew import hottest, salted_join
from larder.session import ensure_checkpoint_dir

# Pricing rules of cart and order totals.
TAX_RATE = "0.07"
FREE_DELIVERY_FROM = "35"
DELIVERY_FEE = "5.99"

#: Time slice of the two-level helpers; one (key, slice) is one window group.
BUCKET_SECONDS = 60

SESSION_RESET_OPS = ("clear", "checkout")


def _after(k: Column, bound: Column) -> Column:
    return F.when(bound.isNull(), F.lit(True)).otherwise(k > bound)


def cart_state(events: DataFrame, *, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """I1 batch form: final cart lines per ``keys`` + product_id.

    ``events``: keys..., event_ts, event_id, op, product_id, quantity.
    Returns keys..., product_id, quantity (bigint) for items still in the cart.
    """
    keys = list(keys)
    e = events.withColumn("_k", F.struct("event_ts", "event_id"))
    op, q = F.col("op"), F.col("quantity")
    sess = (e.filter(op.isin(*SESSION_RESET_OPS)).groupBy(*keys)
            .agg(F.max("_k").alias("_sr")))
    prod_reset = (op == "remove") | ((op == "set") & (q <= 0))
    per = (e.filter(op.isin("add", "set", "remove")).groupBy(*keys, "product_id")
           .agg(F.max(F.when(prod_reset, F.col("_k"))).alias("_pr"),
                F.max(F.when((op == "set") & (q > 0),
                             F.struct(F.col("_k").alias("k"), q.alias("q")))).alias("_ps"),
                F.count_if(op == "add").alias("_adds")))
    stats = (per.join(sess, keys, "left")
             .withColumn("_r", F.greatest("_pr", "_sr"))
             .withColumn("_s", F.when(_after(F.col("_ps.k"), F.col("_r")), F.col("_ps")))
             .select(*keys, "product_id", "_r", "_s"))
    adds = e.filter(op == "add").select(*keys, "product_id", "_k", "quantity")
    j = salted_join(adds, stats, [*keys, "product_id"], hottest(per, [*keys, "product_id"], "_adds"), "_k")
    k = F.col("_k")
    after_r = _after(k, F.col("_r"))
    before_s = F.col("_s").isNotNull() & (k < F.col("_s.k"))
    after_both = after_r & _after(k, F.col("_s.k"))
    agg = (j.groupBy(*keys, "product_id")
           .agg(F.max(after_r.cast("int")).alias("_present"),
                F.max((after_r & before_s).cast("int")).alias("_applied"),
                F.first("_s", ignorenulls=True).alias("_s"),
                F.sum(F.when(after_both, F.col("quantity")).otherwise(0)).alias("_tail")))
    return (agg.filter(F.col("_present") == 1)
            .select(*keys, "product_id",
                    (F.when(F.col("_applied") == 1, F.col("_s.q")).otherwise(0) + F.col("_tail"))
                    .cast("bigint").alias("quantity")))


def expiry_resets(events: DataFrame, *, ttl_seconds: int) -> DataFrame:
    """I2 batch form: a cart not written for ``ttl_seconds`` is gone; the
    first event after such a gap sees an empty cart. Emits one synthetic
    'clear' just before that event (same ts, event id - 0.5 ordering). Gaps come from
    one row per session and slice; the events themselves are not shuffled."""
    us = F.unix_micros(F.col("event_ts").cast("timestamp"))
    # inside a slice no gap passes the TTL, so gaps lie between a slice's first event and the last one before it
    width = max(1, min(BUCKET_SECONDS, ttl_seconds) * 1_000_000)
    slices = (events.groupBy("session_id", F.floor(us / F.lit(width)).alias("_b"))
              .agg(F.min(F.struct("event_ts", "event_id")).alias("_first"), F.max("event_ts").alias("_last"))
              .withColumn("_prev", F.lag("_last").over(Window.partitionBy("session_id").orderBy("_b"))))
    gap = F.unix_micros(F.col("_first.event_ts").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))
    clears = (slices.filter(gap > F.lit(ttl_seconds * 1_000_000))
              .select("session_id", F.col("_first.event_ts").alias("event_ts"),
                      (F.col("_first.event_id").cast("double") - 0.5).alias("event_id"),
                      F.lit("clear").alias("op"), F.lit(None).cast("bigint").alias("product_id"),
                      F.lit(None).cast("int").alias("quantity")))
    base = events.select("session_id", "event_ts", F.col("event_id").cast("double").alias("event_id"),
                         "op", "product_id", "quantity")
    return base.unionByName(clears)


def previous_ts(df: DataFrame, *, part: str, ts: str, tie: str, name: str = "prev_ts",
                bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Timestamp of the previous row of the same ``part`` (by ts, tie).

    Two levels, like :func:`running_count`: a lag inside each (key, time
    bucket) and, for a bucket's first row, the last timestamp of the previous
    non-empty bucket taken from the small per-bucket aggregate. No row is dropped: a null
    key is a key of its own, and rows without a time come first in their key."""
    b = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    # key and slice as one struct: it is never null itself, so rows of a null key or time meet their kind
    d = df.withColumn("_pb", F.struct(F.col(part).alias("p"), b.alias("b")))
    d = d.withColumn("_lag", F.lag(ts).over(Window.partitionBy("_pb").orderBy(ts, tie)))
    last = (d.groupBy("_pb").agg(F.max(ts).alias("_last"))
            .withColumn("_before", F.lag("_last").over(Window.partitionBy("_pb.p").orderBy("_pb.b"))))
    return (d.join(last.select("_pb", "_before"), "_pb", "inner")
            .withColumn(name, F.coalesce("_lag", "_before")).drop("_pb", "_lag", "_before"))


def cart_lines(state: DataFrame, prod: DataFrame, deals: DataFrame | None = None, *,
               as_of: datetime | None = None) -> DataFrame:
    """Cart items joined to products (unknown ids dropped); line total =
    price x quantity (deals do not discount the cart). With ``deals`` the
    first live deal of each product is attached for display (C11)."""
    lines = (state.join(prod.select("product_id", "name", "price", "sku"), "product_id", "inner")
             .withColumn("line_total", (F.col("price") * F.col("quantity")).cast("decimal(18,2)")))
    if deals is not None:
        from larder.operators.catalog import first_active_deal
        fd = first_active_deal(deals, as_of=as_of).select("product_id", F.col("deal_id").alias("active_deal_id"),
                                                          F.col("deal_type").alias("active_deal_type"))
        lines = lines.join(fd, "product_id", "left")
    return lines


def money_totals(subtotal: Column, empty: Column) -> tuple[Column, Column, Column]:
    """Tax (7 %, half-even), delivery fee (free from 35, zero for an empty
    cart) and total for a subtotal."""
    tax = F.bround(subtotal * F.lit(TAX_RATE).cast("decimal(3,2)"), 2).cast("decimal(18,2)")
    fee = (F.when(empty, F.lit(0)).when(subtotal >= F.lit(FREE_DELIVERY_FROM).cast("decimal(4,0)"), F.lit(0))
           .otherwise(F.lit(DELIVERY_FEE).cast("decimal(4,2)"))).cast("decimal(18,2)")
    return tax, fee, (subtotal + tax + fee).cast("decimal(18,2)")


def cart_totals(lines: DataFrame, state: DataFrame, sessions: DataFrame, *,
                keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Per cart: item count, subtotal, tax, fee, total. A cart with no
    stored lines gets all zeros (fee included); a cart whose lines all point
    to unknown products still pays the fee on its zero subtotal."""
    keys = list(keys)
    agg = lines.groupBy(*keys).agg(F.sum("quantity").cast("bigint").alias("item_count"),
                                   F.sum("line_total").cast("decimal(18,2)").alias("subtotal"))
    stored = state.groupBy(*keys).agg(F.count(F.lit(1)).alias("_stored"))
    t = sessions.select(*keys).distinct().join(stored, keys, "left").join(agg, keys, "left")
    empty = F.col("_stored").isNull()
    sub = F.coalesce("subtotal", F.lit(0).cast("decimal(18,2)"))
    tax, fee, total = money_totals(sub, empty)
    return t.select(*keys, F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"),
                    sub.alias("subtotal"), tax.alias("tax"), fee.alias("delivery_fee"), total.alias("total"))


def order_totals(items: DataFrame) -> DataFrame:
    """Order subtotal, tax, fee and total from its item lines."""
    agg = items.groupBy("order_id").agg(F.sum("line_total").cast("decimal(18,2)").alias("subtotal"),
                                        F.count(F.lit(1)).alias("line_count"))
    tax, fee, total = money_totals(F.col("subtotal"), F.lit(False))
    return agg.select("order_id", "line_count", "subtotal", tax.alias("tax"),
                      fee.alias("delivery_fee"), total.alias("total"))


def running_count(df: DataFrame, *, part: str, ts: str, tie: str, flag: Column,
                  bucket_seconds: int = BUCKET_SECONDS, name: str = "before", bucket: Column | None = None) -> DataFrame:
    """Count of flagged rows (or sum of a whole-number ``flag``) strictly before each row within ``part``.

    Two levels so a hot partition key is not one task: per-(key, bucket)
    counts are prefix-summed on the small aggregate, then each bucket is
    scanned on its own (window partitioned by key and bucket). Buckets are
    time slices of ``ts``, or ``bucket`` when given (any expression that is
    non-decreasing in the (ts, tie) order). No row is dropped: a null key is a key
    of its own, and rows without a time come first in their key.
    """
    b = bucket if bucket is not None else \
        F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))
    # key and bucket as one struct: it is never null itself, so rows of a null key or time meet their kind
    d = df.withColumn("_pb", F.struct(F.col(part).alias("p"), b.alias("b"))).withColumn("_f", flag.cast("bigint"))
    offs = d.groupBy("_pb").agg(F.sum("_f").alias("_n")).withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.partitionBy("_pb.p").orderBy("_pb.b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("_pb").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (d.join(offs.select("_pb", "_off"), "_pb", "inner")
            .withColumn(name, (F.col("_off") + F.coalesce(F.sum("_f").over(w), F.lit(0))).cast("bigint"))
            .drop("_pb", "_f", "_off"))


def create_order(events: DataFrame, prod: DataFrame, *, owners: DataFrame | None = None,
                 ttl_seconds: int = 24 * 3600) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every checkout turns the cart it sees into an order (status
    Pending, ETA +45 min, totals as D14) and empties the cart; a checkout on
    an empty cart, or on one not written for ``ttl_seconds`` (I2), is rejected.
    ``owners`` (session_id, user_id, store_id; one row per session) gives the orders
    their user and store.
    Returns (orders, items, rejects)."""
    events = expiry_resets(events, ttl_seconds=ttl_seconds)
    reset = F.col("op").isin(*SESSION_RESET_OPS)
    ep = running_count(events, part="session_id", ts="event_ts", tie="event_id", flag=reset, name="epoch")
    # the epoch-annotated events feed four branches: compute them once and cut
    # the lineage in the shared checkpoint folder
    ensure_checkpoint_dir(events.sparkSession)
    ep = ep.checkpoint(eager=True)
    state = cart_state(ep.filter(~reset), keys=("session_id", "epoch"))
    items = cart_lines(state, prod)
    checkouts = ep.filter(F.col("op") == "checkout").select(
        F.col("event_id").cast("bigint").alias("order_id"), "session_id", "epoch", F.col("event_ts").alias("created_at"))
    lines = items.join(checkouts, ["session_id", "epoch"], "inner")
    totals = lines.groupBy("order_id").agg(F.sum("quantity").cast("bigint").alias("item_count"),
                                            F.sum("line_total").cast("decimal(18,2)").alias("subtotal"))
    tax, fee, total = money_totals(F.col("subtotal"), F.lit(False))
    orders = (checkouts.join(totals, "order_id", "inner")
              .select("order_id", "session_id", "created_at",
                      order_number("created_at", "order_id").alias("order_number"),
                      F.lit("Pending").alias("status"), "item_count", "subtotal",
                      tax.alias("tax"), fee.alias("delivery_fee"), total.alias("total"),
                      plus_minutes("created_at", 45).alias("estimated_delivery")))
    if owners is not None:
        orders = orders.join(owners.select("session_id", "user_id", "store_id"), "session_id", "left")
    order_items = lines.select("order_id", "product_id", "quantity",
                               F.col("price").alias("unit_price"), "line_total")
    rejects = (checkouts.join(totals.select("order_id"), "order_id", "left_anti")
               .withColumn("reason", F.lit("Cannot create order from empty cart")))
    return orders, order_items, rejects


def order_status_apply(orders: DataFrame, events: DataFrame, *, as_of: datetime) -> DataFrame:
    """I10 + I13: the last status event per order wins (any transition is
    allowed); events for unknown orders are ignored; ``updated_at`` only on
    orders whose status changed."""
    last = (events.groupBy("order_id")
            .agg(F.max(F.struct("event_seq", "new_status")).alias("_l"))
            .select("order_id", F.col("_l.new_status").alias("_new")))
    j = orders.join(last, "order_id", "left")
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("status"))
    before = F.col("updated_at") if "updated_at" in orders.columns else F.lit(None).cast("timestamp")
    return (j.withColumn("updated_at", F.when(changed, F.lit(as_of)).otherwise(before))
            .withColumn("status", F.coalesce("_new", "status")).drop("_new"))


def order_with_items(orders: DataFrame, items: DataFrame, prod: DataFrame) -> DataFrame:
    """Each order with its item lines (product name joined) nested and
    sorted; one row per order, items bounded by the order size."""
    it = items.join(prod.select("product_id", F.col("name").alias("product_name")), "product_id", "left")
    nested = (it.groupBy("order_id")
              .agg(F.sort_array(F.collect_list(F.struct("product_id", "product_name", "quantity",
                                                        "line_total"))).alias("items")))
    return orders.join(nested, "order_id", "left")


def orders_of_user(orders: DataFrame, *, user_id) -> DataFrame:
    """One user's orders, newest first (page with ``paginate``, then nest the
    page's lines with :func:`order_with_items`)."""
    return orders.filter(F.col("user_id") == (user_id if isinstance(user_id, Column) else F.lit(user_id)))


def user_order_sort():
    return [F.desc("created_at"), F.desc("order_id")]


def product_upsert(target: DataFrame, changes: DataFrame, cat: DataFrame | None, *, as_of: datetime) -> DataFrame:
    """I12 (products): create / update / soft delete by product id.

    Creates get a slug (F1) and a sku (F3): the first three letters of the category's
    slug in upper case (``GEN`` where the category is null or unknown, or has no slug) and
    the next numbers after the highest existing suffix of that prefix (no count+1
    collisions), of four digits, or of as many as the prefix has already. Without
    ``cat`` a category's slug is its name in lower case.
    Updates overwrite the fields that the feed carries but keep sku and
    availability; deletes set is_available = false. The last change per id wins;
    changes for missing ids (other than creates) are ignored. All other columns
    of the target are kept, and so are slugs and ``updated_at`` of untouched
    rows (a target without a slug column gets one)."""
    from larder.functions.text import slug_api
    w = Window.partitionBy("product_id").orderBy(F.desc("change_seq"))
    last = changes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    fields = [c for c in changes.columns if c in target.columns
              and c not in ("product_id", "sku", "slug", "is_available", "created_at", "updated_at")]
    ch = last.select("product_id", "op", *[F.col(c).alias(f"_n_{c}") for c in fields])
    j = target.withColumn("_known", F.lit(True)).join(ch, "product_id", "full_outer")
    exists = F.col("_known").isNotNull()
    upd = exists & (F.col("op") == "update")
    dele = exists & (F.col("op") == "delete")
    ins = ~exists & (F.col("op") == "create")
    # next sku numbers per prefix for the inserted rows
    if cat is None:
        j = j.withColumn("_cat_slug", F.lower("_n_category"))
    else:
        j = j.join(cat.groupBy(F.col("category").alias("_n_category")).agg(F.min("slug").alias("_cat_slug")), "_n_category", "left")
    prefix = F.coalesce(F.upper(F.substring("_cat_slug", 1, 3)), F.lit("GEN"))
    max_suffix = (target.select(F.split_part("sku", F.lit("-"), F.lit(1)).alias("_prefix"),
                                F.split_part("sku", F.lit("-"), F.lit(2)).alias("_suf"))
                  .groupBy("_prefix").agg(F.max(F.col("_suf").cast("bigint")).alias("_max"), F.max(F.length("_suf")).alias("_width")))
    # numbering of the new rows per prefix: two-level running count over
    # product-id ranges, so a burst of creates in one category is not one task
    creates = running_count(j.filter(ins).withColumn("_prefix", prefix), part="_prefix", ts="product_id",
                            tie="product_id", flag=F.lit(True), name="_before",
                            bucket=F.floor(F.col("product_id") / F.lit(100_000)))
    creates = (creates.join(max_suffix, "_prefix", "left")
               .withColumn("_seq", F.col("_before") + 1)
               .withColumn("_no", (F.coalesce("_max", F.lit(0)) + F.col("_seq")).cast("string"))
              .withColumn("_new_sku", F.concat("_prefix", F.lit("-"), F.lpad("_no", F.greatest(F.lit(4), "_width", F.length("_no")), F.lit("0"))))
              .select("product_id", "_new_sku"))
    j = j.join(creates, "product_id", "left")
    pick = lambda c: F.when(upd | ins, F.col(f"_n_{c}")).otherwise(F.col(c))
    new = {c: pick(c) for c in fields}
    new["sku"] = F.when(ins, F.col("_new_sku")).otherwise(F.col("sku"))
    new["slug"] = (F.when(upd | ins, slug_api(F.col("_n_name"))).otherwise(F.col("slug")) if "slug" in target.columns
                   else slug_api(pick("name")))
    new["is_available"] = F.when(dele, F.lit(False)).when(ins, F.lit(True)).otherwise(F.col("is_available"))
    before = F.col("updated_at") if "updated_at" in target.columns else F.lit(None).cast("timestamp")
    new["updated_at"] = F.when(upd | dele | ins, F.lit(as_of)).otherwise(before)
    cols = [*target.columns, *[c for c in ("slug", "updated_at") if c not in target.columns]]
    return j.filter(exists | ins).select(*[new.get(c, F.col(c)).alias(c) for c in cols])


def cart_expiry(events: DataFrame, *, ttl_seconds: int = 24 * 3600) -> DataFrame:
    """I2 batch form: every session whose cart still holds lines after the
    replay (with in-stream expiry), its expiry time (last write + TTL; reads
    do not extend it) and whether it had expired when the event stream ends."""
    state = cart_state(expiry_resets(events, ttl_seconds=ttl_seconds))
    lines = state.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"),
                                            F.sum("quantity").cast("bigint").alias("items"))
    last = events.groupBy("session_id").agg(F.max("event_ts").alias("last_write"))
    end = events.agg(F.max("event_ts")).scalar()
    expires = F.col("last_write").cast("timestamp") + F.make_interval(secs=F.lit(ttl_seconds))
    return (lines.join(last, "session_id", "inner")
            .withColumn("expires_at", expires)
            .withColumn("expired_at_end", expires < end.cast("timestamp")))
