"""I9 as a stream: checkouts become orders, order lines and rejects.

One stateful processor per session. Events wait in a map state by (slice of a
minute, product) until the watermark has passed their slice; due slices are then
applied in time order, product by product, so neither a session's events nor the
waiting rows of several products are held together. A checkout takes the cart
that it sees and empties it. A cart that was not written for the TTL is empty
for the event that follows the gap, as in the batch form
(:func:`larder.operators.orders.create_order`), whose rows the stream equals.

The processor emits tagged rows (``kind``: order, line, reject). Prices come with
the events by a stream-static join, so a line is priced as at its product's last
change; totals are column expressions shared with the batch form. One sink write
per micro-batch keeps the tags as partitions, and a repeated batch replaces its own folder.

Defined results: a checkout without a session is rejected like one of an empty
cart; a checkout without a time has no place in the order of events and is
rejected with a reason of its own, other events without a time have no effect;
products unknown to ``prod`` never reach an order; a ``set`` without a quantity
changes nothing, an ``add`` without one adds zero; events of one time are ordered by
event_id. Events later than ``lateness`` are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.functions.text import order_number, plus_minutes
from larder.operators.orders import SESSION_RESET_OPS, money_totals
from larder.streaming.carts import SLICE_MS, WHOLE
from larder.streaming.jobs import CART_TTL_MS, with_event_time

SLICE_US = SLICE_MS * 1000
EMPTY_CART = "Cannot create order from empty cart"
NO_TIME = "Checkout without a time"

_EVENTS = "events array<struct<us: bigint, id: bigint, op: string, q: bigint, cents: bigint>>"
_TAGGED = "kind string, order_id bigint, session_id string, us bigint, product_id bigint, quantity bigint, cents bigint, amount bigint"
_TAGGED_NAMES = [f.split()[0] for f in _TAGGED.split(", ")]


class Checkouts(StatefulProcessor):
    """State of a session: waiting events by (slice, product), cart lines by product, time of the last write."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice bigint, product_id bigint", _EVENTS)
        self.lines = handle.getMapState("lines", "product_id bigint", "quantity bigint, cents bigint")
        self.written = handle.getValueState("written", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {int(t) for t in self.handle.listTimers()}
        for frame in rows:  # one Arrow batch at a time
            for at, part in frame.groupby(["slice", "product_id"], sort=False):
                at = tuple(int(x) for x in at)
                new = [(int(us), int(i), op, int(q), None if pd.isna(c) else int(c))
                       for us, i, op, q, c in part[["us", "event_id", "op", "quantity", "cents"]].itertuples(index=False)]
                self.waiting.updateValue(at, (self._events(at) + new,))
                due = (at[0] + 1) * SLICE_MS
                if due not in known:
                    self.handle.registerTimer(due)
                    known.add(due)
        yield from ()

    def _events(self, at: tuple[int, int]) -> list[tuple]:
        return [tuple(e) for e in self.waiting.getValue(at)[0]] if self.waiting.containsKey(at) else []

    def _forget_at(self, last: int) -> int:
        """End (ms) of the slice in which the TTL of a cart runs out: no event within the TTL waits behind it."""
        return ((last + self.ttl_us) // SLICE_US + 1) * SLICE_MS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = int(self.written.get()[0]) if self.written.exists() else None
        due = sorted(tuple(int(x) for x in k) for k in self.waiting.keys() if (k[0] + 1) * SLICE_MS <= now)
        for s, keys in groupby(due, key=lambda k: k[0]):
            last, out = self._apply(s, [p for _, p in keys], last)
            if out:
                rows = pd.DataFrame([(kind, i, key[0], us, *rest) for kind, i, us, *rest in out], columns=_TAGGED_NAMES)
                yield rows.astype({c: "Int64" for c in ("product_id", "quantity", "cents", "amount")})
        if due:
            self.written.update((last,))
            if self._forget_at(last) > now:
                self.handle.registerTimer(self._forget_at(last))
        if last is not None and self._forget_at(last) <= now:
            self.lines.clear()
            self.written.clear()

    def _apply(self, s: int, products: list[int], last: int | None) -> tuple[int, list[tuple]]:
        """Apply the events of slice ``s``; (time of the last write, tagged rows)."""
        if last is not None and (s + 1) * SLICE_US - last > self.ttl_us:  # the gap may pass the TTL
            if min(e[0] for p in products for e in self._events((s, p))) - last > self.ttl_us:
                self.lines.clear()
        whole = sorted(self._events((s, WHOLE)))
        resets = [e for e in whole if e[2] in SESSION_RESET_OPS]
        last = max([last or 0, *(e[0] for e in whole)])
        carts: dict[int, list[tuple[int, int, int | None]]] = {e[1]: [] for e in resets if e[2] == "checkout"}
        stored = [int(k[0]) for k in self.lines.keys()] if resets else []
        for p in sorted({*products, *stored} - {WHOLE}):
            line = tuple(self.lines.getValue((p,))) if self.lines.containsKey((p,)) else None
            before = line
            own = self._events((s, p))
            for us, i, op, q, cents in sorted(own + resets, key=lambda e: e[:2]):
                if op == "add":
                    line = ((line[0] if line else 0) + q, cents)
                elif op == "set" and line:
                    line = (q, cents) if q > 0 else None
                elif op == "remove":
                    line = None
                elif op in SESSION_RESET_OPS:
                    if op == "checkout" and line:
                        carts[i].append((p, *line))
                    line = None
            last = max([last, *(e[0] for e in own)])
            if line is None and before is not None:
                self.lines.removeKey((p,))
            elif line != before:
                self.lines.updateValue((p,), line)
        for p in products:
            self.waiting.removeKey((s, p))
        out: list[tuple] = []
        for us, i, op, *_ in resets:
            if op != "checkout":
                continue
            lines = [(p, q, c, None if c is None else q * c) for p, q, c in carts[i]]
            if not lines:
                out.append(("reject", i, us, None, None, None, None))
                continue
            amounts = [a for *_, a in lines if a is not None]
            out.append(("order", i, us, None, sum(x[1] for x in lines), None, sum(amounts) if amounts else None))
            out += [("line", i, us, *x) for x in lines]
        return last, out

    def close(self) -> None:
        pass


def _money(cents):
    return (cents.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)")


def checkout_stream(events: DataFrame, prod: DataFrame, *, ttl_seconds: int = CART_TTL_MS // 1000,
                    lateness: str = "1 hour") -> DataFrame:
    """Tagged rows (``kind``: order, line, reject) of a stream of cart events; see
    :func:`read_checkouts` for the three tables. ``prod`` (product_id, price; one row
    per product, prices of at most two decimals) is a static table. The session needs
    :data:`larder.streaming.carts.STATE_PROVIDER`."""
    price = prod.schema["price"].dataType
    if not isinstance(price, T.DecimalType) or price.scale > 2:
        raise ValueError("price must be a decimal of at most two decimals")
    ev = with_event_time(events).withWatermark("event_ts", lateness).select(
        "event_id", "session_id", "event_ts", "op", F.col("product_id").cast("bigint").alias("product_id"),
        F.col("quantity").cast("bigint").alias("quantity"))
    placed = F.col("session_id").isNotNull() & F.col("event_ts").isNotNull()
    priced = ev.filter(placed).join(prod.select(F.col("product_id").cast("bigint").alias("product_id"), F.lit(True).alias("known"),
                                                (F.col("price") * 100).cast("bigint").alias("cents")), "product_id", "left")
    whole = F.col("op").isin(*SESSION_RESET_OPS)
    effect = F.col("known").isNotNull() & (F.col("op").isin("add", "remove") | ((F.col("op") == "set") & F.col("quantity").isNotNull()))
    us = F.unix_micros("event_ts")
    # events without effect still count as writes of the cart
    rows = priced.select(
        "session_id", "event_ts", "event_id", us.alias("us"), F.floor(us / F.lit(SLICE_US)).alias("slice"),
        F.when(effect & ~whole, F.col("product_id")).otherwise(F.lit(WHOLE)).alias("product_id"),
        F.when(whole | effect, F.col("op")).otherwise(F.lit("touch")).alias("op"),
        F.coalesce("quantity", F.lit(0)).alias("quantity"), "cents")
    tagged = rows.groupBy("session_id").transformWithStateInPandas(Checkouts(ttl_seconds * 1_000_000), _TAGGED, "append", "EventTime")
    lost = ev.filter(~placed & (F.col("op") == "checkout")).select(
        F.lit("reject").alias("kind"), F.col("event_id").cast("bigint").alias("order_id"), "session_id", us.alias("us"),
        *[F.lit(None).cast("bigint").alias(c) for c in _TAGGED_NAMES[4:]])
    out = tagged.unionByName(lost).withColumn("created_at", F.timestamp_micros("us"))
    order, line, reject = (F.col("kind") == k for k in ("order", "line", "reject"))
    subtotal = F.when(order, _money(F.col("amount")))
    tax, fee, total = money_totals(subtotal, F.lit(False))
    return out.select(
        "kind", "order_id", "session_id", "created_at",
        F.when(order, order_number("created_at", "order_id")).alias("order_number"),
        F.when(order, F.lit("Pending")).alias("status"), F.when(order, F.col("quantity")).alias("item_count"),
        subtotal.alias("subtotal"), F.when(order, tax).alias("tax"), F.when(order, fee).alias("delivery_fee"),
        F.when(order, total).alias("total"), F.when(order, plus_minutes("created_at", 45)).alias("estimated_delivery"),
        "product_id", F.when(line, F.col("quantity")).alias("quantity"), _money(F.col("cents")).alias("unit_price"),
        F.when(line, _money(F.col("amount"))).alias("line_total"),
        F.when(reject, F.when(F.col("us").isNull(), F.lit(NO_TIME)).otherwise(F.lit(EMPTY_CART))).alias("reason"))


def checkout_writer(path: str):
    """``foreachBatch`` sink: the tagged rows of a micro-batch in one write, tags as partitions.
    A repeated batch replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")
    return write


def read_checkouts(spark: SparkSession, path: str, schema: T.StructType, *,
                   owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, items, rejects) as of :func:`larder.operators.orders.create_order` from the folder of
    :func:`checkout_writer`; ``schema`` is that of the stream. Each table reads its own partitions."""
    # files hold the data columns; the folder names give batch and kind
    data = T.StructType([f for f in schema.fields if f.name != "kind"]).add("batch", T.LongType()).add("kind", T.StringType())
    rows = spark.read.schema(data).parquet(path)
    orders = rows.filter("kind = 'order'").select(
        "order_id", "session_id", "created_at", "order_number", "status", "item_count", "subtotal", "tax",
        "delivery_fee", "total", "estimated_delivery")
    if owners is not None:
        orders = orders.join(owners.select("session_id", "user_id", "store_id"), "session_id", "left")
    items = rows.filter("kind = 'line'").select("order_id", "product_id", "quantity", "unit_price", "line_total")
    rejects = rows.filter("kind = 'reject'").select("order_id", "session_id", "created_at", "reason")
    return orders, items, rejects
