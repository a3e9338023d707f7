"""I1 + I2 as a stream on keyed map state: carts that equal the batch replay.

A session's events may arrive in any order within the lateness bound. They wait
in a map state keyed by (product, time slice); a timer per slice fires when the
watermark has passed it. Whole slices are then applied by the closed form of the
cart rules (see :mod:`larder.operators.orders`): last reset, last positive set
after it, adds behind both. That needs neither sorted events nor all events of a
session at once: frames are read one by one, slices come from the state store one
by one (twice), and memory holds a few numbers per product. Cart lines live in a
second map state, one entry per product, of which only changed ones are written.

A cart without a write for ``CART_TTL_MS`` is emptied by its own timer, at the end
of the slice in which the TTL runs out: no write within the TTL waits any more then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.streaming.jobs import CART_OUTPUT, CART_TTL_MS, with_event_time

#: State of keyed maps needs this provider.
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLICE_MS = 60_000
#: A gap over the TTL spans at least one whole stretch of this length.
STRETCH_MS = CART_TTL_MS // 2
#: Product key of events that concern the whole session.
WHOLE = -1

_EVENTS = "events array<struct<ms: bigint, id: bigint, op: string, q: bigint>>"
_FIRST = (-1 << 62, -1 << 62)


def expiry(last_write: int) -> int:
    """End of the slice in which the TTL of a cart runs out."""
    return ((last_write + CART_TTL_MS) // SLICE_MS + 1) * SLICE_MS


class Replay:
    """Closed form of one session's due events, fed in any order, in two passes."""

    def __init__(self, last_write: int | None) -> None:
        self.last_write = last_write
        self.whole = _FIRST  # last reset of the session
        self.reset: dict[int, tuple[int, int]] = {}
        self.sets: dict[int, tuple[tuple[int, int], int]] = {}
        self.stretches: dict[int, list[int]] = {}
        self.between: set[int] = set()  # an add lies between the last reset and the set
        self.seen: set[int] = set()  # an add lies behind the last reset
        self.tail: dict[int, int] = {}

    def first_pass(self, product: int, events: list[tuple]) -> None:
        for ms, event_id, op, q in events:
            at = (ms, event_id)
            s = self.stretches.setdefault(ms // STRETCH_MS, [ms, ms])
            s[0], s[1] = min(s[0], ms), max(s[1], ms)
            if op in ("clear", "checkout"):
                self.whole = max(self.whole, at)
            elif op == "remove" or (op == "set" and q <= 0):
                self.reset[product] = max(self.reset.get(product, _FIRST), at)
            elif op == "set":
                self.sets[product] = max(self.sets.get(product, (_FIRST, 0)), (at, q))

    def close_first_pass(self) -> None:
        """Gaps over the TTL empty the cart before the event that follows them."""
        before = self.last_write
        for k in sorted(self.stretches):
            lo, hi = self.stretches[k]
            if before is not None and lo - before > CART_TTL_MS:
                self.whole = max(self.whole, (lo, -1 << 62))
            before = hi
        self.last_write = before

    def _bounds(self, product: int) -> tuple[tuple[int, int], tuple[int, int] | None]:
        r = max(self.whole, self.reset.get(product, _FIRST))
        s = self.sets.get(product)
        return r, s[0] if s is not None and s[0] > r else None

    def second_pass(self, product: int, events: list[tuple]) -> None:
        r, s = self._bounds(product)
        for ms, event_id, op, q in events:
            if op == "add" and (ms, event_id) > r:
                self.seen.add(product)
                if s is None or (ms, event_id) > s:
                    self.tail[product] = self.tail.get(product, 0) + q
                else:
                    self.between.add(product)

    def quantity(self, product: int, stored: int | None) -> int | None:
        """Quantity of a product after the due events (None: not in the cart)."""
        r, s = self._bounds(product)
        if r != _FIRST:
            stored = None
        if s is not None and (stored is not None or product in self.between):
            stored = self.sets[product][1]
        if product in self.seen:
            return (stored or 0) + self.tail.get(product, 0)
        return stored


class Carts(StatefulProcessor):
    """State of a session: waiting events by (product, slice), cart lines by product, last write and serial."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "product_id bigint, slice bigint", _EVENTS)
        self.lines = handle.getMapState("lines", "product_id bigint", "quantity bigint")
        self.meta = handle.getValueState("meta", "last_write bigint, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slices = set()
        for frame in rows:  # one Arrow batch at a time
            ms = frame["event_ts"].astype("datetime64[us]").astype("int64") // 1000
            product = frame["product_id"].where(~frame["op"].isin(["clear", "checkout"]), WHOLE).fillna(WHOLE).astype("int64")
            batch = pd.DataFrame({"product": product, "slice": ms // SLICE_MS, "ms": ms, "id": frame["event_id"].astype("int64"),
                                  "op": frame["op"], "q": frame["quantity"].fillna(0).astype("int64")})
            for at, part in batch.groupby(["product", "slice"], sort=False):
                at = tuple(int(x) for x in at)
                old = [tuple(e) for e in self.waiting.getValue(at)[0]] if self.waiting.containsKey(at) else []
                new = [(int(m), int(i), op, int(q)) for m, i, op, q in part[["ms", "id", "op", "q"]].itertuples(index=False)]
                self.waiting.updateValue(at, (old + new,))
                slices.add(at[1])
        known = {int(t) for t in self.handle.listTimers()}
        for s in slices:
            if (s + 1) * SLICE_MS not in known:
                self.handle.registerTimer((s + 1) * SLICE_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last_write, seq = self.meta.get() if self.meta.exists() else (None, 0)
        due = [tuple(k) for k in self.waiting.keys() if (k[1] + 1) * SLICE_MS <= now]
        if due:
            replay = Replay(last_write)
            for step in (replay.first_pass, replay.second_pass):
                for at in due:
                    step(at[0], [tuple(e) for e in self.waiting.getValue(at)[0]])
                if step == replay.first_pass:
                    replay.close_first_pass()
            stored = {int(k[0]): int(v[0]) for k, v in self.lines.iterator()}
            for product in set(stored) | {p for p, _ in due if p != WHOLE}:
                q, old = replay.quantity(product, stored.get(product)), stored.get(product)
                if q is None and old is not None:
                    self.lines.removeKey((product,))
                elif q is not None and q != old:
                    self.lines.updateValue((product,), (q,))
            for at in due:
                self.waiting.removeKey(at)
            last_write, seq = replay.last_write, seq + 1
            self.meta.update((last_write, seq))
            if expiry(last_write) > now:
                self.handle.registerTimer(expiry(last_write))
            yield self._snapshot(key[0], seq, last_write, False)
        if last_write is not None and expiry(last_write) <= now:
            self.lines.clear()
            self.meta.update((last_write, seq + 1))
            yield self._snapshot(key[0], seq + 1, last_write, True)
            if not any(True for _ in self.waiting.keys()):
                self.meta.clear()

    def _snapshot(self, session: str, seq: int, last_write: int, expired: bool) -> pd.DataFrame:
        lines = sorted((int(k[0]), int(v[0])) for k, v in self.lines.iterator()) or [(None, 0)]
        return pd.DataFrame({"session_id": session, "snapshot_seq": seq, "product_id": pd.array([p for p, _ in lines], "Int64"),
                             "quantity": [q for _, q in lines], "expired": expired, "last_write": pd.Timestamp(last_write, unit="ms")})

    def close(self) -> None:
        pass


def cart_map_stream(events: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """Cart snapshots (``snapshot_seq`` increases per session; a single row without product
    is an empty cart) whenever the watermark passes slices that hold events, and an
    ``expired`` row when it passes the last write by the TTL. Events later than
    ``lateness`` are dropped by Spark. The session needs ``STATE_PROVIDER``."""
    ev = with_event_time(events).withWatermark("event_ts", lateness).filter(F.col("session_id").isNotNull())
    return ev.groupBy("session_id").transformWithStateInPandas(Carts(), CART_OUTPUT, "append", "EventTime")
