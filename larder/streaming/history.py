"""I3 + I4 as a stream: the stored history of each chat session on list state.

Messages may arrive in any order within the lateness bound. They wait in a map
state by time slice; when the watermark passes a slice its messages are appended
in order of (time, turn). Appending refreshes the session's expiry, the last
``HISTORY_KEEP`` messages stay, and the prompt gets the last ``HISTORY_TO_PROMPT``
of them. A message more than the TTL behind its predecessor, or of an unknown
conversation, opens a new session with an empty history; a timer removes all state
of a session when the watermark passes its expiry.

A task holds one slice and one kept history of a conversation at a time. A message
without conversation or time belongs to no session and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.operators.sessions import HISTORY_KEEP, HISTORY_TO_PROMPT, SESSION_TTL_SECONDS

SLICE_MS = 60_000
TTL_MS = SESSION_TTL_SECONDS * 1000

_MESSAGE = "turn: int, role: string, content: string"
HISTORY_OUTPUT = f"conv_id bigint, turn int, ts timestamp, opened boolean, stored int, history array<struct<{_MESSAGE}>>"


def _or_none(v):
    return None if pd.isna(v) else v


class History(StatefulProcessor):
    """State of a conversation: waiting messages by slice, the kept messages, the time of the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice bigint", f"messages array<struct<ms: bigint, {_MESSAGE}>>")
        self.kept = handle.getListState("kept", _MESSAGE.replace(":", ""))
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slices = set()
        for frame in rows:  # one Arrow batch at a time
            frame = frame.assign(ms=frame["ts"].astype("datetime64[us]").astype("int64") // 1000)
            for s, part in frame.groupby(frame["ms"] // SLICE_MS, sort=False):
                at = (int(s),)
                old = [tuple(m) for m in self.waiting.getValue(at)[0]] if self.waiting.containsKey(at) else []
                new = [(int(ms), int(t), _or_none(r), _or_none(c)) for ms, t, r, c in part[["ms", "turn", "role", "content"]].itertuples(index=False)]
                self.waiting.updateValue(at, (old + new,))
                slices.add(int(s))
        known = {int(t) for t in self.handle.listTimers()}
        for s in slices:
            if (s + 1) * SLICE_MS not in known:
                self.handle.registerTimer((s + 1) * SLICE_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted(int(k[0]) for k in self.waiting.keys() if (int(k[0]) + 1) * SLICE_MS <= now)
        last = self.last.get()[0] if self.last.exists() else None
        if due:
            kept = [tuple(m) for m in self.kept.get()] if self.kept.exists() else []
            for s in due:
                out = []
                for ms, turn, role, content in sorted((tuple(m) for m in self.waiting.getValue((s,))[0]), key=lambda m: m[:2]):
                    opened = last is None or ms - last > TTL_MS
                    kept = ([] if opened else kept)[-(HISTORY_KEEP - 1):] + [(turn, role, content)]
                    last = ms
                    prompt = [dict(zip(("turn", "role", "content"), m, strict=True)) for m in kept[-HISTORY_TO_PROMPT:]]
                    out.append((int(key[0]), turn, pd.Timestamp(ms, unit="ms"), opened, len(kept), prompt))
                self.waiting.removeKey((s,))
                yield pd.DataFrame(out, columns=["conv_id", "turn", "ts", "opened", "stored", "history"])
            self.kept.put(kept)
            self.last.update((last,))
            if last + TTL_MS + 1 > now:
                self.handle.registerTimer(last + TTL_MS + 1)
        if last is not None and last + TTL_MS < now and not any(True for _ in self.waiting.keys()):
            self.kept.clear()
            self.last.clear()

    def close(self) -> None:
        pass


def chat_history_stream(messages: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """One row per stored message (conv_id, turn, ts, role, content), when the watermark passes
    its slice: whether it ``opened`` a session, how many messages are ``stored`` and the prompt's
    ``history``, this message included. Messages later than ``lateness`` are dropped by Spark.
    The session needs ``carts.STATE_PROVIDER``."""
    m = (messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("turn").cast("int"), F.lit(0)).alias("turn"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("role").cast("string").alias("role"), F.col("content").cast("string").alias("content"))
         .withWatermark("ts", lateness).filter(F.col("conv_id").isNotNull() & F.col("ts").isNotNull()))
    return m.groupBy("conv_id").transformWithStateInPandas(History(), HISTORY_OUTPUT, "append", "EventTime")
