"""Registered chat session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import sessions as S
from larder.plans.registry import register
from larder.sources.views import RetailModel


@register("chat_session_state", """
WITH t AS (SELECT conv_id, turn, ts_s,
  CASE WHEN lag(ts_s) OVER (PARTITION BY conv_id ORDER BY ts_s, turn) IS NULL
         OR ts_s - lag(ts_s) OVER (PARTITION BY conv_id ORDER BY ts_s, turn) > 7200 THEN 1 ELSE 0 END AS nw FROM chat_turns),
s AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY ts_s, turn ROWS UNBOUNDED PRECEDING) AS session_no FROM t)
SELECT conv_id, turn, CAST(session_no AS BIGINT) AS session_no,
  min(ts_s) OVER (PARTITION BY conv_id, session_no) AS session_start,
  max(ts_s) OVER (PARTITION BY conv_id, session_no) + 7200 AS expires_at FROM s""")
def q_chat_session_state(spark, d):
    """Gap-based chat sessions (2 h expiry refreshed by every message)."""
    t = RetailModel(spark, d).chat_turns
    return S.chat_session_state(t).select("conv_id", "turn", "session_no", "session_start", "expires_at")


@register("history_last_n", """
SELECT conv_id, turn, role, CAST(back AS INTEGER) AS back FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM chat_turns) WHERE back <= 10""")
def q_history_last_n(spark, d):
    """I4: the last 10 messages of every conversation."""
    t = RetailModel(spark, d).chat_turns
    return S.history_last_n(t, n=10).select("conv_id", "turn", "role", F.col("back").cast("int").alias("back"))


@register("session_upsert", """
WITH tg AS (SELECT 'c' || CAST(conv_id AS VARCHAR) AS session_token, ts_s AS last_message_at, CAST(1 AS BIGINT) AS message_count
  FROM chat_turns WHERE turn = 0),
m AS (SELECT 'c' || CAST(conv_id + 1 AS VARCHAR) AS session_token, ts_s FROM chat_turns WHERE turn > 0),
a AS (SELECT session_token, max(ts_s) AS last, count(*) AS n FROM m GROUP BY session_token)
SELECT coalesce(tg.session_token, a.session_token) AS session_token, greatest(tg.last_message_at, a.last) AS last_message_at,
  CAST(coalesce(tg.message_count, 0) + coalesce(a.n, 0) AS BIGINT) AS message_count, tg.message_count IS NULL AS is_new
FROM tg FULL OUTER JOIN a ON tg.session_token = a.session_token""")
def q_session_upsert(spark, d):
    """Merge later turns (keyed to the next conversation's token) into
    session rows made from first turns: updates plus inserts."""
    t = RetailModel(spark, d).chat_turns
    target = t.filter(F.col("turn") == 0).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_token"),
        F.col("ts_s").alias("last_message_at"), F.lit(1).cast("bigint").alias("message_count"))
    msgs = t.filter(F.col("turn") > 0).select(
        F.concat(F.lit("c"), (F.col("conv_id") + 1).cast("string")).alias("session_token"), "ts_s")
    return S.session_upsert(target, msgs)
