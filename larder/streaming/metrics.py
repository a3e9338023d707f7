"""D22 as a stream: chat counters and histograms per event-time window.

Each request falls into one bucket of each histogram; a window and intent is one
row of counts, so one stateful aggregation with partial sums before its shuffle serves
all metrics. The counters since the start are sums over the windows written so far
(:func:`metric_totals`) and equal the batch metrics once the watermark has passed.

Defined results: a null or empty text counts under the intent that the rules give it, with
embedding status ``empty``; a null latency counts in +Inf only, as in the batch histogram;
requests without a time belong to no window and are left out; requests later than
``lateness`` are dropped by Spark; no windows give zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import routing as R
from larder.operators.evaluation import LATENCY_BOUNDS
from larder.operators.vectors import token_buckets
from larder.streaming.jobs import with_event_time

# Bounds of the histogram of retrieved documents.
RETRIEVED_BOUNDS = [0.0, 1.0, 3.0, 5.0, 10.0, 20.0]


def _bucket_counts(value: Column, bounds: list[float]) -> Column:
    """Array of counts: rows whose smallest bucket is this one, +Inf last."""
    idx = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        idx = F.when(value <= F.lit(b), F.lit(i)).otherwise(idx)
    return F.array(*[F.count_if(idx == i) for i in range(len(bounds) + 1)])


def chat_metrics_stream(requests: DataFrame, *, ts: str = "ts", text: str = "text", latency: str = "latency",
                        window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Per window and intent: requests, bucket counts of latency (seconds) and of retrieved
    documents (the retrieval plan's; scenario answers retrieve none), and embedding requests by
    status. Append mode emits each window once, after the watermark passes."""
    plan = R.retrieval_plan("intent")
    r = with_event_time(requests, ts).withWatermark(ts, lateness)
    r = r.select(F.col(ts).alias("ts"), F.col(text).alias("text"), F.col(latency).alias("latency"))
    r = R.with_scenario(R.with_intent(r, "text"), "text")
    r = r.select("ts", "intent", "latency", F.size(token_buckets("text")).alias("tokens"),
                 F.when(F.coalesce("skip_rag", F.lit(False)), F.lit(0))
                 .otherwise(plan["k_products"] + plan["k_deals"] + plan["k_stores"]).alias("retrieved"))
    ok = F.col("tokens") > 0
    return (r.groupBy(F.window("ts", window).alias("w"), "intent")
            .agg(F.count(F.lit(1)).alias("requests"),
                 _bucket_counts(F.col("latency"), LATENCY_BOUNDS).alias("latency_buckets"),
                 _bucket_counts(F.col("retrieved"), RETRIEVED_BOUNDS).alias("retrieved_buckets"),
                 F.count_if(ok).alias("embed_ok"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("embed_empty"))
            .select(F.col("w.start").alias("window_start"), "intent", "requests", "latency_buckets", "retrieved_buckets",
                    "embed_ok", "embed_empty"))


def _cumulative(windows: DataFrame, buckets: str, bounds: list[float]) -> DataFrame:
    """(le, count): counts up to each bound, from one row of sums."""
    n = len(bounds) + 1
    one = windows.agg(*[F.coalesce(F.sum(F.col(buckets)[i]), F.lit(0)).cast("bigint").alias(f"b{i}") for i in range(n)])
    labels = [*(str(b) for b in bounds), "+Inf"]
    upto = [sum((F.col(f"b{j}") for j in range(i)), F.col(f"b{i}")) for i in range(n)]
    return one.select(F.explode(F.array(*[F.struct(F.lit(le).alias("le"), c.alias("count"))
                                          for le, c in zip(labels, upto, strict=True)])).alias("x")).select("x.*")


def metric_totals(windows: DataFrame) -> dict[str, DataFrame]:
    """Counters since the start from the windows of :func:`chat_metrics_stream`: ``intents`` (intent,
    requests), ``latency`` and ``retrieved`` (le, count; cumulative), ``embed_status`` (status, requests)."""
    status = windows.agg(F.sum("embed_ok").alias("ok"), F.sum("embed_empty").alias("empty")).select(F.explode(F.array(
        *[F.struct(F.lit(c).alias("status"), F.col(c).alias("requests")) for c in ("ok", "empty")])).alias("x")).select("x.*")
    return {"intents": windows.groupBy("intent").agg(F.sum("requests").alias("requests")),
            "latency": _cumulative(windows, "latency_buckets", LATENCY_BOUNDS),
            "retrieved": _cumulative(windows, "retrieved_buckets", RETRIEVED_BOUNDS),
            "embed_status": status.filter("requests > 0")}
