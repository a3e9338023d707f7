"""Evaluation jobs: latency percentiles, retrieval quality, golden answers,
response scoring, prompt-variant comparison and chat metrics (D17-D22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Evaluation gates and scoring weights.
PRECISION_GATE = 0.7
CATEGORY_GATE = 0.8
DEAL_WORDS = ["bogo", "deal", "off", "save", "% off"]
CONCISE_BELOW = 1000
LATENCY_BOUNDS = [0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 30.0]


def select_ranks(df: DataFrame, *, key: str, value: str, ranks: DataFrame, buckets_per_octave: int = 256) -> DataFrame:
    """Exact k-th smallest ``value`` per ``key`` for the 1-based ``pos`` rows of
    ``ranks`` (key, tag, pos), without sorting a whole key in one task.

    Pass 1 histograms values into monotone log buckets (partial aggregation,
    tiny output); the bucket holding each wanted rank is found from the
    cumulative counts; pass 2 ranks only the rows of those buckets.
    """
    v = F.col("_v")
    bucket = (F.signum(v) * F.floor(F.log2(F.abs(v) + 1.0) * buckets_per_octave)).cast("long")
    # equal values are counted first, so a value that most rows share is one row
    d = (df.select(key, F.col(value).cast("double").alias("_v")).groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_c"))
         .withColumn("_b", bucket))
    hist = d.groupBy(key, "_b").agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_cum", F.sum("_n").over(w)).withColumn("_before", F.col("_cum") - F.col("_n"))
    target = (ranks.join(cum, key, "inner")
              .filter((F.col("_before") < F.col("pos")) & (F.col("pos") <= F.col("_cum")))
              .select(key, "tag", "_b", (F.col("pos") - F.col("_before")).alias("_off")))
    rows = d.join(target.select(key, "_b").distinct(), [key, "_b"], "inner")
    rw = Window.partitionBy(key, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_r", F.sum("_c").over(rw))
    return (target.join(ranked, [key, "_b"], "inner")
            .filter((F.col("_r") - F.col("_c") < F.col("_off")) & (F.col("_off") <= F.col("_r")))
            .select(key, "tag", F.col("_v").alias("value")))


def latency_percentiles(timings: DataFrame, *, key: str = "stage", value: str = "latency_ms",
                        qs: tuple[float, ...] = (0.95, 0.99), threshold_ms: float = 30000.0) -> DataFrame:
    """Per stage n, mean, p50 (median, mean of the middle pair for even
    n) and p_q = element at 0-based index int(n*q) of the sorted list (n=10 ->
    the max for q=0.95); ``passed`` = p95 < threshold."""
    stats = timings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    n = F.col("n")
    wanted = [stats.select(key, F.lit("lo").alias("tag"), F.floor((n + 1) / 2).cast("long").alias("pos")),
              stats.select(key, F.lit("hi").alias("tag"), F.floor(n / 2 + 1).cast("long").alias("pos"))]
    for q in qs:
        wanted.append(stats.select(key, F.lit(f"p{int(round(q * 100))}").alias("tag"),
                                   (F.floor(n.cast("double") * F.lit(q)) + 1).cast("long").alias("pos")))
    ranks = wanted[0]
    for w in wanted[1:]:
        ranks = ranks.unionByName(w)
    picked = select_ranks(timings, key=key, value=value, ranks=ranks)
    tags = ["lo", "hi"] + [f"p{int(round(q * 100))}" for q in qs]
    piv = picked.groupBy(key).pivot("tag", tags).agg(F.first("value"))
    out = stats.join(piv, key, "inner").withColumn("p50", (F.col("lo") + F.col("hi")) / 2).drop("lo", "hi")
    return out.withColumn("passed", F.col("p95") < F.lit(threshold_ms))


def retrieval_quality(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case precision (share of hits in the expected category),
    category hit, sku-prefix hit and PASS/FAIL; averages over all cases
    (a case without hits counts 0 and stays in n); gates 0.7 / 0.8."""
    h = hits.select("query_id", "hit_category", "sku", F.lit(1).alias("_hit"))
    j = cases.join(h, "query_id", "left")
    same = F.col("hit_category") == F.col("expected_category")
    per = (j.groupBy("query_id", "expected_category", "expected_prefix")
           .agg(F.avg(F.when(same, 1.0).otherwise(0.0)).alias("precision"),
                F.coalesce(F.max(same), F.lit(False)).alias("category_hit"),
                F.coalesce(F.max(F.col("sku").startswith(F.col("expected_prefix"))), F.lit(False)).alias("sku_hit"),
                F.count("_hit").alias("retrieved_count")))
    per = per.withColumn("precision", F.coalesce("precision", F.lit(0.0)))
    per = per.withColumn("status", F.when(F.col("category_hit") & F.col("sku_hit"), "PASS").otherwise("FAIL"))
    avg_p = per.agg(F.avg("precision")).scalar()
    acc = per.agg(F.avg(F.when(F.col("category_hit"), 1.0).otherwise(0.0))).scalar()
    return (per.withColumn("avg_precision", avg_p).withColumn("category_accuracy", acc)
            .withColumn("gates_pass", (avg_p >= F.lit(PRECISION_GATE)) & (acc >= F.lit(CATEGORY_GATE))))


def golden_regression(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """An answer passes when it contains every must_contain keyword and
    none of must_not_contain (lower-case substring)."""
    j = answers.join(cases, "case_id", "inner")
    r = F.lower("response")
    missing = F.filter("must_contain", lambda kw: ~r.contains(F.lower(kw)))
    unwanted = F.filter("must_not_contain", lambda kw: r.contains(F.lower(kw)))
    return (j.withColumn("missing", missing).withColumn("unwanted", unwanted)
            .withColumn("passed", (F.size("missing") == 0) & (F.size("unwanted") == 0)))


def response_score(answers: DataFrame) -> DataFrame:
    """Keyword share (empty list -> 1.0), price / deal mention, concise
    (< 1000 chars), product mention; composite = .4 kw + .2 price + .15 deal
    + .1 concise + .15 products."""
    text = F.col("response")
    low = F.lower(text)
    hits = F.size(F.filter("expected_keywords", lambda kw: low.contains(F.lower(kw))))
    n = F.size("expected_keywords")
    kw = F.when(n > 0, hits.cast("double") / n.cast("double")).otherwise(F.lit(1.0))
    has_price = text.contains("$")
    has_deal = F.lit(False)
    for w in DEAL_WORDS:
        has_deal = has_deal | low.contains(w)
    concise = F.length(text) < CONCISE_BELOW
    has_products = (F.length(text) - F.length(F.replace(text, F.lit("$"), F.lit("")))) >= 1

    def b(c: Column) -> Column:
        return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    composite = kw * 0.4 + b(has_price) * 0.2 + b(has_deal) * 0.15 + b(concise) * 0.1 + b(has_products) * 0.15
    return answers.select("*", kw.alias("keyword_score"), has_price.alias("has_price"), has_deal.alias("has_deal"),
                          concise.alias("is_concise"), has_products.alias("has_products"),
                          F.length(text).alias("response_length"), composite.alias("composite_score"))


def variant_comparison(scored: DataFrame) -> DataFrame:
    """Per variant averages; the winner has the highest average
    composite, must be above 0, and the first variant (by order) wins ties."""
    per = (scored.groupBy("variant", "variant_order")
           .agg(F.avg("composite_score").alias("avg_composite"), F.avg("keyword_score").alias("avg_keyword"),
                F.avg(F.when(F.col("has_price"), 1.0).otherwise(0.0)).alias("price_mention_rate"),
                F.avg(F.when(F.col("has_deal"), 1.0).otherwise(0.0)).alias("deal_mention_rate")))
    best = per.agg(F.max("avg_composite")).scalar()
    first = per.filter(F.col("avg_composite") == best).agg(F.min("variant_order")).scalar()
    return per.withColumn("is_winner", (F.col("variant_order") == first) & (best > 0))


def latency_histogram(df: DataFrame, *, value: str, bounds: list[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative ``le`` buckets (+Inf last): each row is counted once in
    its smallest bucket, then buckets are prefix-summed (8 rows)."""
    v = F.col(value)
    idx = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        idx = F.when(v <= F.lit(b), F.lit(i)).otherwise(idx)
    per = df.select(idx.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    labels = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    allb = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bucket"))
    j = allb.join(per, "bucket", "left").fillna(0, ["_n"])
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # over 8 rows
    return j.select(F.element_at(labels, F.col("bucket") + 1).alias("le"),
                    F.sum("_n").over(w).cast("bigint").alias("count"))
