"""Mixing to target weights with soft domain membership (DataFrame functions only).

A multinomial naive Bayes classifier over hashed words, counted on a bounded
sample of the labelled table, gives each document posteriors over the domains.
Document rates r >= 0 are then fitted so that the expected token totals of the
domains, sum_i r_i * tokens_i * posterior_ik, match the targets: projected
gradient steps on the sum of squared gaps, each weighted by the inverse of its
domain's unmixed total, in the metric of the tokens, where a document's step
depends on its posteriors alone:

    r <- max(0, r - sum_k posterior_k * (total_k - target_k) / unmixed_k)

Each step is one aggregate over the posteriors of all documents, as they are
(nothing is rounded or grouped), so the totals that meet the targets are those
of the posteriors in the result.
Rates are a fold over the list of residual vectors, so no state is kept
between steps and a lost executor costs only the step at hand.

Defined results: null and empty texts have no tokens, the prior as posterior
and a rate like any other; null domains and labels of unknown documents are
ignored; a document labelled twice takes its smallest domain; repeated rows
give repeated rows; targets of domains without labelled tokens are left out
and the rest scaled to one; without any usable domain every rate is 1; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import skew as S

BUCKETS = 4096
MAX_LABELLED = 8000  # bound of the labelled sample
EFFECTIVE_WORDS = 25  # a longer text counts as so many words of its mean log-likelihood
MAX_STEPS, TOLERANCE = 200, 1e-6


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word (``bucket``; null for a document without any)."""
    flat = functools.reduce(lambda c, ws: F.replace(c, F.lit(ws), F.lit(" ")), "\n\t\r\x0b\x0c", F.coalesce(F.col("text").cast("string"), F.lit("")))
    w = docs.select(*keep, F.explode(F.split(flat, " ")).alias("w"))
    return w.select(*keep, F.when(F.col("w") != "", F.pmod(F.xxhash64("w"), F.lit(BUCKETS))).cast("int").alias("bucket"))


def train(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[list[str], list[float], DataFrame | None]:
    """Domains, their log priors, and the table bucket -> lp (log-probabilities by domain)."""
    lab = (labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain")).dropna()
           .groupBy("doc_id").agg(F.min("domain").alias("domain")))
    n = lab.count()
    if not n:
        return [], [], None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 20)) / float(1 << 20)
    sample = F.broadcast(lab.filter(draw < max_labelled / n))  # bounded by max_labelled
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    counts = S.write_table(_words(src, "domain").filter("bucket is not null").groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")),
                           "word-counts")  # at most domains x BUCKETS rows
    totals = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    domains = sorted(totals)
    if not domains:
        return [], [], None
    all_n = sum(totals.values())
    logs = [F.log((F.coalesce(F.sum(F.when(F.col("domain") == k, F.col("n"))), F.lit(0)) + 0.5) / float(totals[k] + 0.5 * BUCKETS)) for k in domains]
    spark = docs.sparkSession
    lp = (spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
          .groupBy("bucket").agg(*[c.alias(f"lp{i}") for i, c in enumerate(logs)]))
    return domains, [math.log(totals[k] / all_n) for k in domains], S.write_table(lp, "word-weights")


def posteriors(docs: DataFrame, domains: list[str], priors: list[float], lp: DataFrame | None) -> DataFrame:
    """doc_id, n_tokens and p0 .. pK (posteriors), a row per input row."""
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = _words(src, "rid", "doc_id")
    ks = range(len(domains))
    if lp is not None:
        words = words.join(F.broadcast(lp), "bucket", "left")  # BUCKETS rows
    sums = (words.groupBy("rid", "doc_id").agg(F.count("bucket").alias("n_tokens"), *[F.coalesce(F.sum(f"lp{i}"), F.lit(0.0)).alias(f"s{i}") for i in ks]))
    scale = F.least(F.lit(1.0), F.lit(float(EFFECTIVE_WORDS)) / F.greatest("n_tokens", F.lit(1)))
    logit = [F.lit(priors[i]) + F.col(f"s{i}") * scale for i in ks]
    sums = sums.select("doc_id", "n_tokens", *[c.alias(f"z{i}") for i, c in enumerate(logit)])
    if not domains:
        return sums
    top = F.greatest(*[F.col(f"z{i}") for i in ks]) if len(domains) > 1 else F.col("z0")
    e = [F.exp(F.col(f"z{i}") - top) for i in ks]
    sums = sums.select("doc_id", "n_tokens", *[c.alias(f"e{i}") for i, c in enumerate(e)])
    total = sum((F.col(f"e{i}") for i in ks[1:]), F.col("e0"))
    return sums.select("doc_id", "n_tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in ks])


def _rate(n_domains: int, residuals: list[list[float]]) -> Column:
    """The projected gradient steps folded over the residual vectors, from rate 1."""
    if not residuals:
        return F.lit(1.0)
    p = [F.col(f"p{i}") for i in range(n_domains)]
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in residuals])
    return F.aggregate(steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - functools.reduce(
        lambda a, i: a + p[i] * g[i], range(1, n_domains), p[0] * g[0])))


def fit(post: DataFrame, n_domains: int, target: list[float], max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> tuple[list[list[float]], float]:
    """Scaled residual vectors of the steps taken, and the largest gap to a target that is left."""
    p = [F.col(f"p{i}") for i in range(n_domains)]
    total = post.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not total:
        return [], max(target, default=0.0)
    share = F.col("n_tokens") / float(total)
    # gaps count relative to the expected totals at rate 1; then the rows of the
    # Hessian sum to one, which bounds its norm, and a step of 1 is safe
    base = post.agg(*[F.sum(share * c) for c in p]).first()
    residuals: list[list[float]] = []
    while True:
        r = post.withColumn("r", _rate(n_domains, residuals))
        now = r.agg(*[F.sum(share * F.col("r") * c) for c in p]).first()
        gap = [a - b for a, b in zip(now, target, strict=True)]
        left = max(map(abs, gap))
        if left <= tolerance or len(residuals) >= max_steps:
            return residuals, left
        residuals.append([g / b if b else 0.0 for g, b in zip(gap, base, strict=True)])


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0,
        max_labelled: int = MAX_LABELLED, max_steps: int = MAX_STEPS) -> DataFrame:
    """doc_id, n_tokens, rate, domain (most probable), posterior (in the order of
    the sorted domains) and max_gap, the largest gap to a target that the fit left, in units
    of the corpus (null without targets); one above TOLERANCE is also warned of. ``targets`` are weights of the expected token totals;
    ``budget`` is the wanted total in units of the corpus."""
    domains, priors, lp = train(docs, labelled, max_labelled)
    weight = [max(0.0, float(targets.get(k, 0.0))) for k in domains]
    if not sum(weight):
        return posteriors(docs, [], [], None).select("doc_id", "n_tokens", F.lit(1.0).alias("rate"), F.lit(None).cast("string").alias("domain"),
                                                     F.lit(None).cast("array<double>").alias("posterior"), F.lit(None).cast("double").alias("max_gap"))
    post = S.write_table(posteriors(docs, domains, priors, lp), "posteriors")
    residuals, gap = fit(post, len(domains), [budget * w / sum(weight) for w in weight], max_steps)
    if gap > TOLERANCE:
        warnings.warn(f"mixing: {len(residuals)} steps left a gap of {gap:.3g} of the corpus to the targets", RuntimeWarning, stacklevel=2)
    p = [F.col(f"p{i}") for i in range(len(domains))]
    best = F.array_position(F.array(*p), F.greatest(*p) if len(p) > 1 else p[0])
    return post.select("doc_id", "n_tokens", _rate(len(domains), residuals).alias("rate"),
                       F.element_at(F.array(*[F.lit(k) for k in domains]), best.cast("int")).alias("domain"),
                       F.array(*p).alias("posterior"), F.lit(gap).alias("max_gap"))


#: token weights of the registered query and of the pipeline
TARGETS = {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}


def language_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the documents in the label table: their language."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("domain")).join(ids, "doc_id")
