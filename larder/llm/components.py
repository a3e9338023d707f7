"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import skew as S


def _towards_min(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest neighbour m of u; hot u are salted."""
    least = S.write_table(least, "star")
    return S.salted_join(edges, least, ["u"], S.hottest(least, ["u"], "n"), "v")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v; long): the
    smallest node it is connected with. Each round is a few aggregates and joins;
    no neighbourhood is collected. Rounds are written tables."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = S.write_table(edges, "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _towards_min(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = S.write_table(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        near = _towards_min(large, least)
        edges = S.write_table(near.select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .unionByName(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            # every node points at the smallest node of its component
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
