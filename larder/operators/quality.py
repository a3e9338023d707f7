"""Data-quality rules over the retail model (K1-K4): each returns
(rule, table_name, violations). Row-level rules of one table are evaluated
in a single aggregate scan and unpivoted; uniqueness needs one grouped
aggregate per key; all foreign keys share one anti join over counted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed enum values and column length limits.
DEAL_TYPES = ["BOGO", "WeeklyDeal", "DailyDeal"]
ORDER_STATUSES = ["Pending", "Confirmed", "Preparing", "Delivering", "Delivered", "Cancelled"]
CHAT_MESSAGE_CHARS = (1, 2000)


def row_rules(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Count violating rows for every rule in one pass over ``df``."""
    agg = df.agg(*[F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(name) for name, cond in rules.items()])
    return (agg.unpivot([], list(rules), "rule", "violations")
            .select("rule", F.lit(table).alias("table_name"), F.coalesce("violations", F.lit(0)).alias("violations")))


def dq_unique(df: DataFrame, table: str, key: str | Column, rule: str) -> DataFrame:
    """K1: number of key values held by more than one row (nulls ignored)."""
    k = F.col(key) if isinstance(key, str) else key
    dup = df.select(k.alias("_k")).filter(F.col("_k").isNotNull()).groupBy("_k").count().filter("count > 1")
    return dup.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), "violations")


def _orphans(children: dict[str, DataFrame], parents: dict[str, DataFrame],
             relations: list[tuple[str, str, str, str, str]], kind: str) -> DataFrame:
    """(rule, n) of the relations, whose keys are compared as ``kind``."""
    facts = refs = None
    parent = {k: i for i, k in enumerate(dict.fromkeys((p, pk) for _, _, _, p, pk in relations))}
    for table in dict.fromkeys(c for _, c, _, _, _ in relations):
        keys = [F.struct(F.lit(r).alias("rule"), F.lit(parent[p, pk]).alias("p"), F.col(fk).cast(kind).alias("k"))
                for r, c, fk, p, pk in relations if c == table]
        n = (children[table].select(F.explode(F.array(*keys)).alias("_k")).select("_k.*").filter(F.col("k").isNotNull())
             .groupBy("rule", "p", "k").agg(F.count(F.lit(1)).alias("n")))
        facts = n if facts is None else facts.unionByName(n)
    for (table, pk), i in parent.items():  # a parent's keys move once, however many relations name it
        ref = parents[table].select(F.lit(i).alias("p"), F.col(pk).cast(kind).alias("k"))
        refs = ref if refs is None else refs.unionByName(ref)
    return facts.join(refs, ["p", "k"], "left_anti").groupBy("rule").agg(F.sum("n").alias("n"))


def dq_foreign_keys(children: dict[str, DataFrame], parents: dict[str, DataFrame],
                    relations: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """K2: child rows whose non-null key has no parent row, per relation
    (rule, child table, fk, parent table, pk).

    A child's keys are counted per (rule, key) in one read, which also takes the
    weight off hot keys, and relations share one join: one for whole-number keys
    and one for the others, compared as text."""
    whole = [r for r in relations if isinstance(children[r[1]].schema[r[2]].dataType, T.IntegralType)]
    parts = [(whole, "bigint"), ([r for r in relations if r not in whole], "string")]
    found = union_all([_orphans(children, parents, rel, kind) for rel, kind in parts if rel])
    spark = next(iter(children.values())).sparkSession
    rules = spark.createDataFrame([(r, c) for r, c, *_ in relations], "rule string, table_name string")
    return rules.join(found, "rule", "left").select("rule", "table_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"))


def too_long(col: str, n: int) -> Column:
    return F.length(col) > n


def bad_number(col: str, precision: int = 10, scale: int = 2) -> Column:
    """Value needs more digits than DECIMAL(precision, scale) holds."""
    c = F.col(col).cast("double")
    return (F.abs(c) >= F.lit(10.0 ** (precision - scale))) | \
        (F.abs(F.col(col).cast("decimal(38,10)") - F.round(F.col(col).cast("decimal(38,10)"), scale)) > 0)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
