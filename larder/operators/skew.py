"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS, SALTS = 1000, 64


def hottest(keys: DataFrame, on: list[str], weight: str, k: int = HOT_KEYS) -> DataFrame:
    """The k heaviest keys. Without them no key holds more than 1/k of the rows."""
    return keys.orderBy(F.desc(weight), *on).limit(k).select(*on)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame, spread_by: str,
                salts: int = SALTS) -> DataFrame:
    """Inner join in which rows of ``hot`` keys are dealt over ``salts`` tasks: the
    left rows by ``spread_by``, the right rows (unique per key) once for each salt.
    ``hot`` holds at most HOT_KEYS rows, so it is broadcast."""
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    left = left.join(mark, on, "left").withColumn("_salt", salt).drop("_hot")
    right = (right.join(mark, on, "left")
             .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                            .otherwise(F.array(F.lit(0))))).drop("_hot"))
    return left.join(right, [*on, "_salt"]).drop("_salt")
