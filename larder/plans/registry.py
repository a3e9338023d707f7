"""Registry of named queries and their DuckDB oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``. The oracle is SQL over the
driver tables; the retail views it names are inlined as CTEs. Registered
results go through :func:`comparable`: exact decimals become DOUBLE and
timestamps become ``yyyy-MM-dd HH:mm:ss`` strings, so both engines hash the
same values.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.sources.views import oracle_with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

_MODULES = (
    "larder.plans.analytics_queries",
    "larder.plans.catalog_queries",
    "larder.plans.deal_queries",
    "larder.plans.order_queries",
    "larder.plans.text_queries",
    "larder.plans.routing_queries",
    "larder.plans.evaluation_queries",
    "larder.plans.vector_queries",
    "larder.plans.quality_queries",
    "larder.plans.state_queries",
    "larder.plans.answer_queries",
    "larder.plans.source_queries",
)


def comparable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the retail model and the oracles are defined in UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return comparable(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = oracle_with_views(oracle)
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
