"""Written intermediate tables, and the joins on hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from larder.operators.skew import HOT_KEYS, SALTS, hottest, salted_join
from larder.session import ensure_checkpoint_dir

__all__ = ["HOT_KEYS", "SALTS", "hottest", "salted_join", "write_table"]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts the lineage and
    survives lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
