"""Samples and limits: operators whose purpose is to return fewer rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded(df: DataFrame, key: Column, seed: int, n: int) -> DataFrame:
    """``n`` rows in a shuffled order that depends on the key and the seed only, so it
    is the same on any partitioning. Each task keeps its own first ``n``."""
    shuffled = df.withColumn("_at", F.md5(F.concat(key, F.lit(f":{seed}")))).withColumn("_key", key)
    return shuffled.orderBy("_at", "_key").limit(n).drop("_at", "_key")


def every_nth(df: DataFrame, line: str, n: int) -> DataFrame:
    """Rows whose line number is a multiple of ``n``."""
    return df.filter(F.col(line) % n == 0)


def first_items(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in order; 0 is no limit."""
    return df.orderBy(*order).limit(n) if n > 0 else df
