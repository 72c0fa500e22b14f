"""Ranking that survives a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.operators.blocks import HOT_ROWS, on_hot_keys
from sparkcurate.session import materialise

# Above this literal, Spark no longer trims groups before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str | None = None
) -> DataFrame:
    """First ``n`` rows per key. ``n`` is small, so every map task already trims its
    share of a group to ``n`` rows (WindowGroupLimit) and a hot key stays cheap."""
    if not 1 <= n <= GROUP_LIMIT:
        raise ValueError(f"n must be in 1..{GROUP_LIMIT}; use rank_rows for longer lists")
    name = out or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if out else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_per_key(df, keys, order, 1)


def rank_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1-based rank of every row within its key, for groups of any size. ``order`` must
    be a total order; keys must not be null. Without keys all rows are one group.

    Ordinary keys take one window. Keys of more than ``hot_rows`` rows are ranked over
    range partitions, see ``_rank_by_range``."""
    if not keys:
        return _rank_by_range(df, keys, order, out)

    def rank(rows: DataFrame, cut: str | None) -> DataFrame:
        if cut is not None:
            return _rank_by_range(rows, keys, order, out)
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn(out, place.cast("bigint"))

    return on_hot_keys(df, keys, "range", rank, hot_rows)


def _rank_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Rows are range-partitioned on the whole ``(keys, order)`` tuple, so a hot key is
    spread over as many partitions as it needs; only one small row per (key, partition)
    is then ranked."""
    sort = [F.col(k).asc() for k in keys] + list(order)
    cut = materialise(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_seg", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id()),
        "rank",
    )
    before = (
        Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cut.groupBy(*keys, "_seg")
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    # One row per partition without keys; with keys, one per key and partition border.
    # Written out, so the planner broadcasts it only when it really is small, and then
    # the ranked rows are not shuffled a second time.
    offsets = materialise(offsets, "rank-offsets")
    place = F.col("_pos") - F.col("_first") + F.col("_before") + 1
    return cut.join(offsets, [*keys, "_seg"]).select(*df.columns, place.alias(out))


def paged_lists(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    item: Column,
    page_size: int = 1000,
    out: str = "items",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Ordered list per key, cut into pages of at most ``page_size`` items, so no row
    grows with its group. Ordinary groups have the single page 0."""
    ranked = rank_rows(df, keys, order, "_r", hot_rows).withColumn("_item", item)
    return (
        ranked.withColumn("page", F.floor((F.col("_r") - 1) / page_size).cast("bigint"))
        .groupBy(*keys, "page")
        .agg(F.array_sort(F.collect_list(F.struct("_r", "_item"))).alias("_l"))
        .withColumn(out, F.col("_l")["_item"])
        .drop("_l")
    )
