"""Counts, funnels and benchmark metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ten thresholds, with the ninth as floating-point arithmetic gives it.
IOU_THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.8999999999999999, 0.95]


def top_counts(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most common values; equal counts in value order."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), value).limit(k)


def dataset_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and exact distinct counts, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in columns]
    )


def count_buckets(instances: DataFrame, keys: Sequence[str], lo: int = 1, hi: int = 5) -> DataFrame:
    """Instances per key, kept when the count is a bucket ``lo..hi``."""
    return instances.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket")).filter(F.col("bucket").between(lo, hi))


def bucket_summary(bucketed: DataFrame, image: str) -> DataFrame:
    return bucketed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(image).alias("unique_images")
    )


def funnel(df: DataFrame, group: str, stages: Mapping[str, Column]) -> DataFrame:
    """Rows that reach each stage, per group and in total (group null)."""
    return df.groupingSets([[group], []], group).agg(
        F.count(F.lit(1)).alias("rows_in"), *[F.count_if(c).alias(n) for n, c in stages.items()]
    )


def _strict_share(iou: str) -> Column:
    hits = [F.avg((F.col(iou) >= t).cast("double")) for t in IOU_THRESHOLDS]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total / len(hits)


def iou_metrics(df: DataFrame, kinds: Sequence[str] = ("best", "step0", "final")) -> DataFrame:
    """Mean IoU, cumulative IoU, P@50 and P@50-95 in percent for each kind, and the
    gain of the best step over step 0. Columns ``<kind>_iou, _inter, _union``."""
    cols = []
    for k in kinds:
        iou, inter, union = f"{k}_iou", F.sum(f"{k}_inter"), F.sum(f"{k}_union")
        cols += [
            F.round(F.avg(iou) * 100, 6).alias(f"{k}_giou"),
            F.round(F.when(union > 0, inter / union * 100).otherwise(0.0), 6).alias(f"{k}_ciou"),
            F.round(F.avg((F.col(iou) >= 0.5).cast("double")) * 100, 6).alias(f"{k}_p50"),
            F.round(_strict_share(iou) * 100, 6).alias(f"{k}_p50_95"),
        ]
    gain = F.round(F.avg(F.col("best_iou") - F.col("step0_iou")) * 100, 6).alias("refinement_gain")
    return df.agg(F.count(F.lit(1)).alias("evaluated"), *cols, gain)


def validation_profile(df: DataFrame, sign: str, iou: str, x: str, y: str) -> DataFrame:
    """Click counts per sign and IoU tenth with coordinate means and extremes."""
    bin_ = (F.floor(F.col(iou) * 10) / 10).alias("iou_bin")
    return (
        df.groupBy(F.col(sign).alias("click_type"), bin_)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.round(F.avg(x), 6).alias("mean_x"),
            F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.round(F.avg(y), 6).alias("mean_y"),
        )
    )


def profile_summary(df: DataFrame, sign: str, x: str, y: str) -> DataFrame:
    """Clicks per sign with their share in percent, and of all signs (``all``), with
    coordinate means and extremes."""
    sums = df.withColumn("_sign", F.col(sign)).rollup("_sign").agg(
        F.grouping("_sign").alias("_all"), F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{name}_{out}") for c, out in ((x, "x"), (y, "y")) for name, f in (("min", F.min), ("max", F.max))],
        *[F.round(F.avg(c), 6).alias(f"mean_{out}") for c, out in ((x, "x"), (y, "y"))],
    )
    total = F.max("n").over(Window.partitionBy())  # a row per sign
    return sums.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("_sign")).alias("click_type"), "n",
        F.round(F.col("n") * 100 / total, 6).alias("share"), "min_x", "max_x", "mean_x", "min_y", "max_y", "mean_y",
    )


def outcome_counts(df: DataFrame, **flags: Column) -> DataFrame:
    """One row: all rows, and those of each outcome."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in flags.items()])


def list_totals(df: DataFrame, group: str, owner: str) -> DataFrame:
    """Lists and list items per group. Items are counted per owner first, so a group that
    holds most of them is summed in parts."""
    per_owner = df.groupBy(group, owner).agg(F.count(F.lit(1)).alias("_n"))
    return per_owner.groupBy(group).agg(F.count(F.lit(1)).alias("images"), F.sum("_n").alias("parts"))


def bbox_union(df: DataFrame, keys: Sequence[str], box: Sequence[str]) -> DataFrame:
    x1, y1, x2, y2 = box
    return df.groupBy(*keys).agg(
        F.min(x1).alias("x1"), F.min(y1).alias("y1"), F.max(x2).alias("x2"), F.max(y2).alias("y2")
    )


def split_log(df: DataFrame) -> DataFrame:
    """Run-log rows routed to ``eval`` or ``train``; the step is the number before the
    slash. Input: ``progress, epoch, loss, eval_loss``."""
    step = F.when(F.contains("progress", F.lit("/")), F.substring_index("progress", "/", 1).try_cast("bigint"))
    kind = F.when(F.col("eval_loss").isNotNull(), "eval").when(F.col("loss").isNotNull(), "train")
    return df.withColumn("step", step).withColumn("kind", kind).filter(F.col("kind").isNotNull())


def best_checkpoint(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """The evaluation with the smallest loss (first of equals) and the last training row."""
    at = F.struct(*order)
    is_eval, is_train = F.col("kind") == "eval", F.col("kind") == "train"
    # a null ordering value takes a row out of the contest
    both = log.agg(
        F.count_if(is_eval).alias("eval_rows"),
        F.min_by(
            F.struct("step", "eval_loss"), F.when(is_eval, F.struct(F.col("eval_loss"), at.alias("at")))
        ).alias("b"),
        F.count_if(is_train).alias("train_rows"),
        F.max_by(F.struct("step", "loss"), F.when(is_train, at)).alias("l"),
    )
    return both.select(
        "eval_rows", F.col("b.step").alias("best_step"), F.col("b.eval_loss").alias("best_eval_loss"),
        "train_rows", F.col("l.step").alias("last_step"), F.col("l.loss").alias("last_loss"),
    )


def relabel_report(df: DataFrame, keys: Sequence[str], order: Sequence[str], example: str) -> DataFrame:
    """Rows per change with the first example."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*order, F.col(example).alias("_example")))["_example"].alias("example")
    )

