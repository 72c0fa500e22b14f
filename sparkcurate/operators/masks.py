"""Masks as arrays and run tables.

A mask is 0/1 pixels in column-major order. Runs are ``(mask_id, run_start, run_len)``.
Two masks are compared by a sweep over the borders of their runs, so the work follows the
number of runs, whatever the pixels, and no run meets another one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.operators.blocks import HOT_ROWS, blocked_lag, blocked_running, on_hot_keys, range_block
from sparkcurate.session import materialise


def runs(df: DataFrame, mask_id: str, on: Column) -> DataFrame:
    """Foreground runs of a boolean array column; one row stays on one executor, so
    nothing is shuffled."""
    size = F.size("_on")
    index = F.sequence(F.lit(0), size - 1)
    lit = lambda i: F.coalesce(F.get("_on", i), F.lit(False))
    starts = F.filter(index, lambda i: lit(i) & ~lit(i - 1))
    ends = F.filter(index, lambda i: lit(i) & ~lit(i + 1))
    zipped = F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(a.cast("bigint").alias("run_start"), (b - a + 1).cast("bigint").alias("run_len")),
    )
    return df.select(mask_id, on.alias("_on")).filter(size > 0).select(mask_id, F.inline(zipped))


def area(run_table: DataFrame, mask_id: str) -> DataFrame:
    return run_table.groupBy(mask_id).agg(F.sum("run_len").alias("area"))


def bbox(run_table: DataFrame, mask_id: str, h: int) -> DataFrame:
    """Tight ``x, y, w, h``. A run that crosses a column covers all rows."""
    first, last = F.col("run_start"), F.col("run_start") + F.col("run_len") - 1
    c0, c1 = F.floor(first / h), F.floor(last / h)
    r0 = F.when(c0 == c1, first % h).otherwise(0)
    r1 = F.when(c0 == c1, last % h).otherwise(h - 1)
    return (
        run_table.groupBy(mask_id)
        .agg(F.min(c0).alias("x"), F.min(r0).alias("y"), F.max(c1).alias("_x1"), F.max(r1).alias("_y1"))
        .select(
            mask_id,
            F.col("x").cast("bigint").alias("x"),
            F.col("y").cast("bigint").alias("y"),
            (F.col("_x1") - F.col("x") + 1).cast("bigint").alias("w"),
            (F.col("_y1") - F.col("y") + 1).cast("bigint").alias("h"),
        )
    )


def overlap(pairs: DataFrame, run_table: DataFrame, mask_id: str, a: str, b: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Intersection and union of each pair ``(a, b)``; pairs without a common pixel have
    intersection 0. Both zero-union conventions: ``iou`` is 1 when both are empty,
    ``iou_eps`` divides by union + 1e-6. Runs of a mask may touch or overlap.

    Along the borders of both masks, in order, the open runs of either are counted; a stretch
    that is covered adds its end and takes off its start."""
    keys = pairs.select(a, b).distinct()
    end = F.col("run_start") + F.col("run_len")
    border = lambda at, step: F.struct(at.cast("bigint").alias("_pos"), F.lit(step).cast("bigint").alias("_step"))
    borders = run_table.filter("run_len > 0").select(mask_id, F.inline(F.array(border(F.col("run_start"), 1), border(end, -1))))

    def side(mine: str, in_a: int, in_b: int) -> DataFrame:
        met = keys.join(borders.withColumnRenamed(mask_id, mine), mine)
        return met.select(a, b, "_pos", (F.col("_step") * in_a).alias("_da"), (F.col("_step") * in_b).alias("_db"))

    def sweep(rows: DataFrame, cut: str | None) -> DataFrame:
        # the order among borders at one place does not matter: nothing lies between them
        return blocked_running(rows, [a, b], cut, ["_pos", "_da", "_db"], {"_na": ("sum", "_da"), "_nb": ("sum", "_db")})

    events = side(a, 1, 0).unionByName(side(b, 0, 1)).withColumn("_block", range_block("_pos"))
    swept = on_hot_keys(materialise(events, "borders"), [a, b], "_block", sweep, hot_rows)
    na, nb = F.col("_na"), F.col("_nb")
    was_a, was_b = na - F.col("_da") > 0, nb - F.col("_db") > 0

    def covered(before: Column, after: Column) -> Column:
        return F.sum(F.col("_pos") * (before.cast("bigint") - after.cast("bigint")))

    sums = swept.groupBy(a, b).agg(
        covered(was_a & was_b, (na > 0) & (nb > 0)).alias("inter"), covered(was_a | was_b, (na > 0) | (nb > 0)).alias("union_px")
    )
    zero = F.lit(0).cast("bigint")
    out = keys.join(sums, [a, b], "left").withColumns({c: F.coalesce(c, zero) for c in ("inter", "union_px")})
    return out.select(
        a,
        b,
        "inter",
        "union_px",
        F.when(F.col("union_px") == 0, 1.0).otherwise(F.try_divide("inter", "union_px")).alias("iou"),
        (F.col("inter") / (F.col("union_px") + 1e-6)).alias("iou_eps"),
    )


def crop(
    run_table: DataFrame, mask_id: str, h: int, box: Sequence[Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Runs inside a crop box ``x1, y1, x2, y2``, renumbered in the crop; masks empty
    inside it disappear. A run is cut into its first column, its last one and the whole columns
    between them, which stay one piece unless the box reaches above or below the image; the
    pieces are clipped and joined up again."""
    x1, y1, x2, y2 = box
    first, last = F.col("run_start"), F.col("run_start") + F.col("run_len") - 1
    c0, c1 = F.floor(first / h), F.floor(last / h)

    def piece(left: Column, right: Column, top: Column, low: Column) -> Column:
        named = zip(("c0", "c1", "r0", "r1"), (left, right, top, low))
        return F.struct(*[c.cast("bigint").alias(f"_{n}") for n, c in named])

    top, low = F.lit(0), F.lit(h - 1)
    # whole columns inside the box only, so an overhanging box costs no more than its own width
    left, right = F.greatest(c0 + 1, x1), F.least(c1 - 1, x2 - 1)
    single = F.transform(F.sequence(left, right), lambda c: piece(c, c, top, low))
    within = F.when((y1 >= 0) & (y2 <= h), F.array(piece(left, right, top, low))).otherwise(single)
    between = F.when(left <= right, within).otherwise(F.array().cast("array<struct<_c0:bigint,_c1:bigint,_r0:bigint,_r1:bigint>>"))
    parts = F.when(c0 == c1, F.array(piece(c0, c0, first % h, last % h))).otherwise(
        F.concat(F.array(piece(c0, c0, first % h, low), piece(c1, c1, top, last % h)), between)
    )
    split = run_table.filter("run_len > 0").select("*", F.inline(parts))
    r0, r1 = F.greatest("_r0", y1), F.least("_r1", y2 - 1)
    new_h = y2 - y1
    kept = split.filter((F.col("_c0") >= x1) & (F.col("_c1") < x2) & (r0 <= r1)).select(
        mask_id,
        ((F.col("_c0") - x1) * new_h + r0 - y1).cast("bigint").alias("_s"),
        ((F.col("_c1") - F.col("_c0")) * new_h + r1 - r0 + 1).cast("bigint").alias("_n"),
    )
    kept = kept.withColumn("_next", F.col("_s") + F.col("_n")).withColumn("_block", range_block("_s"))

    def link(rows: DataFrame, cut: str | None) -> DataFrame:
        linked = blocked_lag(rows, [mask_id], cut, ["_s"], {"_prev": "_next"})
        fresh = (F.col("_prev").isNull() | (F.col("_prev") != F.col("_s"))).cast("bigint")
        return blocked_running(linked.withColumn("_f", fresh), [mask_id], cut, ["_s"], {"_run": ("sum", "_f")})

    numbered = on_hot_keys(kept, [mask_id], "_block", link, hot_rows)
    return numbered.groupBy(mask_id, "_run").agg(
        F.min("_s").alias("run_start"), F.sum("_n").alias("run_len")
    ).drop("_run")


def unify(
    values: Column, dataset: Column, target: Column, strict: Sequence[str] = (), threshold: int = 128
) -> dict[str, Column]:
    """How a mask of any value set becomes 0/1: ``error`` (null when usable), ``method``,
    and ``foreground``, the number of pixels kept."""
    uniq = F.array_sort(F.array_distinct(values))
    top = F.array_max(values)

    def only(*allowed: int) -> Column:
        return F.size(F.array_except(uniq, F.array(*[F.lit(v) for v in allowed]))) == 0

    binary = only(0, 1, 255)
    by_class = F.concat(F.lit("class_id="), target.cast("string"))
    by_threshold = F.lit(f"threshold>={threshold}")
    is_empty = (F.coalesce(F.size(values), F.lit(0)) == 0) | (top == 0)
    is_strict = dataset.isin(list(strict)) if strict else F.lit(False)
    error = (
        F.when(is_empty, "empty_mask")
        .when(target.isNotNull(), F.when(~F.array_contains(uniq, target), "class_id_not_found"))
        .when(is_strict & ~only(0, 255), "non_0_255_mask_values_for_strict_dataset")
        .when(~binary & (top < threshold), "all_values_below_threshold")
    )
    method = (
        F.when(is_empty, "")
        .when(target.isNotNull(), by_class)
        .when(is_strict & ~only(0, 255), "")
        .when(binary, "binary_nonzero")
        .otherwise(by_threshold)
    )
    kept = (
        F.when(target.isNotNull(), F.size(F.filter(values, lambda v: v == target)))
        .when(binary, F.size(F.filter(values, lambda v: v > 0)))
        .otherwise(F.size(F.filter(values, lambda v: v >= threshold)))
    )
    return {
        "error": error,
        "method": method,
        "foreground": F.when(error.isNull(), kept).otherwise(0),
        "unique_values": uniq,
    }
