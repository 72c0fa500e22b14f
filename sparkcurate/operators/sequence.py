"""Step sequences: lags, trajectories and stop rules. Hot keys are cut into blocks, see
``blocks``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.operators.blocks import HOT_ROWS, blocked_lag, blocked_running, on_hot_keys


def step_numbers(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], out: str = "step", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """0-based position of each row within its key."""

    def number(rows: DataFrame, cut: str | None) -> DataFrame:
        ones = rows.withColumn("_one", F.lit(1).cast("bigint"))
        return blocked_running(ones, keys, cut, order, {out: ("sum", "_one")}, inclusive=False).drop("_one")

    return on_hot_keys(df, keys, block, number, hot_rows)


def islands(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], is_start: Column, out: str = "traj",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based run number: a starting row opens a new run; rows before the first start
    form run 0."""

    def number(rows: DataFrame, cut: str | None) -> DataFrame:
        flagged = rows.withColumn("_start", is_start.cast("bigint"))
        flagged = flagged.withColumn("_key", F.struct(*order, "_start"))
        run = blocked_running(flagged, keys, cut, order, {out: ("sum", "_start"), "_first": ("min", "_key")})
        return run.withColumn(out, F.col(out) - F.col("_first._start")).drop("_start", "_key", "_first")

    return on_hot_keys(df, keys, block, number, hot_rows)


def runs_by_start(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], is_start: Column, wanted: Column,
    out: str = "traj", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows of the runs whose starting row is ``wanted``, with their run number. The
    latest start before a row is a running maximum, so the rows are read once and no
    key list is joined back."""

    def pick(rows: DataFrame, cut: str | None) -> DataFrame:
        marked = rows.withColumn("_start", is_start.cast("bigint"))
        marked = marked.withColumns(
            {
                "_key": F.struct(*order, "_start"),
                "_mark": F.when(is_start, F.struct(*order, wanted.alias("_wanted"))),
            }
        )
        cols = {out: ("sum", "_start"), "_first": ("min", "_key"), "_last": ("max", "_mark")}
        run = blocked_running(marked, keys, cut, order, cols)
        run = run.filter(F.col("_last._wanted")).withColumn(out, F.col(out) - F.col("_first._start"))
        return run.drop("_start", "_key", "_mark", "_first", "_last")

    return on_hot_keys(df, keys, block, pick, hot_rows)


def previous_value(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], col: str, out: str, default: float = 0.0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Value of the previous step, ``default`` at the first one."""

    def lag(rows: DataFrame, cut: str | None) -> DataFrame:
        return blocked_lag(rows, keys, cut, order, {out: col}).withColumn(out, F.coalesce(out, F.lit(default)))

    return on_hot_keys(df, keys, block, lag, hot_rows)


def _until(df: DataFrame, keys, block, order, flag: Column) -> DataFrame:
    """Rows before the first flagged one."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("int"))
    return (
        blocked_running(marked, keys, block, order, {"_stopped": ("max", "_flag")})
        .filter("_stopped = 0")
        .drop("_flag", "_stopped")
    )


def monotone_prefix(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], iou: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Steps before the first decrease."""

    def trim(rows: DataFrame, cut: str | None) -> DataFrame:
        lagged = blocked_lag(rows, keys, cut, order, {"_prev": iou})
        return _until(lagged, keys, cut, order, F.col(iou) < F.col("_prev")).drop("_prev")

    return on_hot_keys(df, keys, block, trim, hot_rows)


def stuck_prefix(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], tolerance: int = 2, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Steps before the first click that repeats its predecessor: same sign and at most
    ``tolerance`` pixels away on both axes. Columns ``x, y, is_positive``."""

    def trim(rows: DataFrame, cut: str | None) -> DataFrame:
        lagged = blocked_lag(rows, keys, cut, order, {"_x": "x", "_y": "y", "_p": "is_positive"})
        near = (F.abs(F.col("x") - F.col("_x")) <= tolerance) & (F.abs(F.col("y") - F.col("_y")) <= tolerance)
        stuck = near & (F.col("is_positive") == F.col("_p"))
        return _until(lagged, keys, cut, order, stuck).drop("_x", "_y", "_p")

    return on_hot_keys(df, keys, block, trim, hot_rows)


def peak_trim(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], iou: str, stop: float = 0.97,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Stop at the first value of at least ``stop`` (kept), or at the first value below
    the running peak; the latter cuts back to the first row of that peak.

    Up to the stopping row values never decrease, so the rows to cut are the repeats of
    the final peak: they equal both the peak before them and the final peak."""
    v, peak, final = F.col(iou), F.col("_peak"), F.col("_final")

    def trim(rows: DataFrame, cut: str | None) -> DataFrame:
        peaked = blocked_running(rows, keys, cut, order, {"_peak": ("max", iou)}, inclusive=False)
        drop = (v < peak) & (v < stop)
        ends = (v >= stop) | F.coalesce(drop, F.lit(False))
        marked = peaked.withColumn("_end", ends.cast("int"))
        run = blocked_running(marked, keys, cut, order, {"_done": ("max", "_end")}, inclusive=False)
        run = run.filter(F.coalesce("_done", F.lit(0)) == 0)
        # at most one stopping row per key
        cuts = run.filter((F.col("_end") == 1) & drop).select(*keys, peak.alias("_final"))
        repeat = final.isNotNull() & ((v < peak) | ((v == peak) & (v == final)))
        kept = run.join(cuts, list(keys), "left").filter(~F.coalesce(repeat, F.lit(False)))
        return kept.drop("_peak", "_end", "_done", "_final")

    return on_hot_keys(df, keys, block, trim, hot_rows)


def accumulated(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], item: Column, out: str, max_steps: int = 20,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Items of all steps up to the current one, in pages of ``max_steps`` (by default the
    longest click loop, so a loop is one page). The whole prefix of a row is its own list
    after the last lists of the earlier pages of its key. Every row stays, and no list grows
    without bound."""
    steps = step_numbers(df, keys, block, order, "_step", hot_rows)
    steps = steps.withColumn("page", F.floor(F.col("_step") / max_steps).cast("bigint"))
    w = Window.partitionBy(*keys, "page").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn(out, F.collect_list(item).over(w)).drop("_step")


def summarise(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], iou: str, step: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Step count, best step (first maximum), and best, final and first value; ``extra``
    columns are taken from the same three steps."""
    at, best = F.struct(*order), F.struct(-F.col(iou), F.col(step))
    cols = [(iou, "iou"), *[(c, c) for c in extra]]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_steps"),
        F.min_by(step, best).alias("best_step"),
        *[F.min_by(c, best).alias(f"best_{n}") for c, n in cols],
        *[F.max_by(c, at).alias(f"final_{n}") for c, n in cols],
        *[F.min_by(c, at).alias(f"step0_{n}") for c, n in cols],
    )


def overlay_plan(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], mask: str, name: Column, existing: DataFrame,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Which mask each step after the first is drawn on (that of the step before), and
    the name of the drawn image; names that exist already are left out."""

    def plan(rows: DataFrame, cut: str | None) -> DataFrame:
        ones = rows.withColumn("_one", F.lit(1).cast("bigint"))
        steps = blocked_running(ones, keys, cut, order, {"step": ("sum", "_one")}, inclusive=False).drop("_one")
        return blocked_lag(steps, keys, cut, order, {"mask_of": mask}).filter("step > 0")

    planned = on_hot_keys(df, keys, block, plan, hot_rows)
    return planned.withColumn("name", name).join(existing.select("name"), "name", "left_anti")
