"""Ordered per-key computations that survive a hot key.

A plain window over a key sends the whole key to one task. That is the best plan for
ordinary keys, so it is kept for them. Keys with more than ``HOT_ROWS`` rows are counted
out first (``on_hot_keys``) and cut into blocks by a column that grows with the order (a
stretch of time, a range of positions). The inner part then runs per (key, block); one
small summary row per block carries the state across block borders, and is joined back on
(key, block). Keys and blocks must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.session import materialise

# Rows of one key that a single task sorts without trouble.
HOT_ROWS = 1_000_000

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(fn: str, local: Column, carry: Column) -> Column:
    if fn == "sum":
        return local + F.coalesce(carry, F.lit(0))
    return F.greatest(local, carry) if fn == "max" else F.least(local, carry)


def time_block(ts: str, minutes: int = 10) -> Column:
    """Number of the stretch of ``minutes`` that a timestamp without zone falls in. A key
    holding a third of a month of data is cut into thousands of blocks."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return F.floor((days * 1440 + F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("bigint")


def range_block(position: str, width: int = 4096) -> Column:
    """Blocks of ``width`` consecutive positions."""
    return F.floor(F.col(position) / width).cast("bigint")


def meet(rows: DataFrame, side: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``cols``, where null meets null."""
    right = side.withColumnsRenamed({c: f"_on_{c}" for c in cols})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in cols]
    return rows.join(right, same, how).drop(*[f"_on_{c}" for c in cols])


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``rows`` rows, or None when there are none. At most one key per
    ``rows`` rows qualifies; the list is written, so the planner knows its size."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    listed = materialise(counted.select(*keys), "hot-keys")
    return None if listed.isEmpty() else listed


def on_hot_keys(
    df: DataFrame, keys: Sequence[str], block: str, fn: Callable[[DataFrame, str | None], DataFrame], rows: int = HOT_ROWS
) -> DataFrame:
    """Run ``fn(rows, None)``, whole keys at a time, on ordinary keys and ``fn(rows,
    block)`` on hot ones."""
    hot = hot_keys(df, keys, rows)
    if hot is None:
        return fn(df, None)
    cold = fn(meet(df, hot, keys, "left_anti"), None)
    return cold.unionByName(fn(meet(df, hot, keys, "left_semi"), block))


def blocked_lag(
    df: DataFrame,
    keys: Sequence[str],
    block: str | None,
    order: Sequence[str],
    cols: Mapping[str, str],
) -> DataFrame:
    """Value of the previous row of the key; null on its first row.
    ``cols`` maps each output name to its input column. Without a block the key is
    taken whole."""
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({o: F.lag(c).over(whole) for o, c in cols.items()})
    inner = Window.partitionBy(*keys, block).orderBy(*order)
    previous = Window.partitionBy(*keys).orderBy(block)
    local = df.withColumns({f"_in_{o}": F.lag(c).over(inner) for o, c in cols.items()})
    local = local.withColumn("_head", F.row_number().over(inner) == 1)
    tails = df.groupBy(*keys, block).agg(
        F.max_by(F.struct(*sorted(set(cols.values()))), F.struct(*order)).alias("_tail")
    )
    carry = tails.withColumn("_tail", F.lag("_tail").over(previous))
    return (
        meet(local, carry, [*keys, block])
        .withColumns(
            {
                o: F.when(F.col("_head"), F.col("_tail")[c]).otherwise(F.col(f"_in_{o}"))
                for o, c in cols.items()
            }
        )
        .drop("_head", "_tail", *[f"_in_{o}" for o in cols])
    )


def blocked_running(
    df: DataFrame,
    keys: Sequence[str],
    block: str | None,
    order: Sequence[str],
    cols: Mapping[str, tuple[str, str]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` from the start of the key up to the row
    (or up to the row before it). ``cols`` maps output name to (function, column).
    ``order`` must be a total order within the key. Without a block the key is taken
    whole."""
    inner = Window.partitionBy(*keys, *([block] if block else [])).orderBy(*order)
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    if block is None:
        made = {}
        for o, (fn, c) in cols.items():
            run = _AGG[fn](c).over(inner)
            made[o] = F.coalesce(run, F.lit(0)) if fn == "sum" else run
        return df.withColumns(made)
    before = (
        Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = df.withColumns({f"_in_{o}": _AGG[fn](c).over(inner) for o, (fn, c) in cols.items()})
    totals = df.groupBy(*keys, block).agg(
        *[_AGG[fn](c).alias(f"_all_{o}") for o, (fn, c) in cols.items()]
    )
    carry = totals.select(
        *keys, block, *[_AGG[fn](f"_all_{o}").over(before).alias(f"_c_{o}") for o, (fn, _) in cols.items()]
    )
    merged = {}
    for o, (fn, _) in cols.items():
        here = F.col(f"_in_{o}")
        if fn == "sum":
            here = F.coalesce(here, F.lit(0))
        merged[o] = _merge(fn, here, F.col(f"_c_{o}"))
    drop = [f"_{p}_{o}" for o in cols for p in ("in", "c")]
    return meet(local, carry, [*keys, block]).withColumns(merged).drop(*drop)
