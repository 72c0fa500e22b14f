"""Adaptive selection: score, gate by class frequency, cap, and rebalance.

Candidate columns: ``target_object, affordance, bw_yellow_veto, image_quality, clutter,
affordance_quality, object_visible, bbox_quality, parts_visibility, confidence`` plus
the caller's order columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions import scoring
from sparkcurate.operators.blocks import HOT_ROWS
from sparkcurate.operators.ranking import first_per_key, rank_rows
from sparkcurate.session import materialise


def score(df: DataFrame) -> DataFrame:
    """Add ``eval_score``, ``confidence_score`` and ``final_score``, rounded to 6 places
    after the final score was computed from the unrounded parts."""
    raw = scoring.eval_score(
        F.col("affordance_quality"), F.col("object_visible"), F.col("bbox_quality"), F.col("parts_visibility")
    )
    conf = scoring.confidence_score(F.col("confidence"))
    total = scoring.final_score(F.col("image_quality"), raw, F.col("clutter"), conf)
    return df.withColumns(
        {
            "eval_score": F.round(raw, 6),
            "confidence_score": F.round(conf, 6),
            "final_score": F.round(total, 6),
        }
    )


def class_thresholds(candidates: DataFrame) -> DataFrame:
    """One row per class with its candidate count and cut-offs. Written out, so that the
    planner sees the size of the class table before it joins it to the candidates."""
    counts = materialise(candidates.groupBy("target_object").agg(F.count(F.lit(1)).alias("n")), "class-counts")
    top = counts.select(F.max("n")).scalar()
    return counts.select(
        "target_object", "n", *[c.alias(name) for name, c in scoring.thresholds(F.col("n"), top).items()]
    )


def judge(candidates: DataFrame, cuts: DataFrame, allow_veto: bool = False) -> DataFrame:
    """Add ``reason``: the first failing rule, or ``pass``."""
    return candidates.join(cuts, "target_object").withColumn("reason", scoring.reject_reason(allow_veto))


def class_caps(passed: DataFrame, order: Sequence[str], **cap_args) -> DataFrame:
    """Cap of each class over its passing rows; the class takes the affordance of its
    first passing row."""
    counts = passed.groupBy("target_object").agg(
        F.count(F.lit(1)).alias("n_passed"), F.min(F.struct(*order, "affordance"))["affordance"].alias("affordance")
    )
    cap = scoring.class_cap(F.col("target_object"), F.col("affordance"), F.col("n_passed"), **cap_args)
    return materialise(counts.withColumn("cap", cap), "class-caps")


def best_first(order: Sequence[str]) -> list[Column]:
    """Ranking of a class: scores down, clutter up, then input order."""
    down = ["final_score", "eval_score", "confidence_score", "image_quality"]
    return [F.col(c).desc() for c in down] + [F.col("clutter").asc()] + [F.col(c).asc() for c in order]


def rebalance(passed: DataFrame, caps: DataFrame, order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep the best ``cap`` rows of each class. Caps grow with the class, so a large
    class is ranked over range partitions, never sorted in a single task."""
    ranked = rank_rows(passed, ["target_object"], best_first(order), "class_rank", hot_rows)
    return ranked.join(caps.select("target_object", "n_passed", "cap"), "target_object").filter(
        F.col("class_rank") <= F.col("cap")
    )


def adaptive_selection(
    candidates: DataFrame, order: Sequence[str], hot_rows: int = HOT_ROWS, **cap_args
) -> dict[str, DataFrame]:
    """The whole selection. The scored candidates are written once and read by each of
    the three passes (count, judge, rank) instead of redoing the join above them."""
    scored = materialise(score(candidates), "scored")
    cuts = class_thresholds(scored)
    judged = judge(scored, cuts)
    passed = judged.filter("reason = 'pass'")
    caps = class_caps(passed, order, **cap_args)
    return {"scored": scored, "cuts": cuts, "judged": judged, "caps": caps, "kept": rebalance(passed, caps, order, hot_rows)}


def object_summary(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Matched, passed, cap and kept rows of each class. The kept count follows from the
    cap, so the ranking need not run."""
    kept = F.coalesce(F.least("cap", "n_passed"), F.lit(0))
    return (
        parts["cuts"].select("target_object", F.col("n").alias("matched"))
        .join(parts["caps"], "target_object", "left")
        .select(
            "target_object",
            "matched",
            F.coalesce("n_passed", F.lit(0)).alias("passed"),
            F.coalesce("cap", F.lit(0)).alias("cap"),
            kept.alias("kept"),
            F.round(kept / F.col("matched"), 6).alias("keep_ratio"),
            F.coalesce("affordance", F.lit("")).alias("affordance"),
        )
    )


def best_evaluation(df: DataFrame, keys: Sequence[str], scored: str, position: str, names: Sequence[str]) -> DataFrame:
    """Best-scored evaluation of each record whose object is one of its target names;
    the first of equal scores wins. ``df`` has one row per evaluation with ``object``."""
    hit = F.lit(False)
    for n in names:
        hit = hit | ((F.lower(F.btrim(n)) != "") & (F.lower(F.btrim("object")) == F.lower(F.btrim(n))))
    return first_per_key(df.filter(hit), keys, [F.col(scored).desc(), F.col(position).asc()])
