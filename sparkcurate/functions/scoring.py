"""Scores, adaptive thresholds and class caps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hard caps of two named classes.
HARD_CAPS = {"chair": 1200, "helmet": 300}

REJECT_ORDER = [
    "bw_yellow_veto",
    "image_quality",
    "clutter",
    "target_affordance_quality",
    "target_object_visible",
    "target_bbox_quality",
    "target_eval_score",
    "final_score",
]


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def unit(v: Column, hi: float) -> Column:
    """Clamp to 0..hi and scale to 0..1."""
    return F.greatest(F.lit(0.0), F.least(v.cast("double"), F.lit(float(hi)))) / float(hi)


def confidence_score(conf: Column) -> Column:
    conf = F.lower(F.btrim(conf))
    return (
        F.when(conf == "high", 1.0).when(conf == "medium", 0.65).when(conf == "low", 0.35).otherwise(0.0)
    )


def eval_score(affordance: Column, visible: Column, bbox: Column, parts: Column) -> Column:
    return 0.45 * unit(affordance, 5) + 0.20 * unit(visible, 3) + 0.20 * unit(bbox, 3) + 0.15 * unit(parts, 3)


def final_score(image_quality: Column, evaluation: Column, clutter: Column, confidence: Column) -> Column:
    return (
        0.30 * unit(image_quality, 5)
        + 0.40 * evaluation
        + 0.15 * (1.0 - unit(clutter, 5))
        + 0.15 * confidence
    )


def thresholds(n: Column, n_max: Column) -> dict[str, Column]:
    """Cut-offs that tighten with the log frequency of a class."""
    s = F.when((n <= 0) | (n_max <= 1), F.lit(0.0)).otherwise(F.log1p(n) / F.log1p(n_max))
    return {
        "strictness": F.round(s, 6),
        "min_image_quality": F.when(s < 0.35, 3).otherwise(4),
        "max_clutter": F.when(s < 0.20, 4).when(s < 0.65, 3).otherwise(2),
        "min_affordance_quality": F.when(s < 0.40, 3).otherwise(4),
        "min_object_visible": F.when(s < 0.25, 1).otherwise(2),
        "min_bbox_quality": F.when(s < 0.25, 1).otherwise(2),
        "min_target_eval_score": F.round(0.45 + 0.25 * s, 6),
        "min_final_score": F.round(0.52 + 0.23 * s, 6),
    }


def reject_reason(allow_veto: bool = False) -> Column:
    """First failing rule of a candidate that carries its thresholds, else ``pass``."""
    failing = {
        "bw_yellow_veto": F.lit(False) if allow_veto else F.col("bw_yellow_veto") == 1,
        "image_quality": F.col("image_quality") < F.col("min_image_quality"),
        "clutter": F.col("clutter") > F.col("max_clutter"),
        "target_affordance_quality": F.col("affordance_quality") < F.col("min_affordance_quality"),
        "target_object_visible": F.col("object_visible") < F.col("min_object_visible"),
        "target_bbox_quality": F.col("bbox_quality") < F.col("min_bbox_quality"),
        "target_eval_score": F.col("eval_score") < F.col("min_target_eval_score"),
        "final_score": F.col("final_score") < F.col("min_final_score"),
    }
    out = None
    for name in REJECT_ORDER:
        out = F.when(failing[name], name) if out is None else out.when(failing[name], name)
    return out.otherwise("pass")


def class_cap(
    name: Column,
    affordance: Column,
    n: Column,
    keep_all: int = 200,
    sqrt_scale: float = 12.0,
    wear_scale: float = 0.55,
    hard_caps: Mapping[str, int] = HARD_CAPS,
) -> Column:
    """Rows a class may keep: all of a rare class, then growing with the square root."""
    spread = F.sqrt(F.greatest(F.lit(0), n - keep_all).cast("double"))
    cap = F.when(n <= keep_all, n).otherwise(
        F.least(F.bround(keep_all + sqrt_scale * spread).cast("bigint"), n)
    )
    cap = F.when(affordance == "wear", F.floor(cap * max(0.0, wear_scale)).cast("bigint")).otherwise(cap)
    for who, hard in hard_caps.items():
        if hard >= 0:
            cap = F.when(name == who, F.least(cap, F.lit(hard))).otherwise(cap)
    return F.when(n > 0, F.greatest(F.lit(1), F.least(cap, n))).otherwise(F.lit(0)).cast("bigint")
