"""Filters and row-level routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.names import clean, label_key, word_key
from sparkcurate.functions.scoring import safe_int


def image_gate(
    veto: Column, image_quality: Column, clutter: Column, min_quality: int = 2, max_clutter: int = 4,
    need_no_veto: bool = True,
) -> Column:
    """Image-level quality rule; absent or unreadable values count as 0."""
    ok = (safe_int(image_quality) >= min_quality) & (safe_int(clutter) <= max_clutter)
    return ok & (safe_int(veto) == 0) if need_no_veto else ok


def counts_agree(keep_ok: Column, count_ok: Column, image: Column, estimated: Column, source: Column) -> Column:
    """Both records are fine and the estimated count, as text, is the source count."""
    return (
        F.coalesce(keep_ok, F.lit(False))
        & F.coalesce(count_ok, F.lit(False))
        & (clean(image) != "")
        & (clean(estimated) == source.cast("string"))
    )


def sit_on_rule(part: Column, affordance: Column, action: Column) -> Column:
    """Sitting keeps only the seat; every other row stays."""
    sits = (label_key(affordance) == "sit on") | (label_key(action) == "sit on")
    return ~sits | (label_key(part) == "seat")


def parts_or_whole(parts: Column) -> Column:
    """The cleaned part list, or the whole object when it is empty."""
    kept = F.filter(F.transform(parts, clean), lambda p: p != "")
    return F.when(F.coalesce(F.size(kept), F.lit(0)) == 0, F.array(F.lit("whole_object"))).otherwise(kept)


def is_whole_object(part: Column) -> Column:
    """Both sides are normalised, so the skip rule can fire."""
    return word_key(part) == "whole object"


def positive_affordances(selected: Column, judged: Column) -> Column:
    """Selected affordances; when there are none, the judged ones that exist. Entries
    marked as not existing are left out; an absent mark counts as existing."""
    fallback = F.filter(judged, lambda x: F.coalesce(x["exists"], F.lit(False)))
    chosen = F.when(F.coalesce(F.size(selected), F.lit(0)) > 0, selected).otherwise(fallback)
    return F.filter(chosen, lambda x: F.coalesce(x["exists"], F.lit(True)))


def flat_or_nested(df: DataFrame, skip_whole: bool = False) -> DataFrame:
    """One row per (image, object, part, affordance). Records that carry all four flat
    fields pass as they are; the others expand their nested selection.

    Input: ``rec_id, ok, image_path, object, part, affordance, selected, judged`` where
    the last two are arrays of ``struct<affordance, parts, exists>``."""
    flat = (clean(F.col("object")) != "") & (clean(F.col("part")) != "") & (clean(F.col("affordance")) != "")
    flat = flat & (clean(F.col("image_path")) != "")
    common = ["rec_id", clean(F.col("image_path")).alias("image_path"), clean(F.col("object")).alias("object")]
    as_is = df.filter(flat).select(
        *common, clean(F.col("part")).alias("part"), clean(F.col("affordance")).alias("affordance"),
        F.concat(F.lit("rec:"), F.col("rec_id").cast("string")).alias("source"),
    )
    nested = (
        df.filter(~flat & F.coalesce("ok", F.lit(False)) & (clean(F.col("object")) != ""))
        .select(*common, F.posexplode(positive_affordances(F.col("selected"), F.col("judged"))).alias("ai", "a"))
        .filter(clean(F.col("a.affordance")) != "")
        .select("*", F.posexplode(F.filter(F.transform("a.parts", clean), lambda p: p != "")).alias("pi", "part"))
        .select(
            "rec_id", "image_path", "object", "part", clean(F.col("a.affordance")).alias("affordance"),
            F.format_string("rec:%d:a%d:p%d", "rec_id", "ai", "pi").alias("source"),
        )
    )
    rows = as_is.unionByName(nested)
    return rows.filter(~is_whole_object(F.col("part"))) if skip_whole else rows


def targets(e_object: Column, e_affordance: Column, quality: Column, obj: Column, affordance: Column) -> Column:
    """Positive evaluations of the target; an empty target affordance takes any."""
    wanted = F.lower(clean(affordance))
    return (
        (F.lower(clean(e_object)) == F.lower(clean(obj)))
        & ((wanted == "") | (F.lower(clean(e_affordance)) == wanted))
        & (safe_int(quality) > 0)
    )


def is_first_step(stem: Column) -> Column:
    """Rows of step 0 carry no step marker in their image stem."""
    return ~F.contains(stem, F.lit("__step"))


# Fixed value: datasets whose captions are already part-level.
SKIP_DATASETS = ["instructpart"]


def route_skip(name: Column, skip: list[str] = SKIP_DATASETS) -> Column:
    hit = F.lit(False)
    for token in skip:
        hit = hit | F.contains(name, F.lit(token))
    return F.when(hit, "copy").otherwise("process")
