"""Judged candidates: ``lineitem`` rows scored with the priority of their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import answers, scoring
from sparkcurate.operators import gates, metrics, select
from sparkcurate.operators.match import lookup_join
from sparkcurate.operators.ranking import first_per_key
from sparkcurate.plans.registry import query, table

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
CAPS = {"keep_all": 20, "hard_caps": {"class_30": 10, "class_20": 50}}
ROW_SQL = ", ".join(ROW)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(*ROW, "l_returnflag")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    cls = F.floor(F.sqrt(F.col("l_partkey").cast("double")))
    priority = F.col("o_orderpriority")
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        *ROW,
        F.col("l_returnflag").alias("source_file"),
        F.concat(F.lit("class_"), cls.cast("string")).alias("target_object"),
        F.when(cls % 2 == 1, "wear").otherwise("grasp").alias("affordance"),
        (5 - F.col("l_partkey") % 3).alias("image_quality"),
        (F.col("l_suppkey") % 4).alias("clutter"),
        (5 - F.col("l_orderkey") % 3).alias("affordance_quality"),
        (3 - F.col("l_linenumber") % 3).alias("object_visible"),
        (3 - F.col("l_quantity").cast("int") % 3).alias("bbox_quality"),
        (3 - F.col("l_partkey") % 4).alias("parts_visibility"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 4 == 0), 1).otherwise(0).alias("bw_yellow_veto"),
        F.when(priority.startswith("1"), "high").when(priority.startswith("2"), "medium")
        .when(priority.startswith("3"), "low").otherwise("").alias("confidence"),
    )


CAND = f"""
raw AS (
  SELECT {ROW_SQL}, l_returnflag, o_orderpriority,
    CAST(floor(sqrt(l_partkey)) AS BIGINT) AS cls
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cand AS (
  SELECT {ROW_SQL}, l_returnflag AS source_file, 'class_' || cls AS target_object,
    CASE WHEN cls % 2 = 1 THEN 'wear' ELSE 'grasp' END AS affordance,
    5 - l_partkey % 3 AS image_quality, l_suppkey % 4 AS clutter,
    5 - l_orderkey % 3 AS affordance_quality, 3 - l_linenumber % 3 AS object_visible,
    3 - CAST(trunc(l_quantity) AS INT) % 3 AS bbox_quality, 3 - l_partkey % 4 AS parts_visibility,
    CASE WHEN l_returnflag = 'R' AND l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS bw_yellow_veto,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.65 WHEN '3' THEN 0.35 ELSE 0.0 END AS conf
  FROM raw),
ev AS (
  SELECT *, 0.45::DOUBLE * (affordance_quality / 5.0::DOUBLE) + 0.20::DOUBLE * (object_visible / 3.0::DOUBLE)
    + 0.20::DOUBLE * (bbox_quality / 3.0::DOUBLE) + 0.15::DOUBLE * (parts_visibility / 3.0::DOUBLE) AS e
  FROM cand),
scored AS (
  SELECT *, round(e, 6) AS eval_score, round(conf, 6) AS confidence_score,
    round(0.30::DOUBLE * (image_quality / 5.0::DOUBLE) + 0.40::DOUBLE * e
      + 0.15::DOUBLE * (1.0::DOUBLE - clutter / 5.0::DOUBLE) + 0.15::DOUBLE * conf, 6) AS final_score
  FROM ev),
cnt AS (SELECT target_object, count(*) AS n FROM scored GROUP BY 1),
st AS (
  SELECT target_object, n,
    CASE WHEN n <= 0 OR (SELECT max(n) FROM cnt) <= 1 THEN 0.0
         ELSE ln(1 + n) / ln(1 + (SELECT max(n) FROM cnt)) END AS s
  FROM cnt),
cuts AS (
  SELECT target_object, n, round(s, 6) AS strictness,
    CASE WHEN s < 0.35 THEN 3 ELSE 4 END AS min_image_quality,
    CASE WHEN s < 0.20 THEN 4 WHEN s < 0.65 THEN 3 ELSE 2 END AS max_clutter,
    CASE WHEN s < 0.40 THEN 3 ELSE 4 END AS min_affordance_quality,
    CASE WHEN s < 0.25 THEN 1 ELSE 2 END AS min_object_visible,
    CASE WHEN s < 0.25 THEN 1 ELSE 2 END AS min_bbox_quality,
    round(0.45 + 0.25 * s, 6) AS min_target_eval_score,
    round(0.52 + 0.23 * s, 6) AS min_final_score
  FROM st),
judged AS (
  SELECT *, CASE
      WHEN bw_yellow_veto = 1 THEN 'bw_yellow_veto'
      WHEN image_quality < min_image_quality THEN 'image_quality'
      WHEN clutter > max_clutter THEN 'clutter'
      WHEN affordance_quality < min_affordance_quality THEN 'target_affordance_quality'
      WHEN object_visible < min_object_visible THEN 'target_object_visible'
      WHEN bbox_quality < min_bbox_quality THEN 'target_bbox_quality'
      WHEN eval_score < min_target_eval_score THEN 'target_eval_score'
      WHEN final_score < min_final_score THEN 'final_score'
      ELSE 'pass' END AS reason
  FROM scored JOIN cuts USING (target_object)),
passed AS (SELECT * FROM judged WHERE reason = 'pass'),
cls AS (
  SELECT target_object, count(*) AS n_passed,
    arg_min(affordance, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey)) AS affordance
  FROM passed GROUP BY 1),
cap0 AS (
  SELECT *, CASE WHEN n_passed <= 20 THEN n_passed
    ELSE least(n_passed, CAST(round_even(20 + 12.0::DOUBLE * sqrt(n_passed - 20), 0) AS BIGINT)) END AS c0
  FROM cls),
cap1 AS (
  SELECT *, CASE WHEN affordance = 'wear' THEN CAST(floor(c0 * 0.55::DOUBLE) AS BIGINT) ELSE c0 END AS c1 FROM cap0),
caps AS (
  SELECT target_object, affordance, n_passed, greatest(1, least(n_passed,
    CASE target_object WHEN 'class_30' THEN least(c1, 10) WHEN 'class_20' THEN least(c1, 50) ELSE c1 END)) AS cap
  FROM cap1)
"""


def selection(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return select.adaptive_selection(candidates(spark, sf), ROW, **CAPS)


@query(
    "rebalance_topn",
    f"""WITH {CAND}, ranked AS (
      SELECT p.*, cap, row_number() OVER (PARTITION BY p.target_object ORDER BY final_score DESC, eval_score DESC,
        confidence_score DESC, image_quality DESC, clutter, {ROW_SQL}) AS class_rank
      FROM passed p JOIN caps ON p.target_object = caps.target_object)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, target_object, affordance, final_score, eval_score,
      confidence_score, strictness, n AS object_candidate_count, cap AS object_cap, class_rank
    FROM ranked WHERE class_rank <= cap""",
)
def rebalance_topn(spark: SparkSession, sf: str) -> DataFrame:
    return selection(spark, sf)["kept"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "target_object", "affordance", "final_score",
        "eval_score", "confidence_score", "strictness", F.col("n").alias("object_candidate_count"),
        F.col("cap").alias("object_cap"), "class_rank",
    )


@query(
    "score_rows",
    f"""WITH {CAND} SELECT {ROW_SQL}, target_object, eval_score, confidence_score, final_score FROM scored""",
)
def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    return select.score(candidates(spark, sf)).select(
        *ROW, "target_object", "eval_score", "confidence_score", "final_score"
    )


@query("adaptive_thresholds", f"WITH {CAND} SELECT * FROM cuts")
def adaptive_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return select.class_thresholds(candidates(spark, sf))


@query("reject_reason", f"WITH {CAND} SELECT {ROW_SQL}, target_object, reason FROM judged")
def reject_reason(spark: SparkSession, sf: str) -> DataFrame:
    scored = select.score(candidates(spark, sf))
    return select.judge(scored, select.class_thresholds(scored)).select(*ROW, "target_object", "reason")


@query("class_caps", f"WITH {CAND} SELECT target_object, affordance, n_passed, cap FROM caps")
def class_caps(spark: SparkSession, sf: str) -> DataFrame:
    scored = select.score(candidates(spark, sf))
    judged = select.judge(scored, select.class_thresholds(scored))
    return select.class_caps(judged.filter("reason = 'pass'"), ROW, **CAPS)


@query(
    "object_summary",
    f"""WITH {CAND}
    SELECT cnt.target_object, cnt.n AS matched, coalesce(n_passed, 0) AS passed, coalesce(cap, 0) AS cap,
      coalesce(least(cap, n_passed), 0) AS kept,
      round(coalesce(least(cap, n_passed), 0)::DOUBLE / cnt.n, 6) AS keep_ratio, coalesce(affordance, '') AS affordance
    FROM cnt LEFT JOIN caps ON cnt.target_object = caps.target_object""",
)
def object_summary(spark: SparkSession, sf: str) -> DataFrame:
    scored = select.score(candidates(spark, sf))
    cuts = select.class_thresholds(scored)
    passed = select.judge(scored, cuts).filter("reason = 'pass'")
    return select.object_summary({"cuts": cuts, "caps": select.class_caps(passed, ROW, **CAPS)})


@query(
    "funnel_rollup",
    f"""WITH {CAND}
    SELECT source_file, count(*) AS rows_in,
      count(*) FILTER (WHERE reason <> 'bw_yellow_veto') AS rows_no_veto,
      count(*) FILTER (WHERE reason NOT IN ('bw_yellow_veto', 'image_quality', 'clutter')) AS rows_imgpass,
      count(*) FILTER (WHERE reason IN ('pass', 'final_score')) AS rows_evalpass,
      count(*) FILTER (WHERE reason = 'pass') AS rows_passed
    FROM judged GROUP BY GROUPING SETS ((source_file), ())""",
)
def funnel_rollup(spark: SparkSession, sf: str) -> DataFrame:
    scored = select.score(candidates(spark, sf))
    judged = select.judge(scored, select.class_thresholds(scored))
    reason = F.col("reason")
    return metrics.funnel(
        judged,
        "source_file",
        {
            "rows_no_veto": reason != "bw_yellow_veto",
            "rows_imgpass": ~reason.isin("bw_yellow_veto", "image_quality", "clutter"),
            "rows_evalpass": reason.isin("pass", "final_score"),
            "rows_passed": reason == "pass",
        },
    )


@query(
    "quality_gate",
    f"""WITH r AS (SELECT {ROW_SQL},
        CASE WHEN l_returnflag = 'R' AND l_linenumber % 4 = 0 THEN '1' WHEN l_linenumber = 7 THEN NULL ELSE '0' END AS veto,
        CASE WHEN l_partkey % 11 = 0 THEN 'n/a' ELSE CAST(l_partkey % 6 AS VARCHAR) END AS iq,
        CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_suppkey % 6 AS VARCHAR) END AS cl FROM lineitem)
    SELECT {ROW_SQL}, iq AS image_quality, cl AS clutter FROM r
    WHERE coalesce(try_cast(veto AS INT), 0) = 0 AND coalesce(try_cast(iq AS INT), 0) >= 2
      AND coalesce(try_cast(cl AS INT), 0) <= 4""",
)
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    veto = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 4 == 0), "1")
        .when(F.col("l_linenumber") == 7, None).otherwise("0")
    )
    iq = F.when(F.col("l_partkey") % 11 == 0, "n/a").otherwise((F.col("l_partkey") % 6).cast("string"))
    cl = F.when(F.col("l_suppkey") % 13 == 0, None).otherwise((F.col("l_suppkey") % 6).cast("string"))
    return table(spark, sf, "lineitem").filter(gates.image_gate(veto, iq, cl)).select(
        *ROW, iq.alias("image_quality"), cl.alias("clutter")
    )


@query(
    "count_join",
    f"""SELECT {ROW_SQL}, l_linestatus AS object, o_orderpriority AS confidence, o_orderkey IS NOT NULL AS found
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND lower(l_linestatus) = lower(o_orderstatus)""",
)
def count_join(spark: SparkSession, sf: str) -> DataFrame:
    keep = table(spark, sf, "lineitem").select(
        *ROW, F.col("l_linestatus").alias("object"), F.col("l_orderkey").alias("image"),
        F.lower("l_linestatus").alias("name"),
    )
    counts = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image"), F.lower("o_orderstatus").alias("name"),
        F.col("o_orderpriority").alias("confidence"),
    )
    counts = first_per_key(counts, ["image", "name"], [F.col("confidence")])
    return lookup_join(keep, counts, ["image", "name"]).select(*ROW, "object", "confidence", "found")


@query(
    "count_agreement",
    f"""WITH j AS (SELECT {ROW_SQL}, l_returnflag <> 'R' AS keep_ok,
        CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN true ELSE l_linenumber % 2 = 0 END AS count_ok,
        CASE WHEN o_custkey % 7 = 6 THEN 'more_than_5' ELSE CAST(o_custkey % 7 AS VARCHAR) END AS estimated_count
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT {ROW_SQL}, estimated_count FROM j
    WHERE keep_ok AND coalesce(count_ok, false) AND estimated_count = CAST(l_linenumber AS VARCHAR)""",
)
def count_agreement(spark: SparkSession, sf: str) -> DataFrame:
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    li = table(spark, sf, "lineitem").select(*ROW, "l_returnflag")
    count_ok = (
        F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderstatus") == "F", True)
        .otherwise(F.col("l_linenumber") % 2 == 0)
    )
    estimated = F.when(F.col("o_custkey") % 7 == 6, "more_than_5").otherwise((F.col("o_custkey") % 7).cast("string"))
    agree = gates.counts_agree(
        F.col("l_returnflag") != "R", count_ok, F.col("l_orderkey").cast("string"), estimated, F.col("l_linenumber")
    )
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).filter(agree).select(
        *ROW, estimated.alias("estimated_count")
    )


@query(
    "best_eval",
    f"""WITH rec AS (SELECT o_orderkey,
        CASE o_orderstatus WHEN 'F' THEN ' a' WHEN 'O' THEN 'N' ELSE '' END AS target,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'R' ELSE '' END AS matched FROM orders),
    e AS (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag AS object,
        round(0.45::DOUBLE * ((5 - l_partkey % 6) / 5.0::DOUBLE) + 0.20::DOUBLE * ((3 - l_linenumber % 4) / 3.0::DOUBLE)
        + 0.20::DOUBLE * ((3 - l_suppkey % 4) / 3.0::DOUBLE) + 0.15::DOUBLE * ((3 - l_partkey % 4) / 3.0::DOUBLE), 6) AS score
      FROM rec JOIN lineitem ON l_orderkey = o_orderkey
      WHERE (trim(target) <> '' AND lower(l_returnflag) = lower(trim(target)))
         OR (matched <> '' AND lower(l_returnflag) = lower(matched)))
    SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, object, score FROM e
    QUALIFY row_number() OVER (PARTITION BY o_orderkey
      ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""",
)
def best_eval(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rec = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "F", " a").when(status == "O", "N").otherwise("").alias("target"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "R").otherwise("").alias("matched"),
    )
    ev = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_returnflag").alias("object"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("position"),
        F.round(
            scoring.eval_score(
                5 - F.col("l_partkey") % 6, 3 - F.col("l_linenumber") % 4, 3 - F.col("l_suppkey") % 4,
                3 - F.col("l_partkey") % 4,
            ), 6,
        ).alias("score"),
    )
    best = select.best_evaluation(rec.join(ev, "o_orderkey"), ["o_orderkey"], "score", "position", ["target", "matched"])
    return best.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "object", "score")


@query(
    "dedupe_best",
    f"""WITH r AS (SELECT {ROW_SQL}, lower(l_returnflag) AS object,
        CASE l_suppkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.65 WHEN 2 THEN 0.35 ELSE 0.0 END AS confidence
      FROM lineitem)
    SELECT l_orderkey, object, confidence, l_linenumber, l_partkey, l_suppkey FROM r
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, object ORDER BY confidence DESC, {ROW_SQL}) = 1""",
)
def dedupe_best(spark: SparkSession, sf: str) -> DataFrame:
    level = F.col("l_suppkey") % 4
    word = F.when(level == 0, "High ").when(level == 1, "medium").when(level == 2, "LOW").otherwise("unknown")
    rows = table(spark, sf, "lineitem").select(
        *ROW, F.lower("l_returnflag").alias("object"), scoring.confidence_score(word).alias("confidence")
    )
    best = first_per_key(rows, ["l_orderkey", "object"], [F.col("confidence").desc(), *[F.col(c) for c in ROW]])
    return best.select("l_orderkey", "object", "confidence", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "target_parts",
    f"""WITH j AS (SELECT l.*, CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'N' ELSE 'R' END AS target,
        CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'f' END AS aff
      FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)
    SELECT {ROW_SQL}, l_returnflag AS object, l_linestatus AS affordance FROM j
    WHERE lower(l_returnflag) = lower(target) AND (aff = '' OR lower(l_linestatus) = aff) AND l_linenumber % 3 > 0""",
)
def target_parts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    od = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "F", "a").when(status == "O", "N").otherwise("R").alias("target"),
        F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("f").alias("aff"),
    )
    li = table(spark, sf, "lineitem").select(*ROW, "l_returnflag", "l_linestatus")
    hit = gates.targets(
        F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber") % 3, F.col("target"), F.col("aff")
    )
    return li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).filter(hit).select(
        *ROW, F.col("l_returnflag").alias("object"), F.col("l_linestatus").alias("affordance")
    )


@query(
    "target_fallback",
    """SELECT o_orderkey,
      CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus
           WHEN o_orderkey % 2 = 0 THEN o_orderpriority
           WHEN o_custkey % 2 = 0 THEN o_orderstatus || '!' ELSE '' END AS object,
      CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 5 + 1 WHEN 1 THEN o_custkey % 5 + 1 ELSE o_custkey % 9 END AS source_count
    FROM orders""",
)
def target_fallback(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    keep = F.when(key % 3 != 0, F.concat(F.lit(" "), "o_orderstatus")).when(key % 2 == 0, "  ")
    first = F.when(key % 2 == 0, F.col("o_orderpriority")).otherwise(" ")
    second = F.when(cust % 2 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise("")
    evals = F.array(F.struct(first.alias("object")), F.struct(second.alias("object")))
    count = F.when(key % 4 == 0, None).when(key % 4 == 1, "x").otherwise((cust % 9).cast("string"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        answers.target_object(keep, evals).alias("object"),
        answers.source_count(count, cust % 5 + 1).alias("source_count"),
    )
