"""Click trajectories: ``events`` of a user in time order. A trajectory is a user's week,
or, for the run queries, the events from one sign-up to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import answers, checks, geometry, paths, templates
from sparkcurate.operators import gates, match, metrics, regroup, sequence
from sparkcurate.operators.blocks import time_block
from sparkcurate.plans.registry import ORACLES, query, table
from sparkcurate.session import materialise
from sparkcurate.sources import documents

KEYS, ORDER = ["user_id", "week"], ["ts", "event_id"]
W, H = 641, 487


def overlap_share() -> Column:
    """A value of 0..1 that grows with ``value``. The constants keep two-decimal texts
    away from exact ties, which engines round differently."""
    return F.col("value") / (F.col("value") + 37.123457)


def steps(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    union = (1000 + F.col("event_id") % 50).cast("bigint")
    iou = overlap_share()
    return table(spark, sf, "events").select(
        "user_id", F.floor(day / 7).alias("week"), "ts", "event_id", "event_type", "value", time_block("ts").alias("block"),
        iou.alias("iou"), F.col("event_type").isin("click", "purchase").alias("is_positive"),
        (F.col("event_id") % 7).cast("int").alias("x"), (F.col("event_id") % 5).cast("int").alias("y"),
        F.floor(iou * union).alias("inter"), union.alias("union"),
    )


S = """s AS (SELECT user_id, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS week, ts, event_id, event_type,
    (value / (value + 37.123457::DOUBLE)) AS iou, event_type IN ('click', 'purchase') AS is_positive, event_id % 7 AS x, event_id % 5 AS y,
    CAST(floor((value / (value + 37.123457::DOUBLE)) * (1000 + event_id % 50)) AS BIGINT) AS inter, 1000 + event_id % 50 AS uni,
    row_number() OVER (PARTITION BY user_id, floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) ORDER BY ts, event_id) - 1 AS step
  FROM events)"""
T = "PARTITION BY user_id, week ORDER BY ts, event_id"


RUNS = """r AS (SELECT user_id, event_id, ts, value, event_type,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c,
    first_value(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events),
  runs AS (SELECT user_id, event_id, value, event_type, CAST(c - CASE WHEN f THEN 1 ELSE 0 END AS BIGINT) AS traj FROM r)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.islands(
        steps(spark, sf).select("user_id", "ts", "event_id", "event_type", "block", "value"),
        ["user_id"], "block", ORDER, F.col("event_type") == "signup",
    )


@query("traj_islands", f"WITH {RUNS} SELECT user_id, event_id, traj FROM runs")
def traj_islands(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).select("user_id", "event_id", "traj")


@query(
    "traj_by_key",
    f"""WITH {RUNS}, k AS (SELECT user_id, traj FROM runs WHERE event_type = 'signup' AND value > 150)
    SELECT user_id, traj, event_id FROM runs WHERE (user_id, traj) IN (SELECT (user_id, traj) FROM k)""",
)
def traj_by_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = steps(spark, sf).select("user_id", "ts", "event_id", "event_type", "block", "value")
    start = F.col("event_type") == "signup"
    found = sequence.runs_by_start(rows, ["user_id"], "block", ORDER, start, F.col("value") > 150)
    return found.select("user_id", "traj", "event_id")


@query(
    "step_lag",
    f"WITH {S} SELECT event_id, round(iou, 6) AS next_iou, round(coalesce(lag(iou) OVER ({T}), 0.0), 6) AS current_iou FROM s",
)
def step_lag(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequence.previous_value(steps(spark, sf), KEYS, "block", ORDER, "iou", "prev")
    return rows.select("event_id", F.round("iou", 6).alias("next_iou"), F.round("prev", 6).alias("current_iou"))


@query(
    "monotone_prefix",
    f"""WITH {S}, d AS (SELECT *, iou < lag(iou) OVER ({T}) AS down FROM s),
    f AS (SELECT user_id, week, min(step) AS stop FROM d WHERE down GROUP BY 1, 2)
    SELECT user_id, week, event_id FROM s LEFT JOIN f USING (user_id, week) WHERE stop IS NULL OR step < stop""",
)
def monotone_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.monotone_prefix(steps(spark, sf), KEYS, "block", ORDER, "iou").select("user_id", "week", "event_id")


@query(
    "stuck_prefix",
    f"""WITH {S}, d AS (SELECT *, abs(x - lag(x) OVER ({T})) <= 2 AND abs(y - lag(y) OVER ({T})) <= 2
        AND is_positive = lag(is_positive) OVER ({T}) AS stuck FROM s),
    f AS (SELECT user_id, week, min(step) AS stop FROM d WHERE stuck GROUP BY 1, 2)
    SELECT user_id, week, event_id FROM s LEFT JOIN f USING (user_id, week) WHERE stop IS NULL OR step < stop""",
)
def stuck_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.stuck_prefix(steps(spark, sf), KEYS, "block", ORDER).select("user_id", "week", "event_id")


@query(
    "peak_trim",
    f"""WITH {S}, v AS (SELECT *, round(iou, 1) AS q FROM s),
    p AS (SELECT *, max(q) OVER ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM v),
    e AS (SELECT user_id, week, min(step) AS stop FROM p WHERE q >= 0.9 OR q < peak GROUP BY 1, 2),
    k AS (SELECT p.user_id, p.week, stop, q < 0.9 AS is_drop, peak FROM p JOIN e ON p.user_id = e.user_id AND p.week = e.week AND step = stop),
    b AS (SELECT k.user_id, k.week, is_drop, stop, (SELECT min(step) FROM p WHERE p.user_id = k.user_id AND p.week = k.week AND q = k.peak) AS best FROM k)
    SELECT user_id, week, event_id FROM p LEFT JOIN b USING (user_id, week)
    WHERE stop IS NULL OR (NOT is_drop AND step <= stop) OR (is_drop AND step <= best)""",
)
def peak_trim(spark: SparkSession, sf: str) -> DataFrame:
    rows = steps(spark, sf).withColumn("q", F.round("iou", 1))  # coarse values, so peaks repeat
    return sequence.peak_trim(rows, KEYS, "block", ORDER, "q", stop=0.9).select("user_id", "week", "event_id")


@query(
    "running_list",
    f"""WITH {S} SELECT event_id, step // 20 AS page, string_agg(x || ':' || y || CASE WHEN is_positive THEN '+' ELSE '-' END, ' ')
      OVER (PARTITION BY user_id, week, step // 20 ORDER BY step) AS clicks FROM s""",
)
def running_list(spark: SparkSession, sf: str) -> DataFrame:
    sign = F.when(F.col("is_positive"), "+").otherwise("-")
    click = F.concat(F.col("x").cast("string"), F.lit(":"), F.col("y").cast("string"), sign)
    rows = sequence.accumulated(steps(spark, sf), KEYS, "block", ORDER, click, "clicks")
    return rows.select("event_id", "page", F.array_join("clicks", " ").alias("clicks"))


@query(
    "traj_final_gate",
    f"""WITH {S} SELECT user_id, week, round(arg_max(iou, step), 6) AS final_iou FROM s GROUP BY 1, 2 HAVING arg_max(iou, step) >= 0.7""",
)
def traj_final_gate(spark: SparkSession, sf: str) -> DataFrame:
    last = steps(spark, sf).groupBy(*KEYS).agg(F.max_by("iou", F.struct(*ORDER)).alias("iou"))
    return last.filter("iou >= 0.7").select(*KEYS, F.round("iou", 6).alias("final_iou"))


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequence.step_numbers(steps(spark, sf), KEYS, "block", ORDER)
    return sequence.summarise(rows, KEYS, ORDER, "iou", "step", ["inter", "union"])


SUMMARY = f"""{S}, m AS (SELECT user_id, week, count(*) AS num_steps, max(iou) AS best_iou, arg_max(iou, step) AS final_iou,
    arg_min(iou, step) AS step0_iou, arg_max(inter, step) AS final_inter, arg_max(uni, step) AS final_union,
    arg_min(inter, step) AS step0_inter, arg_min(uni, step) AS step0_union FROM s GROUP BY 1, 2),
  b AS (SELECT s.user_id, s.week, min(step) AS best_step FROM s JOIN m ON s.user_id = m.user_id AND s.week = m.week AND s.iou = m.best_iou GROUP BY 1, 2),
  sm AS (SELECT m.*, b.best_step, s.inter AS best_inter, s.uni AS best_union FROM m JOIN b USING (user_id, week)
    JOIN s ON s.user_id = m.user_id AND s.week = m.week AND s.step = b.best_step)"""


@query(
    "traj_best_step",
    f"""WITH {SUMMARY} SELECT user_id, week, num_steps, best_step, round(best_iou, 6) AS best_iou, round(final_iou, 6) AS final_iou,
      round(step0_iou, 6) AS step0_iou, best_inter, best_union, best_iou >= 0.5 AS success_at_50 FROM sm""",
)
def traj_best_step(spark: SparkSession, sf: str) -> DataFrame:
    return summaries(spark, sf).select(
        *KEYS, "num_steps", "best_step", *[F.round(c, 6).alias(c) for c in ("best_iou", "final_iou", "step0_iou")],
        "best_inter", "best_union", (F.col("best_iou") >= 0.5).alias("success_at_50"),
    )


def metric_sql(k: str) -> str:
    grid = " + ".join(f"avg(CASE WHEN {k}_iou >= {t}::DOUBLE THEN 1.0 ELSE 0.0 END)" for t in metrics.IOU_THRESHOLDS)
    return f"""round(avg({k}_iou) * 100, 6) AS {k}_giou, round(sum({k}_inter) / sum({k}_union) * 100, 6) AS {k}_ciou,
      round(avg(CASE WHEN {k}_iou >= 0.5 THEN 1.0 ELSE 0.0 END) * 100, 6) AS {k}_p50, round(({grid}) / 10 * 100, 6) AS {k}_p50_95"""


@query(
    "iou_metrics",
    f"""WITH {SUMMARY} SELECT count(*) AS evaluated, {metric_sql('best')}, {metric_sql('step0')}, {metric_sql('final')},
      round(avg(best_iou - step0_iou) * 100, 6) AS refinement_gain FROM sm""",
)
def iou_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.iou_metrics(summaries(spark, sf))


def image_path() -> Column:
    mark = F.when(F.col("event_type") == "signup", "").otherwise(
        F.concat(F.lit("__step"), (F.col("event_id") % 9).cast("string"))
    )
    return F.concat(F.lit("crops/img_"), F.col("event_id").cast("string"), mark, F.lit(".jpg"))


@query("step0_rows", "SELECT event_id, 'crops/img_' || event_id || '.jpg' AS path FROM events WHERE event_type = 'signup'")
def step0_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", image_path().alias("path"))
    return rows.filter(gates.is_first_step(paths.stem(F.col("path"))))


@query(
    "oversample",
    """SELECT event_id, c AS copy FROM events, (VALUES (1), (2), (3)) AS v(c) WHERE event_type = 'signup' OR c = 1""",
)
def oversample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", image_path().alias("path"))
    return regroup.oversample(rows, gates.is_first_step(paths.stem(F.col("path")))).select("event_id", "copy")


REQUEST_SQL = "'" + templates.REQUEST_TEXT.split("{description}")[0].replace("\n", "' || chr(10) || '") + "' || event_type || '</ref>'"
ANSWER_SQL = """'<ref>' || event_type || '</ref> Current IOU: ' || printf('%.2f', (value / (2 * value + 73.123457::DOUBLE))) || ', '
  || CASE WHEN event_type IN ('click', 'purchase') THEN 'Positive' ELSE 'Negative' END || ' point: ('
  || CAST(trunc((event_id % 7) / 641.0::DOUBLE * 1000) AS INT) || ', ' || CAST(trunc((event_id % 5) / 487.0::DOUBLE * 1000) AS INT)
  || '), Predicted next IOU: ' || printf('%.2f', (value / (value + 37.123457::DOUBLE)))"""


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("event_type")
    x, y = geometry.to_thousand(F.col("x"), F.lit(W)), geometry.to_thousand(F.col("y"), F.lit(H))
    answer = templates.answer_text(text, F.col("value") / (2 * F.col("value") + 73.123457), F.col("is_positive"), x, y, F.col("iou"))
    rows = table(spark, sf, "events").select(
        "event_id", "event_type", "value", (overlap_share()).alias("iou"),
        text.isin("click", "purchase").alias("is_positive"), (F.col("event_id") % 7).alias("x"), (F.col("event_id") % 5).alias("y"),
    )
    return rows.select("event_id", "event_type", templates.request_text(text).alias("request"), answer.alias("answer"), image_path().alias("path"))


@query(
    "render_chat",
    f"""SELECT event_id, 'user' AS first_role, {REQUEST_SQL} AS request, {ANSWER_SQL} AS answer,
      'crops/img_' || event_id || CASE WHEN event_type = 'signup' THEN '' ELSE '__step' || event_id % 9 END || '.jpg' AS image FROM events""",
)
def render_chat(spark: SparkSession, sf: str) -> DataFrame:
    rows = rendered(spark, sf).select(
        "event_id", *templates.chat_record(F.col("request"), F.col("answer"), F.col("path"))
    )
    return rows.select(
        "event_id", F.col("messages")[0]["role"].alias("first_role"), F.col("messages")[0]["content"].alias("request"),
        F.col("messages")[1]["content"].alias("answer"), F.col("images")[0].alias("image"),
    )


def noisy() -> Column:
    """Rendered answers, some cut short or broken."""
    a, slot = F.col("answer"), F.col("event_id") % 5
    return (
        F.when(slot == 1, F.regexp_replace(a, ", Predicted.*$", ""))
        .when(slot == 2, F.concat(F.lit("Sure. "), a))
        .when(slot == 3, F.lower(a))
        .otherwise(a)
    )


@query(
    "parse_answer",
    """SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN event_type END AS description,
      CASE WHEN event_id % 5 <> 3 THEN CAST(printf('%.2f', (value / (2 * value + 73.123457::DOUBLE))) AS DOUBLE) END AS current_iou,
      CASE WHEN event_id % 5 <> 3 THEN event_type IN ('click', 'purchase') END AS is_positive,
      CASE WHEN event_id % 5 <> 3 THEN CAST(trunc((event_id % 7) / 641.0::DOUBLE * 1000) AS INT) END AS x_norm,
      CASE WHEN event_id % 5 <> 3 THEN CAST(trunc((event_id % 5) / 487.0::DOUBLE * 1000) AS INT) END AS y_norm,
      CASE WHEN event_id % 5 NOT IN (1, 3) THEN CAST(printf('%.2f', (value / (value + 37.123457::DOUBLE))) AS DOUBLE) END AS next_iou FROM events""",
)
def parse_answer(spark: SparkSession, sf: str) -> DataFrame:
    rows = rendered(spark, sf).select("event_id", noisy().alias("text"))
    return answers.with_click(rows, "text").drop("text")


FAULTS = [
    ("missing_key", "missing_key"),
    ("one_message", "message_count"),
    ("two_images", "image_count"),
    ("lost_image", "image_not_found"),
    ("no_tag", "no_image_tag"),
    ("no_ref", "no_user_ref"),
    ("blank_ref", "empty_description"),
    ("other_ref", "description_mismatch"),
    ("bad_answer", "bad_answer"),
    ("big_iou", "current_iou_out_of_range,next_iou_out_of_range"),
    ("far_point", "coordinate_range"),
    ("odd_number", "invalid_current_iou"),
]


def fault(i: int) -> Column:
    return (F.col("event_type") == "error") & (F.col("event_id") % len(FAULTS) == i)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Training records; those of ``error`` events carry one fault each."""
    at = {name: fault(i) for i, (name, _) in enumerate(FAULTS)}
    a, r = F.col("answer"), F.col("request")
    request = (
        F.when(at["no_tag"], F.replace(r, F.lit("<image>"), F.lit("")))
        .when(at["no_ref"], F.regexp_replace(r, "<ref>.*</ref>", ""))
        .when(at["blank_ref"], F.regexp_replace(r, "<ref>.*</ref>", "<ref> </ref>"))
        .when(at["other_ref"], F.regexp_replace(r, "<ref>.*</ref>", "<ref>other</ref>"))
        .otherwise(r)
    )
    answer = (
        F.when(at["bad_answer"], F.concat(F.lit(" "), a))
        .when(at["big_iou"], F.regexp_replace(a, r"IOU: [0-9.]+", "IOU: 1.20"))
        .when(at["far_point"], F.regexp_replace(a, r"point: \(\d+", "point: (1001"))
        .when(at["odd_number"], F.regexp_replace(a, r"Current IOU: [0-9.]+", "Current IOU: 0.1.2"))
        .otherwise(a)
    )
    messages, images = templates.chat_record(F.col("request"), F.col("answer"), F.col("path"))
    path = F.when(at["lost_image"], F.concat(F.lit("lost/"), "path")).otherwise(F.col("path"))
    made = rendered(spark, sf).withColumns({"request": request, "answer": answer, "path": path})
    made = made.select("event_id", "event_type", "path", messages, images)
    return made.select(
        "event_id", "path",
        F.when(fault(0), None).when(fault(1), F.slice("messages", 1, 1)).otherwise(F.col("messages")).alias("messages"),
        F.when(fault(2), F.concat("images", "images")).otherwise(F.col("images")).alias("images"),
    )


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Image files that are there."""
    return table(spark, sf, "events").select(image_path().alias("path"), F.lit(True).alias("there")).distinct()


def checked(spark: SparkSession, sf: str) -> DataFrame:
    # the record file that a writer left behind, read by the validator
    written = materialise(records(spark, sf), "records")
    rows = written.join(inventory(spark, sf), "path", "left")
    return checks.with_chat_errors(rows.withColumn("there", F.coalesce("there", F.lit(False))), "there")


@query(
    "validate_records",
    f"SELECT event_id, CASE WHEN event_type <> 'error' THEN '' ELSE CASE event_id % {len(FAULTS)} "
    + " ".join(f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(FAULTS))
    + " END END AS errors, event_type <> 'error' AS valid FROM events",
)
def validate_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = checked(spark, sf)
    return rows.select("event_id", F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid"))


VALID_CLICKS = """v AS (SELECT CASE WHEN event_type IN ('click', 'purchase') THEN 'Positive' ELSE 'Negative' END AS click_type,
        floor(CAST(printf('%.2f', (value / (2 * value + 73.123457::DOUBLE))) AS DOUBLE) * 10) / 10 AS iou_bin,
        CAST(trunc((event_id % 7) / 641.0::DOUBLE * 1000) AS INT) AS x, CAST(trunc((event_id % 5) / 487.0::DOUBLE * 1000) AS INT) AS y
      FROM events WHERE event_type <> 'error')"""


@query(
    "validation_profile",
    f"""WITH {VALID_CLICKS} SELECT click_type, iou_bin, count(*) AS n, min(x) AS min_x, max(x) AS max_x, round(avg(x), 6) AS mean_x,
      min(y) AS min_y, max(y) AS max_y, round(avg(y), 6) AS mean_y FROM v GROUP BY 1, 2""",
)
def validation_profile(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.validation_profile(valid_clicks(spark, sf), "sign", "current_iou", "x_norm", "y_norm")


@query(
    "profile_summary",
    f"""WITH {VALID_CLICKS} SELECT coalesce(click_type, 'all') AS click_type, count(*) AS n,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v), 6) AS share, min(x) AS min_x, max(x) AS max_x, round(avg(x), 6) AS mean_x,
      min(y) AS min_y, max(y) AS max_y, round(avg(y), 6) AS mean_y FROM v GROUP BY ROLLUP (click_type)""",
)
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.profile_summary(valid_clicks(spark, sf), "sign", "x_norm", "y_norm")


def valid_clicks(spark: SparkSession, sf: str) -> DataFrame:
    # a filter on the computed errors would be pushed below them and repeat all the work
    report = materialise(checked(spark, sf).select("messages", "errors"), "checked")
    valid = report.filter(F.size("errors") == 0).select(F.col("messages")[1]["content"].alias("text"))
    return answers.with_click(valid, "text").withColumn("sign", templates.click_sign(F.col("is_positive")))


@query(
    "coord_scale",
    """SELECT event_id, CAST(trunc((event_id % 641) / 641.0::DOUBLE * 1000) AS INT) AS x_norm,
      greatest(0, least(CAST(trunc(CAST(trunc((event_id % 641) / 641.0::DOUBLE * 1000) AS INT) / 1000.0::DOUBLE * 641) AS INT), 640)) AS x_back,
      greatest(0, least(CAST(trunc((event_id % 1300) / 1000.0::DOUBLE * 487) AS INT), 486)) AS y_clamped FROM events""",
)
def coord_scale(spark: SparkSession, sf: str) -> DataFrame:
    x = geometry.to_thousand(F.col("event_id") % W, F.lit(W))
    rows = table(spark, sf, "events").select("event_id", x.alias("x_norm"))
    return rows.select(
        "event_id", "x_norm", geometry.from_thousand(F.col("x_norm"), F.lit(W)).alias("x_back"),
        geometry.from_thousand(F.col("event_id") % 1300, F.lit(H)).alias("y_clamped"),
    )


@query(
    "click_to_crop",
    """WITH c AS (SELECT event_id, event_id % 200 AS px, event_id % 150 AS py, event_id % 40 AS x1, event_id % 30 AS y1,
        event_id % 40 + 100 AS x2, event_id % 30 + 80 AS y2 FROM events)
    SELECT event_id, px - x1 AS x, py - y1 AS y FROM c WHERE px >= x1 AND py >= y1 AND px < x2 AND py < y2""",
)
def click_to_crop(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    x, y, inside = geometry.into_crop(e % 200, e % 150, [e % 40, e % 30, e % 40 + 100, e % 30 + 80])
    return table(spark, sf, "events").filter(inside).select("event_id", x.alias("x"), y.alias("y"))


@query(
    "overlay_plan",
    f"""WITH {S}, o AS (SELECT *, lag(event_id) OVER ({T}) AS mask_of FROM s)
    SELECT user_id, week, step, mask_of, 'u' || user_id || '_' || week || '__step' || step || '.jpg' AS name FROM o WHERE step > 0
      AND 'u' || user_id || '_' || week || '__step' || step || '.jpg' NOT IN
        (SELECT 'u' || user_id || '_' || week || '__step' || (event_id % 4) || '.jpg' FROM s WHERE event_type = 'view')""",
)
def overlay_plan(spark: SparkSession, sf: str) -> DataFrame:
    def name(step: Column) -> Column:
        return F.concat(
            F.lit("u"), F.col("user_id").cast("string"), F.lit("_"), F.col("week").cast("string"), F.lit("__step"),
            step.cast("string"), F.lit(".jpg"),
        )

    rows = steps(spark, sf)
    existing = rows.filter("event_type = 'view'").select(name(F.col("event_id") % 4).alias("name")).distinct()
    plan = sequence.overlay_plan(rows, KEYS, "block", ORDER, "event_id", name(F.col("step")), existing)
    return plan.select(*KEYS, "step", "mask_of", "name")


@query(
    "traj_lookup",
    """WITH idx AS (SELECT CASE WHEN value > 300 THEN 'img_' ELSE 'old_' END || user_id AS image, event_type AS caption, event_id FROM events
      QUALIFY row_number() OVER (PARTITION BY value > 300, user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
    q AS (SELECT DISTINCT 'img_' || user_id AS image, event_type AS caption FROM events)
    SELECT q.image, q.caption, idx.event_id, CASE WHEN idx.event_id IS NULL THEN 'missing' ELSE 'match' END AS status
    FROM q LEFT JOIN idx USING (image, caption)""",
)
def traj_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return looked_up(spark, sf)


@query(
    "traj_misses",
    f"""WITH t AS ({ORACLES["traj_lookup"]}), m AS (SELECT image, caption FROM t WHERE status = 'missing')
    SELECT 0 AS rank, NULL::VARCHAR AS image, NULL::VARCHAR AS caption, count(*) AS n_missing FROM m
    UNION ALL SELECT CAST(row_number() OVER (ORDER BY image, caption) AS INT), image, caption, NULL FROM m
    QUALIFY row_number() OVER (ORDER BY image, caption) <= 8""",
)
def traj_misses(spark: SparkSession, sf: str) -> DataFrame:
    return match.miss_report(looked_up(spark, sf), F.col("status") == "missing", ["image", "caption"])


def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("img_"), F.col("user_id").cast("string")).alias("image"), F.col("event_type").alias("caption"),
        "event_id", "ts", "value",
    )
    old = F.regexp_replace("image", "^img_", "old_")  # images that nobody asks for
    stored = rows.withColumn("image", F.when(F.col("value") > 300, F.col("image")).otherwise(old))
    index = regroup.last_per_key(stored, ["image", "caption"], ["ts", "event_id"])
    asked = rows.select("image", "caption").distinct()
    found = asked.join(index.select("image", "caption", "event_id"), ["image", "caption"], "left")
    return found.withColumn("status", F.when(F.col("event_id").isNull(), "missing").otherwise("match"))


@query(
    "traj_scan",
    """SELECT 'f' || event_id || '.json' AS source_file, 'img_' || user_id AS image_name, event_type AS caption, 480 AS height,
      round((value / (value + 37.123457::DOUBLE)), 6) AS final_iou, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS n_clicks FROM events WHERE event_type NOT IN ('error', 'signup')""",
)
def traj_scan(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    click = F.struct(F.lit(0).alias("idx"), F.lit(True).alias("is_positive"), (overlap_share()).alias("iou"))
    item = F.struct(
        F.when(kind == "signup", "").otherwise(F.concat(F.lit("img_"), F.col("user_id").cast("string"))).alias("image_name"),
        F.lit(480).alias("height"), F.struct(F.col("event_type").alias("caption")).alias("gt_ann"),
        F.when(kind == "view", F.array(click, click)).otherwise(F.array(click)).alias("clicks_list"),
    )
    text = (
        F.when(kind == "view", F.to_json(F.array(item)))
        .when(kind == "error", F.lit("{broken"))
        .otherwise(F.to_json(F.struct(F.struct(F.lit(1).alias("v")).alias("info"), F.array(item).alias("data"))))
    )
    docs = table(spark, sf, "events").select(
        text.alias("value"), F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".json")).alias("source_file")
    )
    items = documents.trajectory_items(docs)
    return items.select(
        "source_file", "image_name", F.col("gt_ann.caption").alias("caption"), "height",
        F.round(F.element_at("clicks_list", -1)["iou"], 6).alias("final_iou"), F.size("clicks_list").alias("n_clicks"),
    )
