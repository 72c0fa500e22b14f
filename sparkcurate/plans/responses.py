"""Raw responses: texts of several shapes built around ``events.props`` and whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import answers, names
from sparkcurate.operators import gates, match
from sparkcurate.plans.registry import query, table
from sparkcurate.session import new_path
from sparkcurate.sources import jsonl
from sparkcurate.streaming import ingest as streams


def pick(n: int, *values) -> Column:
    """The value for ``event_id % n``; the last one is the default."""
    out, slot = None, F.col("event_id") % n
    for i, v in enumerate(values[:-1]):
        v = v if isinstance(v, Column) or v is None else F.lit(v)
        out = F.when(slot == i, v) if out is None else out.when(slot == i, v)
    last = values[-1]
    return out.otherwise(last if isinstance(last, Column) or last is None else F.lit(last))


def pick_sql(n: int, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE event_id % {n} {whens} ELSE {values[-1]} END"


# Whole texts of documents stand in answers too; their numbers follow those of the events.
DOC_IDS = 10_000_000_000
_UNQUOTED = r'[\x00-\x1F"\\]'  # what a JSON string must escape


def doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as ``event_id``, ``source``, ``text`` as it is, and ``said``, which can stand in quotes."""
    said = F.regexp_replace("text", _UNQUOTED, " ")
    return table(spark, sf, "documents").select((F.col("doc_id") + DOC_IDS).alias("event_id"), "source", "text", said.alias("said"))


DOC_TEXTS = f"""(SELECT doc_id + {DOC_IDS} AS event_id, source, text,
    regexp_replace(text, '{_UNQUOTED}', ' ', 'g') AS said FROM documents)"""


def quoted(before: str, after: str) -> Column:
    """``said`` between two pieces of a JSON text."""
    return F.concat(F.lit(before), "said", F.lit(after))


LINE = pick_sql(
    5, "props", "'   '", """'{"k": '""", "'[1, 2]'",
    """'  {"k": ' || event_id || ', "image_path": "img_' || user_id || '"} '""",
)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    record = F.concat(
        F.lit('  {"k": '), F.col("event_id").cast("string"), F.lit(', "image_path": "img_'),
        F.col("user_id").cast("string"), F.lit('"} '),
    )
    return table(spark, sf, "events").select(
        F.lit("events").alias("src_file"), F.col("event_id").alias("src_line"),
        pick(5, F.col("props"), "   ", '{"k": ', "[1, 2]", record).alias("value"),
    )


@query(
    "jsonl_lenient_scan",
    f"""WITH r AS (SELECT event_id, trim({LINE}) AS v FROM events)
    SELECT event_id AS src_line, CAST(v ->> 'k' AS BIGINT) AS k, v ->> 'image_path' AS image_path
    FROM (SELECT event_id, CASE WHEN json_valid(v) THEN v END AS v FROM r)
    WHERE json_type(v) = 'OBJECT'""",
)
def jsonl_lenient_scan(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.typed(lines(spark, sf), "k BIGINT, image_path STRING").select("src_line", "k", "image_path")


@query(
    "manifest_scan_audit",
    f"""WITH r AS (SELECT trim({LINE}) AS v FROM events),
    k AS (SELECT CASE WHEN json_valid(v) AND json_type(CASE WHEN json_valid(v) THEN v END) = 'OBJECT'
        THEN nullif(v ->> 'image_path', '') END AS key FROM r WHERE v <> '')
    SELECT count(*) AS total, count(*) FILTER (WHERE key IS NULL) AS bad, count(DISTINCT key) AS indexed FROM k""",
)
def manifest_scan_audit(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.scan_audit(lines(spark, sf), answers.field(F.col("value"), "image_path"))


REPLY = pick_sql(
    7, "'<answer>' || props || '</answer>'", "'noise ' || props || ' tail'",
    """'<answer>not json</answer> but {"k": 1} here'""", "'no braces'", """'<answer> {"k": 5'""", "'} {'",
    """'  <answer>{"a": [1, {"b": 2}]}</answer> <answer>{"x": 1}</answer>'""",
)


def reply() -> Column:
    return pick(
        7, F.concat(F.lit("<answer>"), "props", F.lit("</answer>")), F.concat(F.lit("noise "), "props", F.lit(" tail")),
        '<answer>not json</answer> but {"k": 1} here', "no braces", '<answer> {"k": 5', "} {",
        '  <answer>{"a": [1, {"b": 2}]}</answer> <answer>{"x": 1}</answer>',
    )


DOC_REPLY = pick_sql(
    4, """'<answer>{"said": "' || said || '"}</answer>'""", """text || ' {"said": "' || said || '"} ' || text""",
    "'<answer>' || text || '</answer>'", "text",
)


@query(
    "answer_extract",
    f"""WITH r AS (SELECT event_id, trim({REPLY}) AS t FROM events
      UNION ALL SELECT event_id, trim({DOC_REPLY}) FROM {DOC_TEXTS}),
    p AS (SELECT event_id, CASE WHEN contains(t, '<answer>')
          THEN trim(split_part(split_part(t, '<answer>', 2), '</answer>', 1)) END AS inside,
        nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '') AS span FROM r)
    SELECT event_id, CASE WHEN json_valid(inside) THEN inside WHEN json_valid(span) THEN span END AS answer FROM p""",
)
def answer_extract(spark: SparkSession, sf: str) -> DataFrame:
    said = quoted('{"said": "', '"}')
    long = pick(
        4, F.concat(F.lit("<answer>"), said, F.lit("</answer>")), F.concat("text", F.lit(" "), said, F.lit(" "), "text"),
        F.concat(F.lit("<answer>"), "text", F.lit("</answer>")), F.col("text"),
    )
    rows = table(spark, sf, "events").select("event_id", reply().alias("raw"))
    rows = rows.union(doc_texts(spark, sf).select("event_id", long))
    return rows.select("event_id", answers.answer_json(F.col("raw")).alias("answer"))


FENCED = pick_sql(
    6, "'```json' || chr(10) || props || chr(10) || '```'", "'``` ' || props || '```'", "props",
    "'Sure: ' || props || ' done'", "'nothing'", "'```json {broken```'",
)


DOC_FENCED = pick_sql(
    3, """'```json' || chr(10) || '{"said": "' || said || '"}' || chr(10) || '```'""", """text || '{"said": "' || said || '"}'""",
    "'``` ' || text || ' ```'",
)


@query(
    "fence_extract",
    f"""WITH f AS (SELECT event_id, {FENCED} AS t FROM events UNION ALL SELECT event_id, {DOC_FENCED} FROM {DOC_TEXTS}),
    r AS (SELECT event_id, regexp_replace(regexp_replace(trim(t), '^```(?:json)?\\s*', ''), '\\s*```$', '') AS t FROM f)
    SELECT event_id, CASE WHEN json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '(?s)\\{{.*\\}}'))
      THEN regexp_extract(t, '(?s)\\{{.*\\}}') END AS answer FROM r""",
)
def fence_extract(spark: SparkSession, sf: str) -> DataFrame:
    raw = pick(
        6, F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("``` "), "props", F.lit("```")),
        F.col("props"), F.concat(F.lit("Sure: "), "props", F.lit(" done")), "nothing", "```json {broken```",
    )
    said = quoted('{"said": "', '"}')
    long = pick(
        3, F.concat(F.lit("```json\n"), said, F.lit("\n```")), F.concat("text", said), F.concat(F.lit("``` "), "text", F.lit(" ```"))
    )
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw")).union(doc_texts(spark, sf).select("event_id", long))
    return rows.select("event_id", answers.fenced_json(F.col("raw")).alias("answer"))


VERDICT_TEXTS = [
    "<answer>yes</answer>", "<answer> Yes </answer>", "I would say\nYES", "No.", "maybe", "<answer>no",
    "it is not, yes or no", "yes indeed it does",
]


DOC_VERDICT = pick_sql(
    5, "text", "text || chr(10) || 'Yes.'", "'<answer> yes </answer>' || text", "text || '<answer>No</answer>'",
    "'yes, but ' || text",
)


@query(
    "yes_no_verdict",
    f"""WITH r AS (SELECT event_id, replace(replace({pick_sql(8, *["'" + t.replace(chr(10), "' || chr(10) || '") + "'" for t in VERDICT_TEXTS])},
        ' ', ''), chr(10), '') AS t FROM events
      UNION ALL SELECT event_id, replace(replace({DOC_VERDICT}, ' ', ''), chr(10), '') FROM {DOC_TEXTS}),
    v AS (SELECT event_id, CASE WHEN contains(t, '<answer>') THEN split_part(split_part(t, '<answer>', 2), '<', 1)
        WHEN contains(lower(right(t, 5)), 'yes') THEN 'yes' ELSE 'no' END AS verdict FROM r)
    SELECT event_id, verdict, verdict = 'yes' AS is_yes FROM v""",
)
def yes_no_verdict(spark: SparkSession, sf: str) -> DataFrame:
    long = pick(
        5, F.col("text"), F.concat("text", F.lit("\nYes.")), F.concat(F.lit("<answer> yes </answer>"), "text"),
        F.concat("text", F.lit("<answer>No</answer>")), F.concat(F.lit("yes, but "), "text"),
    )
    rows = table(spark, sf, "events").select("event_id", pick(8, *VERDICT_TEXTS).alias("raw"))
    rows = rows.union(doc_texts(spark, sf).select("event_id", long))
    verdict = answers.yes_no(F.col("raw"))
    return rows.select("event_id", verdict.alias("verdict"), (verdict == "yes").alias("is_yes"))


TASK_DOCS = [
    '{"object_name": "mug", "part_name": "handle", "affordance": "grasp", "tasks": ["a", "b", "c", "d", "e", "f"]}',
    '{"part_name": "rim", "tasks": "wipe the rim"}',
    "{}",
    "not json at all",
]
TASK_ROWS = [
    ("'mug'", "'handle'", "'grasp'", "'a|b|c|d|e'", "false"),
    ("event_type", "'rim'", "'use'", "'wipe the rim'", "false"),
    ("event_type", "event_type", "'use'", "''", "false"),
    ("event_type", "event_type", "'use'", "'use the ' || event_type", "true"),
]


@query(
    "default_result",
    "SELECT event_id, " + ", ".join(
        f"{pick_sql(4, *[r[i] for r in TASK_ROWS]) if i != 1 else 'CASE WHEN event_id % 10 = 0 THEN ' + repr('spout') + ' ELSE ' + pick_sql(4, *[r[1] for r in TASK_ROWS]) + ' END'} AS {n}"
        for i, n in enumerate(["object_name", "part_name", "affordance", "tasks", "parse_error"])
    )
    + f""" FROM events UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 2 THEN source ELSE coalesce(said, source) END,
      CASE WHEN event_id % 10 = 0 THEN 'spout' WHEN said IS NULL OR event_id % 3 = 2 THEN source ELSE 'rim' END, 'use',
      CASE WHEN said IS NULL OR event_id % 3 = 2 THEN 'use the ' || source WHEN event_id % 3 = 0 THEN said
        ELSE said || '|b' END, said IS NULL OR event_id % 3 = 2 FROM {DOC_TEXTS}""",
)
def default_result(spark: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("event_id") % 10 == 0, "spout")
    named, tasks = quoted('{"object_name": "', '", "part_name": "rim", "tasks": '), quoted('"', '"')
    long = pick(
        3, F.concat(named, tasks, F.lit("}")), F.concat(F.lit("```json "), named, F.lit("["), tasks, F.lit(', "b"]}```')),
        F.concat(named, F.lit("["), tasks),
    )
    rows = table(spark, sf, "events").select("event_id", "event_type", pick(4, *TASK_DOCS).alias("raw"))
    rows = rows.union(doc_texts(spark, sf).select("event_id", "source", long))
    rows = rows.select("event_id", "event_type", answers.parsed(answers.fenced_json(F.col("raw"))).alias("tree"))
    got = answers.default_answer(F.col("tree"), F.col("event_type"), known)
    got["tasks"] = F.array_join(got["tasks"], "|")
    return rows.select("event_id", *[c.alias(n) for n, c in got.items()])


COUNT_REPLY = pick_sql(
    8, """'<answer>{"estimated_count": "' || event_id % 7 || '", "confidence": "High", "reason": "seen"}</answer>'""",
    """'{"estimated_count": ' || user_id % 8 || ', "confidence": "low", "reason": "x"}'""",
    """'{"estimated_count": "more_than_5", "confidence": " medium ", "reason": "many"}'""",
    """'{"estimated_count": "2", "confidence": "sure", "reason": "x"}'""",
    """'{"estimated_count": "2", "confidence": "low", "reason": "  "}'""",
    """'{"estimated_count": "2", "confidence": "low"}'""", "'[1, 2]'", "'garbage'",
)


DOC_COUNT = pick_sql(
    4, """'{"estimated_count": "3", "confidence": "low", "reason": "' || said || '"}'""",
    """'Here: {"estimated_count": "' || said || '", "confidence": "low", "reason": "x"} as asked'""",
    """'<answer>{"estimated_count": "1", "confidence": "' || said || '", "reason": "x"}</answer>'""", "text",
)


def count_replies(spark: SparkSession, sf: str) -> DataFrame:
    raw = pick(
        8,
        F.concat(F.lit('<answer>{"estimated_count": "'), (F.col("event_id") % 7).cast("string"),
                 F.lit('", "confidence": "High", "reason": "seen"}</answer>')),
        F.concat(F.lit('{"estimated_count": '), (F.col("user_id") % 8).cast("string"),
                 F.lit(', "confidence": "low", "reason": "x"}')),
        '{"estimated_count": "more_than_5", "confidence": " medium ", "reason": "many"}',
        '{"estimated_count": "2", "confidence": "sure", "reason": "x"}',
        '{"estimated_count": "2", "confidence": "low", "reason": "  "}',
        '{"estimated_count": "2", "confidence": "low"}', "[1, 2]", "garbage",
    )
    tree = answers.answer_tree(F.col("raw"))
    long = pick(
        4, quoted('{"estimated_count": "3", "confidence": "low", "reason": "', '"}'),
        quoted('Here: {"estimated_count": "', '", "confidence": "low", "reason": "x"} as asked'),
        quoted('<answer>{"estimated_count": "1", "confidence": "', '", "reason": "x"}</answer>'), F.col("text"),
    )
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw")).union(doc_texts(spark, sf).select("event_id", long))
    rows = rows.select("event_id", tree.alias("tree"))
    rows = rows.select(
        "event_id", answers.is_object(F.col("tree")).alias("parsed"),
        *[names.clean(answers.get(F.col("tree"), f)).alias(f) for f in ("estimated_count", "confidence", "reason")],
    )
    rows = rows.withColumn(
        "error_msg",
        F.when(~F.col("parsed"), "parse_fail").otherwise(
            answers.count_error(F.col("estimated_count"), F.col("confidence"), F.col("reason"))
        ),
    )
    msg = F.col("error_msg")
    return rows.select(
        "event_id",
        F.when(msg.isNull(), 0).when(msg == "parse_fail", 1).otherwise(2).alias("error_code"),
        "error_msg",
        F.when(msg.isNull(), F.lower("estimated_count")).alias("estimated_count"),
    )


COUNT_CHECK = f"""r AS (SELECT event_id, {COUNT_REPLY} AS t FROM events UNION ALL SELECT event_id, {DOC_COUNT} FROM {DOC_TEXTS}),
    d AS (SELECT event_id, CASE WHEN contains(t, '<answer>') THEN regexp_extract(t, '(?s)<answer>(.*)</answer>', 1)
      WHEN json_valid(t) THEN t ELSE regexp_extract(t, '(?s)\\{{.*\\}}') END AS d FROM r),
    j AS (SELECT event_id, CASE WHEN json_valid(d) AND starts_with(d, '{{') THEN d END AS d FROM d),
    f AS (SELECT event_id, d, lower(trim(coalesce(d ->> 'estimated_count', ''))) AS est,
        lower(trim(coalesce(d ->> 'confidence', ''))) AS conf, trim(coalesce(d ->> 'reason', '')) AS reason FROM j),
    v AS (SELECT event_id, est, CASE WHEN d IS NULL THEN 'parse_fail'
        WHEN est NOT IN ('0', '1', '2', '3', '4', '5', 'more_than_5') THEN 'estimated_count_invalid'
        WHEN conf NOT IN ('low', 'medium', 'high') THEN 'confidence_invalid'
        WHEN reason = '' THEN 'reason_empty' END AS error_msg FROM f)"""


@query(
    "answer_validate",
    f"""WITH {COUNT_CHECK} SELECT event_id,
      CASE WHEN error_msg IS NULL THEN 0 WHEN error_msg = 'parse_fail' THEN 1 ELSE 2 END AS error_code, error_msg,
      CASE WHEN error_msg IS NULL THEN est END AS estimated_count FROM v""",
)
def answer_validate(spark: SparkSession, sf: str) -> DataFrame:
    return count_replies(spark, sf)


@query(
    "outcome_stats",
    f"""WITH {COUNT_CHECK} SELECT count(*) AS total, count(*) FILTER (WHERE error_msg IS NULL) AS ok,
      count(*) FILTER (WHERE error_msg = 'parse_fail') AS parse_fail,
      count(*) FILTER (WHERE error_msg = 'estimated_count_invalid') AS estimated_count_invalid,
      count(*) FILTER (WHERE error_msg = 'confidence_invalid') AS confidence_invalid,
      count(*) FILTER (WHERE error_msg = 'reason_empty') AS reason_empty FROM v""",
)
def outcome_stats(spark: SparkSession, sf: str) -> DataFrame:
    msg = F.col("error_msg")
    kinds = ["parse_fail", "estimated_count_invalid", "confidence_invalid", "reason_empty"]
    return count_replies(spark, sf).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(msg.isNull()).alias("ok"),
        *[F.count_if(msg == k).alias(k) for k in kinds],
    )


UID_SQL = """md5('{"image_path": "img_' || user_id || '", "object": "' || event_type || '"}')"""


def with_uid(df: DataFrame) -> DataFrame:
    image = F.concat(F.lit("img_"), F.col("user_id").cast("string"))
    return df.withColumn("uid", answers.row_uid(object=F.col("event_type"), image_path=image))


@query(
    "todo_antijoin",
    f"""WITH e AS (SELECT event_id, user_id, event_type, value, {UID_SQL} AS uid FROM events)
    SELECT uid, min(event_id) AS event_id FROM e
    WHERE uid NOT IN (SELECT uid FROM e WHERE value > 100) GROUP BY uid""",
)
def todo_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    # a ledger row counts whatever its outcome was: failed responses are handled too
    rows = with_uid(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"))
    ledger = rows.filter("value > 100").select("uid").distinct()
    return match.todo(rows, ledger, "uid", [F.col("event_id")]).select("uid", "event_id")


@query(
    "append_ledger",
    f"""WITH e AS (SELECT event_id, hour(ts) // 8 AS batch, {UID_SQL} AS uid FROM events)
    SELECT uid, event_id FROM e QUALIFY row_number() OVER (PARTITION BY uid ORDER BY batch, event_id) = 1""",
)
def append_ledger(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_uid(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"))
    feed, sink, state = (new_path(spark, n) for n in ("responses", "ledger", "ledger-state"))
    third = F.floor(F.hour("ts") / 8)
    for batch in (0, 1, 2, 2):  # the last batch arrives twice, as after a failure
        rows.filter(third == batch).select("uid", "event_id").write.mode("append").parquet(feed)
        arriving = spark.readStream.schema("uid STRING, event_id BIGINT").parquet(feed)
        streams.ingest(arriving, sink, state, "uid", ["event_id"])
    return streams.handled(spark, sink)


ITEM = "array<struct<affordance:string,parts:array<string>,exists:boolean>>"


def item(affordance: str, parts: list[str], exists) -> Column:
    return F.struct(
        F.lit(affordance).alias("affordance"), F.array(*[F.lit(p) for p in parts]).alias("parts"),
        F.lit(exists).cast("boolean").alias("exists"),
    )


def nested(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("event_id") % 2 == 0
    chosen = F.array(item("open", ["lid", "Whole_Object", " "], None), item("close", ["handle"], False))
    judged = F.array(item("lift", ["rim", "base"], True), item("cut", ["edge"], False), item("", ["x"], True))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("rec_id"),
        (F.col("event_id") % 7 != 5).alias("ok"),
        F.concat(F.lit(" img_"), F.col("user_id").cast("string")).alias("image_path"),
        F.col("event_type").alias("object"),
        F.when(even, F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string"))).otherwise(" ").alias("part"),
        F.when(even, "press").alias("affordance"),
        F.when(F.col("event_id") % 3 == 0, F.array().cast(ITEM)).otherwise(chosen).alias("selected"),
        judged.alias("judged"),
    )


@query(
    "positive_selection",
    """SELECT event_id AS rec_id, CASE WHEN event_id % 3 = 0 THEN 'lift,' ELSE 'open' END AS affordances,
      CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS n FROM events""",
)
def positive_selection(spark: SparkSession, sf: str) -> DataFrame:
    kept = gates.positive_affordances(F.col("selected"), F.col("judged"))
    return nested(spark, sf).select(
        "rec_id", F.array_join(kept["affordance"], ",").alias("affordances"), F.size(kept).alias("n")
    )


@query(
    "flat_or_nested",
    """WITH e AS (SELECT event_id AS rec_id, 'img_' || user_id AS image_path, event_type AS object FROM events)
    SELECT rec_id, image_path, object, 'p' || rec_id % 4 AS part, 'press' AS affordance, 'rec:' || rec_id AS source
    FROM e WHERE rec_id % 2 = 0
    UNION ALL SELECT rec_id, image_path, object, 'lid', 'open', 'rec:' || rec_id || ':a0:p0' FROM e
    WHERE rec_id % 2 = 1 AND rec_id % 7 <> 5 AND rec_id % 3 <> 0
    UNION ALL SELECT rec_id, image_path, object, p, 'lift', 'rec:' || rec_id || ':a0:p' || i
    FROM e, (VALUES ('rim', 0), ('base', 1)) AS v(p, i) WHERE rec_id % 2 = 1 AND rec_id % 7 <> 5 AND rec_id % 3 = 0""",
)
def flat_or_nested(spark: SparkSession, sf: str) -> DataFrame:
    return gates.flat_or_nested(nested(spark, sf), skip_whole=True)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    # As a pattern the path may be one file or a folder of parts; a plain one must be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


@query(
    "stream_ingest",
    f"""SELECT DISTINCT {UID_SQL} AS uid, 'img_' || user_id AS image_path, event_type AS object FROM events""",
)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    sink, state = new_path(spark, "responses"), new_path(spark, "responses-state")

    def prepare(batch: DataFrame) -> DataFrame:
        rows = with_uid(batch)
        return rows.select(
            "uid", F.concat(F.lit("img_"), F.col("user_id").cast("string")).alias("image_path"),
            F.col("event_type").alias("object"),
        )

    for _ in range(2):  # the second run resumes and finds nothing new
        streams.ingest(event_stream(spark, sf), sink, state, "uid", ["image_path", "object"], prepare)
    return streams.handled(spark, sink)


@query("stream_dedupe", f"SELECT DISTINCT {UID_SQL} AS uid FROM events")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    sink, state = new_path(spark, "dedupe"), new_path(spark, "dedupe-state")
    streams.ingest(event_stream(spark, sf), sink, state, "uid", ["uid"], lambda batch: with_uid(batch).select("uid"))
    return streams.handled(spark, sink)
