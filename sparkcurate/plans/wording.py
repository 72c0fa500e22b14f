"""Names and sentences built from ``part``: object is the second word of ``p_name``, part
the first, affordance ``p_type`` or a fixed list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import answers, checks, names, templates
from sparkcurate.operators import gates, match, metrics, regroup
from sparkcurate.plans.registry import ORACLES, query, table

AFFORDANCES = [*templates.CAN_PHRASES, "Scoop", "Type_on"]


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]"


def sql_case(key: str, mapping: dict[str, str], other: str) -> str:
    whens = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in mapping.items())
    return f"CASE {key} {whens} ELSE {other} END"


AFF_SQL = f"{sql_list(AFFORDANCES)}[p_partkey % 20 + 1]"
KEY = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', ' ', 'g'))"


def affordance() -> Column:
    return F.get(F.array(*[F.lit(a) for a in AFFORDANCES]), (F.col("p_partkey") % 20).cast("int"))


def choose(n: int, *values) -> Column:
    out, slot = None, F.col("p_partkey") % n
    for i, v in enumerate(values[:-1]):
        v = v if isinstance(v, Column) or v is None else F.lit(v)
        out = F.when(slot == i, v) if out is None else out.when(slot == i, v)
    last = values[-1]
    return out.otherwise(last if isinstance(last, Column) or last is None else F.lit(last))


def choose_sql(n: int, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE p_partkey % {n} {whens} ELSE {values[-1]} END"


def parts(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select(
        "p_partkey", words[1].alias("object"), words[0].alias("part"), *extra
    )


PARTS = "SELECT *, split_part(p_name, ' ', 2) AS object, split_part(p_name, ' ', 1) AS part FROM part"

MESSY = "'  ' || p_name || '  ' || upper(p_type) || '_' || p_brand || chr(10) || ' of the'"


@query(
    "normalisers",
    f"""WITH t AS (SELECT p_partkey, {MESSY} AS t FROM part), c AS (SELECT p_partkey, trim(t, ' ' || chr(10)) AS t FROM t)
    SELECT p_partkey, lower(t) AS lowered, regexp_replace(lower(t), '\\s+', ' ', 'g') AS squeezed,
      {KEY.format('t')} AS words,
      trim(regexp_replace(lower(replace(t, '_', ' ')), '\\s+', ' ', 'g')) AS label,
      CASE WHEN p_partkey % 9 = 0 THEN 'unnamed'
           ELSE substr(trim(regexp_replace(lower(t || t || t), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80) END AS slug,
      regexp_replace(t, '\\s+', '_', 'g') AS underscored,
      array_to_string(list_sort(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+'))), ',') AS tokens,
      array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')),
        lambda x: x NOT IN ('of', 'the', 'a', 'an', 'with', 'on', 'in', 'at', 'to', 'for'))), ',') AS content
    FROM c""",
)
def normalisers(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.lit("  "), "p_name", F.lit("  "), F.upper("p_type"), F.lit("_"), "p_brand", F.lit("\n of the")
    )
    t = F.col("t")
    thrice = F.when(F.col("p_partkey") % 9 == 0, "#!").otherwise(F.concat(names.clean(t), names.clean(t), names.clean(t)))
    return table(spark, sf, "part").select("p_partkey", text.alias("t")).select(
        "p_partkey",
        names.lower_name(t).alias("lowered"),
        names.squeezed_name(t).alias("squeezed"),
        names.word_key(t).alias("words"),
        names.label_key(t).alias("label"),
        names.slug(thrice).alias("slug"),
        names.underscored(t).alias("underscored"),
        F.array_join(F.array_sort(names.tokens(t)), ",").alias("tokens"),
        F.array_join(F.array_sort(names.content_tokens(t)), ",").alias("content"),
    )


@query(
    "sanitise_text",
    """SELECT p_partkey, trim(regexp_replace(trim(' ,.;: ' || p_name || '  ' || p_type || ' ;., '), '\\s+', ' ', 'g'), ' ,.;:') AS text
    FROM part""",
)
def sanitise_text(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit(" ,.;: "), "p_name", F.lit("  "), "p_type", F.lit(" ;., "))
    return table(spark, sf, "part").select("p_partkey", names.sanitise(text).alias("text"))


LONG = " ".join(["very"] * 15)
PHRASE_SQL = sql_case("aff", templates.CAN_PHRASES, "lower(aff) || 'ed'")


@query(
    "query_repair",
    f"""WITH p AS ({PARTS}),
    t AS (SELECT p_partkey, object, part, {AFF_SQL} AS aff,
        {choose_sql(6, "' The ' || upper(part) || ' of the  ' || object || '.'", "part || ' ' || object", f"part || ' of the {LONG} ' || object", "''", "'lid of the ' || object", "part || '-of-' || object")} AS q1,
        {choose_sql(4, "'the ' || part || ' of the ' || object || ' that can be held'", "part || ' of the ' || object", "'that can ' || object", "NULL")} AS q2
      FROM p),
    k AS (SELECT *, {KEY.format("coalesce(q1, '')")} AS n1, {KEY.format("coalesce(q2, '')")} AS n2,
        trim(regexp_replace(trim(coalesce(q1, '')), '\\s+', ' ', 'g'), ' ,.;:') AS c1,
        trim(regexp_replace(trim(coalesce(q2, '')), '\\s+', ' ', 'g'), ' ,.;:') AS c2 FROM t),
    v AS (SELECT *, n1 <> '' AND contains(n1, object) AND contains(n1, part) AND contains(' ' || n1 || ' ', ' of ')
          AND len(string_split(n1, ' ')) <= 16 AS ok1,
        n2 <> '' AND contains(n2, object) AND contains(n2, part) AND contains(' ' || n2 || ' ', ' of ')
          AND len(string_split(n2, ' ')) <= 16 AND contains(' ' || n2 || ' ', ' that can ') AS ok2 FROM k)
    SELECT p_partkey, CASE WHEN ok1 THEN c1 ELSE part || ' of the ' || object END AS query_direct,
      CASE WHEN ok2 THEN c2 ELSE 'the ' || part || ' of the ' || object || ' that can be ' || {PHRASE_SQL} END AS query_affordance,
      NOT ok1 AS repaired_q1, NOT ok2 AS repaired_q2 FROM v""",
)
def query_repair(spark: SparkSession, sf: str) -> DataFrame:
    obj, part = F.col("object"), F.col("part")
    q1 = choose(
        6, F.concat(F.lit(" The "), F.upper(part), F.lit(" of the  "), obj, F.lit(".")), F.concat(part, F.lit(" "), obj),
        F.concat(part, F.lit(f" of the {LONG} "), obj), "", F.concat(F.lit("lid of the "), obj),
        F.concat(part, F.lit("-of-"), obj),
    )
    q2 = choose(
        4, F.concat(F.lit("the "), part, F.lit(" of the "), obj, F.lit(" that can be held")),
        F.concat(part, F.lit(" of the "), obj), F.concat(F.lit("that can "), obj), None,
    )
    rows = parts(spark, sf).select("*", affordance().alias("aff"), q1.alias("q1"), q2.alias("q2"))
    return checks.with_queries(rows, "q1", "q2", affordance="aff").select(
        "p_partkey", "query_direct", "query_affordance", "repaired_q1", "repaired_q2"
    )


TASK_SQL = "replace(" + sql_case("aff", templates.TASK_FALLBACKS, sql_text(templates.TASK_DEFAULT)) + ", '{obj}', object)"
INSTRUCTION_TEXTS = [
    ("'Open the ' || object || '.'", lambda o, p: F.concat(F.lit("Open the "), o, F.lit("."))),
    ("'Grab ' || part || ' ' || object", lambda o, p: F.concat(F.lit("Grab "), p, F.lit(" "), o)),
    ("'Use the ' || object", lambda o, p: F.concat(F.lit("Use the "), o)),
    ("'Go'", lambda o, p: F.lit("Go")),
    ("'Take hold of ' || object", lambda o, p: F.concat(F.lit("Take hold of "), o)),
    ("'Flush it now'", lambda o, p: F.lit("Flush it now")),
    (f"'{LONG} {LONG} ' || object", lambda o, p: F.concat(F.lit(f"{LONG} {LONG} "), o)),
]
ACTION_SQL = choose_sql(5, "''", "'use'", "' sit  on '", "'light up'", "NULL")


def error_sql(text: str) -> str:
    n = KEY.format(text)
    return f"""CASE WHEN len(string_split({n}, ' ')) < 2 OR {n} = '' THEN 'too_short'
      WHEN len(string_split({n}, ' ')) > 16 THEN 'too_long'
      WHEN contains({n}, part) THEN 'contains_part'
      WHEN contains(' ' || {n} || ' ', ' of ') THEN 'contains_of_pattern'
      WHEN NOT contains({n}, object) THEN 'missing_object'
      WHEN starts_with({n}, 'use the ') AND coalesce({KEY.format("action")}, '') <> 'use' THEN 'generic_use' END"""


@query(
    "instruction_repair",
    f"""WITH p AS (SELECT p_partkey, object, CASE WHEN p_partkey % 3 = 0 THEN 'on' ELSE part END AS part, {AFF_SQL} AS aff,
        {choose_sql(7, *[t for t, _ in INSTRUCTION_TEXTS])} AS raw, {ACTION_SQL} AS action FROM ({PARTS})),
    t AS (SELECT *, trim(raw, ' ,.;:') AS c, trim(regexp_replace(trim(coalesce(action, '')), '\\s+', ' ', 'g')) AS act FROM p),
    f AS (SELECT *, CASE WHEN act <> '' THEN upper(act[1]) || substr(act, 2) || ' the ' || object ELSE {TASK_SQL} END AS spare FROM t),
    e AS (SELECT *, {error_sql('c')} AS e1, {error_sql('spare')} AS e2 FROM f)
    SELECT p_partkey, e1 IS NULL OR e2 IS NULL AS ok,
      CASE WHEN e1 IS NULL THEN c WHEN e2 IS NULL THEN spare END AS instruction,
      e1 IS NOT NULL AND e2 IS NULL AS repaired,
      CASE WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN e1 || '|fallback:' || e2 END AS error_msg FROM e""",
)
def instruction_repair(spark: SparkSession, sf: str) -> DataFrame:
    obj, part = F.col("object"), F.col("part")
    rows = parts(spark, sf).select(
        "*", affordance().alias("aff"), choose(7, *[f(obj, part) for _, f in INSTRUCTION_TEXTS]).alias("raw"),
        choose(5, "", "use", " sit  on ", "light up", None).alias("action"),
    )
    rows = rows.withColumn("part", F.when(F.col("p_partkey") % 3 == 0, "on").otherwise(part))
    return checks.with_instruction(rows, "raw", affordance="aff").select(
        "p_partkey", F.col("valid").alias("ok"), "instruction", "repaired", F.col("instruction_error").alias("error_msg")
    )


@query(
    "repair_stats",
    f"""SELECT 'instruction' AS kind, count(*) AS total, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE repaired) AS repaired,
      count(*) FILTER (WHERE NOT ok) AS rejected, NULL::BIGINT AS repaired_q1, NULL::BIGINT AS repaired_q2 FROM ({ORACLES["instruction_repair"]})
    UNION ALL SELECT 'query', count(*), count(*), NULL, NULL, count(*) FILTER (WHERE repaired_q1), count(*) FILTER (WHERE repaired_q2)
    FROM ({ORACLES["query_repair"]})""",
)
def repair_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    tasks = metrics.outcome_counts(instruction_repair(spark, sf), ok=c("ok"), repaired=c("repaired"), rejected=~c("ok"))
    asked = metrics.outcome_counts(
        query_repair(spark, sf), ok=F.lit(True), repaired_q1=c("repaired_q1"), repaired_q2=c("repaired_q2")
    )
    return tasks.withColumn("kind", F.lit("instruction")).unionByName(asked.withColumn("kind", F.lit("query")), True)


@query(
    "template_lookup",
    f"""WITH p AS (SELECT p_partkey, object, {AFF_SQL} AS aff FROM ({PARTS}))
    SELECT p_partkey, {PHRASE_SQL} AS phrase, {TASK_SQL} AS task,
      {sql_case("lower(aff)", templates.ACTIONS, "replace(lower(aff), '_', ' ')")} AS action FROM p""",
)
def template_lookup(spark: SparkSession, sf: str) -> DataFrame:
    aff = F.col("aff")
    return parts(spark, sf).select("p_partkey", "object", affordance().alias("aff")).select(
        "p_partkey", templates.can_phrase(aff).alias("phrase"), templates.task_sentence(F.col("object"), aff).alias("task"),
        templates.action_of(aff).alias("action"),
    )


@query(
    "caption_compose",
    f"""WITH p AS (SELECT p_partkey, {choose_sql(5, "p_type", "''", "NULL", "''", "''")} AS cap,
        {choose_sql(5, "part", "part", "''", "NULL", "''")} AS part, {choose_sql(5, "object", "object", "object", "''", "''")} AS object,
        part AS p0 FROM ({PARTS}))
    SELECT p_partkey, CASE WHEN coalesce(cap, '') <> '' THEN cap
      WHEN coalesce(part, '') <> '' AND object <> '' THEN part || ' of the ' || object
      WHEN object <> '' THEN object WHEN coalesce(part, '') <> '' THEN part ELSE 'the target object' END AS caption FROM p""",
)
def caption_compose(spark: SparkSession, sf: str) -> DataFrame:
    p, o = F.col("part"), F.col("object")
    cap = templates.compose_caption(
        choose(5, F.col("p_type"), "", None, "", ""), choose(5, p, p, "", None, ""), choose(5, o, o, o, "", "")
    )
    return parts(spark, sf, "p_type").select("p_partkey", cap.alias("caption"))


@query(
    "caption_repair",
    f"""WITH p AS (SELECT p_partkey, p_name, {choose_sql(5, "'<think>hm' || chr(10) || 'ok</think> ' || part || ' OF THE ' || object", "part || ' '", "'<think>only</think>  '", "NULL", "'<think>a</think>x<think>b</think>y'")} AS g
      FROM ({PARTS})),
    t AS (SELECT *, nullif(trim(regexp_replace(g, '(?s)<think>.*?</think>', '', 'g')), '') AS x FROM p),
    n AS (SELECT p_partkey, p_name, CASE WHEN x IS NULL THEN p_name WHEN contains(lower(x), 'of the') THEN x
      ELSE x || ' of the ' || p_name END AS caption FROM t)
    SELECT p_partkey, caption, CASE WHEN caption <> p_name THEN p_name END AS original_caption FROM n""",
)
def caption_repair(spark: SparkSession, sf: str) -> DataFrame:
    p, o = F.col("part"), F.col("object")
    text = choose(
        5, F.concat(F.lit("<think>hm\nok</think> "), p, F.lit(" OF THE "), o), F.concat(p, F.lit(" ")),
        "<think>only</think>  ", None, "<think>a</think>x<think>b</think>y",
    )
    rows = parts(spark, sf, "p_name").select(
        "p_partkey", "p_name", checks.repair_caption(F.col("p_name"), text).alias("caption")
    )
    changed = F.col("caption") != F.col("p_name")
    return rows.select("p_partkey", "caption", F.when(changed, F.col("p_name")).alias("original_caption"))


@query(
    "row_uid",
    f"""WITH p AS ({PARTS}) SELECT p_partkey, md5('{{"affordance": "' || p_type || '", "image_path": "' || p_brand || '", "object": "' || object
      || '", "part": "' || part || '", "source": "part:' || p_partkey || '"}}') AS uid FROM p""",
)
def row_uid(spark: SparkSession, sf: str) -> DataFrame:
    uid = answers.row_uid(
        image_path=F.col("p_brand"), object=F.col("object"), part=F.col("part"), affordance=F.col("p_type"),
        source=F.concat(F.lit("part:"), F.col("p_partkey").cast("string")),
    )
    return parts(spark, sf, "p_brand", "p_type").select("p_partkey", uid.alias("uid"))


@query(
    "token_match",
    f"""WITH p AS (SELECT p_partkey, p_brand, object, part || ' ' || lower(p_type) AS part,
        {choose_sql(6, "part || ' ' || lower(p_type) || ' of the ' || object", "part || ' of the ' || object", "object || ' for ' || part", "'tiny ' || object", "'The'", "lower(p_type)")} AS description,
        CASE WHEN p_partkey % 17 = 0 THEN 'Brand#99' ELSE p_brand END AS image FROM ({PARTS})),
    q AS (SELECT DISTINCT image, description, list_sort(list_distinct(regexp_extract_all(lower(description), '[a-z0-9]+'))) AS tok FROM p),
    qc AS (SELECT *, list_filter(tok, lambda x: x NOT IN ('of', 'the', 'a', 'an', 'with', 'on', 'in', 'at', 'to', 'for')) AS cont FROM q),
    rec AS (SELECT p_brand AS image, p_partkey AS ord, part, object,
        list_sort(list_distinct(regexp_extract_all(part, '[a-z0-9]+'))) AS t1,
        list_sort(list_distinct(regexp_extract_all(part || ' of the ' || object, '[a-z0-9]+'))) AS t2,
        list_sort(list_distinct(regexp_extract_all(part || ' of ' || object, '[a-z0-9]+'))) AS t3,
        list_sort(list_distinct(regexp_extract_all(part || ' ' || object, '[a-z0-9]+'))) AS t4 FROM p),
    m AS (SELECT q.image, q.description, r.ord, r.part, r.object,
        CASE WHEN tok = t1 OR tok = t2 OR tok = t3 OR tok = t4 THEN 1 ELSE 2 END AS tier,
        CASE WHEN tok = t1 OR tok = t2 OR tok = t3 OR tok = t4 THEN 0 ELSE len(t4) - len(cont) END AS extra
      FROM qc q JOIN rec r ON q.image = r.image
      WHERE tok = t1 OR tok = t2 OR tok = t3 OR tok = t4 OR (len(cont) > 0 AND list_has_all(t4, cont))),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY image, description ORDER BY tier, extra, ord) = 1)
    SELECT q.image, q.description, b.ord, b.part, b.object, CASE WHEN b.tier = 1 THEN 'match' WHEN b.tier = 2 THEN 'match_permissive'
      WHEN q.image IN (SELECT image FROM rec) THEN 'no_part_match' ELSE 'no_image_record' END AS status
    FROM qc q LEFT JOIN b ON q.image = b.image AND q.description = b.description""",
)
def token_match(spark: SparkSession, sf: str) -> DataFrame:
    return match.token_match(*described(spark, sf))


MISSED = f"t AS ({ORACLES['token_match']}), miss AS (SELECT * FROM t WHERE ord IS NULL)"


@query("missing_gt_counts", f"WITH {MISSED} SELECT status, count(*) AS n FROM miss GROUP BY 1")
def missing_gt_counts(spark: SparkSession, sf: str) -> DataFrame:
    asked, records = described(spark, sf)
    return match.missing_audit(match.token_match(asked, records), records)["counts"]


@query(
    "missing_gt_parts",
    f"""WITH {MISSED}, r AS (SELECT DISTINCT p_brand AS image, part || ' ' || lower(p_type) AS part FROM ({PARTS})),
    n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY part) - 1 AS i FROM r
      WHERE image IN (SELECT image FROM miss WHERE status = 'no_part_match'))
    SELECT image, i // 1000 AS page, string_agg(part, '; ' ORDER BY part) AS parts FROM n GROUP BY 1, 2""",
)
def missing_gt_parts(spark: SparkSession, sf: str) -> DataFrame:
    asked, records = described(spark, sf)
    found = match.missing_audit(match.token_match(asked, records), records)["available"]
    return found.withColumn("parts", F.array_join("parts", "; "))


def described(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Descriptions asked for, and the part records of each image."""
    rows = parts(spark, sf, "p_brand", F.lower("p_type").alias("kind"))
    p, o, k = F.col("part"), F.col("object"), F.col("kind")
    long_part = F.concat(p, F.lit(" "), k)
    description = choose(
        6, F.concat(long_part, F.lit(" of the "), o), F.concat(p, F.lit(" of the "), o), F.concat(o, F.lit(" for "), p),
        F.concat(F.lit("tiny "), o), "The", k,
    )
    image = F.when(F.col("p_partkey") % 17 == 0, "Brand#99").otherwise(F.col("p_brand"))
    asked = rows.select(image.alias("image"), description.alias("description"))
    records = rows.select(F.col("p_brand").alias("image"), long_part.alias("part"), "object", F.col("p_partkey").alias("ord"))
    return asked, records


ALIASES = {"smal ring": "small ring", "blu bolt": "blue bolt", **templates.NAME_ALIASES}


def vocabulary(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labels of a brand, and the names asked for in it."""
    part = table(spark, sf, "part")
    label = F.when(F.col("p_size") < 30, F.col("p_name")).otherwise(F.concat(F.lit("discontinued "), "p_name"))
    labels = part.select(F.col("p_brand").alias("image"), label.alias("label")).distinct()
    name = choose(
        6, F.col("p_name"), F.regexp_replace("p_name", "^small", "smal"), F.regexp_replace("p_name", "^blue", "blu"),
        F.concat("p_name", F.lit("s")), F.translate("p_name", "o", "0"), F.lit("dinning table"),
    )
    return part.select(F.col("p_brand").alias("image"), names.squeezed_name(name).alias("name")).distinct(), labels


@query(
    "vocab_match",
    f"""WITH l AS (SELECT DISTINCT p_brand AS image, CASE WHEN p_size < 30 THEN p_name ELSE 'discontinued ' || p_name END AS label FROM part),
    q AS (SELECT DISTINCT p_brand AS image, {choose_sql(6, "p_name", "regexp_replace(p_name, '^small', 'smal')", "regexp_replace(p_name, '^blue', 'blu')", "p_name || 's'", "replace(p_name, 'o', '0')", "'dinning table'")} AS name FROM part),
    a AS (SELECT *, {sql_case("name", ALIASES, "NULL")} AS alias FROM q)
    SELECT a.image, a.name, CASE WHEN e.label IS NOT NULL THEN e.label ELSE x.label END AS matched_label, false AS is_fuzzy
    FROM a LEFT JOIN l e ON e.image = a.image AND e.label = a.name LEFT JOIN l x ON x.image = a.image AND x.label = a.alias""",
)
def vocab_match(spark: SparkSession, sf: str) -> DataFrame:
    asked, labels = vocabulary(spark, sf)
    return match.match_vocabulary(asked, labels, "image", ALIASES)


@query("fuzzy_match")
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL twin: the ratio is not an SQL function. Checked by brute force in tests."""
    asked, labels = vocabulary(spark, sf)
    return match.match_vocabulary(asked, labels, "image", ALIASES, cutoff=0.9)


RULES = [("ring", "small", ["PROMO", "Small"]), ("gear", "old", ["ECONOMY"]), ("Bolt", "hot", ["large", "standard", "Medium"])]
RULES_SQL = " OR ".join(
    f"(object = '{o.lower()}' AND part = '{p}' AND lower(p_type) IN ({', '.join(sql_text(a.lower()) for a in wrong)}))"
    for o, p, wrong in RULES
)


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = parts(spark, sf, "p_type", "p_brand", "p_size")
    return match.flag_bad_triples(rows, F.upper("object"), F.col("part"), F.col("p_type"), RULES)


# Every entry of the library's table, and the same objects and parts with another entry's affordance.
TRIPLES = [(o, p, a) for o, p, wrong in templates.BAD_TRIPLES for a in wrong]
_PICK = f"CAST(p_partkey % {len(TRIPLES)} AS INT)"
_MOVE = f"CAST((p_partkey + p_size % 3) % {len(TRIPLES)} AS INT)"
_LISTS = ["[" + ", ".join(sql_text(t[i]) for t in TRIPLES) + "]" for i in range(3)]
_BAD = ", ".join("(" + ", ".join(sql_text(x.replace("_", " ").lower()) for x in t) + ")" for t in TRIPLES)


@query(
    "bad_rule_flag",
    f"""WITH t AS (SELECT p_partkey, ({_LISTS[0]})[{_PICK} + 1] AS object, ({_LISTS[1]})[{_PICK} + 1] AS part,
      ({_LISTS[2]})[{_MOVE} + 1] AS affordance FROM part)
    SELECT *, (replace(lower(object), '_', ' '), replace(lower(part), '_', ' '), replace(lower(affordance), '_', ' ')) IN ({_BAD}) AS is_bad FROM t""",
)
def bad_rule_flag(spark: SparkSession, sf: str) -> DataFrame:
    """The default rules, on objects that occur in them."""
    pick, move = F.expr(_PICK), F.expr(_MOVE)

    def of(i: int, at: Column) -> Column:
        return F.get(F.array(*[F.lit(t[i]) for t in TRIPLES]), at)

    rows = table(spark, sf, "part").select("p_partkey", of(0, pick).alias("object"), of(1, pick).alias("part"), of(2, move).alias("affordance"))
    return match.flag_bad_triples(rows, F.col("object"), F.col("part"), F.col("affordance"))


GOOD = f"""good AS (SELECT object, part, lower(p_type) AS label,
    CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) ELSE lower(p_type) || '_' END AS surface,
    p_brand, p_size % 3 AS size_class, p_partkey FROM ({PARTS}) WHERE NOT ({RULES_SQL})),
  lab AS (SELECT object, part, label, count(*) AS label_count FROM good GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY object, part ORDER BY count(*) DESC, min(p_partkey)) = 1),
  sur AS (SELECT object, part, label, surface FROM good GROUP BY 1, 2, 3, 4
    QUALIFY row_number() OVER (PARTITION BY object, part, label ORDER BY count(*) DESC, min(p_partkey)) = 1),
  com AS (SELECT object, part, label, p_brand, size_class FROM good GROUP BY 1, 2, 3, 4, 5
    QUALIFY row_number() OVER (PARTITION BY object, part, label ORDER BY count(*) DESC, min(p_partkey)) = 1)"""


def dominant(rows: DataFrame) -> DataFrame:
    """Bad rows are left out first, so a group is never mapped to a bad label."""
    t = F.col("p_type")
    surface = choose(3, t, F.lower(t), F.concat(F.lower(t), F.lit("_")))
    good = rows.filter(~F.col("is_bad")).select(
        "object", "part", F.lower(t).alias("label"), surface.alias("surface"), "p_brand",
        (F.col("p_size") % 3).alias("size_class"), "p_partkey",
    )
    return regroup.dominant_labels(good, ["object", "part"], "label", "surface", ["p_brand", "size_class"], ["p_partkey"])


@query(
    "dominant_value",
    f"""WITH {GOOD} SELECT object, part, label, label_count, surface, p_brand, size_class
    FROM lab JOIN sur USING (object, part, label) JOIN com USING (object, part, label)""",
)
def dominant_value(spark: SparkSession, sf: str) -> DataFrame:
    return dominant(flagged(spark, sf))


@query(
    "remap_report",
    f"""WITH {GOOD}, r AS (SELECT p.object, p.part, p.p_type AS from_label, s.surface AS to_label, p_partkey,
        ({RULES_SQL.replace("object", "p.object").replace("part =", "p.part =")}) AS bad
      FROM ({PARTS}) p LEFT JOIN (SELECT * FROM lab JOIN sur USING (object, part, label)) s
        ON p.object = s.object AND p.part = s.part)
    SELECT object, part, from_label, to_label, CASE WHEN to_label IS NULL THEN 'drop' ELSE 'remap' END AS outcome,
      count(*) AS n, 'part:' || min(p_partkey) AS example FROM r WHERE bad GROUP BY ALL""",
)
def remap_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = flagged(spark, sf)
    done = regroup.relabel(rows, dominant(rows), ["object", "part"], "is_bad").filter("is_bad")
    done = done.withColumn("source", F.concat(F.lit("part:"), F.col("p_partkey").cast("string")))
    done = done.withColumnRenamed("p_type", "from_label")
    return metrics.relabel_report(done, ["object", "part", "from_label", "to_label", "outcome"], ["p_partkey"], "source")


@query(
    "conditional_keep",
    f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'seat' ELSE part END AS part,
        p_size % 5 = 0 AS a, p_size % 7 = 0 AS b FROM ({PARTS}))
    SELECT p_partkey, part FROM p WHERE NOT (a OR b) OR part = 'seat'""",
)
def conditional_keep(spark: SparkSession, sf: str) -> DataFrame:
    rows = parts(spark, sf, "p_size").withColumn(
        "part", F.when(F.col("p_partkey") % 2 == 0, "seat").otherwise(F.col("part"))
    )
    aff = F.when(F.col("p_size") % 5 == 0, "Sit_on").otherwise("open")
    action = F.when(F.col("p_size") % 7 == 0, " sit  on").otherwise("open")
    return rows.filter(gates.sit_on_rule(F.col("part"), aff, action)).select("p_partkey", "part")


@query(
    "default_parts",
    f"""SELECT p_partkey, {choose_sql(4, "'whole_object'", "'whole_object'", "part || ',' || object", "'whole object'")} AS parts,
      {choose_sql(4, "true", "true", "false", "true")} AS is_whole FROM ({PARTS})""",
)
def default_parts(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    given = choose(
        4, None, F.array(F.lit(""), F.lit("  ")),
        F.array(F.concat(F.lit(" "), "part"), F.lit(""), F.col("object")), F.array(F.lit("whole object")),
    )
    got = gates.parts_or_whole(F.coalesce(given, empty))
    rows = parts(spark, sf).select("p_partkey", got.alias("got"))
    return rows.select(
        "p_partkey", F.array_join("got", ",").alias("parts"), gates.is_whole_object(F.col("got")[0]).alias("is_whole")
    )
