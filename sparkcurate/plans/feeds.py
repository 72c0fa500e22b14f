"""Two feeds: ``documents`` on the left and ``labels`` on the right, plus the regrouping
of part rows built from ``lineitem`` and ``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import names
from sparkcurate.operators import gates, match, metrics, regroup
from sparkcurate.operators.ranking import first_per_key, paged_lists, rank_rows
from sparkcurate.plans.registry import query, table

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
ROW_SQL = ", ".join(ROW)


def left_feed(spark: SparkSession, sf: str) -> DataFrame:
    # German documents have keys that no label has
    own = F.when(F.col("lang") == "de", -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    return table(spark, sf, "documents").select(
        own.alias("doc_id"), F.col("source").alias("object"), F.col("lang").alias("part"), F.lit("Open").alias("affordance"),
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("q "), "lang")).alias("query"),
    )


def right_feed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        "doc_id", F.concat(F.lit("label"), F.col("quality").cast("string")).alias("object"),
        F.concat(F.lit("tox"), F.col("toxic").cast("string")).alias("part"), F.lit("Press").alias("affordance"),
        F.concat(F.lit(" do "), F.col("doc_id").cast("string")).alias("task"),
    )


@query(
    "outer_merge",
    """WITH l AS (SELECT CASE WHEN lang = 'de' THEN -1 - doc_id ELSE doc_id END AS doc_id, source AS object, lang AS part,
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'q ' || lang END AS query FROM documents),
    r AS (SELECT doc_id, 'label' || quality AS object, 'tox' || toxic AS part, 'do ' || doc_id AS task FROM labels)
    SELECT coalesce(l.doc_id, r.doc_id) AS doc_id,
      CASE WHEN l.doc_id IS NULL THEN 'no_left' WHEN r.doc_id IS NULL THEN 'no_right' ELSE 'both' END AS status,
      coalesce(r.object, l.object) AS object, coalesce(r.part, l.part) AS part,
      CASE WHEN r.doc_id IS NULL THEN 'Open' ELSE 'Press' END AS affordance,
      CASE WHEN l.doc_id IS NULL THEN NULL WHEN query <> '' THEN query ELSE l.part || ' of the ' || l.object END AS orps,
      coalesce(task, 'Open the ' || l.object) AS trps
    FROM l FULL OUTER JOIN r ON l.doc_id = r.doc_id""",
)
def outer_merge(spark: SparkSession, sf: str) -> DataFrame:
    left = left_feed(spark, sf).withColumns({"own_object": F.col("object"), "own_part": F.col("part")})
    left = left.withColumn("task", F.lit(None).cast("string"))
    fields = ["object", "part", "affordance", "task"]
    rows = regroup.outer_merge(left, right_feed(spark, sf), ["doc_id"], fields)
    texts = regroup.merged_texts(
        F.col("query"), F.col("own_part"), F.col("own_object"), F.col("task"), F.col("affordance")
    )
    orps = F.when(F.col("status") != "no_left", texts["orps"])
    return rows.select("doc_id", "status", "object", "part", "affordance", orps.alias("orps"), texts["trps"].alias("trps"))


@query(
    "key_union",
    """SELECT CASE WHEN lang = 'de' THEN -1 - doc_id ELSE doc_id END AS doc_id FROM documents UNION SELECT doc_id FROM labels""",
)
def key_union(spark: SparkSession, sf: str) -> DataFrame:
    return left_feed(spark, sf).select("doc_id").union(right_feed(spark, sf).select("doc_id")).distinct()


@query(
    "union_distinct",
    """SELECT 'img_' || (l_partkey % 5000) AS path FROM lineitem UNION SELECT 'img_' || o_custkey FROM orders
    UNION SELECT 'img_' || user_id FROM events""",
)
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    def image(name: str, c: Column) -> DataFrame:
        return table(spark, sf, name).select(F.concat(F.lit("img_"), c.cast("string")).alias("path"))

    lists = [image("lineitem", F.col("l_partkey") % 5000), image("orders", F.col("o_custkey")), image("events", F.col("user_id"))]
    return lists[0].unionByName(lists[1]).unionByName(lists[2]).distinct()


@query(
    "two_tier_lookup",
    """WITH items AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN 'manual' ELSE 'merged.jsonl:' || doc_id || ':a0:p1' END AS src FROM documents),
    p AS (SELECT *, TRY_CAST(nullif(regexp_extract(src, ':(\\d+):a\\d+:p\\d+$', 1), '') AS BIGINT) AS line FROM items),
    a AS (SELECT doc_id AS line, quality + 1 AS bucket FROM labels),
    b AS (SELECT CASE WHEN lang = 'de' THEN 'old de' ELSE lang END AS lang, source, min(n_chars % 5 + 1) AS bucket FROM documents GROUP BY 1, 2)
    SELECT doc_id, line, coalesce(a.bucket, b.bucket) AS bucket,
      CASE WHEN a.bucket IS NOT NULL THEN 'line' WHEN b.bucket IS NOT NULL THEN 'pair' ELSE 'unmatched' END AS matched_by
    FROM p LEFT JOIN a USING (line) LEFT JOIN b USING (lang, source)""",
)
def two_tier_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    source = F.when(F.col("doc_id") % 5 == 0, "manual").otherwise(
        F.concat(F.lit("merged.jsonl:"), F.col("doc_id").cast("string"), F.lit(":a0:p1"))
    )
    items = docs.select("doc_id", "lang", "source", source_line(source).alias("line"))
    by_line = table(spark, sf, "labels").select(F.col("doc_id").alias("line"), (F.col("quality") + 1).cast("bigint").alias("bucket"))
    by_pair = docs.withColumn("lang", F.when(F.col("lang") == "de", "old de").otherwise(F.col("lang"))).groupBy("lang", "source").agg(F.min(F.col("n_chars") % 5 + 1).alias("bucket"))
    return match.two_tier_lookup(items, by_line, by_pair, "line", ["lang", "source"], "bucket").select(
        "doc_id", "line", "bucket", "matched_by"
    )


def source_line(source: Column) -> Column:
    """Line number inside a ``file:line:aI:pJ`` provenance text."""
    return F.regexp_extract(source, r":(\d+):a\d+:p\d+$", 1).try_cast("bigint")


@query(
    "dedupe_last",
    """SELECT lang, source, doc_id, n_chars FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang, source, n_chars % 10 ORDER BY doc_id DESC) = 1""",
)
def dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars", (F.col("n_chars") % 10).alias("slot"))
    return regroup.last_per_key(rows, ["lang", "source", "slot"], ["doc_id"]).drop("slot")


@query(
    "dedupe_first",
    f"""SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, l_partkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, lower(l_returnflag), l_linestatus ORDER BY {ROW_SQL}) = 1""",
)
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(*ROW, "l_returnflag", "l_linestatus")
    signed = rows.withColumns({"a": names.label_key(F.col("l_returnflag")), "b": names.label_key(F.col("l_linestatus"))})
    first = first_per_key(signed, ["l_orderkey", "a", "b"], [F.col(c) for c in ROW])
    return first.select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")


@query(
    "ordered_distinct",
    """WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part),
    f AS (SELECT name, p_partkey FROM w QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) = 1)
    SELECT name, p_partkey AS first_seen, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM f""",
)
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.col("p_name"))
    rows = table(spark, sf, "part").select("p_partkey", names.clean(spelled).alias("name"))
    first = first_per_key(rows.withColumn("key", F.lower("name")), ["key"], [F.col("p_partkey")])
    ranked = rank_rows(first, [], [F.col("p_partkey")], "_r")
    return ranked.select("name", F.col("p_partkey").alias("first_seen"), (F.col("_r") - 1).alias("position"))


def part_items(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated parts: image, object, part, affordance, action, bucket."""
    words = F.split("p_name", " ")
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), words[1].alias("object"), words[0].alias("part"), F.col("p_type").alias("affordance")
    )
    action = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") <= 3, "sit on").otherwise("hold")
    return table(spark, sf, "lineitem").select(*ROW).join(part, "l_partkey").select(
        *ROW, F.col("l_orderkey").alias("image_path"), "object", "part", "affordance", action.alias("action"),
        (F.col("l_linenumber") % 5 + 1).cast("string").alias("bucket"),
    )


ITEMS = f"""items AS (SELECT {ROW_SQL}, l_orderkey AS image_path, split_part(p_name, ' ', 2) AS object, split_part(p_name, ' ', 1) AS part,
    p_type AS affordance, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber <= 3 THEN 'sit on' ELSE 'hold' END AS action,
    CAST(l_linenumber % 5 + 1 AS VARCHAR) AS bucket FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def listed_parts(spark: SparkSession, sf: str) -> DataFrame:
    # the seat of this stand-in is the small part
    seat = F.when(F.col("part") == "small", "seat").otherwise(F.col("part"))
    return part_items(spark, sf).filter(gates.sit_on_rule(seat, F.col("affordance"), F.col("action")))


@query(
    "part_lists",
    f"""WITH {ITEMS}, k AS (SELECT *, row_number() OVER (PARTITION BY bucket, image_path
        ORDER BY object, part, affordance, {ROW_SQL}) AS r FROM items WHERE action <> 'sit on' OR part = 'small')
    SELECT bucket, image_path, (r - 1) // 3 AS page, string_agg(part || ' of the ' || object || ' / ' || affordance, '; ' ORDER BY r) AS part_list,
      count(*) AS n FROM k GROUP BY 1, 2, 3""",
)
def part_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = listed_parts(spark, sf)
    item = F.concat("part", F.lit(" of the "), "object", F.lit(" / "), "affordance")
    order = [F.col(c) for c in ["object", "part", "affordance", *ROW]]
    pages = paged_lists(rows, ["bucket", "image_path"], order, item, page_size=3, out="items")
    return pages.select("bucket", "image_path", "page", F.array_join("items", "; ").alias("part_list"), F.size("items").alias("n"))


@query(
    "part_list_totals",
    f"""WITH {ITEMS} SELECT bucket, count(DISTINCT image_path) AS images, count(*) AS parts
    FROM items WHERE action <> 'sit on' OR part = 'small' GROUP BY 1""",
)
def part_list_totals(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.list_totals(listed_parts(spark, sf), "bucket", "image_path")


@query(
    "nested_regroup",
    f"""WITH {ITEMS}, e AS (SELECT l_orderkey AS image_path, object, affordance,
        CASE WHEN l_suppkey % 4 = 0 THEN 'whole_object' ELSE part END AS part FROM items),
    d AS (SELECT *, row_number() OVER (PARTITION BY image_path, object, affordance ORDER BY part) AS r FROM (SELECT DISTINCT * FROM e))
    SELECT image_path, object, affordance, (r - 1) // 2 AS page, string_agg(part, ',' ORDER BY r) AS parts FROM d GROUP BY 1, 2, 3, 4""",
)
def nested_regroup(spark: SparkSession, sf: str) -> DataFrame:
    # the evaluation list comes from the first of three fields that is there
    part = F.concat(F.lit(" "), "part")
    own = F.when(F.col("l_suppkey") % 4 == 0, F.array(F.lit(" "))).otherwise(F.array(part))
    first = F.when(F.col("l_linenumber") % 3 == 0, own)
    second = F.when(F.col("l_linenumber") % 3 == 1, own)
    given = F.coalesce(first, second, own)
    rows = part_items(spark, sf).withColumn("part", F.explode(gates.parts_or_whole(given)))
    out = regroup.nested_regroup(rows, ["image_path", "object"], "affordance", "part", page_size=2)
    return out.select("image_path", "object", "affordance", "page", F.array_join("leaves", ",").alias("parts"))


@query(
    "part_catalog",
    f"""WITH {ITEMS} SELECT object, part, 0 AS page, count(DISTINCT affordance) AS affordance_count,
      array_to_string(list_sort(list(DISTINCT affordance)), ' | ') AS affordances,
      array_to_string(list_sort(list(DISTINCT action) FILTER (WHERE action <> '')), ' | ') AS actions,
      array_to_string(list_sort(list(DISTINCT bucket)), ' | ') AS buckets,
      count(DISTINCT image_path) AS image_count, count(*) AS item_count FROM items GROUP BY 1, 2""",
)
def part_catalog(spark: SparkSession, sf: str) -> DataFrame:
    cat = regroup.part_catalog(part_items(spark, sf))
    return cat.select(
        "object", "part", "page", "affordance_count", *[F.array_join(c, " | ").alias(c) for c in ("affordances", "actions", "buckets")],
        "image_count", "item_count",
    )


@query(
    "catalog_oneline",
    f"""WITH {ITEMS} SELECT 'object=' || object || ' | part=' || part || ' | affordances=' || array_to_string(list_sort(list(DISTINCT affordance)), ', ')
      || ' | actions=' || array_to_string(list_sort(list(DISTINCT action) FILTER (WHERE action <> '')), ', ')
      || ' | image_count=' || count(DISTINCT image_path) || ' | item_count=' || count(*) AS line FROM items GROUP BY object, part""",
)
def catalog_oneline(spark: SparkSession, sf: str) -> DataFrame:
    return regroup.catalog_line(regroup.part_catalog(part_items(spark, sf)))


@query(
    "affordance_rollup",
    f"""WITH {ITEMS}, b AS (SELECT affordance, {", ".join(f"count(*) FILTER (WHERE bucket = '{i}') AS bucket_{i}" for i in range(1, 6))} FROM items GROUP BY 1)
    SELECT affordance, object, 0 AS page, item_count, image_count, parts, part_count, {", ".join(f"bucket_{i}" for i in range(1, 6))}
    FROM (SELECT affordance, object, count(*) AS item_count, count(DISTINCT image_path) AS image_count,
        array_to_string(list_sort(list(DISTINCT part)), ',') AS parts, count(DISTINCT part) AS part_count
      FROM items GROUP BY GROUPING SETS ((affordance, object), (affordance))) JOIN b USING (affordance)""",
)
def affordance_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = part_items(spark, sf)
    up = regroup.affordance_rollup(rows).join(regroup.bucket_histogram(rows), "affordance")
    return up.select(
        "affordance", "object", "page", "item_count", "image_count", F.array_join("parts", ",").alias("parts"),
        "part_count", *[f"bucket_{i}" for i in range(1, 6)],
    )
