"""Row-position operators over several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.operators import sampling
from sparkcurate.operators.ranking import rank_rows
from sparkcurate.plans.registry import query, table
from sparkcurate.session import new_path
from sparkcurate.sources import sinks

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
ROW_SQL = ", ".join(ROW)


@query(
    "row_slice",
    """SELECT doc_id, row_number() OVER (ORDER BY lang, source, doc_id) - 1 AS row_no FROM documents
    QUALIFY row_no >= 100 AND row_no < 700""",
)
def row_slice(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "source", "doc_id")
    return sinks.row_slice(docs, [F.col("lang"), F.col("source"), F.col("doc_id")], 100, 700).select("doc_id", "row_no")


@query("nth_sample", "SELECT event_id, event_type FROM events WHERE event_id % 7 = 0")
def nth_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.every_nth(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 7)


@query("max_items", f"SELECT {ROW_SQL} FROM lineitem ORDER BY l_extendedprice DESC, {ROW_SQL} LIMIT 500")
def max_items(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in ROW]]
    return sampling.first_items(table(spark, sf, "lineitem").select(*ROW), order, 500)


@query("chunk_rows", f"SELECT {ROW_SQL}, (row_number() OVER (ORDER BY {ROW_SQL}) - 1) // 20000 AS chunk FROM lineitem")
def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(*ROW)
    made = sinks.chunks(rows, [F.col(c) for c in ROW], 20000).select(*ROW, "chunk")
    folder = new_path(spark, "chunks")
    sinks.write_parts(made, folder, "chunk", one_file=True)
    return sinks.read_parts(spark, folder, made.schema)


@query(
    "balanced_shards",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderpriority, o_custkey, o_orderkey) - 1) % 4 AS shard FROM orders",
)
def balanced_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    order = [F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderkey")]
    made = sinks.shards(rows, order, 4).select("o_orderkey", "shard")
    folder = new_path(spark, "shards")
    sinks.write_parts(made, folder, "shard")
    return sinks.read_parts(spark, folder, made.schema)


@query(
    "provenance_ids",
    """WITH n AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) AS line FROM part)
    SELECT 'part.jsonl:' || line || ':a' || a || ':p' || p AS source, line, upper(split_part(p_name, ' ', CAST(p + 1 AS INT))) AS part
    FROM n, (VALUES (0), (1)) AS x(a), (VALUES (0), (1)) AS y(p)""",
)
def provenance_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = rank_rows(table(spark, sf, "part").select("p_partkey", "p_name"), [], [F.col("p_partkey")], "line")
    words = F.split(F.upper("p_name"), " ")
    items = rows.select("line", F.posexplode(F.array(words, words)).alias("a", "words"))
    items = items.select("line", "a", F.posexplode("words").alias("p", "part"))
    return items.select(F.format_string("part.jsonl:%d:a%d:p%d", "line", "a", "p").alias("source"), "line", "part")
