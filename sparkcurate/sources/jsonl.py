"""Line-oriented scans: JSON lines, manifests, and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate.functions import answers
from sparkcurate.operators.ranking import first_per_key


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Text lines with ``src_file`` and the 0-based ``src_line``.

    Files stay splittable: lines are numbered inside each split, and one small row per
    split carries the count of the lines before it. Only those rows are ranked."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    earlier = Window.partitionBy("src_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("src_file", "_block")
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return (
        lines.join(splits, ["src_file", "_block"])
        .withColumn("src_line", F.col("_pos") - F.col("_first") + F.col("_before"))
        .select("src_file", "src_line", "value")
    )


def objects(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that hold a JSON object; blank, malformed and other lines are skipped."""
    text = F.btrim(value, F.lit(" \t\r\n"))
    return lines.withColumn(value, text).filter(text != "").filter(answers.json_object(F.col(value)).isNotNull())


def typed(lines: DataFrame, schema: T.StructType | str, value: str = "value") -> DataFrame:
    """Records of a known schema, next to their file and line. Wrongly typed fields come
    out null instead of failing the scan."""
    keep = [c for c in lines.columns if c != value]
    rec = F.from_json(F.col(value), schema, {"mode": "PERMISSIVE"})
    return objects(lines, value).select(*keep, rec.alias("r")).select(*keep, "r.*")


def scan_audit(lines: DataFrame, key: Column, value: str = "value") -> DataFrame:
    """One row: non-blank lines, lines without a readable key, and distinct keys."""
    text = F.btrim(value, F.lit(" \t\r\n"))
    marked = lines.filter(text != "").withColumn("_key", F.nullif(key, F.lit("")))
    return marked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_key").isNull()).alias("bad"),
        F.countDistinct("_key").alias("indexed"),
    )


def last_by_key(lines: DataFrame, key: Column, order: Sequence[Column], value: str = "value") -> DataFrame:
    """Manifest index: the last record of each key."""
    keyed = objects(lines, value).withColumn("key", F.nullif(key, F.lit(""))).filter("key IS NOT NULL")
    return first_per_key(keyed, ["key"], order)


def with_extension(files: DataFrame, path: Column, extensions: Sequence[str]) -> DataFrame:
    """Files whose extension, in any case, is one of those given."""
    return files.filter(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions]))


def file_inventory(spark: SparkSession, path: str, extensions: Sequence[str], hashes: bool = False) -> DataFrame:
    """Files of the given extensions under a folder, with size and, on request, their
    content hashes. Without hashes the content column is pruned from the scan."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    cols = ["path", "length"]
    if hashes:
        cols += [F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")]
    return with_extension(files, F.col("path"), extensions).select(*cols)


def patch_files(df: DataFrame, path: Column, first: int, last: int) -> DataFrame:
    """Rows of files whose patch number lies in the inclusive range."""
    number = F.regexp_extract(path, r"(?i)patch(\d+)", 1).try_cast("int")
    return df.withColumn("patch", number).filter(F.col("patch").between(first, last))
