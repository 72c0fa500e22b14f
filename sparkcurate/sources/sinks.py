"""Partitioned, chunked and text sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate.operators.ranking import paged_lists, rank_rows
from sparkcurate.session import exists


# So many first rows are ordered by a single task without trouble.
FEW = 100_000


def chunks(df: DataFrame, order: Sequence[Column], size: int = 20000) -> DataFrame:
    """Number the rows in order and give each its chunk of ``size`` rows."""
    ranked = rank_rows(df, [], order, "row_no")
    return ranked.withColumn("chunk", F.floor((F.col("row_no") - 1) / size).cast("bigint"))


def shards(df: DataFrame, order: Sequence[Column], n: int = 4) -> DataFrame:
    """Deal the ordered rows to ``n`` shards in turn, so sizes differ by at most one."""
    ranked = rank_rows(df, [], order, "row_no")
    return ranked.withColumn("shard", ((F.col("row_no") - 1) % n).cast("int"))


def row_slice(df: DataFrame, order: Sequence[Column], start: int, end: int = -1) -> DataFrame:
    """Rows ``start`` (inclusive, 0-based) to ``end`` (exclusive; -1 is the last). For an end
    within ``FEW`` every task sends on its first rows only; the result is the same."""
    if 0 <= end <= FEW:
        df = df.orderBy(*order).limit(end)
    at = rank_rows(df, [], order, "row_no").withColumn("row_no", F.col("row_no") - 1)
    kept = at.filter(F.col("row_no") >= start)
    return kept if end == -1 else kept.filter(F.col("row_no") < end)


def write_buckets(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "json") -> None:
    """One folder per bucket value; a rerun replaces the whole output."""
    df.write.mode("overwrite").partitionBy(*columns).format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with list columns joined by `` | ``."""
    flat = df.select(
        *[F.array_join(F.col(f.name).cast("array<string>"), " | ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
          for f in df.schema.fields]
    )
    flat.write.mode("overwrite").option("header", "true").csv(path)


def label_files(df: DataFrame, stem: str, line: str, order: Sequence[Column], page_size: int = 10_000) -> DataFrame:
    """Content of the label file of each image: its lines in box order, each with a line
    feed. An image of more than ``page_size`` boxes continues on further pages."""
    pages = paged_lists(df, [stem], order, F.col(line), page_size, "_lines")
    return pages.select(stem, "page", F.concat(F.array_join("_lines", "\n"), F.lit("\n")).alias("content"))


def write_lines(df: DataFrame, path: str, line: str, folder: str | None = None, order: Sequence[Column] = ()) -> None:
    """Text lines, in one folder per value of ``folder`` when given. With ``order`` the lines
    of a folder stand in order, through its part files by name."""
    if order:
        sort = [*([F.col(folder)] if folder else []), *order]
        df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    out = df.select(line) if folder is None else df.select(folder, line)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(folder) if folder else writer).text(path)


def write_documents(rows: DataFrame, path: str, key: str, element: str = "value") -> None:
    """Write JSON texts as the elements of ``{key: [...]}`` documents, one per task."""

    def one(batches):
        line = "{" + json.dumps(key) + ": ["
        for batch in batches:
            texts = batch.column(0)
            if len(texts):
                rest = pc.binary_join_element_wise("", texts[1:], ",")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([line]), texts[:1], rest])], ["value"])
                line = ","
        yield pa.RecordBatch.from_arrays([pa.array([line, "]}"] if line != "," else ["]}"])], ["value"])

    rows.select(F.col(element).alias("value")).mapInArrow(one, "value string").write.text(path)


def write_parts(df: DataFrame, path: str, by: str, one_file: bool = False) -> None:
    """Write ``df`` as JSON in one folder per value of ``by``, and a manifest of the rows of each when all of
    them are there. The manifest commits the output: ``read_parts`` sees nothing without it, so what a
    run that was killed has left behind is never read. ``one_file`` gives every value a single file, for
    values whose size is bounded, such as chunks; otherwise a hot value is written by many tasks."""
    rows = df.repartition(by) if one_file else df
    rows.write.partitionBy(by).json(f"{path}/rows")
    written = df.sparkSession.read.schema(df.schema).json(f"{path}/rows")
    written.groupBy(by).agg(F.count("*").alias("rows")).write.json(f"{path}/manifest")


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a committed output."""
    if not exists(spark, f"{path}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"{path} was not committed")
    return spark.read.schema(schema).json(f"{path}/rows")
