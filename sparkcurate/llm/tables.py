"""Written tables that keep their buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sparkcurate.session import new_path


def bucketed(df: DataFrame, column: str, buckets: int, label: str) -> DataFrame:
    """Write ``df`` to the shared folder, bucketed by ``column``, and read it back: groupings by it
    read the files in place. The catalogue entry goes at once; the files stay for the session."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).format("parquet").option("compression", "zstd").option("path", new_path(spark, label)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE `{name}`")
    return table


BATCH = 1024  # rows of whole texts that go to Python at a time


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that sends at most ``BATCH`` rows to Python at a time. A batch is held
    by both sides of every core, so batches of whole texts add up."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))
    return df
