"""Session helpers: settings the operators count on, and the shared work folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits hot join partitions and coalesces small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the last of repeated JSON keys wins, as in most readers
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; safe to call on any session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local temporary folder is used only when the setting is absent and
    the session runs in local mode, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="sparkcurate-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_scopes: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are made under the work folder meanwhile."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        made = _scopes.pop()
        if _scopes:
            _scopes[-1].extend(made)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared work folder."""
    app = spark.sparkContext.applicationId
    path = f"{work_root(spark)}/sparkcurate/{app}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, in any store that Spark writes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so a lost executor never replays the plan above it, and gives
    the planner the exact size of the table, so a later join is broadcast only when
    the written files really are below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the tables this application wrote to the shared folder. Call it last:
    DataFrames returned earlier may still read them."""
    remove(spark, f"{work_root(spark)}/sparkcurate/{spark.sparkContext.applicationId}")
