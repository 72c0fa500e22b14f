"""Resumable ingest of responses with Structured Streaming.

Every response id is handled once. Which ids were handled is keyed state in RocksDB, next to
the checkpoint: a micro-batch looks up its own ids and opens nothing that earlier batches have
written, so its cost follows the batch and not the history. Each batch writes one folder of the
sink and replaces it when it is replayed after a failure. Rows that fail to parse are kept with
an error code and count as handled.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.session import exists

# state on disk; a commit uploads what a batch has changed; stores of ended runs go soon
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}
RUN, BATCH = "ledger_run", "ledger_batch"  # folder levels of a sink


def _first_arrivals(rows: DataFrame, uid: str, order: list[str]) -> DataFrame:
    """The first row of each id, given out in the batch that brought the id.

    All rows of a batch bear its time, which a replay repeats. The state keeps the smallest
    (time, order) of an id; an update that still has the time of this batch is a new id."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    marked = rows.select(whole.alias("row"), F.current_timestamp().alias("arrived"))
    place = F.struct("arrived", *[F.col(f"row.`{c}`") for c in order])
    kept = marked.groupBy(F.col(f"row.`{uid}`").alias("id")).agg(
        F.min("arrived").alias("arrived"), F.min_by("row", place).alias("row")
    )
    return kept.filter(F.col("arrived") == F.current_timestamp()).select("row.*")


def _other_runs(spark: SparkSession, sink: str, run: str) -> list[str]:
    """Folders of runs that began from another checkpoint."""
    if not exists(spark, sink):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(sink)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    folders = [f.getPath() for f in found if f.getPath().getName().startswith(f"{RUN}=")]
    return [f.toString() for f in folders if f.getName() != f"{RUN}={run}"]


def ingest(
    source: DataFrame, sink: str, checkpoint: str, uid: str, order: list[str],
    prepare: Callable[[DataFrame], DataFrame] | None = None, partitions: int | None = None,
) -> list[dict]:
    """Drain what is available in ``source`` into the folder ``sink`` (read it with ``handled``)
    and return the progress of each micro-batch.

    ``prepare`` works row by row. Of the rows of an id within a batch the first by ``order``
    stays, nulls first; ties leave any one of them. A null id is one id. With a lost checkpoint
    the state is empty: then only, ids are also looked up in the folders of the earlier runs.
    The state holds the first row of each id, in ``partitions`` stores that the first run fixes
    for good: one a core unless told otherwise."""
    spark, begun, run = source.sparkSession, threading.Event(), []

    def each(batch: DataFrame, batch_id: int) -> None:
        begun.wait()
        others = _other_runs(batch.sparkSession, sink, run[0])
        if others:
            done = batch.sparkSession.read.schema(batch.schema).parquet(*[f"{o}/*" for o in others])
            done = done.select(F.col(f"`{uid}`").alias("_done"))
            batch = batch.join(done, F.col(f"`{uid}`").eqNullSafe(F.col("_done")), "left_anti")
        batch.write.mode("overwrite").parquet(f"{sink}/{RUN}={run[0]}/{BATCH}={batch_id}")

    rows = _first_arrivals(prepare(source) if prepare else source, uid, order)
    settings = STORE | {"spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        running = (
            rows.writeStream.foreachBatch(each).outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.append(running.id)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        begun.set()
    running.awaitTermination()
    if running.exception():
        raise running.exception()
    return [dict(p) for p in running.recentProgress]


def handled(spark: SparkSession, sink: str) -> DataFrame:
    """What has been ingested into ``sink`` so far."""
    return spark.read.parquet(sink).drop(RUN, BATCH)


def drop_repeats(stream: DataFrame, uid: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First arrival of each id. Without an event time nothing is lost and the state grows with
    the number of ids; ``ingest`` does the same against its sink. With an event time the state
    is bounded, and rows that arrive more than ``delay`` late are dropped: for streams whose
    delay is known only."""
    if event_time is None:
        return stream.dropDuplicates([uid])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([uid])


def write_append(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Drain the stream into a parquet folder with the exactly-once file sink."""
    running = (
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    if running.exception():
        raise running.exception()
