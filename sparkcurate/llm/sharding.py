"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0 .. n - 1 by (bucket, row), where the bucket is a hash of the row with a
fixed number of buckets, so the numbers depend on the rows alone: not on files, partitions
or the cluster. Equal rows are counted before the shuffle and numbered as a run. A Feistel
network over ``a * b >= n`` numbers, with ``a`` and ``b`` near the root of ``n``, permutes
them; results outside 0 .. n - 1 are permuted again (cycle walking). Shard and slot are the
remainder and the quotient, so anyone can compute them from the row number, sizes differ by
one at most and slots have no gap.

Everything runs as SQL expressions. The only single-task step sums ``buckets`` numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.session import materialise

ROUNDS, WALKS, BUCKETS, RUN = 8, 64, 4096, 100_000


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number`` (0 .. n - 1) among ``n`` rows.

    One round adds a hash of one half to the other, in turns, which can be undone. A walk
    leaves the range for ``a * b - n < a`` numbers only; it ends after as many steps, and
    the chance that a step is needed is about ``n ** -0.5``.
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def mixed(half: Column, k: Column, size: int) -> Column:
        return F.pmod(F.xxhash64(half, k, F.lit(seed)), F.lit(size).cast("long"))

    def step(x: Column) -> Column:
        left = F.pmod(x, F.lit(a).cast("long"))
        halves = F.struct(left.alias("l"), F.call_function("div", x, F.lit(a)).alias("r"))
        return F.aggregate(
            F.array(*[F.lit(k) for k in range(ROUNDS)]),
            halves,
            lambda h, k: F.when(
                k % 2 == 0, F.struct(F.pmod(h["l"] + mixed(h["r"], k, a), F.lit(a).cast("long")).alias("l"), h["r"].alias("r"))
            ).otherwise(F.struct(h["l"].alias("l"), F.pmod(h["r"] + mixed(h["l"], k, b), F.lit(b).cast("long")).alias("r"))),
            lambda h: h["r"] * F.lit(a) + h["l"],
        )

    walks = F.array(*[F.lit(k) for k in range(WALKS)])
    return F.aggregate(walks, number.cast("long"), lambda x, k: F.when((k == 0) | (x >= F.lit(n)), step(x)).otherwise(x))


def numbered(rows: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """``rows`` with ``number``, and their count. Equal rows take neighbouring numbers; rows
    may hold nulls; columns must be of types that can be grouped and sorted."""
    names = rows.columns
    own = F.struct(*[F.col(f"`{c}`") for c in names])
    groups = rows.select(own.alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    in_bucket = Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = materialise(groups.withColumn("before", F.sum("n").over(in_bucket) - F.col("n")), "numbered")
    totals = groups.groupBy("bucket").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    totals = materialise(totals, "totals")  # one row per bucket: ``buckets`` at most
    all_rows, most = totals.agg(F.sum("rows"), F.max("most")).first()
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = totals.select("bucket", (F.sum("rows").over(ahead) - F.col("rows")).alias("first"))
    placed = groups.join(F.broadcast(first), "bucket").select("row", "n", (F.col("first") + F.col("before")).alias("start"))
    if (most or 0) > RUN:  # a run of equal rows is dealt to many tasks
        runs = F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("n") - 1, F.lit(RUN)))).alias("run")
        placed = placed.select("row", "n", "start", runs).repartition("start", "run")
        low = F.col("run") * RUN
    else:
        low = F.lit(0).cast("long")
    each = F.explode(F.sequence(low, F.least(F.col("n"), low + RUN) - 1)).alias("i")
    out = placed.select("row", "start", each).select("row.*", (F.col("start") + F.col("i")).alias("number"))
    return out, int(all_rows or 0)


def shard(rows: DataFrame, shards: int, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 .. shards - 1) and ``slot`` (long, from 0 without gaps).

    Give it the columns that identify a row (a key and a digest), not the texts: the whole
    row is compared. Empty input gives no rows; fewer rows than shards leave shards empty.
    """
    if {"shard", "slot", "number"} & set(rows.columns):
        raise ValueError("rename the columns shard, slot and number first")
    out, n = numbered(rows, buckets)
    place = permuted(F.col("number"), n, seed)
    out = out.withColumn("number", place)
    shard_no = F.pmod("number", F.lit(shards)).cast("int")
    return out.select(*rows.columns, shard_no.alias("shard"), F.call_function("div", F.col("number"), F.lit(shards)).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(rows, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
