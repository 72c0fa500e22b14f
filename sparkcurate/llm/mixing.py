"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent between 0 (all sources alike) and 1
(as they are) and normalised. The exponent is the largest that still reaches a target entropy,
or the smallest whose mix repeats no source more often than a limit; it is found by
section search: every pass over the table of sources tries ``SECTIONS`` exponents at once.

A weight becomes a budget of tokens: whole epochs of the source plus a rest. Each epoch is
a permutation of its own: documents are dealt into blocks by a hash, blocks and the
documents within are ordered by hashes of (seed, epoch). The rest takes whole blocks in
that order, and of the block in which the budget runs out the first documents. So a document
decides from two hashes and its source's row, texts are never shuffled, and a source with a
third of all rows is only ever aggregated (blocks are summed before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SECTIONS, PASSES = 16, 8
BLOCKS = 4096


def word_count(text: Column) -> Column:
    """Tokens of a text: its words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: a null source is a source of its own."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def _curve(sources: DataFrame, exponents: list[float], budget: float, total: float) -> list[tuple[float, float]]:
    """Per exponent the mix's entropy (as a share of the largest possible) and its largest
    number of epochs. One aggregate; a row of numbers reaches the driver."""
    share = F.col("tokens") / total
    sums = [F.count("*").alias("n")]
    for i, e in enumerate(exponents):
        p = F.pow(share, F.lit(e))
        sums += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log(share)).alias(f"l{i}"), F.max(p / F.col("tokens")).alias(f"m{i}")]
    row = sources.agg(*sums).select("n", *[F.struct((F.log(f"z{i}") - e * F.col(f"l{i}") / F.col(f"z{i}")).alias("h"), (F.col(f"m{i}") * budget / F.col(f"z{i}")).alias("r")).alias(f"x{i}") for i, e in enumerate(exponents)], F.log("n").alias("most")).first()
    return [(row[f"x{i}"].h / row["most"] if row["most"] else 1.0, row[f"x{i}"].r) for i in range(len(exponents))]


def exponent(sources: DataFrame, budget: float, total: float, entropy: float | None = None, epochs: float | None = None) -> float:
    """The exponent for a target: at least ``entropy`` (0 .. 1, of the largest possible) and at
    most ``epochs`` epochs of any source. Where both are given and clash, the limit on epochs wins."""

    def search(holds, at_zero: bool) -> float:
        """Border of ``holds``, which is true at one end of 0 .. 1 and changes at most once."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            good = [holds(x) for x in _curve(sources, points, budget, total)]
            if at_zero:
                if good[-1]:
                    return high
                last = max((i for i, g in enumerate(good) if g), default=0)
                low, high = points[last], points[min(last + 1, SECTIONS)]
            else:
                if good[0]:
                    return low
                first = next((i for i, g in enumerate(good) if g), SECTIONS)
                low, high = points[max(0, first - 1)], points[first]
        return low if at_zero else high

    found = 1.0 if entropy is None else search(lambda x: x[0] >= entropy, True)
    if epochs is not None:
        found = max(found, search(lambda x: x[1] <= epochs, False)) if entropy is not None else search(lambda x: x[1] <= epochs, False)
    return found


def plan(sources: DataFrame, budget: int | None = None, entropy: float | None = None, epochs: float | None = None) -> DataFrame:
    """Per source of ``sources(source, tokens)``: ``weight``, ``budget`` (tokens), ``whole`` epochs
    and the ``rest`` of tokens. Sources without tokens are left as they are: one epoch."""
    live = materialise(sources.filter("tokens > 0"), "sources")
    total = live.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    e = exponent(live, float(budget), float(total), entropy, epochs) if total else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(e))
    z = live.agg(F.sum(power)).first()[0] or 1.0
    own = F.floor(F.lit(float(budget)) * power / z).cast("long")
    out = live.select("source", "tokens", (power / z).alias("weight"), own.alias("budget"))
    whole = F.call_function("div", F.col("budget"), F.col("tokens"))
    return out.select("*", whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42, **target) -> DataFrame:
    """The mix: ``row`` (all columns of ``docs``), ``source_key``, ``n_tokens``, ``weight``,
    ``epoch`` (from 0), ``block_key`` and ``doc_key``; ordered by (epoch, block_key, doc_key) the
    rows of a source are its permutations.

    ``target``: ``budget`` (tokens; all there are by default), ``entropy`` and ``epochs``. A
    document is in or out as a whole; a source exceeds its budget by less than one document
    or group of equal rows (they have equal keys and go together). Null sources form one
    source. Documents without words cost nothing and go with the others of their block.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), source_key(F.col(f"`{source}`")).alias("source_key"), word_count(F.col(f"`{text}`")).alias("n_tokens"))
    doc = F.xxhash64(F.lit(seed), F.col(f"row.`{key}`"), "source_key", "n_tokens", F.xxhash64(F.col(f"row.`{text}`")))
    rows = rows.withColumn("doc", doc).withColumn("block", F.pmod("doc", F.lit(BLOCKS)).cast("int"))
    blocks = materialise(rows.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    plans = materialise(plan(blocks.groupBy(F.col("source_key").alias("source")).agg(F.sum("tokens").alias("tokens")), **target), "plan")
    plans = plans.withColumnRenamed("source", "source_key").withColumnRenamed("tokens", "source_tokens")

    def block_key(epoch) -> Column:
        return F.xxhash64(F.lit(seed), epoch, "source_key", "block")

    def doc_key(epoch) -> Column:
        return F.xxhash64(F.lit(seed), epoch, "doc")

    # The block of each source in which its rest runs out: at most BLOCKS rows per source.
    order = Window.partitionBy("source_key").orderBy("block_key", "block")
    ranked = blocks.join(plans, "source_key").withColumn("block_key", block_key(F.col("whole")))
    ranked = ranked.withColumn("after", F.sum("tokens").over(order))
    last = ranked.filter("after >= rest and after - tokens < rest").select("source_key", F.col("block").alias("last_block"), F.col("block_key").alias("last_key"), (F.col("rest") - (F.col("after") - F.col("tokens"))).alias("left"))
    last = materialise(last, "last")
    # Its documents, equal keys summed before the shuffle, up to the one that fills the rest.
    inside = rows.select("source_key", "block", "doc", "n_tokens").join(last, [rows.source_key == last.source_key, rows.block == last.last_block]).drop(last.source_key)
    inside = inside.join(plans.select("source_key", "whole"), "source_key").withColumn("doc_key", doc_key(F.col("whole")))
    inside = inside.groupBy("source_key", "doc_key").agg(F.sum("n_tokens").alias("n"), F.max("left").alias("left"))
    ahead = Window.partitionBy("source_key").orderBy("doc_key")
    border = inside.withColumn("before", F.sum("n").over(ahead) - F.col("n")).filter(F.col("before") < F.col("left")).groupBy("source_key").agg(F.max("doc_key").alias("last_doc"))
    drawn = materialise(plans.join(last, "source_key", "left").join(border, "source_key", "left").select("source_key", "weight", "whole", "rest", "last_block", "last_key", "last_doc"), "draw")
    # A row per source joins back; the adaptive skew join splits the documents of a hot one.
    out = rows.join(drawn, "source_key", "left")
    own = block_key(F.col("whole"))
    before = (own < F.col("last_key")) | ((own == F.col("last_key")) & (F.col("block") < F.col("last_block")))
    within = (F.col("block") == F.col("last_block")) & (doc_key(F.col("whole")) <= F.col("last_doc"))
    extra = F.when((F.col("rest") > 0) & (before | within), 1).otherwise(0)
    copies = F.when(F.col("whole").isNull(), 1).otherwise(F.col("whole") + extra).cast("long")
    out = out.withColumn("copies", copies).filter("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.select("row", "source_key", "n_tokens", "weight", "epoch", block_key(F.col("epoch")).alias("block_key"), doc_key(F.col("epoch")).alias("doc_key"))


#: Sources become as even as nine tenths of the largest entropy; none is read over four times.
TARGET = {"entropy": 0.9, "epochs": 4.0}


def query(spark, sf_dir: str) -> DataFrame:
    """One row per drawn document and epoch."""
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), **TARGET)
    return out.select("row.doc_id", "row.source", "n_tokens", "weight", "epoch", "block_key", "doc_key")
