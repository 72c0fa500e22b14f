"""Near duplicates by 64-bit SimHash over three-word shingles.

Candidates come from an inverted index over byte positions. A fingerprint has eight
bytes; three differing bits spoil at most three of them, so linked fingerprints share at
least ``8 - 3 = 5`` positional bytes, and five of eight positions always put three into
one half. The index therefore posts each fingerprint under every three positional bytes
of a half (eight postings): no linked pair is missed, and a posting list holds
``n / 2**24`` fingerprints instead of the ``n / 256`` of single bytes, which would pair
up everything. For every pair met in a list the shared positional bytes are tallied,
pairs below the guaranteed minimum are dropped, and the rest is verified bit by bit.

Equal fingerprints are one class before any pairing. A posting list longer than
``dense`` classes (many close copies) is refined: its members are posted again under every
two of the five other bytes, of which linked ones share at least two. The tally and the
check of the bits are part of the join condition, so only links leave the join, and the
adaptive skew join splits a long list over tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.graph import components
from sparkcurate.session import materialise

BITS, SEED, WORDS = 3, 42, 3
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
CHUNK = 1 << 16


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """SimHash of one text; null and empty texts have fingerprint zero."""
    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(words, len(parts)) - 1 :]
    tally = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array(
            [digest(line[a:b], SEED) for a, b in zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist())],
            np.uint64,
        )
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        tally += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(tally * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", words: int = WORDS) -> DataFrame:
    """Add the signed 64-bit fingerprint of ``text``; rows stay as they are."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint_of(t.as_py(), words) for t in texts], np.uint64)
        return pa.array(found.view(np.int64))

    return docs.withColumn(out, simhash(F.col(text).cast("string")))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _mask(positions) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


#: Any five of eight positions hold three of one half.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: For a triple, two more of the other five; linked fingerprints share five bytes in all.
REFINED = {s: [(*t, *two) for two in combinations([p for p in range(8) if p not in t], 2)] for s, t in enumerate(TRIPLES)}


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the positional bytes that two fingerprints share."""
    diff = a.bitwiseXOR(b)
    return sum((F.when(diff.bitwiseAND(F.lit(_mask([p]))) == 0, 1).otherwise(0) for p in range(1, 8)), F.when(diff.bitwiseAND(F.lit(_mask([0]))) == 0, 1).otherwise(0))


def _post(fps: DataFrame, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """Inverted index: one row per fingerprint and mask."""
    keys = F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(m))).alias("key")) for i, m in masks])
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.slot", "k.key")


def _within(index: DataFrame, bits: int) -> DataFrame:
    """Pairs of a posting list that pass the count filter and the check."""
    a, b = index.alias("a"), index.alias("b")
    x, y = F.col("a.fp"), F.col("b.fp")
    on = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (x < y)
    on = on & (shared_bytes(x, y) >= 8 - bits) & (F.bit_count(x.bitwiseXOR(y)) <= bits)
    return a.join(b, on).select(x.alias("a"), y.alias("b"))


def links(fps: DataFrame, bits: int = BITS, dense: int = 512) -> DataFrame:
    """Distinct pairs ``(a, b)``, ``a < b``, of distinct fingerprints ``fp`` that differ in
    at most ``bits`` (three or fewer) bits. ``dense`` only decides how a list is paired,
    never what is found."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees three differing bits")
    index = materialise(_post(fps.select("fp"), list(enumerate(TRIPLES))), "postings")
    lists = materialise(index.groupBy("slot", "key").count().filter(F.col("count") > dense).select("slot", "key"), "dense")
    if lists.isEmpty():
        return _within(index, bits).distinct()
    sparse = index.join(lists, ["slot", "key"], "left_anti")
    more = index.join(lists, ["slot", "key"], "left_semi")
    found = _within(sparse, bits)
    fine = None
    for slot, masks in REFINED.items():
        part = _post(more.filter(F.col("slot") == slot), [(slot * 100 + i, m) for i, m in enumerate(masks)])
        fine = part if fine is None else fine.union(part)
    return found.union(_within(materialise(fine, "postings"), bits)).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, words: int = WORDS) -> DataFrame:
    """``docs[key]`` with ``fp`` and ``component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest key that a row reaches over links. Null and empty
    texts have fingerprint zero and are linked like any other. Repeated rows are kept and
    fall into one component; a null key is never the smallest unless all are null. Other
    columns of ``docs`` are not read, so their names cannot clash.
    """
    prints = materialise(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), words=words).select("key", "fp"), "prints")
    return with_components(prints, bits).withColumnRenamed("key", key)


def with_components(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Add ``component_id`` to a written table that holds ``key`` and ``fp``."""
    classes = materialise(prints.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    groups = components(links(classes, bits))
    rooted = classes.join(groups.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_class, "fp")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with one of each near-duplicate group: the smallest key, and of
    equal smallest keys one row. Columns stay as they are."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = fingerprints(rows.withColumn("text", F.col(f"row.`{text}`"))).select(F.monotonically_increasing_id().alias("uid"), "row", "fp")
    rows = materialise(rows, "rows")
    prints = rows.select(F.struct(F.col(f"row.`{key}`").isNull().alias("none"), F.col(f"row.`{key}`").alias("id"), "uid").alias("key"), "fp")
    first = with_components(prints, bits).select("component_id").distinct().select(F.col("component_id.uid").alias("uid"))
    return rows.join(first, "uid", "left_semi").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.format_string("%016x", "fp").alias("fingerprint"), "component_id")
