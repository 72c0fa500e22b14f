"""Near-duplicate vectors by an exact range join in a metric space.

On unit vectors, cosine ``c`` is the distance ``sqrt(2 - 2 c)``, so links are pairs within a
radius. Pivots, a bounded sample per label, split a label into cells: a vector's home is its
nearest pivot. A vector also goes to another cell if a partner could live there: by the
triangle inequality its pivot is at most ``2 r`` farther than the home pivot, and the plane
half-way between both pivots is within ``r``. Pairs across cells are found in the lower
one, so a vector goes to lower cells only. Cells then join on their own.

Equal vectors of a label are one class with a count. A cell above ``BLOCK`` members (many
close vectors) is dealt into blocks and joined block by block. A join sends on, per class,
the sum of its links and one edge to the root of its part: never the pairs. Nothing is
dropped: each link is found once, whatever the pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.llm.graph import components
from sparkcurate.session import materialise

COSINE = 0.98
CELL, BLOCK = 2000, 2048
MAX_PIVOTS, MAX_LABELS = 64, 64  # pivots per label, labels that get pivots: bounds of what the driver holds
SLACK = 1e-9  # for rounding: only sends a vector to one more cell


def _unit(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _homes(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home of every row, and (row, cell) for the lower cells that may hold a partner."""
    square = np.maximum(0.0, 2 - 2 * unit @ pivots.T)
    home = square.argmin(axis=1)
    own = square[np.arange(len(unit)), home]
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))[home]
    triangle = np.sqrt(square) <= np.sqrt(own)[:, None] + 2 * radius + SLACK
    plane = square - own[:, None] <= 2 * radius * apart + SLACK
    row, cell = np.nonzero(triangle & plane & (np.arange(len(pivots)) < home[:, None]))
    return home, row, cell


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, root[side], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def usable(label: str = "label", vector: str = "embedding"):
    """Rows that can link: label and vector there, every component finite, not all zero."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``vectors[key]`` with ``n_links`` (other rows linked directly), ``component_id`` (smallest
    key reachable, itself included) and ``kept`` (it is that key), one row per row.

    Rows that cannot link (``usable``) stay alone. Vectors of different length never link.
    Repeated rows link with each other; rows that share the smallest key are all kept. Other
    columns are not read, so their names cannot clash.
    """
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    rows = rows.withColumn("ok", usable("label", "v"))
    live = rows.filter("ok")
    classes = live.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "classes")
    pivots = _pivots(classes)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            table = pa.table(batch)
            keys = list(zip(table["label"].to_pylist(), table["dim"].to_pylist()))
            for k in set(keys):
                own = table.take(pa.array([i for i, x in enumerate(keys) if x == k]))
                found = shared.value.get(k)
                if found is None:
                    at, cell, home = np.arange(len(own)), np.zeros(len(own), np.int32), np.ones(len(own), bool)
                else:
                    homes, row, other = _homes(_unit(own["v"]), found, radius)
                    at, cell = np.concatenate([np.arange(len(own)), row]), np.concatenate([homes, other])
                    home = np.arange(len(at)) < len(own)
                out = own.select(["label", "dim", "v", "cid", "copies"]).take(pa.array(at))
                out = out.append_column("cell", pa.array(cell, pa.int32())).append_column("home", pa.array(home))
                yield from out.combine_chunks().to_batches()

    kind = classes.schema["label"].dataType.simpleString(), classes.schema["v"].dataType.simpleString()
    placed = classes.select("label", "dim", "v", "cid", "copies").mapInArrow(assign, f"label {kind[0]}, dim int, v {kind[1]}, cid long, copies long, cell int, home boolean")
    placed = materialise(placed, "cells")
    sizes = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(materialise(sizes, "sizes"), ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(F.col("block"), other).alias("lo"), F.greatest(F.col("block"), other).alias("hi"))))
    dealt = dealt.select("label", "dim", "cell", "v", "cid", "copies", "home", "block", pair.alias("p")).select("*", "p.lo", "p.hi").drop("p")

    def join(table: pa.Table) -> pa.Table:
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        block, home = table["block"].to_numpy(), table["home"].to_numpy()
        cid, copies, unit = table["cid"].to_numpy(), table["copies"].to_numpy(), _unit(table["v"])
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        near = unit[a] @ unit[b].T >= cosine
        near &= home[a][:, None] | home[b]
        if lo == hi:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        x, y = a[x], b[y]
        total = np.bincount(x, copies[y], len(cid)) + np.bincount(y, copies[x], len(cid))
        root = _roots(len(cid), x, y)
        has = np.flatnonzero(total)
        return pa.table({"cid": cid[has], "linked": total[has].astype(np.int64), "root": cid[root[has]]})

    found = materialise(dealt.groupBy("label", "dim", "cell", "lo", "hi").applyInArrow(join, "cid long, linked long, root long"), "links")
    links = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    groups = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid").withColumnRenamed("root", "top")
    rooted = classes.select("label", "v", "cid", "least", "copies").join(links, "cid", "left").join(groups, "cid", "left")
    rooted = materialise(rooted.withColumn("top", F.coalesce("top", "cid")), "rooted")
    smallest = rooted.groupBy("top").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(smallest, "top").select("label", "v", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = live.select("id", "label", "v").join(of_class, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _pivots(classes: DataFrame) -> dict:
    """Unit pivots of the labels with more than one cell's worth of vectors: at most
    ``MAX_LABELS * MAX_PIVOTS`` vectors reach the driver."""
    large = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > CELL).orderBy(F.desc("n"), "label", "dim").limit(MAX_LABELS)
    large = materialise(large, "large")
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("v"), "cid")
    some = classes.join(large, ["label", "dim"]).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= MAX_PIVOTS)
    some = some.filter(F.col("i") <= F.ceil(F.col("n") / CELL))
    out: dict = {}
    for r in some.select("label", "dim", "v").collect():
        out.setdefault((r.label, r.dim), []).append(r.v)
    return {k: _unit(pa.array(v)) for k, v in out.items()}


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN links USING (vec_id)
"""
