"""Masks: the signs of the 64 numbers of an embedding as an 8 x 8 grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.operators import masks, match
from sparkcurate.plans.registry import query, table

H = 8
PIXELS = """px AS (SELECT vec_id, i, embedding[i + 1] > 0 AS lit
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""
RUNS = f"""{PIXELS}, g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS grp FROM px WHERE lit)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return masks.runs(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", F.transform("embedding", lambda v: v > 0))


@query("mask_runs", f"WITH {RUNS} SELECT vec_id, min(i) AS run_start, count(*) AS run_len FROM g GROUP BY vec_id, grp")
def mask_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf)


@query("mask_area", f"WITH {PIXELS} SELECT vec_id, count(*) AS area FROM px WHERE lit GROUP BY 1")
def mask_area(spark: SparkSession, sf: str) -> DataFrame:
    return masks.area(runs(spark, sf), "vec_id")


@query(
    "mask_bbox",
    f"""WITH {PIXELS} SELECT vec_id, min(i // 8) AS x, min(i % 8) AS y, max(i // 8) - min(i // 8) + 1 AS w,
      max(i % 8) - min(i % 8) + 1 AS h FROM px WHERE lit GROUP BY 1""",
)
def mask_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return masks.bbox(runs(spark, sf), "vec_id", H)


@query(
    "mask_iou",
    f"""WITH {PIXELS}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, count(*) FILTER (WHERE a.lit AND b.lit) AS inter,
        count(*) FILTER (WHERE a.lit OR b.lit) AS union_px FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1, 2)
    SELECT a, b, inter, union_px, round(CASE WHEN union_px = 0 THEN 1.0 ELSE inter / union_px END, 6) AS iou,
      round(inter / (union_px + 0.000001::DOUBLE), 6) AS iou_eps FROM p""",
)
def mask_iou(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "embeddings").select("vec_id")
    nxt = ids.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"))
    pairs = nxt.join(ids.select(F.col("vec_id").alias("a")), "a", "left_semi")
    out = masks.overlap(pairs, runs(spark, sf), "vec_id", "a", "b")
    return out.withColumns({"iou": F.round("iou", 6), "iou_eps": F.round("iou_eps", 6)})


@query(
    "mask_crop",
    f"""WITH {PIXELS}, c AS (SELECT vec_id, (i // 8 - 2) * 5 + (i % 8 - 1) AS i FROM px
        WHERE lit AND i // 8 >= 2 AND i // 8 < 7 AND i % 8 >= 1 AND i % 8 < 6),
    g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS grp FROM c)
    SELECT vec_id, min(i) AS run_start, count(*) AS run_len FROM g GROUP BY vec_id, grp""",
)
def mask_crop(spark: SparkSession, sf: str) -> DataFrame:
    return masks.crop(runs(spark, sf), "vec_id", H, [F.lit(2), F.lit(1), F.lit(7), F.lit(6)])


GRAY = """CAST(trunc(abs(embedding[i + 1]::DOUBLE) * 10000) AS INT)"""


@query(
    "mask_unify",
    f"""WITH v AS (SELECT vec_id, label, i, CASE vec_id % 6 WHEN 0 THEN CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END
          WHEN 1 THEN CASE WHEN embedding[i + 1] > 0 THEN 255 ELSE 0 END WHEN 2 THEN 0 WHEN 3 THEN {GRAY} % 100
          WHEN 4 THEN {GRAY} % 256 ELSE CASE {GRAY} % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 255 END END AS val,
        CASE WHEN vec_id % 7 = 0 THEN 1 WHEN vec_id % 7 = 1 THEN 77 END AS target, vec_id % 5 = 0 AS strict
      FROM embeddings, (SELECT unnest(range(64)) AS i)),
    m AS (SELECT vec_id, target, strict, max(val) AS top, bool_and(val IN (0, 1, 255)) AS bin, bool_and(val IN (0, 255)) AS b255,
        coalesce(bool_or(val = target), false) AS has_target, count(*) FILTER (WHERE val = target) AS n_target,
        count(*) FILTER (WHERE val > 0) AS n_pos, count(*) FILTER (WHERE val >= 128) AS n_high,
        string_agg(DISTINCT CAST(val AS VARCHAR), ',' ORDER BY CAST(val AS VARCHAR)) AS uniq FROM v GROUP BY ALL),
    e AS (SELECT *, CASE WHEN top = 0 THEN 'empty_mask' WHEN target IS NOT NULL THEN CASE WHEN NOT has_target THEN 'class_id_not_found' END
          WHEN strict AND NOT b255 THEN 'non_0_255_mask_values_for_strict_dataset' WHEN NOT bin AND top < 128 THEN 'all_values_below_threshold' END AS error,
        CASE WHEN top = 0 THEN '' WHEN target IS NOT NULL THEN 'class_id=' || target WHEN strict AND NOT b255 THEN ''
          WHEN bin THEN 'binary_nonzero' ELSE 'threshold>=128' END AS method FROM m)
    SELECT vec_id, error, method, CASE WHEN error IS NOT NULL THEN 0 WHEN target IS NOT NULL THEN n_target WHEN bin THEN n_pos ELSE n_high END AS foreground,
      uniq AS unique_values FROM e""",
)
def mask_unify(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("vec_id") % 6

    def gray(v):
        return F.abs(v.cast("double") * 10000).cast("int")

    def value(v):
        lit = v > 0
        return (
            F.when(kind == 0, F.when(lit, 1).otherwise(0))
            .when(kind == 1, F.when(lit, 255).otherwise(0))
            .when(kind == 2, 0)
            .when(kind == 3, gray(v) % 100)
            .when(kind == 4, gray(v) % 256)
            .otherwise(F.when(gray(v) % 3 == 0, 0).when(gray(v) % 3 == 1, 1).otherwise(255))
        )

    slot = F.col("vec_id") % 7
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", value).alias("values"),
        F.when(slot == 0, 1).when(slot == 1, 77).alias("target"),
        F.when(F.col("vec_id") % 5 == 0, "strict_set").otherwise("open_set").alias("dataset"),
    )
    got = masks.unify(F.col("values"), F.col("dataset"), F.col("target"), strict=["strict_set"])
    got["unique_values"] = F.array_join(F.array_sort(got["unique_values"].cast("array<string>")), ",")
    return rows.select("vec_id", *[c.alias(n) for n, c in got.items()])


@query(
    "size_check",
    """SELECT vec_id, CASE WHEN doc_id IS NULL THEN 'no_image' WHEN n_chars % 3 <> 0 AND n_chars % 5 <> 0 THEN 'ok' ELSE 'size_mismatch' END AS status
    FROM embeddings LEFT JOIN (SELECT CASE WHEN lang = 'de' THEN -1 - doc_id ELSE doc_id END AS doc_id, n_chars FROM documents) d ON vec_id = doc_id""",
)
def size_check(spark: SparkSession, sf: str) -> DataFrame:
    chars = F.col("n_chars")
    # German documents have keys that no vector has
    own = F.when(F.col("lang") == "de", -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    images = table(spark, sf, "documents").select(
        own.alias("vec_id"), F.when(chars % 3 == 0, 16).otherwise(8).alias("height"),
        F.when(chars % 5 == 0, 4).otherwise(8).alias("width"),
    )
    grids = table(spark, sf, "embeddings").select("vec_id", F.lit(8).alias("height"), (F.size("embedding") / 8).cast("int").alias("width"))
    return match.size_check(grids, images, "vec_id").select("vec_id", "status")
