"""Label instances and boxes: ``lineitem`` rows as labels of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import geometry, names, paths
from sparkcurate.operators import match, metrics, regroup
from sparkcurate.operators.ranking import rank_rows, top_per_key
from sparkcurate.plans.registry import query, table
from sparkcurate.session import materialise, new_path
from sparkcurate.sources import documents, sinks

ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
ROW_SQL = ", ".join(ROW)
W, H = 641, 487


def lines(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*ROW, *extra)


def with_part(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", *cols)
    return lines(spark, sf).join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


def r6(c: Column, name: str) -> Column:
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


@query(
    "count_buckets",
    """SELECT l_orderkey, l_returnflag, count(*) AS bucket FROM lineitem
    GROUP BY 1, 2 HAVING count(*) BETWEEN 1 AND 5""",
)
def count_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    found = metrics.count_buckets(rows, ["l_orderkey", "l_returnflag"])
    folder = new_path(spark, "buckets")
    sinks.write_parts(found, folder, "bucket")
    return sinks.read_parts(spark, folder, found.schema)


@query(
    "bucket_summary",
    """WITH b AS (SELECT l_orderkey, l_returnflag, count(*) AS bucket FROM lineitem GROUP BY 1, 2)
    SELECT bucket, count(*) AS rows, count(DISTINCT l_orderkey) AS unique_images FROM b
    WHERE bucket BETWEEN 1 AND 5 GROUP BY bucket""",
)
def bucket_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bucket_summary(count_buckets(spark, sf), "l_orderkey")


@query(
    "bucket_conflicts",
    f"""WITH r AS (SELECT *, l_linenumber % 5 + 1 AS bucket,
        row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {ROW_SQL}) AS rn FROM lineitem),
    f AS (SELECT l_orderkey, l_returnflag, bucket FROM r WHERE rn = 1)
    SELECT l_orderkey, l_returnflag, f.bucket,
      (SELECT count(*) FROM r WHERE r.l_orderkey = f.l_orderkey AND r.l_returnflag = f.l_returnflag
         AND r.bucket <> f.bucket) AS conflicts
    FROM f""",
)
def bucket_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf, "l_returnflag").withColumn("bucket", F.col("l_linenumber") % 5 + 1)
    return regroup.conflicts(rows, ["l_orderkey", "l_returnflag"], "bucket", ROW)


@query(
    "cat_index",
    f"""SELECT {ROW_SQL}, l_returnflag AS category,
      row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {ROW_SQL}) - 1 AS cat_index FROM lineitem""",
)
def cat_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf, "l_returnflag").withColumnRenamed("l_returnflag", "category")
    ranked = rank_rows(rows, ["l_orderkey", "category"], [F.col(c) for c in ROW[1:]], "_r")
    return ranked.select(*ROW, "category", (F.col("_r") - 1).alias("cat_index"))


@query(
    "topk_area",
    f"""SELECT {ROW_SQL}, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, {ROW_SQL}) AS area_rank
    FROM lineitem QUALIFY area_rank <= 12""",
)
def topk_area(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("l_quantity").desc(), *[F.col(c) for c in ROW]]
    return top_per_key(lines(spark, sf), ["l_suppkey"], order, 12, "area_rank")


@query(
    "label_block",
    f"""WITH t AS (SELECT l_orderkey, l_returnflag || l_linestatus AS name,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, {ROW_SQL}) AS rk FROM lineitem),
    e AS (SELECT l_orderkey, name, count(*) AS n, min(rk) AS first FROM t WHERE rk <= 12 GROUP BY 1, 2),
    b AS (SELECT l_orderkey, string_agg(name, chr(10) ORDER BY first) AS label_names,
        string_agg(name || ': ' || n, chr(10) ORDER BY n DESC, first) AS label_counts FROM e GROUP BY 1),
    c AS (SELECT l_orderkey, count(*) AS n FROM t GROUP BY 1)
    SELECT o_orderkey AS image, coalesce(c.n, 0) AS n_instances, coalesce(label_names, '(none)') AS label_names,
      coalesce(label_counts, '(none)') AS label_counts
    FROM orders LEFT JOIN c ON o_orderkey = c.l_orderkey LEFT JOIN b ON o_orderkey = b.l_orderkey""",
)
def label_block(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("l_returnflag", "l_linestatus")
    labels = table(spark, sf, "lineitem").select(*ROW, F.col("l_orderkey").alias("image"), name.alias("name"))
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"))
    return regroup.label_block(images, labels, "l_quantity", ROW)


def centre_box() -> list[Column]:
    return [
        (F.col("l_partkey") % 97 + 1) / 101.0, (F.col("l_suppkey") % 89 + 1) / 103.0,
        F.col("l_quantity") / 107.0, F.col("l_linenumber") / 13.0,
    ]


CENTRE = """SELECT *, (l_partkey % 97 + 1) / 101.0::DOUBLE AS cx, (l_suppkey % 89 + 1) / 103.0::DOUBLE AS cy,
  l_quantity / 107.0::DOUBLE AS bw, l_linenumber / 13.0::DOUBLE AS bh FROM lineitem"""


@query(
    "label_lines",
    f"""WITH b AS ({CENTRE}), c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS cid
      FROM (SELECT DISTINCT p_brand FROM part))
    SELECT l_orderkey AS stem, printf('%d %.5f %.5f %.5f %.5f', cid, cx, cy, bw, bh) AS line
    FROM b JOIN part ON l_partkey = p_partkey JOIN c USING (p_brand)""",
)
def label_lines(spark: SparkSession, sf: str) -> DataFrame:
    return drawn(spark, sf).select(F.col("l_orderkey").alias("stem"), "line")


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    cats = regroup.category_ids(table(spark, sf, "part"), "p_brand")
    line = geometry.label_line(F.col("cid"), centre_box())
    return with_part(spark, sf, "p_brand").join(cats, "p_brand").select(*ROW, line.alias("line"))


@query(
    "label_files",
    f"""WITH b AS ({CENTRE}), c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS cid
      FROM (SELECT DISTINCT p_brand FROM part)),
    l AS (SELECT {ROW_SQL}, printf('%d %.5f %.5f %.5f %.5f', cid, cx, cy, bw, bh) AS line
      FROM b JOIN part ON l_partkey = p_partkey JOIN c USING (p_brand))
    SELECT l_orderkey AS stem, 0::BIGINT AS page, string_agg(line, chr(10) ORDER BY {ROW_SQL}) || chr(10) AS content FROM l GROUP BY 1""",
)
def label_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = drawn(spark, sf).withColumn("stem", F.col("l_orderkey"))
    return sinks.label_files(rows, "stem", "line", [F.col(c) for c in ROW[1:]])


@query(
    "top_counts",
    """SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20""",
)
def top_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_counts(with_part(spark, sf, "p_name"), "p_name", 20)


@query(
    "dataset_stats",
    """SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_image, count(DISTINCT p_name) AS distinct_object,
      count(DISTINCT p_type) AS distinct_affordance FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_part(spark, sf, "p_name", "p_type").select(
        F.col("l_orderkey").alias("image"), F.col("p_name").alias("object"), F.col("p_type").alias("affordance")
    )
    return metrics.dataset_stats(rows, ["image", "object", "affordance"])


@query(
    "semi_reduce",
    f"""SELECT {ROW_SQL} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)""",
)
def semi_reduce(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    return lines(spark, sf).join(wanted, "l_orderkey", "left_semi").select(*ROW)


@query(
    "vocab_semi",
    f"""SELECT {ROW_SQL}, p_name AS object FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size > 45 AND p_type = 'PROMO')""",
)
def vocab_semi(spark: SparkSession, sf: str) -> DataFrame:
    # both spellings differ from the stored one and meet after normalisation
    shouted = F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit(" \t "))))
    allowed = (
        table(spark, sf, "part").filter("p_size > 45 AND p_type = 'PROMO'")
        .select(names.squeezed_name(F.initcap("p_name")).alias("object")).distinct()
    )
    rows = with_part(spark, sf, "p_name").withColumn("object", names.squeezed_name(shouted))
    return rows.join(allowed, "object", "left_semi").select(*ROW, "object")


@query(
    "manifest_enrich",
    f"""WITH b AS ({CENTRE}), m AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey,
        500 + o_custkey % 141 AS w, 400 + o_custkey % 87 AS h FROM orders),
    x AS (SELECT b.*, w, h, greatest(0, least((cx - bw / 2) * w, w)) AS x1, greatest(0, least((cy - bh / 2) * h, h)) AS y1,
        greatest(0, least((cx + bw / 2) * w, w)) AS x2, greatest(0, least((cy + bh / 2) * h, h)) AS y2
      FROM b LEFT JOIN m ON l_orderkey = o_orderkey)
    SELECT {ROW_SQL}, w AS image_width, h AS image_height, w IS NOT NULL AS found,
      CASE WHEN w IS NOT NULL THEN l_returnflag || ' ' || printf('[%.2f,%.2f,%.2f,%.2f]', x1::DOUBLE, y1::DOUBLE, x2::DOUBLE, y2::DOUBLE) END AS instance,
      CASE WHEN w IS NOT NULL THEN round(bw * bh, 6) END AS area
    FROM x""",
)
def manifest_enrich(spark: SparkSession, sf: str) -> DataFrame:
    cust = F.col("o_custkey")
    # pending orders have keys that no line has
    order = F.when(F.col("o_orderstatus") == "P", -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    manifest = table(spark, sf, "orders").select(
        order.alias("l_orderkey"), (500 + cust % 141).alias("image_width"), (400 + cust % 87).alias("image_height")
    )
    rows = match.lookup_join(lines(spark, sf, "l_returnflag"), manifest, ["l_orderkey"])
    cx, cy, bw, bh = centre_box()
    box = geometry.centre_to_xyxy(cx, cy, bw, bh, F.col("image_width"), F.col("image_height"))
    text = F.concat("l_returnflag", F.lit(" "), geometry.box_text(box))
    return rows.select(
        *ROW, "image_width", "image_height", "found",
        F.when(F.col("found"), text).alias("instance"), F.when(F.col("found"), F.round(bw * bh, 6)).alias("area"),
    )


@query(
    "category_join",
    f"""WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS cid
      FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#7'))
    SELECT {ROW_SQL}, cid, p_brand AS category,
      CASE WHEN CAST(substr(p_brand, 7) AS INT) <= 15 THEN p_brand ELSE 'cat_' || substr(p_brand, 7) END AS class_name
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN c USING (p_brand)""",
)
def category_join(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_brand")
    cats = regroup.category_ids(part.filter("p_brand <> 'Brand#7'"), "p_brand")
    number = F.substr("p_brand", F.lit(7)).cast("int")
    class_file = part.select(number.alias("category_id"), F.col("p_brand").alias("listed")).filter("category_id <= 15").distinct()
    rows = with_part(spark, sf, "p_brand").join(cats, "p_brand").withColumn("category_id", number)
    named = rows.join(class_file, "category_id", "left")
    fallback = F.concat(F.lit("cat_"), F.col("category_id").cast("string"))
    return named.select(*ROW, "cid", F.col("p_brand").alias("category"), F.coalesce("listed", fallback).alias("class_name"))


REQUEST_WORDS = ["ring", "Small Ring", "old gear box", "BOLT", "anvil", "red", "rod", "zzz"]
WORDS_SQL = "['" + "','".join(REQUEST_WORDS) + "']"


def requests(spark: SparkSession, sf: str, words: list[str]) -> DataFrame:
    listed = F.array(*[F.lit(w) for w in words])
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image"),
        F.get(listed, (F.col("o_custkey") % len(words)).cast("int")).alias("name"),
        (F.col("o_orderkey") % 3).alias("k"),
    )


@query(
    "contains_kth",
    f"""WITH q AS (SELECT o_orderkey AS image, {WORDS_SQL}[o_custkey % 8 + 1] AS name, o_orderkey % 3 AS k FROM orders),
    b AS (SELECT *, lower(p_name) AS category FROM lineitem JOIN part ON l_partkey = p_partkey),
    cats AS (SELECT DISTINCT category FROM b),
    hit AS (SELECT q.image, q.name, q.k, b.l_linenumber, b.l_partkey, b.l_suppkey,
        row_number() OVER (PARTITION BY q.image, q.name, q.k ORDER BY {ROW_SQL}) - 1 AS r
      FROM q JOIN b ON q.image = b.l_orderkey AND CASE
        WHEN lower(q.name) IN (SELECT category FROM cats) THEN b.category = lower(q.name)
        ELSE contains(b.category, lower(q.name)) OR contains(lower(q.name), b.category) END)
    SELECT q.image, q.name, q.k, l_linenumber, l_partkey, l_suppkey
    FROM q LEFT JOIN hit ON q.image = hit.image AND q.name = hit.name AND hit.k = q.k AND r = q.k""",
)
def contains_kth(spark: SparkSession, sf: str) -> DataFrame:
    boxes = with_part(spark, sf, "p_name").withColumnRenamed("p_name", "category").withColumn("image", F.col("l_orderkey"))
    found = match.kth_match(requests(spark, sf, REQUEST_WORDS), boxes, [F.col(c) for c in ROW[1:]])
    return found.select("image", "name", "k", "l_linenumber", "l_partkey", "l_suppkey")


TYPE_WORDS = ["eco", "Small", "a large box", "PROMO", "m", "zzz"]
TYPES_SQL = "['" + "','".join(TYPE_WORDS) + "']"


@query(
    "nearest_rank",
    f"""WITH q AS (SELECT o_orderkey AS image, {TYPES_SQL}[o_custkey % 6 + 1] AS name, o_orderkey % 3 AS k FROM orders),
    b AS (SELECT l_orderkey AS image, p_type AS category,
        row_number() OVER (PARTITION BY l_orderkey, p_type ORDER BY {ROW_SQL}) - 1 AS cat_index,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY {ROW_SQL}) AS ord
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    hit AS (SELECT q.image, q.name, q.k, category, cat_index FROM q JOIN b ON q.image = b.image
        AND (contains(lower(category), lower(name)) OR contains(lower(name), lower(category)))
      QUALIFY row_number() OVER (PARTITION BY q.image, q.name, q.k ORDER BY abs(cat_index - k), ord) = 1)
    SELECT q.image, q.name, q.k, category, cat_index FROM q LEFT JOIN hit USING (image, name, k)""",
)
def nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_part(spark, sf, "p_type").select(
        F.col("l_orderkey").alias("image"), F.col("p_type").alias("category"), F.struct(*ROW[1:]).alias("ord")
    )
    boxes = rank_rows(rows, ["image", "category"], [F.col("ord")], "_r")
    # the box index is a stage of its own: built and written once, then looked up
    boxes = materialise(boxes.withColumn("cat_index", F.col("_r") - 1).drop("_r"), "box-index")
    return match.nearest_rank(requests(spark, sf, TYPE_WORDS), boxes).select("image", "name", "k", "category", "cat_index")


def pixel_box() -> list[Column]:
    """Corners around the image border, so that clipping matters."""
    x, y = F.col("l_quantity") * 14 - 30, (F.col("l_suppkey") % 97) * 5.5 - 20
    return geometry.xywh_to_xyxy(x, y, (F.col("l_partkey") % 97) * 1.0, F.col("l_linenumber") * 9.0)


PIXEL = """SELECT *, l_quantity * 14 - 30 AS x1, (l_suppkey % 97) * 5.5::DOUBLE - 20 AS y1,
  l_quantity * 14 - 30 + (l_partkey % 97) * 1.0::DOUBLE AS x2,
  (l_suppkey % 97) * 5.5::DOUBLE - 20 + l_linenumber * 9.0::DOUBLE AS y2 FROM lineitem"""


@query(
    "bbox_convert",
    f"""WITH p AS ({PIXEL}), k AS (SELECT {ROW_SQL}, greatest(0, least(x1, {W})) AS a, greatest(0, least(y1, {H})) AS b,
        greatest(0, least(x2, {W})) AS c, greatest(0, least(y2, {H})) AS d FROM p),
    n AS (SELECT *, (a + greatest(0, c - a) / 2) / {W} AS cx, (b + greatest(0, d - b) / 2) / {H} AS cy,
        greatest(0, c - a) / {W} AS w, greatest(0, d - b) / {H} AS h FROM k)
    SELECT {ROW_SQL}, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h,
      round(greatest(0, least((cx - w / 2) * {W}, {W})), 6) AS x1, round(greatest(0, least((cy - h / 2) * {H}, {H})), 6) AS y1,
      round(greatest(0, least((cx + w / 2) * {W}, {W})), 6) AS x2, round(greatest(0, least((cy + h / 2) * {H}, {H})), 6) AS y2
    FROM n""",
)
def bbox_convert(spark: SparkSession, sf: str) -> DataFrame:
    w, h = F.lit(float(W)), F.lit(float(H))
    there = geometry.xyxy_to_centre(*pixel_box(), w, h)
    rows = lines(spark, sf).select(*ROW, *[c.alias(n) for c, n in zip(there, ("cx", "cy", "w", "h"))])
    back = geometry.centre_to_xyxy(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), w, h)
    return rows.select(
        *ROW, *[r6(F.col(n), n) for n in ("cx", "cy", "w", "h")],
        *[r6(c, n) for c, n in zip(back, ("x1", "y1", "x2", "y2"))],
    )


@query(
    "bbox_union",
    f"""WITH p AS ({PIXEL}) SELECT l_orderkey, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2
    FROM p GROUP BY 1""",
)
def bbox_union(spark: SparkSession, sf: str) -> DataFrame:
    box = [c.alias(n) for c, n in zip(pixel_box(), ("x1", "y1", "x2", "y2"))]
    rows = table(spark, sf, "lineitem").select("l_orderkey", *box)
    return metrics.bbox_union(rows, ["l_orderkey"], ["x1", "y1", "x2", "y2"])


@query(
    "crop_box",
    f"""WITH p AS ({PIXEL}) SELECT {ROW_SQL},
      greatest(0, CAST(trunc(x1) AS INT) - 20) AS fx1, greatest(0, CAST(trunc(y1) AS INT) - 20) AS fy1,
      least({W}, CAST(trunc(x2) AS INT) + 20) AS fx2, least({H}, CAST(trunc(y2) AS INT) + 20) AS fy2,
      greatest(0, x1 - greatest(1, CAST(trunc((x2 - x1) * 0.2::DOUBLE) AS INT)))::DOUBLE AS rx1,
      greatest(0, y1 - greatest(1, CAST(trunc((y2 - y1) * 0.2::DOUBLE) AS INT)))::DOUBLE AS ry1,
      least({W}, x2 + greatest(1, CAST(trunc((x2 - x1) * 0.2::DOUBLE) AS INT)))::DOUBLE AS rx2,
      least({H}, y2 + greatest(1, CAST(trunc((y2 - y1) * 0.2::DOUBLE) AS INT)))::DOUBLE AS ry2
    FROM p""",
)
def crop_box(spark: SparkSession, sf: str) -> DataFrame:
    fixed = geometry.crop_fixed(*pixel_box(), F.lit(W), F.lit(H))
    ratio = geometry.crop_ratio(*pixel_box(), F.lit(W), F.lit(H))
    return lines(spark, sf).select(
        *ROW,
        *[c.alias(n) for c, n in zip(fixed, ("fx1", "fy1", "fx2", "fy2"))],
        *[(c.cast("double") + F.lit(0.0)).alias(n) for c, n in zip(ratio, ("rx1", "ry1", "rx2", "ry2"))],
    )


@query(
    "det_samples_filter",
    """SELECT 'objects365_v2_' || l_orderkey AS stem, l_partkey % 25 AS category_id, l_quantity AS x1,
      l_linenumber * 1.0::DOUBLE AS y1, l_quantity + l_suppkey % 7 AS x2, l_linenumber * 1.0::DOUBLE + l_suppkey % 5 AS y2
    FROM lineitem WHERE l_returnflag = 'N'""",
)
def det_samples_filter(spark: SparkSession, sf: str) -> DataFrame:
    prefix = F.when(F.col("l_returnflag") == "N", paths.V2_PREFIX).otherwise(paths.V1_PREFIX)
    path = F.concat(F.lit("train/"), prefix, F.col("l_orderkey").cast("string"), F.lit(".jpg"))
    box = F.array(
        F.col("l_quantity"), F.col("l_linenumber") * F.lit(1.0), (F.col("l_suppkey") % 7).cast("double"),
        (F.col("l_suppkey") % 5).cast("double"),
    )
    note = F.struct((F.col("l_partkey") % 25).alias("category_id"), box.alias("bbox"))
    sample = F.struct(F.struct(path.alias("media_path")).alias("media"), F.array(note).alias("annotations"))
    folder = new_path(spark, "samples")
    sinks.write_documents(table(spark, sf, "lineitem").select(F.to_json(sample).alias("value")), folder, "samples")
    return documents.read_detection_samples(spark, folder)
