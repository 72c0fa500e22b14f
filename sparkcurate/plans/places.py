"""Paths from ``pages.url`` and content from ``documents.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import names, paths
from sparkcurate.operators import gates, match, regroup, sampling
from sparkcurate.operators.ranking import first_per_key
from sparkcurate.plans.registry import query, table
from sparkcurate.sources import jsonl

P = """p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean_url, regexp_extract(url, '://([^/?#]+)', 1) AS host, starts_with(url, 'https') AS secure,
    regexp_extract(url, '/([a-z][a-z])/(\\d+)', 1) AS lang,
    coalesce(TRY_CAST(nullif(regexp_extract(url, '/([a-z][a-z])/(\\d+)', 2), '') AS BIGINT), 0) AS num FROM pages)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    number = F.regexp_extract("url", r"/([a-z][a-z])/(\d+)", 2).try_cast("bigint")
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_replace("url", "[?#].*$", "").alias("clean_url"),
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"),
        F.startswith("url", F.lit("https")).alias("secure"),
        F.regexp_extract("url", r"/([a-z][a-z])/(\d+)", 1).alias("lang"),
        F.coalesce(number, F.lit(0)).cast("bigint").alias("num"),
    )


def text(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def cat(*pieces) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


@query(
    "path_parts",
    f"""WITH {P}, f AS (SELECT page_id, '/root/data/' || lang || '/Patch' || page_id % 7 || '/set_testA.' || num || CASE WHEN page_id % 3 = 0 THEN '.tar.json' WHEN page_id % 3 = 1 THEN '' ELSE '-a_big-mask.png' END AS f FROM p),
    b AS (SELECT *, string_split(f, '/')[-1] AS base FROM f)
    SELECT page_id, base, CASE WHEN contains(base, '.') THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS stem,
      regexp_extract(base, '\\.[^.]+$') AS suffix, f[1:len(f) - len(base) - 1] AS parent, string_split(f, '/')[-2] AS parent_name,
      replace(f, '/root/', '') AS stripped, regexp_extract(f, '(?i)patch\\d+') AS hint, 'set' AS dataset,
      replace(string_split(regexp_replace(base, '\\.[^.]*$', ''), '_')[-1], '-', ' ') AS tail FROM b""",
)
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    slot = F.col("page_id") % 3
    end = F.when(slot == 0, ".tar.json").when(slot == 1, "").otherwise("-a_big-mask.png")
    rows = pages(spark, sf).select(
        "page_id", cat("/root/data/", F.col("lang"), "/Patch", text(F.col("page_id") % 7), "/set_testA.", text("num"), end).alias("f")
    )
    f = F.col("f")
    return rows.select(
        "page_id", paths.basename(f).alias("base"), paths.stem(f).alias("stem"), paths.suffix(f).alias("suffix"),
        paths.parent(f).alias("parent"), paths.parent_name(f).alias("parent_name"),
        paths.strip_prefix(f, "/root/").alias("stripped"), paths.patch_hint(f).alias("hint"),
        paths.dataset_name(f).alias("dataset"), paths.trailing_part(f).alias("tail"),
    )


SLASHED = "replace({}, '\\', '/')"
# some names carry a backslash for the last folder
CATALOG = f"""{P}, c0 AS (SELECT page_id AS ord, CASE page_id % 4 WHEN 0 THEN 'images/patch' || page_id % 15 || '/' WHEN 1 THEN lang || CASE WHEN page_id % 7 = 1 THEN '\\' ELSE '/' END
      WHEN 2 THEN '' ELSE 'PATCH' || page_id % 15 || 'x/' || lang || '/' END || num % 40 || CASE WHEN secure THEN '.jpg' ELSE '.gif' END AS file_name FROM p),
  cat AS (SELECT file_name, min(ord) AS ord, string_split(file_name, '/')[-1] AS base FROM c0 GROUP BY 1),
  q AS (SELECT DISTINCT '/mnt/' || CASE page_id % 5 WHEN 0 THEN 'images/patch1/' WHEN 1 THEN lang || CASE WHEN page_id % 7 = 1 THEN '\\' ELSE '/' END WHEN 2 THEN 'patch' || page_id % 15 || '/'
      WHEN 3 THEN 'q/1' ELSE 'Patch1/s' || lang || '/' END || num % 40 || CASE WHEN lang = 'de' THEN '.png' ELSE '.jpg' END AS path FROM p),
  qb AS (SELECT path, string_split(path, '/')[-1] AS base, lower(regexp_extract(path, '(?i)patch\\d+')) AS hint FROM q),
  idx AS (SELECT * FROM cat WHERE base IN (SELECT base FROM qb)),
  t AS (SELECT qb.path, qb.base, hint, (SELECT count(*) FROM idx WHERE idx.base = qb.base) AS n,
    (SELECT arg_min(file_name, ord) FROM idx WHERE idx.base = qb.base) AS first,
    (SELECT count(*) FROM idx WHERE idx.base = qb.base AND hint <> '' AND contains(lower(file_name), hint)) AS nh,
    (SELECT min(file_name) FROM idx WHERE idx.base = qb.base AND hint <> '' AND contains(lower(file_name), hint)) AS hinted,
    (SELECT arg_min(file_name, ord) FROM idx WHERE idx.base = qb.base AND ends_with({SLASHED.format('qb.path')}, {SLASHED.format('file_name')})) AS ended,
    (SELECT arg_min(file_name, ord) FROM idx WHERE ends_with({SLASHED.format('qb.path')}, {SLASHED.format('file_name')})) AS anywhere FROM qb)"""


def entity_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = pages(spark, sf)
    base = cat(text(F.col("num") % 40), F.when(F.col("secure"), ".jpg").otherwise(".gif"))
    patch = cat("patch", text(F.col("page_id") % 15), "/")
    quarter, fifth = F.col("page_id") % 4, F.col("page_id") % 5
    sep = F.when(F.col("page_id") % 7 == 1, "\\").otherwise("/")
    folder = (
        F.when(quarter == 0, cat("images/", patch)).when(quarter == 1, cat(F.col("lang"), sep)).when(quarter == 2, "")
        .otherwise(cat("PATCH", text(F.col("page_id") % 15), "x/", F.col("lang"), "/"))
    )
    catalog = rows.select(cat(folder, base).alias("file_name"), F.col("page_id").alias("ord"))
    start = (
        F.when(fifth == 0, "images/patch1/").when(fifth == 1, cat(F.col("lang"), sep)).when(fifth == 2, patch)
        .when(fifth == 3, "q/1").otherwise(cat("Patch1/s", F.col("lang"), "/"))
    )
    # no catalog file is a .png and no request a .gif, so those stay unresolved
    end = F.when(F.col("lang") == "de", ".png").otherwise(".jpg")
    asked = rows.select(cat("/mnt/", start, text(F.col("num") % 40), end).alias("path"))
    return asked, catalog


@query(
    "resolve_entity",
    f"""WITH {CATALOG} SELECT path, 'auto' AS mode, CASE WHEN n = 1 THEN first WHEN n > 1 AND nh = 1 THEN hinted WHEN n > 1 THEN coalesce(ended, first)
        ELSE anywhere END AS file_name,
      CASE WHEN n = 1 THEN 'basename_unique' WHEN n > 1 AND nh = 1 THEN 'basename_patch_disambiguated'
        WHEN n > 1 AND ended IS NOT NULL THEN 'file_name_suffix_from_ambiguous' WHEN n > 1 THEN 'ambiguous_fallback'
        WHEN anywhere IS NOT NULL THEN 'file_name_suffix' ELSE 'not_found' END AS match_how FROM t
    UNION ALL SELECT path, 'basename', CASE WHEN n = 1 THEN first WHEN n > 1 AND nh = 1 THEN hinted WHEN n > 1 THEN first END,
      CASE WHEN n = 1 THEN 'basename_unique' WHEN n > 1 AND nh = 1 THEN 'basename_patch_disambiguated' WHEN n > 1 THEN 'basename_ambiguous' ELSE 'not_found' END FROM t
    UNION ALL SELECT path, 'file_name', anywhere, CASE WHEN anywhere IS NOT NULL THEN 'file_name_suffix' ELSE 'not_found' END FROM t""",
)
def resolve_entity(spark: SparkSession, sf: str) -> DataFrame:
    asked, catalog = entity_tables(spark, sf)
    out = None
    for mode in ("auto", "basename", "file_name"):
        got = match.resolve_entity(asked, catalog, mode).withColumn("mode", F.lit(mode))
        out = got if out is None else out.unionByName(got)
    return out


SUFFIXES = ["_mask", "_m", "", "-seg", "_Label", "_other"]


@query(
    "stem_match",
    f"""WITH {P}, img AS (SELECT 'images/' || lang || '/' || CASE WHEN secure THEN '' ELSE 'old_' END || num % 90 || CASE WHEN page_id % 5 = 0 THEN '_M.PNG' ELSE '.jpg' END AS image_path FROM p),
    s AS (SELECT lower(regexp_extract(image_path, '([^/]+)\\.[^.]+$', 1)) AS stem, min(image_path) AS image_path FROM img GROUP BY 1),
    m AS (SELECT page_id, 'masks/' || host || '/' || num % 90 || ['_mask', '_m', '', '-seg', '_Label', '_other'][page_id % 6 + 1] || '.png' AS mask_path FROM p),
    k AS (SELECT *, lower(regexp_extract(mask_path, '([^/]+)\\.[^.]+$', 1)) AS own FROM m)
    SELECT page_id, mask_path, coalesce(a.image_path, b.image_path) AS image_path FROM k LEFT JOIN s a ON own = a.stem
    LEFT JOIN s b ON regexp_replace(own, '(_mask|_m|_seg|_label|-mask|-seg|-label)$', '') = b.stem""",
)
def stem_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages(spark, sf)
    end = F.when(F.col("page_id") % 5 == 0, "_M.PNG").otherwise(".jpg")
    age = F.when(F.col("secure"), "").otherwise("old_")
    images = rows.select(cat("images/", F.col("lang"), "/", age, text(F.col("num") % 90), end).alias("image_path"))
    mark = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("page_id") % 6).cast("int"))
    masks = rows.select("page_id", cat("masks/", F.col("host"), "/", text(F.col("num") % 90), mark, ".png").alias("mask_path"))
    return match.stem_match(masks, images).select("page_id", "mask_path", "image_path")


@query(
    "first_existing",
    f"""WITH {P}, inv AS (SELECT 'm/' || num % 300 || '.png' AS path FROM p WHERE secure UNION
        SELECT 'm/' || num % 300 || '-' || lang || '.png' FROM p WHERE NOT secure),
    c AS (SELECT page_id, 'm/' || page_id % 300 || '-' || lang || '.png' AS a, 'm/' || page_id % 300 || '.png' AS b, 'm/none_' || page_id || '.png' AS c FROM p)
    SELECT page_id, CASE WHEN a IN (SELECT path FROM inv) THEN a WHEN b IN (SELECT path FROM inv) THEN b ELSE c END AS resolved,
      CASE WHEN a IN (SELECT path FROM inv) THEN a WHEN b IN (SELECT path FROM inv) THEN b ELSE a END AS resolved_first FROM c""",
)
def first_existing(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages(spark, sf)
    n = text(F.col("num") % 300)
    inv = rows.filter("secure").select(cat("m/", n, ".png").alias("path")).unionByName(
        rows.filter("NOT secure").select(cat("m/", n, "-", F.col("lang"), ".png").alias("path"))
    )
    i = text(F.col("page_id") % 300)
    tries = F.array(cat("m/", i, "-", F.col("lang"), ".png"), cat("m/", i, ".png"), cat("m/none_", text("page_id"), ".png"))
    # one lookup; both defaults are projections of its result
    out = match.first_existing(rows.select("page_id", "lang"), ["page_id"], tries, inv, default="none", out="hit")
    return out.select("page_id", *[F.coalesce("hit", tries[i]).alias(name) for i, name in ((2, "resolved"), (0, "resolved_first"))])


@query(
    "file_inventory",
    f"""WITH {P} SELECT DISTINCT clean_url AS path, lower(regexp_extract(clean_url, '\\.[^./]+$')) AS suffix FROM p
    WHERE lower(regexp_extract(clean_url, '\\.[^./]+$')) IN ('.html', '.jpg')""",
)
def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    listing = pages(spark, sf).select(F.col("clean_url").alias("path")).distinct()
    kept = jsonl.with_extension(listing, F.col("path"), [".html", ".JPG"])
    return kept.select("path", F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).alias("suffix"))


@query(
    "patch_range_scan",
    f"""WITH {P} SELECT page_id, CAST(num AS INT) AS patch FROM p WHERE num BETWEEN 100 AND 300 AND lang <> 'de'""",
)
def patch_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("lang") == "de", "all/items.jsonl").otherwise(cat("in/object_Patch", text("num"), "_round1.jsonl"))
    rows = pages(spark, sf).select("page_id", name.alias("file"))
    return jsonl.patch_files(rows, F.col("file"), 100, 300).select("page_id", "patch")


@query(
    "unique_names",
    f"""WITH {P}, s AS (SELECT page_id, lang, coalesce(nullif(substr(trim(regexp_replace(lower(regexp_replace(host, '^(www|blog|m)\\.[a-z]+', 'x')), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80), ''), 'unnamed') AS slug FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, slug ORDER BY page_id) AS rn FROM s)
    SELECT page_id, lang, slug || CASE WHEN rn = 1 THEN '' ELSE '__' || rn END AS file_name FROM r""",
)
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    name = names.slug(F.regexp_replace("host", r"^(www|blog|m)\.[a-z]+", "x"))
    rows = pages(spark, sf).select("page_id", "lang", "host")
    return regroup.unique_names(rows, "lang", name, [F.col("page_id")]).select("page_id", "lang", "file_name")


@query(
    "name_lookup_last",
    f"""WITH {P}, m AS (SELECT num || '.jpg' AS base, arg_max(clean_url, page_id) AS path, arg_max(lang, page_id) AS text FROM p GROUP BY 1),
    i AS (SELECT DISTINCT page_id || '.jpg' AS base FROM p)
    SELECT 'matched' AS run, i.base, path, text FROM i JOIN m USING (base)
    UNION ALL SELECT 'all', base, '', 'the target object' FROM i""",
)
def name_lookup_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages(spark, sf)
    entries = rows.select(
        cat(text("num"), ".jpg").alias("base"), F.col("clean_url").alias("path"), F.col("lang").alias("text"), "page_id"
    )
    images = rows.select(cat(text("page_id"), ".jpg").alias("base")).distinct()
    hit = match.name_lookup(images, entries, [F.col("page_id")], "the target object")
    strange = entries.withColumn("base", cat("no_", F.col("base")))
    miss = match.name_lookup(images, strange, [F.col("page_id")], "the target object")
    return hit.withColumn("run", F.lit("matched")).unionByName(miss.withColumn("run", F.lit("all")))


@query(
    "route_skip",
    f"""WITH {P} SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'copy' ELSE 'process' END AS route,
      CASE WHEN contains(host, 'blog') OR contains(host, 'www') THEN 'copy' ELSE 'process' END AS host_route FROM p""",
)
def route_skip(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("page_id") % 4 == 0, "my_instructpart_v1.json").otherwise("other.json")
    return pages(spark, sf).select(
        "page_id", gates.route_skip(name).alias("route"), gates.route_skip(F.col("host"), ["blog", "www"]).alias("host_route")
    )


@query(
    "routed_path",
    f"""WITH {P} SELECT page_id, CASE page_id % 4 WHEN 0 THEN CASE WHEN num > 200 THEN '/v1/f_' || num || '.jpg' END
      WHEN 1 THEN '/v2/patch' || page_id % 9 || '/objects365_v2_' || num || '.jpg' END AS path FROM p""",
)
def routed_path(spark: SparkSession, sf: str) -> DataFrame:
    rows, n, slot = pages(spark, sf), text("num"), F.col("page_id") % 4
    raw = (
        F.when(slot == 0, cat("a/objects365_v1_00", n, ".jpg"))
        .when(slot == 1, cat("b/patch", text(F.col("page_id") % 9), "/objects365_v2_", n, ".jpg"))
        .when(slot == 2, cat("b/objects365_v2_", n, ".jpg"))
        .otherwise(cat("c/", n, ".jpg"))
    )
    listed = F.when(F.col("num") > 200, F.col("num")).otherwise(-1 - F.col("num"))  # numbers up to 200 find nothing
    dim = rows.select(listed.alias("image_id"), cat("f_", n, ".jpg").alias("v1_name")).distinct()
    asked = rows.select("page_id", raw.alias("raw")).withColumn("image_id", paths.v1_id(F.col("raw")))
    named = asked.join(dim, "image_id", "left")
    return named.select("page_id", paths.routed_path(F.col("raw"), F.col("v1_name"), "/v1", "/v2").alias("path"))


@query(
    "md5_match",
    """WITH d AS (SELECT doc_id, lang, 'doc_' || (n_chars // 50) || '.txt' AS base, md5(text) AS md5 FROM documents),
    rel AS (SELECT base, arg_max(CASE WHEN lang = 'fr' THEN md5(md5) ELSE md5 END, doc_id) AS md5 FROM d GROUP BY 1)
    SELECT base, min(doc_id) AS doc_id, md5 FROM d JOIN rel USING (base, md5) GROUP BY base, md5""",
)
def md5_match(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", cat("doc_", text(F.floor(F.col("n_chars") / 50)), ".txt").alias("base"), F.md5("text").alias("md5")
    )
    altered = F.when(F.col("lang") == "fr", F.md5("md5")).otherwise(F.col("md5"))
    release = first_per_key(docs.withColumn("md5", altered), ["base"], [F.col("doc_id").desc()])
    return match.content_match(docs, release, [F.col("doc_id")]).select("base", "doc_id", "md5")


@query(
    "integrity_check",
    """WITH f AS (SELECT CASE WHEN lang = 'fr' THEN 'new_' ELSE 'f_' END || doc_id AS path, sha256(text) AS h FROM documents),
    m AS (SELECT CASE WHEN lang = 'de' THEN 'lost_' ELSE 'f_' END || doc_id AS path,
        CASE WHEN source = 'src3' OR source = 'src7' THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents)
    SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unlisted'
      WHEN f.h <> m.h THEN 'mismatch' ELSE 'ok' END AS status FROM f FULL OUTER JOIN m ON f.path = m.path""",
)
def integrity_check(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")

    def path(lang: str, start: str) -> Column:
        return cat(F.when(F.col("lang") == lang, start).otherwise("f_"), text("doc_id")).alias("path")

    files = docs.select(path("fr", "new_"), F.sha2("text", 256).alias("sha256"))
    body = F.when(F.col("source").isin("src3", "src7"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    manifest = docs.select(path("de", "lost_"), F.sha2(body, 256).alias("sha256"))
    return match.integrity(files, manifest)


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.seeded(table(spark, sf, "documents").select("doc_id"), text("doc_id"), 42, 100)
