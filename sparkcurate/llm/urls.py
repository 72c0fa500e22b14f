"""URL filters: host rules, else the empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host. The share of bad pages is shrunk level by
level: the corpus is the prior of a suffix, the suffix of a registered domain, the domain
of a host. The strength of each level's prior is its own moment estimate, so a level whose
members differ little shrinks them much. A host without labels takes its domain's. A page is blocked if the lower posterior bound
of its host's bad share is above the limit and the host has earned it: it has bad pages of its
own, and the bound stays above the limit when the prior is not worse than the limit, or is above
the share of the whole corpus. Few labels alone block nobody, nor does a prior alone.

SQL expressions only. The counts per host are aggregated before any shuffle and the join
back has one row per host, so the adaptive skew join splits a host with a third of all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the query's contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LIMIT, Z = 0.25, 1.645  # blocked above this bad share, at a one-sided 95 % bound
MARGIN = 0.01  # by which a bound exceeds the share of the corpus
FLOOR, CEILING = 2.0, 1000.0  # least and most pages that a prior counts for


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    rest = F.coalesce(F.substr(url, F.length(rest) + 4), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels; there is no list of public suffixes here)
    and suffix (the last label)."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. The list
    is a parameter, written into the plan: meant for up to some hundred rules."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _shrunk(level: DataFrame, above: DataFrame | float, on: list[str]) -> DataFrame:
    """Posterior counts of a level: pseudo-pages of the level above plus its own.

    Prior strength by moments: with mean m and variance v of the members' shares, weighted
    by pages, less what binomial noise explains, it is m (1 - m) / v - 1. Three sums reach
    the driver. A member without labels keeps its prior."""
    if isinstance(above, float):
        joined = level.withColumn("prior", F.lit(above))
    else:
        joined = level.join(above.select(*on, F.col("mean").alias("prior")), on)
    noise = F.col("prior") * (1 - F.col("prior"))
    m1, over, scale = (
        joined.filter("n > 0")
        .agg(
            F.sum(F.col("n") * noise) / F.sum("n"),
            F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), F.lit(2.0)) - noise),
            F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n"),
        )
        .first()
    )
    k = CEILING
    if scale and over > 0:
        k = max(FLOOR, min(CEILING, m1 / (over / scale) - 1))
    a, b = F.col("prior") * k + F.col("bad"), (1 - F.col("prior")) * k + F.col("n") - F.col("bad")
    out = joined.select(*level.columns, a.alias("a"), b.alias("b"))
    return out.withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def _bound(a: Column, b: Column) -> Column:
    """Lower bound of a beta posterior, by its standard deviation."""
    total = a + b
    return a / total - Z * F.sqrt(a * b / (total * total * (total + 1)))


def reputation(outcomes: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``host``, ``domain``, ``suffix``, pages ``n``, ``bad`` ones, posterior ``a``, ``b``, ``mean``,
    ``lower`` and ``earned`` (evidence of its own for a block) per host of ``outcomes(host, n, bad)``: labelled pages and bad ones, both 0
    for a host without labels, which then stands on its domain's posterior."""
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = materialise(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = materialise(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = domains.groupBy("suffix").agg(*sums)
    # One clean page beside the corpus: without labels nothing is blocked.
    n, bad = domains.agg(F.sum("n"), F.sum("bad")).first()
    corpus = (bad or 0.0) / ((n or 0.0) + 1)
    suffixes = materialise(_shrunk(suffixes, corpus, []), "suffixes")
    domains = materialise(_shrunk(domains, suffixes, ["suffix"]), "domains")
    out = _shrunk(hosts, domains, ["domain", "suffix"]).withColumn("lower", _bound(F.col("a"), F.col("b")))
    k = F.col("a") + F.col("b") - F.col("n")
    base = F.least(F.col("a") - F.col("bad"), k * limit)
    own = _bound(base + F.col("bad"), k - base + F.col("n") - F.col("bad")) > limit
    return out.withColumn("earned", (F.col("bad") > 0) & (own | (F.col("lower") > corpus + MARGIN)))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, page: str = "page_id", url: str = "url") -> DataFrame:
    """``pages[page]`` with ``host``, ``path``, ``rule``, ``verdict`` and ``lower`` (the posterior
    bound), one row per row of ``pages``.

    ``outcomes(page, bad)`` holds labelled pages; a page may have several outcomes or none.
    Null and broken urls have empty host and path, no rule, and the verdict ``allow`` unless
    the empty host itself has earned a block. Other columns are not read.
    """
    host, path = split_url(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{page}`").alias("page"), host.alias("host"), path.alias("path"))
    counts = outcomes.filter("bad is not null").groupBy("page").agg(F.count("*").alias("times"), F.sum(F.col("bad").cast("long")).alias("bad"))
    first = rows.groupBy("page", "host").agg(F.count("*").alias("copies"))
    zero = F.lit(0).cast("long")
    of_page = [(F.coalesce(c, zero) * F.col("copies")).alias(o) for c, o in (("times", "n"), ("bad", "bad"))]
    per_page = first.join(counts, "page", "left").select("host", *of_page)
    known = materialise(reputation(per_page, limit), "hosts")
    out = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).join(known.select("host", "lower", "earned"), "host", "left")
    own = F.when((F.col("lower") > limit) & F.col("earned"), "block").otherwise("allow")
    return out.select(F.col("page").alias(page), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "lower")


def query(spark, sf_dir: str) -> DataFrame:
    """Outcomes: the labels of the document with the page's number; bad is low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    return judge(pages, labels.select(F.col("doc_id").alias("page"), bad)).select("page_id", "host", "path", "rule", "verdict")


def _rules_sql(pick) -> str:
    """The longest rule that fits, as a CASE; ``pick`` gives its value."""
    cases = [
        f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') THEN '{pick(name, start, verdict)}'"
        for name, start, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    return f"CASE {' '.join(cases)} END"


def _level_sql(name: str, rows: str) -> str:
    """Prior strength and posterior of a level whose ``rows`` carry ``n``, ``bad`` and ``prior``."""
    return f"""{name}_rows AS ({rows}),
{name}_sums AS (
  SELECT sum(n * prior * (1 - prior)) / sum(n) AS m, sum(n * pow(bad / n - prior, 2) - prior * (1 - prior)) AS over,
    sum(n) - sum(n * n) / sum(n) AS scale
  FROM {name}_rows WHERE n > 0),
{name}_strength AS (
  SELECT CASE WHEN scale <> 0 AND over > 0 THEN greatest({FLOOR}::DOUBLE, least({CEILING}::DOUBLE, m / (over / scale) - 1))
    ELSE {CEILING}::DOUBLE END AS k FROM {name}_sums),
{name} AS (
  SELECT *, a / (a + b) AS mean
  FROM (SELECT r.*, prior * k + bad AS a, (1 - prior) * k + n - bad AS b FROM {name}_rows r, {name}_strength))"""


def _bound_sql(a: str, b: str) -> str:
    """Lower bound of the share of bad pages."""
    return f"{a} / ({a} + {b}) - {Z}::DOUBLE * sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"


SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
outcomes AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE bad) AS bad
  FROM (SELECT doc_id, quality = 0 OR toxic = 1 AS bad FROM labels) WHERE bad IS NOT NULL GROUP BY doc_id),
h AS (
  SELECT host, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
    sum(coalesce(n, 0))::DOUBLE AS n, sum(coalesce(bad, 0))::DOUBLE AS bad
  FROM p LEFT JOIN outcomes ON page_id = doc_id GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
{_level_sql("suffixes", "SELECT s.*, (SELECT sum(bad) / (sum(n) + 1) FROM s) AS prior FROM s")},
{_level_sql("domains", "SELECT d.*, mean AS prior FROM d JOIN (SELECT suffix, mean FROM suffixes) USING (suffix)")},
{_level_sql("hosts", "SELECT h.*, mean AS prior FROM h JOIN (SELECT domain, suffix, mean FROM domains) USING (domain, suffix)")},
corpus AS (SELECT coalesce(sum(bad), 0) / (coalesce(sum(n), 0) + 1) AS share FROM s),
evidence AS (SELECT *, least(a - bad, (a + b - n) * {LIMIT}::DOUBLE) AS base FROM hosts),
own AS (SELECT *, base + bad AS own_a, a + b - base - bad AS own_b FROM evidence),
bound AS (
  SELECT host, bad, share, {_bound_sql("a", "b")} AS lower, {_bound_sql("own_a", "own_b")} AS own_lower FROM own, corpus)
SELECT page_id, host, path, {_rules_sql(lambda name, start, verdict: name + start)} AS rule,
  coalesce({_rules_sql(lambda name, start, verdict: verdict)}, CASE WHEN lower > {LIMIT}::DOUBLE AND bad > 0
    AND (own_lower > {LIMIT}::DOUBLE OR lower > share + {MARGIN}::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN bound USING (host)
"""
