"""Quality rules as a ledger of bits.

Every rule is evaluated once per text and leaves a measurement and one bit of ``failures``.
A policy is a named, versioned set of rules: a mask. Applying one, or another version, or
asking what a rule alone removes, reads the ledger and never the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper_words")


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of ``MEASURES`` for one text; null and empty texts count zero."""
    if not text:
        return (0,) * len(MEASURES)
    words = WORD.findall(text)
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    seen: dict[tuple, int] = {}
    again = bytearray(len(ids))
    for i, window in enumerate(zip(ids, ids[1:], ids[2:])):
        first = seen.setdefault(window, i)
        if first != i:
            again[i : i + 3] = b"\1\1\1"
            if first >= 0:
                again[first : first + 3] = b"\1\1\1"
                seen[window] = -1
    lines = [line for line in text.split("\n") if WORD.search(line)]
    upper = sum(1 for w in words if w.isupper())
    return (
        len(words),
        sum(map(len, words)),
        len(SYMBOL.findall(text)),
        len(lines),
        len(lines) - len(set(lines)),
        sum(again),
        len(number),
        upper,
    )


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition over the measurements; ``bit`` never changes once used."""

    bit: int
    name: str
    failed: str


#: Thresholds are compared as whole numbers, so no engine rounds them. The vocabulary of a text grows
#: slower than the text: up to 2,000 words a tenth of them must be distinct, beyond that a square root.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "upper_case", "n_words >= 20 and 2 * n_upper_words > n_words"),
    Rule(7, "few_distinct_words", "n_words >= 50 and 10 * n_distinct_words < n_words and n_distinct_words * n_distinct_words < 20 * n_words"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {"base-1": BASE, "strict-1": tuple(r.name for r in RULES if r.bit < 6), "strict-2": tuple(r.name for r in RULES)}
CURRENT = "strict-2"


def mask(names, rules=RULES) -> int:
    """Bits of the named rules."""
    known = {r.name: r.bit for r in rules}
    return sum(1 << known[n] for n in set(names))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add a struct ``measures``; rows and columns stay as they are."""
    shape = "struct<" + ",".join(f"{m}:long" for m in MEASURES) + ">"

    @F.arrow_udf(shape)
    def counts(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_py()) for t in texts]
        columns = list(zip(*rows)) or [[] for _ in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))

    return docs.withColumn("measures", counts(F.col(f"`{text}`").cast("string")))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """``docs[key]``, every measurement and ``failures`` (long), one row per row of ``docs``.

    Null and empty texts have no words, so they fail ``few_words`` alone. Keys may be null or
    repeat. Other columns are not read, so their names cannot clash.
    """
    rows = measured(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))).select("key", "measures.*")
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits + F.when(F.expr(rule.failed), 1 << rule.bit).otherwise(0)
    return rows.select(F.col("key").alias(key), *MEASURES, bits.alias("failures"))


def passes(policy: str, policies=POLICIES, rules=RULES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policies[policy], rules))) == 0


def ablation(entries: DataFrame, policy: str, policies=POLICIES, rules=RULES) -> DataFrame:
    """Per rule of a policy: rows that fail it, and rows that it alone removes (they would
    pass without it). One aggregate over the distinct bit sets, of which there are at most
    two to the number of rules."""
    whole = mask(policies[policy], rules)
    sets = entries.select(F.col("failures").bitwiseAND(F.lit(whole)).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    of = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policies[policy]]))
    each = sets.select("bits", "n", of.alias("r")).select("bits", "n", "r.*")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"), total(F.col("bits") == F.col("bit")).alias("alone"))


def query(spark, sf_dir: str) -> DataFrame:
    entries = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ~passes("base-1")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes(CURRENT).alias("kept"))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
windows AS (
  SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_distinct(w)) AS n_distinct_words, len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS n_upper_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 60 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_words >= 20 AND 2 * n_upper_words > n_words)
    OR (n_words >= 50 AND 10 * n_distinct_words < n_words AND n_distinct_words * n_distinct_words < 20 * n_words)) AS kept
FROM m
"""
