"""Joins and entity matching.

Fuzzy, containment, suffix and subset tests are all turned into equi-joins on derived
keys over distinct names, so no operator pairs up every row of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions import names, paths
from sparkcurate.functions.templates import BAD_TRIPLES, lookup
from sparkcurate.operators.ranking import first_per_key, rank_rows
from sparkcurate.operators.regroup import distinct_lists
from sparkcurate.session import materialise


# -- keyed lookups -----------------------------------------------------------


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], found: str = "found") -> DataFrame:
    """Left join with a flag; ``right`` has one row per key, so no left row multiplies
    and a hot key can be split on the left side by the adaptive skew join."""
    return left.join(right.withColumn(found, F.lit(True)), list(on), "left").withColumn(
        found, F.coalesce(F.col(found), F.lit(False))
    )


def todo(items: DataFrame, ledger: DataFrame, uid: str, order: Sequence[Column]) -> DataFrame:
    """Items not yet in the ledger, the first of each id."""
    return first_per_key(items.join(ledger.select(uid), uid, "left_anti"), [uid], order)


def two_tier_lookup(
    items: DataFrame, by_line: DataFrame, by_pair: DataFrame, line: str, pair: Sequence[str], value: str
) -> DataFrame:
    """Value by line number, else by the pair key; ``matched_by`` tells which."""
    a = by_line.select(line, F.col(value).alias("_a"))
    b = by_pair.select(*pair, F.col(value).alias("_b"))
    return (
        items.join(a, line, "left")
        .join(b, list(pair), "left")
        .withColumn(value, F.coalesce("_a", "_b"))
        .withColumn(
            "matched_by",
            F.when(F.col("_a").isNotNull(), "line").when(F.col("_b").isNotNull(), "pair").otherwise("unmatched"),
        )
        .drop("_a", "_b")
    )


def flag_bad_triples(
    df: DataFrame,
    obj: Column,
    part: Column,
    affordance: Column,
    rules: Sequence[tuple[str, str, list[str]]] = BAD_TRIPLES,
    out: str = "is_bad",
) -> DataFrame:
    """Mark rows whose normalised (object, part, affordance) is listed as a mismatch.
    The rule list is a constant, so it travels inside the expression."""
    key = F.concat_ws("\t", *[names.label_key(c) for c in (obj, part, affordance)])

    def plain(text: str) -> str:
        return " ".join(text.replace("_", " ").lower().split())

    bad = sorted({"\t".join(map(plain, (o, p, a))) for o, p, wrong in rules for a in wrong})
    return df.withColumn(out, key.isin(bad))


# -- vocabulary match --------------------------------------------------------


def _segments(size: Column, cutoff: float) -> Column:
    """Segments ``(i, at, len)`` of a name of ``size`` characters: one more than the
    insertions and deletions that a ratio of ``cutoff`` leaves room for."""
    edits = _edits(size, cutoff)
    pieces = edits + 1
    base, extra = F.floor(size / pieces).cast("int"), size % pieces
    whole = pieces - extra
    return F.transform(
        F.sequence(F.lit(0), edits),
        lambda i: F.struct(
            i.alias("i"),
            (i * base + F.greatest(F.lit(0), i - whole) + 1).alias("at"),
            (base + F.when(i >= whole, 1).otherwise(0)).alias("len"),
        ),
    )


def _edits(size: Column, cutoff: float) -> Column:
    longest = F.floor(size * (2 / cutoff - 1) + 1e-9)
    return F.floor((1 - cutoff) * (size + longest) + 1e-9).cast("int")


def similar_pairs(left: DataFrame, right: DataFrame, cutoff: float = 0.9) -> DataFrame:
    """Pairs ``(left, right, score)`` of distinct names whose sequence ratio reaches
    ``cutoff``. ``left`` and ``right`` are one-column frames named so.

    A ratio of ``cutoff`` bounds the inserted and deleted characters. Cut into one
    segment more than that bound, the right name keeps at least one segment unchanged
    inside the left name, at most that many places away. Only pairs that share a segment
    of the same name length, number and place are scored, so the candidate set is
    complete without being a cross product.
    """
    right = right.select("right").distinct().filter(F.length("right") > 0)
    left = left.select("left").distinct().filter(F.length("left") > 0)
    size = F.length("right")
    cut = right.select("right", size.alias("_n"), F.explode(_segments(size, cutoff)).alias("_s")).select(
        "right", "_n", F.col("_s.i").alias("_i"), F.substring(F.col("right"), F.col("_s.at"), F.col("_s.len")).alias("_piece")
    )
    mine = F.length("left")
    shortest = F.ceil(mine * (cutoff / (2 - cutoff)) - 1e-9).cast("int")
    longest = F.floor(mine * (2 / cutoff - 1) + 1e-9).cast("int")
    # every length the other name may have, its segments, and the places they may be found
    sized = left.select("left", F.explode(F.sequence(F.greatest(F.lit(1), shortest), longest)).alias("_n"))
    placed = sized.select("left", "_n", _edits(F.col("_n"), cutoff).alias("_e"), F.explode(_segments(F.col("_n"), cutoff)).alias("_s"))
    first = F.greatest(F.lit(1), F.col("_s.at") - F.col("_e"))
    last = F.least(F.col("_s.at") + F.col("_e"), mine - F.col("_s.len") + 1)
    probes = placed.filter(first <= last).select(
        "left", "_n", F.col("_s.i").alias("_i"), F.col("_s.len").alias("_len"), F.explode(F.sequence(first, last)).alias("_p")
    )
    probes = probes.select("left", "_n", "_i", F.substring(F.col("left"), F.col("_p"), F.col("_len")).alias("_piece"))
    pairs = probes.join(cut, ["_n", "_i", "_piece"]).select("left", "right").distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = SequenceMatcher()
        for batch in batches:
            got = []
            for a, b in zip(batch["left"], batch["right"]):
                # the requested name is the second sequence, as in get_close_matches
                matcher.set_seqs(b, a)
                got.append(matcher.ratio())
            batch["score"] = got
            yield batch[batch["score"] >= cutoff]

    return pairs.mapInPandas(score, "left string, right string, score double")


def match_vocabulary(
    requests: DataFrame,
    labels: DataFrame,
    scope: str,
    aliases: Mapping[str, str],
    cutoff: float | None = None,
) -> DataFrame:
    """Match each distinct ``(scope, name)`` request to a label of the same scope:
    exact, else through the alias table, else (with a ``cutoff``) the closest label.
    ``labels`` holds one row per ``(scope, label)``. Unmatched requests are kept with
    a null ``matched_label``. Equal scores take the larger label."""
    asked = requests.select(scope, "name").distinct().withColumn("_alias", lookup(aliases, F.col("name")))
    have = labels.select(scope, "label")
    tried = (
        asked.join(have.select(scope, F.col("label").alias("name"), F.lit(True).alias("_hit")), [scope, "name"], "left")
        .join(
            have.select(scope, F.col("label").alias("_alias"), F.col("label").alias("_by_alias")),
            [scope, "_alias"],
            "left",
        )
        .select(scope, "name", F.when(F.col("_hit"), F.col("name")).otherwise(F.col("_by_alias")).alias("_sure"))
    )
    if cutoff is None:
        return tried.select(scope, "name", F.col("_sure").alias("matched_label"), F.lit(False).alias("is_fuzzy"))
    open_ = tried.filter(F.col("_sure").isNull())
    near = similar_pairs(open_.select(F.col("name").alias("left")), have.select(F.col("label").alias("right")), cutoff)
    best = (
        open_.select(scope, "name")
        .join(near.select(F.col("left").alias("name"), F.col("right").alias("label"), "score"), "name")
        .join(have, [scope, "label"])
        .groupBy(scope, "name")
        .agg(F.max(F.struct("score", "label"))["label"].alias("_near"))
    )
    return tried.join(best, [scope, "name"], "left").select(
        scope,
        "name",
        F.coalesce("_sure", "_near").alias("matched_label"),
        (F.col("_sure").isNull() & F.col("_near").isNotNull()).alias("is_fuzzy"),
    )


# -- containment -------------------------------------------------------------


GRAM = 3  # characters of an indexed piece
CROWD = 1000  # labels of an image that are tested one by one; more are found by their pieces


def _hold(a: Column, b: Column) -> Column:
    """Either text holds the other."""
    return F.contains(a, b) | F.contains(b, a)


def _pieces(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def held_pairs(short: DataFrame, long: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pairs ``(*on, short, long)`` of distinct texts of one scope where ``long`` holds ``short``.

    An inverted index over the pieces of the long texts. A short text looks up the rarest of its
    own pieces (itself, if it is no longer than a piece) and is compared with that list only."""
    short, long = short.select(*on, "short").distinct(), long.select(*on, "long").distinct()
    own = F.when(F.length("short") <= GRAM, F.array("short")).otherwise(_pieces(F.col("short"), GRAM))
    every = F.concat(F.array(F.lit("")), *[_pieces(F.col("long"), n) for n in range(1, GRAM + 1)])
    short = materialise(short.select(*on, "short", F.explode(own).alias("piece")), "pieces")
    asked = short.select(*on, "piece").distinct()
    posts = long.select(*on, "long", F.explode(every).alias("piece")).join(asked, [*on, "piece"], "left_semi")
    posts = materialise(posts, "pieces")
    known = posts.groupBy(*on, "piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        short.join(known, [*on, "piece"], "left").groupBy(*on, "short")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rare"))
        .filter("rare.n > 0").select(*on, "short", F.col("rare.piece").alias("piece"))
    )
    return rarest.join(posts, [*on, "piece"]).filter(F.contains("long", "short")).select(*on, "short", "long")


def _meet(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """``asked`` (``image, left, exact`` and more) with the ``labels`` (``image, right`` and more) of
    the same image that equal ``left`` or, unless ``exact``, hold it or are held by it."""
    def tested(asked: DataFrame, labels: DataFrame) -> DataFrame:
        other = labels.withColumnRenamed("image", "_image")
        fits = (F.col("left") == F.col("right")) | (~F.col("exact") & _hold(F.col("left"), F.col("right")))
        return asked.join(other, (F.col("image") == F.col("_image")) & fits).drop("_image")

    many = labels.groupBy("image").count().filter(F.col("count") > CROWD).select("image")
    many = materialise(many, "crowded")
    if many.isEmpty():
        return tested(asked, labels)
    a, b = (materialise(df.join(many, "image", "left_semi"), "crowded") for df in (asked, labels))
    names, have = a.filter(~F.col("exact")).select("image", "left"), b.select("image", "right")
    inside = held_pairs(names.withColumnRenamed("left", "short"), have.withColumnRenamed("right", "long"), ["image"])
    around = held_pairs(have.withColumnRenamed("right", "short"), names.withColumnRenamed("left", "long"), ["image"])
    pairs = inside.toDF("image", "left", "right").union(around.select("image", "long", "short")).distinct()
    loose = a.filter(~F.col("exact")).join(pairs, ["image", "left"]).join(b, ["image", "right"])
    same = a.filter("exact").withColumn("right", F.col("left")).join(b, ["image", "right"])
    rest = tested(asked.join(many, "image", "left_anti"), labels.join(many, "image", "left_anti"))
    return rest.unionByName(loose).unionByName(same)


def kth_match(requests: DataFrame, boxes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The k-th box, in annotation order, whose category is the requested name, or,
    when no category has that name, holds it or is held by it. ``requests`` carries
    ``image, name, k`` (0-based); ``boxes`` carries ``image, category`` and payload.
    Requests without such a box are kept with nulls; an empty name is held by every one.

    Distinct names meet the distinct categories of their own image only, through an index of
    pieces where an image has many. Boxes are ranked once per distinct (image, name), not per
    request."""
    present = boxes.select("image", F.lower("category").alias("right")).distinct()
    asked = requests.withColumn("left", F.lower("name"))
    known = present.select(F.col("right").alias("left")).distinct().withColumn("_known", F.lit(True))
    wanted = asked.select("image", "left").distinct().join(known, "left", "left")
    wanted = wanted.select("image", "left", F.coalesce("_known", F.lit(False)).alias("exact"))
    needed = _meet(wanted, present).select("image", "left", "right")
    hits = boxes.withColumn("right", F.lower("category")).join(needed, ["image", "right"]).drop("right")
    # joined once, then counted and ranked
    ranked = rank_rows(materialise(hits, "hits"), ["image", "left"], order, "_r")
    ranked = ranked.withColumn("k", F.col("_r") - 1).drop("_r")
    return asked.join(ranked, ["image", "left", "k"], "left").drop("left")


def nearest_rank(requests: DataFrame, boxes: DataFrame) -> DataFrame:
    """Box of a matching category (either name holds the other) with the requested
    per-category index, else the closest index. ``boxes`` carries ``image, category,
    cat_index, ord`` with indexes 0..n-1 per (image, category), so the closest one is
    the request clamped to n-1: one lookup per category instead of a scan. Requests meet
    the distinct categories of their own image only, as in ``kth_match``."""
    sizes = boxes.groupBy("image", "category").agg(F.max("cat_index").alias("_last"))
    asked = requests.select("image", "name", "k").distinct()
    met = _meet(
        asked.withColumn("left", F.lower("name")).withColumn("exact", F.lit(False)),
        sizes.withColumn("right", F.lower("category")),
    )
    tried = met.select("image", "name", "k", "category", F.least("k", "_last").alias("cat_index"))
    best = (
        tried.join(boxes, ["image", "category", "cat_index"])
        .groupBy("image", "name", "k")
        .agg(
            F.min_by(
                F.struct("category", "cat_index"), F.struct(F.abs(F.col("cat_index") - F.col("k")), F.col("ord"))
            ).alias("_b")
        )
        .select("image", "name", "k", "_b.category", "_b.cat_index")
    )
    return requests.join(best, ["image", "name", "k"], "left")


def miss_report(found: DataFrame, missing: Column, keys: Sequence[str], examples: int = 8) -> DataFrame:
    """Rows without a hit: ``rank`` 0 carries their number, ranks from 1 the first few in
    key order."""
    gone = materialise(found.filter(missing).select(*keys), "misses")
    none = [F.lit(None).cast(gone.schema[k].dataType).alias(k) for k in keys]
    total = gone.agg(F.count(F.lit(1)).alias("n_missing")).select(F.lit(0).alias("rank"), *none, "n_missing")
    first = gone.orderBy(*keys).limit(examples)  # the window sees these few rows only
    rank = F.row_number().over(Window.orderBy(*keys)).alias("rank")
    return total.unionByName(first.select(rank, *keys, F.lit(None).cast("bigint").alias("n_missing")))


# -- paths -------------------------------------------------------------------


TAIL = 4  # characters by which entries without a folder are looked up


def _endings(open_: DataFrame, cat: DataFrame, bare_too: Column) -> DataFrame:
    """Endings ``(path, base, n, slashed)`` that may be entries of ``cat``: of the lengths that
    occur among the entries with the path's last name, and, where ``bare_too``, among the entries
    without a folder whose last characters agree."""
    last = F.substring_index("slashed", "/", -1)
    own = open_.withColumn("slashed", paths.slashed(F.col("path"))).withColumn("last", last)
    sized = cat.filter(F.length("slashed") > 0).select("slashed", last.alias("last"), F.length("slashed").alias("len"))
    by_name = sized.groupBy("last").agg(F.collect_set("len").alias("lens"))
    bare = sized.filter(F.col("slashed") == F.col("last"))
    by_tail = bare.groupBy(F.right("last", F.least(F.col("len"), F.lit(TAIL))).alias("tail")).agg(F.collect_set("len").alias("lens"))
    tails = F.transform(F.sequence(F.lit(1), F.least(F.length("last"), F.lit(TAIL))), lambda n: F.right("last", n))
    probes = own.filter(bare_too & (F.length("last") > 0)).select("path", "base", "n", "slashed", F.explode(tails).alias("tail"))

    def cut(found: DataFrame) -> DataFrame:
        fitting = F.filter("lens", lambda n: n <= F.length("slashed"))
        sized = found.select("path", "base", "n", "slashed", F.explode(fitting).alias("len"))
        return sized.select("path", "base", "n", F.right("slashed", F.col("len")).alias("slashed"))

    return cut(own.join(by_name, "last")).union(cut(probes.join(by_tail, "tail")))


def resolve_entity(requests: DataFrame, catalog: DataFrame, mode: str = "auto") -> DataFrame:
    """Resolve ``path`` to a catalog entry ``file_name`` and tell how in ``match_how``.

    ``catalog`` carries ``file_name`` and ``ord`` (its position). Modes: ``auto``,
    ``basename`` and ``file_name``. Every tier is an equi-join: on the base name, on
    (base name, patch token), and on endings of the path of lengths that occur. They are compared with
    ``\\`` read as ``/`` on both sides; base names are what follows the last ``/``.
    """
    req = requests.select("path").distinct().withColumn("base", paths.basename(F.col("path")))
    cat = first_per_key(catalog.select("file_name", "ord"), ["file_name"], [F.col("ord")])
    cat = cat.withColumn("base", paths.basename(F.col("file_name")))
    cat = cat.join(req.select("base").distinct(), "base", "left_semi").withColumn("slashed", paths.slashed(F.col("file_name")))
    by_base = cat.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min_by("file_name", "ord").alias("first"))

    # every token a hint could equal: patch1 and patch12 for an entry under patch12
    found = F.regexp_extract_all(F.lower("file_name"), F.lit(r"patch\d+"), F.lit(0))
    tokens = F.array_distinct(
        F.flatten(
            F.transform(
                found, lambda t: F.transform(F.sequence(F.lit(6), F.length(t)), lambda n: F.substring(t, 1, n))
            )
        )
    )
    by_hint = (
        cat.select("base", "file_name", F.explode(tokens).alias("hint"))
        .groupBy("base", "hint")
        .agg(F.count(F.lit(1)).alias("n_hint"), F.min("file_name").alias("hinted"))
        .filter("n_hint = 1")
        .drop("n_hint")
    )
    req = req.withColumn("hint", F.lower(paths.patch_hint(F.col("path"))))
    joined = req.join(by_base, "base", "left")
    # with several base hits an ending of one of them, else of any entry
    own = F.col("n") > 1
    open_ = joined if mode == "file_name" else joined.filter("n > 1 OR n IS NULL")
    ends = _endings(open_, cat, F.lit(mode == "file_name") | F.col("n").isNull())
    by_end = (
        ends.alias("e").join(cat.alias("c"), "slashed")
        .filter(F.lit(mode == "file_name") | F.col("n").isNull() | (F.col("e.base") == F.col("c.base")))
        .groupBy("path")
        .agg(F.min_by("file_name", "ord").alias("ended"))
    )
    full = joined.join(by_hint, ["base", "hint"], "left").join(by_end, "path", "left")
    n, hinted, ended = F.col("n"), F.col("hinted"), F.col("ended")
    if mode == "file_name":
        how = F.when(ended.isNotNull(), "file_name_suffix").otherwise("not_found")
        target = ended
    elif mode == "basename":
        how = (
            F.when(n == 1, "basename_unique")
            .when((n > 1) & hinted.isNotNull(), "basename_patch_disambiguated")
            .when(n > 1, "basename_ambiguous")
            .otherwise("not_found")
        )
        target = F.when((n > 1) & hinted.isNotNull(), hinted).otherwise(F.col("first"))
    else:
        how = (
            F.when(n == 1, "basename_unique")
            .when((n > 1) & hinted.isNotNull(), "basename_patch_disambiguated")
            .when((n > 1) & ended.isNotNull(), "file_name_suffix_from_ambiguous")
            .when(n > 1, "ambiguous_fallback")
            .when(ended.isNotNull(), "file_name_suffix")
            .otherwise("not_found")
        )
        target = F.when(n == 1, F.col("first")).when(n > 1, F.coalesce(hinted, ended, F.col("first"))).otherwise(ended)
    return full.select("path", target.alias("file_name"), how.alias("match_how"))


def stem_match(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Image of the same lower-case stem, retried without the mask marker; the smallest
    image path wins a collision. Unmatched masks keep a null ``image_path``."""
    by_stem = images.groupBy(F.lower(paths.stem(F.col("image_path"))).alias("_s")).agg(
        F.min("image_path").alias("_p")
    )
    own = F.lower(paths.stem(F.col("mask_path")))
    out = masks.withColumn("_own", own).withColumn("_bare", paths.strip_mask_suffix(own))
    out = out.join(by_stem.select(F.col("_s").alias("_own"), F.col("_p").alias("_a")), "_own", "left")
    out = out.join(by_stem.select(F.col("_s").alias("_bare"), F.col("_p").alias("_b")), "_bare", "left")
    return out.withColumn("image_path", F.coalesce("_a", "_b")).drop("_own", "_bare", "_a", "_b")


def first_existing(
    df: DataFrame, keys: Sequence[str], candidates: Column, inventory: DataFrame, default: str = "last",
    out: str = "resolved",
) -> DataFrame:
    """First candidate path that the inventory lists, else the last (or first) one, or, by
    default ``none``, null. ``df`` has one row per key."""
    ranked = df.select(*keys, F.posexplode(candidates).alias("_pos", "path"))
    hits = (
        ranked.join(inventory.select("path").distinct(), "path", "left_semi")
        .groupBy(*keys)
        .agg(F.min(F.struct("_pos", "path"))["path"].alias("_hit"))
    )
    spare = F.lit(None) if default == "none" else F.element_at(candidates, -1 if default == "last" else 1)
    return df.join(hits, list(keys), "left").withColumn(out, F.coalesce("_hit", spare)).drop("_hit")


LISTED = 100_000  # paths of an inventory that need no hint
HASHED = 500_000  # paths that a task may hash


def first_listed(df: DataFrame, candidates: Sequence[Column], inventory: DataFrame, out: str = "resolved") -> DataFrame:
    """Per row, the first of ``candidates`` that the inventory lists, else the first one. A row goes
    through one lookup per candidate with its own columns, and nothing joins back. The inventory is written
    first: where its share of a task is known to fit, tasks hash it, and the wide rows are not sorted."""
    listed = materialise(inventory.select(F.col("path").alias("_path")).filter("_path IS NOT NULL").distinct(), "listed")
    n, parts = listed.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = LISTED < n <= parts * HASHED
    if hashed:
        listed = listed.hint("shuffle_hash")
    names = df.columns
    rows = df.withColumn(out, F.lit(None).cast("string"))
    for path in candidates:
        # a row that has its path is looked up by it again, so rows stay spread
        want = F.coalesce(F.col(out), path)
        if not hashed:  # a sort would work the path out again in every comparison
            rows, want = rows.withColumn("_want", want), F.col("_want")
        rows = rows.join(listed, want == F.col("_path"), "left").select(*names, F.col("_path").alias(out))
    return rows.withColumn(out, F.coalesce(F.col(out), candidates[0]))


def content_match(entries: DataFrame, release: DataFrame, order: Sequence[Column]) -> DataFrame:
    """For each released file, the first entry with its base name and its content hash.
    Entries are cut to one per (name, hash) before the join."""
    return first_per_key(entries, ["base", "md5"], order).join(release.select("base", "md5"), ["base", "md5"], "left_semi")


def name_lookup(images: DataFrame, entries: DataFrame, order: Sequence[Column], default_text: str) -> DataFrame:
    """Entry of each image by its base name, the last one winning. When no image has an
    entry, all of them come back with the default text."""
    index = first_per_key(entries, ["base"], [c.desc() for c in order]).select("base", "path", "text")
    joined = images.select("base").join(index.withColumn("_hit", F.lit(True)), "base", "left")
    total = joined.select(F.count_if(F.col("_hit"))).scalar()
    kept = joined.filter(F.col("_hit") | (total == 0))
    return kept.select(
        "base", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit(default_text)).alias("text")
    )


def integrity(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Compare content hashes with a published manifest. Both carry ``path, sha256``,
    one row per path."""
    status = (
        F.when(F.col("have").isNull(), "missing")
        .when(F.col("want").isNull(), "unlisted")
        .when(F.col("have") != F.col("want"), "mismatch")
        .otherwise("ok")
    )
    return (
        files.select("path", F.col("sha256").alias("have"))
        .join(manifest.select("path", F.col("sha256").alias("want")), "path", "full_outer")
        .select("path", status.alias("status"))
    )


def size_check(masks: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """Masks whose height and width agree with their image."""
    sizes = images.select(key, F.col("height").alias("_h"), F.col("width").alias("_w"))
    status = (
        F.when(F.col("_h").isNull(), "no_image")
        .when((F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w")), "ok")
        .otherwise("size_mismatch")
    )
    return masks.join(sizes, key, "left").withColumn("status", status).drop("_h", "_w")


# -- descriptions ------------------------------------------------------------


def token_match(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Match a description to a part record of the same image.

    ``requests``: ``image, description``; ``records``: ``image, part, object, ord`` with
    one row per ``(image, ord)``. Token-set equality with one of five phrasings wins;
    else the record whose content tokens cover the description with the fewest extras.
    The cover test joins on the rarest token of the description, over distinct token
    sets, instead of pairing every description with every record.
    """
    asked = (
        requests.select("image", "description")
        .distinct()
        .withColumn("_set", F.array_sort(names.tokens(F.col("description"))))
        .withColumn("_content", F.array_sort(names.content_tokens(F.col("description"))))
    )
    part, obj = F.coalesce("part", F.lit("")), F.coalesce("object", F.lit(""))
    # "part obj" and "obj part" have one token set; so do both "of the" orders
    phrasings = F.array(
        part,
        F.concat(part, F.lit(" of the "), obj),
        F.concat(part, F.lit(" of "), obj),
        F.concat(obj, F.lit(" "), part),
    )
    strict = (
        records.select("image", "ord", F.explode(phrasings).alias("_t"))
        .filter("_t <> ''")
        .select("image", "ord", F.array_sort(names.tokens(F.col("_t"))).alias("_set"))
        .groupBy("image", "_set")
        .agg(F.min("ord").alias("_strict"))
    )
    sets = (
        records.withColumn("_cover", F.array_sort(names.content_tokens(F.concat_ws(" ", part, obj))))
        .groupBy("image", "_cover")
        .agg(F.min("ord").alias("ord"))
    )
    words = sets.select("image", "ord", "_cover", F.explode("_cover").alias("_w"))
    weight = words.groupBy("image", "_w").agg(F.count(F.lit(1)).alias("_n"))
    # the first tier settles most requests; only the rest need the cover test
    tier1 = asked.join(strict, ["image", "_set"], "left")
    open_ = tier1.filter(F.col("_strict").isNull() & (F.size("_content") > 0))
    open_ = open_.select("image", "_content").distinct()
    rarest = (
        open_.withColumn("_w", F.explode("_content"))
        .join(weight, ["image", "_w"], "left")
        .groupBy("image", "_content")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_w"))["_w"].alias("_w"))
    )
    cover = (
        rarest.join(words, ["image", "_w"])
        .filter(F.size(F.array_except("_content", "_cover")) == 0)
        .groupBy("image", "_content")
        .agg(
            F.min(F.struct(F.size(F.array_except("_cover", "_content")).alias("extra"), F.col("ord")))["ord"].alias("_loose")
        )
    )
    have = records.select("image").distinct().withColumn("_have", F.lit(True))
    status = (
        F.when(F.col("_strict").isNotNull(), "match")
        .when(F.col("_loose").isNotNull(), "match_permissive")
        .when(F.col("_have"), "no_part_match")
        .otherwise("no_image_record")
    )
    matched = (
        tier1.join(cover, ["image", "_content"], "left")
        .join(have, "image", "left")
        .select("image", "description", F.coalesce("_strict", "_loose").alias("ord"), status.alias("status"))
    )
    return matched.join(records.select("image", "ord", "part", "object"), ["image", "ord"], "left")


def missing_audit(matched: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """Requests of ``token_match`` that found no record: their ``rows``, the ``counts`` per
    status, and per image of a ``no_part_match`` the part names it has, in pages."""
    rows = matched.filter(F.col("ord").isNull()).select("image", "description", "status")
    images = rows.filter("status = 'no_part_match'").select("image").distinct()
    return {
        "rows": rows,
        "counts": rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        "available": distinct_lists(records.join(images, "image", "left_semi"), ["image"], "part", "parts"),
    }
