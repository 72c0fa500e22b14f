"""Operators against brute force on small fixtures, with their ties and edge cases."""

import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from sparkcurate.functions import templates
from sparkcurate.operators import gates, masks, match, metrics, ranking, regroup, sampling, select, sequence
from sparkcurate.operators.blocks import blocked_lag, blocked_running, range_block
from sparkcurate.sources import sinks


@pytest.fixture(autouse=True)
def keep_partitions_apart(spark):
    """Small fixtures would be merged into one partition and hide border cases."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def hot_rows(n=900, seed=3):
    """Rows where one key holds a third of all."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.randrange(6), rng.random()) for i in range(n)]


SCHEMA = "k string, i long, v int, x double"


# -- ranking and blocks ------------------------------------------------------


@pytest.mark.parametrize("heat", [10**6, 100, 0])
@pytest.mark.parametrize("parts", [1, 7])
def test_rank_rows(rows, parts, heat):
    data = hot_rows()
    got = ranking.rank_rows(rows(SCHEMA, data, parts), ["k"], [F.col("v").desc(), F.col("i")], "r", heat).collect()
    want = {}
    for k in {d[0] for d in data}:
        for r, d in enumerate(sorted((d for d in data if d[0] == k), key=lambda d: (-d[2], d[1])), 1):
            want[d[1]] = r
    assert {g["i"]: g["r"] for g in got} == want


def test_rank_rows_spreads_a_hot_key(rows):
    from sparkcurate.session import materialise

    df = rows(SCHEMA, hot_rows(6000), 8)
    cut = materialise(df.repartitionByRange("k", "i").withColumn("p", F.spark_partition_id()))
    assert cut.filter("k = 'hot'").select("p").distinct().count() > 1
    got = ranking.rank_rows(df, ["k"], [F.col("i")], "r", 1000).filter("k = 'hot'")
    assert got.agg(F.max("r"), F.countDistinct("r"), F.count("*")).first() == (2000, 2000, 2000)


def test_rank_without_keys_numbers_all_rows(rows):
    data = hot_rows(300)
    got = ranking.rank_rows(rows(SCHEMA, data, 5), [], [F.col("i")], "r").select("i", "r").collect()
    assert all(g["r"] == g["i"] + 1 for g in got) and len(got) == 300


def test_top_per_key_trims_before_the_shuffle(rows):
    df = ranking.top_per_key(rows(SCHEMA, hot_rows()), ["k"], [F.col("x").desc(), F.col("i")], 3, "r")
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning(k")
    assert "WindowGroupLimit" in plan[shuffle:]
    assert df.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    with pytest.raises(ValueError):
        ranking.top_per_key(df, ["k"], [F.col("x")], 5000)


@pytest.mark.parametrize("heat", [10**6, 100])
def test_paged_lists_keep_every_item(rows, heat):
    data = hot_rows()
    pages = ranking.paged_lists(rows(SCHEMA, data), ["k"], [F.col("i")], F.col("i"), page_size=50, hot_rows=heat).collect()
    assert max(len(p["items"]) for p in pages) == 50
    whole = defaultdict(list)
    for p in sorted(pages, key=lambda p: (p["k"], p["page"])):
        whole[p["k"]] += p["items"]
    want = defaultdict(list)
    for d in data:
        want[d[0]].append(d[1])
    assert whole == want


@pytest.mark.parametrize("width", [None, 1, 7, 10_000])
def test_blocks_equal_whole_windows(rows, width):
    data = hot_rows()
    df = rows(SCHEMA, data).withColumn("b", range_block("i", width or 1))
    b = "b" if width else None
    lag = {r["i"]: r["p"] for r in blocked_lag(df, ["k"], b, ["i"], {"p": "v"}).collect()}
    cols = {"s": ("sum", "v"), "m": ("max", "x"), "n": ("min", "x")}
    run = {r["i"]: r for r in blocked_running(df, ["k"], b, ["i"], cols).collect()}
    prior = {r["i"]: r["m"] for r in blocked_running(df, ["k"], b, ["i"], {"m": ("max", "x")}, False).collect()}
    for k in {d[0] for d in data}:
        before = []
        for _, i, v, x in sorted((d for d in data if d[0] == k), key=lambda d: d[1]):
            assert lag[i] == (before[-1][0] if before else None)
            assert prior[i] == (max(b[1] for b in before) if before else None)
            before.append((v, x))
            assert run[i]["s"] == sum(b[0] for b in before)
            assert run[i]["m"] == max(b[1] for b in before)
            assert run[i]["n"] == min(b[1] for b in before)


def test_hot_keys_are_counted_out(rows):
    from sparkcurate.operators.blocks import hot_keys

    df = rows(SCHEMA, hot_rows())
    assert [r["k"] for r in hot_keys(df, ["k"], 100).collect()] == ["hot"]
    assert hot_keys(df, ["k"], 1000) is None


# -- sequences ---------------------------------------------------------------

CASES = {
    "rising": [0.1, 0.2, 0.3],
    "flat_then_down": [0.4, 0.4, 0.3, 0.9],
    "immediate": [0.98, 0.2],
    "plateau": [0.2, 0.5, 0.5, 0.5, 0.4, 0.6],
    "plateau_kept": [0.5, 0.5, 0.6],
    "down_up": [0.5, 0.1],
    "late_stop": [0.1, 0.97, 0.99],
    "single": [0.3],
}


def steps(rows, width=2):
    data = [(k, i, v) for k, vs in CASES.items() for i, v in enumerate(vs)]
    return rows("k string, i long, iou double", data).withColumn("b", range_block("i", width))


# keys of more rows than this are hot: none, some, all
HEAT = [10**6, 3, 0]


def kept(df):
    out = defaultdict(list)
    for r in df.orderBy("k", "i").collect():
        out[r["k"]].append(r["iou"])
    return dict(out)


@pytest.mark.parametrize("heat", HEAT)
@pytest.mark.parametrize("width", [1, 2])
def test_monotone_prefix(rows, width, heat):
    got = kept(sequence.monotone_prefix(steps(rows, width), ["k"], "b", ["i"], "iou", hot_rows=heat))
    for name, values in CASES.items():
        want = [values[0]]
        for a, b in zip(values, values[1:]):
            if b < a:
                break
            want.append(b)
        assert got[name] == want, name


@pytest.mark.parametrize("heat", HEAT)
@pytest.mark.parametrize("width", [1, 2])
def test_peak_trim(rows, width, heat):
    got = kept(sequence.peak_trim(steps(rows, width), ["k"], "b", ["i"], "iou", hot_rows=heat))
    assert got == {
        "rising": [0.1, 0.2, 0.3],
        "flat_then_down": [0.4],
        "immediate": [0.98],
        "plateau": [0.2, 0.5],
        "plateau_kept": [0.5, 0.5, 0.6],
        "down_up": [0.5],
        "late_stop": [0.1, 0.97],
        "single": [0.3],
    }


@pytest.mark.parametrize("heat", HEAT)
def test_null_keys_and_blocks_stay(rows, heat):
    data = [(k, i, None if i < 3 else i // 4) for k in ("a", None) for i in range(20)]
    df = rows("k string, i long, b long", data)
    numbered = sequence.step_numbers(df, ["k"], "b", ["i"], "n", heat).collect()
    assert {(r["k"], r["i"]): r["n"] for r in numbered} == {(k, i): i for k, i, _ in data} and len(numbered) == 40


@pytest.mark.parametrize("heat", HEAT)
def test_stuck_prefix(rows, heat):
    clicks = {
        "a": [(0, 0, True), (3, 0, True), (4, 1, True), (50, 50, True)],
        "b": [(0, 0, True), (1, 1, False), (1, 1, True), (9, 9, True)],
        "c": [(0, 0, True), (2, 2, True)],
    }
    data = [(k, i, x, y, p) for k, cs in clicks.items() for i, (x, y, p) in enumerate(cs)]
    df = rows("k string, i long, x int, y int, is_positive boolean", data).withColumn("b", range_block("i", 2))
    got = Counter(r["k"] for r in sequence.stuck_prefix(df, ["k"], "b", ["i"], hot_rows=heat).collect())
    assert got == {"a": 2, "b": 4, "c": 1}


@pytest.mark.parametrize("heat", HEAT)
def test_islands_and_step_zero(rows, heat):
    marks = {"u": [0, 0, 1, 0, 1, 1], "w": [1, 0, 0], "z": [0]}
    data = [(k, i, m) for k, ms in marks.items() for i, m in enumerate(ms)]
    df = rows("k string, i long, m int", data).withColumn("b", range_block("i", 2))
    got = sequence.islands(df, ["k"], "b", ["i"], F.col("m") == 1, hot_rows=heat).collect()
    numbers = {(r["k"], r["i"]): r["traj"] for r in got}
    assert [numbers["u", i] for i in range(6)] == [0, 0, 1, 1, 2, 3]
    assert [numbers["w", i] for i in range(3)] == [0, 0, 0]  # dense from 0 (D10)
    assert numbers["z", 0] == 0
    late = sequence.runs_by_start(df, ["k"], "b", ["i"], F.col("m") == 1, F.col("i").isin(2, 5), hot_rows=heat).collect()
    assert {(r["k"], r["i"], r["traj"]) for r in late} == {("u", 2, 1), ("u", 3, 1), ("u", 5, 3)}


@pytest.mark.parametrize("heat", HEAT)
def test_previous_value_starts_at_zero(rows, heat):
    df = sequence.previous_value(steps(rows), ["k"], "b", ["i"], "iou", "now", hot_rows=heat)
    got = {(r["k"], r["i"]): r["now"] for r in df.collect()}
    for name, values in CASES.items():
        assert [got[name, i] for i in range(len(values))] == [0.0, *values[:-1]]


@pytest.mark.parametrize("heat", [10**6, 0])
def test_accumulated_keeps_rows_beyond_one_loop(rows, heat):
    df = rows("k string, i long", [("a", i) for i in range(23)]).withColumn("b", range_block("i", 4))
    got = sequence.accumulated(df, ["k"], "b", ["i"], F.col("i"), "l", 10, hot_rows=heat).collect()
    assert {r["i"]: r["l"] for r in got} == {i: list(range(i // 10 * 10, i + 1)) for i in range(23)}


def test_summary_takes_the_first_maximum(rows):
    df = steps(rows).withColumn("step", F.col("i"))
    got = {r["k"]: r for r in sequence.summarise(df, ["k"], ["i"], "iou", "step", ["i"]).collect()}
    assert got["plateau"]["best_step"] == 5 and got["plateau_kept"]["best_step"] == 2
    flat = got["flat_then_down"]
    assert (flat["best_step"], flat["final_iou"], flat["step0_iou"], flat["num_steps"]) == (3, 0.9, 0.4, 4)
    assert flat["best_i"] == 3 and flat["final_i"] == 3 and flat["step0_i"] == 0
    tie = sequence.summarise(
        rows("k string, i long, iou double", [("t", 0, 0.5), ("t", 1, 0.5)]).withColumn("step", F.col("i")),
        ["k"], ["i"], "iou", "step",
    )
    assert tie.first()["best_step"] == 0


@pytest.mark.parametrize("heat", [10**6, 0])
def test_overlay_plan_uses_the_step_before(rows, heat):
    df = steps(rows).filter("k = 'rising'")
    name = F.format_string("%s__step%d", "k", "step")
    have = rows("name string", [("rising__step2",)])
    got = sequence.overlay_plan(df, ["k"], "b", ["i"], "i", name, have, hot_rows=heat).select("step", "mask_of", "name").collect()
    assert [tuple(r) for r in got] == [(1, 0, "rising__step1")]


# -- matching ----------------------------------------------------------------


def vocabulary(seed, n):
    rng = random.Random(seed)
    base = ["small ring", "dining table", "wine glass", "storage box", "tv", "table tennis paddle", "cup", "leather shoes"]
    out = set(base)
    while len(out) < n:
        w = list(rng.choice(base))
        for _ in range(rng.randrange(1, 4)):
            kind, at = rng.randrange(3), rng.randrange(len(w))
            if kind == 0:
                w.insert(at, rng.choice("abcdest "))
            elif kind == 1 and len(w) > 1:
                del w[at]
            else:
                w[at] = rng.choice("abcdest ")
        out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("cutoff", [0.9, 0.8])
def test_similar_pairs_finds_what_difflib_finds(spark, cutoff):
    left, right = vocabulary(1, 120), vocabulary(2, 120)
    got = match.similar_pairs(
        spark.createDataFrame([(x,) for x in left], "left string"),
        spark.createDataFrame([(x,) for x in right], "right string"), cutoff,
    ).collect()
    want = {}
    for a in left:
        for b in right:
            ratio = SequenceMatcher(None, b, a).ratio()
            if ratio >= cutoff:
                want[a, b] = ratio
    assert {(r["left"], r["right"]): r["score"] for r in got} == want
    assert len(want) > 50


def test_match_vocabulary_tiers(spark):
    labels = {"i1": ["basket", "dining table", "wine glass"], "i2": ["wine glas", "wine glasss", "monitor/tv"], "i3": []}
    asked = [
        ("i1", "basket"), ("i1", "bakset"), ("i1", "dinning table"), ("i1", "wine glasses"), ("i2", "wine glass"),
        ("i2", "moniter/tv"), ("i3", "basket"), ("i2", "bakset"),
    ]
    req = spark.createDataFrame(asked, "image string, name string")
    lab = spark.createDataFrame([(i, x) for i, xs in labels.items() for x in xs], "image string, label string")
    got = {(r["image"], r["name"]): (r["matched_label"], r["is_fuzzy"])
           for r in match.match_vocabulary(req, lab, "image", templates.NAME_ALIASES, 0.9).collect()}
    for image, name in asked:
        have = labels[image]
        alias = templates.NAME_ALIASES.get(name)
        if name in have:
            want = (name, False)
        elif alias in have:
            want = (alias, False)
        else:
            close = get_close_matches(name, have, n=1, cutoff=0.9)
            want = (close[0], True) if close else (None, False)
        assert got[image, name] == want, (image, name)
    assert got["i2", "wine glass"][1] is True


def test_names_match_where_either_holds_the_other(spark):
    left, right = ["ring", "small ring", "x", "", "gold ring box"], ["ring", "small", "box", "small ring", "xx"]
    asked = spark.createDataFrame([(f"{i}.{j}", a, 0) for i, a in enumerate(left) for j in range(len(right))], "image string, name string, k long")
    boxes = [(f"{i}.{j}", b, 0, 0) for i in range(len(left)) for j, b in enumerate(right)]
    got = match.nearest_rank(asked, spark.createDataFrame(boxes, "image string, category string, cat_index long, ord long")).collect()
    assert len(got) == 25
    for r in got:
        other = right[int(r["image"][-1])]
        assert (r["category"] == other) is (r["name"] in other or other in r["name"]), r


def test_names_of_other_images_are_never_met(spark):
    """One image, one name: categories elsewhere only decide whether the exact name exists."""
    boxes = spark.createDataFrame([("a", "big cup", 0), ("b", "cup", 0), ("b", "cup", 1)], "image string, category string, ord long")
    asked = spark.createDataFrame([("a", "cup", 0), ("a", "big", 0), ("b", "cup", 1), (None, "cup", 0)], "image string, name string, k long")
    got = {(r["image"], r["name"]): r["ord"] for r in match.kth_match(asked, boxes, [F.col("ord")]).collect()}
    assert got == {("a", "cup"): None, ("a", "big"): 0, ("b", "cup"): 1, (None, "cup"): None}


def test_pieces_find_what_testing_every_label_finds(spark, monkeypatch):
    """Short, empty, repeated and mixed-case names; the index against one test a label."""
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abAé ") for _ in range(draw.randint(0, n)))
    boxes = spark.createDataFrame([(draw.choice("pq"), word(7), i) for i in range(150)] + [("r", "ab", 150)], "image string, category string, ord long")
    asked = spark.createDataFrame(sorted({(draw.choice("pqrs"), word(9), draw.randint(0, 2)) for _ in range(120)}), "image string, name string, k long")
    index = boxes.groupBy("image", "category").agg(F.min("ord").alias("ord")).withColumn("cat_index", F.lit(0).cast("long"))
    got = {}
    for crowd in (10**6, 0, 40):
        monkeypatch.setattr(match, "CROWD", crowd)
        kth = sorted(map(tuple, match.kth_match(asked, boxes, [F.col("ord")]).select("image", "name", "k", "ord").collect()), key=str)
        near = sorted(map(tuple, match.nearest_rank(asked, index).collect()), key=str)
        got[crowd] = kth, near
    assert got[0] == got[10**6] == got[40] and sum(r[3] is not None for r in got[0][0]) > 30


def test_an_image_with_very_many_categories(spark):
    n = 100_000
    boxes = spark.range(n).select(F.lit("i").alias("image"), F.format_string("part %06d", "id").alias("category"), F.col("id").alias("ord"))
    names = spark.range(0, n, 4).select(F.lit("i").alias("image"), F.format_string("a part %06d of it", "id").alias("name"), F.lit(0).cast("long").alias("k"))
    got = match.kth_match(names, boxes, [F.col("ord")])
    assert got.count() == n // 4 and got.filter(F.col("name") != F.format_string("a part %06d of it", "ord")).count() == 0


def test_endings_agree_with_every_ending(spark):
    draw = random.Random(3)
    name = lambda: "".join(draw.choice("ab12/\\") for _ in range(draw.randint(0, 7)))
    entries, wanted = [name() for _ in range(60)], sorted({name() + name() for _ in range(150)} | {""})
    cat = spark.createDataFrame([(f, i) for i, f in enumerate(entries)], "file_name string, ord long")
    req = spark.createDataFrame([(p,) for p in wanted] + [(None,)], "path string")
    got = {r["path"]: r["file_name"] for r in match.resolve_entity(req, cat, "file_name").collect()}
    bases = {p.rsplit("/", 1)[-1] for p in wanted}
    for p in wanted:
        ends = (f for f in entries if f and f.rsplit("/", 1)[-1] in bases and p.replace("\\", "/").endswith(f.replace("\\", "/")))
        assert got[p] == next(ends, None), p
    assert len(got) == len(wanted) + 1 and got[None] is None


def test_path_endings_read_backslashes_as_slashes(spark):
    files = ["d\\1.jpg", "e/1.jpg", "f/1.jpg", "g\\2.jpg", "h\\g\\2.jpg"]
    cat = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file_name string, ord long")
    req = spark.createDataFrame([("/m/f\\1.jpg",), ("/m/x/d/1.jpg",), ("/m/g\\2.jpg",), ("q/d\\1.jpg",), ("/m\\e/1.jpg",)], "path string")
    got = {m: {r["path"]: (r["file_name"], r["match_how"]) for r in match.resolve_entity(req, cat, m).collect()} for m in ("auto", "file_name")}
    assert got["auto"] == {
        "/m/f\\1.jpg": ("f/1.jpg", "file_name_suffix"), "/m/x/d/1.jpg": ("e/1.jpg", "ambiguous_fallback"),
        "/m/g\\2.jpg": ("g\\2.jpg", "basename_unique"), "q/d\\1.jpg": ("d\\1.jpg", "basename_unique"),
        "/m\\e/1.jpg": ("e/1.jpg", "file_name_suffix_from_ambiguous"),
    }
    assert got["file_name"]["/m/x/d/1.jpg"] == ("d\\1.jpg", "file_name_suffix")


def test_miss_report(spark):
    rows = spark.createDataFrame([(f"i{n:02d}", n % 2 == 0) for n in range(40)], "image string, found boolean")
    got = sorted(match.miss_report(rows, ~F.col("found"), ["image"], examples=3).collect())
    assert [tuple(r) for r in got] == [(0, None, 20), (1, "i01", None), (2, "i03", None), (3, "i05", None)]
    none = match.miss_report(rows.filter("found"), ~F.col("found"), ["image"]).collect()
    assert [tuple(r) for r in none] == [(0, None, 0)]


def test_profile_summary_and_totals(spark):
    clicks = spark.createDataFrame([("Positive", 1, 5), ("Positive", 3, 7), ("Negative", 8, 0), (None, 4, 4)], "sign string, x long, y long")
    got = {r["click_type"]: r for r in metrics.profile_summary(clicks, "sign", "x", "y").collect()}
    assert {k: (r["n"], r["share"]) for k, r in got.items()} == {"Positive": (2, 50.0), "Negative": (1, 25.0), None: (1, 25.0), "all": (4, 100.0)}
    assert (got["all"]["min_x"], got["all"]["max_x"], got["all"]["mean_x"], got["all"]["mean_y"]) == (1, 8, 4.0, 4.0)
    items = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "b"), ("2", "a")], "bucket string, image string")
    assert sorted(tuple(r) for r in metrics.list_totals(items, "bucket", "image").collect()) == [("1", 2, 3), ("2", 1, 1)]


ENTRIES = ["a/1.jpg", "b/1.jpg", "images/patch1/2.jpg", "images/patch12/2.jpg", "PATCH2/x/3.jpg", "q/3.jpg", "only/4.jpg", "5.jpg", "7.jpg", "a/9.jpg"]
RESOLVED = {
    # path: entry and way, for the modes auto, basename and file_name
    "/m/a/1.jpg": [("a/1.jpg", "file_name_suffix_from_ambiguous"), ("a/1.jpg", "basename_ambiguous"), ("a/1.jpg", "file_name_suffix")],
    "/m/xb/1.jpg": [("b/1.jpg", "file_name_suffix_from_ambiguous"), ("a/1.jpg", "basename_ambiguous"), ("b/1.jpg", "file_name_suffix")],
    "/m/z/1.jpg": [("a/1.jpg", "ambiguous_fallback"), ("a/1.jpg", "basename_ambiguous"), (None, "not_found")],
    "/m/Patch12/2.jpg": [("images/patch12/2.jpg", "basename_patch_disambiguated")] * 2 + [(None, "not_found")],
    "/m/images/patch1/2.jpg": [("images/patch1/2.jpg", "file_name_suffix_from_ambiguous"), ("images/patch1/2.jpg", "basename_ambiguous"), ("images/patch1/2.jpg", "file_name_suffix")],
    "/m/patch2/3.jpg": [("PATCH2/x/3.jpg", "basename_patch_disambiguated")] * 2 + [(None, "not_found")],
    "/m/4.jpg": [("only/4.jpg", "basename_unique")] * 2 + [(None, "not_found")],
    "/m/5.jpg": [("5.jpg", "basename_unique")] * 2 + [("5.jpg", "file_name_suffix")],
    "/m/17.jpg": [("7.jpg", "file_name_suffix"), (None, "not_found"), ("7.jpg", "file_name_suffix")],
    "/m/7.jpg": [("7.jpg", "basename_unique")] * 2 + [("7.jpg", "file_name_suffix")],
    "/m/8.jpg": [(None, "not_found")] * 3,
}


@pytest.mark.parametrize("at,mode", list(enumerate(["auto", "basename", "file_name"])))
def test_resolve_entity(spark, at, mode):
    req = spark.createDataFrame([(p,) for p in RESOLVED], "path string")
    cat = spark.createDataFrame([(f, i) for i, f in enumerate(ENTRIES)], "file_name string, ord long").repartition(5)
    got = {r["path"]: (r["file_name"], r["match_how"]) for r in match.resolve_entity(req, cat, mode).collect()}
    assert got == {p: ways[at] for p, ways in RESOLVED.items()}


def test_token_match(spark):
    records = [
        ("i", "left door handle", "refrigerator", 0),
        ("i", "door handle", "refrigerator", 1),
        ("i", "handle", "pot", 2),
        ("i", "handle", "pot", 3),
        ("j", "screen", "phone", 4),
        ("j", "", "lid", 5),
    ]
    cases = [
        ("i", "handle of the pot", 2, "match"),
        ("i", "pot handle", 2, "match"),
        ("i", "Door-handle of the refrigerator!", 1, "match"),
        ("i", "handle of a refrigerator", 1, "match_permissive"),
        ("i", "left refrigerator", 0, "match_permissive"),
        ("i", "screen", None, "no_part_match"),
        ("i", "the", None, "no_part_match"),
        ("j", "screen", 4, "match"),
        ("j", "lid", 5, "match"),
        ("k", "screen", None, "no_image_record"),
    ]
    got = match.token_match(
        spark.createDataFrame([c[:2] for c in cases], "image string, description string"),
        spark.createDataFrame(records, "image string, part string, object string, ord long").repartition(4),
    ).collect()
    assert {(r["image"], r["description"]): (r["ord"], r["status"]) for r in got} == {c[:2]: c[2:] for c in cases}


def test_token_match_worked_cases(spark):
    req = spark.createDataFrame(
        [("a", "screen of the phone"), ("b", "handle of the refrigerator")], "image string, description string"
    )
    rec = spark.createDataFrame(
        [("a", "screen", "phone", 0), ("b", "left door handle", "refrigerator", 1)],
        "image string, part string, object string, ord long",
    )
    got = {r["image"]: r["status"] for r in match.token_match(req, rec).collect()}
    assert got == {"a": "match", "b": "match_permissive"}


def test_kth_match_prefers_the_exact_name(spark):
    boxes = [("i", "ring", 0), ("i", "small ring", 1), ("i", "Ring", 2), ("i", "ring box", 3)]
    asked = [("i", "ring", 0), ("i", "ring", 1), ("i", "ring", 2), ("i", "Small ring box set", 0), ("i", "Small ring box set", 3), ("j", "ring", 0)]
    got = match.kth_match(
        spark.createDataFrame(asked, "image string, name string, k long"),
        spark.createDataFrame(boxes, "image string, category string, ord long"), [F.col("ord")],
    ).collect()
    have = {(r["image"], r["name"], r["k"]): r["ord"] for r in got}
    assert have == {
        ("i", "ring", 0): 0, ("i", "ring", 1): 2, ("i", "ring", 2): None,
        ("i", "Small ring box set", 0): 0, ("i", "Small ring box set", 3): 3, ("j", "ring", 0): None,
    }


def test_nearest_rank_clamps(spark):
    boxes = [("i", "cup", 0, 0), ("i", "cup", 1, 2), ("i", "paper cup", 0, 1), ("i", "pot", 0, 3)]
    asked = [("i", "Cup", 0), ("i", "Cup", 1), ("i", "Cup", 7), ("i", "pot", 5), ("i", "jar", 0)]
    got = match.nearest_rank(
        spark.createDataFrame(asked, "image string, name string, k long"),
        spark.createDataFrame(boxes, "image string, category string, cat_index long, ord long"),
    ).collect()
    have = {(r["name"], r["k"]): (r["category"], r["cat_index"]) for r in got}
    assert have == {
        ("Cup", 0): ("cup", 0), ("Cup", 1): ("cup", 1), ("Cup", 7): ("cup", 1), ("pot", 5): ("pot", 0), ("jar", 0): (None, None)
    }


def test_stem_match_collisions_and_markers(spark):
    images = [("b/IMG.jpg",), ("a/img.png",), ("a/other_m.jpg",)]
    asked = [("m/img_mask.png",), ("m/Img.png",), ("m/other_m.png",), ("m/other_m_seg.png",), ("m/none.png",)]
    got = match.stem_match(
        spark.createDataFrame(asked, "mask_path string"), spark.createDataFrame(images, "image_path string")
    ).collect()
    assert {r["mask_path"]: r["image_path"] for r in got} == {
        "m/img_mask.png": "a/img.png", "m/Img.png": "a/img.png", "m/other_m.png": "a/other_m.jpg",
        "m/other_m_seg.png": "a/other_m.jpg", "m/none.png": None,
    }


def test_first_existing(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["x", "b"]), (3, ["x", "y"])], "id long, c array<string>")
    inv = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    last = {r["id"]: r["resolved"] for r in match.first_existing(df, ["id"], F.col("c"), inv).collect()}
    first = {r["id"]: r["resolved"] for r in match.first_existing(df, ["id"], F.col("c"), inv, default="first").collect()}
    assert last == {1: "a", 2: "b", 3: "y"} and first == {1: "a", 2: "b", 3: "x"}


def test_two_tier_lookup_and_todo(spark):
    items = spark.createDataFrame([(1, "x", 10), (2, "y", 11), (3, "z", None)], "line long, p string, n long")
    lines = spark.createDataFrame([(1, "1")], "line long, bucket string")
    pairs = spark.createDataFrame([("x", "9"), ("y", "2")], "p string, bucket string")
    got = {r["line"]: (r["bucket"], r["matched_by"]) for r in match.two_tier_lookup(items, lines, pairs, "line", ["p"], "bucket").collect()}
    assert got == {1: ("1", "line"), 2: ("2", "pair"), 3: (None, "unmatched")}
    queue = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("c", 0)], "uid string, at long")
    done = spark.createDataFrame([("c",), ("c",)], "uid string")
    assert {tuple(r) for r in match.todo(queue, done, "uid", [F.col("at")]).collect()} == {("a", 1), ("b", 2)}


def test_bad_triples(spark):
    data = [("Wine  Glass", "stem", "drink_with", True), ("lamp", "lamp head", "TAKE_PHOTO", True), ("lamp", "lamp", "Take_photo", False)]
    df = spark.createDataFrame(data, "o string, p string, a string, want boolean")
    got = match.flag_bad_triples(df, F.col("o"), F.col("p"), F.col("a")).collect()
    assert all(r["is_bad"] == r["want"] for r in got)


def test_name_lookup_falls_back_to_all(spark):
    images = spark.createDataFrame([("a",), ("b",)], "base string")
    entries = spark.createDataFrame([("a", "p1", "t1", 1), ("a", "p2", "t2", 2)], "base string, path string, text string, n long")
    assert [tuple(r) for r in match.name_lookup(images, entries, [F.col("n")], "obj").collect()] == [("a", "p2", "t2")]
    none = match.name_lookup(images, entries.withColumn("base", F.lit("z")), [F.col("n")], "obj").collect()
    assert {tuple(r) for r in none} == {("a", "", "obj"), ("b", "", "obj")}


def test_integrity_statuses(spark):
    have = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    want = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert {tuple(r) for r in match.integrity(have, want).collect()} == {
        ("a", "ok"), ("b", "mismatch"), ("c", "unlisted"), ("d", "missing")
    }


# -- selection ---------------------------------------------------------------


def candidate(name, i, **over):
    row = dict(
        target_object=name, affordance="grasp", bw_yellow_veto=0, image_quality=5, clutter=0, affordance_quality=5,
        object_visible=3, bbox_quality=3, parts_visibility=3, confidence="high", i=i,
    )
    return {**row, **over}


@pytest.mark.parametrize("heat", [10**6, 100])
def test_adaptive_selection_invariants(spark, heat):
    data = [candidate("cup", i, parts_visibility=i % 4, affordance="wear") for i in range(300)]
    data += [candidate("pot", i, clutter=i % 3) for i in range(300, 340)]
    data += [candidate("jar", 400, image_quality=3, affordance_quality=3)]
    df = spark.createDataFrame(data).repartition(6)
    got = select.adaptive_selection(df, ["i"], heat, keep_all=20, hard_caps={"pot": 25})
    caps = {r["target_object"]: r for r in got["caps"].collect()}
    kept = got["kept"].collect()
    counts = Counter(r["target_object"] for r in kept)
    assert caps["cup"]["cap"] == int(round(20 + 12 * 280**0.5) * 0.55)
    assert caps["pot"]["cap"] == 25 and caps["jar"]["cap"] == 1
    assert counts == {c: r["cap"] for c, r in caps.items()}
    # rejected plus passed rows add up to all rows
    reasons = Counter(r["reason"] for r in got["judged"].select("reason").collect())
    assert sum(reasons.values()) == len(data) and reasons["pass"] == sum(r["n_passed"] for r in caps.values())
    # the best rows stay, the input order breaks ties
    cups = sorted(r["i"] for r in kept if r["target_object"] == "cup")
    order = sorted(range(300), key=lambda i: (-(i % 4), i))
    assert cups == sorted(order[: caps["cup"]["cap"]])
    # every row carries the cut-offs of its own class (D1)
    strict = {r["target_object"]: r["strictness"] for r in got["cuts"].collect()}
    assert all(r["strictness"] == strict[r["target_object"]] for r in kept)
    summary = {r["target_object"]: r for r in select.object_summary(got).collect()}
    assert {k: r["kept"] for k, r in summary.items()} == counts


def test_best_evaluation_first_of_equals(spark):
    data = [("r", 0, "Cup", 0.5), ("r", 1, "cup ", 0.9), ("r", 2, "mug", 0.9), ("r", 3, "pot", 1.0), ("s", 0, "pot", 1.0)]
    df = spark.createDataFrame(data, "rec string, pos long, object string, score double")
    df = df.withColumns({"a": F.lit(" CUP"), "b": F.when(F.col("rec") == "r", "mug").otherwise("")})
    got = select.best_evaluation(df, ["rec"], "score", "pos", ["a", "b"]).collect()
    assert [(r["rec"], r["pos"]) for r in got] == [("r", 1)]


# -- regrouping --------------------------------------------------------------


def test_last_and_first_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n long, v string")
    assert {tuple(r) for r in regroup.last_per_key(df, ["k"], ["n"]).collect()} == {("a", 2, "y"), ("b", 1, "z")}


def test_dominant_labels_first_seen_wins(spark):
    data = [("o", "open", "Open", "a", 3), ("o", "open", "OPEN", "b", 4), ("o", "pull", "Pull", "a", 1), ("o", "pull", "Pull", "a", 9)]
    df = spark.createDataFrame(data, "op string, label string, surface string, action string, n long")
    r = regroup.dominant_labels(df, ["op"], "label", "surface", ["action"], ["n"]).first()
    assert (r["label"], r["surface"], r["action"], r["label_count"]) == ("pull", "Pull", "a", 2)


def test_bad_labels_never_become_the_target(spark):
    """D8: with the bad rows left out, a group of only bad labels is dropped."""
    data = [("cup", "lid", "Eat", 1), ("cup", "lid", "Eat", 2), ("cup", "lid", "Open", 3), ("pot", "lid", "Eat", 4)]
    df = spark.createDataFrame(data, "object string, part string, aff string, n long")
    df = match.flag_bad_triples(df, F.col("object"), F.col("part"), F.col("aff"))
    good = df.filter("NOT is_bad").withColumns({"label": F.lower("aff"), "surface": F.col("aff"), "action": F.lit("")})
    dom = regroup.dominant_labels(good, ["object", "part"], "label", "surface", ["action"], ["n"])
    got = {r["n"]: (r["outcome"], r["to_label"]) for r in regroup.relabel(df, dom, ["object", "part"], "is_bad").collect()}
    assert got == {1: ("remap", "Open"), 2: ("remap", "Open"), 3: ("keep", "Open"), 4: ("drop", None)}


def test_conflicts(spark):
    data = [("k", "1", 0), ("k", "2", 1), ("k", "2", 2), ("k", "1", 3), ("z", "5", 0)]
    df = spark.createDataFrame(data, "k string, b string, n long")
    assert {tuple(r) for r in regroup.conflicts(df, ["k"], "b", ["n"]).collect()} == {("k", "1", 2), ("z", "5", 0)}


def test_outer_merge_reconciles(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, part string")
    right = spark.createDataFrame([(2, None), (3, "c")], "k long, part string")
    got = {r["k"]: (r["status"], r["part"]) for r in regroup.outer_merge(left, right, ["k"], ["part"]).collect()}
    # a right row wins even with an empty field
    assert got == {1: ("no_right", "a"), 2: ("both", None), 3: ("no_left", "c")}


def test_unique_names_never_clash(spark):
    data = [("f", "x", 1), ("f", "x", 2), ("f", "x_2", 3), ("g", "x", 4), ("f", "X!", 5)]
    df = spark.createDataFrame(data, "folder string, d string, n long")
    from sparkcurate.functions.names import slug

    got = regroup.unique_names(df, "folder", slug(F.col("d")), [F.col("n")]).collect()
    names = [(r["folder"], r["file_name"]) for r in got]
    assert len(set(names)) == len(names)
    assert {r["n"]: r["file_name"] for r in got} == {1: "x", 2: "x__2", 3: "x_2", 4: "x", 5: "x__3"}


def test_label_block_counts_all_but_lists_top(spark):
    data = [("i", "cup", 9.0, 1), ("i", "pot", 8.0, 2), ("i", "pot", 7.0, 3), ("i", "jar", 1.0, 4), ("i", " ", 6.0, 5)]
    labels = spark.createDataFrame(data, "image string, name string, area double, n long")
    images = spark.createDataFrame([("i",), ("j",)], "image string")
    got = {r["image"]: tuple(r)[1:] for r in regroup.label_block(images, labels, "area", ["n"], k=4).collect()}
    assert got == {"i": (5, "cup\npot", "pot: 2\ncup: 1"), "j": (0, "(none)", "(none)")}


def test_part_catalog_and_rollup(spark):
    data = [
        ("cup", "lid", "Open", "open", "i1", "1"), ("cup", "lid", "Grasp", "", "i1", "2"), ("cup", "rim", "Open", "open", "i2", "1"),
        ("", "rim", "Open", "open", "i3", "1"),
    ]
    df = spark.createDataFrame(data, "object string, part string, affordance string, action string, image_path string, bucket string")
    cat = {(r["object"], r["part"]): r for r in regroup.part_catalog(df).collect()}
    assert cat["cup", "lid"]["affordances"] == ["Grasp", "Open"] and cat["cup", "lid"]["actions"] == ["open"]
    assert cat["cup", "lid"]["image_count"] == 1 and cat["cup", "lid"]["item_count"] == 2 and len(cat) == 2
    up = {(r["affordance"], r["object"]): r for r in regroup.affordance_rollup(df.filter("object <> ''")).collect()}
    assert up["Open", None]["parts"] == ["lid", "rim"] and up["Open", None]["image_count"] == 2
    line = regroup.catalog_line(regroup.part_catalog(df)).orderBy("line").first()["line"]
    assert line == "object=cup | part=lid | affordances=Grasp, Open | actions=open | image_count=1 | item_count=2"


def test_catalog_pages_stay_whole(spark):
    data = [("cup", "lid", f"a{i % 7}", f"x{i % 3}", f"i{i}", "1") for i in range(40)]
    df = spark.createDataFrame(data, "object string, part string, affordance string, action string, image_path string, bucket string")
    rows = sorted(regroup.part_catalog(df, page_size=3).collect(), key=lambda r: r["page"])
    assert [r["page"] for r in rows] == [0, 1, 2]
    assert sum((r["affordances"] for r in rows), []) == [f"a{i}" for i in range(7)]
    assert sum((r["actions"] for r in rows), []) == ["x0", "x1", "x2"]
    assert {(r["item_count"], r["image_count"], r["affordance_count"]) for r in rows} == {(40, 40, 7)}
    up = regroup.affordance_rollup(df.withColumn("part", F.col("image_path")), page_size=4).filter("object IS NULL AND affordance = 'a0'")
    got = sorted(up.collect(), key=lambda r: r["page"])
    assert sorted(sum((r["parts"] for r in got), [])) == sorted(f"i{i}" for i in range(0, 40, 7)) and got[0]["part_count"] == 6


def test_sit_on_and_whole_object(spark):
    data = [("seat", "Sit_on", "", True), ("leg", "sit_on", "", False), ("leg", "x", "sit on", False), ("leg", "x", "y", True)]
    df = spark.createDataFrame(data, "p string, a string, act string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", gates.sit_on_rule(F.col("p"), F.col("a"), F.col("act")).alias("got")).collect())
    # the skip rule does fire (D6)
    assert [r[0] for r in spark.createDataFrame([("whole_object",), ("Whole Object",), ("lid",)], "p string").select(gates.is_whole_object(F.col("p"))).collect()] == [True, True, False]


def test_image_gate_reads_odd_values_as_zero(spark):
    data = [("0", "3", "2", True), (None, "2", None, True), ("1", "5", "0", False), ("0", "bad", "0", False), ("0", "3", "5", False)]
    df = spark.createDataFrame(data, "v string, q string, c string, want boolean")
    got = df.select("want", gates.image_gate(F.col("v"), F.col("q"), F.col("c")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


# -- masks -------------------------------------------------------------------

H = 4


def grid(*cells):
    return [int(i in cells) for i in range(H * 5)]


GRIDS = {
    "empty": grid(), "full": grid(*range(20)), "pixel": grid(7), "crossing": grid(2, 3, 4, 5), "ends": grid(0, 19),
    "stripes": grid(*range(0, 20, 2)), "other": grid(3, 4, 9, 10, 11, 12),
}


def mask_runs(spark):
    df = spark.createDataFrame(list(GRIDS.items()), "id string, px array<int>")
    return masks.runs(df, "id", F.transform("px", lambda v: v > 0))


def brute_runs(px):
    out, start = [], None
    for i, v in enumerate([*px, 0]):
        if v and start is None:
            start = i
        if not v and start is not None:
            out.append((start, i - start))
            start = None
    return out


def test_mask_runs_area_box(spark):
    runs = mask_runs(spark)
    got = defaultdict(list)
    for r in runs.collect():
        got[r["id"]].append((r["run_start"], r["run_len"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_runs(p) for k, p in GRIDS.items() if any(p)}
    assert {r["id"]: r["area"] for r in masks.area(runs, "id").collect()} == {k: sum(p) for k, p in GRIDS.items() if any(p)}
    for r in masks.bbox(runs, "id", H).collect():
        on = [i for i, v in enumerate(GRIDS[r["id"]]) if v]
        xs, ys = [i // H for i in on], [i % H for i in on]
        assert (r["x"], r["y"], r["w"], r["h"]) == (min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)


@pytest.mark.parametrize("heat", [10**6, 2])
def test_mask_overlap_both_conventions(spark, heat):
    pairs = [(a, b) for a in GRIDS for b in GRIDS]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in masks.overlap(df, mask_runs(spark), "id", "a", "b", hot_rows=heat).collect():
        p, q = GRIDS[r["a"]], GRIDS[r["b"]]
        inter, union = sum(x & y for x, y in zip(p, q)), sum(x | y for x, y in zip(p, q))
        assert (r["inter"], r["union_px"]) == (inter, union)
        assert inter <= min(sum(p), sum(q))
        assert r["iou"] == pytest.approx(1.0 if union == 0 else inter / union)
        assert r["iou_eps"] == pytest.approx(inter / (union + 1e-6))


def test_overlap_of_long_runs(spark):
    rng = random.Random(4)
    data = {}
    for name in "ab":
        px = [0] * 1000
        for _ in range(12):
            s = rng.randrange(990)
            for i in range(s, min(1000, s + rng.randrange(1, 200))):
                px[i] = 1
        data[name] = px
    runs = spark.createDataFrame([(k, s, n) for k, px in data.items() for s, n in brute_runs(px)], "id string, run_start long, run_len long")
    r = masks.overlap(spark.createDataFrame([("a", "b")], "a string, b string"), runs, "id", "a", "b").first()
    assert r["inter"] == sum(x & y for x, y in zip(data["a"], data["b"]))
    assert r["union_px"] == sum(x | y for x, y in zip(data["a"], data["b"]))


def test_a_full_mask_is_one_row(spark):
    """Large masks of few runs; touching and overlapping runs; the borders are all that is written."""
    side = 4096
    rows = [("full", 0, side * side), ("half", 0, side * side // 2), ("two", 0, 1000), ("two", 1000, side), ("two", 500, 100), ("none", 5, 0)]
    runs = spark.createDataFrame(rows, "id string, run_start long, run_len long")
    pairs = spark.createDataFrame([("full", "half"), ("half", "two"), ("two", "two"), ("none", "none"), ("full", None)], "a string, b string")
    got = {(r["a"], r["b"]): (r["inter"], r["union_px"], r["iou"]) for r in masks.overlap(pairs, runs, "id", "a", "b").collect()}
    n = 1000 + side
    assert got == {
        ("full", "half"): (side * side // 2, side * side, 0.5), ("half", "two"): (n, side * side // 2, n / (side * side // 2)),
        ("two", "two"): (n, n, 1.0), ("none", "none"): (0, 0, 1.0), ("full", None): (0, 0, 1.0),
    }
    box = [F.lit(v) for v in (10, 20, 4000, 3000)]
    cut = masks.crop(runs.filter("id = 'full'"), "id", side, box).collect()
    assert [(r["run_start"], r["run_len"]) for r in cut] == [(0, 3990 * 2980)]


@pytest.mark.parametrize("heat", [10**6, 2])
@pytest.mark.parametrize("box", [(0, 0, 5, 4), (1, 1, 4, 3), (2, 0, 5, 4), (0, 3, 5, 4), (1, 0, 2, 1), (1, -1, 4, 6)])
def test_mask_crop(spark, box, heat):
    x1, y1, x2, y2 = box
    got = defaultdict(list)
    for r in masks.crop(mask_runs(spark), "id", H, [F.lit(v) for v in box], hot_rows=heat).collect():
        got[r["id"]].append((r["run_start"], r["run_len"]))
    want = {}
    for k, px in GRIDS.items():
        inside = [px[c * H + r] if 0 <= r < H else 0 for c in range(x1, x2) for r in range(y1, y2)]
        if any(inside):
            want[k] = brute_runs(inside)
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize(
    "values, dataset, target, error, method, n",
    [
        ([0, 0], "d", None, "empty_mask", "", 0),
        ([], "d", None, "empty_mask", "", 0),
        ([0, 1, 1], "d", None, None, "binary_nonzero", 2),
        ([0, 255, 1], "d", None, None, "binary_nonzero", 2),
        ([0, 1], "s", None, "non_0_255_mask_values_for_strict_dataset", "", 0),
        ([0, 255], "s", None, None, "binary_nonzero", 1),
        ([3, 200, 128], "d", None, None, "threshold>=128", 2),
        ([3, 127], "d", None, "all_values_below_threshold", "threshold>=128", 0),
        ([3, 4, 3], "s", 3, None, "class_id=3", 2),
        ([3, 4], "d", 5, "class_id_not_found", "class_id=5", 0),
    ],
)
def test_mask_unify(spark, values, dataset, target, error, method, n):
    df = spark.createDataFrame([(values, dataset, target)], "v array<int>, d string, t int")
    got = masks.unify(F.col("v"), F.col("d"), F.col("t"), strict=["s"])
    r = df.select(*[c.alias(k) for k, c in got.items()]).first()
    assert (r["error"], r["method"], r["foreground"]) == (error, method, n)


# -- metrics, samples, slices ------------------------------------------------


def test_iou_metrics_guard_zero_union(spark):
    data = [(0.9, 0.4, 0.8, 0, 0, 0, 0, 0, 0), (0.5, 0.5, 0.5, 0, 0, 0, 0, 0, 0)]
    cols = ["best_iou", "step0_iou", "final_iou"] + [f"{k}_{x}" for k in ("best", "step0", "final") for x in ("inter", "union")]
    r = metrics.iou_metrics(spark.createDataFrame(data, cols)).first()
    assert r["best_ciou"] == 0.0 and r["best_giou"] == 70.0 and r["best_p50"] == 100.0 and r["step0_p50"] == 50.0
    # 0.9 reaches the ninth threshold, which is a little below 0.9
    assert r["best_p50_95"] == pytest.approx((9 + 1) / 20 * 100)
    assert r["refinement_gain"] == pytest.approx(25.0)


def test_best_checkpoint_ties(spark):
    data = [(1, "10/90", None, 0.5), (2, "20/90", None, 0.5), (3, "30/90", 0.9, None), (4, "bad", 0.8, None), (5, "", None, None)]
    df = spark.createDataFrame(data, "n long, progress string, loss double, eval_loss double")
    r = metrics.best_checkpoint(metrics.split_log(df), ["n"]).first()
    assert tuple(r) == (2, 10, 0.5, 2, None, 0.8)


def test_funnel_and_buckets(spark):
    df = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "file string, n int")
    got = {r["file"]: (r["rows_in"], r["big"]) for r in metrics.funnel(df, "file", {"big": F.col("n") > 1}).collect()}
    assert got == {"f": (2, 1), "g": (1, 1), None: (3, 2)}
    rows = spark.createDataFrame([("i", k) for k, n in [("a", 1), ("b", 5), ("c", 6)] for _ in range(n)], "image string, label string")
    assert {(r["label"], r["bucket"]) for r in metrics.count_buckets(rows, ["image", "label"]).collect()} == {("a", 1), ("b", 5)}


def test_samples_do_not_depend_on_partitions(rows):
    data = [(f"d{i}", i) for i in range(200)]
    take = lambda parts, seed: [r["i"] for r in sampling.seeded(rows("k string, i long", data, parts), F.col("k"), seed, 20).collect()]
    assert sorted(take(1, 7)) == sorted(take(9, 7))
    assert sorted(take(1, 7)) != sorted(take(1, 8))
    assert sampling.every_nth(rows("k string, i long", data), "i", 50).count() == 4


def test_slices_chunks_shards(rows):
    df = rows("k string, i long", [("x", i) for i in range(103)], 6)
    assert sorted(r["i"] for r in sinks.row_slice(df, [F.col("i")], 10, 20).collect()) == list(range(10, 20))
    assert sinks.row_slice(df, [F.col("i")], 100).count() == 3
    assert Counter(r["chunk"] for r in sinks.chunks(df, [F.col("i")], 40).collect()) == {0: 40, 1: 40, 2: 23}
    assert Counter(r["shard"] for r in sinks.shards(df, [F.col("i")], 4).collect()) == {0: 26, 1: 26, 2: 26, 3: 25}


def test_rollup_counts_images_without_expanding_rows(spark):
    rows = [("a", "o1", "p1", 1), ("a", "o2", "p1", 1), ("a", "o2", "p2", 2), ("a", "o2", "p2", 2), ("a", "o2", "p2", None), ("b", "o1", "p1", 1)]
    df = spark.createDataFrame(rows, "affordance string, object string, part string, image_path long")
    up = regroup.affordance_rollup(df)
    got = {(r.affordance, r.object): (r.item_count, r.image_count, r.part_count, r.parts) for r in up.collect()}
    assert got == {
        ("a", "o1"): (1, 1, 1, ["p1"]), ("a", "o2"): (4, 2, 2, ["p1", "p2"]), ("a", None): (5, 2, 2, ["p1", "p2"]),
        ("b", "o1"): (1, 1, 1, ["p1"]), ("b", None): (1, 1, 1, ["p1"]),
    }
    detail = up._jdf.queryExecution().analyzed().toString()
    assert "Expand" not in detail


def test_first_listed_looks_up_in_order_and_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "x", "y"), (2, "x", "z"), (3, None, "y"), (3, None, "y"), (4, "q", None)], "id long, a string, b string")
    stock = spark.createDataFrame([("y",), ("y",), ("z",)], "path string")
    got = match.first_listed(rows, [F.col("a"), F.col("b")], stock, "hit")
    assert sorted((r.id, r.hit) for r in got.collect()) == [(1, "y"), (2, "z"), (3, "y"), (3, "y"), (4, "q")]


@pytest.mark.parametrize("hashed", [match.HASHED, 0])
def test_first_listed_sorts_no_expressions_and_hashes_what_fits(spark, monkeypatch, hashed):
    monkeypatch.setattr(match, "LISTED", 0)
    monkeypatch.setattr(match, "HASHED", hashed)
    rows = spark.range(40).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("m"), F.col("id") % 20, F.lit(".jpg"))).alias("image"))
    stock = spark.range(20).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("m"), "id", F.when(F.col("id") % 3 == 1, "_a").otherwise(""))).alias("path"))
    stem = F.regexp_replace("image", r"\.jpg$", "")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = match.first_listed(rows, [stem, F.concat(stem, F.lit("_a"))], stock, "hit")
        plan = got._jdf.queryExecution().executedPlan().toString()
        hits = {r.id: r.hit for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not any("Sort [" in line and "regexp" in line for line in plan.splitlines())
    assert ("SortMergeJoin" in plan) == (hashed == 0) and ("ShuffledHashJoin" in plan) == (hashed > 0)
    assert hits == {i: f"m{i % 20}" + "_a" * (i % 20 % 3 == 1) if i % 7 else None for i in range(40)}
