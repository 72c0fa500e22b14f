"""Column expressions on literal rows."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from sparkcurate.functions import answers, checks, geometry, names, numbers, paths, scoring, templates


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def lit(v):
    return F.lit(v)


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (names.lower_name, "\t Big  Cup\n", "big  cup"),
        (names.squeezed_name, " Big \t Cup ", "big cup"),
        (names.word_key, " Left-Door_handle! ", "left door handle"),
        (names.label_key, "Drink_With  cup", "drink with cup"),
        (names.slug, "body of the hot dog", "body_of_the_hot_dog"),
        (names.slug, "!!!", "unnamed"),
        (names.underscored, " hot  dog ", "hot_dog"),
        (names.sanitise, " ,. the  lid;: ", "the lid"),
        (names.lower_name, None, ""),
        (paths.basename, "a/b/c.tar.gz", "c.tar.gz"),
        (paths.stem, "a/b/c.tar.gz", "c.tar"),
        (paths.stem, "a/.hidden", ".hidden"),
        (paths.stem, "noext", "noext"),
        (paths.suffix, "a/b.JPG", ".JPG"),
        (paths.suffix, "a.b/c", ""),
        (paths.parent_name, "a/cls/x.png", "cls"),
        (paths.patch_hint, "x/Patch12/y/patch3", "Patch12"),
        (paths.patch_hint, "x/y", ""),
        (paths.dataset_name, "d/myset_testA_1.json", "myset"),
        (paths.trailing_part, "m/1_cup_water-jug.png", "water jug"),
        (paths.strip_mask_suffix, "img_mask", "img"),
        (paths.strip_mask_suffix, "img-seg", "img"),
        (paths.strip_mask_suffix, "masked", "masked"),
    ],
)
def test_text_functions(spark, fn, text, want):
    assert one(spark, fn(F.lit(text).cast("string"))) == want


def test_slug_is_cut_to_eighty(spark):
    assert one(spark, F.length(names.slug(F.repeat(lit("ab "), 60)))) == 80


def test_tokens(spark):
    assert set(one(spark, names.tokens(lit("The lid of the Lid-2")))) == {"the", "lid", "of", "2"}
    assert set(one(spark, names.content_tokens(lit("the lid of a pot")))) == {"lid", "pot"}


@pytest.mark.parametrize(
    "text, want",
    [
        ('<answer>{"a": 1}</answer>', '{"a": 1}'),
        ('<answer> {"a": 1}', '{"a": 1}'),
        ('<answer>oops</answer> {"b": 2} end', '{"b": 2}'),
        ('x {"a": {"b": 1}} y', '{"a": {"b": 1}}'),
        ("} nothing {", None),
        ("plain", None),
        ("", None),
        (None, None),
        ("<answer>[1, 2]</answer>", "[1, 2]"),
    ],
)
def test_answer_json(spark, text, want):
    assert one(spark, answers.answer_json(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('```{"a": 1}```', '{"a": 1}'),
        ('{"a": 1}', '{"a": 1}'),
        ('Here: {"a":\n 1} ok', '{"a":\n 1}'),
        ("none", None),
    ],
)
def test_fenced_json(spark, text, want):
    assert one(spark, answers.fenced_json(lit(text))) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("<answer>yes</answer>", "yes"),
        ("<answer> Yes </answer>", "Yes"),
        ("<answer>no", "no"),
        ("I think\nYES.", "yes"),
        ("not sure", "no"),
        ("No", "no"),
        ("yes, that is a long text", "no"),
    ],
)
def test_yes_no(spark, text, want):
    assert one(spark, answers.yes_no(lit(text))) == want


@pytest.mark.parametrize(
    "values, want",
    [
        (("3", "High", "x"), None),
        (("more_than_5", " low ", "x"), None),
        (("6", "low", "x"), "estimated_count_invalid"),
        (("2", "sure", "x"), "confidence_invalid"),
        (("2", "low", "  "), "reason_empty"),
        ((None, None, None), "estimated_count_invalid"),
    ],
)
def test_count_error(spark, values, want):
    assert one(spark, answers.count_error(*[F.lit(v).cast("string") for v in values])) == want


def test_parse_click_variants(spark):
    def read(text, pattern=answers.ANSWER_PATTERN):
        df = spark.createDataFrame([(text,)], "t string")
        return answers.with_click(df, "t", pattern).drop("t").first().asDict()

    full = "<ref>lid</ref> Current IOU: 0.50, Positive point: (12, 30), Predicted next IOU: 0.75"
    assert read(full) == {
        "description": "lid", "current_iou": 0.5, "is_positive": True, "x_norm": 12, "y_norm": 30, "next_iou": 0.75
    }
    short = read("ok <ref>a b</ref>  Current IOU: 0.1,Negative point: (1,2)")
    assert short["next_iou"] is None and short["is_positive"] is False and short["y_norm"] == 2
    assert all(v is None for v in read("nothing here").values())
    # the one-click text has its own pattern (D16)
    text = "<ref>lid</ref> Current IOU: 0  Positive point: (5, 6)"
    assert read(text)["x_norm"] is None
    assert read(text, answers.ONE_CLICK_PATTERN)["x_norm"] == 5
    assert one(spark, templates.one_click_text(lit("lid"), lit(True), lit(5), lit(6))) == text


def test_answer_text_reads_back(spark):
    text = templates.answer_text(lit("lid of the pot"), lit(0.0), lit(False), lit(7), lit(1000), lit(0.986))
    assert one(spark, text) == (
        "<ref>lid of the pot</ref> Current IOU: 0.00, Negative point: (7, 1000), Predicted next IOU: 0.99"
    )
    assert one(spark, templates.request_text(lit("x"))).endswith("is as follows: <ref>x</ref>")
    assert one(spark, templates.request_text(lit("x"))).startswith("<image>\nPlease")


@pytest.mark.parametrize(
    "aff, phrase, task, action",
    [
        ("Grasp", "held", "Pick up the cup", "hold"),
        ("Sit", "sat on", "Sit on the cup", "sit on"),
        ("Juggle", "juggleed", "Use the cup", "juggle"),
        ("Look_out", "look_outed", "Use the cup", "look through"),
    ],
)
def test_template_lookup(spark, aff, phrase, task, action):
    assert one(spark, templates.can_phrase(lit(aff))) == phrase
    assert one(spark, templates.task_sentence(lit("cup"), lit(aff))) == task
    assert one(spark, templates.action_of(lit(aff))) == action


def test_fixed_tables_have_their_sizes():
    assert len(templates.CAN_PHRASES) == 18
    assert len(templates.TASK_FALLBACKS) == 18
    assert len(templates.ACTIONS) == 31
    assert len(templates.BAD_TRIPLES) == 71
    assert len(templates.NAME_ALIASES) == 4


@pytest.mark.parametrize(
    "part, text, action, want",
    [
        ("lever", "Flush the toilet", "flush", None),
        ("handle", "Press the toilet handle", "press", "contains_part"),
        ("seat", "Toilet", "", "too_short"),
        ("seat", "toilet " * 17, "", "too_long"),
        ("seat", "Clean inside of toilet", "", "contains_of_pattern"),
        ("seat", "Sit down now", "", "missing_object"),
        ("seat", "Use the toilet", "sit on", "generic_use"),
        ("seat", "Use the toilet", "use", None),
        ("front lid", "Push the toilet up front", "", "contains_part"),
    ],
)
def test_instruction_error(spark, part, text, action, want):
    keys = [names.word_key(lit(v)) for v in ("toilet", part, text, action)]
    assert one(spark, checks.instruction_error(*keys)) == want


def test_instruction_repair(spark):
    def fix(obj, part, aff, action, text):
        df = spark.createDataFrame([(obj, part, aff, action, text)], "object string, part string, affordance string, action string, t string")
        row = checks.with_instruction(df, "t").first()
        return {"ok": row["valid"], "instruction": row["instruction"], "repaired": row["repaired"], "error_msg": row["instruction_error"]}

    kept = fix("toilet", "lever", "Press", "flush", " Flush the  toilet. ")
    assert kept == {"ok": True, "instruction": "Flush the toilet", "repaired": False, "error_msg": None}
    spare = fix("lamp", "switch", "Press", "light  up", "Press the switch of the lamp")
    assert spare["instruction"] == "Light up the lamp" and spare["repaired"]
    lost = fix("lamp", "lamp shade", "Press", "", "Lamp")
    assert lost["error_msg"] == "too_short|fallback:contains_part" and not lost["ok"] and lost["instruction"] is None
    # a repaired instruction is valid when it is checked again
    again = fix("lamp", "switch", "Press", "light  up", spare["instruction"])
    assert again["ok"] and not again["repaired"]


def test_query_repair(spark):
    def fix(q1, q2):
        df = spark.createDataFrame([("mug", "handle", "Grasp", q1, q2)], "object string, part string, affordance string, a string, b string")
        return tuple(checks.with_queries(df, "a", "b").first())[5:]

    canonical = "the handle of the mug that can be held"
    assert fix("Handle of the Mug.", "handle of the mug") == ("Handle of the Mug", canonical, False, True)
    assert fix("mug handle", "A handle of a mug that can be held,") == (
        "handle of the mug", "A handle of a mug that can be held", True, False
    )
    assert fix(None, None) == ("handle of the mug", canonical, True, True)


@pytest.mark.parametrize(
    "original, text, want",
    [
        ("mug", "handle", "handle of the mug"),
        ("mug", "<think>x\ny</think> rim of the mug ", "rim of the mug"),
        ("mug", "<think>only</think>", "mug"),
        ("mug", None, "mug"),
    ],
)
def test_caption_repair(spark, original, text, want):
    assert one(spark, checks.repair_caption(lit(original), F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "caption, part, obj, want",
    [
        ("c", "p", "o", "c"),
        ("", "p", "o", "p of the o"),
        (None, "", "o", "o"),
        ("", "p", None, "p"),
        ("", "", "", "the target object"),
    ],
)
def test_caption_compose(spark, caption, part, obj, want):
    cols = [F.lit(v).cast("string") for v in (caption, part, obj)]
    assert one(spark, templates.compose_caption(*cols)) == want


def test_answers_that_hold_the_group_mark(spark):
    rows = [(f"<ref>{d}</ref> Current IOU: 0.50  Positive point: (12, 34)",) for d in ("the lid", "the\x01lid")] + [("no\x01answer",)]
    got = answers.with_click(spark.createDataFrame(rows, "t string"), "t", answers.ONE_CLICK_PATTERN).collect()
    assert [(r["description"], r["x_norm"], r["is_positive"]) for r in got] == [("the lid", 12, True), ("the\x01lid", 12, True), (None, None, None)]


@pytest.mark.parametrize("fields", [{"object": "cup", "image_path": "a/x.jpg"}, {"object": 'say "hi"\\\n', "image_path": "café 杯 😀"}, {"object": "", "image_path": None}])
def test_uid_is_the_digest_of_spaced_json(spark, fields):
    text = json.dumps(fields, ensure_ascii=False, sort_keys=True)
    cols = {k: F.lit(v).cast("string") for k, v in fields.items()}
    assert one(spark, answers.row_uid(**cols)) == hashlib.md5(text.encode()).hexdigest()


def test_uid_does_not_depend_on_argument_order(spark):
    a = answers.row_uid(object=lit("cup"), image_path=lit("x"))
    b = answers.row_uid(image_path=lit("x"), object=lit("cup"))
    assert one(spark, a) == one(spark, b)
    assert one(spark, a) != one(spark, answers.row_uid(object=lit("cup"), image_path=lit("y")))


@pytest.mark.parametrize("x, d, want", [(0.125, 2, "0.13"), (3.0, 2, "3.00"), (0.000004, 5, "0.00000"), (12.3456, 1, "12.3")])
def test_fixed_text(spark, x, d, want):
    assert one(spark, numbers.fixed(lit(x), d)) == want


def test_boxes(spark):
    f = lambda *v: [lit(float(x)) for x in v]
    there = geometry.xyxy_to_centre(*f(-10, 0, 50, 700), lit(100.0), lit(480.0))
    assert [one(spark, c) for c in there] == [0.25, 0.5, 0.5, 1.0]
    assert [one(spark, c) for c in geometry.xyxy_to_centre(*f(1, 2, 3, 4), lit(0.0), lit(5.0))] == [0.0] * 4
    back = geometry.centre_to_xyxy(*f(0.25, 0.5, 0.5, 1.0), lit(100.0), lit(480.0))
    assert [one(spark, c) for c in back] == [0.0, 0.0, 50.0, 480.0]
    assert [one(spark, c) for c in geometry.crop_fixed(*f(5.9, 30, 90, 470.5), lit(100), lit(480))] == [0, 10, 100, 480]
    ratio = geometry.crop_ratio(*f(10, 10, 12, 60), lit(100), lit(62))
    assert [one(spark, c) for c in ratio] == [9.0, 0.0, 13.0, 62.0]
    assert one(spark, geometry.box_text(f(1, 2.5, 3.456, 4))) == "[1.00,2.50,3.46,4.00]"


def test_clicks_and_scales(spark):
    box = [lit(10), lit(10), lit(20), lit(20)]
    for x, y, inside in [(10, 10, True), (19, 19, True), (20, 10, False), (9, 10, False)]:
        px, py, ok = geometry.into_crop(lit(x), lit(y), box)
        assert one(spark, ok) is inside
        assert (one(spark, px), one(spark, py)) == (x - 10, y - 10)
    assert one(spark, geometry.to_thousand(lit(2), lit(3))) == 666
    assert one(spark, geometry.from_thousand(lit(1000), lit(640))) == 639
    assert one(spark, geometry.from_thousand(lit(-5), lit(640))) == 0


def test_scores(spark):
    e = scoring.eval_score(lit(9), lit(3), lit(-1), lit(0))
    assert one(spark, e) == pytest.approx(0.45 + 0.20)
    assert one(spark, scoring.final_score(lit(5), lit(1.0), lit(0), lit(1.0))) == pytest.approx(1.0)
    # an absent clutter of -1 counts as none
    assert one(spark, scoring.final_score(lit(-1), lit(0.0), lit(-1), lit(0.0))) == pytest.approx(0.15)
    assert [one(spark, scoring.confidence_score(lit(c))) for c in (" High", "medium", "low", "?")] == [1.0, 0.65, 0.35, 0.0]


@pytest.mark.parametrize(
    "n, top, steps",
    [
        (0, 100, (3, 4, 3, 1, 1)),
        (1, 1, (3, 4, 3, 1, 1)),
        (1, 100, (3, 4, 3, 1, 1)),
        (2, 100, (3, 3, 3, 1, 1)),
        (4, 100, (3, 3, 3, 2, 2)),
        (5, 100, (4, 3, 3, 2, 2)),
        (6, 100, (4, 3, 4, 2, 2)),
        (100, 100, (4, 2, 4, 2, 2)),
    ],
)
def test_thresholds(spark, n, top, steps):
    got = scoring.thresholds(lit(n), lit(top))
    row = spark.range(1).select(*[c.alias(k) for k, c in got.items()]).first()
    s = math.log1p(n) / math.log1p(top) if n > 0 and top > 1 else 0.0
    assert tuple(row)[1:6] == steps
    assert (row["strictness"], row["min_target_eval_score"], row["min_final_score"]) == (
        round(s, 6), round(0.45 + 0.25 * s, 6), round(0.52 + 0.23 * s, 6)
    )


@pytest.mark.parametrize(
    "name, aff, n, want",
    [
        ("cup", "grasp", 200, 200),
        ("cup", "grasp", 201, 201),
        ("cup", "grasp", 1000, 539),
        ("hat", "wear", 1000, 296),
        ("hat", "wear", 1, 1),
        ("chair", "sit", 10**6, 1200),
        ("helmet", "wear", 10**5, 300),
        ("cup", "grasp", 0, 0),
    ],
)
def test_class_cap(spark, name, aff, n, want):
    assert one(spark, scoring.class_cap(lit(name), lit(aff), lit(n))) == want


def test_reject_order(spark):
    base = dict(
        bw_yellow_veto=0, image_quality=5, clutter=0, affordance_quality=5, object_visible=3, bbox_quality=3,
        eval_score=1.0, final_score=1.0, min_image_quality=4, max_clutter=2, min_affordance_quality=4,
        min_object_visible=2, min_bbox_quality=2, min_target_eval_score=0.7, min_final_score=0.75,
    )
    worse = [
        ("final_score", 0.1), ("eval_score", 0.1), ("bbox_quality", 0), ("object_visible", 0),
        ("affordance_quality", 0), ("clutter", 9), ("image_quality", 0), ("bw_yellow_veto", 1),
    ]
    seen = []
    for column, value in [(None, None), *worse]:
        if column:
            base[column] = value
        df = spark.createDataFrame([tuple(base.values())], list(base))
        seen.append(df.select(scoring.reject_reason()).first()[0])
    assert seen == ["pass", *reversed(scoring.REJECT_ORDER)]
    assert df.select(scoring.reject_reason(allow_veto=True)).first()[0] == "image_quality"


def test_parsed_reads_what_other_readers_read(spark):
    texts = ['{"a": 1, "a": 2}', '{"a": NaN, "b": -Infinity}', '{"a": 1} x', '{"a": 1} {"b": 2}', "1, 2", '{"a": "x, NaN, y"}', "null", "", None, '{"a": 1']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", F.to_json(answers.parsed(F.col("t"))).alias("v")).collect()}
    want = ['{"a":2}', '{"a":null,"b":null}', None, None, None, '{"a":"x, NaN, y"}', "null", None, None, None]
    assert [got[i] for i in range(len(texts))] == want


def test_valid_json_keeps_the_text(spark):
    df = spark.createDataFrame([('{"a": NaN}',), ('{"a": 1} x',)], "t string")
    got = [r.v for r in df.select(answers.valid_json(F.col("t")).alias("v")).collect()]
    assert sorted(got, key=str) == [None, '{"a": NaN}']
