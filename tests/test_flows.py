"""The flows on small records of their own schemas."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkcurate import flows
from sparkcurate.sources import documents, jsonl

EVAL = "struct<object:string,affordance:string,parts:array<string>,object_visible:int,bbox_quality:int,parts_visibility:int,affordance_quality:int>"
ROUND2 = f"src_file string, src_line long, image_path string, ok boolean, result struct<bw_yellow_veto:int,image_quality:int,clutter:int,evaluations:array<{EVAL}>>"


def ev(obj, aff="Open", parts=("lid",), q=5, v=3, b=3, p=3):
    return (obj, aff, list(parts), v, b, p, q)


def rec(n, image, evals, ok=True, veto=0, iq=5, cl=0):
    return ("r2/object_patch1.jsonl", n, image, ok, (veto, iq, cl, list(evals)))


@pytest.fixture
def round2(spark):
    data = [
        rec(0, "a.jpg", [ev(" Cup "), ev("pot", "Pour", ["rim", "Rim", " "]), ev("cup", "Grasp", ["handle"], q=4)]),
        rec(1, "b.jpg", [ev("bakset"), ev("unknown")]),
        rec(2, "c.jpg", [ev("cup")], veto=1),
        rec(3, "d.jpg", [ev("cup")], iq=1),
        rec(4, "e.jpg", [ev("cup")]),  # six cups: no bucket
        rec(5, "f.jpg", [ev("wine glass")]),  # label is misspelt
        rec(6, "g.jpg", [ev("cup")], ok=False),
        rec(7, "z.jpg", [ev("cup")]),  # no labels at all
    ]
    return spark.createDataFrame(data, ROUND2).repartition(3)


@pytest.fixture
def labels(spark):
    data = [("a.jpg", "cup"), ("a.jpg", "CUP "), ("a.jpg", "pot"), ("b.jpg", "Basket"), ("c.jpg", "cup"), ("d.jpg", "cup"), ("f.jpg", "wine glasss")]
    data += [("e.jpg", "cup")] * 6 + [("other.jpg", "cup")]
    return spark.createDataFrame(data, "image_path string, name string")


@pytest.fixture
def keep(spark, round2, labels):
    allowed = spark.createDataFrame([("cup",), ("Pot",), ("bakset",), ("wine  glass",)], "object string")
    return flows.keep_by_quality(round2, labels, allowed)


def test_keep_by_quality(keep):
    got = {
        (r["image_path"], r["keep_target_object"]): (r["keep_matched_label_name"], r["bucket"], r["keep_is_fuzzy_match"])
        for r in keep.collect()
    }
    assert got == {
        ("a.jpg", "cup"): ("cup", 2, False), ("a.jpg", "pot"): ("pot", 1, False), ("b.jpg", "bakset"): ("basket", 1, False),
        ("f.jpg", "wine glass"): ("wine glasss", 1, True),
    }


def answers_for(spark, items, table):
    rows = [(r["id"], table.get((r["image_path"], r["object"]), "")) for r in items.collect()]
    return spark.createDataFrame(rows, "id string, raw_text string")


@pytest.fixture
def counts(spark, keep):
    items = flows.count_items(keep)
    say = lambda n, conf="high": f'<answer>{{"estimated_count": "{n}", "confidence": "{conf}", "reason": "seen"}}</answer>'
    replies = {("a.jpg", "cup"): say(2), ("a.jpg", "pot"): say(1, "Medium"), ("b.jpg", "bakset"): say(3), ("f.jpg", "wine glass"): "garbage"}
    return flows.count_results(items, answers_for(spark, items, replies))


def test_counting(spark, keep, counts):
    got = {(r["image_path"], r["object"]): (r["ok"], r["error_code"], r["error_msg"]) for r in counts.collect()}
    assert got[("f.jpg", "wine glass")] == (False, 1, "parse_fail")
    assert got[("a.jpg", "cup")] == (True, 0, None)
    ledger = counts.filter("object <> 'pot'").select("id")
    assert [r["object"] for r in flows.count_todo(keep, ledger).collect()] == ["pot"]


def test_adaptive_selection_and_instruction_items(spark, keep, counts):
    got = flows.select_adaptive(keep, counts)
    rows = {r["target_object"]: r for r in got["kept"].collect()}
    # the basket count disagrees, the wine glass has no valid count
    assert set(rows) == {"cup", "pot"}
    # the better of the two cup evaluations
    assert (rows["cup"]["affordance"], rows["cup"]["affordance_quality"], rows["cup"]["confidence"]) == ("open", 5, "high")
    items = flows.instruction_items(got["kept"]).collect()
    assert {(r["bucket_id"], r["object"], r["part"], r["affordance"], r["action"]) for r in items} == {
        ("2", "cup", "lid", "Open", "open"), ("1", "pot", "rim", "Pour", "pour")
    }
    assert {r["source"] for r in items} == {"2/object_patch1.jsonl:1:p0", "1/object_patch1.jsonl:1:p0"}
    assert sorted(r["shard"] for r in items) == [0, 1]


ITEMS = "source string, bucket_id string, image_path string, object string, part string, affordance string, action string"


@pytest.fixture
def feeds(spark):
    data = [
        ("s1", "1", "/p/a.jpg", "cup", "lid", "Open", "open"), ("s2", "1", "/p/a.jpg", "cup", "handle", "Grasp", "hold"),
        ("s3", "2", "b.jpg", "lamp", "switch", "Press", "light up"), ("s4", "2", "b.jpg", "chair", "leg", "sit_on", "sit on"),
        ("s5", "3", "c.jpg", "cup", "lid", "Eat", "eat with"), ("s6", "3", "c.jpg", "jar", "lid", "Open", "open"),
    ]
    items = flows.with_item_id(spark.createDataFrame(data, ITEMS)).withColumns({"src_file": F.lit("f"), "src_line": F.substring("source", 2, 1).cast("long")})
    ids = {r["source"]: r["id"] for r in items.collect()}
    ask = lambda rows: spark.createDataFrame([(ids[s], t) for s, t in rows], "id string, raw_text string")
    q = flows.query_rows(items, ask([
        ("s1", '{"q1": "lid of the cup", "q2": "the lid of the cup that can be opened"}'), ("s2", '{"q1": "cup handle"}'),
        ("s3", "no json"), ("s4", "{}"), ("s5", '{"q1": "lid of the cup"}'), ("s6", "[1]"),
    ]))
    t = flows.task_rows(items, ask([
        ("s1", '<answer>{"instruction": "Open the cup."}</answer>'), ("s3", '{"instruction": "Press the switch"}'),
        ("s4", '{"instruction": "Sit on the chair"}'), ("s5", '{"instruction": "Eat from the cup"}'), ("s6", "nothing"),
    ]))
    return q, t


def test_query_and_task_rows(feeds):
    q = {r["source"]: r for r in feeds[0].collect()}
    assert (q["s1"]["query_direct"], q["s1"]["repaired_q1"], q["s1"]["repaired_q2"]) == ("lid of the cup", False, False)
    assert q["s2"]["query_direct"] == "handle of the cup" and q["s2"]["repaired_q1"]
    assert q["s2"]["query_affordance"] == "the handle of the cup that can be held"
    assert not q["s3"]["ok"] and q["s3"]["error_code"] == 1 and not q["s6"]["ok"]
    t = {r["source"]: r for r in feeds[1].collect()}
    assert (t["s1"]["instruction"], t["s1"]["repaired"]) == ("Open the cup", False)
    assert (t["s3"]["instruction"], t["s3"]["repaired"]) == ("Light up the lamp", True)
    assert not t["s6"]["ok"] and t["s6"]["error_code"] == 1


def test_merge_and_relabel(spark, feeds):
    q, t = feeds
    statuses = Counter(r["status"] for r in flows.merge_feeds(q, t, prefix="/p/").collect())
    # s1 s4 s5 in both, s2 without a task, s3 without a query
    assert statuses == {"both": 3, "no_right": 1, "no_left": 1}
    items = flows.merge_annotations(q, t, prefix="/p/")
    got = {r["source"]: r for r in items.collect()}
    assert set(got) == {"s1", "s2", "s5"}  # a chair leg is no seat
    assert got["s2"]["trps"] == "Pick up the cup" and got["s1"]["image_path"] == "a.jpg"
    out = flows.relabel_annotations(items)
    rows = {r["source"]: r for r in out["items"].collect()}
    assert (rows["s5"]["affordance"], rows["s5"]["trps"], rows["s5"]["action"]) == ("Open", "Open the cup", "open")
    report = out["report"].collect()
    assert [(r["from_label"], r["to_label"], r["outcome"], r["n"], r["example"]) for r in report] == [("Eat", "Open", "remap", 1, "s5")]
    pages = flows.part_lists(out["items"]).orderBy("bucket_id").collect()
    assert [(p["bucket_id"], p["image_path"], [x["part"] for x in p["part_list"]]) for p in pages] == [
        ("1", "a.jpg", ["handle", "lid"]), ("3", "c.jpg", ["lid"])
    ]
    assert pages[1]["part_list"][0]["instruction"]["trps"] == "Open the cup"
    cats = flows.catalogs(out["items"])
    assert cats["lines"].count() == 2
    assert cats["affordances"].filter("object IS NULL AND affordance = 'Open'").first()["item_count"] == 2


def test_only_the_last_row_of_a_key_counts(spark, feeds):
    q, t = feeds
    again = q.filter("source = 's1'").withColumns({"query_direct": F.lit("new lid of the cup"), "src_line": F.lit(99).cast("long")})
    got = {r["source"]: r["orps"] for r in flows.merge_annotations(q.unionByName(again), t).collect()}
    assert got["s1"] == "new lid of the cup"


def test_relabel_drops_repeats_within_an_image(spark, feeds):
    items = flows.merge_annotations(*feeds)
    twice = items.unionByName(items.withColumn("affordance", F.upper("affordance")))
    assert flows.relabel_annotations(twice)["items"].count() == flows.relabel_annotations(items)["items"].count()


def test_image_labels_to_candidates(spark):
    coco = {
        "categories": [{"id": 1, "name": "cup"}, {"id": 4, "name": "pot"}],
        "images": [{"id": 10, "file_name": "p1/a.jpg", "width": 100, "height": 200}, {"id": 11, "file_name": "p1/b.jpg", "width": 10, "height": 10}],
        "annotations": [
            {"image_id": 10, "category_id": 1, "bbox": [0, 0, 10, 20]}, {"image_id": 10, "category_id": 1, "bbox": [50, 50, 40, 40]},
            {"image_id": 10, "category_id": 4, "bbox": [90, 190, 50, 50]}, {"image_id": 10, "category_id": 9, "bbox": [0, 0, 1, 1]},
        ],
    }
    doc = spark.createDataFrame([(json.dumps(coco),)], "t string").select(F.from_json("t", documents.COCO_SCHEMA).alias("d")).select("d.*")
    replies = spark.createDataFrame([("/x/a.jpg", "<answer>yes</answer>"), ("/x/b.jpg", "No"), ("/x/a.jpg", "YES")], "image_path string, raw_text string")
    labels = flows.image_labels(flows.verdicts(replies), doc)
    rows = sorted((r["cid"], round(r["cx"], 4), round(r["bw"], 4), r["match_how"]) for r in labels.collect())
    assert rows == [(0, 0.05, 0.1, "basename_unique"), (0, 0.7, 0.4, "basename_unique"), (1, 0.95, 0.1, "basename_unique")]
    lines = {tuple(r) for r in flows.label_files(labels).collect()}
    assert ("a", "0 0.05000 0.05000 0.10000 0.10000") in lines
    sel = "struct<selected:array<struct<object:string,affordance:string,parts:array<string>>>>"
    round1 = spark.createDataFrame(
        [("f", 0, "/x/a.jpg", True, ([("cup", "Grasp", ["rim"]), ("jar", "Open", [])],)), ("f", 1, "/x/c.jpg", False, None)],
        f"src_file string, src_line long, image_path string, ok boolean, result {sel}",
    )
    inst = flows.selected_instances(round1, labels)
    assert {(r["object"], r["instance"]) for r in inst.collect()} == {
        ("cup", "cup [50.00,50.00,90.00,90.00]"), ("cup", "cup [0.00,0.00,10.00,20.00]"), ("jar", None)
    }
    block = flows.quality_candidates(inst).first()
    assert (block["cand_count"], block["width"]) == (2, 100)
    assert block["labels_text"].split("\n")[0] == "cup; bbox [50.00,50.00,90.00,90.00]; affordance Grasp; parts rim;"
    assert flows.quality_candidates(inst, 1).first()["cand_count"] == 1


def trajectory(image, caption, ious, **ann):
    clicks = [{"idx": i, "coor": [10 * i, 20 * i], "is_positive": i % 2 == 0, "iou": v} for i, v in enumerate(ious)]
    return {"image_name": image, "height": 100, "width": 200, "gt_ann": {"caption": caption, **ann}, "clicks_list": clicks}


def test_training_records_and_checks(spark, tmp_path):
    docs = {"data": [
        trajectory("crops/x.jpg", "lid of the pot", [0.4, 0.6, 0.8], inst_key="k1", bbox=[1, 2, 3, 4], area=9),
        trajectory("crops/y.jpg", "rim of the cup", [0.9, 0.2]), trajectory("crops/z.jpg", "cap", [0.7]),
    ]}
    (tmp_path / "t.json").write_text(json.dumps(docs))
    items = flows.good_trajectories(documents.trajectories(spark, str(tmp_path)))
    assert {r["image_name"] for r in items.collect()} == {"crops/x.jpg", "crops/z.jpg"}
    records = flows.training_records(items, "over")
    got = {(r["image_name"], r["step"]): r for r in records.collect()}
    last = got["crops/x.jpg", 2]
    assert last["images"] == ["over/x__k1__step2.jpg"] and last["overlay_of"] == 1
    assert last["messages"][1]["content"] == "<ref>lid of the pot</ref> Current IOU: 0.60, Positive point: (200, 200), Predicted next IOU: 0.80"
    first = got["crops/x.jpg", 0]
    assert first["images"] == ["crops/x.jpg"] and "Current IOU: 0.00" in first["messages"][1]["content"]
    stock = spark.createDataFrame([("crops/x.jpg",), ("over/x__k1__step1.jpg",), ("crops/z.jpg",)], "path string")
    done = flows.check_records(records, stock)
    errors = {(r["image_name"], r["step"]): r["errors"] for r in done["errors"].collect()}
    assert errors["crops/x.jpg", 2] == ["image_not_found"] and sum(map(len, errors.values())) == 1
    assert sum(r["n"] for r in done["profile"].collect()) == 3


def test_one_click_records(spark):
    schema = "image_path string, inst_key string, bbox array<double>, instruction struct<orps:string>, click_sequence array<struct<x:int,y:int,type:string>>"
    inst = spark.createDataFrame([
        ("d/a.jpg", "i1", [10.0, 10.0, 30.0, 20.0], ("lid of the pot",), [(12, 15, "positive")]),
        ("d/a.jpg", "i2", [10.0, 10.0, 30.0, 20.0], None, [(90, 90, "negative")]),
    ], schema)
    sizes = spark.createDataFrame([("d/a.jpg", 100, 100)], "image_path string, width int, height int")
    rows = flows.one_click_records(inst, sizes, "crops").collect()
    assert len(rows) == 1 and rows[0]["images"] == ["crops/a__i1.jpg"]
    assert rows[0]["messages"][1]["content"] == "<ref>lid of the pot</ref> Current IOU: 0  Positive point: (6, 7)"


def test_evaluation_manifest_and_scores(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([
        trajectory("o1/1.jpg", "Lid of the pot", [0.5, 0.9], bbox=[1, 2, 3, 4], area=7), trajectory("o1/1.jpg", "lid of the pot", [0.4]),
    ]))
    traj = documents.trajectories(spark, str(tmp_path)).withColumns({"src_file": F.col("source_file"), "src_line": F.monotonically_increasing_id()})
    lines = []
    for path, text in [("o1/1.jpg", "Lid of the pot"), ("o1/1.jpg", "lid of the pot"), ("o1/1__step1.jpg", "x"), ("o2/1.jpg", "cap"), ("o1/1.jpg", "gone"), ("o3/9.jpg", "no release")]:
        lines.append(json.dumps({"messages": [{"role": "user", "content": f"<image> <ref>{text}</ref>"}], "images": [path]}))
    (tmp_path / "val.jsonl").write_text("\n".join(lines + lines[:1]))
    schema = "messages array<struct<role:string,content:string>>, images array<string>"
    records = jsonl.typed(jsonl.read_lines(spark, str(tmp_path), "*.jsonl"), schema)
    entries = spark.createDataFrame([("o1/1.jpg", "m1"), ("o2/1.jpg", "m2"), ("o3/9.jpg", "m3")], "path string, md5 string")
    release = spark.createDataFrame([("1.jpg", "m1")], "base string, md5 string")
    got = flows.evaluation_manifest(records, entries, release, traj)
    rows = {r["description"]: r["gt_mask_path"] for r in got["manifest"].collect()}
    # one slug, two descriptions: the second gets a suffix
    assert rows == {"Lid of the pot": "gt_mask/1/lid_of_the_pot.png", "lid of the pot": "gt_mask/1/lid_of_the_pot__2.png"}
    assert [r["description"] for r in got["missing"].collect()] == ["gone"]

    steps = spark.createDataFrame(
        [("a", "d", 0, 0.4, 4, 10), ("a", "d", 1, 0.8, 8, 10), ("a", "d", 2, 0.7, 7, 10), ("b", "d", 0, 0.2, 1, 5)],
        "image_name string, description string, step long, iou double, inter long, union long",
    )
    out = flows.score_run(steps)
    case = out["cases"].filter("image_name = 'a'").first()
    assert (case["best_step"], case["num_steps"], case["final_iou"], case["success_at_50"], case["step0_success_at_50"]) == (1, 3, 0.7, True, False)
    m = out["metrics"].first()
    assert m["best_giou"] == pytest.approx(50.0) and m["best_ciou"] == pytest.approx(60.0) and m["refinement_gain"] == pytest.approx(20.0)
