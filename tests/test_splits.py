"""JSON documents read in byte ranges against whole reads."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkcurate.sources import documents, splits

ODD = ['a "quoted" } b', "back\\slash \\\\", "{[", "]}", ",", "line\nbreak", "é😀", '\\"', "", '"', "x" * 300]


def _sample(rnd, i):
    return {
        "media": {"media_path": f"v2/{i}/{rnd.choice(ODD)}.jpg", "tags": [rnd.choice(ODD) for _ in range(rnd.randint(0, 3))]},
        "annotations": [{"category_id": rnd.randint(0, 9), "bbox": [rnd.random() for _ in range(4)]} for _ in range(rnd.randint(0, 4))],
        "nested": {"deep": [[{"k": [rnd.choice(ODD)]}], []], "n": None},
    }


@pytest.fixture
def ranges(spark):
    """Small byte ranges."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(size))

    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


def _got(spark, path):
    rows = splits.elements(spark, str(path)).collect()
    return sorted((r.file.rsplit("/", 1)[1], r.key or "", r.idx, json.dumps(json.loads(r.value), sort_keys=True)) for r in rows)


def _want(name, doc):
    arrays = {"": doc} if isinstance(doc, list) else {k: v for k, v in doc.items() if isinstance(v, list)}
    return [(name, k, i, json.dumps(x, sort_keys=True)) for k, v in arrays.items() for i, x in enumerate(v)]


@pytest.mark.parametrize("size", [150, 5000, 1 << 20])
def test_elements_of_any_document(spark, tmp_path, ranges, size):
    rnd = random.Random(size)
    some = [_sample(rnd, i) for i in range(40)]
    docs = {
        "coco.json": {"info": {"a": [1, {"b": "]"}], "c": "}"}, "categories": some[:5], "images": [], "n": 3, "annotations": some[5:30], "tail": "x,[y"},
        "list.json": some[30:],
        "plain.json": {"numbers": [1, 2.5, "a,b", None, True, [1, [2]], {"x": 1}]},
        "empty.json": {},
        "none.json": [],
    }
    for i, (name, doc) in enumerate(docs.items()):
        (tmp_path / name).write_text(json.dumps(doc, indent=2 if i % 2 else None, ensure_ascii=i % 3 == 0))
    ranges(size)
    assert _got(spark, tmp_path) == sorted(x for name, doc in docs.items() for x in _want(name, doc))


@pytest.mark.parametrize("cut", [5, 60, 1200, 2500, -1, -2, -30])
def test_broken_tail_keeps_complete_elements(spark, tmp_path, ranges, cut):
    rnd = random.Random(1)
    doc = {"samples": [_sample(rnd, i) for i in range(12)]}
    text = json.dumps(doc, ensure_ascii=True)[:cut]
    (tmp_path / "cut.json").write_text(text)
    ranges(200)
    got, want = _got(spark, tmp_path), _want("cut.json", doc)
    assert got == sorted(want[: len(got)])
    # an element is complete once its comma or its array's bracket has been read
    ends, at = [], len('{"samples": [')
    for x in doc["samples"]:
        at += len(json.dumps(x))
        ends.append(at)
        at += 2
    assert len(got) == sum(e < len(text) for e in ends)


def test_many_tasks_read_one_file(spark, tmp_path, ranges):
    rnd = random.Random(2)
    doc = {"samples": [_sample(rnd, i) for i in range(6000)]}
    path = tmp_path / "train.json"
    path.write_text(json.dumps(doc))
    ranges(64 << 10)
    lines = spark.read.option("lineSep", "}").text(str(path))
    assert lines.rdd.getNumPartitions() >= 16
    got = splits.read_array(spark, str(path), "samples", documents.SAMPLE)
    whole = documents.read_document(spark, str(path), documents.SAMPLES_SCHEMA).select(F.posexplode("samples").alias("idx", "s")).select("idx", "s.*")
    assert got.count() == 6000
    assert got.drop("file").exceptAll(whole.withColumn("idx", F.col("idx").cast("long"))).count() == 0
    rows = documents.read_detection_samples(spark, str(path), "v2/")
    assert rows.count() == sum(len(s["annotations"]) for s in doc["samples"])


def test_coco_tables_of_a_document_on_disk(spark, tmp_path, ranges):
    doc = {
        "categories": [{"id": 7, "name": "cup, \"red\""}, {"id": 2, "name": "mug"}],
        "images": [{"id": i, "file_name": f"{i}.jpg", "width": 4, "height": 5, "x": [1]} for i in range(50)],
        "annotations": [{"image_id": i, "category_id": 7, "bbox": [1, 2, 3, 4.5]} for i in range(50)],
    }
    path = tmp_path / "coco.json"
    path.write_text(json.dumps(doc))
    ranges(300)
    got = documents.read_coco_tables(spark, str(path))
    want = documents.coco_tables(documents.read_document(spark, str(path), documents.COCO_SCHEMA))
    for key, table in want.items():
        assert sorted(map(tuple, got[key].drop("file").collect())) == sorted(map(tuple, table.collect())), key


def test_elements_are_not_shuffled_to_meet_their_array(spark, tmp_path, ranges):
    rnd = random.Random(3)
    (tmp_path / "train.json").write_text(json.dumps({"samples": [_sample(rnd, i) for i in range(3000)]}))
    ranges(64 << 10)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(48 << 10))  # below the elements' size
    try:
        got = splits.read_array(spark, str(tmp_path), "samples", documents.SAMPLE)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        assert [r.idx for r in got.orderBy("idx").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bytes_that_are_no_text_do_not_move_elements(spark, tmp_path):
    (tmp_path / "odd.json").write_bytes(b'{"a": ["\xff", "b", {"c": "\xc3"}, "d"]}')
    got = splits.elements(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r.value.strip() for r in got] == ['"�"', '"b"', '{"c": "�"}', '"d"']
