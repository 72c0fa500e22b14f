"""Files in, files out, and incremental ingest."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkcurate import session
from sparkcurate.functions import answers, checks, templates
from sparkcurate.sources import documents, jsonl, sinks
from sparkcurate.streaming import ingest


def test_line_numbers_survive_splits(spark, tmp_path):
    rng = random.Random(2)
    texts = {}
    for name in ("a.jsonl", "b.jsonl"):
        texts[name] = [f"{name} {i} " + "x" * rng.randrange(80) for i in range(500)] + ["", "last"]
        (tmp_path / name).write_text("\n".join(texts[name]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path), "*.jsonl")
        assert lines.rdd.getNumPartitions() >= 1
        got = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    have = {(r["src_file"].rsplit("/", 1)[-1], r["src_line"]): r["value"] for r in got}
    assert have == {(n, i): t for n, ts in texts.items() for i, t in enumerate(ts)}


def test_lenient_scan_and_audit(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(
        "\n".join(
            ['{"image_path": "a", "k": 1}', "", "  ", "{bad", "[1]", '"text"', '{"image_path": "a", "k": "oops"}', '{"image_path": "", "k": 3}', '{"k": 4}', "null"]
        )
    )
    lines = jsonl.read_lines(spark, str(tmp_path))
    got = jsonl.typed(lines, "image_path string, k long").orderBy("src_line").collect()
    assert [(r["src_line"], r["image_path"], r["k"]) for r in got] == [(0, "a", 1), (6, "a", None), (7, "", 3), (8, None, 4)]
    key = answers.field(F.col("value"), "image_path")
    audit = jsonl.scan_audit(lines, key).first()
    assert tuple(audit) == (8, 6, 1)
    last = jsonl.last_by_key(lines, key, [F.col("src_line").desc()]).collect()
    assert [json.loads(r["value"])["k"] for r in last] == ["oops"]


def test_typed_scan_reads_broken_lines_from_disk(spark, tmp_path):
    good = [json.dumps({"image_path": f"i{i}", "tasks": ["a"] * (i % 3)}) for i in range(50)]
    (tmp_path / "x.jsonl").write_text("\n".join(good[:25] + ["{broken", ""] + good[25:]))
    rows = documents.pool_rows(jsonl.typed(jsonl.read_lines(spark, str(tmp_path)), documents.POOL_SCHEMA), "/d/pool")
    assert rows.count() == 50
    first = rows.orderBy("src_line").first()
    assert first["image"] == "/d/pool/i0" and first["instructions"] == [] and first["instance_masks"] == []


def test_file_inventory_and_patch_range(spark, tmp_path):
    for name in ("a/x.JPG", "a/b/y.png", "c.txt", "patch3/z.jpg"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    files = jsonl.file_inventory(spark, str(tmp_path), [".jpg", ".png"], hashes=True)
    import hashlib

    got = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["sha256"]) for r in files.collect()}
    assert got == {n.rsplit("/", 1)[-1]: (len(n), hashlib.sha256(n.encode()).hexdigest()) for n in ("a/x.JPG", "a/b/y.png", "patch3/z.jpg")}
    assert jsonl.patch_files(files, F.col("path"), 1, 5).count() == 1
    assert "content" not in jsonl.file_inventory(spark, str(tmp_path), [".jpg"]).columns


def test_coco_document_from_disk(spark, tmp_path):
    doc = {
        "categories": [{"id": 5, "name": "cup"}, {"id": 2, "name": "pot"}],
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}],
        "annotations": [{"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}, {"image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1]}],
    }
    path = tmp_path / "coco.json"
    path.write_text(json.dumps(doc, indent=1))
    t = documents.coco_tables(documents.read_document(spark, str(path), documents.COCO_SCHEMA))
    cats = t["categories"].withColumnRenamed("id", "category_id")
    rows = t["annotations"].join(cats, "category_id").collect()
    assert [(r["cid"], r["name"], r["bbox"]) for r in rows] == [(1, "pot", [1.0, 2.0, 3.0, 4.0])]


def test_trajectory_documents(spark, tmp_path):
    item = {"image_name": "i", "height": 4, "width": 5, "gt_ann": {"caption": "c"}, "clicks_list": [{"idx": 0, "coor": [1, 2], "is_positive": True, "iou": 0.5}]}
    (tmp_path / "a.json").write_text(json.dumps({"info": {}, "data": [item, {**item, "gt_ann": {"caption": ""}}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([item, item]))
    (tmp_path / "c.json").write_text("{broken")
    got = documents.trajectories(spark, str(tmp_path)).collect()
    assert sorted(r["source_file"] for r in got) == ["a.json", "b.json", "b.json"]
    assert got[0]["clicks_list"][0]["iou"] == 0.5


def test_eval_rows_take_text_and_numbers(spark):
    cols = "image_path string, description string, gt_mask_path string, gt_bbox string, height string, width int"
    df = spark.createDataFrame([("a.jpg", "d", "m.png", "[1600.0, 371.0, 274.0, 190.0]", "1500", 640), ("b.jpg", "d", "m", "none", "tall", 5)], cols)
    rows = {r["image"]: r for r in documents.eval_rows(df, "eval/").collect()}
    assert rows["eval/a.jpg"]["gt_bbox"] == [1600.0, 371.0, 274.0, 190.0] and rows["eval/a.jpg"]["height"] == 1500
    assert rows["eval/b.jpg"]["gt_bbox"] is None and rows["eval/b.jpg"]["height"] is None


def test_bucket_sink_replaces_its_output(spark, tmp_path):
    out = str(tmp_path / "keep")
    sinks.write_buckets(spark.createDataFrame([("1", "a"), ("2", "b")], "bucket string, v string"), out, ["bucket"])
    sinks.write_buckets(spark.createDataFrame([("2", "c")], "bucket string, v string"), out, ["bucket"])
    back = spark.read.json(out).collect()
    assert [(str(r["bucket"]), r["v"]) for r in back] == [("2", "c")]


def test_report_and_line_sinks(spark, tmp_path):
    df = spark.createDataFrame([("cup", ["a", "b"], 2)], "object string, parts array<string>, n int")
    sinks.write_report(df, str(tmp_path / "csv"))
    row = spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()
    assert row["parts"] == "a | b" and row["n"] == "2"
    lines = spark.createDataFrame([("s1", "0 1"), ("s1", "1 2"), ("s2", "0 3")], "stem string, line string")
    sinks.write_lines(lines, str(tmp_path / "txt"), "line", "stem")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "txt/stem=s1")).collect()) == ["0 1", "1 2"]


def test_ingest_is_idempotent_across_runs(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batch = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "uid long, text string").coalesce(1)
    read = lambda: spark.readStream.schema("uid long, text string").parquet(src)
    batch([1, 2, 2]).write.mode("append").parquet(src)
    ingest.ingest(read(), sink, state, "uid", ["text"])
    batch([2, 3]).write.mode("append").parquet(src)
    ingest.ingest(read(), sink, state, "uid", ["text"])
    # a lost checkpoint replays everything; the sink is its own ledger
    ingest.ingest(read(), sink, state + "2", "uid", ["text"])
    assert sorted(r["uid"] for r in ingest.handled(spark, sink).collect()) == [1, 2, 3]


def test_ingest_cost_follows_the_batch(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, first = "uid long, place int, text string", {}
    for n in range(20):
        # forty new ids, ten of the last batch, each twice with the better place second; one null id
        ids = [i for i in range(n * 40 - 10, n * 40 + 40) if i >= 0]
        rows = [(i, p, f"{n}-{p}") for p in (1, 0) for i in ids] + [(None, 0, f"{n}")]
        for i, p, t in rows:
            if i not in first or first[i][0] > p and first[i][1].split("-")[0] == str(n):
                first[i] = (p, t)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen = [p for p in ingest.ingest(stream, sink, state, "uid", ["place"]) if p["numInputRows"]]
    back = [(r["uid"], (r["place"], r["text"])) for r in ingest.handled(spark, sink).collect()]
    assert len(back) == 801 and dict(back) == first
    stores = [p["stateOperators"][0] for p in seen]
    assert [s["numRowsUpdated"] for s in stores] == [41] + [51] * 19
    read = [s["customMetrics"]["rocksdbTotalBytesRead"] for s in stores]
    assert max(read[1:]) <= 2 * min(read[1:])


def test_a_replayed_batch_replaces_its_folder(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    read = lambda: spark.readStream.schema("uid long").parquet(src)
    spark.createDataFrame([(1,), (2,)], "uid long").write.parquet(src)
    ingest.ingest(read(), sink, state, "uid", ["uid"])
    for mark in (tmp_path / "state/commits").glob("*0*"):  # as if the driver died before the commit
        mark.unlink()
    ingest.ingest(read(), sink, state, "uid", ["uid"])
    assert sorted(r["uid"] for r in ingest.handled(spark, sink).collect()) == [1, 2]


def test_stream_dedupe_without_event_time(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1,), (1,), (2,)], "uid long").write.parquet(src)
    stream = spark.readStream.schema("uid long").parquet(src)
    ingest.write_append(ingest.drop_repeats(stream, "uid"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["uid"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_work_root_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert session.new_path(spark, "x").startswith(root)
    cut = session.materialise(spark.range(5), "t")
    assert cut.inputFiles()[0].replace("file://", "").startswith(root)


def test_chat_record_rules(spark):
    request = templates.request_text(F.lit("lid of the pot"))
    answer = templates.answer_text(F.lit("lid of the pot"), F.lit(0.5), F.lit(True), F.lit(412), F.lit(530), F.lit(0.97))
    good = spark.range(1).select(*templates.chat_record(request, answer, F.lit("a.jpg")))
    messages, images = good.first()
    user, reply = messages[0]["content"], messages[1]["content"]
    pair = lambda u, a: [{"role": "user", "content": u}, {"role": "assistant", "content": a}]
    cases = [
        (pair(user, reply), ["a.jpg"], True, []),
        (pair(user, reply)[:1], ["a.jpg"], True, ["message_count"]),
        (pair(user, reply) + pair(user, reply)[:1], ["a.jpg"], True, ["message_count"]),
        (pair(user, reply), ["a.jpg", "b.jpg"], True, ["image_count"]),
        (pair(user, reply), ["a.jpg"], False, ["image_not_found"]),
        (pair(user.replace("<image>", ""), reply), ["a.jpg"], True, ["no_image_tag"]),
        (pair("<image> <ref> </ref>", reply), ["a.jpg"], True, ["empty_description"]),
        (pair("<image>", reply), ["a.jpg"], True, ["no_user_ref"]),
        (pair(user.replace("pot", "cup"), reply), ["a.jpg"], True, ["description_mismatch"]),
        (pair(user, reply.replace("0.50", "1.20")), ["a.jpg"], True, ["current_iou_out_of_range"]),
        (pair(user, reply.replace("0.97", "1.1")), ["a.jpg"], True, ["next_iou_out_of_range"]),
        (pair(user, reply.replace("0.50", "0.5.0")), ["a.jpg"], True, ["invalid_current_iou"]),
        (pair(user, reply.replace("412", "1001")), ["a.jpg"], True, ["coordinate_range"]),
        (pair(user, "Sure " + reply), ["a.jpg"], True, ["bad_answer"]),
        (None, ["a.jpg"], True, ["missing_key"]),
        (pair(user, reply), None, True, ["missing_key"]),
    ]
    schema = "messages array<struct<role:string,content:string>>, images array<string>, there boolean, n int"
    df = spark.createDataFrame([(m, i, t, n) for n, (m, i, t, _) in enumerate(cases)], schema)
    got = {r["n"]: r["errors"] for r in checks.with_chat_errors(df, "there").collect()}
    assert got == {n: c[3] for n, c in enumerate(cases)}


def test_row_slice_of_few_and_of_all(spark, monkeypatch):
    rows = spark.createDataFrame([(n * 7 % 50,) for n in range(50)], "n long").repartition(6)
    want = [(n, n) for n in range(10, 30)]
    for few in (sinks.FEW, 5):
        monkeypatch.setattr(sinks, "FEW", few)
        assert sorted(tuple(r) for r in sinks.row_slice(rows, [F.col("n")], 10, 30).collect()) == want
    assert sinks.row_slice(rows, [F.col("n")], 45, 99).count() == 5
    assert sinks.row_slice(rows, [F.col("n")], 0, 0).count() == 0


def test_label_files_keep_the_order(spark, tmp_path):
    boxes = spark.createDataFrame([(f"s{n % 2}", n, f"{n} 0.5") for n in range(20)], "stem string, at long, line string").repartition(7)
    files = sorted(tuple(r) for r in sinks.label_files(boxes, "stem", "line", [F.col("at")], page_size=6).collect())
    assert [(s, p) for s, p, _ in files] == [("s0", 0), ("s0", 1), ("s1", 0), ("s1", 1)]
    assert files[1][2] == "12 0.5\n14 0.5\n16 0.5\n18 0.5\n"
    sinks.write_lines(boxes, str(tmp_path / "out"), "line", "stem", [F.col("at")])
    for s in (0, 1):
        parts = sorted((tmp_path / "out" / f"stem=s{s}").glob("part-*"))
        assert "".join(p.read_text() for p in parts) == "".join(f"{n} 0.5\n" for n in range(s, 20, 2))


def test_detection_samples_are_read_from_documents(spark, tmp_path):
    note = {"category_id": 7, "bbox": [1.0, 2.0, 3.0, 4.0]}
    samples = [{"media": {"media_path": f"train/objects365_v{v}_0{v}.jpg"}, "annotations": [note, {**note, "category_id": 8}]} for v in (1, 2)]
    (tmp_path / "train.json").write_text(json.dumps({"samples": samples, "more": 1}, indent=1))
    got = sorted(tuple(r) for r in documents.read_detection_samples(spark, str(tmp_path / "train.json")).collect())
    assert got == [("objects365_v2_02", c, 1.0, 2.0, 4.0, 6.0) for c in (7, 8)]


def test_chunk_files_hold_exact_rows(spark, tmp_path):
    rows = spark.range(103).withColumn("v", F.concat(F.lit("é\n"), F.col("id").cast("string"))).repartition(7)
    made = sinks.chunks(rows, [F.col("id")], 20).select("id", "v", "chunk")
    path = str(tmp_path / "out")
    sinks.write_parts(made, path, "chunk", one_file=True)
    back = sinks.read_parts(spark, path, made.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, made.collect()))
    folders = sorted((tmp_path / "out" / "rows").glob("chunk=*"))
    assert [sum(len(p.read_text().splitlines()) for p in d.glob("*.json")) for d in folders] == [20] * 5 + [3]
    assert all(len(list(d.glob("*.json"))) == 1 for d in folders)
    assert {r["chunk"]: r["rows"] for r in spark.read.json(f"{path}/manifest").collect()} == {**{i: 20 for i in range(5)}, 5: 3}


def test_uncommitted_output_is_not_read(spark, tmp_path):
    made = spark.createDataFrame([(1, 2)], "id int, chunk int")
    made.write.partitionBy("chunk").json(str(tmp_path / "rows"))
    with pytest.raises(FileNotFoundError):
        sinks.read_parts(spark, str(tmp_path), made.schema)
