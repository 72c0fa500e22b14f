"""The curation, training-record and evaluation flows on their own record schemas.

Every function takes and returns DataFrames; model calls are left outside, as a table of
items to ask about and a table of raw responses. Line-oriented inputs carry ``src_file``
and ``src_line`` (see ``sources.jsonl``), which break every tie. Record schemas are in
``FIXTURES.md``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions import answers, checks, geometry, names, paths, scoring, templates
from sparkcurate.operators import gates, match, metrics, ranking, regroup, select, sequence
from sparkcurate.session import materialise
from sparkcurate.sources import documents, sinks

LINE = ["src_file", "src_line"]


def _text(c: str | Column) -> Column:
    return names.clean(F.col(c) if isinstance(c, str) else c)


# -- images to curated annotations -------------------------------------------


def verdicts(responses: DataFrame) -> DataFrame:
    """Images whose answer is exactly ``yes``. Input: ``image_path, raw_text``."""
    return responses.filter(answers.yes_no(F.col("raw_text")) == "yes").select("image_path").distinct()


def image_labels(yes: DataFrame, coco: DataFrame, mode: str = "auto") -> DataFrame:
    """One row per label of each wanted image, centre-normalised. ``yes`` holds
    ``image_path``; ``coco`` is one detection document. Unknown categories drop out."""
    tables = documents.coco_tables(coco)
    images = tables["images"].withColumnRenamed("id", "image_id")
    catalog = images.select("file_name", F.col("image_id").alias("ord"))
    found = match.resolve_entity(yes.select(F.col("image_path").alias("path")), catalog, mode)
    found = found.filter(F.col("file_name").isNotNull()).withColumnRenamed("path", "image_path")
    sized = found.join(images, "file_name").withColumnRenamed("file_name", "coco_file_name")
    classes = tables["categories"].withColumnRenamed("id", "category_id")
    labels = tables["annotations"].join(sized, "image_id").join(classes, "category_id")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    box = geometry.xyxy_to_centre(*geometry.xywh_to_xyxy(x, y, w, h), F.col("width"), F.col("height"))
    return labels.select(
        "image_path", "coco_file_name", "image_id", "width", "height", "match_how", "cid", "name",
        *[c.alias(n) for n, c in zip(("cx", "cy", "bw", "bh"), box)], (box[2] * box[3]).alias("area"),
    )


def label_files(labels: DataFrame) -> DataFrame:
    """Lines of the per-image label files."""
    stem = paths.stem(F.coalesce(F.nullif("coco_file_name", F.lit("")), F.col("image_path")))
    box = [F.col(c) for c in ("cx", "cy", "bw", "bh")]
    return labels.select(stem.alias("stem"), geometry.label_line(F.col("cid"), box).alias("line"))


def selected_instances(round1: DataFrame, labels: DataFrame) -> DataFrame:
    """Round-1 selections with the boxes of the instances of the same name, largest
    first. Rows without a match keep null boxes, as the record passes through."""
    picked = (
        round1.filter(F.coalesce("ok", F.lit(False)))
        .select(*LINE, "image_path", F.posexplode("result.selected").alias("sel", "s"))
        .select(*LINE, "image_path", "sel", _text("s.object").alias("object"), _text("s.affordance").alias("affordance"), "s.parts")
    )
    box = geometry.centre_to_xyxy(*[F.col(c) for c in ("cx", "cy", "bw", "bh")], F.col("width"), F.col("height"))
    boxes = labels.select(
        "image_path", F.btrim("name").alias("object"), "width", "height", "area", F.array(*box).alias("xyxy"),
        F.concat(F.btrim("name"), F.lit(" "), geometry.box_text(box)).alias("instance"),
    )
    return picked.join(boxes, ["image_path", "object"], "left")


def quality_candidates(instances: DataFrame, max_candidates: int = 24) -> DataFrame:
    """Candidate text per image over its first candidates in nested order."""
    sized = instances.filter((F.col("width") > 0) & (F.col("height") > 0) & (F.col("object") != "") & (F.col("affordance") != ""))
    order = [F.col(c).asc() for c in (*LINE, "sel")] + [F.col("area").desc(), F.col("xyxy")]
    top = ranking.top_per_key(sized, ["image_path"], order, max_candidates, "_n")
    parts = F.when(F.coalesce(F.size("parts"), F.lit(0)) == 0, "whole_object").otherwise(F.array_join("parts", ", "))
    line = F.concat(
        "object", F.lit("; bbox "), geometry.box_text([F.col("xyxy")[i] for i in range(4)]), F.lit("; affordance "),
        "affordance", F.lit("; parts "), parts, F.lit(";"),
    )
    block = top.groupBy("image_path").agg(
        F.max("width").alias("width"), F.max("height").alias("height"), F.count(F.lit(1)).alias("cand_count"),
        F.array_sort(F.collect_list(F.struct("_n", line.alias("t")))).alias("_l"),
    )
    return block.withColumn("labels_text", F.array_join(F.col("_l")["t"], "\n")).drop("_l")


def keep_by_quality(
    round2: DataFrame, labels: DataFrame, allowed: DataFrame, cutoff: float = 0.9, min_quality: int = 2, max_clutter: int = 4
) -> DataFrame:
    """Quality-gated records, one per allowed object whose label occurs 1 to 5 times on
    the image; ``bucket`` is that count. ``labels`` carries ``image_path, name``."""
    r = F.col("result")
    passed = round2.filter(
        F.coalesce("ok", F.lit(False))
        & gates.image_gate(r["bw_yellow_veto"], r["image_quality"], r["clutter"], min_quality, max_clutter)
        & (_text("image_path") != "")
    )
    wanted = passed.select("image_path").distinct()
    counted = (
        labels.join(wanted, "image_path", "left_semi")
        .select("image_path", names.squeezed_name(F.col("name")).alias("label"))
        .filter("label <> ''")
        .groupBy("image_path", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    objects = F.array_distinct(F.transform(r["evaluations"], lambda e: names.squeezed_name(e["object"])))
    vocabulary = allowed.select(names.squeezed_name(F.col("object")).alias("name")).distinct()
    asked = passed.withColumn("name", F.explode(objects)).filter("name <> ''").join(vocabulary, "name", "left_semi")
    found = match.match_vocabulary(asked, counted, "image_path", templates.NAME_ALIASES, cutoff)
    found = found.filter(F.col("matched_label").isNotNull())
    found = found.join(counted.withColumnRenamed("label", "matched_label"), ["image_path", "matched_label"])
    found = found.filter(F.col("n").between(1, 5))
    return asked.join(found, ["image_path", "name"]).select(
        *round2.columns,
        F.lit(True).alias("keep_quality_only"),
        F.col("name").alias("keep_target_object"),
        F.col("matched_label").alias("keep_matched_label_name"),
        F.col("n").cast("int").alias("keep_target_bbox_count"),
        F.col("is_fuzzy").alias("keep_is_fuzzy_match"),
        F.col("n").cast("int").alias("bucket"),
    )


def count_items(keep: DataFrame) -> DataFrame:
    """Counting questions: one per (image, target object)."""
    obj = answers.target_object(F.col("keep_target_object"), F.col("result.evaluations"))
    count = answers.source_count(F.col("keep_target_bbox_count"), F.col("bucket"))
    rows = keep.select(*LINE, _text("image_path").alias("image_path"), obj.alias("object"), count.alias("source_count"))
    rows = rows.filter("image_path <> '' AND object <> ''")
    return rows.withColumn("id", answers.row_uid(image_path=F.col("image_path"), object=F.col("object")))


def count_todo(keep: DataFrame, ledger: DataFrame) -> DataFrame:
    """Questions that the ledger (``id``) has not seen, the first of each id."""
    return match.todo(count_items(keep), ledger, "id", [F.col(c) for c in LINE])


def count_results(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Counting answers read from ``id, raw_text``; failures keep an error code."""
    read = responses.select("id", "raw_text", answers.answer_tree(F.col("raw_text")).alias("_tree"))
    read = read.select(
        "id", "raw_text", answers.is_object(F.col("_tree")).alias("_parsed"),
        *[names.clean(answers.get(F.col("_tree"), f)).alias(f"_{f}") for f in ("estimated_count", "confidence", "reason", "object")],
    )
    error = F.when(~F.col("_parsed"), "parse_fail").otherwise(
        answers.count_error(F.col("_estimated_count"), F.col("_confidence"), F.col("_reason"))
    )
    rows = items.join(read.withColumn("error_msg", error), "id")
    ok = F.col("error_msg").isNull()
    result = F.struct(
        F.coalesce(F.nullif("_object", F.lit("")), "object").alias("object"),
        F.lower("_estimated_count").alias("estimated_count"), F.lower("_confidence").alias("confidence"),
        F.col("_reason").alias("reason"),
    )
    return rows.select(
        *LINE, "id", ok.alias("ok"), F.when(ok, 0).when(F.col("error_msg") == "parse_fail", 1).otherwise(2).alias("error_code"),
        "error_msg", "image_path", "object", "source_count", "raw_text", F.when(ok, result).alias("result"),
    )


def count_lookup(counts: DataFrame) -> DataFrame:
    """The most confident count per (image, object); the first one of equals."""
    keyed = counts.withColumn("_name", names.lower_name(F.col("object"))).filter((F.col("image_path") != "") & (F.col("_name") != ""))
    conf = scoring.confidence_score(F.coalesce("result.confidence", F.lit("")))
    return ranking.first_per_key(keyed, ["image_path", "_name"], [conf.desc(), *[F.col(c) for c in LINE]])


def judged_candidates(keep: DataFrame, counts: DataFrame) -> DataFrame:
    """Kept records joined with their count, where both agree, with the best evaluation
    of the target object."""
    lookup = count_lookup(counts).select("image_path", "_name", F.col("ok").alias("_count_ok"), F.col("result").alias("_count"))
    left = keep.withColumn("_name", names.lower_name(F.col("keep_target_object"))).filter((F.col("image_path") != "") & (F.col("_name") != ""))
    rows = left.join(lookup, ["image_path", "_name"])
    source = scoring.safe_int(F.coalesce(F.col("keep_target_bbox_count"), F.col("bucket")))
    rows = rows.filter(
        gates.counts_agree(F.col("ok"), F.col("_count_ok"), F.col("image_path"), F.col("_count.estimated_count"), source)
    )
    other = names.lower_name(F.col("keep_matched_label_name"))
    # the evaluations of a record sit in one row, so the best one needs no shuffle
    own = F.filter("result.evaluations", lambda e: names.lower_name(e["object"]).isin(F.col("_name"), other) & (names.lower_name(e["object"]) != ""))
    ranked = F.transform(
        own,
        lambda e, i: F.struct(
            scoring.eval_score(*[scoring.safe_int(e[f]) for f in ("affordance_quality", "object_visible", "bbox_quality", "parts_visibility")]).alias("score"),
            (-i).alias("at"),
            e.alias("e"),
        ),
    )
    rows = rows.withColumn("_best", F.array_max(ranked)).filter(F.col("_best").isNotNull())
    e, r = F.col("_best.e"), F.col("result")
    return rows.select(
        *LINE, "bucket", "image_path", "result",
        _text("keep_target_object").alias("target_object"),
        _text("keep_matched_label_name").alias("matched_label_name"),
        source.alias("source_count"),
        F.lower(_text(e["affordance"])).alias("affordance"),
        scoring.safe_int(r["bw_yellow_veto"]).alias("bw_yellow_veto"),
        scoring.safe_int(r["image_quality"], -1).alias("image_quality"),
        scoring.safe_int(r["clutter"], -1).alias("clutter"),
        *[scoring.safe_int(e[f]).alias(f) for f in ("affordance_quality", "object_visible", "bbox_quality", "parts_visibility")],
        F.lower(_text("_count.confidence")).alias("confidence"),
    )


def select_adaptive(keep: DataFrame, counts: DataFrame, **cap_args) -> dict[str, DataFrame]:
    """The rebalanced set and its tables (see ``operators.select``)."""
    return select.adaptive_selection(judged_candidates(keep, counts), ["bucket", *LINE, "target_object"], **cap_args)


def instruction_items(kept: DataFrame, n_shards: int = 4) -> DataFrame:
    """Flat (image, object, part, affordance, action) items of the positive evaluations
    of each kept target, dealt to shards in key order. Parts of one affordance keep
    their first spelling."""
    rec = ["bucket", *LINE, "target_object"]
    hit = lambda e: gates.targets(e["object"], e["affordance"], e["affordance_quality"], F.col("target_object"), F.col("affordance"))
    rows = kept.select(*rec, "image_path", F.posexplode(F.filter("result.evaluations", hit)).alias("_e", "e"))
    rows = rows.select(
        *rec, "image_path", "_e", _text("e.object").alias("_obj"), _text("e.affordance").alias("affordance"),
        F.posexplode("e.parts").alias("_p", "part"),
    ).withColumn("part", _text("part")).filter("part <> '' AND affordance <> '' AND _obj <> ''")
    rows = rows.withColumn("_key", F.lower("part"))
    group = [*rec, "_obj", "affordance"]
    first = ranking.first_per_key(rows, [*group, "_key"], [F.col("_e"), F.col("_p")])
    # at most the parts of one record
    at = F.row_number().over(Window.partitionBy(*group).orderBy("_e", "_p")) - 1
    items = first.withColumn("part_idx", at).select(
        F.format_string("%s/%s:%d:p%d", F.col("bucket").cast("string"), paths.basename(F.col("src_file")), F.col("src_line") + 1, "part_idx").alias("source"),
        F.col("bucket").cast("string").alias("bucket_id"), "image_path", F.col("target_object").alias("object"), "part", "affordance",
        templates.action_of(F.col("affordance")).alias("action"),
    )
    order = [F.col(c) for c in ("bucket_id", "image_path", "object", "part", "affordance", "source")]
    return sinks.shards(items, order, n_shards).drop("row_no")


UID_FIELDS = ("image_path", "object", "part", "affordance", "source")


def with_item_id(items: DataFrame) -> DataFrame:
    return items.withColumn("id", answers.row_uid(**{f: F.coalesce(f, F.lit("")) for f in UID_FIELDS}))


def query_rows(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Object queries: validated ``q1`` and ``q2`` of the answer, or their canonical
    forms. ``items`` carries ``id``; ``responses`` carries ``id, raw_text``."""
    read = responses.select("id", answers.answer_tree(F.col("raw_text")).alias("_tree"))
    read = read.select("id", answers.is_object(F.col("_tree")).alias("ok"), *[answers.get(F.col("_tree"), q).alias(f"_{q}") for q in ("q1", "q2")])
    rows = checks.with_queries(items.join(read, "id"), "_q1", "_q2")
    ok = F.col("ok")
    made = ["query_direct", "query_affordance", "repaired_q1", "repaired_q2"]
    return rows.select(
        *items.columns, "ok", F.when(~ok, 1).otherwise(0).alias("error_code"), *[F.when(ok, F.col(c)).alias(c) for c in made]
    )


def task_rows(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Task instructions: validated, replaced by the fallback, or rejected."""
    read = responses.select("id", answers.answer_tree(F.col("raw_text")).alias("_tree"))
    read = read.select("id", answers.is_object(F.col("_tree")).alias("_parsed"), answers.get(F.col("_tree"), "instruction").alias("_text"))
    rows = checks.with_instruction(items.join(read, "id"), "_text")
    parsed, valid = F.col("_parsed"), F.col("valid")
    return rows.select(
        *items.columns, (parsed & valid).alias("ok"), F.when(~parsed, 1).when(~valid, 2).otherwise(0).alias("error_code"),
        F.when(parsed, F.col("instruction_error")).alias("error_msg"), F.when(parsed, F.col("instruction")).alias("instruction"),
        (parsed & F.col("repaired")).alias("repaired"),
    )


KEY = ["_bucket", "_image", "_object", "_part", "_affordance"]


def _keyed(rows: DataFrame, prefix: str, normaliser) -> DataFrame:
    good = rows.filter(F.coalesce("ok", F.lit(False)))
    return good.withColumns(
        {
            # numeric bucket ids count too
            "_bucket": names.clean(F.col("bucket_id").cast("string")),
            "_image": paths.strip_prefix(_text("image_path"), prefix),
            **{f"_{f}": normaliser(F.col(f)) for f in ("object", "part", "affordance")},
        }
    )


def merge_feeds(
    queries: DataFrame, tasks: DataFrame, order: Sequence[str] = LINE, prefix: str = "", normaliser=names.lower_name
) -> DataFrame:
    """Merge the two label feeds on (bucket, image, object, part, affordance); the last
    row of a key wins. ``status`` counts what the other feed lacks; rows without a query
    are ``no_left`` and carry no annotation."""
    fields = ["object", "part", "affordance", "action"]
    left = regroup.last_per_key(_keyed(queries, prefix, normaliser), KEY, order)
    right = regroup.last_per_key(_keyed(tasks, prefix, normaliser), KEY, order)
    left = left.select(*KEY, *fields, "source", "query_direct", F.col("object").alias("_o"), F.col("part").alias("_p"), F.col("affordance").alias("_a"), F.lit(None).cast("string").alias("instruction"))
    rows = regroup.outer_merge(left, right, KEY, [*fields, "instruction"])
    task = F.when(F.col("status") == "both", F.coalesce("instruction", F.lit("")))
    texts = regroup.merged_texts(F.col("query_direct"), F.col("_p"), F.col("_o"), task, F.col("_a"))
    return rows.select(
        F.col("_bucket").alias("bucket_id"), F.col("_image").alias("image_path"), "status", "source",
        *[_text(f).alias(f) for f in fields], *[c.alias(n) for n, c in texts.items()],
    )


def part_lists(items: DataFrame, page_size: int = 1000) -> DataFrame:
    """Part list per (bucket, image), in (object, part, affordance) order, in pages."""
    fields = ["object", "part", "affordance", "action", "trps", "orps"]
    order = [names.label_key(F.col(c)).asc() for c in fields[:3]] + [F.col(c) for c in fields]
    item = F.struct(
        *fields[:4], F.struct("trps", "orps").alias("instruction")
    )
    return ranking.paged_lists(items, ["bucket_id", "image_path"], order, item, page_size, "part_list")


def merge_annotations(queries: DataFrame, tasks: DataFrame, **kw) -> DataFrame:
    """Merged annotation items, sit-on rule applied."""
    rows = merge_feeds(queries, tasks, **kw).filter("status <> 'no_left'")
    return rows.filter(gates.sit_on_rule(F.col("part"), F.col("affordance"), F.col("action")))


def relabel_annotations(items: DataFrame, rules=templates.BAD_TRIPLES) -> dict[str, DataFrame]:
    """Move mismatched affordances to the dominant one of their (object, part), taken
    over the items that are not mismatched, and drop repeats within an image."""
    marked = match.flag_bad_triples(items, F.col("object"), F.col("part"), F.col("affordance"), rules)
    keyed = marked.withColumns({"_op": names.label_key(F.col("object")), "_pp": names.label_key(F.col("part"))})
    seen = ["bucket_id", "image_path", "object", "part", "affordance", "action"]
    good = keyed.filter("NOT is_bad").withColumns({"label": names.label_key(F.col("affordance")), "surface": F.col("affordance")})
    combo = good.select("_op", "_pp", "label", "surface", *[F.col(c).alias(f"_to_{c}") for c in ("action", "trps", "orps")], *seen)
    dominant = regroup.dominant_labels(combo, ["_op", "_pp"], "label", "surface", ["_to_action", "_to_trps", "_to_orps"], seen)
    moved = regroup.relabel(keyed, dominant, ["_op", "_pp"], "is_bad")
    moved = moved.join(dominant.select("_op", "_pp", "_to_action", "_to_trps", "_to_orps"), ["_op", "_pp"], "left")
    remap = F.col("outcome") == "remap"
    spare = templates.task_sentence(F.col("object"), F.col("to_label"))
    out = moved.withColumns(
        {
            "from_label": F.col("affordance"),
            "affordance": F.when(remap, F.col("to_label")).otherwise(F.col("affordance")),
            "action": F.when(remap & (_text("_to_action") != ""), F.col("_to_action")).otherwise(F.col("action")),
            "trps": F.when(remap, F.coalesce(F.nullif(_text("_to_trps"), F.lit("")), spare)).otherwise(F.col("trps")),
            "orps": F.when(remap & (_text("_to_orps") != ""), F.col("_to_orps")).otherwise(F.col("orps")),
        }
    )
    kept = out.filter("outcome <> 'drop'").withColumns(
        {f"_s{i}": names.label_key(F.col(c)) for i, c in enumerate(("object", "part", "affordance", "action"))}
    )
    signature = ["bucket_id", "image_path", "_s0", "_s1", "_s2", "_s3", "trps", "orps"]
    order = [F.col(c) for c in ("_op", "_pp", "from_label", "object", "part", "affordance")]
    kept = ranking.first_per_key(kept, signature, order)
    changed = out.filter(F.col("is_bad"))
    report = metrics.relabel_report(
        changed, ["object", "part", "from_label", "to_label", "outcome"], ["bucket_id", "image_path", "source"], "source"
    )
    return {"items": kept.select(*items.columns), "report": report}


def catalogs(items: DataFrame) -> dict[str, DataFrame]:
    """Object-part catalog, its one-line text, and the affordance rollup."""
    rows = items.withColumnRenamed("bucket_id", "bucket")
    parts = regroup.part_catalog(rows)
    return {
        "parts": parts,
        "lines": regroup.catalog_line(parts),
        "affordances": regroup.affordance_rollup(rows),
        "buckets": regroup.bucket_histogram(rows),
    }


# -- trajectories to training records ----------------------------------------


def good_trajectories(items: DataFrame, min_iou: float = 0.7) -> DataFrame:
    """Trajectories whose last step reaches the IoU."""
    return items.filter(F.try_element_at("clicks_list", F.lit(-1))["iou"] >= min_iou)


def training_records(items: DataFrame, overlay_dir: str) -> DataFrame:
    """One chat record per click. The clicks of an item sit in one row, so the value of
    the step before is read from the same array and nothing is shuffled. ``overlay_of``
    is the step whose mask is drawn on the image; null at step 0."""
    key = F.coalesce("gt_ann.inst_key", F.lit(""))
    stem = F.concat(paths.stem(F.col("image_name")), F.when(key != "", F.concat(F.lit("__"), key)).otherwise(""))
    caption = templates.compose_caption(F.col("gt_ann.caption"), F.col("gt_ann.part"), F.col("gt_ann.object"))
    rows = items.select(
        "image_name", "height", "width", stem.alias("_stem"), caption.alias("_caption"), "clicks_list",
        F.posexplode("clicks_list").alias("step", "c"),
    )
    first = F.col("step") == 0
    before = F.get("clicks_list", F.col("step") - 1)["iou"]
    image = F.when(first, F.col("image_name")).otherwise(
        F.concat(F.lit(overlay_dir.rstrip("/") + "/"), "_stem", F.lit("__step"), F.col("step").cast("string"), F.lit(".jpg"))
    )
    row, col = F.col("c.coor")[0], F.col("c.coor")[1]
    answer = templates.answer_text(
        F.col("_caption"), F.when(first, 0.0).otherwise(before), F.col("c.is_positive"),
        geometry.to_thousand(col, F.col("width")), geometry.to_thousand(row, F.col("height")), F.col("c.iou"),
    )
    return rows.select(
        "image_name", "step", F.when(~first, F.col("step") - 1).alias("overlay_of"),
        *templates.chat_record(templates.request_text(F.col("_caption")), answer, image),
    )


def one_click_records(instances: DataFrame, sizes: DataFrame, image_dir: str, ratio: float = 0.2) -> DataFrame:
    """One record per annotated instance with its first click in crop pixels; clicks
    outside the crop drop out. ``sizes`` carries ``image_path, width, height``."""
    rows = instances.join(sizes, "image_path")
    box = geometry.crop_ratio(*[F.col("bbox")[i] for i in range(4)], F.col("width"), F.col("height"), ratio)
    click = F.col("click_sequence")[0]
    x, y, inside = geometry.into_crop(click["x"], click["y"], box)
    caption = F.coalesce("instruction.orps", F.lit("the target object"))
    image = F.concat(F.lit(image_dir.rstrip("/") + "/"), paths.stem(F.col("image_path")), F.lit("__"), "inst_key", F.lit(".jpg"))
    answer = templates.one_click_text(caption, click["type"] == "positive", x, y)
    return rows.filter(inside).select(
        "image_path", "inst_key", *templates.chat_record(templates.request_text(caption), answer, image)
    )


def check_records(records: DataFrame, inventory: DataFrame) -> dict[str, DataFrame]:
    """Errors per record and the profile of the valid ones. ``inventory`` lists ``path``."""
    listed = inventory.select(F.col("path").alias("_image"), F.lit(True).alias("_there")).distinct()
    rows = records.withColumn("_image", F.try_element_at("images", F.lit(1))).join(listed, "_image", "left")
    rows = checks.with_chat_errors(rows.withColumn("_there", F.coalesce("_there", F.lit(False))), "_there").drop("_image", "_there")
    # a filter on the computed errors would be pushed below them and repeat all the work
    rows = materialise(rows, "checked")
    valid = rows.filter(F.size("errors") == 0).select(F.col("messages")[1]["content"].alias("_a"))
    parsed = answers.with_click(valid, "_a").withColumn("sign", templates.click_sign(F.col("is_positive")))
    return {"errors": rows, "profile": metrics.validation_profile(parsed, "sign", "current_iou", "x_norm", "y_norm")}


# -- evaluation --------------------------------------------------------------


def evaluation_manifest(records: DataFrame, entries: DataFrame, release: DataFrame, trajectories: DataFrame) -> dict[str, DataFrame]:
    """Evaluation queries from the step-0 records of released images.

    ``records``: chat records with ``src_file, src_line``; ``entries``: ``path, md5`` of
    original images; ``release``: ``base, md5`` of released ones; ``trajectories``:
    items with ``src_file, src_line``, the last of each (image, caption) counting."""
    desc = F.regexp_extract(F.col("messages")[0]["content"], "<ref>(.+?)</ref>", 1)
    step0 = records.select(*LINE, F.col("images")[0].alias("path"), desc.alias("description"))
    step0 = step0.filter(gates.is_first_step(paths.stem(F.col("path"))) & (F.col("description") != ""))
    originals = step0.groupBy("path").agg(F.min(F.struct(*LINE)).alias("_at")).join(entries, "path")
    originals = originals.withColumn("base", paths.basename(F.col("path")))
    same = match.content_match(originals, release, [F.col("_at")]).select("path", "base")
    pairs = step0.select("path", "description").distinct().join(same, "path")
    index = trajectories.select(
        F.col("image_name").alias("path"), F.col("gt_ann.caption").alias("description"), "gt_ann", "height", "width", "source_file", *LINE
    )
    index = regroup.last_per_key(index.filter("path <> '' AND description <> ''"), ["path", "description"], LINE).drop(*LINE)
    hits = pairs.join(index.withColumn("_hit", F.lit(True)), ["path", "description"], "left")
    found = hits.filter("_hit").withColumn("_stem", paths.stem(F.col("base")))
    named = regroup.unique_names(found, "_stem", names.slug(F.col("description")), [F.col("path"), F.col("description")], "_mask")
    manifest = named.select(
        F.col("base").alias("image_name"), F.concat(F.lit("images/"), "base").alias("image_path"), F.col("path").alias("orig_image_path"),
        "description", F.concat(F.lit("gt_mask/"), "_stem", F.lit("/"), "_mask", F.lit(".png")).alias("gt_mask_path"),
        F.col("gt_ann.caption").alias("gt_caption"), F.col("gt_ann.bbox").alias("gt_bbox"), F.col("gt_ann.area").alias("gt_area"),
        "height", "width", "source_file",
    )
    return {"manifest": manifest, "missing": hits.filter(F.col("_hit").isNull()).select("path", "base", "description")}


def score_run(steps: DataFrame, keys: Sequence[str] = ("image_name", "description")) -> dict[str, DataFrame]:
    """Per-case summary and benchmark metrics of ``keys, step, iou, inter, union``."""
    cases = sequence.summarise(steps, list(keys), ["step"], "iou", "step", ["inter", "union"])
    cases = cases.withColumns(
        {"step0_success_at_50": F.col("step0_iou") >= 0.5, "success_at_50": F.col("best_iou") >= 0.5}
    )
    return {"cases": cases, "metrics": metrics.iou_metrics(cases)}
