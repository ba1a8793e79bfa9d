import json
import struct

import pytest
from pyspark.sql import functions as F

from annolake.operators import overlay as ov
from annolake.sources import annotations as an
from annolake.sources import images as im
from annolake.sources import labels as lb
from annolake.sources import lines as ln
from annolake.sources import sinks
from annolake.sources import texts as tt

ROWS = [("k7", True, "part-one", 12, "hello there"), ("k8", True, "part-one", 24, "hello there"), ("m1", True, "part-two", 49, "good evening"), ("z9", False, "empty", 95, "")]


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", width, height) + b"\0" * 8


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"J" * 14 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, height, width) + b"\0" * 12


@pytest.fixture()
def root(tmp_path):
    home = tmp_path / "rootA"
    (home / "labels").mkdir(parents=True)
    (home / "images").mkdir()
    with open(home / "annotations.jsonl", "w") as out:
        for name, has, segment, frame, text in ROWS:
            out.write(json.dumps({"image": f"images/{name}.jpg", "source_annotation": {"source_video": "film9.mkv", "frame_index": frame}, "roi_size": [48, 24], "has_subtitle": has, "segment_marker": segment, "ocr_text": text}) + "\n\n")
            (home / "labels" / f"{name}.txt").write_text("0 0.5 0.5 0.25 0.5\nbad line\n# x\n0 0.1 0.1 0 0\n" if has else "")
            (home / "images" / f"{name}.jpg").write_bytes(jpeg(48, 24))
    (home / "images" / "z.png").write_bytes(png(200, 100))
    (home / "summary.json").write_text(json.dumps({"version": 1, "roi_size": [48, 24], "samples": 4}))
    (home / "segment_review.json").write_text(json.dumps({"version": 2, "items": {"z9": {"has_subtitle": True, "segment_id": "", "note": "seen"}, "m1": {"segment_id": "moved"}}}))
    return str(home)


def test_roi_samples(spark, root):
    got = {r.sample_id: r for r in an.read_roi_samples(spark, [root]).collect()}
    assert set(got) == {"k7", "k8", "m1", "z9"} and got["k8"].root == root
    assert (got["k8"].frame_index, got["k8"].video_id, got["k8"].ocr_text, got["k8"].sample_idx) == (24, "film9.mkv", "hello there", 1)
    assert got["z9"].has_subtitle and got["z9"].segment_id == "empty" and not got["z9"].segment_changed and got["z9"].note == "seen"
    assert got["m1"].segment_id == "moved" and got["m1"].segment_changed and got["m1"].has_subtitle
    summary = an.require_roi_size(an.read_summary(spark, [root])).first()
    assert (summary.roi_width, summary.roi_height, summary.is_roi) == (48, 24, True)


def test_missing_and_wrong_documents(spark, root, tmp_path):
    other = tmp_path / "rootB"
    other.mkdir()
    (other / "summary.json").write_text("{}")
    (other / "segment_review.json").write_text('{"version": 1, "items": {}}')
    assert [r.is_roi for r in an.read_summary(spark, [str(other)]).collect()] == [False]
    with pytest.raises(Exception, match="roi_size"):
        an.require_roi_size(an.read_summary(spark, [str(other)])).collect()
    with pytest.raises(Exception, match="version 2"):
        an.read_review(spark, [str(other)]).collect()
    assert lb.read_label_masks(spark, [str(other)]).count() == 0


def test_labels(spark, root):
    lines = lb.read_label_lines(spark, [root])
    sizes = im.discover_images(spark, [root]).select("root", "sample_id", "width", "height")
    got = lb.parse_labels_lenient(lines, sizes, ["root", "sample_id"]).collect()
    assert sorted((r.sample_id, r.line_index, r.valid_index) for r in got) == [(n, 0, 0) for n in ("k7", "k8", "m1")]
    assert tuple(got[0].box) == (18.0, 6.0, 30.0, 18.0)
    assert lb.rejected_labels(lines).count() == 3
    with pytest.raises(Exception, match="five fields"):
        lb.parse_labels_strict(lines, ["root", "sample_id"]).collect()
    strict = lb.parse_labels_strict(lines.filter("value <> 'bad line'"), ["sample_id"]).filter("sample_id = 'k7'").orderBy("line_index").collect()
    assert [(r.line_index, r.w) for r in strict] == [(0, 0.25), (3, 0.0)]


def test_images(spark, root):
    got = {r.filename: (r.width, r.height) for r in im.discover_images(spark, [root]).collect()}
    assert got["k7.jpg"] == (48, 24) and got["z.png"] == (200, 100)
    assert im.list_images(spark, [root], "jpg").count() == 4
    assert im.header_size(b"nothing") is None


def test_dimensions_error_without_any_source(spark):
    wanted = spark.createDataFrame([("a.jpg", "a")], "filename string, sample_id string")
    notes = spark.createDataFrame([("images/a.png", 1, 80, 60)], "image string, line_index long, image_width long, image_height long")
    none = spark.createDataFrame([], "filename string, width long, height long")
    assert tuple(im.resolve_dimensions(wanted, notes, none).first())[2:] == (80, 60)
    with pytest.raises(Exception, match="size unknown"):
        im.resolve_dimensions(wanted, notes.limit(0), none).collect()


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = ln.read_lines(spark, str(path))
        assert got.rdd.getNumPartitions() >= 1 and got.filter(F.concat(F.lit("line "), "line_index") != F.col("value")).count() == 0
        assert got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_masks(spark):
    doc = json.dumps({"items": {"s": {"__image__": {"drop_image": True}, "__add_1": {"add_bbox": [10, 20, 30, 40]}, "0": {"masked": True}, "1": {"masked": True, "bbox": [0, 0, 5, 5]}, "2": {"bbox": [1, 1, 3, 3]}}}})
    records = lb.parse_label_masks(spark.createDataFrame([("r", doc)], "root string, value string")).withColumnRenamed("sample_id", "image_id")
    boxes = spark.createDataFrame([("s", 0, (1.0, 1.0, 9.0, 9.0)), ("s", 1, (2.0, 2.0, 9.0, 9.0))], "image_id string, valid_index long, box struct<x1:double,y1:double,x2:double,y2:double>")
    parts = ov.apply_label_masks(boxes, records, spark.createDataFrame([("s", 100, 100)], "image_id string, width int, height int"))
    # The third box is the added one; record "2" replaces it afterwards.
    assert sorted(tuple(r.box) for r in parts["boxes"].collect()) == [(0, 0, 5, 5), (1, 1, 3, 3)]
    assert parts["dropped"].count() == 1 and parts["ignore_regions"].count() == 0


def test_via(spark):
    files = spark.createDataFrame([("a", "a.jpg", 7, 400, 250), ("b", "b.jpg", 0, 10, 10)], "sample_id string, filename string, size long, width long, height long")
    labels = spark.createDataFrame([("a", 0, 0.25, 0.6, 0.1, 0.2)], "sample_id string, line_index long, cx double, cy double, w double, h double")
    entries = lb.labels_to_via(files, labels)
    item = json.loads({r.entry_key: r.item for r in entries.collect()}["a.jpg7"])
    assert item["regions"][0]["shape_attributes"] == {"name": "rect", "x": 80, "y": 125, "width": 40, "height": 50}
    back = {r.sample_id: r.line for r in lb.via_to_labels(entries).collect()}
    assert back == {"a": "0 0.250000 0.600000 0.100000 0.200000", "b": None}
    odd = json.dumps({"filename": "c.jpg", "regions": [{"shape_attributes": {"name": "circle"}}], "file_attributes": {"width": 0}})
    with pytest.raises(Exception, match="no image size"):
        lb.via_to_labels(spark.createDataFrame([("c", odd)], "entry_key string, item string")).collect()


def test_subtitles(spark):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nGrüß Gott\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nauf Wiedersehen\r\n"
    files = spark.createDataFrame([("x.srt", srt), ("y.txt", " one \n\n2\n")], "path string, text string")
    got = tt.read_subtitles(files).orderBy("path", "cue").collect()
    assert [r.subtitle for r in got] == ["Grüß Gott", "auf Wiedersehen", "one", "2"]


def test_sinks(spark, tmp_path):
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    lines = spark.createDataFrame([("a", 1, "second"), ("a", 0, "first"), ("b", 0, None)], "sample_id string, line_index int, line string")
    folder = str(tmp_path / "labels")
    sinks.write_label_files(sinks.label_texts(samples, lines, ["sample_id"]), folder)
    assert (tmp_path / "labels" / "a.txt").read_text() == "first\nsecond\n" and (tmp_path / "labels" / "b.txt").read_text() == ""
    rows = spark.createDataFrame([("k::1", "k", "1", 0.5)], "sample_key string, root string, sample_id string, score double")
    sinks.write_scores(rows, str(tmp_path / "scores"))
    assert an.read_scores(spark, str(tmp_path / "scores")).first().score == 0.5
    sinks.write_annotations(samples.withColumn("image", F.lit(None).cast("string")), str(tmp_path / "ann"))
    assert '"image":null' in "".join(p.read_text() for p in (tmp_path / "ann").glob("*.json"))
    for epoch in (1, 2):
        sinks.append_metrics(spark.createDataFrame([(epoch, 0.5)], "epoch int, f1 double"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    sinks.write_summary(samples.agg(F.count("*").alias("samples")), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first().samples == 2


def test_leak_gate(spark):
    schema = "root string, video_id string, frame_index long, source_image string"
    train = spark.createDataFrame([("a", "v", 1, "x"), ("a", None, None, None)], schema)
    ov.require_disjoint(train, spark.createDataFrame([("b", "v", 2, "y"), ("b", None, None, None)], schema))
    with pytest.raises(ValueError, match="video_frames"):
        ov.require_disjoint(train, spark.createDataFrame([("b", "v", 1, "y")], schema))
    with pytest.raises(Exception, match="differ in ROI size"):
        a, b = (train.withColumn("roi_width", F.lit(w)).withColumn("roi_height", F.lit(9)) for w in (1, 2))
        ov.union_roots([a, b]).collect()
