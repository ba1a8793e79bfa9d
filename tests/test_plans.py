from pyspark.sql import functions as F

from annolake.functions.geometry import make_box
from annolake.plans.build_samples import build_samples
from annolake.plans.geometry_plan import epoch_geometry_plan
from annolake.plans.prepare_roi import prepare_roi


def test_prepare_roi(spark):
    images = spark.createDataFrame([(n, 200, 100, n == "gone") for n in ("a", "b", "empty", "gone")], "image_id string, width int, height int, drop_image boolean")
    labels = spark.createDataFrame([("a", 0, 0.30, 0.40, 0.10, 0.20), ("b", 0, 0.55, 0.60, 0.20, 0.10), ("gone", 0, 0.9, 0.9, 0.1, 0.1), ("b", 1, 0.9, 0.9, 0.1, 0.1)], "image_id string, line_index long, cx double, cy double, w double, h double")
    masked = spark.createDataFrame([("b", 1)], "image_id string, line_index long")
    out = prepare_roi(images, labels, masked, keep_empty=True)
    rows = {r.image_id: r for r in out["samples"].collect()}
    assert set(rows) == {"a", "b", "empty"}
    assert all((r.roi_width, r.roi_height) == (80, 35) and tuple(r.crop) == (50, 30, 130, 65) for r in rows.values())
    assert rows["a"].label_lines == ["0 0.125000 0.285714 0.250000 0.571429"] and rows["empty"].label_lines == []
    s = out["summary"].first()
    assert (s.samples, s.positive, s.empty) == (3, 2, 1)
    texts = spark.createDataFrame([("a", " "), ("empty", "Ab c")], "image_id string, ocr_text string")
    rows = {r.image_id: r for r in prepare_roi(images, labels, masked, texts, keep_empty=True)["samples"].collect()}
    assert not rows["a"].has_subtitle and rows["empty"].has_subtitle and rows["empty"].ocr_text_normalized == "abc"


def test_build_samples_cap_and_empty(spark):
    frames = spark.createDataFrame([("v", i, 100, 100, 0, 0) for i in range(8)], "video_id string, frame_index long, width int, height int, offset_x int, offset_y int")
    found = spark.createDataFrame([("v", i, 10.0, 0.9 if i != 4 else None) for i in (2, 4, 5, 6)], "video_id string, frame_index long, x double, score double")
    found = found.withColumn("box", make_box("x", F.lit(10.0), F.lit(50.0), F.lit(30.0)))
    out = build_samples(frames, found, stride=2, min_score=0.5, max_frames=2)
    assert sorted(r.sample_id for r in out["frames"].collect()) == ["v_f00000002", "v_f00000004"]
    s = out["stats"].first()
    assert (s.selected_frames, s.kept_frames, s.detections) == (3, 2, 2)
    assert out["labels"].first().line == "0 0.300000 0.200000 0.400000 0.200000"
    everything = build_samples(frames, found, keep_empty=True)
    assert everything["frames"].count() == 8


def test_geometry_plan(spark):
    rows = []
    for i in range(60):
        boxes = [(100.0 + i, 500.0, 400.0, 500.0 + 10 + i)] if i % 2 else []
        rows.append(("r", f"s{i}", "full_frame" if i % 3 else "random_crop", i % 2, 1280, 720, boxes, []))
    box = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    df = spark.createDataFrame(rows, f"root string, sample_id string, sample_type string, crop_view int, width int, height int, boxes {box}, ignored_boxes {box}")
    plan = lambda epoch: epoch_geometry_plan(df, 0.25, 8.0, True, 1, epoch).collect()
    first = plan(0)
    for r in first:
        assert r.output_width % 16 == 0 and 0 <= r.crop.x1 < r.crop.x2 <= 1280 and 0 <= r.crop.y1 < r.crop.y2 <= 720
        if r.has_subtitle:
            (b,) = r.boxes
            height = 10 + int(r.sample_id[1:])
            assert b.y2 - b.y1 == height and b.x2 - b.x1 == 300 - int(r.sample_id[1:]), "a crop keeps the boxes whole"
            assert r.protection_satisfied and height * r.output_height / r.height >= 8 - 1e-6
    scales = {r.resize_scale for r in first if r.has_subtitle}
    assert {r.resize_scale for r in first if not r.has_subtitle} <= scales
    key = lambda rows: sorted((r.item_id, tuple(r.crop), r.resize_scale) for r in rows)
    assert key(plan(0)) == key(first) != key(plan(1))


def test_scales_are_ranked_from_written_rows(spark, monkeypatch):
    from annolake.plans import geometry_plan as gp

    box = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    rows = [("r", str(k), kind, 0, 640, 360, [(10.0, 300.0, 200.0, 304.0 + k)] if k % 2 else [], []) for k in range(6) for kind in ("full_frame", "random_crop")]
    df = spark.createDataFrame(rows, f"root string, sample_id string, sample_type string, crop_view int, width int, height int, boxes {box}, ignored_boxes {box}")
    written = []
    monkeypatch.setattr(gp, "checkpointed", lambda frame: written.append(frame) or frame.localCheckpoint())
    plan = gp.epoch_geometry_plan(df, 0.25, 8.0, True, 1, 0)
    # The rule that pushes filters down would copy each random number of a crop into every corner of every box.
    (scales,) = written
    assert scales._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") <= 4
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") <= 5
    assert plan.count() == len(rows)
