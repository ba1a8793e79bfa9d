"""Nested results at any depth, frames that are unknown, plans that do not follow the cluster, banded alignment."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.operators import pairs as pr
from annolake.operators.similarity import AlignmentSettings, align_batch
from annolake.plans import schedule as sc
from annolake.sources import texts as tt


@pytest.mark.parametrize(("value", "text"), [
    ({"x": "[note] hi"}, "[note] hi"), (["[note]", "hi"], "[note]hi"), (['"so" he said'], '"so" he said'), ({"x": "1984"}, "1984"),
    ({"rec_text": 5, "text": "t"}, "t"), ([[[[[{"label": "deep"}]]]]], "deep"), ({"a": {"b": {"c": {"d": {"e": "far"}}}}}, "far"),
    ({"a": [], "b": ["x", "y"]}, "xy"), ({"rec_texts": ["a", "", 3]}, "a3"), (7, ""), (None, ""), ("plain", "plain"),
])
def test_text_within(value, text):
    assert tt.text_within(value) == text


def test_extract_text_of_odd_rows(spark):
    rows = [(1, None), (2, "no json"), (3, ""), (4, json.dumps([["a"], {"z": "b"}])), (5, "[" * 600 + '"x"' + "]" * 600)]
    got = dict(spark.createDataFrame(rows, "k int, r string").select("k", tt.extract_text(F.col("r"))).collect())
    assert got == {1: "", 2: "", 3: "", 4: "ab", 5: "x"}


@pytest.mark.parametrize("depth", [0, 3, 4, 9])
def test_detections_at_any_depth(spark, depth):
    quad = [[1, 2], [3, 2], [3, 4], [1, 4]]
    value = {"points": quad, "score": 0.5}
    for _ in range(depth):
        value = [value]
    frame = spark.createDataFrame([(1, json.dumps(value)), (2, "[[[[[[null]]]]]]"), (3, None)], "k int, result string")
    got = tt.normalize_detections(frame, ["k"]).collect()
    assert [(r.k, r.polygon, r.score) for r in got] == [(1, quad, 0.5)]


def test_widest_pair_sets_unknown_frames_aside(spark):
    schema = "root string, sample_id string, sample_idx long, has_subtitle boolean, segment_id string, video_id string, frame_index long, ocr_text string"
    frames = [("a", None), ("a", 500), ("a", 530), ("a", 570), ("b", None), ("b", 9), ("c", None), ("c", None)]
    rows = [("r", f"s{k}", k, True, segment, "v", at, "") for k, (segment, at) in enumerate(frames)]
    got = pr.widest_pair_per_segment(spark.createDataFrame(rows, schema)).collect()
    assert {(r.segment_id, r.i, r.j, r.span) for r in got} == {("a", 1, 3, 70), ("b", 4, 5, 0), ("c", 6, 7, 0)}


def test_schedule_is_the_same_on_any_cluster(spark):
    schema = "root string, sample_id string, sample_idx long, has_subtitle boolean, segment_id string, video_id string, frame_index long, ocr_text string"
    rows = [("r", f"s{k}", k, True, f"g{k // 5}", "v", 20 * k, f"text number {k * k}") for k in range(40)]
    samples, old, plans = spark.createDataFrame(rows, schema), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            plan = sc.pair_epoch_schedule(samples, 8, seed=3, epoch=1, ocr_enabled=False)
            plans.append(sorted(tuple(r) for r in plan.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert plans[0] == plans[1] and plans[0]


def slow_alignment(left, right, s):
    def one_way(x, y):
        own = [k for k, v in enumerate(x) if any(v)]
        best = []
        for k in own:
            near = [float(np.dot(x[k], y[j])) - s.position_penalty * abs(k - j) for j in range(len(y)) if any(y[j]) and abs(k - j) <= s.bandwidth]
            best += [max(near)] if near else []
        if not best:
            return -1.0 - s.unmatched_penalty
        low = sorted(best)[: max(1, int(np.ceil(len(best) * s.bottom_ratio)))]
        return s.mean_weight * np.mean(best) + s.bottom_weight * np.mean(low) - s.unmatched_penalty * (1 - len(best) / len(own))

    return (one_way(left, right) + one_way(right, left)) / 2


def test_alignment_with_blank_tokens():
    draw, s = np.random.default_rng(12), AlignmentSettings()
    left, right = draw.standard_normal((30, 9, 4)), draw.standard_normal((30, 9, 4))
    left[draw.random((30, 9)) < 0.5] = 0
    right[draw.random((30, 9)) < 0.6] = 0
    right[0], left[1] = 0, 0
    got = align_batch(left, right, s)
    assert got == pytest.approx([slow_alignment(x, y, s) for x, y in zip(left, right, strict=True)])
