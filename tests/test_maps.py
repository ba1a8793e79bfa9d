import math
import random

import numpy as np
from pyspark.sql import functions as F

from annolake.functions.geometry import make_box
from annolake.operators import maps as mp


def boxes(spark, rows):
    df = spark.createDataFrame([(1, k + 1, *map(float, r)) for k, r in enumerate(rows)], "s long, instance long, x1 double, y1 double, x2 double, y2 double")
    return df.select("s", "instance", make_box("x1", "y1", "x2", "y2").alias("box"))


def cells(df):
    return {(r.x, r.y): r for r in df.collect()}


def test_targets_small(spark):
    got = cells(mp.region_kernel_targets(boxes(spark, [(6, 5, 26, 13)]), boxes(spark, [(0, 0, 4, 4)]), "s", 32, 16, kernel_scale=0.25))
    assert got[1, 1].training_mask == 0 and got[8, 7].region == 1 and got[16, 9].kernel == 1
    assert 0 < sum(r.kernel for r in got.values()) < sum(r.region for r in got.values()) == 160


def test_targets_wide(spark):
    got = cells(mp.region_kernel_targets(boxes(spark, [(10, 10, 90, 30)]), boxes(spark, [(0, 0, 0, 0)]), "s", 100, 40))
    kernel = sum(r.kernel for r in got.values())
    assert 400 < kernel < sum(r.region for r in got.values())
    assert kernel == (80 - 8) * (20 - 8)


def test_targets_at_the_border_and_overlap(spark):
    got = cells(mp.region_kernel_targets(boxes(spark, [(0, 0, 20, 20), (10, 0, 30, 20)]), boxes(spark, [(0, 0, 0, 0)]), "s", 30, 20, pooling=5, kernel_scale=1.0))
    # Shrunk boxes equal the boxes: twice covered cells are cleared, all others are set.
    assert all(r.kernel == (0 if 10 <= x < 20 else 1) for (x, y), r in got.items()) and len(got) == 600
    got = cells(mp.region_kernel_targets(boxes(spark, [(0, 0, 30, 20)]), boxes(spark, [(0, 0, 0, 0)]), "s", 30, 20, pooling=5))
    assert all(r.kernel == 1 for r in got.values()), "cells outside the image do not erode"


def decode(spark, width, height, region, kernel, low=-8.0, high=8.0, **settings):
    grid = lambda inside: [high if inside(x, y) else low for y in range(height) for x in range(width)]
    df = spark.createDataFrame([(1, grid(region), grid(kernel))], "s long, region array<double>, kernel array<double>")
    return [tuple(r)[2:] for r in mp.maps_to_boxes(df, "s", width, **settings).collect()]


def test_decode_grows_seed(spark):
    (box,) = decode(spark, 32, 16, lambda x, y: 5 <= y < 13 and 3 <= x < 27, lambda x, y: 8 <= y < 10 and 12 <= x < 17)
    assert box[:4] == (3, 5, 27, 13) and box[4] > 0.8


def test_decode_refines_to_the_core(spark):
    region = [1.0 if y == 1 and not 5 <= x < 11 else 4.0 if y == 1 else -8.0 for y in range(4) for x in range(16)]
    kernel = [4.0 if y == 1 and 7 <= x < 9 else -8.0 for y in range(4) for x in range(16)]
    df = spark.createDataFrame([(1, region, kernel)], "s long, region array<double>, kernel array<double>")
    (box,) = [tuple(r)[2:6] for r in mp.maps_to_boxes(df, "s", 16, min_size=1.0).collect()]
    assert box == (5, 1, 11, 2)


def test_decode_prefers_the_bottom(spark):
    inside = lambda x, y: (9 <= x < 14 and 3 <= y < 6) or (4 <= x < 15 and 16 <= y < 18)
    got = decode(spark, 20, 20, inside, inside, min_size=1.0)
    assert [b[:4] for b in got] == [(4, 16, 15, 18)]


def test_decode_width_clamp(spark):
    inside = lambda x, y: y in (3, 4, 5) and x < 20
    (box,) = decode(spark, 20, 8, inside, lambda x, y: inside(x, y) and x < 2, max_width_ratio=0.5)
    assert box[2] - box[0] == 10 and box[0] == 0


def test_rasterize_covers_at_least_one_cell(spark):
    label = make_box(F.lit(32 * (0.25 - 0.125)), F.lit(16 * (0.4375 - 0.1875)), F.lit(32 * 0.375), F.lit(16 * 0.625))
    df = spark.range(1).select(F.lit(1).alias("s"), label.alias("box"))
    assert mp.rasterize_boxes(df, "s", (32, 16), (32, 16)).count() == 48
    tiny = boxes(spark, [(5.2, 5.2, 5.3, 5.3)])
    assert [(r.x, r.y) for r in mp.rasterize_boxes(tiny, "s", (32, 16), (32, 16)).collect()] == [(5, 5)]


def test_maps_are_decoded_side_by_side():
    rng = np.random.default_rng(5)
    sizes = [16 * h for h in rng.integers(1, 40, 300)]
    region, kernel = rng.random(sum(sizes)), rng.random(sum(sizes))
    decode = lambda r, k, n: mp.decode_maps(r, k, n, 16, 0.35, 0.9, 1.0, 1.0)
    together = decode(region, kernel, sizes)
    at = 0
    for k, size in enumerate(sizes[:50]):
        alone = decode(region[at : at + size], kernel[at : at + size], [size])
        here = together[0] == k
        assert all((one == many[here]).all() for one, many in zip(alone[1:], together[1:]))
        at += size


def test_targets_shuffle_boxes_only(spark, monkeypatch):
    # One map at a time, samples with more boxes than an Arrow batch, and a plain loop over cells.
    rng, width, height = random.Random(4), 12, 8
    rows, drawn = [], {}
    for s in range(6):
        for k in range(1, 30 if s == 3 else 5):
            x, y = rng.uniform(0, 10), rng.uniform(0, 6)
            rows.append((s, k, x, y, min(12.0, x + rng.uniform(0.2, 7)), min(8.0, y + rng.uniform(0.2, 6))))
    df = spark.createDataFrame(rows, "s long, instance long, x1 double, y1 double, x2 double, y2 double").select("s", "instance", make_box("x1", "y1", "x2", "y2").alias("box"))
    monkeypatch.setattr(mp, "PAINTED", 1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = mp.region_kernel_targets(df, df.filter("instance = 2"), "s", width, height, pooling=3)
        plan = got._jdf.queryExecution().toString()
        found = {(r.s, r.x, r.y): (r.region, r.kernel, r.training_mask) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "Window" not in plan and "Generate" not in plan
    owner, cover, ignored = {}, {}, set()
    clip = lambda v, top: min(max(v, 0.0), float(top))
    for s, k, x1, y1, x2, y2 in rows:
        over = lambda a, b, c, d: [(s, x, y) for x in range(math.floor(clip(a, width)), math.ceil(clip(c, width))) for y in range(math.floor(clip(b, height)), math.ceil(clip(d, height)))]  # noqa: B023, E731
        if k == 2:
            ignored.update(over(x1, y1, x2, y2))
        if x2 - x1 > 0.5 and y2 - y1 > 0.5:
            owner.update(dict.fromkeys(over(x1, y1, x2, y2), k))
            w, h = (v if v <= 3 else min(max(v * 0.1, 3.0), v) for v in (x2 - x1, y2 - y1))
            mx, my = (x1 + x2) * 0.5, (y1 + y2) * 0.5
            for c in over(mx - w * 0.5, my - h * 0.5, mx + w * 0.5, my + h * 0.5):
                cover[c] = cover.get(c, 0) + 1
    one = {(s, x, y) for (s, x, y), k in owner.items() if all(owner.get((s, i, y)) == k for i in (x - 1, x, x + 1) if 0 <= i < width)}
    one = {(s, x, y) for s, x, y in one if all((s, x, j) in one and owner[s, x, j] == owner[s, x, y] for j in (y - 1, y, y + 1) if 0 <= j < height)}
    for c in {*owner, *cover, *ignored}:
        drawn[c] = (int(c in owner), int(c in one) if c not in cover else int(cover[c] == 1), int(c not in ignored))
    assert found == drawn


def test_localization_sorts_no_cells(spark):
    rows = [(1, 0, 0.0, 0.9, 1.0), (1, 1, 1.0, 0.9, 1.0), (1, 2, 1.0, 0.95, 0.0), (2, 5, 1.0, 0.4, 1.0), (2, 6, 0.0, 0.4, 1.0), (3, 0, 0.0, 0.9, 1.0)]
    out = mp.region_localization(spark.createDataFrame(rows, "s long, idx int, target double, prob double, valid double"), "s")
    # Of equal probabilities the first cell decides, and no invalid one; sample 3 has no target.
    assert {r.s: r.pointing for r in out.collect()} == {1: 0.0, 2: 1.0}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_covered_words_are_rasterized_cells(spark):
    rng = random.Random(9)
    corners = lambda: (x := rng.uniform(-5, 100), y := rng.uniform(-5, 50), x + rng.uniform(0, 60), y + rng.uniform(0, 30))
    df = boxes(spark, [corners() for _ in range(12)] + [(120, 0, 130, 4)]).withColumn("s", F.col("instance") % 4)
    cells = {(r.s, r.y * 70 + r.x) for r in mp.rasterize_boxes(df, "s", (100, 50), (70, 9)).collect()}
    none = spark.range(9, 10).select(F.col("id").alias("s"), F.lit(None).cast(df.schema["box"].dataType).alias("box"))
    words = mp.covered_words(df.select("s", "box").unionByName(none), "s", (100, 50), (70, 9))
    every = words.select("s", "words", F.explode(F.sequence(F.lit(0), F.lit(70 * 9 - 1))).alias("i"))
    assert {(r.s, r.i) for r in every.filter(mp.is_covered(F.col("words"), F.col("i"), 70)).collect()} == cells and words.count() == 5
