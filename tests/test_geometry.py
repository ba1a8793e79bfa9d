import random

import pytest
from pyspark.sql import functions as F

from annolake.functions import geometry as g


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lits(*values):
    return [F.lit(float(v)) for v in values]


def corners(row):
    return tuple(round(row[k], 6) for k in ("x1", "y1", "x2", "y2"))


def test_decimal_round_equals_python(spark):
    random.seed(3)
    values = [random.randint(0, 10**7) / random.choice([1280, 640, 720, 1000, 128, 7, 2e6]) for _ in range(3000)]
    values += [2.675, 0.0078125, -0.0203125, 0.5, 1.5]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for digits in (0, 2, 6):
        rows = df.select("v", g.decimal_round("v", digits).alias("r")).collect()
        assert [r.r for r in rows] == [round(r.v, digits) for r in rows]


def test_boxes_and_sizes(spark):
    row = one(
        spark, box=g.yolo_to_box(*lits(0.4, 0.25, 0.2, 0.3), F.lit(500), F.lit(400)), letter=g.letterbox_shape(F.lit(1920), F.lit(1080), 256),
        aligned=g.aligned_resize_size(F.lit(1920), F.lit(1080), F.lit(0.25)),
    )
    assert corners(row.box) == (150, 40, 250, 160)
    assert tuple(row.letter)[:4] == (256, 144, 256, 160)
    assert row.letter.scale_x == 256 / 1920 and row.letter.scale_y == 144 / 1080
    assert tuple(row.aligned) == (480, 272)


def test_bad_scale_is_an_error(spark):
    with pytest.raises(Exception, match="resize scale"):
        one(spark, s=g.aligned_resize_size(F.lit(100), F.lit(100), F.lit(0.0)))


def test_protection(spark):
    boxes = F.array(g.make_box(*lits(0, 0, 200, 20)), g.make_box(*lits(0, 0, 100, 40)))
    row = one(spark, p=g.protection_geometry(boxes, F.lit(1280), F.lit(720), 0.25, 8.0), q=g.protection_geometry(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"), F.lit(1280), F.lit(720), 0.25, 8.0))
    assert row.p.satisfied and row.p.scale > 0.25
    assert 20 * row.p.protected.height / 720 >= 8.0 - 1e-6
    smaller = row.p.protected.height - 16
    assert 20 * smaller / 720 < 8.0
    assert row.q.satisfied and row.q.scale == 0.25 and row.q.short_edge is None


def test_roi_crop(spark):
    crop = g.crop_window(F.lit(90), F.lit(75), F.lit(40), F.lit(30), F.lit(51), F.lit(44))
    assert tuple(one(spark, c=crop).c) == (31, 29, 71, 59)
    wide = g.crop_window(F.lit(10), F.lit(0), F.lit(40), F.lit(30), F.lit(51), F.lit(44))
    assert one(spark, c=wide).c is None


def test_crop_boxes(spark):
    boxes = F.array(g.make_box(*lits(33.5, 61.25, 52.5, 90.75)), g.make_box(*lits(0, 0, 5, 5)))
    row = one(spark, b=g.crop_boxes(boxes, g.make_box(20, 50, 70, 100)))
    assert [corners(b) for b in row.b] == [(13.5, 11.25, 32.5, 40.75)]


def test_quads_and_regions(spark):
    quad = F.array(*[F.array(*lits(*p)) for p in ((12, 6), (48, 6), (48, 18), (12, 18))])
    box = g.quad_to_bbox(g.quad_points(quad, 100, 100))
    row = one(spark, b=box, c=g.bbox_center(box), near=g.intersects_region(box, (40, 10, 90, 70)), far=g.intersects_region(box, (49, 19, 60, 30)))
    assert corners(row.b) == (12, 6, 48, 18) and tuple(row.c) == (30, 12) and row.near and not row.far
    with pytest.raises(Exception, match="four points"):
        one(spark, q=g.quad_points(F.array(F.array(*lits(1, 2))), 10, 10))


def test_stems(spark):
    row = one(spark, s=g.sample_stem(F.lit("film9"), F.lit(731)), p=g.parse_video_frame(F.lit("film9_f00000731")), n=g.parse_video_frame(F.lit("plain")))
    assert row.s == "film9_f00000731" and tuple(row.p) == ("film9", 731) and tuple(row.n) == (None, None)


def test_importance_weight_is_null_for_equal_priors(spark):
    row = one(spark, a=g.importance_weight(F.lit(True), F.lit(0.5), F.lit(0.5)), b=g.importance_weight(F.lit(True), F.lit(0.5), F.lit(0.2)))
    assert row.a is None and row.b == 0.4
