import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from annolake.functions.geometry import make_box
from annolake.operators import detection as dt
from annolake.operators.sweep import Sweep


def boxes(spark, rows):
    df = spark.createDataFrame(rows, "image_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    return df.select("image_id", "box_id", make_box("x1", "y1", "x2", "y2").alias("box"))


# Predictions, targets, and (right, wrong, missed): a near hit and a stray, parts side by side, parts one above the other, nothing.
CASES = [
    ([(100, 100, 200, 140), (300, 300, 340, 320)], [(105, 102, 205, 142)], (1, 1, 0)),
    ([(10, 10, 110, 30)], [(10, 10, 58, 30), (62, 10, 110, 30)], (1, 0, 0)),
    ([(0, 0, 50, 40)], [(0, 0, 50, 19), (0, 21, 50, 40)], (1, 0, 0)),
    ([], [(7, 7, 19, 12)], (0, 0, 1)),
    ([(7, 7, 19, 12)], [], (0, 1, 0)),
]


def test_matching_cases(spark):
    preds, targets, want = [], [], {}
    for image, (p, t, counts) in enumerate(CASES):
        preds += [(image, k, *map(float, b)) for k, b in enumerate(p)]
        targets += [(image, k, *map(float, b)) for k, b in enumerate(t)]
        want[image] = counts
    got = {r.image_id: (r.tp, r.fp, r.fn) for r in dt.evaluate_images(boxes(spark, preds), boxes(spark, targets), ["image_id"]).collect()}
    assert got == want


def test_merged_boxes_cover_and_stay(spark):
    """Every box lies in a merged one, merged edges are edges of boxes, copies change nothing, and merging again changes nothing."""
    random.seed(8)
    rows, plain = [], []
    for image in range(40):
        mine = []
        for _ in range(random.randint(1, 12)):
            x, y = random.randint(0, 900), random.randint(0, 500)
            mine.append((float(x), float(y), float(x + random.randint(1, 200)), float(y + random.randint(1, 40))))
        plain += [(image, k, *b) for k, b in enumerate(mine)]
        rows += [(image, k, *b) for k, b in enumerate(mine + random.choices(mine, k=6))]

    def merged(given):
        found = {}
        for r in dt.merge_adjacent_boxes(boxes(spark, given), ["image_id"]).collect():
            found.setdefault(r.image_id, []).append((r.x1, r.y1, r.x2, r.y2))
        return {k: sorted(v) for k, v in found.items()}

    got = merged(rows)
    assert got == merged(plain)
    assert got == merged([(image, k, *b) for image, own in got.items() for k, b in enumerate(own)])
    for image, own in got.items():
        given = [r[2:] for r in plain if r[0] == image]
        assert all(any(m[0] <= b[0] and m[1] <= b[1] and m[2] >= b[2] and m[3] >= b[3] for m in own) for b in given)
        assert all(m[at] in {b[at] for b in given} for m in own for at in range(4))
    assert sum(map(len, got.values())) < len(plain)


def test_merge_by_hand(spark):
    line = [(0, 0, 40, 10), (50, 1, 90, 11), (97, 0, 120, 10)]  # one after the other
    stack = [(500, 200, 560, 220), (505, 228, 565, 248)]  # one above the other
    far = [(0, 400, 30, 410), (200, 400, 230, 410)]  # a gap too wide
    rows = [(1, k, *map(float, b)) for k, b in enumerate(line + stack + far)]
    got = sorted((r.x1, r.y1, r.x2, r.y2) for r in dt.merge_adjacent_boxes(boxes(spark, rows), ["image_id"]).collect())
    assert got == [(0, 0, 120, 11), (0, 400, 30, 410), (200, 400, 230, 410), (500, 200, 565, 248)]


def test_candidate_pairs_meet_on_the_grid(spark):
    random.seed(1)
    make = lambda n: [(1, k, *(lambda x, y: (x, y, x + random.uniform(20, 900), y + random.uniform(20, 500)))(random.uniform(0, 800), random.uniform(0, 400))) for k in range(n)]
    a, b = make(30), make(30)
    got = {(r.pred_id, r.target_id): r.iou for r in dt.match_candidates(boxes(spark, a), boxes(spark, b), 0.3).collect()}
    want = {}
    for p in a:
        for t in b:
            inter = max(0, min(p[4], t[4]) - max(p[2], t[2])) * max(0, min(p[5], t[5]) - max(p[3], t[3]))
            union = (p[4] - p[2]) * (p[5] - p[3]) + (t[4] - t[2]) * (t[5] - t[3]) - inter
            if inter / union >= 0.3:
                want[p[1], t[1]] = inter / union
    assert got == pytest.approx(want)


def test_candidate_pairs_of_crowded_and_other_images(spark):
    draw = random.Random(5)

    def make(image, count):
        at = [(draw.choice([0.0, 30.0, 250.0, 700.0]), draw.choice([0.0, 20.0, 300.0])) for _ in range(count)]
        return [(image, k, x, y, x + draw.choice([40.0, 60.0, 300.0]), y + draw.choice([40.0, 300.0])) for k, (x, y) in enumerate(at)]

    # Images of no, few, exactly `few` and more targets; more of them on one side than on the other; boxes without a corner or an image.
    targets = make(1, 3) + make(2, 4) + make(3, 5) + make(4, 40) + [(2, 90, None, 0.0, 40.0, 40.0), (None, 0, 0.0, 0.0, 40.0, 40.0)]
    predictions = make(1, 30) + make(2, 9) + make(3, 25) + make(4, 40) + make(5, 6) + [(3, 90, 0.0, 0.0, None, 40.0), (None, 0, 0.0, 0.0, 40.0, 40.0)]
    want = {}
    for p in predictions:
        for t in targets:
            if p[0] == t[0] is not None and None not in p + t:
                inter = max(0, min(p[4], t[4]) - max(p[2], t[2])) * max(0, min(p[5], t[5]) - max(p[3], t[3]))
                want[p[0], p[1], t[1]] = inter / ((p[4] - p[2]) * (p[5] - p[3]) + (t[4] - t[2]) * (t[5] - t[3]) - inter)
    both = boxes(spark, predictions), boxes(spark, targets)
    for threshold in (0.4, 0.0):
        found = dt.match_candidates(*both, threshold, few=4).collect()
        got = {(r.image_id, r.pred_id, r.target_id): r.iou for r in found}
        assert len(found) == len(got) and got == pytest.approx({k: v for k, v in want.items() if v >= threshold})
    assert {k[0] for k, v in want.items() if v >= 0.4} == {1, 2, 3, 4}


def test_boxes_are_moved_once(spark, tmp_path):
    """Where no image is crowded, both sides of the query read one exchange of the table, and none is laid on the grid."""
    rows = [(k % 90, k % 7, k, k * 3, float(k), 20.0 + k % 30, 0.0, 0.0, "N", "O", None) for k in range(400)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, "
    spark.createDataFrame(rows, columns + "l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = contract.queries()["match_candidates"](spark, str(tmp_path))
        assert found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("+- Exchange") == 1 and "ReusedExchange" in plan


def test_candidate_groups(spark):
    random.seed(6)
    rows = []
    for image in range(30):
        for k in range(14):
            h = random.choice([20.0, 22.0, 24.5, 30.0, 40.0])
            rows.append((image, k, float(random.randint(0, 600)), float(random.choice([100, 104, 109, 115, 300])), float(random.randint(5, 150)), h))
        rows += [(image, 14 + k, *rows[-1 - k][2:]) for k in range(2)]
    df = spark.createDataFrame(rows, "image_id long, line_index long, x double, y double, width double, height double")
    got = sorted((r.image_id, r.group, r.members) for r in dt.merge_candidate_groups(df).collect())
    want = []
    for image in range(30):
        mine = [r for r in rows if r[0] == image]
        label = {r[1]: r[1] for r in mine}
        def close(a, b):
            avg = (a[5] + b[5]) / 2
            return (abs(a[5] - b[5]) / avg <= 0.22 and abs(a[3] + a[5] / 2 - b[3] - b[5] / 2) / avg <= 0.45
                    and max(0.0, max(a[2], b[2]) - min(a[2] + a[4], b[2] + b[4])) <= avg * 0.65)
        edges = [(a[1], b[1]) for a in mine for b in mine if a[1] < b[1] and close(a, b)]
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    changed = True
        for name in set(label.values()):
            size = list(label.values()).count(name)
            if size > 1:
                want.append((image, name, size))
    assert got == sorted(want)


def test_reading_order():
    assert list(dt.reading_positions(np.array([(71, 20, 95, 31), (15, 21, 44, 33)]))) == [1, 0]
    assert list(dt.reading_positions(np.array([(3, 80, 19, 91), (55, 31, 80, 41), (12, 30, 40, 42), (70, 81, 88, 90)]))) == [2, 1, 0, 3]
    assert len(dt.reading_positions(np.empty((0, 4)))) == 0


def swept(rows, gap=0.65, tall=0.22, center=0.45):
    """Groups by ``Sweep`` as (id, members), and the most boxes that were open at once."""
    sweep, found, most = Sweep(gap, tall, center), [], 0
    for row in sorted(rows, key=lambda r: r[2]):
        found += sweep.close_before(row[2])
        sweep.add(*row)
        most = max(most, len(sweep.ends))
    found += sweep.close_before(float("inf"))
    return sorted((g.id, g.members) for g in found), most


def test_sweep_equals_all_pairs():
    draw = random.Random(7)
    for _ in range(60):
        rows = [(k, draw.choice([1, 1, 3]), draw.uniform(-300, 900), draw.uniform(0, 120), draw.uniform(0, 90), draw.choice([10, 10.7, 12.4, 12.5, 30, 0.3])) for k in range(40)]
        label = list(range(40))

        def close(a, b):
            avg = (a[5] + b[5]) / 2
            gap = max(0.0, max(a[2], b[2]) - min(a[2] + a[4], b[2] + b[4]))
            return abs(a[5] - b[5]) / avg <= 0.22 and abs(a[3] + a[5] / 2 - b[3] - b[5] / 2) / avg <= 0.45 and gap <= avg * 0.65

        for a in rows:
            for b in rows:
                if close(a, b):
                    low, high = sorted((label[a[0]], label[b[0]]))
                    label = [low if v == high else v for v in label]
        want = sorted((name, sum(r[1] for r in rows if label[r[0]] == name)) for name in set(label))
        assert swept(rows)[0] == want


def test_sweep_holds_only_what_is_open():
    """A chain of 20,000 boxes is one group, and few of them are open at a time."""
    found, most = swept([(k, 1, 30.0 * k, 5.0, 28.0, 20.0) for k in range(20_000)])
    assert found == [(0, 20_000)] and most < 5


def test_groups_with_nulls_and_copies(spark):
    rows = [
        (None, 0, 0.0, 0.0, 10.0, 10.0), (None, 1, 11.0, 0.0, 10.0, 10.0), (1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, None, 0.0, 10.0, 10.0), (1, 2, None, 0.0, 10.0, 10.0),
        (1, 3, 0.0, 0.0, 10.0, 0.0), (1, 4, 0.0, 0.0, 10.0, None), (2, 7, 5.0, 5.0, 1.0, 10.0), (2, 3, 5.0, 5.0, 1.0, 10.0), (2, 5, 500.0, 5.0, 1.0, 10.0), (3, 1, float("nan"), 0.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "image_id long, line_index int, x double, y double, width double, height double").withColumn("group", F.lit("x"))
    got = {(r.image_id, r.group): (r.members, r.x, r.width) for r in dt.merge_candidate_groups(df).collect()}
    assert got == {(None, 0): (2, 0.0, 21.0), (1, 1): (2, None, None), (2, 3): (2, 5.0, 1.0)}
    assert dt.merge_candidate_groups(df.limit(0)).count() == 0
