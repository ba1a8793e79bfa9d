import random
from zlib import crc32

from annolake.operators import sampling as sp

SCHEMA = "root string, sample_id string, sample_idx long, has_subtitle boolean, segment_id string"


def make(spark, n, seed=0, roots=3):
    random.seed(seed)
    rows = [(f"/data/r{random.randint(0, roots - 1)}", f"s{i:03d}", i, random.random() < 0.6, f"g{random.randint(0, n // 3)}") for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


key = lambda r: crc32(f"{r[0].split('/')[-1]}/{r[1]}".encode())


def ids(df):
    return sorted(r.sample_id for r in df.collect())


def test_spread_is_crc_order(spark):
    rows, df = make(spark, 80)
    got = [r.sample_id for r in sp.spread_order(df).orderBy("position").collect()]
    assert got == [r[1] for r in sorted(rows, key=key)]


def take(pool_a, pool_b, a, b, total):
    first, second = pool_a[:a], pool_b[:b]
    first += pool_a[len(first):][: total - len(first) - len(second)]
    second += pool_b[len(second):][: total - len(first) - len(second)]
    return first, second


def test_class_quota_with_refill(spark):
    rows, df = make(spark, 60)
    for total, ratio in ((20, 0.3), (50, 0.9), (50, 0.0), (100, 0.5)):
        pos, neg = (sorted([r for r in rows if r[3] == f], key=key) for f in (True, False))
        empty = min(total, round(total * ratio))
        a, b = take(pos, neg, total - empty, empty, total)
        assert ids(sp.limit_by_class(df, total, ratio)) == sorted(r[1] for r in a + b)
    assert ids(sp.limit_by_class(df, 7, None)) == [f"s{i:03d}" for i in range(7)]


def test_round_robin_and_interleave(spark):
    rows, df = make(spark, 90, 2)
    for total, ratio in ((30, 0.3), (45, 0.7), (60, 0.1)):
        robin = {}
        for flag in (True, False):
            queues = {root: sorted([r for r in rows if r[3] == flag and r[0] == root], key=key) for root in sorted({r[0] for r in rows})}
            robin[flag] = [q[i] for i in range(90) for q in queues.values() if i < len(q)]
        empty = min(total, round(total * ratio))
        a, b = take(robin[True], robin[False], total - empty, empty, total)
        order, spare, gap = [], list(b), max(1, len(a) // max(1, len(b)))
        for i, r in enumerate(a, 1):
            order.append(r)
            if i % gap == 0 and spare:
                order.append(spare.pop(0))
        order += spare
        got = sp.interleave_classes(sp.limit_root_balanced(df, total, ratio, "has_subtitle"), "has_subtitle")
        assert [r.sample_id for r in got.orderBy("position").collect()] == [r[1] for r in order]


def test_segment_aware_cap(spark):
    rows = [("r", "a0", 0, True, "seg-a"), ("r", "a1", 1, True, "seg-a"), ("r", "b0", 2, True, "seg-b"), ("r", "e0", 3, False, "empty")]
    got = sp.limit_segment_aware(spark.createDataFrame(rows, SCHEMA), 3, 1 / 3).collect()
    assert sorted(r.segment_id for r in got) == ["empty", "seg-a", "seg-a"]


def test_segment_aware_cap_brute(spark):
    rows, df = make(spark, 80, 5)
    for total, ratio in ((21, 0.3), (40, 0.25), (60, 0.9)):
        groups = {}
        for r in rows:
            if r[3]:
                groups.setdefault(r[4], []).append(r)
        order = sorted(groups.items(), key=lambda g: crc32(f"{g[1][0][0].split('/')[-1]}/{g[0]}".encode()))
        empty = min(total, round(total * ratio))
        want, picked = total - empty, []
        for paired in (True, False):
            for _, group in order:
                if (len(group) >= 2) == paired:
                    room = want - len(picked)
                    if len(group) <= room or room >= 2:
                        picked += sorted(group, key=key)[:room]
        picked = picked[:want] + sorted([r for r in rows if not r[3]], key=key)[:empty]
        rest = sorted([r for r in rows if r not in picked], key=key)
        picked += rest[: total - len(picked)]
        assert ids(sp.limit_segment_aware(df, total, ratio)) == sorted(r[1] for r in picked)


def test_donors(spark):
    rows = [("a", "p0", 0, True, ""), ("a", "n0", 1, False, ""), ("a", "n1", 2, False, ""), ("a", "n2", 3, False, ""), ("b", "p1", 4, True, ""), ("c", "n3", 5, False, "")]
    got = {r.sample_id: (r.first_donor, r.second_donor) for r in sp.assign_donors(spark.createDataFrame(rows, SCHEMA)).collect()}
    for root, name, pool in (("a", "p0", ["n0", "n1", "n2"]), ("b", "p1", ["n0", "n1", "n2", "n3"])):
        start = crc32(f"{root}/{name}".encode()) % len(pool)
        assert got[name] == (pool[start], pool[(start + len(pool) // 2) % len(pool)])
    none = sp.assign_donors(spark.createDataFrame(rows[:1], SCHEMA)).first()
    assert none.first_donor is None and none.second_donor is None
