"""Ordered helpers over sparse blocks, with blocks cut into few chapters, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from annolake.operators import ordered as od


@pytest.fixture
def few_chapters(monkeypatch):
    monkeypatch.setattr(od, "CHAPTERS", 5)


def _rows(n, seed):
    draw = random.Random(seed)
    return [(draw.choice(["a", "a", "b", None]), draw.randint(0, 40) * 1_048_576 + draw.randint(0, 9), k, draw.choice([1, 2, None])) for k in range(n)]


def test_running_sums_over_sparse_blocks(spark, few_chapters):
    rows = _rows(300, 1) + [("a", None, 900, 5), ("b", None, 901, 7)]
    df = spark.createDataFrame(rows, "g string, at long, k long, v long")
    got = od.running_sums(df, ["at", "k"], {"s": F.col("v"), "n": F.lit(1).cast("long")}, ["g"], od.index_block(F.col("at")), totals=True).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    assert len(got) == len(rows)
    for r in got:
        own = sorted((x for x in rows if x[0] == r.g), key=order)
        before = own[: [x[2] for x in own].index(r.k)]
        assert (r.s, r.n) == (sum(x[3] or 0 for x in before), len(before))
        assert (r.s_total, r.n_total) == (sum(x[3] or 0 for x in own), len(own))


def test_previous_over_sparse_blocks(spark, few_chapters):
    rows = _rows(300, 2) + [("a", None, 900, 5)]
    df = spark.createDataFrame(rows, "g string, at long, k long, v long")
    got = od.with_previous(df, ["at", "k"], ["v", "k"], ["g"], od.index_block(F.col("at"))).collect()
    for r in got:
        own = sorted((x for x in rows if x[0] == r.g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        at = [x[2] for x in own].index(r.k)
        assert (r.prev_v, r.prev_k) == ((own[at - 1][3], own[at - 1][2]) if at else (None, None))


def test_no_window_over_more_than_a_chapter(spark, few_chapters):
    """With one block per video, as in ``conv_id * 1048576 + turn``, a chapter has its share of the blocks and no more."""
    blocks = spark.range(1000).selectExpr("'g' as g", "id * 16 as _block", "1L as _b_n")
    sizes = [r["count"] for r in od._with_chapter(blocks).groupBy("_chapter").count().collect()]
    assert len(sizes) == 5 and max(sizes) <= 1000 // 5 + 20


def test_located(spark):
    draw = random.Random(3)
    points = [(draw.choice("ab"), draw.randint(5, 500), k) for k in range(60)]
    asked = [(draw.choice("abc"), draw.randint(0, 520), -k) for k in range(80)]
    got = od.located(
        spark.createDataFrame(points, "g string, at long, k long"), spark.createDataFrame(asked, "g string, at long, q long"), ["g"], "at", F.shiftright("at", 6),
    ).collect()
    want = set()
    for g, at, q in asked:
        before = [p for p in points if p[0] == g and p[1] <= at]
        if before:
            want.add((g, at, q, max(before, key=lambda p: p[1:])[2]))
    assert {(r.g, r.at, r.q, r.p_k) for r in got} == want
