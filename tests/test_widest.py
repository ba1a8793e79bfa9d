"""Coverage and widest pairs against all pairs, with unknown frames, ties and large segments."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from annolake.plans import schedule as sc

from test_pairs import frame


def _rows(n, segments, seed, frames, unknown):
    draw = random.Random(seed)
    return [
        ("r", f"s{i}", i, draw.random() < 0.95, f"g{draw.randrange(segments)}", "v", None if draw.random() < unknown else draw.choice(frames), "")
        for i in range(n)
    ]


def _span(frames, a, b):
    return 0 if frames[a] is None or frames[b] is None else abs(frames[a] - frames[b])


@pytest.mark.parametrize(
    ("n", "segments", "frames", "unknown", "seed"),
    [(60, 4, range(500), 0.0, 1), (70, 5, range(500), 0.3, 2), (50, 3, range(6), 0.2, 3), (40, 3, [5], 0.0, 4), (40, 3, range(9), 1.0, 5), (45, 20, range(100_000), 0.3, 6)],
)
def test_selection_against_all_pairs(spark, n, segments, frames, unknown, seed):
    rows = _rows(n, segments, seed, list(frames), unknown)
    chosen = sc.select_positive_pairs(frame(spark, rows), 1, 1).collect()
    own, at = {}, {r[2]: r[6] for r in rows}
    for r in rows:
        if r[3]:
            own.setdefault(r[4], []).append(r[2])
    own = {s: v for s, v in own.items() if len(v) > 1}
    every = [(a, b) for v in own.values() for a, b in itertools.combinations(sorted(v), 2)]
    got = [(r.i, r.j) for r in chosen]
    budget = min(len(every), sum(map(len, own.values())))
    assert len(set(got)) == len(got) == budget and set(got) <= set(every)
    assert {x for p in got for x in p} == {x for v in own.values() for x in v}
    assert all(r.span == _span(at, r.i, r.j) for r in chosen)
    for s, v in own.items():
        widest = max(_span(at, a, b) for a, b in itertools.combinations(v, 2))
        assert [r.span for r in chosen if r.stage == 0 and r.segment_id == s] == [widest]
    # No more than one pair of the coverage has a member that another one has already.
    for s, v in own.items():
        cover = [(r.i, r.j) for r in chosen if r.stage < 3 and r.segment_id == s]
        assert len(cover) == -(-len(v) // 2)
    cover = {(r.i, r.j) for r in chosen if r.stage < 3}
    rest = sorted((_span(at, a, b) for a, b in every if (a, b) not in cover), reverse=True)
    assert sorted((r.span for r in chosen if r.stage == 3), reverse=True) == rest[: budget - len(cover)]


def test_unknown_frames_span_nothing(spark):
    rows = [("r", f"s{k}", k, True, "g", "v", f, "") for k, f in enumerate([None, 1000, 1010, 1040])]
    got = {(r.i, r.j): r.span for r in sc.select_positive_pairs(frame(spark, rows), 1, 1).collect()}
    assert got[1, 3] == 40 and all(span == 0 for (i, _), span in got.items() if i == 0) and len(got) == 4


def test_many_segments_unfold_little(spark, monkeypatch):
    """2,000 segments of 500 rows: a million rows, 250 million pairs, and what is unfolded stays below twice the budget."""
    rows = spark.range(1_000_000).selectExpr(
        "'r' as root", "cast(id as string) as sample_id", "id as sample_idx", "true as has_subtitle", "concat('g', id div 500) as segment_id", "'v' as video_id",
        "case when id % 50 = 0 then null else (id % 500) * 7 + (id div 500) * (id % 3) end as frame_index", "'' as ocr_text",
    )
    unfolded = []
    plain = sc.exploded_range

    def counting(df, count, *args):
        unfolded.append(int(df.agg(F.sum(count)).first()[0] or 0))
        return plain(df, count, *args)

    monkeypatch.setattr(sc, "exploded_range", counting)
    chosen = sc.select_positive_pairs(rows, 1, 1)
    told = chosen.groupBy("stage").agg(F.count("*").alias("n"), F.min("span").alias("least")).collect()
    assert sum(r.n for r in told) == 1_000_000 and sum(unfolded) <= 2_000_000
    assert chosen.select("i", "j").distinct().count() == 1_000_000
