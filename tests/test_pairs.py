import itertools
import random

from pyspark.sql import functions as F

from annolake.operators import pairs as pr
from annolake.plans import schedule as sc

from test_text import brute_normalize, brute_similarity

SCHEMA = "root string, sample_id string, sample_idx long, has_subtitle boolean, segment_id string, video_id string, frame_index long, ocr_text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def three_scenes(spark):
    """One harbour film of three scenes (two, four and one frames), a second film, and a frame without a caption between."""
    scenes = [("quay", 2, "ferry to the island"), ("deck", 4, "mind the ropes"), ("bridge", 1, "captain only")]
    rows, at = [], 0
    for name, frames, caption in scenes:
        for _ in range(frames):
            rows.append(("port", f"p{at}", at, True, name, "harbour", at * 5, caption))
            at += 1
    rows.append(("port", f"p{at}", at, False, "none", "harbour", at * 5, ""))
    rows.append(("port", f"p{at + 1}", at + 1, True, "deck", "storm", 0, "mind the waves"))
    return frame(spark, rows)


def test_selection_of_three_scenes(spark):
    pairs, counts = pr.select_pairs(three_scenes(spark), ocr_enabled=False)
    got = {(r.i, r.j, r.same) for r in pairs.collect()}
    deck = [2, 3, 4, 5, 8]  # a segment's frames are pairs across films too
    want = {(0, 1, True), *((i, j, True) for i, j in itertools.combinations(deck, 2))}
    want |= {(i, j, False) for i in (0, 1) for j in deck[:4]} | {(j, 6, False) for j in deck[:4]}
    assert got == want
    c = counts.first()
    assert (c.local_positive_pairs, c.local_negative_pairs, c.ocr_negative_pairs, c.skipped_pairs) == (11, 12, 0, 13)


def random_samples(n=70, seed=11):
    random.seed(seed)
    words = ["alpha caption", "bravo message", "这个放在这里", "这个放在那里", "xyz", "zzzz qqqq", "mnop", "delta echo", ""]
    rows = []
    for i in range(n):
        video = random.choice(["v1", "v2", None])
        rows.append((
            random.choice(["r1", "r2"]), f"s{i:03d}", i, random.random() < 0.8, f"g{i // 6 % 7}", video,
            random.choice([i, i, None]) if video else i, random.choice(words) + random.choice(["", "!", " a"]),
        ))
    return rows


def brute_selection(rows, maximum):
    positive = [r for r in rows if r[3]]
    lines = {}
    for r in positive:
        if r[5] is not None and r[6] is not None:
            lines.setdefault((r[0], r[5]), []).append((r[6], r[4]))
    near = set()
    for key, entries in lines.items():
        names = [s for _, s in sorted(entries)]
        near |= {(*key, frozenset(p)) for p in zip(names, names[1:]) if p[0] != p[1]}
    timed = lambda r: r[5] is not None and r[6] is not None
    same, local, far = [], [], []
    for a, b in itertools.combinations(positive, 2):
        if a[0] != b[0]:
            continue
        x, y = brute_normalize(a[7]), brute_normalize(b[7])
        similar = brute_similarity(x, y)
        if a[4] == b[4]:
            same.append((a[2], b[2]))
        elif timed(a) and timed(b) and a[5] == b[5] and (a[0], a[5], frozenset((a[4], b[4]))) in near:
            if not (x and y and (x == y or (similar or 0) >= 0.9)):
                local.append((a[2], b[2]))
        elif similar is not None and similar <= maximum:
            far.append((a[2], b[2]))
    return same, local, far


def test_selection_against_brute_force(spark):
    rows = random_samples()
    samples = frame(spark, rows).repartition(5)
    same, local, far = brute_selection(rows, 0.4)
    assert far and local
    unlimited = pr.ocr_negatives_in_order(samples, pr.UNLIMITED, 0.4, first_window=64)
    # A frame without an index is outside every timeline, as is its pair with a timed neighbour.
    assert sorted((r.i, r.j) for r in unlimited.collect()) == sorted(far)
    pairs, counts = pr.select_pairs(samples, maximum=0.4, ratio=0.05)
    got = {k: sorted((r.i, r.j) for r in v) for k, v in itertools.groupby(sorted(pairs.collect(), key=lambda r: (r.same, r.source)), key=lambda r: (r.same, r.source))}
    budget = max(1, round(len(local) * 0.05 / 0.95))
    assert got[True, "local"] == sorted(same) and got[False, "local"] == sorted(local)
    assert got[False, "ocr"] == sorted(far)[:budget]
    c = counts.first()
    assert c.skipped_pairs == 70 * 69 // 2 - len(same) - len(local) - budget


def test_rank_addressed_sample(spark):
    rows = random_samples(90, 4)
    samples = frame(spark, rows)
    _, _, far = brute_selection(rows, 0.4)
    take = lambda epoch: sorted((r.i, r.j) for r in pr.ocr_negative_sample(samples, 20, 0.4, 3, epoch).collect())
    first = take(1)
    assert len(set(first)) == 20 and set(first) <= set(far)
    assert take(1) == first and take(2) != first
    # More than exist: the pool whole, then shuffled passes of it.
    refilled = [(r.i, r.j) for r in pr.ocr_negative_sample(samples, 2 * len(far) + 5, 0.4, 3, 1).collect()]
    assert len(refilled) == 2 * len(far) + 5 and set(refilled) == set(far) and {refilled.count(p) for p in far} == {2, 3}


def test_hot_segment_is_whole(spark):
    rows = [("r", f"s{i}", i, True, "hot" if i % 3 else f"g{i}", "v", i, "t") for i in range(90)]
    got = pr.positive_pairs(frame(spark, rows))
    assert got.count() == 60 * 59 // 2 and got.filter("i >= j").count() == 0 and got.distinct().count() == got.count()


def schedule_samples(spark):
    texts = ["winter harbour", "seven quiet owls", "red ticket office"]
    return frame(spark, [("r", f"s{k}_{o}", k * 4 + o, True, f"seg-{k}", "v", k * 100 + o, texts[k]) for k in range(3) for o in range(4)])


def test_schedule_covers_and_fits(spark):
    samples = schedule_samples(spark)
    plan = sc.pair_epoch_schedule(samples, 4, seed=1, epoch=0, ocr_enabled=False).collect()
    same = [(r.i, r.j) for r in plan if r.same]
    assert len(same) == len(set(same)) == 12 and len({(r.i, r.j) for r in plan if not r.same}) == 12
    assert {x for p in same for x in p} == set(range(12))
    assert {(0, 3), (4, 7), (8, 11)} <= set(same)
    members = {}
    for r in plan:
        members.setdefault(r.batch_id, set()).update((r.i, r.j))
    assert max(map(len, members.values())) <= 4
    listed = {r.batch_id: r.members for r in sc.batch_members(sc.pair_epoch_schedule(samples, 4, seed=1, epoch=0, ocr_enabled=False)).collect()}
    assert {b: set(m) for b, m in listed.items()} == members and all(len(set(m)) == len(m) for m in listed.values())
    assert all((listed[r.batch_id][r.i_at], listed[r.batch_id][r.j_at]) == (r.i, r.j) for r in plan)
    stats = sc.schedule_stats(sc.pair_epoch_schedule(samples, 4, seed=1, epoch=0, ocr_enabled=False), samples).first()
    assert (stats.positive_pairs, stats.negative_pairs, stats.covered_rois, stats.total_rois) == (12, 12, 12, 12)


def test_schedule_mixes_sources(spark):
    samples = schedule_samples(spark)
    plan = sc.pair_epoch_schedule(samples, 4, seed=1, epoch=0, maximum=0.9, ocr_ratio=0.5).collect()
    sources = [r.source for r in plan if not r.same]
    assert len(sources) == 12 and set(sources) == {"local", "ocr"}
    other = sc.pair_epoch_schedule(samples, 4, seed=1, epoch=1, maximum=0.9, ocr_ratio=0.5).collect()
    assert sorted((r.i, r.j, r.batch_id) for r in plan) != sorted((r.i, r.j, r.batch_id) for r in other)


def test_adjacent_priority(spark):
    texts = ["这个放在这里", "这个放在那里", "completely different"]
    samples = frame(spark, [("r", f"s{k}", k, True, f"g{k}", "v", k * 10, texts[k]) for k in range(3)])
    ranked = pr.rank_local_negatives(pr.local_negative_pairs(samples), samples, 1, 1)
    top = pr.top_local_negatives(ranked, 1).collect()
    assert [(r.i, r.j) for r in top] == [(0, 1)]


def test_hardest_negatives_are_the_ranked_ones(spark):
    """The same pairs as ranking the whole pool gives."""
    draw = random.Random(9)
    words = ["harbour", "window", "lantern", "ticket", "orchard", "kitchen", "marble", "velvet"]
    rows = [
        ("r", f"s{i}", i, True, f"g{i // 3}", "v", i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 4))) + draw.choice(["", "字幕"])) for i in range(240)
    ]
    samples = frame(spark, rows)
    ranked = pr.rank_local_negatives(pr.local_negative_pairs(samples), samples, 3, 1).cache()
    for count in (1, 25, 100_000):
        want = {(r.i, r.j, round(r.overlap, 9), r.span) for r in pr.top_local_negatives(ranked, count).collect()}
        got = {(r.i, r.j, round(r.overlap, 9), r.span) for r in pr.hardest_local_negatives(samples, count, 3, 1).collect()}
        assert got == want and len(got) == min(count, ranked.count())


def test_positive_selection_takes_widest(spark):
    random.seed(2)
    rows, spans = [], {}
    for i in range(40):
        rows.append(("r", f"s{i}", i, True, f"g{i % 4}" if i < 39 else "lonely", "v", random.randint(0, 500), ""))
    chosen = sc.select_positive_pairs(frame(spark, rows), 1, 1).collect()
    got = {(r.i, r.j) for r in chosen}
    assert len(got) == len(chosen) == 39 and {x for p in got for x in p} == set(range(39))
    frames = {r[2]: r[6] for r in rows}
    segment = {r[2]: r[4] for r in rows}
    cover = {(r.i, r.j) for r in chosen if r.stage < 3}
    rest = sorted((abs(frames[a] - frames[b]) for a, b in itertools.combinations(range(39), 2) if segment[a] == segment[b] and (a, b) not in cover), reverse=True)
    assert sorted((r.span for r in chosen if r.stage == 3), reverse=True) == rest[: len(got) - len(cover)]


def test_refill(spark):
    pool = spark.range(5).withColumnRenamed("id", "k")
    rows = [r.k for r in pr.sample_with_refill(pool, ["k"], 12, 1, 1).collect()]
    assert len(rows) == 12 and sorted(set(rows)) == list(range(5)) and max(rows.count(k) for k in range(5)) == 3
    assert pr.sample_with_refill(pool, ["k"], 3, 1, 1).distinct().count() == 3


def test_budget_rules(spark):
    row = spark.range(1).select(
        pr.max_ocr_negatives(F.lit(3), F.lit(9), 0.5), pr.max_ocr_negatives(F.lit(0), F.lit(0), 0.5), pr.max_ocr_negatives(F.lit(1), F.lit(1), 0.0),
        pr.negative_budget(F.lit(10), 0.5, F.lit(99)), pr.negative_budget(F.lit(10), 1.0, F.lit(99)), pr.negative_budget(F.lit(0), 0.5, F.lit(9)),
    ).first()
    assert tuple(row) == (3, 0, 0, 10, 99, 0)
