"""The rank-addressed pool of text negatives against pairs listed one by one."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from annolake.functions import unlike as un
from annolake.operators import pairs as pr
from annolake.operators import pool as pl
from annolake.plans import schedule as sc
from annolake.streaming import bank

from test_pairs import brute_selection, frame, random_samples
from test_text import brute_similarity


def test_shuffled_ranks_are_a_permutation():
    for total in (1, 2, 7, 64, 1000, 4097):
        out = pl.shuffled_ranks(np.arange(total), total, np.full(total, 5))
        assert sorted(out.tolist()) == list(range(total))
    assert pl.shuffled_ranks(np.arange(50), 1 << 60, np.full(50, 1)).max() < 1 << 60
    assert (pl.shuffled_ranks(np.arange(900), 900, np.full(900, 1)) != pl.shuffled_ranks(np.arange(900), 900, np.full(900, 2))).any()


def test_common_subsequence():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randint(0, 12))) for _ in range(2))
        best = max(n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if _inside(c, b))
        masks = {}
        for place, letter in enumerate(a):
            masks[letter] = masks.get(letter, 0) | 1 << place
        assert un.common_subsequence(masks, len(a), b) == best
        assert sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) <= best


def _inside(letters, text):
    at = iter(text)
    return all(c in at for c in letters)


def test_unlike_by_hand(monkeypatch):
    monkeypatch.setattr(un, "LETTERS", 7)
    draw = random.Random(2)
    word = lambda: "".join(draw.choice(draw.choice(["abc", "defgh", "日本語です", "🙂é"])) for _ in range(draw.randint(4, 30)))
    left, right = [word() for _ in range(40)], [word() for _ in range(50)]
    for maximum in (0.0, 0.2, 0.5, 0.8, 1.0):
        wanted = np.random.default_rng(3).random((40, 50)) < 0.8
        got = un.unlike(left, right, maximum, wanted)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                assert got[i, j] == (wanted[i, j] and brute_similarity(a, b) <= maximum)


def _listed(spark, rows, maximum):
    pool = pr.ocr_negative_pool(frame(spark, rows).repartition(5), maximum)
    every = spark.range(pool.total).selectExpr("0L as pass", "id as rank")
    return pool, [(r.i, r.j) for r in pool.at(every).collect()]


def test_pool_has_every_pair_once(spark, monkeypatch):
    """Exact count and exact content, with several blocks of texts and copies of texts across segments and videos."""
    monkeypatch.setattr(pl, "BLOCK_TEXTS", 4)
    for seed in (4,):
        rows = random_samples(110, seed)
        _, _, far = brute_selection(rows, 0.4)
        pool, got = _listed(spark, rows, 0.4)
        assert pool.total == len(far) and sorted(got) == sorted(far)


def test_pool_without_pairs(spark):
    rows = [("r", f"s{i}", i, True, "one", "v", i, f"caption {i}") for i in range(6)]
    pool = pr.ocr_negative_pool(frame(spark, rows), 0.9)
    assert pool.total == 0 and pool.draw(5, 1, 1).count() == 0
    assert pr.ocr_negative_pool(frame(spark, []), 0.9).total == 0


def test_large_root_unfolds_what_is_drawn(spark):
    """200,000 rows of one root, a third of them one text: the pool has billions of pairs, none listed."""
    n = 200_000
    letters = ["abcdefgh", "ijklmnop", "qrstuvwx", "01234567"]
    text = "concat(element_at(array({}), cast(id % 4 + 1 as int)), repeat(cast(id % 97 as string), 2))".format(", ".join(f"'{w}'" for w in letters))
    samples = spark.range(n).selectExpr(
        "'r' as root", "cast(id as string) as sample_id", "id as sample_idx", "true as has_subtitle", "concat('g', id div 10) as segment_id",
        "'v' as video_id", "id as frame_index", f"case when id % 3 = 0 then 'one common caption' else {text} end as ocr_text",
    )
    pool = pr.ocr_negative_pool(samples, 0.5)
    assert pool.total > 5_000_000_000
    drawn = pool.draw(500, 7, 1).collect()
    assert len({(r.i, r.j) for r in drawn}) == 500
    names = {r.sample_idx: (r.segment_id, r.ocr_text) for r in samples.where(samples.sample_idx.isin([x for r in drawn for x in (r.i, r.j)])).collect()}
    for r in drawn:
        (s, a), (u, b) = names[r.i], names[r.j]
        assert abs(int(s[1:]) - int(u[1:])) > 1 and brute_similarity(a.replace(" ", ""), b.replace(" ", "")) <= 0.5


def test_draws_without_counting_the_pool(spark, monkeypatch):
    """Text negatives come from a seeded order of all pairs, whole and each once; the pool is not counted for them."""
    rows = random_samples(90, 4)
    samples, (_, local, far) = frame(spark, rows).repartition(5), brute_selection(rows, 0.4)
    monkeypatch.setattr(pr, "text_negatives", None)
    found, have = pr.ocr_negatives_drawn(samples, len(far) + 1, 0.4, 3, 1, first_window=64)
    assert have == len(far) and sorted((r.i, r.j) for r in found.collect()) == sorted(far)
    some, have = pr.ocr_negatives_drawn(samples, 30, 0.4, 3, 1, first_window=64)
    some = {(r.i, r.j) for r in some.collect()}
    assert have == len(some) == 30 and some <= set(far)
    # A smaller draw is the beginning of a larger one, whatever its windows.
    few, _ = pr.ocr_negatives_drawn(samples, 10, 0.4, 3, 1, first_window=7)
    assert {(r.i, r.j) for r in few.collect()} < some
    plan = sc.pair_epoch_schedule(samples, 16, seed=3, epoch=1, maximum=0.4).collect()
    negatives = {s: [(r.i, r.j) for r in plan if not r.same and r.source == s] for s in ("local", "ocr")}
    assert negatives["ocr"] and set(negatives["ocr"]) <= set(far) and set(negatives["local"]) <= set(local)
    budget = sum(r.same for r in plan)
    share = min(len(far), round(budget * 0.3))
    taken = min(len(local), budget - share)
    assert {s: len(set(p)) for s, p in negatives.items()} == {"local": taken, "ocr": min(len(far), budget - taken)}


def test_rare_text_negatives_are_counted(spark, monkeypatch):
    rows = random_samples(60, 4)
    _, _, far = brute_selection(rows, 0.1)
    samples = frame(spark, rows)
    monkeypatch.setattr(pr, "COMPARED_ALL", 0)
    monkeypatch.setattr(pr, "COMPARED_EACH", 0)
    assert pr.ocr_negatives_drawn(samples, len(far), 0.1, 3, 1) is None
    got = [(r.i, r.j) for r in pr.ocr_negative_sample(samples, len(far), 0.1, 3, 1).collect()]
    assert sorted(got) == sorted(far)


def test_first_unlike_stops_when_it_has_enough(monkeypatch):
    """A row of the bank compares its text with as many earlier ones as it takes, in their order."""
    draw = random.Random(5)
    texts = ["".join(draw.choice(draw.choice(["abc", "defgh"])) for _ in range(12)) for _ in range(400)]
    far = [k for k, t in enumerate(texts) if brute_similarity("abcabdabcabe", t) <= 0.4]
    compared = []
    monkeypatch.setattr(bank, "unlike", lambda left, right, *rest: compared.extend(right) or un.unlike(left, right, *rest))
    for wanted in (1, 3, 20, len(far), 1 << 60):
        assert bank.first_unlike("abcabdabcabe", texts, 0.4, wanted, range(400)) == far[:wanted]
    compared.clear()
    bank.first_unlike("abcabdabcabe", texts, 0.4, 1, range(400))
    assert len(far) > 20 and len(compared) < 200


def test_ranked_local_negatives_by_bounds(spark):
    """With a count the same rows are on top, and others are left out before their overlap is worked out."""
    samples = frame(spark, random_samples(110, 6))
    pairs = pr.local_negative_pairs(samples)
    whole = pr.rank_local_negatives(pairs, samples, 7, 1)
    some = pr.rank_local_negatives(pairs, samples, 7, 1, 3)
    tell = lambda ranked: sorted(map(str, pr.top_local_negatives(ranked, 3).collect()))
    assert tell(some) == tell(whole) and some.count() < whole.count()


def test_windows_follow_the_hits(spark, monkeypatch):
    """The first text negatives, exactly, without unfolding many times the ranks that hold them."""
    rows = random_samples(110, 6)
    _, _, far = brute_selection(rows, 0.4)
    asked = []
    real = pr.exploded_range
    monkeypatch.setattr(pr, "exploded_range", lambda df, n, *rest: asked.append(df.agg(F.sum(n)).first()[0]) or real(df, n, *rest))
    got = pr.ocr_negatives_in_order(frame(spark, rows), 30, 0.4, first_window=8)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(far)[:30]
    ranks = [(a[2], b[2]) for a, b in itertools.combinations([r for r in rows if r[3]], 2)]
    assert sum(asked) < len(ranks)
