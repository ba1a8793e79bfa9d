"""Trained operators: edges, gradients, held-out accuracy; top-k search and lexicon against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.llm import langid, lexicon, quality, topk, toxicity
from annolake.llm.labelled import remainder

SF = "/root/testdata/sf0.01"
driver_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lexicon_equals_edit_distance():
    draw = random.Random(5)
    terms = ["cab", "abcab", "bacca", "abcabcabcabc", "cccccccccccccc", "über"]
    words = ["".join(draw.choice("abcxü") for _ in range(draw.randint(1, 15))) for _ in range(3000)]
    words += [t[:k] + draw.choice(["", "x", "ab"]) + t[k + draw.randint(0, 2) :] for t in terms for k in range(len(t))]
    words = [w for w in words if w]
    points = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    starts, ends, _ = lexicon.lettered_words(points)
    got = lexicon.Lexicon(terms).match(points, starts, ends)
    for word, found in zip(words, got.tolist(), strict=True):
        costs = [edits(word, t) for t in terms]
        allowed = [c for c, t in zip(costs, terms, strict=True) if c <= lexicon.edits_allowed(t)]
        assert (found >= 0) == bool(allowed)
        if allowed:
            assert found % 3 == min(allowed) == costs[found // 3]


def test_words_lose_outer_marks():
    points = np.frombuffer("«Hi!!  (a-b) ## x".encode("utf-32-le"), np.uint32)
    starts, ends, _ = lexicon.lettered_words(points)
    assert ["".join(map(chr, points[a:b])) for a, b in zip(starts, ends, strict=True)] == ["Hi", "a-b", "", "x"]


def test_toxicity_context_and_misspelling(spark, make_docs):
    draw = random.Random(6)
    clean = lambda: " ".join(f"w{draw.randint(0, 50)}" for _ in range(20))
    rows = [(k, clean() + (" vermin " if k % 4 == 0 else " ") + clean()) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(make_docs(rows), labels, F.lit(True))
    assert model.terms == ["vermin"]
    asked = [(1, "you vermin"), (2, 'he said "vermin" once'), (3, "vermjn here"), (4, "nothing"), (5, None), (6, ""), (7, "VERMIN!!!")]
    got = {r.doc_id: r for r in toxicity.score(make_docs(asked), model).collect()}
    assert got[1].score > 0.3 and got[3].score > 0.3 and got[7].score > 0.3
    assert got[2].score < got[1].score
    assert got[4].score == got[5].score == got[6].score < 0.3
    assert list(got[3].terms) == ["vermin"]


def test_toxicity_without_labels(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(make_docs([(1, "a")]), labels, F.lit(True))
    got = toxicity.score(make_docs([(1, "a"), (1, "a"), (None, None)]), model).collect()
    assert len(got) == 3 and all(0 <= r.score < 0.3 for r in got)
    assert toxicity.score(make_docs([]), model).count() == 0


@driver_tables
def test_toxicity_held_out(spark):
    import __spark_entry__ as contract

    found = contract.queries()["op6_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((found.predicted == 1) & (found.toxic == 0)).sum() <= 0.03 * len(found)
    assert ((found.predicted == 1) & (found.toxic == 1)).sum() >= 0.6 * (found.toxic == 1).sum()


def test_network_gradients():
    draw = np.random.default_rng(0)
    layer, steps = langid.Direction(draw), draw.integers(0, 5, (6, 3)).astype(np.uint8)
    layer.inputs, layer.recurrent = layer.inputs.astype(np.float64), layer.recurrent.astype(np.float64)
    slope = draw.standard_normal((6, 3, langid.UNITS)).astype(np.float32)
    trace: list = []
    layer.run(steps, trace)
    g_in, g_rec = layer.back(steps, trace, slope)
    for value, grad in ((layer.inputs, g_in), (layer.recurrent, g_rec)):
        for _ in range(12):
            at = tuple(draw.integers(0, min(s, 5)) for s in value.shape)
            old, sides = value[at], []
            for d in (1e-2, -1e-2):
                value[at] = old + d
                sides.append(float((layer.run(steps) * slope).sum()))
            value[at] = old
            assert (sides[0] - sides[1]) / 2e-2 == pytest.approx(grad[at], abs=0.03)


@driver_tables
def test_language_held_out(spark):
    import __spark_entry__ as contract

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = contract.queries()["op8_language"](spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() >= 0.95 and found.score.between(0, 1).all()


def test_language_edges(make_docs):
    draw = random.Random(10)
    say = lambda words: " ".join(draw.choice(words.split()) for _ in range(60))
    english, french = "the cat and dog which with then that thing", "le chat et chien que dans une est aussi très"
    rows = [(k, say(english if k % 2 else french), "en" if k % 2 else "fr", "a") for k in range(60)]
    network = langid.fit(make_docs(rows), F.coalesce(remainder("doc_id", 3) != 1, F.lit(False)))
    asked = [(1, None), (2, ""), (3, "12 ?!"), (4, "the dog and the cat"), (5, "le chien et le chat"), (None, "the cat " * 9000)]
    got = {r.doc_id: (r.language, r.score) for r in langid.identify(make_docs(asked), network).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "fr", None: "en"}
    assert got[1][1] == 0 and 0.5 < got[4][1] <= 1
    assert langid.fit(make_docs([(1, "a b", None, "a")]), F.lit(True)) is None
    assert [r.language for r in langid.identify(make_docs([(1, "a")]), None).collect()] == ["und"]
    assert langid.identify(make_docs([]), network).count() == 0


def test_quality_separates(spark, make_docs):
    draw = random.Random(8)
    good = lambda: " ".join(f"word{draw.randint(0, 80)}" for _ in range(draw.randint(20, 200)))
    junk = lambda: " ".join(f"%{draw.randint(0, 80)}" for _ in range(draw.randint(20, 200)))
    rows = [(k, junk() if k % 5 == 0 else good()) for k in range(400)] + [(900, None), (901, ""), (None, good())]
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(200)], "doc_id long, quality int")
    got = quality.resample(make_docs(rows), labels).collect()
    assert len(got) == len(rows)
    judged = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert all(r.kept == (r.doc_id % 5 != 0) for r in judged)
    assert all(r.log_weight == 0 for r in got if r.doc_id in (900, 901))


def test_quality_without_labels(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality.resample(make_docs([(1, "a"), (2, None)]), labels).collect())
    assert quality.resample(make_docs([]), labels).count() == 0


def brute_top(ids, values, k, asked):
    want = []
    for i, v in asked:
        scored = sorted((-int(np.dot(v, w)), j) for j, w in zip(ids, values, strict=True) if j != i)[:k]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(want)


@pytest.mark.parametrize("spread", [2, 100, 10**9])
def test_top_k_brute_force(spark, spread):
    draw = np.random.default_rng(spread)
    values = draw.integers(-spread, spread + 1, (300, 8)).tolist()
    values[10] = values[20] = values[30]
    ids = draw.permutation(1000)[:300].tolist()
    frame = spark.createDataFrame(list(zip(ids, values, strict=True)), "vec_id long, vector array<long>")
    asked = frame.where(F.col("vec_id") % 5 == 0)
    found = topk.top_k_products(frame, asked, 5, block_rows=90, query_rows=20)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == brute_top(ids, values, 5, [(i, v) for i, v in zip(ids, values, strict=True) if i % 5 == 0])


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [0.5, 0.25]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (50, [0.5, -0.01]), (6, [1.0, 2.0, 3.0]), (0, [0.5, 0.25])]
    vectors = topk.scaled_floor(spark.createDataFrame(rows, schema), "vec_id", "embedding")
    got = topk.top_k_products(vectors, vectors.where(F.col("vec_id") % 50 == 0)).collect()
    product = 128 * 128 + 64 * -3
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 50, product), (50, 1, 0, product), (50, 2, 0, product)]
    empty = topk.scaled_floor(spark.createDataFrame([], schema), "vec_id", "embedding")
    assert topk.top_k_products(empty, empty).count() == 0


def test_lexicon_of_many_letters():
    """More letters than fit into a byte."""
    terms = ["".join(chr(0x4E00 + 4 * k + j) for j in range(4)) for k in range(90)]
    points = np.frombuffer(" ".join(terms).encode("utf-32-le"), np.uint32)
    starts, ends, _ = lexicon.lettered_words(points)
    assert len(set(lexicon.Lexicon(terms).match(points, starts, ends).tolist())) == len(terms)


def test_top_k_beyond_64_bits_raises(spark):
    big = spark.createDataFrame([(1, [30_000_000, -1]), (2, [400_000_000_000_000, 400_000_000_000_000])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k_products(big, big, k=1).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk.scaled_floor(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
