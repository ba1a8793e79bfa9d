"""Exact dedup and source mixing: edge cases, oracles on the driver's tables."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from annolake.llm.exact import exact_duplicates
from annolake.llm.mixing import mix_sources, source_targets

SF = "/root/testdata/sf0.001"


def test_exact_edges(make_docs):
    long = "x" * 100_000
    rows = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "a b "), (6, long + "1"), (7, long + "2"), (8, long + "1"), (9, "é"), (9, "é"), (None, "a b")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(make_docs(rows)).collect()}
    assert got == {
        (1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True),
        (6, 8, 2, False), (7, 7, 1, True), (8, 8, 2, True), (9, 9, 2, True),
    }


def test_exact_carries_and_empty(make_docs):
    docs = make_docs([(1, "a"), (2, None)])
    got = {r.doc_id: r.sha for r in exact_duplicates(docs, carry={"sha": F.sha2(F.coalesce("text", F.lit("")), 256)}).collect()}
    assert got == {1: hashlib.sha256(b"a").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    assert exact_duplicates(make_docs([])).count() == 0


def test_exact_beyond_broadcast(make_docs, monkeypatch):
    monkeypatch.setattr("annolake.llm.common.BROADCAST_ROWS", 0)
    rows = [(k, f"text {k % 7}") for k in range(60)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(make_docs(rows)).collect()}
    for k, text in rows:
        same = [j for j, t in rows if t == text]
        assert got[k] == (max(same), len(same))


def test_targets_water_filling(spark):
    rows = [("=a", "a", 10), ("=b", "b", 1000), ("=c", "c", 500), ("", None, 100), ("=d", "d", 0)]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "_key string, source string, source_size long")).collect()}
    assert got["a"] == 20 and got["d"] == 0 and abs(sum(got.values()) - 1.5 * 1610) < 1e-6
    sizes, weight = {r[1]: r[2] for r in rows}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    level = max(got[s] / weight[s] for s in got if got[s] < 2 * sizes[s])
    for s in got:
        assert got[s] == pytest.approx(min(2 * sizes[s], level * weight[s]))


def test_mix_meets_targets(make_docs):
    draw = random.Random(4)
    rows = [(k, " ".join("w" * draw.randint(0, 30)), "en", draw.choice(["a", "b", "c", None])) for k in range(600)]
    rows += [(601, None, "en", "a"), (602, "", "en", None), (5, "again", "en", "a"), (None, "no id", "en", "b")]
    got = mix_sources(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.source == source]
        assert all(0 <= r.copies <= 2 for r in own)
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 31
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(make_docs(rows)).collect()), key=str)


def test_mix_edges(make_docs):
    assert mix_sources(make_docs([])).count() == 0
    blank = mix_sources(make_docs([(1, None), (2, "  \t")])).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in blank] == [(0, 0, 0.0, 0)] * 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_queries_are_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    for n in range(1, 14):
        assert any(name.startswith(f"op{n}_") for name in names)
    assert "pipeline" in names
