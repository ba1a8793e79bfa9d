import pytest
from pyspark.sql import functions as F

from annolake.operators import batches as bt

SCHEMA = "root string, sample_id string, sample_idx long, has_subtitle boolean, segment_id string"


def samples(spark, positives, negatives):
    rows = [("r", f"p{i}", i, True, f"g{i // 2}") for i in range(positives)]
    rows += [("r", f"n{i}", 100 + i, False, f"e{i}") for i in range(negatives)]
    return spark.createDataFrame(rows, SCHEMA)


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.batch, []).append(r)
    return out


def test_balanced(spark):
    df = samples(spark, 6, 10)
    plan = grouped(bt.balanced_batches(df, 4, 0.5, 1, 0))
    assert len(plan) == 4 and all(sum(r.has_subtitle for r in b) == 2 and len(b) == 4 for b in plan.values())
    positives = [r.sample_id for b in plan.values() for r in b if r.has_subtitle]
    assert len(positives) == 8 and len(set(positives)) == 6
    flat = lambda epoch: sorted(map(tuple, bt.balanced_batches(df, 4, 0.5, 1, epoch).collect()))
    assert flat(0) == flat(0) != flat(1)
    with pytest.raises(ValueError):
        bt.balanced_batches(df, 1, 0.5, 1, 0)


def test_segment_pairs(spark):
    df = samples(spark, 6, 10)
    plan = grouped(bt.segment_paired_batches(df, 4, 0.5, 1, 0))
    assert {r.sample_id for b in plan.values() for r in b} == {r.sample_id for r in df.collect()}
    assert all(sum(not r.has_subtitle for r in b) == 2 for b in plan.values())
    plan = grouped(bt.segment_paired_batches(samples(spark, 8, 8), 4, 0.5, 1, 0))
    for b in plan.values():
        ids = [int(r.sample_id[1:]) // 2 for r in b if r.has_subtitle]
        assert len(ids) == 2 and ids[0] == ids[1]


def test_segment_pairs_fill_with_unseen(spark):
    rows = [("r", f"p{i}", i, True, "g" if i < 4 else f"x{i}") for i in range(12)]
    plan = grouped(bt.segment_paired_batches(spark.createDataFrame(rows, SCHEMA), 6, 0.5, 3, 0))
    assert len(plan) == 2 and {r.sample_id for b in plan.values() for r in b} == {f"p{i}" for i in range(12)}


def test_macro_and_micro(spark):
    kinds = [(k, l) for k in bt.REQUIRED_TYPES for l in (True, False)]
    rows = [(f"i{n:03d}", *kinds[n % 6], 64 + 16 * (n % 3), 32) for n in range(75)]
    df = spark.createDataFrame(rows, "item string, sample_type string, has_subtitle boolean, output_width int, output_height int")
    macro = bt.mixed_macro_batches(df, 12, 1, 0)
    plan = grouped(macro)
    assert sorted(len(b) for b in plan.values()) == [12, 12, 12, 13, 13, 13]
    assert len({r.item for b in plan.values() for r in b}) == 75
    for b in plan.values():
        assert {(r.sample_type, r.has_subtitle) for r in b} == set(kinds)
    micro = bt.micro_batches(macro).collect()
    assert sum(r["items"] for r in micro) == 75 and all(len(r.members) == r["items"] for r in micro)
    with pytest.raises(RuntimeError):
        bt.mixed_macro_batches(df.filter("not (sample_type = 'roi' and has_subtitle) or item < 'i010'"), 12, 1, 0)
    with pytest.raises(Exception, match="one output size"):
        bt.mixed_macro_batches(df.withColumn("output_width", F.lit(64)), 12, 1, 0).collect()
