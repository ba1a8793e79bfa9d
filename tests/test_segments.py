import random

import pytest
from pyspark.sql import functions as F

from annolake.operators import segments as sg

SCHEMA = "root string, sample_id string, sample_idx long, has_subtitle boolean, segment_id string, ocr_text string, norm_text string, note string"


def items(spark, rows):
    """(has_subtitle, segment, text) rows of one root in order."""
    full = [("r", f"s{i}", i, bool(h), s, x, x, "n" if i == 3 else "") for i, (h, s, x) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def names(df):
    return [r.segment_id for r in df.orderBy("sample_idx").collect()]


def test_runs(spark):
    df = items(spark, [(1, "seg-a", ""), (0, "x", ""), (0, "y", ""), (1, "seg-b", "")])
    got = sg.segment_runs(df, block_rows=2).orderBy("run").collect()
    assert [(r.segment_id, r["count"], r.note) for r in got] == [("seg-a", 1, ""), ("__no_subtitle_1__", 2, ""), ("seg-b", 1, "n")]


def test_candidates_follow_thresholds(spark):
    df = items(spark, [(1, "a", "字幕识别结果aaaa"), (1, "b", "字幕识别结果bbbb"), (0, "c", ""), (1, "d", "same"), (1, "e", "same")])
    assert [r.match_type for r in sg.similar_candidates(df).collect()] == ["exact"]
    got = {r.left_id: r for r in sg.similar_candidates(df, 0.6, 4).collect()}
    assert set(got) == {"s0", "s3"} and got["s0"].edit_distance == 4 and got["s0"].similarity == 0.6


def brute_merge(rows):
    label, last = [s for _, s, _ in rows], None
    for i, (h, _, x) in enumerate(rows):
        if not h:
            last = None
            continue
        if x and last is not None and rows[last][2] == x and label[last] != label[i]:
            gone, kept = label[i], label[last]
            label = [kept if rows[k][0] and v == gone else v for k, v in enumerate(label)]
        last = i
    return label


def test_exact_merge_is_transitive(spark):
    random.seed(3)
    for n in (12, 60):
        rows = [(random.random() < 0.9, f"g{random.randint(0, n // 3)}", random.choice("ab ").strip()) for _ in range(n)]
        assert names(sg.merge_exact_text(items(spark, rows))) == brute_merge(rows)


def brute_replay(events):
    """Final name of each segment, those that were ever renamed, and how many events changed something."""
    label = {x: x for into, source, _ in events for x in (into, source)}
    moved, changed = set(), 0
    for into, source, _ in sorted(events, key=lambda e: e[2]):
        keep, gone = label[into], label[source]
        if keep != gone:
            changed += 1
            moved |= {x for x, v in label.items() if v == gone}
            label = {x: keep if v == gone else v for x, v in label.items()}
    return label, moved, changed


def test_merge_events_in_any_order(spark):
    """Chains forwards and backwards, stars, repeated and reversed events, times that grow or fall along a chain."""
    draw = random.Random(6)
    cases = {
        "up": [(f"n{k}", f"n{k + 1}", k) for k in range(40)],
        "down": [(f"n{k}", f"n{k + 1}", 40 - k) for k in range(40)],
        "back": [(f"n{k + 1}", f"n{k}", k) for k in range(40)],
        "star": [("hub" if k % 3 else f"n{k}", f"n{k}" if k % 3 else "hub", k) for k in range(30)],
        **{f"random{j}": [(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}", k) for k in draw.sample(range(99), 18)] for j in range(25)},
    }
    rows = [(root, into, source, at) for root, events in cases.items() for into, source, at in events]
    names = sg.resolve_merges(spark.createDataFrame(rows, "root string, into string, source string, at long"))
    got, changed = names.collect(), {r.root: r.merges for r in sg.merge_counts(names).collect()}
    for root, events in cases.items():
        events = [e for e in events if e[0] != e[1]]
        label, moved, merges = brute_replay(events)
        assert {r.segment_id: r.merged for r in got if r.root == root} == label, root
        assert {r.segment_id for r in got if r.root == root and r.moved} == moved and changed[root] == merges, root


def test_one_text_everywhere(spark):
    """All texts of a root equal: 3,000 segments become the first one, each of its items with a note but for the first."""
    n = 3000
    rows = spark.range(n).selectExpr(
        "'r' as root", "concat('s', id) as sample_id", "id as sample_idx", "true as has_subtitle", "concat('g', id) as segment_id",
        "'x' as ocr_text", "'x' as norm_text", "case when id = 5 then 'own' else '' end as note",
    )
    out = sg.merge_exact_text(rows).collect()
    assert {r.segment_id for r in out} == {"g0"} and len(out) == n
    notes = {r.sample_idx: r.note for r in out}
    assert notes[0] == "" and notes[5] == "own" and {v for k, v in notes.items() if k not in (0, 5)} == {sg.MERGED_BY_TEXT}
    assert [r.merges for r in sg.exact_text_merges(rows).collect()] == [n - 1]


def test_invalid_merges_raise(spark):
    df = items(spark, [(1, "a", ""), (0, "", ""), (1, "b", "")])
    ask = lambda *ids: spark.createDataFrame([("r", i) for i in ids], "root string, sample_id string")
    for wrong, fault in (("s1", "without subtitle"), ("nobody", "without subtitle"), ("s0", "no segment before")):
        with pytest.raises(Exception, match=fault):
            sg.merge_to_previous(df, ask("s2", wrong)).collect()
    pairs = spark.createDataFrame([("r", 0, "s0", "s1")], "root string, position int, left_id string, right_id string")
    with pytest.raises(Exception, match="without subtitle"):
        sg.merge_pairs(df, pairs).collect()


def test_split(spark):
    df = items(spark, [(1, "a", ""), (1, "a", ""), (0, "a", ""), (1, "a", ""), (1, "b", "")])
    cut = spark.createDataFrame([("r", "s1")], "root string, sample_id string")
    assert names(sg.split_segments(df, cut)) == ["a", "s1", "a", "s1", "b"]
    taken = items(spark, [(1, "s1", ""), (1, "s1", ""), (1, "s1__split_1", "")])
    assert names(sg.split_segments(taken, cut)) == ["s1", "s1__split_2", "s1__split_1"]


def test_merge_previous_and_pairs(spark):
    df = items(spark, [(1, "a", ""), (0, "", ""), (1, "b", ""), (1, "c", ""), (1, "b", "")])
    chosen = spark.createDataFrame([("r", "s2")], "root string, sample_id string")
    assert names(sg.merge_to_previous(df, chosen)) == ["a", "", "a", "c", "a"]
    pairs = spark.createDataFrame([("r", 0, "s3", "s2"), ("r", 1, "s0", "s4")], "root string, position int, left_id string, right_id string")
    assert names(sg.merge_pairs(df, pairs)) == ["a", "", "a", "a", "a"]


def test_adjacency_across_blocks(spark):
    rows = [("r", f"s{i}", i, True, "a" if i < 70_000 else "b", "v", i) for i in (0, 1, 65_535, 65_536, 140_000)]
    rows += [("r", "e", 9, False, "zzz", "v", 66_000), ("r", "n", 10, True, "q", None, 5), ("r", "m", 11, True, "q", "v", None)]
    df = spark.createDataFrame(rows, "root string, sample_id string, sample_idx long, has_subtitle boolean, segment_id string, video_id string, frame_index long")
    assert [tuple(r) for r in sg.adjacent_segments(df).collect()] == [("r", "v", "a", "b")]
