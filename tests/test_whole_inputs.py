"""Queries without SQL see whole texts and all boxes: a small fixture against values worked out by hand."""

from datetime import date

import pytest

import __spark_entry__ as contract

#: Neighbours of two segments of one conversation: equal starts only, then equal wholes, then two edits.
TEXTS = ["same start, but then a far longer end", "same start, other", "same start, other", "same start, another", "zzz", "qqq"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("whole"))
    turns = [(4, k + 1, "user", text) for k, text in enumerate(TEXTS)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{home}/conversations.parquet")
    # Order, part (cx is part * 7919 % 1000 / 1000), supplier, line, quantity, status.
    lines = [(1, 1000, 10, 1, 20.0, "F"), (1, 1500, 10, 2, 20.0, "O"), (2, 1500, 20, 1, 10.0, "O"), (3, 1100, 20, 1, 10.0, "F")]
    rows = [(o, p, s, n, q, 10.0, 0.0, 0.0, "N", status, date(2020, 1, 1)) for o, p, s, n, q, status in lines]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, f"{kinds}, l_returnflag string, l_linestatus string, l_shipdate date").write.parquet(f"{home}/lineitem.parquet")
    orders = [(o, 1, "O", 100.0, date(2020, 1, 1)) for o in (1, 2, 3)]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date"
    spark.createDataFrame(orders, kinds).write.parquet(f"{home}/orders.parquet")
    return home


def rows(spark, folder, name):
    return contract.queries()[name](spark, folder).collect()


def test_whole_texts_are_merged(spark, folder):
    got = {int(r.sample_id[-1]): r.segment_id for r in rows(spark, folder, "merge_exact_text")}
    # Turn 1 is segment 0, turns 2 and 3 segment 1, 4 and 5 segment 2, 6 segment 3: no two neighbours of different segments agree.
    assert got == {1: "v4_s0", 2: "v4_s1", 3: "v4_s1", 4: "v4_s2", 5: "v4_s2", 6: "v4_s3"}


def test_whole_texts_are_compared(spark, folder):
    got = {int(r.sample_id[-1]): r.near for r in rows(spark, folder, "near_duplicates")}
    # Their first four letters agree up to turn 4; "other" and "another" are two edits apart.
    assert got == {2: False, 3: True, 4: True, 5: False, 6: False}
    found = rows(spark, folder, "similar_candidates")
    assert [(r.left_text, r.right_text, r.match_type) for r in found] == [("samestart,other", "samestart,another", "text-near")]


def test_all_boxes_are_planned(spark, folder):
    plan = {(r.item_id, r.sample_type): r.has_subtitle for r in rows(spark, folder, "epoch_geometry_plan")}
    # Order 1 has its only label at cx 0, order 2 none, order 3 one.
    assert plan == {
        ("1", "full_frame"): True, ("1#crop1", "random_crop"): True, ("2", "full_frame"): False, ("2#crop1", "random_crop"): False, ("3", "roi"): True,
    }
    crop = next(r for r in rows(spark, folder, "random_crop_plan") if r.sample_id == "1" and r.crop_view == 1)
    assert crop.x1 == 0 and crop.x2 >= 128


def test_roi_spans_all_boxes(spark, folder):
    found = {r.image_id: r for r in rows(spark, folder, "prepare_roi")}
    # Unmasked (status O) boxes stand at cx 0.5, cy 0.1 and 0.2 and a quarter of their width: all outside the former window's cy.
    assert found[1].labels and found[2].labels and found[2].roi_width == 64
