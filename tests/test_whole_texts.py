"""Metric queries on small tables of documents and labels, against their SQL and values worked out by hand."""

import duckdb
import pytest

import __spark_entry__ as contract
from oracle import difference


def tables(spark, home, texts, quality):
    """Documents 1, 2, ... with these texts and labels."""
    documents = [(k + 1, text, "en", "web", 100 + 10 * k) for k, text in enumerate(texts)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{home}/documents.parquet")
    labels = [(k + 1, q, 0) for k, q in enumerate(quality)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{home}/labels.parquet")
    return home


def connected(home):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{home}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("quality", [(1, 1, 1), (0, 0, 0), (1, 0, 1)])
def test_segments_of_one_side(spark, tmp_path, quality):
    home = tables(spark, str(tmp_path), ["a", "b", "c"], quality)
    assert difference(spark, connected(home), "segment_presence_metrics", home) is None
    row = contract.queries()["segment_presence_metrics"](spark, home).first()
    assert (row.tail_gap_1pct is None) == (len(set(quality)) == 1) and row.segment_count == 3


def test_short_lines_of_whole_texts(spark, tmp_path):
    home = tables(spark, str(tmp_path), ["A long line\n...\nOh!\nno\r\n", "I\nwe", "", "Ab"], (1, 0, 1, 1))
    assert difference(spark, connected(home), "short_positive", home) is None
    found = {(r.sample_id, r.norm_text) for r in contract.queries()["short_positive"](spark, home).collect()}
    assert found == {("1_l2", "oh"), ("1_l3", "no"), ("4_l0", "ab")}


def test_drift_of_every_line(spark, tmp_path):
    home = tables(spark, str(tmp_path), ["A long line\nOh!\nno", "I\nwe", "xx", "Ab", "", "b", "of\ndocument seven"], (1, 0, 1, 1, 1, 0, 1))
    assert difference(spark, connected(home), "drift_metrics", home) is None
    row = contract.queries()["drift_metrics"](spark, home).first()
    # Eleven lines; the two of document 7 have no earlier score.
    assert row.drift_evaluable_count == 9 and row.short_drift_upper_tail_mean_1pct > 0
