"""The pipeline, stage by stage, against brute force on each stage's own input."""

import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_near_lines import brute_components, brute_lines

import corpus_pipeline
from annolake.llm import minhash, quality
from annolake.llm.common import row_key
from annolake.llm.mixing import mix_sources


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, junk, near copies, repeated lines; null and empty texts, a null id, null source and language."""
    draw = random.Random(13)
    line = lambda n: " ".join(f"word{draw.randint(0, 300)}" for _ in range(n))
    common, rows = line(12), []
    for k in range(150):
        if k % 6 == 0:
            text = " ".join(f"%{draw.randint(0, 60)}" for _ in range(40))
        elif k % 10 == 1 and k % 6 != 1:  # not next to junk
            words = rows[-1][1].split(" ") if rows and rows[-1][1] else ["x"]
            text = " ".join([*words[:-1], "changed"])
        else:
            text = "\n".join([line(30), *([common] if k % 4 == 0 else []), line(25)])
        rows.append((k, text, "en", draw.choice(["a", "b", None]), len(text)))
    rows += [(500, None, None, "a", None), (501, "", "en", "b", 0), (None, line(20), "en", "a", 1)]
    home = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{home}/documents.parquet")
    labels = [(k, int(k % 6 != 0), 0) for k in range(0, 150) if k % 10 != 1 or k % 6 == 1]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, order, texts = docs.columns, [name for name, _ in corpus_pipeline.STAGES], {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        after = docs.collect()
        if name != order[-1]:
            assert docs.columns == columns
        got = {r.doc_id: r.text for r in after} if name != order[-1] else {}
        if name == "quality":
            assert {i for i in before if i is None or i >= 150 or i % 6} == set(got) and len(after) == len(got)
        elif name == "line dedup":
            low = {(-1 if i is None else i): r.text for i, r in before.items()}
            kept = brute_lines(low.items())
            want = {}
            for i, text in low.items():
                lines = (text or "").split("\n")
                left = [x for k, x in enumerate(lines) if kept.get((i, k), True)]
                if any((i, k) in kept for k in range(len(lines))) and not any(kept.get((i, k)) for k in range(len(lines))):
                    continue
                want[None if i < 0 else i] = text if text is None else "\n".join(left)
            assert got == want and len(after) == len(got)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        elif name == "near-duplicates":
            parts = brute_components([(i, r.text) for i, r in before.items() if i is not None], 5)
            assert {i for i in got if i is not None} == {i for i, (_, part) in parts.items() if part == i}
            assert len(after) == len(got) and all(got[i] == before[i].text for i in got)
        elif name == "source mix":
            frame = spark.createDataFrame(list(before.values()), "doc_id long, text string, lang string, source string, n_chars long")
            copies = {r.doc_id: r.copies for r in mix_sources(frame).collect()}
            assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in copies.items() if n})
            texts = got
        else:
            with open(corpus_pipeline.VOCABULARY, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert all(list(r.ids) == library.encode_ordinary(texts[r.doc_id] or "") and r.exact for r in after)
            assert len(after) == sum(n for n in copies.values())


def test_run_equals_the_stages(spark, folder):
    once = sorted((str(r.doc_id), list(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
    assert once == sorted((str(r.doc_id), list(r.ids)) for r in docs.collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decisions_reach_only_their_row(spark, monkeypatch, tmp_path):
    """Two rows without id and two texts of one id: each is kept or dropped, and copied, by itself."""
    rows = [(None, "kept one", "en", "a", 8), (None, "dropped one", "en", "b", 11), (7, "dropped two", "en", "a", 11), (7, "kept two", "en", "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    decided = lambda docs, *_, **__: docs.select("doc_id", row_key("text").alias("_row"), docs.text.startswith("kept").alias("kept"))
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline.quality, "resample", decided)
    monkeypatch.setattr(corpus_pipeline.minhash, "near_duplicates", decided)
    for stage in (corpus_pipeline.good_quality, corpus_pipeline.one_of_each):
        assert sorted(r.text for r in stage(spark, docs, str(tmp_path)).collect()) == ["kept one", "kept two"]
    plan = docs.select("doc_id", "source", F.when(F.col("source") == "a", 1).otherwise(2).alias("copies"))
    monkeypatch.setattr(corpus_pipeline.mixing, "mix_sources", lambda *_: plan)
    assert Counter(r.text for r in corpus_pipeline.mixed(spark, docs, "").collect()) == {"kept one": 1, "dropped one": 2, "dropped two": 1, "kept two": 2}


def test_operators_tell_rows(spark):
    """The two operators give each row its own key."""
    docs = spark.createDataFrame([(None, "aa bb"), (7, "cc dd"), (7, "ee ff")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = sorted(tuple(map(str, r)) for r in docs.select("doc_id", row_key("text")).collect())
    for found in (quality.resample(docs, labels, rows_told=True), minhash.near_duplicates(docs, rows_told=True)):
        assert sorted((str(r.doc_id), str(r._row)) for r in found.collect()) == want
