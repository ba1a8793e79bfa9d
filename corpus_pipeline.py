"""A corpus pipeline: quality, repeated lines, near-duplicates, source mix, tokens. Each stage is one operator of ``annolake.llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm import bpe, linededup, minhash, mixing, quality
from annolake.llm.common import materialized, row_key

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Words of a shingle, and hundredths of the union that near-duplicates and repeated lines share.
SHINGLE_WORDS, SIMILAR = 5, 80
#: Weights of the sources, all words of the mix as a share of what is left, and how often a document may be taken.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling takes; the labels are those beside the documents."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    kept = quality.resample(docs, labels, rows_told=True).where("kept")
    return _semi(docs, kept)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line is similar to; documents of which nothing is left go."""
    left = linededup.without_repeats(docs, SIMILAR)
    empty = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))
    return left.where(~empty).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    kept = minhash.near_duplicates(docs, SHINGLE_WORDS, SIMILAR, rows_told=True).where("kept")
    return _semi(docs, kept)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    plan = mixing.mix_sources(docs, WEIGHTS, SHARE, CAP).where("copies > 0")
    # Documents that share an id or have none are taken by their own source's share.
    plan = plan.select(_name("doc_id").alias("_name"), F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), F.col("copies").alias("_copies")).distinct()
    own = docs.select(_whole(docs), _name("doc_id").alias("_name"), F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"))
    taken = own.join(plan, KEY_OF_PLAN)
    return taken.select("_whole", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_whole.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; ``exact`` says that they decode to its text."""
    encoded = bpe.encode(docs, VOCABULARY, offsets=False, decoded=True, checked=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.octet_length("decoded").alias("n_bytes"), "exact")


KEY_OF_PLAN = ["_name", "_source", "_none"]


def _name(column: str) -> Column:
    """The id as text, so that documents without one are found again too."""
    return F.coalesce(F.col(column).cast("string"), F.lit("none"))


def _whole(docs: DataFrame) -> Column:
    """All columns of a document in one, so that none clashes with a helper's."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole")


def _semi(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``kept`` (id and ``_row``)."""
    # Written first, so that no task scores texts and sorts them at the same time.
    names = materialized(kept.select(_name("doc_id").alias("_name"), "_row").distinct(), "kept")
    own = docs.select(_whole(docs), _name("doc_id").alias("_name"), row_key("text").alias("_row"))
    return own.join(names, ["_name", "_row"], "left_semi").select("_whole.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line dedup", new_lines),
    ("near-duplicates", one_of_each),
    ("source mix", mixed),
    ("tokens", tokens),
]
#: No SQL: hashed n-gram models, Gumbel keys and byte-pair merges are beyond it. tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialized(docs, f"stage{number}")
    return docs
