"""Registered queries of the corpus operators; contract columns are derived here from the operators' own results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from annolake.llm import bpe, fim, langid, quality, repair, sharding, sql, toxicity
from annolake.llm.common import text_of
from annolake.llm.exact import exact_duplicates
from annolake.llm.labelled import remainder
from annolake.llm.linededup import without_repeats
from annolake.llm.minhash import near_duplicates
from annolake.llm.mixing import mix_sources
from annolake.llm.tokenfile import read_tokens, write_tokens
from annolake.llm.topk import scaled_floor, top_k_products
from annolake.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, offsets=False, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled_floor(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k_products(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    found = langid.identify(docs, langid.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), F.col("language").alias("lang_pred"), "score")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/annolake-token-file-{uuid.uuid4().hex}"
    library = public_tokenizers.path("byte_bpe_50k.json")
    write_tokens(_table(spark, sf_dir, "documents"), path, library, end_id=2, encode_special_tokens=False)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2(text_of("text"), 256)})


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    counts, rows = repair.repaired(repair.damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("_of")).distinct()
    same = F.col("_of").eqNullSafe(F.col("conv_id"))
    told = every.join(counts, same, "left").drop("conv_id").join(repair.digests(rows), same, "left")
    numbers = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return told.select(F.col("_of").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(_table(spark, sf_dir, "documents"), carry={"text_crc32": F.crc32(text_of("text").cast("binary"))})
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_top_k": op7_top_k,
    "op8_language": op8_language,
    "op9_token_file": op9_token_file,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sharding": op13_sharding,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": sql.MIX_SOURCES,
    "op2_near_dedup": sql.NEAR_DEDUP,
    "op7_top_k": sql.TOP_K,
    "op10_exact_dedup": sql.EXACT_DEDUP,
    "op11_fill_in_middle": sql.FILL_IN_MIDDLE,
}
