"""Exact deduplication by progressive refinement: length, then a hash of the head, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import keyed_join, materialized, salted_join, text_of

HEAD_CHARS = 64


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and the ``carry`` columns.

    Texts are equal when identical; the row with the largest id stays. Each round looks closer at fewer rows: sizes that
    occur once end it, then heads (size and hash of the first characters) that occur once, and only rows that
    still have a possible twin get their whole text hashed. Only sizes, heads and hashes are shuffled.

    ``carry`` names further columns computed from the input row. Other columns, whatever their names, are ignored.
    Null texts equal the empty text and each other. Rows that repeat id and text are all kept or all dropped
    (``kept`` is ``id == keep_id``, null-safe) and each counts in ``group_size``. A null id loses against any id.
    An empty table gives an empty result.
    """
    text = text_of(text_column)
    rows = docs.select(
        F.col(id_column).alias("_id"),
        F.octet_length(text).alias("_size"),
        F.xxhash64(F.substring(text, 1, HEAD_CHARS)).alias("_head"),
        text.alias("_text"),
        *(column.alias(name) for name, column in (carry or {}).items()),
    )
    light = rows.select("_size", "_head")
    sizes = light.groupBy("_size").count().where("count > 1").select("_size")
    sizes = materialized(sizes, "sizes")
    heads = keyed_join(light, sizes, ["_size"], "left_semi", ["_head"]).groupBy("_size", "_head").count()
    heads = materialized(heads.where("count > 1").select("_size", "_head", F.lit(True).alias("_twin")), "heads")

    refined = keyed_join(rows, heads, ["_size", "_head"], "left", ["_id"])
    refined = refined.withColumn("_full", F.when(F.col("_twin"), F.sha2("_text", 256))).drop("_text", "_twin")
    refined = materialized(refined, "refined")

    key = ["_size", "_head", "_full"]
    groups = (
        refined.where("_full is not null").groupBy(*key).agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    )
    joined = salted_join(refined, groups, key, "left", ["_id"])
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_column),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        *(carry or {}),
    )
