"""Mixing sources to target weights by hash thresholds found in histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.common import discard, keyed_join, materialized, text_of, word_count

#: Hash bits in all, and how many of them each level of the histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
EVERYTHING = (1 << HASH_BITS) - 1


def hash_position(column: Column) -> Column:
    """A fixed position in ``[0, 2^60)`` for a value; null has the position of the empty string."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets per source from ``_key, source, source_size``: weights repeat over sources by code point, null last.

    All targets together are ``share`` times all sizes, split by weight; no target exceeds ``cap`` times its source, and
    what is over goes to the others by weight until none is above. Sorted by cap per weight, the sources that
    stop at their cap come first, so one running sum finds the level of the rest. One row per source is all that is sorted.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(order))
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_ratio", F.col("source_size") * F.lit(float(cap)) / F.col("_weight"))
    by_ratio = W.orderBy("_ratio", "_rank")
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = ranked.withColumn("_level", (F.lit(float(share)) * total - F.lit(float(cap)) * before) / left)
    levels = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level")))
    level = levels.over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["_level"]
    top = F.lit(float(cap)) * F.col("source_size")
    return ranked.withColumn("target", F.least(top, F.coalesce(level * F.col("_weight"), top))).select(
        "_key", "source", "source_size", "target"
    )


def budget_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``_key, _threshold``: rows of a key with ``_hash <= _threshold`` have sizes that add up to its budget, or nearly.

    ``rows`` has ``_key, _hash, _size``, ``budgets`` has ``_key, _budget``. A histogram of sizes by hash bucket shows in
    which bucket the budget ends; only that bucket is cut into finer buckets, until it holds one hash. That hash is in or out,
    whichever is nearer to the budget.
    """
    open_ = budgets.withColumns({"_prefix": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")})
    closed, held = [], None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = keyed_join(rows.withColumn("_prefix", F.shiftright("_hash", shift + LEVEL_BITS)), open_, ["_key", "_prefix"], "inner", ["_hash"])
        histogram = inside.groupBy("_key", "_budget", "_before", F.shiftright("_hash", shift).alias("_bucket")).agg(
            F.sum("_size").alias("_sum"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high")
        )
        running = F.col("_before") + F.sum("_sum").over(W.partitionBy("_key").orderBy("_bucket"))
        over = histogram.withColumn("_until", running).where("_until > _budget")
        edge = over.groupBy("_key", "_budget").agg(F.min(F.struct("_bucket", "_until", "_sum", "_low", "_high")).alias("_edge"))
        edge = materialized(edge.select("_key", "_budget", "_edge.*"), "edges")
        if held is not None:
            discard(held)
        held = edge
        start = F.col("_until") - F.col("_sum")
        nearer = (F.col("_until") - F.col("_budget")) < (F.col("_budget") - start)
        single = edge.where("_low = _high").select("_key", F.when(nearer, F.col("_high")).otherwise(F.col("_low") - 1).alias("_threshold"))
        closed.append(materialized(single, "thresholds"))
        open_ = edge.where("_low < _high").select("_key", "_budget", F.col("_bucket").alias("_prefix"), start.alias("_before"))
        if open_.isEmpty():
            break
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    return budgets.select("_key").join(found, "_key", "left").withColumn("_threshold", F.coalesce("_threshold", F.lit(EVERYTHING)))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """Per row: id, ``size`` (words), ``source``, ``source_size``, ``target`` and ``copies``, how often the mix takes it.

    Every document of a source is taken ``floor(target / source_size)`` times; those below the source's hash threshold once
    more. The position of a document is a hash of its id, so reruns agree and no sort is needed. Null or empty texts
    have size 0, a null source is a source of its own, rows with the same id share their fate, an empty table gives an empty
    result; other columns are ignored.
    """
    key = F.when(F.col(source_column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_column).cast("string")))
    rows = docs.select(
        F.col(id_column).alias("_id"), F.col(source_column).cast("string").alias("source"), key.alias("_key"),
        word_count(text_of(text_column)).alias("_size"), hash_position(F.col(id_column)).alias("_hash"),
    )
    rows = materialized(rows, "sizes")
    sizes = rows.groupBy("_key", "source").agg(F.sum("_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_whole", whole).withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size"))
    targets = materialized(targets, "targets")
    thresholds = budget_thresholds(rows.select("_key", "_hash", "_size"), targets.select("_key", "_budget"))
    plan = targets.join(thresholds, "_key").drop("source", "_budget")
    plan = materialized(plan, "mix")
    extra = ((F.col("_hash") <= F.col("_threshold")) & (F.col("target") > F.col("_whole") * F.col("source_size"))).cast("long")
    return keyed_join(rows, plan, ["_key"], "inner", ["_hash"]).select(
        F.col("_id").alias(id_column), F.col("_size").alias("size"), "source", "source_size", "target", (F.col("_whole") + extra).alias("copies")
    )
