"""Ordered computations that never put one hot group into one task.

Ranks, running sums and ``lag`` are cut into *blocks*: a block column that grows with the order column. Work
inside a block is an ordinary window; totals of earlier blocks come from a per-block table. A group that holds a third of
all rows is spread over as many tasks as it has blocks.

The per-block table grows with the data and may be sparse, so it is cut once more: quantiles of the blocks, a mergeable summary, split
it into ``CHAPTERS`` chapters, and what lies before a block is what lies before its chapter and, in the chapter, before it. No window
runs over more than the blocks of one chapter, or over more than ``CHAPTERS`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.session import checkpointed

_BLOCK, _CHAPTER = "_block", "_chapter"
CHAPTERS = 512


class Few(NamedTuple):
    """A block column with so few values in a group that one window can hold them: a fixed number, or one for some ten thousand rows."""

    column: Column


def crc_block(hash_column: Column) -> Few:
    """4096 blocks over a 32-bit hash."""
    return Few(F.shiftright(hash_column.cast("long"), 20))


def hash_block(key: Column) -> Few:
    """4096 blocks over a 64-bit hash."""
    return Few(F.shiftright(key, 52))


def index_block(index: Column, width: int = 65_536) -> Column:
    """Blocks of an index that may have large gaps, so that blocks may be as many as rows."""
    return F.floor(index / F.lit(width)).cast("long")


def dense_block(index: Column, width: int = 65_536) -> Few:
    """Blocks of an index without large gaps inside its group (a rank, a line, a frame of a video): one for ``width`` rows, about."""
    return Few(index_block(index, width))


def value_block(df: DataFrame, value: str, blocks: int = 64) -> DataFrame:
    """Add the block column from approximate quantiles of ``value`` (one bounded array per query)."""
    fractions = [i / blocks for i in range(1, blocks)]
    bounds = df.agg(F.percentile_approx(F.col(value), fractions, 1000).alias("b")).scalar()
    return (
        df.withColumn("_bounds", bounds)
        .withColumn(_BLOCK, F.size(F.filter("_bounds", lambda b: b <= F.col(value))))
        .drop("_bounds")
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _with_block(df: DataFrame, block: Column | Few | None) -> tuple[DataFrame, bool]:
    """Add the block column; whether its values are few (as those already present are)."""
    if isinstance(block, Few):
        return df.withColumn(_BLOCK, block.column), True
    return (df, True) if block is None else (df.withColumn(_BLOCK, block), False)


def _with_chapter(per_block: DataFrame) -> DataFrame:
    """Number of the chapter of each block, from quantiles of the blocks of all groups. Null blocks come first, as they are sorted."""
    fractions = [i / CHAPTERS for i in range(1, CHAPTERS)]
    ends = per_block.agg(F.percentile_approx(_BLOCK, fractions, 20 * CHAPTERS).alias("b")).scalar()
    numbered = per_block.withColumn("_ends", ends).withColumn(_CHAPTER, F.size(F.filter("_ends", lambda b: b <= F.col(_BLOCK))))
    return numbered.drop("_ends")


def _sums_before(per_block: DataFrame, by: list[str], names: list[str], totals: bool, few: bool) -> DataFrame:
    """``_b_<name>`` of the rows of a per-block table summed over the blocks before (``_a_<name>``), and over all."""
    whole = W.partitionBy(*by)
    every = [F.sum(f"_b_{n}").over(whole).alias(f"{n}_total") for n in names] if totals else []
    before = lambda window: [F.coalesce(F.sum(f"_b_{n}").over(window), F.lit(0)).alias(f"_a_{n}") for n in names]
    ahead = W.partitionBy(*by).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"_k_{c}") for c in [*by, _BLOCK]]
    if few:
        return per_block.select(*keys, *before(ahead), *every)
    per_block = _with_chapter(per_block)
    chapters = per_block.groupBy(*by, _CHAPTER).agg(*(F.sum(f"_b_{n}").alias(f"_b_{n}") for n in names))
    earlier = W.partitionBy(*by).orderBy(_CHAPTER).rowsBetween(W.unboundedPreceding, -1)
    chapters = chapters.select(*(F.col(c).alias(f"_c_{c}") for c in [*by, _CHAPTER]), *before(earlier), *every)
    chapters = chapters.withColumnsRenamed({f"_a_{n}": f"_e_{n}" for n in names})
    inside = W.partitionBy(*by, _CHAPTER).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    placed = per_block.select(*by, _BLOCK, _CHAPTER, *before(inside))
    condition = F.lit(True)
    for c in [*by, _CHAPTER]:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    both = placed.join(chapters, condition)
    sums = [(F.col(f"_a_{n}") + F.col(f"_e_{n}")).alias(f"_a_{n}") for n in names]
    return both.select(*keys, *sums, *([f"{n}_total" for n in names] if totals else []))


def _last_before(per_block: DataFrame, by: list[str], few: bool) -> DataFrame:
    """``_last`` of the block before each (``_carry``)."""
    keys = [F.col(c).alias(f"_k_{c}") for c in [*by, _BLOCK]]
    if few:
        return per_block.select(*keys, F.lag("_last").over(W.partitionBy(*by).orderBy(_BLOCK)).alias("_carry"))
    per_block = _with_chapter(per_block)
    # A null block is the first of all.
    chapters = per_block.groupBy(*by, _CHAPTER).agg(F.max_by("_last", F.struct(_BLOCK)).alias("_last"))
    earlier = F.lag("_last").over(W.partitionBy(*by).orderBy(_CHAPTER)).alias("_earlier")
    chapters = chapters.select(*(F.col(c).alias(f"_c_{c}") for c in [*by, _CHAPTER]), earlier)
    inside = W.partitionBy(*by, _CHAPTER).orderBy(_BLOCK)
    placed = per_block.select(*by, _BLOCK, _CHAPTER, F.lag("_last").over(inside).alias("_near"), F.row_number().over(inside).alias("_nth"))
    condition = F.lit(True)
    for c in [*by, _CHAPTER]:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return placed.join(chapters, condition).select(*keys, F.when(F.col("_nth") > 1, F.col("_near")).otherwise(F.col("_earlier")).alias("_carry"))


def running_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: dict[str, Column],
    by: Sequence[str] = (),
    block: Column | Few | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add the sum over all rows *before* this one in the order, per ``by`` group.

    ``sums`` maps output name to a numeric column. With ``totals`` each ``<name>_total`` is added too. ``block``
    must grow with the order; ``None`` uses a block column already present.
    """
    by = list(by)
    df, few = _with_block(df, block)
    names = list(sums)
    per_block = df.groupBy(*by, _BLOCK).agg(*(F.sum(sums[n]).alias(f"_b_{n}") for n in names))
    per_block = _sums_before(per_block, by, names, totals, few)
    condition = F.lit(True)
    for c in [*by, _BLOCK]:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = df.join(per_block, condition, "inner")
    inside = W.partitionBy(*by, _BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    for n in names:
        joined = joined.withColumn(n, F.coalesce(F.sum(sums[n]).over(inside), F.lit(0)) + F.col(f"_a_{n}"))
    return joined.drop(_BLOCK, *[f"_k_{c}" for c in [*by, _BLOCK]], *[f"_a_{n}" for n in names])


def with_rank(
    df: DataFrame,
    order: Sequence[Column | str],
    block: Column | Few | None,
    by: Sequence[str] = (),
    name: str = "rank",
    totals: bool = False,
) -> DataFrame:
    """Zero-based position in a total order, per ``by`` group."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, by, block, totals)


def with_previous(
    df: DataFrame,
    order: Sequence[str],
    columns: Sequence[str],
    by: Sequence[str],
    block: Column | Few,
    prefix: str = "prev_",
) -> DataFrame:
    """``lag(1)`` of ``columns`` per ``by`` group, carried over block borders."""
    by = list(by)
    df, few = _with_block(df, block)
    key = F.struct(*(F.col(c) for c in order))
    last = df.groupBy(*by, _BLOCK).agg(F.max_by(F.struct(*columns), key).alias("_last"))
    carry = _last_before(last, by, few)
    condition = F.lit(True)
    for c in [*by, _BLOCK]:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = W.partitionBy(*by, _BLOCK).orderBy(*order)
    joined = df.join(carry, condition, "inner").withColumn("_row", F.row_number().over(inside))
    for c in columns:
        joined = joined.withColumn(
            prefix + c, F.when(F.col("_row") == 1, F.col("_carry")[c]).otherwise(F.lag(c).over(inside))
        )
    return joined.drop(_BLOCK, "_row", "_carry", *[f"_k_{c}" for c in [*by, _BLOCK]])


def located(points: DataFrame, asked: DataFrame, by: Sequence[str], at: str, block: Column | Few) -> DataFrame:
    """Each row of ``asked`` with the last of ``points`` (columns prefixed ``p_``) whose ``at`` is not behind its own, per ``by`` group.

    Points of one place count as one, the last in the order of their columns. Rows before the first point have none and go. Points and
    rows are laid out in one order and counted; a row then meets its point by the count.
    """
    by = list(by)
    kind = lambda df: df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType
    whole = lambda df: F.struct(*df.columns)
    first = points.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_kind"), whole(points).alias("_p"), F.lit(None).cast(kind(asked)).alias("_q"))
    second = asked.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind(points)).alias("_p"), whole(asked).alias("_q"))
    both = first.unionByName(second).withColumn(at, F.col("_at"))
    counted = checkpointed(running_sums(both, ["_at", "_kind", "_p"], {"_n": (F.col("_kind") == 0).cast("long")}, by, block))
    found = counted.where("_kind = 1").select(*by, (F.col("_n") - 1).alias("_n"), "_q")
    hit = found.join(counted.where("_kind = 0").select(*by, "_n", "_p"), [*by, "_n"])
    return hit.select("_q.*", *(F.col(f"_p.{c}").alias(f"p_{c}") for c in points.columns))


def exploded_range(df: DataFrame, count: Column, name: str, spread_by: Sequence[str], chunk: int = 4096) -> DataFrame:
    """One row per value in ``[0, count)``, cut into chunks that are spread over tasks before they unfold."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = count.cast("long")
    chunks = df.withColumn("_n", count).filter("_n > 0").withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long")))
    )
    spread = chunks.repartition(tasks, *spread_by, "_from")
    return spread.withColumn(
        name, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + chunk, F.col("_n")) - 1))
    ).drop("_n", "_from")
