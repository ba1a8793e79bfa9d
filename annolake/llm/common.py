"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.session import shared_folder

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only if it has at most so many (narrow) rows; beyond that the join is salted.
BROADCAST_ROWS = 100_000
SALTS = 16
#: Bits of ``may_hold``.
FILTER_BITS = 24


def text_of(column: str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(text_column: str) -> Column:
    """With an id, what tells a row: the hash of its text, for rows that share an id or have none."""
    return F.xxhash64(text_of(text_column))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WORD_BREAK), lambda w: w != "")).cast("long")


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the session's shared folder and read it back.

    Lineage ends at files that every executor sees, so a lost executor costs a reread and nothing else.
    """
    path = f"{shared_folder(df.sparkSession)}/annolake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Spark's cleaner removes shuffle files when the driver's JVM collects their handles; on a busy disk that comes too late by itself.
    gc.collect()
    df.sparkSession._jvm.System.gc()
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a ``materialized`` table that nothing reads any more."""
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def renamed(table: DataFrame, *names: str) -> DataFrame:
    """A ``materialized`` table under other column names."""
    other = table.toDF(*names)
    other._scratch_path = table._scratch_path
    return other


def salted_join(rows: DataFrame, keyed: DataFrame, on: Sequence[str], how: str, spread: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Join ``rows`` to ``keyed`` (one narrow row per key) so that no key's rows meet in one task.

    Rows of a key are dealt over ``salts`` tasks by the hash of ``spread``; the keyed side is repeated that often.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def keyed_join(rows: DataFrame, keyed: DataFrame, on: Sequence[str], how: str, spread: Sequence[str]) -> DataFrame:
    """``salted_join``, or a broadcast where a count shows that ``keyed`` (already materialized) is small."""
    if keyed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keyed), list(on), how)
    return salted_join(rows, keyed, on, how, spread)


def may_hold(wanted: DataFrame, keys: Sequence[str]) -> Column:
    """Whether the ``keys`` of a row may be among those of ``wanted``, by one hash into a filter of ``2 ** FILTER_BITS`` bits.

    The filter has one size whatever ``wanted`` holds. It spares most other rows the way to a join on ``keys``, which has to follow, and
    rows that are long need not be moved to find out; with very many keys it lets everything pass.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (bucket % 32).cast("int"))
    found = wanted.groupBy(F.shiftright(bucket, 5).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2^19 rows at most
    flags = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    flags[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    shared = wanted.sparkSession.sparkContext.broadcast(flags)

    @F.arrow_udf("boolean")
    def asked(place: pa.Array) -> pa.Array:
        at = place.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))

    return asked(bucket)
