"""Bounded samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most: the ones whose id hash comes first.
SAMPLE_ROWS = 40_000


def remainder(id_column: str, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def sample(labels: DataFrame, label: str, learn: Column, id_column: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``_id, _label`` of at most ``rows`` labelled rows. Repeated ids count once, with their highest label."""
    known = labels.where(learn & F.col(id_column).isNotNull() & F.col(label).isNotNull())
    picked = known.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label"))
    picked = picked.orderBy(F.xxhash64("_id"), "_id", F.desc("_label")).limit(rows)
    return picked.groupBy("_id").agg(F.max("_label").alias("_label"))
