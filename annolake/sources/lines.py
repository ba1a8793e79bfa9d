"""Numbered text lines of files of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.operators.ordered import Few, with_rank


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """path, line_index and value. A large file is read in splits; a line's number is its place in the split plus the
    lines of the splits before it, so no file is ever one row."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    raw = reader.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    return with_rank(raw, ["_split", "_seq"], Few(F.col("_split")), ["path"], "line_index").drop("_split", "_seq")


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def root_of(path: Column, depth: int = 1) -> Column:
    """Folder ``depth`` levels above the file, without the scheme."""
    return F.regexp_replace(F.regexp_replace(path, r"^file:/*", "/"), r"(/[^/]+){%d}$" % depth, "")
