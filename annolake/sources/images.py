"""Image listings and sizes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.sources.lines import file_name, root_of, stem

_SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG or baseline/progressive JPEG header; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack_from(">II", data, 16)
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] == 0xFF:
            at += 1
            continue
        marker, size = data[at], struct.unpack_from(">H", data, at + 1)[0]
        if marker in range(0xC0, 0xC4):
            height, width = struct.unpack_from(">HH", data, at + 4)
            return width, height
        at += 1 if marker in (0xD8, 0xD9) else 1 + size
    return None


@F.pandas_udf(_SIZE)
def _sizes(contents: pd.Series) -> pd.DataFrame:
    found = [header_size(bytes(c)) or (None, None) for c in contents]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int64")


def list_images(spark: SparkSession, roots: list[str], suffixes: str = "{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG}") -> DataFrame:
    """Path, size in bytes and time of every image; contents are not read."""
    paths = [f"{r.rstrip('/')}/images" for r in roots]
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffixes}").load(paths)
    return files.select(
        root_of(F.col("path"), 2).alias("root"), stem(F.col("path")).alias("sample_id"), file_name(F.col("path")).alias("filename"),
        F.regexp_replace("path", "^file:/*", "/").alias("image_path"), "length", F.col("modificationTime").alias("modified"),
    )


def discover_images(spark: SparkSession, roots: list[str], suffixes: str = "{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG}") -> DataFrame:
    """Images with the size in their header."""
    paths = [f"{r.rstrip('/')}/images" for r in roots]
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffixes}").load(paths)
    sized = files.select("path", "length", "modificationTime", _sizes("content").alias("s"))
    return sized.select(
        root_of(F.col("path"), 2).alias("root"), stem(F.col("path")).alias("sample_id"), file_name(F.col("path")).alias("filename"),
        F.regexp_replace("path", "^file:/*", "/").alias("image_path"), "length", F.col("modificationTime").alias("modified"), "s.*",
    )


def resolve_dimensions(
    wanted: DataFrame, annotations: DataFrame, headers: DataFrame, default: tuple[int, int] | None = None
) -> DataFrame:
    """Size of each (filename, sample_id): annotation by name, by stem, image header, default, else an error.

    ``annotations``: image, line_index, image_width, image_height; ``headers``: filename, width, height.
    """
    size = F.struct(F.col("image_width").alias("width"), F.col("image_height").alias("height"))
    named = annotations.filter("image is not null").select(file_name(F.col("image")).alias("filename"), "line_index", size.alias("s"))
    last = F.max_by("s", "line_index")
    by_name = named.groupBy("filename").agg(last.alias("_name"))
    by_stem = named.groupBy(stem(F.col("filename")).alias("sample_id")).agg(last.alias("_stem"))
    by_header = headers.select("filename", F.struct("width", "height").alias("_header"))
    joined = wanted.join(by_name, "filename", "left").join(by_stem, "sample_id", "left").join(by_header, "filename", "left")
    kind = "struct<width:bigint,height:bigint>"
    error = F.raise_error(F.concat(F.lit("size unknown for "), F.col("filename"))).cast(kind)
    rest = error if default is None else F.struct(F.lit(default[0]).alias("width"), F.lit(default[1]).alias("height")).cast(kind)
    usable = F.when(F.col("_header.width").isNotNull(), F.col("_header").cast(kind))
    found = F.coalesce(F.col("_name").cast(kind), F.col("_stem").cast(kind), usable, rest)
    return joined.withColumn("_s", found).select(*wanted.columns, "_s.*")
