"""Incremental ingestion of frame annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FRAME = "image string, source_video string, frame_index long, image_width long, image_height long, ingested timestamp"


def annotation_stream(spark: SparkSession, folder: str, schema: str = FRAME, files_per_batch: int = 100) -> DataFrame:
    """JSONL files appearing in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest_annotations(stream: DataFrame, keys: tuple[str, str] = ("source_video", "frame_index"), time: str = "ingested", delay: str = "1 hour", start: int = 0) -> DataFrame:
    """Frames from ``start`` on, each (video, frame) once within the watermark; the checkpoint takes the place of a
    resume position."""
    fresh = stream.filter(F.col(keys[1]) >= start).withWatermark(time, delay)
    return fresh.dropDuplicatesWithinWatermark(list(keys))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a parquet table, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
