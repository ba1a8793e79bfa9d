"""Segment changes on a frame stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from annolake.operators.ordered import index_block, with_previous
from annolake.streaming.bank import ROCKSDB

EVENTS = "kind string, root string, video_id string, frame_index long, prev_segment string, segment_id string, late long"
COLUMNS = ["kind", "root", "video_id", "frame_index", "prev_segment", "segment_id", "late"]
#: Kinds of events.
CHANGE, LATE = "change", "late"


class SegmentChanges(StatefulProcessor):
    """State of one video: the last frame taken, how many came too late, and the frames that wait for the watermark, each an entry of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("frame", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("late", T.LongType())]))
        self.held = handle.getListState("held", T.StructType([T.StructField("frame", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first = None
        for frames in rows:
            self.held.appendList([(int(f), None if pd.isna(s) else s, int(t)) for f, s, t in zip(frames["frame_index"], frames["segment_id"], frames["ms"])])
            least = int(frames["ms"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first, timerValues)
        yield pd.DataFrame([], columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for frame, segment, ms in self.held.get() if self.held.exists() else ():
            (ready if ms <= mark else later).append((frame, segment, ms))
        if later:
            self.held.put(later)
            self._wake(min(ms for _, _, ms in later), timerValues)
        else:
            self.held.clear()
        last, segment, late = self.last.get() if self.last.exists() else (None, None, 0)
        out = []
        for frame, current, _ in sorted(ready, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2])):
            if last is not None and frame < last:
                late += 1
                out.append((LATE, *key, frame, None, current, late))
                continue
            if segment is not None and current is not None and current != segment:
                out.append((CHANGE, *key, frame, segment, current, late))
            last, segment = frame, current
        if last is not None:
            self.last.update((last, segment, late))
        yield pd.DataFrame(out, columns=COLUMNS)

    def _wake(self, ms: int, timerValues: object) -> None:
        """A timer rings when the watermark is past its time; a frame is taken when the watermark has reached it."""
        self.handle.registerTimer(max(ms - 1, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def segment_events(stream: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Segment changes between positive frames of a video (``kind`` change), and frames that came too late (``kind`` late).

    Frames wait until the watermark reaches their time and are then taken in frame order. A frame before the last one taken is late: it is counted
    (``late``) and given out apart, without a previous segment. Frames without video, number or time take no part; from or to a frame without
    segment nothing changes. State lives in RocksDB (``run_segment_events`` sets it) and holds what the watermark delay holds back.
    """
    frames = (
        stream.filter(F.col("has_subtitle") & F.col("video_id").isNotNull() & F.col("frame_index").isNotNull() & F.col(time).isNotNull())
        .withWatermark(time, delay)
        .select("root", "video_id", F.col("frame_index").cast("long").alias("frame_index"), "segment_id", time, F.unix_millis(F.col(time)).alias("ms"))
    )
    return frames.groupBy("root", "video_id").transformWithStateInPandas(SegmentChanges(), EVENTS, "Append", "EventTime")


def stream_segment_changes(stream: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The changes of ``segment_events`` alone."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return segment_events(stream, time, delay).filter(F.col("kind") == CHANGE).drop("kind")


def run_segment_events(stream: DataFrame, folder: str, checkpoint: str, **settings) -> StreamingQuery:
    """Drive ``segment_events`` over what is there. Events go to ``folder/events``, in one subfolder for each kind."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = segment_events(stream, **settings)
    return events.writeStream.format("parquet").partitionBy("kind").option("path", f"{folder}/events").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_segment_events(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What ``segment_events`` would give for the frames that still wait when a bounded input has ended.

    The frames and the last ones taken are read from the state in the checkpoint, which stays as it is: if more input comes after all, the stream
    goes on without these events and gives them in their time. ``late`` is the count at the end of the stream.
    """

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    held = state("held").select("key.root", "key.video_id", F.col("list_element.frame").alias("frame_index"), F.col("list_element.segment").alias("segment_id"), F.col("list_element.ms").alias("ms"))
    last = state("last").select("key.root", "key.video_id", F.col("value.frame").alias("_frame"), F.col("value.segment").alias("_segment"), F.col("value.late").alias("_late"))
    same = held["root"].eqNullSafe(last["root"]) & held["video_id"].eqNullSafe(last["video_id"])
    known = held.join(last, same, "left").select(held["*"], "_frame", "_late")
    waiting = known.withColumn("_is_late", F.coalesce(F.col("frame_index") < F.col("_frame"), F.lit(False)))
    # The last frame taken comes before waiting ones of the same number.
    seen = last.select("root", "video_id", F.col("_frame").alias("frame_index"), F.col("_segment").alias("segment_id"), F.lit(None).cast("long").alias("ms"), "_frame", "_late", F.lit(0).alias("_waits"))
    taken = waiting.filter("not _is_late").drop("_is_late").withColumn("_waits", F.lit(1)).unionByName(seen)
    lagged = with_previous(taken, ["frame_index", "_waits", "segment_id", "ms"], ["segment_id"], ["root", "video_id"], index_block(F.col("frame_index")))
    changes = lagged.filter("_waits = 1 and prev_segment_id <> segment_id").withColumnRenamed("prev_segment_id", "prev_segment")
    late = waiting.filter("_is_late").withColumn("prev_segment", F.lit(None).cast("string"))
    pick = lambda df, kind, count: df.select(F.lit(kind).alias("kind"), "root", "video_id", "frame_index", "prev_segment", "segment_id", count.alias("late"))
    return pick(changes, CHANGE, F.coalesce("_late", F.lit(0).cast("long"))).unionByName(pick(late, LATE, F.col("_late")))
