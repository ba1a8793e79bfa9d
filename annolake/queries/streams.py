"""Streaming operators, each driven to completion over a table read as a stream."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.functions import text as tx
from annolake.operators.segments import adjacency_edges
from annolake.queries.registry import query
from annolake.session import shared_folder
from annolake.streaming.bank import PAIR_ROWS, run_bank
from annolake.streaming.ingest import append_to, ingest_annotations
from annolake.streaming.segments import CHANGE, EVENTS, last_segment_events, run_segment_events, stream_segment_changes


def _folder(t) -> str:
    """Fresh folder for a stream's output, below the session's shared folder."""
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(t) -> DataFrame:
    return t.spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)


def _drain(t, stream: DataFrame) -> DataFrame:
    folder = _folder(t)
    append_to(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("ingest_annotations", "SS-01", """select 'u' || user_id as source_video, event_id as frame_index, event_type from events where event_id >= 100""")
def _(t):
    # Every event arrives twice; each (video, frame) must come out once.
    twice = _event_stream(t).select(
        F.concat(F.lit("u"), "user_id").alias("source_video"), F.col("event_id").alias("frame_index"), "event_type", F.col("ts").cast("timestamp").alias("ingested"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return _drain(t, ingest_annotations(twice, start=100)).select("source_video", "frame_index", "event_type")


def _frame_stream(t) -> DataFrame:
    """Events as frames of a video for each user."""
    return _event_stream(t).select(
        F.concat(F.lit("u"), F.col("user_id") % 4).alias("root"), F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("frame_index"),
        F.col("event_type").alias("segment_id"), (F.col("event_type") != "error").alias("has_subtitle"), F.col("ts").cast("timestamp").alias("ts"))


@query("stream_segment_changes", "SS-02", """with m as (select max(ts) - interval 10 minutes as mark from events where event_type <> 'error'),
 e as (select 'u' || (user_id % 4) as root, user_id::varchar as video_id, event_id as frame_index, event_type as segment_id from events, m where event_type <> 'error' and
 epoch_ms(ts) <= epoch_ms(mark)), l as (select *, lag(segment_id) over (partition by root, video_id order by frame_index) as prev_segment from e)
 select root, video_id, frame_index, prev_segment, segment_id from l where prev_segment <> segment_id""")
def _(t):
    return _drain(t, stream_segment_changes(_frame_stream(t))).drop("late")


@query("segment_changes_to_the_end", "SS-02", """with e as (select 'u' || (user_id % 4) as root, user_id::varchar as video_id, event_id as frame_index, event_type as segment_id from events where event_type <> 'error'),
 l as (select *, lag(segment_id) over (partition by root, video_id order by frame_index) as prev_segment from e)
 select root, video_id, frame_index, prev_segment, segment_id from l where prev_segment <> segment_id""")
def _(t):
    # The changes that the watermark let through, and those of the frames that still waited when the stream ended.
    folder = _folder(t)
    run_segment_events(_frame_stream(t), folder, f"{folder}/checkpoint").awaitTermination()
    seen = t.spark.read.schema(EVENTS).option("basePath", f"{folder}/events").parquet(f"{folder}/events")
    both = seen.unionByName(last_segment_events(t.spark, f"{folder}/checkpoint"))
    return both.filter(F.col("kind") == CHANGE).drop("kind", "late")


#: Micro-batches of the bank's stream, and what the places of one are behind those of the one before; no sample has an index of half that.
PARTS, PART = 8, 1 << 59


@query("rolling_negative_bank", "SS-03")
def _(t):
    edges = adjacency_edges(t.frames).groupBy("root", "video_id", "segment_id").agg(F.collect_set("neighbour").alias("adjacent"))
    vectors = t.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vector"))
    size = vectors.agg(F.max("vec_id").alias("m")).scalar()
    # Rows of one micro-batch never meet, so the frames that a frame is to meet, its segment's and the neighbour segments', have to be in others: each
    # takes every eighth frame of all videos.
    rows = t.frames.filter("has_subtitle").withColumn("part", F.pmod("frame_index", F.lit(PARTS)).cast("int"))
    rows = rows.withColumn("_m", size).withColumn("vec_id", F.pmod(F.xxhash64("sample_idx"), F.col("_m") + 1))
    rows = rows.join(vectors, "vec_id").join(edges, ["root", "video_id", "segment_id"], "left").select(
        "root", "video_id", "segment_id", tx.normalize_text(F.col("ocr_text")).alias("norm_text"), (F.col("part").cast("long") * PART + F.col("sample_idx")).alias("order_idx"), "vector",
        F.coalesce("adjacent", F.array().cast("array<string>")).alias("adjacent"), "part")
    folder = _folder(t)
    # One file for each, written one after the other.
    rows.repartition(1, "part").write.partitionBy("part").parquet(f"{folder}/in")
    schema = t.spark.read.parquet(f"{folder}/in").drop("part").schema
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run_bank(stream, folder, f"{folder}/checkpoint", maximum=0.6).awaitTermination()
    pairs = t.spark.read.schema(PAIR_ROWS).parquet(f"{folder}/pairs")
    sample = lambda place: place - F.shiftright(place + PART // 2, 59) * PART
    return pairs.withColumns({c: sample(F.col(c)) for c in ("order_idx", "old_order_idx")})
