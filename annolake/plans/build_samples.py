"""Frames and detections to training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import bbox_to_yolo, make_box, rect_to_yolo, sample_stem
from annolake.operators.filters import passes_score, region_filter, select_frames
from annolake.operators.ordered import dense_block, running_sums

KEY = ["video_id", "frame_index"]


def build_samples(
    frames: DataFrame, detections: DataFrame, stride: int = 1, start: int = 0, min_score: float = 0.0,
    region: tuple[int, int, int, int] | None = None, keep_empty: bool = False, max_frames: int | None = None,
) -> dict[str, DataFrame]:
    """``frames``: video_id, frame_index, width, height, offset_x, offset_y; ``detections``: video_id, frame_index,
    box, score. Gives kept ``frames``, their ``labels`` and ``stats`` per video.

    The cap counts kept frames in frame order; frames after it is reached are not looked at.
    """
    chosen = select_frames(frames, stride, start)
    scored = detections.filter(passes_score(F.col("score"), min_score))
    placed = scored.join(chosen.select(*KEY, "width", "height", "offset_x", "offset_y"), KEY)
    b = F.col("box")
    moved = make_box(b["x1"] + F.col("offset_x"), b["y1"] + F.col("offset_y"), b["x2"] + F.col("offset_x"), b["y2"] + F.col("offset_y"))
    found = region_filter(placed, moved, region)
    counts = found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("detections"))
    counted = chosen.join(counts, KEY, "left").fillna(0, ["detections"])
    kept = F.lit(True) if keep_empty else F.col("detections") > 0
    counted = counted.withColumn("kept", kept)
    if max_frames:
        counted = running_sums(
            counted, ["frame_index"], {"kept_before": F.col("kept").cast("long")}, ["video_id"], dense_block(F.col("frame_index"))
        ).filter(F.col("kept_before") < max_frames).drop("kept_before")
    stems = sample_stem("video_id", "frame_index")
    samples = counted.filter("kept").drop("kept").withColumn("sample_id", stems)
    labels = found if not max_frames else found.join(samples.select(*KEY), KEY, "left_semi")
    w, h = F.col("width"), F.col("height")
    line = rect_to_yolo(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"], w, h)
    labels = labels.select(*KEY, stems.alias("sample_id"), "box", "score", bbox_to_yolo(b, w, h).alias("yolo"), line.alias("line"))
    stats = counted.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("selected_frames"), F.count_if("kept").alias("kept_frames"), F.sum("detections").alias("detections")
    )
    return {"frames": samples, "labels": labels, "stats": stats}
