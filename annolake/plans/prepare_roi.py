"""Labelled images to fixed-size ROI samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import crop_window, label_to_pixel_box, reproject_label, yolo_line
from annolake.functions.text import strip_casefold
from annolake.operators.detection import reading_order
from annolake.operators.overlay import common_roi, union_boxes


def pixel_labels(images: DataFrame, labels: DataFrame, masked: DataFrame) -> DataFrame:
    """Positive-area integer boxes of unmasked labels."""
    kept = labels.join(masked.select("image_id", "line_index"), ["image_id", "line_index"], "left_anti")
    box = label_to_pixel_box("cx", "cy", "w", "h", "width", "height")
    out = kept.join(images.select("image_id", "width", "height"), "image_id").select("image_id", "line_index", box.alias("b"))
    return out.select("image_id", "line_index", "b.*").filter("x2 > x1 and y2 > y1")


def prepare_roi(
    images: DataFrame, labels: DataFrame, masked: DataFrame, texts: DataFrame | None = None,
    keep_empty: bool = False, keep_dropped: bool = False,
) -> dict[str, DataFrame]:
    """``images``: image_id, width, height, drop_image; ``labels``: image_id, line_index, cx, cy, w, h; ``masked``:
    image_id, line_index; ``texts``: image_id, ocr_text. Gives ROI ``samples`` and a one-row ``summary``.
    """
    usable = images if keep_dropped else images.filter("not drop_image")
    pixels = pixel_labels(usable, labels, masked)
    roi = common_roi(union_boxes(pixels, ["image_id"]))
    boxes = pixels.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("line_index", "x1", "y1", "x2", "y2"))).alias("boxes")
    )
    flat = F.flatten(F.transform("boxes", lambda b: F.array(*(b[k].cast("double") for k in ("x1", "y1", "x2", "y2")))))
    boxes = boxes.withColumn("_at", reading_order(flat)).withColumn(
        "boxes", F.transform("_at", lambda i: F.get(F.col("boxes"), i))
    ).drop("_at")
    one = roi.agg(F.first(F.struct(*roi.columns)).alias("roi")).scalar()
    # A label box, even one without area, makes a sample eligible.
    has_label = labels.join(masked.select("image_id", "line_index"), ["image_id", "line_index"], "left_anti").select("image_id").distinct()
    samples = usable.join(has_label.withColumn("has_label", F.lit(True)), "image_id", "left").fillna({"has_label": False})
    if not keep_empty:
        samples = samples.filter("has_label")
    samples = samples.join(boxes, "image_id", "left").withColumn("_roi", one).select("*", "_roi.*").drop("_roi")
    crop = crop_window("width", "height", "roi_width", "roi_height", "anchor_x", "anchor_y")
    samples = samples.withColumn("crop", crop).filter("crop is not null")
    lines = F.transform(F.coalesce("boxes", F.array()), lambda b: reproject_label(b, F.col("crop"), F.col("roi_width"), F.col("roi_height")))
    lines = F.transform(F.filter(lines, lambda n: n.isNotNull()), lambda n: yolo_line(n["cx"], n["cy"], n["w"], n["h"]))
    if texts is None:
        samples = samples.withColumn("ocr_text", F.lit("")).withColumn("has_subtitle", F.col("has_label"))
    else:
        samples = samples.join(texts, "image_id", "left").fillna({"ocr_text": ""})
        samples = samples.withColumn("has_subtitle", strip_casefold(F.col("ocr_text")) != "")
    samples = samples.withColumn("label_lines", lines).withColumn("ocr_text_normalized", strip_casefold(F.col("ocr_text")))
    samples = samples.drop("drop_image", "has_label", "anchor_x", "anchor_y")
    summary = samples.agg(
        F.max("roi_width").alias("roi_width"), F.max("roi_height").alias("roi_height"), F.count(F.lit(1)).alias("samples"),
        F.count_if("has_subtitle").alias("positive"), F.count_if(~F.col("has_subtitle")).alias("empty"),
    )
    return {"samples": samples, "summary": summary}
