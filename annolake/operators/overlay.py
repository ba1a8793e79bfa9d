"""Joining annotations with labels, review decisions and mask records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import clip_box, make_box
from annolake.operators.filters import label_is_masked, usable_box
from annolake.operators.ordered import index_block, with_rank


def apply_review(items: DataFrame, review: DataFrame) -> DataFrame:
    """Overlay presence and segment decisions; ``items`` has root, sample_id, has_subtitle, segment_marker."""
    decided = review.select(
        "root", "sample_id", F.col("has_subtitle").alias("_has"), F.col("segment_id").alias("_segment"),
        F.col("note").alias("_note"), F.lit(True).alias("_reviewed"),
    )
    marker = F.coalesce(F.nullif(F.col("segment_marker"), F.lit("")), F.col("sample_id"))
    segment = F.coalesce(F.nullif(F.col("_segment"), F.lit("")), marker)
    return (
        items.join(decided, ["root", "sample_id"], "left")
        .withColumn("segment_id", segment)
        .withColumn("segment_changed", segment != marker)
        .withColumn("has_subtitle", F.coalesce("_has", "has_subtitle", F.lit(False)))
        .withColumn("note", F.coalesce("_note", F.lit("")))
        .withColumn("reviewed", F.coalesce("_reviewed", F.lit(False)))
        .drop("_has", "_segment", "_note", "_reviewed", "segment_marker")
    )


def apply_label_masks(boxes: DataFrame, records: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
    """Mask overlay as keyed joins.

    ``boxes``: image_id, valid_index, box. ``records``: image_id, record_order, key and the mask fields.
    ``images``: image_id, width, height. A record whose index names a box added by an *earlier* record edits that
    added box; later records win over earlier ones, and a replacement box wins over a mask of the same record.
    """
    sized = records.join(images, "image_id")
    box_of = lambda field: clip_box(
        make_box(*(F.col(field)[i] for i in range(4))), F.col("width"), F.col("height")
    )
    given = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("_given"))
    added = sized.filter("add_bbox is not null")
    # The n-th added box of an image is addressed by (number of label boxes + n).
    from pyspark.sql import Window as W

    order = W.partitionBy("image_id").orderBy("record_order")
    added = added.join(given, "image_id", "left").select(
        "image_id", (F.coalesce("_given", F.lit(0)) + F.row_number().over(order) - 1).alias("valid_index"),
        box_of("add_bbox").alias("box"), F.col("record_order").alias("_born"),
    )
    pool = boxes.select("image_id", "valid_index", "box", F.lit(-1).cast("long").alias("_born")).unionByName(
        added.select("image_id", "valid_index", "box", F.col("_born").cast("long"))
    )
    masked = label_is_masked(F.struct("masked", "deleted", "unreliable", "exclude_from_loss"))
    edits = sized.select(
        "image_id", F.col("key").try_cast("long").alias("valid_index"), F.col("record_order").alias("_at"),
        F.when(F.col("bbox").isNotNull(), box_of("bbox")).when(masked, make_box(0, 0, 0, 0)).alias("_edit"),
    ).filter("valid_index is not null and _edit is not null")
    edited = pool.join(edits, ["image_id", "valid_index"], "left")
    alive = F.col("_at") >= F.col("_born")
    last = F.max_by(F.when(alive, F.col("_edit")), F.when(alive, F.col("_at")))
    final = edited.groupBy("image_id", "valid_index").agg(F.coalesce(last, F.first("box")).alias("box"))
    return {
        "boxes": final.filter(usable_box(F.col("box"))),
        "ignore_regions": sized.filter("ignore_region is not null").select("image_id", box_of("ignore_region").alias("box")),
        "dropped": records.filter("drop_image").select("image_id").distinct(),
    }


def assemble_samples(images: DataFrame, labels: DataFrame, annotations: DataFrame, masked: DataFrame) -> DataFrame:
    """One row per (image, usable label), and one row without a label for empty images.

    Labels stay in rows, so an image with very many labels is never folded into one record.
    """
    kept = labels.join(masked.select("image_id", "line_index"), ["image_id", "line_index"], "left_anti")
    return images.join(annotations, "image_id", "left").join(kept, "image_id", "left")


def union_boxes(pixel_boxes: DataFrame, by: list[str]) -> DataFrame:
    """Union of the positive-area boxes per group."""
    positive = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    kept = lambda c: F.when(positive, F.col(c))
    # Conditional aggregates instead of a filter: a filter would compute the boxes a second time below the projection.
    unions = pixel_boxes.groupBy(*by).agg(
        F.min(kept("x1")).alias("x1"), F.min(kept("y1")).alias("y1"), F.max(kept("x2")).alias("x2"), F.max(kept("y2")).alias("y2")
    )
    return unions.filter("x1 is not null")


def common_roi(unions: DataFrame) -> DataFrame:
    """Size and integer centre of the union over all samples; an error when there is none."""
    none = F.raise_error(F.lit("no label box to take a region from"))
    one = unions.agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    part = lambda c: F.when(F.col("x1").isNull(), none.cast("long")).otherwise(c)
    return one.select(
        part(F.col("x2") - F.col("x1")).alias("roi_width"), part(F.col("y2") - F.col("y1")).alias("roi_height"),
        part(F.floor((F.col("x1") + F.col("x2")) / 2)).alias("anchor_x"),
        part(F.floor((F.col("y1") + F.col("y2")) / 2)).alias("anchor_y"),
    )


def labelled(samples: DataFrame, label_lines: DataFrame, added: DataFrame) -> DataFrame:
    """Flag samples with label text or an added box (keys root, sample_id)."""
    marks = (
        label_lines.select("root", "sample_id").unionByName(added.select("root", "sample_id")).distinct()
        .withColumn("has_label", F.lit(True))
    )
    return samples.join(marks, ["root", "sample_id"], "left").fillna({"has_label": False})


def skip_existing(rows: DataFrame, done: DataFrame, key: str, order: str, max_samples: int | None = None) -> DataFrame:
    """Rows without output; the head is taken before the skip."""
    if max_samples is not None:
        ranked = with_rank(rows, [order], index_block(F.col(order)), (), "_at")
        rows = ranked.filter(F.col("_at") < max_samples).drop("_at")
    return rows.join(done.select(key), key, "left_anti")


def manifest_join(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Reviewed samples with their score-map row; the last manifest row of a stem wins."""
    latest = manifest.groupBy("stem").agg(
        F.max_by(F.struct("score_max", "score_mean"), F.col("position")).alias("m")
    )
    return samples.join(latest, "stem").select(
        samples["*"], F.coalesce("m.score_max", F.lit(0.0)).alias("score_max"),
        F.coalesce("m.score_mean", F.lit(0.0)).alias("score_mean"),
    )


def assert_disjoint(train: DataFrame, val: DataFrame) -> DataFrame:
    """Leak counts on root, (video, frame) and source image; all must be zero."""
    shared = lambda cols: train.select(*cols).dropna().intersect(val.select(*cols).dropna())
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = train.sparkSession.range(1)
    return one.select(
        count(shared(["root"])).alias("roots"), count(shared(["video_id", "frame_index"])).alias("video_frames"),
        count(shared(["source_image"])).alias("source_images"),
    )


def require_disjoint(train: DataFrame, val: DataFrame) -> None:
    leaks = {k: v for k, v in assert_disjoint(train, val).first().asDict().items() if v}
    if leaks:
        raise ValueError(f"training data leaks into validation: {leaks}")


def union_roots(roots: list[DataFrame], resize: tuple[int, int] | None = None) -> DataFrame:
    """Union of sample frames that carry roi_width and roi_height; sizes must agree unless a resize is given."""
    merged = roots[0]
    for other in roots[1:]:
        merged = merged.unionByName(other)
    if resize is not None:
        return merged.withColumn("roi_width", F.lit(resize[0])).withColumn("roi_height", F.lit(resize[1]))
    size = F.struct("roi_width", "roi_height")
    agree = merged.agg((F.min(size) == F.max(size)).alias("ok")).scalar()
    error = F.raise_error(F.lit("roots differ in ROI size; give an explicit resize"))
    return merged.filter(F.when(F.coalesce(agree, F.lit(True)), F.lit(True)).otherwise(error.cast("boolean")))
