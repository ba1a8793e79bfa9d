"""Per-epoch geometry of frame samples: crop views, protected sizes and borrowed scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import aligned_resize_size, crop_boxes, make_box, protection_geometry
from annolake.operators.ordered import hash_block, index_block, with_rank
from annolake.session import checkpointed

SMALL_EDGE = 8.0  # fixed value


def _uniform(seed: int, epoch: int, salt: int, *keys: str) -> Column:
    """Uniform [0, 1) from a seeded hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(salt), *keys), 11)
    return bits / F.lit(float(1 << 53))


def _between(low: Column, high: Column, unit: Column) -> Column:
    return (low + F.floor(unit * (high - low + 1))).cast("long")


def random_crop_plan(samples: DataFrame, scale: tuple[float, float], seed: int, epoch: int) -> DataFrame:
    """Crop rectangle of each (sample, crop_view) that keeps the union of its boxes whole.

    ``samples``: root, sample_id, crop_view, width, height, boxes.
    """
    keys = ["root", "sample_id", "crop_view"]
    w, h = F.col("width"), F.col("height")
    factor = F.lit(scale[0]) + _uniform(seed, epoch, 1, *keys) * F.lit(scale[1] - scale[0])
    side = lambda size: F.greatest(F.lit(1), F.least(size, F.rint(size * F.col("_s")))).cast("long")
    edge = lambda pick, k: pick(F.transform("boxes", lambda b: b[k]))
    some = F.size("boxes") > 0
    out = samples.withColumn("_s", factor).withColumn("_x1", F.floor(edge(F.array_min, "x1"))).withColumn(
        "_y1", F.floor(edge(F.array_min, "y1"))
    ).withColumn("_x2", F.ceil(edge(F.array_max, "x2"))).withColumn("_y2", F.ceil(edge(F.array_max, "y2")))
    grow = lambda size, a, b: F.when(some, F.least(size, F.greatest(side(size), b - a))).otherwise(side(size))
    out = out.withColumn("_cw", grow(w, F.col("_x1"), F.col("_x2"))).withColumn("_ch", grow(h, F.col("_y1"), F.col("_y2")))

    def start(size: Column, crop: Column, a: Column, b: Column, salt: int) -> Column:
        low = F.when(some, F.greatest(F.lit(0), b - crop)).otherwise(0)
        high = F.when(some, F.greatest(low, F.least(size - crop, a))).otherwise(size - crop)
        return _between(low, high, _uniform(seed, epoch, salt, *keys))

    out = out.withColumn("_l", start(w, F.col("_cw"), F.col("_x1"), F.col("_x2"), 2)).withColumn(
        "_t", start(h, F.col("_ch"), F.col("_y1"), F.col("_y2"), 3)
    )
    crop = make_box("_l", "_t", F.col("_l") + F.col("_cw"), F.col("_t") + F.col("_ch"), "long")
    return out.withColumn("crop", crop).drop("_s", "_x1", "_y1", "_x2", "_y2", "_cw", "_ch", "_l", "_t")


def epoch_geometry_plan(
    items: DataFrame, resize_scale: float, min_short_edge: float, protect: bool, seed: int, epoch: int,
    crop_scale: tuple[float, float] = (0.3, 0.9),
) -> DataFrame:
    """Sizes and scales of all items (root, sample_id, sample_type, crop_view, width, height, boxes, ignored_boxes).

    With protection, negatives draw their scale from the positives: the drawn rank is looked up among ranked scales.
    """
    cropped = F.col("sample_type") == "random_crop"
    plan = random_crop_plan(items, crop_scale, seed, epoch)
    crop = F.when(cropped, F.col("crop")).otherwise(make_box(F.lit(0), F.lit(0), "width", "height", "long"))
    plan = plan.withColumn("crop", crop)
    for name in ("boxes", "ignored_boxes"):
        plan = plan.withColumn(name, F.when(cropped, crop_boxes(F.col(name), F.col("crop"))).otherwise(F.col(name)))
    plan = plan.withColumn("width", (F.col("crop.x2") - F.col("crop.x1")).cast("long")).withColumn(
        "height", (F.col("crop.y2") - F.col("crop.y1")).cast("long")
    ).withColumn("has_subtitle", F.size("boxes") > 0)
    g = protection_geometry(F.col("boxes"), F.col("width"), F.col("height"), F.lit(resize_scale), min_short_edge)
    plan = plan.withColumn("_g", g)
    own = F.col("_g.scale") if protect else F.lit(resize_scale)
    plan = plan.withColumn("_own", own)
    keys = ["root", "sample_id", "crop_view"]
    if protect:
        # Ranking reads the donors three times. A filter on the plan itself would be pushed down to the items, and with it, many times over,
        # all that crops and cut boxes are computed from; on written rows it is one comparison.
        scales = checkpointed(plan.select(*keys, "has_subtitle", "_own", F.xxhash64(*keys).alias("_h")))
        donors = scales.filter("has_subtitle").drop("has_subtitle")
        ranked = with_rank(donors, ["_h", *keys], hash_block(F.col("_h")), (), "_at").select("_at", F.col("_own").alias("_donor"))
        total = donors.agg(F.count(F.lit(1)).alias("n")).scalar()
        draw = F.floor(_uniform(seed, epoch, 9, *keys) * F.col("_n")).cast("long")
        plan = plan.withColumn("_n", total).withColumn("_at", F.when(~F.col("has_subtitle"), draw))
        plan = plan.join(ranked, "_at", "left").drop("_at", "_n")
        scale = F.when(F.col("has_subtitle"), F.col("_own")).otherwise(F.coalesce("_donor", F.lit(resize_scale)))
    else:
        plan = plan.withColumn("_donor", F.lit(None).cast("double"))
        scale = F.lit(resize_scale)
    plan = plan.withColumn("resize_scale", scale)
    size = aligned_resize_size("width", "height", "resize_scale")
    standard = F.col("_g.standard")
    plan = plan.withColumn("_size", size).select(
        "*", standard["width"].alias("standard_width"), standard["height"].alias("standard_height"),
        F.col("_size.width").alias("output_width"), F.col("_size.height").alias("output_height"),
        F.col("_g.short_edge").alias("standard_short_edge"), F.col("_g.satisfied").alias("protection_satisfied"),
    )
    small = F.lit(protect) & F.col("has_subtitle") & (F.col("standard_short_edge") < SMALL_EDGE)
    view_id = F.when(cropped, F.concat("sample_id", F.lit("#crop"), F.col("crop_view"))).otherwise(F.col("sample_id"))
    return plan.withColumn("item_id", view_id).withColumn("small_warning", small).drop("_g", "_own", "_donor", "_size")


def small_subtitle_summary(warnings: DataFrame) -> DataFrame:
    """Warning events, distinct samples and those still too small at full scale."""
    return warnings.agg(
        F.count(F.lit(1)).alias("warning_events"), F.count_distinct("image_path", "sample_id").alias("unique_warning_samples"),
        F.count_if(~F.col("protection_satisfied")).alias("unsatisfied_events"),
    )


def data_manifest(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Planned items with the byte size and time of their image (``files``: image_path, length, modified)."""
    coords = lambda c: F.transform(c, lambda b: F.array(b["x1"], b["y1"], b["x2"], b["y2"]))
    return plan.join(files, "image_path", "left").select(
        "root", F.col("item_id").alias("sample_id"), "image_path", "width", "height", "standard_width", "standard_height",
        "output_width", "output_height", "resize_scale", "standard_short_edge", F.col("length").alias("image_bytes"),
        F.col("modified").alias("image_modified"), "has_subtitle", "sample_type",
        F.when(F.col("sample_type") == "random_crop", F.col("crop_view")).alias("crop_view"),
        coords("boxes").alias("boxes"), coords("ignored_boxes").alias("ignored_boxes"),
    )


def dataset_summary(samples: DataFrame) -> DataFrame:
    """Counts and ratios overall, per root and per sample type in one grouping-sets pass (dropped rows counted apart)."""
    kept = ~F.col("dropped")
    total = F.count_if(kept)
    ratio = lambda c: F.when(total > 0, F.count_if(kept & c) / total).otherwise(0.0)
    sets = samples.groupingSets([[], [F.col("root")], [F.col("sample_type")]], "root", "sample_type")
    return sets.agg(
        total.alias("total"), F.count_if(kept & F.col("has_subtitle")).alias("positive"),
        F.count_if(kept & ~F.col("has_subtitle")).alias("empty"), ratio(F.col("has_subtitle")).alias("positive_ratio"),
        ratio(~F.col("has_subtitle")).alias("empty_ratio"), F.count_if("dropped").alias("dropped"),
    )


def segment_stats(samples: DataFrame) -> DataFrame:
    """Positive segments, repeated ones and same-segment pairs, by segment id alone."""
    sizes = samples.filter("has_subtitle").groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("positive_segments"), F.count_if(F.col("n") >= 2).alias("repeated_positive_segments"),
        F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("same_segment_pairs"),
    )
