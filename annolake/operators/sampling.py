"""Deterministic quotas and orders. Ranks are block-wise, so one hot root or class never sits in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.geometry import clamp, rect_to_yolo
from annolake.operators.ordered import crc_block, dense_block, index_block, running_sums, with_rank


def crc_hash(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def md5_hash(text: Column) -> Column:
    """32 bits of md5, for engines without crc32."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _name(root: Column) -> Column:
    """Last path part of a root."""
    return F.element_at(F.split(F.rtrim(root, F.lit("/")), "/"), -1)


def spread(samples: DataFrame, hash_fn=crc_hash, label: Column | None = None, name: str = "spread") -> DataFrame:
    label = F.col("sample_id") if label is None else label
    return samples.withColumn(name, hash_fn(F.concat_ws("/", _name(F.col("root")), label.cast("string"))))


def spread_order(samples: DataFrame, hash_fn=crc_hash) -> DataFrame:
    """Position of every sample in hash order."""
    return with_rank(spread(samples, hash_fn), ["spread", "sample_idx"], crc_block(F.col("spread")), (), "position")


def head(samples: DataFrame, count: int) -> DataFrame:
    """First rows in list order."""
    ranked = with_rank(samples, ["sample_idx"], index_block(F.col("sample_idx")), (), "_at")
    return ranked.filter(F.col("_at") < count).drop("_at")


def quotas(maximum: int, empty_ratio: float) -> tuple[int, int]:
    empty = min(maximum, int(round(maximum * empty_ratio)))
    return maximum - empty, empty


def _refilled(n_first: Column, n_second: Column, first: int, second: int, maximum: int) -> tuple[Column, Column]:
    """Take counts of two pools after refilling from the first, then from the second."""
    a, b = F.least(n_first, F.lit(first)), F.least(n_second, F.lit(second))
    more = F.least(n_first - a, F.lit(maximum) - a - b)
    return a + more, b + F.least(n_second - b, F.lit(maximum) - a - b - more)


def _class_sizes(samples: DataFrame, flag: str) -> DataFrame:
    sizes = samples.agg(F.count_if(flag).alias("a"), F.count_if(~F.col(flag)).alias("b"))
    return sizes.agg(F.first(F.struct("a", "b")).alias("s"))


def limit_by_class(samples: DataFrame, maximum: int, empty_ratio: float | None, hash_fn=crc_hash) -> DataFrame:
    """Class quotas in hash order; what one class lacks the other fills. Without a ratio: the head."""
    if empty_ratio is None:
        return head(samples, maximum)
    first, second = quotas(maximum, empty_ratio)
    ranked = with_rank(spread(samples, hash_fn), ["spread", "sample_idx"], crc_block(F.col("spread")), ["has_subtitle"], "_at")
    sized = ranked.withColumn("_s", _class_sizes(samples, "has_subtitle").scalar())
    a, b = _refilled(F.col("_s.a"), F.col("_s.b"), first, second, maximum)
    return sized.filter(F.col("_at") < F.when(F.col("has_subtitle"), a).otherwise(b)).drop("_s", "_at", "spread")


def limit_root_balanced(
    samples: DataFrame, maximum: int, empty_ratio: float, flag: str = "has_label", hash_fn=crc_hash
) -> DataFrame:
    """Round robin over roots per class: order by (rank inside the root, root), cut at the class quota.

    The result carries ``turn``, its place in its class.
    """
    first, second = quotas(maximum, empty_ratio)
    hashed = spread(samples, hash_fn)
    ranked = with_rank(hashed, ["spread", "sample_idx"], crc_block(F.col("spread")), ["root", flag], "_rn")
    placed = with_rank(ranked, ["_rn", "root"], dense_block(F.col("_rn"), 1024), [flag], "turn")
    sized = placed.withColumn("_s", _class_sizes(samples, flag).scalar())
    a, b = _refilled(F.col("_s.a"), F.col("_s.b"), first, second, maximum)
    return sized.filter(F.col("turn") < F.when(F.col(flag), a).otherwise(b)).drop("_s", "_rn", "spread")


def interleave_classes(chosen: DataFrame, flag: str = "has_label") -> DataFrame:
    """Place of each row when one empty row follows every L // E labelled rows (``turn``: rank in the class)."""
    sized = chosen.withColumn("_s", _class_sizes(chosen, flag).scalar())
    labelled, empty, turn = F.col("_s.a"), F.col("_s.b"), F.col("turn")
    gap = F.greatest(F.lit(1), F.floor(labelled / F.greatest(F.lit(1), empty)))
    slot = (turn + 1) * gap - 1
    late = slot >= labelled
    first = F.when(F.col(flag), turn).when(late, labelled + turn).otherwise(slot).cast("long")
    second = F.when(~F.col(flag) & ~late, 1).otherwise(0)
    keyed = sized.withColumn("_k", first).withColumn("_e", second)
    return with_rank(keyed, ["_k", "_e"], dense_block(F.col("_k"), 4096), (), "position").drop("_k", "_e", "_s")


def limit_segment_aware(samples: DataFrame, maximum: int, empty_ratio: float | None, hash_fn=crc_hash) -> DataFrame:
    """Repeated segments first (a partial one only with two rows or more), then single rows, empties and a refill."""
    rows = spread(samples, hash_fn)
    n = samples.agg(F.struct(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("has_subtitle")).alias("empty")).alias("s")).scalar()
    share = F.col("_n.empty") / F.greatest(F.lit(1), F.col("_n.all")) if empty_ratio is None else F.lit(float(empty_ratio))
    empty_target = F.least(F.lit(maximum), F.rint(maximum * share)).cast("long")
    groups = rows.filter("has_subtitle").groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("sample_idx", "root")).alias("head")
    ).select("segment_id", "size", F.col("head.sample_idx").alias("head_idx"), F.col("head.root").alias("root"))
    groups = spread(groups, hash_fn, F.col("segment_id"), "group_spread").withColumn("paired", F.col("size") >= 2)
    groups = running_sums(
        groups, ["group_spread", "head_idx"], {"start": F.col("size")}, ["paired"], crc_block(F.col("group_spread"))
    ).withColumn("_n", n)
    target = F.lit(maximum) - empty_target
    share_of = F.greatest(F.lit(0), F.least(F.col("size"), target - F.col("start")))
    groups = groups.withColumn("grant", F.when(F.col("paired") & (share_of == 1), 0).otherwise(share_of))
    granted = groups.filter("paired").agg(F.coalesce(F.sum("grant"), F.lit(0)).alias("g")).scalar()
    groups = groups.withColumn("_g", granted).withColumn(
        "take", F.when(F.col("paired"), F.col("grant")).otherwise((F.col("start") < target - F.col("_g")).cast("long"))
    ).select("segment_id", "take")
    seat = F.when(F.col("has_subtitle"), F.col("segment_id"))
    ranked = with_rank(rows.withColumn("_seat", seat), ["spread", "sample_idx"], crc_block(F.col("spread")), ["has_subtitle", "_seat"], "_at")
    tagged = ranked.join(groups, "segment_id", "left").withColumn("_n", n)
    chosen = F.col("_at") < F.when(F.col("has_subtitle"), F.col("take")).otherwise(empty_target)
    tagged = tagged.withColumn("_in", F.coalesce(chosen, F.lit(False)))
    refill = with_rank(tagged, ["spread", "sample_idx"], crc_block(F.col("spread")), ["_in"], "_rest")
    picked = tagged.agg(F.count_if("_in").alias("c")).scalar()
    final = refill.withColumn("_c", picked).filter(F.col("_in") | (F.col("_rest") < F.lit(maximum) - F.col("_c")))
    return final.select(*samples.columns)


def domain_interleave(frames: DataFrame, views: int, maximum: int | None = None) -> DataFrame:
    """i-th full frame, i-th ROI, then the crop views of that frame (``sample_type`` full_frame or roi)."""
    turns = with_rank(frames, ["sample_idx"], index_block(F.col("sample_idx")), ["sample_type"], "turn")
    crops = F.transform(F.sequence(F.lit(1), F.lit(max(views, 1))), lambda v: F.struct(
        F.lit("random_crop").alias("sample_type"), F.lit(2).alias("kind"), (v - 1).alias("crop_view")))
    own = F.struct(F.col("sample_type"), F.when(F.col("sample_type") == "roi", 1).otherwise(0).alias("kind"), F.lit(0).alias("crop_view"))
    full = F.concat(F.array(own), crops) if views > 0 else F.array(own)
    items = F.explode(F.when(F.col("sample_type") == "full_frame", full).otherwise(F.array(own)))
    out = turns.withColumn("_i", items).drop("sample_type").select("*", "_i.*").drop("_i")
    placed = with_rank(out, ["turn", "kind", "crop_view"], dense_block(F.col("turn"), 4096), (), "position")
    return (placed if maximum is None else placed.filter(F.col("position") < maximum)).drop("kind", "turn")


def assign_donors(samples: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Two negatives per positive from its root (else from all), picked by the CRC of the full key."""
    pool = samples if pool is None else pool
    negatives = pool.filter("not has_subtitle").select("root", "sample_id", "sample_idx")
    both = negatives.withColumn("pool", F.explode(F.array(F.col("root"), F.lit(None).cast("string"))))
    ranked = with_rank(both, ["sample_idx"], index_block(F.col("sample_idx")), ["pool"], "at", totals=True)
    sizes = negatives.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    whole = negatives.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = samples.filter("has_subtitle").select("root", "sample_id").join(
        sizes.withColumn("pool", F.col("root")), "root", "left"
    ).withColumn("_all", whole).withColumn("n", F.coalesce("n", "_all"))
    first = F.pmod(F.crc32(F.concat_ws("/", "root", "sample_id").cast("binary")), F.greatest(F.col("n"), F.lit(1)))
    second = (first + F.greatest(F.lit(1), F.floor(F.col("n") / 2))) % F.greatest(F.col("n"), F.lit(1))
    slots = wanted.select("root", "sample_id", "pool", F.posexplode(F.array(first, second)).alias("slot", "at"))
    donors = ranked.select("pool", "at", F.col("sample_id").alias("donor"))
    same = slots["pool"].eqNullSafe(donors["pool"]) & (slots["at"] == donors["at"])
    hit = slots.join(donors, same, "left")
    pick = lambda k: F.max(F.when(F.col("slot") == k, F.col("donor")))
    return hit.groupBy("root", "sample_id").agg(pick(0).alias("first_donor"), pick(1).alias("second_donor"))


def synthetic_plan(
    backgrounds: DataFrame, subtitles: DataFrame, count: int, seed: int, margin: int = 24,
    region: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Draws of (background, subtitle) with a placed box. Inputs carry ``at`` (0-based rank) and their sizes.

    ``backgrounds``: at, image, width, height; ``subtitles``: at, subtitle, text_width, text_height.
    """
    spark = backgrounds.sparkSession
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = spark.range(1, count + 1).withColumnRenamed("id", "draw").withColumn("_b", size(backgrounds)).withColumn("_t", size(subtitles))
    roll = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "draw"), F.greatest(n, F.lit(1)))
    draws = draws.withColumn("bg", roll(1, F.col("_b"))).withColumn("st", roll(2, F.col("_t")))
    both = draws.join(backgrounds.withColumnRenamed("at", "bg"), "bg").join(subtitles.withColumnRenamed("at", "st"), "st")
    w, h = F.col("width"), F.col("height")
    if region is None:
        corner = (F.lit(margin), F.floor(h * 0.55), w - margin, h - margin)
    else:
        corner = tuple(F.lit(v) for v in region)
    x1, y1 = clamp(corner[0], F.lit(0), w - 1), clamp(corner[1], F.lit(0), h - 1)
    x2, y2 = clamp(corner[2], x1 + 1, w), clamp(corner[3], y1 + 1, h)
    bw, bh = F.least(F.col("text_width") + margin, x2 - x1), F.least(F.col("text_height") + margin, y2 - y1)
    both = both.select("draw", "image", "subtitle", "width", "height", x1.alias("x1"), y1.alias("y1"),
                       F.greatest(x1, x2 - bw).alias("mx"), F.greatest(y1, y2 - bh).alias("my"),
                       bw.cast("long").alias("box_width"), bh.cast("long").alias("box_height"))
    within = lambda low, high, salt: (F.col(low) + roll(salt, F.col(high) - F.col(low) + 1)).cast("long")
    placed = both.withColumn("x", within("x1", "mx", 3)).withColumn("y", within("y1", "my", 4))
    line = rect_to_yolo("x", "y", "box_width", "box_height", "width", "height")
    return placed.select(
        F.format_string("synthetic_%06d", "draw").alias("sample_id"), "image", "subtitle", "width", "height", "x", "y",
        "box_width", "box_height", line.alias("yolo_label"),
    )
