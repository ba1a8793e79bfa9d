"""Epoch batch plans. A shuffle is the order of a seeded hash; batches come from slot arithmetic on ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.operators.ordered import hash_block, with_rank
from annolake.operators.pairs import hash_key, sample_with_refill
from annolake.session import checkpointed

REQUIRED_TYPES = ("full_frame", "roi", "random_crop")


def class_slots(batch_size: int, negative_ratio: float, n_pos: int, n_neg: int) -> tuple[int, int]:
    """(positive, negative) slots of a batch."""
    if batch_size <= 0:
        raise ValueError("batch_size must be at least 1")
    if not 0.0 <= negative_ratio <= 1.0:
        raise ValueError("negative_ratio outside [0, 1]")
    if n_pos and n_neg:
        negative = round(batch_size * negative_ratio)
        return batch_size - negative, negative
    return (0, batch_size) if n_neg else (batch_size, 0)


def _draws(pool: DataFrame, size: int, count: int, seed: int, epoch: int, keys: list[str]) -> DataFrame:
    """``count`` numbered draws in shuffled passes over the pool."""
    drawn = sample_with_refill(pool, keys, count, seed, epoch, size)
    drawn = drawn.withColumn("_h", hash_key(seed, epoch, "pass", *keys))
    ranked = with_rank(drawn, ["_h", *keys], hash_block(F.col("_h")), ["pass"], "_at")
    return ranked.withColumn("draw", F.col("pass") * F.lit(size) + F.col("_at")).drop("_h", "_at", "pass")


def _into_batches(draws: DataFrame, slots: int, base: int = 0) -> DataFrame:
    at = F.col("draw")
    return draws.withColumn("batch", F.floor(at / slots).cast("long")).withColumn("slot", (at % slots + base).cast("long")).drop("draw")


def _counts(samples: DataFrame) -> tuple[int, int]:
    row = samples.agg(F.count_if("has_subtitle"), F.count_if(~F.col("has_subtitle"))).first()
    return row[0], row[1]


def balanced_batches(samples: DataFrame, batch_size: int, negative_ratio: float, seed: int, epoch: int) -> DataFrame:
    """Fixed slots per class in every batch; a class pool is reshuffled when it runs out."""
    n_pos, n_neg = _counts(samples)
    pos, neg = class_slots(batch_size, negative_ratio, n_pos, n_neg)
    if n_pos and n_neg and ((negative_ratio > 0 and neg == 0) or (negative_ratio < 1 and pos == 0)):
        raise ValueError("batch too small for this ratio")
    batches = -(-(n_pos + n_neg) // batch_size)
    keyed = samples.select("root", "sample_id", "sample_idx", "has_subtitle")
    parts = []
    for flag, size, slots, base in ((True, n_pos, pos, 0), (False, n_neg, neg, pos)):
        if size and slots:
            pool = keyed.filter(F.col("has_subtitle") == flag)
            parts.append(_into_batches(_draws(pool, size, batches * slots, seed, epoch, ["sample_idx"]), slots, base))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def segment_paired_batches(samples: DataFrame, batch_size: int, negative_ratio: float, seed: int, epoch: int) -> DataFrame:
    """Balanced batches in which drawn segments bring two samples each.

    Repeated segments take turns in a shuffled rotation. On its v-th turn a segment of n members gives members 2v and
    2v+1 (mod n) of its own shuffle, so unseen members come first. Slots left over go to samples that no turn reaches,
    then to a new pass over all positives.
    """
    n_pos, n_neg = _counts(samples)
    pos, neg = class_slots(batch_size, negative_ratio, n_pos, n_neg)
    if n_pos and n_neg and (pos < 2 or (negative_ratio > 0 and neg < 1)):
        raise ValueError("a batch needs two subtitle places and one empty place")
    needs = [-(-n // s) for n, s in ((n_pos, pos), (n_neg, neg)) if n and s]
    batches = max(needs, default=0)
    keyed = samples.select("root", "sample_id", "sample_idx", "segment_id", "has_subtitle")
    spark = samples.sparkSession
    parts = []
    if n_pos and pos:
        positive = keyed.filter("has_subtitle").withColumn("_h", hash_key(seed, epoch, "sample_idx"))
        members = with_rank(positive, ["_h", "sample_idx"], hash_block(F.col("_h")), ["root", "segment_id"], "member", totals=True)
        groups = members.filter("member = 0 and member_total > 1").select("root", "segment_id", F.col("member_total").alias("size"))
        n_groups = groups.count()
        turns = min(max(1, pos // 2), n_groups) if pos >= 2 else 0
        fill = pos - 2 * turns
        picked = None
        if turns:
            ring = groups.withColumn("_h", hash_key(seed, epoch, "root", "segment_id"))
            ring = with_rank(ring, ["_h", "root", "segment_id"], hash_block(F.col("_h")), (), "seat").drop("_h")
            visits = spark.range(batches * turns).select(
                F.floor(F.col("id") / turns).alias("batch"), (F.col("id") % turns).alias("turn"),
                (F.col("id") % n_groups).alias("seat"), F.floor(F.col("id") / n_groups).alias("visit"),
            )
            two = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
            picks = visits.join(ring, "seat").select("batch", "turn", "root", "segment_id", "size", "visit", two)
            picks = picks.withColumn("member", (F.col("visit") * 2 + F.col("k")) % F.col("size"))
            rows = members.select("root", "segment_id", "member", "sample_id", "sample_idx", "has_subtitle")
            picked = picks.join(rows, ["root", "segment_id", "member"]).select(
                "root", "sample_id", "sample_idx", "has_subtitle", "batch", (F.col("turn") * 2 + F.col("k")).cast("long").alias("slot")
            )
            parts.append(picked)
        if fill:
            pool = positive.drop("_h", "segment_id")
            fresh = pool if picked is None else pool.join(picked.select("sample_idx").distinct(), "sample_idx", "left_anti")
            n_fresh = fresh.count()
            want = batches * fill
            first = _draws(fresh, n_fresh, min(want, n_fresh), seed, epoch, ["sample_idx"]) if n_fresh else None
            rest = want - min(want, n_fresh)
            if rest:
                more = _draws(pool, n_pos, rest, seed, epoch + 1, ["sample_idx"]).withColumn("draw", F.col("draw") + min(want, n_fresh))
                first = more if first is None else first.unionByName(more)
            parts.append(_into_batches(first, fill, 2 * turns))
    if n_neg and neg:
        pool = keyed.filter("not has_subtitle").drop("segment_id")
        parts.append(_into_batches(_draws(pool, n_neg, batches * neg, seed, epoch, ["sample_idx"]), neg, pos))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def mixed_macro_batches(items: DataFrame, batch_size: int, seed: int, epoch: int) -> DataFrame:
    """Every item once; each batch holds all six (type, label) groups and at least two output sizes."""
    if batch_size < 2 * len(REQUIRED_TYPES):
        raise ValueError("a mixed batch needs at least six places")
    items = checkpointed(items)
    sizes = {(r["sample_type"], r["has_subtitle"]): r["n"] for r in
             items.filter(F.col("sample_type").isin(*REQUIRED_TYPES)).groupBy("sample_type", "has_subtitle").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = items.count()
    batches = max(1, total // batch_size)
    for kind in REQUIRED_TYPES:
        for label in (False, True):
            if sizes.get((kind, label), 0) < batches:
                raise RuntimeError(f"too few samples to mix: {kind}, {label} has {sizes.get((kind, label), 0)} of {batches}")
    keyed = items.withColumn("_h", hash_key(seed, epoch, "item"))
    grouped = with_rank(keyed, ["_h", "item"], hash_block(F.col("_h")), ["sample_type", "has_subtitle"], "_g")
    grouped = grouped.withColumn("_seed", F.col("_g") < batches)
    ranked = with_rank(grouped, ["_h", "item"], hash_block(F.col("_h")), ["_seed"], "_r")
    extra = total - batches * batch_size
    wide, room = extra % batches, batch_size + extra // batches - 6
    at = F.col("_r")
    narrow = F.lit(wide) + F.floor((at - wide * (room + 1)) / max(room, 1))
    spread = F.when(at < wide * (room + 1), F.floor(at / (room + 1))).otherwise(narrow)
    batch = F.when(F.col("_seed"), F.col("_g")).otherwise(spread).cast("long")
    out = ranked.withColumn("batch", batch).drop("_h", "_g", "_seed", "_r")
    checks = out.groupBy("batch").agg(F.count_distinct("output_width", "output_height").alias("sizes"))
    enough = checks.agg((F.min("sizes") >= 2).alias("ok")).scalar()
    error = F.raise_error(F.lit("a mixed batch came out with one output size only")).cast("boolean")
    return out.withColumn("_ok", enough).filter(F.when(F.col("_ok"), F.lit(True)).otherwise(error)).drop("_ok")


def micro_batches(macro: DataFrame, order: str = "item") -> DataFrame:
    """Split each macro batch by exact output size, in first-seen order. A batch bounds the list sizes."""
    parts = macro.groupBy("batch", "output_width", "output_height").agg(
        F.min(order).alias("_first"), F.count(F.lit(1)).alias("items"),
        F.array_sort(F.collect_list(order)).alias("members"),
    )
    number = F.row_number().over(W.partitionBy("batch").orderBy("_first")) - 1
    return parts.withColumn("micro", number.cast("long")).drop("_first")


def batch_stats(batches: DataFrame, samples: DataFrame) -> DataFrame:
    """Coverage and class counts of a plan."""
    total = samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    return batches.agg(
        F.count_distinct("batch").alias("batches"), F.count(F.lit(1)).alias("slots"),
        F.count_distinct("sample_idx").alias("covered"), F.count_if("has_subtitle").alias("positive_slots"),
    ).withColumn("samples", total)
