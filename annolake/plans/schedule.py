"""Pair schedule of one epoch: coverage-first positives, ranked negatives, packed batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.operators.ordered import dense_block, exploded_range, hash_block, index_block, running_sums, with_rank
from annolake.operators.pairs import hardest_local_negatives, hash_key, local_groups, ocr_negative_pool, ocr_negatives_drawn, positives_only, prepared
from annolake.session import checkpointed

SEGMENT = ["root", "segment_id"]
#: Bins of the histogram of frames, and parts that a range of spans is cut into by each round of exact counts.
BINS, CUTS = 1024, 15


def _members(samples: DataFrame) -> DataFrame:
    """Positive samples of segments with two or more, by frame: ``r`` (samples without a frame come last), ``n`` of the segment, ``m`` with a frame."""
    positive = positives_only(samples)
    rows = positive.select("root", "segment_id", "sample_idx", F.col("frame_index").cast("long").alias("f"))
    sizes = rows.groupBy("root", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.count("f").alias("m")).filter("n > 1")
    rows = rows.join(sizes, SEGMENT)
    timed = with_rank(rows.filter("f is not null"), ["f", "sample_idx"], dense_block(F.col("f")), SEGMENT, "r")
    rest = with_rank(rows.filter("f is null"), ["sample_idx"], index_block(F.col("sample_idx")), SEGMENT, "r")
    return checkpointed(timed.unionByName(rest.withColumn("r", F.col("r") + F.col("m"))))


def _cover(members: DataFrame) -> DataFrame:
    """Pairs that cover all members, widest first: ``a, b, span, stage``.

    Members with a frame nest: the widest pair of what is left is always (first, last). What is left over in the middle and the members
    without a frame, whose pairs have span 0, go two by two. A last one takes the member that is farthest away.
    """
    n, m, r = F.col("n"), F.col("m"), F.col("r")
    half = F.floor(m / 2)
    # Places of the left over: the middle one of an odd number, then those without a frame.
    odd = m % 2
    spare = F.when(r >= m, r - m + odd).when((odd == 1) & (r == half), F.lit(0))
    rows = members.withColumns({"_half": half, "_spare": spare.cast("long"), "_spares": (n - m + odd).cast("long")})
    left = rows.select(*SEGMENT, "n", "m", "r", "_half", "_spare", "_spares", F.col("sample_idx").alias("a"), F.col("f").alias("fa"))
    nested = (r < F.col("_half")) & F.col("_spare").isNull()
    two = (F.col("_spare") % 2 == 0) & (F.col("_spare") + 1 < F.col("_spares"))
    last = (F.col("_spare") % 2 == 0) & (F.col("_spare") + 1 == F.col("_spares"))
    # The next spare stands behind this one, or first of those without a frame.
    next_spare = F.when(r >= m, r + 1).otherwise(m)
    partner = F.when(nested, m - 1 - r).when(two, next_spare).when(last & (r < m), m - 1).when(last, F.lit(0))
    first = (r == 0) & nested
    stage = F.when(first, 0).when(nested | two, 1).otherwise(2)
    # A segment without nested pairs has its widest one among the others.
    lone = (F.col("_half") == 0) & (F.col("_spare") == 0) & two
    pairs = left.withColumns({"hi": partner, "stage": F.when(lone, 0).otherwise(stage)}).filter("hi is not null")
    right = rows.select(*SEGMENT, F.col("r").alias("hi"), F.col("sample_idx").alias("b"), F.col("f").alias("fb"))
    ends = rows.filter("r = 0").select(*SEGMENT, F.col("sample_idx").alias("a0"), F.col("f").alias("f0"))
    both = pairs.join(right, [*SEGMENT, "hi"]).join(ends, SEGMENT)
    # The middle one may be farther from the first than from the last member.
    swap = (F.col("stage") == 2) & F.col("fa").isNotNull() & (F.col("fa") - F.col("f0") > F.col("fb") - F.col("fa"))
    other, far = F.when(swap, F.col("a0")).otherwise(F.col("b")), F.when(swap, F.col("f0")).otherwise(F.col("fb"))
    span = F.coalesce(F.abs(far - F.col("fa")), F.lit(0))
    return both.select(*SEGMENT, "a", other.alias("b"), span.alias("span"), "stage")


def _wide_counts(timed: DataFrame, cover: DataFrame, spans: list[int]) -> dict[int, int]:
    """How many pairs of one segment that are not in ``cover`` are at least so wide (1 or more), without listing any.

    Each member asks how many come before its frame plus the span; questions and members are laid out in one order and counted.
    """
    every = F.explode(F.array(*(F.lit(s).cast("long") for s in spans)))
    asked = timed.withColumn("_span", every).select(*SEGMENT, (F.col("f") + F.col("_span")).alias("f"), "_span", "m")
    both = timed.select(*SEGMENT, "f", F.lit(None).cast("long").alias("_span"), "m").unionByName(asked)
    counted = running_sums(both, ["f", F.asc_nulls_last("_span")], {"_lo": F.col("_span").isNull().cast("long")}, SEGMENT, dense_block(F.col("f")))
    found = counted.filter("_span is not null").select("_span", (F.col("m") - F.col("_lo")).alias("c"))
    taken = cover.select("span", every.alias("_span")).filter("span >= _span").select("_span", F.lit(-1).cast("long").alias("c"))
    return {s: 0 for s in spans} | {r["_span"]: int(r["c"]) for r in found.unionByName(taken).groupBy("_span").agg(F.sum("c").alias("c")).collect()}


def _lags(frames: pd.DataFrame) -> pd.DataFrame:
    """How many pairs of the rows of one segment lie how many bins apart."""
    own = np.zeros(int(frames["_bin"].max()) + 1, np.int64)
    np.add.at(own, frames["_bin"].to_numpy(), frames["count"].to_numpy())
    lags = np.correlate(own, own, "full")[len(own) - 1 :]
    lags[0] = (lags[0] - own.sum()) // 2
    some = np.flatnonzero(lags)
    return pd.DataFrame({"lag": some, "pairs": lags[some]})


def span_threshold(timed: DataFrame, cover: DataFrame, wanted: int) -> int:
    """The largest span (1 or more) such that at least ``wanted`` pairs beside ``cover`` are as wide; 0 if there is none.

    A histogram of frames per segment bounds it: bins that lie ``d`` apart hold spans above ``d - 1`` and below ``d + 1`` bins. Exact
    counts then cut what is left into parts, again and again. Bins as wide as one frame leave nothing to cut.
    """
    low, high = timed.agg(F.min("f"), F.max("f")).first()
    if low is None or high == low:
        return 0
    width = -(-(high - low + 1) // BINS)
    bins = timed.groupBy(*SEGMENT, F.floor((F.col("f") - F.lit(low)) / width).cast("long").alias("_bin")).count()
    # At most BINS rows a segment meet; their lags are added up.
    lags = bins.groupBy(*SEGMENT).applyInPandas(_lags, "lag long, pairs long")
    taken = cover.filter("span > 0").select(F.floor((F.col("span") - 1) / width).cast("long").alias("lag"), F.lit(-1).cast("long").alias("pairs"))
    pairs, less = np.zeros(BINS + 2, np.int64), np.zeros(BINS + 2, np.int64)
    for own, lag, n in lags.select(F.lit(0), "*").unionByName(taken.select(F.lit(1), "*").toDF("0", "lag", "pairs")).groupBy("0", "lag").agg(F.sum("pairs")).collect():
        (less if own else pairs)[lag] = n
    wide, less = np.cumsum(pairs[::-1])[::-1], np.cumsum(less[::-1])[::-1]
    # Beyond ``d`` bins (``d * width + 1`` or more) lie all pairs of more than d lags and none of fewer.
    surely = np.flatnonzero(wide[1:] + less[:-1] >= wanted)
    never = np.flatnonzero(wide + less < wanted)
    below = int(surely[-1]) * width + 1 if len(surely) else 0
    above = int(never[0]) * width + 1
    if width == 1:
        return below
    # Enough are as wide as ``below`` (0: all), not enough as wide as ``above``.
    while above - below > 1:
        cuts = sorted({below + (above - below) * k // (CUTS + 1) for k in range(1, CUTS + 1)} - {below, above})
        told = _wide_counts(timed, cover, cuts)
        below = max([s for s in cuts if told[s] >= wanted], default=below)
        above = min([s for s in cuts if told[s] < wanted], default=above)
    return below


def _unfolded(members: DataFrame, low: Column, high: Column, keep: list[str]) -> DataFrame:
    """Pairs of each member with the members of its segment from place ``low`` to ``high`` (that one left out): ``a, b, span``."""
    flat = members.select(*SEGMENT, "r", *keep, F.col("sample_idx").alias("a"), F.col("f").alias("fa"), low.alias("_low"), high.alias("_high"))
    flat = exploded_range(flat, F.col("_high") - F.col("_low"), "_step", [*SEGMENT, "r"]).withColumn("hi", F.col("_low") + F.col("_step"))
    right = members.select(*SEGMENT, F.col("r").alias("hi"), F.col("sample_idx").alias("b"), F.col("f").alias("fb"))
    span = F.coalesce(F.abs(F.col("fb") - F.col("fa")), F.lit(0)).alias("span")
    return flat.join(right, [*SEGMENT, "hi"]).select(*SEGMENT, "a", "b", span)


def _first_wider(members: DataFrame, spans: list[int]) -> DataFrame:
    """Members with ``_lo_<k>``: the place of the first one at least ``spans[k]`` behind (of those with a frame)."""
    timed = members.filter("f is not null")
    asked = timed.withColumn("_k", F.explode(F.array(*map(F.lit, range(len(spans))))))
    away = F.element_at(F.array(*(F.lit(s).cast("long") for s in spans)), F.col("_k") + 1)
    asked = asked.select(*SEGMENT, (F.col("f") + away).alias("f"), "_k", "r")
    both = timed.select(*SEGMENT, "f", F.lit(None).cast("int").alias("_k"), "r").unionByName(asked)
    counted = running_sums(both, ["f", F.asc_nulls_last("_k")], {"_lo": F.col("_k").isNull().cast("long")}, SEGMENT, dense_block(F.col("f")))
    places = counted.filter("_k is not null").groupBy(*SEGMENT, "r").agg(*(F.max(F.when(F.col("_k") == k, F.col("_lo"))).alias(f"_lo_{k}") for k in range(len(spans))))
    return members.join(places, [*SEGMENT, "r"], "left")


def select_positive_pairs(samples: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Positive pairs of an epoch: i, j, span and the ``stage`` that chose them.

    Coverage comes first (``_cover``). The budget is the smaller of all pairs and all samples with a partner; what coverage leaves of it goes
    to the widest other pairs. Their least span is found by counting; then the wider pairs are unfolded, which are fewer than the budget and the
    coverage together, and of those that are just as wide, member by member in a seeded order, as many as are missing.

    A pair in which a frame is unknown has span 0.
    """
    members = _members(samples)
    sizes = members.filter("r = 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)")), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.ceil(F.col("n") / 2)), F.lit(0)).alias("cover"),
    ).first()
    cover = checkpointed(_cover(members))
    # Coverage has half as many pairs as members, so it is never more than the budget.
    extra = min(int(sizes["pairs"]), int(sizes["rows"])) - int(sizes["cover"])
    chosen = cover if extra <= 0 else cover.unionByName(_widest_others(members, cover, extra, seed, epoch).select(*cover.columns))
    return chosen.select(*SEGMENT, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "span", "stage")


def _widest_others(members: DataFrame, cover: DataFrame, extra: int, seed: int, epoch: int) -> DataFrame:
    """``extra`` widest pairs that are not in ``cover``, those at the least span in a seeded order."""
    timed = members.filter("f is not null").select(*SEGMENT, "f", "m")
    least = span_threshold(timed, cover, extra)
    placed = checkpointed(_first_wider(members, [least, least + 1]))
    done = cover.select(*SEGMENT, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ordered = lambda pairs: pairs.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    wider = checkpointed(ordered(_unfolded(placed.filter("f is not null"), F.col("_lo_1"), F.col("m"), [])).join(done, [*SEGMENT, "a", "b"], "left_anti"))
    missing = extra - wider.count()
    # Pairs of the least span, counted by member. With span 0 they are members of one frame, and all pairs with an unknown frame.
    low = F.greatest(F.col("r") + 1, F.coalesce("_lo_0", F.col("r") + 1))
    high = F.when(F.col("f").isNull(), F.col("n")).otherwise(F.col("_lo_1"))
    level = placed.withColumns({"_start": low, "_to": high, "_more": F.when(F.col("f").isNotNull() & F.lit(least == 0), F.col("n") - F.col("m")).otherwise(0)})
    level = level.filter(F.lit(least == 0) | F.col("f").isNotNull()).withColumn("_count", F.greatest(F.col("_to") - F.col("_start"), F.lit(0)) + F.col("_more"))
    # Each member of the coverage may find one of its pairs there, in a segment of three even two: so many more are looked at.
    level = level.filter("_count > 0").withColumn("_h", hash_key(seed, epoch, "sample_idx"))
    at_level = cover.filter(F.col("span") == least).count()
    ranked = running_sums(level, ["_h", "sample_idx"], {"_before": F.col("_count").cast("long")}, (), hash_block(F.col("_h")))
    need = F.lit(missing + at_level)
    ranked = ranked.filter(F.col("_before") < need).withColumn("_take", F.least(F.col("_count"), need - F.col("_before")).cast("long"))
    plain = F.greatest(F.col("_to") - F.col("_start"), F.lit(0))
    flat = exploded_range(ranked.select(*SEGMENT, "r", "m", "_start", plain.alias("_plain"), "_take", F.col("sample_idx").alias("a"), F.col("f").alias("fa")), F.col("_take"), "_step", [*SEGMENT, "r"])
    hi = F.when(F.col("_step") < F.col("_plain"), F.col("_start") + F.col("_step")).otherwise(F.col("m") + F.col("_step") - F.col("_plain"))
    right = members.select(*SEGMENT, F.col("r").alias("hi"), F.col("sample_idx").alias("b"))
    equal = flat.withColumn("hi", hi).join(right, [*SEGMENT, "hi"]).select(*SEGMENT, "a", "b", F.lit(least).cast("long").alias("span"))
    equal = checkpointed(ordered(equal).join(done, [*SEGMENT, "a", "b"], "left_anti").withColumn("_h", hash_key(seed, epoch, "a", "b")))
    equal = with_rank(equal, ["_h", "a", "b"], hash_block(F.col("_h")), (), "_at").filter(F.col("_at") < missing).drop("_h", "_at")
    return wider.unionByName(equal).withColumn("stage", F.lit(3))


def pack_pair_batches(pairs: DataFrame, batch_size: int, shards: int, seed: int, epoch: int) -> DataFrame:
    """Consecutive pairs share a batch while their distinct members fit. Packing runs per shard of the shuffle.

    ``i_at`` and ``j_at`` are the places of both members in their batch, in the order in which its pairs bring them in (see ``batch_members``).
    """
    if batch_size < 2:
        raise ValueError("a batch must hold at least one pair")
    keyed = pairs.withColumn("_h", hash_key(seed, epoch, "i", "j", "source"))
    sharded = keyed.withColumn("shard", F.pmod(F.col("_h"), F.lit(shards)).cast("int"))
    schema = sharded.drop("_h").schema.add("batch_id", "string").add("i_at", "integer").add("j_at", "integer")
    names = [f.name for f in schema.fields]

    def pack(batches):
        shard, members, number = None, {}, -1
        for pdf in batches:
            ids, places = [], []
            for own, *pair in zip(pdf["shard"], pdf["i"], pdf["j"]):
                if own != shard or len(members.keys() | set(pair)) > batch_size:
                    number = 0 if own != shard else number + 1
                    shard, members = own, {}
                places.append([members.setdefault(x, len(members)) for x in pair])
                ids.append(f"{shard}:{number}")
            at = np.array(places, np.int32).reshape(-1, 2)
            yield pdf.assign(batch_id=pd.Series(ids, dtype="object", index=pdf.index), i_at=at[:, 0], j_at=at[:, 1])[names]

    ordered = sharded.repartition(shards, "shard").sortWithinPartitions("shard", "_h", "i", "j").drop("_h")
    return ordered.mapInPandas(pack, schema)


def batch_members(packed: DataFrame) -> DataFrame:
    """``batch_id, members``: the distinct samples of each batch, at the places that its pairs name."""
    ends = packed.select("batch_id", F.explode(F.array(F.struct(F.col("i_at").alias("at"), F.col("i").alias("s")), F.struct(F.col("j_at").alias("at"), F.col("j").alias("s")))).alias("m"))
    listed = ends.distinct().groupBy("batch_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return listed.select("batch_id", F.transform("m", lambda m: m["s"]).alias("members"))


def schedule_stats(schedule: DataFrame, samples: DataFrame) -> DataFrame:
    """Counts, repeat rates and sample coverage of a schedule."""
    n = F.count(F.lit(1))
    pos, neg = F.col("same"), ~F.col("same")
    pair = F.struct("i", "j", "source")
    distinct = lambda cond: F.count_distinct(F.when(cond, pair))
    rate = lambda cond: F.when(F.count_if(cond) > 0, 1 - distinct(cond) / F.count_if(cond)).otherwise(0.0)
    flat = schedule.agg(
        F.count_if(pos).alias("positive_pairs"), F.count_if(neg).alias("negative_pairs"),
        distinct(pos).alias("unique_positive_pairs"), distinct(neg).alias("unique_negative_pairs"),
        rate(pos).alias("positive_repeat_rate"), rate(neg).alias("negative_repeat_rate"), F.count_distinct("batch_id").alias("batches"),
    )
    rois = schedule.filter("same").select(F.explode(F.array("i", "j")).alias("s")).distinct().agg(n.alias("c")).scalar()
    total = samples.filter("has_subtitle").agg(n.alias("c")).scalar()
    return flat.withColumn("covered_rois", rois).withColumn("total_rois", total)


def negative_pairs_wanted(positive: int, ratio: float, pool: int) -> int:
    """Driver-side form of ``negative_budget``."""
    if ratio <= 0.0 or positive <= 0 or pool <= 0:
        return 0
    return pool if ratio >= 1.0 else max(0, round(positive * ratio / (1.0 - ratio)))


def local_negatives_suffice(positive: int, local: int, ratio: float | None) -> bool:
    """Whether local negatives alone meet ``ratio``. ``None`` and 1 are never met."""
    if ratio is None:
        return False
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("skip_ratio must be in [0, 1]")
    return ratio < 1.0 and local >= negative_pairs_wanted(positive, ratio, local)


def pair_epoch_schedule(
    samples: DataFrame, batch_size: int, seed: int, epoch: int, negative_ratio: float = 0.5, ocr_enabled: bool = True,
    maximum: float = 0.2, ocr_ratio: float = 0.3, shards: int = 64, skip_ratio: float | None = None,
) -> DataFrame:
    """Pairs of one epoch with their batch: i, j, same, source, shard, batch_id.

    Neither pool of negatives is listed: of the local ones, which are counted, the hardest are unfolded, of the text negatives only the pairs that the budget asks for are drawn. Text negatives have their share of the
    budget as far as there are any; local ones fill the rest, and text negatives again what is then missing. With ``skip_ratio``
    text negatives are left out when the local ones alone meet that ratio. ``shards`` is part of the plan: the same number gives
    the same batches on any cluster.
    """
    for name, value in (("negative_ratio", negative_ratio), ("maximum", maximum), ("ocr_ratio", ocr_ratio)):
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"{name} must be in [0, 1]")
    samples = prepared(samples)
    positive = checkpointed(
        select_positive_pairs(samples, seed, epoch).select("i", "j", F.lit(True).alias("same"), F.lit("local").alias("source"))
    )
    n_pos = positive.count()
    differ, members = local_groups(samples)
    differ = checkpointed(differ)
    n_local = int(differ.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])
    pool, drawn, n_ocr = None, None, 0
    if ocr_enabled and ocr_ratio > 0.0 and not local_negatives_suffice(n_pos, n_local, skip_ratio):
        # Whether there are more text negatives than their share, or than local ones leave, changes nothing: these are drawn, the pool is not counted.
        most = negative_pairs_wanted(n_pos, negative_ratio, 1)
        most = max(round(most * ocr_ratio), most - n_local)
        if negative_ratio < 1.0:
            drawn = ocr_negatives_drawn(samples, most, maximum, seed, epoch)
        if drawn is None:
            pool = ocr_negative_pool(samples, maximum)
        n_ocr = pool.total if pool else drawn[1]
    budget = negative_pairs_wanted(n_pos, negative_ratio, n_local + n_ocr)
    take_local = min(n_local, budget - min(n_ocr, round(budget * ocr_ratio)))
    take_ocr = min(n_ocr, budget - take_local)
    parts = positive
    if take_local:
        hardest = hardest_local_negatives(samples, take_local, seed, epoch, (differ, members))
        parts = parts.unionByName(hardest.select("i", "j", "same", "source"))
    if take_ocr:
        text = pool.draw(take_ocr, seed, epoch) if pool else drawn[0].select("i", "j", F.lit(False).alias("same"), F.lit("ocr").alias("source"))
        parts = parts.unionByName(text)
    return pack_pair_batches(parts, batch_size, shards, seed, epoch)
