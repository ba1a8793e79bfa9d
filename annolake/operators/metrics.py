"""Evaluation metrics.

Everything ranked (AUC, percentiles, tails, threshold sweep) comes from one histogram: rows are first counted per
distinct score, then running counts are laid over it block by block. No task ever sorts one whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.functions.text import is_short_positive
from annolake.operators.ordered import running_sums, value_block


def ratio(top: Column, bottom: Column) -> Column:
    """0 for an empty denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2.0) * precision * recall, precision + recall)


def score_histogram(scores: DataFrame, by: list[str] = [], score: str = "score", target: str = "target") -> DataFrame:
    """Counts per distinct score with the running counts before it and the totals of the group."""
    counted = scores.groupBy(*by, F.col(score).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(target).alias("p")
    ).withColumn("q", F.col("n") - F.col("p"))
    blocked = value_block(counted, "value")
    sums = {"n_before": F.col("n"), "p_before": F.col("p"), "q_before": F.col("q")}
    return running_sums(blocked, ["value"], sums, by, None, totals=True).withColumnsRenamed(
        {"n_before_total": "n_all", "p_before_total": "p_all", "q_before_total": "q_all"}
    )


def _pick(which: str, quantile: float) -> tuple[Column, Column, Column]:
    """Lower neighbour, upper neighbour and weight of a linear percentile over the p or q side."""
    before, here, total = F.col(f"{which}_before"), F.col(which), F.col(f"{which}_all")
    position = (total - 1) * F.lit(quantile)
    low = F.floor(position)
    high = F.least(low + 1, total - 1)
    holds = lambda at: (here > 0) & (before <= at) & (at < before + here)
    value = lambda at: F.max(F.when(holds(at), F.col("value")))
    return value(low), value(high), F.max(position - low)


def percentile(which: str, quantile: float) -> Column:
    low, high, weight = _pick(which, quantile)
    return F.coalesce(low * (1.0 - weight) + high * weight, F.lit(0.0))


def nearest_rank(which: str, quantile: float) -> Column:
    before, here, total = F.col(f"{which}_before"), F.col(which), F.col(f"{which}_all")
    at = F.rint((total - 1) * F.lit(quantile))
    return F.coalesce(F.max(F.when((here > 0) & (before <= at) & (at < before + here), F.col("value"))), F.lit(0.0))


def tail_mean(which: str, fraction: float, largest: bool) -> Column:
    """Mean of the extreme ceil(count * fraction) values, at least one."""
    before, here, total = F.col(f"{which}_before"), F.col(which), F.col(f"{which}_all")
    size = F.greatest(F.lit(1), F.ceil(total * F.lit(fraction)))
    outside = total - before - here if largest else before
    taken = F.greatest(F.lit(0), F.least(here, size - outside))
    return F.coalesce(ratio(F.sum(F.when(here > 0, F.col("value") * taken)), F.max(size)), F.lit(0.0))


def roc_auc() -> Column:
    """Mann-Whitney with average ranks on ties; a single class scores 0."""
    ranks = F.sum(F.col("p") * (F.col("n_before") + (F.col("n") + 1) / 2))
    p, q = F.max("p_all").cast("double"), F.max("q_all").cast("double")
    return F.coalesce(ratio(ranks - p * (p + 1) / 2, p * q), F.lit(0.0))


def best_f1() -> Column:
    """struct(f1, value): best F1 over the distinct scores; the highest threshold wins ties."""
    tp = F.col("p_all") - F.col("p_before")
    predicted = F.col("n_all") - F.col("n_before")
    f1 = f1_of(ratio(tp, predicted), ratio(tp, F.col("p_all")))
    best = F.max(F.struct(f1.alias("f1"), F.col("value")))
    top = F.max("value") + F.lit(1e-6)
    nothing = F.struct(F.lit(0.0).alias("f1"), F.coalesce(top, F.lit(0.0)).alias("value"))
    return F.when(best["f1"] > 0, best).otherwise(nothing)


def _side_sum(which: str, value: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.col(which) * (F.col("value") if value is None else value)), F.lit(0.0))


def confusion(threshold: float) -> dict[str, Column]:
    """Raw counts on a histogram."""
    hit = F.col("value") >= threshold
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("double")
    return {"tp": total("p", hit), "fp": total("q", hit), "fn": total("p", ~hit), "tn": total("q", ~hit)}


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall,
        "f1": f1_of(precision, recall), "tp": tp, "fp": fp, "fn": fn, "tn": tn,
    }


def confusion_metrics(scores: DataFrame, by: list[str] = [], threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """Counts and rates in one map-side combined pass."""
    hit = F.col("score") >= threshold
    count = lambda cond: F.count_if(cond).cast("double")
    out = rates(
        count(hit & F.col("target")), count(hit & ~F.col("target")),
        count(~hit & F.col("target")), count(~hit & ~F.col("target")),
    )
    return scores.groupBy(*by).agg(*(c.alias(prefix + k) for k, c in out.items()))


def frame_gap_metrics(scores: DataFrame, by: list[str] = [], threshold: float = 0.5) -> DataFrame:
    """Confusion metrics plus extremes; here an absent class counts as 0 inside the gap."""
    base = confusion_metrics(scores, by, threshold)
    low = F.coalesce(F.min(F.when(F.col("target"), F.col("score"))), F.lit(0.0))
    high = F.coalesce(F.max(F.when(~F.col("target"), F.col("score"))), F.lit(0.0))
    ends = scores.groupBy(*by).agg(low.alias("min_positive"), high.alias("max_negative"), (low - high).alias("gap"))
    return base.join(ends, by) if by else _side_by_side(base, ends)


def _side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames as one row."""
    key = "_one"
    parts = [f.withColumn(key, F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(b, key), parts).drop(key)


def score_gap() -> tuple[Column, Column, Column]:
    low = F.min(F.when(F.col("p") > 0, F.col("value")))
    high = F.max(F.when(F.col("q") > 0, F.col("value")))
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(0.0)), F.coalesce(low - high, F.lit(0.0))


def brier() -> Column:
    value = F.col("value")
    squares = F.col("p") * (value - 1) * (value - 1) + F.col("q") * value * value
    return ratio(F.sum(squares), F.sum("n"))


def nll() -> Column:
    v = F.least(F.greatest(F.col("value"), F.lit(1e-7)), F.lit(1.0 - 1e-7))
    return ratio(-F.sum(F.col("p") * F.log(v) + F.col("q") * F.log(1.0 - v)), F.sum("n"))


def calibration_error(histogram: DataFrame, by: list[str] = [], bins: int = 10) -> DataFrame:
    """Expected calibration error; the last bin is closed."""
    value = F.col("value")
    inside = histogram.filter((value >= 0) & (value <= 1))
    edges = reduce(Column.__add__, [(value >= i / bins).cast("int") for i in range(1, bins)])
    per_bin = inside.groupBy(*by, edges.alias("bin")).agg(
        F.sum("n").alias("bn"), F.sum("p").alias("bp"), F.sum(value * F.col("n")).alias("bs"), F.max("n_all").alias("all")
    )
    part = F.col("bn") / F.col("all") * F.abs(F.col("bs") / F.col("bn") - F.col("bp") / F.col("bn"))
    return per_bin.groupBy(*by).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("ece"))


def presence_metrics(scores: DataFrame, by: list[str] = [], threshold: float = 0.5) -> DataFrame:
    """The full binary report per group (columns score, target)."""
    h = score_histogram(scores, by)
    low, high, gap = score_gap()
    best = best_f1()
    out = rates(**confusion(threshold))
    p05, n95 = percentile("p", 0.05), percentile("q", 0.95)
    p_tail, n_tail = tail_mean("p", 0.01, False), tail_mean("q", 0.01, True)
    out |= {
        "positive_score": ratio(_side_sum("p"), F.sum("p")), "negative_score": ratio(_side_sum("q"), F.sum("q")),
        "roc_auc": roc_auc(), "positive_p05": p05, "positive_p10": percentile("p", 0.10),
        "positive_p50": percentile("p", 0.50), "negative_p90": percentile("q", 0.90), "negative_p95": n95,
        "negative_p99": percentile("q", 0.99), "min_positive_score": low, "max_negative_score": high, "gap": gap,
        "robust_gap": p05 - n95, "positive_lower_tail_mean_1pct": p_tail, "negative_upper_tail_mean_1pct": n_tail,
        "tail_gap_1pct": p_tail - n_tail, "best_f1_threshold": best["value"], "best_f1": best["f1"],
        "zero_error_threshold_exists": (gap > 0).cast("double"), "brier": brier(), "nll": nll(),
    }
    report = h.groupBy(*by).agg(*(F.coalesce(c, F.lit(0.0)).alias(k) for k, c in out.items()))
    ece = calibration_error(h, by)
    joined = report.join(ece, by) if by else _side_by_side(report, ece)
    return joined.withColumn("decision_threshold", F.lit(threshold))


def similarity_metrics(pairs: DataFrame, threshold: float, by: list[str] = []) -> DataFrame:
    """Pair report over (score, same): accuracy, means, AUC, percentiles, gap and best threshold."""
    h = score_histogram(pairs, by, target="same")
    c = confusion(threshold)
    low, high, gap = score_gap()
    best = best_f1()
    out = {
        "accuracy": ratio(c["tp"] + c["tn"], F.sum("n")), "pairs": F.coalesce(F.sum("n"), F.lit(0)).cast("double"),
        "same_score": ratio(_side_sum("p"), F.sum("p")), "diff_score": ratio(_side_sum("q"), F.sum("q")),
        "roc_auc": roc_auc(), "positive_p05": percentile("p", 0.05), "positive_p10": percentile("p", 0.10),
        "positive_p25": percentile("p", 0.25), "positive_p50": percentile("p", 0.50),
        "negative_p90": percentile("q", 0.90), "negative_p95": percentile("q", 0.95),
        "negative_p99": percentile("q", 0.99), "false_positive": c["fp"], "false_negative": c["fn"],
        "min_positive": low, "max_negative": high, "gap": gap, "best_f1_threshold": best["value"], "best_f1": best["f1"],
        "zero_error_threshold_exists": (gap > 0).cast("double"),
    }
    return h.groupBy(*by).agg(*(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in out.items()))


def pair_source_counts(pairs: DataFrame) -> DataFrame:
    local, ocr = F.col("source") == "local", F.col("source") == "ocr"
    return pairs.agg(
        F.count_if(local & F.col("same")).cast("double").alias("local_positive"),
        F.count_if(local & ~F.col("same")).cast("double").alias("local_negative"),
        F.count_if(ocr & ~F.col("same")).cast("double").alias("ocr_negative"),
    )


def pair_metrics(pairs: DataFrame, threshold: float, skipped: int | Column = 0) -> DataFrame:
    """``similarity_metrics`` with the source counts of the selection."""
    skipped = skipped if isinstance(skipped, Column) else F.lit(skipped)
    both = _side_by_side(similarity_metrics(pairs, threshold), pair_source_counts(pairs))
    return both.withColumn("skipped", skipped.cast("double"))


def negative_source_accuracy(pairs: DataFrame, threshold: float) -> DataFrame:
    below = (F.col("score") < threshold).cast("double")
    share = lambda s: F.coalesce(F.avg(F.when(~F.col("same") & (F.col("source") == s), below)), F.lit(0.0))
    return pairs.agg(share("local").alias("local_negative_accuracy"), share("ocr").alias("ocr_negative_accuracy"))


def hard_negative_metrics(pairs: DataFrame, threshold: float) -> DataFrame:
    """Hard negatives are local ones; normal pairs have no short side (column ``short``)."""
    right = ((F.col("score") >= threshold) == F.col("same")).cast("double")
    hard = ~F.col("same") & (F.col("source") == "local")
    share = lambda cond: F.coalesce(F.avg(F.when(cond, right)), F.lit(0.0))
    flat = pairs.agg(
        share(~F.col("short")).alias("normal_accuracy"), share(hard).alias("hard_negative_accuracy"),
        F.coalesce(F.avg(F.when(hard, F.col("score"))), F.lit(0.0)).alias("hard_negative_sim"),
        F.count_if(hard).cast("double").alias("hard_negative_pairs"),
    )
    h = score_histogram(pairs.filter(F.col("same") | hard), target="same")
    both = F.coalesce((F.max("p_all") > 0) & (F.max("q_all") > 0), F.lit(False))
    same_p10, hard_p90 = percentile("p", 0.10), percentile("q", 0.90)
    ranked = h.agg(
        percentile("q", 0.50).alias("hard_negative_sim_p50"), hard_p90.alias("hard_negative_sim_p90"),
        percentile("q", 0.95).alias("hard_negative_sim_p95"), percentile("p", 0.50).alias("same_sim_p50"),
        same_p10.alias("same_sim_p10"), F.when(both, same_p10 - hard_p90).otherwise(0.0).alias("hard_margin"),
    )
    return _side_by_side(flat, ranked)


def scoped(scores: DataFrame) -> DataFrame:
    """Repeat each row for its scopes: global, normal (no short positives), short (no long positives)."""
    short = is_short_positive(F.col("target"), F.col("norm_text"))
    scopes = F.when(~F.col("target"), F.array(F.lit("global"), F.lit("normal"), F.lit("short"))).when(
        short, F.array(F.lit("global"), F.lit("short"))
    ).otherwise(F.array(F.lit("global"), F.lit("normal")))
    return scores.withColumn("scope", F.explode(scopes))


def scoped_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """F1 and accuracy per scope; an empty scope scores 0."""
    names = scores.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("global", "normal", "short")))).alias("scope"))
    found = confusion_metrics(scoped(scores), ["scope"], threshold).select("scope", "f1", "accuracy")
    return names.join(found, "scope", "left").fillna(0.0, ["f1", "accuracy"])


def segment_scores(scores: DataFrame) -> DataFrame:
    """One row per (root, segment): positive if any sample is; the worst score of its side."""
    any_positive = F.max("target")
    worst = F.when(any_positive, F.min("score")).otherwise(F.max("score"))
    return scores.groupBy("root", "segment_id").agg(worst.alias("score"), any_positive.alias("target"))


def segment_presence_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    names = ["f1", "recall", "accuracy", "positive_lower_tail_mean_1pct", "tail_gap_1pct"]
    segments = segment_scores(scores)
    full = presence_metrics(segments, [], threshold).select(*names)
    return _side_by_side(full, segments.agg(F.count(F.lit(1)).cast("double").alias("segment_count")))


def text_distractor_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Negatives that show text: count, false-positive rate, 95th percentile, and whether there were any."""
    only = scores.filter(~F.col("target") & F.col("has_candidate"))
    h = score_histogram(only)
    c = confusion(threshold)
    count = F.coalesce(F.sum("n"), F.lit(0)).cast("double")
    return h.agg(
        count.alias("text_distractor_count"), ratio(c["fp"], count).alias("text_distractor_fpr"),
        percentile("q", 0.95).alias("text_distractor_score_p95"),
        (count > 0).cast("double").alias("subtitle_specificity_evaluable"),
    )


def bce_from_logits(logit: Column, target: Column) -> Column:
    """Numerically stable binary cross entropy of one row."""
    return F.greatest(logit, F.lit(0.0)) - logit * target.cast("double") + F.log1p(F.exp(-F.abs(logit)))


def loss_summary(rows: DataFrame, logit: str, target: str, weight: str | None = None) -> DataFrame:
    loss = bce_from_logits(F.col(logit), F.col(target))
    weighted = loss if weight is None else loss * F.coalesce(F.col(weight), F.lit(1.0))
    total, count = F.coalesce(F.sum(loss), F.lit(0.0)), F.count(F.lit(1))
    return rows.agg(
        total.alias("bce_sum"), (total / F.greatest(F.lit(1), count)).alias("bce_mean"),
        (F.coalesce(F.sum(weighted), F.lit(0.0)) / F.greatest(F.lit(1), count)).alias("weighted_bce_mean"),
    )


def score_drift(current: DataFrame, previous: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Change of each sample's score against an earlier run (root, sample_id, score)."""
    before = previous.select("root", "sample_id", F.col("score").alias("previous_score"))
    delta = F.col("score") - F.col("previous_score")
    joined = current.join(before, ["root", "sample_id"], "left").withColumn("score_delta", delta)
    adverse = F.when(F.col("target"), -F.col("score_delta")).otherwise(F.col("score_delta"))
    return (
        joined.withColumn("score_drift", F.abs("score_delta"))
        .withColumn("adverse_drift", F.when(F.col("score_delta").isNotNull(), F.greatest(F.lit(0.0), adverse)))
        .withColumn("flipped", (F.col("score") >= threshold) != (F.col("previous_score") >= threshold))
    )


def drift_metrics(drift: DataFrame) -> DataFrame:
    """Summary of ``score_drift`` rows that carry ``short`` too."""
    seen = drift.filter("score_delta is not null")
    flat = seen.agg(
        F.coalesce(F.max("score_drift"), F.lit(0.0)).alias("drift_max"), F.count(F.lit(1)).cast("double").alias("drift_evaluable_count"),
        F.count_if("flipped").cast("double").alias("threshold_flip_count"),
        F.count_if(F.col("flipped") & F.col("short")).cast("double").alias("short_threshold_flip_count"),
    )
    kinds = {
        "drift_upper_tail_mean_1pct": (F.lit(True), "score_drift"),
        "adverse_drift_upper_tail_mean_1pct": (F.lit(True), "adverse_drift"),
        "positive_drop_upper_tail_mean_1pct": (F.col("target"), "adverse_drift"),
        "negative_rise_upper_tail_mean_1pct": (~F.col("target"), "adverse_drift"),
        "short_drift_upper_tail_mean_1pct": (F.col("short"), "score_drift"),
    }
    tagged = F.array(*(F.when(cond, F.struct(F.lit(k).alias("kind"), F.col(v).alias("score"))) for k, (cond, v) in kinds.items()))
    long = seen.select(F.explode(F.filter(tagged, lambda s: s.isNotNull())).alias("s")).select("s.kind", "s.score", F.lit(True).alias("target"))
    tails = score_histogram(long, ["kind"]).groupBy("kind").agg(tail_mean("p", 0.01, True).alias("v"))
    wide = tails.agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("v"))), F.lit(0.0)).alias(k) for k in kinds))
    return _side_by_side(flat, wide)


def counterfactual_metrics(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scores of erased, transplanted and seam variants (null: not evaluated)."""
    erased, moved, seam = F.col("erased_score"), F.col("transplanted_score"), F.col("seam_score")
    rows = rows.filter(erased.isNotNull())
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    share = lambda c, cond: F.coalesce(F.avg(F.when(c.isNotNull(), cond.cast("double"))), F.lit(0.0))
    flat = rows.agg(
        F.count(F.lit(1)).cast("double").alias("evaluable_count"), mean(erased).alias("erased_score"),
        share(erased, erased < threshold).alias("erased_flip_rate"), mean(F.col("score") - erased).alias("score_drop"),
        share(moved, moved >= threshold).alias("transplanted_recall"),
        mean(F.abs(F.col("score") - moved)).alias("transplanted_abs_delta"),
        share(seam, seam >= threshold).alias("seam_control_fpr"),
    )
    drops = rows.select((F.col("score") - erased).alias("score"), F.lit(True).alias("target"))
    tail = score_histogram(drops).agg(tail_mean("p", 0.01, False).alias("score_drop_lower_tail_1pct"))
    return _side_by_side(flat, tail)


def acceptance_gates(metrics: DataFrame, complete: bool) -> DataFrame:
    """One boolean per acceptance rule on a ``frame_gap_metrics`` row."""
    return metrics.select(
        F.lit(complete).alias("validation_complete"), (F.col("recall") == 1).alias("recall"), (F.col("f1") == 1).alias("f1"),
        (F.col("fp") == 0).alias("no_false_positive"), (F.col("fn") == 0).alias("no_false_negative"),
        (F.col("gap") >= 0.8).alias("gap"),
    )


def metrics_by_domain(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts overall and per sample type in one grouping-sets pass."""
    hit = F.col("score") >= threshold
    count = lambda cond: F.count_if(cond).cast("double")
    out = rates(
        count(hit & F.col("target")), count(hit & ~F.col("target")),
        count(~hit & F.col("target")), count(~hit & ~F.col("target")),
    )
    return scores.rollup("sample_type").agg(*(c.alias(k) for k, c in out.items())).fillna({"sample_type": "all"})


# Rankings: ascending structs, the best run is the maximum; the earliest epoch wins ties.

def _or(columns: list[str], name: str, *fallbacks: str) -> Column:
    known = [F.col(n) for n in (name, *fallbacks) if n in columns]
    return F.coalesce(*known, F.lit(0.0)) if known else F.lit(0.0)


def presence_rank(columns: list[str]) -> list[Column]:
    g = lambda n, *f: _or(columns, n, *f)
    f1 = [g("global_presence_f1"), g("normal_presence_f1"), g("short_presence_f1"), g("segment_presence_f1", "global_presence_f1")]
    hard = F.when(g("subtitle_specificity_evaluable") != 0, 1.0 - g("text_distractor_fpr")).otherwise(0.0)
    brier_score = F.col("presence_brier") if "presence_brier" in columns else F.lit(1.0)
    return [
        F.least(*f1), reduce(Column.__add__, f1) / 4, hard, g("region_pointing_accuracy"),
        g("counterfactual_score_drop_lower_tail_1pct"), g("presence_tail_gap_1pct"), -brier_score,
    ]


def frame_rank(columns: list[str]) -> list[Column]:
    c = lambda n: F.col(f"presence_{n}")
    return [
        ((c("f1") == 1) & (c("recall") == 1)).cast("double"), (c("gap") >= 0.8).cast("double"),
        F.bround(c("f1"), 8), F.bround(c("recall"), 8), F.bround(c("gap"), 8), -c("fp"), -c("fn"),
    ]


def matcher_rank(columns: list[str]) -> list[Column]:
    gap, fp, fn = F.col("pair_gap"), F.col("pair_false_positive_count").cast("long"), F.col("pair_false_negative_count").cast("long")
    return [-(fp + fn), -fp, F.when(gap > 0, 0).otherwise(-1), gap]


def embedding_rank(columns: list[str], phase: str = "joint") -> list[Column]:
    g = lambda n, *f: _or(columns, n, *f)
    if phase == "embedding":
        return [-g("embedding_false_positive_pairs"), -g("embedding_false_negative_pairs"), g("embedding_gap")]
    presence = (
        g("global_presence_f1", "presence_f1") + g("normal_presence_f1", "global_presence_f1", "presence_f1")
        + g("short_presence_f1", "global_presence_f1", "presence_f1")
    ) / 3.0
    if phase == "presence":
        return [presence]
    embedding = (
        g("global_embedding_acc", "embedding_pair_accuracy")
        + g("normal_embedding_acc", "global_embedding_acc", "embedding_pair_accuracy")
        + g("style_hard_negative_embedding_acc", "global_embedding_acc", "embedding_pair_accuracy")
    ) / 3.0
    return [0.5 * presence + 0.5 * embedding]


def best_run(runs: DataFrame, rank: list[Column], by: str = "run", epoch: str = "epoch") -> DataFrame:
    """Best epoch of each run."""
    key = F.struct(*(c.alias(f"r{i}") for i, c in enumerate(rank)), (-F.col(epoch)).alias("first"))
    return runs.groupBy(by).agg(F.max_by(F.struct(*[c for c in runs.columns if c != by]), key).alias("best")).select(by, "best.*")


def detection_metrics(counts: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 over per-image counts."""
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return total.select("*", precision.alias("precision"), recall.alias("recall"), f1_of(precision, recall).alias("f1"))
