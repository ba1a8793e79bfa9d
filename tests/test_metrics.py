import math
import random

from pyspark.sql import functions as F

from annolake.operators import metrics as m


def scores(spark, values, targets, **extra):
    rows = [(float(v), bool(t)) for v, t in zip(values, targets)]
    return spark.createDataFrame(rows, "score double, target boolean")


def test_four_scores(spark):
    r = m.presence_metrics(scores(spark, (0.95, 0.65, 0.25, 0.2), (1, 1, 0, 0))).first()
    assert abs(r.gap - 0.4) < 1e-12 and r.roc_auc == 1 and r.best_f1 == 1 and r.zero_error_threshold_exists == 1
    assert (r.min_positive_score, r.max_negative_score, r.best_f1_threshold) == (0.65, 0.25, 0.65)


def test_fixed_threshold_misses(spark):
    r = m.presence_metrics(scores(spark, (0.45, 0.41, 0.3, 0.05), (1, 1, 0, 0))).first()
    assert r.roc_auc == 1 and r.fn == 2 and r.positive_lower_tail_mean_1pct < 0.5


def test_empty_and_single_class(spark):
    r = m.presence_metrics(scores(spark, (), ())).first()
    assert r is None or all(v == 0 for k, v in r.asDict().items() if k != "decision_threshold")
    r = m.presence_metrics(scores(spark, (0.2, 0.6), (0, 0))).first()
    assert (r.roc_auc, r.best_f1, r.gap, r.recall) == (0, 0, 0, 0) and abs(r.best_f1_threshold - 0.600001) < 1e-12
    assert m.confusion_metrics(scores(spark, (), ())).first().accuracy == 0


def test_distractors(spark):
    df = spark.createDataFrame([(0.9, True, True), (0.8, False, True), (0.1, False, False)], "score double, target boolean, has_candidate boolean")
    r = m.text_distractor_metrics(df).first()
    assert (r.text_distractor_count, r.text_distractor_fpr, r.subtitle_specificity_evaluable) == (1, 1, 1)
    r = m.text_distractor_metrics(df.filter("score > 0.85")).first()
    assert tuple(r) == (0, 0, 0, 0)


def test_report_against_definitions(spark):
    random.seed(9)
    values = [round(random.random(), 2) for _ in range(500)] + [0.5] * 200
    targets = [random.random() < v * 0.8 + 0.1 for v in values]
    r = m.presence_metrics(scores(spark, values, targets)).first()
    pos, neg = sorted(v for v, t in zip(values, targets) if t), sorted(v for v, t in zip(values, targets) if not t)
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert abs(r.roc_auc - wins) < 1e-9
    def at(sorted_values, q):
        k = (len(sorted_values) - 1) * q
        low = math.floor(k)
        return sorted_values[low] + (sorted_values[min(low + 1, len(sorted_values) - 1)] - sorted_values[low]) * (k - low)
    assert abs(r.positive_p10 - at(pos, 0.1)) < 1e-9 and abs(r.negative_p95 - at(neg, 0.95)) < 1e-9
    k = math.ceil(len(neg) * 0.01)
    assert abs(r.negative_upper_tail_mean_1pct - sum(neg[-k:]) / k) < 1e-9
    best = max((2 * sum(t for v, t in zip(values, targets) if v >= c) / (sum(v >= c for v in values) + len(pos)), c) for c in set(values))
    assert abs(r.best_f1 - best[0]) < 1e-9 and r.best_f1_threshold == best[1]


def test_rankings(spark):
    rows = [("a", 1, 0.0, 0.0, 0.1), ("a", 2, 0.0, 0.0, 0.3), ("a", 3, 1.0, 0.0, 0.9), ("a", 4, 0.0, 0.0, 0.3)]
    runs = spark.createDataFrame(rows, "run string, epoch int, pair_false_positive_count double, pair_false_negative_count double, pair_gap double")
    assert m.best_run(runs, m.matcher_rank(runs.columns)).first().epoch == 2
    runs = spark.createDataFrame([("a", 1, 0.9, 0.2), ("a", 2, 0.8, 0.9)], "run string, epoch int, presence_f1 double, embedding_pair_accuracy double")
    assert m.best_run(runs, m.embedding_rank(runs.columns)).first().epoch == 2
    assert m.best_run(runs, m.embedding_rank(runs.columns, "presence")).first().epoch == 1
    assert m.best_run(runs, m.embedding_rank(runs.columns, "embedding")).first().epoch == 1


def test_gates_and_gap_of_absent_class(spark):
    r = m.frame_gap_metrics(scores(spark, (0.9, 0.95), (1, 1))).first()
    assert r.gap == 0.9
    gates = m.acceptance_gates(m.frame_gap_metrics(scores(spark, (0.9, 0.05), (1, 0))), True).first()
    assert all(gates)


def test_pair_report_of_nothing(spark):
    empty = spark.createDataFrame([], "score double, same boolean, source string")
    r = m.pair_metrics(empty, 0.5, 7).first().asDict()
    assert r.pop("skipped") == 7 and all(v == 0 for v in r.values())
