"""Quality by importance resampling: two hashed n-gram models and Gumbel keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import row_key
from annolake.llm.labelled import SAMPLE_ROWS, sample
from annolake.llm.words import Words, mix64, slices

#: Hash buckets of word unigrams and bigrams together, and the count that every bucket starts from.
BUCKET_BITS, SMOOTHING = 16, 1.0
BUCKETS = 1 << BUCKET_BITS
#: Losing a good document counts as much as keeping so many bad ones (as shares of their kind).
GOOD_WEIGHT = 5.0
FOLDS = 3
#: Longer texts weigh as if they had so many n-grams; otherwise the model's small errors add up over long texts.
LENGTH = 64


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words and neighbouring words of the texts, and the text of each. Case counts."""
    spans = Words(texts, fold_case=False)
    single = spans.hashes()
    owner = np.repeat(np.arange(len(texts)), spans.last - spans.first)
    double = mix64(single[:-1] * np.uint64(3) + single[1:] * np.uint64(5)) if len(single) else single
    inside = owner[:-1] == owner[1:]
    both = np.concatenate((single, double[inside]))
    return (both >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate((owner, owner[:-1][inside]))


def fit(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """Log ratio of target and raw probability of each bucket.

    The raw model counts all documents. ``target`` holds ids (``_id``) of a bounded sample of good documents; those are
    counted apart. Each task adds up its own counts; what reaches the driver are two numbers per bucket.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).where("_text is not null")
    marked = rows.join(F.broadcast(target.select("_id", F.lit(1).alias("_good"))), "_id", "left").select("_text", "_good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                buckets, owner = grams(texts)
                raw += np.bincount(buckets, minlength=BUCKETS)
                chosen = np.asarray(part.column("_good").fill_null(0)) == 1
                good += np.bincount(buckets[chosen[owner]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    counts = marked.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    model = np.full((2, BUCKETS), SMOOTHING)
    for side, name in enumerate(("raw", "good")):
        model[side, counts["bucket"].to_numpy()] += counts[name].to_numpy()
    model = np.log(model / model.sum(axis=1, keepdims=True))
    return (model[1] - model[0]).astype(np.float32)


def gumbel(id_column: str) -> Column:
    """A fixed draw from the standard Gumbel distribution for each id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_column), F.lit("gumbel")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def weigh(docs: DataFrame, ratios: np.ndarray, id_column: str = "doc_id", text_column: str = "text", rows_told: bool = False) -> DataFrame:
    """Per row: id, ``_row`` (``row_key``, if ``rows_told``), ``n_grams``, ``log_weight`` (sum of log ratios) and ``key`` (tempered by length, with Gumbel noise)."""
    kind, told = dict(docs.dtypes)[id_column], ["_id", *["_row"] * rows_told]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                buckets, owner = grams(texts)
                weight = np.bincount(owner, ratios[buckets], len(texts))
                number = np.bincount(owner, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in told), pa.array(number, pa.int64()), pa.array(weight, pa.float64())], names=[*told, "n_grams", "log_weight"])

    rows = docs.select(F.col(id_column).alias("_id"), *[row_key(text_column).alias("_row")] * rows_told, F.col(text_column).alias("_text"))
    found = rows.mapInArrow(run, f"_id {kind}, {'_row long, ' * rows_told}n_grams long, log_weight double")
    tempered = F.col("log_weight") * F.least(F.lit(1.0), F.lit(float(LENGTH)) / F.greatest("n_grams", F.lit(1)))
    return found.withColumn("key", tempered + gumbel("_id")).withColumnRenamed("_id", id_column)


def best_cut(keys: np.ndarray, good: np.ndarray) -> float:
    """The key above which good and bad labelled documents are told apart best: ``GOOD_WEIGHT`` times the share of good ones kept
    minus the share of bad ones kept.

    Of equal cuts the lowest counts. It lies midway to the next lower bad key, so that good documents just below those seen stay.
    """
    if good.all() or not good.any():
        return -np.inf
    order = np.lexsort((good, -keys))
    keys, good = keys[order], good[order]
    gain = np.cumsum(np.where(good, GOOD_WEIGHT / good.sum(), -1 / (~good).sum()))
    gain[:-1][keys[:-1] == keys[1:]] = -np.inf
    at = len(gain) - 1 - int(np.argmax(gain[::-1]))
    return float((keys[at] + keys[at + 1]) / 2) if at + 1 < len(keys) else -np.inf


def resample(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text_column: str = "text", rows: int = SAMPLE_ROWS, rows_told: bool = False
) -> DataFrame:
    """Per row: id, ``_row`` (``row_key``, if ``rows_told``), ``n_grams``, ``log_weight``, ``key`` and ``kept``.

    The weight of a document is the ratio of its probability under the n-gram model of good labelled documents to that
    under the model of all documents. Adding Gumbel noise to log weights and taking the k highest keys samples k documents
    without replacement in proportion to the weights. Here k is the number of documents whose key reaches the cut that
    tells good from bad labelled documents best, so the selection is a comparison and no sort. One labelled document in
    ``FOLDS`` finds the cut and is not in the model, so that its weight is like that of a document without a label.

    ``rows`` bounds the labelled sample. Texts without words weigh 1 (log weight 0). Null and empty texts are such; repeated rows get the same
    key; without labels of both kinds all documents are kept; other columns are ignored; an empty table gives an empty result.
    """
    picked = sample(labels, label, F.lit(True), id_column, rows)
    judges = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)) == 0
    ratios = fit(docs, picked.where(~judges & (F.col("_label") == 1)), id_column, text_column)
    judging = F.broadcast(picked.where(judges).withColumnRenamed("_id", id_column))
    judged = weigh(docs.join(judging, id_column, "left_semi"), ratios, id_column, text_column).join(judging, id_column)
    judged = judged.where("n_grams > 0").select("key", "_label").toPandas()
    cut = best_cut(judged["key"].to_numpy(np.float64), judged["_label"].to_numpy() == 1)
    return weigh(docs, ratios, id_column, text_column, rows_told).withColumn("kept", F.col("key") >= F.lit(cut))
