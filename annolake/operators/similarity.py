"""Vector and token-sequence similarity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot_similarity(left: Column, right: Column) -> Column:
    product = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, v: acc + v)


@dataclass(frozen=True)
class AlignmentSettings:
    """Fixed values."""

    bandwidth: int = 3
    position_penalty: float = 0.02
    bottom_ratio: float = 0.20
    mean_weight: float = 0.60
    bottom_weight: float = 0.40
    unmatched_penalty: float = 0.10


def _band_best(left: np.ndarray, right: np.ndarray, reach: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Each token's best partner within ``reach`` places, for both sequences at once.

    A shift of the right sequence against the left one is a row-wise product, so ``2 * reach + 1`` of them see every
    pair in the band, and each product raises the best value of both of its tokens. All-zero tokens are nobody's partner.
    """
    rows, n_left, n_right = left.shape[0], left.shape[1], right.shape[1]
    best_left, best_right = np.full((rows, n_left), -np.inf), np.full((rows, n_right), -np.inf)
    live_left, live_right = left.any(axis=2), right.any(axis=2)
    for shift in range(-reach, reach + 1):
        start, stop = max(0, -shift), min(n_left, n_right - shift)
        if start >= stop:
            continue
        here, there = slice(start, stop), slice(start + shift, stop + shift)
        value = np.einsum("rtd,rtd->rt", left[:, here], right[:, there]) - penalty * abs(shift)
        np.maximum(best_left[:, here], np.where(live_right[:, there], value, -np.inf), out=best_left[:, here])
        np.maximum(best_right[:, there], np.where(live_left[:, here], value, -np.inf), out=best_right[:, there])
    best_left[~live_left] = -np.inf
    best_right[~live_right] = -np.inf
    return best_left, best_right


def _blend(best: np.ndarray, tokens: np.ndarray, s: AlignmentSettings) -> np.ndarray:
    """Mean, mean of the lowest part and share without partner, from each token's best value (minus infinity: none)."""
    has = np.isfinite(best)
    n = has.sum(axis=1)
    place = np.where(has, best, np.inf).argsort(axis=1).argsort(axis=1)
    lowest = place < np.maximum(1, np.ceil(n * s.bottom_ratio))[:, None]
    value = np.where(has, best, 0.0)
    average = lambda part: (value * part).sum(axis=1) / np.maximum(1, (has & part).sum(axis=1))
    alone = s.unmatched_penalty * (1.0 - n / np.maximum(1, tokens))
    blended = s.mean_weight * average(has) + s.bottom_weight * average(lowest) - alone
    return np.where(n > 0, blended, -1.0 - s.unmatched_penalty)


def align_batch(left: np.ndarray, right: np.ndarray, settings: AlignmentSettings = AlignmentSettings()) -> np.ndarray:
    """Mean of both directions' blended best matches, for arrays of (pairs, tokens, dims)."""
    best = _band_best(left, right, settings.bandwidth, settings.position_penalty)
    sides = (_blend(b, side.any(axis=2).sum(axis=1), settings) for b, side in zip(best, (left, right)))
    return sum(sides) / 2


def local_alignment(left: Column, right: Column, tokens: int, settings: AlignmentSettings = AlignmentSettings()) -> Column:
    """Similarity of two flat float arrays that hold ``tokens`` unit vectors each (all-zero token: invalid)."""
    if settings.bandwidth < 0 or not 0.0 < settings.bottom_ratio <= 1.0:
        raise ValueError("bandwidth below 0 or bottom_ratio outside (0, 1]")

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        if len(a) == 0:
            return pd.Series([], dtype="float64")
        shape = (len(a), tokens, -1)
        stack = lambda s: np.stack(s.to_numpy()).astype("float64").reshape(shape)
        return pd.Series(align_batch(stack(a), stack(b), settings))

    return score(left, right)


def unit_tokens(vector: Column, tokens: int, dims: int) -> Column:
    """Cut a vector into ``tokens`` pieces and scale each to unit length; the result stays flat."""

    def piece(at: Column) -> Column:
        part = F.transform(F.slice(vector, at * dims + 1, dims), lambda v: v.cast("double"))
        norm = F.sqrt(F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v * v))
        return F.transform(part, lambda v: F.when(norm > 0, v / norm).otherwise(0.0))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), piece))


def pair_scores(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Score (left_id, right_id, same, source) with the vectors of both sides."""
    side = lambda p: vectors.select(F.col("vec_id").alias(f"{p}_id"), F.col("embedding").alias(f"{p}_vector"))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    scored = both.withColumn("score", dot_similarity(F.col("left_vector"), F.col("right_vector")))
    predicted = F.col("score") >= threshold
    return scored.drop("left_vector", "right_vector").withColumn("prediction", predicted).withColumn(
        "correct", predicted == F.col("same")
    )
