"""Plugging a user's batch scorer into a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score_batches(df: DataFrame, predict: Callable[[pd.DataFrame], np.ndarray], inputs: list[str], threshold: float = 0.5) -> DataFrame:
    """Add logit, score and prediction. ``predict`` maps a frame of ``inputs`` to logits, one Arrow batch at a time."""
    schema = T.StructType([*df.schema.fields, T.StructField("logit", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(logit=np.asarray(predict(batch[inputs]), dtype="float64"))

    scored = df.mapInPandas(run, schema)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit")))
    return scored.withColumn("score", score).withColumn("prediction", F.col("score") >= threshold)
