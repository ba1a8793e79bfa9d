"""Exact top-k inner products by aggregation of sorted lists without random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Candidates and queries in one unit of work, and how deep each round reads the lists of a block (shares of its rows).
BLOCK_ROWS, QUERY_ROWS = 8192, 2048
DEPTHS = (1 / 32, 1 / 8, 1 / 3)


def _number_type(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which all inner products of the rows are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most >= 2**63:
        raise ValueError("inner products of these vectors do not fit into 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def search_block(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best rows of one block for each query: ``query_id, vec_id, score``.

    Each dimension is a list of the block's rows sorted by value. It is read from the high end for queries whose component
    is positive and from the low end for the others. A row that a list has not shown yet is bounded there by the list's
    last value read (from above) and its final value (from below). Lists are read to growing depths; rows whose upper bound
    is under the k-th best lower bound drop out, and once few are left, or the lists are read through, the
    final scores of those that remain are resolved. Ties go to smaller ids; rows with the query's id are its own and never count.
    """
    kind = _number_type(values, queries)
    x, q = values.astype(kind), queries.astype(kind)
    n = len(ids)
    ordered = np.sort(x, axis=0)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    own = query_ids[:, None] == ids[None, :]
    alive = ~own
    for depth in DEPTHS:
        read = max(1, int(n * depth))
        if read * 2 >= n:
            break
        high, low = ordered[n - read], ordered[read - 1]
        # A read value is itself in both bounds; an unread one is at most `high` (at least `low`) and within the list.
        upper = up @ np.maximum(np.where(x >= high, x, high), high).T + down @ np.minimum(x, low).T
        lower = up @ np.where(x >= high, x, ordered[0]).T + down @ np.where(x <= low, x, ordered[-1]).T
        lower[own] = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        if n > k:
            bar = np.partition(lower, n - k, axis=1)[:, n - k]
            alive &= upper >= bar[:, None]
        if alive.sum() <= 4 * k * len(q):
            break
    found = []
    for at in range(len(q)):
        rows = np.flatnonzero(alive[at])
        score = (x[rows] @ q[at]).astype(np.int64)
        best = np.lexsort((ids[rows], -score))[:k]
        found.append(pd.DataFrame({"query_id": query_ids[at], "vec_id": ids[rows][best], "score": score[best]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def top_k_products(
    candidates: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector_column: str = "vector",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products over all candidates but its own id.

    Vectors are arrays of integers. Queries and candidates are cut into blocks of bounded size, and each pair of blocks
    is one task's unit; every unit gives at most ``k`` rows per query, which are merged by query. Both numbers of blocks
    follow from counted rows. Ties go to smaller ids, fewer than ``k`` rows are given if there are no more, vectors
    of different lengths are never compared, null vectors or ids take no part, rows that repeat a query's id and vector ask
    once, repeated candidates each count. Vectors whose products may not fit into 64 bits raise. Empty tables give an empty result.
    """
    column = lambda df: df.select(
        F.col(id_column).cast("long").alias("_id"), F.col(vector_column).cast("array<long>").alias("_vector")
    ).where("_id is not null and _vector is not null and size(_vector) > 0")
    candidates, queries = column(candidates), column(queries).distinct()
    blocks = max(1, -(-candidates.count() // block_rows))
    chunks = max(1, -(-queries.count() // query_rows))
    dealt = lambda salt, n: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumns({"_block": dealt(1, blocks), "_size": F.size("_vector")}).withColumn("_chunk", every(chunks))
    right = queries.withColumns({"_chunk": dealt(2, chunks), "_size": F.size("_vector")}).withColumn("_block", every(blocks))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return search_block(
            rows["_id"].to_numpy(), np.stack(rows["_vector"]), asked["_id"].to_numpy(), np.stack(asked["_vector"]), k
        ).astype("int64")

    key = ["_block", "_chunk", "_size"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled_floor(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """``vec_id, vector``: ``floor(scale * x)`` of each component; vectors that are null or hold null or non-finite parts go.

    A component beyond 64 bits raises.
    """
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    fits = lambda v: F.abs(v) < F.lit(float(2**63))
    whole = lambda v: F.when(fits(v), F.floor(v).cast("long")).otherwise(F.raise_error(F.lit("a component does not fit into 64 bits")).cast("long"))
    # Guarded where it is computed too: later filters on the result may be evaluated before this one.
    floors = F.when(x.isNotNull() & finite, F.transform(x, lambda v: whole(v * scale)))
    return vectors.where(x.isNotNull() & finite).select(F.col(id_column).alias("vec_id"), floors.alias("vector"))
