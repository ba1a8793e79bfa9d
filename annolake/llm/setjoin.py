"""Exact set-similarity joins over hashed sets: rarity order, prefix, length and position filters, verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token counts are kept by hash bucket, so that the order of rarity has one size whatever the corpus holds. Any order gives
#: exact results; buckets that tokens share only make it a little less selective.
SKETCH_BITS = 20


def buckets_of(tokens: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def rarity(sets: DataFrame, column: str = "_set") -> np.ndarray:
    """How many sets hold the tokens of each hash bucket. Tasks add up their own sets; a count per bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            tokens = np.frombuffer(b"".join(own or b"" for own in batch.column(0).to_pylist()), np.uint64)
            total += np.bincount(buckets_of(tokens), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return sketch_of(sets.select(column).mapInArrow(count, "bucket long, n long"))


def sketch_of(counts: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Sum rows ``bucket, n`` into one array."""
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << bits, np.uint32)
    total[rows["bucket"].to_numpy()] = np.minimum(rows["n"].to_numpy(), 0xFFFFFFFF)
    return total


def prefix_length(size: int, percent: int) -> int:
    """How many of the rarest tokens two sets similar enough cannot both do without."""
    return size - -(-size * percent // 100) + 1


def ordered(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens from rare to frequent, ties by value: one order for all sets."""
    return own[np.lexsort((own, counts[buckets_of(own)]))]


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int, keep: Sequence[str], column: str = "_set") -> DataFrame:
    """A row for each prefix token of each set: ``keep`` columns, ``_token``, ``_at`` (its place), ``_size`` (of the set)."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)  # 2^SKETCH_BITS numbers of four bytes, always
    kinds = dict(sets.dtypes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places, rows, sizes = [], [], [], []
            for row, own in enumerate(batch.column(column).to_pylist()):
                own = np.frombuffer(own or b"", np.uint64)
                if len(own):
                    take = ordered(own, shared.value)[: prefix_length(len(own), percent)]
                    tokens.append(take)
                    places.append(np.arange(len(take), dtype=np.int32))
                    rows.append(np.full(len(take), row))
                    sizes.append(np.full(len(take), len(own), dtype=np.int32))
            if tokens:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in keep), pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes))],
                    names=[*keep, "_token", "_at", "_size"],
                )

    schema = "".join(f"{c} {kinds[c]}, " for c in keep) + "_token long, _at int, _size int"
    return sets.select(*keep, column).mapInArrow(emit, schema)


def can_match(size: Column, at: Column, other_size: Column, other_at: Column, percent: int) -> Column:
    """Length and position filters for two sets that share a token at these places of their orders.

    Similar sets share at least ``percent / (100 + percent)`` of both sizes together, and after the first token that
    they share no more than what is left of either. A similar pair passes at its first shared token, which lies in
    both prefixes, so pairs that fail at later ones are not lost.
    """
    lengths = 100 * F.least(size, other_size) >= percent * F.greatest(size, other_size)
    shared = 1 + F.least(size - at - 1, other_size - other_at - 1)
    return lengths & ((100 + percent) * shared >= percent * (size + other_size))


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether the intersection of two sets (sorted hashes as bytes) is at least ``percent`` hundredths of their union."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)
