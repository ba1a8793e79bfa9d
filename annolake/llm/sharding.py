"""Shards of near equal size: splitters from size-weighted key samples, range partitioning, overfull ranges subdivided."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import discard, materialized, text_of

SHARDS = 24
#: What a document costs beside its bytes.
ROW_COST = 8
#: Key samples for each range, ranges for each shard at least, and rows of a range at most (about).
OVERSAMPLED, RANGES_PER_SHARD, RANGE_ROWS = 8, 32, 1 << 20
#: A range that a shard ends in is split into about so many; once it has no more rows, all of them are looked at.
SUBDIVIDED = 512
KEY = ["_group", "_own", "_nth"]


def _spread(value: Column) -> Column:
    """Sixty hash bits of a text."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame, id_column: str, text_column: str, carry: Sequence[Column]) -> DataFrame:
    """``KEY``, id, ``size`` and carried columns. Equal texts are neighbours in key order; the id's hash orders them,
    and a running number tells rows apart that repeat both."""
    text, name = text_of(text_column), F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    size = (F.octet_length(text) + ROW_COST).cast("long")
    return docs.select(
        _spread(text).alias("_group"), _spread(name).alias("_own"), F.monotonically_increasing_id().alias("_nth"),
        F.col(id_column).alias("_id"), size.alias("_size"), *carry,
    )


def _marks(batch: pa.RecordBatch) -> np.ndarray:
    """The key of each row as 24 bytes whose order is the key's."""
    parts = np.stack([batch.column(k).to_numpy() for k in KEY], axis=1).astype(">u8")
    return np.ascontiguousarray(parts).view("S24").ravel()


def mark(key: Sequence[int]) -> bytes:
    """One key in the form of ``_marks`` (trailing zero bytes, as numpy drops them, do not count)."""
    return b"".join(int(k).to_bytes(8, "big") for k in key).rstrip(b"\0")


def ranged(rows: DataFrame, splitters: list[bytes], name: str = "_range") -> DataFrame:
    """``rows`` with the number of splitters that are not behind each row's key."""
    points = np.array(splitters, dtype="S24")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(points, _marks(batch), side="right") if len(points) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + f", {name} int")


def _sample(rows: DataFrame, asked: dict[int, tuple[float, float]]) -> dict[int, list[tuple[bytes, int, int]]]:
    """Key samples of the asked ranges, in key order: key, how often it was drawn, size of its row.

    ``asked`` gives each range a step and what is added to each row's size. A row is drawn as often as whole steps fit into its
    weight, and once more with the probability of the rest (by a hash).
    """
    share = lambda at: F.get(F.array(*(F.lit(float(asked[k][at]) if k in asked else 0.0) for k in range(max(asked) + 1))), F.col("_range"))
    weight = (F.col("_size") + share(1)) / share(0)
    chance = F.pmod(F.xxhash64(*KEY), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(F.col("_range").isin(list(asked))).select("_range", *KEY, F.floor(weight + chance).cast("long").alias("_drawn"), "_size").where("_drawn > 0")
    found: dict[int, list[tuple[bytes, int, int]]] = {k: [] for k in asked}
    for r in drawn.collect():  # as many as were asked for, give or take the square root of that
        found[r[0]].append((mark(r[1:4]), r[4], r[5]))
    return {k: sorted(v) for k, v in found.items()}


def _steps(size: int, count: int, draws: int) -> tuple[float, float]:
    """Step and addition for about ``draws`` draws. A row weighs its size and the mean size together, so that neither many
    bytes nor many small rows make an overfull range."""
    return 2.0 * size / draws, size / count


def _quantiles(sample: list[tuple[bytes, int, int]], ranges: int) -> list[bytes]:
    """Keys that split a weighted sample into ``ranges`` parts of equal weight."""
    until = np.cumsum([n for _, n, _ in sample])
    if not len(until):
        return []
    at = np.searchsorted(until, np.arange(1, ranges) * until[-1] / ranges)
    return sorted({sample[k][0] for k in at})


def _loads(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("_range").agg(F.sum("_size"), F.count("*")).collect()}


@dataclass
class Part:
    """A range of keys in which shards end: where it begins and ends, the bytes before it, its bytes and rows, the shards."""

    low: bytes | None
    high: bytes | None
    before: int
    size: int
    count: int
    shards: list[int]


def _ends(rows: DataFrame, splitters: list[bytes], shards: int) -> list[bytes | None]:
    """The first key of shards 1, 2, ...: of the first row whose middle lies at or beyond the shard's share of all bytes.

    Shards that end between two ranges are settled by sums. Ranges in which a shard ends are overfull: they are split by samples of their
    own, again and again, until few enough rows are left to look at each. ``None`` stands for a shard behind all rows.
    """
    loads = _loads(ranged(rows, splitters))
    total = sum(size for size, _ in loads.values())
    ends: list[bytes | None] = [None] * (shards - 1)

    def settle(edges: list[bytes | None], loads: dict[int, tuple[int, int]], first: int, before: int, asked: Sequence[int]) -> list[Part]:
        """Ends that lie between the ranges from number ``first`` on; the ranges that have others inside."""
        inside = []
        for at in range(len(edges) - 1):
            size, count = loads.get(first + at, (0, 0))
            for k in asked:
                if total * k == before * shards and size:
                    ends[k - 1] = edges[at]
            hit = [k for k in asked if before * shards < total * k < (before + size) * shards]
            if hit:
                inside.append(Part(edges[at], edges[at + 1], before, size, count, hit))
            before += size
        return inside

    parts = settle([None, *splitters, None], loads, 0, 0, range(1, shards))
    work, scratch = rows, []
    while parts:
        points = sorted({e for p in parts for e in (p.low, p.high) if e is not None})
        # A part's rows have the number of points up to its low end.
        numbers = [0 if p.low is None else points.index(p.low) + 1 for p in parts]
        work = materialized(ranged(work, points).where(F.col("_range").isin(numbers)), "open")
        scratch.append(work)
        # Where few rows are left, the step is so small that each of them is drawn.
        asked = {n: (1.0, 1.0) if p.count <= SUBDIVIDED else _steps(p.size, p.count, OVERSAMPLED * SUBDIVIDED) for n, p in zip(numbers, parts, strict=True)}
        samples = _sample(work, asked)
        new, after = {}, []
        for n, p in zip(numbers, parts, strict=True):
            if p.count > SUBDIVIDED:
                new[n] = _quantiles(samples[n], SUBDIVIDED)
                continue
            at, left = p.before, list(p.shards)
            for key, _, size in samples[n]:
                while left and (2 * at + size) * shards >= 2 * total * left[0]:
                    ends[left.pop(0) - 1] = key
                at += size
            for k in left:
                ends[k - 1] = p.high  # the first row behind the range
        if new:
            points = sorted({*points, *(e for own in new.values() for e in own)})
            work = work.drop("_range")
            loads = _loads(ranged(work, points))
            for n, p in zip(numbers, parts, strict=True):
                if n in new:
                    first = 0 if p.low is None else points.index(p.low) + 1
                    own = [e for e in new[n] if e != p.low]
                    after += settle([p.low, *own, p.high], loads, first, p.before, p.shards)
        parts = after
    for table in scratch:
        discard(table)
    return ends


def plan_shards(rows: DataFrame, shards: int) -> tuple[list[bytes], list[bytes | None]]:
    """Splitters of fine ranges, and the first key of each shard but the first, for rows with ``KEY`` and ``_size``."""
    size, count = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    if not count:
        return [], [None] * (shards - 1)
    ranges = max(shards * RANGES_PER_SHARD, -(-count // RANGE_ROWS))
    sample = _sample(rows.withColumn("_range", F.lit(0)), {0: _steps(size, count, OVERSAMPLED * ranges)})
    splitters = _quantiles(sample[0], ranges)
    return splitters, _ends(rows, splitters, shards)


def sharded(
    docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text", carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes and ``ROW_COST``), the ``carry`` columns, ``shard`` (from 0) and ``slot``.

    Shards hold near equal bytes: rows are in the order of a key (hash of the text, then of the id), and a row belongs to the
    shard in whose share of all bytes its middle lies, so no shard is off by more than its largest row. Size-weighted
    samples split the keys into fine ranges; ranges in which a shard ends are split on. Equal texts lie side by side and
    share a shard unless one ends among them. ``slot`` counts the rows of a shard from 0 without gaps; the rank of a row is
    found within its fine range, and no task holds a shard.

    Null texts are empty; null ids are ordinary ids. Rows that repeat id and text get slots of their own. With few or very large
    rows some shards may stay empty. Other columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    extra = [column.alias(f"_carry{k}") for k, column in enumerate((carry or {}).values())]
    rows = materialized(keyed(docs, id_column, text_column, extra), "keyed")
    splitters, ends = plan_shards(rows, shards)
    firsts = [e for e in ends if e is not None]
    # A shard's first row starts a range of its own, so that a range never lies in two shards.
    points = sorted({*splitters, *firsts})
    home = [0] * (len(points) + 1)
    for at, point in enumerate(points):
        home[at + 1] = max([k + 1 for k, e in enumerate(ends) if e is not None and e <= point], default=0)
    placed = ranged(rows, points)
    loads = {r[0]: r[1] for r in placed.groupBy("_range").count().collect()}
    start, last = [], {}
    for at, shard in enumerate(home):
        start.append(last.get(shard, 0))
        last[shard] = start[-1] + loads.get(at, 0)
    ranked = _ranked(placed, start, home)
    return ranked.select(
        F.col("_id").alias(id_column), F.col("_size").alias("size"), *(F.col(f"_carry{k}").alias(name) for k, name in enumerate(carry or {})),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
    )


def _ranked(placed: DataFrame, start: list[int], home: list[int]) -> DataFrame:
    """``_shard`` and ``_slot`` of rows with ``_range``: rows of a range meet, in key order, and are counted as they pass."""
    starts, homes = np.array(start, np.int64), np.array(home, np.int32)
    kinds = [(c, k) for c, k in placed.dtypes if c not in KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("_range").to_numpy()
            edge = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
            place = np.arange(len(own)) - np.repeat(edge, np.diff(edge, append=len(own)))
            if own[0] == at:
                place[: edge[1] if len(edge) > 1 else len(own)] += seen
            at, seen = int(own[-1]), int(place[-1]) + 1
            columns = [batch.column(c) for c, _ in kinds]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(homes[own]), pa.array(starts[own] + place)], names=[*(c for c, _ in kinds), "_shard", "_slot"])

    ordered = placed.repartition("_range").sortWithinPartitions("_range", *KEY)
    return ordered.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds) + ", _shard int, _slot long")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the whole rows of ``docs`` as Parquet below ``path``, a folder ``shard=...`` for each shard.

    Beside the columns of ``docs`` (nested as ``row``) the files hold ``size`` and ``slot``; rows of a file are in the order of their slots. A shard's
    folder has as many files as ranges of slots were dealt, and no task writes more than one of them at a time.
    """
    whole = F.struct(*(docs[c] for c in docs.columns))
    placed = sharded(docs, shards, id_column, text_column, {"row": whole}).select("shard", "slot", "size", "row")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
