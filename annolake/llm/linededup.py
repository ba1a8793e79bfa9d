"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.llm.common import discard, materialized, may_hold, row_key, text_of
from annolake.llm.setjoin import buckets_of, can_match, similar, sketch_of
from annolake.llm.words import Words, mix64, slices

NEWLINE = 10
#: A token of so many lines at most (as counted by hash bucket) is rare.
RARE = 512
#: Tokens are counted in so many hash buckets, whatever the corpus holds.
COUNT_BITS = 22
#: Lines over so many tokens meet over single tokens only.
LONG = 256
#: Shares that the keys are dealt with in, at most, and rows of a share where fewer do.
SHARES, SHARE_ROWS = 6, 4_000_000
#: What a null id counts as: it comes before all others.
NULL_ID = -(1 << 63)


def _token_counts(docs: DataFrame) -> np.ndarray:
    """Sketch of how often each token occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "_text"):
                np.add.at(total, buckets_of(Words(texts, True).hashes(), COUNT_BITS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return sketch_of(docs.select("_text").mapInArrow(count, "bucket long, n long"), COUNT_BITS)


class LineSets:
    """Distinct tokens of each line of some texts, all in one array, in the order of ``rank`` and then of value."""

    def __init__(self, texts: list[bytes], counts: np.ndarray | None) -> None:
        spans = Words(texts, True)
        tokens = spans.hashes()
        breaks = np.flatnonzero(spans.data == NEWLINE)  # one ends each line; the text's own end is one too
        line = np.searchsorted(breaks, spans.starts)
        order = np.lexsort((tokens, line) if counts is None else (tokens, counts[buckets_of(tokens, COUNT_BITS)], line))
        line, tokens = line[order], tokens[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (line[1:] != line[:-1])
        self.line, self.tokens = line[new], tokens[new]
        self.count = len(breaks)
        self.size = np.bincount(self.line, minlength=self.count)
        self.start = np.cumsum(self.size) - self.size
        mixed = np.stack((mix64(self.tokens), mix64(self.tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))), axis=1)
        sums = np.zeros((self.count, 2), np.uint64)
        full = self.size > 0
        if full.any():
            sums[full] = np.add.reduceat(mixed, self.start[full], axis=0)
        self.keys = sums
        self.text = np.searchsorted(spans.text_ends, breaks, side="right")
        first = np.searchsorted(self.text, np.arange(len(texts)))
        self.number = np.arange(self.count) - first[self.text]

    def parity(self, rows: np.ndarray) -> np.ndarray:
        """Bit k says whether an odd number of a line's tokens end in k (of 64). Sets differ in as many tokens as parities do in bits, at least."""
        bits = np.uint64(1) << (self.tokens & np.uint64(63))
        until = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(bits)))
        return (until[(self.start + self.size)[rows]] ^ until[self.start[rows]]).view(np.int64)

    def key_column(self, rows: np.ndarray) -> pa.Array:
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(np.ascontiguousarray(self.keys[rows]))]).cast(pa.binary())


#: What tells a line, in the order of lines: its document, its number, and the hash of the whole text.
LATER = ["_doc", "_ref", "_row"]
LINE = ", ".join(f"{name} long" for name in LATER)


def _home(part: pa.RecordBatch, sets: LineSets, rows: np.ndarray) -> list[pa.Array]:
    """The columns ``LATER`` of some lines."""
    text = pa.array(sets.text[rows])
    return [part.column("_doc").take(text), pa.array(sets.number[rows]), part.column("_row").take(text)]


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line with tokens: ``_doc, _ref, _row`` (its document, number and the hash of its text, for documents that share
    an id), ``_key`` (a 128-bit hash of its token set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                sets = LineSets(texts, None)
                rows = np.flatnonzero(sets.size)
                yield pa.RecordBatch.from_arrays([*_home(part, sets, rows), sets.key_column(rows)], names=[*LATER, "_key"])

    return docs.mapInArrow(run, f"{LINE}, _key binary")


def _prefixes(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """The lines that can have similar ones: ``_doc, _ref, _row, _key, _size, _parity, _prefix, _rare``.

    The prefix has one token more than similar sets cannot do without, so that they share two. The first ``_rare`` of it are rare.
    Lines of up to three tokens are only similar to equal sets, which share their key.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 2^COUNT_BITS numbers of four bytes, always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                sets = LineSets(texts, shared.value)
                rows = np.flatnonzero(sets.size > 3)
                take = sets.size[rows] - -(-sets.size[rows] * percent // 100) + 2
                offsets = np.concatenate(([0], np.cumsum(take)))
                place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], take)
                prefix = sets.tokens[np.repeat(sets.start[rows], take) + place]
                rare = np.concatenate(([0], np.cumsum(shared.value[buckets_of(prefix, COUNT_BITS)] <= RARE)))
                yield pa.RecordBatch.from_arrays(
                    [*_home(part, sets, rows), sets.key_column(rows), pa.array(sets.size[rows].astype(np.int32)), pa.array(sets.parity(rows)),
                     pa.ListArray.from_arrays(offsets.astype(np.int32), prefix.view(np.int64)), pa.array((rare[offsets[1:]] - rare[offsets[:-1]]).astype(np.int32))],
                    names=[*LATER, "_key", "_size", "_parity", "_prefix", "_rare"],
                )

    return docs.mapInArrow(run, f"{LINE}, _key binary, _size int, _parity long, _prefix array<long>, _rare int")


def _classes(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """One row for all lines of one set, the first of them, with ``_line``: a number that grows in the order of lines."""
    first = F.min(F.struct(*LATER)).alias("_first")
    fields = ["_size", "_parity", "_prefix", "_rare"]
    grouped = _prefixes(docs, counts, percent).groupBy("_key").agg(first, *(F.first(c).alias(c) for c in fields))
    grouped = materialized(grouped.select("_first.*", *fields), "grouped")
    ordered = grouped.repartitionByRange(*LATER).sortWithinPartitions(*LATER)
    classes = materialized(ordered.withColumn("_line", F.monotonically_increasing_id()), "classes")
    discard(grouped)
    return classes


def _keys(classes: DataFrame, part: int, parts: int) -> DataFrame:
    """``_token, _line, _mark, _parity``: what classes meet over, in one of ``parts`` shares. The mark holds place and size.

    The first token that two similar sets share is in both prefixes. If it is rare, it is a key by itself. If not, no token
    that they share is rare, and the first two of them are: those pairs are keys (placed so that the position filter counts both).
    Lines over ``LONG`` tokens would have too many pairs; there each token is a key. Lines near that length have both kinds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rare = batch.column("_size").to_numpy().astype(np.int64), batch.column("_rare").to_numpy().astype(np.int64)
            prefix = batch.column("_prefix")
            tokens, offsets = prefix.flatten().to_numpy().view(np.uint64), prefix.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            length = np.diff(offsets)
            # Single tokens: the rare ones of the prefix proper, all of a long line's.
            single = np.where(size * 5 >= LONG * 4, length - 1, np.minimum(rare, length - 1))
            rows = np.repeat(np.arange(len(size)), single)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(single) - single, single)
            yield from emit(batch, rows, tokens[offsets[rows] + at], at, size)
            # Pairs of others, for all lines with equally many of them at a time.
            others = np.where(size * 4 <= LONG * 5, length - rare, 0)
            for many in np.unique(others[others > 1]).tolist():
                left, right = np.triu_indices(many, 1)
                every = np.flatnonzero(others == many)
                step = max(1, (1 << 19) // len(left))
                for own in (every[k : k + step] for k in range(0, len(every), step)):
                    start = (offsets[own] + rare[own])[:, None]
                    x, y = tokens[start + left], tokens[start + right]
                    key = mix64(x * np.uint64(0x9E3779B97F4A7C15) + (y << np.uint64(1) | np.uint64(1)))
                    yield from emit(batch, np.repeat(own, len(left)), key.ravel(), (rare[own][:, None] + right - 1).ravel(), size)

    def emit(batch: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        if parts > 1:
            mine = keys % np.uint64(parts) == np.uint64(part)
            rows, keys, at = rows[mine], keys[mine], at[mine]
        if len(rows):
            where = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), batch.column("_line").take(where), pa.array(at << 32 | size[rows]), batch.column("_parity").take(where)],
                names=["_token", "_line", "_mark", "_parity"],
            )

    return classes.select("_line", "_size", "_parity", "_prefix", "_rare").mapInArrow(run, "_token long, _line long, _mark long, _parity long")


def _shares(classes: DataFrame) -> int:
    """How many shares the keys are dealt with in, so that not all of them lie on disk at once."""
    size, length, rare = F.col("_size"), F.size("_prefix"), F.col("_rare")
    single = F.when(size * 5 >= LONG * 4, length - 1).otherwise(F.least(rare, length - 1))
    others = F.when(size * 4 <= LONG * 5, length - rare).otherwise(0).cast("long")
    rows = classes.agg(F.sum(single + others * (others - 1) / 2)).first()[0] or 0
    return int(min(SHARES, rows // SHARE_ROWS + 1))


def _near(x: str, y: str, percent: int) -> Column:
    """What two rows of one key must hold: order, size, place, and parities that do not differ in more bits than similar sets may in tokens."""
    size = lambda t: F.col(f"{t}._mark").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    at = lambda t: F.shiftright(F.col(f"{t}._mark"), 32)
    differ = F.bit_count(F.col(f"{x}._parity").bitwiseXOR(F.col(f"{y}._parity")))
    close = (100 + percent) * differ <= (100 - percent) * (size(x) + size(y))
    return (F.col(f"{x}._line") > F.col(f"{y}._line")) & can_match(size(x), at(x), size(y), at(y), percent) & close


def _with_first(rows: DataFrame, percent: int) -> DataFrame:
    """``_line, _other``: each row with the earliest one of its key, if it may be similar to that."""
    own = [F.min_by(c, "_line").alias(c) for c in ("_mark", "_parity")]
    first = rows.groupBy("_token").agg(F.count("*").alias("_n"), F.min("_line").alias("_line"), *own).where("_n > 1")
    joined = rows.alias("x").join(first.alias("y"), (F.col("x._token") == F.col("y._token")) & _near("x", "y", percent))
    return joined.select(F.col("x._line").alias("_line"), F.col("y._line").alias("_other")).distinct()


def _within(rows: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """``_line, _other``: each row with the earlier ones of its key that it may be similar to."""
    joined = rows.alias("x").join(others.alias("y"), (F.col("x._token") == F.col("y._token")) & _near("x", "y", percent))
    return joined.select(F.col("x._line").alias("_line"), F.col("y._line").alias("_other")).distinct()


def _line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``_line, _set`` of the wanted lines (``_line`` and ``LATER``). Texts are not moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                sets = LineSets(texts, None)
                rows = np.flatnonzero(sets.size > 3)
                home = _home(part, sets, rows)
                own = [sets.tokens[a : a + n].tobytes() for a, n in zip(sets.start[rows].tolist(), sets.size[rows].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*home, pa.array(own, pa.binary())], names=[*LATER, "_set"])

    sets = docs.mapInArrow(run, f"{LINE}, _set binary").where(may_hold(wanted, LATER))
    return sets.join(wanted, LATER, "inner").select("_line", "_set")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``_line`` of the later lines that are similar to the earlier one of a pair, by full token sets."""
    ids = pairs.select("_line").union(pairs.select("_other")).distinct()
    wanted = materialized(classes.select("_line", *LATER).join(ids, "_line", "left_semi"), "wanted")
    sets = materialized(_line_sets(docs, wanted).dropDuplicates(["_line"]), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = batch.column("_set").to_pylist(), batch.column("_other_set").to_pylist()
            keep = pa.array([similar(x, y, percent) for x, y in zip(mine, other, strict=True)], pa.bool_())
            yield batch.select(["_line"]).filter(keep)

    both = pairs.join(sets, "_line").join(sets.toDF("_other", "_other_set"), "_other")
    found = materialized(both.select("_line", "_set", "_other_set").mapInArrow(run, "_line long").distinct(), "gone")
    for table in (wanted, sets):
        discard(table)
    return found


def repeated_lines(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per line with tokens: ``id, line`` (from 0), ``kept``.

    A line's set holds its distinct lower-cased words. A line goes if an earlier line (by id, then line number; whether that one stays or not)
    has a set whose intersection with its own is at least ``percent`` hundredths of their union. Equal sets are one class whose
    first line stands for all, so a very common line is counted and not compared. Classes meet over the rarest tokens of
    their prefixes, or two of them where none is rare, filtered by length, position and parity. A class is first compared with the
    earliest one of each of its keys only, so that many alike cost no more each than few; classes that find no match there are then
    compared with all earlier ones that pass the filters. Matches are verified on full sets.

    Ids are integers. Blank lines, and so null and empty texts, have no rows. Rows that repeat an id and text share their fate; null
    ids come first and are one id. Texts that share an id are told apart: equal line numbers are ordered by the hash of the text.
    Other columns are ignored; an empty table gives an empty result.
    """
    name = F.when(F.col("_doc") != NULL_ID, F.col("_doc")).alias(id_column)
    return _decided(docs, percent, id_column, text_column).select(name, "line", "kept")


def _decided(docs: DataFrame, percent: int, id_column: str, text_column: str) -> DataFrame:
    """``repeated_lines`` with ``_doc, _row`` instead of the id."""
    source = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("_doc"), row_key(text_column).alias("_row"), text_of(text_column).alias("_text")
    )
    classes = _classes(source, _token_counts(source), percent)
    pairs, shares = [], _shares(classes)
    for part in range(shares):
        rows = materialized(_keys(classes, part, shares), "keys")
        pairs.append(materialized(_with_first(rows, percent), "pairs"))
        discard(rows)
    tested = materialized(reduce(DataFrame.union, pairs).distinct(), "tested")
    for table in pairs:
        discard(table)
    gone = _confirmed(tested, classes, source, percent)

    # What found no match there against all earlier classes.
    pairs = []
    for part in range(shares):
        rows = materialized(_keys(classes, part, shares), "keys")
        found = _within(rows.join(gone, "_line", "left_anti"), rows, percent)
        pairs.append(materialized(found.join(tested, ["_line", "_other"], "left_anti"), "pairs"))
        discard(rows)
    more = materialized(reduce(DataFrame.union, pairs).distinct(), "more")
    more_gone = _confirmed(more, classes, source, percent)
    for table in (tested, more, *pairs):
        discard(table)
    lost = materialized(classes.select("_line", *LATER).join(gone.union(more_gone).distinct(), "_line", "left_semi").select(*LATER), "lost")
    for table in (classes, gone, more_gone):
        discard(table)

    lines = materialized(_lines(source), "lines")
    first = F.min(F.struct(*LATER)).alias("_first")
    stay = lines.groupBy("_key").agg(first).select("_first.*").join(lost, LATER, "left_anti").withColumn("_stays", F.lit(True))
    placed = lines.select(*LATER).join(stay, LATER, "left")
    return placed.select("_doc", "_row", F.col("_ref").cast("int").alias("line"), F.coalesce("_stays", F.lit(False)).alias("kept"))


def without_repeats(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines``, ``n_removed``: how many lines with words it had and lost.

    Blank lines stay. Texts that lose nothing are unchanged. Columns of the input that are called like the two new ones are replaced.
    """
    found = _decided(docs, percent, id_column, text_column)
    lost = F.collect_set(F.when(~F.col("kept"), F.col("line"))).alias("_lost")
    counts = materialized(found.groupBy("_doc", "_row").agg(F.count_distinct("line").alias("_lines"), lost), "lost")
    name = F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("_doc")
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_whole"), name, row_key(text_column).alias("_row"), F.col(text_column).alias("_text"))
    joined = whole.join(counts, ["_doc", "_row"], "left")
    loses = F.size("_lost") > 0
    text = F.when(loses, _without(F.when(loses, F.col("_text")), F.when(loses, F.col("_lost")))).otherwise(F.col("_text"))
    columns = [text.alias(c) if c == text_column else F.col("_whole")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    counted = F.coalesce("_lines", F.lit(0)).cast("long").alias("n_lines"), F.when(loses, F.size("_lost")).otherwise(0).cast("long").alias("n_removed")
    return joined.select(*columns, *counted)


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, lost: pa.Array) -> pa.Array:
    """Texts without the lines of these numbers."""

    def one(text: str | None, numbers: list[int] | None) -> str | None:
        if text is None or numbers is None:
            return None
        gone = set(numbers)
        return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)

    return pa.array([one(text.as_py(), numbers.as_py()) for text, numbers in zip(texts, lost, strict=True)], pa.string())
