"""Rolling bank of earlier vectors that new rows are paired with.

State is the latest vector of each (root, segment) and the last ``capacity`` rows of each root. Rows of one batch never meet each
other. ``rolling_pairs`` keeps it in the state store of a stream; ``bank_step`` is the same for one batch of tables, as a join
against bounded state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from annolake.functions import text as tx
from annolake.functions.unlike import unlike
from annolake.operators.ordered import index_block, with_rank
from annolake.operators.pairs import UNLIMITED, max_ocr_negatives
from annolake.operators.similarity import dot_similarity

CAPACITY = 512  # fixed value
SALTS = 8
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAIR_ROWS = T.StructType([
    T.StructField("root", T.StringType()), T.StructField("order_idx", T.LongType()), T.StructField("old_order_idx", T.LongType()),
    T.StructField("same", T.BooleanType()), T.StructField("source", T.StringType()), T.StructField("similarity", T.DoubleType()),
])
COLUMNS = "root string, video_id string, segment_id string, norm_text string, order_idx long, vector array<double>"


def bank_step(
    rows: DataFrame, bank: DataFrame, latest: DataFrame, maximum: float = 0.2, ratio: float = 0.3,
    capacity: int = CAPACITY, salts: int = 16,
) -> dict[str, DataFrame]:
    """Pair new positive rows (``COLUMNS`` plus adjacent, an array of neighbour segments) with the state before them."""
    names = ["root", "video_id", "segment_id", "norm_text", "order_idx", "vector"]
    old = lambda df: df.select("root", *[F.col(c).alias("old_" + c) for c in names[1:]])
    same = rows.join(old(latest).withColumnRenamed("old_segment_id", "segment_id"), ["root", "segment_id"]).select(
        "root", "order_idx", "old_order_idx", F.lit(True).alias("same"), F.lit("local").alias("source"),
        dot_similarity(F.col("vector"), F.col("old_vector")).alias("similarity"),
    )
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("order_idx"), F.lit(salts)))
    spread = old(bank).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = salted.join(spread, ["root", "_salt"]).filter(F.col("segment_id") != F.col("old_segment_id"))
    near = F.coalesce((F.col("video_id") == F.col("old_video_id")) & F.array_contains("adjacent", F.col("old_segment_id")), F.lit(False))
    met = met.withColumn("near", near)
    local = met.filter("near").filter(~tx.is_same_text(F.col("norm_text"), F.col("old_norm_text")))
    far = met.filter("not near").filter(tx.similarity_at_most(F.col("norm_text"), F.col("old_norm_text"), maximum))
    pick = lambda df, source: df.select(
        "root", "order_idx", "old_order_idx", F.lit(False).alias("same"), F.lit(source).alias("source"),
        dot_similarity(F.col("vector"), F.col("old_vector")).alias("similarity"),
    )
    both = pick(local, "local").unionByName(pick(far, "ocr"))
    # Per new row at most `capacity` candidates: the budget of text negatives follows its own local ones.
    mine = W.partitionBy("root", "order_idx")
    ranked = both.withColumn("_local", F.sum((F.col("source") == "local").cast("long")).over(mine)).withColumn(
        "_at", F.row_number().over(W.partitionBy("root", "order_idx", "source").orderBy("old_order_idx"))
    )
    kept = ranked.filter((F.col("source") == "local") | (F.col("_at") <= max_ocr_negatives(F.col("_local"), F.lit(1), ratio)))
    everything = bank.select(*names).unionByName(rows.select(*names))
    newest = with_rank(everything, [F.col("order_idx").desc()], -index_block(F.col("order_idx"), 1024), ["root"], "_age")
    both_latest = latest.select(*names).unionByName(rows.select(*names))
    last = both_latest.groupBy("root", "segment_id").agg(F.max_by(F.struct(*names), "order_idx").alias("v")).select("v.*")
    return {
        "pairs": same.unionByName(kept.drop("_local", "_at")),
        "bank": newest.filter(F.col("_age") < capacity).drop("_age"),
        "latest": last.select(*names),
    }


class Seen:
    """The bank before a batch, laid out for its rows: what each row asks of all entries is read from arrays."""

    def __init__(self, bank: list[tuple]) -> None:
        self.bank = bank
        self.vectors = np.array([entry[4] for entry in bank], np.float64)
        column = lambda k: np.array([*(entry[k] for entry in bank), None], dtype=object)[:-1]
        self.videos, self.segments = column(0), column(1)
        self.long = np.array([len(entry[2]) >= tx.MIN_COMPARED_CHARS for entry in bank], bool)
        self.in_order = np.argsort(np.array([entry[3] for entry in bank], np.int64), kind="stable")


def _entry(row) -> tuple[tuple, set]:
    """A row as it stands in the bank, and its neighbour segments."""
    return (row.video_id, row.segment_id, row.norm_text, int(row.order_idx), [float(v) for v in row.vector]), set(row.adjacent)


def first_unlike(text: str, others: list[str], maximum: float, wanted: int, names) -> list:
    """The first ``wanted`` of ``names`` whose texts are unlike ``text``. Texts are compared a few at a time, and no more than that takes."""
    found, at, step = [], 0, 8
    while at < len(others) and len(found) < wanted:
        part = others[at : at + step]
        hit = unlike([text], part, maximum, np.ones((1, len(part)), bool))[0]
        found += [names[at + k] for k in np.flatnonzero(hit)]
        at, step = at + step, 2 * step
    return found[:wanted]


class RollingBank(StatefulProcessor):
    """State of one (root, salt): the last ``capacity`` rows of the root, and the latest vector of each segment that is dealt to the salt.

    Rows of one micro-batch meet the state before it, never each other. Every salt keeps the whole bank of its root, which is bounded; the rows
    that are paired, and their segments' vectors, are dealt over the salts.
    """

    def __init__(self, maximum: float, ratio: float, capacity: int) -> None:
        self.maximum, self.ratio, self.capacity = maximum, ratio, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        vector = T.ArrayType(T.DoubleType())
        row = T.StructType([T.StructField("order_idx", T.LongType()), T.StructField("vector", vector)])
        entry = T.StructType([
            T.StructField("video_id", T.StringType()), T.StructField("segment_id", T.StringType()), T.StructField("norm_text", T.StringType()), *row.fields,
        ])
        self.latest = handle.getMapState("latest", T.StructType([T.StructField("segment_id", T.StringType())]), row)
        self.bank = handle.getListState("bank", entry)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        bank = [tuple(entry) for entry in self.bank.get()] if self.bank.exists() else []
        seen = Seen(bank)
        newest = [(entry[3], entry) for entry in bank]
        latest: dict[str, tuple] = {}
        # Each segment is asked of the store once a batch.
        known: dict[str, tuple | None] = {}
        for frame in rows:
            # No more than the bank holds is read from one piece of a batch, or carried to the next.
            last = np.argsort(frame["order_idx"].to_numpy(), kind="stable")[-self.capacity :]
            newest += [(own[3], own) for own, _ in map(_entry, frame.iloc[last].itertuples(index=False))]
            newest = sorted(newest, key=lambda e: e[0])[-self.capacity :]
            out = []
            for own, adjacent in map(_entry, frame[frame["own"].to_numpy(bool)].itertuples(index=False)):
                if own[1] not in known:
                    known[own[1]] = self.latest.getValue((own[1],)) if self.latest.containsKey((own[1],)) else None
                out += self._pairs(key[0], own, adjacent, seen, known[own[1]])
                if own[1] not in latest or latest[own[1]][0] < own[3]:
                    latest[own[1]] = (own[3], own[4])
            yield pd.DataFrame(out, columns=[f.name for f in PAIR_ROWS.fields]).astype({"order_idx": "int64", "old_order_idx": "int64", "same": "bool", "similarity": "float64"})
        self.bank.put([entry for _, entry in newest])
        for segment, value in latest.items():
            if known[segment] is None or known[segment][0] < value[0]:
                self.latest.updateValue((segment,), value)

    def _pairs(self, root: str, own: tuple, adjacent: set, seen: Seen, old: tuple | None) -> list[tuple]:
        video, segment, text, order, vector = own
        out = []
        if old is not None:
            out.append((root, order, int(old[0]), True, "local", float(np.dot(vector, old[1]))))
        bank = seen.bank
        if not bank:
            return out
        other = seen.segments != segment
        near = other & (seen.videos == video) if video is not None else np.zeros(len(bank), bool)
        near[near] = [s in adjacent for s in seen.segments[near]]
        local = [k for k in np.flatnonzero(near) if not same_text(text, bank[k][2])]
        far = seen.in_order[(other & ~near & seen.long)[seen.in_order]] if len(text) >= tx.MIN_COMPARED_CHARS else ()
        far = first_unlike(text, [bank[k][2] for k in far], self.maximum, text_negatives_wanted(len(local), self.ratio), far)
        scores = seen.vectors @ np.array(vector, np.float64)
        out += [(root, order, bank[k][3], False, "local", float(scores[k])) for k in local]
        return out + [(root, order, bank[k][3], False, "ocr", float(scores[k])) for k in far]

    def close(self) -> None:
        pass


def same_text(left: str, right: str) -> bool:
    """``functions.text.is_same_text`` of two strings."""
    if not left or not right or left == right:
        return bool(left) and left == right
    if min(len(left), len(right)) < tx.MIN_COMPARED_CHARS:
        return False
    return not unlike([left], [right], np.nextafter(tx.SAME_TEXT_SIMILARITY, 0), np.ones((1, 1), bool))[0, 0]


def text_negatives_wanted(local: int, ratio: float) -> int:
    """``max_ocr_negatives`` of one row."""
    if ratio <= 0.0:
        return 0
    if ratio >= 1.0:
        return UNLIMITED
    return max(1, round(local * ratio / (1.0 - ratio))) if local else max(1, round(ratio))


def rolling_pairs(stream: DataFrame, maximum: float = 0.2, ratio: float = 0.3, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Pairs (``PAIR_ROWS``) of each row of a stream (``COLUMNS`` and adjacent) with the bank before its micro-batch.

    State lives in the stream's state store (RocksDB has to be its provider) and survives a lost executor and a restart with it. A hot
    root is dealt over ``salts`` keys: each sees all rows for its bank, and pairs those of its segments.
    """
    home = F.pmod(F.xxhash64("segment_id"), F.lit(salts)).cast("int")
    spread = stream.withColumn("_home", home).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("own", F.col("salt") == F.col("_home")).drop("_home")
    return spread.groupBy("root", "salt").transformWithStateInPandas(RollingBank(maximum, ratio, capacity), PAIR_ROWS, "Append", "None")


def run_bank(stream: DataFrame, folder: str, checkpoint: str, **settings) -> StreamingQuery:
    """Drive ``rolling_pairs`` over what is there; pairs go to ``folder/pairs``, each once."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    pairs = rolling_pairs(stream, **settings)
    return pairs.writeStream.format("parquet").option("path", f"{folder}/pairs").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
