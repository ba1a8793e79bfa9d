"""The pool of text negatives, addressed by rank and never listed.

A text negative is a pair of samples of one root with unlike texts, of different segments that are no neighbours. Samples with
one text behave alike, so the pool is a relation between distinct texts: its counts are summed by (text, block of later texts), a
rank is found in the running sums of these cells, then in the cell's texts, then in the two texts' members. Only
members that are drawn are looked up; nothing is drawn twice or rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.functions.unlike import unlike
from annolake.operators.ordered import Few, dense_block, hash_block, index_block, located, running_sums
from annolake.operators.segments import adjacency_edges
from annolake.session import checkpointed

#: Texts (and letters of texts, about) of a block. Blocks are compared pair by pair, each pair in one task's memory.
BLOCK_TEXTS, BLOCK_LETTERS = 2048, 1 << 22
#: Parts that the ranks are cut into when cells are looked up.
RANK_PARTS = 4096

PAIRS = "i long, j long, same boolean, source string"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shuffled_ranks(ranks: np.ndarray, total: int, seeds: np.ndarray) -> np.ndarray:
    """A seeded permutation of ``range(total)`` at the given places: four Feistel rounds, walked until they end inside the range."""
    half = np.uint64(max(1, ((total - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, seeds = ranks.astype(np.uint64), seeds.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        high, low, seed = out[walking] >> half, out[walking] & mask, seeds[walking]
        for turn in range(4):
            key = seed + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            high, low = low, high ^ (mixed(low ^ mixed(key)) & mask)
        out[walking] = high << half | low
        walking = walking[out[walking] >= np.uint64(total)]
    return out.astype(np.int64)


def _places(total: int, seed: int, epoch: int):
    """The rank at each place of a seeded order of ``range(total)``; places from ``total`` on are further passes, each in an order of its own."""

    @F.pandas_udf(T.LongType())
    def place(number: pd.Series) -> pd.Series:
        n = number.to_numpy()
        base = np.uint64((seed * 0x9E3779B97F4A7C15 + epoch) & (1 << 64) - 1)
        seeds = mixed(base + (n // total).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        return pd.Series(shuffled_ranks(n % total, total, seeds))

    return place


def drawn_ranks(spark: SparkSession, total: int, count: int, seed: int, epoch: int) -> DataFrame:
    """``pass, rank``: ``count`` ranks below ``total`` in a seeded order. Each pass has every rank at most once; there are as few as possible."""
    return spark.range(count).select(F.expr(f"id div {total}L").alias("pass"), _places(total, seed, epoch)("id").alias("rank"))


def ranks_between(spark: SparkSession, total: int, first: int, last: int, seed: int, epoch: int) -> DataFrame:
    """``place, rank``: the ranks at the places ``[first, last)`` of that order."""
    return spark.range(first, last).select(F.col("id").alias("place"), _places(total, seed, epoch)("id").alias("rank"))


@dataclass
class TextNegatives:
    """``total`` pairs, as ``cells`` (root, text, block, bitmap, start, pairs), ``blocks`` (members of each text of a block), ``excluded``
    (what members of one text may not meet of another: those of their segments and of neighbours), ``holes`` (the same summed by cell)
    and ``members`` (sample at a place of a text)."""

    total: int
    cells: DataFrame
    blocks: DataFrame
    excluded: DataFrame
    holes: DataFrame
    members: DataFrame

    def at(self, ranks: DataFrame) -> DataFrame:
        """The pairs at these ranks: ``pass, rank`` (of ``ranks``), ``i``, ``j``."""
        draw = ["pass", "rank"]
        width = max(1, -(-self.total // RANK_PARTS))
        found = located(self.cells.select(F.col("start").alias("rank")), ranks.select(*draw), (), "rank", Few(F.expr(f"rank div {width}L")))
        found = found.join(self.cells, F.col("p_rank") == F.col("start"))
        found = found.select(*draw, (F.col("rank") - F.col("start")).alias("_left"), "root", "t", "block", "n", "bitmap")
        found = found.join(self.blocks, ["root", "block"]).join(self.holes, ["root", "t", "block"], "left")
        found = checkpointed(found.mapInPandas(_text_of_cell, "pass long, rank long, root string, t long, h long, n long, m long, rest long"))
        # Members of both texts: rows of a table as wide as the later text has members, less what the earlier one's may not meet.
        texts = ["root", "t", "h"]
        pieces = self.excluded.join(found.select(*texts, "n", "m").distinct(), texts)
        pieces = running_sums(pieces, ["x"], {"_less": F.col("nx") * F.col("blocked")}, texts, dense_block(F.col("x")))
        pieces = pieces.select(*texts, "n", "m", (F.col("x") * F.col("m") - F.col("_less")).alias("rest"), "x", "nx", "blocked", "gaps")
        zero = F.lit(0).cast("long")
        origin = found.select(*texts, "n", "m", zero.alias("rest"), zero.alias("x"), zero.alias("nx"), zero.alias("blocked")).distinct()
        points = pieces.unionByName(origin.withColumn("gaps", F.array().cast(pieces.schema["gaps"].dataType)))
        part = Few(F.floor(F.col("rest") * (F.lit(float(RANK_PARTS)) / (F.col("n") * F.col("m")))).cast("long"))
        found = located(points, found, [*texts, "n", "m"], "rest", part)
        beyond, free, rows = F.col("rest") - F.col("p_rest"), F.col("m") - F.col("p_blocked"), F.col("p_nx")
        found = found.withColumns({"_d": beyond, "_free": free, "_in": beyond < rows * free})
        past = F.col("_d") - rows * F.col("_free")
        found = found.withColumns({"_d": F.when(F.col("_in"), F.col("_d")).otherwise(past), "_wide": F.when(F.col("_in"), F.col("_free")).otherwise(F.col("m"))})
        x = F.col("p_x") + F.when(F.col("_in"), zero).otherwise(rows) + F.expr("_d div _wide")
        skipped = F.aggregate(F.array_sort("p_gaps"), F.expr("_d % _wide"), lambda at, g: at + F.when(at >= g["y"], g["ny"]).otherwise(zero))
        y = F.when(F.col("_in"), skipped).otherwise(F.expr("_d % _wide"))
        found = found.select(*draw, *texts, x.alias("x"), y.alias("y"))
        left = self.members.select("root", "t", F.col("at").alias("x"), F.col("sample_idx").alias("_a"))
        right = self.members.select("root", F.col("t").alias("h"), F.col("at").alias("y"), F.col("sample_idx").alias("_b"))
        both = found.join(left, ["root", "t", "x"]).join(right, ["root", "h", "y"])
        return both.select(*draw, F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"))

    def draw(self, count: int, seed: int, epoch: int) -> DataFrame:
        """``count`` pairs (i, j, same, source) in a seeded choice: distinct ones while there are any, then whole passes again."""
        spark = self.cells.sparkSession
        if count <= 0 or self.total <= 0:
            return spark.createDataFrame([], PAIRS)
        pairs = self.at(drawn_ranks(spark, self.total, count, seed, epoch))
        return pairs.select("i", "j", F.lit(False).alias("same"), F.lit("ocr").alias("source"))


def _text_of_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The later text of each rank in a cell, and the rank among the pairs of members of both texts."""
    for frame in batches:
        later, members, rest = [], [], []
        for bitmap, own, sizes, first, holes, left in zip(frame["bitmap"], frame["n"], frame["sizes"], frame["first"], frame["holes"], frame["_left"]):
            sizes = np.asarray(sizes, np.int64)
            count = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(sizes)).astype(np.int64) * sizes * own
            for hole in holes if holes is not None else ():
                count[hole["k"]] -= hole["area"]
            until = np.cumsum(count)
            at = int(np.searchsorted(until, left, side="right"))
            later.append(first + at)
            members.append(sizes[at])
            rest.append(left - (until[at] - count[at]))
        yield pd.DataFrame({"pass": frame["pass"], "rank": frame["rank"], "root": frame["root"], "t": frame["t"], "h": later, "n": frame["n"], "m": members, "rest": rest})


def _cells(texts: DataFrame, blocks: DataFrame, maximum: float) -> DataFrame:
    """``root, t, block, n, bitmap, pairs`` of each text and block of later texts: which texts are unlike, before neighbours are taken out."""
    spans = blocks.groupBy("root").agg(F.max("block").alias("_top"))
    every = texts.join(spans, "root")
    fields = ["root", "block", "t", "k", "n", "home", "norm_text"]
    left = every.withColumn("_other", F.explode(F.sequence("block", "_top"))).select(*fields, "_other")
    right = every.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), "block"))).select(
        F.col("root").alias("root"), F.col("_other").alias("block"), F.col("block").alias("_other"), *(F.col(c).alias(c) for c in fields[2:])
    )

    def compare(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or others.empty:
            return pd.DataFrame({"root": [], "t": [], "block": [], "n": [], "bitmap": [], "pairs": []})
        others = others.sort_values("k")
        wanted = rows["t"].to_numpy()[:, None] < others["t"].to_numpy()[None]
        # Texts that only ever show in one and the same segment make no pair.
        mine, theirs = (s["home"].to_numpy(dtype=object) for s in (rows, others))
        wanted &= ~((mine[:, None] == theirs[None]) & pd.notna(mine)[:, None])
        hit = unlike(rows["norm_text"].tolist(), others["norm_text"].tolist(), maximum, wanted)
        pairs = rows["n"].to_numpy() * (hit @ others["n"].to_numpy())
        some = np.flatnonzero(pairs)
        bitmaps = [b.tobytes() for b in np.packbits(hit[some], axis=1)]
        return pd.DataFrame({"root": rows["root"].to_numpy()[some], "t": rows["t"].to_numpy()[some], "block": others["_other"].iloc[0], "n": rows["n"].to_numpy()[some], "bitmap": bitmaps, "pairs": pairs[some]})

    key = ["root", "block", "_other"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "root string, t long, block long, n long, bitmap binary, pairs long")


def _pieces(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """``root, t, h, x, nx, blocked, gaps``: a run of members of one text, in one segment and video, and the members of a later text that
    it may not meet, which share its segment or are of a neighbour in its video: how many, and from where on."""
    whole = runs.groupBy("root", "t", "segment_id", "home").agg(F.min("x").alias("x"), F.sum("nx").alias("nx"))
    own = lambda df, *keys: df.select("root", "t", "x", "nx", "home", *keys)
    other = lambda df, *keys: df.select("root", F.col("t").alias("h"), F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("home").alias("_home"), *keys)
    # Texts that only show in one and the same segment were told apart before.
    inside = own(runs, "segment_id").join(other(whole, "segment_id"), ["root", "segment_id"])
    inside = inside.where((F.col("t") < F.col("h")) & ~F.coalesce(F.col("home") == F.col("_home"), F.lit(False)))
    edges = adjacency_edges(samples)
    timed = runs.where("video_id is not null")
    key = ["root", "video_id", "segment_id"]
    beside = own(timed, *key[1:]).join(edges, key).drop("segment_id").withColumnRenamed("neighbour", "segment_id")
    beside = beside.join(other(timed, *key[1:]), key).where("t < h")
    columns = ["root", "t", "h", "x", "nx", "y", "ny"]
    every = inside.select(*columns).unionByName(beside.select(*columns))
    return every.groupBy(*columns[:5]).agg(F.sum("ny").alias("blocked"), F.collect_list(F.struct("y", "ny")).alias("gaps"))


def text_negatives(comparable: DataFrame, samples: DataFrame, maximum: float) -> TextNegatives:
    """The pool of ``comparable`` (root, sample_idx, segment_id, norm_text, and video_id where the frame is known), counted exactly.

    Texts are compared block by block; what is kept of a block pair is a bitmap for each text. Members of a text
    lie in the order of their segments and videos, so that what two texts may not pair are rectangles.
    """
    groups = comparable.groupBy("root", "norm_text").agg(
        F.min("sample_idx").alias("_first"), F.count(F.lit(1)).alias("n"),
        F.when(F.min("segment_id") == F.max("segment_id"), F.min("segment_id")).alias("home"),
    )
    numbered = running_sums(
        groups, ["_first", "norm_text"], {"t": F.lit(1).cast("long"), "_letters": F.length("norm_text").cast("long")}, ["root"], index_block(F.col("_first")),
    )
    block = (F.floor(F.col("t") / BLOCK_TEXTS) + F.floor(F.col("_letters") / BLOCK_LETTERS)).cast("long")
    numbered = checkpointed(numbered.withColumn("block", block).drop("_first", "_letters"))
    blocks = numbered.groupBy("root", "block").agg(
        F.min("t").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda s: s["n"]).alias("sizes"),
    )
    # Numbers of blocks may leave gaps; those that are there are numbered anew, a row per block and root.
    blocks = blocks.withColumn("_block", (F.row_number().over(W.partitionBy("root").orderBy("block")) - 1).cast("long"))
    texts = numbered.join(blocks.select("root", "block", "_block", "first"), ["root", "block"])
    texts = checkpointed(texts.select("root", "norm_text", "t", "n", "home", F.col("_block").alias("block"), (F.col("t") - F.col("first")).cast("int").alias("k")))
    blocks = checkpointed(blocks.select("root", F.col("_block").alias("block"), "first", "sizes"))
    cells = checkpointed(_cells(texts, blocks, maximum))

    placed = comparable.join(texts.select("root", "norm_text", "t", "n", "home"), ["root", "norm_text"]).drop("norm_text")
    runs = placed.groupBy("root", "t", "home", "segment_id", "video_id").agg(F.count(F.lit(1)).alias("nx"))
    # The runs of a text, (segment, video) pairs, in the order of the segment's hash: a text that is everywhere is cut into blocks.
    runs = runs.withColumn("_h", F.xxhash64("segment_id"))
    order = ["_h", "segment_id", F.asc_nulls_first("video_id")]
    runs = checkpointed(running_sums(runs, order, {"x": F.col("nx")}, ["root", "t", "home"], hash_block(F.col("_h"))).drop("_h"))
    own = running_sums(
        placed.select("root", "t", "segment_id", "video_id", "sample_idx"), ["sample_idx"], {"_in": F.lit(1).cast("long")},
        ["root", "t", "segment_id", "video_id"], dense_block(F.col("sample_idx")),
    )
    run = runs.select("root", "t", F.col("segment_id").alias("_s"), F.col("video_id").alias("_v"), "x").alias("run")
    same = (own["root"] == F.col("run.root")) & (own["t"] == F.col("run.t")) & (own["segment_id"] == F.col("_s")) & own["video_id"].eqNullSafe(F.col("_v"))
    members = own.join(run, same).select(own["root"], own["t"], (F.col("x") + F.col("_in")).alias("at"), "sample_idx")

    # Pieces only count where the bitmap has the pair.
    pieces = _pieces(runs, samples).join(texts.select("root", F.col("t").alias("h"), "block", "k"), ["root", "h"])
    pieces = pieces.join(cells.select("root", "t", "block", "bitmap"), ["root", "t", "block"])
    octet = F.conv(F.hex(F.expr("substring(bitmap, k div 8 + 1, 1)")), 16, 10).cast("int")
    bit = F.element_at(F.array(*(F.lit(1 << (7 - k)) for k in range(8))), F.expr("k % 8 + 1"))
    pieces = checkpointed(pieces.where(octet.bitwiseAND(bit) != 0).drop("bitmap"))
    areas = pieces.groupBy("root", "t", "block", "k").agg(F.sum(F.col("nx") * F.col("blocked")).alias("area"))
    holes = areas.groupBy("root", "t", "block").agg(F.collect_list(F.struct("k", "area")).alias("holes"), F.sum("area").alias("_less"))
    holes = checkpointed(holes)
    counted = cells.join(holes.select("root", "t", "block", "_less"), ["root", "t", "block"], "left")
    counted = counted.withColumn("pairs", (F.col("pairs") - F.coalesce("_less", F.lit(0))).cast("long")).drop("_less").where("pairs > 0")
    # Running sums inside each root, and over the roots in the order of a hash.
    inside = running_sums(counted, ["t", "block"], {"_inside": F.col("pairs")}, ["root"], Few(F.shiftright("t", 8)))
    roots = counted.groupBy("root").agg(F.sum("pairs").alias("_all")).withColumn("_h", F.xxhash64("root"))
    roots = running_sums(roots, ["_h", "root"], {"_before": F.col("_all")}, (), hash_block(F.col("_h"))).select("root", "_before")
    cells = checkpointed(inside.join(roots, "root").withColumn("start", (F.col("_before") + F.col("_inside")).cast("long")).drop("_before", "_inside"))
    total = int(cells.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])
    return TextNegatives(total, cells, blocks, pieces.drop("block", "k"), holes.drop("_less"), checkpointed(members))

