"""Registry of driver queries and the tables they read."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.operators.ordered import Few, with_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the view macros below as ``{frames}``."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = _with_views(sql)
        return fn

    return register


class Tables:
    """The driver tables seen through the engine's schemas."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def frames(self) -> DataFrame:
        c = F.col
        return self.table("conversations").select(
            F.concat(F.lit("r"), c("conv_id") % 4).alias("root"),
            c("conv_id").cast("string").alias("video_id"),
            c("turn").alias("frame_index"),
            (c("conv_id") * 1_048_576 + c("turn")).alias("sample_idx"),
            F.concat(F.lit("v"), c("conv_id"), F.lit("_f"), F.lpad(c("turn").cast("string"), 8, "0")).alias("sample_id"),
            (c("role") != "system").alias("has_subtitle"),
            F.concat(F.lit("v"), c("conv_id"), F.lit("_s"), F.floor(c("turn") / 2)).alias("segment_id"),
            c("text").alias("ocr_text"),
        )

    @cached_property
    def boxes(self) -> DataFrame:
        c = F.col
        order = [
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        ]
        line = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)) - 1
        # Numbered first and derived from after: only the table's own columns are moved, the same ones for every reader of the boxes.
        numbered = self.table("lineitem").select("l_orderkey", *order, line.cast("long").alias("line_index"))
        return numbered.select(
            F.concat(F.lit("r"), c("l_orderkey") % 4).alias("root"),
            c("l_orderkey").alias("image_id"),
            F.lit(1280).alias("width"),
            F.lit(720).alias("height"),
            "line_index",
            ((c("l_partkey") * 7919 % 1000).cast("double") / 1000).alias("cx"),
            (((c("l_suppkey") * 31 + c("l_partkey")) % 100).cast("double") / 100).alias("cy"),
            (c("l_quantity") / 100).alias("w"),
            ((1 + c("l_linenumber")).cast("double") / 40).alias("h"),
            F.when(c("l_returnflag") != "A", 1 - 5 * c("l_discount")).alias("score"),
            (200 * c("l_tax")).alias("jitter_px"),
            c("l_linestatus").alias("status"),
        )

    @cached_property
    def flat_boxes(self) -> DataFrame:
        """Boxes without ``line_index``: no window, so column expressions stay one narrow scan."""
        c = F.col
        return self.table("lineitem").select(
            F.concat(F.lit("r"), c("l_orderkey") % 4).alias("root"),
            c("l_orderkey").alias("image_id"),
            F.lit(1280).alias("width"),
            F.lit(720).alias("height"),
            ((c("l_partkey") * 7919 % 1000).cast("double") / 1000).alias("cx"),
            (((c("l_suppkey") * 31 + c("l_partkey")) % 100).cast("double") / 100).alias("cy"),
            (c("l_quantity") / 100).alias("w"),
            ((1 + c("l_linenumber")).cast("double") / 40).alias("h"),
            F.when(c("l_returnflag") != "A", 1 - 5 * c("l_discount")).alias("score"),
            (200 * c("l_tax")).alias("jitter_px"),
            c("l_linestatus").alias("status"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        c = F.col
        text = F.when(c("doc_id") % 5 < 3, c("lang")).otherwise(c("source"))
        unit = lambda v: (v.cast("double") * 2 + 1) / F.lit(1994.0)
        joined = self.table("documents").join(self.table("labels"), "doc_id")
        return joined.select(
            c("source").alias("root"),
            c("doc_id").alias("sample_id"),
            F.concat(c("lang"), F.lit("-"), c("doc_id") % 50).alias("segment_id"),
            c("lang").alias("sample_type"),
            (c("quality") == 1).alias("target"),
            (c("toxic") == 1).alias("has_candidate"),
            unit(c("n_chars") % 997).alias("score"),
            unit((c("n_chars") * 7) % 997).alias("prev_score"),
            F.regexp_replace(F.lower(text), "[^a-z0-9]", "").alias("norm_text"),
        )

    @cached_property
    def line_scores(self) -> DataFrame:
        """``scores`` by line of the whole text: each line is a sample of its document with a text of its own."""
        c = F.col
        unit = lambda v: (v.cast("double") * 2 + 1) / F.lit(1994.0)
        lines = self.table("documents").join(self.table("labels"), "doc_id").select("*", F.posexplode(F.split("text", "\n", -1)).alias("line", "own"))
        return lines.select(
            c("source").alias("root"),
            c("doc_id"),
            F.concat(c("doc_id").cast("string"), F.lit("_l"), c("line")).alias("sample_id"),
            (c("quality") == 1).alias("target"),
            unit((c("n_chars") + c("line") * 31) % 997).alias("score"),
            unit((c("n_chars") * 7 + c("line") * 17) % 997).alias("prev_score"),
            F.regexp_replace(F.lower("own"), "[^a-z0-9]", "").alias("norm_text"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Neighbouring vectors as labelled pairs: one equi-join per distance, no cross product."""
        e = self.table("embeddings").select("vec_id", "embedding", "label")
        left = e.select(
            F.col("vec_id").alias("left_id"), F.col("embedding").alias("left_vector"), F.col("label").alias("left_label"),
            F.explode(F.sequence(F.lit(1), F.lit(20))).alias("distance"),
        ).withColumn("right_id", F.col("left_id") + F.col("distance"))
        right = e.select(
            F.col("vec_id").alias("right_id"), F.col("embedding").alias("right_vector"), F.col("label").alias("right_label")
        )
        return left.join(right, "right_id").select(
            "left_id", "right_id", "left_vector", "right_vector",
            (F.col("left_label") == F.col("right_label")).alias("same"),
            F.when(F.col("distance") <= 5, "local").otherwise("ocr").alias("source"),
        )

    @cached_property
    def frame_events(self) -> DataFrame:
        c = F.col
        day = F.floor(F.unix_seconds(c("ts").cast("timestamp")) / 86_400)
        ranked = with_rank(self.table("events"), ["ts", "event_id"], Few(day), ["user_id"], "at")
        return ranked.select(
            F.concat(F.lit("u"), c("user_id") % 4).alias("root"),
            c("user_id").cast("string").alias("video_id"),
            (c("at") + 1).alias("frame_index"),
            c("event_id").alias("sample_idx"),
            c("event_id").cast("string").alias("sample_id"),
            c("event_type").alias("segment_id"),
            (c("event_type") != "error").alias("has_subtitle"),
            c("ts"),
        )


VIEWS = {
    "frames": """frames as (select 'r' || (conv_id % 4) as root, cast(conv_id as varchar) as video_id,
 turn as frame_index, conv_id * 1048576 + turn as sample_idx,
 'v' || conv_id || '_f' || lpad(cast(turn as varchar), 8, '0') as sample_id, role <> 'system' as has_subtitle,
 'v' || conv_id || '_s' || (turn // 2) as segment_id, text as ocr_text from conversations)""",
    "boxes": """boxes as (select 'r' || (l_orderkey % 4) as root, l_orderkey as image_id, 1280 as width, 720 as height,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
 l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) - 1 as line_index,
 cast(l_partkey * 7919 % 1000 as double) / 1000 as cx, cast((l_suppkey * 31 + l_partkey) % 100 as double) / 100 as cy, l_quantity / 100 as w,
 cast(1 + l_linenumber as double) / 40 as h,
 case when l_returnflag <> 'A' then 1 - 5 * l_discount end as score, 200 * l_tax as jitter_px, l_linestatus as status
 from lineitem)""",
    "corners": """corners as (select *, least(greatest(cx * width - w * width / 2, 0), width) as x1,
 least(greatest(cy * height - h * height / 2, 0), height) as y1,
 least(greatest(cx * width + w * width / 2, 0), width) as x2,
 least(greatest(cy * height + h * height / 2, 0), height) as y2 from boxes)""",
    "rects": """rects as (select *, [[2:cx * width - w * width / 2]] as x,
 [[2:cy * height - h * height / 2]] as y, [[2:w * width]] as rw, [[2:h * height]] as rh,
 [[2:cy * height - h * height / 2 + h * height / 2]] as center_y,
 [[2:(w * width) * (h * height)]] as area from boxes)""",
    "pixels": """pixels as (select *, cast(px1 as bigint) as ix1, cast(py1 as bigint) as iy1,
 cast(greatest(px1, least(width, round_even(x + rw, 0))) as bigint) as ix2,
 cast(greatest(py1, least(height, round_even(y + rh, 0))) as bigint) as iy2 from (select *,
 least(greatest(round_even(x, 0), 0), width) as px1, least(greatest(round_even(y, 0), 0), height) as py1 from rects) q)""",
    "scores": """scores as (select source as root, d.doc_id as sample_id, lang || '-' || (d.doc_id % 50) as segment_id,
 lang as sample_type, quality = 1 as target, toxic = 1 as has_candidate,
 (cast(n_chars % 997 as double) * 2 + 1) / cast(1994 as double) as score,
 (cast((n_chars * 7) % 997 as double) * 2 + 1) / cast(1994 as double) as prev_score,
 regexp_replace(lower(case when d.doc_id % 5 < 3 then lang else source end), '[^a-z0-9]', '', 'g') as norm_text
 from documents d join labels l on d.doc_id = l.doc_id)""",
    "line_scores": """line_scores as (select source as root, doc_id, doc_id || '_l' || line as sample_id, quality = 1 as target,
 (cast((n_chars + line * 31) % 997 as double) * 2 + 1) / cast(1994 as double) as score,
 (cast((n_chars * 7 + line * 17) % 997 as double) * 2 + 1) / cast(1994 as double) as prev_score,
 regexp_replace(lower(own), '[^a-z0-9]', '', 'g') as norm_text from (select d.*, quality, unnest(string_split(text, chr(10))) as own,
 generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents d join labels l on d.doc_id = l.doc_id) q)""",
    "pairs": """pairs as (select a.vec_id as left_id, b.vec_id as right_id, a.embedding as left_vector,
 b.embedding as right_vector, a.label = b.label as same,
 case when b.vec_id - a.vec_id <= 5 then 'local' else 'ocr' end as source
 from embeddings a join embeddings b on b.vec_id > a.vec_id and b.vec_id - a.vec_id <= 20)""",
    "pair_scores": """pair_scores as (select left_id, right_id, same, source, round(list_dot_product(
 cast(left_vector as double[]), cast(right_vector as double[])), 6) as score from pairs)""",
    "frame_events": """frame_events as (select 'u' || (user_id % 4) as root, cast(user_id as varchar) as video_id,
 row_number() over (partition by user_id order by ts, event_id) as frame_index, event_id as sample_idx,
 cast(event_id as varchar) as sample_id, event_type as segment_id, event_type <> 'error' as has_subtitle, ts
 from events)""",
}


def _with_views(sql: str) -> str:
    """``{name}`` expands to a view body, ``[[n:expr]]`` to exact half-even rounding at n decimals."""
    for name, body in VIEWS.items():
        sql = sql.replace("{" + name + "}", body)
    return re.sub(r"\[\[(\d):(.*?)\]\]", r"(cast(format('{:.\1f}', cast(\2 as double)) as double) + 0e0)", sql)
