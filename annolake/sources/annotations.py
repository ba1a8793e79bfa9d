"""JSONL annotations, review documents and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions.geometry import parse_video_frame
from annolake.functions.text import first_text
from annolake.sources.lines import read_lines, root_of, stem, strip

_NESTED = "struct<video_id:string,sequence_id:string,source_video:string,frame_index:string>"
ANNOTATION = (
    "image string, source_image string, source_sample_id string, video_id string, sequence_id string, source_video string,"
    f" frame_index string, source_annotation {_NESTED}, image_width long, image_height long, roi_size array<long>,"
    " roi_offset array<long>, filter_region array<long>, source_roi array<long>, source_subtitle_boxes array<array<long>>,"
    " detections array<struct<polygon:array<array<double>>,score:double>>, has_subtitle boolean, segment_marker string,"
    " ocr_text string, ocr_text_normalized string, omlx_text string, omlx_text_normalized string"
)
REVIEW = "version int, items map<string,struct<has_subtitle:boolean,segment_id:string,note:string,updated_at:long>>"


def parse_annotations(lines: DataFrame) -> DataFrame:
    """Lines (root, line_index, value) to typed rows; blank lines are skipped, ids count the kept ones."""
    from annolake.operators.ordered import dense_block, with_rank

    kept = lines.filter(strip("value") != "")
    numbered = with_rank(kept, ["line_index"], dense_block(F.col("line_index")), ["root"], "item_index")
    rows = numbered.select("root", "line_index", "item_index", F.from_json("value", ANNOTATION).alias("a")).select(
        "root", "line_index", "item_index", "a.*"
    )
    fallback = F.format_string("sample_%06d", "item_index")
    sample_id = F.coalesce(F.nullif(stem(F.coalesce("image", F.lit(""))), F.lit("")), fallback)
    return rows.withColumn("sample_id", sample_id)


def read_annotations(spark: SparkSession, roots: list[str], name: str = "annotations.jsonl") -> DataFrame:
    lines = read_lines(spark, [f"{r.rstrip('/')}/{name}" for r in roots])
    return parse_annotations(lines.withColumn("root", root_of(F.col("path"))).drop("path"))


def last_per_stem(annotations: DataFrame) -> DataFrame:
    """Keyed by image stem; the last line wins, rows without an image name are left out."""
    named = annotations.withColumn("stem", stem(F.coalesce("image", F.lit("")))).filter("stem <> ''")
    rest = [c for c in annotations.columns if c != "root"]
    return named.groupBy("root", "stem").agg(F.max_by(F.struct(*rest), "line_index").alias("a")).select("root", "stem", "a.*")


def review_item_id() -> Column:
    """Review id: the source sample id when given, else the image stem."""
    given = F.nullif(strip(F.coalesce("source_sample_id", F.lit(""))), F.lit(""))
    named = F.nullif(stem(F.coalesce("image", F.lit(""))), F.lit(""))
    return F.coalesce(given, named, F.concat(F.lit("sample_"), F.col("line_index")))


def _present(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def resolve_video_id(sample_id: str = "sample_id") -> Column:
    """First non-blank of the item's and the nested source's names, else from the sample id."""
    names = ("video_id", "sequence_id", "source_video")
    own = [_present(F.col(n)) for n in names]
    nested = [_present(F.col("source_annotation")[n]) for n in names]
    return F.coalesce(*own, *nested, parse_video_frame(sample_id)["video_id"])


def _frame(value: Column) -> Column:
    """Integer text only; booleans and blanks are rejected."""
    return F.when(~F.lower(value).isin("true", "false"), strip(value).try_cast("long"))


def resolve_frame_index(sample_id: str = "sample_id") -> Column:
    own = _frame(F.col("frame_index").cast("string"))
    nested = _frame(F.col("source_annotation")["frame_index"])
    return F.coalesce(own, nested, parse_video_frame(sample_id)["frame_index"])


def item_text() -> Column:
    return first_text(F.col("ocr_text_normalized"), F.col("omlx_text_normalized"), F.col("ocr_text"), F.col("omlx_text"))


def annotation_text() -> Column:
    return first_text(F.col("ocr_text_normalized"), F.col("ocr_text"))


def parse_review(documents: DataFrame) -> DataFrame:
    """Review documents (root, value) to one row per decided sample; any version but 2 is an error."""
    parsed = documents.select("root", F.from_json("value", REVIEW).alias("d"))
    right = F.coalesce(F.col("d.version"), F.lit(-1)) == 2
    items = F.when(right, F.col("d.items")).otherwise(
        F.raise_error(F.lit("review document is not version 2")).cast(
            "map<string,struct<has_subtitle:boolean,segment_id:string,note:string,updated_at:bigint>>"
        )
    )
    rows = parsed.select("root", F.explode(items).alias("sample_id", "r"))
    return rows.select("root", "sample_id", "r.*")


def _read_documents(spark: SparkSession, roots: list[str], name: str) -> DataFrame:
    """One row per existing document; roots without one give none."""
    paths = [r.rstrip("/") for r in roots]
    found = spark.read.option("pathGlobFilter", name).option("wholetext", True).text(paths)
    return found.select(root_of(F.col("_metadata.file_path")).alias("root"), "value")


def read_review(spark: SparkSession, roots: list[str], name: str = "segment_review.json") -> DataFrame:
    return parse_review(_read_documents(spark, roots, name))


def parse_summary(documents: DataFrame) -> DataFrame:
    """Summaries (root, value); ``is_roi`` tells whether the ROI size is usable."""
    parsed = documents.select(
        "root", F.from_json("value", "version int, roi_size array<long>, samples long, positive long, empty long").alias("s")
    ).select("root", "s.*")
    is_roi = F.coalesce(F.size("roi_size") == 2, F.lit(False))
    return parsed.withColumn("is_roi", is_roi).withColumn("roi_width", F.get("roi_size", F.lit(0))).withColumn(
        "roi_height", F.get("roi_size", F.lit(1))
    ).drop("roi_size")


def read_summary(spark: SparkSession, roots: list[str], name: str = "summary.json") -> DataFrame:
    return parse_summary(_read_documents(spark, roots, name))


def require_roi_size(summaries: DataFrame) -> DataFrame:
    error = F.raise_error(F.concat(F.lit("summary without a usable roi_size: "), F.col("root"))).cast("boolean")
    return summaries.filter(F.when(F.col("is_roi"), F.lit(True)).otherwise(error))


def read_roi_samples(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Annotations with review decisions, video, frame and text resolved."""
    from annolake.operators.overlay import apply_review

    rows = read_annotations(spark, roots)
    typed = rows.select(
        "root", "sample_id", F.col("item_index").alias("sample_idx"), "image", "source_image", "roi_size", "has_subtitle",
        "segment_marker", resolve_video_id().alias("video_id"), resolve_frame_index().alias("frame_index"),
        annotation_text().alias("ocr_text"),
    )
    return apply_review(typed, read_review(spark, roots))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Earlier score rows: sample_key and score."""
    return spark.read.schema("sample_key string, root string, sample_id string, score double").json(path)
