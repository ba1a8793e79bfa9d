"""Label text files, label masks and the VIA format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions.geometry import bound, rect_to_yolo, yolo_to_box, yolo_to_rect
from annolake.operators.filters import usable_box
from annolake.operators.ordered import dense_block, with_rank
from annolake.sources.lines import read_lines, root_of, stem, strip

_RECORD = (
    "struct<masked:boolean,deleted:boolean,unreliable:boolean,exclude_from_loss:boolean,drop_image:boolean,"
    "ignore_region:array<double>,add_bbox:array<double>,bbox:array<double>,reason:string,updated_at:long>"
)
MASKS = f"version int, items map<string,map<string,{_RECORD}>>"
VIA_ITEM = (
    "struct<filename:string,size:long,regions:array<struct<shape_attributes:struct<name:string,x:double,y:double,"
    "width:double,height:double>,region_attributes:struct<class:string>>>,file_attributes:struct<width:long,height:long>>"
)
CLASS_NAME = "subtitle"  # fixed value


def read_label_lines(spark: SparkSession, roots: list[str]) -> DataFrame:
    """root, sample_id, line_index and text of every label line."""
    lines = read_lines(spark, [f"{r.rstrip('/')}/labels" for r in roots], "*.txt")
    return lines.select(root_of(F.col("path"), 2).alias("root"), stem(F.col("path")).alias("sample_id"), "line_index", "value")


def parse_labels_lenient(lines: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Usable boxes with both indexes: the physical line and the place among usable boxes. Bad lines are skipped."""
    tokens = F.split(strip("value"), r"\s+")
    numbers = bound(tokens, lambda t: F.when(F.size(t) == 5, F.transform(t, lambda v: v.try_cast("double"))))
    rows = lines.select(*by, "line_index", numbers.alias("_v")).filter(F.col("_v").isNotNull() & ~F.exists("_v", lambda v: v.isNull()))
    box = yolo_to_box(*[F.col("_v")[i] for i in range(1, 5)], "width", "height")
    usable = rows.join(sizes, by).select(*by, "line_index", box.alias("box")).filter(usable_box(F.col("box")))
    return with_rank(usable, ["line_index"], dense_block(F.col("line_index"), 4096), by, "valid_index")


def parse_labels_strict(lines: DataFrame, by: list[str]) -> DataFrame:
    """Typed label lines; comments and blanks are skipped, a wrong number of fields is an error."""
    rows = lines.withColumn("raw", strip("value")).filter((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    tokens = F.split(F.regexp_replace("raw", r"\s+", " "), " ")
    bad = F.raise_error(F.concat(F.lit("label line needs five fields: "), F.col("raw"))).cast("array<string>")
    rows = rows.withColumn("_t", F.when(F.size(tokens) == 5, tokens).otherwise(bad))
    parts = [F.get("_t", F.lit(i)) for i in range(5)]
    return rows.select(
        *by, "line_index", parts[0].alias("class_id"),
        *[p.cast("double").alias(n) for p, n in zip(parts[1:], ("cx", "cy", "w", "h"))], "raw",
    )


def rejected_labels(lines: DataFrame) -> DataFrame:
    """Lines that the strict reader would refuse."""
    raw = strip("value")
    count = F.size(F.split(F.regexp_replace(raw, r"\s+", " "), " "))
    return lines.filter((raw != "") & ~raw.startswith("#") & (count != 5))


def parse_label_masks(documents: DataFrame) -> DataFrame:
    """Mask documents (root, value) to records in document order."""
    parsed = documents.select("root", F.from_json("value", MASKS).alias("d"))
    stems = parsed.select("root", F.explode("d.items").alias("sample_id", "records"))
    keys = stems.select("root", "sample_id", F.posexplode(F.map_entries("records")).alias("record_order", "e"))
    return keys.select("root", "sample_id", "record_order", F.col("e.key").alias("key"), "e.value.*").fillna({"drop_image": False})


def read_label_masks(spark: SparkSession, roots: list[str], name: str = "label_masks.json") -> DataFrame:
    from annolake.sources.annotations import _read_documents

    return parse_label_masks(_read_documents(spark, roots, name))


def labels_to_via(files: DataFrame, labels: DataFrame) -> DataFrame:
    """One VIA entry (entry_key, item) per label file. ``files``: sample_id, filename, size, width, height."""
    rect = yolo_to_rect("cx", "cy", "w", "h", "width", "height")
    region = F.struct(
        F.struct(F.lit("rect").alias("name"), rect["x"].alias("x"), rect["y"].alias("y"), rect["width"].alias("width"),
                 rect["height"].alias("height")).alias("shape_attributes"),
        F.struct(F.lit(CLASS_NAME).alias("class")).alias("region_attributes"),
    )
    sized = labels.join(files.select("sample_id", "width", "height"), "sample_id").select(
        "sample_id", F.struct("line_index", region.alias("r")).alias("e")
    )
    regions = sized.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["r"]).alias("regions"))
    empty = F.array().cast(
        "array<struct<shape_attributes:struct<name:string,x:bigint,y:bigint,width:bigint,height:bigint>,region_attributes:struct<class:string>>>"
    )
    item = F.struct("filename", "size", F.coalesce("regions", empty).alias("regions"), F.struct("width", "height").alias("file_attributes"))
    return files.join(regions, "sample_id", "left").select(
        F.concat("filename", F.col("size").cast("string")).alias("entry_key"), F.to_json(item).alias("item")
    )


def via_entries(documents: DataFrame) -> DataFrame:
    """VIA documents (value) to entries."""
    parsed = documents.select(F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select(F.explode("m").alias("entry_key", "item"))


def via_to_labels(entries: DataFrame) -> DataFrame:
    """Label lines of VIA entries: sample_id, line_index, line; null line for a file without rectangles.

    Shapes other than rectangles are skipped; a missing size is an error.
    """
    item = entries.select(F.from_json("item", VIA_ITEM).alias("v")).select("v.*")
    w, h = (F.coalesce(F.col(f"file_attributes.{n}"), F.lit(0)) for n in ("width", "height"))
    error = F.raise_error(F.concat(F.lit("no image size for "), F.col("filename"))).cast("boolean")
    sized = item.select("filename", "regions", w.alias("width"), h.alias("height")).filter(
        F.when((F.col("width") > 0) & (F.col("height") > 0), F.lit(True)).otherwise(error)
    )
    shapes = F.filter(F.transform(F.coalesce("regions", F.array()), lambda r: r["shape_attributes"]), lambda s: s["name"] == "rect")
    rows = sized.select(stem(F.col("filename")).alias("sample_id"), "width", "height", F.posexplode_outer(shapes).alias("line_index", "s"))
    line = rect_to_yolo(F.col("s.x"), F.col("s.y"), F.col("s.width"), F.col("s.height"), "width", "height")
    return rows.select("sample_id", "line_index", F.when(F.col("s").isNotNull(), line).alias("line"))


def via_document(entries: DataFrame, path: str) -> None:
    """Write entries as JSON lines of one-entry maps; together they form the VIA map."""
    entries.select(F.to_json(F.create_map("entry_key", "item")).alias("value")).write.text(path)
