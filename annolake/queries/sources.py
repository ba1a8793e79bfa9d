"""File-format operators, run on text that Spark derives from the tables."""

import uuid

from pyspark.sql import functions as F

from annolake.functions import geometry as g
from annolake.queries.registry import query
from annolake.session import shared_folder
from annolake.sources import annotations as an
from annolake.sources import images as im
from annolake.sources import labels as lb
from annolake.sources import sinks
from annolake.sources import texts as tt

BOX = ("cx", "cy", "w", "h", "width", "height")


def _jsonl(t):
    """Frames as annotation lines; every seventh line is blank and some rows lack an image or a frame."""
    body = F.to_json(F.struct(
        F.when(F.col("frame_index") != 5, F.concat(F.lit("images/"), "sample_id", F.lit(".jpg"))).alias("image"),
        F.struct(F.when(F.col("frame_index") % 2 == 0, F.col("video_id")).alias("source_video"), F.when(F.col("frame_index") % 3 == 0, F.col("frame_index")).alias("frame_index")).alias("source_annotation"),
        F.when(F.col("frame_index") == 1, F.concat(F.lit("  seq"), "video_id", F.lit(" "))).alias("sequence_id"),
        "has_subtitle", F.col("segment_id").alias("segment_marker"), "ocr_text",
        F.when(F.col("frame_index") == 2, F.lit("")).alias("ocr_text_normalized"), F.array(F.lit(256), F.lit(32)).alias("roi_size"),
    ))
    value = F.when(F.col("frame_index") == 6, F.lit("  ")).otherwise(body)
    return t.frames.select("root", F.col("sample_idx").alias("line_index"), value.alias("value"))


_LINES = """numbered as (select *, row_number() over (partition by root order by sample_idx) - 1 as item_index from frames where frame_index <> 6),
 parsed as (select *, case when frame_index <> 5 then sample_id else 'sample_' || lpad(item_index::varchar, 6, '0') end as sid from numbered)"""


@query("parse_annotations", "IO-01", "with {frames}, " + _LINES + " select root, sample_idx as line_index, item_index, sid as sample_id, has_subtitle, segment_id as segment_marker, ocr_text as text from parsed")
def _(t):
    rows = an.parse_annotations(_jsonl(t))
    return rows.select("root", "line_index", "item_index", "sample_id", "has_subtitle", "segment_marker", an.annotation_text().alias("text"))


@query("last_annotation_per_stem", "IO-01", """with {frames} select root, segment_id as stem, max(sample_idx) as line_index, count(*) > 0 as found from frames group by all""")
def _(t):
    lines = t.frames.select("root", F.col("sample_idx").alias("line_index"), F.to_json(F.struct(F.concat("segment_id", F.lit(".png")).alias("image"))).alias("value"))
    return an.last_per_stem(an.parse_annotations(lines)).select("root", "stem", "line_index", F.lit(True).alias("found"))


@query("resolve_video_and_frame", "PJ-18", "with {frames}, " + _LINES + """ select sid as sample_id, case when frame_index = 1 then 'seq' || video_id when frame_index % 2 = 0 then video_id
 when frame_index = 5 then null else 'v' || video_id end as video, case when frame_index % 3 = 0 then frame_index when frame_index = 5 then null else frame_index end as frame
 from parsed""")
def _(t):
    rows = an.parse_annotations(_jsonl(t))
    return rows.select("sample_id", an.resolve_video_id().alias("video"), an.resolve_frame_index().alias("frame"))


def _label_lines(t):
    """Boxes as label lines with three decimals; some lines are comments, blank or malformed."""
    body = F.format_string("0 %.3f %.3f %.3f %.3f", "cx", "cy", "w", "h")
    kind = F.col("line_index") % 6
    value = F.when(kind == 4, F.lit("# checked")).when(kind == 5, F.lit("  ")).otherwise(F.concat(body, F.lit(" ")))
    return t.boxes.select("image_id", "line_index", value.alias("value"), "width", "height")


@query("labels_lenient", "IO-02", """with {boxes}, {corners}, k as (select *, row_number() over (partition by image_id order by line_index) - 1 as valid_index
 from corners where line_index % 6 < 4 and x2 - x1 > 0.5 and y2 - y1 > 0.5)
 select image_id, line_index, valid_index, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2 from k""")
def _(t):
    lines = _label_lines(t)
    sizes = lines.select("image_id", "width", "height").distinct()
    out = lb.parse_labels_lenient(lines.select("image_id", "line_index", "value"), sizes, ["image_id"])
    return out.select("image_id", "line_index", "valid_index", *[F.round(F.col("box")[k], 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("labels_strict", "IO-03", """with {boxes} select image_id, line_index, '0' as class_id, round(cx, 3) as cx, round(cy, 3) as cy, round(w, 3) as w, round(h, 3) as h from boxes where line_index % 6 < 4""")
def _(t):
    return lb.parse_labels_strict(_label_lines(t), ["image_id"]).drop("raw")


@query("label_masks_round_trip", "IO-04, IO-17", """with {boxes} select 'p' || (image_id % 1000) as root, image_id::varchar as sample_id, line_index::varchar as key,
 status = 'F' as masked, round(jitter_px, 6) as first_x, jitter_px > 15 as drop_image from boxes""")
def _(t):
    records = t.boxes.select(
        F.concat(F.lit("p"), F.col("image_id") % 1000).alias("root"), F.col("image_id").cast("string").alias("sample_id"),
        F.col("line_index").alias("record_order"), F.col("line_index").cast("string").alias("key"), (F.col("status") == "F").alias("masked"),
        (F.col("jitter_px") > 15).alias("drop_image"), F.array("jitter_px", F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("bbox"))
    back = lb.parse_label_masks(sinks.masks_documents(records))
    return back.select("root", "sample_id", "key", "masked", F.round(F.col("bbox")[0], 6).alias("first_x"), "drop_image")


@query("review_round_trip", "IO-05, IO-17", "with {frames} select 'v' || video_id as root, sample_id, has_subtitle, segment_id, 'n' || frame_index as note from frames")
def _(t):
    review = t.frames.select(
        F.concat(F.lit("v"), "video_id").alias("root"), "sample_id", "has_subtitle", "segment_id", F.concat(F.lit("n"), "frame_index").alias("note"), F.lit(0).cast("long").alias("updated_at"))
    return an.parse_review(sinks.review_documents(review)).drop("updated_at")


@query("parse_summary", "IO-06", """select o_orderkey::varchar as root, o_orderkey % 3 <> 0 as is_roi, case when o_orderkey % 3 <> 0 then 200 + o_custkey % 7 end as roi_width,
 case when o_orderkey % 3 <> 0 then 32 end as roi_height, o_custkey as samples from orders""")
def _(t):
    size = F.when(F.col("o_orderkey") % 3 != 0, F.array((200 + F.col("o_custkey") % 7), F.lit(32).cast("long")))
    docs = t.table("orders").select(
        F.col("o_orderkey").cast("string").alias("root"), F.to_json(F.struct(F.lit(1).alias("version"), size.alias("roi_size"), F.col("o_custkey").alias("samples"))).alias("value"))
    return an.parse_summary(docs).select("root", "is_roi", "roi_width", "roi_height", "samples")


@query("resolve_dimensions", "IO-08", """select 'i' || o_orderkey || '.jpg' as filename, case when o_orderkey % 4 = 0 then 640 when o_orderkey % 4 = 1 then 320 when o_orderkey % 4 = 2 then 200 + o_custkey else 99 end::bigint as width,
 case when o_orderkey % 4 = 0 then 360 when o_orderkey % 4 = 1 then 180 when o_orderkey % 4 = 2 then 100 else 77 end::bigint as height from orders""")
def _(t):
    o = t.table("orders").withColumn("sample_id", F.concat(F.lit("i"), "o_orderkey")).withColumn("filename", F.concat("sample_id", F.lit(".jpg")))
    k = F.col("o_orderkey") % 4
    notes = o.filter(k < 2).select(
        F.when(k == 0, F.concat(F.lit("images/"), "filename")).otherwise(F.concat(F.lit("images/"), "sample_id", F.lit(".png"))).alias("image"), F.col("o_orderkey").alias("line_index"),
        F.when(k == 0, 640).otherwise(320).alias("image_width"), F.when(k == 0, 360).otherwise(180).alias("image_height"))
    headers = o.filter(k == 2).select("filename", (200 + F.col("o_custkey")).alias("width"), F.lit(100).alias("height"))
    return im.resolve_dimensions(o.select("filename", "sample_id"), notes, headers, (99, 77)).drop("sample_id")


@query("read_subtitles", "IO-09", """with b as (select doc_id, unnest(regexp_split_to_array(text, '\n\\s*\n')) as block from documents),
 k as (select doc_id, [trim(l, ' \t\r\f\v') for l in string_split(block, '\n')] as ls from b),
 c as (select doc_id, array_to_string([l for l in ls if l <> '' and not regexp_full_match(l, '[0-9]+') and not contains(l, '-->')], '\n') as cue from k)
 select doc_id::varchar || '.srt' as path, count(*) as cues, sum(length(cue))::bigint as chars from c where cue <> '' group by doc_id""")
def _(t):
    files = t.table("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".srt")).alias("path"), "text")
    return tt.read_subtitles(files).groupBy("path").agg(F.count(F.lit(1)).alias("cues"), F.sum(F.length("subtitle")).alias("chars"))


@query("via_round_trip", "IO-10", """with {boxes}, r as (select image_id, line_index, round_even(cx * width - w * width / 2, 0) as x, round_even(cy * height - h * height / 2, 0) as y,
 round_even(w * width, 0) as rw, round_even(h * height, 0) as rh, width, height from boxes),
 l as (select image_id, row_number() over (partition by image_id order by line_index) - 1 as line_index, '0 ' || format('{:.6f}', (x + rw / 2) / width) || ' ' || format('{:.6f}', (y + rh / 2) / height)
 || ' ' || format('{:.6f}', rw / width) || ' ' || format('{:.6f}', rh / height) as line from r)
 select o_orderkey::varchar as sample_id, line_index::int as line_index, line from orders left join l on image_id = o_orderkey""")
def _(t):
    files = t.table("orders").select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("filename"),
        F.col("o_custkey").alias("size"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    labels = t.boxes.select(F.col("image_id").cast("string").alias("sample_id"), "line_index", "cx", "cy", "w", "h")
    return lb.via_to_labels(lb.labels_to_via(files, labels))


@query("label_texts", "IO-13", """with {boxes}, l as (select image_id, string_agg('0 ' || format('{:.6f}', cx) || ' ' || format('{:.6f}', cy) || ' ' || format('{:.6f}', w) || ' ' || format('{:.6f}', h), chr(10) order by line_index) || chr(10) as text from boxes group by image_id)
 select o_orderkey as sample_id, coalesce(text, '') as text from orders left join l on image_id = o_orderkey""")
def _(t):
    samples = t.table("orders").select(F.col("o_orderkey").alias("sample_id"))
    six = lambda c: F.format_string("%.6f", g.decimal_round(c, 6))
    lines = t.boxes.select(F.col("image_id").alias("sample_id"), "line_index", F.concat_ws(" ", F.lit("0"), six("cx"), six("cy"), six("w"), six("h")).alias("line"))
    return sinks.label_texts(samples, lines, ["sample_id"])


@query("score_rows", "IO-14", """with {scores} select root || '::' || sample_id as sample_key, root, sample_id, segment_id, target::int as target,
 case when target then 'subtitle' when has_candidate then 'text_distractor' else 'empty' end as sample_kind, round(score, 6) as score, (score >= 0.5)::int as predicted from scores""")
def _(t):
    return sinks.score_rows(t.scores).withColumn("score", F.round("score", 6))


def _written(t) -> str:
    """A fresh path below the session's shared folder."""
    return f"{shared_folder(t.spark)}/sink-{uuid.uuid4().hex}"


@query("write_annotations", "IO-12", """with {frames} select 'images/' || sample_id || '.jpg' as image, has_subtitle, segment_id, ocr_text,
 case when frame_index % 2 = 0 then frame_index end as frame_index from frames""")
def _(t):
    rows = t.frames.select(
        F.concat(F.lit("images/"), "sample_id", F.lit(".jpg")).alias("image"), "has_subtitle", "segment_id", "ocr_text",
        F.when(F.col("frame_index") % 2 == 0, F.col("frame_index")).alias("frame_index"))
    path = _written(t)
    sinks.write_annotations(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query("read_scores", "IO-11", "with {scores} select root || '::' || sample_id as sample_key, round(score, 9) as score from scores")
def _(t):
    path = _written(t)
    sinks.write_scores(sinks.score_rows(t.scores), path)
    return an.read_scores(t.spark, path).select("sample_key", F.round("score", 9).alias("score"))


@query("append_metrics", "IO-15", "select user_id % 3 as epoch, count(*) as frames, count(distinct event_type) as kinds from events group by user_id % 3")
def _(t):
    path = _written(t)
    for epoch in range(3):
        own = t.table("events").where(F.col("user_id") % 3 == epoch)
        sinks.append_metrics(own.agg(F.lit(epoch).cast("long").alias("epoch"), F.count(F.lit(1)).alias("frames"), F.count_distinct("event_type").alias("kinds")), path)
    return t.spark.read.schema("epoch long, frames long, kinds long").json(path)


def _quad_json(x):
    x = x.cast("string")
    return F.concat(F.lit("[["), x, F.lit(",1],["), x, F.lit("5,2],["), x, F.lit("6,9],["), x, F.lit(",8]]"))


@query("normalize_detections", "AR-01", """with k as (select l_orderkey, l_linenumber % 7 as kind, l_partkey + 1 as x, l_discount as s from lineitem),
 e as (select l_orderkey, x, case when kind in (0, 1, 3) then s end as score from k where kind < 5 or kind = 6 union all select l_orderkey, x, s from k where kind = 4
 union all select l_orderkey, x, null from k where kind = 0)
 select l_orderkey as image_id, count(*) as detections, count(score) as scored, sum(x)::bigint as sum_x, round(sum(score), 6) as sum_score from e group by l_orderkey""")
def _(t):
    q, s = _quad_json(F.col("l_partkey") + 1), F.col("l_discount").cast("string")
    kind = F.col("l_linenumber") % 7
    result = (
        F.when(kind == 0, F.concat(F.lit('{"dt_polys":['), q, F.lit(","), q, F.lit('],"dt_scores":['), s, F.lit("]}")))
        .when(kind == 1, F.concat(F.lit('[{"points":'), q, F.lit(',"score":'), s, F.lit("}]")))
        .when(kind == 2, q).when(kind == 3, F.concat(F.lit("["), q, F.lit(","), s, F.lit("]")))
        .when(kind == 4, F.concat(F.lit('[{"poly":'), q, F.lit("},["), q, F.lit(","), s, F.lit("]]")))
        .when(kind == 6, F.concat(F.lit("[[[[["), q, F.lit("]]]]]"))).otherwise(F.lit("[null]"))
    )
    found = tt.normalize_detections(t.table("lineitem").select(F.col("l_orderkey").alias("image_id"), result.alias("result")), ["image_id"])
    return found.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("detections"), F.count("score").alias("scored"), F.sum(F.col("polygon")[0][0]).cast("long").alias("sum_x"), F.round(F.sum("score"), 6).alias("sum_score"))


@query("extract_text", "AR-04", """with {frames} select sample_id, case sample_idx % 11 when 0 then video_id || segment_id when 2 then sample_id when 3 then video_id || segment_id || 'x'
 when 5 then '[' || video_id || '] ' || segment_id when 6 then '[' || video_id || ']' || segment_id when 7 then '"' || video_id || '" line' when 8 then video_id
 when 10 then '' else segment_id end as text from frames""")
def _(t):
    js = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    v, s, i = js(F.col("video_id")), js(F.col("segment_id")), js(F.col("sample_id"))
    kind = F.col("sample_idx") % 11
    result = (
        F.when(kind == 0, F.concat(F.lit('{"rec_texts":['), v, F.lit(',"",'), s, F.lit("]}"))).when(kind == 1, F.concat(F.lit('{"score":0.5,"rec_text":'), s, F.lit("}")))
        .when(kind == 2, i).when(kind == 3, F.concat(F.lit("["), v, F.lit(',[{"text":'), s, F.lit('}],"x",null]')))
        .when(kind == 4, F.concat(F.lit('{"score":1,"page":{"label":'), s, F.lit("}}")))
        # strings that look like JSON or like numbers, a name with a number, nesting beyond any usual depth, nothing
        .when(kind == 5, F.concat(F.lit('{"x":"['), "video_id", F.lit("] "), "segment_id", F.lit('"}')))
        .when(kind == 6, F.concat(F.lit('["['), "video_id", F.lit(']",'), s, F.lit("]")))
        .when(kind == 7, F.concat(F.lit('["\\"'), "video_id", F.lit('\\" line"]')))
        .when(kind == 8, F.concat(F.lit('{"a":{"b":null},"x":'), v, F.lit("}")))
        .when(kind == 9, F.concat(F.lit('[[[[{"rec_text":5,"text":{"text":7},"y":[[[[{"label":'), s, F.lit("}]]]]}]]]]")))
        .otherwise(F.lit('{"a":[1,2.5,true,null]}'))
    )
    return t.frames.select("sample_id", tt.extract_text(result).alias("text"))
