"""Geometry projections and filters over label boxes."""

from pyspark.sql import functions as F

from annolake.functions import geometry as g
from annolake.operators import filters as fl
from annolake.queries.registry import query

BOX = ("cx", "cy", "w", "h", "width", "height")
r6 = lambda c: F.round(c, 6)


def _spread(struct, names):
    return [struct[n].alias(n) for n in names]


@query("yolo_to_box", "PJ-01", """with {boxes}, {corners}
 select image_id, cx, cy, w, h, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2
 from corners""")
def _(t):
    box = g.yolo_to_box(*BOX)
    return t.flat_boxes.select("image_id", "cx", "cy", "w", "h", *[r6(box[k]).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("box_iou", "PJ-02", """with {boxes}, {corners}, o as (select *,
 greatest(0, least(x2, x2 + jitter_px) - greatest(x1, x1 + jitter_px)) * greatest(0, y2 - y1) as inter,
 (x2 - x1) * (y2 - y1) as area from corners)
 select image_id, cx, cy, w, h, jitter_px,
 round(case when 2 * area - inter > 0 then inter / (2 * area - inter) else 0 end, 6) as iou from o""")
def _(t):
    box = g.yolo_to_box(*BOX)
    moved = g.make_box(box["x1"] + F.col("jitter_px"), box["y1"], box["x2"] + F.col("jitter_px"), box["y2"])
    return t.flat_boxes.select("image_id", "cx", "cy", "w", "h", "jitter_px", r6(g.box_iou(moved, box)).alias("iou"))


_SIZES = "select l_orderkey as image_id, 200 + l_partkey % 1700 as iw, 100 + l_suppkey % 97 * 11 as ih, l_discount from lineitem"


def _sizes(t):
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("image_id"), (200 + F.col("l_partkey") % 1700).alias("iw"),
        (100 + F.col("l_suppkey") % 97 * 11).alias("ih"), "l_discount",
    )


@query("letterbox_shape", "PJ-03", f"""with s as ({_SIZES}), r as (select *,
 cast(greatest(1, round_even(iw * (cast(512 as double) / greatest(iw, ih)), 0)) as bigint) as resized_width,
 cast(greatest(1, round_even(ih * (cast(512 as double) / greatest(iw, ih)), 0)) as bigint) as resized_height from s)
 select image_id, iw, ih, resized_width, resized_height,
 cast(ceil(resized_width / 32) * 32 as bigint) as padded_width, cast(ceil(resized_height / 32) * 32 as bigint) as padded_height,
 round(resized_width / iw, 6) as scale_x, round(resized_height / ih, 6) as scale_y from r""")
def _(t):
    s = g.letterbox_shape("iw", "ih", 512)
    whole = ("resized_width", "resized_height", "padded_width", "padded_height")
    return _sizes(t).select(
        "image_id", "iw", "ih", *_spread(s, whole), r6(s["scale_x"]).alias("scale_x"), r6(s["scale_y"]).alias("scale_y")
    )


@query("roi_letterbox", "PJ-04", f"""with s as ({_SIZES}), k as (select *, least(256 / iw, 32 / ih) as scale from s),
 r as (select *, cast(greatest(1, least(256, round_even(iw * scale, 0))) as bigint) as resized_width,
 cast(greatest(1, least(32, round_even(ih * scale, 0))) as bigint) as resized_height from k)
 select image_id, iw, ih, resized_width, resized_height, (256 - resized_width) // 2 as pad_left,
 256 - resized_width - (256 - resized_width) // 2 as pad_right, (32 - resized_height) // 2 as pad_top,
 32 - resized_height - (32 - resized_height) // 2 as pad_bottom from r""")
def _(t):
    s = g.roi_letterbox("iw", "ih", 256, 32)
    names = ("resized_width", "resized_height", "pad_left", "pad_right", "pad_top", "pad_bottom")
    return _sizes(t).select("image_id", "iw", "ih", *_spread(s, names))


@query("aligned_resize", "PJ-05", f"""with s as ({_SIZES})
 select image_id, iw, ih, l_discount,
 cast(greatest(16, floor(iw * (0.25 + l_discount) / 16 + 0.5) * 16) as bigint) as out_width,
 cast(greatest(16, floor(ih * (0.25 + l_discount) / 16 + 0.5) * 16) as bigint) as out_height from s""")
def _(t):
    s = g.aligned_resize_size("iw", "ih", F.lit(0.25) + F.col("l_discount"))
    return _sizes(t).select(
        "image_id", "iw", "ih", "l_discount", s["width"].alias("out_width"), s["height"].alias("out_height")
    )


@query("subtitle_protection", "PJ-06", """with {boxes}, {corners},
 s as (select image_id, width, height, min(x2 - x1) as mw, min(y2 - y1) as mh from corners
 where x2 - x1 > 0.5 and y2 - y1 > 0.5 group by all),
 a as (select *, least(mw * 64 / width, mh * 32 / height) as short_edge from s),
 p as (select *, case when short_edge >= 8 then cast(0.05 as double) else least(1, greatest(cast(0.05 as double),
 (ceil(8 * width / mw / 16) * 16 - 8) / width + cast(1e-12 as double),
 (ceil(8 * height / mh / 16) * 16 - 8) / height + cast(1e-12 as double))) end as scale from a),
 q as (select *, greatest(16, floor(width * scale / 16 + 0.5) * 16) as pw, greatest(16, floor(height * scale / 16 + 0.5) * 16) as ph from p)
 select image_id, round(scale, 6) as scale, cast(64 as bigint) as standard_width, cast(32 as bigint) as standard_height,
 cast(pw as bigint) as protected_width, cast(ph as bigint) as protected_height, round(short_edge, 6) as short_edge,
 short_edge >= 8 or least(mw * pw / width, mh * ph / height) + 1e-6 >= 8 as satisfied from q""")
def _(t):
    box = g.yolo_to_box(*BOX)
    usable = t.flat_boxes.withColumn("box", box).filter(fl.usable_box(F.col("box")))
    # The narrowest and the lowest box decide alone, so the group shrinks to two numbers before the shuffle.
    edges = usable.groupBy("image_id", "width", "height").agg(
        F.min(g.box_width(F.col("box"))).alias("mw"), F.min(g.box_height(F.col("box"))).alias("mh")
    )
    boxes = F.array(g.make_box(F.lit(0.0), F.lit(0.0), F.col("mw"), F.col("mh")))
    p = g.protection_geometry(boxes, "width", "height", 0.05, 8.0)
    return edges.select(
        "image_id", r6(p["scale"]).alias("scale"),
        p["standard"]["width"].alias("standard_width"), p["standard"]["height"].alias("standard_height"),
        p["protected"]["width"].alias("protected_width"), p["protected"]["height"].alias("protected_height"),
        r6(p["short_edge"]).alias("short_edge"), p["satisfied"].alias("satisfied"),
    )


def _quad():
    d = lambda c: F.col(c).cast("double")
    px, py, q = d("l_partkey") % 1400 - 50, d("l_suppkey") * 9 - 40, d("l_quantity")
    return F.array(F.array(px, py + 3), F.array(px + q * 4, py), F.array(px + q * 4 + 5, py + q), F.array(px - 2, py + q + 4))


@query("quad_to_bbox", "PJ-07", """with s as (select l_orderkey as image_id, l_linenumber as line, l_partkey, l_suppkey,
 l_quantity as q, l_partkey % 1400 - 50 as px, l_suppkey * 9 - 40 as py from lineitem),
 b as (select *, least(greatest(px - 2, 0), 1279) as x1, least(greatest(py, 0), 719) as y1,
 least(greatest(px + q * 4 + 5, 0), 1279) as x2, least(greatest(py + q + 4, 0), 719) as y2 from s)
 select image_id, line, l_partkey, l_suppkey, cast(x1 + 10 as double) as x1, cast(y1 + 20 as double) as y1, x2 + 10 as x2,
 y2 + 20 as y2, round((x1 + x2) / 2, 6) as center_x, round((y1 + y2) / 2, 6) as center_y from b""")
def _(t):
    points = g.quad_points(_quad(), 1280, 720)
    plain, moved = g.quad_to_bbox(points), g.quad_to_bbox(points, 10, 20)
    center = g.bbox_center(plain)
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey",
        *[r6(moved[k]).alias(k) for k in ("x1", "y1", "x2", "y2")],
        r6(center["x"]).alias("center_x"), r6(center["y"]).alias("center_y"),
    )


@query("box_to_label_text", "PJ-08", """with {boxes}, {corners}, {rects}
 select c.image_id, c.cx, c.cy, c.w, c.h, [[4:(x1 + x2) / 2 / c.width]] as n_cx, [[4:(y1 + y2) / 2 / c.height]] as n_cy,
 '0 ' || format('{:.6f}', (floor(x1) + ceil(x2 - x1) / 2) / c.width) || ' ' || format('{:.6f}', (floor(y1) + ceil(y2 - y1) / 2) / c.height)
 || ' ' || format('{:.6f}', ceil(x2 - x1) / c.width) || ' ' || format('{:.6f}', ceil(y2 - y1) / c.height) as line,
 cast(round_even(c.cx * c.width - c.w * c.width / 2, 0) as bigint) as rect_x,
 cast(round_even(c.w * c.width, 0) as bigint) as rect_width from corners c""".replace(", {rects}", ""))
def _(t):
    box = g.yolo_to_box(*BOX)
    n = g.bbox_to_yolo(box, "width", "height", digits=4)
    w, h = F.ceil(box["x2"] - box["x1"]), F.ceil(box["y2"] - box["y1"])
    line = g.rect_to_yolo(F.floor(box["x1"]), F.floor(box["y1"]), w, h, "width", "height")
    rect = g.yolo_to_rect(*BOX)
    return t.flat_boxes.select(
        "image_id", "cx", "cy", "w", "h", n["cx"].alias("n_cx"), n["cy"].alias("n_cy"), line.alias("line"),
        rect["x"].alias("rect_x"), rect["width"].alias("rect_width"),
    )


@query("box_features", "PJ-09", """with {boxes}, {rects}
 select image_id, cx, cy, w, h, x, y, rw as width, rh as height, center_y, area,
 case when h * height <> 0 then [[4:(w * width) / (h * height)]] else 0 end as aspect from rects""")
def _(t):
    f = g.box_features(*BOX)
    names = ("x", "y", "width", "height", "center_y", "area", "aspect")
    return t.flat_boxes.select("image_id", "cx", "cy", "w", "h", *_spread(f, names))


@query("label_to_pixel_box", "PJ-10", """with {boxes}, {rects}, {pixels}
 select image_id, cx, cy, w, h, ix1 as x1, iy1 as y1, ix2 as x2, iy2 as y2 from pixels""")
def _(t):
    p = g.label_to_pixel_box(*BOX)
    return t.flat_boxes.select("image_id", "cx", "cy", "w", "h", *_spread(p, ("x1", "y1", "x2", "y2")))


@query("crop_window", "PJ-11", f"""with s as ({_SIZES}), c as (select *, greatest(0, least(iw - 640, iw // 2 - 320)) as x1,
 greatest(0, least(ih - 256, ih // 3 - 128)) as y1 from s)
 select image_id, iw, ih, cast(x1 as bigint) as x1, cast(y1 as bigint) as y1, cast(least(iw, x1 + 640) as bigint) as x2,
 cast(least(ih, y1 + 256) as bigint) as y2 from c""")
def _(t):
    crop = g.crop_window("iw", "ih", 640, 256, F.floor(F.col("iw") / 2), F.floor(F.col("ih") / 3))
    return _sizes(t).select("image_id", "iw", "ih", *_spread(crop, ("x1", "y1", "x2", "y2")))


@query("reproject_label", "PJ-12", """with {boxes}, {rects}, {pixels}, c as (select *,
 least(greatest(ix1 - 320, 0), 640) as a1, least(greatest(ix2 - 320, 0), 640) as a2,
 least(greatest(iy1 - 360, 0), 256) as b1, least(greatest(iy2 - 360, 0), 256) as b2 from pixels)
 select image_id, cx, cy, w, h, (a1 + a2) / 2 / 640 as n_cx, (b1 + b2) / 2 / 256 as n_cy,
 (a2 - a1) / 640 as n_w, (b2 - b1) / 256 as n_h from c where a2 > a1 and b2 > b1""")
def _(t):
    crop = g.make_box(320, 360, 960, 616, "long")
    out = t.flat_boxes.withColumn("n", g.reproject_label(g.label_to_pixel_box(*BOX), crop, 640, 256)).filter("n is not null")
    return out.select("image_id", "cx", "cy", "w", "h", *[F.col("n")[k].alias("n_" + k) for k in ("cx", "cy", "w", "h")])


@query("crop_boxes", "PJ-13", """with {boxes}, {corners}
 select image_id, cx, cy, w, h, round(greatest(x1, 320) - 320, 6) as x1, round(greatest(y1, 180) - 180, 6) as y1,
 round(least(x2, 960) - 320, 6) as x2, round(least(y2, 540) - 180, 6) as y2 from corners
 where least(x2, 960) > greatest(x1, 320) and least(y2, 540) > greatest(y1, 180)""")
def _(t):
    cut = g.crop_boxes(F.array(g.yolo_to_box(*BOX)), g.make_box(320, 180, 960, 540))
    out = t.flat_boxes.select("image_id", "cx", "cy", "w", "h", F.explode(cut).alias("b"))
    return out.select("image_id", "cx", "cy", "w", "h", *[r6(F.col("b")[k]).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("scale_boxes", "PJ-14", """with {boxes}, {corners}
 select image_id, cx, cy, w, h, round(least(x1 * 0.2, 250), 6) as x1, round(least(y1 * 0.3, 200), 6) as y1,
 round(least(x2 * 0.2, 250), 6) as x2, round(least(y2 * 0.3, 200), 6) as y2 from corners""")
def _(t):
    scaled = g.scale_boxes(F.array(g.yolo_to_box(*BOX)), 0.2, 0.3, 250, 200)
    out = t.flat_boxes.select("image_id", "cx", "cy", "w", "h", scaled[0].alias("b"))
    return out.select("image_id", "cx", "cy", "w", "h", *[r6(F.col("b")[k]).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("clamp_edit_rect", "PJ-15", """with {boxes}, e as (select *, least(greatest(cx * 1500 - 100, 0), 1279) as ex,
 least(greatest(cy * 900 - 60, 0), 719) as ey from boxes), f as (select *, greatest(1, least(w * width - 40, 1280 - ex)) as ew,
 greatest(1, least(h * height, 720 - ey)) as eh from e)
 select image_id, cx, cy, w, h, round(ex, 6) as ex, round(ey, 6) as ey, round(ew, 6) as ew, round(eh, 6) as eh,
 round((ex + ew / 2) / 1280, 12) as n_cx, round((ey + eh / 2) / 720, 12) as n_cy from f""")
def _(t):
    e = g.clamp_edit_rect(
        F.col("cx") * 1500 - 100, F.col("cy") * 900 - 60, F.col("w") * F.col("width") - 40, F.col("h") * F.col("height"),
        "width", "height",
    )
    out = t.flat_boxes.withColumn("e", e)
    n = g.bbox_center(g.make_box(F.col("e.x"), F.col("e.y"), F.col("e.x") + F.col("e.width"), F.col("e.y") + F.col("e.height")))
    return out.select(
        "image_id", "cx", "cy", "w", "h", r6("e.x").alias("ex"), r6("e.y").alias("ey"), r6("e.width").alias("ew"),
        r6("e.height").alias("eh"), F.round(n["x"] / 1280, 12).alias("n_cx"), F.round(n["y"] / 720, 12).alias("n_cy"),
    )


@query("union_rect", "PJ-16", """with {boxes}, {rects}
 select image_id, [[2:min(x)]] as x, [[2:min(y)]] as y, [[2:max(x + rw) - min(x)]] as width,
 [[2:max(y + rh) - min(y)]] as height from rects group by image_id""")
def _(t):
    f = g.box_features(*BOX)
    rects = t.flat_boxes.select("image_id", *_spread(f, ("x", "y", "width", "height")))
    x1, y1 = F.min("x"), F.min("y")
    x2, y2 = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return rects.groupBy("image_id").agg(
        g.decimal_round(x1, 2).alias("x"), g.decimal_round(y1, 2).alias("y"), g.decimal_round(x2 - x1, 2).alias("width"),
        g.decimal_round(y2 - y1, 2).alias("height"),
    )


@query("sample_stem", "PJ-17", """with {frames} select sample_id, sample_id as stem, video_id as parsed_root, frame_index as parsed_frame
 from (select *  replace ('v' || video_id as video_id) from frames) q""")
def _(t):
    stem = g.sample_stem(F.concat(F.lit("v"), F.col("video_id")), "frame_index")
    parsed = g.parse_video_frame(stem)
    return t.frames.select(
        "sample_id", stem.alias("stem"), parsed["video_id"].alias("parsed_root"), parsed["frame_index"].alias("parsed_frame")
    )


@query("presence_score", "PJ-19", """with {scores}, p as (select avg(target::int) as prior from scores)
 select sample_id, round(1 / (1 + exp(-(score * 8 - 4))), 6) as presence_score,
 round(case when target then 0.5 / prior else 0.5 / (1 - prior) end, 6) as weight from scores, p""")
def _(t):
    prior = t.scores.agg(F.avg(F.col("target").cast("int")).alias("p")).scalar()
    return t.scores.withColumn("prior", prior).select(
        "sample_id", r6(g.sigmoid(F.col("score") * 8 - 4)).alias("presence_score"),
        r6(g.importance_weight(F.col("target"), F.col("prior"), F.lit(0.5))).alias("weight"),
    )


@query("select_frames", "FL-01", """with {frames} select root, sample_id, frame_index from frames
 where frame_index >= 1 and frame_index % 3 = 0""")
def _(t):
    return fl.select_frames(t.frames, 3, start=1).select("root", "sample_id", "frame_index")


@query("min_score", "FL-02", """with {boxes} select image_id, cx, cy, w, h, score from boxes where score is null or score >= 0.8""")
def _(t):
    return t.flat_boxes.filter(fl.passes_score(F.col("score"), 0.8)).select("image_id", "cx", "cy", "w", "h", "score")


@query("region_filter", "FL-03", """with {boxes}, {corners} select image_id, cx, cy, w, h from corners
 where x1 + 100 <= 900 and x2 + 100 >= 300 and y1 + 50 <= 700 and y2 + 50 >= 400""")
def _(t):
    b = g.yolo_to_box(*BOX)
    moved = g.make_box(b["x1"] + 100, b["y1"] + 50, b["x2"] + 100, b["y2"] + 50)
    return fl.region_filter(t.flat_boxes, moved, (300, 400, 900, 700)).select("image_id", "cx", "cy", "w", "h")


@query("drop_empty_frames", "FL-04", """with {boxes} select o_orderkey as image_id, count(*) as boxes from orders
 join boxes on image_id = o_orderkey where score is null or score >= 0.9 group by o_orderkey""")
def _(t):
    images = t.table("orders").select(F.col("o_orderkey").alias("image_id"))
    kept = t.flat_boxes.filter(fl.passes_score(F.col("score"), 0.9)).groupBy("image_id").agg(F.count(F.lit(1)).alias("boxes"))
    frames = images.join(kept, "image_id", "left").fillna(0, ["boxes"])
    return fl.drop_empty(frames.withColumn("list", F.when(F.col("boxes") > 0, F.array("boxes")).otherwise(F.array())), F.col("list")).drop("list")


_BOUNDS = {"area_gt": 5000.0, "width_lt": 500.0, "height_gt": 40.0, "y_gt": 200.0, "y_lt": 650.0}


@query("box_filter", "FL-05", """with {boxes}, {rects} select image_id, x, y, rw as width, rh as height, area from rects
 where area > 5000 and rw < 500 and rh > 40 and center_y > 200 and center_y < 650""")
def _(t):
    f = t.flat_boxes.select("image_id", g.box_features(*BOX).alias("f"))
    return f.filter(fl.box_filter(F.col("f"), _BOUNDS)).select("image_id", *_spread(F.col("f"), ("x", "y", "width", "height", "area")))


def _listing(t):
    boxes = t.flat_boxes.select("image_id", g.box_features(*BOX).alias("features"), (F.col("status") == "F").alias("masked"))
    images = t.table("orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderstatus") == "P").alias("drop_image"))
    return boxes, images


_LISTING = """with {boxes}, {rects}, per as (select image_id, count(*) as total_boxes, sum((status = 'F')::int) as masked_boxes,
 sum((status <> 'F')::int) as shown_boxes, sum((status <> 'F' and area > 20000 and center_y > 300)::int) as matched_count
 from rects group by image_id), listed as (select o_orderkey as image_id, o_orderstatus = 'P' as drop_image,
 coalesce(total_boxes, 0)::bigint as total_boxes, coalesce(masked_boxes, 0)::bigint as masked_boxes,
 coalesce(shown_boxes, 0)::bigint as shown_boxes, coalesce(matched_count, 0)::bigint as matched_count,
 total_boxes is null as empty_label from orders left join per on image_id = o_orderkey)
"""


@query("review_listing", "FL-06", _LISTING + "select * from listed where shown_boxes > 0 and matched_count > 0")
def _(t):
    return fl.review_listing(*_listing(t), {"area_gt": 20000.0, "y_gt": 300.0}, show_masked=False)


@query("review_listing_stats", "FL-06", _LISTING + """select (select count(*) from boxes semi join orders on image_id = o_orderkey)
 as total_boxes, (select count(*) from boxes semi join orders on image_id = o_orderkey where status = 'F') as masked_boxes,
 (select count(*) from orders where o_orderstatus = 'P') as dropped_images,
 (select count(*) from listed where drop_image or not drop_image) as images""")
def _(t):
    boxes, images = _listing(t)
    return fl.listing_stats(boxes, images, fl.review_listing(boxes, images, {}, include_empty=True))


@query("usable_labels", "FL-07", """with {boxes} select image_id, cx, cy, w, h from boxes join orders on o_orderkey = image_id
 where o_orderstatus <> 'P' and not (status = 'F' or jitter_px > 14)""")
def _(t):
    record = F.struct(
        (F.col("status") == "F").alias("masked"), F.lit(None).cast("boolean").alias("deleted"),
        (F.col("jitter_px") > 14).alias("unreliable"), F.lit(False).alias("exclude_from_loss"),
    )
    images = t.table("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("image_id"))
    boxes = t.flat_boxes.filter(~fl.label_is_masked(record)).select("image_id", "cx", "cy", "w", "h")
    return boxes.join(images, "image_id", "left_semi")
