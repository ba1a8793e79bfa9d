"""Box merging, matching, maps, scoring, and the end-to-end plans."""

import numpy as np
from pyspark.sql import functions as F

from annolake.functions import geometry as g
from annolake.operators import detection as dt
from annolake.operators import maps as mp
from annolake.operators import metrics as m
from annolake.operators.filters import usable_box
from annolake.operators.scoring import score_batches
from annolake.plans.build_samples import build_samples
from annolake.plans.prepare_roi import prepare_roi
from annolake.queries.registry import query

BOX = ("cx", "cy", "w", "h", "width", "height")


def _detections(t):
    """Targets and predictions: the same boxes, shifted right by their jitter and clipped; a few are not predicted."""
    rows = t.boxes.withColumn("target", g.yolo_to_box(*BOX)).filter(usable_box(F.col("target")))
    b, j = F.col("target"), F.col("jitter_px")
    moved = g.clip_box(g.make_box(b["x1"] + j, b["y1"], b["x2"] + j, b["y2"]), "width", "height", ordered=True)
    targets = rows.select("image_id", F.col("line_index").alias("box_id"), b.alias("box"))
    predictions = rows.filter(F.coalesce("score", F.lit(1.0)) >= 0.6).withColumn("box", moved).filter(usable_box(F.col("box")))
    return predictions.select("image_id", F.col("line_index").alias("box_id"), "box"), targets


@query("match_candidates", "JN-15", """with {boxes}, {corners}, t as (select * from corners where x2 - x1 > 0.5 and y2 - y1 > 0.5),
 p as (select image_id, line_index, least(x1 + jitter_px, width) as x1, y1, least(x2 + jitter_px, width) as x2, y2 from t where coalesce(score, 1) >= 0.6),
 k as (select p.image_id, p.line_index as pred_id, t.line_index as target_id, greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) *
 greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) as inter, (p.x2 - p.x1) * (p.y2 - p.y1) as a, (t.x2 - t.x1) * (t.y2 - t.y1) as b
 from p join t on p.image_id = t.image_id where p.x2 - p.x1 > 0.5)
 select image_id, pred_id, target_id, round(inter / (a + b - inter), 6) as iou from k where inter / (a + b - inter) >= 0.5""")
def _(t):
    predictions, targets = _detections(t)
    return dt.match_candidates(predictions, targets, 0.5).withColumn("iou", F.round("iou", 6))


@query("merge_adjacent_boxes", "GM-01")
def _(t):
    return dt.merge_adjacent_boxes(_detections(t)[1], ["image_id"])


@query("evaluate_images", "GM-02")
def _(t):
    return dt.evaluate_images(*_detections(t), ["image_id"])


@query("detection_metrics", "AG-22")
def _(t):
    return m.detection_metrics(dt.evaluate_images(*_detections(t), ["image_id"]))


@query("merge_candidate_groups", "GM-03", """with recursive {boxes}, {rects}, r as (select image_id, line_index, x, y, rw, rh from rects where status <> 'F'),
 e as (select a.image_id, a.line_index as a, b.line_index as b from r a join r b on a.image_id = b.image_id and a.line_index <> b.line_index
 where abs(a.rh - b.rh) / ((a.rh + b.rh) / 2) <= 0.22 and abs((a.y + a.rh / 2) - (b.y + b.rh / 2)) / ((a.rh + b.rh) / 2) <= 0.45
 and greatest(0, greatest(a.x, b.x) - least(a.x + a.rw, b.x + b.rw)) <= (a.rh + b.rh) / 2 * 0.65),
 reach(image_id, a, b) as (select image_id, line_index, line_index from r union select c.image_id, c.a, e.b from reach c join e on e.image_id = c.image_id and e.a = c.b),
 lab as (select image_id, a, min(b) as grp from reach group by image_id, a),
 g as (select r.image_id, grp, count(*) as members, min(x) as x0, min(y) as y0, max(x + rw) as x1, max(y + rh) as y1 from r join lab on lab.image_id = r.image_id and lab.a = r.line_index group by r.image_id, grp),
 h as (select image_id, grp as "group", members::bigint as members, [[2:x0]] as x, [[2:y0]] as y, [[2:x1 - x0]] as width, [[2:y1 - y0]] as height from g where members > 1)
 select *, [[2:width * height]] as area from h""")
def _(t):
    f = g.box_features(*BOX)
    rects = t.boxes.filter("status <> 'F'").select("image_id", "line_index", *[f[k].alias(k) for k in ("x", "y", "width", "height")])
    return dt.merge_candidate_groups(rects)


@query("reading_order", "GM-04")
def _(t):
    p = t.boxes.select("image_id", "line_index", g.label_to_pixel_box(*BOX).alias("b")).filter("b.x2 > b.x1 and b.y2 > b.y1")
    lists = p.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("line_index", "b"))).alias("l"))
    flat = F.flatten(F.transform("l", lambda e: F.array(*[e["b"][k].cast("double") for k in ("x1", "y1", "x2", "y2")])))
    ordered = lists.select("image_id", "l", F.posexplode(dt.reading_order(flat)).alias("position", "at"))
    return ordered.select("image_id", "position", F.col("l")[F.col("at")]["line_index"].alias("line_index"))


_CELLS = """cover as (select distinct image_id, cast(least(greatest(floor(x1 * 32 / 1280), 0), 32) as int) as l, cast(least(greatest(floor(y1 * 18 / 720), 0), 18) as int) as t,
 cast(greatest(least(greatest(floor(x1 * 32 / 1280), 0), 32) + 1, least(32, ceil(x2 * 32 / 1280))) as int) as r,
 cast(greatest(least(greatest(floor(y1 * 18 / 720), 0), 18) + 1, least(18, ceil(y2 * 18 / 720))) as int) as b
 from corners where x2 - x1 > 0.5 and y2 - y1 > 0.5), cells as (select distinct image_id, x, y from
 (select image_id, x, unnest(range(t, b)) as y from (select image_id, unnest(range(l, r)) as x, t, b from cover)) where x < 32 and y < 18)"""


@query("rasterize_boxes", "GM-05", "with {boxes}, {corners}, " + _CELLS + " select image_id, count(*) as cells, sum(x)::bigint as sum_x, sum(y * x)::bigint as sum_xy from cells group by image_id")
def _(t):
    targets = _detections(t)[1]
    cells = mp.rasterize_boxes(targets, "image_id", (1280, 720), (32, 18))
    return cells.groupBy("image_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("x").alias("sum_x"), F.sum(F.col("x") * F.col("y")).alias("sum_xy"))


def _scaled(t):
    b = t.boxes.withColumn("box", g.clip_box(g.transform_box(g.yolo_to_box(*BOX), 0.05, 0.05), 64, 36, ordered=True))
    return b.select("image_id", (F.col("line_index") + 1).alias("instance"), "box", "status")


@query("region_kernel_targets", "GM-06", """with {boxes}, {corners}, s as (select image_id, line_index + 1 as instance, status, least(x1 * 0.05, 64) as x1,
 least(y1 * 0.05, 36) as y1, least(x2 * 0.05, 64) as x2, least(y2 * 0.05, 36) as y2 from corners where image_id % 5 = 0 or image_id % 5 <> 0),
 u as (select * from s where x2 - x1 > 0.5 and y2 - y1 > 0.5 and status = 'F'),
 own as (select image_id, x, y, max(instance) as owner from (select image_id, instance, x, unnest(range(floor(y1)::int, ceil(y2)::int)) as y from
 (select *, unnest(range(floor(x1)::int, ceil(x2)::int)) as x from u)) group by image_id, x, y),
 rowpass as (select image_id, x, y, owner from (select *, min(owner) over w as lo, max(owner) over w as hi, count(*) over w as n,
 least(x + 1, 63) - greatest(x - 1, 0) + 1 as want from own window w as (partition by image_id, y order by x range between 1 preceding and 1 following)) where lo = hi and n = want),
 inner_cells as (select image_id, x, y from (select *, min(owner) over w as lo, max(owner) over w as hi, count(*) over w as n,
 least(y + 1, 35) - greatest(y - 1, 0) + 1 as want from rowpass window w as (partition by image_id, x order by y range between 1 preceding and 1 following)) where lo = hi and n = want),
 k as (select image_id, (x1 + x2) * 0.5 as mx, (y1 + y2) * 0.5 as my, case when x2 - x1 <= 3 then x2 - x1 else least(greatest((x2 - x1) * 0.1, 3), x2 - x1) end as kw,
 case when y2 - y1 <= 3 then y2 - y1 else least(greatest((y2 - y1) * 0.1, 3), y2 - y1) end as kh from u),
 kc as (select image_id, x, y, count(*) as cover from (select image_id, x, unnest(range(floor(greatest(my - kh * 0.5, 0))::int, ceil(least(my + kh * 0.5, 36))::int)) as y from
 (select *, unnest(range(floor(greatest(mx - kw * 0.5, 0))::int, ceil(least(mx + kw * 0.5, 64))::int)) as x from k)) group by image_id, x, y),
 ig as (select distinct image_id, x, y from (select image_id, x, unnest(range(floor(y1)::int, ceil(y2)::int)) as y from (select *, unnest(range(floor(x1)::int, ceil(x2)::int)) as x
 from s where status = 'O' and instance % 4 = 0))),
 z as (select image_id, x, y, o.owner is not null as region, case when coalesce(cover, 0) = 0 then i.image_id is not null when cover = 1 then true else false end as kernel,
 g.image_id is not null as ign from own o left join (select * from inner_cells) i using (image_id, x, y) full join kc using (image_id, x, y) full join ig g using (image_id, x, y))
 select image_id, sum(region::int)::bigint as region_cells, sum(kernel::int)::bigint as kernel_cells, sum(case when kernel then x * 37 + y else 0 end)::bigint as kernel_hash,
 sum(ign::int)::bigint as ignored_cells from z group by image_id""".replace(" where image_id % 5 = 0 or image_id % 5 <> 0", ""))
def _(t):
    rows = _scaled(t)
    cells = mp.region_kernel_targets(
        rows.filter("status = 'F'"), rows.filter("status = 'O' and instance % 4 = 0"), "image_id", 64, 36, pooling=3)
    return cells.groupBy("image_id").agg(
        F.sum("region").alias("region_cells"), F.sum("kernel").alias("kernel_cells"),
        F.sum(F.when(F.col("kernel") == 1, F.col("x") * 37 + F.col("y")).otherwise(0)).cast("long").alias("kernel_hash"),
        F.sum(1 - F.col("training_mask")).alias("ignored_cells"))


def _maps(t):
    """Logit maps of 32 x 18 cells: high inside the boxes, highest in their middle.

    Rows of cells are joined as words of 32 bits; no list of boxes is searched for each cell.
    """
    boxes, b = _detections(t)[1].select("image_id", g.transform_box(F.col("box"), 0.025, 0.025).alias("b")), F.col("b")
    kinds = {"region": 0.0, "kernel": 1.0}
    ends = {}
    for name, shrink in kinds.items():
        # Columns whose middle is inside, and rows.
        ends[f"{name}_first"] = F.greatest(F.ceil(b["x1"] + shrink - 0.5), F.lit(0)).cast("int")
        ends[f"{name}_last"] = F.least(F.floor(b["x2"] - shrink - 0.5), F.lit(31)).cast("int")
        ends[f"{name}_top"], ends[f"{name}_bottom"] = b["y1"] + shrink / 2, b["y2"] - shrink / 2
    spans = boxes.withColumns(ends).withColumns({
        f"{n}_word": F.expr(f"if({n}_last >= {n}_first, shiftleft(1L, {n}_last + 1) - shiftleft(1L, {n}_first), 0L)") for n in kinds})
    inside = lambda n, row: (F.col(f"{n}_top") <= row + 0.5) & (F.col(f"{n}_bottom") >= row + 0.5)
    joined = spans.groupBy("image_id").agg(*(
        F.bit_or(F.when(inside(n, row), F.col(f"{n}_word"))).alias(f"{n}_{row}") for n in kinds for row in range(18)))
    cells = F.sequence(F.lit(0), F.lit(31))
    row_of = lambda c: F.transform(cells, lambda i: F.when(F.getbit(F.coalesce(c, F.lit(0).cast("long")), i) == 1, 4.0).otherwise(-4.0))
    return joined.select("image_id", *(F.concat(*(row_of(F.col(f"{n}_{row}")) for row in range(18))).alias(n) for n in kinds))


@query("maps_to_boxes", "GM-07")
def _(t):
    return mp.maps_to_boxes(_maps(t), "image_id", 32, min_size=1.0)


def _prob_cells(t):
    """Dense 16 x 9 cell table: target from the box cover, probability from a fixed pattern."""
    box = g.yolo_to_box(*BOX)
    boxes = t.flat_boxes.select("image_id", F.when(usable_box(box), box).alias("box"))
    cover = mp.covered_words(boxes, "image_id", (1280, 720), (16, 9))
    grid = cover.select("image_id", "words", F.explode(F.sequence(F.lit(0), F.lit(143))).alias("idx"))
    prob = ((F.col("idx") * 7 + F.col("image_id") * 13) % 101 / 100).alias("prob")
    target = F.coalesce(mp.is_covered(F.col("words"), F.col("idx"), 16), F.lit(False)).cast("double").alias("target")
    return grid.select("image_id", "idx", target, prob, F.when(F.col("idx") % 17 == 0, 0.0).otherwise(1.0).alias("valid"))


_PROB = """with {boxes}, {corners}, cover as (select distinct image_id, cast(least(greatest(floor(x1 * 16 / 1280), 0), 16) as int) as l, cast(least(greatest(floor(y1 * 9 / 720), 0), 9) as int) as t,
 cast(greatest(least(greatest(floor(x1 * 16 / 1280), 0), 16) + 1, least(16, ceil(x2 * 16 / 1280))) as int) as r,
 cast(greatest(least(greatest(floor(y1 * 9 / 720), 0), 9) + 1, least(9, ceil(y2 * 9 / 720))) as int) as b
 from corners where x2 - x1 > 0.5 and y2 - y1 > 0.5), hit as (select distinct image_id, y * 16 + x as idx from
 (select image_id, x, unnest(range(t, b)) as y from (select image_id, unnest(range(l, r)) as x, t, b from cover)) where x < 16 and y < 9),
 cells as (select i.image_id, n as idx, h.idx is not null as target, ((n * 7 + i.image_id * 13) % 101) / 100 as prob, n % 17 <> 0 as ok from
 (select distinct l_orderkey as image_id from lineitem) i cross join (select unnest(range(144)) as n) k left join hit h on h.image_id = i.image_id and h.idx = n),
 rec as (select image_id, sum((ok and target and prob >= 0.5)::int) as inter, sum((ok and (target or prob >= 0.5))::int) as un,
 sum((ok and prob >= 0.5)::int) as nh, sum((ok and target)::int) as nt, avg(case when ok and target then prob end) as inside,
 coalesce(avg(case when ok and not target then prob end), 0) as outside,
 arg_max(target::int, (case when ok then prob else -1 end) * 1000 - idx / 1000) as pointing from cells group by image_id having sum((ok and target)::int) > 0)"""


@query("region_localization", "AG-18", _PROB + """ select image_id, round(inter / un, 12) as iou, round(2 * inter / greatest(1, nh + nt), 12) as dice, round(inside, 12) as inside,
 round(outside, 12) as outside, round(inside - outside, 12) as contrast, pointing::double as pointing from rec""")
def _(t):
    rec = mp.region_localization(_prob_cells(t), "image_id")
    return rec.select("image_id", *[F.round(c, 12).alias(c) for c in rec.columns if c != "image_id"])


@query("localization_metrics", "AG-18", _PROB + """ select count(*)::double as localizable_count, round(avg(inter / un), 6) as iou, round(avg(2 * inter / greatest(1, nh + nt)), 6) as dice,
 round(avg(inside), 6) as inside, round(avg(outside), 6) as outside, round(avg(inside - outside), 6) as contrast, round(avg(pointing), 6) as pointing from rec""")
def _(t):
    out = mp.localization_metrics(mp.region_localization(_prob_cells(t), "image_id"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("region_activation", "AG-19", _PROB + """, act as (select image_id, coalesce(max(case when ok then prob end), 0) as mx, coalesce(avg(case when ok then (prob >= 0.5)::int end), 0) as area,
 image_id % 3 = 0 as negative from cells group by image_id),
 r as (select mx, row_number() over (order by mx) as rn, count(*) over () as n from act where negative)
 select (select mx from r where rn = round_even((n - 1) * 0.95, 0) + 1) as negative_max_p95, round(avg(case when negative then area end), 6) as negative_area,
 round(avg(mx), 6) as mean_max from act""")
def _(t):
    act = mp.region_activation(_prob_cells(t), "image_id").withColumn("target", F.lit(True))
    negative = act.filter("image_id % 3 = 0")
    p95 = m.score_histogram(negative, score="max_score").agg(m.nearest_rank("p", 0.95).alias("v")).scalar()
    out = act.agg(F.round(F.avg(F.when(F.col("image_id") % 3 == 0, F.col("activation_area"))), 6).alias("negative_area"), F.round(F.avg("max_score"), 6).alias("mean_max"))
    return out.withColumn("negative_max_p95", p95)


@query("score_batches", "GM-17", """with {scores} select sample_id, round(1 / (1 + exp(-(score * 6 - prev_score * 2 - 2))), 6) as model_score,
 score * 6 - prev_score * 2 - 2 >= 0 as prediction from scores""")
def _(t):
    def predict(batch):
        return batch["score"].to_numpy() * 6 - batch["prev_score"].to_numpy() * 2 - 2

    rows = t.scores.select("sample_id", "score", "prev_score")
    scored = score_batches(rows, predict, ["score", "prev_score"])
    return scored.select("sample_id", F.round("score", 6).alias("model_score"), "prediction")


def _frames_and_detections(t):
    frames = t.table("orders").select(
        F.concat(F.lit("vid"), F.col("o_custkey") % 100).alias("video_id"), F.col("o_orderkey").alias("frame_index"),
        F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit(10).alias("offset_x"), F.lit(20).alias("offset_y"))
    videos = t.table("orders").select(F.col("o_orderkey").alias("frame_index"), F.concat(F.lit("vid"), F.col("o_custkey") % 100).alias("video_id"))
    found = t.flat_boxes.select(F.col("image_id").alias("frame_index"), g.yolo_to_box(*BOX).alias("box"), "score", "cx", "cy", "w", "h")
    return frames, found.join(videos, "frame_index")


_BUILD = """with {boxes}, {corners}, f as (select 'vid' || (o_custkey % 100) as video_id, o_orderkey as frame_index from orders where o_orderkey % 2 = 0),
 d as (select f.video_id, f.frame_index, c.* from f join corners c on c.image_id = f.frame_index where (score is null or score >= 0.75)
 and x1 + 10 <= 1000 and x2 + 10 >= 200 and y1 + 20 <= 700 and y2 + 20 >= 300),
 n as (select f.video_id, f.frame_index, count(d.image_id) as detections from f left join d on d.frame_index = f.frame_index and d.video_id = f.video_id group by all),
 k as (select *, coalesce(sum((detections > 0)::int) over (partition by video_id order by frame_index rows between unbounded preceding and 1 preceding), 0) as kept_before from n)"""
_ARGS = dict(stride=2, min_score=0.75, region=(200, 300, 1000, 700), max_frames=40)


@query("build_samples", "GM-19, PJ-08, FL-01, FL-02, FL-03, FL-04, SL-01", _BUILD + """ select d.video_id, d.frame_index, d.video_id || '_f' || lpad(d.frame_index::varchar, 8, '0') as sample_id,
 score, [[6:(x1 + x2) / 2 / 1280]] as cx, [[6:(y1 + y2) / 2 / 720]] as cy, [[6:(x2 - x1) / 1280]] as w, [[6:(y2 - y1) / 720]] as h
 from d join k on k.video_id = d.video_id and k.frame_index = d.frame_index where kept_before < 40""")
def _(t):
    labels = build_samples(*_frames_and_detections(t), **_ARGS)["labels"]
    return labels.select("video_id", "frame_index", "sample_id", "score", "yolo.*")


@query("video_stats", "AG-26", _BUILD + """ select video_id, count(*) as selected_frames, sum((detections > 0)::int)::bigint as kept_frames, sum(detections)::bigint as detections
 from k where kept_before < 40 group by video_id""")
def _(t):
    return build_samples(*_frames_and_detections(t), **_ARGS)["stats"]


def _roi_inputs(t, boxes):
    images = t.table("orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit(1280).alias("width"), F.lit(720).alias("height"), (F.col("o_orderstatus") == "P").alias("drop_image"))
    small = boxes.withColumn("w", F.col("w") / 4)
    return images, small.select("image_id", "line_index", "cx", "cy", "w", "h"), t.boxes.filter("status = 'F'").select("image_id", "line_index")


@query("prepare_roi", "GM-18")
def _(t):
    samples = prepare_roi(*_roi_inputs(t, t.boxes), keep_empty=True)["samples"]
    return samples.select("image_id", "roi_width", "roi_height", "crop.*", "has_subtitle", F.array_join("label_lines", "|").alias("labels"))


_ROI = """with {boxes}, small as (select * replace (w / 4 as w) from boxes where status <> 'F'),
 """ + "rects as (select *, [[2:cx * width - w * width / 2]] as x, [[2:cy * height - h * height / 2]] as y, [[2:w * width]] as rw, [[2:h * height]] as rh from small)," + """ {pixels},
 p as (select pixels.* from pixels join orders on o_orderkey = image_id where o_orderstatus <> 'P' and ix2 > ix1 and iy2 > iy1),
 roi as (select max(ix2) - min(ix1) as roi_width, max(iy2) - min(iy1) as roi_height from p)"""


@query("prepare_roi_summary", "GM-18, IO-15", _ROI + """ select roi_width, roi_height, (select count(*) from orders where o_orderstatus <> 'P') as samples,
 (select count(distinct image_id) from small join orders on o_orderkey = image_id where o_orderstatus <> 'P') as positive,
 (select count(*) from orders where o_orderstatus <> 'P') - (select count(distinct image_id) from small join orders on o_orderkey = image_id where o_orderstatus <> 'P') as empty from roi""")
def _(t):
    return prepare_roi(*_roi_inputs(t, t.boxes), keep_empty=True)["summary"]
