"""Sample assembly, sequence windows, sampling and set operations."""

from pyspark.sql import functions as F

from annolake.functions import geometry as g
from annolake.functions.text import normalize_text
from annolake.operators import overlay as ov
from annolake.operators import sampling as sp
from annolake.operators import segments as sg
from annolake.operators.maps import map_stats
from annolake.operators.ordered import dense_block, index_block, with_rank
from annolake.plans import geometry_plan as gp
from annolake.queries.registry import query

BOX = ("cx", "cy", "w", "h", "width", "height")


def _items(t):
    """Frames as unreviewed items: the segment marker is missing for every fifth conversation."""
    conv = F.col("video_id").cast("long")
    return t.frames.select(
        "root", "sample_id", "sample_idx", "video_id", "frame_index", "has_subtitle", "ocr_text",
        F.when(conv % 5 != 0, F.col("segment_id")).alias("segment_marker"),
    )


def _review(t):
    conv = F.col("video_id").cast("long")
    return t.frames.filter(conv % 3 == 0).select(
        "root", "sample_id", F.when(F.col("frame_index") % 2 == 0, F.lit(True)).alias("has_subtitle"),
        F.when(F.col("frame_index") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("m"), F.col("video_id"))).alias("segment_id"),
        F.when(F.col("frame_index") == 1, F.lit("checked")).otherwise("").alias("note"),
    )


_REVIEWED = """items as (select *, case when video_id::bigint % 5 <> 0 then segment_id end as marker from frames),
 decided as (select sample_id, case when frame_index % 2 = 0 then true end as rh,
 case when frame_index % 4 = 0 then '' else 'm' || video_id end as rs, case when frame_index = 1 then 'checked' else '' end as rn
 from frames where video_id::bigint % 3 = 0),
 reviewed as (select i.root, i.sample_id, i.sample_idx, i.video_id, i.frame_index, i.ocr_text, coalesce(rh, i.has_subtitle) as has_subtitle,
 coalesce(nullif(rs, ''), marker, i.sample_id) as segment_id,
 coalesce(nullif(rs, ''), marker, i.sample_id) <> coalesce(marker, i.sample_id) as segment_changed, coalesce(rn, '') as note,
 d.sample_id is not null as reviewed from items i left join decided d on i.sample_id = d.sample_id)"""


def _reviewed(t):
    return ov.apply_review(_items(t), _review(t))


@query("apply_review", "JN-01", "with {frames}, " + _REVIEWED + " select sample_id, has_subtitle, segment_id, segment_changed, note, reviewed from reviewed")
def _(t):
    return _reviewed(t).select("sample_id", "has_subtitle", "segment_id", "segment_changed", "note", "reviewed")


@query("review_stats", "AG-27", "with {frames}, " + _REVIEWED + """ select count(*) as samples, sum(has_subtitle::int)::bigint as subtitle_samples,
 sum((not has_subtitle)::int)::bigint as empty_samples, count(distinct case when has_subtitle then segment_id end) as segments,
 sum(reviewed::int)::bigint as edited_samples from reviewed""")
def _(t):
    return sg.review_stats(_reviewed(t))


def _mask_records(t):
    """Mask records: every line with a status or tax pattern is masked, replaced, added to or ignored."""
    ten = lambda c: F.array(F.lit(10.0), F.lit(20.0), c, F.lit(60.0))
    b = t.boxes
    kind = F.col("line_index") % 7
    return b.filter(kind < 6).select(
        F.col("image_id"), F.col("line_index").alias("record_order"),
        F.when(kind == 3, F.concat(F.lit("__add_"), F.col("line_index"))).otherwise(F.col("line_index").cast("string")).alias("key"),
        (kind == 0).alias("masked"), F.lit(False).alias("deleted"), (kind == 1).alias("unreliable"), F.lit(None).cast("boolean").alias("exclude_from_loss"),
        (F.col("jitter_px") > 15).alias("drop_image"),
        F.when(kind == 2, ten(F.lit(2000.0))).alias("ignore_region"), F.when(kind == 3, ten(F.col("jitter_px") + 30)).alias("add_bbox"),
        F.when(kind == 4, ten(F.col("jitter_px") + 50)).alias("bbox"),
    )


def _masked(t):
    boxes = t.boxes.select("image_id", F.col("line_index").alias("valid_index"), g.yolo_to_box(*BOX).alias("box"))
    images = t.boxes.select("image_id", "width", "height").distinct()
    return ov.apply_label_masks(boxes, _mask_records(t), images)


@query("apply_label_masks", "JN-02", """with {boxes}, {corners}, k as (select *, line_index % 7 as kind from corners),
 own as (select image_id, line_index as valid_index, case kind when 4 then 10 else x1 end as bx1, case kind when 4 then 20 else y1 end as by1,
 case kind when 4 then jitter_px + 50 else x2 end as bx2, case kind when 4 then 60 else y2 end as by2 from k where kind not in (0, 1)),
 added as (select image_id, (select count(*) from boxes b where b.image_id = k.image_id) + row_number() over (partition by image_id order by line_index) - 1 as valid_index,
 10 as bx1, 20 as by1, jitter_px + 30 as bx2, 60 as by2 from k where kind = 3)
 select image_id, valid_index, round(bx1, 6) as x1, round(by1, 6) as y1, round(bx2, 6) as x2, round(by2, 6) as y2
 from (select * from own union all select * from added) u where bx2 - bx1 > 0.5 and by2 - by1 > 0.5""")
def _(t):
    return _masked(t)["boxes"].select("image_id", "valid_index", *[F.round(F.col("box")[k], 6).alias(k) for k in ("x1", "y1", "x2", "y2")])


@query("mask_regions", "JN-02", """with {boxes} select image_id, count(case when line_index % 7 = 2 then 1 end) as ignore_regions,
 bool_or(line_index % 7 < 6 and jitter_px > 15) as dropped from boxes group by image_id""")
def _(t):
    parts = _masked(t)
    regions = parts["ignore_regions"].groupBy("image_id").agg(F.count(F.lit(1)).alias("ignore_regions"))
    images = t.flat_boxes.select("image_id").distinct().join(regions, "image_id", "left").fillna(0, ["ignore_regions"])
    return images.join(parts["dropped"].withColumn("dropped", F.lit(True)), "image_id", "left").fillna({"dropped": False})


@query("assemble_samples", "JN-03", """with {boxes} select o_orderkey as image_id, o_orderpriority as marker, line_index, cx, cy from orders
 left join (select * from boxes where status <> 'F') b on image_id = o_orderkey""")
def _(t):
    images = t.table("orders").select(F.col("o_orderkey").alias("image_id"))
    notes = t.table("orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("marker"))
    labels = t.boxes.select("image_id", "line_index", "cx", "cy")
    masked = t.boxes.filter("status = 'F'").select("image_id", "line_index")
    return ov.assemble_samples(images, labels, notes, masked)


def _pixels(t):
    p = t.flat_boxes.select("root", "image_id", g.label_to_pixel_box(*BOX).alias("b"))
    return p.select("root", "image_id", "b.*")


@query("union_box", "AG-01", """with {boxes}, {rects}, {pixels} select image_id, min(ix1) as x1, min(iy1) as y1, max(ix2) as x2, max(iy2) as y2
 from pixels where ix2 > ix1 and iy2 > iy1 group by image_id""")
def _(t):
    return ov.union_boxes(_pixels(t), ["image_id"])


@query("common_roi", "AG-02", """with {boxes}, {rects}, {pixels}, u as (select min(ix1) as x1, min(iy1) as y1, max(ix2) as x2, max(iy2) as y2
 from pixels where ix2 > ix1 and iy2 > iy1)
 select x2 - x1 as roi_width, y2 - y1 as roi_height, (x1 + x2) // 2 as anchor_x, (y1 + y2) // 2 as anchor_y from u""")
def _(t):
    p = t.flat_boxes.select("image_id", g.label_to_pixel_box(*BOX).alias("b"))
    return ov.common_roi(ov.union_boxes(p.select("image_id", "b.*"), ["image_id"]))


@query("nonempty_labels", "FL-09", """with {boxes} select o_orderkey as sample_id, exists (select 1 from boxes where image_id = o_orderkey and status = 'F')
 or o_orderkey % 11 = 0 as has_label from orders""")
def _(t):
    samples = t.table("orders").select(F.concat(F.lit("r"), F.col("o_orderkey") % 4).alias("root"), F.col("o_orderkey").alias("sample_id"))
    lines = t.flat_boxes.filter("status = 'F'").select("root", F.col("image_id").alias("sample_id"))
    added = samples.filter("sample_id % 11 = 0")
    return ov.labelled(samples, lines, added).select("sample_id", "has_label")


@query("candidate_text", "FL-10", """with {scores} select sum((not target and has_candidate)::int)::bigint as text_distractors,
 sum((target and not has_candidate)::int)::bigint as positive_without_region from scores""")
def _(t):
    return t.scores.agg(
        F.count_if(~F.col("target") & F.col("has_candidate")).alias("text_distractors"),
        F.count_if(F.col("target") & ~F.col("has_candidate")).alias("positive_without_region"),
    )


def _split_half(t):
    rows = t.frames.withColumn("source_image", F.xxhash64("ocr_text").cast("string")).withColumn("source_image", F.col("ocr_text"))
    conv = F.col("video_id").cast("long")
    return rows.filter(conv % 2 == 0), rows.filter((conv % 2 == 1) | ((conv % 10 == 0) & (F.col("frame_index") < 2)))


@query("leak_report", "JN-08, SO-04", """with {frames}, a as (select * from frames where video_id::bigint % 2 = 0),
 b as (select * from frames where video_id::bigint % 2 = 1 or (video_id::bigint % 10 = 0 and frame_index < 2))
 select (select count(*) from (select root from a intersect select root from b)) as roots,
 (select count(*) from (select video_id, frame_index from a intersect select video_id, frame_index from b)) as video_frames,
 (select count(*) from (select ocr_text from a intersect select ocr_text from b)) as source_images""")
def _(t):
    return ov.assert_disjoint(*_split_half(t))


@query("manifest_join", "JN-11", """with {frames}, m as (select doc_id, avg(n_chars) as mean_chars from documents group by doc_id)
 select f.sample_id, f.segment_id, n_chars / 1000 as score_max, n_chars / 4000 as score_mean from frames f
 join documents d on d.doc_id = f.video_id::bigint * 8 + f.frame_index""")
def _(t):
    samples = t.frames.select("sample_id", "segment_id", (F.col("video_id").cast("long") * 8 + F.col("frame_index")).cast("string").alias("stem"))
    manifest = t.table("documents").select(
        F.col("doc_id").cast("string").alias("stem"), (F.col("n_chars") / 1000).alias("score_max"),
        (F.col("n_chars") / 4000).alias("score_mean"), F.col("doc_id").alias("position"),
    )
    return ov.manifest_join(samples, manifest).select("sample_id", "segment_id", "score_max", "score_mean")


@query("skip_existing", "JN-12", """with {frames}, h as (select * from frames order by sample_idx limit 300)
 select sample_id from h where sample_id not in (select sample_id from frames where frame_index = 0)""")
def _(t):
    done = t.frames.filter("frame_index = 0").select("sample_id")
    return ov.skip_existing(t.frames, done, "sample_id", "sample_idx", 300).select("sample_id")


@query("union_roots", "SO-01", """with {frames} select root, count(*) as samples, 256 as roi_width, 32 as roi_height from frames group by root""")
def _(t):
    sized = t.frames.withColumn("roi_width", F.lit(256)).withColumn("roi_height", F.lit(32))
    parts = [sized.filter(F.col("root") == f"r{k}") for k in range(4)]
    return ov.union_roots(parts).groupBy("root", "roi_width", "roi_height").agg(F.count(F.lit(1)).alias("samples"))


@query("dataset_summary", "AG-03", """with {frames}, s as (select *, segment_id like '%_s0' as dropped, 'k' || (frame_index % 3) as sample_type from frames)
 select root, sample_type, sum((not dropped)::int)::bigint as total, sum((not dropped and has_subtitle)::int)::bigint as positive,
 sum((not dropped and not has_subtitle)::int)::bigint as empty,
 round(coalesce(sum((not dropped and has_subtitle)::int) / nullif(sum((not dropped)::int), 0), 0), 6) as positive_ratio,
 round(coalesce(sum((not dropped and not has_subtitle)::int) / nullif(sum((not dropped)::int), 0), 0), 6) as empty_ratio,
 sum(dropped::int)::bigint as dropped from s group by grouping sets ((), (root), (sample_type))""")
def _(t):
    rows = t.frames.withColumn("dropped", F.col("segment_id").like("%_s0")).withColumn("sample_type", F.concat(F.lit("k"), F.col("frame_index") % 3))
    out = gp.dataset_summary(rows)
    return out.withColumn("positive_ratio", F.round("positive_ratio", 6)).withColumn("empty_ratio", F.round("empty_ratio", 6))


@query("segment_stats", "AG-04", """with {frames}, c as (select segment_id, count(*) as n from frames where has_subtitle group by segment_id)
 select count(*) as positive_segments, sum((n >= 2)::int)::bigint as repeated_positive_segments,
 sum(n * (n - 1) // 2)::bigint as same_segment_pairs from c""")
def _(t):
    return gp.segment_stats(t.frames)


_ADJ = """m as (select root, video_id, segment_id, lag(segment_id) over (partition by root, video_id order by frame_index, segment_id) as p
 from {src} where has_subtitle), adj as (select distinct root, video_id, least(p, segment_id) as left_segment,
 greatest(p, segment_id) as right_segment from m where p is not null and p <> segment_id)"""


@query("adjacent_segments", "WN-01", "with {frame_events}, " + _ADJ.replace("{src}", "frame_events") + " select * from adj")
def _(t):
    return sg.adjacent_segments(t.frame_events)


@query("adjacent_segment_sets", "WN-01", "with {frames}, " + _ADJ.replace("{src}", "frames") + """, e as (select root, video_id, left_segment as segment_id,
 right_segment as nb from adj union all select root, video_id, right_segment, left_segment from adj)
 select f.sample_id, string_agg(nb, ',' order by nb) as neighbours from frames f join e using (root, video_id, segment_id)
 where f.has_subtitle group by f.sample_id""")
def _(t):
    edges = sg.adjacency_edges(t.frames)
    sets = edges.groupBy("root", "video_id", "segment_id").agg(F.array_join(F.array_sort(F.collect_set("neighbour")), ",").alias("neighbours"))
    return t.frames.filter("has_subtitle").join(sets, ["root", "video_id", "segment_id"]).select("sample_id", "neighbours")


def _run_items(t):
    return t.frame_events.withColumn("note", F.when(F.col("sample_idx") % 13 == 0, F.concat(F.lit("n"), F.col("sample_idx"))).otherwise(""))


_RUNS_SQL = """k as (select root, sample_idx, has_subtitle, case when has_subtitle then segment_id end as key,
 case when sample_idx % 13 = 0 then 'n' || sample_idx else '' end as note from frame_events),
 l as (select *, lag(sample_idx) over w is null or key is distinct from lag(key) over w as start from k window w as (partition by root order by sample_idx)),
 n as (select *, sum(start::int) over w as run, sum((start and not has_subtitle)::int) over w as no from l window w as (partition by root order by sample_idx)),
 runs as (select root, run::bigint as run, coalesce(max(key), '__no_subtitle_' || max(no)::bigint || '__') as segment_id, not bool_or(has_subtitle) as no_subtitle,
 count(*) as count, case when bool_or(has_subtitle) then coalesce(arg_min(note, sample_idx) filter (note <> ''), '') else '' end as note,
 min(sample_idx) as first_idx from n group by root, run)"""


@query("segment_runs", "WN-02", "with {frame_events}, " + _RUNS_SQL + " select * from runs")
def _(t):
    return sg.segment_runs(_run_items(t), 1024)


@query("split_segment", "WN-05", """with {frames}, cuts as (select root, segment_id, sample_idx as cut, sample_id as base from frames
 where has_subtitle and frame_index % 4 = 3) select f.sample_id, coalesce(case when has_subtitle and f.sample_idx >= cut then base end, f.segment_id) as segment_id
 from frames f left join cuts c on f.root = c.root and f.segment_id = c.segment_id""")
def _(t):
    cuts = t.frames.filter("has_subtitle and frame_index % 4 = 3").select("root", "sample_id")
    return sg.split_segments(t.frames, cuts).select("sample_id", "segment_id")


@query("rename_segment", "WN-06", """with {frames} select sample_id, case when has_subtitle and frame_index % 4 < 2 and video_id::bigint % 2 = 0
 then 'renamed-' || segment_id else segment_id end as segment_id from (select *, 1 as one from frames) f""".replace("frame_index % 4 < 2", "frame_index // 2 % 2 = 0"))
def _(t):
    conv = F.col("video_id").cast("long")
    names = t.frames.filter((F.floor(F.col("frame_index") / 2) % 2 == 0) & (conv % 2 == 0)).select(
        "root", F.col("segment_id").alias("old"), F.concat(F.lit("renamed-"), F.col("segment_id")).alias("new")
    ).distinct()
    return sg.rename_segments(t.frames, names).select("sample_id", "segment_id")


_MD5 = "cast(('0x' || substr(md5(root || '/' || {id}), 1, 8)) as bigint)"


def _spread_sql(source="frames", ident="sample_id"):
    return f"s as (select *, {_MD5.format(id=ident)} as spread from {source})"


@query("spread_order", "WN-07", "with {frames}, " + _spread_sql() + " select sample_id, row_number() over (order by spread, sample_idx) - 1 as position from s")
def _(t):
    return sp.spread_order(t.frames, sp.md5_hash).select("sample_id", "position")


@query("spread_order_crc", "WN-07")
def _(t):
    return sp.spread_order(t.frames).select("root", "sample_id", "spread", "position")


_LIMIT_CLASS = """c as (select sum(has_subtitle::int) as a, sum((not has_subtitle)::int) as b from frames),
 k as (select least(a, {p}) as ta, least(b, {e}) as tb, a, b from c),
 k2 as (select ta + least(a - ta, {m} - ta - tb) as qa, tb, b, {m} - ta - tb - least(a - ta, {m} - ta - tb) as left_over from k),
 k3 as (select qa, tb + least(b - tb, left_over) as qb from k2)"""


@query("limit_by_class", "WN-08", "with {frames}, " + _spread_sql() + ", " + _LIMIT_CLASS.format(p=120, e=80, m=200) + """,
 r as (select *, row_number() over (partition by has_subtitle order by spread, sample_idx) as rn from s)
 select sample_id, has_subtitle from r, k3 where rn <= case when has_subtitle then qa else qb end""")
def _(t):
    return sp.limit_by_class(t.frames, 200, 0.4, sp.md5_hash).select("sample_id", "has_subtitle")


_BALANCED = "with {frames}, " + _spread_sql() + ", " + _LIMIT_CLASS.format(p=150, e=50, m=200) + """,
 r as (select *, row_number() over (partition by root, has_subtitle order by spread, sample_idx) as rr from s),
 t as (select *, row_number() over (partition by has_subtitle order by rr, root) - 1 as turn from r),
 chosen as (select sample_id, has_subtitle, turn from t, k3 where turn < case when has_subtitle then qa else qb end)"""


@query("limit_root_balanced", "WN-09", _BALANCED + " select * from chosen")
def _(t):
    return sp.limit_root_balanced(t.frames, 200, 0.25, "has_subtitle", sp.md5_hash).select("sample_id", "has_subtitle", "turn")


@query("interleave_classes", "WN-10", _BALANCED + """, z as (select sum(has_subtitle::int) as l, sum((not has_subtitle)::int) as e from chosen),
 p as (select *, greatest(1, l // greatest(1, e)) as gap from chosen, z),
 q as (select *, case when has_subtitle then turn when (turn + 1) * gap - 1 < l then (turn + 1) * gap - 1 else l + turn end as k1,
 case when not has_subtitle and (turn + 1) * gap - 1 < l then 1 else 0 end as k2 from p)
 select sample_id, row_number() over (order by k1, k2) - 1 as position from q""")
def _(t):
    chosen = sp.limit_root_balanced(t.frames, 200, 0.25, "has_subtitle", sp.md5_hash)
    return sp.interleave_classes(chosen, "has_subtitle").select("sample_id", "position")


@query("limit_segment_aware", "WN-11", "with {frames}, " + _spread_sql() + """, g as (select segment_id, count(*) as size, min(sample_idx) as head_idx,
 arg_min(root, sample_idx) as root from s where has_subtitle group by segment_id),
 h as (select *, """ + _MD5.format(id="segment_id") + """ as gs from g),
 i as (select *, coalesce(sum(size) over (partition by size >= 2 order by gs, head_idx rows between unbounded preceding and 1 preceding), 0) as start from h),
 j as (select *, case when size >= 2 then case when least(size, 101 - start) = 1 then 0 else greatest(0, least(size, 101 - start)) end end as grant_n from i),
 k as (select *, case when size >= 2 then grant_n else (start < 101 - (select sum(grant_n) from j))::int end as take from j),
 r as (select s.*, row_number() over (partition by has_subtitle, case when has_subtitle then s.segment_id end order by spread, sample_idx) as rn from s),
 u as (select r.*, coalesce(rn <= case when has_subtitle then take else 49 end, false) as chosen from r left join k on r.segment_id = k.segment_id),
 v as (select *, row_number() over (partition by chosen order by spread, sample_idx) as rest, sum(chosen::int) over () as picked from u)
 select sample_id, has_subtitle, segment_id from v where chosen or rest <= 150 - picked""")
def _(t):
    return sp.limit_segment_aware(t.frames, 150, 49 / 150, sp.md5_hash).select("sample_id", "has_subtitle", "segment_id")


@query("domain_interleave", "WN-12", """with {frames}, k as (select *, case when has_subtitle then 'full_frame' else 'roi' end as sample_type from frames),
 r as (select *, row_number() over (partition by sample_type order by sample_idx) as turn from k),
 e as (select sample_id, sample_type, turn, (sample_type = 'roi')::int as kind, 0 as crop_view from r
 union all select sample_id, 'random_crop', turn, 2, v from r, (select unnest([0, 1]) as v) where sample_type = 'full_frame'),
 p as (select *, row_number() over (order by turn, kind, crop_view) - 1 as position from e)
 select sample_id, sample_type, crop_view, position from p where position < 700""")
def _(t):
    kinds = t.frames.withColumn("sample_type", F.when(F.col("has_subtitle"), "full_frame").otherwise("roi"))
    return sp.domain_interleave(kinds, 2, 700).select("sample_id", "sample_type", "crop_view", "position")


@query("assign_donors", "JN-09")
def _(t):
    return sp.assign_donors(t.frames)


@query("synthetic_plan", "JN-14")
def _(t):
    orders = t.table("orders").select("o_orderkey", (640 + F.col("o_custkey") % 1280).alias("width"), (360 + F.col("o_custkey") % 720).alias("height"))
    backgrounds = with_rank(orders, ["o_orderkey"], index_block(F.col("o_orderkey")), (), "at").select(
        "at", F.concat(F.lit("bg"), F.col("o_orderkey")).alias("image"), "width", "height"
    )
    lines = with_rank(t.frames, ["sample_idx"], index_block(F.col("sample_idx")), (), "at").select(
        "at", F.col("ocr_text").alias("subtitle"), (F.length("ocr_text") * 8).alias("text_width"), F.lit(40).alias("text_height")
    )
    return sp.synthetic_plan(backgrounds, lines, t.table("orders").count(), seed=7)


@query("cap_kept_per_video", "SL-01", """with {frame_events}, r as (select *, row_number() over (partition by video_id order by frame_index) as rn
 from frame_events where has_subtitle) select video_id, frame_index, sample_id from r where rn <= 20""")
def _(t):
    ranked = with_rank(t.frame_events.filter("has_subtitle"), ["frame_index"], dense_block(F.col("frame_index")), ["video_id"], "kept_before")
    return ranked.filter("kept_before < 20").select("video_id", "frame_index", "sample_id")


@query("first_samples", "SL-04", "with {frames} select sample_id from frames order by sample_idx limit 32")
def _(t):
    return t.frames.orderBy("sample_idx").limit(32).select("sample_id")


@query("score_map_stats", "AG-29", """select vec_id, round(list_max(embedding)::double, 6) as score_max,
 round(list_avg(cast(embedding as double[])), 6) as score_mean from embeddings""")
def _(t):
    return t.table("embeddings").select("vec_id", map_stats(F.col("embedding")).alias("s")).select(
        "vec_id", F.round("s.score_max", 6).alias("score_max"), F.round("s.score_mean", 6).alias("score_mean")
    )


@query("normalize_text", "TX-01")
def _(t):
    return t.frames.select("sample_id", normalize_text(F.col("ocr_text")).alias("norm_text"))
