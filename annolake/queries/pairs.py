"""Pair mining, text similarity, schedules and batch plans."""

from pyspark.sql import functions as F

from annolake.functions import text as tx
from annolake.operators import batches as bt
from annolake.operators import pairs as pr
from annolake.operators import segments as sg
from annolake.operators.similarity import local_alignment, unit_tokens
from annolake.plans import geometry_plan as gp
from annolake.plans import schedule as sc
from annolake.queries.registry import query
from annolake.queries.samples import _ADJ, BOX
from annolake.functions.geometry import yolo_to_box
from annolake.operators.filters import usable_box

_NORM = "regexp_replace(replace(lower(ocr_text), 'ß', 'ss'), '[\\s\\p{P}\\p{S}]', '', 'g')"
_CHARS = "list_distinct(string_split({x}, ''))"
_JACCARD = ("len(list_intersect(" + _CHARS.format(x="{a}") + ", " + _CHARS.format(x="{b}") + ")) / greatest(1, len(list_distinct(list_concat("
            + _CHARS.format(x="{a}") + ", " + _CHARS.format(x="{b}") + "))))")


@query("positive_pairs", "JN-04", """with {frames} select a.sample_idx as i, b.sample_idx as j, true as same, 'local' as source
 from frames a join frames b on a.root = b.root and a.segment_id = b.segment_id and a.sample_idx < b.sample_idx
 where a.has_subtitle and b.has_subtitle""")
def _(t):
    return pr.positive_pairs(t.frames)


@query("positive_pool", "JN-04", """with {frame_events} select root, segment_id, count(*) as members, count(*) * (count(*) - 1) // 2 as pairs
 from frame_events where has_subtitle group by root, segment_id""")
def _(t):
    return pr.positive_pool(t.frame_events)


@query("local_negative_pairs", "JN-05", "with {frames}, " + _ADJ.replace("{src}", "frames") + ", n as (select *, " + _NORM + """ as norm from frames where has_subtitle)
 select least(a.sample_idx, b.sample_idx) as i, greatest(a.sample_idx, b.sample_idx) as j, false as same, 'local' as source
 from adj join n a on a.root = adj.root and a.video_id = adj.video_id and a.segment_id = left_segment
 join n b on b.root = adj.root and b.video_id = adj.video_id and b.segment_id = right_segment
 where not (a.norm <> '' and b.norm <> '' and (a.norm = b.norm or (length(a.norm) >= 4 and length(b.norm) >= 4 and """
       + _JACCARD.format(a="a.norm", b="b.norm") + " >= 0.9)))")
def _(t):
    return pr.local_negative_pairs(t.frames)


@query("ocr_negative_pairs", "JN-06")
def _(t):
    return pr.ocr_negatives_in_order(t.frames, 400, 0.6)


@query("pair_selection", "JN-07")
def _(t):
    return pr.select_pairs(t.frames, maximum=0.6)[0]


@query("pair_selection_counts", "JN-07")
def _(t):
    return pr.select_pairs(t.frames, maximum=0.6)[1]


_BUDGET = "with {frame_events}, c as (select root, count(*) as n, sum((segment_id = 'view')::int) as v from frame_events group by root) select root, "


@query("max_ocr_negatives", "SL-02", _BUDGET + """cast(case when v > 0 then greatest(1, round_even(v * 0.3 / (1 - 0.3), 0)) when n > 0
 then greatest(1, round_even(n * 0.3, 0)) else 0 end as bigint) as budget, cast(greatest(1, round_even(n * 0.3, 0)) as bigint) as without_local from c""")
def _(t):
    c = t.frame_events.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("segment_id") == "view").alias("v"))
    return c.select("root", pr.max_ocr_negatives(F.col("v"), F.col("n"), 0.3).alias("budget"), pr.max_ocr_negatives(F.lit(0), F.col("n"), 0.3).alias("without_local"))


@query("negative_budget", "SL-03", _BUDGET + """cast(case when v <= 0 then 0 else greatest(0, round_even(n * 0.4 / (1 - 0.4), 0)) end as bigint) as budget,
 cast(v as bigint) as whole_pool from c""")
def _(t):
    c = t.frame_events.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("segment_id") == "view").alias("v"))
    return c.select("root", pr.negative_budget(F.col("n"), 0.4, F.col("v")).alias("budget"), pr.negative_budget(F.col("n"), 1.0, F.col("v")).alias("whole_pool"))


@query("sample_with_refill", "SL-05")
def _(t):
    return pr.sample_with_refill(t.frames.select("sample_idx", "sample_id"), ["sample_idx"], 2 * t.frames.count() + 17, 7, 1)


@query("rank_addressed_sample", "SL-06")
def _(t):
    return pr.ocr_negative_sample(t.frames, 300, 0.6, 7, 1)


@query("distinct_pairs", "SO-02", """with {pairs} select least(left_id, right_id) as i, greatest(left_id, right_id) as j, same, source from pairs""")
def _(t):
    p = t.pairs.select(F.col("left_id").alias("i"), F.col("right_id").alias("j"), "same", "source")
    back = p.select(F.col("j").alias("i"), F.col("i").alias("j"), "same", "source")
    return pr.distinct_pairs(p.unionByName(back))


@query("except_local", "SO-03", "with {pairs} select left_id as i, right_id as j from pairs where source = 'ocr'")
def _(t):
    p = t.pairs.select(F.col("left_id").alias("i"), F.col("right_id").alias("j"), "source")
    return pr.except_local(p.drop("source"), p.filter("source = 'local'"))


@query("widest_pairs", "WN-13", """with {frame_events}, f as (select *, case when sample_idx % 5 <> 0 and root <> 'u3' then frame_index end as known from frame_events),
 e as (select root, segment_id, min(known) as lo, max(known) as hi, count(known) as timed, count(*) as n from f where has_subtitle group by all)
 select root, segment_id, cast(case when timed > 1 then hi - lo else 0 end as bigint) as span from e where n > 1""")
def _(t):
    unknown = (F.col("sample_idx") % 5 == 0) | (F.col("root") == "u3")
    frames = t.frame_events.withColumn("frame_index", F.when(~unknown, F.col("frame_index")))
    return pr.widest_pair_per_segment(frames).select("root", "segment_id", F.col("span").cast("long").alias("span"))


@query("rank_local_negatives", "WN-14")
def _(t):
    ranked = pr.rank_local_negatives(pr.local_negative_pairs(t.frames), t.frames, 7, 1, 200)
    return pr.top_local_negatives(ranked, 200)


@query("hardest_local_negatives", "WN-14")
def _(t):
    return pr.hardest_local_negatives(t.frames, 200, 7, 1).select("i", "j", F.round("overlap", 9).alias("overlap"), "span")


@query("similar_candidates", "WN-03")
def _(t):
    return sg.similar_candidates(_with_text(t), 0.6, 3)


def _with_text(t):
    """Frames that show the text of the odd frame before them, across the border of segments; some with a letter more."""
    shown = F.when(F.col("frame_index") % 2 == 0, F.col("frame_index") - 1).otherwise(F.col("frame_index"))
    texts = t.frames.select("root", "video_id", F.col("frame_index").alias("_shown"), F.col("ocr_text").alias("_text"))
    frames = t.frames.withColumn("_shown", shown).join(texts, ["root", "video_id", "_shown"], "left")
    text = F.concat(F.coalesce("_text", "ocr_text"), F.when(F.col("frame_index") % 4 == 0, "x").otherwise(""))
    return frames.withColumn("ocr_text", text).withColumn("norm_text", tx.strip_casefold(F.col("ocr_text"))).drop("_shown", "_text")


@query("merge_exact_text", "WN-04")
def _(t):
    return sg.merge_exact_text(_with_text(t)).select("root", "sample_id", "segment_id")


@query("merge_exact_notes", "WN-04")
def _(t):
    return sg.merge_exact_text(_with_text(t).withColumn("note", F.lit(""))).select("root", "sample_id", "segment_id", "note")


@query("exact_text_merges", "WN-04")
def _(t):
    return sg.exact_text_merges(_with_text(t))


@query("merge_to_previous", "WN-06")
def _(t):
    chosen = t.frames.filter("has_subtitle and frame_index = 4").select("root", "sample_id")
    return sg.merge_to_previous(t.frames.withColumn("note", F.lit("")), chosen).select("root", "sample_id", "segment_id")


@query("merge_pairs", "WN-06")
def _(t):
    later = t.frames.filter("has_subtitle and frame_index = 2").select("root", "video_id", F.col("sample_id").alias("right_id"), F.col("sample_idx").alias("position"))
    first = t.frames.filter("has_subtitle and frame_index = 1").select("root", "video_id", F.col("sample_id").alias("left_id"))
    return sg.merge_pairs(t.frames, first.join(later, ["root", "video_id"]).drop("video_id")).select("root", "sample_id", "segment_id")


def _text_pairs(t):
    """Whole normalised texts of consecutive frames."""
    f = t.frames.withColumn("norm_text", tx.normalize_text(F.col("ocr_text"))).select("root", "sample_idx", "sample_id", "norm_text", "has_subtitle", "segment_id", "ocr_text")
    return sg.neighbours(f).select("sample_id", F.col("prev_norm_text").alias("a"), F.col("norm_text").alias("b"))


_TEXT_PAIRS = "with {frames}, n as (select *, " + _NORM + """ as norm from frames), p as (select sample_id, norm as b, has_subtitle,
 lag(norm) over w as a, lag(has_subtitle) over w as prev from n window w as (partition by root order by sample_idx)),
 text_pairs as (select sample_id, a, b from p where has_subtitle and prev)"""


@query("text_jaccard", "TX-03", _TEXT_PAIRS + " select sample_id, round(" + _JACCARD.format(a="a", b="b") + ", 6) as jaccard from text_pairs")
def _(t):
    return _text_pairs(t).select("sample_id", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("text_similarity", "TX-03")
def _(t):
    return _text_pairs(t).select("sample_id", tx.text_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("similarity_at_most", "TX-04")
def _(t):
    return _text_pairs(t).select("sample_id", tx.similarity_at_most(F.col("a"), F.col("b"), 0.6).alias("unlike"))


@query("is_same_text", "TX-05")
def _(t):
    return _text_pairs(t).select("sample_id", tx.is_same_text(F.col("a"), F.col("b")).alias("same"))


@query("edit_distance", "TX-06", _TEXT_PAIRS + """ select sample_id, least(9, levenshtein(a, b)) as distance from text_pairs""")
def _(t):
    return _text_pairs(t).select("sample_id", tx.capped_edit_distance(F.col("a"), F.col("b"), 9).cast("long").alias("distance"))


@query("near_duplicates", "TX-07")
def _(t):
    return _text_pairs(t).select("sample_id", tx.is_near_duplicate(F.col("a"), F.col("b"), 0.5).alias("near"))


@query("strip_casefold", "TX-02", "with {frames} select sample_id, regexp_replace(replace(lower(ocr_text), 'ß', 'ss'), '\\s', '', 'g') as text from frames")
def _(t):
    return t.frames.select("sample_id", tx.strip_casefold(F.col("ocr_text")).alias("text"))


@query("normalize_text_full", "TX-01", "with {frames} select sample_id, " + _NORM + " as text from frames")
def _(t):
    return t.frames.select("sample_id", tx.normalize_text(F.col("ocr_text")).alias("text"))


@query("item_text", "TX-08", """with {frames} select sample_id, coalesce(nullif(case when frame_index % 2 = 0 then '' else video_id end, ''),
 nullif(case when frame_index % 3 = 0 then ocr_text end, ''), '') as text from frames""")
def _(t):
    return t.frames.select("sample_id", tx.first_text(
        F.when(F.col("frame_index") % 2 == 0, "").otherwise(F.col("video_id")), F.when(F.col("frame_index") % 3 == 0, F.col("ocr_text"))).alias("text"))


_ALIGN = """with {pairs}, tok as (select vec_id, i as pos, [x / sqrt(list_sum([y * y for y in v])) for x in v] as u from
 (select vec_id, i, cast(embedding[i * 8 + 1 : i * 8 + 8] as double[]) as v from embeddings, (select unnest(range(8)) as i))),
 sim as (select p.left_id, p.right_id, a.pos as lp, b.pos as rp, list_dot_product(a.u, b.u) - 0.02 * abs(a.pos - b.pos) as s
 from pairs p join tok a on a.vec_id = p.left_id join tok b on b.vec_id = p.right_id and abs(a.pos - b.pos) <= 3),
 best as (select left_id, right_id, 0 as side, lp as pos, max(s) as s from sim group by all union all
 select left_id, right_id, 1, rp, max(s) from sim group by all),
 r as (select *, row_number() over (partition by left_id, right_id, side order by s) as rn from best),
 d as (select left_id, right_id, side, 0.6 * avg(s) + 0.4 * avg(case when rn <= 2 then s end) as v from r group by all)
 select left_id, right_id, round(avg(v), 6) as similarity from d group by all"""


@query("local_alignment", "AR-03", _ALIGN)
def _(t):
    tokens = t.table("embeddings").select("vec_id", unit_tokens(F.col("embedding"), 8, 8).alias("tokens"))
    side = lambda p: tokens.select(F.col("vec_id").alias(f"{p}_id"), F.col("tokens").alias(f"{p}_tokens"))
    both = t.pairs.select("left_id", "right_id").join(side("left"), "left_id").join(side("right"), "right_id")
    return both.select("left_id", "right_id", F.round(local_alignment(F.col("left_tokens"), F.col("right_tokens"), 8), 6).alias("similarity"))


@query("positive_pair_selection", "GM-08")
def _(t):
    return sc.select_positive_pairs(t.frame_events, 7, 1)


@query("pack_pair_batches", "GM-09")
def _(t):
    return sc.pack_pair_batches(t.pairs.select(F.col("left_id").alias("i"), F.col("right_id").alias("j"), "same", "source"), 16, 8, 7, 1)


@query("batch_members", "GM-09")
def _(t):
    pairs = t.pairs.select(F.col("left_id").alias("i"), F.col("right_id").alias("j"), "same", "source")
    return sc.batch_members(sc.pack_pair_batches(pairs, 16, 8, 7, 1)).select("batch_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("pair_epoch_schedule", "GM-10")
def _(t):
    return sc.pair_epoch_schedule(t.frames, 32, 7, 1, maximum=0.6)


@query("schedule_stats", "AG-30")
def _(t):
    return sc.schedule_stats(sc.pair_epoch_schedule(t.frames, 32, 7, 1, maximum=0.6), t.frames)


@query("balanced_batches", "GM-11")
def _(t):
    return bt.balanced_batches(t.frame_events, 32, 0.4, 7, 1)


@query("segment_paired_batches", "GM-12")
def _(t):
    return bt.segment_paired_batches(t.frames, 16, 0.25, 7, 1)


def _geometry_items(t, views=1):
    """Label boxes (status F; the others are ignored boxes, so images without a label are negatives) as full frames, ROI samples (order keys divisible by three) and crop views of the full frames."""
    box = yolo_to_box(*BOX)
    kept = t.flat_boxes.withColumn("box", box).filter(usable_box(F.col("box")))
    of = lambda status: F.array_sort(F.collect_list(F.when(status, F.col("box"))))
    labelled = F.coalesce(F.col("status") == "F", F.lit(False))
    images = kept.groupBy("root", "image_id").agg(of(labelled).alias("boxes"), of(~labelled).alias("ignored_boxes"))
    every = t.flat_boxes.select("root", "image_id", "width", "height").distinct().join(images, ["root", "image_id"], "left")
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    every = every.withColumns({c: F.coalesce(c, none) for c in ("boxes", "ignored_boxes")})
    kinds = F.when(F.col("image_id") % 3 == 0, F.array(F.lit("roi"))).otherwise(F.array(*[F.lit("full_frame")] + [F.lit("random_crop")] * views))
    out = every.select("*", F.posexplode(kinds).alias("crop_view", "sample_type"))
    return out.withColumn("sample_id", F.col("image_id").cast("string")).withColumn("image_path", F.concat(F.lit("images/"), "image_id", F.lit(".jpg")))


def _geometry(t):
    return gp.epoch_geometry_plan(_geometry_items(t), 0.25, 8.0, True, 7, 1)


@query("random_crop_plan", "GM-15")
def _(t):
    return gp.random_crop_plan(_geometry_items(t), (0.3, 0.9), 7, 1).select("root", "sample_id", "crop_view", "crop.*")


@query("epoch_geometry_plan", "GM-16")
def _(t):
    return _geometry(t).select("root", "item_id", "sample_type", "has_subtitle", "resize_scale", "output_width", "output_height", "standard_short_edge", "protection_satisfied")


@query("data_manifest", "IO-16")
def _(t):
    files = t.table("orders").select(
        F.concat(F.lit("images/"), "o_orderkey", F.lit(".jpg")).alias("image_path"), F.col("o_totalprice").cast("long").alias("length"), F.col("o_orderdate").alias("modified"))
    return gp.data_manifest(_geometry(t), files)


@query("small_subtitle_summary", "AG-28", """with {boxes}, w as (select 'p' || l_orderkey % 100 as image_path, image_id as sample_id, h * 100 >= 5 as ok
 from boxes join (select distinct l_orderkey from lineitem) on image_id = l_orderkey where h * 100 < 10)
 select count(*) as warning_events, count(distinct (image_path, sample_id)) as unique_warning_samples, sum((not ok)::int)::bigint as unsatisfied_events from w""")
def _(t):
    w = t.flat_boxes.filter("h * 100 < 10").select(
        F.concat(F.lit("p"), F.col("image_id") % 100).alias("image_path"), F.col("image_id").alias("sample_id"), (F.col("h") * 100 >= 5).alias("protection_satisfied"))
    return gp.small_subtitle_summary(w)


@query("mixed_macro_batches", "GM-13")
def _(t):
    items = _geometry(t).select(F.concat_ws("/", "root", "item_id").alias("item"), "sample_type", "has_subtitle", "output_width", "output_height")
    return bt.mixed_macro_batches(items, 64, 7, 1)


@query("micro_batches", "GM-14", """with m as (select o_orderkey as item, o_orderkey // 64 as batch, (o_custkey % 3 * 16 + 64)::int as output_width, 32 as output_height from orders),
 g as (select batch, output_width, output_height, min(item) as f, count(*) as items, string_agg(item, ',' order by item) as members from m group by all)
 select batch, output_width, output_height, items, members, row_number() over (partition by batch order by f) - 1 as micro from g""")
def _(t):
    macro = t.table("orders").select(
        F.col("o_orderkey").alias("item"), F.floor(F.col("o_orderkey") / 64).alias("batch"),
        (F.col("o_custkey") % 3 * 16 + 64).cast("int").alias("output_width"), F.lit(32).alias("output_height"))
    out = bt.micro_batches(macro)
    return out.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))
