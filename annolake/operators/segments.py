"""Runs, adjacency and review actions over ordered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.functions import text as tx
from annolake.operators.ordered import dense_block, index_block, running_sums, with_previous
from annolake.session import checkpointed

POSITIVE = "has_subtitle"


def adjacent_segments(samples: DataFrame) -> DataFrame:
    """Distinct unordered neighbours in each (root, video) timeline of positive frames."""
    timeline = samples.filter(F.col(POSITIVE) & F.col("video_id").isNotNull() & F.col("frame_index").isNotNull())
    # Copies of one (frame, segment) change nothing; drop them before the ordered pass.
    points = timeline.select("root", "video_id", "frame_index", "segment_id").distinct()
    moves = with_previous(
        points, ["frame_index", "segment_id"], ["segment_id"], ["root", "video_id"], dense_block(F.col("frame_index"))
    ).filter(F.col("prev_segment_id").isNotNull() & (F.col("prev_segment_id") != F.col("segment_id")))
    return moves.select(
        "root", "video_id",
        F.least("prev_segment_id", "segment_id").alias("left_segment"),
        F.greatest("prev_segment_id", "segment_id").alias("right_segment"),
    ).distinct()


def adjacency_edges(samples: DataFrame) -> DataFrame:
    """Both directions of the neighbour relation: one row per (root, video, segment, neighbour)."""
    pairs = adjacent_segments(samples)
    forward = pairs.select("root", "video_id", F.col("left_segment").alias("segment_id"), F.col("right_segment").alias("neighbour"))
    back = pairs.select("root", "video_id", F.col("right_segment").alias("segment_id"), F.col("left_segment").alias("neighbour"))
    return forward.unionByName(back)


def segment_runs(items: DataFrame, block_rows: int = 65_536) -> DataFrame:
    """Gaps and islands over each root's item order; empty runs are numbered per root."""
    key = F.when(F.col(POSITIVE), F.col("segment_id"))
    keyed = items.select("root", "sample_idx", POSITIVE, key.alias("_key"), "note")
    block = index_block(F.col("sample_idx"), block_rows)
    seen = with_previous(keyed, ["sample_idx"], [POSITIVE, "_key"], ["root"], block)
    starts = F.col("prev_" + POSITIVE).isNull() | ~F.col("_key").eqNullSafe(F.col("prev__key"))
    seen = seen.withColumn("_start", starts.cast("long")).withColumn(
        "_empty", (starts & ~F.col(POSITIVE)).cast("long")
    )
    numbered = running_sums(
        seen, ["sample_idx"], {"_runs": F.col("_start"), "_empties": F.col("_empty")}, ["root"], block
    )
    numbered = numbered.withColumn("run", F.col("_runs") + F.col("_start")).withColumn("_no", F.col("_empties") + F.col("_empty"))
    first_note = F.min_by(F.when(F.col("note") != "", F.col("note")), F.when(F.col("note") != "", F.col("sample_idx")))
    runs = numbered.groupBy("root", "run").agg(
        F.first(POSITIVE).alias(POSITIVE), F.first("_key").alias("_key"), F.first("_no").alias("_no"),
        F.count(F.lit(1)).alias("count"), first_note.alias("_note"), F.min("sample_idx").alias("first_idx"),
    )
    empty_name = F.concat(F.lit("__no_subtitle_"), F.col("_no"), F.lit("__"))
    return runs.select(
        "root", "run", F.coalesce("_key", empty_name).alias("segment_id"), (~F.col(POSITIVE)).alias("no_subtitle"),
        "count", F.when(F.col(POSITIVE), F.coalesce("_note", F.lit(""))).otherwise("").alias("note"), "first_idx",
    )


def neighbours(items: DataFrame) -> DataFrame:
    """Each positive item with the item right before it when that one is positive too."""
    fields = ["sample_id", POSITIVE, "segment_id", "ocr_text", "norm_text"]
    seen = with_previous(items, ["sample_idx"], fields, ["root"], index_block(F.col("sample_idx")))
    return seen.filter(F.col(POSITIVE) & F.coalesce(F.col("prev_" + POSITIVE), F.lit(False)))


def similar_candidates(items: DataFrame, ratio: float = tx.NEAR_RATIO, tolerance: int = tx.NEAR_DISTANCE) -> DataFrame:
    """Consecutive positive items of different segments whose texts are equal or nearly so."""
    left, right = F.col("prev_norm_text"), F.col("norm_text")
    pairs = neighbours(items).filter((left != "") & (right != "") & (F.col("prev_segment_id") != F.col("segment_id")))
    distance = F.levenshtein(left, right, tolerance)
    # Far pairs cannot become candidates: they leave before the ratio is computed.
    close = pairs.filter((left == right) | (distance >= 0)).withColumn("similarity", tx.matching_ratio(left, right))
    exact = left == right
    hits = close.filter(exact | tx.is_near_duplicate(left, right, ratio, tolerance, F.col("similarity")))
    return hits.select(
        "root", F.col("prev_sample_id").alias("left_id"), F.col("sample_id").alias("right_id"),
        F.col("prev_segment_id").alias("left_segment_id"), F.col("segment_id").alias("right_segment_id"),
        left.alias("left_text"), right.alias("right_text"),
        F.when(exact, "exact").otherwise("text-near").alias("match_type"),
        F.round("similarity", 4).alias("similarity"),
        tx.capped_edit_distance(left, right, tolerance + 1).alias("edit_distance"),
    )


def min_label_components(edges: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """Connected components: each vertex gets the smallest ``rank`` it can reach (pointer doubling per round).

    ``edges``: by, a, b (ids); ``vertices``: by, id, rank. State is checkpointed each round so lineage stays short.
    """
    both = edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    vertices = checkpointed(vertices)
    labels = checkpointed(vertices.select(*by, "id", F.col("rank").alias("label")))
    while True:
        reached = both.join(labels.withColumnRenamed("id", "b"), [*by, "b"]).select(*by, F.col("a").alias("id"), "label")
        lower = labels.unionByName(reached).groupBy(*by, "id").agg(F.min("label").alias("label"))
        # Jump to the label of the vertex that owns the current label.
        owner = vertices.select(*by, F.col("id").alias("_owner"), F.col("rank").alias("label"))
        jump = lower.withColumnRenamed("label", "_far").withColumnRenamed("id", "_owner")
        jumped = lower.join(owner, [*by, "label"]).join(jump, [*by, "_owner"]).select(
            *by, "id", F.least("label", "_far").alias("label")
        )
        jumped = checkpointed(jumped)
        changed = jumped.join(labels.withColumnRenamed("label", "_old"), [*by, "id"]).filter("label <> _old")
        labels, done = jumped, changed.isEmpty()
        if done:
            return labels


#: What a sample without a note gets when its segment is merged by text.
MERGED_BY_TEXT = "merged by exact OCR text"


def _text_events(items: DataFrame) -> DataFrame:
    """Consecutive positive items of different segments with one text, as events: the first of each pair of segments."""
    pairs = neighbours(items).filter(
        (F.col("norm_text") != "") & (F.col("prev_norm_text") == F.col("norm_text")) & (F.col("prev_segment_id") != F.col("segment_id"))
    )
    return pairs.groupBy("root", F.col("prev_segment_id").alias("into"), F.col("segment_id").alias("source")).agg(F.min("sample_idx").alias("at"))


def merge_exact_text(items: DataFrame) -> DataFrame:
    """Merge a segment into the one before it wherever consecutive positive items carry the same text.

    Items are walked in order and a merge renames the whole later segment, so it carries everything merged before it. Only the
    (segment, segment) events matter; ``resolve_merges`` settles their order. Items with a ``note`` column get ``MERGED_BY_TEXT``
    where the note is blank and their segment was renamed.
    """
    names = resolve_merges(_text_events(items))
    out = relabel(items, names)
    if "note" not in items.columns:
        return out
    moved = names.filter("moved").select("root", F.col("segment_id").alias("_was"), F.lit(True).alias("_moved"))
    own = items.select("root", "sample_idx", F.col("segment_id").alias("_was")).join(moved, ["root", "_was"]).select("root", "sample_idx", "_moved")
    noted = out.join(own, ["root", "sample_idx"], "left")
    blank = F.col(POSITIVE) & F.coalesce("_moved", F.lit(False)) & (F.coalesce("note", F.lit("")) == "")
    return noted.withColumn("note", F.when(blank, F.lit(MERGED_BY_TEXT)).otherwise(F.col("note"))).drop("_moved").select(*out.columns)


def merge_counts(names: DataFrame) -> DataFrame:
    """``root, merges``: how many merges changed something. Each takes one name away for good."""
    return names.groupBy("root").agg((F.count("segment_id") - F.count_distinct("merged")).alias("merges"))


def exact_text_merges(items: DataFrame) -> DataFrame:
    """``merge_counts`` of ``merge_exact_text``."""
    return merge_counts(resolve_merges(_text_events(items)))


def resolve_merges(events: DataFrame) -> DataFrame:
    """Ordered merge events (root, into, source, at) to final names: ``root, segment_id, merged, moved``.

    An event gives the class of ``source`` the name of the class of ``into``; events within one class do nothing. ``moved`` says that a
    segment was in a class that was renamed. What events do is a minimum spanning forest by time, grown in rounds: each fragment hooks
    itself to another one by its earliest event. A fragment is one growing class, joined by others at times, and keeps its renamings (time, name);
    its own events are all later than the joining of the segment that they touch. A fragment that hooks itself as ``into``
    renames the class that it joins to its own name of that time; its later renamings go on in that class. Fragments halve
    in number each round at least, and chains of hooks are followed by pointer doubling, so no component meets in one task.
    """
    when = F.struct("at", "into", "source")
    edges = checkpointed(events.filter("into <> source").select("root", F.col("into").alias("a"), F.col("source").alias("b"), when.alias("t")))
    kind = edges.schema["t"].dataType
    ends = edges.select("root", F.col("a").alias("id")).unionByName(edges.select("root", F.col("b").alias("id"))).distinct()
    vertices = checkpointed(ends.select("root", "id", F.col("id").alias("f"), F.lit(None).cast(kind).alias("joined"), F.lit(False).alias("moved")))
    renamed = edges.limit(0).select("root", F.col("a").alias("f"), "t", F.col("a").alias("name"))
    later = lambda x, y: y.isNotNull() & (x.isNull() | (x < y))
    while not edges.isEmpty():
        sides = edges.select("root", F.col("a").alias("f"), F.struct("t", F.col("b").alias("g"), F.lit(True).alias("into")).alias("e"))
        sides = sides.unionByName(edges.select("root", F.col("b").alias("f"), F.struct("t", F.col("a").alias("g"), F.lit(False).alias("into")).alias("e")))
        hooks = checkpointed(sides.groupBy("root", "f").agg(F.min("e").alias("e")).select("root", "f", "e.*"))
        # Two fragments with the same earliest event: the one that gives the name stays.
        other = hooks.select("root", F.col("f").alias("g"), F.col("t").alias("_t"))
        stays = F.col("into") & (F.col("t") == F.col("_t"))
        hooks = checkpointed(hooks.join(other, ["root", "g"]).select("root", "f", "t", "into", F.when(stays, F.col("f")).otherwise(F.col("g")).alias("up")))
        tops = _tops(hooks.select("root", "f", "up"))
        moves = checkpointed(hooks.filter("up <> f").select("root", "f", F.col("t").alias("_t"), "into").join(tops, ["root", "f"]))
        # The name of a fragment at its hook, and the renamings that end there.
        old = renamed.join(moves.select("root", "f", "_t"), ["root", "f"]).filter(F.col("t") <= F.col("_t"))
        past = checkpointed(old.groupBy("root", "f").agg(F.max_by("name", "t").alias("_name"), F.max("t").alias("_last")))
        moves = moves.join(past, ["root", "f"], "left")
        hooked = moves.filter("into").select("root", F.col("top").alias("f"), F.col("_t").alias("t"), F.coalesce("_name", "f").alias("name"))
        kept = renamed.join(moves.select("root", "f", "_t", "top"), ["root", "f"], "left").filter(F.col("_t").isNull() | (F.col("t") > F.col("_t")))
        renamed = checkpointed(kept.select("root", F.coalesce("top", "f").alias("f"), "t", "name").unionByName(hooked))
        # Segments that were in a renamed class, or in a class that is renamed by its hook.
        placed = vertices.join(moves.select("root", "f", "_t", "into", "top", "_last"), ["root", "f"], "left")
        inside = F.col("_t").isNotNull() & ~later(F.col("_t"), F.col("joined"))
        moved = F.col("moved") | later(F.col("joined"), F.col("_last")) | (inside & ~F.col("into"))
        vertices = checkpointed(placed.select("root", "id", F.coalesce("top", "f").alias("f"), F.when(inside, F.col("_t")).otherwise(F.col("joined")).alias("joined"), moved.alias("moved")))
        tops = moves.select("root", "f", "top")
        for end in ("a", "b"):
            edges = edges.join(tops.withColumnsRenamed({"f": end, "top": "_top"}), ["root", end], "left").withColumn(end, F.coalesce("_top", end)).drop("_top")
        edges = checkpointed(edges.filter("a <> b").groupBy("root", "a", "b").agg(F.min("t").alias("t")))
    last = renamed.groupBy("root", "f").agg(F.max_by("name", "t").alias("_name"), F.max("t").alias("_last"))
    named = vertices.join(last, ["root", "f"], "left")
    moved = F.col("moved") | later(F.col("joined"), F.col("_last"))
    return named.select("root", F.col("id").alias("segment_id"), F.coalesce("_name", "f").alias("merged"), moved.alias("moved"))


def _tops(hooks: DataFrame) -> DataFrame:
    """``root, f, top``: where the chain of each ``up`` ends (a fragment that is its own), by pointer doubling."""
    now = checkpointed(hooks)
    while True:
        ahead = now.select("root", F.col("f").alias("up"), F.col("up").alias("_next"))
        after = checkpointed(now.join(ahead, ["root", "up"]).select("root", "f", F.col("_next").alias("up"), (F.col("up") != F.col("_next")).alias("_more")))
        now = after.drop("_more")
        if after.filter("_more").isEmpty():
            return now.withColumnRenamed("up", "top")


def relabel(items: DataFrame, names: DataFrame) -> DataFrame:
    """Rename the segments of positive items."""
    renamed = items.join(names.select("root", "segment_id", "merged"), ["root", "segment_id"], "left")
    target = F.when(F.col(POSITIVE), F.coalesce("merged", "segment_id")).otherwise(F.col("segment_id"))
    return renamed.withColumn("segment_id", target).drop("merged")


def split_segments(items: DataFrame, cuts: DataFrame) -> DataFrame:
    """Give rows at or after each cut sample (root, sample_id) a fresh segment id.

    Several cuts of one segment split it into consecutive parts, each named after its own cut sample.
    """
    at = cuts.join(items.filter(POSITIVE), ["root", "sample_id"]).select(
        "root", "segment_id", F.col("sample_idx").alias("cut_idx"), F.col("sample_id").alias("base")
    )
    taken = items.select("root", F.col("segment_id").alias("name")).distinct()
    number = F.regexp_extract("name", r"__split_(\d+)$", 1).try_cast("int")
    stem = F.regexp_replace("name", r"__split_\d+$", "")
    used = taken.filter(number.isNotNull()).groupBy("root", stem.alias("base")).agg(F.collect_set(number).alias("used"))
    plain = taken.select("root", F.col("name").alias("base"), F.lit(True).alias("_plain"))
    named = at.join(used, ["root", "base"], "left").join(plain, ["root", "base"], "left")
    none = F.array().cast("array<int>")
    free = F.array_min(
        F.array_except(F.sequence(F.lit(1), F.size(F.coalesce("used", none)) + 1), F.coalesce("used", none))
    )
    own = (F.col("base") != F.col("segment_id")) & F.col("_plain").isNull()
    named = named.withColumn("fresh", F.when(own, F.col("base")).otherwise(F.concat("base", F.lit("__split_"), free)))
    spans = named.withColumn(
        "next_idx", F.lead("cut_idx").over(W.partitionBy("root", "segment_id").orderBy("cut_idx"))
    ).select(F.col("root").alias("_root"), F.col("segment_id").alias("_segment"), "cut_idx", "next_idx", "fresh")
    hit = (
        (F.col("root") == F.col("_root")) & (F.col("segment_id") == F.col("_segment")) & F.col(POSITIVE)
        & (F.col("sample_idx") >= F.col("cut_idx"))
        & (F.col("next_idx").isNull() | (F.col("sample_idx") < F.col("next_idx")))
    )
    cut = items.join(spans, hit, "left").withColumn("segment_id", F.coalesce("fresh", "segment_id"))
    return cut.drop("_root", "_segment", "cut_idx", "next_idx", "fresh")


def _segment_of(asked: DataFrame, items: DataFrame, id_column: str, into: str) -> DataFrame:
    """The segment of each asked sample; a sample that is not there or has no subtitle is an error."""
    known = items.select("root", F.col("sample_id").alias(id_column), F.col(POSITIVE).alias("_positive"), F.col("segment_id").alias(into), F.col("sample_idx").alias(f"{into}_idx"))
    both = asked.join(known, ["root", id_column], "left")
    fault = F.concat(F.lit("a sample without subtitle cannot be merged: "), F.col(id_column).cast("string"))
    checked = F.when(F.coalesce("_positive", F.lit(False)), F.col(into)).otherwise(F.raise_error(fault).cast("string"))
    return both.withColumn(into, checked).drop("_positive")


def merge_to_previous(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Merge the segments of the chosen samples (root, sample_id) into the previous subtitle run's segment.

    A sample that is not there or without subtitle, or a segment with none before it, is an error.
    """
    runs = segment_runs(items).filter("not no_subtitle")
    previous = with_previous(runs, ["first_idx"], ["segment_id"], ["root"], index_block(F.col("first_idx")))
    first = previous.groupBy("root", "segment_id").agg(F.min_by("prev_segment_id", "first_idx").alias("into"))
    picks = _segment_of(chosen.select("root", "sample_id"), items, "sample_id", "segment_id")
    fault = F.raise_error(F.concat(F.lit("no segment before that of "), F.col("sample_id").cast("string"))).cast("string")
    before = picks.join(first, ["root", "segment_id"], "left").withColumn("into", F.coalesce("into", fault))
    events = before.filter("into <> segment_id").groupBy("root", "into", F.col("segment_id").alias("source")).agg(F.min("segment_id_idx").alias("at"))
    return relabel(items, resolve_merges(events))


def merge_pairs(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Merge the segments of (root, position, left_id, right_id) in position order; a sample that is not there or without subtitle is an error."""
    asked = pairs.select("root", "position", "left_id", "right_id")
    both = _segment_of(_segment_of(asked, items, "left_id", "into"), items, "right_id", "source")
    return relabel(items, resolve_merges(both.groupBy("root", "into", "source").agg(F.min("position").alias("at"))))


def rename_segments(items: DataFrame, names: DataFrame) -> DataFrame:
    """Rename (root, old, new); an empty new name is an error."""
    new = F.when(F.trim("new") == "", F.raise_error(F.lit("the new segment name is blank"))).otherwise(F.trim("new"))
    return relabel(items, names.select("root", F.col("old").alias("segment_id"), new.cast("string").alias("merged")))


def review_stats(items: DataFrame) -> DataFrame:
    """Counters of a review session (items carry ``reviewed``)."""
    return items.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(POSITIVE).alias("subtitle_samples"),
        F.count_if(~F.col(POSITIVE)).alias("empty_samples"),
        F.count_distinct(F.when(F.col(POSITIVE), F.col("segment_id"))).alias("segments"),
        F.count_if("reviewed").alias("edited_samples"),
    )
