"""Dense maps as cell tables, and decoding of score maps back to boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.functions.geometry import box_height, box_width, clamp, make_box

# Fixed values.
REGION_WEIGHT, KERNEL_WEIGHT, CORE_SHARE, BOTTOM_SHARE = 0.8, 0.2, 0.95, 0.75
#: Cells of maps that a task paints at a time (at least one map).
PAINTED = 1 << 20


def rasterize_boxes(boxes: DataFrame, key: str, in_size: tuple[int, int], out_size: tuple[int, int]) -> DataFrame:
    """Covered cells of each sample: floor/ceil cover after scaling, at least one cell per box."""
    return _distinct_cells(boxes.select(key, *_cell_spans(in_size, out_size)).filter("l < r and t < b"), key)


def _cell_spans(in_size: tuple[int, int], out_size: tuple[int, int]) -> list[Column]:
    """Integer spans (l, t, r, b) of the cells that ``box`` covers; empty for a start beyond the map."""
    (iw, ih), (ow, oh) = in_size, out_size
    b = F.col("box")
    left = clamp(F.floor(b["x1"] * ow / iw), F.lit(0), F.lit(ow))
    top = clamp(F.floor(b["y1"] * oh / ih), F.lit(0), F.lit(oh))
    right = F.least(F.greatest(left + 1, F.least(F.lit(ow), F.ceil(b["x2"] * ow / iw))), F.lit(ow))
    bottom = F.least(F.greatest(top + 1, F.least(F.lit(oh), F.ceil(b["y2"] * oh / ih))), F.lit(oh))
    return [c.alias(n) for c, n in ((left, "l"), (top, "t"), (right, "r"), (bottom, "b"))]


def covered_words(boxes: DataFrame, key: str, in_size: tuple[int, int], out_size: tuple[int, int]) -> DataFrame:
    """The cells of ``rasterize_boxes`` as one row per key, for small maps: ``words``, row-major, of 32 cells each.

    What is shuffled is a row of words for each key. Null boxes cover nothing, but their key has its row.
    """
    width, height = out_size
    here = F.col("box").isNotNull()
    spans = boxes.select(key, *(F.when(here, c).alias(n) for c, n in zip(_cell_spans(in_size, out_size), "ltrb")))
    per_row = -(-width // _WORD)
    for w in range(per_row):
        ends = (F.when(F.col(n).isNotNull(), F.least(F.greatest(F.col(n) - w * _WORD, F.lit(0)), F.lit(_WORD))).cast("int").alias(f"_{n}") for n in ("l", "r"))
        spans = spans.select("*", *ends).withColumn(f"_{w}", F.expr("shiftleft(1L, _r) - shiftleft(1L, _l)")).drop("_l", "_r")
    word = lambda y, w: F.coalesce(F.bit_or(F.when((F.col("t") <= y) & (F.col("b") > y), F.col(f"_{w}"))), F.lit(0).cast("long"))
    names = [(y, w, f"_{y}_{w}") for y in range(height) for w in range(per_row)]
    joined = spans.groupBy(key).agg(*(word(y, w).alias(n) for y, w, n in names))
    return joined.select(key, F.array(*(n for _, _, n in names)).alias("words"))


def is_covered(words: Column, idx: Column, width: int) -> Column:
    """Whether the cell ``idx`` (row-major) of ``covered_words`` is covered."""
    x, y = idx % width, F.floor(idx / width)
    return F.getbit(F.get(words, (y * -(-width // _WORD) + F.floor(x / _WORD)).cast("int")), (x % _WORD).cast("int")) == 1


_WORD = 32


def _distinct_cells(spans: DataFrame, key: str) -> DataFrame:
    """Distinct cells of non-empty integer spans (l, t, r, b). Rows of cells travel as 32-bit words joined by ``bit_or``, so what
    is shuffled is up to 32 times smaller than the cells."""
    words = F.sequence(F.floor(F.col("l") / _WORD).cast("int"), F.floor((F.col("r") - 1) / _WORD).cast("int"))
    rows = spans.select(
        key, "l", "r", F.explode(words).alias("word"), F.col("t").cast("int").alias("t"), F.col("b").cast("int").alias("b")
    )
    first = F.greatest(F.col("l") - F.col("word") * _WORD, F.lit(0)).cast("int")
    last = F.least(F.col("r") - F.col("word") * _WORD, F.lit(_WORD)).cast("int")
    mask = F.expr("shiftleft(1L, _last) - shiftleft(1L, _first)")
    rows = rows.withColumn("_first", first).withColumn("_last", last).select(
        key, "word", mask.alias("mask"), F.explode(F.sequence(F.col("t"), F.col("b") - 1)).alias("y")
    )
    joined = rows.groupBy(key, "y", "word").agg(F.bit_or("mask").alias("mask"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda i: F.getbit("mask", i) == 1)
    return joined.select(key, "y", "word", F.explode(bits).alias("bit")).select(
        key, "y", (F.col("word") * _WORD + F.col("bit")).cast("int").alias("x")
    )


def _cover(b: Column, width: int, height: int) -> list[Column]:
    w, h, zero = F.lit(float(width)), F.lit(float(height)), F.lit(0.0)
    return [
        F.floor(clamp(b["x1"], zero, w)), F.floor(clamp(b["y1"], zero, h)),
        F.ceil(clamp(b["x2"], zero, w)), F.ceil(clamp(b["y2"], zero, h)),
    ]


def shrink_box(b: Column, scale: float, min_width: float, min_height: float) -> Column:
    side = lambda v, low: F.when(v <= low, v).otherwise(F.least(F.greatest(v * scale, F.lit(low)), v))
    w, h = side(box_width(b), min_width), side(box_height(b), min_height)
    cx, cy = (b["x1"] + b["x2"]) * 0.5, (b["y1"] + b["y2"]) * 0.5
    return make_box(cx - w * 0.5, cy - h * 0.5, cx + w * 0.5, cy + h * 0.5)


def _interior(owners: np.ndarray, radius: int) -> np.ndarray:
    """Cells of many maps (map, y, x; 0: no owner) whose window, as far as it lies in the map, has one owner: first along x, then along y."""
    one = owners > 0
    for d in range(1, min(radius, owners.shape[2] - 1) + 1):
        same = owners[:, :, d:] == owners[:, :, :-d]
        one[:, :, d:] &= same
        one[:, :, :-d] &= same
    both = one.copy()
    for d in range(1, min(radius, owners.shape[1] - 1) + 1):
        same = owners[:, d:] == owners[:, :-d]
        both[:, d:] &= same & one[:, :-d]
        both[:, :-d] &= same & one[:, d:]
    return both


def region_kernel_targets(
    boxes: DataFrame, ignores: DataFrame, key: str, width: int, height: int, pooling: int = 9,
    kernel_scale: float = 0.1, min_width: float = 3.0, min_height: float = 3.0,
) -> DataFrame:
    """Non-empty cells of the training maps: region, kernel and training_mask (absent cells: 0, 0 and 1).

    ``boxes``: key, instance (1-based, later wins a cell), box already clipped. The kernel is the interior that a
    square window erosion leaves to one owner, united with the shrunk boxes; cells in two shrunk boxes are cleared.

    Boxes are shuffled, not cells: those of a sample arrive in the order of their instances and are painted on its map one after the other, so
    a task holds ``PAINTED`` cells of maps, however many boxes there are.
    """
    if pooling > 1 and pooling % 2 == 0:
        raise ValueError("pooling must be odd")
    radius, ends = pooling // 2, ["l", "t", "r", "b"]
    usable = boxes.filter((box_width(F.col("box")) > 0.5) & (box_height(F.col("box")) > 0.5))
    span = lambda box, prefix: [c.cast("int").alias(prefix + n) for n, c in zip(ends, _cover(box, width, height))]
    small = shrink_box(F.col("box"), kernel_scale, min_width, min_height)
    own = usable.select(key, F.col("instance").alias("_i"), *span(F.col("box"), "_o"), *span(small, "_s"))
    empty = [F.lit(None).cast("int").alias("_s" + n) for n in ends]
    marked = ignores.select(key, F.lit(None).cast(own.schema["_i"].dataType).alias("_i"), *span(F.col("box"), "_o"), *empty)
    rows = own.withColumn("_kind", F.lit(0)).unionByName(marked.withColumn("_kind", F.lit(1)))
    # The owner of a row is the place of its instance among those of the sample.
    rows = rows.repartition(F.col(key)).sortWithinPartitions(key, "_kind", "_i")
    values = ["x", "y", "region", "kernel", "training_mask"]
    schema = T.StructType([rows.schema[key], *(T.StructField(c, T.IntegerType()) for c in values)])
    spans, limit = ["_o" + n for n in ends] + ["_s" + n for n in ends], max(1, PAINTED // (width * height))

    def painted(batches):
        names, open_key, instance, number = [], None, None, 0
        owners, cover, ignored = (np.zeros((limit, height, width), np.int32) for _ in range(3))

        def cells(kind):
            n = len(names)
            own_, cover_, ignored_ = owners[:n], cover[:n], ignored[:n]
            inside = _interior(own_, radius)
            at = np.nonzero((own_ > 0) | (cover_ > 0) | (ignored_ > 0))
            kernel = np.where(cover_[at] == 0, inside[at], cover_[at] == 1)
            columns = [at[2], at[1], own_[at] > 0, kernel, ignored_[at] == 0]
            keys = pa.array(names, kind).take(pa.array(at[0]))
            for grid in (own_, cover_, ignored_):
                grid[:] = 0
            names.clear()
            return pa.RecordBatch.from_arrays([keys, *(pa.array(c.astype(np.int32)) for c in columns)], names=[key, *values])

        for batch in batches:
            kind = batch.column(key).type
            places = np.stack([np.asarray(pc.fill_null(batch.column(c), 0)) for c in spans], axis=1).tolist()
            for name, mark, place, (l, t, r, b, sl, st, sr, sb) in zip(
                batch.column(key).to_pylist(), batch.column("_kind").to_pylist(), batch.column("_i").to_pylist(), places,
            ):
                if not names or name != open_key:
                    if len(names) == limit:
                        yield cells(kind)
                    names.append(name)
                    open_key, instance, number = name, None, 0
                at = len(names) - 1
                if mark:
                    ignored[at, t:b, l:r] = 1
                    continue
                if number == 0 or place != instance:
                    instance, number = place, number + 1
                owners[at, t:b, l:r] = number
                cover[at, st:sb, sl:sr] += 1
        if names:
            yield cells(kind)

    return rows.mapInArrow(painted, schema)


def region_localization(cells: DataFrame, key: str) -> DataFrame:
    """Per sample with a usable target: IoU, Dice, inside/outside means, contrast and pointing.

    ``cells``: key (not null), idx (row-major), target, prob, valid. Cells that are partitioned by their key are not moved.
    """
    ok = F.col("valid") > 0.5
    target, hit = ok & (F.col("target") > 0.25), ok & (F.col("prob") >= 0.5)
    # Highest valid probability, first index on ties: found first, then read. A maximum of structs would sort all cells of a task.
    shown = F.when(ok, F.col("prob")).otherwise(-1.0)
    top = cells.groupBy(key).agg(F.max(shown).alias("_top"))
    code = F.col("idx") * 3 + F.when(target, 0).when(~target, 1).otherwise(2)
    both = cells.join(top.hint("shuffle_hash"), key, "left")
    first = F.min(F.when(shown.eqNullSafe(F.col("_top")), code)) % 3
    peak = F.when(first == 0, 1.0).when(first == 1, 0.0)
    flat = both.groupBy(key).agg(
        F.count_if(target & hit).alias("inter"), F.count_if(target | hit).alias("union"), F.count_if(hit).alias("n_hit"),
        F.count_if(target).alias("n_target"), F.avg(F.when(target, F.col("prob"))).alias("inside"),
        F.coalesce(F.avg(F.when(ok & ~target, F.col("prob"))), F.lit(0.0)).alias("outside"), peak.alias("pointing"),
    ).filter("n_target > 0")
    return flat.select(
        key, F.when(F.col("union") > 0, F.col("inter") / F.col("union")).otherwise(0.0).alias("iou"),
        (2.0 * F.col("inter") / F.greatest(F.lit(1), F.col("n_hit") + F.col("n_target"))).alias("dice"),
        "inside", "outside", (F.col("inside") - F.col("outside")).alias("contrast"), "pointing",
    )


def localization_metrics(records: DataFrame) -> DataFrame:
    names = ["iou", "dice", "inside", "outside", "contrast", "pointing"]
    return records.agg(
        F.count(F.lit(1)).cast("double").alias("localizable_count"), *(F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names)
    )


def region_activation(cells: DataFrame, key: str) -> DataFrame:
    """Maximum probability and share of cells at 0.5 or more among the valid cells of each sample."""
    ok = F.col("valid") > 0.5
    return cells.groupBy(key).agg(
        F.coalesce(F.max(F.when(ok, F.col("prob"))), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.avg(F.when(ok, (F.col("prob") >= 0.5).cast("double"))), F.lit(0.0)).alias("activation_area"),
    )


def map_stats(values: Column) -> Column:
    """Maximum and mean of a dense map held as an array; 0 for an empty one."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    some = F.size(values) > 0
    return F.struct(
        F.when(some, F.array_max(values).cast("double")).otherwise(0.0).alias("score_max"),
        F.when(some, total / F.size(values)).otherwise(0.0).alias("score_mean"),
    )


#: Maps that are decoded side by side.
MAPS = 512


class _Sheet:
    """Cells of many maps in one row: the place in its map (row-major), the map and the height of it for each."""

    def __init__(self, sizes: np.ndarray, width: int) -> None:
        starts = np.cumsum(sizes) - sizes
        self.map = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.arange(len(self.map)) - starts[self.map]
        self.x, self.y = self.at % width, self.at // width
        self.heights, self.width, last = sizes // width, width, sizes[self.map] - 1
        # Whether there is a cell left, right, above and below.
        self.sides = np.stack([
            self.x > 0, (self.x + 1 < width) & (self.at < last), self.y > 0, (self.y + 1 < self.heights[self.map]),
        ], axis=1)
        self.steps = np.array([-1, 1, -width, width])


def _first_cells(open_cells: np.ndarray, sheet: _Sheet) -> np.ndarray:
    """The first cell of the connected part that each open cell belongs to."""
    here = [np.flatnonzero(open_cells & sheet.sides[:, k]) for k in (1, 3)]
    pairs = np.concatenate([np.stack([h, h + s], axis=1) for h, s in zip(here, (1, sheet.width))])
    pairs = pairs[open_cells[pairs[:, 1]]]
    label = np.arange(len(open_cells))
    while True:
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        apart = a != b
        if not apart.any():
            return label
        pairs, a, b = pairs[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def _grow(open_cells: np.ndarray, owner: np.ndarray, frontier: np.ndarray, sheet: _Sheet) -> None:
    """First-come growth of owners through open cells, in queue order, one generation of all maps at a time."""
    while len(frontier):
        usable = sheet.sides[frontier]
        reached = (frontier[:, None] + sheet.steps[None])[usable]
        source = np.repeat(frontier, usable.sum(axis=1))
        free = open_cells[reached] & (owner[reached] < 0)
        source, reached = source[free], reached[free]
        _, first = np.unique(reached, return_index=True)
        first.sort()
        owner[reached[first]] = owner[source[first]]
        frontier = reached[first]


def decode_maps(region_prob, kernel_prob, sizes, width, region_threshold, kernel_threshold, min_size, max_width_ratio):
    """Boxes of flat probability map pairs that lie one behind the other: ``map, seed, x1, y1, x2, y2, score`` as arrays."""
    sheet = _Sheet(np.asarray(sizes, np.int64), width)
    region = region_prob >= region_threshold
    core = (kernel_prob >= kernel_threshold) & region
    owner = np.full(len(region), -1, np.int64)
    label, inside = _first_cells(core, sheet), np.flatnonzero(core)
    roots, owner[inside] = np.unique(label[inside], return_inverse=True)
    _grow(region, owner, inside, sheet)
    # Cells by seed, ascending inside each.
    cells = np.flatnonzero(owner >= 0)
    cells = cells[np.argsort(owner[cells], kind="stable")]
    seed = owner[cells]
    starts = np.searchsorted(seed, np.arange(len(roots)))
    if not len(roots):
        none = np.zeros(0)
        return none.astype(np.int64), none.astype(np.int64), none, none, none, none, none
    probs, kernels = region_prob[cells], kernel_prob[cells]
    most = np.maximum.reduceat(probs, starts)
    tight = probs >= np.maximum(most * CORE_SHARE, 0.5)[seed]
    used = tight | ~np.logical_or.reduceat(tight, starts)[seed]
    x, y, far = sheet.x[cells], sheet.y[cells], len(region) + 1
    least = lambda v: np.minimum.reduceat(np.where(used, v, far), starts).astype(np.float64)
    past = lambda v: np.maximum.reduceat(np.where(used, v, -1), starts).astype(np.float64) + 1.0
    x1, y1, x2, y2 = least(x), least(y), past(x), past(y)
    ends = np.append(starts[1:], len(cells))
    limit = width * max_width_ratio
    if 0.0 < max_width_ratio < 1.0:
        for k in np.flatnonzero(x2 - x1 > limit):
            own = slice(starts[k], ends[k])
            weight = kernels[own].sum()
            middle = (kernels[own] * (x[own] + 0.5)).sum() / weight if weight > 0 else (x1[k] + x2[k]) / 2
            x1[k] = min(max(min(max(middle, 0.0), float(width)) - limit / 2, 0.0), width - limit)
            x2[k] = x1[k] + limit
    values = REGION_WEIGHT * probs + KERNEL_WEIGHT * kernels
    score = np.array([np.add.reduce(values[i:j]) for i, j in zip(starts, ends)]) / (ends - starts)
    kept = np.flatnonzero((x2 - x1 >= min_size) & (y2 - y1 >= min_size))
    at = sheet.map[roots[kept]]
    # Of several boxes in a map those at the bottom stay, if there are any.
    bottom = (y1[kept] + y2[kept]) / 2 >= sheet.heights[at] * BOTTOM_SHARE
    many, low = np.bincount(at, minlength=len(sheet.heights)) > 1, np.zeros(len(sheet.heights), bool)
    low[at[bottom]] = True
    stays = bottom | ~(many & low)[at]
    kept, at = kept[stays], at[stays]
    number = np.arange(len(at)) - np.searchsorted(at, at)
    return at, number, x1[kept], y1[kept], x2[kept], y2[kept], score[kept]


def maps_to_boxes(
    maps: DataFrame, key: str, width: int, region_threshold: float = 0.5, kernel_threshold: float = 0.5,
    min_size: float = 3.0, max_width_ratio: float = 1.0,
) -> DataFrame:
    """Decode maps (key, region and kernel logits as row-major arrays); each map is one row."""
    sides = ["x1", "y1", "x2", "y2", "score"]
    logits = F.transform("region", lambda v: v.cast("double")), F.transform("kernel", lambda v: v.cast("double"))
    inputs = maps.select(key, *(maps[c] if maps.schema[c].dataType.simpleString() == "array<double>" else v.alias(c) for c, v in zip(("region", "kernel"), logits)))
    schema = T.StructType([maps.schema[key], T.StructField("seed", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in sides)])

    def decoded(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, MAPS):
                batch = whole.slice(at, MAPS)
                region, kernel = batch.column("region"), batch.column("kernel")
                sizes = np.asarray(pc.fill_null(pc.list_value_length(region), 0))
                prob = lambda v: 1.0 / (1.0 + np.exp(-v.flatten().to_numpy(zero_copy_only=False)))
                found = decode_maps(prob(region), prob(kernel), sizes, width, region_threshold, kernel_threshold, min_size, max_width_ratio)
                columns = [batch.column(key).take(pa.array(found[0])), pa.array(found[1].astype(np.int32)), *map(pa.array, found[2:])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "seed", *sides])

    return inputs.mapInArrow(decoded, schema)
