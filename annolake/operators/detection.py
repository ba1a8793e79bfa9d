"""Box merging, matching and grouping inside images.

Merging and matching depend on the order of the boxes of one image, so the image is the unit of work there. Boxes
travel as one flat double array per image and a whole Arrow batch of images is handled per call. Exact copies of a box
never change a merge result and are dropped before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.functions.geometry import box_iou, decimal_round
from annolake.operators.sweep import swept_groups

# Fixed values.
ROW_OVERLAP, ROW_GAP_HEIGHTS, ROW_GAP_PIXELS = 0.5, 1.5, 48.0
STACK_OVERLAP, STACK_GAP_HEIGHTS = 0.45, 0.75
LINE_OVERLAP, LINE_CENTER, LINE_CENTER_PIXELS = 0.45, 0.35, 4.0
MERGE_GAP, MERGE_HEIGHT, MERGE_CENTER = 0.65, 0.22, 0.45
#: Targets up to which an image's boxes are compared without a grid.
FEW_TARGETS = 64


def _overlap(a0, a1, b0, b1):
    return max(0.0, min(a1, b1) - max(a0, b0))


def _gap(a0, a1, b0, b1):
    return max(0.0, b0 - a1, a0 - b1)


def _belongs(a, b) -> bool:
    """Same text row by vertical overlap and gap; only without that overlap the stacked rule applies."""
    heights = (max(0.0, a[3] - a[1]), max(0.0, b[3] - b[1]))
    tall, low = max(*heights, 1.0), max(min(heights), 1.0)
    if _overlap(a[1], a[3], b[1], b[3]) / low >= ROW_OVERLAP:
        return _gap(a[0], a[2], b[0], b[2]) <= max(tall * ROW_GAP_HEIGHTS, ROW_GAP_PIXELS)
    narrow = max(min(max(0.0, a[2] - a[0]), max(0.0, b[2] - b[0])), 1.0)
    stacked = _overlap(a[0], a[2], b[0], b[2]) / narrow >= STACK_OVERLAP
    return stacked and _gap(a[1], a[3], b[1], b[3]) <= tall * STACK_GAP_HEIGHTS


def merge_adjacent(boxes) -> list[tuple]:
    """Repeat top-down passes, each box swallowing later ones that belong to it, until nothing changes."""
    rows = [tuple(b) for b in boxes]
    while len(rows) > 1:
        waiting, settled = sorted(rows, key=lambda b: (b[1], b[0])), []
        while waiting:
            grown, kept = waiting[0], []
            for other in waiting[1:]:
                if _belongs(grown, other):
                    grown = (*map(min, grown[:2], other[:2]), *map(max, grown[2:], other[2:]))
                else:
                    kept.append(other)
            settled.append(grown)
            waiting = kept
        done = len(settled) == len(rows)
        rows = sorted(settled, key=lambda b: (b[1], b[0]))
        if done:
            break
    return rows


def _iou(a, b) -> float:
    shared = _overlap(a[0], a[2], b[0], b[2]) * _overlap(a[1], a[3], b[1], b[3])
    area = lambda c: max(0.0, c[2] - c[0]) * max(0.0, c[3] - c[1])
    union = area(a) + area(b) - shared
    return shared / union if union > 0 else 0.0


def match_counts(predictions, targets, threshold: float) -> tuple[int, int, int]:
    """(tp, fp, fn) after merging both sides; predictions claim the best free target in their order."""
    predictions, free = merge_adjacent(predictions), merge_adjacent(targets)
    hits = 0
    for box in predictions:
        best = max(range(len(free)), key=lambda k: _iou(box, free[k]), default=None)
        overlap = 0.0 if best is None else _iou(box, free[best])
        if overlap > 0 and overlap >= threshold:
            hits += 1
            del free[best]
    return hits, len(predictions) - hits, len(free)


def box_lists(boxes: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct boxes of each group as one flat array. Copies below half a pixel of height are kept."""
    sides = ["x1", "y1", "x2", "y2"]
    unique = boxes.select(*by, *[F.col("box")[k].alias(k) for k in sides]).groupBy(*by, *sides).agg(F.count(F.lit(1)).alias("_n"))
    times = F.when(F.col("y2") - F.col("y1") < 0.5, F.col("_n")).otherwise(1).cast("int")
    copies = F.array_repeat(F.array(*sides), times)
    return unique.groupBy(*by).agg(F.flatten(F.array_sort(F.flatten(F.collect_list(copies)))).alias(name))


def _rows(flat) -> list[list[float]]:
    return [] if flat is None else np.asarray(flat).reshape(-1, 4).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _merged(lists: pd.Series) -> pd.Series:
    return lists.map(lambda b: [v for box in merge_adjacent(_rows(b)) for v in box])


def merge_adjacent_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Merged boxes per group, one row each (input column ``box``)."""
    merged = box_lists(boxes, by, "_all").withColumn("_m", _merged("_all"))
    at = F.explode(F.sequence(F.lit(0), F.size("_m") - 4, F.lit(4))).alias("_i")
    rows = merged.select(*by, "_m", at)
    part = lambda k: F.col("_m")[F.col("_i") + k]
    return rows.select(*by, part(0).alias("x1"), part(1).alias("y1"), part(2).alias("x2"), part(3).alias("y2"))


def evaluate_images(predictions: DataFrame, targets: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """tp, fp and fn per image."""

    @F.pandas_udf("tp long, fp long, fn long")
    def score(p: pd.Series, t: pd.Series) -> pd.DataFrame:
        counts = [match_counts(_rows(a), _rows(b), threshold) for a, b in zip(p, t)]
        return pd.DataFrame(counts, columns=["tp", "fp", "fn"], dtype="int64")

    both = box_lists(predictions, by, "_p").join(box_lists(targets, by, "_t"), by, "full")
    return both.select(*by, score("_p", "_t").alias("s")).select(*by, "s.*")


def match_candidates(predictions: DataFrame, targets: DataFrame, threshold: float, cell: float = 256.0, few: int = FEW_TARGETS) -> DataFrame:
    """Prediction-target pairs of one image at or above the overlap threshold.

    Images of up to ``few`` targets are compared whole, by a join on the image alone: where both sides are dealt by image already, no box is
    moved. Only the boxes of crowded images are laid on a grid, so that those that share a cell meet; a pair counts in its first shared cell only.
    """
    corners = [F.col(f"box.{k}").isNotNull() for k in ("x1", "y1", "x2", "y2")]
    side = lambda df, p: df.filter(corners[0] & corners[1] & corners[2] & corners[3]).select(
        "image_id", F.col("box_id").alias(f"{p}_id"), F.col("box").alias(f"{p}_box"))
    own, other = side(predictions, "pred"), side(targets, "target")

    def scored(met: DataFrame) -> DataFrame:
        overlap = met.withColumn("iou", box_iou(F.col("pred_box"), F.col("target_box")))
        return overlap.filter(F.col("iou") >= threshold).select("image_id", "pred_id", "target_id", "iou")

    # At 0 every pair of an image is asked for, those that share no cell too.
    if threshold <= 0:
        return scored(own.join(other, "image_id"))

    def gridded(df: DataFrame, p: str) -> DataFrame:
        steps = lambda a, b: F.sequence(F.floor(F.col(f"{p}_box.{a}") / cell), F.floor(F.col(f"{p}_box.{b}") / cell))
        return df.join(crowded, "image_id", "left_semi").withColumn("gx", F.explode(steps("x1", "x2"))).withColumn("gy", F.explode(steps("y1", "y2")))

    counted = other.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    # The few that are crowded are dealt out on their own: where there are none, that is known before any box is laid on the grid.
    crowded = counted.filter(F.col("_n") > few).select("image_id").hint("rebalance")
    met = gridded(own, "pred").join(gridded(other, "target"), ["image_id", "gx", "gy"])
    first = lambda k: F.floor(F.greatest(F.col(f"pred_box.{k}"), F.col(f"target_box.{k}")) / cell)
    once = met.filter((F.col("gx") == first("x1")) & (F.col("gy") == first("y1")))
    whole = own.join(other.join(crowded, "image_id", "left_anti"), "image_id")
    return scored(whole).unionByName(scored(once))


def merge_candidate_groups(
    rects: DataFrame, gap_ratio: float = MERGE_GAP, height_tolerance: float = MERGE_HEIGHT, center_tolerance: float = MERGE_CENTER
) -> DataFrame:
    """Connected groups of alike, neighbouring boxes (image_id, line_index, x, y, width, height; unmasked rows).

    Copies of a rectangle always belong together and are folded first; ``swept_groups`` says what nulls give.
    """
    found = swept_groups(rects, gap_ratio, height_tolerance, center_tolerance)
    size = {"x": F.col("left"), "y": F.col("top"), "width": F.col("right") - F.col("left"), "height": F.col("bottom") - F.col("top")}
    groups = found.select("image_id", "group", "members", *[decimal_round(c, 2).alias(k) for k, c in size.items()])
    return groups.withColumn("area", decimal_round(F.col("width") * F.col("height"), 2))


def reading_positions(boxes: np.ndarray) -> np.ndarray:
    """Indices of integer boxes in reading order: rows from the top, left to right inside a row."""
    boxes = np.asarray(boxes, dtype="float64").reshape(-1, 4)
    if not len(boxes):
        return np.empty(0, dtype="int64")
    rows: list[list] = []  # [bounds, indices]
    for i in np.lexsort((boxes[:, 0], (boxes[:, 1] + boxes[:, 3]) / 2)):
        box = boxes[i]
        for row in rows:
            top, bottom = row[0]
            low = max(1.0, min(bottom - top, box[3] - box[1]))
            shared = min(bottom, box[3]) - max(top, box[1])
            level = abs((top + bottom) / 2 - (box[1] + box[3]) / 2) <= max(LINE_CENTER_PIXELS, low * LINE_CENTER)
            if (shared > 0 and shared / low >= LINE_OVERLAP) or level:
                row[0] = (min(top, box[1]), max(bottom, box[3]))
                row[1].append(i)
                break
        else:
            rows.append([(box[1], box[3]), [i]])
    rows.sort(key=lambda r: r[0][0])
    return np.array([i for _, members in rows for i in sorted(members, key=lambda k: boxes[k, 0])])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def reading_order(lists: pd.Series) -> pd.Series:
    """Reading order of flat box arrays, as positions in the array."""
    return lists.map(reading_positions)
