"""Connected groups of boxes by a sweep over x inside each image.

Boxes come sorted by image and left edge. What a later box can still touch is kept open; a group is given out as soon as none of its boxes is
open. So a task holds the boxes that one vertical line (and the allowed gap) meets, never an image, and one shuffle by image is all.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = ["x", "y", "width", "height"]
#: Finished groups that a task gathers before it hands them on.
CHUNK = 10_000


class Group:
    """Sums over the boxes of a group; ``into`` is the group that took it over."""

    __slots__ = ("id", "members", "left", "top", "right", "bottom", "open", "into")

    def __init__(self, name: int, copies: int, x: float, y: float, width: float, height: float) -> None:
        self.id, self.members, self.open, self.into = name, copies, 1, None
        self.left, self.top, self.right, self.bottom = x, y, x + width, y + height

    def root(self) -> Group:
        top = self
        while top.into is not None:
            top = top.into
        while self is not top:
            self.into, self = top, self.into
        return top

    def take(self, other: Group) -> None:
        other.into = self
        self.id = min(self.id, other.id)
        self.members += other.members
        self.open += other.open
        self.left, self.top = min(self.left, other.left), min(self.top, other.top)
        self.right, self.bottom = max(self.right, other.right), max(self.bottom, other.bottom)


class Sweep:
    """Open boxes of one image, by band of height and then by centre."""

    def __init__(self, gap_ratio: float, height_tolerance: float, center_tolerance: float) -> None:
        self.gap, self.tall, self.center = gap_ratio, height_tolerance, center_tolerance
        #: Heights of two alike boxes differ by this factor at most, so they lie in the same band or in neighbouring ones.
        self.spread = (1 + height_tolerance / 2) / (1 - height_tolerance / 2) * (1 + 1e-9)
        self.clear()

    def clear(self) -> None:
        self.bands: dict[int, list[tuple]] = {}
        self.ends: list[tuple] = []
        self.number = 0

    def close_before(self, x: float) -> Iterator[Group]:
        """Groups that no box from ``x`` on can join."""
        while self.ends and self.ends[0][0] < x:
            _, number, band, centre, group = heapq.heappop(self.ends)
            row = self.bands[band]
            del row[bisect_left(row, (centre, number))]
            if not row:
                del self.bands[band]
            root = group.root()
            root.open -= 1
            if not root.open:
                yield root

    def add(self, name: int, copies: int, x: float, y: float, width: float, height: float) -> None:
        """Open a box whose left edge is at or behind all earlier ones', and join it to what it touches."""
        band, centre = math.floor(math.log(height) / math.log(self.spread)), y + height / 2
        group = Group(name, copies, x, y, width, height)
        reach = height * (1 + self.spread) / 2 * self.center * (1 + 1e-9) + abs(centre) * 1e-12
        for near in (band - 1, band, band + 1):
            row = self.bands.get(near, ())
            for other_centre, _, other_x, other_width, other_height, other in row[bisect_left(row, (centre - reach,)) : bisect_right(row, (centre + reach, math.inf))] if row else ():
                average = (height + other_height) / 2
                if abs(height - other_height) / average > self.tall or abs(centre - other_centre) / average > self.center:
                    continue
                if max(0.0, max(x, other_x) - min(x + width, other_x + other_width)) > average * self.gap:
                    continue
                mine, theirs = group.root(), other.root()
                if mine is not theirs:
                    theirs.take(mine)
        number = self.number = self.number + 1
        insort(self.bands.setdefault(band, []), (centre, number, x, width, height, group))
        last = x + width + height * (1 + self.spread) / 2 * self.gap
        heapq.heappush(self.ends, (last + abs(last) * 1e-12, number, band, centre, group))


def swept_groups(rects: DataFrame, gap_ratio: float, height_tolerance: float, center_tolerance: float) -> DataFrame:
    """``image_id``, ``group`` (smallest line_index), ``members`` and bounds (``left, top, right, bottom``) of groups of two boxes and more.

    ``rects``: image_id, line_index, x, y, width, height. Boxes without a height above 0 take no part; a box with a null or non-finite number meets
    only its own copies. Images that are null are one image. Copies are folded before the shuffle.
    """
    kinds = dict(rects.dtypes)
    numbers = [F.col(c).cast("double").alias(c) for c in SHAPE]
    unit = rects.filter("height > 0").groupBy("image_id", *numbers).agg(F.min(F.col("line_index").cast("long")).alias("id"), F.count(F.lit(1)).alias("copies"))
    laid = unit.repartition("image_id").sortWithinPartitions("image_id", "x", "id")
    names = ["image_id", "group", "members", "left", "top", "right", "bottom"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, image, done, kind = Sweep(gap_ratio, height_tolerance, center_tolerance), None, [], None

        def finished(groups: Iterator[Group]) -> None:
            done.extend((image, g.id, g.members, g.left, g.top, g.right, g.bottom) for g in groups if g.members > 1)

        def given() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(names)
            types = [kind, pa.int64(), pa.int64(), *[pa.float64()] * 4]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            done.clear()
            return out

        for batch in batches:
            kind = batch.column("image_id").type
            for name, *shape, least, copies in zip(*(batch.column(c).to_pylist() for c in ["image_id", *SHAPE, "id", "copies"])):
                if name != image:
                    finished(sweep.close_before(math.inf))
                    sweep.clear()
                    image = name
                if any(v is None or not math.isfinite(v) for v in shape):
                    if copies > 1:
                        x, y, width, height = shape
                        total = lambda a, b: None if a is None or b is None else a + b
                        done.append((image, least, copies, x, y, total(x, width), total(y, height)))
                    continue
                finished(sweep.close_before(shape[0]))
                sweep.add(least, copies, *shape)
                if len(done) >= CHUNK:
                    yield given()
        finished(sweep.close_before(math.inf))
        if done:
            yield given()

    return laid.mapInArrow(run, f"image_id {kinds['image_id']}, `group` long, members long, left double, top double, right double, bottom double")
