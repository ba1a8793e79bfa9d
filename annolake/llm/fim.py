"""Fill-in-middle transformation: texts are cut at two ranks, which an indexable skip list of their units finds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import text_of
from annolake.llm.words import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rearranged; of 100 of those so many put the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: A node of a lane stands on the next lane with this probability.
PROMOTED = 1 / 8


@dataclass
class Lane:
    """The nodes of one lane: how far each reaches in units, code points and bytes, and where it stands on the lane below."""

    units: np.ndarray
    points: np.ndarray
    octets: np.ndarray
    below: np.ndarray | None


class SkipList:
    """An indexable skip list over consecutive units.

    The lowest lane has a node per unit. Each lane above holds some of the nodes of the one below, as coin tosses choose
    (the gaps between them are drawn, from a fixed seed), and each of its nodes is as wide as the nodes that it passes over.
    """

    def __init__(self, points: np.ndarray, octets: np.ndarray) -> None:
        draw = np.random.default_rng(11)
        self.lanes = [Lane(np.broadcast_to(np.int8(1), len(points)), points, octets, None)]
        while len(self.lanes[-1].points) > 2 / PROMOTED:
            low, n = self.lanes[-1], len(self.lanes[-1].points)
            tosses = np.cumsum(draw.geometric(PROMOTED, int(2 * n * PROMOTED) + 64))
            at = np.concatenate(([0], tosses[tosses < n]))  # the head is on every lane
            if tosses[-1] < n:
                at = np.concatenate((at, np.arange(tosses[-1] + 1, n)))
            wide = (np.add.reduceat(width, at, dtype=np.int64) for width in (low.units, low.points, low.octets))
            self.lanes.append(Lane(*wide, at))

    def find(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and bytes before the unit of each rank. All ranks go down the lanes side by side."""
        left = np.asarray(ranks, np.int64).copy()
        points, octets, node = (np.zeros(len(left), np.int64) for _ in range(3))
        for height in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[height]
            last = len(lane.points)
            moving = np.flatnonzero(node < last)
            while len(moving):
                here = node[moving]
                moving = moving[lane.units[here] <= left[moving]]
                here = node[moving]
                left[moving] -= lane.units[here]
                points[moving] += lane.points[here]
                octets[moving] += lane.octets[here]
                node[moving] += 1
                moving = moving[node[moving] < last]
            if lane.below is not None:
                # What has passed the last node of a lane is behind everything.
                node = np.where(node == last, len(self.lanes[height - 1].points), lane.below[np.minimum(node, last - 1)])
        return points, octets


def _units(texts: list[bytes], pattern: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points and bytes of each unit of the joined texts, and how many units each text has."""
    if pattern is None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        octets = np.diff(starts, append=len(data)).astype(np.uint8)
        return np.broadcast_to(np.int8(1), len(starts)), octets, counts
    points, octets, counts = [], [], []
    for raw in texts:
        text, edges = raw.decode("utf-8", "surrogateescape"), {0}
        for match in pattern.finditer(text):
            edges.update(match.span())
        edges = sorted(edges | {len(text)})
        parts = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        points += map(len, parts)
        octets += (len(p.encode("utf-8", "surrogateescape")) for p in parts)
        counts.append(len(parts))
    return np.array(points, np.int64), np.array(octets, np.int64), np.array(counts, np.int64)


def draws(id_column: str, seed: str = "1") -> list[Column]:
    """Four 32-bit numbers of each row: 8-digit groups of the hash of ``seed:id``. A null id counts as the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return [F.conv(F.substring(F.sha2(name, 256), 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: str | None = None, seed: str = "1",
    rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Per row: id, ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (code points), ``output``.

    A unit is a code point, or what the regular expression ``unit`` matches from left to right (what lies between matches is a unit
    too). Both cut ranks follow from the id alone. Form is ``plain`` (the text as it is) for empty texts, texts that hold a
    mark, and the share that stays unchanged; ``psm`` is prefix, suffix, middle behind their marks, ``spm`` suffix, prefix, middle.

    Null texts are empty. Null ids are all cut alike. Rows that repeat an id and text give equal rows. Texts of a batch are handled
    in slices of bounded size, a longer text alone. Other columns, whatever their names, are ignored; an empty table gives an
    empty result.
    """
    h1, h2, h3, h4 = draws(id_column, seed)
    rows = docs.select(F.col(id_column).alias("_id"), text_of(text_column).alias("_text"), h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"))
    pattern = re.compile(unit) if unit is not None else None
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    kind = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                points, octets, counts = _units(texts, pattern)
                base = np.cumsum(counts) - counts
                begin = np.cumsum([0, *map(len, texts)])
                h = [part.column(f"_h{k}").to_numpy() for k in (1, 2, 3, 4)]
                one, two = h[0] % (counts + 1), h[1] % (counts + 1)
                low, high = base + np.minimum(one, two), base + np.maximum(one, two)
                found = SkipList(points, octets).find(np.concatenate((base, low, high)))
                (c0, c1, c2), (_, b1, b2) = (np.split(x, 3) for x in found)
                forms, outputs = [], []
                for k, raw in enumerate(texts):
                    a, b = int(b1[k] - begin[k]), int(b2[k] - begin[k])
                    if not raw or h[2][k] % 100 >= rearranged or any(mark in raw for mark in marks):
                        forms.append("plain")
                        outputs.append(raw)
                    elif h[3][k] % 100 < suffix_first:
                        forms.append("spm")
                        outputs.append(b"".join((s, raw[b:], p, raw[:a], m, raw[a:b])))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((p, raw[:a], s, raw[b:], m, raw[a:b])))
                plain = np.array([form == "plain" for form in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(counts), pa.array(forms, pa.string()), pa.array(c1 - c0, mask=plain), pa.array(c2 - c1, mask=plain),
                     pa.array(outputs, pa.binary()).cast(pa.string(), safe=False)],
                    names=["_id", *kind.names],
                )

    made = rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("_id", id_column)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. Marks occur once in an output that is not plain, for its text holds none."""
    parts = F.split(F.col(output), "|".join(re.escape(mark) for mark in (PREFIX, SUFFIX, MIDDLE)), -1)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (
        F.when(F.col(form) == "psm", F.concat(first, third, second)).when(F.col(form) == "spm", F.concat(second, third, first)).otherwise(F.col(output))
    )
