"""Context-mixing range coder for token ids.

A block is coded on its own: models start afresh and a checksum covers all of it. Its ids are cut into lanes of equal length that
advance together and share the models, so that one numpy operation serves all lanes. Three predictions are mixed for
each id: the id that last followed the two ids before it (order 2), the one that last followed the id before (order 1), and
the counts of all ids so far (order 0). How often the two candidates have been right lately gives two probabilities,
which a logistic mixer with learned weights joins; the range coder then codes which candidate is right, and if none is, the id by
order 0. All arithmetic is in integers, so decoding gives the same on any machine.

What the mixer says depends on how sure both candidates are and whether they are the same: 128 cases, which are worked out once for
a step. Lanes only look their case up, and a count of cases and outcomes is all that the mixer learns from.
"""

from __future__ import annotations

import struct
import zlib
from functools import cache

import numpy as np

MAGIC = b"IDC2"
#: Lanes at most, and how many ids each holds at least (but in the last lane of a block).
LANES, LANE_IDS = 8192, 128
#: Slots of the order-2 table; a slot's confidence runs up to LIMIT (its low SURE_BITS bits).
SLOT_BITS, LIMIT, SURE_BITS = 18, 7, 3
#: Probabilities have 16 bits in the coder and 12 in the mixer; order-0 counts grow by GAIN.
SCALE, MIXED, GAIN = 16, 12, 24
#: Order-0 intervals are drawn anew after so many steps of all lanes.
EVERY = 4
U64 = np.uint64
#: The cases ``sure2 << 4 | sure1 << 1 | same``.
CASES = np.arange((LIMIT + 1) ** 2 * 2)
SURE2, KIND1, SURE1, SAME = CASES >> 4, CASES & 15, CASES >> 1 & LIMIT, (CASES & 1).astype(bool)
#: What a hit (first row) and a miss add to an entry of each confidence.
STEP = np.array([[1] * LIMIT + [0], [(n >> 1) - n for n in range(LIMIT + 1)]]).ravel()


@cache
def _curves() -> tuple[np.ndarray, np.ndarray]:
    """``stretch`` of a 12-bit probability (in 1/256) and ``squash`` of a sum from -2047 to 2047."""
    p = (np.arange(1 << MIXED) + 0.5) / (1 << MIXED)
    stretch = np.rint(256 * np.log(p / (1 - p))).astype(np.int64)
    squash = np.rint((1 << MIXED) / (1 + np.exp(-np.arange(-2047, 2048) / 256))).astype(np.int64)
    return stretch, np.clip(squash, 1, (1 << MIXED) - 1)


class Models:
    """Everything that adapts while a block is coded. An entry of the tables ``two`` and ``one`` is ``id << SURE_BITS | confidence``."""

    def __init__(self, vocabulary: int) -> None:
        self.two, self.one = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(vocabulary, np.int64)
        self.right2 = np.full(LIMIT + 1, 1 << (MIXED - 1), np.int64)  # chance that a slot of this confidence is right
        self.right1 = np.full(2 * (LIMIT + 1), 1 << (MIXED - 1), np.int64)
        self.other = np.full(LIMIT + 1, 1 << (MIXED - 1), np.int64)  # the same for order 1 where order 2 was wrong
        self.weights = np.array([9, 9], np.int64) << 12  # in 1 / 2^16
        self.counts, self.seen = np.ones(vocabulary, np.int64), []
        #: By ``case << 2 | outcome`` (0 the first candidate, 1 the second, 2 neither): where the coder's interval begins, and its size.
        self.at, self.size = np.zeros((len(CASES), 4), np.int64), np.zeros((len(CASES), 4), np.int64)
        self.refresh()

    def refresh(self) -> None:
        """Order-0 intervals that add up to 2^SCALE or less; halve the counts before they outgrow the coder."""
        total = int(self.counts.sum())
        if total > 1 << 24:
            self.counts = (self.counts + 1) >> 1
            total = int(self.counts.sum())
        self.total = total
        self.until = np.cumsum(self.counts)

    def predict(self, before: np.ndarray, last: np.ndarray) -> None:
        """Candidates and cases of all lanes, and the coder's intervals (of 2^SCALE) of each case."""
        stretch, squash = _curves()
        self.x2, self.x1 = stretch[self.right2][SURE2], stretch[self.right1][KIND1]
        dot = np.minimum(np.maximum((self.weights[0] * self.x2 + self.weights[1] * self.x1) >> 16, -2047), 2047)
        self.p = squash[dot + 2047]
        width1 = np.minimum(np.maximum(self.p << (SCALE - MIXED), 64), (1 << SCALE) - 256)
        rest = (1 << SCALE) - width1
        width2 = np.minimum(np.maximum(rest * self.other[SURE1] >> MIXED, 1), rest - 64)
        width2[SAME] = 0
        self.at[:, 1], self.at[:, 2] = width1, width1 + width2
        self.size[:, 0], self.size[:, 1], self.size[:, 2] = width1, width2, rest - width2

        self.slot = ((before * 0x2F0B4C47 + last * 0x9E3779B1) >> 7) & ((1 << SLOT_BITS) - 1)
        self.last = last
        self.entry2, self.entry1 = self.two[self.slot], self.one[last]
        self.sure2, self.sure1 = self.entry2 & LIMIT, self.entry1 & LIMIT
        self.first, self.second = self.entry2 >> SURE_BITS, self.entry1 >> SURE_BITS
        self.case = self.sure2 << 6 | self.sure1 << 3 | (self.first == self.second).astype(np.int64) << 2

    def update(self, found: np.ndarray, missed2: np.ndarray, outcome: np.ndarray) -> None:
        """``outcome`` is ``case << 2`` and which of the three was coded; ``missed2``: the first candidate is not it."""
        seen = np.bincount(outcome, minlength=self.at.size).reshape(-1, 4)
        each, hit2 = seen.sum(axis=1), seen[:, 0]
        error = (hit2 << MIXED) - self.p * each
        self.weights += np.array([error @ self.x2, error @ self.x1]) // len(found) >> 6
        by2, by1 = (LIMIT + 1, -1), (-1, 2 * (LIMIT + 1))
        self._toward(self.right2, each.reshape(by2).sum(axis=1), hit2.reshape(by2).sum(axis=1))
        self._toward(self.right1, each.reshape(by1).sum(axis=0), hit2.reshape(by1).sum(axis=0))
        differ = (LIMIT + 1, LIMIT + 1, 2)
        self._toward(self.other, (each - hit2).reshape(differ)[:, :, 0].sum(axis=0), seen[:, 1].reshape(differ)[:, :, 0].sum(axis=0))
        fresh = found << SURE_BITS
        for table, at, entry, sure, missed in (
            (self.two, self.slot, self.entry2, self.sure2, missed2), (self.one, self.last, self.entry1, self.sure1, self.second != found)
        ):
            now = entry + STEP[sure + (missed.view(np.int8) << SURE_BITS)]
            np.copyto(now, fresh, where=missed & (sure < 2))
            table[at] = now
        self.seen.append(found)
        if len(self.seen) == EVERY:
            self.counts += GAIN * np.bincount(np.concatenate(self.seen), minlength=len(self.counts))
            self.seen.clear()
            self.refresh()

    @staticmethod
    def _toward(table: np.ndarray, seen: np.ndarray, hits: np.ndarray) -> None:
        """Move each kind's chance by up to an eighth toward this step's share of hits, the more the more lanes say so."""
        goal = (hits << MIXED) // np.maximum(seen, 1)
        moved = table + ((goal - table) * np.minimum(seen, 16) >> 7)
        np.minimum(np.maximum(moved, 8), (1 << MIXED) - 8, out=table)


LOW32, ONE, HALF = U64(0xFFFFFFFF), U64(1), U64(32)


class Ranges:
    """The range ``[low, low + width)`` of each lane."""

    def __init__(self, lanes: int) -> None:
        self.low, self.width = np.zeros(lanes, U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)

    def narrow(self, unit: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All lanes to the part ``[at, at + size)``, in units; which lanes give out a word, and the words."""
        self.low += unit * at.view(U64)
        self.width = unit * size.view(U64)
        return self.shift(np.flatnonzero(self.width <= LOW32))

    def narrow_some(self, lanes: np.ndarray, unit: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for some lanes."""
        self.low[lanes] += unit * at.view(U64)
        width = unit * size.view(U64)
        self.width[lanes] = width
        return self.shift(lanes[width <= LOW32])

    def shift(self, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, width = self.low[short], self.width[short]
        # A short range that spans a word border is cut at it, so that the word is settled and no carry follows.
        word = low >> HALF
        cut = word != (low + (width - ONE)) >> HALF
        np.copyto(width, (~low & LOW32) + ONE, where=cut)
        self.low[short], self.width[short] = low << HALF, width << HALF
        return short, word


def _lanes(count: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, -(-count // LANE_IDS)))
    return lanes, -(-count // lanes)


def compress(ids: np.ndarray, vocabulary: int) -> bytes:
    """The ids as bytes that ``expand`` reads. No ids are fine; an id must be below ``vocabulary``."""
    lanes, steps = _lanes(len(ids))
    grid = np.zeros(lanes * steps, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    ranges, given = Ranges(lanes), []
    models, before, last = Models(vocabulary), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for found in grid:
        models.predict(before, last)
        missed2 = models.first != found
        neither = missed2 & (models.second != found)
        outcome = models.case + (missed2.view(np.int8) + neither.view(np.int8))
        given.append(ranges.narrow(ranges.width >> U64(SCALE), models.at.ravel()[outcome], models.size.ravel()[outcome]))
        escaped = np.flatnonzero(neither)
        own = found[escaped]
        size = models.counts[own]
        given.append(ranges.narrow_some(escaped, ranges.width[escaped] // U64(models.total), models.until[own] - size, size))
        models.update(found, missed2, outcome)
        before, last = last, found
    every = np.arange(lanes)
    given += [(every, ranges.low >> HALF), (every, ranges.low & LOW32)]
    # Words lane by lane, each lane's in the order of steps.
    lane, words = (np.concatenate(parts) for parts in zip(*given, strict=True))
    body = words[np.argsort(lane.astype(np.uint16), kind="stable")].astype("<u4").tobytes()
    head = struct.pack("<III", len(ids), lanes, vocabulary) + np.bincount(lane, minlength=lanes).astype("<u4").tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(head + body)) + head + body


def expand(block: bytes) -> np.ndarray:
    """The ids of a block; raises if its checksum does not fit."""
    if block[:4] != MAGIC or zlib.crc32(block[8:]) != struct.unpack("<I", block[4:8])[0]:
        raise ValueError("token block is damaged")
    count, lanes, vocabulary = struct.unpack("<III", block[8:20])
    sizes = np.frombuffer(block, "<u4", lanes, 20).astype(np.int64)
    stream = np.concatenate((np.frombuffer(block, "<u4", -1, 20 + 4 * lanes).astype(U64), np.zeros(2, U64)))
    place = np.cumsum(sizes) - sizes
    steps = _lanes(count)[1]
    ranges, code = Ranges(lanes), stream[place] << HALF | stream[place + 1]
    place += 2
    grid = np.zeros((steps, lanes), np.int64)
    models, before, last = Models(vocabulary), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def read(short: np.ndarray, word: np.ndarray) -> None:
        at = place[short]
        code[short] = code[short] << HALF | stream[np.minimum(at, len(stream) - 1)]
        place[short] = at + 1

    for step in range(steps):
        models.predict(before, last)
        unit, ahead = ranges.width >> U64(SCALE), code - ranges.low
        missed2 = ahead >= unit * models.at[:, 1].view(U64)[models.case >> 2]
        neither = ahead >= unit * models.at[:, 2].view(U64)[models.case >> 2]
        outcome = models.case + (missed2.view(np.int8) + neither.view(np.int8))
        read(*ranges.narrow(unit, models.at.ravel()[outcome], models.size.ravel()[outcome]))
        found = np.where(missed2, models.second, models.first)
        escaped = np.flatnonzero(neither)
        unit = ranges.width[escaped] // U64(models.total)
        value = np.minimum((code[escaped] - ranges.low[escaped]) // unit, U64(models.total - 1)).view(np.int64)
        order = np.argsort(value)  # in order they are found faster
        own = np.empty_like(value)
        own[order] = np.searchsorted(models.until, value[order], side="right")
        found[escaped] = own
        size = models.counts[own]
        read(*ranges.narrow_some(escaped, unit, models.until[own] - size, size))
        models.update(found, missed2, outcome)
        grid[step] = found
        before, last = last, found
    return grid.T.reshape(-1)[:count].astype(np.uint32)
