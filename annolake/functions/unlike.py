"""Which of many pairs of texts are unlike, for two blocks of texts at once."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Letters that are compared at a time.
LETTERS = 2048


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, letter and count of each distinct letter of each text."""
    rows, codes, counts = [], [], []
    for row, text in enumerate(texts):
        own, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        rows.append(np.full(len(own), row))
        codes.append(own)
        counts.append(n)
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(counts)


def _tables(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], sizes: list[int]):
    """Counts of letters, texts x letters, for a bounded number of letters at a time."""
    every = np.unique(np.concatenate([codes for _, codes, _ in sides]))
    for at in range(0, len(every), LETTERS):
        part = every[at : at + LETTERS]
        out = []
        for (rows, codes, counts), size in zip(sides, sizes, strict=True):
            place = np.searchsorted(part, codes)
            inside = (place < len(part)) & (part[np.minimum(place, len(part) - 1)] == codes)
            table = np.zeros((size, len(part)), np.int32)
            table[rows[inside], place[inside]] = counts[inside]
            out.append(table)
        yield out


def common_subsequence(masks: dict[str, int], length: int, text: str) -> int:
    """Length of the longest common subsequence of ``text`` and the text of ``length`` letters whose places ``masks`` hold."""
    every = (1 << length) - 1
    row = every
    for letter in text:
        hit = row & masks.get(letter, 0)
        row = ((row + hit) | (row - hit)) & every
    return length - row.bit_count()


def unlike(left: list[str], right: list[str], maximum: float, wanted: np.ndarray) -> np.ndarray:
    """For the ``wanted`` cells (left x right): whether matching ratio and character Jaccard are both at most ``maximum``.

    Bounds decide nearly all: Jaccard itself, then letters in common with their counts, then the longest common subsequence (matching
    blocks are one). The ratio is only taken of what is left.
    """
    sides, sizes = [_letters(left), _letters(right)], [len(left), len(right)]
    both = np.zeros((len(left), len(right)), np.float32)
    for x, y in _tables(sides, sizes):
        both += (x > 0).astype(np.float32) @ (y > 0).astype(np.float32).T
    distinct = [np.bincount(s[0], minlength=n) for s, n in zip(sides, sizes, strict=True)]
    union = distinct[0][:, None] + distinct[1][None] - both.astype(np.float64)
    out = wanted & ~(both.astype(np.float64) / np.maximum(1, union) > maximum)

    shared = np.zeros(out.shape, np.int64)
    for x, y in _tables(sides, sizes):
        for row in np.flatnonzero(out.any(axis=1)):
            letters, others = np.flatnonzero(x[row]), np.flatnonzero(out[row])
            if len(letters):
                shared[row, others] += np.minimum(y[np.ix_(others, letters)], x[row, letters]).sum(axis=1)
    length = np.array([len(t) for t in left])[:, None] + np.array([len(t) for t in right], np.int64)[None]
    open_ = out & (2.0 * shared / np.maximum(1, length) > maximum)
    for column in np.flatnonzero(open_.any(axis=0)):
        text, masks = right[column], {}
        for place, letter in enumerate(text):
            masks[letter] = masks.get(letter, 0) | 1 << place
        matcher = SequenceMatcher(None, "", text)
        for row in np.flatnonzero(open_[:, column]):
            other = left[row]
            if 2.0 * common_subsequence(masks, len(text), other) / (len(text) + len(other)) > maximum:
                matcher.set_seq1(other)
                out[row, column] = matcher.ratio() <= maximum
    return out
