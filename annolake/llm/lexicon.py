"""A lexicon trie intersected with Levenshtein automata, run over the words of many texts at once."""

from __future__ import annotations

import numpy as np

from annolake.llm.pretokens import GAP, OTHER, class_table

#: Known states at most; beyond that the automaton is built anew from its start.
STATES = 100_000
DEAD, START = 0, 1


def edits_allowed(term: str) -> int:
    """Misspellings that still count: none in short terms, one from five letters on, two from twelve on."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class Lexicon:
    """Deterministic product of the trie of the terms and their Levenshtein automata, built as words reach new states.

    A state is a set of (trie node, edits) pairs. ``match`` advances all words of a text slice by one letter at a
    time, so that a word costs a table look-up per letter until its state is dead.
    """

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.children: list[dict[int, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.room: list[int] = [0]
        letters = sorted({c for t in terms for c in t})
        self.letter = {c: k + 1 for k, c in enumerate(letters)}  # 0: any other
        for index, term in enumerate(terms):
            node, allowed = 0, edits_allowed(term)
            self.room[0] = max(self.room[0], allowed)
            for c in term:
                child = self.children[node].get(self.letter[c])
                if child is None:
                    child = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.room.append(0)
                    self.children[node][self.letter[c]] = child
                node = child
                self.room[node] = max(self.room[node], allowed)
            self.term_at[node] = index
        self.longest = max((len(t) + edits_allowed(t) for t in terms), default=0)
        self.codes = np.zeros(0x110000, np.int32)
        for c, k in self.letter.items():
            self.codes[ord(c)] = k
        self._reset()

    def _reset(self) -> None:
        width = len(self.letter) + 1
        self.table = np.full((64, width), -1, np.int32)
        self.table[DEAD] = DEAD
        self.sets: list[tuple] = [(), self._closure({0: 0})]
        self.known = {s: k for k, s in enumerate(self.sets)}
        self.accepts = [-1, self._accept(self.sets[START])]

    def _closure(self, best: dict[int, int]) -> tuple:
        """Add what skipping letters of a term reaches; keep the fewest edits of each node."""
        stack = list(best.items())
        while stack:
            node, edits = stack.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.room[child] and edits + 1 < best.get(child, 9):
                    best[child] = edits + 1
                    stack.append((child, edits + 1))
        return tuple(sorted(best.items()))

    def _accept(self, state: tuple) -> int:
        """``3 * term + edits`` of the best term that ends here, or -1."""
        ends = [(e, self.term_at[n]) for n, e in state if self.term_at[n] >= 0 and e <= edits_allowed(self.terms[self.term_at[n]])]
        return min((3 * t + e for e, t in [min(ends)]), default=-1) if ends else -1

    def _advance(self, state: tuple, code: int) -> tuple:
        best: dict[int, int] = {}
        for node, edits in state:
            if edits + 1 <= self.room[node] and edits + 1 < best.get(node, 9):
                best[node] = edits + 1  # a letter too many
            for letter, child in self.children[node].items():
                cost = edits + (letter != code)
                if cost <= self.room[child] and cost < best.get(child, 9):
                    best[child] = cost
        return self._closure(best)

    def _grow(self, state: int, code: int) -> None:
        found = self._advance(self.sets[state], code)
        index = self.known.get(found)
        if index is None:
            index = self.known[found] = len(self.sets)
            self.sets.append(found)
            self.accepts.append(self._accept(found))
            if index >= len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
        self.table[state, code] = index

    def match(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word ``3 * term + edits`` of its nearest term (exact before misspelt), or -1."""
        if len(self.sets) > STATES:
            self._reset()
        found = np.full(len(starts), -1, np.int64)
        size = ends - starts
        rows = np.flatnonzero((size <= self.longest) & (size > 0))
        state = np.full(len(rows), START, np.int32)
        codes, step = self.codes[points], 0
        while len(rows):
            code = codes[starts[rows] + step]
            after = self.table[state, code]
            for s, c in {(int(s), int(c)) for s, c in zip(state[after < 0], code[after < 0], strict=True)}:
                self._grow(s, c)
            after = self.table[state, code]
            step += 1
            over = size[rows] == step
            if over.any():
                found[rows[over]] = np.array(self.accepts, np.int64)[after[over]]
            going = (after != DEAD) & ~over
            rows, state = rows[going], after[going]
        return found


def lettered_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space without the marks at their ends: starts, ends, and the raw starts."""
    kind = class_table()[points]
    edge = np.flatnonzero(np.diff(kind == GAP, prepend=True, append=True))
    raw, stop = edge[0::2], edge[1::2]
    solid = np.flatnonzero(kind < OTHER)
    if not len(solid):
        return raw, raw, raw
    first = solid[np.minimum(np.searchsorted(solid, raw), len(solid) - 1)]
    last = solid[np.maximum(np.searchsorted(solid, stop) - 1, 0)] + 1
    none = (first >= stop) | (first < raw)
    return np.where(none, raw, first), np.where(none, raw, last), raw
