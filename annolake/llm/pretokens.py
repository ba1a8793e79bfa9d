"""Pre-tokens without regular expressions: code-point classes and an associative scan of transition functions.

The boundaries are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Each code point becomes a symbol (its class, with a look at its neighbours where the pattern looks ahead), each symbol is a
function from automaton state to automaton state, and functions compose: the state before every position follows from a scan over
equal-length lanes, all lanes at once, whatever the text.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

# Symbols. A suffix apostrophe may open one of the seven suffixes of one or two letters; a gap is white space followed by more of it
# or by the end; a last gap is the last white space before something else; a blank is such a last one that is U+0020.
LETTER, NUMBER, OTHER, SUFFIX1, SUFFIX2, GAP, LAST_GAP, BLANK, BREAK = range(9)
# States: which token is open.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_GAP, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
#: Unicode White_Space, as code points.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
#: Letters that follow the apostrophe in the suffixes.
SUFFIX_LETTERS = ("s", "t", "m", "d")
SUFFIX_PAIRS = ("re", "ve", "ll")
#: Letters and numbers that Unicode 16.0 added, for interpreters with older tables (first and last code point).
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
LANE = 256


@cache
def class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER or GAP for each code point, by the general categories of Unicode 16.0."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for low, high in ranges:
            table[low : high + 1] = kind
    table[list(WHITE_SPACE)] = GAP
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token begins at this symbol."""
    if symbol == BREAK:
        return START, True
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return START, False
    if symbol == GAP:
        return IN_GAP, state != IN_GAP
    if symbol in (LAST_GAP, BLANK):
        return (AFTER_BLANK if symbol == BLANK else START), True
    joined = state == AFTER_BLANK
    if symbol in (SUFFIX1, SUFFIX2) and state not in (IN_OTHERS, AFTER_BLANK):
        return (ONE_MORE if symbol == SUFFIX1 else TWO_MORE), True
    own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    return own, not joined and state != own


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first[symbol]`` is its function, ``then[f, g]`` is ``g`` after ``f``, ``apply[f, state]``, ``begins[state, symbol]``."""
    symbols, states = range(9), range(8)
    identity = tuple(states)
    known: dict[tuple[int, ...], int] = {identity: 0}
    first = [known.setdefault(tuple(_step(s, x)[0] for s in states), len(known)) for x in symbols]
    grown = True
    while grown:
        grown = False
        for f in list(known):
            for x in symbols:
                both = tuple(_step(s, x)[0] for s in f)
                if both not in known:
                    known[both] = len(known)
                    grown = True
    functions = list(known)
    then = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], dtype=np.uint16)
    begins = np.array([[_step(s, x)[1] for x in symbols] for s in states])
    return np.array(first, np.uint16), then, np.array(functions, np.uint8), begins


def symbols_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``ends`` are the positions of the breaks after each text (any code point stands there)."""
    symbol = class_table()[points]
    symbol[ends] = BREAK
    after = np.append(symbol[1:], np.uint8(BREAK))
    last = (symbol == GAP) & (after != GAP) & (after != BREAK)
    symbol[last] = np.where(points[last] == 32, BLANK, LAST_GAP)
    quote = np.flatnonzero((points == 39) & (symbol == OTHER))
    quote = quote[quote + 1 < len(points)]
    next1 = points[quote + 1]
    symbol[quote[np.isin(next1, [ord(c) for c in SUFFIX_LETTERS])]] = SUFFIX1
    quote = quote[quote + 2 < len(points)]
    two = points[quote + 1].astype(np.int64) << 21 | points[quote + 2]
    symbol[quote[np.isin(two, [ord(a) << 21 | ord(b) for a, b in SUFFIX_PAIRS])]] = SUFFIX2
    # The break's own place may hold any code point, so a suffix never reaches over it.
    symbol[ends] = BREAK
    return symbol


def states_before(symbol: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol: compose within lanes, scan the lanes, then walk all lanes at once."""
    first, then, apply, _ = _automaton()
    n = len(symbol)
    lanes = -(-n // LANE)
    function = np.zeros(lanes * LANE, dtype=np.uint16)
    function[:n] = first[symbol]
    grid = np.ascontiguousarray(function.reshape(lanes, LANE).T)
    prefix = np.empty_like(grid)
    running = np.zeros(lanes, dtype=np.uint16)
    flat, width = then.ravel(), np.intp(then.shape[1])
    for k in range(LANE):
        prefix[k] = running
        running = flat[running * width + grid[k]]
    total, span = running, 1
    while span < lanes:  # inclusive scan over lanes by doubling
        total = np.concatenate((total[:span], flat[total[:-span] * width + total[span:]]))
        span *= 2
    at_lane = apply[np.concatenate((np.zeros(1, np.uint16), total[:-1])), START]
    return apply.ravel()[prefix * np.intp(apply.shape[1]) + at_lane].T.reshape(-1)[:n]


def pretoken_begins(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as UTF-8 with a zero byte after each, byte offsets where pre-tokens begin (breaks too), and the breaks' offsets."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    symbol = symbols_of(points, ends)
    begins = _automaton()[3].ravel()[states_before(symbol) * np.intp(9) + symbol]
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offset = np.cumsum(width) - width
    return joined.encode("utf-8", "surrogatepass"), offset[begins], offset[ends]
