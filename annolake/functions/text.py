"""Text normalisation and similarity.

Everything that the JVM can decide stays a Column; the Arrow functions see null for rows that are decided already.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
MIN_COMPARED_CHARS = 4
SAME_TEXT_SIMILARITY = 0.9
SHORT_TEXT_CHARS = 2
NEAR_RATIO = 0.86
NEAR_DISTANCE = 3
SHORT_NEAR_DISTANCE = 1

_ASCII = r"^[\x00-\x7F]*$"
_ASCII_DROPPED = r"[\s\x0B\x1C-\x1F\p{Punct}]"
_ASCII_SPACE = r"[\s\x0B\x1C-\x1F]"


@F.pandas_udf(T.StringType())
def _normalize_unicode(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        folded = unicodedata.normalize("NFKC", text).casefold()
        return "".join(c for c in folded if not c.isspace() and unicodedata.category(c)[0] not in "PS")

    return texts.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def _strip_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(t.split()).casefold(), na_action="ignore")


def _split_by_alphabet(text: Column, dropped: str, slow) -> Column:
    text = F.coalesce(text, F.lit(""))
    ascii_only = text.rlike(_ASCII)
    fast = F.regexp_replace(F.lower(text), dropped, "")
    return F.when(ascii_only, fast).otherwise(slow(F.when(~ascii_only, text)))


def normalize_text(text: Column) -> Column:
    """NFKC, case folding, without white space, punctuation and symbols. Null reads as empty."""
    return _split_by_alphabet(text, _ASCII_DROPPED, _normalize_unicode)


def strip_casefold(text: Column) -> Column:
    """Case folding without white space only."""
    return _split_by_alphabet(text, _ASCII_SPACE, _strip_unicode)


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def jaccard(left: Column, right: Column) -> Column:
    a, b = characters(left), characters(right)
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.lit(1), F.size(a) + F.size(b) - shared)


def multiset_bound(left: Column, right: Column) -> Column:
    """Upper bound of the matching ratio from character counts."""
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    units = lambda c: F.length(c)
    shared = F.aggregate(
        F.array_intersect(characters(left), characters(right)),
        F.lit(0),
        lambda acc, c: acc + (F.least(count(left, c), count(right, c)) / units(c)).cast("int"),
    )
    return 2.0 * shared / F.greatest(F.lit(1), F.length(left) + F.length(right))


@F.pandas_udf(T.DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}

    def one(a, b):
        if a is None or b is None:
            return None
        if (a, b) not in known:
            known[a, b] = SequenceMatcher(None, a, b).ratio()
        return known[a, b]

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="object").astype("float64")


def matching_ratio(left: Column, right: Column, needed: Column | None = None) -> Column:
    """Longest-matching-block ratio; ``needed`` limits the rows that reach Python."""
    needed = F.lit(True) if needed is None else needed
    differs = needed & (left != right)
    slow = _ratio(F.when(differs, left), F.when(differs, right))
    return F.when(left == right, F.lit(1.0)).otherwise(slow)


def comparable(left: Column, right: Column) -> Column:
    return (F.length(left) >= MIN_COMPARED_CHARS) & (F.length(right) >= MIN_COMPARED_CHARS)


def text_similarity(left: Column, right: Column) -> Column:
    """Larger of matching ratio and character Jaccard on normalised texts; null below four characters."""
    ok = comparable(left, right)
    return F.when(ok & (left == right), F.lit(1.0)).when(
        ok, F.greatest(matching_ratio(left, right, ok), jaccard(left, right))
    )


def similarity_at_most(left: Column, right: Column, maximum: float) -> Column:
    """``text_similarity <= maximum`` decided by the cheapest bound that settles it."""
    ok = comparable(left, right)
    far = jaccard(left, right) > maximum
    near = multiset_bound(left, right) <= maximum
    undecided = ok & (left != right) & ~far & ~near
    return (
        F.when(~ok, F.lit(False))
        .when(left == right, F.lit(1.0 <= maximum))
        .when(far, F.lit(False))
        .when(near, F.lit(True))
        .otherwise(F.coalesce(matching_ratio(left, right, undecided) <= maximum, F.lit(False)))
    )


def is_same_text(left: Column, right: Column) -> Column:
    """Both non-empty and equal, or similar to at least 0.9."""
    some = (F.length(left) > 0) & (F.length(right) > 0)
    ok = comparable(left, right)
    close = ok & (left != right) & (jaccard(left, right) < SAME_TEXT_SIMILARITY)
    possible = close & (multiset_bound(left, right) >= SAME_TEXT_SIMILARITY)
    return (
        F.when(~some, F.lit(False))
        .when(left == right, F.lit(True))
        .when(~ok, F.lit(False))
        .when(jaccard(left, right) >= SAME_TEXT_SIMILARITY, F.lit(True))
        .otherwise(F.coalesce(matching_ratio(left, right, possible) >= SAME_TEXT_SIMILARITY, F.lit(False)))
    )


def capped_edit_distance(left: Column, right: Column, cap: int) -> Column:
    """Edit distance, or ``cap`` when it is larger (only values up to the cap matter to the callers)."""
    within = F.levenshtein(left, right, cap)
    return F.when(within < 0, F.lit(cap)).otherwise(within)


def is_near_duplicate(
    left: Column, right: Column, ratio: float = NEAR_RATIO, tolerance: int = NEAR_DISTANCE, score: Column | None = None
) -> Column:
    """Near duplicate after strict rules for short texts at the default tolerance."""
    shorter = F.least(F.length(left), F.length(right))
    distance = F.levenshtein(left, right, tolerance)
    if score is None:
        score = matching_ratio(left, right, distance >= 0)
    short_rule = (distance >= 0) & (distance <= SHORT_NEAR_DISTANCE) & (score >= min(ratio, 0.8))
    long_rule = (distance >= 0) & (score >= ratio)
    near = F.when((shorter < 6) & F.lit(tolerance == NEAR_DISTANCE), short_rule).otherwise(long_rule)
    return F.when(shorter == 0, F.lit(False)).otherwise(F.coalesce(near, F.lit(False)))


def is_short_positive(target: Column, normalized: Column) -> Column:
    return target & (F.length(normalized) > 0) & (F.length(normalized) <= SHORT_TEXT_CHARS)


def first_text(*columns: Column) -> Column:
    """First non-empty value, else the empty string."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns), F.lit(""))
