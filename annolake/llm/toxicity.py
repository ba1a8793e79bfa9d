"""Toxicity from misspelling-proof lexicon matches, weighed by the words around them."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.labelled import SAMPLE_ROWS, sample
from annolake.llm.lexicon import Lexicon, lettered_words
from annolake.llm.words import slices

#: Terms at most, and what makes a word a term: share of the toxic texts, number of them, and how much likelier it is there.
TERMS, TERM_SHARE, TERM_TEXTS, TERM_LIFT, TERM_PRECISION = 400, 0.006, 4, 15.0, 0.9
#: A match's context reaches so many words to either side.
CONTEXT_WORDS = 6
#: So many kinds of matches count, the strongest ones; further ones say little new.
STRONGEST = 3
#: Marks that open or close a quotation, words that report speech, words that address someone.
QUOTE_MARKS = "\"«»“”„‘"
REPORTING = ("said", "says", "wrote", "quoted", "quote", "quoting", "term", "word", "called", "reported")
ADDRESSING = ("you", "your", "you're", "u", "du", "dich", "ihr", "tu", "toi", "vous", "te", "usted", "ustedes")
PLAIN, QUOTED, ADDRESSED = range(3)
#: Prior share of toxic texts among those with such a match, as if seen in two texts: plain, quoted, addressed.
PRIORS = (0.5, 0.2, 0.7)


@dataclass
class Model:
    terms: list[str]
    base: float  # share of toxic texts among learned ones without a match
    prior: float  # share of toxic texts among all learned ones
    shares: dict[int, float]  # share of toxic texts by match kind: (3 * term + edits) * 3 + context
    by_edits: list[float]  # the same by number of edits, over all terms: a bound for kinds that were never seen

    def share(self, kind: int) -> float:
        return self.shares.get(kind, min(PRIORS[kind % 3], self.by_edits[kind // 3 % 3]))

    def score(self, kinds: dict[int, int]) -> float:
        """Odds of the base, times those of each kind of match as far as they exceed the prior's; at least the share
        supposed for a kind that was never seen."""
        start = max(self.base, self.prior / 10) if kinds else self.base  # a base of hardly any toxic text would drown one sure match
        level = math.log(start / (1 - start))
        usual = math.log(self.prior / (1 - self.prior))
        shares = [self.share(kind) for kind in kinds]
        gains = sorted((math.log(p / (1 - p)) - usual for p in shares), reverse=True)
        level += sum(max(0.0, gain) for gain in gains[:STRONGEST])
        return max([1 / (1 + math.exp(-level)), *(self.share(kind) for kind in kinds if kind not in self.shares)])


@cache
def _lexicon(terms: tuple[str, ...]) -> Lexicon:
    return Lexicon(list(terms))


@cache
def _context_words() -> Lexicon:
    return Lexicon([*REPORTING, *ADDRESSING])


def matches(texts: list[bytes], terms: tuple[str, ...]) -> list[dict[int, int]]:
    """For each text its match kinds and their counts.

    A match is quoted if a quotation mark opens or closes within the window on both sides, or a reporting word stands
    in it, addressed if it is not quoted and a word that addresses someone is near, else plain.
    """
    found: list[dict[int, int]] = [{} for _ in texts]
    if not terms:
        return found
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    points = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    text_ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    starts, ends, raw = lettered_words(points)
    hit = _lexicon(terms).match(points, starts, ends)
    at = np.flatnonzero(hit >= 0)
    if not len(at):
        return found
    owner = np.searchsorted(text_ends, raw[at], side="right")
    first = np.searchsorted(raw, np.concatenate(([0], text_ends)))  # words of a text: first[k] to first[k + 1]
    low, high = np.maximum(first[owner], at - CONTEXT_WORDS), np.minimum(first[owner + 1], at + CONTEXT_WORDS + 1)
    around = np.zeros(len(raw) + 1, np.int64)
    np.add.at(around, low, 1)
    np.add.at(around, high, -1)
    around = np.flatnonzero(np.cumsum(around)[:-1])
    near = np.full(len(raw), -1, np.int64)
    context = _context_words().match(points, starts[around], ends[around])
    near[around] = np.where(context % 3 == 0, context // 3, -1)
    marks = np.flatnonzero(np.isin(points, [ord(c) for c in QUOTE_MARKS]))
    window_end = np.where(high < len(raw), raw[np.minimum(high, len(raw) - 1)], len(points))
    opened = np.searchsorted(marks, starts[at]) > np.searchsorted(marks, raw[low])
    closed = np.searchsorted(marks, window_end) > np.searchsorted(marks, ends[at])
    for k in range(len(at)):
        words = near[low[k] : high[k]]
        if (opened[k] and closed[k]) or ((words >= 0) & (words < len(REPORTING))).any():
            context = QUOTED
        else:
            context = ADDRESSED if (words >= len(REPORTING)).any() else PLAIN
        kinds, kind = found[owner[k]], int(hit[at[k]]) * 3 + context
        kinds[kind] = kinds.get(kind, 0) + 1
    return found


def _learn_terms(rows: DataFrame, toxic: int, clean: int) -> list[str]:
    """Words that toxic texts hold far more often than others; each text counts once."""
    words = F.transform(F.split(F.lower("_text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    seen = rows.select("_label", F.explode(F.array_distinct(words)).alias("word")).where("word <> '' and length(word) <= 40")
    counts = seen.groupBy("word").agg(F.sum("_label").alias("bad"), F.sum(1 - F.col("_label")).alias("good"))
    lift = (F.col("bad") / max(1, toxic)) / ((F.col("good") + 0.5) / max(1, clean))
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    least = max(TERM_TEXTS, TERM_SHARE * toxic)
    terms = counts.where((F.col("bad") >= least) & (lift >= TERM_LIFT) & (share >= TERM_PRECISION) & (F.length("word") >= 3))
    return sorted(r[0] for r in terms.orderBy(F.desc("bad"), "word").limit(TERMS).select("word").collect())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Terms and match weights from at most ``rows`` labelled rows that ``learn`` admits; texts are used whole.

    Without labelled rows there are no terms, and every text scores the neutral base.
    """
    picked = sample(labels, label, learn, id_column, rows)
    # At most `rows` ids, so the texts are not shuffled for them.
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).where("_text is not null")
    known = texts.join(F.broadcast(picked), "_id")
    totals = known.agg(F.sum("_label"), F.count("*")).first()
    toxic, count = int(totals[0] or 0), int(totals[1])
    terms = tuple(_learn_terms(known, toxic, count - toxic))

    def count_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for part, own in slices(batch, "_text"):
                for kinds, bad in zip(matches(own, terms), part.column("_label").to_pylist(), strict=True):
                    for kind in kinds or (-1,):
                        seen[kind][bad] += 1
        kinds = sorted(seen)
        columns = [pa.array(kinds, pa.int64()), *(pa.array([seen[k][j] for k in kinds], pa.int64()) for j in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "good", "bad"])

    counted = known.select("_text", "_label").mapInArrow(count_kinds, "kind long, good long, bad long")
    cells = {r[0]: (r[1], r[2]) for r in counted.groupBy("kind").agg(F.sum("good"), F.sum("bad")).collect()}
    good, bad = cells.pop(-1, (0, 0))
    prior = (toxic + 0.1) / (count + 2)
    shares = {k: (b + 2 * PRIORS[k % 3]) / (g + b + 2) for k, (g, b) in cells.items()}
    seen = [[n for k, n in cells.items() if k // 3 % 3 == e] for e in range(3)]
    by_edits = [1.0, *((sum(b for _, b in own) + 1) / (sum(g + b for g, b in own) + 2) for own in seen[1:])]
    return Model(list(terms), (bad + 0.1) / (good + bad + 2), prior, shares, by_edits)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``score`` in [0, 1], and ``terms``: the matched terms (as learned) with repeats.

    The score multiplies the odds of a text without matches by what each kind of match (term, number of misspelt letters,
    context) adds to the odds. Null, empty and clean texts score the model's base. Repeated rows score alike; other
    columns are ignored; an empty table gives an empty result.
    """
    kind_of_id, terms = dict(docs.dtypes)[id_column], tuple(model.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                scores, found = [], []
                for kinds in matches(texts, terms):
                    scores.append(model.score(kinds))
                    found.append([terms[k // 9] for k, times in sorted(kinds.items()) for _ in range(times)])
                columns = [part.column("_id"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "score", "terms"])

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind_of_id}, score double, terms array<string>").withColumnRenamed("_id", id_column)
