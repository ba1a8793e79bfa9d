"""Language identification: a bidirectional gated recurrent network over bytes, trained by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.words import slices

UNDETERMINED = "und"
#: Units of each direction, bytes the network sees in a row, and bounds of the training sample.
UNITS, SPAN = 8, 256
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC, WINDOW = 600, 4, 64
STEPS, LANES, RATE = 220, 128, 0.02


def _soft(x: np.ndarray) -> np.ndarray:
    """``x / (1 + |x|)``, in place: the layer's squashing function, as tanh would be, at a tenth of its cost."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def _gate_slope(gate: np.ndarray) -> np.ndarray:
    return 0.5 * np.square(1 - np.abs(2 * gate - 1))


class Direction:
    """One gated recurrent layer; gates are update, reset and candidate, in this order."""

    def __init__(self, draw: np.random.Generator) -> None:
        self.inputs = (draw.standard_normal((3, 256, UNITS)) * 0.3).astype(np.float32)
        self.recurrent = (draw.standard_normal((3, UNITS, UNITS)) / np.sqrt(UNITS)).astype(np.float32)

    def run(self, steps: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Outputs ``(time, lanes, units)`` for bytes ``(time, lanes)``; ``trace`` keeps what backpropagation needs.

        A gate is ``(soft(x) + 1) / 2``, a candidate ``soft(input + r * q)``, the new state ``z * h + (1 - z) * c``.
        """
        h = np.zeros((steps.shape[1], UNITS), np.float32)
        out = np.empty((*steps.shape, UNITS), np.float32)
        for t, x in enumerate(steps.astype(np.intp)):
            gates = []
            for k in (0, 1):
                gate = self.inputs[k].take(x, axis=0)
                gate += h @ self.recurrent[k]
                _soft(gate)
                gate += 1
                gate *= 0.5
                gates.append(gate)
            z, r = gates
            q = h @ self.recurrent[2]
            c = self.inputs[2].take(x, axis=0)
            c += r * q
            _soft(c)
            new = np.subtract(h, c, out=out[t])
            new *= z
            new += c
            if trace is not None:
                trace.append((h, z, r, q, c))
            h = new
        return out

    def back(self, steps: np.ndarray, trace: list, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``inputs`` and ``recurrent`` for the slope of the loss by the outputs."""
        g_in, g_rec = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        ahead = np.zeros_like(slope[0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, q, c = trace[t]
            d = slope[t] + ahead
            dc = d * (1 - z) * np.square(1 - np.abs(c))
            dq = dc * r
            parts = (d * (h - c) * _gate_slope(z), dc * q * _gate_slope(r), dc)
            for k, part in enumerate(parts):
                np.add.at(g_in[k], steps[t], part)
            ahead = d * z
            for k, part in enumerate((parts[0], parts[1], dq)):
                g_rec[k] += h.T @ part
                ahead += part @ self.recurrent[k].T
        return g_in, g_rec


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    heads: np.ndarray  # (2, units, languages)
    bias: np.ndarray

    def positions(self, steps: np.ndarray) -> np.ndarray:
        """Label probabilities ``(languages, time, lanes)`` of every position."""
        ahead, back = self.forward.run(steps), self.backward.run(steps[::-1])
        logits = (self.heads[0].T @ ahead.reshape(-1, UNITS).T).reshape(-1, *steps.shape)
        logits += (self.heads[1].T @ back.reshape(-1, UNITS).T).reshape(-1, *steps.shape)[:, ::-1]
        logits += self.bias[:, None, None]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=0)
        return logits

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of each text: the mean over all its positions, of whole texts cut into lanes of ``SPAN`` bytes."""
        lanes = np.array([-(-len(t) // SPAN) for t in texts], np.int64)
        grid = np.zeros((int(lanes.sum()), SPAN), np.uint8)
        flat, at = grid.reshape(-1), np.concatenate(([0], np.cumsum(lanes)))
        used = np.zeros(len(grid), np.int64)
        for text, first, last in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True):
            if text:
                flat[first * SPAN : first * SPAN + len(text)] = np.frombuffer(text, np.uint8)
                used[first:last] = SPAN
                used[last - 1] = len(text) - (last - 1 - first) * SPAN
        sums = np.zeros((len(grid), len(self.languages)), np.float64)
        for k in range(0, len(grid), 2048):
            found = self.positions(np.ascontiguousarray(grid[k : k + 2048].T))
            found *= np.arange(SPAN)[:, None] < used[None, k : k + 2048]
            sums[k : k + 2048] = found.sum(axis=1).T
        owner = np.repeat(np.arange(len(texts)), lanes)
        pooled = np.stack([np.bincount(owner, sums[:, j], len(texts)) for j in range(len(self.languages))], axis=1)
        return pooled / np.maximum(1, np.array(list(map(len, texts))))[:, None]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 11) -> Network:
    """Fit by Adam on random batches of windows ``(count, WINDOW)``; languages are drawn equally often."""
    draw = np.random.default_rng(seed)
    net = Network(
        languages, Direction(draw), Direction(draw),
        (draw.standard_normal((2, UNITS, len(languages))) * 0.3).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    groups = [np.flatnonzero(labels == k) for k in range(len(languages))]
    values = [net.forward.inputs, net.forward.recurrent, net.backward.inputs, net.backward.recurrent, net.heads, net.bias]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, STEPS + 1):
        want = draw.integers(0, len(languages), LANES)
        rows = np.array([groups[k][draw.integers(0, len(groups[k]))] for k in want])
        steps = np.ascontiguousarray(windows[rows].T)
        back_steps = np.ascontiguousarray(steps[::-1])
        traces: tuple[list, list] = ([], [])
        out = (net.forward.run(steps, traces[0]), net.backward.run(back_steps, traces[1]))
        logits = out[0] @ net.heads[0] + out[1][::-1] @ net.heads[1] + net.bias
        logits -= logits.max(axis=2, keepdims=True)
        slope = np.exp(logits)
        slope /= slope.sum(axis=2, keepdims=True)
        slope[:, np.arange(LANES), want] -= 1
        slope /= LANES * WINDOW
        flat = slope.reshape(-1, len(languages))
        g_heads = np.stack([out[0].reshape(-1, UNITS).T @ flat, out[1][::-1].reshape(-1, UNITS).T @ flat])
        g = [
            *net.forward.back(steps, traces[0], slope @ net.heads[0].T),
            *net.backward.back(back_steps, traces[1], (slope @ net.heads[1].T)[::-1]),
            g_heads, flat.sum(axis=0),
        ]
        for v, a, b, d in zip(values, first, second, g, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            v -= RATE * min(1.0, 2 - 2 * step / STEPS) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def training_windows(docs: DataFrame, learn, id_column: str, text_column: str, language_column: str) -> DataFrame:
    """``language, windows``: of each language the ``DOCS_PER_LANGUAGE`` documents whose hash comes first (their whole
    texts are open to it: windows lie at evenly spread places)."""
    rows = docs.where(learn & F.col(language_column).isNotNull() & F.col(text_column).rlike(r"\p{L}"))
    picked = rows.select(F.col(id_column).alias("_id"), F.col(language_column).cast("string").alias("_language"))
    # First within shares of a language, so that a frequent one is spread over tasks; of each share at most the bound goes on.
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = picked.withColumn("_share", F.pmod(F.xxhash64("_id", F.lit("share")), F.lit(64)))
    for group in (["_language", "_share"], ["_language"]):
        rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
        picked = picked.withColumn("_n", rank).where(F.col("_n") <= DOCS_PER_LANGUAGE)
    picked = picked.select("_id", "_language").distinct()
    texts = rows.select(F.col(id_column).alias("_id"), F.col(language_column).cast("string").alias("_language"), F.col(text_column).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in slices(batch, "_text"):
                made = []
                for text in own:
                    room = max(0, len(text) - WINDOW)
                    starts = [room * k // max(1, WINDOWS_PER_DOC - 1) for k in range(WINDOWS_PER_DOC)]
                    made.append(b"".join(text[s : s + WINDOW].ljust(WINDOW) for s in starts))
                yield pa.RecordBatch.from_arrays([part.column("_language"), pa.array(made, pa.binary())], names=["language", "windows"])

    # At most DOCS_PER_LANGUAGE ids per language: narrow and bounded, so that texts are not shuffled for it.
    return texts.join(F.broadcast(picked), ["_id", "_language"], "left_semi").mapInArrow(cut, "language string, windows binary")


def fit(docs: DataFrame, learn, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> Network | None:
    """Train on a sample bounded by ``DOCS_PER_LANGUAGE``; None if no row can be learned from."""
    rows = training_windows(docs, learn, id_column, text_column, language_column).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    windows = np.concatenate([np.frombuffer(r[1], np.uint8).reshape(-1, WINDOW) for r in rows])
    labels = np.repeat([languages.index(r[0]) for r in rows], WINDOWS_PER_DOC)
    return train(windows, labels, languages)


def identify(docs: DataFrame, network: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``language`` and ``score``, the pooled probability of that language over all bytes of the whole text.

    ``und`` with score 0 if the text is null, empty or has no letter, or if nothing was learned. Ties go to the language that
    sorts first. Other columns are ignored; repeated rows get the same result; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                if network is None:
                    names, best = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                else:
                    found = network.documents(texts)
                    names = [network.languages[k] if t else UNDETERMINED for k, t in zip(found.argmax(axis=1), texts, strict=True)]
                    best = np.minimum(found.max(axis=1), 1.0)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(names), pa.array(best, pa.float64())], names=["_id", "language", "score"])

    lettered = F.when(F.col(text_column).rlike(r"\p{L}"), F.col(text_column)).otherwise("")
    rows = docs.select(F.col(id_column).alias("_id"), lettered.alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, language string, score double").withColumnRenamed("_id", id_column)
