"""Byte-level BPE encoding and decoding with ranks from a vocabulary file."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from annolake.llm.pretokens import pretoken_begins
from annolake.llm.words import slices

#: Merged pieces that a worker remembers; when full it starts afresh. Pieces over so many bytes are merged by a heap.
CACHE_PIECES, SHORT_BYTES = 400_000, 48


class RankedMerges(dict):
    """Cached pair merging: a piece's bytes to its token ids as native 32-bit integers.

    A token's id is its rank, so the least id among the merges of neighbouring tokens says which merge comes next.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int32, len(self.tokens))
        self.single = [self.ranks[bytes([k])] for k in range(256)]
        #: ``left << 32 | right`` to the token that both make.
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self[b""] = b""

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) > CACHE_PIECES:
            self.clear()
            self[b""] = b""
        whole = self.ranks.get(piece)
        if whole is not None:
            ids = [whole]
        elif len(piece) <= SHORT_BYTES:
            ids = self._short(piece)
        else:
            ids = self._long(piece)
        packed = array("i", ids).tobytes()
        self[piece] = packed
        return packed

    def _short(self, piece: bytes) -> list[int]:
        ids, made, never = list(map(self.single.__getitem__, piece)), self.pairs.get, len(self.tokens)
        costs = [made(a << 32 | b, never) for a, b in pairwise(ids)]
        while costs:
            least = min(costs)
            if least == never:
                break
            at = costs.index(least)
            ids[at] = least
            del ids[at + 1], costs[at]
            if at < len(costs):
                costs[at] = made(least << 32 | ids[at + 1], never)
            if at:
                costs[at - 1] = made(ids[at - 1] << 32 | least, never)
        return ids

    def _long(self, piece: bytes) -> list[int]:
        """The same with a heap of merges over a linked list, for pieces without bound."""
        n, made = len(piece), self.pairs.get
        ids = list(map(self.single.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(cost, k, ids[k], ids[k + 1]) for k in range(n - 1) if (cost := made(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            cost, left, a, b = heapq.heappop(heap)
            right = after[left]
            if right == n or ids[left] != a or ids[right] != b:
                continue  # one of the two has been merged meanwhile
            ids[left], ids[right] = cost, -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for x, y in ((before[left], left), (left, after[left])):
                if x >= 0 and y < n and (cost := made(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (cost, x, ids[x], ids[y]))
        return [k for k in ids if k >= 0]

    def text_of(self, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        """The bytes of each run of ids that ``rows`` (offsets) cut out."""
        parts, edges = list(map(self.tokens.__getitem__, ids.tolist())), rows.tolist()
        return pa.array([b"".join(parts[a:b]) for a, b in pairwise(edges)], pa.binary())


@cache
def merges(path: str) -> RankedMerges:
    return RankedMerges(path)


def split_pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Pre-tokens of all texts in a row, an empty one after each text, and the indexes of those."""
    data, begins, breaks = pretoken_begins([t.decode("utf-8", "replace") for t in texts])
    # A byte that UTF-8 never has goes before each piece but the first.
    new = np.zeros(len(data), np.int64)
    new[begins[1:]] = 1
    marked = np.full(len(data) + max(0, len(begins) - 1), 0xFF, np.uint8)
    marked[np.arange(len(data)) + np.cumsum(new)] = np.frombuffer(data, np.uint8)
    pieces = marked.tobytes().split(b"\xff")
    stops = np.searchsorted(begins, breaks)
    for k in stops.tolist():
        pieces[k] = b""
    return pieces, stops


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", offsets: bool = True, decoded: bool = False, checked: bool = False) -> DataFrame:
    """Per row: id, ``ids``, if wanted ``ends``, the byte offset in the text where each token ends, and ``decoded``, the bytes
    that the ids give back (as ``decode`` would, without a second pass). With ``checked``, ``exact`` says that those are the text's own bytes.

    ``vocabulary`` is the path of a rank file that every executor has. Pre-tokens are merged apart from each other, special
    tokens are ordinary text. Null and empty texts give empty arrays; a text of any length is encoded whole. Other columns are ignored,
    repeated rows stay, an empty table gives an empty result.
    """
    names = ["ids", *["ends"] * offsets, *["decoded"] * decoded, *["exact"] * checked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                pieces, stops = split_pieces(texts)
                encoded = list(map(table.__getitem__, pieces))
                ids = np.frombuffer(b"".join(encoded), np.int32)
                until = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))[stops] // 4
                rows = np.concatenate(([0], until)).astype(np.int32)
                columns = [part.column("_id"), pa.ListArray.from_arrays(rows, ids)]
                if offsets:
                    ends = np.cumsum(table.lengths[ids], dtype=np.int64)
                    base = np.concatenate(([0], ends))[rows[:-1]]
                    ends = (ends - np.repeat(base, np.diff(rows))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(rows, ends))
                back = table.text_of(ids, rows) if decoded or checked else None
                if decoded:
                    columns.append(back)
                if checked:
                    columns.append(pa.array([a == b for a, b in zip(back.to_pylist(), texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", *names])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.selectExpr(f"`{id_column}` as _id", f"coalesce(`{text_column}`, '') as _text")
    kinds = {"ids": "array<int>", "ends": "array<int>", "decoded": "binary", "exact": "boolean"}
    found = rows.mapInArrow(run, ", ".join([f"_id {kind}", *(f"{name} {kinds[name]}" for name in names)]))
    return found.withColumnRenamed("_id", id_column)


def decode(encoded: DataFrame, vocabulary: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes that each row's ids stand for; null ids give no bytes. An id outside the vocabulary raises."""
    names = [c for c in encoded.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary)
        for batch in batches:
            ids = pc.fill_null(batch.column(ids_column), pa.scalar([], batch.column(ids_column).type))
            rows = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(ids)))))
            values = table.text_of(ids.flatten().to_numpy(), rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*names, into])

    frame = encoded.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{kinds}, `{into}` binary")
