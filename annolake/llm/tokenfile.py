"""Token ids in files: blocks of whole documents in id order, each range coded on its own and checksummed."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.bpe import split_pieces
from annolake.llm.coder import LANE_IDS, LANES, compress, expand
from annolake.llm.common import BROADCAST_ROWS, text_of
from annolake.llm.words import slices

#: A block is closed once it holds so many ids; a document is never cut, so a longer one makes a longer block.
BLOCK_IDS = LANES * LANE_IDS
#: A worker remembers so many pieces, and those that it remembered before the last time it was full.
CACHE_PIECES = 300_000


class Pieces(dict):
    """Pre-tokens to their ids by the tokenizers library, as native 32-bit integers. Every piece is its own pre-token for the library too,
    unless its text holds an added token: such texts are encoded whole."""

    def __init__(self, path: str, encode_special_tokens: bool) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special_tokens
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: What the library finds in a text before it looks for pre-tokens.
        self.added = [t.content.encode() for t in added if not (t.special and encode_special_tokens)]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.line_end = self._ids("\n")[0]
        self.former: dict[bytes, bytes] = {}
        self[b""] = b""

    def learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces: those without white space but a leading blank all in one text, a line each, where they are pre-tokens as well."""
        distinct = dict.fromkeys(pieces)
        if len(self) + len(distinct) > CACHE_PIECES:
            self.former = dict(self)
            self.clear()
            self[b""] = b""
        self.update((p, self.former[p]) for p in distinct if p in self.former)
        new = [p for p in distinct if p not in self]
        lines = [p for p in new if not (text := p.decode()).isspace() and "\n" not in text]
        ids = np.array(self._ids("\n".join(p.decode() for p in lines)), np.uint32) if lines else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) == len(lines) - 1:
            raw, edges = ids.tobytes(), (4 * np.concatenate(([-1], ends, [len(ids)]))).tolist()
            self.update((p, raw[a + 4 : b]) for p, a, b in zip(lines, edges[:-1], edges[1:], strict=True))
        self.update((p, np.array(self._ids(p.decode()), np.uint32).tobytes()) for p in new if p not in self)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        whole = {k: t.decode("utf-8", "replace") for k, t in enumerate(texts) if any(a in t for a in self.added)}
        pieces, stops = split_pieces([b"" if k in whole else t for k, t in enumerate(texts)] if whole else texts)
        encoded, first, out = list(map(self.get, pieces)), 0, []
        unknown = [k for k, ids in enumerate(encoded) if ids is None]
        if unknown:
            self.learn([pieces[k] for k in unknown])
            for k in unknown:
                encoded[k] = self[pieces[k]]
        for stop in stops.tolist():
            out.append(b"".join(encoded[first:stop]))
            first = stop + 1
        for k, text in whole.items():
            out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        return out


@cache
def _pieces(path: str, encode_special_tokens: bool) -> Pieces:
    return Pieces(path, encode_special_tokens)


def pack(names: list[bytes], lengths: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """A block: checksum, number of documents, sizes of the parts, compressed table of documents, coded ids."""
    sizes = np.array([(len(n), k) for n, k in zip(names, lengths, strict=True)], "<u8").tobytes()
    table = zlib.compress(sizes + b"".join(names), 1)
    body = struct.pack("<II", len(names), len(table)) + table + compress(ids, vocabulary)
    return struct.pack("<I", zlib.crc32(body)) + body


def unpack(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Names, lengths and all ids of a block; raises if it is damaged."""
    if zlib.crc32(block[4:]) != struct.unpack("<I", block[:4])[0]:
        raise ValueError("token block is damaged")
    count, size = struct.unpack("<II", block[4:12])
    table = zlib.decompress(block[12 : 12 + size])
    sizes = np.frombuffer(table, "<u8", 2 * count).reshape(-1, 2).astype(np.int64)
    edges = (16 * count + np.concatenate(([0], np.cumsum(sizes[:, 0])))).tolist()
    return [table[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], sizes[:, 1], expand(block[12 + size :])


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", encode_special_tokens: bool = True
) -> None:
    """Encode every text with the tokenizers library, append ``end_id``, and write blocks to ``path``.

    Rows are dealt out by ranges of the id and sorted, so part after part and block after block they ascend; repeated ids are ordered by
    their text's hash, null ids come first. A row of the Parquet table at ``path`` is one block: ``part, block, start`` (ids of the
    part before it), ``n_tokens, data``. Spark's committer sees to it that a task that runs again leaves no double. Null and
    empty texts are the end id alone; other columns are not written; an empty table gives files without blocks.

    ``encode_special_tokens`` is the library's flag of that name: if true, special tokens in a text are ordinary text; if false
    (as the library loads), each is its own id.
    """
    ordered = docs.select(F.col(id_column).cast("string").alias("_name"), F.col(id_column).alias("_id"), text_of(text_column).alias("_text"))
    ordered = ordered.repartitionByRange("_id").sortWithinPartitions("_id", F.xxhash64("_text")).select("_name", "_text")
    end = np.array([end_id], np.uint32).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, block, start = _pieces(tokenizer, encode_special_tokens), TaskContext.get().partitionId(), 0, 0
        names: list[bytes] = []
        lengths: list[int] = []
        held: list[bytes] = []
        waiting = 0

        def closed() -> pa.RecordBatch:
            data = pack(names, lengths, np.frombuffer(b"".join(held), np.uint32), table.vocabulary)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([waiting], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "block", "start", "n_tokens", "data"])

        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                # A null id has no name: it is written as empty, which no id is.
                for name, ids in zip(rows.column("_name").to_pylist(), table.encode(texts), strict=True):
                    ids += end
                    names.append(b"" if name is None else name.encode())
                    lengths.append(len(ids) // 4)
                    held.append(ids)
                    waiting += lengths[-1]
                    if waiting >= BLOCK_IDS:
                        yield closed()
                        block, start, waiting = block + 1, start + waiting, 0
                        names, lengths, held = [], [], []
        if names:
            yield closed()

    ordered.mapInArrow(encode, "part int, block int, start long, n_tokens long, data binary").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_column: str = "doc_id", id_type: str = "long") -> DataFrame:
    """Per document: id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit).

    The ids of the parts are added up once (a row per part); all else a block knows itself. Damaged blocks raise.
    """
    blocks = spark.read.schema("part int, block int, start long, n_tokens long, data binary").parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("_before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "data")), strict=True):
                names, lengths, ids = unpack(data)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                values = [raw[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array([n.decode() if n else None for n in names], pa.string()), pa.array(np.full(len(names), part), pa.int32()),
                    pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(values, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_name", "part", "_start", "n_tokens", "ids"])

    found = blocks.select("part", "start", "data").mapInArrow(decode, "_name string, part int, _start long, n_tokens long, ids binary")
    # One row per part file, as many as write tasks; joined by broadcast only if counted to be few.
    few = parts.count() <= BROADCAST_ROWS
    return found.join(F.broadcast(parts) if few else parts, "part").select(
        F.col("_name").cast(id_type).alias(id_column), (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", "ids"
    )
