"""Pre-tokens, merges, the range coder and token files against the libraries."""

import base64
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from annolake.llm import bpe, coder, tokenfile
from annolake.llm.pretokens import pretoken_begins
from annolake.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n):
    draw = random.Random(9)
    parts = [*"ab1 '\n\t.s trevlmd’é 　中٣!\0", "'s", "'ll", "the ", "hello", "\U00010d45", "\U0001f600", "Ɤ", "<|endoftext|>"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_pretokens_follow_the_pattern():
    pattern, texts = regex.compile(public_tokenizers.PATTERN), odd_texts(3000)
    texts = [t.replace("\U00010d45", "a") for t in texts]  # newer than some tables of the regex module
    data, begins, breaks = pretoken_begins(texts)
    ends, marks = [*begins.tolist()[1:], len(data)], set(breaks.tolist())
    got, own = [], []
    for a, b in zip(begins.tolist(), ends, strict=True):
        if a in marks:
            got.append(own)
            own = []
        else:
            own.append(data[a:b].decode())
    assert got == [pattern.findall(t) for t in texts]


def test_merges_equal_the_library(make_docs, reference):
    texts = [*odd_texts(300), "a" * 3000, "ab" * 2000, "word " * 5000, "", None]
    docs = make_docs(list(enumerate(texts)))
    for r in bpe.encode(docs, RANKS, decoded=True).collect():
        text = texts[r.doc_id] or ""
        assert list(r.ids) == reference.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        assert list(r.ends) == np.cumsum([len(reference.decode_single_token_bytes(i)) for i in r.ids]).astype(int).tolist()


def test_decode_is_its_own_operator(make_docs):
    texts = ["one two", None, "", "drei"]
    encoded = bpe.encode(make_docs(list(enumerate(texts))), RANKS, offsets=False)
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, RANKS).collect()}
    assert got == {k: (t or "").encode() for k, t in enumerate(texts)}
    assert bpe.decode(bpe.encode(make_docs([]), RANKS), RANKS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000, 140_000])
def test_coder_round_trip(n):
    draw = np.random.default_rng(n)
    for ids in (draw.integers(0, 50257, n), draw.zipf(1.4, n) % 50257, np.full(n, 2), np.tile(draw.integers(0, 50257, 50), n // 50 + 1)[:n]):
        block = coder.compress(ids, 50257)
        assert (coder.expand(block) == ids).all()


def test_coder_learns_and_checks():
    ids = np.tile(np.arange(40), 1000)
    block = coder.compress(ids, 50257)
    assert len(block) < 0.15 * 2 * len(ids)
    for at in (5, 30, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            coder.expand(bytes(broken))


def test_pack_keeps_names():
    names, lengths = [b"1", b"", b"-20"], [2, 1, 3]
    got = tokenfile.unpack(tokenfile.pack(names, lengths, np.arange(6), 50257))
    assert got[0] == names and got[1].tolist() == lengths and got[2].tolist() == list(range(6))


def test_token_file(spark, make_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 200)
    library = Tokenizer.from_file(LIBRARY)
    library.encode_special_tokens = True
    texts = [*odd_texts(120), "long " * 3000, "", None]
    rows = [(7 * k % 1000, t) for k, t in enumerate(texts)]
    path = f"file://{tmp_path}/ids"
    tokenfile.write_tokens(make_docs(rows), path, LIBRARY, 2)
    got, start = {r.doc_id: r for r in tokenfile.read_tokens(spark, path).collect()}, 0
    for i, text in sorted(rows):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, zlib.crc32(bytes(got[i].ids))) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_pieces_are_learned_in_one_text(monkeypatch):
    """Distinct pieces go to the library together, and those that are used stay when the cache is full."""
    monkeypatch.setattr(tokenfile, "CACHE_PIECES", 60)
    library, pieces, calls = Tokenizer.from_file(LIBRARY), tokenfile.Pieces(LIBRARY, False), []
    own = pieces._ids
    monkeypatch.setattr(pieces, "_ids", lambda text: calls.append(text) or own(text))
    texts = [*odd_texts(60), "'ll 's' \n\n\t x \u00a0\u2003y\u0085 z'", *(f"many other words{k} come" for k in range(100)), *odd_texts(60)]
    for text in texts:
        assert np.frombuffer(pieces.encode([text.encode()])[0], np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
    calls.clear()
    pieces.encode([" ".join(f"fresh{k:c}" for k in range(97, 122)).encode()])
    assert len(calls) == 1


def test_blocks_share_their_cases():
    """A step of all lanes costs much less than one by one: 8192 lanes at a time."""
    ids = np.random.default_rng(4).zipf(1.3, 1 << 20) % 50257
    block = coder.compress(ids, 50257)
    assert struct.unpack("<I", block[12:16])[0] == 8192
    assert (coder.expand(block) == ids).all()


def test_token_file_edges(spark, make_docs, tmp_path):
    tokenfile.write_tokens(make_docs([]), f"file://{tmp_path}/none", LIBRARY, 2)
    assert tokenfile.read_tokens(spark, f"file://{tmp_path}/none").count() == 0
    tokenfile.write_tokens(make_docs([(3, "b"), (None, "a"), (3, "c")]), f"file://{tmp_path}/few", LIBRARY, 2)
    got = sorted((str(r.doc_id), r.start, r.n_tokens) for r in tokenfile.read_tokens(spark, f"file://{tmp_path}/few").collect())
    assert got == [("3", 2, 2), ("3", 4, 2), ("None", 0, 2)]


def test_op9_equals_the_library_as_loaded(spark, make_docs, tmp_path):
    texts = ["a <|endoftext|> b", "plain 'll do", "<|endoftext|><|endoftext|>", "<|endoftext", None, "", " <|endoftext|>\n\n x", *odd_texts(100)]
    make_docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    library, start = Tokenizer.from_file(LIBRARY), 0
    got = {r.doc_id: r for r in QUERIES["op9_token_file"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert any(50256 in library.encode(t or "", add_special_tokens=False).ids for t in texts)
