"""Fill-in-middle, conversation repair and sharding: brute force on small tables, edge cases, the driver's tables."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.llm import fim, repair, sharding
from annolake.llm.common import text_of
from annolake.llm.queries import op12_conversation_repair, op13_sharding

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


# Fill-in-middle


@pytest.mark.parametrize("n", [0, 1, 16, 17, 300, 20_000])
def test_skip_list_finds_every_rank(n):
    draw = np.random.default_rng(n)
    points, octets = draw.integers(1, 4, n), draw.integers(1, 5, n).astype(np.uint8)
    ranks = np.concatenate((np.arange(n + 1), draw.integers(0, n + 1, 50)))
    got = fim.SkipList(points, octets).find(ranks)
    for found, width in zip(got, (points, octets), strict=True):
        assert (found == np.concatenate(([0], np.cumsum(width.astype(int))))[ranks]).all()


def _fim_by_hand(doc_id, text, units=list):
    own = units(text or "")
    n, h = len(own), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(own[:a]), "".join(own[a:b]), "".join(own[b:])
    if not own or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text or ""
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, out[0], len(p), len(m), out[1]


def _texts():
    draw = random.Random(3)
    odd = [None, "", "a", "é", "<P", "P>", "a<S>b", "<M>", "<<P", "x<" * 9, "日本語 text\n", "🙂" * 40, "word " * 60_000]
    return odd + ["".join(draw.choice("aé日🙂 <S>M\n") for _ in range(draw.randint(0, 60))) for _ in range(150)]


def test_fim_by_hand(make_docs):
    rows = [(k, t) for k, t in enumerate(_texts())] + [(3, "another text"), (3, "another text"), (None, "no id here")]
    made = fim.fill_in_middle(make_docs(rows)).withColumn("back", fim.restored()).collect()
    got = sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made], key=str)
    assert got == sorted([(k, *_fim_by_hand(k, t), t or "") for k, t in rows], key=str)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(make_docs([])).count() == 0


def test_fim_by_words(make_docs):
    units = lambda t: [u for u in re.split(r"(\S+\s*)", t) if u]
    rows = [(k, t) for k, t in enumerate(_texts())]
    made = fim.fill_in_middle(make_docs(rows), unit=r"\S+\s*").withColumn("back", fim.restored()).collect()
    assert {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made} == {(k, *_fim_by_hand(k, t, units), t or "") for k, t in rows}


# Conversation repair


def _grammar(roles):
    return re.fullmatch("(s?(ua)+)?", "".join(roles)) is not None


def _cheapest(symbols):
    """Least (cost, audit) of one conversation, by trying edits in all ways (at most one insertion before each row, two behind)."""
    best = {("", ""): 0}
    for symbol in symbols:
        after = {}
        for (audit, out), cost in best.items():
            for extra in ("", "u", "a", "ua", "au"):
                start, paid = out + extra, cost + 5 * len(extra)
                ways = [("D", start, 2)]
                if symbol != "x":
                    more = 5 * symbol.isupper()
                    ways += [("K", start + symbol.lower(), more), ("R", start + "u", 1 + more), ("R", start + "a", 1 + more)]
                for name, text, price in ways:
                    if re.fullmatch("s?(ua)*u?", text):
                        key = (audit + "I" * len(extra) + name, text)
                        after[key] = min(after.get(key, 1 << 30), paid + price)
        # Outcomes in one state differ only by what they cost and their audit.
        kept = {}
        for (audit, text), cost in after.items():
            state = "0" if not text else text[-1]
            if state not in kept or (cost, audit) < kept[state][:2]:
                kept[state] = (cost, audit, text)
        best = {(audit, text): cost for cost, audit, text in kept.values()}
    ends = []
    for (audit, out), cost in best.items():
        for extra in ("", "u", "a", "ua"):
            if _grammar(out + extra):
                ends.append((cost + 5 * len(extra), audit + "I" * len(extra), out + extra))
    return min(ends)


def _by_runs(symbols):
    runs = [(k, len(list(g))) for k, g in itertools.groupby(symbols)]
    return "".join(k for k, _ in runs), [n for _, n in runs]


def test_run_length_dp_against_all_edits():
    draw = random.Random(5)
    cases = ["", *map("".join, itertools.product("suax", repeat=3)), *("".join(draw.choice("suaoSUAOx") for _ in range(draw.randint(1, 9))) for _ in range(500))]
    cases += ["u" * 40, "a" * 41, "x" * 30, "s" * 17 + "ua" * 9, "U" * 12 + "a" * 13]
    for symbols in cases:
        letters, lengths = _by_runs(symbols)
        ahead = repair.costs_at_runs(letters, lengths, repair.END)[0][repair.EMPTY]
        if not symbols:
            assert ahead == 0
            continue
        edits, roles, state = repair.unrolled(letters, lengths, repair.EMPTY, repair.END, True)
        cost, audit, _ = _cheapest(symbols)
        assert (ahead, "".join(edits)) == (cost, audit), symbols
        left = [r if r != "-" else s.lower() for s, e, g in zip(symbols, edits, roles, strict=True) for n, r in zip(e, g, strict=True) if n != "D"]
        assert _grammar(left) and state in (repair.EMPTY, repair.AFTER_A)


def test_powers_are_repeated_steps():
    for symbol in repair.SYMBOLS:
        costs = repair.END
        for length in range(1, 40):
            up, costs_above = repair._step(symbol, tuple(c - min(costs) for c in costs))
            costs = tuple(c + up + min(costs) for c in costs_above)
            assert repair.across(symbol, length, repair.END) == costs


BLANK = " \t\n\x0b\x0c\r"


def _repair_by_hand(rows):
    """What the contract says of undamaged rows (conv, turn, role, text), one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            last = text.rstrip(BLANK)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "none")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        symbols = ""
        for (_, role, _), fault in zip(own, faults, strict=True):
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial
        cost, audit, left = _cheapest(symbols)
        lines, at, left = [], 0, iter(left)
        for name in audit:
            if name == "I":
                lines.append({"u": "user:", "a": "assistant:"}[next(left)])
                continue
            _, role, text = own[at]
            at += 1
            if name != "D":
                initial = next(left)
                lines.append(f"{role if name == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def _told(spark, rows):
    schema = "conv_id long, turn long, role string, text string, _at string, _conv string, audit string"
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    counts, left = repair.repaired(table)
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(left).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, empty)) for r in counts.collect()}


def _conversations(n, most, seed):
    draw = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "cut", "é cut \n", "", " \t", None, "Four. ", "日本."]
    rows = []
    for conv in [*range(n), None]:
        turn = 0
        for _ in range(draw.randint(1, most)):
            turn += draw.choice([0, 1, 1, 1, 3])
            rows.append((conv, draw.choice([turn, turn, turn, None]), draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), draw.choice(texts) or draw.choice(texts)))
    return rows


def test_repair_by_hand(spark):
    rows = _conversations(60, 9, 8)
    assert _told(spark, rows) == _repair_by_hand(rows)
    assert _told(spark, []) == {}


def test_repair_of_a_conversation_over_many_segments(spark, monkeypatch):
    """A hot conversation lies in several partitions and batches, and comes out as if it were in one."""
    monkeypatch.setattr(repair, "SMALL_PART_ROWS", 40)
    draw = random.Random(2)
    rows = [(7, k, draw.choice(["user", "assistant", "user"]), f"Turn {k}" + draw.choice([".", "!", ""])) for k in range(400)]
    rows += [(7, 50, "user", "Again.")] * 30 + [(8, 1, "system", "Hi.")] + _conversations(20, 5, 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = _told(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _repair_by_hand(rows)


def _damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


@needs_tables
def test_repair_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted, empty = _repair_by_hand(_damage_by_hand(rows)), (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in op12_conversation_repair(spark, SF).collect()}
    assert got == {c: wanted.get(c, empty) for c in {r[0] for r in rows}}


def test_damage_of_nulls(spark):
    rows = [(c, t, r, x) for c in (1, None) for t in (*range(40), None) for r, x in (("user", "A. b!"), (None, None))]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_damage_by_hand(rows), key=str)


# Sharding


def _shards_by_hand(rows, shards):
    spread = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    own = sorted((spread(t or ""), spread("" if k is None else str(k)), k, len((t or "").encode()) + 8) for k, t in rows) if all(k is not None for k, _ in rows) else None
    if own is None:
        own = sorted(((spread(t or ""), spread("" if k is None else str(k)), k, len((t or "").encode()) + 8) for k, t in rows), key=lambda r: r[:2])
    total, before, out, seen = sum(r[3] for r in own), 0, [], {}
    for _, _, k, size in own:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((k, size, shard, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + 1
        before += size
    return sorted(out, key=str)


def _placed(docs, shards):
    return sorted([(r.doc_id, r.size, r.shard, r.slot) for r in sharding.sharded(docs, shards).collect()], key=str)


def test_shards_by_hand(make_docs):
    draw = random.Random(1)
    rows = [(k, "w" * draw.choice([0, 3, 50, 400, 9000])) for k in range(900)] + [(k, None) for k in range(900, 950)]
    rows += [(3, "www"), (3, "www"), (None, "x"), (None, "é" * 100)]
    for shards in (1, 7, 24):
        assert _placed(make_docs(rows), shards) == _shards_by_hand(rows, shards)
    assert sharding.sharded(make_docs([])).count() == 0
    assert _placed(make_docs([(1, None)]), 24) == [(1, 8, 12, 0)]


def test_shards_when_ranges_are_subdivided(make_docs, monkeypatch):
    """Ranges that shards end in are split several times over; a third of the rows is one text, another third one row."""
    for name, value in (("OVERSAMPLED", 2), ("RANGES_PER_SHARD", 1), ("SUBDIVIDED", 6)):
        monkeypatch.setattr(sharding, name, value)
    rows = [(k, f"text {k} " * (k % 9)) for k in range(400)] + [(k, "copy") for k in range(400, 800)] + [(9, "one row")] * 400
    got = _placed(make_docs(rows), 24)
    assert got == _shards_by_hand(rows, 24)
    sizes = [sum(r[1] for r in got if r[2] == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_one_text_that_outweighs_all(make_docs):
    rows = [(0, "x" * 1_000_000)] + [(k, "y" * k) for k in range(1, 60)]
    assert _placed(make_docs(rows), 24) == _shards_by_hand(rows, 24)


def test_written_shards(make_docs, spark, tmp_path):
    docs = make_docs([(k, f"some text {k}") for k in range(100)])
    sharding.write_shards(docs, f"{tmp_path}/shards", 4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r.row.doc_id, r.row.text, r.row.key) for r in back.collect()) == [(k, f"some text {k}", "z") for k in range(100)]
    for own in back.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect():
        assert own.s == list(range(len(own.s)))


@needs_tables
def test_sharding_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op13_sharding(spark, SF).collect()
    assert sorted([(r.doc_id, r["size"], r.shard, r.slot) for r in got], key=str) == _shards_by_hand(rows, 24)
    sums = {k: zlib.crc32((t or "").encode()) for k, t in rows}
    assert all(r.text_crc32 == sums[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in got)


def test_carried_columns(make_docs):
    docs = make_docs([(1, "a"), (2, None)])
    got = sharding.sharded(docs, 2, carry={"sum": F.crc32(text_of("text").cast("binary"))}).collect()
    assert {(r.doc_id, r["sum"]) for r in got} == {(1, zlib.crc32(b"a")), (2, 0)}
