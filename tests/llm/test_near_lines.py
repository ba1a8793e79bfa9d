"""Near-duplicates, components, set joins and line dedup against brute force."""

import random
import re

from annolake.llm import minhash
from annolake.llm.components import connected_components
from annolake.llm.linededup import repeated_lines, without_repeats
from annolake.llm.minhash import near_duplicates

GAP = re.compile(r"[\x20\x09-\x0d]+")


def words_of(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in GAP.split(folded) if w]


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def alike(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def brute_components(rows, n):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if alike(a, b):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return {i: (len(s), top(i)) for i, s in sets}


def family(draw, n_base, n_each):
    """Texts of some bases with up to a few edits, so that similarities lie on both sides of the limit."""
    rows = []
    for _ in range(n_base):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([3, 8, 60, 120]))]
        for _ in range(n_each):
            own = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 20))):
                own[draw.randrange(len(own))] = f"e{draw.randint(0, 999)}"
            rows.append(" ".join(own))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_brute_force(make_docs):
    rows = family(random.Random(1), 6, 20)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three"), (5, rows[5][1])]
    want = brute_components(dict(rows).items(), 4)
    for r in near_duplicates(make_docs(rows), words=4).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_without_hubs(make_docs, monkeypatch):
    """The exact join alone gives the same."""
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 0)
    rows = family(random.Random(2), 4, 15)
    want = brute_components(rows, 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == want


def test_near_duplicates_edges(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, long), (2, long + " tail"), (3, None), (None, long)]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), None: (1, False)}


def test_rows_of_one_id_are_one_node(make_docs):
    """Two texts of an id carry the links of both; near texts without an id are linked too."""
    a, b = ([f"{t}{k}" for k in range(60)] for t in "ab")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (9, near(a)), (None, near(b)), (4, "c d e f g h"), (None, "x y z x y z"), (5, "")]
    got = sorted(((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(make_docs(rows)).collect()))
    assert got == sorted([("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "1", False), ("9", "1", False), ("None", "1", False), ("4", "4", True), ("None", "None", True), ("5", "5", True)])


def test_components_paths_stars_and_repeats(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(7, 201), (201, 7), (3, 3)]
    found = connected_components(spark.createDataFrame(links, "u long, v long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, **{k: 7 for k in range(200, 260)}}


def brute_lines(rows):
    seen, kept = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((text or "").split("\n")):
            own = set(words_of(line))
            if own:
                kept[i, k] = not any(alike(own, s) for s in seen)
                seen.append(own)
    return kept


def test_repeated_lines_brute_force(make_docs):
    draw = random.Random(3)
    lines = [t for _, t in family(draw, 8, 14)] + ["the the the", "a b c d", "a b c d e", "A  B c\td", ""]
    rows = [(k, "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 6)))) for k in range(40)]
    want = brute_lines(rows)
    got = {(r.doc_id, r.line): r.kept for r in repeated_lines(make_docs(rows)).collect()}
    assert got == want


def test_without_repeats(make_docs):
    rows = [(1, "same line here\n\nother words stand"), (2, "new one\nSAME line here"), (3, None), (4, ""), (5, "same line here")]
    docs = make_docs(rows)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in without_repeats(docs).collect()}
    assert got == {
        1: ("same line here\n\nother words stand", 2, 0), 2: ("new one", 2, 1), 3: (None, 0, 0), 4: ("", 0, 0), 5: ("", 1, 1),
    }
    assert set(docs.columns) < set(without_repeats(docs).columns)
    assert without_repeats(make_docs([])).count() == 0


def test_lines_of_repeated_and_null_ids(make_docs):
    rows = [(1, "aa bb cc dd"), (1, "ee ff gg hh"), (None, "aa bb cc dd"), (2, "ee ff gg hh")]
    got = sorted((str(r.doc_id), r.line, r.kept) for r in repeated_lines(make_docs(rows)).collect())
    assert got == [("1", 0, False), ("1", 0, True), ("2", 0, False), ("None", 0, True)]


def test_beyond_broadcast(make_docs, monkeypatch):
    """The salted joins that take over where nothing is small give the same."""
    monkeypatch.setattr("annolake.llm.common.BROADCAST_ROWS", 0)
    rows = family(random.Random(14), 3, 8)
    got = {(r.doc_id, r.line): r.kept for r in repeated_lines(make_docs(rows)).collect()}
    assert got == brute_lines(rows)
    want = brute_components(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows), words=4).collect()} == want


def test_decisions_reach_only_their_text(make_docs):
    """Texts that share an id, or have none, do not decide for each other."""
    rows = [
        (None, "aa bb cc dd\nsecond line of one"), (None, "ee ff gg hh\naa bb cc dd"),
        (7, "ee ff gg hh\nown words stand here"), (7, "new words come first\nstays as well too"),
    ]
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in without_repeats(make_docs(rows)).collect())
    assert got == sorted([
        ("None", rows[0][1], 2, 0), ("None", "ee ff gg hh", 2, 1), ("7", "own words stand here", 2, 1), ("7", rows[3][1], 2, 0),
    ])


def test_equal_lines_of_texts_without_id(make_docs):
    """One of the equal lines at the same number stays."""
    rows = [(None, "aa bb cc dd\none text of two"), (None, "aa bb cc dd\nother words than those")]
    got = sorted((r.line, r.kept) for r in repeated_lines(make_docs(rows)).collect())
    assert got == [(0, False), (0, True), (1, True), (1, True)]


def _long_and_common_lines(draw):
    """Lines of few frequent words, of very many words around the length where keys change, and near copies of one line."""
    few = [" ".join(draw.choice("abcdefghijklmnop") * 2 for _ in range(draw.randint(4, 24))) for _ in range(60)]
    base = [f"w{draw.randint(0, 3000)}" for _ in range(40)]
    long = []
    for n in (28, 32, 36, 40):
        own = base[:n]
        long += [" ".join(own), " ".join(own[1:]), " ".join([*own[:-2], "x1", "x2"]), " ".join([*own[5:], "y"])]
    return few + long + [f"one line that all have with a small change {k}" for k in range(40)]


def test_keys_of_rare_and_frequent_tokens(make_docs, monkeypatch):
    """Every kind of key, in several shares, gives what all pairs give."""
    from annolake.llm import linededup

    lines = _long_and_common_lines(random.Random(8))
    rows = [(k, "\n".join(lines[k * 4 : k * 4 + 4])) for k in range(len(lines) // 4 + 1)]
    want = brute_lines(rows)
    for rare, long, share_rows in ((2, 32, 300), (0, 1000, 10**6), (10**6, 1000, 10**6)):
        monkeypatch.setattr(linededup, "RARE", rare)
        monkeypatch.setattr(linededup, "LONG", long)
        monkeypatch.setattr(linededup, "SHARE_ROWS", share_rows)
        got = {(r.doc_id, r.line): r.kept for r in repeated_lines(make_docs(rows)).collect()}
        assert got == want


def test_lines_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd\nnew one", "p", 1, [2]), (2, "aa bb cc dd", "q", 3, [4])], "doc_id long, text string, _doc string, _row int, _lost array<int>")
    got = sorted(tuple(r) for r in without_repeats(docs).collect())
    assert got == [(1, "aa bb cc dd\nnew one", "p", 1, [2], 2, 0), (2, "", "q", 3, [4], 1, 1)]


def test_many_alike_make_few_candidates(make_docs):
    """Twice the near copies of a line make twice the candidates: each is compared with the first one, and all match there."""
    from annolake.llm import linededup

    def candidates(n):
        words = [f"w{k}" for k in range(20)]
        rows = [(k, " ".join([*words[:19], f"x{k}"])) for k in range(n)] + [(1000, "other words stand here")]
        docs = make_docs(rows).selectExpr("doc_id as _doc", "xxhash64(text) as _row", "text as _text")
        classes = linededup._classes(docs, linededup._token_counts(docs), 80)
        return linededup._with_first(linededup._keys(classes, 0, 1), 80).count(), {(r.doc_id, r.line): r.kept for r in repeated_lines(make_docs(rows)).collect()}

    (few, _), (many, got) = candidates(40), candidates(80)
    assert 39 <= few and 79 <= many <= 2.2 * few
    assert [k for k, kept in sorted(got.items()) if kept] == [(0, 0), (1000, 0)]
