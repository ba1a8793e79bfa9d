import random
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from annolake.functions import text as tx


def brute_normalize(text):
    out = ""
    for c in unicodedata.normalize("NFKC", text).casefold():
        if not c.isspace() and unicodedata.category(c)[0] not in ("P", "S"):
            out += c
    return out


def brute_similarity(a, b):
    if min(len(a), len(b)) < 4:
        return None
    if a == b:
        return 1.0
    return max(SequenceMatcher(None, a, b).ratio(), len(set(a) & set(b)) / len(set(a) | set(b)))


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_normalize(spark):
    texts = ["Hello,  World!", "Straße №5", "ＦＵＬＬ　ｗｉｄｔｈ", "字幕，识别。", "a\x1cb\x0bc", "$1 + 2^3 = `x`~", "", "É tion　…"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.normalize_text(F.col("t")).alias("n"), tx.strip_casefold(F.col("t")).alias("s"))
    for row in df.collect():
        assert row.n == brute_normalize(row.t)
        assert row.s == "".join(row.t.split()).casefold()
    assert spark.range(1).select(tx.normalize_text(F.lit(None).cast("string"))).first()[0] == ""


def sample_pairs():
    random.seed(5)
    base = ["这个放在这里", "这个放在那里", "alpha caption", "bravo message", "abcd", "abcdabcdabcd", "abc", "", "ab" * 120]
    for _ in range(150):
        base.append("".join(random.choice("abcdeé字") for _ in range(random.randint(0, 14))))
    return [(random.choice(base), random.choice(base)) for _ in range(600)] + [(b, b) for b in base[:9]]


def test_similarity_decisions(spark):
    df = spark.createDataFrame(sample_pairs(), "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        "a", "b", tx.text_similarity(a, b).alias("sim"), tx.similarity_at_most(a, b, 0.5).alias("most"), tx.is_same_text(a, b).alias("same"),
        tx.capped_edit_distance(a, b, 4).alias("dist"), tx.is_near_duplicate(a, b).alias("near"), tx.is_near_duplicate(a, b, 0.6, 4).alias("near2"),
    ).collect()
    assert any(r.most for r in rows) and any(r.near for r in rows)
    for r in rows:
        want = brute_similarity(r.a, r.b)
        assert (r.sim is None) == (want is None) and (want is None or abs(r.sim - want) < 1e-12)
        assert r.most == (want is not None and want <= 0.5)
        assert r.same == (bool(r.a) and bool(r.b) and (r.a == r.b or (want is not None and want >= 0.9)))
        distance, ratio = brute_distance(r.a, r.b), SequenceMatcher(None, r.a, r.b).ratio()
        assert r.dist == min(distance, 4)
        shorter = min(len(r.a), len(r.b))
        strict = distance <= 1 and ratio >= 0.8 if shorter < 6 else ratio >= 0.86 and distance <= 3
        assert r.near == (shorter > 0 and strict)
        assert r.near2 == (shorter > 0 and ratio >= 0.6 and distance <= 4)
