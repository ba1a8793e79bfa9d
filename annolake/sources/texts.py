"""Subtitle cues and nested model output."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.session import checkpointed
from annolake.sources.lines import strip


def cue_texts(text: Column, is_srt: Column) -> Column:
    """Cue texts of a subtitle file, or its non-blank lines when it is plain text."""
    plain_lines = lambda t: F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda s: strip(s)), lambda s: s != "")
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    blocks = F.split(unix, r"\n\s*\n")
    kept = lambda block: F.filter(plain_lines(block), lambda s: ~s.rlike(r"^\d+$") & ~s.contains("-->"))
    cues = F.filter(F.transform(blocks, lambda b: F.array_join(kept(b), "\n")), lambda c: c != "")
    return F.when(is_srt | text.contains("-->"), cues).otherwise(plain_lines(text))


def read_subtitles(files: DataFrame) -> DataFrame:
    """Files (path, text) to rows (path, cue, subtitle). A leading byte-order mark is dropped."""
    clean = F.regexp_replace("text", "^﻿", "")
    rows = files.select("path", F.posexplode(cue_texts(clean, F.lower("path").endswith(".srt"))).alias("cue", "subtitle"))
    return rows


_QUAD = "array<array<double>>"


def normalize_detections(results: DataFrame, key: list[str]) -> DataFrame:
    """Nested detector output (column ``result``, JSON) to rows (polygon, score).

    Known forms: parallel ``dt_polys``/``dt_scores``, one object with points/poly/bbox and score, a bare polygon, a
    (polygon, score) pair, and lists of any of these. Each pass opens one level of lists and the forms are told apart
    by what the text parses to.
    """
    shape = f"struct<dt_polys:array<{_QUAD}>,dt_scores:array<double>,points:{_QUAD},poly:{_QUAD},bbox:{_QUAD},score:double>"
    entry = f"struct<result:string,polygon:{_QUAD},score:double>"

    def found(polygon: Column, score: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("result"), polygon.alias("polygon"), score.alias("score"))

    def unopened(text: Column) -> Column:
        return F.struct(text.alias("result"), F.lit(None).cast(_QUAD).alias("polygon"), F.lit(None).cast("double").alias("score"))

    def open_level(df: DataFrame) -> DataFrame:
        is_object = strip("result").startswith("{")
        parsed = df.withColumn("_o", F.when(is_object, F.from_json("result", shape))).withColumn(
            "_q", F.when(~is_object, F.from_json("result", _QUAD))
        ).withColumn("_i", F.when(~is_object, F.from_json("result", "array<string>")))
        o, q, items = F.col("_o"), F.col("_q"), F.col("_i")
        quad = F.coalesce((F.size(q) == 4) & F.forall(q, lambda p: F.coalesce(F.size(p) == 2, F.lit(False))), F.lit(False))
        first, number = F.from_json(F.get(items, F.lit(0)), _QUAD), F.get(items, F.lit(1)).try_cast("double")
        pair = F.coalesce((F.size(items) >= 2) & (F.size(first) == 4) & number.isNotNull(), F.lit(False))
        entries = (
            F.when(F.col("result").isNull(), F.array(found(F.col("polygon"), F.col("score"))).cast(f"array<{entry}>"))
            .when(o["dt_polys"].isNotNull(), F.transform(o["dt_polys"], lambda p, i: found(p, F.get(o["dt_scores"], i))).cast(f"array<{entry}>"))
            .when(o.isNotNull(), F.array(found(F.coalesce(o["points"], o["poly"], o["bbox"]), o["score"])).cast(f"array<{entry}>"))
            .when(quad, F.array(found(q, F.lit(None).cast("double"))).cast(f"array<{entry}>"))
            .when(pair, F.array(found(first, number)).cast(f"array<{entry}>"))
            .otherwise(F.transform(items, unopened).cast(f"array<{entry}>"))
        )
        opened = parsed.select(*key, "at", F.posexplode(entries).alias("n", "e"))
        # Nothing without text or polygon goes on.
        alive = opened.filter(F.col("e.result").isNotNull() | F.col("e.polygon").isNotNull())
        return alive.select(*key, F.concat("at", F.array("n")).alias("at"), "e.*")

    level = results.select(
        *key, F.array().cast("array<int>").alias("at"), "result", F.lit(None).cast(_QUAD).alias("polygon"), F.lit(None).cast("double").alias("score")
    )
    for _ in range(4):  # the usual nesting: batch, page, list, pair
        level = open_level(level)
    level = checkpointed(level)
    while not level.filter("result is not null").isEmpty():
        level = checkpointed(open_level(level))
    return level.filter("polygon is not null").select(*key, F.col("at").alias("position"), "polygon", "score")


#: Keys that name the recognised text of an object, in this order.
TEXT_KEYS = ("rec_text", "text", "label")


def text_within(value: object) -> str:
    """Text of one parsed result. Only strings count, whatever they look like; a walk with its own stack, to any depth.

    A frame of the stack is [kind, parts, what is left]: a list joins the texts of its items, an object takes the first
    text that its values give.
    """
    done: str | None = None
    stack: list[list] = []
    while True:
        if done is None:
            if isinstance(value, str):
                done = value
            elif isinstance(value, dict):
                several = value.get("rec_texts")
                named = next((value[k] for k in TEXT_KEYS if isinstance(value.get(k), str)), None)
                if isinstance(several, list):
                    done = "".join(map(str, several))
                elif named is not None:
                    done = named
                else:
                    stack.append(["first", [], iter(value.values())])
            elif isinstance(value, list):
                stack.append(["all", [], iter(value)])
            else:
                done = ""
        if done is not None:
            if not stack:
                return done
            kind, parts, _ = stack[-1]
            if done:
                parts.append(done)
            if kind == "first" and done:
                stack.pop()
                continue
            done = None
        kind, parts, rest = stack[-1]
        missing = object()
        value = next(rest, missing)
        if value is missing:
            stack.pop()
            done = "".join(parts)


def extract_text(result: Column) -> Column:
    """Recognised text of nested recogniser output (JSON): ``rec_texts`` joined, else the first of rec_text, text and label
    that is a string; lists are joined; other objects give their first value with text. Text that is no JSON gives ''."""

    @F.pandas_udf("string")
    def walk(documents: pd.Series) -> pd.Series:
        def one(document: str | None) -> str:
            try:
                return "" if document is None else text_within(json.loads(document))
            except ValueError:
                return ""

        return documents.map(one, na_action=None)

    return walk(result)
