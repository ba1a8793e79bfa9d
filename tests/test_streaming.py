import json
import random
from datetime import datetime, timedelta

import pyspark.sql.functions as F

import __spark_entry__ as contract
from annolake.streaming.bank import COLUMNS, bank_step, run_bank, same_text
from annolake.streaming.ingest import annotation_stream, append_to, ingest_annotations
from annolake.streaming.segments import EVENTS, last_segment_events, run_segment_events


def test_ingest_resumes_without_copies(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    row = lambda f: json.dumps({"source_video": "v", "frame_index": f, "ingested": f"2024-01-01T00:00:{f:02d}"}) + "\n"
    run = lambda: append_to(ingest_annotations(annotation_stream(spark, str(source)), start=2), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    (source / "one.jsonl").write_text(row(1) + row(2) + row(3) + row(3))
    run()
    (source / "two.jsonl").write_text(row(3) + row(4))
    run()
    assert sorted(r.frame_index for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3, 4]


def rows(spark, data):
    return spark.createDataFrame(data, COLUMNS + ", adjacent array<string>")


def test_bank_pairs(spark):
    none = spark.createDataFrame([], COLUMNS)
    first = rows(spark, [("r", "v", "a", "alpha caption", 0, [1.0, 0.0], ["b"]), ("r", "v", "b", "bravo message", 1, [0.0, 1.0], ["a"]), ("r", "w", "c", "zzzz", 2, [0.6, 0.8], [])])
    step = bank_step(first, none, none)
    assert step["pairs"].count() == 0 and step["bank"].count() == 3 and step["latest"].count() == 3
    second = rows(spark, [("r", "v", "a", "alpha caption", 3, [1.0, 0.0], ["b"])])
    got = sorted((r.old_order_idx, r.same, r.source, round(r.similarity, 6)) for r in bank_step(second, step["bank"], step["latest"])["pairs"].collect())
    assert got == [(0, True, "local", 1.0), (1, False, "local", 0.0), (2, False, "ocr", 0.6)]
    alone = rows(spark, [("r", "v", "a", "bravo message", 4, [1.0, 0.0], ["b"])])
    got = {r.old_order_idx for r in bank_step(alone, step["bank"], step["latest"], ratio=0.0)["pairs"].collect()}
    assert got == {0}, "the same text is no negative and a zero ratio leaves no text negatives"


def test_bank_evicts(spark):
    none = spark.createDataFrame([], COLUMNS)
    many = rows(spark, [("r", "v", f"g{i}", "t", i, [1.0], []) for i in range(3000)])
    step = bank_step(many, none, none, capacity=100)
    assert sorted(r.order_idx for r in step["bank"].collect()) == list(range(2900, 3000)) and step["latest"].count() == 3000


def test_bank_stream_equals_steps(spark, tmp_path):
    """A real stream of several micro-batches gives what the batch form gives step by step; the bank evicts on the way."""
    draw = random.Random(4)
    texts = ["alpha caption", "bravo message", "zzzz qqqq", "mnop rstu", "xyz", "这个放在这里", ""]
    batches, number = [], 0
    for _ in range(4):
        batch = []
        for _ in range(25):
            segment = draw.choice("abcdef")
            near = [s for s in "abcdef" if abs(ord(s) - ord(segment)) == 1]
            batch.append((draw.choice(["r", "q"]), draw.choice(["v", "w", None]), segment, draw.choice(texts), number, [draw.random(), draw.random()], near))
            number += 1
        batches.append(batch)
    source = tmp_path / "in"
    for k, batch in enumerate(batches):
        rows(spark, batch).coalesce(1).write.parquet(str(source / f"part{k}"))
    settings = {"maximum": 0.5, "ratio": 0.6, "capacity": 30}
    stream = spark.readStream.schema(COLUMNS + ", adjacent array<string>").option("maxFilesPerTrigger", 1).parquet(str(source) + "/*")
    run_bank(stream, str(tmp_path / "bank"), str(tmp_path / "ckpt"), salts=3, **settings).awaitTermination()
    tell = lambda df: sorted((r.root, r.order_idx, r.old_order_idx, r.same, r.source, round(r.similarity, 9)) for r in df.collect())
    got = tell(spark.read.parquet(str(tmp_path / "bank" / "pairs")))
    bank = latest = spark.createDataFrame([], COLUMNS)
    want = []
    for batch in batches:
        step = bank_step(rows(spark, batch), bank, latest, **settings)
        want += tell(step["pairs"])
        bank, latest = (spark.createDataFrame(step[name].collect(), COLUMNS) for name in ("bank", "latest"))
    assert got == sorted(want) and any(r[4] == "ocr" for r in got) and any(r[3] for r in got)


def test_bank_query_meets_neighbour_segments(spark, tmp_path):
    """Frames of one video come in several micro-batches, so its own and its neighbour segments are in the state when they are asked for."""
    draw, frame = random.Random(9), lambda video, number: video * 1_048_576 + number
    words = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))
    length = {0: 8, 1: 8, 2: 11, 3: 1, 4: 8, 5: 3, -4: 6}
    talk = [(video, turn, "user", words()) for video, n in length.items() for turn in range(n)] + [(8, 0, "system", words()), (8, 1, "user", words())]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    vectors = [(k, [draw.random() for _ in range(3)]) for k in range(5)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = contract.queries()["rolling_negative_bank"](spark, str(tmp_path)).collect()
    pairs = lambda same, source: {(r.order_idx, r.old_order_idx) for r in found if (r.same, r.source) == (same, source)}
    # Two frames are a segment; a frame meets those whose number has a smaller rest by eight.
    met = [(v, k, j) for v, n in length.items() for k in range(n) for j in range(n) if j % 8 < k % 8]
    assert pairs(True, "local") == {(frame(v, k), frame(v, j)) for v, k, j in met if k // 2 == j // 2}
    assert pairs(False, "local") == {(frame(v, k), frame(v, j)) for v, k, j in met if abs(k // 2 - j // 2) == 1}
    assert (frame(2, 7), frame(2, 8)) in pairs(False, "local") and (frame(-4, 1), frame(-4, 0)) in pairs(True, "local")
    far = [(new >> 20, new % (1 << 20), old >> 20, old % (1 << 20)) for new, old in pairs(False, "ocr")]
    assert far and all(j % 8 < k % 8 and v % 4 == w % 4 and (v != w or abs(k // 2 - j // 2) > 1) for v, k, w, j in far)


def test_same_text_of_strings():
    assert same_text("alpha", "alpha") and not same_text("", "") and not same_text("ab", "abc") and same_text("abcdefghij", "abcdefghijj")
    assert not same_text("alpha caption", "bravo message")


FRAMES = "root string, video_id string, frame_index long, segment_id string, has_subtitle boolean, ts timestamp"


def replayed(batches, delay):
    """Changes, late frames and frames left waiting, taken batch by batch with the watermark that each batch leaves."""
    last, held, changes, late, newest = {}, [], set(), set(), None
    for batch in batches:
        floor = None if newest is None else newest - delay
        new = [r for r in batch if r[4] and r[1] is not None and r[2] is not None and r[5] is not None]
        # The engine drops rows behind the watermark before they reach the state.
        held += [r for r in new if floor is None or r[5] > floor]
        newest = max([r[5] for r in new] + ([newest] if newest else []))
        for r in sorted((r for r in held if r[5] <= newest - delay), key=lambda r: (r[2], r[3] is not None, r[3] or "", r[5])):
            take(r, last, changes, late)
        held = [r for r in held if r[5] > newest - delay]
    return last, held, changes, late


def take(row, last, changes, late):
    frame, segment = last.get(row[:2], (None, None))
    if frame is not None and row[2] < frame:
        late.add((*row[:3], row[3]))
        return
    if segment is not None and row[3] is not None and segment != row[3]:
        changes.add((*row[:3], segment, row[3]))
    last[row[:2]] = (row[2], row[3])


def test_segment_events_and_the_end(spark, tmp_path):
    """Several micro-batches with frames that come too late, and the frames that wait when the stream ends."""
    draw, start, batches = random.Random(11), datetime(2024, 1, 1), []
    for k in range(4):
        batch = []
        for j in range(60):
            frame = k * 60 + j
            video = draw.choice(["v", "w", "x", None])
            number = None if draw.random() < 0.03 else max(0, frame - draw.choice([0, 0, 0, 90]))
            batch.append((draw.choice(["r", None]), video, number, draw.choice(["a", "b", "c", None]), draw.random() < 0.9, start + timedelta(seconds=10 * frame)))
        batches.append(batch)
    batches.append([("r", "y", 1, "a", True, None), ("r", "y", 2, "a", True, start + timedelta(seconds=2405)), ("r", "y", 3, "b", True, start + timedelta(seconds=2406))])
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, FRAMES).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in") + "/*")
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run_segment_events(stream, folder, checkpoint, delay="5 minutes").awaitTermination()
    last, held, changes, late = replayed(batches, timedelta(minutes=5))
    tell = lambda df, kind: {tuple(r) for r in df.filter(F.col("kind") == kind).select("root", "video_id", "frame_index", *["prev_segment"] * (kind == "change"), "segment_id").collect()}
    seen = spark.read.schema(EVENTS).parquet(f"{folder}/events")
    assert changes and late and held
    assert tell(seen, "change") == changes and tell(seen, "late") == late
    end, end_late = set(), set()
    for row in sorted(held, key=lambda r: (r[2], r[3] is not None, r[3] or "", r[5])):
        take(row, last, end, end_late)
    tail = last_segment_events(spark, checkpoint)
    assert end and tell(tail, "change") == end and tell(tail, "late") == end_late
