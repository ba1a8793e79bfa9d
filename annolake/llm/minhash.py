"""Near-duplicates: MinHash signatures, banding, signature and set verification, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import discard, materialized, may_hold, row_key, salted_join, text_of
from annolake.llm.components import connected_components
from annolake.llm.setjoin import can_match, prefixes, rarity, similar
from annolake.llm.words import mix64, shingle_sets, slices

#: 64 bands of 6 minima: a pair at similarity 0.8 shares no band with probability 4e-9.
BANDS, BAND_ROWS = 64, 6
#: A pair goes on to its sets if so large a share of the minima agree; 0.8 lies six standard deviations above.
AGREEMENT = 0.68
#: What a null id counts as where a row is looked up by its id and text.
NULL_ID = -(1 << 63)
#: Rounds in which each bucket is compared with one member only; what is then still apart goes through an exact join.
HUB_ROUNDS = 2


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """Least values of ``count`` universal hash functions ``a * x + b`` (mod 2^32) over a set."""
    draw = np.random.default_rng(7)
    a = draw.integers(0, 1 << 32, (count, 1), dtype=np.uint32) | np.uint32(1)
    b = draw.integers(0, 1 << 32, (count, 1), dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        value = a * x[at : at + 1024]
        value += b
        np.minimum(least, value.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, words: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``_id, _row`` (``row_key``), ``n_shingles, _key`` (a 128-bit hash of the set), ``_signature`` (a byte per minimum), ``_bands``."""
    factors = mix64(np.arange(1, BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    kind = pa.schema([("_id", pa.int64()), ("_row", pa.int64()), ("n_shingles", pa.int64()), ("_key", pa.binary()), ("_signature", pa.binary()), ("_bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                sizes, keys, marks, bands = [], [], [], []
                for own in shingle_sets(texts, words):
                    sizes.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    least = minima(own, BANDS * BAND_ROWS)
                    marks.append((least & np.uint32(255)).astype(np.uint8).tobytes())
                    joined = (least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * factors).sum(axis=1)
                    bands.append(mix64(joined * np.uint64(BANDS + 1) + band).view(np.int64) if len(own) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_row"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    schema=kind,
                )

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), row_key(text_column).alias("_row"), text_of(text_column).alias("_text"))
    return rows.mapInArrow(run, "_id long, _row long, n_shingles long, _key binary, _signature binary, _bands array<long>")


def _sets(source: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``_id`` (the class), ``_set``: the shingle hashes of the texts that stand for the classes of ``nodes``. Texts are not moved."""
    home = ["_name", "_row"]
    kind = pa.schema([("_name", pa.int64()), ("_row", pa.int64()), ("_set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                own = [s.tobytes() for s in shingle_sets(texts, words)]
                yield pa.RecordBatch.from_arrays([part.column("_name"), part.column("_row"), pa.array(own, pa.binary())], schema=kind)

    named = source.select(F.coalesce("_id", F.lit(NULL_ID)).alias("_name"), row_key("_text").alias("_row"), "_text")
    made = named.where(may_hold(nodes, home)).mapInArrow(run, "_name long, _row long, _set binary")
    return made.join(nodes, home).select(F.col("_class").alias("_id"), "_set").dropDuplicates(["_id"])


def _filtered(pairs: DataFrame, left: str, right: str, similar) -> DataFrame:
    """Rows ``a, b`` of ``pairs`` whose two byte columns are ``similar``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = batch.column(left).to_pylist(), batch.column(right).to_pylist()
            keep = pa.array([similar(x, y) for x, y in zip(mine, other, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.select("a", "b", left, right).mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar: first by signature, then by their full sets."""
    least = AGREEMENT * BANDS * BAND_ROWS

    def by_signature(x: bytes, y: bytes) -> bool:
        return int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= least

    def beside(df: DataFrame, table: DataFrame, value: str, node: str) -> DataFrame:
        return df.join(table.select(F.col("_id").alias(node), F.col(value).alias(f"{value}_{node}")), node)

    likely = _filtered(beside(beside(pairs, marks, "_signature", "b"), marks, "_signature", "a"), "_signature_a", "_signature_b", by_signature)
    return _filtered(beside(beside(likely, sets, "_set", "b"), sets, "_set", "a"), "_set_a", "_set_b", lambda x, y: similar(x, y, percent))


def _pairs_apart(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes in different parts whose sets may be similar, from the prefixes of the sets."""
    own = materialized(sets.withColumnRenamed("_id", "_class").join(open_, "_class"), "open")
    rows = materialized(prefixes(own, rarity(own), percent, ["_class", "_part"]), "prefixes")
    x, y = rows.alias("x"), rows.alias("y")
    near = can_match(F.col("x._size"), F.col("x._at"), F.col("y._size"), F.col("y._at"), percent)
    apart = (F.col("x._part") != F.col("y._part")) & (F.col("x._class") < F.col("y._class"))
    joined = x.join(y, (F.col("x._token") == F.col("y._token")) & apart & near)
    return joined.select(F.col("x._class").alias("a"), F.col("y._class").alias("b")).distinct()


def _same_id(marks: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` between the classes of one id, each with the first of them."""
    own = marks.where("n_shingles > 0 and _id is not null").select("_id", "_key").distinct()
    several = own.groupBy("_id").count().where("count > 1").select("_id")
    of = own.join(several, "_id").join(classes.select("_key", "_class"), "_key").select("_id", "_class")
    first = of.groupBy("_id").agg(F.min("_class").alias("a"))
    return of.join(first, "_id").where("a < _class").select("a", F.col("_class").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", rows_told: bool = False) -> DataFrame:
    """Per row: id, ``_row`` (``row_key``, if ``rows_told``), ``n_shingles``, ``component_id`` and ``kept`` (the id is its component's smallest).

    A text's set holds its distinct runs of ``words`` lower-cased words; two texts are linked if their intersection is at least
    ``percent`` hundredths of their union, and components are what links reach. Equal sets are one class from the start.
    Classes that share a band bucket are candidates. Each round compares a bucket with one member, its hub (the one that
    meets most others in all buckets); what a hub joins needs no more comparing among itself, the hub leaves the bucket,
    and buckets within one component are done. Classes that are then still apart from others of a bucket go through an exact
    prefix join of their sets, so no link between components is lost and no bucket is ever unfolded into its pairs. Every
    link is confirmed on full sets.

    Null, empty and blank texts have no shingles and are linked with nothing. Equal texts are always linked. Rows that repeat an id are one
    node: what one of its texts is linked with, all are. Rows with a null id are nodes of their own; a component without any id has a null
    ``component_id``. Other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_column).cast("long").alias("_id"), text_of(text_column).alias("_text"))
    marks = materialized(signatures(source, words, "_id", "_text"), "signatures")
    home = F.min(F.struct(F.coalesce("_id", F.lit(NULL_ID)).alias("_name"), "_row")).alias("_home")
    classes = marks.where("n_shingles > 0").groupBy("_key").agg(home, F.min("_id").alias("_low"), F.first("_signature").alias("_signature"), F.first("_bands").alias("_bands"))
    classes = materialized(classes.select("*", F.monotonically_increasing_id().alias("_class")), "classes")
    rows = classes.select(F.explode("_bands").alias("_bucket"), "_class")
    shared = rows.groupBy("_bucket").agg(F.min("_class").alias("_low"), F.max("_class").alias("_high")).where("_low < _high")
    placed = materialized(rows.join(shared.select("_bucket"), "_bucket", "left_semi").distinct(), "placed")
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    degrees = placed.join(sizes, "_bucket").groupBy("_class").agg(F.sum("_n").alias("_degree"))
    members = materialized(placed.join(degrees, "_class"), "members")
    nodes = materialized(classes.join(placed.select("_class").distinct(), "_class", "left_semi").select("_home.*", "_class"), "nodes")
    sets = materialized(_sets(source, nodes, words), "sets")
    scratch = [placed, members, nodes, sets]
    marks_of = classes.select(F.col("_class").alias("_id"), "_signature")

    links, component, tested = materialized(_same_id(marks, classes), "links"), None, None
    scratch.append(links)
    for turn in range(HUB_ROUNDS + 1):
        placed = members.withColumn("_part", F.col("_class"))
        if component is not None:
            placed = members.join(component.withColumnRenamed("node", "_class"), "_class", "left")
            placed = placed.select("_bucket", "_class", "_degree", F.coalesce("component", "_class").alias("_part"))
        hub = F.max(F.struct("_degree", F.negative("_class").alias("_other"), "_part")).alias("_hub")
        apart = placed.groupBy("_bucket").agg(hub, F.min("_part").alias("_low"), F.max("_part").alias("_high")).where("_low < _high")
        apart = apart.select("_bucket", F.negative("_hub._other").alias("_other"), F.col("_hub._part").alias("_there"))
        joined = materialized(placed.join(apart, "_bucket").where("_class <> _other"), "apart")
        scratch.append(joined)
        if turn < HUB_ROUNDS:
            pairs = joined.where("_part <> _there").select(F.least("_class", "_other").alias("a"), F.greatest("_class", "_other").alias("b")).distinct()
        else:
            open_ = joined.select("_class", "_part").union(joined.select("_other", "_there")).distinct()
            pairs = _pairs_apart(open_, sets, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialized(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = materialized(_confirmed(pairs, marks_of, sets, percent), "found")
        scratch += [pairs, found]
        links = links.union(found)
        if component is not None:
            discard(component)
        component = connected_components(links)
        members = joined.select("_bucket", "_class", "_degree")

    part = F.coalesce("component", "_class").alias("_part")
    placed = classes.select("_key", "_class", "_low").join(component.withColumnRenamed("node", "_class"), "_class", "left").select("_key", "_low", part)
    least = placed.groupBy("_part").agg(F.min("_low").alias("component_id"))
    placed = materialized(placed.join(least, "_part").select("_key", "component_id"), "components")
    for table in (*scratch, classes, component):
        discard(table)
    joined = salted_join(marks.select("_id", "_row", "n_shingles", "_key"), placed, ["_key"], "left", ["_id"])
    component_id = F.coalesce("component_id", "_id")
    return joined.select(F.col("_id").alias(id_column), *["_row"] * rows_told, "n_shingles", component_id.alias("component_id"), F.col("_id").eqNullSafe(component_id).alias("kept"))
