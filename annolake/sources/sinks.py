"""Writers. Rows stay distributed; only one-document formats gather, and those are folded by Spark itself."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_annotations(rows: DataFrame, path: str) -> None:
    """JSONL with nulls kept."""
    rows.write.option("ignoreNullFields", False).json(path)


def label_texts(samples: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
    """Label text of every sample; empty text where it has no line (``lines``: by, line_index, line)."""
    grouped = lines.filter("line is not null").groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("line_index", "line"))).alias("_l")
    )
    text = F.concat(F.array_join(F.transform("_l", lambda e: e["line"]), "\n"), F.lit("\n"))
    return samples.select(*by).join(grouped, by, "left").select(*by, F.coalesce(text, F.lit("")).alias("text"))


def write_label_files(texts: DataFrame, folder: str, name: str = "sample_id") -> None:
    """One ``<sample>.txt`` per row, written by the tasks into a shared folder; a retried task replaces its files."""

    def write(rows):
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            target = os.path.join(folder, f"{row[name]}.txt")
            part = f"{target}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8") as out:
                out.write(row["text"])
            os.replace(part, target)

    texts.foreachPartition(write)


def score_rows(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Score rows with key, prediction and kind, ready for JSONL."""
    kind = F.when(F.col("target"), "subtitle").when(F.col("has_candidate"), "text_distractor").otherwise("empty")
    return scored.select(
        F.concat_ws("::", "root", "sample_id").alias("sample_key"), "root", "sample_id", "segment_id",
        F.col("target").cast("int").alias("target"), kind.alias("sample_kind"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def write_scores(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One-row summary."""
    summary.coalesce(1).write.json(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One row per epoch into a growing table."""
    metrics.write.mode("append").json(path)


def masks_documents(records: DataFrame) -> DataFrame:
    """Mask records back to one document per root."""
    fields = [c for c in records.columns if c not in ("root", "sample_id", "key", "record_order")]
    entry = F.struct(F.col("record_order"), F.col("key"), F.struct(*fields).alias("value"))
    per_stem = records.groupBy("root", "sample_id").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["key"], e["value"]))).alias("r")
    )
    note = "Mask records over label files; the label files stay as they are."
    return per_stem.select("root", "sample_id", F.to_json("r").alias("r")).groupBy("root").agg(
        F.concat(
            F.lit('{"version":1,"description":"' + note + '","items":{'),
            F.array_join(F.array_sort(F.collect_list(F.concat(F.to_json(F.array("sample_id")).substr(F.lit(2), F.length(F.to_json(F.array("sample_id"))) - 2), F.lit(":"), F.col("r")))), ","),
            F.lit("}}"),
        ).alias("value")
    )


def review_documents(review: DataFrame) -> DataFrame:
    """Review decisions back to one version-2 document per root."""
    entry = F.struct("sample_id", F.struct("has_subtitle", "segment_id", "note", "updated_at"))
    items = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    document = F.struct(F.lit(2).alias("version"), F.lit("Reviewed presence and segment of each sample.").alias("description"), items.alias("items"))
    return review.groupBy("root").agg(F.to_json(document).alias("value"))
