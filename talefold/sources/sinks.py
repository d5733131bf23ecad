"""Writers: JSON lines, records, texts, reports. Nothing is overwritten in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talefold.functions.text import clean_story, is_blank, merge_paragraphs


def write_manifest(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines; one_file only for small results, as a single task writes them."""
    (rows.coalesce(1) if one_file else rows).write.mode("errorifexists").json(path)


def write_records(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_texts(rows: DataFrame, path: str) -> None:
    """name, text as Parquet, blank texts left out."""
    rows.where(~is_blank(F.col("text"))).select("name", "text").write.mode("append").parquet(path)


def append_stamped(rows: DataFrame, path: str) -> None:
    """Stories, evaluations, reports: rows with the time they were saved, as yyyyMMdd_HHmmss."""
    rows.withColumn("saved_at", F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).write.mode("append").parquet(path)


def write_merged_paragraphs(files: DataFrame, path: str) -> None:
    """Text files (name, text) with their paragraphs merged, under a new folder; the files read stay as they are."""
    files.select("name", merge_paragraphs(F.col("text")).alias("text")).write.mode("errorifexists").parquet(path)


def write_archive_metadata(rows: DataFrame, path: str) -> None:
    """name, json of downloaded books, one line each."""
    rows.select("name", "json").write.mode("append").json(path)


def saved_stories(rows: DataFrame, path: str) -> None:
    """Generated stories (text), cleaned and stamped; empty ones are not saved."""
    append_stamped(rows.withColumn("text", clean_story(F.col("text"))).where(~is_blank(F.col("text"))), path)


def saved_summaries(rows: DataFrame, path: str) -> None:
    """Summaries (name, source_text, summary), stamped; a missing or blank source is an error, before anything is written."""
    if not rows.where(is_blank(F.col("source_text"))).isEmpty():
        raise ValueError("a summary needs its source")
    append_stamped(rows, path)
