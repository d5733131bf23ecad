"""File sources: stories, records, manifests, evaluation cases, templates, books."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talefold.functions.chunk import formatted
from talefold.functions.text import first_of
from talefold.operators.metadata import RECORD

MANIFEST = """id string, text string, metadata struct<Title:string,chunk_id:string,id:string,Is_series:boolean,query_type:string,section:string,
meta_json:string,chapter_json:string,series_json:string,volume_json:string>"""
CASES = "query string, expected_title string, expected_facts string, expected_author string"


def _stem(suffix: str):
    return F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), rf"(?i)\.{suffix}\z", "")


def stories(spark: SparkSession, folder: str) -> DataFrame:
    """title, text of each .txt file of one folder; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.option("pathGlobFilter", "*.[tT][xX][tT]").text(folder, wholetext=True)
    return files.select(_stem("txt").alias("title"), F.col("value").alias("text"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Story records of a folder of JSON files; files that hold no object are dropped."""
    files = spark.read.schema(RECORD.replace("\n", " ")).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder)
    return files.where("id is not null or raw_text is not null or chunks is not null")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of JSON lines; chunk_id falls back to id, rows without either are dropped. `file` and `line` tell their order."""
    rows = spark.read.schema(MANIFEST.replace("\n", " ")).json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("line", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
    return rows.withColumn("chunk_id", first_of(F.col("metadata.chunk_id"), F.col("id"))).where("chunk_id is not null")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases: a list or {cases: [...]}; one fact may stand for a list; cases without query or title are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.cases", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    c = raw.select(F.explode(listed).alias("c"))
    text = lambda name: F.trim(F.try_variant_get("c", f"$.{name}", "string"))
    facts = F.coalesce(F.try_variant_get("c", "$.expected_facts", "array<string>"), F.array(F.try_variant_get("c", "$.expected_facts", "string")))
    out = c.select(text("query").alias("query"), text("expected_title").alias("expected_title"), F.filter(facts, lambda f: f.isNotNull() & (F.trim(f) != "")).alias("expected_facts"), text("expected_author").alias("expected_author"))
    return out.where("query <> '' and expected_title <> ''")


def template(path: str) -> tuple[dict, dict]:
    """(defaults, by_title) of a metadata template; keys that begin with an underscore are comments at both levels."""
    try:
        raw = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        raw = {}
    raw = raw if isinstance(raw, dict) else {}
    visible = lambda d: {k: v for k, v in (d if isinstance(d, dict) else {}).items() if not k.startswith("_")}
    if "defaults" in raw or "by_title" in raw:
        return visible(raw.get("defaults")), {k: visible(v) for k, v in visible(raw.get("by_title")).items()}
    return {}, {k: visible(v) for k, v in visible(raw).items() if isinstance(v, dict)}


#: What stands for a source text that isn't there.
NOT_PROVIDED = "Not provided."


def with_sources(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """texts (name, text) with `source_text`: the text of the source (name, text) of that name, NOT_PROVIDED where there is none. Of several sources of a name, the greatest text counts."""
    given = sources.groupBy("name").agg(F.max("text").alias("source_text"))
    return texts.join(given, "name", "left").withColumn("source_text", F.coalesce("source_text", F.lit(NOT_PROVIDED)))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """path, length, modified of the files with these endings, whatever their case, in the order of their paths."""
    ending = "|".join(re.escape(s.lower()) for s in suffixes)
    found = spark.read.format("binaryFile").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return found.where(F.lower("path").rlike(rf"(?:{ending})\z")).orderBy("path")


_TAG = re.compile(r"(?is)<(script|style)\b.*?</\1>|<[^>]+>")


def html_text(page: str) -> str:
    """The visible text of a page, one line for each block."""
    page = re.sub(r"(?i)<(?:br|/p|/div|/h\d|/li|/tr)\b[^>]*>", "\n", page)
    lines = (re.sub(r"\s+", " ", line).strip() for line in html.unescape(_TAG.sub("", page)).split("\n"))
    return "\n".join(line for line in lines if line)


def epub_text(data: bytes) -> str:
    """The chapters of an EPUB in the order of its file names, blank lines between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = sorted(n for n in book.namelist() if n.lower().endswith((".xhtml", ".html", ".htm", ".md", ".txt")))
        parts = [html_text(book.read(n).decode("utf-8", "replace")) for n in names]
    return "\n\n".join(p for p in parts if p)


def pdf_text(data: bytes) -> str:
    """Text blocks of a PDF, by whichever library is there; without one, an error for that file."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("no PDF library") from e
    return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages).strip()


READERS = {"epub": epub_text, "pdf": pdf_text, "html": lambda b: html_text(b.decode("utf-8", "replace")), "txt": lambda b: b.decode("utf-8", "replace")}


def books(spark: SparkSession, folder: str) -> DataFrame:
    """name, text, error of each book file; an unreadable file has an error and no text, the others go on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{epub,pdf,html,txt,EPUB,PDF,HTML,TXT}").load(folder)

    @F.pandas_udf("struct<text:string,error:string>")
    def read(name: pd.Series, content: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for n, data in zip(name, content):
            try:
                texts.append(READERS[n.rsplit(".", 1)[-1].lower()](bytes(data)))
                errors.append(None)
            except Exception as e:  # noqa: BLE001  # one bad file must not end the job
                texts.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"text": texts, "error": errors})

    name = F.url_decode(F.col("_metadata.file_name"))
    rows = files.select(name.alias("name"), read(name, F.col("content")).alias("r"))
    return rows.select("name", formatted(F.col("r.text")).alias("text"), F.col("r.error").alias("error"))


def counters(read: DataFrame) -> DataFrame:
    """One row: files, failed, characters."""
    return read.agg(F.count("*").alias("files"), F.count("error").alias("failed"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))
