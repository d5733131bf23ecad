"""Rows of book and archive searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = """id string, selfLink string, volumeInfo struct<title:string,authors:array<string>,description:string,previewLink:string,infoLink:string,
industryIdentifiers:array<struct<type:string,identifier:string>>>, accessInfo struct<webReaderLink:string,viewability:string,publicDomain:boolean,
pdf:struct<downloadLink:string>,epub:struct<downloadLink:string>>"""
FORMATS = ("pdf", "epub")


def flattened(raw: DataFrame, column: str = "json") -> DataFrame:
    """One row for each item of a search answer; of several ISBNs the first in the list's order."""
    answer = F.from_json(F.col(column), f"struct<items:array<struct<{ITEM}>>>".replace("\n", " "))
    i = F.col("i")
    rows = raw.select(F.explode(answer["items"]).alias("i"))
    isbns = F.filter(i["volumeInfo"]["industryIdentifiers"], lambda x: x["type"].isin("ISBN_13", "ISBN_10"))
    return rows.select(
        i["id"].alias("id"),
        i["volumeInfo"]["title"].alias("title"),
        F.coalesce(F.array_join(i["volumeInfo"]["authors"], ", "), F.lit("")).alias("authors"),
        F.get(isbns, F.lit(0))["identifier"].alias("isbn"),
        F.coalesce(i["selfLink"], i["volumeInfo"]["infoLink"]).alias("url"),
        i["accessInfo"]["pdf"]["downloadLink"].alias("pdf"),
        i["accessInfo"]["epub"]["downloadLink"].alias("epub"),
        F.coalesce(i["accessInfo"]["publicDomain"], F.lit(False)).alias("public_domain"),
    )


def most_downloaded(docs: DataFrame, rows: int = 10) -> DataFrame:
    return docs.orderBy(F.desc("downloads"), "identifier").limit(rows)


def not_yet(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Docs (identifier) for which no file `archive__{identifier}__...` is there."""
    have = files.select(F.regexp_extract("name", "^archive__(.+?)__", 1).alias("identifier")).where("identifier <> ''").distinct()
    return docs.join(have, "identifier", "left_anti")


def picked_file(files: Column, formats: list[str] = FORMATS) -> Column:
    """The name of the first file (name, format) of the first format that has one, by its ending or its format."""

    def first(fmt: str) -> Column:
        def fits(f: Column) -> Column:
            by_name = F.lower(f["name"]).endswith(f".{fmt}")
            return by_name | (f["format"] == fmt.upper()) if fmt in FORMATS else by_name

        return F.get(F.filter(files, fits), F.lit(0))["name"]

    return F.coalesce(*[first(fmt.lower()) for fmt in formats])
