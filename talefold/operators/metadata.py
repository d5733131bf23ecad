"""Story records, manifest rows and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talefold.functions.chunk import chunks_of
from talefold.functions.text import falsy, is_blank, parse_object, strip

RECORD = """Is_series boolean, id string, series struct<id:string,series_name:string>, volume struct<volume_id:string,volume_name:string,volume_number:int>,
meta struct<author:string,title:string>, chapter struct<chapter_id:string,chapter_number:int,chapter_name:string>, summary string, raw_text string,
chunks array<struct<chunk_id:string,text:string,section:string>>"""


#: What a record has where its template has none of these.
NESTED = {
    "series": ({"id": "", "series_name": ""}, "struct<id:string,series_name:string>"),
    "volume": ({"volume_id": "", "volume_name": "", "volume_number": 0}, "struct<volume_id:string,volume_name:string,volume_number:int>"),
    "chapter": ({"chapter_id": "", "chapter_number": 1, "chapter_name": ""}, "struct<chapter_id:string,chapter_number:int,chapter_name:string>"),
}


def _nested(template: dict, name: str) -> Column:
    default, kind = NESTED[name]
    value = template.get(name, default)
    return F.lit(None).cast(kind).alias(name) if value is None else F.struct(*[F.lit(value.get(k)).alias(k) for k in default]).cast(kind).alias(name)


def compact_json(c: Column) -> Column:
    """JSON without blanks, fields in order, nulls kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def flat_list(c: Column) -> Column:
    """A list in metadata: its members that aren't blank, joined by a comma and a space."""
    return F.array_join(F.filter(c, lambda x: ~is_blank(x)), ", ")


def object_or_empty(c: Column) -> Column:
    """JSON text of an object, without blanks; {} for anything else."""
    return F.coalesce(F.to_json(parse_object(c)), F.lit("{}"))


def flattened(c: Column) -> Column:
    """A JSON object as a map of texts: nulls go, lists of texts are joined, other lists and objects stay as JSON, truth values and numbers as text; an empty map for anything else."""
    entries = F.try_variant_get(parse_object(c), "$", "map<string,variant>")
    kept = F.map_filter(entries, lambda k, v: v.isNotNull() & ~F.is_variant_null(v))

    def text_of(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        texts = flat_list(F.try_variant_get(v, "$", "array<string>"))
        return F.when(kind == "ARRAY<STRING>", texts).when(kind.rlike("^(?:ARRAY|OBJECT)"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))

    return F.coalesce(F.transform_values(kept, lambda k, v: text_of(v)), F.create_map().cast("map<string,string>"))


def without_nulls(c: Column) -> Column:
    return F.map_filter(c, lambda k, v: v.isNotNull())


def without_hidden(c: Column) -> Column:
    """A template's entries but those whose key begins with an underscore."""
    return F.map_filter(c, lambda k, v: ~k.startswith("_"))


def overlaid(*maps: Column) -> Column:
    """One map of several, a later one's entry in place of an earlier one's, whatever the session does with equal keys."""

    def without(earlier: Column, later: tuple[Column, ...]) -> Column:
        return F.map_filter(earlier, lambda k, v: ~F.exists(F.array(*[F.map_contains_key(m, k) for m in later]), lambda x: x))

    return F.map_concat(*[without(m, maps[i + 1 :]) if i + 1 < len(maps) else m for i, m in enumerate(maps)])


def merged(template: Column, defaults: Column, override: Column, title: Column, chunk_id: Column) -> Column:
    """Metadata of a chunk: template, defaults and the title's own entries, later ones winning; texts left out; id falls back to the title."""
    empty = F.create_map().cast("map<string,string>")
    base = overlaid(*[F.coalesce(m, empty) for m in (template, defaults, override)])
    series = ~falsy(F.try_element_at(base, F.lit("Is_series")))
    dropped = ["raw_text", "chunks", "extracted", "Title", "chunk_id", "Is_series", "id"]
    kept = F.map_filter(base, lambda k, v: v.isNotNull() & ~k.isin(*dropped) & (series | ~k.isin("series_json", "volume_json")))
    own = F.try_element_at(base, F.lit("id"))
    forced = F.create_map(F.lit("id"), F.when(is_blank(own), title).otherwise(own), F.lit("Title"), title, F.lit("chunk_id"), chunk_id, F.lit("Is_series"), series.cast("string"))
    return F.map_concat(kept, forced)


def story_records(stories: DataFrame, template: dict | None = None, existing: DataFrame | None = None, overwrite: bool = False, only: list[str] | None = None) -> DataFrame:
    """One record for each story (title, text): the template's values, blank ids replaced by the title, and its chunks.

    Titles that have a record already are left out unless `overwrite`; `only`
    restricts to some titles. Null texts have no chunks. Each story keeps its own
    chunks, also where two have one title; nothing is shuffled.
    """
    t = template or {}
    rows = stories.where(F.col("title").isin(only)) if only else stories
    if existing is not None and not overwrite:
        rows = rows.join(existing.select("title").distinct(), "title", "left_anti")
    own = t.get("id") or ""
    numbered = F.transform(chunks_of(F.col("text")), lambda c, i: F.struct(F.concat(F.col("title"), F.lit("_chunk_"), (i + 1).cast("string")).alias("chunk_id"), c.alias("text"), F.lit("").alias("section")))
    return rows.withColumn("chunks", numbered).select(
        "title",
        F.lit(bool(t.get("Is_series", True))).alias("Is_series"),
        (F.lit(own) if own.strip() else F.col("title")).alias("id"),
        _nested(t, "series"),
        _nested(t, "volume"),
        F.struct(F.lit((t.get("meta") or {}).get("author") or "").alias("author"), F.col("title").alias("title")).alias("meta"),
        _nested(t, "chapter"),
        F.lit(t.get("summary") or "").alias("summary"),
        F.col("text").alias("raw_text"),
        F.coalesce("chunks", F.array().cast("array<struct<chunk_id:string,text:string,section:string>>")).alias("chunks"),
    )


def manifest(records: DataFrame) -> DataFrame:
    """One row for each chunk that has an id: id, text, metadata as the collection takes it.

    An empty id gives way to the title; series and volume are kept for series
    only; what a record lacks is an empty object.
    """
    c = F.col("c")
    nested = lambda name: F.coalesce(compact_json(F.col(name)), F.lit("{}"))
    rows = records.select("*", F.explode("chunks").alias("c")).where(~is_blank(c["chunk_id"]))
    return rows.select(
        c["chunk_id"].alias("id"),
        F.coalesce(c["text"], F.lit("")).alias("text"),
        F.struct(
            F.col("meta.title").alias("Title"),
            c["chunk_id"].alias("chunk_id"),
            F.when(F.length("id") > 0, F.col("id")).otherwise(F.col("meta.title")).alias("id"),
            "Is_series",
            F.lit("content").alias("query_type"),
            F.coalesce(c["section"], F.lit("")).alias("section"),
            nested("meta").alias("meta_json"),
            nested("chapter").alias("chapter_json"),
            F.when(F.col("Is_series"), nested("series")).alias("series_json"),
            F.when(F.col("Is_series"), nested("volume")).alias("volume_json"),
        ).alias("metadata"),
    )


def backfilled(manifest_rows: DataFrame) -> DataFrame:
    """Manifest rows whose chunk_id is their id where they have none; rows without any id are dropped."""
    key = F.coalesce(F.nullif(strip(F.col("metadata.chunk_id")), F.lit("")), F.nullif(strip(F.col("id")), F.lit("")))
    return manifest_rows.withColumn("chunk_id", key).where(F.col("chunk_id").isNotNull())
