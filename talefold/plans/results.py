"""Queries: answers of stores and services, prompts and settings, requests and downloads, the life of a collection."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talefold.config import EngineConfig
from talefold.functions import text
from talefold.operators import collection, metadata, results
from talefold.plans.sql import strip
from talefold.plans.texts import _SHORT
from talefold.session import scratch_dir
from talefold.sources import files

_MODES = ["thinking", " Think ", "SLOW", "medium", "fast", "quick", ""]
_TYPES = ["single", "Standalone", "series", " chapter", "CHAPTERS", "both", ""]
_PROVIDERS = ["hf", "HuggingFace", " transformers ", "local", "ollama", "other", ""]
_TRUTHS = ["1", "true", " YES ", "y", "no", "0", "maybe"]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _one_of(values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))


def aliases(spark, sf):
    """Every alias of modes, story types, providers and truth values, in turn."""
    d = _table(spark, sf, "documents")
    return d.select("doc_id", text.mode(_one_of(_MODES)).alias("mode"), text.story_type(_one_of(_TYPES)).alias("story_type"), text.provider(_one_of(_PROVIDERS)).alias("provider"), text.truthy(_one_of(_TRUTHS)).alias("truthy"), text.falsy(_one_of(_TRUTHS)).alias("falsy"))


def mode_settings(spark, sf):
    cfg = EngineConfig(thinking_max_tokens=1536, thinking_top_p=0.9)
    s = results.generation_settings(_one_of(_MODES), cfg, F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") % 100).cast("int")))
    return _table(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.max_tokens", "s.temperature", "s.top_p")


def answer_hits(spark, sf):
    """Answers of a store in its three shapes, a distance that is no number, and what is no answer."""
    d = _table(spark, sf, "documents").select("doc_id", "title", "author", F.left("text", F.lit(100)).alias("t"))
    meta = F.struct(F.col("title").alias("Title"), F.col("author").alias("Author"))
    number = F.col("doc_id").cast("double") / 8
    nested = F.struct(F.struct(F.array(F.array("t")).alias("documents"), F.array(F.array(meta)).alias("metadatas"), F.array(F.array(number)).alias("distances")).alias("results"))
    flat = F.struct(F.array(F.col("t"), F.lit("more")).alias("documents"), F.array(meta).alias("metadatas"))
    objects = F.array(F.struct(F.col("t").alias("document"), meta.alias("metadata"), F.lit("far").alias("distance")))
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.to_json(nested)).when(k == 1, F.to_json(flat)).when(k == 2, F.to_json(objects)).otherwise("no answer")
    return d.select("doc_id", F.posexplode(results.hits(raw)).alias("no", "h")).select("doc_id", "no", "h.title", "h.author", "h.summary", "h.document", "h.distance")


def result_fields(spark, sf):
    s = _table(spark, sf, "series_records")
    entries = F.create_map(F.lit("series_id"), F.col("series.id"), F.lit("series_name"), F.col("series.series_name"), F.lit("volume_number"), F.when(F.col("row_id") % 3 == 0, "none").otherwise(F.col("volume.volume_number").cast("string")), F.lit("chapter_name"), F.col("chapter.chapter_name"))
    return s.select("row_id", results.result_fields(metadata.without_nulls(entries)).alias("f")).select("row_id", "f.*")


def evaluation_responses(spark, sf):
    d = _table(spark, sf, "documents")
    n = (F.col("doc_id") % 10).cast("string")
    full = F.concat(F.lit('{"average_score": '), n, F.lit(', "scores": {"depth": '), n, F.lit('}, "summary": "fine", "suggestions": ["a", "b"], "conclusion": "c"}'))
    k = F.col("doc_id") % 3
    r = results.evaluation_response(F.when(k == 0, full).when(k == 1, "{}").otherwise('{"average_score": "high", "summary": "s"}'))
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.success", "r.average_score", "r.summary", "r.conclusion", F.array_join("r.suggestions", ",").alias("suggestions"), "r.scores", "r.metadata")


def prompts(spark, sf):
    asked = results.filled("QUERY:\n{query}\n\nBY: {author} {{x}}\n{section}", query=F.col("title"), author=F.col("author"), section=F.col("section"))
    return _table(spark, sf, "documents").select("doc_id", asked.alias("prompt"))


def template_by_series(spark, sf):
    chosen = results.by_series(F.col("metadata.Is_series"), {"kind": "series", "volume": "1"}, {"kind": "single"})
    return _table(spark, sf, "ingest_manifest").select("row_id", F.try_element_at(chosen, F.lit("kind")).alias("kind"), F.try_element_at(chosen, F.lit("volume")).alias("volume"))


def nested_metadata(spark, sf):
    """Metadata with objects, lists, numbers and truth values as a flat map of texts."""
    s = _table(spark, sf, "series_records")
    raw = F.to_json(F.struct("id", "Is_series", "meta", F.col("volume.volume_number").alias("number"), F.array("lang", F.lit(" "), "source").alias("tags")), {"ignoreNullFields": "false"})
    flat = metadata.flattened(raw)
    names = ("id", "Is_series", "number", "tags")
    author = F.get_json_object(F.try_element_at(flat, F.lit("meta")), "$.author")
    return s.select("row_id", *[F.try_element_at(flat, F.lit(n)).alias(n.lower()) for n in names], author.alias("author"))


def scoring_inputs(spark, sf):
    """Summaries beside the text of the document of their title."""
    s = _table(spark, sf, "standalone_records").select("row_id", F.col("meta.title").alias("name"), F.col("summary").alias("text"))
    d = _table(spark, sf, "documents").where("title is not null and text is not null").select(F.col("title").alias("name"), "text")
    return files.with_sources(s, d).select("row_id", "text", "source_text")


def section_feedbacks(spark, sf):
    s = _table(spark, sf, "series_records").where("raw_text is not null")
    return s.select("row_id", results.section_feedback(text.short_sections(F.col("raw_text"), 3), 3).alias("feedback"))


def story_events(spark, sf):
    d = _table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.left("text", F.lit(200)).alias("story"))
    return results.story_events(d)


def volume_requests(spark, sf):
    d = _table(spark, sf, "documents")
    return d.select("doc_id", results.volume_request("https://books.test/volumes", F.col("title"), "k").alias("url"), results.archive_query(F.col("title")).alias("query"), results.archive_query(F.col("title"), F.col("author")).alias("retry"))


def volume_answers(spark, sf):
    d = _table(spark, sf, "documents")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 200, 200, 401, 500)]), (F.col("doc_id") % 5 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"items": ['), F.col("doc_id").cast("string"), F.lit("]}"))).when(F.col("doc_id") % 5 == 1, '{"error": {"message": "quota"}}').otherwise("<html>")
    return d.select("doc_id", results.volume_answer(status, body).alias("a")).select("doc_id", "a.items", "a.error")


def _archive_docs(spark, sf) -> DataFrame:
    """Answers of an archive for each title: nothing by title alone for every third document."""
    d = _table(spark, sf, "documents")
    doc = F.struct(F.concat(F.lit("id"), F.col("doc_id").cast("string")).alias("identifier"), F.col("title"), (F.col("doc_id") * 7 % 1000).alias("downloads"))
    answer = lambda docs: F.to_json(F.struct(F.struct(docs.alias("docs")).alias("response")))
    none = F.array_except(F.array(doc), F.array(doc))
    rows = d.select(F.col("doc_id").alias("request_id"), F.explode(F.array(F.struct(F.lit(1).alias("attempt"), answer(F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.array(doc))).alias("json")), F.struct(F.lit(2).alias("attempt"), answer(F.array(doc)).alias("json")))).alias("a"))
    return results.archive_docs(rows.select("request_id", "a.attempt", "a.json"))


def archive_docs(spark, sf):
    return _archive_docs(spark, sf)


def download_plans(spark, sf):
    docs = _archive_docs(spark, sf).select("identifier", "title", F.when(F.col("request_id") % 5 > 0, F.concat("identifier", F.lit(".v1.pdf"))).alias("file"), (F.col("request_id") * 1_000_003 % 50_000_000).alias("size"))
    p = results.download_plan(docs, "https://archive.test/download/")
    return p.select("identifier", "url", "name", F.size("blocks").alias("n_blocks"), F.element_at("blocks", -1)["offset"].alias("last_offset"), F.element_at("blocks", -1)["length"].alias("last_length"))


def archive_metadata(spark, sf):
    d = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("identifier"), "title", F.array("author").alias("creators"), F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("name"))
    m = results.archive_metadata(d, F.lit("asked"), F.lit("20260101_000000"))
    return m.select("name", *[F.get_json_object("json", f"$.{p}").alias(n) for n, p in (("title", "books[0].title"), ("author", "books[0].authors[0]"), ("filename", "books[0].filename"), ("search_query", "search_query"))])


def collection_life(spark, sf):
    """A collection after writes in groups, new versions, updates and deletions, all as segments, some of them merged."""
    c = collection.Collection(spark, f"{scratch_dir(spark)}/life-{uuid.uuid4().hex}", "life")
    none = F.lit(None).cast("map<string,string>")
    m = _table(spark, sf, "ingest_manifest").where("id is not null").select("id", F.col("text").alias("document"), none.alias("metadata"), F.col("row_id").alias("version"))
    c.upsert(m, 7)
    v = _table(spark, sf, "village_chunks").select(F.col("chunk_id").alias("id"), F.col("text").alias("document"), none.alias("metadata"), F.lit(-1).cast("bigint").alias("version"))
    c.upsert(v)
    c.update(m.where("version % 10 = 0").select("id", F.concat(F.lit("new "), "id").alias("document")).distinct())
    c.delete(m.where("version % 10 = 3").select("id"))
    return c.read().select("id", "document")


_PICK = lambda values: f"[{', '.join(repr(v) for v in values)}][doc_id % {len(values)} + 1]"
_SLOW = f"lower(trim({_PICK(_MODES)})) IN ('thinking', 'think', 'slow', 'medium')"
_META = "coalesce(title, '') AS title, coalesce(author, '') AS author, '' AS summary"
_SAFE = """left(replace(regexp_replace(coalesce(title, 'Unknown'), '[<>:"/\\\\|?*]', '_', 'g'), ' ', '_'), 100)"""
ORACLE = {
    "aliases": f"""SELECT doc_id, CASE WHEN {_SLOW} THEN 'thinking' ELSE 'fast' END AS mode, CASE WHEN lower(trim({_PICK(_TYPES)})) IN ('single', 'standalone') THEN 'single' WHEN lower(trim({_PICK(_TYPES)})) IN ('series', 'chapter', 'chapters') THEN 'series' ELSE 'mix' END AS story_type,
 CASE WHEN lower(trim({_PICK(_PROVIDERS)})) IN ('hf', 'huggingface', 'transformers', 'local') THEN 'transformers' ELSE 'ollama' END AS provider, lower(trim({_PICK(_TRUTHS)})) IN ('1', 'true', 'yes', 'y') AS truthy, lower(trim({_PICK(_TRUTHS)})) IN ('false', '0', 'no', '') AS falsy FROM documents""",
    "mode_settings": f"SELECT doc_id, (CASE WHEN doc_id % 4 = 0 THEN doc_id % 100 WHEN {_SLOW} THEN 1536 ELSE 768 END)::INT AS max_tokens, 0.4::DOUBLE AS temperature, (CASE WHEN {_SLOW} THEN 0.9 ELSE 0.8 END)::DOUBLE AS top_p FROM documents",
    "answer_hits": f"""WITH d AS (SELECT doc_id, title, author, left(text, 100) AS t FROM documents)
 SELECT doc_id, 0 AS no, {_META}, coalesce(t, '') AS document, CASE WHEN doc_id % 4 = 0 THEN doc_id / 8.0::DOUBLE END AS distance FROM d WHERE doc_id % 4 <> 3
 UNION ALL SELECT doc_id, 1, '', '', '', 'more', NULL FROM d WHERE doc_id % 4 = 1""",
    "result_fields": """SELECT row_id, coalesce(series.id, '') AS series_id, coalesce(series.series_name, '') AS series_name, CASE WHEN row_id % 3 = 0 THEN 0 ELSE coalesce(volume.volume_number, 0) END AS volume_number, '' AS chapter_id, 0 AS chapter_number,
 coalesce(chapter.chapter_name, '') AS chapter_name, '' AS section, '' AS "character" FROM series_records""",
    "evaluation_responses": """SELECT doc_id, doc_id % 3 <> 1 AS success, CASE WHEN doc_id % 3 = 0 THEN doc_id % 10 ELSE 0 END::DOUBLE AS average_score, CASE doc_id % 3 WHEN 0 THEN 'fine' WHEN 1 THEN '' ELSE 's' END AS summary, CASE WHEN doc_id % 3 = 0 THEN 'c' ELSE '' END AS conclusion,
 CASE WHEN doc_id % 3 = 0 THEN 'a,b' ELSE '' END AS suggestions, CASE WHEN doc_id % 3 = 0 THEN '{"depth":' || doc_id % 10 || '}' ELSE '{}' END AS scores, '{}' AS metadata FROM documents""",
    "prompts": "SELECT doc_id, 'QUERY:' || chr(10) || coalesce(title, '') || chr(10) || chr(10) || 'BY: ' || coalesce(author, '') || ' {x}' || chr(10) || coalesce(section, '') AS prompt FROM documents",
    "template_by_series": "SELECT row_id, CASE WHEN metadata.Is_series THEN 'series' ELSE 'single' END AS kind, CASE WHEN metadata.Is_series THEN '1' END AS volume FROM ingest_manifest",
    "nested_metadata": "SELECT row_id, id, Is_series::VARCHAR AS is_series, volume.volume_number::VARCHAR AS number, CASE WHEN lang IS NOT NULL AND source IS NOT NULL THEN lang || ', ' || source END AS tags, meta.author AS author FROM series_records",
    "scoring_inputs": "WITH d AS (SELECT title, max(text) AS t FROM documents WHERE title IS NOT NULL AND text IS NOT NULL GROUP BY 1) SELECT row_id, summary AS text, coalesce(t, 'Not provided.') AS source_text FROM standalone_records LEFT JOIN d ON d.title = meta.title",
    "section_feedbacks": f"""WITH {_SHORT}, f AS (SELECT row_id, string_agg('(' || n || ', ' || sentences || ')', ', ' ORDER BY n) AS f FROM counted WHERE sentences < 3 GROUP BY row_id)
 SELECT s.row_id, 'Section format fix required: each section must have at least 3 complete sentences. Sections below minimum: [' || f || ']. Expand only the short sections while preserving grounded facts.' AS feedback FROM series_records s LEFT JOIN f ON f.row_id = s.row_id WHERE raw_text IS NOT NULL""",
    "story_events": """WITH d AS (SELECT doc_id, left(text, 200) AS t FROM documents), ok AS (SELECT doc_id, t, coalesce(length(STRIP) > 0, false) AS ok FROM d),
 e AS (SELECT doc_id, list_concat([{step: 'retrieve', status: 'start', detail: NULL::VARCHAR}, {step: 'retrieve', status: 'done', detail: NULL}, {step: 'extract', status: 'start', detail: NULL}, {step: 'extract', status: 'done', detail: NULL}, {step: 'generate', status: 'start', detail: NULL},
  {step: 'generate', status: CASE WHEN ok THEN 'done' ELSE 'error' END, detail: NULL}], CASE WHEN ok THEN list_transform(regexp_extract_all(t, '\\S+\\s*'), lambda x: {step: 'token', status: 'data', detail: x}) ELSE [] END, [{step: 'end', status: 'done', detail: NULL::VARCHAR}]) AS e FROM ok),
 u AS (SELECT doc_id AS query_id, unnest(range(len(e)))::INT AS seq, unnest(e) AS x FROM e) SELECT query_id, seq, x.step AS step, x.status AS status, x.detail AS detail FROM u""".replace("STRIP", strip("t")),
    "volume_requests": """SELECT doc_id, 'https://books.test/volumes?q=title:' || replace(url_encode(title), '%2F', '/') || '&key=k&maxResults=20' AS url, 'title:"' || coalesce(nullif(title, ''), 'Unknown') || '" AND mediatype:texts' AS query,
 'title:"' || coalesce(nullif(title, ''), 'Unknown') || '" AND creator:"' || author || '" AND mediatype:texts' AS retry FROM documents""",
    "volume_answers": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '{"items": [' || doc_id || ']}' END AS items, CASE doc_id % 5 WHEN 1 THEN 'quota' WHEN 2 THEN 'no JSON' WHEN 3 THEN 'not authorised' WHEN 4 THEN 'status 500' END AS error FROM documents""",
    "archive_docs": "SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS attempt, 'id' || doc_id AS identifier, title, doc_id * 7 % 1000 AS downloads FROM documents",
    "download_plans": f"""WITH d AS (SELECT doc_id, title, 'id' || doc_id AS identifier, doc_id * 1000003 % 50000000 AS size FROM documents WHERE doc_id % 5 > 0), b AS (SELECT *, greatest(ceil(size / 10485760.0), 1)::INT AS n FROM d)
 SELECT identifier, 'https://archive.test/download/' || identifier || '/' || identifier || '.v1.pdf' AS url, 'archive__' || identifier || '__' || {_SAFE} || '.pdf' AS name, n AS n_blocks, (n - 1)::BIGINT * 10485760 AS last_offset, least(10485760, size - (n - 1)::BIGINT * 10485760) AS last_length FROM b""",
    "archive_metadata": "SELECT 'archive_books_20260101_000000_' || doc_id || '.json' AS name, coalesce(title, 'asked') AS title, coalesce(nullif(author, ''), 'Unknown') AS author, 'a/' || doc_id || '.txt' AS filename, 'asked' AS search_query FROM documents",
    "collection_life": """WITH m AS (SELECT id, text AS document, row_id AS version, 1 AS w FROM ingest_manifest WHERE id IS NOT NULL UNION ALL SELECT chunk_id, text, -1, 2 FROM village_chunks WHERE chunk_id IS NOT NULL),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, w DESC, document NULLS FIRST) AS k FROM m)
 SELECT id, CASE WHEN id IN (SELECT id FROM ingest_manifest WHERE row_id % 10 = 0) THEN 'new ' || id ELSE document END AS document FROM k WHERE k = 1 AND id NOT IN (SELECT id FROM ingest_manifest WHERE row_id % 10 = 3 AND id IS NOT NULL)""",
}
QUERIES = {
    f.__name__: f
    for f in (aliases, mode_settings, answer_hits, result_fields, evaluation_responses, prompts, template_by_series, nested_metadata, scoring_inputs, section_feedbacks, story_events, volume_requests, volume_answers, archive_docs, download_plans,
              archive_metadata, collection_life)
}
