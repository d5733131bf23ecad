"""Queries: records, manifests, collections, books, streams; and general SQL over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talefold.config import EngineConfig
from talefold.functions.text import preview
from talefold.operators import books, collection, metadata
from talefold.plans.pipeline import collection_rows
from talefold.plans.sql import SPACE, chunks, strip
from talefold.session import scratch_dir
from talefold.streaming import ingest as stream


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def story_records(spark, sf):
    d = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("title"), "text")
    r = metadata.story_records(d, {"id": "", "meta": {"author": "unknown"}})
    return r.select("title", "id", F.size("chunks").alias("n_chunks"), "meta.author")


def _records(spark, sf) -> DataFrame:
    """Series records with their text as one chunk."""
    s = _table(spark, sf, "series_records")
    one = F.struct(F.when(F.col("raw_text").isNotNull(), F.concat(F.coalesce("id", F.lit("")), F.lit("_chunk_"), F.col("row_id").cast("string"))).alias("chunk_id"), F.col("raw_text").alias("text"), F.lit("setup").alias("section"))
    return s.select("id", "Is_series", "series", "volume", "meta", "chapter", F.array(one).alias("chunks"))


def ingest_manifest(spark, sf):
    m = metadata.manifest(_records(spark, sf))
    return m.select("id", F.length("text").alias("n"), F.col("metadata.Title").alias("title"), "metadata.Is_series", F.col("metadata.meta_json").alias("meta_json"), F.col("metadata.section").alias("section"))


def ingest_manifest_nested(spark, sf):
    """What manifest rows keep of record, chapter, series and volume."""
    m = metadata.manifest(_records(spark, sf))
    return m.select("id", *[F.col(f"metadata.{c}").alias(c if c != "id" else "story_id") for c in ("id", "chapter_json", "series_json", "volume_json")])


def manifest_backfill(spark, sf):
    return metadata.backfilled(_table(spark, sf, "ingest_manifest")).select("row_id", "chunk_id")


def manifest_metadata_merge(spark, sf):
    """Template, defaults and overrides (the hottest title's), for each manifest row."""
    m = _table(spark, sf, "ingest_manifest")
    text = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v)])
    template = text(author="unknown", lang="en", _note="no", series_json="{}", raw_text="x")
    override = F.when(F.col("metadata.Is_series"), text(Is_series="true", lang=F.coalesce("lang", F.lit("?"))))
    merged = metadata.merged(metadata.without_hidden(template), text(query_type="content"), override, F.coalesce("metadata.Title", F.lit("?")), F.coalesce("metadata.chunk_id", "id"))
    names = ("id", "Title", "chunk_id", "Is_series", "author", "lang", "query_type", "series_json", "raw_text", "_note")
    return m.select("row_id", *[F.try_element_at(merged, F.lit(n)).alias(f"m_{n.lower()}") for n in names])


def flat_metadata(spark, sf):
    """Lists in metadata as one text, blanks dropped."""
    c = _table(spark, sf, "retrieval_cases")
    return c.select("item_id", metadata.flat_list(F.concat("expected_facts", F.array(F.lit(" "), F.col("expected_author")))).alias("facts"))


def _existing(spark, sf) -> DataFrame:
    return _table(spark, sf, "village_chunks").select(F.col("chunk_id").alias("id"), F.col("text").alias("document"), F.lit(0).cast("bigint").alias("version"))


def collection_upsert(spark, sf):
    new = _table(spark, sf, "ingest_manifest").select("id", F.col("text").alias("document"), F.col("row_id").alias("version"))
    old = _table(spark, sf, "village_chunks").select(F.col("chunk_id").alias("id"), F.col("text").alias("document"), (-F.col("row_id")).alias("version"))
    return collection.upserted(old, new)


def collection_insert(spark, sf):
    rows = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("document"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(1).cast("bigint").alias("version"))
    return collection.inserted(rows, ["1", "new-a", "new-b", "new-a"], "A note.", {"lang": "en"}).select("id", "document", F.try_element_at("metadata", F.lit("query_type")).alias("query_type"), "version")


def collection_update(spark, sf):
    """Documents that evaluation items name by title get the item's passage."""
    d = _table(spark, sf, "documents").select(F.col("title").alias("id"), "doc_id", F.col("text").alias("document"))
    changes = _table(spark, sf, "retrieval_cases").select(F.col("expected_title").alias("id"), F.col("passage").alias("document"))
    return collection.updated(d, changes).select("doc_id", "document", "changed")


def collection_delete(spark, sf):
    gone = _table(spark, sf, "retrieval_cases").select(F.col("expected_title").alias("id"))
    return collection.deleted(_table(spark, sf, "documents").where("title is not null").select(F.col("title").alias("id"), "doc_id"), gone)


def collection_absent(spark, sf):
    asked = _table(spark, sf, "retrieval_cases").select(F.col("expected_title").alias("id"))
    return collection.absent(_table(spark, sf, "ingest_manifest").select(F.col("metadata.Title").alias("id")), asked)


def collection_count(spark, sf):
    return _table(spark, sf, "ingest_manifest").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.count_if(F.col("metadata.query_type") == "content").alias("n_content"))


def collection_ids_page(spark, sf):
    return collection.page(_table(spark, sf, "documents").select(F.col("doc_id").alias("id")), offset=40, limit=20)


def collection_list_page(spark, sf):
    d = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    return collection.listing(d, 0, 0)


def collection_get(spark, sf):
    return _table(spark, sf, "documents").where("doc_id = 100").select("doc_id", preview(F.col("text"), 500).alias("document"))


def content_rows(spark, sf):
    """What a search sees, with typed defaults for missing metadata."""
    m = _table(spark, sf, "ingest_manifest").where(F.col("metadata.query_type") == "content")
    return m.select("row_id", F.coalesce("metadata.Title", F.lit("")).alias("title"), F.coalesce("metadata.section", F.lit("")).alias("section"), F.coalesce("metadata.Is_series", F.lit(False)).alias("is_series"))


def skip_existing(spark, sf):
    """Titles of documents that have no record yet."""
    have = _table(spark, sf, "series_records").select(F.col("meta.title").alias("title"))
    return _table(spark, sf, "documents").select("title").where("title is not null").distinct().join(have, "title", "left_anti")


_ARCHIVE = [("a1", 5, ["a1.txt:Text", "A1.PDF:x", "a1.epub:EPUB"]), ("b2", 50, ["b2_x.djvu:PDF", "b2.epub:"]), ("c3", 50, ["c3.zip:ZIP"]), ("d4", 7, [])]
_ANSWERS = [
    '{"items":[{"id":"x1","selfLink":"s1","volumeInfo":{"title":"T1","authors":["A","B"],"infoLink":"i1","industryIdentifiers":[{"type":"OTHER","identifier":"0"},{"type":"ISBN_10","identifier":"10"},{"type":"ISBN_13","identifier":"13"}]},"accessInfo":{"pdf":{"downloadLink":"p1"},"publicDomain":true}},'
    '{"id":"x2","volumeInfo":{"title":"T2","infoLink":"i2"},"accessInfo":{"epub":{"downloadLink":"e2"}}}]}',
    '{"kind":"none"}',
    "not json",
]


def archive_pick(spark, sf):
    docs = spark.createDataFrame(_ARCHIVE, "identifier string, downloads bigint, names array<string>")
    files = F.transform("names", lambda n: F.struct(F.split_part(n, F.lit(":"), F.lit(1)).alias("name"), F.split_part(n, F.lit(":"), F.lit(2)).alias("format")))
    best = books.most_downloaded(books.not_yet(docs, spark.createDataFrame([("archive__d4__book.pdf",), ("other.txt",)], "name string")))
    return best.select("identifier", "downloads", books.picked_file(files).alias("file"))


def book_flatten(spark, sf):
    return books.flattened(spark.createDataFrame([(a,) for a in _ANSWERS], "json string"))


def stream_ingest(spark, sf):
    """Documents as a stream, in micro-batches, upserted into a collection; what it holds in the end."""
    import uuid

    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = _table(spark, sf, "documents").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/documents.parquet*")
    target = collection.Collection(spark, f"{folder}/collections", "documents")
    stream.ingest(rows.select(F.col("doc_id").cast("string").alias("title"), "text"), target, f"{folder}/checkpoint").awaitTermination()
    return target.read().select("id", "document")


def batch_ingest(spark, sf):
    rows = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("title"), "text")
    return collection_rows(rows, EngineConfig()).select("id", "document")


def event_windows(spark, sf):
    return stream.late_counts(_table(spark, sf, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def tpch_q1(spark, sf):
    li = _table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def tpch_q5(spark, sf):
    """Revenue by nation where customer and supplier are of the same nation."""
    t = lambda name: _table(spark, sf, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


_BLANK = f"[{SPACE}]*"
_CHUNKS = f"{chunks('doc_id', 'documents')} SELECT doc_id || '_chunk_' || no AS id, chunk AS document FROM chunks"
ORACLE = {
    "batch_ingest": _CHUNKS,
    "stream_ingest": _CHUNKS,
    "story_records": f"{chunks('doc_id', 'documents')}, n AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) SELECT doc_id::VARCHAR AS title, doc_id::VARCHAR AS id, coalesce(n, 0)::INT AS n_chunks, 'unknown' AS author FROM documents LEFT JOIN n USING (doc_id)",
    "ingest_manifest": """SELECT coalesce(id, '') || '_chunk_' || row_id AS id, length(raw_text) AS n, meta.title AS title, Is_series, json_object('author', meta.author, 'title', meta.title)::VARCHAR AS meta_json, 'setup' AS section
 FROM series_records WHERE raw_text IS NOT NULL""",
    "ingest_manifest_nested": """SELECT coalesce(id, '') || '_chunk_' || row_id AS id, coalesce(nullif(id, ''), meta.title) AS story_id,
 CASE WHEN chapter IS NULL THEN '{}' ELSE json_object('chapter_id', chapter.chapter_id, 'chapter_number', chapter.chapter_number, 'chapter_name', chapter.chapter_name)::VARCHAR END AS chapter_json,
 CASE WHEN Is_series THEN CASE WHEN series IS NULL THEN '{}' ELSE json_object('id', series.id, 'series_name', series.series_name)::VARCHAR END END AS series_json,
 CASE WHEN Is_series THEN CASE WHEN volume IS NULL THEN '{}' ELSE json_object('volume_id', volume.volume_id, 'volume_name', volume.volume_name, 'volume_number', volume.volume_number)::VARCHAR END END AS volume_json
 FROM series_records WHERE raw_text IS NOT NULL""",
    "manifest_backfill": f"""SELECT row_id, coalesce(nullif({strip('metadata.chunk_id')}, ''), nullif({strip('id')}, '')) AS chunk_id FROM ingest_manifest WHERE coalesce(nullif({strip('metadata.chunk_id')}, ''), nullif({strip('id')}, '')) IS NOT NULL""",
    "manifest_metadata_merge": """SELECT row_id, coalesce(metadata.Title, '?') AS m_id, coalesce(metadata.Title, '?') AS m_title, coalesce(metadata.chunk_id, id) AS m_chunk_id, CASE WHEN metadata.Is_series THEN 'true' ELSE 'false' END AS m_is_series,
 'unknown' AS m_author, CASE WHEN metadata.Is_series THEN coalesce(lang, '?') ELSE 'en' END AS m_lang, 'content' AS m_query_type, CASE WHEN metadata.Is_series THEN '{}' END AS m_series_json, NULL::VARCHAR AS m_raw_text, NULL::VARCHAR AS m__note FROM ingest_manifest""",
    "flat_metadata": f"SELECT item_id, array_to_string(list_filter(list_append(expected_facts, expected_author), lambda x: x IS NOT NULL AND NOT regexp_full_match(x, '{_BLANK}')), ', ') AS facts FROM retrieval_cases",
    "collection_upsert": """WITH u AS (SELECT chunk_id AS id, text AS document, -row_id AS version, 0 AS new FROM village_chunks UNION ALL SELECT id, text, row_id, 1 FROM ingest_manifest)
 SELECT id, document, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, new DESC) AS k FROM u WHERE id IS NOT NULL) WHERE k = 1""",
    "collection_insert": "SELECT doc_id::VARCHAR AS id, text AS document, NULL::VARCHAR AS query_type, 1::BIGINT AS version FROM documents UNION ALL SELECT id, 'A note.', 'Title', 0 FROM (VALUES ('1'), ('new-a'), ('new-b')) t(id) WHERE id NOT IN (SELECT doc_id::VARCHAR FROM documents)",
    "collection_update": "WITH c AS (SELECT expected_title AS id, max(passage) AS p FROM retrieval_cases GROUP BY 1) SELECT doc_id, coalesce(p, text) AS document, p IS NOT NULL AND p IS DISTINCT FROM text AS changed FROM documents LEFT JOIN c ON c.id = title",
    "collection_delete": "SELECT title AS id, doc_id FROM documents WHERE title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM retrieval_cases WHERE expected_title = title)",
    "collection_absent": "SELECT DISTINCT expected_title AS id FROM retrieval_cases WHERE NOT EXISTS (SELECT 1 FROM ingest_manifest WHERE metadata.Title = expected_title)",
    "collection_count": "SELECT count(*) AS n, count(DISTINCT id) AS n_ids, count(*) FILTER (metadata.query_type = 'content') AS n_content FROM ingest_manifest",
    "collection_ids_page": "SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40",
    "collection_list_page": "SELECT doc_id AS id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' WHEN length(text) > 0 THEN text END AS preview FROM documents",
    "collection_get": "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' WHEN length(text) > 0 THEN text END AS document FROM documents WHERE doc_id = 100",
    "content_rows": "SELECT row_id, coalesce(metadata.Title, '') AS title, coalesce(metadata.section, '') AS section, coalesce(metadata.Is_series, false) AS is_series FROM ingest_manifest WHERE metadata.query_type = 'content'",
    "skip_existing": "SELECT DISTINCT title FROM documents d WHERE title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM series_records s WHERE s.meta.title = d.title)",
    "archive_pick": "SELECT * FROM (VALUES ('b2', 50::BIGINT, 'b2_x.djvu'), ('c3', 50, NULL), ('a1', 5, 'A1.PDF')) t(identifier, downloads, file)",
    "book_flatten": "SELECT * FROM (VALUES ('x1', 'T1', 'A, B', '10', 's1', 'p1', NULL, true), ('x2', 'T2', '', NULL, 'i2', NULL, 'e2', false)) t(id, title, authors, isbn, url, pdf, epub, public_domain)",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
}
QUERIES = {
    f.__name__: f
    for f in (story_records, ingest_manifest, ingest_manifest_nested, manifest_backfill, manifest_metadata_merge, flat_metadata, collection_upsert, collection_insert, collection_update, collection_delete, collection_absent, collection_count, collection_ids_page,
              collection_list_page, collection_get, content_rows, skip_existing, archive_pick, book_flatten, stream_ingest, batch_ingest, event_windows, tpch_q1, tpch_q5)
}
