"""Queries: text functions, chunking, sections, entities, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talefold.functions import chunk, text
from talefold.models import embed, summarise
from talefold.operators import enrich, evaluate
from talefold.plans.sql import SPACE, WIDE, chunks, strip, words


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf, *columns) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", *columns)


def _story(spark, sf, *columns) -> DataFrame:
    return _table(spark, sf, "series_records").select("row_id", *columns)


def word_count(spark, sf):
    return _docs(spark, sf, text.word_count(F.col("text")).alias("n_words"), text.sentence_count(F.col("text")).alias("n_sentences"))


def completeness(spark, sf):
    c = _story(spark, sf, evaluate.completeness(F.col("raw_text"), 250).alias("c"))
    return c.select("row_id", "c.ok", "c.word_count", F.array_join(F.col("c.missing_sections").cast("array<string>"), ",").alias("missing"), "c.ends_clean", F.array_join("c.reasons", "; ").alias("reasons"))


def completeness_sections(spark, sf):
    """With a minimum of sentences in each section."""
    c = _story(spark, sf, evaluate.completeness(F.col("raw_text"), 50, 2, 3).alias("c"))
    return c.select("row_id", "c.ok", F.array_join("c.reasons", "; ").alias("reasons"))


def section_bodies(spark, sf):
    return _story(spark, sf, F.explode(text.section_bodies(F.col("raw_text"))).alias("section", "body"))


def short_sections(spark, sf):
    return _story(spark, sf, F.explode(text.short_sections(F.col("raw_text"), 3)).alias("s")).select("row_id", "s.n", "s.sentences")


def entities(spark, sf):
    return _docs(spark, sf, F.explode(text.entities(F.col("text"))).alias("entity"))


def strip_think(spark, sf):
    return _docs(spark, sf, text.strip_think(F.concat(F.lit("<think>a\nb</think>"), F.coalesce(F.col("text"), F.lit("")), F.lit("<think>c</think>"))).alias("out"))


def repair_json(spark, sf):
    raw = F.concat(F.lit("```json\nSure: {\"title\": \""), F.regexp_replace(F.coalesce("title", F.lit("")), r'["\\]', ""), F.lit("\", \"n\": [1, 2, ], }\nDone\n```"))
    return _docs(spark, sf, text.repair_json(raw).alias("out"))


def searchable_text(spark, sf):
    return _docs(spark, sf, text.searchable(F.col("title"), F.col("author"), F.lit(None), F.col("text")).alias("out"))


def safe_title(spark, sf):
    return _docs(spark, sf, text.safe_title(F.concat(F.coalesce("title", F.lit("?")), F.lit(": a/b "), F.coalesce("author", F.lit("*")))).alias("out"))


def story_types(spark, sf):
    """Aliases of modes, story types and providers, and truth values, over labels of documents."""
    q = F.col("query_type")
    return _docs(spark, sf, text.mode(q).alias("mode"), text.story_type(F.col("section")).alias("story_type"), text.provider(F.col("source")).alias("provider"), text.truthy(F.col("lang")).alias("truthy"), text.retryable(F.col("text")).alias("retryable"), text.is_blank(F.col("text")).alias("blank"))


def label_cleanup(spark, sf):
    return _table(spark, sf, "village_chunks").select("row_id", text.label(F.col("section")).alias("label"))


def format_extracted(spark, sf):
    return _docs(spark, sf, chunk.formatted(F.col("text")).alias("out"))


def clean_story(spark, sf):
    return _story(spark, sf, text.clean_story(F.col("raw_text")).alias("out"))


def sentence_split(spark, sf):
    return _docs(spark, sf, F.posexplode(text.sentences(F.col("text"))).alias("no", "sentence"))


def merge_paragraphs(spark, sf):
    return _docs(spark, sf, text.merge_paragraphs(F.regexp_replace(F.col("text"), "\n\n", "\n - - -\n")).alias("out"))


def url_quote(spark, sf):
    return _docs(spark, sf, text.url_quote(F.col("title")).alias("out"))


def chunk_documents(spark, sf):
    d = _docs(spark, sf, "title", "text")
    return chunk.chunked(d, "title", "text").select("doc_id", "chunk_no", "chunk_id", "chunk")


def chunk_paragraph_pack_all(spark, sf):
    """All documents with a text; pieces of up to 1,800 characters, a longer paragraph is a piece of its own."""
    d = _docs(spark, sf, text.newline_trim(F.col("text")).alias("t")).where("t is not null")
    return d.select("doc_id", F.size(chunk.packed_paragraphs(F.col("t"))).alias("n_chunks"))


def section_tag(spark, sf):
    """Positional labels of the chunks of each record."""
    v = _table(spark, sf, "village_chunks").where("record_id is not null")
    rows = enrich.labelled(v.select("row_id", "record_id", F.lit("").alias("label")), "record_id", "row_id", "label")
    return rows.select("row_id", "section")


_LABELS = ["setup", "conflict", "journey", "climax", "resolution"]


def label_streak(spark, sf):
    """Labels of events as a model might give them, in order; long repetitions give way to the positional label."""
    e = _table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return enrich.labelled(e, "user_id", "event_id", "event_type", ["view", "click", "purchase"]).select("event_id", "section")


def embed_documents(spark, sf):
    return _docs(spark, sf, embed(F.col("text")).alias("v")).select("doc_id", F.size("v").alias("width"))


def summaries(spark, sf):
    return _docs(spark, sf, summarise(F.col("text")).alias("summary"))


def listed_models(spark, sf):
    names = F.concat(F.when(F.col("doc_id") % 2 == 0, "models/").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "text-embedding-").when(F.col("doc_id") % 5 == 0, "gemini-image-").otherwise("gemini-"), F.col("doc_id").cast("string"))
    return _docs(spark, sf, names.alias("name")).where(text.listed_model(F.col("name")))


_BARE = strip("text")
_RAW = strip("coalesce(raw_text, '')")
_FOUND = f"list_transform(regexp_extract_all({_RAW}, '(?i)\\[SECTION\\s+(\\d+)', 1), lambda x: x::INT)"
_MISSING = f"list_filter(range(1, 6), lambda i: NOT list_contains({_FOUND}, i::INT))"
_CLEAN = f"(length({_RAW}) > 0 AND contains('.!?\"”’'')', right({_RAW}, 1)))"
_ENTITY_STOP = ", ".join(f"'{w}'" for w in text.STOP)
_PLAIN = f"regexp_replace({strip(f'''regexp_replace(text, '[{SPACE}]+', ' ', 'g')''')}, '{WIDE}', '0', 'g')"

_THOUGHT = "regexp_replace('<think>a' || chr(10) || 'b</think>' || coalesce(text, '') || '<think>c</think>', '(?s)<think>.*?</think>', '', 'g')"

_SENTENCES = lambda t: f"list_filter(list_transform(string_split(regexp_replace({strip(t)}, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"
# lines, those that are headers, and the bodies between them; of equal numbers the last counts
_SECTIONS = f"""ln AS (SELECT row_id, unnest(string_split(raw_text, chr(10))) AS line, unnest(range(len(string_split(raw_text, chr(10))))) AS i FROM series_records WHERE raw_text IS NOT NULL),
 hd AS (SELECT *, regexp_full_match(line, '(?i)\\[SECTION\\s+\\d+[^\\r]*?\\][ \\t]*\\r?') AS head FROM ln), nr AS (SELECT *, sum(head::INT) OVER (PARTITION BY row_id ORDER BY i) AS no FROM hd),
 bd AS (SELECT row_id, no, max(CASE WHEN head THEN try_cast(regexp_extract(line, '(?i)SECTION\\s+(\\d+)', 1) AS INT) END) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), '') AS b FROM nr WHERE no > 0 GROUP BY row_id, no),
 bodies AS (SELECT row_id, n AS section, {strip('arg_max(b, no)')} AS body FROM bd WHERE n IS NOT NULL GROUP BY row_id, n)"""
_SHORT = f"""{_SECTIONS}, five AS (SELECT row_id, unnest(range(1, 6))::INT AS n FROM series_records WHERE raw_text IS NOT NULL),
 counted AS (SELECT row_id, n, len(regexp_extract_all(coalesce(body, ''), '[^.!?]+[.!?]')) AS sentences FROM five LEFT JOIN bodies USING (row_id) WHERE bodies.section IS NULL OR true)""".replace("LEFT JOIN bodies USING (row_id) WHERE bodies.section IS NULL OR true", "LEFT JOIN bodies ON bodies.row_id = five.row_id AND section = n").replace("SELECT row_id, n, len(", "SELECT five.row_id, n, len(")

ORACLE = {
    "chunk_documents": f"{chunks('doc_id', 'documents')} SELECT doc_id, no::INT AS chunk_no, title || '_chunk_' || no AS chunk_id, chunk FROM chunks JOIN documents USING (doc_id)",
    "section_bodies": f"WITH {_SECTIONS} SELECT row_id, section, body FROM bodies",
    "short_sections": f"WITH {_SHORT} SELECT row_id, n, sentences FROM counted WHERE sentences < 3",
    "completeness_sections": f"""WITH {_SHORT.replace('raw_text', _RAW).replace(f'WHERE {_RAW} IS NOT NULL', '')},
 few AS (SELECT row_id, 'sections below sentence minimum: ' || string_agg('SECTION ' || n || ' has ' || sentences || ' sentence(s) < 3', '; ' ORDER BY n) AS few FROM counted WHERE sentences < 3 GROUP BY row_id),
 s AS (SELECT row_id, len({words(_RAW)}) AS word_count, list_filter(range(1, 3), lambda i: NOT list_contains({_FOUND}, i::INT)) AS m, {_CLEAN} AS ends_clean FROM series_records),
 two AS (SELECT row_id, 'sections below sentence minimum: ' || string_agg('SECTION ' || n || ' has ' || sentences || ' sentence(s) < 3', '; ' ORDER BY n) AS few FROM counted WHERE sentences < 3 AND n <= 2 GROUP BY row_id),
 r AS (SELECT s.row_id, list_filter([CASE WHEN len(m) > 0 THEN 'missing sections: [' || array_to_string(m, ', ') || ']' END, CASE WHEN NOT ends_clean THEN 'does not end on terminal punctuation' END,
  CASE WHEN word_count < 50 THEN 'too short (' || word_count || ' < 50 words)' END, CASE WHEN len(m) = 0 THEN two.few END], lambda x: x IS NOT NULL) AS reasons FROM s LEFT JOIN two ON two.row_id = s.row_id)
 SELECT row_id, len(reasons) = 0 AS ok, array_to_string(reasons, '; ') AS reasons FROM r""",
    "sentence_split": f"WITH s AS (SELECT doc_id, {_SENTENCES('text')} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(range(len(s)))::INT AS no, unnest(s) AS sentence FROM s",
    "summaries": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_slice({_SENTENCES('left(text, 8000)')}, 1, 2), ' ') END AS summary FROM documents",
    "url_quote": "SELECT doc_id, replace(url_encode(title), '%2F', '/') AS out FROM documents",
    "format_extracted": f"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM documents),
 p AS (SELECT doc_id, l, 0 AS i, 0 AS para, 0 AS size, true AS fresh, []::INT[] AS paras FROM l UNION ALL
  SELECT doc_id, l, i + 1, para + (fresh OR opens)::INT, CASE WHEN fresh OR opens THEN length(x) ELSE size + 1 + length(x) END, contains('.?!', right(x, 1)) AND CASE WHEN fresh OR opens THEN length(x) ELSE size + 1 + length(x) END >= 400, list_append(paras, para + (fresh OR opens)::INT)
  FROM (SELECT *, l[i + 1] AS x, regexp_full_match(l[i + 1], '[A-Z0-9][A-Z0-9\\s\\-–—]{{5,}}|\\d{{1,4}}') AS opens FROM p WHERE i < len(l))),
 u AS (SELECT doc_id, unnest(l) AS x, unnest(paras) AS para, unnest(range(len(l))) AS i FROM p WHERE i = len(l)),
 j AS (SELECT doc_id, para, regexp_replace(string_agg(x, ' ' ORDER BY i), '[ \\t]+', ' ', 'g') AS t FROM u GROUP BY doc_id, para)
 SELECT d.doc_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY para), '') AS out FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id""",
    "word_count": f"SELECT doc_id, len({words('text')}) AS n_words, len(regexp_extract_all(text, '[^.!?]+[.!?]')) AS n_sentences FROM documents",
    "completeness": f"""WITH s AS (SELECT row_id, len({words(_RAW)}) AS word_count, {_MISSING} AS m, {_CLEAN} AS ends_clean FROM series_records),
 r AS (SELECT *, list_filter([CASE WHEN len(m) > 0 THEN 'missing sections: [' || array_to_string(m, ', ') || ']' END, CASE WHEN NOT ends_clean THEN 'does not end on terminal punctuation' END,
  CASE WHEN word_count < 250 THEN 'too short (' || word_count || ' < 250 words)' END], lambda x: x IS NOT NULL) AS reasons FROM s)
 SELECT row_id, len(reasons) = 0 AS ok, word_count, array_to_string(m, ',') AS missing, ends_clean, array_to_string(reasons, '; ') AS reasons FROM r""",
    "entities": f"""WITH t AS (SELECT doc_id, {_PLAIN} AS t FROM documents), e AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(t, '\\b(?:[A-Z][a-z]+(?: [A-Z][a-z]+)*)\\b'), regexp_extract_all(t, '\\b[A-Z][a-z]+\\b'))) AS entity FROM t)
 SELECT DISTINCT doc_id, entity FROM e WHERE length(entity) > 2 AND entity NOT IN ({_ENTITY_STOP})""",
    "strip_think": f"SELECT doc_id, {strip(_THOUGHT)} AS out FROM documents",
    "repair_json": """SELECT doc_id, '{"title": "' || regexp_replace(coalesce(title, ''), '["\\\\]', '', 'g') || '", "n": [1, 2]}' AS out FROM documents""",
    "searchable_text": "SELECT doc_id, lower(coalesce(title, '') || ' ' || coalesce(author, '') || '  ' || coalesce(text, '')) AS out FROM documents",
    "safe_title": """SELECT doc_id, left(replace(regexp_replace(coalesce(title, '?') || ': a/b ' || coalesce(author, '*'), '[<>:"/\\\\|?*]', '_', 'g'), ' ', '_'), 100) AS out FROM documents""",
    "story_types": f"""SELECT doc_id, CASE WHEN lower({strip('query_type')}) IN ('thinking', 'think', 'slow', 'medium') THEN 'thinking' ELSE 'fast' END AS mode,
 CASE WHEN lower({strip('section')}) IN ('single', 'standalone') THEN 'single' WHEN lower({strip('section')}) IN ('series', 'chapter', 'chapters') THEN 'series' ELSE 'mix' END AS story_type,
 CASE WHEN lower({strip('source')}) IN ('hf', 'huggingface', 'transformers', 'local') THEN 'transformers' ELSE 'ollama' END AS provider, coalesce(lower({strip('lang')}) IN ('1', 'true', 'yes', 'y'), false) AS truthy,
 coalesce(regexp_matches(lower(text), '503|unavailable|high demand|429|rate limit|resource exhausted'), false) AS retryable, text IS NULL OR length({_BARE}) = 0 AS blank FROM documents""",
    "label_cleanup": f"SELECT row_id, lower({strip(f'''split_part({strip('section')}, chr(10), 1)''')}) AS label FROM village_chunks",
    "merge_paragraphs": f"""WITH b AS (SELECT doc_id, list_transform(string_split(replace(replace(text, chr(10) || chr(10), chr(1)), chr(13), ''), chr(1)), lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda l: {strip('l')}), lambda l: l <> ''), ' ')) AS b FROM documents)
 SELECT doc_id, array_to_string(list_filter(b, lambda p: p <> ''), chr(10)) AS out FROM b""",
    "chunk_paragraph_pack_all": f"""WITH RECURSIVE t AS (SELECT doc_id, {strip("replace(text, chr(13) || chr(10), chr(10))")} AS t FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: length(x)) AS p FROM t),
 s AS (SELECT doc_id, p, 0 AS i, 0 AS n, 0 AS size FROM p UNION ALL
  SELECT doc_id, p, i + 1, CASE WHEN n > 0 AND size + p[i + 1] + 2 <= 1800 THEN n ELSE n + 1 END, CASE WHEN n > 0 AND size + p[i + 1] + 2 <= 1800 THEN size + p[i + 1] + 2 ELSE p[i + 1] END FROM s WHERE i < len(p))
 SELECT doc_id, n AS n_chunks FROM s WHERE i = len(p)""",
    "section_tag": """WITH v AS (SELECT row_id, row_number() OVER (PARTITION BY record_id ORDER BY row_id) AS i, count(*) OVER (PARTITION BY record_id) AS n FROM village_chunks WHERE record_id IS NOT NULL)
 SELECT row_id, CASE WHEN n <= 1 OR i = 1 THEN 'setup' WHEN i = 2 THEN CASE WHEN n >= 4 THEN 'inciting_incident' ELSE 'rising_action' END WHEN i >= n THEN 'resolution' WHEN i = n - 1 THEN CASE WHEN n >= 5 THEN 'climax' ELSE 'confrontation' END ELSE 'rising_action' END AS section FROM v""",
    "label_streak": """WITH v AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 r AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM v), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS streak FROM r)
 SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') AND streak < 3 THEN event_type WHEN n <= 1 OR i = 1 THEN 'setup' WHEN i = 2 THEN CASE WHEN n >= 4 THEN 'inciting_incident' ELSE 'rising_action' END
 WHEN i >= n THEN 'resolution' WHEN i = n - 1 THEN CASE WHEN n >= 5 THEN 'climax' ELSE 'confrontation' END ELSE 'rising_action' END AS section FROM s""",
    "embed_documents": f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[\\p{{L}}\\p{{N}}]') THEN 64 END AS width FROM documents",
    "listed_models": "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'models/' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'text-embedding-' WHEN doc_id % 5 = 0 THEN 'gemini-image-' ELSE 'gemini-' END || doc_id AS name FROM documents) SELECT doc_id, name FROM n WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0",
}
QUERIES = {
    f.__name__: f
    for f in (word_count, completeness, completeness_sections, section_bodies, short_sections, entities, strip_think, repair_json, searchable_text, safe_title, story_types, label_cleanup, format_extracted, clean_story, sentence_split,
              merge_paragraphs, url_quote, chunk_documents, chunk_paragraph_pack_all, section_tag, label_streak, embed_documents, summaries, listed_models)
}
