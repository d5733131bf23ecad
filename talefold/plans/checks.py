"""Queries: facts, gates, rubrics, decisions, the loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talefold.config import EngineConfig
from talefold.models import embed
from talefold.operators import evaluate, facts
from talefold.plans import loop, texts
from talefold.session import stage


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r'["\\]', "")


def _facts(spark, sf) -> DataFrame:
    """Answers of a fact extractor, one for each document: fenced, with trailing commas, sources as list or text, some without."""
    n = F.col("doc_id").cast("string")
    raw = F.concat(
        F.when(F.col("doc_id") % 2 == 0, "```json\n").otherwise("Here: "), F.lit('{"facts": [{"type": "who", "fact": "'), _plain(F.col("title")), F.lit('", "source_chunk_ids": ["c'), n, F.lit('", "c0"], "quote": "q'), n, F.lit('"}, '),
        F.lit('{"type": "event", "fact": "Written by '), _plain(F.col("author")), F.lit('", "sources": "s'), (F.col("doc_id") % 7).cast("string"), F.lit('",}, {"fact": "Nobody said this", "source_chunk_ids": []}, {"fact": " ", "sources": "x"}, ]}'),
        F.when(F.col("doc_id") % 2 == 0, "\n```").otherwise(" done"),
    )
    return _table(spark, sf, "documents").select("doc_id", "title", "author", facts.parse_facts(raw).alias("facts"))


def facts_parse(spark, sf):
    f = _facts(spark, sf).select("doc_id", F.explode("facts").alias("f"))
    return f.select("doc_id", "f.fact", "f.type", F.array_join("f.source_chunk_ids", ",").alias("sources"), "f.quote")


def facts_prompt(spark, sf):
    return _facts(spark, sf).select("doc_id", facts.prompt_lines(F.col("facts")).alias("prompt"))


def facts_sources(spark, sf):
    return _facts(spark, sf).select("doc_id", F.array_join(facts.source_ids(F.col("facts")), ",").alias("ids"))


def facts_cited(spark, sf):
    """Facts whose source is among the chunks there are: s0 to s3."""
    rows = _facts(spark, sf).select("doc_id", F.explode("facts").alias("f")).select("doc_id", "f.fact", F.explode("f.source_chunk_ids").alias("source"))
    return facts.cited(rows, spark.createDataFrame([(f"s{i}",) for i in range(4)], "chunk_id string"))


def reformulate_query(spark, sf):
    return _facts(spark, sf).select("doc_id", facts.reformulated(F.lit("what happened"), F.col("facts")).alias("query"))


def attribution_violations(spark, sf):
    """Names in a document that its own title and author don't give."""
    known = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")))
    return _table(spark, sf, "documents").select("doc_id", F.explode(facts.violations(F.col("text"), known)).alias("entity"))


def attribution_gate(spark, sf):
    known = F.coalesce("title", F.lit(""))
    g = _table(spark, sf, "documents").where("text is not null").select("doc_id", facts.gate(F.col("text"), known, True, 8)["found"].alias("found"), facts.gate(F.col("text"), known, True, 8)["novel"].alias("novel"))
    return g.withColumn("ratio", F.round(F.col("novel") / F.greatest("found", F.lit(1)), 6))


def gated_story(spark, sf):
    return _table(spark, sf, "documents").where("text is not null").select("doc_id", F.length(facts.gate(F.col("text"), F.col("title"), True, 8)["story"]).alias("n"))


def _rubric(spark, sf) -> DataFrame:
    """Evaluations as a model writes them; numbers and objects mixed, booleans and texts among them."""
    d = _table(spark, sf, "documents")
    a, b = (F.col("doc_id") % 10).cast("string"), (F.col("doc_id") % 7).cast("string")
    flat = F.concat(F.lit('{"clarity": '), a, F.lit(', "faithfulness": {"score": '), b, F.lit(', "feedback": "f"}, "ok": true, "conclusion": "good", "suggestions": ["more", " "]}'))
    nested = F.concat(F.lit('Sure!\n{"scores": {"clarity": {"score": '), a, F.lit('}, "faithfulness": '), b, F.lit('}, "model": 9} bye'))
    given = F.concat(F.lit('```json\n{"average_score": '), a, F.lit(', "clarity": 4}\n```'))
    raw = F.when(F.col("doc_id") % 4 == 0, flat).when(F.col("doc_id") % 4 == 1, nested).when(F.col("doc_id") % 4 == 2, given).otherwise("no json {at all")
    return d.select("doc_id", evaluate.parse_evaluation(raw).alias("e"))


def rubric_average(spark, sf):
    return _rubric(spark, sf).select("doc_id", F.when(F.col("e").isNull(), 0.0).otherwise(evaluate.average(F.col("e"))).alias("avg"))


def criterion_score(spark, sf):
    return _rubric(spark, sf).select("doc_id", evaluate.criterion(F.col("e"), "faithfulness").alias("faithfulness"), evaluate.criterion(F.col("e"), "clarity").alias("clarity"))


def feedback_text(spark, sf):
    e = F.col("e")
    return _rubric(spark, sf).select("doc_id", evaluate.feedback(F.try_variant_get(e, "$.conclusion", "string"), F.try_variant_get(e, "$.suggestions", "array<string>"), F.col("doc_id") % 3 == 0, F.array(F.lit("too short"), F.lit("open end"))).alias("feedback"))


def decide_action(spark, sf):
    d = F.col("doc_id")
    action = evaluate.decision(d % 5 != 0, (d % 10).cast("double"), F.when(d % 11 != 0, (d % 9).cast("double")), d % 2 == 0, (d % 7).cast("int"))
    return _table(spark, sf, "documents").select("doc_id", action.alias("action"))


def best_candidate(spark, sf):
    """Of each user's events, seen as drafts of one run, the best."""
    e = _table(spark, sf, "events")
    rows = e.select("user_id", F.col("event_id").alias("iteration"), F.when(F.col("event_type") == "purchase", "accept").otherwise("refine").alias("action"), (F.col("event_id") % 2 == 0).alias("complete"), F.round("value", 0).alias("avg"), F.col("event_type").alias("story"))
    return evaluate.best_candidates(rows, "user_id")


def _loop_inputs(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", "title")
    corpus = stage(docs.withColumn("embedding", embed(F.col("text"))).where("embedding is not null"), "loop-corpus")  # embedded once, as a collection stores it
    return corpus, _table(spark, sf, "retrieval_cases").select(F.col("item_id").alias("query_id"), "query")


def agentic_loop_trace(spark, sf):
    out = loop.agentic(*_loop_inputs(spark, sf), EngineConfig(min_words=40, min_sentences=1))
    return out.iterations.select("query_id", "iteration", "action", F.round("avg", 2).alias("avg"), "complete", "n_facts")


def three_step_answers(spark, sf):
    return loop.three_steps(*_loop_inputs(spark, sf)).select("query_id", F.size("facts").alias("n_facts"), "story")


def stage_events(spark, sf):
    return spark.createDataFrame(loop.stage_events(), "seq int, step string, status string")


_T = "regexp_replace(coalesce(title, ''), '[\"\\\\]', '', 'g')"
_A = "regexp_replace(coalesce(author, ''), '[\"\\\\]', '', 'g')"
_F = f"""f AS (SELECT doc_id, 1 AS k, regexp_replace({_T}, '^\\s+|\\s+$', '', 'g') AS fact, 'who' AS type, ['c' || doc_id, 'c0'] AS src, 'q' || doc_id AS quote FROM documents WHERE trim({_T}) <> ''
 UNION ALL SELECT doc_id, 2, regexp_replace('Written by ' || {_A}, '^\\s+|\\s+$', '', 'g'), 'event', ['s' || (doc_id % 7)], '' FROM documents)"""


def _names(text: str) -> str:
    """Distinct (doc_id, entity) of a text column of documents."""
    plain = texts._PLAIN.replace("(text,", f"({text},")
    return f"""(WITH t AS (SELECT doc_id, {plain} AS t FROM documents), e AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(t, '\\b(?:[A-Z][a-z]+(?: [A-Z][a-z]+)*)\\b'), regexp_extract_all(t, '\\b[A-Z][a-z]+\\b'))) AS entity FROM t)
 SELECT DISTINCT doc_id, entity FROM e WHERE length(entity) > 2 AND entity NOT IN ({texts._ENTITY_STOP}))"""


_DECIDE = """CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'accept' WHEN doc_id % 7 <= 0 THEN 're_retrieve' ELSE 'refine' END WHEN doc_id % 11 <> 0 AND doc_id % 9 < 6 THEN 're_retrieve' WHEN doc_id % 7 <= 0 THEN 're_retrieve'
 WHEN doc_id % 10 >= 7 AND doc_id % 2 = 0 THEN 'accept' WHEN doc_id % 2 <> 0 THEN 'refine' WHEN doc_id % 7 < 3 THEN 're_retrieve' ELSE 'refine' END"""
_KEEP = "'Keep every section, finish the final sentence, and stay strictly grounded in the facts.'"
_TERMS = f"""WITH {_F}, t AS (SELECT doc_id, k, unnest(list_filter(regexp_extract_all(fact, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{2,}}'))) AS t, unnest(range(len(list_filter(regexp_extract_all(fact, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{2,}}'))))) AS i FROM f),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY k, i) AS nth FROM t), five AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS place FROM o WHERE nth = 1)"""
ORACLE = {
    "reformulate_query": f"{_TERMS} SELECT doc_id, 'what happened' || coalesce(' ' || string_agg(t, ' ' ORDER BY place), '') AS query FROM documents LEFT JOIN (SELECT * FROM five WHERE place <= 5) USING (doc_id) GROUP BY doc_id",
    "gated_story": f"""WITH s AS {_names('text')}, a AS {_names("coalesce(title, '')")}, c AS (SELECT s.doc_id, count(*) AS found, count(*) FILTER (a.entity IS NULL) AS novel FROM s LEFT JOIN a USING (doc_id, entity) GROUP BY 1)
 SELECT doc_id, length(CASE WHEN novel > 0 AND (novel > 8 OR novel / found::DOUBLE > 0.6) THEN array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {texts.strip('p')}), lambda p: p <> ''), 1, 6), chr(10) || chr(10)) ELSE text END)::INT AS n FROM documents LEFT JOIN c USING (doc_id) WHERE text IS NOT NULL""",
    "facts_parse": f"WITH {_F} SELECT doc_id, fact, type, array_to_string(src, ',') AS sources, quote FROM f",
    "facts_prompt": f"""WITH {_F}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM f)
 SELECT doc_id, string_agg(i || '. [' || type || '] ' || fact || CASE WHEN quote <> '' THEN ' ("' || quote || '")' ELSE '' END || '  (source: ' || array_to_string(src, ', ') || ')', chr(10) ORDER BY k) AS prompt FROM n GROUP BY doc_id""",
    "facts_sources": f"WITH {_F}, s AS (SELECT DISTINCT doc_id, unnest(src) AS s FROM f) SELECT doc_id, string_agg(s, ',' ORDER BY s) AS ids FROM s GROUP BY doc_id",
    "facts_cited": f"WITH {_F}, s AS (SELECT doc_id, fact, unnest(src) AS source FROM f) SELECT source, doc_id, fact FROM s WHERE source IN ('s0', 's1', 's2', 's3')",
    "attribution_violations": f"""SELECT s.doc_id, s.entity FROM {_names('text')} s ANTI JOIN {_names("(coalesce(title, '') || ' ' || coalesce(author, ''))")} a USING (doc_id, entity)""",
    "attribution_gate": f"""WITH s AS {_names('text')}, a AS {_names("coalesce(title, '')")}, c AS (SELECT s.doc_id, count(*) AS found, count(*) FILTER (a.entity IS NULL) AS novel FROM s LEFT JOIN a USING (doc_id, entity) GROUP BY 1)
 SELECT doc_id, coalesce(found, 0) AS found, coalesce(novel, 0) AS novel, round(coalesce(novel, 0)::DOUBLE / greatest(coalesce(found, 0), 1), 6) AS ratio FROM documents LEFT JOIN c USING (doc_id) WHERE text IS NOT NULL""",
    "rubric_average": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN round(((doc_id % 10) + (doc_id % 7)) / 2.0::DOUBLE, 2) WHEN 1 THEN round(((doc_id % 10) + (doc_id % 7)) / 2.0::DOUBLE, 2)
 WHEN 2 THEN CASE WHEN doc_id % 10 <> 0 THEN (doc_id % 10)::DOUBLE ELSE 4.0::DOUBLE END ELSE 0.0::DOUBLE END AS avg FROM documents""",
    "criterion_score": "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN (doc_id % 7)::DOUBLE END AS faithfulness, CASE WHEN doc_id % 4 IN (0, 1) THEN (doc_id % 10)::DOUBLE WHEN doc_id % 4 = 2 THEN 4.0::DOUBLE END AS clarity FROM documents",
    "feedback_text": f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'Reviewer conclusion: good' END, CASE WHEN doc_id % 4 = 0 THEN '- more' END, CASE WHEN doc_id % 3 <> 0 THEN 'Completeness issues to fix: too short; open end' END, {_KEEP}], lambda x: x IS NOT NULL), chr(10)) AS feedback FROM documents""",
    "decide_action": f"SELECT doc_id, {_DECIDE} AS action FROM documents",
    "best_candidate": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END, round(value, 0) DESC, event_id) AS k FROM events)
 SELECT user_id, event_id AS iteration, event_type AS story FROM r WHERE k = 1""",
    "stage_events": "SELECT * FROM (VALUES (0, 'retrieve', 'start'), (1, 'retrieve', 'done'), (2, 'extract', 'start'), (3, 'extract', 'done'), (4, 'generate', 'start'), (5, 'generate', 'done'), (6, 'end', 'done')) t(seq, step, status)",
}
QUERIES = {
    f.__name__: f
    for f in (facts_parse, facts_prompt, facts_sources, facts_cited, reformulate_query, attribution_violations, attribution_gate, gated_story, rubric_average, criterion_score, feedback_text, decide_action, best_candidate, agentic_loop_trace,
              three_step_answers, stage_events)
}
