"""Queries: search, fusion, selection, evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talefold.operators import evaluate, retrieve
from talefold.plans.sql import bm25, strip, words

POOL = 24


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have a vector and a text; a vector belongs to the document of its number."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return _table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", "title").join(e, "id")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every vector whose number is divisible by 100, with its document's title as words."""
    e = _table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("query")).join(e, "query_id")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round(F.greatest("distance", F.lit(0.0)), 6).alias("distance"), "rank")


def dense_topk(spark, sf):
    return _shown(retrieve.dense_topk(_table(spark, sf, "embeddings"), _vectors(spark, sf), 10))


def dense_topk_filtered(spark, sf):
    return _shown(retrieve.dense_topk(_table(spark, sf, "embeddings"), _vectors(spark, sf), 10, {"label": 3}))


def bm25_topk(spark, sf):
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = _table(spark, sf, "retrieval_cases").select(F.col("item_id").alias("query_id"), "query")
    best = retrieve.ranked(retrieve.bm25(docs, asked), [F.desc(F.round("score", 9)), F.col("id")]).where("rank <= 10")
    return best.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _pool(spark, sf) -> DataFrame:
    return retrieve.candidate_pool(_corpus(spark, sf), _queries(spark, sf), POOL)


def _lexical(pool: DataFrame, queries: DataFrame) -> DataFrame:
    return retrieve.bm25_pools(pool, queries).withColumnRenamed("rank", "dense").withColumnRenamed("lexical_rank", "rank")


def bm25_pool_rank(spark, sf):
    return _lexical(_pool(spark, sf), _queries(spark, sf)).select("query_id", "id", F.round("score", 6).alias("score"), "dense", "rank")


def rrf_fuse(spark, sf):
    pool = _pool(spark, sf)
    return retrieve.rrf(pool, _lexical(pool, _queries(spark, sf))).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


def rrf_fuse_missing_rank(spark, sf):
    """The lexical list holds only the better half of the pool."""
    pool = _pool(spark, sf)
    return retrieve.rrf(pool, _lexical(pool, _queries(spark, sf)).where(F.col("rank") <= POOL // 2)).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


def diverse_select(spark, sf):
    return retrieve.diverse(_pool(spark, sf), 3, 2).select("query_id", "id", "title", "pick")


def diverse_select_fill(spark, sf):
    """More picks than titles can give: the rest fills up in rank order."""
    return retrieve.diverse(_pool(spark, sf), 10, 2).select("query_id", "id", "pick")


def hybrid_retrieve(spark, sf):
    return retrieve.hybrid(_corpus(spark, sf), _queries(spark, sf), POOL).select("query_id", "pick", "id", "title", "score")


def hybrid_rerank(spark, sf):
    """Composed retrieval whose picks a pair scorer orders again; the first four stay."""
    out = retrieve.hybrid(_corpus(spark, sf), _queries(spark, sf), POOL, top_n=4, pair_score=retrieve.overlap_score)
    return out.select("query_id", "pick", "id", "title")


def dense_topk_where(spark, sf):
    """A filter of several comparisons."""
    where = {"$or": [{"label": {"$in": [1, 2]}}, {"$and": [{"label": {"$gte": 7}}, {"vec_id": {"$lt": 500}}]}], "label": {"$ne": 2}}
    return _shown(retrieve.dense_topk(_table(spark, sf, "embeddings"), _vectors(spark, sf), 10, where))


def rerank_topn(spark, sf):
    hits = _pool(spark, sf).join(_queries(spark, sf).select("query_id", "query"), "query_id")
    score = retrieve.overlap_score(F.col("query"), F.col("text"))
    return retrieve.rerank(hits, 5, score).select("query_id", "id", F.round(score, 6).alias("score"), "rank_after")


def context_string(spark, sf):
    return retrieve.context(_pool(spark, sf), "rank")


def _case_hits(spark, sf) -> tuple[DataFrame, DataFrame]:
    cases = _table(spark, sf, "retrieval_cases")
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "title", "author", F.lit("").alias("summary"), "text")
    best = retrieve.ranked(retrieve.bm25(docs, cases.select(F.col("item_id").alias("query_id"), "query")), [F.desc(F.round("score", 9)), F.col("id")]).where("rank <= 10")
    return best.withColumnRenamed("query_id", "item_id").join(docs, "id"), cases


def retrieval_case_eval(spark, sf):
    return evaluate.case_results(*_case_hits(spark, sf), 3).withColumn("fact_coverage", F.round("fact_coverage", 6))


def retrieval_summary(spark, sf):
    s = evaluate.summary(evaluate.case_results(*_case_hits(spark, sf), 3))
    return s.select("total", *[F.round(c, 6).alias(c) for c in ("top1_accuracy", "topk_accuracy", "fact_coverage")])


_DISTANCE = "1 - list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv) * list_dot_product(v, v))"


def _dense(where: str = "true") -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
 d AS (SELECT query_id, id, {_DISTANCE} AS distance FROM q, (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE {where})),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM d)
SELECT query_id, id, round(greatest(distance, 0), 6) AS distance, rank FROM r WHERE rank <= 10"""


_POOL = f"""
 q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, coalesce(title, '') AS query FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0),
 c AS (SELECT doc_id AS id, text, title, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id WHERE text IS NOT NULL),
 d AS (SELECT query_id, query, id, text, title, {_DISTANCE} AS distance FROM q, c),
 pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM d) WHERE rank <= {POOL})"""
_LEXICAL = f"""{_POOL},
 docs AS (SELECT query_id, id, {words('lower(text)')} AS w FROM pool),{bm25('query_id')},
 lex AS (SELECT pool.query_id, pool.id, text, rank AS dense, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY pool.query_id ORDER BY round(coalesce(score, 0), 9) DESC, rank) AS lrank
   FROM pool LEFT JOIN scores ON scores.query_id = pool.query_id AND scores.id = pool.id)"""


def _fused(where: str = "true") -> str:
    return f"""{_LEXICAL},
 lists AS (SELECT query_id, id, text, rank, 0 AS list FROM pool UNION ALL SELECT query_id, id, text, lrank, 1 FROM lex WHERE {where}),
 texts AS (SELECT query_id, text, arg_min(id, list * 1000 + rank) AS id, min(list * 1000 + rank) AS first, max(rank) FILTER (list = 0) AS dr, max(rank) FILTER (list = 1) AS lr FROM lists GROUP BY ALL),
 filled AS (SELECT *, count(*) OVER (PARTITION BY query_id) + 60 AS absent FROM texts),
 scored AS (SELECT *, 0.7::DOUBLE / (coalesce(dr, absent) + 60) + 0.3::DOUBLE / (coalesce(lr, absent) + 60) AS score FROM filled),
 fused AS (SELECT query_id, id, text, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM scored)"""


def _diverse(hits: str, n: int, c: int) -> str:
    return f"""
 seen AS (SELECT *, min(rank) OVER (PARTITION BY query_id, title) AS best, row_number() OVER (PARTITION BY query_id, title ORDER BY rank) AS in_title FROM {hits}),
 placed AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best) AS title_no FROM seen),
 chosen AS (SELECT *, title_no <= {n} AND in_title <= {c} AS main FROM placed),
 picks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN main THEN 0 ELSE 1 END, CASE WHEN main THEN title_no END NULLS FIRST, CASE WHEN main THEN in_title END NULLS FIRST, rank) AS pick FROM chosen)"""


_CASE_HITS = f"""
 q AS (SELECT item_id AS query_id, query FROM retrieval_cases),
 docs AS (SELECT doc_id AS id, coalesce({words('lower(text)')}, []) AS w FROM documents),{bm25('')},
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scores) WHERE rank <= 10)"""
_CASES = f"""{_CASE_HITS},
 hits AS (SELECT query_id AS item_id, rank, title, lower(concat_ws(' ', coalesce(title, ''), coalesce(author, ''), '', coalesce(text, ''))) AS t FROM best JOIN documents ON doc_id = id),
 found AS (SELECT item_id, min(rank) FILTER (lower({strip('title')}) = lower({strip('expected_title')})) AS title_rank, string_agg(t, chr(10) ORDER BY rank) FILTER (rank <= 3) AS top FROM hits JOIN retrieval_cases USING (item_id) GROUP BY ALL),
 results AS (SELECT item_id, title_rank, coalesce(title_rank = 1, false) AS top1_match, coalesce(title_rank <= 3, false) AS topk_match,
   len(list_filter(coalesce(expected_facts, []), lambda f: coalesce(contains(top, lower(f)), false)))::DOUBLE / nullif(len(coalesce(expected_facts, [])), 0) AS fact_coverage
   FROM retrieval_cases LEFT JOIN found USING (item_id))"""
_TITLE = "coalesce(nullif(title, ''), 'Unknown')"

ORACLE = {
    "dense_topk": _dense(),
    "dense_topk_filtered": _dense("label = 3"),
    "bm25_topk": f"WITH {_CASE_HITS} SELECT query_id, id, round(score, 6) AS score, rank FROM best",
    "bm25_pool_rank": f"WITH {_LEXICAL} SELECT query_id, id, round(score, 6) AS score, dense, lrank AS rank FROM lex",
    "rrf_fuse": f"WITH {_fused()} SELECT query_id, id, round(score, 9) AS score, rank FROM fused",
    "rrf_fuse_missing_rank": f"WITH {_fused(f'lrank <= {POOL // 2}')} SELECT query_id, id, round(score, 9) AS score, rank FROM fused",
    "diverse_select": f"WITH {_POOL}, {_diverse('pool', 3, 2)} SELECT query_id, id, title, pick FROM picks WHERE pick <= 6",
    "diverse_select_fill": f"WITH {_POOL}, {_diverse('pool', 10, 2)} SELECT query_id, id, pick FROM picks WHERE pick <= 20",
    "hybrid_retrieve": f"WITH {_fused()}, titled AS (SELECT fused.*, title FROM fused JOIN c USING (id)), {_diverse('titled', 3, 2)} SELECT query_id, pick, id, title, round(score, 9) AS score FROM picks WHERE pick <= 6",
    "rerank_topn": f"""WITH {_POOL}, s AS (SELECT *, len(list_intersect(list_distinct({words('lower(query)')}), list_distinct({words('lower(text)')})))::DOUBLE / greatest(len(list_distinct({words('lower(query)')})), 1) AS score FROM pool),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS rank_after FROM s) SELECT query_id, id, round(score, 6) AS score, rank_after FROM r WHERE rank_after <= 5""",
    "dense_topk_where": _dense("(label IN (1, 2) OR (label >= 7 AND vec_id < 500)) AND label <> 2"),
    "hybrid_rerank": f"""WITH {_fused()}, titled AS (SELECT fused.*, title FROM fused JOIN c USING (id)), {_diverse('titled', 3, 2)},
 s AS (SELECT picks.*, len(list_intersect(list_distinct({words('lower(query)')}), list_distinct({words('lower(text)')})))::DOUBLE / greatest(len(list_distinct({words('lower(query)')})), 1) AS pair FROM picks JOIN q USING (query_id) WHERE pick <= 6),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(pair, 9) DESC, pick) AS after FROM s) SELECT query_id, after AS pick, id, title FROM r WHERE after <= 4""",
    "context_string": f"WITH {_POOL} SELECT query_id, string_agg('[' || {_TITLE} || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, string_agg('[CHUNK ' || id || ' | ' || {_TITLE} || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS prompt FROM pool GROUP BY query_id",
    "retrieval_case_eval": f"WITH {_CASES} SELECT item_id, title_rank, top1_match, topk_match, round(fact_coverage, 6) AS fact_coverage FROM results",
    "retrieval_summary": f"WITH {_CASES} SELECT count(*) AS total, round(coalesce(avg(top1_match::INT), 0), 6) AS top1_accuracy, round(coalesce(avg(topk_match::INT), 0), 6) AS topk_accuracy, round(avg(fact_coverage), 6) AS fact_coverage FROM results",
}
QUERIES = {f.__name__: f for f in (dense_topk, dense_topk_filtered, dense_topk_where, bm25_topk, bm25_pool_rank, rrf_fuse, rrf_fuse_missing_rank, diverse_select, diverse_select_fill, hybrid_retrieve, hybrid_rerank, rerank_topn, context_string, retrieval_case_eval, retrieval_summary)}
