"""Batch retrieval: exact dense top-k, BM25, reciprocal-rank fusion, diversity selection, reranking.

All operators take many queries at once. Every ranking has a total order:
scores rounded to 9 digits, then the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talefold.functions.text import words
from talefold.session import stage

#: Query vectors that one scan of the corpus compares at once; their size is what is broadcast.
QUERY_BLOCK = 4096
#: BM25 parameters, and the share of the mean idf that stands in for a negative one.
K1, B, IDF_FLOOR = 1.5, 0.75, 0.25


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors, in doubles; null where one is null or zero, an error where the sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    same = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))
    return 1 - same / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


#: Comparisons of a metadata filter.
_COMPARE = {
    "$eq": lambda c, v: c.isNull() if v is None else c == F.lit(v),
    "$ne": lambda c, v: c.isNotNull() if v is None else ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)),
}


def condition(where: dict, column: Callable[[str], Column] = F.col) -> Column:
    """A filter as a column: {name: value} or {name: {comparison: value}}, all of them together; $and and $or take lists of filters.

    `column` says where a name is found. Unknown comparisons are an error. What
    compares with null is false, but for `$ne` and `$nin`.
    """
    parts = []
    for name, wanted in where.items():
        if name in ("$and", "$or"):
            if not wanted:
                raise ValueError(f"{name} needs filters")
            join = (lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, [condition(w, column) for w in wanted]))
            continue
        for how, value in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            if how not in _COMPARE:
                raise ValueError(f"unknown comparison: {how}")
            parts.append(_COMPARE[how](column(name), value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filtered(df: DataFrame, where: dict | None) -> DataFrame:
    """The rows that meet a filter (see condition()) on their columns; pushed down to the scan."""
    return df.where(condition(where)) if where else df


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, where: dict | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, id, distance, rank of the k nearest rows of each query (query_id, query_vector), exact.

    The stated queries are compared with all rows in blocks of QUERY_BLOCK as
    matrix products; each task keeps k rows for each query, so what is shuffled
    is queries times tasks times k rows. Null and zero vectors match nothing;
    vectors of another size are an error.
    """
    spark = corpus.sparkSession
    rows = filtered(corpus, where).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    found = None
    for ids, matrix in _query_blocks(queries):
        part = rows.mapInArrow(_nearest(spark.sparkContext.broadcast((ids, matrix)), k), "query_id bigint, id bigint, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id bigint, id bigint, distance double")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vectors = [], []
    for row in queries.select("query_id", "query_vector").where("query_id is not null and query_vector is not null").toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def _nearest(shared, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        unit = matrix / np.maximum(np.sqrt((matrix**2).sum(axis=1, keepdims=True)), 1e-300)
        best_d = np.full((len(ids), 0), np.inf)
        best_i = np.zeros((len(ids), 0), np.int64)
        for part in parts:
            for low in range(0, part.num_rows, 2048):
                piece = part.slice(low, 2048)
                lists = piece.column(1)
                if not len(piece):
                    continue
                flat = np.asarray(lists.flatten(), np.float64)
                if len(flat) != len(piece) * matrix.shape[1]:
                    raise ValueError("vectors of different sizes")
                x = flat.reshape(len(piece), -1)
                size = np.sqrt((x**2).sum(axis=1))
                x, number = x[size > 0] / size[size > 0][:, None], np.asarray(piece.column(0), np.int64)[size > 0]
                d = np.round(1 - unit @ x.T, 12)
                best_d = np.concatenate([best_d, d], axis=1)
                best_i = np.concatenate([best_i, np.broadcast_to(number, d.shape)], axis=1)
                if best_d.shape[1] > k:
                    keep = np.lexsort((best_i, np.round(best_d, 9)), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(best_d, keep, 1), np.take_along_axis(best_i, keep, 1)
        n = best_d.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], ["query_id", "id", "distance"])

    return run


def _terms(text: Column) -> Column:
    return words(F.lower(text))


#: Asked terms up to which their list goes to all tasks; beyond it, documents' words are shuffled to them.
LISTED_TERMS = 100_000


def _asked(queries: DataFrame) -> DataFrame:
    """query_id, term, qf: each term of each query and how often the query has it."""
    return queries.select("query_id", F.explode(_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def _part(tf: Column, n: Column, avgdl: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / avgdl))


def _raw_idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score of documents (id, text) by Okapi BM25 for queries (query_id, query).

    The statistics are those of the whole table. A repeated query term counts
    each time. Null texts are empty; documents without a query term have no row.

    One pass gives document frequencies and, in the row of the null term, number
    and mean size of documents; another counts the asked words of each document.
    Neither shuffles (document, word) pairs beyond what the queries ask for.
    """
    asked = _asked(queries)
    terms = asked.select("term").distinct()
    if terms.limit(LISTED_TERMS + 1).count() <= LISTED_TERMS:
        terms = F.broadcast(terms)
    rows = docs.select("id", _terms(F.coalesce("text", F.lit(""))).alias("w"))
    counted = rows.select(F.size("w").alias("n"), F.explode(F.array_append(F.array_distinct("w"), F.lit(None))).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.avg("n").alias("mean"))
    whole = counted.where("term is null").select(F.col("df").alias("n_docs"), F.col("mean").alias("avgdl"))
    idf = counted.where("term is not null").crossJoin(F.broadcast(whole)).select("term", "avgdl", _raw_idf(F.col("n_docs"), F.col("df")).alias("raw"))
    floor = idf.agg((IDF_FLOOR * F.avg("raw")).alias("floor"))
    weights = idf.join(terms, "term", "left_semi").crossJoin(F.broadcast(floor)).select("term", "avgdl", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    hits = rows.select("id", F.size("w").alias("n"), F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    scored = hits.join(weights, "term").select("id", "term", _part(F.col("tf"), F.col("n"), F.col("avgdl"), F.col("idf")).alias("part"))
    return scored.join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("qf") * F.col("part")).alias("score"))


def bm25_pools(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of each query's pool (query_id, id, text, rank and others) with their BM25 `score` and `lexical_rank`.

    Each query's statistics are those of its own pool. A document without a query
    term scores 0. Equal scores keep the pool's order. The pool is partitioned
    by query once; all counts and ranks are taken within that partitioning.
    """
    asked = _asked(queries).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "qf"))).alias("asked"))
    rows = pool.repartition("query_id").withColumn("w", _terms(F.coalesce("text", F.lit(""))))
    of_query = Window.partitionBy("query_id")
    rows = rows.withColumn("n", F.size("w")).withColumn("n_docs", F.count("*").over(of_query)).withColumn("avgdl", F.avg("n").over(of_query))
    rows = rows.join(asked, "query_id", "left")
    distinct = rows.select("query_id", "id", "n_docs", "avgdl", "n", F.col("asked"), "w", F.explode_outer(F.array_distinct("w")).alias("term"))
    qf = F.coalesce(F.try_element_at("asked", F.col("term")), F.lit(0))
    tf = F.when(qf > 0, F.size(F.filter("w", lambda x: x == F.col("term")))).otherwise(0)
    t = distinct.select("query_id", "id", "n_docs", "avgdl", "n", "term", qf.alias("qf"), tf.alias("tf"))
    t = t.withColumn("df", F.count("term").over(Window.partitionBy("query_id", "term"))).withColumn("raw", F.when(F.col("term").isNotNull(), _raw_idf(F.col("n_docs"), F.col("df"))))
    mean = F.sum(F.col("raw") / F.col("df")).over(of_query) / F.sum(F.when(F.col("term").isNotNull(), 1 / F.col("df"))).over(of_query)
    idf = F.when(F.col("raw") < 0, IDF_FLOOR * mean).otherwise(F.col("raw"))
    t = t.withColumn("idf", idf)
    scores = t.groupBy("query_id", "id").agg(F.coalesce(F.sum(F.when(F.col("qf") > 0, F.col("qf") * _part(F.col("tf"), F.col("n"), F.col("avgdl"), F.col("idf")))), F.lit(0.0)).alias("score"))
    return ranked(pool.join(scores, ["query_id", "id"]), [F.desc(F.round("score", 9)), F.col("rank")], "lexical_rank")


def ranked(scores: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    return scores.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))


def rrf(dense: DataFrame, lexical: DataFrame, weight: float = 0.3, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two lists (query_id, id, text, rank), by text; a title in both lists is carried along.

    Of rows with equal text the first of the dense list (else of the other)
    stands for them, with the last rank each list gives the text. A text that
    one list lacks has, there, the number of fused texts plus k as its rank.
    """
    extra = ["title"] if "title" in dense.columns and "title" in lexical.columns else []
    columns = ["query_id", "id", "text", "rank", *extra]
    both = dense.select(*columns, F.lit(0).alias("list")).unionByName(lexical.select(*columns, F.lit(1).alias("list")))
    # partitioned by query once; texts are told apart by their hash, and by themselves only where hashes agree
    both = both.repartition("query_id").withColumn("hash", F.xxhash64("text"))
    texts = both.groupBy("query_id", "hash", "text").agg(
        F.min(F.struct("list", "rank", "id", *extra)).alias("first"),
        F.max(F.when(F.col("list") == 0, F.col("rank"))).alias("dense_rank"),
        F.max(F.when(F.col("list") == 1, F.col("rank"))).alias("lexical_rank"),
    )
    n = F.count("*").over(Window.partitionBy("query_id"))
    absent = n + k
    dense_rank, lexical_rank = F.coalesce("dense_rank", absent), F.coalesce("lexical_rank", absent)
    score = (1 - weight) / (dense_rank + k) + weight / (lexical_rank + k)
    fused = texts.select("query_id", F.col("first.id").alias("id"), "text", *[F.col(f"first.{c}").alias(c) for c in extra], "dense_rank", "lexical_rank", score.alias("score"), "first")
    order = [F.desc(F.round("score", 12)), F.col("first.list"), F.col("first.rank")]
    return ranked(fused, order).drop("first")


def diverse(hits: DataFrame, n_titles: int, per_title: int) -> DataFrame:
    """Of ranked hits (query_id, id, title, rank) the first `per_title` of the first `n_titles` titles, then others up to the full number.

    Titles come in the order of their best hit; what fills up follows in rank
    order. `pick` is the new order. A null title is a title.
    """
    c = max(1, per_title)
    title = Window.partitionBy("query_id", "title")
    seen = hits.withColumn("best", F.min("rank").over(title)).withColumn("in_title", F.row_number().over(title.orderBy("rank")))
    seen = seen.withColumn("title_no", F.dense_rank().over(Window.partitionBy("query_id").orderBy("best")))
    main = (F.col("title_no") <= n_titles) & (F.col("in_title") <= c)
    order = [F.when(main, 0).otherwise(1), F.when(main, F.col("title_no")), F.when(main, F.col("in_title")), F.col("rank")]
    return ranked(seen, order, "pick").where(F.col("pick") <= n_titles * c).drop("best", "in_title", "title_no")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's terms in the text: the offline stand-in of a pair scorer."""
    q, d = F.array_distinct(_terms(query)), F.array_distinct(_terms(text))
    return F.size(F.array_intersect(q, d)) / F.greatest(F.size(q), F.lit(1))


def rerank(hits: DataFrame, top_n: int, score: Column | None = None) -> DataFrame:
    """The first top_n hits by score (null: by their rank), with `rank_after`."""
    order = [F.desc(F.round(score, 9)), F.col("rank")] if score is not None else [F.col("rank")]
    return ranked(hits, order, "rank_after").where(F.col("rank_after") <= top_n)


def candidate_pool(corpus: DataFrame, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
    """The k nearest rows of each query with text and title. Written out once: what follows reads it, not the corpus, again and again.

    Ids of another type than a number are searched by their hash; where two ids
    have one hash, the distance tells which of them was meant.
    """
    numeric = dict(corpus.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")
    keyed = corpus if numeric else corpus.withColumn("_key", F.xxhash64("id"))
    hits = dense_topk(keyed, queries, k, where, "embedding", "id" if numeric else "_key")
    if numeric:
        return stage(hits.join(corpus.select("id", "text", "title"), "id"), "retrieve-pool")
    found = hits.withColumnRenamed("id", "_key").join(keyed.select("_key", "id", "text", "title", "embedding"), "_key").join(queries.select("query_id", "query_vector"), "query_id")
    same = F.abs(cosine_distance(F.col("embedding"), F.col("query_vector")) - F.col("distance")) < 1e-6
    once = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("rank"))
    found = found.where(same).withColumn("_once", once).where("_once = 1").select("query_id", "id", "text", "title", "distance")
    return stage(ranked(found, [F.round("distance", 9), F.col("id")]), "retrieve-pool")


def hybrid(
    corpus: DataFrame, queries: DataFrame, k: int, n_titles: int = 3, per_title: int = 2, weight: float = 0.3, rrf_k: int = 60, use_bm25: bool = True, where: dict | None = None,
    top_n: int | None = None, pair_score: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Composed retrieval over corpus (id, text, title, embedding) for queries (query_id, query, query_vector).

    Dense pool of k, BM25 over each pool, fusion by text, diversity selection:
    query_id, pick, id, title, text, score. With `pair_score`, a scorer of
    (query, text), the picks are ordered again by it and the first `top_n` kept
    (all where top_n is null).
    """
    pool = candidate_pool(corpus, queries, k, where)
    lexical = bm25_pools(pool, queries).drop("rank", "score").withColumnRenamed("lexical_rank", "rank") if use_bm25 else pool
    picked = diverse(rrf(pool, lexical, weight, rrf_k), n_titles, per_title)
    if pair_score is not None:
        asked = queries.select("query_id", "query")
        scored = picked.drop("rank").withColumnRenamed("pick", "rank").join(asked, "query_id").withColumn("pair", pair_score(F.col("query"), F.col("text")))
        picked = rerank(scored, top_n or n_titles * max(1, per_title), F.col("pair")).withColumnRenamed("rank_after", "pick")
    return picked.select("query_id", "pick", "id", "title", "text", F.round("score", 9).alias("score"))


def context(hits: DataFrame, order: str = "pick") -> DataFrame:
    """query_id, context: `[title]\\ntext` of the hits in order, and prompt: `[CHUNK id | title]\\ntext`."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Unknown"))
    row = F.struct(F.col(order).alias("o"), F.concat(F.lit("["), title, F.lit("]\n"), F.col("text")).alias("a"), F.concat(F.lit("[CHUNK "), F.col("id").cast("string"), F.lit(" | "), title, F.lit("]\n"), F.col("text")).alias("b"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return rows.select("query_id", F.array_join(F.transform("r", lambda x: x["a"]), "\n\n").alias("context"), F.array_join(F.transform("r", lambda x: x["b"]), "\n\n").alias("prompt"))
