"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talefold.llm import encodings, leakage, neardup, pii, residue, scans, splitting, tokens, truncation

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Problem 1: table, column, limit, overlap.
SPLITS = (("series_records", "raw_text", 1800, 200), ("village_chunks", "section", 120, 20))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [splitting.oversized(_table(spark, sf, t), t, c, limit, overlap) for t, c, limit, overlap in SPLITS]
    return parts[0].unionByName(parts[1])


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    parts = [splitting.pieces(_table(spark, sf, t), t, c, limit, overlap) for t, c, limit, overlap in SPLITS]
    return parts[0].unionByName(parts[1])


#: Problem 2: table, column.
RESIDUE = (("series_records", "raw_text"), ("standalone_records", "summary"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [residue.residue(_table(spark, sf, t), t, c).select("tbl", "row_id") for t, c in RESIDUE]
    return parts[0].unionByName(parts[1])


def p2_kinds(spark: SparkSession, sf: str) -> DataFrame:
    parts = [residue.residue(_table(spark, sf, t), t, c) for t, c in RESIDUE]
    return parts[0].unionByName(parts[1]).groupBy("tbl", "kind").agg(F.count("*").alias("n"), F.avg("coverage").alias("coverage"))


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    parts = [residue.without_residue(_table(spark, sf, t), c).select(F.lit(t).alias("tbl"), "row_id", F.col(c).alias("text")) for t, c in RESIDUE]
    return parts[0].unionByName(parts[1])


def p2_without(spark: SparkSession, sf: str) -> DataFrame:
    """The tables without all rows of p2_found, however little residue they hold."""
    parts = [residue.without_residue(_table(spark, sf, t), c, 0.0).select(F.lit(t).alias("tbl"), "row_id") for t, c in RESIDUE]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_table(spark, sf, "standalone_records"))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(_table(spark, sf, "standalone_records"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_pairs(_table(spark, sf, "ingest_manifest"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicate_groups(_table(spark, sf, "ingest_manifest"))


def _scans(spark: SparkSession, sf: str) -> list[tuple[DataFrame, str, str]]:
    return [(_table(spark, sf, t), t, c) for t, c in (("series_records", "raw_text"), ("village_chunks", "text"))]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scanned(_scans(spark, sf)).select("tbl", "row_id")


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repaired(_scans(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.garbled(_table(spark, sf, "village_chunks"))


def p6_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.restored(_table(spark, sf, "village_chunks"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(_table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "retrieval_cases")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "retrieval_cases"))


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_spans(_table(spark, sf, "documents"), _table(spark, sf, "retrieval_cases"))


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.without_leaks(_table(spark, sf, "documents"), _table(spark, sf, "retrieval_cases"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal(_table(spark, sf, "documents")).select("doc_id", "kind")


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(_table(spark, sf, "documents"))


_BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _oversized_sql(tbl: str, column: str, limit: int) -> str:
    text = f"replace({column}, chr(13) || chr(10), chr(10))"
    return f"SELECT '{tbl}' AS tbl, row_id FROM {tbl} WHERE length(regexp_replace({text}, '^{_BLANKS}|{_BLANKS}$', '', 'g')) > {limit}"


_P8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
     i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM retrieval_cases),
     dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
     ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""
_P8_GRAMS = _P8_SQL.split("SELECT DISTINCT doc_id, item_id")[0].replace("SELECT doc_id, array_to_string", "SELECT doc_id, k, len(w) AS n, array_to_string").replace("DISTINCT item_id, array_to_string", "DISTINCT item_id, k, array_to_string")
_P8_SPANS = f"""{_P8_GRAMS}, hit AS (SELECT DISTINCT doc_id, n, k FROM dg WHERE g IN (SELECT g FROM ig)),
     run AS (SELECT *, CASE WHEN k <= lag(k) OVER w + 12 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
     island AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS no FROM run)
SELECT doc_id, (min(k) - 1)::INT AS first_word, (max(k) + 11)::INT AS end_word, max(n)::INT AS words_in_doc FROM island GROUP BY doc_id, no"""
_P8_LEAKS = f"""{_P8_GRAMS}, hit AS (SELECT DISTINCT doc_id, item_id, n, dg.k AS k, ig.k AS i FROM dg JOIN ig USING (g)),
     run AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, k - i ORDER BY k) AS no FROM hit),
     runs AS (SELECT doc_id, item_id, n, min(k) - 1 AS first, count(*) + 11 AS longest FROM run GROUP BY doc_id, item_id, n, k - i, no)
SELECT doc_id, item_id, max(longest)::INT AS longest, arg_min(first, (-longest, first))::INT AS first_word, max(n)::INT AS words_in_doc FROM runs GROUP BY doc_id, item_id"""


_P4_SETS = r"""
WITH w AS (SELECT row_id, list_concat(regexp_extract_all(lower(coalesce(metadata.Title, '')), '[\p{L}\p{N}]+'), regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM ingest_manifest
       WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) >= 20),
     s AS (SELECT row_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')))) AS s FROM w),
     g AS (SELECT row_id, len(s) AS n, unnest(s) AS g FROM s),
     pairs AS (SELECT a.row_id AS a, b.row_id AS b FROM g a JOIN g b ON a.g = b.g AND a.row_id < b.row_id GROUP BY ALL HAVING count(*) >= 0.6 * (max(a.n) + max(b.n) - count(*)) - 1e-9)"""
_P4_GROUPS = _P4_SETS.replace("WITH w AS", "WITH RECURSIVE w AS") + """,
     edges AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
     reach AS (SELECT DISTINCT u AS row_id, u AS seen FROM edges UNION SELECT reach.row_id, v FROM reach JOIN edges ON seen = u),
     lowest AS (SELECT row_id, min(seen) AS group_id FROM reach GROUP BY row_id),
     copies AS (SELECT s, count(*) AS copies FROM s GROUP BY s),
     links AS (SELECT u AS row_id, count(DISTINCT o.s) AS links FROM edges JOIN s m ON m.row_id = u JOIN s o ON o.row_id = v WHERE o.s <> m.s GROUP BY u)
SELECT i.row_id, coalesce(group_id, i.row_id) AS group_id, coalesce(copies, 1) AS copies, coalesce(links, 0) AS links
FROM ingest_manifest i LEFT JOIN lowest USING (row_id) LEFT JOIN s USING (row_id) LEFT JOIN copies USING (s) LEFT JOIN links USING (row_id)"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": " UNION ALL ".join(_oversized_sql(t, c, limit) for t, c, limit, _ in SPLITS),
        "p4_found": f"{_P4_SETS} SELECT a AS row_id_a, b AS row_id_b FROM pairs",
        "p4_groups": _P4_GROUPS,
        "p8_found": _P8_SQL,
        "p8_spans": _P8_SPANS,
        "p8_leaks": _P8_LEAKS,
    }
