"""The training-data queries against their SQL, or to their end, and on empty tables."""

import pytest

from talefold.llm import queries as llm
from tests.oracle import assert_same

SQL = llm.oracle_sql()
TABLES = ("series_records", "standalone_records", "village_chunks", "ingest_manifest", "documents", "retrieval_cases")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert_same(llm.queries()[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert llm.queries()[name](spark, sf).count() > 0


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('empty')}"
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, empty, name):
    assert llm.queries()[name](spark, empty).count() == 0


@pytest.fixture(scope="module")
def nulls(spark, sf, tmp_path_factory):
    """Each table with all columns null in one row, a row twice, and extra columns of clashing names."""
    from pyspark.sql import functions as F

    folder = f"file://{tmp_path_factory.mktemp('nulls')}"
    for t in TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet").limit(20)
        key = df.columns[0]
        none = df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        bare = df.limit(1).select(*[F.col(f.name) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        rows = df.unionByName(df).unionByName(none).unionByName(bare.withColumn(key, F.lit(-1).cast("bigint")))
        for extra in ("t", "tbl", "a", "b", "n", "kind", "pool", "unit", "set_id", "group_id", "chains", "_residue_row", "known"):
            if extra not in rows.columns:
                rows = rows.withColumn(extra, F.lit("x"))
        rows.write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_nulls_repeats_and_clashing_columns(spark, nulls, name):
    rows = llm.queries()[name](spark, nulls).collect()
    assert all(r is not None for r in rows)
