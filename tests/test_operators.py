"""Operators on small tables: ranking, collections, facts, decisions, labels, files, streams."""

import json
import math
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from talefold import config
from talefold.models import hash_vector
from talefold.operators import collection, enrich, evaluate, facts, metadata, results, retrieve
from talefold.plans import loop
from talefold.plans.pipeline import Engine
from talefold.sources import files, sinks


FOUR = "id string, document string, metadata map<string,string>, version bigint"


def test_dense_topk_is_exact_and_ties_go_by_id(spark):
    rows = [(3, [1.0, 0.0], "a"), (1, [2.0, 0.0], "b"), (2, [0.0, 1.0], "c"), (4, None, "d"), (5, [0.0, 0.0], "e"), (None, [1.0, 0.0], "f")]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string").repartition(3)
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, query_vector array<float>")
    got = [(r["id"], round(r["distance"], 6)) for r in retrieve.dense_topk(corpus, queries, 3).orderBy("rank").collect()]
    assert got == [(1, 0.0), (3, 0.0), (2, 1.0)]
    assert retrieve.dense_topk(corpus, queries.where("false"), 3).count() == 0
    assert retrieve.dense_topk(corpus.where("false"), queries, 3).count() == 0


def test_vectors_of_other_sizes_are_refused(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "vec_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, query_vector array<float>")
    with pytest.raises(Exception, match="different sizes"):
        retrieve.dense_topk(corpus, queries, 1).collect()


def test_rrf_keeps_the_first_of_equal_texts_with_their_last_rank(spark):
    dense = spark.createDataFrame([(1, 10, "x", 1), (1, 11, "y", 2), (1, 12, "x", 3)], "query_id int, id int, text string, rank int")
    lexical = spark.createDataFrame([(1, 11, "y", 1)], "query_id int, id int, text string, rank int")
    got = {r["id"]: r["score"] for r in retrieve.rrf(dense, lexical).collect()}
    assert set(got) == {10, 11}
    assert math.isclose(got[10], 0.7 / (3 + 60) + 0.3 / (2 + 60 + 60)) and math.isclose(got[11], 0.7 / 62 + 0.3 / 61)


def test_diverse_selection_fills_up(spark):
    hits = spark.createDataFrame([(1, i, t, i) for i, t in enumerate(["a", "a", "a", "b", None], 1)], "query_id int, id int, title string, rank int")
    got = [r["id"] for r in retrieve.diverse(hits, 2, 2).orderBy("pick").collect()]
    assert got == [1, 2, 4, 3]


def test_bm25_negative_weights_are_floored(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat"), (3, "cat bird bird"), (4, None)], "id int, text string")
    queries = spark.createDataFrame([(1, "Cat bird"), (2, ""), (3, None)], "query_id int, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in retrieve.bm25(docs, queries).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3)} and max(got, key=got.get) == (1, 3)


def test_collection_life(spark, tmp_path):
    c = collection.Collection(spark, f"file://{tmp_path}", "stories")
    assert c.version() == -1 and c.count() == 0
    rows = spark.createDataFrame([("a", "one", {"k": "v"}, 1), ("b", "two", None, 1), (None, "x", None, 9)], FOUR)
    c.upsert(rows)
    c.upsert(rows)
    assert c.count() == 2
    c.upsert(spark.createDataFrame([("a", "newer", {"k": "w"}, 2)], FOUR))
    assert c.get("a").first()["document"] == "newer"
    c.insert(["b", "c"], "note", {})
    assert {r["id"]: r["document"] for r in c.read().collect()} == {"a": "newer", "b": "two", "c": "note"}
    c.update(spark.createDataFrame([("c", "other"), ("zz", "none")], "id string, document string"))
    c.delete(spark.createDataFrame([("a",)], "id string"))
    assert [r["id"] for r in c.ids()[0].collect()] == ["b", "c"] and c.get("c").first()["document"] == "other"
    assert [r["id"] for r in c.list(offset=1, limit=5).collect()] == ["c"]
    c.reset()
    assert c.count() == 0
    c.vacuum()
    with pytest.raises(ValueError):
        c.insert([], "x", {})
    with pytest.raises(ValueError):
        collection.Collection(spark, "x", " ")


def rewritten(c):
    """Rows in all segments that the collection names."""
    return [s["level"] for s in c.segments()], c._rows(c.segments()).count()


def test_a_write_costs_its_rows_and_a_bounded_merge(spark, tmp_path):
    c = collection.Collection(spark, f"file://{tmp_path}", "c")
    frame = lambda low, n, v: spark.range(low, low + n).selectExpr("cast(id as string) id", "concat('d', id) document", "cast(null as map<string,string>) metadata", f"cast({v} as bigint) version")
    c.upsert(frame(0, 500, 0))
    c.upsert(frame(10, 5, 1))
    assert rewritten(c) == ([0, 0], 505) and c.count() == 500
    for k in range(6):
        c.upsert(frame(20, 2, 2 + k))
    assert rewritten(c) == ([1], 500)  # eight segments became one, without the rows they replace
    c.delete(spark.createDataFrame([("20",), ("nobody",)], "id string"))
    c.upsert(frame(20, 1, 0))  # an older version counts again after a deletion
    assert c.count() == 500 and c.get("20").first()["version"] == 0
    c.vacuum()
    assert c.count() == 500


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    a, b = (collection.Collection(spark, f"file://{tmp_path}", "c") for _ in range(2))
    a.create()
    seen = b.version()
    a.upsert(spark.createDataFrame([("x", "one", None, 1)], "id string, document string, metadata map<string,string>, version bigint"))
    with pytest.raises(RuntimeError):
        b._commit(seen, [])
    assert a.count() == 1


def test_only_changed_rows_are_embedded_again(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def vectors(text):
        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            seen.add(len(texts))
            return texts.map(lambda t: [float(len(t or ""))])

        return run(text)

    c = collection.Collection(spark, f"file://{tmp_path}", "c", vectors)
    c.upsert(spark.createDataFrame([(str(k), f"text {k}", None, 1) for k in range(50)], "id string, document string, metadata map<string,string>, version bigint"))
    before = seen.value
    c.update(spark.createDataFrame([("1", "text 1"), ("2", "a longer text"), ("none", "x")], "id string, document string"))
    assert before == 50 and seen.value == 51
    assert {r["id"]: r["embedding"] for r in c.read().where("id in ('1', '2')").collect()} == {"1": [6.0], "2": [13.0]}


def test_stream_of_several_batches_equals_the_batch(spark, tmp_path):
    from talefold.plans.pipeline import collection_rows
    from talefold.streaming import ingest as stream

    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"S{k}.txt").write_text(f"Story {k} of the red fox who counted lanterns by the mill. " * 60)
    c = collection.Collection(spark, f"file://{tmp_path}/c", "s")
    q = stream.ingest(stream.story_stream(spark, f"file://{tmp_path}/in", 2), c, f"file://{tmp_path}/check")
    q.awaitTermination()
    assert len(c.segments()) >= 2
    rows = collection_rows(files.stories(spark, f"file://{tmp_path}/in"))
    assert sorted(map(tuple, c.read().select("id", "document").collect())) == sorted(map(tuple, rows.select("id", "document").collect()))


def test_retries():
    from talefold.models import retried

    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("503 high demand")
        return "done"

    assert retried(flaky, sleep=waits.append)("p") == "done" and waits == [2, 4]
    with pytest.raises(RuntimeError):
        retried(lambda p: (_ for _ in ()).throw(RuntimeError("bad key")), sleep=waits.append)("p")
    assert waits == [2, 4]


def test_filters_and_templates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    ids = lambda where: [r["n"] for r in retrieve.filtered(df, where).orderBy("n").collect()]
    assert ids({"s": "a"}) == [1] and ids({"s": None}) == [3] and ids({"s": {"$ne": "a"}}) == [2, 3] and ids({"$or": [{"n": {"$gt": 2}}, {"s": {"$in": ["a"]}}]}) == [1, 3] and ids({"s": {"$nin": ["a"]}}) == [2, 3]
    with pytest.raises(ValueError):
        ids({"s": {"$like": "a"}})
    with pytest.raises(ValueError):
        results.filled("{nobody}")


def test_text_ids_with_one_hash_are_told_apart(spark, monkeypatch):
    corpus = spark.createDataFrame([("a", "one", "A", [1.0, 0.0]), ("b", "two", "B", [0.0, 1.0]), ("c", "three", "C", [0.6, 0.8])], "id string, text string, title string, embedding array<float>")
    queries = spark.createDataFrame([(1, "one", [1.0, 0.1])], "query_id int, query string, query_vector array<float>")
    wanted = [r["id"] for r in retrieve.candidate_pool(corpus, queries, 2).orderBy("rank").collect()]
    monkeypatch.setattr(retrieve.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    assert wanted == [r["id"] for r in retrieve.candidate_pool(corpus, queries, 2).orderBy("rank").collect()] == ["a", "c"]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


def test_facts(spark):
    raw = '```json\n{"facts": [{"type": "who", "fact": "Ann is a smith", "source_chunk_ids": ["c1"], "quote": ""}, {"fact": "no source"}, {"fact": "B", "sources": "c2",},]}\n```'
    got = one(spark, facts.parse_facts, raw)
    assert [(f["fact"], f["type"], f["source_chunk_ids"]) for f in got] == [("Ann is a smith", "who", ["c1"]), ("B", "fact", ["c2"])]
    assert one(spark, facts.parse_facts, "broken {") == [] == one(spark, facts.parse_facts, None)
    assert one(spark, lambda c: facts.prompt_lines(facts.parse_facts(c)), raw) == "1. [who] Ann is a smith  (source: c1)\n2. [fact] B  (source: c2)"


def test_gate(spark):
    story = "[SECTION 1: A]\n\n" + "\n\n".join(f"Name{chr(97 + i)} Walked." for i in range(12))
    row = spark.createDataFrame([(story, "Namea")], "s string, f string").select(facts.gate(F.col("s"), F.col("f"), True)["story"], facts.gate(F.col("s"), F.col("f"), False)["story"]).first()
    assert len(row[0].split("\n\n")) == 6 and row[1] == story


@pytest.mark.parametrize(
    "raw,wanted",
    [('{"a": 8, "b": 6, "c": {"score": 7}, "d": 9, "e": 10}', 8.0), ('{"average_score": 5.5, "a": 9}', 5.5), ("{}", 0.0), ('chat {"scores": {"a": {"score": "4"}}} chat', 4.0), ('{"a": true, "summary": 3}', 0.0), ('{"average_score": true, "a": 2}', 2.0)],
)
def test_average(spark, raw, wanted):
    assert one(spark, lambda c: evaluate.average(evaluate.parse_evaluation(c)), raw) == wanted


@pytest.mark.parametrize(
    "has,avg,faith,ok,n,wanted",
    [(False, 0.0, None, True, 0, "accept"), (False, 0.0, None, False, 0, "re_retrieve"), (False, 0.0, None, False, 2, "refine"), (True, 9.0, 5.0, True, 9, "re_retrieve"), (True, 9.0, 9.0, True, 0, "re_retrieve"),
     (True, 9.0, 9.0, True, 1, "accept"), (True, 9.0, None, False, 9, "refine"), (True, 5.0, 8.0, True, 2, "re_retrieve"), (True, 5.0, 8.0, True, 5, "refine")],
)
def test_decision(spark, has, avg, faith, ok, n, wanted):
    df = spark.createDataFrame([(has, avg, faith, ok, n)], "h boolean, a double, f double, o boolean, n int")
    assert df.select(evaluate.decision(F.col("h"), F.col("a"), F.col("f"), F.col("o"), F.col("n"))).first()[0] == wanted


def test_case_results(spark):
    cases = spark.createDataFrame([(1, " The Fox ", ["red", "hill"]), (2, "None", []), (3, "X", None)], "item_id int, expected_title string, expected_facts array<string>")
    hits = spark.createDataFrame([(1, 1, "Dog", None, "", "on the Hill"), (1, 2, "the fox", "A", "", "RED")], "item_id int, rank int, title string, author string, summary string, text string")
    got = {r["item_id"]: tuple(r)[1:] for r in evaluate.case_results(hits, cases).collect()}
    assert got == {1: (2, False, True, 1.0), 2: (None, False, False, None), 3: (None, False, False, None)}
    empty = evaluate.summary(evaluate.case_results(hits.where("false"), cases.where("false"))).first()
    assert tuple(empty) == (0, 0.0, 0.0, None)


def test_label_streak(spark):
    rows = spark.createDataFrame([("s", i, label) for i, label in enumerate(["setup"] * 5 + ["odd", "", None, "twist"])], "t string, i int, label string")
    got = [r["section"] for r in enrich.labelled(rows, "t", "i", "label").orderBy("i").collect()]
    assert got == ["setup", "setup", "setup", "rising_action", "rising_action", "rising_action", "rising_action", "climax", "twist"]


def test_metadata_merge(spark):
    df = spark.createDataFrame([({"author": "t", "_x": "1", "series_json": "{}"}, {"Is_series": "yes", "id": " "}, None)], "t map<string,string>, d map<string,string>, o map<string,string>")
    m = df.select(metadata.merged(metadata.without_hidden(F.col("t")), F.col("d"), F.col("o"), F.lit("T"), F.lit("c1"))).first()[0]
    assert m == {"author": "t", "series_json": "{}", "id": "T", "Title": "T", "chunk_id": "c1", "Is_series": "true"}


def test_files(spark, tmp_path):
    (tmp_path / "b.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "c.md").write_text("no")
    got = {r["title"]: r["text"] for r in files.stories(spark, f"file://{tmp_path}").collect()}
    assert got == {"a": "one\n\ntwo", "b": "caf�"}
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"query": "q", "expected_title": "t", "expected_facts": "f"}, {"query": "q"}]}))
    assert [tuple(r) for r in files.cases(spark, f"file://{tmp_path}/cases.json").collect()] == [("q", "t", ["f"], None)]
    (tmp_path / "t.json").write_text(json.dumps({"defaults": {"a": 1, "_c": 2}, "by_title": {"X": {"b": 1, "_d": 0}, "_e": {}}}))
    assert files.template(str(tmp_path / "t.json")) == ({"a": 1}, {"X": {"b": 1}}) and files.template("none") == ({}, {})


def test_books(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("2.xhtml", "<p>Second &amp; last</p>")
        z.writestr("1.xhtml", "<h1>First</h1><script>x</script>")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    read = files.books(spark, f"file://{tmp_path}")
    got = {r["name"]: (r["text"], r["error"] is not None) for r in read.collect()}
    assert got["x.epub"] == ("First Second & last", False) and got["bad.epub"][1]
    assert tuple(files.counters(read).first())[:2] == (2, 1)


def test_manifest_keeps_chapter_series_and_volume(spark):
    stories = spark.createDataFrame([("Fox", "The red fox of Marsh Hill counted lanterns.")], "title string, text string")
    template = {"Is_series": True, "series": {"id": "s1", "series_name": "Foxes"}, "volume": {"volume_id": "v2", "volume_name": "Hill", "volume_number": 2}, "chapter": {"chapter_id": "c3", "chapter_number": 3, "chapter_name": "Lanterns"}}
    r = metadata.story_records(stories, template)
    got = metadata.manifest(r.withColumn("id", F.lit(""))).first()["metadata"]
    assert got["id"] == "Fox"
    assert [json.loads(got[f"{n}_json"]) for n in ("series", "volume", "chapter")] == [template[n] for n in ("series", "volume", "chapter")]
    alone = metadata.manifest(metadata.story_records(stories, template | {"Is_series": False, "chapter": None})).first()["metadata"]
    assert (alone["series_json"], alone["volume_json"], alone["chapter_json"]) == (None, None, "{}")
    plain = metadata.manifest(metadata.story_records(stories)).first()["metadata"]
    assert json.loads(plain["series_json"]) == {"id": "", "series_name": ""} and json.loads(plain["chapter_json"])["chapter_number"] == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", " ")], "name string, text string")
    sinks.write_texts(df, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 1
    sinks.append_stamped(df, f"file://{tmp_path}/s")
    assert len(spark.read.parquet(f"file://{tmp_path}/s").first()["saved_at"]) == 15
    sinks.write_manifest(df, f"file://{tmp_path}/m", True)
    sinks.write_records(df, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/m").count() == 2


def test_engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Fox.txt").write_text("The red fox of Marsh Hill counted lanterns. " * 80)
    (tmp_path / "in" / "Owl.txt").write_text("An owl slept above the old mill in Thornford. " * 20)
    engine = Engine(spark, config.EngineConfig(collection_path=f"file://{tmp_path}/c", min_words=10, min_sentences=0))
    steps = engine.run(["fetch", "extract", "prepare", "enrich", "reset", "ingest"], f"file://{tmp_path}/in", f"file://{tmp_path}/work")
    assert steps == {"fetch": "2 files", "extract": "done", "prepare": "done", "enrich": "done", "reset": "done", "ingest": "done"}
    assert engine.status()["rows"] > 2 and {r["m"] for r in engine.collection.read().selectExpr("metadata['section'] m").collect()} <= set(enrich.TAGS)
    assert engine.run(["reset", "ingest"], f"file://{tmp_path}/in") == {"reset": "done", "ingest": "done"}
    n = engine.collection.count()
    engine.ingest_stories(f"file://{tmp_path}/in")
    assert engine.collection.count() == n > 2
    queries = spark.createDataFrame([(1, "red fox lanterns")], "query_id int, query string")
    assert engine.query(queries).where("pick = 1").first()["title"] == "Fox"
    assert engine.generate_agentic(queries).answers.count() == 1
    (tmp_path / "in" / "Fox.txt").write_text("The red fox of Marsh Hill counted lanterns. " * 10)
    engine.ingest_stories(f"file://{tmp_path}/in", drop_stale=True)
    assert engine.collection.count() < n
    with pytest.raises(ValueError):
        engine.run(["nonsense"], "x")


def test_config(tmp_path, monkeypatch):
    (tmp_path / "setup.json").write_text('{"bm25_weight": 0, "unknown": 1, "collection_path": "${BASE}/x", "k_boost": null}')
    c = config.load(root=str(tmp_path))
    assert c.bm25_weight == 0 and c.k_boost == 1.0 and c.collection_path == f"{tmp_path}/x"
    (tmp_path / "other.json").write_text('{"min_facts": 9}')
    monkeypatch.setenv("TALEFOLD_CONFIG", str(tmp_path / "other.json"))
    assert config.load(root=str(tmp_path)).min_facts == 9
    assert config.pool_size(20, 3, 2) == 24 and config.pool_size(20, 3, 0, 2) == 40 and config.backoff(3) == [2, 4, 8]


def test_stage_events_and_vectors():
    assert loop.stage_events("extract") == [(0, "retrieve", "start"), (1, "retrieve", "done"), (2, "extract", "start"), (3, "extract", "error"), (4, "end", "done")]
    v = hash_vector("Fox fox!")
    assert math.isclose(sum(x * x for x in v), 1, rel_tol=1e-5) and hash_vector(" ") is None and hash_vector(None) is None
