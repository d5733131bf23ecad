"""Text functions, chunker and formatter."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talefold.functions import text as T
from talefold.functions.chunk import chunk_text, chunked, format_extracted

SENTENCE = "The old miller counted every lantern twice before dawn. "


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def test_strip_knows_all_white_space(spark):
    assert one(spark, T.newline_trim, "   a\r\nb 　\n") == "a\nb"
    assert one(spark, T.newline_trim, None) is None


def test_clean_story(spark):
    assert one(spark, T.clean_story, 'Write it.\n[SECTION 1: A]\n" Hello there,"she said said softly.') == '[SECTION 1: A]\n"Hello there," she said softly.'
    assert one(spark, T.clean_story, "“Come here.\n\n\nHe went.") == "“Come here.”\n\nHe went."
    assert one(spark, T.clean_story, "") == ""


def test_sections(spark):
    story = "[SECTION 1: A]\nOne. Two.\n[section 2: B]\nThree.\n[SECTION 1: A]\nLast."
    assert one(spark, T.section_bodies, story) == {1: "Last.", 2: "Three."}
    assert one(spark, T.missing_sections, story) == [3, 4, 5]
    assert [(r["n"], r["sentences"]) for r in one(spark, lambda c: T.short_sections(c, 2), story)] == [(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)]


def test_json_repair(spark):
    assert one(spark, T.repair_json, '```JSON\nok {"a": [1, 2,], }\n```') == '{"a": [1, 2]}'


def test_merge_paragraphs(spark):
    assert one(spark, T.merge_paragraphs, "a\n b\n---\n\n c\n– – –\n---\n--\nd") == "a b\nc\n-- d"


def test_entities(spark):
    assert one(spark, T.entities, "The Red Fox met Élan and Ann in Rome. Al left") == ["Ann", "Red", "Rome", "The Red Fox", "Fox"] or set(one(spark, T.entities, "The Red Fox met Ann in Rome. Al left")) == {"The Red Fox", "Red", "Fox", "Ann", "Rome"}


def test_url_quote_and_title(spark):
    assert one(spark, T.url_quote, "a b/c+é") == "a%20b/c%2B%C3%A9"
    assert one(spark, T.safe_title, 'a: "b"?' + "x" * 200).startswith("a___b__x") and len(one(spark, T.safe_title, "x" * 200)) == 100


@pytest.mark.parametrize("value,wanted", [("yes", True), ("1", True), ("TRUE ", True), ("on", False), (None, False), ("", False)])
def test_truthy(spark, value, wanted):
    assert one(spark, T.truthy, value) is wanted


def test_chunker_packs_paragraphs():
    text = "\n\n".join([SENTENCE * 8] * 6)
    chunks = chunk_text(text, 1000, 100)
    assert [len(c) <= 1000 for c in chunks] == [True] * 3 and "\n\n".join(chunks) == text.replace(" \n", "\n").strip()


def test_chunker_windows_overlap_and_begin_with_sentences():
    chunks = chunk_text(SENTENCE * 100, 900, 200)
    assert len(chunks) > 5 and all(len(c) <= 900 for c in chunks)
    assert all(c.startswith("The old") for c in chunks)


def test_chunker_drops_tiny_chunks_unless_all_are():
    assert chunk_text("Short one.") == ["Short one."]
    assert chunk_text("Tiny.\n\n" + "x " * 30, 40, 5, 20) != []
    assert chunk_text(None) == chunk_text(" \r\n ") == []


def test_chunker_gets_past_endless_words():
    assert "".join(dict.fromkeys(chunk_text("y" * 5000, 100, 90))) != "" and len(chunk_text("y" * 5000, 100, 90)) < 2000


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.,-'\n \t!", max_size=700), st.integers(60, 120), st.integers(0, 50))
def test_chunker_ends_and_keeps_words(text, limit, overlap):
    chunks = chunk_text(text, limit, overlap, 0)
    assert all(len(c) <= limit for c in chunks)
    assert (not text.strip()) == (not chunks)


def test_chunk_ids(spark):
    rows = chunked(spark.createDataFrame([("A", SENTENCE * 80), ("B", None), ("C", "")], "title string, text string"), "title", "text").collect()
    assert [r["chunk_id"] for r in rows] == [f"A_chunk_{i + 1}" for i in range(len(rows))] and len(rows) > 1


def test_format_extracted():
    assert format_extracted("one\r\ntwo\n\nCHAPTER ONE\nthree\n12\nfour") == "one two\n\nCHAPTER ONE three\n\n12 four"
    assert format_extracted("a" * 400 + ".\nnext") == "a" * 400 + ".\n\nnext"
    assert format_extracted(None) == ""


def test_all_documents_are_packed(spark, tmp_path):
    from talefold.plans import registry

    docs = [(1, "a" * 2000 + "\n\nb\n\nc"), (2, "a" * 900 + "\n\n" + "b" * 898 + "\n\nc"), (3, "x"), (4, None), (5, "  ")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = registry.queries()["chunk_paragraph_pack_all"](spark, f"file://{tmp_path}")
    assert {r["doc_id"]: r["n_chunks"] for r in got.collect()} == {1: 2, 2: 2, 3: 1, 5: 0}
