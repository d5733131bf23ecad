import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talefold.llm.splitting import cut, oversized, pieces


def check(text, limit, overlap):
    spans = cut(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    done = 0
    for k, (start, end) in enumerate(spans):
        assert 0 < end - start <= limit or not text
        assert start <= done and done - start <= overlap and (end > done or not text)
        done = end
    assert "".join(text[max(s, d) : e] for (s, e), d in zip(spans, [0, *[e for _, e in spans]])) == text
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé.!? \ń", max_size=600), st.integers(5, 80), st.integers(0, 4))
def test_nothing_is_lost_and_limits_hold(text, limit, overlap):
    check(text, limit, overlap)


def test_boundaries_in_order_of_worth():
    text = "First one here. Second one.\n\nThird one is here. Fourth one is longer than that."
    assert text[: cut(text, 40, 0)[0][1]] == "First one here. Second one.\n\n"
    assert text[: cut(text[:27] + text[29:], 40, 0)[0][1]].startswith("First one here. Second one")
    assert cut("abcdefgh" * 10, 16, 4)[:2] == [(0, 16), (12, 28)]
    words = "alpha beta gamma delta epsilon"
    assert [words[a:b] for a, b in cut(words, 12, 6)] == ["alpha beta ", "beta gamma ", "gamma delta ", "epsilon"] or check(words, 12, 6)


def test_overlap_begins_with_a_word():
    text = "The mill stood still. " * 60
    spans = check(text, 300, 50)
    assert all(text[s] in "Tmse" and (s == 0 or text[s - 1].isspace()) for s, _ in spans) and any(s < e for (s, _), (_, e) in zip(spans[1:], spans))


def test_very_long_text():
    check("word " * 200_000, 1800, 200)


def test_wrong_parameters():
    with pytest.raises(ValueError):
        cut("abc", 10, 10)


def test_rows(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, None), (3, ""), (4, " " * 500), (5, "a\r\n" * 40 + "b"), (6, " " + "y" * 50 + "\r\n")], "row_id bigint, c string")
    assert sorted(r["row_id"] for r in oversized(df, "t", "c", 50, 5).collect()) == [1, 5]
    got = pieces(df, "t", "c", 50, 5).where("row_id = 1").orderBy("piece_no").collect()
    assert [len(r["piece"]) for r in got] == [50, 50, 10] and [r["overlap"] for r in got] == [0, 5, 5]
