"""Problem 3: values cut at a hidden storage limit or in mid-transfer."""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talefold.llm.arrow import map_rows
from talefold.llm.residue import Detector
from talefold.session import stage

#: A value's length, as a store or a transfer may have counted it; and by how much a cut may fall short of the limit there.
MEASURES = {
    "characters": (len, 0),
    "utf8_bytes": (lambda t: len(t.encode("utf-8", "surrogatepass")), 3),
    "utf16_units": (lambda t: len(t.encode("utf-16-le", "surrogatepass")) // 2, 1),
    "html_escaped": (lambda t: len(html.escape(t)), 5),
    "html_entities": (lambda t: len(html.escape(t).encode("ascii", "xmlcharrefreplace")), 7),
    "json_escaped": (lambda t: len(json.dumps(t, ensure_ascii=False)) - 2, 1),
    "json_ascii": (lambda t: len(json.dumps(t)) - 2, 5),
    "crlf_characters": (lambda t: len(t.replace("\r\n", "\n").replace("\n", "\r\n")), 1),
    "crlf_utf8_bytes": (lambda t: len(t.replace("\r\n", "\n").replace("\n", "\r\n").encode("utf-8", "surrogatepass")), 3),
    "lf_characters": (lambda t: len(t.replace("\r\n", "\n")), 0),
}
#: A limit shows where a length has so many rows at least, most of them with an open ending, and so many times what lengths near it have,
#: and where chance gives as many in none of a hundred sources of that size (logarithm of the odds).
LEAST_ROWS, OPEN_SHARE, PEAK, ODDS = 4, 0.5, 4.0, 4.6
#: The longest headline without a closing mark.
HEADLINE = 70

ENDING = "row_id bigint, source string, lengths array<int>, ending string, one_sentence boolean, n_chars int, last_word string"
_DOTS = re.compile(r"\s*(?:\.{3,}|…)$")
_CLOSED = re.compile(r"""[.!?。！？…]["'”’“»)\]]*(?:\s*\([^()]{1,40}\))?$""")
_SOFT_QUOTE = re.compile(r"""[!?]\s*["”“»]$""")
_COMMA_QUOTE = re.compile(r"""[,;:–—-]\s*["”“»]$""")
_BETWEEN = re.compile(r"""[.!?]["'”“»)\]]*\s""")
_LAST_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*$")
# Words that no headline ends with.
_LINKING = set(
    """a an the and or of to in on at by for from with was were is are had has that which who as but so than their his her its this these
    der die das den dem des ein eine einen einem einer und oder von vom zu zum zur im am mit bei für nicht so wie auch
    le la les un une des du de et ou à au aux en avec pour par que qui ne pas sa son ses
    el los las una unos y o del al con por para que no su sus se
    os as um uma e do da dos das ao com por para que não seu sua
    и в на с к у о за по из не но а что как для от""".split()
)


def ending(text: str) -> str:
    """dots, open, comma_quote, soft_quote, open_quote or closed; `text` has no white space at its end."""
    if _DOTS.search(text):
        before = _DOTS.sub("", text)
        return "closed" if _CLOSED.search(before) and not before.endswith("…") else "dots"
    if _COMMA_QUOTE.search(text):
        return "comma_quote"
    if not _CLOSED.search(text):
        return "open"
    if _SOFT_QUOTE.search(text):
        return "soft_quote"
    last = _BETWEEN.split(text)[-1]
    opened = text.count("“") > text.count("”") and "„" not in text or text.count("«") > text.count("»") or text.count("„") > text.count("“")
    return "open_quote" if opened or text.count('"') % 2 or (re.match(r"\s*—\s*¿", last) and last.endswith("?")) else "closed"


def endings(df: DataFrame, text: str = "summary", source: str = "source", key: str = "row_id") -> DataFrame:
    """Lengths by every measure and the kind of ending (ENDING), of all rows but null, blank and residue ones."""
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    measures = [f for f, _ in MEASURES.values()]

    def make():
        detect = Detector()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for row_id, src, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                trimmed = t.rstrip()
                if not trimmed or detect(t) is not None:
                    continue
                word = _LAST_WORD.search(trimmed)
                values = (row_id, src, [f(t) for f in measures], ending(trimmed), not _BETWEEN.search(trimmed), len(trimmed), word.group().lower() if word else None)
                for col, value in zip(cols, values):
                    col.append(value)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.bool_(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row_id", "source", "lengths", "ending", "one_sentence", "n_chars", "last_word"])

        return step

    return map_rows(rows, ENDING, make)


def limits(ends: DataFrame) -> DataFrame:
    """source, measure (its number), limit_at, rows_at: the storage limits of each source that has some.

    Counts are grouped by source, measure and length over all rows. A limit is a
    length that piles up rows with open endings far beyond what the lengths near
    it have; how far follows from the source's number of rows, so that a limit
    counts however small its share of them is. A source that changed its limit
    has several. The measure by which most rows stand at limits is the source's.
    """
    counts = (
        ends.select("source", F.posexplode("lengths").alias("m", "length"), (F.col("ending") != "closed").cast("int").alias("open"))
        .groupBy("source", "m", "length")
        .agg(F.count("*").alias("n"), F.sum("open").alias("n_open"))
    )
    by = Window.partitionBy("source", "m")
    near = lambda low, high: F.coalesce(F.sum("n").over(by.orderBy("length").rangeBetween(low, high)), F.lit(0))
    seen = counts.select("*", F.sum("n").over(by).alias("n_source"), ((near(-40, -8) + near(8, 40)) / 66.0).alias("two_sided"), (near(-40, -8) / 33.0).alias("below"))
    usual = F.greatest("two_sided", "below", F.lit(0.1))
    odds = F.col("n") * F.ln(F.col("n") / usual) - (F.col("n") - usual)
    walls = seen.where(
        (F.col("n") >= LEAST_ROWS)
        & (F.col("n_open") >= OPEN_SHARE * F.col("n"))
        & (F.col("n") >= PEAK * usual)
        & (odds >= F.ln(F.lit(float(len(MEASURES))) * F.col("n_source")) + ODDS)
    ).select("source", "m", "length", "n")
    of_measure = walls.withColumn("rows", F.sum("n").over(by))
    best = F.dense_rank().over(Window.partitionBy("source").orderBy(F.desc("rows"), "m"))
    return of_measure.withColumn("k", best).where("k = 1").select("source", F.col("m").alias("measure"), F.col("length").alias("limit_at"), F.col("n").alias("rows_at"))


#: Kinds of ending that a cut may leave, and what each says by itself and at its source's limit.
SCORES = {"dots": (1.0, 1.0), "comma_quote": (0.8, 1.0), "open": (0.6, 1.0), "soft_quote": (0.3, 0.7), "open_quote": (0.3, 0.7), "closed": (0.0, 0.2)}
#: What is taken off where an open ending may be a whole headline; a value is cut from CUT on.
MAY_BE_HEADLINE, CUT = 0.5, 0.5


def judged(df: DataFrame, text: str = "summary", source: str = "source", key: str = "row_id", with_limits: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with `cut`, limits): cut is true where the value ends before its last sentence does.

    Each kind of ending has a score (SCORES), a higher one where the value
    stands at a limit of its source. It is lowered for what may be a whole
    headline: one sentence of at most HEADLINE characters whose last word is a
    known word (one that stands inside some value) and no linking word. At a
    limit that is no excuse: a headline, or a question within quotation marks,
    that ends there is cut too. Null, blank and residue values are not judged.
    """
    ends = stage(endings(df, text, source, key), "truncation-endings")
    walls = stage(limits(ends) if with_limits else limits(ends).where("false"), "truncation-limits")
    # a source has few limits, as each holds at least LEAST_ROWS of its rows; lengths are compared with the list of them
    listed = walls.groupBy("source").agg(F.collect_list(F.struct("measure", "limit_at")).alias("walls")).withColumnRenamed("source", "wall_source")
    slack = F.array(*[F.lit(s) for _, s in MEASURES.values()])
    at = F.exists("walls", lambda w: (w["limit_at"] - F.element_at("lengths", w["measure"] + 1)).between(0, F.element_at(slack, w["measure"] + 1)))
    placed = ends.join(listed, F.col("source").eqNullSafe(F.col("wall_source")), "left").select("row_id", "source", "ending", "one_sentence", "n_chars", "last_word", F.coalesce(at, F.lit(False)).alias("at_limit"))
    # words inside a value are whole; only the last words of possible headlines are looked up
    maybe = (F.col("ending") == "open") & F.col("one_sentence") & (F.col("n_chars") <= HEADLINE)
    asked = placed.where(maybe).select("last_word").distinct()
    known = (
        df.select(F.explode(F.split(F.lower(F.regexp_replace(F.col(text), r"[\p{L}\p{N}'’-]+[^\p{L}\p{N}]*$", "")), r"[^\p{L}\p{N}'’-]+")).alias("last_word"))
        .distinct()
        .join(asked, "last_word", "left_semi")
        .withColumn("known", F.lit(True))
    )
    headline = maybe & F.coalesce("known", F.lit(False)) & ~F.col("last_word").isin(sorted(_LINKING))
    table = F.create_map(*[x for kind, (free, held) in SCORES.items() for x in (F.lit(kind), F.array(F.lit(free), F.lit(held)))])
    score = F.element_at(F.element_at(table, F.col("ending")), F.when(F.col("at_limit"), 2).otherwise(1)) - F.when(headline, MAY_BE_HEADLINE).otherwise(0.0)
    return placed.join(known, "last_word", "left").select("row_id", "source", "ending", "at_limit", (score >= CUT).alias("cut")), walls


def truncated(df: DataFrame, text: str = "summary", source: str = "source", key: str = "row_id") -> DataFrame:
    """row_id of each cut value; a repeated row counts under its own id."""
    return judged(df, text, source, key)[0].where("cut").select("row_id")


def truncation_rates(df: DataFrame, text: str = "summary", source: str = "source", key: str = "row_id") -> DataFrame:
    """source, n_rows, n_cut, share_cut, and where the source shows limits their measure, the one with most rows, and all of them in order; null is a source of its own."""
    rows, walls = judged(df, text, source, key)
    names = F.array(*[F.lit(m) for m in MEASURES])
    cuts = rows.where("cut").groupBy("source").agg(F.count("*").alias("n_cut")).withColumnRenamed("source", "cut_source")
    walls = walls.groupBy("source").agg(F.max("measure").alias("measure"), F.max_by("limit_at", F.struct("rows_at", "limit_at")).alias("limit_at"), F.array_sort(F.collect_list("limit_at")).alias("limits"))
    walls = walls.withColumnRenamed("source", "wall_source")
    total = df.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n_rows"))
    out = total.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").join(walls, F.col("source").eqNullSafe(F.col("wall_source")), "left")
    n_cut = F.coalesce("n_cut", F.lit(0))
    return out.select("source", "n_rows", n_cut.alias("n_cut"), (n_cut / F.col("n_rows")).alias("share_cut"), F.when(F.col("measure").isNotNull(), F.get(names, F.col("measure"))).alias("measure"), "limit_at", "limits")
