"""Problem 1: cut oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talefold.llm.arrow import map_rows

PIECE = "tbl string, row_id bigint, piece_no int, n_pieces int, start_at int, end_at int, overlap int, piece string"
_TOKEN = re.compile(r"\s*\S+\s*", re.S)
_PARAGRAPH_END = re.compile(r"\n[^\S\n]*\n\s*$")
_SENTENCE_END = re.compile(r"""[.!?…。！？]["'”’»)\]]*\s+$""")
_NEWLINE_END = re.compile(r"\n\s*$")


def normalised(text: Column) -> Column:
    """CRLF to LF, white space (in Unicode's sense) taken off both ends."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"(?U)^\s+|\s+$", "")


def boundaries(text: str) -> tuple[list[int], list[list[int]]]:
    """Offsets of token ends, and those of them that end a paragraph, sentence or line, a sentence, a word.

    A token is a run of visible characters with the white space after it;
    the prefix sums of the token lengths are the offsets, sorted as they come.
    """
    tokens = _TOKEN.findall(text)
    ends = list(accumulate(map(len, tokens)))
    para, sent = [], []
    for token, end in zip(tokens, ends):
        if token[-1].isspace():
            if _PARAGRAPH_END.search(token):
                para.append(end)
                sent.append(end)
            elif _SENTENCE_END.search(token) or _NEWLINE_END.search(token):
                sent.append(end)
    return ends, [para, sent, ends]


def _hard_cut(text: str, start: int, end: int) -> int:
    """A cut inside a long word; combining marks stay with their letter where that is possible."""
    at = end
    while at > start + 1 and 0x300 <= ord(text[at]) <= 0x36F:
        at -= 1
    return at if at > start + 1 else end


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece: at most `limit` characters, repeating at most `overlap` of the piece before.

    The last boundary under the limit is found by binary search, first among
    paragraph ends, then sentence ends, then word ends; paragraph and sentence
    ends must leave at least half a piece. Without any, the cut is hard.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be 0 or more and less than limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    ends, levels = boundaries(text)
    out, start, done = [], 0, 0
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        end = 0
        for level, least in zip(levels, (limit // 2, limit // 2, 1)):
            k = bisect_right(level, start + limit) - 1
            if k >= 0 and level[k] >= max(start + least, done + 1):
                end = level[k]
                break
        else:
            end = _hard_cut(text, max(start, done), start + limit)
        out.append((start, end))
        done = end
        k = bisect_left(ends, end - overlap)
        start = ends[k] if k < len(ends) and ends[k] <= end else end
        if start == end and end not in ends and overlap:
            start = end - overlap  # a cut inside a long word repeats its characters


def pieces(df: DataFrame, tbl: str, text: str, limit: int, overlap: int, key: str = "row_id") -> DataFrame:
    """One row per piece of each oversized `text` (PIECE); rows within the limit have no pieces.

    Only oversized rows leave the JVM. Null and blank texts have none; a
    repeated row is cut again under its own key; other columns are not read.
    """
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), normalised(F.col(text)).alias("t")).where(F.length("t") > limit)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            for row_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = cut(t, limit, overlap)
                before = 0
                for no, (start, end) in enumerate(spans, 1):
                    for col, value in zip(cols, (tbl, row_id, no, len(spans), start, end, max(0, before - start), t[start:end])):
                        col.append(value)
                    before = end
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), *[pa.int32()] * 5, pa.string()))],
                ["tbl", "row_id", "piece_no", "n_pieces", "start_at", "end_at", "overlap", "piece"],
            )

        return step

    return map_rows(rows, PIECE, make, 200)


def oversized(df: DataFrame, tbl: str, text: str, limit: int, overlap: int) -> DataFrame:
    """The rows that the splitter cuts: tbl, row_id."""
    return pieces(df, tbl, text, limit, overlap).where("piece_no = 1").select("tbl", "row_id")
