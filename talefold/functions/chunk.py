"""The story chunker and the formatter of extracted text: sequential rules, run as Arrow-batched functions.

Both lay out a text once as sorted arrays of places (where words, runs of signs,
sentences and lines begin and end) and then find each cut by binary search, so a
text of any length costs its length plus a logarithm for each piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What separates paragraphs, marks that no chunk begins with, dashes, the least reach for a sentence's start, and the least piece.
_BREAK = re.compile(r"\n\s*\n+")
_LEADING = "\"'`“”‘’.,;:!?)-–—"
_DASHES = "-–—"
_LEAST_REACH, _LEAST_PIECE = 60, 50


class Runs:
    """Runs of characters of one kind, by their sorted begins and ends."""

    def __init__(self, pattern: str, text: str):
        spans = [m.span() for m in re.finditer(pattern, text)]
        self.begins, self.ends, self.n = [a for a, _ in spans], [b for _, b in spans], len(text)

    def around(self, at: int) -> tuple[int, int]:
        """Begin and end of the run whose characters lie on both sides of `at`; (at, at) where none does."""
        k = bisect_left(self.begins, at) - 1
        return (self.begins[k], self.ends[k]) if k >= 0 and at < self.ends[k] else (at, at)

    def end_at(self, at: int) -> int:
        """The end of the run that holds the character at `at`; `at` where none does."""
        k = bisect_right(self.begins, at) - 1
        return self.ends[k] if k >= 0 and at < self.ends[k] else at

    def first_from(self, at: int) -> int:
        """The first place from `at` on that lies in a run; the text's end where none follows."""
        k = bisect_right(self.ends, at)
        return max(at, self.begins[k]) if k < len(self.ends) else self.n


class Layout:
    """One long paragraph: its words, its solid (unspaced) stretches, its leading marks, and the spaces after which a sentence may begin."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.words, self.solid, self.marks = Runs(r"[^\W_]+", text), Runs(r"\S+", text), Runs(f"[{re.escape(_LEADING)}]+", text)
        self.gaps = [m.start() for m in re.finditer(r"\n|(?<=[.!?])\s", text)]

    def resumed(self, at: int, reach: int) -> int:
        """A lower-case start within a sentence gives way to the next sentence, if that one begins before `reach`."""
        if at < reach and self.text[at].islower() and self.text[at - 1] not in "\n\r.!?":
            k = bisect_left(self.gaps, at)
            if k < len(self.gaps) and self.gaps[k] < reach:
                return self.solid.first_from(self.gaps[k])
        return at

    def opening(self, at: int, overlap: int) -> int:
        """Where a later piece begins that may begin at `at`: at a word, a sentence if one is near, and no leading mark."""
        at = self.solid.first_from(self.words.around(at)[1])
        reach = min(self.n, at + max(_LEAST_REACH, overlap))
        at = self.resumed(at, reach)
        if at < reach:
            at = min(self.marks.end_at(at), reach)
        return self.resumed(self.solid.first_from(at), reach)

    def closing(self, start: int, at: int, limit: int) -> int:
        """Where a piece from `start` ends that may end at `at`: at a word's end, and before a word whose hyphen would dangle."""
        if at >= self.n:
            return self.n
        at = max(start, self.words.around(at)[0])
        if at > start + 1 and self.text[at - 1] in _DASHES and self.text[at].isalpha():
            at = max(start + 1, self.solid.around(at)[0])
        return at if at > start + _LEAST_PIECE else min(self.n, start + limit)

    def pieces(self, limit: int, overlap: int) -> list[str]:
        spans: list[tuple[int, int]] = []
        at = 0
        while not spans or spans[-1][1] < self.n:
            start = self.opening(at, overlap) if spans else 0
            if start >= self.n:
                break
            spans.append((start, self.closing(start, min(self.n, at + limit), limit)))
            back = spans[-1][1] - overlap
            # an endless word could hold the window back; then it goes on without an overlap
            at = back if back > at else max(spans[-1][1], at + 1)
        return [piece for a, b in spans if (piece := self.text[a:b].strip())]


def _packs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """(from, to) of paragraphs that go into one chunk, two line ends between each; one over the limit stands alone."""
    filled = [0, *accumulate(size + 2 for size in sizes)]
    out: list[tuple[int, int]] = []
    first = 0
    while first < len(sizes):
        last = max(first + 1, bisect_right(filled, filled[first] + most + 2) - 1)
        out.append((first, last))
        first = last
    return out


def chunk_text(text: str | None, max_chars: int = 1800, overlap_chars: int = 200, least_words: int = 20) -> list[str]:
    """Chunks of up to about max_chars: whole paragraphs packed together, long ones in overlapping windows.

    Chunks of fewer than least_words words go, unless all are that short. Null
    and blank texts have no chunks.
    """
    text = (text or "").replace("\r\n", "\n").strip()
    paragraphs = [p for p in map(str.strip, _BREAK.split(text)) if p]
    chunks: list[str] = []
    for first, last in _packs([len(p) for p in paragraphs], max_chars):
        whole = "\n\n".join(paragraphs[first:last])
        chunks += [whole] if len(whole) <= max_chars else Layout(whole).pieces(max_chars, overlap_chars)
    return [c for c in chunks if len(c.split()) >= least_words] or chunks


def chunks_of(text: Column, max_chars: int = 1800, overlap_chars: int = 200, least_words: int = 20) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, max_chars, overlap_chars, least_words))

    return split(text)


def chunked(df: DataFrame, title: str, text: str, max_chars: int = 1800, overlap_chars: int = 200, least_words: int = 20) -> DataFrame:
    """df's rows once for each chunk: chunk_no from 1, chunk_id `{title}_chunk_{no}`, chunk."""
    rows = df.select("*", F.posexplode(chunks_of(F.col(text), max_chars, overlap_chars, least_words)).alias("chunk_no", "chunk"))
    rows = rows.withColumn("chunk_no", F.col("chunk_no") + 1)
    return rows.withColumn("chunk_id", F.concat(F.col(title), F.lit("_chunk_"), F.col("chunk_no").cast("string")))


def packed_paragraphs(text: Column, max_chars: int = 1800) -> Column:
    """The packing rule alone, in the JVM; a paragraph over the limit is a piece of its own."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n+"), F.trim), lambda p: p != "")
    empty = F.array().cast("array<string>")

    def add(acc: Column, p: Column) -> Column:
        fits = (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(p) + 2 <= max_chars)
        last = F.concat(F.element_at(acc, -1), F.lit("\n\n"), p)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(last))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(paragraphs, empty, add)


# Headings and page numbers of extracted books.
_OPENER = re.compile(r"[A-Z0-9][A-Z0-9\s\-–—]{5,}|\d{1,4}")


def format_extracted(text: str | None, full: int = 400) -> str:
    """Paragraphs of extracted book text: a heading or page number opens one, a sentence end closes a long one.

    Lines are trimmed, blank ones dropped. A paragraph of lines i to j has
    ends[j] - ends[i] - 1 characters; the first sentence end that makes it long
    enough is found in the sorted list of such ends. Null texts give "".
    """
    lines = [line for line in map(str.strip, re.split(r"\r\n?|\n", text or "")) if line]
    ends = [0, *accumulate(len(line) + 1 for line in lines)]
    openers = [k for k, line in enumerate(lines) if _OPENER.fullmatch(line)] + [len(lines)]
    stops = [k + 1 for k, line in enumerate(lines) if line[-1] in ".?!"]
    stop_ends = [ends[k] for k in stops]
    out: list[str] = []
    first = 0
    while first < len(lines):
        last = openers[bisect_right(openers, first)]
        k = bisect_left(stop_ends, ends[first] + full + 1)
        if k < len(stops):
            last = min(last, stops[k])
        out.append(re.sub(r"[ \t]+", " ", " ".join(lines[first:last])))
        first = last
    return "\n\n".join(out)


@F.pandas_udf(StringType())
def formatted(texts: pd.Series) -> pd.Series:
    return texts.map(format_extracted)
