"""Problem 7: token ids of a byte-level BPE vocabulary, by longest match and backtracking.

A sequence of tokens is the BPE encoding of its bytes exactly if each two
neighbours are, by themselves, encoded as these two. So the encoder takes the
longest token at each place, and steps back to a shorter one where a pair of
neighbours fails that test. The test's answers are kept, and each pretoken's
ids as well, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talefold.llm.arrow import map_rows

DEFAULT_VOCABULARY = os.environ.get("TALEFOLD_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: How this family of tokenizers splits a text before merging (a fixed value of its vocabulary).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pretokens whose ids a task remembers; beyond that the memory is emptied, which changes no result.
MEMORY = 400_000


class Encoder:
    """Encodes by a table of ranks (tiktoken's format: base64 of the bytes, rank)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.token = {i: b for b, i in self.rank.items()}
        self.split = regex.compile(SPLIT).findall
        self.automaton = ahocorasick.Automaton()
        for word, i in self.rank.items():
            self.automaton.add_word(word.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self.memory: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; only for the compatibility of short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.fits.get((a, b))) is None:
            known = self.fits[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
            if len(self.fits) > 4 * MEMORY:
                self.fits.clear()
        return known

    def whole(self, a: int) -> bool:
        """Does merging the token's own bytes end in the token?"""
        if (known := self.sound.get(a)) is None:
            known = self.sound[a] = self.merge(self.token[a]) == [a]
        return known

    def encode_pretoken(self, data: bytes) -> list[int]:
        at: list[list[int]] = [[] for _ in data]  # at each place the tokens that begin there, the longest last
        for end, i in self.automaton.iter(data.decode("latin-1")):
            at[end - len(self.token[i]) + 1].append(i)
        dead = bytearray(len(data) + 1)  # places from which nothing fits
        ids: list[int] = []
        places = [0]
        untried = [list(at[0])]
        while places[-1] < len(data):
            left = untried[-1]
            while left:
                i = left.pop()
                end = places[-1] + len(self.token[i])
                if not dead[end] and self.whole(i) and (not ids or self.compatible(ids[-1], i)):
                    ids.append(i)
                    places.append(end)
                    untried.append(list(at[end]) if end < len(data) else [])
                    break
            else:
                dead[places.pop()] = 1
                untried.pop()
                ids.pop()
        return ids

    def ids(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty text or null."""
        out: list[int] = []
        memory = self.memory
        for piece in self.split(text) if text else ():
            known = memory.get(piece)
            if known is None:
                known = self.encode_pretoken(piece.encode("utf-8", "surrogatepass"))
                if len(memory) > MEMORY:
                    memory.clear()
                memory[piece] = known
            out += known
        return out


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id and ids of each row, in one pass without a shuffle.

    Null and empty texts get an empty list. Every row counts, repeated rows
    too; other columns are not read. The driver hands the vocabulary's file out
    to the executors.
    """
    shipped = os.path.isfile(vocabulary)
    if shipped:
        df.sparkSession.sparkContext.addFile(vocabulary)
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("t"))

    def make():
        import numpy as np

        encoder = _encoder(SparkFiles.get(os.path.basename(vocabulary)) if shipped else vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat: list[int] = []
            ends = [0]
            for t in batch.column(1).to_pylist():
                flat += encoder.ids(t)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            return pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

        return step

    return map_rows(rows, "doc_id bigint, ids array<int>", make, 500)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker process, kept for its next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
