"""Problem 8: passages of held-out items inside a corpus, by a generalised suffix automaton."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talefold.llm.arrow import map_rows
from talefold.session import stage

#: Consecutive words that make a leak.
LEAST_WORDS = 12
#: Words of items in one automaton; more items are matched block by block.
BLOCK_WORDS = 200_000
FOUND = "doc_id bigint, item_id bigint, longest int, first_word int, words_in_doc int"
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


def places(text: str) -> list[tuple[int, int]]:
    """Where each of `words(text)` begins and ends in the text."""
    low = text.lower()
    at = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return at
    origin = [k for k, c in enumerate(text) for _ in c.lower()]  # a letter may become two
    return [(origin[a], origin[b - 1] + 1) for a, b in at]


class SuffixAutomaton:
    """All word runs of all items in one automaton; each state knows the items it occurs in."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[set[int]] = [set()]
        for item, text in items:
            last = 0
            for w in text:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                self.items[last].add(item)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:  # an item of a state is one of its shorter suffixes too
                self.items[self.link[state]] |= self.items[state]

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # another item has come this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def matches(self, text: list[str], least: int) -> dict[int, tuple[int, int]]:
        """Each item that shares at least `least` consecutive words: the longest such run and where it begins."""
        codes = list(map(self.vocabulary.get, text))
        found: dict[int, tuple[int, int]] = {}
        if b"\1" * least not in bytes(c is not None for c in codes):
            return found  # a run of known words shorter than that can't hold a match
        state = run = 0
        for i, c in enumerate(codes):
            if c is None:
                state = run = 0
                continue
            while state and c not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                run += 1
            at, size = state, run
            seen: set[int] = set()
            while size >= least:  # shorter suffixes occur in more items
                for item in self.items[at] - seen:
                    if size > found.get(item, (0, 0))[0]:
                        found[item] = (size, i - size + 1)
                seen = self.items[at]
                at = self.link[at]
                size = self.length[at]
        return found

    def covered(self, text: list[str], least: int) -> list[tuple[int, int]]:
        """The words (from, to) that stand in some shared run of at least `least` words, in order and apart."""
        codes = list(map(self.vocabulary.get, text))
        found: list[tuple[int, int]] = []
        if b"\1" * least not in bytes(c is not None for c in codes):
            return found
        state = run = 0
        for i, c in enumerate(codes):
            if c is None:
                state = run = 0
                continue
            while state and c not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                run += 1
            if run >= least:
                start = i - run + 1
                if found and start <= found[-1][1]:
                    start = min(start, found.pop()[0])
                found.append((start, i + 1))
        return found


def blocks(items: list[tuple[int, str | None]], least: int, block_words: int) -> list[SuffixAutomaton]:
    out, block, size = [], [], 0
    for item, passage in items:
        text = words(passage or "")
        if len(text) < least:
            continue
        if block and size + len(text) > block_words:
            out.append(SuffixAutomaton(block))
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    return out + ([SuffixAutomaton(block)] if block else [])


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these words (from, to), which are in order and apart."""
    at = places(text)
    for start, end in reversed(spans):
        before, after = text[: at[start][0]], text[at[end - 1][1] :]
        text = (before.rstrip(" \t") if after[:1].isspace() else before) + after
    return text


def cut(text: str, automata: list[SuffixAutomaton], most_words: int, most_share: float, least: int) -> str | None:
    """The text without its leaked words; None if these are `most_words` or `most_share` of its words.

    What is left is searched again, as a cut may bring two parts of a passage together.
    """
    total = gone = 0
    while True:
        held = words(text)
        total = total or len(held)
        spans = united([s for a in automata for s in a.covered(held, least)])
        if not spans:
            return text
        gone += sum(end - start for start, end in spans)
        if gone >= most_words or gone >= most_share * total:
            return None
        text = without(text, spans)


#: Blocks of items with which one pass over the documents compares: the most that is broadcast at a time.
PASS_BLOCKS = 4


def _automata(items: DataFrame, least: int, block_words: int) -> list[DataFrame]:
    """The items' automata in groups of PASS_BLOCKS blocks, built by the executors and written to the shared folder."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("passage").cast("string").alias("passage")).where("item_id is not null and passage is not null")
    total = rows.agg(F.coalesce(F.sum(F.size(F.split("passage", r"[^\p{L}\p{N}]+"))), F.lit(0))).first()[0]
    parts = max(1, -(-total // block_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        for automaton in blocks(sorted(held), least, block_words):
            data = pickle.dumps(automaton, pickle.HIGHEST_PROTOCOL)
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["automaton"])

    dealt = rows.repartition(parts, "item_id")
    built = stage(dealt.mapInArrow(build, "automaton binary").withColumn("no", F.monotonically_increasing_id()), "leak-automata")
    numbers = [r[0] for r in built.select("no").orderBy("no").toLocalIterator()]  # one number for each block
    return [built.where(F.col("no").between(numbers[k], numbers[min(k + PASS_BLOCKS, len(numbers)) - 1])) for k in range(0, len(numbers), PASS_BLOCKS)]


def _passes(docs: DataFrame, groups: list[DataFrame], schema: str, step_of) -> DataFrame:
    """The rows that `step_of(automata)` makes of batches of documents, for each group of automata.

    With one group that is a lazy pass. With more, each pass is run and written
    before the next group is broadcast, and its broadcast is given up, so that
    driver and executors hold PASS_BLOCKS blocks at a time however many items
    there are.
    """
    spark = docs.sparkSession

    def one(group: DataFrame):
        shared = spark.sparkContext.broadcast([bytes(r[0]) for r in group.select("automaton").collect()])

        def make():
            automata = [pickle.loads(a) for a in shared.value]
            return lambda batch: step_of(automata, batch)

        return shared, map_rows(docs, schema, make, 1000)

    if len(groups) == 1:
        return one(groups[0])[1]
    out = spark.createDataFrame([], schema)
    for group in groups:
        shared, rows = one(group)
        out = out.unionByName(stage(rows, "leak-pass"))
        shared.destroy()
    return out


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("t"))


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and each item of which it holds `least` consecutive words (FOUND).

    `items` (item_id, passage) is the held-out set, a stated set against all
    documents, in blocks of at most `block_words` words each. Null and short
    texts and passages match nothing; a repeated document counts under each id;
    an item_id that comes twice counts as one item.
    """

    def step(automata: list[SuffixAutomaton], batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = words(t)
            best: dict[int, tuple[int, int]] = {}
            for automaton in automata:
                for item, hit in automaton.matches(text, least).items():
                    best[item] = max(best.get(item, (0, 0)), hit)
            for item, (size, first) in best.items():
                for col, value in zip(cols, (doc, item, size, first, len(text))):
                    col.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "longest", "first_word", "words_in_doc"])

    return _passes(_docs(docs).where("t is not null"), _automata(items, least, block_words), FOUND, step)


SPAN = "doc_id bigint, text_hash bigint, first_word int, end_word int, words_in_doc int"


def _spans(docs: DataFrame, groups: list[DataFrame], least: int) -> DataFrame:
    """SPAN rows, apart and in order within a document; those of several passes are united."""

    def step(automata: list[SuffixAutomaton], batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(5)]
        for doc, t, text_hash in zip(*(batch.column(i).to_pylist() for i in range(3))):
            text = words(t)
            for start, end in united([s for a in automata for s in a.covered(text, least)]):
                for col, value in zip(cols, (doc, text_hash, start, end, len(text))):
                    col.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "text_hash", "first_word", "end_word", "words_in_doc"])

    rows = _passes(docs.where("t is not null").withColumn("text_hash", F.xxhash64("t")), groups, SPAN, step)
    if len(groups) == 1:
        return rows
    by = Window.partitionBy("doc_id", "text_hash").orderBy("first_word", "end_word")
    before = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first_word") <= F.col("before"), 0).otherwise(1)).over(by)
    rows = rows.distinct().withColumn("before", before).withColumn("island", island)
    return rows.groupBy("doc_id", "text_hash", "island").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.max("words_in_doc").alias("words_in_doc")).drop("island")


def leaked_spans(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, first_word, end_word (past the last), words_in_doc: all words of a document that stand in runs shared with items, whichever these are.

    Spans that overlap or touch are one. A document that comes twice with one id and text has its spans twice.
    """
    return _spans(_docs(docs), _automata(items, least, block_words), least).drop("text_hash")


def without_leaks(docs: DataFrame, items: DataFrame, most_words: int = 50, most_share: float = 0.5, least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text: the documents to keep, without the words that they share with items in runs of at least `least`.

    A document is dropped if all such words together, of whatever items, are
    `most_words` or `most_share` of its words. Null texts are kept; each row is
    judged by its own text. What is left after a cut is searched again, as it may
    bring two parts of a passage together.
    """
    groups = _automata(items, least, block_words)
    rows = _docs(docs)
    if len(groups) != 1:
        return _without_in_passes(rows, groups, most_words, most_share, least) if groups else rows.withColumnRenamed("t", "text")

    def step(automata: list[SuffixAutomaton], batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = [], []
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rest = None if t is None else cut(t, automata, most_words, most_share, least)
            if t is None or rest is not None:
                ids.append(doc)
                texts.append(rest)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _passes(rows, groups, "doc_id bigint, text string", step)


def _without_in_passes(rows: DataFrame, groups: list[DataFrame], most_words: int, most_share: float, least: int) -> DataFrame:
    """without_leaks() where the items need several passes: documents with spans are cut and searched again until none has any."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [without(t, [(s["first_word"], s["end_word"]) for s in found or []]) for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(3), batch.column(4)], ["doc_id", "t", "gone", "total"])

    open_rows = rows.withColumn("gone", F.lit(0)).withColumn("total", F.lit(None).cast("int"))
    kept = rows.where("false").select("doc_id", F.col("t").alias("text"))
    while True:
        spans = _spans(open_rows.select("doc_id", "t").where("t is not null").distinct(), groups, least)
        listed = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias("spans"), F.sum(F.col("end_word") - F.col("first_word")).cast("int").alias("now"), F.max("words_in_doc").alias("words_in_doc"))
        keys = open_rows.withColumn("text_hash", F.xxhash64("t"))
        hit = keys.join(listed.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (keys["text_hash"] == listed["text_hash"]), "left")
        hit = stage(hit.select("doc_id", "t", "spans", (F.col("gone") + F.coalesce("now", F.lit(0))).alias("gone"), F.coalesce("total", "words_in_doc").alias("total")), "leak-hits")
        kept = kept.unionByName(hit.where("spans is null").select("doc_id", F.col("t").alias("text")))
        left = hit.where(F.col("spans").isNotNull() & (F.col("gone") < most_words) & (F.col("gone") < most_share * F.col("total")))
        if left.isEmpty():
            return kept
        open_rows = stage(left.mapInArrow(remove, "doc_id bigint, t string, gone int, total int"), "leak-cut")
