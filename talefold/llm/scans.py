"""Problem 5: traces of page scans: split words, misread letters, page furniture. Found and repaired.

Misread words are looked up in a trie of the collection's own vocabulary by a
Levenshtein automaton: a walk over trie and word at once that allows a bounded
cost of edits, where a confusion that scanners make (e for c, m for rn) costs
two and any other edit three. Such a walk finds every word within the bound.
Candidates are ranked by their frequency and by how often they stand beside the
word's neighbours; a word counts as misread where the best of them is so many
times likelier than the word itself.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talefold.llm.arrow import add_slices, batches, map_rows, sum_counts
from talefold.session import stage

#: Texts a word of the vocabulary stands in, at least: a word of one text tells nothing about others.
LEAST_TEXTS = 2
#: Words of the vocabulary in one trie, at most; of more words, several tries are asked one after the other.
BLOCK = 1_000_000
#: A word may be a misreading of one that is so many times as frequent, by confusions of scanners and by any other edit.
RATIO, ANY_RATIO = 40, 2000
#: The ratio for capitalised words, and for words shorter than MISREAD_LENGTH, which are oftener rare words of their own.
STRICT_RATIO, MISREAD_LENGTH = 200, 4
#: What a ratio is multiplied by for each neighbour that the candidate is known to stand beside (the word itself is not), or the other way round.
BESIDE = 2.0
#: Edits' cost within which words are candidates: two confusions or one other edit.
CONFUSED, EDITED, MOST_COST = 2, 3, 4
#: Buckets in which neighbouring words, and texts of any word, are counted (4 MB each, whatever the size of the collection).
CONTEXT_BUCKETS, OWN_BUCKETS, SLICES = 1 << 20, 1 << 20, 64

# What a scanner reads, and what was printed.
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("b", "h"), ("h", "b"), ("li", "h"),
    ("ii", "u"), ("ll", "u"), ("iii", "m"), ("0", "o"), ("o", "0"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("2", "z"), ("4", "a"), ("7", "t"), ("†", "t"),
    ("tl", "d"), ("t", "f"), ("f", "t"), ("u", "n"), ("n", "u"), ("v", "y"), ("y", "v"), ("fi", "h"), ("uri", "un"), ("j", "i"),
    ("0", "о"), ("3", "з"), ("6", "б"), ("н", "и"), ("и", "н"), ("щ", "ш"), ("ш", "щ"), ("п", "л"), ("л", "п"), ("с", "о"), ("о", "с"), ("о", "е"), ("ь", "ы"), ("ц", "ш"), ("4", "ч"), ("в", "б"), ("т", "г"),
]
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _read, _printed in CONFUSIONS:
    _BY_FIRST.setdefault(_read[0], []).append((_read, _printed))

_ALPHA = r"[^\W\d_]"
_WORD = re.compile(rf"(?:{_ALPHA}|[0-9†](?=[0-9†]?{_ALPHA})|(?<={_ALPHA})[0-9†])+")
_MIXED = re.compile(r"[0-9†]")
_ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|er|e|º|ª|s)$|^[a-z]{1,2}\d+$", re.I)
_SPLIT = re.compile(rf"(?<={_ALPHA})([-¬­])([ \t]*)\r?\n[ \t|~]*({_ALPHA}+)")
_LEFT = re.compile(rf"{_ALPHA}+\Z")
_TOKEN = re.compile(r"[\w†]+")
_NUMBER = r"(?:\d{1,4}|(?-i:[ivxlcdm]{1,8}))"
_MARK = r"(?:p\.|pp\.|pg\.|page|seite|s\.|pág\.|página|стр\.|[-–—\[(~|•·*])"
_PAGE_LINE = re.compile(rf"^[|~\s]*(?:{_MARK}\s*)*{_NUMBER}\s*[-–—\])~|•·*]*\s*$", re.I)
_HEADING_LINE = re.compile(rf"^[|~\s]*\S.{{1,70}}?\s{{2,}}(?:{_MARK}\s*)*{_NUMBER}\s*[-–—\])~|•·*.\s]*$", re.I)
_NUMBER_HEADING_LINE = re.compile(rf"^[|~\s]*(?:{_MARK}\s*)*{_NUMBER}\s*[-–—\])~|]*\s{{2,}}\S.{{1,70}}$", re.I)
_MARKED_HEADING = re.compile(r"^[|~\s]*[^a-zа-яß-ÿ\n]{4,70}\s(?:[-–—]\s?\d{1,4}\s?[-–—]|\[\d{1,4}\]|p\.\s?\d{1,4}|Page\s\d{1,4})\s*$")
_CHAPTER_LINE = re.compile(r"^[|~\s]*(?:CHAPTER|KAPITEL|CHAPITRE|CAPÍTULO|ГЛАВА)\s+[\w.]+\s*[·.]?\s*$")
_CAPITAL_LINE = re.compile(r"^[|~\s]*[A-ZÀ-ÞА-ЯЁ][A-ZÀ-ÞА-ЯЁ' .’-]{5,60}[.·]?\s*$")
_BAR = re.compile(r"(?m)^[|~](?=\s)")


def furniture(text: str) -> list[int]:
    """Numbers of the lines that are page headings or page numbers; a heading on the first line alone is none."""
    lines = re.split(r"\n|\f", text)
    out, begun = [], False
    for no, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            continue
        if begun and (_PAGE_LINE.match(line) or _CHAPTER_LINE.match(line)) or _HEADING_LINE.match(line) or _MARKED_HEADING.match(line) or _NUMBER_HEADING_LINE.match(line):
            out.append(no)
        elif _PAGE_LINE.match(line) and any(c.isdigit() for c in bare):
            out.append(no)  # a page number before the text
        elif not _CHAPTER_LINE.match(line):
            begun = True
    return out if begun else []


class Trie:
    """The vocabulary, as nested dictionaries; the empty string marks a word's end."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def candidates(self, word: str, most: int = MOST_COST) -> dict[str, int]:
        """Every word of the trie within `most` of `word`, with its cost."""
        found: dict[str, int] = {}
        seen: dict[tuple[int, int], int] = {}
        stack = [(0, self.root, 0)]
        n = len(word)
        while stack:
            i, node, cost = stack.pop()
            state = (i, id(node))
            if seen.get(state, most + 1) <= cost:
                continue
            seen[state] = cost
            if i == n and "" in node:
                found[node[""]] = min(cost, found.get(node[""], cost))
            if i < n and word[i] in node:
                stack.append((i + 1, node[word[i]], cost))
            if cost + CONFUSED <= most and i < n:
                for read, printed in _BY_FIRST.get(word[i], ()):
                    if word.startswith(read, i):
                        to = node
                        for c in printed:
                            if (to := to.get(c)) is None:
                                break
                        else:
                            stack.append((i + len(read), to, cost + CONFUSED))
            if cost + EDITED <= most:
                if i < n:
                    stack.append((i + 1, node, cost + EDITED))
                for c, to in node.items():
                    if c:
                        stack.append((i, to, cost + EDITED))
                        if i < n and c != word[i]:
                            stack.append((i + 1, to, cost + EDITED))
        return found


class Vocabulary:
    """What a collection tells of words: texts of each (one block of them), texts of any word by bucket, and neighbours by bucket."""

    def __init__(self, count: dict[str, int], own: np.ndarray, context: np.ndarray, most: int):
        self.count, self.own, self.context, self.most, self.key = count, own, context, most, uuid.uuid4().hex


class Reader:
    """Judges and repairs texts by a vocabulary."""

    def __init__(self, v: Vocabulary):
        self.count, self._own, self.context, self.most = v.count, v.own, v.context, v.most
        self.trie = Trie(w for w in v.count if len(w) > 2 and "-" not in w)
        self.memory: dict[str, list[tuple[str, int]]] = {}
        self.common = {w for w, n in v.count.items() if n * RATIO > v.most}

    def own(self, word: str) -> int:
        """Texts that hold the word: exact if it is in the vocabulary, else never too few."""
        n = self.count.get(word)
        return n if n is not None else int(self._own[bucket(word, OWN_BUCKETS)])

    def printed(self, word: str) -> list[tuple[str, int]]:
        """What `word` may be a misreading of, the cheapest and most frequent first; empty for a word that stands for itself."""
        known = self.memory.get(word)
        if known is None:
            mixed = _MIXED.search(word) is not None
            own = 0 if mixed else max(1, self.own(word))
            if len(word) < 3 or (mixed and _ORDINAL.match(word)) or own * RATIO > self.most * BESIDE**2:
                known = []
            else:
                found = self.trie.candidates(word)
                known = sorted(((w, c) for w, c in found.items() if c and self.count[w] * BESIDE**2 >= own * RATIO), key=lambda x: (x[1], -self.count[x[0]]))
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[word] = known
        return known

    def beside(self, before: str, word: str, after: str) -> tuple[bool, bool]:
        """Is the word known to follow the one before it, and to precede the one after it, in other places too?"""
        seen = lambda a, b: bool(a and b) and self.context[bucket(f"{a} {b}", CONTEXT_BUCKETS)] > 1
        return seen(before, word), seen(word, after)

    def likelihood(self, before: str, word: str, after: str, candidate: str) -> float:
        """How many times likelier the candidate is than the word, by frequency and neighbours."""
        gain = sum(self.beside(before, candidate, after)) - sum(self.beside(before, word, after))
        return self.count[candidate] / max(1, self.own(word)) * BESIDE**gain

    def misread(self, word: str, before: str, after: str) -> bool:
        """Does a word of letters alone show a scan? Capitalised and short ones by STRICT_RATIO."""
        low = word.lower()
        if len(word) < MISREAD_LENGTH - 1 or low in self.common or not word[1:].islower():
            return False
        short = len(word) < MISREAD_LENGTH
        if short and not word.islower():
            return False  # abbreviations and short names
        least = STRICT_RATIO if short or not word.islower() else RATIO
        return any(self.likelihood(before, low, after, w) >= (least if cost != EDITED else ANY_RATIO) and (cost != EDITED or len(word) > MISREAD_LENGTH) for w, cost in self.printed(low))

    def split(self, m: re.Match) -> bool:
        """Is a word split at this line's end, rather than a compound that has its hyphen there?"""
        sign, gap, right = m.groups()
        if sign != "-" or gap:
            return True
        left, right = _LEFT.search(m.string[max(0, m.start() - 60) : m.start()]).group().lower(), right.lower()
        return not (f"{left}-{right}" in self.count and (left + right) not in self.count)

    def traces(self, text: str) -> tuple[int, int, int, int]:
        """Split words, words with digits or signs in them, other misread words, lines of page furniture (and margin signs)."""
        splits = sum(self.split(m) for m in _SPLIT.finditer(text)) if "\n" in text else 0
        lines = len(furniture(text)) + len(_BAR.findall(text)) + text.count("\f") if "\n" in text else 0
        tokens = _TOKEN.findall(_SPLIT.sub(r"\3", text) if splits else text)
        mixed = strange = misread = 0
        for word in set(tokens):
            if not word.isalpha():
                letters = _MIXED.sub("", word)
                if not letters.isalpha() or 2 * len(letters) < len(word) or _ORDINAL.match(word):
                    continue
                if (letters.isascii() and letters.isupper()) or letters[1:].islower() or len(letters) < 2:  # other cases come from wrong encodings
                    if self.printed(word.lower()):
                        mixed += 1
                    else:
                        strange += 1
            elif (low := word.lower()) not in self.common and self.printed(low):
                at = tokens.index(word)
                before, after = tokens[at - 1].lower() if at else "", tokens[at + 1].lower() if at + 1 < len(tokens) else ""
                misread += self.misread(word, before, after)
        if strange and (mixed or misread or splits or lines):
            mixed += strange  # beside other traces a sign in an unknown word is one too
        return splits, mixed, misread, lines

    def is_scan(self, text: str) -> bool:
        return any(self.traces(text))

    def _best(self, before: str, word: str, after: str) -> str:
        """The candidate that its neighbours make likeliest; the word itself where none is likely enough."""
        low = word.lower()
        found = self.printed(low)
        if not _MIXED.search(word):
            found = [x for x in found if self.likelihood(before, low, after, x[0]) >= (RATIO if x[1] != EDITED else ANY_RATIO)]
        if not found:
            return word
        cheapest = found[0][1]

        def rank(w: str, cost: int) -> float:
            seen = math.log1p(self.context[bucket(f"{before} {w}", CONTEXT_BUCKETS)]) + math.log1p(self.context[bucket(f"{w} {after}", CONTEXT_BUCKETS)])
            return seen + 0.3 * math.log1p(self.count[w]) - 1.5 * (cost - cheapest)

        best = max(found, key=lambda x: rank(*x))[0]
        return best.upper() if word.isupper() and len(word) > 1 else best.capitalize() if word[0].isupper() or (not word[0].isalpha() and before == "") else best

    def repair(self, text: str) -> str:
        """The text without page furniture, its words whole and read again, as continuous paragraphs."""
        drop = set(furniture(text))
        lines = [("" if no in drop else re.sub(r"^[|~]\s", "", line)) if no not in drop else None for no, line in enumerate(re.split(r"\n|\f", text))]
        out: list[str] = []
        for k, line in enumerate(lines):
            if line is None:
                # blank lines around furniture belong to the page, not to the text
                while out and not out[-1].strip():
                    out.pop()
                continue
            if not line.strip() and (not out or (k and lines[k - 1] is None)):
                continue
            out.append(line)
        text = "\n".join(out)
        text = _SPLIT.sub(lambda m: ("" if self.split(m) else "-") + m.group(3), text)
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n|\n(?=[ \t]{2,}\S)", text)]
        return "\n\n".join(self._read(p) for p in paragraphs if p)

    def _read(self, paragraph: str) -> str:
        found = list(_WORD.finditer(paragraph))
        out, at = [], 0
        for k, m in enumerate(found):
            word = m.group()
            low = word.lower()
            if _MIXED.search(word) or (low not in self.common and word[1:].islower()):  # what `misread` may count
                before = found[k - 1].group().lower() if k else ""
                after = found[k + 1].group().lower() if k + 1 < len(found) else ""
                out += [paragraph[at : m.start()], self._best(before, word, after)]
                at = m.end()
        return "".join(out) + paragraph[at:]


def bucket(key: str, buckets: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(key) % buckets


#: Words a task counts before it hands them on, and pairs whose bucket it remembers.
TALLY = 500_000
_COMPOUND = re.compile(rf"{_ALPHA}+(?:-{_ALPHA}+)?")


def _tally_batch(words: list[str], counts: list[int], slices: list[int | None], blobs: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], ["w", "n", "slice", "counts"])


def vocabularies(texts: DataFrame) -> list[Callable[[], Broadcast]]:
    """For each block of at most BLOCK words of the collection's Vocabulary a function that broadcasts it.

    One pass over all texts counts the texts of each word and the neighbours of
    words; each task adds up its own first. A word stands in the vocabulary from
    LEAST_TEXTS texts on, whatever the size of the collection. What the driver
    holds at a time is one block and two arrays of fixed size.
    """

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seen: Counter[str] = Counter()
        pairs = np.zeros(CONTEXT_BUCKETS, np.int64)
        memory: dict[tuple[str, str], int] = {}
        for part in parts:
            for piece in batches(part, 1000):
                found: list[int] = []
                for t in piece.column(0).to_pylist():
                    words = _COMPOUND.findall(t.lower())
                    once = set(words)
                    seen.update(once.union(*(w.split("-") for w in once if "-" in w)))
                    for pair in zip(words, words[1:]):
                        if (b := memory.get(pair)) is None:
                            if len(memory) > TALLY:
                                memory.clear()
                            b = memory[pair] = bucket(f"{pair[0]} {pair[1]}", CONTEXT_BUCKETS)
                        found.append(b)
                pairs += np.bincount(np.array(found, np.int64), minlength=CONTEXT_BUCKETS)
                if len(seen) > TALLY:
                    yield _tally_batch(list(seen), list(seen.values()), [None] * len(seen), [None] * len(seen))
                    seen.clear()
        if seen:
            yield _tally_batch(list(seen), list(seen.values()), [None] * len(seen), [None] * len(seen))
        if pairs.any():
            pack = zstandard.ZstdCompressor(3).compress
            yield _tally_batch([""] * SLICES, [0] * SLICES, list(range(SLICES)), [pack(s.tobytes()) for s in np.split(pairs, SLICES)])

    spark = texts.sparkSession
    tallies = stage(texts.mapInArrow(tally, "w string, n bigint, slice int, counts binary"), "scan-tallies")
    context = np.minimum(add_slices(tallies.where("slice is not null").select("slice", "counts"), CONTEXT_BUCKETS, SLICES), (1 << 31) - 1).astype(np.int32)
    counts = stage(tallies.where("slice is null").groupBy("w").agg(F.sum("n").alias("n")), "scan-words")

    def bucketed():
        def step(batch: pa.RecordBatch) -> np.ndarray:
            at = np.fromiter((bucket(w, OWN_BUCKETS) for w in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            return np.bincount(at, np.asarray(batch.column(1), np.float64), OWN_BUCKETS).astype(np.int64)

        return step

    own = np.minimum(sum_counts(counts.select("w", "n"), bucketed, OWN_BUCKETS), (1 << 31) - 1).astype(np.int32)
    known = counts.where(F.col("n") >= LEAST_TEXTS)
    n, most = known.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK))

    def block(k: int) -> Broadcast:
        mine = known.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == k) if blocks > 1 else known
        return spark.sparkContext.broadcast(Vocabulary({r["w"]: r["n"] for r in mine.toLocalIterator()}, own, context, most))

    return [partial(block, k) for k in range(blocks)]


def _texts(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """tbl, row_id, t of all tables; null and empty texts are left out."""
    out = None
    for df, tbl, text in parts:
        one = df.select(F.lit(tbl).alias("tbl"), F.col("row_id").cast("bigint").alias("row_id"), F.col(text).alias("t")).where(F.length("t") > 0)
        out = one if out is None else out.unionByName(one)
    return out


TRACES = ["splits", "mixed", "misread", "furniture"]


def _traced(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """tbl, row_id, text_hash and TRACES of the rows that show some by one block of the vocabulary."""

    def make():
        reader = _reader(shared)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, numbers = [], []
            for k, t in enumerate(batch.column(2).to_pylist()):
                got = reader.traces(t)
                if any(got):
                    keep.append(k)
                    numbers.append(got)
            at = pa.array(keep, pa.int64())
            cols = [pa.array([x[c] for x in numbers], pa.int32()) for c in range(4)]
            return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in (0, 1, 3)], *cols], ["tbl", "row_id", "text_hash", *TRACES])

        return step

    return map_rows(texts.withColumn("text_hash", F.xxhash64("t")), "tbl string, row_id bigint, text_hash bigint, splits int, mixed int, misread int, furniture int", make)


def scanned(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """tbl, row_id, splits, mixed, misread, furniture: the rows of (table, its name, its text column) that show traces of a scan.

    One vocabulary is counted over all given tables. Null and blank texts show
    nothing; a repeated row counts under its own id. A vocabulary of several
    blocks takes a pass for each, of which one is broadcast at a time; a row's
    traces are then the most that one block shows, and rows of one id and text
    come once.
    """
    texts = _texts(parts)
    blocks = vocabularies(texts.select("t"))
    if len(blocks) == 1:
        return _traced(texts, blocks[0]()).drop("text_hash")
    out = None
    for block in blocks:
        shared = block()
        rows = stage(_traced(texts, shared), "scan-pass")
        shared.destroy()
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("tbl", "row_id", "text_hash").agg(*[F.max(c).alias(c) for c in TRACES]).drop("text_hash")


def _mended(texts: DataFrame, shared: Broadcast, all_rows: bool) -> DataFrame:
    """tbl, row_id, t, hit: each text that shows traces repaired, the others left out unless `all_rows`."""

    def make():
        reader = _reader(shared)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, out, hits = [], [], []
            for k, (t, hit) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                found = reader.is_scan(t)
                if found or all_rows or hit:
                    keep.append(k)
                    out.append(reader.repair(t) if found or hit else t)
                    hits.append(found or hit)
            at = pa.array(keep, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.string()), pa.array(hits, pa.bool_())], ["tbl", "row_id", "t", "hit"])

        return step

    return map_rows(texts, "tbl string, row_id bigint, t string, hit boolean", make)


def repaired(parts: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """tbl, row_id, repaired: the text of each scanned row as continuous paragraphs; several blocks repair it one after the other."""
    texts = _texts(parts)
    blocks = vocabularies(texts.select("t"))
    rows = texts.withColumn("hit", F.lit(False))
    for k, block in enumerate(blocks):
        shared = block()
        rows = _mended(rows, shared, k + 1 < len(blocks))
        if len(blocks) > 1:
            rows = stage(rows, "scan-repair")
            shared.destroy()
    return rows.where("hit").select("tbl", "row_id", F.col("t").alias("repaired"))


_READERS: dict[str, Reader] = {}


def _reader(shared) -> Reader:
    """One reader per worker process and vocabulary, kept for its next tasks; named by the key that the driver gave it."""
    v = shared.value
    if v.key not in _READERS:
        if len(_READERS) > 3:
            _READERS.clear()
        _READERS[v.key] = Reader(v)
    return _READERS[v.key]
