"""Problem 6: text read in a wrong character encoding, found and restored by EM over encoding chains.

Each unit (sentence or line) of a text has a hidden chain of wrong readings;
the identity is one of them. A unit's likelihood under a chain is that of the
text the chain's inverse gives, by frequencies of neighbouring characters in
the whole table; the chains' prior is estimated per pool (the field, and the
language or source the row names) by expectation-maximization, so that weak
evidence of many records helps to judge each of them. Characters that a reading
lost for good (U+FFFD) are a chain of their own, which explains them and
restores nothing.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talefold.llm.arrow import map_rows, may_be_in, sum_counts
from talefold.session import stage, unstage

#: Character pairs are counted in so many buckets (2 MB).
BUCKETS = 1 << 18
ROUNDS = 6
#: Likelihoods of neighbouring pairs aren't independent; this share of their logarithm counts.
WEIGHT = 0.5
_RUN = re.compile(r"[^\x00-\x7f]+")
_UNIT = re.compile(r"[^\n.!?]+[\n.!?]*|[\n.!?]+")
LOST = "�"
#: Of a two-byte letter the second byte was a no-break space that became a plain one, or a soft hyphen that was dropped.
_PLAIN_SPACE = re.compile(r"(?<![A-ZÀ-Þ])Ã (?![A-ZÀ-Þ]{2})")
_LOST_HYPHEN = re.compile(r"(?<=[a-zß-ÿ])Ã(?=[a-z])")
#: Subtracted for each pair of characters that occurs nowhere else.
NEVER = 12.0


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes without a character stand for the control of the same number."""
    out = {}
    for byte in range(128, 256):
        try:
            out[bytes([byte]).decode(encoding)] = byte
        except UnicodeDecodeError:
            out[chr(byte)] = byte
    return out


class Chain:
    """The inverse of reading `wrote` as `read`, once or more times."""

    def __init__(self, name: str, wrote: str, read: str, times: int = 1):
        self.name, self.wrote, self.times = name, wrote, times
        self.byte = _bytes_of(read)
        self.table = None
        if wrote != "utf-8":
            self.table = {}
            for char, byte in self.byte.items():
                try:
                    self.table[ord(char)] = bytes([byte]).decode(wrote)
                except UnicodeDecodeError:
                    self.table[ord(char)] = LOST

    def _once(self, run: str) -> str:
        try:
            return bytes(map(self.byte.__getitem__, run)).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return run

    def run(self, run: str) -> str | None:
        """A run of characters beyond ASCII before the wrong reading; None where the chain can't have made it."""
        if self.table is not None:
            out = run.translate(self.table)
            return None if out == run or LOST in out else out
        for _ in range(self.times):
            out = _RUN.sub(lambda m: self._once(m.group()), run)
            if out == run:
                return None
            run = out
        return run

    def __call__(self, text: str) -> str:
        """The text before the wrong reading; runs that the chain can't have made stay."""
        text = _RUN.sub(lambda m: self.run(m.group()) or m.group(), text)
        if self.table is None and "Ã" in text:
            text = _LOST_HYPHEN.sub("í", _PLAIN_SPACE.sub("à ", text))
        return text


# Wrong readings that occur in practice.
CHAINS = [
    *(Chain(f"utf-8 as {read}", "utf-8", read) for read in ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_15")),
    *(Chain(f"utf-8 as {read} twice", "utf-8", read, 2) for read in ("cp1252", "latin-1")),
    Chain("cp1251 as cp1252", "cp1251", "cp1252"),
    Chain("koi8_r as cp1251", "koi8_r", "cp1251"),
    Chain("cp1251 as koi8_r", "cp1251", "koi8_r"),
    Chain("cp866 as cp1251", "cp866", "cp1251"),
    Chain("cp1251 as cp866", "cp1251", "cp866"),
    Chain("koi8_r as cp1252", "koi8_r", "cp1252"),
    Chain("cp866 as cp1252", "cp866", "cp1252"),
    Chain("mac_cyrillic as cp1251", "mac_cyrillic", "cp1251"),
    Chain("cp1252 as mac_roman", "cp1252", "mac_roman"),
    Chain("mac_roman as cp1252", "mac_roman", "cp1252"),
    Chain("cp1252 as cp437", "cp1252", "cp437"),
    Chain("cp1252 as cp850", "cp1252", "cp850"),
    Chain("cp850 as cp1252", "cp850", "cp1252"),
    Chain("cp437 as cp1252", "cp437", "cp1252"),
    Chain("cp1252 as cp1251", "cp1252", "cp1251"),
    Chain("cp1252 as cp1250", "cp1252", "cp1250"),
]
#: After the chains: the reading that lost characters, and the identity.
LOSSY, IDENTITY = len(CHAINS), len(CHAINS) + 1
NAMES = [c.name for c in CHAINS] + ["lossy", "identity"]
N_UTF8 = sum(c.table is None for c in CHAINS)


def _pairs(before: str, run: str, after: str) -> list[int]:
    """Buckets of the neighbouring characters in a run and at its edges."""
    codes = [ord(before), *map(ord, run), ord(after)]
    return [(a * 31421 + b * 7 + 3) % BUCKETS for a, b in zip(codes, codes[1:])]


def _runs(unit: str):
    """(character before, run, character after) of each run beyond ASCII; a line's edge counts as a line end."""
    n = len(unit)
    for m in _RUN.finditer(unit):
        a, b = m.span()
        yield unit[a - 1] if a else "\n", m.group(), unit[b] if b < n else "\n"


#: Runs of characters that a task remembers; emptied beyond that, which changes no result.
MEMORY = 200_000


def pair_model(rows: DataFrame) -> np.ndarray:
    """Log frequencies of character pairs, from all units that aren't mostly readable as UTF-8 read wrongly: chance makes few such texts."""

    def make():
        memory: dict[tuple[str, str, str], tuple[np.ndarray, list[int]]] = {}

        def look(key: tuple[str, str, str]) -> tuple[np.ndarray, list[int]]:
            if (known := memory.get(key)) is None:
                if len(memory) > MEMORY:
                    memory.clear()
                known = memory[key] = np.array([c._once(key[1]) != key[1] for c in CHAINS[:N_UTF8]], np.int32), _pairs(*key)
            return known

        def step(batch: pa.RecordBatch) -> np.ndarray:
            found: list[int] = []
            for t in batch.column(2).to_pylist():
                for unit in _UNIT.findall(t):
                    if unit.isascii() or LOST in unit:
                        continue
                    runs = [look(key) for key in _runs(unit)]
                    if 2 * sum(flags for flags, _ in runs).max() < len(runs):
                        for _, pairs in runs:
                            found += pairs
            return np.bincount(np.array(found, np.int64), minlength=BUCKETS)

        return step

    counts = sum_counts(rows, make, BUCKETS)
    return (np.log((counts + 0.3) / max(1, counts.sum())) - NEVER * (counts == 0)).astype(np.float32)


#: A unit whose every chain is below the identity by this much (in logarithms) is added up with others of its pool: there, a
#: chain's posterior is in proportion to its likelihood, so that the sum over such units is all that EM needs of them.
FAR = 8.0
UNITS = "row_id bigint, text_hash bigint, pool string, unit int, chains array<int>, scores array<double>, n bigint"


def scored_units(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Of each unit with letters beyond ASCII: the chains that may have been at work and the likelihood of what they give.

    No chain is left out. Units that no chain explains nearly as well as the
    identity come as one row for a batch and pool: their number n, and the mean
    likelihood of each chain against the identity.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        table = shared.value.tolist()
        memory: dict[tuple[str, str, str], tuple[np.ndarray, np.ndarray]] = {}

        def score(before: str, run: str, after: str) -> float:
            return WEIGHT * sum(map(table.__getitem__, _pairs(before, run, after)))

        def look(key: tuple[str, str, str]) -> tuple[np.ndarray, np.ndarray]:
            """Scores of the run under each chain (the identity last), and which chains change it."""
            if (known := memory.get(key)) is None:
                if len(memory) > MEMORY:
                    memory.clear()
                before, run, after = key
                scores, changed = np.full(IDENTITY + 1, score(*key)), np.zeros(IDENTITY + 1, bool)
                for k, chain in enumerate(CHAINS):
                    if (out := chain.run(run)) is not None:
                        scores[k], changed[k] = score(before, out, after), True
                    elif chain.table is not None:
                        scores[k] = -np.inf
                if LOST in run:  # what stands beside a lost character tells nothing
                    scores[LOSSY] = WEIGHT * sum(table[p] for p, pair in zip(_pairs(*key), zip(before + run, run + after)) if LOST not in pair)
                    changed[LOSSY] = True
                known = memory[key] = scores, changed
            return known

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            far: dict[str, list] = {}
            for row_id, pool, t, text_hash in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for no, unit in enumerate(_UNIT.findall(t)):
                    if unit.isascii():
                        continue
                    total, changed = 0.0, False
                    for key in _runs(unit):
                        scores, some = look(key)
                        total, changed = total + scores, changed | some
                    gap = np.where(changed, total - total[IDENTITY], -np.inf)
                    if gap.max() < -FAR:
                        held = far.setdefault(pool, [0, np.zeros(IDENTITY + 1)])
                        held[0] += 1
                        held[1] += np.exp(gap)
                        continue
                    near = np.flatnonzero(gap > -np.inf).tolist()
                    options = {float(total[k]): k for k in reversed(near)}  # chains that give the same text have the same score; the first counts
                    values = (row_id, text_hash, pool, no, [IDENTITY, *options.values()], [float(total[IDENTITY]), *options], 1)
                    for col, value in zip(cols, values):
                        col.append(value)
            for pool, (n, likelihood) in far.items():
                some = np.flatnonzero(likelihood).tolist()
                for col, value in zip(cols, (None, None, pool, None, [IDENTITY, *some], [0.0, *np.log(likelihood[some] / n).tolist()], n)):
                    col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row_id", "text_hash", "pool", "unit", "chains", "scores", "n"])

        return step

    return map_rows(rows, UNITS, make)


#: Prior of the chains before anything is known, and what is added to each pool's weights.
START = [0.1 / IDENTITY] * IDENTITY + [0.9]
ADDED = [0.2] * IDENTITY + [2.0]


def _posterior(units: DataFrame, prior: DataFrame | None) -> DataFrame:
    """units with `posterior`, an array beside `chains`; prior: pool, logs."""
    start = F.array(*[F.lit(math.log(x)) for x in START])
    rows = units.withColumn("logs", start) if prior is None else units.join(prior, "pool", "left").withColumn("logs", F.coalesce("logs", start))
    weights = F.zip_with("chains", "scores", lambda c, s: s + F.element_at("logs", c + 1))
    return (
        rows.withColumn("w", weights)
        .withColumn("w", F.transform("w", lambda x: F.exp(x - F.array_max("w"))))
        .withColumn("posterior", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, b: a + b)))
        .drop("logs", "w")
    )


def estimate(units: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """Prior of the chains in each pool (pool, logs), by EM over all units.

    The priors are a table of one row for each pool, written once a round;
    nothing of it comes to the driver or into a plan, however many pools there are.
    """
    prior = None
    number = F.sequence(F.lit(0), F.lit(IDENTITY))
    added = F.array(*[F.lit(x) for x in ADDED])
    for _ in range(rounds):
        sums = (
            _posterior(units, prior)
            .select("pool", "n", F.explode(F.arrays_zip("chains", "posterior")).alias("x"))
            .groupBy("pool", F.col("x.chains").alias("chain"))
            .agg(F.sum(F.col("x.posterior") * F.col("n")).alias("weight"))
            .groupBy("pool")
            .agg(F.map_from_entries(F.collect_list(F.struct("chain", "weight"))).alias("weights"))
        )
        total = F.transform(number, lambda k: F.coalesce(F.try_element_at("weights", k), F.lit(0.0)) + F.element_at(added, k + 1))
        share = F.transform("total", lambda x: F.log(F.greatest(x / F.aggregate("total", F.lit(0.0), lambda a, b: a + b), F.lit(1e-9))))
        before = prior
        prior = stage(sums.select("pool", total.alias("total")).select("pool", share.alias("logs")), "encoding-prior")
        unstage(before)
    return prior


def _rows(df: DataFrame, text: str, pool: str | list[str], key: str) -> DataFrame:
    """row_id, pool, t, text_hash of rows with characters beyond ASCII; the pool is the field with what `pool` columns name."""
    named = [F.coalesce(F.lower(F.trim(F.col(p).cast("string"))), F.lit("")) for p in ([pool] if isinstance(pool, str) else pool)]
    chosen = df.select(F.col(key).cast("bigint").alias("row_id"), F.concat_ws("/", F.lit(text), *named).alias("pool"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("text_hash"))
    return chosen.where(F.col("t").rlike(r"[^\x00-\x7F]"))


def garbled_units(df: DataFrame, text: str = "text", pool: str | list[str] = "lang", key: str = "row_id", rounds: int = ROUNDS) -> DataFrame:
    """row_id, text_hash, unit, chain: each unit that most likely was read wrongly ("lossy" where characters are lost for good).

    Rows of null, empty or plain ASCII text have none. A repeated row counts
    under its own id; rows of one id and different texts are told apart by the
    hash.
    """
    rows = _rows(df, text, pool, key)
    units = stage(scored_units(rows, pair_model(rows)), "encoding-units")
    prior = estimate(units, rounds)
    best = F.array_max(F.arrays_zip(F.col("posterior").alias("p"), F.col("chains").alias("c")))
    names = F.array(*[F.lit(n) for n in NAMES])
    judged = _posterior(units.where("row_id is not null"), prior).select("row_id", "text_hash", "unit", best["c"].alias("c"))
    return judged.where(F.col("c") != IDENTITY).select("row_id", "text_hash", "unit", F.element_at(names, F.col("c") + 1).alias("chain"))


def garbled(df: DataFrame, text: str = "text", pool: str | list[str] = "lang", key: str = "row_id", rounds: int = ROUNDS) -> DataFrame:
    """row_id of each row whose text was, in whole or in part, read in a wrong encoding; a repeated row_id comes once."""
    return garbled_units(df, text, pool, key, rounds).select("row_id").distinct()


def restored(df: DataFrame, text: str = "text", pool: str | list[str] = "lang", key: str = "row_id") -> DataFrame:
    """row_id, restored, chains, complete: the text of each garbled row with every unit repaired by its own chain.

    complete is false where characters are lost for good (U+FFFD).
    """
    found = stage(garbled_units(df, text, pool, key), "encoding-found")
    # rows that come twice have the same units and chains; one of each is kept
    once = found.groupBy("row_id", "text_hash", "unit").agg(F.min("chain").alias("chain"))
    fixes = once.groupBy("row_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("unit", "chain"))).alias("fixes"))
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("text_hash")).where(F.col("t").isNotNull())
    # most other texts stay out of the join
    rows = rows.where(may_be_in(found.select("row_id"))(F.col("row_id"))).join(fixes, ["row_id", "text_hash"]).select("row_id", "t", "fixes")
    by_name = {c.name: c for c in CHAINS}

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, chains = [], []
            for t, fix in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fix = dict(fix or ())
                units = _UNIT.findall(t)
                texts.append("".join(by_name[fix[k]](u) if fix.get(k) in by_name else u for k, u in enumerate(units)))
                chains.append(sorted(set(fix.values()) - {"lossy"}))
            whole = [LOST not in t for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(chains, pa.list_(pa.string())), pa.array(whole)], ["row_id", "restored", "chains", "complete"])

        return step

    return map_rows(rows, "row_id bigint, restored string, chains array<string>, complete boolean", make)
