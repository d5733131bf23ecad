"""Model calls as pluggable functions, with deterministic offline stand-ins.

A plug-in is any function from Column(s) to Column; a served model goes in as a
pandas UDF that loads once per worker. The stand-ins need no model.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from typing import Callable, Iterator, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from talefold.config import backoff
from talefold.functions.text import OUTLINE, entities, sentences, word_count
from talefold.operators.enrich import positional_tag
from talefold.operators.retrieve import overlap_score

WIDTH = 64
_WORD = re.compile(r"[^\W_]+")


def hash_vector(text: str | None, width: int = WIDTH) -> list[float] | None:
    """Signed hashed word counts of a text, of length 1; null for a text without words."""
    from xxhash import xxh3_64_intdigest

    v = np.zeros(width)
    for w in _WORD.findall((text or "").lower()):
        h = xxh3_64_intdigest(w)
        v[h % width] += 1 - 2 * (h >> 32 & 1)
    size = np.sqrt((v**2).sum())
    return (v / size).astype(np.float32).tolist() if size else None


def embed(text: Column) -> Column:
    """Passage and query vectors (the same space for both)."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(hash_vector)

    return run(text)


def summarise(text: Column, most: int = 2, limit: int = 8000) -> Column:
    return F.array_join(F.slice(sentences(F.left(text, F.lit(limit))), 1, most), " ")


def extract_facts(chunks: Column) -> Column:
    """Facts JSON of retrieved chunks (array of struct chunk_id, text): their sentences that name somebody."""
    facts = F.flatten(
        F.transform(
            chunks,
            lambda c: F.transform(
                F.filter(sentences(c["text"]), lambda s: F.size(entities(s)) > 1),
                lambda s: F.struct(F.lit("event").alias("type"), s.alias("fact"), F.array(c["chunk_id"].cast("string")).alias("source_chunk_ids"), F.lit("").alias("quote")),
            ),
        )
    )
    return F.to_json(F.struct(facts.alias("facts")))


def generate(facts_text: Column, draft: Column | None = None) -> Column:
    """Five sections filled with the facts' sentences in turn; a draft gets the sections it lacks."""
    s = sentences(F.coalesce(facts_text, F.lit("")))
    share = F.greatest(F.ceil(F.size(s) / 5).cast("int"), F.lit(1))
    parts = [F.concat(F.lit(head + "\n"), F.coalesce(F.nullif(F.array_join(F.slice(s, F.lit(i) * share + 1, share), " "), F.lit("")), F.lit("Nothing more is told."))) for i, head in enumerate(OUTLINE)]
    whole = F.concat_ws("\n\n", *parts)
    return whole if draft is None else F.coalesce(F.when(F.length(draft) > F.length(whole), draft), whole)


def evaluate(story: Column) -> Column:
    """Rubric JSON by simple counts."""
    grade = lambda c: F.least(F.lit(10.0), F.greatest(F.lit(1.0), c.cast("double")))
    n = F.coalesce(word_count(story), F.lit(0))
    scores = F.struct(grade(n / 40).alias("depth"), grade(F.size(sentences(story)) / 3).alias("flow"), F.lit(8.0).alias("faithfulness"))
    return F.to_json(F.struct(scores.alias("scores"), F.lit("").alias("conclusion"), F.array().cast("array<string>").alias("suggestions")))


@dataclass(frozen=True)
class Models:
    """The callables of a pipeline; each can be replaced."""

    embed: Callable[[Column], Column] = embed
    pair_score: Callable[[Column, Column], Column] = overlap_score
    label: Callable[[Column, Column], Column] = positional_tag
    summarise: Callable[[Column], Column] = summarise
    extract_facts: Callable[[Column], Column] = extract_facts
    generate: Callable[..., Column] = generate
    evaluate: Callable[[Column], Column] = evaluate


class Generator(Protocol):
    """What a text generator of a pipeline offers: one prompt in, one text out."""

    def invoke(self, prompt: str) -> str: ...


#: What in an error's message makes another attempt worth while.
_AGAIN = re.compile(r"503|unavailable|high demand|429|rate limit|resource exhausted", re.I)


def retried(call: Callable[[str], str], attempts: int = 6, first: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """`call`, again after passing errors, with the waits of backoff(); the last error, and one that won't pass, is raised."""

    def run(prompt: str) -> str:
        waits = backoff(attempts, first)
        for k, wait in enumerate(waits):
            try:
                return call(prompt)
            except Exception as e:  # noqa: BLE001
                if k + 1 == len(waits) or not _AGAIN.search(str(e)):
                    raise
                sleep(wait)
        raise ValueError("no attempts")

    return run


def served(make: Callable[[], Generator], attempts: int = 6) -> Callable[[Column], Column]:
    """A generator as a column function: made once for each worker, called again after passing errors; null where it fails for good."""

    @F.pandas_udf("string")
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = retried(make().invoke, attempts)

        def one(prompt: str | None) -> str | None:
            try:
                return None if prompt is None else call(prompt)
            except Exception:  # noqa: BLE001  # one failed prompt must not end the job
                return None

        for part in parts:
            yield part.map(one)

    return answer


def first_that_answers(*calls: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Providers in order of priority: the first that gives no null."""
    return lambda c: F.coalesce(*[call(c) for call in calls])
