"""Grounded facts: parsing, sources, prompts, and the check of a story's names against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talefold.functions.text import entities, let, parse_object, repair_json, sentences, strip

FACT = "struct<fact:string,type:string,source_chunk_ids:array<string>,quote:string>"


def _sources(v: Column) -> Column:
    """source_chunk_ids or sources, a list or one string."""

    def at(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.transform(F.array(F.try_variant_get(v, path, "string")), lambda x: x))

    given = F.coalesce(F.filter(at("$.source_chunk_ids"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    other = F.coalesce(F.filter(at("$.sources"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    both = F.when(F.size(given) > 0, given).otherwise(other)
    return F.filter(F.transform(both, strip), lambda x: x != "")


def parse_facts(c: Column) -> Column:
    """Array of FACT from a model's answer; facts without text or sources are dropped, what can't be parsed is an empty array."""
    listed = F.try_variant_get(parse_object(repair_json(c)), "$.facts", "array<variant>")  # parsed once: see let()

    def fact(v: Column) -> Column:
        text = strip(F.coalesce(F.try_variant_get(v, "$.fact", "string"), F.lit("")))
        kind = strip(F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("")))
        quote = strip(F.coalesce(F.try_variant_get(v, "$.quote", "string"), F.lit("")))
        return F.struct(text.alias("fact"), F.when(kind == "", "fact").otherwise(kind).alias("type"), _sources(v).alias("source_chunk_ids"), quote.alias("quote"))

    kept = F.filter(F.transform(listed, fact), lambda f: (F.length(f["fact"]) > 0) & (F.size(f["source_chunk_ids"]) > 0))
    return F.coalesce(kept, F.array().cast(f"array<{FACT}>"))


def prompt_lines(facts: Column) -> Column:
    """`1. [type] fact ("quote")  (source: a, b)` for each fact; empty for none."""

    def line(f: Column, i: Column) -> Column:
        quote = F.when(F.length(f["quote"]) > 0, F.concat(F.lit(' ("'), f["quote"], F.lit('")'))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". ["), f["type"], F.lit("] "), f["fact"], quote, F.lit("  (source: "), F.array_join(f["source_chunk_ids"], ", "), F.lit(")"))

    return F.array_join(F.transform(facts, line), "\n")


def source_ids(facts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(facts, lambda f: f["source_chunk_ids"]))))


def cited(facts: DataFrame, chunks: DataFrame, strict: bool = True) -> DataFrame:
    """Facts (doc_id, fact, source) with the chunk they cite; strict keeps only sources that exist among the retrieved chunks."""
    return facts.join(chunks.select(F.col("chunk_id").alias("source")).distinct(), "source", "left_semi") if strict else facts


def allowed(facts: Column) -> Column:
    return entities(F.array_join(F.transform(facts, lambda f: F.concat(f["fact"], F.lit(" "), f["quote"])), " "))


def violations(story: Column, facts_text: Column) -> Column:
    """Entities of the story that the facts don't name."""
    return F.array_except(entities(story), entities(facts_text))


def gate(story: Column, facts_text: Column, truncate: bool = False, threshold: int = 8, ratio: float = 0.6, keep: int = 6) -> Column:
    """struct of found, novel, ratio and the story, cut to `keep` paragraphs where truncation is on and too much is novel."""
    body = F.regexp_replace(story, r"(?m)^\[SECTION \d+:.*?\][ \t\r]*\n?", "")
    paragraphs = F.slice(F.filter(F.transform(F.split(story, "\n\n"), strip), lambda p: p != ""), 1, keep)

    def judged(n: Column) -> Column:
        share = n["novel"] / F.greatest(n["found"], F.lit(1))
        cut = F.lit(truncate) & (n["novel"] > 0) & ((n["novel"] > threshold) | (share > ratio))
        return F.struct(n["found"].alias("found"), n["novel"].alias("novel"), share.alias("ratio"), F.when(cut, F.array_join(paragraphs, "\n\n")).otherwise(story).alias("story"))

    counts = let(entities(body), lambda e: F.struct(F.size(e).alias("found"), F.size(F.array_except(e, entities(facts_text))).alias("novel")))
    return let(counts, judged)


def tagged_sentences(story: Column, ids: Column) -> Column:
    return F.transform(sentences(story), lambda s: F.struct(s.alias("text"), ids.alias("source_chunk_ids")))


def query_terms(facts: Column, most: int = 5) -> Column:
    """The first capitalised words of facts about who, where, setting or event, each once whatever its case."""
    about = F.filter(facts, lambda f: F.lower(f["type"]).isin("who", "where", "setting", "event"))
    tokens = F.flatten(F.transform(about, lambda f: F.regexp_extract_all(f["fact"], F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-z]{2,}(?![\p{L}\p{N}_])"), F.lit(0))))
    firsts = F.filter(tokens, lambda t, i: F.array_position(F.transform(tokens, F.lower), F.lower(t)) == i + 1)
    return F.slice(firsts, 1, most)


def reformulated(query: Column, facts: Column) -> Column:
    terms = query_terms(facts)
    return F.when(F.size(terms) > 0, F.trim(F.concat_ws(" ", query, F.array_join(terms, " ")))).otherwise(query)
