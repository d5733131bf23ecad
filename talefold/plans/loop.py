"""The three-step answer and the agentic loop, for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talefold.config import EngineConfig, pool_size
from talefold.models import Models
from talefold.operators.evaluate import average, best_candidates, completeness, criterion, decision, feedback, parse_evaluation
from talefold.operators.facts import gate, parse_facts, prompt_lines, reformulated
from talefold.functions.text import short_sections
from talefold.operators.results import section_feedback
from talefold.operators.retrieve import hybrid
from talefold.session import stage


@dataclass(frozen=True)
class Result:
    """One row for each run and iteration, and one answer for each run."""

    iterations: DataFrame
    answers: DataFrame


def _facts(corpus: DataFrame, queries: DataFrame, cfg: EngineConfig, models: Models, n_stories: int, boost: float, rerank: bool = True) -> DataFrame:
    """query_id, facts for each query, by retrieval and extraction; no hits give no facts."""
    asked = queries.select("query_id", F.col("current").alias("query"), models.embed(F.col("current")).alias("query_vector"))
    hits = hybrid(corpus, asked, pool_size(cfg.pool_base, n_stories, cfg.chunks_per_story, boost), n_stories, cfg.chunks_per_story, cfg.bm25_weight, cfg.rrf_k, cfg.bm25, pair_score=models.pair_score if cfg.rerank_model and rerank else None)
    listed = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", F.col("id").cast("string").alias("chunk_id"), "text"))), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"))).alias("chunks"))
    return listed.select("query_id", parse_facts(models.extract_facts(F.col("chunks"))).alias("facts"))


def agentic(corpus: DataFrame, queries: DataFrame, cfg: EngineConfig = EngineConfig(), models: Models = Models(), boost_step: float = 2.0, wide: int = 5) -> Result:
    """Retrieve, extract, generate, judge; accept, refine or retrieve again, at most cfg.max_iterations times.

    queries: query_id, query. All open runs go through each round together; a
    round is written out and only the number of open runs comes to the driver.
    """
    state = queries.select("query_id", "query", F.col("query").alias("current"), F.lit(None).cast("string").alias("draft"))
    facts = _facts(corpus, state, cfg, models, cfg.n_stories, 1.0)
    state = stage(state.join(facts, "query_id", "left"), "loop-state")
    rounds, boost, n_stories = [], 1.0, cfg.n_stories
    for i in range(1, cfg.max_iterations + 1):
        none = F.array().cast("array<struct<fact:string,type:string,source_chunk_ids:array<string>,quote:string>>")
        rows = state.withColumn("facts", F.coalesce("facts", none)).withColumn("told", F.array_join(F.transform("facts", lambda f: f["fact"]), " "))
        rows = rows.withColumn("story", gate(models.generate(F.col("told"), F.col("draft")), F.col("told"), cfg.gate_truncate, cfg.gate_threshold)["story"])
        rows = rows.withColumn("c", completeness(F.col("story"), cfg.min_words, 5, cfg.min_sentences)).withColumn("e", parse_evaluation(models.evaluate(F.col("story"))))
        rows = rows.withColumn("avg", F.when(F.col("e").isNotNull(), average(F.col("e"))).otherwise(0.0)).withColumn("faithfulness", criterion(F.col("e"), "faithfulness"))
        rows = rows.withColumn("action", decision(F.col("e").isNotNull(), F.col("avg"), F.col("faithfulness"), F.col("c.ok"), F.size("facts"), cfg.accept_score, cfg.min_faithfulness, cfg.min_facts))
        notes = feedback(F.try_variant_get("e", "$.conclusion", "string"), F.try_variant_get("e", "$.suggestions", "array<string>"), F.col("c.ok"), F.col("c.reasons"))
        done = stage(
            rows.select("query_id", "query", "current", F.lit(i).alias("iteration"), "action", "avg", "faithfulness", F.col("c.ok").alias("complete"), F.col("c.word_count").alias("word_count"), F.col("c.missing_sections").alias("missing_sections"), F.size("facts").alias("n_facts"), "facts", "story", notes.alias("feedback")),
            "loop-round",
        )
        rounds.append(done)
        left = done.where("action <> 'accept'")
        if i == cfg.max_iterations or left.limit(1).count() == 0:
            break
        boost, n_stories = boost * boost_step, max(n_stories, wide)
        refine = left.where("action = 'refine'").select("query_id", "query", "current", F.col("story").alias("draft"), "facts")
        again = left.where("action = 're_retrieve'").select("query_id", "query", reformulated(F.col("query"), F.col("facts")).alias("current"), F.lit(None).cast("string").alias("draft"))
        state = stage(refine.unionByName(again.join(_facts(corpus, again, cfg, models, n_stories, boost, False), "query_id", "left")), "loop-state")
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    return Result(every, best_candidates(every, "query_id"))


def three_steps(corpus: DataFrame, queries: DataFrame, cfg: EngineConfig = EngineConfig(), models: Models = Models()) -> DataFrame:
    """query_id, facts, prompt, feedback, story: retrieval, extraction and one generation; sections that are too short get one more pass, with the feedback that names them."""
    state = queries.select("query_id", "query", F.col("query").alias("current"))
    rows = state.join(_facts(corpus, state, cfg, models, cfg.n_stories, 1.0), "query_id", "left")
    told = F.array_join(F.transform("facts", lambda f: f["fact"]), " ")
    rows = rows.withColumn("first", models.generate(told)).withColumn("short", short_sections(F.col("first"), cfg.min_sentences))
    story = F.when(F.size("short") == 0, F.col("first")).otherwise(models.generate(told, F.col("first")))
    return rows.select("query_id", "facts", prompt_lines(F.col("facts")).alias("prompt"), section_feedback(F.col("short"), cfg.min_sentences).alias("feedback"), story.alias("story"))


STAGES = ("retrieve", "extract", "generate")


def stage_events(failed: str | None = None) -> list[tuple[int, str, str]]:
    """(seq, step, status) of a run: each stage starts, then is done; after a failure nothing follows but the end."""
    out: list[tuple[str, str]] = []
    for step in STAGES:
        out.append((step, "start"))
        if step == failed:
            out.append((step, "error"))
            break
        out.append((step, "done"))
    return [(i, s, t) for i, (s, t) in enumerate([*out, ("end", "done")])]
