"""Scores, completeness, decisions, and the evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talefold.functions.text import ends_clean, let, missing_sections, outer_braces, parse_object, searchable, short_sections, strip, strip_fences, word_count

# Keys of an evaluation that are no criteria.
NO_CRITERIA = ["conclusion", "suggestions", "average_score", "scores", "summary", "metadata", "success", "provider", "model"]
NUMBERS = "^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def parse_evaluation(c: Column) -> Column:
    """An evaluation as VARIANT: the whole answer, else its outermost object; null where neither is an object."""
    return let(strip_fences(c), lambda body: F.coalesce(parse_object(body), parse_object(outer_braces(body))))


def number(v: Column) -> Column:
    """A number, or the score of an object; null for booleans, texts and all else."""
    score = F.try_variant_get(v, "$.score", "variant")
    direct = F.when(F.schema_of_variant(v).rlike(NUMBERS), F.try_variant_get(v, "$", "double"))
    inner = F.when(F.schema_of_variant(score).rlike(NUMBERS + "|^STRING"), F.try_variant_get(score, "$", "double"))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), inner).otherwise(direct)


def _criteria(v: Column) -> Column:
    """scores where it is an object with entries, else the whole."""
    scores = F.try_variant_get(v, "$.scores", "map<string,variant>")
    whole = F.try_variant_get(v, "$", "map<string,variant>")
    return F.when(F.size(F.coalesce(scores, F.create_map().cast("map<string,variant>"))) > 0, scores).otherwise(whole)


def criterion(v: Column, name: str) -> Column:
    return number(F.try_element_at(_criteria(v), F.lit(name)))


def average(v: Column) -> Column:
    """average_score where it is a number other than 0, else the mean of the criteria to 2 digits, else 0."""
    explicit = number(F.try_variant_get(v, "$.average_score", "variant"))
    explicit = F.when(F.schema_of_variant(F.try_variant_get(v, "$.average_score", "variant")).rlike(NUMBERS), explicit)
    named = F.map_filter(_criteria(v), lambda k, x: ~k.isin(*NO_CRITERIA))
    values = F.filter(F.transform(F.map_values(named), number), lambda x: x.isNotNull())
    mean = F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0)), 2)
    return F.coalesce(F.nullif(explicit, F.lit(0.0)), mean, F.lit(0.0))


def completeness(story: Column, min_words: int = 250, expected: int = 5, min_sentences: int = 0) -> Column:
    """struct of ok, word_count, missing_sections, ends_clean, reasons; a null story is empty."""

    def facts_of(t: Column) -> Column:
        short = F.array().cast("array<struct<n:int,sentences:int>>")
        missing = missing_sections(t, expected)
        if min_sentences > 0:
            short = let(missing, lambda m: F.when(F.size(m) == 0, short_sections(t, min_sentences, expected)).otherwise(F.array().cast("array<struct<n:int,sentences:int>>")))
        return F.struct(word_count(t).alias("n"), missing.alias("missing"), ends_clean(t).alias("clean"), short.alias("short"))

    def report(f: Column) -> Column:
        lines = F.transform(f["short"], lambda s: F.concat(F.lit("SECTION "), s["n"].cast("string"), F.lit(" has "), s["sentences"].cast("string"), F.lit(f" sentence(s) < {min_sentences}")))
        reasons = F.array_compact(
            F.array(
                F.when(F.size(f["missing"]) > 0, F.concat(F.lit("missing sections: ["), F.array_join(f["missing"].cast("array<string>"), ", "), F.lit("]"))),
                F.when(~f["clean"], "does not end on terminal punctuation"),
                F.when(f["n"] < min_words, F.concat(F.lit("too short ("), f["n"].cast("string"), F.lit(f" < {min_words} words)"))),
                F.when(F.size(f["short"]) > 0, F.concat(F.lit("sections below sentence minimum: "), F.array_join(lines, "; "))),
            )
        )
        return let(reasons, lambda r: F.struct((F.size(r) == 0).alias("ok"), f["n"].alias("word_count"), f["missing"].alias("missing_sections"), f["clean"].alias("ends_clean"), r.alias("reasons")))

    return let(let(F.coalesce(strip(story), F.lit("")), facts_of), report)


def decision(has_eval: Column, avg: Column, faith: Column, complete: Column, facts: Column, accept: float = 7.0, min_faith: float = 6.0, min_facts: int = 3) -> Column:
    """accept, refine or re_retrieve; the first rule that applies decides."""
    blind = F.when(complete, "accept").when(facts <= 0, "re_retrieve").otherwise("refine")
    return (
        F.when(~has_eval, blind)
        .when(faith < min_faith, "re_retrieve")
        .when(facts <= 0, "re_retrieve")
        .when((avg >= accept) & complete, "accept")
        .when(~complete, "refine")
        .when(facts < min_facts, "re_retrieve")
        .otherwise("refine")
    )


def feedback(conclusion: Column, suggestions: Column, complete: Column, reasons: Column) -> Column:
    said = F.nullif(strip(F.coalesce(conclusion, F.lit(""))), F.lit(""))
    notes = F.transform(F.filter(F.transform(F.coalesce(suggestions, F.array().cast("array<string>")), strip), lambda s: s != ""), lambda s: F.concat(F.lit("- "), s))
    gaps = F.when(~complete, F.concat(F.lit("Completeness issues to fix: "), F.array_join(reasons, "; ")))
    return F.array_join(
        F.array_compact(F.concat(F.array(F.concat(F.lit("Reviewer conclusion: "), said)), notes, F.array(gaps, F.lit("Keep every section, finish the final sentence, and stay strictly grounded in the facts.")))),
        "\n",
    )


def best_candidates(iterations: DataFrame, by: str = "run_id") -> DataFrame:
    """The story of each run: an accepted one, else the complete one of best average, the earliest among equals."""
    best = F.struct((F.col("action") == "accept").cast("int"), F.col("complete").cast("int"), "avg", -F.col("iteration"))
    return iterations.groupBy(by).agg(F.max_by(F.struct("iteration", "story"), best).alias("b")).select(by, "b.iteration", "b.story")


def case_results(hits: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """For each case (item_id, expected_title, expected_facts): rank of the expected title, matches, fact coverage in the first k hits.

    hits has item_id, rank, title, author, summary, text. Titles are compared
    trimmed and in lower case. Coverage is null where no facts are expected;
    a case without hits matches nothing.
    """
    same = F.lower(strip(F.col("title"))) == F.lower(strip(F.col("expected_title")))
    text = searchable(F.col("title"), F.col("author"), F.col("summary"), F.col("text"))
    joined = hits.join(cases.select("item_id", "expected_title"), "item_id")
    found = joined.groupBy("item_id").agg(
        F.min(F.when(same, F.col("rank"))).alias("title_rank"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", text.alias("t"))))), lambda x: x["t"]), "\n").alias("top"),
    )
    rows = cases.select("item_id", "expected_facts").join(found, "item_id", "left")
    wanted = F.coalesce("expected_facts", F.array().cast("array<string>"))
    matched = F.size(F.filter(wanted, lambda f: F.coalesce(F.contains(F.col("top"), F.lower(f)), F.lit(False))))
    return rows.select(
        "item_id",
        "title_rank",
        F.coalesce(F.col("title_rank") == 1, F.lit(False)).alias("top1_match"),
        F.coalesce(F.col("title_rank") <= k, F.lit(False)).alias("topk_match"),
        (matched / F.nullif(F.size(wanted), F.lit(0))).alias("fact_coverage"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row: total, top1_accuracy, topk_accuracy (0 without cases), mean coverage of the cases that have one."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0))
    return results.agg(F.count("*").alias("total"), rate("top1_match").alias("top1_accuracy"), rate("topk_match").alias("topk_accuracy"), F.avg("fact_coverage").alias("fact_coverage"))
