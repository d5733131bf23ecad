"""Shapes of what a store, a search service or a model returns, as columns; and the requests that ask for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talefold.config import EngineConfig
from talefold.functions.text import first_of, let, mode, parse_object, safe_title, strip, url_quote

HIT = "struct<title:string,author:string,summary:string,document:string,distance:double>"
_NUMBER = "^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(name), F.lit(False))


def _text(v: Column, *paths: str) -> Column:
    """The first of these paths that is there; empty where none is."""
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths], F.lit(""))


def _number(v: Column, path: str) -> Column:
    """A number as it is; texts, truth values and all else are null."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at).rlike(_NUMBER), F.try_variant_get(at, "$", "double"))


def inner_list(v: Column) -> Column:
    """A list of results (VARIANT), or the first of several lists of them, as an array; null and anything else is an empty array."""
    first = F.try_variant_get(v, "$[0]", "variant")
    found = F.when(_kind(first, "ARRAY"), F.try_variant_get(first, "$", "array<variant>")).otherwise(F.try_variant_get(v, "$", "array<variant>"))
    return F.coalesce(found, F.array().cast("array<variant>"))


def hits(answer: Column) -> Column:
    """Array of HIT from a search's answer as JSON: {results: ..}, parallel lists (documents, metadatas, distances), or a list of objects.

    Documents without metadata or distance have empty texts and null. What is
    no answer gives an empty array.
    """
    raw = F.try_parse_json(answer)
    inner = F.try_variant_get(raw, "$.results", "variant")
    body = F.when(_kind(raw, "OBJECT") & F.get_json_object(answer, "$.results").isNotNull(), inner).otherwise(raw)

    def shaped(v: Column) -> Column:
        docs, metas, far = (inner_list(F.try_variant_get(v, f"$.{name}", "variant")) for name in ("documents", "metadatas", "distances"))

        def parallel(d: Column, i: Column) -> Column:
            m = F.get(metas, i)
            return F.struct(_text(m, "$.Title").alias("title"), _text(m, "$.Author").alias("author"), _text(m, "$.Summary").alias("summary"), _text(d, "$").alias("document"), _number(F.get(far, i), "$").alias("distance"))

        def single(o: Column) -> Column:
            named = lambda n: _text(o, f"$.metadata.{n}", f"$.metadatas.{n}", f"$.{n}")
            return F.struct(named("Title").alias("title"), named("Author").alias("author"), named("Summary").alias("summary"), _text(o, "$.document", "$.documents").alias("document"), _number(o, "$.distance").alias("distance"))

        objects = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda o: _kind(o, "OBJECT"))
        return F.when(_kind(v, "OBJECT"), F.transform(docs, parallel)).when(_kind(v, "ARRAY"), F.transform(objects, single))

    return F.coalesce(let(body, shaped), F.array().cast(f"array<{HIT}>"))


#: Metadata fields of a result, with what stands for a missing one.
RESULT_FIELDS = {"series_id": "", "series_name": "", "volume_number": 0, "chapter_id": "", "chapter_number": 0, "chapter_name": "", "section": "", "character": ""}


def result_fields(metadata: Column) -> Column:
    """struct of RESULT_FIELDS from a map of texts; a number that can't be read is its default."""
    out = []
    for name, default in RESULT_FIELDS.items():
        value = F.try_element_at(metadata, F.lit(name))
        out.append(F.coalesce(value.try_cast("int") if isinstance(default, int) else value, F.lit(default)).alias(name))
    return F.struct(*out)


def evaluation_response(evaluation: Column) -> Column:
    """struct of success, average_score, summary, conclusion, suggestions, and scores and metadata as JSON; defaults for what is missing, no success for what is no object or empty."""
    v = parse_object(evaluation)

    def shaped(o: Column) -> Column:
        ok = F.coalesce(F.size(F.try_variant_get(o, "$", "map<string,variant>")) > 0, F.lit(False))
        nested = lambda p: F.coalesce(F.to_json(F.try_variant_get(o, p, "map<string,variant>")), F.lit("{}"))
        return F.struct(
            ok.alias("success"), F.coalesce(_number(o, "$.average_score"), F.lit(0.0)).alias("average_score"), _text(o, "$.summary").alias("summary"), _text(o, "$.conclusion").alias("conclusion"),
            F.coalesce(F.try_variant_get(o, "$.suggestions", "array<string>"), F.array().cast("array<string>")).alias("suggestions"), nested("$.scores").alias("scores"), nested("$.metadata").alias("metadata"),
        )

    return let(v, shaped)


def generation_settings(wanted: Column, cfg: EngineConfig = EngineConfig(), max_tokens: Column | None = None) -> Column:
    """struct of max_tokens, temperature, top_p by the mode a text names; what thinking leaves open is that of fast, an asked-for budget counts first."""
    slow = mode(wanted) == "thinking"

    def of(thinking, fast) -> Column:
        return F.when(slow, F.lit(thinking or fast)).otherwise(F.lit(fast))

    budget = of(cfg.thinking_max_tokens, cfg.fast_max_tokens).cast("int")
    return F.struct((F.coalesce(max_tokens, budget) if max_tokens is not None else budget).alias("max_tokens"), of(cfg.thinking_temperature, cfg.fast_temperature).alias("temperature"), of(cfg.thinking_top_p, cfg.fast_top_p).alias("top_p"))


def filled(template: str, **values: Column) -> Column:
    """A template's text with each {name} replaced by its column; unknown names are an error before anything runs, nulls count as empty."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in values:
                raise ValueError(f"the template asks for {name}")
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def section_feedback(short: Column, least: int) -> Column:
    """What a generator is told about sections (n, sentences) below the least number of sentences; null for none."""
    listed = F.array_join(F.transform(F.array_sort(short), lambda s: F.concat(F.lit("("), s["n"].cast("string"), F.lit(", "), s["sentences"].cast("string"), F.lit(")"))), ", ")
    # The wording that generators are tuned to.
    said = F.concat(F.lit(f"Section format fix required: each section must have at least {least} complete sentences. Sections below minimum: ["), listed, F.lit("]. Expand only the short sections while preserving grounded facts."))
    return F.when(F.size(short) > 0, said)


def by_series(is_series: Column, series: dict[str, str], standalone: dict[str, str]) -> Column:
    """The template's entries as a map: the one for series where the text or truth value says so."""
    from talefold.functions.text import falsy

    entries = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,string>")
    return F.when(~falsy(is_series), entries(series)).otherwise(entries(standalone))


# ---- requests to book and archive services, and what becomes of their answers

#: Answers of a volume search, and bytes that one request of a download asks for.
MOST_VOLUMES, BLOCK = 20, 10 * 1024 * 1024


def volume_request(base: str, title: Column, key: str, most: int = MOST_VOLUMES) -> Column:
    return F.concat(F.lit(f"{base}?q=title:"), url_quote(title), F.lit(f"&key={key}&maxResults={most}"))


def volume_answer(status: Column, body: Column) -> Column:
    """struct of items (JSON) and error: an answer counts with status 200 and an object that names no error."""
    v = parse_object(body)
    named = F.get_json_object(body, "$.error").isNotNull()
    error = F.when(status.isin(401, 403), "not authorised").when(status != 200, F.concat(F.lit("status "), status.cast("string"))).when(v.isNull(), "no JSON")
    error = error.when(named, F.coalesce(F.get_json_object(body, "$.error.message"), F.lit("unknown error")))
    return F.struct(F.when(error.isNull(), body).alias("items"), error.alias("error"))


def archive_query(title: Column, author: Column | None = None) -> Column:
    """The search for texts of a title, and of an author where one is given."""
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit("Unknown"))
    by = F.concat(F.lit(' AND creator:"'), author, F.lit('"')) if author is not None else F.lit("")
    return F.concat(F.lit('title:"'), named, F.lit('"'), by, F.lit(" AND mediatype:texts"))


def archive_docs(answers: DataFrame) -> DataFrame:
    """request_id, identifier, title, downloads of answers (request_id, attempt, json): those of the first attempt that found any.

    The second attempt names the author; it is asked only where the first found nothing.
    """
    from pyspark.sql import Window

    listed = F.from_json("json", "struct<response:struct<docs:array<struct<identifier:string,title:string,downloads:bigint>>>>")["response"]["docs"]
    rows = answers.select("request_id", "attempt", F.explode(listed).alias("d"))
    first = F.min("attempt").over(Window.partitionBy("request_id"))
    return rows.withColumn("first", first).where("attempt = first").select("request_id", "attempt", "d.identifier", "d.title", "d.downloads")


def download_plan(docs: DataFrame, base: str) -> DataFrame:
    """docs (identifier, title, file, size) with url, the name to store it under, and the blocks (offset, length) to ask for; rows without a file go."""
    ending = F.regexp_extract("file", r"(\.[^.]+)\z", 1)
    name = F.concat(F.lit("archive__"), F.col("identifier"), F.lit("__"), safe_title(F.coalesce("title", F.lit("Unknown"))), ending)
    last = F.greatest(F.ceil(F.coalesce("size", F.lit(0)) / BLOCK), F.lit(1)) - 1
    blocks = F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda k: F.struct((k * BLOCK).alias("offset"), F.least(F.lit(BLOCK), F.col("size") - k * BLOCK).alias("length")))
    return docs.where("file is not null and identifier is not null").select("identifier", F.concat(F.lit(base), "identifier", F.lit("/"), "file").alias("url"), name.alias("name"), blocks.alias("blocks"))


def archive_metadata(downloads: DataFrame, query: Column, stamp: Column) -> DataFrame:
    """name, json: what is kept about each downloaded file (identifier, title, creators, name)."""
    creator = F.coalesce(first_of(F.get("creators", F.lit(0))), F.lit("Unknown"))
    book = F.struct(
        F.coalesce("title", query).alias("title"), F.array(creator).alias("authors"), F.col("identifier"), F.concat(F.regexp_replace("name", r"\.[^.]+\z", ""), F.lit(".txt")).alias("filename"), F.col("name").alias("file_path")
    )
    whole = F.struct(query.alias("search_query"), F.lit("archive").alias("source"), stamp.alias("timestamp"), F.array(book).alias("books"))
    return downloads.select(F.concat(F.lit("archive_books_"), stamp, F.lit("_"), F.col("identifier"), F.lit(".json")).alias("name"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def story_events(stories: DataFrame, key: str = "query_id", text: str = "story") -> DataFrame:
    """key, seq, step, status, detail of each run as a client sees it: three stages, the story's tokens in order, the end.

    A run without a story ends its last stage with an error and has no tokens.
    """
    pair = lambda step, status, detail=None: F.struct(F.lit(step).alias("step"), F.lit(status).alias("status"), F.lit(detail).cast("string").alias("detail"))
    begun = F.array(pair("retrieve", "start"), pair("retrieve", "done"), pair("extract", "start"), pair("extract", "done"), pair("generate", "start"))
    tokens = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\S+\s*"), F.lit(0)), lambda t: F.struct(F.lit("token").alias("step"), F.lit("data").alias("status"), t.alias("detail")))
    story = F.concat(begun, F.array(pair("generate", "done")), tokens, F.array(pair("end", "done")))
    failed = F.concat(begun, F.array(pair("generate", "error"), pair("end", "done")))
    rows = stories.select(key, F.posexplode(F.when(F.length(strip(F.col(text))) > 0, story).otherwise(failed)).alias("seq", "e"))
    return rows.select(key, "seq", "e.step", "e.status", "e.detail")
