"""Text functions as columns; all stay in the JVM.

Nulls give nulls unless the docstring says otherwise; an empty text is a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Words that are no entities.
STOP = ["The", "A", "An", "And", "But", "Or", "In", "On", "At", "To", "For", "Of", "With", "As", "When", "Then", "After", "Before", "Once", "Section", "SECTION", "WHO", "WHERE", "WHEN", "WHAT", "HOW", "WHY", "OUTCOME"]
# Marks that end a story well.
TERMINAL = ".!?\"”’')"
# The outline of a generated story.
OUTLINE = [
    "[SECTION 1: WHO, WHERE, WHEN (The Setup)]",
    "[SECTION 2: WHAT (The Problem Starts)]",
    "[SECTION 3: TWIST/COMPLICATION (The Challenge)]",
    "[SECTION 4: HOW (The Big Action/Climax)]",
    "[SECTION 5: WHY/OUTCOME (The Moral and Conclusion)]",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """White space off both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(BLANKS))


def plain_space(c: Column) -> Column:
    """Each white space as a blank."""
    return F.translate(c, BLANKS, " " * len(BLANKS))


def newline_trim(c: Column) -> Column:
    """CRLF to LF, then white space off both ends."""
    return strip(F.regexp_replace(c, "\r\n", "\n"))


def is_blank(c: Column) -> Column:
    """True for null, empty and white space."""
    return c.isNull() | (F.length(strip(c)) == 0)


def first_of(*columns: Column, default: str | None = None) -> Column:
    """The first that is neither null nor empty."""
    out = F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
    return F.coalesce(out, F.lit(default)) if default is not None else out


def words(c: Column) -> Column:
    """Runs of characters between white space."""
    return F.array_remove(F.split(plain_space(c), " "), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def sentence_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]"), F.lit(0)))


def sentences(c: Column) -> Column:
    """Parts between white space that follows . ! or ?"""
    return F.filter(F.transform(F.split(strip(c), rf"(?<=[.!?])[{BLANKS}]+"), strip), lambda s: s != "")


def strip_think(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def strip_fences(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^(?i)```(?:json)?\s*", ""), r"\s*```\z", ""))


def outer_braces(c: Column) -> Column:
    """From the first { to the last }; null without both."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.nullif(found, F.lit(""))


def repair_json(c: Column) -> Column:
    """Fences off, the outermost object, no trailing commas."""
    return let(strip_fences(c), lambda body: F.regexp_replace(F.coalesce(outer_braces(body), body), r",\s*([}\]])", "$1"))


def parse_object(c: Column) -> Column:
    """A JSON object as VARIANT; null for anything else."""
    return let(F.try_parse_json(c), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def safe_title(c: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), " ", "_"), F.lit(100))


def searchable(*columns: Column) -> Column:
    """All given texts in one lower-case line; nulls count as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def preview(c: Column, n: int = 200) -> Column:
    """The first n characters, with ... only where more follow; null for null and empty texts."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).when(F.length(c) > 0, c)


def label(c: Column) -> Column:
    """A model's label: its first line, lower case."""
    return F.lower(strip(F.split(strip(c), "\n")[0]))


#: How a form encodes characters that a path keeps or escapes otherwise.
_FORM_TO_PATH = (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"))


def url_quote(c: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits, - . _ ~ and / stay."""
    out = F.url_encode(c)
    for form, path in _FORM_TO_PATH:
        out = F.replace(out, F.lit(form), F.lit(path))
    return out


def found_sections(c: Column) -> Column:
    """Numbers of the section headers in order; one too large for an int is null."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\[SECTION\s+(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))


def missing_sections(c: Column, expected: int = 5) -> Column:
    return F.array_except(F.sequence(F.lit(1), F.lit(expected)), found_sections(c))


def ends_clean(c: Column) -> Column:
    t = strip(c)
    return (F.length(t) > 0) & F.lit(TERMINAL).contains(F.right(t, F.lit(1)))


def section_bodies(c: Column) -> Column:
    """Map from a section's number to its text; of equal numbers the last counts, a number too large for an int has no entry.

    A null text gives null. No session setting changes the outcome.
    """
    parts = F.filter(F.split(c, r"(?im)(?=^\[SECTION\s+\d+.*?\][ \t]*$)"), lambda p: p.rlike(r"^(?i)\[SECTION\s+\d+"))
    numbered = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(?i)\[SECTION\s+(\d+)", 1).try_cast("int").alias("n"), strip(F.regexp_replace(p, r"^[^\n]*(?:\n|\z)", "")).alias("body")))

    def last_of_each(entries: Column) -> Column:
        return F.filter(entries, lambda e, i: e["n"].isNotNull() & ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["n"] == e["n"]))

    return F.map_from_entries(let(numbered, last_of_each))


def short_sections(c: Column, least: int, expected: int = 5) -> Column:
    """(n, sentences) of the expected sections with fewer than `least` sentences; a section that isn't there has none. Null for a null text."""

    def counted(bodies: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(expected)), lambda n: F.struct(n.alias("n"), sentence_count(F.coalesce(F.try_element_at(bodies, n), F.lit(""))).alias("sentences")))

    return F.when(c.isNotNull(), F.filter(let(section_bodies(c), counted), lambda s: s["sentences"] < least))


#: Edges of a word in any script, alike in every Java version; the first is tested after a capital has been read.
_CAPITAL, _EDGE = r"[A-Z](?<![\p{L}\p{N}_][A-Z])[a-z]+", r"(?![\p{L}\p{N}_])"


def entities(c: Column) -> Column:
    """Capitalised words and runs of them, without stop words and words of up to two letters; sorted."""

    def found(t: Column) -> Column:
        phrases = F.regexp_extract_all(t, F.lit(rf"{_CAPITAL}(?: [A-Z][a-z]+)*{_EDGE}"), F.lit(0))
        tokens = F.regexp_extract_all(t, F.lit(rf"{_CAPITAL}{_EDGE}"), F.lit(0))
        kept = F.array_except(F.array_union(phrases, tokens), F.array(*[F.lit(s) for s in STOP]))
        return F.array_sort(F.filter(kept, lambda e: F.length(e) > 2))

    return let(strip(F.regexp_replace(plain_space(c), "  +", " ")), found)


# Repairs of a generated story, in the order in which they apply (what is found, what takes its place).
STORY_REPAIRS = [
    (r'(?<=[”"])(?=[A-Za-z])', " "),  # a word right after a closing quotation mark
    (r'(^|[\s(\[])(["“])\s+([A-Za-z])', "$1$2$3"),  # white space right after an opening one
    (r"(?i)\b([A-Za-z]+)(\s+\1\b)+", "$1"),  # a word again and again
    (r"  +", " "),
]
# Opening and closing quotation marks, and the marks at which an unclosed paragraph of speech gets one.
QUOTES = {'"': '"', "“": "”"}
SPEECH_ENDS = ".!?,"
#: Sentence marks before the first section up to which that text is a leaked prompt line.
MOST_LEAKED = 2


def without_leaked_prompt(c: Column) -> Column:
    """A short text before the first section header goes."""
    at = F.regexp_instr(c, F.lit(r"(?i)\[SECTION"))

    def judged(n: Column) -> Column:
        marks = F.length(F.regexp_replace(F.left(c, n - 1), r"[^.!?]", ""))
        return F.when((n > 1) & (marks <= MOST_LEAKED), F.substr(c, n)).otherwise(c)

    return let(at, judged)


def closed_speech(paragraph: Column) -> Column:
    """A paragraph that opens a quotation and never closes it gets its closing mark after a sentence end."""
    closing = F.replace(F.replace(F.left(paragraph, F.lit(1)), F.lit('"'), F.lit(QUOTES['"'])), F.lit("“"), F.lit(QUOTES["“"]))
    open_alone = paragraph.rlike(rf'\A["“][^"”]*[{SPEECH_ENDS}]\z')
    return F.when(open_alone, F.concat(paragraph, closing)).otherwise(paragraph)


def clean_story(c: Column) -> Column:
    """A generated story without leaked prompt lines, with quotations closed and STORY_REPAIRS made; null gives null, blank gives "".

    Paragraphs are the parts between empty lines; blank ones go.
    """
    bare = let(strip(c), without_leaked_prompt)
    paragraphs = F.filter(F.transform(F.split(bare, r"\n{2,}"), strip), lambda p: p != "")
    out = F.array_join(F.transform(paragraphs, closed_speech), "\n\n")
    for found, instead in STORY_REPAIRS:
        out = F.regexp_replace(out, found, instead)
    return out


def merge_paragraphs(c: Column) -> Column:
    """Lines between marker lines (three or more dashes and spaces) joined by spaces; one line for each block."""
    lines = F.regexp_replace(c, r"\r", "")
    blocks = F.split(F.concat(F.lit("\n"), lines, F.lit("\n")), r"\n[ \t]*[-–—][- \t–—]+[-–—][ \t]*(?=\n)")
    joined = F.transform(blocks, lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""), " "))
    return F.array_join(F.filter(joined, lambda b: b != ""), "\n")


def truthy(c: Column) -> Column:
    """1, true, yes or y; everything else, null too, is false."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def falsy(c: Column) -> Column:
    """false, 0, no, empty or null."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin("false", "0", "no", ""), F.lit(True))


def mode(c: Column) -> Column:
    return F.when(F.lower(strip(c)).isin("thinking", "think", "slow", "medium"), "thinking").otherwise("fast")


def story_type(c: Column) -> Column:
    v = F.lower(strip(c))
    return F.when(v.isin("single", "standalone"), "single").when(v.isin("series", "chapter", "chapters"), "series").otherwise("mix")


def provider(c: Column) -> Column:
    return F.when(F.lower(strip(c)).isin("hf", "huggingface", "transformers", "local"), "transformers").otherwise("ollama")


def providers(c: Column) -> Column:
    """A comma-separated priority list; the default where none is named."""
    named = F.filter(F.transform(F.split(c, ","), lambda p: F.lower(strip(p))), lambda p: p != "")
    return F.when(F.size(F.coalesce(named, F.array().cast("array<string>"))) > 0, named).otherwise(F.array(F.lit("huggingface"), F.lit("gemini")))


def retryable(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("503|unavailable|high demand|429|rate limit|resource exhausted"), F.lit(False))


# Models that a listing leaves out.
_MODEL_STARTS = "embedding|text-embedding|gemini-embedding|imagen|veo|aqa|deep-research"
_MODEL_PARTS = "-tts|image-generation|-image|native-audio|robotics|computer-use|nano-banana"


def listed_model(c: Column) -> Column:
    base = F.lower(F.regexp_replace(c, "^(.*?)models/", "$1"))
    return ~base.rlike(f"^(?:{_MODEL_STARTS})") & ~base.rlike(_MODEL_PARTS)


def prefixed(text: Column, model: str, query: bool = False) -> Column:
    """What an embedding model of the BGE family expects before a text."""
    if "bge" not in model.lower():
        return text
    return F.concat(F.lit("Represent this sentence for searching relevant passages: " if query else "passage: "), text)
