"""Problem 2: unfilled templates, filler, error pages and script notices among story text."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talefold.llm.arrow import map_rows

HIT = "tbl string, row_id bigint, kind string, coverage double, unit_coverage double"
#: A phrase counts where phrases cover this share of its sentence or line.
UNIT_SHARE = 0.5
#: Filler words that make a sentence filler: their share of its words, and how many at least.
FILLER_SHARE, FILLER_WORDS = 0.6, 3

# Phrases of our own choice: error pages, programs, script notices, filler and orders to fill in. Numbers are written as 0.
PHRASES = {
    "error": """
        404 not found|403 forbidden|401 unauthorized|400 bad request|500 internal server error|502 bad gateway|503 service unavailable|504 gateway timeout|
        429 too many requests|error 404|error 500|http error|http status|page not found|file not found|object not found|the page you asked for|the page you requested|
        the page you are looking for|does not exist|could not be found|cannot be found|can't be found|no longer available|has been moved|internal server error|bad gateway|
        service unavailable|temporarily unavailable|service temporarily unavailable|the server encountered|unexpected condition|no summary returned|returned no|error:|
        access denied|permission denied|access forbidden|you don't have permission|you do not have permission|unauthorized|this site can't be reached|
        this page can't be displayed|site can't be reached|connection refused|connection reset|connection timed out|err_connection|took too long to respond|request timed out|
        gateway timeout|timed out|quota exceeded|too many requests|retry after 0|rate limit exceeded|try again later|please try again|
        your session has expired|session expired|please sign in again|please log in again|please sign in|return to the home page|go back to the home page|contact support|
        contact the administrator|something went wrong|an error occurred|an error has occurred|an unexpected error|we're sorry|traceback (most recent call last)|valueerror|typeerror|keyerror|
        nullpointerexception|exception in thread|fatal error|undefined index|segmentation fault|stack trace|uncaught exception|empty response|[object object]|undefined is not|syntax error|
        code 0|no summary available|no content available|content unavailable|database error|sql error|error establishing a database connection|server: nginx|server: apache|reference id|error code|ref 0|under maintenance|scheduled maintenance|
        seite nicht gefunden|die seite wurde nicht gefunden|diese seite existiert nicht|fehler 404|fehler 0|interner serverfehler|zugriff verweigert|dienst nicht verfügbar|
        der dienst ist vorübergehend nicht verfügbar|vorübergehend nicht erreichbar|bitte versuchen sie es später|ihre sitzung ist abgelaufen|es ist ein fehler aufgetreten|zeitüberschreitung|
        page introuvable|erreur 404|erreur 0|erreur interne|accès refusé|accès interdit|service indisponible|temporairement indisponible|veuillez réessayer|votre session a expiré|une erreur est survenue|
        página no encontrada|error interno|acceso denegado|servicio no disponible|inténtelo de nuevo|intente de nuevo|vuelva a intentarlo|ha ocurrido un error|se ha producido un error|su sesión ha caducado|código 0|
        página não encontrada|erro 404|erro 0|erro interno|acesso negado|serviço indisponível|tente novamente|ocorreu um erro|sua sessão expirou|
        страница не найдена|ошибка 404|ошибка 0|внутренняя ошибка|доступ запрещён|доступ запрещен|сервис недоступен|сервис временно недоступен|временно недоступен|попробуйте позже|попробуйте ещё раз|произошла ошибка|сессия истекла""",
    "script": """
        enable javascript|please enable javascript|javascript is required|javascript is disabled|javascript must be enabled|requires javascript|without javascript|
        javascript to continue|javascript to view|turn on javascript|needs javascript|need to enable scripts|enable scripts|enable scripts to run this app|scripts are disabled|scripts must be|scripting is off|javascript enabled|javascript turned off|scripting turned off|does not work without|doesn't work without|cookies must be enabled|scripts are disabled in your browser|
        checking your browser|enable cookies|cookies must be|
        noscript|browser does not support|you need to enable|to run this app|to continue reading|
        bitte aktivieren sie javascript|aktivieren sie javascript|javascript aktivieren|um diese seite anzuzeigen|javascript ist deaktiviert|javascript wird benötigt|
        activez javascript|pour afficher ce contenu|veuillez activer javascript|javascript est désactivé|javascript est requis|
        este sitio necesita javascript|necesita javascript para funcionar|active javascript|activar javascript|habilite javascript|javascript está desactivado|
        ative o javascript|habilite o javascript|javascript desativado|este site precisa de javascript|precisa de javascript|para ver esta página|
        включите javascript|javascript отключён|javascript отключен|необходим javascript|требуется javascript|чтобы продолжить чтение|для просмотра""",
    "filler": """
        lorem ipsum|dolor sit amet|consectetur adipiscing|this is sample copy|sample copy|sample text|dummy text|placeholder text|text placeholder|
        will be replaced by|before release|asdf asdf|xxx xxx|blah blah|test test test|foo bar|
        beispieltext|blindtext|platzhaltertext|texte d'exemple|faux texte|texto de ejemplo|texto de relleno|texto de exemplo|текст-заполнитель|пример текста""",
    "order": """
        insert summary|insert text|insert title|insert chapter|insert here|insert name|more text|rest of text|your text|your text here|your summary here|your summary goes here|goes here|
        summary goes here|text goes here|enter a short description|enter a description|enter text|enter summary|enter title|paste the chapter here|paste text here|paste here|
        replace this text|replace this text with the|replace with your text|delete this line|summary to follow|text to follow|to follow (tbd)|write summary|write two sentences|write a summary|todo: finish|todo: write|todo: add|finish this chapter|finish this summary|to do:|tbd - add|add closing paragraph|add text here|
        body missing|fill in|fill me in|to be written|to be completed|to be added|coming soon|object object|
        résumé à compléter|à compléter|introduzca aquí|insira aqui|a completar|a preencher|bitte ausfüllen|noch auszufüllen|zusammenfassung folgt|введите текст|введите описание|заполнить позже|
        hier text einfügen|text hier einfügen|zusammenfassung einfügen|insérer le texte|insérer le résumé|texte à venir|insertar texto|insertar resumen|inserir texto|inserir resumo|вставьте текст|вставить текст""",
}

# Words of the usual filler text.
FILLER = set(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis
    nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur
    excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum asdf xxx qwerty blah""".split()
)
#: Filler words that are also words of a language tell nothing by themselves.
_COMMON = set("sit do ut et ad in non id est ex ea eu do qui esse sed quam magna porta ultra".split())
#: Words that no paragraph of a language goes without for long; beside filler words their absence tells that all is filler, whatever its other words.
_FUNCTION = set(
    """the and of to a that was with his her he she it they from by for as on at der die und das den mit von ein eine zu nicht ist la les des que une un dans sur pas los las del con por
    el su una uma com não os da no и на с не что как он она за по из""".split()
)

_NAME = r"(?:[a-z]+(?:[._][a-z]+)*)"
#: A field name between the marks of a template language, or a blank that a template leaves.
PLACEHOLDER = re.compile(
    r"\{\{\s*[^{}\n]{1,60}?\s*\}\}|\{%\s*[^%\n]{1,60}?\s*%\}|<%=?\s*[^%\n]{1,60}?\s*%>|\$\{\s*[^{}\n]{1,60}?\s*\}|\[\[\s*[^\[\]\n]{1,60}?\s*\]\]|<<\s*[^<>\n]{1,60}?\s*>>|"
    rf"(?<!%)%{_NAME}%(?!%)|(?<![#\w])#[A-Z]+(?:_[A-Z]+)*#(?!#)|<!--.{{1,80}}?-->|@@{_NAME}@@|__[A-Za-z]+(?:[._][A-Za-z]+)*__|"
    rf"<(?!/?(?:p|i|b|em|br|hr|u|q|strong|sup|sub|small)\b){_NAME}(?:[ _][a-z]+){{0,4}}>|\{{(?:title|author|summary|body|text|raw_text|synopsis|name|chapter(?:[._]\w+)?|volume(?:[._]\w+)?|series(?:[._]\w+)?)\}}|"
    r"</?(?:html|head|body|noscript|script|h1|div)\b[^>\n]*>",
    re.S,
)
_LINE = re.compile(r"[^\n]+")
_UNIT = re.compile(r"(?:[^\n.!?…]|[.!?…](?!\s|$))+(?:[.!?…]+[\"'”’»)\]]*)?")
_NUMBER = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_ORDER = re.compile(
    r"^[\[(<{*_\s]*(?:(?:todo|tbd|fixme)\b(?=\s*[:\-–—]|[\])>}*]|$)|(?:insert|paste|enter|write|add|fill|type|your|put)\b(?=.*\b(?:text|title|summary|synopsis|chapter|description|paragraphs?|sentences?|ending|story|author|name|content|here)\b))"
    r".{0,80}?[\])>}*…]*\s*$",
    re.I,
)
_QUOTES = "\"'“”‘’«»„‹›"


def _folded(text: str) -> str:
    return _SPACE.sub(" ", _NUMBER.sub("0", text.replace("’", "'").lower())).strip()


# What the marks of template languages and of pages begin with; PLACEHOLDER confirms them.
MARKS = ["{", "<", "%", "[[", "#", "$", "@@", "__"]


class Found(NamedTuple):
    """Kind of residue, its share of the text, the greatest share of a sentence, and where it stands."""

    kind: str
    coverage: float
    unit_coverage: float
    spans: list[tuple[int, int]]


class Detector:
    """Phrases, filler words and the marks of templates in one automaton; the longest of overlapping matches counts."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word in FILLER - _COMMON:
            self.automaton.add_word(word, ("word", len(word)))
        for mark in MARKS:
            self.automaton.add_word(mark, ("mark", len(mark)))
        for kind, phrases in PHRASES.items():
            for phrase in filter(None, map(_folded, phrases.split("|"))):
                self.automaton.add_word(phrase, (kind, len(phrase)))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """Matches of phrases and filler words at word edges; no quotation mark opens or closes a phrase."""
        out = []
        for end, (kind, size) in self.automaton.iter(text):
            start, stop = end - size + 1, end + 1
            if kind == "mark":
                continue
            before, after = text[start - 1 : start], text[stop : stop + 1]
            if (before.isalnum() and text[start].isalnum()) or (after.isalnum() and text[end].isalnum()):
                continue
            if kind != "word" and (before and before in _QUOTES or after and text[stop : stop + 2].strip(".,!?")[:1] in tuple(_QUOTES)):
                continue
            out.append((start, stop, kind))
        return out

    def __call__(self, text: str | None) -> Found | None:
        """What residue a text holds, in whole or in part; None for clean, null and blank texts."""
        if not text or text.isspace():
            return None
        kinds = {kind for _, (kind, _) in self.automaton.iter(_folded(text))}
        spans: list[tuple[int, int]] = []
        best, best_kind = 0.0, None
        if "mark" in kinds:
            spans = [m.span() for m in PLACEHOLDER.finditer(text)]
            if spans:
                best, best_kind = 1.0, "placeholder"
        phrases = bool(kinds - {"mark", "word"})
        for line in _LINE.finditer(text):
            filler = "word" in kinds and self._filler_line(line.group())
            for m in _UNIT.finditer(line.group()):
                unit = m.group().strip()
                if not unit:
                    continue
                share, kind = (1.0, "filler") if filler else self._unit(unit, phrases, "word" in kinds)
                if share > best:
                    best, best_kind = share, kind
                if share >= UNIT_SHARE:
                    spans.append((line.start() + m.start(), line.start() + m.end()))
        if best < UNIT_SHARE:
            return None
        spans = united(spans)
        return Found(best_kind, sum(b - a for a, b in spans) / len(text), best, spans)

    def _filler_line(self, line: str) -> bool:
        """Several filler words and no word that a language needs: all of the line is filler."""
        words = [w.lower() for w in _WORD.findall(line)]
        strange = sum(w in FILLER and w not in _COMMON for w in words)
        return (strange >= FILLER_WORDS or strange >= 2 and len(words) >= 8) and not any(w in _FUNCTION and w not in FILLER for w in words)

    def _unit(self, unit: str, phrases: bool, filler: bool) -> tuple[float, str | None]:
        share, kind = 0.0, None
        if phrases:
            folded = _folded(unit)
            at = total = longest = 0
            for start, stop, what in sorted(x for x in self.matches(folded) if x[2] != "word"):
                if stop > at:
                    total += stop - max(start, at)
                    at = stop
                if stop - start > longest:
                    longest, kind = stop - start, what
            share = total / max(1, len(folded.strip(" .!?*[](){}<>|:;,-…")))
            if kind == "order" and _ORDER.match(unit):
                share = 1.0
        elif _ORDER.match(unit) and (unit[0] in "[(<{*" or unit[-1] in "])>}*…" or unit[:4].upper() in ("TODO", "TBD:", "FIXM")):
            share, kind = 1.0, "order"
        if share < UNIT_SHARE:
            words = [w.lower() for w in _WORD.findall(unit)]
            if len(words) >= 5 and max(map(words.count, set(words))) >= 0.8 * len(words):
                return 1.0, "filler"  # one word over and over
            if filler:
                strange = sum(kind == "word" for _, _, kind in self.matches(_folded(unit)))
                if strange >= FILLER_WORDS and sum(w in FILLER for w in words) >= FILLER_SHARE * len(words):
                    return 1.0, "filler"
        return min(share, 1.0), kind


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def residue(df: DataFrame, tbl: str, text: str, key: str = "row_id") -> DataFrame:
    """The rows whose `text` holds residue (HIT): its kind, its share of the text, and of its own sentence.

    A phrase counts where phrases cover at least UNIT_SHARE of its sentence or
    line and no quotation marks enclose it, so a story that merely speaks of
    such things is none. Null and blank texts are never residue. One pass, no
    shuffle; a repeated row is judged again; other columns are not read.
    """
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("t")).where(F.col("t").isNotNull())

    def make():
        detect = _detector()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, kinds, shares, units = [], [], [], []
            for row_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (hit := detect(t)) is not None:
                    ids.append(row_id)
                    kinds.append(hit.kind)
                    shares.append(hit.coverage)
                    units.append(hit.unit_coverage)
            return pa.RecordBatch.from_arrays(
                [pa.array([tbl] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(shares, pa.float64()), pa.array(units, pa.float64())],
                ["tbl", "row_id", "kind", "coverage", "unit_coverage"],
            )

        return step

    return map_rows(rows, HIT, make)


_DETECTORS: list[Detector] = []


def _detector() -> Detector:
    """One detector per worker process."""
    if not _DETECTORS:
        _DETECTORS.append(Detector())
    return _DETECTORS[0]


#: Share of a text from which on residue excludes it; below, only the residue goes.
MOST_COVERAGE = 0.3


def without_residue(df: DataFrame, text: str, most: float = MOST_COVERAGE) -> DataFrame:
    """df without the rows of which residue is `most` or more; in other rows that hold some, `text` comes without it.

    All columns and rows of null text stay; with `most` 0 every row that holds
    residue goes. One pass, nothing is shuffled.
    """

    @F.pandas_udf("struct<keep:boolean,text:string>")
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        detect = _detector()
        keep, out = [], []
        for t in texts:
            hit = detect(t)
            keep.append(hit is None or hit.coverage < most)
            out.append(t if hit is None else cut(t, hit.spans))
        return pd.DataFrame({"keep": keep, "text": out})

    name = "_cleaned"
    while name in df.columns:
        name += "_"
    rows = df.withColumn(name, cleaned(F.col(text))).where(F.col(text).isNull() | F.col(f"{name}.keep"))
    return rows.withColumn(text, F.when(F.col(text).isNull(), F.col(text)).otherwise(F.col(f"{name}.text"))).drop(name)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, and without the empty lines and brackets they leave."""
    for start, end in reversed(spans):
        text = text[:start] + text[end:]
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|$)", "", text)).strip() if spans else text
