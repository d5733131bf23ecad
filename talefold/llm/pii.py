"""Problem 9: personal information in free text, found and replaced by typed placeholders.

Patterns propose spans; check digits confirm or weaken them; words nearby
adjust the score. A span counts from LEAST_SCORE on.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talefold.llm.arrow import map_rows

KINDS = ("email", "phone", "id_number", "address", "name")
LEAST_SCORE = 0.5
#: Characters before and after a span in which words count as its context.
AROUND = 40


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# e-mail addresses, plain and spelled out
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*\w@(?:[\w-]+\.)+[^\W\d_]{2,}", re.U)
_AT, _DOT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+)", r"(?:\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)"
_EMAIL_SPELLED = re.compile(
    rf"(?<![\w.+-])[\w.+-]*\w(?:{_AT}[\w-]+(?:{_DOT}[\w-]+)+|\s*[\[({{<]\s*at\s*[\])}}>]\s*(?:[\w-]+\.)+[^\W\d_]{{2,}}|@[\w-]+(?:{_DOT}[\w-]+)+)", re.I
)

_SPELLED_HINT = re.compile(r"\b(?:dot|DOT|Dot)\b|[\[({<]\s*(?:at|AT)\s*[\])}>]")

# telephone numbers
_PHONE = re.compile(
    r"(?<![\w+./-])(?:"
    r"(?P<plus>\+\d{1,3}[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?\d(?:[\s.-]?\d){5,11})|"
    r"(?P<area>\(\d{2,5}\)[\s.-]?\d{3,4}(?:[\s.-]?\d{2,5}){1,3})|"
    r"(?P<long>(?:1[-. ])?\d{3}[-. ]\d{3}[-. ]\d{4})|"
    r"(?P<pairs>0\d(?:[ .-]\d{2}){4})|"
    r"(?P<trunk>0\d{2,4}[ /-]\d{3,4}(?:[ -]?\d{3,4})?)|"
    r"(?P<short>\d{3}-\d{4})|"
    r"(?P<plain>0\d{9,10})"
    r")(?![\w/]|[-.]\w)"
)
_PHONE_WORDS = re.compile(r"\b(?:tel|tél|teléfono|telefone|telefon|telephone|phone|call|ring|rufen|mobile|mobil|handy|fax|cell|whatsapp|queries|questions|reached|contact|kontakt|тел|телефон|звоните)\b", re.I)
_NOT_PHONE = re.compile(r"\b(?:isbn|issn|pages?|plates|price|copy|copies|catalogue|catalog|shelf|order|drawer|version|key|edition|chapter|lot|invoice|item|ref|reference|page|line|printed|leaves)\b[^.]{0,18}$", re.I)

# identity numbers: what it is, then the number
_ID_LABEL = (
    r"passport|reisepass|pass-?nr|passeport|pasaporte|passaporte|паспорт|national insurance|ni|nino|social security|social insurance|ssn|sin|national id(?:entity)?|identity card|id card|identity|"
    r"tax(?:payer)?(?: id(?:entification)?)?|tin|itin|utr|vat id|steuer-?id(?:entifikationsnummer)?|steuernummer|steuer-?nr|sozialversicherung(?:s(?:nummer|-?nr))?|personalausweis(?:nummer)?|ausweis(?:nummer|-?nr)?|"
    r"dni|nie|nif|nss|cpf|rg|cni|nir|insee|carte d['’]identité|sécurité sociale|numéro fiscal|seguridad social|documento de identidad|cartão de cidadão|bilhete de identidade|segurança social|"
    r"driving licen[cs]e|driver['’]?s licen[cs]e|führerschein(?:nummer)?|permis de conduire|carnet de conducir|carta de condução|codice fiscale|pesel|bsn|снилс|инн|водительское удостоверение"
)
_ID = re.compile(
    rf"(?<![\w-])(?P<label>{_ID_LABEL})(?![^\W\d_])(?P<word>\s*(?:number|numbers|no\.?|nr\.?|n[º°o]\.?|num\.?|nummer|numéro|número|номер|№|#))?\s*(?:is|:|=|-|–|—|,)?\s*"
    r"(?P<value>(?=[A-Z0-9./ -]*\d)[A-Z0-9](?:[ ./-]?[A-Z0-9]){4,23})(?![\w])",
    re.I,
)
# Labels that may stand before other numbers too: only a check digit makes what follows an identity number.
_GENERIC_LABEL = r"id|identification|document|documento|dokument|ausweis|pièce|doc|personal"
_ID = re.compile(_ID.pattern.replace(_ID_LABEL, f"{_ID_LABEL}|{_GENERIC_LABEL}", 1), re.I)
_GENERIC = set(_GENERIC_LABEL.split("|"))
#: Number of other things: orders, books, pages.
_OTHER_NUMBER = re.compile(r"\b(?:order|isbn|issn|catalogue|catalog|shelf|invoice|edition|page|chapter|lot|item|reference|parcel|ticket|archive)\b", re.I)
_ID_WORDS = re.compile(r"\b(?:born|holder|issued|citizen|resident|nationality|date of birth|payment|tax|insured|geboren|ausgestellt|née?|nacid[oa]|nascid[oa]|expedid[oa])\b", re.I)
_SHORT_LABEL = {"ni", "nie", "sin", "tin", "rg", "identity", "nir", "nif"}
_ID_VALUE = re.compile(r"[A-Z0-9](?:[ ./-]?[A-Z0-9])*")

# street addresses
_TOWN = r"(?:,?\s+\d{4,5}\s+[A-ZÀ-Þ][\w'’-]+(?:[ -][A-ZÀ-Þ][\w'’-]+)?|,?\s+[A-ZÀ-Þ][\w'’-]+\s+\d{4,5}\b(?![ -]?\d)|,\s+[A-ZÀ-Þ][\w'’-]+(?:-[\w'’-]+)*)?"
_HOUSE = r"\d{1,4}\s?(?:[a-hA-H]\b)?"
_FLAT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\s?\d+[a-zA-Z]?,?\s+)?"
_CAPS = r"[A-ZÀ-Þ][\w'’-]*"
_ADDRESS = [
    re.compile(rf"(?<![\w.]){_FLAT}{_HOUSE},?\s+(?:{_CAPS}\s+){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Way|Close|Court|Ct|Hill|Drive|Dr|Place|Pl|Square|Sq|Terrace|Crescent|Row|Gardens|Grove|Walk|Mews|Boulevard|Blvd|Yard|Gate|Green|Rise|Alley|Parade|Quay)\b\.?{_TOWN}"),
    re.compile(rf"(?<![\w.])\d{{1,4}}(?:\s?(?:bis|ter|quater)\b|\s?[a-d]\b)?,?\s+(?:rue|avenue|av\.|bd\.?|boulevard|place|pl\.|quai|chemin|impasse|allée|route|cours|passage|square|ruelle|sentier|faubourg)\s+(?:(?:de la|de l['’]|du|des|de|d['’]|aux|au|à la|la|le|les)\s*)?{_CAPS}(?:[ -](?:(?:de|du|des|la|le|l['’])[ -]?)*{_CAPS})*{_TOWN}", re.I),
    re.compile(rf"(?<![\w])(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Lange|Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Hinter der|Unter den)\s+)?[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|ring|damm|hof|steig|graben|markt|berg)\s+\d{{1,4}}\s?[a-h]?\b{_TOWN}"),
    re.compile(rf"(?<![\w])(?:Am|An der|Im|Zum|Zur|Auf dem|Auf der)\s+[A-ZÄÖÜ][\wäöüß-]+\s+\d{{1,4}}[a-h]?\b{_TOWN}"),
    re.compile(rf"(?<![\w])(?:Calle|C/|C\.|Cl\.|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Pl\.|Paseo|P\.º|Camino|Ronda|Travesía|Carrera|Rua|R\.|Praça|Travessa|Largo|Alameda|Estrada|Via|Viale|Piazza|Corso)\s*(?:(?:de los|de las|de la|del|de|dos|das|do|da|d['’])\s+)?{_CAPS}(?:\s+(?:(?:de los|de las|de la|del|de|dos|das|do|da|y|e)\s+)?{_CAPS})*,?\s*(?:n\.?\s?[º°o]\.?\s*|núm\.?\s*|#)?\d{{1,4}}\s?[a-h]?\b{_TOWN}"),
    re.compile(r"(?<![\w])(?:ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|наб\.|набережная|пл\.|площадь|бульвар|б-р|шоссе)\s+[А-ЯЁ][\w-]+(?:\s+[А-ЯЁ]?[\w-]+)?,?\s*(?:д\.|дом)?\s*\d{1,4}[а-я]?(?:,\s*(?:кв\.|корп\.)\s*\d+)?"),
    re.compile(r"(?<![\w])[А-ЯЁ][\w-]+(?:ая|ый|ий|ой)\s+(?:ул\.|улица|пер\.|переулок|наб\.|набережная|пл\.|площадь),?\s*(?:д\.|дом)?\s*\d{1,4}[а-я]?"),
]
_ADDRESS_HINT = re.compile(r"\d")

# A list of given names of our own; other names need a context.
GIVEN = set(
    """abdul abigail adam adrian agnes ahmed aisha akira alan albert alejandro alex alexander alexandra alexandre alexei alexey alfred ali alice alicia alison amanda amara amelia
    amina amir amy ana anastasia andrea andreas andrei andrew andrzej andré andrés angela anja ann anna anne annette anthony anton antonio arjun arnaud arthur arturo astrid ayesha
    aylin barbara barbro beatrice beatriz ben benedict benjamin bernard bernd bianca birgit björn boris brenda brian bridget brigitte bruno camille carla carlo carlos carmen carol
    caroline catherine cecilia charles charlie charlotte chen chiara chinedu chioma chloe chloé christian christina christine christoph christopher cindy claire clara claude
    claudia colette colin cornelia craig cristina cédric damian daniel danielle david deborah denis dennis derek diana diane diego dieter dirk dmitri dmitry dominik dominique
    donald dorothea dorothy douglas duncan ebba edgar edith edmund eduardo edward eileen eleanor elena elias elisabeth elise elizabeth ella emeka emil emilia emilie emily emma
    emmanuel enrique eric erik erika ernest ernst esther eugene eva evelyn ewa fabian fatima federico felix fernando fiona florian francesca francis francisco frank franz françois
    fred frederick frida friedrich fritz gabriel galina gareth geoffrey georg george gerald gerard gerhard gertrud gilles giovanni giulia gloria gordon graham greg gregor gregory
    greta guillaume gustav günter hana hannah hans harold harriet harry hassan heather heidi heinrich heinz helen helena helga henri henriette henrik henry herbert hiroshi holger
    horst howard hubert huda hugo ian ibrahim igor ilse imran ines inga ingeborg ingo ingrid inês irene irina isaac isabel isabelle ivan ivana jack jacob jakob jamal james jan
    jane janet janine jason javier jean jeanne jeff jennifer jens jeremy jerzy jessica jill joachim joan joana joanna johan johann johannes john jonas jonathan jorge jose josef
    joseph josé joão juan judith julia julian julie jurgen jutta jürgen kamal karen karim karin karl katarina kate katherine kathleen keith kenji kevin khadija kim
    klara klaus kofi krzysztof kumar kwame lakshmi lars laura laurent lawrence layla leila lena leo leon leonie leslie liam lina linda lorenzo lothar louis louise luca lucas lucia
    lucy luigi luis luisa lukas lydia lynn lúcia mads magda magdalena maja malcolm manfred manuel marc marcel marco marcus marek margaret margarita margot maria mariana marianne
    marie marina mario marion mark markus marlene marta martin mary mateo mathieu matthew matthias maureen maurice maximilian maya mehmet mei melanie michael michel michelle
    miguel mikhail mila miriam mohamed mohammad mohammed monica monika mustafa nadia nancy naomi nasreen natalia natalie neil ngozi nicholas nicolas nicole nigel nikolai nils nina
    nkechi noah noemie nora norbert norman noémie oleg olena olga oliver oluwaseun omar orla oscar oskar otto pablo pamela paolo pascal patricia patrick paul paula pauline pavel
    pedro peter petr petra philip philippe pierre piotr priya rachel rafael raj ralf ralph ramón raquel raymond rebecca reinhard renata renate rené reza richard rita robert
    rodrigo roger roland ronald rosa rosemary roy ruben rudolf ruth rüdiger sabine salma sam samir samira samuel sandeep sandra sara sarah sasha sean sergei sergey sergio shirley
    sigrid silvia simon simone sofia sofie solveig sophie stanislav stefan stella stephanie stephen steve steven stuart stéphane sunita susan susanne suzanne sven sylvia sylvie
    sébastien søren tadeusz takashi tamara tariq tatiana tatjana ted teresa theodor theresa thierry thomas tim timothy tina tobias tom tomas tomasz tomás toni ulrich ulrike ursula
    uwe valentina valerie vanessa vera veronica victor viktor vincent viola virginia vivian vladimir volker véronique walter wanda wang wei wendy werner wilhelm willem william
    wolfgang xavier xin yan yasmin yasmina yolanda yuki yusuf yves yvonne zahra zainab zoe zofia zoë ángel александр алексей андрей анна антон борис вера виктор владимир дмитрий
    евгений екатерина елена иван ирина мария михаил наталья николай ольга павел пётр светлана сергей татьяна юлия""".split()
)
_CAP = r"(?:[A-ZÀ-ÞА-ЯЁ][a-zß-ÿа-яё]+(?:[-'’][A-ZÀ-Þa-zß-ÿ]+)*|[A-ZÀ-ÞА-ЯЁ]{3,}(?:[-'’][A-ZÀ-Þ]{2,})*)"
_TOKEN = re.compile(r"[A-ZÀ-ÞА-ЯЁ][A-Za-zÀ-ÿА-Яа-яЁё]+")
_AFTER = re.compile(rf"(?:[ \t]+|[ \t]*\r?\n[ \t]*)(?:(?:[A-Z]\.\s*){{1,2}})?(?:(?:van|von|de|da|di|del|der|la|le)\s+)*(?P<family>{_CAP})")
_BEFORE = re.compile(rf"(?P<family>{_CAP})(?:,\s*|[ \t]+)$")
#: Two names, in either order, right before contact details or what such a line calls them.
_CALLED = rf"(?:{_ID_LABEL}|tel|phone|telephone|mobile|mail|e-mail|address|flat)"
_PAIR_BEFORE = re.compile(rf"(?<![\w'’-])(?P<a>{_CAP})(?:,[ \t]*|[ \t]+)(?:[A-Z]\.[ \t]*)?(?P<b>{_CAP})[ \t]*(?:[,;:(<\[—–|-]|\r?\n|[ \t])[ \t(<\[]*(?:(?i:{_CALLED})\b[^.\n]{{0,14}}?)?$")
_PAIR = re.compile(rf"(?P<a>{_CAP})(?:,[ \t]*|[ \t]+)(?:[A-Z]\.[ \t]*)?(?P<b>{_CAP})(?=[ \t]*(?:[.;:)\]]|\r?\n|$))")
_MADE_BY = re.compile(r"\b\w+(?:ed|en|wn|nt|pt|ad|ght|ld|nd) by (?=[A-ZÀ-ÞА-ЯЁ])")
_INITIAL = re.compile(r"\s+[A-Z]\.(?![a-z])")
# Phrases before the name of someone around the book.
_PERSON_PHRASES = """thanks to|thank you|letter from|translated by|submitted by|received from|signed by|confirmed by|edited by|sent by|read by|found by|proofread by|illustrated by|collected by|told by|neighbour|neighbor|friend|colleague|editor|
    translator|sincerely|regards|wishes|contact|kontakt|contacto|contato|author's file|author’s file|written by|it was|dear|attn|c/o|goes to|freundlichen grüßen|cordialement|atentamente|atenciosamente|спасибо|редактор|переводчик|dr|prof|mr|mrs|ms|mme|herr|frau|sr|sra|sir|lady|
    rev|madame|monsieur|übersetzt von|eingereicht von|traduit par|envoyé par|traducido por|enviado por|traduzido por""".replace("\n", "")
#: Those of them after which two names are somebody by themselves.
_STRONG_PHRASES = set(
    """thanks to|letter from|translated by|submitted by|signed by|edited by|sent by|read by|proofread by|illustrated by|collected by|written by|sincerely|regards|wishes|dear|attn|c/o|author's file|author’s file|freundlichen grüßen|cordialement|
    atentamente|atenciosamente|übersetzt von|eingereicht von|traduit par|envoyé par|traducido por|enviado por|traduzido por""".replace("\n    ", "").split("|")
)
#: Capitalised words that begin no name.
_NOT_GIVEN = set("the a an our my your his her their its this that all old new saint der die das dem den ein eine le la les un une el los las o os as um uma reader readers friends".split())
_LEAD = re.compile(r"[\s,:.—–-]*(?:(?:Dr|Prof|Mr|Mrs|Ms|Mme|Herr|Frau|Sr|Sra)\b\.?\s+)?")
_TITLES = set("dr prof mr mrs ms mme herr frau sr sra sir lady rev hon madame monsieur".split())
_PERSON_AFTER = re.compile(r"^[\s,;:—–(<\[-]*(?:<|[\w.+-]+@|\+?\(?\d{2,}|for reading|told me|on the telephone|[\w.+-]+ (?:\[at\]|\(at\)|at) |\((?:tel|dni|passport|social|national|ni|driving|tax|ssn)|passport|social security|national insurance|dni|ssn|ni number|driving)", re.I)
#: Given-name-like words that begin sentences or name places.
_MONTHS = set("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
_PLACE_END = _MONTHS | set("hill moor street road lane way close court avenue place square house hall bridge gate harbour river lake valley church station town village north south east west".split())
_NOT_GIVEN |= _PLACE_END


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(value: str) -> bool:
    """The check of bank accounts and some identity numbers: country and check digits first."""
    moved = value[4:] + value[:4]
    return moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def dni(value: str) -> bool:
    return len(value) == 9 and value[:8].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(value[:8]) % 23] == value[8].upper()


def nie(value: str) -> bool:
    """A foreigner's number: X, Y or Z stands for a first digit."""
    return len(value) == 9 and value[0].upper() in "XYZ" and dni(str("XYZ".index(value[0].upper())) + value[1:])


def cpf(value: str) -> bool:
    """Eleven digits, the last two weighted sums of those before."""
    if len(value) != 11 or not value.isdigit() or len(set(value)) == 1:
        return False
    d = list(map(int, value))
    return all(d[n] == sum((n + 1 - k) * d[k] for k in range(n)) * 10 % 11 % 10 for n in (9, 10))


def nir(value: str) -> bool:
    """Thirteen digits and a key of two, mod 97."""
    return len(value) == 15 and value.isdigit() and 97 - int(value[:13]) % 97 == int(value[13:])


#: Shapes that have check digits, with their check and what it says when it passes: a check that one number in ten passes says little.
CHECKS = [
    (re.compile(r"\d{8}[A-Za-z]"), dni, 0.35), (re.compile(r"[XYZxyz]\d{7}[A-Za-z]"), nie, 0.35), (re.compile(r"\d{15}"), nir, 0.35),
    (re.compile(r"[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30}"), lambda v: mod97(v.upper()), 0.35), (re.compile(r"\d{11}"), cpf, 0.35),
    (re.compile(r"\d{9}|\d{13}|\d{16}"), luhn, 0.15),
]
#: Taken off where a shape has check digits and none of its checks passes.
FAILED = 0.1


def checked(value: str) -> float:
    """What check digits add to or take off the score of a number without blanks and signs; 0 for shapes without any."""
    asked = [(check, gain) for shape, check, gain in CHECKS if shape.fullmatch(value)]
    passed = [gain for check, gain in asked if check(value)]
    return max(passed) if passed else -FAILED if asked and max(gain for _, gain in asked) > 0.2 else 0.0


def emails(text: str) -> list[Span]:
    out = []
    if "@" in text:
        out += [Span(*m.span(), "email", 1.0) for m in _EMAIL.finditer(text)]
    if _SPELLED_HINT.search(text):
        out += [Span(*m.span(), "email", 0.9) for m in _EMAIL_SPELLED.finditer(text)]
    return out


def phones(text: str, taken: list[Span]) -> list[Span]:
    out = []
    for m in _PHONE.finditer(text):
        start, end = m.span()
        if any(s.start < end and start < s.end for s in taken):
            continue
        digits = re.sub(r"\D", "", m.group())
        if not 7 <= len(digits) <= 15:
            continue
        score = {"plus": 0.9, "area": 0.7, "long": 0.6, "pairs": 0.7, "trunk": 0.6, "short": 0.35, "plain": 0.35}[m.lastgroup]
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        if _PHONE_WORDS.search(before) or _PHONE_WORDS.search(after):
            score += 0.3
        if digits.startswith("555") and m.lastgroup == "short":
            score += 0.25
        if _NOT_PHONE.search(before):
            score -= 0.5
        if luhn(digits) and len(digits) in (15, 16):
            score -= 0.3  # a card
        out.append(Span(start, end, "phone", score))
    return out


def identities(text: str, anchors: list[int]) -> list[Span]:
    out: list[Span] = []
    for at in anchors:
        m = _ID.match(text, at)
        if m is None or (out and m.start("value") < out[-1].end):
            continue
        value = m.group("value")
        # the value ends where words begin
        parts = re.split(r"(\s)", value)
        keep = ""
        for part in parts:
            if part.isalpha() and len(part) > 3 and not part.isupper():
                break
            keep += part
        keep = keep.rstrip(" ./-")
        plain = re.sub(r"[ ./-]", "", keep)
        if len(plain) < 6 or sum(c.isdigit() for c in plain) < 4:
            continue
        label = m.group("label").lower()
        if label in _GENERIC:
            score = 0.2
        elif label in _SHORT_LABEL and m.group("word") is None and not m.group("label").isupper():
            score = 0.2
        else:
            score = 0.6
        score += checked(plain) + (0.1 if label in _GENERIC else 0.2) * (m.group("word") is not None)
        around = text[max(0, m.start() - AROUND) : m.start()] + " " + text[m.start("value") + len(keep) : m.start("value") + len(keep) + AROUND]
        if _ID_WORDS.search(around):
            score += 0.1
        if _OTHER_NUMBER.search(text[max(0, m.start() - 20) : m.start()]):
            score -= 0.2
        out.append(Span(m.start("value"), m.start("value") + len(keep), "id_number", score))
    return out


def addresses(text: str) -> list[Span]:
    if not _ADDRESS_HINT.search(text):
        return []
    out: list[Span] = []
    for pattern in _ADDRESS:
        for m in pattern.finditer(text):
            if not any(s.start < m.end() and m.start() < s.end for s in out):
                out.append(Span(m.start(), m.end(), "address", 0.8))
    return out


class Anchors:
    """Labels of identity numbers and phrases about people, found in one pass by an automaton."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        labels = {re.sub(r"\W.*", "", x) for x in _ID_LABEL.split("|")} | _GENERIC
        people = {x.strip() for x in _PERSON_PHRASES.split("|")}
        for kind, words in (("id", labels), ("person", people - _STRONG_PHRASES), ("strong", _STRONG_PHRASES)):
            for word in words:
                known = self.automaton.get(word, ())
                self.automaton.add_word(word, (*known, (kind, len(word))))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[list[int], dict[int, bool]]:
        """Where labels begin, and where names after phrases would begin (true after a strong one)."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        labels, people = [], {}
        n = len(low)
        for end, kinds in self.automaton.iter(low):
            for kind, size in kinds:
                start = end - size + 1
                if start and low[start - 1].isalnum():
                    continue
                if kind == "id":
                    labels.append(start)
                elif end + 1 == n or not low[end + 1].isalnum():
                    at = _LEAD.match(text, end + 1).end()
                    people[at] = people.get(at, False) or kind == "strong"
        if " by " in text:  # whatever was done by somebody: a weak phrase
            for m in _MADE_BY.finditer(text):
                people.setdefault(_LEAD.match(text, m.end()).end(), False)
        return labels, people


_ANCHORS: list[Anchors] = []


def anchors(text: str) -> tuple[list[int], dict[int, bool]]:
    if not _ANCHORS:
        _ANCHORS.append(Anchors())
    return _ANCHORS[0](text)


def names(text: str, taken: list[Span], people: dict[int, bool]) -> list[Span]:
    """Given and family name in either order: a known given name, or two names in a context that is about people around the book."""
    out: list[Span] = []
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        low = m.group().lower()
        given, about = low in GIVEN, start in people
        if not (given or about) or low in _TITLES or (out and start < out[-1].end):
            continue
        if any(s.start < end and start < s.end for s in taken):
            continue
        tail = end + (lambda i: len(i.group()) if i else 0)(_INITIAL.match(text, end))
        follows = any(0 <= s.start - tail <= 3 for s in taken)  # an address, a number: contact lines
        prior = _BEFORE.search(text[max(0, start - 40) : start]) if given else None
        if prior:
            head = start - len(prior.group())
            family = prior.group("family").lower()
            near = follows or bool(_PERSON_AFTER.match(text[tail : tail + 40])) or bool(re.match(r"\s*[\])>.;:|]|[ \t]*\n|\s+(?:and|und|et|y|e)\s|\s*$", text[tail : tail + 6]))
            reverse = 0.3 + 0.2 * ("," in prior.group()) + 0.35 * (head in people) + 0.2 * near
            if family in GIVEN or family in _PLACE_END or family in _TITLES or (out and head < out[-1].end):
                reverse = 0.0
            if "," in prior.group() and head in people and reverse > LEAST_SCORE:
                out.append(Span(head, tail, "name", reverse))
                continue
        after = _AFTER.match(text, end)
        if after and after.group("family").lower() not in _PLACE_END and not any(s.start < after.end() and start < s.end for s in taken):
            stop = after.end()
            score = 0.6 * given + 0.35 * about
            if not given:  # the family name first
                score += 0.2 * (people[start] and low not in _NOT_GIVEN)
                score += 0.4 * (after.group("family").lower() in GIVEN) + 0.2 * bool(_PERSON_AFTER.match(text[stop : stop + 40]))
            elif after.group("family").lower() in GIVEN and not about:
                score -= 0.2
            if score >= LEAST_SCORE:
                out.append(Span(start, stop, "name", score))
                continue
        if prior and reverse > LEAST_SCORE:
            out.append(Span(head, tail, "name", reverse))
    return out + _by_context(text, taken + out, people)


#: What two capitalised words are worth as a name, and what contact details after them or a strong phrase before them add.
PAIR, CONTACT, PHRASE = 0.3, 0.3, 0.25


def _by_context(text: str, taken: list[Span], people: dict[int, bool]) -> list[Span]:
    """Names that no list knows: two capitalised words in either order right before contact details, or after a strong phrase."""
    out: list[Span] = []

    def add(start: int, end: int, a: str, b: str, score: float) -> None:
        low = {a.lower(), b.lower()}
        if low & (_NOT_GIVEN | _TITLES | _PLACE_END) or any(s.start < end and start < s.end for s in taken + out):
            return
        out.append(Span(start, end, "name", score))

    for s in taken:
        if s.kind == "name" or s.score < LEAST_SCORE:
            continue
        low = max(0, s.start - 80)
        if m := _PAIR_BEFORE.search(text[low : s.start]):
            start = low + m.start("a")
            add(start, low + m.end("b"), m.group("a"), m.group("b"), PAIR + CONTACT + PHRASE * people.get(start, False))
    for start, strong in people.items():
        if strong and (m := _PAIR.match(text, start)):
            add(start, m.end("b"), m.group("a"), m.group("b"), PAIR + PHRASE)
    return out


def spans(text: str | None) -> list[Span]:
    """All spans of LEAST_SCORE or more, in order, none overlapping another; none for null and empty texts."""
    if not text:
        return []
    labels, people = anchors(text)
    found = emails(text)
    found += identities(text, labels)
    if _ADDRESS_HINT.search(text):
        found += addresses(text)
        found += phones(text, found)
    found += names(text, found, people)
    found = sorted((s for s in found if s.score >= LEAST_SCORE), key=lambda s: (-s.score, s.start))
    kept: list[Span] = []
    for s in found:
        if not any(k.start < s.end and s.start < k.end for k in kept):
            kept.append(s)
    return sorted(kept)


def redact(text: str, found: list[Span]) -> str:
    """The text with [EMAIL], [PHONE] and so on in place of the spans."""
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("t")).where(F.length("t") > 0)


def personal(df: DataFrame) -> DataFrame:
    """doc_id, kind, n, score: each kind of personal information that a document holds, how often, and its best score.

    Null and empty texts hold none; a repeated document counts under each id;
    other columns are not read. One pass, no shuffle.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], []]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by: dict[str, list[float]] = {}
                for s in spans(t):
                    by.setdefault(s.kind, []).append(s.score)
                for kind, scores in by.items():
                    for col, value in zip(cols, (doc, kind, len(scores), max(scores))):
                        col.append(value)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "kind", "n", "score"])

        return step

    return map_rows(_rows(df), "doc_id bigint, kind string, n int, score double", make)


def redacted(df: DataFrame) -> DataFrame:
    """doc_id, redacted: each document that holds personal information, with placeholders in its place."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := spans(t):
                    ids.append(doc)
                    texts.append(redact(t, found))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "redacted"])

        return step

    return map_rows(_rows(df), "doc_id bigint, redacted string", make)
