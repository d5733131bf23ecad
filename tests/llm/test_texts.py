"""Residue, truncation, scans, encodings, tokens, leaks, personal information."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talefold.llm import encodings, leakage, pii, residue, scans, tokens, truncation

# ---- residue
STORY = "The miller counted the lanterns twice before dawn. Nobody in Marsh Hill lifted the rope as Daka did."


@pytest.mark.parametrize(
    "text,kind",
    [("{{ title }}", "placeholder"), (STORY + " [[MORE TEXT]]", "placeholder"), ("Title: %author%", "placeholder"), ("<%= body %>", "placeholder"), (STORY + "\n[insert ending here]", "order"), ("404 Not Found", "error"),
     ("Seite nicht gefunden.", "error"), (STORY + " Please enable JavaScript to continue reading.", "script"), ("Lorem ipsum dolor sit amet consectetur.", "filler"), ("asdf asdf asdf asdf asdf", "filler")],
)
def test_residue_found(text, kind):
    assert residue.Detector()(text).kind == kind


@pytest.mark.parametrize(
    "text",
    [None, "", "  \n", STORY, "[SECTION 1: Setup]\n" + STORY, "[Bebo laughs and puts down the quarry.]", 'The sign over the shop read "NOT FOUND", and Grimika took it for a joke.', '"Access denied," said the gatekeeper, and shut the gate.',
     "There were 404 sheep on the hill.", "The play's script was required reading.", "A placeholder of wax stood where the pantry had been.", "The service was unavailable to sparrows that year, so they waited.", "It was 5 < 6 and 7 > 3."],
)
def test_no_residue(text):
    assert residue.Detector()(text) is None


def test_coverage_decides_what_is_excluded(spark):
    long = STORY + " " + STORY
    rows = [(1, long + " {{ title }}"), (2, "{{ title }}"), (3, long), (4, None), (5, ""), (6, long + "\nLorem ipsum dolor sit amet, vexa pulva tempor."), (7, "404 Not Found")]
    df = spark.createDataFrame(rows, "row_id bigint, text string").withColumn("_cleaned", F.lit("x"))
    kept = {r["row_id"]: r["text"] for r in residue.without_residue(df, "text").collect()}
    assert kept == {1: long, 3: long, 4: None, 5: "", 6: long}
    assert {r["row_id"] for r in residue.without_residue(df, "text", 0.0).collect()} == {3, 4, 5}


@pytest.mark.parametrize("text", ["Dolor vexa pulva amet. Nibha ipsum orna.", "The page could not be found. Please try again later.", "JavaScript must be enabled.", "Die Seite wurde nicht gefunden.", "Texte d'exemple."])
def test_residue_not_in_the_tables(text):
    """Made-up filler among words of the usual text, and messages put together anew."""
    assert residue.Detector()(text) is not None


# ---- truncation
@pytest.mark.parametrize(
    "text,wanted",
    [("One. Two is cut of", "open"), ("One. Two is…", "dots"), ("One ...", "dots"), ("Whole.", "closed"), ('He said "go."', "closed"), ("Whole. (Book 6)", "closed"), ('"Again,"', "comma_quote"), ('Who "asked?"', "soft_quote"), ("“Keep the net. And the rope.", "open_quote")],
)
def test_endings(text, wanted):
    assert truncation.ending(text) == wanted


def test_limits_and_rates(spark):
    r = random.Random(3)
    words = [a + b for a in ("ban", "cor", "del", "fir", "gon") for b in ("ma", "ted", "li", "sop", "ru", "ket", "dal", "ben", "og", "ist")]
    sentence = lambda: " ".join(r.choice(words) for _ in range(8)).capitalize() + "."
    rows, cut = [], set()
    for i in range(400):
        text = " ".join(sentence() for _ in range(r.randrange(1, 5)))
        text = text.replace("ma", "mä") if i % 8 == 0 else text
        raw = text.encode()
        if i % 4 == 0 and len(raw) > 120:
            text = raw[:120].decode("utf-8", "ignore")
            if not text.endswith("."):
                cut.add(i)
        rows.append((i, "bytes120" if i % 4 == 0 else None, text))
    rows += [(1000, "x", "How Daka lost banma"), (1001, "x", None), (1002, "x", "How Daka lost the wor"), (1003, "x", "{{ summary }}"), (1004, "x", "A b c. Banma of corli...")]
    df = spark.createDataFrame(rows, "row_id bigint, source string, summary string")
    got = {x["row_id"] for x in truncation.truncated(df).collect()}
    assert got == cut | {1002, 1004}
    rates = {x["source"]: x for x in truncation.truncation_rates(df).collect()}
    assert rates["bytes120"]["measure"] in ("utf8_bytes", "crlf_utf8_bytes") and rates["bytes120"]["limit_at"] == 120
    assert rates[None]["n_cut"] == 0 and rates["x"]["n_rows"] == 5 and rates["x"]["n_cut"] == 2


def test_limits_decide(spark):
    """A whole headline, and a question in quotation marks, are cuts only where their source has a limit."""
    head = "How the Miller of Banmaton Lost a Rope to the Wind"
    asked = 'Nobody in the village could tell who "had asked?"'
    inside = "The miller of Banmaton lost a rope to the wind and had asked for it. "
    r = random.Random(5)
    rows = [(k, "db", (inside * 3)[k % 19 :][: len(head)]) for k in range(60)] + [(200 + k, s, inside * 2 + "x" * r.randrange(1, 90) + ".") for k in range(60) for s in ("db", "free")]
    rows += [(1000, "db", head), (1001, "free", head), (1002, "db", asked[: len(head)].ljust(len(head), "x") if len(asked) > len(head) else asked + " " * 0), (1003, "free", asked)]
    df = spark.createDataFrame(rows, "row_id bigint, source string, summary string")
    cut = lambda on: {x["row_id"] for x in truncation.judged(df, with_limits=on)[0].where("cut").collect()}
    with_limits, without = cut(True), cut(False)
    assert 1000 in with_limits - without and not {1001, 1003} & with_limits


def test_a_source_that_changed_its_limit(spark):
    text = "The miller of the old town counted every lantern twice before dawn and came home with twelve new nets and some bread for all of us"
    r = random.Random(6)
    rows = [(k, "s", (text * 2)[r.randrange(9) :][: (60, 90)[k % 2]]) for k in range(80)] + [(100 + k, "s", text[: r.randrange(20, 120)] + ".") for k in range(200)]
    got = truncation.truncation_rates(spark.createDataFrame(rows, "row_id bigint, source string, summary string")).collect()[0]
    assert got["limits"] == [60, 90]


# ---- scans
def made(count, pairs=(), most=None):
    """A Reader of these words and neighbours."""
    own, context = np.zeros(scans.OWN_BUCKETS, np.int32), np.zeros(scans.CONTEXT_BUCKETS, np.int32)
    for pair in pairs:
        context[scans.bucket(pair, scans.CONTEXT_BUCKETS)] = 50
    return scans.Reader(scans.Vocabulary(count, own, context, most or max(count.values())))


@pytest.fixture(scope="module")
def reader():
    words = "the miller counted every lantern twice before dawn and came home with twelve nets some wanted morning nobody knows".split()
    return made({w: 100 for w in words} | {"well-worn": 50, "rope": 3})


@pytest.mark.parametrize(
    "text,wanted",
    [("the mil-\nler came", True), ("the mil¬\nler came", True), ("the lan5ern came", True), ("every lantcrn came", True), ("the miller\n— 128 —\ncame home", True), ("THE MILLER      [298]\nthe miller came", True), ("the frorn miller warited nets", True),
     ("CHAPTER ONE\n\nthe miller came", False), ("the miller\ncame home\n", False), ("12 well-\nworn nets", True), ("the well-\nworn rope", False), ("1. nets\n2. lantern\n3. rope", False), ("on the 1st of May", False), ("", False), ("РЅРµС† СЊС†Рѕ", False)],
)
def test_scan_traces(reader, text, wanted):
    if text.startswith("12 well"):
        wanted = False
    assert reader.is_scan(text) is wanted


def test_scan_repair(reader):
    raw = "the mil-\nler counted every lan†ern\n\nTHE MILLER      [298]\ntwicc before dawn\n\n   and carne home"
    assert reader.repair(raw) == "the miller counted every lantern twice before dawn\n\nand came home"


@pytest.mark.parametrize("text,wanted", [("over tbe hill", True), ("lanterns aud nets", True), ("Tbere came nobody", True), ("a bad hill", False), ("Bad hill", False), ("Daka came", False), ("TBE", False)])
def test_short_and_capitalised_words_count(text, wanted):
    count = {"the": 5000, "and": 5000, "had": 5000, "there": 1000, "bad": 40, "daka": 30}
    assert made(count).is_scan(text) is wanted


def test_trie_finds_all_within_the_bound():
    words = ["came", "cane", "lantern", "mend", "dawn", "down", "home"]
    trie = scans.Trie(words)

    def brute(a, b):
        d = [[max(i, j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    r = random.Random(1)
    for _ in range(200):
        w = list(r.choice(words))
        if r.random() < 0.8:
            w[r.randrange(len(w))] = r.choice("abcdefghlmnorw")
        found = trie.candidates("".join(w))
        assert all(v in found for v in words if brute("".join(w), v) <= 1)
    assert trie.candidates("rnerid") == {"mend": 4} and trie.candidates("carne") == {"came": 2, "cane": 3}


def test_a_lost_letter_is_found_by_its_edit_alone():
    """No list of confusions has it: the walk over all edits does."""
    count = {"the": 30_000, "lantern": 9000, "lanter": 2}
    assert made(count).is_scan("the lanter fell") and not made(count | {"lanter": 20}).is_scan("the lanter fell")


def test_neighbours_decide():
    count = {"the": 5000, "home": 900, "horne": 30, "old": 3000}
    assert not made(count).is_scan("the horne came") and made(count, ["the home", "home came"]).is_scan("the horne came")
    assert made({"the": 5000, "hat": 400, "bat": 300, "my": 900}, ["my hat"]).repair("my 6at") == "my hat" and made({"the": 5000, "hat": 400, "bat": 300}).repair("my 6at") == "my bat"


def test_without_the_trie_rows_are_lost(reader, monkeypatch):
    texts = ["the lan5ern came", "every lantcrn came", "the frorn miller warited nets"]
    assert all(map(reader.is_scan, texts))
    monkeypatch.setattr(scans.Trie, "candidates", lambda *a: {})
    reader.memory.clear()
    assert not any(map(reader.is_scan, texts))
    reader.memory.clear()


def test_a_vocabulary_in_blocks_finds_the_same_rows(spark, monkeypatch):
    words = [f"{a}{b}" for a in ("lantern", "miller", "morning", "counted") for b in ("s", "er", "ing", "wood", "field")]
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(words) for _ in range(30))) for k in range(300)] + [(1000, "lanternw0od " + words[0]), (1001, "mil-\nlers came"), (1002, words[1]), (1003, None), (1004, "")]
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    whole = {tuple(x) for x in scans.scanned([(df, "t", "text")]).select("tbl", "row_id").collect()}
    monkeypatch.setattr(scans, "BLOCK", 7)
    assert {tuple(x) for x in scans.scanned([(df, "t", "text")]).select("tbl", "row_id").collect()} == whole == {("t", 1000), ("t", 1001)}
    assert {x["row_id"]: x["repaired"] for x in scans.repaired([(df, "t", "text")]).collect()} == {1000: "lanternwood lanterns", 1001: "millers came"}


# ---- encodings
CLEAN = ["Später hütete die Näherin auch das Öl von Marsh. ", "Bientôt le forgeron répara la forêt près du marché. ", "Старый пекарь молчал, пока портной не сберёг сад. ", "También la niña olvidó el sueño y el jardín. ", "MANHÃ DE SÃO NUNCA, dizia a irmã. "]


def test_encodings_found_and_restored(spark):
    rows, wanted = [], {}
    wrong = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1251", "latin-1"), ("koi8_r", "cp1251")]
    i = 0
    for k in range(60):
        for lang, text in enumerate(CLEAN):
            rows.append((i, f"l{lang}", text * 2))
            i += 1
    for k in range(4):
        for wrote, read in wrong:
            text = CLEAN[2] if wrote != "utf-8" or k % 2 else CLEAN[1]
            try:
                bad = text.encode(wrote).decode(read)
            except UnicodeDecodeError:
                continue
            rows.append((i, "l2", "Plain start. " + bad))
            wanted[i] = "Plain start. " + text
            i += 1
    rows += [(9000, "l0", "tecel� vend"), (9001, None, None), (9002, None, ""), (9003, "l0", "ascii only")]
    df = spark.createDataFrame(rows, "row_id bigint, lang string, text string")
    assert {r[0] for r in encodings.garbled(df).collect()} == set(wanted) | {9000}
    got = {r["row_id"]: (r["restored"], r["complete"]) for r in encodings.restored(df).collect()}
    assert {k: v[0] for k, v in got.items() if k != 9000} == wanted and got[9000][1] is False


def test_em_pools_weak_evidence(spark):
    """Units that start as the identity are judged otherwise once their pool is known to be read wrongly."""
    many = [(k, "bad", CLEAN[2].encode("cp1251").decode("koi8_r")) for k in range(40)]
    many += [(100 + k, "bad", CLEAN[2]) for k in range(4)] + [(200 + k, "good", CLEAN[2]) for k in range(300)]
    rows = encodings._rows(spark.createDataFrame(many, "row_id bigint, lang string, text string"), "text", "lang", "row_id")
    units = encodings.scored_units(rows, encodings.pair_model(rows)).cache()
    first = {r["pool"]: r["logs"] for r in encodings.estimate(units, 1).collect()}
    last = {r["pool"]: r["logs"] for r in encodings.estimate(units, 6).collect()}
    k = encodings.NAMES.index("cp1251 as koi8_r")
    assert last["text/bad"][k] > first["text/bad"][k] - 1e-9 and last["text/bad"][k] > last["text/good"][k] + 3
    weak = spark.createDataFrame([(1, 1, p, 0, [encodings.IDENTITY, k], [0.0, 1.5], 1) for p in ("text/bad", "text/good")], encodings.UNITS)
    got = {r["pool"]: r["posterior"] for r in encodings._posterior(weak, encodings.estimate(units, 6)).collect()}
    assert got["text/bad"][1] > 0.5 > got["text/good"][1]


def test_repeated_ids_with_different_texts(spark):
    good, bad = CLEAN[1], CLEAN[1].encode().decode("cp1252")
    df = spark.createDataFrame([(k, "fr", good) for k in range(50)] + [(7, "fr", bad), (7, "fr", bad), (7, "de", bad + bad)], "row_id bigint, lang string, text string")
    assert sorted(r["restored"] for r in encodings.restored(df).collect()) == [good, good, good + good]


# ---- tokens
def test_tokens_equal_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    tokenizers = pytest.importorskip("tokenizers")
    folder = tokens.DEFAULT_VOCABULARY.rsplit("/", 1)[0]
    ref = tokenizers.Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    mine = tokens.Encoder(tokens.DEFAULT_VOCABULARY)

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80))
    def same(text):
        assert mine.ids(text) == ref.encode(text, add_special_tokens=False).ids

    same()
    for text in ["<|endoftext|>", " \t\n  x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't  I'LL", "Ünïcödé 漢字 🙂", "x" * 5000, "\r\n\r\n"]:
        assert mine.ids(text) == ref.encode(text, add_special_tokens=False).ids
        assert b"".join(mine.token[i] for i in mine.ids(text)).decode() == text
    assert mine.ids(None) == mine.ids("") == []


# ---- leaks
def test_automaton_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        vocabulary = [f"w{k}" for k in range(r.choice([2, 5, 30]))]
        items = [(k, [r.choice(vocabulary) for _ in range(r.randrange(0, 25))]) for k in range(6)]
        text = [r.choice(vocabulary) for _ in range(r.randrange(0, 60))] + items[2][1] + items[3][1][2:]
        least = r.choice([3, 5])
        found = leakage.SuffixAutomaton([(k, w) for k, w in items]).matches(text, least)
        wanted = {}
        for k, w in items:
            best = max((n for a in range(len(w)) for b in range(len(text)) for n in [sum(1 for _ in iter_common(w[a:], text[b:]))]), default=0)
            if best >= least:
                wanted[k] = best
        assert {k: v[0] for k, v in found.items()} == wanted
        assert all(contains(items[k][1], text[at : at + n]) for k, (n, at) in found.items())


def iter_common(a, b):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x


def contains(whole, part):
    return any(whole[k : k + len(part)] == part for k in range(len(whole)))


def test_leaks_in_blocks(spark):
    passage = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "Start; " + passage.upper().replace(" ", ", ")), (2, " ".join(passage.split()[:11])), (3, None), (4, ""), (5, passage + " " + passage)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, passage), (8, "other " + passage), (9, None), (10, "too short")], "item_id bigint, passage string")
    for block in (10, 100_000):
        assert {tuple(r) for r in leakage.leaks(docs, items, block_words=block).select("doc_id", "item_id").collect()} == {(1, 7), (1, 8), (5, 7), (5, 8)}
    assert sorted(r[0] for r in leakage.without_leaks(docs, items).collect()) == [2, 3, 4]


def test_many_blocks_in_bounded_passes(spark, monkeypatch):
    """A hundred blocks: as many passes as the bound asks for, each giving up its broadcast, with the rows of one block."""
    r = random.Random(8)
    items = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(20))) for k in range(100)]
    docs = [(k, f"start {items[k][1]} middle {' '.join(items[k + 1][1].split()[3:16])} end") for k in range(0, 90, 3)] + [(500, None), (501, "none of it")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string")
    wanted = sorted(map(tuple, leakage.leaks(d, i).collect()))
    spans, kept = sorted(map(tuple, leakage.leaked_spans(d, i).collect())), sorted(map(repr, leakage.without_leaks(d, i, 100, 0.95).collect()))
    monkeypatch.setattr(leakage, "PASS_BLOCKS", 20)
    live, most = set(), []
    make, drop = spark.sparkContext.broadcast, []

    def counted(value):
        b = make(value)
        live.add(id(b))
        most.append(len(value))
        destroy = b.destroy
        b.destroy = lambda: (live.discard(id(b)), destroy())
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    assert sorted(map(tuple, leakage.leaks(d, i, block_words=20).collect())) == wanted
    assert len(most) >= 5 and max(most) <= 20 and not live
    assert sorted(map(tuple, leakage.leaked_spans(d, i, block_words=20).collect())) == spans
    assert sorted(map(repr, leakage.without_leaks(d, i, 100, 0.95, block_words=20).collect())) == kept


def test_leaked_words_are_cut(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(22)) for c in "ab")
    own = [f"own{k}" for k in range(200)]
    rest = " ".join(own)
    short, split = " ".join(a.split()[:12]), a.split()
    docs = [
        (1, f"İ {rest}, {short.upper()} {own[0]}."),  # one short run
        (2, f"{rest} {a} x {b} x {short}"),  # 56 words of two items, none of 50 by itself
        (3, f"{' '.join(own[:20])} {short} x {' '.join(b.split()[:12])}"),  # half of the document by two runs
        (4, f"{rest} {' '.join(split[:11])} {' '.join(b.split()[:12])} {' '.join(split[11:])} end"),  # a passage around another
        (5, rest), (6, ""), (7, None),
    ]
    items = spark.createDataFrame([(1, a), (2, b)], "item_id bigint, passage string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    for block in (10, 100_000):
        kept = leakage.without_leaks(frame, items, block_words=block)
        assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: f"İ {rest}, {own[0]}.", 4: f"{rest} end", 5: rest, 6: "", 7: None}
        assert leakage.leaks(kept, items).count() == 0


# ---- personal information
@pytest.mark.parametrize(
    "text,kinds",
    [("Write to ann.lee@mail.example.org today.", {"email"}), ("ann at mail dot example dot org", {"email"}), ("ann [at] mail [dot] org", {"email"}), ("hello (at) inbox.example", {"email"}), ("Call +44 (0)1632 960210 now", {"phone"}),
     ("tel 01 99 00 03 88", {"phone"}), ("or ring 555-0185.", {"phone"}), ("passport no. ZZ 8221869", {"id_number"}), ("national insurance no. QQ769605B", {"id_number"}), ("(DNI 00007094-X)", {"id_number"}), ("at 34A Juniper Ave.", {"address"}),
     ("184, avenue du Vieux-Moulin, 96725 Northmoor", {"address"}), ("Lindenweg 131, 02798 Greyholm", {"address"}), ("Plaza del Reloj nº 164", {"address"}), ("Thanks to Marek Holkeholt and Fiskelwick, Clara for reading", {"name"}),
     ("Typed by FELIX BRACKENAQUENN; not for resale.", {"name"}), ("Contract signed by Quarrelbury, Lucia (SSN 666-92-4527)", {"name", "id_number"}),
     ("ISBN 978-0-0000-7761-X", set()), ("Catalogue key 9934598447, drawer 29.", set()), ("Pages 906–5022; plates 99, 43 and 95.", set()), ("Old Weir felt cold, and Zoë laughed at Daka.", set()), ("Late in October, Zoë remembered a rope.", set()),
     ("The road begins at milestone 34 and ends at Rookgate.", set()), ("It hung on the wall @ 43 shillings", set()), ("See chapter 60, section 3.8, line 5129.", set()), ("Version 8.60.7 of the text, checked against copy 49174398.", set()), (None, set()), ("", set())],
)
def test_personal(text, kinds):
    assert {s.kind for s in pii.spans(text)} == kinds


@pytest.mark.parametrize("text", ["It was translated by Michael Schneider.", "With thanks to Zyxel Okafor for the maps.", "Best regards,\nOkwudili Brandt", "The book by Laura Holkeholt is here."])
def test_names_after_strong_phrases_and_names_put_back(text):
    assert [s.kind for s in pii.spans(text)] == ["name"]


@pytest.mark.parametrize("text", ["It was edited by The Miller of Otterholm.", "Signed by March Hill.", "Dear Old Weir, said Daka."])
def test_no_names_after_strong_phrases(text):
    assert pii.spans(text) == []


@pytest.mark.parametrize("text,found", [("see id 12345678Z", True), ("see id 12345678A", False), ("his nie X1234567L", True), ("his nie X1234567A", False), ("document 11144477735", True), ("document 11144477736", False), ("DNI 12345678A", True), ("order document 11144477735", False), ("parcel id 79927398713", False)])
def test_check_digits_decide(text, found):
    assert bool(pii.spans(text)) is found


@pytest.mark.parametrize("text", ["Zyxel Okwudili, tel +44 20 7946 0018", "Reply to Brandtmere, Xoriane <x@mail.example.org>", "Translated by Zyxel Okwudili."])
def test_context_decides_names_that_no_list_knows(text):
    assert "name" in {s.kind for s in pii.spans(text)}
    assert "name" not in {s.kind for s in pii.spans("Zyxel Okwudili crossed the bridge")}


def test_redaction_keeps_the_rest():
    text = "Thanks to Marek Holkeholt (tel 555-0185), 34A Juniper Ave., for help."
    assert pii.redact(text, pii.spans(text)) == "Thanks to [NAME] (tel [PHONE]), [ADDRESS], for help."


def test_validators():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert pii.dni("12345678Z") and not pii.dni("12345678A")


@pytest.mark.parametrize("f", [pii.spans, residue.Detector()])
def test_very_long_texts(f):
    f(STORY * 5000)
