import itertools
import random
import unicodedata

import pytest

from quillgrid.llm import lookalike as la

TERMS = ["Fixed Cost", "Café société (%)", "Сумма расход", "Ο χρόνος A/B", "Co-Op No. 48", "Điểm tháng", "По", "x"]
SWAPS = {"a": "а", "c": "с", "e": "е", "o": "οоօ", "p": "р", "x": "х", "i": "і", "F": "Ｆ", "C": "СＣ", " ": "\xa0　 ", "-": "‐‑－", "о": "oο", "с": "c", "р": "p", "ο": "oо", "А": "A"}


@pytest.fixture(scope="module")
def lattice():
    pairs = la.count_pairs([t for t in TERMS for _ in range(3)] + ["the cat sat on a box", "работа по цена с в", "και το ο η στην"])
    total = {}
    for (a, _), n in pairs.items():
        total[a] = total.get(a, 0) + n
    from math import log

    return la.Lattice({k: log((n + 0.1) / (total[k[0]] + 20)) for k, n in pairs.items()})


def disguise(text, rng):
    out = []
    for ch in unicodedata.normalize("NFD" if rng.random() < 0.5 else "NFC", text):
        out.append(rng.choice(SWAPS[ch]) if ch in SWAPS and rng.random() < 0.5 else ch)
        if rng.random() < 0.2:
            out.append(rng.choice("​­⁠﻿͏‎"))
    return "".join(out)


def test_disguises_meet_their_term(lattice):
    rng = random.Random(3)
    for _ in range(400):
        term = rng.choice(TERMS)
        assert lattice.form(disguise(term, rng)) == lattice.form(term)
    for term in TERMS:
        assert lattice.form(term) == term


def test_visible_differences_stay(lattice):
    forms = {lattice.form(t) for t in ("Fixed Cost", "fixed cost", "Fixed Cost2", "Fixed Cost²", "Fixed—Cost", "Fixéd Cost", "FixedCost", "Fixed Costs")}
    assert len(forms) == 8


def test_viterbi_against_every_path(lattice):
    """The best score of each script equals that of the best of all paths, marks within a word included."""
    rng = random.Random(5)

    def score(letters):
        total, had, last = 0.0, None, "^"
        for ch in letters:
            kind = la.script(ch)
            total += lattice.pairs.get((last, ch), la.UNSEEN) - (la.SWITCH_IN_WORD if had and kind and had != kind else 0.0)
            had, last = kind or had, ch
        return had, total + lattice.pairs.get((last, "$"), la.UNSEEN)

    words = ["o\u0301", "co\u0301p", "x\u0301o\u0301"] + ["".join(rng.choice("ocpxaHbe\u0301\u0306") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    for word in words:
        key = word.translate(lattice.key)
        best = {}
        for letters in itertools.product(*(lattice.groups.get(ch, (ch,)) for ch in key)):
            kind, total = score(letters)
            best[kind] = max(best.get(kind, -1e9), total)
        got = {kind: s for kind, (s, _) in lattice.word(key).items()}
        assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-9 for k in best), word
        assert all(score(letters)[1] == pytest.approx(s) for s, letters in lattice.word(key).values())
    assert len(lattice.word("o\u0301")) == 4


def test_odd_texts(lattice):
    assert lattice.form(None) is None and lattice.form("") == "" and lattice.form("12 + 3") == "12 + 3" and lattice.form("​﻿") == ""
    assert lattice.form("学校。カタログ") == "学校。カタログ" and lattice.form("ﬁn") == "fin" and lattice.form("́") == "́"
    assert len(lattice.form("сat " * 50_000)) == 200_000
    assert lattice.form(lattice.form("Fіхеd Соst")) == "Fixed Cost"


def test_empty_model():
    assert la.Lattice({}).form("Fіxеd") == "Fixed"


def test_tables(spark):
    terms = spark.createDataFrame([(1, "Fixed Cost", "en"), (2, "Сумма", "ru"), (3, None, None), (4, "", None), (5, "Fixed Cost", "en")], "term_id long, term string, text string")
    cells = spark.createDataFrame([(1, "Fixed Cost", "f"), (2, "Fіxed Cost", "f"), (2, "Fіxed Cost", "f"), (3, None, None), (4, "", None), (5, "fixed cost", None)], "cell_id long, value string, form string")
    boxes = spark.createDataFrame([(7, "Cумма​", 1)], "box_id long, text string, row_id int")
    spans = spark.createDataFrame([], "span_id long, text string")
    got = sorted(map(tuple, la.same_as_terms(cells, boxes, spans, terms).collect()))
    assert got == [("cells", 2, 1), ("cells", 2, 1), ("cells", 2, 5), ("cells", 2, 5), ("text_boxes", 7, 2)]
    assert la.same_as_terms(cells.limit(0), boxes.limit(0), spans, terms).collect() == [] and la.same_as_terms(cells, boxes, spans, terms.limit(0)).collect() == []
    forms = {(r.src, r.row_id): r.form for r in la.unified(cells, boxes, spans, terms).collect()}
    assert forms["cells", 2] == "Fixed Cost" and forms["text_boxes", 7] == "Сумма" and ("cells", 3) not in forms


def test_real_labels_against_brute_force(spark, small):
    """Rows found are those whose look, one representative for each group of look-alikes, is a term's."""
    groups = la.Lattice({}).key
    look = lambda t: la.visible(t).translate(groups)
    tables = {t: spark.read.parquet(f"{small}/{t}.parquet") for t in ("cells", "text_boxes", "styled_spans", "term_catalog")}
    terms = {look(r.term): r for r in tables["term_catalog"].collect()}
    rows = la.texts_of(tables["cells"], tables["text_boxes"], tables["styled_spans"]).where("text <> ''").collect()
    want = sorted((r.src, r.row_id, terms[look(r.text)].term_id) for r in rows if look(r.text) in terms and terms[look(r.text)].term != r.text)
    assert sorted(map(tuple, la.same_as_terms(*tables.values()).collect())) == want and want
