"""Queries over documents whose whole range no SQL covers: compared with brute force."""

import re

import pytest

import __spark_entry__ as entry
from quillgrid.operators import recalc
from quillgrid.operators.formula import address


def test_text_transform_of_every_box(spark, small, tmp_path):
    texts = ["abc", "", None, "Straße ΟΔΟΣ", "éÉ ǆ İ", "日本語 かな", "e\u0301x", "😀a🏳️", "привет МИР", "ﬁn ŉ"]
    spark.createDataFrame(list(enumerate(texts)), "box_id long, text string").write.parquet(str(tmp_path / "text_boxes.parquet"))
    for root in (str(tmp_path), small):
        boxes = {b.box_id: b.text for b in spark.read.parquet(f"{root}/text_boxes.parquet").select("box_id", "text").collect()}
        got = {r.box_id: (r.upper, r.lower, r.backwards) for r in entry.queries()["text_transform"](spark, root).collect()}
        assert got == {k: (t.upper(), t.lower(), t[::-1]) if t is not None else (None,) * 3 for k, t in boxes.items()}


def test_recalc_report_has_every_location(spark):
    schema = "doc_key string, sheet string, row_no int, col_no int, kind string, value string, num double, flag boolean"
    rows = [("d", "Z", r, c, "formula", "1/0", None, None) for r in range(12) for c in (0, 30)] + [("d", "A", 0, 1, "formula", "1/0", None, None), ("c", "S", 4, 0, "formula", "A5", None, None), ("c", "S", 0, 0, "formula", "1", None, None)]
    sheets = spark.createDataFrame([("d", "Z", 0), ("d", "A", 1), ("c", "S", 0)], "doc_key string, sheet string, sheet_no int")
    values = recalc.evaluate(spark.createDataFrame(rows, schema))
    want = [("#CYCLE!", 1, "c", "S!A5")] + [("#DIV/0!", 25, "d", f"Z!{c}{r}") for r in range(1, 13) for c in ("A", "AE")]
    assert [tuple(r) for r in recalc.errors(values, sheets).collect()] == [*want, ("#DIV/0!", 25, "d", "A!B1")]
    assert [tuple(r) for r in recalc.errors(values).collect()] == [want[0], ("#DIV/0!", 25, "d", "A!B1"), *want[1:]]


def test_recalc_report_query(spark, small):
    got = [tuple(r) for r in entry.queries()["recalc_report"](spark, small).collect()]
    cells = spark.read.parquet(f"{small}/cells.parquet")
    wrong = [r for r in recalc.evaluate(recalc.latest(cells)).collect() if r.error is not None]
    numbers = {(r.doc_key, r.sheet): r.sheet_no for r in cells.select("doc_key", recalc.sheet_name().alias("sheet"), "sheet_no").orderBy("sheet_no", ascending=False).collect()}
    wrong.sort(key=lambda r: (r.error, r.doc_key, numbers[r.doc_key, r.sheet], r.sheet, r.row_no, r.col_no))
    n = {e: len([r for r in wrong if r.error == e]) for e in {r.error for r in wrong}}
    assert len(got) > len(n) and got == [(r.error, n[r.error], r.doc_key, f"{r.sheet}!{address(r.row_no, r.col_no)}") for r in wrong]


def test_token_jaccard_of_whole_texts(spark, small, tmp_path):
    rows = [("a", "The cat, the hat", 1, 10, None), ("b", "the hat sat", 1, 11, 10), ("c", None, 1, 12, 11), ("d", "", 1, 13, 12), ("e", "Κόσμε x_1", 1, 14, 13), ("f", "κόσμε y", 1, 15, 14), ("g", "alone", 2, 16, 10)]
    spark.createDataFrame(rows, "doc_id string, text string, page_id long, rev_id long, parent_rev_id long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.parent_id): r.similarity for r in entry.queries()["token_jaccard"](spark, str(tmp_path)).collect()}
    assert got == {("b", "a"): 50.0, ("c", "b"): 0.0, ("d", "c"): 100.0, ("e", "d"): 0.0, ("f", "e"): pytest.approx(100 / 3, abs=1e-4)}

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "page_id", "rev_id", "parent_rev_id").collect()
    words = {d.doc_id: set(re.findall(r"[A-Za-z0-9_]+", d.text.lower())) for d in docs if d.text is not None and d.text.isascii()}
    pairs = {(a.doc_id, b.doc_id): (words.get(a.doc_id), words.get(b.doc_id)) for a in docs for b in docs if a.parent_rev_id is not None and (a.parent_rev_id, a.page_id) == (b.rev_id, b.page_id)}
    got = {(r.doc_id, r.parent_id): r.similarity for r in entry.queries()["token_jaccard"](spark, small).collect()}
    assert got.keys() == pairs.keys() and pairs
    for key, (x, y) in pairs.items():
        if x is not None and y is not None:
            assert got[key] == pytest.approx(len(x & y) * 100 / len(x | y) if x | y else 100.0, abs=1e-4)


def test_html_to_text_of_every_document(spark, small, tmp_path):
    texts = {"a": "<p>A&#65;&#x42;</p>", "b": None, "c": "&#8364;&#128512;&#x1F600; &#0; &#xD800; &#99999999;x", "d": "", "e": "&amp;#65; &lt;b&gt;"}
    spark.createDataFrame(list(texts.items()), "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.plain for r in entry.queries()["html_to_text"](spark, str(tmp_path)).collect()}
    assert got == {"a": "AAB\n\n", "b": None, "c": "€😀😀 &#0; &#xD800; &#99999999;x", "d": "", "e": "&#65; <b>"}
    assert entry.queries()["html_to_text"](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_roman_numerals_of_every_size(spark, tmp_path):
    def brute(n):
        out = ""
        for value, letters in [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]:
            out, n = out + letters * (n // value), n % value
        return out

    sizes = [*range(1, 51), 99, 444, 3999]
    spark.createDataFrame([(n,) for n in [*sizes, 7, 40]], "p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(tuple(r) for r in entry.queries()["roman_numerals"](spark, str(tmp_path)).collect())
    assert got == [(n, brute(n)) for n in sizes]


def test_addresses_of_every_column(spark, tmp_path):
    places = [(k, r, c) for k, (r, c) in enumerate([(0, 0), (8, 25), (9, 26), (0, 51), (0, 52), (0, 701), (0, 702), (0, 727), (0, 728), (99, 16383), (0, 18277)])]
    spark.createDataFrame(places, "cell_id long, row_no int, col_no int").write.parquet(str(tmp_path / "cells.parquet"))
    got = {r.cell_id: r.address for r in entry.queries()["a1_codec"](spark, str(tmp_path)).collect()}
    assert got == {k: address(r, c) for k, r, c in places}
