import pytest

from quillgrid.operators import edits, pdf_lines
from quillgrid.session import InvalidInput


def test_lines(spark):
    rows = [("d", 1, 100.0, 50.0, 1, 10.0, "World", "z"), ("d", 1, 100.5, 10.0, 2, 10.0, "Hello", "z"), ("d", 1, 80.0, 10.0, 3, 10.0, "next", "z"), ("d", 1, 98.5, 90.0, 4, 10.0, "!", None), ("d", 2, 80.0, 1.0, 5, None, "page", None), (None, None, 1.0, 1.0, 6, 1.0, "x", None), ("d", 1, None, 1.0, 7, 1.0, "gone", None), ("d", 1, 60.0, 1.0, 8, 1.0, "", None), ("d", 1, 60.0, 1.0, 9, 1.0, None, None)]
    df = spark.createDataFrame(rows, "doc_key string, page_no int, y double, x double, span_id long, font_size double, text string, line string")
    got = sorted((str(r.doc_key), r.page_no or 0, r.line, r.text) for r in pdf_lines.reconstruct(df).collect())
    assert got == [("None", 0, 1, "x"), ("d", 1, 1, "Hello World !"), ("d", 1, 2, "next"), ("d", 2, 1, "page")]
    assert pdf_lines.reconstruct(df.limit(0)).collect() == []


def test_real_pages(spark, small):
    spans = spark.read.parquet(f"{small}/pdf_spans.parquet")
    got = pdf_lines.reconstruct(spans).agg({"spans": "sum"}).first()[0]
    assert got == spans.where("text <> ''").count()


def test_edits(spark):
    base = spark.createDataFrame([("d", "S", 0, 0, "number", None, 2.0, None), ("d", "S", 0, 1, "formula", "A1*21", None, None), ("e", "S", 0, 0, "text", "t", None, None)], edits._SCHEMA)
    books = edits.Workbooks(base)
    assert books.evaluate_cell("d", "S", "B1") == 42.0 and books.evaluate_cell("e", "S", "A1") == "t"
    books.set_cell("d", "S", "A1", " 3 ")
    books.set_cell("d", "S", "C1", "=TRUE")
    assert books.evaluate_cell("d", "S", "B1") == 63.0 and books.evaluate_cell("d", "S", "C1") is True
    assert books.append_row("d", "S", ["x", "=1", "7"]) == 1
    assert books.evaluate_cell("d", "S", "B2") == "=1" and books.evaluate_cell("d", "S", "C2") == 7.0
    books.set_cell("d", "S", "A1", "")
    assert books.cells().where("doc_key = 'd' and row_no = 0 and col_no = 0").count() == 0
    with pytest.raises(InvalidInput):
        books.evaluate_cell("d", "S", "Z9")
