import io
import struct
import zipfile
import zlib

import pytest

from quillgrid.functions import numbers
from quillgrid.operators import changes, charts, recalc, sessionlog
from quillgrid.operators.formula import Evaluator, Value
from quillgrid.session import InvalidInput, ParseError
from quillgrid.sources import delimited, legacy, markup, packages, pdf, sinks


def test_csv_tokenizer():
    assert delimited.tokenize('a,b\r\n"x, ""y""",2\n\nq"r,s"t\n') == [["a", "b"], ['x, "y"', "2"], [""], ["qr,st"]]
    assert delimited.tokenize("") == [] and delimited.tokenize("a,") == [["a", ""]]
    with pytest.raises(ParseError):
        delimited.tokenize('a,"b')


def test_csv_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Name,,Age,Active,Score\nAlice,x,30,true,1.5\n"Bob, B",,22,FALSE,2\n,,, ,inf\n')
    for exact in (False, True):
        df = delimited.read_table(spark, str(tmp_path / "p.csv"), exact)
        assert dict(df.dtypes) == {"Name": "string", "column_2": "string", "Age": "bigint", "Active": "boolean", "Score": "double"}
        assert [tuple(r) for r in df.orderBy("Score").collect()] == [("Alice", "x", 30, True, 1.5), ("Bob, B", None, 22, False, 2.0), (None, None, None, None, float("inf"))]
    (tmp_path / "r.csv").write_text("a,b\n1\n2,3,4\n")
    assert [tuple(r) for r in delimited.read_table(spark, str(tmp_path / "r.csv"), True).orderBy("a").collect()] == [(1, None), (2, 3)]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(InvalidInput):
        delimited.read_fields(spark, str(tmp_path / "e.csv"), True)


def test_cells_of_csv(spark):
    from pyspark.sql import functions as F

    fields = spark.createDataFrame([(0, "Name", " N "), (1, "=A1&\"x\"", "1e3"), (2, "TRUE", ""), (3, None, "t")], "rn int, a string, b string")
    got = sorted((r.row_no, r.col_no, r.kind, r.value, r.num, r.flag) for r in delimited.to_cells(fields, "rn", F.lit("d"), F.lit("S"), True).collect())
    assert got == [(0, 0, "text", "Name", None, None), (0, 1, "text", " N ", None, None), (1, 0, "formula", 'A1&"x"', None, None), (1, 1, "number", None, 1000.0, None), (2, 0, "bool", None, None, True), (3, 1, "text", "t", None, None)]


CELLS = [(0, 0, "text", "a & <b>", None, None), (0, 1, "number", None, 1.5, None), (1, 0, "bool", None, None, True), (1, 2, "formula", "SUM(B1:B1)*2", 3.0, None)]


def test_workbooks_round_trip():
    for data, read in ((sinks.xlsx_bytes({"One": CELLS, "T'w": CELLS[:1]}), packages.xlsx_cells), (sinks.ods_bytes({"One": CELLS, "T'w": CELLS[:1]}, True), packages.ods_cells)):
        got = list(read(data))
        assert [g[2:] for g in got if g[1] == "One"] == CELLS
        assert [(g[0], g[1]) for g in got if g[1] != "One"] == [(1, "T'w")]
    assert packages.sniff(sinks.xlsx_bytes({"S": CELLS})) == "xlsx" and packages.sniff(sinks.ods_bytes({"S": CELLS})) == "ods"


def test_xlsx_details():
    sheet = '<worksheet><sheetData><row><c><v>1</v></c><c t="s"><v>0</v></c><c t="e"><v>#N/A</v></c></row><row r="5"><c r="A5"><f t="shared" si="0" ref="A5:A6">B5*2</f><v>0</v></c></row><row r="6"><c r="A6"><f t="shared" si="0"/></c></row></sheetData></worksheet>'
    data = sinks.pack([("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Gone" r:id="r1"/><sheet name="S" r:id="r2"/></sheets></workbook>'), ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/gone.xml"/><Relationship Id="r2" Target="/xl/worksheets/s.xml"/></Relationships>'), ("xl/worksheets/s.xml", sheet), ("xl/sharedStrings.xml", "<sst><si><r><t>sha</t></r><r><t>red</t></r></si></sst>")])
    got = [g[:6] for g in packages.xlsx_cells(data)]
    assert got == [(1, "S", 0, 0, "number", None), (1, "S", 0, 1, "text", "shared"), (1, "S", 0, 2, "error", "#N/A"), (1, "S", 4, 0, "formula", "B5*2"), (1, "S", 5, 0, "formula", "B6*2")]


def test_databases():
    data = sinks.odb_bytes({"People": (["name", "age"], [["Al, ice", 30], [None, "x"]])})
    assert packages.odb_tables(data) == [("People", ["name", "age"], [["Al, ice", "30"], ["", "x"]])]
    assert packages.sniff(data) == "odb"
    inline = sinks.pack([("content.xml", '<o><table name="t"><row><cell name="a">1</cell></row><row><cell name="b">2</cell></row></table></o>')])
    assert packages.odb_tables(inline) == [("t", ["a", "b"], [["1", None], [None, "2"]])]
    assert packages.odb_tables(sinks.pack([("database/x.csv", "h\n1")])) == [("x", ["h"], [["1"]])]


BLOCKS = [("heading", 2, None, "Title"), ("paragraph", None, None, "some & text"), ("table", None, None, "a\tb")]


def test_text_documents():
    for data, kind in ((sinks.docx_bytes(BLOCKS), "docx"), (sinks.odt_bytes(BLOCKS), "odt")):
        assert packages.sniff(data) == kind
        assert list(packages.blocks_of(data, kind)) == BLOCKS
    assert [b[0] for b in packages.blocks_of(b"# T\n\nA **b** word.\n\n- one\n- two\n", "md")] == ["heading", "paragraph", "list"]
    assert [b[3] for b in packages.blocks_of(b"<h1>hi</h1><p>one<br/>two</p>", "html")] == ["hi", "one\ntwo"]


def test_markdown():
    blocks = markup.markdown_blocks("# A *b*\n\ntext `c`\nmore [l](u)\n\n1. x\n2. y\n\n|a|b|\n|---|---|\n|1|2|\n\n---\n")
    assert [b["kind"] for b in blocks] == ["heading", "paragraph", "list", "table", "rule"]
    assert markup.plain(blocks[2]) == "1. x\n2. y" and blocks[3]["rows"] == [["a", "b"], ["1", "2"]]
    assert [s["kind"] for s in blocks[1]["spans"]] == ["text", "code", "text", "link"]
    again = markup.markdown_blocks(markup.to_markdown(blocks))
    assert again == blocks
    assert "<ol><li>x</li><li>y</li></ol>" in markup.to_html(blocks) and '<a href="u">l</a>' in markup.to_html(blocks)
    assert markup.inline_spans("a * b ** c") == [{"kind": "text", "text": "a * b ** c", "url": None}] or markup.inline_spans("") == []
    assert markup.outline_slides("# One\n- a\ntext\n# Two") == [(1, "title", "One"), (1, "bullet", "a"), (1, "text_box", "text"), (2, "title", "Two")]


def test_xml_and_math():
    tree = markup.lenient_xml('<?xml?><!-- c --><a x="1&amp;2"><b>t<w:c>u</b><![CDATA[<raw>]]>')
    assert tree.tag == "a" and tree.attrib == {"x": "1&2"} and "".join(tree.itertext()) == "tu<raw>"
    assert markup.decode_entities("&amp;&lt;&#65;&#x42;&copy;") == "&<AB&copy;"
    assert markup.mathml(markup.parse_latex(r"\frac{a+b}{c}")) == "<mfrac><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><mi>c</mi></mfrac>"
    assert markup.flat_math(markup.parse_latex("x^2 + y_1")) == "x^2+y_1" and markup.mathml(markup.parse_latex(r"\sqrt{\alpha}")) == "<msqrt><mi>α</mi></msqrt>"


def test_header_row_of_a_long_file():
    assert delimited.header_row('a,"b\nc",\r\n1,2,3\n"open') == ["a", "b\nc", ""] and delimited.header_row("") == [] and delimited.header_row("\nx") == [""] and delimited.header_row("x") == ["x"]
    assert delimited.header_row("k,v\n" + "1,2\n" * 1_000_000) == ["k", "v"]


def test_shapes():
    svg = b'<svg xmlns="http://www.w3.org/2000/svg"><rect x="10mm" y="0" width="5mm" height="1cm"/><circle cx="10mm" cy="10mm" r="2mm"/><text x="0" y="0">hi</text></svg>'
    got = list(packages.svg_elements(svg))
    assert got[0][1:6] == ("rectangle", 10.0, 0.0, 5.0, 10.0) and got[1][1:6] == ("ellipse", 8.0, 8.0, 4.0, 4.0) and got[2][-1] == "hi"
    assert packages.millimetres("1in") == 25.4 and packages.millimetres("x") is None
    assert packages.normalize_path("a/./b/../c") == "a/c" and packages.resolve_target("xl/workbook.xml", "../p.xml") == "p.xml" and packages.rels_path("a/b.xml") == "a/_rels/b.xml.rels"


def _pdf(content: bytes, filters: bytes = b"", font: bytes = b"") -> bytes:
    return b"%PDF-1.4\n1 0 obj<</Type/Pages/Kids[2 0 R]/Count 1>>endobj\n2 0 obj<</Type/Page/Parent 1 0 R/Contents 3 0 R/Resources<</Font<</F1 4 0 R>>>>>>endobj\n3 0 obj<<" + filters + b"/Length 1>>stream\n" + content + b"\nendstream endobj\n4 0 obj<</Type/Font" + font + b">>endobj\n5 0 obj<<>>stream\nbeginbfchar <0041> <03B1> endbfchar\nendstream endobj\n"


def test_pdf():
    text = b"BT /F1 12 Tf 10 700 Td (Hello \\(x\\)) Tj 0 -20 Td [(Wo) 10 (rld)] TJ ET"
    assert pdf.pages(_pdf(text)) == [["Hello (x)", "World"]]
    assert pdf.pages(_pdf(zlib.compress(text), b"/Filter/FlateDecode")) == [["Hello (x)", "World"]]
    assert pdf.pages(_pdf(b"BT /F1 9 Tf <0041> Tj ET", font=b"/ToUnicode 5 0 R")) == [["α"]]
    assert pdf.decode_stream(b"/Filter/ASCIIHexDecode", b"48 69>") == b"Hi" and pdf._run_length(b"\x01ab\xffc\x80") == b"abcc"
    with pytest.raises(ParseError):
        pdf.spans(b"nothing")


def test_legacy():
    assert legacy.clean_text("a\rb\x07\x13 HYPERLINK x\x14shown\x15\r\r\rc") == "a\n\nb\tshown\n\nc"
    with pytest.raises(ParseError):
        legacy.Compound(b"no")
    assert packages.sniff(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "WordDocument".encode("utf-16-le")) == "doc"
    assert struct.calcsize("<I") == 4


def test_readers_report_errors(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sinks.xlsx_bytes({"S": CELLS}))
    (tmp_path / "b.xlsx").write_bytes(b"PK\x03\x04broken")
    files = packages.read_files(spark, str(tmp_path))
    rows = packages.read_cells(files).collect()
    assert len([r for r in rows if r.error is None]) == len(CELLS) and len([r for r in rows if r.error]) == 1
    assert {r.format for r in packages.sniffed(files).collect()} == {"xlsx", None}
    assert packages.read_members(files).where("error is null").count() == 5
    (tmp_path / "c.md").write_text("# T\n\npara\n")
    blocks = packages.read_blocks(packages.read_files(spark, str(tmp_path / "c.md"))).orderBy("block_no").collect()
    assert [(b.kind, b.text) for b in blocks] == [("heading", "T"), ("paragraph", "para")]


def test_tracked_changes():
    body = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>keep</w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:rPrChange/></w:p><w:tbl><w:tr><w:trPr><w:del/></w:trPr><w:tc/></w:tr></w:tbl><w:commentReference w:id="1"/></w:body></w:document>'
    comments = '<w:comments xmlns:w="w"><w:comment w:id="1"/><w:comment w:id="2"/><w:comment/></w:comments>'
    out = changes.accept_package(sinks.pack([("word/document.xml", body), ("word/comments.xml", comments), ("x.bin", b"\x00")]))
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        text = z.read("word/document.xml").decode()
        assert "new" in text and "keep" in text and "old" not in text and "Change" not in text and "trPr" not in text
        assert z.read("word/comments.xml").decode().count("comment ") == 2 and z.read("x.bin") == b"\x00"


def test_recalc(spark):
    rows = [("d", "Main", 0, 0, "formula", "Data!A1+1", None, None), ("d", "Data", 0, 0, "number", None, 41.0, None), ("d", "Main", 1, 0, "formula", "1/0", None, None), ("d", "Main", 2, 0, "formula", "SUM(A:A)", None, None), ("d", "Main", 3, 1, "formula", "B5", None, None), ("d", "Main", 4, 1, "formula", "B4", None, None), ("e", "Main", 0, 0, "formula", "", None, None)]
    rows += [("f", "S", r, 0, "formula", f"A{r}+1", None, None) for r in range(1, 12)] + [("f", "S", 0, 0, "number", None, 1.0, None)]
    cells = spark.createDataFrame(rows, "doc_key string, sheet string, row_no int, col_no int, kind string, value string, num double, flag boolean")
    got = {tuple(r)[:4]: r.num if r.kind == "number" else r.error for r in recalc.evaluate(cells).collect()}
    assert got["d", "Main", 0, 0] == 42.0 and got["d", "Main", 1, 0] == "#DIV/0!" and got["d", "Main", 2, 0] == "#CYCLE!" and got["d", "Main", 3, 1] == "#CYCLE!" and got["e", "Main", 0, 0] == "#VALUE!"
    assert got["f", "S", 11, 0] == 12.0 and len(got) == 17
    assert recalc.evaluate(cells.limit(0)).count() == 0
    report = {r.error: r.n for r in recalc.errors(recalc.evaluate(cells)).collect()}
    assert report == {"#DIV/0!": 1, "#CYCLE!": 3, "#VALUE!": 1}


def test_recalc_equals_one_evaluator(spark, small):
    cells = recalc.latest(spark.read.parquet(f"{small}/cells.parquet"))
    docs: dict = {}
    for x in cells.collect():
        docs.setdefault(x.doc_key, {})[x.sheet, x.row_no, x.col_no] = ("formula", x.value or "") if x.kind == "formula" else recalc._value(x.kind, x.value, x.num, x.flag)
    want = {(d, *a): Evaluator(cs).cell(*a) for d, cs in docs.items() for a, v in cs.items() if not isinstance(v, Value)}
    got = {tuple(r)[:4]: Value(r.kind, {"number": r.num, "text": r.text, "bool": r.flag, "error": r.error}.get(r.kind)) for r in recalc.evaluate(cells).collect()}
    assert got == want


def test_grids(spark):
    rows = [("d", "S", 0, 0, "text", "a b", None, None), ("d", "S", 1, 1, "number", None, 2.0, None), ("d", "S", 3, 0, "formula", "A1", None, None), ("d", "S", 3, 1, "bool", None, None, False)]
    cells = spark.createDataFrame(rows, "doc_key string, sheet string, row_no int, col_no int, kind string, value string, num double, flag boolean")
    assert [r.line for r in sinks.csv_lines(cells).orderBy("row_no").collect()] == ["a b,", ",2", ",", "=A1,false"]
    assert sinks.markdown_lines(cells).orderBy("row_no").first().line == "| a b |  |\n| --- | --- |"
    assert sinks.html_lines(cells).orderBy("row_no").first().line == "<tr><td>a b</td><td></td></tr>"
    assert sinks.csv_lines(cells.limit(0)).count() == 0
    odd = spark.createDataFrame([("d", "E", 4, 4, "empty", None, None, None), ("d", "S", 0, 0, "error", "#REF!", None, None), ("d", "S", 0, 1, "text", "a|b\nc", None, None)], cells.schema)
    assert {(r.sheet, r.line) for r in sinks.markdown_lines(odd).collect()} == {("E", "(empty sheet)"), ("S", "| #REF! | a\\|b\nc |\n| --- | --- |")}
    assert {(r.sheet, r.line) for r in sinks.csv_lines(odd).collect()} == {("E", ""), ("S", '#ERR #REF!,"a|b\nc"')}


def test_axes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 3.0), ("a", 47.0), ("b", -2.0), ("c", 0.0), ("d", None)], "k string, v double")
    got = {r.k: (r.low, r.high, r.ticks) for r in charts.axes(df, ["k"], "v").collect()}
    assert got["a"] == (0.0, 47.0, ["0", "10", "20", "30", "40", "50", "60"]) and got["b"][:2] == (-2.0, -1.0) or got["b"][0] == -2.0
    assert got["c"][:2] == (0.0, 1.0) and got["d"] == (None, None, None)
    ticks = spark.createDataFrame([(0.25,), (3.0,), (-1.5,), (1 / 3,)], "x double").select(numbers.format_tick(F.col("x"))).collect()
    assert [t[0] for t in ticks] == ["0.25", "3", "-1.5", "0.3333"]
    assert spark.range(1).select(charts.mode(F.array(F.lit("bar"), F.lit("pie")))).first()[0] == "pie"


def test_sessions(spark, tmp_path):
    from pyspark.sql import functions as F

    saved = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 9)], "path string, ts int")
    assert [r.path for r in sessionlog.recents(saved).collect()] == ["a", "b"]
    assert [r[0] for r in spark.createDataFrame([(".uno:SetCell",), ("Bold",), (None,)], "c string").select(sessionlog.mutating(F.col("c"))).collect()] == [True, False, False]
    lines = spark.createDataFrame([("1\tk\tt\tp\ta\ts",), ("bad",)], "value string")
    assert sessionlog.manifest(lines).count() == 1
    services = sessionlog.Services(spark)
    heard = []
    key = services.subscribe("upper", lambda s, t: heard.append((s, t)))
    services.register("text", lambda m, x: {"upper": str.upper, "lower": str.lower}[m](x))
    assert services.invoke("text", "upper", "a") == "A" and services.invoke("text", "lower", "A") == "a"
    assert heard == [("text", "upper")] and services.unsubscribe(key) and services.event_log().count() == 2
    with pytest.raises(InvalidInput):
        services.invoke("none", "x")


def test_event_stream(spark, small, tmp_path):
    from quillgrid.streaming import events

    table = spark.read.parquet(f"{small}/events.parquet")
    folder = tmp_path / "in"
    table.repartition(3).write.parquet(str(folder))
    stream = events.windowed_counts(events.read_events(spark, str(folder), table.schema), late="3650 days")
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.start, r.event_type, r.events) for r in spark.table("counted").collect())
    want = sorted((r.start, r.event_type, r.events) for r in events.windowed_counts(table).collect())
    assert got == want
    counts = {}
    bus = events.bus(events.read_events(spark, str(folder), table.schema), {t: (lambda df, t=t: counts.__setitem__(t, counts.get(t, 0) + df.count())) for t in ("click", "view")}, str(tmp_path / "b"))
    bus.processAllAvailable()
    bus.stop()
    assert counts == {t: table.where(F_col("event_type") == t).count() for t in ("click", "view")}


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
