"""Queries over small documents made here: every reader and writer of packages, with the rows expected."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from quillgrid.operators import changes, charts, rewrite
from quillgrid.operators.formula import shift
from quillgrid.plans import convert
from quillgrid.sources import delimited, markup, packages, pdf, sinks

QUERIES = {}
ORACLE: dict[str, str] = {}

_CELLS = [(0, 0, "text", "Item", None, None), (0, 1, "text", "Qty", None, None), (1, 0, "text", "Pen & ink", None, None), (1, 1, "number", None, 2.0, None), (2, 0, "bool", None, None, True), (2, 1, "formula", "B2*21", 42.0, None)]
_ODD = [(0, 0, "text", "a b", None, None), (0, 1, "bool", None, None, True), (0, 2, "error", "#DIV/0!", None, None), (0, 3, "text", "x, y", None, None), (0, 4, "text", 'say "hi"', None, None), (0, 5, "text", "two\nlines", None, None)]
_BLOCKS = [("heading", 1, None, "Title"), ("paragraph", None, None, "One & two"), ("list", None, False, "item"), ("table", None, None, "a\tb")]
_SVG = b'<svg xmlns="http://www.w3.org/2000/svg"><rect x="1mm" y="2mm" width="3mm" height="4mm"/><ellipse cx="10mm" cy="10mm" rx="2mm" ry="1mm"/><line x1="0mm" y1="0mm" x2="5mm" y2="6mm"/></svg>'


def _files(spark, files: dict[str, bytes]):
    return spark.createDataFrame([(path, bytearray(data)) for path, data in files.items()], "path string, content binary")


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _add(name: str, columns: str, rows: list[tuple]):
    """A query and the rows it must give, as SQL values."""
    values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)

    def register(f):
        QUERIES[name] = f
        ORACLE[name] = f"SELECT * FROM (VALUES {values}) t({columns})"
        return f

    return register


@_add("xlsx_cells", "sheet, row_no, col_no, kind, value, num, flag", [("One", *c) for c in _CELLS])
def xlsx_cells(spark, root):
    return packages.read_cells(_files(spark, {"a.xlsx": sinks.xlsx_bytes({"One": _CELLS})})).select("sheet", "row_no", "col_no", "kind", "value", "num", "flag")


@_add("ods_cells", "sheet, row_no, col_no, kind, value, num, flag", [("One", *c) for c in _CELLS])
def ods_cells(spark, root):
    return packages.read_cells(_files(spark, {"a.ods": sinks.ods_bytes({"One": _CELLS}, header=True)})).select("sheet", "row_no", "col_no", "kind", "value", "num", "flag")


@_add("docx_blocks", "block_no, kind, level, text", [(0, "heading", 1, "Title"), (1, "paragraph", None, "One & two"), (2, "paragraph", None, "• item"), (3, "table", None, "a\tb")])
def docx_blocks(spark, root):
    return packages.read_blocks(_files(spark, {"a.docx": sinks.docx_bytes(_BLOCKS)})).select("block_no", "kind", "level", "text")


@_add("odt_blocks", "block_no, kind, level, text", [(k, b[0], b[1], b[3]) for k, b in enumerate(_BLOCKS)])
def odt_blocks(spark, root):
    return packages.read_blocks(_files(spark, {"a.odt": sinks.odt_bytes(_BLOCKS)})).select("block_no", "kind", "level", "text")


@_add("markdown_blocks", "block_no, kind, level, text", [(0, "heading", 1, "T"), (1, "paragraph", None, "A bold word."), (2, "list", None, "- one\n- two"), (3, "table", None, "a\tb\n1\t2")])
def markdown_blocks(spark, root):
    return packages.read_blocks(_files(spark, {"a.md": b"# T\n\nA **bold** word.\n\n- one\n- two\n\n|a|b|\n|---|---|\n|1|2|\n"})).select("block_no", "kind", "level", "text")


@_add("html_blocks", "block_no, text", [(0, "hi"), (1, "one\ntwo & more")])
def html_blocks(spark, root):
    return packages.read_blocks(_files(spark, {"a.html": b"<html><h1>hi</h1><p>one<br/>two &amp; more</p>"})).select("block_no", "text")


@_add("pdf_blocks", "block_no, text", [(0, "First (line)"), (1, "Second")])
def pdf_blocks(spark, root):
    return packages.read_blocks(_files(spark, {"a.pdf": convert.pdf_bytes(["First (line)", "Second"])})).select("block_no", "text")


@_add("text_outline_slides", "slide_no, kind, text", [(1, "title", "One"), (1, "bullet", "a"), (1, "text_box", "plain"), (2, "title", "Two")])
def text_outline_slides(spark, root):
    return packages.read_slides(_files(spark, {"a.txt": b"# One\n- a\nplain\n# Two"})).select("slide_no", "kind", "text")


@_add("svg_shapes", "kind, x_mm, y_mm, width_mm, height_mm", [("rectangle", 1.0, 2.0, 3.0, 4.0), ("ellipse", 8.0, 9.0, 4.0, 2.0), ("line", 0.0, 0.0, 5.0, 6.0)])
def svg_shapes(spark, root):
    return packages.read_shapes(_files(spark, {"a.svg": _SVG})).select("kind", "x_mm", "y_mm", "width_mm", "height_mm")


@_add("odb_scan", "name, age", [("Alice", 30), ("Bob, B", 22), (None, 41)])
def odb_scan(spark, root):
    name, columns, rows = packages.odb_tables(sinks.odb_bytes({"People": (["name", "age"], [["Alice", 30], ["Bob, B", 22], [None, 41]])}))[0]
    return delimited.typed(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)))


@_add("zip_list", "name, size", [("mimetype", 46), ("a/b.txt", 5)])
def zip_list(spark, root):
    data = sinks.pack([("mimetype", "application/vnd.oasis.opendocument.spreadsheet"), ("a/b.txt", "hello")])
    return packages.read_members(_files(spark, {"a.zip": data})).select("name", "size")


@_add("sniff_bytes", "path, format, family", [("a", "xlsx", "spreadsheet"), ("b", "odt", "text"), ("c", "pdf", "text"), ("d", "svg", "drawing"), ("e", "csv", "spreadsheet"), ("f", "md", "text"), ("g", "txt", "text"), ("h", None, None), ("i", "odb", "database"), ("j", "doc", "text")])
def sniff_bytes(spark, root):
    files = {"a": sinks.xlsx_bytes({"S": []}), "b": sinks.odt_bytes([]), "c": b"%PDF-1.4", "d": _SVG, "e": b"a,b\n1,2", "f": b"# T", "g": b"plain", "h": b"\xff\x00", "i": sinks.odb_bytes({}), "j": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "WordDocument".encode("utf-16-le")}
    return packages.sniffed(_files(spark, files))


@_add("tracked_changes", "path, kept, dropped", [("a.docx", True, False)])
def tracked_changes(spark, root):
    body = '<w:document xmlns:w="w"><w:body><w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p></w:body></w:document>'
    accepted = changes.accept_all(_files(spark, {"a.docx": sinks.pack([("word/document.xml", body)])}))

    def text(batches):
        for batch in batches:
            parts = []
            for data in batch.column(1).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    parts.append(z.read("word/document.xml").decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.string())], names=["path", "text"])

    texts = accepted.select("path", "content").mapInArrow(text, "path string, text string")
    return texts.select("path", F.col("text").contains("new").alias("kept"), F.col("text").contains("old").alias("dropped"))


@_add("shared_formula_shift", "formula, moved", [("SUM(Sheet2!A:A)+Sheet2!B1", "SUM(Sheet2!C:C)+Sheet2!D5"), ("$A$1+A$1+$A1", "$A$1+C$1+$A5"), ('"A1"&B2', '"A1"&D6')])
def shared_formula_shift(spark, root):
    formulas = spark.createDataFrame([("SUM(Sheet2!A:A)+Sheet2!B1",), ("$A$1+A$1+$A1",), ('"A1"&B2',)], "formula string")
    return formulas.select("formula", F.pandas_udf(lambda f: f.map(lambda x: shift(x, 4, 2)), "string")("formula").alias("moved"))


@_add("latex_flatten", "latex, flat, mathml", [(r"\frac{a+b}{c}", "(a+b)/(c)", "<mfrac><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><mi>c</mi></mfrac>"), ("x^2+y_1", "x^2+y_1", "<mrow><msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><msub><mi>y</mi><mn>1</mn></msub></mrow>")])
def latex_flatten(spark, root):
    df = spark.createDataFrame([(r"\frac{a+b}{c}",), ("x^2+y_1",)], "latex string")
    return df.select("latex", F.pandas_udf(lambda s: s.map(lambda t: markup.flat_math(markup.parse_latex(t))), "string")("latex").alias("flat"), F.pandas_udf(lambda s: s.map(lambda t: markup.mathml(markup.parse_latex(t))), "string")("latex").alias("mathml"))


# Every route, written out.
_ROUTES = """
md txt html docx odt pdf doc : text : txt md html docx odt pdf svg
csv xlsx ods : spreadsheet : csv md html xlsx ods svg pdf
pptx odp : presentation : txt md html pptx odp svg pdf
odg svg : drawing : svg txt odg pdf
latex mathml odf : formula : mathml txt odf svg pdf
odb : database : csv html odb svg pdf
"""


@_add("conversion_routes", "source, family, target", [(source, family.strip(), to) for line in _ROUTES.split("\n") if line for sources, family, targets in [line.split(":")] for source in sources.split() for to in targets.split()])
def conversion_routes(spark, root):
    return convert.route_table(spark)


@_add("convert_batch", "path, content", [("a.xlsx", "Item,Qty\nPen & ink,2\ntrue,=B2*21"), ("b.ods", "Item,Qty\nPen & ink,2\ntrue,=B2*21"), ("c.xlsx", "a b,true,#ERR #DIV/0!,\"x, y\",\"say \"\"hi\"\"\",\"two\nlines\"")])
def convert_batch(spark, root):
    done = convert.convert_files(_files(spark, {"a.xlsx": sinks.xlsx_bytes({"S": _CELLS}), "b.ods": sinks.ods_bytes({"S": _CELLS}), "c.xlsx": sinks.xlsx_bytes({"S": _ODD})}), "csv")
    return done.select("path", F.decode("content", "UTF-8").alias("content"))


@_add("recalculated_workbook", "address, num", [("B3", 42.0)])
def recalculated_workbook(spark, root):
    """A workbook with a stale value is read, recalculated, written and read again."""
    stale = [c if c[2] != "formula" else (*c[:4], 0.0, None) for c in _CELLS]
    fresh = convert.convert_files(_files(spark, {"a.xlsx": sinks.xlsx_bytes({"S": stale})}), "xlsx").select("path", "content")
    from quillgrid.functions.texts import a1

    return packages.read_cells(fresh).where(F.col("kind") == "formula").select(a1(F.col("row_no"), F.col("col_no")).alias("address"), "num")


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
#: A workbook as another program writes it: shared strings, styles, names, widths, stale values, a calculation chain.
_FOREIGN = [
    ("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/calcChain.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.calcChain+xml"/></Types>'),
    ("xl/workbook.xml", f'<workbook {_MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Main" sheetId="1" r:id="rId1"/><sheet name="Gone" sheetId="2" r:id="rId9"/><sheet name="Data" sheetId="3" r:id="rId2"/></sheets><definedNames><definedName name="x">Main!$A$1</definedName></definedNames><calcPr calcId="1" calcMode="manual" fullCalcOnLoad="1"/></workbook>'),
    ("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t/worksheet" Target="worksheets/one.xml"/><Relationship Id="rId2" Type="t/worksheet" Target="/xl/worksheets/two.xml"/><Relationship Id="rId3" Type="t/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="rId4" Type="t/calcChain" Target="calcChain.xml"/></Relationships>'),
    ("xl/sharedStrings.xml", f'<sst {_MAIN}><si><t>Pen</t></si><si><r><t>In</t></r><r><t>k &amp; co</t></r></si></sst>'),
    ("xl/styles.xml", f"<styleSheet {_MAIN}><fonts/></styleSheet>"),
    ("xl/calcChain.xml", f'<calcChain {_MAIN}><c r="C1"/></calcChain>'),
    ("xl/worksheets/one.xml", f'<worksheet {_MAIN}><cols><col min="1" max="1" width="20"/></cols><sheetData><row r="1"><c r="A1" s="2"><v>40</v></c><c r="B1"><v>2</v></c><c r="C1" s="3"><f>A1+B1</f><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="str"><f>A2&amp;"-"&amp;B2</f><v>old</v></c></row><row r="3"><c r="A3"><f>1/0</f><v>1</v></c><c r="B3"><f>A1&gt;B1</f></c><c r="C3"><f t="shared" ref="C3:C4" si="0">A1*2</f><v>9</v></c></row><row r="4"><c r="C4"><f t="shared" si="0"/><v>9</v></c><c r="D4"><f>Data!A1+1</f><v/></c></row></sheetData></worksheet>'),
    ("xl/worksheets/two.xml", f'<worksheet {_MAIN}><sheetData><row><c><v>41</v></c><c t="inlineStr"><is><t>in line</t></is></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c></row></sheetData></worksheet>'),
]


@_add("foreign_workbook", "sheet_no, sheet, row_no, col_no, kind, value, num, flag", [
    (0, "Main", 0, 0, "number", None, 40.0, None), (0, "Main", 0, 1, "number", None, 2.0, None), (0, "Main", 0, 2, "formula", "A1+B1", 0.0, None), (0, "Main", 1, 0, "text", "Pen", None, None), (0, "Main", 1, 1, "text", "Ink & co", None, None), (0, "Main", 1, 2, "formula", 'A2&"-"&B2', None, None),
    (0, "Main", 2, 0, "formula", "1/0", 1.0, None), (0, "Main", 2, 1, "formula", "A1>B1", None, None), (0, "Main", 2, 2, "formula", "A1*2", 9.0, None), (0, "Main", 3, 2, "formula", "A2*2", 9.0, None), (0, "Main", 3, 3, "formula", "Data!A1+1", None, None),
    (2, "Data", 0, 0, "number", None, 41.0, None), (2, "Data", 0, 1, "text", "in line", None, None), (2, "Data", 0, 2, "bool", None, None, True), (2, "Data", 0, 3, "error", "#N/A", None, None),
])
def foreign_workbook(spark, root):
    """Shared strings, shared formulas, a missing sheet part and cells without addresses."""
    return packages.read_cells(_files(spark, {"a.xlsx": sinks.pack(_FOREIGN)})).select("sheet_no", "sheet", "row_no", "col_no", "kind", "value", "num", "flag")


@_add("rewritten_workbook", "address, type, value", [("C1", None, "42"), ("C2", "str", "Pen-Ink & co"), ("A3", "e", "#DIV/0!"), ("B3", "b", "1"), ("C3", None, "80"), ("C4", "e", "#VALUE!"), ("D4", None, "42")])
def rewritten_workbook(spark, root):
    """Cached values and their types after recalculation in place."""
    done = rewrite.rewrite_files(_files(spark, {"a.xlsx": sinks.pack(_FOREIGN)}))

    def cached(batches):
        for batch in batches:
            out = []
            for data in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for c in packages.descendants(packages.parse_xml(z.read("xl/worksheets/one.xml")), "c"):
                        if any(True for _ in packages.children(c, "f")):
                            out.append((c.get("r"), c.get("t"), next(iter(packages.children(c, "v"))).text))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], names=["address", "type", "value"])

    return done.select("content").mapInArrow(cached, "address string, type string, value string")


@_add("rewritten_parts", "name, kept", [("[Content_Types].xml", False), ("xl/workbook.xml", False), ("xl/_rels/workbook.xml.rels", False), ("xl/sharedStrings.xml", True), ("xl/styles.xml", True), ("xl/worksheets/one.xml", False), ("xl/worksheets/two.xml", True)])
def rewritten_parts(spark, root):
    """The members after recalculation, and which are as they were: no calculation chain, styles and other sheets untouched."""
    before = dict(_FOREIGN)
    done = rewrite.rewrite_files(_files(spark, {"a.xlsx": sinks.pack(_FOREIGN)}))

    def members(batches):
        for batch in batches:
            out = []
            for data in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    out += [(n, z.read(n).decode() == before.get(n)) for n in z.namelist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.bool_())], names=["name", "kept"])

    return done.select("content").mapInArrow(members, "name string, kept boolean")


_CHART = """<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:chart><c:plotArea>
<c:barChart><c:barDir val="col"/><c:ser><c:idx val="0"/><c:tx><c:strRef><c:strCache><c:pt idx="0"><c:v>Sales</c:v></c:pt></c:strCache></c:strRef></c:tx>
<c:cat><c:strRef><c:strCache><c:ptCount val="3"/><c:pt idx="1"><c:v>Q2</c:v></c:pt><c:pt idx="0"><c:v>Q1</c:v></c:pt></c:strCache></c:strRef></c:cat>
<c:val><c:numRef><c:numCache><c:pt idx="2"><c:v>7</c:v></c:pt><c:pt idx="0"><c:v>4.5</c:v></c:pt><c:pt idx="1"><c:v>n/a</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser></c:barChart>
<c:lineChart><c:ser><c:cat><c:numRef><c:numCache><c:formatCode>mmm yy</c:formatCode><c:pt idx="0"><c:v>45000</c:v></c:pt></c:numCache></c:numRef></c:cat>
<c:val><c:numRef><c:numCache><c:pt idx="0"><c:v>-1e2</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser></c:lineChart></c:plotArea></c:chart></c:chartSpace>"""
_PIE = '<chartSpace><plotArea><doughnutChart><ser><val><numLit><pt idx="0"><v>1</v></pt></numLit></val></ser></doughnutChart></plotArea></chartSpace>'
#: A presentation as another program writes it: slides out of order, a table, a picture, notes, charts.
_DECK = [
    ("ppt/presentation.xml", '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="b"/><p:sldId id="257" r:id="a"/></p:sldIdLst></p:presentation>'),
    ("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="a" Target="slides/slide1.xml"/><Relationship Id="b" Target="/ppt/slides/slide2.xml"/></Relationships>'),
    ("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:txBody><a:p><a:r><a:t>Last </a:t></a:r><a:r><a:t>slide</a:t></a:r></a:p><a:p/><a:p><a:r><a:t>x &lt; y</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'),
    ("ppt/slides/slide2.xml", '<p:sld xmlns:p="p" xmlns:a="a"><p:pic><p:nvPicPr><p:cNvPr id="4" descr="A chart"/></p:nvPicPr></p:pic><a:tbl><a:tr><a:tc><a:t>k</a:t></a:tc><a:tc><a:t>v</a:t></a:tc></a:tr></a:tbl></p:sld>'),
    ("ppt/slides/_rels/slide2.xml.rels", '<Relationships><Relationship Id="n" Target="../notesSlides/notesSlide1.xml"/></Relationships>'),
    ("ppt/notesSlides/notesSlide1.xml", '<p:notes xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Say it.</a:t></a:r></a:p></p:notes>'),
    ("ppt/charts/chart1.xml", _CHART),
    ("ppt/charts/chart2.xml", _PIE),
]


@_add("foreign_slides", "slide_no, kind, text", [(1, "image", "A chart"), (1, "table", "k | v"), (1, "notes", "Say it."), (2, "text_box", "Last slide\nx < y")])
def foreign_slides(spark, root):
    return packages.read_slides(_files(spark, {"a.pptx": sinks.pack(_DECK)})).select("slide_no", "kind", "text")


@_add("chart_cache", "chart, series_no, series, kind, dated, pt_idx, category, y", [("ppt/charts/chart1.xml", 0, "Sales", "column", False, 0, "Q1", 4.5), ("ppt/charts/chart1.xml", 0, "Sales", "column", False, 2, None, 7.0), ("ppt/charts/chart1.xml", 1, "", "line", True, 0, "45000", -100.0), ("ppt/charts/chart2.xml", 0, "", "doughnut", False, 0, None, 1.0)])
def chart_cache(spark, root):
    """Cached points of charts by index; what is no number is left out."""
    return packages.read_charts(_files(spark, {"a.pptx": sinks.pack(_DECK)})).select("chart", "series_no", "series", "kind", "dated", "pt_idx", "category", "y")


@_add("chart_types", "chart, type, mode", [("ppt/charts/chart1.xml", "combo", "column"), ("ppt/charts/chart2.xml", "doughnut", "doughnut")])
def chart_types(spark, root):
    return charts.types(packages.read_charts(_files(spark, {"a.pptx": sinks.pack(_DECK)})), ["chart"])


_ODF_NS = 'xmlns:office="o" xmlns:draw="d" xmlns:svg="s" xmlns:text="t" xmlns:table="b" xmlns:presentation="p"'


@_add("foreign_odp", "slide_no, kind, text", [(1, "text_box", "Hello\nyou"), (1, "image", ""), (1, "notes", "quiet"), (2, "rectangle", "in box")])
def foreign_odp(spark, root):
    body = f'<office:document-content {_ODF_NS}><draw:page><draw:frame><draw:text-box><text:p>Hello</text:p><text:p>you</text:p></draw:text-box></draw:frame><draw:frame><draw:image/></draw:frame><presentation:notes><text:p>quiet</text:p></presentation:notes></draw:page><draw:page><draw:rect><text:p>in box</text:p></draw:rect></draw:page></office:document-content>'
    return packages.read_slides(_files(spark, {"a.odp": sinks.pack([("mimetype", "application/vnd.oasis.opendocument.presentation"), ("content.xml", body)])})).select("slide_no", "kind", "text")


@_add("foreign_odg", "page_no, kind, x_mm, y_mm, width_mm, height_mm, text", [(1, "rectangle", 10.0, 20.0, 30.0, 40.0, "r"), (1, "line", 0.0, 0.0, 25.4, 10.0, ""), (2, "text_box", 5.0, 5.0, 50.0, 10.0, "label")])
def foreign_odg(spark, root):
    body = f'<office:document-content {_ODF_NS}><draw:page><draw:rect svg:x="1cm" svg:y="20mm" svg:width="3cm" svg:height="40mm"><text:p>r</text:p></draw:rect><draw:line svg:x1="0mm" svg:y1="0mm" svg:x2="1in" svg:y2="10mm"/></draw:page><draw:page><draw:frame svg:x="5mm" svg:y="5mm" svg:width="50mm" svg:height="1cm"><draw:text-box><text:p>label</text:p></draw:text-box></draw:frame></draw:page></office:document-content>'
    return packages.read_shapes(_files(spark, {"a.odg": sinks.pack([("mimetype", "application/vnd.oasis.opendocument.graphics"), ("content.xml", body)])})).select("page_no", "kind", "x_mm", "y_mm", "width_mm", "height_mm", "text")


@_add("foreign_ods", "row_no, col_no, kind, value, num, flag", [(0, 0, "text", "Head", None, None), (1, 0, "number", None, 1.5, None), (2, 0, "number", None, 1.5, None), (1, 1, "text", "x", None, None), (1, 2, "text", "x", None, None), (2, 1, "text", "x", None, None), (2, 2, "text", "x", None, None), (5, 3, "bool", None, None, True)])
def foreign_ods(spark, root):
    """Header rows, repeated rows and columns, gaps."""
    row = '<table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="1.5"/><table:table-cell table:number-columns-repeated="2" office:value-type="string"><text:p>x</text:p></table:table-cell></table:table-row>'
    body = f'<office:document-content {_ODF_NS}><table:table table:name="T"><table:table-header-rows><table:table-row><table:table-cell office:value-type="string"><text:p>Head</text:p></table:table-cell></table:table-row></table:table-header-rows>{row}<table:table-row table:number-rows-repeated="2"><table:table-cell/></table:table-row><table:table-row><table:table-cell table:number-columns-repeated="3"/><table:table-cell office:value-type="boolean" office:boolean-value="true"/></table:table-row></table:table></office:document-content>'
    return packages.read_cells(_files(spark, {"a.ods": sinks.pack([("mimetype", "application/vnd.oasis.opendocument.spreadsheet"), ("content.xml", body)])})).select("row_no", "col_no", "kind", "value", "num", "flag")


@_add("csv_cells", "row_no, col_no, kind, value, num, flag", [(0, 0, "text", "Name", None, None), (0, 1, "text", "Qty", None, None), (1, 0, "text", "a, b", None, None), (1, 1, "number", None, 2.5, None), (2, 0, "bool", None, None, True), (2, 1, "formula", "B2*2", None, None)])
def csv_cells(spark, root):
    return packages.read_cells(_files(spark, {"a.csv": b'Name,Qty\n"a, b", 2.5\nTRUE,=B2*2\n'})).select("row_no", "col_no", "kind", "value", "num", "flag")


@_add("database_rows", "path, table_name, row_no, name, age", [("a.csv", "data", 0, "Alice", "30"), ("a.csv", "data", 1, "Bob, B", None), ("b.odb", "People", 0, "Cara", "41")])
def database_rows(spark, root):
    """Rows of databases and CSV files alike."""
    files = {"a.csv": b'name,age\nAlice,30\n"Bob, B",\n', "b.odb": sinks.pack([("mimetype", "application/vnd.oasis.opendocument.base"), ("content.xml", '<c xmlns:db="d"><db:table-representation db:name="People"/></c>'), ("database/People.csv", "name,age\nCara,41\n")])}
    rows = packages.read_tables(_files(spark, files))
    return rows.select("path", "table_name", "row_no", F.col("fields")["name"].alias("name"), F.col("fields")["age"].alias("age"))


@_add("zip_entry", "path, text", [("a.zip", "hello")])
def zip_entry(spark, root):
    return packages.read_entry(_files(spark, {"a.zip": sinks.pack([("x", "no"), ("a/b.txt", "hello")])}), "a/b.txt").select("path", F.decode("content", "UTF-8").alias("text"))


@_add("formula_documents", "path, content", [("a.mml", "(a+b)/(c)"), ("b.odf", "x^2+y_1"), ("c.tex", "sqrt(2)")])
def formula_documents(spark, root):
    """MathML, formula packages and LaTeX as flat text."""
    mathml = b'<?xml version="1.0"?><math xmlns="http://www.w3.org/1998/Math/MathML"><semantics><mfrac><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><mi>c</mi></mfrac><annotation encoding="t">no</annotation></semantics></math>'
    odf = '<math:math xmlns:math="m"><math:mrow><math:msup><math:mi>x</math:mi><math:mn>2</math:mn></math:msup><math:mo>+</math:mo><math:msub><math:mi>y</math:mi><math:mn>1</math:mn></math:msub></math:mrow></math:math>'
    files = {"a.mml": mathml, "b.odf": sinks.pack([("mimetype", "application/vnd.oasis.opendocument.formula"), ("content.xml", odf)]), "c.tex": b"\\sqrt{2}"}
    return convert.convert_files(_files(spark, files), "txt").select("path", F.decode("content", "UTF-8").alias("content"))


@_add("converted_back", "source, target, text", [
    ("csv", "pdf", "Sheet1\na\tb\n1\t2"), ("csv", "svg", "a\nb\n1\n2"), ("pptx", "odp", "Last slide\nx < y"), ("pptx", "pptx", "Last slide\nx < y"), ("pptx", "pdf", "Slide 1\nk | v\nSay it.\nSlide 2\nLast slide\nx < y"), ("svg", "odg", "hi"), ("svg", "pdf", "hi"), ("odb", "pdf", "People\nname\tage\nCara\t41"), ("latex", "odf", "(a)/(2)"), ("md", "svg", "T\npara"),
])
def converted_back(spark, root):
    """Texts read out of what the exporters wrote."""
    sources = {
        "csv": b"a,b\n1,2\n", "pptx": sinks.pack(_DECK), "svg": b'<svg xmlns="http://www.w3.org/2000/svg"><text x="1mm" y="2mm">hi</text></svg>', "latex": rb"\frac{a}{2}", "md": b"# T\n\npara\n",
        "odb": sinks.pack([("mimetype", "application/vnd.oasis.opendocument.base"), ("content.xml", '<c xmlns:db="d"><db:table-representation db:name="People"/></c>'), ("database/People.csv", "name,age\nCara,41\n")]),
    }

    def text(data: bytes, target: str) -> str:
        if target == "pdf":
            return "\n".join(line for page in pdf.pages(data) for line in page if line)
        if target == "svg":
            return "\n".join(s[-1] for s in packages.svg_elements(data) if s[-1])
        if target == "odg":
            return "\n".join(s[-1] for s in packages.odg_elements(data))
        if target == "odf":
            return convert.convert(data, "odf", "txt").decode()
        return next(t for n, kind, t in (packages.pptx_elements if target == "pptx" else packages.odp_elements)(data) if n == 2)

    rows = []
    for source, target in (("csv", "pdf"), ("csv", "svg"), ("pptx", "odp"), ("pptx", "pptx"), ("pptx", "pdf"), ("svg", "odg"), ("svg", "pdf"), ("odb", "pdf"), ("latex", "odf"), ("md", "svg")):
        rows.append((source, target, text(convert.convert(sources[source], source, target), target)))
    return spark.createDataFrame(rows, "source string, target string, text string")
