import pytest

from quillgrid.plans import convert
from quillgrid.session import Unsupported
from quillgrid.sources import packages, pdf, sinks

CSV = b"Name,Qty,Price\nA,2,1.5\nB,3,=B2*2\n"


def test_text_family():
    for kind in ("docx", "odt"):
        data = convert.convert(b"# Title\n\nA *b* c.\n\n- x\n- y\n", "md", kind)
        assert packages.sniff(data) == kind
        assert b"Title" in convert.convert(data, None, "txt") and b"# Title" in convert.convert(data, None, "md") and b"<h1>Title</h1>" in convert.convert(data, kind, "html")
    page = convert.convert(b"# T (x)\n\npara", "md", "pdf")
    assert [t for p in pdf.pages(page) for t in p] == ["T (x)", "para"]
    assert convert.convert(page, None, "txt").startswith(b"T (x)")


def test_spreadsheets():
    for kind in ("xlsx", "ods"):
        data = convert.convert(CSV, "csv", kind)
        assert convert.convert(data, None, "csv").decode() == "Name,Qty,Price\nA,2,1.5\nB,3,=B2*2"
        assert b"<td>4</td>" in convert.convert(data, None, "html")
        assert [c[-2] for c in (packages.xlsx_cells if kind == "xlsx" else packages.ods_cells)(data) if c[4] == "formula"] == [4.0]
    assert convert.convert(CSV, "csv", "md").decode().split("\n")[1] == "| --- | --- | --- |"


def test_others():
    svg = b'<svg xmlns="http://www.w3.org/2000/svg"><rect x="1mm" y="2mm" width="3mm" height="4mm"/><text x="0mm" y="0mm">hi</text></svg>'
    again = convert.convert(svg, "svg", "svg")
    assert [s[1:6] for s in packages.svg_elements(again)] == [s[1:6] for s in packages.svg_elements(svg)][:1] + [("text_box", 0.0, 0.0, None, None)]
    assert convert.convert(rb"\frac{a}{2}", "latex", "txt") == b"(a)/(2)" and b"<mfrac>" in convert.convert(rb"\frac{a}{2}", "latex", "mathml")
    odb = sinks.odb_bytes({"t": (["a"], [["x,y"]])})
    assert convert.convert(odb, "odb", "csv") == b'a\n"x,y"' and b"<td>x,y</td>" in convert.convert(odb, None, "html")
    pptx = sinks.pack([("ppt/presentation.xml", '<p xmlns:r="r"><sldId r:id="r1"/></p>'), ("ppt/_rels/presentation.xml.rels", '<Relationships><Relationship Id="r1" Target="slides/s.xml"/></Relationships>'), ("ppt/slides/s.xml", "<s><sp><txBody><p><r><t>Hello</t></r></p></txBody></sp><tbl><tr><tc><t>a</t></tc><tc/><tc><t>b</t></tc></tr></tbl></s>")])
    assert convert.convert(pptx, "pptx", "txt") == b"Slide 1\n\nHello\n\na | b"


def test_refused():
    for source, target in (("csv", "docx"), ("xls", "csv"), ("zzz", "txt")):
        with pytest.raises(Unsupported):
            convert.convert(b"x", source, target)
    assert ("docx", "text", "pdf") in convert.routes() and len(convert.routes()) > 60


def test_batches(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    got = {r.path[-4:]: (r.format, r.error is None) for r in convert.convert_files(packages.read_files(spark, str(tmp_path)), "html").collect()}
    assert got == {"a.md": ("md", True), ".bin": (None, False)}
    assert convert.route_table(spark).where("source = 'ods'").count() == 7
