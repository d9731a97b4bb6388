"""Sinks: grids of cells as CSV, Markdown and HTML, result files, packages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.numbers import display
from quillgrid.operators.formula import BLANK, Value, address
from quillgrid.sources.markup import encode_entities


def cell_text(evaluated: bool = False, error: str = "") -> Column:
    """Text of a cell: formulas by their source, unless the cells were evaluated; ``error`` stands before an error."""
    return F.coalesce(
        F.when(F.col("kind") == "number", display(F.col("num")))
        .when(F.col("kind") == "bool", F.col("flag").cast("string"))
        .when((F.col("kind") == "formula") & F.lit(not evaluated), F.concat(F.lit("="), F.col("value")))
        .when(F.col("kind") == "error", F.concat(F.lit(error), F.col("value")))
        .otherwise(F.col("value")),
        F.lit(""),
    )


def extents(cells: DataFrame, by: tuple[str, ...] = ("doc_key", "sheet")) -> DataFrame:
    """Last row and column of each sheet by its cells that are not empty; 0 and 0, and no cells, if all are."""
    filled = F.coalesce(F.col("kind") != "empty", F.lit(True))
    last = lambda name: F.coalesce(F.max(F.when(filled, F.col(name))), F.lit(0))
    return cells.groupBy(*by).agg(last("row_no").alias("rows"), last("col_no").alias("cols"), F.count(F.when(filled, 1)).alias("cells"))


def grid_rows(cells: DataFrame, text: Column) -> DataFrame:
    """Dense rows: doc_key, sheet, cells (of the sheet), row_no, fields (an array from column 0 to the sheet's last).

    A group is one row of a sheet, so no sheet is gathered in one task; missing rows have blank fields.
    """
    size = extents(cells)
    filled = cells.groupBy("doc_key", "sheet", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", text.alias("text")))).alias("by_col"))
    every = size.select("doc_key", "sheet", "cells", "cols", F.explode(F.sequence(F.lit(0), "rows")).alias("row_no"))
    return every.join(filled, ["doc_key", "sheet", "row_no"], "left").select("doc_key", "sheet", "cells", "row_no", F.transform(F.sequence(F.lit(0), "cols"), lambda c: F.coalesce(F.try_element_at("by_col", c), F.lit(""))).alias("fields"))


def csv_field(text: Column) -> Column:
    """Quoted only where a comma, a quote or a line break makes it needed."""
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_text(text: str) -> str:
    """As ``csv_field``, of one text."""
    return '"' + text.replace('"', '""') + '"' if any(ch in text for ch in ',"\n') else text


#: What stands before an error in CSV.
CSV_ERROR = "#ERR "


def csv_lines(cells: DataFrame) -> DataFrame:
    rows = grid_rows(cells, cell_text(error=CSV_ERROR))
    return rows.select("doc_key", "sheet", "row_no", F.array_join(F.transform("fields", csv_field), ",").alias("line"))


#: The line of a sheet without cells.
EMPTY_SHEET = "(empty sheet)"


def markdown_lines(cells: DataFrame) -> DataFrame:
    """Rows of a pipe table; the rule after the header is part of row 0's line. Line breaks in cells are kept."""
    rows = grid_rows(cells, cell_text())
    line = F.concat(F.lit("| "), F.array_join(F.transform("fields", lambda t: F.replace(t, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.size("fields")))
    return rows.select("doc_key", "sheet", "row_no", F.when(F.col("cells") == 0, EMPTY_SHEET).when(F.col("row_no") == 0, F.concat(line, rule)).otherwise(line).alias("line"))


def html_lines(cells: DataFrame, evaluated: bool = True) -> DataFrame:
    from quillgrid.functions.texts import encode_entities as encode

    rows = grid_rows(cells, cell_text(evaluated))
    return rows.select("doc_key", "sheet", "row_no", F.concat(F.lit("<tr>"), F.array_join(F.transform("fields", lambda t: F.concat(F.lit("<td>"), encode(t), F.lit("</td>"))), ""), F.lit("</tr>")).alias("line"))


def write_tsv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def json_report(errors: DataFrame) -> DataFrame:
    """One JSON text a row of an error report."""
    return errors.select(F.to_json(F.struct(*errors.columns)).alias("value"))


def pack(parts: Iterable[tuple[str, str | bytes]], stored: tuple[str, ...] = ("mimetype",)) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def _xlsx_result(v: Value) -> tuple[str, str]:
    """Type attribute and element of a formula's value that is no number; a blank one has none."""
    if v.kind == "bool":
        return ' t="b"', f"<v>{int(bool(v.value))}</v>"
    if v.kind in ("text", "error"):
        return ' t="str"' if v.kind == "text" else ' t="e"', f"<v>{encode_entities(v.value)}</v>"
    return "", ""


def xlsx_bytes(sheets: dict[str, list[tuple]]) -> bytes:
    """A workbook; cells are (row, col, kind, value, num, flag), of formulas with the value known so far: a number, or a seventh field."""
    parts = []
    for k, cells in enumerate(sheets.values()):
        rows: dict[int, list[str]] = {}
        for row, col, kind, value, num, flag, *result in sorted(cells, key=lambda c: (c[0], c[1])):
            at = address(row, col)
            if kind == "number":
                xml = f'<c r="{at}"><v>{num!r}</v></c>'
            elif kind == "bool":
                xml = f'<c r="{at}" t="b"><v>{int(bool(flag))}</v></c>'
            elif kind == "error":
                xml = f'<c r="{at}" t="e"><v>{encode_entities(value or "")}</v></c>'
            elif kind == "formula":
                what, v = ("", f"<v>{num!r}</v>") if num is not None else _xlsx_result(*result or [BLANK])
                xml = f'<c r="{at}"{what}><f>{encode_entities(value or "")}</f>{v}</c>'
            else:
                xml = f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{encode_entities(value or "")}</t></is></c>'
            rows.setdefault(row, []).append(xml)
        body = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in rows.items())
        parts.append((f"xl/worksheets/sheet{k + 1}.xml", f'{_HEAD}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'))
    n = range(1, len(sheets) + 1)
    parts += [
        ("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in n) + "</Types>"),
        ("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'{_HEAD}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{encode_entities(s, True)}" sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(n, sheets, strict=True)) + "</sheets></workbook>"),
        ("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>"),
    ]
    return pack(parts)


_ODF = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'


def _odf(kind: str, content: str) -> bytes:
    mime = f"application/vnd.oasis.opendocument.{kind}"
    return pack([("mimetype", mime), ("content.xml", f'{_HEAD}<office:document-content {_ODF} office:version="1.2"><office:body>{content}</office:body></office:document-content>'), ("META-INF/manifest.xml", f'{_HEAD}<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>')])


def _ods_result(v: Value) -> tuple[str, str]:
    """Attributes and content of a formula's value that is no number; a blank one has none."""
    if v.kind == "bool":
        return f' office:value-type="boolean" office:boolean-value="{str(bool(v.value)).lower()}"', ""
    if v.kind in ("text", "error"):
        error = ' xmlns:calcext="urn:org:documentfoundation:names:experimental:calc:xmlns:calcext:1.0" calcext:value-type="error"' if v.kind == "error" else ""
        return f' office:value-type="string" office:string-value="{encode_entities(v.value, True)}"{error}', f"<text:p>{encode_entities(v.value)}</text:p>"
    return "", ""


def ods_bytes(sheets: dict[str, list[tuple]], header: bool = False) -> bytes:
    out = []
    for name, cells in sheets.items():
        by = {(c[0], c[1]): c for c in cells}
        widths: dict[int, int] = {}
        for r, c in by:
            widths[r] = max(widths.get(r, -1), c)
        rows = []
        for r in range(max(widths, default=-1) + 1):
            fields = []
            for c in range(widths.get(r, -1) + 1):
                cell = by.get((r, c))
                if cell is None:
                    fields.append("<table:table-cell/>")
                    continue
                _, _, kind, value, num, flag, *result = cell
                if kind == "number":
                    fields.append(f'<table:table-cell office:value-type="float" office:value="{num!r}"><text:p>{num!r}</text:p></table:table-cell>')
                elif kind == "bool":
                    fields.append(f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(bool(flag)).lower()}"/>')
                elif kind == "formula":
                    what, shown = (f' office:value-type="float" office:value="{num!r}"', "") if num is not None else _ods_result(*result or [BLANK])
                    fields.append(f'<table:table-cell table:formula="of:={encode_entities(value or "", True)}"{what}>{shown}</table:table-cell>')
                elif kind == "error":
                    what, shown = _ods_result(Value("error", value or ""))
                    fields.append(f"<table:table-cell{what}>{shown}</table:table-cell>")
                else:
                    fields.append(f'<table:table-cell office:value-type="string"><text:p>{encode_entities(value or "")}</text:p></table:table-cell>')
            rows.append(f"<table:table-row>{''.join(fields)}</table:table-row>")
        if header and rows:
            rows[0] = f"<table:table-header-rows>{rows[0]}</table:table-header-rows>"
        out.append(f'<table:table table:name="{encode_entities(name, True)}">{"".join(rows)}</table:table>')
    return _odf("spreadsheet", f"<office:spreadsheet>{''.join(out)}</office:spreadsheet>")


def odt_bytes(blocks: list[tuple]) -> bytes:
    """A text document of (kind, level, ordered, text) blocks."""
    out = []
    for kind, level, _, text in blocks:
        t = encode_entities(text)
        if kind == "heading":
            out.append(f'<text:h text:outline-level="{level or 1}">{t}</text:h>')
        elif kind == "list":
            out.append(f"<text:list><text:list-item><text:p>{t}</text:p></text:list-item></text:list>")
        elif kind == "table":
            out.append("<table:table><table:table-row>" + "".join(f"<table:table-cell><text:p>{c}</text:p></table:table-cell>" for c in t.split("\t")) + "</table:table-row></table:table>")
        else:
            out.append(f"<text:p>{t}</text:p>")
    return _odf("text", f"<office:text>{''.join(out)}</office:text>")


def docx_bytes(blocks: list[tuple]) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = []
    for kind, level, ordered, text in blocks:
        style = f'<w:pPr><w:pStyle w:val="Heading{level or 1}"/></w:pPr>' if kind == "heading" else ""
        run = lambda s: f'<w:r><w:t xml:space="preserve">{encode_entities(s)}</w:t></w:r>'
        if kind == "list":
            # an item opens with a run of its mark
            out.append(f"<w:p>{run('1. ' if ordered else '• ')}{run(text)}</w:p>")
        elif kind == "table":
            out.append("<w:tbl><w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in text.split("\t")) + "</w:tr></w:tbl>")
        else:
            out.append(f"<w:p>{style}{run(text)}</w:p>")
    return pack(
        [
            ("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'),
            ("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
            ("word/document.xml", f"{_HEAD}<w:document {w}><w:body>{''.join(out)}</w:body></w:document>"),
        ]
    )


def odb_bytes(tables: dict[str, tuple[list[str], list[list[object]]]]) -> bytes:
    """A database package: a content part naming the tables and a CSV member for each."""
    field = lambda v: "" if v is None else csv_text(str(v))
    members = [(f"database/{n}.csv", "\n".join(",".join(map(field, r)) for r in [cols, *rows])) for n, (cols, rows) in tables.items()]
    listed = "".join(f'<db:table-representation xmlns:db="urn:oasis:names:tc:opendocument:xmlns:database:1.0" db:name="{encode_entities(n, True)}"/>' for n in tables)
    return pack([("mimetype", "application/vnd.oasis.opendocument.base"), ("content.xml", f"{_HEAD}<office:document-content {_ODF}><office:body>{listed}</office:body></office:document-content>"), *members])


_DRAW = 'xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0" xmlns:svg="urn:oasis:names:tc:opendocument:xmlns:svg-compatible:1.0"'


def _odf_paragraphs(text: str) -> str:
    return "".join(f"<text:p>{encode_entities(t)}</text:p>" for t in text.split("\n")) if text else ""


def _odf_shape(kind: str, x: float, y: float, w: float, h: float, text: str) -> str:
    if kind == "line":
        return f'<draw:line svg:x1="{x:g}mm" svg:y1="{y:g}mm" svg:x2="{x + w:g}mm" svg:y2="{y + h:g}mm">{_odf_paragraphs(text)}</draw:line>'
    place = f'svg:x="{x:g}mm" svg:y="{y:g}mm" svg:width="{w:g}mm" svg:height="{h:g}mm"'
    if kind in ("rectangle", "ellipse"):
        name = "rect" if kind == "rectangle" else kind
        return f"<draw:{name} {place}>{_odf_paragraphs(text)}</draw:{name}>"
    return f"<draw:frame {place}><draw:text-box>{_odf_paragraphs(text)}</draw:text-box></draw:frame>"


def odg_bytes(shapes: list[tuple]) -> bytes:
    """A drawing of (page, kind, x, y, width, height, text) shapes in millimetres."""
    pages: dict[int, list[str]] = {}
    for page, kind, x, y, w, h, text in shapes:
        pages.setdefault(page, []).append(_odf_shape(kind, x or 0.0, y or 0.0, w or 0.0, h or 0.0, text or ""))
    return _odf("graphics", f"<office:drawing {_DRAW}>{''.join(f'<draw:page>{chr(32).join(p)}</draw:page>' for p in pages.values())}</office:drawing>")


def odp_bytes(elements: list[tuple]) -> bytes:
    """A presentation of (slide, kind, text) elements, one below the other; notes are kept as notes."""
    slides: dict[int, list[str]] = {}
    for slide, kind, text in elements:
        own = slides.setdefault(slide, [])
        if kind == "notes":
            own.append(f'<presentation:notes xmlns:presentation="urn:oasis:names:tc:opendocument:xmlns:presentation:1.0">{_odf_paragraphs(text)}</presentation:notes>')
        elif kind != "image":
            own.append(_odf_shape(kind if kind in ("rectangle", "ellipse") else "text_box", 20.0, 20.0 + 25.0 * len(own), 200.0, 20.0, text))
    return _odf("presentation", f"<office:presentation {_DRAW}>{''.join(f'<draw:page>{chr(32).join(p)}</draw:page>' for p in slides.values())}</office:presentation>")


_PML = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def pptx_bytes(elements: list[tuple]) -> bytes:
    """A presentation of (slide, kind, text) elements, one below the other in twentieths of an inch; notes are kept as notes."""
    slides: dict[int, list[tuple]] = {}
    for slide, kind, text in elements:
        slides.setdefault(slide, []).append((kind, text))

    def box(k: int, text: str) -> str:
        lines = "".join(f"<a:p><a:r><a:t>{encode_entities(t)}</a:t></a:r></a:p>" for t in text.split("\n"))
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{k + 2}" name="Text {k + 1}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="457200" y="{457200 * (k + 1)}"/><a:ext cx="8229600" cy="411480"/></a:xfrm></p:spPr><p:txBody><a:bodyPr/>{lines}</p:txBody></p:sp>'

    parts, kinds = [], ""
    for n, own in enumerate(slides.values(), 1):
        boxes = "".join(box(k, text) for k, (kind, text) in enumerate(x for x in own if x[0] not in ("notes", "image")) )
        parts.append((f"ppt/slides/slide{n}.xml", f"{_HEAD}<p:sld {_PML}><p:cSld><p:spTree>{boxes}</p:spTree></p:cSld></p:sld>"))
        kinds += f'<Override PartName="/ppt/slides/slide{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.presentationml.slide+xml"/>'
        notes = "\n".join(text for kind, text in own if kind == "notes")
        if notes:
            parts.append((f"ppt/slides/_rels/slide{n}.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/notesSlide" Target="../notesSlides/notesSlide{n}.xml"/></Relationships>'))
            parts.append((f"ppt/notesSlides/notesSlide{n}.xml", f"{_HEAD}<p:notes {_PML}><p:cSld><p:spTree>{box(0, notes)}</p:spTree></p:cSld></p:notes>"))
    numbers = range(1, len(slides) + 1)
    parts += [
        ("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/ppt/presentation.xml" ContentType="application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml"/>{kinds}</Types>'),
        ("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="ppt/presentation.xml"/></Relationships>'),
        ("ppt/presentation.xml", f'{_HEAD}<p:presentation {_PML}><p:sldIdLst>{"".join(f"""<p:sldId id="{255 + n}" r:id="rId{n}"/>""" for n in numbers)}</p:sldIdLst></p:presentation>'),
        ("ppt/_rels/presentation.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="rId{n}" Type="{_REL}/slide" Target="slides/slide{n}.xml"/>""" for n in numbers)}</Relationships>'),
    ]
    return pack(parts)


def odf_formula_bytes(mathml: str) -> bytes:
    """A formula package; its content is the formula itself, in no office element."""
    mime = "application/vnd.oasis.opendocument.formula"
    return pack([("mimetype", mime), ("content.xml", f'{_HEAD}<math xmlns="http://www.w3.org/1998/Math/MathML">{mathml}</math>'), ("META-INF/manifest.xml", f'{_HEAD}<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{mime}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>')])


def grid_svg(grid: list[list[str]], width: float = 30.0, height: float = 6.0) -> bytes:
    """A table as a drawing: a box and a text for every cell, in millimetres."""
    out = []
    for r, row in enumerate(grid):
        for c, text in enumerate(row):
            x, y = c * width, r * height
            out.append(f'<rect x="{x:g}mm" y="{y:g}mm" width="{width:g}mm" height="{height:g}mm" fill="none" stroke="black"/>')
            if text:
                out.append(f'<text x="{x + 1:g}mm" y="{y + height - 2:g}mm">{encode_entities(text)}</text>')
    wide = max((len(row) for row in grid), default=0)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide * width:g}mm" height="{len(grid) * height:g}mm">{"".join(out)}</svg>'.encode()


def lines_svg(lines: list[str], height: float = 6.0) -> bytes:
    """Lines of text as a drawing, one below the other."""
    texts = "".join(f'<text x="10mm" y="{10 + height * k:g}mm">{encode_entities(t)}</text>' for k, t in enumerate(lines) if t)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="210mm" height="{20 + height * len(lines):g}mm">{texts}</svg>'.encode()
