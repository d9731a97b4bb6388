"""Packaged documents (OOXML, ODF) and plain formats to rows, one document a row of bytes.

Parsers are pure functions of bytes; ``read`` applies them to a binaryFile table in Arrow workers and
reports a document that cannot be read in its ``error`` column instead of failing the batch.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators.charts import DATE_PARTS
from quillgrid.operators.formula import parse_address, shift
from quillgrid.session import EngineError, InvalidInput, Unsupported
from quillgrid.sources import legacy, markup, pdf
from quillgrid.sources.delimited import tokenize


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attr(node: ET.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    if name in node.attrib:
        return node.attrib[name]
    return next((v for k, v in node.attrib.items() if local(k) == name), default)


def children(node: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in node if local(c.tag) == name]


def descendants(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (c for c in node.iter() if local(c.tag) == name)


def parse_xml(data: bytes) -> ET.Element:
    """Root of an XML part; what a strict parser refuses is closed and read again leniently."""
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        return markup.lenient_xml(data.decode("utf-8", "replace"))


def normalize_path(path: str) -> str:
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if out:
                out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def resolve_target(part: str, target: str) -> str:
    """Path of a relationship's target, relative to the part that has it."""
    return normalize_path(target) if target.startswith("/") else normalize_path(part.rpartition("/")[0] + "/" + target)


def rels_path(part: str) -> str:
    folder, _, name = part.rpartition("/")
    return f"{folder}/_rels/{name}.rels".lstrip("/")


def relationships(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    path = rels_path(part)
    if path not in z.namelist():
        return {}
    return {attr(r, "Id", ""): resolve_target(part, attr(r, "Target", "")) for r in descendants(parse_xml(z.read(path)), "Relationship") if attr(r, "TargetMode") != "External"}


def zip_entries(data: bytes) -> list[tuple]:
    """(name, compressed, size, offset, crc) of the members."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(i.filename, i.compress_size, i.file_size, i.header_offset, i.CRC) for i in z.infolist()]


# -- spreadsheets: rows (sheet_no, sheet, row_no, col_no, kind, value, num, flag) ---------------------------


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def xlsx_cells(data: bytes) -> Iterator[tuple]:
    """Cells of a workbook. Cells without an address follow the one before; shared formulas are moved to
    every cell that uses them; a missing sheet part is an empty sheet, so later ones keep their number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        rels = relationships(z, "xl/workbook.xml")
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in descendants(si, "t")) for si in children(parse_xml(z.read("xl/sharedStrings.xml")), "si")]
        for k, sheet in enumerate(descendants(parse_xml(z.read("xl/workbook.xml")), "sheet")):
            part = rels.get(attr(sheet, "id", ""), f"xl/worksheets/sheet{k + 1}.xml")
            if part not in names:
                continue
            masters: dict[str, tuple[str, int, int]] = {}
            next_row = 0
            for row in descendants(parse_xml(z.read(part)), "row"):
                r = int(attr(row, "r") or next_row + 1) - 1
                next_row, c = r + 1, 0
                for cell in children(row, "c"):
                    at = attr(cell, "r")
                    if at:
                        r, c = parse_address(at)
                    kind, here = attr(cell, "t", "n"), c
                    c += 1
                    formula = next(iter(children(cell, "f")), None)
                    v = next(iter(children(cell, "v")), None)
                    text = (v.text or "") if v is not None else ""
                    if formula is not None:
                        source, group = formula.text or "", attr(formula, "si")
                        if attr(formula, "t") == "shared" and group is not None:
                            if source:
                                masters[group] = (source, r, here)
                            elif group in masters:
                                first, r0, c0 = masters[group]
                                source = shift(first, r - r0, here - c0)
                        if source:
                            yield k, attr(sheet, "name", f"Sheet{k + 1}"), r, here, "formula", source, _number(text) if kind == "n" else None, None
                            continue
                    if kind == "s":
                        index = int(text) if text.isdigit() else -1
                        value = ("text", shared[index] if 0 <= index < len(shared) else "", None, None)
                    elif kind == "inlineStr":
                        value = ("text", "".join(t.text or "" for t in descendants(cell, "t")), None, None)
                    elif kind == "b":
                        value = ("bool", None, None, text == "1")
                    elif kind == "e":
                        value = ("error", text, None, None)
                    elif kind == "str":
                        value = ("text", text, None, None)
                    elif (x := _number(text)) is not None:
                        value = ("number", None, x, None)
                    elif text:
                        value = ("text", text, None, None)
                    else:
                        continue
                    yield k, attr(sheet, "name", f"Sheet{k + 1}"), r, here, *value


def ods_cells(data: bytes) -> Iterator[tuple]:
    """Cells of a workbook; repeated rows and columns are expanded where they hold something, header rows count."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = parse_xml(z.read("content.xml"))
    for k, table in enumerate(descendants(root, "table")):
        r = 0
        rows = [row for row in table.iter() if local(row.tag) == "table-row"]
        for row in rows:
            again = int(attr(row, "number-rows-repeated", "1"))
            c, found = 0, []
            for cell in row:
                if local(cell.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                width = int(attr(cell, "number-columns-repeated", "1"))
                kind, formula = attr(cell, "value-type"), attr(cell, "formula")
                text = "\n".join("".join(p.itertext()) for p in children(cell, "p"))
                value = None
                if formula:
                    source = re.sub(r"^(of|oooc):", "", formula).removeprefix("=")
                    value = ("formula", re.sub(r"\[\.?([^\]]*)\]", lambda m: m.group(1).replace(".", "!" if not m.group(1).startswith(".") and "." in m.group(1) else "").replace(":!", ":"), source), _number(attr(cell, "value", "")), None)
                elif kind in ("float", "percentage", "currency"):
                    value = ("number", None, _number(attr(cell, "value", "")), None)
                elif kind == "boolean":
                    value = ("bool", None, None, attr(cell, "boolean-value") == "true")
                elif kind in ("date", "time"):
                    value = ("text", attr(cell, f"{kind}-value", text), None, None)
                elif text:
                    value = ("text", text, None, None)
                if value:
                    found += [(c + i, value) for i in range(width)]
                c += width
            if found:
                for i in range(again):
                    for col, value in found:
                        yield k, attr(table, "name", f"Sheet{k + 1}"), r + i, col, *value
            r += again


def odb_tables(data: bytes) -> list[tuple[str, list[str], list[list[str | None]]]]:
    """(name, columns, rows of texts) of a database package: declared tables with their CSV members, inline
    tables, else any CSV member below database/."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        root = parse_xml(z.read("content.xml")) if "content.xml" in names else ET.Element("none")
        for node in descendants(root, "table-representation"):
            name = attr(node, "name", "")
            member = f"database/{name}.csv"
            rows = tokenize(z.read(member).decode("utf-8", "replace")) if member in names else []
            header = [h.strip() or f"column_{k + 1}" for k, h in enumerate(rows[0])] if rows else []
            out.append((name, header, rows[1:]))
        if not out:
            for node in descendants(root, "table"):
                records = [{attr(c, "name", ""): "".join(c.itertext()) for c in children(row, "cell")} for row in children(node, "row")]
                header = list(dict.fromkeys(k for r in records for k in r))
                if header:
                    out.append((attr(node, "name", ""), header, [[r.get(h) for h in header] for r in records]))
        if not out:
            for member in sorted(n for n in names if n.startswith("database/") and n.endswith(".csv")):
                rows = tokenize(z.read(member).decode("utf-8", "replace"))
                if rows:
                    out.append((member[9:-4], [h.strip() or f"column_{k + 1}" for k, h in enumerate(rows[0])], rows[1:]))
    return out


# -- text documents: blocks (kind, level, ordered, text) ----------------------------------------------------


def _run_text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        name = local(x.tag)
        if name == "t":
            out.append(x.text or "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        elif name == "footnoteReference":
            out.append(f"[^{attr(x, 'id', '')}]")
    return "".join(out)


def docx_blocks(data: bytes) -> Iterator[tuple]:
    """Headers, body, notes (numbered in order of reference) and footers as blocks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        ordered_by: dict[str, bool] = {}
        if "word/numbering.xml" in names:
            root = parse_xml(z.read("word/numbering.xml"))
            formats = {attr(a, "abstractNumId"): next((attr(f, "val") for f in descendants(a, "numFmt")), "bullet") for a in descendants(root, "abstractNum")}
            for n in children(root, "num"):
                base = next((attr(a, "val") for a in children(n, "abstractNumId")), None)
                ordered_by[attr(n, "numId", "")] = formats.get(base, "bullet") not in ("bullet", "none")

        def blocks(parent: ET.Element) -> Iterator[tuple]:
            for node in parent:
                name = local(node.tag)
                if name == "p":
                    style = next((attr(s, "val", "") for s in descendants(node, "pStyle")), "")
                    num = next((attr(s, "val", "") for s in descendants(node, "numId")), None)
                    text = _run_text(node).strip()
                    m = re.fullmatch(r"(?i)heading\s?([1-9])|title", style)
                    if any(attr(b, "type") == "page" for b in descendants(node, "br")):
                        yield "page_break", None, None, ""
                    if not text:
                        continue
                    if m:
                        yield "heading", int(m.group(1) or 1), None, text
                    elif num is not None and num != "0":
                        yield "list", None, ordered_by.get(num, False), text
                    else:
                        yield "paragraph", None, None, text
                elif name == "tbl":
                    for row in children(node, "tr"):
                        yield "table", None, None, "\t".join(" ".join(_run_text(p).strip() for p in descendants(cell, "p")).strip() for cell in children(row, "tc"))
                elif name in ("sdt", "sdtContent", "ins", "smartTag"):
                    yield from blocks(node)

        for member in sorted(n for n in names if re.fullmatch(r"word/header[0-9]*\.xml", n)):
            yield from blocks(parse_xml(z.read(member)))
        root = parse_xml(z.read("word/document.xml"))
        numbered = {}
        for ref in descendants(root, "footnoteReference"):
            numbered.setdefault(attr(ref, "id", ""), len(numbered) + 1)
        renumber = lambda b: (*b[:3], re.sub(r"\[\^([^\]]*)\]", lambda m: f"[{numbered.get(m.group(1), m.group(1))}]", b[3]))
        for body in descendants(root, "body"):
            yield from map(renumber, blocks(body))
        for member, tag in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
            if member in names:
                notes = {attr(n, "id", ""): n for n in children(parse_xml(z.read(member)), tag) if attr(n, "type") not in ("separator", "continuationSeparator")}
                for key in sorted(notes, key=lambda i: (numbered.get(i, 1 << 30), i)):
                    text = " ".join(b[3] for b in blocks(notes[key]))
                    if text:
                        yield "paragraph", None, None, f"[{numbered.get(key, key)}] {text}"
        for member in sorted(n for n in names if re.fullmatch(r"word/footer[0-9]*\.xml", n)):
            yield from blocks(parse_xml(z.read(member)))


def _odf_text(node: ET.Element) -> str:
    out = [node.text or ""]
    for c in node:
        name = local(c.tag)
        if name == "s":
            out.append(" " * int(attr(c, "c", "1")))
        elif name == "tab":
            out.append("\t")
        elif name == "line-break":
            out.append("\n")
        elif name != "annotation":
            out.append(_odf_text(c))
        out.append(c.tail or "")
    return "".join(out)


def odt_blocks(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = parse_xml(z.read("content.xml"))

    def blocks(parent: ET.Element) -> Iterator[tuple]:
        for node in parent:
            name = local(node.tag)
            if name == "h":
                yield "heading", int(attr(node, "outline-level", "1")), None, _odf_text(node).strip()
            elif name == "p":
                if text := _odf_text(node).strip():
                    yield "paragraph", None, None, text
            elif name == "list":
                for item in children(node, "list-item"):
                    for p in item:
                        if local(p.tag) == "p":
                            yield "list", None, False, _odf_text(p).strip()
                        elif local(p.tag) == "list":
                            yield from blocks([p])
            elif name == "table":
                for row in descendants(node, "table-row"):
                    yield "table", None, None, "\t".join(" ".join(_odf_text(p).strip() for p in descendants(c, "p")) for c in children(row, "table-cell"))
            elif name == "soft-page-break":
                yield "page_break", None, None, ""
            elif name == "section":
                yield from blocks(node)

    for body in descendants(root, "text"):
        if local(body.tag) == "text" and len(body):
            yield from blocks(body)
            return


def csv_cells(data: bytes, sheet: str = "Sheet1") -> Iterator[tuple]:
    """Cells of a CSV file, each of the kind its text has; blank fields are no cells."""
    for r, row in enumerate(tokenize(data.decode("utf-8", "replace"))):
        for c, field in enumerate(row):
            t = field.strip()
            if not t:
                continue
            if t.startswith("="):
                yield 0, sheet, r, c, "formula", t[1:], None, None
            elif t.lower() in ("true", "false"):
                yield 0, sheet, r, c, "bool", None, None, t.lower() == "true"
            elif (x := _number(t)) is not None:
                yield 0, sheet, r, c, "number", None, x, None
            else:
                yield 0, sheet, r, c, "text", t, None, None


def cells_of(data: bytes, kind: str | None) -> Iterator[tuple]:
    """Cells of a workbook of any format read here."""
    readers = {"xlsx": xlsx_cells, "ods": ods_cells, "csv": csv_cells}
    if kind not in readers:
        raise Unsupported(f"no workbook: {kind}")
    return readers[kind](data)


def tables_of(data: bytes, kind: str | None, name: str = "data") -> list[tuple[str, list[str], list[list]]]:
    """(name, columns, rows) of a database, or of a CSV file as one table of the given name."""
    if kind == "odb":
        return odb_tables(data)
    if kind != "csv":
        raise Unsupported(f"no database: {kind}")
    rows = tokenize(data.decode("utf-8", "replace").removeprefix("\ufeff"))
    return [(name, rows[0], [[x if x != "" else None for x in (*r, *[""] * (len(rows[0]) - len(r)))][: len(rows[0])] for r in rows[1:]])] if rows else []


def zip_entry(data: bytes, name: str) -> bytes:
    """One member of an archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if name not in z.namelist():
            raise InvalidInput(f"no entry {name}")
        return z.read(name)


#: Kinds of charts by their element.
CHARTS = {"barChart": "bar", "bar3DChart": "bar", "lineChart": "line", "line3DChart": "line", "areaChart": "area", "area3DChart": "area", "scatterChart": "scatter", "pieChart": "pie", "pie3DChart": "pie", "doughnutChart": "doughnut"}


def _cache(node: ET.Element | None) -> dict[int, str]:
    """Points of a cache by their index."""
    found = {}
    for point in descendants(node, "pt") if node is not None else ():
        index = attr(point, "idx", "")
        if index.isdigit():
            found[int(index)] = "".join(t.text or "" for t in children(point, "v"))
    return found


def chart_points(xml: bytes) -> Iterator[tuple]:
    """(series_no, series, kind, dated, pt_idx, category, y) of a chart part: cached points by index, those that are no
    numbers left out. Bars that stand are columns; a point takes the category of its index."""
    n = 0
    for plot in parse_xml(xml).iter():
        kind = CHARTS.get(local(plot.tag))
        if kind is None:
            continue
        if kind == "bar" and next((attr(d, "val") for d in children(plot, "barDir")), "col") != "bar":
            kind = "column"
        for ser in children(plot, "ser"):
            first = lambda *names: next((x for name in names for x in children(ser, name)), None)  # noqa: B023, E731
            title, cat = first("tx"), first("cat", "xVal")
            name = "".join(t.text or "" for t in descendants(title, "v")) if title is not None else ""
            code = next((c.text or "" for c in descendants(cat, "formatCode")), "") if cat is not None else ""
            categories = _cache(cat)
            for idx, text in sorted(_cache(first("val", "yVal")).items()):
                if (y := _number(text)) is not None:
                    yield n, name, kind, any(part in code.lower() for part in DATE_PARTS), idx, categories.get(idx), y
            n += 1


def pptx_charts(data: bytes) -> Iterator[tuple]:
    """(chart, ...) as ``chart_points`` of every chart part, in the order of their names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"ppt/charts/chart[0-9]+\.xml", n)):
            for row in chart_points(z.read(name)):
                yield name, *row


# -- presentations and drawings: elements -------------------------------------------------------------------


def pptx_elements(data: bytes) -> Iterator[tuple]:
    """(slide_no, kind, text) of every slide in the presentation's order, tables flattened, notes last."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        rels = relationships(z, "ppt/presentation.xml")
        # the relationship's id has a namespace, beside the slide's own
        order = [rels.get(next((v for k, v in s.attrib.items() if k != "id" and local(k) == "id"), "")) for s in descendants(parse_xml(z.read("ppt/presentation.xml")), "sldId")]
        order = [attr_path for attr_path in order if attr_path in names] or sorted((n for n in names if re.fullmatch(r"ppt/slides/slide[0-9]+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for k, part in enumerate(order):
            root = parse_xml(z.read(part))
            for shape in root.iter():
                name = local(shape.tag)
                if name == "sp":
                    paragraphs = ["".join(t.text or "" for t in descendants(p, "t")) for p in descendants(shape, "p")]
                    if text := "\n".join(p for p in paragraphs if p).strip():
                        yield k + 1, "text_box", text
                elif name == "tbl":
                    for row in descendants(shape, "tr"):
                        cells = [" ".join(t.text or "" for t in descendants(c, "t")).strip() for c in children(row, "tc")]
                        yield k + 1, "table", " | ".join(c for c in cells if c)
                elif name == "pic":
                    yield k + 1, "image", next((attr(p, "descr", "") for p in descendants(shape, "cNvPr")), "")
            for target in relationships(z, part).values():
                if "notesSlide" in target and target in names:
                    text = "\n".join("".join(t.text or "" for t in descendants(p, "t")) for p in descendants(parse_xml(z.read(target)), "p")).strip()
                    if text:
                        yield k + 1, "notes", text


def odp_elements(data: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = parse_xml(z.read("content.xml"))
    for k, page in enumerate(descendants(root, "page")):
        for frame in page:
            name = local(frame.tag)
            text = "\n".join(_odf_text(p) for p in descendants(frame, "p")).strip()
            if name == "frame":
                yield k + 1, "image" if next(descendants(frame, "image"), None) is not None else "text_box", text
            elif name in ("rect", "ellipse", "line"):
                yield k + 1, {"rect": "rectangle"}.get(name, name), text
            elif name == "notes":
                yield k + 1, "notes", text


_LENGTH = re.compile(r"\s*(-?[0-9.]+)\s*(cm|mm|in|pt|px|)\s*\Z")
#: Millimetres of a unit.
UNITS = {"cm": 10.0, "mm": 1.0, "in": 25.4, "pt": 0.352778, "px": 0.264583, "": 1.0}


def millimetres(text: str | None) -> float | None:
    m = _LENGTH.match(text or "")
    return float(m.group(1)) * UNITS[m.group(2)] if m else None


def odg_elements(data: bytes) -> Iterator[tuple]:
    """(page_no, kind, x, y, width, height, text) of a drawing, its top level."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = parse_xml(z.read("content.xml"))
    for k, page in enumerate(descendants(root, "page")):
        for node in page:
            name = local(node.tag)
            text = "\n".join(_odf_text(p) for p in descendants(node, "p")).strip()
            if name in ("rect", "ellipse", "circle", "frame"):
                kind = {"rect": "rectangle", "circle": "ellipse", "frame": "text_box"}.get(name, name)
                yield k + 1, kind, *(millimetres(attr(node, a)) for a in ("x", "y", "width", "height")), text
            elif name == "line":
                x1, y1, x2, y2 = (millimetres(attr(node, a)) or 0.0 for a in ("x1", "y1", "x2", "y2"))
                yield k + 1, "line", x1, y1, x2 - x1, y2 - y1, text


def svg_elements(data: bytes) -> Iterator[tuple]:
    def of(node: ET.Element, name: str) -> float:
        return (millimetres(attr(node, name)) or 0.0) * (UNITS["px"] if re.fullmatch(r"-?[0-9.]+", attr(node, name) or "") else 1.0)

    for node in parse_xml(data):
        name = local(node.tag)
        if name == "rect":
            yield 1, "rectangle", of(node, "x"), of(node, "y"), of(node, "width"), of(node, "height"), ""
        elif name in ("circle", "ellipse"):
            rx, ry = (of(node, "r"),) * 2 if name == "circle" else (of(node, "rx"), of(node, "ry"))
            yield 1, "ellipse", of(node, "cx") - rx, of(node, "cy") - ry, 2 * rx, 2 * ry, ""
        elif name == "line":
            yield 1, "line", of(node, "x1"), of(node, "y1"), of(node, "x2") - of(node, "x1"), of(node, "y2") - of(node, "y1"), ""
        elif name == "text":
            yield 1, "text_box", of(node, "x"), of(node, "y"), None, None, "".join(node.itertext()).strip()


# -- sniffing and reading -----------------------------------------------------------------------------------

HINTS = {"tex": "latex", "text": "txt", "markdown": "md", "htm": "html", "mml": "mathml", "odfmath": "odf", "odf-formula": "odf"}
FAMILIES = {**dict.fromkeys(("txt", "md", "html", "docx", "doc", "odt", "pdf"), "text"), **dict.fromkeys(("csv", "xlsx", "ods"), "spreadsheet"), **dict.fromkeys(("pptx", "odp"), "presentation"), **dict.fromkeys(("svg", "odg"), "drawing"), **dict.fromkeys(("latex", "mathml", "odf"), "formula"), "odb": "database"}


def format_hint(name: str) -> str:
    head = name.strip().removeprefix(".").split(":")[0].strip().lower()
    return HINTS.get(head, head)


def sniff(data: bytes) -> str | None:
    """Format of a document by its bytes."""
    if data[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
                for part, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx")):
                    if part in names:
                        return kind
                types = z.read("[Content_Types].xml").decode("utf-8", "replace").lower() if "[Content_Types].xml" in names else ""
                for word, kind in (("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("presentationml", "pptx")):
                    if word in types:
                        return kind
                mime = z.read("mimetype").decode("utf-8", "replace").lower() if "mimetype" in names else ""
                for word, kind in (("opendocument.text", "odt"), ("opendocument.spreadsheet", "ods"), ("opendocument.presentation", "odp"), ("opendocument.graphics", "odg"), ("opendocument.formula", "odf"), ("opendocument.base", "odb"), ("opendocument.database", "odb")):
                    if word in mime:
                        return kind
        except (zipfile.BadZipFile, KeyError):
            return None
    if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        wide = lambda s: s.encode("utf-16-le")
        for word, kind in (("WordDocument", "doc"), ("Workbook", "xls"), ("PowerPoint Document", "ppt")):
            if word.encode() in data or wide(word) in data:
                return kind
    if b"%PDF-" in data[:1024]:
        return "pdf"
    try:
        text = data.decode("utf-8").lstrip("﻿")
    except UnicodeDecodeError:
        return None
    if "<svg" in text:
        return "svg"
    if text.startswith(("<!doctype html", "<html")) or "<body" in text:
        return "html"
    if text.startswith("#") or "\n# " in text or "\n- " in text:
        return "md"
    if "," in text and len(text.split("\n")) - text.endswith("\n") > 1:
        return "csv"
    return "txt" if text else None


def blocks_of(data: bytes, kind: str) -> Iterator[tuple]:
    """Blocks (kind, level, ordered, text) of a text document of any readable format."""
    if kind == "docx":
        yield from docx_blocks(data)
    elif kind == "odt":
        yield from odt_blocks(data)
    elif kind == "md":
        for b in markup.markdown_blocks(data.decode("utf-8", "replace")):
            yield b["kind"], b.get("level"), b.get("ordered"), markup.plain(b)
    elif kind in ("html", "txt"):
        text = data.decode("utf-8", "replace")
        for p in markup.paragraphs(markup.html_text(text) if kind == "html" else text):
            yield "paragraph", None, None, p
    elif kind == "pdf":
        for k, page in enumerate(pdf.pages(data)):
            if k:
                yield "page_break", None, None, ""
            for line in page:
                yield "paragraph", None, None, line
    elif kind == "doc":
        for p in markup.paragraphs(legacy.doc_text(data)):
            yield "paragraph", None, None, p
    else:
        raise Unsupported(f"no text format: {kind}")


_CELLS = "path string, sheet_no int, sheet string, row_no int, col_no int, kind string, value string, num double, flag boolean, error string"
_BLOCKS = "path string, block_no int, kind string, level int, ordered boolean, text string, error string"
_SLIDES = "path string, slide_no int, kind string, text string, error string"
_SHAPES = "path string, page_no int, kind string, x_mm double, y_mm double, width_mm double, height_mm double, text string, error string"
_MEMBERS = "path string, name string, compressed long, size long, offset long, crc long, error string"


def _reader(files: DataFrame, schema: str, rows: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """One row of output for each tuple; a document that fails gives one row with its error."""
    width = len(schema.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}[c.split()[1]] for c in schema.split(", ")]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                try:
                    for row in rows(content or b""):
                        out.append((path, *row, None))
                except (EngineError, zipfile.BadZipFile, KeyError, ValueError, ET.ParseError, IndexError, NotImplementedError) as e:
                    out.append((path, *[None] * (width - 2), f"{type(e).__name__}: {e}"[:300]))
                columns = list(zip(*out, strict=True)) if out else [()] * width
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_cells(files: DataFrame) -> DataFrame:
    return _reader(files, _CELLS, lambda data: cells_of(data, sniff(data)))


_TABLES = "path string, table_name string, row_no long, fields map<string,string>, error string"


def read_tables(files: DataFrame, name: str = "data") -> DataFrame:
    """Rows of every table of databases and CSV files: path, table_name, row_no, fields (by column), error."""
    def rows(data: bytes) -> Iterator[tuple]:
        for table, columns, found in tables_of(data, sniff(data), name):
            for k, row in enumerate(found):
                yield table, k, [(c, v) for c, v in dict(zip(columns, row, strict=False)).items()]

    return _reader(files, _TABLES, rows)


_CHARTS = "path string, chart string, series_no int, series string, kind string, dated boolean, pt_idx int, category string, y double, error string"


def read_charts(files: DataFrame) -> DataFrame:
    return _reader(files, _CHARTS, pptx_charts)


def read_entry(files: DataFrame, name: str) -> DataFrame:
    """path, content and error of one member of every archive."""
    return _reader(files, "path string, content binary, error string", lambda data: iter([(zip_entry(data, name),)]))


def read_blocks(files: DataFrame) -> DataFrame:
    return _reader(files, _BLOCKS, lambda data: ((k, *b) for k, b in enumerate(blocks_of(data, sniff(data) or "txt"))))


def read_slides(files: DataFrame) -> DataFrame:
    def rows(data: bytes) -> Iterator[tuple]:
        kind = sniff(data)
        if kind == "pptx":
            yield from pptx_elements(data)
        elif kind == "odp":
            yield from odp_elements(data)
        elif kind is None or FAMILIES.get(kind) not in ("text", "spreadsheet"):
            raise Unsupported(f"no presentation: {kind}")
        else:
            for slide, what, text in markup.outline_slides(data.decode("utf-8", "replace")):
                yield slide, what, text

    return _reader(files, _SLIDES, rows)


def read_shapes(files: DataFrame) -> DataFrame:
    return _reader(files, _SHAPES, lambda data: (odg_elements if sniff(data) == "odg" else svg_elements)(data))


def read_members(files: DataFrame) -> DataFrame:
    return _reader(files, _MEMBERS, lambda data: iter(zip_entries(data)))


def sniffed(files: DataFrame) -> DataFrame:
    """path, format and family of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [sniff(data) if data is not None else None for data in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array([FAMILIES.get(k) for k in kinds], pa.string())], names=["path", "format", "family"])

    return files.select("path", "content").mapInArrow(run, "path string, format string, family string")
