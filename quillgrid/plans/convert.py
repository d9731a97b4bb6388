"""Conversion of documents between formats: the source decides the family, the family the targets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgrid.operators.formula import Evaluator, Value, display_number, number
from quillgrid.session import EngineError, Unsupported
from quillgrid.sources import markup, packages, sinks

#: Targets of each family.
TARGETS = {
    "text": ("txt", "md", "html", "docx", "odt", "pdf", "svg"),
    "spreadsheet": ("csv", "md", "html", "xlsx", "ods", "svg", "pdf"),
    "presentation": ("txt", "md", "html", "pptx", "odp", "svg", "pdf"),
    "drawing": ("svg", "txt", "odg", "pdf"),
    "formula": ("mathml", "txt", "odf", "svg", "pdf"),
    "database": ("csv", "html", "odb", "svg", "pdf"),
}


def routes() -> list[tuple[str, str, str]]:
    """(source, family, target) of every supported pair."""
    return [(source, family, to) for source, family in packages.FAMILIES.items() for to in TARGETS[family]]


def route_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(routes(), "source string, family string, target string")


def _cells(data: bytes, kind: str) -> dict[str, list[tuple]]:
    sheets: dict[str, list[tuple]] = {}
    for _, sheet, *cell in packages.cells_of(data, kind):
        sheets.setdefault(sheet, []).append(tuple(cell))
    return sheets


def evaluated(sheets: dict[str, list[tuple]]) -> Evaluator:
    """Evaluator over the sheets' cells; ``cell`` gives any value."""
    cells = {}
    for sheet, rows in sheets.items():
        for r, c, kind, value, num, flag in rows:
            cells[sheet, r, c] = ("formula", value) if kind == "formula" else number(num) if kind == "number" and num is not None else Value("bool", flag) if kind == "bool" else Value(kind, value)
    return Evaluator(cells, "workbook", list(sheets))


def recalculated(sheets: dict[str, list[tuple]]) -> dict[str, list[tuple]]:
    """The sheets with the values of formulas brought up to date: numbers as the cell's number, others as a seventh field."""
    ev = evaluated(sheets)

    def fresh(sheet: str, cell: tuple) -> tuple:
        if cell[2] != "formula":
            return cell
        v = ev.cell(sheet, cell[0], cell[1])
        return (*cell[:4], v.value, cell[5]) if v.kind == "number" else (*cell[:4], None, cell[5], v)

    return {sheet: [fresh(sheet, cell) for cell in rows] for sheet, rows in sheets.items()}


def _shown(ev: Evaluator | None, sheet: str, cell: tuple, error: str = "") -> str:
    r, c, kind, value, num, flag = cell[:6]
    if kind == "formula" and ev:
        return ev.to_text(ev.cell(sheet, r, c))
    if kind == "error":
        return error + (value or "")
    return "=" + (value or "") if kind == "formula" else display_number(num) if kind == "number" else str(bool(flag)).lower() if kind == "bool" else value or ""


def _grid(sheet: str, rows: list[tuple], ev: Evaluator | None, error: str = "") -> list[list[str]]:
    if not rows:
        return []
    by = {(x[0], x[1]): _shown(ev, sheet, x, error) for x in rows}
    height, width = max(k[0] for k in by) + 1, max(k[1] for k in by) + 1
    return [[by.get((r, c), "") for c in range(width)] for r in range(height)]


def _csv(grid: list[list[str]]) -> str:
    return "\n".join(",".join(map(sinks.csv_text, row)) for row in grid)


def pdf_bytes(lines: list[str], a_page: int = 54) -> bytes:
    """A plain document: one column of text lines in a standard font, characters beyond it as '?'."""
    pages = [lines[k : k + a_page] for k in range(0, len(lines), a_page)] or [[]]
    objects = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(pages)))}]/Count {len(pages)}>>", "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    for k, page in enumerate(pages):
        escape = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
        content = "BT /F1 11 Tf 14 TL 56 790 Td " + " ".join(f"({escape(t)}) Tj T*" for t in page) + " ET"
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Contents {5 + 2 * k} 0 R/Resources<</Font<</F1 3 0 R>>>>>>")
        objects.append(f"<</Length {len(content.encode('cp1252', 'replace'))}>>stream\n{content}\nendstream")
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects):
        places.append(len(out))
        out += f"{k + 1} 0 obj{body}endobj\n".encode("cp1252", "replace")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer<</Size {len(objects) + 1}/Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def _spans_blocks(blocks: list[tuple]) -> list[dict]:
    out: list[dict] = []
    for kind, level, ordered, text in blocks:
        spans = [{"kind": "text", "text": text, "url": None}]
        if kind == "list":
            if out and out[-1]["kind"] == "list" and out[-1]["ordered"] == bool(ordered):
                out[-1]["items"].append(spans)
            else:
                out.append({"kind": "list", "ordered": bool(ordered), "items": [spans]})
        elif kind == "table":
            row = text.split("\t")
            if out and out[-1]["kind"] == "table" and len(out[-1]["rows"][0]) == len(row):
                out[-1]["rows"].append(row)
            else:
                out.append({"kind": "table", "rows": [row]})
        else:
            out.append({"kind": kind, "level": level, "spans": spans})
    return out


def svg_bytes(shapes: list[tuple]) -> bytes:
    out = []
    for _, kind, x, y, w, h, text in shapes:
        x, y, w, h = (v or 0.0 for v in (x, y, w, h))
        if kind == "rectangle":
            out.append(f'<rect x="{x}mm" y="{y}mm" width="{w}mm" height="{h}mm"/>')
        elif kind == "ellipse":
            out.append(f'<ellipse cx="{x + w / 2}mm" cy="{y + h / 2}mm" rx="{w / 2}mm" ry="{h / 2}mm"/>')
        elif kind == "line":
            out.append(f'<line x1="{x}mm" y1="{y}mm" x2="{x + w}mm" y2="{y + h}mm"/>')
        if text:
            out.append(f'<text x="{x}mm" y="{y}mm">{markup.encode_entities(text)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg">{"".join(out)}</svg>'.encode()


def convert(data: bytes, source: str | None, target: str, title: str = "") -> bytes:
    """The document in another format of its family; ``source`` is sniffed where it is not given."""
    kind = packages.format_hint(source) if source else packages.sniff(data)
    target = packages.format_hint(target)
    family = packages.FAMILIES.get(kind or "")
    if family is None or target not in TARGETS[family]:
        raise Unsupported(f"no conversion from {kind} to {target}")
    if family == "text":
        if kind == "md":
            blocks = markup.markdown_blocks(data.decode("utf-8", "replace"))
            flat = [(b["kind"], b.get("level"), b.get("ordered"), markup.plain(b)) for b in blocks]
        else:
            flat = list(packages.blocks_of(data, kind))
            blocks = _spans_blocks(flat)
        if target == "md":
            return markup.to_markdown(blocks).encode()
        if target == "html":
            return markup.to_html(blocks, title).encode()
        if target in ("docx", "odt"):
            return (sinks.docx_bytes if target == "docx" else sinks.odt_bytes)(flat)
        lines = [b[3] for b in flat if b[0] not in ("rule", "page_break")]
        if target == "txt":
            return "\n\n".join(lines).encode()
        return (pdf_bytes if target == "pdf" else sinks.lines_svg)([x for t in lines for x in [*t.split("\n"), ""]])
    if family == "spreadsheet":
        sheets = _cells(data, kind)
        if target in ("xlsx", "ods"):
            return (sinks.xlsx_bytes if target == "xlsx" else sinks.ods_bytes)(recalculated(sheets))
        ev = evaluated(sheets) if target == "html" else None
        grids = {s: _grid(s, rows, ev, sinks.CSV_ERROR if target == "csv" else "") for s, rows in sheets.items()}
        if target in ("csv", "svg"):
            first = next(iter(grids.values()), [])
            return _csv(first).encode() if target == "csv" else sinks.grid_svg(first)
        if target == "pdf":
            return pdf_bytes([line for s, g in grids.items() for line in [s, *("\t".join(row) for row in g), ""]])
        tables = [{"kind": "table", "rows": g} for g in grids.values() if g]
        return (markup.to_markdown(tables) if target == "md" else markup.to_html(tables, title)).encode() if tables else b"(empty sheet)"
    if family == "presentation":
        rows = list((packages.pptx_elements if kind == "pptx" else packages.odp_elements)(data))
        if target in ("pptx", "odp"):
            return (sinks.pptx_bytes if target == "pptx" else sinks.odp_bytes)(rows)
        blocks, last = [], None
        for slide, what, text in rows:
            if slide != last:
                blocks.append(("heading", 1, None, f"Slide {slide}"))
                last = slide
            if text and what != "image":
                blocks.append(("paragraph", None, None, text))
        if target == "txt":
            return "\n\n".join(b[3] for b in blocks).encode()
        if target in ("svg", "pdf"):
            return (sinks.lines_svg if target == "svg" else pdf_bytes)([x for b in blocks for x in b[3].split("\n")])
        return (markup.to_markdown if target == "md" else markup.to_html)(_spans_blocks(blocks)).encode()
    if family == "drawing":
        shapes = list((packages.odg_elements if kind == "odg" else packages.svg_elements)(data))
        if target in ("svg", "odg"):
            return (svg_bytes if target == "svg" else sinks.odg_bytes)(shapes)
        texts = [s[-1] for s in shapes if s[-1]]
        return "\n".join(texts).encode() if target == "txt" else pdf_bytes([x for t in texts for x in t.split("\n")])
    if family == "formula":
        if kind == "odf":
            tree = markup.parse_mathml(packages.zip_entry(data, "content.xml").decode("utf-8", "replace"))
        else:
            tree = (markup.parse_latex if kind == "latex" else markup.parse_mathml)(data.decode("utf-8", "replace"))
        if target in ("mathml", "odf"):
            body = markup.mathml(tree)
            return sinks.odf_formula_bytes(body) if target == "odf" else f'<math xmlns="http://www.w3.org/1998/Math/MathML">{body}</math>'.encode()
        flat = markup.flat_math(tree)
        return flat.encode() if target == "txt" else (sinks.lines_svg if target == "svg" else pdf_bytes)([flat])
    tables = {n: (cols, rows) for n, cols, rows in packages.odb_tables(data)}
    if target == "odb":
        return sinks.odb_bytes(tables)
    if target == "csv":
        cols, rows = next(iter(tables.values()), ([], []))
        return _csv([cols, *[["" if v is None else v for v in r] for r in rows]]).encode()
    if target in ("svg", "pdf"):
        grids = [[cols, *[[v or "" for v in r] for r in rows]] for cols, rows in tables.values()]
        return sinks.grid_svg(next(iter(grids), [])) if target == "svg" else pdf_bytes([line for n, g in zip(tables, grids, strict=True) for line in [n, *("\t".join(row) for row in g), ""]])
    return markup.to_html([{"kind": "table", "rows": [cols, *[[v or "" for v in r] for r in rows]]} for cols, rows in tables.values()], title).encode()


def convert_files(files: DataFrame, target: str) -> DataFrame:
    """path, format, content and error of every file in the target format; one that fails has its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, contents, errors = [], [], []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = packages.sniff(data or b"")
                named = packages.format_hint((path or "").rpartition(".")[2])
                # markup of formulas is plain text by its bytes: there the file's name tells
                if kind in (None, "txt") and packages.FAMILIES.get(named) == "formula":
                    kind = named
                kinds.append(kind)
                try:
                    contents.append(convert(data or b"", kind, target))
                    errors.append(None)
                except (EngineError, ValueError, KeyError, IndexError, OSError, SyntaxError, RuntimeError) as e:
                    contents.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=["path", "format", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, format string, content binary, error string")
