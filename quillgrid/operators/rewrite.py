"""Recalculation inside the existing workbook: cached values are replaced, everything else is kept byte for byte.

Only the values and types of formula cells in the sheet parts change. The calculation chain is dropped with its
content type and relationship, and the workbook is marked as calculated.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.operators.formula import Value, display_number, parse_address
from quillgrid.plans.convert import evaluated
from quillgrid.session import EngineError
from quillgrid.sources.markup import encode_entities
from quillgrid.sources.packages import attr, descendants, parse_xml, relationships, xlsx_cells

CHAIN = "xl/calcChain.xml"
_ROW = re.compile(r"<((?:\w+:)?)row\b([^>]*?)(?:/>|>(.*?)</\1row\s*>)", re.DOTALL)
_CELL = re.compile(r"<((?:\w+:)?)c\b([^>]*?)(?:/>|>(.*?)</\1c\s*>)", re.DOTALL)
_FORMULA = re.compile(r"<(?:\w+:)?f\b[^>]*?(?:/>|>.*?</(?:\w+:)?f\s*>)", re.DOTALL)
_VALUE = re.compile(r"<(?:\w+:)?v\b[^>]*?(?:/>|>.*?</(?:\w+:)?v\s*>)|<(?:\w+:)?is\b.*?</(?:\w+:)?is\s*>", re.DOTALL)
_TYPE = re.compile(r"""\s+t\s*=\s*("[^"]*"|'[^']*')""")
_AT = re.compile(r"""\br\s*=\s*["']([^"']*)["']""")


def _cached(value: Value) -> tuple[str, str]:
    """Type attribute and text of a value."""
    if value.kind == "number":
        return "", display_number(value.value)
    if value.kind == "bool":
        return ' t="b"', str(int(bool(value.value)))
    if value.kind == "error":
        return ' t="e"', encode_entities(str(value.value))
    return ' t="str"', encode_entities(str(value.value)) if value.kind == "text" else ""


def _patched(xml: str, values: dict[tuple[int, int], Value]) -> str:
    """The sheet part with the values of its formula cells (row, column)."""
    row, col = -1, 0

    def cell(m: re.Match) -> str:
        nonlocal row, col
        prefix, attributes, inner = m.groups()
        at = _AT.search(attributes)
        if at:
            row, col = parse_address(at.group(1))
        here = (row, col)
        col += 1
        formula = _FORMULA.search(inner or "")
        if not formula or here not in values:
            return m.group()
        what, text = _cached(values[here])
        kept = _VALUE.sub("", inner)
        end = _FORMULA.search(kept).end()
        return f"<{prefix}c{_TYPE.sub('', attributes).rstrip()}{what}>{kept[:end]}<{prefix}v>{text}</{prefix}v>{kept[end:]}</{prefix}c>"

    def line(m: re.Match) -> str:
        nonlocal row, col
        at = _AT.search(m.group(2))
        row, col = (int(at.group(1)) - 1 if at and at.group(1).isdigit() else row + 1), 0
        here, inner = row, m.group(3)
        if inner is None:
            return m.group()
        start = m.start(3) - m.start()
        out = m.group()[:start] + _CELL.sub(cell, inner) + m.group()[start + len(inner) :]
        row = here
        return out

    return _ROW.sub(line, xml)


def _without(xml: str, element: str, marks: tuple[str, ...]) -> str:
    """The part without the elements of a name that hold one of the marks."""
    return re.sub(rf"<(?:\w+:)?{element}\b[^>]*?(?:/>|>.*?</(?:\w+:)?{element}\s*>)", lambda m: "" if any(k in m.group() for k in marks) else m.group(), xml, flags=re.DOTALL)


def _marked(xml: str) -> str:
    """The workbook part, said to be calculated."""
    found = re.search(r"<((?:\w+:)?)calcPr\b([^>]*?)(/?)>", xml)
    if found:
        kept = re.sub(r"""\s+(?:calcCompleted|fullCalcOnLoad|calcMode)\s*=\s*("[^"]*"|'[^']*')""", "", found.group(2)).rstrip()
        return f'{xml[: found.start()]}<{found.group(1)}calcPr{kept} calcCompleted="1" fullCalcOnLoad="0"{found.group(3)}>{xml[found.end() :]}'
    return re.sub(r"</((?:\w+:)?)workbook\s*>", r'<\1calcPr calcCompleted="1" fullCalcOnLoad="0"/></\1workbook>', xml, count=1)


def recalculate(data: bytes) -> bytes:
    """The workbook with the cached values of all formulas brought up to date."""
    sheets: dict[str, list[tuple]] = {}
    for _, sheet, *cell in xlsx_cells(data):
        sheets.setdefault(sheet, []).append(tuple(cell))
    ev = evaluated(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        rels = relationships(z, "xl/workbook.xml")
        parts = {rels.get(attr(s, "id", ""), f"xl/worksheets/sheet{k + 1}.xml"): attr(s, "name", f"Sheet{k + 1}") for k, s in enumerate(descendants(parse_xml(z.read("xl/workbook.xml")), "sheet"))}
        for info in z.infolist():
            name, body = info.filename, z.read(info)
            if name == CHAIN:
                continue
            if name == "[Content_Types].xml":
                body = _without(body.decode(), "Override", ("/" + CHAIN,)).encode()
            elif name == "xl/_rels/workbook.xml.rels":
                body = _without(body.decode(), "Relationship", ("calcChain",)).encode()
            elif name == "xl/workbook.xml":
                body = _marked(body.decode()).encode()
            elif name in parts:
                sheet = parts[name]
                body = _patched(body.decode(), {(r, c): ev.cell(sheet, r, c) for r, c, kind, *_ in sheets.get(sheet, []) if kind == "formula"}).encode()
            made.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rewrite_files(files: DataFrame) -> DataFrame:
    """path, content and error of every workbook of ``files`` (path, content), recalculated; one that fails has its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors = [], []
            for data in batch.column(1).to_pylist():
                try:
                    contents.append(recalculate(data or b""))
                    errors.append(None)
                except (EngineError, ValueError, KeyError, OSError, SyntaxError, zipfile.BadZipFile) as e:
                    contents.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, error string")
