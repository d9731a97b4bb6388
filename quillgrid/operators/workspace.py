"""Open documents of a session: handles, commands by kind, recorded macros, listeners, autosave and recovery.

Documents here are edited one at a time on the driver, like the sessions they stand for; what a session
did is a table of events (``Services.event_log``), and queries of a database run as Spark plans.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillgrid.operators import sessionlog
from quillgrid.operators.edits import inferred
from quillgrid.operators.formula import SHEET, Evaluator, Value, number
from quillgrid.plans import convert
from quillgrid.plans.dialect import Database
from quillgrid.session import InvalidInput, Unsupported
from quillgrid.sources import delimited, markup, packages, sinks

#: Of each kind the format read where none is named, the one autosaved, and the name in manifests.
KINDS = {"text": ("txt", "odt", "writer"), "spreadsheet": ("csv", "ods", "calc"), "presentation": ("txt", "odp", "impress"), "drawing": ("txt", "odg", "draw"), "formula": ("latex", "odf", "math"), "database": ("csv", "odb", "base")}
MANIFEST = "recovery.tsv"


@dataclass
class Document:
    """An open document. ``content`` is a list of blocks, elements or shapes, a dict of cells or tables, or a formula's tree."""

    handle: int
    kind: str
    title: str
    content: object
    path: str | None = None
    listeners: list[Callable[[str, object], None]] = field(default_factory=list)


def _loaded(kind: str, data: bytes, form: str) -> object:
    if form != KINDS[kind][0] and packages.FAMILIES.get(form) not in (kind, "text"):
        raise Unsupported(f"{form} is no format of {kind}")
    if kind == "text":
        if form == "md":
            return [(b["kind"], b.get("level"), b.get("ordered"), markup.plain(b)) for b in markup.markdown_blocks(data.decode("utf-8", "replace"))]
        return list(packages.blocks_of(data, form))
    if kind == "spreadsheet":
        return {(r, c): (what, value, num, flag) for k, _, r, c, what, value, num, flag in packages.cells_of(data, form) if k == 0}
    if kind == "presentation":
        return list({"pptx": packages.pptx_elements, "odp": packages.odp_elements}[form](data)) if form in ("pptx", "odp") else markup.outline_slides(data.decode("utf-8", "replace"))
    if kind == "drawing":
        return list((packages.odg_elements if form == "odg" else packages.svg_elements)(data)) if form in ("odg", "svg") else [(1, "text_box", 20.0, 20.0 + 10.0 * k, 170.0, 10.0, t) for k, t in enumerate(data.decode("utf-8", "replace").splitlines()) if t.strip()]
    if kind == "formula":
        if form == "odf":
            return markup.parse_mathml(packages.zip_entry(data, "content.xml").decode("utf-8", "replace"))
        return (markup.parse_mathml if form == "mathml" else markup.parse_latex)(data.decode("utf-8", "replace"))
    return {name: (columns, rows) for name, columns, rows in packages.tables_of(data, form)}


def _bytes(doc: Document, form: str) -> bytes:
    """The document in a format of its family: its own form first, then by the routes of conversion."""
    c = doc.content
    if doc.kind == "text":
        own, data = "odt", sinks.odt_bytes(c)
    elif doc.kind == "spreadsheet":
        own, data = "ods", sinks.ods_bytes({"Sheet1": [(*at, *cell) for at, cell in c.items()]})
    elif doc.kind == "presentation":
        own, data = "odp", sinks.odp_bytes(c)
    elif doc.kind == "drawing":
        own, data = "odg", sinks.odg_bytes(c)
    elif doc.kind == "formula":
        own, data = "odf", sinks.odf_formula_bytes(markup.mathml(c))
    else:
        own, data = "odb", sinks.odb_bytes(c)
    return data if packages.format_hint(form) == own else convert.convert(data, own, form, doc.title)


class Workspace:
    """Registry of open documents. A command's success is told to the document's listeners and to the services' topic."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.services = sessionlog.Services(spark)
        self.documents: dict[int, Document] = {}
        self.macros: dict[str, list[tuple[str, dict]]] = {}
        self.recording: str | None = None
        self.last = 0
        self.commands: dict[tuple[str, str], Callable] = {
            ("text", "InsertText"): self._insert_text, ("text", "AppendHeading"): self._heading, ("text", "AppendTable"): self._table, ("text", "SelectAll"): lambda d, a: True,
            ("text", "Bold"): self._bold, ("text", "GetSelectionText"): lambda d, a: self._plain(d), ("text", "Uppercase"): self._uppercase,
            ("spreadsheet", "SetCell"): self._set_cell, ("spreadsheet", "AppendRow"): self._append_row, ("spreadsheet", "EvaluateCell"): self._evaluate,
            ("presentation", "InsertSlide"): self._slide, ("presentation", "InsertTextBox"): self._text_box, ("presentation", "InsertBullets"): self._bullets, ("presentation", "InsertShape"): self._slide_shape,
            ("drawing", "InsertPage"): self._page, ("drawing", "InsertShape"): self._shape,
            ("formula", "SetFormula"): self._formula, ("formula", "ToMathML"): lambda d, a: markup.mathml(d.content),
            ("database", "CreateTable"): self._create, ("database", "InsertRow"): self._insert_row, ("database", "ExecuteQuery"): self._query,
        }

    # -- registry -------------------------------------------------------------------------------------------

    def new(self, kind: str, title: str) -> int:
        if kind not in KINDS:
            raise InvalidInput(f"no such kind: {kind}")
        empty = {} if kind in ("spreadsheet", "database") else ("row",) if kind == "formula" else []
        return self._add(kind, title, empty)

    def load(self, kind: str, title: str, data: bytes, form: str | None = None, path: str | None = None) -> int:
        """Opens a document from bytes, in the kind's usual format if none is named."""
        if kind not in KINDS:
            raise InvalidInput(f"no such kind: {kind}")
        return self._add(kind, title, _loaded(kind, data, packages.format_hint(form or KINDS[kind][0])), path)

    def _add(self, kind: str, title: str, content: object, path: str | None = None) -> int:
        self.last += 1
        self.documents[self.last] = Document(self.last, kind, title, content, path)
        self.services.publish("workspace", "open")
        return self.last

    def get(self, handle: int) -> Document:
        if handle not in self.documents:
            raise InvalidInput(f"no document {handle}")
        return self.documents[handle]

    def close(self, handle: int) -> None:
        self.get(handle)
        del self.documents[handle]
        self.services.publish("workspace", "close")

    def listen(self, handle: int, listener: Callable[[str, object], None]) -> None:
        self.get(handle).listeners.append(listener)

    def save(self, handle: int, form: str) -> bytes:
        return _bytes(self.get(handle), form)

    # -- commands and macros --------------------------------------------------------------------------------

    def execute(self, handle: int, command: str, **arguments):
        """Runs a command ('.uno:' before its name) on a document; it is recorded if a macro is, and told to listeners."""
        doc = self.get(handle)
        run = self.commands.get((doc.kind, command.removeprefix(".uno:")))
        if run is None or not command.startswith(".uno:"):
            raise Unsupported(f"{doc.kind} command {command}")
        out = run(doc, arguments)
        if self.recording is not None:
            self.macros[self.recording].append((command, dict(arguments)))
        self.services.publish(doc.title, command)
        for listener in doc.listeners:
            listener(command, out)
        return out

    def record(self, name: str) -> None:
        self.recording, self.macros[name] = name, []

    def stop(self) -> list[tuple[str, dict]]:
        """Ends the recording; its commands, none if there was no recording."""
        name, self.recording = self.recording, None
        return self.macros.get(name, []) if name is not None else []

    def replay(self, name: str, handle: int) -> list:
        if name not in self.macros:
            raise InvalidInput(f"macro not found: {name}")
        return [self.execute(handle, command, **arguments) for command, arguments in list(self.macros[name])]

    # -- recovery -------------------------------------------------------------------------------------------

    def autosave(self, folder: str, now: float | None = None) -> list[str]:
        """Writes every open document below ``folder`` and a manifest of six tab-separated fields: kind, title, format, file, original path, seconds."""
        os.makedirs(folder, exist_ok=True)
        clean = lambda t: " ".join((t or "").replace("\t", " ").split("\n")).replace("\r", " ")
        lines, files = [], []
        for doc in self.documents.values():
            form = KINDS[doc.kind][1]
            name = os.path.join(folder, f"{doc.handle}-{''.join(ch if ch.isalnum() else '-' for ch in doc.title.lower()).strip('-')}.{form}")
            with open(name, "wb") as f:
                f.write(self.save(doc.handle, form))
            files.append(name)
            lines.append("\t".join((KINDS[doc.kind][2], clean(doc.title), form, clean(name), clean(doc.path), str(int(now if now is not None else time.time())))))
        with open(os.path.join(folder, MANIFEST), "w", encoding="utf-8") as f:
            f.write("".join(line + "\n" for line in lines))
        return files

    def recover(self, folder: str) -> list[int]:
        """Opens what a manifest lists; lines of other than six fields, unknown kinds and missing files are skipped."""
        path = os.path.join(folder, MANIFEST)
        if not os.path.exists(path):
            return []
        kinds = {names[2]: kind for kind, names in KINDS.items()}
        opened = []
        with open(path, encoding="utf-8") as f:
            for fields in (line.rstrip("\n").split("\t") for line in f):
                if len(fields) != 6 or fields[0] not in kinds or not os.path.exists(fields[3]):
                    continue
                with open(fields[3], "rb") as saved:
                    opened.append(self.load(kinds[fields[0]], f"{fields[1]} (Recovered)", saved.read(), fields[2]))
        return opened

    def report(self) -> DataFrame:
        """The last ten events, newest first: event_id, source, topic."""
        return sessionlog.last_events(self.services.event_log(), ["event_id"])

    # -- text -----------------------------------------------------------------------------------------------

    @staticmethod
    def _plain(doc: Document) -> str:
        return "\n\n".join(b[3] for b in doc.content if b[0] not in ("rule", "page_break"))

    def _insert_text(self, doc: Document, a: dict) -> bool:
        doc.content.append(("paragraph", None, None, a.get("text", "")))
        return True

    def _heading(self, doc: Document, a: dict) -> bool:
        doc.content.append(("heading", min(6, max(1, int(a.get("level", 1)))), None, a.get("text", "")))
        return True

    def _table(self, doc: Document, a: dict) -> bool:
        doc.content += [("table", None, None, "\t".join(c.strip() for c in line.split("|"))) for line in a.get("rows", "").splitlines()]
        return True

    def _bold(self, doc: Document, a: dict) -> bool:
        """Marks paragraphs and headings as bold, in Markdown."""
        doc.content[:] = [(*b[:3], f"**{b[3]}**") if b[0] in ("paragraph", "heading") and b[3] and not b[3].startswith("**") else b for b in doc.content]
        return True

    def _uppercase(self, doc: Document, a: dict) -> str:
        text = self._plain(doc).upper()
        doc.content[:] = [("paragraph", None, None, text)]
        return text

    # -- spreadsheets: the first sheet ----------------------------------------------------------------------

    def _set_cell(self, doc: Document, a: dict) -> bool:
        at, cell = (max(0, int(a.get("row", 0))), max(0, int(a.get("col", 0)))), inferred(a.get("value", ""))
        if cell[0] == "empty":
            doc.content.pop(at, None)
        else:
            doc.content[at] = cell
        return True

    def _append_row(self, doc: Document, a: dict) -> bool:
        row = max((r for r, _ in doc.content), default=-1) + 1
        for col, text in enumerate(a.get("row", "").split(",")):
            cell = inferred(text, plain=True)
            if cell[0] != "empty":
                doc.content[row, col] = cell
        return True

    def _evaluate(self, doc: Document, a: dict):
        at = (max(0, int(a.get("row", 0))), max(0, int(a.get("col", 0))))
        if at not in doc.content:
            raise InvalidInput("cell is empty")
        cells = {("Sheet1", *k): ("formula", value) if kind == "formula" else number(num) if kind == "number" else Value("bool", flag) if kind == "bool" else Value(kind, value) for k, (kind, value, num, flag) in doc.content.items()}
        return Evaluator(cells, SHEET).cell("Sheet1", *at).value

    # -- presentations, drawings ----------------------------------------------------------------------------

    def _slide(self, doc: Document, a: dict) -> int:
        n = max((e[0] for e in doc.content), default=0) + 1
        doc.content.append((n, "title", a.get("title", "Slide")))
        return n

    def _text_box(self, doc: Document, a: dict) -> bool:
        doc.content.append((max(1, int(a.get("slide", 1))), "text_box", a.get("text", "")))
        return True

    def _bullets(self, doc: Document, a: dict) -> bool:
        items = [f"• {t.strip()}" for t in a.get("items", "").split("|") if t.strip()]
        return self._text_box(doc, {"slide": a.get("slide", 1), "text": "\n".join(items)})

    def _slide_shape(self, doc: Document, a: dict) -> bool:
        doc.content.append((max(1, int(a.get("slide", 1))), self._kind(a), ""))
        return True

    @staticmethod
    def _kind(a: dict) -> str:
        kind = a.get("kind", "rect").lower()
        return kind if kind in ("ellipse", "line") else "rectangle"

    def _page(self, doc: Document, a: dict) -> int:
        n = max((e[0] for e in doc.content), default=0) + 1
        doc.content.append((n, "text_box", 20.0, 10.0, 170.0, 10.0, a.get("name", f"Page{n}")))
        return n

    def _shape(self, doc: Document, a: dict) -> bool:
        page = max(1, int(a.get("page", 1)))
        x, y, w, h = (float(a.get(k, d)) for k, d in (("x", 20), ("y", 40), ("width", 60), ("height", 40)))
        doc.content.append((page, self._kind(a), x, y, w, h, ""))
        if a.get("text") is not None:
            doc.content.append((page, "text_box", x + 2, y + 2, w - 4, 10.0, a["text"]))
        return True

    # -- formulas, databases --------------------------------------------------------------------------------

    def _formula(self, doc: Document, a: dict) -> bool:
        doc.content = markup.parse_latex(a.get("formula", ""))
        return True

    def _create(self, doc: Document, a: dict) -> str:
        name = a.get("name", "data")
        doc.content[name] = ([c.strip() for c in a.get("columns", "").split(",") if c.strip()], [])
        return name

    def _insert_row(self, doc: Document, a: dict) -> bool:
        columns, rows = self._table_of(doc, a.get("table", "data"))
        fields = [t.strip() or None for t in a.get("row", "").split(",")]
        rows.append([*fields, *[None] * len(columns)][: len(columns)])
        return True

    @staticmethod
    def _table_of(doc: Document, name: str) -> tuple[list[str], list[list]]:
        if name not in doc.content:
            raise InvalidInput(f"table not found: {name}")
        return doc.content[name]

    def _query(self, doc: Document, a: dict) -> int:
        """Number of rows of a SELECT over the document's tables, their columns typed by what they hold."""
        db = Database(self.spark)
        for name, (columns, rows) in doc.content.items():
            table = self.spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` string" for c in columns))
            db.add_table(name, delimited.typed(table))
        return db.query(a.get("sql", "")).count()
