"""Edits of workbooks held as rows of cells: set a cell, append a row, evaluate one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import recalc
from quillgrid.operators.formula import parse_address
from quillgrid.session import InvalidInput

_SCHEMA = "doc_key string, sheet string, row_no int, col_no int, kind string, value string, num double, flag boolean"


def inferred(text: str, plain: bool = False) -> tuple:
    """kind, value, num and flag of typed-in text; ``plain`` knows numbers and text only."""
    t = text.strip()
    if not t:
        return "empty", None, None, None
    if not plain and t.startswith("="):
        return "formula", t[1:], None, None
    if not plain and t.lower() in ("true", "false"):
        return "bool", None, None, t.lower() == "true"
    try:
        return "number", None, float(t), None
    except ValueError:
        return "text", t, None, None


class Workbooks:
    """Cells of many workbooks with edits on top; each edit is a row, and the last one of a place counts."""

    def __init__(self, cells: DataFrame):
        self.base = cells.select(*(c.split()[0] for c in _SCHEMA.split(", ")))
        self.edits: dict[tuple, tuple] = {}

    def cells(self) -> DataFrame:
        if not self.edits:
            return self.base
        rows = self.base.sparkSession.createDataFrame([(*k, *v) for k, v in self.edits.items()], _SCHEMA)
        places = F.broadcast(rows.select("doc_key", "sheet", "row_no", "col_no"))  # as many as edits were made
        return self.base.join(places, ["doc_key", "sheet", "row_no", "col_no"], "left_anti").unionByName(rows.where(F.col("kind") != "empty"))

    def set_cell(self, doc: str, sheet: str, address: str, text: str) -> None:
        self.edits[(doc, sheet, *parse_address(address))] = inferred(text)

    def append_row(self, doc: str, sheet: str, fields: list[str]) -> int:
        """A row below the sheet's last; numbers and text only. Gives its number."""
        last = self.cells().where((F.col("doc_key") == doc) & (F.col("sheet") == sheet)).agg(F.max("row_no")).first()[0]
        row = 0 if last is None else last + 1
        for col, text in enumerate(fields):
            self.edits[(doc, sheet, row, col)] = inferred(text, plain=True)
        return row

    def evaluate_cell(self, doc: str, sheet: str, address: str):
        row, col = parse_address(address)
        own = self.cells().where(F.col("doc_key") == doc)
        here = own.where((F.col("sheet") == sheet) & (F.col("row_no") == row) & (F.col("col_no") == col)).first()
        if here is None:
            raise InvalidInput(f"no cell {sheet}!{address}")
        if here.kind != "formula":
            return here.num if here.kind == "number" else here.flag if here.kind == "bool" else here.value
        got = recalc.evaluate(own).where((F.col("sheet") == sheet) & (F.col("row_no") == row) & (F.col("col_no") == col)).first()
        return {"number": got.num, "text": got.text, "bool": got.flag, "error": got.error}.get(got.kind)
