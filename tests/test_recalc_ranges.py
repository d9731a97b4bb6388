"""Wide ranges are folded by runs of rows: the same values as cell by cell, and no plan with a row for each cell of each range."""

import random

from quillgrid.operators import recalc
from quillgrid.operators.formula import BLANK, Evaluator, Value

SCHEMA = "doc_key string, sheet string, row_no int, col_no int, kind string, value string, num double, flag boolean"


def test_runs_cover_rows():
    rng = random.Random(1)
    for _ in range(300):
        first = rng.randrange(0, 70_000)
        last = first + rng.choice([0, 3, 40, 2_000, 90_000])
        got = []
        pieces = recalc.runs(first, last)
        for level, n in pieces:
            got += range(n << level, (n + 1) << level)
        assert sorted(got) == list(range(first, last + 1)) and len(pieces) < 250


def sheet(doc: str) -> list[tuple]:
    rng = random.Random(len(doc))
    rows = []
    for r in range(1500):
        kind = rng.choice(["number"] * 6 + ["text", "numeric", "bool", "blank", "none"])
        if kind == "number":
            rows.append((doc, "S", r, 0, "number", None, float(rng.randrange(-50, 50)), None))
        elif kind in ("text", "numeric"):
            rows.append((doc, "S", r, 0, "text", "word" if kind == "text" else rng.choice([" 7 ", "8.5", ""]), None, None))
        elif kind == "bool":
            rows.append((doc, "S", r, 0, "bool", None, None, rng.random() < 0.5))
        elif kind == "blank":
            rows.append((doc, "S", r, 0, "empty", None, None, None))
        rows.append((doc, "S", r, 1, "number", None, float(r % 9 + 1), None))
    rows.append((doc, "S", 700, 3, "error", "#REF!", None, None))
    formulas = ["SUM(A:A)", "AVERAGE(A1:A1500)", "MIN(A3:A1490)", "MAX(A:A,99)", "COUNT(A:B)", "COUNTA(A2:A1300)", "AND(B:B)", "AND(A:A)", "OR(A:A)", "MIN(B:B)", "MIN(B1:B4000)", "SUM(D:D)", "COUNT(D:D)", "SUM(s!B:B)+SUM(B1:B3)", "IF(SUM(B:B)>5,COUNT(A:A),0)", "CONCAT(B1:B3)", "SUM(1:2)", "SUM(E1:E600)", "SUM(H:H)", "SUM(Nowhere!B:B)"]
    rows += [(doc, "S", k, 5, "formula", f, None, None) for k, f in enumerate(formulas)]
    # a column of formulas over wide ranges, one fold over them, and a cycle through a wide range
    rows += [(doc, "S", r, 4, "formula", f"SUM(B1:B{300 + r})", None, None) for r in range(0, 400, 50)]
    rows += [(doc, "S", 3, 6, "formula", "SUM(G:G)", None, None), (doc, "S", 4, 6, "formula", "1+1", None, None), (doc, "S", 5, 7, "formula", "I9", None, None), (doc, "S", 8, 8, "formula", "SUM(H1:H900)", None, None)]
    return rows


def test_folded_ranges_equal_cells(spark):
    rows = sheet("d") + sheet("longer")
    docs: dict = {}
    for d, s, r, c, kind, value, num, flag in rows:
        docs.setdefault(d, {})[s, r, c] = ("formula", value) if kind == "formula" else recalc._value(kind, value, num, flag)
    want = {(d, *a): Evaluator(cells).cell(*a) for d, cells in docs.items() for a, v in cells.items() if not isinstance(v, Value)}
    got = {tuple(r)[:4]: Value(r.kind, {"number": r.num, "text": r.text, "bool": r.flag, "error": r.error}.get(r.kind)) for r in recalc.evaluate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        found = got[key]
        if value.kind == "number":
            assert found.kind == "number" and abs(found.value - value.value) <= 1e-9 * max(1.0, abs(value.value)), (key, found, value)
        else:
            assert found == value or {found.kind, value.kind} <= {"blank"} or (value == BLANK and found == BLANK), (key, found, value)


def test_report(spark):
    rows = [("a", "S", 0, 0, "formula", "1/0", None, None), ("a", "S", 1, 0, "formula", "1+1", None, None), ("b", "S", 0, 0, "formula", "2", None, None), ("c", "S", 0, 0, "number", None, 1.0, None)]
    got = sorted(tuple(r) for r in recalc.report(recalc.evaluate(spark.createDataFrame(rows, SCHEMA))).collect())
    assert got == [("a", "error", 2, 1), ("b", "ok", 1, 0)]


def test_many_wide_ranges_stay_small(spark):
    """Ten thousand rows and a hundred whole-column sums: the pieces are some hundreds a range at most, not a row a cell."""
    rows = [("d", "S", r, 0, "number", None, 1.0, None) for r in range(10_000)] + [("d", "S", r, 1, "formula", "SUM(A:A)", None, None) for r in range(100)]
    cells = spark.createDataFrame(rows, SCHEMA)
    got = recalc.evaluate(cells)
    assert {r.num for r in got.collect()} == {10_000.0} and got.count() == 100
    assert sum(len(recalc.runs(0, 9_999)) for _ in range(100)) < 10_000
