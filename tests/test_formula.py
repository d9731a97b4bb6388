import math

import pytest

from quillgrid.operators.formula import SHEET, WORKBOOK, Compiler, Evaluator, Value, aggregate, display_number, number, parse, round_half_away, shift
from quillgrid.session import EvalError, ParseError, Unsupported

GRID = {("S", 0, c): Value("text", t) for c, t in enumerate("ABC")} | {("S", r + 1, c): number(x) for r, row in enumerate([(10, 20, 30), (5, 15, 25), (1, 2, 3)]) for c, x in enumerate(row)}
GOLDEN = {
    "=SUM(A2:A4)": 16.0, "=AVERAGE(B2:B4)": 37 / 3, "=MIN(A2:A4)": 1.0, "=MAX(C2:C4)": 30.0, "=COUNT(A2:A4)": 3.0, '=IF(A2>3,"big","small")': "big", '=CONCAT("foo","bar")': "foobar", "=A2*B2": 200.0,
    "=AND(TRUE,TRUE)": True, "=OR(FALSE,TRUE)": True, "=NOT(FALSE)": True, "=ABS(-42)": 42.0, "=ROUND(3.14159,2)": 3.14, '=LEN("hello")': 5.0, "=A2+B2": 30.0, "=A2^2": 100.0, "=-2^2": 4.0, "=2^3^2": 64.0, "=SUM(A1:A4)": 16.0, "=1=1=TRUE": True, '="a"<"b"': True, "=AVG(A2:B2)": 15.0, "=IF(FALSE,1)": None, '=1&"x"&TRUE': "1xtrue",
}


def sheet(formula):
    return Evaluator(GRID, SHEET).evaluate(formula, "S").value


def book(formula, cells=None):
    return Evaluator(cells if cells is not None else GRID, WORKBOOK).evaluate(formula, "S")


@pytest.mark.parametrize("formula", GOLDEN)
def test_sheet(formula):
    assert sheet(formula) == GOLDEN[formula]


@pytest.mark.parametrize("formula", ["=1/0", '="x"+1', "=MIN(Z1:Z2)", "=A1:A2", "=NOT()", "=ROUND()"])
def test_sheet_errors(formula):
    with pytest.raises(EvalError):
        sheet(formula)


def test_refused():
    for bad in ("=1+", "=(1", "=foo", '="x', "=1e5", "=A1:"):
        with pytest.raises((ParseError, EvalError)):
            sheet(bad)
    with pytest.raises(Unsupported):
        sheet("=VLOOKUP(1)")


def test_workbook():
    assert book("=1/0") == Value("error", "#DIV/0!")
    assert book("=AVERAGE(Z1:Z3)") == Value("error", "#DIV/0!")
    assert book("=MIN(A2:A9)").value == 0.0  # blanks count
    assert book('=LEFT("abc")').value == "" and book('=RIGHT("abc",2)').value == "bc" and book('=LEFT("abc","x")').value == "a"
    assert book('=UPPER("aé")').value == "Aé" and book('=TRIM(" x  y ")').value == "x  y"
    assert book("=word").value == "word" and book('="a""b"').value == 'a"b'
    assert book("=0.1+0.2=0.3").value is True and book('=1="1"').value is True
    assert book("=SUM(A:A)").value == 16.0 and book("=SUM(2:2)").value == 60.0 and book("=A2:B3").value == 10.0
    assert book("=COUNT(A1:A4)").value == 3.0 and book("=COUNTA(A1:A4)").value == 4.0
    assert book("=INT(-1.5)").value == -2.0 and book("=POWER(2,10)").value == 1024.0 and book("=ROUND(-2.5)").value == -3.0


def test_cells():
    cells = {("Main", 0, 0): ("formula", "Data!A1+1"), ("Data", 0, 0): number(41), ("Main", 1, 0): ("formula", "NOPE(1)"), ("Main", 2, 0): ("formula", "'Data'!$A$1&\"x\""), ("Main", 3, 0): ("formula", "Gone!B9"), ("Main", 8, 1): number(9)}
    ev = Evaluator(cells)
    assert ev.cell("Main", 0, 0) == number(42) and ev.cell("Main", 1, 0) == Value("error", "#VALUE!") and ev.cell("Main", 2, 0).value == "41x"
    assert ev.cell("Main", 3, 0) == number(9)  # an unknown sheet is the own one


def test_cycles_do_not_depend_on_the_start():
    cells = {("S", 0, 0): ("formula", "B1+1"), ("S", 0, 1): ("formula", "A1"), ("S", 0, 2): ("formula", "A1+1"), ("S", 0, 3): ("formula", "D1")}
    for start in range(4):
        ev = Evaluator(dict(cells))
        ev.cell("S", 0, start)
        assert [ev.cell("S", 0, c).value for c in range(4)] == ["#CYCLE!", "#CYCLE!", "#VALUE!", "#CYCLE!"]
    with pytest.raises(EvalError):
        Evaluator(dict(cells), SHEET).cell("S", 0, 0)


def test_long_chain_and_diamonds():
    chain = {("S", r, 0): ("formula", f"A{r}+A{r}") for r in range(1, 60)} | {("S", 0, 0): number(1)}
    assert Evaluator(chain).cell("S", 59, 0) == number(2.0**59)
    deep = {("S", r, 0): ("formula", f"A{r}+1") for r in range(1, 5000)} | {("S", 0, 0): number(1)}
    assert Evaluator(deep).cell("S", 4999, 0) == number(5000)


def test_shift():
    assert shift("SUM(Sheet2!A:A)+Sheet2!B1", 4, 2) == "SUM(Sheet2!C:C)+Sheet2!D5"
    assert shift('$A$1+A$1+$A1&"A1"', 1, 1) == '$A$1+B$1+$A2&"A1"'
    assert shift("B2", -5, -5) == "A1"


def test_numbers():
    assert [display_number(x) for x in (1.0, -0.0, 1e10, 1e21, 1e-7, 0.1, math.inf, math.nan)] == ["1", "-0", "10000000000", "1000000000000000000000", "0.0000001", "0.1", "inf", "NaN"]
    assert round_half_away(2.5, 0) == 3.0 and round_half_away(-2.5, 0) == -3.0 and round_half_away(1234.0, -2) == 1200.0 and round_half_away(1.005, 2) == 1.0
    assert parse("=1+2*3")[1] == "+"


def test_compiled_equals_evaluated(spark):
    from pyspark.sql import functions as F

    rows = [(1.0, -2.5, "x", True), (0.0, 3.0, "12", False), (7.25, None, None, None), (-4.0, 0.0, "", True)]
    df = spark.createDataFrame(rows, "a double, b double, c string, d boolean")
    columns = [("a", "number"), ("b", "number"), ("c", "text"), ("d", "bool")]
    formulas = ["=A1+B1", "=A1&C1", "=IF(A1>0,B1,A1)", "=LEN(C1)", "=ROUND(B1,0)", "=SUM(A1:B1)", "=COUNT(A1:B1)", "=MAX(A1:B1)", "=OR(D1,A1>5)", "=NOT(D1)", "=A1<>B1", "=ABS(A1-B1)", "=COUNTA(A1:D1)", "=UPPER(C1)", "=INT(B1)"]
    for mode in (SHEET, WORKBOOK):
        for f in formulas:
            if mode == SHEET and f.split("(")[0] in ("=COUNTA", "=UPPER", "=INT"):
                continue
            got = [r[0] for r in df.select(Compiler(columns, mode).column(f)).collect()]
            for row, value in zip(rows, got, strict=True):
                cells = {("S", 0, k): number(v) if isinstance(v, float) else Value("bool", v) if isinstance(v, bool) else Value("text", v) for k, v in enumerate(row) if v is not None}
                want = Evaluator(cells, mode).evaluate(f, "S").value
                assert value == want or (want is None and value in (None, "")) or (value is None and want in ("", None)), (mode, f, row, value, want)
    assert df.agg(aggregate("SUM", F.col("c"), "text", WORKBOOK)).first()[0] == 12.0
    assert df.limit(0).agg(aggregate("AVERAGE", F.col("a"), "number"), aggregate("SUM", F.col("a"), "number"), aggregate("AND", F.col("d"), "bool"), aggregate("MIN", F.col("a"), "number", WORKBOOK)).first()[0:4] == (None, 0.0, True, 0.0)
