"""Batch evaluation of workbooks held as rows of cells.

Cells are rows (doc_key, sheet, row_no, col_no, kind, value, num, flag). A workbook may hold any
share of all rows, so formulas are not evaluated workbook by workbook: every formula's references
are joined with the cells they name, and a formula whose cells are all known is evaluated from them
alone. Single cells and ranges up to SMALL cells are named cell by cell. A larger range in a fold (SUM,
MIN and the like) is never taken apart: its columns are cut into runs of 1, 32, 1024 and 32768 rows, of
which it needs some two hundred at most, and every column so used is folded once over these runs.

Formulas that need other formulas follow in the next round, until none is left or a round evaluates less
than a tenth of them. After that, and after ``rounds`` rounds, what is left (long chains, cycles) is evaluated by workbook from the
left-over formulas and the values they need, a small rest of the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.numbers import parse_float
from quillgrid.functions.texts import trim_blank
from quillgrid.operators.formula import BLANK, Block, Evaluator, Value, foldable, number, parse, references
from quillgrid.session import EngineError, cut

_KEY = ["doc_key", "sheet", "row_no", "col_no"]


def sheet_name(sheet: str = "sheet") -> Column:
    """Name of a cell's sheet, by its number where it has none."""
    return F.coalesce(sheet, F.concat(F.lit("#"), F.col("sheet_no").cast("string")))


def latest(cells: DataFrame) -> DataFrame:
    """One cell for each place: of cells delivered twice the one loaded last (then of the greatest id)."""
    newest = cells.groupBy("doc_key", "sheet_no", "row_no", "col_no").agg(F.max_by(F.struct("sheet", "kind", "value", "num", "flag"), F.struct("loaded_at", "cell_id")).alias("c"))
    return newest.select("doc_key", sheet_name("c.sheet").alias("sheet"), "row_no", "col_no", "c.kind", "c.value", "c.num", "c.flag")


def _value(kind: str | None, value: str | None, num: float | None, flag: bool | None) -> Value:
    if kind == "number" and num is not None:
        return number(num)
    if kind == "text" and value is not None:
        return Value("text", value)
    if kind == "bool" and flag is not None:
        return Value("bool", flag)
    if kind == "error":
        return Value("error", value or "#VALUE!")
    return BLANK


#: Cells up to which a range is named cell by cell.
SMALL = 256
#: Rows of the runs that columns are folded over, as powers of two.
LEVELS = (0, 5, 10, 15)


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The references of each formula as rectangles, and whether they may be folded; a formula that cannot be parsed has none."""
    for batch in batches:
        out: list[tuple] = []
        for doc, sheet, row, col, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                expr = parse(source or "", "workbook")
            except EngineError:
                continue
            folds = foldable(expr)
            for e in dict.fromkeys(references(expr)):
                target = e[1] if e[1] is not None else sheet
                r1, c1, r2, c2 = (e[2], e[3], e[2], e[3]) if e[0] == "ref" else e[2:]
                out.append((doc, sheet, row, col, target, r1, c1, r2, c2, e in folds))
        names = ["doc_key", "sheet", "row_no", "col_no", "target", "r1", "c1", "r2", "c2", "fold"]
        kinds = [pa.string(), pa.string(), *([pa.int32()] * 2), pa.string(), *([pa.int32()] * 4), pa.bool_()]
        columns = list(zip(*out, strict=True)) if out else [()] * 10
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_NEEDS = "doc_key string, sheet string, row_no int, col_no int, target string, r1 int, c1 int, r2 int, c2 int, fold boolean"


def runs(first: int, last: int) -> list[tuple[int, int]]:
    """(level, number) of the runs that together are the rows from ``first`` to ``last``."""
    out, low, high = [], first, last + 1
    for k, level in enumerate(LEVELS):
        step = 1 << (LEVELS[k + 1] - level) if k + 1 < len(LEVELS) else 0
        if not step or -(-low // step) >= high // step:
            out += [(level, n) for n in range(low, high)]
            break
        up, down = -(-low // step), high // step
        out += [(level, n) for n in range(low, up * step)] + [(level, n) for n in range(down * step, high)]
        low, high = up, down
    return out


def _to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row: a range (number, first and last row), to rows of runs."""
    for batch in batches:
        out = [(rect, level, n) for rect, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True) for level, n in runs(first, last)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["rect", "level", "run"])


_RESULT = "doc_key string, sheet string, row_no int, col_no int, formula string, kind string, num double, text string, flag boolean, error string"


def _answer(key: tuple, source: str, v: Value) -> tuple:
    return (*key, source, v.kind, v.value if v.kind == "number" else None, v.value if v.kind == "text" else None, v.value if v.kind == "bool" else None, v.value if v.kind == "error" else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string()]
    names = ["doc_key", "sheet", "row_no", "col_no", "formula", "kind", "num", "text", "flag", "error"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_BLOCK = ("filled", "numbers", "total", "errors", "low", "high", "true")


def _block(b: dict, inside: tuple = ()) -> tuple[tuple, Block]:
    """Key and folded values of a range out of its struct; cells not yet evaluated are left to ``inside``."""
    return (b["target"], b["o1"], b["p1"], b["o2"], b["p2"]), Block(b["size"] - (b["open"] or 0), *(b[name] if name in ("low", "high") else b[name] or 0 for name in _BLOCK), inside)


def _evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row: a formula with all it needs, cells and folded ranges; one that waits for others has a null kind."""
    for batch in batches:
        out = []
        for doc, sheet, row, col, source, waits, known, blocks, rows, cols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if waits or any(b["open"] for b in blocks or []):
                out.append((doc, sheet, row, col, source, *[None] * 5))
                continue
            cells = {(k["sheet"], k["row_no"], k["col_no"]): _value(k["kind"], k["value"], k["num"], k["flag"]) for k in known or []}
            folded = dict(_block(b) for b in blocks or [])
            ev = Evaluator(cells, "workbook", [sheet, *dict.fromkeys([*(k[0] for k in cells), *(k[0] for k in folded)])], folded)
            for target in {sheet, *(k[0] for k in cells)}:
                a, b = ev.extent.get(target, (0, 0))
                ev.extent[target] = (max(a, rows or 0), max(b, cols or 0))
            at = (sheet, row, col)
            ev.cells = dict(cells) | {at: ("formula", source)}
            out.append(_answer((doc, sheet, row, col), source, ev.cell(*at)))
        yield _batch(out)


def _columns(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_key", F.col("target").alias("sheet"), F.col("col").alias("col_no")).distinct()


def _folded(values: DataFrame, open_: DataFrame, pieces: DataFrame, wide: DataFrame) -> DataFrame:
    """Of each formula with wide ranges, those ranges folded over the values known so far, and the formulas open in them.

    ``pieces`` has the runs of every range by column; a column is folded over its runs once for all ranges.
    """
    text = F.when(F.col("kind") == "text", F.col("value"))
    loose = parse_float(trim_blank(text))
    truth = F.col("flag").cast("double")
    is_number = (F.col("kind") == "number") & F.col("num").isNotNull()
    seen = values.select(
        "doc_key", "sheet", "row_no", "col_no",
        F.when(is_number | (text.isNotNull()) | ((F.col("kind") == "bool") & truth.isNotNull()) | (F.col("kind") == "error"), 1).alias("filled"),
        F.when(is_number, 1).alias("numbers"),
        F.when(is_number, F.col("num")).when(F.col("kind") == "bool", truth).otherwise(parse_float(text)).alias("total"),
        F.when(F.col("kind") == "error", 1).alias("errors"),
        F.when(is_number, F.col("num")).when(F.col("kind") == "bool", truth).otherwise(loose).alias("x"),
        F.when(is_number, (F.col("num") != 0).cast("int")).when(F.col("kind") == "bool", F.col("flag").cast("int")).when(text != "", 1).alias("true"),
        F.lit(None).cast("int").alias("open"),
    )
    none = [F.lit(None).cast(t).alias(n) for n, t in (("filled", "int"), ("numbers", "int"), ("total", "double"), ("errors", "int"), ("x", "double"), ("true", "int"))]
    both = seen.unionByName(open_.select("doc_key", "sheet", "row_no", "col_no", *none, F.lit(1).alias("open"))).join(_columns(pieces), ["doc_key", "sheet", "col_no"], "left_semi")
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("row_no", k).alias("run")) for k in LEVELS)))
    sums = lambda: [F.sum(n).alias(n) for n in ("filled", "numbers", "total", "errors", "true", "open")]
    by_run = both.withColumn("l", level).groupBy("doc_key", F.col("sheet").alias("target"), F.col("col_no").alias("col"), "l.level", "l.run").agg(*sums(), F.min("x").alias("low"), F.max("x").alias("high"))
    by_range = pieces.join(by_run, ["doc_key", "target", "col", "level", "run"]).groupBy("rect").agg(*sums(), F.min("low").alias("low"), F.max("high").alias("high"))
    names = ["target", "o1", "p1", "o2", "p2", "size", "open", *_BLOCK]
    return wide.join(by_range, "rect", "left").groupBy(*_KEY).agg(F.collect_list(F.struct(*names)).alias("blocks"))


def evaluate(cells: DataFrame, rounds: int = 3) -> DataFrame:
    """Value of every formula cell: doc_key, sheet, row_no, col_no, formula, kind, num, text, flag, error.

    ``cells`` has one row a place (see ``latest``), its extra columns are ignored. A missing cell is
    blank, an unknown sheet is the formula's own; cells of a cycle are '#CYCLE!'. Formulas that cannot
    be parsed or evaluated are '#VALUE!'. A null formula is blank text and so '#VALUE!'.
    """
    base = cells.select("doc_key", "sheet", F.col("row_no").cast("int").alias("row_no"), F.col("col_no").cast("int").alias("col_no"), "kind", "value", F.col("num").cast("double").alias("num"), "flag")
    base = cut(base)  # read several times: written once, whatever made it
    sheets = base.groupBy("doc_key", "sheet").agg(F.max("row_no").alias("rows"), F.max("col_no").alias("cols"))
    formulas = base.where(F.col("kind") == "formula").select(*_KEY, F.coalesce("value", F.lit("")).alias("value"))
    known_sheets = sheets.select(F.col("doc_key").alias("k_doc"), F.col("sheet").alias("k_sheet"), F.lower("sheet").alias("k_low"), F.col("rows").alias("k_rows"), F.col("cols").alias("k_cols"))
    rects = formulas.mapInArrow(_needs, _NEEDS).join(known_sheets, (F.col("doc_key") == F.col("k_doc")) & (F.lower("target") == F.col("k_low")), "left").join(sheets, ["doc_key", "sheet"], "left")
    rects = rects.select(
        *_KEY, F.coalesce("k_sheet", "sheet").alias("target"), "fold", F.col("r1").alias("o1"), F.col("c1").alias("p1"), F.col("r2").alias("o2"), F.col("c2").alias("p2"),
        F.coalesce("r1", F.lit(0)).alias("r1"), F.greatest(F.coalesce("r2", "k_rows", "rows", F.lit(0)), F.coalesce("r1", F.lit(0))).alias("r2"),
        F.coalesce("c1", F.lit(0)).alias("c1"), F.greatest(F.coalesce("c2", "k_cols", "cols", F.lit(0)), F.coalesce("c1", F.lit(0))).alias("c2"),
    )
    size = (F.col("r2") - F.col("r1") + 1).cast("bigint") * (F.col("c2") - F.col("c1") + 1)
    rects = cut(rects.withColumn("size", size).withColumn("rect", F.monotonically_increasing_id()))
    is_wide = F.col("fold") & (F.col("size") > SMALL)
    wide = rects.where(is_wide)
    pieces = None
    if not wide.isEmpty():
        pieces = cut(wide.select("rect", "r1", "r2").mapInArrow(_to_runs, "rect long, level int, run int").join(wide.select("rect", "doc_key", "target", F.explode(F.sequence("c1", "c2")).alias("col")), "rect"))
    places = rects.where(~is_wide).select(*_KEY, "target", F.explode(F.sequence("r1", "r2")).alias("r"), "c1", "c2").select(*_KEY, "target", "r", F.explode(F.sequence("c1", "c2")).alias("c")).distinct()
    wanted = cut(places)
    known = base.where(F.col("kind") != "formula").select(*_KEY, "kind", "value", "num", "flag")
    used = wanted.select("doc_key", F.col("target").alias("sheet"), F.col("r").alias("row_no"), F.col("c").alias("col_no")).distinct()
    # of the other cells only those that formulas name; read in every round, so written once
    given = cut(known.join(used, _KEY, "left_semi"))
    in_columns = cut(known.join(_columns(pieces), ["doc_key", "sheet", "col_no"], "left_semi")) if pieces is not None else None
    open_, results = cut(formulas.join(sheets, ["doc_key", "sheet"], "left")), None
    waiting = open_.count()

    def valued() -> DataFrame:
        return results.select(*_KEY, "kind", F.coalesce("text", "error").alias("value"), "num", "flag")

    def folded() -> DataFrame:
        return _folded(in_columns if results is None else in_columns.unionByName(valued()), open_, pieces, wide)

    for _ in range(rounds):
        if not waiting:
            break
        values = given if results is None else given.unionByName(valued())
        content = values.select(*(F.col(k).alias(f"v_{k}") for k in _KEY), F.struct("sheet", "row_no", "col_no", "kind", "value", "num", "flag").alias("cell"))
        content = content.unionByName(open_.select(*(F.col(k).alias(f"v_{k}") for k in _KEY), F.lit(None).cast(content.schema["cell"].dataType).alias("cell")))
        need = open_.select(*_KEY).join(wanted, _KEY)
        got = need.join(content, (F.col("doc_key") == F.col("v_doc_key")) & (F.col("target") == F.col("v_sheet")) & (F.col("r") == F.col("v_row_no")) & (F.col("c") == F.col("v_col_no")))
        got = got.groupBy(*_KEY).agg(F.collect_list("cell").alias("cells"), F.max(F.col("cell").isNull()).alias("waits"))
        rows = open_.join(got, _KEY, "left")
        blocks = F.lit(None).cast("array<struct<target:string>>").alias("blocks")
        if pieces is not None:
            rows, blocks = rows.join(folded(), _KEY, "left"), "blocks"
        step = cut(rows.select(*_KEY, "value", "waits", "cells", blocks, "rows", "cols").mapInArrow(_evaluate, _RESULT))
        done = step.where(F.col("kind").isNotNull())
        left = step.where(F.col("kind").isNull()).select(*_KEY)
        results = done if results is None else results.unionByName(done)
        open_ = open_.join(left, _KEY, "left_semi")
        before, waiting = waiting, left.count()
        if (before - waiting) * 10 < before:
            break
    if not waiting:
        return formulas.select(*_KEY).limit(0).mapInArrow(_nothing, _RESULT) if results is None else results
    open_ = cut(open_)
    needed = open_.select(*_KEY).join(wanted, _KEY).select("doc_key", F.col("target").alias("sheet"), F.col("r").alias("row_no"), F.col("c").alias("col_no")).distinct()
    values = given if results is None else given.unionByName(valued())
    rest = values.join(needed, _KEY, "left_semi").select(*_KEY, "kind", "value", "num", "flag").unionByName(open_.select(*_KEY, F.lit("formula").alias("kind"), "value", F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("flag")))
    names = ["target", "o1", "p1", "o2", "p2", "size", "open", *_BLOCK]
    no_blocks = "array<struct<target:string,o1:int,p1:int,o2:int,p2:int,size:bigint,open:bigint,filled:bigint,numbers:bigint,total:double,errors:bigint,low:double,high:double,true:bigint>>"
    if pieces is None:
        rest = rest.withColumn("blocks", F.lit(None).cast(no_blocks))
    else:
        rest = rest.join(folded(), _KEY, "left").withColumn("blocks", F.transform("blocks", lambda b: F.struct(*(b[n].alias(n) for n in names))))

    def by_document(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        cells = {(r["sheet"], r["row_no"], r["col_no"]): ("formula", r["value"]) if r["kind"] == "formula" else _value(r["kind"], r["value"], r["num"], r["flag"]) for r in rows}
        columns: dict[tuple, list] = {}
        for (sheet, row, col), content in cells.items():
            if not isinstance(content, Value):
                columns.setdefault((sheet, col), []).append(row)
        blocks: dict[tuple, Block] = {}
        for r in rows:
            for b in r["blocks"] or []:
                high, right = (1 << 30 if b["o2"] is None else b["o2"]), (1 << 30 if b["p2"] is None else b["p2"])
                inside = tuple((s, row, col) for (s, col), found in columns.items() if s == b["target"] and (b["p1"] or 0) <= col <= right for row in found if (b["o1"] or 0) <= row <= high)
                key, block = _block(b, inside)
                blocks[key] = block
        ev = Evaluator(cells, "workbook", None, blocks)
        for target, *_ in blocks:
            ev.sheets.setdefault(target.lower(), target)
        return pa.Table.from_batches([_batch([_answer((r["doc_key"], r["sheet"], r["row_no"], r["col_no"]), r["value"], ev.cell(r["sheet"], r["row_no"], r["col_no"])) for r in rows if r["kind"] == "formula"])])

    last = rest.groupBy("doc_key").applyInArrow(by_document, _RESULT)
    return last if results is None else results.unionByName(last)


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        yield _batch([])


def report(results: DataFrame) -> DataFrame:
    """Of each workbook with formulas: doc_key, status ('ok', or 'error' if any formula gives an error), total_formulas, total_errors."""
    counted = results.groupBy("doc_key").agg(F.count("*").alias("total_formulas"), F.count("error").alias("total_errors"))
    return counted.select("doc_key", F.when(F.col("total_errors") > 0, "error").otherwise("ok").alias("status"), "total_formulas", "total_errors")


def errors(results: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Every error cell: error, n (cells with that error), doc_key and location, in order of error, document,
    sheet, row and column. Sheets are in the order of ``sheets`` (doc_key, sheet, sheet_no), else by name.

    One row a cell, so that no row or task holds all locations of an error.
    """
    from quillgrid.functions.texts import a1

    found = results.where(F.col("error").isNotNull()).select("error", *_KEY)
    if sheets is None:
        found = found.withColumn("sheet_no", F.lit(0))
    else:
        found = found.join(sheets.groupBy("doc_key", "sheet").agg(F.min("sheet_no").alias("sheet_no")), ["doc_key", "sheet"], "left")
    found = cut(found)
    counts = found.groupBy("error").agg(F.count("*").alias("n"))  # a few kinds of errors
    ordered = found.join(F.broadcast(counts), "error").orderBy("error", "doc_key", "sheet_no", "sheet", "row_no", "col_no")
    return ordered.select("error", "n", "doc_key", F.concat_ws("!", "sheet", a1(F.col("row_no"), F.col("col_no"))).alias("location"))
