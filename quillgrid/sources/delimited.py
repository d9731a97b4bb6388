"""Comma-separated text to typed tables, and to sheet cells."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions import numbers, texts
from quillgrid.session import InvalidInput, ParseError


def tokenize(text: str) -> list[list[str]]:
    """Rows of fields: a quote toggles quoting anywhere, a doubled one inside quotes is literal, carriage
    returns outside quotes are dropped, a blank line is a row of one empty field."""
    rows, row, cur, quoted, i, n = [], [], [], False, 0, len(text)
    fresh = True
    while i < n:
        ch = text[i]
        fresh = False
        if ch == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cur.append('"')
                i += 1
            else:
                quoted = not quoted
        elif ch == "," and not quoted:
            row.append("".join(cur))
            cur = []
        elif ch == "\n" and not quoted:
            rows.append([*row, "".join(cur)])
            row, cur, fresh = [], [], True
        elif ch != "\r" or quoted:
            cur.append(ch)
        i += 1
    if quoted:
        raise ParseError("a quoted field does not end")
    if not fresh:
        rows.append([*row, "".join(cur)])
    return rows


_MARKS = re.compile('["\n]')


def header_row(text: str) -> list[str]:
    """The fields of the first row; what follows it is not looked at."""
    inside = False
    for m in _MARKS.finditer(text):
        if m.group() == '"':
            inside = not inside
        elif not inside:
            return tokenize(text[: m.start()])[0] if m.start() else [""]
    rows = tokenize(text)
    return rows[0] if rows else []


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The header of each file, so that no content leaves its task."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([header_row((c or b"").decode("utf-8", "replace").removeprefix("\ufeff")) for c in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["names"])


def read_fields(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """All fields as text under the header's names; a blank name becomes column_1, column_2 and so on.

    By default Spark's own reader splits the files. ``exact`` reads each file whole and follows the
    tokenizer to the letter (quotes inside fields, blank lines): for files that need it.
    """
    if not exact:
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False)
        return df.toDF(*(f"column_{k + 1}" if not c.strip() or c == f"_c{k}" else c.strip() for k, c in enumerate(df.columns)))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.agg(F.min("path")).first()[0]  # the header of one file gives the names
    found = files.where(F.col("path") == first).select("content").mapInArrow(_headers, "names array<string>").first() if first is not None else None
    if not found or not found.names:
        raise InvalidInput("CSV must include a header row")
    names = [c.strip() or f"column_{k + 1}" for k, c in enumerate(found.names)]
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                data = [(r + [None] * width)[:width] for r in tokenize(content.decode("utf-8", "replace"))[1:]]
                columns = list(zip(*data, strict=True)) if data else [()] * width
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return files.select("content").mapInArrow(run, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def infer_types(df: DataFrame) -> dict[str, str]:
    """bigint, double, boolean or string for every text column, by its non-blank values: one aggregation."""
    tests = {"bigint": numbers.parse_integer, "double": numbers.parse_float, "boolean": numbers.parse_boolean}
    out: list[Column] = []
    for k, name in enumerate(df.columns):
        value = texts.trim_blank(F.col(f"`{name}`"))
        filled = F.coalesce(value != "", F.lit(False))
        out += [F.coalesce(F.bool_and(~filled | test(value).isNotNull()), F.lit(False)).alias(f"{kind}_{k}") for kind, test in tests.items()]
        out.append(F.coalesce(F.bool_or(filled), F.lit(False)).alias(f"any_{k}"))
    row = df.agg(*out).first()
    return {name: next((kind for kind in tests if row[f"{kind}_{k}"]), "string") if row[f"any_{k}"] else "string" for k, name in enumerate(df.columns)}


def typed_value(text: Column, kind: str) -> Column:
    value = texts.trim_blank(text)
    parse = {"bigint": numbers.parse_integer, "double": numbers.parse_float, "boolean": numbers.parse_boolean}.get(kind, lambda v: v)
    return F.when(value != "", parse(value))


def typed(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """The table with inferred (or given) types; values are trimmed and blanks null."""
    kinds = kinds or infer_types(df)
    return df.select(*(typed_value(F.col(f"`{c}`"), kinds[c]).alias(c) for c in df.columns))


def read_table(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    return typed(read_fields(spark, path, exact))


def cell_kind(text: Column, formula_first: bool = True) -> Column:
    """What a field is as a sheet cell: empty, formula, bool, number or text."""
    t = texts.trim_blank(text)
    out = F.when(F.coalesce(t, F.lit("")) == "", "empty")
    if formula_first:
        out = out.when(t.startswith("="), "formula")
    return out.when(numbers.parse_boolean(t).isNotNull(), "bool").when(numbers.parse_float(t).isNotNull(), "number").otherwise("text")


def to_cells(fields: DataFrame, row_id: str, doc: Column, sheet: Column, header: bool = False) -> DataFrame:
    """Long form: one row for every non-empty field of a table of texts, places zero-based.

    ``row_id`` is a column with the row's number. With ``header`` row 0 stays text as it is.
    """
    names = [c for c in fields.columns if c != row_id]
    stacked = fields.select(row_id, F.posexplode(F.array(*(F.col(f"`{c}`") for c in names))).alias("col_no", "field"))
    kind = cell_kind(F.col("field"))
    kind = F.when((F.col(row_id) == 0) & F.lit(header) & (F.col("field") != ""), "text").otherwise(kind)
    t = texts.trim_blank(F.col("field"))
    return stacked.select(
        doc.alias("doc_key"), sheet.alias("sheet"), F.col(row_id).cast("int").alias("row_no"), "col_no", kind.alias("kind"),
        F.when(kind == "formula", F.expr("substring(trim(field), 2)")).when(kind == "text", F.when((F.col(row_id) == 0) & F.lit(header), F.col("field")).otherwise(t)).alias("value"),
        F.when(kind == "number", numbers.parse_float(t)).alias("num"), F.when(kind == "bool", numbers.parse_boolean(t)).alias("flag"),
    ).where(F.col("kind") != "empty")
