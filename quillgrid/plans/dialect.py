"""The small SELECT dialect: strict parser and translation to a DataFrame.

    SELECT * | col {, col} FROM table [WHERE col op literal] [ORDER BY col [ASC|DESC]] [LIMIT n] [;]

A null compares and sorts as 0 (or as '' among texts). Text against text compares by bytes, any other
pair as numbers; text that is no number then fails the query. Ties keep the order of the rows, and
DESC reverses them, where the table has a row number to tell it. Anything else is refused rather
than misread: unknown columns, a bad limit, several predicates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.numbers import parse_float
from quillgrid.session import InvalidInput, ParseError

_TOKEN = re.compile(r"""\s*(?:("(?:[^"]|"")*"|'(?:[^']|'')*')|(<=|>=|<>|[=<>,;*])|([^\s"'<>=,;*]+))""")
OPERATORS = ("<=", ">=", "<>", "=", "<", ">")


@dataclass(frozen=True)
class Select:
    columns: tuple[str, ...] | None
    table: str
    predicate: tuple[str, str, object] | None = None
    order: tuple[str, bool] | None = None
    limit: int | None = None


def _tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    sql = sql.strip()
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected text at {at}")
        kind = "string" if m.group(1) else "mark" if m.group(2) else "word"
        out.append((kind, m.group(1) or m.group(2) or m.group(3)))
        at = m.end()
    return out


def literal(kind: str, text: str) -> object:
    if kind == "string":
        q = text[0]
        return text[1:-1].replace(q + q, q)
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"[+-]?[0-9]+", text) and -(2**63) <= int(text) < 2**63:
        return int(text)
    if re.fullmatch(r"(?i)[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)", text):
        return float(text)
    return text


def parse(sql: str) -> Select:
    tokens = _tokens(sql)
    while tokens and tokens[-1] == ("mark", ";"):
        tokens.pop()
    at = 0

    def word(expected: str) -> bool:
        nonlocal at
        if at < len(tokens) and tokens[at][0] == "word" and tokens[at][1].upper() == expected:
            at += 1
            return True
        return False

    def take(what: str, *kinds: str) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens) or tokens[at][0] not in kinds:
            raise ParseError(f"{what} expected")
        at += 1
        return tokens[at - 1]

    if not word("SELECT"):
        raise ParseError("a query begins with SELECT")
    columns: list[str] | None = None
    if at < len(tokens) and tokens[at] == ("mark", "*"):
        at += 1
    else:
        columns = [take("column", "word")[1]]
        while at < len(tokens) and tokens[at] == ("mark", ","):
            at += 1
            columns.append(take("column", "word")[1])
    if not word("FROM"):
        raise ParseError("FROM expected")
    table = take("table", "word")[1]
    predicate = order = limit = None
    if word("WHERE"):
        column = take("column", "word")[1]
        op = take("operator", "mark")[1]
        if op not in OPERATORS:
            raise ParseError(f"no such operator: {op}")
        predicate = (column, op, literal(*take("literal", "word", "string")))
    if word("ORDER"):
        if not word("BY"):
            raise ParseError("BY expected")
        key = take("column", "word")[1]
        descending = word("DESC")
        if not descending:
            word("ASC")
        order = (key, descending)
    if word("LIMIT"):
        n = take("limit", "word")[1]
        if not n.isascii() or not n.isdigit():
            raise ParseError(f"bad limit: {n}")
        limit = int(n)
    if at < len(tokens):
        raise ParseError(f"unexpected {tokens[at][1]!r}")
    return Select(tuple(columns) if columns is not None else None, table, predicate, order, limit)


def _field(df: DataFrame, name: str) -> T.StructField:
    found = [f for f in df.schema.fields if f.name.lower() == name.lower()]
    if not found:
        raise InvalidInput(f"column not found: {name}")
    if len(found) > 1:
        raise InvalidInput(f"column is ambiguous: {name}")
    return found[0]


def _number(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        text = F.coalesce(column, F.lit("0"))
        value = parse_float(text)
        return F.when(value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")).otherwise(value)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column.cast("double"), F.lit(0.0))
    return F.coalesce(column.cast("double"), F.lit(0.0))


def _compare(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def condition(df: DataFrame, predicate: tuple[str, str, object]) -> Column:
    """The predicate as a Column; plain where null as 0 cannot matter, so that it reaches the scan."""
    name, op, value = predicate
    field = _field(df, name)
    column = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, T.StringType) and isinstance(value, str):
        plain = _compare(column, op, F.lit(value))
        empty = {"=": value == "", "<>": value != "", "<": "" < value, "<=": True, ">": False, ">=": value == ""}[op]
        return plain | column.isNull() if empty else plain
    if isinstance(kind, (T.StringType, T.BooleanType)) or isinstance(value, str):
        if isinstance(value, str):
            try:
                value = float(value)
            except ValueError:
                raise InvalidInput(f"not a number: {value}") from None
        return _compare(_number(column, kind), op, F.lit(float(value)))
    value = int(value) if isinstance(value, bool) else value
    zero = {"=": value == 0, "<>": value != 0, "<": value > 0, "<=": value >= 0, ">": value < 0, ">=": value <= 0}[op]
    plain = _compare(column, op, F.lit(value))
    return plain | column.isNull() if zero else plain


def sort_keys(df: DataFrame, order: tuple[str, bool], row_id: str | None) -> list[Column]:
    """One total order: numbers (null as 0, numeric text as its number) before other texts by bytes; ties by row number, reversed with the rest."""
    name, descending = order
    field = _field(df, name)
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        number = parse_float(column)
        keys = [(column.isNotNull() & number.isNull()), F.coalesce(number, F.when(column.isNull(), F.lit(0.0))), column]
    else:
        keys = [F.coalesce(column.cast("double") if isinstance(field.dataType, T.BooleanType) else column, F.lit(0).cast(field.dataType) if not isinstance(field.dataType, T.BooleanType) else F.lit(0.0)) if isinstance(field.dataType, (T.NumericType, T.BooleanType)) else column]
    if row_id and row_id in df.columns:
        keys.append(F.col(row_id))
    else:  # without a row number ties are settled by the other columns, so that a limit always gives the same rows
        keys += [F.col(f"`{f.name}`") for f in df.schema.fields if f.name != field.name and isinstance(f.dataType, T.AtomicType)]
    return [k.desc() if descending else k.asc() for k in keys]


def execute(df: DataFrame, query: Select, row_id: str | None = None) -> DataFrame:
    """Filter, sort, limit, then project: rows sort by any column of the table, projected or not."""
    names = [f.name for f in df.schema.fields if f.name != row_id] if query.columns is None else [_field(df, c).name for c in query.columns]
    if query.predicate:
        df = df.where(condition(df, query.predicate))
    if query.order:
        df = df.orderBy(*sort_keys(df, query.order, row_id))
    if query.limit is not None:
        df = df.limit(query.limit)
    return df.select(*(F.col(f"`{n}`") for n in names))


class Database:
    """Named tables and stored queries over a session."""

    def __init__(self, spark: SparkSession, title: str = ""):
        self.spark, self.title = spark, title
        self.tables: dict[str, DataFrame] = {}
        self.row_ids: dict[str, str] = {}
        self.queries: dict[str, str] = {}

    def add_table(self, name: str, df: DataFrame, row_id: str | None = None) -> None:
        """Registers a table; ``row_id`` is a column with the rows' order, which is no part of its results."""
        self.tables[name] = df
        if row_id is not None:
            self.row_ids[name.lower()] = row_id
        df.createOrReplaceTempView(name)

    def add_query(self, name: str, sql: str) -> None:
        parse(sql)
        self.queries[name] = sql

    def table(self, name: str) -> DataFrame:
        for known, df in self.tables.items():
            if known.lower() == name.lower():
                return df
        raise InvalidInput(f"table not found: {name}")

    def query(self, sql: str, row_id: str | None = None) -> DataFrame:
        q = parse(sql)
        return execute(self.table(q.table), q, row_id or self.row_ids.get(q.table.lower()))

    def run_stored(self, name: str) -> DataFrame:
        if name not in self.queries:
            raise InvalidInput(f"query not found: {name}")
        return self.query(self.queries[name])

    def insert_row(self, table: str, values: list[object]) -> None:
        """One more row; short ones are padded with nulls, long ones refused."""
        df = self.table(table)
        if len(values) > len(df.columns):
            raise InvalidInput(f"{len(values)} values for {len(df.columns)} columns")
        row = tuple(values) + (None,) * (len(df.columns) - len(values))
        name = next(k for k in self.tables if k.lower() == table.lower())
        self.add_table(name, df.unionByName(self.spark.createDataFrame([row], df.schema)))
