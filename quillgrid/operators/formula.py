"""Spreadsheet formulas in two dialects: parsing, evaluation over cells, compilation to Columns.

``sheet`` knows one sheet, thirteen functions and A1 references; what goes wrong raises EvalError.
``workbook`` knows other sheets, $ references, whole rows and columns and twenty-one functions; what
goes wrong becomes an error value. The dialects differ in many more ways; each is noted where it
is decided.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions import numbers, texts
from quillgrid.session import EvalError, ParseError, Unsupported

SHEET, WORKBOOK = "sheet", "workbook"
EPSILON = 2.0**-52
_FLOAT = re.compile(r"(?i)[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\Z")

# An expression is a tuple: ("num", x), ("text", s), ("bool", b), ("ref", sheet, row, col),
# ("range", sheet, row, col, row, col) with None for the open sides of whole rows and columns,
# ("unary", op, x), ("binary", op, x, y), ("call", NAME, args), ("name", word).


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def column_name(col: int) -> str:
    out = ""
    col += 1
    while col:
        col, k = divmod(col - 1, 26)
        out = chr(65 + k) + out
    return out


def address(row: int, col: int) -> str:
    return f"{column_name(col)}{row + 1}"


def parse_address(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([1-9][0-9]*)", text)
    if not m:
        raise ParseError(f"no cell address: {text}")
    return int(m.group(2)) - 1, column_number(m.group(1))


_QUALIFIER = r"(?:(?P<sheet>'(?:[^']|'')*'|[A-Za-z_][A-Za-z0-9_.]*)!)?"
_REFERENCE = re.compile(_QUALIFIER + r"(?:\$?(?P<c1>[A-Za-z]{1,3})\$?(?P<r1>[1-9][0-9]*)(?::\$?(?P<c2>[A-Za-z]{1,3})\$?(?P<r2>[1-9][0-9]*))?|\$?(?P<a>[A-Za-z]{1,3}):\$?(?P<b>[A-Za-z]{1,3})|\$?(?P<x>[1-9][0-9]*):\$?(?P<y>[1-9][0-9]*))(?![A-Za-z0-9_(!.])")
_PLAIN_REFERENCE = re.compile(r"(?P<c1>[A-Za-z]{1,3})(?P<r1>[1-9][0-9]*)(?:\s*:\s*(?P<c2>[A-Za-z]{1,3})(?P<r2>[1-9][0-9]*))?(?![A-Za-z0-9_(])")
_WORKBOOK_NUMBER = re.compile(r"[0-9]+\.?[0-9]*|\.[0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_OPERATOR = re.compile(r"<=|>=|<>|[=<>&+\-*/^(),;]")


def tokenize(text: str, dialect: str) -> list[tuple]:
    text = text.strip().removeprefix("=").strip()
    out, at = [], 0
    reference = _REFERENCE if dialect == WORKBOOK else _PLAIN_REFERENCE
    while at < len(text):
        ch = text[at]
        if ch.isspace():
            at += 1
            continue
        if ch == '"':
            # workbook: a doubled quote is one; sheet: the next quote ends the text
            end = at + 1
            while True:
                end = text.find('"', end)
                if end < 0:
                    raise ParseError("a text does not end")
                if dialect == WORKBOOK and text[end + 1 : end + 2] == '"':
                    end += 2
                    continue
                break
            value = text[at + 1 : end]
            out.append(("text", value.replace('""', '"') if dialect == WORKBOOK else value))
            at = end + 1
            continue
        m = reference.match(text, at)
        if m:
            g = m.groupdict()
            sheet = g.get("sheet")
            if sheet and sheet[0] == "'":
                sheet = sheet[1:-1].replace("''", "'")
            if g["c1"]:
                one = (int(g["r1"]) - 1, column_number(g["c1"]))
                if g["c2"]:
                    two = (int(g["r2"]) - 1, column_number(g["c2"]))
                    out.append(("range", sheet, min(one[0], two[0]), min(one[1], two[1]), max(one[0], two[0]), max(one[1], two[1])))
                else:
                    out.append(("ref", sheet, *one))
            elif g["a"]:
                a, b = sorted((column_number(g["a"]), column_number(g["b"])))
                out.append(("range", sheet, None, a, None, b))
            else:
                a, b = sorted((int(g["x"]) - 1, int(g["y"]) - 1))
                out.append(("range", sheet, a, None, b, None))
            at = m.end()
            continue
        m = _WORKBOOK_NUMBER.match(text, at)
        if m:
            out.append(("num", float(m.group())))
            at = m.end()
            continue
        m = _IDENTIFIER.match(text, at)
        if m:
            out.append(("name", m.group()))
            at = m.end()
            continue
        m = _OPERATOR.match(text, at)
        if not m:
            raise ParseError(f"unexpected {ch!r}")
        out.append(("op", m.group()))
        at = m.end()
    return out


_LEVELS = (("=", "<>", "<", "<=", ">", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",))


def parse(text: str, dialect: str = SHEET) -> tuple:
    """Expression of a formula; operators of one level group from the left, a sign binds tighter than ^."""
    tokens = tokenize(text, dialect)
    at = 0

    def peek() -> tuple:
        return tokens[at] if at < len(tokens) else ("end",)

    def level(k: int) -> tuple:
        nonlocal at
        if k == len(_LEVELS):
            return unary()
        left = level(k + 1)
        while peek()[0] == "op" and peek()[1] in _LEVELS[k]:
            op = tokens[at][1]
            at += 1
            left = ("binary", op, left, level(k + 1))
        return left

    def unary() -> tuple:
        nonlocal at
        signs = []
        while peek() in (("op", "-"), ("op", "+")):
            signs.append(tokens[at][1])
            at += 1
        out = primary()
        for sign in reversed(signs):
            out = ("unary", sign, out)
        return out

    def primary() -> tuple:
        nonlocal at
        token = peek()
        at += 1
        if token[0] in ("num", "text", "ref", "range"):
            return token
        if token == ("op", "("):
            out = level(0)
            if peek() != ("op", ")"):
                raise ParseError("a bracket is not closed")
            at += 1
            return out
        if token[0] == "name":
            name = token[1]
            if peek() == ("op", "("):
                at += 1
                args = []
                if peek() == ("op", ")"):
                    at += 1
                    return ("call", name.upper(), tuple(args))
                while True:
                    args.append(level(0))
                    mark = peek()
                    at += 1
                    if mark == ("op", ")"):
                        return ("call", name.upper(), tuple(args))
                    if mark not in (("op", ","), ("op", ";")):
                        raise ParseError("a comma or a closing bracket is missing")
            if name.upper() in ("TRUE", "FALSE"):
                return ("bool", name.upper() == "TRUE")
            if dialect == WORKBOOK:
                return ("text", name)  # a bare word is a text there
            raise ParseError(f"unknown name: {name}")
        raise ParseError("the formula ends too early" if token[0] == "end" else f"unexpected {token[-1]!r}")

    out = level(0)
    if at < len(tokens):
        raise ParseError(f"unexpected {tokens[at][-1]!r}")
    return out


def references(expr: tuple) -> list[tuple]:
    """The ('ref', ...) and ('range', ...) of an expression."""
    out, stack = [], [expr]
    while stack:
        e = stack.pop()
        if e[0] in ("ref", "range"):
            out.append(e)
        elif e[0] == "unary":
            stack.append(e[2])
        elif e[0] == "binary":
            stack += (e[3], e[2])
        elif e[0] == "call":
            stack += reversed(e[2])
    return out


_SHIFTED = re.compile(r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'!|(?<![A-Za-z0-9_$.])(\$?)([A-Za-z]{1,3})(\$?)([1-9][0-9]*)(?![A-Za-z0-9_(!])|(?<![A-Za-z0-9_$.])(\$?)([A-Za-z]{1,3}):(\$?)([A-Za-z]{1,3})(?![A-Za-z0-9_(!])")


def shift(formula: str, rows: int, cols: int) -> str:
    """The formula moved by rows and columns: relative parts move (not below 0), $ parts and texts stay."""

    def one(m: re.Match) -> str:
        if m.group(2):
            col = m.group(2) if m.group(1) else column_name(max(0, column_number(m.group(2)) + cols))
            row = m.group(4) if m.group(3) else str(max(0, int(m.group(4)) - 1 + rows) + 1)
            return f"{m.group(1)}{col}{m.group(3)}{row}"
        if m.group(6):
            a = m.group(6) if m.group(5) else column_name(max(0, column_number(m.group(6)) + cols))
            b = m.group(8) if m.group(7) else column_name(max(0, column_number(m.group(8)) + cols))
            return f"{m.group(5)}{a}:{m.group(7)}{b}"
        return m.group()

    return _SHIFTED.sub(one, formula)


@dataclass(frozen=True)
class Value:
    """A cell's value: kind blank, number, text, bool or error."""

    kind: str
    value: object = None


BLANK = Value("blank")

#: Functions of the workbook dialect for which a range may come as a Block.
FOLDS = ("SUM", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "AND", "OR")


@dataclass(frozen=True)
class Block:
    """A range folded: its cells (without those of ``inside``, which are formulas), those not blank, numbers, their total with what
    counts as a number, errors, least and greatest number, true ones."""

    size: int
    filled: int = 0
    numbers: int = 0
    total: float = 0.0
    errors: int = 0
    low: float | None = None
    high: float | None = None
    true: int = 0
    inside: tuple = ()


def foldable(expr: tuple) -> set[tuple]:
    """The ranges of an expression that stand in folds only."""
    inside, outside, stack = set(), set(), [(expr, False)]
    while stack:
        e, fold = stack.pop()
        if e[0] == "range":
            (inside if fold else outside).add(e)
        elif e[0] == "unary":
            stack.append((e[2], False))
        elif e[0] == "binary":
            stack += ((e[2], False), (e[3], False))
        elif e[0] == "call":
            stack += [(x, e[1] in FOLDS) for x in e[2]]
    return inside - outside


def number(x: float) -> Value:
    return Value("number", float(x))


def display_number(x: float) -> str:
    """Shortest text without an exponent."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    text = repr(x)
    if "e" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text.removesuffix(".0")


class Evaluator:
    """Evaluates formulas over cells; ``cells`` gives the Value or ('formula', source) of (sheet, row, col).

    Results are kept, so diamonds of references cost nothing. In the workbook dialect all cells of a
    cycle, and what needs them as a number, show an error; in the sheet dialect a cycle raises.
    ``blocks`` has the folded values of ranges, by (sheet, and the range as the formula has it, and the
    sheet it stands on); of their cells only formulas are looked at one by one.
    """

    def __init__(self, cells: dict[tuple[str, int, int], object], dialect: str = WORKBOOK, sheets: list[str] | None = None, blocks: dict[tuple, Block] | None = None):
        self.cells, self.dialect, self.blocks = cells, dialect, blocks or {}
        self.sheets = {s.lower(): s for s in (sheets if sheets is not None else dict.fromkeys(k[0] for k in cells))}
        self.done: dict[tuple[str, int, int], Value] = {}
        self.extent: dict[str, tuple[int, int]] = {}
        for s, r, c in cells:
            a, b = self.extent.get(s, (0, 0))
            self.extent[s] = (max(a, r), max(b, c))
        self.parsed: dict[str, tuple] = {}

    def expression(self, source: str) -> tuple:
        if source not in self.parsed:
            self.parsed[source] = parse(source, self.dialect)
        return self.parsed[source]

    def _target(self, sheet: str | None, here: str) -> str:
        return self.sheets.get(sheet.lower(), here) if sheet is not None else here  # an unknown sheet is the own one

    def _addresses(self, e: tuple, here: str):
        sheet = self._target(e[1], here)
        if e[0] == "ref":
            yield sheet, e[2], e[3]
            return
        block = self.blocks.get((sheet, *e[2:])) if self.blocks else None
        if block is not None:
            yield from block.inside
            return
        rows, cols = self.extent.get(sheet, (0, 0))
        r1, r2 = (0, rows) if e[2] is None else (e[2], e[4])
        c1, c2 = (0, cols) if e[3] is None else (e[3], e[5])
        for r in range(r1, r2 + 1):
            for c in range(c1, c2 + 1):
                yield sheet, r, c

    def cell(self, sheet: str, row: int, col: int) -> Value:
        """Value of a cell; formulas it needs are evaluated first, without recursion between cells."""
        start = (sheet, row, col)
        stack, active = [start], set()
        while stack:
            at = stack[-1]
            content = self.cells.get(at, BLANK)
            if at in self.done or isinstance(content, Value):
                self.done.setdefault(at, content)
                stack.pop()
                continue
            if at in active:
                stack.pop()
                active.discard(at)
                self.done[at] = self._formula(at, content[1])
                continue
            active.add(at)
            try:
                needed = [a for e in references(self.expression(content[1])) for a in self._addresses(e, at[0])]
            except (ParseError, Unsupported):
                needed = []
            for a in needed:
                if a in active and a not in self.done:
                    self._cycle(a, active)
                    break
                if a not in self.done and not isinstance(self.cells.get(a, BLANK), Value):
                    stack.append(a)
        return self.done[start]

    def _cycle(self, at: tuple, active: set) -> None:
        if self.dialect == SHEET:
            raise EvalError(f"circular reference at {address(at[1], at[2])}")
        # every cell on the way from ``at`` back to it belongs to the cycle
        for m in self._component(at):
            self.done[m] = Value("error", "#CYCLE!")
            active.discard(m)

    def _component(self, start: tuple) -> set:
        """Cells that reach ``start`` and are reached from it."""

        def needs(a: tuple) -> list[tuple]:
            content = self.cells.get(a, BLANK)
            if isinstance(content, Value):
                return []
            try:
                return [x for e in references(self.expression(content[1])) for x in self._addresses(e, a[0]) if not isinstance(self.cells.get(x, BLANK), Value)]
            except (ParseError, Unsupported):
                return []

        forward, todo, edges = {start}, [start], {}
        while todo:
            a = todo.pop()
            for b in needs(a):
                edges.setdefault(b, []).append(a)
                if b not in forward:
                    forward.add(b)
                    todo.append(b)
        back, todo = {start}, [start]
        while todo:
            for a in edges.get(todo.pop(), ()):
                if a not in back:
                    back.add(a)
                    todo.append(a)
        return forward & back

    def _formula(self, at: tuple, source: str) -> Value:
        if self.dialect == SHEET:
            return self.evaluate(source, at[0])
        try:
            return self.evaluate(source, at[0])
        except (EvalError, ParseError, Unsupported):
            return Value("error", "#VALUE!")

    def evaluate(self, source: str, sheet: str = "") -> Value:
        """Value of a formula as if it stood on ``sheet``; what it refers to is evaluated."""
        expr = self.expression(source)
        return self._scalar(self._eval(expr, sheet))

    def _values(self, node: object) -> list[Value]:
        return node if isinstance(node, list) else [node]

    def _scalar(self, node: object) -> Value:
        if isinstance(node, list):
            if self.dialect == SHEET:
                raise EvalError("a range is no single value")
            return node[0] if node else BLANK
        return node

    def to_number(self, v: Value) -> float:
        if v.kind == "blank":
            return 0.0
        if v.kind == "number":
            return v.value
        if v.kind == "bool":
            return 1.0 if v.value else 0.0
        if v.kind == "text":
            text = v.value.strip() if self.dialect == WORKBOOK else v.value
            if _FLOAT.match(text):
                return float(text)
            raise EvalError(f"not a number: {v.value}")
        raise EvalError(str(v.value))

    def to_bool(self, v: Value) -> bool:
        if v.kind == "error":
            raise EvalError(str(v.value))
        return v.kind != "blank" and (v.value != 0 if v.kind == "number" else bool(v.value))

    def to_text(self, v: Value) -> str:
        if v.kind == "blank":
            return ""
        if v.kind == "number":
            return display_number(v.value if self.dialect == SHEET or v.value != 0 else 0.0)
        if v.kind == "bool":
            return str(v.value).upper() if self.dialect == WORKBOOK else str(v.value).lower()
        if v.kind == "error":
            return v.value if self.dialect == WORKBOOK else f"#ERR {v.value}"
        return v.value

    def _eval(self, e: tuple, sheet: str) -> object:
        kind = e[0]
        if kind == "num":
            return number(e[1])
        if kind in ("text", "bool"):
            return Value(kind, e[1])
        if kind == "ref":
            return self.cell(*next(self._addresses(e, sheet)))
        if kind == "range":
            block = self.blocks.get((self._target(e[1], sheet), *e[2:])) if self.blocks else None
            return [*([Value("block", block)] if block is not None else []), *(self.cell(*a) for a in self._addresses(e, sheet))]
        if kind == "unary":
            x = self.to_number(self._scalar(self._eval(e[2], sheet)))
            return number(-x if e[1] == "-" else x)
        if kind == "binary":
            return self._binary(e[1], self._scalar(self._eval(e[2], sheet)), self._scalar(self._eval(e[3], sheet)))
        return self._call(e[1], e[2], sheet)

    def _binary(self, op: str, a: Value, b: Value) -> Value:
        if op == "&":
            return Value("text", self.to_text(a) + self.to_text(b))
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return Value("bool", self._compare(op, a, b))
        x, y = self.to_number(a), self.to_number(b)
        if op == "/":
            if y == 0:
                if self.dialect == SHEET:
                    raise EvalError("division by zero")
                return Value("error", "#DIV/0!")
            return number(x / y)
        try:
            return number({"+": x + y, "-": x - y, "*": x * y}[op] if op != "^" else _power(x, y))
        except OverflowError:
            return number(math.inf)

    def _compare(self, op: str, a: Value, b: Value) -> bool:
        if self.dialect == WORKBOOK and op in ("=", "<>"):
            if a.kind == b.kind == "number":
                same = abs(a.value - b.value) < EPSILON
            elif a.kind == b.kind:
                same = a.value == b.value
            else:
                same = self.to_text(a) == self.to_text(b)
            return same == (op == "=")
        if self.dialect == SHEET and a.kind == b.kind == "text":
            x, y = a.value.encode(), b.value.encode()
        else:
            x, y = self.to_number(a), self.to_number(b)
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def _sheet_numbers(self, nodes: list[object]) -> list[float]:
        """Numbers of arguments: blanks are skipped, texts only inside ranges; errors and other texts raise."""
        out = []
        for node in nodes:
            for v in self._values(node):
                if v.kind == "blank" or (v.kind == "text" and isinstance(node, list)):
                    continue
                out.append(self.to_number(v))
        return out

    def _call(self, name: str, args: tuple, sheet: str) -> Value:
        return self._sheet_call(name, args, sheet) if self.dialect == SHEET else self._workbook_call(name, args, sheet)

    def _sheet_call(self, name: str, args: tuple, sheet: str) -> Value:
        ev = lambda k: self._scalar(self._eval(args[k], sheet))

        def arity(low: int, high: int) -> None:
            if not low <= len(args) <= high:
                raise EvalError(f"{name} takes {low} to {high} arguments")

        if name in ("SUM", "AVERAGE", "AVG", "MIN", "MAX", "COUNT"):
            xs = self._sheet_numbers([self._eval(a, sheet) for a in args])
            if name == "SUM":
                return number(sum(xs))
            if name == "COUNT":
                return number(len(xs))
            if name in ("AVERAGE", "AVG"):
                return number(sum(xs) / len(xs)) if xs else BLANK
            if not xs:
                raise EvalError(f"{name} of no values")
            return number(min(xs) if name == "MIN" else max(xs))
        if name == "IF":
            arity(2, 3)
            return ev(1) if self.to_bool(ev(0)) else ev(2) if len(args) == 3 else BLANK
        if name == "AND":
            return Value("bool", all(self.to_bool(ev(k)) for k in range(len(args))))
        if name == "OR":
            return Value("bool", any(self.to_bool(ev(k)) for k in range(len(args))))
        if name == "NOT":
            arity(1, 1)
            return Value("bool", not self.to_bool(ev(0)))
        if name == "CONCAT":
            return Value("text", "".join(self.to_text(v) for a in args for v in self._values(self._eval(a, sheet))))
        if name == "LEN":
            arity(1, 1)
            return number(len(self.to_text(ev(0))))
        if name == "ABS":
            arity(1, 1)
            return number(abs(self.to_number(ev(0))))
        if name == "ROUND":
            arity(1, 2)
            return number(round_half_away(self.to_number(ev(0)), int(self.to_number(ev(1))) if len(args) == 2 else 0))
        raise Unsupported(f"unknown function: {name}")

    def _workbook_call(self, name: str, args: tuple, sheet: str) -> Value:
        nodes = [self._eval(a, sheet) for a in args]  # all of them, IF too
        flat = [v for node in nodes for v in self._values(node)]
        at = lambda k: self._scalar(nodes[k]) if k < len(nodes) else BLANK

        def total() -> float:
            out = 0.0
            for v in flat:
                if v.kind == "block":
                    if v.value.errors:
                        raise EvalError("an error in a range")
                    out += v.value.total
                if v.kind == "error":
                    raise EvalError(v.value)
                if v.kind == "number" or v.kind == "bool":
                    out += float(v.value)
                elif v.kind == "text" and _FLOAT.match(v.value):
                    out += float(v.value)
            return out

        def maybe(v: Value) -> float | None:
            try:
                return self.to_number(v)
            except EvalError:
                return None

        def truth(v: Value) -> bool:
            return v.kind != "error" and self.to_bool(v)

        def count_of(v: Value) -> int:
            x = maybe(v)
            x = 1.0 if x is None else x
            return int(x) if math.isfinite(x) and x > 0 else 0 if not x == math.inf else 1 << 31

        if name == "SUM":
            return number(total())
        folded = [v.value for v in flat if v.kind == "block"]
        if name == "AVERAGE":
            n = sum(v.kind == "number" for v in flat) + sum(b.numbers for b in folded)
            return number(total() / n) if n else Value("error", "#DIV/0!")
        if name in ("MIN", "MAX"):
            xs = [x for v in flat if v.kind != "block" and (x := maybe(v)) is not None]
            xs += [x for b in folded for x in (b.low, b.high, 0.0 if b.size > b.filled else None) if x is not None]
            return number((min(xs) if name == "MIN" else max(xs)) if xs else 0.0)
        if name == "COUNT":
            return number(sum(v.kind == "number" for v in flat) + sum(b.numbers for b in folded))
        if name == "COUNTA":
            return number(sum(v.kind not in ("blank", "block") for v in flat) + sum(b.filled for b in folded))
        if name == "IF":
            return at(1) if self.to_bool(at(0)) else at(2)
        if name == "AND":
            return Value("bool", all(v.value.true == v.value.size if v.kind == "block" else truth(v) for v in flat))
        if name == "OR":
            return Value("bool", any(v.value.true > 0 if v.kind == "block" else truth(v) for v in flat))
        if name == "NOT":
            return Value("bool", not self.to_bool(at(0)))
        if name == "ABS":
            return number(abs(self.to_number(at(0))))
        if name == "INT":
            x = self.to_number(at(0))
            return number(math.floor(x) if math.isfinite(x) else x)
        if name == "ROUND":
            d = maybe(at(1))
            return number(round_half_away(self.to_number(at(0)), int(d) if d is not None and math.isfinite(d) else 0))
        if name == "LEN":
            return number(len(self.to_text(at(0))))
        if name in ("CONCAT", "CONCATENATE"):
            return Value("text", "".join(self.to_text(v) for v in flat))
        if name in ("LEFT", "RIGHT"):
            text, n = self.to_text(at(0)), count_of(at(1))
            return Value("text", text[:n] if name == "LEFT" else text[max(0, len(text) - n) :])
        if name in ("UPPER", "LOWER"):
            text = self.to_text(at(0))
            return Value("text", "".join(c.upper() if c.isascii() else c for c in text) if name == "UPPER" else "".join(c.lower() if c.isascii() else c for c in text))
        if name == "TRIM":
            return Value("text", self.to_text(at(0)).strip())
        if name == "POWER":
            return number(_power(self.to_number(at(0)), self.to_number(at(1))))
        raise Unsupported(f"unknown function: {name}")


def _power(x: float, y: float) -> float:
    try:
        return math.pow(x, y)
    except OverflowError:
        return math.inf if x > 0 or y % 2 == 0 else -math.inf
    except ValueError:
        return math.nan if x != 0 else math.inf


def round_half_away(x: float, digits: int) -> float:
    """Half away from zero on the scaled binary double."""
    scale = math.pow(10.0, digits) if abs(digits) < 308 else math.inf
    y = x * scale
    if not math.isfinite(y) or abs(y) >= 2.0**52:
        return x if math.isfinite(scale) else math.nan
    whole = math.floor(abs(y))
    return math.copysign(whole + (abs(y) - whole >= 0.5), x) / scale


# -- compilation to Columns -----------------------------------------------------------------------------


class Compiler:
    """Compiles a formula over a table to one Column: a reference to a cell of the first row names the
    column of that letter, in the row at hand; a range names the columns between its ends.

    Kinds are known from the table's schema, so the Column has no boxed values and stays in code
    generation. In the workbook dialect what would be an error value is null; in the sheet dialect
    it fails the query.
    """

    def __init__(self, columns: list[tuple[str, str]], dialect: str = SHEET):
        self.columns, self.dialect = columns, dialect

    def column(self, formula: str) -> Column:
        return self._compile(parse(formula, self.dialect))[1]

    def _at(self, col: int) -> tuple[str, Column]:
        if col >= len(self.columns):
            return "blank", F.lit(None).cast("double")
        name, kind = self.columns[col]
        return kind, F.col(f"`{name}`")

    def _number(self, kc: tuple[str, Column]) -> Column:
        kind, c = kc
        if kind == "blank":
            return F.lit(0.0)
        if kind == "number":
            return F.coalesce(c.cast("double"), F.lit(0.0))
        if kind == "bool":
            return F.coalesce(c.cast("double"), F.lit(0.0))
        text = texts.trim_blank(c) if self.dialect == WORKBOOK else c
        value = numbers.parse_float(text)
        if self.dialect == WORKBOOK:
            return F.when(c.isNull(), 0.0).otherwise(value)
        return F.when(c.isNull(), 0.0).when(value.isNull(), F.raise_error(F.lit("not a number")).cast("double")).otherwise(value)

    def _text(self, kc: tuple[str, Column]) -> Column:
        kind, c = kc
        if kind == "blank":
            return F.lit("")
        if kind == "number":
            return F.coalesce(numbers.display(c.cast("double")), F.lit(""))
        if kind == "bool":
            return F.coalesce(F.upper(c.cast("string")) if self.dialect == WORKBOOK else c.cast("string"), F.lit(""))
        return F.coalesce(c, F.lit(""))

    def _bool(self, kc: tuple[str, Column]) -> Column:
        kind, c = kc
        if kind == "blank":
            return F.lit(False)
        if kind == "bool":
            return F.coalesce(c, F.lit(False))
        return F.coalesce(c.cast("double") != 0, F.lit(False)) if kind == "number" else F.coalesce(c != "", F.lit(False))

    def _members(self, args: tuple) -> list[tuple[str, Column, bool]]:
        out = []
        for a in args:
            if a[0] == "range":
                out += [(*self._at(c), True) for c in range(a[3] or 0, (len(self.columns) - 1 if a[5] is None else a[5]) + 1)]
            else:
                out.append((*self._compile(a), False))
        return out

    def _compile(self, e: tuple) -> tuple[str, Column]:
        kind = e[0]
        if kind == "num":
            return "number", F.lit(e[1])
        if kind in ("text", "bool"):
            return kind, F.lit(e[1])
        if kind == "ref":
            return self._at(e[3])
        if kind == "range":
            if self.dialect == SHEET:
                raise EvalError("a range is no single value")
            return self._at(e[3] or 0)
        if kind == "unary":
            x = self._number(self._compile(e[2]))
            return "number", -x if e[1] == "-" else x
        if kind == "binary":
            return self._binary(e[1], self._compile(e[2]), self._compile(e[3]))
        return self._call(e[1], e[2])

    def _binary(self, op: str, a: tuple, b: tuple) -> tuple[str, Column]:
        if op == "&":
            return "text", F.concat(self._text(a), self._text(b))
        if op in ("=", "<>", "<", "<=", ">", ">="):
            if self.dialect == WORKBOOK and op in ("=", "<>"):
                if a[0] == b[0] == "number":
                    same = F.abs(self._number(a) - self._number(b)) < EPSILON
                else:
                    same = self._text(a) == self._text(b)
                return "bool", same if op == "=" else ~same
            text = self.dialect == SHEET and a[0] == b[0] == "text"
            x, y = (self._text(a), self._text(b)) if text else (self._number(a), self._number(b))
            return "bool", {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        x, y = self._number(a), self._number(b)
        if op == "/":
            zero = F.lit(None).cast("double") if self.dialect == WORKBOOK else F.raise_error(F.lit("division by zero")).cast("double")
            return "number", F.when(y == 0, zero).otherwise(F.try_divide(x, y))
        return "number", {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "^": lambda: F.pow(x, y)}[op]()

    def _call(self, name: str, args: tuple) -> tuple[str, Column]:
        one = lambda k: self._compile(args[k]) if k < len(args) else ("blank", F.lit(None).cast("double"))
        if name in ("SUM", "AVERAGE", "AVG", "MIN", "MAX", "COUNT", "COUNTA"):
            return "number", self._fold(name, self._members(args))
        if name == "IF":
            a, b = one(1), one(2)
            if a[0] == b[0] or "blank" in (a[0], b[0]):
                kind = a[0] if a[0] != "blank" else b[0]
                return kind, F.when(self._bool(one(0)), a[1] if a[0] == kind else F.lit(None)).otherwise(b[1] if b[0] == kind else F.lit(None))
            return "text", F.when(self._bool(one(0)), self._text(a)).otherwise(self._text(b))
        if name in ("AND", "OR"):
            parts = [self._bool((k, c)) for k, c, _ in self._members(args)]
            out = F.lit(name == "AND")
            for p in parts:
                out = out & p if name == "AND" else out | p
            return "bool", out
        simple: dict[str, Callable[[], tuple[str, Column]]] = {
            "NOT": lambda: ("bool", ~self._bool(one(0))),
            "ABS": lambda: ("number", F.abs(self._number(one(0)))),
            "LEN": lambda: ("number", F.char_length(self._text(one(0))).cast("double")),
            "ROUND": lambda: ("number", numbers.round_scaled(self._number(one(0)), self._number(one(1)).cast("int"))),
            "CONCAT": lambda: ("text", F.concat(*(self._text((k, c)) for k, c, _ in self._members(args)))),
        }
        more: dict[str, Callable[[], tuple[str, Column]]] = {
            "CONCATENATE": lambda: simple["CONCAT"](),
            "INT": lambda: ("number", F.floor(self._number(one(0))).cast("double")),
            "POWER": lambda: ("number", F.pow(self._number(one(0)), self._number(one(1)))),
            "LEFT": lambda: ("text", F.left(self._text(one(0)), F.greatest(F.coalesce(self._number(one(1)), F.lit(1.0)), F.lit(0.0)).cast("int"))),
            "RIGHT": lambda: ("text", F.right(self._text(one(0)), F.greatest(F.coalesce(self._number(one(1)), F.lit(1.0)), F.lit(0.0)).cast("int"))),
            "UPPER": lambda: ("text", texts.ascii_upper(self._text(one(0)))),
            "LOWER": lambda: ("text", texts.ascii_lower(self._text(one(0)))),
            "TRIM": lambda: ("text", texts.trim_blank(self._text(one(0)))),
        }
        found = simple.get(name) or (more.get(name) if self.dialect == WORKBOOK else None)
        if not found:
            raise Unsupported(f"unknown function: {name}")
        return found()

    def _fold(self, name: str, members: list[tuple[str, Column, bool]]) -> Column:
        """Over the columns of one row; null cells are blank."""
        numeric = []
        for kind, c, ranged in members:
            if kind == "blank" or (kind == "text" and ranged and self.dialect == SHEET):
                continue
            if kind == "text" and self.dialect == WORKBOOK:
                numeric.append(F.when(c.isNotNull(), numbers.parse_float(c)))
            else:
                numeric.append(F.when(c.isNotNull(), self._number((kind, c))))
        if name == "COUNTA":
            return sum((F.when(c.isNotNull(), 1.0).otherwise(0.0) for _, c, _ in members), F.lit(0.0))
        if name == "COUNT" or name in ("AVERAGE", "AVG"):
            counted = [c for (kind, c, _) in members if kind == "number" or (kind == "bool" and self.dialect == SHEET)]
            count = sum((F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in counted), F.lit(0.0))
            if name == "COUNT":
                return count
        total = sum((F.coalesce(x, F.lit(0.0)) for x in numeric), F.lit(0.0))
        if name == "SUM":
            return total
        if name in ("AVERAGE", "AVG"):
            return F.try_divide(total, F.nullif(count, F.lit(0.0)))
        if self.dialect == WORKBOOK:  # a blank is 0 there
            numeric = [F.coalesce(x, F.lit(0.0)) for x in numeric]
        best = numeric[0] if len(numeric) == 1 else (F.least if name == "MIN" else F.greatest)(*numeric) if numeric else F.lit(None).cast("double")
        return F.coalesce(best, F.lit(0.0)) if self.dialect == WORKBOOK else best


def aggregate(name: str, column: Column, kind: str, dialect: str = SHEET) -> Column:
    """A fold over a whole column of a table: SUM, AVERAGE, MIN, MAX, COUNT, COUNTA, AND, OR, CONCAT-free."""
    if kind == "text":
        value = numbers.parse_float(column) if dialect == WORKBOOK else F.lit(None).cast("double")
    else:
        value = column.cast("double")
    blank_is_zero = dialect == WORKBOOK
    if name == "SUM":
        return F.coalesce(F.sum(value), F.lit(0.0))
    if name in ("AVERAGE", "AVG"):
        if dialect == SHEET or kind == "number":
            return F.avg(value)
        return F.lit(None).cast("double")
    if name in ("MIN", "MAX"):
        if blank_is_zero:
            value = F.when(column.isNull(), 0.0).otherwise(value)
        best = F.min(value) if name == "MIN" else F.max(value)
        return F.coalesce(best, F.lit(0.0)) if blank_is_zero else best
    if name == "COUNT":
        return F.count(column if kind == "number" or (kind == "bool" and dialect == SHEET) else F.lit(None)).cast("double")
    if name == "COUNTA":
        return F.count(column).cast("double")
    if name in ("AND", "OR"):
        truth = F.coalesce(column, F.lit(False)) if kind == "bool" else F.coalesce(value != 0, F.lit(False)) if kind == "number" else F.coalesce(column != "", F.lit(False))
        return F.coalesce(F.bool_and(truth), F.lit(True)) if name == "AND" else F.coalesce(F.bool_or(truth), F.lit(False))
    raise Unsupported(f"unknown function: {name}")


def average_cells(kind: Column, num: Column, flag: Column) -> Column:
    """AVERAGE in the workbook dialect over cells as rows: booleans add to the sum but not to the count; null without numbers."""
    numbers_ = F.when(kind == "number", num)
    total = F.coalesce(F.sum(numbers_), F.lit(0.0)) + F.coalesce(F.sum(F.when(kind == "bool", flag.cast("int"))), F.lit(0))
    return F.try_divide(total, F.nullif(F.count(numbers_), F.lit(0)))
