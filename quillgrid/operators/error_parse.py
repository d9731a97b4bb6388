"""Rows that fail to parse: minimum-cost error parse of comma-separated records.

A dynamic program walks a record and may, at a cost, insert or delete a quote or a delimiter, or
give up on the value of a typed field. Costs are ordered: one quote edit outweighs any number of
delimiter edits, which outweigh any number of values given up. A parse of cost zero whose typed
fields hold is a valid row; of any other record, the edits of its cheapest parse state the reason.

Quotes toggle anywhere, a doubled quote inside quotes is one literal quote, and a carriage return
outside quotes is dropped. A record ends inside quotes exactly if no parse without a quote edit
exists, so 'quoting', 'columns', 'age' and 'active' are the kinds of the most expensive edit.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INT = re.compile(r"[+-]?[0-9]+\Z")
_LOW, _HIGH = -(2**63), 2**63 - 1

#: Automata over one field: text (anything), long (blank or an integer of 64 bits; a state has its sign and digits),
#: bool (blank, true, false).
_BAD = "bad"
_WORDS = ("true", "false")
KINDS = ("text", "long", "bool")
REASONS = ("quoting", "columns", "age", "active")


def _step(kind: str, state: str, ch: str) -> str:
    """Next automaton state of a field of this kind after one more character."""
    if kind == "text" or state == _BAD:
        return state
    space = ch.isspace()
    if state == "":
        if space:
            return ""
        if kind == "long":
            return ch if ch in "+-" else "+" + ch if "0" <= ch <= "9" else _BAD
        low = ch.lower()
        return low if low in ("t", "f") else _BAD
    if state == "end":
        return "end" if space else _BAD
    if kind == "long":
        if "0" <= ch <= "9":
            grown = state[0] + ch if state[1:] == "0" else state + ch
            return grown if _LOW <= int(grown) <= _HIGH else _BAD
        return "end" if space and len(state) > 1 else _BAD
    if space:
        return "end" if state in _WORDS else _BAD
    grown = state + ch.lower()
    return grown if any(w.startswith(grown) for w in _WORDS) else _BAD


def _accepts(kind: str, state: str) -> bool:
    if kind == "text" or state in ("", "end"):
        return True
    return state != _BAD and len(state) > 1 if kind == "long" else state in _WORDS


def plain_fields(record: str) -> tuple[list[str], bool]:
    """The fields without any edit, and whether the record ends inside quotes."""
    fields, cur, quoted, i, n = [], [], False, 0, len(record)
    while i < n:
        ch = record[i]
        if ch == '"':
            if quoted and i + 1 < n and record[i + 1] == '"':
                cur.append('"')
                i += 1
            else:
                quoted = not quoted
        elif ch == "," and not quoted:
            fields.append("".join(cur))
            cur = []
        elif ch == "\n" and not quoted:
            if i + 1 < n:
                fields.append("".join(cur))
                cur = []
        elif ch != "\r" or quoted:
            cur.append(ch)
        i += 1
    fields.append("".join(cur))
    return fields, quoted


def typed(kind: str, field: str) -> tuple[bool, object]:
    """Whether a field has a value of its kind, and the value; a blank one is null."""
    text = field.strip()
    if text == "":
        return True, None
    if kind == "text":
        return True, text
    if kind == "long":
        if _INT.match(text) and len(text) < 5000 and _LOW <= (number := int(text)) <= _HIGH:
            return True, number
        stripped = text.lstrip("+-").lstrip("0")
        if _INT.match(text) and len(stripped) < 20:
            number = int((stripped or "0")) * (-1 if text[0] == "-" else 1)
            return (_LOW <= number <= _HIGH), number if _LOW <= number <= _HIGH else None
        return False, None
    low = text.lower()
    return low in _WORDS, low == "true" if low in _WORDS else None


_TOKEN = re.compile(r'"|,|\n|[^",\n]+')
_MARK = re.compile(r'[",\n]')
_ATOM = re.compile(r"\s+|\S")
_TYPED = re.compile(r"[0-9]|true|false", re.IGNORECASE)
#: Atoms at each end of a long run that stand alone; a value of 64 bits, one of bool and the space around them are fewer.
_EDGE = 32
_TAKE, _DELETE, _DROP, _QUOTE, _DELIMITER = range(5)


def _scarce(record: str, wanted: int) -> bool:
    """Whether delimiters are missing wherever one quote edit, if one is needed, is made."""
    size = len(record)
    counts = [0, 0]  # delimiters outside and inside
    inside = 0
    for m in _MARK.finditer(record):
        if m.group() == '"':
            inside ^= 1
        elif m.end() < size or m.group() == ",":
            counts[inside] += 1
    if not inside:
        return counts[0] < wanted
    # an edit turns all behind it over: inner delimiters count from there, outer ones until there
    most = now = counts[1]
    inside = 0
    for m in _MARK.finditer(record):
        if m.group() == '"':
            inside ^= 1
        elif m.end() < size or m.group() == ",":
            now += -1 if inside else 1
            most = max(most, now)
    return most < wanted


def _tokens(record: str, scarce: bool) -> Iterator[tuple[int, str]]:
    """Places and texts of quotes, delimiters and the runs between them.

    Where delimiters are scarce, runs in which one may be missing beside a value, or beside a quote, are taken apart
    into characters and stretches of space; long ones at both ends only, as what lies between fits no value.
    """
    for m in _TOKEN.finditer(record):
        at, text = m.start(), m.group()
        if not scarce or len(text) == 1 or not (_TYPED.search(text) or '"' in (record[at - 1 : at], record[m.end() : m.end() + 1])):
            yield at, text
            continue
        head, size = [], len(text)
        for m in _ATOM.finditer(text):
            if len(head) == _EDGE:
                break
            head.append((m.start(), m.group()))
        upto = head[-1][0] + len(head[-1][1])
        tail, low = [], size
        while low > upto and len(tail) < _EDGE:
            cut = low - 1
            if text[cut].isspace():
                while cut > upto and text[cut - 1].isspace():
                    cut -= 1
            tail.append((cut, text[cut:low]))
            low = cut
        middle = [(upto, text[upto:low])] if low > upto else []
        for i, part in [*head, *middle, *reversed(tail)]:
            yield at + i, part


def _over(kind: str, state: str, text: str) -> str:
    """Automaton state after a run."""
    if kind == "text" or state == _BAD:
        return state
    if text.isspace():
        return _step(kind, state, " ")
    for ch in text:
        state = _step(kind, state, ch)
        if state == _BAD:
            break
    return state


def cheapest(record: str, kinds: tuple[str, ...] = KINDS) -> tuple[tuple[int, int, int], list[tuple[str, int, str]], str]:
    """Cost (quote edits, delimiter edits, values given up), the edits and the mended record.

    A state is (inside quotes, index of the field, automaton state of the field); 2 for 'inside' stands
    between the two quotes of a doubled one. A layer has the states after a token, a few dozen at most, so
    the whole is linear in the record; a run that changes no state needs no layer, and back pointers are
    two bytes a state. One quote edit is always enough (a quote may be added at the end), so dearer states
    are left; delimiters are inserted only where too few stand.
    """
    last, size = len(kinds) - 1, len(record)
    base = size + 16
    quote, delim = base * base, base
    scarce = _scarce(record, last)
    before, how, begins, upto = bytearray(), bytearray(), array("Q"), array("Q")

    def close(layer: dict[tuple, int], links: dict[tuple, tuple]) -> dict[tuple, int]:
        """The layer with insertions at its place, a quote or delimiters that end a field; its links are kept."""
        for state, cost in list(layer.items()):
            if cost < quote and state[0] != 2:
                flipped = (1 - state[0], state[1], state[2])
                if cost + quote < layer.get(flipped, 1 << 200):
                    layer[flipped] = cost + quote
                    links[flipped] = (state, _QUOTE)
        if scarce:
            for k in range(last):
                best = None
                for state, cost in layer.items():
                    if state[1] == k and state[0] == 0:
                        cost += delim + (not _accepts(kinds[k], state[2]))
                        if best is None or cost < best[0]:
                            best = (cost, state)
                to = (0, k + 1, "")
                if best and best[0] < layer.get(to, 1 << 200):
                    layer[to] = best[0]
                    links[to] = (best[1], _DELIMITER)
        if len(layer) > 8:
            # a value that is lost costs one at most, and one that is not yet lost may be
            lost = {s[:2]: c for s, c in layer.items() if s[2] == _BAD}
            least: dict[tuple, int] = {}
            for s, c in layer.items():
                if s[2] != _BAD:
                    least[s[:2]] = min(c, least.get(s[:2], c))
            used = {link[0] for link in links.values() if link[1] >= _QUOTE}
            layer = {s: c for s, c in layer.items() if s in used or (c < least.get(s[:2], c + 1) if s[2] == _BAD else c <= lost.get(s[:2], c))}
        return layer

    def keep(layer: dict[tuple, int], links: dict[tuple, tuple], slots: dict[tuple, int]) -> dict[tuple, int]:
        """Writes the layer's back pointers; the slots of its states."""
        own = {state: k for k, state in enumerate(layer)}
        begins.append(len(before))
        for state in layer:
            source, what = links[state]
            before.append(own[source] if what >= _QUOTE else slots[source])
            how.append(what)
        return own

    start = (0, 0, "")
    links: dict[tuple, tuple] = {start: (start, _TAKE)}
    layer = close({start: 0}, links)
    slots = keep(layer, links, {start: 0})
    upto.append(0)
    for at, text in _tokens(record, scarce):
        fresh: dict[tuple, int] = {}
        links = {}
        if text == '"':
            doubled = record[at + 1 : at + 2] == '"'
            for state, cost in layer.items():
                inside, k, auto = state
                if inside == 2:
                    moves = (((1, k, auto), cost, _TAKE),)
                else:
                    after = (2, k, _step(kinds[k], auto, '"')) if inside and doubled else (1 - inside, k, auto)
                    moves = ((after, cost, _TAKE), (state, cost + quote, _DELETE))
                for to, cost, what in moves:
                    if cost < fresh.get(to, 2 * quote):
                        fresh[to] = cost
                        links[to] = (state, what)
        elif text == "," or text == "\n":
            ends = text == "\n" and at + 1 == size
            for state, cost in layer.items():
                inside, k, auto = state
                if inside:
                    moves = (((1, k, _step(kinds[k], auto, text)), cost, _TAKE),)
                elif ends:
                    moves = ((state, cost, _DROP),)
                else:
                    moves = ((state, cost + delim, _DELETE),)
                    if k < last:
                        moves += (((0, k + 1, ""), cost + (not _accepts(kinds[k], auto)), _TAKE),)
                for to, cost, what in moves:
                    if cost < fresh.get(to, 2 * quote):
                        fresh[to] = cost
                        links[to] = (state, what)
        else:
            plain = text.replace("\r", "") if "\r" in text else text
            moved = False
            for state, cost in layer.items():
                inside, k, auto = state
                run = text if inside else plain
                to = (inside, k, _over(kinds[k], auto, run)) if run else state
                moved = moved or to != state
                if cost < fresh.get(to, 2 * quote):
                    fresh[to] = cost
                    links[to] = (state, _TAKE)
            if not moved and not scarce:
                upto[-1] = at + len(text)
                continue
        layer = close(fresh, links)
        slots = keep(layer, links, slots)
        upto.append(at + len(text))
    best, state = min((cost + (not _accepts(kinds[s[1]], s[2])), s) for s, cost in layer.items() if s[0] == 0 and s[1] == last)
    # back to front: a layer's insertions stand behind its token and the runs that need no layer
    edits, parts, slot, level = [], [], slots[state], len(begins) - 1
    while True:
        entry = begins[level] + slot
        what, slot, at = how[entry], before[entry], upto[level]
        if what >= _QUOTE:
            edits.append(("insert quote", at, '"') if what == _QUOTE else ("insert delimiter", at, ","))
            parts.append(edits[-1][2])
            continue
        if level == 0:
            parts.append(record[:at])
            break
        low = upto[level - 1]
        text = record[low:at]
        if what == _DELETE:
            edits.append(("delete quote" if text[0] == '"' else "delete delimiter", low, text[0]))
            text = text[1:]
        elif what == _DROP and any(parts):
            text = ""
        elif text == "\n" and what == _TAKE and not any(parts):
            text = ","  # a delimiter still, though nothing follows it any more
        parts.append(text)
        level -= 1
    return (best // quote, best % quote // delim, best % delim), edits[::-1], "".join(reversed(parts))


def parse_record(record: str | None, kinds: tuple[str, ...] = KINDS, names: tuple[str, ...] = REASONS[2:]) -> tuple[list | None, str | None, str, str | None]:
    """Typed values of a valid record, else the reason, the edits and the mended record.

    A record whose plain fields all hold has a parse of cost zero; any other is decided by the cheapest one.
    """
    if record is None:
        return None, "columns", "no record", None
    fields, quoted = plain_fields(record)
    if not quoted and len(fields) == len(kinds):
        values = [typed(k, f) for k, f in zip(kinds, fields, strict=True)]
        if all(ok for ok, _ in values):
            return [v for _, v in values], None, "", None
    cost, edits, mended = cheapest(record, kinds)
    said = "; ".join(f"{what} at {at}" for what, at, _ in edits)
    if cost[0]:
        return None, "quoting", said, mended
    if cost[1]:
        return None, "columns", said, mended
    failed = [k for k, (kind, f) in enumerate(zip(kinds, plain_fields(mended)[0], strict=True)) if not typed(kind, f)[0]]
    return None, names[failed[0] - 1], "; ".join(f"give up {names[k - 1]}" for k in failed), mended


SCHEMA = "row_id long, file_id string, line_no int, name string, age long, active boolean, reason string, edits string, mended string"
_ARROW = pa.schema(
    [("row_id", pa.int64()), ("file_id", pa.string()), ("line_no", pa.int32()), ("name", pa.string()), ("age", pa.int64()), ("active", pa.bool_()), ("reason", pa.string()), ("edits", pa.string()), ("mended", pa.string())]
)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for record in batch.column(3).to_pylist():
            values, reason, edits, mended = parse_record(record)
            for column, value in zip(out, [*(values or (None, None, None)), reason, edits, mended], strict=True):
                column.append(value)
        arrays = [batch.column(k) for k in range(3)] + [pa.array(c, f.type) for c, f in zip(out, list(_ARROW)[3:], strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def parse(records: DataFrame) -> DataFrame:
    """Every data record (``line_no`` above 1) once: typed values, or the reason it fails.

    ``records`` has row_id, file_id, line_no and record; other columns are ignored. A null record,
    like an empty one, fails with 'columns'. Repeated records stay repeated. An empty table gives an
    empty result. One pass without a shuffle; both outputs are filters of it.
    """
    return records.where(F.col("line_no") > 1).select(F.col("row_id").cast("long"), "file_id", F.col("line_no").cast("int"), "record").mapInArrow(_parse_batches, SCHEMA)


def valid_rows(records: DataFrame) -> DataFrame:
    return parse(records).where(F.col("reason").isNull()).select("row_id", "file_id", "line_no", "name", "age", "active")


def failing_rows(records: DataFrame) -> DataFrame:
    return parse(records).where(F.col("reason").isNotNull()).select("row_id", "file_id", "line_no", "reason", "edits", "mended")
