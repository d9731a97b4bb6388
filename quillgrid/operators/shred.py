"""Deeply nested records to flat, linked tables: single-pass tagged emission.

A depth-first visitor walks each part once and emits rows of one shape, each with its table's tag,
primary key, parent key and payload. Filtering (or writing partitioned) by tag and applying the
table's schema gives the flat tables; no row is visited twice and nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("node", "attribute", "reject")
SCHEMA = "tag string, part_id long, node_no long, parent_no long, seq long, depth long, name string, value string"
_ARROW = pa.schema([("tag", pa.string()), *((c, pa.int64()) for c in ("part_id", "node_no", "parent_no", "seq", "depth")), ("name", pa.string()), ("value", pa.string())])

#: Table of a tag: the emitted columns it keeps, renamed.
TABLES = {
    "node": {"part_id": "part_id", "node_no": "node_no", "parent_no": "parent_no", "seq": "child_no", "depth": "depth", "name": "name", "value": "text"},
    "attribute": {"part_id": "part_id", "node_no": "node_no", "seq": "attribute_no", "name": "name", "value": "value"},
    "reject": {"part_id": "part_id", "value": "reason"},
}
_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|([\[\]{}:,])|([^\s\[\]{}:,"]+))', re.S)


def parse_deep(text: str) -> object:
    """JSON of any depth without recursion; ValueError as json.loads raises it."""
    stack: list = []
    result: list = []
    key: str | None = None
    state = "value"  # what may come: value, first (value or end), key, firstkey, colon, next
    pos, end = 0, len(text.rstrip())

    def put(value: object) -> str:
        nonlocal key
        if not stack:
            result.append(value)
            return "done"
        top = stack[-1]
        if isinstance(top, list):
            top.append(value)
        else:
            top[key] = value
            key = None
        return "next"

    keys: list = []
    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m or state == "done":
            raise ValueError(f"unexpected text at {pos}")
        pos = m.end()
        string, mark, bare = m.groups()
        if string is not None and state in ("key", "firstkey"):
            key, state = json.loads(string, strict=False), "colon"
        elif mark == ":" and state == "colon":
            state = "value"
        elif state in ("value", "first") and mark in ("[", "{"):
            keys.append(key)
            stack.append([] if mark == "[" else {})
            state = "first" if mark == "[" else "firstkey"
        elif state in ("value", "first") and (string is not None or bare is not None):
            state = put(json.loads(string or bare, strict=False))
        elif (mark == "]" and state in ("first", "next") and stack and isinstance(stack[-1], list)) or (mark == "}" and state in ("firstkey", "next") and stack and isinstance(stack[-1], dict)):
            value = stack.pop()
            key = keys.pop()
            state = put(value)
        elif mark == "," and state == "next":
            state = "value" if isinstance(stack[-1], list) else "key"
        else:
            raise ValueError(f"unexpected text before {pos}")
    if state != "done":
        raise ValueError("the text ends too early")
    return result[0]


def _load(text: str) -> object:
    try:
        return json.loads(text, strict=False)
    except RecursionError:
        return parse_deep(text)


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return "(nested too deeply to print)"


def _attributes(node: dict) -> Iterator[tuple[str | None, object]]:
    given = node.get("attributes")
    if isinstance(given, dict):
        yield from given.items()
    elif isinstance(given, list):
        for one in given:
            if isinstance(one, dict):
                if "key" in one or "name" in one:
                    yield one.get("key", one.get("name")), one.get("value")
                else:
                    yield from one.items()


def visit(part_id: int, text: str | None, tags: tuple[str, ...] = TAGS) -> Iterator[tuple]:
    """Rows (tag, part_id, node_no, parent_no, seq, depth, name, value) of one part in document order."""
    if text is None:
        return
    try:
        root = _load(text)
    except ValueError as e:
        if "reject" in tags:
            yield "reject", part_id, None, None, None, None, None, str(e)[:200]
        return
    if not isinstance(root, dict):
        if "reject" in tags and root is not None:
            yield "reject", part_id, None, None, None, None, None, "the root is not an object"
        return
    nodes, attributes = "node" in tags, "attribute" in tags
    stack = [(root, None, 0, 0)]
    number = 0
    while stack:
        node, parent, seq, depth = stack.pop()
        if nodes:
            yield "node", part_id, number, parent, seq, depth, _text(node.get("name")), _text(node.get("text"))
        if attributes:
            for k, (name, value) in enumerate(_attributes(node)):
                yield "attribute", part_id, number, parent, k, depth, _text(name), _text(value)
        children = node.get("children")
        if isinstance(children, dict):
            stack.append((children, number, 0, depth + 1))
        elif isinstance(children, list):
            kept = [c for c in children if isinstance(c, dict)]
            for k in range(len(kept) - 1, -1, -1):
                stack.append((kept[k], number, k, depth + 1))
        number += 1


def emit(parts: DataFrame, tags: tuple[str, ...] = TAGS, rows_a_batch: int = 50_000) -> DataFrame:
    """Tagged rows of all parts; ``parts`` has part_id and node (JSON), other columns are ignored.

    A null part has no rows, one that is no JSON object gives one 'reject' row. Of repeated keys of
    an object the last counts. Repeated parts are kept, each under its own part_id. ``children`` may
    be a list, one node, null or absent; what is no object in it is no node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for part_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in visit(part_id, text, tags):
                    rows.append(row)
                    if len(rows) >= rows_a_batch:
                        yield flush()
        if rows:
            yield flush()

    return parts.select(F.col("part_id").cast("long"), F.col("node").cast("string")).mapInArrow(run, SCHEMA)


def typed_table(emitted: DataFrame, tag: str) -> DataFrame:
    """The flat table of a tag out of emitted rows."""
    return emitted.where(F.col("tag") == tag).select(*(F.col(a).alias(b) for a, b in TABLES[tag].items()))


def nodes(parts: DataFrame) -> DataFrame:
    return typed_table(emit(parts, ("node",)), "node")


def attributes(parts: DataFrame) -> DataFrame:
    return typed_table(emit(parts, ("attribute",)), "attribute")


def write_tables(parts: DataFrame, folder: str) -> None:
    """All tables in one pass, as Parquet below ``folder`` partitioned by tag."""
    emit(parts).write.partitionBy("tag").mode("overwrite").parquet(folder)


def read_table(spark, folder: str, tag: str) -> DataFrame:
    return typed_table(spark.read.schema(SCHEMA).parquet(folder), tag)
