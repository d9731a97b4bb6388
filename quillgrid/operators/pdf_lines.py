"""Lines of printed pages from positioned spans: spans whose baseline is near the first one's of the line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "doc_key string, page_no int, line int, y double, spans int, text string"
_ARROW = pa.schema([("doc_key", pa.string()), ("page_no", pa.int32()), ("line", pa.int32()), ("y", pa.float64()), ("spans", pa.int32()), ("text", pa.string())])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come page by page from top to bottom; only the line at hand is held."""
    out: list[tuple] = []
    page, number, line = None, 0, []

    def end() -> None:
        if line:
            parts = sorted(line)
            out.append((*page, number, line[0][2], len(line), " ".join(t for _, _, _, t in parts)))

    for batch in batches:
        for doc, page_no, y, x, span, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (doc, page_no) != page:
                end()
                page, number, line = (doc, page_no), 1, []
            elif line and abs(line[0][2] - y) > max(2.0, 0.3 * (size or 0.0)):
                end()
                number, line = number + 1, []
            line.append((x, span, y, text))
        columns = list(zip(*out, strict=True)) if out else [()] * len(_ARROW)
        out.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
    end()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def reconstruct(spans: DataFrame) -> DataFrame:
    """doc_key, page_no, line (from 1, top down), y, spans and text of every line.

    Spans without text or position are left out; a null document or page counts as one of its own.
    Pages are the unit of work, whatever share of all pages a document has; rows stream in order, so
    a page is never held. Other columns are ignored.
    """
    rows = spans.where((F.col("text") != "") & F.col("x").isNotNull() & F.col("y").isNotNull()).select("doc_key", F.col("page_no").cast("int").alias("page_no"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("span_id").cast("long").alias("span_id"), F.col("font_size").cast("double").alias("font_size"), "text")
    return rows.repartition("doc_key", "page_no").sortWithinPartitions("doc_key", "page_no", F.desc("y"), "x", "span_id").mapInArrow(_grouped, _SCHEMA)
