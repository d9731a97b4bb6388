"""Splitting oversized items at natural boundaries, range by range.

The blocks of a document form one stream of characters. Ranges of blocks (not whole documents) are
the unit of work: every range sums its lengths and resolves the section starts and ends it can see;
what stays open is stitched over the small per-range tables, which also give each range its offset
(prefix sum). Cuts lie in windows at a fixed grid of offsets of the item, so each is found from
the text around it alone (the halo), and pieces are then put together by offset: no task ever holds
a document, and a document with a third of all blocks is spread like any other.

With max = max_chars and overlap = overlap_chars, cut k is the best boundary in
(k*step - slack, k*step], and piece k begins at the best start in
[cut - overlap - more, cut - overlap], where step = max - overlap - slack - more. So a piece is never longer
than max, and consecutive pieces share between overlap and overlap + more characters, or fewer where
the cut is nearer than that to the item's start. ``slack`` and ``more`` follow from the limits
(see ``plan``); where max leaves no room, pieces may share less.

Boundaries, best first: the end of a block or a line break; the end of a sentence;
white space; else any position that does not part a base character from its combining marks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks of a document are ranged by block_no; characters of a stream by offset.
BLOCKS_A_RANGE = 2048
CHARS_A_CELL = 1 << 15

_SENTENCE = re.compile(r"[.!?…]['\"”’)\]]*\s|[。！？．]")
_SPACE = re.compile(r"\s")


def span_chars(kind: Column, text: Column) -> Column:
    """Characters (code points) of one span: a line break counts one, a null text none."""
    return F.when(kind == "line_break", F.lit(1)).otherwise(F.coalesce(F.char_length(text), F.lit(0)))


def blocks_chars() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(span_chars(x["kind"], x["text"]), F.lit(0)))


def blocks_text() -> Column:
    return F.concat_ws("", F.transform("spans", lambda x: F.when(x["kind"] == "line_break", F.lit("\n")).otherwise(x["text"])))


def slide_text() -> Column:
    boxes = F.filter("elements", lambda x: x["kind"] == "text_box")
    return F.coalesce(F.concat_ws("", F.transform(boxes, lambda x: x["text"])), F.lit(""))


def slide_chars() -> Column:
    return F.aggregate("elements", F.lit(0).cast("long"), lambda n, x: n + F.when(x["kind"] == "text_box", F.coalesce(F.char_length(x["text"]), F.lit(0))).otherwise(0))


_RANGE_OUT = "kind string, doc_key string, range_no long, seq long, block_id long, level long, at long, chars long"
_RANGE_ARROW = pa.schema([("kind", pa.string()), ("doc_key", pa.string()), *((c, pa.int64()) for c in ("range_no", "seq", "block_id", "level", "at", "chars"))])
_NO_LEVEL = 1 << 40


def _range_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: block offsets within it, closed sections, open ones, closing levels and the total.

    Rows come sorted by (doc_key, range_no, block_no, block_id). A heading closes every open section
    of its level or a deeper one, so open ones have rising levels: few, whatever the range holds.
    """
    out: list[tuple] = []
    state: dict = {"key": None}

    def finish() -> None:
        if state["key"] is None:
            return
        doc, no = state["key"]
        for seq, (level, at, block) in enumerate(state["open"]):
            out.append(("open", doc, no, seq, block, level, at, None))
        for seq, (level, at) in enumerate(state["closers"]):
            out.append(("closer", doc, no, seq, None, level, at, None))
        out.append(("total", doc, no, 0, None, None, None, state["at"]))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(_RANGE_ARROW)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RANGE_ARROW, strict=True)], schema=_RANGE_ARROW)

    for batch in batches:
        for doc, no, block, heading, level, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (doc, no) != state["key"]:
                finish()
                state = {"key": (doc, no), "at": 0, "open": [], "closers": [], "least": None}
            if heading:
                # a heading without level is deeper than any: it closes only its like
                level = _NO_LEVEL if level is None else level
                while state["open"] and state["open"][-1][0] >= level:
                    _, at, opened = state["open"].pop()
                    out.append(("section", doc, no, 0, opened, None, at, state["at"] - at))
                state["open"].append((level, state["at"], block))
                if state["least"] is None or level < state["least"]:
                    state["least"] = level
                    state["closers"].append((level, state["at"]))
            out.append(("block", doc, no, 0, block, None, state["at"], chars))
            state["at"] += chars
            if len(out) >= 50_000:
                yield flush()
    finish()
    if out:
        yield flush()


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the range tables of a document in order: sections that span ranges, and each range's offset."""
    out: list[tuple] = []
    doc_now, stack, base = None, [], 0
    waiting: dict = {}

    def end_range() -> None:
        nonlocal base
        if not waiting:
            return
        for level, at in waiting["closers"]:
            while stack and stack[-1][0] >= level:
                _, start, block = stack.pop()
                out.append(("section", doc_now, None, 0, block, None, start, base + at - start))
        for level, at, block in waiting["open"]:
            stack.append((level, base + at, block))
        out.append(("offset", doc_now, waiting["no"], 0, None, None, base, waiting["total"]))
        base += waiting["total"]
        waiting.clear()

    def end_doc() -> None:
        end_range()
        for _, start, block in stack:
            out.append(("section", doc_now, None, 0, block, None, start, base - start))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(_RANGE_ARROW)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RANGE_ARROW, strict=True)], schema=_RANGE_ARROW)

    for batch in batches:
        rows = batch.to_pydict()
        for kind, doc, no, block, level, at, chars in zip(rows["kind"], rows["doc_key"], rows["range_no"], rows["block_id"], rows["level"], rows["at"], rows["chars"], strict=True):
            if doc != doc_now:
                if doc_now is not None:
                    end_doc()
                doc_now, stack, base = doc, [], 0
            if not waiting or waiting["no"] != no:
                end_range()
                waiting.update(no=no, closers=[], open=[], total=0)
            if kind == "closer":
                waiting["closers"].append((level, at))
            elif kind == "open":
                waiting["open"].append((level, at, block))
            else:
                waiting["total"] = chars
        if len(out) >= 50_000:
            yield flush()
    if doc_now is not None:
        end_doc()
    if out:
        yield flush()


def ranges(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Block offsets and closed sections by range, and the stitched rest.

    Both have the columns of ``_RANGE_OUT``; offsets of the first are within the range.
    """
    rows = blocks.select(
        F.coalesce("doc_key", F.lit("")).alias("doc_key"),
        F.floor(F.coalesce("block_no", F.lit(0)) / BLOCKS_A_RANGE).cast("long").alias("range_no"),
        F.col("block_id").cast("long").alias("block_id"),
        F.coalesce(F.col("kind") == "heading", F.lit(False)).alias("heading"),
        F.col("level").cast("long").alias("level"),
        F.coalesce(blocks_chars(), F.lit(0)).cast("long").alias("chars"),
        F.coalesce("block_no", F.lit(0)).alias("block_no"),
    )
    local = rows.repartition("doc_key", "range_no").sortWithinPartitions("doc_key", "range_no", "block_no", "block_id").drop("block_no").mapInArrow(_range_tables, _RANGE_OUT)
    rest = local.where(F.col("kind").isin("open", "closer", "total")).repartition("doc_key").sortWithinPartitions("doc_key", "range_no", "kind", "seq").mapInArrow(_stitch, _RANGE_OUT)
    return local, rest


def limits(split_limits: DataFrame) -> DataFrame:
    """One row a kind; of repeated ones the smallest limit holds. Bounded by the three kinds."""
    return split_limits.where(F.col("max_chars") > 0).groupBy("item_kind").agg(F.min("max_chars").cast("long").alias("max_chars"), F.min(F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0))).cast("long").alias("overlap_chars"))


def items(blocks: DataFrame, slides: DataFrame, split_limits: DataFrame) -> DataFrame:
    """Every item above its limit: item_kind, item_id, chars, stream, range_no, at, max_chars, overlap_chars.

    ``at`` is the item's offset in its range's or document's text (range_no null: in the document's).
    Blocks without spans have no characters; a kind without a limit has no oversized items. Slides
    that were delivered twice are two items, as their ids differ.
    """
    local, rest = ranges(blocks)
    paragraph = blocks.where(F.col("kind") == "paragraph").select(F.lit("paragraph").alias("item_kind"), F.col("block_id").cast("long").alias("item_id"), F.coalesce(blocks_chars(), F.lit(0)).alias("chars"))
    section = local.where(F.col("kind") == "section").select("block_id", "chars").unionByName(rest.where(F.col("kind") == "section").select("block_id", "chars")).select(F.lit("section").alias("item_kind"), F.col("block_id").alias("item_id"), "chars")
    slide = slides.select(F.lit("slide").alias("item_kind"), F.col("slide_id").cast("long").alias("item_id"), F.coalesce(slide_chars(), F.lit(0)).alias("chars"))
    # split_limits has one row for each kind of item, so this broadcast is bounded
    every = paragraph.unionByName(section).unionByName(slide)
    return every.join(F.broadcast(limits(split_limits)), "item_kind").where(F.col("chars") > F.col("max_chars"))


def plan(max_chars: Column, overlap: Column) -> dict[str, Column]:
    """Grid of cuts from the limits; with any limit of at least 1 the step is at least 1."""
    overlap = F.least(overlap, F.floor(max_chars / 2))
    more = F.least(F.floor(overlap / 2), F.floor((max_chars - overlap) / 8))
    slack = F.floor((max_chars - overlap - more) / 4)
    return {"overlap": overlap.cast("long"), "more": more.cast("long"), "slack": slack.cast("long"), "step": F.greatest(max_chars - overlap - more - slack, F.lit(1)).cast("long")}


def streams(blocks: DataFrame, slides: DataFrame, local: DataFrame, rest: DataFrame) -> DataFrame:
    """Fragments of text by stream and offset: stream, at, text, block_id; none crosses a cell."""
    offsets = rest.where(F.col("kind") == "offset").select("doc_key", "range_no", F.col("at").alias("base"))
    placed = local.where((F.col("kind") == "block") & (F.col("chars") > 0)).join(offsets, ["doc_key", "range_no"]).select("block_id", F.concat(F.lit("d"), "doc_key").alias("stream"), (F.col("base") + F.col("at")).alias("at"))
    texts = blocks.select(F.col("block_id").cast("long").alias("block_id"), blocks_text().alias("text"))
    of_blocks = placed.join(texts, "block_id").select("stream", "at", "text", "block_id")
    of_slides = slides.select(F.concat(F.lit("s"), F.col("slide_id").cast("string")).alias("stream"), F.lit(0).cast("long").alias("at"), slide_text().alias("text"), F.lit(None).cast("long").alias("block_id"))
    whole = of_blocks.unionByName(of_slides).where(F.char_length("text") > 0)
    first = F.floor(F.col("at") / CHARS_A_CELL)
    final = F.floor((F.col("at") + F.char_length("text") - 1) / CHARS_A_CELL)
    cells = whole.withColumn("cell", F.explode(F.sequence(first, final)))
    low = F.greatest(F.col("at"), F.col("cell") * CHARS_A_CELL)
    high = F.least(F.col("at") + F.char_length("text"), (F.col("cell") + 1) * CHARS_A_CELL)
    return cells.select(
        "stream", "cell", low.alias("frag_at"), F.substring("text", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("text"),
        (high == F.col("at") + F.char_length("text")).alias("ends"), "block_id",
    )


def pick(text: str, low: int, high: int, ends: set[int]) -> int:
    """The best boundary in [low, high] of a text; ``ends`` has positions after whole blocks.

    Of equally good ones the last counts.
    """
    high = min(high, len(text))
    low = max(0, min(low, high))
    best = [p for p in ends if low <= p <= high]
    best += [p + 1 for p in (text.rfind("\n", max(0, low - 1), high),) if p >= 0 and low <= p + 1 <= high]
    if best:
        return max(best)
    at = -1
    for m in _SENTENCE.finditer(text, max(0, low - 8), min(len(text), high + 1)):
        if low <= m.end() <= high:
            at = m.end()
    if at >= 0:
        return at
    for p in range(high, low - 1, -1):
        if p > 0 and text[p - 1].isspace():
            return p
    p = high
    while p > low and p < len(text) and (unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍"):
        p -= 1
    return p


def _cuts(window: pd.Series, ends: pd.Series, begin: pd.Series, grid: pd.Series, slack: pd.Series, overlap: pd.Series, more: pd.Series) -> pd.DataFrame:
    """Cut and next start of each window; ``begin`` is the offset in the item of the window's text."""
    cuts, starts = [], []
    for text, marks, b, g, s, o, m in zip(window, ends, begin, grid, slack, overlap, more, strict=True):
        inner = {int(e) - b for e in marks} if marks is not None else set()
        cut = pick(text, g - s + 1 - b, g - b, inner)
        start = pick(text, cut - o - m, cut - o, inner) if o else cut
        cuts.append(b + cut)
        starts.append(b + max(0, start))
    return pd.DataFrame({"cut": cuts, "start": starts})


def _joined(wanted: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Text of [low, high) of streams: joined by cell, cut to the range, put together in order."""
    parts = (
        wanted.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / CHARS_A_CELL), F.floor((F.col("high") - 1) / CHARS_A_CELL))))
        .join(fragments, ["stream", "cell"])
        .where((F.col("frag_at") < F.col("high")) & (F.col("frag_at") + F.char_length("text") > F.col("low")))
    )
    begin = F.greatest(F.col("frag_at"), F.col("low"))
    end = F.least(F.col("frag_at") + F.char_length("text"), F.col("high"))
    piece = F.struct(begin.alias("from"), F.substring("text", (begin - F.col("frag_at") + 1).cast("int"), (end - begin).cast("int")).alias("text"), (F.col("ends") & (end == F.col("frag_at") + F.char_length("text"))).alias("ends"), end.alias("to"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("parts"))


def pieces(blocks: DataFrame, slides: DataFrame, split_limits: DataFrame) -> DataFrame:
    """The pieces of every oversized item.

    Columns item_kind, item_id, piece_no (from 0), start_char and end_char (offsets in the item, the
    end excluded) and text. Pieces cover the whole item, none is longer than max_chars, and each
    begins before the one before ends, by about overlap_chars. Items within the limit have none. A
    group here is one window or piece, so it is bounded by max_chars.
    """
    local, rest = ranges(blocks)
    fragments = streams(blocks, slides, local, rest)
    offsets = rest.where(F.col("kind") == "offset").select("doc_key", "range_no", F.col("at").alias("base"))
    d = F.concat(F.lit("d"), "doc_key").alias("stream")
    inside = local.join(offsets, ["doc_key", "range_no"]).withColumn("at", F.col("base") + F.col("at"))
    section = inside.where(F.col("kind") == "section").select(F.lit("section").alias("item_kind"), F.col("block_id").alias("item_id"), d, "at", "chars").unionByName(
        rest.where(F.col("kind") == "section").select(F.lit("section").alias("item_kind"), F.col("block_id").alias("item_id"), d, "at", "chars")
    )
    paragraphs = blocks.where(F.col("kind") == "paragraph").select(F.col("block_id").cast("long").alias("block_id"))
    paragraph = inside.where(F.col("kind") == "block").join(paragraphs, "block_id", "left_semi").select(F.lit("paragraph").alias("item_kind"), F.col("block_id").alias("item_id"), d, "at", "chars")
    slide = slides.select(F.lit("slide").alias("item_kind"), F.col("slide_id").cast("long").alias("item_id"), F.concat(F.lit("s"), F.col("slide_id").cast("string")).alias("stream"), F.lit(0).cast("long").alias("at"), F.coalesce(slide_chars(), F.lit(0)).alias("chars"))
    over = paragraph.unionByName(section).unionByName(slide).join(F.broadcast(limits(split_limits)), "item_kind").where(F.col("chars") > F.col("max_chars"))
    grid = over.select("item_kind", "item_id", "stream", "at", "chars", *(c.alias(n) for n, c in plan(F.col("max_chars"), F.col("overlap_chars")).items()))
    item = ["item_kind", "item_id"]
    windows = grid.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("chars") - 1) / F.col("step"))))).withColumn("grid", F.col("k") * F.col("step"))
    # the halo: as far back as the next piece may begin, and a little beyond the grid point
    begin = F.greatest(F.lit(0), F.col("grid") - F.col("slack") - F.col("overlap") - F.col("more"))
    windows = windows.withColumn("begin", begin).withColumn("low", F.col("at") + begin).withColumn("high", F.col("at") + F.least(F.col("chars"), F.col("grid") + 2))
    read = _joined(windows, fragments, [*item, "k", "stream", "at", "chars", "begin", "grid", "slack", "overlap", "more"])
    texts = read.withColumn("window", F.array_join(F.transform("parts", lambda p: p["text"]), "")).withColumn(
        "ends", F.transform(F.filter("parts", lambda p: p["ends"]), lambda p: p["to"] - F.col("at"))
    )
    choose = F.pandas_udf(_cuts, T.StructType([T.StructField("cut", T.LongType()), T.StructField("start", T.LongType())]))
    cut = texts.select(*item, "k", "stream", "at", "chars", choose("window", "ends", "begin", "grid", "slack", "overlap", "more").alias("c")).select(*item, "k", "stream", "at", "chars", "c.cut", "c.start")
    # cut k ends piece k - 1 and begins piece k; the first piece begins at 0, the last ends with the item
    ends = cut.select(*item, (F.col("k") - 1).alias("piece_no"), "stream", "at", "chars", F.col("cut").alias("to"), F.when(F.col("k") == 1, F.lit(0)).cast("long").alias("from"))
    begins = cut.select(*item, F.col("k").alias("piece_no"), "stream", "at", "chars", F.lit(None).cast("long").alias("to"), F.col("start").alias("from"))
    bounds = ends.unionByName(begins).groupBy(*item, "piece_no").agg(F.first("stream").alias("stream"), F.first("at").alias("at"), F.first("chars").alias("chars"), F.max("from").alias("start_char"), F.coalesce(F.max("to"), F.first("chars")).alias("end_char"))
    wanted = bounds.withColumn("low", F.col("at") + F.col("start_char")).withColumn("high", F.col("at") + F.col("end_char"))
    done = _joined(wanted, fragments, [*item, "piece_no", "start_char", "end_char"])
    return done.select(*item, "piece_no", "start_char", "end_char", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
