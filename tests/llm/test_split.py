import unicodedata
from collections import defaultdict

import pytest

from quillgrid.llm import split

SPANS = "array<struct<kind:string,text:string,url:string>>"
BLOCKS = f"block_id long, doc_key string, block_no int, kind string, level int, spans {SPANS}, stream string, text string"
SLIDES = "slide_id long, elements array<struct<kind:string,text:string>>, at int"


def text_of(block):
    return "".join("\n" if s and s["kind"] == "line_break" else (s["text"] or "") if s else "" for s in block.spans or [])


def brute(blocks, slides):
    """Every item's text by plain loops over whole documents."""
    out, docs = {}, defaultdict(list)
    for b in blocks:
        docs[b.doc_key or ""].append(b)
    for rows in docs.values():
        rows.sort(key=lambda b: (b.block_no if b.block_no is not None else 0, b.block_id))
        for k, b in enumerate(rows):
            if b.kind == "paragraph":
                out["paragraph", b.block_id] = text_of(b)
            if b.kind == "heading":
                level, parts = b.level if b.level is not None else 1 << 40, [text_of(b)]
                for c in rows[k + 1 :]:
                    if c.kind == "heading" and (c.level if c.level is not None else 1 << 40) <= level:
                        break
                    parts.append(text_of(c))
                out["section", b.block_id] = "".join(parts)
    for s in slides:
        out["slide", s.slide_id] = "".join(e["text"] or "" for e in s.elements or [] if e and e["kind"] == "text_box")
    return out


def check(spark, blocks, slides, limits):
    want = brute(blocks.collect(), slides.collect())
    most = {r.item_kind: (r.max_chars, r.overlap_chars) for r in limits.collect()}
    over = {k: t for k, t in want.items() if k[0] in most and len(t) > most[k[0]][0]}
    assert {(r.item_kind, r.item_id) for r in split.items(blocks, slides, limits).collect()} == set(over)
    by = defaultdict(list)
    for r in split.pieces(blocks, slides, limits).collect():
        by[r.item_kind, r.item_id].append(r)
    assert set(by) == set(over)
    for key, rows in by.items():
        rows.sort(key=lambda r: r.piece_no)
        full, (high, overlap) = over[key], most[key[0]]
        assert [r.piece_no for r in rows] == list(range(len(rows))) and rows[0].start_char == 0 and rows[-1].end_char == len(full)
        for k, r in enumerate(rows):
            assert r.text == full[r.start_char : r.end_char] and 0 < len(r.text) <= high
            if k:
                shared = rows[k - 1].end_char - r.start_char
                assert min(overlap, high // 2) <= shared <= 1.5 * overlap + 1
    return by


def test_real_tables(spark, small):
    tables = [spark.read.parquet(f"{small}/{t}.parquet") for t in ("blocks", "slides", "split_limits")]
    assert check(spark, *tables)


@pytest.fixture
def limits(spark):
    return spark.createDataFrame([("paragraph", 40, 8), ("section", 100, 10), ("slide", 30, 0)], "item_kind string, max_chars int, overlap_chars int")


def test_odd_rows(spark, limits, monkeypatch):
    """Nulls, empty spans, unusual levels, ties, ranges and cells much smaller than documents, clashing names."""
    monkeypatch.setattr(split, "BLOCKS_A_RANGE", 3)
    monkeypatch.setattr(split, "CHARS_A_CELL", 128)
    words = "Words of a text. " * 9
    rows = []
    for k in range(40):
        kind = "heading" if k % 4 == 0 else "paragraph"
        level = [1, 3, 2, None, 9, 2, 0, 1][k // 4 % 8]
        spans = [("text", words[: k * 3], None), ("line_break", None, None), ("bold", None, "u"), ("text", "漢字é𝒳" * (k % 5), None)]
        rows.append((k, "d", 39 - k, kind, level if kind == "heading" else None, None if k == 7 else [] if k == 9 else spans, "x", "y"))
    rows += [(100, None, None, "paragraph", None, [("text", "z" * 90, None)], None, None), (101, "e", 0, None, None, None, None, None), (102, "f", 5, "heading", 1, [("text", "h" * 101, None)], None, None)]
    blocks = spark.createDataFrame(rows, BLOCKS)
    slides = spark.createDataFrame([(1, [("text_box", "a b " * 20), ("image", "no"), ("text_box", None)], 1), (2, None, 1), (3, [], 1), (4, [("text_box", "q" * 31)], None), (4, [("text_box", "q" * 29)], None)], SLIDES).where("slide_id < 4 or elements[0].text = repeat('q', 31)")
    check(spark, blocks, slides, limits)


def test_empty_tables(spark, limits):
    blocks, slides = spark.createDataFrame([], BLOCKS), spark.createDataFrame([], SLIDES)
    assert split.items(blocks, slides, limits).collect() == [] and split.pieces(blocks, slides, limits).collect() == []
    some = spark.createDataFrame([(1, "d", 0, "paragraph", None, [("text", "x" * 99, None)], "", "")], BLOCKS)
    assert split.items(some, slides, limits.limit(0)).collect() == []


def test_very_long_text(spark, limits):
    blocks = spark.createDataFrame([(1, "d", 0, "paragraph", None, [("text", "abc def. " * 30_000, None)], "", "")], BLOCKS)
    check(spark, blocks, spark.createDataFrame([], SLIDES), limits)


def test_boundaries():
    assert split.pick("one two three", 5, 9, set()) == 8
    assert split.pick("One. Two three", 2, 12, set()) == 5
    assert split.pick("One.\nTwo three. x", 2, 15, set()) == 5
    assert split.pick("abcdefgh", 2, 6, {4}) == 4
    assert split.pick("abcdefgh", 2, 6, set()) == 6
    marked = "e" + "́" * 3 + "x"
    assert not unicodedata.combining(marked[split.pick("abc" + marked, 1, 5, set()) - 3 :][:1] or "x") or split.pick("abc" + marked, 1, 5, set()) == 3
    assert split.pick("学校。橋南", 1, 4, set()) == 3
