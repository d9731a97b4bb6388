"""Queries over documents: text operators, blocks, grids of cells, workbook evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgrid.functions import texts
from quillgrid.operators import pdf_lines as printed
from quillgrid.operators import recalc
from quillgrid.operators.sessionlog import transform
from quillgrid.session import table
from quillgrid.sources import markup, sinks

QUERIES = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+|[\s\p{{Z}}\x{{85}}\x{{1c}}-\x{{1f}}]+$', '', 'g')"


@_add("entity_encode", "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS encoded FROM documents")
def entity_encode(spark, root):
    return table(spark, root, "documents").select("doc_id", texts.encode_entities(F.col("text")).alias("encoded"))


@_add("entity_decode", "SELECT doc_id, text FROM documents")
def entity_decode(spark, root):
    """Encoding and decoding again gives every text back."""
    return table(spark, root, "documents").select("doc_id", texts.decode_entities(texts.encode_entities(F.col("text"), True)).alias("text"))


@_add("html_to_text", r"SELECT doc_id, replace(replace(replace(replace(replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '<br>', chr(10)), '<br/>', chr(10)), '<br />', chr(10)), '</p>', chr(10) || chr(10)), '</div>', chr(10)), '<li>', '- '), '</li>', chr(10)), '</h1>', chr(10) || chr(10)), '</h2>', chr(10) || chr(10)), '</h3>', chr(10) || chr(10)), '(?s)<[^>]*(>|\z)', '', 'g'), '>', ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '""'), '&apos;', chr(39)), '&amp;', '&') AS plain FROM documents".replace("'\"\"'", "'\"'"))
def html_to_text(spark, root):
    return table(spark, root, "documents").select("doc_id", texts.html_to_text(F.col("text")).alias("plain"))


@_add("entity_numeric", "SELECT box_id, text, '&#38;amp; ' || text AS once FROM text_boxes WHERE text IS NOT NULL AND text NOT LIKE '%&%'")
def entity_numeric(spark, root):
    """Every character as a numeric entity, decimal or hexadecimal, and back; what an entity gives is not decoded again."""
    boxes = table(spark, root, "text_boxes").where(F.col("text").isNotNull() & ~F.col("text").contains("&"))
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10)
    numbered = F.array_join(F.transform(chars, lambda c, i: F.when(i % 2 == 0, F.concat(F.lit("&#"), code(c), F.lit(";"))).otherwise(F.concat(F.lit("&#x"), F.lower(F.conv(code(c), 10, 16)), F.lit(";")))), "")
    return boxes.select("box_id", texts.decode_entities(numbered).alias("text"), texts.decode_entities(F.concat(F.lit("&#38;#38;amp; "), "text")).alias("once"))


@_add("text_to_paragraphs", "SELECT doc_id, p AS paragraph FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10) || chr(10)), lambda x: " + _TRIM.format("x") + ")) AS p FROM documents) WHERE p <> ''")
def text_to_paragraphs(spark, root):
    return table(spark, root, "documents").select("doc_id", F.explode(texts.paragraphs(F.col("text"))).alias("paragraph"))


@_add("sniff_text_format", "SELECT doc_id, CASE WHEN contains(t, '<svg') THEN 'svg' WHEN starts_with(t, '<!doctype html') OR starts_with(t, '<html') OR contains(t, '<body') THEN 'html' WHEN starts_with(t, '#') OR contains(t, chr(10) || '# ') OR contains(t, chr(10) || '- ') THEN 'md' WHEN contains(t, ',') AND regexp_matches(t, '(?s)\\n.') THEN 'csv' WHEN t <> '' THEN 'txt' END AS format FROM (SELECT doc_id, ltrim(text, chr(65279)) AS t FROM documents)")
def sniff_text_format(spark, root):
    return table(spark, root, "documents").select("doc_id", texts.sniff_text(F.col("text")).alias("format"))


@_add("md_block_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^#{1,6}[^#\\s]') OR regexp_matches(t, '^#{1,6}[\\s]+[^\\s]') THEN 'heading' WHEN t IN ('---', '***') THEN 'rule' WHEN regexp_matches(t, '^[-*] ') THEN 'list' WHEN starts_with(t, '|') AND ends_with(t, '|') THEN 'table' ELSE 'text' END AS kind FROM (SELECT " + _TRIM.format("l") + " AS t FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents))) GROUP BY kind")
def md_block_kinds(spark, root):
    lines = table(spark, root, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(texts.block_kind(F.col("line")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@_add("text_transform", "SELECT box_id, upper(replace(text, 'ß', 'SS')) AS upper, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(range(CAST(length(text) AS BIGINT), 0, -1), lambda i: text[i]), '') END AS backwards, lower(text) AS lower FROM text_boxes")
def text_transform(spark, root):
    """Every text box: case by Unicode, reversal by code points."""
    t = F.col("text")
    return table(spark, root, "text_boxes").select("box_id", transform(t, "uppercase").alias("upper"), transform(t, "reverse").alias("backwards"), transform(t, "lowercase").alias("lower"))


@_add("title_case", r"SELECT box_id, array_to_string(list_transform(regexp_extract_all(text, '[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+'), lambda w: CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END || lower(w[2:])), '') AS title FROM text_boxes")
def title_case(spark, root):
    return table(spark, root, "text_boxes").select("box_id", transform(F.col("text"), "titlecase").alias("title"))


@_add("slug", "SELECT doc_key, regexp_replace(regexp_replace(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM office_docs")
def slug(spark, root):
    return table(spark, root, "office_docs").select("doc_key", texts.slug(F.col("title")).alias("slug"))


@_add("roman_numerals", "SELECT DISTINCT p_size, ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][p_size // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_size % 10 + 1] AS roman FROM part")
def roman_numerals(spark, root):
    return table(spark, root, "part").select("p_size").distinct().select("p_size", texts.roman(F.col("p_size")).alias("roman"))


@_add("token_jaccard", """WITH w AS (SELECT doc_id, page_id, rev_id, parent_rev_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{Nd}\\p{Nl}\\p{M}\\p{Pc}\\x{200c}\\x{200d}]+')) AS t FROM documents)
SELECT a.doc_id, b.doc_id AS parent_id, round(CASE WHEN len(a.t) = 0 AND len(b.t) = 0 THEN 100 ELSE len(list_intersect(a.t, b.t)) * 100.0 / len(list_distinct(list_concat(a.t, b.t))) END, 4) AS similarity FROM w a JOIN w b ON a.parent_rev_id = b.rev_id AND a.page_id = b.page_id""")
def token_jaccard(spark, root):
    """Likeness of the whole texts of every revision and the one it follows, a null text as an empty one."""
    d = table(spark, root, "documents").select("doc_id", "page_id", "rev_id", "parent_rev_id", F.coalesce("text", F.lit("")).alias("t"))
    parent = d.select(F.col("doc_id").alias("parent_id"), F.col("page_id").alias("p_page"), F.col("rev_id").alias("p_rev"), F.col("t").alias("p_t"))
    return d.join(parent, (F.col("parent_rev_id") == F.col("p_rev")) & (F.col("page_id") == F.col("p_page"))).select("doc_id", "parent_id", F.round(texts.token_jaccard(F.col("t"), F.col("p_t")), 4).alias("similarity"))


@_add("blocks_plain_text", "SELECT block_id, coalesce(array_to_string(list_transform(spans, lambda x: CASE WHEN x.kind = 'line_break' THEN chr(10) ELSE coalesce(x.text, '') END), ''), '') AS plain FROM blocks")
def blocks_plain_text(spark, root):
    parts = F.transform("spans", lambda x: F.when(x["kind"] == "line_break", F.lit("\n")).otherwise(F.coalesce(x["text"], F.lit(""))))
    return table(spark, root, "blocks").select("block_id", F.coalesce(F.array_join(parts, ""), F.lit("")).alias("plain"))


@_add("running_headings", "SELECT doc_key, block_id, row_number() OVER (PARTITION BY doc_key ORDER BY block_no, block_id) AS n FROM blocks WHERE kind = 'heading'")
def running_headings(spark, root):
    """Headings numbered in order of the document: numbers within ranges of blocks, shifted by the counts of
    the ranges before, so that no task orders a whole document."""
    h = table(spark, root, "blocks").where(F.col("kind") == "heading").select("doc_key", "block_id", "block_no", F.floor(F.col("block_no") / 2048).alias("part"))
    before = h.groupBy("doc_key", "part").count().withColumn("before", F.sum("count").over(W.partitionBy("doc_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    within = F.row_number().over(W.partitionBy("doc_key", "part").orderBy("block_no", "block_id"))
    numbered = h.withColumn("k", within).join(before, ["doc_key", "part"])
    return numbered.select("doc_key", "block_id", (F.col("k") + F.coalesce("before", F.lit(0))).cast("bigint").alias("n"))


@_add("md_inline_spans", None)
def md_inline_spans(spark, root):
    spans = F.pandas_udf(lambda s: s.map(lambda t: [(x["kind"], x["text"], x["url"]) for x in markup.inline_spans(t)] if t is not None else []), "array<struct<kind:string,text:string,url:string>>")
    return table(spark, root, "text_boxes").select("box_id", F.explode(spans("text")).alias("s")).select("box_id", "s.*")


@_add("slide_text", "SELECT slide_id, coalesce(array_to_string(list_transform(list_filter(elements, lambda x: x.kind = 'text_box' AND x.text IS NOT NULL), lambda x: x.text), chr(10)), '') AS text FROM slides")
def slide_text(spark, root):
    boxes = F.filter("elements", lambda x: (x["kind"] == "text_box") & x["text"].isNotNull())
    return table(spark, root, "slides").select("slide_id", F.coalesce(F.array_join(F.transform(boxes, lambda x: x["text"]), "\n"), F.lit("")).alias("text"))


@_add("pdf_lines", "SELECT doc_key, page_no, line_no, string_agg(text, ' ' ORDER BY x, span_id) AS line FROM pdf_spans WHERE text <> '' GROUP BY ALL")
def pdf_lines(spark, root):
    """Text of every printed line: spans from left to right. A group is one line of a page."""
    s = table(spark, root, "pdf_spans").where(F.col("text") != "")
    parts = F.array_sort(F.collect_list(F.struct("x", "span_id", "text")))
    return s.groupBy("doc_key", "page_no", "line_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("line"))


@_add("pdf_line_reconstruction", None)
def pdf_line_reconstruction(spark, root):
    """Lines told from positions alone."""
    return printed.reconstruct(table(spark, root, "pdf_spans"))


# -- cells --------------------------------------------------------------------------------------------------


@_add("latest_cells", "SELECT doc_key, sheet_no, row_no, col_no, kind, value, num, flag FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, sheet_no, row_no, col_no ORDER BY loaded_at DESC, cell_id DESC) AS r FROM cells) WHERE r = 1".replace("sheet_no, row_no, col_no, kind", "coalesce(sheet, '#' || CAST(sheet_no AS VARCHAR)) AS sheet, row_no, col_no, kind", 1))
def latest_cells(spark, root):
    return recalc.latest(table(spark, root, "cells"))


_GRID = """WITH l AS (SELECT * FROM (SELECT doc_key, coalesce(sheet, '#' || CAST(sheet_no AS VARCHAR)) AS sheet, row_no, col_no, kind, value, num, flag, row_number() OVER (PARTITION BY doc_key, sheet_no, row_no, col_no ORDER BY loaded_at DESC, cell_id DESC) AS place FROM cells) WHERE place = 1),
s AS (SELECT doc_key, sheet, coalesce(max(row_no) FILTER (kind <> 'empty'), 0) AS rows, coalesce(max(col_no) FILTER (kind <> 'empty'), 0) AS cols, count(*) FILTER (kind <> 'empty') AS cells FROM l GROUP BY ALL),
g AS (SELECT doc_key, sheet, cells, cols, r AS row_no, k AS col_no FROM s, unnest(range(rows + 1)) a(r), unnest(range(cols + 1)) b(k)),
t AS (SELECT g.doc_key, g.sheet, g.cells, g.cols, g.row_no, g.col_no, kind, coalesce(CASE kind WHEN 'number' THEN regexp_replace(CAST(num AS VARCHAR), '[.]0$', '') WHEN 'bool' THEN CAST(flag AS VARCHAR) WHEN 'formula' THEN '=' || value ELSE value END, '') AS v FROM g LEFT JOIN l ON l.doc_key = g.doc_key AND l.sheet = g.sheet AND l.row_no = g.row_no AND l.col_no = g.col_no)
"""


@_add("sheet_grid_csv", _GRID + """SELECT doc_key, sheet, row_no, string_agg(CASE WHEN contains(f, ',') OR contains(f, '"') OR contains(f, chr(10)) THEN '"' || replace(f, '"', '""') || '"' ELSE f END, ',' ORDER BY col_no) AS line FROM (SELECT *, CASE WHEN kind = 'error' THEN '#ERR ' || v ELSE v END AS f FROM t) GROUP BY doc_key, sheet, row_no""")
def sheet_grid_csv(spark, root):
    return sinks.csv_lines(recalc.latest(table(spark, root, "cells")))


@_add("sheet_grid_markdown", _GRID + """SELECT doc_key, sheet, row_no, CASE WHEN min(cells) = 0 THEN '(empty sheet)' ELSE '| ' || string_agg(replace(v, '|', '\\|'), ' | ' ORDER BY col_no) || ' |' || CASE WHEN row_no = 0 THEN chr(10) || '|' || repeat(' --- |', min(cols) + 1) ELSE '' END END AS line FROM t GROUP BY doc_key, sheet, row_no""")
def sheet_grid_markdown(spark, root):
    return sinks.markdown_lines(recalc.latest(table(spark, root, "cells")))


@_add("recalc_values", None)
def recalc_values(spark, root):
    return recalc.evaluate(recalc.latest(table(spark, root, "cells")))


@_add("recalc_report", None)
def recalc_report(spark, root):
    cells = table(spark, root, "cells")
    return recalc.errors(recalc.evaluate(recalc.latest(cells)), cells.select("doc_key", recalc.sheet_name().alias("sheet"), "sheet_no"))


@_add("recalc_status", None)
def recalc_status(spark, root):
    """Status and totals of every workbook with formulas."""
    return recalc.report(recalc.evaluate(recalc.latest(table(spark, root, "cells"))))


@_add("stored_error_report", "SELECT value AS error, count(*) AS n FROM cells WHERE kind = 'error' GROUP BY value")
def stored_error_report(spark, root):
    return table(spark, root, "cells").where(F.col("kind") == "error").groupBy(F.col("value").alias("error")).agg(F.count("*").alias("n"))


@_add("bare_table_types", "SELECT kind, count(*) AS n, count(value) AS texts, count(num) AS numbers, count(flag) AS flags FROM cells GROUP BY kind")
def bare_table_types(spark, root):
    return table(spark, root, "cells").groupBy("kind").agg(F.count("*").alias("n"), F.count("value").alias("texts"), F.count("num").alias("numbers"), F.count("flag").alias("flags"))
