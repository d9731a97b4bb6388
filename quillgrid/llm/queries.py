"""Queries of the operators for language-model data, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.llm import garbled, lookalike, merge_replay, mixture, reading_level, split
from quillgrid.session import table


def p1_found(spark, root):
    return lookalike.same_as_terms(*(table(spark, root, t) for t in ("cells", "text_boxes", "styled_spans", "term_catalog")))


def p1_forms(spark, root):
    return lookalike.unified(*(table(spark, root, t) for t in ("cells", "text_boxes", "styled_spans", "term_catalog")))


def p4_found(spark, root):
    return garbled.found(table(spark, root, "pdf_spans"), table(spark, root, "styled_spans"))


def p4_restored(spark, root):
    return garbled.restore(table(spark, root, "pdf_spans"), table(spark, root, "styled_spans"))


def p5_found(spark, root):
    return split.items(table(spark, root, "blocks"), table(spark, root, "slides"), table(spark, root, "split_limits")).select("item_kind", "item_id")


def p5_pieces(spark, root):
    return split.pieces(table(spark, root, "blocks"), table(spark, root, "slides"), table(spark, root, "split_limits"))


def p6_ids(spark, root):
    return merge_replay.encode(table(spark, root, "documents"))


#: Size of the mixture against the largest with exact target shares: a tenth more, so that the exponent is bisected.
STRETCH = 1.1


def p7_mixture(spark, root):
    return mixture.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"), stretch=STRETCH)


def p7_exact(spark, root):
    return mixture.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p7_shares(spark, root):
    return mixture.shares(table(spark, root, "documents"), table(spark, root, "mix_targets"), stretch=STRETCH)


def p8_found(spark, root):
    return reading_level.demanding(table(spark, root, "documents"), table(spark, root, "level_labels"))


def p8_levels(spark, root):
    documents = table(spark, root, "documents")
    return reading_level.levels(documents, reading_level.fit(documents, table(spark, root, "level_labels"))).select("doc_id", "words", F.round("level", 3).alias("level"))


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p4_found, p4_restored, p5_found, p5_pieces, p6_ids, p7_mixture, p7_exact, p7_shares, p8_found, p8_levels)}

ORACLE = {
    "p5_found": """
WITH b AS (SELECT doc_key, block_no, block_id, kind, coalesce(level, 1099511627776) AS level,
    coalesce(list_sum(list_transform(spans, lambda x: CASE WHEN x.kind = 'line_break' THEN 1 ELSE coalesce(length(x.text), 0) END)), 0) AS chars FROM blocks),
s AS (SELECT *, sum(chars) OVER (PARTITION BY doc_key ORDER BY block_no, block_id ROWS UNBOUNDED PRECEDING) - chars AS at FROM b),
e AS (SELECT h.block_id, (SELECT min(n.at) FROM s n WHERE n.doc_key = h.doc_key AND n.block_no > h.block_no AND n.kind = 'heading' AND n.level <= h.level) - h.at AS upto,
    (SELECT sum(t.chars) FROM s t WHERE t.doc_key = h.doc_key AND t.block_no >= h.block_no) AS rest FROM s h WHERE h.kind = 'heading'),
i AS (SELECT 'paragraph' AS item_kind, block_id AS item_id, chars FROM b WHERE kind = 'paragraph'
    UNION ALL SELECT 'section', block_id, coalesce(upto, rest) FROM e
    UNION ALL SELECT 'slide', slide_id, coalesce(list_sum(list_transform(elements, lambda x: CASE WHEN x.kind = 'text_box' THEN coalesce(length(x.text), 0) ELSE 0 END)), 0) FROM slides)
SELECT item_kind, item_id FROM i JOIN split_limits USING (item_kind) WHERE chars > max_chars""",
}
