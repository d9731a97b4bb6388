"""Queries over the office tables that clean data on its way in: failing records, nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import error_parse, shred
from quillgrid.session import table


def p2_found(spark, root):
    return error_parse.failing_rows(table(spark, root, "raw_sample")).select("row_id", "reason")


def p2_valid(spark, root):
    return error_parse.valid_rows(table(spark, root, "raw_sample"))


def p2_failing(spark, root):
    return error_parse.failing_rows(table(spark, root, "raw_sample"))


def p3_found(spark, root):
    return shred.nodes(table(spark, root, "xml_parts")).where(F.col("parent_no").isNotNull()).select("part_id", "parent_no", "node_no")


def p3_nodes(spark, root):
    return shred.nodes(table(spark, root, "xml_parts"))


def p3_attributes(spark, root):
    return shred.attributes(table(spark, root, "xml_parts"))


QUERIES = {f.__name__: f for f in (p2_found, p2_valid, p2_failing, p3_found, p3_nodes, p3_attributes)}

_BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_FIELD = r'((?:[^",]|"[^"]*")*)'
# three fields of a record whose quotes are even in number; a doubled quote inside quotes is a literal one
_PARSED = rf"""
WITH r AS (SELECT row_id, file_id, line_no, replace(record, chr(13), '') AS record FROM raw_sample WHERE line_no > 1),
f AS (SELECT row_id, file_id, line_no, record IS NULL AS missing, (length(record) - length(replace(record, '"', ''))) % 2 = 1 AS odd,
  regexp_full_match(record, '(?s){_FIELD},{_FIELD},{_FIELD}') AS three,
  regexp_extract(record, '(?s)^{_FIELD},', 1) AS n0,
  regexp_extract(record, '(?s)^(?:[^",]|"[^"]*")*,{_FIELD},', 1) AS a0,
  regexp_extract(record, '(?s)^(?:[^",]|"[^"]*")*,(?:[^",]|"[^"]*")*,{_FIELD}$', 1) AS b0 FROM r),
v AS (SELECT row_id, file_id, line_no, missing, odd, three, n0,
  CASE WHEN regexp_matches(a0, '^[^"]*("[^"]*"[^"]+)*"[^"]*""') THEN 'x' ELSE regexp_replace(replace(a0, '"', ''), '^{_BLANK}+|{_BLANK}+$', '', 'g') END AS age,
  CASE WHEN regexp_matches(b0, '^[^"]*("[^"]*"[^"]+)*"[^"]*""') THEN 'x' ELSE lower(regexp_replace(replace(b0, '"', ''), '^{_BLANK}+|{_BLANK}+$', '', 'g')) END AS active FROM f),
g AS (SELECT *, CASE WHEN missing THEN 'columns' WHEN odd THEN 'quoting' WHEN NOT three THEN 'columns'
  WHEN age <> '' AND NOT (regexp_full_match(age, '[+-]?[0-9]+') AND try_cast(ltrim(age, '+') AS BIGINT) IS NOT NULL) THEN 'age'
  WHEN active NOT IN ('', 'true', 'false') THEN 'active' END AS reason FROM v)
"""

ORACLE = {
    "p2_found": _PARSED + "SELECT row_id, reason FROM g WHERE reason IS NOT NULL",
    # a carriage return inside quotes belongs to the name
    "p2_valid": _PARSED.replace(
        "replace(record, chr(13), '') AS record FROM",
        """array_to_string(list_transform(regexp_extract_all(record, '"(?:[^"]|"")*"|[^"]+|"'), lambda x: CASE WHEN x[1] = '"' THEN x ELSE replace(x, chr(13), '') END), '') AS record FROM""",
    )
    + rf"""SELECT row_id, file_id, line_no,
  nullif(regexp_replace(replace(regexp_replace(n0, '"((?:[^"]|"")*)"', '\1', 'g'), '""', '"'), '^{_BLANK}+|{_BLANK}+$', '', 'g'), '') AS name,
  try_cast(ltrim(nullif(age, ''), '+') AS BIGINT) AS age, CASE active WHEN 'true' THEN true WHEN 'false' THEN false END AS active FROM g WHERE reason IS NULL""",
    "p3_found": """
WITH RECURSIVE t AS (SELECT part_id, 0 AS depth, [0]::INTEGER[] AS path, node::JSON AS n FROM xml_parts WHERE json_type(node::JSON) = 'OBJECT'
  UNION ALL SELECT part_id, depth + 1, list_append(path, k), x FROM (SELECT part_id, depth, path, unnest(kids) AS x, generate_subscripts(kids, 1)::INTEGER AS k FROM (
    SELECT part_id, depth, path, CASE json_type(n, '$.children') WHEN 'ARRAY' THEN json_extract(n, '$.children[*]') WHEN 'OBJECT' THEN [json_extract(n, '$.children')] ELSE [] END AS kids FROM t)) WHERE json_type(x) = 'OBJECT'),
o AS (SELECT part_id, path, row_number() OVER (PARTITION BY part_id ORDER BY path) - 1 AS node_no FROM t)
SELECT c.part_id, p.node_no AS parent_no, c.node_no FROM o c JOIN o p ON p.part_id = c.part_id AND p.path = c.path[1:len(c.path) - 1] WHERE len(c.path) > 1""",
}
