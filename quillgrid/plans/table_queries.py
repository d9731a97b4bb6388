"""Queries over the star-schema tables: the SELECT dialect, folds, formula scalars, inference, charts, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import numbers, texts
from quillgrid.operators import charts, sessionlog, workspace
from quillgrid.operators.formula import SHEET, WORKBOOK, Compiler, aggregate, average_cells
from quillgrid.plans import dialect
from quillgrid.session import table
from quillgrid.sources import delimited, sinks
from quillgrid.streaming import events as event_stream

QUERIES = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def _select(name: str, source: str, sql: str, oracle: str | None = None) -> None:
    """A query of the dialect; its SQL is the same text unless nulls or ties need another."""

    @_add(name, oracle or sql)
    def run(spark, root, source=source, sql=sql):
        return dialect.execute(table(spark, root, source), dialect.parse(sql))


_select("select_star", "region", "SELECT * FROM region")
_select("select_project", "nation", "SELECT n_name, n_regionkey FROM nation")
_select("case_insensitive_names", "orders", "SELECT O_ORDERKEY, o_TotalPrice FROM ORDERS", "SELECT o_orderkey, o_totalprice FROM orders")
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    _select(f"filter_{_name}", "lineitem", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25")
    _select(f"filter_text_{_name}", "customer", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment {_op} 'FURNITURE'")
    _select(f"filter_null_{_name}", "cells", f"SELECT cell_id, num FROM cells WHERE num {_op} 10", f"SELECT cell_id, num FROM cells WHERE coalesce(num, 0) {_op} 10")
    _select(f"filter_bool_{_name}", "cells", f"SELECT cell_id, flag FROM cells WHERE flag {_op} true", f"SELECT cell_id, flag FROM cells WHERE coalesce(CAST(flag AS INT), 0) {_op} 1")
_select("filter_int_float_literal", "nation", "SELECT n_nationkey FROM nation WHERE n_regionkey >= 1.5")
_select("order_asc_limit", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
_select("order_desc_limit", "customer", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 20")
_select("order_text", "supplier", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name LIMIT 7", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_name LIMIT 7")
_select("limit_over_size", "region", "SELECT r_name FROM region LIMIT 1000")


@_add("order_nonprojected", "SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey DESC LIMIT 15")
def order_nonprojected(spark, root):
    return dialect.execute(table(spark, root, "orders"), dialect.parse("SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey DESC LIMIT 15"))


@_add("order_ties_reversed", "SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_nationkey DESC LIMIT 12")
def order_ties_reversed(spark, root):
    """DESC reverses ties: the row number decides between rows of the same key."""
    return dialect.execute(table(spark, root, "nation"), dialect.parse("SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_regionkey DESC LIMIT 12"), "n_nationkey")


@_add("order_numeric_text", "SELECT t.cell_id, t.value FROM (SELECT * FROM cells WHERE coalesce(value, '') > '') t ORDER BY try_cast(CASE WHEN regexp_full_match(value, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN value END AS DOUBLE) IS NULL, try_cast(CASE WHEN regexp_full_match(value, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN value END AS DOUBLE), value, cell_id LIMIT 50")
def order_numeric_text(spark, root):
    """Numeric texts first by number, then the others by bytes."""
    return dialect.execute(table(spark, root, "cells").select("cell_id", "value"), dialect.parse("SELECT cell_id, value FROM cells WHERE value > '' ORDER BY value LIMIT 50"), "cell_id")


@_add("stored_query", "SELECT p_partkey, p_name FROM part WHERE p_size >= 40")
def stored_query(spark, root):
    db = dialect.Database(spark, "parts")
    db.add_table("part", table(spark, root, "part"))
    db.add_query("large", "SELECT p_partkey, p_name FROM part WHERE p_size >= 40")
    return db.run_stored("large")


@_add("insert_row", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, NULL")
def insert_row(spark, root):
    db = dialect.Database(spark)
    db.add_table("region", table(spark, root, "region"))
    db.insert_row("region", [99])
    return db.query("SELECT * FROM region")


# -- folds over columns -------------------------------------------------------------------------------------

for _fn, _sql in (("SUM", "coalesce(sum(l_quantity), 0)"), ("AVERAGE", "avg(l_quantity)"), ("MIN", "min(l_extendedprice)"), ("MAX", "max(l_extendedprice)"), ("COUNT", "CAST(count(l_tax) AS DOUBLE)")):
    _column = _sql[_sql.rindex("(l_") + 1 :].split(")")[0] if _fn != "SUM" else "l_quantity"

    @_add(f"agg_{_fn.lower()}", f"SELECT {_sql} AS value FROM lineitem")
    def fold(spark, root, fn=_fn, column=_column):
        return table(spark, root, "lineitem").agg(aggregate(fn, F.col(column), "number").alias("value"))


@_add("agg_counta", "SELECT CAST(count(value) AS DOUBLE) AS texts, CAST(count(num) AS DOUBLE) AS numbers FROM cells")
def agg_counta(spark, root):
    return table(spark, root, "cells").agg(aggregate("COUNTA", F.col("value"), "text", WORKBOOK).alias("texts"), aggregate("COUNTA", F.col("num"), "number", WORKBOOK).alias("numbers"))


@_add("agg_minmax_blank", "SELECT min(num) AS sheet_min, min(coalesce(num, 0)) AS workbook_min, max(num) AS sheet_max, max(coalesce(num, 0)) AS workbook_max FROM cells")
def agg_minmax_blank(spark, root):
    n = F.col("num")
    return table(spark, root, "cells").agg(*(aggregate(fn, n, "number", d).alias(f"{'sheet' if d == SHEET else 'workbook'}_{fn.lower()}") for fn in ("MIN", "MAX") for d in (SHEET, WORKBOOK)))


@_add("agg_workbook_average_mixed", "SELECT doc_key, round((coalesce(sum(num), 0) + coalesce(sum(CAST(flag AS INT)), 0)) / nullif(count(num), 0), 6) AS average FROM cells WHERE kind IN ('number', 'bool') GROUP BY doc_key")
def agg_workbook_average_mixed(spark, root):
    """Booleans add to the sum but not to the count."""
    cells = table(spark, root, "cells").where(F.col("kind").isin("number", "bool"))
    return cells.groupBy("doc_key").agg(F.round(average_cells(F.col("kind"), F.col("num"), F.col("flag")), 6).alias("average"))


@_add("agg_and_or", "SELECT l_returnflag, bool_and(l_quantity <> 0) AS every, bool_or(l_tax <> 0) AS some FROM lineitem GROUP BY l_returnflag")
def agg_and_or(spark, root):
    return table(spark, root, "lineitem").groupBy("l_returnflag").agg(aggregate("AND", F.col("l_quantity"), "number").alias("every"), aggregate("OR", F.col("l_tax"), "number").alias("some"))


@_add("sheet_max_extent", "SELECT doc_key, sheet_no, coalesce(max(row_no) FILTER (kind <> 'empty'), 0) AS rows, coalesce(max(col_no) FILTER (kind <> 'empty'), 0) AS cols, count(*) FILTER (kind <> 'empty') AS cells FROM cells GROUP BY ALL")
def sheet_max_extent(spark, root):
    return sinks.extents(table(spark, root, "cells"), ("doc_key", "sheet_no"))


@_add("range_sum", "SELECT doc_key, sheet_no, round(coalesce(sum(num), 0), 4) AS total FROM cells WHERE kind = 'number' AND row_no BETWEEN 1 AND 20 AND col_no BETWEEN 0 AND 2 GROUP BY ALL")
def range_sum(spark, root):
    """SUM(A2:C21) of every sheet: a range is a filter."""
    inside = F.col("row_no").between(1, 20) & F.col("col_no").between(0, 2) & (F.col("kind") == "number")
    return table(spark, root, "cells").where(inside).groupBy("doc_key", "sheet_no").agg(F.round(aggregate("SUM", F.col("num"), "number"), 4).alias("total"))


# -- formulas compiled to Columns: column letters are those of the table ------------------------------------


def _fx(name: str, source: str, keys: list[str], formula: str, oracle: str, mode: str = SHEET) -> None:
    keyed = ", ".join(keys)

    @_add(f"fx_{name}", f"SELECT {keyed}, {oracle} AS value FROM {source}")
    def run(spark, root):
        df = table(spark, root, source)
        kinds = {"string": "text", "boolean": "bool"}
        columns = [(c, kinds.get(t, "number")) for c, t in df.dtypes]
        return df.select(*keys, Compiler(columns, mode).column(formula).alias("value"))


_LI = ["l_orderkey", "l_linenumber"]
# lineitem: A l_orderkey, B l_partkey, C l_suppkey, D l_linenumber, E l_quantity, F l_extendedprice, G l_discount, H l_tax, I l_returnflag, J l_linestatus
_fx("add_mul", "lineitem", _LI, "=F1*(1-G1)*(1+H1)", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
_fx("div_zero", "lineitem", _LI, "=E1/G1", "l_quantity / nullif(l_discount, 0)", WORKBOOK)
_fx("power_unary", "lineitem", _LI, "=-E1^2", "pow(-l_quantity, 2)")
_fx("round", "lineitem", _LI, "=ROUND(F1,1)", "floor(abs(l_extendedprice * 10) + 0.5) / 10")
_fx("int_abs", "lineitem", _LI, "=INT(ABS(F1-1000)/7)", "CAST(floor(abs(l_extendedprice - 1000) / 7) AS DOUBLE)", WORKBOOK)
_fx("power", "lineitem", _LI, "=POWER(E1,2)", "pow(l_quantity, 2)", WORKBOOK)
_fx("compare_chain", "lineitem", _LI, "=E1>25=TRUE", "l_quantity > 25")
_fx("equal_epsilon", "lineitem", _LI, "=G1=0.04", "abs(l_discount - 0.04) < 2.220446049250313e-16", WORKBOOK)
_fx("text_less", "lineitem", _LI, '=I1<"N"', "l_returnflag < 'N'")
_fx("if", "lineitem", _LI, '=IF(E1>30,"big","small")', "CASE WHEN l_quantity > 30 THEN 'big' ELSE 'small' END")
_fx("and_or_not", "lineitem", _LI, "=OR(AND(E1>10,NOT(G1>0.05)),H1=0)", "(l_quantity > 10 AND NOT l_discount > 0.05) OR l_tax = 0")
_fx("number_to_text", "lineitem", _LI, '="q"&E1', "'q' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)")
_fx("row_sum", "lineitem", _LI, "=SUM(E1:H1)", "l_quantity + l_extendedprice + l_discount + l_tax")
_fx("row_minmax", "lineitem", _LI, "=MAX(G1:H1)-MIN(G1:H1)", "greatest(l_discount, l_tax) - least(l_discount, l_tax)")
_fx("row_count", "cells", ["cell_id"], "=COUNT(I1:J1)", "CAST((num IS NOT NULL)::INT + (flag IS NOT NULL)::INT AS DOUBLE)")
_fx("row_counta", "cells", ["cell_id"], "=COUNTA(H1:J1)", "CAST((num IS NOT NULL)::INT + (flag IS NOT NULL)::INT + (value IS NOT NULL)::INT AS DOUBLE)", WORKBOOK)
_fx("len", "part", ["p_partkey"], "=LEN(B1)", "CAST(length(p_name) AS DOUBLE)")
_fx("left_right", "part", ["p_partkey"], '=LEFT(B1,3)&"-"&RIGHT(B1,2)', "left(p_name, 3) || '-' || right(p_name, 2)", WORKBOOK)
_fx("upper_lower", "customer", ["c_custkey"], "=UPPER(B1)&LOWER(E1)", "upper(c_name) || lower(c_mktsegment)", WORKBOOK)
_fx("trim_concat", "customer", ["c_custkey"], '=CONCATENATE("[",TRIM("  "&B1&" "),"]")', "'[' || trim(c_name) || ']'", WORKBOOK)


# -- numbers and inference ----------------------------------------------------------------------------------


@_add("infer_schema", """SELECT name, CASE WHEN NOT any_filled THEN 'string' WHEN all_int THEN 'bigint' WHEN all_float THEN 'double' WHEN all_bool THEN 'boolean' ELSE 'string' END AS kind FROM (
SELECT name, count(v) > 0 AS any_filled, coalesce(bool_and(regexp_full_match(v, '[+-]?[0-9]+') AND try_cast(v AS BIGINT) IS NOT NULL), false) AS all_int,
 coalesce(bool_and(regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')), false) AS all_float, coalesce(bool_and(lower(v) IN ('true', 'false')), false) AS all_bool
FROM (SELECT 'event_id' AS name, CAST(event_id AS VARCHAR) AS v FROM events UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events UNION ALL SELECT 'event_type', event_type FROM events UNION ALL SELECT 'even', CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'FALSE' END FROM events UNION ALL SELECT 'blank', NULL FROM events) GROUP BY name)""")
def infer_schema(spark, root):
    e = table(spark, root, "events")
    as_text = e.select(F.col("event_id").cast("string"), F.col("value").cast("string"), "event_type", F.when(F.col("event_id") % 2 == 0, "True").otherwise("FALSE").alias("even"), F.lit(" ").alias("blank"))
    return spark.createDataFrame(list(delimited.infer_types(as_text).items()), "name string, kind string")


@_add("typed_values", "SELECT event_id, user_id FROM events")
def typed_values(spark, root):
    """Texts to typed columns and back to what they were."""
    e = table(spark, root, "events").select(F.col("event_id").cast("string"), F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("user_id"))
    return delimited.typed(e, {"event_id": "bigint", "user_id": "bigint"})


@_add("cell_inference", "SELECT cell_id, CASE WHEN value IS NULL OR regexp_full_match(value, '[\\s\\p{Z}]*') THEN 'empty' WHEN starts_with(ltrim(value), '=') THEN 'formula' WHEN lower(trim(value)) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(regexp_replace(value, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '(?i)[+-]?(inf|infinity|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)') THEN 'number' ELSE 'text' END AS inferred FROM cells")
def cell_inference(spark, root):
    return table(spark, root, "cells").select("cell_id", delimited.cell_kind(F.col("value")).alias("inferred"))


@_add("number_display", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS shown FROM lineitem")
def number_display(spark, root):
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", numbers.display(F.col("l_quantity")).alias("shown"))


@_add("a1_codec", "SELECT cell_id, CASE WHEN col_no >= 702 THEN chr(65 + (col_no - 702) // 676) ELSE '' END || CASE WHEN col_no >= 26 THEN chr(65 + (col_no - 26) // 26 % 26) ELSE '' END || chr(65 + col_no % 26) || CAST(row_no + 1 AS VARCHAR) AS address FROM cells")
def a1_codec(spark, root):
    return table(spark, root, "cells").select("cell_id", texts.a1(F.col("row_no"), F.col("col_no")).alias("address"))


@_add("a1_letters", "SELECT l_orderkey, l_linenumber, CASE WHEN c >= 702 THEN chr(65 + (c - 702) // 676) ELSE '' END || CASE WHEN c >= 26 THEN chr(65 + (c - 26) // 26 % 26) ELSE '' END || chr(65 + c % 26) AS letters FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 13 % 16384 AS INTEGER) AS c FROM lineitem)")
def a1_letters(spark, root):
    """Columns of one to three letters, A to XFD."""
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", texts.column_letters((F.col("l_partkey") * 13 % 16384).cast("int")).alias("letters"))


@_add("date_formats", "SELECT p_partkey, regexp_matches(lower(code), 'yy|mmm|dd|/yy|h:mm|d-m') AS dated FROM (SELECT p_partkey, ['General', '0.00', 'd-m', 'dd.mm.yyyy', '# ?/? s', 'MMM', 'h:mm', '[$-409]0', 'm/d', 'D/M/YY', p_name][p_partkey % 11 + 1] AS code FROM part)")
def date_formats(spark, root):
    codes = F.array(*map(F.lit, ("General", "0.00", "d-m", "dd.mm.yyyy", "# ?/? s", "MMM", "h:mm", "[$-409]0", "m/d", "D/M/YY")), F.col("p_name"))
    return table(spark, root, "part").select("p_partkey", charts.is_date_format(F.element_at(codes, (F.col("p_partkey") % 11 + 1).cast("int"))).alias("dated"))


@_add("chart_value_range", "SELECT l_returnflag, least(min(l_extendedprice), 0) AS low, CASE WHEN abs(max(l_extendedprice) - least(min(l_extendedprice), 0)) < 1e-9 THEN least(min(l_extendedprice), 0) + 1 ELSE max(l_extendedprice) END AS high FROM lineitem GROUP BY l_returnflag")
def chart_value_range(spark, root):
    return charts.axes(table(spark, root, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", "low", "high")


@_add("axis_ticks", """WITH r AS (SELECT l_returnflag, least(min(l_quantity), 0) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1),
s AS (SELECT *, greatest(high - low, 1) / 6 AS raw, pow(10, floor(log10(greatest(high - low, 1) / 6))) AS p FROM r),
t AS (SELECT *, CASE WHEN raw / p < 1.5 THEN 1 WHEN raw / p < 3.5 THEN 2 WHEN raw / p < 7.5 THEN 5 ELSE 10 END * p AS step FROM s)
SELECT l_returnflag, CAST(floor(low / step) * step + i * step AS BIGINT) AS tick FROM t, range(32) q(i) WHERE floor(low / step) * step + i * step <= ceil(high / step) * step + step * 1.5""")
def axis_ticks(spark, root):
    return charts.axes(table(spark, root, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", F.explode("ticks").alias("tick")).withColumn("tick", F.col("tick").cast("bigint"))


@_add("format_tick", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_extendedprice - round(l_extendedprice)) < 1e-9 THEN CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.4f', l_extendedprice), '0'), '.') END AS tick FROM lineitem")
def format_tick(spark, root):
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", numbers.format_tick(F.col("l_extendedprice")).alias("tick"))


@_add("palette_assign", "SELECT n_nationkey, ['#4472C4', '#ED7D31', '#A5A5A5', '#FFC000', '#5B9BD5', '#70AD47', '#264478', '#9E480E'][n_nationkey % 8 + 1] AS colour FROM nation")
def palette_assign(spark, root):
    return table(spark, root, "nation").select("n_nationkey", charts.colour(F.col("n_nationkey")).alias("colour"))


@_add("chart_points", "SELECT l_returnflag AS series, count(*) AS points, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def chart_points(spark, root):
    series = table(spark, root, "lineitem").select(F.col("l_returnflag").alias("series"), F.array(F.col("l_quantity").cast("string"), F.lit("n/a")).alias("values"), F.array("l_linestatus").alias("categories"))
    return charts.points(series).groupBy("series").agg(F.count("*").alias("points"), F.round(F.sum("y"), 2).alias("total"))


@_add("unit_conversion", "SELECT box_id, round(CAST(width_mm AS DOUBLE) * 36000 / 36000, 4) AS emu_mm, round(CAST(width_mm AS DOUBLE) * 0.352778, 4) AS pt_mm, round(CAST(width_mm AS DOUBLE) * 0.264583, 4) AS px_mm FROM text_boxes")
def unit_conversion(spark, root):
    w = F.col("width_mm").cast("double")
    return table(spark, root, "text_boxes").select("box_id", F.round(numbers.emu_to_mm(w * 36000), 4).alias("emu_mm"), F.round(numbers.pt_to_mm(w), 4).alias("pt_mm"), F.round(numbers.px_to_mm(w), 4).alias("px_mm"))


@_add("checksum", "SELECT * FROM (VALUES (0, 0, 1), (1, 3421780262, 152961502), (2, 3904355907, 6422626)) t(k, crc32, adler32)")
def checksum(spark, root):
    """Of '', '123456789' and 'a' + 'b': known values of both sums."""
    texts_ = spark.createDataFrame([(0, ""), (1, "123456789"), (2, "a")], "k int, text string")
    return texts_.select("k", F.crc32(F.col("text").cast("binary")).alias("crc32"), numbers.adler32(F.col("text").cast("binary")).alias("adler32"))


@_add("family_means", "SELECT l_returnflag, round(avg(l_quantity), 6) AS own, round(avg(l_extendedprice), 6) AS other, round(sum(l_extendedprice) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1")
def family_means(spark, root):
    out = charts.family_means(table(spark, root, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("own", "other", "ratio")))


# -- sessions -----------------------------------------------------------------------------------------------


@_add("recents", "SELECT path, max(ts) AS ts FROM (SELECT event_type || '/' || CAST(user_id % 50 AS VARCHAR) AS path, ts FROM events) GROUP BY path ORDER BY ts DESC, path LIMIT 20")
def recents(spark, root):
    e = table(spark, root, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 50).cast("string")).alias("path"), "ts")
    return sessionlog.recents(e)


@_add("mutating_commands", "SELECT event_type, count(*) AS n, bool_or(regexp_matches(event_type, '^(Set|Insert|Append|Delete|Add|Create|Update|Remove|Replace|Execute)')) AS changes FROM events GROUP BY event_type")
def mutating_commands(spark, root):
    return table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.bool_or(sessionlog.mutating(F.col("event_type"))).alias("changes"))


@_add("last_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def last_events(spark, root):
    return sessionlog.last_events(table(spark, root, "events").select("event_id", "ts"), ["ts", "event_id"])


@_add("windowed_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, root):
    out = event_stream.windowed_counts(table(spark, root, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


@_add("workspace_events", "SELECT * FROM (VALUES (5, 'Book', '.uno:EvaluateCell'), (4, 'Book', '.uno:SetCell'), (3, 'Book', '.uno:SetCell'), (2, 'workspace', 'open'), (1, 'workspace', 'open')) t(event_id, source, topic)")
def workspace_events(spark, root):
    """The last events of a session that opened two documents, set cells and evaluated one."""
    w = workspace.Workspace(spark)
    w.new("text", "Note")
    book = w.load("spreadsheet", "Book", b"a,1\n")
    w.execute(book, ".uno:SetCell", row=1, col=1, value="41")
    w.execute(book, ".uno:SetCell", row=2, col=1, value="=B1+B2")
    w.execute(book, ".uno:EvaluateCell", row=2, col=1)
    return w.report()


@_add("session_query_count", "SELECT * FROM (VALUES ('Alice', 2)) t(first, n)")
def session_query_count(spark, root):
    """A database built by commands; a query's command gives the number of its rows."""
    w = workspace.Workspace(spark)
    db = w.new("database", "Staff")
    w.execute(db, ".uno:CreateTable", name="People", columns="name, age")
    for row in ("Alice,30", "Bob,22", "Cara,41"):
        w.execute(db, ".uno:InsertRow", table="People", row=row)
    n = w.execute(db, ".uno:ExecuteQuery", sql="SELECT name FROM People WHERE age > 25")
    return spark.createDataFrame([(w.get(db).content["People"][1][0][0], n)], "first string, n int")


@_add("extension_kinds", "SELECT doc_key, CASE WHEN format IN ('docx', 'pdf', 'md', 'odt', 'html') THEN 'text' WHEN format IN ('xlsx', 'ods') THEN 'spreadsheet' WHEN format IN ('pptx', 'odp') THEN 'presentation' WHEN format IN ('odg', 'svg') THEN 'drawing' END AS kind FROM office_docs")
def extension_kinds(spark, root):
    return table(spark, root, "office_docs").select("doc_key", sessionlog.kind_of(F.concat_ws(".", "doc_key", "format")).alias("kind"))
