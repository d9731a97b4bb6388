import pytest

from quillgrid.functions import numbers, texts
from quillgrid.plans import dialect
from quillgrid.session import InvalidInput, ParseError

PEOPLE = [(1, "Alice", 30, True), (2, "Bob", 22, False), (3, "Cara", 41, True), (4, "Dave", None, None), (5, None, 22, True)]


@pytest.fixture(scope="module")
def db(spark):
    out = dialect.Database(spark, "test")
    out.add_table("People", spark.createDataFrame(PEOPLE, "id int, name string, age int, active boolean"))
    return out


def ids(db, sql, row_id=None):
    return [r[0] for r in db.query(sql, row_id).collect()]


def test_queries(db):
    assert [tuple(r) for r in db.query("SELECT name, age FROM people WHERE age >= 22 ORDER BY age DESC LIMIT 2;").collect()] == [("Cara", 41), ("Alice", 30)]
    assert sorted(ids(db, "select ID from People where Age < 25")) == [2, 4, 5]  # null is 0
    assert ids(db, "SELECT id FROM People WHERE active = 1 ORDER BY id") == [1, 3, 5]
    assert ids(db, "SELECT id FROM People WHERE active = false ORDER BY id") == [2, 4]
    assert ids(db, "SELECT id FROM People WHERE name < 'C' ORDER BY id") == [1, 2, 5]
    assert ids(db, "SELECT id FROM People WHERE name = \"Bob\"") == [2]
    assert ids(db, "SELECT id FROM People WHERE name <> Bob ORDER BY id") == [1, 3, 4, 5]
    assert ids(db, "SELECT id FROM People ORDER BY age DESC", "id") == [3, 1, 5, 2, 4]
    assert ids(db, "SELECT id FROM People ORDER BY age", "id") == [4, 2, 5, 1, 3]
    assert db.query("SELECT * FROM People").columns == ["id", "name", "age", "active"]
    assert ids(db, "SELECT id FROM People LIMIT 0") == []


def test_plans(db, spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    q = dialect.execute(orders, dialect.parse("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC LIMIT 5"))
    text = q._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in text and "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text


def test_refused(db):
    for bad in ("DELETE FROM People", "SELECT id", "SELECT id FROM People WHERE age > 1 AND id = 2", "SELECT id FROM People LIMIT x", "SELECT id FROM People ORDER age", "SELECT *, id FROM People", "SELECT id FROM People WHERE age ! 3"):
        with pytest.raises(ParseError):
            db.query(bad)
    for bad in ("SELECT id FROM Gone", "SELECT gone FROM People", "SELECT id FROM People ORDER BY gone", "SELECT id FROM People WHERE age = ten"):
        with pytest.raises(InvalidInput):
            db.query(bad)
    with pytest.raises(InvalidInput):
        db.run_stored("none")


def test_ambiguous_and_empty(spark):
    twice = spark.createDataFrame([(1, 2)], "a int, A int")
    with pytest.raises(Exception, match="ambiguous"):
        dialect.execute(twice, dialect.parse("SELECT a FROM t"))
    empty = spark.createDataFrame([], "a int, b string")
    assert dialect.execute(empty, dialect.parse("SELECT b FROM t WHERE a > 1 ORDER BY b DESC LIMIT 3")).collect() == []


def test_insert(db, spark):
    own = dialect.Database(spark)
    own.add_table("t", spark.createDataFrame([(1, "a")], "k int, v string"))
    own.insert_row("T", [2])
    assert sorted(own.query("SELECT * FROM t").collect()) == [(1, "a"), (2, None)]
    with pytest.raises(InvalidInput):
        own.insert_row("t", [1, "b", 3])


def test_numbers(spark):
    from pyspark.sql import functions as F

    strings = ["1", "-1.5", ".5", "1.", "1e3", "+7", "inf", "-Infinity", "nan", "1d", "1.5f", " 1", "", None, "1\n", "٣", "0x1"]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = [r[0] for r in df.select(numbers.parse_float(F.col("s"))).collect()]
    assert got[:6] == [1.0, -1.5, 0.5, 1.0, 1000.0, 7.0] and got[6] == float("inf") and got[7] == float("-inf") and got[8] != got[8] and got[9:] == [None] * 8
    assert [r[0] for r in df.select(numbers.parse_boolean(F.col("s"))).distinct().collect()] == [None]
    values = [1.0, -0.0, 1e10, 1e21, 123456789.125, 1e-7, 0.001, -2.5, 1.7976931348623157e308, float("nan"), float("inf")]
    from quillgrid.operators.formula import display_number

    shown = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(numbers.display(F.col("v"))).collect()]
    assert shown == [display_number(v) for v in values]


def test_texts(spark):
    from pyspark.sql import functions as F

    def one(text, fn):
        return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]

    assert one("&amp;&lt;&#65;&#x42;&#x1F600;&copy; & &amp;#65;", texts.decode_entities) == "&<AB😀&copy; & &#65;"
    assert one(None, texts.decode_entities) is None
    assert one("&#38;amp; &amp;lt; &#x26;#65; &", texts.decode_entities) == "&amp; &lt; &#65; &"
    assert one("<h1>hi</h1><p>one<br/>two</p>", texts.html_to_text) == "hi\n\none\ntwo\n\n"
    assert one("a\n\n \n\n b ", texts.paragraphs) == ["a", "b"]
    assert one("hello  WORLD\tx", texts.title_case) == "Hello  World\tX"
    assert one("  Ünï Code--x ", texts.slug) == "n-code-x"
    assert [one(t, texts.sniff_text) for t in ("<svg>", "<html>", "# a", "a,b\nc", "x", "", None)] == ["svg", "html", "md", "csv", "txt", None, None]
    assert [one(t, texts.block_kind) for t in ("## a", "---", "- x", "|a|", "t", "", "#######")] == ["heading", "rule", "list", "table", "text", "blank", "text"]
    cells = spark.range(0, 800).select(texts.column_letters(F.col("id"))).collect()
    from quillgrid.operators.formula import column_name

    assert [r[0] for r in cells] == [column_name(k) for k in range(800)]
    assert [r[0] for r in spark.createDataFrame([(1,), (4,), (1994,), (4000,)], "n int").select(texts.roman(F.col("n"))).collect()] == ["i", "iv", "mcmxciv", "4000"]


def test_ties_of_a_database(spark):
    """Ties under DESC are reversed where the table has a row number, and the same at every run where it has none."""
    from quillgrid.plans.dialect import Database

    rows = [(k, "abcd"[k % 4], 5 if k % 2 else 6) for k in range(8)]
    df = spark.createDataFrame(rows, "n int, name string, age int").repartition(3)
    db = Database(spark)
    db.add_table("People", df, row_id="n")
    assert [tuple(r) for r in db.query("SELECT name FROM people WHERE age = 5 ORDER BY age DESC LIMIT 3").collect()] == [("d",), ("b",), ("d",)]
    assert [r.name for r in db.query("SELECT name FROM People ORDER BY age LIMIT 2").collect()] == ["b", "d"] and "n" not in db.query("SELECT * FROM People").columns
    db.add_table("Loose", df.select("age", "name"))
    assert [r.name for r in db.query("SELECT name FROM Loose ORDER BY age DESC LIMIT 3").collect()] == ["c", "c", "a"]
