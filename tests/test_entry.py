import importlib
import sys

import pytest


def test_keys():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_without_the_language_model_package(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "quillgrid.llm", None)
    alone = importlib.reload(entry)
    try:
        assert "p2_found" in alone.queries() and "filter_eq" in alone.queries() and not any(q.startswith(("p1_", "p4_", "p5_", "p6_", "p7_", "p8_")) for q in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_flagship(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["row_id", "reason"] and got.count() > 0


SOME = ["select_project", "filter_null_lt", "filter_bool_ne", "order_ties_reversed", "agg_minmax_blank", "fx_div_zero", "fx_number_to_text", "infer_schema", "axis_ticks", "recents", "p2_found", "html_to_text", "md_block_kinds", "token_jaccard", "latest_cells", "running_headings", "pdf_lines"]


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, small, name):
    import os

    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(got.select(*order).collect()) == plain(want.select(*order).fetchall())
