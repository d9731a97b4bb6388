import math

import pytest

from quillgrid.llm import mixture as mx


def test_weights():
    tokens = {"a": 1000, "b": 100, "c": 10}
    targets = {"a": (0.5, 1), "b": (0.3, 4), "c": (0.1, 5), "gone": (0.1, 9)}
    got = mx.weigh(tokens, targets)
    total = sum(w["budget"] for w in got.values())
    for name, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(got[name]["budget"] / total - share / 0.9) < 0.01
    assert got["gone"]["budget"] == 0 and got["c"]["budget"] <= 50
    large = mx.weigh(tokens, targets, total=1000)
    assert 0 < large["a"]["exponent"] < 1 and all(large[n]["budget"] <= tokens[n] * targets[n][1] for n in tokens)
    assert sum(w["budget"] for w in large.values()) == pytest.approx(1000, abs=2)
    flat = mx.weigh(tokens, targets, total=20, target_entropy=mx.entropy([1 / 3] * 3) * 0.8)
    assert mx.entropy([w["weight"] for w in flat.values()]) == pytest.approx(math.log(3) * 0.8, rel=1e-3)
    stretched = mx.weigh(tokens, targets, stretch=1.1)
    assert 0 < stretched["a"]["exponent"] < 1 and sum(w["budget"] for w in stretched.values()) == pytest.approx(1.1 * total, rel=0.02)
    huge = mx.weigh(tokens, targets, total=10**9)
    assert all(huge[n]["budget"] <= tokens[n] * targets[n][1] for n in tokens)


def test_no_sources():
    assert mx.weigh({}, {"a": (1.0, 1)})["a"]["budget"] == 0 and mx.weigh({"a": 5}, {}) == {}
    assert mx.weigh({"a": 5}, {"a": (None, 2)})["a"]["budget"] == 0 and mx.weigh({"a": 5}, {"a": (float("nan"), None)})["a"]["budget"] == 0


@pytest.fixture
def tables(spark):
    rows = [(i, "word " * (i % 7 + 1), "big" if i % 3 else "small", "x") for i in range(600)] + [(1000, None, "big", None), (1001, "", "small", None), (1002, "text", None, None), (1003, "text", "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block string")
    return docs, spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")


def test_mixture(tables):
    docs, targets = tables
    rows = mx.mixture(docs, targets).collect()
    assert rows and {r.source for r in rows} == {"big", "small"}
    used = {}
    for r in rows:
        assert (r.doc_id, r.repeat_no) not in used
        used[r.doc_id, r.repeat_no] = r
    assert max(r.repeat_no for r in rows if r.source == "small") <= 3 and max(r.repeat_no for r in rows if r.source == "big") == 1
    whole = sum(r.n_tokens for r in rows)
    share = sum(r.n_tokens for r in rows if r.source == "big") / whole
    assert abs(share - 0.5 / 0.9) < 0.02
    again = sorted(map(tuple, mx.mixture(docs.repartition(5), targets).collect()))
    assert again == sorted(map(tuple, rows))


def test_shares(tables):
    docs, targets = tables
    got = {r.source: r for r in mx.shares(docs, targets).collect()}
    assert set(got) == {"big", "small", "none"} and got["none"].share == 0.0 and got["none"].mixed_tokens == 0
    assert sum(r.share for r in got.values()) == pytest.approx(1)
    assert {r.exponent for r in got.values()} == {1.0} and got["big"].available_tokens > got["small"].available_tokens > 0


def test_stretched_against_sql(spark, tables):
    """Shares of a mixture with a bisected exponent, counted by SQL over its rows."""
    import duckdb

    docs, _ = tables
    targets = spark.createDataFrame([("big", 0.5, 5), ("small", 0.4, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mx.shares(docs, targets, stretch=1.2).collect()}
    exponent = got["big"].exponent
    assert 0 < exponent < 1
    rows = mx.mixture(docs, targets, stretch=1.2).toPandas()  # noqa: F841
    counted = duckdb.sql("SELECT source, sum(n_tokens) AS n, count(*) AS docs, max(repeat_no) AS most, count(DISTINCT (doc_id, repeat_no)) AS once, sum(n_tokens) / sum(sum(n_tokens)) OVER () AS share FROM rows GROUP BY source").fetchall()
    assert len(counted) == 2
    for source, n, rows_of, most, once, share in counted:
        r = got[source]
        assert (r.mixed_tokens, r.documents, r.most_repeats) == (n, rows_of, most) and once == rows_of and most <= r.max_repeats
        assert share == pytest.approx(r.share, abs=1e-5) and share == pytest.approx(r.weight, abs=0.02)
    tokens = {s: r.available_tokens for s, r in got.items()}
    natural = [tokens[s] / sum(tokens.values()) for s in ("big", "small")]
    assert mx.tilted(natural, [0.5, 0.4], exponent) == pytest.approx([got["big"].weight, got["small"].weight], abs=1e-4)


def test_budget_ends_within_a_block():
    blocks = [(k, 10) for k in range(20)]
    whole, end, left = mx._taken(blocks, 57, 1, "s")
    assert len(whole) == 5 and end not in whole and left == 7
    assert mx._taken(blocks, 200, 1, "s")[1:] == (None, 0) and mx._taken([], 5, 1, "s") == ([], None, 5)
    assert mx._taken(blocks, 57, 2, "s")[0] != whole


def test_empty(tables):
    docs, targets = tables
    assert mx.mixture(docs.limit(0), targets).collect() == [] and mx.mixture(docs, targets.limit(0)).collect() == []
    assert {r.share for r in mx.shares(docs.limit(0), targets).collect()} == {None}
