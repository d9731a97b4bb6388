import json

from quillgrid.operators import shred


def brute(node, number=0, parent=None):
    """Rows (parent, number) of a tree, recursively."""
    out, nxt = [(parent, number)], number + 1
    kids = node.get("children")
    for child in [kids] if isinstance(kids, dict) else kids or []:
        if isinstance(child, dict):
            rows = brute(child, nxt, number)
            out += rows
            nxt += len(rows)
    return out


def numbers(text):
    return [(r[3], r[2]) for r in shred.visit(1, text, ("node",))]


def test_shapes():
    tree = {"name": "a", "children": [{"children": {"name": "x"}}, None, "text", 3, {"name": None, "children": []}, {"children": None, "text": "t"}]}
    assert numbers(json.dumps(tree)) == brute(tree)
    assert numbers("{}") == [(None, 0)]
    assert numbers(None) == [] and numbers("null") == [] and numbers("[]") == []
    assert [r[0] for r in shred.visit(1, "{bad", shred.TAGS)] == ["reject"]
    assert [r[0] for r in shred.visit(1, "[1]", shred.TAGS)] == ["reject"]


def test_attributes():
    rows = [r for r in shred.visit(7, '{"attributes": {"a": "1", "b": null}, "children": {"attributes": [{"key": "k", "value": 5}, {"z": "y"}, 3]}}', ("attribute",))]
    assert [(r[2], r[4], r[6], r[7]) for r in rows] == [(0, 0, "a", "1"), (0, 1, "b", None), (1, 0, "k", "5"), (1, 1, "z", "y")]


def test_deep():
    deep = '{"children":' * 30_000 + '{"name":"end"}' + "}" * 30_000
    got = numbers(deep)
    assert len(got) == 30_001 and got[-1] == (29_999, 30_000)
    sample = '{"a": [1, {"b": "x\\"y"}, [], {}, null, true, -2.5e3], "c": ""}'
    assert shred.parse_deep(sample) == json.loads(sample)
    for bad in ('{"a" 1}', "[1,]", '{"a":1', "1 2", ""):
        try:
            shred.parse_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"name":"r","children":[{"name":"c","text":"t","attributes":{"x":"1"}}]}', "n"), (2, None, "n"), (3, "oops", None), (3, "oops", None)], "part_id long, node string, name string")
    assert sorted(map(tuple, shred.nodes(df).collect())) == [(1, 0, None, 0, 0, "r", None), (1, 1, 0, 0, 1, "c", "t")]
    assert list(map(tuple, shred.attributes(df).collect())) == [(1, 1, 0, "x", "1")]
    shred.write_tables(df, str(tmp_path / "t"))
    assert shred.read_table(spark, str(tmp_path / "t"), "node").count() == 2
    assert shred.read_table(spark, str(tmp_path / "t"), "reject").count() == 2
    assert shred.emit(df.limit(0)).count() == 0


def test_whole_table(spark, small):
    parts = spark.read.parquet(f"{small}/xml_parts.parquet")
    want = sorted((r.part_id, p, n) for r in parts.collect() if r.node for p, n in brute(json.loads(r.node)) if p is not None)
    got = sorted((r.part_id, r.parent_no, r.node_no) for r in shred.nodes(parts).where("parent_no is not null").collect())
    assert got == want
