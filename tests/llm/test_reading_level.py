import numpy as np

from quillgrid.llm import reading_level as rl

EASY = "The cat saw the dog. A boy had the red ball. The sun met a cow. "
HARD = "The institutional urbanization of this epistemology contextualized the heterogeneous jurisdiction, notwithstanding that its bureaucratic historiography instantiated the hermeneutic taxonomy. "
MIDDLE = "The regional museum described a traditional harbor, although the local farmer repaired its window. "


def test_prose():
    assert rl.prose("{{Infobox river}} and more of the text") == "" and rl.prose("| a = b of the table of things") == "" and rl.line_tokens("short") == []
    assert rl.line_tokens("To be or not?") and not rl.line_tokens("Main Street 5") and not rl.line_tokens("Lol!")
    assert rl.prose("'''Name''' is in [[Page|the place]] with [[link]]s.<ref name=\"x\">{{cite book|title=T}}</ref> End.") == "Name is in the place with links.  End."
    assert rl.prose(":The man said so to the men. --[[User:a|b]] 10:00, 1 May 2020 (UTC)") == "The man said so to the men."
    assert rl.line_tokens("Le petit chat est dans la grande maison de la ville.") == []
    assert rl.line_tokens("hahaha lol qwerty asdf zzzz poop BORING hahaha") == []


def test_isotonic_and_ranker():
    x, y = rl.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([1.0, 3.0, 2.0, 5.0]))
    assert list(y) == [1.0, 2.5, 5.0] and list(x) == [1.0, 2.5, 4.0]
    rng = np.random.default_rng(1)
    features = rng.normal(size=(200, 3))
    _, _, w = rl.fit_ranker(features, np.clip(np.round(3 + 2 * features[:, 1]), 1, 5))
    assert w[1] > 5 * max(abs(w[0]), abs(w[2]))
    assert not rl.fit_ranker(features[:3], np.ones(3))[2].any()


def test_ranker_takes_all_pairs():
    """Blocks of pairs give the minimum over all pairs: the gradient there, summed pair by pair, is nil."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4))
    y = np.clip(np.round(3 + x[:, 0] - 0.5 * x[:, 2] + rng.normal(size=90)), 1, 5)
    mean, scale, w = rl.fit_ranker(x, y, ridge=1e-3, block=16)
    z = (x - mean) / scale
    grad, total = np.zeros(4), 0.0
    for i in range(90):
        for j in range(90):
            if y[j] - y[i] >= 0.75:
                total += y[j] - y[i]
                grad -= (y[j] - y[i]) * (z[j] - z[i]) / (1 + np.exp((z[j] - z[i]) @ w))
    assert np.abs(grad / total + 1e-3 * w).max() < 1e-6
    assert np.allclose(rl.fit_ranker(x, y, ridge=1e-3, block=90)[2], w)


def test_vocabulary_leaves_the_own_fold_out():
    docs, grades = {"a": 4, "b": 2, "c": 1}, {"a": 8.0, "b": 10.0, "c": 5.0}
    vocabulary = rl._vocabulary(docs, grades)
    assert set(vocabulary) == {"a", "b"} and vocabulary["a"][0] < 3 < vocabulary["b"][0] and vocabulary["a"][1] == 0
    assert rl._vocabulary({}, {}) == {}


def tables(spark):
    rows, labels = [], []
    for k in range(60):
        text, level = ((EASY, 1), (MIDDLE, 3), (HARD, 5))[k % 3]
        rows.append((k, "== Head ==\n\n" + text * (4 + k % 5) + "\n\n{{navbox|name=x}}", "en", "w"))
        labels += [(k, level, "g"), (k, min(5, level + (k == 7)), "h"), (k, None, "i")] if k % 2 else []
    rows += [(100, None, "en", "w"), (101, "", "en", "w"), (102, HARD, "en", "w"), (103, "Das ist ein Haus und der Hund ist in dem Garten. " * 20, "en", "w"), (104, HARD * 9 + "\n\n" + "hahaha lol " * 90, None, None), (104, HARD * 9, None, None), (105, HARD * 4000, "xx", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, words string"), spark.createDataFrame(labels + [(999, 4, "g"), (None, 1, "g")], "doc_id long, level int, grader string")


def test_levels(spark):
    docs, labels = tables(spark)
    model = rl.fit(docs, labels)
    got = {}
    for r in rl.levels(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[100][0].words == 0 and got[100][0].level is None and got[103][0].words == 0 and len(got[104]) == 2
    assert got[0][0].level < 2 and abs(got[1][0].level - 3) < 1 and got[2][0].level > 4.4
    found = [r.doc_id for r in rl.demanding(docs, labels).collect()]
    assert sorted(found) == sorted([k for k in range(60) if k % 3 == 2] + [104, 104, 105])


def test_nothing_to_learn(spark):
    docs, labels = tables(spark)
    assert rl.demanding(docs, labels.limit(0)).collect() == [] and rl.demanding(docs.limit(0), labels).collect() == []
    assert {r.level for r in rl.levels(docs, rl.fit(docs, labels.limit(0))).collect()} == {None}


def test_held_out_accuracy(spark):
    """Grades of one half of the graded pages predict those of the other."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/level_labels.parquet").where("level is not null")
    graded = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    model = rl.fit(graded, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.level for r in rl.levels(graded, model).where(f"words >= {rl.MIN_WORDS}").collect()}
    truth = {r.doc_id: r.g for r in labels.where("doc_id % 2 = 1").groupBy("doc_id").agg({"level": "avg"}).withColumnRenamed("avg(level)", "g").collect()}
    pairs = [(truth[i], v) for i, v in got.items() if i in truth]
    assert len(pairs) > 300
    assert np.mean([(t >= 3.5) == (v >= 3.5) for t, v in pairs]) > 0.95
    assert np.mean([abs(t - v) for t, v in pairs]) < 0.3
