"""Reading level of documents: a linear pairwise ranker with isotonic calibration.

Graded documents give pairs of which one is harder; a linear ranker over features of syntax and
vocabulary is fitted so that the harder one scores higher (logistic loss on the score's difference),
over all pairs of the sample. Isotonic regression then maps scores to the scale of the grades. A
word's difficulty is the mean grade of the documents that have it; for the fit, of those in the other
FOLDS only, so that no document is scored by its own grade.

Only prose counts: templates, tables, references, lists, headings, signatures and lines that are no
running English are left out; fewer than FEW tokens are running text if they end as a sentence. A page is treated line by line, and what a line adds is kept in a
memo, as revisions and mirrors repeat lines; the memo starts afresh beyond ``memo_chars``.

The model is fitted on at most SAMPLE graded documents (those with the least hash of their id, the
same at every run), a parameter, and knows the words that two of them have. Every document is scored,
in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.session import cut

SAMPLE = 5000
FOLDS = 5
FEW = 5
MIN_WORDS = 40
#: Share of function words above which prose counts as English; other languages here have next to none.
ENGLISH = 0.12

# English function words and clause words.
FUNCTION_WORDS = frozenset("the of its this an and by with from for at near in under to was were is are it as that on which their his her he she they be has had have not or".split())
CLAUSE_WORDS = frozenset("because although though while whereas after before since unless until when where if provided despite inasmuch insofar notwithstanding albeit whether whereby wherein lest".split())
JOINING_WORDS = frozenset("and but so then or".split())

_SKIP = re.compile(r"\s*(?:[|{}!=#*<;]|\[\[(?:[Cc]ategory|[Ff]ile|[Ii]mage)[: ]|__|&lt;)")
_REF = re.compile(r"<ref[^<>]*?/>|<ref[^>]*>.*?</ref\s*>|<!--.*?-->|<[^<>]*>")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}|\{\{\{[^{}]*\}\}\}")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_SIGNED = re.compile(r"\s*(?:--|—)?\s*\[\[[Uu]ser:.*$")
_WEB = re.compile(r"\[?https?://\S+")
_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)?(?![A-Za-z])|[^\W\d_][\w'’-]*|\d[\d,.]*\d|\d|[.!?]+(?=[\s'\"”)]|$)|[,;]")

#: What a line adds, in this order.
SUMS = ("words", "plain", "sentences", "commas", "letters", "long", "clauses", "joins", "of", "function", "known", "difficulty", "hard", "easy", "rarity")
FEATURES = ("difficulty", "hard", "easy", "rarity", "word length", "long words", "sentence length", "commas", "clauses", "joins", "of", "function words")


def prose(line: str) -> str:
    """The running text of one line of page source; '' if it has none."""
    if _SKIP.match(line):
        return ""
    line = line.lstrip(": \t")
    if "[[" in line:
        if "ser:" in line:
            line = _SIGNED.sub("", line)
        line = _LINK.sub(r"\1", line)
    if "<" in line:
        line = _REF.sub(" ", line)
    while "{{" in line:
        shorter = _TEMPLATE.sub(" ", line)
        if shorter == line:
            break
        line = shorter
    if "''" in line:
        line = line.replace("'''", "").replace("''", "")
    if "&" in line:
        line = line.replace("&nbsp;", " ").replace("&ndash;", "–").replace("&amp;", "&")
    return _WEB.sub(" ", line) if "http" in line else line


def line_tokens(line: str) -> list[str]:
    """Words and sentence marks of a line that is running English, else none."""
    tokens = _TOKEN.findall(prose(line))
    if not tokens or (len(tokens) < FEW and tokens[-1][0] not in ".!?"):
        return []
    function = sum(1 for t in tokens if t in FUNCTION_WORDS)
    return tokens if function >= ENGLISH * len(tokens) else []


def line_sums(line: str, vocabulary: dict[str, tuple[float, float]]) -> tuple | None:
    tokens = line_tokens(line)
    if not tokens:
        return None
    words = plain = sentences = commas = letters = long = clauses = joins = of = function = known = hard = easy = 0
    difficulty = rarity = 0.0
    get = vocabulary.get
    for t in tokens:
        c = t[0]
        if "a" <= c <= "z":
            words += 1
            plain += 1
            n = len(t)
            if t in FUNCTION_WORDS:
                function += 1
                if t == "of":
                    of += 1
                elif t == "and":
                    joins += 1
            else:
                letters += n
                long += n >= 10
                if t in CLAUSE_WORDS:
                    clauses += 1
                elif t in JOINING_WORDS:
                    joins += 1
            v = get(t)
            if v is not None:
                known += 1
                difficulty += v[0]
                rarity += v[1]
                hard += v[0] > 3.7
                easy += v[0] < 2.3
        elif c in ".!?":
            sentences += 1
        elif c in ",;":
            commas += 1
        else:
            words += 1
    if tokens[-1][0] not in ".!?":
        sentences += 1
    return words, plain, sentences, commas, letters, long, clauses, joins, of, function, known, difficulty, hard, easy, rarity


def features(sums: np.ndarray) -> np.ndarray:
    """Rows of SUMS to rows of FEATURES."""
    s = {n: sums[:, k].astype(float) for k, n in enumerate(SUMS)}
    one = lambda x: np.maximum(x, 1.0)
    known, content, sentences = one(s["known"]), one(s["plain"] - s["function"]), one(s["sentences"])
    return np.stack(
        [
            s["difficulty"] / known, s["hard"] / known, s["easy"] / known, s["rarity"] / known, s["letters"] / content, s["long"] / content,
            np.log(one(s["words"]) / sentences), s["commas"] / sentences, s["clauses"] / sentences, s["joins"] / sentences, s["of"] / sentences, s["function"] / one(s["plain"]),
        ],
        axis=1,
    )


def _summed(documents: DataFrame, keep: list[str], vocabularies: dict[int, dict[str, tuple[float, float]]], finish, schema: str, memo_chars: int = 48_000_000) -> DataFrame:
    """``finish(batch, sums)`` of every batch of documents; ``keep`` columns precede the text.

    Of several vocabularies the first of ``keep`` names the one that a document is read with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: dict[int, dict[str, tuple | None]] = {k: {} for k in vocabularies}
        size = 0
        for batch in batches:
            sums = np.zeros((batch.num_rows, len(SUMS)))
            folds = batch.column(0).to_pylist() if len(vocabularies) > 1 else None
            for row, value in enumerate(batch.column(len(keep))):
                text = value.as_py()
                if not text:
                    continue
                fold = folds[row] if folds else 0
                memo, vocabulary = memos[fold], vocabularies[fold]
                parts = []
                for line in text.split("\n"):
                    if not line:
                        continue
                    if line in memo:
                        part = memo[line]
                    else:
                        if size > memo_chars:
                            for one in memos.values():
                                one.clear()
                            size = 0
                        part = memo[line] = line_sums(line, vocabulary)
                        size += len(line) + 200
                    if part is not None:
                        parts.append(part)
                if parts:
                    sums[row] = parts[0] if len(parts) == 1 else list(map(sum, zip(*parts, strict=True)))
            yield finish(batch, sums)

    return documents.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def fit_ranker(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a linear ranker over all pairs of different grades, weighted by the difference.

    Newton's method; pairs are taken in blocks of rows, so memory holds ``block`` times the documents. Grades
    less than 0.75 apart are ties, as single grades may be one step off.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    order = np.argsort(y, kind="stable")
    z, y = z[order], y[order]
    w = np.zeros(x.shape[1])
    # of row k, the rows from above[k] on are harder
    above = np.searchsorted(y, y + 0.75 - 1e-9, side="left")
    starts = range(0, len(y), block)
    gap_of = lambda i: np.maximum(y[None, above[i] :] - y[i : i + block, None], 0.0) * (np.arange(above[i], len(y))[None, :] >= above[i : i + block, None])
    total = sum(float(gap_of(i).sum()) for i in starts)
    if not total:
        return mean, scale, w
    for _ in range(30):
        score = z @ w
        grad, hess = ridge * w, ridge * np.eye(len(w))
        for i in starts:
            gap = gap_of(i)
            low, high = z[i : i + block], z[above[i] :]
            p = 1 / (1 + np.exp(np.clip(score[None, above[i] :] - score[i : i + block, None], -30, 30)))
            miss = gap * p
            grad = grad - (high.T @ miss.sum(axis=0) - low.T @ miss.sum(axis=1)) / total
            c = miss * (1 - p) / total
            cross = low.T @ c @ high
            hess = hess + (low.T * c.sum(axis=1)) @ low + (high.T * c.sum(axis=0)) @ high - cross - cross.T
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (pool adjacent violators) as points to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """Fitted ranker; ``levels`` gives calibrated levels of rows of SUMS."""

    def __init__(self, vocabulary, mean, scale, weights, steps, values):
        self.vocabulary, self.mean, self.scale, self.weights, self.steps, self.values = vocabulary, mean, scale, weights, steps, values

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return ((features(sums) - self.mean) / self.scale) @ self.weights

    def levels(self, sums: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.full(len(sums), np.nan)
        return np.interp(self.scores(sums), self.steps, self.values)


def _vocabulary(docs: dict[str, int], grades: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Difficulty and rarity of the words that two documents have: the mean grade of the documents that have a word,
    drawn to the middle where they are few, and the log of how seldom it is."""
    kept = {w: n for w, n in docs.items() if n >= 2}
    if not kept:
        return {}
    most = max(kept.values())
    middle = sum(grades[w] for w in kept) / sum(kept.values())
    return {w: ((grades[w] + 3 * middle) / (n + 3), math.log(most / n)) for w, n in kept.items()}


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` graded documents; null levels and ungraded documents are left out.

    Of several grades of a document the mean counts. Without any usable grade the model gives no
    levels (null).
    """
    grades = labels.where(F.col("level").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("level").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    grades = grades.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    graded = cut(documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(grades), "doc_id"))  # at most ``sample`` rows

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, str], list[float]] = {}
        for batch in batches:
            for fold, grade, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen = {t for line in text.split("\n") for t in line_tokens(line) if "a" <= t[0] <= "z"}
                for t in seen:
                    at = total.setdefault((fold, t), [0, 0.0])
                    at[0] += 1
                    at[1] += grade
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.float64())], names=["fold", "word", "docs", "grades"])

    # words of the sample: bounded by it
    rows = graded.select("fold", "grade", "text").mapInArrow(words_of, "fold int, word string, docs long, grades double").groupBy("fold", "word").agg(F.sum("docs").alias("docs"), F.sum("grades").alias("grades")).collect()
    rows.sort(key=lambda r: (r.fold, r.word))
    docs: dict[str, int] = {}
    sums_: dict[str, float] = {}
    for r in rows:
        docs[r.word] = docs.get(r.word, 0) + r.docs
        sums_[r.word] = sums_.get(r.word, 0.0) + r.grades
    vocabulary = _vocabulary(docs, sums_)
    none = Model(vocabulary, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), np.array([]), np.array([]))
    if not vocabulary:
        return none
    others = {}
    for fold in range(FOLDS):
        less, lower = dict(docs), dict(sums_)
        for r in rows:
            if r.fold == fold:
                less[r.word] -= r.docs
                lower[r.word] -= r.grades
        others[fold] = _vocabulary(less, lower)

    def finish(batch: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(sums))], names=["grade", "sums"])

    got = _summed(graded, ["fold", "grade"], others, finish, "grade double, sums array<double>").collect()
    used = [r for r in got if r.sums[0] >= MIN_WORDS]
    if len(used) < 2:
        return none
    order = np.lexsort([np.array([r.sums[k] for r in used]) for k in (0, 4, 11)])  # the same whatever order rows came in
    sums, y = np.array([used[k].sums for k in order]), np.array([used[k].grade for k in order])
    mean, scale, weights = fit_ranker(features(sums), y)
    model = Model(vocabulary, mean, scale, weights, np.array([]), np.array([]))
    model.steps, model.values = isotonic(model.scores(sums), y)
    return model


def levels(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, words, english (share of function words), score and level of every document.

    A document without English prose of at least one line (null, empty, other languages) has 0 words
    and null score and level. Repeated rows are kept; extra columns are ignored.
    """

    def finish(batch: pa.RecordBatch, sums: np.ndarray) -> pa.RecordBatch:
        words, none = sums[:, 0].astype(np.int64), sums[:, 0] == 0
        score, level = model.scores(sums), model.levels(sums)
        english = sums[:, SUMS.index("function")] / np.maximum(sums[:, 0], 1)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(english), pa.array(score, mask=none), pa.array(level, mask=none | np.isnan(level))], names=["doc_id", "words", "english", "score", "level"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _summed(documents, ["doc_id"], {0: model.vocabulary}, finish, f"doc_id {kind}, words long, english double, score double, level double")


def demanding(documents: DataFrame, labels: DataFrame, least: float = 3.5, min_words: int = MIN_WORDS, sample: int = SAMPLE) -> DataFrame:
    """doc_id of the English documents with at least ``min_words`` words of prose and a level that rounds to 4 or 5."""
    return levels(documents, fit(documents, labels, sample)).where((F.col("words") >= min_words) & (F.col("level") >= least)).select("doc_id")
