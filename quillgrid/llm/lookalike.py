"""One consistent form for text that looks the same: look-alike lattices searched with Viterbi.

First comes what no reader can see: characters that take no room are deleted, width variants and
non-breaking spaces and hyphens become plain ones, presentation ligatures their letters. Then the
text is taken apart into base characters and marks, and every base character that another script
draws the same way gets all its look-alikes as states of a lattice. The path with the best score
under character bigrams, with a charge for every change of script, is the text's form: a change
within a word is dear, one between words cheap, so words keep to one script and ambiguous words
follow their neighbours. States do not depend on which look-alike was written, so two texts that
look the same have the same form. Marks are put back and composed (NFC).

Visible differences (accents, case, signs such as superscripts) are kept. The bigrams are counted
over all given texts, from words whose letters are all of one script as written.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters drawn alike, Latin first; in each group at most one of a script.
ALIKE = """
a а
c с ϲ
d ԁ
e е
g ɡ
h һ
i і
j ј ϳ
l ӏ
o о ο օ
p р
q ԛ
s ѕ
v ѵ ν
w ԝ
x х
y у
A А Α
B В Β
C С Ϲ
E Е Ε
G Ԍ
H Н Η
I І Ι
J Ј
K К Κ
M М Μ
N Ν
O О Ο Օ
P Р Ρ
Q Ԛ
S Ѕ Տ
T Т Τ
V Ѵ
W Ԝ
X Х Χ
Y Ү Υ
Z Ζ
Đ Ð
Đ Ɖ
І Ӏ
У Ү
ə ә
Ə Ә
æ ӕ
Æ Ӕ
"""
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
#: Characters without width of their own (ignorable by default), as ranges.
IGNORABLE = "­͏؜ᅟ-ᅠ឴-឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
_IGNORABLE = re.compile(f"[{IGNORABLE}]+")
_HYPHENS = {"‐": "-", "‑": "-"}
_WORD = re.compile(r"[^\W\d_]+")
SWITCH_IN_WORD, SWITCH_BETWEEN, UNSEEN = 14.0, 4.0, -11.0


def _folded(ch: str) -> str:
    """A character without its invisible traits: width, line breaking, ligature drawing."""
    if ch in _HYPHENS:
        return _HYPHENS[ch]
    how = unicodedata.decomposition(ch)
    if how.startswith(("<wide>", "<narrow>", "<noBreak>")) or "ﬀ" <= ch <= "ﬆ":
        plain = unicodedata.normalize("NFKC", ch)
        return _HYPHENS.get(plain, plain)
    return " " if unicodedata.category(ch) == "Zs" else ch


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        value = self[code] = _folded(chr(code))
        return value


_FOLD = _Fold()


def visible(text: str) -> str:
    """The text without invisible traits, decomposed (NFD)."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", _IGNORABLE.sub("", text).translate(_FOLD))


class _Script(dict):
    def __missing__(self, ch: str) -> str | None:
        name = unicodedata.name(ch, "") if ch.isalpha() else None
        value = self[ch] = None if name is None else next((s for s in SCRIPTS if name.startswith(s)), "OTHER")
        return value


_SCRIPT = _Script()


def script(ch: str) -> str | None:
    """The script of a letter, None of anything else."""
    return _SCRIPT[ch]


def _groups() -> dict[str, tuple[str, ...]]:
    found: dict[str, set[str]] = {}
    for line in ALIKE.split("\n"):
        chars = set(line.split())
        for ch in list(chars):
            chars |= found.get(ch, set())
        for ch in chars:
            found[ch] = chars
    return {ch: tuple(sorted(chars, key=lambda c: ((*SCRIPTS, "OTHER").index(script(c) or "OTHER"), c))) for ch, chars in found.items()}


class Lattice:
    """Finds forms. ``pairs`` has log probabilities of (first, second) letters, '^' starting a word."""

    def __init__(self, pairs: dict[tuple[str, str], float]):
        self.pairs, self.groups = pairs, _groups()
        self.key = {ord(ch): chars[0] for ch, chars in self.groups.items()}
        self.words: dict[str, dict[str, tuple[float, str]]] = {}

    def word(self, key: str) -> dict[str, tuple[float, str]]:
        """Best path through the lattice of a word, by the script it keeps to: score and letters.

        ``key`` has one representative of each group of look-alikes, so it stands for all words that
        look like this one.
        """
        known = self.words.get(key)
        if known is not None:
            return known
        layer: dict[tuple[str | None, str], tuple[float, tuple]] = {(None, "^"): (0.0, ())}
        for ch in key:
            fresh: dict[tuple[str | None, str], tuple[float, tuple]] = {}
            for to in self.groups.get(ch, (ch,)):
                kind = script(to)
                for (had, last), (score, path) in layer.items():
                    score += self.pairs.get((last, to), UNSEEN) - (SWITCH_IN_WORD if had and kind and had != kind else 0.0)
                    # a mark is of no script: the path keeps the one it had
                    at = (kind or had, to)
                    if at not in fresh or score > fresh[at][0]:
                        fresh[at] = (score, (path, to))
            layer = fresh
        out: dict[str, tuple[float, str]] = {}
        for (kind, last), (score, path) in sorted(layer.items(), key=lambda x: (str(x[0][0]), x[0][1])):
            score += self.pairs.get((last, "$"), UNSEEN)
            if kind not in out or score > out[kind][0]:
                letters = []
                while path:
                    path, one = path
                    letters.append(one)
                out[kind] = (score, "".join(reversed(letters)))
        if len(self.words) > 500_000:
            self.words.clear()
        self.words[key] = out
        return out

    def form(self, text: str | None) -> str | None:
        """The form of a text; null stays null, and ASCII text of no letters stays as it is."""
        if text is None:
            return None
        plain = visible(text)
        key = plain.translate(self.key)
        parts = _split_words(key)
        states: dict[str | None, tuple[float, tuple]] = {None: (0.0, ())}
        for is_word, part in parts:
            if not is_word:
                continue
            fresh: dict[str | None, tuple[float, tuple]] = {}
            for kind, (gain, letters) in self.word(part).items():
                best = None
                for had, (score, path) in states.items():
                    s = score + gain - (SWITCH_BETWEEN if had and kind and had != kind else 0.0)
                    if best is None or s > best[0]:
                        best = (s, (path, letters))
                if kind not in fresh or best[0] > fresh[kind][0]:
                    fresh[kind] = best
            states = fresh
        _, path = max(states.values(), key=lambda x: x[0])
        words = []
        while path:
            path, letters = path
            words.append(letters)
        out = "".join(words.pop() if is_word else part for is_word, part in parts)
        return out if out.isascii() else unicodedata.normalize("NFC", out)


_PARTS = re.compile(r"((?:[^\W\d_][̀-ͯ]*)+)")


def _split_words(text: str) -> list[tuple[bool, str]]:
    """Runs of letters with their marks, and what lies between them."""
    return [(k % 2 == 1, part) for k, part in enumerate(_PARTS.split(text)) if part]


def count_pairs(texts: Iterator[str | None]) -> Counter:
    """Letter pairs of the words whose letters are all of one script, with '^' before and '$' after a word."""
    words: Counter = Counter()
    for text in texts:
        if text:
            words.update(part for is_word, part in _split_words(visible(text)) if is_word)
    pairs: Counter = Counter()
    for word, n in words.items():
        kinds = {s for ch in word if (s := script(ch))}
        if len(kinds) != 1 or next(iter(kinds)) == "OTHER":
            continue
        last = "^"
        for ch in word + "$":
            pairs[last, ch] += n
            last = ch
    return pairs


def learn(texts: DataFrame) -> dict[tuple[str, str], float]:
    """Log probabilities of letter pairs, counted over all rows of the one text column.

    The table is bounded by the square of the letters of the scripts that have look-alikes, whatever
    the corpus holds. Without any text every pair is unseen, and forms follow the scripts alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(count_pairs(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total]), pa.array([b for _, b in total]), pa.array(list(total.values()), pa.int64())], names=["a", "b", "n"])

    text = texts.columns[0]
    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    first: Counter = Counter()
    for r in rows:
        first[r.a] += r.n
    return {(r.a, r.b): log((r.n + 0.1) / (first[r.a] + 20)) for r in rows}


def forms(rows: DataFrame, keys: list[str], text: str, pairs: dict[tuple[str, str], float]) -> DataFrame:
    """``keys``, the text and its form, for every row; null texts have a null form, empty ones ''."""
    size = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, seen, chars = Lattice(pairs), {}, 0
        for batch in batches:
            out = []
            for one in batch.column(size).to_pylist():
                form = seen.get(one)
                if form is None and one is not None:
                    if chars > 16_000_000:
                        seen.clear()
                        chars = 0
                    form = seen[one] = lattice.form(one)
                    chars += 2 * len(one)
                out.append(form)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(size)), batch.column(size), pa.array(out, pa.string())], names=[*keys, "text", "form"])

    selected = rows.select(*keys, F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in selected.schema.fields)
    return selected.mapInArrow(run, f"{schema}, form string")


def texts_of(cells: DataFrame, text_boxes: DataFrame, styled_spans: DataFrame) -> DataFrame:
    """src, row_id and text of the three tables."""
    one = lambda df, src, key, text: df.select(F.lit(src).alias("src"), F.col(key).cast("long").alias("row_id"), F.col(text).cast("string").alias("text"))
    return one(cells, "cells", "cell_id", "value").unionByName(one(text_boxes, "text_boxes", "box_id", "text")).unionByName(one(styled_spans, "styled_spans", "span_id", "text"))


def same_as_terms(cells: DataFrame, text_boxes: DataFrame, styled_spans: DataFrame, terms: DataFrame) -> DataFrame:
    """src, row_id and term_id of every row whose whole text looks like a term but is written otherwise.

    Rows equal to a term, null and empty texts and terms are left out; a row that looks like two terms
    of the same look gives two rows, repeated rows are kept. Joined by form: the catalog is the
    smaller side and broadcast by Spark only where its size allows that.
    """
    rows = texts_of(cells, text_boxes, styled_spans).where(F.col("text").isNotNull() & (F.col("text") != ""))
    pairs = learn(rows.select("text").unionByName(terms.select(F.col("term").alias("text"))))
    catalog = forms(terms.where(F.col("term") != ""), ["term_id"], "term", pairs).select("term_id", F.col("text").alias("term"), "form")
    found = forms(rows, ["src", "row_id"], "text", pairs).join(catalog, "form")
    return found.where(F.col("text") != F.col("term")).select("src", "row_id", F.col("term_id").cast("long").alias("term_id"))


def unified(cells: DataFrame, text_boxes: DataFrame, styled_spans: DataFrame, terms: DataFrame) -> DataFrame:
    """src, row_id and form of every row that has a text, by the bigrams that ``same_as_terms`` has.

    A form that is the form of a term is given as the term is written.
    """
    rows = texts_of(cells, text_boxes, styled_spans).where(F.col("text").isNotNull())
    pairs = learn(rows.where(F.col("text") != "").select("text").unionByName(terms.select(F.col("term").alias("text"))))
    named = forms(terms.where(F.col("term") != ""), ["term_id"], "term", pairs).groupBy("form").agg(F.min("text").alias("term"))
    return forms(rows, ["src", "row_id"], "text", pairs).join(named, "form", "left").select("src", "row_id", F.coalesce("term", "form").alias("form"))
