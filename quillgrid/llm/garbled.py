"""Text read in a wrong encoding: code-page swaps as substitution ciphers, learnt by EM.

A swap (bytes of one code page read in another) substitutes letters; which swaps a source suffered
is unknown. The model has letter bigrams of the languages at hand and, for each source (a document
of a table), weights of the swaps, among them 'none'. Expectation-maximization learns both from the
distinct words of all spans: each source's words are read softly under every swap (E), then bigrams
are counted anew over the words so read and each source's weights over its words (M), until the
number of damaged words settles. Code pages of single bytes give a substitution each, double-byte
pages and UTF-8 read as single bytes give substitutions of byte groups; UTF-8 damage is undone in
places and as often as it goes. Characters that no language writes (U+FFFD, C1 controls) are a swap
of their own, under which any letter may have stood there.

Known pages are where EM starts, as most sources have a handful of words only. A source whose words
the other sources make unlikely, and no known page explains, gets a mapping of its own: EM over its
pair counts learns each letter's emission over the characters shown (``solve_cipher``), and the
mapping is applied with translate().
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.lookalike import Lattice
from quillgrid.session import cut

#: Pages that text was read in (wrongly), that it was written in, and multi-byte ones it was written in.
READ = ("cp1252", "cp1251", "cp1250", "cp1253", "cp437", "cp850", "cp866", "mac_roman", "koi8_r")
WRITTEN = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "cp437", "cp737", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "mac_roman", "mac_cyrillic", "mac_latin2", "mac_greek")
DOUBLE = ("euc_jp", "cp932", "gb18030", "big5", "cp949")
_SPACE = re.compile(r"([ \t\r\n\f\v]+)")
_ZERO_WIDTH = re.compile("[​-‏⁠﻿͏]")
_LOSS = re.compile("[\x80-\x84\x86-\x9f\ufffd]")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_GAP = "\x01"
_MARKS = "«»„“”‘’‚…–—¿¡\xa0"


def _page(name: str) -> dict[str, int]:
    """Character to byte of a single-byte page; bytes it leaves undefined stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(name)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    if name == "cp1252":
        for b in range(128, 160):  # and as ISO 8859-1 reads them
            out.setdefault(chr(b), b)
    return out


PAGES = {name: _page(name) for name in READ}


#: Of each character, the pages (as bits) that show a first and a following byte of UTF-8 as it, and all bytes as characters of Latin-1.
LEADS: dict[str, int] = {}
FOLLOWS: dict[str, int] = {}
RAW: dict[str, dict[int, str]] = {}
for _k, (_name, _codes) in enumerate(PAGES.items()):
    RAW[_name] = {ord(_ch): chr(_b) for _ch, _b in _codes.items()}
    for _ch, _b in _codes.items():
        if 0xC2 <= _b <= 0xF4:
            LEADS[_ch] = LEADS.get(_ch, 0) | 1 << _k
        if 0x80 <= _b <= 0xBF:
            FOLLOWS[_ch] = FOLLOWS.get(_ch, 0) | 1 << _k


def _utf8_pages(word: str) -> list[str]:
    """The pages as which UTF-8 may have been read: without two such bytes together nothing can be undone."""
    mask, last = 0, 0
    for ch in word:
        if ch > "\x7f":
            mask |= last & FOLLOWS.get(ch, 0)
            last = LEADS.get(ch, 0)
        else:
            last = 0
    return [page for k, page in enumerate(READ) if mask >> k & 1] if mask else []


def _substitutions() -> dict[str, dict[int, str]]:
    """The single-byte swaps as translation tables, without those that equal an earlier one."""
    out: dict[str, dict[int, str]] = {}
    seen = set()
    for read in READ:
        for written in WRITTEN:
            if written == read:
                continue
            table = {}
            for ch, b in PAGES[read].items():
                try:
                    to = bytes([b]).decode(written)
                except UnicodeDecodeError:
                    continue
                table[ord(ch)] = to
            key = frozenset(table.items())
            if key not in seen:
                seen.add(key)
                out[f"{written} as {read}"] = table
    return out


def symbol(ch: str) -> str:
    """What bigrams see of a character: itself, or the class of a large script or of digits."""
    code = ord(ch)
    if code < 0x300:
        return "0" if ch.isdigit() and code < 128 else ch
    if 0x3040 <= code < 0x30A0:
        return "あ"
    if 0x30A0 <= code < 0x3100 or 0xFF66 <= code < 0xFFA0:
        return "ア"
    if 0x3400 <= code < 0xA000 or 0x20000 <= code < 0x32000:
        return "字"
    if 0xAC00 <= code < 0xD7B0 or 0x1100 <= code < 0x1200:
        return "한"
    if code >= 0x2E80:
        return "、" if unicodedata.category(ch)[0] in "PSZ" else "\x02"
    return ch


class _Symbols(dict):
    def __missing__(self, ch: str) -> str:
        value = self[ch] = symbol(ch)
        return value


_SYMBOLS = _Symbols()
_CLASSES = frozenset("あア字한、\x02")


def count_words(words: dict[str, float]) -> Counter:
    """(first, second) symbols of words with '^' and '$' around them, and (class, character) behind a gap mark.

    Words with characters that no language writes are no text and are not counted.
    """
    out: Counter = Counter()
    for word, n in words.items():
        if _LOSS.search(word):
            continue
        last = "^"
        for ch in word:
            s = symbol(ch)
            out[last, s] += n
            if s in _CLASSES:
                out[_GAP + s, ch] += n
            last = s
        out[last, "$"] += n
    return out


class Bigrams:
    """Log likelihood of words, smoothed towards how often symbols occur at all."""

    SMOOTH, UNSEEN, CAPITALS, LETTER = 4.0, -15.0, -4.0, -6.0

    def __init__(self, counts: dict[tuple[str, str], float]):
        self.first: Counter = Counter()
        self.single: Counter = Counter()
        self.chars: dict[str, float] = {}
        of_class: Counter = Counter()
        self.pairs = {}
        for (a, b), n in counts.items():
            if a[0] == _GAP:
                of_class[a[1]] += n
            else:
                self.first[a] += n
                self.single[b] += n
                self.pairs[a, b] = n
        total = sum(self.single.values()) or 1.0
        self.share = {s: n / total for s, n in self.single.items()}
        for (a, b), n in counts.items():
            if a[0] == _GAP:
                self.chars[b] = log(n / of_class[a[1]])
        self.memo: dict[tuple[str, str], float] = {}

    def step(self, a: str, b: str) -> float:
        at = (a, b)
        value = self.memo.get(at)
        if value is None:
            share = self.share.get(b, 0.0)
            value = log((self.pairs.get(at, 0) + self.SMOOTH * share) / (self.first.get(a, 0) + self.SMOOTH)) if share else self.UNSEEN
            self.memo[at] = value = max(value, self.UNSEEN)
        return value

    def knows(self, ch: str) -> bool:
        s = symbol(ch)
        return ch in self.chars if s in _CLASSES else self.share.get(s, 0.0) > 0

    def word(self, word: str) -> float:
        """Log likelihood of a word; one in capitals may be any word written so."""
        if word.isupper() and len(word) > 1:
            return max(self.spelt(word), self.spelt(word.lower()) + self.CAPITALS)
        return self.spelt(word)

    def spelt(self, word: str) -> float:
        last, score, memo = "^", 0.0, self.memo
        for ch in word:
            s = _SYMBOLS[ch]
            gain = memo.get((last, s))
            score += self.step(last, s) if gain is None else gain
            if s in _CLASSES:
                score += self.chars.get(ch, self.UNSEEN)
            last = s
        return score + self.step(last, "$")

    def lossy(self, word: str) -> float:
        """As ``word``, where any character may have stood at those that are lost."""
        last, score = "^", 0.0
        for ch in word + "$":
            if _LOSS.match(ch):
                last = None
                score += self.LETTER
                continue
            s = "$" if ch == "$" else _SYMBOLS[ch]
            score += self.step(last, s) if last else max(self.UNSEEN, log(self.share.get(s, 0.0) or 1e-9))
            if s in _CLASSES:
                score += self.chars.get(ch, self.UNSEEN)
            last = s
        return score


#: Log odds that a run of characters forms a UTF-8 sequence by damage rather than by chance.
FORM = 3.0
#: Swaps by number: single-byte ones, double-byte ones, UTF-8, and two more. A character is lost where no language
#: writes it and any letter may have stood there; a source's own mapping is learnt.
SWAPS = [*_substitutions(), *(f"{double} as {page}" for double in DOUBLE for page in READ), *(f"utf-8 as {page}" for page in READ), "lost", "learned"]
_NUMBER = {name: k for k, name in enumerate(SWAPS)}
LOST, LEARNED = _NUMBER["lost"], _NUMBER["learned"]


class Solver:
    """Readings of a word under the known swaps; what they are worth is for ``Bigrams`` to say."""

    def __init__(self):
        tables = _substitutions().values()
        # of each character, what it becomes and by which tables (as bits)
        self.becomes: dict[str, dict[str, int]] = {}
        for k, table in enumerate(tables):
            for code, to in table.items():
                if to.isalpha() or to in _MARKS:
                    into = self.becomes.setdefault(chr(code), {})
                    into[to] = into.get(to, 0) | 1 << k
        self.lattice = Lattice({})

    def undo_utf8(self, word: str, page: str) -> str:
        """The word with every run that is UTF-8 read as ``page`` decoded."""
        raw = word.translate(RAW[page])
        out, at = [], 0
        for m in _UTF8.finditer(raw):
            if any(ch > "\x7f" and ch not in PAGES[page] for ch in word[m.start() : m.end()]):
                continue  # a character that the page does not have
            try:
                right = m.group().encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += (word[at : m.start()], right)
            at = m.end()
        return "".join([*out, word[at:]]) if out else word

    def _utf8(self, plain: str) -> Iterator[tuple[int, str, float]]:
        """Readings as UTF-8, undone as often as it goes; each undoing makes a word shorter, so this ends."""
        for page in _utf8_pages(plain + "\xa0"):
            now = self.undo_utf8(plain, page)
            if now == plain:
                # a last byte that became a space: UTF-8 that ends too early
                now = self.undo_utf8(plain + "\xa0", page) if plain[-1:] > "\x7f" else plain
                if now != plain and now != plain + "\xa0" and now.count("\xa0") < plain.count("\xa0") + 1:
                    yield _NUMBER[f"utf-8 as {page}"], now, 0.0
                continue
            seen, todo = {now}, [(now, 1)]
            while todo:
                now, turns = todo.pop()
                fresh = sum(ch > "\x7f" and ch not in plain for ch in now)
                yield _NUMBER[f"utf-8 as {page}"], now, FORM * (max(1, fresh) + turns - 1)
                for other in _utf8_pages(now):
                    if (new := self.undo_utf8(now, other)) not in seen:
                        seen.add(new)
                        todo.append((new, turns + 1))

    def readings(self, word: str) -> list[tuple[int, str, float]]:
        """(swap, reading, log odds of its form) of every swap that can have made the word.

        A letter substitution gives letters and marks of text, at least one letter. Swaps that read the
        word alike are all there: the source's other words tell which of them it suffered.
        """
        plain = _ZERO_WIDTH.sub("", word)
        found = list(dict.fromkeys(self._utf8(plain)))
        if _LOSS.search(word):
            found.append((LOST, word, 0.0))
        high = list(dict.fromkeys(ch for ch in plain if ch > "\x7f"))
        if not high or all(ch == "\xa0" for ch in high):
            return found
        partial: list[tuple[int, dict[int, str]]] = [(-1, {})]
        for ch in high:
            into = self.becomes.get(ch, {})
            partial = [(both, table | {ord(ch): to}) for fits, table in partial for to, by in into.items() if (both := fits & by)]
        for fits, table in partial:
            if not any(to.isalpha() for to in table.values()) or (new := plain.translate(table)) == plain:
                continue
            while fits:
                low = fits & -fits
                found.append((low.bit_length() - 1, new, 0.0))
                fits ^= low
        for page, codes in PAGES.items():
            if all(map(codes.__contains__, high)):
                raw = plain.translate(RAW[page]).encode("latin-1")
                for double in DOUBLE:
                    try:
                        new = raw.decode(double)
                    except UnicodeDecodeError:
                        continue
                    if new != plain:
                        found.append((_NUMBER[f"{double} as {page}"], new, 0.0))
        return found

    def alike(self, word: str) -> str:
        """The word in letters of one script, where it is written with look-alikes of another."""
        return self.lattice.form(word)


#: Log odds of a swap against 'none' where nothing is known of the source, in the first and the later steps of EM (at
#: first bigrams still hold the damage itself, so readings must not be asked too much), and of one substituted letter alone.
START, LATER, LONE = -2.0, -6.0, -14.0
#: EM ends where the expected number of damaged words moves by less than this share, or after so many steps.
SETTLED, STEPS = 0.05, 6
#: A source joins a swap with this many expected words at least.
EVIDENCE = 0.5
_READING = "array<struct<swap int, new string, form double>>"
_SCORED = "word string, n double, entries array<struct<swap int, new string, gain double, base double>>"


def spans_of(pdf_spans: DataFrame, styled_spans: DataFrame) -> DataFrame:
    """src, span_id, source and text of both tables; the source is the document within its table."""
    one = lambda df, src: df.select(F.lit(src).alias("src"), F.col("span_id").cast("long").alias("span_id"), F.concat_ws("/", F.lit(src), F.col("doc_key").cast("string")).alias("source"), F.col("text").cast("string").alias("text"))
    return one(pdf_spans, "pdf_spans").unionByName(one(styled_spans, "styled_spans")).where(F.col("text").isNotNull())


def _wide(text: str) -> Column:
    return F.length(text) < F.octet_length(text)


def _words(spans: DataFrame, *keep: str) -> DataFrame:
    return spans.select(*keep, F.explode(F.split("text", r"[ \t\r\n\x0b\f]+")).alias("word")).where(F.col("word") != "")


def _count(spans: DataFrame) -> DataFrame:
    """(source, a, b, n) of the spans' words in one pass: of those beyond ASCII the number by source (a is the word, b null), of
    all others symbol pairs over all sources (source null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        wide: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = [*((s, w, None) for s, w in wide), *((None, a, b) for a, b in pairs)]
            done = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([float(n) for n in (*wide.values(), *pairs.values())], pa.float64())], names=["source", "a", "b", "n"])
            wide.clear()
            pairs.clear()
            return done

        for batch in batches:
            plain: Counter = Counter()
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text.isascii():
                    plain.update(text.split())
                else:
                    for word in _SPACE.split(text):
                        if word.isascii():
                            plain[word] += 1
                        else:
                            wide[source, word] += 1
            for blank in [w for w in plain if not w or w.isspace()]:
                del plain[blank]
            pairs.update(count_words(plain))
            if len(wide) > 200_000:
                yield out()
        yield out()

    return spans.select("source", "text").mapInArrow(run, "source string, a string, b string, n double").groupBy("source", "a", "b").agg(F.sum("n").alias("n"))


def _bigrams(weighted: DataFrame) -> dict[tuple[str, str], float]:
    """Symbol pairs of (word, n), to the driver: at most the square of the symbols, in practice a few ten thousand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(count_words(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total], pa.string()), pa.array([b for _, b in total], pa.string()), pa.array(list(total.values()), pa.float64())], names=["a", "b", "n"])

    rows = weighted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > 1e-6).mapInArrow(run, "a string, b string, n double")
    return {(r.a, r.b): r.n for r in rows.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def _lists(rows: list[list[tuple]], kinds: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """Lists of structs out of lists of tuples."""
    flat = list(zip(*(x for row in rows for x in row), strict=True)) or [()] * len(kinds)
    structs = pa.StructArray.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(flat, kinds, strict=True)], names=[name for name, _ in kinds])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), structs)


def _tuples(column: pa.ListArray) -> list[list[tuple]]:
    """As ``_lists``, back."""
    flat = column.flatten()
    rows = list(zip(*(flat.field(k).to_pylist() for k in range(flat.type.num_fields)), strict=True))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return [rows[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _read(words: DataFrame) -> DataFrame:
    """Every word (word, n) once, with its readings under all swaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            found = [solver.readings(w) for w in batch.column(0).to_pylist()]
            alike = [solver.alike(w) if f else None for w, f in zip(batch.column(0).to_pylist(), found, strict=True)]
            readings = _lists(found, [("swap", pa.int32()), ("new", pa.string()), ("form", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.string()), readings], names=["word", "n", "alike", "readings"])

    return words.mapInArrow(run, f"word string, n double, alike string, readings {_READING}")


def gains(bigrams: Bigrams, word: str, alike: str | None, readings: list[tuple[int, str, float]], base: dict[int, float], other: float, written: frozenset[str] | None = None) -> list[tuple[int, str, float, float]]:
    """(swap, reading, gain in log likelihood over 'none', log odds of the swap where the source shows none), of gains above 0.

    ``other`` are the log odds of a swap that ``base`` does not name. Readings with a symbol that no text has as it
    stands (``written``) are none, or EM would come to believe in its own.
    """
    plain = _ZERO_WIDTH.sub("", word)
    none = bigrams.word(plain)
    # written with look-alikes of another script, a word is odd but no damage
    less = max(0.0, bigrams.word(alike) - none) if alike is not None and alike != plain else 0.0
    lone = sum(ch > "\x7f" for ch in plain.replace("\xad", "")) == 1
    scores: dict[str, float] = {}
    out = []
    for swap, new, form in readings:
        if swap == LOST:
            out.append((swap, new, bigrams.lossy(plain) - none, 0.0))
            continue
        score = scores.get(new)
        if score is None:
            strange = written is not None and any(ch > "\x7f" and _SYMBOLS[ch] not in written for ch in new)
            score = scores[new] = -1e9 if strange else bigrams.word(new)
        # a decoded run is evidence of its own only if what it gives is a character that the texts have
        gain = score - none - less + (form if form and all(bigrams.knows(ch) for ch in new if ch > "\x7f") else 0.0)
        if gain > 0:
            odds = base.get(swap, other)
            out.append((swap, new, gain, min(odds, LONE) if lone and not form else odds))
    return out


#: Log odds, all told, below which a reading of a word is not taken up in a step of EM.
FAINT = -5.0


def _score(read: DataFrame, bigrams: Bigrams, base: dict[int, float], other: float, most: dict[int, float], written: frozenset[str], least: float = FAINT) -> DataFrame:
    """The words with readings of some weight: ``most`` are the log odds of each swap in the source where they are greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for row, (word, alike, readings) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _tuples(batch.column(3)), strict=True)):
                got = [g for g in gains(bigrams, word, alike, readings, base, other, written) if g[2] + max(g[3], most.get(g[0], g[3])) > least]
                if got:
                    keep.append(row)
                    found.append(got)
            chosen = pa.array(keep, pa.int64())
            entries = _lists(found, [("swap", pa.int32()), ("new", pa.string()), ("gain", pa.float64()), ("base", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), entries], names=["word", "n", "entries"])

    return read.where(F.size("readings") > 0).mapInArrow(run, _SCORED)


#: Rows up to which a written table is broadcast; beyond them Spark joins by sorting and splits hot keys.
BROADCAST = 200_000


def _small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """The table written once, marked for broadcast if it is counted to be small (``size``: of each row)."""
    df = cut(df)
    return F.broadcast(df) if (df.agg(F.sum(F.lit(1) if size is None else size)).first()[0] or 0) <= BROADCAST else df


def _logits(counted: DataFrame, scored: DataFrame, odds: DataFrame | None) -> DataFrame:
    """source, word, n and each reading's score: its gain and the log odds of its swap in the source."""
    rows = counted.join(_small(scored.select("word", "entries"), F.size("entries") + 1), "word")
    known = F.create_map().cast("map<int,double>") if odds is None else F.col("odds")
    if odds is not None:
        rows = rows.join(_small(odds, F.size("odds") + 1), "source", "left")
    return rows.select("source", "word", "n", F.transform("entries", lambda e: F.struct((e["gain"] + F.coalesce(F.try_element_at(known, e["swap"]), e["base"])).alias("score"), e["swap"].alias("swap"), e["new"].alias("new"))).alias("entries"))


def _expect(counted: DataFrame, scored: DataFrame, odds: DataFrame | None) -> DataFrame:
    """E step: source, word, swap, new and the expected number of the source's words so made."""
    rows = _logits(counted, scored, odds)
    weighed = rows.withColumn("entries", F.transform("entries", lambda e: F.struct(F.exp(F.least(e["score"], F.lit(300.0))).alias("weight"), e["swap"].alias("swap"), e["new"].alias("new"))))
    total = F.aggregate("entries", F.lit(1.0), lambda acc, e: acc + e["weight"])  # 'none' weighs 1
    each = weighed.select("source", "word", "n", total.alias("total"), F.explode("entries").alias("e"))
    return each.select("source", "word", F.col("e.swap").alias("swap"), F.col("e.new").alias("new"), (F.col("n") * F.col("e.weight") / F.col("total")).alias("n")).where(F.col("n") > 1e-2)


def learn(spans: DataFrame) -> dict:
    """EM over the distinct words of all spans.

    Words are counted by source in one pass; readings are made once a distinct word. E: readings of each
    source's words by bigrams and the source's swaps, softly. M: bigrams over the words so read, weights
    of the swaps by source and over all. Only symbol pairs and totals by swap go to the driver; words
    and weights of sources stay tables.
    """
    spread = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work a word: not to be coalesced
    words = cut(_count(spans).repartition(spread, F.xxhash64("source", "a")))
    counted = words.where(F.col("source").isNotNull()).select("source", F.col("a").alias("word"), "n")
    distinct = cut(_read(counted.groupBy("word").agg(F.sum("n").alias("n")).repartition(spread, F.xxhash64("word"))))
    ascii_pairs = {(r.a, r.b): r.n for r in words.where(F.col("source").isNull()).select("a", "b", "n").collect()}
    totals = counted.groupBy("source").agg(F.sum("n").alias("words"))
    every = totals.agg(F.sum("words")).first()[0] or 0.0

    def merged(*parts: DataFrame) -> Bigrams:
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        pairs: Counter = Counter(ascii_pairs)
        for key, n in _bigrams(rows).items():
            pairs[key] += n
        return Bigrams(pairs)

    own = distinct.select("word", "n")
    bigrams, odds, base, other, most, last = merged(own), None, {}, START, {}, None
    written = frozenset(s for s, share in bigrams.share.items() if share > 0)
    for _ in range(STEPS):
        expected = cut(_expect(counted, _score(distinct, bigrams, base, other, most, written), odds))
        found = {r.swap: r.n for r in expected.groupBy("swap").agg(F.sum("n").alias("n")).collect()}  # as many as there are swaps
        bigrams = merged(own, expected.select("word", (-F.col("n")).alias("n")), expected.where(F.col("swap") != LOST).select(F.col("new").alias("word"), "n"))
        now = sum(found.values())
        clean = max(every - now, 0.0) + 0.01
        whole = {s: (n + 0.01) / (every + 1.0) for s, n in found.items()}
        none = clean / (every + 1.0)
        base, other = {s: max(log(w / none), -9.0) for s, w in whole.items()}, -9.0
        # a source's weight of a swap: its own words and as much of the whole as five words
        own_swaps = expected.where(F.col("swap") != LOST).groupBy("source", "swap").agg(F.sum("n").alias("n"))
        general = F.create_map(*[x for s, w in whole.items() for x in (F.lit(s), F.lit(float(w)))]) if whole else F.create_map().cast("map<int,double>")
        prior = 5 * F.coalesce(F.try_element_at(general, F.col("swap")), F.lit(1e-6))
        by_source = own_swaps.groupBy("source").agg(F.sum("n").alias("damaged")).join(totals, "source").select("source", (F.greatest(F.col("words") - F.col("damaged"), F.lit(0.0)) + 5 * none).alias("clean"))
        each = own_swaps.where(F.col("n") >= EVIDENCE).join(by_source, "source").select("source", "swap", F.log((F.col("n") + prior) / F.col("clean")).alias("odds"))
        each = cut(each)
        most = {r.swap: r.odds for r in each.groupBy("swap").agg(F.max("odds").alias("odds")).collect()}
        odds = each.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("swap", "odds"))).alias("odds"))
        if last is not None and abs(now - last) <= SETTLED * max(now, 1.0):
            break
        last = now
    return {"bigrams": bigrams, "odds": odds, "base": base, "other": other, "most": most, "written": written, "counted": counted, "distinct": distinct, "expected": expected}


#: Ciphers of sources: mean log likelihood of a step beside a high character below which a source's words are no text as
#: they stand (seen by the other sources), steps needed, steps and gain needed for every letter, and the turns of EM.
UNLIKELY, ENOUGH, EVERY, PRICE, TURNS = -6.0, 150.0, 10.0, 8.0, 60
#: Starts of EM: the known pages that come nearest, and even ones.
NEAREST, EVEN = 3, 5
_EAST_ASIAN = r"[\x{2e80}-\x{d7ff}\x{f900}-\x{ffef}\x{20000}-\x{3ffff}]"


def _cipherable(word: str) -> bool:
    return all(ch in _SHOWN for ch in word if ch > "\x7f")


_SHOWN = frozenset(ch for page in PAGES.values() for ch in page)


def _source_pairs(rest: DataFrame) -> DataFrame:
    """source, a, b, n: pairs with a high character, of the words (source, word, n) that single-byte pages can show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str, str], float] = {}
        spelt: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in total], pa.string()) for i in range(3)), pa.array(list(total.values()), pa.float64())], names=["source", "a", "b", "n"])
            total.clear()
            return done

        for batch in batches:
            for source, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = spelt.get(word)
                if pairs is None:
                    if len(spelt) > 100_000:
                        spelt.clear()
                    marked = "^" + "".join(symbol(ch) for ch in word) + "$"
                    pairs = spelt[word] = [(a, b) for a, b in zip(marked, marked[1:], strict=False) if a > "\x7f" or b > "\x7f"] if _cipherable(word) else []
                for a, b in pairs:
                    total[source, a, b] = total.get((source, a, b), 0.0) + n
            if len(total) > 200_000:
                yield out()
        yield out()

    return rest.select("source", "word", "n").mapInArrow(run, "source string, a string, b string, n double").groupBy("source", "a", "b").agg(F.sum("n").alias("n"))


def solve_cipher(pairs: dict[tuple[str, str], float], bigrams: Bigrams) -> tuple[dict[str, str], float]:
    """A source's mapping of high characters to letters, and its gain in log likelihood over 'none'.

    EM over the source's pair counts: both letters behind a pair are hidden, their bigrams are given, and
    each letter's emission over the characters is learnt; ASCII stands for itself. Known pages and an even
    start compete, the likeliest end is climbed up letter by letter. Size: the square of the symbols,
    whatever the source holds.
    """
    shown = sorted({s for pair in pairs for s in pair})
    high = [s for s in shown if s > "\x7f"]
    # what bigrams know without this source
    left = Counter(bigrams.pairs)
    for key, n in pairs.items():
        left[key] = max(0.0, left[key] - n)
    without = Bigrams(left)
    letters = sorted(s for s, share in without.share.items() if s > "\x7f" and s not in _CLASSES and share > 1e-7 and (s.isalpha() or s in _MARKS))
    plain = [s for s in shown if s <= "\x7f"]
    if not high or not letters:
        return {}, 0.0
    hidden, at = plain + letters, {s: k for k, s in enumerate(shown)}
    logs = np.array([[without.step(a, b) for b in hidden] for a in hidden])
    single = np.array([without.share.get(s, 0.0) + (without.first.get(s, 0.0) / (sum(without.first.values()) or 1.0) if s == "^" else 0.0) for s in hidden])
    joint = single[:, None] * np.exp(logs)
    counts = np.zeros((len(shown), len(shown)))
    for (a, b), n in pairs.items():
        counts[at[a], at[b]] = n
    own = np.array([at[s] for s in plain], int)
    free = np.array([at[s] for s in high], int)
    p = len(plain)
    climb = np.array([[without.step(a, b) for b in hidden] for a in hidden])
    place = {s: k for k, s in enumerate(letters)}
    rng = np.random.default_rng(5)

    def worth(choice: np.ndarray) -> float:
        full = np.empty(len(shown), int)
        full[own] = np.arange(p)
        full[free] = p + choice
        return float((counts * climb[np.ix_(full, full)]).sum())

    common = int(single[p:].argmax())
    ranked = sorted(((worth(np.array([place.get(t.get(ord(ch), ""), common) for ch in high])), k, t) for k, t in enumerate(_substitutions().values())), key=lambda x: (-x[0], x[1]))
    starts: list[np.ndarray] = []
    for _, _, table in ranked[:NEAREST]:
        e = np.full((len(letters), len(high)), 0.02)
        for k, ch in enumerate(high):
            if table.get(ord(ch)) in place:
                e[place[table[ord(ch)]], k] += 1.0
        starts.append(e)
    starts += [1.0 + rng.random((len(letters), len(high))) for _ in range(EVEN)]
    best: tuple[float, np.ndarray] | None = None
    for e in starts:
        e = e / e.sum(axis=1, keepdims=True)
        for _ in range(TURNS):
            emit = np.zeros((len(hidden), len(shown)))
            emit[np.arange(p), own] = 1.0
            emit[p:, free] = e
            ratio = counts / np.maximum(emit.T @ joint @ emit, 1e-30)
            gained = emit * (joint @ emit @ ratio.T + joint.T @ emit @ ratio)
            e = gained[p:, free] + 1e-3
            e = e / e.sum(axis=1, keepdims=True)
        choice = (e * single[p:, None]).argmax(axis=0)
        now = worth(choice)
        if best is None or now > best[0]:
            best = (now, choice)
    now, choice = best
    for _ in range(6):
        before = now
        for k in range(len(high)):
            for letter in range(len(letters)):
                if letter != choice[k]:
                    old, choice[k] = choice[k], letter
                    if (new := worth(choice)) > now:
                        now = new
                    else:
                        choice[k] = old
        if now <= before:
            break
    best = (now, choice)
    none = sum(n * without.step(a, b) for (a, b), n in pairs.items())
    return {ch: letters[k] for ch, k in zip(high, best[1], strict=True)}, best[0] - none


def ciphers(learnt: dict) -> DataFrame:
    """source and table (character to letter) of the sources with a cipher of no known swap.

    A source is looked at if more than half of its words with high characters are in no other source and
    no known swap explains them. What known swaps leave of it is counted as pairs, and its mapping is
    learnt if the other sources make the pairs unlikely, and kept if it gains PRICE for every letter and
    rests on EVERY pairs for every letter.
    """
    bigrams: Bigrams = learnt["bigrams"]
    everywhere = _small(learnt["distinct"].select("word", F.col("n").alias("all")))
    alone = learnt["counted"].where(~F.col("word").rlike(_EAST_ASIAN)).join(everywhere, "word").groupBy("source").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("n") == F.col("all"), F.col("n"))).alias("own"))
    alone = _small(alone.where((F.col("own") * 2 > F.col("words")) & (F.col("words") * 4 >= ENOUGH)).select("source"))
    done = learnt["expected"].join(alone, "source", "left_semi").groupBy("source", "word").agg(F.sum("n").alias("done"))
    rest = learnt["counted"].join(alone, "source", "left_semi").join(done, ["source", "word"], "left").select("source", "word", (F.col("n") - F.coalesce("done", F.lit(0.0))).alias("n")).where(F.col("n") > 0.5)
    pairs = cut(_source_pairs(rest))
    spark = pairs.sparkSession
    # bounded by the square of the symbols
    rows = [(a, b, float(n), float(bigrams.first[a]), bigrams.share.get(b, 0.0)) for (a, b), n in bigrams.pairs.items()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    known = spark.createDataFrame(pa.table({name: pa.array(column, kind) for name, column, kind in zip(("a", "b", "pair", "first", "share"), columns, (pa.string(), pa.string(), *[pa.float64()] * 3), strict=True)}))
    firsts = pairs.groupBy("source", "a").agg(F.sum("n").alias("of_first"))
    others = F.greatest(F.coalesce("pair", F.lit(0.0)) - F.col("n"), F.lit(0.0)) + Bigrams.SMOOTH * F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(1e-7))
    seen = pairs.join(F.broadcast(known), ["a", "b"], "left").join(firsts, ["source", "a"]).select("source", "n", F.greatest(F.log(others / (F.greatest(F.coalesce("first", F.lit(0.0)) - F.col("of_first"), F.lit(0.0)) + Bigrams.SMOOTH)), F.lit(Bigrams.UNSEEN)).alias("step"))
    odd = seen.groupBy("source").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("step")) / F.sum("n")).alias("mean")).where((F.col("n") >= ENOUGH) & (F.col("mean") < UNLIKELY)).select("source")

    def run(table: pa.Table) -> pa.Table:
        source, *columns = (table.column(k).to_pylist() for k in range(4))
        mapping, gain = solve_cipher({(a, b): n for a, b, n in zip(*columns, strict=True)}, bigrams)
        kept = bool(mapping) and gain > PRICE * len(mapping) and sum(columns[2]) >= EVERY * len(mapping)
        return pa.table({"source": pa.array(source[:1] if kept else [], pa.string()), "chars": pa.array(["".join(mapping)] if kept else [], pa.string()), "letters": pa.array(["".join(mapping.values())] if kept else [], pa.string())})

    return cut(pairs.join(odd, "source", "left_semi").groupBy("source").applyInArrow(run, "source string, chars string, letters string"))


def damaged(spans: DataFrame) -> DataFrame:
    """source, word, swap and reading of every word of a source that a swap or cipher explains better than 'none'."""
    learnt = learn(spans)
    scored = _score(learnt["distinct"], learnt["bigrams"], learnt["base"], learnt["other"], learnt["most"], learnt["written"], 0.0)
    rows = _logits(learnt["counted"], scored, learnt["odds"]).select("source", "word", F.array_max("entries").alias("e")).where(F.col("e.score") > 0)
    known = cut(rows.select("source", "word", F.col("e.swap").alias("swap"), "e.new"))
    tables = ciphers(learnt)
    if tables.isEmpty():
        return known
    bigrams: Bigrams = learnt["bigrams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, word, chars, letters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = word.translate(str.maketrans(chars, letters))
                if new != word and _cipherable(word):
                    out.append((source, word, LEARNED, new))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))], names=["source", "word", "swap", "new"])

    left = learnt["counted"].join(known.select("source", "word"), ["source", "word"], "left_anti").join(tables, "source").select("source", "word", "chars", "letters")
    return known.unionByName(left.mapInArrow(run, "source string, word string, swap int, new string"))


def found(pdf_spans: DataFrame, styled_spans: DataFrame) -> DataFrame:
    """src and span_id of the garbled spans, each once: those with a damaged word of their source."""
    spans = spans_of(pdf_spans, styled_spans)
    words = _words(spans.where(_wide("text")), "src", "span_id", "source").where(_wide("word"))
    return words.join(_small(damaged(spans).select("source", "word")), ["source", "word"], "left_semi").select("src", "span_id").distinct()


def restore(pdf_spans: DataFrame, styled_spans: DataFrame) -> DataFrame:
    """The garbled spans: src, span_id, text, restored, swaps.

    ``restored`` has the original text as far as it can be told; where characters are lost (U+FFFD)
    or a word has no likelier reading, those words stay as they are. Null and empty texts are no
    cases; repeated spans are kept; a null document counts as a source of its own.
    """
    spans = spans_of(pdf_spans, styled_spans)
    words = _words(spans.where(_wide("text")), "src", "span_id", "source").where(_wide("word")).distinct()
    hits = words.join(_small(damaged(spans)), ["source", "word"]).groupBy("src", "span_id").agg(F.collect_set(F.struct("word", "new")).alias("readings"), F.collect_set("swap").alias("swaps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, readings in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                table = {r["word"]: r["new"] for r in readings}
                texts.append("".join(table.get(part, part) for part in _SPACE.split(text)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(texts, pa.string()), pa.array([sorted(SWAPS[k] for k in used) for used in batch.column(4).to_pylist()], pa.list_(pa.string()))], names=["src", "span_id", "text", "restored", "swaps"])

    return spans.join(hits, ["src", "span_id"]).select("src", "span_id", "text", "readings", "swaps").mapInArrow(run, "src string, span_id long, text string, restored string, swaps array<string>")
