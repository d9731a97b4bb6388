"""Encoding of a corpus with a public byte-level BPE tokenizer: merge replay over its words.

BPE merges are ordered by rank, and a merge never makes a pair of a lower rank possible that was
not possible before it was learnt; so instead of searching each text for its next merge, all words
of a block of the corpus are merged together: an inverted index leads from a token pair to the
positions where it stands, a heap gives the pairs in rank order, and a merge touches only its
positions and their neighbours. Every distinct word of a task's share of the corpus is so replayed
once, and texts are put together from the ids of their words.

The index belongs to a task's share rather than to the whole corpus: the vocabulary of 100 TB fits
neither a driver nor a broadcast, and a join of all word occurrences with their ids would shuffle
the corpus several times over. So the operator needs no shuffle, no driver memory and no broadcast
but the tokenizer's file, whose size is fixed.

Texts repeat lines (revisions, mirrors, boilerplate), so ids are kept by line too. A line break
after a non-space character always begins a new word, so lines can be encoded apart. Both memos
hold at most ``memo_chars`` characters of keys and start afresh beyond that, which changes nothing
but the time.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where public tokenizers lie: the folder named here, else the one of the session's setting.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Fixed: how this public tokenizer family divides text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for lines of ASCII only, by the faster of the two engines.
ASCII_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def split_lines(text: str) -> list[str]:
    """Parts that can be encoded apart: each line break after a non-space character begins one."""
    out, cur = [], None
    for part in text.split("\n"):
        if cur is None:
            cur = part
        elif cur and not cur[-1].isspace():
            out.append(cur)
            cur = "\n" + part
        else:
            cur += "\n" + part
    out.append(cur)
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Replay:
    """Replays merges over blocks of words. ``ranks`` gives ids and merge order, as in the file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.token = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], int | None] = {}

    def merged(self, left: int, right: int) -> int | None:
        """Id of the token that the pair merges to, if it does; it is the merge's rank too."""
        pair = (left, right)
        if pair in self.pairs:
            return self.pairs[pair]
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        found = self.pairs[pair] = self.ranks.get(self.token[left] + self.token[right])
        return found

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (none is empty), all words merged together."""
        ids: list[int] = []
        starts = []
        for word in words:
            starts.append(len(ids))
            ids.extend(map(self.byte_ids.__getitem__, word))
        size = len(ids)
        # doubly linked positions; a word's first has no left, its last no right neighbour
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        for s in starts:
            before[s] = -1
            if s:
                after[s - 1] = -1
        if size:
            after[size - 1] = -1
        index: dict[int, list[int]] = {}  # the rank of a merge to the positions of its left tokens
        merged = self.merged
        for p in range(size):
            n = after[p]
            if n >= 0 and (rank := merged(ids[p], ids[n])) is not None:
                index.setdefault(rank, []).append(p)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            # from left to right, so that of overlapping pairs the first merges
            for p in sorted(index.pop(rank)):
                n = after[p]
                if n < 0 or ids[p] < 0 or merged(ids[p], ids[n]) != rank:
                    continue  # an earlier merge took one of the two
                ids[p] = rank
                ids[n] = -1
                behind = after[p] = after[n]
                if behind >= 0:
                    before[behind] = p
                    new = merged(rank, ids[behind])
                    if new is not None:
                        at = index.get(new)
                        if at is None:
                            index[new] = [p]
                            heapq.heappush(heap, new)
                        else:
                            at.append(p)
                front = before[p]
                if front >= 0:
                    new = merged(ids[front], rank)
                    if new is not None:
                        at = index.get(new)
                        if at is None:
                            index[new] = [front]
                            heapq.heappush(heap, new)
                        else:
                            at.append(front)
        starts.append(size)
        return [[i for i in ids[a:b] if i >= 0] for a, b in zip(starts, starts[1:], strict=False)]


class Encoder:
    """Encodes batches of texts, with memos of words and lines.

    ``of_line`` turns the ids of a line into what is kept of it; see ``encode_texts`` and ``count_texts``.
    """

    def __init__(self, ranks: dict[bytes, int], of_line: Callable[[list[int]], object], memo_chars: int = 32_000_000):
        self.replay = Replay(ranks)
        self.find, self.find_ascii = regex.compile(WORD).findall, re.compile(ASCII_WORD, re.ASCII).findall
        self.of_line, self.memo_chars = of_line, memo_chars
        self.words: dict[str, list[int]] = {}
        self.lines: dict[str, object] = {}
        self.word_size = self.line_size = 0

    def lines_of(self, texts: list[str | None]) -> list[list[str]]:
        """The lines of each text; all of them are then in the memo."""
        if self.line_size > self.memo_chars:
            self.lines.clear()
            self.line_size = 0
        if self.word_size > self.memo_chars // 2:
            self.words.clear()
            self.word_size = 0
        divided = [split_lines(t) if t else [] for t in texts]
        fresh: dict[str, list[str]] = {}
        unknown: dict[str, None] = {}
        for lines in divided:
            for line in lines:
                if line not in self.lines and line not in fresh:
                    found = fresh[line] = self.find_ascii(line) if line.isascii() else self.find(line)
                    for word in found:
                        if word not in self.words:
                            unknown[word] = None
        if unknown:
            for word, ids in zip(unknown, self.replay.encode([w.encode("utf-8", "replace") for w in unknown]), strict=True):
                self.words[word] = ids
                self.word_size += len(word) + 16
        for line, found in fresh.items():
            ids: list[int] = []
            for word in found:
                ids += self.words[word]
            self.lines[line] = self.of_line(ids)
            self.line_size += len(line) + 16
        return divided


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype=np.int32).tobytes()


def _each(batch: pa.RecordBatch, column: int, chars: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about so many characters, so that memory is bounded by one text and this."""
    texts: list[str | None] = []
    start, size = 0, 0
    for k, value in enumerate(batch.column(column)):
        text = value.as_py()
        texts.append(text)
        size += len(text) if text else 0
        if size >= chars:
            yield start, texts
            start, texts, size = k + 1, [], 0
    if texts:
        yield start, texts


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None, name: str = NAME) -> DataFrame:
    """doc_id and ids (list of int) of every document, without special tokens.

    An empty or null text gives an empty list; the strings of special tokens in a text are ordinary
    text. Repeated rows are kept. Other columns are ignored. Texts are encoded whole, whatever their
    length. ``folder`` holds the vocabulary files on every executor.
    """
    path = os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(read_ranks(path), _packed)
            for start, texts in _each(batch, 1, 4_000_000):
                divided = encoder.lines_of(texts)
                lines = encoder.lines
                packed = [b"".join([lines[x] for x in one]) for one in divided]
                offsets = np.zeros(len(packed) + 1, dtype=np.int64)
                np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), ids], names=["doc_id", "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", folder: str | None = None, name: str = NAME) -> DataFrame:
    """The columns ``keep`` of every document and n_tokens, 0 for an empty or null text."""
    path = os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")
    size = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(read_ranks(path), len)
            for start, texts in _each(batch, size, 4_000_000):
                divided = encoder.lines_of(texts)
                lines = encoder.lines
                counts = pa.array([sum([lines[x] for x in one]) for one in divided], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, len(texts)) for k in range(size)), counts], names=[*keep, "n_tokens"])

    selected = documents.select(*keep, F.col(text_column).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in selected.schema.fields[:size])
    return selected.mapInArrow(run, f"{schema}, n_tokens long")
