import base64
import random

import pytest

from quillgrid.llm import merge_replay as m


@pytest.fixture(scope="module")
def ranks():
    return m.read_ranks(f"{m.TOKENIZERS}/{m.NAME}.tiktoken")


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=m.WORD, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, text):
    import numpy as np

    lines = encoder.lines_of([text])[0]
    return [i for x in lines for i in np.frombuffer(encoder.lines[x], dtype=np.int32).tolist()]


def test_any_text(ranks, reference):
    rng = random.Random(5)
    alphabet = "ab cd'sé漢\n\t \xa0\x85\x1c ᠎​1２'LL'T.🤪\r_"
    encoder = m.Encoder(ranks, m._packed)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50)))
        assert ids_of(encoder, text) == reference.encode_ordinary(text)


def test_full_memos_change_nothing(ranks, reference):
    encoder = m.Encoder(ranks, m._packed, memo_chars=10)
    for text in ("one two\nthree", "one two\nthree", "aaaaaaaaaaaaaaaaaaaaab", "poopa" * 3000):
        assert ids_of(encoder, text) == reference.encode_ordinary(text)


def test_tables(spark, ranks, reference):
    rows = [(1, "Hello  world\n\n x", "a"), (2, "", "b"), (3, None, "c"), (4, "<|endoftext|> I'll", "d"), (4, "<|endoftext|> I'll", "d"), (5, " \n \n ", None), (6, "é 漢\r\n" * 200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in m.encode(df).collect())
    assert got == sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    counts = sorted((r.doc_id, r.n_tokens) for r in m.count_tokens(df).collect())
    assert counts == sorted((i, len(reference.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert m.encode(df.limit(0)).collect() == []


def test_whole_table_and_the_other_library(spark, small):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{m.TOKENIZERS}/{m.NAME}.json")
    other.encode_special_tokens = True
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.ids for r in m.encode(docs).collect()}
    assert got == {i: other.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_own_ranks():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc"]
    own = {t: k for k, t in enumerate(tokens)}
    assert base64.b64encode(b"ab")
    assert m.Replay(own).encode([b"abc", b"bcab", b"aab"]) == [[258], [257, 256], [97, 256]]
    assert m.Replay(own).encode([]) == []
