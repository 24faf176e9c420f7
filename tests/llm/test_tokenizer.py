"""The numpy tokenizer against the library's own encoder."""

import base64
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from factweave.llm import tokenizer as K  # noqa: E402

PATH = f"{K.DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = [
    "", " ", "Hello world", "<|endoftext|> is text", "aaa" * 500, "\r\n\t x\x0b", "naïve café 語語語 🧪👩🏽‍💻", "I'll've don't WE'RE", "=" * 3000 + "-=" * 400,
    " " * 5000 + "x", "0123456789" * 90, "‮abc‬\x00�", "語" * 2000,
]


def test_encodes_like_the_library(reference):
    rng = random.Random(7)
    texts = CASES + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x600), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randrange(200))) for _ in range(200)]
    texts.append("".join(rng.choice("abcde") for _ in range(30_000)))
    got = K.encoder(PATH).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == reference.encode_ordinary(text), text[:40]
        assert reference.decode(ids.tolist()) == text


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 3)
    e = K.BytePairEncoder(PATH)
    for _ in range(3):
        assert [x.tolist() for x in e.encode(["one two three four", None, "five six"])] == [reference.encode_ordinary("one two three four"), [], reference.encode_ordinary("five six")]


def test_spark_rows(spark, reference):
    data = [(1, "Hello", "x"), (2, None, "x"), (3, "", "x"), (None, "Hello", "x"), (1, "Hello", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in K.encode_texts(df, "doc_id", "text").collect()), key=str)
    hello = reference.encode_ordinary("Hello")
    assert got == sorted([(1, hello), (1, hello), (2, []), (3, []), (None, hello)], key=str)
    sizes = K.encode_texts(df, "doc_id", "text", lengths_only=True)
    assert sorted(r.n_tokens for r in sizes.collect()) == sorted([len(hello)] * 3 + [0, 0])
    assert K.encode_texts(df.where("false"), "doc_id", "text").count() == 0
