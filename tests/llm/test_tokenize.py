"""Token ids against two independent encoders and round trips."""

import base64

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm import tokenize

ENCODER, WORDS = tokenize.load(tokenize.TOKENIZER)
REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
REFERENCE.encode_special_tokens = True


def ids(texts):
    flat, ends = ENCODER.encode(texts, WORDS)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(texts):
    assert ids(texts) == [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]


def test_other_encoder_and_round_trip():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "a" * 3000, "x́ नमस्ते 漢字 🏽‍💻", "<|endoftext|>", "it's  \n\t we'LL", "aaaabbbb" * 500, "\x00\x01 \r\n", " " * 999]
    got = ids(texts)
    assert got == [other.encode_ordinary(t) for t in texts]
    assert [other.decode(g) for g in got] == texts


def test_memory_is_emptied_without_loss(monkeypatch):
    monkeypatch.setattr(tokenize, "MEMORY_BYTES", 500)
    texts = [f"word{i} other{i * 7}" for i in range(300)]
    assert ids(texts) == [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]
    assert ids(texts[:5]) == [e.ids for e in REFERENCE.encode_batch(texts[:5], add_special_tokens=False)]


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(tokenize, "SLICE_BYTES", 50)
    rows = [(1, "hello world", 5), (2, "", 5), (3, None, 5), (None, "a", 5), (1, "hello world", 5), (4, "long " * 100, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in tokenize.encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted([(k, REFERENCE.encode(t or "", add_special_tokens=False).ids) for k, t, _ in rows], key=str)
    out = tokenize.encode_corpus(df.limit(0))
    assert out.count() == 0 and dict(out.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
