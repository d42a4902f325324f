from __future__ import annotations

import hashlib
import random

import pytest

from barloom.llm.bpe import decode, encode, encode_texts, load, round_trip_digest
from barloom.llm.common import table
from barloom.llm.queries import tokenizer_path

from .fixtures import AWKWARD, documents, rows

tokenizers = pytest.importorskip("tokenizers")

STRANGE = [
    "", " ", "\t\n\x0b\x0c\r", "hello world", "Hello,   WORLD!!! it's they'll I'VE", "ΣΑΣ Σ ΌΣΟΣ", "İstanbul ǅ ß ẞ ﬁ", "é ẛ̣ Å", "<|startoftext|> a <|endoftext|>b<|STARTOFTEXT|>",
    "12345 1.5e10 ½ ² ٣", " x y　z w​v﻿\x85k\x1c\x1d\x1e\x1f", "aaaaaaaaaaaaaaaaaaaaaaaa abababababababa", "日本語 テキスト 한국어 👩‍👩‍👧‍👦 🇩🇪", "a" * 5000, "\x00\x01\x7f", "don''t 's 're 'S", "\U0010ffff ",
    "<|endoftext|>", " <|endoftext|>  <|endoftext|> ", "<|end​oftext|>", "q̣̇ 각",
]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def expected(reference, texts):
    out = []
    for i, t in texts:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_strange_texts(reference):
    bpe = load(tokenizer_path())
    rng = random.Random(2)
    alphabet = [*"aabbcdeE .,'!1\n", "é", "Σ", "́", "ﬀ", "字", "\U0001f600", "<|endoftext|>"]
    texts = STRANGE + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    ids = encode_texts(bpe, texts)
    for text, got in zip(texts, ids):
        want = reference.encode(text, add_special_tokens=False).ids
        assert got == want, text
        assert bpe.decode(got) == reference.decode(want, skip_special_tokens=False)


def test_awkward_rows(spark, reference):
    assert rows(round_trip_digest(documents(spark, AWKWARD), tokenizer_path()), *COLUMNS) == expected(reference, AWKWARD)


def test_whole_table(spark, sf_dir, reference):
    docs = table(spark, sf_dir, "documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(round_trip_digest(docs, tokenizer_path()), *COLUMNS) == expected(reference, texts)


def test_encode_then_decode(spark, reference):
    path = tokenizer_path()
    out = decode(encode(documents(spark, AWKWARD), path), path)
    for r in out.collect():
        assert r["row"]["row"]["key"] == "k"
        assert r["text"] == reference.decode(list(r["row"]["ids"]), skip_special_tokens=False)


def test_empty_table(spark):
    assert round_trip_digest(documents(spark, []), tokenizer_path()).count() == 0
