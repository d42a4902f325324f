from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from barloom.llm import suffix_dedup as module
from barloom.llm.common import table
from barloom.llm.suffix_dedup import suffix_array, suffix_dedup, suffix_report

from .fixtures import AWKWARD, documents, rows

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(texts, length):
    data = [(t or "").encode() for _, t in texts]
    windows = Counter(hash(d[i:i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(texts, data):
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if windows[hash(d[i:i + length])] > 1:
                gone[i:i + length] = 1
        kept = bytes(np.frombuffer(d, np.uint8)[gone[:-1] == 0])
        out.append((doc, len(d), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shared(seed, n, length):
    """Texts of random words with copies of passages of all kinds of lengths and offsets."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(8)]
    texts = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(pool)
            s = rng.randrange(len(p))
            text += rng.choice([p, p[s:], p[:s], " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), "x" * rng.randint(1, 2 * length), "ab" * rng.randint(1, length)])
        texts.append((i, text))
    return texts


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 200):
        text = rng.integers(97, 99, n).astype(np.uint8)
        order, place = suffix_array(text)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tobytes())
        assert place[order].tolist() == list(range(n))


@pytest.mark.parametrize("depth", [8, 12, 16, 21, 64])
def test_suffix_array_to_a_depth(depth):
    """Suffixes of segments have one place if their first bytes are the same, and no comparison goes deeper."""
    rng = np.random.default_rng(depth)
    parts = [rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in rng.integers(0, 80, 30)] + [b"a" * 200, b"a" * 150, b"ab" * 70]
    text = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    ends = np.concatenate([np.full(len(p) + 1, len(p)) for p in parts]) + np.repeat(np.cumsum([0, *(len(p) + 1 for p in parts[:-1])]), [len(p) + 1 for p in parts])
    order, place = suffix_array(text, ends, depth)
    assert sorted(order.tolist()) == list(range(len(text)))
    whole = [i for i in order.tolist() if ends[i] - i >= depth]
    heads = [text[i: i + depth].tobytes() for i in whole]
    assert heads == sorted(heads)
    groups = {}
    for i, head in zip(whole, heads):
        groups.setdefault(head, set()).add(int(place[i]))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set.union(*groups.values())) == len(groups)
    assert len(groups) < len(whole)


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"SEGMENTS": 2}), (3, {"SEGMENTS": 2, "SHARD": 512, "PIECE": 512}), (4, {"HOT": 2}), (5, {"PIECE": 300, "SEGMENTS": 3})])
def test_passages(spark, monkeypatch, seed, limits):
    for k, v in limits.items():
        monkeypatch.setattr(module, k, v)
    texts = shared(seed, 60, 64)
    assert rows(suffix_report(documents(spark, texts), 64), *COLUMNS) == brute(texts, 64)


def test_awkward_rows(spark):
    assert rows(suffix_report(documents(spark, AWKWARD)), *COLUMNS) == brute(AWKWARD, 400)


def test_spans_and_columns(spark):
    got = suffix_dedup(documents(spark, [(1, "q" * 399 + "r"), (2, "Ä" + "q" * 399 + "r"), (3, "s" * 400)]))
    found = {r["row"]["doc_id"]: (r["row"]["key"], [(s["s"], s["e"]) for s in r["spans"]], bytes(r["kept"])) for r in got.collect()}
    assert found == {1: ("k", [(0, 400)], b""), 2: ("k", [(2, 402)], "Ä".encode()), 3: ("k", [], b"s" * 400)}


def test_what_is_kept_is_counted_in_characters(spark):
    """A text left alone keeps its n_chars, whatever its letters; passages below 400 bytes stay."""
    passage = " ".join(f"wör{i}" for i in range(52))
    clean = " ".join(f"Äé€😀{i}" for i in range(60))
    assert len(passage.encode()) < 400 < len(clean.encode())
    texts = [(1, clean), (2, "x" * 400 + "ß"), (3, "x" * 400), (4, None), (5, "one " + passage), (6, passage + " two"), (7, "q" * 399 + "€"), (8, "q" * 399 + "₭")]
    got = {r["doc_id"]: (r["n_removed"], r["n_kept"], r["kept_text"]) for r in suffix_report(documents(spark, texts)).collect()}
    assert got == {1: (0, len(clean), clean), 2: (400, 1, "ß"), 3: (400, 0, ""), 4: (0, 0, ""), 5: (0, len(texts[4][1]), texts[4][1]),
                   6: (0, len(texts[5][1]), texts[5][1]), 7: (401, 1, "\ufffd"), 8: (401, 1, "\ufffd")}


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(suffix_report(docs), *COLUMNS) == brute(texts, 400)


def test_empty_table(spark):
    assert suffix_report(documents(spark, [])).count() == 0
