from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from barloom.llm import periodic_runs as module
from barloom.llm.common import table
from barloom.llm.periodic_runs import find_runs, periodic_runs, run_report

from .fixtures import AWKWARD, documents, rows

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def plain_runs(words, least_words=24, least_periods=3):
    """Every period, by comparing the words with those a period later."""
    number = {}
    n, out, code = len(words), {}, np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    for q in range(1, n // least_periods + 1):
        same = np.concatenate([[False], code[:-q] == code[q:], [False]])
        for s, e in zip(np.flatnonzero(~same[:-1] & same[1:]).tolist(), np.flatnonzero(same[:-1] & ~same[1:]).tolist()):
            if e - s + q >= max(least_words, least_periods * q):
                out.setdefault((s, e - s + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(i, text, edit=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if edit and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    four = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("seed", range(12))
def test_find_runs(seed):
    rng = random.Random(seed)
    for _ in range(40):
        words = []
        while len(words) < rng.choice([10, 60, 300]):
            piece = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 20))]
            words += piece * rng.choice([1, 1, 2, 3, 4, 9]) + piece[:rng.randint(0, len(piece))]
        for least in (24, 3):
            got = [tuple(r) for r in find_runs(np.array(words), len(words) // 3, least).tolist()]
            assert got == sorted(plain_runs(words, least), key=lambda r: (r[0], r[2]))


def test_grid_in_small_chunks(monkeypatch):
    words = np.array(([1, 2, 3] * 30 + [4, 5] * 20 + [6] * 40) * 3)
    whole = find_runs(words, len(words) // 3).tolist()
    monkeypatch.setattr(module, "CHUNK", 7)
    assert find_runs(words, len(words) // 3).tolist() == whole


@pytest.mark.parametrize("together", [1, 1 << 16])
def test_awkward_rows(spark, monkeypatch, together):
    monkeypatch.setattr(module, "TOGETHER", together)
    texts = AWKWARD + [(20, "a " * 23), (21, "a " * 24), (22, "a b c d e f g h i " * 3), (23, "a b c d e f g h i " * 2 + "a b c d e f g h"), (24, "x y　z " * 30), (25, "a b\x0ba b\x0ca b\ta b\ra b\n" * 5)]
    frame = documents(spark, texts)
    assert rows(run_report(frame), *COLUMNS) == sorted((plain_row(i, t) for i, t in texts), key=repr)
    assert rows(periodic_runs(frame), *COLUMNS) == sorted((plain_row(i, t, False) for i, t in texts), key=repr)


def test_collapsed_text(spark):
    got = periodic_runs(documents(spark, [(1, "start " + "one two three " * 9 + "end"), (2, "nothing here")]), texts=True)
    assert {r["doc_id"]: r["collapsed"] for r in got.collect()} == {1: "start one two three end", 2: "nothing here"}


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = sorted((plain_row(i, t) for i, t in texts), key=repr)
    assert sum(1 for r in expected if r[1]) > 5
    got = rows(run_report(docs), *COLUMNS)
    assert got == expected


def test_empty_table(spark):
    assert run_report(documents(spark, [])).count() == 0
