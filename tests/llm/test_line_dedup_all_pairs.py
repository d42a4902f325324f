from __future__ import annotations

import hashlib
import random

import pytest

from barloom.llm import line_dedup as module
from barloom.llm.common import table
from barloom.llm.line_dedup import line_dedup, line_report

from .fixtures import documents, rows

COLUMNS = ("doc_id", "n_lines", "n_removed", "kept_sha256")


def gone_lines(texts, min_chars=20):
    """Each document against all earlier ones: equal long lines with the equal short lines next to them, wherever they stand."""
    docs = sorted({(i, t or "") for i, t in texts}, key=lambda d: d[0])
    lines = [[x.strip() for x in t.split("\n")] for _, t in docs]
    out = {}
    for d, b in enumerate(lines):
        gone = set()
        for a in lines[:d]:
            places = {}
            for i, x in enumerate(a):
                places.setdefault(x, []).append(i)
            for j, x in enumerate(b):
                for i in places.get(x, []) if len(x) >= min_chars else []:
                    gone.add(j)
                    for step in (1, -1):
                        k = step
                        while 0 <= i + k < len(a) and 0 <= j + k < len(b) and a[i + k] == b[j + k] and len(b[j + k]) < min_chars:
                            gone.add(j + k)
                            k += step
        out[docs[d]] = gone
    return out


def brute(texts, min_chars=20):
    out, result = gone_lines(texts, min_chars), []
    for i, t in texts:
        ls = (t or "").split("\n")
        g = out[i, t or ""]
        result.append((i, len(ls), len(g), hashlib.sha256("\n".join(x for j, x in enumerate(ls) if j not in g).encode()).hexdigest()))
    return sorted(result, key=repr)


@pytest.mark.parametrize("seed,hot,paired", [(1, 1000, 32), (2, 3, 4), (3, 1, 1), (4, 1000, 100)])
def test_all_earlier_documents(spark, monkeypatch, seed, hot, paired):
    monkeypatch.setattr(module, "HOT", hot)
    rng = random.Random(seed)
    line = [f"line number {i} " + "w" * rng.randint(8, 20) for i in range(30)] + ["", "ab", "short"]
    texts = []
    for i in range(60):
        parts = [line[s:s + rng.randint(1, 5)] for s in (rng.randrange(len(line)) for _ in range(rng.randint(1, 5)))]
        texts.append((i, "\n".join("\n".join(p) for p in parts) + rng.choice(["", "\n", " "])))
    expected = brute(texts)
    assert any(r[2] for r in expected)
    assert rows(line_report(documents(spark, texts), paired=paired), *COLUMNS) == expected


def test_a_later_holder_aligns_where_the_first_does_not(spark):
    a, b = "a line that is long enough", "another line of that kind"
    texts = [(1, f"{a}\nx\n{b}"), (2, f"p\n{a}"), (3, f"q\n{b}"), (4, f"{b}\ny\n{a}")]
    assert {r["row"]["doc_id"]: r["kept_text"] for r in line_dedup(documents(spark, texts)).collect()}[4] == "y"


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert rows(line_report(docs), *COLUMNS) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
