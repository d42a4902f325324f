from __future__ import annotations

import random

import numpy as np
import pytest

from barloom.llm import line_dedup as module
from barloom.llm.common import table
from barloom.llm.line_dedup import align, common_lines, line_dedup, line_report

from .fixtures import AWKWARD, documents, rows
from .test_line_dedup_all_pairs import brute

COLUMNS = ("doc_id", "n_lines", "n_removed", "kept_sha256")


def test_align():
    a = np.array([1, 2, 3, 4, 5, 6, 7])
    assert align(a, a) == [(i, i) for i in range(7)]
    assert align(np.array([9, 1, 2, 8]), np.array([1, 2, 7])) == [(1, 0), (2, 1)]
    assert align(np.array([1, 1, 5, 1, 1]), np.array([1, 5, 1])) == [(0, 0), (2, 1), (4, 2)]
    assert align(np.array([], int), a) == []


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 3), (3, 1)])
def test_shared_blocks(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(module, "HOT", hot)
    rng = random.Random(seed)
    line = [f"line number {i} " + "w" * rng.randint(0, 20) for i in range(30)] + ["", "ab", "short"]
    texts = []
    for i in range(60):
        text = "\n".join("\n".join(line[s:s + rng.randint(1, 5)]) for s in (rng.randrange(len(line)) for _ in range(rng.randint(1, 5))))
        texts.append((i, text + rng.choice(["", "\n", " "])))
    assert rows(line_report(documents(spark, texts)), *COLUMNS) == brute(texts)


def test_first_document_keeps_its_lines(spark):
    a, b = "a line that is long enough", "another line of that kind"
    got = {r["row"]["doc_id"]: r["kept_text"] for r in line_dedup(documents(spark, [(1, f"{a}\n{b}"), (2, f"x\n{a}\n{b}\ny"), (3, f"{b}\n{a}")])).collect()}
    assert got[1] == f"{a}\n{b}" and got[2] == "x\ny" and got[3] == ""


def test_awkward_rows(spark):
    known = [t for t in AWKWARD if t[0] is not None]
    assert rows(line_report(documents(spark, known)), *COLUMNS) == brute(known)
    assert line_report(documents(spark, AWKWARD)).count() == len(AWKWARD)


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = brute(texts)
    assert any(r[2] for r in expected)
    assert rows(line_report(docs), *COLUMNS) == expected


def test_empty_table(spark):
    assert line_report(documents(spark, [])).count() == 0


def test_copies_of_a_document_in_another_order_go(spark):
    a, b = "a line that is long enough", "another line of that kind"
    got = {r["row"]["doc_id"]: r["kept_text"] for r in line_dedup(documents(spark, [(1, f"{a}\n{b}"), (2, f"{b}\n{a}"), (3, f"{b}\n{a}")])).collect()}
    assert got[3] == ""


def test_white_space_at_the_ends_of_lines(spark):
    lines = ["a line that is long enough", "another line of that kind", "a third one, longer than both"]
    texts = [(1, "\n".join(lines)), (2, "\r\n".join(lines)), (3, "\n".join(f"\t\u3000{x}\x0b\u00a0" for x in lines))]
    assert {r["row"]["doc_id"]: r["n_removed"] for r in line_dedup(documents(spark, texts)).collect()} == {1: 0, 2: 3, 3: 3}


def test_shorter_lines_by_a_parameter(spark):
    texts = [(1, "one\ntwo"), (2, "zero\none\ntwo")]
    assert {r["doc_id"]: r["n_removed"] for r in line_report(documents(spark, texts)).collect()} == {1: 0, 2: 0}
    assert {r["doc_id"]: r["n_removed"] for r in line_report(documents(spark, texts), min_chars=3).collect()} == {1: 0, 2: 2}


def test_second_hashes_tell_lines_apart():
    a = np.array([3, 5, 7])
    assert common_lines(a, a) == [0, 1, 2]
    assert common_lines(a, a, np.array([1, 2, 3]), np.array([1, 9, 3])) == [0, 2]
