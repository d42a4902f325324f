from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_dedup as module
from barloom.llm.common import table
from barloom.llm.exact_dedup import exact_dedup

from .fixtures import AWKWARD, documents, rows

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(texts, best=max):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows_per_salt", [2, 4096])
def test_awkward_rows(spark, monkeypatch, rows_per_salt):
    monkeypatch.setattr(module, "ROWS_PER_SALT", rows_per_salt)
    assert rows(exact_dedup(documents(spark, AWKWARD)), *COLUMNS) == brute(AWKWARD)


def test_hot_group_over_many_salts(spark, monkeypatch):
    monkeypatch.setattr(module, "ROWS_PER_SALT", 16)
    texts = [(i, "the same text" if i % 3 else f"text {i}") for i in range(500)]
    assert rows(exact_dedup(documents(spark, texts)), *COLUMNS) == brute(texts)


def test_neighbours_decide(spark, sf_dir, monkeypatch):
    """Each text that is not hot is one run of the content sort; of a hot one only the runs of its salts are merged."""
    docs = table(spark, sf_dir, "documents")
    distinct = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    runs = module.sorted_runs(docs).collect()
    assert len(runs) == distinct < docs.count() and not any(r["salted"] for r in runs)
    monkeypatch.setattr(module, "ROWS_PER_SALT", 20)
    texts = [(i, "the same text" if i % 3 else f"text {i // 9}") for i in range(900)]
    runs = module.sorted_runs(documents(spark, texts)).collect()
    assert [len(r["ids"]) for r in runs if not r["salted"]] == [3] * 100
    assert len([r for r in runs if r["salted"]]) > 20 and sum(r["n"] for r in runs) == 900


def test_smallest_stays_and_normalisation(spark):
    texts = [(1, "A b"), (2, "a  B"), (3, "c")]
    got = exact_dedup(documents(spark, texts), normalise=F.lower(F.regexp_replace("text", r"\s+", " ")), keep="smallest")
    assert rows(got, *COLUMNS) == brute([(1, "a b"), (2, "a b"), (3, "c")], min)


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(exact_dedup(docs), *COLUMNS) == brute(texts)


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).count() == 0
