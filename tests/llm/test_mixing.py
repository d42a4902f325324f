from __future__ import annotations

import hashlib
from collections import Counter
from math import exp

import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing as module
from barloom.llm.mixing import mix_sources, mixed_digest

from .fixtures import AWKWARD, documents, rows


def poisson(u, mean):
    """The least count whose cumulative chance reaches u."""
    j, p = 0, exp(-mean)
    c = p
    while c < u:
        j += 1
        p *= mean / j
        c += p
    return j


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def expected(docs, temperature=0.5, epochs=1.0, seed=17):
    size = Counter()
    for _, text, _, source in docs:
        size[source] += len(text or "")
    size = {s: n for s, n in size.items() if n}
    weight = {s: n ** temperature for s, n in size.items()}
    out = {}
    for i, text, _, source in docs:
        i = "null:" + hashlib.md5((text or "").encode()).hexdigest() if i is None else i
        if source in size:
            rate = weight[source] / sum(weight.values()) * epochs * sum(size.values()) / size[source]
            draws = max(1, -int(-rate // 32))
            out[i] = sum(poisson(uniform(seed, d, i), rate / draws) for d in range(1, draws + 1))
    return out


DOCS = [(i, "word " * (1 + i % 50), "en", ["web", "web", "web", "book", "code"][i % 5] if i < 900 else "tiny" if i < 905 else None) for i in range(1000)]


@pytest.mark.parametrize("epochs,most", [(1.0, 20_000), (3.0, 0), (60.0, 20_000)])
def test_copies_follow_the_inverted_distribution(spark, monkeypatch, epochs, most):
    monkeypatch.setattr(module, "MAX_BROADCAST", most)
    got = Counter(r["id"] for r in mix_sources(documents(spark, DOCS), epochs=epochs).selectExpr("row.doc_id AS id").collect())
    assert got == Counter({i: n for i, n in expected(DOCS, epochs=epochs).items() if n})


@pytest.mark.parametrize("block", [1, 7])
def test_many_draws_are_dealt_out_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_DRAWS", block)
    docs = DOCS[::9] + [(901, "word", "en", "tiny"), (None, "without an id", "en", "tiny"), (None, "another", "en", "web")] * 2
    out = mix_sources(documents(spark, docs), epochs=200.0).selectExpr("coalesce(string(row.doc_id), row.text) AS id", "copy", "n_copies").collect()
    want = {{"null:" + hashlib.md5(t.encode()).hexdigest(): t for t in ("without an id", "another")}.get(i, str(i)): n for i, n in expected(docs, epochs=200.0).items() if n}
    assert max(want.values()) > 32 * block
    twice = {"901", "without an id", "another"}
    assert Counter(r["id"] for r in out) == Counter({i: n * (2 if i in twice else 1) for i, n in want.items()})
    assert Counter((r["id"], r["copy"]) for r in out) == Counter({(i, c): 2 if i in twice else 1 for i, n in want.items() for c in range(1, n + 1)})
    assert all(r["n_copies"] == want[r["id"]] for r in out)


def test_rows_without_an_id_fill_all_partitions(spark):
    docs = documents(spark, [(None, "the same text", "en", "web")] * 2000).repartition(40)
    sizes = [r["n"] for r in mix_sources(docs, epochs=5.0).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_shares_reach_the_targets(spark):
    target = {"web": 0.2, "book": 0.5, "code": 0.3, "absent": 4.0}
    out = mix_sources(documents(spark, DOCS), weights=target, epochs=20.0)
    size = {r["source"]: r["n"] for r in out.groupBy("row.source").agg({"row.n_chars": "sum"}).toDF("source", "n").collect()}
    assert set(size) == {"web", "book", "code"}
    for s, n in size.items():
        assert n / sum(size.values()) == pytest.approx(target[s], abs=0.03)


def test_global_shuffle_is_stable(spark):
    out = mixed_digest(documents(spark, DOCS))
    order = [r["doc_id"] for r in out.orderBy("mix_key", "doc_id", "copy").collect()]
    assert order != sorted(order)
    again = mixed_digest(documents(spark, DOCS[::-1]).repartition(7)).orderBy("mix_key", "doc_id", "copy").collect()
    assert order == [r["doc_id"] for r in again]


def test_awkward_rows(spark):
    texts = [(i, t, "en", s) for (i, t), s in zip(AWKWARD, ["a", None, "empty", "empty", "a", "b", "b", "b", None, "a", "a", "a", "b", "b"])]
    got = rows(mixed_digest(documents(spark, texts), epochs=4.0), "doc_id", "copy", "n_copies")
    assert not [r for r in got if r[0] in (1, 2)]
    assert all(1 <= c <= n for _, c, n in got)
    assert mixed_digest(documents(spark, [])).count() == 0
    assert mixed_digest(documents(spark, [(1, None, None, "x")])).count() == 0
