"""The vector store against all distances."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.operators import vector_index as module
from barloom.operators.vector_index import VectorStore


def frame(spark, ids, x, label=None):
    return spark.createDataFrame(pa.table({"vec_id": ids, "embedding": list(np.float32(x)), "label": label if label is not None else ids % 3}))


def plain(ids, x, queries, k):
    out = {}
    for i, q in queries:
        d = ((np.float64(np.float32(x)) - np.float64(np.float32(q))) ** 2).sum(axis=1).round(9)
        out[i] = [int(ids[j]) for j in np.lexsort((ids, d))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["vec_id"])
    return out


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 32)) * 3
    x = np.concatenate([centres[rng.integers(0, 60, 4000)] + rng.standard_normal((4000, 32)), np.repeat(centres[:1], 2000, axis=0) + 0.001 * rng.standard_normal((2000, 32))])
    return np.arange(len(x)), x


def test_recall_and_the_exact_way(spark, monkeypatch, clusters):
    """A third of all vectors lie in one list, in blocks; queries are the ids divisible by 20."""
    monkeypatch.setattr(module, "VECTORS", 500)
    monkeypatch.setattr(module, "QUERIES", 40)
    ids, x = clusters
    store = VectorStore.create(frame(spark, ids, x))
    queries = frame(spark, ids[::20], x[::20]).select(F.col("vec_id").alias("query"), "embedding")
    want = plain(ids, x, list(zip(ids[::20].tolist(), x[::20])), 5)
    assert found(store.search(queries, 5)) == want
    probed = found(store.search(queries, 5, exact=False))
    assert store.probes < len(store.centres) / 2
    assert np.mean([len(set(probed[q]) & set(w)) / 5 for q, w in want.items()]) >= 0.9


def test_recall_on_the_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    store = VectorStore.create(vectors)
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    exact, probed = found(store.search(queries, 5)), found(store.search(queries, 5, exact=False))
    assert np.mean([len(set(probed.get(q, [])) & set(w)) / 5 for q, w in exact.items()]) >= 0.9


def test_changes(spark, clusters):
    ids, x = clusters[0][:300], clusters[1][:300].copy()
    store = VectorStore.create(frame(spark, ids, x), lists=7)
    x[10:20] += 50
    store.add(frame(spark, ids[10:20], x[10:20]))
    store.delete(frame(spark, ids[15:40], x[15:40]))
    store.add(frame(spark, ids[38:40], x[38:40]))
    store.add(frame(spark, np.arange(1000, 1010), x[:10] - 50))
    left = np.r_[0:15, 38:300]
    now_ids, now = np.r_[ids[left], 1000:1010], np.concatenate([x[left], x[:10] - 50])
    for s in (store, store.compact()):
        assert s.count() == len(now_ids)
        assert {r["vec_id"] for r in s.rows().collect()} == set(now_ids.tolist())
        queries = frame(spark, ids[:30], x[:30]).select(F.col("vec_id").alias("query"), "embedding")
        assert found(s.search(queries, 4)) == plain(now_ids, now, list(zip(ids[:30].tolist(), x[:30])), 4)
    assert store.count_by("label").agg(F.sum("n")).first()[0] == len(now_ids)


def test_only_probed_lists_are_read(spark, clusters):
    store = VectorStore.create(frame(spark, *clusters))
    read = store.rows([1, 2])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*list#\d+ IN \(1,2\)", plan), plan
    assert set(read.select("list").distinct().toPandas()["list"]) == {1, 2}


def test_filters_ties_and_few_vectors(spark):
    x = np.array([[0.0, 1.0]] * 6 + [[5.0, 5.0]])
    store = VectorStore.create(frame(spark, np.arange(7), x))
    queries = frame(spark, np.arange(2), x[:2]).select(F.col("vec_id").alias("query"), "embedding")
    assert found(store.search(queries, 3)) == {0: [0, 1, 2], 1: [0, 1, 2]}
    assert found(store.search(queries, 9, where=F.col("label") == 0)) == {0: [0, 3, 6], 1: [0, 3, 6]}
    assert found(store.search(queries, 3, where=F.col("label") > 7)) == {}
    empty = VectorStore.create(frame(spark, np.arange(1), x[:1]).where("vec_id > 5"))
    assert empty.count() == 0 and found(empty.search(queries, 3)) == {}
