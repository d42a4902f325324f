from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import embedding_dedup as module
from barloom.llm.common import table
from barloom.llm.embedding_dedup import embedding_dedup

from .fixtures import components, rows

COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def brute(vectors, cosine=0.95):
    usable = [(k, np.asarray(v, np.float64)) for k, (_, v) in enumerate(vectors)
              if v is not None and len(v) and all(x is not None for x in v) and np.isfinite(np.asarray(v, np.float64)).all() and np.any(np.asarray(v, np.float64))]
    by_dim = {}
    for k, v in usable:
        by_dim.setdefault(len(v), []).append((k, v / np.sqrt(v @ v)))
    n_links, links = [0] * len(vectors), []
    for group in by_dim.values():
        x = np.stack([v for _, v in group])
        sims = x @ x.T
        for i in range(len(group)):
            for j in range(i + 1, len(group)):
                if sims[i, j] >= cosine:
                    a, b = group[i][0], group[j][0]
                    n_links[a] += 1
                    n_links[b] += 1
                    links.append((a, b))
    part = components(range(len(vectors)), links)
    low = {}
    for k, (i, _) in enumerate(vectors):
        low[part[k]] = min(i, low.get(part[k], i))
    return sorted([(i, n_links[k], low[part[k]], i == low[part[k]]) for k, (i, _) in enumerate(vectors)], key=repr)


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1) for i, v in vectors],
                                 "vec_id long, embedding array<float>, label int, h string, cid int")


@pytest.mark.parametrize("block", [4, 1024])
def test_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(20):
        base = rng.standard_normal(32)
        for s in rng.uniform(0, 0.4, 12):
            vectors.append((len(vectors), np.float32(base + s * rng.standard_normal(32)).tolist()))
    vectors += [(len(vectors) + i, vectors[0][1]) for i in range(9)]
    rng.shuffle(order := list(range(len(vectors))))
    vectors = [(int(k), v) for k, (_, v) in zip(order, vectors)]
    assert rows(embedding_dedup(frame(spark, vectors)), *COLUMNS) == brute(vectors)


def test_awkward_vectors(spark):
    vectors = [(1, None), (2, []), (3, [0, 0, 0]), (4, [1, None, 2]), (5, [float("nan"), 1, 1]), (6, [float("inf"), 1, 1]), (7, [1, 2, 3]), (8, [2, 4, 6]), (9, [1, 2]),
               (10, [-1, -2, -3]), (11, [1, 2, 3]), (12, [0, 0, 0]), (13, [1e-30, 2e-30, 3e-30]), (14, [3e38, 3e38, 3e38]), (15, [-0.0, 0, 0])]
    assert rows(embedding_dedup(frame(spark, vectors)), *COLUMNS) == brute(vectors)


def test_whole_table(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings")
    vectors = [tuple(r) for r in data.select("vec_id", "embedding").collect()]
    assert rows(embedding_dedup(data), *COLUMNS) == brute(vectors)


def test_recall_of_pairs_near_the_threshold(spark):
    """20 000 vectors with 2 000 pairs planted at cosines of 0.95 to 0.97 and one large tight group."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((17_000, 64)))
    a = base[:2000]
    other = rng.standard_normal((2000, 64))
    other = unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.9501, 0.97, (2000, 1))
    group = unit(base[2500] + 0.01 * rng.standard_normal((1000, 64)))
    x = np.float32(np.concatenate([base, cos * a + np.sqrt(1 - cos * cos) * other, group]))
    got = embedding_dedup(spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))).toPandas()
    n = got.set_index("vec_id").sort_index()["n_links"].to_numpy()
    y = unit(x.astype(np.float64))
    want = np.concatenate([(y[i:i + 1000] @ y.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(y), 1000)])
    assert (n <= want).all()
    pairs = np.r_[0:2000, 17_000:19_000]
    assert n[pairs].sum() >= 0.99 * want[pairs].sum()
    assert n[19_000:].sum() == want[19_000:].sum()


def test_tables_keep_the_chance_at_any_size():
    for n in (10, 10 ** 5, 10 ** 9, 10 ** 12, 10 ** 15):
        k, tables = module.tables_for(n, 0.95, 0.995)
        assert tables <= module.MAX_TABLES
        assert 1 - (1 - module.collision((2 - 2 * 0.95) ** 0.5) ** k) ** tables >= 0.995


def test_empty_table(spark):
    assert embedding_dedup(frame(spark, [])).count() == 0
