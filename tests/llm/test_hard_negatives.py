from __future__ import annotations

import math

import numpy as np
import pytest

from barloom.llm import hard_negatives as module
from barloom.llm.common import table
from barloom.llm.hard_negatives import hard_negatives, negative_report, scores
from barloom.llm.queries import ORACLE_SQL

from .fixtures import rows

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(vectors, every=50, move=True):
    used = []
    for k, (i, v, label) in enumerate(vectors):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if move and i is not None and i % 7 == 0:
            label = (label + 1) % 10
        used.append((k, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for k, i, v, label in used:
        if i is None or i % every:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, other) for m, j, w, other in used if m != k and len(w) == len(v)),
                        key=lambda x: (-x[0], x[1] is None, x[1]))
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 50 * s <= 100 * x[0] <= 95 * s][:3]
            out += [(i, j, r, x[1], s, x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out, key=repr)


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 7, 3, "x") for i, v, label in vectors],
                                 "vec_id long, embedding array<float>, label int, rid long, dim int, score string")


@pytest.mark.parametrize("blocks", [(2, 5, 2), (1024, 4096, 64)])
def test_random_vectors_with_ties(spark, monkeypatch, blocks):
    for name, n in zip(("ANCHORS", "ROWS", "STRIP"), blocks):
        monkeypatch.setattr(module, name, n)
    rng = np.random.default_rng(4)
    vectors = [(int(10 * k), (rng.integers(0, 3, 6) / 8 + rng.normal(0, 0.05, 6) * (k % 2)).tolist(), int(rng.integers(0, 4))) for k in range(120)]
    expected = brute(vectors)
    assert len(expected) > 50
    assert rows(negative_report(frame(spark, vectors)), *COLUMNS) == expected


def test_awkward_rows(spark):
    a = [1.0, 2.0]
    vectors = [(0, a, 1), (0, a, 1), (50, a, 2), (None, a, 1), (None, [0.5, 1.2], 2), (1, [0.6, 1.2], 2), (1, [0.6, 1.2], 3), (2, None, 1), (3, a, None), (4, [1, None], 1),
               (5, [float("nan"), 1], 1), (6, [float("inf"), 1], 2), (100, [], 1), (101, [], 1), (102, [], 2), (-50, [-1, -2], 1), (8, [-1, -2], 1), (9, [0, 0], 4), (150, [1, 2, 3], 1)]
    for every in (50, 1):
        got = hard_negatives(frame(spark, vectors), module.F.col("vec_id") % every == 0)
        assert rows(got, *COLUMNS) == brute(vectors, every, False)


def test_all_rows_alike(spark):
    vectors = [(i, [1.0, 0.0], 1) for i in range(200)] + [(1000 + i, [0.7, 0.0], 2) for i in range(200)]
    assert rows(negative_report(frame(spark, vectors)), *COLUMNS) == brute(vectors)


def test_whole_table(spark, sf_dir):
    data = table(spark, sf_dir, "embeddings")
    assert rows(negative_report(data), *COLUMNS) == brute([tuple(r) for r in data.select("vec_id", "embedding", "label").collect()])


def test_large_scores():
    x = np.array([[2.0 ** 30 + 1, 3.0]])
    assert scores(x, x).tolist() == [[(2 ** 30 + 1) ** 2 + 9]]
    with pytest.raises(ValueError):
        scores(x * 2.0 ** 30, x * 2.0 ** 30)


def test_empty_table(spark):
    assert negative_report(frame(spark, [])).count() == 0


def test_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_hard_negatives']})").fetchall()
    assert sorted(got, key=repr) == rows(negative_report(table(spark, sf_dir, "embeddings")), *COLUMNS)
