"""Selection against plain Python: hot cells, ties, empty populations."""

from __future__ import annotations

import hashlib
import math
import random
from bisect import bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.operators import selection as S


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def test_roulette(spark):
    rng = random.Random(2)
    scores = [(i, rng.choice([None, -1.0, 0.0, rng.random() * 5])) for i in range(300)]
    weights = [math.floor(max(0.001, f or 0.0) * 1_000_000) for _, f in scores]
    starts = [sum(weights[:i]) for i in range(300)]
    draws = spark.range(5000).withColumnRenamed("id", "draw")
    got = {r["draw"]: r["dna_id"] for r in S.roulette(spark.createDataFrame(scores, "dna_id long, fitness double"), draws, 7).collect()}
    assert got == {d: bisect_right(starts, math.floor(u(7, d) * float(sum(weights)))) - 1 for d in range(5000)}
    many = Counter(got.values())
    best = max(range(300), key=lambda i: weights[i])
    assert many[best] == pytest.approx(5000 * weights[best] / sum(weights), rel=0.5)
    assert S.roulette(spark.createDataFrame([], "dna_id long, fitness double"), draws, 7).count() == 0


def test_running_total_and_last_mark(spark):
    rows = [(i, (i * 7) % 5) for i in range(100)]
    got = {r["k"]: (r["at"], r["before"]) for r in S.running_total(spark.createDataFrame(rows, "k long, v long"), "v", "k").collect()}
    assert got == {i: (i, sum(v for _, v in rows[:i])) for i in range(100)}
    marks = spark.createDataFrame([(10, "a"), (20, "b")], "p long, name string")
    points = spark.createDataFrame([(x,) for x in (5, 10, 15, 20, 99, 99)], "p long")
    assert sorted((r["p"], r["name"]) for r in S.last_at_or_before(marks, points, "p", "name").where("name IS NOT NULL").collect()) == [(10, "a"), (15, "a"), (20, "b"), (99, "b"), (99, "b")]


def test_lowest_of_equals(spark):
    scores = spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "dna_id long, fitness double")
    assert sorted(r["dna_id"] for r in S.lowest(scores).collect()) == [0, 2, 4, 6]
    assert [r["dna_id"] for r in S.lowest(scores.where("dna_id = 3")).collect()] == [3]


def test_stratified_and_swapped(spark):
    names = {**{f"a{i}": "A" for i in range(5)}, "b": "B"}
    genes = S.stratified(spark.range(50).withColumnRenamed("id", "dna_id"), names, 2, 1)
    counts = {(r["dna_id"], r["category"]): r["n"] for r in genes.where("active").groupBy("dna_id", "category").agg(F.count("*").alias("n")).collect()}
    assert set(counts.values()) == {1, 2} and all(n == (2 if c == "A" else 1) for (_, c), n in counts.items()) and len(counts) == 100
    assert genes.where("NOT active AND weight <> 0").count() == 0
    swapped = S.swap(genes, 3, 0.3)
    assert swapped.where("NOT active AND weight <> 0").count() == 0
    turned = swapped.alias("s").join(genes.alias("g"), ["dna_id", "name"]).where("s.active <> g.active").count()
    assert 0.2 * 300 < turned < 0.4 * 300


@pytest.mark.parametrize("block,dims", [(1 << 11, 3), (5, 2), (5, 1)])
def test_crowded_out(spark, monkeypatch, block, dims):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr("barloom.operators.skew.HOT", 3)
    rng = random.Random(dims)
    rows = [(i, float(rng.randrange(5)), [rng.uniform(-1, 1) for _ in range(dims)]) for i in range(150)]
    rows += [(200 + i, 1.0, [0.25] * dims) for i in range(75)] + [(300, None, [0.25] * dims)]  # a third lie in one place
    fit = lambda r: -math.inf if r[1] is None else r[1]
    want = {a[0] for a in rows for b in rows if a[0] != b[0] and sum((x - y) ** 2 for x, y in zip(a[2], b[2])) < 0.04 and (fit(b), -b[0]) > (fit(a), -a[0])}
    frame = spark.createDataFrame(rows, "dna_id long, fitness double, vector array<double>")
    assert {r["dna_id"] for r in S.crowded_out(frame, 0.2).collect()} == want
    kept = S.keep_apart(frame, 0.2, 4).collect()
    assert {r["dna_id"] for r in kept if r["replaced"]} == want and len(kept) == len(rows)


def test_nothing_unused(spark):
    genes = spark.createDataFrame([(1, "a", 0.5, True), (2, "a", 0.0, False), (2, "b", 0.1, True)], "dna_id long, name string, weight double, active boolean")
    scores = spark.createDataFrame([(1, 0.1), (2, 0.2)], "dna_id long, fitness double")
    assert sorted(map(tuple, S.inject_unused(genes, scores, 3, 1).select("dna_id", "name", "weight", "active").collect())) == sorted(map(tuple, genes.collect()))
