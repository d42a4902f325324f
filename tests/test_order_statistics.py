"""Counts among all earlier rows, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barloom.operators import order_statistics as O


def plain(rows):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == key and r[2] is not None and r[2] == r[2])
        out += [(key, t, v, i, sum(w < v for _, w in own[:i]), sum(w == v for _, w in own[:i])) for i, (t, v) in enumerate(own)]
    return sorted(out, key=repr)


def test_earlier():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 501):
        x = rng.integers(0, 9, n)
        below, equal = O.earlier(x)
        assert below.tolist() == [int((x[:i] < x[i]).sum()) for i in range(n)] and equal.tolist() == [int((x[:i] == x[i]).sum()) for i in range(n)]


@pytest.mark.parametrize("cuts,chunk,leaf,hot", [(2, 7, 5, 1000), (4, 16, 10, 2), (64, 1 << 14, 1 << 12, 1000)])
def test_all_earlier_rows(spark, monkeypatch, cuts, chunk, leaf, hot):
    for name, n in zip(("CUTS", "CHUNK", "LEAF", "HOT"), (cuts, chunk, leaf, hot)):
        monkeypatch.setattr(O, name, n)
    rng = random.Random(cuts)
    # One key has most rows, one value a third of them.
    rows = [(rng.choice(["a"] * 6 + ["b", "c", None]), i, 5.0 if rng.random() < 0.33 else round(rng.gauss(0, 3), 1)) for i in range(700)]
    rows += [("d", 1, 2.0), ("e", 1, None), ("e", 2, float("nan")), ("e", 3, 1.0), ("f", 1, 3.0), ("f", 1, 1.0), ("f", 1, 3.0)]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "symbol string, ts int, v double, at int, node string")
    got = O.earlier_counts(frame, "v", ["symbol"], ["ts"]).collect()
    assert len(got) == len(rows)
    assert sorted((tuple(r[c] for c in ("symbol", "ts", "v", "n_before", "below", "equal")) for r in got if r["n_before"] is not None), key=repr) == plain(rows)
    assert {r["symbol"] for r in got if r["n_before"] is None} == {"e"} and got[0]["at"] == 9


def test_empty(spark):
    assert O.earlier_counts(spark.createDataFrame([], "symbol string, ts int, v double"), "v", ["symbol"], ["ts"]).count() == 0


@pytest.mark.parametrize("cuts", [3, 5])
def test_values_on_and_beside_cuts(spark, monkeypatch, cuts):
    """Fewer distinct values than cuts, numbers of cuts that are no powers of two, zeros of both signs, infinities."""
    for name, n in zip(("CUTS", "CHUNK", "LEAF"), (cuts, 8, 4)):
        monkeypatch.setattr(O, name, n)
    values = [0.0, -0.0, float("inf"), float("-inf"), 1.5, -1.5, 2.0]
    rows = [(k, i, values[(i * 5 + i // 7) % n]) for k, n in (("a", 2), ("b", 4), ("c", 7)) for i in range(60)]
    got = O.earlier_counts(spark.createDataFrame(rows, "symbol string, ts int, v double"), "v", ["symbol"], ["ts"]).collect()
    shown = lambda r: (r[0], r[1], *r[3:])
    assert sorted(shown(tuple(r[c] for c in ("symbol", "ts", "v", "n_before", "below", "equal"))) for r in got) == sorted(map(shown, plain(rows)))
