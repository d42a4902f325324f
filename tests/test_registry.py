"""The table function over registered definitions."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from barloom.functions.registry import Registry, standard

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, DAY + dt.timedelta(days=(i * 7) % 30), float((i * 7) % 30 + k), 9) for k, s in enumerate(("A", "B", None)) for i in range(30)]
    return spark.createDataFrame(rows, "symbol string, ts date, close double, other int")


def test_schema_follows_the_call(spark, bars):
    r = standard()
    r.register("twice", "own", lambda s: s["close"] * 2)
    assert r.apply(bars, "own").columns == [*bars.columns, "twice"]
    # Definitions that need volume, high or low are left out: the table lacks these.
    assert r.apply(bars).columns == [*bars.columns, "mom_20", "mom_5", "sma_20", "sma_5", "stdev_20", "stdev_5", "twice"]
    with pytest.raises(Exception, match="no indicator has the category nothing"):
        r.apply(bars, "nothing")
    with pytest.raises(Exception, match="has a column twice already"):
        r.apply(bars.withColumnRenamed("other", "twice"), "own")


def test_series_in_order_of_time(spark, bars):
    r = Registry()
    r.register("before", "own", lambda s: np.concatenate([[np.nan], s["close"][:-1]]))
    got = sorted(((x["symbol"] or "", x["ts"], x["close"], x["before"]) for x in r.apply(bars, "own").collect()), key=repr)
    assert len(got) == 90
    for symbol, ts, close, before in got:
        assert before == (None if ts == DAY else close - 1), (symbol, ts)


def test_registry_queries(spark, bars):
    r = standard()
    assert r.counts() == {"overlap": 3, "volatility": 4, "momentum": 2, "volume": 1}
    assert r.names("momentum") == ["mom_20", "mom_5"] and len(r.names()) == 10
    with pytest.raises(ValueError):
        r.register("not a name", "x", lambda s: s["close"])
    assert standard().apply(bars.limit(0), "momentum").count() == 0
