"""The cache of bars as a data source."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan

from barloom.sources import bar_cache as BC
from barloom.streaming import bars as ST

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def cache(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cache"))
    rows = [(s, START + dt.timedelta(hours=h), float(h), h + 1.0, h - 1.0, h + 0.5, 10.0) for s in ("A", "B/C=1", "é") for h in range(96)] + [(None, START, 1.0, 1.0, 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, BC.BARS)
    BC.write_cache(frame, path, "2024-02-01 00:00:00", 0)
    # The last day of A comes again, with other prices and a later time.
    again = frame.where("symbol = 'A' AND ts >= timestamp_ntz'2024-01-04 00:00:00'").withColumn("close", F.lit(-1.0))
    BC.write_cache(again, path, "2024-02-02 00:00:00", 1)
    BC.register(spark)
    return path


def load(spark, path, **options):
    return spark.read.format("bar_cache").option("path", path).options(**options).load()


def test_whole_cache_and_the_newest_write(spark, cache):
    rows = load(spark, cache)
    assert rows.count() == 3 * 96 and {r["symbol"] for r in rows.select("symbol").distinct().collect()} == {"A", "B/C=1", "é"}
    assert rows.where("close = -1").count() == 24


def test_pushed_filters_prune(spark, cache, monkeypatch):
    monkeypatch.setattr(BC, "ROWS", 1)
    reader = BC.BarCacheReader({"path": cache})
    rest = list(reader.pushFilters([In(("symbol",), ("A", "é")), GreaterThanOrEqual(("ts",), dt.datetime(2024, 1, 2, 12)), LessThan(("ts",), dt.datetime(2024, 1, 3)), GreaterThan(("close",), 1.0)]))
    assert rest == [GreaterThan(("close",), 1.0)]
    assert len(reader.partitions()) == 2
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 24
    both = BC.BarCacheReader({"path": cache})
    assert not list(both.pushFilters([EqualTo(("symbol",), "A"), In(("symbol",), ("é",))])) and both.partitions() == [BC.Pieces(())]
    got = load(spark, cache).where("symbol = 'B/C=1' AND ts >= timestamp_ntz'2024-01-02 12:00:00' AND ts < timestamp_ntz'2024-01-03 00:00:00' AND close > 40")
    assert sorted(r["close"] for r in got.collect()) == [h + 0.5 for h in range(40, 48)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "B/C" not in plan.split("Filter", 1)[1].split("\n")[0] and "close" in plan.split("Filter", 1)[1].split("\n")[0]


def test_universe_and_age(spark, cache):
    assert load(spark, cache, symbols="A, é").count() == 2 * 96
    assert load(spark, cache, maxAgeHours="30", now="2024-02-02 12:00:00").count() == 24
    assert load(spark, cache, maxAgeHours="1", now="2024-03-01 00:00:00").count() == 0
    with pytest.raises(Exception, match="needs now"):
        load(spark, cache, maxAgeHours="1").count()


def test_poll_by_offsets(spark, tmp_path, sf_dir):
    rows = spark.createDataFrame([("A", START + dt.timedelta(days=d), *[float(d)] * 5) for d in range(6)], BC.BARS)
    BC.register(spark)
    path, run = str(tmp_path / "c"), str(tmp_path / "run")
    seen = []
    for i in range(3):
        BC.write_cache(rows.where(F.floor(F.col("close") / 2) == i), path, "2024-02-01 00:00:00", i)
        out = ST.drain(spark.readStream.format("bar_cache").option("path", path).load(), "", "append", run=run)
        seen.append(out.count())
    assert seen == [2, 4, 6] and out.select("batch").distinct().count() == 3
    assert sorted(r["close"] for r in out.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
