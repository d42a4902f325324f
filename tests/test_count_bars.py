"""Bars of a number of ticks come out alike however the ticks fall into batches."""

from __future__ import annotations

import shutil

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators.reviews import tick_bars
from barloom.session import shared_folder
from barloom.streaming import bars as ST
from barloom.streaming import count_bars as CB

PRICES = ["open", "high", "low", "close", "volume"]


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    """The events in five files, each with its share of the time but for some ticks that come a file late."""
    folder = tmp_path_factory.mktemp("ticks")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    span = F.ntile(5).over(Window.orderBy("ts"))
    late = events.withColumn("f", F.least(F.lit(5), span + F.when(F.col("event_id") % 9 == 0, 1).otherwise(0))).toPandas()
    for i in range(1, 6):
        spark.createDataFrame(late[late["f"] == i].drop(columns="f"), ST.EVENTS).coalesce(1).write.parquet(str(folder / f"{i}"))
    return folder


def bars(out):
    return sorted(tuple(r) for r in out.select("symbol", "bar", "first_ts", "last_ts", *PRICES, "num_trades", "complete").collect())


def test_complete_bars_equal_those_of_the_batch(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    out = ST.drain(CB.count_bars(ST.event_stream(spark, path + "*"), 7, "3650 days", "0 seconds"), shared_folder(spark), "append", conf=CB.ROCKSDB)
    got = sorted(tuple(r) for r in out.where("complete").select("symbol", "bar", *PRICES).collect())
    whole = spark.read.parquet(path).where("value IS NOT NULL").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    want = sorted(tuple(r) for r in tick_bars(whole, 7, "value", "value", ["ts", "event_id"], "symbol").where("complete").select("symbol", "bar", *PRICES).collect())
    # The newest tick of all stays with the watermark, and perhaps the bar that it completes.
    assert len(want) - 1 <= len(got) <= len(want)
    close = lambda a, b: a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])
    rest = [w for w in want if w[:2] in {g[:2] for g in got}]
    assert len(rest) == len(got) and all(close(g, w) for g, w in zip(got, rest))
    assert not out.where("NOT complete").count()


def test_batches_restart_and_flush(spark, files, tmp_path_factory):
    """One file at a time, stopped and started again after each, gives what all files at once give."""
    work = tmp_path_factory.mktemp("restarts")
    made = lambda path: CB.count_bars(ST.event_stream(spark, str(path / "*")), 7, "3 hours", "40 days")
    at_once = ST.drain(CB.count_bars(ST.event_stream(spark, str(files / "*")), 7, "3 hours", "0 seconds"), shared_folder(spark), "append", conf=CB.ROCKSDB)
    (work / "in").mkdir()
    last = None
    for i in range(1, 6):
        shutil.copytree(files / str(i), work / "in" / str(i))
        last = ST.drain(made(work / "in"), "", "append", run=str(work / "run"), conf=CB.ROCKSDB)
    assert last.count() == 0  # the watermark is 40 days behind
    # A tick far ahead moves the watermark, and the timers close what is open.
    ahead = spark.createDataFrame([(10 ** 9 + k, 1, "ahead", 1.0, None) for k in range(2)], "event_id long, user_id long, event_type string, value double, props string")
    ahead = ahead.withColumn("ts", F.expr("timestamp_ntz'2024-06-01 00:00:00' + make_dt_interval(0, 0, 0, event_id - 1000000000)")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    ahead.coalesce(1).write.parquet(str(work / "in" / "6"))
    out = ST.drain(made(work / "in"), "", "append", run=str(work / "run"), conf=CB.ROCKSDB)
    assert out.where("NOT complete").count() >= 1
    known = {r[:2]: r for r in bars(out)}
    for r in bars(at_once):
        assert known[r[:2]] == r
    assert sum(r[-2] for r in known.values()) == spark.read.parquet(str(files / "*")).count()


def test_silence_closes_a_bar(spark, tmp_path):
    rows = [(1, 0), (2, 10), (3, 200), (4, 205), (5, 206), (6, 500), (7, 9000)]
    frame = spark.createDataFrame([(i, 1, "a" if m < 9000 else "b", float(i), None, m) for i, m in rows], "event_id long, user_id long, event_type string, value double, props string, m int")
    frame.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, m)")).select("event_id", "ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))
    out = ST.drain(CB.count_bars(ST.event_stream(spark, str(tmp_path / "in")), 3, "1 hour", "0 seconds"), shared_folder(spark), "append", conf=CB.ROCKSDB)
    assert [(r["bar"], r["open"], r["close"], r["num_trades"], r["complete"]) for r in out.orderBy("bar").collect()] == [(0, 1.0, 2.0, 2, False), (1, 3.0, 5.0, 3, True), (2, 6.0, 6.0, 1, False)]


def test_ticks_wait_packed():
    ticks = np.zeros(20_000, CB.TICK)
    ticks["us"] = np.arange(20_000)
    packed = CB._packed(ticks)
    assert len(packed) < 10 and np.concatenate([np.frombuffer(p[0], CB.TICK) for p in packed]).tolist() == ticks.tolist()
