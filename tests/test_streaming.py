"""Streams in several batches give what one batch gives."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from barloom.session import shared_folder
from barloom.streaming import bars as ST


@pytest.fixture(scope="module")
def pieces(spark, sf_dir, tmp_path_factory):
    """The events in order of time, in five files of growing age."""
    folder = tmp_path_factory.mktemp("stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts").toPandas()
    for i in range(5):
        part = events.iloc[len(events) * i // 5: len(events) * (i + 1) // 5]
        spark.createDataFrame(part, ST.EVENTS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return str(folder / "in")


def key(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_bars_over_batches(spark, sf_dir, pieces):
    whole = ST.newest(ST.drain(ST.bars(ST.event_stream(spark, f"{sf_dir}/events.parquet*")), shared_folder(spark), "update"), "symbol", "ts")
    out = ST.drain(ST.bars(ST.event_stream(spark, pieces, 1), late="3650 days"), shared_folder(spark), "update")
    assert out.select("batch").distinct().count() > 1
    cols = ["symbol", "ts", "open", "high", "low", "close", F.round("volume", 6), "num_trades"]
    assert key(ST.newest(out, "symbol", "ts").select(*cols)) == key(whole.select(*cols))


def test_signals_keep_state_between_batches(spark, sf_dir, pieces):
    cols = ["symbol", "ts", "value", "signal_type", "held"]
    whole = ST.drain(ST.keyed_signals(ST.event_stream(spark, f"{sf_dir}/events.parquet*"), 60, 20), shared_folder(spark), "append")
    out = ST.drain(ST.keyed_signals(ST.event_stream(spark, pieces, 1), 60, 20), shared_folder(spark), "append")
    # Files of one age come in any order; with one file a batch, later files may hold earlier events, which are left out.
    assert set(key(out.select("symbol", "ts"))) <= set(key(whole.select("symbol", "ts")))
    held = {}
    for symbol, ts, _, kind, now in sorted(tuple(r) for r in out.select(*cols).collect()):
        before = held.get(symbol, 0)
        assert now - before == {"HOLD": 0, "LONG_ENTRY": 1, "LONG_EXIT": -1}[kind], (symbol, ts)
        held[symbol] = now


def test_late_events_are_left_out(spark, tmp_path):
    """The watermark of one batch holds for late events of the batch after the next."""
    rows = [(1, "2024-01-01 00:01:00", 1, "a", 5.0, None), (2, "2024-01-01 10:00:00", 1, "a", 6.0, None), (4, "2024-01-01 10:01:00", 1, "a", 6.5, None), (3, "2024-01-01 00:02:00", 1, "a", 7.0, None)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(
            "event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time
    out = ST.drain(ST.bars(ST.event_stream(spark, str(tmp_path / "in"), 1)), shared_folder(spark), "append")
    assert [(r["open"], r["num_trades"]) for r in out.orderBy("ts").collect()][0] == (5.0, 1)


def test_alerts_reach_the_handler(spark, sf_dir):
    seen = []
    out = ST.drain(ST.alerts(ST.event_stream(spark, f"{sf_dir}/events.parquet*"), {"view": (5, 90)}), shared_folder(spark), "append", lambda batch, n: seen.append((n, batch.count())))
    assert sum(n for _, n in seen) == out.count() > 0


def test_signals_leave_in_pieces(spark, sf_dir, monkeypatch):
    signals = lambda: sorted(tuple(r) for r in ST.drain(ST.keyed_signals(ST.event_stream(spark, f"{sf_dir}/events.parquet*"), 60, 20), shared_folder(spark), "append").select("symbol", "ts", "value", "signal_type", "held").collect())
    whole = signals()
    monkeypatch.setattr(ST, "PIECE", 7)
    assert signals() == whole and len(whole) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
