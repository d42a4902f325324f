"""Bars of a fixed number of ticks on a stream, with a flush when a symbol falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed lists and timers need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
BARS = "symbol string, bar long, first_ts timestamp, last_ts timestamp, open double, high double, low double, close double, volume double, vwap double, num_trades long, complete boolean"
#: Ticks wait packed, many in one entry of the list.
_TICKS, TICK = "packed binary", np.dtype([("us", "<i8"), ("id", "<i8"), ("price", "<f8"), ("volume", "<f8")])
#: Ticks of one entry, and ticks whose bars leave a task at a time.
PACK, PIECE = 1 << 13, 1 << 16
_BAR = "bar long, first_us long, last_us long, open double, high double, low double, close double, volume double, money double, n long"


class CountBars(StatefulProcessor):
    """Ticks wait in a list until the watermark has passed them, so they are taken in order of event time whatever batch
    brought them; the bar under construction is one value.  A timer for the oldest waiting tick and one for the end of
    the silence after the last bar's tick wake the key."""

    def __init__(self, n: int, idle_us: int) -> None:
        self.n, self.idle_us = n, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _TICKS)
        self.bar = handle.getValueState("bar", _BAR)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        oldest = None
        for batch in rows:
            if not len(batch):
                continue
            ticks = np.empty(len(batch), TICK)
            for name in TICK.names:
                ticks[name] = batch[name].to_numpy()
            self.waiting.appendList(_packed(ticks))
            oldest = min(ticks["us"].min(), ticks["us"].min() if oldest is None else oldest)
        if oldest is not None:
            self.handle.registerTimer(int(oldest) // 1000 + 1)
        # Ticks of before have their timers; what waits is read only where a new one is due.
        if oldest is not None and oldest < timerValues.getCurrentWatermarkInMs() * 1000:
            yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        """Takes all ticks before the watermark, and closes a bar that has been silent for too long."""
        ticks = np.concatenate([np.empty(0, TICK), *(np.frombuffer(t[0], TICK) for t in (self.waiting.get() if self.waiting.exists() else []))])
        past = ticks["us"] < watermark * 1000
        due, rest = ticks[past], ticks[~past]
        due = due[np.lexsort((due["volume"], due["price"], due["id"], due["us"]))]
        bar = self.bar.get() if self.bar.exists() else None
        out: list[tuple] = []
        number = bar[0] if bar else 0
        open_bar = list(bar) if bar and bar[9] else None
        for us, _, price, volume in (t for c in range(0, len(due), PIECE) for t in due[c:c + PIECE].tolist()):
            if open_bar and us - open_bar[2] > self.idle_us:
                out.append((*open_bar, False))
                number, open_bar = number + 1, None
            if open_bar is None:
                open_bar = [number, us, us, price, price, price, price, 0.0, 0.0, 0]
            open_bar[2], open_bar[4], open_bar[5], open_bar[6] = us, max(open_bar[4], price), min(open_bar[5], price), price
            open_bar[7] += volume
            open_bar[8] += volume * price
            open_bar[9] += 1
            if open_bar[9] == self.n:
                out.append((*open_bar, True))
                number, open_bar = number + 1, None
            if len(out) == PIECE:
                yield _bars(key, out)
                out = []
        if open_bar and watermark * 1000 - open_bar[2] > self.idle_us:
            out.append((*open_bar, False))
            number, open_bar = number + 1, None
        if len(due):
            if len(rest):
                self.waiting.put(_packed(rest))
                self.handle.registerTimer(int(rest["us"].min()) // 1000 + 1)
            else:
                self.waiting.clear()
        if len(due) or out:
            self.bar.update(tuple(open_bar) if open_bar else (number, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0))
            if open_bar:
                self.handle.registerTimer((open_bar[2] + self.idle_us) // 1000 + 1)
        if out:
            yield _bars(key, out)


def _packed(ticks: np.ndarray) -> list[tuple]:
    return [(ticks[c:c + PACK].tobytes(),) for c in range(0, len(ticks), PACK)]


def _bars(key: tuple, out: list[tuple]) -> pd.DataFrame:
    at = lambda i: pd.to_datetime([r[i] for r in out], unit="us", utc=True)
    return pd.DataFrame({
        "symbol": key[0], "bar": [r[0] for r in out], "first_ts": at(1), "last_ts": at(2), **{c: [r[i] for r in out] for i, c in enumerate(("open", "high", "low", "close", "volume"), 3)},
        "vwap": [r[8] / r[7] if r[7] > 0 else r[6] for r in out], "num_trades": [r[9] for r in out], "complete": [r[10] for r in out]})


def count_bars(events: DataFrame, n: int, idle: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars of ``n`` ticks of each symbol, numbered from 0; a bar that is silent for longer than ``idle`` closes with fewer.

    The result does not depend on how the ticks fall into batches: they are taken
    in order of event time (ties by id) once the watermark, ``late`` behind the newest
    tick, has passed them; later ones are left out.  Ticks of a type are one key, of
    which only those since the watermark are held.  vwap weighs prices by volume,
    and is the close where the volume is zero.  Run it with the settings in ``ROCKSDB``.
    """
    rows = events.where(F.col("value").isNotNull() & F.col("event_type").isNotNull()).withWatermark("ts", late).select(
        F.col("event_type").alias("symbol"), "ts", F.unix_micros("ts").alias("us"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.col("value").alias("volume"))
    idle_us = rows.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp'1970-01-02 00:00:00' + interval {idle}) - unix_micros(timestamp'1970-01-02 00:00:00')")).first()[0]
    return rows.groupBy("symbol").transformWithStateInPandas(CountBars(n, idle_us), BARS, "append", "eventTime")
