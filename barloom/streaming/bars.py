"""Bars, sessions, alerts and keyed signals on event streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Events from Parquet files as they come; ts becomes a timestamp for the watermark."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, interval: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, vwap, num_trades) by tumbling windows.

    State is one row for each open window; the watermark drops it when it closes.
    """
    order = F.struct("ts", "event_id")
    rows = events.where("value > 0").withWatermark("ts", late)
    return rows.groupBy(F.col("event_type").alias("symbol"), F.window("ts", interval).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.sum("value").alias("volume"), F.try_divide(F.sum(F.col("value") * F.col("value")), F.sum("value")).alias("vwap"), F.count("*").alias("num_trades"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap", "num_trades")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, first_ts, last_ts, n, total): activity with no pause longer than the gap."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select("user_id", "first_ts", "last_ts", "n", "total")


#: Rows of a key that leave a task at a time.
PIECE = 1 << 16
KINDS = np.array(["HOLD", "LONG_ENTRY", "LONG_EXIT"], object)
SIGNALS = "symbol string, ts timestamp, value double, signal_type string, held int"


def keyed_signals(events: DataFrame, enter: float, leave: float, late: str = "1 hour") -> DataFrame:
    """What each event makes a symbol's position do: entry when the value rises above ``enter``, exit when it falls below ``leave``.

    State is the last value, what is held and how far time has come; events that
    come after later ones of their symbol were handled are left out.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, held, upto = state.get if state.exists else (float("nan"), 0, 0)
        us, ids, values = [], [], []
        for b in batches:
            us.append(b["us"].to_numpy(np.int64))
            ids.append(b["event_id"].to_numpy(np.int64))
            values.append(b["value"].to_numpy(np.float64))
        if not sum(map(len, us)):
            return
        us, ids, values = (np.concatenate(x) for x in (us, ids, values))
        order = np.lexsort((ids, us))
        us, values = us[order], values[order]
        late_ones = np.searchsorted(us, upto)
        us, values = us[late_ones:], values[late_ones:]
        kinds, helds = np.zeros(len(us), np.int8), np.zeros(len(us), np.int8)
        for c in range(0, len(us), PIECE):
            for i, value in enumerate(values[c:c + PIECE].tolist(), c):
                if not held and value > enter and not before > enter and before == before:
                    kinds[i], held = 1, 1
                elif held and value < leave:
                    kinds[i], held = 2, 0
                helds[i], before = held, value
        state.update((before, held, int(us[-1]) if len(us) else upto))
        for c in range(0, max(1, len(us)), PIECE):
            at = slice(c, c + PIECE)
            yield pd.DataFrame({"symbol": key[0], "ts": pd.to_datetime(us[at], unit="us", utc=True), "value": values[at], "signal_type": KINDS[kinds[at]], "held": helds[at].astype(np.int32)})

    rows = events.withWatermark("ts", late).select(F.col("event_type").alias("symbol"), "ts", F.coalesce(F.unix_micros("ts"), F.lit(-1)).alias("us"),
                                                    F.coalesce("event_id", F.lit((1 << 63) - 1)).alias("event_id"), "value")
    return rows.groupBy("symbol").applyInPandasWithState(step, SIGNALS, "before double, held int, upto long", "append", GroupStateTimeout.NoTimeout)


def alerts(events: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Events outside the limits of their type, with a priority by how far; stateless."""
    out = None
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind, (lo, hi) in limits.items():
        low, high = F.when(F.col("event_type") == kind, lo).otherwise(low), F.when(F.col("event_type") == kind, hi).otherwise(high)
    out = events.withColumn("excess", F.greatest(F.col("value") - high, low - F.col("value"))).where("excess > 0")
    return out.withColumn("priority", F.when(F.col("excess") > (high - low), "high").otherwise("normal"))


def drain(stream: DataFrame, folder: str, mode: str, handle: Callable[[DataFrame, int], None] | None = None,
          run: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there now and read its output back.

    Each batch goes to Parquet under its number, so a batch that is run again
    replaces its own files; in update mode the reader keeps each row's newest.
    With ``run``, a folder, a later call goes on where that one stopped.  ``conf``
    holds while the stream starts, which is when it is read.
    """
    spark = stream.sparkSession
    run = run or f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={number}")
        if handle:
            handle(batch, number)

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{run}/state").foreachBatch(write).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(f"{run}/out")


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of an update stream's output, the last state of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
