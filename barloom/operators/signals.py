"""Signals from a combined indicator: crossings, positions with state, contributions, quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bars import series


def crossings(rows: DataFrame, x: str, level: float) -> DataFrame:
    """Rows at which ``x`` rises above or falls to the level, with the side."""
    before = F.lag(x).over(series())
    side = F.when((F.col(x) > level) & (before <= level), "up").when((F.col(x) <= level) & (before > level), "down")
    return rows.withColumn("crossing", side).where("crossing IS NOT NULL")


def _states(si: np.ndarray, enter: float, leave: float) -> list[str]:
    """What happens on each bar of one series, given what is held."""
    held, out = 0, ["HOLD"]
    for before, now in zip(si[:-1].tolist(), si[1:].tolist()):
        event = "HOLD"
        if before == before and now == now:
            if not held:
                if now > enter >= before:
                    held, event = 1, "LONG_ENTRY"
                elif now < -enter <= before:
                    held, event = -1, "SHORT_ENTRY"
            elif now * held < leave:
                event, held = ("LONG_EXIT" if held > 0 else "SHORT_EXIT"), 0
        out.append(event)
    return out


def positions(rows: DataFrame, si: str = "si", enter: float = 0.7, leave: float = 0.3) -> DataFrame:
    """(symbol, ts, si, signal_type, confidence): entries when flat and the level is crossed,
    exits when the value falls back below the lower level.

    What a bar does depends on what earlier bars did, so each series is one
    grouped scan; series are independent.
    """
    kept = [f for f in rows.schema if f.name in ("symbol", "ts")]
    schema = T.StructType([*kept, T.StructField("si", T.DoubleType()), T.StructField("signal_type", T.StringType()), T.StructField("confidence", T.DoubleType())])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts", kind="stable")
        x = b["si"].to_numpy(float)
        return b.assign(signal_type=_states(x, enter, leave), confidence=np.abs(x))[["symbol", "ts", "si", "signal_type", "confidence"]]

    return rows.select("symbol", "ts", F.col(si).alias("si")).groupBy("symbol").applyInPandas(run, schema)


def confident(signals: DataFrame, least: float = 0.5) -> DataFrame:
    """Entries below the confidence become HOLD."""
    weak = F.col("signal_type").endswith("_ENTRY") & (F.col("confidence") < least)
    return signals.withColumn("signal_type", F.when(weak, "HOLD").otherwise(F.col("signal_type")))


def quality(signals: DataFrame, forward: str, *keys: str) -> DataFrame:
    """Counts, mean forward returns and win rates of entries by side; a falling price is a short's gain."""
    long, short = F.col("signal_type") == "LONG_ENTRY", F.col("signal_type") == "SHORT_ENTRY"
    r = F.col(forward)

    def rate(side: Column, win: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(side & win), F.count_if(side)), F.lit(0.0))

    return signals.groupBy(*keys).agg(
        F.count_if(long | short).alias("total_signals"), F.count_if(long).alias("long_signals"), F.count_if(short).alias("short_signals"),
        F.coalesce(F.avg(F.when(long, r)), F.lit(0.0)).alias("long_avg_return"), F.coalesce(-F.avg(F.when(short, r)), F.lit(0.0)).alias("short_avg_return"),
        rate(long, r > 0).alias("long_win_rate"), rate(short, r < 0).alias("short_win_rate"))


def contributions(rows: DataFrame, weights: dict[str, float], *keys: str) -> DataFrame:
    """(keys, indicator, value, contribution): each normalised column times its weight."""
    parts = F.array(*(F.struct(F.lit(c).alias("indicator"), F.col(f"`{c}`").alias("value"), (F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) * float(w)).alias("contribution")) for c, w in weights.items()))
    return rows.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")


def top_contributors(parts: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n largest contributions by size for each key; names decide ties.

    Kept as a bounded heap in the aggregation: nothing is sorted over all rows.
    """
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.abs("contribution")).alias("size"), "indicator", "contribution"))), 1, n)
    return parts.groupBy(*keys).agg(best.alias("b")).select(*keys, F.posexplode("b").alias("rank", "b")).select(*keys, (F.col("rank") + 1).alias("rank"), "b.indicator", "b.contribution")


def live_signals(rows: DataFrame, si: str, atr: str, stop: float = 2.0, reward: float = 2.0) -> DataFrame:
    """Adds direction, stop and target prices of the newest bar of each symbol."""
    newest = rows.groupBy("symbol").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "symbol"]), "ts").alias("r")).select("symbol", "r.*")
    side = F.when(F.col(si) > 0.3, 1).when(F.col(si) < -0.3, -1).otherwise(0)
    return newest.withColumn("side", side).withColumn("stop_price", F.when(side != 0, F.col("close") - side * stop * F.col(atr))).withColumn(
        "target_price", F.when(side != 0, F.col("close") + side * reward * stop * F.col(atr)))
