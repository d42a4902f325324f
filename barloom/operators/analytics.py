"""Analytic windows over series: returns, expanding and rolling statistics, runs, drawdowns."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .bars import series


def rows_back(n: int, over: WindowSpec | None = None) -> WindowSpec:
    return (over or series()).rowsBetween(-(n - 1), 0)


def expanding(over: WindowSpec | None = None) -> WindowSpec:
    return (over or series()).rowsBetween(Window.unboundedPreceding, 0)


def pct_change(x: str, k: int = 1, over: WindowSpec | None = None) -> Column:
    before = F.lag(x, k).over(over or series())
    return F.try_divide(F.col(x) - before, before)


def forward_return(x: str, k: int, over: WindowSpec | None = None) -> Column:
    return F.try_divide(F.lead(x, k).over(over or series()) - F.col(x), F.col(x))


def expanding_z(x: str, least: int = 20, over: WindowSpec | None = None) -> Column:
    """(x - mean) / sample deviation of all rows so far, this one included."""
    w = expanding(over)
    z = F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w))
    return F.when(F.count(x).over(w) >= least, z)


def percentile_of(history: Column, x: Column) -> Column:
    """The mean of the shares of ``history`` below and up to x, in percent of ties."""
    below = F.size(F.filter(history, lambda y: y < x))
    up_to = F.size(F.filter(history, lambda y: y <= x))
    return F.try_divide((below + up_to + F.when(up_to > below, 1).otherwise(0)).cast("double"), F.lit(2.0) * F.size(history))


def rolling_percent_rank(x: str, n: int, over: WindowSpec | None = None) -> Column:
    """Rank in percent of the newest of the last n values, ties averaged; null before n values."""
    held = F.collect_list(x).over(rows_back(n, over))
    below = F.size(F.filter(held, lambda y: y < F.col(x)))
    equal = F.size(F.filter(held, lambda y: y == F.col(x)))
    return F.when(F.size(held) >= n, (below + (equal + 1) / 2.0) / n * 100)


def drawdowns(rows: DataFrame, equity: str, over: WindowSpec | None = None) -> DataFrame:
    """Adds peak and drawdown, the share below the running maximum."""
    peak = F.max(equity).over(expanding(over))
    return rows.withColumn("peak", peak).withColumn("drawdown", F.try_divide(F.col(equity) - F.col("peak"), F.col("peak")))


def islands(rows: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Maximal runs of one state: keys, state, run number, length and ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(1))
    marked = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run", state).agg(F.count("*").alias("length"), F.min(order[0]).alias("first_ts"), F.max(order[0]).alias("last_ts"))


def transitions(rows: DataFrame, state: str, over: WindowSpec | None = None) -> DataFrame:
    """Rows at which the state changes, with the state before."""
    return rows.withColumn("from_state", F.lag(state).over(over or series())).where(F.col("from_state") != F.col(state)).withColumnRenamed(state, "to_state")


def simple_regimes(bars: DataFrame, trend: int = 20, lookback: int = 252) -> DataFrame:
    """Adds regime by closing trend and volatility percentile.

    volatile above the 0.8 percentile of the mean true range so far this year,
    else up or down by more than two percent from the mean of ``trend`` closes,
    else ranging; unknown during the first 2 * trend bars.
    """
    before = F.lag("close").over(series())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    out = bars.withColumn("rn", F.row_number().over(series())).withColumn("tr", F.when(F.col("rn") > 1, tr))
    out = out.withColumn("mean_tr", F.when(F.col("rn") > trend, F.avg("tr").over(rows_back(trend)))).withColumn("mean_close", F.avg("close").over(rows_back(trend)))
    held = F.collect_list("mean_tr").over(rows_back(lookback))
    share = F.try_divide(F.size(F.filter(held, lambda y: y <= F.col("mean_tr"))).cast("double"), F.size(held))
    out = out.withColumn("vol_pct", share).withColumn("distance", F.try_divide(F.col("close") - F.col("mean_close"), F.col("mean_close")))
    return out.withColumn("regime", F.when(F.col("rn") <= 2 * trend, "unknown").when(F.col("vol_pct") > 0.8, "volatile")
                          .when(F.col("distance") > 0.02, "trending_up").when(F.col("distance") < -0.02, "trending_down").otherwise("ranging"))


def _wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Seeded with the mean of the first n values, then (before * (n - 1) + x) / n; a missing seed stays missing."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1] = x[:n].mean()
        for i in range(n, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


def _detect(b: pd.DataFrame, n: int, vol: int, adx_limit: float, vol_limit: float, seeded: bool) -> pd.DataFrame:
    b = b.sort_values("ts", kind="stable")
    high, low, close = (b[c].to_numpy(np.float64) for c in ("high", "low", "close"))
    size = len(b)
    tr = np.maximum(high[1:] - low[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])))
    up, down = np.diff(high), -np.diff(low)
    atr = _wilder(tr, n) + 1e-10
    plus = 100 * _wilder(np.where((up > down) & (up > 0), up, 0.0), n) / atr
    minus = 100 * _wilder(np.where((down > up) & (down > 0), down, 0.0), n) / atr
    dx = 100 * np.abs(plus - minus) / (plus + minus + 1e-10)
    adx = np.full(size, np.nan)
    skip = n - 1 if seeded else 0
    if size > 1 + skip:
        adx[1 + skip:] = _wilder(dx[skip:], n)
    ema = pd.Series(close).ewm(span=n, adjust=False).mean().to_numpy()
    slow = pd.Series(close).ewm(span=2 * n, adjust=False).mean().to_numpy()
    slope = np.full(size, np.nan)
    slope[5:] = ema[5:] - ema[:-5]
    strength = np.minimum(1.0, np.abs(ema - slow) / (pd.Series(close).rolling(n).mean().to_numpy() + 1e-10) * 20)
    mean_tr = np.concatenate([[np.nan], pd.Series(tr).rolling(vol).mean().to_numpy()]) if size else tr
    # The exact share of all values so far: each is filed in a sorted list.
    seen: list[float] = []
    share_below = np.full(size, 0.5)
    for i, x in enumerate(mean_tr):
        if not np.isnan(x):
            insort(seen, x)
            if i >= 2 * vol - 1:
                share_below[i] = bisect_right(seen, x) / len(seen)
    trending, volatile = adx > adx_limit, share_below > vol_limit
    regime = np.select([np.arange(size) < 2 * n, volatile & ~trending, trending & (slope > 0), trending & (slope < 0)], ["unknown", "volatile", "trending_up", "trending_down"], "ranging")
    sure = {"volatile": np.minimum(1.0, share_below), "ranging": np.fmin(1.0, (adx_limit - adx) / adx_limit), "unknown": np.zeros(size)}
    confidence = np.select([regime == k for k in sure], list(sure.values()), np.minimum(1.0, adx / 50))
    run = np.arange(size) - np.maximum.accumulate(np.where(np.concatenate([[True], regime[1:] != regime[:-1]]), np.arange(size), 0)) + 1 if size else np.zeros(0, int)
    return pd.DataFrame({"symbol": b["symbol"], "ts": b["ts"], "close": close, "regime": regime, "adx": adx, "slope": slope, "strength": strength * np.sign(np.nan_to_num(slope)), "vol_pct": share_below, "confidence": confidence, "duration": run})


def detect_regimes(bars: DataFrame, trend: int = 20, vol: int = 20, adx_limit: float = 25.0, vol_limit: float = 0.7, seeded: bool = True) -> DataFrame:
    """(symbol, ts, close, regime, adx, slope, strength, vol_pct, confidence, duration) for every bar, from the bars up to it.

    Trending by the average directional index and the slope of an EMA over five
    bars; volatile by the share of all mean true ranges so far that are no
    larger; unknown for the first 2 * ``trend`` bars.  One pass a series: a
    series is bounded by calendar time.  The second smoothing of the index starts
    at its first value; with ``seeded`` False it takes in the missing ones before
    it, stays missing for ever, and nothing is called trending.
    """
    kept = {f.name: f.dataType.simpleString() for f in bars.schema if f.name in ("symbol", "ts")}
    schema = ", ".join(f"{c} {t}" for c, t in kept.items()) + ", close double, regime string, adx double, slope double, strength double, vol_pct double, confidence double, duration long"
    return bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(lambda b: _detect(b, trend, vol, adx_limit, vol_limit, seeded), schema)
