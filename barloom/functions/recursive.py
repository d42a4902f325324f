"""Indicators defined by recursion over a series: one grouped pass computes all that are asked for.

A series is the bars of one symbol, bounded by calendar time and not by the size
of the input; the pass is one sort and one linear scan per symbol.  Smoothing
starts at the first value of its input; outputs are null until the smoothing
has seen as many values as its period.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ema(x: pd.Series, n: int, masked: bool = True) -> pd.Series:
    return x.ewm(span=n, adjust=False, min_periods=n if masked else 0).mean()


def wilder(x: pd.Series, n: int) -> pd.Series:
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def true_range(b: pd.DataFrame) -> pd.Series:
    before = b["close"].shift()
    return pd.concat([b["high"] - b["low"], (b["high"] - before).abs(), (b["low"] - before).abs()], axis=1).max(axis=1, skipna=True)


def atr(b: pd.DataFrame, n: int) -> pd.Series:
    """Seeded with the mean of the first n true ranges, then Wilder's smoothing."""
    tr = true_range(b).to_numpy()
    out = np.full(len(tr), np.nan)
    if len(tr) >= n:
        out[n - 1] = tr[:n].mean()
        for i in range(n, len(tr)):
            out[i] = (out[i - 1] * (n - 1) + tr[i]) / n
    return pd.Series(out, index=b.index)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def rsi(b: pd.DataFrame, n: int) -> dict:
    d = b["close"].diff()
    up, down = wilder(d.clip(lower=0).fillna(0), n), wilder(-d.clip(upper=0).fillna(0), n)
    return {f"RSI_{n}": 100 * _ratio(up, up + down)}


def macd(b: pd.DataFrame, fast: int, slow: int, signal: int) -> dict:
    line = ema(b["close"], fast) - ema(b["close"], slow)
    sign = ema(line.dropna(), signal).reindex(b.index)
    tag = f"{fast}_{slow}_{signal}"
    return {f"MACD_{tag}": line, f"MACDh_{tag}": line - sign, f"MACDs_{tag}": sign}


def chained(x: pd.Series, n: int, k: int) -> list[pd.Series]:
    out = []
    for _ in range(k):
        x = ema(x.dropna(), n).reindex(x.index)
        out.append(x)
    return out


def dema(b: pd.DataFrame, n: int) -> dict:
    e = chained(b["close"], n, 2)
    return {f"DEMA_{n}": 2 * e[0] - e[1]}


def tema(b: pd.DataFrame, n: int) -> dict:
    e = chained(b["close"], n, 3)
    return {f"TEMA_{n}": 3 * e[0] - 3 * e[1] + e[2]}


def t3(b: pd.DataFrame, n: int, v: float = 0.7) -> dict:
    e = chained(b["close"], n, 6)
    return {f"T3_{n}": -v ** 3 * e[5] + (3 * v ** 2 + 3 * v ** 3) * e[4] + (-6 * v ** 2 - 3 * v - 3 * v ** 3) * e[3] + (1 + 3 * v + v ** 3 + 3 * v ** 2) * e[2]}


def kama(b: pd.DataFrame, n: int, fast: int = 2, slow: int = 30) -> dict:
    c = b["close"].to_numpy()
    out = np.full(len(c), np.nan)
    if len(c) >= n:
        noise = pd.Series(np.abs(np.diff(c, prepend=c[0]))).rolling(n).sum().to_numpy()
        out[n - 1] = c[n - 1]
        for i in range(n, len(c)):
            er = abs(c[i] - c[i - n]) / noise[i] if noise[i] else 0.0
            k = (er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
            out[i] = out[i - 1] + k * (c[i] - out[i - 1])
    return {f"KAMA_{n}": pd.Series(out, index=b.index)}


def tsi(b: pd.DataFrame, fast: int, slow: int) -> dict:
    d = b["close"].diff().iloc[1:]

    def twice(x: pd.Series) -> pd.Series:
        return ema(ema(x, slow).dropna(), fast)

    return {f"TSI_{fast}_{slow}": (100 * _ratio(twice(d), twice(d.abs()))).reindex(b.index)}


def adx(b: pd.DataFrame, n: int) -> dict:
    up, down = b["high"].diff(), -b["low"].diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    tr = true_range(b).iloc[1:]
    s = wilder(tr, n)
    p, m = 100 * _ratio(wilder(plus.iloc[1:], n), s), 100 * _ratio(wilder(minus.iloc[1:], n), s)
    a = wilder((100 * _ratio((p - m).abs(), p + m)).dropna(), n)
    return {f"ADX_{n}": a.reindex(b.index), f"DMP_{n}": p.reindex(b.index), f"DMN_{n}": m.reindex(b.index)}


def supertrend(b: pd.DataFrame, n: int, k: float) -> dict:
    a = atr(b, n)
    mid = (b["high"] + b["low"]) / 2
    high, low, c = mid + k * a, mid - k * a, b["close"]
    turn = pd.Series(np.where(c > high.shift(), 1.0, np.where(c < low.shift(), -1.0, np.nan)), index=b.index)
    side = turn.ffill().fillna(1.0)
    return {f"SUPERT_{n}_{k:g}": low.where(side > 0, high), f"SUPERTd_{n}_{k:g}": side}


def psar(b: pd.DataFrame, step: float = 0.02, most: float = 0.2) -> dict:
    h, lo = b["high"].to_numpy(), b["low"].to_numpy()
    n = len(h)
    up, down = np.full(n, np.nan), np.full(n, np.nan)
    if n > 1:
        rising, af, sar, best = True, step, lo[0], h[0]
        for i in range(1, n):
            sar = sar + af * (best - sar)
            sar = min(sar, lo[i - 1], lo[max(i - 2, 0)]) if rising else max(sar, h[i - 1], h[max(i - 2, 0)])
            if (lo[i] < sar) if rising else (h[i] > sar):
                rising, sar, af = not rising, best, step
                best = h[i] if rising else lo[i]
            elif (h[i] > best) if rising else (lo[i] < best):
                best, af = (h[i] if rising else lo[i]), min(af + step, most)
            (up if rising else down)[i] = sar
    u, d = pd.Series(up, index=b.index), pd.Series(down, index=b.index)
    flip_up, flip_down = u.notna() & u.shift().isna(), d.notna() & d.shift().isna()
    return {"PSARl": u, "PSARs": d, "PSARlf": flip_up.astype(float), "PSARsf": flip_down.astype(float)}


def mass_index(b: pd.DataFrame, fast: int, slow: int) -> dict:
    e = chained(b["high"] - b["low"], fast, 2)
    return {f"MASSI_{fast}_{slow}": _ratio(e[0], e[1]).rolling(slow).sum()}


def keltner(b: pd.DataFrame, n: int, k: float) -> dict:
    mid, a = ((b["high"] + b["low"] + b["close"]) / 3).rolling(n).mean(), atr(b, n)
    return {f"KCL_{n}_{k:g}": mid - k * a, f"KCM_{n}_{k:g}": mid, f"KCU_{n}_{k:g}": mid + k * a}


def adosc(b: pd.DataFrame, fast: int, slow: int) -> dict:
    span = b["high"] - b["low"]
    flow = (((2 * b["close"] - b["low"] - b["high"]) / span.where(span != 0)).fillna(0) * b["volume"]).cumsum()
    return {f"ADOSC_{fast}_{slow}": ema(flow, fast) - ema(flow, slow)}


def efi(b: pd.DataFrame, n: int) -> dict:
    return {f"EFI_{n}": ema((b["close"].diff() * b["volume"]).iloc[1:], n).reindex(b.index)}


def ema_adjusted(b: pd.DataFrame, n: int) -> dict:
    return {f"EMA_ADJ_{n}": b["close"].ewm(span=n).mean()}


FAMILIES: dict[str, list[tuple]] = {
    "smoothing": [*((lambda b, n: {f"EMA_{n}": ema(b["close"], n)}, n) for n in (10, 20, 50, 100, 200)), (dema, 10), (dema, 20), (tema, 10), (tema, 20),
                  (t3, 5), (t3, 10), (kama, 10), (kama, 20), (ema_adjusted, 9), (ema_adjusted, 21)],
    "oscillators": [(rsi, 7), (rsi, 14), (rsi, 21), (macd, 12, 26, 9), (macd, 8, 17, 9), (macd, 5, 35, 5), (tsi, 13, 25)],
    "ranges": [(lambda b, n: {f"ATR_{n}": atr(b, n)}, 14), (lambda b, n: {f"ATR_{n}": atr(b, n)}, 20), (lambda b, n: {f"NATR_{n}": 100 * atr(b, n) / b["close"]}, 14),
               (lambda b, n: {f"NATR_{n}": 100 * atr(b, n) / b["close"]}, 20), (keltner, 20, 2.0), (keltner, 20, 1.5), (mass_index, 9, 25)],
    "direction": [(adx, 14), (adx, 20), (supertrend, 7, 3.0), (supertrend, 10, 2.0), (supertrend, 20, 3.0), (psar,)],
    "flows": [(adosc, 3, 10), (efi, 13), (efi, 20)],
}


def outputs(*families: str) -> list[str]:
    """Names of the columns of the families, from a short series."""
    sample = pd.DataFrame({c: np.linspace(10.0, 11.0, 300) for c in ("open", "high", "low", "close", "volume")})
    return [name for f in families or tuple(FAMILIES) for make, *args in FAMILIES[f] for name in make(sample, *args)]


def recursive_indicators(bars: DataFrame, *families: str) -> DataFrame:
    """(symbol, ts, one column per output) of the families, or of all."""
    chosen = families or tuple(FAMILIES)
    names = outputs(*chosen)
    kept = [f for f in bars.schema if f.name in ("symbol", "ts")]
    schema = T.StructType(kept + [T.StructField(n, T.DoubleType()) for n in names])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("ts", kind="stable").reset_index(drop=True)
        out = {"symbol": b["symbol"], "ts": b["ts"]}
        for f in chosen:
            for make, *args in FAMILIES[f]:
                out.update(make(b, *args))
        return pd.DataFrame(out)[[f.name for f in schema]]

    return bars.select("symbol", "ts", "open", "high", "low", "close", "volume").groupBy("symbol").applyInPandas(run, schema)
