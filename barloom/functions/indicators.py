"""Technical indicators that are plain windows: rolling means, ranges, sums and lags.

``window_indicators`` computes any of them in as few Window operators as the
nesting of the formulas needs: all expressions of one level share the partition
and order, so Spark sorts each series once.  A value is null until its window is
full; nothing is filled backwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.bars import series

Stage = dict[str, Column]


def _w(n: int):
    return series().rowsBetween(-(n - 1), 0)


def _full(n: int, x: Column) -> Column:
    return F.when(F.col("rn") >= n, x)


def roll(kind: str, x: str, n: int, lead: int = 0) -> Column:
    """A rolling aggregate of ``n`` rows of a column whose first ``lead`` rows are null."""
    agg = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "pstd": F.stddev_pop}[kind]
    return _full(n + lead, agg(x).over(_w(n)))


def wma(x: str, n: int, lead: int = 0) -> Column:
    """Weights 1..n, the newest heaviest: a weighted sum of lags, so no array is built."""
    total = sum((F.lag(x, k).over(series()) if k else F.col(x)) * float(n - k) for k in range(n))
    return _full(n + lead, total / (n * (n + 1) / 2))


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _sma(n: int) -> list[Stage]:
    return [{f"SMA_{n}": roll("avg", "close", n)}]


def _wma(n: int) -> list[Stage]:
    return [{f"WMA_{n}": wma("close", n)}]


def _hma(n: int) -> list[Stage]:
    half, root = max(n // 2, 1), max(int(n ** 0.5), 1)
    return [{f"_hma{n}": 2 * wma("close", half) - wma("close", n)}, {f"HMA_{n}": wma(f"_hma{n}", root, n - 1)}]


def _vwma(n: int) -> list[Stage]:
    return [{f"VWMA_{n}": _div(roll("sum", "_pv", n), roll("sum", "volume", n))}]


def _stoch(k: int, d: int) -> list[Stage]:
    low, high = roll("min", "low", k), roll("max", "high", k)
    return [{f"STOCHk_{k}_{d}": 100 * _div(F.col("close") - low, high - low)}, {f"STOCHd_{k}_{d}": roll("avg", f"STOCHk_{k}_{d}", d, k - 1)}]


def _willr(n: int) -> list[Stage]:
    low, high = roll("min", "low", n), roll("max", "high", n)
    return [{f"WILLR_{n}": -100 * _div(high - F.col("close"), high - low)}]


def _cci(n: int) -> list[Stage]:
    mean = f"_cci{n}"
    held = F.collect_list("_tp").over(_w(n))
    mad = F.aggregate(F.transform(held, lambda x: F.abs(x - F.col(mean))), F.lit(0.0), lambda a, x: a + x) / n
    return [{mean: roll("avg", "_tp", n)}, {f"CCI_{n}": _full(n, _div(F.col("_tp") - F.col(mean), 0.015 * mad))}]


def _roc(n: int) -> list[Stage]:
    before = F.lag("close", n).over(series())
    return [{f"ROC_{n}": 100 * _div(F.col("close") - before, before)}]


def _mom(n: int) -> list[Stage]:
    return [{f"MOM_{n}": F.col("close") - F.lag("close", n).over(series())}]


def _cmo(n: int) -> list[Stage]:
    up, down = roll("sum", "_up", n, 1), roll("sum", "_down", n, 1)
    return [{f"CMO_{n}": 100 * _div(up - down, up + down)}]


def _uo(a: int, b: int, c: int) -> list[Stage]:
    def part(n: int) -> Column:
        return _div(roll("sum", "_bp", n, 1), roll("sum", "_range", n, 1))

    return [{f"UO_{a}_{b}_{c}": 100 * (4 * part(a) + 2 * part(b) + part(c)) / 7}]


def _ao(a: int, b: int) -> list[Stage]:
    return [{f"AO_{a}_{b}": roll("avg", "_hl2", a) - roll("avg", "_hl2", b)}]


def _kst(r: tuple[int, ...] = (10, 15, 20, 30), s: tuple[int, ...] = (10, 10, 10, 15), signal: int = 9) -> list[Stage]:
    rocs = {f"_kst{i}": _div(F.col("close") - F.lag("close", n).over(series()), F.lag("close", n).over(series())) for i, n in enumerate(r)}
    line = 100 * sum((i + 1) * roll("avg", f"_kst{i}", m, n) for i, (n, m) in enumerate(zip(r, s)))
    return [rocs, {"KST": line}, {"KSTs": roll("avg", "KST", signal, r[3] + s[3] - 1)}]


def _coppock(fast: int, slow: int, n: int) -> list[Stage]:
    def roc(k: int) -> Column:
        return 100 * _div(F.col("close") - F.lag("close", k).over(series()), F.lag("close", k).over(series()))

    return [{"_coppock": roc(fast) + roc(slow)}, {f"COPC_{fast}_{slow}_{n}": wma("_coppock", n, slow)}]


def _aroon(n: int) -> list[Stage]:
    """Bars since the extreme of the last n + 1; of equal extremes the oldest counts."""
    w = series().rowsBetween(-n, 0)

    def since(x: str, best: Callable) -> Column:
        place = F.array_position(F.collect_list(x).over(w), best(x).over(w))
        return _full(n + 1, 100.0 * (place - 1) / n)

    down, up = since("low", F.min), since("high", F.max)
    return [{f"AROOND_{n}": down, f"AROONU_{n}": up}, {f"AROONOSC_{n}": F.col(f"AROONU_{n}") - F.col(f"AROOND_{n}")}]


def _linreg(n: int) -> list[Stage]:
    """Slope over the n closes before this bar."""
    return [{f"LR_{n}": F.when(F.col("rn") > n, F.regr_slope("close", F.col("rn").cast("double")).over(series().rowsBetween(-n, -1)))}]


def _ichimoku(a: int, b: int, c: int) -> list[Stage]:
    def mid(n: int) -> Column:
        return (roll("max", "high", n) + roll("min", "low", n)) / 2

    return [{"ITS": mid(a), "IKS": mid(b), "ISB": mid(c)}, {"ISA": (F.col("ITS") + F.col("IKS")) / 2}]


def _vortex(n: int) -> list[Stage]:
    plus = _div(roll("sum", "_vmp", n, 1), roll("sum", "_tr", n, 1))
    minus = _div(roll("sum", "_vmm", n, 1), roll("sum", "_tr", n, 1))
    return [{f"VTXP_{n}": plus, f"VTXM_{n}": minus}]


def _true_range() -> list[Stage]:
    return [{"TRUERANGE": F.col("_tr")}]


def _bbands(n: int, k: float) -> list[Stage]:
    mean, dev = roll("avg", "close", n), roll("pstd", "close", n)
    low, high = mean - k * dev, mean + k * dev
    tag = f"{n}_{k:g}"
    return [{f"BBL_{tag}": low, f"BBM_{tag}": mean, f"BBU_{tag}": high, f"BBB_{tag}": 100 * _div(high - low, mean), f"BBP_{tag}": _div(F.col("close") - low, high - low)}]


def _donchian(n: int) -> list[Stage]:
    low, high = roll("min", "low", n), roll("max", "high", n)
    return [{f"DCL_{n}": low, f"DCM_{n}": (low + high) / 2, f"DCU_{n}": high}]


def _obv() -> list[Stage]:
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(series())), F.lit(1.0)) * F.col("volume")
    return [{"_obv": step}, {"OBV": F.sum("_obv").over(series().rowsBetween(Window.unboundedPreceding, 0))}]


def _ad() -> list[Stage]:
    return [{"AD": F.sum("_mfv").over(series().rowsBetween(Window.unboundedPreceding, 0))}]


def _cmf(n: int) -> list[Stage]:
    return [{f"CMF_{n}": _div(roll("sum", "_mfv", n), roll("sum", "volume", n))}]


def _mfi(n: int) -> list[Stage]:
    up, down = roll("sum", "_mfup", n, 1), roll("sum", "_mfdown", n, 1)
    return [{f"MFI_{n}": 100 * _div(up, up + down)}]


def _volume_index(name: str, fits: Callable[[Column, Column], Column]) -> list[Stage]:
    """A running product from 1000 over the bars whose volume fits, as the exponential of summed logarithms."""
    before, old = F.lag("volume").over(series()), F.lag("close").over(series())
    step = F.when(F.coalesce(fits(F.col("volume"), before), F.lit(False)), F.log(F.try_divide(F.col("close"), old))).otherwise(0.0)
    return [{f"_{name}": step}, {name: 1000 * F.exp(F.sum(f"_{name}").over(series().rowsBetween(Window.unboundedPreceding, 0)))}]


def _pivots() -> list[Stage]:
    h, lo, c = (F.lag(x).over(series()) for x in ("high", "low", "close"))
    p = (h + lo + c) / 3
    return [{"PIVOT_S1": 2 * p - h, "PIVOT_S2": p - (h - lo), "PIVOT_S3": lo - 2 * (h - p), "PIVOT_P": p, "PIVOT_R1": 2 * p - lo, "PIVOT_R2": p + (h - lo), "PIVOT_R3": h + 2 * (p - lo)}]


def _zscore(n: int) -> list[Stage]:
    return [{f"ZSCORE_{n}": _div(F.col("close") - roll("avg", "close", n), roll("std", "close", n))}]


def _rsi_simple(n: int) -> list[Stage]:
    up, down = roll("avg", "_up", n, 1), roll("avg", "_down", n, 1)
    return [{f"RSI_SIMPLE_{n}": 100 * _div(up, up + down)}]


def _atr_simple(n: int) -> list[Stage]:
    return [{f"ATR_SIMPLE_{n}": roll("avg", "_tr", n, 1)}]


def _vwap() -> list[Stage]:
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    return [{"VWAP": _div(F.sum("_tpv").over(w), F.sum("volume").over(w))}]


def _volume_sma(n: int) -> list[Stage]:
    return [{f"VOLUME_SMA_{n}": roll("avg", "volume", n)}]


#: Families of window indicators: the registered parameter sets of each kernel.
FAMILIES: dict[str, list[tuple]] = {
    "overlap": [*((_sma, n) for n in (10, 20, 50, 100, 200)), *((_wma, n) for n in (10, 20)), *((_hma, n) for n in (9, 16)),
                *((_vwma, n) for n in (10, 20)), (_ichimoku, 9, 26, 52), (_pivots,)],
    "momentum": [(_stoch, 14, 3), (_stoch, 5, 3), (_stoch, 21, 5), (_willr, 14), (_willr, 28), (_cci, 14), (_cci, 20), (_roc, 10), (_roc, 20),
                 (_mom, 10), (_mom, 20), (_cmo, 14), (_cmo, 20), (_uo, 7, 14, 28), (_ao, 5, 34), (_kst,), (_coppock, 11, 14, 10), (_rsi_simple, 14)],
    "trend": [(_aroon, 14), (_aroon, 25), (_linreg, 14), (_linreg, 25), (_vortex, 14), (_zscore, 20), (_zscore, 50)],
    "volatility": [(_true_range,), (_bbands, 20, 2.0), (_bbands, 20, 2.5), (_bbands, 10, 1.5), (_donchian, 20), (_donchian, 50), (_atr_simple, 14)],
    "volume": [(_obv,), (_ad,), (_cmf, 20), (_cmf, 21), (_mfi, 14), (_mfi, 20), (_volume_index, "NVI", lambda v, b: v < b), (_volume_index, "PVI", lambda v, b: v > b), (_vwap,), (_volume_sma, 20)],
}


def _base(bars: DataFrame) -> DataFrame:
    before = {c: F.lag(c).over(series()) for c in ("high", "low", "close")}
    rows = bars.withColumns({"rn": F.row_number().over(series()), **{f"_p{c}": x for c, x in before.items()}})
    h, lo, c, pc = F.col("high"), F.col("low"), F.col("close"), F.col("_pclose")
    tp = (h + lo + c) / 3
    known = pc.isNotNull()
    return rows.withColumns({
        "_tp": tp, "_hl2": (h + lo) / 2, "_pv": c * F.col("volume"), "_tpv": tp * F.col("volume"),
        "_up": F.when(known, F.greatest(c - pc, F.lit(0.0))), "_down": F.when(known, F.greatest(pc - c, F.lit(0.0))),
        "_tr": F.when(known, F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc))), "_bp": F.when(known, c - F.least(lo, pc)),
        "_range": F.when(known, F.greatest(h, pc) - F.least(lo, pc)), "_vmp": F.abs(h - F.col("_plow")), "_vmm": F.abs(lo - F.col("_phigh")),
        "_mfv": F.coalesce(_div((c - lo) - (h - c), h - lo), F.lit(0.0)) * F.col("volume"),
        "_ptp": (F.col("_phigh") + F.col("_plow") + pc) / 3,
    }).withColumns({
        "_mfup": F.when(known, F.when(F.col("_tp") > F.col("_ptp"), F.col("_tp") * F.col("volume")).otherwise(0.0)),
        "_mfdown": F.when(known, F.when(F.col("_tp") < F.col("_ptp"), F.col("_tp") * F.col("volume")).otherwise(0.0)),
    })


def window_indicators(bars: DataFrame, *families: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, ts, columns of the bars to keep, one column per output) of the families, or of all."""
    levels: list[Stage] = []
    for family in families or tuple(FAMILIES):
        for make, *args in FAMILIES[family]:
            for i, stage in enumerate(make(*args)):
                if i == len(levels):
                    levels.append({})
                levels[i].update(stage)
    rows = _base(bars)
    for stage in levels:
        rows = rows.withColumns(stage)
    return rows.select("symbol", "ts", *keep, *(F.col(f"`{c}`") for stage in levels for c in stage if not c.startswith("_")))
