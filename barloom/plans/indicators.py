"""Queries on indicators: windows by family, recursive ones against recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as G
from ..functions.indicators import window_indicators
from ..functions.recursive import recursive_indicators
from ..sources.tables import daily_bars
from .base import DAILY, query, shown, shown_sql

P = "OVER (PARTITION BY symbol ORDER BY ts"

BASE = f"""{DAILY}, b0 AS (SELECT *, row_number() {P}) AS rn, lag(close) {P}) AS pc, lag(high) {P}) AS ph, lag(low) {P}) AS pl, (high + low + close) / 3 AS tp FROM bars),
    b1 AS (SELECT *, CASE WHEN rn > 1 THEN greatest(close - pc, 0.0) END AS up, CASE WHEN rn > 1 THEN greatest(pc - close, 0.0) END AS dn,
        CASE WHEN rn > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN rn > 1 THEN close - least(low, pc) END AS bp,
        CASE WHEN rn > 1 THEN greatest(high, pc) - least(low, pc) END AS rg, abs(high - pl) AS vmp, abs(low - ph) AS vmm, (ph + pl + pc) / 3 AS ptp,
        CASE WHEN high = low THEN 0.0 ELSE (2 * close - low - high) / (high - low) END * volume AS mfv FROM b0)"""


def _r(n: int) -> str:
    return f"{P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _agg(f: str, x: str, n: int, lead: int = 0) -> str:
    return f"(CASE WHEN rn >= {n + lead} THEN {f}({x}) {_r(n)} END)"


def _wma(x: str, n: int) -> str:
    return "((" + " + ".join(f"{n - k} * lag({x}, {k}) {P})" for k in range(n)) + f") / {n * (n + 1) / 2}::DOUBLE)"


def _select(cols: dict[str, str], rows: str) -> str:
    return (f"SELECT symbol, ts, {', '.join(f'{shown_sql(c)} AS {c}' for c in cols)} FROM (SELECT symbol, ts, "
            + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {rows})")


def _query(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    out = window_indicators(daily_bars(spark, sf_dir), family)
    return out.select("symbol", "ts", *(shown(F.col(f"`{c}`")).alias(c) for c in out.columns[2:]))


_mid = {n: f"(({_agg('max', 'high', n)} + {_agg('min', 'low', n)}) / 2)" for n in (9, 26, 52)}


@query(f"WITH {BASE}, h AS (SELECT *, 2 * {_wma('close', 4)} - {_wma('close', 9)} AS h9, 2 * {_wma('close', 8)} - {_wma('close', 16)} AS h16 FROM b1) " + _select({
    **{f"SMA_{n}": _agg("avg", "close", n) for n in (10, 20, 50, 100, 200)}, **{f"WMA_{n}": _wma("close", n) for n in (10, 20)},
    "HMA_9": _wma("h9", 3), "HMA_16": _wma("h16", 4),
    **{f"VWMA_{n}": f"{_agg('sum', 'close * volume', n)} / {_agg('sum', 'volume', n)}" for n in (10, 20)},
    "ITS": _mid[9], "IKS": _mid[26], "ISB": _mid[52], "ISA": f"(({_mid[9]} + {_mid[26]}) / 2)",
    "PIVOT_S1": "2 * ptp - ph", "PIVOT_S2": "ptp - (ph - pl)", "PIVOT_S3": "pl - 2 * (ph - ptp)", "PIVOT_P": "ptp", "PIVOT_R1": "2 * ptp - pl",
    "PIVOT_R2": "ptp + (ph - pl)", "PIVOT_R3": "ph + 2 * (ptp - pl)"}, "h"))
def indicators_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "overlap")


def _stoch(k: int) -> str:
    return f"(100 * (close - {_agg('min', 'low', k)}) / nullif({_agg('max', 'high', k)} - {_agg('min', 'low', k)}, 0))"


def _roc(n: int) -> str:
    return f"((close - lag(close, {n}) {P})) / lag(close, {n}) {P}))"


def _uo(n: int) -> str:
    return f"({_agg('sum', 'bp', n, 1)} / nullif({_agg('sum', 'rg', n, 1)}, 0))"


_kst = "(100 * (" + " + ".join(f"{i} * {_agg('avg', f'k{i}', m, n)}" for i, n, m in ((1, 10, 10), (2, 15, 10), (3, 20, 10), (4, 30, 15))) + "))"


@query(f"""WITH {BASE}, k AS (SELECT *, {', '.join(f'{_roc(n)} AS k{i}' for i, n in ((1, 10), (2, 15), (3, 20), (4, 30)))}, 100 * {_roc(11)} + 100 * {_roc(14)} AS cop,
        {', '.join(f'{_stoch(n)} AS s{n}' for n in (14, 5, 21))}, {', '.join(f"{_agg('avg', 'tp', n)} AS m{n}, list(tp) {_r(n)} AS l{n}" for n in (14, 20))} FROM b1),
    k2 AS (SELECT *, {_kst} AS kst FROM k) """ + _select({
    "STOCHk_14_3": "s14", "STOCHd_14_3": _agg("avg", "s14", 3, 13), "STOCHk_5_3": "s5", "STOCHd_5_3": _agg("avg", "s5", 3, 4), "STOCHk_21_5": "s21", "STOCHd_21_5": _agg("avg", "s21", 5, 20),
    **{f"WILLR_{n}": f"-100 * ({_agg('max', 'high', n)} - close) / nullif({_agg('max', 'high', n)} - {_agg('min', 'low', n)}, 0)" for n in (14, 28)},
    **{f"CCI_{n}": f"CASE WHEN rn >= {n} THEN (tp - m{n}) / nullif(0.015::DOUBLE * (list_sum(list_transform(l{n}, lambda x: abs(x - m{n}))) / {n}), 0) END" for n in (14, 20)},
    **{f"ROC_{n}": f"100 * {_roc(n)}" for n in (10, 20)}, **{f"MOM_{n}": f"close - lag(close, {n}) {P})" for n in (10, 20)},
    **{f"CMO_{n}": f"100 * ({_agg('sum', 'up', n, 1)} - {_agg('sum', 'dn', n, 1)}) / nullif({_agg('sum', 'up', n, 1)} + {_agg('sum', 'dn', n, 1)}, 0)" for n in (14, 20)},
    "UO_7_14_28": f"100 * (4 * {_uo(7)} + 2 * {_uo(14)} + {_uo(28)}) / 7", "AO_5_34": f"{_agg('avg', '(high + low) / 2', 5)} - {_agg('avg', '(high + low) / 2', 34)}",
    "KST": "kst", "KSTs": _agg("avg", "kst", 9, 44), "COPC_11_14_10": _wma("cop", 10),
    "RSI_SIMPLE_14": f"100 * {_agg('avg', 'up', 14, 1)} / nullif({_agg('avg', 'up', 14, 1)} + {_agg('avg', 'dn', 14, 1)}, 0)"}, "k2"))
def indicators_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "momentum")


def _aroon(x: str, f: str, n: int) -> str:
    w = f"{P} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN rn > {n} THEN 100.0::DOUBLE * (list_position(list({x}) {w}, {f}({x}) {w}) - 1) / {n} END)"


@query(f"WITH {BASE} " + _select({
    **{f"AROOND_{n}": _aroon("low", "min", n) for n in (14, 25)}, **{f"AROONU_{n}": _aroon("high", "max", n) for n in (14, 25)},
    **{f"AROONOSC_{n}": f"{_aroon('high', 'max', n)} - {_aroon('low', 'min', n)}" for n in (14, 25)},
    **{f"LR_{n}": f"CASE WHEN rn > {n} THEN regr_slope(close, rn) {P} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END" for n in (14, 25)},
    "VTXP_14": f"{_agg('sum', 'vmp', 14, 1)} / nullif({_agg('sum', 'tr', 14, 1)}, 0)", "VTXM_14": f"{_agg('sum', 'vmm', 14, 1)} / nullif({_agg('sum', 'tr', 14, 1)}, 0)",
    **{f"ZSCORE_{n}": f"(close - {_agg('avg', 'close', n)}) / nullif({_agg('stddev_samp', 'close', n)}, 0)" for n in (20, 50)}}, "b1"))
def indicators_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "trend")


def _bb(n: int, k: float) -> dict[str, str]:
    m, d, t = _agg("avg", "close", n), _agg("stddev_pop", "close", n), f"{n}_{k:g}"
    return {f'"BBL_{t}"': f"{m} - {k}::DOUBLE * {d}", f'"BBM_{t}"': m, f'"BBU_{t}"': f"{m} + {k}::DOUBLE * {d}", f'"BBB_{t}"': f"100 * 2 * {k}::DOUBLE * {d} / {m}",
            f'"BBP_{t}"': f"(close - ({m} - {k}::DOUBLE * {d})) / nullif(2 * {k}::DOUBLE * {d}, 0)"}


@query(f"WITH {BASE} " + _select({
    "TRUERANGE": "tr", **_bb(20, 2.0), **_bb(20, 2.5), **_bb(10, 1.5),
    **{f"DCL_{n}": _agg("min", "low", n) for n in (20, 50)}, **{f"DCM_{n}": f"({_agg('min', 'low', n)} + {_agg('max', 'high', n)}) / 2" for n in (20, 50)},
    **{f"DCU_{n}": _agg("max", "high", n) for n in (20, 50)}, "ATR_SIMPLE_14": _agg("avg", "tr", 14, 1)}, "b1"))
def indicators_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "volatility")


@query(f"""WITH {BASE}, v AS (SELECT *, coalesce(sign(close - pc), 1) * volume AS ob, tp * volume AS tpv, lag(volume) {P}) AS pv,
        CASE WHEN rn > 1 THEN CASE WHEN tp > ptp THEN tp * volume ELSE 0 END END AS mu, CASE WHEN rn > 1 THEN CASE WHEN tp < ptp THEN tp * volume ELSE 0 END END AS md FROM b1),
    x AS (SELECT *, CASE WHEN volume < pv THEN ln(close / pc) ELSE 0 END AS nv, CASE WHEN volume > pv THEN ln(close / pc) ELSE 0 END AS ps FROM v) """ + _select({
    "OBV": f"sum(ob) {P})", "AD": f"sum(mfv) {P})", **{f"CMF_{n}": f"{_agg('sum', 'mfv', n)} / {_agg('sum', 'volume', n)}" for n in (20, 21)},
    **{f"MFI_{n}": f"100 * {_agg('sum', 'mu', n, 1)} / nullif({_agg('sum', 'mu', n, 1)} + {_agg('sum', 'md', n, 1)}, 0)" for n in (14, 20)},
    "NVI": f"1000 * exp(sum(nv) {P}))", "PVI": f"1000 * exp(sum(ps) {P}))", "VWAP": f"sum(tpv) {P}) / sum(volume) {P})", "VOLUME_SMA_20": _agg("avg", "volume", 20)}, "x"))
def indicators_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "volume")


def _recursive(spark: SparkSession, sf_dir: str, family: str, *cols: str) -> DataFrame:
    out = recursive_indicators(daily_bars(spark, sf_dir), family)
    return out.select("symbol", "ts", *(shown(F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double"))).alias(c) for c in cols or out.columns[2:]))


ROWS = f"""{DAILY}, r0 AS (SELECT *, row_number() {P}) AS rn, lag(close) {P}) AS pc, lag(high) {P}) AS ph, lag(low) {P}) AS pl,
        lag(high, 2) {P}) AS ph2, lag(low, 2) {P}) AS pl2, (high + low + close) / 3 AS tp FROM bars),
    r1 AS (SELECT *, coalesce(close - pc, 0) AS d, CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
        CASE WHEN rn > 1 AND high - ph > pl - low AND high > ph THEN high - ph ELSE 0 END AS up, CASE WHEN rn > 1 AND pl - low > high - ph AND pl > low THEN pl - low ELSE 0 END AS dn,
        CASE WHEN high = low THEN 0.0 ELSE (2 * close - low - high) / (high - low) END * volume AS mfv FROM r0),
    s AS (SELECT *, sum(mfv) {P}) AS flow, {', '.join(f"avg(tr) {_r(n)} AS tr{n}" for n in (7, 10, 14, 20))},
        avg(up) {_r(20)} AS up_mean, avg(dn) {_r(20)} AS dn_mean,
        {', '.join(f"lag(close, {n}) {P}) AS c{n}, sum(abs(d)) {_r(n)} AS noise{n}" for n in (10, 20))} FROM r1)"""

States = dict[str, tuple[str, str]]


def fold(states: States, outputs: dict[str, str] | str, inner: str = "SELECT * FROM e") -> str:
    """SQL that goes through each symbol's bars in order.  A state has its value at the first bar, and its
    value at a later one from the bar's columns, the old states and, with an n before the name, the new states above it."""
    rows = f"SELECT s.*, {', '.join(f'e.{x}' for x in states)} FROM e JOIN s ON s.symbol = e.symbol AND s.rn = e.rn + 1"
    for x, (_, step) in states.items():
        rows = f"SELECT *, ({step})::DOUBLE AS n{x} FROM ({rows})"
    begin = ", ".join(f"({first})::DOUBLE AS {x}" for x, (first, _) in states.items())
    each = f"""e AS (SELECT symbol, rn, {begin} FROM s WHERE rn = 1 UNION ALL SELECT symbol, rn, {', '.join(f'n{x}' for x in states)} FROM ({rows})),
        f AS (SELECT * FROM s JOIN e USING (symbol, rn)), g AS ({inner.replace(' FROM e', ' FROM f')})"""
    return f"WITH RECURSIVE {ROWS}, {each} {outputs if isinstance(outputs, str) else _select(outputs, 'g')}"


def smoothed(name: str, x: str, n: int, start: int = 1, alpha: float | None = None, new: bool = False) -> States:
    """Smoothing that starts with the value of ``x`` at bar ``start``; ``x`` may be a new state."""
    a = f"({alpha or f'2.0::DOUBLE / {n + 1}'})"
    first = x if start == 1 and not new else "NULL"
    return {name: (first, f"CASE WHEN rn < {start} THEN NULL WHEN rn = {start} THEN {x} ELSE {a} * {x} + (1 - {a}) * {name} END")}


def _chain(n: int, k: int, x: str = "close") -> States:
    """The mean of the mean and so on, each from the first full value of the one before."""
    out: States = {}
    for i in range(1, k + 1):
        out |= smoothed(f"e{n}_{i}", x if i == 1 else f"ne{n}_{i - 1}", n, (i - 1) * (n - 1) + 1, new=i > 1)
    return out


def _from(rn: int, x: str) -> str:
    return f"CASE WHEN rn >= {rn} THEN {x} END"


def _t3(n: int, v: float = 0.7) -> str:
    weights = (-v ** 3, 3 * v ** 2 + 3 * v ** 3, -6 * v ** 2 - 3 * v - 3 * v ** 3, 1 + 3 * v + v ** 3 + 3 * v ** 2)
    return _from(6 * n - 5, " + ".join(f"{w!r}::DOUBLE * e{n}_{6 - i}" for i, w in enumerate(weights)))


def _kama(n: int) -> States:
    k = f"pow(coalesce(abs(close - c{n}) / nullif(noise{n}, 0), 0) * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2)"
    return {f"k{n}": ("NULL", f"CASE WHEN rn < {n} THEN NULL WHEN rn = {n} THEN close ELSE k{n} + {k} * (close - k{n}) END")}


def _atr(n: int) -> States:
    return {f"a{n}": ("NULL", f"CASE WHEN rn < {n} THEN NULL WHEN rn = {n} THEN tr{n} ELSE (a{n} * {n - 1} + tr) / {n} END")}


_SMOOTH = {n: smoothed(f"e{n}_1", "close", n) for n in (50, 100, 200)}


@query(fold({**_chain(5, 6), **_chain(10, 6), **_chain(20, 3), **_SMOOTH[50], **_SMOOTH[100], **_SMOOTH[200], **_kama(10), **_kama(20),
              **{x: y for n in (9, 21) for x, y in {f"num{n}": ("close", f"close + (1 - 2.0::DOUBLE / {n + 1}) * num{n}"), f"den{n}": ("1", f"1 + (1 - 2.0::DOUBLE / {n + 1}) * den{n}")}.items()}},
             {**{f"EMA_{n}": _from(n, f"e{n}_1") for n in (10, 20, 50, 100, 200)}, **{f"DEMA_{n}": _from(2 * n - 1, f"2 * e{n}_1 - e{n}_2") for n in (10, 20)},
              **{f"TEMA_{n}": _from(3 * n - 2, f"3 * e{n}_1 - 3 * e{n}_2 + e{n}_3") for n in (10, 20)}, **{f"T3_{n}": _t3(n) for n in (5, 10)},
              **{f"KAMA_{n}": f"k{n}" for n in (10, 20)}, **{f"EMA_ADJ_{n}": f"num{n} / den{n}" for n in (9, 21)}}))
def indicators_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recursive(spark, sf_dir, "smoothing")


_MACD = ((12, 26, 9), (8, 17, 9), (5, 35, 5))
_TSI = {**smoothed("t1", "d", 25, 2), **smoothed("t2", "nt1", 13, 26, new=True), **smoothed("u1", "abs(d)", 25, 2), **smoothed("u2", "nu1", 13, 26, new=True)}


@query(fold({**{x: y for n in (7, 14, 21) for x, y in {**smoothed(f"up{n}", "greatest(d, 0)", n, alpha=1 / n), **smoothed(f"dn{n}", "greatest(-d, 0)", n, alpha=1 / n)}.items()},
              **{x: y for n in sorted({n for m in _MACD for n in m[:2]}) for x, y in smoothed(f"m{n}", "close", n).items()},
              **{x: y for f, s, g in _MACD for x, y in smoothed(f"g{f}", f"(nm{f} - nm{s})", g, s, new=True).items()}, **_TSI},
             {**{f"RSI_{n}": _from(n, f"100 * up{n} / nullif(up{n} + dn{n}, 0)") for n in (7, 14, 21)},
              **{x: y for f, s, g in _MACD for x, y in {f"MACD_{f}_{s}_{g}": _from(s, f"m{f} - m{s}"), f"MACDh_{f}_{s}_{g}": _from(s + g - 1, f"m{f} - m{s} - g{f}"), f"MACDs_{f}_{s}_{g}": _from(s + g - 1, f"g{f}")}.items()},
              "TSI_13_25": _from(38, "100 * t2 / nullif(u2, 0)")}))
def indicators_oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recursive(spark, sf_dir, "oscillators")


@query(fold({"e10_1": _chain(10, 1)["e10_1"], **_SMOOTH[50], **_SMOOTH[100], **_SMOOTH[200], "e20_1": _chain(20, 1)["e20_1"]},
             {f"EMA_{n}": _from(n, f"e{n}_1") for n in (10, 20, 50, 100, 200)}))
def indicators_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recursive(spark, sf_dir, "smoothing", "EMA_10", "EMA_20", "EMA_50", "EMA_100", "EMA_200")


@query(fold({x: y for n in (7, 14, 21) for x, y in {**smoothed(f"up{n}", "greatest(d, 0)", n, alpha=1 / n), **smoothed(f"dn{n}", "greatest(-d, 0)", n, alpha=1 / n)}.items()},
             {f"RSI_{n}": _from(n, f"100 * up{n} / nullif(up{n} + dn{n}, 0)") for n in (7, 14, 21)}))
def indicators_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recursive(spark, sf_dir, "oscillators", "RSI_7", "RSI_14", "RSI_21")


@query(fold(_atr(14), {"ATR_14": "a14", "NATR_14": "100 * a14 / close"}))
def indicators_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recursive(spark, sf_dir, "ranges", "ATR_14", "NATR_14")


@query(fold({**_atr(14), **_atr(20), **_chain(9, 2, "(high - low)")},
             {**{f"ATR_{n}": f"a{n}" for n in (14, 20)}, **{f"NATR_{n}": f"100 * a{n} / close" for n in (14, 20)},
              **{f'"KC{x}_20_{k:g}"': f"mid20 {sign} {k if sign else 0}::DOUBLE * a20" if sign else "mid20" for k in (2.0, 1.5) for x, sign in (("L", "-"), ("M", ""), ("U", "+"))},
              "MASSI_9_25": f"CASE WHEN count(ratio) {_r(25)} = 25 THEN sum(ratio) {_r(25)} END"},
             f"SELECT *, {_from(17, 'e9_1 / nullif(e9_2, 0)')} AS ratio, {_agg('avg', 'tp', 20)} AS mid20 FROM e"))
def indicators_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recursive(spark, sf_dir, "ranges")


def _adx(n: int) -> States:
    out: States = {}
    for x, y in (("t", "tr"), ("p", "up"), ("m", "dn")):
        out |= smoothed(f"x{x}{n}", y, n, 2, alpha=1 / n)
    dx = f"(CASE WHEN rn > {n} THEN 100 * abs(nxp{n} / nullif(nxt{n}, 0) - nxm{n} / nullif(nxt{n}, 0)) / nullif(nxp{n} / nullif(nxt{n}, 0) + nxm{n} / nullif(nxt{n}, 0), 0) END)"
    out |= {f"dx{n}": ("NULL", dx), f"cx{n}": ("0", f"cx{n} + CASE WHEN ndx{n} IS NULL THEN 0 ELSE 1 END"),
            f"ax{n}": ("NULL", f"CASE WHEN ndx{n} IS NULL THEN ax{n} WHEN ax{n} IS NULL THEN ndx{n} ELSE {1 / n}::DOUBLE * ndx{n} + (1 - {1 / n}::DOUBLE) * ax{n} END")}
    return out


_SUPER = ((7, 3.0), (10, 2.0), (20, 3.0))
#: rise: 1 or 0; the stop before its test; whether it turns; then speed, stop and extreme.
_PSAR = {
    "rise0": ("1", "rise"), "trial": ("low", "CASE WHEN rise = 1 THEN least(sar + af * (best - sar), pl, coalesce(pl2, pl)) ELSE greatest(sar + af * (best - sar), ph, coalesce(ph2, ph)) END"),
    "turn": ("0", "CASE WHEN rise = 1 THEN (low < ntrial)::INT ELSE (high > ntrial)::INT END"), "rise": ("1", "CASE WHEN nturn = 1 THEN 1 - nrise0 ELSE nrise0 END"),
    "sar": ("low", "CASE WHEN nturn = 1 THEN best ELSE ntrial END"),
    "af": ("0.02", "CASE WHEN nturn = 1 THEN 0.02 WHEN nrise = 1 AND high > best OR nrise = 0 AND low < best THEN least(af + 0.02::DOUBLE, 0.2) ELSE af END"),
    "best": ("high", "CASE WHEN nturn = 1 THEN CASE WHEN nrise = 1 THEN high ELSE low END WHEN nrise = 1 THEN greatest(best, high) ELSE least(best, low) END"),
}


@query(fold({**_adx(14), **_adx(20), **_atr(7), **_atr(10), **_atr(20), **_PSAR},
             {**{x: y for n in (14, 20) for x, y in {f"ADX_{n}": f"CASE WHEN cx{n} >= {n} AND dx{n} IS NOT NULL THEN ax{n} END", f"DMP_{n}": _from(n + 1, f"100 * xp{n} / nullif(xt{n}, 0)"), f"DMN_{n}": _from(n + 1, f"100 * xm{n} / nullif(xt{n}, 0)")}.items()},
              **{x: y for n, k in _SUPER for x, y in {f"SUPERT_{n}_{k:g}": f"CASE WHEN coalesce(last_value(turn{n} IGNORE NULLS) {P}), 1) > 0 THEN low{n} ELSE high{n} END", f"SUPERTd_{n}_{k:g}": f"coalesce(last_value(turn{n} IGNORE NULLS) {P}), 1)::DOUBLE"}.items()},
              "PSARl": "sl", "PSARs": "ss", "PSARlf": f"(sl IS NOT NULL AND lag(sl) {P}) IS NULL)::INT::DOUBLE", "PSARsf": f"(ss IS NOT NULL AND lag(ss) {P}) IS NULL)::INT::DOUBLE"},
             f"SELECT *, {', '.join(f'CASE WHEN close > lag(high{n}) {P}) THEN 1 WHEN close < lag(low{n}) {P}) THEN -1 END AS turn{n}' for n, _ in _SUPER)} FROM (SELECT *, CASE WHEN rn > 1 AND rise = 1 THEN sar END AS sl, CASE WHEN rn > 1 AND rise = 0 THEN sar END AS ss, "
             + ", ".join(f"(high + low) / 2 + {k}::DOUBLE * a{n} AS high{n}, (high + low) / 2 - {k}::DOUBLE * a{n} AS low{n}" for n, k in _SUPER) + " FROM e)"))
def indicators_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recursive(spark, sf_dir, "direction")


@query(fold({**smoothed("f3", "flow", 3), **smoothed("f10", "flow", 10), **smoothed("i13", "(close - pc) * volume", 13, 2), **smoothed("i20", "(close - pc) * volume", 20, 2)},
             {"ADOSC_3_10": _from(10, "f3 - f10"), "EFI_13": _from(14, "i13"), "EFI_20": _from(21, "i20")}))
def indicators_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recursive(spark, sf_dir, "flows")


_BACK = "OVER (PARTITION BY symbol ORDER BY ts ROWS {} PRECEDING)"
_FULL = "count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS {} PRECEDING) = {}"
_REGISTERED = f"""r AS (SELECT symbol, ts, CASE WHEN {_FULL.format(4, 5)} THEN avg(close) {_BACK.format(4)} END AS sma_5, CASE WHEN {_FULL.format(19, 20)} THEN avg(close) {_BACK.format(19)} END AS sma_20,
        CASE WHEN {_FULL.format(19, 20)} THEN sum(close * volume) {_BACK.format(19)} / sum(volume) {_BACK.format(19)} END AS vwma_20,
        close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts) AS mom_5, close - lag(close, 20) OVER (PARTITION BY symbol ORDER BY ts) AS mom_20, (high + low) / 2 AS middle FROM bars)"""


def _registry() -> G.Registry:
    registry = G.standard()
    registry.register("middle", "own", lambda s: (s["high"] + s["low"]) / 2, ["high", "low"])
    return registry


@query(f"WITH {DAILY}, {_REGISTERED} SELECT symbol, ts, {', '.join(f'{shown_sql(c)} AS {c}' for c in ('sma_5', 'sma_20', 'vwma_20', 'mom_5', 'mom_20', 'middle'))} FROM r")
def indicators_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered definitions of three categories, one of them a user's, by a table function over daily bars."""
    rows = _registry().apply(daily_bars(spark, sf_dir), "overlap", "momentum", "own")
    return rows.select("symbol", "ts", *(shown(F.col(c)).alias(c) for c in ("sma_5", "sma_20", "vwma_20", "mom_5", "mom_20", "middle")))


@query(f"""WITH {DAILY}, n AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars), d(category, lacks) AS (VALUES ('overlap', 4), ('overlap', 19), ('overlap', 19), ('momentum', 5), ('momentum', 20), ('own', 0),
        ('volatility', 4), ('volatility', 19), ('volatility', 19), ('volatility', 19), ('volume', 19))
    SELECT category, count(*) AS n_definitions, sum(v) AS n_values FROM (SELECT category, lacks, row_number() OVER (PARTITION BY category ORDER BY lacks) AS k, (SELECT count(*) FROM n WHERE i > lacks) AS v FROM d) GROUP BY 1""")
def registered_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many registered definitions each category has, and how many values they give over daily bars."""
    registry = _registry()
    rows = registry.apply(daily_bars(spark, sf_dir))
    counts = rows.agg(*(F.count(n).alias(n) for n in registry.names()))
    listed = F.array(*(F.struct(F.lit(d.category).alias("category"), F.col(d.name).alias("n")) for d in registry.definitions.values()))
    return counts.select(F.explode(listed).alias("x")).groupBy("x.category").agg(F.count("*").alias("n_definitions"), F.sum("x.n").alias("n_values"))
