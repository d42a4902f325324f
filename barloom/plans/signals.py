"""Queries on normalised indicators and the signals made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions.indicators import window_indicators
from ..operators import analytics as A
from ..operators import signals as S
from ..sources.tables import daily_bars
from .base import DAILY, query

WEIGHTS = {"n_rsi": 0.6, "n_roc": -0.3, "n_sma": 0.5, "n_volume": 0.2}
ENTER, LEAVE = 0.4, 0.15

P = "OVER (PARTITION BY symbol ORDER BY ts"


def _squash(z: str) -> str:
    return f"(CASE WHEN {z} IS NULL THEN 0.0::DOUBLE ELSE tanh(0.5::DOUBLE * least(greatest({z}, -3), 3)) END)"


def _z(x: str, upto: str = "CURRENT ROW") -> str:
    w = f"{P} ROWS BETWEEN UNBOUNDED PRECEDING AND {upto})"
    return f"(CASE WHEN count({x}) {w} >= 20 THEN ({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0) END)"


NORMAL = f"""{DAILY}, i0 AS (SELECT *, row_number() {P}) AS rn, lag(close) {P}) AS pc FROM bars),
    i1 AS (SELECT *, CASE WHEN rn > 1 THEN greatest(close - pc, 0.0) END AS up, CASE WHEN rn > 1 THEN greatest(pc - close, 0.0) END AS dn FROM i0),
    i2 AS (SELECT *, CASE WHEN rn >= 15 THEN 100 * avg(up) {P} ROWS 13 PRECEDING) / nullif(avg(up) {P} ROWS 13 PRECEDING) + avg(dn) {P} ROWS 13 PRECEDING), 0) END AS rsi,
        100 * (close - lag(close, 10) {P})) / lag(close, 10) {P}) AS roc, CASE WHEN rn >= 20 THEN avg(close) {P} ROWS 19 PRECEDING) END AS sma,
        list(volume) {P} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS prior FROM i1),
    i3 AS (SELECT *, (sma - close) / close AS far, len(list_filter(prior, lambda y: y < volume)) AS lt, len(list_filter(prior, lambda y: y <= volume)) AS le FROM i2),
    normal AS (SELECT symbol, ts, rn, close, CASE WHEN rsi IS NOT NULL THEN least(greatest((rsi - 50) / 50, -1), 1) END AS n_rsi, {_squash(_z('roc'))} AS n_roc, {_squash(_z('far'))} AS n_sma,
        CASE WHEN len(prior) >= 20 THEN (lt + le + CASE WHEN le > lt THEN 1 ELSE 0 END)::DOUBLE / (2.0::DOUBLE * len(prior)) * 2 - 1 END AS n_volume,
        {_squash(_z('roc', '1 PRECEDING'))} AS pit_roc FROM i3)"""
_SUM = " + ".join(f"coalesce({c}, 0) * {w}::DOUBLE" for c, w in WEIGHTS.items())
_SIZE = sum(map(abs, WEIGHTS.values()))
_KNOWN = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {abs(w)}::DOUBLE ELSE 0 END" for c, w in WEIGHTS.items())
SI = f"""{NORMAL}, si AS (SELECT *, tanh(1.5::DOUBLE * (({_SUM}) / {_SIZE}::DOUBLE)) AS si, tanh(1.5::DOUBLE * coalesce(({_SUM}) / nullif({_KNOWN}, 0), 0)) AS si_known,
        ({_SUM}) / {_SIZE}::DOUBLE AS si_raw FROM normal)"""


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with four indicators, each normalised by the method that fits it."""
    rows = window_indicators(daily_bars(spark, sf_dir), "momentum", "overlap", keep=("close", "volume"))
    rows = rows.select("symbol", "ts", "close", "volume", "RSI_SIMPLE_14", "ROC_10", "SMA_20")
    return rows.select(
        "symbol", "ts", "close", N.bounded(F.col("RSI_SIMPLE_14"), 0, 100).alias("n_rsi"), N.adaptive(F.col("ROC_10")).alias("n_roc"),
        N.price_relative(F.col("SMA_20"), F.col("close")).alias("n_sma"), N.percentile(F.col("volume")).alias("n_volume"), N.point_in_time(F.col("ROC_10")).alias("pit_roc"))


def super_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal(spark, sf_dir).withColumns({"si": N.combine(WEIGHTS), "si_known": N.combine(WEIGHTS, known_only=True), "si_raw": N.combine(WEIGHTS, sharpen=None)})


@query(f"WITH {NORMAL} SELECT symbol, ts, round(n_rsi, 6) AS n_rsi, round(n_roc, 6) AS n_roc, round(n_sma, 6) AS n_sma, round(n_volume, 6) AS n_volume, round(pit_roc, 6) AS pit_roc FROM normal")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal(spark, sf_dir).select("symbol", "ts", *(F.round(c, 6).alias(c) for c in ("n_rsi", "n_roc", "n_sma", "n_volume", "pit_roc")))


@query(f"""WITH {SI} SELECT symbol, ts, round(si, 6) AS si, round(si_known, 6) AS si_known, round(si_raw, 6) AS si_raw,
    CASE WHEN si > 0.3 THEN 'LONG' WHEN si < -0.3 THEN 'SHORT' ELSE 'NEUTRAL' END AS direction,
    CASE WHEN abs(si) > 0.7 THEN 'STRONG' WHEN abs(si) > 0.4 THEN 'MODERATE' ELSE 'WEAK' END AS strength, round(least(abs(si) / 0.7::DOUBLE, 1), 6) AS confidence FROM si""")
def super_indicator_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    si = F.col("si")
    return super_indicator(spark, sf_dir).select(
        "symbol", "ts", *(F.round(c, 6).alias(c) for c in ("si", "si_known", "si_raw")), N.direction(si).alias("direction"),
        N.strength(si).alias("strength"), F.round(N.confidence(si), 6).alias("confidence"))


@query(f"""WITH {SI}, c AS (SELECT symbol, ts, si, lag(si) {P}) AS p FROM si)
    SELECT symbol, ts, round(si, 6) AS si, CASE WHEN si > 0.4 THEN 'up' ELSE 'down' END AS crossing FROM c WHERE (si > 0.4 AND p <= 0.4) OR (si <= 0.4 AND p > 0.4)""")
def signal_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.crossings(super_indicator(spark, sf_dir), "si", ENTER).select("symbol", "ts", F.round("si", 6).alias("si"), "crossing")


def _next(si: str, p: str, held: str, values: tuple) -> str:
    long_in, short_in, long_out, short_out, hold = values
    return f"""CASE WHEN {held} = 0 AND {si} > {ENTER} AND {p} <= {ENTER} THEN {long_in} WHEN {held} = 0 AND {si} < -{ENTER} AND {p} >= -{ENTER} THEN {short_in}
        WHEN {held} = 1 AND {si} < {LEAVE} THEN {long_out} WHEN {held} = -1 AND {si} > -{LEAVE} THEN {short_out} ELSE {hold} END"""


STATES = f"""{SI}, s AS (SELECT symbol, ts, rn, close, si, lag(si) {P}) AS p, lead(close, 5) {P}) / close - 1 AS fwd FROM si),
    m AS (SELECT symbol, ts, rn, si, fwd, 0 AS held, 'HOLD' AS signal_type FROM s WHERE rn = 1
        UNION ALL SELECT s.symbol, s.ts, s.rn, s.si, s.fwd, {_next('s.si', 's.p', 'm.held', ('1', '-1', '0', '0', 'm.held'))},
            {_next('s.si', 's.p', 'm.held', ("'LONG_ENTRY'", "'SHORT_ENTRY'", "'LONG_EXIT'", "'SHORT_EXIT'", "'HOLD'"))}
        FROM m JOIN s ON s.symbol = m.symbol AND s.rn = m.rn + 1)"""


@query(f"WITH RECURSIVE {STATES} SELECT symbol, ts, round(si, 6) AS si, signal_type, round(abs(si), 6) AS confidence FROM m")
def signal_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.positions(super_indicator(spark, sf_dir), enter=ENTER, leave=LEAVE)
    return out.select("symbol", "ts", F.round("si", 6).alias("si"), "signal_type", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH RECURSIVE {STATES}, f AS (SELECT *, CASE WHEN signal_type LIKE '%ENTRY' AND abs(si) < 0.5 THEN 'HOLD' ELSE signal_type END AS kept FROM m)
    SELECT symbol, count(*) FILTER (kept LIKE '%ENTRY') AS total_signals, count(*) FILTER (kept = 'LONG_ENTRY') AS long_signals, count(*) FILTER (kept = 'SHORT_ENTRY') AS short_signals,
        round(coalesce(avg(fwd) FILTER (kept = 'LONG_ENTRY'), 0), 6) AS long_avg_return, round(coalesce(-avg(fwd) FILTER (kept = 'SHORT_ENTRY'), 0), 6) AS short_avg_return,
        round(coalesce(count(*) FILTER (kept = 'LONG_ENTRY' AND fwd > 0)::DOUBLE / nullif(count(*) FILTER (kept = 'LONG_ENTRY'), 0), 0), 6) AS long_win_rate,
        round(coalesce(count(*) FILTER (kept = 'SHORT_ENTRY' AND fwd < 0)::DOUBLE / nullif(count(*) FILTER (kept = 'SHORT_ENTRY'), 0), 0), 6) AS short_win_rate
    FROM f GROUP BY symbol""")
def signal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = super_indicator(spark, sf_dir)
    signals = S.confident(S.positions(rows, enter=ENTER, leave=LEAVE))
    forward = rows.select("symbol", "ts", A.forward_return("close", 5).alias("fwd"))
    out = S.quality(signals.join(forward, ["symbol", "ts"]), "fwd", "symbol")
    return out.withColumns({c: F.round(c, 6) for c in ("long_avg_return", "short_avg_return", "long_win_rate", "short_win_rate")})


_PARTS = " UNION ALL ".join(f"SELECT symbol, ts, '{c}' AS indicator, coalesce({c}, 0) * {w}::DOUBLE AS contribution FROM normal" for c, w in WEIGHTS.items())


@query(f"""WITH {NORMAL}, parts AS ({_PARTS}), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY abs(contribution) DESC, indicator) AS rank FROM parts)
    SELECT symbol, ts, rank, indicator, round(contribution, 6) AS contribution FROM r WHERE rank <= 2""")
def signal_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.top_contributors(S.contributions(normal(spark, sf_dir), WEIGHTS, "symbol", "ts"), 2, "symbol", "ts")
    return out.select("symbol", "ts", F.col("rank").cast("long").alias("rank"), "indicator", F.round("contribution", 6).alias("contribution"))


@query(f"""WITH {SI}, a AS (SELECT symbol, ts, close, si, stddev_samp(close) {P} ROWS 19 PRECEDING) AS dev, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS last FROM si),
    l AS (SELECT *, CASE WHEN si > 0.3 THEN 1 WHEN si < -0.3 THEN -1 ELSE 0 END AS side FROM a WHERE last = 1)
    SELECT symbol, ts, side, round(CASE WHEN side <> 0 THEN close - side * 2 * dev END, 4) AS stop_price, round(CASE WHEN side <> 0 THEN close + side * 4 * dev END, 4) AS target_price FROM l""")
def signal_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = super_indicator(spark, sf_dir).withColumn("dev", F.stddev_samp("close").over(A.rows_back(20)))
    return S.live_signals(rows, "si", "dev").select("symbol", "ts", "side", F.round("stop_price", 4).alias("stop_price"), F.round("target_price", 4).alias("target_price"))
