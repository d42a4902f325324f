"""Queries on bars: resampling, cleaning, selection, analytic windows, regimes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import bars as B
from ..operators import order_statistics as O
from ..session import shared_folder
from ..sources import bar_cache as BC
from ..sources.tables import daily_bars, event_bars, table
from ..streaming import bars as ST
from .base import DAILY, HOURLY, query

W = "OVER (PARTITION BY symbol ORDER BY ts"


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"""WITH {HOURLY}, r AS (
    SELECT *, close / lag(close) {W}) - 1 AS ret, avg(close) {W} ROWS 19 PRECEDING) AS mean20, row_number() {W}) AS rn FROM bars
), e AS (SELECT *, sum(ln(1 + coalesce(ret, 0))) {W}) AS lr FROM r),
d AS (SELECT *, exp(lr) AS equity, exp(lr) / exp(max(lr) {W})) - 1 AS dd FROM e)
SELECT symbol, count(*) AS n_bars, round(avg(ret), 6) AS mean_return, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe,
       round(min(dd), 6) AS max_drawdown, sum(CASE WHEN rn >= 20 AND close > mean20 THEN 1 ELSE 0 END)::BIGINT AS n_above_mean
FROM d GROUP BY symbol""")
def series_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, returns, moving average, compounded equity and drawdown by symbol."""
    rows = event_bars(spark, sf_dir).withColumn("ret", A.pct_change("close")).withColumn("mean20", F.avg("close").over(A.rows_back(20)))
    rows = rows.withColumn("rn", F.row_number().over(B.series())).withColumn("lr", F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(A.expanding()))
    rows = A.drawdowns(rows.withColumn("equity", F.exp("lr")), "equity")
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.avg("ret").alias("mean_return"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.count_if((F.col("rn") >= 20) & (F.col("close") > F.col("mean20"))).alias("n_above_mean"))
    return _rounded(out, "mean_return", "sharpe", "max_drawdown")


@query(f"WITH {HOURLY} SELECT symbol, ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 4) AS volume FROM bars")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(event_bars(spark, sf_dir), *B.OHLC, digits=8), "volume", digits=4)


@query(f"WITH {DAILY} SELECT symbol, ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 4) AS volume FROM bars")
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(daily_bars(spark, sf_dir), *B.OHLC, digits=8), "volume", digits=4)


@query(f"""WITH {HOURLY} SELECT symbol, date_trunc('day', ts) AS bin, round(first(open ORDER BY ts), 8) AS open, round(max(high), 8) AS high, round(min(low), 8) AS low,
    round(last(close ORDER BY ts), 8) AS close, round(sum(volume), 4) AS volume FROM bars GROUP BY 1, 2""")
def bars_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_rounded(B.resample(event_bars(spark, sf_dir), "day"), *B.OHLC, digits=8), "volume", digits=4)


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw text bars: some prices unreadable, zero or negative, some volumes negative, times repeated."""
    e = table(spark, sf_dir, "events")
    price = F.when(F.col("event_id") % 17 == 0, "bad").when(F.col("event_id") % 13 == 0, "-1").otherwise(F.col("value").cast("decimal(18,4)").cast("string"))
    return e.select(F.col("event_type").alias("Symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("TS"), price.alias("Open"), price.alias("High"), price.alias("Low"), price.alias("Close"),
                    (F.col("value") - 10).alias("Volume"), F.col("event_id"))


MESSY = """messy AS (
    SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, event_id,
           CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -1.0::DOUBLE ELSE CAST(CAST(value AS DECIMAL(18,4)) AS DOUBLE) END AS close,
           greatest(value - 10, 0.0) AS volume FROM events
), cleaned AS (SELECT * FROM messy WHERE close IS NOT NULL AND close > 0)"""


@query(f"WITH {MESSY} SELECT symbol, count(*) AS n, round(sum(close), 2) AS sum_close, round(sum(volume), 2) AS sum_volume FROM cleaned GROUP BY 1")
def bars_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.clean(B.canonical(_messy(spark, sf_dir)))
    return out.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("sum_close"), F.round(F.sum("volume"), 2).alias("sum_volume"))


@query("""WITH e AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, event_id AS seq, value AS close FROM events)
    SELECT symbol, ts, round(arg_min(close, seq), 6) AS first_close, round(arg_max(close, seq), 6) AS last_close FROM e GROUP BY 1, 2""")
def bars_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated times resolved both ways: keep the first and keep the last row."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("close"))
    first = B.dedup(e, "seq", "first").select("symbol", "ts", F.round("close", 6).alias("first_close"))
    return first.join(B.dedup(e, "seq", "last").select("symbol", "ts", F.round("close", 6).alias("last_close")), ["symbol", "ts"])


@query(f"""WITH {DAILY}, g AS (SELECT *, ts - lag(ts) {W}) AS gap FROM bars)
    SELECT symbol, count(*) AS n_rows, count(*) < 252 AS too_short, count(*) FILTER (gap > 10) AS n_gaps, coalesce(max(gap), 0)::BIGINT AS max_gap,
           count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS n_inconsistent,
           count(*) FILTER (least(open, high, low, close) <= 0) AS n_non_positive FROM g GROUP BY 1""")
def bars_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.validation_report(daily_bars(spark, sf_dir))


@query(f"""WITH {HOURLY}, r AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY CAST(ts AS DATE) DESC) AS d FROM bars)
    SELECT symbol, ts, round(close, 6) AS close FROM r WHERE d <= 5""")
def bars_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.last_days(event_bars(spark, sf_dir), 5).select("symbol", "ts", F.round("close", 6).alias("close"))


@query(f"""WITH {HOURLY} SELECT symbol, count(*) AS n_bars, round(sum(volume), 4) AS volume FROM bars
    WHERE strftime(ts + INTERVAL 330 MINUTE, '%H:%M:%S') BETWEEN '09:15:00' AND '15:30:00' GROUP BY 1""")
def bars_trading_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = B.trading_hours(event_bars(spark, sf_dir), "09:15:00", "15:30:00", "Asia/Kolkata")
    return kept.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.round(F.sum("volume"), 4).alias("volume"))


@query(f"""WITH {DAILY}, r AS (SELECT *, row_number() {W}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
    p AS (SELECT *, CASE WHEN rn <= floor(n * 0.67::DOUBLE) THEN 'train' WHEN rn <= floor(n * (0.67::DOUBLE + 0.165::DOUBLE)) THEN 'validation' ELSE 'holdout' END AS part FROM r)
    SELECT symbol, part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1, 2""")
def bars_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.split(daily_bars(spark, sf_dir)).groupBy("symbol", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {HOURLY} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM bars GROUP BY 1")
def bars_date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.date_ranges(event_bars(spark, sf_dir))


@query(f"""WITH {HOURLY}, grid AS (SELECT s.symbol, t.ts, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT ts FROM bars) t
        LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = t.ts
        WHERE CAST(t.ts AS DATE) BETWEEN (SELECT min(CAST(ts AS DATE)) FROM bars x WHERE x.symbol = s.symbol) AND (SELECT max(CAST(ts AS DATE)) FROM bars x WHERE x.symbol = s.symbol))
    SELECT symbol, ts, round(close, 6) AS close, round(last(close IGNORE NULLS) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS filled_2,
           round(first(close IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 6) AS back_3,
           round(coalesce(first(close IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last(close IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS filled_all
    FROM grid""")
def bars_aligned_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All symbols at all times, with bounded and unbounded fills of what is missing."""
    grid = B.calendar(event_bars(spark, sf_dir))
    return grid.select("symbol", "ts", F.round("close", 6).alias("close"), F.round(B.ffill("close", 2), 6).alias("filled_2"),
                       F.round(B.bfill("close", 3), 6).alias("back_3"), F.round(F.coalesce(B.bfill("close"), B.ffill("close")), 6).alias("filled_all"))


@query(f"""WITH {DAILY} SELECT symbol, ts, round(close - lag(close) {W}), 8) AS diff, round(close / lag(close) {W}) - 1, 6) AS ret_1,
    round(close / lag(close, 5) {W}) - 1, 6) AS ret_5, round(lead(close, 5) {W}) / close - 1, 6) AS fwd_5 FROM bars""")
def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir).select(
        "symbol", "ts", F.round(F.col("close") - F.lag("close").over(B.series()), 8).alias("diff"), F.round(A.pct_change("close"), 6).alias("ret_1"),
        F.round(A.pct_change("close", 5), 6).alias("ret_5"), F.round(A.forward_return("close", 5), 6).alias("fwd_5"))


@query(f"""WITH {DAILY} SELECT symbol, ts, CASE WHEN count(close) {W}) >= 20 THEN round((close - avg(close) {W})) / stddev_samp(close) {W}), 6) END AS z FROM bars""")
def expanding_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir).select("symbol", "ts", F.round(A.expanding_z("close"), 6).alias("z"))


@query(f"""WITH {DAILY}, h AS (SELECT symbol, ts, volume AS v, list(volume) {W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS held,
        list(volume) {W} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS prior FROM bars),
    c AS (SELECT *, len(list_filter(held, lambda y: y < v)) AS lt, len(list_filter(held, lambda y: y = v)) AS eq,
        len(list_filter(prior, lambda y: y < v)) AS plt, len(list_filter(prior, lambda y: y <= v)) AS ple FROM h)
    SELECT symbol, ts, CASE WHEN len(held) >= 252 THEN round((lt + (eq + 1) / 2.0::DOUBLE) / 252 * 100, 6) END AS pct_rank_252,
           round((plt + ple + CASE WHEN ple > plt THEN 1 ELSE 0 END)::DOUBLE / (2.0::DOUBLE * nullif(len(prior), 0)), 6) AS prior_pct FROM c""")
def volume_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = F.collect_list("volume").over(B.series().rowsBetween(-252, -1))
    rows = daily_bars(spark, sf_dir).withColumn("prior", prior)
    return rows.select("symbol", "ts", F.round(A.rolling_percent_rank("volume", 252), 6).alias("pct_rank_252"),
                       F.round(A.percentile_of(F.col("prior"), F.col("volume")), 6).alias("prior_pct"))


@query(f"""WITH {DAILY}, h AS (SELECT symbol, ts, volume, row_number() {W}) - 1 AS n, list(volume) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM bars),
    c AS (SELECT symbol, ts, n, coalesce(len(list_filter(prior, lambda y: y < volume)), 0) AS below, coalesce(len(list_filter(prior, lambda y: y = volume)), 0) AS equal FROM h)
    SELECT symbol, ts, n AS n_before, below, equal, CASE WHEN n >= 19 THEN round((2 * below + equal + CASE WHEN equal > 0 THEN 1 ELSE 0 END) / (2.0::DOUBLE * n) * 2 - 1, 6) END AS normalised FROM c""")
def expanding_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentile of each day's volume among all earlier days of its symbol, from the twentieth on, scaled to [-1, 1]."""
    rows = O.earlier_counts(daily_bars(spark, sf_dir).select("symbol", "ts", "volume"), "volume", ["symbol"], ["ts"])
    share = O.percentile_of_earlier(F.col("n_before"), F.col("below"), F.col("equal"))
    return rows.select("symbol", "ts", "n_before", "below", "equal", F.round(share * 2 - 1, 6).alias("normalised"))


@query("""WITH e AS (SELECT event_id, event_type, value, ts FROM events WHERE value IS NOT NULL),
    d AS (SELECT event_id, event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS n FROM e),
    c AS (SELECT a.event_id, a.n, count(b.n) FILTER (b.value < a.value) AS below, count(b.n) FILTER (b.value = a.value) AS equal FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND b.n < a.n GROUP BY 1, 2)
    SELECT event_id, n AS n_before, below, equal FROM c""")
def expanding_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many earlier events of its type have a smaller value, and an equal one, for each event."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "event_type", "ts", "value")
    return O.earlier_counts(events, "value", ["event_type"], ["ts"]).select("event_id", "n_before", "below", "equal")


@query(f"""WITH {HOURLY} SELECT symbol, ts, round(close, 6) AS close, round(volume, 4) AS volume FROM bars
    WHERE symbol IN ('click', 'view', 'absent') AND ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND close > 1""")
def cached_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two symbols and two weeks of a cache of hourly bars: symbols and times reach the source, the price does not."""
    path = f"{shared_folder(spark).rstrip('/')}/cache-{uuid.uuid4().hex}"
    BC.write_cache(event_bars(spark, sf_dir), path, "2024-02-01 00:00:00")
    BC.register(spark)
    rows = spark.read.format("bar_cache").option("path", path).option("maxAgeHours", 24).option("now", "2024-02-01 23:00:00").load()
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = rows.where(F.col("symbol").isin("click", "view", "absent") & (F.col("ts") >= t("2024-01-05 06:00:00")) & (F.col("ts") < t("2024-01-20 00:00:00")) & (F.col("close") > 1))
    return rows.select("symbol", "ts", F.round("close", 6).alias("close"), F.round("volume", 4).alias("volume"))


@query(f"""WITH {HOURLY} SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(close), 4) AS total FROM bars GROUP BY 1, 2""")
def cached_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream polls the cache while it is written in three pieces of time."""
    path = f"{shared_folder(spark).rstrip('/')}/cache-{uuid.uuid4().hex}"
    rows, days = event_bars(spark, sf_dir), (F.dayofmonth("ts") - 1) / 10
    BC.register(spark)
    run, out = f"{path}-run", None
    for i in range(3):
        BC.write_cache(rows.where(F.least(F.floor(days), F.lit(2)) == i), path, "2024-02-01 00:00:00", i)
        out = ST.drain(spark.readStream.format("bar_cache").option("path", path).load(), "", "append", run=run)
    return out.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query(f"""WITH {DAILY}, p AS (SELECT symbol, ts, close, max(close) {W}) AS peak FROM bars), d AS (SELECT *, (close - peak) / peak AS dd FROM p),
    c AS (SELECT *, dd < 0 AS below, CASE WHEN (dd < 0) = lag(dd < 0) {W}) THEN 0 ELSE 1 END AS ch FROM d), r AS (SELECT *, sum(ch) {W}) AS run FROM c),
    l AS (SELECT symbol, run, below, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT symbol, coalesce(max(n) FILTER (below), 0) AS longest, count(*) FILTER (below) AS n_runs FROM l GROUP BY 1)
    SELECT symbol, round(min(dd), 6) AS max_drawdown, round(avg(dd), 6) AS mean_drawdown, any_value(longest) AS longest, any_value(n_runs) AS n_runs FROM d JOIN m USING (symbol) GROUP BY symbol""")
def drawdown_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.drawdowns(daily_bars(spark, sf_dir).select("symbol", "ts", "close"), "close").withColumn("below", F.col("drawdown") < 0)
    runs = A.islands(rows, ["symbol"], ["ts"], "below").groupBy("symbol").agg(
        F.coalesce(F.max(F.when(F.col("below"), F.col("length"))), F.lit(0)).alias("longest"), F.count_if("below").alias("n_runs"))
    depth = rows.groupBy("symbol").agg(F.round(F.min("drawdown"), 6).alias("max_drawdown"), F.round(F.avg("drawdown"), 6).alias("mean_drawdown"))
    return depth.join(runs, "symbol")


@query(f"""WITH {DAILY}, r AS (SELECT symbol, ts, close / lag(close) {W}) - 1 AS ret FROM bars)
    SELECT symbol, ts, CASE WHEN count(ret) {W} ROWS 19 PRECEDING) >= 20 THEN round(avg(ret) {W} ROWS 19 PRECEDING) * 252 * 100, 4) END AS ann_return,
           CASE WHEN count(ret) {W} ROWS 19 PRECEDING) >= 20 THEN round(stddev_samp(ret) {W} ROWS 19 PRECEDING) * sqrt(252) * 100, 4) END AS ann_vol FROM r""")
def rolling_return_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_bars(spark, sf_dir).select("symbol", "ts", A.pct_change("close").alias("ret"))
    w = A.rows_back(20)
    full = F.count("ret").over(w) >= 20
    return rows.select("symbol", "ts", F.when(full, F.round(F.avg("ret").over(w) * 252 * 100, 4)).alias("ann_return"),
                       F.when(full, F.round(F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252.0)) * 100, 4)).alias("ann_vol"))


REGIMES = f"""{DAILY}, t AS (SELECT *, row_number() {W}) AS rn, lag(close) {W}) AS pc FROM bars),
    t1 AS (SELECT *, CASE WHEN rn > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM t),
    t2 AS (SELECT *, CASE WHEN rn > 20 THEN avg(tr) {W} ROWS 19 PRECEDING) END AS mean_tr, avg(close) {W} ROWS 19 PRECEDING) AS mean_close FROM t1),
    t3 AS (SELECT *, list_filter(list(mean_tr) {W} ROWS 251 PRECEDING), lambda y: y IS NOT NULL) AS held FROM t2),
    t4 AS (SELECT *, len(list_filter(held, lambda y: y <= mean_tr))::DOUBLE / nullif(len(held), 0) AS vol_pct, (close - mean_close) / mean_close AS distance FROM t3),
    regimes AS (SELECT symbol, ts, CASE WHEN rn <= 40 THEN 'unknown' WHEN vol_pct > 0.8 THEN 'volatile' WHEN distance > 0.02 THEN 'trending_up'
                            WHEN distance < -0.02 THEN 'trending_down' ELSE 'ranging' END AS regime, vol_pct FROM t4)"""


@query(f"WITH {REGIMES} SELECT symbol, ts, regime, round(vol_pct, 6) AS vol_pct FROM regimes")
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.simple_regimes(daily_bars(spark, sf_dir)).select("symbol", "ts", "regime", F.round("vol_pct", 6).alias("vol_pct"))


@query(f"""WITH {REGIMES}, c AS (SELECT *, lag(regime) {W}) AS before FROM regimes), x AS (SELECT *, sum(CASE WHEN before = regime THEN 0 ELSE 1 END) {W}) AS run FROM c),
    l AS (SELECT symbol, run, regime, count(*) AS n FROM x GROUP BY ALL)
    SELECT symbol, regime, count(*) AS n_runs, sum(n)::BIGINT AS n_bars, round(avg(n), 6) AS mean_run, max(n) AS longest FROM l GROUP BY 1, 2""")
def regime_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.islands(A.simple_regimes(daily_bars(spark, sf_dir)), ["symbol"], ["ts"], "regime")
    return runs.groupBy("symbol", "regime").agg(F.count("*").alias("n_runs"), F.sum("length").alias("n_bars"), F.round(F.avg("length"), 6).alias("mean_run"), F.max("length").alias("longest"))


@query(f"""WITH {REGIMES}, c AS (SELECT *, lag(regime) {W}) AS before FROM regimes)
    SELECT before AS from_state, regime AS to_state, count(*) AS n FROM c WHERE before <> regime GROUP BY 1, 2""")
def regime_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.transitions(A.simple_regimes(daily_bars(spark, sf_dir)).select("symbol", "ts", "regime"), "regime")
    return rows.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


