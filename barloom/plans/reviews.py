"""Queries on reviews of trades: ledgers, regimes, patterns, recommendations, patches, risk checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import costs as C
from ..operators import analytics as A
from ..operators import bars as B
from ..operators import reviews as R
from ..operators import temporal as J
from ..operators import trades as T
from ..sources.tables import daily_bars, table, trades
from .base import DAILY, TRADES, query, shown, shown_sql
from .indicators import P, fold, smoothed
from .trades import ORDER, SNAPSHOT, _with_snapshot

SI = "((l_orderkey % 17)::DOUBLE / 17 * 2 - 1)"


def _shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: shown(F.col(c)) for c in cols})


def _sql(cte: str, rows: str, plain: str, *cols: str) -> str:
    return f"{cte} SELECT {plain}, {', '.join(f'{shown_sql(c)} AS {c}' for c in cols)} FROM ({rows})"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).withColumn("si", (F.col("l_orderkey") % 17).cast("double") / 17 * 2 - 1)


@query(f"""WITH {TRADES} SELECT trade_id, player, symbol FROM trades WHERE symbol IN ('Brand#1', 'Brand#12', 'Brand#23', 'Brand#5') AND player IN (1, 2, 3) AND direction = 'LONG' AND net_pnl > 0
    AND exit_date BETWEEN DATE '1995-01-01' AND DATE '1998-06-30'""")
def trades_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades that meet several conditions at once."""
    rows = R.select_trades(trades(spark, sf_dir), "LONG", True, "1995-01-01", "1998-06-30", symbol=["Brand#1", "Brand#12", "Brand#23", "Brand#5"], player=[1, 2, 3])
    return rows.select("trade_id", "player", "symbol")


_LEDGER = """count(*) AS n_trades, count(*) FILTER (net_pnl > 0) AS winners, count(*) FILTER (NOT net_pnl > 0) AS losers, sum(gross_pnl) AS gross_pnl, sum(total_costs) AS total_costs, sum(net_pnl) AS net_pnl,
    avg(net_pnl) AS avg_pnl, max(net_pnl) AS best, min(net_pnl) AS worst, coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) AS won, coalesce(sum(net_pnl) FILTER (NOT net_pnl > 0), 0) AS lost,
    count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE * 100 AS win_rate"""
_SUMS = ("gross_pnl", "total_costs", "net_pnl", "avg_pnl", "best", "worst", "won", "lost", "win_rate")


@query(_sql(f"WITH {TRADES}", f"SELECT player, exit_date, {_LEDGER} FROM trades GROUP BY 1, 2", "player, exit_date, n_trades, winners, losers", *_SUMS))
def ledger_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.ledger(trades(spark, sf_dir), "player", "exit_date"), *_SUMS)


@query(_sql(f"WITH {TRADES}", f"SELECT player, {_LEDGER} FROM trades GROUP BY 1", "player, n_trades, winners, losers", *_SUMS))
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.ledger(trades(spark, sf_dir), "player"), *_SUMS)


_DAY = f"""WITH {TRADES}, l AS (SELECT player, exit_date, {_LEDGER} FROM trades GROUP BY 1, 2), d AS (SELECT *, CASE WHEN losers = 0 THEN won / 1.0 ELSE coalesce(won / nullif(abs(lost), 0), 0) END AS profit_factor,
    win_rate > 60 AND net_pnl > 0 AS good, win_rate < 35 AS bad FROM l)"""


@query(_sql(_DAY, """SELECT *, CASE WHEN good THEN 'trending' WHEN bad THEN 'choppy' ELSE 'mixed' END AS character, CASE WHEN good THEN 'good' WHEN bad THEN 'poor' ELSE 'mixed' END AS fit,
    array_to_string(list_filter([CASE WHEN win_rate < 40 THEN 'threshold_change' END, CASE WHEN profit_factor > 0 AND profit_factor < 1 THEN 'risk_param' END], lambda x: x IS NOT NULL), ',') AS changes FROM d""",
            "player, exit_date, character, fit, changes", "profit_factor", "net_pnl"))
def day_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's days: profit factor, character of the day, and what it calls for."""
    m = R.ledger(trades(spark, sf_dir), "player", "exit_date")
    m = R.opportunities(R.day_character(m.withColumn("profit_factor", R.profit_factor(F.col("won"), F.col("lost"), F.col("losers"), 1.0))))
    return _shown(m.select("player", "exit_date", "character", "fit", F.array_join("changes", ",").alias("changes"), "profit_factor", "net_pnl"), "profit_factor", "net_pnl")


@query(_sql(f"""WITH e AS (SELECT event_type, value - 50 AS net_pnl, CASE WHEN hour(ts) BETWEEN 9 AND 9 THEN 'morning_open' WHEN hour(ts) BETWEEN 10 AND 11 THEN 'mid_morning' WHEN hour(ts) BETWEEN 12 AND 13 THEN 'afternoon'
        WHEN hour(ts) BETWEEN 14 AND 15 THEN 'closing_hour' END AS cluster FROM events)""",
            "SELECT event_type, cluster, count(*) AS n, count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE AS win_rate, avg(net_pnl) AS avg_pnl FROM e WHERE cluster IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2", "event_type, cluster, n", "win_rate", "avg_pnl"))
def hour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results by cluster of hours."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") - 50).alias("net_pnl"), R.hour_cluster(F.hour("ts")).alias("cluster")).where("cluster IS NOT NULL")
    m = rows.groupBy("event_type", "cluster").agg(F.count("*").alias("n"), T.share(F.count_if(T.wins()), F.count("*")).alias("win_rate"), F.avg("net_pnl").alias("avg_pnl")).where("n >= 2")
    return _shown(m, "win_rate", "avg_pnl")


_K = {"ra": ("tr", "tr20"), "rp": ("up", "up_mean"), "rm": ("dn", "dn_mean")}
_DX = "(100 * abs(100 * nrp / (nra + 1e-10::DOUBLE) - 100 * nrm / (nra + 1e-10::DOUBLE)) / (100 * nrp / (nra + 1e-10::DOUBLE) + 100 * nrm / (nra + 1e-10::DOUBLE) + 1e-10::DOUBLE))"
_DETECTED = {**{k: ("NULL", f"CASE WHEN rn < 21 THEN NULL WHEN rn = 21 THEN {mean} ELSE ({k} * 19 + {x}) / 20 END") for k, (x, mean) in _K.items()},
             "dx": ("NULL", f"CASE WHEN rn >= 21 THEN {_DX} END"), "sdx": ("0", "CASE WHEN rn BETWEEN 21 AND 40 THEN sdx + ndx ELSE sdx END"),
             "adx": ("NULL", "CASE WHEN rn < 40 THEN NULL WHEN rn = 40 THEN nsdx / 20 ELSE (adx * 19 + ndx) / 20 END"), **smoothed("q20", "close", 20), **smoothed("q40", "close", 40)}
_INNER = f"""SELECT *, CASE WHEN rn <= 40 THEN 'unknown' WHEN vol_pct > 0.7 AND NOT coalesce(adx > 25, false) THEN 'volatile' WHEN adx > 25 AND slope > 0 THEN 'trending_up' WHEN adx > 25 AND slope < 0 THEN 'trending_down' ELSE 'ranging' END AS regime FROM (
    SELECT *, CASE WHEN rn >= 40 THEN len(list_filter(list(mean_tr) {P}), lambda y: y <= mean_tr))::DOUBLE / count(mean_tr) {P}) ELSE 0.5 END AS vol_pct FROM (
    SELECT *, q20 - lag(q20, 5) {P}) AS slope, CASE WHEN rn >= 21 THEN tr20 END AS mean_tr, least(1, abs(q20 - q40) / (avg(close) {P} ROWS 19 PRECEDING) + 1e-10::DOUBLE) * 20) AS size FROM e))"""
_FINAL = f"""SELECT symbol, ts, regime, duration, {', '.join(f'{shown_sql(c)} AS {c}' for c in ('adx', 'strength', 'vol_pct', 'confidence'))} FROM (
    SELECT symbol, ts, regime, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS duration, adx, CASE WHEN rn >= 20 THEN size * sign(coalesce(slope, 0)) END AS strength, vol_pct,
        CASE regime WHEN 'unknown' THEN 0 WHEN 'volatile' THEN vol_pct WHEN 'ranging' THEN coalesce(least(1, (25 - adx) / 25), 1) ELSE least(1, adx / 50) END AS confidence FROM (
    SELECT *, sum(ch) {P}) AS run FROM (SELECT *, CASE WHEN regime = lag(regime) {P}) THEN 0 ELSE 1 END AS ch FROM g)))"""


@query(fold(_DETECTED, _FINAL, _INNER))
def market_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime of every bar by directional index, slope and volatility, with its certainty and how long it has lasted."""
    out = A.detect_regimes(daily_bars(spark, sf_dir))
    null = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return out.select("symbol", "ts", "regime", "duration", *(shown(null(F.col(c))).alias(c) for c in ("adx", "strength", "vol_pct", "confidence")))


@query(fold({"x": ("0", "0")}, "SELECT regime, count(*) AS n FROM g GROUP BY 1", f"""SELECT *, CASE WHEN rn <= 40 THEN 'unknown' WHEN vol_pct > 0.7 THEN 'volatile' ELSE 'ranging' END AS regime FROM (
    SELECT *, CASE WHEN rn >= 40 THEN len(list_filter(list(mean_tr) {P}), lambda y: y <= mean_tr))::DOUBLE / count(mean_tr) {P}) ELSE 0.5 END AS vol_pct FROM (SELECT *, CASE WHEN rn >= 21 THEN tr20 END AS mean_tr FROM e))"""))
def market_regimes_unseeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each regime is found where the index never gets a value: nothing trends."""
    return A.detect_regimes(daily_bars(spark, sf_dir), seeded=False).groupBy("regime").agg(F.count("*").alias("n"))


_PERF = f"""WITH {TRADES}, b AS (SELECT symbol, ts, CASE WHEN close > lag(close) OVER w THEN 'up' WHEN close < lag(close) OVER w THEN 'down' ELSE 'flat' END AS regime FROM (WITH {DAILY} SELECT * FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    r AS (SELECT t.* EXCLUDE (regime), coalesce(b.regime, 'UNKNOWN') AS regime FROM trades t LEFT JOIN b ON t.symbol = b.symbol AND t.entry_date = b.ts),
    m AS (SELECT regime, count(*) AS n_trades, count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE AS win_rate, avg(net_pnl) AS avg_pnl, sum(net_pnl) AS total_pnl, coalesce(avg(net_pnl_pct) / nullif(stddev_pop(net_pnl_pct), 0), 0) * sqrt(252) AS sharpe,
        coalesce(count(*) FILTER (direction = 'LONG' AND net_pnl > 0) / nullif(count(*) FILTER (direction = 'LONG'), 0)::DOUBLE, 0) AS long_win_rate,
        coalesce(count(*) FILTER (direction = 'SHORT' AND net_pnl > 0) / nullif(count(*) FILTER (direction = 'SHORT'), 0)::DOUBLE, 0) AS short_win_rate FROM r GROUP BY 1),
    s AS (SELECT regime, count(*) / sum(count(*)) OVER ()::DOUBLE AS share_of_time FROM b GROUP BY 1)"""


def _up_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("close").over(B.series())
    return daily_bars(spark, sf_dir).select("symbol", "ts", F.when(F.col("close") > before, "up").when(F.col("close") < before, "down").otherwise("flat").alias("regime"))


@query(_sql(_PERF, """SELECT m.*, coalesce(share_of_time, 0) AS share_of_time, CASE WHEN n_trades < 10 THEN NULL WHEN win_rate > 0.55 THEN 'strong' WHEN win_rate < 0.45 THEN 'weak' ELSE 'even' END AS insight,
    CASE WHEN long_win_rate - short_win_rate > 0.15 THEN 'longs' WHEN long_win_rate - short_win_rate < -0.15 THEN 'shorts' END AS favours FROM m LEFT JOIN s USING (regime)""",
            "regime, n_trades, insight, favours", "win_rate", "avg_pnl", "total_pnl", "sharpe", "long_win_rate", "short_win_rate", "share_of_time"))
def regime_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by the direction of the entry day, and each direction's share of all days."""
    out = R.regime_performance(trades(spark, sf_dir), _up_down(spark, sf_dir))
    return _shown(out, "win_rate", "avg_pnl", "total_pnl", "sharpe", "long_win_rate", "short_win_rate", "share_of_time")


_NAMES = f"""WITH {TRADES}, t AS (SELECT *, abs({SI}) AS size, exit_date - entry_date AS days FROM trades),
    n AS (SELECT player, net_pnl, unnest([{{'name': CASE WHEN size >= 0.85 AND size < 1 THEN 'signal_strength_very_strong' WHEN size >= 0.7 AND size < 0.85 THEN 'signal_strength_strong' WHEN size >= 0.5 AND size < 0.7 THEN 'signal_strength_moderate'
            WHEN size >= 0.3 AND size < 0.5 THEN 'signal_strength_weak' END, 'f': 0}}, {{'name': 'holding_' || CASE WHEN days < 2 THEN '0-2' WHEN days < 5 THEN '2-5' WHEN days < 10 THEN '5-10' WHEN days < 30 THEN '10-30' ELSE '30+' END, 'f': 50}},
            {{'name': 'direction_' || lower(direction), 'f': 50}}, {{'name': 'exit_' || exit_reason, 'f': 30}}, {{'name': 'all', 'f': -1}}]) AS p FROM t),
    g AS (SELECT player, p.name AS name, p.f AS f, count(*) AS n, count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE AS win_rate, avg(net_pnl) AS avg_pnl FROM n WHERE p.name IS NOT NULL GROUP BY 1, 2, 3),
    x AS (SELECT *, max(win_rate) FILTER (f = -1) OVER (PARTITION BY player) AS total FROM g),
    found AS (SELECT player, name, n, win_rate, avg_pnl, CASE WHEN f = 0 THEN least(1, abs(win_rate - total) * 5) ELSE least(1, n / f::DOUBLE) END AS confidence FROM x WHERE f >= 0 AND n >= 10 AND (f > 0 OR abs(win_rate - total) > 0.05))"""


@query(_sql(_NAMES, "SELECT * FROM found", "player, name, n", "win_rate", "avg_pnl", "confidence"))
def trade_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of signal strength, holding period, direction and exit reason for each player."""
    return _shown(R.patterns(_scored(spark, sf_dir), "si", "player"), "win_rate", "avg_pnl", "confidence")


@query(_sql(f"""WITH {SNAPSHOT.replace('SELECT trade_id, net_pnl, (l_orderkey % 17)', 'SELECT trade_id, symbol, year(exit_date) AS year, net_pnl, (l_orderkey % 17)')},
    p AS (SELECT symbol, year, net_pnl > 0 AS won, x.name AS name, x.same AS same FROM (SELECT symbol, year, net_pnl, unnest([{{'name': 'combo_A_B', 'same': sign(a) = sign(b), 'ok': a * b <> 0}},
        {{'name': 'combo_A_C', 'same': sign(a) = sign(c), 'ok': a * c <> 0}}, {{'name': 'combo_B_C', 'same': sign(b) = sign(c), 'ok': b * c <> 0}}]) AS x FROM snap) WHERE x.ok),
    g AS (SELECT symbol, year, name, count(*) FILTER (won) AS w, count(*) FILTER (NOT won) AS l, count(*) FILTER (won AND same) / nullif(count(*) FILTER (won), 0)::DOUBLE AS wa,
        count(*) FILTER (NOT won AND same) / nullif(count(*) FILTER (NOT won), 0)::DOUBLE AS la FROM p GROUP BY 1, 2, 3)""",
    "SELECT symbol, year, name, CASE WHEN wa > la THEN 'aligned' ELSE 'divergent' END AS direction, w + l AS n, CASE WHEN wa > la THEN wa ELSE 1 - la END AS win_rate, least(1, abs(wa - la) * 3) AS confidence FROM g WHERE w >= 10 AND l >= 10 AND abs(wa - la) > 0.15",
    "symbol, year, name, direction, n", "win_rate", "confidence"))
def combination_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of indicators that tell winners from losers in a symbol's year."""
    rows = _with_snapshot(spark, sf_dir).select("symbol", F.year("exit_date").alias("year"), "net_pnl", "snapshot")
    return _shown(R.combination_patterns(rows, "symbol", "year"), "win_rate", "confidence")


@query(_sql(_NAMES, """SELECT player, coalesce(arg_max(e, place) FILTER (e IS NOT NULL), 0) AS entry_change, coalesce(max(st), 1) AS stop_factor, avg(confidence) AS confidence FROM (
    SELECT *, CASE WHEN confidence >= 0.5 AND name = 'signal_strength_very_strong' AND win_rate > 0.6 THEN 0.05::DOUBLE WHEN confidence >= 0.5 AND name = 'signal_strength_weak' AND win_rate < 0.4 THEN -0.05 END AS e,
        CASE WHEN confidence >= 0.5 AND name LIKE 'exit_stop%' AND avg_pnl < 0 THEN 0.9::DOUBLE END AS st FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY confidence DESC, name) AS place FROM found)) WHERE place <= 5 GROUP BY 1""",
            "player", "entry_change", "stop_factor", "confidence"))
def pattern_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the surest patterns advise for each player's thresholds."""
    return _shown(R.threshold_advice(R.patterns(_scored(spark, sf_dir), "si", "player"), "player"), "entry_change", "stop_factor", "confidence")


@query(f"""WITH {TRADES}, d AS (SELECT symbol, exit_date, sum(net_pnl) AS pnl FROM trades GROUP BY 1, 2), e AS (SELECT *, 100000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY exit_date) AS equity FROM d),
    f AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY symbol ORDER BY exit_date)) AS peak FROM e), w AS (SELECT symbol, max((peak - equity) / peak) AS dd FROM f GROUP BY 1),
    m AS (SELECT symbol, count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE AS wr, coalesce(avg(net_pnl_pct) / nullif(stddev_pop(net_pnl_pct), 0) * sqrt(252), 0) AS sharpe,
        CASE WHEN -sum(net_pnl) FILTER (NOT net_pnl > 0) > 0 THEN coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) / -sum(net_pnl) FILTER (NOT net_pnl > 0) ELSE 10 END AS pf FROM trades GROUP BY 1)
    SELECT symbol, array_to_string(list_filter([CASE WHEN wr < 0.4 THEN 'low_win_rate' WHEN wr > 0.6 THEN 'high_win_rate' END, CASE WHEN sharpe < 0.5 THEN 'low_sharpe' WHEN sharpe > 1.5 THEN 'high_sharpe' END, CASE WHEN dd > 0.2 THEN 'deep_drawdown' END,
        CASE WHEN pf < 1.2 THEN 'low_profit_factor' WHEN pf > 2 THEN 'high_profit_factor' END], lambda x: x IS NOT NULL), ',') AS notes, CASE WHEN dd > 0.2 THEN 0.85::DOUBLE ELSE 1 END AS stop_factor FROM m JOIN w USING (symbol)""")
def performance_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades(spark, sf_dir)
    m = T.metrics(rows, "symbol").join(T.max_drawdown(rows, "symbol"), "symbol")
    return R.performance_notes(m).select("symbol", F.array_join("notes", ",").alias("notes"), "stop_factor")


@query(f"""WITH {TRADES}, y AS (SELECT symbol, avg(net_pnl) FILTER (year(exit_date) < 1997) + 100 AS train, avg(net_pnl) FILTER (year(exit_date) >= 1997) + 100 AS hold, max(net_pnl) / 100 AS best FROM trades GROUP BY 1)
    SELECT symbol, CASE WHEN CASE WHEN train > 0 THEN (train - hold) / train ELSE 0 END > 0.3 THEN 'overfit' WHEN best > 0 AND (best - hold) / best > 0.2 THEN 'degraded' ELSE 'passed' END AS verdict FROM y WHERE train IS NOT NULL AND hold IS NOT NULL""")
def holdout_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's later years against its earlier ones."""
    late = F.year("exit_date") >= 1997
    m = trades(spark, sf_dir).groupBy("symbol").agg((F.avg(F.when(~late, F.col("net_pnl"))) + 100).alias("train"), (F.avg(F.when(late, F.col("net_pnl"))) + 100).alias("hold"), (F.max("net_pnl") / 100).alias("best"))
    return R.holdout_check(m.where("train IS NOT NULL AND hold IS NOT NULL"), "train", "hold", "best").select("symbol", "verdict")


def _table(rows: tuple) -> str:
    return "(VALUES " + ", ".join(f"('{m}', {o}, '{k}', '{n}', {c}::DOUBLE, {p}::DOUBLE)" for m, o, k, n, c, p in rows) + ") t(mistake, option, kind, name, change, confidence)"


_MISTAKES = f"""{TRADES}, b AS (SELECT *, count(*) OVER (PARTITION BY player, entry_date) AS busy FROM trades),
    x AS (SELECT player, net_pnl, list_filter([CASE WHEN net_pnl_pct <= -0.05 THEN 'late_exit' END, CASE WHEN exit_date - entry_date <= 2 AND exit_reason = 'signal' THEN 'early_exit' END,
        CASE WHEN busy >= 5 THEN 'overtrading' END], lambda z: z IS NOT NULL) AS f FROM b WHERE net_pnl < 0),
    m AS (SELECT player, unnest(CASE WHEN len(f) > 0 THEN f ELSE ['false_signal'] END) AS mistake, net_pnl FROM x)"""
_PRIORITY = "least(10, greatest(1, floor((5 + CASE WHEN abs(impact) > 10000 THEN 2 WHEN abs(impact) > 5000 THEN 1 ELSE 0 END + CASE WHEN n >= 10 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END) * confidence)))::INT"


def _mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(player, net_pnl, mistake) of losing trades; five entries of a player on a day are too many."""
    days = F.datediff("exit_date", "entry_date")
    all_ = trades(spark, sf_dir).select("player", "entry_date", "exit_date", "exit_reason", "net_pnl", "net_pnl_pct")
    busy = all_.groupBy("player", "entry_date").agg(F.count("*").alias("busy"))
    rows = all_.where("net_pnl < 0").join(busy, ["player", "entry_date"], "left")
    found = F.array_compact(F.array(F.when(F.col("net_pnl_pct") <= -0.05, F.lit("late_exit")), F.when((days <= 2) & (F.col("exit_reason") == "signal"), F.lit("early_exit")), F.when(F.col("busy") >= 5, F.lit("overtrading"))))
    return rows.select("player", "net_pnl", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("false_signal")))).alias("mistake"))


@query(f"""WITH {_MISTAKES}, g AS (SELECT mistake, count(*) AS n, sum(net_pnl) AS impact FROM m GROUP BY 1)
    SELECT mistake, option, kind, name, change, confidence, {_PRIORITY} AS priority FROM g JOIN {_table(R.PATCHES)} USING (mistake)""")
def patch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of the patches for the mistakes found in losing trades, with their priority."""
    counts = _mistakes(spark, sf_dir).groupBy("mistake").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("impact"))
    return R.candidate_patches(counts).select("mistake", "option", "kind", "name", "change", "confidence", "priority")


_BASE = (("threshold", "entry_threshold", 0.7), ("threshold", "exit_threshold", 0.3), ("threshold", "stop_loss_atr_mult", 2.0), ("weight", "CMF_20", 0.95), ("weight", "OBV", -0.2), ("weight", "RSI_14", 0.4), ("rule", "trend_filter", 0.0))


@query(f"""WITH {_MISTAKES}, g AS (SELECT player, mistake, count(*) AS n, sum(net_pnl) AS impact FROM m GROUP BY 1, 2),
    c AS (SELECT *, {_PRIORITY} AS priority FROM g JOIN {_table(R.PATCHES)} USING (mistake)), w AS (SELECT player, mistake, option FROM c QUALIFY row_number() OVER (PARTITION BY player ORDER BY priority DESC, mistake, option) = 1),
    h AS (SELECT player, kind, name, sum(change) AS change FROM c SEMI JOIN w USING (player, mistake, option) GROUP BY ALL),
    s AS (SELECT DISTINCT player, kind, name, value FROM trades, (VALUES {", ".join(f"('{k}', '{n}', {v}::DOUBLE)" for k, n, v in _BASE)}) b(kind, name, value)),
    a AS (SELECT player, kind, name, coalesce(value, 0) + coalesce(change, 0) AS v FROM s FULL JOIN h USING (player, kind, name))
    SELECT player, kind, name, round(CASE kind WHEN 'weight' THEN least(greatest(v, -1), 1) WHEN 'rule' THEN CASE WHEN v > 0 THEN 1 ELSE 0 END ELSE v END, 9)::DOUBLE AS value FROM a""")
def patched_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's strategy after the first patch for its own mistakes."""
    counts = _mistakes(spark, sf_dir).groupBy("player", "mistake").agg(F.count("*").alias("n"), F.sum("net_pnl").alias("impact"))
    found = R.candidate_patches(counts)
    first = found.withColumn("at", F.dense_rank().over(Window.partitionBy("player").orderBy(F.desc("priority"), "mistake", "option"))).where("at = 1")
    base = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.lit(v).alias("value")) for k, n, v in _BASE))
    strategies = trades(spark, sf_dir).select("player").distinct().select("player", F.explode(base).alias("x")).select("player", "x.*")
    return R.apply_changes(strategies, first, "player")


@query(f"""WITH {TRADES}, r AS (SELECT CASE WHEN exit_reason = 'signal' THEN 'ranging' WHEN exit_reason = 'stop_loss' THEN 'volatile' ELSE 'trending_down' END AS regime, sum(net_pnl) AS total FROM trades GROUP BY 1),
    w AS (SELECT * FROM r ORDER BY total, regime LIMIT 1)
    SELECT regime, option, kind, name, change, confidence, 7 AS priority, round(abs(total) * 0.2::DOUBLE, 4) AS gain FROM w JOIN {_table(R.REGIME_PATCHES)} ON mistake = regime WHERE total < 0""")
def worst_regime_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime that lost most, exit reasons standing for regimes, and the changes of its patch."""
    regime = F.when(F.col("exit_reason") == "signal", "ranging").when(F.col("exit_reason") == "stop_loss", "volatile").otherwise("trending_down")
    m = trades(spark, sf_dir).groupBy(regime.alias("regime")).agg(F.sum("net_pnl").alias("total_pnl"))
    return R.worst_regime_patch(m).withColumn("gain", F.round("gain", 4))


@query(f"""WITH {TRADES}, p AS (SELECT trade_id, quantity * entry_price AS size, entry_price * 0.05::DOUBLE * quantity AS risk FROM trades)
    SELECT trade_id, CASE WHEN size > 250000 * 0.2::DOUBLE THEN 'too_large' WHEN risk > 250000 * 0.006::DOUBLE * 1.1::DOUBLE THEN 'too_risky' ELSE 'ok' END AS "check" FROM p""")
def position_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as proposals with a stop five percent away, against a portfolio's limits."""
    stop = F.when(F.col("direction") == "LONG", F.col("entry_price") - F.col("entry_price") * 0.05).otherwise(F.col("entry_price") + F.col("entry_price") * 0.05)
    return R.position_check(trades(spark, sf_dir).withColumn("stop", stop), F.lit(250_000.0), 0.2, 0.006).select("trade_id", "check")


@query(_sql(f"""WITH {TRADES}, r AS (SELECT *, row_number() OVER (PARTITION BY player, symbol {ORDER}) AS rn, count(*) OVER d AS trades_today, sum(net_pnl) OVER d AS pnl_today FROM trades
        WINDOW d AS (PARTITION BY player, symbol, exit_date {ORDER} ROWS UNBOUNDED PRECEDING))""",
            f"SELECT player, symbol, trade_id, trades_today, 20 - trades_today AS trades_remaining, pnl_today, pnl_today + 5000 AS pnl_remaining, rn - coalesce(max(CASE WHEN net_pnl >= 0 THEN rn END) OVER (PARTITION BY player, symbol {ORDER} ROWS UNBOUNDED PRECEDING), 0) AS losses_in_a_row FROM r",
            "player, symbol, trade_id, trades_today, trades_remaining, losses_in_a_row", "pnl_today", "pnl_remaining"))
def risk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.risk_counters(trades(spark, sf_dir), "player", "symbol")
    return _shown(out.select("player", "symbol", "trade_id", "trades_today", "trades_remaining", "losses_in_a_row", "pnl_today", "pnl_remaining"), "pnl_today", "pnl_remaining")


@query(_sql(f"""WITH {TRADES}, d AS (SELECT player, exit_date, sum(net_pnl) AS pnl FROM trades GROUP BY 1, 2),
    w AS (SELECT *, sum(pnl) OVER (PARTITION BY player, date_trunc('week', exit_date) ORDER BY exit_date) AS week_pnl FROM d), h AS (SELECT *, CASE WHEN pnl < -2000 THEN 'daily' WHEN week_pnl < -5000 THEN 'weekly' END AS halt FROM w)""",
            "SELECT * FROM h WHERE halt IS NOT NULL", "player, exit_date, halt", "pnl", "week_pnl"))
def loss_halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a player's losses would stop trading."""
    return _shown(R.halts(trades(spark, sf_dir), "player"), "pnl", "week_pnl")


@query(_sql(f"WITH {SNAPSHOT}", "SELECT indicator, coalesce(sum(value) FILTER (net_pnl > 0), 0) AS win_sum, coalesce(sum(value) FILTER (NOT net_pnl > 0), 0) AS loss_sum, coalesce(sum(value) FILTER (net_pnl > 0), 0) - abs(coalesce(sum(value) FILTER (NOT net_pnl > 0), 0)) AS net FROM long GROUP BY 1",
            "indicator", "win_sum", "loss_sum", "net"))
def contribution_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_snapshot(spark, sf_dir).select("net_pnl", F.explode("snapshot").alias("indicator", "value"))
    return _shown(R.contribution_sums(rows), "win_sum", "loss_sum", "net")


@query(_sql(f"""WITH {SNAPSHOT}, d AS (SELECT long.*, direction, CASE indicator WHEN 'B' THEN -0.5::DOUBLE ELSE 0.5 END AS weight FROM long JOIN trades USING (trade_id)),
    r AS (SELECT *, rank() OVER (PARTITION BY indicator ORDER BY value) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY indicator ORDER BY net_pnl) + (count(*) OVER (PARTITION BY indicator, net_pnl) - 1) / 2.0::DOUBLE AS rp,
        row_number() OVER (PARTITION BY indicator ORDER BY exit_date, value, net_pnl) <= floor(count(*) OVER (PARTITION BY indicator) / 2) AS half FROM d),
    m AS (SELECT indicator, count(*) AS n, coalesce(corr(value, net_pnl), 0) AS pearson, coalesce(corr(rv, rp), 0) AS spearman,
        count(*) FILTER (CASE WHEN weight >= 0 THEN value > 0 AND net_pnl > 0 OR value < 0 AND net_pnl < 0 ELSE value < 0 AND net_pnl > 0 OR value > 0 AND net_pnl < 0 END) / count(*)::DOUBLE AS accuracy,
        CASE WHEN count(*) FILTER (value > 0.3) > 3 THEN avg(net_pnl) FILTER (value > 0.3) ELSE 0 END AS bullish, CASE WHEN count(*) FILTER (value < -0.3) > 3 THEN avg(net_pnl) FILTER (value < -0.3) ELSE 0 END AS bearish,
        CASE WHEN count(*) FILTER (direction = 'LONG') >= 5 THEN count(*) FILTER (direction = 'LONG' AND value > 0 AND net_pnl > 0) / count(*) FILTER (direction = 'LONG')::DOUBLE ELSE 0 END AS long_accuracy,
        CASE WHEN count(*) FILTER (direction <> 'LONG') >= 5 THEN count(*) FILTER (direction <> 'LONG' AND value < 0 AND net_pnl > 0) / count(*) FILTER (direction <> 'LONG')::DOUBLE ELSE 0 END AS short_accuracy,
        coalesce(corr(value, net_pnl) FILTER (half), 0) AS a, coalesce(corr(value, net_pnl) FILTER (NOT half), 0) AS b FROM r GROUP BY 1)""",
            "SELECT *, CASE WHEN a * b > 0 THEN least(abs(a), abs(b)) ELSE 0 END AS consistency FROM m", "indicator, n", "pearson", "spearman", "accuracy", "bullish", "bearish", "long_accuracy", "short_accuracy", "consistency"))
def indicator_trade_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_snapshot(spark, sf_dir).select(F.explode("snapshot").alias("indicator", "value"), "net_pnl", "direction", F.col("exit_date").alias("ts")).withColumn("weight", F.when(F.col("indicator") == "B", -0.5).otherwise(0.5))
    return _shown(R.trade_scores(rows), "pearson", "spearman", "accuracy", "bullish", "bearish", "long_accuracy", "short_accuracy", "consistency")


@query(_sql(f"WITH {TRADES}, m AS (SELECT symbol, avg(net_pnl) AS m, stddev_samp(net_pnl) AS s FROM trades GROUP BY 1)",
            "SELECT trade_id, symbol, CASE WHEN s > 0 THEN (net_pnl - m) / s ELSE net_pnl END AS net_pnl FROM trades JOIN m USING (symbol)", "trade_id, symbol", "net_pnl"))
def standardised_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.standardised(trades(spark, sf_dir).select("trade_id", "symbol", "net_pnl"), "net_pnl", "symbol"), "net_pnl")


@query(_sql(f"WITH {TRADES}, y AS (SELECT player, year(exit_date) AS run, sum(net_pnl) AS pnl FROM trades GROUP BY 1, 2), m AS (SELECT player, count(*) AS n_runs, arg_min(pnl, run) AS first, arg_max(pnl, run) AS last, max(pnl) AS best FROM y GROUP BY 1)",
            "SELECT *, CASE WHEN first = 0 THEN CASE WHEN last > 0 THEN 100 ELSE 0 END ELSE (last - first) / abs(first) * 100 END AS improvement FROM m", "player, n_runs", "first", "last", "best", "improvement"))
def run_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's years as runs."""
    m = trades(spark, sf_dir).groupBy("player", F.year("exit_date").alias("run")).agg(F.sum("net_pnl").alias("pnl"))
    return _shown(R.run_trend(m, "run", "pnl", "player"), "first", "last", "best", "improvement")


@query(_sql("WITH t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)",
            "SELECT event_type, floor((rn - 1) / 7)::INT AS bar, arg_min(value, rn) AS open, max(value) AS high, min(value) AS low, arg_max(value, rn) AS close, sum(value) AS volume, count(*) = 7 AS complete FROM t GROUP BY 1, 2",
            "event_type, bar, complete", "open", "high", "low", "close", "volume"))
def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of seven events each, the last one of a type perhaps partial."""
    return _shown(R.tick_bars(table(spark, sf_dir, "events"), 7, "value", "value", ["ts", "event_id"], "event_type"), "open", "high", "low", "close", "volume")


@query("""WITH d AS (SELECT doc_id, text, list_concat([1], list_filter(range(1, length(text) + 1), lambda i: i > 1 AND substr(text, i - 1, 1) = chr(10))) AS starts FROM documents WHERE text IS NOT NULL),
    o AS (SELECT doc_id, starts, unnest(range(1, greatest(length(text), 1) + 1, 2500)) AS place FROM d) SELECT doc_id, place::INT AS place, greatest(1, len(list_filter(starts, lambda s: s <= place)))::INT AS page FROM o""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page, here the line, on which each chunk of 2500 characters starts."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lengths = F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)
    ends = F.aggregate(lengths, F.array(F.lit(1)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    rows = docs.select("doc_id", F.slice(ends, 1, F.size(lengths)).alias("starts"), F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(2500))).alias("place"))
    return rows.select("doc_id", "place", R.page_of(F.col("place"), F.col("starts")).alias("page"))


@query(f"""WITH {TRADES}, {DAILY.replace('bars AS', 'b AS')}, o AS (SELECT trade_id, symbol, direction, quantity, entry_price FROM trades WHERE entry_date <= DATE '1998-01-01' AND exit_date > DATE '1998-01-01'),
    l AS (SELECT symbol, arg_max(close, ts) AS mark FROM b WHERE ts <= DATE '1998-01-01' GROUP BY 1)
    SELECT trade_id, {shown_sql('u')} AS unrealised FROM (SELECT trade_id, (mark - entry_price) * quantity * CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END AS u FROM o LEFT JOIN l USING (symbol))""")
def open_positions_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions open on a day, at the last close up to it."""
    day = F.lit("1998-01-01").cast("date")
    held = trades(spark, sf_dir).where((F.col("entry_date") <= day) & (F.col("exit_date") > day)).select("trade_id", "symbol", "direction", "quantity", "entry_price")
    marks = J.latest(daily_bars(spark, sf_dir).where(F.col("ts") <= day).select("symbol", "ts", F.col("close").alias("mark")), ["symbol"], "ts").select("symbol", "mark")
    gain = (F.col("mark") - F.col("entry_price")) * F.col("quantity") * F.when(F.col("direction") == "LONG", 1).otherwise(-1)
    return held.join(marks, "symbol", "left").select("trade_id", shown(gain).alias("unrealised"))


@query(_sql(f"WITH {DAILY}, h AS (SELECT symbol, ts, volume, list(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS held FROM bars)",
            "SELECT symbol, ts, CASE WHEN len(held) >= 5 THEN len(list_filter(held, lambda y: y < volume))::DOUBLE / len(held) ELSE 0.5 END AS pct FROM h", "symbol, ts", "pct"))
def recent_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the last twenty values that are smaller, from five values on, as a stream keeps it."""
    held = F.collect_list("volume").over(B.series().rowsBetween(-20, -1))
    pct = F.when(F.size(held) >= 5, F.size(F.filter(held, lambda y: y < F.col("volume"))).cast("double") / F.size(held)).otherwise(0.5)
    return daily_bars(spark, sf_dir).select("symbol", "ts", shown(pct).alias("pct"))


@query("""WITH n AS (SELECT DISTINCT p_brand || '_' || p_size AS name FROM part) SELECT name, CASE WHEN name IN ('Brand#1_5', 'Brand#1_7', 'Brand#23_10') THEN name WHEN name LIKE 'Brand#1\\_%' ESCAPE '\\' THEN 'Brand#1_5' WHEN name LIKE 'Brand#23\\_%' ESCAPE '\\' THEN 'Brand#23_10' END AS definition FROM n""")
def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered names for outputs: exact, or by the part before the underscore."""
    names = table(spark, sf_dir, "part").select(F.concat_ws("_", "p_brand", "p_size").alias("name")).distinct()
    return names.select("name", R.definition(F.col("name"), ["Brand#1_5", "Brand#1_7", "Brand#23_10"]).alias("definition"))


@query(_sql(f"""WITH {TRADES}, s AS (SELECT trade_id, {SI} AS si, CASE WHEN {SI} > 0 THEN 'long' ELSE 'short' END AS was, CASE l_linenumber % 3 WHEN 0 THEN 'hold' WHEN 1 THEN 'long' ELSE 'short' END AS now, (l_orderkey % 10) / 10.0::DOUBLE AS c, (l_orderkey % 7) / 7.0::DOUBLE AS o FROM trades)""",
            "SELECT trade_id, CASE WHEN was <> now AND now = 'hold' THEN 0 WHEN was <> now AND now = 'long' AND si < 0 THEN abs(si) WHEN was <> now AND now = 'short' AND si > 0 THEN -abs(si) ELSE si * least(c / greatest(o, 0.1::DOUBLE), 1.5) END AS si FROM s", "trade_id", "si"))
def signals_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals after a second opinion made from the trades' numbers."""
    rows, n = _scored(spark, sf_dir), F.col("l_linenumber") % 3
    si = R.adjusted_signal(F.col("si"), F.when(F.col("si") > 0, "long").otherwise("short"), F.when(n == 0, "hold").when(n == 1, "long").otherwise("short"), (F.col("l_orderkey") % 10) / 10.0, (F.col("l_orderkey") % 7) / 7.0)
    return rows.select("trade_id", shown(si).alias("si"))


@query(f"""WITH {DAILY} SELECT symbol, count(*) AS n, max(ts) AS last_ts, {shown_sql('max(close)')} AS best FROM bars WHERE ts <= DATE '1996-06-30' GROUP BY 1""")
def bars_up_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each series at a point in time."""
    rows = B.up_to(daily_bars(spark, sf_dir), "1996-06-30")
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), shown(F.max("close")).alias("best"))


@query("""WITH g AS (SELECT c_custkey AS rank, c_mktsegment AS dna_id, CASE WHEN c_acctbal > 0 THEN '{"a": ' || round(c_acctbal, 2) || '}' ELSE '{}' END AS genes FROM customer), k AS (SELECT * FROM g WHERE length(genes) > 2)
    SELECT dna_id, min(rank) AS rank, arg_min(genes, rank) AS genes FROM k GROUP BY 1""")
def best_known_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ranked entry with a genome that is not empty, for each segment of customers."""
    genes = F.when(F.col("c_acctbal") > 0, F.concat(F.lit('{"a": '), F.round("c_acctbal", 2).cast("string"), F.lit("}"))).otherwise("{}")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rank"), F.col("c_mktsegment").alias("dna_id"), genes.alias("genes")).where(F.length("genes") > 2)
    return J.top_per_group(rows, 1, [F.col("rank")], "dna_id").select("dna_id", "rank", "genes")


@query("""WITH a AS (SELECT user_id, event_id, event_type, ts FROM events WHERE event_type IN ('error', 'signup')), m AS (SELECT max(ts) AS now FROM events) SELECT user_id, event_id, event_type FROM a CROSS JOIN m WHERE ts >= now - INTERVAL 24 HOUR""")
def alerts_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts not older than a day when the table ends."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    alerts = e.where("event_type IN ('error', 'signup')").select("user_id", "event_id", "event_type", "ts")
    return B.alive(alerts, now, 24).select("user_id", "event_id", "event_type")


@query("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1)
    SELECT user_id, CASE kind WHEN 'signup' THEN 'requested' WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS state, n FROM s""")
def approval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their newest state, from an append-only log of events."""
    log = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase', 'error')")
    state = F.when(F.col("event_type") == "signup", "requested").when(F.col("event_type") == "purchase", "approved").otherwise("rejected")
    return log.groupBy("user_id").agg(F.max_by(state, F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))


@query(_sql(f"WITH {TRADES}, d AS (SELECT player, date_trunc('month', exit_date)::DATE AS month, exit_date, count(*) AS n, count(*) FILTER (net_pnl > 0) AS won, sum(net_pnl) AS pnl FROM trades GROUP BY ALL)",
            "SELECT player, month, sum(n)::BIGINT AS n_trades, sum(won) / sum(n)::DOUBLE AS win_rate, sum(pnl) AS net_pnl, count(*) AS n_days, count(*) FILTER (pnl > 0) AS good_days, max(pnl) AS best_day, min(pnl) AS worst_day FROM d GROUP BY 1, 2",
            "player, month, n_trades, n_days, good_days", "win_rate", "net_pnl", "best_day", "worst_day"))
def monthly_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.monthly_report(trades(spark, sf_dir), "player"), "win_rate", "net_pnl", "best_day", "worst_day")


@query(f"""WITH {TRADES}, c AS (SELECT player, regime, count(*) AS n FROM trades WHERE exit_date >= DATE '1998-01-01' GROUP BY 1, 2)
    SELECT player, regime, n, row_number() OVER (PARTITION BY player ORDER BY n DESC, regime)::INT AS place FROM c QUALIFY row_number() OVER (PARTITION BY player ORDER BY n DESC, regime) <= 3""")
def recent_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent regimes of each player's last trades."""
    return R.frequent(R.select_trades(trades(spark, sf_dir), since="1998-01-01"), "regime", 3, "player")


@query(_sql(f"""WITH {TRADES}, m AS (SELECT player, symbol, count(*) AS n_trades, count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE AS win_rate, sum(net_pnl) AS total_pnl FROM trades GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY total_pnl DESC, symbol) AS u, row_number() OVER (PARTITION BY player ORDER BY total_pnl, symbol) AS d FROM m),
        k AS (SELECT player, symbol, n_trades, win_rate, total_pnl, unnest(list_filter([CASE WHEN u <= 3 THEN 'best' END, CASE WHEN d <= 3 THEN 'worst' END, CASE WHEN n_trades >= 3 AND win_rate <= 0.2 THEN 'avoid' END,
            CASE WHEN n_trades >= 3 AND win_rate >= 0.7 THEN 'favour' END], lambda x: x IS NOT NULL)) AS kind FROM r)""", "SELECT * FROM k", "player, symbol, kind, n_trades", "win_rate", "total_pnl"))
def player_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols worth telling a player about."""
    return _shown(R.context(trades(spark, sf_dir), "symbol", "player"), "win_rate", "total_pnl")


@query(_sql(f"WITH {TRADES}, y AS (SELECT symbol, year(exit_date) AS version, count(*) AS n, count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE AS win_rate, avg(net_pnl) AS avg_pnl FROM trades GROUP BY 1, 2)",
            "SELECT symbol, version, sum(n) OVER w AS live_trades, sum(win_rate * n) OVER w / sum(n) OVER w::DOUBLE AS live_win_rate, sum(avg_pnl * n) OVER w / sum(n) OVER w::DOUBLE AS live_avg_pnl FROM y WINDOW w AS (PARTITION BY symbol ORDER BY version)",
            "symbol, version, live_trades::BIGINT AS live_trades", "live_win_rate", "live_avg_pnl"))
def strategy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as versions of a strategy, with its record so far."""
    m = trades(spark, sf_dir).groupBy("symbol", F.year("exit_date").alias("version")).agg(F.count("*").alias("n"), T.share(F.count_if(T.wins()), F.count("*")).alias("win_rate"), F.avg("net_pnl").alias("avg_pnl"))
    out = R.live_record(m, "version", "n", ["win_rate", "avg_pnl"], "symbol")
    return _shown(out.select("symbol", "version", "live_trades", "live_win_rate", "live_avg_pnl"), "live_win_rate", "live_avg_pnl")


@query(f"""WITH {TRADES}, x AS (SELECT player, net_pnl, CASE WHEN net_pnl_pct <= -0.05 THEN 'late_exit' WHEN exit_reason = 'stop_loss' THEN 'tight_stop' ELSE 'false_signal' END AS mistake FROM trades WHERE net_pnl < 0)
    SELECT player, mistake, count(*) AS n, {shown_sql('sum(net_pnl)')} AS impact, CASE WHEN mistake = 'tight_stop' THEN 'stops lie too near' ELSE replace(mistake, '_', ' ') || ' in ' || count(*) || ' trades' END AS text FROM x GROUP BY 1, 2""")
def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("net_pnl_pct") <= -0.05, "late_exit").when(F.col("exit_reason") == "stop_loss", "tight_stop").otherwise("false_signal")
    found = trades(spark, sf_dir).where("net_pnl < 0").select("player", "net_pnl", kind.alias("mistake"))
    return _shown(R.diagnosis(found, "player", told={"tight_stop": "stops lie too near"}), "impact")


@query(f"""WITH {TRADES}, f AS (SELECT trade_id, unnest(['entry', 'exit']) AS kind, direction, entry_price, quantity FROM trades), s AS (SELECT trade_id, kind, quantity, entry_price, CASE WHEN (direction = 'LONG') = (kind = 'entry') THEN 'BUY' ELSE 'SELL' END AS side FROM f)
    SELECT trade_id, kind, side, {shown_sql('p')} AS fill, {shown_sql('v')} AS value FROM (SELECT *, entry_price * CASE WHEN side = 'BUY' THEN 1.0005::DOUBLE ELSE 0.9995::DOUBLE END AS p, entry_price * CASE WHEN side = 'BUY' THEN 1.0005::DOUBLE ELSE 0.9995::DOUBLE END * quantity AS v FROM s)""")
def market_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market orders that enter and leave each trade, at the entry price with slippage against the order."""
    rows = trades(spark, sf_dir).select("trade_id", "direction", "entry_price", "quantity", F.explode(F.array(F.lit("entry"), F.lit("exit"))).alias("kind"))
    rows = rows.withColumn("side", F.when((F.col("direction") == "LONG") == (F.col("kind") == "entry"), "BUY").otherwise("SELL"))
    fill = C.fill_price(F.col("entry_price"), F.col("side"))
    return rows.select("trade_id", "kind", "side", shown(fill).alias("fill"), shown(fill * F.col("quantity")).alias("value"))


@query(f"""WITH {TRADES}, p AS (SELECT player, quantity * entry_price AS size, entry_price * 0.05::DOUBLE * quantity AS risk FROM trades)
    SELECT player, CASE WHEN size > 250000 * 0.2::DOUBLE THEN 'too_large' WHEN risk > 250000 * 0.006::DOUBLE * 1.1::DOUBLE THEN 'too_risky' ELSE 'ok' END AS reason, count(*) AS n, {shown_sql('sum(size)')} AS exposure FROM p GROUP BY 1, 2""")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why proposed trades are turned down, and their exposure."""
    stop = F.when(F.col("direction") == "LONG", F.col("entry_price") - F.col("entry_price") * 0.05).otherwise(F.col("entry_price") + F.col("entry_price") * 0.05)
    rows = R.position_check(trades(spark, sf_dir).withColumn("stop", stop), F.lit(250_000.0), 0.2, 0.006)
    return _shown(rows.groupBy("player", F.col("check").alias("reason")).agg(F.count("*").alias("n"), F.sum(F.col("quantity") * F.col("entry_price")).alias("exposure")), "exposure")
