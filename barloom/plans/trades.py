"""Queries on closed trades: metrics, groups, patterns, indicator scores, joins on time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs as C
from ..operators import analytics as A
from ..operators import temporal as J
from ..operators import trades as T
from ..sources.keyed_store import TRADE_ALIASES, KeyedStore
from ..sources.tables import daily_bars, event_bars, table, trades
from .base import DAILY, HOURLY, TRADES, query, shown, shown_sql

ORDER = "ORDER BY exit_date, entry_date, trade_id"


def _round(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


_METRICS = """count(*) AS total_trades, count(*) FILTER (net_pnl > 0) AS winning_trades, count(*) FILTER (NOT net_pnl > 0) AS losing_trades,
    round(sum(net_pnl), 4) AS net_profit, round(sum(gross_pnl), 4) AS gross_pnl, round(sum(total_costs), 4) AS total_costs,
    round(count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE, 6) AS win_rate,
    round(coalesce(count(*) FILTER (net_pnl > 0 AND direction = 'LONG') / nullif(count(*) FILTER (direction = 'LONG'), 0)::DOUBLE, 0), 6) AS long_win_rate,
    round(coalesce(count(*) FILTER (net_pnl > 0 AND direction = 'SHORT') / nullif(count(*) FILTER (direction = 'SHORT'), 0)::DOUBLE, 0), 6) AS short_win_rate,
    round(coalesce(avg(net_pnl) FILTER (net_pnl > 0), 0), 7) AS avg_win, round(coalesce(-avg(net_pnl) FILTER (NOT net_pnl > 0), 0), 7) AS avg_loss,
    round(coalesce(max(net_pnl) FILTER (net_pnl > 0), 0), 7) AS largest_win, round(coalesce(-min(net_pnl) FILTER (NOT net_pnl > 0), 0), 7) AS largest_loss,
    round(CASE WHEN -sum(net_pnl) FILTER (NOT net_pnl > 0) > 0 THEN coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) / -sum(net_pnl) FILTER (NOT net_pnl > 0) ELSE 10 END, 6) AS profit_factor,
    round(coalesce(coalesce(avg(net_pnl) FILTER (net_pnl > 0), 0) / nullif(coalesce(-avg(net_pnl) FILTER (NOT net_pnl > 0), 0), 0), 0), 6) AS payoff_ratio,
    round(avg(net_pnl), 7) AS avg_trade, round(avg(exit_date - entry_date), 7) AS avg_days, round(coalesce(avg(exit_date - entry_date) FILTER (net_pnl > 0), 0), 7) AS avg_winner_days,
    round(coalesce(avg(net_pnl_pct) / nullif(stddev_pop(net_pnl_pct), 0) * sqrt(252), 0), 6) AS sharpe"""
_SHOWN = {4: ("net_profit", "gross_pnl", "total_costs"), 7: ("avg_win", "avg_loss", "largest_win", "largest_loss", "avg_trade", "avg_days", "avg_winner_days"),
          6: ("win_rate", "long_win_rate", "short_win_rate", "profit_factor", "payoff_ratio", "sharpe")}


def _metrics(df: DataFrame, *keys: str) -> DataFrame:
    m = T.metrics(df, *keys)
    for digits, cols in _SHOWN.items():
        m = _round(m, digits, *cols)
    return m.select(*keys, "total_trades", "winning_trades", "losing_trades", *(c for cols in _SHOWN.values() for c in cols))


@query(f"WITH {TRADES} SELECT player, {_METRICS} FROM trades GROUP BY player")
def trade_metrics_by_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(trades(spark, sf_dir), "player")


@query(f"WITH {TRADES} SELECT regime, {_METRICS} FROM trades GROUP BY regime")
def trade_metrics_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(trades(spark, sf_dir), "regime")


@query(f"WITH {TRADES} SELECT {_METRICS} FROM trades")
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(trades(spark, sf_dir))


def _groups_sql(by: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    return f"""WITH {TRADES} SELECT {k}{by}, count(*) AS n, round(count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE, 6) AS win_rate, round(sum(net_pnl), 4) AS total_pnl,
        round(avg(net_pnl), 7) AS avg_pnl, round(count(*) / sum(count(*)) {over}::DOUBLE, 6) AS share_of_all FROM trades GROUP BY {k}{by}"""


def _groups(spark: SparkSession, sf_dir: str, by: str, *keys: str) -> DataFrame:
    return _round(_round(_round(T.groups(trades(spark, sf_dir), by, *keys), 6, "win_rate", "share_of_all"), 4, "total_pnl"), 7, "avg_pnl")


@query(_groups_sql("exit_reason", "player"))
def trades_by_exit_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, "exit_reason", "player")


@query(_groups_sql("symbol", "player"))
def trades_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, "symbol", "player")


@query(_groups_sql("direction", "regime"))
def trades_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, "direction", "regime")


@query(f"""WITH {TRADES}, c AS (SELECT player, symbol, net_pnl > 0 AS won, exit_date, entry_date, trade_id,
        CASE WHEN lag(net_pnl > 0) OVER (PARTITION BY player, symbol {ORDER}) = (net_pnl > 0) THEN 0 ELSE 1 END AS ch FROM trades),
    r AS (SELECT *, sum(ch) OVER (PARTITION BY player, symbol {ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM c), l AS (SELECT player, symbol, run, won, count(*) AS n FROM r GROUP BY ALL)
    SELECT player, symbol, coalesce(max(n) FILTER (won), 0) AS max_wins, coalesce(max(n) FILTER (NOT won), 0) AS max_losses FROM l GROUP BY 1, 2""")
def trade_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.streaks(trades(spark, sf_dir), "player", "symbol")


@query(f"""WITH {TRADES}, w AS (SELECT player, symbol, trade_id, exit_date, row_number() OVER o AS trade_num, avg((net_pnl > 0)::INT) OVER l AS win_rate,
        sum(net_pnl) OVER s AS cumulative_pnl, sum(net_pnl) OVER l AS rolling_pnl, avg(net_pnl) OVER l AS rolling_avg FROM trades
        WINDOW o AS (PARTITION BY player, symbol {ORDER}), l AS (PARTITION BY player, symbol {ORDER} ROWS 29 PRECEDING), s AS (PARTITION BY player, symbol {ORDER} ROWS UNBOUNDED PRECEDING))
    SELECT player, symbol, trade_id, exit_date, trade_num::INT AS trade_num, round(win_rate, 6) AS win_rate, round(cumulative_pnl, 4) AS cumulative_pnl, round(rolling_pnl, 4) AS rolling_pnl,
        round(rolling_avg, 6) AS rolling_avg FROM w WHERE trade_num >= 30""")
def trade_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_round(_round(T.rolling(trades(spark, sf_dir), 30, "player", "symbol"), 6, "win_rate"), 4, "cumulative_pnl", "rolling_pnl"), 6, "rolling_avg")


_DRAWN = f"""{TRADES}, d AS (SELECT player, exit_date, sum(net_pnl) AS pnl FROM trades GROUP BY 1, 2), e AS (SELECT *, 100000 + sum(pnl) OVER (PARTITION BY player ORDER BY exit_date) AS equity FROM d),
    p AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY player ORDER BY exit_date)) AS peak FROM e),
    drawn AS (SELECT player, max(peak - equity) AS max_drawdown_abs, max((peak - equity) / peak) AS max_drawdown FROM p GROUP BY player)"""


@query(f"WITH {_DRAWN} SELECT player, round(max_drawdown_abs, 4) AS max_drawdown_abs, round(max_drawdown, 5) AS max_drawdown FROM drawn")
def trade_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_round(T.max_drawdown(trades(spark, sf_dir), "player"), 4, "max_drawdown_abs"), 5, "max_drawdown")


@query(f"""WITH {_DRAWN}, m AS (SELECT symbol, player, count(*) AS n, sum(net_pnl) AS profit, count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE AS wr,
        coalesce(avg(net_pnl_pct) / nullif(stddev_pop(net_pnl_pct), 0) * sqrt(252), 0) AS sharpe,
        CASE WHEN -sum(net_pnl) FILTER (NOT net_pnl > 0) > 0 THEN coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) / -sum(net_pnl) FILTER (NOT net_pnl > 0) ELSE 10 END AS pf FROM trades GROUP BY 1, 2),
    x AS (SELECT m.*, max_drawdown AS dd FROM m JOIN drawn USING (player)),
    s AS (SELECT *, (0.3::DOUBLE / (1 + exp(-profit / 10000)) + 0.25::DOUBLE * CASE WHEN sharpe < 0 THEN 0 ELSE 1 / (1 + exp(-(sharpe - 1) * 2)) END + 0.2::DOUBLE * greatest(0, 1 - dd)
        + 0.25::DOUBLE * (0.7::DOUBLE * CASE WHEN wr >= 0.7 THEN 1.0::DOUBLE WHEN wr >= 0.65 THEN 0.9::DOUBLE + (wr - 0.65::DOUBLE) * 2 WHEN wr >= 0.55 THEN 0.7::DOUBLE + (wr - 0.55::DOUBLE) * 2
            ELSE greatest(0, wr / 0.55::DOUBLE * 0.7::DOUBLE) END + 0.3::DOUBLE * CASE WHEN pf > 0 THEN least(1, pf / 2) ELSE 0 END))
        * CASE WHEN wr < 0.45 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN dd > 0.3 THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN sharpe < 0 THEN 0.4::DOUBLE ELSE 1 END * CASE WHEN n < 50 THEN 0.7::DOUBLE ELSE 1 END
        * CASE WHEN wr >= 0.7 THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN wr >= 0.65 AND sharpe >= 5 THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN profit >= 100000 AND wr >= 0.6 THEN 1.25::DOUBLE ELSE 1 END
        * CASE WHEN pf >= 2 THEN 1.15::DOUBLE ELSE 1 END AS f FROM x)
    SELECT player, symbol, n AS total_trades, round(CASE WHEN n < 30 THEN 0 ELSE greatest(0, f) END, 6) AS fitness FROM s""")
def strategy_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol of a player scored with the player's drawdown."""
    rows = trades(spark, sf_dir)
    drawn = T.max_drawdown(rows, "player").select("player", "max_drawdown")
    out = T.fitness(T.metrics(rows, "symbol", "player").join(drawn, "player"))
    return _round(out.select("player", "symbol", "total_trades", "fitness"), 6, "fitness")


@query(f"""WITH {TRADES}, b AS (SELECT player, CASE WHEN exit_date - entry_date < 2 THEN '0-2' WHEN exit_date - entry_date < 5 THEN '2-5' WHEN exit_date - entry_date < 10 THEN '5-10'
        WHEN exit_date - entry_date < 30 THEN '10-30' ELSE '30+' END AS bucket, net_pnl FROM trades),
    g AS (SELECT player, bucket, count(*) AS n, count(*) FILTER (net_pnl > 0) AS won, avg(net_pnl) AS avg_pnl FROM b GROUP BY 1, 2),
    e AS (SELECT *, won / n::DOUBLE AS win_rate, won / n::DOUBLE - sum(won) OVER (PARTITION BY player)::DOUBLE / sum(n) OVER (PARTITION BY player)::DOUBLE AS edge FROM g)
    SELECT player, bucket, n, round(avg_pnl, 7) AS avg_pnl, round(win_rate, 6) AS win_rate, round(edge, 6) AS edge, abs(edge) > 0.05 AS notable FROM e""")
def trade_holding_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.bucket_edges(trades(spark, sf_dir), T.holding_bucket(F.datediff("exit_date", "entry_date")), "player")
    return _round(_round(out, 7, "avg_pnl"), 6, "win_rate", "edge")


@query(f"WITH {TRADES} SELECT player, exit_date, count(*) AS n, round(sum(net_pnl), 4) AS total_pnl FROM trades GROUP BY 1, 2 HAVING count(*) >= 5")
def trade_overtrading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.overtrading(trades(spark, sf_dir), "exit_date", 5, "player"), 4, "total_pnl")


@query(f"""WITH {TRADES}, l AS (SELECT *, exit_date - entry_date AS days FROM trades WHERE net_pnl < 0),
    m AS (SELECT *, list_filter([CASE WHEN net_pnl_pct <= -0.05 THEN 'late_exit' END, CASE WHEN days <= 2 AND exit_reason = 'signal' THEN 'early_exit' END,
        CASE WHEN days <= 30 AND exit_reason = 'stop_loss' THEN 'tight_stop' END, CASE WHEN days > 365 THEN 'overstay' END], lambda x: x IS NOT NULL) AS found FROM l),
    e AS (SELECT trade_id, net_pnl, unnest(CASE WHEN len(found) > 0 THEN found ELSE ['false_signal'] END) AS mistake FROM m)
    SELECT mistake, count(*) AS n, round(sum(net_pnl), 4) AS total_pnl, min(trade_id) AS first_trade FROM e GROUP BY 1""")
def trade_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.mistakes(trades(spark, sf_dir))
    return out.groupBy("mistake").agg(F.count("*").alias("n"), F.round(F.sum("net_pnl"), 4).alias("total_pnl"), F.min("trade_id").alias("first_trade"))


@query(f"""WITH {TRADES}, r AS (SELECT player, symbol, net_pnl, row_number() OVER (PARTITION BY player, symbol ORDER BY exit_date DESC, entry_date DESC, trade_id DESC) AS r FROM trades),
    m AS (SELECT player, symbol, avg(net_pnl) FILTER (r <= 10) AS recent, avg(net_pnl) FILTER (r > 10) AS before FROM r WHERE r <= 20 GROUP BY 1, 2),
    c AS (SELECT *, (recent - before) / nullif(abs(before), 0) AS change FROM m)
    SELECT player, symbol, round(recent, 7) AS recent, round(before, 7) AS before, CASE WHEN change > 0.05 THEN 'improving' WHEN change < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM c""")
def trade_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.trend(trades(spark, sf_dir), 10, "player", "symbol"), 7, "recent", "before")


def _with_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with a map of indicator values that follows from their own fields."""
    scaled = lambda x, m: (x % m).cast("double") / m * 2 - 1
    q = F.col("l_orderkey")
    return trades(spark, sf_dir).withColumn("snapshot", F.create_map(
        F.lit("A"), scaled(q, 17), F.lit("B"), scaled(q * 3 + F.col("l_linenumber"), 23), F.lit("C"), scaled(q + F.col("l_linenumber") * 5, 31)))


SNAPSHOT = f"""{TRADES}, snap AS (SELECT trade_id, net_pnl, (l_orderkey % 17)::DOUBLE / 17 * 2 - 1 AS a, ((l_orderkey * 3 + l_linenumber) % 23)::DOUBLE / 23 * 2 - 1 AS b,
        ((l_orderkey + l_linenumber * 5) % 31)::DOUBLE / 31 * 2 - 1 AS c, exit_date FROM trades),
    long AS (SELECT trade_id, net_pnl, 'A' AS indicator, a AS value, exit_date FROM snap UNION ALL SELECT trade_id, net_pnl, 'B', b, exit_date FROM snap UNION ALL SELECT trade_id, net_pnl, 'C', c, exit_date FROM snap)"""


@query(f"""WITH {SNAPSHOT}, s AS (SELECT indicator, count(*) AS n, avg(value) FILTER (net_pnl > 0) AS w, stddev_pop(value) FILTER (net_pnl > 0) AS ws, avg(value) FILTER (NOT net_pnl > 0) AS l,
        count(*) FILTER (net_pnl > 0) / count(*)::DOUBLE AS win_rate, avg(net_pnl) AS avg_pnl FROM long GROUP BY 1)
    SELECT indicator, n, round(w, 6) AS winner_mean, round(ws, 6) AS winner_std, round(l, 6) AS loser_mean, round(win_rate, 6) AS win_rate, round(avg_pnl, 7) AS avg_pnl, round(w - l, 6) AS difference,
        round(avg_pnl / greatest(1, abs(avg_pnl)), 6) AS contribution FROM s""")
def indicator_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_snapshot(spark, sf_dir).select("trade_id", "net_pnl", F.explode("snapshot").alias("indicator", "value"))
    return _round(_round(T.indicator_edges(rows), 6, "winner_mean", "winner_std", "loser_mean", "win_rate", "difference", "contribution"), 7, "avg_pnl")


@query(f"""WITH {SNAPSHOT}, p AS (SELECT net_pnl > 0 AS won, x.a, x.b, x.same FROM (SELECT net_pnl, unnest([{{'a': 'A', 'b': 'B', 'same': sign(a) = sign(b)}}, {{'a': 'A', 'b': 'C', 'same': sign(a) = sign(c)}},
        {{'a': 'B', 'b': 'C', 'same': sign(b) = sign(c)}}]) AS x FROM snap)),
    g AS (SELECT a, b, count(*) FILTER (won) AS winners, count(*) FILTER (NOT won) AS losers, count(*) FILTER (won AND same) / count(*) FILTER (won)::DOUBLE AS wa,
        count(*) FILTER (NOT won AND same) / count(*) FILTER (NOT won)::DOUBLE AS la FROM p GROUP BY 1, 2)
    SELECT a, b, winners, losers, round(wa, 6) AS winner_agreement, round(la, 6) AS loser_agreement, abs(wa - la) > 0.15 AS notable FROM g WHERE winners >= 10 AND losers >= 10""")
def indicator_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.pair_agreement(_with_snapshot(spark, sf_dir).select("net_pnl", "snapshot")), 6, "winner_agreement", "loser_agreement")


@query(f"""WITH {SNAPSHOT}, r AS (SELECT indicator, value, net_pnl AS result, rank() OVER (PARTITION BY indicator ORDER BY value) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2.0::DOUBLE AS rv,
        rank() OVER (PARTITION BY indicator ORDER BY net_pnl) + (count(*) OVER (PARTITION BY indicator, net_pnl) - 1) / 2.0::DOUBLE AS rr,
        row_number() OVER (PARTITION BY indicator ORDER BY exit_date, value, net_pnl) <= floor(count(*) OVER (PARTITION BY indicator) / 2) AS half FROM long),
    m AS (SELECT indicator, count(*) AS n, coalesce(corr(value, result), 0) AS pearson, coalesce(corr(rv, rr), 0) AS spearman, count(*) FILTER (sign(value) = sign(result)) / count(*)::DOUBLE AS accuracy,
        CASE WHEN count(*) FILTER (value > 0.3) > 5 THEN avg(result) FILTER (value > 0.3) ELSE 0 END AS long_return, CASE WHEN count(*) FILTER (value < -0.3) > 5 THEN avg(result) FILTER (value < -0.3) ELSE 0 END AS short_return,
        greatest(0, 1 - abs(coalesce(corr(value, result) FILTER (half), 0) - coalesce(corr(value, result) FILTER (NOT half), 0))) AS consistency FROM r GROUP BY 1),
    s AS (SELECT *, abs(pearson) * 0.25::DOUBLE + accuracy * 0.25::DOUBLE + abs(spearman) * 0.2::DOUBLE + least(1, abs(long_return - short_return)) * 0.15::DOUBLE + consistency * 0.15::DOUBLE AS score FROM m)
    SELECT indicator, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(accuracy, 6) AS accuracy, round(long_return, 4) AS long_return, round(short_return, 4) AS short_return,
        round(consistency, 6) AS consistency, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, indicator)::INT AS place FROM s""")
def indicator_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_snapshot(spark, sf_dir).select(F.explode("snapshot").alias("indicator", "value"), F.col("net_pnl").alias("result"), F.col("exit_date").alias("ts"))
    out = T.ranked(T.rank_indicators(rows), "score", "indicator")
    return _round(_round(_round(out, 6, "pearson", "spearman", "accuracy", "consistency"), 4, "long_return", "short_return"), 5, "score")


@query("""WITH e AS (SELECT event_id, event_type, value, unnest(map_entries(json_transform(props, '"MAP(VARCHAR, DOUBLE)"'))) AS kv FROM events)
    SELECT event_type, kv.key AS k, count(*) AS n, round(avg(kv.value), 6) AS mean_k, round(coalesce(corr(kv.value, value), 0), 6) AS with_value FROM e GROUP BY 1, 2 HAVING count(*) >= 3""")
def snapshot_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON maps of events laid out as rows and aggregated by key."""
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.explode(F.from_json("props", "map<string,double>")).alias("k", "v"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_k"), F.round(F.coalesce(F.nanvl(F.corr("v", "value"), F.lit(0.0)), F.lit(0.0)), 6).alias("with_value")).where("n >= 3")


@query(f"""WITH {TRADES}, c AS (SELECT trade_id, quantity * entry_price AS value, entry_price, CASE WHEN direction = 'LONG' THEN 'BUY' ELSE 'SELL' END AS side, least(greatest(l_tax_vol / 0.015::DOUBLE, 0.5), 2) AS ratio
        FROM (SELECT *, abs(net_pnl_pct) AS l_tax_vol FROM trades)),
    d AS (SELECT *, 20.0::DOUBLE AS brokerage, CASE WHEN side = 'SELL' THEN value * 0.00025::DOUBLE ELSE 0 END AS tax, value * 0.0000345::DOUBLE AS exchange, value * 0.000001::DOUBLE AS regulator,
        CASE WHEN side = 'BUY' THEN value * 0.00015::DOUBLE ELSE 0 END AS stamp, value * 0.0005::DOUBLE * (CASE WHEN ratio > 0 THEN ratio ELSE 1 END) AS slippage FROM c)
    SELECT trade_id, side, round(tax, 9) AS tax, round(exchange, 9) AS exchange, round((brokerage + exchange) * 0.18::DOUBLE, 11) AS gst, round(stamp, 9) AS stamp, round(slippage, 9) AS slippage,
        round(brokerage + tax + exchange + regulator + (brokerage + exchange) * 0.18::DOUBLE + stamp + slippage, 10) AS total FROM d WHERE ratio IS NOT NULL""")
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades(spark, sf_dir).withColumn("side", F.when(F.col("direction") == "LONG", "BUY").otherwise("SELL"))
    cost = C.order_costs(F.col("quantity") * F.col("entry_price"), F.col("side"), volatility=F.greatest(F.abs("net_pnl_pct"), F.lit(1e-9)))
    out = rows.select("trade_id", "side", cost.alias("c")).select("trade_id", "side", "c.tax", "c.exchange", "c.gst", "c.stamp", "c.slippage", "c.total")
    return _round(_round(_round(out, 9, "tax", "exchange", "stamp", "slippage"), 11, "gst"), 10, "total")


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT p.event_id, p.user_id, round(v.value, 6) AS last_view FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    out = J.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "last_view")
    return out.select("event_id", "user_id", F.round("last_view", 6).alias("last_view"))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT p.event_id, p.user_id, round(v.value, 6) AS next_view FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts""")
def asof_next_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("next_view"))
    out = J.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "next_view", forward=True)
    return out.select("event_id", "user_id", F.round("next_view", 6).alias("next_view"))


@query("""WITH s AS (SELECT event_id AS alarm, event_type AS kind, ts - INTERVAL 2 HOUR AS valid_from, ts + INTERVAL 4 HOUR AS valid_until FROM events WHERE event_type = 'error')
    SELECT e.event_id, s.alarm, s.kind FROM events e JOIN s ON e.ts BETWEEN s.valid_from AND s.valid_until WHERE e.event_type = 'purchase'""")
def interval_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within the validity of errors as alarms: two hours before to four after."""
    e = table(spark, sf_dir, "events")
    spans = e.where("event_type = 'error'").select(F.col("event_id").alias("alarm"), F.col("event_type").alias("kind"), F.expr("ts - INTERVAL 2 HOURS").alias("valid_from"), F.expr("ts + INTERVAL 4 HOURS").alias("valid_until"))
    out = J.interval_join(e.where("event_type = 'purchase'").select("event_id", "ts"), spans, "ts", "valid_from", "valid_until", 6)
    return out.select("event_id", "alarm", "kind")


@query(f"""WITH {TRADES}, s AS (SELECT DISTINCT player, exit_date AS session FROM trades WHERE day(exit_date) = 1),
    x AS (SELECT s.player, s.session, sum(net_pnl) FILTER (exit_date < session) AS before, sum(net_pnl) FILTER (exit_date >= session) AS after FROM s JOIN trades USING (player) GROUP BY 1, 2)
    SELECT player, session, round(coalesce(before, 0), 4) AS before, round(coalesce(after, 0), 4) AS after FROM x""")
def sessions_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a player before each session and from it on."""
    rows = trades(spark, sf_dir).select("player", "exit_date", "net_pnl")
    marks = rows.where(F.dayofmonth("exit_date") == 1).select("player", F.col("exit_date").alias("session")).distinct()
    return _round(J.before_after(marks, rows, ["player"], "session", "exit_date", "net_pnl"), 4, "before", "after").drop("helped")


@query(f"""WITH {TRADES}, r AS (SELECT player, symbol, trade_id, net_pnl, row_number() OVER (PARTITION BY player ORDER BY net_pnl DESC, trade_id)::INT AS place FROM trades)
    SELECT player, symbol, trade_id, round(net_pnl, 4) AS net_pnl, place FROM r WHERE place <= 10""")
def hall_of_fame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades(spark, sf_dir).select("player", "symbol", "trade_id", "net_pnl")
    return _round(J.top_per_group(rows, 10, [F.desc("net_pnl"), F.col("trade_id")], "player"), 4, "net_pnl")


@query(f"""WITH {TRADES}, r AS (SELECT player, trade_id, row_number() OVER (PARTITION BY player ORDER BY net_pnl DESC, trade_id) AS place FROM trades)
    SELECT player, count(*) AS n_deleted, min(trade_id) AS first_id FROM r WHERE place > 100 GROUP BY 1""")
def hall_of_fame_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades(spark, sf_dir).select("player", "trade_id", "net_pnl")
    return J.all_but_top(rows, 100, [F.desc("net_pnl"), F.col("trade_id")], "player").groupBy("player").agg(F.count("*").alias("n_deleted"), F.min("trade_id").alias("first_id"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, round(arg_max(value, ts), 6) AS value FROM events GROUP BY 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each key of an append-only log."""
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return J.latest(log, ["user_id"], "ts").select("user_id", "ts", "event_id", F.round("value", 6).alias("value"))


@query(f"""WITH {TRADES}, v AS (SELECT player, trade_id, direction, entry_price, net_pnl, 1 AS version, false AS gone FROM trades
        UNION ALL SELECT player, trade_id, direction, entry_price, net_pnl * 2, 2, false FROM trades WHERE l_linenumber = 1
        UNION ALL SELECT player, trade_id, NULL, NULL, NULL, 3, true FROM trades WHERE l_linenumber = 2 AND player < 3
        UNION ALL SELECT player, trade_id, 'FLAT', 0, 0, 0, false FROM trades WHERE l_linenumber = 3),
    n AS (SELECT player, trade_id, arg_max(struct_pack(d := direction, e := entry_price, p := net_pnl, g := gone), version) AS x FROM v GROUP BY 1, 2),
    s AS (SELECT player, x.d AS direction, count(*) AS n, sum(x.e) AS e, sum(x.p) AS p FROM n WHERE NOT x.g GROUP BY 1, 2)
    SELECT player, direction, n, {shown_sql('e')} AS entry_price, {shown_sql('p')} AS net_pnl FROM s""")
def keyed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades upserted under other field names, replaced, deleted and sent again too late, by player and direction."""
    t = trades(spark, sf_dir).select("player", "trade_id", "direction", "entry_price", "net_pnl", "l_linenumber")
    other = t.withColumnsRenamed({"direction": "side", "entry_price": "price", "net_pnl": "pnl"})
    buckets = max(8, -(-table(spark, sf_dir, "lineitem").count() // 1_000_000))  # a bucket is sorted in one task
    store = KeyedStore(spark, "trade_id string, direction string, entry_price double, net_pnl double, player long", "player", ["trade_id"], buckets)
    store.upsert(other, 1, TRADE_ALIASES)
    store.upsert(t.where("l_linenumber = 1").withColumn("net_pnl", F.col("net_pnl") * 2), 2, TRADE_ALIASES)
    store.delete(t.where("l_linenumber = 2 AND player < 3").select("player", "trade_id"), 3)
    store.upsert(t.where("l_linenumber = 3").withColumns({"side": F.lit("FLAT"), "price": F.lit(0.0), "pnl": F.lit(0.0)}), 0, TRADE_ALIASES)
    return store.read().groupBy("player", "direction").agg(F.count("*").alias("n"), shown(F.sum("entry_price")).alias("entry_price"), shown(F.sum("net_pnl")).alias("net_pnl"))


@query(f"""WITH {HOURLY}, r AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
    SELECT symbol, ts, round(close, 6) AS close FROM r WHERE i % greatest(1, floor(n / 50)::BIGINT) = 0""")
def equity_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.every_nth(event_bars(spark, sf_dir).select("symbol", "ts", F.round("close", 6).alias("close")), 50, ["ts"], "symbol")


@query(f"""WITH {DAILY}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars), c AS (SELECT symbol, ts, ret, sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY ts) AS lr FROM r WHERE ret IS NOT NULL),
    d AS (SELECT *, exp(lr) / exp(max(lr) OVER (PARTITION BY symbol ORDER BY ts)) - 1 AS dd FROM c)
    SELECT symbol, round(sqrt(252) * (avg(ret) - 0.05::DOUBLE / 252) / stddev_samp(ret), 6) AS sharpe, round(sqrt(252) * (avg(ret) - 0.05::DOUBLE / 252) / stddev_samp(ret) FILTER (ret < 0), 6) AS sortino,
        round(-min(dd), 6) AS max_drawdown, round(avg(ret) * 252 / -min(dd), 4) AS calmar FROM d GROUP BY symbol""")
def equity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe and Sortino ratios over a yearly rate of 5 %, drawdown and Calmar ratio of each series."""
    rows = daily_bars(spark, sf_dir).select("symbol", "ts", A.pct_change("close").alias("ret")).where("ret IS NOT NULL")
    rows = A.drawdowns(rows.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(A.expanding()))), "equity")
    excess = (F.avg("ret") - 0.05 / 252) * F.sqrt(F.lit(252.0))
    return rows.groupBy("symbol").agg(
        F.round(F.try_divide(excess, F.stddev_samp("ret")), 6).alias("sharpe"), F.round(F.try_divide(excess, F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret")))), 6).alias("sortino"),
        F.round(-F.min("drawdown"), 6).alias("max_drawdown"), F.round(F.try_divide(F.avg("ret") * 252, -F.min("drawdown")), 4).alias("calmar"))
