"""Queries on gates, postures, audits, calendars and weight histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as G
from ..operators import temporal as J
from ..sources.tables import daily_bars, table, trades
from .base import DAILY, TRADES, query, shown, shown_sql

_SEVERITY = "CASE WHEN value > 99.9 THEN 'critical' WHEN value > 99 THEN 'high' WHEN value > 95 THEN 'medium' ELSE 'low' END"


def _news_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors stand for market events; the value decides how severe one is."""
    e, v = table(spark, sf_dir, "events").where("event_type = 'error'"), F.col("value")
    return e.select("event_id", "event_type", "ts", F.when(v > 99.9, "critical").when(v > 99, "high").when(v > 95, "medium").otherwise("low").alias("severity"))


@query(f"""WITH e AS (SELECT event_id, ts, {_SEVERITY} AS severity FROM events WHERE event_type = 'error')
    SELECT event_id, severity, ts - to_hours(CASE severity WHEN 'critical' THEN 12 WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 1 END) AS valid_from,
        ts + to_hours(CASE severity WHEN 'critical' THEN 24 WHEN 'high' THEN 8 WHEN 'medium' THEN 4 ELSE 2 END) AS valid_until FROM e""")
def event_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.validity(_news_events(spark, sf_dir)).select("event_id", "severity", "valid_from", "valid_until")


_ACTIVE = f"""e AS (SELECT event_id, ts, {_SEVERITY} AS severity FROM events WHERE event_type = 'error'),
    v AS (SELECT *, ts - to_hours(CASE severity WHEN 'critical' THEN 12 WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 1 END) AS a, ts + to_hours(CASE severity WHEN 'critical' THEN 24 WHEN 'high' THEN 8 WHEN 'medium' THEN 4 ELSE 2 END) AS b FROM e),
    p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    s AS (SELECT p.event_id, p.user_id, p.ts, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END) AS k FROM p LEFT JOIN v ON p.ts BETWEEN v.a AND v.b GROUP BY ALL),
    posted AS (SELECT event_id, user_id, ts, CASE k WHEN 0 THEN 'halt' WHEN 1 THEN 'defensive' WHEN 2 THEN 'cautious' ELSE 'normal' END AS posture, CASE k WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 1 END AS size_factor FROM s)"""


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    spans = J.merged_spans(G.validity(_news_events(spark, sf_dir)), "valid_from", "valid_until", "severity")
    active = J.interval_join(points, spans, "ts", "valid_from", "valid_until", 12).groupBy("event_id").agg(G.worst(F.col("severity")).alias("severity"))
    return G.postures(points.join(active, "event_id", "left"))


@query(f"WITH {_ACTIVE} SELECT event_id, posture, size_factor FROM posted")
def event_postures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posture of each purchase from the most severe event that is valid then."""
    return _posted(spark, sf_dir).select("event_id", "posture", "size_factor")


@query(f"""WITH {_ACTIVE}, c AS (SELECT *, lag(posture) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM posted), d AS (SELECT * FROM c WHERE before IS NULL OR before <> posture)
    SELECT user_id, ts, before, posture, user_id || '_' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY ts))::VARCHAR, 6, '0') AS audit_id FROM d""")
def posture_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.changes(_posted(spark, sf_dir).select("user_id", "ts", "posture"), "posture", "ts", "user_id").select("user_id", "ts", "before", "posture", "audit_id")


_END = "1998-06-30"
_GATE = f"""{TRADES}, sides AS (SELECT symbol AS strategy, direction, exit_date, net_pnl, net_pnl_pct FROM trades WHERE exit_date <= DATE '{_END}'),
    win(win, days, weight, enough) AS (VALUES {', '.join(f"('{k}', {d}, {w}::DOUBLE, {n})" for k, (d, w, n) in G.WINDOWS.items())}),
    x AS (SELECT * FROM sides JOIN win ON exit_date > DATE '{_END}' - days), d AS (SELECT strategy, direction, win, exit_date, sum(net_pnl) AS pnl FROM x GROUP BY ALL),
    e AS (SELECT *, 100000 + sum(pnl) OVER (PARTITION BY strategy, direction, win ORDER BY exit_date) AS eq FROM d), f AS (SELECT *, greatest(100000, max(eq) OVER (PARTITION BY strategy, direction, win ORDER BY exit_date)) AS peak FROM e),
    dd AS (SELECT strategy, direction, win, max((peak - eq) / peak) AS dd FROM f GROUP BY ALL),
    m AS (SELECT strategy, direction, win, any_value(weight) AS weight, any_value(enough) AS enough, count(*) AS n, sum(net_pnl) AS profit, coalesce(avg(net_pnl_pct) / nullif(stddev_pop(net_pnl_pct), 0) * sqrt(252), 0) AS sharpe FROM x GROUP BY ALL),
    k AS (SELECT * FROM m JOIN dd USING (strategy, direction, win)),
    p AS (SELECT c.strategy, c.weight, c.n >= c.enough AND CASE WHEN b.profit = 0 THEN CASE WHEN c.profit > 0 THEN 100 ELSE 0 END ELSE (c.profit - b.profit) / abs(b.profit) * 100 END >= 2 AND (c.dd - b.dd) * 100 <= 3 AND c.sharpe - b.sharpe >= -0.5 AS passed
        FROM k c JOIN k b ON c.strategy = b.strategy AND c.win = b.win AND c.direction = 'LONG' AND b.direction = 'SHORT'),
    forward AS (SELECT strategy, count(*) AS n_windows, count(*) FILTER (passed) AS n_passed, sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) AS score, count(*) FILTER (passed) >= 2 AS accepted FROM p GROUP BY 1)"""
_STABLE = """d2 AS (SELECT symbol AS strategy, direction, exit_date AS day, count(*) AS n, sum(net_pnl) AS pnl FROM trades GROUP BY ALL), w2 AS (SELECT *, sum(pnl) OVER o AS cum, row_number() OVER o AS rn FROM d2 WHERE direction = 'LONG' WINDOW o AS (PARTITION BY strategy ORDER BY day)),
    v2 AS (SELECT *, max(cum) OVER o - cum AS fall, coalesce(max(CASE WHEN pnl >= 0 THEN rn END) OVER o, 0) AS good FROM w2 WINDOW o AS (PARTITION BY strategy ORDER BY day)),
    a2 AS (SELECT strategy, max(n) AS busiest, avg(n) AS turnover, CASE WHEN sum(pnl) > 0 THEN max(fall) / sum(abs(pnl)) * 100 ELSE 100 END AS fall, count(*) FILTER (pnl > 0) / count(*)::DOUBLE * 100 AS good_days, max(rn - good) AS losses_in_a_row,
        CASE WHEN sum(pnl) > 0 THEN max(pnl) / sum(pnl) * 100 ELSE 0 END AS concentration FROM v2 GROUP BY 1),
    b2 AS (SELECT strategy, avg(n) AS before FROM d2 WHERE direction = 'SHORT' GROUP BY 1), c2 AS (SELECT a2.*, coalesce(abs(turnover - before) / before * 100, 0) AS change FROM a2 LEFT JOIN b2 USING (strategy)),
    h2 AS (SELECT *, busiest <= 15 AND change <= 50 AS turnover_ok, fall <= 15 AS drawdown_ok, good_days >= 45 AND losses_in_a_row <= 5 AS consistency_ok, concentration <= 30 AS concentration_ok FROM c2),
    stable AS (SELECT *, turnover_ok::INT + drawdown_ok::INT + consistency_ok::INT + concentration_ok::INT AS n_held, turnover_ok::INT + drawdown_ok::INT + consistency_ok::INT + concentration_ok::INT >= 3 AS stable FROM h2)"""


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades(spark, sf_dir).withColumnRenamed("symbol", "strategy")
    base, new = (G.window_metrics(rows.where(F.col("direction") == side), _END, "strategy") for side in ("SHORT", "LONG"))
    return G.walk_forward_gate(base, new)


def _stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = trades(spark, sf_dir).groupBy(F.col("symbol").alias("strategy"), "direction", F.col("exit_date").alias("day")).agg(F.count("*").alias("n_trades"), F.sum("net_pnl").alias("pnl"))
    base, new = (daily.where(F.col("direction") == side).drop("direction") for side in ("SHORT", "LONG"))
    return G.stability_gate(base, new)


@query(f"WITH {_GATE} SELECT strategy, n_windows, n_passed, {shown_sql('score')} AS score, accepted FROM forward")
def gate_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long trades as candidates against short ones as their baseline, in three windows."""
    return _forward(spark, sf_dir).withColumn("score", shown(F.col("score")))


@query(f"WITH {TRADES}, {_STABLE} SELECT strategy, losses_in_a_row, turnover_ok, drawdown_ok, consistency_ok, concentration_ok, n_held, stable, {', '.join(f'{shown_sql(c)} AS {c}' for c in ('turnover', 'change', 'fall', 'good_days', 'concentration'))} FROM stable")
def gate_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stable(spark, sf_dir).withColumns({c: shown(F.col(c)) for c in ("turnover", "change", "fall", "good_days", "concentration")})


@query(f"""WITH {_GATE}, {_STABLE}, v AS (SELECT strategy, coalesce(accepted, false)::INT + coalesce(stable, false)::INT AS passed, (accepted IS NOT NULL)::INT + (stable IS NOT NULL)::INT AS held FROM forward FULL JOIN stable USING (strategy))
    SELECT strategy, passed / held::DOUBLE AS score, CASE WHEN passed = held THEN 'PASS' WHEN passed > 0 THEN 'CONDITIONAL' ELSE 'FAIL' END AS verdict FROM v""")
def validation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.validation(_forward(spark, sf_dir), _stable(spark, sf_dir))


@query(f"""WITH {TRADES}, s AS (SELECT symbol AS trial, date_trunc('month', exit_date)::DATE AS session, sum(net_pnl) AS pnl FROM trades GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY session DESC) AS r FROM s),
    m AS (SELECT trial, count(*) AS n, sum(pnl) AS total, count(*) FILTER (r <= 4 AND pnl < 0) AS recent_losses FROM r GROUP BY 1)
    SELECT trial, n, round(total, 4) AS total, recent_losses, CASE WHEN n >= 4 AND recent_losses = 4 THEN 'rollback' WHEN total < -30000 THEN 'rollback' WHEN n >= 8 THEN 'promote' ELSE 'continue' END AS verdict FROM m""")
def gate_canary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trades(spark, sf_dir).groupBy(F.col("symbol").alias("trial"), F.trunc("exit_date", "month").alias("session")).agg(F.sum("net_pnl").alias("pnl"))
    return G.canary(s, 30_000).withColumn("total", F.round("total", 4))


@query(f"""WITH {TRADES}, a AS (SELECT symbol, sum(net_pnl) AS candidate FROM trades WHERE player < 3 GROUP BY 1), b AS (SELECT symbol, sum(net_pnl) AS base FROM trades WHERE player > 2 GROUP BY 1),
    i AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, candidate, base, CASE WHEN base = 0 THEN CASE WHEN candidate > 0 THEN 1 ELSE 0 END ELSE (candidate - base) / abs(base) END AS improvement FROM a FULL JOIN b ON a.symbol = b.symbol)
    SELECT symbol, round(improvement, 6) AS improvement, CASE WHEN improvement IS NULL THEN 'missing' WHEN improvement > 0.05 THEN 'accept' WHEN improvement < -0.05 THEN 'reject' ELSE 'review' END AS verdict FROM i""")
def experiment_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trades(spark, sf_dir)
    sums = lambda rule: rows.where(rule).groupBy("symbol").agg(F.sum("net_pnl").alias("net_profit"))
    return G.verdict(sums("player < 3"), sums("player > 2"), "symbol").select("symbol", F.round("improvement", 6).alias("improvement"), "verdict")


@query("""WITH p AS (SELECT event_id, list_filter([CASE WHEN value < 1 THEN 'tiny' END, CASE WHEN value > 95 THEN 'large' END, CASE WHEN props IS NULL THEN 'no_props' END, CASE WHEN user_id % 50 = 0 THEN 'blocked_user' END], lambda x: x IS NOT NULL) AS p FROM events)
    SELECT event_id, array_to_string(p, ',') AS problems FROM p WHERE len(p) > 0""")
def row_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = G.problems(e, {"tiny": F.col("value") < 1, "large": F.col("value") > 95, "no_props": F.col("props").isNull(), "blocked_user": F.col("user_id") % 50 == 0})
    return out.where(F.size("problems") > 0).select("event_id", F.array_join("problems", ",").alias("problems"))


@query(f"""WITH {DAILY}, s AS (SELECT symbol || ':' || count(*) || ':' || min(ts) || ':' || max(ts) AS p FROM bars GROUP BY symbol) SELECT substr(md5(string_agg(p, '|' ORDER BY p)), 1, 8) AS data_hash FROM s""")
def run_data_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.data_hash(daily_bars(spark, sf_dir))


@query("""WITH e AS (SELECT event_type, hour(ts) * 60 + minute(ts) AS m, isodow(ts) AS d, ts FROM events),
    p AS (SELECT event_type, CASE WHEN m < 555 THEN 'before' WHEN m < 570 THEN 'opening' WHEN m < 690 THEN 'morning' WHEN m < 810 THEN 'midday' WHEN m < 885 THEN 'afternoon' WHEN m <= 930 THEN 'closing' ELSE 'after' END AS phase, d >= 6 AS weekend FROM e)
    SELECT event_type, phase, weekend, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def trading_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", G.phase(F.hour("ts") * 60 + F.minute("ts")).alias("phase"), (F.weekday("ts") >= 5).alias("weekend")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) SELECT day, last_day(day) - ((isodow(last_day(day)) - 4 + 7) % 7)::INT AS expiry FROM d""")
def expiry_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shipping day with the last Thursday of its month."""
    d = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return d.select("day", G.last_thursday(F.col("day")).alias("expiry"))


_HISTORY = f"{TRADES}, h AS (SELECT symbol AS name, year(exit_date) AS generation, avg(net_pnl) / 1000 AS weight FROM trades GROUP BY 1, 2)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).groupBy(F.col("symbol").alias("name"), F.year("exit_date").alias("generation")).agg((F.avg("net_pnl") / 1000).alias("weight"))


@query(f"""WITH {_HISTORY}, m AS (SELECT name, count(*) AS n, avg(abs(weight)) AS mean_size, stddev_pop(weight) AS std, avg(weight) AS mean FROM h GROUP BY 1)
    SELECT name, n, round(mean_size, 6) AS mean_size, round(std, 6) AS std, round(mean, 6) AS mean, round(1 - least(1, coalesce(std / nullif(abs(mean), 0), 0)), 6) AS stability FROM m""")
def weight_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.weight_history(_history(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_size", "std", "mean", "stability")})


@query(f"WITH {_HISTORY} SELECT name, " + ", ".join(f"round(coalesce(sum(weight) FILTER (generation = {y}), 0), 6) AS g{y}" for y in range(1996, 2000)) + " FROM h GROUP BY name")
def weight_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by generations, a missing weight as 0."""
    wide = _history(spark, sf_dir).groupBy("name").pivot("generation", list(range(1996, 2000))).agg(F.sum("weight")).na.fill(0.0)
    return wide.select("name", *(F.round(F.col(f"`{y}`"), 6).alias(f"g{y}") for y in range(1996, 2000)))


@query(f"""WITH {_HISTORY} SELECT generation, count(*) AS n, round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS std, round(min(weight), 6) AS least, round(max(weight), 6) AS best,
    arg_max(name, weight) AS best_name FROM h GROUP BY 1""")
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir).groupBy("generation").agg(F.count("*").alias("n"), F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("std"), F.min("weight").alias("least"), F.max("weight").alias("best"), F.max_by("name", "weight").alias("best_name"))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std", "least", "best")})
