"""Gates, postures, audits and summaries around strategies: rules over small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trades import max_drawdown, metrics, share

# Hours that an event stays valid by severity, and what a posture allows.
VALID_HOURS = {"critical": 24, "high": 8, "medium": 4, "low": 2}
POSTURES = {"critical": ("halt", 0.0, 0.5), "high": ("defensive", 0.5, 0.75), "medium": ("cautious", 0.75, 1.0), "low": ("normal", 1.0, 1.0)}
SEVERITIES = tuple(VALID_HOURS)


def lookup(x: Column, values: dict, otherwise: object = None) -> Column:
    """A value for each key, as a chain of conditions: no join for a handful of keys."""
    out = F.lit(otherwise)
    for k, v in reversed(values.items()):
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def validity(events: DataFrame, at: str = "ts") -> DataFrame:
    """Adds valid_from (half the hours before, rounded down) and valid_until (the hours after) by severity."""
    hours = lookup(F.col("severity"), VALID_HOURS, 2)
    return events.withColumn("valid_from", F.col(at) - F.make_dt_interval(hours=F.floor(hours / 2).cast("int"))).withColumn("valid_until", F.col(at) + F.make_dt_interval(hours=hours))


def worst(severity: Column) -> Column:
    """Aggregate: the most severe value, or null."""
    n = F.min(lookup(severity, {s: i for i, s in enumerate(SEVERITIES)}))
    return lookup(n, dict(enumerate(SEVERITIES)))


def postures(rows: DataFrame) -> DataFrame:
    """Adds posture, size factor and stop factor for a severity; without one all is normal."""
    s = F.coalesce(F.col("severity"), F.lit("low"))
    return rows.withColumns({"posture": lookup(s, {k: v[0] for k, v in POSTURES.items()}, "normal"), "size_factor": lookup(s, {k: v[1] for k, v in POSTURES.items()}, 1.0),
                             "stop_factor": lookup(s, {k: v[2] for k, v in POSTURES.items()}, 1.0)})


def changes(rows: DataFrame, state: str, order: str, *keys: str) -> DataFrame:
    """The rows at which a state differs from the one before, the first included, numbered for an audit trail."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = rows.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNull() | (F.col("before") != F.col(state)))
    return changed.withColumn("audit_id", F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.lpad(F.row_number().over(w).cast("string"), 6, "0")))


# Days back, weight in the score and least number of trades of each window.
WINDOWS = {"recent": (30, 0.4, 10), "medium": (90, 0.35, 25), "long": (180, 0.25, 40)}


def window_metrics(trades: DataFrame, end: object, *keys: str) -> DataFrame:
    """(keys, window, total_trades, net_profit, sharpe, max_drawdown) of the trades that left within each of WINDOWS before ``end``."""
    windows = F.array(*(F.when(F.col("exit_date") > F.date_sub(F.lit(end).cast("date"), days), F.lit(name)) for name, (days, _, _) in WINDOWS.items()))
    rows = trades.where(F.col("exit_date") <= F.lit(end).cast("date")).withColumn("window", F.explode(F.array_compact(windows)))
    return metrics(rows, *keys, "window").join(max_drawdown(rows, *keys, "window"), [*keys, "window"]).select(*keys, "window", "total_trades", "net_profit", "sharpe", "max_drawdown")


def walk_forward_gate(baseline: DataFrame, candidate: DataFrame, key: str = "strategy", least_gain: float = 2.0, most_fall: float = 3.0, least_windows: int = 2, all_windows: bool = False) -> DataFrame:
    """Does a candidate beat its baseline in enough windows?  Both are tables of ``window_metrics``.

    A window passes with enough trades, a profit better by ``least_gain`` percent
    (from nothing any gain counts as 100), a drawdown deeper by at most
    ``most_fall`` points and a Sharpe ratio worse by at most 0.5.  The score is
    the weight of the windows passed among those that both sides have.
    """
    rows = baseline.select(key, "window", *(F.col(c).alias(f"b_{c}") for c in ("net_profit", "sharpe", "max_drawdown"))).join(candidate, [key, "window"])
    gain = F.when(F.col("b_net_profit") == 0, F.when(F.col("net_profit") > 0, 100.0).otherwise(0.0)).otherwise((F.col("net_profit") - F.col("b_net_profit")) / F.abs("b_net_profit") * 100)
    weight, enough = (lookup(F.col("window"), {k: v[i] for k, v in WINDOWS.items()}) for i in (1, 2))
    passed = (F.col("total_trades") >= enough) & (gain >= least_gain) & ((F.col("max_drawdown") - F.col("b_max_drawdown")) * 100 <= most_fall) & (F.col("sharpe") - F.col("b_sharpe") >= -0.5)
    out = rows.withColumns({"passed": passed, "weight": weight}).groupBy(key).agg(
        F.count("*").alias("n_windows"), F.count_if("passed").alias("n_passed"), share(F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("score"))
    return out.withColumn("accepted", (F.col("n_passed") == F.col("n_windows")) if all_windows else (F.col("n_passed") >= least_windows))


def _day_metrics(daily: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("day")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumns({"_cum": F.sum("pnl").over(sofar), "_rn": F.row_number().over(w)})
    rows = rows.withColumns({"_fall": F.max("_cum").over(sofar) - F.col("_cum"), "_good": F.coalesce(F.max(F.when(F.col("pnl") >= 0, F.col("_rn"))).over(sofar), F.lit(0))})
    return rows.groupBy(key).agg(
        F.max("n_trades").alias("busiest"), F.avg("n_trades").alias("turnover"), F.max("_fall").alias("_fall"), F.sum(F.abs("pnl")).alias("_size"), F.sum("pnl").alias("_total"),
        (share(F.count_if(F.col("pnl") > 0), F.count("*")) * 100).alias("good_days"), F.max(F.col("_rn") - F.col("_good")).alias("losses_in_a_row"), F.max("pnl").alias("_best"))


def stability_gate(baseline: DataFrame, candidate: DataFrame, key: str = "strategy", most_trades: float = 15, most_change: float = 50.0, most_fall: float = 15.0, least_days: float = 45.0, most_losses: int = 5, most_share: float = 30.0) -> DataFrame:
    """Four checks of a candidate's days, of which three must hold; both tables have the key, day, n_trades, pnl.

    Turnover: no day with too many trades, and their mean not too far from the
    baseline's.  Drawdown: the deepest fall in percent of the sum of all daily
    results' sizes, 100 for those that lose on the whole.  Consistency: enough
    days with a gain and no long row of losing ones.  Concentration: the best day
    in percent of the whole, where that is a gain.
    """
    base = baseline.groupBy(key).agg(F.avg("n_trades").alias("_before"))
    m = _day_metrics(candidate, key).join(base, key, "left").withColumns({
        "change": F.coalesce(F.when(F.col("_before") > 0, F.abs(F.col("turnover") - F.col("_before")) / F.col("_before") * 100), F.lit(0.0)),
        "fall": F.when(F.col("_total") > 0, share(F.col("_fall"), F.col("_size")) * 100).otherwise(100.0),
        "concentration": F.when(F.col("_total") > 0, F.col("_best") / F.col("_total") * 100).otherwise(0.0)})
    checks = {"turnover_ok": (F.col("busiest") <= most_trades) & (F.col("change") <= most_change), "drawdown_ok": F.col("fall") <= most_fall,
              "consistency_ok": (F.col("good_days") >= least_days) & (F.col("losses_in_a_row") <= most_losses), "concentration_ok": F.col("concentration") <= most_share}
    out = m.withColumns(checks).withColumn("n_held", sum((F.col(c).cast("int") for c in checks), F.lit(0)))
    return out.select(key, "turnover", "change", "fall", "good_days", "losses_in_a_row", "concentration", *checks, "n_held", (F.col("n_held") >= 3).alias("stable"))


def validation(forward: DataFrame, stability: DataFrame, key: str = "strategy") -> DataFrame:
    """PASS where every gate that could be held was passed, CONDITIONAL where one was, else FAIL; the score is the share passed."""
    both = forward.select(key, "accepted").join(stability.select(key, "stable"), key, "full")
    held = F.col("accepted").isNotNull().cast("int") + F.col("stable").isNotNull().cast("int")
    passed = F.coalesce(F.col("accepted"), F.lit(False)).cast("int") + F.coalesce(F.col("stable"), F.lit(False)).cast("int")
    return both.select(key, (passed / held).alias("score"), F.when(passed == held, "PASS").when(passed > 0, "CONDITIONAL").otherwise("FAIL").alias("verdict"))


def canary(sessions: DataFrame, most_loss: float, streak: int = 4) -> DataFrame:
    """Roll back a trial when all of its last sessions lost, or it lost too much.  ``sessions`` has trial, session, pnl."""
    rank = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("session")))
    rows = sessions.withColumn("r", rank)
    m = rows.groupBy("trial").agg(F.count("*").alias("n"), F.sum("pnl").alias("total"), F.count_if((F.col("r") <= streak) & (F.col("pnl") < 0)).alias("recent_losses"))
    return m.withColumn("verdict", F.when((F.col("n") >= streak) & (F.col("recent_losses") == streak), "rollback").when(F.col("total") < -most_loss, "rollback").when(F.col("n") >= 2 * streak, "promote").otherwise("continue"))


def verdict(m: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Candidate against baseline by name: the relative change of profit; a missing side fails.

    With a baseline of zero any gain counts as 100 %.
    """
    both = m.select(key, F.col("net_profit").alias("candidate")).join(baseline.select(key, F.col("net_profit").alias("base")), key, "full")
    change = F.when(F.col("base") == 0, F.when(F.col("candidate") > 0, 1.0).otherwise(0.0)).otherwise((F.col("candidate") - F.col("base")) / F.abs("base"))
    both = both.withColumn("improvement", change)
    return both.withColumn("verdict", F.when(F.col("improvement").isNull(), "missing").when(F.col("improvement") > 0.05, "accept").when(F.col("improvement") < -0.05, "reject").otherwise("review"))


def problems(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds the names of all rules that a row breaks."""
    return rows.withColumn("problems", F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))))


def data_hash(bars: DataFrame) -> DataFrame:
    """(data_hash): a fingerprint of which symbols, how many rows and which spans a run has read."""
    spans = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    parts = spans.select(F.concat_ws(":", "symbol", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")).alias("p"))
    return parts.agg(F.substring(F.md5(F.concat_ws("|", F.array_sort(F.collect_list("p")))), 1, 8).alias("data_hash"))


def phase(minute: Column) -> Column:
    """Part of the trading day by minute after midnight."""
    return F.when(minute < 555, "before").when(minute < 570, "opening").when(minute < 690, "morning").when(minute < 810, "midday").when(minute < 885, "afternoon").when(minute <= 930, "closing").otherwise("after")


def last_thursday(day: Column) -> Column:
    """The last Thursday of the month of a date."""
    end = F.last_day(day)
    return F.date_sub(end, F.pmod(F.dayofweek(end) - 5, F.lit(7)))


def weight_history(weights: DataFrame) -> DataFrame:
    """Mean size, deviation and stability of each name's weights over generations."""
    out = weights.groupBy("name").agg(F.count("*").alias("n"), F.avg(F.abs("weight")).alias("mean_size"), F.stddev_pop("weight").alias("std"), F.avg("weight").alias("mean"))
    return out.withColumn("stability", 1 - F.least(F.lit(1.0), share(F.col("std"), F.abs("mean"))))


def recommend(edges: DataFrame, cap: float = 0.1) -> DataFrame:
    """A factor within the cap for each indicator: up when it is higher for winners and wins more often than not, down in the opposite case."""
    good, bad = (F.col("difference") > 0) & (F.col("win_rate") > 0.5), (F.col("difference") < 0) & (F.col("win_rate") < 0.5)
    return edges.select("indicator", F.when(good, "increase").when(bad, "decrease").otherwise("keep").alias("action"), F.when(good, 1 + cap).when(bad, 1 - cap).otherwise(1.0).alias("factor"))
