"""Statistics over closed trades: metrics, groups, streaks, patterns, indicator snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import shared_folder
from .skew import join_by_size

PNL = "net_pnl"
#: Half-open holding periods in days; the last has no end.
HOLDING = (0, 2, 5, 10, 30)


def wins() -> Column:
    return F.col(PNL) > 0


def in_order() -> list[Column]:
    """Exit order with the id as the last resort, so that sequences are well defined."""
    return [F.col("exit_date"), F.col("entry_date"), F.col("trade_id")]


def sequence(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*in_order())


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(trades: DataFrame, *keys: str, factor_cap: float = 10.0) -> DataFrame:
    """Counts, sums, averages, extremes and ratios of each group: one aggregation with partial sums.

    A trade without gain is a loser.  Without losses the profit factor is capped;
    deviations are those of the population.
    """
    won, pnl = wins(), F.col(PNL)
    days = F.datediff("exit_date", "entry_date")
    gain, loss = F.coalesce(F.sum(F.when(won, pnl)), F.lit(0.0)), F.coalesce(-F.sum(F.when(~won, pnl)), F.lit(0.0))
    base = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.count_if(won).alias("winning_trades"), F.count_if(F.col("direction") == "LONG").alias("long_trades"),
        F.count_if((F.col("direction") == "LONG") & won).alias("long_wins"), F.count_if((F.col("direction") == "SHORT") & won).alias("short_wins"),
        F.sum("gross_pnl").alias("gross_pnl"), F.sum("total_costs").alias("total_costs"), F.sum(pnl).alias("net_profit"),
        gain.alias("gross_profit"), loss.alias("gross_loss"),
        F.coalesce(F.max(F.when(won, pnl)), F.lit(0.0)).alias("largest_win"), F.coalesce(-F.min(F.when(~won, pnl)), F.lit(0.0)).alias("largest_loss"),
        F.avg(days).alias("avg_days"), F.coalesce(F.avg(F.when(won, days)), F.lit(0.0)).alias("avg_winner_days"),
        F.coalesce(share(F.avg("net_pnl_pct"), F.stddev_pop("net_pnl_pct")) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"))
    lost = F.col("total_trades") - F.col("winning_trades")
    out = base.withColumns({
        "losing_trades": lost, "win_rate": share(F.col("winning_trades"), F.col("total_trades")),
        "long_win_rate": share(F.col("long_wins"), F.col("long_trades")), "short_win_rate": share(F.col("short_wins"), F.col("total_trades") - F.col("long_trades")),
        "avg_win": share(F.col("gross_profit"), F.col("winning_trades")), "avg_loss": share(F.col("gross_loss"), lost),
        "avg_trade": share(F.col("net_profit"), F.col("total_trades")),
        "profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).otherwise(factor_cap)})
    return out.withColumns({"payoff_ratio": share(F.col("avg_win"), F.col("avg_loss")), "expectancy_ratio": share(F.col("avg_trade"), F.col("avg_loss"))})


def fitness(m: DataFrame, least_trades: int = 30) -> DataFrame:
    """Adds the score of a strategy's metrics: weighted parts, then penalties and bonuses in a fixed order.

    ``m`` has net_profit, sharpe, max_drawdown, win_rate, total_trades and profit_factor.
    """
    wr, pf, sharpe, dd, profit, n = (F.col(c) for c in ("win_rate", "profit_factor", "sharpe", "max_drawdown", "net_profit", "total_trades"))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    by_wins = F.when(wr >= 0.7, 1.0).when(wr >= 0.65, 0.9 + (wr - 0.65) * 2).when(wr >= 0.55, 0.7 + (wr - 0.55) * 2).otherwise(F.greatest(F.lit(0.0), wr / 0.55 * 0.7))
    by_factor = F.when(pf > 0, F.least(F.lit(1.0), pf / 2)).otherwise(0.0)
    scored = m.withColumns({
        "profit_score": logistic(profit / 10_000), "sharpe_score": F.when(sharpe < 0, 0.0).otherwise(logistic((sharpe - 1) * 2)),
        "drawdown_score": F.greatest(F.lit(0.0), 1 - dd), "consistency_score": by_wins * 0.7 + by_factor * 0.3})
    total = F.col("profit_score") * 0.3 + F.col("sharpe_score") * 0.25 + F.col("drawdown_score") * 0.2 + F.col("consistency_score") * 0.25
    for rule, factor in [(wr < 0.45, 0.5), (dd > 0.3, 0.6), (sharpe < 0, 0.4), (n < 50, 0.7), (wr >= 0.7, 1.3), ((wr >= 0.65) & (sharpe >= 5), 1.2),
                         ((profit >= 100_000) & (wr >= 0.6), 1.25), (pf >= 2, 1.15)]:
        total = total * F.when(rule, factor).otherwise(1.0)
    return scored.withColumn("fitness", F.when(n < least_trades, 0.0).otherwise(F.greatest(F.lit(0.0), total)))


def groups(trades: DataFrame, by: str, *keys: str, unknown: str = "unknown") -> DataFrame:
    """Count, share of all, win rate, total and mean by one column within the keys; a missing value is a group."""
    g = trades.withColumn(by, F.coalesce(by, F.lit(unknown))).groupBy(*keys, by).agg(
        F.count("*").alias("n"), share(F.count_if(wins()), F.count("*")).alias("win_rate"), F.sum(PNL).alias("total_pnl"), F.avg(PNL).alias("avg_pnl"))
    return g.withColumn("share_of_all", share(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))


def streaks(trades: DataFrame, *keys: str) -> DataFrame:
    """The longest runs of winners and of losers in exit order."""
    w = sequence(*keys)
    marked = trades.select(*keys, *in_order(), wins().alias("won"))
    change = F.coalesce((F.lag("won").over(w) != F.col("won")).cast("int"), F.lit(1))
    runs = marked.withColumn("c", change).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "run", "won").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("won"), F.col("n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(~F.col("won"), F.col("n"))), F.lit(0)).alias("max_losses"))


def rolling(trades: DataFrame, n: int, *keys: str) -> DataFrame:
    """Win rate and result over the last n trades, and the running total; from the n-th trade on."""
    w = sequence(*keys)
    last, sofar = w.rowsBetween(-(n - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0)
    return trades.select(
        *keys, "trade_id", "exit_date", F.row_number().over(w).alias("trade_num"), F.avg(wins().cast("double")).over(last).alias("win_rate"),
        F.sum(PNL).over(sofar).alias("cumulative_pnl"), F.sum(PNL).over(last).alias("rolling_pnl"), F.avg(PNL).over(last).alias("rolling_avg")).where(F.col("trade_num") >= n)


def max_drawdown(trades: DataFrame, *keys: str, capital: float = 100_000.0) -> DataFrame:
    """The deepest fall of capital and running result below their maximum, absolute and as a share of it.

    Daily results are summed first, so the running part is over days and not
    over all trades.  The start counts as a maximum, so the share is defined for
    groups that only lose; it passes 1 where more than all is lost.
    """
    daily = trades.groupBy(*keys, "exit_date").agg(F.sum(PNL).alias("pnl"))
    w = Window.partitionBy(*keys).orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("equity", F.sum("pnl").over(w) + capital).withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(w)))
    fall = F.col("peak") - F.col("equity")
    return curve.groupBy(*keys).agg(F.max(fall).alias("max_drawdown_abs"), F.max(fall / F.col("peak")).alias("max_drawdown"))


def holding_bucket(days: Column) -> Column:
    label = F.lit(f"{HOLDING[-1]}+")
    for lo, hi in reversed([*zip(HOLDING, HOLDING[1:])]):
        label = F.when(days < hi, f"{lo}-{hi}").otherwise(label)
    return label


def bucket_edges(trades: DataFrame, bucket: Column, *keys: str, least: float = 0.05) -> DataFrame:
    """Win rate of each bucket against that of all trades of the key; ``notable`` where it differs by more than ``least``."""
    b = trades.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.count_if(wins()).alias("won"), F.avg(PNL).alias("avg_pnl"))
    all_ = Window.partitionBy(*keys)
    out = b.withColumn("win_rate", share(F.col("won"), F.col("n"))).withColumn("edge", F.col("win_rate") - share(F.sum("won").over(all_), F.sum("n").over(all_)))
    return out.withColumn("notable", F.abs("edge") > least).drop("won")


def overtrading(trades: DataFrame, at: str, least: int, *keys: str) -> DataFrame:
    """Groups of (keys, value of ``at``) with at least so many trades."""
    return trades.groupBy(*keys, at).agg(F.count("*").alias("n"), F.sum(PNL).alias("total_pnl")).where(F.col("n") >= least)


def mistakes(trades: DataFrame, large_loss: float = -0.05, quick_days: int = 2, long_days: int = 365) -> DataFrame:
    """(trade_id, net_pnl, mistake): every rule that a losing trade matches; one without any is a false signal."""
    days = F.datediff("exit_date", "entry_date")
    rules = {
        "late_exit": F.col("net_pnl_pct") <= large_loss, "early_exit": (days <= quick_days) & (F.col("exit_reason") == "signal"),
        "tight_stop": (days <= 30) & (F.col("exit_reason") == "stop_loss"), "overstay": days > long_days}
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    losing = trades.where(~wins() & (F.col(PNL) < 0)).withColumn("found", found)
    return losing.select("trade_id", PNL, F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.array(F.lit("false_signal")))).alias("mistake"))


def trend(trades: DataFrame, k: int, *keys: str, band: float = 0.05) -> DataFrame:
    """Mean result of the last k trades against the k before: improving, declining or stable within the band."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(c.desc() for c in in_order())))
    rows = trades.select(*keys, PNL, *in_order()).withColumn("r", rank).where(F.col("r") <= 2 * k)
    m = rows.groupBy(*keys).agg(F.avg(F.when(F.col("r") <= k, F.col(PNL))).alias("recent"), F.avg(F.when(F.col("r") > k, F.col(PNL))).alias("before"))
    change = F.try_divide(F.col("recent") - F.col("before"), F.abs("before"))
    return m.withColumn("trend", F.when(change > band, "improving").when(change < -band, "declining").otherwise("stable"))


def snapshot_rows(trades: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(trade columns, indicator, value): trades with their snapshot maps, a row for each entry; trades without one are left out."""
    return trades.join(snapshots, "trade_id").select(*trades.columns, F.explode("snapshot").alias("indicator", "value"))


def indicator_edges(rows: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """By indicator: mean and deviation for winners and for losers, their difference, win rate and contribution."""
    won = wins()
    out = rows.groupBy("indicator", *keys).agg(
        F.count("*").alias("n"), F.avg(F.when(won, F.col("value"))).alias("winner_mean"), F.stddev_pop(F.when(won, F.col("value"))).alias("winner_std"),
        F.avg(F.when(~won, F.col("value"))).alias("loser_mean"), share(F.count_if(won), F.count("*")).alias("win_rate"), F.avg(PNL).alias("avg_pnl")).where(F.col("n") >= least)
    return out.withColumn("difference", F.col("winner_mean") - F.col("loser_mean")).withColumn("contribution", F.col("avg_pnl") / F.greatest(F.lit(1.0), F.abs("avg_pnl")))


def pair_agreement(rows: DataFrame, least: int = 10, apart: float = 0.15) -> DataFrame:
    """For pairs of indicators of one trade, how often their signs agree among winners and among losers.

    ``rows`` has trade_id, net_pnl and a map ``snapshot``; pairs come from each
    trade's own map, so their number is bounded by the indicators of a trade.
    """
    entries = F.transform(F.array_sort(F.map_entries("snapshot")), lambda e: F.struct(e["key"].alias("k"), F.signum(e["value"]).alias("s")))
    pairs = F.flatten(F.transform("e", lambda x: F.transform(F.filter("e", lambda y: y["k"] > x["k"]), lambda y: F.struct(x["k"].alias("a"), y["k"].alias("b"), (x["s"] == y["s"]).alias("same")))))
    each = rows.withColumn("e", entries).select(wins().alias("won"), F.explode(pairs).alias("p")).select("won", "p.*")
    won = F.col("won")
    out = each.groupBy("a", "b").agg(
        F.count_if(won).alias("winners"), F.count_if(~won).alias("losers"), share(F.count_if(won & F.col("same")), F.count_if(won)).alias("winner_agreement"),
        share(F.count_if(~won & F.col("same")), F.count_if(~won)).alias("loser_agreement")).where((F.col("winners") >= least) & (F.col("losers") >= least))
    return out.withColumn("notable", F.abs(F.col("winner_agreement") - F.col("loser_agreement")) > apart)


def positions(rows: DataFrame, order: list[str], *keys: str, prefix: str = "") -> DataFrame:
    """``rows`` with the columns of ``places``."""
    return rows.join(places(rows, order, *keys, prefix=prefix), [*keys, *order])


def places(rows: DataFrame, order: list[str], *keys: str, prefix: str = "") -> DataFrame:
    """For each of the rows' different keys and ``order``, ``before`` and ``ties``: how many rows of the keys come earlier in ``order``, and how many are equal.

    Few keys may hold all rows, so no window runs over a key: different values
    are dealt out by sampled ranges and counted within each range, and the ranges
    before it, one number each, are added.  The ranges are written to the shared
    folder, as both uses must see the same ones.  Columns of ``order`` are not null.
    """
    shared_folder(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy(*keys, *order).agg(F.count("*").alias("_n"))
    placed = counted.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s")).withColumn("_off", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(ranges, [*keys, "_part"])
    return found.select(*keys, *order, (F.col("_off") + F.col("_in")).alias(f"{prefix}before"), F.col("_n").alias(f"{prefix}ties"))


def ranks_and_halves(rows: DataFrame, result: str) -> DataFrame:
    """Adds, within each indicator, average ranks ``rv`` of value and ``rr`` of the result, and whether a row is in the earlier half of time."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/ranked-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    rank = lambda c, name: places(rows, [c], "indicator").select("indicator", c, (F.col("before") + (F.col("ties") + 1) / 2.0).alias(name), "ties")
    # Only rows of the one time that holds the middle need an order within their time.
    half = F.floor(F.col("_all") / 2)
    times = places(rows, ["ts"], "indicator").join(rows.groupBy("indicator").agg(F.count("*").alias("_all")), "indicator")
    dated = join_by_size(rows, times, ["indicator", "ts"], "ties")
    middle = (F.col("before") < half) & (F.col("before") + F.col("ties") > half)
    whole = dated.where(~middle).select(*rows.columns, (F.col("before") + F.col("ties") <= half).alias("first_half"))
    cut = positions(dated.where(middle).withColumnRenamed("before", "_before").drop("ties"), ["value", result], "indicator")
    equal = Window.partitionBy("indicator", "value", result).orderBy("ts")  # rows that differ in nothing
    cut = cut.select(*rows.columns, (F.col("_before") + F.col("before") + F.row_number().over(equal) <= half).alias("first_half"))
    out = join_by_size(whole.unionByName(cut), rank("value", "rv"), ["indicator", "value"], "ties").drop("ties")
    return out.join(rank(result, "rr").drop("ties"), ["indicator", result])


def rank_indicators(rows: DataFrame, least: int = 5) -> DataFrame:
    """Score of each indicator's values against a result: ``rows`` has indicator, value, result and ts.

    Pearson and rank correlation, share of equal signs, mean result above 0.3 and
    below -0.3, and how alike the correlations of both halves of time are;
    composite 0.25 / 0.25 / 0.2 / 0.15 / 0.15.
    """
    ranked = ranks_and_halves(rows, "result")
    half = lambda side: F.corr(F.when(side, F.col("value")), F.when(side, F.col("result")))
    up, down = F.col("value") > 0.3, F.col("value") < -0.3
    zero = lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    m = ranked.groupBy("indicator").agg(
        F.count("*").alias("n"), zero(F.corr("value", "result")).alias("pearson"), zero(F.corr("rv", "rr")).alias("spearman"),
        share(F.count_if(F.signum("value") == F.signum("result")), F.count("*")).alias("accuracy"),
        F.when(F.count_if(up) > least, F.avg(F.when(up, F.col("result")))).otherwise(0.0).alias("long_return"),
        F.when(F.count_if(down) > least, F.avg(F.when(down, F.col("result")))).otherwise(0.0).alias("short_return"),
        F.greatest(F.lit(0.0), 1 - F.abs(zero(half(F.col("first_half"))) - zero(half(~F.col("first_half"))))).alias("consistency"))
    spread = F.least(F.lit(1.0), F.abs(F.col("long_return") - F.col("short_return")))
    score = F.abs("pearson") * 0.25 + F.col("accuracy") * 0.25 + F.abs("spearman") * 0.2 + spread * 0.15 + F.col("consistency") * 0.15
    return m.withColumn("score", score)


def ranked(scores: DataFrame, by: str, *tie: str) -> DataFrame:
    """Adds the place by falling score.  The input is one row for each name and thus small."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), *tie)))
