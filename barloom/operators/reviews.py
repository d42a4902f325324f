"""Reviews of closed trades: ledgers, day characters, patterns, recommendations, patches, risk checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trades import PNL, holding_bucket, in_order, ranks_and_halves, share, wins

# Half-open ranges of signal strength, hours of the day, patches by mistake and by regime.
STRENGTHS = {"very_strong": (0.85, 1.0), "strong": (0.7, 0.85), "moderate": (0.5, 0.7), "weak": (0.3, 0.5)}
HOURS = {"morning_open": (9, 10), "mid_morning": (10, 12), "afternoon": (12, 14), "closing_hour": (14, 16)}
# What may mend a mistake: mistake, option, kind of change, name, change, confidence.
PATCHES = (
    ("early_entry", 1, "threshold", "entry_threshold", 0.05, 0.7),
    ("early_entry", 2, "rule", "momentum_confirm", 1.0, 0.6),
    ("early_entry", 3, "weight", "ADX_14", 0.10, 0.65),
    ("early_entry", 3, "weight", "AROON_14", 0.08, 0.65),
    ("late_entry", 1, "threshold", "entry_threshold", -0.05, 0.6),
    ("late_entry", 2, "weight", "RSI_7", 0.10, 0.55),
    ("late_entry", 2, "weight", "STOCH_5_3", 0.08, 0.55),
    ("early_exit", 1, "threshold", "exit_threshold", -0.05, 0.65),
    ("early_exit", 2, "threshold", "take_profit_atr_mult", 0.5, 0.6),
    ("late_exit", 1, "threshold", "exit_threshold", 0.05, 0.7),
    ("late_exit", 2, "threshold", "stop_loss_atr_mult", -0.3, 0.6),
    ("false_signal", 1, "rule", "volume_filter", 1.0, 0.7),
    ("false_signal", 2, "weight", "CMF_20", 0.10, 0.65),
    ("false_signal", 2, "weight", "OBV", 0.08, 0.65),
    ("false_signal", 3, "rule", "trend_filter", 1.0, 0.6),
    ("overtrading", 1, "rule", "time_filter", 1.0, 0.7),
    ("overtrading", 2, "threshold", "entry_threshold", 0.08, 0.65),
    ("overtrading", 2, "threshold", "exit_threshold", 0.05, 0.65),
)
# The same by the regime that lost most; "off" takes an indicator out.
REGIME_PATCHES = (
    ("volatile", 1, "threshold", "stop_loss_atr_mult", 0.5, 0.6),
    ("volatile", 1, "weight", "ATR_14", 0.10, 0.6),
    ("volatile", 1, "weight", "NATR_14", 0.08, 0.6),
    ("ranging", 1, "rule", "volatility_filter", 1.0, 0.65),
    ("ranging", 1, "weight", "BBANDS_20_2", 0.10, 0.65),
    ("ranging", 1, "weight", "RSI_14", 0.08, 0.65),
    ("trending_down", 1, "off", "SUPERTREND_7_3", 0.0, 0.5),
    ("trending_down", 1, "weight", "ADX_20", 0.10, 0.5),
)


def select_trades(trades: DataFrame, direction: str | None = None, profitable: bool | None = None, since: str | None = None, until: str | None = None, **among: Sequence) -> DataFrame:
    """Trades that meet every given condition; ``among`` has allowed values by column."""
    out = trades
    for column, values in among.items():
        out = out.where(F.col(column).isin(list(values)))
    if direction is not None:
        out = out.where(F.col("direction") == direction)
    if profitable is not None:
        out = out.where(wins() if profitable else ~wins())
    if since is not None:
        out = out.where(F.col("exit_date") >= F.lit(since).cast("date"))
    return out if until is None else out.where(F.col("exit_date") <= F.lit(until).cast("date"))


def ledger(trades: DataFrame, *keys: str) -> DataFrame:
    """Counts and sums of each group, as a ledger keeps them by day or in all; a trade without gain is a loser."""
    out = trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.count_if(wins()).alias("winners"), F.count_if(~wins()).alias("losers"), F.sum("gross_pnl").alias("gross_pnl"),
        F.sum("total_costs").alias("total_costs"), F.sum(PNL).alias("net_pnl"), F.avg(PNL).alias("avg_pnl"), F.max(PNL).alias("best"), F.min(PNL).alias("worst"),
        F.coalesce(F.sum(F.when(wins(), F.col(PNL))), F.lit(0.0)).alias("won"), F.coalesce(F.sum(F.when(~wins(), F.col(PNL))), F.lit(0.0)).alias("lost"))
    return out.withColumn("win_rate", share(F.col("winners"), F.col("n_trades")) * 100)


def profit_factor(won: Column, lost: Column, n_lost: Column, no_losses: float) -> Column:
    """Gains over losses; without a losing trade gains over ``no_losses``, and 0 where losers lost nothing."""
    return F.when(n_lost == 0, won / no_losses).otherwise(share(won, F.abs(lost)))


def day_character(m: DataFrame) -> DataFrame:
    """Adds what kind of day a ledger row shows, and how well it went."""
    good, bad = (F.col("win_rate") > 60) & (F.col("net_pnl") > 0), F.col("win_rate") < 35
    return m.withColumn("character", F.when(good, "trending").when(bad, "choppy").otherwise("mixed")).withColumn("fit", F.when(good, "good").when(bad, "poor").otherwise("mixed"))


def opportunities(m: DataFrame) -> DataFrame:
    """Adds the kinds of change that a ledger row with its profit factor calls for."""
    pf = F.col("profit_factor")
    return m.withColumn("changes", F.array_compact(F.array(F.when(F.col("win_rate") < 40, F.lit("threshold_change")), F.when((pf > 0) & (pf < 1), F.lit("risk_param")))))


def hour_cluster(hour: Column) -> Column:
    out = F.lit(None)
    for name, (lo, hi) in HOURS.items():
        out = F.when((hour >= lo) & (hour < hi), name).otherwise(out)
    return out


def regime_performance(trades: DataFrame, regimes: DataFrame) -> DataFrame:
    """Results by the regime of the symbol on the entry day, UNKNOWN where it has no bar, and each regime's share of all bars."""
    at = regimes.select("symbol", F.col("ts").cast("date").alias("entry_date"), F.col("regime").alias("found"))
    rows = trades.drop("regime").join(at, ["symbol", "entry_date"], "left").withColumn("regime", F.coalesce("found", F.lit("UNKNOWN")))
    long, short = F.col("direction") == "LONG", F.col("direction") == "SHORT"
    m = rows.groupBy("regime").agg(
        F.count("*").alias("n_trades"), share(F.count_if(wins()), F.count("*")).alias("win_rate"), F.avg(PNL).alias("avg_pnl"), F.sum(PNL).alias("total_pnl"),
        (share(F.avg("net_pnl_pct"), F.stddev_pop("net_pnl_pct")) * F.sqrt(F.lit(252.0))).alias("sharpe"),
        share(F.count_if(long & wins()), F.count_if(long)).alias("long_win_rate"), share(F.count_if(short & wins()), F.count_if(short)).alias("short_win_rate"))
    bars = regimes.groupBy("regime").agg(F.count("*").alias("_n"))
    time = bars.withColumn("share_of_time", share(F.col("_n"), F.sum("_n").over(Window.partitionBy()))).drop("_n")  # one row a regime
    out = m.join(time, "regime", "left").withColumn("share_of_time", F.coalesce("share_of_time", F.lit(0.0)))
    lean = F.col("long_win_rate") - F.col("short_win_rate")
    insight = F.when(F.col("n_trades") < 10, None).when(F.col("win_rate") > 0.55, "strong").when(F.col("win_rate") < 0.45, "weak").otherwise("even")
    return out.withColumn("insight", insight).withColumn("favours", F.when(lean > 0.15, "longs").when(lean < -0.15, "shorts"))


def strength_bucket(si: Column) -> Column:
    size, out = F.abs(si), F.lit(None)
    for name, (lo, hi) in STRENGTHS.items():
        out = F.when((size >= lo) & (size < hi), name).otherwise(out)
    return out


def patterns(trades: DataFrame, si: str, *keys: str, least: int = 10) -> DataFrame:
    """(keys, name, n, win_rate, avg_pnl, confidence) of four detectors: signal strength, holding period, direction, exit reason.

    A strength counts where its win rate differs by more than 0.05 from that of
    all trades, and is the surer the more it differs; the others are the surer
    the more trades they have.  All are groups of one aggregation.
    """
    days = F.datediff("exit_date", "entry_date")
    named = F.array(
        F.struct(F.concat(F.lit("signal_strength_"), strength_bucket(F.col(si))).alias("name"), F.lit(0).alias("full")), F.struct(F.concat(F.lit("holding_"), holding_bucket(days)).alias("name"), F.lit(50).alias("full")),
        F.struct(F.concat(F.lit("direction_"), F.lower("direction")).alias("name"), F.lit(50).alias("full")), F.struct(F.concat(F.lit("exit_"), F.coalesce("exit_reason", F.lit("unknown"))).alias("name"), F.lit(30).alias("full")),
        F.struct(F.lit("all").alias("name"), F.lit(-1).alias("full")))
    rows = trades.select(*keys, wins().alias("_won"), F.col(PNL), F.explode(named).alias("p")).where("p.name IS NOT NULL")
    m = rows.groupBy(*keys, F.col("p.name").alias("name"), F.col("p.full").alias("full")).agg(F.count("*").alias("n"), share(F.count_if("_won"), F.count("*")).alias("win_rate"), F.avg(PNL).alias("avg_pnl"))
    m = m.withColumn("_all", F.max(F.when(F.col("full") == -1, F.col("win_rate"))).over(Window.partitionBy(*keys)))
    differs = F.abs(F.col("win_rate") - F.col("_all"))
    confidence = F.when(F.col("full") == 0, F.least(F.lit(1.0), differs * 5)).otherwise(F.least(F.lit(1.0), F.col("n") / F.col("full")))
    kept = (F.col("full") >= 0) & (F.col("n") >= least) & ((F.col("full") > 0) | (differs > 0.05))
    return m.where(kept).select(*keys, "name", "n", "win_rate", "avg_pnl", confidence.alias("confidence"))


def combination_patterns(rows: DataFrame, *keys: str, least: int = 10, apart: float = 0.15) -> DataFrame:
    """(keys, name, direction, n, win_rate, confidence) of the fifth detector: pairs of indicators whose signs agree more often among winners, or among losers.

    ``rows`` has net_pnl and a map ``snapshot``; a value of 0 or null has no sign.  Pairs with
    ``least`` winners and losers count whose rates of agreement are more than ``apart``
    apart; aligned ones win when they agree, divergent ones when they do not.
    """
    signs = F.filter(F.transform(F.array_sort(F.map_entries("snapshot")), lambda e: F.struct(e["key"].alias("k"), F.signum(e["value"]).alias("s"))), lambda e: e["s"] != 0)
    pairs = F.flatten(F.transform("e", lambda x: F.transform(F.filter("e", lambda y: y["k"] > x["k"]), lambda y: F.struct(x["k"].alias("a"), y["k"].alias("b"), (x["s"] == y["s"]).alias("same")))))
    each = rows.select(*keys, wins().alias("_won"), signs.alias("e")).select(*keys, "_won", F.explode(pairs).alias("p"))
    won, same = F.col("_won"), F.col("p.same")
    m = each.groupBy(*keys, F.concat_ws("_", F.lit("combo"), "p.a", "p.b").alias("name")).agg(
        F.count_if(won).alias("_w"), F.count_if(~won).alias("_l"), share(F.count_if(won & same), F.count_if(won)).alias("_wa"), share(F.count_if(~won & same), F.count_if(~won)).alias("_la"))
    gap = F.col("_wa") - F.col("_la")
    found = m.where((F.col("_w") >= least) & (F.col("_l") >= least) & (F.abs(gap) > apart))
    return found.select(*keys, "name", F.when(gap > 0, "aligned").otherwise("divergent").alias("direction"), (F.col("_w") + F.col("_l")).alias("n"),
                        F.when(gap > 0, F.col("_wa")).otherwise(1 - F.col("_la")).alias("win_rate"), F.least(F.lit(1.0), F.abs(gap) * 3).alias("confidence"))


def threshold_advice(found: DataFrame, *keys: str, least: float = 0.5) -> DataFrame:
    """What the five surest patterns of a group advise for the entry threshold and the stop, and how sure they are on the mean."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "name"))
    top = found.withColumn("place", place).where(F.col("place") <= 5)
    sure = F.col("confidence") >= least
    entry = F.when(sure & (F.col("name") == "signal_strength_very_strong") & (F.col("win_rate") > 0.6), 0.05).when(sure & (F.col("name") == "signal_strength_weak") & (F.col("win_rate") < 0.4), -0.05)
    stop = F.when(sure & F.col("name").startswith("exit_stop") & (F.col("avg_pnl") < 0), 0.9)
    return top.groupBy(*keys).agg(F.coalesce(F.max_by(entry, F.when(entry.isNotNull(), F.col("place"))), F.lit(0.0)).alias("entry_change"), F.coalesce(F.max(stop), F.lit(1.0)).alias("stop_factor"), F.avg("confidence").alias("confidence"))


def performance_notes(m: DataFrame) -> DataFrame:
    """Adds what overall metrics suggest, and the factor for stops after a deep fall."""
    wr, sharpe, dd, pf = (F.col(c) for c in ("win_rate", "sharpe", "max_drawdown", "profit_factor"))
    notes = F.array(F.when(wr < 0.4, "low_win_rate").when(wr > 0.6, "high_win_rate"), F.when(sharpe < 0.5, "low_sharpe").when(sharpe > 1.5, "high_sharpe"),
                    F.when(dd > 0.2, "deep_drawdown"), F.when(pf < 1.2, "low_profit_factor").when(pf > 2, "high_profit_factor"))
    return m.withColumn("notes", F.array_compact(notes)).withColumn("stop_factor", F.when(dd > 0.2, 0.85).otherwise(1.0))


def holdout_check(rows: DataFrame, train: str, holdout: str, best: str, gap: float = 0.3, tolerance: float = 0.2) -> DataFrame:
    """Adds ``verdict``: overfit where the holdout falls far below training, degraded where it falls below the best so far."""
    t, h, b = F.col(train), F.col(holdout), F.col(best)
    behind = F.when(t > 0, (t - h) / t).otherwise(0.0)
    return rows.withColumn("verdict", F.when(behind > gap, "overfit").when((b > 0) & ((b - h) / b > tolerance), "degraded").otherwise("passed"))


def _changes(of: Column, table: tuple) -> Column:
    """The rows of a table of patches for a mistake or regime, as an array."""
    out = F.lit(None).cast("array<struct<option:int,kind:string,name:string,change:double,confidence:double>>")
    for key in dict.fromkeys(r[0] for r in table):
        rows = [F.struct(*(F.lit(x).alias(n) for x, n in zip(r[1:], ("option", "kind", "name", "change", "confidence")))) for r in table if r[0] == key]
        out = F.when(of == key, F.array(*rows)).otherwise(out)
    return out


def candidate_patches(mistakes: DataFrame) -> DataFrame:
    """Adds option, kind, name, change, confidence and priority: a row for each change of each patch for a mistake, by a fixed table.

    ``mistakes`` has mistake, their number ``n`` and their cost ``impact``.  Cost and number raise the
    priority by up to two each from five; it is scaled by the patch's
    confidence and lies between 1 and 10.
    """
    size = F.abs("impact")
    base = 5 + F.when(size > 10_000, 2).when(size > 5_000, 1).otherwise(0) + F.when(F.col("n") >= 10, 2).when(F.col("n") >= 5, 1).otherwise(0)
    out = mistakes.withColumn("_base", base).withColumn("p", F.explode(_changes(F.col("mistake"), PATCHES)))
    priority = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("_base") * F.col("p.confidence")).cast("int")))
    return out.select(*mistakes.columns, "p.*", priority.alias("priority"))


def worst_regime_patch(performance: DataFrame) -> DataFrame:
    """(regime, option, kind, name, change, confidence, priority, gain), a row a change, for the regime that lost most, if one lost and has a patch."""
    worst = performance.agg(F.min_by(F.struct("regime", "total_pnl"), F.struct("total_pnl", "regime")).alias("w")).select("w.*").where("total_pnl < 0")
    found = worst.withColumn("p", F.explode(_changes(F.col("regime"), REGIME_PATCHES)))
    return found.select("regime", "p.*", F.lit(7).alias("priority"), (F.abs("total_pnl") * 0.2).alias("gain"))


def apply_changes(strategy: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, name, value) of a strategy after a patch.

    Thresholds and weights are added to, weights stay in [-1, 1], rules are 1 when
    they are on, "off" sets a weight to 0.  What the strategy lacks counts as 0 before; of several
    changes of one name the sum counts, and "off" above all.
    """
    kind = F.when(F.col("kind") == "off", "weight").otherwise(F.col("kind"))
    by_name = changes.groupBy(*keys, kind.alias("kind"), "name").agg(F.sum("change").alias("_change"), F.max(F.col("kind") == "off").alias("_off"))
    both = strategy.join(by_name, [*keys, "kind", "name"], "full")
    moved = F.coalesce("value", F.lit(0.0)) + F.coalesce("_change", F.lit(0.0))
    new = F.when(F.coalesce("_off", F.lit(False)), 0.0).when(F.col("kind") == "weight", F.least(F.greatest(moved, F.lit(-1.0)), F.lit(1.0))).when(
        F.col("kind") == "rule", F.when(moved > 0, 1.0).otherwise(0.0)).otherwise(moved)
    return both.select(*keys, "kind", "name", F.round(new, 9).alias("value"))


def position_check(rows: DataFrame, value: Column, most_share: float = 0.2, most_risk: float = 0.02, tolerance: float = 1.1) -> DataFrame:
    """Adds ``check`` for a proposed trade (entry_price, stop, quantity, direction) in a portfolio of ``value``: size first, then risk with its tolerance."""
    size = F.col("entry_price") * F.col("quantity")
    risk = F.when(F.col("direction") == "LONG", F.col("entry_price") - F.col("stop")).otherwise(F.col("stop") - F.col("entry_price")) * F.col("quantity")
    return rows.withColumn("check", F.when(size > value * most_share, "too_large").when(risk > value * most_risk * tolerance, "too_risky").otherwise("ok"))


def risk_counters(trades: DataFrame, *keys: str, loss_limit: float = 5_000.0, most_trades: int = 20) -> DataFrame:
    """For each trade in exit order: the day's trades and result so far, losses in a row, and what remains of the day's limits.

    Counters of the day start again every day; losses in a row go on.
    """
    w = Window.partitionBy(*keys).orderBy(*in_order())
    day = Window.partitionBy(*keys, "exit_date").orderBy(*in_order()).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.select(*keys, *in_order(), PNL).withColumns({
        "trades_today": F.count("*").over(day), "pnl_today": F.sum(PNL).over(day), "_rn": F.row_number().over(w)})
    last_other = F.max(F.when(F.col(PNL) >= 0, F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("losses_in_a_row", F.col("_rn") - F.coalesce(last_other, F.lit(0)))
    return rows.drop("_rn").withColumns({"pnl_remaining": F.col("pnl_today") + loss_limit, "trades_remaining": F.lit(most_trades) - F.col("trades_today")})


def halts(trades: DataFrame, *keys: str, capital: float = 100_000.0, daily: float = 0.02, weekly: float = 0.05) -> DataFrame:
    """Days on which the day's or the week's result so far breaks its limit, with which one; the day's comes first."""
    days = trades.groupBy(*keys, "exit_date").agg(F.sum(PNL).alias("pnl"))
    week = Window.partitionBy(*keys, F.trunc("exit_date", "week")).orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumn("week_pnl", F.sum("pnl").over(week))
    return rows.withColumn("halt", F.when(F.col("pnl") < -capital * daily, "daily").when(F.col("week_pnl") < -capital * weekly, "weekly")).where("halt IS NOT NULL")


def contribution_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """By indicator: the sums of ``value`` over winners and over losers, and the first less the size of the second."""
    out = rows.groupBy("indicator", *keys).agg(*(F.coalesce(F.sum(F.when(side, F.col("value"))), F.lit(0.0)).alias(n) for n, side in (("win_sum", wins()), ("loss_sum", ~wins()))))
    return out.withColumn("net", F.col("win_sum") - F.abs("loss_sum"))


def standardised(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """``column`` as deviations from the mean of its group, or as it is where it does not vary."""
    m = rows.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    joined = rows.join(m, list(keys)) if keys else rows.crossJoin(m)  # the moments are one row
    return joined.withColumn(column, F.when(F.col("_s") > 0, (F.col(column) - F.col("_m")) / F.col("_s")).otherwise(F.col(column))).drop("_m", "_s")


def trade_scores(rows: DataFrame, least: int = 5) -> DataFrame:
    """Score of each indicator on trades: ``rows`` has indicator, weight, value, net_pnl, direction and an order ``ts``.

    A positive weight expects equal signs of value and result, a negative one
    opposite signs.  Means above 0.3 and below -0.3 need more than 3 trades,
    accuracies by direction ``least``.  Consistency is the smaller correlation of
    both halves where these have one sign.
    """
    v, pnl, long = F.col("value"), F.col(PNL), F.col("direction") == "LONG"
    ranked = ranks_and_halves(rows, PNL)
    zero = lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    half = lambda side: zero(F.corr(F.when(side, v), F.when(side, pnl)))
    agrees = F.when(F.col("weight") >= 0, ((v > 0) & (pnl > 0)) | ((v < 0) & (pnl < 0))).otherwise(((v < 0) & (pnl > 0)) | ((v > 0) & (pnl < 0)))
    mean = lambda side: F.when(F.count_if(side) > 3, F.avg(F.when(side, pnl))).otherwise(0.0)
    by_side = lambda side, right: F.when(F.count_if(side) >= least, share(F.count_if(side & right & (pnl > 0)), F.count_if(side))).otherwise(0.0)
    m = ranked.groupBy("indicator").agg(
        F.count("*").alias("n"), zero(F.corr("value", PNL)).alias("pearson"), zero(F.corr("rv", "rr")).alias("spearman"), share(F.count_if(agrees), F.count("*")).alias("accuracy"),
        mean(v > 0.3).alias("bullish"), mean(v < -0.3).alias("bearish"), by_side(long, v > 0).alias("long_accuracy"), by_side(~long, v < 0).alias("short_accuracy"),
        half(F.col("first_half")).alias("_a"), half(~F.col("first_half")).alias("_b"))
    return m.withColumn("consistency", F.when(F.col("_a") * F.col("_b") > 0, F.least(F.abs("_a"), F.abs("_b"))).otherwise(0.0)).drop("_a", "_b")


def trend_strength(adx: Column, macd_hist: Column, ema_diff: Column) -> Column:
    """Mean of three terms: ADX in hundreds, and the sizes of the histogram (over 2) and of the EMA distance (over 0.02), each up to 1."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return (z(adx) / 100 + F.least(F.abs(z(macd_hist)) / 2, F.lit(1.0)) + F.least(F.abs(z(ema_diff)) / 0.02, F.lit(1.0))) / 3


def adjusted_signal(si: Column, was: Column, now: Column, confidence: Column, original: Column) -> Column:
    """A signal after a second opinion: 0 on hold, turned to the new direction, else scaled by the ratio of confidences, at most 1.5."""
    scaled = si * F.least(confidence / F.greatest(original, F.lit(0.1)), F.lit(1.5))
    changed = was != now
    return F.when(changed & (now == "hold"), 0.0).when(changed & (now == "long") & (si < 0), F.abs(si)).when(changed & (now == "short") & (si > 0), -F.abs(si)).otherwise(scaled)


def run_trend(results: DataFrame, run: str, value: str, *keys: str) -> DataFrame:
    """First, last and best result of each key's runs, and the change from first to last in percent of the first's size."""
    m = results.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.min_by(value, run).alias("first"), F.max_by(value, run).alias("last"), F.max(value).alias("best"))
    change = F.when(F.col("first") == 0, F.when(F.col("last") > 0, 100.0).otherwise(0.0)).otherwise((F.col("last") - F.col("first")) / F.abs("first") * 100)
    return m.withColumn("improvement", change)


def tick_bars(ticks: DataFrame, n: int, price: str, volume: str, order: list[str], *keys: str) -> DataFrame:
    """Bars of ``n`` ticks each in order; the last of a key may be partial, which ``complete`` tells."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = ticks.withColumn("_rn", F.row_number().over(w)).withColumn("bar", F.floor((F.col("_rn") - 1) / n).cast("int"))
    return rows.groupBy(*keys, "bar").agg(F.min_by(price, "_rn").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "_rn").alias("close"),
                                          F.sum(volume).alias("volume"), (F.count("*") == n).alias("complete"))


def page_of(offset: Column, starts: Column) -> Column:
    """The number, from 1, of the page that holds a place: the last of the ascending ``starts`` at or before it."""
    return F.greatest(F.lit(1), F.size(F.filter(starts, lambda s: s <= offset)))


def definition(name: Column, known: Sequence[str]) -> Column:
    """The registered name for an output: itself, or the first registered one with the same part before the first underscore."""
    out = F.lit(None)
    for k in reversed(known):
        out = F.when(F.substring_index(name, "_", 1) == k.split("_")[0], F.lit(k)).otherwise(out)
    return F.when(name.isin(list(known)), name).otherwise(out)


def risk_sections(text: Column, most: int = 50_000) -> Column:
    """The risk factors of a filing: from their heading to the next item, or to the end; at most ``most`` characters."""
    first = F.regexp_extract(text, r"(?is)item\s*1a\.?\s*(?:[-–—:]\s*)?risk\s+factors(.*?)item\s*(?:1b|2)\b", 1)
    rest = F.regexp_extract(text, r"(?is)risk\s+factors(.*)", 1)
    return F.substring(F.btrim(F.when(first != "", first).otherwise(rest)), 1, most)


def monthly_report(trades: DataFrame, *keys: str) -> DataFrame:
    """One row a month: trades, win rate, result, days with trades, days that gained, the best and the worst day."""
    month = F.trunc("exit_date", "month").alias("month")
    days = trades.groupBy(*keys, month, "exit_date").agg(F.count("*").alias("n"), F.count_if(wins()).alias("won"), F.sum(PNL).alias("pnl"))
    return days.groupBy(*keys, "month").agg(
        F.sum("n").alias("n_trades"), share(F.sum("won"), F.sum("n")).alias("win_rate"), F.sum("pnl").alias("net_pnl"), F.count("*").alias("n_days"), F.count_if(F.col("pnl") > 0).alias("good_days"),
        F.max("pnl").alias("best_day"), F.min("pnl").alias("worst_day"))


def frequent(rows: DataFrame, column: str, n: int, *keys: str) -> DataFrame:
    """The n most frequent values of a column for each key, of equals the smaller; counts are few rows a key."""
    counts = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), column))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def context(trades: DataFrame, by: str, *keys: str, n: int = 3, least: int = 3, low: float = 0.2, high: float = 0.7) -> DataFrame:
    """What to tell about the values of ``by``: the n best and the n worst by result, and those with an alarming or a high win rate.

    A value may have several rows; its ``kind`` says why it is told.
    """
    m = trades.groupBy(*keys, by).agg(F.count("*").alias("n_trades"), share(F.count_if(wins()), F.count("*")).alias("win_rate"), F.sum(PNL).alias("total_pnl"))
    up, down = (F.row_number().over(Window.partitionBy(*keys).orderBy(o, by)) for o in (F.desc("total_pnl"), F.asc("total_pnl")))
    known = F.col("n_trades") >= least
    m = m.withColumns({"_up": up, "_down": down})
    kinds = F.array_compact(F.array(F.when(F.col("_up") <= n, F.lit("best")), F.when(F.col("_down") <= n, F.lit("worst")), F.when(known & (F.col("win_rate") <= low), F.lit("avoid")), F.when(known & (F.col("win_rate") >= high), F.lit("favour"))))
    return m.select(*keys, by, "n_trades", "win_rate", "total_pnl", F.explode(kinds).alias("kind"))


def live_record(results: DataFrame, version: str, n: str, values: list[str], *keys: str) -> DataFrame:
    """Adds to each version of a strategy the means of its values over all versions so far, weighted by their numbers of trades."""
    w = Window.partitionBy(*keys).orderBy(version).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(n).over(w)
    return results.withColumns({f"live_{v}": share(F.sum(F.col(v) * F.col(n)).over(w), total) for v in values}).withColumn("live_trades", total)


def diagnosis(found: DataFrame, *keys: str, told: dict[str, str] | None = None) -> DataFrame:
    """(keys, mistake, n, impact, text): mistakes of trades added up, with a text from ``told`` that overrides the plain one."""
    m = found.groupBy(*keys, "mistake").agg(F.count("*").alias("n"), F.sum(PNL).alias("impact"))
    text = F.concat_ws(" ", F.replace("mistake", F.lit("_"), F.lit(" ")), F.lit("in"), F.col("n").cast("string"), F.lit("trades"))
    for name, own in (told or {}).items():
        text = F.when(F.col("mistake") == name, F.lit(own)).otherwise(text)
    return m.withColumn("text", text)
