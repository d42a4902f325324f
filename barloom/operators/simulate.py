"""Rule-based portfolios simulated bar by bar, one group for each run and portfolio."""

from __future__ import annotations

from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import costs
from ..functions.normalise import combine

TRADES = ("run_id string, portfolio string, symbol string, direction string, entry_date date, exit_date date, entry_price double, exit_price double, "
          "quantity long, gross_pnl double, total_costs double, net_pnl double, exit_reason string, bars int")


@dataclass(frozen=True)
class Rules:
    """Parameters of one run.

    ``take_profit`` of 0 never takes profit; with ``long_only`` no shorts are
    opened; ``loss_limit`` is the share of the starting capital whose loss on a
    day stops that day's entries, ``week_limit`` (0: none) that of a week; after a
    stop no entry for ``cooldown`` times.  ``max_value`` (0: none) bounds a
    position.  With ``accounting`` "corrected" cash moves by net results; with
    "inflated" an entry costs its fees only and an exit returns the whole value
    of the position besides its result, so that later sizes grow, and fills carry
    the slippage, as some published backtests keep their books.
    """

    run_id: str = "base"
    capital: float = 100_000.0
    size: float = 0.1
    enter: float = 0.5
    leave: float = 0.2
    stop: float = 2.0
    take_profit: float = 3.0
    max_positions: int = 5
    max_entries: int = 10
    loss_limit: float = 0.02
    cooldown: int = 3
    warm_up: int = 0
    long_only: bool = False
    week_limit: float = 0.0
    max_value: float = 0.0
    accounting: str = "corrected"


#: More runs than this are refused; so many go through one pass over a portfolio's bars.
MAX_RUNS, RUNS_AT_ONCE = 10_000, 64


def runs_table(spark: SparkSession, runs: list[Rules]) -> DataFrame:
    kinds = {"str": "string", "float": "double", "int": "int", "bool": "boolean"}
    return spark.createDataFrame([tuple(getattr(r, f.name) for f in fields(Rules)) for r in runs], ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Rules)))


def _cost(value: float, buys: bool) -> float:
    fee = costs.BROKERAGE_FLAT + value * costs.EXCHANGE
    return fee * (1 + costs.GST) + value * (costs.REGULATOR + costs.SLIPPAGE + (costs.STAMP_BUY if buys else costs.TAX_INTRADAY_SELL))


def _exit(held: dict, high: float, low: float, close: float, si: float, r: Rules) -> tuple[float, str] | None:
    """Where and why a position leaves on this bar: the stop comes first, then the target, then the signal."""
    side = held["side"]
    worst, best = (low, high) if side > 0 else (high, low)
    if (worst - held["stop"]) * side <= 0:
        return held["stop"], "stop_loss"
    if r.take_profit and (best - held["target"]) * side >= 0:
        return held["target"], "take_profit"
    if si * side < -r.leave:
        return close, "signal"
    return None


def simulate_portfolio(b: pd.DataFrame, r: Rules) -> list[tuple]:
    """Trades of one portfolio.  ``b`` is sorted by time and symbol; its symbols share capital and limits.

    What is still held at the end closes at each symbol's last price.
    """
    inflated = r.accounting == "inflated"
    slip = costs.SLIPPAGE if inflated else 0.0
    cash, day, entries, day_pnl, free_at, step = r.capital, None, 0, 0.0, 0, 0
    week, week_pnl = None, 0.0
    book: dict[str, dict] = {}
    last: dict[str, tuple] = {}
    seen: dict[str, int] = {}
    out: list[tuple] = []

    def close_at(symbol: str, ts: object, price: float, why: str) -> float:
        nonlocal cash
        h = book.pop(symbol)
        filled = price * (1 - h["side"] * slip)
        fee = _cost(filled * h["n"], h["side"] < 0)
        gross = (filled - h["filled"]) * h["n"] * h["side"]
        gain = gross - fee if inflated else gross - h["fee"] - fee
        cash += gain + (h["price"] * h["n"] if inflated else 0.0)
        out.append((r.run_id, symbol, "LONG" if h["side"] > 0 else "SHORT", h["ts"], ts, h["price"], price, h["n"], gross, h["fee"] + fee, gain, why, seen[symbol] - h["bar"]))
        return gain

    before = None
    for symbol, ts, high, low, close, si, atr in zip(b["symbol"], b["ts"], *(b[c].to_numpy(float) for c in ("high", "low", "close", "si", "atr"))):
        if ts != before:
            step, before = step + 1, ts
        if ts != day:
            day, entries, day_pnl = ts, 0, 0.0
            if (this := ts.isocalendar()[:2]) != week:
                week, week_pnl = this, 0.0
        seen[symbol] = seen.get(symbol, 0) + 1
        last[symbol] = (ts, close)
        if symbol in book:
            leaving = _exit(book[symbol], high, low, close, si, r)
            if leaving:
                gain = close_at(symbol, ts, *leaving)
                day_pnl += gain
                week_pnl += gain
                if leaving[1] == "stop_loss":
                    free_at = step + r.cooldown
            continue
        blocked = (len(book) >= r.max_positions or entries >= r.max_entries or step < free_at or seen[symbol] <= r.warm_up or day_pnl <= -r.capital * r.loss_limit
                   or (r.week_limit and week_pnl <= -r.capital * r.week_limit))
        if blocked or not abs(si) >= r.enter or not atr > 0 or (r.long_only and si < 0):
            continue
        value = max(0.0, cash) * r.size
        n = int((min(value, r.max_value) if r.max_value else value) / close)
        if n < 1:
            continue
        side = 1 if si > 0 else -1
        filled = close * (1 + side * slip)
        fee = _cost(filled * n, side > 0)
        book[symbol] = {"side": side, "ts": ts, "price": close, "filled": filled, "n": n, "stop": close - side * r.stop * atr, "target": close + side * r.take_profit * atr, "fee": fee, "bar": seen[symbol]}
        cash -= fee if inflated else 0.0
        entries += 1
    for symbol in sorted(book):
        close_at(symbol, *last[symbol], "end")
    return out


def simulate(bars: DataFrame, runs: DataFrame) -> DataFrame:
    """Trades of every run over every portfolio.

    ``bars`` has portfolio, symbol, ts (date), high, low, close, si and atr.  A
    group is one portfolio with up to RUNS_AT_ONCE runs: its bars are bounded by
    calendar time and its number of symbols, and are sorted once for all these
    runs.  Groups are independent, so portfolios times parts of the run table is
    what spreads over the cluster.  ``runs`` is a small table of ``Rules``, whose
    size is checked.
    """
    names = [f.name for f in fields(Rules)]
    known = [Rules(*row) for row in runs.select(*names).limit(MAX_RUNS + 1).collect()]
    if len(known) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs: simulate them in parts")
    if unknown := {r.accounting for r in known} - {"corrected", "inflated"}:
        raise ValueError(f"unknown accounting {sorted(unknown)}")
    parts = max(1, -(-len(known) // RUNS_AT_ONCE))
    columns = ["symbol", "ts", "high", "low", "close", "si", "atr"]
    dealt = bars.select("portfolio", *columns, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        part, portfolio = int(b["part"].iloc[0]), b["portfolio"].iloc[0]
        b = b.sort_values(["ts", "symbol"], kind="stable")
        rows = [t for rules in known[part::parts] for t in simulate_portfolio(b, rules)]
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in TRADES.split(", ") if not c.startswith("portfolio")])
        frame.insert(1, "portfolio", portfolio)
        return frame

    return dealt.groupBy("portfolio", "part").applyInPandas(run, T.StructType.fromDDL(TRADES))


def genome_runs(bars: DataFrame, genomes: dict[str, dict[str, float]], rules: Rules = Rules()) -> DataFrame:
    """Trades of one set of rules for each genome: its signal is tanh(1.5 x) of the weighted mean of the bars' indicator columns.

    ``bars`` has the indicator columns, normalised to [-1, 1]; a missing value
    counts as 0.  ``genomes`` is a population, bounded by its size.
    """
    signals = F.array(*(F.struct(F.lit(name).alias("run_id"), combine(weights).alias("si")) for name, weights in genomes.items()))
    rows = bars.select("portfolio", "symbol", "ts", "high", "low", "close", "atr", F.explode(signals).alias("g")).select(
        F.concat_ws("|", "g.run_id", "portfolio").alias("portfolio"), "symbol", "ts", "high", "low", "close", F.col("g.si").alias("si"), "atr")
    out = simulate(rows, runs_table(bars.sparkSession, [rules]))
    return out.withColumn("run_id", F.substring_index("portfolio", "|", 1)).withColumn("portfolio", F.substring_index("portfolio", "|", -1))


def equity_curve(trades: DataFrame, capital: float, *keys: str) -> DataFrame:
    """(keys, ts, equity): capital and the results closed so far, on each day with an exit."""
    daily = trades.groupBy(*keys, F.col("exit_date").alias("ts")).agg(F.sum("net_pnl").alias("pnl"))
    return daily.select(*keys, "ts", (F.sum("pnl").over(Window.partitionBy(*keys).orderBy("ts")) + capital).alias("equity"))


def pair_fills(fills: DataFrame, *keys: str) -> DataFrame:
    """Entries with the exits that follow them: ``fills`` has kind (entry or exit), ts and price.

    An entry that another entry follows stays open; an exit without an entry is left out.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "kind")
    nxt = {c: F.lead(c).over(w) for c in ("kind", "ts", "price")}
    rows = fills.select(*keys, "kind", "ts", "price", *(x.alias(f"next_{c}") for c, x in nxt.items())).where("kind = 'entry'")
    closed = F.col("next_kind") == "exit"
    return rows.select(*keys, F.col("ts").alias("entry_ts"), F.col("price").alias("entry_price"), F.when(closed, F.col("next_ts")).alias("exit_ts"), F.when(closed, F.col("next_price")).alias("exit_price"))
