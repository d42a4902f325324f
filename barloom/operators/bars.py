"""Cleaning, selection and alignment of bar series (long format: one row per symbol and time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

OHLC = ["open", "high", "low", "close"]


def series() -> WindowSpec:
    """All bars of a symbol in order of time."""
    return Window.partitionBy("symbol").orderBy("ts")


def canonical(rows: DataFrame) -> DataFrame:
    """Case-insensitive choice of the bar columns; missing ones are an error."""
    found = {c.lower(): c for c in rows.columns}
    missing = [c for c in ["symbol", "ts", *OHLC, "volume"] if c not in found]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows.select(*(F.col(f"`{found[c]}`").alias(c) for c in ["symbol", "ts", *OHLC, "volume"]))


def clean(rows: DataFrame) -> DataFrame:
    """Numbers or nothing, no missing or non-positive price, no negative volume."""
    out = rows.select("symbol", "ts", *(F.expr(f"try_cast({c} AS double)").alias(c) for c in [*OHLC, "volume"]))
    out = out.na.drop(subset=OHLC).where(" AND ".join(f"{c} > 0 AND NOT isnan({c})" for c in OHLC))
    return out.withColumn("volume", F.greatest(F.coalesce(F.nanvl("volume", F.lit(None)), F.lit(0.0)), F.lit(0.0)))


def dedup(rows: DataFrame, seq: str, keep: str = "last") -> DataFrame:
    """One row per symbol and time: the first or last by the ingest sequence."""
    order = F.col(seq).desc() if keep == "last" else F.col(seq)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(order))).where("_n = 1").drop("_n")


def last_days(bars: DataFrame, days: int) -> DataFrame:
    """Bars of the last ``days`` distinct trading days of each symbol.

    The days are ranked in their own small aggregate, which is joined back.
    """
    day = bars.select("symbol", F.to_date("ts").alias("day")).distinct()
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))
    kept = day.withColumn("_r", rank).where(F.col("_r") <= days).groupBy("symbol").agg(F.min("day").alias("_from"))
    return bars.join(kept, "symbol").where(F.to_date("ts") >= F.col("_from")).drop("_from")


def trading_hours(bars: DataFrame, start: str, end: str, zone: str) -> DataFrame:
    """Bars whose local time of day is in [start, end]; ts is UTC."""
    local = F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone), "HH:mm:ss")
    return bars.where(local.between(start, end))


def split(bars: DataFrame, train: float = 0.67, validation: float = 0.165) -> DataFrame:
    """Adds part: train, validation or holdout by position, cut at the floor of shares of the rows."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    at = F.row_number().over(series())
    cut, cut2 = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + validation))
    return bars.withColumn("part", F.when(at <= cut, "train").when(at <= cut2, "validation").otherwise("holdout"))


def date_ranges(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"), F.countDistinct(F.to_date("ts")).alias("n_days"))


def validation_report(bars: DataFrame, min_rows: int = 252, max_gap_days: int = 10) -> DataFrame:
    """Per symbol: too few rows, long gaps, bars whose high and low do not bound the rest, non-positive prices."""
    gap = F.datediff("ts", F.lag("ts").over(series()))
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    return bars.withColumn("_gap", gap).groupBy("symbol").agg(
        F.count("*").alias("n_rows"), (F.count("*") < min_rows).alias("too_short"), F.count_if(F.col("_gap") > max_gap_days).alias("n_gaps"),
        F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("max_gap"), F.count_if(bad).alias("n_inconsistent"),
        F.count_if(F.least(*OHLC) <= 0).alias("n_non_positive"))


def ffill(x: str | Column, limit: int | None = None, over: WindowSpec | None = None) -> Column:
    """The last known value, at most ``limit`` rows back."""
    return F.last(x, ignorenulls=True).over((over or series()).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def bfill(x: str | Column, limit: int | None = None, over: WindowSpec | None = None) -> Column:
    """The next known value, at most ``limit`` rows ahead: this looks ahead of time."""
    return F.first(x, ignorenulls=True).over((over or series()).rowsBetween(0, Window.unboundedFollowing if limit is None else limit))


def calendar(bars: DataFrame) -> DataFrame:
    """Every symbol at every time at which any symbol has a bar; null where it has none.

    Symbols are few and each time stands once, so the grid is symbols x times by
    design.  Times are collected per day before the grid is laid out, so that the
    explode runs beside the join instead of multiplying rows before a shuffle.
    """
    times = bars.select("ts").distinct().groupBy(F.to_date("ts").alias("day")).agg(F.collect_list("ts").alias("at"))
    spans = bars.groupBy("symbol").agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    days = spans.select("symbol", F.explode(F.sequence("lo", "hi")).alias("day"))
    grid = days.join(times, "day").select("symbol", F.explode("at").alias("ts"))
    return grid.join(bars, ["symbol", "ts"], "left")


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volume; empty bins give none."""
    return bars.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bin")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def up_to(rows: DataFrame, moment: object, at: str = "ts") -> DataFrame:
    """What was known at a moment: rows at or before it."""
    return rows.where(F.col(at) <= F.lit(moment).cast(rows.schema[at].dataType))


def alive(rows: DataFrame, now: object, hours: int, at: str = "ts") -> DataFrame:
    """Rows not older than so many hours."""
    return rows.where(F.col(at) >= F.lit(now).cast(rows.schema[at].dataType) - F.make_dt_interval(hours=F.lit(hours)))


def primary_names(rows: DataFrame, outputs: dict[str, list[str]]) -> DataFrame:
    """Each indicator's first output under the indicator's name; its other outputs go."""
    rename = {cols[0]: name for name, cols in outputs.items() if cols and cols[0] in rows.columns}
    extra = [c for cols in outputs.values() for c in cols[1:] if c in rows.columns]
    return rows.withColumnsRenamed(rename).drop(*extra)


def usable_definitions(definitions: dict[str, bool], bars: DataFrame) -> list[str]:
    """Indicators that these bars allow: those that need volume only where there is some."""
    has_volume = "volume" in bars.columns and bars.where("volume > 0").limit(1).count() > 0
    return [name for name, needs in definitions.items() if has_volume or not needs]
