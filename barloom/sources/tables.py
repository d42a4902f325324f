"""Canonical bars and trades derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlc(rows: DataFrame, keys: list[Column], price: str, volume: str, order: Column) -> DataFrame:
    """One bar per key: open and close are the first and last price in ``order``.

    A single hash aggregation with partial combine; the order column decides
    open and close, so no sort of the rows is needed.
    """
    return rows.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume): brand by ship date, unit prices."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("price", F.try_divide("l_extendedprice", "l_quantity"))
    return ohlc(rows, [F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("ts")], "price", "l_quantity",
                F.struct("l_orderkey", "l_linenumber", "price"))


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """(symbol, ts, ohlcv): event type by ``unit`` of time, positive values only."""
    rows = table(spark, sf_dir, "events").where("value > 0").select("event_type", "ts", "event_id", "value")
    return ohlc(rows, [F.col("event_type").alias("symbol"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")], "value", "value", F.struct("ts", "event_id"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: a row for each line item, directions and exits from its flags."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = (lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey")))
    return rows.select(
        F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"), F.date_format("l_shipdate", "yyyyMMdd"), "l_returnflag", "l_linestatus")).alias("trade_id"),
        F.col("p_brand").alias("symbol"), F.col("n_regionkey").cast("long").alias("player"), F.col("c_mktsegment").alias("regime"),
        F.when(F.col("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("direction"),
        F.when(F.col("l_returnflag") == "A", "stop_loss").when(F.col("l_returnflag") == "N", "signal").otherwise("take_profit").alias("exit_reason"),
        F.to_date(F.least("o_orderdate", "l_shipdate")).alias("entry_date"), F.to_date(F.greatest("o_orderdate", "l_shipdate")).alias("exit_date"),
        F.col("l_quantity").alias("quantity"), F.try_divide("l_extendedprice", "l_quantity").alias("entry_price"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("total_costs"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("gross_pnl"),
        (F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount"))).alias("net_pnl"),
        (F.col("l_tax") - F.col("l_discount")).alias("net_pnl_pct"), "l_orderkey", "l_linenumber")
