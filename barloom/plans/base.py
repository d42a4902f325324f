"""Registry of queries and the common table expressions of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DAILY = """bars AS (
    SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS ts,
           first(price ORDER BY l_orderkey, l_linenumber, price) AS open, max(price) AS high, min(price) AS low,
           last(price ORDER BY l_orderkey, l_linenumber, price) AS close, sum(l_quantity) AS volume
    FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2
)"""
HOURLY = """bars AS (
    SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
           min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume
    FROM events WHERE value > 0 GROUP BY 1, 2
)"""
TRADES = """trades AS (
    SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
                         strftime(l_shipdate, '%Y%m%d'), l_returnflag, l_linestatus)) AS trade_id,
           p_brand AS symbol, CAST(n_regionkey AS BIGINT) AS player, c_mktsegment AS regime,
           CASE WHEN l_linestatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS direction,
           CASE l_returnflag WHEN 'A' THEN 'stop_loss' WHEN 'N' THEN 'signal' ELSE 'take_profit' END AS exit_reason,
           CAST(least(o_orderdate, l_shipdate) AS DATE) AS entry_date, CAST(greatest(o_orderdate, l_shipdate) AS DATE) AS exit_date,
           l_quantity AS quantity, l_extendedprice / l_quantity AS entry_price, l_extendedprice * l_discount AS total_costs,
           l_extendedprice * l_tax AS gross_pnl, l_extendedprice * (l_tax - l_discount) AS net_pnl, l_tax - l_discount AS net_pnl_pct,
           l_orderkey, l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f
    return register


def shown(x: Column) -> Column:
    """``x`` with six decimals, or nine significant digits where these are fewer.

    Two engines add up in different orders, so values differ in their last bits;
    they are put on a grid whose borders lie off the halves, on which means of
    prices with few decimals often fall.
    """
    size = F.floor(F.log10(F.abs(x)))
    step = F.pow(F.lit(10.0), size - 8)
    text = F.concat(F.floor(x / step + 0.4142).cast("string"), F.lit("E"), (size - 8).cast("string"))
    return F.when(F.abs(x) < 100, F.floor(x * 1e6 + 0.4142) / 1e6).when(F.abs(x) < 1e8, F.floor(x * F.pow(F.lit(10.0), 8 - size) + 0.4142) / F.pow(F.lit(10.0), 8 - size)).when(
        F.abs(x) < 1e300, text.cast("double"))


def shown_sql(x: str) -> str:
    """The same in SQL; ``x`` is a column."""
    size = f"floor(log10(abs({x})))"
    return (f"CASE WHEN abs({x}) < 100 THEN floor({x} * 1e6::DOUBLE + 0.4142::DOUBLE)::BIGINT / 1e6::DOUBLE WHEN abs({x}) < 1e8 THEN floor({x} * pow(10.0::DOUBLE, 8 - {size}) + 0.4142::DOUBLE)::BIGINT / pow(10.0::DOUBLE, 8 - {size}) "
            f"WHEN abs({x}) < 1e300 THEN concat(floor({x} / pow(10.0::DOUBLE, {size} - 8) + 0.4142::DOUBLE)::BIGINT, 'E', ({size} - 8)::BIGINT)::DOUBLE END")
