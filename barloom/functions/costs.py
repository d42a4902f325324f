"""Costs of orders, fills, position sizes and price levels as projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates of a broker, an exchange and its taxes, as shares of the value of an order.
BROKERAGE_FLAT = 20.0
BROKERAGE = 0.0003
TAX_INTRADAY_SELL = 0.00025
TAX_DELIVERY = 0.001
EXCHANGE = 0.0000345
REGULATOR = 0.000001
GST = 0.18
STAMP_BUY = 0.00015
SLIPPAGE = 0.0005
USUAL_VOLATILITY = 0.015


def slippage_share(volatility: Column | None = None) -> Column:
    """The usual slippage, scaled by volatility over the usual one between a half and twice."""
    if volatility is None:
        return F.lit(SLIPPAGE)
    ratio = F.least(F.greatest(volatility / USUAL_VOLATILITY, F.lit(0.5)), F.lit(2.0))
    return F.when(volatility > 0, ratio).otherwise(1.0) * SLIPPAGE


def order_costs(value: Column, side: Column, volatility: Column | None = None, delivery: bool = False) -> Column:
    """A struct of the parts and the total of what an order of a value costs; ``side`` is BUY or SELL."""
    buys = side == "BUY"
    brokerage = value * BROKERAGE if delivery else F.lit(BROKERAGE_FLAT)
    tax = value * TAX_DELIVERY if delivery else F.when(buys, 0.0).otherwise(value * TAX_INTRADAY_SELL)
    exchange, regulator = value * EXCHANGE, value * REGULATOR
    gst = (brokerage + exchange) * GST
    stamp = F.when(buys, value * STAMP_BUY).otherwise(0.0)
    slippage = value * slippage_share(volatility)
    return F.struct(brokerage.alias("brokerage"), tax.alias("tax"), exchange.alias("exchange"), regulator.alias("regulator"), gst.alias("gst"),
                    stamp.alias("stamp"), slippage.alias("slippage"), (brokerage + tax + exchange + regulator + gst + stamp + slippage).alias("total"))


def fill_price(price: Column, side: Column, volatility: Column | None = None) -> Column:
    return price * (1 + F.when(side == "BUY", 1).otherwise(-1) * slippage_share(volatility))


def spread(price: Column) -> Column:
    """Half the distance of bid and ask by price tier."""
    return price * F.when(price < 100, 0.001).when(price < 1000, 0.0005).otherwise(0.0003)


def stop_price(entry: Column, atr: Column, long: Column, multiple: float = 2.0) -> Column:
    return F.when(long, entry - atr * multiple).otherwise(entry + atr * multiple)


def target_price(entry: Column, stop: Column, reward: float = 2.0) -> Column:
    """As far from the entry as the stop, times the reward, on the other side."""
    return entry + (entry - stop) * reward


def position_size(capital: Column, entry: Column, stop: Column, risk: float = 0.02, most: float = 0.2) -> Column:
    """Whole units so that neither the risk to the stop nor the value exceeds its share of the capital; 0 without risk."""
    per_unit = F.abs(entry - stop)
    by_risk, by_value = F.floor(F.try_divide(capital * risk, per_unit)), F.floor(F.try_divide(capital * most, entry))
    return F.when((per_unit > 0) & (entry > 0), F.greatest(F.least(by_risk, by_value), F.lit(0))).otherwise(0).cast("long")
