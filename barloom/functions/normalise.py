"""Normalisers to [-1, 1] that never look ahead, and the weighted combination of indicators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.analytics import percentile_of
from ..operators.bars import series

#: Rows that an expanding statistic needs before it says anything.
LEAST = 20


def clip(x: Column, lo: float, hi: float) -> Column:
    """x between lo and hi; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def bounded(x: Column, lo: float, hi: float) -> Column:
    """An indicator with a fixed range, scaled about its middle."""
    half = (hi - lo) / 2
    return clip((x - (lo + hi) / 2) / half, -1, 1)


def squash(z: Column) -> Column:
    """z clipped at three deviations, then tanh of its half."""
    return F.tanh(clip(z, -3, 3) * 0.5)


def _z(x: Column, w: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(w) >= least, F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def adaptive(x: Column, least: int = LEAST, over: WindowSpec | None = None) -> Column:
    """Squashed z-score against all rows so far, this one included; 0 while it is undefined."""
    w = (over or series()).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(squash(_z(x, w, least)), F.lit(0.0))


def percentile(x: Column, lookback: int = 252, least: int = LEAST, over: WindowSpec | None = None) -> Column:
    """2p - 1 for the share p of the ``lookback`` rows before this one; bounded, so a long series stays linear."""
    prior = F.collect_list(x).over((over or series()).rowsBetween(-lookback, -1))
    return F.when(F.size(prior) >= least, percentile_of(prior, x) * 2 - 1)


def price_relative(x: Column, price: Column, over: WindowSpec | None = None) -> Column:
    """The adaptive value of the distance from the price, in shares of it."""
    return adaptive(F.try_divide(x - price, price), over=over)


def point_in_time(x: Column, least: int = LEAST, over: WindowSpec | None = None) -> Column:
    """Squashed z-score against the rows before this one only."""
    w = (over or series()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(squash(_z(x, w, least)), F.lit(0.0))


def method(category: str, lo: float | None, hi: float | None) -> str:
    """Which normaliser fits an indicator: a known range first, then its category."""
    if lo is not None and hi is not None:
        return "bounded"
    return {"volume": "percentile", "overlap": "price_relative"}.get(category, "adaptive")


def combine(weights: dict[str, float], known_only: bool = False, sharpen: float | None = 1.5) -> Column:
    """The weighted mean of normalised columns, by default through tanh(1.5 x).

    A missing value counts as 0 with its weight, or with ``known_only`` is left
    out of both sums.  Without any weight the result is 0.
    """
    if not weights:
        return F.lit(0.0)
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) * float(w) for c, w in weights.items()), F.lit(0.0))
    size = sum((F.when(F.col(f"`{c}`").isNotNull(), abs(float(w))).otherwise(0.0) if known_only else F.lit(abs(float(w))) for c, w in weights.items()), F.lit(0.0))
    mean = F.coalesce(F.try_divide(total, size), F.lit(0.0))
    return clip(mean if sharpen is None else F.tanh(mean * sharpen), -1, 1)


def direction(si: Column, limit: float = 0.3) -> Column:
    return F.when(si > limit, "LONG").when(si < -limit, "SHORT").otherwise("NEUTRAL")


def strength(si: Column, strong: float = 0.7, moderate: float = 0.4) -> Column:
    return F.when(F.abs(si) > strong, "STRONG").when(F.abs(si) > moderate, "MODERATE").otherwise("WEAK")


def confidence(si: Column, strong: float = 0.7) -> Column:
    return F.least(F.abs(si) / strong, F.lit(1.0))
