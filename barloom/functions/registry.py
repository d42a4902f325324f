"""Indicators that users register, and a table function that computes them: ``SELECT * FROM indicators(TABLE(bars), ...)``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf


@dataclass(frozen=True)
class Definition:
    """A name, its category, and what computes it from the columns of one series in order of time (NaN: no value)."""

    name: str
    category: str
    compute: Callable[[dict[str, np.ndarray]], np.ndarray]
    inputs: tuple[str, ...] = ("close",)


@dataclass
class Registry:
    """Definitions by name; a later one of a name replaces the earlier."""

    definitions: dict[str, Definition] = field(default_factory=dict)

    def register(self, name: str, category: str, compute: Callable[[dict[str, np.ndarray]], np.ndarray], inputs: Iterable[str] = ("close",)) -> Definition:
        if not name.isidentifier():
            raise ValueError(f"{name!r} is to be the name of a column")
        self.definitions[name] = Definition(name, category, compute, tuple(inputs))
        return self.definitions[name]

    def names(self, *categories: str) -> list[str]:
        """Registered names, of some categories or of all, in order."""
        return sorted(d.name for d in self.definitions.values() if not categories or d.category in categories)

    def counts(self) -> dict[str, int]:
        """Definitions by category."""
        out: dict[str, int] = {}
        for d in self.definitions.values():
            out[d.category] = out.get(d.category, 0) + 1
        return out

    def install(self, spark: SparkSession, function: str = "indicators") -> None:
        """Make the table function known to a session, with the definitions registered so far.

        ``indicators(TABLE(bars), 'overlap,momentum')`` gives the columns of bars and one
        for each definition of the named categories (NULL: all).  What is not asked for is not computed, and
        its columns are not there: the schema follows from the call.  The function
        itself asks for rows by symbol in order of ts, so the call needs no PARTITION BY.
        A series is one call's state; it is bounded by calendar time.  Definitions whose inputs the table lacks are left out.
        """
        definitions = list(self.definitions.values())

        def wanted(columns: Iterable[str], categories: str | None) -> list[Definition]:
            some = None if categories is None else {c.strip() for c in categories.split(",")}
            known = {d.category for d in definitions}
            if some is not None and some - known:
                raise ValueError(f"no indicator has the category {', '.join(sorted(some - known))}")
            return sorted((d for d in definitions if (some is None or d.category in some) and set(d.inputs) <= set(columns)), key=lambda d: d.name)

        class Indicators:
            def __init__(self) -> None:
                self.rows: list = []
                self.categories: str | None = None

            @staticmethod
            def analyze(bars: AnalyzeArgument, categories: AnalyzeArgument) -> AnalyzeResult:
                if not bars.isTable:
                    raise ValueError("the first argument is to be a table")
                names = bars.dataType.fieldNames()
                for needed in ("symbol", "ts"):
                    if needed not in names:
                        raise ValueError(f"the table has no column {needed}")
                schema = T.StructType(list(bars.dataType.fields))
                for d in wanted(names, categories.value):
                    if d.name in names:
                        raise ValueError(f"the table has a column {d.name} already")
                    schema = schema.add(d.name, T.DoubleType())
                return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("ts")])

            def eval(self, row, categories: str | None) -> None:
                self.rows.append(row)
                self.categories = categories

            def terminate(self):
                if not self.rows:
                    return
                names = self.rows[0].__fields__
                chosen = wanted(names, self.categories)
                series = {c: np.array([r[c] for r in self.rows], np.float64) for c in {c for d in chosen for c in d.inputs}}
                columns = [np.asarray(d.compute(series), np.float64) for d in chosen]
                for row, values in zip(self.rows, zip(*(np.where(np.isnan(c), None, c) for c in columns)) if columns else ((),) * len(self.rows)):
                    yield (*row, *values)

        spark.udtf.register(function, udtf(Indicators))

    def apply(self, bars: DataFrame, *categories: str) -> DataFrame:
        """The table function as a transformation of a DataFrame."""
        spark = bars.sparkSession
        self.install(spark)
        return spark.sql("SELECT * FROM indicators(TABLE({bars}), " + ("'" + ",".join(categories) + "'" if categories else "CAST(NULL AS STRING)") + ")", bars=bars)


def _rolling(n: int, how: str, column: str = "close") -> Callable[[dict[str, np.ndarray]], np.ndarray]:
    return lambda s: getattr(pd.Series(s[column]).rolling(n), how)().to_numpy()


def standard() -> Registry:
    """A registry with some common definitions of every category, to which others can be added."""
    r = Registry()
    for n in (5, 20):
        r.register(f"sma_{n}", "overlap", _rolling(n, "mean"))
        r.register(f"stdev_{n}", "volatility", lambda s, n=n: pd.Series(s["close"]).rolling(n).std(ddof=0).to_numpy())
        r.register(f"mom_{n}", "momentum", lambda s, n=n: pd.Series(s["close"]).diff(n).to_numpy())
    r.register("donchian_high_20", "volatility", _rolling(20, "max", "high"), ["high"])
    r.register("donchian_low_20", "volatility", _rolling(20, "min", "low"), ["low"])
    r.register("volume_sma_20", "volume", _rolling(20, "mean", "volume"), ["volume"])
    r.register("vwma_20", "overlap", lambda s: (pd.Series(s["close"] * s["volume"]).rolling(20).sum() / pd.Series(s["volume"]).rolling(20).sum()).to_numpy(), ["close", "volume"])
    return r
