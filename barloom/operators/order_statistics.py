"""Counts of smaller values among all earlier rows, however long a series is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

#: Cuts of a value range, rows of one stretch of time that are counted together, and rows of a range that is small enough.
CUTS, CHUNK, LEAF = 64, 1 << 14, 1 << 12
#: Ranges of more than 1/HOT of all rows get their cuts by broadcast: there are at most HOT.
HOT = 1000


def earlier(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the number of earlier smaller and of earlier equal values: values are split by the bits of their ranks, the highest first."""
    n = len(values)
    at, below, equal = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return below, equal
    code = np.unique(values, return_inverse=True)[1]
    since = lambda x: at - np.maximum.accumulate(np.where(np.concatenate([[True], x[1:] != x[:-1]]), at, 0))
    order = at  # by the higher bits, then by place
    for bit in reversed(range(int(code.max()).bit_length())):
        high = code[order] >> bit
        one = high % 2
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        below[order] += one * (zeros[:-1] - zeros[at - since(high >> 1)])
        order = order[np.argsort(high, kind="stable")]
    equal[order] = since(code[order])
    return below, equal


def _held(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _cut(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with the cuts of their node: a large node's by broadcast, the others by a join on the node."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    many, rest = sizes.where(F.col("n") * HOT > total), sizes.where(F.col("n") * HOT <= total)
    return rows.join(F.broadcast(many), "node").unionByName(rows.join(F.broadcast(many.select("node")), "node", "left_anti").join(rest, "node"))


def _level(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of nodes that are too large, with ``sub`` and the counts of one level added: the values of a node are cut, and earlier rows in lower parts are counted.

    ``sub`` is odd for a cut itself, even between two.  A stretch of time has
    ``CHUNK`` rows of a node, by their place ``pos`` in it; what earlier stretches
    hold comes from running sums of a small table, what lies within one from
    numpy, and both give the place in the part as well.
    """
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(CUTS.bit_length()))))  # cuts are in order: the lower ones are counted by halving
    lower = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get("cuts", n + step - 1) < F.col("value"), step).otherwise(0))
    rows = _held(_cut(rows, sizes).select("node", "at", "pos", "value", "below", "equal", F.floor(F.col("pos") / CHUNK).alias("stretch"),
                                          (2 * lower + F.array_contains("cuts", F.col("value")).cast("int")).alias("sub")))
    by = ["node", "stretch"]
    counts = rows.groupBy(*by, "sub").agg(F.count("*").alias("k")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("sub", "k"))).alias("ks"))
    dense = counts.select(*by, "ks", F.explode(F.sequence(F.lit(0), F.lit(2 * CUTS))).alias("sub")).withColumn("k", F.coalesce(F.element_at("ks", F.col("sub")), F.lit(0)))
    earlier_ones = Window.partitionBy("node", "sub").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = dense.select(*by, "sub", F.coalesce(F.sum("k").over(earlier_ones), F.lit(0)).alias("s"))
    carried = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("sub", "s"))).alias("x")).select(*by, F.col("x.s").alias("sums"))

    def count(part: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", kind="stable")
        sub, carry = part["sub"].to_numpy(), np.asarray(sums["sums"].iloc[0], np.int64)
        below, equal = earlier(sub)
        part["below"] += below + (np.cumsum(carry) - carry)[sub]
        part["pos"] = equal + carry[sub]
        part["equal"] += np.where(sub % 2 == 1, part["pos"], 0)
        return part

    return rows.groupBy(*by).cogroup(carried.groupBy(*by)).applyInPandas(count, rows.schema)


def _leaf(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("pos", kind="stable")
    below, equal = earlier(part["value"].to_numpy())
    return pd.DataFrame({"at": part["at"], "below": part["below"] + below, "equal": part["equal"] + equal})


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(at, row, key, value): rows numbered from 0 over all ranges by key and order; a range's first number comes from a table of their sizes."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    ranges = _held(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)))
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    starts = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ranges.join(F.broadcast(starts), "range").withColumn("at", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("range", "start")


def earlier_counts(rows: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with n_before, below and equal: how many earlier rows of the key have a value, a smaller and an equal one.

    The rows are range-partitioned by key and time, which numbers them.  Then
    the values of a key are cut at quantiles of a mergeable summary, again and again, until few
    are left between two cuts: at each level a row adds the earlier rows in the
    lower parts of its own range.  A value as frequent as one in ``CUTS`` is a cut
    itself and is done at once.  No task holds a series: it holds a stretch of
    time or a leaf, and the number of levels is the logarithm of the longest
    series to the base of ``CUTS``.  Null values and NaN count nowhere and get
    nulls; rows of equal time stand in the order of their values.
    """
    named = rows.select(F.struct("*").alias("row"), F.struct(*keys).alias("key"), F.col(value).cast("double").alias("value"), F.struct(*order).alias("when"))
    known = F.col("value").isNotNull() & ~F.isnan("value")
    numbered = _held(_numbered(named.where(known), ["key"], ["when", "value"]).select("at", "row", "key", "value"))
    starts = _held(numbered.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    total = starts.agg(F.sum("n")).first()[0] or 0
    many, rest = starts.where(F.col("n") * HOT > total), starts.where(F.col("n") * HOT <= total)
    placed = numbered.join(F.broadcast(many), "key").unionByName(numbered.join(F.broadcast(many.select("key")), "key", "left_anti").join(rest, "key"))
    placed = _held(placed.select("row", "at", (F.col("at") - F.col("first")).alias("pos"), "first", "value"))
    zero = F.lit(0).cast("long")
    # A node is a key, told by its first row, and the way down to a range of its values.
    left = placed.select(F.struct("first", zero.alias("way")).alias("node"), "at", "pos", "value", zero.alias("below"), zero.alias("equal"))
    probabilities = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    counted = []
    while True:
        cuts = F.array_sort(F.array_distinct(F.percentile_approx("value", probabilities, 10_000)))
        sizes = _held(left.groupBy("node").agg(F.count("*").alias("n"), cuts.alias("cuts")))
        counted.append(left.join(sizes.where(F.col("n") <= LEAF).select("node"), "node").groupBy("node").applyInPandas(_leaf, "at long, below long, equal long"))
        large = sizes.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        level = _held(_level(left, large))
        counted.append(level.where("sub % 2 = 1").select("at", "below", "equal"))
        down = F.struct(F.col("node.first").alias("first"), (F.col("node.way") * (2 * CUTS + 1) + F.col("sub") + 1).alias("way"))
        left = level.where("sub % 2 = 0").select(down.alias("node"), "at", "pos", "value", "below", "equal")
    found = counted[0]
    for more in counted[1:]:
        found = found.unionByName(more)
    result = placed.join(found, "at").select("row.*", F.col("pos").alias("n_before"), "below", "equal")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("n_before", "below", "equal")]
    return result.unionByName(named.where(~known | F.col("value").isNull()).select("row.*", *nothing))


def percentile_of_earlier(n_before: Column, below: Column, equal: Column, least: int = 20) -> Column:
    """The percentile, 0 to 1, of a value among the earlier ones, ties in the middle; null before the ``least``-th row, 0.5 with one earlier row."""
    middle = (2 * below + equal + F.when(equal > 0, 1).otherwise(0)) / (2.0 * n_before)
    return F.when(n_before + 1 >= least, F.when(n_before < 2, 0.5).otherwise(middle))
