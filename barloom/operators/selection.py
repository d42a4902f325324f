"""Choosing genomes of a large population: by fitness, by category, and apart from each other."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .skew import join_by_size

#: Genomes of a cell that meet in one group.
BLOCK = 1 << 11
#: The fitness that a genome counts for at least on the wheel, and parts of one that are told apart.
LEAST, PARTS = 0.001, 1_000_000


def _held(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in sampled ranges, sorted, with the number of the range; written once, so the numbers stay."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _held(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))


def running_total(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """``rows`` with before, the sum of the integer ``value`` over all rows that come first, and at, their number.

    The windows run within sampled ranges; what lies before a range comes from a
    table with one row for each.  ``order`` is to tell all rows apart.
    """
    ranges = _ranges(rows, *order)
    sums = ranges.groupBy("range").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    own = Window.partitionBy("range").orderBy(*order)
    inside = ranges.withColumn("at", F.row_number().over(own) - 1).withColumn("before", F.coalesce(F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(starts), "range").withColumn("at", F.col("at") + F.col("n0")).withColumn("before", F.col("before") + F.col("s0")).drop("range", "s0", "n0")


def last_at_or_before(marks: DataFrame, points: DataFrame, pos: str, value: str) -> DataFrame:
    """``points`` with the ``value`` of the last mark whose ``pos`` is not above theirs; positions of marks are unique.

    Both are sorted together in ranges; a range starts with the last mark of those before it.
    """
    both = marks.select(F.col(pos).alias("_pos"), F.lit(0).alias("_kind"), F.struct(F.col(value).alias("v")).alias("_mark")).unionByName(
        points.select(F.col(pos).alias("_pos"), F.lit(1).alias("_kind"), F.struct("*").alias("_point")), allowMissingColumns=True)
    ranges = _ranges(both, "_pos", "_kind")
    newest = ranges.where("_kind = 0").groupBy("range").agg(F.max_by("_mark", "_pos").alias("_newest"))
    every = ranges.select("range").distinct().join(newest, "range", "left")
    carried = every.select("range", F.last("_newest", True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    seen = F.last("_mark", True).over(Window.partitionBy("range").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    found = ranges.withColumn("_seen", seen).where("_kind = 1").join(F.broadcast(carried), "range")
    return found.select("_point.*", F.coalesce("_seen", "_carried").getField("v").alias(value))


def drawn(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of a seed and columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def roulette(scores: DataFrame, draws: DataFrame, seed: int, key: str = "draw") -> DataFrame:
    """``draws`` with dna_id, each drawn with a chance in proportion to its fitness (at least LEAST).

    The wheel is the running total of fitnesses in millionths, by id; a draw is a hashed
    place on it, and the genome is the last that starts at or before it: no task
    sees the whole population.  Null fitness counts as none; an empty population draws nothing.
    """
    weight = F.floor(F.greatest(F.lit(LEAST), F.coalesce("fitness", F.lit(0.0))) * PARTS).cast("long")
    wheel = _held(running_total(scores.select("dna_id", weight.alias("weight")), "weight", "dna_id"))
    total = wheel.agg(F.max(F.col("before") + F.col("weight"))).first()[0]
    if total is None:
        return draws.withColumn("dna_id", F.lit(None)).limit(0)
    placed = draws.withColumn("before", F.floor(drawn(seed, F.col(key).cast("string")) * float(total)).cast("long"))
    return last_at_or_before(wheel, placed, "before", "dna_id").drop("before")


def stratified(genomes: DataFrame, names: dict[str, str], per_category: int, seed: int) -> DataFrame:
    """(dna_id, name, category, active, weight): each genome uses ``per_category`` random indicators of every category, or all where there are fewer.

    ``names`` maps the registered indicators to categories.  The others are there, inactive, with weight 0.
    """
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("category")) for n, c in names.items()))
    genes = genomes.select("dna_id", F.explode(listed).alias("x")).select("dna_id", "x.name", "x.category")
    nth = F.row_number().over(Window.partitionBy("dna_id", "category").orderBy(drawn(seed, F.col("dna_id").cast("string"), "name"), "name"))
    active = nth <= per_category
    return genes.withColumn("active", active).withColumn("weight", F.when(F.col("active"), F.round(drawn(seed + 1, F.col("dna_id").cast("string"), "name") * 2 - 1, 6)).otherwise(0.0))


def swap(genes: DataFrame, seed: int, rate: float = 0.05) -> DataFrame:
    """Switches some genes on or off: one switched off weighs 0, one switched on gets a random weight."""
    turn = drawn(seed, F.col("dna_id").cast("string"), "name") < rate
    new = F.when(F.col("active"), 0.0).otherwise(F.round(drawn(seed + 1, F.col("dna_id").cast("string"), "name") * 2 - 1, 6))
    return genes.withColumn("weight", F.when(turn, new).otherwise(F.col("weight"))).withColumn("active", F.col("active") != turn)


def lowest(scores: DataFrame, share: float = 0.1) -> DataFrame:
    """(dna_id): the weakest tenth, at least one; of equals the smaller id first."""
    placed = _held(running_total(scores.select("dna_id", F.coalesce("fitness", F.lit(float("-inf"))).alias("fitness"), F.lit(1).alias("one")), "one", "fitness", "dna_id"))
    return placed.where(F.col("at") < max(1, int(placed.count() * share))).select("dna_id")


def inject_unused(genes: DataFrame, scores: DataFrame, most: int, seed: int) -> DataFrame:
    """Genes in which up to ``most`` names that no genome uses are switched on in the weakest tenth, with random weights."""
    names = genes.groupBy("name").agg(F.max("active").alias("used")).where(~F.col("used")).orderBy(drawn(seed, "name"), "name").limit(most)
    chosen = genes.join(F.broadcast(names.select("name", F.lit(True).alias("_new"))), "name", "left").join(lowest(scores).withColumn("_weak", F.lit(True)), "dna_id", "left")
    hit = F.coalesce(F.col("_new") & F.col("_weak"), F.lit(False))
    weight = F.round(drawn(seed + 1, F.col("dna_id").cast("string"), "name") * 2 - 1, 6)
    return chosen.withColumn("weight", F.when(hit, weight).otherwise(F.col("weight"))).withColumn("active", F.col("active") | hit).drop("_new", "_weak")


def crowded_out(vectors: DataFrame, radius: float) -> DataFrame:
    """(dna_id): genomes that have a fitter one (of equals, one of smaller id) closer than ``radius``.

    ``vectors`` has dna_id, fitness and vector, arrays of one length.  Two genomes
    that close differ by less than the radius in any one coordinate, so each lies in one cell of a
    grid over its first two coordinates and asks its cell and the eight around
    it: exact.  A cell with many genomes is dealt out in pairs of blocks, each compared in
    one matrix; what leaves a task is the genomes that lose, not pairs.
    """
    cell = lambda i: F.floor(F.coalesce(F.try_element_at("vector", F.lit(i)), F.lit(0.0)) / radius)
    rows = _held(vectors.select("dna_id", F.coalesce("fitness", F.lit(float("-inf"))).alias("fitness"), "vector", cell(1).alias("cx"), cell(2).alias("cy")))
    around = F.array(*(F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    asking = rows.select("dna_id", "fitness", "vector", F.explode(around).alias("c")).select("dna_id", "fitness", "vector", "c.cx", "c.cy")
    keys = ["cx", "cy"]
    sizes = _held(asking.groupBy(*keys).agg(F.count("*").alias("n")).join(rows.groupBy(*keys).agg(F.count("*").alias("m")), keys))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own, every = lambda c: F.pmod(F.xxhash64("dna_id"), blocks(c)).cast("int"), lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    # The columns of one side get other names: both come from the same table.
    left = join_by_size(asking, sizes, keys, "n").select(*keys, own("n").alias("i"), every("m").alias("j"), "dna_id", "fitness", "vector")
    right = join_by_size(rows, sizes, keys, "m").select(*keys, every("n").alias("i"), own("m").alias("j"), *(F.col(c).alias("other_" + c) for c in ("dna_id", "fitness", "vector")))
    schema = rows.select("dna_id").schema

    def lose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return a[["dna_id"]].iloc[:0]
        x, y = (np.stack(v.to_numpy()).astype(np.float64) for v in (a["vector"], b["other_vector"]))
        near = reduce(np.add, ((x[:, None, k] - y[None, :, k]) ** 2 for k in range(x.shape[1]))) < radius * radius
        f, g, i, j = a["fitness"].to_numpy(), b["other_fitness"].to_numpy(), a["dna_id"].to_numpy(), b["other_dna_id"].to_numpy()
        fitter = (g[None, :] > f[:, None]) | (g[None, :] == f[:, None]) & (j[None, :] < i[:, None])
        return a[["dna_id"]][(near & fitter).any(axis=1)]

    by = [*keys, "i", "j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lose, schema).distinct()


def keep_apart(vectors: DataFrame, radius: float, seed: int) -> DataFrame:
    """The population in which the weaker of two close genomes is replaced by a random one: (dna_id, vector, replaced)."""
    gone = crowded_out(vectors, radius).withColumn("_gone", F.lit(True))
    fresh = F.transform("vector", lambda _, i: F.round(drawn(seed, F.col("dna_id").cast("string"), i.cast("string")) * 2 - 1, 6))
    return vectors.join(gone, "dna_id", "left").select("dna_id", F.when(F.col("_gone"), fresh).otherwise(F.col("vector")).alias("vector"), F.coalesce("_gone", F.lit(False)).alias("replaced"))
