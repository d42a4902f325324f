"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions

#: Mean of one Poisson draw; a larger rate is the sum of several independent draws.
MAX_MEAN = 32.0
#: Sources whose rates are broadcast; with more of them the rates are joined by a shuffle.
MAX_BROADCAST = 20_000
#: Parts that the rows of a source are dealt into where the rates are joined by a shuffle.
SALTS = 64
#: A document of more draws than this is dealt out in blocks of so many before its copies are made.
BLOCK_DRAWS = 32


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the seed and the parts."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text",
                 weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(key, size, rate): the mean number of copies of a source's documents.

    Sizes are characters.  With ``weights`` a source gets that share (they are
    scaled to one; a source without a weight gets none), else the share
    size ** temperature.  ``epochs`` is the size of the mix over the size of the
    input.
    """
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    sizes = docs.groupBy(key.alias("key")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("key") == F.lit("s" + name), float(w)).otherwise(weight)
    sizes = cut_lineage(sizes.where("size > 0").withColumn("weight", weight))
    total, all_weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    if not total or not all_weight:
        return sizes.select("key", "size", F.lit(0.0).alias("rate"))
    return sizes.select("key", "size", (F.col("weight") / all_weight * (epochs * total) / F.col("size")).alias("rate"))


def _with_draws(rates: DataFrame) -> DataFrame:
    """Adds the number of draws and the cumulative distribution that each inverts."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int")
    mean = F.col("rate") / draws
    terms = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")  # what lies beyond is below 2 ** -53
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def term(acc: Column, j: Column) -> Column:
        p = acc["p"] * mean / j
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["cdf"], acc["c"] + p).alias("cdf"))

    return rates.select("key", draws.alias("draws"), F.aggregate(F.sequence(F.lit(1), terms), start, term)["cdf"].alias("cdf"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0,
                seed: int = 17) -> DataFrame:
    """Repeat each document so that the sources reach their target shares, in random order.

    A document's number of copies is a Poisson variable whose mean is the rate
    of its source (``source_rates``), got by inverting the distribution at a hash
    of the seed and the id: the same on every run and on any partitioning.  The
    copies are exploded and dealt out by the hash of id and copy over all
    partitions, each sorted by that hash.  The rate of a tiny source grows with
    the mix; a document of more than ``BLOCK_DRAWS`` draws is first dealt out in
    blocks of draws, so its copies are made in many tasks.

    Returns (row, copy, n_copies, mix_key): ``row`` is the struct of all input
    columns, so no name can clash; copy counts from 1.  Rows of one id get the
    same number of copies; a null id draws by the MD5 of its text, and rows of one hash
    are dealt out by the part of the input they lie in.  A null source is a
    source of its own; sources without text and empty tables give no rows.
    """
    spark = docs.sparkSession
    rates = cut_lineage(_with_draws(source_rates(docs, source_col, text_col, weights, temperature, epochs)))
    key = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.struct("*").alias("row"), own.alias("id"), key.alias("key"), F.spark_partition_id().alias("part"))
    if len(rates.select(F.lit(1)).take(MAX_BROADCAST + 1)) <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(rates), "key")
    else:  # a hot source is spread over SALTS keys
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    one = lambda i: F.size(F.filter("cdf", lambda c: c < uniform(seed, i, F.col("id"))))
    several = lambda first, last: F.aggregate(F.sequence(first, last), F.lit(0), lambda n, i: n + one(i))
    single = joined.where(F.col("draws") <= BLOCK_DRAWS).withColumn("u", uniform(seed, F.lit(1), F.col("id"))).withColumn(
        "n_copies", F.when(F.col("draws") == 1, F.size(F.filter("cdf", lambda c: c < F.col("u")))).otherwise(several(F.lit(1), F.col("draws"))).cast("long"))
    copies = single.where("n_copies > 0").select(
        "row", "id", "part", "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
    if not rates.where(F.col("draws") > BLOCK_DRAWS).isEmpty():
        copies = copies.unionByName(_heavy(joined.where(F.col("draws") > BLOCK_DRAWS), several))
    mix_key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("mix"), F.col("id"), F.col("copy"))), 1, 15), 16, 10).cast("long")
    return copies.select("row", "part", "copy", "n_copies", mix_key.alias("mix_key")).repartition(
        shuffle_partitions(spark), "mix_key", "part").sortWithinPartitions("mix_key").drop("part")


def _heavy(rows: DataFrame, several: Callable[[Column, Column], Column]) -> DataFrame:
    """The copies of documents with many draws: counts by block of draws, without texts, give each block the number of its first copy."""
    blocks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("draws") / BLOCK_DRAWS).cast("int") - 1)).alias("block")
    first = F.col("block") * BLOCK_DRAWS
    counted = rows.select("id", "draws", "cdf").dropDuplicates(["id"]).select("id", "draws", "cdf", blocks).repartition("id", "block").select(
        "id", "block", several(first + 1, F.least(first + BLOCK_DRAWS, "draws")).cast("long").alias("n"))
    each = Window.partitionBy("id")
    placed = counted.select("id", "block", "n", F.sum("n").over(each.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)).alias("last"), F.sum("n").over(each).alias("n_copies"))
    return rows.select("row", "id", "part", blocks).join(placed.where("n > 0"), ["id", "block"]).select(
        "row", "id", "part", "n_copies", F.explode(F.sequence(F.col("last") - F.col("n") + 1, "last")).alias("copy"))


def mixed_digest(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, copy, n_copies, source, mix_key, text_sha256) of the mix of ``documents``."""
    held = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return mix_sources(held, **options).select(
        "row.doc_id", "copy", "n_copies", "row.source", "mix_key", F.sha2("row.text", 256).alias("text_sha256"))
