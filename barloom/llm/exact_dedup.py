"""Exact dedup by content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stash

#: Characters of a text that the range splitters hold; what follows is told apart by a hash.
HEAD = 64
#: Texts of more than 1/HOT of all rows, of which there are at most HOT, are sorted under several keys ...
HOT = 10_000
#: ... unless they have no more rows than this.
ROWS_PER_SALT = 256


def sorted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "largest") -> DataFrame:
    """(ids, n, best, sha, salted): the groups of equal texts that lie beside each other in the content sort.

    A text whose rows all have one key is one row and final; one that was
    ``salted`` has a row for each of its keys.
    """
    best = F.max if keep == "largest" else F.min
    text = F.coalesce(F.col(text_col) if normalise is None else normalise, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body")).withColumn("h", F.xxhash64("body"))
    part = max(ROWS_PER_SALT, docs.count() // HOT)
    hot = stash(rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > part).select("h", F.ceil(F.col("n") / part).alias("salts")))
    number = F.when(F.col("id").isNull(), F.spark_partition_id().cast("long")).otherwise(F.xxhash64("id"))
    keyed = rows.join(F.broadcast(hot), "h", "left").select(
        "id", "body", F.substring("body", 1, HEAD).alias("head"), "h", F.coalesce(F.pmod(number, "salts"), F.lit(0)).alias("salt"), F.col("salts").isNotNull().alias("salted"))
    key = ["head", "h", "salt"]
    ranges = keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), *key)
    # The ranges already cluster the keys below: neither step moves a row again.
    beside = Window.partitionBy(*key).orderBy("body", "id")
    first = F.coalesce(F.lag("body").over(beside) != F.col("body"), F.lit(True))
    marked = ranges.select("id", *key, "salted", "body", first.alias("first")).select(
        "id", *key, "salted", F.when(F.col("first"), F.unhex(F.sha2("body", 256))).alias("sha"),
        F.count(F.when(F.col("first"), 1)).over(beside.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return marked.groupBy(*key, "run").agg(
        F.collect_list(F.struct("id")).alias("ids"), F.count("*").alias("n"), best("id").alias("best"), F.max("sha").alias("sha"),
        F.max("salted").alias("salted")).select("ids", "n", "best", "sha", "salted")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Column | None = None, keep: str = "largest") -> DataFrame:
    """Label each row with the row of its group of equal texts that stays.

    The rows are range-partitioned by sampled splitters over the normalised
    content and sorted there by Spark's external sort, so equal texts lie beside
    each other, and each row is compared in full with its neighbour: that decides.
    Only a text of more than 1/``HOT`` of all rows (and ``ROWS_PER_SALT``), found by a count of hashes, has
    a salt in its key, taken from the id (of a null id, from the part of the
    input it lies in), and so fills many ranges; the one digest row that each
    salt leaves is merged by SHA-256, without ids, and the merged rows, at most
    twice ``HOT``, are broadcast.  No task gets all ids of such a text.  Only the
    first ``HEAD`` characters and a hash go into the splitters, which bounds what
    sampling sends to the driver.

    Returns (id_col, keep_id, group_size, kept, text_sha256), one row per input
    row.  Null text counts as empty.  A null id never stays beside another id;
    repeated ids are rows of their own.  Very long texts are compared whole.  An
    empty table gives an empty result; other columns are ignored.
    """
    best = F.max if keep == "largest" else F.min
    runs = stash(sorted_runs(docs, id_col, text_col, normalise, keep))
    merged = runs.where("salted").groupBy("sha").agg(best("best").alias("keep_id"), F.sum("n").alias("group_size"))
    whole = runs.where(~F.col("salted")).select("ids", "sha", F.col("best").alias("keep_id"), F.col("n").alias("group_size")).unionByName(
        runs.where("salted").select("ids", "sha").join(F.broadcast(merged), "sha"))
    return whole.select("sha", "keep_id", "group_size", F.explode("ids").alias("x")).select(
        F.col("x.id").alias(id_col), "keep_id", "group_size",
        F.coalesce(F.col("x.id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
