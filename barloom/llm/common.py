"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: What Unicode calls white space; it has none beyond U+3000.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame, *partition_cols: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Columnar and compressed, so for wide intermediate tables it takes less disk
    than a checkpoint.  The files stay until the folder is cleaned; the shuffle
    files that led to them go when the driver's collector has run, so it is asked to.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if partition_cols:
        out = out.partitionBy(*partition_cols)
    out.parquet(path)
    spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let Python workers get at most ``rows`` rows at a time: texts are long, and a batch is held whole.

    The session keeps the setting, as plans read it when they run, after an
    operator has returned; it is never raised.  Spark bounds a batch's bytes besides.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, hot: int) -> DataFrame:
    """``rows`` with the columns of ``counts``, which has one row a key and the key's number of rows in ``n``.

    Keys of over 1/``hot`` of the counted rows, of which there are at most ``hot``,
    are broadcast, so the rows of such a key stay where they are; the others meet by a shuffle.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    many, rest = counts.where(F.col(n) * hot > total), counts.where(F.col(n) * hot <= total)
    return rows.join(F.broadcast(many), keys).unionByName(rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(rest, keys))


def bucket_blocks(filed: DataFrame, member: str, tables: int, block: int, hot: int) -> DataFrame:
    """(member, key, i, j, right): the buckets of several hash tables, dealt out to be compared within (key, i, j).

    ``filed`` has a row (member, key) for each member's bucket in each table, the
    number of the table being ``key`` modulo ``tables``.  Buckets of one member go;
    of those with the same members, told by 128 bits, the one of the first table
    stays, as a tight group lies together in most tables.  A bucket larger than
    ``block`` is dealt out as pairs of blocks: where i < j only the two sides,
    told by ``right``, are to be compared with each other.
    """
    many = stash(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = stash(join_counted(filed, many, ["key"], "n", hot))
    alike = members.groupBy("key", "n").agg(F.bit_xor(F.xxhash64(member)).alias("x"), F.bit_xor(F.xxhash64(F.lit("other"), member)).alias("y"))
    first = stash(alike.groupBy("n", "x", "y").agg(F.min_by("key", F.pmod("key", F.lit(tables))).alias("key")).select("key", "n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = join_counted(members.select("key", member), first, ["key"], "n", hot).select(
        "key", member, F.pmod(F.xxhash64(member), blocks).cast("int").alias("k"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    return dealt.select(member, "key", F.least("k", "j").alias("i"), F.greatest("k", "j").alias("j"), (F.col("k") > F.col("j")).alias("right"))


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the machine at the end of a task: its Python worker stays for the tasks after it."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def key_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut the batches of one sorted partition between keys: no key spans two frames.

    For ``repartition(keys).sortWithinPartitions(keys).mapInPandas``: many small
    groups reach Python together, without a call for each.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        ks = batch[keys]
        last = ks.iloc[-1]
        starts = np.flatnonzero((ks != last).any(axis=1).to_numpy())
        at = int(starts[-1]) + 1 if len(starts) else 0
        if held and (at or not (held[-1][keys].iloc[-1] == last).all()):
            held.append(batch.iloc[:at])
            yield pd.concat(held, ignore_index=True)
            held = [batch.iloc[at:]]
        elif at:
            yield batch.iloc[:at].reset_index(drop=True)
            held = [batch.iloc[at:]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new key begins in parallel sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b between any integers: each node but the smallest of its
    component, with that smallest node.  At most one row per node."""
    if not len(a):
        return a, b
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = np.minimum(new, new[label])
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the links ``a``-``b``.

    Alternates the large-star and small-star steps; each is one aggregation with
    a map-side minimum and one join, and the link table never grows.  Nodes
    without a link are absent.  Lineage is cut every round by checkpoint().
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = joined.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut_lineage(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
