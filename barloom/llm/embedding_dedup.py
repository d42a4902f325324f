"""Embedding near-dedup by Euclidean p-stable hashing."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erfc, exp, floor, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_blocks, connected_components, cut_lineage, join_counted, key_runs, run_starts, spanning_forest, stash

#: Width of a quantisation step for vectors of length one.
WIDTH = 2.0
#: Vectors of a bucket that meet in one block.
BLOCK = 1024
#: Links whose earlier tables are compared at a time.
CHUNK = 1 << 17
#: Tables are numbered in the low bits of a bucket's key.
MAX_TABLES = 1024
#: Buckets of more than 1/HOT of all memberships are joined by broadcast: there are at most HOT.
HOT = 1000


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for vectors at a distance."""
    r = width / distance
    return 1 - erfc(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def tables_for(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Projections a table and tables: unrelated vectors share a bucket about once in n, and
    a pair at the threshold shares one at least with the given chance.

    Where that would take more than MAX_TABLES tables there are fewer
    projections: more exact checks, the same chance.
    """
    near, far = collision(sqrt(2 - 2 * cosine)), collision(sqrt(2.0))
    k = max(4, ceil(log(max(n, 2)) / log(1 / far)))
    most = floor(log(1 - (1 - recall) ** (1 / MAX_TABLES)) / log(near))
    if most < 1:
        raise ValueError("this recall at this cosine takes too many tables")
    k = min(k, most)
    return k, ceil(log(1 - recall) / log(1 - near ** k))


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class _Tables:
    """The random projections, drawn again from the seed wherever they are needed.

    They take dimension x projections x tables doubles, which grows like a small
    power (0.19) of the number of vectors.
    """

    def __init__(self, tables: int, k: int, seed: int) -> None:
        self.tables, self.k, self.seed = tables, k, seed
        self.drawn: dict[int, tuple] = {}

    def keys(self, unit: np.ndarray, tables: int | None = None) -> np.ndarray:
        """(vectors x the first ``tables`` tables): each vector's bucket, the table in its low bits."""
        dim, k = unit.shape[1], self.k
        if dim not in self.drawn:
            rng = np.random.default_rng([self.seed, dim])
            n = self.tables * k
            self.drawn[dim] = (rng.standard_normal((dim, n)), rng.uniform(0, WIDTH, n), rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1))
        project, shift, weight = self.drawn[dim]
        t = self.tables if tables is None else tables
        q = np.floor((unit @ project[:, :t * k] + shift[:t * k]) / WIDTH).astype(np.int64).view(np.uint64)
        h = (q * weight[:t * k]).reshape(len(unit), t, k).sum(axis=2, dtype=np.uint64) + np.uint64(dim)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return ((h & np.uint64(-MAX_TABLES % (1 << 64))) | np.arange(t, dtype=np.uint64)).view(np.int64)


def buckets(classes: DataFrame, tables: int, k: int, seed: int) -> DataFrame:
    """(cid, keys): the bucket of each vector in every table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn = _Tables(tables, k, seed)
        for batch in batches:
            for _, part in batch.groupby(batch["vec"].map(len)):
                yield pd.DataFrame({"cid": part["cid"], "keys": list(drawn.keys(_unit(list(part["vec"]))))})

    return classes.select("cid", "vec").mapInPandas(run, "cid long, keys array<long>")


def _links(classes: DataFrame, hashed: DataFrame, cosine: float, drawn: tuple[int, int, int]) -> DataFrame:
    """(cid, links, root): for each block of a bucket, a class's number of linked vectors of
    other classes that no earlier table finds, and the smallest class it reaches there."""
    dealt = bucket_blocks(hashed.select("cid", F.explode("keys").alias("key")), "cid", MAX_TABLES, BLOCK, HOT)
    keys = ["key", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _Tables(*drawn)
        for part in key_runs(batches, keys):
            starts = run_starts(*(part[k].to_numpy() for k in keys))
            out: list[tuple] = []
            cids, sizes, right = part["cid"].to_numpy(), part["size"].to_numpy(), part["right"].to_numpy()
            vecs, cross = part["vec"].to_numpy(), (part["i"] != part["j"]).to_numpy()
            table = part["key"].to_numpy() & (MAX_TABLES - 1)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                at = np.arange(s, e)
                left, other = (at[~right[s:e]], at[right[s:e]]) if cross[s] else (at, at)
                if not len(left) or not len(other) or e - s < 2 or len({len(v) for v in vecs[s:e]}) > 1:
                    continue
                x = _unit(list(vecs[s:e]))
                p, q = np.nonzero(x[left - s] @ x[other - s].T >= cosine)
                if not cross[s]:
                    p, q = p[p < q], q[p < q]
                a, b = left[p], other[q]
                if len(p) and table[s]:
                    linked, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                    h = tables.keys(x[linked - s], int(table[s]))
                    pa, pb = place[: len(a)], place[len(a):]
                    fresh = np.concatenate([~(h[pa[c:c + CHUNK]] == h[pb[c:c + CHUNK]]).any(axis=1) for c in range(0, len(p), CHUNK)])
                    a, b = a[fresh], b[fresh]
                if not len(a):
                    continue
                links = np.zeros(e - s, np.int64)
                np.add.at(links, a - s, sizes[b])
                np.add.at(links, b - s, sizes[a])
                node, root = spanning_forest(cids[a], cids[b])
                found = dict(zip(node.tolist(), root.tolist()))
                out += [(c, n, found.get(c, c)) for c, n in zip(cids[s:e].tolist(), links.tolist()) if n]
            yield pd.DataFrame(out, columns=["cid", "links", "root"])

    return dealt.join(classes.select("cid", "size", "vec"), "cid").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(
        compare, "cid long, links long, root long")


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                    recall: float = 0.995, seed: int = 11) -> DataFrame:
    """(id_col, n_links, component_id, kept): link vectors whose cosine reaches ``cosine``.

    Vectors of length one are hashed by quantised random projections into as
    many tables as make a pair at the threshold meet with chance ``recall``
    (closer pairs nearly surely); the vectors of a bucket are then compared by
    exact cosine in double precision, so no pair below is linked.  The number of
    projections follows the number of vectors, and with it the work for pairs
    that only meet by chance stays in proportion.  Equal vectors, told by 128
    bits, are one class from the start.  A large bucket is dealt out as pairs of
    blocks, and a block returns sums and a spanning forest, never its pairs; a
    pair that meets in several tables is counted in the first.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of other lengths are not compared.  Repeated ids are
    rows of their own; ids are integers.  An empty table gives an empty result;
    other columns are ignored.
    """
    vec = F.col(vector_col)
    each = rows.select(F.col(id_col).alias("id"), vec.alias("vec"), F.xxhash64(vec).alias("h"), F.xxhash64(F.lit("other"), vec).alias("h2"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0), F.lit(False))
    classes = each.where(good).groupBy("h", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    # The number is unique, and written once.
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()))
    k, tables = tables_for(classes.count(), cosine, recall)
    hashed = stash(buckets(classes, tables, k, seed))
    links = stash(_links(classes, hashed, cosine, (tables, k, seed)))
    counted = links.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(links.where("cid <> root").select("cid", "root"), "cid", "root")
    named = classes.select("h", "h2", "cid", "rep", "size").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = cut_lineage(named.join(smallest, "component").join(counted, "cid", "left").select(
        "h", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "size"))
    linked = join_counted(each.where(good).select("id", "h", "h2"), named, ["h", "h2"], "size", HOT).select("id", "n_links", "component_id")
    alone = each.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))
