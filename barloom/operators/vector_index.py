"""A store of vectors in inverted lists: add, replace, delete, count, and search that reads the lists it needs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from .documents import k_nearest

#: Vectors that centroids are fitted on, lists at most, queries among the sample that set the number of probes.
SAMPLE, MAX_LISTS, TRIED = 1 << 15, 1 << 11, 256
#: Queries and vectors of a list that meet in one group.
QUERIES, VECTORS = 1 << 10, 1 << 13


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :], 0)


def fit(sample: np.ndarray, lists: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """Centroids of k-means; one that loses all its vectors moves to the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        distance = _squares(sample, centres)
        own = distance.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        count = np.bincount(own, minlength=len(centres))
        empty = np.flatnonzero(count == 0)
        centres = sums / np.maximum(count, 1)[:, None]
        if len(empty):
            centres[empty] = sample[np.argsort(-distance[np.arange(len(sample)), own], kind="stable")[: len(empty)]]
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest lists hold the share ``recall`` of the k nearest vectors of the sample's first queries."""
    queries = sample[:TRIED]
    own = np.concatenate([_squares(sample[i:i + 4096], centres).argmin(axis=1) for i in range(0, len(sample), 4096)])
    order = _squares(queries, centres).argsort(axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    near = np.argsort(_squares(queries, sample), axis=1, kind="stable")[:, :k]
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


@dataclass
class VectorStore:
    """Vectors in Parquet, one folder for each list of a version.

    An id's newest version counts.  ``add`` writes new rows and the ids they
    replace, ``delete`` ids alone, so nothing is rewritten; ``compact`` writes
    what counts to a new store.  Centroids (at most MAX_LISTS) are fitted on at
    most SAMPLE vectors, the ones of smallest hash; every vector is filed.
    """

    spark: SparkSession
    path: str
    id_col: str
    vector_col: str
    centres: np.ndarray
    probes: int
    schema: T.StructType
    version: int = 0

    @classmethod
    def create(cls, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, k: int = 5, recall: float = 0.97) -> VectorStore:
        """A store of ``vectors`` (finite, of one length); ``recall`` sets the number of lists that a search probes, by trial on the sample."""
        spark = vectors.sparkSession
        n = vectors.count()
        share = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.5 * SAMPLE / max(n, 1)))
        rows = vectors.where(share).orderBy(F.xxhash64(F.lit("sample"), id_col), id_col).select(vector_col).limit(SAMPLE).collect()
        sample = np.array([r[0] for r in rows], np.float64).reshape(len(rows), len(rows[0][0]) if rows else 0)
        lists = min(MAX_LISTS, len(sample), lists or max(1, round(n ** 0.5 / 2)))
        centres = fit(sample, lists) if len(sample) else np.zeros((0, 0))
        store = cls(spark, f"{shared_folder(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}", id_col, vector_col, centres, probes_for(sample, centres, k, recall) if len(sample) else 0, vectors.schema)
        store._write(vectors)
        return store

    def _filed(self, vectors: DataFrame) -> DataFrame:
        """Adds list, the nearest centroid, and away, the distance to it."""
        centres = self.centres

        @F.pandas_udf("list int, away double")
        def nearest(v: pd.Series) -> pd.DataFrame:
            if not len(v):
                return pd.DataFrame({"list": [], "away": []})
            x = np.stack(v.to_numpy()).astype(np.float64)
            own = _squares(x, centres).argmin(axis=1)
            return pd.DataFrame({"list": own.astype(np.int32), "away": np.sqrt(((x - centres[own]) ** 2).sum(axis=1))})

        if not len(centres):
            return vectors.select("*", F.lit(0).alias("list"), F.lit(0.0).alias("away"))
        return vectors.withColumn("_n", nearest(self.vector_col)).select(*vectors.columns, "_n.list", "_n.away")

    def _write(self, vectors: DataFrame) -> None:
        # A list goes to several files where it is long: the hash of the id spreads it.
        spread = F.pmod(F.xxhash64(self.id_col), F.lit(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 4)))
        self._filed(vectors).withColumn("version", F.lit(self.version)).repartition("list", spread).sortWithinPartitions("list", self.id_col).write.mode("append").partitionBy(
            "version", "list").option("compression", "zstd").parquet(f"{self.path}/rows")

    def _changed(self, ids: DataFrame) -> None:
        self.version += 1
        ids.select(F.col(self.id_col).alias("id")).distinct().write.parquet(f"{self.path}/changes/version={self.version}")

    def add(self, vectors: DataFrame) -> None:
        """New vectors, or new values of known ids."""
        self._changed(vectors)
        self._write(vectors)

    def delete(self, ids: DataFrame) -> None:
        self._changed(ids)

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """What counts now, with list and away; ``lists`` prunes the folders that are read."""
        schema = T.StructType([*self.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("away", T.DoubleType()), T.StructField("version", T.IntegerType())])
        held = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        if lists is not None:
            held = held.where(F.col("list").isin(lists))
        if self.version:
            ids = T.StructType([T.StructField("id", self.schema[self.id_col].dataType), T.StructField("version", T.IntegerType())])
            newest = self.spark.read.schema(ids).parquet(f"{self.path}/changes").groupBy("id").agg(F.max("version").alias("_newest"))
            held = held.join(newest, held[self.id_col] == newest["id"], "left").where(F.coalesce(F.col("version") >= F.col("_newest"), F.lit(True))).drop("id", "_newest")
        return held.drop("version")

    def count(self) -> int:
        return self.rows().count()

    def count_by(self, *columns: str) -> DataFrame:
        return self.rows().groupBy(*columns).agg(F.count("*").alias("n"))

    def compact(self) -> VectorStore:
        """The same rows as a store of one version, with the same centroids."""
        new = VectorStore(self.spark, f"{shared_folder(self.spark).rstrip('/')}/vectors-{uuid.uuid4().hex}", self.id_col, self.vector_col, self.centres, self.probes, self.schema)
        new._write(self.rows().drop("list", "away"))
        return new

    def search(self, queries: DataFrame, k: int, query_col: str = "query", exact: bool = True, where: Column | None = None) -> DataFrame:
        """(query, id, distance, score, rank): the k nearest vectors of each query by squared distance, of equals the smaller id.

        First the ``probes`` nearest lists of a query are compared with it.  With
        ``exact``, lists that may hold a nearer vector than the k-th one found
        follow, by the triangle inequality: a list whose centroid is farther than
        that distance and the list's radius together cannot.  Without it the rest is left out.
        ``where`` filters vectors before they are ranked.  Only the lists that some query needs are read.
        """
        asked = queries.select(query_col, F.col(self.vector_col).alias("v"))
        first = self._compare(self._lists(asked.withColumn("edge", F.lit(-1.0)), query_col, None), k, query_col, where)
        if not exact:
            return first
        first = self._held(first)
        edge = first.groupBy(query_col).agg(F.max("rank").alias("found"), F.max("distance").alias("edge")).select(
            query_col, F.when(F.col("found") == k, F.sqrt("edge")).alias("edge"))
        radius = np.full(len(self.centres), -1.0)
        for r in (self.rows() if where is None else self.rows().where(where)).groupBy("list").agg(F.max("away").alias("away")).collect():  # at most MAX_LISTS rows
            radius[r["list"]] = r["away"]
        more = self._compare(self._lists(asked.join(edge, query_col, "left"), query_col, radius), k, query_col, where)
        return self._ranked(first.select(query_col, self.id_col, "distance").unionByName(more.select(query_col, self.id_col, "distance")), k, query_col)

    def _held(self, df: DataFrame) -> DataFrame:
        shared_folder(self.spark)
        return df.checkpoint(eager=True)

    def _lists(self, asked: DataFrame, query_col: str, radius: np.ndarray | None) -> DataFrame:
        """(query, v, list): the lists a query probes first, or, with ``radius``, the others that may hold a vector within its ``edge`` (null: any that is not empty)."""
        centres, probes = self.centres, self.probes

        @F.pandas_udf("array<int>")
        def chosen(v: pd.Series, edge: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            gap = np.sqrt(_squares(np.stack(v.to_numpy()).astype(np.float64), centres))
            order = gap.argsort(axis=1, kind="stable")
            if radius is None:
                return pd.Series(list(order[:, :probes].astype(np.int32)))
            # One part in a thousand million for the last bits of the distances.
            reach = (edge.fillna(np.inf).to_numpy()[:, None] + radius[None, :]) * (1 + 1e-9) + 1e-9
            near = (gap <= reach) & (radius >= 0)[None, :]
            np.put_along_axis(near, order[:, :probes], False, axis=1)
            return pd.Series([np.flatnonzero(x).astype(np.int32) for x in near])

        if not len(centres):
            return asked.select(query_col, "v", F.lit(0).alias("list")).limit(0)
        return asked.select(query_col, "v", F.explode(chosen("v", "edge")).alias("list"))

    def _compare(self, pairs: DataFrame, k: int, query_col: str, where: Column | None) -> DataFrame:
        """The k nearest of each query among the vectors of its lists: blocks of a list's queries meet blocks of its vectors."""
        id_col, vector_col = self.id_col, self.vector_col
        pairs = self._held(pairs)
        rows = self.rows([r["list"] for r in pairs.select("list").distinct().collect()])  # at most MAX_LISTS
        rows = rows if where is None else rows.where(where)
        sizes = rows.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / VECTORS)).cast("int").alias("parts"))
        wanted = pairs.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        blocks = wanted.join(sizes, "list")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        blocks = F.broadcast(self._held(blocks))
        q = pairs.join(blocks, "list").select("list", F.col(query_col).alias("q"), "v", F.pmod(F.xxhash64(query_col), "blocks").cast("int").alias("block"), every("parts").alias("part"))
        x = rows.join(blocks, "list").select("list", F.col(id_col).alias("x"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), "parts").cast("int").alias("part"), every("blocks").alias("block"))
        schema = T.StructType([pairs.schema[query_col], rows.schema[id_col], T.StructField("distance", T.DoubleType())])

        def nearest(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(xs):
                return pd.DataFrame(columns=schema.names)
            i, j, distance = k_nearest(*(np.stack(d["v"].to_numpy()) for d in (qs, xs)), xs["x"], k)
            return pd.DataFrame({query_col: qs["q"].to_numpy()[i], id_col: xs["x"].to_numpy()[j], "distance": distance})

        by = ["list", "block", "part"]
        return self._ranked(q.groupBy(*by).cogroup(x.groupBy(*by)).applyInPandas(nearest, schema), k, query_col)

    def _ranked(self, found: DataFrame, k: int, query_col: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(query_col).orderBy("distance", self.id_col))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.round(1 / (1 + F.col("distance")), 4))
