"""Tables that are written once and appended to: readers, caches with an age, journals with a newest version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.temporal import latest

#: Columns that a journal adds to each row.
VERSION, DELETED = "version", "deleted"


def read_bars(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None, symbols: list[str] | None = None,
              start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from Parquet, ORC, CSV or JSON; symbols and dates are filters that reach the scan and prune partitions."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)
    if symbols:
        rows = rows.where(F.col("symbol").isin(symbols))
    if start:
        rows = rows.where(F.col("ts") >= F.lit(start).cast(rows.schema["ts"].dataType))
    return rows.where(F.col("ts") <= F.lit(end).cast(rows.schema["ts"].dataType)) if end else rows


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each symbol, rows in order of time in a file: scans prune by symbol and by row group."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode(mode).partitionBy("symbol").parquet(path)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """(path, text, hash): whole files below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.md5("value").alias("hash"))


def cache_key(symbol: Column, start: Column, end: Column) -> Column:
    return F.md5(F.concat_ws("|", symbol, start.cast("string"), end.cast("string")))


def fresh(manifest: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Cache entries younger than an age."""
    return manifest.where(F.col("cached_at") >= now - F.make_dt_interval(hours=F.lit(hours)))


def without(manifest: DataFrame, symbol: str | None = None) -> DataFrame:
    """The manifest after entries of a symbol, or all of them, are declared invalid."""
    return manifest.where(F.col("symbol") != symbol) if symbol is not None else manifest.limit(0)


def expired(manifest: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Entries that a clean-up would delete: those of an age and more."""
    return manifest.where(F.col("cached_at") < now - F.make_dt_interval(hours=F.lit(hours)))


def read_cached(spark: SparkSession, manifest: DataFrame, symbol: str, start: str, end: str, now: Column, hours: int = 24) -> DataFrame | None:
    """The bars of a cached request, or nothing where it is absent or too old; one row of the manifest is looked up."""
    hit = fresh(manifest, now, hours).where(F.col("key") == cache_key(F.lit(symbol), F.lit(start), F.lit(end))).agg(F.max_by("path", "cached_at")).first()[0]
    return None if hit is None else read_bars(spark, hit)


def clamped(start: Column, now: Column, days: int = 55) -> Column:
    """The start of an intraday request, not further back than the history that is kept."""
    return F.greatest(start, now - F.make_dt_interval(days=F.lit(days)))


def cache_stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("entries"), F.sum("n_rows").alias("n_rows"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"))


class Journal:
    """An append-only table with keys: inserts, upserts, field updates and deletions are appended rows, readers see the newest of each key.

    Appending never rewrites what is there, so writers do not block readers; the
    versions of a key come from the caller (a time or a sequence).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys
        self.fields = T.StructType.fromDDL(schema)
        self.schema = T.StructType([*self.fields, T.StructField(VERSION, T.LongType()), T.StructField(DELETED, T.BooleanType())])

    def append(self, rows: DataFrame, version: int, deleted: bool = False) -> None:
        """Insert or replace rows; columns that ``rows`` lacks are null."""
        cols = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType) for f in self.fields]
        rows.select(*(c.alias(f.name) for c, f in zip(cols, self.fields)), F.lit(version).cast("long").alias(VERSION), F.lit(deleted).alias(DELETED)).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """The newest row of each key that is not deleted."""
        log = self.spark.read.schema(self.schema).parquet(self.path)
        return latest(log, self.keys, VERSION).where(~F.col(DELETED)).select(*self.fields.names)

    def update(self, changes: DataFrame, version: int, allowed: list[str]) -> None:
        """Set the allowed fields of known keys; other columns of ``changes`` are left out."""
        cols = [c for c in changes.columns if c in allowed]
        fresh_ = changes.select(*self.keys, *(F.col(c).alias(f"_{c}") for c in cols))
        rows = self.read().join(fresh_, self.keys)
        self.append(rows.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in self.fields.names)), version)

    def delete(self, keys: DataFrame, version: int) -> None:
        self.append(self.read().join(keys.select(*self.keys), self.keys, "left_semi"), version, deleted=True)

    def compact(self, path: str) -> None:
        """Write the newest rows to another path, as version 0."""
        Journal(self.spark, path, self.fields.simpleString()[7:-1].replace(":", " "), self.keys).append(self.read(), 0)
