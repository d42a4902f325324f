"""Cached bars as a data source: ``spark.read.format("bar_cache")`` and ``spark.readStream.format("bar_cache")``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
MANIFEST = "symbol string, day date, first_ts timestamp_ntz, last_ts timestamp_ntz, n_rows long, cached_at timestamp_ntz, sequence long, folder string"


def write_cache(bars: DataFrame, path: str, cached_at: str, sequence: int = 0) -> None:
    """Add bars (columns of BARS) to the cache: a folder for each symbol and day of this write, and a row for each in the manifest.

    ``sequence`` numbers the writes, from 0; a later write of a symbol and day
    replaces the earlier one for readers.  Rows without a symbol or a time are no
    bars and are left out.  Folders are named by the MD5 of the symbol, which may hold any character.
    """
    rows = bars.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(BARS))).where("symbol IS NOT NULL AND ts IS NOT NULL").withColumn("day", F.to_date("ts"))
    root = f"{path.rstrip('/')}/bars/sequence={sequence}"
    rows.repartition("symbol", "day").sortWithinPartitions("symbol", "ts").withColumn("of", F.md5("symbol")).write.partitionBy("of", "day").parquet(root)
    made = rows.groupBy("symbol", "day").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows")).withColumns({
        "cached_at": F.lit(cached_at).cast("timestamp_ntz"), "sequence": F.lit(sequence).cast("long"), "folder": F.concat(F.lit(f"bars/sequence={sequence}/of="), F.md5("symbol"), F.lit("/day="), F.col("day").cast("string"))})
    made.repartition(1).sortWithinPartitions("symbol", "day").write.mode("append").parquet(f"{path.rstrip('/')}/manifest/")


#: Rows that one task reads, more or less.
ROWS = 500_000


@dataclass
class Pieces(InputPartition):
    """Folders, each of one symbol and day, that one task reads."""

    folders: tuple[str, ...]


def _packed(entries: list[dict]) -> list[Pieces]:
    out: list[list[str]] = []
    size = ROWS
    for r in entries:
        if size + r["n_rows"] > ROWS:
            out.append([])
            size = 0
        out[-1].append(r["folder"])
        size += r["n_rows"]
    return [Pieces(tuple(x)) for x in out]


def _root(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Cache:
    """What batch and stream readers share: the manifest, and how a piece is read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.symbols = {s.strip() for s in options["symbols"].split(",")} if options.get("symbols") else None
        self.age = float(options["maxagehours"]) if options.get("maxagehours") else None
        self.now = dt.datetime.fromisoformat(options["now"]) if options.get("now") else None
        if self.age is not None and self.now is None:
            raise ValueError("maxAgeHours needs now, the time that ages are counted to")

    def entries(self) -> list[dict]:
        """The rows of the manifest that count: of wanted symbols, young enough, the newest write of each symbol and day."""
        fs, root = _root(self.path)
        rows = ds.dataset(f"{root}/manifest", filesystem=fs, format="parquet", schema=_schema(MANIFEST)).to_table().to_pylist()
        rows = [r for r in rows if self.symbols is None or r["symbol"] in self.symbols]
        if self.age is not None:
            rows = [r for r in rows if self.now - r["cached_at"] < dt.timedelta(hours=self.age)]
        return sorted(rows, key=lambda r: (r["sequence"], r["symbol"], r["day"]))

    def load(self, pieces: Pieces, limits: list[tuple]) -> Iterator[pa.RecordBatch]:
        fs, root = _root(self.path)
        wanted = None
        for op, column, value in limits:
            side = {"=": ds.field(column) == value, ">": ds.field(column) > value, ">=": ds.field(column) >= value, "<": ds.field(column) < value, "<=": ds.field(column) <= value}[op]
            wanted = side if wanted is None else wanted & side
        for folder in pieces.folders:
            yield from ds.dataset(f"{root}/{folder}", filesystem=fs, format="parquet", schema=_schema(BARS)).to_batches(filter=wanted)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "double": pa.float64(), "long": pa.int64(), "date": pa.date32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class BarCacheReader(DataSourceReader):
    """Prunes symbols and days by the manifest, and rows within a day by the pushed limits of time."""

    OPS = ((GreaterThan, ">"), (GreaterThanOrEqual, ">="), (LessThan, "<"), (LessThanOrEqual, "<="), (EqualTo, "="))

    def __init__(self, options: dict[str, str]) -> None:
        self.cache = _Cache(options)
        self.names: set[str] | None = None
        self.limits: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes symbols (= and IN) and limits of ts; gives the others back to Spark."""
        for f in filters:
            op = next((sign for kind, sign in self.OPS if isinstance(f, kind)), None)
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                names = set(f.value) if isinstance(f, In) else {f.value}
                self.names = names if self.names is None else self.names & names
            elif op and f.attribute == ("ts",) and isinstance(f.value, dt.datetime):
                self.limits.append((op, "ts", f.value))
            else:
                yield f

    def partitions(self) -> list[Pieces]:
        newest = {(r["symbol"], r["day"]): r for r in self.cache.entries()}
        keep = []
        for r in newest.values():
            if self.names is not None and r["symbol"] not in self.names:
                continue
            if all({"=": r["first_ts"] <= v <= r["last_ts"], ">": r["last_ts"] > v, ">=": r["last_ts"] >= v, "<": r["first_ts"] < v, "<=": r["first_ts"] <= v}[op] for op, _, v in self.limits):
                keep.append(r)
        return _packed(keep) or [Pieces(())]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        yield from self.cache.load(partition, self.limits)


class BarCacheStream(DataSourceStreamReader):
    """A poll of the cache: an offset is the number of the next write, so a batch is the pieces of some writes, whenever it is run."""

    def __init__(self, options: dict[str, str]) -> None:
        self.cache = _Cache(options)

    def initialOffset(self) -> dict:
        return {"sequence": 0}

    def latestOffset(self) -> dict:
        return {"sequence": max((r["sequence"] for r in self.cache.entries()), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return _packed([r for r in self.cache.entries() if start["sequence"] <= r["sequence"] < end["sequence"]])

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        yield from self.cache.load(partition, [])


class BarCache(DataSource):
    """Options: path; symbols, a list with commas, for a universe; maxAgeHours and now, beyond which entries do not count.

    The manifest is read on the driver: it has a row for each symbol and day, not for each bar.
    Bars are read as Arrow batches by the tasks, from any file system that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "bar_cache"

    def schema(self) -> str:
        return BARS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BarCacheReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return BarCacheStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BarCache)
