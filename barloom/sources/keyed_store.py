"""Tables of newest rows by key: bucketed, so that reads by key move nothing, and rewritten only where a batch touches them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: What the records of trades call their fields, the name that goes first first.  Fixed values.
TRADE_ALIASES = {
    "direction": ["side", "direction"], "entry_price": ["price", "entry_price"], "entry_time": ["timestamp", "entry_time"], "net_pnl": ["pnl", "net_pnl"],
    "si_at_entry": ["si_value", "si_at_entry"], "si_at_exit": ["exit_si", "si_at_exit"], "atr_at_entry": ["atr", "atr_at_entry"],
}


def canonical(rows: DataFrame, fields: T.StructType, aliases: dict[str, list[str]], defaults: dict[str, object] | None = None) -> DataFrame:
    """``rows`` with the columns of ``fields``: each is the first that is there and not null of its aliases (else of its own name), then its default, else null.

    Names that no field asks for are left out; text and numbers are cast to the field's type.
    """
    def one(f: T.StructField) -> Column:
        found = [F.col(f"`{n}`").cast(f.dataType) for n in aliases.get(f.name, [f.name]) if n in rows.columns]
        return F.coalesce(*found, F.lit((defaults or {}).get(f.name)).cast(f.dataType)).alias(f.name)

    return rows.select(*map(one, fields.fields))


class KeyedStore:
    """The newest row of each key, in a table partitioned by one column and bucketed by the others of the key.

    A key is ``part`` and ``keys``, none of them null.  ``upsert`` shuffles the batch alone, and
    once: it is dealt out as the table's buckets are.  Only the partitions that the batch
    names are read, and dynamic partition overwrite replaces those of them in which a row of it counts.
    """

    def __init__(self, spark: SparkSession, schema: str, part: str, keys: list[str], buckets: int = 8, path: str | None = None) -> None:
        self.spark, self.part, self.keys, self.buckets = spark, part, keys, buckets
        fields = T.StructType.fromDDL(schema).fields
        self.fields = T.StructType([f for f in fields if f.name != part] + [f for f in fields if f.name == part])
        self.name = f"keyed_{uuid.uuid4().hex}"
        self.path = path or f"{shared_folder(spark).rstrip('/')}/{self.name}"
        stored = T.StructType([*self.fields.fields[:-1], T.StructField("version", T.LongType()), T.StructField("deleted", T.BooleanType()), self.fields.fields[-1]])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored)
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY (`{part}`) CLUSTERED BY ({', '.join(f'`{k}`' for k in keys)}) INTO {buckets} BUCKETS LOCATION '{self.path}' OPTIONS (compression 'zstd')")
        self.stored = stored

    def upsert(self, rows: DataFrame, version: int, aliases: dict[str, list[str]] | None = None, defaults: dict[str, object] | None = None, deleted: bool = False) -> None:
        """Insert or replace; of a key's rows the one of highest version stays, of one version the later call, of one call the largest row.

        Columns go by ``aliases``; those that ``rows`` lacks are null.
        """
        given = canonical(rows, self.fields, aliases or {}, defaults).withColumns({"version": F.lit(version).cast("long"), "deleted": F.lit(deleted)})
        key = [self.part, *self.keys]
        rest = [f.name for f in self.stored if f.name not in key]
        fresh = given.repartition(self.buckets, *self.keys).groupBy(*key).agg(F.max(F.struct(*rest)).alias("_new"))
        table = self.spark.table(self.name)
        named = lambda rows: [r[0] for r in rows.select(self.part).distinct().collect()]  # noqa: E731  partitions of the table, as many as folders
        # Buckets by ``keys`` serve a join by ``key``; a checkpoint of an adaptive plan would forget how its rows are dealt out.
        conf = {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.enabled": "false"}
        before = {k: self.spark.conf.get(k) for k in conf}
        try:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
            fresh = fresh.checkpoint()
            late = table.where(F.col(self.part).isin(named(fresh)) & (F.col("version") > version)).select(*key)
            parts = named(fresh.hint("shuffle_merge").join(late, key, "left_anti"))
            if not parts:
                return
            held = table.where(F.col(self.part).isin(parts)).select(*key, F.struct(*rest).alias("_old"))
            newest = F.when(F.col("_new").isNull() | (F.col("_old.version") > F.col("_new.version")), F.col("_old")).otherwise(F.col("_new"))
            both = held.join(fresh.where(F.col(self.part).isin(parts)).hint("shuffle_merge"), key, "full").select(*key, newest.alias("x")).select(*key, "x.*").select(*self.stored.names)
            both.write.insertInto(self.name, overwrite=True)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def delete(self, keys: DataFrame, version: int) -> None:
        """Rows of these keys are gone until a later version of them comes."""
        self.upsert(keys, version, deleted=True)

    def read(self) -> DataFrame:
        return self.spark.table(self.name).where(~F.col("deleted")).select(*self.fields.names)

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
