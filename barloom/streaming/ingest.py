"""Ingest of documents from a stream of their changes: chunks follow the newest text, replays change nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A change: a document's new text, or that it is gone.
CHANGES = "doc_id long, source string, text string, deleted boolean"
DOCS = "doc_id long, source string, hash string, n_chunks long, status string, batch long"
ERRORS = "doc_id long, source string, reason string, batch long"
#: Up to so many ids of documents with different changes in one batch are broadcast.
SEVERAL = 500_000


@dataclass
class Ingest:
    """The tables of an ingest below one folder: docs (a log of what each batch changed), chunks, errors; given and changed are steps of a batch, without texts.

    Every batch writes folders of its own number and replaces them when it is run
    again, and what it does follows from earlier batches alone: so a replay after a failure
    leaves the same state.  ``chunker`` takes (doc_id, text) and gives (doc_id, chunk, text).
    """

    spark: SparkSession
    path: str
    chunker: Callable[[DataFrame], DataFrame]
    chunk_schema: str = "doc_id long, chunk int, text string"

    def _log(self, name: str, schema: str) -> DataFrame:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def documents(self, before: int | None = None) -> DataFrame:
        """The newest entry of each document, of batches before a number if one is given; deleted ones are gone."""
        log = self._log("docs", DOCS)
        log = log if before is None else log.where(F.col("batch") < before)
        rest = [f.name for f in T.StructType.fromDDL(DOCS) if f.name != "doc_id"]
        newest = log.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select("doc_id", "x.*")
        return newest.where("status <> 'deleted'")

    def chunks(self) -> DataFrame:
        """The chunks of the newest text of each document: those of the batch that wrote it."""
        rows = self._log("chunks", f"{self.chunk_schema}, batch long")
        return rows.join(self.documents().select("doc_id", "batch"), ["doc_id", "batch"], "left_semi")

    def errors(self) -> DataFrame:
        return self._log("errors", ERRORS)

    def totals(self) -> DataFrame:
        """(source, n_docs, n_chunks, n_errors) of what is there and of all rows that could not be taken."""
        held = self.documents().groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chunks").alias("n_chunks"))
        failed = self.errors().groupBy(F.col("source").alias("failed")).agg(F.count("*").alias("n_errors"))
        both = held.join(failed, F.col("source").eqNullSafe(F.col("failed")), "full")
        return both.select(F.coalesce("source", "failed").alias("source"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_chunks", "n_errors")))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take one batch of CHANGES; of a document's changes in it the deletion, or else the largest text, counts.

        A row without an id or, unless it is a deletion, without any word is an
        error and changes nothing.  A text whose MD5 is known is skipped, a deletion of an unknown document too.
        """
        gone = F.coalesce("deleted", F.lit(False))
        empty = ~gone & ~F.coalesce("text", F.lit("")).rlike(r"[^ \t\n\x0b\f\r]")
        reason = F.when(F.col("doc_id").isNull(), "no id").when(empty, "no text")
        batch = batch.withColumn("reason", reason)
        self._write(batch.where("reason IS NOT NULL").select("doc_id", "source", "reason"), "errors", number)
        given = batch.where("reason IS NULL").select("doc_id", gone.alias("gone"), "text", "source", F.md5("text").alias("hash"))
        # Texts stay where they are as long as their MD5 decides; where a document has different changes, the texts themselves do.
        order = F.struct("gone", "hash", "source")
        self._write(given.groupBy("doc_id").agg(F.max(order).alias("x"), (~F.min(order).eqNullSafe(F.max(order))).alias("several")).select("doc_id", "x.*", "several"), "given", number)
        first = self.spark.read.schema("doc_id long, gone boolean, hash string, source string, several boolean").parquet(f"{self.path}/given/batch={number}")
        several = first.where("several").select("doc_id")
        n_several = several.count()
        latest = first.where("NOT several").select("doc_id", "gone", "hash", "source")
        if n_several:
            several = F.broadcast(several) if n_several <= SEVERAL else several
            largest = given.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("gone", "text", "source")).alias("x"))
            latest = latest.unionByName(largest.select("doc_id", "x.gone", F.md5("x.text").alias("hash"), "x.source"))
        latest = latest.withColumn("hash", F.when(~F.col("gone"), F.col("hash")))
        known = self.documents(number).select("doc_id", F.col("hash").alias("known"))
        status = F.when(F.col("gone"), F.when(F.col("known").isNotNull(), "deleted")).when(F.col("known").isNull(), "new").when(F.col("known") != F.col("hash"), "modified")
        self._write(latest.join(known, "doc_id", "left").withColumn("status", status).where("status IS NOT NULL").select("doc_id", "source", "hash", "status"), "changed", number)
        changed = self.spark.read.schema("doc_id long, source string, hash string, status string").parquet(f"{self.path}/changed/batch={number}")
        by = ["doc_id", "hash"]
        texts = given.where("NOT gone").select(*by, "text").join(changed.where("status <> 'deleted'").select(*by), by, "left_semi").groupBy(*by).agg(F.max("text").alias("text"))
        self._write(self.chunker(texts.select("doc_id", "text")), "chunks", number)
        schema = T.StructType.fromDDL(self.chunk_schema)
        counts = self.spark.read.schema(schema).parquet(f"{self.path}/chunks/batch={number}").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        # The log comes last: without it the batch has not been.
        self._write(changed.join(counts, "doc_id", "left").select("doc_id", "source", "hash", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "status"), "docs", number)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/batch={number}")

    def run(self, changes: DataFrame) -> None:
        """Take what a stream of CHANGES has now; a later call goes on where this one stopped."""
        query = changes.writeStream.option("checkpointLocation", f"{self.path}/state").foreachBatch(self.apply).trigger(availableNow=True).start()
        query.awaitTermination()


def changes_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """CHANGES from Parquet files as they come."""
    reader = spark.readStream.schema(CHANGES)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def word_windows(size: int, step: int) -> Callable[[DataFrame], DataFrame]:
    """A chunker: windows of ``size`` words, one each ``step`` words."""
    def chunk(docs: DataFrame) -> DataFrame:
        words: Column = F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
        rows = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(step))
        return rows.select("doc_id", "w", F.posexplode(starts).alias("chunk", "at")).select("doc_id", "chunk", F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("text"))

    return chunk
