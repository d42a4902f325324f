"""From raw documents to token ids: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever further columns these have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.bpe import decode, encode
from barloom.llm.common import WHITE, stash, table
from barloom.llm.line_dedup import line_dedup
from barloom.llm.mixing import mix_sources
from barloom.llm.quality import classify, trusted_labels
from barloom.llm.queries import tokenizer_path
from barloom.llm.shingle_dedup import shingle_components


def _row(docs: DataFrame, **new: object) -> list:
    """The columns of ``docs`` out of the struct ``row``, some replaced."""
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose perplexity is above their language's threshold."""
    return classify(docs, trusted_labels(table(spark, sf_dir, "labels"))).where("kept").select(*_row(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks of lines that earlier documents hold, and documents of which nothing is left.

    n_chars follows the text.  A document without text from the start stays, as
    does one that loses no line; one left with white space alone goes.
    """
    out = line_dedup(docs)
    same = F.col("n_removed") == 0
    left = same | (F.btrim("kept_text", F.lit(WHITE)) != "")
    new = {"text": F.when(same, F.col("row.text")).otherwise(F.col("kept_text")), "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("kept_text"))}
    return out.where(left).select(*_row(docs, **new))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more exactly one row stays.

    It is the one with the smallest id, a null id coming last; rows of one id go
    by a hash of the text, then of the row.
    """
    keys = [F.col("row.doc_id").alias("own_id"), F.xxhash64("row.text").alias("text_hash"), F.xxhash64("row").alias("row_hash")]
    packed = docs.select(F.struct("*").alias("row")).select("row", *keys)
    names = ["own_id", "text_hash", "row_hash"]
    parts = shingle_components(packed.select(*names, F.col("row.text").alias("text")), names)
    order = F.struct(F.col("own_id").isNull().alias("no_id"), *names)
    stays = parts.groupBy("component").agg(F.min(order).alias("stays"))
    chosen = [F.col(k).eqNullSafe(F.col("stays").getField(k)) for k in names]
    return packed.join(stays, chosen).dropDuplicates(["component"]).select(*_row(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources reach their target shares, in random order."""
    return mix_sources(docs).select(*_row(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded_sha256) of every document."""
    path = tokenizer_path()
    encoded = encode(docs.select("doc_id", "lang", "source", "text"), path)
    decoded = decode(encoded.select("row.doc_id", "row.lang", "row.source", "ids"), path)
    return decoded.select("row.doc_id", "row.lang", "row.source", F.size("row.ids").cast("long").alias("n_tokens"), "row.ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("mix_sources", mix), ("bpe", tokens)]

#: Perplexities under a Kneser-Ney model are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
