"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut_lineage, join_counted, key_runs, run_starts, spanning_forest, stash

SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fingerprints that one task compares with each other at a time.
BLOCK = 2048
#: Shingles whose bits are counted at a time; bounds memory for very long texts.
CHUNK = 1 << 16
#: Segment values of more than 1/HOT of all rows are joined by broadcast: there are at most HOT.
HOT = 1000


def ones(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each of the 64 bits is set."""
    total = np.zeros(64, np.int64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for j in range(0, len(bits), 255):  # sums of up to 255 ones fit a byte
        total += bits[j:j + 255].sum(axis=0, dtype=np.uint8)
    return total


def majority(total: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are set in over half of ``n`` hashes."""
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int) -> int:
    """The 64-bit SimHash of the XXH64 of all ``width``-word shingles; without words 0."""
    data = text.encode("utf-8", "surrogatepass")
    if not data.isascii() or data.lower() != data:
        data = data.translate(_LOWER)
    words = WORD.findall(data)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    w = min(width, len(words))
    starts, ends = starts[: len(words) - w + 1], ends[w - 1:]
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        total += ones(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i:i + CHUNK].tolist(), ends[i:i + CHUNK].tolist())], np.uint64))
    return majority(total, len(starts))


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of each row's whole text; null text counts as empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t or "", width) for t in batch["body"]], np.uint64)
            yield pd.DataFrame({"id": batch["id"], "known": batch["known"], "fp": fp.view(np.int64)})

    # A column of longs with nulls would pass through doubles.
    held = docs.select(F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.col(id_col).isNotNull().alias("known"), F.col(text_col).alias("body"))
    return held.mapInPandas(run, "id long, known boolean, fp long").select(F.when(F.col("known"), F.col("id")).alias("id"), "fp")


def _segment(fp: Column, table: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if table else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Enough of the pairs (a, b) of distinct fingerprints at most 3 bits apart to connect
    all that are linked.

    Two 32-bit segments cannot both differ in two bits, so each pair agrees in
    one segment up to one bit.  Each table files every fingerprint under its
    segment and looks up the Hamming ball of radius one around it; for a pair
    one of both has the 0 where they differ, so only 0-to-1 flips are looked up.
    The members of a bucket are compared in numpy over all 64 bits, and only a
    spanning forest of its links leaves the task: no pairs within a group are
    emitted.  A bucket too large for one block is dealt out as pairs of blocks.
    """
    if distance > 3:
        raise ValueError("two segments with balls of radius one cover up to 3 differing bits")
    table = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("t")).select(
        "t", F.when(F.col("t") == 0, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1)).alias("v"), "fp")
    # Balls are enumerated around segment values, however many fingerprints have one, and met with the values that some fingerprint has.
    held = stash(table.groupBy("t", "v").agg(F.count("*").alias("n")))
    ball = held.select("t", F.col("v").alias("near"), "n", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")).where(F.getbit("near", "bit") == 0)
    ball = ball.select("t", "near", "n", F.col("near").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("v"))
    matched = stash(ball.join(held.select("t", "v"), ["t", "v"]).groupBy("t", "near", "n").agg(F.collect_list("v").alias("vs")))
    looked = join_counted(table.withColumnRenamed("v", "near"), matched, ["t", "near"], "n", HOT)
    members = stash(table.select("t", "v", F.lit(True).alias("own"), "fp").unionByName(looked.select("t", F.explode("vs").alias("v"), F.lit(False).alias("own"), "fp")))
    sizes = stash(members.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1"))
    members = join_counted(members, sizes, ["t", "v"], "n", HOT)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = members.select("t", "v", "own", "fp", block.alias("k"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    dealt = dealt.select("t", "v", F.least("k", "j").alias("i"), F.greatest("k", "j").alias("j"), (F.col("k") > F.col("j")).alias("right"), "own", "fp")
    keys = ["t", "v", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in key_runs(batches, keys):
            fp, own = part["fp"].to_numpy().view(np.uint64), part["own"].to_numpy()
            right, cross = part["right"].to_numpy(), (part["i"] != part["j"]).to_numpy()
            starts = run_starts(*(part[k].to_numpy() for k in keys))
            ends = np.append(starts[1:], len(part))
            size = ends - starts
            out_a, out_b = [], []
            # Runs of two need no matrix; most runs are such.
            two = starts[size == 2]
            ok = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance) & (own[two] | own[two + 1])
            out_a.append(fp[two][ok])
            out_b.append(fp[two + 1][ok])
            for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
                x, o = fp[s:e], own[s:e]
                left, other = (~right[s:e], right[s:e]) if cross[s] else (slice(None), slice(None))
                xa, oa, xb, ob = x[left], o[left], x[other], o[other]
                for c in range(0, len(xa), BLOCK):
                    hit = np.bitwise_count(xa[c:c + BLOCK, None] ^ xb[None, :]) <= distance
                    hit &= oa[c:c + BLOCK, None] | ob[None, :]
                    p, q = np.nonzero(hit)
                    a, b = xa[c:c + BLOCK][p], xb[q]
                    keep = a != b
                    a, b = spanning_forest(a[keep], b[keep])
                    out_a.append(a)
                    out_b.append(b)
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            a, b = spanning_forest(a, b)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id): link texts whose fingerprints differ in at most
    ``distance`` bits.

    component_id is the smallest id reachable over links, the row's own included.
    Rows of one fingerprint are one node from the start, so a large group of
    copies costs no more than one document.  Null or wordless text has
    fingerprint zero and is linked like any other; rows with a null id keep a
    fingerprint and take part as such, repeated ids are rows of their own.  An
    empty table gives an empty result; other columns are ignored.
    """
    each = cut_lineage(fingerprints(docs, id_col, text_col, width))
    classes = cut_lineage(each.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    edges = links(classes.select("fp"), distance)
    parts = connected_components(edges, "a", "b")
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = cut_lineage(named.join(smallest, "component").select("fp", "n", "component_id"))
    return join_counted(each, by_fp, ["fp"], "n", HOT).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
