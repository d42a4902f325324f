"""Line dedup by pairwise patience alignment."""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, bounded_batches, cut_lineage, give_back, join_counted, stash

#: Lines in more than 1/HOT of all occurrences are joined by broadcast: there are at most HOT.
HOT = 1000


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Aligned (i, j) with a[i] == b[j], both ascending, by patience diff.

    Common ends of a stretch are aligned; between them the lines that are unique
    in both stretches, thinned to the longest ascending sequence, are fixed and
    the stretches between these are treated alike.
    """
    x, y = a.tolist(), b.tolist()
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        lo, hi, lo2, hi2 = todo.pop()
        while lo < hi and lo2 < hi2 and x[lo] == y[lo2]:
            out.append((lo, lo2))
            lo, lo2 = lo + 1, lo2 + 1
        while lo < hi and lo2 < hi2 and x[hi - 1] == y[hi2 - 1]:
            hi, hi2 = hi - 1, hi2 - 1
            out.append((hi, hi2))
        if lo >= hi or lo2 >= hi2:
            continue
        in_x, in_y = Counter(x[lo:hi]), Counter(y[lo2:hi2])
        place = {v: j for j, v in enumerate(y[lo2:hi2], lo2) if in_y[v] == 1}
        both = [(i, place[v]) for i, v in enumerate(x[lo:hi], lo) if in_x[v] == 1 and v in place]
        if not both:
            continue
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(both):
            p = bisect_left(tails, j)
            back.append(ends[p - 1] if p else -1)
            if p == len(tails):
                tails.append(j)
                ends.append(k)
            else:
                tails[p], ends[p] = j, k
        k, fixed = ends[-1], []
        while k >= 0:
            fixed.append(both[k])
            k = back[k]
        at, at2 = lo, lo2
        for i, j in reversed(fixed):
            out.append((i, j))
            todo.append((at, i, at2, j))
            at, at2 = i + 1, j + 1
        todo.append((at, hi, at2, hi2))
    return sorted(out)


def common_lines(a: np.ndarray, b: np.ndarray, a2: np.ndarray | None = None, b2: np.ndarray | None = None) -> list[int]:
    """Places in ``b`` of the blocks it has in common with ``a`` that hold a line long enough (odd hashes).

    Blocks come from the alignment.  Lines that it leaves out, as they stand in
    another order or more often in one text, are matched with the short lines
    around them, so that every long line of ``b`` that ``a`` holds is found.
    Lines whose second hashes ``a2``, ``b2`` differ are not equal, whatever the first ones say.
    """
    a2, b2 = (a, b) if a2 is None else (a2, b2)
    out: set[int] = set()
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*((i, j) for i, j in align(a, b) if a2[i] == b2[j]), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if any(b[k] & 1 for k in block):
                out.update(block)
            block = []
        block.append(j)
        before = (i, j)
    shared = {h for h in set(a.tolist()) & set(b.tolist()) if h & 1}
    known = {r[2:] for r in runs(a, a2, shared)}
    for start, end, *run in runs(b, b2, shared):
        if tuple(run) in known:
            out.update(range(start, end + 1))
    return sorted(out)


def _key(id_col: str, text: Column) -> Column:
    return F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("t"))


def _line_hashes(lines: Column, min_chars: int) -> list[Column]:
    """Two 64-bit hashes for each line; the first is odd if the line has ``min_chars`` characters besides white space at its ends."""
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(WHITE)))
    return [F.transform(bare, lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2)) + F.when(F.length(x) >= min_chars, 1).otherwise(0)).alias("lines"),
            F.transform(bare, lambda x: F.xxhash64(F.lit("line"), x)).alias("seconds")]


def runs(lines: np.ndarray, seconds: np.ndarray, of: set[int]) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, two hashes) of each line in ``of`` and of its runs over the short lines after and before it.

    A run that goes on to the next long line needs no row: that line has runs of its own.
    """
    x, y = lines.tolist(), seconds.tolist()
    for at, h in enumerate(x):
        if h not in of:
            continue
        yield at, at, h, y[at]
        for step in (1, -1):
            mixed, j = (h, y[at]), at + step
            while 0 <= j < len(x) and not x[j] & 1:
                digest = xxhash.xxh3_128_digest(struct.pack("<qqqqb", *mixed, x[j], y[j], step))
                mixed = struct.unpack("<qq", digest)
                yield min(at, j), max(at, j), *mixed
                j += step


def _counted(held: DataFrame, by: list[str]) -> DataFrame:
    """``held`` with ``first`` and ``n``, the smallest key and the number of rows of its ``by``, where n > 1."""
    firsts = stash(held.groupBy(*by).agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"))
    return join_counted(held, firsts, by, "n", HOT)


def line_deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, paired: int = 32) -> DataFrame:
    """(key, gone): for each document that loses lines, their places.  See ``line_dedup``."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(_key(id_col, text).alias("key"), F.split(text, "\n").alias("split"))
    lines = stash(split.select("key", *_line_hashes(F.col("split"), min_chars)).dropDuplicates(["key"]))
    held = lines.select("key", F.explode(F.array_distinct(F.filter("lines", lambda h: h.bitwiseAND(F.lit(1)) == 1))).alias("h"))
    held = stash(_counted(held, ["h"]).select("key", "h", "n"))
    holders = held.where(F.col("n") <= paired).groupBy("h").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    pairs = holders.select("keys", F.posexplode("keys").alias("at", "key")).where("at > 0").select(
        "key", F.explode(F.slice("keys", F.lit(1), F.col("at"))).alias("first"))
    pairs = stash(pairs.distinct())
    both = pairs.join(lines.select(F.col("key").alias("first"), F.col("lines").alias("a"), F.col("seconds").alias("a2")), "first").join(
        lines.select("key", F.col("lines").alias("b"), F.col("seconds").alias("b2")), "key")

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = [common_lines(*x) for x in zip(batch["a"], batch["b"], batch["a2"], batch["b2"])]
            yield pd.DataFrame({"id": batch["id"], "t": batch["t"], "gone": gone})
        give_back()

    found = both.select("key.id", "key.t", "a", "b", "a2", "b2").mapInPandas(aligned, "id long, t long, gone array<int>").where(F.size("gone") > 0)
    frequent = held.where(F.col("n") > paired).groupBy("key").agg(F.collect_list("h").alias("frequent")).join(lines, "key")

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, t, *r) for i, t, f, x, y in zip(batch["id"], batch["t"], batch["frequent"], batch["lines"], batch["seconds"]) for r in runs(x, y, set(f.tolist()))]
            yield pd.DataFrame(out, columns=["id", "t", "start", "end", "run", "run2"])
        give_back()

    known = frequent.select("key.id", "key.t", "frequent", "lines", "seconds").mapInPandas(looked_up, "id long, t long, start int, end int, run long, run2 long")
    known = stash(known.select(F.struct("id", "t").alias("key"), "start", "end", "run", "run2"))
    repeats = _counted(known, ["run", "run2"]).where("first < key").select("key", F.sequence("start", "end").alias("gone"))
    gone = found.select(F.struct("id", "t").alias("key"), "gone").unionByName(repeats).select("key", F.explode("gone").alias("at"))
    return gone.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, paired: int = 32) -> DataFrame:
    """Delete from each document the blocks of lines that it shares with earlier ones.

    A line of at least ``min_chars`` characters goes if an earlier document (smaller id)
    holds it, with the shorter lines next to it as far as they stand next to it
    there too: the same rule for every line, rare or frequent.  Shorter lines
    alone are kept.  Lines are compared without the white space at their ends
    (any that Unicode knows) and by 128 bits.

    Each document is paired with every earlier one that shares a rare line, one
    which at most ``paired`` documents hold.  A pair is aligned by patience diff;
    the aligned blocks of the later document go, and then what the alignment
    left out because it stands in another order.  A frequent line would pair its holders by
    the square of their number: its runs over the short lines around it are joined by hash with the first
    document that has them, a row for each line of a run, which finds the same lines.  So
    ``paired`` divides the work and does not change the result.
    Lines are matched in the texts as given, so the result does not depend on order.

    Returns the input's columns in a struct ``row``, with n_lines, n_removed and
    kept_text.  Null text counts as empty (one empty line); rows of one id and
    text are one document and are treated alike; of one id with several texts
    the order is by a hash.  Very long texts are aligned whole.  Ids are integers.
    An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = cut_lineage(line_deletions(docs, id_col, text_col, min_chars, paired))
    rows = docs.select(F.struct("*").alias("row"), text.alias("body"), _key(id_col, text).alias("key"))
    kept = F.filter("lines", lambda x, i: ~F.array_contains("gone", i))
    return rows.join(gone, "key", "left").select("row", "body", "gone", F.split("body", "\n").alias("lines")).select(
        "row", F.size("lines").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("kept_text"))


def line_report(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_chars_kept, kept_sha256) of documents."""
    return line_dedup(docs.select("doc_id", "text"), **options).select(
        "row.doc_id", "n_lines", "n_removed", F.length("kept_text").alias("n_chars_kept"), F.sha2("kept_text", 256).alias("kept_sha256"))
