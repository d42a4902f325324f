"""Hard negatives of anchors by a full sort of their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, join_counted, key_runs, run_starts, shuffle_partitions, stash

#: Anchors and other rows that meet in one block; scores of STRIP anchors are held at a time.
ANCHORS, ROWS, STRIP = 1024, 4096, 64
#: Vector lengths of more than 1/HOT of all rows are joined by broadcast: there are at most HOT.
HOT = 1000
#: Stands for a null id, which comes last.
NULL = (1 << 63) - 1
#: Doubles hold every integer up to here.
EXACT = 2.0 ** 53


def _matrix(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    return np.floor(np.stack(vectors).astype(np.float64) * scale)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers as int64; an error beyond the range of a long."""
    bound = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    x, y = (np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape) for m in (a, b))
    exact = x @ y.T
    if any(not -(1 << 63) <= v < 1 << 63 for v in exact.ravel()):
        raise ValueError("a score leaves the range of a long")
    return exact.astype(np.int64)


def sorted_scores(s: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of scores the places from the highest score down, ties by smaller id."""
    return np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)


def _blocks(rows: DataFrame, anchors: DataFrame, body: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``body(anchors, rows)`` of every block of anchors with every block of rows of the same vector length."""
    sizes = stash(rows.groupBy("dim").agg(F.count("*").alias("n")).join(anchors.groupBy("dim").agg(F.count("*").alias("m")), "dim").select(
        "dim", "n", F.ceil(F.col("n") / ROWS).cast("int").alias("right_blocks"), F.ceil(F.col("m") / ANCHORS).cast("int").alias("left_blocks")))
    own = lambda blocks: F.pmod(F.xxhash64("rid"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    held = ["dim", "i", "j", "anchor", "rid", "id", "label", "vec"]
    right = join_counted(rows, sizes, ["dim"], "n", HOT).select("*", each("left_blocks").alias("i"), own("right_blocks").alias("j"), F.lit(False).alias("anchor"))
    left = join_counted(anchors, sizes, ["dim"], "n", HOT).select("*", own("left_blocks").alias("i"), each("right_blocks").alias("j"), F.lit(True).alias("anchor"))
    more = [c for c in anchors.columns if c not in rows.columns]
    dealt = left.select(*held, *more).unionByName(right.select(*held), allowMissingColumns=True)
    keys = ["dim", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in key_runs(batches, keys):
            starts = run_starts(*(part[k].to_numpy() for k in keys))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                group = part.iloc[s:e]
                is_anchor = group["anchor"].to_numpy(bool)
                a, b = group[is_anchor], group[~is_anchor]
                for at in range(0, len(a) if len(b) else 0, STRIP):
                    yield body(a.iloc[at:at + STRIP], b)
        give_back()

    # A block is one key, and its size is bounded; the numbers of a pair of blocks spread over all tasks.
    return dealt.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _best(found: DataFrame, by: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each key; the tasks that found them drop what cannot be among these before the shuffle."""
    return found.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = 5, negatives: int = 3, lower: tuple[int, int] = (50, 100), upper: tuple[int, int] = (95, 100), scale: float = 256.0) -> DataFrame:
    """For each anchor and each of its positives, hard negatives: close rows of another label, not too close.

    A component x counts as floor(scale * x), so a score, the inner product with
    the anchor, is an exact integer.  An anchor's positives are its first
    ``positives`` other rows of the same label by score, ties by smaller id; of
    the rows of other labels the first ``negatives`` are returned whose score is
    at least ``lower`` and at most ``upper`` times (as fractions) that of the positive.

    Anchors and rows are dealt out in blocks of bounded size and every block of
    anchors meets every block of rows: the anchors are a stated query set.  In a
    block each anchor's scores are sorted in full by score and id; the places of
    the upper limits come from binary search and what follows is read down to the
    lower one.  A block returns at most ``positives`` rows an anchor, or
    ``negatives`` a positive, and the best of these over all blocks stay.  The first
    pass finds positives, the second negatives.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score); rank counts from 1.  Rows with a null label, a null vector or
    any null or non-finite component take no part; vectors of another length
    than the anchor's are not compared with it, empty ones score zero.  Rows of
    one id are rows of their own, and each may be a positive of the other; a null
    id comes after all others.  A negative positive's score leaves no negatives.  A score beyond the
    range of a long is an error.  Anchors without positives or negatives give no rows, nor does an
    empty table; other columns are ignored.
    """
    vec, label = F.col(vector_col), F.col(label_col)
    fine = label.isNotNull() & vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    used = rows.where(fine).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL)).alias("id"), label.alias("label"), vec.alias("vec"), F.size(vec).alias("dim"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    # The number of a row is written once, so it stays the same in both passes.
    used = stash(used.withColumn("rid", F.monotonically_increasing_id()))
    held, anchors = used.drop("anchor"), used.where("anchor").drop("anchor")
    labels = lambda a, b: (a["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :])

    def find_positives(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        s, ident = scores(_matrix(list(a["vec"]), scale), _matrix(list(b["vec"]), scale)), b["id"].to_numpy()
        order = sorted_scores(s, ident)
        same = labels(a, b) & (a["rid"].to_numpy()[:, None] != b["rid"].to_numpy()[None, :])
        out = []
        for k, (rid, row) in enumerate(zip(a["rid"].tolist(), order)):
            mine = row[same[k, row]][:positives]
            out.append(pd.DataFrame({"rid": rid, "positive_rid": b["rid"].to_numpy()[mine], "positive": ident[mine], "score": s[k, mine]}))
        return pd.concat(out, ignore_index=True)

    near = _best(_blocks(held, anchors, find_positives, "rid long, positive_rid long, positive long, score long"), ["rid"],
                 [F.desc("score"), F.asc("positive"), F.asc("positive_rid")], positives, "place")
    limits = near.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "score", "positive"))).alias("near")).select("rid", "near.score", "near.positive")
    limits = stash(anchors.join(limits, "rid"))

    def find_negatives(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        s, ident = scores(_matrix(list(a["vec"]), scale), _matrix(list(b["vec"]), scale)), b["id"].to_numpy()
        order = sorted_scores(s, ident)
        other = ~labels(a, b)
        out: list[tuple] = []
        for k, (rid, row, near) in enumerate(zip(a["rid"].tolist(), order, a["score"])):
            mine = row[other[k, row]]
            down = -s[k, mine]
            for place, p in enumerate(near.tolist()):
                # The largest score with upper[1] * score <= upper[0] * p, and the smallest allowed one.
                most, least = upper[0] * p // upper[1], -(-lower[0] * p // lower[1])
                at = int(np.searchsorted(down, -most))
                out += [(rid, place, ident[m], s[k, m]) for m in mine[at:at + negatives] if s[k, m] >= least]
        return pd.DataFrame(out, columns=["rid", "place", "negative", "score"])

    found = _best(_blocks(held, limits, find_negatives, "rid long, place int, negative long, score long"), ["rid", "place"],
                  [F.desc("score"), F.asc("negative")], negatives, "rank")
    named = limits.select("rid", F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("score", "positive")).alias("place", "x"))
    known = lambda c: F.when(F.col(c) != NULL, F.col(c))
    return found.join(named, ["rid", "place"]).select(
        known("anchor_id").alias("anchor_id"), known("x.positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative").alias("negative_id"),
        F.col("x.score").alias("positive_score"), F.col("score").alias("negative_score"))


def negative_report(rows: DataFrame) -> DataFrame:
    """Hard negatives of the embeddings whose vec_id is divisible by 50; where it is divisible by 7 the label moves on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0)
