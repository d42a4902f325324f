"""Near-dedup by exact Jaccard similarity of word shingles; SimHash proposes the pairs, and MinHash those that differ in more bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bucket_blocks, connected_components, give_back, join_counted, key_runs, run_starts, stash
from .simhash import _LOWER, CHUNK, SEED, WORD, links, majority, ones

#: Words in a shingle, and the similarity from which two texts are linked, as a fraction.
WIDTH, SIMILARITY = 5, (4, 5)
#: A pair at similarity 0.8 shares a bucket of some band with chance 1 - (1 - 0.8 ** 8) ** 40 = 0.9994.
ROWS, BANDS = 8, 40
#: Tables are numbered in the low bits of a bucket's key: 0 is that of SimHash, then come the bands.
TABLES = 64
#: Of ROWS x BANDS minima a pair at similarity 0.8 has so many in common but for one time in 10 ** 7 (5.4 standard deviations).
LEAST = 218
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
#: Shingles hashed for all bands at a time; fits a cache.
PIECE = 256
#: Texts of a bucket that meet in one block, and comparisons of minima made at a time.
BLOCK, CHUNK_PAIRS = 256, 1 << 13
#: Keys of more than 1/HOT of all rows are joined by broadcast: there are at most HOT.
HOT = 1000


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 of all ``width``-word shingles (of all words where there are fewer), ascending."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    w = min(width, len(words))
    starts, ends = starts[: len(words) - w + 1], ends[w - 1:]
    digest = xxhash.xxh64_intdigest
    out = [np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i:i + CHUNK].tolist(), ends[i:i + CHUNK].tolist())], np.uint64) for i in range(0, len(starts), CHUNK)]
    return np.unique(np.concatenate(out))


def minima(h: np.ndarray) -> bytes:
    """The low 16 bits of the minimum of each of ROWS x BANDS hash functions over a set."""
    low = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), PIECE):
        np.minimum(low, (x[i:i + PIECE, None] * _A + _B).min(axis=0), out=low)
    low ^= low >> np.uint32(16)
    return low.astype("<u2").tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def _candidates(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, band: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of minima that may be similar and share no band before ``band``, with the number of minima in common."""
    step = max(1, CHUNK_PAIRS // max(1, len(y)))
    for c in range(0, len(x), step):
        same = x[c:c + step, None, :] == y[None, :, :]
        common = same.sum(axis=2)
        small, large = np.minimum(n[c:c + step, None], m[None, :]), np.maximum(n[c:c + step, None], m[None, :])
        ok = (common >= LEAST) & (small * SIMILARITY[1] >= large * SIMILARITY[0])
        p, q = np.nonzero(ok)
        if band and len(p):
            new = ~same[p, q, : band * ROWS].reshape(len(p), band, ROWS).all(axis=2).any(axis=1)
            p, q = p[new], q[new]
        yield p + c, q, common[p, q]


def _forest(ids: list[int], sets: list[bytes], p: np.ndarray, q: np.ndarray, common: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs, enough to connect what is linked: the likeliest are tried first, and none within a tree."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    out = []
    for k in np.argsort(-common, kind="stable").tolist():
        a, b = int(p[k]), int(q[k])
        x, y = find(a), find(b)
        if x != y and similar(np.frombuffer(sets[a], np.uint64), np.frombuffer(sets[b], np.uint64)):
            up[x] = y
            out.append((ids[a], ids[b]))
    return out


def _links(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): enough of the pairs of similar texts that share a bucket to connect all of them."""
    keys = ["key", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in key_runs(batches, keys):
            starts = run_starts(*(part[k].to_numpy() for k in keys))
            ids, sets_, n = part["s"].tolist(), part["sh"].tolist(), part["n"].to_numpy()
            low = np.frombuffer(b"".join(part["low"]), "<u2").reshape(len(part), ROWS * BANDS)
            right, cross, band = part["right"].to_numpy(), (part["i"] != part["j"]).to_numpy(), np.maximum(part["key"].to_numpy() % TABLES - 1, 0)
            out = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                at = np.arange(s, e)
                left, other = (at[~right[s:e]], at[right[s:e]]) if cross[s] else (at, at)
                if e - s < 2 or not len(left) or not len(other):
                    continue
                found = list(_candidates(low[left], low[other], n[left], n[other], int(band[s])))
                p, q, common = (np.concatenate(x) for x in zip(*found))
                if not cross[s]:
                    once = p < q
                    p, q, common = p[once], q[once], common[once]
                out += _forest(ids, sets_, left[p], other[q], common)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        give_back()

    return dealt.join(sets, "s").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def simhash_groups(nodes: DataFrame) -> DataFrame:
    """(s, group): which of the rows (s, fp) are linked by fingerprints that differ in at most three bits."""
    fps = stash(nodes.groupBy("fp").agg(F.count("*").alias("rows")))
    parts = connected_components(links(fps.select("fp")), "a", "b").withColumnsRenamed({"node": "fp", "component": "group"})
    named = stash(fps.join(parts, "fp", "left").select("fp", "rows", F.coalesce("group", "fp").alias("group")))
    return join_counted(nodes.select("s", "fp"), named, ["fp"], "rows", HOT).select("s", "group")


def shingle_components(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, component): rows linked by texts whose word shingles have Jaccard similarity >= 0.8.

    Texts of equal shingle sets are one node.  Those that SimHash links, by multi-index
    hashing of fingerprints up to three bits apart, are one bucket; at similarity 0.8
    most pairs differ in more bits, so the bands of MinHash give further buckets.  The members of a bucket
    meet in one task, or if they are many as pairs of blocks; there the minima
    tell which pairs are worth a comparison of their whole sets, the likeliest
    are compared first, and pairs that are connected already are not.  Only a
    spanning forest leaves the task, so a large group of copies gives no more
    links than it has texts.  A pair is looked at in the group of SimHash
    and in the first band that it shares.  Texts without words are equal to each other.
    """
    bounded_batches(docs.sparkSession, 128)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            sets = [shingles(x or "") for x in t["body"]]
            yield t[keys].assign(s=[xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) for h in sets], n=[len(h) for h in sets], low=[minima(h) for h in sets], fp=np.array([majority(ones(h), len(h)) for h in sets], np.uint64).view(np.int64))
        give_back()

    each = stash(docs.select(*keys, F.col(text_col).alias("body")).mapInPandas(hashed, f"{schema}, s long, n long, low binary, fp long"))
    nodes = stash(each.groupBy("s").agg(F.count("*").alias("rows"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("fp").alias("fp"), F.min(F.struct(*keys)).alias("one")))
    filed = nodes.where("n > 0").select("s", "low", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("t"))
    bucket = F.xxhash64("t", F.substring("low", F.col("t") * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    filed = filed.select("s", bucket.bitwiseAND(F.lit(-TABLES)).bitwiseOR(F.col("t") + 1).alias("key"))
    filed = filed.unionByName(simhash_groups(nodes.where("n > 0")).select("s", F.xxhash64("group").bitwiseAND(F.lit(-TABLES)).alias("key")))
    dealt = stash(bucket_blocks(filed, "s", TABLES, BLOCK, HOT))
    shown = nodes.join(dealt.select("s").distinct(), "s").select("s", "n", "low", "one")
    match = [F.col(k).eqNullSafe(F.col("one").getField(k)) for k in keys]
    texts = docs.select(*keys, F.col(text_col).alias("body")).join(shown, match)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t[["s", "n", "low"]].assign(sh=[shingles(x or "").tobytes() for x in t["body"]])
        give_back()

    sets = stash(texts.dropDuplicates(["s"]).select("s", "n", "low", "body").mapInPandas(listed, "s long, n long, low binary, sh binary"))
    parts = connected_components(_links(dealt, sets), "a", "b")
    named = stash(nodes.select("s", "rows").join(parts.withColumnRenamed("node", "s"), "s", "left").select("s", "rows", F.coalesce("component", "s").alias("component")))
    return join_counted(each.select(*keys, "s"), named, ["s"], "rows", HOT).select(*keys, "component")
