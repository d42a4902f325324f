"""Removal of repeated byte strings with suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_counted, key_runs, run_starts, shuffle_partitions, stash

#: Bytes of a k-gram whose hash picks the anchor of a window.
GRAM = 32
#: Bytes hashed together; positions fit the low bits of a hash.
PIECE = 1 << 19
_POS = np.uint64((1 << 20) - 1)
#: Bytes of one shard of segments.
SHARD = 1 << 20
#: Segments of one anchor in a shard; those of a more frequent anchor fill several shards.
SEGMENTS = 2048
#: Places of the anchor in a shared window that are told apart before segments are compared.
CASES = 4
#: Segments found in more than 1/HOT of all places are joined by broadcast: there are at most HOT.
HOT = 1000
_GAP = 0xFF  # no byte of UTF-8


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of ``length`` bytes, runs with one anchor: first window, number of
    windows, place of the anchor, its hash.

    The anchor of a window is the k-gram in it with the least hash, the last of
    equals, so equal windows have it at equal places.
    """
    n = len(data) - length + 1
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    step, factor = 1, 0xD6E8FEB86659FD93
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = (factor * factor + 2) % (1 << 64)
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    w = length - GRAM + 1
    v = (h & ~_POS) | (_POS - np.arange(len(h), dtype=np.uint64))
    padded = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    rows = padded.reshape(-1, w)
    down = np.minimum.accumulate(rows, axis=1).ravel()
    up = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(up[:n], down[w - 1: w - 1 + n])
    first = run_starts(least)
    place = (_POS - (least[first] & _POS)).astype(np.int64)
    return first, np.diff(np.append(first, n)), place, h[place]


def _pieces(data: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(data) - length + 1, PIECE):
        yield at, whole[at: at + PIECE + length - 1]


def segments(data: bytes, length: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """The distinct segments of a text, and the spans of those it holds twice.

    A segment is the bytes of a run of windows with one anchor: (anchor hash,
    two halves of the segment's fingerprint, start, windows, times, keys).  Two
    segments that share a window share the bytes around the anchor that lie in
    the window whichever way it lies: one of CASES stretches, whose hashes are
    the keys.
    """
    step = -(-(length - GRAM) // CASES)
    found: dict[bytes, list] = {}
    spans: list[tuple[int, int]] = []
    for at, piece in _pieces(data, length):
        for s, n, a, h in zip(*(x.tolist() for x in anchors(piece, length))):
            s += at
            a += at
            fp = xxhash.xxh3_128_digest(data[s: s + n + length - 1])
            if (seen := found.get(fp)) is None:
                found[fp] = [h, s, n, 1, a]
                continue
            if seen[3] == 1:
                spans.append((seen[1], seen[1] + n + length - 1))
            seen[3] += 1
            end = s + n + length - 1
            if spans[-1][0] <= s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((s, end))
    out = []
    for fp, (h, s, n, times, a) in found.items():
        f1, f2 = np.frombuffer(fp, np.int64).tolist()
        keys = []
        for j in range(CASES):
            lo = a - step * j
            hi = lo + length - step
            if lo >= s and hi <= s + n + length - 1:
                keys.append(int(np.uint64(xxhash.xxh3_64_intdigest(data[lo:hi], j)).view(np.int64)))
        out.append((int(np.uint64(h).view(np.int64)), f1, f2, s, n, times, keys))
    return out, spans


def suffix_array(text: np.ndarray, ends: np.ndarray | None = None, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and each one's place: the first place of its equals.

    Larsson-Sadakane refinement: suffixes start sorted by eight bytes; each round
    sorts the groups that are still undecided by the rank of what follows, which
    doubles the depth.  A decided suffix is not touched again.  With ``ends`` a
    suffix is sorted up to its end only (its first eight bytes always), with
    ``depth``, at least eight, up to so many bytes; without them no two are equal.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = padded[:n].copy()
    for i in range(1, 8):
        key = (key << np.uint64(8)) | padded[i: i + n]
    order = np.argsort(key)  # equals have one rank, so they may stand in any order
    sorted_key = key[order]
    del key, padded
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)  # a group's number is the place of its first
    h = 8
    open_ = np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(open_)
    while len(at) and (depth is None or h < depth):
        step = h if depth is None else min(h, depth - h)
        suffix = order[at]
        nxt = suffix + step
        goes_on = nxt < (n if ends is None else ends[suffix])
        follow = np.where(goes_on, rank[np.minimum(nxt, n - 1)] + 1, 0)
        both = (rank[suffix] << 32) | follow
        by = np.argsort(both)
        suffix, both, goes_on = suffix[by], both[by], goes_on[by]
        order[at] = suffix
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        rank[suffix] = np.repeat(at[heads], sizes)
        at = at[np.repeat(sizes > 1, sizes) & goes_on]
        h += step
    return order, rank


def repeated_windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all windows of the segments, in sorted order: segment, place in it, whether the
    window is found twice, whether it is the first of its equals."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.frombuffer(bytes([_GAP]).join(parts) + bytes([_GAP]), np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    order, place = suffix_array(text, np.repeat(starts + size, size + 1), length)
    seg = np.repeat(np.arange(len(parts)), size + 1)
    inside = np.arange(len(text)) - starts[seg]
    is_window = (inside < (size - length + 1)[seg])[order]
    sorted_at = order[is_window]
    places = place[sorted_at]
    same = np.zeros(len(places), bool)
    same[1:] = places[1:] == places[:-1]  # suffixes with the same first bytes have one place
    twice = same.copy()
    twice[:-1] |= same[1:]
    return seg[sorted_at], inside[sorted_at], twice, ~same


def _runs(seg: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of neighbouring windows: segment, first, one past the last."""
    by = np.lexsort((at, seg))
    seg, at = seg[by], at[by]
    new = np.ones(len(at), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    for f, e in zip(first.tolist(), np.append(first[1:], len(at)).tolist()):
        yield int(seg[f]), int(at[f]), int(at[e - 1]) + 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    return docs.select(key.alias("id"), F.xxhash64(text).alias("t"), text.alias("body"), F.struct("*").alias("row"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, t, s, e): byte spans that together cover what is to be removed; t is a hash of the text."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    bounded_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "t", "h", "f1", "f2", "s", "n", "times", "keys"]
        for batch in batches:
            out: list[tuple] = []
            for i, t, body in zip(batch["id"], batch["t"], batch["body"]):
                segs, spans = segments(body.encode("utf-8", "surrogatepass"), length)
                out += [(i, t, *x) for x in segs]
                out += [(i, t, 0, 0, 0, s, e - s - length + 1, 0, None) for s, e in spans]
            yield pd.DataFrame(out, columns=columns)

    cutted = stash(keyed.select("id", "t", "body").mapInPandas(cut, "id long, t long, h long, f1 long, f2 long, s long, n long, times long, keys array<long>"))
    held = cutted.where("times > 0")
    own = cutted.where("times = 0").select("id", "t", "s", (F.col("s") + F.col("n") + length - 1).alias("e"))
    # Equal segments become one with a count, wherever they lie: all their windows repeat.
    seg = ["h", "f1", "f2"]
    kinds = stash(held.groupBy(*seg).agg(F.sum("times").alias("m"), F.min(F.struct("id", "t", "s", "n", "keys")).alias("one")))
    multi = kinds.where("m > 1").select(*seg, "m")
    copies = join_counted(held.select(*seg, "id", "t", "s", "n"), multi, seg, "m", HOT)
    copied = copies.select("id", "t", "s", (F.col("s") + F.col("n") + length - 1).alias("e"))
    # Different segments of one anchor can share windows, if one of them is not covered yet
    # and they agree in one of the stretches around the anchor.
    found = "d > 1 AND least = 1"
    unsure = stash(kinds.groupBy("h").agg(F.count("*").alias("d"), F.min("m").alias("least")).where(found).select("h", "d"))
    near = stash(join_counted(kinds, unsure, ["h"], "d", HOT).select("h", "f1", "f2", "m", "one"))
    keyed_near = near.select("h", "f1", "f2", "m", F.explode("one.keys").alias("key"))
    shared = stash(keyed_near.groupBy("h", "key").agg(F.count("*").alias("d"), F.min("m").alias("least")).where(found).select("h", "key", "d"))
    close = stash(join_counted(keyed_near, shared, ["h", "key"], "d", HOT).select("h", "f1", "f2").distinct())
    sizes = stash(close.groupBy("h").agg(F.count("*").alias("d")))
    shards = (close.count() * (length + (length - GRAM) // 2)) // SHARD + 1
    subs = F.ceil(F.col("d") / SEGMENTS).cast("long")
    wanted = join_counted(near.join(close, seg, "left_semi"), sizes, ["h"], "d", HOT).select(
        "h", subs.alias("subs"), "one.id", "one.t", "one.s", "one.n", (F.col("m") > 1).alias("known"),
        F.when(subs > 1, F.xxhash64("h", F.pmod(F.xxhash64("f1", "f2"), subs))).otherwise(F.pmod("h", F.lit(shards))).alias("shard"))
    by_doc = wanted.groupBy("id", "t").agg(F.collect_list(F.struct("h", "subs", "s", "n", "known", "shard")).alias("wanted"))
    texts = keyed.select("id", "t", "body").join(by_doc.withColumnRenamed("id", "i2").withColumnRenamed("t", "t2"), F.expr("t = t2 AND id = i2"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t, body, ws in zip(batch["id"], batch["t"], batch["body"], batch["wanted"]):
                data = body.encode("utf-8", "surrogatepass")
                out += [(w["shard"], w["subs"] > 1, w["h"], w["subs"], i, t, w["s"], w["known"], data[w["s"]: w["s"] + w["n"] + length - 1]) for w in ws]
            yield pd.DataFrame(out, columns=["shard", "split", "h", "subs", "id", "t", "s", "known", "part"])

    parts = texts.select("id", "t", "body", "wanted").mapInPandas(fetch, "shard long, split boolean, h long, subs long, id long, t long, s long, known boolean, part binary")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "t", "s", "e", "h", "bucket", "key", "ids", "ts", "at"]
        for frame in key_runs(batches, ["split", "shard"]):
            first = run_starts(frame["split"].to_numpy(), frame["shard"].to_numpy())
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(frame)]):
                rows = frame.iloc[a:b]
                data = list(rows["part"])
                seg, at, twice, lead = repeated_windows(data, length)
                ids, ts, begin = rows["id"].tolist(), rows["t"].to_numpy(), rows["s"].to_numpy()
                known, split = rows["known"].to_numpy(), bool(rows["split"].iloc[0])
                new = twice & ~known[seg]
                out = [(ids[x], ts[x], begin[x] + s, begin[x] + e + length - 1, 0, 0, None, None, None, None) for x, s, e in _runs(seg[new], at[new])]
                if split:  # the shards of one anchor still have to be merged: one key for each different window
                    h, subs = rows["h"].to_numpy(), rows["subs"].to_numpy()
                    x, p = seg[lead], at[lead]
                    keys = np.array([xxhash.xxh3_128_digest(data[i][j: j + length]) for i, j in zip(x.tolist(), p.tolist())], "S16")
                    told = (twice | known[seg])[lead]
                    bucket = np.frombuffer(keys.tobytes(), "<u4")[::4] % subs[x].astype(np.uint32)
                    by = np.lexsort((keys, bucket, h[x]))
                    x, p, keys, told, bucket = x[by], p[by], keys[by], told[by], bucket[by]
                    cut_at = run_starts(h[x], bucket)
                    for c, d in zip(cut_at.tolist(), [*cut_at[1:].tolist(), len(x)]):
                        where = np.where(told[c:d], -1, begin[x[c:d]] + p[c:d])
                        out.append((0, 0, 0, 0, h[x[c]], int(bucket[c]), keys[c:d].tobytes(), [ids[i] for i in x[c:d]], ts[x[c:d]], where))
                yield pd.DataFrame(out, columns=columns)

    schema = "id long, t long, s long, e long, h long, bucket long, key binary, ids array<long>, ts array<long>, at array<long>"
    # About one shard a task: their number follows the text to compare, and each goes where its own number says.
    tasks = max(shuffle_partitions(docs.sparkSession), shards)
    dealt = parts.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
    compared = stash(dealt.sortWithinPartitions("split", "shard").mapInPandas(compare, schema))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in key_runs(batches, ["h", "bucket"]):
            first = run_starts(frame["h"].to_numpy(), frame["bucket"].to_numpy())
            out = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(frame)]):
                rows = frame.iloc[a:b]
                shards_ = [np.frombuffer(k, "S16") for k in rows["key"]]
                every = np.sort(np.concatenate(shards_), kind="stable")
                for keys, ids, ts, at in zip(shards_, rows["ids"], rows["ts"], rows["at"]):
                    n = np.searchsorted(every, keys, "right") - np.searchsorted(every, keys, "left")
                    for i in np.flatnonzero((n > 1) & (at >= 0)).tolist():
                        out.append((ids[i], ts[i], at[i], at[i] + length))
            yield pd.DataFrame(out, columns=["id", "t", "s", "e"])

    merged = compared.where("key IS NOT NULL").select("h", "bucket", "key", "ids", "ts", "at").repartition("h", "bucket").sortWithinPartitions(
        "h", "bucket").mapInPandas(merge, "id long, t long, s long, e long")
    found = compared.where("key IS NULL").select("id", "t", "s", "e")
    return own.unionByName(copied).unionByName(found).unionByName(merged)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts anywhere else.

    Every window of ``length`` bytes has an anchor, its k-gram of least hash, so
    equal windows lie in segments of one anchor.  Equal segments are added up
    before anything is compared: what whole segments tell is decided by counts
    of their 128-bit fingerprints, which is most of the removal.  Segments that
    differ but may share a window meet in a shard, whose suffix array
    (Larsson-Sadakane refinement) is ordered to ``length`` bytes, so that windows
    that repeat share a place.  The segments of a frequent anchor fill several shards; these
    are merged by binary search over 128-bit hashes of their windows, taken in
    the order of the suffix array and sorted by hash.  Matches never cross texts;
    the same text counts as anywhere else; strings are judged on the input.  Very
    long texts are cut in pieces.  Ids are integers.

    Returns the input's columns in a struct ``row``, with n_bytes, n_removed,
    spans (array of struct s, e: maximal removed runs in bytes of UTF-8) and kept
    (binary, the remaining bytes).  Null text counts as empty; equal rows, ids
    repeated or null, are texts of their own; an empty table gives an empty result.
    """
    spans = stash(repeated_spans(docs, id_col, text_col, length))
    per_doc = spans.groupBy("id", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans")).select(F.col("id").alias("i2"), F.col("t").alias("t2"), "spans")
    rows = _keyed(docs, id_col, text_col).join(per_doc, F.expr("t = t2 AND id = i2"), "left")

    @F.pandas_udf("n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary")
    def remove(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, ss in zip(texts, spans):
            data = text.encode("utf-8", "surrogatepass")
            runs = merge_spans([(x["s"], x["e"]) for x in ss]) if ss is not None else []
            ends = [0, *(x for r in runs for x in r), len(data)]
            kept = b"".join(data[s:e] for s, e in zip(ends[::2], ends[1::2])) if runs else data
            out.append((len(data), len(data) - len(kept), [{"s": s, "e": e} for s, e in runs], kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "spans", "kept"])

    return rows.select("row", remove("body", "spans").alias("x")).select("row", "x.*")


def suffix_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept_text) of documents.

    kept_text has the replacement sign where a cut left part of a character.
    n_kept counts its code points, so a text left alone keeps its n_chars; n_bytes
    and n_removed count bytes.
    """
    kept_text = F.make_valid_utf8(F.col("kept").cast("string"))
    return suffix_dedup(docs.select("doc_id", "text"), length=length).select(
        "row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.length(kept_text).cast("long").alias("n_kept"), kept_text.alias("kept_text"))
