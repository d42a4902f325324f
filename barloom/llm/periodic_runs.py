"""Periodic runs of words by Karp-Miller-Rosenberg naming."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back

#: Words of short documents that are named together; a longer document is named alone.
TOGETHER = 1 << 16
#: Pairs of grid places that are tested at a time; bounds memory for very long texts.
CHUNK = 1 << 20

RUN_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def name_levels(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[j][i] tells the 2 ** j words from place i apart from any other such stretch.

    A level's names come from sorting the pairs of names of the two halves.  A
    stretch that occurs once can match nothing, nor can a longer one over it, so
    only places whose halves both repeat are sorted and the others get a
    negative name of their own.  It ends where nothing repeats or a level is
    longer than ``longest``.
    """
    def repeated(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        names = -1 - np.arange(n, dtype=np.int64)
        if len(at):
            _, code, count = np.unique(keys, return_inverse=True, return_counts=True)
            many = count[code] > 1
            names[at[many]] = code[many]
        return names

    n = len(words)
    levels = [repeated(words, np.arange(n), n)]
    step = 1
    while 2 * step <= longest:
        now = levels[-1]
        left, right = now[:-step], now[step:]
        at = np.flatnonzero((left >= 0) & (right >= 0))
        if not len(at):
            break
        levels.append(repeated(left[at] * np.int64(n) + right[at], at, len(left)))
        step *= 2
    return levels


def common_after(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch that begins at x and at y > x, level by level from the longest."""
    total = np.zeros(len(x), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        names = levels[j]
        inside = np.flatnonzero(y + total < len(names))
        at = inside[names[x[inside] + total[inside]] == names[y[inside] + total[inside]]]
        total[at] += 1 << j
    return total


def common_before(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch that ends before x and before y > x."""
    total = np.zeros(len(x), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        names, step = levels[j], 1 << j
        inside = np.flatnonzero(x - total >= step)
        at = inside[names[x[inside] - total[inside] - step] == names[y[inside] - total[inside] - step]]
        total[at] += step
    return total


def _grid(levels: list[np.ndarray], n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the first multiple of the period in each stretch where the next ``period`` words repeat.

    A run of three periods or more holds a multiple of its period within its
    first one, and from there the words agree with those a period later for a
    period at least.  Of the multiples in one stretch all but the first are
    skipped: that the one before agrees over a period shows that it lies there.
    """
    for j, names in enumerate(levels):
        low, high = 1 << j, min((2 << j) - 1, most)
        at = low
        while at <= high:
            # As many periods as keep the grid under CHUNK places.
            upto = min(high, at + max(0, CHUNK // (n // at + 1)))
            periods = np.arange(at, upto + 1)
            counts = np.maximum(0, (n - 2 * periods) // periods + 1)
            period = np.repeat(periods, counts)
            place = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period
            same = names[place] == names[place + period]
            tail = period - low
            hit = np.flatnonzero(same)
            same[hit] = names[place[hit] + tail[hit]] == names[place[hit] + tail[hit] + period[hit]]
            first = same.copy()
            first[1:] &= ~(same[:-1] & (place[1:] > 0))
            yield place[first], period[first]
            at = upto + 1


def find_runs(words: np.ndarray, most: int, least_words: int = 24, least_periods: int = 3) -> np.ndarray:
    """(start, length, period) of every maximal run, by start and period.

    ``words`` are numbers; a run's smallest period is at most ``most``.  Every
    stretch found is extended to both sides by the name levels.  A run is found
    again with multiples of its period, always with the same ends, so of equal
    stretches the smallest period stays.
    """
    n = len(words)
    found = [np.zeros((0, 3), np.int64)]
    if most >= 1 and n:
        levels = name_levels(words, n)
        for place, period in _grid(levels, n, most):
            back = common_before(levels, place, place + period)
            length = back + common_after(levels, place, place + period) + period
            ok = (length >= least_words) & (length >= least_periods * period)
            found.append(np.stack([place[ok] - back[ok], length[ok], period[ok]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_many(texts: list[list[bytes]], least_words: int = 24, least_periods: int = 3) -> list[np.ndarray]:
    """``find_runs`` of each list of words; short lists are named together with a word of its own between two."""
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    order = sorted((k for k, ws in enumerate(texts) if len(ws) >= least_words), key=lambda k: len(texts[k]))
    at = 0
    while at < len(order):
        group, size = [order[at]], len(texts[order[at]])
        while at + len(group) < len(order) and size + len(texts[order[at + len(group)]]) <= TOGETHER:
            group.append(order[at + len(group)])
            size += len(texts[group[-1]])
        at += len(group)
        number: dict[bytes, int] = {}
        words = np.empty(size + len(group), np.int64)
        starts, place = [], 0
        for k in group:
            ws = texts[k]
            starts.append(place)
            words[place:place + len(ws)] = [number.setdefault(w, len(number)) for w in ws]
            place += len(ws) + 1
            words[place - 1] = -place
        runs = find_runs(words, len(texts[group[-1]]) // least_periods, least_words, least_periods)
        bounds = np.searchsorted(runs[:, 0], [*starts, len(words)])
        for k, s, lo, hi in zip(group, starts, bounds[:-1].tolist(), bounds[1:].tolist()):
            out[k] = runs[lo:hi] - np.array([s, 0, 0])
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: none does that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which each tenth, told by the CRC-32 of its id, ends in repetitions."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 24, least_periods: int = 3,
                  edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, texts: bool = False) -> DataFrame:
    """The runs of repeated words of each text, and the text with each run cut to its first period.

    A run is a stretch of words with smallest period q and at least
    ``least_words`` and ``least_periods`` * q words, none of whose neighbours
    extends it.  Words lie between the white space of ASCII.  Stretches of
    2 ** j words get names by sorting pairs of names; for every period q the
    multiples of q are compared with the word q later by two names, and what
    agrees is extended to both sides by descending levels: exact, without hashes
    of stretches, n log n places for n words.  Names are sorted only where both
    halves repeat.  Documents are independent, so nothing is shuffled.

    Returns (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256, n_words, n_dropped) and, with ``texts``, collapsed: start
    to exponent_milli tell the run of greatest length / period (ties: smallest
    start, then period), null where there is none; the digests are of each run's
    ``start,length,period`` and a line feed, by start and period, and of the kept
    words joined by a blank.  ``edit`` replaces a document's words before.  Null
    text counts as empty.  Rows are independent: a null or repeated id is kept
    as it is.  Very long texts are taken whole; they need about 8 bytes a word
    for each level that still repeats.  An empty table gives an empty result;
    other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    schema = RUN_SCHEMA + (", collapsed string" if texts else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [i if known else None for i, known in zip(batch["id"].tolist(), batch["known"].tolist())]
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch["body"]]
            if edit is not None:
                words = [edit(i, ws) for i, ws in zip(ids, words)]
            out = []
            for i, ws, runs in zip(ids, words, runs_of_many(words, least_words, least_periods)):
                rows = runs.tolist()
                best = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                keep = kept_words(len(ws), runs) if rows else None
                left = b" ".join(ws if keep is None else [w for w, k in zip(ws, keep.tolist()) if k])
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in rows)
                out.append((i, len(rows), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(),
                            hashlib.sha256(left).hexdigest(), len(ws), 0 if keep is None else int((~keep).sum()), *([left.decode("utf-8", "replace")] if texts else [])))
            names = [c.split()[0] for c in schema.split(", ")]
            nullable = ("doc_id", "start", "length", "period", "exponent_milli")
            columns = zip(*out) if out else [()] * len(names)
            yield pd.DataFrame({c: pd.array(x, "Int64") if c in nullable else x for c, x in zip(names, columns)})
        give_back()

    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNotNull().alias("known"), F.col(text_col).alias("body")).mapInPandas(run, schema)


def run_report(docs: DataFrame) -> DataFrame:
    """``periodic_runs`` of documents of which each tenth is made to end in repetitions."""
    return periodic_runs(docs, edit=repeated_tail)
