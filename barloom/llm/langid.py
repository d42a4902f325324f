"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import run_starts, stash

#: Hash buckets of the model.
BUCKETS = 1 << 15
#: Languages of one block of the model, which bounds what is broadcast and gathered at a time
#: (16 MB broadcast); further languages take further blocks.
LANGUAGES = 128
ORDERS = (2, 3)
SMOOTHING = 0.5
#: Numbers gathered, and n-grams sorted, at a time while scoring.
CHUNK = 1 << 21
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-case code points in which every stretch without letters is one blank; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return c[:0]
    c = np.where(letter, c, np.uint32(32))
    first = letter.copy()
    first[1:] |= letter[:-1]
    c = c[first]
    return np.concatenate([c[:0] if c[0] == 32 else np.array([32], np.uint32), c, c[:0] if c[-1] == 32 else np.array([32], np.uint32)])


def features(text: str) -> np.ndarray:
    """The bucket of every character n-gram of the whole text."""
    c = _codes(text)
    out = []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h ^= c[i: len(c) - n + 1 + i]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


Block = tuple[list[str], np.ndarray]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[Block]:
    """The model in blocks of languages, in name order: names and log-probabilities (BUCKETS x languages, float32).

    Counts n-grams over the whole text of every row with a language.  Each task
    adds up its own counts; at most BUCKETS numbers per language leave it.  Every
    language is learned; the driver holds one block's counts at a time.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))

        def out() -> Iterator[pd.DataFrame]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["body"]):
                held[lang] += np.bincount(features(text), minlength=BUCKETS)
                if len(held) > LANGUAGES:
                    yield from out()
        yield from out()

    counts = stash(known.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # A language whose texts have no letters is learned too: all its n-grams are equally likely.
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    blocks = []
    for i in range(0, len(names), LANGUAGES):
        part = names[i: i + LANGUAGES]
        of_block = counts.where((F.col("lang") >= part[0]) & (F.col("lang") <= part[-1])).toArrow().to_pandas()
        n = np.zeros((BUCKETS, len(part)))
        n[of_block["bucket"], of_block["lang"].map({x: j for j, x in enumerate(part)})] = of_block["n"]
        n += SMOOTHING
        blocks.append((part, np.log(n / n.sum(axis=0)).astype(np.float32)))
    return blocks


def _counted(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse matrix of n-gram counts of a batch, in pieces: text, bucket, count, ordered by text.

    A text with more than CHUNK n-grams comes in several pieces.
    """
    held, size = [], 0

    def piece() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        return cells // BUCKETS, cells % BUCKETS, n

    for i, text in enumerate(texts):
        f = features(text) if text else np.zeros(0, np.uint32)
        for j in range(0, len(f), CHUNK):
            held.append(f[j: j + CHUNK].astype(np.int64) + i * BUCKETS)
            size += len(held[-1])
            if size >= CHUNK:
                yield piece()
                held, size = [], 0
    if held:
        yield piece()


def totals(texts: list[str | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages): the log-likelihoods of a batch, its sparse counts times the model; and which texts have an n-gram."""
    out, known = np.zeros((len(texts), logp.shape[1])), np.zeros(len(texts), bool)
    step = max(1, CHUNK // max(1, logp.shape[1]))
    for row, bucket, n in _counted(texts):
        for i in range(0, len(row), step):
            r = row[i: i + step]
            first = run_starts(r)
            out[r[first]] += np.add.reduceat(logp[bucket[i: i + step]] * n[i: i + step, None].astype(np.float64), first, axis=0)
            known[r] = True
    return out, known


def _scorer(held: Broadcast) -> Callable[..., Column]:
    """Of the languages before and those of this block: the best, its log-likelihood, and all likelihoods as a multiple of it."""
    @F.pandas_udf("lang string, best double, total double")
    def scored(texts: pd.Series, lang: pd.Series, best: pd.Series, total: pd.Series) -> pd.DataFrame:
        names, logp = held.value
        ll, known = totals(list(texts), logp)
        top = ll.argmax(axis=1)
        here = ll[np.arange(len(ll)), top]
        before = best.to_numpy(np.float64, na_value=-np.inf)
        high = np.maximum(before, here)
        every = np.exp(ll - high[:, None]).sum(axis=1) + total.to_numpy(np.float64, na_value=0.0) * np.exp(before - high)
        name = np.where(here > before, np.array(names, object)[top], lang.to_numpy(object))
        return pd.DataFrame({"lang": np.where(known, name, None), "best": np.where(known, high, np.nan), "total": np.where(known, every, np.nan)})

    return scored


def identify(docs: DataFrame, model: list[Block], text_col: str = "text") -> DataFrame:
    """The input's columns in a struct ``row``, with lang_pred and score.

    lang_pred is the likeliest language (the first in name order of equals),
    score its posterior.  Each block of the model is broadcast: BUCKETS x
    LANGUAGES floats whatever the input; with several blocks the texts are read
    once for each, and the best and the sum of all are carried on.  Null text and
    text without letters are ``und`` with score 0, as is all text where nothing
    could be learned; repeated rows are rows of their own; very long texts are
    scored whole, in pieces.
    """
    out = docs.select(F.struct("*").alias("row"), F.lit(None).cast("struct<lang:string,best:double,total:double>").alias("p"))
    for i, block in enumerate(model):
        held = docs.sparkSession.sparkContext.broadcast(block)

        out = out.select("row", _scorer(held)(F.col("row").getField(text_col), "p.lang", "p.best", "p.total").alias("p"))
        if i < len(model) - 1:
            out = stash(out)
    return out.select("row", F.coalesce("p.lang", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("p.lang").isNotNull(), 1 / F.col("p.total")).otherwise(F.lit(0.0)).alias("score"))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is in neither part."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents; learns from those not held out."""
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    model = train(rows.where("not held_out"))
    return identify(rows.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out")), model).select(
        "row.doc_id", "row.held_out", "lang_pred", "score")
