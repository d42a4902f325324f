"""Quality classifier: interpolated modified Kneser-Ney perplexity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut_lineage, give_back, run_starts, stash

ORDER = 5
#: N-gram scores that are broadcast (12 bytes each); a larger model is joined by a shuffle.
MAX_BROADCAST = 4_000_000
#: Trusted ids that are broadcast; more of them are joined by a shuffle.
MAX_TRUSTED = 2_000_000
#: Languages whose thresholds are broadcast.
MAX_LANGUAGES = 20_000
#: Characters whose n-grams are counted or scored at a time.
CHUNK = 1 << 17
#: Distinct n-grams that a task holds before it hands its counts on.
HELD = 1 << 19
#: Rows that leave a task together.
ROWS = 1 << 16
#: Characters of text in one block where the model is joined by a shuffle.
BLOCK_CHARS = 1 << 24
_BOS, _EOS = 1, 2
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def _codes(text: str) -> np.ndarray:
    """Code points with runs of white space as one blank, digits as 0, between ORDER-1 starts and one end."""
    c = np.frombuffer(" ".join(text.split()).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), np.maximum(c, np.uint32(3)))
    return np.concatenate([np.full(ORDER - 1, _BOS, np.uint32), c, np.array([_EOS], np.uint32)])


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n-gram that ends at each place."""
    n = len(codes) - ORDER + 1
    h = np.zeros(n, np.uint64)
    for i in range(ORDER):
        h += codes[i: i + n].astype(np.uint64) * _WEIGHTS[i]
    return h ^ (h >> np.uint64(29))


def _pieces(texts: list[str]) -> Iterator[tuple[list[np.ndarray], list[int], list[int]]]:
    """Codes of the texts, about CHUNK characters together, with each one's place among the
    texts and number of n-grams.  A long text comes in several pieces."""
    held, at, sizes, n = [], [], [], 0
    for i, text in enumerate(texts):
        codes = _codes(text)
        for s in range(0, len(codes) - ORDER + 1, CHUNK):
            part = codes[s: s + CHUNK + ORDER - 1]
            held.append(part)
            at.append(i)
            sizes.append(len(part) - ORDER + 1)
            n += len(part)
            if n >= CHUNK:
                yield held, at, sizes
                held, at, sizes, n = [], [], [], 0
    if held:
        yield held, at, sizes


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct n-grams of chunks of the texts: hashes, counts, code points."""
    for held, _, _ in _pieces(texts):
        hashes = np.concatenate([_hashes(c) for c in held])
        codes = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, ORDER) for c in held])
        h, first, n = np.unique(hashes, return_index=True, return_counts=True)
        yield h, n, codes[first]


def _merge(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = run_starts(h)
    n = np.add.reduceat(np.concatenate([p[1] for p in parts])[order], first)
    return h[first], n, np.concatenate([p[2] for p in parts])[order[first]]


def ngram_counts(docs: DataFrame, text_col: str, trusted: Column) -> DataFrame:
    """(gram, h, n): every distinct n-gram of the corpus, with its count in trusted text.

    Each task adds up its own n-grams first, so what is shuffled grows with the
    distinct n-grams of a task and not with the text.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out(x: tuple) -> Iterator[pa.RecordBatch]:
            grams = np.ascontiguousarray(x[2]).view(f"<U{ORDER}").ravel()
            for i in range(0, len(grams), ROWS):
                part = slice(i, i + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(grams[part]), pa.array(x[0][part].view(np.int64)), pa.array(x[1][part])], ["gram", "h", "n"])

        for batch in batches:
            bodies, good = batch.column("body").to_pylist(), batch.column("trusted").to_pylist()
            for flag in (True, False):
                for h, n, codes in _grams([t or "" for t, g in zip(bodies, good) if bool(g) == flag]):
                    held.append((h, n * flag, codes))
                    size += len(h)
                    if size > 2 * HELD:
                        held = [_merge(held)]
                        size = len(held[0][0])
                        if size > HELD:
                            yield from out(held[0])
                            held, size = [], 0
        if held:
            yield from out(_merge(held))
        held.clear()
        give_back()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("body"), trusted.alias("trusted"))
    return rows.mapInArrow(count, "gram string, h long, n long").groupBy("gram").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts."""
    n = {int(r["c"]): r["m"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("m")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(found)]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(h, logp): the natural log-probability of every n-gram's last character after the others.

    ``counts`` as from ``ngram_counts``.  Orders are built from the lowest: the
    count tables of an order (n-grams; contexts with their discount mass) are
    joined to the n-grams that the order above asks for, all keyed by n-gram and
    so spread over all tasks.  Lower orders count distinct continuations.
    """
    asked = counts.select("gram")
    seen = counts.where("n > 0").select("gram", F.col("n").alias("c"))
    seen_by, asked_by = {ORDER: seen}, {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):
        tail = F.substring("gram", 2, k)
        seen_by[k] = seen_by[k + 1].groupBy(tail.alias("gram")).agg(F.count("*").alias("c"))
        asked_by[k] = asked_by[k + 1].select(tail.alias("gram")).distinct()
        if k < 3:  # few rows, used again and again
            seen_by[k], asked_by[k] = cut_lineage(seen_by[k]), cut_lineage(asked_by[k])
    lower: DataFrame | None = None
    vocabulary = seen_by[1].count() + 1
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(seen_by[k])
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.substring("gram", 1, k - 1)
        contexts = seen_by[k].groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(discount).alias("left"))
        rows = asked_by[k].join(seen_by[k].select("gram", (F.col("c") - discount).alias("kept")), "gram", "left")
        if k == 1:
            total = contexts.first()
            total, left = (total["total"], total["left"]) if total else (1, 1.0)
            lower = rows.select("gram", (F.coalesce("kept", F.lit(0.0)) / float(total) + float(left) / float(total) / float(vocabulary)).alias("p"))
            continue
        rows = rows.select("gram", "kept", context.alias("context"), F.substring("gram", 2, k - 1).alias("tail"))
        rows = rows.join(contexts, "context", "left").join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("q")), "tail")
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise((F.coalesce("kept", F.lit(0.0)) + F.col("left") * F.col("q")) / F.col("total"))
        lower = cut_lineage(rows.select("gram", p.alias("p")))
    return counts.select("gram", "h").join(lower, "gram").select("h", F.log("p").cast("float").alias("logp"))


class _Scores:
    """Log-probabilities found by hash: a slot table, and a sorted table for the few that share a slot."""

    def __init__(self, h: np.ndarray, logp: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.logp = h[order], logp[order]
        bits = max(8, int(np.ceil(np.log2(max(1, len(h))))) + 2)
        self.shift = np.uint64(64 - bits)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[self._at(self.h)] = np.arange(len(h), dtype=np.int32)

    def _at(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        i = self.slot[self._at(h)]
        miss = np.flatnonzero(self.h[i] != h)
        i[miss] = np.searchsorted(self.h, h[miss])
        return self.logp[i]


def _perplexities(texts: list[str], scores: _Scores) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for held, at, sizes in _pieces(texts):
        logp = scores.find(np.concatenate([_hashes(c) for c in held]))
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        np.add.at(total, at, np.add.reduceat(logp.astype(np.float64), begin))
        np.add.at(n, at, sizes)
    return np.exp(-total / n)


class LanguageModel:
    """A Kneser-Ney model in the shared folder, and how it reaches the texts.

    Up to ``max_broadcast`` n-grams the scores are broadcast; beyond, blocks of
    documents and the scores of the n-grams in each meet by a shuffle.
    """

    def __init__(self, docs: DataFrame, trusted: Column, text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> None:
        self.table = stash(kneser_ney(stash(ngram_counts(docs, text_col, trusted))))
        self.held = None
        if self.table.count() <= max_broadcast:
            known = self.table.toArrow()  # columns, without an object for each row
            self.held = docs.sparkSession.sparkContext.broadcast((known["h"].to_numpy().astype(np.int64).view(np.uint64), known["logp"].to_numpy().astype(np.float32)))

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The input's columns in a struct ``row``, with each text's perplexity per character.

        Knows the n-grams of the table it was built from.  Null text counts as empty:
        it consists of its end alone.
        """
        rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
        if self.held is None:
            return _score_by_block(rows, self.table)
        held = self.held

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scores = _Scores(*held.value)
            for texts in batches:
                yield pd.Series(_perplexities(list(texts), scores))
            del scores
            give_back()

        return rows.select("row", score("body").alias("perplexity"))


def _score_by_block(rows: DataFrame, model: DataFrame) -> DataFrame:
    chars = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(chars // BLOCK_CHARS + 1)))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, part in batch.groupby("block"):
                for h, _, _ in _grams(list(part["body"])):
                    yield pd.DataFrame({"block": block, "h": h.view(np.int64)})

    needed = rows.select("block", "body").mapInPandas(grams, "block long, h long").distinct().join(model, "h")
    schema = T.StructType([f for f in rows.schema if f.name == "row"] + [T.StructField("perplexity", T.DoubleType())])

    def score(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        scores = _Scores(known["h"].to_numpy(np.int64).view(np.uint64), known["logp"].to_numpy(np.float32))
        return pd.DataFrame({"row": texts["row"], "perplexity": _perplexities(list(texts["body"]), scores)})

    return rows.groupBy("block").cogroup(needed.groupBy("block")).applyInPandas(score, schema)


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def _allowance(length: Column, short: float) -> Column:
    """What the perplexity of a short text, the mean of few numbers, may exceed that of a long one by."""
    return 1 + short / F.sqrt(length.cast("double") + 1)


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", quantile: float = 0.99, slack: float = 1.3, short: float = 4.0, hold_out: int = 4,
             max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The input's columns in a struct ``row``, with trusted, perplexity, threshold and kept.

    ``trusted_ids`` has the ids (column ``id_col``) of trusted documents.  One in
    ``hold_out`` of them, by a hash of the id, is held out (0: none) and the model
    is trained on all text of the others.  A language's limit is ``slack`` times
    the ``quantile`` of the perplexities of its held-out documents (all of them,
    by a mergeable quantile summary), each over its allowance for short texts,
    1 + ``short`` / sqrt(characters + 1); a document's threshold is the limit
    times its own allowance, and texts above it are rejected.  A language, or
    null, without held-out documents takes the limit over all of them; where none
    are held out, all trusted documents set the limits; without any trusted
    document all rows are kept and have no threshold.  Null and empty texts
    consist of their end alone and are scored as such; repeated ids are rows of
    their own; an empty table gives an empty result.
    """
    ids = cut_lineage(trusted_ids.select(F.col(id_col).alias("trusted_id")).where("trusted_id IS NOT NULL").distinct())
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("body"),
                         F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("language"))
    held_out = F.pmod(F.xxhash64("id"), F.lit(hold_out)) == 0 if hold_out else F.lit(False)
    flagged = packed.join(F.broadcast(ids) if _few(ids, MAX_TRUSTED) else ids, F.col("id") == F.col("trusted_id"), "left").select(
        "row", "body", "language", F.col("trusted_id").isNotNull().alias("trusted"), held_out.alias("held_out"))
    model = LanguageModel(flagged, F.expr("trusted AND NOT held_out"), "body", max_broadcast)
    size = F.length(F.coalesce("row.body", F.lit("")))

    def limits_of(rows: Column) -> tuple[DataFrame, float | None]:
        good = model.score(flagged.where(rows).select("body", "language", F.col("row").getField(id_col).alias("id")), "body").select(
            "row.language", (F.col("perplexity") / _allowance(size, short)).alias("perplexity"))
        good = cut_lineage(good)
        limit = F.percentile_approx("perplexity", quantile, 10_000) * slack
        return cut_lineage(good.groupBy("language").agg(limit.alias("own"))), good.agg(limit).first()[0]

    limits, overall = limits_of(F.expr("trusted AND held_out"))
    if overall is None:
        limits, overall = limits_of(F.col("trusted"))
    scored = model.score(flagged, "body").select("row.*", "perplexity")
    joined = scored.join(F.broadcast(limits) if _few(limits, MAX_LANGUAGES) else limits, "language", "left")
    allowance = _allowance(F.length(F.coalesce("body", F.lit(""))), short)
    threshold = F.coalesce("own", F.lit(overall).cast("double")) * allowance
    return joined.select("row", "trusted", "perplexity", threshold.alias("threshold"),
                         F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids that the labels call good: quality 1, and not toxic where the labels say so."""
    good = labels.where("quality = 1")
    return (good.where("coalesce(toxic, 0) <> 1") if "toxic" in labels.columns else good).select("doc_id")


def quality_report(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """(doc_id, trusted, perplexity, threshold, kept) of documents."""
    return classify(docs.select("doc_id", "text", "lang"), trusted_labels(labels), **options).select(
        "row.doc_id", "trusted", "perplexity", "threshold", "kept")
