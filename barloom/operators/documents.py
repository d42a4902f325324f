"""Chunking, ingestion by content hash, retrieval and keyword scores over text tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors, and vectors that are searched, that meet in one task.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 1 << 16
#: Distances, and vectors of near pairs, that a task holds at a time.
CELLS, PIECE = 1 << 20, 1 << 15


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """About how many tokens a text has: 1.3 for each word."""
    return F.floor(F.size(words(text)) * 1.3).cast("int")


def word_windows(docs: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, total_chunks, text): windows of ``size`` words, each starting ``size - overlap`` after the last.

    As long as a start lies within the text it gives a window, so a short tail
    that the window before it holds in full still counts.
    """
    w = docs.select(id_col, words(F.coalesce(text_col, F.lit(""))).alias("w")).where(F.size("w") > 0)
    starts = w.withColumn("starts", F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap)))
    out = starts.select(id_col, "w", F.size("starts").alias("total_chunks"), F.posexplode("starts").alias("chunk_index", "s"))
    return out.select(id_col, "chunk_index", "total_chunks", F.array_join(F.slice("w", F.col("s") + 1, size), " ").alias("text"))


def _units(text: Column, limit: int) -> Column:
    """Paragraphs, or the sentences of those that are too long."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")  # F.trim itself would get the index as what to trim
    return F.flatten(F.transform(paragraphs, lambda p: F.when(tokens(p) > limit, F.filter(F.split(p, r"(?<=[.!?])\s+"), lambda s: s != "")).otherwise(F.array(p))))


def paragraph_chunks(docs: DataFrame, id_col: str, text_col: str, limit: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, total_chunks, text): paragraphs packed greedily up to ``limit`` tokens.

    A new chunk starts with the last ``overlap`` words of the one before.  The
    fold over a document's paragraphs carries numbers only: where each chunk
    starts, and how many words the growing one has; texts are put together once,
    when the chunks are known.
    """
    units = docs.select(id_col, _units(F.coalesce(text_col, F.lit("")), limit).alias("units")).where(F.size("units") > 0)
    units = units.withColumn("words", F.transform("units", words)).withColumn("n", F.transform("words", F.size))
    of = lambda n: F.floor(n * 1.3).cast("int")
    start = F.struct(F.array().cast("array<struct<unit:int,word:int>>").alias("starts"), F.lit(0).alias("now"), F.lit(0).alias("unit"), F.lit(0).alias("word"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["unit"] == 0) | (of(acc["now"]) + of(n) > limit)
        carried = F.when(full, F.least(acc["now"], F.lit(overlap))).otherwise(acc["now"])
        here = F.struct(acc["unit"].alias("unit"), acc["word"].alias("word"))
        return F.struct(F.when(full, F.array_append(acc["starts"], here)).otherwise(acc["starts"]).alias("starts"), (carried + n).alias("now"), (acc["unit"] + 1).alias("unit"), (acc["word"] + n).alias("word"))

    rows = units.withColumn("starts", F.aggregate("n", start, step, lambda acc: acc["starts"])).withColumn("all", F.flatten("words"))
    rows = rows.select(id_col, "units", "all", "starts", F.size("starts").alias("total_chunks"), F.posexplode("starts").alias("chunk_index", "at"))
    end = F.coalesce(F.try_element_at("starts", F.col("chunk_index") + 2).getField("unit"), F.size("units"))
    own = F.array_join(F.slice("units", F.col("at.unit") + 1, end - F.col("at.unit")), "\n\n")
    carried = F.least(F.col("at.word"), F.lit(overlap))
    tail = F.array_join(F.slice("all", F.col("at.word") - carried + 1, carried), " ")
    text = F.when(F.col("chunk_index") == 0, own).otherwise(F.concat(tail, F.lit("\n\n"), own))
    return rows.select(id_col, "chunk_index", "total_chunks", text.alias("text"))


def section_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 500) -> DataFrame:
    """(id, chunk_index, title, text): sections under headings of up to three signs, long ones cut into numbered parts."""
    sections = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(text_col, F.lit(""))), r"\n#{1,3}[ \t]+"), lambda s: F.trim(s) != "")
    rows = docs.select(id_col, F.posexplode(sections).alias("section", "s"))
    head = F.trim(F.substring_index("s", "\n", 1))
    w = words(F.substring(F.col("s"), F.length(F.substring_index("s", "\n", 1)) + 1, F.length("s")))
    rows = rows.select(id_col, "section", head.alias("title"), w.alias("w")).where(F.size("w") > 0)
    rows = rows.select(id_col, "section", "title", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size))).alias("part", "at"))
    title = F.when(F.size("w") > size, F.concat("title", F.lit(" (part "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return rows.select(id_col, F.col("section").alias("chunk_index"), F.col("part"), title.alias("title"), F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("text"))


def content_changes(log: DataFrame, now: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, status, hash): what is new, modified, deleted or unchanged against a log of (key, hash)."""
    fresh = now.select(key, F.md5(F.coalesce(text_col, F.lit(""))).alias("new_hash"))
    both = log.select(key, F.col("hash").alias("old_hash")).join(fresh, key, "full")
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return both.select(key, status.alias("status"), F.coalesce("new_hash", "old_hash").alias("hash"))


def apply_changes(chunks: DataFrame, changes: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The chunk table after a change scan: chunks of deleted and modified documents go, those of new and modified ones come."""
    gone = changes.where("status IN ('deleted', 'modified')").select(key)
    come = changes.where("status IN ('new', 'modified')").select(key)
    return chunks.join(gone, key, "left_anti").unionByName(fresh.join(come, key, "left_semi"))


def k_nearest(a: np.ndarray, b: np.ndarray, ids: pd.Series, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance): the k rows of ``b`` closest to each row of ``a``, of equals the smaller of ``ids``.

    A few rows of ``a`` meet ``b`` at a time, so the matrix of distances is never held whole.
    """
    b, n, out = b.astype(np.float64), min(k, len(b)), []
    place = pd.factorize(ids, sort=True)[0]
    place[place < 0] = len(b)
    size, step = (b * b).sum(axis=1), max(1, CELLS // len(b))
    for c in range(0, len(a), step):
        x = a[c:c + step].astype(np.float64)
        near = x @ b.T
        near *= -2
        near += size
        near += (x * x).sum(axis=1)[:, None]
        edge = np.partition(near, n - 1, axis=1)[:, n - 1]
        i, j = np.nonzero(near <= (edge + 1e-6 * (1 + np.abs(edge)))[:, None])
        distance = np.concatenate([((x[i[s:s + PIECE]] - b[j[s:s + PIECE]]) ** 2).sum(axis=1).round(9) for s in range(0, len(i), PIECE)])
        order = np.lexsort((place[j], distance, i))
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[first] + c, j[order][first], distance[order][first]))
    return tuple(np.concatenate(o) for o in zip(*out))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_col: str = "query", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, id, distance, score, rank): the k closest vectors of each query by squared distance, of equals the smaller id.

    Queries and vectors are dealt into blocks by a hash, and every block of one
    meets every block of the other in a group of its own; each group keeps k rows
    a query.  Nothing passes the driver, and a task's size does not follow the
    input.  Distances come from one matrix product; those near the edge are
    computed again without it.  Filter the vectors before (pre-filter) or the
    result after (post-filter): these differ.
    """
    blocks = F.lit(queries.count() // QUERY_BLOCK + 1)
    parts = F.lit(vectors.count() // VECTOR_BLOCK + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    schema = T.StructType([queries.schema[query_col], vectors.schema[id_col], T.StructField("distance", T.DoubleType())])
    q = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_col).alias("q"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(query_col), blocks).alias("block"), every(parts).alias("part"))
    x = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("x"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), parts).alias("part"), every(blocks).alias("block"))

    def search(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame(columns=schema.names)
        i, j, distance = k_nearest(*(np.stack(d["v"].to_numpy()) for d in (qs, xs)), xs["x"], k)
        return pd.DataFrame({query_col: qs["q"].to_numpy()[i], id_col: xs["x"].to_numpy()[j], "distance": distance})

    keys = ["block", "part"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy("distance", id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.round(1 / (1 + F.col("distance")), 4))


def mmr(found: DataFrame, k: int, query_col: str = "query", text_col: str = "text", balance: float = 0.3) -> DataFrame:
    """Re-rank each query's few results by relevance less the overlap of words with what is already chosen."""
    schema = T.StructType([*found.schema.fields, T.StructField("mmr_rank", T.IntegerType())])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["score", "rank"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bags = [set(t.lower().split()) if t else set() for t in b[text_col]]
        chosen: list[int] = []
        overlap = np.zeros(len(b))
        while len(chosen) < min(k, len(b)):
            value = (1 - balance) * b["score"].to_numpy() - balance * overlap
            value[chosen] = -np.inf
            at = int(np.argmax(value))
            chosen.append(at)
            for i, bag in enumerate(bags):
                most = max(len(bag), len(bags[at]))
                overlap[i] = max(overlap[i], len(bag & bags[at]) / most if most else 0.0)
        return b.iloc[chosen].assign(mmr_rank=range(1, len(chosen) + 1))

    return found.groupBy(query_col).applyInPandas(run, schema)


def within_budget(rows: DataFrame, budget: int, text_col: str, order: str, *keys: str) -> DataFrame:
    """The longest prefix by ``order`` whose texts have at most so many tokens, a quarter for each character."""
    cost = F.floor(F.length(text_col) * 0.25)
    return rows.withColumn("used", F.sum(cost).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def keyword_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(hits for - hits against) / all hits in [-1, 1]; a keyword counts once wherever it stands, also inside a word."""
    low = F.lower(text)
    hits = lambda ks: sum((F.when(low.contains(k), 1).otherwise(0) for k in ks), F.lit(0))
    p, n = hits(positive), hits(negative)
    return F.coalesce(F.try_divide((p - n).cast("double"), (p + n).cast("double")), F.lit(0.0))


def category(text: Column, rules: dict[str, list[str]], otherwise: str = "general") -> Column:
    """The first category with a keyword in the text."""
    out = F.lit(otherwise)
    for name, ks in reversed(rules.items()):
        rule = F.lit(False)
        for k in ks:
            rule = rule | F.lower(text).contains(k)
        out = F.when(rule, name).otherwise(out)
    return out


def news(docs: DataFrame, text_col: str, names: dict[str, str], rules: dict[str, list[str]]) -> DataFrame:
    """(id, headline, symbols, category, ...): id from the text, one row for each id, symbols whose names it holds."""
    headline = F.substring_index(F.col(text_col), "\n", 1)
    symbols = F.array_compact(F.array(*(F.when(F.lower(text_col).contains(n.lower()), F.lit(s)) for s, n in names.items())))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.substring(F.md5(text_col), 1, 12).alias("id"), headline.alias("headline"), symbols.alias("symbols"), category(F.col(text_col), rules).alias("category"))
    return rows.groupBy("id").agg(F.min("headline").alias("headline"), F.min("symbols").alias("symbols"), F.min("category").alias("category"))


def weighted_sentiment(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean score weighted by confidence, and the most frequent impact; of equals the more severe."""
    severity = ["critical", "high", "medium", "low"]
    counts = F.struct(*(F.count_if(F.col("impact") == s).alias(s) for s in severity))
    out = rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col("score") * F.col("confidence")), F.sum("confidence")).alias("score"), counts.alias("c"), F.count("*").alias("n"))
    most = F.greatest(*(F.col(f"c.{s}") for s in severity))
    label = F.lit(None)
    for s in reversed(severity):
        label = F.when(F.col(f"c.{s}") == most, s).otherwise(label)
    return out.select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"), label.alias("impact"), "n")


def enhanced(query: Column, volatility: Column, trend: Column, regime: Column) -> Column:
    """A query with what is known of the market after it."""
    words_ = [F.when(x != "", F.concat(x, F.lit(f" {name}"))) for x, name in ((volatility, "volatility"), (trend, "trend"), (regime, "market"))]
    return F.concat_ws(" ", query, *words_)


def routed(queries: DataFrame, role: str, categories: dict[str, list[str]]) -> DataFrame:
    """Adds the categories that a role reads; an unknown role reads all, which null says."""
    out = F.lit(None).cast("array<string>")
    for name, known in categories.items():
        out = F.when(F.lower(role) == name, F.array(*map(F.lit, known))).otherwise(out)
    return queries.withColumn("categories", out)
