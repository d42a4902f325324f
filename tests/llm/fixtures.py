"""Rows with every awkward case, and helpers to compare with plain Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key string, h long, body string"


def documents(spark: SparkSession, texts: Iterable[tuple], schema: str = SCHEMA) -> DataFrame:
    """(doc_id, text[, lang[, source]]) as documents with more columns, whose names the operators use inside."""
    rows = []
    for i, text, *rest in texts:
        lang, source = (*rest, None, None)[:2]
        rows.append((i, text, lang, source, None if text is None else len(text), 7, "r", "k", 3, "b"))
    return spark.createDataFrame(rows, schema)


LONG = "lorem ipsum dolor sit amet " * 4000
AWKWARD = [
    (None, None), (None, "no id"), (1, ""), (2, None), (3, "   \t\n"), (4, "One short line"), (5, "One short line"), (5, "One short line"), (6, "…§ ünïcödé 数字 \U0001f600"),
    (7, LONG), (8, LONG), (9, "a\n\nb\n"), (-3, "negative id"), (10, "1234 5678"),
]


def components(nodes: Iterable, links: Iterable[tuple]) -> dict:
    """The smallest node reachable from each."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in up}


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted(([tuple(r) for r in df.select(*columns).collect()]), key=repr)


def pairs(items: list) -> Iterator[tuple]:
    for i, a in enumerate(items):
        for b in items[i + 1:]:
            yield a, b
