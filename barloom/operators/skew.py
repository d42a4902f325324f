"""Joins that keep the rows of a frequent key where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of more than 1/HOT of all rows are joined by broadcast: there are at most HOT.
HOT = 1000


def join_by_size(rows: DataFrame, table: DataFrame, keys: list[str], n: str, hot: int = HOT) -> DataFrame:
    """``rows`` with the columns of ``table``, one row a key, whose ``n`` is the number of rows that the key has.

    Keys of over 1/``hot`` of the counted rows are broadcast, the others meet by a shuffle.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    many, rest = table.where(F.col(n) * hot > total), table.where(F.col(n) * hot <= total)
    return rows.join(F.broadcast(many), keys).unionByName(rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(rest, keys))
