"""Joins on time and position: as-of, interval, range conditions, tops and their rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans and points in one row of an interval join, and copies of the spans where few buckets hold them all.
PACK, POINTS, COPIES = 256, 32, 4


def asof_join(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str, forward: bool = False, strict: bool = False) -> DataFrame:
    """Adds to each left row the ``value`` of the closest right row at or before it (at or after with ``forward``).

    Both sides go through one shuffle on ``on`` as one sorted stream in which the
    last known right value is carried to the left rows: no range join, and a
    right side with few keys is not copied anywhere.  Several right rows of one
    time: the largest value counts.  ``strict`` leaves out equal times.
    """
    side = 0 if strict == forward else 1
    lhs = left.select(F.struct("*").alias("_row"), *on, F.col(at).alias("_at"), F.lit(1 - side).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    rhs = right.groupBy(*on, F.col(at).alias("_at")).agg(F.max(value).alias("_value")).select(
        F.lit(None).cast(lhs.schema["_row"].dataType).alias("_row"), *on, "_at", F.lit(side).alias("_side"), "_value")
    w = Window.partitionBy(*on).orderBy("_at", "_side")
    if forward:
        found = F.first("_value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = lhs.unionByName(rhs).withColumn("_found", found).where("_row IS NOT NULL")
    return both.select("_row.*", F.col("_found").alias(value))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, hours: int = 24) -> DataFrame:
    """Pairs of a point and each span with start <= at <= end.

    Spans are packed first: neighbours by start, at most ``PACK`` of them, become
    one row.  Packs are filed under every bucket that they touch, so this is an
    equi-join on buckets whose size follows the data and not the square of it.
    Buckets come in sizes of ``hours`` times powers of eight, and a span takes the
    smallest size of which it, and so its pack, touches at most nine: a long span
    is not copied into thousands.  Points are packed too, at most ``POINTS``
    neighbours, and a pack is looked up once in each size that spans have.

    The pairs are as many as they are; each is made when it leaves, so rows that
    meet are packs and a pair costs no lookup.  Most of a file is one list of
    spans again and again, which its encoding holds in little space.  Where all
    spans start in few buckets, the packs of points of a bucket are dealt to
    ``COPIES`` copies of its spans, so that a bucket is not one task.
    """
    unit, base = hours * 3_600_000_000, 8
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    levels = 12  # eight to the twelfth hours exceed the range of timestamps
    width = lambda level: F.lit(unit) * F.pow(F.lit(base), level).cast("long")
    bucket = lambda c: F.floor(micros(c) / width(F.col("_l"))).cast("long")
    length = (micros(end) - micros(start)) / unit
    level = F.greatest(F.lit(0), F.ceil(F.log(float(base), F.greatest(length / base, F.lit(1.0)))).cast("int"))
    sized = spans.where(F.col(start) <= F.col(end)).withColumn("_l", F.least(level, F.lit(levels))).withColumn("_b", bucket(start))
    used = {r["_l"]: r["n"] for r in sized.groupBy("_l").agg(F.approx_count_distinct("_b").alias("n")).collect()}  # at most levels + 1 rows
    # A fixed number of partitions: joined by the size of what is shuffled, all pairs would leave from one or two tasks.
    session = points.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    copies = COPIES if sum(used.values()) < COPIES * parts else 1

    def packs(rows: DataFrame, at: str, to: str, size: int, name: str) -> DataFrame:
        """(_l, _b, name, name_from, name_to): at most ``size`` neighbours by ``at`` in a row."""
        place = F.row_number().over(Window.partitionBy("_l", "_b").orderBy(at)) - 1
        columns = [c for c in rows.columns if c not in ("_l", "_b")]
        return rows.withColumn("_n", F.floor(place / size)).groupBy("_l", "_b", "_n").agg(
            F.collect_list(F.struct(*columns)).alias(name), F.min(at).alias(f"{name}_from"), F.max(to).alias(f"{name}_to"))

    filed = packs(sized, start, end, PACK, "_spans").withColumn("_b", F.explode(F.sequence(bucket("_spans_from"), bucket("_spans_to"))))
    filed = filed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    # The smallest buckets lie within larger ones, so a pack has one bucket of each size.
    near = packs(points.where(F.col(at).isNotNull()).withColumn("_l", F.lit(0)).withColumn("_b", bucket(at)), at, at, POINTS, "_points")
    looked = near.withColumn("_l", F.explode(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>"))).withColumn("_b", bucket("_points_from"))
    looked = looked.withColumn("_copy", F.pmod("_n", F.lit(copies)).cast("int"))
    met, keys = F.col("_spans_from") <= F.col("_points_to"), ["_l", "_b", "_copy"]
    found = filed.drop("_n").repartition(parts, *keys).join(looked.drop("_n").repartition(parts, *keys), keys).where(met & (F.col("_points_from") <= F.col("_spans_to")))
    pairs = found.select(F.explode("_points").alias("_point"), "_spans").select("_point.*", F.inline("_spans"))
    return pairs.where(F.col(at).between(F.col(start), F.col(end)))


def merged_spans(spans: DataFrame, start: str, end: str, *keys: str, hours: int = 1) -> DataFrame:
    """(keys, start, end): the times that at least one span of a key covers, ends included, as spans that do not meet.

    Spans merge within buckets of their start first, and what is left of all
    buckets afterwards: where spans are about as long as a bucket there is one for
    each bucket, so the second pass follows the time covered and not the number of spans.
    """
    def merge(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(start)
        reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = rows.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
        return new.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_n").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_n")

    once = spans.where(F.col(start) <= F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    filed = once.withColumn("_b", F.floor(F.unix_micros(F.col(start).cast("timestamp")) / (hours * 3_600_000_000)))
    return merge(merge(filed, *keys, "_b").drop("_b"), *keys)


def before_after(marks: DataFrame, rows: DataFrame, on: list[str], mark: str, at: str, value: str) -> DataFrame:
    """For each mark, the sums of ``value`` before it and from it on, and whether it helped.

    Running sums over the union of marks and daily totals take the place of a
    join on a range: one shuffle on ``on``.
    """
    daily = rows.groupBy(*on, F.col(at).alias("_at")).agg(F.sum(value).alias("_v"))
    lhs = marks.select(*on, F.col(mark).alias("_at"), F.lit(0).alias("_side"), F.lit(0.0).alias("_v")).distinct()
    w = Window.partitionBy(*on).orderBy("_at", "_side")
    both = lhs.unionByName(daily.select(*on, "_at", F.lit(1).alias("_side"), "_v"))
    # At one time the mark stands before the rows, so its running sum holds earlier times only.
    out = both.withColumns({"before": F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_v").over(Window.partitionBy(*on))}).where("_side = 0")
    return out.select(*on, F.col("_at").alias(mark), "before", (F.col("_all") - F.col("before")).alias("after")).withColumn("helped", F.col("after") > F.col("before"))


def top_per_group(rows: DataFrame, n: int, order: list[Column], *keys: str) -> DataFrame:
    """The first n rows of each group; the order must be total."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def all_but_top(rows: DataFrame, n: int, order: list[Column], *keys: str) -> DataFrame:
    """What a table that keeps the first n of each group would delete; the order must be total.

    A group is ranked in parts, dealt out by a hash, and then the first n of all
    its parts together: what is not among the first n of its part is deleted anyway.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = lambda by: F.row_number().over(Window.partitionBy(*keys, by).orderBy(*order))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*(c for c, t in rows.dtypes if "map<" not in t)), F.lit(parts)))
    dealt = dealt.withColumn("_part", F.when(place("_part") > n, F.col("_part")))
    return dealt.withColumn("_place", place("_part")).where(F.col("_part").isNotNull() | (F.col("_place") > n)).select(*rows.columns)


def latest(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key of an append-only table; ties by the largest row."""
    rest = [c for c in log.columns if c not in (*keys, version)]
    return log.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("r")).select(*keys, "r.*")


def every_nth(rows: DataFrame, points: int, order: list[str], *keys: str) -> DataFrame:
    """About ``points`` rows of each group at even steps of its order, the first included."""
    w = Window.partitionBy(*keys)
    at = F.row_number().over(w.orderBy(*order)) - 1
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / points))
    return rows.withColumn("_k", at % step).where("_k = 0").drop("_k")
