"""Queries that choose genomes; a customer is a genome, its balance and nation are genes, its orders are its fitness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import selection as S
from ..sources.tables import table
from .base import query

#: A number in [0, 1) from the MD5 of a text, in SQL.
U = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
FITNESS = "p AS (SELECT c_custkey AS dna_id, (c_custkey * 7919) % 1000 / 1000.0::DOUBLE - 0.1::DOUBLE AS fitness FROM customer)"


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dna_id"), ((F.col("c_custkey") * 7919) % 1000 / 1000.0 - 0.1).alias("fitness"))


@query(f"""WITH {FITNESS}, w AS (SELECT dna_id, floor(greatest(0.001::DOUBLE, fitness) * 1000000)::BIGINT AS weight FROM p), c AS (SELECT *, sum(weight) OVER (ORDER BY dna_id) - weight AS before FROM w),
    d AS (SELECT o_orderkey AS draw, floor({U.format("'5:' || o_orderkey")} * (SELECT sum(weight) FROM w)::DOUBLE)::BIGINT AS place FROM orders)
    SELECT dna_id, count(*) AS n FROM d ASOF JOIN c ON d.place >= c.before GROUP BY 1""")
def roulette_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each genome is drawn, one draw for each order."""
    draws = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw"))
    return S.roulette(_population(spark, sf_dir), draws, 5).groupBy("dna_id").agg(F.count("*").alias("n"))


NAMES = {f"Brand#{m}{b}": f"Manufacturer#{m}" for m in range(1, 6) for b in range(1, 6)}
GENES = f"""r AS (SELECT s_suppkey AS dna_id, 'Brand#' || m || b AS name, 'Manufacturer#' || m AS category FROM supplier, range(1, 6) x(m), range(1, 6) y(b)),
    h AS (SELECT *, row_number() OVER (PARTITION BY dna_id, category ORDER BY {U.format("'3:' || dna_id || ':' || name")}, name) <= 2 AS active FROM r),
    g AS (SELECT dna_id, name, category, active, CASE WHEN active THEN round({U.format("'4:' || dna_id || ':' || name")} * 2 - 1, 6) ELSE 0 END AS weight FROM h)"""


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dna_id")), NAMES, 2, 3)


@query(f"WITH {GENES} SELECT * FROM g")
def stratified_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier as a genome two brands of every manufacturer, with random weights."""
    return _genes(spark, sf_dir)


@query(f"""WITH {GENES}, t AS (SELECT *, {U.format("'9:' || dna_id || ':' || name")} < 0.05::DOUBLE AS turn FROM g)
    SELECT dna_id, name, category, active <> turn AS active, CASE WHEN turn AND active THEN 0 WHEN turn THEN round({U.format("'10:' || dna_id || ':' || name")} * 2 - 1, 6) ELSE weight END AS weight FROM t""")
def swapped_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same genomes after some genes were switched on or off."""
    return S.swap(_genes(spark, sf_dir), 9)


SOME = "i AS (SELECT dna_id, name, category, active AND name NOT LIKE '%5' AS active, CASE WHEN name NOT LIKE '%5' THEN weight ELSE 0 END AS weight FROM g), f AS (SELECT s_suppkey AS dna_id, (s_suppkey * 37) % 11 / 11.0::DOUBLE AS fitness FROM supplier)"


@query(f"""WITH {GENES}, {SOME}, u AS (SELECT name FROM i GROUP BY 1 HAVING NOT bool_or(active) ORDER BY {U.format("'6:' || name")}, name LIMIT 3),
    l AS (SELECT dna_id FROM (SELECT dna_id, row_number() OVER (ORDER BY fitness, dna_id) AS rn FROM f) WHERE rn <= greatest(1, floor((SELECT count(*) FROM f) * 0.1)))
    SELECT dna_id, name, category, active OR (dna_id IN (FROM l) AND name IN (FROM u)) AS active,
           CASE WHEN dna_id IN (FROM l) AND name IN (FROM u) THEN round({U.format("'7:' || dna_id || ':' || name")} * 2 - 1, 6) ELSE weight END AS weight FROM i""")
def injected_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the brands that no genome uses come into the weakest tenth of all genomes."""
    genes = _genes(spark, sf_dir)
    usable = ~F.col("name").like("%5")
    some = genes.withColumn("weight", F.when(usable, F.col("weight")).otherwise(0.0)).withColumn("active", F.col("active") & usable)
    scores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dna_id"), ((F.col("s_suppkey") * 37) % 11 / 11.0).alias("fitness"))
    return S.inject_unused(some, scores, 3, 6).select("dna_id", "name", "category", "active", "weight")


@query(f"""WITH {FITNESS}, v AS (SELECT dna_id, fitness, c_acctbal / 10000 AS x, c_nationkey / 25.0::DOUBLE AS y FROM customer JOIN p ON c_custkey = dna_id),
    l AS (SELECT DISTINCT a.dna_id FROM v a JOIN v b ON a.dna_id <> b.dna_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 0.01::DOUBLE * 0.01::DOUBLE AND (b.fitness > a.fitness OR b.fitness = a.fitness AND b.dna_id < a.dna_id))
    SELECT dna_id, l.dna_id IS NOT NULL AS replaced, CASE WHEN l.dna_id IS NOT NULL THEN round({U.format("'8:' || dna_id || ':0'")} * 2 - 1, 6) ELSE x END AS first FROM v LEFT JOIN l USING (dna_id)""")
def genomes_kept_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes closer than 0.01 to a fitter one are replaced by random ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dna_id"), F.array(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25.0).alias("vector"))
    return S.keep_apart(c.join(_population(spark, sf_dir), "dna_id"), 0.01, 8).select("dna_id", "replaced", F.col("vector")[0].alias("first"))
