"""Evolution of indicator weights: genomes are rows of genes, evaluation is one pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .selection import running_total


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the hash of a seed and columns: the same wherever it is computed."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / float(1 << 40)


def gaussian(seed: int, *parts: Column | str) -> Column:
    """Standard normal from two hashed uniforms."""
    u = F.greatest(uniform(seed, *parts), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(uniform(seed + 1, *parts) * 6.283185307179586)


def random_population(spark: SparkSession, names: list[str], n: int, seed: int) -> DataFrame:
    """(dna_id, name, weight): n genomes with weights in [-1, 1]."""
    genes = spark.createDataFrame([(x,) for x in names], "name string")
    ids = spark.range(n).select(F.format_string("g0-%05d", "id").alias("dna_id"))
    return ids.crossJoin(F.broadcast(genes)).withColumn("weight", F.round(uniform(seed, "dna_id", "name") * 2 - 1, 6))


def clip(w: Column) -> Column:
    return F.least(F.greatest(w, F.lit(-1.0)), F.lit(1.0))


def mutate(genes: DataFrame, seed: int, rate: float = 0.1, step: float = 0.2, reset: float = 0.02) -> DataFrame:
    """Shifts some weights, and draws a few anew."""
    r = uniform(seed, "dna_id", "name")
    new = F.when(r < reset, uniform(seed + 3, "dna_id", "name") * 2 - 1).when(r < rate, clip(F.col("weight") + gaussian(seed + 5, "dna_id", "name") * step)).otherwise(F.col("weight"))
    return genes.withColumn("weight", F.round(new, 6))


def crossover(genes: DataFrame, couples: DataFrame, seed: int, kind: str = "uniform") -> DataFrame:
    """(dna_id, name, weight) of one child for each row (child, mother, father) of ``couples``.

    ``uniform`` takes each gene from either parent, ``blend`` a random mean of
    both, ``category`` whole groups of genes (the name up to its first _) from
    one.  A gene that only one parent has counts as 0 in the other.
    """
    side = lambda who: couples.join(genes, F.col(who) == F.col("dna_id")).select("child", "name", F.col("weight").alias(who + "_w"))
    both = side("mother").join(side("father"), ["child", "name"], "full")
    m, f = F.coalesce("mother_w", F.lit(0.0)), F.coalesce("father_w", F.lit(0.0))
    u = uniform(seed, "child", F.substring_index("name", "_", 1) if kind == "category" else F.col("name"))
    weight = m * u + f * (1 - u) if kind == "blend" else F.when(u < 0.5, m).otherwise(f)
    return both.select(F.col("child").alias("dna_id"), "name", F.round(clip(weight), 6).alias("weight"))


def tournaments(scores: DataFrame, children: DataFrame, seed: int, size: int = 3) -> DataFrame:
    """(child, mother, father): each parent is the best of ``size`` drawn genomes.

    Genomes are numbered by id, in ranges; draws are hashed numbers, joined back.
    """
    numbered = running_total(scores.select("dna_id", "fitness", F.lit(1).alias("one")), "one", "dna_id").select("dna_id", "fitness", F.col("at").alias("i"))
    n = scores.count()
    draws = children.select("child", F.explode(F.sequence(F.lit(0), F.lit(2 * size - 1))).alias("d")).withColumn("i", F.floor(uniform(seed, "child", "d") * n).cast("int"))
    best = draws.join(numbered, "i").groupBy("child", (F.col("d") < size).alias("mother")).agg(F.max_by("dna_id", F.struct("fitness", "dna_id")).alias("dna_id"))
    return best.groupBy("child").agg(F.max(F.when(F.col("mother"), F.col("dna_id"))).alias("mother"), F.max(F.when(~F.col("mother"), F.col("dna_id"))).alias("father"))


def moments(rows: DataFrame, names: list[str], result: str) -> DataFrame:
    """(a, b, s): sums of products of indicators and the result over complete rows; '' is the constant, '=' the result.

    One aggregation over the data, whatever the number of genomes: the
    correlation of any weighted sum with the result follows from these sums.
    """
    cols = {"": F.lit(1.0), "=": F.col(result), **{n: F.col(f"`{n}`") for n in names}}
    keys = list(cols)
    whole = rows.na.drop(subset=[result, *names])
    sums = whole.agg(*(F.sum(cols[a] * cols[b]).alias(f"s{i}_{j}") for i, a in enumerate(keys) for j, b in enumerate(keys) if i <= j))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{min(i, j)}_{max(i, j)}").alias("s")) for i, a in enumerate(keys) for j, b in enumerate(keys)]
    return sums.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def evaluate(genes: DataFrame, m: DataFrame) -> DataFrame:
    """(dna_id, fitness): correlation of each genome's weighted sum of indicators with the result; 0 where it is undefined.

    ``m`` is the small table of ``moments``: its size is the square of the number
    of indicators.
    """
    g = genes.select("dna_id", F.col("name").alias("a"), F.col("weight").alias("wa"))
    h = genes.select("dna_id", F.col("name").alias("b"), F.col("weight").alias("wb"))
    quad = g.join(F.broadcast(m.where("a NOT IN ('', '=') AND b NOT IN ('', '=')")), "a").join(h, ["dna_id", "b"]).groupBy("dna_id").agg(F.sum(F.col("wa") * F.col("wb") * F.col("s")).alias("xx"))
    side = lambda b, name: g.join(F.broadcast(m.where(F.col("b") == b)), "a").groupBy("dna_id").agg(F.sum(F.col("wa") * F.col("s")).alias(name))
    cell = lambda a, b, name: m.where((F.col("a") == a) & (F.col("b") == b)).select(F.col("s").alias(name))
    one = cell("", "", "n").join(cell("", "=", "y")).join(cell("=", "=", "yy"))
    rows = quad.join(side("", "x"), "dna_id").join(side("=", "xy"), "dna_id").join(F.broadcast(one))
    vx, vy = F.col("n") * F.col("xx") - F.col("x") * F.col("x"), F.col("n") * F.col("yy") - F.col("y") * F.col("y")
    corr = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(vx * vy)
    return rows.select("dna_id", F.when((vx > 0) & (vy > 0), F.round(corr, 6)).otherwise(0.0).alias("fitness"))


def population_stats(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("fitness").alias("mean"), F.stddev_pop("fitness").alias("std"), F.min("fitness").alias("least"), F.max("fitness").alias("best"),
                                     F.max_by("dna_id", F.struct("fitness", "dna_id")).alias("best_id"))


def diversity(genes: DataFrame) -> DataFrame:
    """(diversity): the mean squared distance of two genomes, from sums by gene: no pairs are formed."""
    n = F.countDistinct("dna_id")
    count = genes.agg(n.alias("n"))
    by_gene = genes.groupBy("name").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    return by_gene.join(F.broadcast(count)).groupBy("n").agg(F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("d")).select(
        F.coalesce(F.try_divide(2 * F.col("d"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("diversity"))


def evolve(population: DataFrame, m: DataFrame, generations: int, seed: int, elite: int = 4, patience: int = 5) -> tuple[DataFrame, DataFrame]:
    """(genes of the last generation, history of generation, best, mean, std).

    Each generation scores the population from the moments, keeps the elite,
    fills up with mutated children of tournament winners, and stops when the
    best has not risen for ``patience`` generations.  The driver holds one row
    for each generation; lineage is cut every time.
    """
    spark = population.sparkSession
    shared_folder(spark)
    population, n = population.checkpoint(), population.select("dna_id").distinct().count()
    history, stale = [], 0
    for g in range(generations):
        scores = evaluate(population, m).checkpoint()
        s = population_stats(scores).first()
        stale = stale + 1 if history and s["best"] <= max(h[1] for h in history) else 0
        history.append((g, s["best"], s["mean"], s["std"], s["best_id"]))
        if g == generations - 1 or stale >= patience:
            break
        kept = scores.orderBy(F.desc("fitness"), "dna_id").limit(elite).select("dna_id")
        children = spark.range(n - elite).select(F.format_string(f"g{g + 1}-%05d", "id").alias("child"))
        born = crossover(population, tournaments(scores, children, seed + 31 * g), seed + 31 * g + 7)
        population = population.join(kept, "dna_id", "left_semi").unionByName(mutate(born, seed + 31 * g + 13)).checkpoint()
    return population, spark.createDataFrame(history, "generation int, best double, mean double, std double, best_id string")


def apply_patch(weights: DataFrame, patch: DataFrame, cap: float = 0.1) -> DataFrame:
    """Weights changed by named factors, each change within ``cap`` of the old weight; names without a patch stay, unknown ones are left out."""
    change = F.least(F.greatest(F.coalesce(F.col("factor"), F.lit(1.0)), F.lit(1 - cap)), F.lit(1 + cap))
    return weights.join(patch.select("name", "factor"), "name", "left").select(*(c for c in weights.columns if c != "weight"), F.round(clip(F.col("weight") * change), 6).alias("weight"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(drift): the mean relative change of weights that were not zero; a missing weight counts as zero."""
    both = old.select("name", F.col("weight").alias("o")).join(new.select("name", F.col("weight").alias("n")), "name", "full")
    return both.where(F.abs("o") > 0).agg(F.coalesce(F.avg(F.abs(F.coalesce("n", F.lit(0.0)) - F.col("o")) / F.abs("o")), F.lit(0.0)).alias("drift"))


def weights_of(genes: DataFrame) -> DataFrame:
    """(dna_id, weights, vector, genes_json) of each genome, genes by name.

    ``weights`` maps the active genes that are not 0, ``vector`` has all active
    ones, ``genes_json`` is the map as JSON.  ``genes`` may have ``active``.
    """
    active = F.coalesce(F.col("active"), F.lit(True)) if "active" in genes.columns else F.lit(True)
    rows = genes.withColumn("_active", active).groupBy("dna_id").agg(F.array_sort(F.collect_list(F.when(F.col("_active"), F.struct("name", "weight")))).alias("g"))
    some = F.map_from_entries(F.filter("g", lambda x: x["weight"] != 0))
    return rows.select("dna_id", some.alias("weights"), F.transform("g", lambda x: x["weight"]).alias("vector"), F.to_json(some).alias("genes_json"))


def from_vector(genes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Genes with the weights of (dna_id, vector), clipped, in the order of the active genes' names; a shorter vector leaves the rest."""
    active = F.coalesce(F.col("active"), F.lit(True)) if "active" in genes.columns else F.lit(True)
    at = F.row_number().over(Window.partitionBy("dna_id", "_active").orderBy("name"))
    rows = genes.withColumn("_active", active).withColumn("_at", at).join(vectors.select("dna_id", F.col("vector").alias("_v")), "dna_id", "left")
    given = F.try_element_at("_v", "_at")
    new = F.when(F.col("_active") & given.isNotNull(), clip(given))
    return rows.withColumn("weight", F.coalesce(new, F.col("weight"))).drop("_active", "_at", "_v")


def from_json(rows: DataFrame, id_col: str = "dna_id", json_col: str = "genes_json") -> DataFrame:
    """(dna_id, name, weight) of genomes kept as JSON maps, weights clipped; what is no map gives no genes."""
    return rows.select(F.col(id_col).alias("dna_id"), F.explode(F.from_json(json_col, "map<string,double>")).alias("name", "weight")).withColumn("weight", clip(F.col("weight")))
