"""Queries that simulate portfolios, evolve weights and run streams to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import costs as C
from ..functions import normalise as N
from ..operators import analytics as A
from ..operators import bars as B
from ..operators import evolve as E
from ..operators import simulate as S
from ..operators import trades as T
from ..session import shared_folder
from ..sources.tables import daily_bars, table
from ..streaming import bars as ST
from ..streaming import count_bars as CB
from .base import DAILY, query

RUNS = [S.Rules("base"), S.Rules("tight", stop=1.0, take_profit=1.5), S.Rules("eager", enter=0.3, leave=0.1), S.Rules("long", long_only=True, take_profit=0.0),
        S.Rules("inflated", accounting="inflated", max_value=50_000.0), S.Rules("weekly", week_limit=0.01)]
PORTFOLIOS = 8


def signal_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with a signal in [-1, 1] and a simple mean true range, symbols dealt over portfolios."""
    rows = daily_bars(spark, sf_dir)
    before = F.lag("close").over(B.series())
    rows = rows.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    si = N.squash(F.try_divide(F.col("close") - F.avg("close").over(A.rows_back(20)), F.stddev_samp("close").over(A.rows_back(20))) * 2)
    rows = rows.withColumns({"atr": F.avg("tr").over(A.rows_back(14)), "si": F.coalesce(si, F.lit(0.0)), "portfolio": F.concat(F.lit("p"), F.pmod(F.crc32(F.col("symbol").cast("binary")), F.lit(PORTFOLIOS)).cast("string"))})
    return rows.select("portfolio", "symbol", "ts", "high", "low", "close", "si", "atr")


@query()
def simulated_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of six runs over all portfolios."""
    out = S.simulate(signal_bars(spark, sf_dir), S.runs_table(spark, RUNS))
    return out.withColumns({c: F.round(c, 4) for c in ("entry_price", "exit_price", "gross_pnl", "total_costs", "net_pnl")})


@query()
def simulated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each run, with the deepest fall of its result."""
    out = S.simulate(signal_bars(spark, sf_dir), S.runs_table(spark, RUNS)).withColumns({
        "trade_id": F.concat_ws("-", "run_id", "symbol", "entry_date"), "net_pnl_pct": F.try_divide("net_pnl", F.col("entry_price") * F.col("quantity"))})
    m = T.metrics(out, "run_id").join(T.max_drawdown(out, "run_id"), "run_id")
    return m.select("run_id", "total_trades", "winning_trades", *(F.round(c, 4).alias(c) for c in ("net_profit", "win_rate", "profit_factor", "sharpe", "max_drawdown_abs")))


_GENOMES = {"g1": {"si": 1.0}, "g2": {"si": -1.0}, "g3": {"si": 0.5, "mom": 1.0}, "g4": {"mom": -1.0}}


@query()
def genome_simulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitness of four genomes by simulation: their trades' metrics and drawdown, scored."""
    mom = N.squash(A.pct_change("close", 5, over=B.series()) * 10)
    rows = signal_bars(spark, sf_dir).withColumn("mom", F.coalesce(mom, F.lit(0.0)))
    out = S.genome_runs(rows, _GENOMES, S.Rules(max_value=50_000.0)).withColumns({
        "trade_id": F.concat_ws("-", "run_id", "symbol", "entry_date"), "net_pnl_pct": F.try_divide("net_pnl", F.col("entry_price") * F.col("quantity"))})
    m = T.fitness(T.metrics(out, "run_id").join(T.max_drawdown(out, "run_id"), "run_id"))
    return m.select("run_id", "total_trades", *(F.round(c, 4).alias(c) for c in ("net_profit", "win_rate", "max_drawdown", "fitness")))


def _factors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    rows = daily_bars(spark, sf_dir)
    r = rows.withColumns({"F_1": A.pct_change("close", 1), "F_5": A.pct_change("close", 5), "V_1": A.pct_change("volume", 1), "H_0": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
                          "fwd": A.forward_return("close", 5)})
    return r.select("F_1", "F_5", "V_1", "H_0", "fwd"), ["F_1", "F_5", "V_1", "H_0"]


_WEIGHTS = {"d1": (0.5, -0.2, 0.1, 0.0), "d2": (0.0, 1.0, 0.0, -0.5), "d3": (0.1, 0.1, 0.1, 0.1)}
_OVER = "OVER (PARTITION BY symbol ORDER BY ts)"


@query(f"""WITH {DAILY}, f AS (SELECT close / lag(close) {_OVER} - 1 AS a, close / lag(close, 5) {_OVER} - 1 AS b, volume / lag(volume) {_OVER} - 1 AS c, (high - low) / close AS d, lead(close, 5) {_OVER} / close - 1 AS y FROM bars),
    g AS (SELECT * FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL AND y IS NOT NULL)
    """ + " UNION ALL ".join(f"SELECT '{k}' AS dna_id, round(corr({w[0]}::DOUBLE * a + {w[1]}::DOUBLE * b + {w[2]}::DOUBLE * c + {w[3]}::DOUBLE * d, y), 5) AS fitness FROM g" for k, w in _WEIGHTS.items()))
def genome_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of three genomes' signals with the forward return, from sums over the data."""
    rows, names = _factors(spark, sf_dir)
    genes = spark.createDataFrame([(k, n, w) for k, ws in _WEIGHTS.items() for n, w in zip(names, ws)], "dna_id string, name string, weight double")
    return E.evaluate(genes, E.moments(rows, names, "fwd")).withColumn("fitness", F.round("fitness", 5))


@query()
def evolution_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best, mean and deviation of each generation of an evolution."""
    rows, names = _factors(spark, sf_dir)
    m = E.moments(rows, names, "fwd").cache()
    return E.evolve(E.random_population(spark, names, 24, 7), m, 4, 11)[1]


_EVENTS = "SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, event_id, ts AS moment, value FROM events WHERE value > 0"


@query(f"""WITH e AS ({_EVENTS}) SELECT symbol, ts, round(first(value ORDER BY moment, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(last(value ORDER BY moment, event_id), 6) AS close,
    round(sum(value), 4) AS volume, count(*) AS num_trades FROM e GROUP BY 1, 2""")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars of the event stream, the newest state of each window."""
    out = ST.drain(ST.bars(ST.event_stream(spark, f"{sf_dir}/events.parquet*")), shared_folder(spark), "update")
    rows = ST.newest(out, "symbol", "ts")
    return rows.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *(F.round(c, 6).alias(c) for c in B.OHLC), F.round("volume", 4).alias("volume"), "num_trades")


@query("""WITH t AS (SELECT event_type AS symbol, ts, event_id, value FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL AND epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL)),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
    n AS (SELECT *, row_number() OVER (PARTITION BY symbol, k ORDER BY ts, event_id) AS rn FROM s),
    b AS (SELECT symbol, k, (rn - 1) // 7 AS j, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(value, rn) AS open, max(value) AS high, min(value) AS low, arg_max(value, rn) AS close, sum(value) AS volume,
        sum(value * value) / nullif(sum(value), 0) AS vwap, count(*) AS num_trades, count(*) = 7 AS complete FROM n GROUP BY 1, 2, 3),
    m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k, j) - 1 AS bar, k = max(k) OVER (PARTITION BY symbol) AS newest FROM b)
    SELECT symbol, bar, first_ts, last_ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 4) AS volume, round(CASE WHEN volume > 0 THEN vwap ELSE close END, 4) AS vwap, num_trades, complete
    FROM m WHERE complete OR NOT newest OR last_ts + INTERVAL 45 MINUTE < (SELECT date_trunc('millisecond', max(ts)) FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL)""")
def stream_tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of seven events each from the stream; one is closed with fewer after 45 silent minutes."""
    events = ST.event_stream(spark, f"{sf_dir}/events.parquet*")
    out = ST.drain(CB.count_bars(events, 7, "45 minutes", "0 seconds"), shared_folder(spark), "append", conf=CB.ROCKSDB)
    return out.select("symbol", "bar", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")), *(F.round(c, 6).alias(c) for c in B.OHLC),
                      F.round("volume", 4).alias("volume"), F.round("vwap", 4).alias("vwap"), "num_trades", "complete")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
    r AS (SELECT user_id, k, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2)
    SELECT user_id, first_ts, last_ts, n, total FROM r WHERE last_ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that the watermark has closed."""
    out = ST.drain(ST.sessions(ST.event_stream(spark, f"{sf_dir}/events.parquet*")), shared_folder(spark), "append")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")), "n", F.round("total", 4).alias("total"))


@query("""WITH RECURSIVE s AS (SELECT event_type AS symbol, ts, value, lag(value) OVER w AS p, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
    m AS (SELECT symbol, ts, value, rn, 0 AS held, 'HOLD' AS signal_type FROM s WHERE rn = 1 UNION ALL
        SELECT s.symbol, s.ts, s.value, s.rn, CASE WHEN held = 0 AND s.value > 60 AND s.p <= 60 THEN 1 WHEN held = 1 AND s.value < 20 THEN 0 ELSE held END,
            CASE WHEN held = 0 AND s.value > 60 AND s.p <= 60 THEN 'LONG_ENTRY' WHEN held = 1 AND s.value < 20 THEN 'LONG_EXIT' ELSE 'HOLD' END
        FROM m JOIN s ON s.symbol = m.symbol AND s.rn = m.rn + 1)
    SELECT symbol, signal_type, count(*) AS n, round(sum(value), 4) AS total FROM m GROUP BY 1, 2""")
def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and exits by state kept for each symbol of the stream."""
    out = ST.drain(ST.keyed_signals(ST.event_stream(spark, f"{sf_dir}/events.parquet*"), 60, 20), shared_folder(spark), "append")
    return out.groupBy("symbol", "signal_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH a AS (SELECT event_id, event_type, CASE event_type WHEN 'purchase' THEN greatest(value - 80, 10 - value) WHEN 'view' THEN greatest(value - 90, 5 - value) END AS excess,
        CASE event_type WHEN 'purchase' THEN 70 ELSE 85 END AS span FROM events WHERE event_type IN ('purchase', 'view'))
    SELECT event_id, event_type, round(excess, 6) AS excess, CASE WHEN excess > span THEN 'high' ELSE 'normal' END AS priority FROM a WHERE excess > 0""")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ST.drain(ST.alerts(ST.event_stream(spark, f"{sf_dir}/events.parquet*"), {"purchase": (10, 80), "view": (5, 90)}), shared_folder(spark), "append")
    return out.select("event_id", "event_type", F.round("excess", 6).alias("excess"), "priority")


@query("""WITH f AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 'entry' ELSE 'exit' END AS kind, ts, value AS price FROM events WHERE event_type IN ('view', 'purchase')),
    n AS (SELECT *, lead(kind) OVER w AS nk, lead(ts) OVER w AS nt, lead(price) OVER w AS np FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, kind))
    SELECT user_id, ts AS entry_ts, round(price, 6) AS entry_price, CASE WHEN nk = 'exit' THEN nt END AS exit_ts, round(CASE WHEN nk = 'exit' THEN np END, 6) AS exit_price FROM n WHERE kind = 'entry'""")
def ledger_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a ledger with the exits that follow them."""
    fills = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')").select("user_id", F.when(F.col("event_type") == "view", "entry").otherwise("exit").alias("kind"), "ts", F.col("value").alias("price"))
    return S.pair_fills(fills, "user_id").withColumns({c: F.round(c, 6) for c in ("entry_price", "exit_price")})


@query(f"""WITH {DAILY}, t AS (SELECT symbol, ts, close, greatest(high - low, abs(high - lag(close) {_OVER}), abs(low - lag(close) {_OVER})) AS tr FROM bars),
    a AS (SELECT symbol, ts, close, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS atr FROM t WHERE close > 0), l AS (SELECT * FROM a WHERE atr > 0)
    SELECT symbol, ts, round(close - 2 * atr, 5) AS stop, round(close + 4 * atr, 5) AS target, floor(least(100000 * 0.02::DOUBLE / (close - (close - 2 * atr)), 100000 * 0.2::DOUBLE / close))::BIGINT AS n FROM l""")
def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop, target and size of a long position entered at each close."""
    rows = daily_bars(spark, sf_dir)
    before = F.lag("close").over(B.series())
    rows = rows.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))).withColumn("atr", F.avg("tr").over(A.rows_back(14))).where("atr > 0 AND close > 0")
    close = F.col("close")
    rows = rows.withColumn("s", C.stop_price(close, F.col("atr"), F.lit(True)))
    return rows.select("symbol", "ts", F.round("s", 5).alias("stop"), F.round(C.target_price(close, F.col("s")), 5).alias("target"), C.position_size(F.lit(100_000.0), close, F.col("s")).alias("n"))


@query("""WITH g AS (SELECT c_custkey AS dna_id, name, w FROM (SELECT c_custkey, 'a' AS name, c_acctbal / 10000 AS w FROM customer UNION ALL SELECT c_custkey, 'b', c_nationkey / 25.0::DOUBLE FROM customer)),
    n AS (SELECT count(DISTINCT dna_id) AS n FROM g), d AS (SELECT sum(n * q - s * s) AS d, any_value(n) AS n FROM (SELECT name, sum(w) AS s, sum(w * w) AS q FROM g GROUP BY 1) CROSS JOIN n)
    SELECT round(2 * d / (n * (n - 1)), 6) AS diversity FROM d""")
def population_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared distance of two genomes whose genes follow from customers."""
    c = table(spark, sf_dir, "customer")
    genes = c.select(F.col("c_custkey").alias("dna_id"), F.explode(F.create_map(F.lit("a"), F.col("c_acctbal") / 10000, F.lit("b"), F.col("c_nationkey") / 25.0)).alias("name", "weight"))
    return E.diversity(genes).select(F.round("diversity", 6).alias("diversity"))


@query("""WITH w AS (SELECT p_partkey AS name, (p_size - 25) / 50.0::DOUBLE AS weight FROM part), p AS (SELECT p_partkey AS name, p_size / 20.0::DOUBLE AS factor FROM part)
    SELECT w.name, round(least(greatest(w.weight * least(greatest(coalesce(factor, 1), 0.9::DOUBLE), 1.1::DOUBLE), -1), 1), 6) AS weight FROM w LEFT JOIN p ON w.name = p.name""")
def patched_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    weights = part.select(F.col("p_partkey").alias("name"), ((F.col("p_size") - 25) / 50.0).alias("weight"))
    return E.apply_patch(weights, part.select(F.col("p_partkey").alias("name"), (F.col("p_size") / 20.0).alias("factor")))


@query("""WITH g AS (SELECT c_custkey AS dna_id, n AS name, CASE n WHEN 'a' THEN round(c_acctbal / 10000, 4) WHEN 'b' THEN c_nationkey / 25.0::DOUBLE ELSE 0.0::DOUBLE END AS weight, NOT (n = 'b' AND c_nationkey % 2 = 0) AS active
        FROM customer CROSS JOIN (VALUES ('a'), ('b'), ('c')) t(n))
    SELECT dna_id, string_agg(name, ',' ORDER BY name) FILTER (active AND weight <> 0) AS names, count(*) FILTER (active) AS size, round(sum(weight) FILTER (active), 6) AS total FROM g GROUP BY 1""")
def genome_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes as maps and vectors of their active genes."""
    c = table(spark, sf_dir, "customer")
    genes = c.select(F.col("c_custkey").alias("dna_id"), "c_nationkey", F.explode(F.create_map(F.lit("a"), F.round(F.col("c_acctbal") / 10000, 4), F.lit("b"), F.col("c_nationkey") / 25.0, F.lit("c"), F.lit(0.0))).alias("name", "weight"))
    w = E.weights_of(genes.withColumn("active", ~((F.col("name") == "b") & (F.col("c_nationkey") % 2 == 0))))
    names = F.array_join(F.array_sort(F.map_keys("weights")), ",")
    return w.select("dna_id", F.when(names != "", names).alias("names"), F.size("vector").cast("long").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
