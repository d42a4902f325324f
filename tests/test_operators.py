"""Operators against small hand-made cases and plain Python."""

from __future__ import annotations

import datetime as dt
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import costs, normalise, recursive
from barloom.operators import documents as D
from barloom.operators import evolve as E
from barloom.operators import simulate as S
from barloom.operators import temporal as J
from barloom.operators.trades import ranks_and_halves
from barloom.sources.journal import Journal, read_bars, read_texts, write_bars


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def simulated(spark, bars, **rules):
    rows = [("p", s, day(t), *map(float, (high, low, close, si, atr))) for s, t, high, low, close, si, atr in bars]
    frame = spark.createDataFrame(rows, "portfolio string, symbol string, ts date, high double, low double, close double, si double, atr double")
    return S.simulate(frame, S.runs_table(spark, [S.Rules(**rules)])).orderBy("entry_date", "symbol").collect()


def test_stop_before_target(spark):
    got = simulated(spark, [("A", 0, 100, 100, 100, 0.9, 1), ("A", 1, 110, 90, 100, 0.9, 1)])
    assert [(r["exit_reason"], r["exit_price"], r["bars"]) for r in got] == [("stop_loss", 98.0, 1)]


def test_target_signal_and_end(spark):
    got = simulated(spark, [("A", 0, 100, 100, 100, 0.9, 1), ("A", 1, 104, 99, 103, 0.9, 1), ("B", 0, 50, 50, 50, -0.8, 5), ("B", 1, 51, 49, 50, 0.5, 5), ("C", 1, 10, 10, 10, 0.9, 1)])
    assert {(r["symbol"], r["direction"], r["exit_reason"], r["exit_price"]) for r in got} == {("A", "LONG", "take_profit", 103.0), ("B", "SHORT", "signal", 50.0), ("C", "LONG", "end", 10.0)}
    a = next(r for r in got if r["symbol"] == "A")
    assert a["quantity"] == 100 and a["gross_pnl"] == 300.0
    fee = sum(v * (costs.REGULATOR + costs.SLIPPAGE + side + costs.EXCHANGE * (1 + costs.GST)) + costs.BROKERAGE_FLAT * (1 + costs.GST) for v, side in ((10_000, costs.STAMP_BUY), (10_300, costs.TAX_INTRADAY_SELL)))
    assert a["total_costs"] == pytest.approx(fee) and a["net_pnl"] == pytest.approx(300 - fee)


def test_limits(spark):
    bars = [(s, 0, 100, 100, 100, 0.9, 1) for s in "ABCDEFG"] + [(s, 1, 100, 100, 100, 0, 1) for s in "ABCDEFG"]
    assert {r["symbol"] for r in simulated(spark, bars)} == set("ABCDE")
    assert {r["symbol"] for r in simulated(spark, bars, max_entries=2)} == set("AB")
    assert simulated(spark, bars, warm_up=2) == []
    assert simulated(spark, [(s, t, h, lo, c, -si, a) for s, t, h, lo, c, si, a in bars], long_only=True) == []


def test_cooldown(spark):
    bars = [("A", 0, 100, 100, 100, 0.9, 1), ("A", 1, 100, 90, 95, 0.9, 1), *(("A", t, 95, 95, 95, 0.9, 1) for t in range(2, 8))]
    assert [r["entry_date"] for r in simulated(spark, bars)] == [day(0), day(4)]


def test_recursive_indicators_follow_their_recursions():
    rng = np.random.default_rng(1)
    close = pd.Series(100 + rng.standard_normal(120).cumsum())
    b = pd.DataFrame({"open": close, "high": close + 1, "low": close - 1, "close": close, "volume": 10.0})
    e, a = close[0], 2 / 11
    for i in range(1, 120):
        e = a * close[i] + (1 - a) * e
    assert recursive.ema(close, 10).iloc[-1] == pytest.approx(e)
    assert recursive.ema(close, 10).isna().sum() == 9
    r = recursive.rsi(b, 14)["RSI_14"].dropna()
    assert ((r >= 0) & (r <= 100)).all()
    up = pd.DataFrame({c: np.arange(1.0, 60) for c in ("open", "high", "low", "close", "volume")})
    assert recursive.rsi(up, 14)["RSI_14"].iloc[-1] == 100
    sar = recursive.psar(b)
    assert (sar["PSARl"].notna() ^ sar["PSARs"].notna())[1:].all()


def test_normalisers(spark):
    rows = spark.createDataFrame([("a", i, float(i % 7)) for i in range(60)], "symbol string, ts int, x double")
    out = rows.select("ts", normalise.bounded(F.col("x"), 0, 6).alias("b"), normalise.adaptive(F.col("x")).alias("a"), normalise.point_in_time(F.col("x")).alias("p")).orderBy("ts").toPandas()
    assert out["b"].between(-1, 1).all() and out["a"].between(-1, 1).all()
    x = pd.Series([float(i % 7) for i in range(60)])
    assert out["a"][40] == pytest.approx(np.tanh(0.5 * (x[40] - x[:41].mean()) / x[:41].std()))
    assert out["p"][40] == pytest.approx(np.tanh(0.5 * (x[40] - x[:40].mean()) / x[:40].std()))
    flat = spark.createDataFrame([("a", i, 5.0) for i in range(30)], "symbol string, ts int, x double")
    assert flat.select(normalise.adaptive(F.col("x")).alias("a")).where("a <> 0").count() == 0
    assert [normalise.method(*m) for m in (("momentum", 0, 100), ("volume", None, None), ("overlap", None, None), ("trend", None, None))] == ["bounded", "percentile", "price_relative", "adaptive"]


def test_sizes_and_prices(spark):
    r = spark.range(1).select(
        costs.position_size(F.lit(100_000.0), F.lit(100.0), F.lit(98.0)).alias("n"), costs.position_size(F.lit(100_000.0), F.lit(100.0), F.lit(100.0)).alias("none"),
        costs.stop_price(F.lit(100.0), F.lit(3.0), F.lit(True)).alias("stop"), costs.target_price(F.lit(100.0), F.lit(94.0)).alias("target"), costs.fill_price(F.lit(100.0), F.lit("SELL")).alias("fill")).first()
    assert (r["n"], r["none"], r["stop"], r["target"]) == (200, 0, 94.0, 112.0) and r["fill"] == pytest.approx(99.95)


def test_asof_ties_and_strictness(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), ("c", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 4, 12), ("a", 6, 13), ("b", 6, 14)], "k string, t int, v int")
    read = lambda **o: sorted((r["k"], r["t"], r["v"]) for r in J.asof_join(left, right, ["k"], "t", "v", **o).collect())
    assert read() == [("a", 1, 11), ("a", 5, 12), ("b", 5, None), ("c", 1, None)]
    assert read(strict=True) == [("a", 1, None), ("a", 5, 12), ("b", 5, None), ("c", 1, None)]
    assert read(forward=True) == [("a", 1, 11), ("a", 5, 13), ("b", 5, 14), ("c", 1, None)]
    assert read(forward=True, strict=True) == [("a", 1, 12), ("a", 5, 13), ("b", 5, 14), ("c", 1, None)]


def chunks_in_python(text, limit, overlap):
    import math
    import re
    n = lambda t: math.floor(len(t.split()) * 1.3)
    units = []
    for p in (p.strip(" ") for p in re.split(r"\n\s*\n", text)):
        if p:
            units += [s for s in re.split(r"(?<=[.!?])\s+", p) if s] if n(p) > limit else [p]
    out, now = [], ""
    for u in units:
        if now and n(now) + n(u) > limit:
            out.append(now)
            now = " ".join(now.split()[-overlap:]) + "\n\n" + u
        else:
            now = now + "\n\n" + u if now else u
    return [*out, now] if now else out


def test_paragraph_chunks(spark):
    rng = np.random.default_rng(4)
    texts = ["", "one", "\n\n \n", *("\n\n".join(". ".join(" ".join(["w"] * int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 5)))) + "." for _ in range(int(rng.integers(1, 12)))) for _ in range(20))]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "id int, text string")
    got = {}
    for r in D.paragraph_chunks(docs, "id", "text", 40, 5).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["text"])
    for i, t in enumerate(texts):
        assert got.get(i, []) == chunks_in_python(t, 40, 5), i


def test_mmr_prefers_other_words(spark):
    rows = spark.createDataFrame([(1, 10, 0.9, 1, "a b c"), (1, 11, 0.89, 2, "a b c"), (1, 12, 0.6, 3, "x y z")], "query int, id int, score double, rank int, text string")
    assert [r["id"] for r in D.mmr(rows, 2).orderBy("mmr_rank").collect()] == [10, 12]


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 5))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>").repartition(5)
    got = D.nearest(vectors.where("vec_id < 7").withColumnRenamed("vec_id", "query"), vectors, 4)
    for q in range(7):
        want = np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:4].tolist()
        assert [r["vec_id"] for r in got.where(f"query = {q}").orderBy("rank").collect()] == want


def test_evolution(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 3))
    y = x @ [1.0, -0.5, 0.0] + rng.standard_normal(500) * 0.1
    data = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    m = E.moments(data, ["a", "b", "c"], "y").cache()
    population = E.random_population(spark, ["a", "b", "c"], 16, 5)
    w = population.groupBy("dna_id").pivot("name", ["a", "b", "c"]).agg(F.first("weight")).toPandas().set_index("dna_id")
    for r in E.evaluate(population, m).collect():
        assert r["fitness"] == pytest.approx(np.corrcoef(x @ w.loc[r["dna_id"]].to_numpy(), y)[0, 1], abs=1e-5)
    pairs = [((w.iloc[i] - w.iloc[j]) ** 2).sum() for i in range(16) for j in range(i)]
    assert E.diversity(population).first()["diversity"] == pytest.approx(np.mean(pairs))
    last, history = E.evolve(population, m, 4, 9)
    best = [r["best"] for r in history.orderBy("generation").collect()]
    assert best == sorted(best) and last.select("dna_id").distinct().count() == 16
    assert last.where("abs(weight) > 1").count() == 0


def test_patches(spark):
    w = spark.createDataFrame([("a", 0.5), ("b", -0.4), ("c", 0.95)], "name string, weight double")
    p = spark.createDataFrame([("a", 5.0), ("c", 1.1), ("z", 2.0)], "name string, factor double")
    new = E.apply_patch(w, p)
    assert {r["name"]: r["weight"] for r in new.collect()} == {"a": 0.55, "b": -0.4, "c": 1.0}
    assert E.drift(w, new).first()["drift"] == pytest.approx((0.1 + 0 + 0.05 / 0.95) / 3)


def test_journal(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"), "id int, name string, score double", ["id"])
    rows = lambda *r: spark.createDataFrame(list(r), "id int, name string, score double")
    j.append(rows((1, "a", 1.0), (2, "b", 2.0)), 1)
    j.append(rows((2, "B", 2.5)), 2)
    j.update(spark.createDataFrame([(1, 9.0, "no"), (7, 1.0, "no")], "id int, score double, name string"), 3, ["score"])
    j.delete(rows((2, None, None)), 4)
    assert [tuple(r) for r in j.read().collect()] == [(1, "a", 9.0)]
    j.append(rows((2, "again", 0.0)), 5)
    assert j.read().count() == 2


def test_bars_on_disk(spark, tmp_path):
    bars = spark.createDataFrame([("A", day(i), float(i)) for i in range(9)] + [("B", day(1), 5.0)], "symbol string, ts date, close double")
    write_bars(bars, str(tmp_path / "bars"))
    assert read_bars(spark, str(tmp_path / "bars"), symbols=["A"], start="2024-01-03", end="2024-01-05").count() == 3
    plan = read_bars(spark, str(tmp_path / "bars"), symbols=["A"], start="2024-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [symbol" in plan.replace("isnotnull(", "") or "PartitionFilters" in plan
    (tmp_path / "kb" / "sub").mkdir(parents=True)
    (tmp_path / "kb" / "a.md").write_text("# A\ntext")
    (tmp_path / "kb" / "sub" / "b.txt").write_text("b")
    (tmp_path / "kb" / "sub" / "c.bin").write_text("c")
    assert sorted(r["text"] for r in read_texts(spark, str(tmp_path / "kb")).collect()) == ["# A\ntext", "b"]


def test_paragraphs_keep_their_first_and_last_digits(spark):
    docs = spark.createDataFrame([(1, "0 zero 0\n\n 1 one 1 \n\n2 two 2")], "doc_id int, text string")
    got = D.paragraph_chunks(docs, "doc_id", "text").collect()
    assert [r["text"] for r in got] == ["0 zero 0\n\n1 one 1\n\n2 two 2"]


def test_distances_are_not_held_whole(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((300, 8)), rng.standard_normal((20_000, 8))
    b[::3] = b[0]
    ids = pd.Series(rng.permutation(len(b)))
    tracemalloc.start()
    i, j, distance = D.k_nearest(a, b, ids, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(a) * len(b)
    monkeypatch.setattr(D, "CELLS", 50_000)
    monkeypatch.setattr(D, "PIECE", 7)
    for got, again in zip((i, j, distance), D.k_nearest(a, b, ids, 5)):
        assert (got == again).all()
    for q in range(0, 300, 50):
        d = ((b - a[q]) ** 2).sum(axis=1).round(9)
        assert j[i == q].tolist() == np.lexsort((ids, d))[:5].tolist()


def test_merged_spans(spark):
    """A point meets at most one merged span of a key, however many cover it."""
    rng = np.random.default_rng(7)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m))
    raw = [("ab"[i % 2], int(m), int(m) + int(rng.integers(-1, 90))) for i, m in enumerate(rng.integers(0, 6000, 120))] + [("a", 100, 101), ("a", 101, 102), ("c", 5, 4)]
    spans = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in raw], "k string, a timestamp_ntz, b timestamp_ntz")
    points = spark.createDataFrame([(m, at(m)) for m in range(0, 6200, 7)], "m int, at timestamp_ntz")
    for hours in (1, 24):
        got = J.interval_join(points, J.merged_spans(spans, "a", "b", "k", hours=hours), "at", "a", "b", 1).select("m", "k").collect()
        want = {(m, k) for m in range(0, 6200, 7) for k, a, b in raw if a <= m <= b}
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_interval_join_leaves_in_packs(spark, monkeypatch, tmp_path):
    """All pairs are found whatever the size of packs, and dense ones take little space where they are written."""
    rng = np.random.default_rng(9)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(m))
    raw = [(i, int(a), int(a) + int(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 90_000, 300), 10 ** rng.uniform(-1, 5, 300) - 1))]
    spans = spark.createDataFrame([(i, at(a), at(b), {"a": i}) for i, a, b in raw], "s int, a timestamp_ntz, b timestamp_ntz, m map<string,int>")
    points = spark.createDataFrame([(m, at(m)) for m in range(0, 90_000, 500)] + [(-1, None)], "p int, at timestamp_ntz")
    want = sorted((m, i) for m in range(0, 90_000, 500) for i, a, b in raw if a <= m <= b)
    for size in (1, 7, 256):
        monkeypatch.setattr(J, "PACK", size)
        got = J.interval_join(points, spans, "at", "a", "b", 1)
        assert got.columns == ["p", "at", "s", "a", "b", "m"]
        assert sorted((r["p"], r["s"]) for r in got.collect()) == want
    some = spark.range(8000).select("id", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, pmod(xxhash64(id), 86400))").alias("at"))
    long = some.select(F.col("id").alias("s"), F.col("at").alias("a"), F.expr("at + INTERVAL 6 HOURS").alias("b"))
    J.interval_join(some.limit(1000), long, "at", "a", "b", 6).select("id", "s").write.parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n > 1_000_000 and sum(p.stat().st_size for p in tmp_path.rglob("*.parquet") if p.is_file()) < 0.5 * n


def test_interval_join_deals_out_a_bucket(spark):
    """Points and spans of one hour leave from several tasks, and what meets are packs on both sides."""
    at = lambda c, n: F.expr(f"timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, {c} % {n})")
    points = spark.range(2000).select("id", at("id", 3000).alias("at"))
    spans = spark.range(1000).select(F.col("id").alias("s"), at("id", 900).alias("a")).withColumn("b", F.expr("a + INTERVAL 10 MINUTES"))
    got = J.interval_join(points, spans, "at", "a", "b", 6).withColumn("task", F.spark_partition_id())
    by_task = {r["task"]: r["count"] for r in got.groupBy("task").count().collect()}
    assert sum(by_task.values()) == sum(s % 900 <= p <= s % 900 + 600 for p in range(2000) for s in range(1000))
    assert len(by_task) > 1 and max(by_task.values()) < 0.7 * sum(by_task.values())
    assert got.count() == got.select("id", "s").distinct().count()


def test_rest_of_a_group_is_ranked_in_parts(spark):
    rng = np.random.default_rng(8)
    raw = [("ab"[int(i == 7)], float(x), f"t{i % 40}") for i, x in enumerate(rng.integers(0, 30, 300))] + [("c", 1.0, "same")] * 50
    rows = spark.createDataFrame(raw, "k string, x double, id string")
    out = J.all_but_top(rows, 20, [F.desc("x"), F.col("id")], "k")
    want = [r for k in "abc" for r in sorted((r for r in raw if r[0] == k), key=lambda r: (-r[1], r[2]))[20:]]
    assert sorted(tuple(r) for r in out.select("k", "x", "id").collect()) == sorted(want)
    assert "_part" in out._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_read_their_rows_once(spark):
    raw = [("a", float(i % 5), float(i * 7 % 11), i % 3) for i in range(60)]
    rows = spark.createDataFrame(raw, "indicator string, value double, result double, ts int").repartition(3)
    out = ranks_and_halves(rows, "result")
    order = sorted((r[3], r[1], r[2]) for r in raw)
    rank = lambda i, x: sum(r[i] < x for r in raw) + (sum(r[i] == x for r in raw) + 1) / 2
    got = out.collect()
    assert sorted((r["ts"], r["value"], r["result"]) for r in got if r["first_half"]) == order[:30] and len(got) == 60
    assert all(r["rv"] == rank(1, r["value"]) and r["rr"] == rank(2, r["result"]) for r in got)
