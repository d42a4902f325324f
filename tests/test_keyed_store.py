"""Upserts by alias chains into bucketed tables."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.sources.keyed_store import TRADE_ALIASES, KeyedStore, canonical

SCHEMA = "trade_id long, direction string, entry_price double, net_pnl double, player long"


@pytest.fixture
def store(spark):
    s = KeyedStore(spark, SCHEMA, "player", ["trade_id"], 4)
    yield s
    s.drop()


def test_alias_chains(spark):
    rows = spark.createDataFrame([(1, "LONG", None, "3.5", 1.0), (2, None, "SHORT", None, None)], "trade_id long, side string, direction string, price string, other double")
    got = canonical(rows, T.StructType.fromDDL(SCHEMA), TRADE_ALIASES, {"net_pnl": 0.0, "entry_price": 9.0}).collect()
    assert [tuple(r) for r in got] == [(1, "LONG", 3.5, 0.0, None), (2, "SHORT", 9.0, 0.0, None)]


def test_newest_version_stays(spark, store):
    rng = random.Random(1)
    state = {}
    for version in (1, 3, 2, 4, 4):
        batch = {(rng.randrange(3), rng.randrange(60)): (rng.choice("LS"), rng.random(), rng.random()) for _ in range(50)}
        gone = set(rng.sample(sorted(batch), 10)) if version == 3 else set()
        frame = spark.createDataFrame([(i, p, d, e, n) for (p, i), (d, e, n) in batch.items()], "trade_id long, player long, side string, price double, pnl double")
        if gone:
            keys = spark.createDataFrame([(i, p) for p, i in gone], "trade_id long, player long")
            store.delete(keys, version)
            frame = frame.join(keys, ["trade_id", "player"], "left_anti")
        store.upsert(frame, version, TRADE_ALIASES)
        for k, v in batch.items():
            if state.get(k, (0,))[0] <= version:
                state[k] = (version, None if k in gone else v)
    want = sorted((i, *v, p) for (p, i), (_, v) in state.items() if v is not None)
    assert sorted(tuple(r) for r in store.read().collect()) == want


def test_reads_by_key_move_nothing(spark, store):
    store.upsert(spark.range(2000).select(F.col("id").alias("trade_id"), (F.col("id") % 3).alias("player"), F.lit(1.0).alias("net_pnl")), 1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(store.read().groupBy("player", "trade_id").agg(F.sum("net_pnl")))
        assert "Exchange" not in plan(store.read().alias("a").join(store.read().alias("b"), "trade_id"))
        one = plan(store.read().where("trade_id = 7 AND player = 1"))
        assert "EqualTo(trade_id,7)" in one and re.search(r"PartitionFilters: \[[^]]*player", one)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_touched_partitions_are_rewritten(spark, store):
    store.upsert(spark.range(90).select(F.col("id").alias("trade_id"), (F.col("id") % 3).alias("player")), 1)
    folder = store.path.removeprefix("file:")
    files = lambda p: sorted(os.listdir(f"{folder}/player={p}"))
    before = {p: files(p) for p in range(3)}
    store.upsert(spark.createDataFrame([(1, 1, "LONG")], "trade_id long, player long, side string"), 2, TRADE_ALIASES)
    assert files(0) == before[0] and files(2) == before[2] and files(1) != before[1]
    assert store.read().where("direction = 'LONG'").count() == 1 and store.read().count() == 90
    store.upsert(spark.createDataFrame([], "trade_id long, player long"), 3)
    assert store.read().count() == 90


def test_the_table_does_not_move_and_late_batches_write_nothing(spark, store):
    rows = spark.range(2000).select(F.col("id").alias("trade_id"), (F.col("id") % 3).alias("player"), F.lit("S").alias("side"))
    folder = store.path.removeprefix("file:")
    files = lambda: sorted((p, f) for p, _, fs in os.walk(folder) for f in fs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.upsert(rows, 2, TRADE_ALIASES)
        store.upsert(rows.where("trade_id < 900"), 3, TRADE_ALIASES)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [done.apply(i).physicalPlanDescription() for i in range(done.size())]
    written = [p for p in plans if "InsertIntoHadoopFsRelation" in p and store.name in p]
    assert len(written) == 2 and not any("Exchange" in p for p in written)
    held = files()
    store.upsert(rows.withColumn("side", F.lit("L")), 1, TRADE_ALIASES)
    assert files() == held and store.read().where("direction = 'S'").count() == 2000
    store.upsert(rows.where("player = 1").union(spark.createDataFrame([(5000, 2, "L")], "trade_id long, player long, side string")), 1, TRADE_ALIASES)
    changed = {p for p, _ in set(files()) ^ set(held)}
    assert any(p.endswith("player=2") for p in changed) and not any(p.endswith(("player=0", "player=1")) for p in changed)
    assert store.read().count() == 2001
