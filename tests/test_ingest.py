"""A stream of document changes, its replays and its errors."""

from __future__ import annotations

import hashlib
import random

import pytest

from barloom.streaming.ingest import CHANGES, Ingest, changes_stream, word_windows

md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
BATCHES = [
    [(1, "a", "one two three", False), (2, "a", "x", None), (3, "b", None, False), (None, "b", "lost", False), (4, "b", " \n", False), (9, "c", "gone before it came", True)],
    [(1, "a", "one two three", False), (2, "b", "y z", False), (5, None, "new", False), (6, "c", "short", False), (6, "c", "text that counts", False)],
    [(1, "a", None, True), (5, None, "newer text", False), (6, "c", "again", False), (6, "c", "", True)],
    [(1, "d", "back again", False)],
]


def state(ingest):
    return (sorted((r["doc_id"], r["source"], r["hash"], r["n_chunks"]) for r in ingest.documents().collect()),
            sorted((r["doc_id"], r["chunk"], r["text"]) for r in ingest.chunks().collect()),
            sorted(((r["doc_id"], r["reason"]) for r in ingest.errors().collect()), key=repr))


@pytest.fixture
def ingest(spark, tmp_path):
    return Ingest(spark, str(tmp_path / "store"), word_windows(2, 2))


def test_batches_restarts_and_replays(spark, ingest, tmp_path):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        ingest.run(changes_stream(spark, str(tmp_path / "in" / "*")))
        before = state(ingest)
        ingest.apply(spark.createDataFrame(rows, CHANGES), i)
        assert state(ingest) == before
    docs, chunks, errors = state(ingest)
    assert docs == [(1, "d", md5("back again"), 1), (2, "b", md5("y z"), 1), (5, None, md5("newer text"), 1)]
    assert chunks == [(1, 0, "back again"), (2, 0, "y z"), (5, 0, "newer text")]
    assert errors == sorted([(3, "no text"), (None, "no id"), (4, "no text")], key=repr)
    totals = {r["source"]: (r["n_docs"], r["n_chunks"], r["n_errors"]) for r in ingest.totals().collect()}
    assert totals == {"d": (1, 1, 0), "b": (1, 1, 3), None: (1, 1, 0)}


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    broken = {"yes": True}

    def chunker(docs):
        if broken["yes"] and docs.where("doc_id = 2").count():
            raise ValueError("stopped")
        return word_windows(2, 1)(docs)

    ingest = Ingest(spark, str(tmp_path / "store"), chunker)
    for i, rows in enumerate(([(1, "a", "one two three", False)], [(1, "a", "changed text here", False), (2, "a", "b", False)])):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = changes_stream(spark, str(tmp_path / "in" / "*"))
        if i:
            with pytest.raises(Exception, match="stopped"):
                ingest.run(stream)
            assert [r["hash"] for r in ingest.documents().collect()] == [md5("one two three")]
            broken.clear()
            broken["yes"] = False
        ingest.run(stream)
    assert sorted((r["doc_id"], r["text"]) for r in ingest.chunks().collect()) == [(1, "changed text"), (1, "here"), (1, "text here"), (2, "b")]


def test_nothing_yet(ingest):
    assert ingest.documents().count() == ingest.chunks().count() == ingest.totals().count() == 0


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_once(spark, ingest):
    rng = random.Random(3)
    rows = [(i, "a", rng.randbytes(2000).hex(), False) for i in range(300)]
    frame = spark.createDataFrame(rows, CHANGES)
    before = shuffled(spark)
    ingest.apply(frame, 0)
    assert shuffled(spark) - before < 1.5 * sum(len(r[2]) for r in rows)
    assert ingest.documents().count() == 300


@pytest.mark.parametrize("most", [0, 500_000])
def test_different_changes_of_one_document(spark, ingest, monkeypatch, most):
    monkeypatch.setattr("barloom.streaming.ingest.SEVERAL", most, raising=False)
    rng = random.Random(most)
    rows = [(rng.randrange(40), rng.choice("ab"), rng.choice([None, "", "x y z", "x", "w w w", "zz"]), rng.choice([None, False, False, True])) for _ in range(200)]
    rows += [(50, "a", "same text", False)] * 3 + [(51, "a", None, True), (51, "b", None, True)]
    taken = [r for r in rows if r[3] or (r[2] or "").strip()]
    first = [(i, "old", "x", False) for i in range(60)]
    ingest.apply(spark.createDataFrame(first, CHANGES), 0)
    ingest.apply(spark.createDataFrame(rows, CHANGES), 1)
    want = {i: ("old", md5("x")) for i in range(60)}
    for i in {r[0] for r in taken}:
        gone, _, text, source = max((bool(r[3]), r[2] is not None, r[2] or "", r[1]) for r in taken if r[0] == i)
        if gone:
            del want[i]
        elif md5(text) != md5("x"):
            want[i] = (source, md5(text))
    assert {r["doc_id"]: (r["source"], r["hash"]) for r in ingest.documents().collect()} == want
    assert {r["doc_id"] for r in ingest.chunks().collect()} == set(want) and ingest.chunks().where("doc_id = 50").count() == 1
