from __future__ import annotations

from collections import Counter
from math import exp, log

import numpy as np
import pytest

from barloom.llm import quality as module
from barloom.llm.common import table
from barloom.llm.quality import ORDER, classify, quality_report, trusted_labels

from .fixtures import AWKWARD, documents


def chars(text):
    c = ["0" if "0" <= x <= "9" else x for x in " ".join((text or "").split())]
    return ["\1"] * (ORDER - 1) + c + ["\2"]


class Plain:
    """Interpolated modified Kneser-Ney over dictionaries, by the published formulas."""

    def __init__(self, texts):
        self.counts = {ORDER: Counter(tuple(c[i:i + ORDER]) for c in map(chars, texts) for i in range(len(c) - ORDER + 1))}
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.vocabulary = len(self.counts[1]) + 1
        self.context = {}
        for k in range(1, ORDER + 1):
            n = Counter(self.counts[k].values())
            n1, n2, n3, n4 = (n[i] for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            d = [min(max(x, 0.1), i + 0.9) for i, x in enumerate(d)]
            self.context[k] = (d, {}, {})
            for g, c in self.counts[k].items():
                total, left = self.context[k][1:]
                total[g[:-1]] = total.get(g[:-1], 0) + c
                left[g[:-1]] = left.get(g[:-1], 0) + d[min(c, 3) - 1]

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / self.vocabulary
        d, total, left = self.context[k]
        if g[:-1] not in total:
            return self.p(g[1:])
        c = self.counts[k].get(g, 0)
        return (max(0, c - d[min(c, 3) - 1]) * (c > 0) + left[g[:-1]] * self.p(g[1:])) / total[g[:-1]]

    def perplexity(self, text):
        c = chars(text)
        logs = [log(self.p(tuple(c[i:i + ORDER]))) for i in range(len(c) - ORDER + 1)]
        return exp(-sum(logs) / len(logs))


TEXTS = [(1, "the cat sat on the mat", "en"), (2, "the dog sat on the log 12", "en"), (3, "der hund sass auf der matte", "de"), (4, "die katze  sass\nauf dem 99", "de"), (5, "xq zv kkk jjj", "en"), (6, "the mat", None)]


@pytest.mark.parametrize("most", [0, module.MAX_BROADCAST])
def test_perplexities(spark, most):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "doc_id long")
    plain = Plain([t for i, t, _ in TEXTS if i <= 4])
    got = {r["row"]["doc_id"]: r for r in classify(documents(spark, TEXTS), ids, max_broadcast=most, hold_out=0).collect()}
    for i, text, _ in TEXTS:
        assert got[i]["perplexity"] == pytest.approx(plain.perplexity(text), rel=1e-5)
    assert [got[i]["trusted"] for i in range(1, 7)] == [True] * 4 + [False] * 2
    assert not got[5]["kept"] and got[6]["threshold"] is not None
    allowed = [1 + 4 / (len(t) + 1) ** 0.5 for _, t, _ in TEXTS]
    limit = 1.3 * max(plain.perplexity(TEXTS[i][1]) / allowed[i] for i in (0, 1))
    assert got[1]["threshold"] == pytest.approx(limit * allowed[0], rel=1e-5)
    assert got[5]["threshold"] == pytest.approx(limit * allowed[4], rel=1e-5)


def test_sums_to_one():
    plain = Plain([t for _, t, _ in TEXTS])
    every = {g[-1] for g in plain.counts[1]}
    assert sum(plain.p((*"the ", c)) for c in every) + plain.p((*"the ", "?")) == pytest.approx(1)


@pytest.mark.parametrize("most", [0, module.MAX_BROADCAST])
def test_awkward_rows(spark, most):
    rows = [(*t, "en", "web") for t in AWKWARD]
    ids = spark.createDataFrame([(4,), (7,), (99,)], "doc_id long")
    got = classify(documents(spark, rows), ids, max_broadcast=most).collect()
    assert len(got) == len(rows)
    assert all(np.isfinite(r["perplexity"]) for r in got)


def test_nobody_trusted_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] and r["threshold"] is None for r in quality_report(documents(spark, AWKWARD), none).collect())
    assert quality_report(documents(spark, []), none).count() == 0
    assert quality_report(documents(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_keeps_good_documents(spark):
    """Labelled documents that training never saw: of the good ones nearly all stay, of the bad ones most go."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = classify(docs.select("doc_id", "text", "lang"), trusted_labels(labels.where("doc_id % 2 = 0"))).select("row.doc_id", "kept").collect()
    good = [r["kept"] for r in got if known.get(r["doc_id"]) == 1 and r["doc_id"] % 2]
    bad = [r["kept"] for r in got if known.get(r["doc_id"]) == 0]
    assert np.mean(good) >= 0.995
    assert np.mean(bad) <= 0.25
