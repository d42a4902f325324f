from __future__ import annotations

import binascii

from collections import Counter
from math import exp, log

import numpy as np
import pytest

from barloom.llm import langid as module
from barloom.llm.common import table
from barloom.llm.langid import features, identify, language_report, train

from .fixtures import AWKWARD, LONG, documents


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in language_report(docs).collect()}
    right = known = 0
    for d in docs.select("doc_id", "lang", "text").collect():
        r = got.pop(d["doc_id"])
        assert r["held_out"] == (binascii.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if d["text"] is None or not any(c.isalpha() for c in d["text"]):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and d["lang"] is not None:
            known += 1
            right += r["lang_pred"] == d["lang"]
    assert not got
    assert right >= 0.97 * known


def test_counts_equal_plain_counts(spark):
    texts = [(0, "aba ab", "x"), (1, "Ab!", "x"), (3, "cdc", "y"), (4, "zzz", None), (5, None, "y")]
    (names, logp), = train(documents(spark, texts))
    assert names == ["x", "y"]
    n = np.full((logp.shape[0], 2), 0.5)
    for _, text, lang in texts[:3]:
        np.add.at(n[:, names.index(lang)], features(text), 1)
    assert np.allclose(logp, np.log(n / n.sum(axis=0)), atol=1e-5)


def test_hides_language_of_held_out_rows(spark):
    texts = [(i, t, "en" if binascii.crc32(str(i).encode()) % 4 != 2 else "wrong") for i, t in enumerate(["some words here"] * 40)]
    assert {r["lang_pred"] for r in language_report(documents(spark, texts)).collect()} == {"en"}


def test_awkward_rows(spark):
    texts = [(*t, "en", "web") for t in AWKWARD]
    got = language_report(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    assert {r["lang_pred"] for r in got} == {"en", "und"}
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 10)] == ["und"] * 4


def test_nothing_to_learn_and_empty_table(spark):
    assert {r["lang_pred"] for r in language_report(documents(spark, AWKWARD)).collect()} == {"und"}
    assert language_report(documents(spark, [])).count() == 0


def test_keeps_columns(spark):
    model = train(documents(spark, [(0, "abc", "x")]))
    assert identify(documents(spark, [(0, "abc", "x")]), model).first()["row"]["key"] == "k"


def brute(learned, texts):
    """Multinomial naive Bayes over dictionaries, with the buckets of ``features``."""
    counts = {}
    for lang, text in learned:
        counts.setdefault(lang, Counter()).update(features(text).tolist())
    for text in texts:
        f = features(text).tolist() if text else []
        if not f or not counts:
            yield "und", 0.0
            continue
        ll = {}
        for lang in sorted(counts):
            all_ = sum(counts[lang].values()) + 0.5 * module.BUCKETS
            ll[lang] = sum(log((counts[lang][b] + 0.5) / all_) for b in f)
        best = max(ll, key=lambda x: (ll[x], [-ord(c) for c in x]))
        yield best, 1 / sum(exp(x - ll[best]) for x in ll.values())


@pytest.mark.parametrize("languages,chunk", [(128, 1 << 21), (2, 1 << 21), (1, 64), (128, 50)])
def test_predictions_equal_plain_ones(spark, monkeypatch, languages, chunk):
    monkeypatch.setattr(module, "LANGUAGES", languages)
    monkeypatch.setattr(module, "CHUNK", chunk)
    learned = [("en", "the cat sat"), ("de", "der hund sass"), ("fr", "le chat est la"), ("nl", "de hond zat"), ("en", "on the mat"), ("zz", "12 34")]
    model = train(documents(spark, [(i, t, l) for i, (l, t) in enumerate(learned)]))
    texts = ["the dog", "der kater", "la", "hond", None, "", "?!", "the der le de", "q", LONG[:5000] + "der hund", "the dog"]
    got = identify(documents(spark, list(enumerate(texts))), model).collect()
    got = sorted((r["row"]["doc_id"], r["lang_pred"], r["score"]) for r in got)
    for (i, lang, score), (want, p) in zip(got, brute(learned, texts)):
        assert lang == want and score == pytest.approx(p, abs=1e-3), i
