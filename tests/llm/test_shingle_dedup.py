from __future__ import annotations

import random
import re

import corpus_pipeline
from barloom.llm import shingle_dedup as module
from barloom.llm.common import bucket_blocks as blocks
from barloom.llm.common import table

from .fixtures import AWKWARD, components, documents


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    """The texts' components by all pairs of similarity >= 0.8."""
    sets = [shingle_set(t) for t in texts]
    by_shingle, links = {}, []
    for i, s in enumerate(sets):
        near = {}
        for x in s or [None]:
            for j in by_shingle.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            by_shingle[x].append(i)
        links += [(j, i) for j, n in near.items() if not s or 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
    return components(range(len(texts)), links), links


def kept(spark, docs):
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]


def one_of_each(texts, got):
    part, _ = brute([t for _, t in texts])
    place = {}
    for i, row in enumerate(texts):
        place.setdefault(row, part[i])
    assert sorted(place[r] for r in got) == sorted(set(part.values()))
    for row in got:
        ids = [i for (i, _), p in zip(texts, (part[j] for j in range(len(texts)))) if p == place[row] and i is not None]
        assert row[0] == (min(ids) if ids else None)


def test_similar_texts_beyond_three_bits(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(8):
            base[rng.randrange(300)] = rng.choice(words)
            base[rng.randrange(300)] = rng.choice(words)
            texts.append((len(texts), " ".join(base)))
    assert 0 < len(kept(spark, documents(spark, texts))) < len(texts) / 2
    one_of_each(texts, kept(spark, documents(spark, texts)))


def test_null_and_repeated_ids_keep_their_texts(spark):
    texts = [(None, "a text without an id"), (None, "another text that has no id"), (None, "a text without an id"), (5, "one text of id five"), (5, "some other words of that id"), (5, "one text of id five"), *AWKWARD]
    got = kept(spark, documents(spark, texts))
    assert len([r for r in got if r[0] is None]) >= 2
    one_of_each(texts, got)


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one_of_each([tuple(r) for r in docs.select("doc_id", "text").collect()], kept(spark, docs))


def test_simhash_proposes_too(spark, monkeypatch):
    rows = [(1, 0b1011), (2, 0b1000), (3, 0b1011), (4, -1), (5, -1 << 2), (6, 0x0F0F0F0F)]
    groups = {}
    for r in module.simhash_groups(spark.createDataFrame(rows, "s long, fp long")).collect():
        groups.setdefault(r["group"], set()).add(r["s"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5], [6]]
    # Without bands that pairs can share, what SimHash links is compared and found.
    monkeypatch.setattr(module, "bucket_blocks", lambda filed, *rest: blocks(filed.where(f"key % {module.TABLES} = 0"), *rest))
    words = [f"word{i}" for i in range(400)]
    texts = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(reversed(words)))]
    assert sorted(i for i, _ in kept(spark, documents(spark, texts))) == [1, 3]
