from __future__ import annotations

import random
import re

import pytest
import xxhash

from barloom.llm import simhash as module
from barloom.llm.common import table
from barloom.llm.simhash import simhash_dedup

from .fixtures import AWKWARD, components, documents, pairs, rows

COLUMNS = ("doc_id", "fingerprint", "component_id")


def simhash(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(texts):
    fps = [simhash(t) for _, t in texts]
    by_fp = {}
    for (i, _), f in zip(texts, fps):
        by_fp.setdefault(f, []).append(i)
    links = [(a, b) for a, b in pairs(sorted(by_fp)) if (a ^ b).bit_count() <= 3]
    part = components(by_fp, links)
    low = {}
    for f, ids in by_fp.items():
        known = [i for i in ids if i is not None]
        if known:
            low[part[f]] = min([*known, *([low[part[f]]] if part[f] in low else [])])
    return sorted([(i, f"{f:016x}", low.get(part[f])) for (i, _), f in zip(texts, fps)], key=repr)


def test_awkward_rows(spark):
    assert rows(simhash_dedup(documents(spark, AWKWARD)), *COLUMNS) == brute(AWKWARD)


@pytest.mark.parametrize("block", [3, 2048])
def test_chains_of_close_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    texts, n = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(25):
            base[rng.randrange(400)] = rng.choice(words)
            texts.append((n := n + 1, " ".join(base)))
    expected = brute(texts)
    assert len({r[2] for r in expected}) < len(texts)
    assert rows(simhash_dedup(documents(spark, texts)), *COLUMNS) == expected


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(simhash_dedup(docs), *COLUMNS) == brute(texts)


def test_empty_table(spark):
    assert simhash_dedup(documents(spark, [])).count() == 0
