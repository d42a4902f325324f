from __future__ import annotations

import random
import struct
from collections import Counter

import xxhash

import corpus_pipeline
from barloom.llm.common import table
from barloom.llm.exact_dedup import exact_dedup

from .fixtures import AWKWARD, documents
from .test_line_dedup_all_pairs import gone_lines
from .test_quality import Plain
from .test_shingle_dedup import brute as components_of


def write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_awkward_rows_through_all_stages(spark, tmp_path):
    rows = [(*t, "en", "web") for t in AWKWARD]
    folder = write(spark, tmp_path, documents(spark, rows), [(4, 1, 0)])
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.collect())


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, documents(spark, []), [])).count() == 0


def test_stages_do_what_the_operators_say(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).persist()
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert len(set(kept["quality"])) == len(kept["quality"]) < len(texts)
    assert set(kept["line_dedup"]) <= set(kept["quality"])
    assert set(kept["simhash_dedup"]) < set(kept["line_dedup"])
    assert set(kept["mix_sources"]) <= set(kept["simhash_dedup"])
    # What is left has no two equal texts besides the copies that mixing made.
    same = exact_dedup(docs.dropDuplicates(["doc_id"])).where("group_size > 1 AND kept").count()
    assert same == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in tokens.collect()) == sorted(kept["mix_sources"])


def held_out(doc_id):
    return xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42) % 4 == 0


def brute(rows, trusted):
    """The documents after the first three stages, in plain Python."""
    good = [t for i, t, _ in rows if i in trusted and not held_out(i)]
    plain = Plain(good)
    allowance = {i: 1 + 4 / (len(t or "") + 1) ** 0.5 for i, t, _ in rows}
    limits = {}
    for i, t, lang in rows:
        if i in trusted and held_out(i):
            x = 1.3 * plain.perplexity(t) / allowance[i]
            limits[lang] = max(limits.get(lang, 0), x)
    overall = max(limits.values())
    kept = [(i, t) for i, t, lang in rows if plain.perplexity(t) <= limits.get(lang, overall) * allowance[i]]
    gone, lines = gone_lines(kept), []
    for i, t in kept:
        g = gone[i, t or ""]
        new = "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in g) if g else t
        if not g or new.strip():
            lines.append((i, new))
    part, _ = components_of([t for _, t in lines])
    stays = {}
    for k, (i, _) in enumerate(lines):
        stays[part[k]] = min(i, stays.get(part[k], i))
    return {"quality": kept, "line_dedup": lines, "simhash_dedup": [r for r in lines if r[0] in stays.values()]}


def test_first_three_stages_equal_plain_ones(spark, tmp_path):
    rng = random.Random(8)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)] for lang, letters in (("en", "aeiotnsrh"), ("de", "eiuscnhdg"))}
    rows = []

    def text(lang, n):
        return "\n".join(" ".join(rng.choice(words[lang]) for _ in range(12)) for _ in range(n))

    for i in range(90):
        lang = rng.choice(["en", "de"])
        kind = rng.random()
        old = rng.choice(rows)[1] if rows else None
        if kind < 0.1 and old:
            new = old
        elif kind < 0.2 and old:
            new = " ".join([*old.split(" "), "more"])
        elif kind < 0.3 and old:
            new = old.split("\n")[0] + "\r\n" + text(lang, 4)
        elif kind < 0.4:
            new = "".join(chr(rng.randint(33, 126)) for _ in range(200))
        else:
            new = text(lang, rng.randint(1, 8))
        rows.append((i, new, rng.choice([lang, lang, lang, None])))
    rows += [(90, "", "en"), (91, None, "en"), (92, "\n" * 5, "en")]
    trusted = [i for i, t, _ in rows if t and i % 2 and "\n" in t]
    folder = write(spark, tmp_path, documents(spark, rows), [(i, 1, 0) for i in trusted] + [(0, 1, 1), (2, 0, 0)])
    expected = brute(rows, set(trusted))
    assert len(rows) > len(expected["quality"]) > len(expected["line_dedup"]) > len(expected["simhash_dedup"])
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder).persist()
        assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == Counter(expected[name]), name


def test_blank_lines_that_are_left_go(spark):
    lines = ["a line that is long enough", "another line of that kind"]
    docs = documents(spark, [(1, "\n".join(lines)), (2, f"\n{lines[0]}\n\n{lines[1]}\n\n"), (3, "\n\n"), (4, None)])
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: "\n".join(lines), 3: "\n\n", 4: None}


def test_rows_of_one_id_with_different_texts_stay(spark):
    docs = documents(spark, [(1, "the first text of this id, about rivers and lakes"), (1, "some other words that share nothing with it at all")])
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 2
