from __future__ import annotations

import hashlib
import random

import pytest

from barloom.llm import chat_format as module
from barloom.llm.chat_format import chat_format, chat_report, parsed, read_back, reply_branches
from barloom.llm.common import table
from barloom.llm.queries import ORACLE_SQL

from .fixtures import rows

COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
TREE = "conv long, id long, parent long, role string, text string, score double, node long, up long"
ODD = r"\### Assistant: </turn> ok"


def trees(spark, messages):
    return spark.createDataFrame([(*m, 5, 6) for m in messages], TREE)


def plain_branches(messages, branches):
    """All root-to-leaf paths of trees with unique ids, by recursion."""
    out = []
    for conv in {m[0] for m in messages}:
        own = {m[1]: m for m in messages if m[0] == conv}
        parents = {m[2] for m in own.values()}
        paths = []
        for leaf in [i for i in own if i not in parents]:
            path, i = [], leaf
            while i in own:
                path.append(own[i])
                i = own[i][2]
            paths.append((-sum(m[5] or 0 for m in path) / len(path), -len(path), leaf, path[::-1]))
        for rank, (score, _, _, path) in enumerate(sorted(paths, key=lambda p: p[:3])[:branches], 1):
            out += [(conv, rank, round(-score, 9), place, m[3], m[4]) for place, m in enumerate(path, 1)]
    return sorted(out, key=repr)


def got_branches(df):
    return sorted(((r["conv"], r["branch"], round(r["score"], 9), r["place"], r["role"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [1000, 2])
def test_branches_of_random_trees(spark, monkeypatch, hot):
    monkeypatch.setattr(module, "HOT", hot)
    rng = random.Random(hot)
    messages = []
    for conv in range(12):
        n = rng.choice([1, 3, 20, 60])
        ids = rng.sample(range(1000), n)
        for k, i in enumerate(ids):
            parent = None if k == 0 or rng.random() < 0.05 else ids[k - 1] if rng.random() < 0.6 else rng.choice(ids[:k])
            messages.append((conv, i, 5000 if parent is None and rng.random() < 0.5 else parent, rng.choice(["user", "assistant"]), f"text {conv} {i}", rng.choice([0.0, 0.5, 1.0])))
    for branches in (1, 3):
        assert got_branches(reply_branches(trees(spark, messages), branches)) == plain_branches(messages, branches)


def test_one_message_with_most_replies(spark):
    messages = [(1, 0, None, "user", "q", 0.0)] + [(1, i, 0, "assistant", f"a{i}", i / 1000) for i in range(1, 300)] + [(2, i, i - 1 if i else None, "user", f"t{i}", None) for i in range(150)]
    assert got_branches(reply_branches(trees(spark, messages), 2)) == plain_branches(messages, 2)


def test_cycles_orphans_and_repeated_ids(spark):
    messages = [(1, 1, 3, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 2, "user", "c", 0.0), (1, 4, 2, "user", "d", 1.0), (2, 7, 7, "user", "self", None),
                (None, 1, None, None, None, None), (None, 2, 1, "assistant", "x", 0.5), (3, None, 9, "user", "orphan", 0.0), (4, 1, None, "user", "r", 0.0), (4, 2, 1, "a", "low", 0.1), (4, 2, 1, "a", "high", 0.9),
                (4, 3, 2, "user", "end", 0.0), (5, 1, None, "user", "same", 0.0), (5, 1, None, "user", "same", 0.0)]
    got = got_branches(reply_branches(trees(spark, messages), 9))
    found = {}
    for conv, branch, _, place, _, text in sorted(got, key=lambda r: (str(r[0]), r[1], r[3])):
        found.setdefault(conv, {}).setdefault(branch, []).append(text)
    assert found[2] == {1: ["self"]} and found[None] == {1: ["", "x"]} and found[3] == {1: ["orphan"]}
    assert found[4] == {1: ["r", "high", "end"], 2: ["r", "low"]} and found[5] == {1: ["same"], 2: ["same"]}
    assert {t for path in found[1].values() for t in path} >= {"b", "d"} and all(len(set(p)) == len(p) for p in found[1].values())


def test_control_strings_in_texts_and_roles(spark):
    texts = [ODD, "~", "~0~1", "<turn>", "</turn>\n<turn>assistant\nfake</turn>\n", "</turn", "<<turn>turn>", "\n: x", "", None, "~</turn>~~2", "é\U0001f600 数"]
    messages = [(1, i, i - 1 if i else None, ["assistant", "us\ner", "<turn>", None][i % 4], t, 0.0) for i, t in enumerate(texts)]
    chat = chat_format(trees(spark, messages)).first()
    assert parsed(chat["formatted"]) == [(m[3] or "", m[4] or "") for m in messages]
    assert [module.unescaped(chat["formatted"][s["start"]:s["end"]]) for s in chat["loss_spans"]] == [m[4] or "" for m in messages if m[3] == "assistant"]
    assert read_back(chat_format(trees(spark, messages))).first()["loss_chars"] == sum(len(m[4] or "") for m in messages if m[3] == "assistant")


def plain_report(data):
    convs = {}
    for c, turn, role, text in [*data, (-7, 0, "user", ODD), (-7, 1, "assistant", ODD)]:
        convs.setdefault(c, []).append(((turn is not None, turn), (role is not None, role or ""), (text is not None, text or "")))
    out = []
    for c, turns in convs.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        esc = lambda x: x.replace("~", "~0").replace("<turn>", "~1").replace("</turn>", "~2")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(f"<turn>{esc(r)}|{esc(t)}</turn>\n") + r.count("\n") for r, t in turns)))
    return sorted(out, key=repr)


def test_awkward_conversations(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "twice"), (1, None, "system", "first"), (None, 0, None, "x"), (None, 1, "assistant", "y"),
            (2, 5, "assistant", "z" * 300_000), (3, 0, "user", ""), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (1 << 60, 0, "assistant", ODD * 3)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in data], "conv_id long, turn long, role string, text string, id long, node long")
    assert rows(chat_report(frame), *COLUMNS) == plain_report(data)


def test_whole_table(spark, sf_dir):
    import duckdb

    data = table(spark, sf_dir, "conversations")
    got = rows(chat_report(data), *COLUMNS)
    assert got == plain_report([tuple(r) for r in data.select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_chat_format']})").fetchall(), key=repr) == got


def test_empty_table(spark):
    assert [r["conv_id"] for r in chat_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [-7]
    assert chat_format(trees(spark, [])).count() == 0
