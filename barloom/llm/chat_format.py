"""Conversations for training: reply trees, their best branches, and text with a loss mask."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, join_counted, stash

#: Messages that over 1/HOT of all rows point to are joined by broadcast: there are at most HOT.
HOT = 1000
#: The template: a turn is HEAD, the role, MID, the text, END.
HEAD, MID, END = "<turn>", "\n", "</turn>\n"
#: What cannot stand inside a text or a role, each with its escape; the sign of escapes comes first.
IN_TEXT = (("~", "~0"), ("<turn>", "~1"), ("</turn>", "~2"))
IN_ROLE = (*IN_TEXT, ("\n", "~3"))


def escaped(text: Column, table: tuple = IN_TEXT) -> Column:
    """``text`` without control strings; ``unescaped`` reverses it."""
    for plain, sign in table:
        text = F.replace(text, F.lit(plain), F.lit(sign))
    return text


def unescaped(text: str, table: tuple = IN_TEXT) -> str:
    for plain, sign in reversed(table):
        text = text.replace(sign, plain)
    return text


def chain(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages (conv, id, parent, role, text, score) of rows in order: each replies to the one before.

    Rows of one turn stand in the order of role and text; a null turn comes first.
    """
    order = Window.partitionBy(conv_col).orderBy(*(F.asc_nulls_first(c) for c in (turn_col, role_col, text_col)))
    at = F.row_number().over(order).cast("long")
    return rows.select(F.col(conv_col).alias("conv"), at.alias("id"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).select(
        "conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _links(messages: DataFrame) -> DataFrame:
    """(node, up): each message with the one it replies to, null where there is none."""
    conv = ["none", "conv"]
    heads = messages.groupBy(*conv, F.col("id").alias("parent")).agg(F.min(F.struct((-F.col("score")).alias("s"), "hash", "node")).alias("first"))
    replies = messages.where("parent IS NOT NULL").select(*conv, "parent", "node")
    counts = replies.groupBy(*conv, "parent").agg(F.count("*").alias("n")).join(heads.select(*conv, "parent", F.col("first.node").alias("up")), [*conv, "parent"])
    return messages.select("node").join(join_counted(replies, stash(counts), [*conv, "parent"], "n", HOT).select("node", "up"), "node", "left")


def _climb(messages: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Links without cycles, (node, total, depth) of the way from each message to its root, and the jumps.

    jumps[k] has (node, up) where the message 2 ** k above is ``up``.  Each round
    joins the table with itself, which doubles the distance, so the number of
    rounds is the logarithm of the longest branch.  ``low`` is the smallest
    message above: where it is the message itself this is on a cycle, and as the
    smallest of it becomes a root.
    """
    links = stash(_links(messages))
    while True:
        way = stash(messages.select("node", F.col("score").alias("total"), F.lit(1).alias("depth")).join(links, "node").withColumn("low", F.col("up")))
        jumps: list[DataFrame] = []
        while True:
            rising, around = way.agg(F.count("up"), F.count(F.when(F.col("low") == F.col("node"), 1))).first()
            if around or not rising:
                break
            jumps.append(way.where("up IS NOT NULL").select("node", "up"))
            to = way.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("further"), F.col("low").alias("lower"))
            met = join_counted(way.where("up IS NOT NULL"), stash(jumps[-1].groupBy("up").agg(F.count("*").alias("n"))).join(to, "up"), ["up"], "n", HOT)
            way = stash(met.select("node", (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("further")).alias("depth"),
                                   F.col("next").alias("up"), F.least("low", "lower").alias("low")).unionByName(way.where("up IS NULL")))
        if not around:
            return links, way.select("node", "total", "depth"), jumps
        roots = way.where("low = node").select("node", F.lit(True).alias("root"))
        links = stash(links.join(roots, "node", "left").select("node", F.when(F.col("root").isNull(), F.col("up")).alias("up")))


def reply_branches(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, branch, score, depth, place, role, text): the best root-to-leaf paths of every reply tree, a row for each message.

    ``messages`` has conv, id, parent, role, text and score.  Iterated self-joins
    with doubled distance give the sum of scores on the way from each leaf to its
    root; a branch's score is the mean, and the ``branches`` highest of a
    conversation stay (ties: the longer one, then the smaller id of the leaf,
    then a hash of its role and text), numbered from 1.  Only these are then
    enumerated message by message, by the same jumps.  Place counts from 1 at the root.

    Null texts and roles are empty, a null score is zero, rows with a null conv
    are one conversation.  A message whose parent is null or unknown is a root.  Of several messages of one id the
    one of highest score (then by a hash of role and text) gets the replies, the
    others end branches of their own.  A cycle of replies is cut at one message.
    An empty table gives an empty result.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    numbered = stash(messages.select(
        F.col("conv").isNull().alias("none"), F.coalesce(F.col("conv").cast("long"), F.lit(0)).alias("conv"), "id", "parent", role.alias("role"), text.alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.xxhash64(role, text).alias("hash")).withColumn("node", F.monotonically_increasing_id()))
    links, way, jumps = _climb(numbered)
    leaves = numbered.select("none", "conv", "id", "hash", "node").join(links.select(F.col("up").alias("node")).distinct(), "node", "left_anti").join(way, "node")
    best = Window.partitionBy("none", "conv").orderBy(F.desc("score"), F.desc("depth"), F.asc_nulls_last("id"), "hash", "node")
    chosen = stash(leaves.withColumn("score", F.col("total") / F.col("depth")).withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches).select(
        "none", "conv", "branch", "score", "depth", "node", F.col("depth").alias("place")))
    for k, jump in reversed(list(enumerate(jumps))):
        # The longest jumps come first: a path has one message in 2 ** (k + 1) so far, and each brings the one 2 ** k above.
        step = F.array(F.struct("node", "place"), F.struct(F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place")))
        chosen = chosen.join(jump, "node", "left").select("none", "conv", "branch", "score", "depth", F.explode(F.filter(step, lambda x: x["node"].isNotNull())).alias("x")).select(
            "none", "conv", "branch", "score", "depth", "x.node", "x.place")
    return chosen.join(numbered.select("node", "role", "text"), "node").select(
        F.when(~F.col("none"), F.col("conv")).alias("conv"), "branch", "score", "depth", "place", "role", "text")


def format_branches(paths: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, branch, score, n_turns, formatted, loss_spans): each branch as one text with the spans that count for the loss.

    A span (start, end) holds the text of one turn of a role in ``loss_roles``, in
    code points of ``formatted``.  A conversation is one row, so its text is
    built in one task; places come from a running sum, not from the text.
    """
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), IN_ROLE), F.lit(MID))
    pieces = paths.select("conv", "branch", "score", "place", F.col("role").isin(*loss_roles).alias("counts"), head.alias("head"), escaped(F.col("text")).alias("body"))
    size = (F.length("head") + F.length("body") + len(END)).cast("long")
    so_far = Window.partitionBy("conv", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("end", F.sum(size).over(so_far) - len(END)).select(
        "conv", "branch", "score", "place", F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(F.col("counts"), F.struct((F.col("end") - F.length("body")).alias("start"), "end")).alias("span"))
    turns = F.array_sort(F.collect_list(F.struct("place", "piece", "span")))
    return placed.groupBy("conv", "branch").agg(F.first("score").alias("score"), turns.alias("turns")).select(
        "conv", "branch", "score", F.size("turns").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.span", lambda x: x.isNotNull()).alias("loss_spans"))


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    turns = (piece.removeprefix(HEAD).partition(MID) for piece in formatted.split(END)[:-1])
    return [(unescaped(role, IN_ROLE), unescaped(text)) for role, _, text in turns]


def chat_format(messages: DataFrame, branches: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The best branches of the reply trees in ``messages`` (``reply_branches``) as text (``format_branches``)."""
    return format_branches(reply_branches(messages, branches), loss_roles)


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as the formatted text and its spans say."""
    from hashlib import sha256

    bounded_batches(chats.sparkSession)
    digest = lambda x: sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["formatted"], batch["loss_spans"]):
                turns = parsed(text)
                loss = "".join(unescaped(text[s["start"]:s["end"]]) for s in spans)
                out.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            yield pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).assign(
                id=batch["id"], none=batch["none"], branch=batch["branch"])
        give_back()

    known = chats.select(F.coalesce("conv", F.lit(0)).alias("id"), F.col("conv").isNull().alias("none"), "branch", "formatted", "loss_spans")
    return known.mapInPandas(run, "id long, none boolean, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").select(
        F.when(~F.col("none"), F.col("id")).alias("conv_id"), "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def chat_report(conversations: DataFrame) -> DataFrame:
    """Read-back of all conversations, rows by turn, and of one whose texts hold control strings."""
    spark = conversations.sparkSession
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    return read_back(chat_format(chain(rows))).drop("branch")
