"""Reply trees as conversations: branches, their rank, chat format and loss mask.

Every message names the message it answers. Self-joins double the reach of
each message's link upwards until all links stand at a root (as many rounds as
the binary digits of the longest branch), summing depth and score on the way.
The leaves are ranked by their branch's mean score, the chosen branches are
read off by joining the stored links back from the longest to the shortest,
and each becomes one conversation in a chat template.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Control
strings inside a text lose their meaning by a backslash after ``<``, one more
where there are some already, so the text can be read back; in roles backslash
and newline are escaped first. The loss mask covers the text of the trained
role, by code points of the formatted text.

A conversation is stored in segments of ``SEGMENT`` messages, so nothing holds
a conversation of any length at once; one within that length is one row.

Defined cases. Null texts and roles are empty, a null score is 0, a null tree
is a tree like any other, messages without an id take no part. Of several rows
with one id the least (parent, score, role, text) stands. A message whose
parent is null, itself or not in its tree is a root. Messages that hang on a
circle of replies have no root and are on no branch. Equal scores go by the
smaller leaf id. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.ordering import fold_runs
from netquarry.llm.textkit import small_batches
from netquarry.operators.common import top_rows
from netquarry.session import stage

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = 512
FORMATTED = "tree bigint, leaf bigint, rank int, branch_score double, segment bigint, messages int, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of every message of a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def _look_up(rows: DataFrame, on: str, messages: DataFrame, how: str) -> DataFrame:
    """Join rows with the messages that ``on`` names in the same tree (which may be null); drops the messages' keys."""
    keyed = messages.withColumnsRenamed({"tree": "_tree", "id": "_id"})
    both = rows.join(keyed, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col(on) == F.col("_id")), how)
    return both.drop("_tree", "_id")


def distinct_messages(messages: DataFrame, tree: str, id_col: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    own = messages.select(
        F.col(tree).cast("bigint").alias("tree"), F.col(id_col).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("parent"),
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("id IS NOT NULL")
    one = own.groupBy("tree", "id").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m"))
    return stage(one.select("tree", "id", "m.*"), "chat-messages")


def climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(branches, links): depth and score sum of all messages with a root, and the links of 1, 2, 4, ... steps.

    Each round joins the links that don't stand at a root yet with all links;
    a message that very many answer is a single row on the side it is looked up in.
    """
    nodes = messages.select("tree", "id", "score", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("up"))
    known = messages.select("tree", "id", F.lit(True).alias("there"))
    linked = _look_up(nodes.where("up IS NOT NULL"), "up", known, "left").withColumn("up", F.when(F.col("there"), F.col("up"))).drop("there")
    first = linked.unionByName(nodes.where("up IS NULL"))
    first = first.select("tree", "id", "up", F.col("score").alias("total"), F.lit(1).cast("bigint").alias("hops"))
    state = stage(first, "chat-links")
    links, most = [], state.count()
    while not (open_ := state.where("up IS NOT NULL")).isEmpty() and 1 << len(links) <= most:
        links.append(open_.select("tree", "id", "up"))
        on = state.select("tree", "id", F.col("up").alias("next"), F.col("total").alias("more"), F.col("hops").alias("further"))
        moved = _look_up(open_, "up", on, "inner").select(
            "tree", "id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("hops") + F.col("further")).alias("hops")
        )
        state = stage(state.where("up IS NULL").unionByName(moved), "chat-links")
    return state.where("up IS NULL").drop("up"), links


def choose(branches: DataFrame, links: list[DataFrame], best: int | None) -> DataFrame:
    """The leaves (tree, leaf, hops, branch_score, rank): the ``best`` of each tree by mean score, or all."""
    leaves = branches
    if links:
        answered = links[0].select("tree", F.col("up").alias("id")).distinct()
        leaves = _look_up(branches, "id", answered, "left_anti")
    scored = leaves.select("tree", F.col("id").alias("leaf"), "hops", (F.col("total") / F.col("hops")).alias("branch_score"))
    order = [F.desc("branch_score"), F.asc("leaf")]
    if best is None:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    return top_rows(scored, ["tree"], order, best, salted=True)


def paths(chosen: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(tree, leaf, rank, branch_score, id, place) of all messages on the chosen branches, place 0 at the root."""
    rows = chosen.withColumn("id", F.col("leaf")).withColumn("back", F.lit(0).cast("bigint"))
    for k in range(len(links) - 1, -1, -1):
        here = F.struct("id", "back")
        there = F.struct(F.col("up").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))
        rows = _look_up(rows, "id", links[k], "left").select("tree", "leaf", "hops", "rank", "branch_score", F.inline(both))
    return rows.select("tree", "leaf", "rank", "branch_score", "id", (F.col("hops") - 1 - F.col("back")).alias("place"))


def _format(row: dict, trained: str) -> dict:
    parts, loss, at = [], [], 0
    for m in row.pop("own"):
        head, text = f"{START}{escape_role(m['role'])}\n", escape(m["text"])
        if m["role"] == trained:
            loss.append({"start": at + len(head), "end": at + len(head) + len(text)})
        parts.append(f"{head}{text}{END}\n")
        at += len(parts[-1])
    return row | {"messages": len(parts), "text": "".join(parts), "loss": loss}


def format_branches(
    messages: DataFrame, tree: str = "tree", id_col: str = "id", parent: str = "parent", role: str = "role", text: str = "text",
    score: str | None = "score", best: int | None = 1, trained: str = "assistant", segment: int = SEGMENT,
) -> DataFrame:
    """The chosen branches as formatted conversations with their loss masks (see ``FORMATTED``)."""
    own = distinct_messages(messages, tree, id_col, parent, role, text, score)
    branches, links = climb(own)
    rows = paths(choose(branches, links, best), links)
    texts = own.select("tree", "id", "role", "text")
    keys = ("tree", "leaf", "rank", "branch_score", "segment")
    full = _look_up(rows, "id", texts, "inner").select(
        "tree", "leaf", "rank", "branch_score", F.floor(F.col("place") / segment).alias("segment"), F.struct("place", "role", "text").alias("m")
    )
    grouped = full.groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("own"))
    small_batches(grouped)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [_format(r, trained) for r in batch.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    types = pa.schema([
        ("tree", pa.int64()), ("leaf", pa.int64()), ("rank", pa.int32()), ("branch_score", pa.float64()), ("segment", pa.int64()),
        ("messages", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ])
    return grouped.mapInArrow(run, FORMATTED)


class ReadBack:
    """Digests of a conversation, read back from its segments in order."""

    def __init__(self, key):
        self.key, self.turns, self.loss = key, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, row):
        for role, text in read_back(row["text"]):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for span in row["loss"]:
            part = unescape(row["text"][span["start"] : span["end"]])
            self.loss.update(part.encode())
            self.loss_chars += len(part)
        self.chars += len(row["text"])

    def done(self):
        return [(self.key[0], self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)]


def digest(formatted: DataFrame) -> DataFrame:
    """A row per conversation with what its formatted text says, for trees with one chosen branch."""
    return fold_runs(
        formatted, ["tree", "leaf"], [F.asc("segment")], ReadBack,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
