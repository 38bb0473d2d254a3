"""Repair of conversation structure: faults, cheapest edits, repaired turns.

A conversation should be empty or an optional system turn followed by pairs of
a user and an assistant turn. Its cheapest repair keeps, reroles, deletes and
inserts turns; ``auction`` finds it on a lattice of turns and pattern states.

Conversations of any length are handled in pieces of ``PIECE`` turns, cut by
the turns' number in the whole table. A piece that holds a whole conversation
is solved alone. Of longer conversations each piece first gives its costs from
each state to each state (spread over all tasks), a stream over a
conversation's pieces, last to first, turns those into prices at the pieces'
borders, each piece is traced from every state it may start in (spread again),
and a stream from first to last picks the traces that follow one another. Only
the streams, 1/PIECE of the rows and a few numbers each, pass one conversation
through one task.

Defined cases. Turns are read by turn number, null first; equal numbers by
role, then by a hash of the text, and equal rows stand side by side. Null
roles and texts count as empty, a null conversation id is a conversation like
any other. A role is judged by its first letter, s, u or a. Blank turns (no
character but ASCII space) and repeated ones (role and text seen earlier in
the conversation) must go; a turn is cut off if its last character that is not
an ASCII space isn't one of ``.!?``. Only the first of these three faults
counts. A conversation without turns has no row here; an empty table gives
empty tables; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from netquarry.llm import auction
from netquarry.llm.ordering import fold_runs, in_order
from netquarry.session import stage

PIECE_BITS = 6
PIECE = 1 << PIECE_BITS
LETTERS = "suao"
PAIRS = ("su", "ua", "au")
EDIT_ROWS = "array<struct<slot:int,at:bigint,role:string>>"
SOLVED = f"conv_id bigint, piece bigint, edits string, cost bigint, illegal bigint, turns {EDIT_ROWS}"


class Repair(NamedTuple):
    """``report``: a row per conversation with its faults, cost and edits; ``turns``: the repaired turns."""

    report: DataFrame
    turns: DataFrame


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in PAIRS for i in range(len(initials) - 1))


def _edited(base: int, codes: str, edits: str, entry: int) -> list[dict]:
    return [
        {"slot": slot, "at": None if place is None else base + place, "role": role}
        for slot, (place, role) in enumerate(auction.apply_edits(codes, edits, entry))
    ]


def _closed(edits: str, state: int) -> str:
    return edits + "I" * (auction.CLOSE[state] // auction.INSERT_COST)


def _solved(row: dict, edits: str, entry: int, illegal: int) -> tuple:
    turns = _edited(row["base"], row["codes"], edits, entry)
    return row["conv_id"], row["piece"], edits, auction.edits_cost(row["codes"], edits), illegal, turns


def _map_rows(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(row, known)`` for every row; ``known`` is a dictionary for what a task has solved already."""
    types = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        known = {}
        for batch in batches:
            out = [fn(row, known) for row in batch.to_pylist()]
            if len(known) > 100_000:
                known.clear()
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, r)) for r in out], schema=types)

    return rows.mapInArrow(run, schema)


def _solve_whole(row: dict, known: dict) -> tuple:
    """A piece that is a whole conversation; short ones are often alike."""
    codes = row["codes"]
    if codes not in known:
        edits, state = auction.traces(codes, auction.CLOSE, (auction.EMPTY,))[auction.EMPTY]
        known[codes] = _closed(edits, state)
    return _solved(row, known[codes], auction.EMPTY, _illegal(row["initials"]))


class _Prices:
    """From a conversation's last piece to its first: prices behind each piece."""

    def __init__(self, key):
        self.ends, self.last = auction.CLOSE, True

    def add(self, row):
        out = (row["conv_id"], row["piece"], row["base"], row["codes"], row["initials"], list(self.ends), self.last)
        costs = row["costs"]
        self.ends = tuple(
            min(auction.FAR, *(costs[4 * s + e] + self.ends[e] for e in range(4))) for s in range(4)
        )
        self.last = False
        return [out]

    def done(self):
        return None


class _Follow:
    """From a conversation's first piece to its last: the trace that begins where the one before ends."""

    def __init__(self, key):
        self.state, self.initial = auction.EMPTY, None

    def add(self, row):
        entry, edits, exit_state = self.state, row["edits"][self.state], row["exits"][self.state]
        border = 0 if self.initial is None else _illegal(self.initial + row["initials"][0])
        self.state, self.initial = exit_state, row["initials"][-1]
        if row["last"]:
            edits = _closed(edits, exit_state)
        return [_solved(row, edits, entry, _illegal(row["initials"]) + border)]

    def done(self):
        return None


def _trace_all(row: dict, known: dict) -> tuple:
    found = auction.traces(row["codes"], tuple(row["ends"]), (0, 1, 2, 3))
    edits = [f[0] if f else "" for f in found]
    exits = [f[1] if f else 0 for f in found]
    return row["conv_id"], row["piece"], row["base"], row["codes"], row["initials"], row["last"], edits, exits


def marked_turns(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The turns' texts by number (``_at``), and their marks: first fault, initial and lattice code."""
    own = rows.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    seen = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    initial = F.substring("role", 1, 1)
    flagged = own.select(
        "*", same.alias("same"), (F.length(seen) == 0).alias("blank"),
        (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.when(initial.isin(*LETTERS[:3]), initial).otherwise("o").alias("initial"),
    )
    ordered = in_order(flagged, "conv_id", ["turn", "role", "same"], "turns")
    # the first of equal turns, by its number: a join of single rows, whatever is repeated how often
    firsts = ordered.groupBy("conv_id", "same").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("new"))
    narrow = ordered.select("conv_id", "turn", "_at", "_first", "blank", "cut", "initial").join(firsts, "_at", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut"), "truncated")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial"))
    marks = stage(narrow.withColumn("fault", fault).withColumn("code", F.coalesce(code, "initial")), "turn-marks")
    return ordered.select("_at", "role", "text"), marks


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """Faults, cheapest edits and repaired turns of every conversation.

    ``report``: conv_id, gaps (numbers missing between the least and the
    greatest turn), blank, duplicate, truncated, illegal (neighbours that are
    not su, ua or au), cost, edits (K keep, R rerole, D delete, I insert, the
    least string among the cheapest). ``turns``: conv_id, piece, slot (the
    order within a conversation), role, text, inserted.
    """
    texts, marks = marked_turns(rows, conv_id, turn, role, text)
    pieces = marks.groupBy("conv_id", F.shiftright("_at", PIECE_BITS).alias("piece")).agg(
        F.min("_at").alias("base"), F.max("_first").alias("first"),
        F.array_sort(F.collect_list(F.struct("_at", "code", "initial"))).alias("own"),
    ).select(
        "conv_id", "piece", "base", F.array_join("own.code", "").alias("codes"), F.array_join("own.initial", "").alias("initials"),
        # a piece that begins a conversation and ends before its border holds all of it
        (F.col("first") & ((F.col("base") + F.size("own")) % PIECE != 0)).alias("whole"),
    )
    pieces = stage(pieces, "turn-pieces")
    alone = _map_rows(pieces.where("whole"), _solve_whole, SOLVED)
    parts = pieces.where("NOT whole")
    costs = _map_rows(
        parts, lambda r, known: (r["conv_id"], r["piece"], r["base"], r["codes"], r["initials"], auction.passage_costs(r["codes"])),
        "conv_id bigint, piece bigint, base bigint, codes string, initials string, costs array<bigint>",
    )
    priced = fold_runs(
        costs, ["conv_id"], [F.desc("piece")], _Prices,
        "conv_id bigint, piece bigint, base bigint, codes string, initials string, ends array<bigint>, last boolean",
    )
    traced = _map_rows(
        priced.repartition("conv_id", "piece"), _trace_all,
        "conv_id bigint, piece bigint, base bigint, codes string, initials string, last boolean, edits array<string>, exits array<int>",
    )
    solved = stage(alone.unionByName(fold_runs(traced, ["conv_id"], [F.asc("piece")], _Follow, SOLVED)), "turn-edits")

    by_turn = marks.groupBy("conv_id", "turn").agg(*[
        F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")
    ])
    faults = by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    edits = solved.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.array_sort(F.collect_list(F.struct("piece", "edits")))["edits"], "").alias("edits"),
    )
    report = faults.join(edits, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    slots = solved.select("conv_id", "piece", F.inline("turns")).withColumnRenamed("role", "new_role")
    kept = slots.where("at IS NOT NULL").join(texts, F.col("at") == F.col("_at"))
    turns = kept.select(
        "conv_id", "piece", "slot", F.coalesce("new_role", "role").alias("role"), "text", F.lit(False).alias("inserted")
    ).unionByName(slots.where("at IS NULL").select(
        "conv_id", "piece", "slot", F.col("new_role").alias("role"), F.lit("").alias("text"), F.lit(True).alias("inserted")
    ))
    return Repair(report, turns)


class TurnDigest:
    """SHA-256 of a conversation's turns, a line ``role:text`` each, joined by newlines."""

    def __init__(self, key):
        self.key, self.sha, self.any = key, hashlib.sha256(), False

    def add(self, row):
        line = f"{row['role']}:{row['text']}".encode()
        self.sha.update(b"\n" + line if self.any else line)
        self.any = True

    def done(self):
        return [(*self.key, self.sha.hexdigest())]


def digest(convs: DataFrame, fixed: Repair) -> DataFrame:
    """A row per id of ``convs`` (its column conv_id): the report, and the digest of the repaired turns."""
    sums = fold_runs(fixed.turns, ["conv_id"], [F.asc("piece"), F.asc("slot")], TurnDigest, "_conv2 bigint, sha string")
    ids = convs.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    report = fixed.report.withColumnRenamed("conv_id", "_conv")
    rows = ids.join(report, ids["conv_id"].eqNullSafe(F.col("_conv")), "left")
    rows = rows.join(sums, ids["conv_id"].eqNullSafe(F.col("_conv2")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select(
        ids["conv_id"], *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("edits", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
