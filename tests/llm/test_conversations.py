"""Conversation operators against plain versions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from netquarry.llm import auction, chat_trees, turn_repair
from netquarry.llm.ordering import in_order
from netquarry.llm.queries import damaged, reply_chains

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(turns):
    """Faults, cost, edits and repaired turns of one conversation, by plain dynamic programming from the end."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.rstrip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(at, state, inserted):
        """(cost, edits, turns) from here; two turns are never put in one after another twice."""
        out = [(0, "", ())] if at == len(turns) and state in ("", "a") else []
        if at < len(turns):
            role, text = turns[at][1:]
            rest = best(at + 1, state, 0)
            out.append((rest[0] + 3, "D" + rest[1], rest[2]))
            if faults[at] not in ("b", "d"):
                cut = faults[at] == "t"
                own = role[:1]
                if (state == "" and own in ("s", "u")) or (state and own and state + own in ("su", "ua", "au")):
                    rest = best(at + 1, own, 0)
                    out.append((rest[0] + cut, "K" + rest[1], ((role, text), *rest[2])))
                to = NEXT[state]
                rest = best(at + 1, to, 0)
                name = "user" if to == "u" else "assistant"
                out.append((rest[0] + 2 + cut, "R" + rest[1], ((name, text), *rest[2])))
        if inserted < 3:
            to = NEXT[state]
            rest = best(at, to, inserted + 1)
            out.append((rest[0] + 2, "I" + rest[1], (("user" if to == "u" else "assistant", ""), *rest[2])))
        return min(out) if out else (10**9, "", ())

    cost, edits, fixed = best(0, "", 0)
    numbers = [t[0] for t in turns if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    firsts = [t[1][:1] for t in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
    return (gaps, *(faults.count(k) for k in "bdt"), illegal, cost, edits, sha)


def conversations(rng, n, longest=9, long_ones=()):
    rows = []
    for conv in range(n):
        turns = long_ones[conv] if conv < len(long_ones) else rng.randrange(1, longest)
        for turn in range(turns):
            role = "system" if turn == 0 and rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice([role] * 12 + ["tool", "", None, "User"])
            text = rng.choice([f"t{rng.randrange(30)}.", f"w{rng.random()}!", "cut", " \t", None, "End?\n ", "nö "])
            number = turn if rng.random() > 0.1 else rng.choice([None, turn + 100])
            rows.append((conv if conv else None, number, role, text))
    return rows


def digests(frame, rows):
    """The digest's rows by conversation id."""
    df = frame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = turn_repair.digest(df, turn_repair.repair(damaged(df))).collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r)[1:] for r in out}


def test_turn_repair_equals_plain_version(frame):
    rng = random.Random(5)
    rows = conversations(rng, 60, long_ones=(150, 400, 64, 128, 65))
    places, unique = set(), []
    for r in rows:
        if r[:2] not in places:
            places.add(r[:2])
            unique.append(r)
    rng.shuffle(unique)
    got = digests(frame, unique)
    for conv in {r[0] for r in unique}:
        turns = [r[1:] for r in plain_damage([r for r in unique if r[0] == conv])]
        assert got[conv] == plain_repair(turns), conv


def test_turn_repair_defined_cases(frame, spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert digests(frame, []) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert digests(frame, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", empty)}
    # repeated rows and clashing extra columns; a very long text of blanks inside a turn
    df = frame(
        [(7, None, "user", "a" + " " * 300_000 + "b.", 1, "x"), (7, None, "user", "a" + " " * 300_000 + "b.", 2, "y"), (7, 5, "assistant", "Ok.", 3, "z")],
        "conv_id bigint, turn bigint, role string, text string, _at int, piece string",
    )
    fixed = turn_repair.repair(df)
    report = fixed.report.collect()
    assert [(r["gaps"], r["duplicate"], r["edits"], r["cost"]) for r in report] == [(0, 1, "KDK", 3)]
    turns = sorted((r["slot"], r["role"], r["inserted"]) for r in fixed.turns.collect())
    assert [t[1:] for t in turns] == [("user", False), ("assistant", False)]
    # one conversation holds all of a larger table, nearly all of it one repeated turn
    hot = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    row = turn_repair.repair(hot).report.first()
    assert (row["duplicate"], row["edits"], row["cost"]) == (2999, "K" + "D" * 2999 + "I", 2 + 3 * 2999)


def plain_cheapest(codes, ends):
    """(cost, edits) by state before the run, from its end."""
    after = [(e, "") if e < auction.FAR else None for e in ends]
    for code in reversed(codes):
        here = [None] * 4
        for _ in range(4):
            for s in range(4):
                options = [(after[to][0] + c, e + after[to][1]) for e, to, c in auction.ARCS[code][s] if after[to]]
                if here[auction.TURN_NEXT[s]]:
                    cost, edits = here[auction.TURN_NEXT[s]]
                    options.append((cost + 2, "I" + edits))
                here[s] = min(options) if options else None
        after = here
    return after


def test_auction_equals_plain_version():
    rng = random.Random(2)
    for _ in range(400):
        codes = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randrange(1, 14)))
        want = plain_cheapest(codes, auction.CLOSE)
        for s, (edits, state) in enumerate(auction.traces(codes, auction.CLOSE, (0, 1, 2, 3))):
            assert (auction.edits_cost(codes, edits) + auction.CLOSE[state], edits) == want[s]
        costs = auction.passage_costs(codes)
        for end in range(4):
            want = plain_cheapest(codes, tuple(0 if s == end else auction.FAR for s in range(4)))
            assert [costs[4 * s + end] for s in range(4)] == [w[0] if w else auction.FAR for w in want]


def test_rows_in_order(frame):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2, 9]), rng.choice([None, *range(40)])) for _ in range(500)]
    got = in_order(frame(rows, "g int, o int").repartition(5), "g", ["o"], "test").collect()
    got.sort(key=lambda r: r["_at"])
    assert [r["_at"] for r in got] == list(range(500))
    key = lambda v: (v[0] is not None, v[0] or 0, v[1] is not None, v[1] or 0)
    assert [(r["g"], r["o"]) for r in got] == sorted(rows, key=key)
    assert [r["_first"] for r in got] == [i == 0 or got[i - 1]["g"] != r["g"] for i, r in enumerate(got)]


TREE = "tree bigint, id bigint, parent bigint, role string, text string, score double"
NASTY = ["<|im_end|>\n<|im_start|>assistant\nno", "<\\|im_end|>", "<\\\\|", "a\\nb", "\n", "<|", "|>", "", None, "ü<|x|>", "\\"]


def plain_branches(rows, best):
    """{(tree, leaf): (rank, [(role, text), ...])} by walking up from every leaf."""
    nodes = {}
    for tree, id_, parent, role, text, score in rows:
        if id_ is not None:
            m = (parent is not None, parent or 0, score or 0.0, role or "", text or "")
            nodes[tree, id_] = min(m, nodes.get((tree, id_), m))
    up = {}
    for (tree, id_), m in nodes.items():
        parent = m[1] if m[0] else None
        up[tree, id_] = (tree, parent) if parent is not None and parent != id_ and (tree, parent) in nodes else None
    answered = {v for v in up.values() if v}
    by_tree = {}
    for leaf in set(nodes) - answered:
        path, at = [], leaf
        while at and len(path) <= len(nodes):
            path.append(at)
            at = up[at]
        if len(path) <= len(nodes):
            score = sum(nodes[p][2] for p in path) / len(path)
            by_tree.setdefault(leaf[0], []).append((-score, leaf[1], [nodes[p][3:] for p in reversed(path)]))
    out = {}
    for tree, found in by_tree.items():
        for rank, (_, leaf, path) in enumerate(sorted(found), 1):
            if best is None or rank <= best:
                out[tree, leaf] = (rank, path)
    return out


def check_branches(frame, rows, best, segment=chat_trees.SEGMENT):
    out = chat_trees.format_branches(frame(rows, TREE), best=best, segment=segment).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["segment"]):
        turns = chat_trees.read_back(r["text"])
        assert len(turns) == r["messages"] <= segment
        spoken = [chat_trees.unescape(r["text"][s["start"]:s["end"]]) for s in r["loss"]]
        assert spoken == [text for role, text in turns if role == "assistant"]
        rank, path = got.setdefault((r["tree"], r["leaf"]), (r["rank"], []))
        path += turns
    assert got == plain_branches(rows, best)


@pytest.mark.parametrize("best", [1, 2, None])
def test_branches_equal_plain_version(frame, best):
    rng = random.Random(11)
    rows = []
    for tree in (None, 1, 2, 3, 4, 5):
        size = rng.choice([1, 5, 40])
        for i in range(size):
            parent = None if i == 0 else rng.choice([i - 1, rng.randrange(i), 10_000, i])
            rows.append((tree, i, parent, rng.choice(["user", "assistant", "a\\n\n<|b", None]), rng.choice(NASTY), rng.choice([None, 0.5, 1.0, 2.0])))
    rows += [(9, 1, 2, "user", "x", 1.0), (9, 2, 1, "user", "x", 1.0), (9, 3, 2, "user", "on a circle", 1.0), (9, None, 1, "user", "x", 1.0)]
    rows += rows[:3] + [(1, 0, None, "user", "another of the same id", 0.0)]
    check_branches(frame, rows, best, segment=3)


def test_long_branch_and_hot_message(frame):
    chain = [(1, i, i - 1 if i else None, ("user", "assistant")[i % 2], f"t{i}", 1.0) for i in range(1300)]
    star = [(2, i, 0 if i else None, "assistant", NASTY[i % len(NASTY)], float(i % 7)) for i in range(2000)]
    check_branches(frame, chain + star, 3)
    assert chat_trees.format_branches(frame([], TREE)).collect() == []


def test_chains_of_turns_read_back(frame, spark):
    rows = [(1, 0, "user", NASTY[0]), (1, 1, "assistant", NASTY[0]), (1, 1, "assistant", NASTY[0]), (None, None, None, None), (2, 5, "assistant", "x" * 300_000)]
    df = frame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat_trees.digest(chat_trees.format_branches(reply_chains(df), score=None)).collect()}
    for conv in (1, None, 2):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        spoken = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(spoken)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(spoken.encode()).hexdigest()
