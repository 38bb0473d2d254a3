"""Shortest edit paths of a run of turns by the auction algorithm.

Lattice nodes are (turns read, state of the role pattern): nothing yet, after
a system turn, after a user turn, after an assistant turn. Arcs are edits with
whole costs. The auction (Bertsekas, 1991) keeps a price on every node, never
above arc cost plus the price at the arc's end, and one path whose arcs are all
tight. The path's last node either raises its price and is left (contraction)
or is extended along a tight arc. When the path arrives, prices along all
cheapest paths are exact, so every cheapest path is made of tight arcs.

A turn is one character: ``s``, ``u``, ``a`` by its role's initial, ``o`` for
any other, in upper case if it ends in mid-sentence, ``x`` if it must go.
"""

from __future__ import annotations

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant turn put in leads to.
TURN_NEXT = (USER, USER, ASSISTANT, USER)
#: What keeping a role's turn leads to, by state.
KEEP = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 0, 2, 3, 2, 1
FAR = 1 << 40
#: Cost of closing a conversation by state: nothing, a pair, an answer, nothing.
CLOSE = (0, 2 * INSERT_COST, INSERT_COST, 0)


def _row_arcs(code: str) -> list[list[tuple[str, int, int]]]:
    """Arcs over one turn by state: (edit, next state, cost), in ASCII order of the edits."""
    out = []
    for state in range(4):
        arcs = [("D", state, DELETE_COST)]
        if code != "x":
            cut = CUT_COST if code.isupper() else 0
            if state in KEEP[code.lower()]:
                arcs.append(("K", KEEP[code.lower()][state], KEEP_COST + cut))
            arcs.append(("R", TURN_NEXT[state], REROLE_COST + cut))
        out.append(arcs)
    return out


ARCS = {code: _row_arcs(code) for code in "suaoSUAOx"}
#: The least any edit of a turn can cost.
LEAST = {code: min(cost for arcs in ARCS[code] for _, _, cost in arcs) for code in ARCS}


class Lattice:
    """One run of turns, with the costs to go after its last turn by state (``FAR``: no way)."""

    def __init__(self, codes: str, ends: tuple[int, ...]):
        self.codes, self.ends = codes, ends
        # Sums of least costs are feasible prices and lie close below the true ones.
        self.price = [[0] * 4 for _ in codes] + [list(ends)]
        floor = min(ends)
        for at in range(len(codes) - 1, -1, -1):
            floor += LEAST[codes[at]]
            self.price[at] = [floor] * 4
        self._bar_dead_ends()

    def arcs(self, at: int, state: int):
        """(edit, turns read, state, cost) of all arcs out of a node, in ASCII order of the edits."""
        rows = [(edit, at + 1, to, cost) for edit, to, cost in ARCS[self.codes[at]][state]]
        return [rows[0], ("I", at, TURN_NEXT[state], INSERT_COST), *rows[1:]]

    def _bar_dead_ends(self) -> None:
        """Nodes without a way to the end get the price ``FAR``."""
        alive = {s for s in range(4) if self.ends[s] < FAR}
        for at in range(len(self.codes) - 1, -1, -1):
            here = {s for s in range(4) if any(to in alive for _, to, _ in ARCS[self.codes[at]][s])}
            while grown := {s for s in range(4) if s not in here and TURN_NEXT[s] in here}:
                here |= grown
            for s in range(4):
                if s not in here:
                    self.price[at][s] = FAR
            alive = here

    def auction(self, entry: int) -> int:
        """The cheapest way's cost from a state before the first turn; prices stay for the next call."""
        price, last = self.price, len(self.codes)
        path = [(0, entry)]
        while True:
            at, state = path[-1]
            if at == last or price[at][state] >= FAR:
                return price[0][entry]
            best, goal = FAR, None
            for _, to_at, to, cost in self.arcs(at, state):
                if cost + price[to_at][to] < best:
                    best, goal = cost + price[to_at][to], (to_at, to)
            if price[at][state] < best:  # contraction
                price[at][state] = best
                if len(path) > 1:
                    path.pop()
            else:  # extension along a tight arc
                path.append(goal)

    def tight(self) -> list[set[int]]:
        """By turns read, the states from which tight arcs lead to the end."""
        price = self.price
        reach = [set() for _ in self.codes] + [{s for s in range(4) if self.ends[s] < FAR}]
        for at in range(len(self.codes) - 1, -1, -1):
            here = reach[at]
            grown = True
            while grown:
                grown = False
                for s in range(4):
                    if s not in here and price[at][s] < FAR and any(
                        to in reach[to_at] and price[at][s] == cost + price[to_at][to] for _, to_at, to, cost in self.arcs(at, s)
                    ):
                        here.add(s)
                        grown = True
        return reach

    def trace(self, entry: int, reach: list[set[int]]) -> tuple[str, int]:
        """The least string of edits among the cheapest, and the state it ends in.

        An edit's letter and a node fix the next node, and no cheapest string
        begins another (what is longer costs more), so taking the least letter
        that stays among the cheapest gives the least string.
        """
        at, state, out = 0, entry, []
        while at < len(self.codes):
            for edit, to_at, to, cost in self.arcs(at, state):
                if to in reach[to_at] and self.price[at][state] == cost + self.price[to_at][to]:
                    break
            out.append(edit)
            at, state = to_at, to
        return "".join(out), state


def passage_costs(codes: str) -> list[int]:
    """Least costs from each state before a run to each after it, as 16 numbers (``FAR``: no way)."""
    out = [[FAR] * 4 for _ in range(4)]
    for end in range(4):
        lattice = Lattice(codes, tuple(0 if s == end else FAR for s in range(4)))
        for entry in range(4):
            out[entry][end] = lattice.auction(entry)
    return [cost for row in out for cost in row]


def traces(codes: str, ends: tuple[int, ...], entries: tuple[int, ...]) -> list[tuple[str, int] | None]:
    """Per state before a run, its least cheapest edits and the state after; None for states not asked for."""
    lattice = Lattice(codes, ends)
    costs = {entry: lattice.auction(entry) for entry in entries}
    reach = lattice.tight()
    return [lattice.trace(s, reach) if costs.get(s, FAR) < FAR else None for s in range(4)]


def edits_cost(codes: str, edits: str) -> int:
    """What a string of edits costs over the run's turns."""
    total, at = 0, 0
    for edit in edits:
        if edit == "I":
            total += INSERT_COST
            continue
        total += {"D": DELETE_COST, "K": KEEP_COST, "R": REROLE_COST}[edit]
        total += CUT_COST if edit != "D" and codes[at].isupper() else 0
        at += 1
    return total


def apply_edits(codes: str, edits: str, entry: int) -> list[tuple[int | None, str | None]]:
    """The turns after the edits: (place in the run or None if new, role or None if unchanged)."""
    out, at, state = [], 0, entry
    for edit in edits:
        if edit == "K":
            out.append((at, None))
            state = KEEP[codes[at].lower()][state]
        elif edit != "D":
            state = TURN_NEXT[state]
            out.append((None if edit == "I" else at, "user" if state == USER else "assistant"))
        at += edit != "I"
    return out
