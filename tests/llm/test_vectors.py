"""Hard negatives against a plain version."""

import random

import numpy as np
import pytest

from netquarry.llm import hard_negatives as hn

DDL = "id bigint, vector array<bigint>, label bigint, anchor boolean, rank int, block string"


def plain(rows, cfg):
    one = {}
    for id_, vector, label, anchor, *_ in rows:
        if id_ is None or label is None or vector is None or any(x is None for x in vector):
            continue
        old = one.get(id_)
        new = (label, list(vector))
        one[id_] = (min(new, old[0]) if old else new, bool(anchor) or bool(old and old[1]))
    out = set()
    for a, ((label, q), is_anchor) in one.items():
        if not is_anchor:
            continue
        scored = sorted(((sum(x * y for x, y in zip(q, v)), i, l) for i, ((l, v), _) in one.items() if i != a), key=lambda t: (-t[0], t[1]))
        for score, positive, _ in [s for s in scored if s[2] == label][: cfg.positives]:
            fit = [s for s in scored if s[2] != label and cfg.low * score <= 100 * s[0] <= cfg.high * score]
            out |= {(a, positive, rank, n, score, s) for rank, (s, n, _) in enumerate(fit[: cfg.negatives], 1)}
    return out


def mined(frame, rows, cfg):
    got = hn.mine(frame(rows, DDL), cfg=cfg).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def vectors(rng, n, dims, spread, labels):
    centres = [[rng.randrange(-spread, spread + 1) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        out.append((i, [c + rng.randrange(-3, 4) for c in centres[rng.randrange(labels)]], label, i % 20 == 0, 1, "x"))
    return out


@pytest.mark.parametrize("dims,spread", [(64, 6), (5, 2), (33, 40)])
def test_hard_negatives_equal_plain_version(frame, dims, spread):
    rng = random.Random(dims)
    rows = vectors(rng, 400, dims, spread, 4)
    rows += [(i, rows[7][1], rng.randrange(4), i % 3 == 0, 1, "x") for i in range(1000, 1200)]  # copies: ties
    rows += rows[:30]  # repeated rows
    rows += [(None, [1], 1, True, 1, "x"), (2000, None, 1, True, 1, "x"), (2001, [1, None], 1, True, 1, "x"), (2002, [1], None, True, 1, "x")]
    rows += [(2003, [], 1, True, 1, "x"), (2004, [5, 5], 2, None, 1, "x"), (2, [0] * dims, 3, False, 1, "x")]
    cfg = hn.MineConfig(block_rows=150, anchor_rows=16)
    assert mined(frame, rows, cfg) == plain(rows, cfg)


def test_hard_negatives_edges(frame):
    cfg = hn.MineConfig(positives=2, negatives=2)
    assert mined(frame, [], cfg) == set()
    big = 1 << 40  # beyond exact doubles
    rows = [(1, [big, 3], 0, True, 1, ""), (2, [1, 1], 0, False, 1, ""), (3, [1, 0], 1, False, 1, ""), (4, [0, 7], 1, False, 1, "")]
    rows += [(5, [-1, 0], 0, False, 1, "")]
    assert mined(frame, rows, hn.MineConfig(positives=2, negatives=2, high=100)) == plain(rows, hn.MineConfig(positives=2, negatives=2, high=100))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-200, 200, (40, 64)), rng.integers(-200, 200, (90, 64))
    exact = a @ b.T
    widths = []
    for level in range(len(hn.LEVELS)):
        low, high = hn.bounds(hn.summaries(a), hn.summaries(b), level, 64)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True)
    # on vectors that are even within segments, most candidates go before exact scoring
    flat = np.repeat(rng.integers(-200, 200, (500, 16)), 4, axis=1) + rng.integers(-3, 4, (500, 64))
    low, high = hn.bounds(hn.summaries(flat[:10]), hn.summaries(flat), 2, 64)
    least = hn._kth_best(low, 5)
    assert (high >= least[:, None]).mean() < 0.05
