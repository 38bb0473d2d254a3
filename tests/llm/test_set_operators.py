"""Operators over several documents against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netquarry.llm import components, decontaminate, mixing, near_dedup, passages, sharding, url_filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def low(text):
    return SPACED.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, own, rate):
    return [w if rng.random() > rate else f"e{rng.randrange(10**6)}" for w in own]


def with_columns(texts):
    return [(i, t, "en" if i % 3 else "de", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def brute_components(rows):
    sets = {}
    for r in rows:
        own = low(r[1])
        sets[r[0]] = {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    groups, ids = Sets(), sorted(i for i in sets if i is not None)
    for i, a in enumerate(ids):
        groups.find(a)
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                groups.join(a, b)
    return sets, groups


def near_fixture(seed=1):
    rng = random.Random(seed)
    texts = [None, "", "  \n", "one", "One", "one two three", "one two three four", "a b c d e", "A B C D E"]
    for size in (12, 30, 80, 200):
        for _ in range(6):
            base = prose(rng, size)
            texts.append(" ".join(base))
            for rate in (0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1):
                texts.append(" ".join(edited(rng, base, rate)))
    hub = prose(rng, 120)  # a large group of near copies, far more than a node compares exhaustively
    texts += [" ".join(edited(rng, hub, 0.02)) for _ in range(120)]
    shared = prose(rng, 30)  # unlike texts around one passage
    texts += [" ".join(prose(rng, 40) + shared + prose(rng, 40)) for _ in range(60)]
    rng.shuffle(texts)
    return with_columns(texts)


def recall(rows, got, groups):
    """Documents whose component is the brute force's, as a share."""
    return sum(got[r[0]]["component_id"] == groups.find(r[0]) for r in rows) / len(rows)


@pytest.mark.parametrize("cfg", [near_dedup.DedupConfig(), near_dedup.DedupConfig(node_sets=8, depth=3)], ids=["default", "tiny-nodes"])
def test_near_duplicates_equal_brute_force(frame, cfg):
    rows = near_fixture()
    sets, groups = brute_components(rows)
    got = {r["doc_id"]: r for r in near_dedup.digest(near_dedup.near_components(frame(rows, DDL), cfg)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert recall(rows, got, groups) == 1.0


def test_near_duplicates_of_odd_rows(frame):
    long = " ".join(f"x{i}" for i in range(50_000))
    rows = [(None, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (5, "a b c d e f", None, None, None), (3, "a b c d e f", "en", "s", 1),
            (3, "a b c d e f", "en", "s", 1), (4, "quite another text than the others are", "en", "s", 1), (4, "a b c d e f", "en", "s", 1), (8, long, "en", "s", 1), (9, long + " y", "en", "s", 1)]
    got = near_dedup.digest(near_dedup.near_components(frame(rows, DDL))).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert by[3] == by[5] == {3} and by[8] == by[9] == {8}
    assert near_dedup.near_components(frame([], DDL)).count() == 0
    kept = near_dedup.keep_one(frame(rows, DDL))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} >= {None, 3, 8}


def test_trees_reach_the_recall_asked_for():
    assert near_dedup.DedupConfig(recall=0.9).trees < near_dedup.DedupConfig(recall=0.999).trees
    assert near_dedup.DedupConfig(percent=90).trees < near_dedup.DedupConfig(percent=75).trees


def test_recall_of_pairs_at_the_threshold_settled_at_the_last_level():
    """The rule by which nodes select functions, tried on 4,000 pairs at the threshold."""
    cfg, np, rng = near_dedup.DedupConfig(), near_dedup.np, near_dedup.np.random.default_rng(5)
    found, trees = 0, cfg.trees
    for _ in range(4000):
        same = rng.random(cfg.functions) < cfg.percent / 100  # the functions that agree on the pair, for all trees
        nodes = np.ones(trees, int)
        for _ in range(cfg.depth):
            first = rng.integers(0, cfg.functions, nodes.sum())
            second = (first + rng.integers(1, cfg.functions, len(first))) % cfg.functions
            kept = same[first].astype(int) + (same[second] & (rng.random(len(first)) < 100 / cfg.percent - 1))
            nodes = np.bincount(np.repeat(np.arange(trees), nodes), kept, trees).astype(int)
        found += nodes.any()
    assert found >= 4000 * cfg.recall - 8  # 4 expected to be missed


def test_recall_at_the_threshold_in_a_large_family_of_templates(frame):
    """300 pairs at 0.75 among 3,000 texts; all words are common ones, so nodes stay large for six levels."""
    rng = random.Random(12)
    kinds = [rng.choices("abc", (70, 15, 15), k=112) for _ in range(2700)]
    for own in kinds[:300]:
        other = own.copy()
        for i in rng.sample(range(112), 16):  # 96 of 128 words are common
            other[i] = rng.choice([c for c in "abc" if c != own[i]])
        kinds.append(other)
    texts = [" ".join(f"{i}{c}" for i, c in enumerate(k)) for k in kinds]
    cfg = near_dedup.DedupConfig(shingle=1, node_sets=64)
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(order[i], t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.digest(near_dedup.near_components(frame(rows, DDL), cfg)).collect()}
    found = sum(got[order[k]] == got[order[2700 + k]] for k in range(300))
    assert found >= 298
    assert len(set(got.values())) == 3000 - found


def test_blocks_of_a_large_node_hold_few_sets_of_either_side(frame):
    cfg = near_dedup.DedupConfig(node_sets=32)
    sets = frame([(i, bytes(4)) for i in range(600)], "id bigint, bins binary")
    rows = sets.selectExpr("0 AS tree", "7L AS node", "id")
    mixed = near_dedup._mixed(rows, frame([(i, 0) for i in range(100)], "node bigint, component bigint"), cfg, True)
    held, met = Counter(), defaultdict(lambda: ([], []))
    for r in near_dedup._blocks(mixed, sets, cfg).collect():
        held[r["block"], r["part"]] += 1
        met[r["block"]][r["part"]].append(r["id"])
    assert max(held.values()) <= 2 * cfg.node_sets
    pairs = Counter((a, b) for asks, lies in met.values() for a in asks for b in lies)
    assert len(pairs) == 500 * 600 and set(pairs.values()) == {1}


def test_components_equal_union_find(frame):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(2000, 2000 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (4, None)]
    groups = Sets()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            groups.join(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(frame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: groups.find(x) for x in groups.up}
    assert components.connected_components(frame([], "a string, b string")).count() == 0


def shard_rows(n=700):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(40), rng.choice(["en", "de", "fr"]), rng.choice(["hot"] * 5 + [f"src{k}" for k in range(9)]), rng.randrange(5000)) for i in range(n)]
    return rows + [(None, None, None, None, None), (9003, None, None, "hot", -5), (9003, None, None, "hot", -5)]


@pytest.mark.parametrize("run_rows", [20_000, 16])
def test_shards(frame, run_rows):
    rows = shard_rows()
    cfg = sharding.ShardConfig(run_rows=run_rows)
    got = sharding.digest(sharding.hilbert_shards(frame(rows, DDL), cfg=cfg)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        own = sorted((r["slot"], r["curve"]) for r in got if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
    ends = [[r["curve"] for r in got if r["shard"] == s] for s in range(16)]
    assert all(max(a) <= min(b) for a, b in zip(ends, ends[1:]))
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "rows", None) for r in got)


def test_shards_of_few_rows(frame):
    assert sharding.hilbert_shards(frame([], DDL)).count() == 0
    one = sharding.hilbert_shards(frame([(1, "a", None, "s", None)], DDL)).collect()
    assert [(r["shard"], r["slot"]) for r in one] == [(0, 0)]


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 4), (4, 2), (1, 3)])
def test_curve_visits_every_cell_by_unit_steps(spark, dims, bits):
    side = 1 << bits
    axes = [F.expr(f"CAST(id DIV {side ** i} % {side} AS INT)") for i in range(dims)]
    cells = spark.range(side**dims).select(*[a.alias(f"x{i}") for i, a in enumerate(axes)])
    placed = cells.select("*", sharding.curve_index([F.col(f"x{i}") for i in range(dims)], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in placed] == list(range(side**dims))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(placed, placed[1:]))


def test_shards_prune(frame):
    """A filter on any dimension meets fewer shards than under a hash of the id."""
    rows = shard_rows(3000)
    got = {r["doc_id"]: r["shard"] for r in sharding.hilbert_shards(frame(rows, DDL)).collect()}
    for column, value in ((2, "fr"), (3, "src4")):
        assert len({got[r[0]] for r in rows if r[column] == value}) < 12


def brute_leaks(text, windows):
    own, hit, items = WORD.findall((text or "").translate(LOWER)), set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(own) - size + 1):
            if (found := windows.get(tuple(own[i:i + size]))) is not None:
                hit |= set(range(i, i + size))
                items |= found
    return len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("cfg", [decontaminate.LeakConfig(), decontaminate.LeakConfig(block_rows=40)], ids=["one-block", "blocks"])
def test_leaks_equal_brute_force(frame, cfg):
    rng = random.Random(12)
    items = [(i, " ".join(prose(rng, n, 60))) for i, n in enumerate((1, 2, 3, 5, 9, 10, 11, 25, 40))]
    items += [(20, "Ärger ÉTÉ's fin-de ΑΣ'Α siècle K x1 y2 z3 q"), (21, None), (22, "..."), (None, " ".join(prose(rng, 12, 60))), (7, "Extra text of item seven with more than ten words in it now")]
    windows = {}
    for i, text in items:
        own = WORD.findall((text or "").translate(LOWER))
        for at in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[at:at + 10]), set()).update([] if i is None else [str(i)])
    texts = [None, "", "!!", items[9][1].upper(), "ärger ÉTÉ's fin-de ΑΣ'Α siècle K x1 y2 z3 q", items[9][1].replace("x1", "X1")]
    for _ in range(150):
        own = prose(rng, rng.randint(0, 60), 60)
        if rng.random() < 0.6:
            part = (rng.choice(items)[1] or "").split()
            start = rng.randint(0, len(part))
            own[len(own) // 2:len(own) // 2] = part[start:start + rng.randint(1, 30)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(own))
    rows = with_columns(texts) + [(None, items[7][1], None, None, None), (3, items[8][1], "en", "s", 1), (3, items[8][1], "en", "s", 1)]
    found = decontaminate.digest(*decontaminate.find_leaks(frame(rows, DDL), frame(items, "item_id bigint, text string"), cfg)).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found)
    assert got == Counter((r[0], *brute_leaks(r[1], windows)) for r in rows)


def test_leaks_of_empty_tables(frame):
    docs, bench = frame(with_columns(["a b"]), DDL), frame([], "item_id bigint, text string")
    assert [r["contaminated"] for r in decontaminate.digest(*decontaminate.find_leaks(docs, bench)).collect()] == [False]
    assert decontaminate.digest(*decontaminate.find_leaks(docs.limit(0), bench)).count() == 0
    assert decontaminate.drop_leaked(docs, bench).columns == docs.columns


def brute_shares(children, budget):
    """(weight, room) per child: fill by weight, taking out what is full, until nothing changes."""
    share, open_, left = {}, dict(children), budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [c for c, (w, room) in open_.items() if room <= left * w / total]
        if not full:
            return share | {c: left * w / total for c, (w, _) in open_.items()}
        for c in full:
            share[c] = open_.pop(c)[1]
        left = budget - sum(share.values())
    return share


@pytest.mark.parametrize("run_rows", [20_000, 4])
def test_mixing(frame, run_rows):
    rng = random.Random(21)
    rows = [(i, " ".join(prose(rng, rng.randint(0, 30))), rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot"] * 6 + ["a", "b", "c"]), 0) for i in range(500)]
    docs = frame(rows, DDL)
    weights = {"lang": frame([("en", 0.3), ("de", 0.6), ("fr", 0.5), (None, 0.1)], "lang string, weight double")}
    cfg = mixing.MixConfig(budget=0.8, epochs=2, run_rows=run_rows)
    taken, leaves = mixing.mix(docs, ("lang", "source"), weights, cfg)
    taken, leaves = taken.collect(), leaves.collect()
    tokens = {r[0]: len(low(r[1])) for r in rows}
    assert {r["doc_id"]: r["tokens"] for r in taken} == tokens and len(taken) == len(rows)
    w = {"en": 0.3, "de": 0.6, None: 0.1}
    have = Counter()
    for r in rows:
        have[r[2], r[3]] += tokens[r[0]]
    total = int(sum(tokens.values()) * cfg.budget)
    by_lang = brute_shares({g: (w[g], 2 * sum(v for k, v in have.items() if k[0] == g)) for g in w}, total)
    for leaf in leaves:
        kids = {k[1]: (1.0, 2 * v) for k, v in have.items() if k[0] == leaf["lang"]}
        want = brute_shares(kids, by_lang[leaf["lang"]])[leaf["source"]]
        assert abs(leaf["budget"] - want) <= 1
        own = [r for r in taken if (r["lang"], r["source"]) == (leaf["lang"], leaf["source"])]
        used = sum(r["tokens"] * r["copies"] for r in own)
        assert leaf["budget"] <= used < leaf["budget"] + max(r["tokens"] for r in own) + 1
        assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1 and max(r["copies"] for r in own) <= 2
    again, _ = mixing.mix(docs.repartition(7), ("lang", "source"), weights, mixing.MixConfig(budget=0.8, epochs=2))
    assert {(r["doc_id"], r["copies"]) for r in again.collect()} == {(r["doc_id"], r["copies"]) for r in taken}


def test_mixing_of_odd_rows(frame):
    rows = [(None, None, None, None, None), (1, "a b c", "en", "s", 1), (1, "a b c", "en", "s", 1), (2, "", "en", "t", 1)]
    taken, leaves = mixing.mix(frame(rows, DDL), ("lang", "source"), {"lang": frame([("en", None)], "lang string, weight double")})
    assert sorted((r["doc_id"] or 0, r["copies"]) for r in taken.collect()) == [(0, 1), (1, 0), (1, 0), (2, 1)]
    taken, _ = mixing.mix(frame([], DDL), ("lang", "source"))
    assert taken.count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts_of(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def rule_of(url):
    host, path = parts_of(url)
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: len(r[0] + r[1])) if fit else None


def test_url_rules_and_aliases(frame):
    canonical = '<html><head><LINK href="https://m.site.net/fr/1" rel=canonical></head>'
    refresh = "<meta http-equiv=\"refresh\" content=\"0; url='/es/9'\">"
    pages = [
        (1, "https://www.Example.com/en/1?x#y", None), (2, "http://a.example.com/en/2", ""), (3, "https://a.example.com/en", "<p>"),
        (4, "http://site.org/old", canonical), (5, "http://m.site.net/fr/1/", None), (6, None, canonical), (7, "no host/fr/", canonical),
        (8, "ftp://x.net/fr/é?a=b", ""), (9, "https://notexample.com/en/1", ""), (10, "https://hop.org/a?utm_source=z&q=1", ""), (11, "http://hop.org/a?q=1#f", ""),
        (12, "https://r.net/z", refresh), (13, "x://a://b.net/fr/", ""), (14, "https://example.com?x=/en/", ""), (15, "http://both.org/1", ""), (15, "http://both.org/1", ""),
    ]
    hops = [("http://hop.org/a?q=1", "https://way.org/station"), ("https://way.org/station", "https://deep.net/es/9"),
            ("http://both.org/1", "http://deep2.net/es/1"), ("http://both.org/1", "http://shop.com/"), (None, "http://a.com/"), ("http://a.org/", None)]
    got = url_filters.url_verdicts(
        frame(pages, "page_id bigint, url string, html string"), frame(RULES, "host string, path string, decision string"), frame(hops, "source string, target string"),
    ).collect()
    assert len(got) == len(pages)
    urls = {p[0]: p[1] for p in pages}
    for r in got:
        own = rule_of(urls[r["page_id"]])
        assert (r["host"], r["path"]) == parts_of(urls[r["page_id"]])
        assert r["rule"] == (own and own[0] + own[1])
        if own:
            assert r["verdict"] == own[2]
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert [verdict[i] for i in (4, 12, 10, 11, 15, 6, 7)] == ["block", "block", "block", "block", "allow", "allow", "allow"]
    assert {r["alias_group"] for r in got if r["page_id"] in (10, 11)} == {min("hop.org/a?q=1", "way.org/station", "deep.net/es/9")}


def test_url_filters_of_empty_tables(frame):
    rules = frame([], "host string, path string, decision string")
    assert url_filters.url_verdicts(frame([], "page_id bigint, url string, html string"), rules).count() == 0
    one = url_filters.url_verdicts(frame([(None, "http://a.b/", None)], "page_id bigint, url string, html string"), rules).collect()
    assert [(r["rule"], r["verdict"]) for r in one] == [(None, "allow")]


def test_chains_equal_brute_force():
    rng = random.Random(30)
    cfg = passages.PassageConfig()
    for _ in range(300):
        found = sorted({(rng.randrange(60), rng.randrange(60), rng.randint(1, 9)) for _ in range(rng.randint(1, 9))})
        best = {}
        for i, (x, y, n) in enumerate(found):
            before = [best[j] - cfg.gap_cost * (x - a - k + y - b - k) for j, (a, b, k) in enumerate(found[:i]) if a + k <= x and b + k <= y]
            best[i] = n + max([0, *before])
        chain = passages.chains(passages.np.array(found), cfg)
        score = found[chain[0][0]][2]
        for p, q in zip(chain[0], chain[0][1:]):
            a, b = found[p], found[q]
            assert a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1]
            score += b[2] - cfg.gap_cost * (b[0] - a[0] - a[2] + b[1] - a[1] - a[2])
        assert score == pytest.approx(max(best.values()))
        assert sorted(i for c in chain for i in c) == list(range(len(found)))


def test_gap_alignment_is_longest_common_subsequence():
    rng = random.Random(31)
    for _ in range(200):
        x, y = (rng.choices(range(4), k=rng.randint(0, 9)) for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        assert passages.equal_in_gap(passages.np.array(x), passages.np.array(y)) == table[-1][-1]


def test_passages(frame):
    rng = random.Random(33)
    shared = [prose(rng, 55, 10**6) for _ in range(12)]
    texts, planted = [], {}
    for i in range(160):
        own = prose(rng, rng.randint(60, 200), 10**6)
        if i % 2 == 0:
            passage = rng.choice(shared)
            if i % 4 == 0:  # an edit in the midst, and one word too many
                passage = passage[:20] + ["edit"] + passage[21:40] + ["more"] + passage[40:]
            at = rng.randint(0, len(own))
            own[at:at] = passage
            planted[i] = (at, at + len(passage))
        texts.append(" ".join(own).upper() if i % 6 == 0 else " ".join(own))
    short = " ".join(prose(rng, 49, 10**6))
    texts += [short, short, " ".join(prose(rng, 50, 10**6)), None, "", "word " * 5000]
    copy = " ".join(prose(rng, 51, 10**6))
    texts += [copy, copy.replace(" ", "\n"), copy]
    got = defaultdict(list)
    found = passages.digest(passages.repeated_passages(frame(with_columns(texts), DDL))).collect()
    for r in found:
        got[r["doc_id"]].append((r["start_word"], r["end_word"]))
        assert r["end_word"] - r["start_word"] >= 50 and r["other_doc_id"] != r["doc_id"]
    for i, (a, b) in planted.items():
        assert any(x <= a + 3 and b - 3 <= y and y - x <= b - a + 6 for x, y in got[i]), (i, a, b, got[i])
    n = len(texts)
    assert set(got) == set(planted) | {n - 3, n - 2, n - 1}
    assert {(r["doc_id"], r["copies_of"], r["n_copies"]) for r in found if r["doc_id"] >= n - 3} == {(i, n - 3, 3) for i in (n - 3, n - 2, n - 1)}


def test_blocks_on_all_diagonals():
    np, cfg, rng = passages.np, passages.PassageConfig(), random.Random(41)
    words = lambda n: [rng.getrandbits(62) for _ in range(n)]
    found = lambda x, y: {p[:4] for p in passages.align(np.array(x, np.uint64), np.array(y, np.uint64), cfg)}
    p = words(60)
    x, twice, late = words(9) + p + words(7), words(5) + p + words(40) + p, words(3) + p[:40] + words(35) + p + words(2)
    assert found(x, twice) == {(9, 69, 5, 65), (9, 69, 105, 165)}
    assert found(twice, x) == {(5, 65, 9, 69), (105, 165, 9, 69)}
    assert (9, 69, 78, 138) in found(x, late) and (78, 138, 9, 69) in found(late, x)
    assert (43, 103, 0, 60) in found(words(3) + p[:40] + p + words(2), p + words(35) + p[:40])
    many = [w for _ in range(60) for w in p[:52] + words(8)]  # each run 60 times on either side
    other = [w for _ in range(60) for w in p[:52] + words(31)]
    assert {a for a, b, _, _ in found(many, other)} == set(range(0, 3600, 60))
    assert {c for _, _, c, d in found(many, other)} == set(range(0, 60 * 83, 83))
    line = words(12)
    assert found(line * 300, line * 200 + words(30))
    for _ in range(200):
        x, y = (rng.choices(range(1, 5), k=rng.randint(0, 40)) for _ in range(2))
        best = {(i, j) for i in range(len(x)) for j in range(len(y)) if x[i : i + 4] == y[j : j + 4] and len(x[i : i + 4]) == 4 and (not i or not j or x[i - 1] != y[j - 1])}
        assert {(a, b) for a, b, _ in passages.blocks(np.array(x, np.uint64), np.array(y, np.uint64), cfg).tolist()} == best


def passage_recall(frame, rate, n=400, words=60):
    """Share of candidates among pairs of texts with one passage, of whose words ``rate`` are edited."""
    rng, texts = random.Random(43), []
    for _ in range(n):
        passage = prose(rng, words, 10**6)
        other = passage.copy()
        for i in rng.sample(range(words), round(rate * words)):
            other[i] = f"e{rng.randrange(10**6)}"
        texts += [" ".join(prose(rng, 30, 10**6) + p + prose(rng, 30, 10**6)) for p in (passage, other)]
    rows = passages.text_rows(frame(with_columns(texts), DDL).selectExpr("doc_id AS id", "text", "xxhash64(text) AS text_key"), passages.PassageConfig())
    pairs = passages.class_pairs(passages.seed_places(rows.cache()))
    ids = rows.select("cls", "id")
    met = pairs.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").where("x div 2 = y div 2").select(F.expr("x div 2")).distinct().count()
    return met / n


@pytest.mark.parametrize("rate,least", [(0.05, 0.99), (0.1, 0.95), (0.15, 0.85)])
def test_edited_passages_are_candidates(frame, rate, least):
    assert passage_recall(frame, rate) >= least


def test_exact_repeat_of_lines_that_lesser_texts_have_singly(frame):
    rng = random.Random(47)
    texts, planted = [], set()
    for _ in range(6):
        lines = [prose(rng, 26, 10**6) for _ in range(3)]
        planted |= {len(texts), len(texts) + 1}
        texts += [" ".join(prose(rng, 30, 10**6) + sum(lines, []) + prose(rng, 30, 10**6)) for _ in range(2)]
        for i in range(3):  # any two halves of neighbouring lines stand in lesser texts as well
            for part in (lines[i], sum(lines, [])[13 + 26 * i : 39 + 26 * i]):
                texts += [" ".join(prose(rng, 30, 10**6) + part + prose(rng, 30, 10**6)) for _ in range(12)]
    found = passages.digest(passages.repeated_passages(frame(with_columns(texts), DDL))).collect()
    assert {r["doc_id"] for r in found if r["end_word"] - r["start_word"] >= 78} == planted


def test_edited_repeat_whose_seeds_lesser_texts_have_singly(frame):
    rng = random.Random(71)
    texts, planted = [], set()
    for _ in range(8):
        passage = prose(rng, 70, 10**6)
        other = passage.copy()
        for i in (16, 35, 52):
            other[i] = f"e{rng.randrange(10**6)}"
        planted |= {len(texts), len(texts) + 1}
        texts += [" ".join(prose(rng, 30, 10**6) + p + prose(rng, 30, 10**6)) for p in (passage, other)]
        for low in range(0, 60, 5):  # any run of six to ten words stands in ten lesser texts as well
            texts += [" ".join(prose(rng, 40, 10**6) + passage[low : low + 14] + prose(rng, 40, 10**6)) for _ in range(10)]
    found = passages.digest(passages.repeated_passages(frame(with_columns(texts), DDL))).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in found} == {(i, i ^ 1) for i in planted}


def test_common_passage_gives_no_pairs_of_all(frame):
    rng = random.Random(35)
    passage = prose(rng, 70, 10**6)
    texts = [" ".join(prose(rng, 30, 10**6) + passage + prose(rng, 30, 10**6)) for _ in range(150)]
    rows = passages.text_rows(frame(with_columns(texts), DDL).selectExpr("doc_id AS id", "text", "xxhash64(text) AS text_key"), passages.PassageConfig())
    assert passages.class_pairs(passages.seed_places(rows)).count() <= 3 * len(texts)  # seeds at its ends differ
    assert passages.repeated_passages(frame(with_columns(texts), DDL)).count() == 150


def edited(rng, words, rate):
    return [f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in words]


def test_windows_around_a_seed_tell_what_whole_texts_tell():
    np, cfg, rng = passages.np, passages.PassageConfig(), random.Random(53)
    words = lambda n: [rng.getrandbits(62) for _ in range(n)]
    told = 0
    for _ in range(600):
        shared = words(rng.choice([6, 12, 40, 50, 60, 75, 110, 300]))
        at = rng.randrange(len(shared) - 5)
        other = [w if at <= i < at + 6 or rng.random() > rng.choice([0, 0.1, 0.2]) else rng.getrandbits(62) for i, w in enumerate(shared)]
        heads = [words(rng.choice([0, 3, 20, 200])) for _ in range(2)]
        texts = [np.array(h + s + words(rng.choice([0, 3, 20, 200])), np.uint64) for h, s in zip(heads, (shared, other))]
        places = [len(h) + at for h in heads]
        low = [max(0, p - cfg.reach) for p in places]
        near = [t[a : p + 6 + cfg.reach] for t, a, p in zip(texts, low, places)]
        ends = [e for t, a, n in zip(texts, low, near) for e in (a > 0, a + len(n) < len(t))]
        got = passages.align_near(*near, (places[0] - low[0], places[1] - low[1]), tuple(ends), cfg)
        if got is not None:
            told += 1
            assert [(a + low[0], b + low[0], c + low[1], d + low[1], e) for a, b, c, d, e in got] == passages.align(*texts, cfg)
    assert told > 200


def test_short_runs_are_known_without_alignment():
    np, pa, cfg, rng = passages.np, passages.pa, passages.PassageConfig(), random.Random(61)
    sides, windows = ([], []), []
    for _ in range(500):
        run = rng.choice([6, 6, 9, 25, 45, 60, 134])
        shared = [rng.getrandbits(62) for _ in range(run)]
        at, stray = rng.randrange(run - 5), rng.random() < 0.3
        extra = [rng.getrandbits(62) for _ in range(4)]
        pair = []
        for side in sides:
            head, tail = ([rng.getrandbits(62) for _ in range(rng.choice([0, 5, 40, 90]))] for _ in range(2))
            if stray:
                tail = extra + tail
            text, place = head + [rng.getrandbits(62)] + shared + [rng.getrandbits(62)] + tail, len(head) + 1 + at
            low = max(0, place - cfg.reach)
            side.append({"place": place, "low": low, "size": len(text), "words": text[low : place + 6 + cfg.reach]})
            pair.append((np.array(side[-1]["words"], np.uint64), place - low, low > 0, low + len(side[-1]["words"]) < len(text)))
        windows.append(pair)
    kind = pa.struct([("place", pa.int32()), ("low", pa.int32()), ("size", pa.int32()), ("words", pa.list_(pa.int64()))])
    for part in (slice(0, 500), slice(100, 400)):
        columns = [pa.array(side, kind)[part] for side in sides]
        alone = passages.only_short_runs(*(passages._side(c) for c in columns), cfg)
        found = [passages.align_near(x[0], y[0], (x[1], y[1]), (*x[2:], *y[2:]), cfg) for x, y in windows[part]]
        assert all(f == [] for f, only in zip(found, alone) if only)
        assert 0.3 < alone.mean() < 0.9


def test_reach_changes_no_passage(frame):
    rng, texts = random.Random(59), []
    for i in range(120):
        passage = prose(rng, rng.choice([8, 20, 45, 52, 60, 90, 200]), 10**6)
        for rate in (0, rng.choice([0, 0.05, 0.15])):
            texts.append(" ".join(prose(rng, rng.choice([0, 30, 150]), 10**6) + edited(rng, passage, rate) + prose(rng, rng.choice([0, 30, 150]), 10**6)))
    docs = frame(with_columns(texts), DDL)
    near, whole = (
        {tuple(r) for r in passages.digest(passages.repeated_passages(docs, passages.PassageConfig(reach=reach))).collect()} for reach in (64, 10**6)
    )
    assert near == whole and len(near) > 60


def test_shifts_of_a_repeated_word_are_few_and_cover_the_same_words():
    import numpy as np

    cfg = passages.PassageConfig()
    x, y = np.full(900, 7, np.uint64), np.full(73, 7, np.uint64)
    found = passages.align(x, y, cfg)
    assert len(found) <= 30 and all(p[1] - p[0] == p[4] == 73 for p in found)
    assert {i for p in found for i in range(p[0], p[1])} == set(range(900)) and {i for p in found for i in range(p[2], p[3])} == set(range(73))


def test_next_blocks_are_the_same_rows_once():
    import numpy as np

    rng = np.random.default_rng(5)
    rows = rng.integers(0, 3, 400), rng.integers(0, 2, 400).astype(np.uint64), rng.integers(0, 3, 400).astype(np.int32), rng.integers(0, 2, 400) > 0
    got = list(zip(*passages._once(*rows)))
    assert len(got) == len(set(got)) and set(got) == set(zip(*rows))


def test_passages_of_odd_rows(frame):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(None, long, "en", "s", 1), (1, long, None, None, None), (1, long, "en", "s", 1), (2, long + " z", "en", "s", 1), (3, None, "en", "s", 1)]
    assert {r["doc_id"] for r in passages.repeated_passages(frame(rows, DDL)).collect()} == {1, 2}
    assert passages.repeated_passages(frame([], DDL)).count() == 0


def test_split_rows_keeps_every_row_once(frame):
    from netquarry.llm.semijoin import maybe_in, split_rows, without

    rows = frame([(i if i % 50 else None, i % 3) for i in range(3000)], "id bigint, __x int")
    ids = frame([(i,) for i in range(0, 3000, 7)] + [(None,)], "gone bigint")
    near, far = split_rows(rows, ids, "id", "gone")
    assert near.columns == far.columns == rows.columns
    assert near.count() + far.count() == rows.count() and near.count() < 700
    named = {i for i in range(3000) if i % 50 and i % 7 == 0}
    assert named <= {r["id"] for r in near.collect()}
    assert sorted(r["id"] for r in without(rows, ids, "id", "gone").collect()) == [i for i in range(3000) if i % 50 and i % 7]
    text = frame([("a",), ("b",)], "id string")
    assert [r["id"] for r in maybe_in(text, frame([("a",)], "id string")).collect()] == ["a"]
    assert without(text, text.limit(0), "id", "id").count() == 2


def test_pairs_whose_blocks_reach_nowhere_are_not_chained(monkeypatch):
    """All pairs of a slice are aligned at once, as each would be alone; chains are made only where a passage may be."""
    np, cfg, rng = passages.np, passages.PassageConfig(), random.Random(71)
    random_words = lambda n, kinds: [rng.randrange(1, kinds) for _ in range(n)]
    line, shared = random_words(8, 10**9), random_words(70, 10**9)
    heads = [random_words(40, 10**9) + shared + line * 60, random_words(500, 12), line * 90 + random_words(20, 10**9)]
    others = [[shared[:30] + [5, 6] + shared[32:] + random_words(30, 10**9), line * 40 + shared, random_words(300, 12), [9] + line * 3, [7] * 80] for _ in heads]
    words, rows = [], []
    for k, (head, partners) in enumerate(zip(heads, others)):
        begin = len(words)
        words += head
        for other in partners:
            rows.append((k, begin, begin + len(head), len(words), len(words) + len(other)))
            words += other
    alone = [passages.align(np.array(words[x:x_end], np.uint64), np.array(words[y:y_end], np.uint64), cfg) for _, x, x_end, y, y_end in rows]
    pairs = passages.Pairs(np.array(words, np.uint64), *(np.array(c) for c in zip(*rows)))
    assert passages.align_all(pairs, cfg) == alone and any(alone) and not all(alone)
    monkeypatch.setattr(passages, "HELD", 100)  # in several parts
    assert passages.align_all(pairs, cfg) == alone
    monkeypatch.undo()
    chained, chains = [], passages.chains
    monkeypatch.setattr(passages, "chains", lambda found, cfg: chained.append(found) or chains(found, cfg))
    x, y = (sum((random_words(45, 10**9) + line for _ in range(20)), []) for _ in "xy")
    x, y = np.array(x, np.uint64), np.array(y, np.uint64)
    assert len(passages.blocks(x, y, cfg)) >= 20 and passages.align(x, y, cfg) == [] and not chained
