"""Per-document operators against plain Python on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from netquarry.llm import labelled, quality_model, quality_rules, secrets, textkit, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n\v ", "en", None), (None, "one two", "en", "b"), (4, "é" * 50_000 + " end", "de", "b"),
    (5, "a b c d e f " * 4000, "en", "a"), (6, "Ünïcode\x0bwörds\x85here", "fr", "c"), (6, "Ünïcode\x0bwörds\x85here", "fr", "c"), (7, "x", "en", "c"),
]
ODD_DDL = "doc_id bigint, text string, lang string, source string"


def words(text):
    return SPACED.findall(text or "")


def test_words_and_slices():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab é\n\t ßZ", k=rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    seen = []
    for part in textkit.slices([batch, batch.slice(0, 0)], limit=100):
        w = textkit.Words(part.column("text"))
        for i, text in enumerate(part.column("text").to_pylist()):
            own = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.first[i]:w.first[i + 1]], w.ends[w.first[i]:w.first[i + 1]])]
            assert own == words(text)
            seen.append(text)
    assert seen == texts


def test_equal_words_have_equal_hashes_wherever_they_stand():
    w = textkit.Words(pa.array(["Ab cd ab", "cd AB ba"]), lower=True)
    a, b, c, d, e, f = (int(h) for h in w.hashes)
    assert a == c == e and b == d and len({a, b, f}) == 3
    plain = textkit.Words(pa.array(["Ab ab"]))
    assert plain.hashes[0] != plain.hashes[1]


ASSIGN = re.compile("""(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], secrets.BASE_KINDS.index(s[2])))


def test_base_spans_equal_plain_search():
    rng = random.Random(9)
    parts = ["password", "Secret", "TOKEN", "api", "_", "key", "=", ":", " ", '"', "'", "AKIA", "ABCDEF123456", "0123456789abcdef",
             "é", "İ", "K", "ſ", "\n", "x", "abcdefgh", "passwd", "🙂"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert [s for s in secrets.scan(text) if s[2] in secrets.BASE_KINDS] == base_spans(text), text


def crc_token(prefix, body):
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        digits = secrets.BASE62[r] + digits
    return prefix + body + digits.rjust(6, "0")


def test_checksums_decide():
    good = crc_token("ghp_", "a1B2" * 7 + "zz")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    text = f"x {good} y {bad} card: 4111 1111 1111 1111, card 4111 1111 1111 1112 iban GB82 WEST 1234 5698 7654 32 iban GB83 WEST 1234 5698 7654 32"
    kinds = [(k, text[a:b]) for a, b, k in secrets.scan(text)]
    assert kinds == [("hosting", good), ("card", "4111 1111 1111 1111"), ("account", "GB82 WEST 1234 5698 7654 32")]


def test_secret_digest(frame):
    text = 'é token = "abcdefgh1" and AKIAABCDEFGHIJKL12 ' + "0" * 40
    rows = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(frame([(9, text, "en", "s"), *ODD], ODD_DDL).where("doc_id is not null"))).collect()}
    want = ",".join(f"{k}:{a}:{b}" for a, b, k in base_spans(text))
    r = rows[9]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert rows[1]["spans"] == "" and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.find_secrets(frame([], ODD_DDL)).count() == 0


def plain_features(text):
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = {}
    for i in range(len(own) - 4):
        at.setdefault(tuple(own[i:i + 5]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_features(frame):
    rng = random.Random(2)
    vocabulary = ["the", "of", "ä", "a|b", "**", "x\ny", "same line\nsame line\n", "🙂", "<p>", "Tab\tbed"]
    rows = [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))), "en", "s") for i in range(200)] + ODD
    got = quality_rules.features(frame(rows, ODD_DDL)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_features(texts[r["doc_id"]])


def test_binomial_tail_is_exact():
    from math import comb

    for n, p in ((1, 0.3), (20, 0.05), (60, 0.5), (400, 0.01)):
        for k in range(0, n + 1, max(1, n // 13)):
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality_rules.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)


def test_rules_keep_good_and_need_evidence(spark, frame):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows, labels = [], []
    for i in range(4000):
        own = [rng.choice(vocabulary) + str(rng.randint(0, 999)) for _ in range(20)]
        bad = i % 5 == 0
        rows.append((i, " ".join(w + "***" for w in own) if bad else " ".join(own), "en" if i < 3900 else "rare", "s"))
        labels.append((i, 0 if bad else 1))
    cfg = quality_rules.RuleConfig()
    docs, marks = frame(rows, ODD_DDL), frame(labels + [(None, 1), (7, None), (10**9, 1)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, marks, cfg).collect()}
    good = [got[i]["kept"] for i, q in labels if q and i < 3900]
    assert sum(good) >= (1 - cfg.risk) * len(good)
    assert not any(got[i]["kept"] for i, q in labels if not q and i < 3900)
    assert all(got[i]["kept"] for i in range(3900, 4000))  # too few labels for a cutoff
    limits = quality_rules.cutoffs(
        quality_rules.features(docs).join(marks.selectExpr("doc_id AS i", "quality = 1 AS good"), quality_rules.F.col("doc_id") == quality_rules.F.col("i")),
        quality_rules.default_rules(), cfg,
    ).collect()
    parts = len(quality_rules.default_rules())
    for r in limits:  # each cutoff passes its exact bound
        if r["cutoff"] is not None:
            assert quality_rules.binomial_tail(r["n_lost"], r["n_good"], cfg.risk / parts) <= cfg.error / parts / 2


def test_rules_on_odd_rows(frame):
    got = quality_rules.quality_rules(frame(ODD, ODD_DDL), frame([], "doc_id bigint, quality int")).collect()
    assert len(got) == len(ODD)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert {r["doc_id"]: r["base_failed"] for r in got}[1]
    assert quality_rules.quality_rules(frame([], ODD_DDL), frame([], "doc_id bigint, quality int")).count() == 0


def toxic_corpus(n=900):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    slurs = ["grubbel", "wrenk", "zottox"]
    rows, labels = [], []
    for i in range(n):
        own = rng.choices(vocabulary, k=rng.randint(10, 120))
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 6)):
                own.insert(rng.randrange(len(own)), rng.choice(slurs) + rng.choice(["", "er", "ing", "est"]))
        rows.append((i, " ".join(own), "en", "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(frame):
    rows, labels = toxic_corpus()
    got = toxicity.classify(frame(rows + ODD, ODD_DDL), frame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] > 7]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]]]) >= 0.95
    assert np.mean([r["predicted"] for r in held if not truth[r["doc_id"]]]) <= 0.02


def test_toxicity_never_reads_held_out_labels(frame):
    rows, labels = toxic_corpus(300)
    docs = frame(rows, ODD_DDL)
    turned = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in labels]
    a, b = (sorted(tuple(r) for r in toxicity.classify(docs, frame(x, "doc_id bigint, toxic int")).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_without_labels(frame):
    rows = toxicity.classify(frame(ODD, ODD_DDL), frame([(None, 1), (1, None)], "doc_id bigint, toxic int")).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.0}
    extra = frame([(1, "t", "x", 3.0)], "doc_id bigint, text string, score string, c0 double")
    assert toxicity.drop_toxic(extra, frame([], "doc_id bigint, toxic int")).columns == ["doc_id", "text", "score", "c0"]


def test_quality_model_on_held_out_rows(frame):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        own = rng.choices(vocabulary, k=rng.randint(20, 80))
        bad = i % 4 == 0
        if bad:
            own = [w for w in own for _ in range(3)] if i % 8 else [w.upper() + "!!" for w in own]
        rows.append((i, " ".join(own), "en", "s"))
        labels.append((i, int(not bad)))
    got = quality_model.classify(frame(rows + ODD, ODD_DDL), frame(labels, "doc_id bigint, quality int")).collect()
    truth = dict(labels)
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] > 7]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_quality_model_with_one_kind_of_label(frame):
    docs = frame(ODD, ODD_DDL)
    assert {r["score"] for r in quality_model.classify(docs, frame([], "doc_id bigint, quality int")).collect()} == {0.5}
    assert {r["score"] for r in quality_model.classify(docs, frame([(i, 1) for i in range(1, 8)], "doc_id bigint, quality int")).collect()} == {1.0}


def test_context_counts_equal_plain_sums(frame):
    cfg = quality_model.NetConfig(word_rows=16, shape_rows=8, dims=4)
    texts = ["a b c a b", "x", "", "A b! b! 3 c"]
    places, signs = quality_model.index_vectors(cfg)
    want = np.zeros((24, 4), int)
    for text in texts:
        w = textkit.Words(pa.array([text]))
        pair = list(zip(*quality_model.tokens(w, cfg)))
        for i, mine in enumerate(pair):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(pair):
                    for t in mine:
                        for near in pair[j]:
                            for k in (0, 1):
                                want[t, places[k][near]] += signs[k][near]
    got = np.zeros_like(want)
    for r in quality_model.context_counts(frame([(i, t, None, None) for i, t in enumerate(texts)], ODD_DDL), cfg).collect():
        got[r[0]] = r[1:]
    assert (got == want).all()


def test_sample_takes_the_greatest_of_several_labels(frame):
    ids = [i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1]
    a, b, out = ids[0], ids[1], next(i for i in range(99) if i not in ids)
    rows = [(a, 0), (a, 1), (None, 1), (b, None), (out, 1)]
    got = labelled.training_labels(frame(rows, "doc_id bigint, toxic int"), "toxic", "doc_id").collect()
    assert [tuple(r) for r in got] == [(a, 1)]
