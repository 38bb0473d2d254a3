"""Rows and links that earlier versions lost, and names that clashed."""

import base64

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from netquarry.llm import mixing, near_dedup, secrets, toxicity, url_filters
from netquarry.llm.semijoin import split_rows, without

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"


def canonical(target, extra=""):
    return f'<html><head>{extra}<link rel="canonical" href="{target}"></head>'


@pytest.mark.parametrize("page,html,blocked", [
    ("http://a.org/x/y", canonical("//b.net/fr/1"), True),
    ("http://b.net/fr/sub/y", canonical("../2"), True),
    ("http://b.net/de/sub/y?q=/fr/", canonical("../../fr/9"), True),
    ("http://b.net/de/sub/y", canonical("./x/../../../../fr/9"), True),
    ("http://b.net", canonical("fr/9"), True),
    ("http://a.org/x", canonical("1", '<base href="http://b.net/fr/">'), True),
    ("http://a.org/x", canonical("../fr/1", "<BASE target=_top href='//b.net/es/'>"), True),
    ("http://a.org/x", canonical("http:&#47;&#x2F;b.net/fr/1"), True),
    ("http://a.org/x", "<meta http-equiv=refresh content=\"0; URL= '//b.net/es/9'\">", True),
    ("http://a.org/x", canonical("fr/1"), False),
    ("http://a.org/x", canonical("#b.net/fr/"), False),
])
def test_relative_targets_keep_their_links(frame, page, html, blocked):
    rules = frame([("net", "/es/", "block"), ("net", "/fr/", "block")], "host string, path string, decision string")
    got = url_filters.url_verdicts(frame([(1, page, html)], PAGES), rules).first()
    assert got["verdict"] == ("block" if blocked else "allow")


def test_coded_ampersands_make_one_group(frame):
    rules = frame([], "host string, path string, decision string")
    pages = [(1, "http://a.org/x", canonical("/p?a=1&amp;b=2")), (2, "http://a.org/p?b=2&a=1", None), (3, "http://a.org/q", canonical("?a=1&amp;b=2"))]
    got = {r["page_id"]: r["alias_group"] for r in url_filters.url_verdicts(frame(pages, PAGES), rules).collect()}
    assert got[1] == got[2] == "a.org/p?a=1&b=2" and got[3] == "a.org/q"


def test_deeply_nested_header_is_no_secret(frame):
    deep = base64.urlsafe_b64encode(b"[" * 200_000).decode().rstrip("=")
    text = f"eyJ{deep}.eyJhIjoxfQ.c2lnbmF0dXJl and token = abcdefgh12"
    assert secrets.signed_header(deep) is False
    assert secrets.digest(secrets.find_secrets(frame([(1, text)], "doc_id bigint, text string"))).count() == 1


def test_clashing_names_in_prefiltered_joins(frame):
    columns = "doc_id bigint, text string, _own int, _at int, _bucket int, _bits int, _near int, _k0 int, g0 int, gone int"
    rows = [(i, f"t{i}", *[i] * 8) for i in range(50)] + [(None, "n", *[0] * 8)]
    docs = frame(rows, columns)
    ids = frame([(3,), (4,), (None,)], "gone bigint")
    near, far = split_rows(docs, ids, "doc_id", "gone")
    assert near.columns == far.columns == docs.columns and near.count() + far.count() == 51
    kept = without(docs, ids, {"gone": "doc_id"})
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(50)) - {3, 4}
    assert without(docs, ids.limit(0), {"gone": "doc_id"}).count() == 51


def test_rows_of_one_id_are_decided_one_by_one(frame, spark):
    one, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    docs = frame([(1, one, "en", "s", 1), (4, one, "en", "s", 1), (4, other, "en", "s", 1), (4, None, None, None, None), (5, third, "en", "s", 1)], DDL)
    kept = near_dedup.keep_one(docs).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted([(1, one), (4, other), (4, ""), (5, third)])
    # languages the weights don't name keep a share, and an id's other rows stay when one leaf is cut
    rows = [(i, " ".join(["w"] * 20), lang, "s", 1) for i in range(200) for lang in ("en", "tlh")] + [(None, "one two", "en", "s", 1), (None, "x", None, "s", 1)]
    mixed = corpus_pipeline.mix_sources(spark, frame(rows, DDL), "")
    got = {(r["doc_id"], r["lang"]) for r in mixed.collect()}
    assert {lang for _, lang in got} >= {"en", "tlh"}
    taken, _ = mixing.mix(frame(rows, DDL), ("lang",), {"lang": frame([("en", 1.0), ("tlh", 0.0)], "lang string, weight double")}, mixing.MixConfig(budget=0.4, epochs=1))
    copies = {r["lang"]: r["n"] for r in taken.groupBy("lang").agg(F.sum("copies").alias("n")).collect()}
    assert copies["tlh"] == 0 and copies["en"] > 0


def test_risk_gradient_equals_numeric_one():
    import numpy as np

    rng = np.random.default_rng(3)

    class Rows(toxicity.Sample):
        def __init__(self, n):
            self.n, self.row = n, np.repeat(np.arange(n, dtype=np.int32), 4)
            self.feature, self.weight = rng.integers(0, 6, 4 * n).astype(np.int32), rng.random(n)

    def risk(w, b, p, u, prior):
        sp, su = (toxicity.sigmoid(s.scores(w) + b) for s in (p, u))
        wp, wu = p.weight / p.weight.sum(), u.weight / u.weight.sum()
        loss = lambda s, sign: -np.log(s if sign > 0 else 1 - s)
        rest = wu @ loss(su, -1) - prior * (wp @ loss(sp, -1))
        return prior * (wp @ loss(sp, 1)), rest

    p, u, prior = Rows(30), Rows(50), 0.3
    for scale in (0.1, 3.0):  # with the rest above and below zero
        w, b = rng.normal(size=6) * scale, 0.2
        gw, gb = toxicity.gradient(w, b, p, u, p.weight / p.weight.sum(), u.weight / u.weight.sum(), prior)
        first, rest = risk(w, b, p, u, prior)
        whole = (lambda *a: sum(risk(*a))) if rest >= 0 else (lambda *a: -risk(*a)[1])
        for i in range(7):
            step = np.zeros(7)
            step[i] = 1e-6
            high, low = whole(w + step[:6], b + step[6], p, u, prior), whole(w - step[:6], b - step[6], p, u, prior)
            assert abs((high - low) / 2e-6 - np.append(gw, gb)[i]) < 1e-5
