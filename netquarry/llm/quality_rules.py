"""Quality rules whose cutoffs carry a guarantee on good documents lost.

Each rule compares one feature of the whole text with a cutoff of its own per
stratum. Cutoffs come from a labelled holdout: for every stratum and rule the
grid is walked from the mildest cutoff to the strictest (fixed-sequence
testing) and stops before the first whose exact binomial bound on the share
of good documents rejected exceeds the rule's part of the allowed risk. Of
the cutoffs passed on the way, the mildest that catches the most bad
documents is taken. The error level is split over all rules and strata (Bonferroni), so with
probability 1 - ``error`` no stratum loses more than ``risk`` of its good
documents to all rules together. Strata without enough labels get no cutoff,
and their documents are kept. The holdout is only counted: one histogram of
(stratum, rule, grid cell), which no label count can outgrow.

Null or empty texts have zeros for all features and fail the base rule; a
null stratum is a stratum. Rows are judged one by one; repeated rows give
repeated results. A label row whose label is null, or that names no document,
is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm import textkit
from netquarry.session import stage

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SPACE_CHARS = " \t\n\v\f\r"

FEATURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_lines bigint, n_repeat_words bigint, "
    "n_upper bigint, n_letters bigint, n_bangs bigint, n_echo bigint"
)


@dataclass(frozen=True)
class Rule:
    """Reject where ``feature`` is above the cutoff; the grid runs from mild to strict."""

    name: str
    feature: Column
    grid: tuple[float, ...]


@dataclass(frozen=True)
class RuleConfig:
    """risk: share of good documents that may be lost in a stratum; error: chance that it is more."""

    risk: float = 0.03
    error: float = 0.05
    min_words: int = 10
    max_repeat_percent: int = 20


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


_STEPS = tuple(x / 40 for x in range(40, 0, -1))


def default_rules() -> tuple[Rule, ...]:
    length = F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(0.0))
    return (
        Rule("symbols", _share("n_symbols", "n_words"), tuple(4 * s for s in _STEPS)),
        Rule("dup_lines", _share("n_dup_lines", "n_lines"), _STEPS),
        Rule("echoes", _share("n_echo", "n_words"), _STEPS),
        Rule("capitals", _share("n_upper", "n_letters"), _STEPS),
        Rule("long_words", length, tuple(range(60, 4, -1))),
        Rule("short_words", -length, tuple(x / 8 for x in range(-1, -65, -1))),
    )


def _features(part: pa.RecordBatch) -> dict:
    column = part.column("text")
    w = textkit.Words(column)
    n = len(column)
    inside = ~textkit.SPACES[w.data]
    points = inside & ((w.data & 0xC0) != 0x80)
    upper = (w.data >= 65) & (w.data <= 90)
    lower = (w.data >= 97) & (w.data <= 122)

    hashes, at = w.shingles(5)
    owner = w.text[at].astype(np.uint64)
    keys = textkit.mix(hashes + owner * np.uint64(textkit.STEP[7]))
    _, back, seen = np.unique(keys, return_inverse=True, return_counts=True)
    again = at[seen[back] > 1]
    marks = np.zeros(len(w.hashes) + 5, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + 5, -1)
    covered = np.cumsum(marks)[: len(w.hashes)] > 0

    echo = np.zeros(len(w.hashes), bool)
    echo[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])

    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            real = [x for x in text.split("\n") if x.strip(SPACE_CHARS)]
            dup[i], lines[i] = len(real) - len(set(real)), len(real)
        else:
            lines[i] = bool(text and text.strip(SPACE_CHARS))
    return {
        "n_words": w.counts, "word_chars": w.per_text(points), "n_symbols": w.per_text(SYMBOLS[w.data]),
        "n_dup_lines": dup, "n_lines": lines, "n_repeat_words": np.bincount(w.text[covered], minlength=n),
        "n_upper": w.per_text(upper), "n_letters": w.per_text(upper | lower), "n_bangs": w.per_text(w.data == 33),
        "n_echo": np.bincount(w.text[echo], minlength=n),
    }


def features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns ``keep`` and the text features of every document."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def rows(part: pa.RecordBatch) -> dict:
        found = _features(part)
        return {f"k{i}": part.column(f"k{i}") for i in range(len(keep))} | {c: pa.array(found[c], pa.int64()) for c in names}

    fixed = [docs[c].alias(f"k{i}") for i, c in enumerate(keep)]
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), FEATURES])
    out = textkit.map_arrow(docs.select(*fixed, docs[text_col].alias("text")), rows, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *names)


def base_failed(cfg: RuleConfig) -> Column:
    n = F.col("n_words")
    return (n < cfg.min_words) | (100 * F.col("n_repeat_words") > cfg.max_repeat_percent * n)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed from its largest term until terms vanish."""
    if k >= n:
        return 1.0
    top = min(k, int(n * p))
    log = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)
    first = total = math.exp(log)
    term = first
    for i in range(top, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < total * 1e-17:
            break
    term = first
    for i in range(top + 1, k + 1):
        term *= (n - i + 1) * p / (i * (1 - p))
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total)


def cutoffs(labelled: DataFrame, rules: tuple[Rule, ...], cfg: RuleConfig, stratum: str = "lang") -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_lost, n_caught) from labelled features (column ``good`` boolean).

    Only documents that pass the base rule are counted, as only they can be
    lost to a rule. The counting is one combining aggregate; the walk along
    the grid is one task per stratum over at most rules x grid cells.
    """
    held = labelled.where(F.col("good").isNotNull() & ~base_failed(cfg))
    cells = F.array(*[
        F.struct(F.lit(i).alias("rule"), r.feature.cast("double").alias("value"), F.lit([float(x) for x in r.grid]).alias("grid"))
        for i, r in enumerate(rules)
    ])
    caught_by = F.size(F.filter("c.grid", lambda x: F.col("c.value") > x))
    counted = (
        held.select(F.col(stratum).alias("stratum"), "good", F.explode(cells).alias("c"))
        .select("stratum", "good", "c.rule", caught_by.alias("caught_by"))
        .groupBy("stratum", "good", "rule", "caught_by")
        .agg(F.count("*").alias("n"))
    )
    named = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))  # a null stratum counts
    strata = max(1, held.agg(F.count_distinct(named)).first()[0])
    grids, part, level = [r.grid for r in rules], cfg.risk / len(rules), cfg.error / len(rules) / strata

    def walk(group):
        out = []
        for rule, rows in group.groupby("rule"):
            grid = grids[int(rule)]
            good, bad = np.zeros(len(grid) + 1, np.int64), np.zeros(len(grid) + 1, np.int64)
            for flag, cell, n in zip(rows["good"], rows["caught_by"], rows["n"]):
                (good if flag else bad)[cell] += n
            lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]  # by as many cells, or more
            n, best = int(lost[0]), None
            for step in range(len(grid)):  # a document over the mildest cutoff is over all: in the last cell
                at = len(grid) - step
                if binomial_tail(int(lost[at]), n, part) > level:
                    break
                if best is None or caught[at] > caught[best]:
                    best = at
            cut, lost_here, caught_here = (None, 0, 0) if best is None else (float(grid[len(grid) - best]), int(lost[best]), int(caught[best]))
            out.append((group["stratum"].iloc[0], int(rule), cut, n, lost_here, caught_here))
        return pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "n_good", "n_lost", "n_caught"])

    kind = labelled.schema[stratum].dataType.simpleString()
    return counted.groupBy("stratum").applyInPandas(
        walk, f"stratum {kind}, rule int, cutoff double, n_good bigint, n_lost bigint, n_caught bigint"
    )


def judge(scored: DataFrame, limits: DataFrame, rules: tuple[Rule, ...], cfg: RuleConfig, stratum: str = "lang") -> DataFrame:
    """Adds base_failed, kept and the names of the rules that reject."""
    wide = limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    both = scored.join(wide.withColumnRenamed("stratum", "_stratum"), F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    hits = [F.when(r.feature > F.col("_cutoffs")[i], F.lit(r.name)) for i, r in enumerate(rules)]
    return (
        both.withColumn("rejected_by", F.array_compact(F.array(*hits)))
        .withColumn("base_failed", base_failed(cfg))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("_cutoffs", "_stratum")
    )


def quality_rules(
    docs: DataFrame, labels: DataFrame, cfg: RuleConfig = RuleConfig(), rules: tuple[Rule, ...] | None = None,
    stratum: str = "lang", id_col: str = "doc_id", label_col: str = "quality",
) -> DataFrame:
    """Every document with its features, ``base_failed``, ``kept`` and ``rejected_by``.

    Label 1 marks a good document. ``labels`` may name an id twice; the
    greater label holds.
    """
    rules = rules or default_rules()
    scored = stage(features(docs, keep=(id_col, stratum)), "rule-features")
    marks = labels.groupBy(labels[id_col].alias("_id")).agg((F.max(label_col) == 1).alias("good")).where(F.col("good").isNotNull())
    sample = scored.join(marks, F.col(id_col) == F.col("_id"))
    return judge(scored, cutoffs(sample, rules, cfg, stratum), rules, cfg, stratum)
