"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the texts of a second sample of
labelled rows, their labels hidden, are the unlabelled. Linear classifiers
minimise the class-prior-corrected risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

with the logistic loss; where the second term falls below zero its gradient
is turned round, as in the non-negative estimator of Kiryo et al. (2017).
The prior is the toxic share among all labelled training rows.

Features are the lower-cased words and their first 3 to 8 bytes (a stem with
many endings is one feature), each at several levels of count and of rate per
word, so that a stem that is common in a language counts only where it is
dense. Those found in positives far more often than their rate among the
unlabelled explains are kept. Near copies inside a sample share one weight,
so that a much-copied text does not teach its own words. The score is the
sigmoid of the mean logit of the classifiers.

Both samples are bounded by ``PuConfig``; every row of the input is scored
over its whole text. Null or empty texts get the score of a text without
words; repeated rows get equal scores; without a positive all scores are 0.
Labels that are null or whose id is null are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import labelled, textkit
from netquarry.session import stage


@dataclass(frozen=True)
class PuConfig:
    """positives, unlabelled: most rows of either sample; threshold: of ``predicted``."""

    positives: int = 2500
    unlabelled: int = 6000
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 8)
    counts: tuple[int, ...] = (1, 2, 4, 8)
    per_words: tuple[int, ...] = (100, 25, 10)
    least_docs: float = 3.0
    least_z: float = 4.0
    features: int = 4096
    classifiers: int = 3
    rounds: int = 250
    rate: float = 0.1
    l2: float = 5e-5
    threshold: float = 0.7
    seed: int = 11


BITS = 32
_MASK = (1 << BITS) - 1


def _leveled(stems: np.ndarray, level: int) -> np.ndarray:
    return (textkit.mix((stems + (level << BITS)).astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def text_features(part: pa.RecordBatch, cfg: PuConfig, stems: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of a slice, by text; of the given stems only, where they are given (sorted)."""
    w = textkit.Words(part.column("text"), textkit.ASCII_BREAKS, lower=True)
    hashes, owners = [w.hashes], [w.text]
    for size in cfg.prefixes:
        h, at = w.prefixes(size)
        hashes.append(h)
        owners.append(w.text[at])
    stem = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    owner = np.concatenate(owners).astype(np.int64)
    if stems is not None:
        known = _among(stem, stems)
        stem, owner = stem[known], owner[known]
    keys, n = np.unique((owner << BITS) | stem, return_counts=True)
    text, stem = keys >> BITS, keys & _MASK
    words = w.counts[text]
    levels = [n >= c for c in cfg.counts] + [(n >= 2) & (n * r >= words) for r in cfg.per_words]
    out = np.unique(np.concatenate([(text[m] << BITS) | _leveled(stem[m], i) for i, m in enumerate(levels)]))
    return out >> BITS, out & _MASK


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values if len(known) else np.zeros(len(values), bool)


def featured(texts: DataFrame, cfg: PuConfig) -> DataFrame:
    """(weight, features) of every text, stored: its features' numbers and a weight that near copies share."""

    def rows(part: pa.RecordBatch) -> dict:
        text, feature = text_features(part, cfg)
        keys = np.zeros(part.num_rows, np.uint64)
        for seed in (3, 5):
            least = np.full(part.num_rows, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, text, textkit.mix(feature.astype(np.uint64) * np.uint64(textkit.STEP[seed])))
            keys = textkit.mix(keys + least)
        cuts = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
        return {"copies": keys.view(np.int64), "features": pa.ListArray.from_arrays(cuts, feature)}

    found = stage(textkit.map_arrow(texts.select("text"), rows, "copies bigint, features array<bigint>"), "toxicity-features")
    shared = found.groupBy("copies").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    return found.join(shared, "copies").select("weight", "features")


def telling(positive: DataFrame, unlabelled: DataFrame, cfg: PuConfig) -> np.ndarray:
    """The features, sorted, that positives have far more often than their rate among the unlabelled explains.

    Counted by Spark over all features of both samples; only the best, at most
    ``cfg.features``, reach the driver.
    """

    def counts(side: DataFrame, name: str) -> DataFrame:
        each = side.select("weight", F.explode("features").alias("feature"))
        return each.groupBy("feature").agg(F.sum("weight").alias(name), F.count("*").alias(f"{name}_rows"))

    p, u = (side.agg(F.sum("weight")).first()[0] or 0.0 for side in (positive, unlabelled))
    both = counts(positive, "found").where(F.col("found_rows") >= cfg.least_docs).join(counts(unlabelled, "there"), "feature", "left")
    expected = F.lit(p) * (F.coalesce("there", F.lit(0.0)) + 0.5) / (F.lit(u) + 1)
    z = F.when(F.col("found") >= cfg.least_docs, F.round((F.col("found") - expected) / F.sqrt(expected + 1), 9))
    best = both.select("feature", z.alias("z")).where(F.col("z") > cfg.least_z).orderBy(F.desc("z"), "feature").limit(cfg.features)
    return np.sort(np.array([r["feature"] for r in best.collect()], np.int64))


class Sample:
    """The given features of the texts of a sample, by their places among them."""

    def __init__(self, side: DataFrame, known: np.ndarray):
        def rows(batches):
            for batch in batches:
                lists = batch.column("features")
                values = np.asarray(lists.flatten(), np.int64)
                row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(lists)))
                kept = _among(values, known)
                cuts = np.searchsorted(row[kept], np.arange(batch.num_rows + 1)).astype(np.int32)
                places = np.searchsorted(known, values[kept]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"weight": batch.column("weight"), "places": pa.ListArray.from_arrays(cuts, places)})

        got = side.mapInArrow(rows, "weight double, places array<int>").toArrow().combine_chunks()
        self.n = got.num_rows
        lists = got["places"].combine_chunks() if self.n else pa.array([], pa.list_(pa.int32()))
        self.feature = np.asarray(lists.flatten(), np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.asarray(pc.list_value_length(lists), np.int32))
        self.weight = np.asarray(got["weight"], np.float64)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.feature], minlength=self.n)

    def sums(self, per_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, weights=per_row[self.row], minlength=size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _loss_against(scores: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.minimum(scores, 1 - 1e-12))


def gradient(w: np.ndarray, b: float, positive: Sample, unlabelled: Sample, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """The risk's gradient by weights and intercept; of the second term alone, turned round, where that is below zero."""
    sp, su = sigmoid(positive.scores(w) + b), sigmoid(unlabelled.scores(w) + b)
    if u @ _loss_against(su) - prior * (p @ _loss_against(sp)) >= 0:
        gp, gu = prior * p * (sp - 1) - prior * p * sp, u * su
    else:
        gp, gu = prior * p * sp, -u * su
    return positive.sums(gp, len(w)) + unlabelled.sums(gu, len(w)), gp.sum() + gu.sum()


def fit(positive: Sample, unlabelled: Sample, size: int, prior: float, cfg: PuConfig) -> tuple[np.ndarray, float]:
    """Mean weights and intercept of the classifiers, each on its own reweighting of the samples."""
    total, offset = np.zeros(size), 0.0
    rng = np.random.Generator(np.random.PCG64(cfg.seed))
    for _ in range(cfg.classifiers):
        p = positive.weight * rng.exponential(size=positive.n)
        u = unlabelled.weight * rng.exponential(size=unlabelled.n)
        p, u = p / p.sum(), u / u.sum()
        w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
        m, v = np.zeros(size + 1), np.zeros(size + 1)
        for step in range(1, cfg.rounds + 1):
            gw, gb = gradient(w, b, positive, unlabelled, p, u, prior)
            g = np.append(gw + cfg.l2 * w, gb)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            w, b = w - move[:-1], b - move[-1]
        total += w / cfg.classifiers
        offset += b / cfg.classifiers
    return total, offset


@dataclass(frozen=True)
class Model:
    """features: sorted numbers with their weights; stems: sorted, those that can give a feature."""

    features: np.ndarray
    weights: np.ndarray
    offset: float
    stems: np.ndarray


def train(docs: DataFrame, labels: DataFrame, cfg: PuConfig = PuConfig(), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model | None:
    known = labelled.training_labels(labels, label_col, id_col)
    counts = known.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    if not counts["toxic"]:
        return None

    def texts(rows: DataFrame, n: int, seed: int) -> DataFrame:
        return labelled.texts_of(docs, labelled.first_by_hash(rows, n, seed), id_col, text_col)

    positive = featured(texts(known.where("y = 1"), cfg.positives, cfg.seed), cfg)
    if positive.isEmpty():
        return None
    unlabelled = featured(texts(known, cfg.unlabelled, cfg.seed + 1), cfg)
    features = telling(positive, unlabelled, cfg)
    prior = min(0.9, max(1e-4, counts["toxic"] / counts["n"]))
    weights, offset = fit(Sample(positive, features), Sample(unlabelled, features), len(features), prior, cfg)
    return Model(features, weights, offset, _stems(docs, known, features, cfg, id_col, text_col))


def _stems(docs: DataFrame, known: DataFrame, features: np.ndarray, cfg: PuConfig, id_col: str, text_col: str) -> np.ndarray:
    """The stems of the positives that give one of the features at some level."""

    def rows(part: pa.RecordBatch) -> dict:
        w = textkit.Words(part.column("text"), textkit.ASCII_BREAKS, lower=True)
        stems = np.unique(np.concatenate([w.hashes, *(w.prefixes(size)[0] for size in cfg.prefixes)]) >> np.uint64(64 - BITS)).astype(np.int64)
        levels = range(len(cfg.counts) + len(cfg.per_words))
        useful = np.zeros(len(stems), bool)
        for level in levels:
            useful |= _among(_leveled(stems, level), features)
        return {"stem": stems[useful]}

    sample = labelled.texts_of(docs, labelled.first_by_hash(known.where("y = 1"), cfg.positives, cfg.seed), id_col, text_col)
    return np.sort(np.array([r["stem"] for r in textkit.map_arrow(sample.select("text"), rows, "stem bigint").distinct().collect()], np.int64))


def score_texts(docs: DataFrame, model: Model | None, cfg: PuConfig = PuConfig(), text_col: str = "text",
                out: str = "score") -> DataFrame:
    """All input columns and ``out``, the estimated probability that a text is toxic."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at = f"c{docs.columns.index(text_col)}"

    def rows(part: pa.RecordBatch) -> dict:
        scores = np.zeros(part.num_rows)
        if model is not None:
            text, feature = text_features(pa.record_batch({"text": part.column(text_at)}), cfg, model.stems)
            known = _among(feature, model.features)
            weights = model.weights[np.searchsorted(model.features, feature[known])]
            scores = sigmoid(np.bincount(text[known], weights=weights, minlength=part.num_rows) + model.offset)
        return {c: part.column(c) for c in names} | {"score": scores}

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return textkit.map_arrow(docs.toDF(*names), rows, f"{kinds}, score double", text=text_at).toDF(*docs.columns, out)


def classify(docs: DataFrame, labels: DataFrame, cfg: PuConfig = PuConfig(), id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    model = train(docs, labels, cfg, id_col)
    scored = score_texts(docs.select(docs[id_col], docs["text"]), model, cfg)
    return scored.select(
        id_col, labelled.held_out(F.col(id_col)).alias("held_out"), "score",
        (F.col("score") >= cfg.threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, cfg: PuConfig = PuConfig()) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    score = "_score"
    while score in docs.columns:
        score += "_"
    return score_texts(docs, train(docs, labels, cfg), cfg, out=score).where(F.col(score) < cfg.threshold).drop(score)
