"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

Every token has a sparse ternary index vector drawn from its hash; a token's
context vector is the sum of the index vectors of its neighbours, two words
to either side, over the whole corpus. Tokens are hashed words and word
shapes (length, case, symbols, repetition), each hashed into a fixed number
of rows, so that the gathered table is bounded while its counts grow with the
corpus. Each task sums its own table; the tables are added in one aggregate.

A document is the mean of its tokens' scaled context vectors, which a
two-layer numpy network turns into a logit. The network is fitted on a
bounded sample of labelled rows; part of it sets the temperature that divides
the logits, so that scores are calibrated probabilities.

Null or empty texts are pooled to zero and get the score of that vector;
repeated rows get equal scores; with labels of one kind only, or none, every
score is the share of good labels (one half without any). Labels that are
null or whose id is null are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm import labelled, textkit


@dataclass(frozen=True)
class NetConfig:
    """sample: most labelled rows to fit on; word_rows, shape_rows: rows of the gathered table."""

    sample: int = 8000
    word_rows: int = 8192
    shape_rows: int = 512
    dims: int = 64
    hidden: int = 32
    epochs: int = 60
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-3
    calibration: float = 0.25
    threshold: float = 0.5
    seed: int = 5


_LETTER = np.zeros(256, np.int8)  # 1 lower, 2 upper, 3 digit, 4 beyond ASCII; 0 other signs
_LETTER[97:123], _LETTER[65:91], _LETTER[48:58], _LETTER[128:] = 1, 2, 3, 4
_SIGN = np.zeros(256, bool)
_SIGN[[33, *range(35, 39), 42, 47, 60, 62, 64, 92, 94, 95, 124, 126]] = True


def tokens(w: textkit.Words, cfg: NetConfig) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of each word's own token and of its shape."""
    word = (w.hashes % np.uint64(cfg.word_rows)).astype(np.int64)
    if not len(word):
        return word, word

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[w.ends] - sums[w.starts]

    kind = _LETTER[w.data]
    size = w.ends - w.starts
    echo = np.zeros(len(word), bool)
    echo[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])
    upper, first = count(kind == 2), _LETTER[w.data[w.starts]] == 2
    shape = np.searchsorted([2, 3, 5, 8, 12, 18, 30], size, side="right")  # 0 to 7
    for flag in (count((kind == 1) | (kind == 4)) > 0, upper > first, first, count(_SIGN[w.data]) > 0, count(kind == 3) > 0, echo):
        shape = shape * 2 + flag
    return word, cfg.word_rows + shape % cfg.shape_rows


def index_vectors(cfg: NetConfig) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the two non-zero places of its index vector and their signs."""
    h = textkit.mix(np.arange(cfg.word_rows + cfg.shape_rows, dtype=np.uint64) + np.uint64(cfg.seed << 32))
    places = np.stack([h % np.uint64(cfg.dims), (h >> np.uint64(16)) % np.uint64(cfg.dims)]).astype(np.int64)
    signs = np.stack([(h >> np.uint64(40)) & np.uint64(1), (h >> np.uint64(41)) & np.uint64(1)]).astype(np.int64) * 2 - 1
    return places, signs


def context_counts(docs: DataFrame, cfg: NetConfig, text_col: str = "text") -> DataFrame:
    """(row, d0..): the sums of neighbours' index vectors over all texts."""
    rows, dims = cfg.word_rows + cfg.shape_rows, cfg.dims

    def run(batches):
        places, signs = index_vectors(cfg)
        table = np.zeros(rows * dims, np.int64)
        for part in textkit.slices(batches):
            w = textkit.Words(part.column("text"))
            word, shape = tokens(w, cfg)
            up, down = [], []
            for gap in (1, 2):
                at = np.flatnonzero(w.text[gap:] == w.text[:-gap]) if len(word) > gap else np.zeros(0, np.int64)
                for target, source in ((at, at + gap), (at + gap, at)):
                    bases = [mine[target] * dims for mine in (word, shape)]
                    for near in (word[source], shape[source]):
                        for k in (0, 1):
                            place, sign = places[k][near], signs[k][near] > 0
                            for base in bases:
                                cell = base + place
                                up.append(cell[sign])
                                down.append(cell[~sign])
            if up:
                table += np.bincount(np.concatenate(up), minlength=rows * dims)
                table -= np.bincount(np.concatenate(down), minlength=rows * dims)
        table = table.reshape(rows, dims)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_pydict({"row": used} | {f"d{i}": table[used, i] for i in range(dims)})

    schema = ", ".join(["row bigint", *(f"d{i} bigint" for i in range(dims))])
    parts = docs.select(docs[text_col].alias("text")).mapInArrow(run, schema)
    return parts.groupBy("row").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(dims)))


def word_vectors(docs: DataFrame, cfg: NetConfig, text_col: str = "text") -> np.ndarray:
    """The gathered table, each row scaled to length one (rows never seen stay zero)."""
    table = np.zeros((cfg.word_rows + cfg.shape_rows, cfg.dims), np.float32)
    for r in context_counts(docs, cfg, text_col).collect():  # one row per table row at most
        table[r[0]] = r[1:]
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.where(size > 0, size, 1)


def pooled(part: pa.RecordBatch, vectors: np.ndarray, cfg: NetConfig, texts: int = 128) -> np.ndarray:
    """The mean vectors of each text's words and of its shapes, side by side.

    A few texts at a time are counted by table row, and the counts multiplied
    with the table.
    """
    w = textkit.Words(part.column("text"))
    out = np.zeros((part.num_rows, 2 * cfg.dims), np.float32)
    both = tokens(w, cfg)
    spans = ((0, cfg.word_rows), (cfg.word_rows, cfg.word_rows + cfg.shape_rows))
    for start in range(0, part.num_rows, texts):
        end = min(part.num_rows, start + texts)
        own = slice(w.first[start], w.first[end])
        n = np.maximum(1, w.counts[start:end])[:, None]
        for i, (rows, (low, high)) in enumerate(zip(both, spans)):
            width = high - low
            cells = (w.text[own] - start) * width + rows[own] - low
            counts = np.bincount(cells, minlength=(end - start) * width).reshape(end - start, width).astype(np.float32)
            out[start:end, i * cfg.dims : (i + 1) * cfg.dims] = counts @ vectors[low:high] / n
    return out


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, cfg: NetConfig) -> Network:
    """Adam on the logistic loss of all but the calibration rows, which then set the temperature."""
    rng = np.random.Generator(np.random.PCG64(cfg.seed))
    x, y = x.astype(np.float64), y.astype(np.float64)
    order = rng.permutation(len(y))
    cut = int(len(y) * cfg.calibration)
    held, used = order[:cut], order[cut:]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    d = x.shape[1]
    p = [rng.normal(size=(d, cfg.hidden)) * np.sqrt(2 / d), np.zeros(cfg.hidden), rng.normal(size=cfg.hidden) / np.sqrt(cfg.hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(cfg.epochs):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // cfg.batch)):
            h = np.maximum(0, z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(g, p[2]) * (h > 0)
            grads = [z[rows].T @ back + cfg.decay * p[0], back.sum(axis=0), h.T @ g + cfg.decay * p[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * v[i] + 0.001 * grad * grad
                p[i] = p[i] - cfg.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if not cut:
        return net
    logits, truth = net.logits(x[held]), y[held]

    def loss(t: float) -> float:
        s = logits / t
        return float(np.mean(np.logaddexp(0, s) - truth * s))

    best = min(np.geomspace(1, 16, 65), key=loss)
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(best))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, cfg: NetConfig, id_col: str, text_col: str, label_col: str) -> Network | float:
    """The network, or the share of good labels where there are not both kinds."""
    known = labelled.training_labels(labels, label_col, id_col)
    sample = labelled.texts_of(docs, labelled.first_by_hash(known, cfg.sample, cfg.seed), id_col, text_col)

    def rows(part: pa.RecordBatch) -> dict:
        return {"y": part.column("y"), "x": pa.array([r.tobytes() for r in pooled(part, vectors, cfg)], pa.binary())}

    got = textkit.map_arrow(sample.select("_id", "y", "text"), rows, "y int, x binary").collect()
    y = np.array([r["y"] for r in got])
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    order = np.lexsort([*x.T[:4], y])  # whatever order the rows came in
    return fit(x[order], y[order], cfg)


def score_quality(docs: DataFrame, labels: DataFrame, cfg: NetConfig = NetConfig(), id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """All input columns and ``score``, the calibrated probability that a text is good."""
    vectors = word_vectors(docs, cfg, text_col)
    net = train(docs, labels, vectors, cfg, id_col, text_col, label_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at = f"c{docs.columns.index(text_col)}"

    def rows(part: pa.RecordBatch) -> dict:
        if isinstance(net, float):
            scores = np.full(part.num_rows, net)
        else:
            scores = net.scores(pooled(pa.record_batch({"text": part.column(text_at)}), vectors, cfg))
        return {c: part.column(c) for c in names} | {"score": scores}

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return textkit.map_arrow(docs.toDF(*names), rows, f"{kinds}, score double", text=text_at).toDF(*docs.columns, "score")


def classify(docs: DataFrame, labels: DataFrame, cfg: NetConfig = NetConfig(), id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    scored = score_quality(docs.select(docs[id_col], docs["text"]), labels, cfg, id_col)
    return scored.select(
        id_col, labelled.held_out(F.col(id_col)).alias("held_out"), "score",
        (F.col("score") >= cfg.threshold).cast("int").alias("predicted"),
    )
