"""Hard negatives by segment summaries.

Of every vector and every segment of its components (all in one, then quarters,
then sixteenths) the mean and the deviation are stored. By Cauchy and Schwarz
two vectors' product over a segment differs from length times the product of
means by the product of deviations at most, so the sums over segments bound
the score. A candidate whose bounds can't reach what others are sure to reach,
or which can't lie in the score band, is dropped at the coarsest level that
shows it; the rest is refined and at last scored exactly, in whole numbers.

Anchors are a stated query set: blocks of anchors meet blocks of all rows, and
each meeting yields the best few per anchor only, so nothing but packed blocks
and short lists is shuffled. First the best positives of each anchor are found,
then, with their scores, the first negatives inside each positive's band.

Defined cases. Rows with a null id, label, vector or component take no part;
of several rows of one id the least (label, vector) stands. Shorter vectors
count as filled up with zeros. Ties go to the smaller id. A positive with a
negative score has an empty band. Scores beyond the range of a long are held at
its ends. Empty tables give empty ones; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.textkit import small_batches
from netquarry.session import stage

#: Segments of each level; widths are rounded up to a multiple of the last.
LEVELS = (1, 4, 16)
LONG = (1 << 63) - 1


class MineConfig(NamedTuple):
    """Positives per anchor, negatives per positive, the band in percent of the positive's score, rows in a block."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    block_rows: int = 16384
    anchor_rows: int = 512


def summaries(q: np.ndarray) -> np.ndarray:
    """Means, then deviations (roots of the sums of squared distances) of all levels' segments, a row per vector."""
    parts = [q.reshape(len(q), n, -1).astype(np.float64) for n in LEVELS]
    means = [p.mean(axis=2) for p in parts]
    spread = [np.sqrt(((p - m[:, :, None]) ** 2).sum(axis=2)) for p, m in zip(parts, means)]
    return np.concatenate(means + spread, axis=1)


def bounds(a: np.ndarray, b: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores that two blocks' summaries of one level allow."""
    at, n, all_ = sum(LEVELS[:level]), LEVELS[level], sum(LEVELS)
    middle = (a[:, at : at + n] * (width // n)) @ b[:, at : at + n].T
    reach = a[:, all_ + at : all_ + at + n] @ b[:, all_ + at : all_ + at + n].T
    reach += 1e-9 * (np.abs(middle) + reach) + 1e-6  # rounding never drops a candidate
    return middle - reach, middle + reach


def exact_scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Whole-number products; in doubles where none can pass 2**53, else in Python's numbers, held at a long's range."""
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG).astype(np.int64)


def _kth_best(sure: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest number of each row, minus infinity where there are fewer."""
    if sure.shape[1] < k:
        return np.full(len(sure), -np.inf)
    return np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by smaller id."""
    if len(scores) > 8 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Block:
    """A packed block: ids, labels, components, summaries and, of anchors, the bands of their positives."""

    def __init__(self, row: dict, width: int, kind: str):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.q = np.frombuffer(row["q"], kind).reshape(len(self.ids), width).astype(np.int64)
        # those of anchors are cheaper computed anew than sent to every block
        self.sums = np.frombuffer(row["sums"], np.float64).reshape(len(self.ids), -1) if row["sums"] else summaries(self.q)
        bands = np.frombuffer(row["bands"], np.int64)
        self.bands = bands.reshape(len(self.ids), -1, 2) if len(bands) else np.zeros((len(self.ids), 0, 2), np.int64)


def _survivors(a: Block, rows: slice, b: Block, cols: np.ndarray, allowed: np.ndarray, keep, width: int):
    """Refine level by level; ``keep(low, high, allowed)`` says which candidates may still count."""
    for level in range(len(LEVELS)):
        if not len(cols):
            break
        low, high = bounds(a.sums[rows], b.sums[cols], level, width)
        allowed = allowed & keep(low, high, allowed)
        left = allowed.any(axis=0)
        if not left.all():
            cols, allowed = cols[left], allowed[:, left]
    return cols, allowed


def best_positives(a: Block, b: Block, width: int, exact: bool, k: int):
    """(anchor, other, score) of each anchor's ``k`` best rows of its own label in one block."""

    def keep(low, high, allowed):
        return high >= _kth_best(np.where(allowed, low, -np.inf), k)[:, None]

    for at in range(0, len(a.ids), 64):
        rows = slice(at, at + 64)
        cols = np.flatnonzero(np.isin(b.labels, a.labels[rows]))
        allowed = (a.labels[rows, None] == b.labels[cols]) & (a.ids[rows, None] != b.ids[cols])
        cols, allowed = _survivors(a, rows, b, cols, allowed, keep, width)
        if not len(cols):
            continue
        scores = exact_scores(a.q[rows], b.q[cols], exact)
        for i, anchor in enumerate(a.ids[rows]):
            own = np.flatnonzero(allowed[i])
            for j in own[_first(scores[i, own], b.ids[cols[own]], k)]:
                yield int(anchor), int(b.ids[cols[j]]), int(scores[i, j])


def banded_negatives(a: Block, b: Block, width: int, exact: bool, k: int):
    """(anchor, band number, other, score) of the ``k`` best rows of other labels inside each band in one block."""
    n_bands = a.bands.shape[1]

    def keep_for(rows):
        def keep(low, high, allowed):
            out = np.zeros_like(allowed)
            for r in range(n_bands):
                floor, ceiling = (a.bands[rows, r, side].astype(np.float64)[:, None] for side in (0, 1))
                sure = allowed & (low >= floor) & (high <= ceiling)
                least = np.maximum(floor, _kth_best(np.where(sure, low, -np.inf), k)[:, None])
                out |= (high >= least) & (low <= ceiling) & (floor <= ceiling)
            return out

        return keep

    for at in range(0, len(a.ids), 64):
        rows = slice(at, at + 64)
        cols = np.arange(len(b.ids))
        allowed = a.labels[rows, None] != b.labels
        cols, allowed = _survivors(a, rows, b, cols, allowed, keep_for(rows), width)
        if not len(cols):
            continue
        scores = exact_scores(a.q[rows], b.q[cols], exact)
        for i, anchor in enumerate(a.ids[rows]):
            own = np.flatnonzero(allowed[i])
            found = scores[i, own]
            for r, (floor, ceiling) in enumerate(a.bands[at + i]):
                fit = own[(found >= floor) & (found <= ceiling)]
                for j in fit[_first(scores[i, fit], b.ids[cols[fit]], k)]:
                    yield int(anchor), r + 1, int(b.ids[cols[j]]), int(scores[i, j])


def usable(rows: DataFrame, id_col: str, vector: str, label: str, anchor: str) -> DataFrame:
    """(id, label, vector, anchor): one complete row per id."""
    own = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.col(vector).cast("array<bigint>").alias("vector"), F.coalesce(F.col(anchor), F.lit(False)).alias("anchor"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    one = own.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v"), F.max("anchor").alias("anchor"))
    return stage(one.select("id", "v.label", "v.vector", "anchor"), "mine-rows")


PACKED = "block bigint, ids binary, labels binary, q binary, sums binary, bands binary"


def packed(rows: DataFrame, count: int, size: int, width: int, kind: str, sums: bool) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows, dealt by a hash of the id, as one packed row each; and their number.

    ``kind`` is the numbers' type, ``sums`` says whether to store summaries.
    ``rows`` may have ``bands``, an array of (floor, ceiling) pairs per anchor.
    """
    blocks = max(1, -(-count // size))
    bands = F.col("bands") if "bands" in rows.columns else F.array().cast("array<bigint>")
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "label", "vector", bands.alias("bands"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        vectors = table.column("vector").combine_chunks()
        lengths = np.diff(np.asarray(vectors.offsets))
        flat = np.asarray(vectors.flatten(), np.int64)
        q = np.zeros((len(table), width), np.int64)
        row = np.repeat(np.arange(len(table)), lengths)
        q[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        out = {
            "block": [table.column("block")[0].as_py()],
            "ids": [np.asarray(table.column("id"), np.int64).tobytes()],
            "labels": [np.asarray(table.column("label"), np.int64).tobytes()],
            "q": [q.astype(kind).tobytes()],
            "sums": [summaries(q).tobytes() if sums else b""],
            "bands": [np.asarray(table.column("bands").combine_chunks().flatten(), np.int64).tobytes()],
        }
        return pa.table(out, schema=schema)

    schema = pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n in ("ids", "labels", "q", "sums", "bands")]])
    return stage(dealt.groupBy("block").applyInArrow(pack, PACKED), "mine-blocks"), blocks


def meet(anchors: DataFrame, data: DataFrame, blocks: int, width: int, kind: str, fn, schema: str) -> DataFrame:
    """``fn(anchor block, data block)`` for every pair of blocks.

    The anchors, the fewer rows, are sent to every block of data, which is
    shuffled once; a task works on one pair of blocks at a time.
    """
    parts = min(blocks, 4096)
    sent = anchors.select(
        *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "block"], F.col("block").alias("a_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
    )
    pairs = sent.repartition(parts, "block").join(data.drop("bands").repartition(parts, "block"), "block")
    small_batches(pairs)
    types = {"anchor_id": pa.int64(), "rank": pa.int32(), "other_id": pa.int64(), "score": pa.int64()}
    names = [part.split()[0] for part in schema.split(", ")]
    target = pa.schema([(n, types[n]) for n in names])
    fields = ("ids", "labels", "q", "sums", "bands")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                a = Block({f: row[f"a_{f}"] for f in fields}, width, kind)
                out = list(fn(a, Block({f: row.get(f) or b"" for f in fields}, width, kind)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], names)

    return pairs.mapInArrow(run, schema)


def mine(
    rows: DataFrame, id_col: str = "id", vector: str = "vector", label: str = "label", anchor: str = "anchor", cfg: MineConfig = MineConfig()
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``vector`` holds whole numbers, ``anchor`` marks the query set.

    Per anchor and each of its best positives, the first negatives with a
    score between ``low`` and ``high`` percent of the positive's.
    """
    own = usable(rows, id_col, vector, label, anchor)
    facts = own.agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("vector")).alias("width"),
        F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("decimal(20,0)"))))).alias("most"),
    ).first()
    step = LEVELS[-1]
    width = max(step, -(-(facts["width"] or 0) // step) * step)
    exact = width * int(facts["most"] or 0) ** 2 < 1 << 53
    kind = next((k for k in ("int16", "int32") if int(facts["most"] or 0) < 1 << (8 * np.dtype(k).itemsize - 1)), "int64")
    data, blocks = packed(own, facts["n"], cfg.block_rows, width, kind, True)
    anchors = own.where("anchor")
    asked, _ = packed(anchors, facts["anchors"], cfg.anchor_rows, width, kind, False)

    found = meet(
        asked, data, blocks, width, kind, lambda a, b: best_positives(a, b, width, exact, cfg.positives),
        "anchor_id bigint, other_id bigint, score bigint",
    )
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), F.asc("other_id"))
    positives = stage(
        found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cfg.positives), "mine-positives"
    )
    # whole-number borders of 100 * negative >= low * positive and 100 * negative <= high * positive
    score = F.col("score").cast("decimal(25,0)")
    floor, ceiling = F.ceil(score * cfg.low / 100).cast("bigint"), F.floor(score * cfg.high / 100).cast("bigint")
    bands = positives.groupBy(F.col("anchor_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("place", floor.alias("floor"), ceiling.alias("ceiling")))).alias("b")
    )
    empty = F.array(F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))
    filled = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(cfg.positives - 1)), lambda i: F.when(
        i < F.size("b"), F.array(F.get("b", i)["floor"], F.get("b", i)["ceiling"])
    ).otherwise(empty)))
    banded = anchors.join(bands, "id").select("id", "label", "vector", filled.alias("bands"))
    asked, _ = packed(banded, facts["anchors"], cfg.anchor_rows, width, kind, False)
    found = meet(
        asked, data, blocks, width, kind, lambda a, b: banded_negatives(a, b, width, exact, cfg.negatives),
        "anchor_id bigint, rank int, other_id bigint, score bigint",
    )
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), F.asc("other_id"))
    negatives = found.withColumnRenamed("rank", "place").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.negatives)
    best = positives.select("anchor_id", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(best, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
