"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Rows whose labels must not be learnt from; a null id is not held out, as no label names it."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(id, y) of the rows that may be learnt from; of several labels of an id the greatest holds."""
    usable = labels.where(labels[id_col].isNotNull() & labels[label].isNotNull() & ~held_out(labels[id_col]))
    return usable.groupBy(usable[id_col].alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))


def first_by_hash(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded hash of ``_id``: the same rows whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(n)


def texts_of(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sampled rows with one text each (the smallest, where an id has several)."""
    rows = docs.select(docs[id_col].alias("_doc"), docs[text_col].alias("_text"))
    both = sample.join(rows, sample["_id"] == rows["_doc"])
    return both.groupBy(*sample.columns).agg(F.min("_text").alias("text"))
