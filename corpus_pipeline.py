"""From raw documents to sharded training data, in five stages.

Each stage takes the documents its predecessor kept, as a stored table, and
returns those it keeps with their own columns; the last returns where each
document lies: id, size, checksum, shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netquarry.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from netquarry.llm.queries import mixed, table
from netquarry.llm.semijoin import without
from netquarry.session import stage

#: Nine tenths of the tokens that are left, none twice.
MIX = mixing.MixConfig(budget=0.9, epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group."""
    return near_dedup.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in their leaf's token prefix, under the target weights."""
    rows, _ = mixed(spark, docs, MIX)
    # the leaf decides with the id: rows of one id may hang on different leaves
    left_out = stage(rows.where("copies = 0").select("doc_id", "lang", "source").distinct(), "mix-out")
    return without(docs, left_out, {c: c for c in ("doc_id", "lang", "source")})


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, in Hilbert order of its metadata."""
    return sharding.digest(sharding.hilbert_shards(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaked),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL: a trained classifier and a randomised join have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
