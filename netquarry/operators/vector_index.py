"""A cluster index for similarity search whose pruned search is exact.

Centres are fitted on a bounded sample; every row of the collection goes to
the list of its nearest centre, stored as a partition, with its distance to
the centre. For unit vectors distance and cosine similarity order rows alike,
and by the triangle inequality a row of a list is no nearer to a query than
the query is to the centre less the row's own distance to it. A search reads
the nearest lists first and then only those lists, and those rows in them,
that the distance of the k-th row found so far doesn't rule out.

Rows whose vector is null, empty or zero have no similarity and are in no list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.operators.vectors import top_k
from netquarry.session import stage

#: Slack for rounding when distances are compared.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: the collection with ``_list`` (partition) and ``_far``, the distance to its centre; ``lists``:
    list, centre, radius and number of rows of each list."""

    rows: DataFrame
    lists: DataFrame
    embedding: str


@dataclass(frozen=True)
class Found:
    """The k most similar rows, and which lists the search read, of how many."""

    rows: DataFrame
    lists_read: tuple[int, ...]
    lists: int


def _doubles(column: Column) -> Column:
    return F.transform(column, lambda x: x.cast("double"))


def unit(column: Column) -> Column:
    """The vector at length one; null without a direction."""
    squares = F.aggregate(_doubles(column), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.when(squares > 0, F.transform(_doubles(column), lambda x: x / F.sqrt(squares)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def build(collection: DataFrame, embedding: str = "embedding", lists: int = 64, sample: int = 20_000, seed: int = 7) -> VectorIndex:
    """Fit centres on the first ``sample`` rows by a hash of their vector, and store every row in its list.

    Only the centres, ``lists`` vectors, pass through the driver.
    """
    spark = collection.sparkSession
    rows = collection.withColumn("_unit", unit(F.col(embedding))).where("_unit IS NOT NULL").withColumn("_vector", array_to_vector("_unit"))
    first = rows.select("_vector", F.xxhash64(F.lit(seed), "_unit").alias("_hash")).orderBy("_hash").limit(sample)
    model = KMeans(k=lists, featuresCol="_vector", predictionCol="_list", seed=seed, maxIter=15).fit(stage(first.select("_vector"), "index-sample"))
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "_at int, _centre array<double>")
    placed = model.transform(rows).join(F.broadcast(centres), F.col("_list") == F.col("_at"))
    kept = placed.withColumn("_far", distance(F.col("_unit"), F.col("_centre"))).select(*collection.columns, "_far", "_list")
    stored = stage(kept.repartition("_list", F.pmod(F.xxhash64(embedding), F.lit(8))), "index-rows", ("_list",))
    sizes = stored.groupBy("_list").agg(F.max("_far").alias("radius"), F.count(F.lit(1)).alias("n"))
    facts = sizes.join(F.broadcast(centres), F.col("_list") == F.col("_at")).select("_list", "_centre", "radius", "n")
    return VectorIndex(stored, stage(facts, "index-lists"), embedding)


def search(index: VectorIndex, query: list[float], k: int, where: dict[str, object] | None = None, tie: str = "doc_id") -> Found:
    """The k rows most similar to a query, exactly as ``vectors.top_k`` over the whole collection gives them."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    near = index.lists.select("_list", "radius", "n", distance(unit(vector), F.col("_centre")).alias("d"))
    lists = sorted(near.collect(), key=lambda r: (r["d"], r["_list"]))  # one line per list
    if not lists or all(r["d"] is None for r in lists):  # an empty collection, or a query without a direction
        return Found(top_k(index.rows.limit(0), vector, k, where, index.embedding, tie).drop("_far", "_list"), (), len(lists))
    first, have = [], 0
    for r in lists:
        if have >= k:
            break
        first.append(r["_list"])
        have += r["n"]

    def best(rows: DataFrame) -> DataFrame:
        return top_k(rows, vector, k, where, index.embedding, tie)

    probe = best(index.rows.where(F.col("_list").isin(*first))).select("similarity").collect()  # k numbers
    # a filter may leave the first lists with fewer than k rows: then nothing is ruled out
    reach = (2 - 2 * min(r["similarity"] for r in probe)) ** 0.5 + SLACK if len(probe) >= k else float("inf")
    left = [r for r in lists if r["d"] - r["radius"] <= reach]
    rows = index.rows.where(F.col("_list").isin(*[r["_list"] for r in left]))
    if reach < float("inf"):
        own = F.element_at(F.create_map(*[F.lit(x) for r in left for x in (r["_list"], float(r["d"]))]), F.col("_list"))
        rows = rows.where(F.abs(own - F.col("_far")) <= reach)
    read = tuple(sorted({*first, *(r["_list"] for r in left)}))
    return Found(best(rows).drop("_far", "_list"), read, len(lists))
