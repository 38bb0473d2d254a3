"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.session import stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes of the edges; the component is its least node.

    Large-star and small-star rounds (Kiveris et al., 2014): every node hands
    its greater neighbours, then its smaller ones, to the least node it knows,
    until every node leads straight to the least of its component. Every step is a
    combining minimum and one join, so a node with very many edges is summed
    before it is shuffled; each round is a table in the shared folder. Edges
    with a null end and loops are left out; nodes that have only such edges
    have no row.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while _unsettled(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # the greater neighbours of u go to the least it knows, itself included
        large = stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = stage(small.where("u <> v").distinct(), "components")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stage(nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")


def _unsettled(links: DataFrame) -> bool:
    """Whether some node leads to two others, or is led to and leads on."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        links.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    return not ends.groupBy("n").agg(F.sum("out").alias("o"), F.max("into").alias("i")).where("o > 1 OR (o = 1 AND i = 1)").isEmpty()
