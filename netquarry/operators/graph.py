"""Graph view of the map: nodes, peers, edges and the Internet node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions import net
from netquarry.operators.common import top_rows
from netquarry.operators.devices import type_label, type_tier

INTERNET = "__internet__"
REST = "__rest__"


def _graphable(node_table: DataFrame) -> DataFrame:
    """Internal nodes, or every node where there is no internal one."""
    none_inside = node_table.agg((F.count_if("is_internal") == 0).alias("x")).scalar()
    return node_table.where(F.col("is_internal") | none_inside)


def view_nodes(node_table: DataFrame, max_nodes: int = 500) -> DataFrame:
    """The busiest addresses, one node each: the variant with most connections,
    with all vlans and sensors the address was seen on anywhere in the map."""
    nodes = _graphable(node_table)
    fields = [c for c in ("node_id", "sensor_id", "vlan", "is_internal", "device_type", "service_count") if c in nodes.columns]
    best = F.max_by(F.struct(*fields), F.struct("total_connections", "node_id"))
    merged = nodes.groupBy("ip").agg(
        best.alias("_b"), F.max("total_connections").alias("total_connections"),
        F.array_sort(F.collect_set("vlan")).alias("vlans"), F.array_sort(F.collect_set("sensor_id")).alias("sensors"),
    ).select("ip", "_b.*", "total_connections", "vlans", "sensors")
    return merged.orderBy(F.desc("total_connections"), F.asc("ip")).limit(max_nodes)


def _edges_of(edge_table: DataFrame, view: DataFrame, own: str) -> DataFrame:
    """Edges at the view's canonical nodes, by source or destination side."""
    ids = view.select("sensor_id", "vlan", F.col("ip").alias(own), "node_id")
    return edge_table.join(ids, ["sensor_id", "vlan", own])


def peers(edge_table: DataFrame, view: DataFrame, internal_cap: int = 30, external_cap: int = 50) -> DataFrame:
    """Busiest peers per view node, direction and side (node_id, direction,
    external, peer, n, rank)."""
    out = _edges_of(edge_table, view, "src").select("node_id", F.lit("out").alias("direction"), F.col("src").alias("own"), F.col("dst").alias("peer"), "n")
    inn = _edges_of(edge_table, view, "dst").select("node_id", F.lit("in").alias("direction"), F.col("dst").alias("own"), F.col("src").alias("peer"), "n")
    rows = out.unionByName(inn).where(F.col("own") != F.col("peer")).withColumn("external", ~net.is_internal("peer"))
    ranked = top_rows(rows, ["node_id", "direction", "external"], [F.desc("n"), F.asc("peer")], max(internal_cap, external_cap))
    cap = F.when(F.col("external"), external_cap).otherwise(internal_cap)
    return ranked.where(F.col("rank") <= cap).drop("own")


def payload(view: DataFrame, names: DataFrame | None = None, bindings: DataFrame | None = None) -> DataFrame:
    """Display columns per view node: label, subnet, tier, size, MAC count."""
    out = view
    if "device_type" not in out.columns:
        out = out.withColumn("device_type", F.lit(""))
    if names is not None:
        first = names.groupBy("ip").agg(
            F.min(F.when(F.col("kind") == "netbios", F.col("name"))).alias("_nb"),
            F.min(F.when(F.col("kind") == "hostname", F.col("name"))).alias("_host"),
        )
        out = out.join(first, "ip", "left")
    else:
        out = out.withColumns({"_nb": F.lit(None).cast("string"), "_host": F.lit(None).cast("string")})
    other_host = F.col("_host").isNotNull() & (F.substring_index(F.lower("_host"), ".", 1) != F.lower("_nb"))
    label = (
        F.when(F.col("_nb").isNotNull(), F.concat_ws("\n", "_nb", "ip", F.when(other_host, F.col("_host"))))
        .when(F.col("_host").isNotNull(), F.concat_ws("\n", "_host", "ip"))
        .when(F.col("vlan") != "0", F.concat(F.col("ip"), F.lit(" (v"), F.col("vlan"), F.lit(")")))
        .otherwise(F.col("ip"))
    )
    out = out.withColumns(
        {
            "label": label, "subnet": F.coalesce(net.subnet24("ip"), F.lit("")),
            "size": F.least(F.col("total_connections") / 10, F.lit(50.0)),
            "tier": type_tier(), "device_label": type_label(),
            "group": F.when(F.col("is_internal"), "internal").otherwise("external"),
        }
    ).drop("_nb", "_host")
    if bindings is not None and "mac_address" in out.columns:
        counts = bindings.groupBy(F.col("mac").alias("mac_address")).agg(F.countDistinct("ip").alias("mac_ip_count"))
        out = out.join(counts, "mac_address", "left").na.fill(0, ["mac_ip_count"])
    return out


def internet_edges(edge_table: DataFrame, view: DataFrame) -> DataFrame:
    """Connections from each view node to outside peers, as one edge each."""
    return (
        _edges_of(edge_table, view, "src").where(~net.is_internal("dst"))
        .groupBy(F.col("node_id").alias("from_id"))
        .agg(F.sum("n").alias("value"))
        .select("from_id", F.lit(INTERNET).alias("to_id"), "value")
    )


def internet_node(edge_table: DataFrame, view: DataFrame) -> DataFrame:
    """One row: distinct outside peers of the view and connections to them."""
    out = _edges_of(edge_table, view, "src").where(~net.is_internal("dst")).select(F.col("dst").alias("peer"), "n")
    inn = _edges_of(edge_table, view, "dst").where(~net.is_internal("src")).select(F.col("src").alias("peer"), F.lit(0).cast("bigint").alias("n"))
    per_peer = out.unionByName(inn).groupBy("peer").agg(F.sum("n").alias("n"))
    return per_peer.agg(F.count(F.lit(1)).alias("unique_ips"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_connections")).where(
        F.col("unique_ips") > 0
    ).select(F.lit(INTERNET).alias("node_id"), "unique_ips", "total_connections")


def _busiest(edge_table: DataFrame, view: DataFrame, per_source: int) -> DataFrame:
    """The edges a view draws: each node's busiest targets, as far as the view has them."""
    busiest = top_rows(
        _edges_of(edge_table, view, "src").select("node_id", "src", "dst", "n"), ["node_id"], [F.desc("n"), F.asc("dst")], per_source
    )
    targets = view.select(F.col("ip").alias("dst"), F.col("node_id").alias("to_id"))
    return busiest.join(targets, "dst").where(F.col("node_id") != F.col("to_id"))


def view_edges(edge_table: DataFrame, view: DataFrame, per_source: int = 15) -> DataFrame:
    """Undirected edges between view nodes from each one's busiest targets;
    of both directions the one with more connections stays, then the lesser
    source."""
    rows = _busiest(edge_table, view, per_source)
    a, b = F.least("node_id", "to_id").alias("a"), F.greatest("node_id", "to_id").alias("b")
    kept = rows.groupBy(a, b).agg(F.min(F.struct(F.negative("n").alias("n"), F.col("node_id").alias("from_id"), "to_id")).alias("_e"))
    return kept.select("_e.from_id", "_e.to_id", F.negative("_e.n").alias("value"))


def edge_totals(edge_table: DataFrame, view: DataFrame, per_source: int = 15) -> DataFrame:
    """Everything the map knows beside what a view draws: per source and side
    (inside, outside) all its edges and connections, those drawn and the rest.

    Sources that the view leaves out come as one node, ``REST``, so the sums
    over all rows are the map's own. Edges are summed by source address and
    side first; only these sums meet the view, and nothing is ranked but the
    edges of its nodes.
    """
    outside = F.when(net.is_internal("dst"), "inside").otherwise("outside")
    sums = edge_table.groupBy("sensor_id", "vlan", "src", outside.alias("side")).agg(
        F.count(F.lit(1)).alias("edges"), F.sum("n").alias("connections")
    )
    ids = view.select("sensor_id", "vlan", F.col("ip").alias("src"), "node_id")
    whole = sums.join(ids, ["sensor_id", "vlan", "src"], "left").groupBy(F.coalesce("node_id", F.lit(REST)).alias("node_id"), "side").agg(
        F.sum("edges").alias("edges"), F.sum("connections").alias("connections")
    )
    drawn = _busiest(edge_table, view, per_source).groupBy("node_id", outside.alias("side")).agg(
        F.count(F.lit(1)).alias("drawn_edges"), F.sum("n").alias("drawn_connections")
    )
    both = whole.join(drawn, ["node_id", "side"], "left").na.fill(0, ["drawn_edges", "drawn_connections"])
    return both.withColumns({
        "rest_edges": F.col("edges") - F.col("drawn_edges"), "rest_connections": F.col("connections") - F.col("drawn_connections"),
    })


def vlan_counts(node_table: DataFrame) -> DataFrame:
    return _graphable(node_table).groupBy("vlan").agg(F.count(F.lit(1)).alias("nodes"))
