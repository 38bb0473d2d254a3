"""Router and firewall evidence per address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions import net
from netquarry.operators.devices import infrastructure_type
from netquarry.operators.netmap import infrastructure_hint


def dhcp_gateways(profile: DataFrame) -> DataFrame:
    """(ip, subnet) from the DHCP router option; the subnet of a client, else
    the gateway's own."""
    clients = F.filter(F.transform("clients", lambda c: net.subnet24(F.trim(c))), lambda s: s.isNotNull())
    subnet = F.coalesce(F.get(clients, F.lit(0)), net.subnet24("gateway_ip"))
    return profile.select(F.col("gateway_ip").alias("ip"), subnet.alias("subnet")).where(F.col("subnet").isNotNull()).distinct()


def snmp_infrastructure(node_table: DataFrame) -> DataFrame:
    """(ip, snmp_type) where the SNMP model names a network device."""
    return (
        node_table.select("ip", infrastructure_type(F.col("device_model")).alias("snmp_type"))
        .where(F.col("snmp_type").isNotNull())
        .groupBy("ip").agg(F.min("snmp_type").alias("snmp_type"))
    )


def subnet_gateways(edge_table: DataFrame, least_clients: int = 3) -> DataFrame:
    """(ip, subnet) for .1 and .254 addresses with enough clients of their own
    /24 at one node."""
    own, peer = net.subnet24("dst"), net.subnet24("src")
    return (
        edge_table.where(net.is_internal("dst") & F.col("dst").rlike(r"\.(1|254)$") & (own == peer))
        .groupBy("sensor_id", "vlan", F.col("dst").alias("ip"))
        .agg(F.countDistinct("src").alias("_n"))
        .where(F.col("_n") >= least_clients)
        .select("ip", net.subnet24("ip").alias("subnet"))
        .distinct()
    )


def cross_subnet_sources(edge_table: DataFrame) -> DataFrame:
    """(ip, subnet) of other internal /24s that reach an internal node."""
    rows = edge_table.where(net.is_internal("dst") & net.is_internal("src"))
    return (
        rows.select("sensor_id", "vlan", F.col("dst").alias("ip"), net.subnet24("src").alias("subnet"))
        .where(F.col("subnet") != net.subnet24("ip"))
        .distinct()
    )


def cross_subnet_gateways(edge_table: DataFrame, least: int = 6) -> DataFrame:
    """(ip, subnets_in): the most other subnets seen at one node."""
    return (
        cross_subnet_sources(edge_table).groupBy("sensor_id", "vlan", "ip")
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        .groupBy("ip").agg(F.max("n").alias("subnets_in"))
    )


def vendor_infrastructure(node_table: DataFrame) -> DataFrame:
    """(ip, vendor_hint) for internal nodes with a network vendor's MAC."""
    return (
        node_table.where("is_internal").select("ip", infrastructure_hint("vendor").alias("vendor_hint"))
        .where(F.col("vendor_hint") != "")
        .groupBy("ip").agg(F.min("vendor_hint").alias("vendor_hint"))
    )


def infrastructure_evidence(
    dhcp: DataFrame | None = None, snmp: DataFrame | None = None, subnet: DataFrame | None = None,
    cross: DataFrame | None = None, vendor: DataFrame | None = None,
) -> DataFrame:
    """Evidence points and the type they suggest, one row per address."""
    parts = []
    if snmp is not None:
        parts.append(snmp.select("ip", "snmp_type"))
    if dhcp is not None:
        parts.append(dhcp.select("ip").distinct().withColumn("_dhcp", F.lit(True)))
    if vendor is not None:
        parts.append(vendor.select("ip", "vendor_hint"))
    if subnet is not None:
        parts.append(subnet.select("ip").distinct().withColumn("_subnet", F.lit(True)))
    if cross is not None:
        parts.append(cross.select("ip", "subnets_in"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "ip", "full_outer")
    blank = {"snmp_type": "string", "_dhcp": "boolean", "vendor_hint": "string", "_subnet": "boolean", "subnets_in": "bigint"}
    for name, kind in blank.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    points = (
        F.when(F.col("snmp_type").isNotNull(), 2).otherwise(0)
        + F.when(F.col("_dhcp"), 2).otherwise(0)
        + F.when(F.col("vendor_hint").isNotNull(), 1).otherwise(0)
        + F.when(F.col("_subnet"), 1).otherwise(0)
        + F.when(F.col("subnets_in") >= 8, 2).when(F.col("subnets_in").isNotNull(), 1).otherwise(0)
    )
    kind = F.coalesce(
        F.col("snmp_type"), F.when(F.col("_dhcp"), F.lit("router")),
        F.when(F.contains("vendor_hint", F.lit("firewall")), F.lit("firewall")).when(F.col("vendor_hint").isNotNull(), F.lit("router")),
        F.when(F.col("_subnet") | F.col("subnets_in").isNotNull(), F.lit("router")),
    )
    evidence = F.filter(
        F.array(
            F.when(F.col("_dhcp"), F.lit("DHCP router option")),
            F.concat(F.lit("SNMP model: "), "snmp_type"),
            F.when(F.col("_subnet"), F.lit("Subnet gateway address")),
            F.concat(F.lit("Reached from "), F.col("subnets_in").cast("string"), F.lit(" other subnets")),
            F.concat(F.lit("Network vendor: "), "vendor_hint"),
        ),
        lambda e: e.isNotNull(),
    )
    return out.select("ip", points.alias("infra_points"), kind.alias("infra_type"), evidence.alias("gateway_evidence"))


def gateway_subnets(dhcp: DataFrame | None, subnet: DataFrame | None, cross: DataFrame | None, edge_table: DataFrame | None) -> DataFrame:
    """(ip, subnet) each gateway candidate serves, all kinds of evidence."""
    parts = [p.select("ip", "subnet") for p in (dhcp, subnet) if p is not None]
    if cross is not None and edge_table is not None:
        parts.append(cross_subnet_sources(edge_table).select("ip", "subnet").join(cross.select("ip"), "ip", "left_semi"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
