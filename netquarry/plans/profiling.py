"""Device profiling: protocol logs and connections to classified nodes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.operators import devices, gateways, netmap, profiles
from netquarry.operators.common import sorted_values
from netquarry.operators.netmap import NODE
from netquarry.session import stage


#: Profiles that more than one operator reads.
SHARED = ("rdp", "dhcp", "dhcp_extended", "smtp_banner", "dhcp_gateway", "server", "client", "kerberos")


@dataclass(frozen=True)
class NetworkMap:
    nodes: DataFrame
    edges: DataFrame
    services: DataFrame
    names: DataFrame


def build_map(
    connections: DataFrame, dns: DataFrame | None = None, ntlm: DataFrame | None = None, staged: bool = False
) -> NetworkMap:
    """Nodes, edges, services and names from the telemetry; ``staged`` writes
    the edge, service and node tables once to the shared folder."""
    keep = stage if staged else (lambda df, name: df)
    edges = keep(netmap.edges(connections), "edges")
    services = keep(netmap.services(connections), "services")
    nodes = keep(netmap.nodes(edges, services), "nodes")
    names = None
    for part in (
        netmap.answer_names(dns) if dns is not None else None,
        netmap.ntlm_names(ntlm) if ntlm is not None else None,
    ):
        if part is not None:
            names = part if names is None else names.unionByName(part)
    if names is None:
        names = nodes.limit(0).select(*NODE, F.lit("").alias("kind"), F.lit("").alias("name"))
    return NetworkMap(nodes, edges, services, names)


def profile_map(
    net_map: NetworkMap, logs: Mapping[str, DataFrame], oui: DataFrame | None = None, previous: DataFrame | None = None,
    staged: bool = False,
) -> DataFrame:
    """Nodes with facts, names, infrastructure evidence and device type.

    The profiles are independent aggregates joined once per address; nothing
    loops over devices. ``staged`` writes what several operators read once:
    the profiles of ``SHARED``, the fact table (one row per address), the
    names, the evidence and the enriched nodes.
    """
    keep = stage if staged else (lambda df, name: df)
    results = profiles.run_profiles(logs)
    results |= {n: keep(results[n], f"profile-{n}") for n in SHARED if n in results}
    facts = keep(devices.facts(results, net_map.nodes), "facts")
    nodes = devices.enrich_nodes(net_map.nodes, facts, oui)
    names = net_map.names
    if any(n in results for n in ("smb", "rdp", "dhcp", "dhcp_extended", "smtp_banner")):
        names = names.unionByName(devices.node_names_from_ip(devices.profile_names(results), net_map.nodes)).distinct()
    names = keep(names, "names")
    nodes = devices.attach_names(nodes, names)
    if "x509" in logs:
        certificates = keep(devices.certificate_rows(logs["x509"]), "certificates")
        matches = keep(devices.certificate_matches(names, certificates.select("cert_sensor", "cn").distinct()), "certificate-matches")
        nodes = devices.attach_certificates(nodes, matches, devices.certificate_issuers(matches, certificates))
    if "ntlm" in logs:
        rows = profiles.ntlm_rows(logs["ntlm"]).withColumnRenamed("ts", "timestamp")
        nodes = devices.attach_domain(nodes, netmap.ntlm_domains(rows))
        heavy = keep(devices.heavy_ntlm_servers(rows), "heavy-ntlm")
    else:
        heavy = None
    nodes = keep(nodes, "enriched")
    dhcp = gateways.dhcp_gateways(results["dhcp_gateway"]) if "dhcp_gateway" in results else None
    cross = keep(gateways.cross_subnet_gateways(net_map.edges), "cross-subnet")
    subnet = keep(gateways.subnet_gateways(net_map.edges), "subnet")
    evidence = keep(gateways.infrastructure_evidence(
        dhcp, gateways.snmp_infrastructure(nodes), subnet, cross, gateways.vendor_infrastructure(nodes),
    ), "evidence")
    served = net_map.services.select("ip", "port")
    if "conn" in logs:
        values = profiles.profile_values(logs["conn"], "server").select("ip", F.col("value").try_cast("int").alias("port"))
        served = served.unionByName(values)
        server, client = results["server"], results["client"]
    else:
        e = net_map.edges.groupBy("src", "dst").agg(F.sum("n").alias("n"))
        server = e.groupBy(F.col("dst").alias("ip")).agg(F.count(F.lit(1)).alias("unique_clients"))
        client = e.groupBy(F.col("src").alias("ip")).agg(
            F.count(F.lit(1)).alias("unique_destinations"), F.sum("n").alias("outgoing_count")
        )
    kdc = devices.kerberos_servers(results["kerberos"]) if "kerberos" in results else None
    typed = devices.device_types(nodes, served, server, client, kdc, heavy, evidence, previous)
    serves = sorted_values(gateways.gateway_subnets(dhcp, subnet, cross, net_map.edges), ["ip"], "subnet", "is_gateway_for")
    typed = typed.join(evidence.select("ip", "gateway_evidence"), "ip", "left").join(serves, "ip", "left")
    typed = keep(typed.withColumn("is_gateway_for", F.coalesce("is_gateway_for", F.array().cast("array<string>"))), "typed")
    identity = devices.host_identity(typed).select(*NODE, F.col("os").alias("host_id"))
    return typed.join(identity, NODE, "left")
