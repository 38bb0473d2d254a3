"""Closest-to-threshold diagnostics for detector families that found nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.config import HuntConfig
from netquarry.functions import text
from netquarry.operators.flows import as_flows, present
from netquarry.operators.lateral import internal_pairs
from netquarry.operators.recon import scan_counts


def _top(df: DataFrame, agent: str, check: str, subject, value: str, threshold: int) -> DataFrame:
    """The largest group; ties go to the lesser subject."""
    return (
        df.select(
            F.lit(agent).alias("agent"), F.lit(check).alias("check"),
            subject.alias("subject"), F.col(value).cast("bigint").alias("value"),
            F.lit(threshold).cast("bigint").alias("threshold"),
        )
        .orderBy(F.desc("value"), F.asc("subject"))
        .limit(1)
    )


def c2_near_misses(connections: DataFrame, dns: DataFrame, cfg: HuntConfig = HuntConfig()) -> DataFrame:
    flows = as_flows(connections).where(present("source_ip") & present("destination_ip"))
    label = F.concat(
        "source_ip", F.lit("->"), "destination_ip", F.lit(":"),
        F.coalesce(F.col("destination_port").cast("string"), F.lit("")),
    )
    parents = (
        dns.select(text.parent_domain(F.lower("domain")).alias("parent"))
        .where(F.col("parent").isNotNull())
        .groupBy("parent")
        .agg(F.count(F.lit(1)).alias("queries"))
    )
    return _top(flows, "c2_hunter", "beacon", label, "connections", cfg.c2.min_connections).unionByName(
        _top(parents, "c2_hunter", "dns_tunnel", F.col("parent"), "queries", cfg.c2.tunnel_subdomains)
    )


def recon_near_misses(connections: DataFrame, dns: DataFrame, cfg: HuntConfig = HuntConfig()) -> DataFrame:
    per_source = scan_counts(connections)
    volume = dns.where(present("source_ip")).groupBy("source_ip").agg(F.count(F.lit(1)).alias("queries"))
    agent, src = "reconnaissance_hunter", F.col("source_ip")
    return (
        _top(per_source, agent, "port_scan", src, "unique_ports", cfg.recon.scan_ports)
        .unionByName(_top(per_source, agent, "host_sweep", src, "unique_hosts", cfg.recon.sweep_hosts))
        .unionByName(_top(volume, agent, "dns_recon", src, "queries", cfg.recon.dns_volume))
    )


def lateral_near_misses(connections: DataFrame, cfg: HuntConfig = HuntConfig()) -> DataFrame:
    flows = as_flows(connections)
    share = flows.agg(
        F.coalesce(F.sum(F.when(F.col("src_internal") & F.col("dst_internal"), F.col("connections"))), F.lit(0))
        .alias("inside"),
        F.coalesce(F.sum("connections"), F.lit(0)).alias("total"),
    ).select(
        F.lit("lateral_movement_hunter").alias("agent"), F.lit("internal_connections").alias("check"),
        F.lit("internal/all").alias("subject"), F.col("inside").cast("bigint").alias("value"),
        F.col("total").cast("bigint").alias("threshold"),
    )
    targets = (
        internal_pairs(flows)
        .groupBy("protocol", "source_ip")
        .agg(F.count(F.lit(1)).alias("targets"))
    )
    out = share
    for protocol in ("RDP", "SMB", "SSH"):
        out = out.unionByName(
            _top(targets.where(F.col("protocol") == protocol), "lateral_movement_hunter", protocol,
                 F.col("source_ip"), "targets", cfg.lateral.fan_out[protocol])
        )
    return out


def unless_fired(near_misses: DataFrame, findings: DataFrame) -> DataFrame:
    """Keep diagnostics only for families without a finding."""
    return near_misses.join(findings.select("agent").distinct(), "agent", "left_anti")
