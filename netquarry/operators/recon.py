"""Reconnaissance detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import ReconConfig
from netquarry.operators.c2 import query_count
from netquarry.operators.flows import as_flows, present


def span_minutes(first: str = "first_ts", last: str = "last_ts") -> Column:
    return (F.unix_micros(last) - F.unix_micros(first)) / 60_000_000.0


def scan_counts(connections: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Distinct ports and hosts, totals and time span per source."""
    flows = as_flows(connections, extra_keys).where(present("source_ip"))
    return flows.groupBy(*extra_keys, "source_ip").agg(
        F.countDistinct(F.coalesce("destination_port", F.lit(-1))).alias("unique_ports"),
        F.countDistinct(F.coalesce("destination_ip", F.lit(""))).alias("unique_hosts"),
        F.sum("connections").alias("total_connections"),
        F.sum("rejected").alias("rejected"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("timed").alias("timed"),
    )


def port_scans(connections: DataFrame, cfg: ReconConfig = ReconConfig(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """Port scans and host sweeps per source."""
    minutes = F.when((F.col("timed") >= 2) & (span_minutes() > 0), span_minutes())
    ports, hosts = F.col("unique_ports"), F.col("unique_hosts")
    out = (
        scan_counts(connections, extra_keys)
        .where((ports >= cfg.scan_ports) | (hosts >= cfg.sweep_hosts))
        .withColumn("ports_per_min", F.coalesce(ports / minutes, F.lit(0.0)))
        .withColumn("hosts_per_min", F.coalesce(hosts / minutes, F.lit(0.0)))
        .withColumn("reject_ratio", F.col("rejected") / F.col("total_connections"))
        .withColumn(
            "scan_type",
            F.when(F.col("ports_per_min") > cfg.aggressive_ports_per_min, "Aggressive scan")
            .when(hosts > ports, "Host sweep")
            .when(ports > hosts * 5, "Vertical port scan")
            .otherwise("Network scan"),
        )
    )
    boost = (
        F.least(F.col("ports_per_min") / 100, F.lit(0.15))
        + F.least(ports / 200, F.lit(0.15))
        + F.col("reject_ratio") * 0.15
    )
    return out.withColumn("confidence", F.least(0.55 + boost, F.lit(0.95))).drop("first_ts", "last_ts", "timed")


def dns_reconnaissance(dns: DataFrame, cfg: ReconConfig = ReconConfig(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """High query volume or NXDOMAIN share per source."""
    nxdomain = F.sum("nxdomain") if "nxdomain" in dns.columns else F.count_if(F.col("response_code") == "NXDOMAIN")
    per_domain = (
        dns.where(present("source_ip"))
        .groupBy(*extra_keys, "source_ip", F.coalesce("domain", F.lit("")).alias("domain"))
        .agg(
            query_count(dns).alias("n"),
            nxdomain.alias("nx"),
        )
    )
    total, ratio = F.col("total_queries"), F.col("nxdomain_ratio")
    return (
        per_domain.groupBy(*extra_keys, "source_ip")
        .agg(
            F.sum("n").alias("total_queries"),
            F.sum("nx").alias("nxdomain_count"),
            F.count(F.lit(1)).alias("unique_domains"),
        )
        .withColumn("nxdomain_ratio", F.col("nxdomain_count") / total)
        .where((total >= cfg.dns_volume) | (ratio >= cfg.nxdomain_ratio))
        .withColumn(
            "confidence",
            F.least(
                0.40
                + F.least(total / cfg.dns_volume, F.lit(1.0)) * 0.3
                + F.least(ratio / cfg.nxdomain_ratio, F.lit(1.0)) * 0.4
                + F.least(F.col("unique_domains") / 100, F.lit(0.2)),
                F.lit(0.93),
            ),
        )
    )


def service_enumeration(connections: DataFrame, cfg: ReconConfig = ReconConfig(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """One source probing many ports of one host, mostly rejected."""
    flows = as_flows(connections, extra_keys).where(present("source_ip") & present("destination_ip"))
    ratio = F.col("rejected") / F.col("total_connections")
    return (
        flows.groupBy(*extra_keys, "source_ip", "destination_ip")
        .agg(
            F.count(F.lit(1)).alias("ports_probed"),
            F.sum("rejected").alias("rejected"),
            F.sum("connections").alias("total_connections"),
        )
        .withColumn("reject_ratio", ratio)
        .where((F.col("ports_probed") >= cfg.enum_ports) & (F.col("reject_ratio") >= cfg.enum_reject_ratio))
        .withColumn(
            "confidence",
            F.least(0.55 + F.col("ports_probed") * 0.01 + F.col("reject_ratio") * 0.15, F.lit(0.90)),
        )
    )
