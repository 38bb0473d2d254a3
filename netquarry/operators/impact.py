"""Impact detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.config import ImpactConfig
from netquarry.functions import text
from netquarry.operators.common import left_join_all, smallest_values
from netquarry.operators.exfil import _pairs
from netquarry.operators.flows import as_flows, present
from netquarry.operators.lateral import internal_pairs
from netquarry.operators.recon import span_minutes


def cryptomining(
    connections: DataFrame,
    dns: DataFrame,
    cfg: ImpactConfig = ImpactConfig(),
    extra_keys: Sequence[str] = (),
    samples: int = 0,
) -> DataFrame:
    """Mining-pool lookups and mining-port use, merged per source."""
    keys = [*extra_keys, "source_ip"]
    pool_names = (
        dns.select(*extra_keys, F.coalesce("source_ip", F.lit("")).alias("source_ip"), F.lower("domain").alias("domain"))
        .where(text.any_contains("domain", cfg.pool_domains))
        .distinct()
    )
    endpoints = (
        as_flows(connections, extra_keys)
        .where(
            F.col("destination_port").isin(*cfg.stratum_ports)
            & present("source_ip")
            & ~F.col("dst_internal")
        )
        .select(*keys, F.concat_ws(":", "destination_ip", "destination_port").alias("endpoint"))
        .distinct()
    )
    pools = pool_names.groupBy(*keys).agg(F.count(F.lit(1)).alias("pool_domains"))
    ports = endpoints.groupBy(*keys).agg(F.count(F.lit(1)).alias("stratum_endpoints"))
    out = (
        pools.join(ports, keys, "full_outer")
        .na.fill(0, ["pool_domains", "stratum_endpoints"])
        .withColumn(
            "confidence",
            F.when((F.col("pool_domains") > 0) & (F.col("stratum_endpoints") > 0), 0.92)
            .when(F.col("pool_domains") > 0, 0.75)
            .otherwise(0.65),
        )
    )
    if samples:
        out = left_join_all(
            out,
            [
                smallest_values(pool_names, keys, "domain", samples, "sample_pools"),
                smallest_values(endpoints, keys, "endpoint", samples, "sample_endpoints"),
            ],
            keys,
        )
    return out


def ransomware_spread(
    connections: DataFrame, cfg: ImpactConfig = ImpactConfig(), extra_keys: Sequence[str] = (), samples: int = 0
) -> DataFrame:
    """SMB fan-out between internal hosts with its speed."""
    pairs = connections if "protocol" in connections.columns and "timed" in connections.columns \
        else internal_pairs(connections, extra_keys)
    pairs = pairs.where(F.col("protocol") == "SMB")
    keys = [*extra_keys, "source_ip"]
    minutes = F.when((F.col("timed") >= 2) & (span_minutes() > 0), span_minutes())
    out = (
        pairs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("targets"),
            F.sum("connections").alias("connections"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("timed").alias("timed"),
        )
        .where(F.col("targets") >= cfg.smb_targets)
        .withColumn("hosts_per_min", F.coalesce(F.col("targets") / minutes, F.lit(0.0)))
        .withColumn(
            "confidence",
            F.least(
                0.60
                + (F.col("targets") - cfg.smb_targets) * 0.03
                + F.least(F.col("hosts_per_min") * 0.02, F.lit(0.15)),
                F.lit(0.95),
            ),
        )
        .drop("first_ts", "last_ts", "timed")
    )
    if samples:
        out = left_join_all(out, [smallest_values(pairs, keys, "destination_ip", samples, "sample_targets")], keys)
    return out


def ddos_participation(connections: DataFrame, cfg: ImpactConfig = ImpactConfig(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """Internal hosts sending most of a large volume to one outside target.

    The top target is a max over (count, target): ties go to the greater name.
    """
    top = F.max(F.struct(F.col("connections").alias("n"), F.col("destination_ip").alias("ip")))
    return (
        _pairs(connections, extra_keys)
        .groupBy(*extra_keys, "source_ip")
        .agg(F.sum("connections").alias("total_connections"), top.alias("top"))
        .withColumn("top_target", F.col("top.ip"))
        .withColumn("target_share", F.col("top.n") / F.col("total_connections"))
        .drop("top")
        .where((F.col("total_connections") >= cfg.ddos_total) & (F.col("target_share") >= cfg.ddos_share))
        .withColumn(
            "confidence",
            F.least(
                0.60 + F.col("target_share") * 0.15 + F.col("total_connections") / 10000 * 0.1,
                F.lit(0.90),
            ),
        )
    )
