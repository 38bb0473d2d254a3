"""Lateral-movement detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.config import LateralConfig
from netquarry.operators.common import left_join_all, smallest_values
from netquarry.operators.flows import as_flows, present


def protocol_of(port: str) -> Column:
    """Lateral-movement protocol of a destination port, else null."""
    return F.coalesce(
        *[
            F.when(F.col(port).isin(*ports), F.lit(name))
            for name, (ports, _, _) in fv.LATERAL_PROTOCOLS.items()
        ]
    )


def per_protocol(column: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in values.items()])


def internal_pairs(connections: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Connections per (source, protocol, destination) between internal hosts."""
    return (
        as_flows(connections, extra_keys)
        .where(F.col("src_internal") & F.col("dst_internal") & (F.col("source_ip") != F.col("destination_ip")))
        .withColumn("protocol", protocol_of("destination_port"))
        .where(F.col("protocol").isNotNull())
        .groupBy(*extra_keys, "source_ip", "protocol", "destination_ip")
        .agg(
            F.sum("connections").alias("connections"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("timed").alias("timed"),
        )
    )


def fan_out(
    connections: DataFrame, cfg: LateralConfig = LateralConfig(), extra_keys: Sequence[str] = (), samples: int = 0
) -> DataFrame:
    """RDP, SMB, SSH and WinRM/DCOM fan-out in one pass."""
    pairs = connections if "protocol" in connections.columns and "timed" in connections.columns \
        else internal_pairs(connections, extra_keys)
    keys = [*extra_keys, "source_ip", "protocol"]
    threshold = per_protocol(F.col("protocol"), cfg.fan_out)
    out = (
        pairs.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("targets"), F.sum("connections").alias("connections"))
        .where(F.col("targets") >= threshold)
        .withColumn(
            "confidence",
            F.least(
                0.55 + (F.col("targets") - threshold) * 0.05 + F.col("connections") * 0.002,
                F.lit(0.93),
            ),
        )
        .withColumn(
            "activity_type",
            per_protocol(F.col("protocol"), {k: v[1] for k, v in fv.LATERAL_PROTOCOLS.items()}),
        )
    )
    if samples:
        out = left_join_all(out, [smallest_values(pairs, keys, "destination_ip", samples, "sample_targets")], keys)
    return out


def ntlm_relay(
    ntlm: DataFrame, cfg: LateralConfig = LateralConfig(), extra_keys: Sequence[str] = (), samples: int = 0
) -> DataFrame:
    """One host name authenticating to several targets."""
    pairs = (
        ntlm.where(present("hostname") & present("dest_ip"))
        .groupBy(*extra_keys, "hostname", "dest_ip")
        .agg(F.count(F.lit(1)).alias("auths"))
    )
    keys = [*extra_keys, "hostname"]
    out = (
        pairs.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("targets"), F.sum("auths").alias("auth_count"))
        .where(F.col("targets") >= cfg.ntlm_targets)
        .withColumn("confidence", F.least(0.60 + F.col("targets") * 0.05, F.lit(0.88)))
    )
    if samples:
        out = left_join_all(out, [smallest_values(pairs, keys, "dest_ip", samples, "sample_targets")], keys)
    return out
