"""Collection and exfiltration detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.config import ExfilConfig
from netquarry.functions import text
from netquarry.operators.c2 import subdomain_counts
from netquarry.operators.common import left_join_all, smallest_values
from netquarry.operators.flows import as_flows, present

MIB = 1024.0 * 1024.0


def outbound_pairs(connections: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Bytes and connections per internal source and external destination."""
    return (
        as_flows(connections, extra_keys)
        .where(F.col("src_internal") & ~F.col("dst_internal"))
        .groupBy(*extra_keys, "source_ip", F.coalesce("destination_ip", F.lit("")).alias("destination_ip"))
        .agg(
            F.sum("bytes_out").alias("bytes_out"),
            F.sum("bytes_in").alias("bytes_in"),
            F.sum("connections").alias("connections"),
        )
    )


def _pairs(df: DataFrame, extra_keys: Sequence[str]) -> DataFrame:
    done = "bytes_out" in df.columns and "destination_port" not in df.columns
    return df if done else outbound_pairs(df, extra_keys)


def large_transfers(connections: DataFrame, cfg: ExfilConfig = ExfilConfig(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """Internal to external pairs above a byte threshold."""
    return (
        _pairs(connections, extra_keys)
        .where(present("destination_ip") & (F.col("bytes_out") >= cfg.transfer_bytes))
        .withColumn("mb_out", F.col("bytes_out") / MIB)
        .withColumn("confidence", F.least(0.55 + F.col("mb_out") / 1000 * 0.25, F.lit(0.90)))
    )


def asymmetric_traffic(connections: DataFrame, cfg: ExfilConfig = ExfilConfig(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """Internal hosts sending far more to the outside than they receive."""
    ratio = F.col("bytes_out") / F.greatest(F.col("bytes_in"), F.lit(1))
    return (
        _pairs(connections, extra_keys)
        .groupBy(*extra_keys, "source_ip")
        .agg(
            F.sum("bytes_out").alias("bytes_out"),
            F.sum("bytes_in").alias("bytes_in"),
            F.count(F.lit(1)).alias("unique_destinations"),
            F.sum("connections").alias("connections"),
        )
        .withColumn("out_in_ratio", ratio)
        .where((F.col("bytes_out") >= cfg.asymmetric_bytes) & (F.col("out_in_ratio") >= cfg.asymmetric_ratio))
        .withColumn(
            "confidence",
            F.least(
                0.50 + F.col("out_in_ratio") / 50 * 0.2 + F.col("bytes_out") / MIB / 500 * 0.15,
                F.lit(0.85),
            ),
        )
    )


def dns_exfiltration(
    dns: DataFrame, cfg: ExfilConfig = ExfilConfig(), extra_keys: Sequence[str] = (), samples: int = 0
) -> DataFrame:
    """Many long subdomains under one parent domain."""
    subs = dns if "subdomain" in dns.columns else subdomain_counts(dns, extra_keys)
    subs = subs.where(F.length("subdomain") >= cfg.subdomain_length)
    keys = [*extra_keys, "source_ip", "parent_domain"]
    out = (
        subs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("unique_subdomains"),
            F.sum("queries").alias("total_queries"),
            F.sum(F.col("queries") * F.length("subdomain")).alias("total_chars"),
        )
        .where(F.col("unique_subdomains") >= cfg.unique_subdomains)
        .withColumn("estimated_bytes", F.col("total_chars") * 0.75)
        .withColumn(
            "confidence",
            F.least(
                0.60 + F.col("unique_subdomains") * 0.002 + F.col("total_chars") / 10000 * 0.1,
                F.lit(0.92),
            ),
        )
    )
    if samples:
        out = left_join_all(out, [smallest_values(subs, keys, "subdomain", samples, "sample_subdomains")], keys)
    return out


def cloud_uploads(http: DataFrame, cfg: ExfilConfig = ExfilConfig(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """POST/PUT requests to upload services, first service in list order."""
    url = F.lower(F.concat(F.coalesce("host", F.lit("")), F.coalesce("uri", F.lit(""))))
    return (
        http.where(F.upper("method").isin("POST", "PUT"))
        .withColumn("service", text.first_contained(url, cfg.cloud_domains))
        .where(F.col("service").isNotNull())
        .groupBy(*extra_keys, F.coalesce("source_ip", F.lit("unknown")).alias("source_ip"), "service")
        .agg(F.count(F.lit(1)).alias("uploads"))
        .withColumn("confidence", F.least(0.60 + F.col("uploads") * 0.05, F.lit(0.88)))
    )
