"""Command-and-control detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import C2Config
from netquarry.functions import text
from netquarry.operators.common import interarrival, left_join_all, possible_rows, smallest_values
from netquarry.operators.flows import FLOW_KEYS, as_flows, present


def beacon_candidates(flows: DataFrame, cfg: C2Config = C2Config(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """Keys of the flow summary with enough timed connections, at more than one time, to be a beacon."""
    enough = (F.col("timed") >= cfg.min_connections) & (F.col("first_ts") < F.col("last_ts"))
    return flows.where(enough).select(*extra_keys, *FLOW_KEYS, "timed", "first_ts", "last_ts")


def mostly_candidates(flows: DataFrame, wanted: DataFrame) -> bool:
    """Whether at least half of all timed connections are of the wanted keys, so that a prefilter would not pay."""
    n = F.coalesce(F.sum("timed"), F.lit(0)).alias("n")
    return 2 * wanted.agg(n).first()["n"] >= flows.agg(n).first()["n"]


def beaconing(
    connections: DataFrame, cfg: C2Config = C2Config(), extra_keys: Sequence[str] = (), flows: DataFrame | None = None
) -> DataFrame:
    """Regular call-backs per (source, destination, port).

    With a stored flow summary the rows of pairs that connect too seldom,
    usually nearly all, are left out in the scan, before the shuffle by pair;
    where the summary says that they are less than half, nothing is tested.
    """
    rows = connections.where(present("source_ip") & present("destination_ip"))
    sizes = None
    if flows is not None:
        wanted = beacon_candidates(flows, cfg, extra_keys)
        if not mostly_candidates(flows, wanted):
            rows = possible_rows(rows, wanted.select(*extra_keys, *FLOW_KEYS), [*extra_keys, *FLOW_KEYS])
        sizes = wanted.select(F.col("timed").alias("n"), F.col("first_ts").alias("lo"), F.col("last_ts").alias("hi"))
    stats = interarrival(rows, [*extra_keys, *FLOW_KEYS], bucket_seconds=cfg.beacon_bucket_seconds, sizes=sizes)
    cv = F.col("std_dev") / F.col("mean_interval")
    out = (
        stats.where(
            (F.col("events") >= cfg.min_connections)
            & (F.col("gaps") >= cfg.min_connections - 1)
            & (F.col("mean_interval") > 0)
        )
        .withColumn("variation", cv)
        .withColumn("regularity", 1 - F.least(F.col("variation"), F.lit(1.0)))
        .where(F.col("regularity") >= cfg.regularity)
    )
    return out.withColumn(
        "confidence",
        F.least(
            0.65 + (F.col("regularity") - 0.75) + F.least(F.col("events") / 50.0, F.lit(0.15)),
            F.lit(0.95),
        ),
    )


def dns_summary(dns: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Queries per (source, domain): the partial that all detections over DNS share.

    It also splits a hot source over its domains, and a hot domain over its
    sources. ``first_ts`` is null where some query has no time.
    """
    return dns.groupBy(*extra_keys, "source_ip", "domain").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("response_code") == "NXDOMAIN").alias("nxdomain"),
        F.when(F.count("timestamp") == F.count(F.lit(1)), F.min("timestamp")).alias("first_ts"),
    )


def query_count(dns: DataFrame) -> Column:
    """How many queries the rows of a DNS log or of its summary stand for."""
    return F.sum("queries") if "queries" in dns.columns else F.count(F.lit(1))


def dga_domains(dns: DataFrame, cfg: C2Config = C2Config(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """Algorithm-like second-level labels, one row per domain with its first source."""
    first = F.min(F.struct("first_ts" if "first_ts" in dns.columns else "timestamp", "source_ip")).getField("source_ip")
    per_domain = (
        dns.where(present("domain") & (text.label_count("domain") >= 2))
        .withColumn("label", text.second_level("domain"))
        .where((F.length("label") >= cfg.dga_min_length) & text.has_digit("label"))
        .groupBy(*extra_keys, "domain", "label")
        .agg(first.alias("source_ip"), query_count(dns).alias("queries"))
    )
    return (
        per_domain.withColumn("consonant_ratio", text.consonant_ratio("label"))
        .where(F.col("consonant_ratio") > cfg.dga_consonant_ratio)
        .withColumn("entropy", text.shannon_entropy("label"))
        .where(F.col("entropy") >= cfg.dga_entropy)
        .withColumn(
            "confidence",
            F.least(
                0.55 + (F.col("entropy") - 3.5) * 0.25 + (F.length("label") - 10) * 0.01,
                F.lit(0.92),
            ),
        )
    )


def subdomain_counts(dns: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Queries per (source, parent domain, subdomain): shared by tunnelling and
    exfiltration, and the pre-aggregate that splits a hot parent domain."""
    return (
        dns.where(present("source_ip") & (text.label_count("domain") >= 3))
        .select(
            *extra_keys,
            *[c for c in ("queries",) if c in dns.columns],
            "source_ip",
            text.parent_domain("domain").alias("parent_domain"),
            text.subdomain("domain").alias("subdomain"),
        )
        .groupBy(*extra_keys, "source_ip", "parent_domain", "subdomain")
        .agg(query_count(dns).alias("queries"))
    )


def dns_tunneling(
    dns: DataFrame, cfg: C2Config = C2Config(), extra_keys: Sequence[str] = (), samples: int = 0
) -> DataFrame:
    """Many distinct high-entropy subdomains under one parent domain."""
    subs = dns if "subdomain" in dns.columns else subdomain_counts(dns, extra_keys)
    keys = [*extra_keys, "source_ip", "parent_domain"]
    out = (
        subs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("unique_subdomains"),
            F.avg(text.shannon_entropy("subdomain")).alias("avg_entropy"),
        )
        .where(
            (F.col("unique_subdomains") >= cfg.tunnel_subdomains)
            & (F.col("avg_entropy") >= cfg.tunnel_entropy)
        )
        .withColumn(
            "confidence",
            F.least(
                0.60 + F.col("unique_subdomains") / 500 * 0.2 + (F.col("avg_entropy") - 3.0) * 0.1,
                F.lit(0.93),
            ),
        )
    )
    if samples:
        out = left_join_all(out, [smallest_values(subs, keys, "subdomain", samples, "sample_subdomains")], keys)
    return out


def persistent_channels(connections: DataFrame, cfg: C2Config = C2Config(), extra_keys: Sequence[str] = ()) -> DataFrame:
    """Long-lived pairs with little traffic."""
    flows = as_flows(connections, extra_keys)
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1_000_000.0
    return (
        flows.where(present("source_ip") & present("destination_ip") & (F.col("timed") > 0))
        .withColumn("duration_seconds", span)
        .withColumn("total_bytes", F.col("bytes_in") + F.col("bytes_out"))
        .where(F.col("duration_seconds") >= cfg.channel_seconds)
        .where(~((F.col("total_bytes") > cfg.channel_bytes) & (F.col("connections") > cfg.channel_count)))
        .select(
            *extra_keys, *FLOW_KEYS, "duration_seconds", "total_bytes", "connections",
            F.least(0.50 + F.col("duration_seconds") / 86400 * 0.2, F.lit(0.80)).alias("confidence"),
        )
    )


def suspicious_ports(
    connections: DataFrame, cfg: C2Config = C2Config(), extra_keys: Sequence[str] = (), samples: int = 0
) -> DataFrame:
    """Repeated use of backdoor-like ports per source; the port set is bounded
    by the configured list."""
    flows = (
        as_flows(connections, extra_keys)
        .where(F.col("destination_port").isin(*cfg.suspicious_ports))
        .withColumn("source_ip", F.coalesce("source_ip", F.lit("")))
        .withColumn("endpoint", F.concat_ws(":", F.coalesce("destination_ip", F.lit("")), F.col("destination_port")))
    )
    keys = [*extra_keys, "source_ip"]
    out = (
        flows.groupBy(*keys)
        .agg(
            F.array_sort(F.collect_set("destination_port")).alias("ports"),
            F.count(F.lit(1)).alias("endpoints"),
            F.sum("connections").alias("connections"),
        )
        .where(F.col("connections") >= cfg.suspicious_min_count)
        .withColumn(
            "confidence",
            F.least(0.55 + F.size("ports") * 0.05 + F.col("connections") * 0.01, F.lit(0.80)),
        )
    )
    if samples:
        out = left_join_all(out, [smallest_values(flows, keys, "endpoint", samples, "sample_endpoints")], keys)
    return out
