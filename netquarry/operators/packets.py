"""The same ideas over a table of decoded packets: src, dst, sport, dport,
proto, flags, length, time (epoch seconds), payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import PacketConfig
from netquarry.operators.common import following, interarrival, left_join_all, smallest_values

# Ports on which HTTP is expected, and the inputs of each family.
WEB_PORTS = (80, 443, 8080, 8443)
AGENT_FEATURES = {
    "reconnaissance_hunter": ("network_connections", "dns_queries", "port_scan_indicators"),
    "c2_hunter": ("beaconing_candidates", "network_connections"),
    "collection_exfiltration_hunter": ("data_transfers", "http_requests"),
    "lateral_movement_hunter": ("network_connections",),
    "impact_hunter": ("network_connections", "dns_queries"),
}


def flows(packets: DataFrame) -> DataFrame:
    """Packets, bytes and duration per (src, dst, dport, proto)."""
    return (
        packets.groupBy("src", "dst", "dport", "proto")
        .agg(
            F.count(F.lit(1)).alias("packet_count"), F.sum("length").alias("bytes_transferred"),
            F.min("time").alias("first_seen"), F.max("time").alias("last_seen"),
        )
        .withColumn("duration", F.col("last_seen") - F.col("first_seen"))
    )


def dns_lookups(messages: DataFrame) -> DataFrame:
    """Queries with the answer code of the response that follows them in the
    same exchange (client, server, client port, transaction id).

    ``messages``: client, server, client_port, dns_id, is_response, qname,
    rcode, time. Code 3 marks the query NXDOMAIN.
    """
    rows = following(
        messages, ["client", "server", "client_port", "dns_id"], ["time", "is_response"], ["is_response", "rcode"], "reply", F.col("time")
    )
    return rows.where(~F.col("is_response")).select(
        F.col("client").alias("source_ip"), F.regexp_replace("qname", r"\.+$", "").alias("domain"),
        F.when(F.col("reply.is_response") & (F.col("reply.rcode") == 3), "NXDOMAIN").alias("response_code"), "time",
    )


def _header(name: str) -> Column:
    got = F.regexp_extract("payload", rf"(?m)^{name}:\s*([^\r\n]*?)\s*\r?$", 1)
    return got


def http_requests(packets: DataFrame) -> DataFrame:
    """Request line and headers of GET and POST payloads."""
    rows = packets.where((F.col("proto") == "tcp") & F.col("payload").rlike(r"^(GET|POST) \S+ "))
    return rows.select(
        F.col("src").alias("source_ip"), F.col("dst").alias("destination_ip"),
        F.regexp_extract("payload", r"^(GET|POST) ", 1).alias("method"),
        F.regexp_extract("payload", r"^\S+ (\S+) ", 1).alias("uri"),
        _header("Host").alias("host"), _header("User-Agent").alias("user_agent"), "time",
    )


def syn_scans(packets: DataFrame, cfg: PacketConfig = PacketConfig()) -> DataFrame:
    """Sources sending SYN to many ports; ports form a bounded set."""
    ports = packets.where((F.col("proto") == "tcp") & (F.col("flags").bitwiseAND(2) != 0)).select("src", "dport")
    out = ports.groupBy("src").agg(F.countDistinct("dport").alias("ports_scanned")).where(
        F.col("ports_scanned") >= cfg.scan_ports
    )
    return left_join_all(out, [smallest_values(ports, ["src"], "dport", cfg.scan_sample, "ports")], ["src"])


def beacons(packets: DataFrame, cfg: PacketConfig = PacketConfig()) -> DataFrame:
    """Regular arrivals per (dst, port); zero gaps count here."""
    rows = packets.where(F.col("proto") == "tcp").select(
        "dst", "dport", F.timestamp_micros((F.col("time") * 1_000_000).cast("bigint")).alias("timestamp")
    )
    stats = interarrival(rows, ["dst", "dport"], bucket_seconds=cfg.beacon_bucket_seconds, keep_zero=True)
    cv = F.col("std_dev") / F.col("mean_interval")
    return (
        stats.where((F.col("events") >= cfg.beacon_packets) & (F.col("mean_interval") > 0))
        .withColumn("regularity", 1 - cv)
        .where(1 - F.col("regularity") < cfg.beacon_cv)
        .withColumn("confidence", F.least(0.5 + F.col("regularity") * 0.5, F.lit(0.95)))
    )


def large_transfers(packets: DataFrame, cfg: PacketConfig = PacketConfig()) -> DataFrame:
    return (
        packets.groupBy("src", "dst")
        .agg(
            F.sum("length").alias("bytes_transferred"), F.count(F.lit(1)).alias("packet_count"),
            (F.max("time") - F.min("time")).alias("duration"),
        )
        .where(F.col("bytes_transferred") >= cfg.transfer_bytes)
    )


def protocol_mismatches(packets: DataFrame) -> DataFrame:
    """HTTP on unexpected ports and DNS over TCP, one scan for both."""
    web = ~F.col("dport").isin(*WEB_PORTS) & (F.contains("payload", F.lit("HTTP/")) | F.contains("payload", F.lit("GET ")))
    kinds = F.filter(
        F.array(F.when(web, F.lit("http_on_unusual_port")), F.when(F.col("dport") == 53, F.lit("dns_over_tcp"))),
        lambda k: k.isNotNull(),
    )
    return packets.where((F.col("proto") == "tcp") & (F.coalesce(F.length("payload"), F.lit(0)) > 0)).select(
        F.explode(kinds).alias("type"), F.col("src").alias("source_ip"), F.col("dst").alias("destination_ip"),
        F.col("dport").alias("port"), "time",
    )


def agent_features(packets: DataFrame, dns_messages: DataFrame | None, agent: str, cfg: PacketConfig = PacketConfig()) -> dict[str, DataFrame]:
    """The feature frames one detector family looks at, built lazily."""
    makers = {
        "network_connections": lambda: flows(packets),
        "dns_queries": lambda: dns_lookups(dns_messages) if dns_messages is not None else None,
        "port_scan_indicators": lambda: syn_scans(packets, cfg),
        "beaconing_candidates": lambda: beacons(packets, cfg),
        "data_transfers": lambda: large_transfers(packets, cfg),
        "http_requests": lambda: http_requests(packets),
    }
    built = {name: makers[name]() for name in AGENT_FEATURES.get(agent, ())}
    return {name: df for name, df in built.items() if df is not None}
