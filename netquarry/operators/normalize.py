"""Raw logs to the common columns, union of sources and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import net, times

CONNECTION_KEYS = ("source_ip", "destination_ip", "destination_port", "timestamp")
DNS_KEYS = ("source_ip", "domain", "timestamp")


def flatten_names(df: DataFrame) -> DataFrame:
    """Dotted Zeek names to plain ones: ``id.orig_h`` becomes ``orig_h``, other
    dots become underscores."""
    plain = [c.removeprefix("id.").replace(".", "_") for c in df.columns]
    return df.toDF(*plain)


def _field(df: DataFrame, *names: str, default=None) -> Column:
    got = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*got, F.lit(default))


def _number(value: Column, kind: str) -> Column:
    """0 when absent; null when present but not a number."""
    return F.when(value.isNull() | (value.cast("string") == ""), F.lit(0).cast(kind)).otherwise(
        value.cast("string").try_cast(kind)
    )


def connections(raw: DataFrame) -> DataFrame:
    """Zeek conn rows; the originator's bytes are the outgoing ones. Rows whose
    numbers do not parse are dropped."""
    df = flatten_names(raw)
    port = _number(_field(df, "resp_p"), "int")
    out_bytes = _number(_field(df, "orig_bytes"), "bigint")
    in_bytes = _number(_field(df, "resp_bytes"), "bigint")
    rows = df.select(
        _field(df, "orig_h").alias("source_ip"), _field(df, "resp_h").alias("destination_ip"),
        _number(_field(df, "orig_p"), "int").alias("source_port"), port.alias("destination_port"),
        _field(df, "proto", default="tcp").alias("protocol"),
        in_bytes.alias("bytes_in"), out_bytes.alias("bytes_out"),
        _field(df, "conn_state", default="").alias("conn_state"),
        _field(df, "sensor_id", "host", default="default").alias("sensor_id"),
        _field(df, "vlan", default="0").cast("string").alias("vlan"),
        times.parse_timestamp(_field(df, "ts", "_time")).alias("timestamp"),
    )
    return rows.where(
        F.col("destination_port").isNotNull() & F.col("bytes_in").isNotNull() & F.col("bytes_out").isNotNull()
    )


def dns_queries(raw: DataFrame) -> DataFrame:
    df = flatten_names(raw)
    return df.select(
        _field(df, "orig_h").alias("source_ip"), _field(df, "query").alias("domain"),
        _field(df, "rcode_name", default="NOERROR").alias("response_code"),
        _field(df, "answers", default="").cast("string").alias("answer"),
        _field(df, "sensor_id", "host", default="default").alias("sensor_id"),
        _field(df, "vlan", default="0").cast("string").alias("vlan"),
        times.parse_timestamp(_field(df, "ts", "_time")).alias("timestamp"),
    )


def http_requests(raw: DataFrame) -> DataFrame:
    df = flatten_names(raw)
    return df.select(
        _field(df, "orig_h").alias("source_ip"), _field(df, "resp_h").alias("destination_ip"),
        _field(df, "method").alias("method"), _field(df, "uri").alias("uri"), _field(df, "host").alias("host"),
        _field(df, "user_agent").alias("user_agent"), times.parse_timestamp(_field(df, "ts", "_time")).alias("timestamp"),
    )


def ntlm_logs(raw: DataFrame) -> DataFrame:
    df = flatten_names(raw)
    names = ("hostname", "domainname", "server_nb_computer_name", "server_dns_computer_name")
    return df.select(
        _field(df, "orig_h").alias("source_ip"), _field(df, "resp_h").alias("dest_ip"),
        *[_field(df, n).alias(n) for n in names],
        _field(df, "sensor_id", "host", default="default").alias("sensor_id"),
        _field(df, "vlan", default="0").cast("string").alias("vlan"),
        times.parse_timestamp(_field(df, "ts", "_time")).alias("timestamp"),
    )


def alert_signals(alerts: DataFrame) -> DataFrame:
    """Suricata alerts as hunt signals; lower severity numbers weigh more."""
    level = F.coalesce(F.col("severity"), F.lit(3))
    return alerts.select(
        F.coalesce("category", F.lit("unknown")).alias("type"),
        (0.6 + (4 - level) * 0.1).alias("confidence"),
        F.coalesce("signature", F.lit("")).alias("description"), F.coalesce("category", F.lit("")).alias("category"),
        F.array("src_ip", "dest_ip").alias("indicators"),
    )


def merge_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """All sources as one frame; columns a source lacks are null. The source's
    position is kept as ``source_rank``."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def dedup(events: DataFrame, keys: Sequence[str], prefer: Sequence[str] = ("source_rank",)) -> DataFrame:
    """One event per key: lowest preference columns, then lowest remaining
    values. A combining aggregate, so a key repeated a billion times shrinks
    before the shuffle."""
    first = [c for c in prefer if c in events.columns and c not in keys]
    rest = [c for c in events.columns if c not in keys and c not in first]
    picked = events.groupBy(*keys).agg(F.min(F.struct(*first, *rest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*events.columns)


def mark_internal(events: DataFrame, column: str, out: str, known_nodes: DataFrame | None = None) -> DataFrame:
    """Internal flag: RFC 1918, or a known node where the map lists internal
    hosts with public addresses (ip)."""
    flag = net.is_internal(column)
    if known_nodes is None:
        return events.withColumn(out, flag)
    known = known_nodes.select(F.col("ip").alias(column), F.lit(True).alias("_known")).distinct()
    return events.join(known, column, "left").withColumn(out, flag | F.coalesce("_known", F.lit(False))).drop("_known")


def host_events(bundle: dict[str, DataFrame], host: str) -> dict[str, DataFrame]:
    """Every frame that has a hostname column, filtered to one host; the
    others unchanged."""
    return {
        name: df.where(F.col("hostname") == host) if "hostname" in df.columns else df
        for name, df in bundle.items()
    }
