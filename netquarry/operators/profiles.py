"""Device profiles: 31 grouped views of the protocol logs.

Each profile is data: which log, which rows, the key, and its aggregates.
Scalar aggregates (count, distinct count, sum, first/last, latest) run in one
combining aggregate. Values run as (key, field, value) rows, made distinct by
a combining aggregate: ``profile_values`` keeps them in that long form, which
no number of values can outgrow and on which decisions can be taken; the
wide form of ``run_profile`` has them as arrays, whole unless a display asks
for the first ``cap`` in sorted order.

Logs are Zeek logs with plain names (``normalize.flatten_names``) and ``ts``
as a timestamp.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.functions import text
from netquarry.operators.common import latest, left_join_all

@dataclass(frozen=True)
class Profile:
    name: str
    log: str
    key: Mapping[str, Callable[[], Column] | str]
    scalars: Mapping[str, tuple] = field(default_factory=dict)
    values: Mapping[str, Callable[[], Column] | str] = field(default_factory=dict)
    where: Callable[[], Column] | None = None
    having: tuple[str, int] | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None


def _col(spec) -> Column:
    return F.col(spec) if isinstance(spec, str) else spec()


def _scalar(spec: tuple) -> Column:
    kind = spec[0]
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "dc":
        return F.countDistinct(_col(spec[1]))
    if kind == "sum":
        return F.sum(_col(spec[1]).cast("bigint"))
    if kind == "count_if":
        return F.count_if(spec[1]())
    if kind == "latest":
        return latest(spec[1], "ts")
    return {"min": F.min, "max": F.max}[kind](_col(spec[1]))


def _known(*names: str) -> Callable[[], Column]:
    def test():
        out = F.lit(True)
        for n in names:
            out = out & F.col(n).isNotNull() & ~F.col(n).cast("string").isin("", "-")
        return out

    return test


def _not_null(*names: str) -> Callable[[], Column]:
    def test():
        out = F.lit(True)
        for n in names:
            out = out & F.col(n).isNotNull()
        return out

    return test


def _service_name() -> Column:
    named = F.col("service").isNotNull() & ~F.col("service").isin("", "-")
    return F.when(named, F.col("service")).otherwise(F.concat_ws("/", F.col("port_num").cast("string"), "port_proto"))


def _software_name() -> Column:
    major, minor = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("version_major", "version_minor"))
    return F.concat(F.col("name"), F.lit(" "), major, F.lit("."), minor)


def _vlan() -> Column:
    return F.coalesce(F.col("vlan").cast("string"), F.lit("0"))


def _file_hosts(df: DataFrame) -> DataFrame:
    return df.withColumn("file_host", F.explode(F.coalesce("tx_hosts", "rx_hosts")))


ANY_CLIENTS = {"unique_clients": ("dc", "orig_h")}

PROFILES: dict[str, Profile] = {
    p.name: p
    for p in (
        Profile("server", "conn", {"ip": "resp_h"}, {**ANY_CLIENTS, "incoming_count": ("count",)},
                {"ports": "resp_p"}, having=("incoming_count", 3)),
        Profile("client", "conn", {"ip": "orig_h"},
                {"unique_destinations": ("dc", "resp_h"), "outgoing_count": ("count",)}, having=("outgoing_count", 3)),
        Profile("kerberos", "kerberos", {"ip": "resp_h"}, {**ANY_CLIENTS, "auth_count": ("count",)},
                {"services": "service"}, having=("auth_count", 3)),
        Profile("dhcp", "dhcp", {"ip": "assigned_addr", "mac": "mac", "vlan": _vlan},
                {"first_seen": ("min", "ts"), "last_seen": ("max", "ts"),
                 "dhcp_hostname": ("latest", "host_name"), "sensor_id": ("latest", "sensor_id")},
                where=_not_null("assigned_addr", "mac")),
        Profile("snmp", "snmp", {"ip": "resp_h"},
                {"community": ("latest", "community"), "snmp_version": ("latest", "version")},
                where=_not_null("resp_h")),
        Profile("smb", "smb", {"ip": "resp_h"}, {"smb_count": ("count",)},
                {"nb_names": "server_name", "share_types": "share_type"}, where=_known("server_name")),
        Profile("software", "software", {"ip": lambda: F.coalesce("host", "orig_h")}, {"software_count": ("count",)},
                {"software": _software_name, "sw_types": "software_type"},
                where=lambda: F.col("host").isNotNull() | F.col("orig_h").isNotNull()),
        Profile("ssh", "ssh", {"client_ip": "orig_h", "server_ip": "resp_h"},
                {"ssh_client": ("latest", "client"), "ssh_server": ("latest", "server")}),
        Profile("x509", "x509", {"sensor_id": "sensor_id"}, {"cert_count": ("count",)},
                {"cert_names": lambda: text.common_name("certificate_subject")},
                where=lambda: text.common_name("certificate_subject").isNotNull()),
        Profile("http_ua", "http", {"ip": "orig_h"}, {"sites_visited": ("dc", "host"), "http_count": ("count",)},
                {"user_agents": "user_agent"}, where=_known("user_agent"), having=("http_count", 2)),
        Profile("ja3_ssl", "ssl", {"ip": "orig_h"}, {"unique_servers": ("dc", "resp_h"), "tls_count": ("count",)},
                {"ja3_hashes": "ja3", "ja3s_hashes": "ja3s", "sni_names": "server_name", "tls_versions": "version"},
                where=_known("ja3"), having=("tls_count", 2)),
        Profile("ja3s_server", "ssl", {"ip": "resp_h"}, dict(ANY_CLIENTS),
                {"ja3s_hashes": "ja3s", "cert_subjects": "subject", "cert_issuers": "issuer", "tls_versions": "version"},
                where=_known("ja3s"), having=("unique_clients", 1)),
        Profile("dns_profile", "dns", {"ip": "orig_h"},
                {"query_count": ("count",), "unique_domains": ("dc", "query"),
                 "nxdomain_count": ("count_if", lambda: F.col("rcode_name") == "NXDOMAIN")},
                {"tlds": lambda: text.top_level("query"), "query_types": "qtype_name"},
                where=_known("query"), having=("query_count", 5)),
        Profile("rdp", "rdp", {"ip": "orig_h"},
                {"rdp_cookie": ("latest", "cookie"), "client_build": ("latest", "client_build"),
                 "client_name": ("latest", "client_name"), "keyboard_layout": ("latest", "keyboard_layout"),
                 "desktop_width": ("latest", "desktop_width"), "desktop_height": ("latest", "desktop_height"),
                 "security_protocol": ("latest", "security_protocol"), "rdp_count": ("count",)},
                where=lambda: F.col("cookie").isNotNull() | F.col("client_build").isNotNull()),
        Profile("dhcp_extended", "dhcp", {"ip": "assigned_addr", "mac": "mac", "vlan": _vlan},
                {"client_fqdn": ("latest", "client_fqdn"), "dhcp_domain": ("latest", "domain"),
                 "vendor_class": ("latest", "vendor_class"), "lease_time": ("latest", "lease_time"),
                 "sensor_id": ("latest", "sensor_id")},
                {"msg_types": "msg_types"}, where=_not_null("assigned_addr", "mac")),
        Profile("files", "files", {"ip": "file_host"},
                {"unique_types": ("dc", "mime_type"), "total_file_bytes": ("sum", "total_bytes"), "file_count": ("count",)},
                {"mime_types": "mime_type", "file_sources": "source"},
                where=_known("mime_type"), having=("file_count", 2), prepare=_file_hosts),
        Profile("x509_extended", "x509", {"sensor_id": "sensor_id"},
                {"unique_certs": ("dc", lambda: text.common_name("certificate_subject"))},
                {"cert_names": lambda: text.common_name("certificate_subject"),
                 "issuer_names": lambda: text.common_name("certificate_issuer"),
                 "issuer_orgs": lambda: text.organisation("certificate_issuer"),
                 "key_types": "certificate_key_type", "key_lengths": "certificate_key_length"},
                where=_not_null("certificate_subject")),
        Profile("known_services", "known_services", {"ip": "host"}, {"port_count": ("dc", "port_num")},
                {"service_names": _service_name}, where=_not_null("host", "port_num")),
        Profile("smtp_banner", "smtp", {"ip": "resp_h"},
                {"last_banner": ("latest", "last_reply"), **ANY_CLIENTS, "smtp_count": ("count",)},
                {"helo_names": "helo"}, where=_not_null("resp_h"), having=("smtp_count", 2)),
        Profile("ftp_banner", "ftp", {"ip": "resp_h"},
                {"ftp_banner": ("latest", "reply_msg"), **ANY_CLIENTS, "ftp_count": ("count",)},
                where=_not_null("resp_h"), having=("ftp_count", 1)),
        Profile("dhcp_gateway", "dhcp", {"gateway_ip": lambda: F.get("router", F.lit(0)), "vlan": _vlan},
                {"client_count": ("dc", "assigned_addr")}, {"clients": "assigned_addr"},
                where=lambda: F.col("assigned_addr").isNotNull()
                & F.coalesce(~F.get("router", F.lit(0)).isin("", "-"), F.lit(False)),
                having=("client_count", 1)),
        Profile("snmp_oid", "snmp", {"ip": "resp_h"},
                {"community": ("latest", "community"), "snmp_version": ("latest", "version"),
                 "sys_object_id": ("latest", "sys_object_id")}, where=_not_null("resp_h")),
        Profile("tunnel", "tunnel", {"ip": "orig_h"}, {"tunnel_count": ("count",)},
                {"tunnel_types": "tunnel_type", "actions": "action"}, where=_not_null("tunnel_type"), having=("tunnel_count", 1)),
        Profile("ntp", "ntp", {"ip": "resp_h"}, {**ANY_CLIENTS, "ntp_count": ("count",)},
                where=_not_null("resp_h"), having=("ntp_count", 2)),
        Profile("radius", "radius", {"ip": "resp_h"}, {**ANY_CLIENTS, "radius_count": ("count",)},
                {"results": "result"}, where=_not_null("resp_h"), having=("radius_count", 1)),
        Profile("mqtt", "mqtt", {"ip": "resp_h"}, {**ANY_CLIENTS, "mqtt_count": ("count",)},
                {"actions": "action"}, where=_not_null("resp_h"), having=("mqtt_count", 1)),
        Profile("modbus", "ics", {"ip": "resp_h"}, {**ANY_CLIENTS, "ics_count": ("count",)},
                {"protocols": lambda: F.when(F.col("log_source") == "modbus", "Modbus").otherwise("DNP3")},
                where=_not_null("resp_h"), having=("ics_count", 1)),
        Profile("notice", "notice", {"ip": lambda: F.coalesce("src", "orig_h")}, {"notice_count": ("count",)},
                {"notice_types": "note", "notice_msgs": "msg"},
                where=lambda: F.col("src").isNotNull() | F.col("orig_h").isNotNull(), having=("notice_count", 1)),
        Profile("traceroute", "traceroute", {"ip": "src"}, {"traceroute_count": ("count",)},
                {"destinations": "dst"}, where=_not_null("src", "dst")),
        Profile("known_hosts", "known_hosts", {"ip": "host"}, {"seen_count": ("count",)}, where=_not_null("host")),
    )
}


def _rows(log: DataFrame, p: Profile) -> DataFrame:
    df = p.prepare(log) if p.prepare else log
    if p.where is not None:
        df = df.where(p.where())
    return df


def profile_values(log: DataFrame, profile: str, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Every distinct value: (extra keys, profile keys, field, value, n)."""
    p = PROFILES[profile]
    pairs = F.array(
        *[F.struct(F.lit(name).alias("field"), _col(spec).cast("string").alias("value")) for name, spec in p.values.items()]
    )
    keys = [_col(spec).alias(name) for name, spec in p.key.items()]
    rows = _rows(log, p).select(*extra_keys, *keys, F.explode(pairs).alias("_v")).select(*extra_keys, *p.key, "_v.*")
    return rows.where(F.col("value").isNotNull()).groupBy(*extra_keys, *p.key, "field", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def value_lists(values: DataFrame, keys: Sequence[str], fields: Sequence[str], cap: int | None = None) -> DataFrame:
    """The values per key and field in sorted order, as arrays; with ``cap``
    the first ones only."""
    if cap is not None:
        w = Window.partitionBy(*keys, "field").orderBy("value")
        values = values.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap)
    return values.groupBy(*keys).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("field") == f, F.col("value")))).alias(f) for f in fields]
    )


def run_profile(log: DataFrame, profile: str, extra_keys: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """One row per key with the profile's aggregates and value lists."""
    p = PROFILES[profile]
    keys = [*extra_keys, *p.key]
    grouped = _rows(log, p).groupBy(*extra_keys, *[_col(spec).alias(name) for name, spec in p.key.items()])
    out = grouped.agg(*[_scalar(spec).alias(name) for name, spec in p.scalars.items()])
    if p.having:
        out = out.where(F.col(p.having[0]) >= p.having[1])
    if p.values:
        lists = value_lists(profile_values(log, profile, extra_keys), keys, list(p.values), cap)
        out = left_join_all(out, [lists], keys)
        out = out.withColumns({f: F.coalesce(F.col(f), F.array().cast("array<string>")) for f in p.values})
    if profile == "dns_profile":
        out = out.withColumn("nxdomain_ratio", F.round(F.col("nxdomain_count") / F.col("query_count"), 4))
    if profile == "dhcp_extended":
        out = out.where(F.col("client_fqdn").isNotNull() | F.col("vendor_class").isNotNull())
    return out


def run_profiles(logs: Mapping[str, DataFrame], names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All profiles whose log is present, lazily."""
    return {
        name: run_profile(logs[p.log], name)
        for name, p in PROFILES.items() if p.log in logs and (names is None or name in names)
    }


def ntlm_rows(log: DataFrame) -> DataFrame:
    """NTLM projection used by the name enrichment."""
    return log.select(
        "ts", "sensor_id", _vlan().alias("vlan"), F.col("orig_h").alias("source_ip"), F.col("resp_h").alias("dest_ip"),
        "hostname", "domainname", "server_nb_computer_name", "server_dns_computer_name",
    )


def merge_windows(per_window: DataFrame, distinct: Sequence[str], counts: Sequence[str], lists: Sequence[str] = (),
                  key: str = "ip") -> DataFrame:
    """Merge window-level profiles the compatible way: greatest distinct count,
    summed counts, united lists. Distinct counts over the whole range are
    larger; ``run_profile`` without window keys gives the exact ones."""
    merged = per_window.groupBy(key).agg(
        *[F.max(c).alias(c) for c in distinct], *[F.sum(c).alias(c) for c in counts]
    )
    if not lists:
        return merged
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("array<string>").alias("vs")) for c in lists])
    values = (
        per_window.select(key, F.explode(pairs).alias("_p"))
        .select(key, "_p.field", F.explode("_p.vs").alias("value"))
        .distinct()
    )
    return left_join_all(merged, [value_lists(values, [key], list(lists))], [key])


def index_by_ip(results: Mapping[str, DataFrame]) -> DataFrame:
    """(ip, profile, row as JSON); SSH and NTLM rows appear under both ends."""
    parts = []
    for name, df in results.items():
        body = F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("row")
        ends = [c for c in ("ip", "client_ip", "server_ip", "source_ip", "dest_ip", "gateway_ip") if c in df.columns]
        if ends:
            parts.append(df.select(F.explode(F.array_distinct(F.array(*ends))).alias("ip"), F.lit(name).alias("profile"), body))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.coalesce("ip", F.lit("")) != "")
