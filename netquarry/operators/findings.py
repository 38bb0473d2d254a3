"""Uniform finding rows and the detection registry.

A detection returns typed measures. ``to_findings`` turns them into one row
shape shared by correlation, cases and reports: agent, activity type,
indicators, affected assets, techniques, confidence, evidence map and a
fingerprint that does not depend on list order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.config import HuntConfig
from netquarry.functions import text
from netquarry.operators import c2, exfil, impact, lateral, recon
from netquarry.operators.flows import flow_summary

FINDING_COLUMNS = (
    "agent", "activity_type", "indicators", "affected_assets", "mitre_techniques",
    "confidence", "evidence", "evidence_count", "fingerprint",
)


def _strings(*cols) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def _tag(label: str, col: str) -> Column:
    return F.concat(F.lit(label + ":"), F.col(col).cast("string"))


def _endpoint() -> Column:
    return F.concat_ws(":", "destination_ip", F.col("destination_port").cast("string"))


def _more(base: Column, extra: str, n: int) -> Column:
    """Base indicators followed by up to ``n`` sampled values."""
    return F.concat(base, F.slice(F.coalesce(F.col(extra), F.array().cast("array<string>")), 1, n))


@dataclass(frozen=True)
class Detection:
    """One detection: how to run it and how its measures become a finding."""

    name: str
    agent: str
    activity_type: str | None
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]
    indicators: Callable[[], Column]
    assets: Callable[[], Column]
    techniques: Callable[[], Column]
    evidence: tuple[str, ...] = field(default_factory=tuple)


def _fixed(*values: str) -> Callable[[], Column]:
    return lambda: F.array(*[F.lit(v) for v in values])


def _lateral_techniques() -> Column:
    return F.coalesce(
        *[
            F.when(F.col("protocol") == name, F.array(*[F.lit(t) for t in techniques]))
            for name, (_, _, techniques) in fv.LATERAL_PROTOCOLS.items()
        ]
    )


C2, RECON, LATERAL, EXFIL, IMPACT = (
    "c2_hunter", "reconnaissance_hunter", "lateral_movement_hunter",
    "collection_exfiltration_hunter", "impact_hunter",
)

# ``needs`` names inputs of the hunt bundle: connections (raw), flows, pairs
# (outbound), internal_pairs, dns (raw), dns_summary, subdomains, http, ntlm.
DETECTIONS: dict[str, Detection] = {
    d.name: d
    for d in (
        Detection("beaconing", C2, "c2_beaconing", ("connections",),
                  lambda b, c, k: c2.beaconing(b["connections"], c.c2, k, b.get("stored_flows")),
                  lambda: _strings("source_ip", _endpoint()), lambda: _strings("source_ip"),
                  _fixed("T1071", "T1571"),
                  ("events", "mean_interval", "std_dev", "regularity", "variation")),
        Detection("dga_domains", C2, "dga_domain", ("dns_summary",),
                  lambda b, c, k: c2.dga_domains(b["dns_summary"], c.c2, k),
                  lambda: _strings("domain", "source_ip"), lambda: _strings("source_ip"),
                  _fixed("T1568.002"), ("entropy", "consonant_ratio", "label")),
        Detection("dns_tunneling", C2, "dns_tunneling", ("subdomains",),
                  lambda b, c, k: c2.dns_tunneling(b["subdomains"], c.c2, k, samples=5),
                  lambda: _strings("source_ip", "parent_domain"), lambda: _strings("source_ip"),
                  _fixed("T1071.004"), ("unique_subdomains", "avg_entropy", "sample_subdomains")),
        Detection("persistent_channels", C2, "persistent_c2_channel", ("flows",),
                  lambda b, c, k: c2.persistent_channels(b["flows"], c.c2, k),
                  lambda: _strings("source_ip", _endpoint()), lambda: _strings("source_ip"),
                  _fixed("T1071", "T1573"), ("duration_seconds", "total_bytes", "connections")),
        Detection("suspicious_ports", C2, "suspicious_port_usage", ("flows",),
                  lambda b, c, k: c2.suspicious_ports(b["flows"], c.c2, k, samples=20),
                  lambda: F.concat(_strings("source_ip"), F.col("ports").cast("array<string>")),
                  lambda: _strings("source_ip"), _fixed("T1571"),
                  ("ports", "connections", "endpoints", "sample_endpoints")),
        Detection("port_scans", RECON, "port_scanning", ("flows",),
                  lambda b, c, k: recon.port_scans(b["flows"], c.recon, k),
                  lambda: _strings("source_ip", _tag("ports", "unique_ports"), _tag("hosts", "unique_hosts")),
                  lambda: _strings("source_ip"), _fixed("T1595", "T1046"),
                  ("unique_ports", "unique_hosts", "ports_per_min", "hosts_per_min", "reject_ratio",
                   "total_connections", "scan_type")),
        Detection("dns_reconnaissance", RECON, "dns_reconnaissance", ("dns_summary",),
                  lambda b, c, k: recon.dns_reconnaissance(b["dns_summary"], c.recon, k),
                  lambda: _strings("source_ip", _tag("dns_queries", "total_queries"),
                                   F.concat(F.lit("nxdomain_ratio:"), F.format_string("%.2f", "nxdomain_ratio"))),
                  lambda: _strings("source_ip"), _fixed("T1595.002"),
                  ("total_queries", "nxdomain_count", "nxdomain_ratio", "unique_domains")),
        Detection("service_enumeration", RECON, "service_enumeration", ("flows",),
                  lambda b, c, k: recon.service_enumeration(b["flows"], c.recon, k),
                  lambda: _strings("source_ip", "destination_ip", _tag("ports_probed", "ports_probed")),
                  lambda: _strings("destination_ip"), _fixed("T1046"),
                  ("ports_probed", "reject_ratio", "total_connections")),
        Detection("fan_out", LATERAL, None, ("internal_pairs",),
                  lambda b, c, k: lateral.fan_out(b["internal_pairs"], c.lateral, k, samples=20),
                  lambda: _strings("source_ip", _tag("targets", "targets")),
                  lambda: _more(_strings("source_ip"), "sample_targets", 10), _lateral_techniques,
                  ("protocol", "targets", "connections", "sample_targets")),
        Detection("ntlm_relay", LATERAL, "ntlm_relay", ("ntlm",),
                  lambda b, c, k: lateral.ntlm_relay(b["ntlm"], c.lateral, k, samples=10),
                  lambda: _more(_strings("hostname"), "sample_targets", 5), lambda: _strings("hostname"),
                  _fixed("T1557.001"), ("targets", "auth_count", "sample_targets")),
        Detection("large_transfers", EXFIL, "large_data_transfer", ("pairs",),
                  lambda b, c, k: exfil.large_transfers(b["pairs"], c.exfil, k),
                  lambda: _strings("source_ip", "destination_ip"), lambda: _strings("source_ip"),
                  _fixed("T1041"), ("bytes_out", "bytes_in", "mb_out", "connections")),
        Detection("asymmetric_traffic", EXFIL, "asymmetric_traffic", ("pairs",),
                  lambda b, c, k: exfil.asymmetric_traffic(b["pairs"], c.exfil, k),
                  lambda: _strings("source_ip", F.concat(F.lit("ratio:"), F.format_string("%.1f", "out_in_ratio"))),
                  lambda: _strings("source_ip"), _fixed("T1048"),
                  ("bytes_out", "bytes_in", "out_in_ratio", "unique_destinations")),
        Detection("dns_exfiltration", EXFIL, "dns_exfiltration", ("subdomains",),
                  lambda b, c, k: exfil.dns_exfiltration(b["subdomains"], c.exfil, k, samples=3),
                  lambda: _strings("source_ip", "parent_domain"), lambda: _strings("source_ip"),
                  _fixed("T1048.003"),
                  ("unique_subdomains", "total_queries", "estimated_bytes", "sample_subdomains")),
        Detection("cloud_uploads", EXFIL, "cloud_exfiltration", ("http",),
                  lambda b, c, k: exfil.cloud_uploads(b["http"], c.exfil, k),
                  lambda: _strings("source_ip", "service"), lambda: _strings("source_ip"),
                  _fixed("T1567"), ("uploads",)),
        Detection("cryptomining", IMPACT, "cryptomining", ("flows", "dns_summary"),
                  lambda b, c, k: impact.cryptomining(b["flows"], b["dns_summary"], c.impact, k, samples=20),
                  lambda: _more(_more(_strings("source_ip"), "sample_pools", 3), "sample_endpoints", 3),
                  lambda: _strings("source_ip"), _fixed("T1496"),
                  ("pool_domains", "stratum_endpoints", "sample_pools", "sample_endpoints")),
        Detection("ransomware_spread", IMPACT, "ransomware_spread", ("internal_pairs",),
                  lambda b, c, k: impact.ransomware_spread(b["internal_pairs"], c.impact, k, samples=20),
                  lambda: _strings("source_ip", _tag("targets", "targets")),
                  lambda: _more(_strings("source_ip"), "sample_targets", 10), _fixed("T1486", "T1021.002"),
                  ("targets", "connections", "hosts_per_min", "sample_targets")),
        Detection("ddos_participation", IMPACT, "ddos_participation", ("pairs",),
                  lambda b, c, k: impact.ddos_participation(b["pairs"], c.impact, k),
                  lambda: _strings("source_ip", "top_target"), lambda: _strings("source_ip"),
                  _fixed("T1498"), ("total_connections", "target_share")),
    )
}


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind == "array":
        return F.array_join(F.col(name).cast("array<string>"), ",")
    if kind == "double":
        return F.round(F.col(name), 4).cast("string")
    return F.col(name).cast("string")


def to_findings(measures: DataFrame, detection: Detection, extra_keys: Sequence[str] = ()) -> DataFrame:
    activity = F.lit(detection.activity_type) if detection.activity_type else F.col("activity_type")
    pairs = [p for name in detection.evidence for p in (F.lit(name), _as_text(measures, name))]
    out = measures.select(
        *extra_keys,
        F.lit(detection.agent).alias("agent"),
        activity.alias("activity_type"),
        detection.indicators().alias("indicators"),
        detection.assets().alias("affected_assets"),
        detection.techniques().alias("mitre_techniques"),
        F.col("confidence"),
        F.create_map(*pairs).alias("evidence"),
        F.lit(1).alias("evidence_count"),
    )
    return out.withColumn(
        "fingerprint",
        text.fingerprint("activity_type", "indicators", "affected_assets", "mitre_techniques"),
    )


def prepare(
    bundle: dict[str, DataFrame], extra_keys: Sequence[str] = (), keep: Callable[[DataFrame, str], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Add the shared partial aggregates to a bundle of log frames.

    ``keep(df, name)`` may write a partial once (``session.stage``), so that
    the detections over it scan a small table instead of each repeating the
    wide shuffle.
    """
    stored = keep is not None
    keep = keep or (lambda df, name: df)
    out = dict(bundle)
    if "connections" in out and "flows" not in out:
        out["flows"] = keep(flow_summary(out["connections"], extra_keys), "flows")
        if stored:  # cheap to read again, so it can prefilter the raw rows
            out["stored_flows"] = out["flows"]
    if "flows" in out:
        out.setdefault("pairs", exfil.outbound_pairs(out["flows"], extra_keys))
        out.setdefault("internal_pairs", lateral.internal_pairs(out["flows"], extra_keys))
    if "dns" in out and "dns_summary" not in out:
        out["dns_summary"] = keep(c2.dns_summary(out["dns"], extra_keys), "dns-summary")
    if "dns_summary" in out and "subdomains" not in out:
        out["subdomains"] = keep(c2.subdomain_counts(out["dns_summary"], extra_keys), "subdomains")
    return out


def run_detections(
    bundle: dict[str, DataFrame],
    cfg: HuntConfig = HuntConfig(),
    extra_keys: Sequence[str] = (),
    registry: dict[str, Detection] | None = None,
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """All enabled detections whose inputs are present, as one union."""
    needed = {n for name, det in (registry or DETECTIONS).items() if name not in cfg.disabled for n in det.needs}
    ready = prepare(bundle, extra_keys, keep if needed & {"flows", "pairs", "internal_pairs", "dns_summary", "subdomains"} else None)
    parts = []
    for name, detection in (registry or DETECTIONS).items():
        if name in cfg.disabled or not set(detection.needs) <= set(ready):
            continue
        parts.append(to_findings(detection.run(ready, cfg, extra_keys), detection, extra_keys))
    if not parts:
        raise ValueError("no enabled detection has its inputs in the bundle")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def asset_rows(found: DataFrame, pairs: DataFrame | None, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Every asset of every finding: (extra keys, fingerprint, asset).

    A finding row names the first targets of a fan-out; this table has all of
    them, from the internal pairs the finding was made of.
    """
    named = found.select(*extra_keys, "fingerprint", F.explode("affected_assets").alias("asset"))
    if pairs is None:
        return named.distinct()
    spread = found.where((F.col("activity_type") == "ransomware_spread") | F.col("evidence")["protocol"].isNotNull()).select(
        *extra_keys, "fingerprint", F.get("affected_assets", F.lit(0)).alias("source_ip"),
        F.coalesce(F.col("evidence")["protocol"], F.lit("SMB")).alias("protocol"),
    )
    reached = pairs.join(spread, [*extra_keys, "source_ip", "protocol"])
    return named.unionByName(reached.select(*extra_keys, "fingerprint", F.col("destination_ip").alias("asset"))).distinct()
