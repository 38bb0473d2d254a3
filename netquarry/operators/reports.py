"""Summaries over events, findings, cycles and assessments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions import text
from netquarry.functions.times import severity_rank


def top_ports(connections: DataFrame, n: int = 10) -> DataFrame:
    return (
        connections.where(F.col("destination_port").isNotNull())
        .groupBy("destination_port").agg(F.count(F.lit(1)).alias("connections"))
        .orderBy(F.desc("connections"), F.asc("destination_port")).limit(n)
    )


def endpoint_counts(connections: DataFrame) -> DataFrame:
    return connections.agg(
        F.count(F.lit(1)).alias("connections"),
        F.countDistinct(F.nullif("source_ip", F.lit(""))).alias("unique_sources"),
        F.countDistinct(F.nullif("destination_ip", F.lit(""))).alias("unique_destinations"),
    )


def state_distribution(connections: DataFrame) -> DataFrame:
    return connections.groupBy(F.coalesce("conn_state", F.lit("unknown")).alias("conn_state")).agg(
        F.count(F.lit(1)).alias("connections")
    )


def top_parent_domains(dns: DataFrame, n: int = 10) -> DataFrame:
    parent = F.coalesce(text.parent_domain("domain"), F.col("domain"), F.lit(""))
    return (
        dns.groupBy(parent.alias("parent_domain")).agg(F.count(F.lit(1)).alias("queries"))
        .orderBy(F.desc("queries"), F.asc("parent_domain")).limit(n)
    )


def ntlm_summary(ntlm: DataFrame) -> DataFrame:
    """Events and distinct host names."""
    return ntlm.agg(F.count(F.lit(1)).alias("events"), F.countDistinct(F.nullif("hostname", F.lit(""))).alias("unique_hosts"))


def alert_categories(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("alerts"))


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Findings with their severity order for a report, most severe first."""
    return findings.withColumn("severity_rank", severity_rank("severity")).orderBy(
        F.desc("severity_rank"), F.desc("confidence"), F.asc("fingerprint")
    )


def report_techniques(findings: DataFrame) -> DataFrame:
    """Distinct techniques with their finding counts."""
    return (
        findings.select("fingerprint", F.explode("mitre_techniques").alias("technique"))
        .groupBy("technique").agg(F.count(F.lit(1)).alias("findings"))
    )


def finding_summary(findings: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """Counts by severity, by family and in total, dismissed ones left out:
    (facet, value, findings)."""
    rows = active_findings(findings, dismissed)
    facets = ["severity", "agent"]
    grouped = rows.groupingSets([[F.col("severity")], [F.col("agent")], []], *facets).agg(
        F.grouping("severity").alias("_s"), F.grouping("agent").alias("_a"), F.count(F.lit(1)).alias("findings")
    )
    return grouped.select(
        F.when(F.col("_s") == 0, "severity").when(F.col("_a") == 0, "agent").otherwise("total").alias("facet"),
        F.when(F.col("_s") == 0, F.col("severity")).when(F.col("_a") == 0, F.col("agent")).alias("value"),
        "findings",
    )


def active_findings(findings: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    if dismissed is None:
        return findings
    return findings.join(dismissed.select("fingerprint").distinct(), "fingerprint", "left_anti")


def dismiss(dismissed: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Dismissed ids with more added; dismissing twice changes nothing."""
    return dismissed.select("fingerprint").unionByName(fingerprints.select("fingerprint")).distinct()


def filter_findings(
    findings: DataFrame, dismissed: DataFrame | None = None, agent: str | None = None,
    min_severity: str | None = None, limit: int = 100, order: str = "created_at",
) -> DataFrame:
    """Newest findings by family and least severity."""
    rows = active_findings(findings, dismissed)
    if agent is not None:
        rows = rows.where(F.col("agent") == agent)
    if min_severity is not None:
        rows = rows.where(severity_rank("severity") >= severity_rank(F.lit(min_severity)))
    return rows.orderBy(F.desc(order), F.asc("fingerprint")).limit(limit)


def cycle_counts(events: DataFrame) -> DataFrame:
    """Events per cycle and type with the per-cycle and grand totals (nulls)."""
    return events.rollup("cycle", "data_type").agg(F.count(F.lit(1)).alias("events"))


def latest_cycle(events: DataFrame) -> DataFrame:
    return events.agg(F.max("cycle").alias("cycle"))


def queue_status(cycle_log: DataFrame) -> DataFrame:
    """Newest state per cycle counted by state (cycle, status, at)."""
    newest = cycle_log.groupBy("cycle").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    return newest.groupBy("status").agg(
        F.count(F.lit(1)).alias("cycles"), F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle")
    )


def next_pending(cycle_log: DataFrame) -> DataFrame:
    newest = cycle_log.groupBy("cycle").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    return newest.where(F.col("status") == "pending").agg(F.min("cycle").alias("cycle"))


def hunt_statistics(assessments: DataFrame, started: str = "window_start") -> DataFrame:
    """Hunts, detections and rates over an assessment log."""
    c = F.col("final_confidence")
    span = (F.unix_micros(F.max(started)) - F.unix_micros(F.min(started))) / 3_600_000_000.0
    out = assessments.agg(
        F.count(F.lit(1)).alias("total_hunts"), F.count_if(c > 0.5).alias("total_detections"),
        F.count_if(c >= 0.7).alias("high_confidence_detections"), span.alias("_hours"),
    )
    return out.select(
        "total_hunts", "total_detections", "high_confidence_detections",
        (F.col("total_detections") / F.col("total_hunts")).alias("detection_rate"),
        F.when(F.col("_hours") > 0, F.col("total_hunts") / F.col("_hours")).otherwise(0.0).alias("hunts_per_hour"),
    )


def most_active_agents(activations: DataFrame, n: int = 5) -> DataFrame:
    return (
        activations.groupBy("agent").agg(F.count(F.lit(1)).alias("activations"))
        .orderBy(F.desc("activations"), F.asc("agent")).limit(n)
    )


def window_statistics(findings: DataFrame, windows: DataFrame, keys: Sequence[str] = ("window_start",)) -> DataFrame:
    """Findings and best confidence per window, windows without findings too."""
    per = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("findings"), F.max("confidence").alias("confidence"))
    return windows.join(per, list(keys), "left").na.fill(0, ["findings"]).na.fill(0.0, ["confidence"])


def high_risk_windows(stats: DataFrame, least: int = 5, n: int = 10, order: str = "window_start") -> DataFrame:
    return stats.where(F.col("findings") >= least).orderBy(F.desc("findings"), F.asc(order)).limit(n)


def window_baselines(stats: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Minimum, mean and maximum of per-window measures and the finding totals."""
    aggs = [f(m).alias(f"{n}_{m}") for m in measures for n, f in (("min", F.min), ("avg", F.avg), ("max", F.max))]
    return stats.agg(
        F.count(F.lit(1)).alias("windows"), F.sum("findings").alias("total_findings"),
        F.avg("findings").alias("avg_findings"), F.count_if(F.col("findings") >= 5).alias("high_risk"), *aggs,
    )


def source_counts(events: DataFrame, source: str, like: str | None = None) -> DataFrame:
    """Events per source, largest first, optionally filtered by a LIKE pattern."""
    rows = events.where(F.col(source).like(like)) if like else events
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), F.asc(source))


def field_coverage(events: DataFrame, source: str) -> DataFrame:
    """Share of non-null values per source and field, in one pass."""
    fields = [c for c in events.columns if c != source]
    wide = events.groupBy(source).agg(F.count(F.lit(1)).alias("events"), *[F.count(F.col(c)).alias(c) for c in fields])
    return wide.unpivot([source, "events"], fields, "field", "present").withColumn(
        "coverage", F.col("present") / F.col("events")
    )
