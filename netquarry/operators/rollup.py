"""Per-family roll-up of findings and the families' running metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.functions.times import severity_rank


def agent_severity(agent: str = "agent", confidence: str = "confidence", findings: str = "findings") -> Column:
    """Each family's own severity rule."""
    a, c, n = F.col(agent), F.col(confidence), F.col(findings)
    return (
        F.when(a == "c2_hunter", F.when(c > 0.8, "critical").when(c > 0.6, "high").otherwise("medium"))
        .when(
            a == "reconnaissance_hunter",
            F.when((c >= 0.8) | (n >= 3), "high").when((c >= 0.6) | (n >= 2), "medium").otherwise("low"),
        )
        .when(a == "impact_hunter", F.when(c > 0.5, "critical").otherwise("high"))
        .otherwise(F.when(c > 0.6, "high").otherwise("medium"))
    )


def recommendations(agent: str, activity_types: str) -> Column:
    """Advice for a family's activity types, in the table's order."""
    rows = [
        F.when(
            (F.col(agent) == who)
            & (F.lit(what == "*") | F.array_contains(F.col(activity_types), F.lit(what))),
            F.lit(advice),
        )
        for who, what, advice in fv.RECOMMENDATIONS
    ]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def agent_tactics(agent: str) -> Column:
    return F.coalesce(
        *[
            F.when(F.col(agent) == name, F.array(*[F.lit(t) for t in tactics]))
            for name, tactics in fv.AGENT_TACTICS.items()
        ],
        F.array().cast("array<string>"),
    )


def agent_rollup(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per family (and key): confidence, severity, techniques, advice.

    Techniques and activity types come from the fixed registry, so their sets
    are bounded however many findings there are; finding rows themselves are
    only counted.
    """
    out = findings.groupBy(*keys, "agent").agg(
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("findings"),
        F.array_sort(F.collect_set("activity_type")).alias("activity_types"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("mitre_techniques")))).alias("mitre_techniques"),
    )
    return (
        out.withColumn("severity", agent_severity())
        .withColumn("severity_rank", severity_rank("severity"))
        .withColumn("mitre_tactics", agent_tactics("agent"))
        .withColumn("recommended_actions", recommendations("agent", "activity_types"))
    )


def agent_metrics(runs: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Running metrics per family from a run log (agent, confidence, findings,
    seconds, timestamp) and a verdict log (agent, verdict)."""
    out = runs.groupBy("agent").agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_if((F.col("confidence") > 0.5) & (F.col("findings") > 0)).alias("total_detections"),
        F.avg("seconds").alias("average_seconds"),
        F.avg("confidence").alias("average_confidence"),
        F.max("timestamp").alias("last_execution"),
    ).withColumn("detection_rate", F.col("total_detections") / F.col("total_analyses"))
    if feedback is None:
        return out
    judged = feedback.groupBy("agent").agg(
        F.count_if(F.col("verdict") == "tp").alias("true_positives"),
        F.count_if(F.col("verdict") != "tp").alias("false_positives"),
    )
    total = F.col("true_positives") + F.col("false_positives")
    return (
        out.join(judged, "agent", "left")
        .na.fill(0, ["true_positives", "false_positives"])
        .withColumn("false_positive_rate", F.when(total > 0, F.col("false_positives") / total).otherwise(0.0))
    )
