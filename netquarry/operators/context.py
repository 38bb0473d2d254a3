"""Traffic context, state vector, anomalies and hypotheses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.functions import times


def traffic_metrics(connections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Volume, destinations and failures in one pass."""
    return connections.groupBy(*keys).agg(
        F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("total_bytes_in"),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("total_bytes_out"),
        F.count(F.lit(1)).alias("connection_count"),
        F.countDistinct(F.coalesce("destination_ip", F.lit(""))).alias("unique_destinations"),
        F.count_if(F.col("conn_state").isin(*fv.FAILED_STATES)).alias("failed_connections"),
    )


def protocol_distribution(connections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Connections per protocol; ``protocol_map`` folds it to one map per key."""
    return connections.groupBy(*keys, F.coalesce("protocol", F.lit("unknown")).alias("protocol")).agg(
        F.count(F.lit(1)).alias("connections")
    )


def protocol_map(connections: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return protocol_distribution(connections, keys).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("protocol", "connections")))).alias("protocols")
    )


def alert_history(alerts: DataFrame) -> DataFrame:
    """Alert count and the distinct categories of all alerts."""
    kinds = F.array_sort(F.collect_set(F.coalesce("category", F.lit("unknown"))))
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts_24h"), kinds.alias("incident_types"))


def alert_counts(alerts: DataFrame, as_of, keys: Sequence[str] = ()) -> DataFrame:
    """Alerts in the last day and week before ``as_of``, in one pass."""
    ts = F.col("timestamp")
    return alerts.groupBy(*keys).agg(
        F.count_if(times.within(ts, as_of, 24)).alias("alerts_24h"),
        F.count_if(times.within(ts, as_of, 168)).alias("alerts_7d"),
    )


def time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(
        {
            "hour_of_day": F.hour(ts),
            "day_of_week": F.weekday(ts),
            "is_business_hours": (F.hour(ts) >= 8) & (F.hour(ts) < 18),
            "is_weekend": F.weekday(ts) >= 5,
        }
    )


# Context columns with the defaults used when a metrics source lacks them.
CONTEXT_DEFAULTS = {
    "is_holiday": False, "total_bytes_in": 0, "total_bytes_out": 0, "connection_count": 0,
    "unique_destinations": 0, "dns_queries": 0, "failed_connections": 0, "total_alerts_24h": 0,
    "total_alerts_7d": 0, "false_positive_rate": 0.0, "mean_time_to_detect": 0.0,
    "active_campaigns": 0, "ioc_matches": 0, "risk_score": 0.0, "critical_assets": 0,
    "active_users": 0, "privileged_sessions": 0, "system_load": 0.0,
}


def with_context_defaults(df: DataFrame) -> DataFrame:
    """Fill absent context columns and nulls with their defaults."""
    have = set(df.columns)
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value)
            for name, value in CONTEXT_DEFAULTS.items()
        }
    )


def state_vector() -> Column:
    """22 normalised features of one context row, as array<float>."""
    def ratio(name: str, scale: float, cap: bool = True) -> Column:
        value = F.col(name) / F.lit(scale)
        return F.least(value, F.lit(1.0)) if cap else value

    parts = [
        ratio("hour_of_day", 24.0, False), ratio("day_of_week", 7.0, False),
        F.col("is_business_hours"), F.col("is_weekend"), F.col("is_holiday"),
        ratio("total_bytes_in", 1e9), ratio("total_bytes_out", 1e9),
        ratio("connection_count", 10000.0), ratio("unique_destinations", 1000.0),
        ratio("dns_queries", 10000.0), ratio("failed_connections", 1000.0),
        ratio("total_alerts_24h", 100.0), ratio("total_alerts_7d", 1000.0),
        F.col("false_positive_rate"), ratio("mean_time_to_detect", 3600.0),
        ratio("active_campaigns", 10.0, False), ratio("ioc_matches", 100.0), F.col("risk_score"),
        ratio("critical_assets", 100.0, False), ratio("active_users", 1000.0, False),
        ratio("privileged_sessions", 100.0, False), F.col("system_load"),
    ]
    return F.array(*[p.cast("float") for p in parts])


def anomalies(states: DataFrame, order: str, scope: Sequence[str] = (), history: int = 100, needed: int = 10) -> DataFrame:
    """Alert and connection spikes against the mean of the last states.

    ``states`` has one row per window, so the ordered history per scope is
    bounded by the number of windows, not by events.
    """
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(-(history - 1), 0)
    base = states.withColumn("_n", F.count(F.lit(1)).over(w)).withColumns(
        {
            "mean_alerts": F.avg("total_alerts_24h").over(w),
            "mean_connections": F.avg("connection_count").over(w),
        }
    )
    rows = F.array(
        F.when(
            F.col("total_alerts_24h") > F.col("mean_alerts") * 2,
            F.struct(F.lit("alert_volume_spike").alias("type"), F.lit("high").alias("severity"), F.lit(0.7).alias("confidence")),
        ),
        F.when(
            F.col("connection_count") > F.col("mean_connections") * 3,
            F.struct(F.lit("connection_spike").alias("type"), F.lit("medium").alias("severity"), F.lit(0.6).alias("confidence")),
        ),
    )
    return (
        base.where(F.col("_n") >= needed)
        .withColumn("_a", F.explode(F.filter(rows, lambda r: r.isNotNull())))
        .select(*scope, order, "_a.*", "mean_alerts", "mean_connections")
    )


def _strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values]).cast("array<string>")


def hypotheses(signals: DataFrame, hunts: DataFrame, key: str = "hunt_id") -> DataFrame:
    """Threat hypotheses per hunt: first matching rule per signal, one per
    active campaign list, and the three monitoring baselines for hunts where
    neither applied. ``hunts`` has the key and ``active_campaigns`` (array)."""
    signal = F.lower("type")
    rule = F.coalesce(
        *[
            F.when(
                F.greatest(*[F.contains(signal, F.lit(n)) for n in needles], F.lit(False)),
                F.struct(
                    F.lit(kind).alias("hypothesis_type"), _strings(agents).alias("suggested_agents"),
                    F.lit(priority).alias("priority"), _strings(tactics).alias("kill_chain_stages"),
                ),
            )
            for needles, kind, agents, priority, tactics in fv.HYPOTHESIS_RULES
        ]
    )
    cols = [key, "hypothesis_type", "indicator", "suggested_agents", "priority", "confidence", "kill_chain_stages"]
    matched = (
        signals.withColumn("_r", rule)
        .where(F.col("_r").isNotNull())
        .select(key, "_r.*", F.col("type").alias("indicator"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
        .select(*cols)
    )
    campaigns = hunts.where(F.size("active_campaigns") > 0).select(
        key, F.lit("apt_campaign").alias("hypothesis_type"),
        F.get("active_campaigns", F.lit(0)).alias("indicator"),
        _strings(fv.CAMPAIGN_AGENTS).alias("suggested_agents"), F.lit(0.9).alias("priority"),
        F.lit(0.6).alias("confidence"), _strings(()).alias("kill_chain_stages"),
    )
    found = matched.unionByName(campaigns)
    baseline = F.array(
        *[
            F.struct(
                F.lit("kill_chain_stage").alias("hypothesis_type"), F.lit("continuous_monitoring").alias("indicator"),
                _strings(agents).alias("suggested_agents"), F.lit(priority).alias("priority"),
                F.lit(0.4).alias("confidence"), _strings(tactics).alias("kill_chain_stages"),
            )
            for _, agents, priority, tactics in fv.BASELINE_HYPOTHESES
        ]
    )
    quiet = hunts.select(key).join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(quiet.select(key, F.inline(baseline)))
