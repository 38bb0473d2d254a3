"""Which detector families to run, and in what order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquarry import fixed_values as fv

AGENTS = tuple(sorted(fv.AGENT_TACTICS))
# Weights of the priority score and its baseline families.
WEIGHTS = {"threat_relevance": 0.4, "asset_criticality": 0.3, "temporal_urgency": 0.2, "agent_confidence_history": 0.1}
BASELINE_AGENTS = ("c2_hunter", "reconnaissance_hunter")


def with_agents(hunts: DataFrame, agents: Sequence[str] = AGENTS) -> DataFrame:
    return hunts.withColumn("agent", F.explode(F.array(*[F.lit(a) for a in agents])))


def parallel(hunts: DataFrame, agents: Sequence[str] = AGENTS) -> DataFrame:
    return with_agents(hunts, agents).withColumn("score", F.lit(0.8))


def suggestions(hypotheses: DataFrame, key: str = "hunt_id", agents: Sequence[str] = AGENTS) -> DataFrame:
    return (
        hypotheses.select(key, "priority", F.explode("suggested_agents").alias("agent"))
        .where(F.col("agent").isin(*agents))
        .groupBy(key, "agent")
        .agg(F.max("priority").alias("priority"), F.count(F.lit(1)).alias("suggestions"))
    )


def sequential(hypotheses: DataFrame, key: str = "hunt_id", agents: Sequence[str] = AGENTS) -> DataFrame:
    """Only suggested families, by the best hypothesis priority."""
    return suggestions(hypotheses, key, agents).select(key, "agent", F.col("priority").alias("score"))


def adaptive(
    hunts: DataFrame,
    hypotheses: DataFrame,
    history: DataFrame | None = None,
    key: str = "hunt_id",
    agents: Sequence[str] = AGENTS,
    weights: dict[str, float] = WEIGHTS,
) -> DataFrame:
    """Weighted score of suggestion, assets, urgency and past confidence; the
    baseline families never fall below 0.5; scores under 0.3 are left out.

    ``hunts`` carries critical_assets, privileged_sessions, is_business_hours
    and total_alerts_24h; ``history`` carries (agent, average_confidence).
    """
    base = with_agents(hunts, agents).join(suggestions(hypotheses, key, agents), [key, "agent"], "left")
    if history is not None:
        base = base.join(history.select("agent", "average_confidence"), "agent", "left")
    else:
        base = base.withColumn("average_confidence", F.lit(None).cast("double"))
    relevance = F.when(
        F.col("suggestions") > 0, F.least(0.8 + (F.col("suggestions") - 1) * 0.1, F.lit(1.0))
    ).otherwise(0.3)
    assets = F.when(F.col("critical_assets") > 0, 0.8).otherwise(0.5)
    assets = F.when(F.col("privileged_sessions") > 0, F.least(assets + 0.2, F.lit(1.0))).otherwise(assets)
    urgency = F.when(F.col("total_alerts_24h") > 100, 0.9).when(~F.col("is_business_hours"), 0.7).otherwise(0.5)
    score = (
        relevance * weights["threat_relevance"]
        + assets * weights["asset_criticality"]
        + urgency * weights["temporal_urgency"]
        + F.coalesce("average_confidence", F.lit(0.5)) * weights["agent_confidence_history"]
    )
    floor = F.when(F.col("agent").isin(*BASELINE_AGENTS), 0.5).otherwise(0.0)
    return base.select(key, "agent", F.greatest(score, floor).alias("score")).where(F.col("score") >= 0.3)


def agent_history(runs: DataFrame) -> DataFrame:
    """Mean confidence, runs and successes per family (agent, confidence, success)."""
    return runs.groupBy("agent").agg(
        F.avg("confidence").alias("average_confidence"),
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(F.col("success")).alias("success_count"),
    )


def adjust_weights(weights: DataFrame, feedback: DataFrame) -> DataFrame:
    """Add feedback (name, adjustment), clamp to 0..1 and normalise to 1.
    The frame holds one row per score weight."""
    moved = weights.join(feedback, "name", "left").withColumn(
        "weight",
        F.when(
            F.col("adjustment").isNotNull(),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight") + F.col("adjustment"))),
        ).otherwise(F.col("weight")),
    )
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return moved.select("name", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")).alias("weight"))


def _pairs(spark, table: dict[str, Sequence[str]], left: str, right: str) -> DataFrame:
    rows = [(k, x) for k, xs in table.items() for x in xs]
    return spark.createDataFrame(rows, f"{left} string, {right} string")


def tactic_agents(spark) -> DataFrame:
    """(tactic, agent) pairs."""
    return _pairs(spark, fv.AGENT_TACTICS, "agent", "tactic").select("tactic", "agent")


def tactic_progression(spark) -> DataFrame:
    return _pairs(spark, fv.TACTIC_PROGRESSION, "tactic", "next_tactic")


def tactic_techniques(spark) -> DataFrame:
    return _pairs(spark, fv.TACTIC_TECHNIQUES, "tactic", "technique")


def next_stage_agents(detected: DataFrame, key: str = "hunt_id", agents: Sequence[str] = AGENTS) -> DataFrame:
    """Families covering the tactics that may follow the detected ones
    (key, tactic); the lookup tables are fixed and broadcast."""
    spark = detected.sparkSession
    return (
        detected.join(F.broadcast(tactic_progression(spark)), "tactic")
        .select(key, F.col("next_tactic").alias("tactic"))
        .join(F.broadcast(tactic_agents(spark)), "tactic")
        .where(F.col("agent").isin(*agents))
        .select(key, "agent")
        .distinct()
    )
