"""Cross-family correlation: de-duplication, corroboration, chain, confidence.

``keys`` names the columns of one assessment (a hunt, a window, a cycle), so a
whole history is assessed in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.functions.times import severity_name, severity_rank


def family_order(agent: str = "agent", priority: Mapping[str, float] | None = None) -> Column:
    """Sorts families: greater priority first, then as the registry lists them; unknown ones last, by name."""
    names = list(fv.AGENT_TACTICS)
    place = F.coalesce(*[F.when(F.col(agent) == n, F.lit(i)) for i, n in enumerate(names)], F.lit(len(names)))
    weight = F.coalesce(*[F.when(F.col(agent) == a, F.lit(-float(p))) for a, p in (priority or {}).items()], F.lit(0.0))
    return F.struct(weight.alias("p"), place.alias("i"), F.col(agent).alias("a"))


def _family_confidence(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every finding with its family's highest confidence; the few families of one assessment are looked up in a map."""
    best = findings.groupBy(*keys, "agent").agg(F.max("confidence").alias("_family_confidence"))
    if keys:
        return findings.join(best, [*keys, "agent"])
    known = best.agg(F.map_from_entries(F.collect_list(F.struct("agent", "_family_confidence"))).alias("m"))
    return findings.withColumn("_family_confidence", F.try_element_at(known.scalar(), F.col("agent")))


def dedup_findings(findings: DataFrame, keys: Sequence[str] = (), priority: Mapping[str, float] | None = None) -> DataFrame:
    """One row per fingerprint: the family with the highest overall confidence;
    on a tie the one that ``family_order`` puts first."""
    ranked = _family_confidence(findings, keys)
    order = F.struct(
        F.negative("_family_confidence").alias("c"),
        family_order(priority=priority).alias("a"),
        F.negative("confidence").alias("f"),
        F.struct(*[c for c in findings.columns if c not in (*keys, "fingerprint", "evidence")]).alias("row"),
        F.to_json("evidence").alias("evidence") if "evidence" in findings.columns else F.lit("").alias("evidence"),
    )
    kept = ranked.groupBy(*keys, "fingerprint").agg(F.min(order).alias("_pick"))
    out = kept.select(*keys, "fingerprint", "_pick.row.*", F.col("_pick.evidence").alias("_evidence"))
    if "evidence" in findings.columns:
        out = out.withColumn("evidence", F.from_json("_evidence", "map<string,string>"))
    return out.select(*findings.columns)


def drop_empty(outputs: DataFrame) -> DataFrame:
    """Family outputs without confidence and findings carry no signal."""
    return outputs.where(~((F.col("confidence") == 0) & (F.col("findings") == 0)))


def corroborate(outputs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Boost a family by the number of other families per shared technique."""
    pairs = outputs.select(*keys, "agent", F.explode("mitre_techniques").alias("technique"))
    others = pairs.withColumn(
        "_others", F.count(F.lit(1)).over(Window.partitionBy(*keys, "technique")) - 1
    )
    counts = others.groupBy(*keys, "agent").agg(F.sum("_others").alias("corroborations"))
    n = F.coalesce("corroborations", F.lit(0))
    return (
        outputs.join(counts, [*keys, "agent"], "left")
        .withColumn("corroborations", n)
        .withColumn("corroboration_boost", 1.0 + 0.2 * F.least(F.col("corroborations"), F.lit(3)))
        .withColumn(
            "boosted_confidence",
            F.least(F.col("confidence") * F.col("corroboration_boost"), F.lit(1.0)),
        )
    )


def follows(first: Column, second: Column) -> Column:
    """Whether one tactic may follow another."""
    allowed = F.lit(False)
    for tactic, nexts in fv.TACTIC_PROGRESSION.items():
        allowed = allowed | ((first == tactic) & second.isin(*nexts))
    return allowed


def is_progression(tactics: Column) -> Column:
    """At least two tactics, every neighbouring pair in progression order."""
    pairs = F.arrays_zip(
        F.slice(tactics, F.lit(1), F.greatest(F.size(tactics) - 1, F.lit(0))).alias("a"),
        F.slice(tactics, F.lit(2), F.greatest(F.size(tactics) - 1, F.lit(0))).alias("b"),
    )
    names = F.transform(pairs, lambda p: follows(p.getItem("a"), p.getItem("b")))
    return (F.size(tactics) >= 2) & F.forall(names, lambda x: x)


def _attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of a one-row-per-key frame: a join on the keys, or scalar
    subqueries where there is a single assessment."""
    if keys:
        return df.join(per_key.select(*keys, *columns), list(keys))
    return df.withColumns({c: per_key.select(c).scalar() for c in columns})


def kill_chain(outputs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Multiply by 1.5 when the families' tactics form a progression, families
    by priority (column ``priority``, if there is one) and then in the
    registry's order. The list per assessment is bounded by the registry."""
    priority = F.col("priority") if "priority" in outputs.columns else F.lit(0.0)
    ordered = F.array_sort(
        F.collect_list(F.struct(F.negative(priority).alias("p"), family_order().alias("a"), F.col("mitre_tactics").alias("t")))
    )
    chains = outputs.groupBy(*keys).agg(
        F.flatten(F.transform(ordered, lambda s: s.getField("t"))).alias("tactic_chain")
    ).withColumn("chain_multiplier", F.when(is_progression(F.col("tactic_chain")), 1.5).otherwise(1.0))
    return _attach(outputs, chains, keys, ("tactic_chain", "chain_multiplier")).withColumn(
        "chain_confidence", F.least(F.col("boosted_confidence") * F.col("chain_multiplier"), F.lit(1.0))
    )


def dampen(outputs: DataFrame, fp_rates: DataFrame | None = None) -> DataFrame:
    """Weigh families down by half their false-positive rate (agent, rate)."""
    if fp_rates is None:
        out = outputs.withColumn("fp_dampening", F.lit(1.0))
    else:
        rates = fp_rates.select("agent", F.col("false_positive_rate").alias("_rate"))
        out = outputs.join(rates, "agent", "left").withColumn(
            "fp_dampening", 1.0 - 0.5 * F.coalesce("_rate", F.lit(0.0))
        ).drop("_rate")
    return out.withColumn("adjusted_confidence", F.col("chain_confidence") * F.col("fp_dampening"))


def score_outputs(outputs: DataFrame, keys: Sequence[str] = (), fp_rates: DataFrame | None = None) -> DataFrame:
    return dampen(kill_chain(corroborate(drop_empty(outputs), keys), keys), fp_rates)


def alert_level(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.9, "critical").when(confidence >= 0.7, "high")
        .when(confidence >= 0.5, "medium").otherwise("low")
    )


def technique_similarity(outputs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean Jaccard similarity of technique sets over family pairs whose union
    is not empty; at most one array entry per registered family."""
    sets = F.array_sort(F.collect_list(F.struct(F.col("agent").alias("a"), F.col("mitre_techniques").alias("t"))))
    per_key = outputs.groupBy(*keys).agg(sets.alias("_sets"))

    def jaccard(x, y):
        both = F.size(F.array_intersect(x, y))
        either = F.size(F.array_union(x, y))
        return F.when(either > 0, both / either)

    scores = F.flatten(
        F.transform(
            F.col("_sets"),
            lambda x: F.transform(
                F.filter(F.col("_sets"), lambda y: y.getField("a") > x.getField("a")),
                lambda y: jaccard(x.getField("t"), y.getField("t")),
            ),
        )
    )
    kept = F.filter(scores, lambda s: s.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, s: acc + s)
    return per_key.withColumn("_n", F.size(kept)).withColumn("_sum", total).select(
        *keys, F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(0.0).alias("correlation_score")
    )


def assess(
    outputs: DataFrame, keys: Sequence[str] = (), fp_rates: DataFrame | None = None
) -> DataFrame:
    """One assessment per key from the family outputs."""
    scored = score_outputs(outputs, keys, fp_rates)
    a = F.col("adjusted_confidence")
    out = scored.groupBy(*keys).agg(
        F.max(a).alias("_max"),
        F.count_if(a > 0.7).alias("_strong"),
        F.count(F.lit(1)).alias("agent_count"),
        F.count_if(a > 0.5).alias("corroborating_agents"),
        F.sum("findings").alias("total_findings"),
        F.max(severity_rank("severity")).alias("severity_rank"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("mitre_techniques")))).alias("mitre_techniques"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("recommended_actions")))).alias("_advice"),
    )
    final = F.when(F.col("_strong") >= 2, F.least(F.col("_max") * 1.1, F.lit(1.0))).otherwise(F.col("_max"))
    (hi, hi_advice), (mid, mid_advice) = fv.CONFIDENCE_ADVICE
    extra = (
        F.when(F.col("final_confidence") >= hi, F.array(*[F.lit(x) for x in hi_advice]))
        .when(F.col("final_confidence") >= mid, F.array(*[F.lit(x) for x in mid_advice]))
        .otherwise(F.array().cast("array<string>"))
    )
    out = (
        out.withColumn("final_confidence", final)
        .withColumn("severity", severity_name("severity_rank"))
        .withColumn("alert_level", alert_level(F.col("final_confidence")))
        .withColumn("recommendations", F.array_union("_advice", extra))
        .drop("_max", "_strong", "_advice")
    )
    similarity = technique_similarity(drop_empty(outputs), keys)
    return _attach(out, similarity, keys, ("correlation_score",))


def apply_adjustments(outputs: DataFrame, adjustments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Shift each family by the mean of its findings' adjustments (agent,
    confidence_adjustment), clamp to 0..1 and re-grade."""
    mean = adjustments.groupBy(*keys, "agent").agg(F.avg("confidence_adjustment").alias("avg_adjustment"))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.col("avg_adjustment")))
    return (
        outputs.join(mean, [*keys, "agent"], "left")
        .withColumn("avg_adjustment", F.coalesce("avg_adjustment", F.lit(0.0)))
        .withColumn("confidence", c)
        .withColumn(
            "severity",
            F.when(F.col("confidence") >= 0.8, "critical").when(F.col("confidence") >= 0.6, "high")
            .when(F.col("confidence") >= 0.4, "medium").otherwise("low"),
        )
        .withColumn("severity_rank", severity_rank("severity"))
    )


def evidence_total(contributions: Column) -> Column:
    """Sum of evidence contributions, at most 1."""
    return F.least(F.aggregate(contributions, F.lit(0.0), lambda acc, c: acc + c), F.lit(1.0))


def hypothesis_support(support: DataFrame) -> DataFrame:
    """Confidence of each hypothesis: its own or the best family's, and the
    supporting confidence per family (hypothesis_id, prior, agent, confidence)."""
    per_agent = support.groupBy("hypothesis_id", "agent").agg(
        F.max("prior").alias("prior"), F.max("confidence").alias("confidence")
    )
    return per_agent.groupBy("hypothesis_id").agg(
        F.greatest(F.max("prior"), F.max("confidence")).alias("confidence"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "confidence")))).alias("support"),
    )
