"""Cases: escalation, creation, merging, filters, statistics.

A case's assets and findings can be many, so they live in their own tables
(case_id, asset) and (case_id, finding_id); the case row keeps counts and a
sorted preview.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import net, text, times
from netquarry.operators.common import latest, smallest_values

OPEN = ("new", "investigating")
# Import severity ids and case statuses by verdict.
SEVERITY_IDS = {1: "low", 2: "medium", 3: "high", 4: "critical"}
VERDICT_STATUS = {"tp": "confirmed_tp", "fp": "confirmed_fp"}
VERDICT_TEXT = {
    "tp": "confirmed malicious / true positive",
    "fp": "confirmed benign / false positive",
    "uncertain": "uncertain / requires further investigation",
}


def escalation(confidence: Column, respond: float = 0.95, investigate: float = 0.80, case: float = 0.60) -> Column:
    return (
        F.when(confidence >= respond, "auto_respond")
        .when(confidence >= investigate, "auto_investigate")
        .when(confidence >= case, "human_review")
        .otherwise("log_only")
    )


def case_id(*key_cols: str) -> Column:
    """Deterministic id from the assessment's key."""
    return F.concat(F.lit("case-"), F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]), 256), 1, 12))


def case_title(techniques: Column, confidence: Column) -> Column:
    pct = F.format_string("%.0f%%", confidence * 100)
    return F.when(
        F.size(techniques) > 0,
        F.concat(F.lit("Threat activity detected: "), F.array_join(F.slice(techniques, 1, 3), ", "),
                 F.lit(" (confidence: "), pct, F.lit(")")),
    ).otherwise(F.concat(F.lit("Automated hunt finding (confidence: "), pct, F.lit(")")))


def new_cases(assessments: DataFrame, keys: Sequence[str], created_at: str, source: str = "autonomous") -> DataFrame:
    """Case rows for assessments at or above the case threshold."""
    level = escalation(F.col("final_confidence"))
    return (
        assessments.withColumn("escalation_level", level)
        .where(F.col("escalation_level") != "log_only")
        .select(
            case_id(*keys).alias("case_id"), *keys,
            case_title(F.col("mitre_techniques"), F.col("final_confidence")).alias("title"),
            F.format_string("Hunt with %d findings, combined confidence %.2f.",
                            "total_findings", "final_confidence").alias("description"),
            F.lit("new").alias("status"), "severity",
            F.col("final_confidence").alias("confidence"), "mitre_techniques",
            F.col("recommendations").alias("recommended_actions"),
            "escalation_level", F.lit(source).alias("source"), F.col(created_at).alias("created_at"),
        )
    )


def case_assets(findings: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (case_id, asset), from findings or from their table of assets."""
    listed = findings.select(*keys, "asset") if "asset" in findings.columns else findings.select(*keys, F.explode("affected_assets").alias("asset"))
    return (
        listed.distinct()
        .join(cases.select("case_id", *keys), list(keys))
        .select("case_id", "asset")
    )


def case_findings(findings: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (case_id, finding_id)."""
    return (
        findings.select(*keys, F.col("fingerprint").alias("finding_id"))
        .distinct()
        .join(cases.select("case_id", *keys), list(keys))
        .select("case_id", "finding_id")
    )


def with_preview(cases: DataFrame, assets: DataFrame, links: DataFrame, n: int = 20) -> DataFrame:
    """Case rows with asset and finding counts and the first assets by name."""
    a = assets.groupBy("case_id").agg(F.count(F.lit(1)).alias("asset_count"))
    f = links.groupBy("case_id").agg(F.count(F.lit(1)).alias("finding_count"))
    return (
        cases.join(a, "case_id", "left").join(f, "case_id", "left")
        .join(smallest_values(assets, ["case_id"], "asset", n, "first_assets"), "case_id", "left")
        .na.fill(0, ["asset_count", "finding_count"])
    )


def link_findings(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Many-to-many links; adding a link twice changes nothing."""
    return existing.unionByName(added).dropDuplicates(["case_id", "finding_id"])


def open_case_index(
    cases: DataFrame, assets: DataFrame, as_of, window_hours: float
) -> DataFrame:
    """Newest open case per (asset, technique) inside the window.

    A case overlaps a new one in techniques and in assets exactly when they
    share such a pair; keeping the newest per pair bounds the join to one
    match per pair however many cases share a hot asset.
    """
    recent = cases.where(F.col("status").isin(*OPEN) & times.within("created_at", as_of, window_hours))
    pairs = recent.select("case_id", "created_at", "confidence", F.explode("mitre_techniques").alias("technique")).join(
        assets, "case_id"
    )
    return pairs.groupBy("asset", "technique").agg(
        F.max(F.struct("created_at", "case_id", "confidence")).alias("open_case")
    )


def match_open_cases(candidates: DataFrame, candidate_assets: DataFrame, index: DataFrame) -> DataFrame:
    """The newest overlapping open case per candidate case, if any."""
    pairs = candidates.select("case_id", F.explode("mitre_techniques").alias("technique")).join(
        candidate_assets, "case_id"
    )
    return (
        pairs.join(index, ["asset", "technique"])
        .groupBy("case_id")
        .agg(F.max("open_case").alias("open_case"))
        .select("case_id", F.col("open_case.case_id").alias("open_case_id"))
    )


def moved(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows of a case under the id of the open case it went to, if any."""
    to = matches.select(F.col("case_id").alias("_from"), "open_case_id")
    out = rows.join(to, F.col("case_id") == F.col("_from"), "left").withColumn("case_id", F.coalesce("open_case_id", "case_id"))
    return out.drop("_from", "open_case_id").distinct()


def merge_cases(existing: DataFrame, candidates: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated existing cases, candidates that stay new): a matched open case
    takes the greater confidence."""
    gain = (
        candidates.join(matches, "case_id")
        .groupBy(F.col("open_case_id").alias("case_id"))
        .agg(F.max("confidence").alias("_gain"))
    )
    updated = existing.join(gain, "case_id", "left").withColumn(
        "confidence", F.greatest("confidence", F.coalesce("_gain", F.lit(0.0)))
    ).drop("_gain")
    fresh = candidates.join(matches.select("case_id"), "case_id", "left_anti")
    return updated, fresh


def filter_cases(
    cases: DataFrame, links: DataFrame | None = None, status=None, severity=None,
    escalation_level=None, source=None, limit: int = 100, sample: int = 100,
) -> DataFrame:
    """Newest cases by the given filters, with their linked finding ids."""
    out = cases
    for name, value in (("status", status), ("severity", severity),
                        ("escalation_level", escalation_level), ("source", source)):
        if value is not None:
            out = out.where(F.col(name) == value)
    out = out.orderBy(F.desc("created_at"), F.asc("case_id")).limit(limit)
    if links is None:
        return out
    mine = links.join(F.broadcast(out.select("case_id")), "case_id")
    counts = mine.groupBy("case_id").agg(F.count(F.lit(1)).alias("finding_count"))
    first = smallest_values(mine, ["case_id"], "finding_id", sample, "findings")
    return out.join(counts, "case_id", "left").join(first, "case_id", "left").na.fill(0, ["finding_count"])


def case_timeline(cases: DataFrame, wanted: str) -> DataFrame:
    """Dated events of one case, oldest first."""
    one = cases.where(F.col("case_id") == wanted)
    events = F.array(
        F.struct(F.lit("created").alias("event"), F.col("created_at").alias("at")),
        F.struct(F.lit("updated").alias("event"), F.col("updated_at").alias("at")),
        F.struct(F.lit("resolved").alias("event"), F.col("resolved_at").alias("at")),
    )
    return one.select("case_id", F.inline(events)).where(F.col("at").isNotNull()).orderBy("at", "event")


def resolve(cases: DataFrame, verdict_log: DataFrame) -> DataFrame:
    """Apply the latest verdict per case (case_id, verdict, notes, timestamp)."""
    last = verdict_log.groupBy("case_id").agg(
        latest("verdict").alias("analyst_verdict"), latest("notes").alias("analyst_notes"),
        F.max("timestamp").alias("resolved_at"),
    )
    status = (
        F.when(F.col("analyst_verdict") == "tp", "confirmed_tp")
        .when(F.col("analyst_verdict") == "fp", "confirmed_fp")
        .when(F.col("analyst_verdict").isNotNull(), "closed")
        .otherwise(F.col("status"))
    )
    keep = [c for c in cases.columns if c not in ("analyst_verdict", "analyst_notes", "resolved_at")]
    return cases.select(*keep).join(last, "case_id", "left").withColumn("status", status)


def case_statistics(cases: DataFrame) -> DataFrame:
    """Counts by status, severity, escalation and verdict and in total, in one
    grouping-sets aggregate: (facet, value, cases)."""
    facets = ["status", "severity", "escalation_level", "analyst_verdict"]
    grouped = cases.groupingSets([[F.col(f)] for f in facets] + [[]], *facets).agg(
        *[F.grouping(f).alias(f"_g_{f}") for f in facets], F.count(F.lit(1)).alias("cases")
    )
    facet = F.coalesce(*[F.when(F.col(f"_g_{f}") == 0, F.lit(f)) for f in facets], F.lit("total"))
    value = F.coalesce(*[F.when(F.col(f"_g_{f}") == 0, F.col(f)) for f in facets])
    out = grouped.select(facet.alias("facet"), value.alias("value"), "cases")
    return out.where(~((F.col("facet") == "analyst_verdict") & F.col("value").isNull()))


# --- exchange with an external case system ---------------------------------

def outcome_verdict(classification: Column) -> Column:
    """tp / fp / uncertain from a resolution classification."""
    c = F.lower(F.coalesce(classification, F.lit("")))
    return (
        F.when(F.contains(c, F.lit("true")) | F.contains(c, F.lit("malicious")), "tp")
        .when(F.contains(c, F.lit("false")) | F.contains(c, F.lit("benign")), "fp")
        .otherwise("uncertain")
    )


def import_cases(external: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Case rows from an external feed (case_id, case_name, case_description,
    case_severity_id, case_status_id, case_tags, classification), skipping the
    ones already imported (external_id)."""
    closed = F.col("case_status_id").isin(1, 2)
    verdict = outcome_verdict(F.col("classification"))
    severity = F.coalesce(
        *[F.when(F.col("case_severity_id") == i, F.lit(s)) for i, s in SEVERITY_IDS.items()], F.lit("medium")
    )
    feed = external.withColumn("external_id", F.col("case_id").cast("string"))
    if known is not None:
        feed = feed.join(known.select("external_id").distinct(), "external_id", "left_anti")
    return feed.select(
        "external_id",
        F.concat(F.lit("case-"), F.substring(F.sha2(F.concat(F.lit("import|"), "external_id"), 256), 1, 12)).alias("case_id"),
        F.coalesce("case_name", F.concat(F.lit("Case #"), "external_id")).alias("title"),
        F.coalesce("case_description", F.lit("")).alias("description"),
        severity.alias("severity"),
        text.technique_ids(F.concat_ws(" ", "case_tags", "classification")).alias("mitre_techniques"),
        F.when(closed & (verdict == "tp"), "confirmed_tp").when(closed & (verdict == "fp"), "confirmed_fp")
        .when(closed, "closed").otherwise("investigating").alias("status"),
        F.when(closed, verdict).alias("analyst_verdict"),
        F.lit(0.5).alias("confidence"), F.lit("import").alias("source"),
        F.lit("human_review").alias("escalation_level"),
    )


def import_assets(indicators: DataFrame) -> DataFrame:
    """All indicator values of each case (case_id, position, ioc_value)."""
    return indicators.where(F.coalesce("ioc_value", F.lit("")) != "").select("case_id", F.col("ioc_value").alias("asset"))


def verdict_updates(cases: DataFrame, external: DataFrame) -> DataFrame:
    """Verdicts for cases closed outside but open here."""
    closed = external.where(F.col("case_status_id").isin(1, 2)).select(
        F.col("case_id").cast("string").alias("external_id"),
        outcome_verdict(F.col("classification")).alias("verdict"),
    )
    return (
        cases.where(F.col("status").isin(*OPEN)).select("case_id", "external_id")
        .join(closed, "external_id")
        .select("case_id", "external_id", "verdict")
    )


def push_payload(cases: DataFrame) -> DataFrame:
    """Case rows as outgoing payloads with a markdown description."""
    severity_id = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in SEVERITY_IDS.items()], F.lit(2))
    actions = F.when(
        F.size("recommended_actions") > 0,
        F.concat(F.lit("\n\n**Recommended Actions:**\n"),
                 F.array_join(F.transform("recommended_actions", lambda a: F.concat(F.lit("- "), a)), "\n")),
    ).otherwise("")
    body = F.concat(
        F.lit("Case "), "case_id", F.lit("\n\n"), "description",
        F.lit("\n\n**Confidence:** "), F.format_string("%.0f%%", F.col("confidence") * 100),
        F.lit("\n**Escalation Level:** "), "escalation_level",
        F.lit("\n**MITRE Techniques:** "), F.array_join("mitre_techniques", ", "), actions,
    )
    return cases.select(
        F.col("title").alias("case_name"), body.alias("case_description"), F.lit(1).alias("case_customer"),
        F.col("case_id").alias("case_soc_id"), severity_id.alias("case_severity_id"),
    )


def push_indicators(cases: DataFrame, assets: DataFrame) -> DataFrame:
    """One indicator row per case asset: type 1 for addresses, else 6."""
    is_ip = net.is_ipv4("asset") | F.contains(F.col("asset"), F.lit(":"))
    tags = cases.select("case_id", F.array_join(F.slice("mitre_techniques", 1, 5), ",").alias("ioc_tags"))
    return assets.join(tags, "case_id").select(
        F.col("case_id").alias("case_soc_id"), F.col("asset").alias("ioc_value"),
        F.when(is_ip, 1).otherwise(6).alias("ioc_type_id"), "ioc_tags",
    )
