"""Feedback: precision, calibration, playbooks, strategy statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators.common import latest


def technique_precision(verdicts: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Precision per technique from (technique_id, verdict) rows, optionally
    added to stored counts (technique_id, true_positives, false_positives,
    uncertain)."""
    v = F.col("verdict")
    counts = verdicts.groupBy("technique_id").agg(
        F.count_if(v == "tp").alias("true_positives"),
        F.count_if(v == "fp").alias("false_positives"),
        F.count_if(F.coalesce(~v.isin("tp", "fp"), F.lit(True))).alias("uncertain"),
    )
    if seed is not None:
        names = ["technique_id", "true_positives", "false_positives", "uncertain"]
        counts = counts.select(*names).unionByName(seed.select(*names)).groupBy("technique_id").agg(
            *[F.sum(n).alias(n) for n in names[1:]]
        )
    judged = F.col("true_positives") + F.col("false_positives")
    return counts.withColumn(
        "precision", F.when(judged > 0, F.col("true_positives") / judged).otherwise(0.5)
    )


def case_technique_verdicts(cases: DataFrame, verdict: str = "analyst_verdict") -> DataFrame:
    """(technique_id, verdict) rows of resolved cases."""
    return cases.where(F.col(verdict).isNotNull()).select(
        F.explode("mitre_techniques").alias("technique_id"), F.col(verdict).alias("verdict")
    )


def precision_tiers(precision: DataFrame) -> DataFrame:
    p = F.col("precision")
    return precision.withColumn(
        "tier", F.when(p >= 0.7, "high_precision").when(p >= 0.3, "medium_precision").otherwise("low_precision")
    )


def reliable_techniques(precision: DataFrame, samples: int = 2) -> DataFrame:
    """High and low tiers of techniques with enough judged cases."""
    judged = F.col("true_positives") + F.col("false_positives")
    return precision_tiers(precision.where(judged >= samples)).where(F.col("tier") != "medium_precision")


def outcome(verdict: Column) -> Column:
    return F.when(verdict == "tp", 1.0).when(verdict == "fp", 0.0).otherwise(0.5)


def calibration_points(history: DataFrame, order: tuple[str, ...], keep: int = 500) -> DataFrame:
    """The last ``keep`` (predicted, actual) points: a bounded top-k."""
    return (
        history.select(*order, F.col("confidence").alias("predicted"), outcome(F.col("verdict")).alias("actual"))
        .orderBy(*[F.desc(c) for c in order])
        .limit(keep)
    )


def calibration_factors(probes: DataFrame, points: DataFrame, band: float = 0.1) -> DataFrame:
    """Factor per distinct probe confidence from past outcomes within the band.

    ``points`` is limited to 500 rows, so it travels as one array (a scalar
    subquery) and each probe filters it: no join. The band test works on
    integer millionths.
    """
    unit = 1_000_000
    packed = points.agg(
        F.coalesce(
            F.collect_list(F.struct(F.round(F.col("predicted") * unit).cast("bigint").alias("p"), F.col("actual").alias("a"))),
            F.array().cast("array<struct<p:bigint,a:double>>"),
        )
    )
    q = F.round(F.col("confidence") * unit).cast("bigint")
    out = probes.select("confidence").distinct().withColumn("_points", packed.scalar()).withColumn(
        "_near", F.filter("_points", lambda x: F.abs(x.getField("p") - q) <= int(band * unit))
    )
    near = F.size("_near")
    mean = F.aggregate("_near", F.lit(0.0), lambda acc, x: acc + x.getField("a")) / near
    factor = F.greatest(F.lit(0.5), F.least(F.lit(1.5), mean / F.col("confidence")))
    usable = (F.size("_points") >= 10) & (near >= 3) & (F.col("confidence") > 0)
    return out.select("confidence", near.alias("near"), F.when(usable, factor).otherwise(1.0).alias("factor"))


def feedback_metrics(feedback: DataFrame) -> DataFrame:
    """Counts, precision and false-positive rate over a verdict log."""
    v = F.col("verdict")
    out = feedback.agg(
        F.count(F.lit(1)).alias("total_feedback"),
        F.count_if(v == "tp").alias("true_positives"),
        F.count_if(v == "fp").alias("false_positives"),
        F.count_if(~v.isin("tp", "fp")).alias("uncertain"),
    )
    judged = F.col("true_positives") + F.col("false_positives")
    return out.withColumn(
        "precision", F.when(judged > 0, F.col("true_positives") / judged).otherwise(0.0)
    ).withColumn(
        "false_positive_rate", F.when(judged > 0, F.col("false_positives") / judged).otherwise(0.0)
    )


def recent_feedback(feedback: DataFrame, order: tuple[str, ...], keep: int = 1000) -> DataFrame:
    return feedback.orderBy(*[F.desc(c) for c in order]).limit(keep)


def playbook_key(techniques: Column) -> Column:
    """All techniques, in order."""
    return F.array_join(F.array_sort(techniques), "_")


def playbooks(history: DataFrame) -> DataFrame:
    """Per technique key: attempts, successes, distinct successful family
    combinations and the first of them (timestamp, techniques, agents, success)."""
    rows = history.select(
        "timestamp", "success", playbook_key(F.col("techniques")).alias("playbook"),
        F.array_join(F.array_sort("agents"), ",").alias("combination"),
    )
    per_combo = rows.groupBy("playbook", "combination").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("success")).alias("ok"),
        F.min(F.when(F.col("success"), F.col("timestamp"))).alias("first_ok"),
    )
    won = F.when(F.col("ok") > 0, F.struct("first_ok", "combination"))
    return per_combo.groupBy("playbook").agg(
        F.sum("n").alias("total_count"), F.sum("ok").alias("success_count"),
        F.count(won).alias("combinations"),
        F.min(won).getField("combination").alias("recommended"),
    )


def recommend_strategy(queries: DataFrame, books: DataFrame) -> DataFrame:
    """The recommended families for each technique list with a won playbook."""
    return (
        queries.withColumn("playbook", playbook_key(F.col("techniques")))
        .join(books.where(F.col("success_count") > 0).select("playbook", "recommended"), "playbook")
        .withColumn("agents", F.split("recommended", ","))
    )


PLAYBOOK = "playbook string, total_count bigint, success_count bigint, combinations bigint, recommended string"


def export_playbooks(books: DataFrame, folder: str) -> None:
    """Playbooks as JSON lines, nulls written out, so that another installation can load them."""
    books.select(*[part.split()[0] for part in PLAYBOOK.split(", ")]).write.option("ignoreNullFields", "false").mode("errorifexists").json(folder)


def import_playbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Playbooks that ``export_playbooks`` wrote; broken lines and those without a key are left out."""
    rows = spark.read.schema(PLAYBOOK + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(folder)
    return rows.where(F.col("_broken").isNull() & F.col("playbook").isNotNull()).drop("_broken")


def merge_playbooks(own: DataFrame, imported: DataFrame) -> DataFrame:
    """Own and imported playbooks by key: attempts and successes add up; the
    recommended combination is the own one, where there is any success."""
    both = own.withColumn("_own", F.lit(0)).unionByName(imported.withColumn("_own", F.lit(1)))
    won = F.when(F.col("recommended").isNotNull(), F.struct("_own", "recommended"))
    return both.groupBy("playbook").agg(
        F.sum("total_count").alias("total_count"), F.sum("success_count").alias("success_count"),
        F.max("combinations").alias("combinations"), F.min(won).getField("recommended").alias("recommended"),
    )


def arm_statistics(rewards: DataFrame) -> DataFrame:
    """Pulls, successes, mean reward and posterior mean per arm (arm, reward)."""
    out = rewards.groupBy("arm").agg(
        F.count(F.lit(1)).alias("pulls"), F.count_if(F.col("reward") > 0.5).alias("successes"),
        F.avg("reward").alias("mean_reward"),
    )
    return out.withColumn("posterior_mean", (F.col("successes") + 1) / (F.col("pulls") + 2))


def best_arm(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("posterior_mean"), F.asc("arm")).limit(1)


def case_outcomes(cases: DataFrame, verdict_log: DataFrame) -> dict[str, DataFrame]:
    """Everything one resolved case feeds: metrics, precision and calibration
    rows plus the text for the finding memory."""
    last = verdict_log.groupBy("case_id").agg(latest("verdict").alias("verdict"), F.max("timestamp").alias("resolved_at"))
    resolved = cases.drop("verdict", "resolved_at").join(last, "case_id")
    said = (
        F.when(F.col("verdict") == "tp", "confirmed malicious / true positive")
        .when(F.col("verdict") == "fp", "confirmed benign / false positive")
        .otherwise("uncertain / requires further investigation")
    )
    return {
        "metrics": feedback_metrics(resolved),
        "precision": technique_precision(case_technique_verdicts(resolved, "verdict")),
        "calibration": resolved.select("resolved_at", "case_id", "confidence", "verdict"),
        "memory": resolved.select(
            F.concat(F.lit("Case "), "case_id", F.lit(": "), "title", F.lit(" — resolved as "), said,
                     F.lit(". "), "description").alias("text"),
            "mitre_techniques", "severity", "verdict",
        ),
    }
