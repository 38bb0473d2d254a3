"""Similarity search over embedding columns and its upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import text


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays, null for zero vectors."""
    def dot(x, y):
        prod = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def top_k(
    collection: DataFrame, query: Column, k: int, where: dict[str, object] | None = None,
    embedding: str = "embedding", tie: str = "doc_id",
) -> DataFrame:
    """The k most similar rows; ``query`` is a literal array or a scalar
    subquery. Each task keeps its own top k, only those meet."""
    rows = collection
    for name, value in (where or {}).items():
        rows = rows.where(F.col(name) == value)
    return (
        rows.withColumn("_query", query)
        .withColumn("similarity", cosine(F.col(embedding), F.col("_query")))
        .drop("_query")
        .where(F.col("similarity").isNotNull())
        .orderBy(F.desc("similarity"), F.asc(tie))
        .limit(k)
    )


def upsert_by_content(stored: DataFrame, added: DataFrame, order: str = "updated_at") -> DataFrame:
    """Rows keyed by the hash of their text; the newest version wins. Both
    frames hold text, embedding, metadata (string) and the order column."""
    rows = stored.select("text", "embedding", "metadata", order).unionByName(
        added.select("text", "embedding", "metadata", order)
    )
    newest = rows.groupBy(text.content_id("text").alias("doc_id")).agg(
        F.max(F.struct(order, "text", "embedding", "metadata")).alias("_r")
    )
    return newest.select("doc_id", "_r.*")


def finding_text() -> Column:
    """A finding row as one searchable line."""
    def listed(label, col, n):
        return F.when(F.size(col) > 0, F.concat(F.lit(label), F.array_join(F.slice(col, 1, n), ", ")))

    return F.concat_ws(
        " | ",
        F.concat(F.lit("["), F.upper(F.coalesce("severity", F.lit("?"))), F.lit("] "), F.coalesce("activity_type", F.lit("?"))),
        F.nullif(F.col("description"), F.lit("")),
        listed("Indicators: ", "indicators", 10), listed("MITRE: ", "mitre_techniques", 5),
        F.when(F.coalesce("agent", F.lit("")) != "", F.concat(F.lit("Agent: "), "agent")),
    )


# Baseline facts in the order they are written out.
BASELINE_FACTS = (
    "total_nodes", "internal_nodes", "top_ports", "top_protocols", "dns_servers",
    "domain_controllers", "gateways", "description",
)


def baseline_text(columns: list[str]) -> Column:
    """A baseline row as one line; absent, empty and zero facts are left out."""
    facts = [
        F.when(
            F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0", "[]"),
            F.concat(F.lit(f"{c}: "), F.col(c).cast("string")),
        )
        for c in BASELINE_FACTS if c in columns
    ]
    return F.concat_ws(" | ", F.concat(F.lit("Baseline ("), F.coalesce("type", F.lit("network")), F.lit(")")), *facts)


def intel_text() -> Column:
    def listed(label, col, n):
        return F.when(F.size(col) > 0, F.concat(F.lit(label), F.array_join(F.slice(col, 1, n), ", ")))

    return F.concat_ws(
        " | ",
        F.concat(F.lit("["), F.coalesce("source", F.lit("?")), F.lit("] "), F.coalesce("type", F.lit("?"))),
        F.nullif(F.col("description"), F.lit("")), listed("IOCs: ", "iocs", 10), listed("TTPs: ", "ttps", 5),
    )


def context_block(findings: DataFrame, baselines: DataFrame, intel: DataFrame, query: Column,
                  counts: tuple[int, int, int] = (5, 3, 5)) -> DataFrame:
    """The best matches of the three collections with section and rank."""
    parts = []
    for section, (name, df, n, cut) in enumerate(
        (("findings", findings, counts[0], 500), ("baselines", baselines, counts[1], 400), ("threat_intel", intel, counts[2], 400))
    ):
        best = top_k(df, query, n).agg(
            F.array_sort(F.collect_list(F.struct(F.negative("similarity").alias("s"), F.col("doc_id").alias("d"),
                                                 F.substring("text", 1, cut).alias("t")))).alias("_hits")
        )
        parts.append(
            best.select(F.lit(section).alias("section"), F.lit(name).alias("collection"), F.posexplode("_hits").alias("pos", "hit"))
            .select("section", "collection", (F.col("pos") + 1).alias("rank"), F.col("hit.d").alias("doc_id"),
                    F.negative(F.col("hit.s")).alias("similarity"), F.col("hit.t").alias("text"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
