"""Stored tables: events by cycle, findings, map, MAC history, reports.

All stores are folders of parquet or JSON lines on the shared file system.
Writers append or write a new folder; nothing overwrites what it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry import schemas


def _paths(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, fs = _paths(spark, folder)
    return fs.exists(path)


# --- events ------------------------------------------------------------------

def append_events(events: DataFrame, store: str, data_type: str, cycle: int, collected_at) -> None:
    """Append events of one type and cycle as JSON with their event time."""
    body = F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("event")
    at = F.lit(collected_at).cast("timestamp")
    ts = F.col("timestamp") if "timestamp" in events.columns else at
    events.select(
        body, ts.alias("timestamp"), at.alias("collected_at"), F.date_format(at, "yyyyMMddHH").alias("collected_hour"),
        F.lit(cycle).cast("bigint").alias("cycle"), F.lit(data_type).alias("data_type"),
    ).write.mode("append").partitionBy("collected_hour", "cycle", "data_type").parquet(store)


def read_events(spark: SparkSession, store: str, data_type: str | None = None, cycle: int | None = None, limit: int | None = None) -> DataFrame:
    """Stored events; type and cycle are partition columns, so other
    partitions are not read."""
    rows = spark.read.parquet(store)
    if data_type is not None:
        rows = rows.where(F.col("data_type") == data_type)
    if cycle is not None:
        rows = rows.where(F.col("cycle") == cycle)
    return rows.limit(limit) if limit is not None else rows


def typed(events: DataFrame, data_type: str) -> DataFrame:
    """Stored JSON events as the columns of their type."""
    return events.where(F.col("data_type") == data_type).select(F.from_json("event", schemas.EVENTS[data_type]).alias("e")).select("e.*")


def cycle_bundle(spark: SparkSession, store: str, cycle: int) -> dict[str, DataFrame]:
    """All frames of one cycle, by type."""
    rows = read_events(spark, store, cycle=cycle)
    return {name: typed(rows, name) for name in schemas.EVENTS}


def drop_expired(spark: SparkSession, store: str, cutoff) -> list[str]:
    """Delete the hour partitions collected wholly before the cutoff and
    return them; no data file is rewritten."""
    limit = spark.range(1).select(F.date_format(F.lit(cutoff).cast("timestamp"), "yyyyMMddHH").alias("h")).first()["h"]
    path, fs = _paths(spark, store)
    gone = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("collected_hour=") and name.split("=", 1)[1] < limit:
            fs.delete(status.getPath(), True)
            gone.append(name.split("=", 1)[1])
    return sorted(gone)


# --- findings, enrichments, reports --------------------------------------------

def insert_findings(findings: DataFrame, store: str) -> None:
    """Append findings whose fingerprint is not stored yet, once each."""
    spark = findings.sparkSession
    new = findings.dropDuplicates(["fingerprint"])
    if exists(spark, store):
        new = new.join(spark.read.parquet(store).select("fingerprint"), "fingerprint", "left_anti")
    new.write.mode("append").parquet(store)


def write_version(df: DataFrame, store: str, version: int) -> None:
    """A new version of a table beside the older ones (upserts write here)."""
    df.write.mode("errorifexists").parquet(f"{store}/version={version}")


def read_latest(spark: SparkSession, store: str) -> DataFrame:
    """The newest complete version of a table."""
    path, fs = _paths(spark, store)
    versions = [
        int(s.getPath().getName().split("=", 1)[1]) for s in fs.listStatus(path)
        if s.getPath().getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return spark.read.parquet(f"{store}/version={max(versions)}")


def append_report(report: DataFrame, store: str, cycle: int, created_at) -> None:
    report.withColumn("cycle", F.lit(cycle)).withColumn("created_at", F.lit(created_at).cast("timestamp")).write.mode("append").parquet(store)


def newest_reports(spark: SparkSession, store: str, limit: int = 1) -> DataFrame:
    return spark.read.parquet(store).orderBy(F.desc("created_at"), F.desc("cycle")).limit(limit)


def write_window_results(results: DataFrame, folder: str) -> None:
    """One JSON folder per window."""
    results.withColumn("window", F.date_format("window_start", "yyyyMMdd'T'HHmmss")).write.mode("append").partitionBy("window").json(folder)


# --- network map ------------------------------------------------------------------

def save_map(nodes: DataFrame, folder: str) -> None:
    """One JSON object per node, with every column and whole lists."""
    nodes.write.mode("errorifexists").json(folder)


def load_map(spark: SparkSession, folder: str, schema: str = schemas.NODE) -> DataFrame:
    """Nodes of a map file; a header line and broken lines have no address."""
    rows = spark.read.schema(schema).json(folder)
    return rows.where(F.col("ip").isNotNull())


def load_legacy_map(spark: SparkSession, path: str, schema: str = schemas.NODE) -> DataFrame:
    """Nodes of a single JSON document whose ``nodes`` is a list of nodes, or a map of them by id."""
    text = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.nodes").alias("nodes"))
    listed = F.when(F.startswith("nodes", F.lit("[")), F.from_json("nodes", f"array<struct<{schema}>>"))
    keyed = F.when(F.startswith("nodes", F.lit("{")), F.map_values(F.from_json("nodes", f"map<string,struct<{schema}>>")))
    return text.select(F.inline(F.coalesce(listed, keyed))).where(F.col("ip").isNotNull())


def save_snapshot(nodes: DataFrame, base: str, name: str, saved_at) -> None:
    nodes.withColumn("saved_at", F.lit(saved_at).cast("timestamp")).write.mode("errorifexists").parquet(f"{base}/snapshot={name}")


def list_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """Snapshots with node and sensor counts, newest first."""
    rows = spark.read.parquet(base)
    return (
        rows.groupBy("snapshot")
        .agg(F.count(F.lit(1)).alias("nodes"), F.max("saved_at").alias("saved_at"), F.countDistinct("sensor_id").alias("sensors"))
        .orderBy(F.desc("saved_at"), F.asc("snapshot"))
    )


def load_snapshot(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(base).where(F.col("snapshot") == name).drop("snapshot", "saved_at")


def save_mac_history(bindings: DataFrame, folder: str) -> None:
    """One JSON object per binding, grouped by MAC within files; a MAC's
    bindings are never gathered into one row."""
    bindings.repartition("mac").sortWithinPartitions("mac", "ip").write.mode("errorifexists").json(folder)


def load_mac_history(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(
        "mac string, ip string, vlan string, sensor_id string, first_seen timestamp, last_seen timestamp, hostname string, named_at timestamp"
    ).json(folder)


# --- case feed ----------------------------------------------------------------------

def read_case_feed(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Cases from JSON: an array of cases or ``{"data": [...]}``; optionally
    those opened or modified since a time."""
    case = T.StructType.fromDDL(schemas.CASE_FEED)
    both = T.StructType([*case.fields, T.StructField("data", T.ArrayType(case))])
    rows = spark.read.schema(both).option("multiLine", True).json(path)
    plain = rows.where(F.col("case_id").isNotNull()).drop("data")
    wrapped = rows.where(F.col("data").isNotNull()).select(F.inline("data"))
    out = plain.unionByName(wrapped)
    if since is None:
        return out
    at = F.lit(since).cast("timestamp")
    return out.where((F.col("case_open_date").try_cast("timestamp") >= at) | (F.col("modification_date").try_cast("timestamp") >= at))


def write_payloads(payloads: DataFrame, folder: str) -> None:
    """Outgoing case or indicator payloads as JSON lines."""
    payloads.write.mode("errorifexists").json(folder)
