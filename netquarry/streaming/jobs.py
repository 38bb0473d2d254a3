"""Continuous hunting: windowed aggregates, duplicate suppression, cycles.

A cycle is a micro-batch. Its results go to a folder named by the batch id and
are written with overwrite of that folder alone, so a batch that is retried
after a failure replaces its own output: together with the checkpoint every
cycle counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netquarry.config import HuntConfig
from netquarry.operators import correlate, findings, netmap, rollup

AVAILABLE_NOW = {"availableNow": True}


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A stream of the parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def with_event_time(stream: DataFrame, column: str, delay: str, out: str = "timestamp") -> DataFrame:
    """Event time as a zoned timestamp under a watermark."""
    return stream.withColumn(out, F.col(column).cast("timestamp")).withWatermark(out, delay)


def window_counts(stream: DataFrame, keys: Sequence[str], length: str, slide: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Events per window and key; sliding when ``slide`` is given."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "events"
    )


def host_sessions(stream: DataFrame, keys: Sequence[str], gap: str, ts: str = "timestamp") -> DataFrame:
    """Bursts of a host's activity separated by a quiet gap."""
    return stream.groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(
        *keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events"
    )


def suppress_repeats(stream: DataFrame, keys: Sequence[str] = ("fingerprint",)) -> DataFrame:
    """The first of each key within the watermark delay."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def start_sink(stream: DataFrame, folder: str, checkpoint: str, trigger: Mapping = AVAILABLE_NOW, mode: str = "append") -> StreamingQuery:
    """Append a stream's rows to a parquet folder."""
    return (
        stream.writeStream.format("parquet").outputMode(mode).option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def run_cycles(
    stream: DataFrame, process: Callable[[DataFrame, int], DataFrame], folder: str, checkpoint: str,
    trigger: Mapping = AVAILABLE_NOW, callback: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Run a batch function once per cycle; results land in ``cycle=<id>``."""
    def each(batch: DataFrame, cycle: int) -> None:
        process(batch, cycle).write.mode("overwrite").parquet(f"{folder}/cycle={cycle}")
        if callback:
            callback(cycle)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def finding_cycle(to_bundle: Callable[[DataFrame], dict[str, DataFrame]], cfg: HuntConfig = HuntConfig()) -> Callable[[DataFrame, int], DataFrame]:
    """A cycle that detects and de-duplicates findings in its batch."""
    def process(batch: DataFrame, cycle: int) -> DataFrame:
        found = findings.run_detections(to_bundle(batch), cfg)
        return correlate.dedup_findings(found).withColumn("evidence", F.to_json("evidence"))

    return process


def edge_cycle(to_connections: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], DataFrame]:
    """A cycle that stores its partial edges; ``merged_edges`` sums them up."""
    return lambda batch, cycle: netmap.edges(to_connections(batch))


def merged_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The map's edges over all cycles so far: partial sums merge in any
    order, so no cycle re-reads older events."""
    parts = spark.read.parquet(folder).drop("cycle")
    return netmap.merge_edges(parts, parts.limit(0))


def assess_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """One assessment per finished cycle from the stored findings."""
    return correlate.assess(rollup.agent_rollup(spark.read.parquet(folder), ("cycle",)), ("cycle",))


def split_late(
    process: Callable[[DataFrame, int], DataFrame], late_folder: str, marks: str, delay_seconds: float, ts: str = "timestamp"
) -> Callable[[DataFrame, int], DataFrame]:
    """Wrap a cycle so that rows older than the greatest event time of earlier
    cycles minus the delay go to a side table instead of the cycle.

    The greatest event time of every cycle is one stored number per cycle.
    """
    def wrapped(batch: DataFrame, cycle: int) -> DataFrame:
        spark = batch.sparkSession
        from netquarry.sources.stores import exists

        seen = spark.read.schema("us bigint, cycle bigint").parquet(marks) if exists(spark, marks) else None
        top = seen.where(F.col("cycle") < cycle).agg(F.max("us").alias("us")).scalar() if seen is not None else F.lit(None).cast("bigint")
        late = F.coalesce(F.unix_micros(ts) < top - int(delay_seconds * 1_000_000), F.lit(False))
        marked = batch.withColumn("_late", late)
        marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{late_folder}/cycle={cycle}")
        result = process(marked.where("NOT _late").drop("_late"), cycle)
        batch.agg(F.max(F.unix_micros(ts)).alias("us")).write.mode("overwrite").parquet(f"{marks}/cycle={cycle}")
        return result

    return wrapped


def backfill_then_follow(start: Callable[[Mapping], StreamingQuery], interval: str = "15 minutes") -> StreamingQuery:
    """Drain what is there, then keep following from the same checkpoint."""
    start(AVAILABLE_NOW).awaitTermination()
    return start({"processingTime": interval})
