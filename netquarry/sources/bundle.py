"""The bundle of normalised frames a hunt reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry import schemas
from netquarry.functions import times
from netquarry.operators import context

# Names under which a hunt knows the data types.
HUNT_NAMES = {
    "network_connections": "connections", "dns_queries": "dns", "http_requests": "http", "ntlm_logs": "ntlm",
}


def load(
    spark: SparkSession, base: str, as_of=None, time_range: str | None = None, hosts: Sequence[str] | None = None,
    types: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Frames of ``base/<data type>`` parquet folders, restricted to a time
    range and sensors. Both restrictions are plain predicates on stored
    columns, so they reach the scan; a ``dt`` partition column also prunes."""
    out = {}
    for name in types or schemas.EVENTS:
        df = spark.read.parquet(f"{base}/{name}")
        if hosts and "sensor_id" in df.columns:
            df = df.where(F.col("sensor_id").isin(*hosts))
        out[name] = in_range(df, as_of, time_range) if time_range else df
    return out


def in_range(df: DataFrame, as_of, time_range: str) -> DataFrame:
    """Rows of a relative range before ``as_of``; prunes ``dt`` where present."""
    hours = times.range_hours(time_range)
    out = df.where(times.within("timestamp", as_of, hours))
    if "dt" in df.columns:
        end = F.lit(as_of).cast("timestamp")
        start = F.timestamp_seconds(F.unix_micros(end) / 1000000.0 - hours * 3600)
        out = out.where(F.col("dt").between(F.to_date(start), F.to_date(end)))
    return out


def between(df: DataFrame, start, end) -> DataFrame:
    """Rows of an absolute range, end excluded."""
    return df.where((F.col("timestamp") >= F.lit(start).cast("timestamp")) & (F.col("timestamp") < F.lit(end).cast("timestamp")))


def for_hunt(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The frames under the names the detections use."""
    return {HUNT_NAMES.get(name, name): df for name, df in frames.items()}


def context_data(alerts: DataFrame, connections: DataFrame, as_of) -> DataFrame:
    """Alert counts of the last day and week and the traffic of the last hour
    before ``as_of``, as one row."""
    counts = context.alert_counts(alerts, as_of)
    traffic = context.traffic_metrics(connections.where(times.within("timestamp", as_of, 1)))
    one = F.lit(1).alias("_one")
    return counts.select(one, "*").join(traffic.select(one, "*"), "_one").drop("_one")
