"""Flow summary: the shared partial aggregate under the connection detectors.

Seventeen detections group the same connections by source, by pair, or by
(pair, port). All of them are roll-ups of one table keyed by (extra keys,
source, destination, port), so the wide shuffle over raw rows happens once and
a host that owns a third of the traffic is already split over its destinations
and ports before anything is grouped by host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.functions import net

FLOW_KEYS = ("source_ip", "destination_ip", "destination_port")


def flow_summary(connections: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    cols = set(connections.columns)

    def col(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in cols else F.lit(default)

    ts = F.col("timestamp") if "timestamp" in cols else F.lit(None).cast("timestamp")
    state = col("conn_state", "")
    grouped = connections.groupBy(*extra_keys, *FLOW_KEYS).agg(
        F.count(F.lit(1)).alias("connections"),
        F.count_if(state.isin(*fv.REJECTED_STATES)).alias("rejected"),
        F.sum(col("bytes_in", 0).cast("bigint")).alias("bytes_in"),
        F.sum(col("bytes_out", 0).cast("bigint")).alias("bytes_out"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(ts).alias("timed"),
    )
    return grouped.withColumn("src_internal", net.is_internal("source_ip")).withColumn(
        "dst_internal", net.is_internal("destination_ip")
    )


def as_flows(df: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Accept either raw connections or an existing flow summary."""
    return df if "src_internal" in df.columns else flow_summary(df, extra_keys)


def present(name: str):
    return F.coalesce(F.col(name), F.lit("")) != ""
