"""Zeek TSV logs, Suricata EVE lines and raw JSON events."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquarry import schemas
from netquarry.functions import times
from netquarry.operators import normalize


#: Lines read of each file split when headers are looked up.
HEAD_LINES = 64


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, fields) of every file under a path: its own ``#fields`` line, null if its head has none.

    One task per file split takes the first few lines and stops reading, so
    the logs are not scanned; splits inside a file give no row. The settings
    that deal one split per task hold for this lookup only.
    """
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )

    def head(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("start")[0].as_py() == 0:
                lines = batch.column("value").to_pylist()
                fields = next((line.split("\t")[1:] for line in lines if line.startswith("#fields\t")), None)
                own = [batch.column("file")[0].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([fields], pa.list_(pa.string()))], ["file", "fields"])
            return

    own = {"spark.sql.files.openCostInBytes": str(1 << 40), "spark.sql.execution.arrow.maxRecordsPerBatch": str(HEAD_LINES)}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, value in own.items():
            spark.conf.set(k, value)
        found = [(unquote(r["file"]), r["fields"]) for r in rows.mapInArrow(head, "file string, fields array<string>").collect()]
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    return spark.createDataFrame(found, "file string, fields array<string>")


def header_fields(spark: SparkSession, path: str) -> list[str]:
    """Column names of logs that share one header."""
    kinds = file_headers(spark, path).where("fields IS NOT NULL").select("fields").distinct().limit(2).collect()
    if not kinds:
        raise ValueError(f"no #fields header in the first {HEAD_LINES} lines of the files under {path}")
    if len(kinds) > 1:
        raise ValueError(f"files under {path} have different #fields headers; read_folder reads each under its own")
    return kinds[0]["fields"]


def read_folder(spark: SparkSession, path: str, unheaded: Sequence[str] | None = None) -> DataFrame:
    """Zeek logs as strings, every file under its own ``#fields`` line.

    Files are grouped by header and each group is one scan; columns are united
    by name, and a field that a file lacks is null. ``unheaded`` names the
    fields of files without a header; without it such files are an error. An
    empty file has no rows and needs no header.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in file_headers(spark, path).collect():  # one line per file
        fields = row["fields"] or unheaded
        if not fields:
            raise ValueError(f"no #fields header in the first {HEAD_LINES} lines of {row['file']}")
        groups.setdefault(tuple(fields), []).append(row["file"])
    if not groups:
        raise ValueError(f"no log lines under {path}")
    literal = {f: re.sub(r"([*?\[\]{}\\])", r"\\\1", f) for files in groups.values() for f in files}  # names, not patterns
    parts = [read_log(spark, sorted(literal[f] for f in files), fields) for fields, files in sorted(groups.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_log(spark: SparkSession, path: str | list[str], fields: Sequence[str] | None = None) -> DataFrame:
    """A Zeek log as strings under its own field names; ``-`` is null."""
    names = list(fields or header_fields(spark, path))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (
        spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("nullValue", "-")
        .option("quote", "").option("escape", "").option("mode", "PERMISSIVE").csv(path)
    )


def write_log(lines: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Append the lines of (value) to a folder of Zeek logs, a file per partition, each under its own ``#fields`` line.

    The header goes before the first row of a partition, so nothing is shuffled or sorted.
    """
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # a partition's number stands above bit 33
    head = F.lit("#fields\t" + "\t".join(fields))
    rows = lines.withColumn("_first", first).select(F.explode(F.when(F.col("_first"), F.array(head, "value")).otherwise(F.array("value"))).alias("value"))
    rows.write.mode("append").text(path)


def read_alerts(spark: SparkSession, path: str, as_of=None, hours: float | None = None, least_severity: int = 3) -> DataFrame:
    """Suricata alerts at or above a severity (1 is worst) inside a range;
    broken lines are dropped."""
    rows = spark.read.schema(schemas.EVE).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.where(F.col("_corrupt_record").isNull() & (F.col("event_type") == "alert"))
    out = rows.select(
        times.parse_timestamp("timestamp").alias("timestamp"), F.col("alert.signature").alias("signature"),
        F.col("alert.category").alias("category"), F.coalesce("alert.severity", F.lit(3)).alias("severity"),
        "src_ip", "dest_ip", "src_port", "dest_port", F.col("proto").alias("protocol"),
    ).where(F.col("severity") <= least_severity)
    return out if as_of is None else out.where(times.within("timestamp", as_of, hours))


def first_of(value: Column) -> Column:
    """First element of a value that may be a JSON list; other values as is."""
    listed = F.get(F.from_json(value, "array<string>"), F.lit(0))
    return F.when(F.startswith(value, F.lit("[")), listed).otherwise(value)


def parse_raw(events: DataFrame, fields: Sequence[str], raw: str = "_raw") -> DataFrame:
    """Named fields of a raw JSON column, first value of multi-valued ones;
    other columns (host, _time) are kept.

    Each text is parsed once: as a generator's output, so that filters on the
    fields do not parse it again for every mention.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    keep = [F.col(c) for c in events.columns if c != raw and c not in fields]
    parsed = events.select(*keep, F.inline(F.array(F.from_json(raw, schema))))
    return parsed.select(*keep, *[first_of(F.col(f"`{f}`")).alias(f) for f in fields])


CONNECTION_FIELDS = ("id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "orig_bytes", "resp_bytes", "conn_state", "vlan")
DNS_FIELDS = ("id.orig_h", "query", "rcode_name", "answers", "vlan")
NTLM_FIELDS = ("id.orig_h", "id.resp_h", "hostname", "domainname", "server_nb_computer_name", "server_dns_computer_name", "vlan")


def host_filter(events: DataFrame, hosts: Sequence[str] | None, column: str = "host") -> DataFrame:
    """Keep events of the named sensors; an empty list keeps all."""
    return events.where(F.col(column).isin(*hosts)) if hosts else events


def scan_connections(events: DataFrame, hosts: Sequence[str] | None = None, source_ip: str | None = None) -> DataFrame:
    """Normalised connections from raw JSON events (host, _time, _raw)."""
    rows = normalize.connections(parse_raw(host_filter(events, hosts), CONNECTION_FIELDS))
    return rows.where(F.col("source_ip") == source_ip) if source_ip else rows


def scan_dns(events: DataFrame, hosts: Sequence[str] | None = None) -> DataFrame:
    return normalize.dns_queries(parse_raw(host_filter(events, hosts), DNS_FIELDS))


def scan_ntlm(events: DataFrame, hosts: Sequence[str] | None = None) -> DataFrame:
    return normalize.ntlm_logs(parse_raw(host_filter(events, hosts), NTLM_FIELDS))
