"""Streaming jobs and source and sink round trips over the given tables.

A stream here reads files of the given tables (or files Spark writes from
them) to their end and lands in the shared folder; the query returns what it
stored.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from netquarry.operators import netmap, normalize
from netquarry.session import fresh_path
from netquarry.sources import bundle, stores, winlog, zeek
from netquarry.streaming import jobs
from workload import maps
from workload import views as v
from workload.views import Registry, out

R = Registry()


def _events_stream(spark, sf, delay):
    schema = v.table(spark, sf, "events").schema
    return jobs.with_event_time(jobs.file_stream(spark, sf, schema, glob="events.parquet"), "ts", delay)


def _drain(stream, name):
    spark = stream.sparkSession
    folder = fresh_path(spark, name)
    jobs.start_sink(stream, folder, fresh_path(spark, name + "-checkpoint")).awaitTermination()
    return spark.read.parquet(folder)


@R.add("stream_tumbling_windows", """
WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS events FROM events GROUP BY 1, 2)
SELECT CAST(epoch(s) AS BIGINT) AS window_start, event_type, events FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def _(spark, sf):
    got = _drain(jobs.window_counts(_events_stream(spark, sf, "10 minutes"), ["event_type"], "1 hour"), "tumbling")
    return out(got.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "events"))


@R.add("stream_sliding_windows", """
WITH w AS (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE]) AS s, ts FROM events),
 c AS (SELECT s, count(*) AS events FROM w WHERE ts >= s AND ts < s + INTERVAL 20 MINUTE GROUP BY 1)
SELECT CAST(epoch(s) AS BIGINT) AS window_start, events FROM c WHERE s + INTERVAL 20 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def _(spark, sf):
    got = _drain(jobs.window_counts(_events_stream(spark, sf, "10 minutes"), [], "20 minutes", "15 minutes"), "sliding")
    return out(got.select(F.unix_seconds("window_start").alias("window_start"), "events"))


@R.add("stream_host_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events),
 s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
 c AS (SELECT user_id, count(*) AS events, min(epoch_us(ts)) AS started, max(ts) AS e FROM s GROUP BY user_id, sid)
SELECT user_id, events, started FROM c WHERE e + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def _(spark, sf):
    got = _drain(jobs.host_sessions(_events_stream(spark, sf, "10 minutes"), ["user_id"], "6 hours"), "sessions")
    return out(got.select("user_id", "events", F.unix_micros("session_start").alias("started")))


@R.add("stream_repeat_suppression", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    stream = _events_stream(spark, sf, "90 days").select("user_id", "event_type", "timestamp")
    return _drain(jobs.suppress_repeats(stream, ("user_id", "event_type")), "distinct").select("user_id", "event_type")


def _cycles(df, name, process, parts):
    """Each part arrives as new files and is drained as one cycle of the same
    checkpointed stream."""
    spark = df.sparkSession
    folder, target, checkpoint = (fresh_path(spark, name + tail) for tail in ("-in", "", "-checkpoint"))
    for part in parts:
        part.write.mode("append").parquet(folder)
        jobs.run_cycles(jobs.file_stream(spark, folder, df.schema), process, target, checkpoint).awaitTermination()
    return target


@R.add("stream_cycle_counts", "SELECT event_type, count(*) AS events, 4::BIGINT AS cycles FROM events GROUP BY 1")
def _(spark, sf):
    e = v.table(spark, sf, "events")
    parts = [e.where(F.col("event_id") % 4 == i) for i in range(4)]
    target = _cycles(e, "counts", lambda b, c: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), parts)
    got = spark.read.parquet(target)
    return out(got.groupBy("event_type").agg(F.sum("n").alias("events"), F.countDistinct("cycle").alias("cycles")))


class Stopped(Exception):
    """Ends a stream between a cycle's write and its commit."""


@R.add("stream_restarted_cycles", """
WITH m AS (SELECT max(ts) AS top FROM events WHERE event_id % 3 = 0),
 k AS (SELECT *, event_id % 3 <> 0 AND ts < (SELECT top FROM m) - INTERVAL 10 DAY AS late FROM events)
SELECT CASE WHEN late THEN 'late' ELSE event_type END AS kind, count(*) AS events FROM k GROUP BY 1""")
def _(spark, sf):
    """A backfill that is stopped after writing each cycle and before committing it, then restarted:
    every row counts once, late ones in their own table."""
    e = v.table(spark, sf, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    folder, target, late, marks, checkpoint = (fresh_path(spark, "restart-" + n) for n in ("in", "out", "late", "marks", "checkpoint"))
    process = jobs.split_late(lambda b, c: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), late, marks, 10 * 86400)

    def stop(cycle):
        raise Stopped(f"cycle {cycle} is written, not committed")

    def start(callback):
        return jobs.run_cycles(jobs.file_stream(spark, folder, e.schema), process, target, checkpoint, callback=callback)

    for part in (e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0")):
        part.write.mode("append").parquet(folder)
        try:
            start(stop).awaitTermination()
        except StreamingQueryException:
            start(None).awaitTermination()
    kept = spark.read.parquet(target).groupBy(F.col("event_type").alias("kind")).agg(F.sum("n").alias("events"))
    gone = spark.read.schema(e.schema).parquet(late).select(F.lit("late").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("events"))
    return out(kept.unionByName(gone))


@R.add("stream_incremental_edges", maps.R.sql["map_edges"])
def _(spark, sf):
    c = v.connections(spark, sf)
    cut = [F.col("source_port") % 3 == i for i in range(3)]
    target = _cycles(c, "edges", jobs.edge_cycle(lambda b: b), [c.where(x) for x in cut])
    return out(jobs.merged_edges(spark, target))


@R.add("stream_cycle_findings", """
WITH d AS (SELECT *, ord % 3 AS part FROM v_dns), a AS (SELECT part, source_ip, count(*) AS t, count(*) FILTER (response_code = 'NXDOMAIN') AS nx FROM d GROUP BY 1, 2)
SELECT source_ip, count(*) AS findings FROM a WHERE t >= 200 OR nx / t >= 0.3 GROUP BY 1""", ("v_dns",))
def _(spark, sf):
    from netquarry.config import HuntConfig
    from netquarry.operators.findings import DETECTIONS
    d = v.dns(spark, sf)
    e = v.table(spark, sf, "events")
    cfg = HuntConfig(disabled=tuple(n for n in DETECTIONS if n != "dns_reconnaissance"))
    parts = [v.dns_of(e.where(F.col("event_id") % 3 == i)) for i in range(3)]
    target = _cycles(d, "findings", jobs.finding_cycle(lambda b: {"dns": b}, cfg), parts)
    got = spark.read.parquet(target)
    return out(got.groupBy(F.get("affected_assets", F.lit(0)).alias("source_ip")).agg(F.count(F.lit(1)).alias("findings")))


@R.add("stream_late_rows", """
WITH m AS (SELECT max(ts) AS top FROM events WHERE event_id % 2 = 0)
SELECT 'late' AS kind, count(*) AS events FROM events, m WHERE event_id % 2 = 1 AND ts < top - INTERVAL 10 DAY
UNION ALL SELECT 'on_time', (SELECT count(*) FROM events) - (SELECT count(*) FROM events, m WHERE event_id % 2 = 1 AND ts < top - INTERVAL 10 DAY)""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    late, marks = fresh_path(spark, "late"), fresh_path(spark, "marks")
    process = jobs.split_late(lambda b, c: b.groupBy().agg(F.count(F.lit(1)).alias("n")), late, marks, 10 * 86400)
    folder, target, checkpoint = fresh_path(spark, "late-in"), fresh_path(spark, "ontime"), fresh_path(spark, "late-checkpoint")
    for rest in (0, 1):
        e.where(F.col("event_id") % 2 == rest).write.mode("append").parquet(folder)
        jobs.run_cycles(jobs.file_stream(spark, folder, e.schema), process, target, checkpoint).awaitTermination()
    kept = spark.read.parquet(target).agg(F.sum("n").alias("events")).select(F.lit("on_time").alias("kind"), "events")
    gone = spark.read.schema(e.schema).parquet(late).agg(F.count(F.lit(1)).alias("events")).select(F.lit("late").alias("kind"), "events")
    return out(kept.unionByName(gone))


# --- sources and sinks -----------------------------------------------------------

_AGG = """SELECT source_ip, destination_ip, CAST(destination_port AS BIGINT) AS destination_port, protocol, CAST(sum(bytes_in) AS BIGINT) AS bytes_in,
  CAST(sum(bytes_out) AS BIGINT) AS bytes_out, count(*) AS connections FROM v_conn GROUP BY ALL"""


def _connection_totals(df):
    return out(df.groupBy("source_ip", "destination_ip", "destination_port", "protocol").agg(
        F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.count(F.lit(1)).alias("connections")))


ZEEK = ("ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "orig_bytes", "resp_bytes", "conn_state", "vlan")


def _zeek_columns():
    plain = ("source_ip", "source_port", "destination_ip", "destination_port", "protocol", "bytes_out", "bytes_in", "conn_state", "vlan")
    return dict(zip(ZEEK, (F.unix_seconds("timestamp"), *[F.col(c) for c in plain])))


def _zeek_rows(spark, sf):
    return v.connections(spark, sf).select(*[x.cast("string").alias(n) for n, x in _zeek_columns().items()])


@R.add("source_zeek_tsv", _AGG, ("v_conn",))
def _(spark, sf):
    folder = fresh_path(spark, "zeek")
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{n}`"), F.lit("-")) for n in ZEEK]).alias("value")
    head = spark.createDataFrame([("#separator \\x09",), ("#fields\t" + "\t".join(ZEEK),)], "value string").coalesce(1)
    head.write.text(folder)
    rows = zeek.header_fields(spark, folder)
    _zeek_rows(spark, sf).select(line).write.mode("append").text(folder)
    return _connection_totals(normalize.connections(zeek.read_log(spark, folder, rows)))


@R.add("source_zeek_folder", """
SELECT source_ip, destination_ip, CAST(destination_port AS BIGINT) AS destination_port, protocol,
  CASE WHEN source_port % 2 = 0 THEN vlan ELSE '0' END AS vlan, CASE WHEN source_port % 2 = 1 THEN sensor_id ELSE 'default' END AS sensor_id,
  CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, count(*) AS connections,
  CAST(sum(source_port) AS BIGINT) AS ports, CAST(min(epoch(ts)) AS BIGINT) AS first_seen, max(conn_state) AS last_state
FROM v_conn GROUP BY ALL""", ("v_conn",))
def _(spark, sf):
    """Two kinds of files side by side: other fields in another order, each under its own header."""
    kinds = (ZEEK, ("sensor_id", *reversed([n for n in ZEEK if n != "vlan"])))
    source = _zeek_columns() | {"sensor_id": F.col("sensor_id")}
    folder, c = fresh_path(spark, "zeek-kinds"), v.connections(spark, sf)
    for kind, fields in enumerate(kinds):
        line = F.concat_ws("\t", *[F.coalesce(source[n].cast("string"), F.lit("-")) for n in fields])
        zeek.write_log(c.where(F.col("source_port") % 2 == kind).select(line.alias("value")), folder, fields)
    got = normalize.connections(zeek.read_folder(spark, folder))
    return out(got.groupBy("source_ip", "destination_ip", "destination_port", "protocol", "vlan", "sensor_id").agg(
        F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.count(F.lit(1)).alias("connections"),
        F.sum("source_port").alias("ports"), F.min(F.unix_seconds("timestamp")).alias("first_seen"), F.max("conn_state").alias("last_state")))


@R.add("source_raw_json_connections", _AGG + " HAVING bool_and(sensor_id IN ('sensor0', 'sensor1', 'sensor2'))", ("v_conn",))
def _(spark, sf):
    raw = _zeek_rows(spark, sf)
    events = raw.select(F.lit("sensor0").alias("host"), F.col("ts").alias("_time"),
                        F.to_json(F.struct(*[F.col(f"`{n}`") for n in ZEEK if n != "ts"])).alias("_raw"))
    return _connection_totals(zeek.scan_connections(events, hosts=["sensor0"]))


@R.add("source_raw_json_dns", "SELECT source_ip, domain, response_code, count(*) AS queries FROM v_dns GROUP BY ALL", ("v_dns",))
def _(spark, sf):
    d = v.dns(spark, sf)
    body = F.struct(F.col("source_ip").alias("id.orig_h"), F.array("domain", F.lit("x")).alias("query"), F.col("response_code").alias("rcode_name"))
    events = d.select(F.lit("s").alias("host"), F.unix_seconds("timestamp").cast("string").alias("_time"), F.to_json(body).alias("_raw"))
    got = zeek.scan_dns(events)
    return out(got.groupBy("source_ip", "domain", "response_code").agg(F.count(F.lit(1)).alias("queries")))


@R.add("source_raw_json_ntlm", "SELECT source_ip, dest_ip, hostname, count(*) AS auths FROM v_ntlm GROUP BY ALL", ("v_ntlm",))
def _(spark, sf):
    n = v.ntlm(spark, sf)
    body = F.struct(F.col("source_ip").alias("id.orig_h"), F.col("dest_ip").alias("id.resp_h"), "hostname", "domainname")
    events = n.select(F.lit("s").alias("host"), F.unix_seconds("timestamp").cast("string").alias("_time"), F.to_json(body).alias("_raw"))
    return out(zeek.scan_ntlm(events).groupBy("source_ip", "dest_ip", "hostname").agg(F.count(F.lit(1)).alias("auths")))


@R.add("source_suricata_eve", """
SELECT 'cat' || (event_id % 6) AS category, CAST(event_id % 4 AS BIGINT) AS severity, count(*) AS alerts FROM events
WHERE event_type = 'error' AND event_id % 4 <= 2 AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY ALL""")
def _(spark, sf):
    e = F.col("event_id")
    folder = fresh_path(spark, "eve")
    kind = F.when(F.col("event_type") == "error", "alert").otherwise("flow")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'")
    alert = F.struct(F.lit("sig").alias("signature"), F.concat(F.lit("cat"), e % 6).alias("category"), (e % 4).cast("int").alias("severity"))
    good = F.to_json(F.struct(kind.alias("event_type"), stamp.alias("timestamp"), F.lit("10.0.0.1").alias("src_ip"), alert.alias("alert")))
    v.table(spark, sf, "events").select(F.explode(F.array(good, F.when(e % 50 == 0, F.lit('{"broken'))) ).alias("value")).where("value IS NOT NULL").write.text(folder)
    got = zeek.read_alerts(spark, folder, "2024-01-20 00:00:00", 240, 2)
    return out(got.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("alerts")))


def _windows(spark, sf):
    e = F.col("event_id")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return v.table(spark, sf, "events").select(
        pick(("security", "security", "sysmon", "security", "powershell", "security", "sysmon", "security", "sysmon", "security"), e % 10).alias("index"),
        pick((4624, 4625, 1, 4688, 4104, 4663, 11, 4698, 13, 4657), e % 10).alias("EventCode"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("_time"), F.concat(F.lit("h"), F.col("user_id") % 9).alias("host"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user"), F.lit("10.0.0.9").alias("src_ip"), F.lit("dc1").alias("dest_host"),
        F.lit("cmd.exe").alias("Process_Name"), F.when(e % 20 == 4, F.lit("Get-Item")).alias("ScriptBlockText"), F.lit("msg").alias("Message"),
        pick(("0x1 DELETE", "WRITE_DAC", "READ"), e % 3).alias("Access_Mask"),
        F.when(e % 10 == 5, F.lit("C:\\a.txt")).when(e % 10 == 9, F.lit("HKLM\\Run\\evil")).alias("Object_Name"),
        F.when(e % 10 == 6, F.lit("C:\\b.txt")).alias("TargetFilename"), F.when(e % 10 == 8, F.lit("HKCU\\x")).alias("TargetObject"),
        F.lit("task").alias("TaskName"))


@R.add("source_windows_events", """
WITH e AS (SELECT event_id, 'h' || (user_id % 9) AS host FROM events)
SELECT data_type, detail, count(*) AS events FROM (
 SELECT CASE WHEN event_id % 10 IN (0, 1) THEN 'authentication_logs' WHEN event_id % 10 IN (2, 3) THEN 'process_logs' WHEN event_id % 10 = 4 THEN 'powershell_logs'
   WHEN event_id % 10 IN (5, 6) THEN 'file_operations' WHEN event_id % 10 = 7 THEN 'scheduled_tasks' ELSE 'registry_changes' END AS data_type,
  CASE event_id % 10 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 2 THEN 'cmd.exe' WHEN 3 THEN 'cmd.exe' WHEN 4 THEN CASE WHEN event_id % 20 = 4 THEN 'Get-Item' ELSE 'msg' END
   WHEN 5 THEN 'a' || CASE event_id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'modify' ELSE 'access' END WHEN 6 THEN 'b' || CASE event_id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'modify' ELSE 'access' END
   WHEN 7 THEN 'created' WHEN 8 THEN 'x' ELSE 'evil' END AS detail FROM e WHERE host IN ('h0', 'h1', 'h5')) GROUP BY 1, 2""")
def _(spark, sf):
    frames = winlog.collect(_windows(spark, sf), ["h0", "h1", "h5"])
    detail = {
        "authentication_logs": F.col("result"), "process_logs": F.col("process_name"), "powershell_logs": F.col("command_line"),
        "file_operations": F.concat(F.substring("filename", 4, 1), "operation"), "scheduled_tasks": F.col("event_type"), "registry_changes": F.col("value_name"),
    }
    parts = [df.select(F.lit(n).alias("data_type"), detail[n].alias("detail")) for n, df in frames.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return out(both.groupBy("data_type", "detail").agg(F.count(F.lit(1)).alias("events")))


@R.add("source_host_investigation", "SELECT 'process_logs' AS data_type, count(*) AS events FROM events WHERE event_id % 10 IN (2, 3) AND user_id % 9 = 4 UNION ALL SELECT 'authentication_logs', count(*) FROM events WHERE event_id % 10 IN (0, 1)")
def _(spark, sf):
    frames = winlog.collect(_windows(spark, sf))
    picked = normalize.host_events({n: frames[n] for n in ("process_logs", "authentication_logs")}, "h4")
    a, b = [df.agg(F.count(F.lit(1)).alias("events")).select(F.lit(n).alias("data_type"), "events") for n, df in picked.items()]
    return a.unionByName(b)


@R.add("source_bundle_range", """
SELECT 'dns_queries' AS data_type, count(*) AS events FROM v_dns WHERE ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20'
UNION ALL SELECT 'network_connections', count(*) FROM v_conn WHERE sensor_id = 'sensor1' AND ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20'""", ("v_dns", "v_conn"))
def _(spark, sf):
    base = fresh_path(spark, "bundle")
    v.dns(spark, sf).write.parquet(f"{base}/dns_queries")
    v.connections(spark, sf).write.parquet(f"{base}/network_connections")
    frames = bundle.load(spark, base, "2024-01-20 00:00:00", "-7d", ["sensor1"], ["dns_queries", "network_connections"])
    a, b = [df.agg(F.count(F.lit(1)).alias("events")).select(F.lit(n).alias("data_type"), "events") for n, df in frames.items()]
    return a.unionByName(b)


@R.add("source_context_data", """
SELECT count(*) FILTER (event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20') AS alerts_24h,
  count(*) FILTER (event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20') AS alerts_7d,
  count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-19 23:00:00' AND TIMESTAMP '2024-01-20') AS connection_count,
  count(DISTINCT user_id) FILTER (ts BETWEEN TIMESTAMP '2024-01-19 23:00:00' AND TIMESTAMP '2024-01-20') AS unique_destinations FROM events""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    conns = e.select("timestamp", F.col("user_id").cast("string").alias("destination_ip"), F.lit(1).alias("bytes_in"), F.lit(1).alias("bytes_out"), F.lit("SF").alias("conn_state"))
    got = bundle.context_data(e.where("event_type = 'error'"), conns, "2024-01-20 00:00:00")
    return out(got, "alerts_24h", "alerts_7d", "connection_count", "unique_destinations")


@R.add("store_events_by_cycle", """
SELECT cycle, 'dns_queries' AS data_type, source_ip, count(*) AS events FROM (SELECT ord % 3 AS cycle, source_ip FROM v_dns) WHERE cycle = 1 GROUP BY ALL""", ("v_dns",))
def _(spark, sf):
    store = fresh_path(spark, "events")
    e = v.table(spark, sf, "events")
    for cycle in range(3):
        stores.append_events(v.dns_of(e.where(F.col("event_id") % 3 == cycle)), store, "dns_queries", cycle, "2024-01-20 00:00:00")
    stores.append_events(v.ntlm(spark, sf), store, "ntlm_logs", 1, "2024-01-20 00:00:00")
    got = stores.cycle_bundle(spark, store, 1)["dns_queries"]
    return out(got.groupBy(F.lit(1).alias("cycle"), F.lit("dns_queries").alias("data_type"), "source_ip").agg(F.count(F.lit(1)).alias("events")))


@R.add("store_retention", "SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS events FROM events WHERE hour(ts) >= 20 GROUP BY 1")
def _(spark, sf):
    store = fresh_path(spark, "kept")
    e = v.table(spark, sf, "events").select("event_id", F.hour("ts").alias("hour"), F.format_string("20240120%02d", F.hour("ts")).alias("collected_hour"))
    e.write.partitionBy("collected_hour").parquet(store)
    stores.drop_expired(spark, store, "2024-01-20 20:30:00")
    return out(spark.read.parquet(store).groupBy("hour").agg(F.count(F.lit(1)).alias("events")))


@R.add("store_insert_findings", "SELECT count(DISTINCT fingerprint) AS findings FROM v_finding", ("v_finding",))
def _(spark, sf):
    store = fresh_path(spark, "findings")
    f = v.findings(spark, sf)
    for part in (f.where("severity = 'low'"), f.where("severity <> 'low'"), f):
        stores.insert_findings(part, store)
    return out(spark.read.parquet(store).agg(F.count(F.lit(1)).alias("findings")))


@R.add("store_versions", "SELECT event_type, count(*) AS events FROM events WHERE event_id % 2 = 1 GROUP BY 1")
def _(spark, sf):
    store = fresh_path(spark, "versions")
    e = v.table(spark, sf, "events")
    for i in (0, 1):
        stores.write_version(e.where(F.col("event_id") % 2 == i), store, i)
    return out(stores.read_latest(spark, store).groupBy("event_type").agg(F.count(F.lit(1)).alias("events")))


@R.add("store_reports_newest", "SELECT event_type, count(*) AS events, 2::BIGINT AS cycle FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, sf):
    store = fresh_path(spark, "reports")
    e = v.table(spark, sf, "events")
    for cycle, kind in ((1, "click"), (2, "error")):
        stores.append_report(e.where(F.col("event_type") == kind).groupBy("event_type").agg(F.count(F.lit(1)).alias("events")), store, cycle, f"2024-01-0{cycle} 00:00:00")
    return out(stores.newest_reports(spark, store), "event_type", "events", "cycle")


@R.add("store_window_results", "SELECT strftime(date_trunc('day', ts), '%Y%m%dT000000') AS window, count(*) AS events FROM events GROUP BY 1")
def _(spark, sf):
    folder = fresh_path(spark, "windows")
    e = v.table(spark, sf, "events").withColumn("window_start", F.date_trunc("day", F.col("ts").cast("timestamp")))
    stores.write_window_results(e.select("window_start", "event_id"), folder)
    got = spark.read.schema("event_id bigint, window string").json(folder)
    return out(got.groupBy("window").agg(F.count(F.lit(1)).alias("events")))


def _save_load(spark, sf):
    folder = fresh_path(spark, "map")
    nodes = maps._map(spark, sf)[0]
    stores.save_map(nodes, folder)
    return stores.load_map(spark, folder)


@R.add("store_map_file", maps.R.sql["map_nodes"])
def _(spark, sf):
    return out(_save_load(spark, sf).withColumn("service_count", F.size("services")), "sensor_id", "vlan", "ip", "node_id", "total_connections",
               "bytes_sent", "bytes_received", "out_degree", "in_degree", "first_seen", "last_seen", "is_internal", "service_count")


_ALL_NODES = "(SELECT DISTINCT sensor_id, vlan, unnest([source_ip, destination_ip]) AS ip FROM v_conn)"


@R.add("store_map_snapshots", f"""SELECT s AS snapshot, count(*) AS nodes, count(DISTINCT sensor_id) AS sensors, min(ip) AS first_ip
FROM {_ALL_NODES}, (SELECT unnest(['first', 'second']) AS s) WHERE s = 'second' OR sensor_id <> 'sensor1' GROUP BY 1""", ("v_conn",))
def _(spark, sf):
    """Two snapshots, the first without one sensor; counts as listed, the rest as loaded."""
    base = fresh_path(spark, "snapshots")
    nodes = maps._map(spark, sf)[0]
    stores.save_snapshot(nodes.where("sensor_id <> 'sensor1'"), base, "first", "2024-01-01 00:00:00")
    stores.save_snapshot(nodes, base, "second", "2024-01-02 00:00:00")
    loaded = None
    for name in ("first", "second"):
        one = stores.load_snapshot(spark, base, name).agg(F.min("ip").alias("first_ip")).withColumn("snapshot", F.lit(name))
        loaded = one if loaded is None else loaded.unionByName(one)
    return out(stores.list_snapshots(spark, base).join(loaded, "snapshot"), "snapshot", "nodes", "sensors", "first_ip")


@R.add("store_mac_history", maps.R.sql["mac_bindings"])
def _(spark, sf):
    folder = fresh_path(spark, "macs")
    stores.save_mac_history(netmap.mac_bindings(maps.leases(spark, sf)), folder)
    return out(stores.load_mac_history(spark, folder).drop("named_at"))


@R.add("store_case_feed", """
SELECT o_orderkey AS case_id, 'T' || (o_orderkey % 9) AS case_tags FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'
  OR (o_orderkey % 3 = 0 AND o_orderdate + INTERVAL 400 DAY >= TIMESTAMP '2000-01-01')""")
def _(spark, sf):
    folder = fresh_path(spark, "cases")
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = v.table(spark, sf, "orders").select(
        k.alias("case_id"), F.concat(F.lit("T"), k % 9).alias("case_tags"), F.date_format(d, "yyyy-MM-dd HH:mm:ss").alias("case_open_date"),
        F.when(k % 3 == 0, F.date_format(d + F.expr("INTERVAL 400 DAYS"), "yyyy-MM-dd HH:mm:ss")).alias("modification_date"))
    stores.write_payloads(rows, folder)
    spark_rows = spark.read.schema("value string").text(folder)
    wrapped = fresh_path(spark, "feed")
    per_file = spark_rows.withColumn("bucket", F.floor(F.get_json_object("value", "$.case_id").cast("bigint") / 200)).groupBy("bucket").agg(F.array_join(F.collect_list("value"), ",").alias("v"))
    per_file.select(F.when(F.col("bucket") % 2 == 0, F.concat(F.lit('{"data": ['), "v", F.lit("]}"))).otherwise(F.concat(F.lit("["), "v", F.lit("]"))).alias("value"))\
        .write.option("maxRecordsPerFile", 1).text(wrapped)
    return out(stores.read_case_feed(spark, wrapped, "2000-01-01 00:00:00"), "case_id", "case_tags")
