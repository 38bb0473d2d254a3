"""Packet-table operators over packets derived from lineitem and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.config import PacketConfig
from netquarry.operators import packets as pk
from workload import views as v
from workload.views import Registry, out

R = Registry()

CFG = PacketConfig(scan_ports=5, beacon_packets=10, beacon_cv=0.99, transfer_bytes=60_000)

_V = """v_pkt AS (SELECT source_ip AS src, destination_ip AS dst, source_port AS sport, destination_port AS dport, protocol AS proto,
  CAST(l_linenumber AS INT) AS flags, bytes_in + 64 AS length, epoch(ts) + l_orderkey % 86400 AS time,
  CASE l_orderkey % 7 WHEN 0 THEN 'GET /a' || (l_orderkey % 9) || ' HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || (l_orderkey % 5) || '.example' || chr(13) || chr(10) || 'User-Agent: ua/1' || chr(13) || chr(10)
    WHEN 1 THEN 'binary' ELSE '' END AS payload, l_orderkey
 FROM (SELECT *, l_orderkey, l_linenumber FROM v_raw))"""
_V = _V.replace("(SELECT *, l_orderkey, l_linenumber FROM v_raw)", "v_raw")


def _raw_sql():
    base = v.VIEW_SQL["v_conn"].replace("l_shipdate AS ts\nFROM", "l_shipdate AS ts, l_orderkey, l_linenumber\nFROM").strip()
    return f"v_raw AS ({base}), {_V}"


VP = _raw_sql()


def table(spark, sf):
    key, num = F.col("l_orderkey"), F.col("l_linenumber")
    both = v.connections_with(spark, sf, key, num)
    crlf = F.lit("\r\n")
    return both.select(
        F.col("source_ip").alias("src"), F.col("destination_ip").alias("dst"), F.col("source_port").alias("sport"),
        F.col("destination_port").alias("dport"), F.col("protocol").alias("proto"), num.cast("int").alias("flags"),
        (F.col("bytes_in") + 64).alias("length"), (F.unix_micros("timestamp") / 1000000.0 + key % 86400).alias("time"),
        F.when(key % 7 == 0, F.concat(F.lit("GET /a"), key % 9, F.lit(" HTTP/1.1"), crlf, F.lit("Host: h"), key % 5, F.lit(".example"), crlf, F.lit("User-Agent: ua/1"), crlf))
        .when(key % 7 == 1, "binary").otherwise("").alias("payload"),
    )


@R.add("packet_flows", f"""WITH {VP} SELECT src, dst, CAST(dport AS BIGINT) AS dport, proto, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS bytes_transferred,
  round(min(time), 6) AS first_seen, round(max(time), 6) AS last_seen, round(max(time) - min(time), 6) AS duration FROM v_pkt GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return out(pk.flows(table(spark, sf)))


@R.add("packet_syn_scans", f"""WITH {VP}, s AS (SELECT src, dport FROM v_pkt WHERE proto = 'tcp' AND (flags & 2) <> 0)
SELECT src, count(DISTINCT dport) AS ports_scanned, array_to_string(list_sort(list(DISTINCT dport)), ',') AS ports FROM s GROUP BY 1 HAVING count(DISTINCT dport) >= 5""")
def _(spark, sf):
    return out(pk.syn_scans(table(spark, sf), CFG))


@R.add("packet_beacons", f"""WITH {VP}, p AS (SELECT dst, dport, floor(time * 1000000) / 1000000 AS t FROM v_pkt WHERE proto = 'tcp'),
 g AS (SELECT dst, dport, t - lag(t) OVER (PARTITION BY dst, dport ORDER BY t) AS d FROM p),
 a AS (SELECT dst, dport, count(*) AS events, count(d) AS gaps, avg(d) AS m, stddev_pop(d) AS s FROM g GROUP BY 1, 2)
SELECT dst, CAST(dport AS BIGINT) AS dport, events, gaps, round(m, 3) AS mean_interval, round(1 - s / m, 5) AS regularity, round(least(0.5 + (1 - s / m) * 0.5, 0.95), 5) AS confidence
FROM a WHERE events >= 10 AND m > 0 AND s / m < 0.99""")
def _(spark, sf):
    b = pk.beacons(table(spark, sf), CFG)
    return out(b.select("dst", "dport", "events", "gaps", F.round("mean_interval", 3).alias("mean_interval"),
                        F.round("regularity", 5).alias("regularity"), F.round("confidence", 5).alias("confidence")))


@R.add("packet_large_transfers", f"""WITH {VP} SELECT src, dst, CAST(sum(length) AS BIGINT) AS bytes_transferred, count(*) AS packet_count, round(max(time) - min(time), 6) AS duration
FROM v_pkt GROUP BY 1, 2 HAVING sum(length) >= 60000""")
def _(spark, sf):
    return out(pk.large_transfers(table(spark, sf), CFG))


@R.add("packet_protocol_mismatches", f"""WITH {VP}, t AS (SELECT * FROM v_pkt WHERE proto = 'tcp' AND payload <> '')
SELECT 'http_on_unusual_port' AS type, src AS source_ip, dst AS destination_ip, CAST(dport AS BIGINT) AS port, count(*) AS packets FROM t
WHERE dport NOT IN (80, 443, 8080, 8443) AND (payload LIKE '%HTTP/%' OR payload LIKE '%GET %') GROUP BY ALL
UNION ALL SELECT 'dns_over_tcp', src, dst, CAST(dport AS BIGINT), count(*) FROM t WHERE dport = 53 GROUP BY ALL""")
def _(spark, sf):
    m = pk.protocol_mismatches(table(spark, sf))
    return out(m.groupBy("type", "source_ip", "destination_ip", "port").agg(F.count(F.lit(1)).alias("packets")))


@R.add("packet_http_requests", f"""WITH {VP} SELECT src AS source_ip, 'GET' AS method, '/a' || (l_orderkey % 9) AS uri, 'h' || (l_orderkey % 5) || '.example' AS host, 'ua/1' AS user_agent, count(*) AS requests
FROM v_pkt WHERE proto = 'tcp' AND l_orderkey % 7 = 0 GROUP BY ALL""")
def _(spark, sf):
    h = pk.http_requests(table(spark, sf))
    return out(h.groupBy("source_ip", "method", "uri", "host", "user_agent").agg(F.count(F.lit(1)).alias("requests")))


@R.add("packet_dns_lookups", """
SELECT '10.0.0.' || user_id AS source_ip, 'q' || (event_id % 50) || '.example' AS domain, CASE WHEN event_type = 'error' THEN 'NXDOMAIN' END AS response_code, count(*) AS lookups
FROM events GROUP BY ALL""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)
    q = e.select(
        F.concat(F.lit("10.0.0."), F.col("user_id")).alias("client"), F.lit("10.0.0.53").alias("server"), (F.col("event_id") % 60000).alias("client_port"),
        F.col("event_id").alias("dns_id"), F.concat(F.lit("q"), F.col("event_id") % 50, F.lit(".example.")).alias("qname"),
        F.inline(F.array(
            F.struct(F.lit(False).alias("is_response"), F.lit(None).cast("int").alias("rcode"), F.col("t").alias("time")),
            F.struct(F.lit(True).alias("is_response"), F.when(F.col("event_type") == "error", 3).otherwise(0).alias("rcode"), (F.col("t") + 0.01).alias("time")),
        )),
    )
    return out(pk.dns_lookups(q).groupBy("source_ip", "domain", "response_code").agg(F.count(F.lit(1)).alias("lookups")))


@R.add("packet_agent_features", f"""WITH {VP}, s AS (SELECT src FROM v_pkt WHERE proto = 'tcp' AND (flags & 2) <> 0 GROUP BY 1 HAVING count(DISTINCT dport) >= 5)
SELECT 'network_connections' AS feature, count(*) AS rows FROM (SELECT DISTINCT src, dst, dport, proto FROM v_pkt) UNION ALL SELECT 'port_scan_indicators', count(*) FROM s""")
def _(spark, sf):
    got = pk.agent_features(table(spark, sf), None, "reconnaissance_hunter", CFG)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("feature"), "rows") for n, df in got.items()]
    return parts[0].unionByName(parts[1])
