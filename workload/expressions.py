"""Column helpers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.functions import net, text, times
from netquarry.operators import normalize
from workload import views as v
from workload.views import Registry, out

R = Registry()

_PRIV = "'^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)'"


@R.add("expr_internal_flag", f"""
SELECT source_ip, destination_ip, regexp_matches(source_ip, {_PRIV}) AS src_internal,
  regexp_matches(destination_ip, {_PRIV}) AS dst_internal, count(*) AS connections
FROM v_conn GROUP BY ALL""", ("v_conn",))
def _(spark, sf):
    df = v.connections(spark, sf)
    return out(
        df.groupBy("source_ip", "destination_ip", net.is_internal("source_ip").alias("src_internal"),
                   net.is_internal("destination_ip").alias("dst_internal")).agg(F.count(F.lit(1)).alias("connections"))
    )


@R.add("expr_enrichable_ip", """
WITH ips AS (SELECT (s_suppkey % 256) || '.' || (s_suppkey % 300) || '.' || s_nationkey || '.' || (s_suppkey % 7) AS ip FROM supplier
  UNION ALL SELECT CASE c_custkey % 6 WHEN 0 THEN '172.' || (c_custkey % 40) || '.0.1' WHEN 1 THEN '169.254.' || (c_custkey % 256) || '.9'
    WHEN 2 THEN 'host' || c_custkey WHEN 3 THEN '127.0.0.' || (c_custkey % 256) WHEN 4 THEN '8.8.' || (c_custkey % 256)
    ELSE '203.0.113.' || (c_custkey % 256) END FROM customer),
 o AS (SELECT ip, list_transform(string_split(ip, '.'), lambda x: TRY_CAST(x AS INT)) AS p FROM ips),
 f AS (SELECT ip, coalesce(len(p) = 4 AND len(list_filter(p, lambda x: x IS NOT NULL AND x BETWEEN 0 AND 255)) = 4, false) AS ok, p FROM o)
SELECT ip, ok AND NOT (p[1] IN (10, 127) OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 192 AND p[2] = 168)
  OR (p[1] = 169 AND p[2] = 254)) AS enrichable, count(*) AS n FROM f GROUP BY ALL""")
def _(spark, sf):
    sup, cust = v.table(spark, sf, "supplier"), v.table(spark, sf, "customer")
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    dot = F.lit(".")
    a = sup.select(F.concat(s % 256, dot, s % 300, dot, F.col("s_nationkey"), dot, s % 7).alias("ip"))
    b = cust.select(
        F.when(c % 6 == 0, F.concat(F.lit("172."), c % 40, F.lit(".0.1"))).when(c % 6 == 1, F.concat(F.lit("169.254."), c % 256, F.lit(".9")))
        .when(c % 6 == 2, F.concat(F.lit("host"), c)).when(c % 6 == 3, F.concat(F.lit("127.0.0."), c % 256))
        .when(c % 6 == 4, F.concat(F.lit("8.8."), c % 256)).otherwise(F.concat(F.lit("203.0.113."), c % 256)).alias("ip")
    )
    return out(a.unionByName(b).groupBy("ip", net.is_enrichable("ip").alias("enrichable")).agg(F.count(F.lit(1)).alias("n")))


@R.add("expr_cidr_membership", """
WITH n AS (SELECT *, list_transform(string_split(destination_ip, '.'), lambda x: CAST(x AS BIGINT)) AS p FROM v_conn),
 m AS (SELECT destination_ip, p[1] * 16777216 + p[2] * 65536 + p[3] * 256 + p[4] AS ipn FROM n)
SELECT destination_ip, ipn AS ip_number, (ipn >> 12) = (167772160 >> 12) AS in_slash20, (ipn >> 6) = (3405803776 >> 6) AS in_slash26,
  count(*) AS connections FROM m GROUP BY ALL""", ("v_conn",))
def _(spark, sf):
    df = v.connections(spark, sf)
    return out(
        df.groupBy("destination_ip", net.ip_number("destination_ip").alias("ip_number"),
                   net.in_cidr("destination_ip", "10.0.0.0/20").alias("in_slash20"),
                   net.in_cidr("destination_ip", "203.0.113.0/26").alias("in_slash26"))
        .agg(F.count(F.lit(1)).alias("connections"))
    )


@R.add("expr_subnet24", """
SELECT array_to_string(list_slice(string_split(source_ip, '.'), 1, 3), '.') || '.0/24' AS subnet, count(*) AS connections,
  count(DISTINCT source_ip) AS hosts FROM v_conn GROUP BY 1""", ("v_conn",))
def _(spark, sf):
    return out(
        v.connections(spark, sf).groupBy(net.subnet24("source_ip").alias("subnet"))
        .agg(F.count(F.lit(1)).alias("connections"), F.countDistinct("source_ip").alias("hosts"))
    )


@R.add("expr_domain_parts", """
SELECT domain, p[-2] || '.' || p[-1] AS parent, CASE WHEN len(p) >= 3 THEN array_to_string(list_slice(p, 1, len(p) - 2), '.') END AS sub,
  p[-2] AS sld, p[-1] AS tld, count(*) AS queries
FROM (SELECT domain, string_split(domain, '.') AS p FROM v_dns) GROUP BY ALL""", ("v_dns",))
def _(spark, sf):
    d = "domain"
    return out(
        v.dns(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("queries"))
        .select(d, text.parent_domain(d).alias("parent"), text.subdomain(d).alias("sub"), text.second_level(d).alias("sld"),
                text.top_level(d).alias("tld"), "queries")
    )


@R.add("expr_domain_entropy", """
SELECT domain, round(list_entropy(string_split(lower(domain), '')), 6) AS entropy,
  round(length(regexp_replace(lower(domain), '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) / length(domain), 6) AS consonants,
  regexp_matches(domain, '[0-9]') AS digits FROM (SELECT DISTINCT domain FROM v_dns)""", ("v_dns",))
def _(spark, sf):
    d = "domain"
    return out(
        v.dns(spark, sf).select(d).distinct().select(
            d, text.shannon_entropy(d).alias("entropy"), text.consonant_ratio(d).alias("consonants"), text.has_digit(d).alias("digits"))
    )


@R.add("expr_url_host_entropy", """
SELECT host, round(list_entropy(string_split(lower(host), '')), 6) AS entropy, p[-2] || '.' || p[-1] AS parent, count(*) AS pages
FROM (SELECT host, string_split(host, '.') AS p FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)) GROUP BY ALL""")
def _(spark, sf):
    rows = v.table(spark, sf, "pages").select(F.parse_url("url", F.lit("HOST")).alias("host"))
    return out(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).select(
        "host", text.shannon_entropy("host").alias("entropy"), text.parent_domain("host").alias("parent"), "pages"))


@R.add("expr_mac_normalise", """
SELECT upper(replace(trim(mac), '-', ':')) AS mac, substr(upper(replace(trim(mac), '-', ':')), 1, 8) AS prefix, count(*) AS n FROM (
 SELECT ' ' || substr(md5(CAST(c_custkey % 200 AS VARCHAR)), 1, 2) || '-' || substr(md5(CAST(c_custkey % 200 AS VARCHAR)), 3, 2) || '-' ||
  substr(md5(CAST(c_custkey % 200 AS VARCHAR)), 5, 2) || ':00:00:0' || (c_custkey % 9) AS mac FROM customer) GROUP BY ALL""")
def _(spark, sf):
    c = F.col("c_custkey")
    h = F.md5((c % 200).cast("string"))
    mac = F.concat(F.lit(" "), F.substring(h, 1, 2), F.lit("-"), F.substring(h, 3, 2), F.lit("-"), F.substring(h, 5, 2),
                   F.lit(":00:00:0"), (c % 9).cast("string"))
    return out(v.table(spark, sf, "customer").select(net.normalize_mac(mac).alias("mac"))
               .groupBy("mac", net.mac_prefix("mac").alias("prefix")).agg(F.count(F.lit(1)).alias("n")))


@R.add("expr_finding_fingerprint", """
SELECT source_ip, destination_ip, substr(sha256('t::' || least(source_ip, destination_ip) || '|' || greatest(source_ip, destination_ip) || '::' ||
  source_ip || '::T1046|T1595'), 1, 16) AS fingerprint FROM (SELECT DISTINCT source_ip, destination_ip FROM v_conn)""", ("v_conn",))
def _(spark, sf):
    rows = v.connections(spark, sf).select("source_ip", "destination_ip").distinct()
    fp = text.fingerprint(F.lit("t"), F.array("source_ip", "destination_ip"), F.array("source_ip"), F.array(F.lit("T1595"), F.lit("T1046")))
    return rows.withColumn("fingerprint", fp)


@R.add("expr_content_id", "SELECT doc_id, substr(sha256(text), 1, 24) AS content FROM documents")
def _(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", text.content_id("text").alias("content"))


@R.add("expr_technique_extract", """
WITH t AS (SELECT doc_id, 'tags t' || (1000 + doc_id % 700) || ' and T' || (1000 + doc_id % 40) || '.00' || (doc_id % 9) || ' T' || (1000 + doc_id % 40) || '.00' || (doc_id % 9) AS s FROM documents)
SELECT doc_id, 'T' || (1000 + doc_id % 700) || ',' || 'T' || (1000 + doc_id % 40) || '.00' || (doc_id % 9) AS techniques FROM t""")
def _(spark, sf):
    d = F.col("doc_id")
    t = F.concat(F.lit("T"), 1000 + d % 40, F.lit(".00"), d % 9)
    s = F.concat(F.lit("tags t"), 1000 + d % 700, F.lit(" and "), t, F.lit(" "), t)
    return out(v.table(spark, sf, "documents").select("doc_id", text.technique_ids(s).alias("techniques")))


@R.add("expr_certificate_names", """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'host' || s_suppkey || '.example' END AS cn,
  'Org' || s_nationkey AS org FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    subject = F.when(k % 5 == 0, F.lit("OU=none")).otherwise(F.concat(F.lit("CN=host"), k, F.lit(".example,OU=x")))
    issuer = F.concat(F.lit("CN=ca,O=Org"), F.col("s_nationkey"), F.lit("/C=US"))
    return v.table(spark, sf, "supplier").select("s_suppkey", text.common_name(subject).alias("cn"), text.organisation(issuer).alias("org"))


@R.add("expr_timestamp_parse", """
SELECT event_id, CAST(epoch_us(ts) AS BIGINT) - CASE event_id % 3 WHEN 1 THEN 7200000000 ELSE 0 END AS us FROM events""")
def _(spark, sf):
    e = v.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    sec = F.format_string("%d.%06d", F.floor(F.unix_micros(ts) / 1000000).cast("bigint"), F.unix_micros(ts) % 1000000)
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.when(F.col("event_id") % 3 == 0, sec).when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("+02:00"))).otherwise(F.concat(iso, F.lit("Z")))
    return e.select("event_id", F.unix_micros(times.parse_timestamp(raw)).alias("us"))


@R.add("expr_time_features", """
SELECT hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week, hour(ts) BETWEEN 8 AND 17 AS business, isodow(ts) >= 6 AS weekend,
  count(*) AS events FROM events GROUP BY ALL""")
def _(spark, sf):
    from netquarry.operators.context import time_features
    rows = time_features(v.table(spark, sf, "events").withColumn("timestamp", F.col("ts").cast("timestamp")))
    return out(rows.groupBy("hour_of_day", "day_of_week", F.col("is_business_hours").alias("business"), F.col("is_weekend").alias("weekend"))
               .agg(F.count(F.lit(1)).alias("events")))


@R.add("expr_event_dedup", """
SELECT user_id, event_type, min(CAST(event_id AS BIGINT)) AS event_id FROM events GROUP BY 1, 2""")
def _(spark, sf):
    rows = v.table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return normalize.dedup(rows, ["user_id", "event_type"], prefer=())


@R.add("normalize_connections", """
SELECT source_ip, destination_ip, CAST(destination_port AS BIGINT) AS destination_port, protocol, CAST(sum(bytes_in) AS BIGINT) AS bytes_in,
  CAST(sum(bytes_out) AS BIGINT) AS bytes_out, count(*) AS connections, max(epoch_us(ts)) AS last_us
FROM v_conn GROUP BY ALL""", ("v_conn",))
def _(spark, sf):
    c = v.connections(spark, sf)
    raw = c.select(
        F.col("source_ip").alias("id.orig_h"), F.col("destination_ip").alias("id.resp_h"), F.col("destination_port").cast("string").alias("id.resp_p"),
        F.col("protocol").alias("proto"), F.col("bytes_in").cast("string").alias("resp_bytes"), F.col("bytes_out").cast("string").alias("orig_bytes"),
        F.unix_seconds("timestamp").cast("string").alias("ts"))
    return out(normalize.connections(raw).groupBy("source_ip", "destination_ip", "destination_port", "protocol").agg(
        F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.count(F.lit(1)).alias("connections"),
        F.unix_micros(F.max("timestamp")).alias("last_us")))


@R.add("normalize_dns", """
SELECT source_ip, domain, response_code, count(*) AS queries, max(epoch_us(ts)) AS last_us FROM v_dns GROUP BY ALL""", ("v_dns",))
def _(spark, sf):
    d = v.dns(spark, sf)
    raw = d.select(F.col("source_ip").alias("id.orig_h"), F.col("domain").alias("query"),
                   F.when(F.col("response_code") != "NOERROR", F.col("response_code")).alias("rcode_name"),
                   F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"))
    return out(normalize.dns_queries(raw).groupBy("source_ip", "domain", "response_code").agg(
        F.count(F.lit(1)).alias("queries"), F.unix_micros(F.max("timestamp")).alias("last_us")))


@R.add("normalize_http", """
SELECT source_ip, destination_ip, method, host, uri, user_agent, count(*) AS requests FROM v_http GROUP BY ALL""", ("v_http",))
def _(spark, sf):
    h = v.http(spark, sf)
    raw = h.withColumnsRenamed({"source_ip": "id.orig_h", "destination_ip": "id.resp_h", "timestamp": "ts"})
    return out(normalize.http_requests(raw).groupBy("source_ip", "destination_ip", "method", "host", "uri", "user_agent")
               .agg(F.count(F.lit(1)).alias("requests")))


@R.add("normalize_alert_signals", """
SELECT 'cat' || (event_id % 4) AS type, round(0.6 + (4 - coalesce(CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id % 5 END, 3)) * 0.1, 6) AS confidence,
  count(*) AS signals FROM events WHERE event_type = 'error' GROUP BY ALL""")
def _(spark, sf):
    e = F.col("event_id")
    alerts = v.table(spark, sf, "events").where(F.col("event_type") == "error").select(
        F.concat(F.lit("cat"), e % 4).alias("category"), F.when(e % 5 != 4, (e % 5).cast("int")).alias("severity"),
        F.lit("sig").alias("signature"), F.lit("10.0.0.1").alias("src_ip"), F.lit("203.0.113.1").alias("dest_ip"))
    return out(normalize.alert_signals(alerts).groupBy("type", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("signals")))


@R.add("merge_and_dedup_connections", """
WITH a AS (SELECT source_ip, destination_ip, destination_port, ts, 0 AS r, bytes_out FROM v_conn WHERE sensor_id <> 'sensor0'
  UNION ALL SELECT source_ip, destination_ip, destination_port, ts, 1, bytes_out FROM v_conn WHERE sensor_id <> 'sensor1'),
 p AS (SELECT source_ip, destination_ip, destination_port, ts, min({'r': r, 'b': bytes_out}) AS k FROM a GROUP BY ALL)
SELECT CAST(k.r AS BIGINT) AS source_rank, count(*) AS connections, CAST(sum(k.b) AS BIGINT) AS bytes_out FROM p GROUP BY 1""", ("v_conn",))
def _(spark, sf):
    c = v.connections(spark, sf).select("source_ip", "destination_ip", "destination_port", "timestamp", "bytes_out", "sensor_id")
    merged = normalize.merge_sources([c.where("sensor_id <> 'sensor0'").drop("sensor_id"), c.where("sensor_id <> 'sensor1'").drop("sensor_id")])
    kept = normalize.dedup(merged, list(normalize.CONNECTION_KEYS))
    return out(kept.groupBy("source_rank").agg(F.count(F.lit(1)).alias("connections"), F.sum("bytes_out").alias("bytes_out")))


@R.add("known_node_internal_flag", f"""
SELECT source_ip, regexp_matches(source_ip, {_PRIV}) OR k.ip IS NOT NULL AS internal, count(*) AS connections
FROM v_conn LEFT JOIN (SELECT DISTINCT '198.51.100.' || (s_suppkey % 20 + 1) AS ip FROM supplier) k ON k.ip = source_ip GROUP BY ALL""", ("v_conn",))
def _(spark, sf):
    known = v.table(spark, sf, "supplier").select(F.concat(F.lit("198.51.100."), F.col("s_suppkey") % 20 + 1).alias("ip"))
    rows = normalize.mark_internal(v.connections(spark, sf), "source_ip", "internal", known)
    return out(rows.groupBy("source_ip", "internal").agg(F.count(F.lit(1)).alias("connections")))
