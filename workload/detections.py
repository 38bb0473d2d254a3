"""The twenty detections and their near misses over the telemetry views."""

from __future__ import annotations

from netquarry.config import C2Config, ExfilConfig, ImpactConfig, ReconConfig
from netquarry.operators import c2, exfil, impact, lateral, recon
from workload import views as v
from workload.views import Registry, out

R = Registry()

# Thresholds scaled to the given tables.
C2_CFG = C2Config(regularity=0.3, dga_entropy=3.0, tunnel_subdomains=20)
RECON_CFG = ReconConfig(scan_ports=10, enum_ports=8)
EXFIL_CFG = ExfilConfig(transfer_bytes=5_000_000, unique_subdomains=20)
IMPACT_CFG = ImpactConfig(pool_domains=("pool.example",), ddos_total=100, ddos_share=0.05)


@R.add("c2_beaconing", """
WITH g AS (SELECT source_ip, destination_ip, destination_port, epoch_us(ts) AS us,
             epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY source_ip, destination_ip, destination_port ORDER BY ts) AS d
           FROM v_beacon),
 a AS (SELECT source_ip, destination_ip, destination_port, count(*) AS events,
         count(*) FILTER (d > 0) AS gaps, avg(d / 1e6) FILTER (d > 0) AS m, stddev_pop(d / 1e6) FILTER (d > 0) AS s
       FROM g GROUP BY ALL),
 r AS (SELECT *, 1 - least(s / m, 1.0) AS reg FROM a WHERE events >= 10 AND gaps >= 9 AND m > 0)
SELECT source_ip, destination_ip, CAST(destination_port AS BIGINT) AS destination_port, events, gaps,
  round(m, 3) AS mean_interval, round(s, 3) AS std_dev, round(reg, 6) AS regularity, round(s / m, 6) AS variation,
  round(least(0.65 + (reg - 0.75) + least(events / 50.0, 0.15), 0.95), 6) AS confidence
FROM r WHERE reg >= 0.3""", ("v_beacon",))
def _(spark, sf):
    df = c2.beaconing(v.beacon(spark, sf), C2_CFG)
    from pyspark.sql import functions as F
    return out(df.withColumn("mean_interval", F.round("mean_interval", 3)).withColumn("std_dev", F.round("std_dev", 3)))


@R.add("c2_dga_domains", """
WITH d AS (SELECT domain, string_split(domain, '.')[-2] AS label, arg_min(source_ip, ts) AS source_ip, count(*) AS queries
           FROM v_dns WHERE len(string_split(domain, '.')) >= 2 GROUP BY 1, 2),
 m AS (SELECT *, list_entropy(string_split(lower(label), '')) AS h,
         length(regexp_replace(lower(label), '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) / length(label) AS cr
       FROM d WHERE length(label) >= 10 AND regexp_matches(label, '[0-9]'))
SELECT domain, label, source_ip, queries, round(cr, 6) AS consonant_ratio, round(h, 6) AS entropy,
  round(least(0.55 + (h - 3.5) * 0.25 + (length(label) - 10) * 0.01, 0.92), 6) AS confidence
FROM m WHERE cr > 0.55 AND h >= 3.0""", ("v_dns",))
def _(spark, sf):
    return out(c2.dga_domains(v.dns(spark, sf), C2_CFG))


@R.add("c2_dns_tunneling", """
WITH s AS (SELECT DISTINCT source_ip, parent_domain, subdomain FROM v_subs),
 a AS (SELECT source_ip, parent_domain, count(*) AS n, avg(list_entropy(string_split(lower(subdomain), ''))) AS h,
         array_to_string(list_slice(list_sort(list(subdomain)), 1, 5), ',') AS sample_subdomains
       FROM s GROUP BY 1, 2)
SELECT source_ip, parent_domain, n AS unique_subdomains, round(h, 6) AS avg_entropy, sample_subdomains,
  round(least(0.60 + n / 500 * 0.2 + (h - 3.0) * 0.1, 0.93), 6) AS confidence
FROM a WHERE n >= 20 AND h >= 3.0""", ("v_subs",))
def _(spark, sf):
    return out(c2.dns_tunneling(v.dns(spark, sf), C2_CFG, samples=5))


@R.add("c2_persistent_channels", """
WITH a AS (SELECT source_ip, destination_ip, destination_port, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS dur,
             CAST(sum(bytes_in + bytes_out) AS BIGINT) AS total_bytes, count(*) AS connections
           FROM v_conn GROUP BY 1, 2, 3)
SELECT source_ip, destination_ip, CAST(destination_port AS BIGINT) AS destination_port, round(dur, 6) AS duration_seconds,
  total_bytes, connections, round(least(0.5 + dur / 86400 * 0.2, 0.8), 6) AS confidence
FROM a WHERE dur >= 3600 AND NOT (total_bytes > 10240 AND connections > 5)""", ("v_conn",))
def _(spark, sf):
    return out(c2.persistent_channels(v.connections(spark, sf), C2_CFG))


@R.add("c2_suspicious_ports", """
WITH s AS (SELECT * FROM v_conn WHERE destination_port IN
  (4444,5555,1234,6667,6697,8443,8080,9090,9443,1337,31337,12345,2222,4443,5900,5901)),
 a AS (SELECT source_ip, array_to_string(list_sort(list(DISTINCT destination_port)), ',') AS ports,
         count(DISTINCT destination_port) AS np, count(DISTINCT destination_ip || ':' || destination_port) AS endpoints,
         count(*) AS connections FROM s GROUP BY 1)
SELECT source_ip, ports, endpoints, connections, round(least(0.55 + np * 0.05 + connections * 0.01, 0.8), 6) AS confidence
FROM a WHERE connections >= 3""", ("v_conn",))
def _(spark, sf):
    return out(c2.suspicious_ports(v.connections(spark, sf), C2_CFG))


@R.add("recon_port_scans", """
WITH a AS (SELECT source_ip, count(DISTINCT destination_port) AS p, count(DISTINCT destination_ip) AS h, count(*) AS n,
             count(*) FILTER (conn_state IN ('REJ','S0','RSTOS0','RSTRH')) AS rej,
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 AS mins
           FROM v_conn GROUP BY 1),
 b AS (SELECT *, CASE WHEN n >= 2 AND mins > 0 THEN p / mins ELSE 0.0 END AS ppm,
             CASE WHEN n >= 2 AND mins > 0 THEN h / mins ELSE 0.0 END AS hpm, rej / n AS rr
       FROM a WHERE p >= 10 OR h >= 15)
SELECT source_ip, p AS unique_ports, h AS unique_hosts, n AS total_connections, rej AS rejected,
  round(ppm, 6) AS ports_per_min, round(hpm, 6) AS hosts_per_min, round(rr, 6) AS reject_ratio,
  CASE WHEN ppm > 100 THEN 'Aggressive scan' WHEN h > p THEN 'Host sweep' WHEN p > h * 5 THEN 'Vertical port scan'
       ELSE 'Network scan' END AS scan_type,
  round(least(0.55 + least(ppm / 100, 0.15) + least(p / 200, 0.15) + rr * 0.15, 0.95), 6) AS confidence
FROM b""", ("v_conn",))
def _(spark, sf):
    return out(recon.port_scans(v.connections(spark, sf), RECON_CFG))


@R.add("recon_dns_reconnaissance", """
WITH a AS (SELECT source_ip, count(*) AS t, count(*) FILTER (response_code = 'NXDOMAIN') AS nx,
             count(DISTINCT domain) AS u FROM v_dns GROUP BY 1)
SELECT source_ip, t AS total_queries, nx AS nxdomain_count, u AS unique_domains, round(nx / t, 6) AS nxdomain_ratio,
  round(least(0.4 + least(t / 200, 1.0) * 0.3 + least(nx / t / 0.3, 1.0) * 0.4 + least(u / 100, 0.2), 0.93), 6) AS confidence
FROM a WHERE t >= 200 OR nx / t >= 0.3""", ("v_dns",))
def _(spark, sf):
    return out(recon.dns_reconnaissance(v.dns(spark, sf), RECON_CFG))


@R.add("recon_service_enumeration", """
WITH a AS (SELECT source_ip, destination_ip, count(DISTINCT destination_port) AS p, count(*) AS n,
             count(*) FILTER (conn_state IN ('REJ','S0','RSTOS0','RSTRH')) AS rej FROM v_conn GROUP BY 1, 2)
SELECT source_ip, destination_ip, p AS ports_probed, rej AS rejected, n AS total_connections, round(rej / n, 6) AS reject_ratio,
  round(least(0.55 + p * 0.01 + rej / n * 0.15, 0.9), 6) AS confidence
FROM a WHERE p >= 8 AND rej / n >= 0.6""", ("v_conn",))
def _(spark, sf):
    return out(recon.service_enumeration(v.connections(spark, sf), RECON_CFG))


_FAN_SQL = """
WITH s AS (SELECT *, CASE WHEN destination_port = 3389 THEN 'RDP' WHEN destination_port IN (445, 139) THEN 'SMB'
             WHEN destination_port = 22 THEN 'SSH' WHEN destination_port IN (5985, 5986, 135) THEN 'WinRM/DCOM' END AS pr
           FROM v_conn_int WHERE src_int AND dst_int AND source_ip <> destination_ip),
 a AS (SELECT source_ip, pr AS protocol, count(DISTINCT destination_ip) AS t, count(*) AS n,
         CASE pr WHEN 'RDP' THEN 5 WHEN 'SMB' THEN 5 WHEN 'SSH' THEN 4 ELSE 3 END AS thr
       FROM s WHERE pr IS NOT NULL GROUP BY 1, 2)
SELECT source_ip, protocol, t AS targets, n AS connections,
  CASE protocol WHEN 'RDP' THEN 'rdp' WHEN 'SMB' THEN 'smb' WHEN 'SSH' THEN 'ssh' ELSE 'winrm' END || '_lateral_movement' AS activity_type,
  round(least(0.55 + (t - thr) * 0.05 + n * 0.002, 0.93), 6) AS confidence
FROM a WHERE t >= thr"""

for _proto in ("RDP", "SMB", "SSH", "WinRM/DCOM"):
    def _fan(spark, sf, _proto=_proto):
        df = lateral.fan_out(v.connections(spark, sf))
        return out(df.where(df.protocol == _proto))

    R.add("lateral_fan_out_" + _proto.split("/")[0].lower(), _FAN_SQL + f" AND protocol = '{_proto}'", ("v_conn_int",))(_fan)


@R.add("lateral_fan_out_targets", """
WITH s AS (SELECT DISTINCT source_ip, destination_ip FROM v_conn_int
           WHERE src_int AND dst_int AND source_ip <> destination_ip AND destination_port IN (445, 139)),
 a AS (SELECT source_ip, count(*) AS targets, array_to_string(list_slice(list_sort(list(destination_ip)), 1, 20), ',') AS sample_targets
       FROM s GROUP BY 1)
SELECT * FROM a WHERE targets >= 5""", ("v_conn_int",))
def _(spark, sf):
    df = lateral.fan_out(v.connections(spark, sf), samples=20)
    return out(df.where(df.protocol == "SMB"), "source_ip", "targets", "sample_targets")


@R.add("lateral_ntlm_relay", """
WITH a AS (SELECT hostname, count(DISTINCT dest_ip) AS t, count(*) AS auth_count FROM v_ntlm GROUP BY 1)
SELECT hostname, t AS targets, auth_count, round(least(0.6 + t * 0.05, 0.88), 6) AS confidence FROM a WHERE t >= 3""", ("v_ntlm",))
def _(spark, sf):
    return out(lateral.ntlm_relay(v.ntlm(spark, sf)))


@R.add("exfil_large_transfers", """
WITH a AS (SELECT source_ip, destination_ip, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in,
             count(*) AS connections FROM v_conn_int WHERE src_int AND NOT dst_int GROUP BY 1, 2)
SELECT *, round(bytes_out / 1048576.0, 6) AS mb_out, round(least(0.55 + bytes_out / 1048576.0 / 1000 * 0.25, 0.9), 6) AS confidence
FROM a WHERE bytes_out >= 5000000""", ("v_conn_int",))
def _(spark, sf):
    return out(exfil.large_transfers(v.connections(spark, sf), EXFIL_CFG))


@R.add("exfil_asymmetric_traffic", """
WITH a AS (SELECT source_ip, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in,
             count(DISTINCT destination_ip) AS unique_destinations, count(*) AS connections
           FROM v_conn_int WHERE src_int AND NOT dst_int GROUP BY 1)
SELECT *, round(bytes_out / greatest(bytes_in, 1), 6) AS out_in_ratio,
  round(least(0.5 + bytes_out / greatest(bytes_in, 1) / 50 * 0.2 + bytes_out / 1048576.0 / 500 * 0.15, 0.85), 6) AS confidence
FROM a WHERE bytes_out >= 52428800 AND bytes_out / greatest(bytes_in, 1) >= 10""", ("v_conn_int",))
def _(spark, sf):
    return out(exfil.asymmetric_traffic(v.connections(spark, sf)))


@R.add("exfil_dns", """
WITH a AS (SELECT source_ip, parent_domain, count(DISTINCT subdomain) AS u, count(*) AS n, CAST(sum(length(subdomain)) AS BIGINT) AS ch
           FROM v_subs WHERE length(subdomain) >= 30 GROUP BY 1, 2)
SELECT source_ip, parent_domain, u AS unique_subdomains, n AS total_queries, ch AS total_chars, round(ch * 0.75, 6) AS estimated_bytes,
  round(least(0.6 + u * 0.002 + ch / 10000 * 0.1, 0.92), 6) AS confidence
FROM a WHERE u >= 20""", ("v_subs",))
def _(spark, sf):
    return out(exfil.dns_exfiltration(v.dns(spark, sf), EXFIL_CFG))


@R.add("exfil_cloud_uploads", """
WITH a AS (SELECT source_ip, CASE WHEN host || uri LIKE '%dropbox.com%' THEN 'dropbox.com'
             WHEN host || uri LIKE '%drive.google.com%' THEN 'drive.google.com' WHEN host || uri LIKE '%mega.nz%' THEN 'mega.nz' END AS service
           FROM v_http WHERE method IN ('POST', 'PUT'))
SELECT source_ip, service, count(*) AS uploads, round(least(0.6 + count(*) * 0.05, 0.88), 6) AS confidence
FROM a WHERE service IS NOT NULL GROUP BY 1, 2""", ("v_http",))
def _(spark, sf):
    return out(exfil.cloud_uploads(v.http(spark, sf)))


@R.add("impact_cryptomining", """
WITH d AS (SELECT source_ip, count(DISTINCT domain) AS pools FROM v_dns WHERE domain LIKE '%pool.example%' GROUP BY 1),
 p AS (SELECT source_ip, count(DISTINCT destination_ip || ':' || destination_port) AS eps FROM v_conn_int
       WHERE destination_port IN (3333,4444,5555,7777,8888,9999,14433,14444,45560) AND NOT dst_int GROUP BY 1)
SELECT coalesce(d.source_ip, p.source_ip) AS source_ip, coalesce(pools, 0) AS pool_domains, coalesce(eps, 0) AS stratum_endpoints,
  CASE WHEN pools > 0 AND eps > 0 THEN 0.92 WHEN pools > 0 THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence
FROM d FULL OUTER JOIN p ON d.source_ip = p.source_ip""", ("v_dns", "v_conn_int"))
def _(spark, sf):
    return out(impact.cryptomining(v.connections(spark, sf), v.dns(spark, sf), IMPACT_CFG))


@R.add("impact_ransomware_spread", """
WITH a AS (SELECT source_ip, count(DISTINCT destination_ip) AS t, count(*) AS n,
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 AS mins
           FROM v_conn_int WHERE src_int AND dst_int AND source_ip <> destination_ip AND destination_port IN (445, 139) GROUP BY 1),
 b AS (SELECT *, CASE WHEN n >= 2 AND mins > 0 THEN t / mins ELSE 0.0 END AS vel FROM a WHERE t >= 10)
SELECT source_ip, t AS targets, n AS connections, round(vel, 6) AS hosts_per_min,
  round(least(0.6 + (t - 10) * 0.03 + least(vel * 0.02, 0.15), 0.95), 6) AS confidence
FROM b""", ("v_conn_int",))
def _(spark, sf):
    return out(impact.ransomware_spread(v.connections(spark, sf)))


@R.add("impact_ddos_participation", """
WITH p AS (SELECT source_ip, destination_ip, count(*) AS n FROM v_conn_int WHERE src_int AND NOT dst_int GROUP BY 1, 2),
 a AS (SELECT source_ip, CAST(sum(n) AS BIGINT) AS total_connections, max({'n': n, 'ip': destination_ip}) AS top FROM p GROUP BY 1)
SELECT source_ip, total_connections, top.ip AS top_target, round(top.n / total_connections, 6) AS target_share,
  round(least(0.6 + top.n / total_connections * 0.15 + total_connections / 10000 * 0.1, 0.9), 6) AS confidence
FROM a WHERE total_connections >= 100 AND top.n / total_connections >= 0.05""", ("v_conn_int",))
def _(spark, sf):
    return out(impact.ddos_participation(v.connections(spark, sf), IMPACT_CFG))
