"""Whole hunts: findings, roll-ups, assessments, windows and near misses."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.config import HuntConfig
from netquarry.operators import correlate, findings, nearmiss, reports, rollup
from netquarry.plans import hunt
from netquarry.session import stage
from workload import detections as d
from workload import views as v
from workload.views import Registry, out

R = Registry()

CFG = HuntConfig(c2=d.C2_CFG, recon=d.RECON_CFG, exfil=d.EXFIL_CFG, impact=d.IMPACT_CFG)


def bundle(spark, sf):
    return {"connections": v.connections(spark, sf), "dns": v.dns(spark, sf), "http": v.http(spark, sf), "ntlm": v.ntlm(spark, sf)}


def _part(agent: str, activity: str, techniques: str, name: str) -> str:
    return (f"SELECT '{agent}' AS agent, {activity} AS activity_type, {techniques} AS techniques, confidence FROM ({d.R.sql[name]})")


_BEACON = d.R.sql["c2_beaconing"].replace("FROM v_beacon)", "FROM v_conn)")
_BEACON = _BEACON[: _BEACON.index("v_beacon AS (")] + v.with_views("", "v_conn")[5:].strip() + ", " + _BEACON[_BEACON.index("g AS (SELECT source_ip") :]

_FAN_TECH = """CASE protocol WHEN 'RDP' THEN 'T1021.001' WHEN 'SMB' THEN 'T1021.002' WHEN 'SSH' THEN 'T1021.004' ELSE 'T1021.003,T1021.006' END"""
_FINDINGS = " UNION ALL ".join(
    [
        f"SELECT 'c2_hunter' AS agent, 'c2_beaconing' AS activity_type, 'T1071,T1571' AS techniques, confidence FROM ({_BEACON})",
        _part("c2_hunter", "'dga_domain'", "'T1568.002'", "c2_dga_domains"),
        _part("c2_hunter", "'dns_tunneling'", "'T1071.004'", "c2_dns_tunneling"),
        _part("c2_hunter", "'persistent_c2_channel'", "'T1071,T1573'", "c2_persistent_channels"),
        _part("c2_hunter", "'suspicious_port_usage'", "'T1571'", "c2_suspicious_ports"),
        _part("reconnaissance_hunter", "'port_scanning'", "'T1046,T1595'", "recon_port_scans"),
        _part("reconnaissance_hunter", "'dns_reconnaissance'", "'T1595.002'", "recon_dns_reconnaissance"),
        _part("reconnaissance_hunter", "'service_enumeration'", "'T1046'", "recon_service_enumeration"),
        *[_part("lateral_movement_hunter", "activity_type", _FAN_TECH, f"lateral_fan_out_{p}") for p in ("rdp", "smb", "ssh", "winrm")],
        _part("lateral_movement_hunter", "'ntlm_relay'", "'T1557.001'", "lateral_ntlm_relay"),
        _part("collection_exfiltration_hunter", "'large_data_transfer'", "'T1041'", "exfil_large_transfers"),
        _part("collection_exfiltration_hunter", "'asymmetric_traffic'", "'T1048'", "exfil_asymmetric_traffic"),
        _part("collection_exfiltration_hunter", "'dns_exfiltration'", "'T1048.003'", "exfil_dns"),
        _part("collection_exfiltration_hunter", "'cloud_exfiltration'", "'T1567'", "exfil_cloud_uploads"),
        _part("impact_hunter", "'cryptomining'", "'T1496'", "impact_cryptomining"),
        _part("impact_hunter", "'ransomware_spread'", "'T1021.002,T1486'", "impact_ransomware_spread"),
        _part("impact_hunter", "'ddos_participation'", "'T1498'", "impact_ddos_participation"),
    ]
)


@R.add("hunt_findings", f"""
WITH f AS ({_FINDINGS})
SELECT agent, activity_type, techniques, count(*) AS findings, round(max(confidence), 6) AS confidence FROM f GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = findings.run_detections(bundle(spark, sf), CFG, keep=stage)
    return out(rows.groupBy("agent", "activity_type", F.array_join(F.array_sort("mitre_techniques"), ",").alias("techniques"))
               .agg(F.count(F.lit(1)).alias("findings"), F.max("confidence").alias("confidence")))


_ROLLUP = f"""
f AS ({_FINDINGS}),
roll AS (SELECT agent, round(max(confidence), 6) AS confidence, count(*) AS findings,
  list_sort(list_distinct(flatten(list(string_split(techniques, ','))))) AS techs FROM f GROUP BY 1),
sev AS (SELECT *, CASE agent WHEN 'c2_hunter' THEN CASE WHEN confidence > 0.8 THEN 'critical' WHEN confidence > 0.6 THEN 'high' ELSE 'medium' END
   WHEN 'reconnaissance_hunter' THEN CASE WHEN confidence >= 0.8 OR findings >= 3 THEN 'high' WHEN confidence >= 0.6 OR findings >= 2 THEN 'medium' ELSE 'low' END
   WHEN 'impact_hunter' THEN CASE WHEN confidence > 0.5 THEN 'critical' ELSE 'high' END
   ELSE CASE WHEN confidence > 0.6 THEN 'high' ELSE 'medium' END END AS severity FROM roll)"""


@R.add("hunt_agent_rollup", f"""
WITH {_ROLLUP.strip()} SELECT agent, confidence, findings, array_to_string(techs, ',') AS mitre_techniques, severity FROM sev""")
def _(spark, sf):
    rows = findings.run_detections(bundle(spark, sf), CFG, keep=stage)
    return out(rollup.agent_rollup(rows), "agent", "confidence", "findings", "mitre_techniques", "severity")


@R.add("hunt_recommendations", f"""
WITH {_ROLLUP.strip()}, n AS (SELECT DISTINCT agent, activity_type FROM f)
SELECT agent, count(*) AS kinds, CAST(1 + sum(CASE activity_type WHEN 'ransomware_spread' THEN 3 WHEN 'c2_beaconing' THEN 2 WHEN 'port_scanning' THEN 2
  WHEN 'dns_reconnaissance' THEN 2 WHEN 'cloud_exfiltration' THEN 2 WHEN 'cryptomining' THEN 2 WHEN 'ddos_participation' THEN 2 ELSE 1 END) AS BIGINT) AS advice
FROM n GROUP BY 1""")
def _(spark, sf):
    rows = findings.run_detections(bundle(spark, sf), CFG, keep=stage)
    r = rollup.agent_rollup(rows)
    return out(r.select("agent", F.size("activity_types").alias("kinds"), F.size("recommended_actions").alias("advice")))


@R.add("hunt_assessment", f"""
WITH {_ROLLUP.strip()},
 ex AS (SELECT agent, unnest(techs) AS t FROM sev),
 oth AS (SELECT agent, t, count(*) OVER (PARTITION BY t) - 1 AS o FROM ex),
 cor AS (SELECT agent, CAST(sum(o) AS BIGINT) AS corr FROM oth GROUP BY 1),
 keyed AS (SELECT 1 AS one, agent FROM sev), {v.chain_sql('keyed', 'one')},
 adj AS (SELECT s.*, corr, least(least(s.confidence * (1.0 + 0.2 * least(corr, 3)), 1.0) * (SELECT x FROM mult), 1.0) AS adjusted FROM sev s JOIN cor USING (agent)),
 jac AS (SELECT a.agent, len(list_intersect(a.techs, b.techs)) / len(list_distinct(list_concat(a.techs, b.techs))) AS j
         FROM sev a JOIN sev b ON a.agent < b.agent)
SELECT round(CASE WHEN count(*) FILTER (adjusted > 0.7) >= 2 THEN least(max(adjusted) * 1.1, 1.0) ELSE max(adjusted) END, 6) AS final_confidence,
  count(*) AS agent_count, count(*) FILTER (adjusted > 0.5) AS corroborating_agents, CAST(sum(findings) AS BIGINT) AS total_findings,
  CASE max(CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN final_confidence >= 0.9 THEN 'critical' WHEN final_confidence >= 0.7 THEN 'high' WHEN final_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS alert_level, (SELECT count(DISTINCT t) FROM ex) AS techniques, (SELECT round(avg(j), 6) FROM jac) AS correlation_score
FROM adj""")
def _(spark, sf):
    a = hunt.run_hunt(bundle(spark, sf), CFG, staged=True, hunt_id="hunt-1", hunted_at="2024-01-01 00:00:00").assessments
    return out(a.select("final_confidence", "agent_count", "corroborating_agents", "total_findings", "severity", "alert_level",
                        F.size("mitre_techniques").alias("techniques"), "correlation_score"))


@R.add("hunt_cases", f"""
WITH a AS ({R.sql["hunt_assessment"]})
SELECT CASE WHEN final_confidence >= 0.95 THEN 'auto_respond' WHEN final_confidence >= 0.8 THEN 'auto_investigate' ELSE 'human_review' END AS escalation_level,
  severity, total_findings AS findings FROM a WHERE final_confidence >= 0.6""")
def _(spark, sf):
    r = hunt.run_hunt(bundle(spark, sf), CFG, staged=True, hunt_id="hunt-1", hunted_at="2024-01-01 00:00:00")
    links = r.case_findings.groupBy("case_id").agg(F.count(F.lit(1)).alias("findings"))
    return out(r.cases.join(links, "case_id"), "escalation_level", "severity", "findings")


@R.add("bulk_hunt_whole_history", R.sql["hunt_assessment"])
def _(spark, sf):
    """The bulk hunt over all four logs and all detections, its one window as long as the history."""
    a = hunt.bulk_hunt(bundle(spark, sf), "36500 days", CFG, staged=True).assessments
    return out(a.select("final_confidence", "agent_count", "corroborating_agents", "total_findings", "severity", "alert_level",
                        F.size("mitre_techniques").alias("techniques"), "correlation_score"))


@R.add("focused_hunt")
def _(spark, sf):
    """A second hunt over what the first one pointed at: rows only."""
    logs = bundle(spark, sf)
    first = hunt.run_hunt(logs, CFG, staged=True, hunt_id="hunt-1", hunted_at="2024-01-01 00:00:00")
    second = hunt.focused_hunt(logs, first, CFG, staged=True, hunt_id="hunt-2", hunted_at="2024-01-01 01:00:00")
    return out(second.assessments.select("final_confidence", "agent_count", "total_findings", "severity"))


# --- windows ----------------------------------------------------------------

_DAY = "date_trunc('day', ts)"
_WINDOW_FINDINGS = f"""
 recon AS (SELECT {_DAY} AS w, source_ip, count(*) AS t, count(*) FILTER (response_code = 'NXDOMAIN') AS nx, count(DISTINCT domain) AS u FROM v_dns GROUP BY 1, 2),
 up AS (SELECT {_DAY} AS w, source_ip, host, count(*) AS n FROM v_http WHERE method IN ('POST', 'PUT') AND host <> 'intranet.local' GROUP BY 1, 2, 3),
 lab AS (SELECT {_DAY} AS w, domain, string_split(domain, '.')[-2] AS label FROM v_dns GROUP BY ALL),
 dga AS (SELECT w, list_entropy(string_split(lower(label), '')) AS h, length(label) AS len,
   length(regexp_replace(lower(label), '[^bcdfghjklmnpqrstvwxyz]', '', 'g')) / length(label) AS cr FROM lab
   WHERE length(label) >= 10 AND regexp_matches(label, '[0-9]')),
 wf AS (SELECT w, 'reconnaissance_hunter' AS agent, least(0.4 + least(t / 200, 1.0) * 0.3 + least(nx / t / 0.3, 1.0) * 0.4 + least(u / 100, 0.2), 0.93) AS confidence
     FROM recon WHERE t >= 200 OR nx / t >= 0.3
   UNION ALL SELECT w, 'collection_exfiltration_hunter', least(0.6 + n * 0.05, 0.88) FROM up
   UNION ALL SELECT w, 'c2_hunter', least(0.55 + (h - 3.5) * 0.25 + (len - 10) * 0.01, 0.92) FROM dga WHERE cr > 0.55 AND h >= 3.0)"""
_ONLY = ("dns_reconnaissance", "cloud_uploads", "dga_domains")
BULK_CFG = HuntConfig(c2=d.C2_CFG, disabled=tuple(n for n in findings.DETECTIONS if n not in _ONLY))


def _window_findings(spark, sf):
    b = hunt.windowed({"dns": v.dns(spark, sf), "http": v.http(spark, sf)}, "1 day")
    return findings.run_detections(b, BULK_CFG, ("window_start",))


@R.add("bulk_hunt_window_findings", f"""
WITH {_WINDOW_FINDINGS.strip()}
SELECT CAST(epoch(w) AS BIGINT) AS window_start, agent, count(*) AS findings, round(max(confidence), 6) AS confidence FROM wf GROUP BY 1, 2""", ("v_dns", "v_http"))
def _(spark, sf):
    rows = rollup.agent_rollup(_window_findings(spark, sf), ("window_start",))
    return out(rows.select(F.unix_seconds("window_start").alias("window_start"), "agent", "findings", "confidence"))


@R.add("bulk_hunt_window_assessments", f"""
WITH {_WINDOW_FINDINGS.strip()},
 r AS (SELECT w, agent, max(confidence) AS c, count(*) AS n FROM wf GROUP BY 1, 2), {v.chain_sql('r', 'w')},
 m AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1),
 x AS (SELECT r.w, r.agent, least(r.c * mult.x, 1.0) AS adj FROM r JOIN mult USING (w))
SELECT CAST(epoch(x.w) AS BIGINT) AS window_start, count(*) AS agent_count, (SELECT n FROM m WHERE m.w = x.w) AS total_findings,
  round(CASE WHEN count(*) FILTER (adj > 0.7) >= 2 THEN least(max(adj) * 1.1, 1.0) ELSE max(adj) END, 6) AS final_confidence
FROM x GROUP BY x.w""", ("v_dns", "v_http"))
def _(spark, sf):
    rows = _window_findings(spark, sf)
    a = correlate.assess(rollup.agent_rollup(rows, ("window_start",)), ("window_start",))
    return out(a.select(F.unix_seconds("window_start").alias("window_start"), "agent_count", "total_findings", "final_confidence"))


@R.add("bulk_hunt_high_risk_windows", f"""
WITH {_WINDOW_FINDINGS.strip()}
SELECT CAST(epoch(w) AS BIGINT) AS window_start, count(*) AS findings, round(max(confidence), 6) AS confidence FROM wf GROUP BY 1
HAVING count(*) >= 5 ORDER BY findings DESC, window_start LIMIT 10""", ("v_dns", "v_http"))
def _(spark, sf):
    rows = _window_findings(spark, sf)
    windows = v.dns(spark, sf).select(F.window("timestamp", "1 day").getField("start").alias("window_start")).distinct()
    top = reports.high_risk_windows(reports.window_statistics(rows, windows))
    return out(top.select(F.unix_seconds("window_start").alias("window_start"), "findings", "confidence"))


@R.add("bulk_hunt_window_baselines", f"""
WITH {_WINDOW_FINDINGS.strip()},
 q AS (SELECT {_DAY} AS w, count(*) AS queries, count(DISTINCT source_ip) AS sources FROM v_dns GROUP BY 1),
 n AS (SELECT w, count(*) AS f FROM wf GROUP BY 1), j AS (SELECT q.*, coalesce(f, 0) AS f FROM q LEFT JOIN n USING (w))
SELECT count(*) AS windows, CAST(sum(f) AS BIGINT) AS total_findings, round(avg(f), 6) AS avg_findings, count(*) FILTER (f >= 5) AS high_risk,
  min(queries) AS min_queries, round(avg(queries), 6) AS avg_queries, max(queries) AS max_queries,
  min(sources) AS min_sources, round(avg(sources), 6) AS avg_sources, max(sources) AS max_sources FROM j""", ("v_dns", "v_http"))
def _(spark, sf):
    rows = _window_findings(spark, sf)
    windows = v.dns(spark, sf).groupBy(F.window("timestamp", "1 day").getField("start").alias("window_start")).agg(
        F.count(F.lit(1)).alias("queries"), F.countDistinct("source_ip").alias("sources"))
    return out(reports.window_baselines(reports.window_statistics(rows, windows), ["queries", "sources"]))


@R.add("sliding_window_dns_volume", """
WITH w AS (SELECT source_ip, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE]) AS s, ts FROM v_dns)
SELECT CAST(epoch(s) AS BIGINT) AS window_start, count(*) AS queries, count(DISTINCT source_ip) AS sources FROM w
WHERE ts >= s AND ts < s + INTERVAL 20 MINUTE GROUP BY 1""", ("v_dns",))
def _(spark, sf):
    rows = hunt.windowed({"dns": v.dns(spark, sf)}, "20 minutes", "15 minutes")["dns"]
    return out(rows.groupBy(F.unix_seconds("window_start").alias("window_start")).agg(
        F.count(F.lit(1)).alias("queries"), F.countDistinct("source_ip").alias("sources")))


@R.add("session_windows_per_host", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events),
 s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, count(*) AS events, min(epoch_us(ts)) AS started FROM s GROUP BY user_id, sid""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    rows = e.groupBy("user_id", F.session_window("timestamp", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return out(rows.select("user_id", "events", F.unix_micros("s.start").alias("started")))


@R.add("window_bounds_clipped", """
WITH r AS (SELECT min(ts) AS a, max(ts) AS b FROM events), w AS (SELECT unnest(generate_series(a, b, INTERVAL 24 HOUR)) AS s, b FROM r)
SELECT epoch_us(s) AS window_start, epoch_us(least(s + INTERVAL 24 HOUR, b)) AS window_end FROM w WHERE s < b""")
def _(spark, sf):
    r = v.table(spark, sf, "events").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return out(hunt.window_bounds_of(r, "a", "b", 24))


# --- near misses -------------------------------------------------------------

@R.add("near_misses_c2", """
WITH p AS (SELECT source_ip || '->' || destination_ip || ':' || destination_port AS s, count(*) AS n FROM v_conn GROUP BY 1),
 q AS (SELECT string_split(lower(domain), '.')[-2] || '.' || string_split(lower(domain), '.')[-1] AS s, count(*) AS n FROM v_dns GROUP BY 1)
SELECT 'c2_hunter' AS agent, 'beacon' AS "check", s AS subject, n AS value, 10::BIGINT AS threshold FROM (SELECT * FROM p ORDER BY n DESC, s LIMIT 1)
UNION ALL SELECT 'c2_hunter', 'dns_tunnel', s, n, 50 FROM (SELECT * FROM q ORDER BY n DESC, s LIMIT 1)""", ("v_conn", "v_dns"))
def _(spark, sf):
    return nearmiss.c2_near_misses(v.connections(spark, sf), v.dns(spark, sf))


@R.add("near_misses_recon", """
WITH a AS (SELECT source_ip AS s, count(DISTINCT destination_port) AS p, count(DISTINCT destination_ip) AS h FROM v_conn GROUP BY 1),
 q AS (SELECT source_ip AS s, count(*) AS n FROM v_dns GROUP BY 1)
SELECT 'reconnaissance_hunter' AS agent, 'port_scan' AS "check", s AS subject, p AS value, 25::BIGINT AS threshold FROM (SELECT * FROM a ORDER BY p DESC, s LIMIT 1)
UNION ALL SELECT 'reconnaissance_hunter', 'host_sweep', s, h, 15 FROM (SELECT * FROM a ORDER BY h DESC, s LIMIT 1)
UNION ALL SELECT 'reconnaissance_hunter', 'dns_recon', s, n, 200 FROM (SELECT * FROM q ORDER BY n DESC, s LIMIT 1)""", ("v_conn", "v_dns"))
def _(spark, sf):
    return nearmiss.recon_near_misses(v.connections(spark, sf), v.dns(spark, sf))


@R.add("near_misses_lateral", """
WITH i AS (SELECT * FROM v_conn_int WHERE src_int AND dst_int),
 t AS (SELECT CASE WHEN destination_port = 3389 THEN 'RDP' WHEN destination_port IN (445, 139) THEN 'SMB' WHEN destination_port = 22 THEN 'SSH' END AS pr,
   source_ip AS s, count(DISTINCT destination_ip) AS n FROM i WHERE source_ip <> destination_ip GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY n DESC, s) AS r FROM t WHERE pr IS NOT NULL)
SELECT 'lateral_movement_hunter' AS agent, 'internal_connections' AS "check", 'internal/all' AS subject, (SELECT count(*) FROM i) AS value, (SELECT count(*) FROM v_conn) AS threshold
UNION ALL SELECT 'lateral_movement_hunter', pr, s, n, CASE pr WHEN 'SSH' THEN 4 ELSE 5 END FROM k WHERE r = 1""", ("v_conn_int",))
def _(spark, sf):
    return nearmiss.lateral_near_misses(v.connections(spark, sf))
