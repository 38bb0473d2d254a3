"""Device enrichment and identity over the map and the protocol logs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from netquarry.operators import devices, gateways, netmap, profiles
from netquarry.session import stage
from workload import maps
from workload import protocols as pr
from workload import views as v
from workload.views import Registry, out

R = Registry()


@R.add("host_identity_rules", """
WITH c AS (SELECT c_custkey AS k, '10.1.' || (c_custkey % 250) || '.' || (c_custkey // 250) AS ip FROM customer),
 n AS (SELECT *, CASE WHEN k % 4 <= 1 THEN 1 ELSE 0 END + CASE k % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END
   + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS s FROM c),
 b AS (SELECT *, CASE WHEN k % 6 = 0 THEN 'Windows 10 22H2' WHEN k % 4 = 0 THEN 'Windows' WHEN k % 5 = 0 THEN 'SSH server: OpenSSH Debian-2' WHEN k % 5 = 1 THEN 'Windows 10 x'
   WHEN k % 5 = 2 THEN 'SMTP: 220 Ubuntu' WHEN k % 4 = 1 THEN 'Android' WHEN k % 3 = 0 THEN 'Ubuntu Linux' WHEN k % 7 = 0 THEN 'Linux' ELSE 'Unknown' END AS os,
   CASE WHEN k % 6 = 0 THEN 'RDP Build' WHEN k % 4 = 0 THEN 'DHCP Vendor Class' WHEN k % 5 <= 2 THEN 'Software' WHEN k % 4 = 1 THEN 'DHCP Vendor Class' WHEN k % 3 = 0 THEN 'OS Detection'
    WHEN k % 7 = 0 THEN 'HTTP User-Agent' ELSE '' END AS os_source,
   CASE WHEN k % 6 = 0 THEN 92 WHEN k % 4 = 0 OR k % 5 <= 2 THEN 90 WHEN k % 4 = 1 THEN 85 WHEN k % 3 = 0 THEN 80 WHEN k % 7 = 0 THEN 60 ELSE 0 END AS oc FROM n WHERE s > 0)
SELECT ip, os, os_source, oc::BIGINT AS os_confidence, (CASE WHEN oc > 0 THEN least(oc + 3 * s, 100) ELSE least(12 * s, 60) END)::BIGINT AS confidence, s::BIGINT AS signal_count FROM b""")
def _(spark, sf):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    nodes = v.table(spark, sf, "customer").select(
        F.lit("s").alias("sensor_id"), F.lit("0").alias("vlan"), F.concat(F.lit("10.1."), k % 250, F.lit("."), F.floor(k / 250)).alias("ip"), F.lit(True).alias("is_internal"),
        F.when(k % 4 == 0, "MSFT 10.0").when(k % 4 == 1, "android-dhcp").alias("dhcp_vendor_class"), F.when(k % 3 == 0, "Ubuntu Linux").otherwise("").alias("os_info"),
        F.when(k % 5 == 0, F.array(F.lit("SSH server: OpenSSH Debian-2"))).when(k % 5 == 1, F.array(F.lit("Windows 10 x, y")))
        .when(k % 5 == 2, F.array(F.lit("SMTP: 220 Ubuntu"))).otherwise(none).alias("software"),
        F.when(k % 7 == 0, F.array(F.lit("curl linux"))).otherwise(none).alias("user_agents"), F.when(k % 6 == 0, 19045).alias("rdp_build"),
        F.when(k % 2 == 0, "Dell").otherwise("").alias("vendor"))
    return out(devices.host_identity(nodes), "ip", "os", "os_source", "os_confidence", "confidence", "signal_count")


_NODE_IPS = "SELECT DISTINCT sensor_id, vlan, unnest([source_ip, destination_ip]) AS ip FROM v_conn"


@R.add("enriched_node_facts", f"""
WITH {pr.V_LOG}, n AS ({_NODE_IPS}),
 sw AS (SELECT coalesce(host, orig_h) AS ip, bool_or(software_type LIKE '%OS%') AS has, min(name || ' ' || coalesce(version_major, '') || '.' || coalesce(version_minor, '')) AS s FROM v_log GROUP BY 1),
 sh AS (SELECT DISTINCT orig_h AS ip FROM v_log WHERE client IS NOT NULL), ua AS (SELECT orig_h AS ip FROM v_log WHERE user_agent <> '-' GROUP BY 1 HAVING count(*) >= 2),
 rd AS (SELECT orig_h AS ip, max({{'t': ts, 'v': client_build}}) FILTER (client_build IS NOT NULL).v AS b FROM v_log WHERE cookie IS NOT NULL OR client_build IS NOT NULL GROUP BY 1),
 dh AS (SELECT DISTINCT assigned_addr AS ip FROM v_log WHERE assigned_addr IS NOT NULL AND vendor_class IS NOT NULL),
 sm AS (SELECT resp_h AS ip FROM v_log GROUP BY 1 HAVING count(*) >= 2), ft AS (SELECT DISTINCT resp_h AS ip FROM v_log)
SELECT n.sensor_id, n.vlan, n.ip, coalesce(CASE WHEN sw.has THEN sw.s END, CASE WHEN sh.ip IS NOT NULL THEN 'Ubuntu Linux' END, CASE WHEN ua.ip IS NOT NULL THEN 'Windows 10/11' END,
  CASE rd.b WHEN '19041' THEN 'Windows 10 2004' WHEN '19042' THEN 'Windows 10 20H2' WHEN '19043' THEN 'Windows 10 21H1' WHEN '19044' THEN 'Windows 10 21H2' WHEN '19045' THEN 'Windows 10 22H2' END,
  CASE WHEN dh.ip IS NOT NULL THEN 'Windows 10/11' END, CASE WHEN sm.ip IS NOT NULL THEN 'Ubuntu Linux' END, CASE WHEN ft.ip IS NOT NULL THEN 'Linux' END, '') AS os_info,
  sm.ip IS NOT NULL AS serves_time
FROM n LEFT JOIN sw USING (ip) LEFT JOIN sh USING (ip) LEFT JOIN ua USING (ip) LEFT JOIN rd USING (ip) LEFT JOIN dh USING (ip) LEFT JOIN sm USING (ip) LEFT JOIN ft USING (ip)""", ("v_conn",))
def _(spark, sf):
    nodes = stage(maps._map(spark, sf)[0], "nodes")
    wanted = ("software", "ssh", "http_ua", "rdp", "dhcp", "dhcp_extended", "smtp_banner", "ftp_banner", "ntp")
    facts = stage(devices.facts(profiles.run_profiles(pr.logs(spark, sf), wanted), nodes), "facts")
    got = devices.enrich_nodes(nodes, facts)
    return out(got.select("sensor_id", "vlan", "ip", "os_info", F.array_contains("roles", "ntp_server").alias("serves_time")))


@R.add("lookup_banner_os", f"""
WITH {pr.V_LOG} SELECT client, last_reply, reply_msg, CASE WHEN client LIKE '%Ubuntu%' THEN 'Ubuntu Linux' END AS ssh_os, CASE WHEN last_reply LIKE '%Ubuntu%' THEN 'Ubuntu Linux' END AS smtp_os,
  CASE WHEN reply_msg LIKE 'vsFTPd%' THEN 'Linux' END AS ftp_os, count(*) AS n FROM v_log GROUP BY ALL""")
def _(spark, sf):
    g = pr.log(spark, sf).groupBy("client", "last_reply", "reply_msg").agg(F.count(F.lit(1)).alias("n"))
    return out(g.select("*", devices.os_from_ssh(F.col("client")).alias("ssh_os"), devices.os_from_smtp(F.col("last_reply")).alias("smtp_os"),
                        devices.os_from_ftp(F.col("reply_msg")).alias("ftp_os")))


@R.add("gateway_dhcp_option", f"""
WITH {pr.V_LOG} SELECT DISTINCT router AS ip, array_to_string(list_slice(string_split(router, '.'), 1, 3), '.') || '.0/24' AS subnet FROM v_log WHERE router IS NOT NULL AND assigned_addr IS NOT NULL""")
def _(spark, sf):
    return gateways.dhcp_gateways(profiles.run_profile(pr.log(spark, sf), "dhcp_gateway"))


def _devices(spark, sf):
    k = F.col("p_partkey")
    return v.table(spark, sf, "part").select(
        F.lit("s").alias("sensor_id"), F.lit("0").alias("vlan"), F.concat(F.lit("10.2."), k % 250, F.lit("."), F.floor(k / 250)).alias("ip"), (k % 9 != 0).alias("is_internal"),
        F.when(k % 3 == 0, "router").when(k % 3 == 1, "web_server").otherwise("").alias("device_type"),
        F.when(k % 4 == 0, "Cisco").when(k % 4 == 1, "Fortinet").when(k % 4 == 2, "Dell").otherwise("").alias("vendor"),
        F.when(k % 5 == 0, "Cisco Router/Switch").when(k % 5 == 1, "FortiSwitch").otherwise("SNMP-managed device").alias("device_model"),
        F.when(k % 2 == 0, "Linux").otherwise("").alias("os_info"), F.when(k % 6 == 0, F.array(F.lit("j"))).otherwise(F.array().cast("array<string>")).alias("ja3_fingerprints"))


_DEV = """dv AS (SELECT p_partkey AS k, '10.2.' || (p_partkey % 250) || '.' || (p_partkey // 250) AS ip, p_partkey % 9 <> 0 AS inside FROM part)"""


@R.add("gateway_vendor_hints", f"WITH {_DEV} SELECT ip, CASE k % 4 WHEN 0 THEN 'router_or_switch' ELSE 'firewall' END AS vendor_hint FROM dv WHERE inside AND k % 4 <= 1")
def _(spark, sf):
    return gateways.vendor_infrastructure(_devices(spark, sf))


@R.add("gateway_snmp_types", f"WITH {_DEV} SELECT ip, CASE k % 5 WHEN 0 THEN 'router' ELSE 'switch' END AS snmp_type FROM dv WHERE k % 5 <= 1")
def _(spark, sf):
    return gateways.snmp_infrastructure(_devices(spark, sf))


@R.add("map_coverage", f"""
WITH {_DEV} SELECT count(*) FILTER (inside AND k % 3 <= 1) AS profiled, count(*) FILTER (inside AND k % 6 = 0) AS ja3_fingerprinted, 0::BIGINT AS dns_profiled, 0::BIGINT AS rdp_fingerprinted,
  0::BIGINT AS dhcp_vendor_identified, 0::BIGINT AS cert_identified, 0::BIGINT AS file_types_tracked, count(*) FILTER (inside AND k % 2 = 0) AS os_identified, 0::BIGINT AS host_identified FROM dv""")
def _(spark, sf):
    return out(netmap.coverage(_devices(spark, sf)))


@R.add("device_unprofiled", f"WITH {_DEV} SELECT ip FROM dv WHERE inside AND k % 3 = 2")
def _(spark, sf):
    d = _devices(spark, sf)
    return devices.unprofiled(d, d.where("device_type <> ''")).select("ip")


@R.add("device_enrichment_merge", f"""
WITH {_DEV} SELECT ip, CASE WHEN k % 2 = 1 THEN CASE WHEN k % 3 = 0 THEN 'router' WHEN k % 3 = 1 THEN 'web_server' ELSE '' END ELSE CASE WHEN k % 3 = 0 THEN 'firewall' WHEN k % 3 = 1 THEN 'web_server' ELSE '' END END AS device_type,
  CASE WHEN k % 2 = 0 THEN 'Linux' ELSE '' END AS os_info FROM dv""")
def _(spark, sf):
    d = _devices(spark, sf)
    even = F.col("os_info") == "Linux"
    fresh = d.where(even).withColumn("device_type", F.when(F.col("device_type") == "router", "firewall").when(F.col("device_type") == "web_server", ""))
    return devices.merge_enrichment(d, fresh, ["device_type", "os_info"]).select("ip", "device_type", "os_info")


DEVICE = "10.0.1.2"
ENDS = {"ssh": ("client_ip", "server_ip"), "dhcp_gateway": ("gateway_ip",)}


def _names_of(profile):
    """The columns of a profile in the order of its SQL."""
    keys, picks = pr.SQL[profile][:2]
    parts = [p.split(" AS ")[-1] for p in keys.split(", ")] + re.findall(r" AS (\w+)(?=, |$)", picks)
    return [p for p in parts if re.fullmatch(r"\w+", p)]


def _device_sql(profile):
    ends = " OR ".join(f"{c} = '{DEVICE}'" for c in ENDS.get(profile, ("ip",)))
    row = ", ".join(f"coalesce({c}::VARCHAR, '~')" for c in _names_of(profile))
    return f"SELECT '{profile}' AS profile, concat_ws('|', {row}) AS row FROM ({pr.R.sql['profile_' + profile]}) WHERE {ends}"


OF_DEVICES = [p for p in profiles.PROFILES if "sensor_id" not in profiles.PROFILES[p].key or p == "dhcp_extended"]


@R.add("profile_single_device", " UNION ALL ".join(_device_sql(p) for p in OF_DEVICES))
def _(spark, sf):
    """Every profile of one address, with all its columns."""
    got = devices.single_device(profiles.run_profiles(pr.logs(spark, sf)), DEVICE)
    parts = []
    for name in OF_DEVICES:
        rows = out(got[name])
        row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in _names_of(name)])
        parts.append(rows.select(F.lit(name).alias("profile"), row.alias("row")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@R.add("kerberos_and_ntlm_servers", f"""
WITH {pr.V_LOG} SELECT 'kerberos' AS kind, resp_h AS ip FROM v_log GROUP BY 2 HAVING count(*) >= 10 AND count(DISTINCT orig_h) >= 3
UNION ALL SELECT 'ntlm', resp_h FROM v_log GROUP BY 2 HAVING count(DISTINCT orig_h) >= 5""")
def _(spark, sf):
    rows = pr.log(spark, sf)
    a = devices.kerberos_servers(profiles.run_profile(rows, "kerberos"), 10, 3).select(F.lit("kerberos").alias("kind"), "ip")
    return a.unionByName(devices.heavy_ntlm_servers(profiles.ntlm_rows(rows)).select(F.lit("ntlm").alias("kind"), "ip"))
