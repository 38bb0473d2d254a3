"""Network map, MAC history, gateways and graph over the telemetry views."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.operators import devices, gateways, graph, netmap
from netquarry.plans import profiling
from netquarry.session import stage
from workload import protocols
from workload import views as v
from workload.views import Registry, out

R = Registry()

_INT = "regexp_matches({0}, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')"
_NET24 = "array_to_string(list_slice(string_split({0}, '.'), 1, 3), '.') || '.0/24'"

_EDGES = """
 e AS (SELECT sensor_id, vlan, source_ip AS src, destination_ip AS dst, count(*) AS n, CAST(sum(bytes_out) AS BIGINT) AS bo,
   CAST(sum(bytes_in) AS BIGINT) AS bi, min(ts) AS f, max(ts) AS l FROM v_conn GROUP BY 1, 2, 3, 4)"""
_NODES = _EDGES + """,
 ends AS (SELECT sensor_id, vlan, src AS ip, n, bo AS sent, bi AS rcv, 1 AS o, 0 AS i, f, l FROM e
   UNION ALL SELECT sensor_id, vlan, dst, n, bi, bo, 0, 1, f, l FROM e),
 nd AS (SELECT sensor_id, vlan, ip, CAST(sum(n) AS BIGINT) AS total_connections, CAST(sum(sent) AS BIGINT) AS bytes_sent,
   CAST(sum(rcv) AS BIGINT) AS bytes_received, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree,
   epoch_us(min(f)) AS first_seen, epoch_us(max(l)) AS last_seen, {inside} AS is_internal FROM ends GROUP BY 1, 2, 3),
 sv AS (SELECT sensor_id, vlan, destination_ip AS ip, destination_port AS port, protocol, count(*) AS n FROM v_conn GROUP BY ALL),
 sc AS (SELECT sensor_id, vlan, ip, count(*) AS service_count, bool_or(port = 53) AS dns, bool_or(port IN (80, 443) AND protocol = 'tcp') AS web FROM sv GROUP BY 1, 2, 3),
 nodes AS (SELECT nd.*, sensor_id || ':' || vlan || ':' || ip AS node_id, coalesce(service_count, 0) AS service_count,
   list_filter([CASE WHEN out_degree > in_degree * 2 THEN 'client' END, CASE WHEN dns THEN 'dns_server' END,
    CASE WHEN in_degree > 50 THEN 'popular' END, CASE WHEN out_degree > 50 THEN 'scanner' END,
    CASE WHEN in_degree > 10 THEN 'server' END, CASE WHEN web THEN 'web_server' END], lambda x: x IS NOT NULL) AS roles
   FROM nd LEFT JOIN sc USING (sensor_id, vlan, ip))""".replace("{inside}", _INT.format("ip"))


def _map(spark, sf):
    c = v.connections(spark, sf)
    e, s = netmap.edges(c), netmap.services(c)
    return netmap.nodes(e, s), e, s


@R.add("map_edges", f"""
WITH {_EDGES.strip()} SELECT sensor_id, vlan, src, dst, n, bo AS bytes_out, bi AS bytes_in, epoch_us(f) AS first_seen, epoch_us(l) AS last_seen FROM e""", ("v_conn",))
def _(spark, sf):
    return out(netmap.edges(v.connections(spark, sf)))


@R.add("map_services", """
SELECT sensor_id, vlan, destination_ip AS ip, CAST(destination_port AS BIGINT) AS port, protocol, count(*) AS n FROM v_conn GROUP BY ALL""", ("v_conn",))
def _(spark, sf):
    return out(netmap.services(v.connections(spark, sf)))


@R.add("map_nodes", f"""
WITH {_NODES.strip()} SELECT sensor_id, vlan, ip, node_id, total_connections, bytes_sent, bytes_received, out_degree, in_degree,
  first_seen, last_seen, is_internal, service_count FROM nodes""", ("v_conn",))
def _(spark, sf):
    n, _, _ = _map(spark, sf)
    return out(n.withColumn("service_count", F.size("services")), "sensor_id", "vlan", "ip", "node_id", "total_connections",
               "bytes_sent", "bytes_received", "out_degree", "in_degree", "first_seen", "last_seen", "is_internal", "service_count")


@R.add("map_node_roles", f"""
WITH {_NODES.strip()} SELECT node_id, array_to_string(roles, ',') AS roles FROM nodes""", ("v_conn",))
def _(spark, sf):
    return out(_map(spark, sf)[0], "node_id", "roles")


@R.add("map_incremental_merge", f"""
WITH {_EDGES.strip()} SELECT sensor_id, vlan, src, dst, n, bo AS bytes_out, bi AS bytes_in, epoch_us(f) AS first_seen, epoch_us(l) AS last_seen FROM e""", ("v_conn",))
def _(spark, sf):
    c = v.connections(spark, sf)
    early, late = F.col("timestamp") < "1998-01-01", F.col("timestamp") >= "1998-01-01"
    return out(netmap.merge_edges(netmap.edges(c.where(early)), netmap.edges(c.where(late))))


@R.add("map_capped_peers", f"""
WITH {_EDGES.strip()}, r AS (SELECT sensor_id, vlan, src, dst, n, row_number() OVER (PARTITION BY sensor_id, vlan, src ORDER BY n DESC, dst) AS k FROM e)
SELECT sensor_id, vlan, src, dst, n, k AS peer_rank FROM r WHERE k <= 50""", ("v_conn",))
def _(spark, sf):
    return out(netmap.capped_peers(netmap.edges(v.connections(spark, sf)), 50), "sensor_id", "vlan", "src", "dst", "n", "peer_rank")


@R.add("map_external_peers", """
WITH x AS (SELECT sensor_id, vlan, CASE WHEN src_int THEN source_ip ELSE destination_ip END AS ip, CASE WHEN src_int THEN destination_ip ELSE source_ip END AS peer,
   CASE WHEN src_int THEN source_port ELSE destination_port END AS lp, CASE WHEN src_int THEN destination_port ELSE source_port END AS ep, ts
  FROM v_conn_int WHERE src_int <> dst_int)
SELECT sensor_id, vlan, ip, peer, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT lp)), 1, 20), ',') AS local_ports,
  array_to_string(list_slice(list_sort(list(DISTINCT ep)), 1, 20), ',') AS remote_ports, epoch_us(max(ts)) AS last_seen FROM x GROUP BY 1, 2, 3, 4""", ("v_conn_int",))
def _(spark, sf):
    return out(netmap.external_peers(v.connections(spark, sf)))


@R.add("map_answer_names", "SELECT DISTINCT answer AS ip, domain AS name FROM v_dns", ("v_dns",))
def _(spark, sf):
    return netmap.answer_names(v.dns(spark, sf)).select("ip", "name")


@R.add("map_ntlm_names", """
SELECT DISTINCT sensor_id, source_ip AS ip, 'netbios' AS kind, upper(hostname) AS name FROM v_ntlm
UNION SELECT DISTINCT sensor_id, dest_ip, 'netbios', upper(server_nb_computer_name) FROM v_ntlm
UNION SELECT DISTINCT sensor_id, dest_ip, 'hostname', lower(server_dns_computer_name) FROM v_ntlm""", ("v_ntlm",))
def _(spark, sf):
    return netmap.ntlm_names(v.ntlm(spark, sf)).select("sensor_id", "ip", "kind", "name")


@R.add("map_ntlm_domains", """
WITH x AS (SELECT sensor_id, source_ip AS ip, upper(domainname) AS d, ts FROM v_ntlm UNION ALL SELECT sensor_id, dest_ip, upper(domainname), ts FROM v_ntlm)
SELECT sensor_id, ip, max({'t': ts, 'd': d}).d AS domain FROM x GROUP BY 1, 2""", ("v_ntlm",))
def _(spark, sf):
    return netmap.ntlm_domains(v.ntlm(spark, sf)).select("sensor_id", "ip", "domain")


@R.add("map_evict_stale", f"""
WITH {_NODES.strip()} SELECT node_id, last_seen FROM nodes ORDER BY last_seen DESC, node_id LIMIT 200""", ("v_conn",))
def _(spark, sf):
    return out(netmap.evict_stale(_map(spark, sf)[0], 200), "node_id", "last_seen")


# --- MAC history: leases derived from orders ---------------------------------

_LEASES = """
 ls AS (SELECT upper(replace('02-42-' || substr(md5(CAST(o_custkey % 300 AS VARCHAR)), 1, 2), '-', ':') || ':00:00:01') AS mac,
   '10.0.' || (o_custkey % 4) || '.' || (o_orderkey % 9 + 1) AS ip, '0' AS vlan, 'sensor' || (o_orderkey % 3) AS sensor_id,
   CASE o_orderkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '' ELSE 'pc' || (o_custkey % 300) || '-' || (o_orderkey % 2) END AS host_name, o_orderdate AS ts FROM orders),
 b AS (SELECT mac, ip, vlan, sensor_id, min(ts) AS f, max(ts) AS l,
   coalesce(min({'t': ts, 'h': host_name}) FILTER (host_name NOT IN ('', '-')).h, '') AS hostname FROM ls GROUP BY 1, 2, 3, 4)"""


def leases(spark, sf):
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    s = lambda c: c.cast("string")
    return v.table(spark, sf, "orders").select(
        F.concat(F.lit(" 02-42-"), F.substring(F.md5(s(cust % 300)), 1, 2), F.lit("-00-00-01")).alias("mac"),
        F.concat(F.lit("10.0."), s(cust % 4), F.lit("."), s(key % 9 + 1)).alias("ip"), F.lit("0").alias("vlan"),
        F.concat(F.lit("sensor"), s(key % 3)).alias("sensor_id"),
        F.when(key % 5 == 0, "-").when(key % 5 == 1, "").otherwise(F.concat(F.lit("PC"), s(cust % 300), F.lit("-"), s(key % 2))).alias("host_name"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


@R.add("mac_bindings", f"""
WITH {_LEASES.strip()} SELECT mac, ip, vlan, sensor_id, epoch_us(f) AS first_seen, epoch_us(l) AS last_seen, hostname FROM b""")
def _(spark, sf):
    return out(netmap.mac_bindings(leases(spark, sf)).drop("named_at"))


@R.add("mac_bindings_merged", f"""
WITH {_LEASES.strip()} SELECT mac, ip, sensor_id, epoch_us(f) AS first_seen, epoch_us(l) AS last_seen, hostname FROM b""")
def _(spark, sf):
    rows = leases(spark, sf)
    day = F.col("timestamp") < "1998-01-01"
    return out(netmap.merge_bindings(netmap.mac_bindings(rows.where(day)), netmap.mac_bindings(rows.where(~day))),
               "mac", "ip", "sensor_id", "first_seen", "last_seen", "hostname")


@R.add("mac_multi_ip", f"""
WITH {_LEASES.strip()} SELECT mac, count(DISTINCT ip) AS ip_count, epoch_us(min(f)) AS first_seen, epoch_us(max(l)) AS last_seen
FROM b GROUP BY 1 HAVING count(DISTINCT ip) > 1 ORDER BY ip_count DESC, mac LIMIT 100""")
def _(spark, sf):
    return out(netmap.multi_ip_macs(netmap.mac_bindings(leases(spark, sf))))


@R.add("mac_all_devices", f"""
WITH {_LEASES.strip()} SELECT mac, count(DISTINCT ip) AS ip_count FROM b GROUP BY 1 ORDER BY ip_count DESC, mac LIMIT 500""")
def _(spark, sf):
    return out(netmap.all_macs(netmap.mac_bindings(leases(spark, sf))), "mac", "ip_count")


@R.add("mac_associated_nodes", f"""
WITH {_LEASES.strip()}, {_NODES.strip()} SELECT DISTINCT mac, nodes.sensor_id, nodes.vlan, nodes.ip FROM b JOIN nodes ON nodes.ip = b.ip""", ("v_conn",))
def _(spark, sf):
    return netmap.mac_nodes(netmap.mac_bindings(leases(spark, sf)), _map(spark, sf)[0])


@R.add("mac_device_identity", f"""
WITH {_LEASES.strip()} SELECT mac, ip, sensor_id, epoch_us(l) AS last_seen FROM b WHERE mac IN (SELECT mac FROM b WHERE ip = '10.0.1.3')""")
def _(spark, sf):
    return out(netmap.device_identity(netmap.mac_bindings(leases(spark, sf)), "10.0.1.3"), "mac", "ip", "sensor_id", "last_seen")


@R.add("mac_vendor_lookup", """
WITH d AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '00:50:56' WHEN 1 THEN '52:54:00' WHEN 2 THEN '02:42:1A' WHEN 3 THEN 'AA:BB:0' || (c_custkey % 9)
   WHEN 4 THEN '08:00:27' ELSE 'CC:DD:EE' END || ':00:00:01' AS mac FROM customer),
 o AS (SELECT DISTINCT 'AA:BB:0' || (s_suppkey % 6) AS prefix, CASE s_suppkey % 6 WHEN 0 THEN 'Cisco' WHEN 1 THEN 'Fortinet' WHEN 2 THEN 'Dell' ELSE 'Vendor' || (s_suppkey % 6) END AS vendor FROM supplier)
SELECT c_custkey, coalesce(vendor, '') AS vendor, CASE substr(mac, 1, 8) WHEN '00:50:56' THEN 'VMware' WHEN '52:54:00' THEN 'QEMU/KVM' WHEN '02:42:1A' THEN 'Docker'
  WHEN '08:00:27' THEN 'VirtualBox' ELSE '' END AS platform, CASE vendor WHEN 'Cisco' THEN 'router_or_switch' WHEN 'Fortinet' THEN 'firewall' ELSE '' END AS hint
FROM d LEFT JOIN o ON o.prefix = substr(mac, 1, 8)""")
def _(spark, sf):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    mac = F.concat(
        F.when(c % 6 == 0, "00:50:56").when(c % 6 == 1, "52:54:00").when(c % 6 == 2, "02:42:1A").when(c % 6 == 3, F.concat(F.lit("AA:BB:0"), c % 9))
        .when(c % 6 == 4, "08:00:27").otherwise("CC:DD:EE"), F.lit(":00:00:01"))
    rows = v.table(spark, sf, "customer").select("c_custkey", mac.alias("mac_address"))
    oui = v.table(spark, sf, "supplier").select(
        F.concat(F.lit("AA:BB:0"), s % 6).alias("prefix"),
        F.when(s % 6 == 0, "Cisco").when(s % 6 == 1, "Fortinet").when(s % 6 == 2, "Dell").otherwise(F.concat(F.lit("Vendor"), s % 6)).alias("vendor")).distinct()
    got = netmap.vendor_of(rows, oui)
    return got.select("c_custkey", "vendor", netmap.virtual_platform().alias("platform"), netmap.infrastructure_hint().alias("hint"))


# --- summaries ----------------------------------------------------------------

@R.add("map_totals", f"""
WITH {_NODES.strip()} SELECT count(*) AS total_nodes, count(*) FILTER (is_internal) AS internal_nodes, count(*) FILTER (NOT is_internal) AS external_nodes,
  CAST(sum(service_count) FILTER (is_internal) AS BIGINT) AS total_services, count(*) FILTER (list_contains(roles, 'server')) AS servers,
  count(DISTINCT vlan) FILTER (vlan <> '0') AS vlans, count(DISTINCT sensor_id) AS sensors FROM nodes""", ("v_conn",))
def _(spark, sf):
    return out(netmap.map_totals(_map(spark, sf)[0]))


@R.add("map_top_talkers", f"""
WITH {_NODES.strip()} SELECT ip, sensor_id, vlan, total_connections FROM nodes WHERE is_internal
ORDER BY total_connections DESC, ip, sensor_id, vlan LIMIT 10""", ("v_conn",))
def _(spark, sf):
    return out(netmap.top_talkers(_map(spark, sf)[0]))


_TYPED = _NODES + """,
 sp AS (SELECT ip, list(DISTINCT port) AS ports, count(DISTINCT port) AS pc FROM sv GROUP BY 1),
 pe AS (SELECT src, dst, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY 1, 2),
 srv AS (SELECT dst AS ip, count(*) AS clients FROM pe GROUP BY 1), cli AS (SELECT src AS ip, count(*) AS dests, CAST(sum(n) AS BIGINT) AS outc FROM pe GROUP BY 1),
 fx AS (SELECT nodes.*, coalesce(ports, []) AS ports, coalesce(pc, 0) AS pc, coalesce(clients, 0) AS clients, coalesce(dests, 0) AS dests, coalesce(outc, 0) AS outc
   FROM nodes LEFT JOIN sp USING (ip) LEFT JOIN srv USING (ip) LEFT JOIN cli USING (ip) WHERE is_internal),
 typed AS (SELECT *, CASE WHEN len(list_intersect(ports, [88, 389])) >= 2 THEN 'domain_controller'
   WHEN list_contains(ports, 53) AND clients >= 5 THEN 'dns_server' WHEN len(list_intersect(ports, [80, 443, 8080, 8443])) >= 1 AND clients >= 3 THEN 'web_server'
   WHEN len(list_intersect(ports, [3306, 5432, 1433, 27017, 6379, 9200, 5984, 9042])) >= 1 THEN 'database_server'
   WHEN len(list_intersect(ports, [25, 587, 993, 143, 110, 465])) >= 1 THEN 'mail_server'
   WHEN len(list_intersect(ports, [445, 139, 2049, 21])) >= 1 AND clients >= 3 THEN 'file_server'
   WHEN list_contains(ports, 22) AND clients >= 2 THEN 'ssh_server' WHEN dests > 20 AND outc > clients * 3 THEN 'workstation'
   WHEN clients > 20 AND pc = 0 THEN 'gateway' WHEN pc <= 2 AND clients <= 3 AND dests <= 5 THEN 'iot_device' ELSE '' END AS device_type FROM fx)"""


def _typed(spark, sf):
    n, e, s = _map(spark, sf)
    pe = e.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    server = pe.groupBy(F.col("dst").alias("ip")).agg(F.count(F.lit(1)).alias("unique_clients"))
    client = pe.groupBy(F.col("src").alias("ip")).agg(F.count(F.lit(1)).alias("unique_destinations"), F.sum("n").alias("outgoing_count"))
    return devices.device_types(n, s, server, client), e


@R.add("device_classification", f"""
WITH {_TYPED.strip()} SELECT node_id, device_type, pc AS port_count, clients AS unique_clients, dests AS unique_destinations, outc AS outgoing_count FROM typed""", ("v_conn",))
def _(spark, sf):
    return out(_typed(spark, sf)[0], "node_id", "device_type", "port_count", "unique_clients", "unique_destinations", "outgoing_count")


@R.add("device_classification_rules", """
WITH p AS (SELECT p_partkey, p_size AS clients, p_partkey % 45 AS dests, p_partkey % 200 AS outc,
  CASE p_partkey % 12 WHEN 0 THEN [88, 389] WHEN 1 THEN [3306] WHEN 2 THEN [25] WHEN 3 THEN [67] WHEN 4 THEN [500] WHEN 5 THEN [179] WHEN 6 THEN [4443, 981]
   WHEN 7 THEN [9100] WHEN 8 THEN [514] WHEN 9 THEN [123] WHEN 10 THEN [161] ELSE CAST([] AS INTEGER[]) END AS ports FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 12 = 0 THEN 'domain_controller' WHEN p_partkey % 12 = 1 THEN 'database_server' WHEN p_partkey % 12 = 2 THEN 'mail_server'
  WHEN p_partkey % 12 = 3 THEN 'dhcp_server' WHEN p_partkey % 12 = 4 THEN 'vpn_gateway' WHEN p_partkey % 12 = 5 THEN 'router'
  WHEN p_partkey % 12 = 6 AND clients >= 3 THEN 'firewall' WHEN p_partkey % 12 = 7 THEN 'print_server' WHEN p_partkey % 12 = 8 AND clients >= 3 THEN 'syslog_server'
  WHEN p_partkey % 12 = 9 THEN 'ntp_server' WHEN p_partkey % 12 = 10 THEN 'monitoring' WHEN dests > 20 AND outc > clients * 3 THEN 'workstation'
  WHEN clients > 20 AND len(ports) = 0 THEN 'gateway' WHEN len(ports) <= 2 AND clients <= 3 AND dests <= 5 THEN 'iot_device' ELSE '' END AS device_type FROM p""")
def _(spark, sf):
    k = F.col("p_partkey")
    groups = ((88, 389), (3306,), (25,), (67,), (500,), (179,), (4443, 981), (9100,), (514,), (123,), (161,))
    ports = F.lit(None).cast("array<int>")
    for i, g in reversed(list(enumerate(groups))):
        ports = F.when(k % 12 == i, F.array(*[F.lit(p) for p in g])).otherwise(ports)
    ports = F.coalesce(ports, F.array().cast("array<int>"))
    kind = devices.classify(ports, F.size(ports), F.col("p_size"), k % 45, k % 200)
    return v.table(spark, sf, "part").select("p_partkey", kind.alias("device_type"))


@R.add("device_inventory", f"""
WITH {_TYPED.strip()}, r AS (SELECT device_type, node_id, total_connections, row_number() OVER (PARTITION BY device_type ORDER BY total_connections DESC, node_id) AS k
  FROM typed WHERE device_type <> '')
SELECT device_type, node_id, total_connections, k AS rank FROM r WHERE k <= 25""", ("v_conn",))
def _(spark, sf):
    return out(netmap.device_inventory(_typed(spark, sf)[0]), "device_type", "node_id", "total_connections", "rank")


@R.add("device_type_counts", f"""
WITH {_TYPED.strip()} SELECT sensor_id, device_type, count(*) AS devices FROM typed WHERE device_type <> '' GROUP BY ROLLUP (sensor_id, device_type)""", ("v_conn",))
def _(spark, sf):
    return out(netmap.type_counts(_typed(spark, sf)[0]))


@R.add("device_profiling_stats", f"""
WITH {_TYPED.strip()} SELECT count(*) AS total, count(*) FILTER (device_type <> '') AS profiled, count(*) FILTER (device_type = '') AS unprofiled,
  0::BIGINT AS host_identified FROM typed""", ("v_conn",))
def _(spark, sf):
    return out(netmap.profiling_stats(_typed(spark, sf)[0]))


@R.add("device_downgrade_protection", f"""
WITH {_TYPED.strip()}, old AS (SELECT node_id, CASE WHEN total_connections % 2 = 0 THEN 'mail_server' ELSE 'workstation' END AS o FROM typed)
SELECT node_id, CASE WHEN device_type = '' THEN o WHEN o = 'mail_server' AND device_type IN ('gateway', 'workstation', 'iot_device') THEN o ELSE device_type END AS device_type
FROM typed JOIN old USING (node_id)""", ("v_conn",))
def _(spark, sf):
    n, e, s = _map(spark, sf)
    pe = e.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    server = pe.groupBy(F.col("dst").alias("ip")).agg(F.count(F.lit(1)).alias("unique_clients"))
    client = pe.groupBy(F.col("src").alias("ip")).agg(F.count(F.lit(1)).alias("unique_destinations"), F.sum("n").alias("outgoing_count"))
    old = n.withColumn("device_type", F.when(F.col("total_connections") % 2 == 0, "mail_server").otherwise("workstation"))
    return out(devices.device_types(n, s, server, client, previous=old), "node_id", "device_type")


@R.add("map_sensor_tables", f"""
WITH {_NODES.strip()}, k AS (SELECT sensor_id, vlan, ip, 'internal' AS kind, total_connections AS weight FROM nodes WHERE is_internal
  UNION ALL SELECT sensor_id, vlan, ip, 'external', total_connections FROM nodes WHERE NOT is_internal
  UNION ALL SELECT sensor_id, vlan, ip, 'server', service_count FROM nodes WHERE is_internal AND (list_contains(roles, 'server') OR service_count > 0)),
 r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, kind ORDER BY weight DESC, ip, vlan) AS rank FROM k)
SELECT * FROM r WHERE rank <= CASE kind WHEN 'server' THEN 20 ELSE 10 END""", ("v_conn",))
def _(spark, sf):
    return out(netmap.sensor_tables(_map(spark, sf)[0]))


@R.add("map_context_members", f"""
WITH {_NODES.strip()} SELECT DISTINCT 'dns_server' AS kind, ip FROM nodes WHERE list_contains(roles, 'dns_server')""", ("v_conn",))
def _(spark, sf):
    return netmap.map_context(_map(spark, sf)[0])


_LAST = "CAST(string_split(ip, '.')[4] AS INT)"


@R.add("map_asset_context", f"""
WITH {_NODES.strip()}, t AS (SELECT *, CASE {_LAST} % 5 WHEN 0 THEN 'server' WHEN 1 THEN 'domain_controller' WHEN 2 THEN 'workstation' ELSE '' END AS ty, {_LAST} % 7 = 3 AS gw FROM nodes),
 m AS (SELECT 'high_value' AS weight, ip, ty AS why FROM t WHERE ty IN ('server', 'domain_controller')
  UNION SELECT 'critical', ip, '' FROM t WHERE gw OR list_contains(roles, 'dns_server') OR ty = 'domain_controller')
SELECT DISTINCT weight, ip, (SELECT count(DISTINCT ip) FROM m WHERE weight = 'critical') AS critical_assets, (SELECT count(DISTINCT ip) FROM m WHERE weight = 'high_value') AS high_value_assets FROM m""", ("v_conn",))
def _(spark, sf):
    """High-value and critical assets of a map with device types, gateways and roles, and their numbers."""
    last = F.element_at(F.split("ip", "\\."), 4).cast("int")
    nodes = _map(spark, sf)[0].withColumns({
        "device_type": F.when(last % 5 == 0, "server").when(last % 5 == 1, "domain_controller").when(last % 5 == 2, "workstation").otherwise(""),
        "is_gateway_for": F.when(last % 7 == 3, F.array(F.lit("10.0.0.0/24"))).otherwise(F.array().cast("array<string>"))})
    assets = netmap.asset_context(nodes)
    counts = netmap.asset_counts(assets)
    return out(assets.withColumns({c: counts.select(c).scalar() for c in counts.columns}), "weight", "ip", "critical_assets", "high_value_assets")


@R.add("map_node_baselines", f"""
WITH {_NODES.strip()} SELECT ip, CAST(sum(total_connections) AS BIGINT) AS total_connections, CAST(sum(bytes_received) AS BIGINT) AS bytes_in,
  CAST(sum(bytes_sent) AS BIGINT) AS bytes_out FROM nodes GROUP BY 1""", ("v_conn",))
def _(spark, sf):
    return out(netmap.node_baselines(_map(spark, sf)[0]))


@R.add("map_filter_nodes", f"""
WITH {_NODES.strip()} SELECT node_id, total_connections FROM nodes WHERE list_contains(roles, 'server') AND starts_with(ip, '10.0.1.')
  AND EXISTS (SELECT 1 FROM sv WHERE sv.ip = nodes.ip AND sv.sensor_id = nodes.sensor_id AND sv.vlan = nodes.vlan AND port = 445)
  AND EXISTS (SELECT 1 FROM e WHERE e.sensor_id = nodes.sensor_id AND e.vlan = nodes.vlan AND ((e.src = ip AND NOT {_INT.format('e.dst')}) OR (e.dst = ip AND NOT {_INT.format('e.src')})))
ORDER BY total_connections DESC, node_id LIMIT 50""", ("v_conn",))
def _(spark, sf):
    n, e, _ = _map(spark, sf)
    return out(netmap.filter_nodes(n, e, role="server", ip_prefix="10.0.1.", port=445, has_external=True), "node_id", "total_connections")


@R.add("map_annotations", f"""
WITH {_NODES.strip()}, a AS (SELECT '10.0.' || (s_suppkey % 4) || '.' || (s_suppkey % 30) AS ip, s_name AS note, s_suppkey AS made FROM supplier),
 r AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY made DESC, note) AS k FROM a),
 g AS (SELECT ip, count(*) AS note_count, array_to_string(list(note ORDER BY k) FILTER (k <= 2), ',') AS notes FROM r GROUP BY 1)
SELECT node_id, notes, coalesce(note_count, 0) AS note_count FROM nodes LEFT JOIN g USING (ip)""", ("v_conn",))
def _(spark, sf):
    s = F.col("s_suppkey")
    notes = v.table(spark, sf, "supplier").select(
        F.concat(F.lit("sensor0:0:10.0."), s % 4, F.lit("."), s % 30).alias("node_id"), F.col("s_name").alias("note"), s.alias("created_at"))
    return out(netmap.with_annotations(_map(spark, sf)[0], notes, 2), "node_id", "notes", "note_count")


@R.add("map_groups_and_flags", f"""
WITH {_NODES.strip()}, m AS (SELECT DISTINCT node_id, 'group' || (total_connections % 3) AS g FROM nodes WHERE total_connections % 2 = 0),
 fl AS (SELECT node_id, 'watch' AS f FROM nodes WHERE total_connections % 5 = 0)
SELECT nodes.node_id, m.g AS lan_groups, fl.f AS flag FROM nodes LEFT JOIN m USING (node_id) LEFT JOIN fl USING (node_id)""", ("v_conn",))
def _(spark, sf):
    n = _map(spark, sf)[0]
    t = F.col("total_connections")
    members = n.where(t % 2 == 0).select("node_id", F.concat(F.lit("group"), t % 3).alias("group_name"))
    flags = n.where(t % 5 == 0).select("node_id", F.lit("watch").alias("flag"), F.lit("seen").alias("reason"))
    got = netmap.with_groups(n, members, flags)
    return out(got.select("node_id", "lan_groups", F.get(F.col("flags"), F.lit(0)).getField("flag").alias("flag")))


@R.add("map_group_members", f"""
WITH {_NODES.strip()}, m AS (SELECT DISTINCT node_id, 'group' || (total_connections % 3) AS group_name FROM nodes)
SELECT group_name, count(*) AS members, array_to_string(list_slice(list_sort(list(node_id)), 1, 5), ',') AS node_ids FROM m GROUP BY 1""", ("v_conn",))
def _(spark, sf):
    n = _map(spark, sf)[0]
    return out(netmap.group_members(n.select("node_id", F.concat(F.lit("group"), F.col("total_connections") % 3).alias("group_name")), 5))


# --- gateway evidence -----------------------------------------------------------

@R.add("gateway_subnet_addresses", f"""
SELECT DISTINCT answer AS ip, {_NET24.format('answer')} AS subnet FROM (SELECT answer, count(DISTINCT source_ip) AS k
  FROM v_dns WHERE regexp_matches(answer, '\\.(1|254)$') AND {_NET24.format('source_ip')} = {_NET24.format('answer')} GROUP BY 1) WHERE k >= 3""", ("v_dns",))
def _(spark, sf):
    d = v.dns(spark, sf).select("source_ip", F.col("answer").alias("destination_ip"), F.lit(0).alias("bytes_in"), F.lit(0).alias("bytes_out"), "timestamp")
    return gateways.subnet_gateways(netmap.edges(d))


@R.add("gateway_cross_subnet", f"""
WITH s AS (SELECT DISTINCT sensor_id, vlan, destination_ip AS ip, {_NET24.format('source_ip')} AS sub FROM v_conn_int WHERE src_int AND dst_int
   AND {_NET24.format('source_ip')} <> {_NET24.format('destination_ip')}), k AS (SELECT sensor_id, vlan, ip, count(*) AS n FROM s GROUP BY 1, 2, 3)
SELECT ip, max(n) AS subnets_in FROM k WHERE n >= 3 GROUP BY 1""", ("v_conn_int",))
def _(spark, sf):
    return out(gateways.cross_subnet_gateways(netmap.edges(v.connections(spark, sf)), 3))


@R.add("gateway_evidence_points", """
WITH i AS (SELECT p_partkey, '10.9.' || (p_partkey % 250) || '.' || (p_partkey // 250) AS ip, CASE WHEN p_partkey % 7 = 0 THEN 'firewall' WHEN p_partkey % 7 = 1 THEN 'switch' END AS snmp,
  p_partkey % 3 = 0 AS dhcp, CASE WHEN p_partkey % 4 = 0 THEN 'router_or_firewall' WHEN p_partkey % 4 = 1 THEN 'switch' END AS vh, p_partkey % 5 = 0 AS sub,
  CASE WHEN p_partkey % 6 = 0 THEN 6 WHEN p_partkey % 6 = 1 THEN 9 END AS x FROM part)
SELECT ip, CAST((CASE WHEN snmp IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN dhcp THEN 2 ELSE 0 END) + (CASE WHEN vh IS NOT NULL THEN 1 ELSE 0 END) +
  (CASE WHEN sub THEN 1 ELSE 0 END) + (CASE WHEN x >= 8 THEN 2 WHEN x IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS infra_points,
  coalesce(snmp, CASE WHEN dhcp THEN 'router' END, CASE WHEN vh LIKE '%firewall%' THEN 'firewall' WHEN vh IS NOT NULL THEN 'router' END,
   CASE WHEN sub OR x IS NOT NULL THEN 'router' END) AS infra_type FROM i WHERE snmp IS NOT NULL OR dhcp OR vh IS NOT NULL OR sub OR x IS NOT NULL""")
def _(spark, sf):
    k = F.col("p_partkey")
    ip = F.concat(F.lit("10.9."), k % 250, F.lit("."), F.floor(k / 250)).alias("ip")
    p = v.table(spark, sf, "part").select(k.alias("k"), ip)
    k = F.col("k")
    got = gateways.infrastructure_evidence(
        dhcp=p.where(k % 3 == 0).select("ip", F.lit("s").alias("subnet")),
        snmp=p.where(k % 7 < 2).select("ip", F.when(k % 7 == 0, "firewall").otherwise("switch").alias("snmp_type")),
        subnet=p.where(k % 5 == 0).select("ip", F.lit("s").alias("subnet")),
        cross=p.where(k % 6 < 2).select("ip", F.when(k % 6 == 0, 6).otherwise(9).cast("bigint").alias("subnets_in")),
        vendor=p.where(k % 4 < 2).select("ip", F.when(k % 4 == 0, "router_or_firewall").otherwise("switch").alias("vendor_hint")),
    )
    return out(got, "ip", "infra_points", "infra_type")


# --- graph view -----------------------------------------------------------------

_VIEW = _NODES + """,
 top AS (SELECT * FROM nodes WHERE is_internal),
 vw AS (SELECT ip, arg_max({'id': node_id, 's': sensor_id, 'v': vlan}, {'t': total_connections, 'id': node_id}) AS b, max(total_connections) AS total_connections,
   list_sort(list(DISTINCT vlan)) AS vlans, list_sort(list(DISTINCT sensor_id)) AS sensors FROM top GROUP BY 1 ORDER BY max(total_connections) DESC, ip LIMIT 120),
 vn AS (SELECT ip, b.id AS node_id, b.s AS sensor_id, b.v AS vlan, total_connections, vlans, sensors FROM vw)"""


def _graph(spark, sf):
    """The stored edge table and the staged view of the busiest nodes."""
    c = v.connections(spark, sf)
    e = stage(netmap.edges(c), "edges")
    return e, stage(graph.view_nodes(netmap.nodes(e, netmap.services(c)), 120), "view")


@R.add("graph_nodes", f"""
WITH {_VIEW.strip()} SELECT node_id, ip, total_connections, array_to_string(vlans, ',') AS vlans, array_to_string(sensors, ',') AS sensors,
  {_NET24.format('ip')} AS subnet, round(least(total_connections / 10, 50.0), 6) AS size, CASE WHEN vlan <> '0' THEN ip || ' (v' || vlan || ')' ELSE ip END AS label, 3::BIGINT AS tier FROM vn""", ("v_conn",))
def _(spark, sf):
    _, view = _graph(spark, sf)
    return out(graph.payload(view), "node_id", "ip", "total_connections", "vlans", "sensors", "subnet", "size", "label", "tier")


@R.add("graph_peers", f"""
WITH {_VIEW.strip()},
 p AS (SELECT vn.node_id, 'out' AS direction, e.dst AS peer, e.n FROM e JOIN vn ON e.src = vn.ip AND e.sensor_id = vn.sensor_id AND e.vlan = vn.vlan WHERE e.src <> e.dst
   UNION ALL SELECT vn.node_id, 'in', e.src, e.n FROM e JOIN vn ON e.dst = vn.ip AND e.sensor_id = vn.sensor_id AND e.vlan = vn.vlan WHERE e.src <> e.dst),
 r AS (SELECT *, NOT {_INT.format('peer')} AS external FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY node_id, direction, external ORDER BY n DESC, peer) AS rank FROM r)
SELECT * FROM k WHERE rank <= CASE WHEN external THEN 50 ELSE 30 END""", ("v_conn",))
def _(spark, sf):
    return out(graph.peers(*_graph(spark, sf)))


@R.add("graph_internet_node", f"""
WITH {_VIEW.strip()},
 p AS (SELECT e.dst AS peer, e.n FROM e JOIN vn ON e.src = vn.ip AND e.sensor_id = vn.sensor_id AND e.vlan = vn.vlan WHERE NOT {_INT.format('e.dst')}
   UNION ALL SELECT e.src, 0 FROM e JOIN vn ON e.dst = vn.ip AND e.sensor_id = vn.sensor_id AND e.vlan = vn.vlan WHERE NOT {_INT.format('e.src')})
SELECT '__internet__' AS node_id, count(DISTINCT peer) AS unique_ips, CAST(sum(n) AS BIGINT) AS total_connections FROM p""", ("v_conn",))
def _(spark, sf):
    return out(graph.internet_node(*_graph(spark, sf)))


@R.add("graph_edges", f"""
WITH {_VIEW.strip()},
 s AS (SELECT vn.node_id, e.src, e.dst, e.n, row_number() OVER (PARTITION BY vn.node_id ORDER BY e.n DESC, e.dst) AS k FROM e JOIN vn ON e.src = vn.ip AND e.sensor_id = vn.sensor_id AND e.vlan = vn.vlan),
 t AS (SELECT s.node_id AS a, vn.node_id AS b, s.n FROM s JOIN vn ON s.dst = vn.ip WHERE k <= 15 AND s.node_id <> vn.node_id),
 u AS (SELECT min({{'n': -n, 'f': a, 't': b}}) AS m FROM t GROUP BY least(a, b), greatest(a, b))
SELECT m.f AS from_id, m.t AS to_id, -m.n AS value FROM u
UNION ALL SELECT vn.node_id, '__internet__', CAST(sum(e.n) AS BIGINT) FROM e JOIN vn ON e.src = vn.ip AND e.sensor_id = vn.sensor_id AND e.vlan = vn.vlan
  WHERE NOT {_INT.format('e.dst')} GROUP BY 1""", ("v_conn",))
def _(spark, sf):
    e, view = _graph(spark, sf)
    return out(graph.view_edges(e, view).unionByName(graph.internet_edges(e, view)))


@R.add("graph_edge_totals", f"""
WITH {_VIEW.strip()},
 a AS (SELECT coalesce(vn.node_id, '__rest__') AS node_id, CASE WHEN {_INT.format('e.dst')} THEN 'inside' ELSE 'outside' END AS side, count(*) AS edges, CAST(sum(e.n) AS BIGINT) AS connections
   FROM e LEFT JOIN vn ON e.src = vn.ip AND e.sensor_id = vn.sensor_id AND e.vlan = vn.vlan GROUP BY 1, 2),
 s AS (SELECT vn.node_id, e.dst, e.n, row_number() OVER (PARTITION BY vn.node_id ORDER BY e.n DESC, e.dst) AS k FROM e JOIN vn ON e.src = vn.ip AND e.sensor_id = vn.sensor_id AND e.vlan = vn.vlan),
 d AS (SELECT s.node_id, CASE WHEN {_INT.format('s.dst')} THEN 'inside' ELSE 'outside' END AS side, count(*) AS de, CAST(sum(s.n) AS BIGINT) AS dn FROM s JOIN vn ON s.dst = vn.ip WHERE k <= 15 AND s.node_id <> vn.node_id GROUP BY 1, 2)
SELECT a.*, coalesce(de, 0) AS drawn_edges, coalesce(dn, 0) AS drawn_connections, edges - coalesce(de, 0) AS rest_edges, connections - coalesce(dn, 0) AS rest_connections,
  (SELECT CAST(sum(n) AS BIGINT) FROM e) AS map_connections
FROM a LEFT JOIN d ON a.node_id = d.node_id AND a.side = d.side""", ("v_conn",))
def _(spark, sf):
    """What the view draws, what it leaves out, and the map's own total beside their sum."""
    e, view = _graph(spark, sf)
    got = graph.edge_totals(e, view)
    return out(got.withColumn("map_connections", got.agg(F.sum("connections").alias("t")).scalar()))


@R.add("graph_vlan_counts", f"WITH {_NODES.strip()} SELECT vlan, count(*) AS nodes FROM nodes WHERE is_internal GROUP BY 1", ("v_conn",))
def _(spark, sf):
    return out(graph.vlan_counts(_map(spark, sf)[0]))


# --- lookups ----------------------------------------------------------------------

@R.add("lookup_rdp_build", """
WITH b AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 7601 WHEN 1 THEN 19045 ELSE 2000 + p_partkey * 13 END AS build FROM part)
SELECT p_partkey, build, CASE build WHEN 7601 THEN 'Windows 7 SP1 / Server 2008 R2 SP1' WHEN 19045 THEN 'Windows 10 22H2'
""" + "\n".join(f" WHEN {b} THEN '{n}'" for b, n in fv.RDP_BUILDS.items() if b not in (7601, 19045)) + """
 ELSE CASE WHEN build < 6000 THEN 'Windows XP/2003' WHEN build < 7600 THEN 'Windows Vista/2008' WHEN build < 9200 THEN 'Windows 7/2008 R2'
  WHEN build < 9600 THEN 'Windows 8/2012' WHEN build < 10240 THEN 'Windows 8.1/2012 R2' WHEN build < 22000 THEN 'Windows 10 (build ' || build || ')' ELSE 'Windows 11 (build ' || build || ')' END END AS os FROM b""")
def _(spark, sf):
    k = F.col("p_partkey")
    build = F.when(k % 4 == 0, 7601).when(k % 4 == 1, 19045).otherwise(2000 + k * 13)
    return v.table(spark, sf, "part").select("p_partkey", build.alias("build")).withColumn("os", devices.rdp_windows(F.col("build")))


@R.add("lookup_dhcp_vendor_class", """
WITH c AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'MSFT 10.0' WHEN 1 THEN 'msft 5.0x' WHEN 2 THEN 'android-dhcp-13' WHEN 3 THEN 'dhcpcd-9.4' WHEN 4 THEN 'udhcp 1.3' ELSE 'other' END AS vc FROM customer)
SELECT c_custkey, CASE WHEN vc LIKE 'MSFT 10.0' THEN 'Windows 10/11' WHEN vc LIKE 'msft 5.0%' THEN 'Windows 2000/XP/2003' WHEN vc LIKE 'android%' THEN 'Android'
  WHEN vc LIKE 'dhcpcd%' THEN 'Linux/BSD (dhcpcd)' WHEN vc LIKE 'udhcp%' THEN 'Embedded Linux (BusyBox)' END AS os FROM c""")
def _(spark, sf):
    k = F.col("c_custkey")
    vc = (F.when(k % 6 == 0, "MSFT 10.0").when(k % 6 == 1, "msft 5.0x").when(k % 6 == 2, "android-dhcp-13")
          .when(k % 6 == 3, "dhcpcd-9.4").when(k % 6 == 4, "udhcp 1.3").otherwise("other"))
    return v.table(spark, sf, "customer").select("c_custkey", devices.dhcp_os(vc).alias("os"))


@R.add("lookup_snmp_model", """
WITH o AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '1.3.6.1.4.1.9.1.' || s_suppkey WHEN 1 THEN '1.3.6.1.4.1.9.12.' || s_suppkey
  WHEN 2 THEN '1.3.6.1.4.1.11.2.3.7.11.' || s_suppkey WHEN 3 THEN '1.3.6.1.4.1.9.100' ELSE '1.3.6.1.4.1.12356.101' END AS oid FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Cisco Router/Switch' WHEN 1 THEN 'Cisco Firewall (ASA/FTD)' WHEN 2 THEN 'HP ProCurve Switch' WHEN 4 THEN 'FortiGate Firewall' END AS model,
  CASE s_suppkey % 5 WHEN 0 THEN 'router' WHEN 1 THEN 'firewall' WHEN 2 THEN 'switch' WHEN 4 THEN 'firewall' END AS device_type FROM o""")
def _(spark, sf):
    k = F.col("s_suppkey")
    oid = (F.when(k % 5 == 0, F.concat(F.lit("1.3.6.1.4.1.9.1."), k)).when(k % 5 == 1, F.concat(F.lit("1.3.6.1.4.1.9.12."), k))
           .when(k % 5 == 2, F.concat(F.lit("1.3.6.1.4.1.11.2.3.7.11."), k)).when(k % 5 == 3, F.lit("1.3.6.1.4.1.9.100")).otherwise("1.3.6.1.4.1.12356.101"))
    model = devices.snmp_model(oid)
    return v.table(spark, sf, "supplier").select("s_suppkey", model.alias("model"), devices.infrastructure_type(model).alias("device_type"))


@R.add("lookup_user_agent_os", """
SELECT user_agent, CASE WHEN lower(user_agent) LIKE '%windows nt 10%' THEN 'Windows 10/11' WHEN lower(user_agent) LIKE '%macintosh%' THEN 'macOS'
  WHEN lower(user_agent) LIKE '%linux%' THEN 'Linux' END AS os, count(*) AS requests FROM v_http GROUP BY ALL""", ("v_http",))
def _(spark, sf):
    return out(v.http(spark, sf).groupBy("user_agent", devices.os_from_user_agent(F.col("user_agent")).alias("os")).agg(F.count(F.lit(1)).alias("requests")))


@R.add("certificate_name_matches", """
WITH n AS (SELECT DISTINCT sensor_id, vlan, dest_ip AS ip, lower(server_dns_computer_name) AS name FROM v_ntlm
   UNION SELECT DISTINCT sensor_id, vlan, source_ip, lower(hostname) FROM v_ntlm),
 c AS (SELECT DISTINCT 'sensor' || (s_suppkey % 3) AS cert_sensor, CASE s_suppkey % 4 WHEN 0 THEN 'srv-' || (s_suppkey % 12) || '.corp.example' WHEN 1 THEN '*.ws-' || (s_suppkey % 40)
    WHEN 2 THEN 'corp.exam' ELSE 'ws-' || (s_suppkey % 40) || '.other.org' END AS cn FROM supplier)
SELECT DISTINCT n.sensor_id, n.ip, c.cn, c.cert_sensor FROM n JOIN c ON contains(n.name, c.cn) OR n.name = string_split(regexp_replace(c.cn, '^[*.]+', ''), '.')[1]""", ("v_ntlm",))
def _(spark, sf):
    k = F.col("s_suppkey")
    s = lambda c: c.cast("string")
    certs = v.table(spark, sf, "supplier").select(
        F.concat(F.lit("sensor"), s(k % 3)).alias("cert_sensor"),
        F.when(k % 4 == 0, F.concat(F.lit("SRV-"), s(k % 12), F.lit(".corp.example"))).when(k % 4 == 1, F.concat(F.lit("*.ws-"), s(k % 40)))
        .when(k % 4 == 2, "corp.exam").otherwise(F.concat(F.lit("ws-"), s(k % 40), F.lit(".other.org"))).alias("cn"))
    names = netmap.ntlm_names(v.ntlm(spark, sf)).where("kind = 'hostname' OR name LIKE 'WS-%'")
    return devices.certificate_matches(names, certs).select("sensor_id", "ip", "cn", "cert_sensor")


def _listed(expr):
    return f"array_to_string(list_sort(list_distinct({expr})), ',')"


@R.add("certificates_of_nodes", f"""
WITH {protocols.V_LOG}, n AS (SELECT DISTINCT 'sensor' || (s_suppkey % 3) AS sensor_id, '0' AS vlan, '10.0.0.' || (s_suppkey % 50) AS ip, 'host' || (s_suppkey % 80) || CASE WHEN s_suppkey % 3 = 0 THEN '.corp.local' ELSE '' END AS name FROM supplier),
 c AS (SELECT DISTINCT sensor_id AS cert_sensor, certificate_subject AS cn, 'ca' || (certificate_issuer % 4) AS ca, 'O=Org' || (certificate_issuer % 3) AS org FROM v_log WHERE certificate_subject IS NOT NULL),
 m AS (SELECT n.sensor_id, n.vlan, n.ip, c.* FROM n JOIN c ON contains(n.name, c.cn) OR n.name = string_split(c.cn, '.')[1]),
 g AS (SELECT sensor_id, vlan, ip, list(cn) AS cns, list_concat(list(ca), list(org)) AS iss FROM m GROUP BY ALL)
SELECT n.sensor_id, n.ip, {_listed("list_concat(['shown.example'], coalesce(cns, []))")} AS cert_subjects, {_listed("list_concat(['ca1'], coalesce(iss, []))")} AS cert_issuers
FROM (SELECT DISTINCT sensor_id, vlan, ip FROM n) n LEFT JOIN g USING (sensor_id, vlan, ip)""")
def _(spark, sf):
    """Certificates and their issuers beside those that a node's own servers showed."""
    k = F.col("s_suppkey")
    names = v.table(spark, sf, "supplier").select(
        F.concat(F.lit("sensor"), k % 3).alias("sensor_id"), F.lit("0").alias("vlan"), F.concat(F.lit("10.0.0."), k % 50).alias("ip"),
        F.concat(F.lit("HOST"), k % 80, F.when(k % 3 == 0, ".corp.local").otherwise("")).alias("name"))
    nodes = names.select("sensor_id", "vlan", "ip").distinct().withColumns(
        {"cert_subjects": F.array(F.lit("shown.example")), "cert_issuers": F.array(F.lit("ca1"))})
    certificates = devices.certificate_rows(protocols.log(spark, sf))
    matches = devices.certificate_matches(names, certificates.select("cert_sensor", "cn").distinct())
    got = devices.attach_certificates(nodes, matches, devices.certificate_issuers(matches, certificates))
    return out(got.withColumns({c: F.array_join(c, ",") for c in ("cert_subjects", "cert_issuers")}), "sensor_id", "ip", "cert_subjects", "cert_issuers")


def profile_logs(spark, sf):
    from workload.protocols import logs

    return logs(spark, sf)


@R.add("profiled_map")
def _(spark, sf):
    """Whole profiling job: rows only, its parts have their own SQL."""
    net_map = profiling.build_map(v.connections(spark, sf), v.dns(spark, sf), v.ntlm(spark, sf), staged=True)
    typed = profiling.profile_map(net_map, profile_logs(spark, sf), staged=True)
    return out(typed, "node_id", "device_type", "os_info", "roles", "gateway_evidence")


@R.add("host_identity")
def _(spark, sf):
    net_map = profiling.build_map(v.connections(spark, sf), v.dns(spark, sf), v.ntlm(spark, sf), staged=True)
    typed = profiling.profile_map(net_map, profile_logs(spark, sf), staged=True)
    return out(devices.host_identity(typed), "sensor_id", "vlan", "ip", "os", "os_source", "os_confidence", "confidence", "signal_count")
