"""The network map: nodes, edges, services, names and MAC bindings.

A node is (sensor_id, vlan, ip). Peers, services, names and bindings are long
tables beside the nodes, never map columns, so a host that talks to millions
of peers stays spread over many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.functions import net, text
from netquarry.operators.common import earliest, top_rows
from netquarry.operators.flows import present

NODE = ["sensor_id", "vlan", "ip"]
EDGE = ["sensor_id", "vlan", "src", "dst"]


def _scoped(df: DataFrame) -> DataFrame:
    """Sensor and vlan with their defaults."""
    have = df.columns
    sensor = F.coalesce("sensor_id", F.lit("default")) if "sensor_id" in have else F.lit("default")
    vlan = F.coalesce(F.col("vlan").cast("string"), F.lit("0")) if "vlan" in have else F.lit("0")
    return df.withColumns({"sensor_id": sensor, "vlan": vlan})


def edges(connections: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Connections, bytes and time span per directed pair."""
    return (
        _scoped(connections).where(present("source_ip") & present("destination_ip"))
        .groupBy(*extra_keys, "sensor_id", "vlan", F.col("source_ip").alias("src"), F.col("destination_ip").alias("dst"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out"),
            F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in"),
            F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        )
    )


def services(connections: DataFrame) -> DataFrame:
    """(node, port, protocol) served, with connection counts."""
    port = F.col("destination_port").cast("int")
    return (
        _scoped(connections).where(present("source_ip") & present("destination_ip") & (F.coalesce(port, F.lit(0)) != 0))
        .groupBy("sensor_id", "vlan", F.col("destination_ip").alias("ip"), port.alias("port"),
                 F.coalesce("protocol", F.lit("tcp")).alias("protocol"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new edge partials as one; only sums, minima and maxima, so
    increments in any order give the same map."""
    return stored.unionByName(new).groupBy(*EDGE).agg(
        F.sum("n").alias("n"), F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def merge_services(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new).groupBy("sensor_id", "vlan", "ip", "port", "protocol").agg(F.sum("n").alias("n"))


def node_totals(edge_table: DataFrame) -> DataFrame:
    """Both ends of every edge rolled up per node; bytes swap by side. A self
    connection counts once per side, as two observations."""
    src_end = F.struct(
        F.col("src").alias("ip"), F.col("n").alias("n"), F.col("bytes_out").alias("sent"), F.col("bytes_in").alias("received"),
        F.lit(1).alias("out_peer"), F.lit(0).alias("in_peer"),
    )
    dst_end = F.struct(
        F.col("dst").alias("ip"), F.col("n").alias("n"), F.col("bytes_in").alias("sent"), F.col("bytes_out").alias("received"),
        F.lit(0).alias("out_peer"), F.lit(1).alias("in_peer"),
    )
    ends = edge_table.select(
        "sensor_id", "vlan", "first_seen", "last_seen", F.explode(F.array(src_end, dst_end)).alias("_e")
    ).select("sensor_id", "vlan", "first_seen", "last_seen", "_e.*")
    return (
        ends.groupBy(*NODE)
        .agg(
            F.sum("n").alias("total_connections"), F.sum("sent").alias("bytes_sent"), F.sum("received").alias("bytes_received"),
            F.sum("out_peer").alias("out_degree"), F.sum("in_peer").alias("in_degree"),
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        )
        .withColumn("is_internal", net.is_internal("ip"))
    )


def _serves(port: int, protocol: str | None = None) -> Column:
    test = F.col("port") == port
    return test & (F.col("protocol") == protocol) if protocol else test


def service_flags(service_table: DataFrame) -> DataFrame:
    """Per node: service list (bounded by the port range) and the flags the
    role rules need."""
    def any_of(*pairs):
        test = F.lit(False)
        for port, protocol in pairs:
            test = test | _serves(port, protocol)
        return F.max(test)

    return service_table.groupBy(*NODE).agg(
        F.array_sort(F.collect_set(F.struct("port", "protocol"))).alias("services"),
        any_of((53, "udp"), (53, "tcp")).alias("_dns"),
        any_of((80, "tcp"), (443, "tcp")).alias("_web"),
        any_of((25, "tcp"), (587, "tcp"), (993, "tcp")).alias("_mail"),
        any_of((179, "tcp"), (1985, "udp"), (520, "udp")).alias("_router"),
    )


def node_roles() -> Column:
    """Behavioural roles from degrees and service flags, sorted."""
    def flag(name):
        return F.coalesce(F.col(name), F.lit(False))

    rules = (
        (F.col("out_degree") > F.col("in_degree") * 2, "client"),
        (flag("_dns"), "dns_server"),
        (flag("_mail"), "mail_server"),
        (F.col("in_degree") > 50, "popular"),
        (flag("_router"), "router"),
        (F.col("out_degree") > 50, "scanner"),
        (F.col("in_degree") > 10, "server"),
        (flag("_web"), "web_server"),
    )
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda r: r.isNotNull())


def nodes(edge_table: DataFrame, service_table: DataFrame) -> DataFrame:
    """Node table with totals, services and roles."""
    out = node_totals(edge_table).join(service_flags(service_table), NODE, "left")
    out = out.withColumn("roles", node_roles()).withColumn(
        "services", F.coalesce("services", F.array().cast("array<struct<port:int,protocol:string>>"))
    )
    return out.drop("_dns", "_web", "_mail", "_router").withColumn("node_id", net.node_id(*NODE))


def capped_peers(edge_table: DataFrame, cap: int = 10_000, direction: str = "out") -> DataFrame:
    """Peers per node, busiest first, as many as the map file keeps; the edge
    table itself stays whole."""
    own, other = ("src", "dst") if direction == "out" else ("dst", "src")
    return top_rows(edge_table, ["sensor_id", "vlan", own], [F.desc("n"), F.asc(other)], cap, "peer_rank")


def external_peers(connections: DataFrame, ports: int = 20) -> DataFrame:
    """Per internal node and outside peer: local and remote ports (sets bounded
    by the port range, first ``ports`` kept), last contact."""
    src_in, dst_in = net.is_internal("source_ip"), net.is_internal("destination_ip")
    rows = _scoped(connections).where(present("source_ip") & present("destination_ip") & (src_in != dst_in))
    sport = F.nullif(F.coalesce(F.col("source_port"), F.lit(0)), F.lit(0))
    dport = F.nullif(F.coalesce(F.col("destination_port"), F.lit(0)), F.lit(0))
    rows = rows.select(
        "sensor_id", "vlan", "timestamp",
        F.when(src_in, F.col("source_ip")).otherwise(F.col("destination_ip")).alias("ip"),
        F.when(src_in, F.col("destination_ip")).otherwise(F.col("source_ip")).alias("peer"),
        F.when(src_in, sport).otherwise(dport).alias("local_port"),
        F.when(src_in, dport).otherwise(sport).alias("remote_port"),
    )
    return rows.groupBy(*NODE, "peer").agg(
        F.count(F.lit(1)).alias("n"),
        F.slice(F.array_sort(F.collect_set("local_port")), 1, ports).alias("local_ports"),
        F.slice(F.array_sort(F.collect_set("remote_port")), 1, ports).alias("remote_ports"),
        F.max("timestamp").alias("last_seen"),
    )


def answer_names(dns: DataFrame) -> DataFrame:
    """(node, name) for answers that are IPv4 addresses."""
    return (
        _scoped(dns).where(net.is_ipv4_literal("answer") & present("domain") & present("source_ip"))
        .select("sensor_id", "vlan", F.col("answer").alias("ip"), F.lit("hostname").alias("kind"), F.col("domain").alias("name"))
        .distinct()
    )


def ntlm_names(ntlm: DataFrame) -> DataFrame:
    """(node, kind, name): client and server NetBIOS names and server host
    names, from one scan."""
    names = F.array(
        F.struct(F.col("source_ip").alias("ip"), F.lit("netbios").alias("kind"), F.upper(text.meaningful("hostname")).alias("name")),
        F.struct(F.col("dest_ip").alias("ip"), F.lit("netbios").alias("kind"), F.upper(text.meaningful("server_nb_computer_name")).alias("name")),
        F.struct(F.col("dest_ip").alias("ip"), F.lit("hostname").alias("kind"), F.lower(text.meaningful("server_dns_computer_name")).alias("name")),
    )
    return (
        _scoped(ntlm).select("sensor_id", "vlan", F.inline(names))
        .where(F.col("name").isNotNull() & present("ip")).distinct()
    )


def ntlm_domains(ntlm: DataFrame) -> DataFrame:
    """The last domain seen per node, on either side."""
    rows = _scoped(ntlm).where(text.meaningful("domainname").isNotNull()).select(
        "sensor_id", "vlan", F.explode(F.array("source_ip", "dest_ip")).alias("ip"), F.upper("domainname").alias("domain"), "timestamp"
    )
    return rows.where(present("ip")).groupBy(*NODE).agg(F.max(F.struct("timestamp", "domain")).getField("domain").alias("domain"))


def evict_stale(node_table: DataFrame, max_nodes: int) -> DataFrame:
    """Keep the most recently seen nodes; the rest drop out oldest first."""
    return node_table.orderBy(F.desc("last_seen"), F.asc("node_id")).limit(max_nodes)


def mac_bindings(leases: DataFrame) -> DataFrame:
    """First and last time per (mac, ip, vlan, sensor) and its first real host
    name; leases: mac, ip, vlan, sensor_id, host_name, timestamp."""
    rows = _scoped(leases).where(present("mac") & present("ip")).withColumns(
        {"mac": net.normalize_mac("mac"), "host_name": F.lower(text.meaningful("host_name"))}
    )
    return rows.groupBy("mac", "ip", "vlan", "sensor_id").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.coalesce(earliest("host_name"), F.lit("")).alias("hostname"),
        F.min(F.when(F.col("host_name").isNotNull(), F.col("timestamp"))).alias("named_at"),
    )


def merge_bindings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Widen stored bindings by new ones; the name seen first stays, whichever side arrives first."""
    named = F.min(F.when(F.col("hostname") != "", F.struct("named_at", "hostname")))
    return stored.unionByName(new).groupBy("mac", "ip", "vlan", "sensor_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.coalesce(named.getField("hostname"), F.lit("")).alias("hostname"), named.getField("named_at").alias("named_at"),
    )


def mac_summary(bindings: DataFrame) -> DataFrame:
    """Distinct addresses per MAC; address lists stay in the binding table."""
    return bindings.groupBy("mac").agg(
        F.countDistinct("ip").alias("ip_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def multi_ip_macs(bindings: DataFrame, n: int = 100) -> DataFrame:
    return mac_summary(bindings).where(F.col("ip_count") > 1).orderBy(F.desc("ip_count"), F.asc("mac")).limit(n)


def all_macs(bindings: DataFrame, n: int = 500) -> DataFrame:
    return mac_summary(bindings).orderBy(F.desc("ip_count"), F.asc("mac")).limit(n)


def mac_nodes(bindings: DataFrame, node_table: DataFrame) -> DataFrame:
    """(mac, node): nodes carrying the MAC or any address bound to it."""
    cols = ["sensor_id", "vlan", "ip"]
    by_ip = bindings.select("mac", "ip").distinct().join(node_table.select(*cols), "ip").select("mac", *cols)
    if "mac_address" not in node_table.columns:
        return by_ip.distinct()
    own = bindings.select("mac").distinct().join(
        node_table.select(F.col("mac_address").alias("mac"), *cols), "mac"
    ).select("mac", *cols)
    return by_ip.unionByName(own).distinct()


def device_identity(bindings: DataFrame, ip: str) -> DataFrame:
    """All bindings of every MAC ever seen at an address."""
    macs = bindings.where(F.col("ip") == ip).select("mac").distinct()
    return bindings.join(macs, "mac", "left_semi")


# --- lookups by MAC ---------------------------------------------------------

def oui_registry(spark, path: str) -> DataFrame:
    """(prefix, vendor) from the public IEEE assignment file (CSV with the
    columns Registry, Assignment, Organization Name)."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    code = F.upper(F.col("Assignment"))
    return rows.where(F.length("Assignment") == 6).select(
        F.concat_ws(":", F.substring(code, 1, 2), F.substring(code, 3, 2), F.substring(code, 5, 2)).alias("prefix"),
        F.col("Organization Name").alias("vendor"),
    )


def vendor_of(devices: DataFrame, oui: DataFrame, mac: str = "mac_address") -> DataFrame:
    """Vendor by the first three octets; '' when unknown."""
    lookup = oui.select(F.col("prefix").alias("_prefix"), "vendor").dropDuplicates(["_prefix"])
    out = devices.drop("vendor").withColumn("_mp", net.mac_prefix(mac)).join(lookup, F.col("_mp") == F.col("_prefix"), "left")
    return out.withColumn("vendor", F.coalesce("vendor", F.lit(""))).drop("_mp", "_prefix")


def virtual_platform(mac: str = "mac_address") -> Column:
    prefix = net.mac_prefix(mac)
    known = [F.when(prefix == p, F.lit(name)) for p, name in fv.VIRTUAL_MAC_PREFIXES.items()]
    return F.coalesce(*known, F.when(F.startswith(prefix, F.lit("02:42:")), F.lit("Docker")), F.lit(""))


def infrastructure_hint(vendor: str = "vendor") -> Column:
    """Network-equipment kind of a vendor; registry names may carry a legal
    form, so the known name only has to lead."""
    return F.coalesce(
        *[
            F.when(F.startswith(F.lower(vendor), F.lit(name.lower())), F.lit(hint))
            for name, hint in fv.INFRASTRUCTURE_VENDORS.items()
        ],
        F.lit(""),
    )


# --- reading the map --------------------------------------------------------

def filter_nodes(
    node_table: DataFrame, edge_table: DataFrame | None = None, device_type: str | None = None, role: str | None = None,
    has_external: bool | None = None, port: int | None = None, os_contains: str | None = None,
    ip_prefix: str | None = None, hostname_contains: str | None = None, limit: int = 50,
) -> DataFrame:
    """Nodes by type, role, outside contact, served port, OS, address prefix
    and host name; busiest first."""
    out = node_table
    if device_type is not None:
        out = out.where(F.col("device_type") == device_type)
    if role is not None:
        out = out.where(F.array_contains("roles", role))
    if port is not None:
        out = out.where(F.exists("services", lambda s: s.getField("port") == port))
    if os_contains is not None:
        out = out.where(F.contains(F.lower("os_info"), F.lit(os_contains.lower())))
    if ip_prefix is not None:
        out = out.where(F.startswith("ip", F.lit(ip_prefix)))
    if hostname_contains is not None:
        out = out.where(F.exists("hostnames", lambda h: F.contains(F.lower(h), F.lit(hostname_contains.lower()))))
    if has_external is not None:
        outside = edge_table.select(
            "sensor_id", "vlan", F.inline(F.array(F.struct(F.col("src").alias("ip"), F.col("dst").alias("peer")),
                                                 F.struct(F.col("dst").alias("ip"), F.col("src").alias("peer"))))
        ).where(~net.is_internal("peer")).select(*NODE)
        out = out.join(outside.distinct(), NODE, "left_semi" if has_external else "left_anti")
    return out.orderBy(F.desc("total_connections"), F.asc("node_id")).limit(limit)


def with_annotations(node_table: DataFrame, annotations: DataFrame, cap: int = 50) -> DataFrame:
    """Analyst notes by the address in the annotated node id (node_id, note,
    created_at): newest ``cap`` on the row, all of them counted."""
    rows = annotations.select(F.element_at(F.split("node_id", ":"), -1).alias("ip"), "note", "created_at")
    counts = rows.groupBy("ip").agg(F.count(F.lit(1)).alias("note_count"))
    lists = top_rows(rows, ["ip"], [F.desc("created_at"), F.asc("note")], cap, "_n").groupBy("ip").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "note"))), lambda s: s.getField("note")).alias("notes")
    )
    return node_table.join(lists, "ip", "left").join(counts, "ip", "left").na.fill(0, ["note_count"])


def with_groups(node_table: DataFrame, members: DataFrame, flags: DataFrame) -> DataFrame:
    """LAN groups (node_id, group_name) and device flags (node_id, flag,
    reason) per node; both are analyst-made and small per node."""
    groups = members.groupBy("node_id").agg(F.array_sort(F.collect_set("group_name")).alias("lan_groups"))
    marked = flags.groupBy("node_id").agg(F.array_sort(F.collect_set(F.struct("flag", "reason"))).alias("flags"))
    return node_table.join(groups, "node_id", "left").join(marked, "node_id", "left")


def group_members(members: DataFrame, cap: int = 1000) -> DataFrame:
    """Members per group: count and the first ids."""
    counts = members.groupBy("group_name").agg(F.countDistinct("node_id").alias("members"))
    first = top_rows(members.distinct(), ["group_name"], [F.asc("node_id")], cap, "_n").groupBy("group_name").agg(
        F.array_sort(F.collect_list("node_id")).alias("node_ids")
    )
    return counts.join(first, "group_name")


# --- map summaries ----------------------------------------------------------

def map_totals(node_table: DataFrame) -> DataFrame:
    inside = F.col("is_internal")
    return node_table.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if(inside).alias("internal_nodes"),
        F.count_if(~inside).alias("external_nodes"),
        F.sum(F.when(inside, F.size("services")).otherwise(0)).alias("total_services"),
        F.count_if(F.array_contains("roles", "server")).alias("servers"),
        F.countDistinct(F.when(F.col("vlan") != "0", F.col("vlan"))).alias("vlans"),
        F.countDistinct("sensor_id").alias("sensors"),
    )


def top_talkers(node_table: DataFrame, n: int = 10) -> DataFrame:
    return (
        node_table.where("is_internal").select("ip", "sensor_id", "vlan", "total_connections")
        .orderBy(F.desc("total_connections"), F.asc("ip"), F.asc("sensor_id"), F.asc("vlan")).limit(n)
    )


def device_inventory(node_table: DataFrame, n: int = 25) -> DataFrame:
    """The busiest internal nodes per device type, types in reading order."""
    order = F.coalesce(
        *[F.when(F.col("device_type") == t, F.lit(i)) for i, t in enumerate(fv.INVENTORY_ORDER)], F.lit(len(fv.INVENTORY_ORDER))
    )
    rows = node_table.where(F.col("is_internal") & (F.coalesce("device_type", F.lit("")) != ""))
    return top_rows(rows, ["device_type"], [F.desc("total_connections"), F.asc("node_id")], n).withColumn("type_order", order)


def type_counts(node_table: DataFrame) -> DataFrame:
    """Internal nodes per sensor and type with per-sensor and grand totals."""
    rows = node_table.where(F.col("is_internal") & (F.coalesce("device_type", F.lit("")) != ""))
    return rows.rollup("sensor_id", "device_type").agg(F.count(F.lit(1)).alias("devices"))


def coverage(node_table: DataFrame) -> DataFrame:
    """Internal nodes per kind of identification; absent columns count zero."""
    have = set(node_table.columns)
    inside = F.col("is_internal")

    def filled(name):
        if name not in have:
            return F.lit(False)
        kind = node_table.schema[name].dataType.typeName()
        if kind in ("array", "map"):
            return F.coalesce(F.size(name) > 0, F.lit(False))
        if kind == "string":
            return F.coalesce(F.col(name) != "", F.lit(False))
        return F.col(name).isNotNull()

    wanted = {
        "profiled": "device_type", "ja3_fingerprinted": "ja3_fingerprints", "dns_profiled": "dns_profile",
        "rdp_fingerprinted": "rdp_info", "dhcp_vendor_identified": "dhcp_vendor_class",
        "cert_identified": "cert_subjects", "file_types_tracked": "file_mime_types",
        "os_identified": "os_info", "host_identified": "host_id",
    }
    return node_table.agg(*[F.count_if(inside & filled(c)).alias(out) for out, c in wanted.items()])


def profiling_stats(node_table: DataFrame) -> DataFrame:
    """Profiled, unprofiled and identified nodes; the candidates are internal
    nodes, or all nodes where there is no internal one."""
    done = F.coalesce(F.col("device_type"), F.lit("")) != ""
    inside = F.col("is_internal")
    identified = F.col("host_id").isNotNull() if "host_id" in node_table.columns else F.lit(False)
    sums = node_table.agg(
        F.count_if(inside).alias("_in"), F.count(F.lit(1)).alias("_all"),
        F.count_if(inside & done).alias("_in_done"), F.count_if(done).alias("_all_done"),
        F.count_if(inside & identified).alias("_in_id"), F.count_if(identified).alias("_all_id"),
    )

    def pick(name):
        return F.when(F.col("_in") > 0, F.col("_in" + name)).otherwise(F.col("_all" + name))

    return sums.select(
        pick("").alias("total"), pick("_done").alias("profiled"),
        (pick("") - pick("_done")).alias("unprofiled"), pick("_id").alias("host_identified"),
    )


def sensor_tables(node_table: DataFrame) -> DataFrame:
    """Per sensor: ten busiest internal and external nodes and the twenty
    servers with most services (sensor, kind, rank)."""
    inside = F.col("is_internal")
    kinds = F.filter(
        F.array(
            F.when(inside, F.struct(F.lit("internal").alias("kind"), F.col("total_connections").alias("weight"))),
            F.when(~inside, F.struct(F.lit("external").alias("kind"), F.col("total_connections").alias("weight"))),
            F.when(
                inside & (F.array_contains("roles", "server") | (F.size("services") > 0)),
                F.struct(F.lit("server").alias("kind"), F.size("services").cast("bigint").alias("weight")),
            ),
        ),
        lambda k: k.isNotNull(),
    )
    rows = node_table.select("sensor_id", "vlan", "ip", F.inline(kinds))
    ranked = top_rows(rows, ["sensor_id", "kind"], [F.desc("weight"), F.asc("ip"), F.asc("vlan")], 20)
    return ranked.where((F.col("kind") == "server") | (F.col("rank") <= 10))


def map_context(node_table: DataFrame) -> DataFrame:
    """Infrastructure members of the map as (kind, ip): gateways, DNS servers,
    domain controllers, NTP servers and, for asset weighting, servers."""
    have = set(node_table.columns)

    def has_role(*names):
        out = F.lit(False)
        for n in names:
            out = out | F.array_contains("roles", n)
        return out

    gateway = F.size("is_gateway_for") > 0 if "is_gateway_for" in have else F.lit(False)
    ntp = F.coalesce("ntp_server", F.lit(False)) if "ntp_server" in have else F.lit(False)
    kind = F.col("device_type") if "device_type" in have else F.lit("")
    kinds = F.filter(
        F.array(
            F.when(gateway, F.lit("gateway")), F.when(has_role("dns_server"), F.lit("dns_server")),
            F.when(has_role("domain_controller", "dc") | (kind == "domain_controller"), F.lit("domain_controller")),
            F.when(ntp, F.lit("ntp_server")),
        ),
        lambda k: k.isNotNull(),
    )
    return node_table.select(F.explode(kinds).alias("kind"), "ip").distinct()


def node_baselines(node_table: DataFrame) -> DataFrame:
    """Connections and bytes per address over all sensors and vlans."""
    return node_table.groupBy("ip").agg(
        F.sum("total_connections").alias("total_connections"),
        F.sum("bytes_received").alias("bytes_in"), F.sum("bytes_sent").alias("bytes_out"),
    )


# Device types worth an attacker's effort, and members of the infrastructure that all others need.
HIGH_VALUE_TYPES = ("server", "domain_controller")
CRITICAL_KINDS = ("gateway", "dns_server", "domain_controller")


def asset_context(node_table: DataFrame) -> DataFrame:
    """(weight, ip) of the assets that selection and hypotheses weigh:
    ``high_value`` by device type, ``critical`` by part in the infrastructure.
    An address may be both; it counts once for each, whatever its sensors."""
    kind = F.col("device_type") if "device_type" in node_table.columns else F.lit("")
    high = node_table.where(kind.isin(*HIGH_VALUE_TYPES)).select(F.lit("high_value").alias("weight"), "ip")
    critical = map_context(node_table).where(F.col("kind").isin(*CRITICAL_KINDS)).select(F.lit("critical").alias("weight"), "ip")
    return high.unionByName(critical).distinct()


def asset_counts(assets: DataFrame) -> DataFrame:
    """One row with the numbers that family selection asks for."""
    return assets.agg(*[F.count_if(F.col("weight") == w).alias(f"{w}_assets") for w in ("critical", "high_value")])
