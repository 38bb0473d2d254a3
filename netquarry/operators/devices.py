"""Device facts from protocol profiles: operating system, names, type, identity.

Facts are joined per address onto the nodes; every inference is an ordered
``coalesce`` of conditions, so the first matching rule wins as written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.functions import net, text
from netquarry.operators import netmap
from netquarry.operators.common import sorted_values, substring_matches
from netquarry.operators.netmap import NODE

# Operating-system hints in banners and agents, first match wins.
SSH_HINTS = (("ubuntu", "Ubuntu Linux"), ("debian", "Debian Linux"), ("rhel", "Red Hat Linux"),
             ("redhat", "Red Hat Linux"), ("windows", "Windows"))
SMTP_HINTS = (("ubuntu", "Ubuntu Linux"), ("debian", "Debian Linux"), ("centos", "CentOS Linux"),
              ("microsoft", "Windows Server"), ("exchange", "Windows Server"))
FTP_HINTS = (("windows", "Windows Server"), ("microsoft", "Windows Server"), ("ubuntu", "Ubuntu Linux"),
             ("debian", "Debian Linux"), ("vsftpd", "Linux"), ("proftpd", "Linux"))
AGENT_HINTS = (("windows nt 10", "Windows 10/11"), ("windows nt 6.3", "Windows 8.1"), ("windows nt 6.1", "Windows 7"),
               ("windows", "Windows"), ("macintosh", "macOS"), ("mac os x", "macOS"), ("linux", "Linux"),
               ("android", "Android"), ("iphone", "iOS"), ("ipad", "iOS"))


def hinted(value: Column, hints: Sequence[tuple[str, str]], unless: Mapping[str, str] = {}) -> Column:
    """The first hint a lower-cased text contains; ``unless`` names a word that
    cancels a hint."""
    low = F.lower(value)
    tests = []
    for needle, name in hints:
        test = F.contains(low, F.lit(needle))
        if needle in unless:
            test = test & ~F.contains(low, F.lit(unless[needle]))
        tests.append(F.when(test, F.lit(name)))
    return F.coalesce(*tests)


def os_from_ssh(banner: Column) -> Column:
    return hinted(banner, SSH_HINTS)


def os_from_smtp(banner: Column) -> Column:
    return hinted(banner, SMTP_HINTS)


def os_from_ftp(banner: Column) -> Column:
    return hinted(banner, FTP_HINTS)


def os_from_user_agent(agent: Column) -> Column:
    return hinted(agent, AGENT_HINTS, {"linux": "android"})


def first_match(items: Column, rule) -> Column:
    """The first non-null result of a rule over a list."""
    return F.get(F.filter(F.transform(items, rule), lambda x: x.isNotNull()), F.lit(0))


def rdp_windows(build: Column) -> Column:
    """Windows release of an RDP client build: exact, else by range."""
    exact = [F.when(build == b, F.lit(name)) for b, name in fv.RDP_BUILDS.items()]
    ranges = [F.when(build < top, F.lit(name)) for top, name in fv.RDP_BUILD_RANGES]
    tail = F.concat(
        F.when(build < 22000, F.lit("Windows 10 (build ")).otherwise(F.lit("Windows 11 (build ")),
        build.cast("string"), F.lit(")"),
    )
    return F.when(build.isNotNull(), F.coalesce(*exact, *ranges, tail))


def dhcp_os(vendor_class: Column) -> Column:
    """OS of a DHCP vendor class: exact, else first listed prefix."""
    exact = [F.when(vendor_class == k, F.lit(v)) for k, v in fv.DHCP_VENDOR_CLASSES.items()]
    prefix = [F.when(F.startswith(F.lower(vendor_class), F.lit(k.lower())), F.lit(v)) for k, v in fv.DHCP_VENDOR_CLASSES.items()]
    return F.coalesce(*exact, *prefix)


def snmp_model(oid: Column) -> Column:
    """Model of a sysObjectID by the longest listed prefix, whole arcs only."""
    by_length = sorted(fv.SNMP_MODELS.items(), key=lambda kv: -len(kv[0]))
    dotted = F.concat(oid, F.lit("."))
    return F.coalesce(*[F.when(F.startswith(dotted, F.lit(k + ".")), F.lit(v)) for k, v in by_length])


def infrastructure_type(model: Column) -> Column:
    """Device type named by an SNMP model."""
    low = F.lower(model)

    def has(*words):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    return F.when(has("firewall", "asa", "ftd", "fortigate"), "firewall").when(has("router"), "router").when(
        has("switch"), "switch"
    )


# --- facts per address ------------------------------------------------------

def _list(df: DataFrame, col: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast("array<string>")) if col in df.columns else F.array().cast("array<string>")


def ssh_facts(ssh: DataFrame) -> DataFrame:
    """Banner lines per address from both ends of SSH sessions."""
    ends = F.array(
        F.struct(F.col("client_ip").alias("ip"), F.lit("SSH client: ").alias("side"), text.meaningful("ssh_client").alias("banner")),
        F.struct(F.col("server_ip").alias("ip"), F.lit("SSH server: ").alias("side"), text.meaningful("ssh_server").alias("banner")),
    )
    rows = ssh.select(F.inline(ends)).where(F.col("banner").isNotNull() & F.col("ip").isNotNull())
    lines = rows.select("ip", F.concat("side", "banner").alias("line"))
    return sorted_values(lines, ["ip"], "line", "ssh_lines").withColumn(
        "ssh_os", first_match(F.col("ssh_lines"), lambda s: os_from_ssh(F.substring_index(s, ": ", -1)))
    )


def lease_facts(dhcp: DataFrame, dhcp_extended: DataFrame | None = None) -> DataFrame:
    """The latest lease per address: MAC, host name, FQDN, vendor class."""
    last = dhcp.groupBy("ip").agg(F.max(F.struct("last_seen", "mac", "dhcp_hostname")).alias("_l")).select(
        "ip", net.normalize_mac("_l.mac").alias("mac_address"), F.lower(text.meaningful("_l.dhcp_hostname")).alias("dhcp_hostname")
    )
    if dhcp_extended is None:
        return last
    more = dhcp_extended.groupBy("ip").agg(
        F.max(F.lower(text.meaningful("client_fqdn"))).alias("dhcp_client_fqdn"),
        F.max(text.meaningful("vendor_class")).alias("dhcp_vendor_class"),
        F.max(F.upper(text.meaningful("dhcp_domain"))).alias("dhcp_domain"),
    ).withColumn("dhcp_os", dhcp_os(F.col("dhcp_vendor_class")))
    return last.join(more, "ip", "full_outer")


def rdp_facts(rdp: DataFrame) -> DataFrame:
    build = F.col("client_build").cast("string").try_cast("int")
    resolution = F.when(
        text.meaningful("desktop_width").isNotNull() & text.meaningful("desktop_height").isNotNull(),
        F.concat_ws("x", "desktop_width", "desktop_height"),
    )
    return rdp.select(
        "ip", F.upper(text.meaningful("rdp_cookie")).alias("rdp_name"), build.alias("rdp_build"),
        rdp_windows(build).alias("rdp_os"),
        F.struct(
            text.meaningful("rdp_cookie").alias("cookie"), build.alias("client_build"),
            text.meaningful("client_name").alias("client_name"), text.meaningful("keyboard_layout").alias("keyboard_layout"),
            resolution.alias("resolution"), text.meaningful("security_protocol").alias("security_protocol"),
        ).alias("rdp_info"),
    )


def banner_facts(banners: DataFrame, column: str, label: str, rule, out: str) -> DataFrame:
    """Software line and OS hint of a service banner."""
    b = text.meaningful(column)
    return banners.where(b.isNotNull()).select(
        "ip", F.concat(F.lit(label + ": "), b).alias(f"{out}_line"), rule(b).alias(f"{out}_os")
    )


def facts(results: Mapping[str, DataFrame], addresses: DataFrame) -> DataFrame:
    """One row per address of the map with everything the profiles say.

    The map's distinct addresses are the spine and every part is left-joined
    to it: the parts come out of aggregates on ``ip``, so both sides of each
    join are already partitioned by it and the chain adds no shuffles. Parts
    whose log is absent are left out.
    """
    parts = []

    def add(name, make):
        if name in results:
            parts.append(make(results[name]))

    add("snmp", lambda d: d.select(
        "ip", F.when(text.meaningful("community").isNotNull(), F.lit("SNMP-managed device")).alias("snmp_managed"),
        F.concat(F.lit("SNMP "), text.meaningful("snmp_version")).alias("snmp_line")))
    add("snmp_oid", lambda d: d.select("ip", snmp_model(F.col("sys_object_id")).alias("snmp_model")))
    add("software", lambda d: d.select(
        "ip", F.col("software").alias("software_list"),
        F.when(F.exists("sw_types", lambda t: F.contains(t, F.lit("OS"))), F.get("software", F.lit(0))).alias("software_os")))
    add("ssh", ssh_facts)
    add("http_ua", lambda d: d.select(
        "ip", "user_agents", first_match(F.col("user_agents"), os_from_user_agent).alias("agent_os")))
    add("rdp", rdp_facts)
    if "dhcp" in results:
        parts.append(lease_facts(results["dhcp"], results.get("dhcp_extended")))
    add("smtp_banner", lambda d: banner_facts(d, "last_banner", "SMTP", os_from_smtp, "smtp"))
    add("ftp_banner", lambda d: banner_facts(d, "ftp_banner", "FTP", os_from_ftp, "ftp"))
    add("ja3_ssl", lambda d: d.select(
        "ip", F.col("ja3_hashes").alias("ja3_fingerprints"), F.col("sni_names").alias("tls_server_names"),
        F.col("ja3s_hashes").alias("_ja3s_client"), F.col("tls_versions").alias("_tls_client")))
    add("ja3s_server", lambda d: d.select(
        "ip", F.col("ja3s_hashes").alias("_ja3s_server"), F.col("tls_versions").alias("_tls_server"),
        "cert_subjects", "cert_issuers"))
    add("dns_profile", lambda d: d.select(
        "ip", F.struct("query_count", "unique_domains", "nxdomain_ratio",
                       F.col("tlds").alias("top_tlds"), "query_types").alias("dns_profile")))
    add("files", lambda d: d.select("ip", F.col("mime_types").alias("file_mime_types")))
    add("known_services", lambda d: d.select("ip", F.col("service_names").alias("known_services_names")))
    add("tunnel", lambda d: d.select("ip", F.col("tunnel_types").alias("tunnel_info")))
    add("ntp", lambda d: d.select("ip", F.lit(True).alias("ntp_server")))
    add("radius", lambda d: d.select("ip", F.lit(True).alias("radius_server")))
    add("mqtt", lambda d: d.select("ip", F.struct("unique_clients", "actions").alias("mqtt_info")))
    add("modbus", lambda d: d.select("ip", F.col("protocols").alias("ics_protocols")))
    add("notice", lambda d: d.select("ip", F.col("notice_types").alias("notices")))
    add("traceroute", lambda d: d.select("ip", F.col("destinations").alias("traceroute_hops")))
    out = addresses.select("ip").distinct()
    for p in parts:
        out = out.join(p, "ip", "left")
    return out


def profile_names(results: Mapping[str, DataFrame]) -> DataFrame:
    """(ip, kind, name) from SMB, RDP, DHCP and SMTP profiles."""
    parts = []
    if "smb" in results:
        parts.append(results["smb"].select("ip", F.lit("netbios").alias("kind"), F.explode(F.transform("nb_names", lambda x: F.upper(F.trim(x)))).alias("name")))
    if "rdp" in results:
        parts.append(results["rdp"].select("ip", F.lit("netbios").alias("kind"), F.upper(text.meaningful("rdp_cookie")).alias("name")))
    if "dhcp" in results:
        parts.append(results["dhcp"].select("ip", F.lit("hostname").alias("kind"), F.lower(text.meaningful("dhcp_hostname")).alias("name")))
    if "dhcp_extended" in results:
        parts.append(results["dhcp_extended"].select("ip", F.lit("hostname").alias("kind"), F.lower(text.meaningful("client_fqdn")).alias("name")))
    if "smtp_banner" in results:
        parts.append(results["smtp_banner"].select("ip", F.lit("hostname").alias("kind"), F.explode(F.transform("helo_names", lambda x: F.lower(F.trim(x)))).alias("name")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(text.meaningful("name").isNotNull() & F.col("ip").isNotNull()).distinct()


def attach_names(node_table: DataFrame, names: DataFrame) -> DataFrame:
    """Host and NetBIOS names per node (node keys, kind, name) as sorted arrays."""
    out = node_table
    for kind, col in (("hostname", "hostnames"), ("netbios", "netbios_names")):
        lists = sorted_values(names.where(F.col("kind") == kind), NODE, "name", col)
        out = out.join(lists, NODE, "left").withColumn(col, F.coalesce(col, F.array().cast("array<string>")))
    return out


def node_names_from_ip(names: DataFrame, node_table: DataFrame) -> DataFrame:
    """Names known per address, repeated for each node with that address."""
    return names.join(node_table.select(*NODE), "ip").select(*NODE, "kind", "name").distinct()


# Protocol facts that add a role.
PROTOCOL_ROLES = (("tunnel_info", "vpn_endpoint"), ("ntp_server", "ntp_server"), ("radius_server", "radius_server"),
                  ("mqtt_info", "mqtt_broker"), ("ics_protocols", "ics_device"))


def enrich_nodes(node_table: DataFrame, fact_table: DataFrame, oui: DataFrame | None = None) -> DataFrame:
    """Facts onto nodes: software, OS, model, vendor, platform and roles."""
    out = node_table.join(fact_table, "ip", "left")
    have = set(out.columns)

    def c(name, kind="string"):
        return F.col(name) if name in have else F.lit(None).cast(kind)

    def arr(name):
        return _list(out, name)

    lines = F.concat(
        F.array(c("snmp_line")), arr("software_list"), arr("ssh_lines"), F.array(c("smtp_line")), F.array(c("ftp_line"))
    )
    roles = F.concat(
        F.col("roles"),
        *[F.when(F.col(f).isNotNull(), F.array(F.lit(r))).otherwise(F.array().cast("array<string>"))
          for f, r in PROTOCOL_ROLES if f in have],
    )
    out = out.withColumns(
        {
            "software": F.array_distinct(F.filter(lines, lambda s: text.meaningful(s).isNotNull())),
            "os_info": F.coalesce(
                c("software_os"), c("ssh_os"), c("agent_os"), c("rdp_os"), c("dhcp_os"), c("smtp_os"), c("ftp_os"), F.lit("")
            ),
            "device_model": F.coalesce(c("snmp_model"), c("snmp_managed"), F.lit("")),
            "ja3s_fingerprints": F.array_sort(F.array_union(arr("_ja3s_client"), arr("_ja3s_server"))),
            "tls_versions_seen": F.array_sort(F.array_union(arr("_tls_client"), arr("_tls_server"))),
            "roles": F.array_sort(F.array_distinct(roles)),
            "mac_address": F.coalesce(c("mac_address"), F.lit("")),
        }
    )
    out = out.withColumn("virtual_platform", netmap.virtual_platform("mac_address")).withColumn(
        "is_virtual", F.col("virtual_platform") != ""
    )
    out = netmap.vendor_of(out, oui) if oui is not None else out.withColumn("vendor", F.lit(""))
    drop = ["snmp_line", "software_list", "ssh_lines", "smtp_line", "ftp_line", "software_os", "ssh_os", "agent_os",
            "rdp_os", "dhcp_os", "smtp_os", "ftp_os", "snmp_model", "snmp_managed", "_ja3s_client", "_ja3s_server",
            "_tls_client", "_tls_server"]
    return out.drop(*drop)


def attach_domain(node_table: DataFrame, ntlm_domains: DataFrame) -> DataFrame:
    """Domain per node: NTLM first, else the DHCP domain of its address."""
    out = node_table.join(ntlm_domains, NODE, "left")
    fallback = F.col("dhcp_domain") if "dhcp_domain" in out.columns else F.lit(None).cast("string")
    return out.withColumn("domain", F.coalesce("domain", fallback, F.lit("")))


def certificate_matches(names: DataFrame, certificates: DataFrame) -> DataFrame:
    """(node, certificate name, sensor of the certificate): the name equals a
    node name, or its first label does, or a node name contains it.

    ``names``: node keys and name; ``certificates``: cert_sensor, cn.
    """
    names = names.select(*NODE, F.lower("name").alias("name")).distinct()
    certs = certificates.select("cert_sensor", F.lower(F.trim("cn")).alias("cn")).where(text.meaningful("cn").isNotNull()).distinct()
    base = F.substring_index(F.regexp_replace("cn", r"^[*.]+", ""), ".", 1)
    within = substring_matches(names, "name", certs, "cn")
    by_label = certs.select("cn", base.alias("name")).where(F.col("name") != "").distinct()
    pairs = within.unionByName(by_label.select("name", "cn")).distinct()
    return names.join(pairs, "name").join(certs, "cn").select(*NODE, "cn", "cert_sensor").distinct()


def certificate_rows(log: DataFrame) -> DataFrame:
    """(cert_sensor, cn, issuer) of a certificate log, a row per value: names and
    organisations (``O=...``) of issuers stay with the certificate they signed."""
    name, org = (text.meaningful(F.trim(of("certificate_issuer"))) for of in (text.common_name, text.organisation))
    issuers = F.filter(F.array(name, F.concat(F.lit("O="), org)), lambda x: x.isNotNull())
    return log.select(
        F.col("sensor_id").alias("cert_sensor"), text.common_name("certificate_subject").alias("cn"), F.explode_outer(issuers).alias("issuer")
    ).where(text.meaningful("cn").isNotNull()).distinct()


def certificate_issuers(matches: DataFrame, certificates: DataFrame) -> DataFrame:
    """(node, issuer) of the certificates that match a node; ``certificates``
    has cert_sensor, cn and issuer, so issuers come with their own certificate."""
    listed = certificates.where("issuer IS NOT NULL").select("cert_sensor", F.lower(F.trim("cn")).alias("cn"), "issuer").distinct()
    same = matches["cert_sensor"].eqNullSafe(listed["cert_sensor"]) & (matches["cn"] == listed["cn"])
    return matches.join(listed, same).select(*NODE, "issuer").distinct()


def attach_certificates(node_table: DataFrame, matches: DataFrame, issuers: DataFrame | None = None) -> DataFrame:
    """Names and issuers of certificates that match a node join those its own TLS servers showed."""
    out = node_table
    for found, value, column in ((matches, "cn", "cert_subjects"), (issuers, "issuer", "cert_issuers")):
        if found is not None:
            lists = sorted_values(found, NODE, value, "_matched")
            both = F.array_sort(F.array_union(_list(out, column), F.coalesce("_matched", F.array().cast("array<string>"))))
            out = out.join(lists, NODE, "left").withColumn(column, both).drop("_matched")
    return out


# --- device type ------------------------------------------------------------

def device_ports(served: DataFrame) -> DataFrame:
    """Per address: how many ports it serves and which of the ports that any
    rule asks about (a bounded set); ``served``: ip, port."""
    wanted = sorted({p for _, ports, _, _ in fv.DEVICE_PROFILES for p in ports} | set(fv.DOMAIN_CONTROLLER_PORTS))
    return (
        served.select("ip", F.col("port").cast("int").alias("port")).where(F.col("port").isNotNull()).distinct()
        .groupBy("ip")
        .agg(F.count(F.lit(1)).alias("port_count"), F.array_sort(F.collect_set(F.when(F.col("port").isin(*wanted), F.col("port")))).alias("ports"))
    )


def classify(ports: Column, port_count: Column, clients: Column, destinations: Column, outgoing: Column) -> Column:
    """Type by the first matching port profile, else by traffic shape, else ''."""
    rules = []
    for name, required, least, least_clients in fv.DEVICE_PROFILES:
        hits = F.size(F.array_intersect(ports, F.array(*[F.lit(p) for p in required])))
        rules.append(F.when((hits >= least) & (clients >= least_clients), F.lit(name)))
    return F.coalesce(
        *rules,
        F.when((destinations > 20) & (outgoing > clients * 3), F.lit("workstation")),
        F.when((clients > 20) & (port_count == 0), F.lit("gateway")),
        F.when((port_count <= 2) & (clients <= 3) & (destinations <= 5), F.lit("iot_device")),
        F.lit(""),
    )


def kerberos_servers(kerberos: DataFrame, least_auths: int = 3, least_clients: int = 0) -> DataFrame:
    return kerberos.where((F.col("auth_count") >= least_auths) & (F.col("unique_clients") >= least_clients)).select("ip").distinct()


def heavy_ntlm_servers(ntlm: DataFrame, least_clients: int = 5) -> DataFrame:
    rows = ntlm.where((F.coalesce("source_ip", F.lit("")) != "") & (F.coalesce("dest_ip", F.lit("")) != ""))
    return rows.groupBy(F.col("dest_ip").alias("ip")).agg(F.countDistinct("source_ip").alias("_n")).where(
        F.col("_n") >= least_clients
    ).select("ip")


def device_types(
    node_table: DataFrame, served: DataFrame, server: DataFrame, client: DataFrame,
    kdc: DataFrame | None = None, ntlm_servers: DataFrame | None = None, infrastructure: DataFrame | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Type per internal node: domain-controller evidence, then port profiles
    and traffic shape, then infrastructure evidence over generic types, then
    protection of an earlier specific type (node keys, device_type)."""
    out = node_table.drop("device_type").where("is_internal")
    out = out.join(device_ports(served), "ip", "left")
    out = out.join(server.select("ip", "unique_clients"), "ip", "left").join(
        client.select("ip", "unique_destinations", "outgoing_count"), "ip", "left"
    )
    out = out.na.fill(0, ["port_count", "unique_clients", "unique_destinations", "outgoing_count"])
    ports = F.coalesce("ports", F.array().cast("array<int>"))
    found = classify(ports, F.col("port_count"), F.col("unique_clients"), F.col("unique_destinations"), F.col("outgoing_count"))
    for frame, flag in ((kdc, "_kdc"), (ntlm_servers, "_ntlm")):
        out = out.join(frame.select("ip", F.lit(True).alias(flag)), "ip", "left") if frame is not None else out.withColumn(flag, F.lit(None).cast("boolean"))
    dc_ports = F.arrays_overlap(ports, F.array(*[F.lit(p) for p in fv.DOMAIN_CONTROLLER_PORTS]))
    found = F.when(F.col("_kdc") | (F.col("_ntlm") & dc_ports), F.lit("domain_controller")).otherwise(found)
    out = out.withColumn("_type", found)
    if infrastructure is not None:
        out = out.join(infrastructure.select("ip", "infra_points", "infra_type"), "ip", "left")
        generic = F.col("_type").isin("", "gateway", "iot_device")
        out = out.withColumn(
            "_type", F.when(generic & (F.col("infra_points") >= 2) & F.col("infra_type").isNotNull(), F.col("infra_type")).otherwise(F.col("_type"))
        ).drop("infra_points", "infra_type")
    if previous is not None:
        out = out.join(previous.select(*NODE, F.col("device_type").alias("_old")), NODE, "left")
        keep = (F.col("_type") == "") | (F.col("_old").isin(*fv.SPECIFIC_TYPES) & F.col("_type").isin(*fv.FALLBACK_TYPES))
        out = out.withColumn("_type", F.when(keep & F.col("_old").isNotNull(), F.col("_old")).otherwise(F.col("_type"))).drop("_old")
    return out.withColumnRenamed("_type", "device_type").drop("_kdc", "_ntlm")


def type_label(device_type: str = "device_type") -> Column:
    return F.coalesce(*[F.when(F.col(device_type) == t, F.lit(label)) for t, (label, _) in fv.DEVICE_LABELS.items()], F.lit(""))


def type_tier(device_type: str = "device_type", internal: str = "is_internal") -> Column:
    """Diagram tier: 0 outside, 1 edge, 2 core services, 3 servers, 4 end devices."""
    known = [F.when(F.col(device_type) == t, F.lit(tier)) for t, (_, tier) in fv.DEVICE_LABELS.items()]
    return F.when(~F.col(internal), F.lit(0)).otherwise(F.coalesce(*known, F.lit(3)))


# --- host identity ----------------------------------------------------------

def _has(low: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def _software_os(entry: Column):
    """(os, confidence) of a software line, else null."""
    low = F.lower(entry)
    first = F.substring(F.substring_index(entry, ",", 1), 1, 60)

    def found(os, conf):
        return F.struct(os.alias("os"), F.lit(conf).alias("conf"))

    return (
        F.when(_has(low, "windows 10", "windows 11"), found(first, 90))
        .when(_has(low, "windows"), found(F.lit("Windows"), 85))
        .when(_has(low, "ubuntu", "debian", "centos", "rhel", "fedora"), found(first, 90))
        .when(_has(low, "macos", "darwin"), found(F.lit("macOS"), 85))
    )


def _agent_os(agent: Column) -> Column:
    """UA candidate; a bare 'windows' gives none here, plain Linux weighs less."""
    hints = [h for h in AGENT_HINTS if h[0] != "windows"]
    name = hinted(agent, hints, {"linux": "android"})
    return F.when(
        name.isNotNull(), F.struct(name.alias("os"), F.when(name == "Linux", 60).otherwise(65).alias("conf"))
    )


def host_identity(node_table: DataFrame) -> DataFrame:
    """Best OS candidate, its source and confidence, overall confidence and all
    signals per internal node with at least one signal."""
    have = set(node_table.columns)

    def c(name):
        return F.col(name) if name in have else F.lit(None).cast("string")

    def arr(name):
        return _list(node_table, name)

    def signal(source, value):
        return F.when(value.isNotNull(), F.struct(F.lit(source).alias("source"), value.alias("value")))

    def some(value):
        return F.when(F.coalesce(value, F.lit("")) != "", value)

    def joined(name):
        return F.when(F.size(arr(name)) > 0, F.array_join(arr(name), ", "))

    vclass, os_info = some(c("dhcp_vendor_class")), some(c("os_info"))
    software = arr("software")
    known = F.transform(software, _software_os)
    at = F.array_position(F.transform(known, lambda k: k.isNotNull()), True)
    scanned = F.when(at > 0, F.slice(software, F.lit(1), F.greatest(at, F.lit(1)).cast("int"))).otherwise(software)
    software_signals = F.transform(
        F.filter(scanned, lambda s: _software_os(s).isNotNull() | _has(F.lower(s), "ssh server:", "ssh client:", "smtp:", "ftp:")),
        lambda s: F.struct(F.lit("Software").alias("source"), s.alias("value")),
    )

    def banners(*prefixes):
        def starts(s):
            out = F.lit(False)
            for p in prefixes:
                out = out | F.startswith(s, F.lit(p))
            return out

        return F.transform(F.filter(software, starts), lambda s: F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))))

    ssh = banners("SSH server:", "SSH client:")
    agent = F.get(arr("user_agents"), F.lit(0))
    build = F.col("rdp_build") if "rdp_build" in have else F.lit(None).cast("int")
    low = F.lower(vclass)
    lease_os = (
        F.when(_has(low, "msft", "microsoft"), F.struct(F.lit("Windows").alias("os"), F.lit(90).alias("conf")))
        .when(_has(low, "android"), F.struct(F.lit("Android").alias("os"), F.lit(85).alias("conf")))
        .when(_has(low, "linux"), F.struct(F.lit("Linux").alias("os"), F.lit(80).alias("conf")))
        .when(_has(low, "apple", "darwin"), F.struct(F.lit("macOS/iOS").alias("os"), F.lit(85).alias("conf")))
    )
    ssh_os = first_match(ssh, lambda b: hinted(b, (("ubuntu", "Ubuntu Linux"), ("debian", "Debian Linux"), ("windows", "Windows"))))
    found = (
        ("DHCP Vendor Class", lease_os),
        ("Software", F.get(F.filter(known, lambda k: k.isNotNull()), F.lit(0))),
        ("OS Detection", F.when(os_info.isNotNull(), F.struct(os_info.alias("os"), F.lit(80).alias("conf")))),
        ("SSH Banner", F.when(ssh_os.isNotNull(), F.struct(ssh_os.alias("os"), F.lit(75).alias("conf")))),
        ("HTTP User-Agent", _agent_os(agent)),
        ("RDP Build", F.when(build.isNotNull(), F.struct(rdp_windows(build).alias("os"), F.lit(92).alias("conf")))),
    )
    candidates = F.filter(
        F.array(
            *[
                F.when(cand.isNotNull(), F.struct(cand.getField("conf").alias("conf"), F.lit(-i).alias("ord"),
                                                  cand.getField("os").alias("os"), F.lit(source).alias("source")))
                for i, (source, cand) in enumerate(found)
            ]
        ),
        lambda x: x.isNotNull(),
    )
    single = F.array(signal("DHCP Vendor Class", vclass))
    rest = F.array(
        signal("OS Detection", os_info),
        signal("SSH Banner", F.get(ssh, F.lit(0))),
        signal("HTTP User-Agent", agent),
        signal("RDP Build", F.concat(F.lit("Build "), build.cast("string"))),
        signal("DHCP FQDN", some(c("dhcp_client_fqdn"))),
        signal("SMTP Banner", F.get(banners("SMTP:"), F.lit(0))),
        signal("FTP Banner", F.get(banners("FTP:"), F.lit(0))),
        signal("Known Services", joined("known_services_names")),
        signal("TLS SNI", joined("tls_server_names")),
        signal("JA3 Client", joined("ja3_fingerprints")),
        signal("TLS Certificate", joined("cert_subjects")),
        signal("MAC Vendor", some(c("vendor"))),
    )
    signals = F.filter(F.concat(single, software_signals, rest), lambda s: s.isNotNull())
    best, n = F.array_max("_candidates"), F.col("signal_count")
    out = (
        node_table.where("is_internal")
        .withColumns({"_signals": signals, "_candidates": candidates})
        .withColumn("signal_count", F.size("_signals"))
        .where(n > 0)
        .withColumn("_best", best)
    )
    confidence = F.when(
        F.col("_best").isNotNull(), F.least(F.col("_best.conf") + n * 3, F.lit(100))
    ).otherwise(F.least(n * 12, F.lit(60)))
    return out.select(
        *NODE, F.coalesce("_best.os", F.lit("Unknown")).alias("os"), F.coalesce("_best.source", F.lit("")).alias("os_source"),
        F.coalesce("_best.conf", F.lit(0)).alias("os_confidence"), confidence.alias("confidence"), "signal_count",
        F.col("_signals").alias("signals"),
    )


def identity_display(identity: DataFrame, signals: int = 15, width: int = 80) -> DataFrame:
    """For a report: the first signals, their values cut to a width."""
    short = F.transform(F.slice("signals", 1, signals), lambda s: F.struct(s["source"].alias("source"), F.substring(s["value"], 1, width).alias("value")))
    return identity.withColumn("signals", short)


def merge_enrichment(stored: DataFrame, enriched: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Enriched fields over stored ones where they say something; nodes the
    stored map lacks come back with their enriched row."""
    cols = stored.columns
    e = enriched.select(*NODE, *[F.col(c).alias(f"_e_{c}") for c in cols if c in enriched.columns and c not in NODE], F.lit(True).alias("_has"))
    both = stored.withColumn("_stored", F.lit(True)).join(e, NODE, "full_outer")

    def says(name):
        col, kind = F.col(f"_e_{name}"), enriched.schema[name].dataType.typeName()
        if kind in ("array", "map"):
            return F.coalesce(F.size(col) > 0, F.lit(False))
        if kind == "string":
            return F.coalesce(col != "", F.lit(False))
        if kind == "boolean":
            return F.coalesce(col, F.lit(False))
        return col.isNotNull()

    picked = []
    for name in cols:
        if name in NODE or name not in enriched.columns:
            picked.append(F.col(name))
        elif name in fields:
            picked.append(F.when(F.col("_stored").isNull() | says(name), F.col(f"_e_{name}")).otherwise(F.col(name)).alias(name))
        else:
            picked.append(F.when(F.col("_stored").isNull(), F.col(f"_e_{name}")).otherwise(F.col(name)).alias(name))
    return both.select(*picked)


def unprofiled(node_table: DataFrame, profiled: DataFrame) -> DataFrame:
    """Internal nodes without a profile yet."""
    return node_table.where("is_internal").join(profiled.select(*NODE).distinct(), NODE, "left_anti")


def single_device(results: Mapping[str, DataFrame], ip: str) -> dict[str, DataFrame]:
    """Profile rows of one address, under either end of two-ended profiles."""
    out = {}
    for name, df in results.items():
        ends = [c for c in ("ip", "client_ip", "server_ip", "source_ip", "dest_ip", "gateway_ip") if c in df.columns]
        if ends:
            test = F.lit(False)
            for c in ends:
                test = test | (F.col(c) == ip)
            out[name] = df.where(test)
    return out
