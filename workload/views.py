"""The given tables read as network telemetry.

Each view exists twice: as DataFrame calls for the Spark side and as SQL text
for the check. ``with_views`` prefixes a query with the views it needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Destination port by order key modulo 12.
PORTS = (80, 443, 53, 22, 445, 139, 3389, 5985, 135, 4444, 8080, 3333)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _s(col) -> F.Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def connections(spark, sf) -> DataFrame:
    return connections_with(spark, sf)


def connections_with(spark, sf, *more) -> DataFrame:
    """The connection view with further lineitem columns."""
    sup, part, order = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_orderkey")
    port = F.element_at(F.array(*[F.lit(p) for p in PORTS]), (order % 12 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        F.when(sup % 10 < 8, F.concat(F.lit("10.0."), _s(sup % 4), F.lit("."), _s(sup % 50 + 1)))
        .otherwise(F.concat(F.lit("198.51.100."), _s(sup % 50 + 1))).alias("source_ip"),
        F.when(part % 3 == 0, F.concat(F.lit("203.0.113."), _s(part % 40 + 1)))
        .otherwise(F.concat(F.lit("10.0."), _s(part % 5), F.lit("."), _s(part % 60 + 1))).alias("destination_ip"),
        (F.lit(1024) + order % 50000).cast("int").alias("source_port"),
        port.alias("destination_port"),
        F.when(order % 12 == 2, "udp").otherwise("tcp").alias("protocol"),
        F.floor(F.col("l_quantity") * 100).cast("bigint").alias("bytes_in"),
        F.floor(F.col("l_extendedprice") * 10).cast("bigint").alias("bytes_out"),
        F.when(F.col("l_returnflag") == "R", "REJ").when(F.col("l_returnflag") == "A", "S0").otherwise("SF")
        .alias("conn_state"),
        F.concat(F.lit("sensor"), _s(F.col("l_linenumber") % 3)).alias("sensor_id"),
        _s(F.col("l_linenumber") % 2).alias("vlan"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        *more,
    )


def dns(spark, sf) -> DataFrame:
    return dns_of(table(spark, sf, "events"))


def dns_of(events: DataFrame) -> DataFrame:
    """The DNS view over any subset of the events table."""
    eid, uid = F.col("event_id"), F.col("user_id")
    digest = F.md5(_s(eid))
    return events.select(
        F.concat(F.lit("10.0."), _s(uid % 4), F.lit("."), _s(uid % 50 + 1)).alias("source_ip"),
        F.when(eid % 4 == 0, F.concat(F.translate(F.substring(digest, 1, 14), "012345", "bcdfgh"), F.lit(".com")))
        .when(eid % 4 == 1, F.concat(digest, F.lit(".tun"), _s(uid % 5), F.lit(".net")))
        .when(eid % 4 == 2, F.concat(F.lit("www.site"), _s(uid % 20), F.lit(".org")))
        .otherwise(F.concat(F.lit("p"), _s(uid % 3), F.lit(".pool.example"))).alias("domain"),
        F.when(F.col("event_type") == "error", "NXDOMAIN").otherwise("NOERROR").alias("response_code"),
        F.concat(F.lit("10.0."), _s(eid % 5), F.lit("."), _s(eid % 60 + 1)).alias("answer"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def beacon(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("10.0.0."), _s("user_id")).alias("source_ip"),
        F.concat(F.lit("203.0.113."), _s(F.length("event_type"))).alias("destination_ip"),
        F.lit(443).alias("destination_port"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def ntlm(spark, sf) -> DataFrame:
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("10.0."), _s(cust % 4), F.lit("."), _s(cust % 50 + 1)).alias("source_ip"),
        F.concat(F.lit("10.0.4."), _s(order % 12 + 1)).alias("dest_ip"),
        F.concat(F.lit("WS-"), _s(cust % 30)).alias("hostname"),
        F.concat(F.lit("corp"), _s(cust % 2)).alias("domainname"),
        F.concat(F.lit("srv-"), _s(order % 12)).alias("server_nb_computer_name"),
        F.concat(F.lit("SRV-"), _s(order % 12), F.lit(".corp.example")).alias("server_dns_computer_name"),
        F.concat(F.lit("sensor"), _s(order % 3)).alias("sensor_id"),
        F.lit("0").alias("vlan"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )


def http(spark, sf) -> DataFrame:
    uid, eid = F.col("user_id"), F.col("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("10.0.0."), _s(uid)).alias("source_ip"),
        F.concat(F.lit("203.0.113."), _s(eid % 9 + 1)).alias("destination_ip"),
        F.when(F.col("event_type") == "purchase", "POST").when(F.col("event_type") == "signup", "PUT")
        .otherwise("GET").alias("method"),
        F.lit("/u").alias("uri"),
        F.when(eid % 5 == 0, "www.dropbox.com").when(eid % 5 == 1, "drive.google.com")
        .when(eid % 5 == 2, "mega.nz").otherwise("intranet.local").alias("host"),
        F.when(uid % 4 == 0, F.concat(F.lit("Mozilla/5.0 (Windows NT 10.0) b"), _s(eid % 7)))
        .when(uid % 4 == 1, "Mozilla/5.0 (Macintosh; Mac OS X)").when(uid % 4 == 2, "curl/8 linux")
        .otherwise("-").alias("user_agent"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def verdicts(spark, sf) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf, "labels").select(
        doc.alias("case_no"),
        F.when(doc % 5 == 0, "T1071").when(doc % 5 == 1, "T1046").when(doc % 5 == 2, "T1041")
        .when(doc % 5 == 3, "T1021.002").otherwise("T1496").alias("technique_id"),
        F.when(F.col("quality") == 1, "tp").when(F.col("toxic") == 1, "fp").otherwise("uncertain").alias("verdict"),
        ((doc % 100) / 100.0).alias("confidence"),
    )


# Techniques and families of derived findings and cases.
TECHS = ("T1071", "T1046", "T1041", "T1021.002", "T1496")
AGENT_NAMES = ("c2_hunter", "reconnaissance_hunter", "lateral_movement_hunter", "collection_exfiltration_hunter", "impact_hunter")
SEVERITIES = ("low", "medium", "high", "critical")


def _pick(values, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (index + 1).cast("int"))


def findings(spark, sf) -> DataFrame:
    """Findings from events: family, severity, techniques, two addresses."""
    eid, uid = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        F.substring(F.md5(_s(eid % 4000)), 1, 16).alias("fingerprint"),
        _pick(AGENT_NAMES, uid % 5).alias("agent"),
        F.concat(F.lit("activity"), _s(uid % 7)).alias("activity_type"),
        _pick(SEVERITIES, eid % 4).alias("severity"),
        ((eid % 97) / 100.0).alias("confidence"),
        F.array(_pick(TECHS, uid % 5), _pick(TECHS, eid % 5)).alias("mitre_techniques"),
        F.array(F.concat(F.lit("10.0.0."), _s(uid)), F.concat(F.lit("203.0.113."), _s(eid % 200), F.lit(":443"))).alias("indicators"),
        F.array(F.concat(F.lit("10.0.0."), _s(uid))).alias("affected_assets"),
        F.col("event_type").alias("description"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def cases(spark, sf) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    conf = (cust % 100) / 100.0
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("c"), _s(key)).alias("case_id"),
        F.concat(F.lit("Case "), _s(key)).alias("title"),
        F.col("o_orderpriority").alias("description"),
        F.when(status == "F", "confirmed_tp").when(status == "O", "new").otherwise("investigating").alias("status"),
        _pick(SEVERITIES, key % 4).alias("severity"),
        conf.alias("confidence"),
        F.when(conf >= 0.95, "auto_respond").when(conf >= 0.8, "auto_investigate").when(conf >= 0.6, "human_review")
        .otherwise("log_only").alias("escalation_level"),
        F.when(status == "F", "tp").when(key % 7 == 0, "fp").alias("analyst_verdict"),
        F.when(key % 2 == 0, "autonomous").otherwise("manual").alias("source"),
        F.array(_pick(TECHS, cust % 5), _pick(TECHS, key % 3)).alias("mitre_techniques"),
        _s(key % 500).alias("external_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def case_assets(spark, sf) -> DataFrame:
    sup = F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), _s("l_orderkey")).alias("case_id"),
        F.concat(F.lit("10.0."), _s(sup % 4), F.lit("."), _s(sup % 50)).alias("asset"),
    ).distinct()


_PORT_CASE = " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(PORTS[:-1])) + f" ELSE {PORTS[-1]}"

VIEW_SQL: dict[str, str] = {
    "v_conn": f"""
SELECT CASE WHEN l_suppkey % 10 < 8 THEN '10.0.' || (l_suppkey % 4) || '.' || (l_suppkey % 50 + 1)
            ELSE '198.51.100.' || (l_suppkey % 50 + 1) END AS source_ip,
       CASE WHEN l_partkey % 3 = 0 THEN '203.0.113.' || (l_partkey % 40 + 1)
            ELSE '10.0.' || (l_partkey % 5) || '.' || (l_partkey % 60 + 1) END AS destination_ip,
       CAST(1024 + l_orderkey % 50000 AS INT) AS source_port,
       CASE l_orderkey % 12 {_PORT_CASE} END AS destination_port,
       CASE WHEN l_orderkey % 12 = 2 THEN 'udp' ELSE 'tcp' END AS protocol,
       CAST(floor(l_quantity * 100) AS BIGINT) AS bytes_in,
       CAST(floor(l_extendedprice * 10) AS BIGINT) AS bytes_out,
       CASE l_returnflag WHEN 'R' THEN 'REJ' WHEN 'A' THEN 'S0' ELSE 'SF' END AS conn_state,
       'sensor' || (l_linenumber % 3) AS sensor_id, CAST(l_linenumber % 2 AS VARCHAR) AS vlan,
       l_shipdate AS ts
FROM lineitem""",
    "v_conn_int": """
SELECT *, regexp_matches(source_ip, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS src_int,
       regexp_matches(destination_ip, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') AS dst_int
FROM v_conn""",
    "v_dns": """
SELECT '10.0.' || (user_id % 4) || '.' || (user_id % 50 + 1) AS source_ip,
       CASE event_id % 4
         WHEN 0 THEN translate(substr(md5(CAST(event_id AS VARCHAR)), 1, 14), '012345', 'bcdfgh') || '.com'
         WHEN 1 THEN md5(CAST(event_id AS VARCHAR)) || '.tun' || (user_id % 5) || '.net'
         WHEN 2 THEN 'www.site' || (user_id % 20) || '.org'
         ELSE 'p' || (user_id % 3) || '.pool.example' END AS domain,
       CASE WHEN event_type = 'error' THEN 'NXDOMAIN' ELSE 'NOERROR' END AS response_code,
       '10.0.' || (event_id % 5) || '.' || (event_id % 60 + 1) AS answer,
       event_id AS ord, ts
FROM events""",
    "v_subs": """
SELECT source_ip, array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') AS parent_domain,
       array_to_string(list_slice(string_split(domain, '.'), 1, len(string_split(domain, '.')) - 2), '.') AS subdomain,
       domain, ts
FROM v_dns WHERE len(string_split(domain, '.')) >= 3""",
    "v_beacon": """
SELECT '10.0.0.' || user_id AS source_ip, '203.0.113.' || length(event_type) AS destination_ip,
       443 AS destination_port, ts FROM events""",
    "v_ntlm": """
SELECT '10.0.' || (o_custkey % 4) || '.' || (o_custkey % 50 + 1) AS source_ip,
       '10.0.4.' || (o_orderkey % 12 + 1) AS dest_ip, 'WS-' || (o_custkey % 30) AS hostname,
       'corp' || (o_custkey % 2) AS domainname, 'srv-' || (o_orderkey % 12) AS server_nb_computer_name,
       'SRV-' || (o_orderkey % 12) || '.corp.example' AS server_dns_computer_name,
       'sensor' || (o_orderkey % 3) AS sensor_id, '0' AS vlan, o_orderdate AS ts
FROM orders""",
    "v_http": """
SELECT '10.0.0.' || user_id AS source_ip, '203.0.113.' || (event_id % 9 + 1) AS destination_ip,
       CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END AS method,
       '/u' AS uri,
       CASE event_id % 5 WHEN 0 THEN 'www.dropbox.com' WHEN 1 THEN 'drive.google.com'
            WHEN 2 THEN 'mega.nz' ELSE 'intranet.local' END AS host,
       CASE user_id % 4 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) b' || (event_id % 7)
            WHEN 1 THEN 'Mozilla/5.0 (Macintosh; Mac OS X)' WHEN 2 THEN 'curl/8 linux' ELSE '-' END AS user_agent,
       ts
FROM events""",
    "v_verdict": """
SELECT doc_id AS case_no,
       CASE doc_id % 5 WHEN 0 THEN 'T1071' WHEN 1 THEN 'T1046' WHEN 2 THEN 'T1041'
            WHEN 3 THEN 'T1021.002' ELSE 'T1496' END AS technique_id,
       CASE WHEN quality = 1 THEN 'tp' WHEN toxic = 1 THEN 'fp' ELSE 'uncertain' END AS verdict,
       (doc_id % 100) / 100.0 AS confidence
FROM labels""",
}

def _case(index: str, values) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(values)) + " END"


VIEW_SQL["v_finding"] = f"""
SELECT substr(md5(CAST(event_id % 4000 AS VARCHAR)), 1, 16) AS fingerprint, {_case('user_id % 5', AGENT_NAMES)} AS agent,
  'activity' || (user_id % 7) AS activity_type, {_case('event_id % 4', SEVERITIES)} AS severity, event_id % 4 AS sev,
  (event_id % 97) / 100.0 AS confidence, {_case('user_id % 5', TECHS)} AS t1, {_case('event_id % 5', TECHS)} AS t2,
  '10.0.0.' || user_id AS asset, '203.0.113.' || (event_id % 200) AS peer, event_type AS description, ts
FROM events"""
VIEW_SQL["v_case"] = f"""
SELECT 'c' || o_orderkey AS case_id, 'Case ' || o_orderkey AS title, o_orderpriority AS description,
  CASE o_orderstatus WHEN 'F' THEN 'confirmed_tp' WHEN 'O' THEN 'new' ELSE 'investigating' END AS status,
  {_case('o_orderkey % 4', SEVERITIES)} AS severity, (o_custkey % 100) / 100.0 AS confidence,
  CASE WHEN o_custkey % 100 >= 95 THEN 'auto_respond' WHEN o_custkey % 100 >= 80 THEN 'auto_investigate'
       WHEN o_custkey % 100 >= 60 THEN 'human_review' ELSE 'log_only' END AS escalation_level,
  CASE WHEN o_orderstatus = 'F' THEN 'tp' WHEN o_orderkey % 7 = 0 THEN 'fp' END AS analyst_verdict,
  CASE WHEN o_orderkey % 2 = 0 THEN 'autonomous' ELSE 'manual' END AS source,
  {_case('o_custkey % 5', TECHS)} AS t1, {_case('o_orderkey % 3', TECHS)} AS t2,
  CAST(o_orderkey % 500 AS VARCHAR) AS external_id, o_orderdate AS created_at
FROM orders"""
VIEW_SQL["v_case_asset"] = """
SELECT DISTINCT 'c' || l_orderkey AS case_id, '10.0.' || (l_suppkey % 4) || '.' || (l_suppkey % 50) AS asset FROM lineitem"""

_NEEDS = {"v_conn_int": ("v_conn",), "v_subs": ("v_dns",)}


def with_views(sql: str, *views: str) -> str:
    """Prefix a query with the view definitions it names, dependencies first."""
    order: list[str] = []

    def add(name):
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    heads = ", ".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in order)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


def double_literals(sql: str) -> str:
    """Write decimal literals outside quotes as doubles, Spark-side arithmetic."""
    parts = sql.split("'")
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", parts[i])
    return "'".join(parts)


class Registry:
    """Collects queries and their SQL by name."""

    def __init__(self):
        self.queries = {}
        self.sql = {}

    def add(self, name: str, sql: str | None = None, views: tuple[str, ...] = ()):
        def keep(fn):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = double_literals(with_views(sql, *views) if views else sql.strip())
            return fn

        return keep


def out(df: DataFrame, *cols) -> DataFrame:
    """Select columns for comparison: doubles to 6 digits, counts as bigint,
    arrays as comma-joined text."""
    picked = df.select(*cols) if cols else df
    shaped = []
    for f in picked.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("integer", "short", "byte", "long"):
            c = c.cast("bigint")
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.unix_micros(c.cast("timestamp"))
        shaped.append(c.alias(f.name))
    return picked.select(*shaped)


#: Tactic pairs in progression, and the families with their place and tactics, as SQL.
_PROGRESSION = "('TA0043>TA0001','TA0043>TA0042','TA0001>TA0002','TA0001>TA0011','TA0002>TA0003','TA0002>TA0006','TA0002>TA0008','TA0003>TA0006','TA0003>TA0008','TA0006>TA0008','TA0006>TA0004','TA0008>TA0009','TA0008>TA0010','TA0009>TA0010')"
FAMILIES = """fam(agent, place, tactics) AS (VALUES ('reconnaissance_hunter', 1, ['TA0043', 'TA0007']), ('lateral_movement_hunter', 2, ['TA0008']),
  ('collection_exfiltration_hunter', 3, ['TA0009', 'TA0010']), ('c2_hunter', 4, ['TA0011']), ('impact_hunter', 5, ['TA0040']))"""


def chain_sql(outputs: str, key: str, first: str = "") -> str:
    """Tables ``fam`` and ``mult`` (key, chain, x): tactics of the families in ``outputs`` per key, and the multiplier."""
    return f"""{FAMILIES},
 mult AS (SELECT {key}, chain, CASE WHEN len(chain) >= 2 AND len(list_filter(range(1, len(chain)), lambda i: chain[i] || '>' || chain[i + 1] NOT IN {_PROGRESSION})) = 0
    THEN 1.5 ELSE 1.0 END AS x FROM (SELECT {key}, flatten(list(tactics ORDER BY {first} place)) AS chain FROM {outputs} JOIN fam USING (agent) GROUP BY 1))"""
