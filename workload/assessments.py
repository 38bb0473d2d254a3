"""Correlation, context, selection, cases, learning, intel, vectors, rules and
reports over findings, cases and verdicts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquarry.operators import cases as cs
from netquarry.operators import context as cx
from netquarry.operators import correlate, intel, learning, reports, rollup, selection, sigma, vector_index, vectors
from netquarry.operators.common import first_listed_match
from netquarry.session import stage
from workload import views as v
from workload.views import Registry, out

R = Registry()

AS_OF = "2001-01-01 00:00:00"


# --- findings and correlation --------------------------------------------------

_OUTPUTS = """
 o AS (SELECT date_trunc('day', ts) AS w, agent, max(confidence) AS c, count(*) AS n FROM v_finding GROUP BY 1, 2),
 tt AS (SELECT DISTINCT date_trunc('day', ts) AS w, agent, unnest([t1, t2]) AS t FROM v_finding),
 oth AS (SELECT w, agent, count(*) OVER (PARTITION BY w, t) - 1 AS k FROM tt),
 cor AS (SELECT w, agent, CAST(sum(k) AS BIGINT) AS corr FROM oth GROUP BY 1, 2),
 b AS (SELECT o.*, corr, 1.0 + 0.2 * least(corr, 3) AS boost, least(c * (1.0 + 0.2 * least(corr, 3)), 1.0) AS boosted FROM o JOIN cor USING (w, agent))"""


def _outputs(spark, sf):
    f = v.findings(spark, sf).withColumn("window_start", F.window("created_at", "1 day").getField("start"))
    return rollup.agent_rollup(f, ("window_start",))


_W = "CAST(epoch(w) AS BIGINT) AS window_start"


@R.add("corroboration", f"WITH {_OUTPUTS.strip()} SELECT {_W}, agent, corr AS corroborations, round(boost, 6) AS boost, round(boosted, 6) AS boosted FROM b", ("v_finding",))
def _(spark, sf):
    c = correlate.corroborate(correlate.drop_empty(_outputs(spark, sf)), ("window_start",))
    return out(c.select(F.unix_seconds("window_start").alias("window_start"), "agent", "corroborations",
                        F.col("corroboration_boost").alias("boost"), F.col("boosted_confidence").alias("boosted")))


_PROG = "('TA0043','TA0001'),('TA0043','TA0042'),('TA0001','TA0002'),('TA0001','TA0011'),('TA0002','TA0003'),('TA0002','TA0006'),('TA0002','TA0008'),('TA0003','TA0006'),('TA0003','TA0008'),('TA0006','TA0008'),('TA0006','TA0004'),('TA0008','TA0009'),('TA0008','TA0010'),('TA0009','TA0010')"


@R.add("kill_chain_progression", f"""
WITH s AS (SELECT user_id, ['TA0001', 'TA0002', 'TA0008', 'TA0009', 'TA0010', 'TA0043'][1 + CAST(event_id % 6 AS INT)] AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 p AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY k) AS nx, k FROM s WHERE k <= 3)
SELECT user_id, count(*) >= 2 AND bool_and(nx IS NULL OR (t, nx) IN ({_PROG})) AS progression FROM p GROUP BY 1""")
def _(spark, sf):
    from netquarry.operators.common import top_rows
    tactic = F.element_at(F.array(*[F.lit(t) for t in ("TA0001", "TA0002", "TA0008", "TA0009", "TA0010", "TA0043")]), (F.col("event_id") % 6 + 1).cast("int"))
    e = v.table(spark, sf, "events").select("user_id", "ts", "event_id", tactic.alias("t"))
    first = top_rows(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], 3)
    chains = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x.getField("t")).alias("chain"))
    return chains.select("user_id", correlate.is_progression(F.col("chain")).alias("progression"))


@R.add("kill_chain_multiplier", f"""
WITH {_OUTPUTS.strip()}, {v.chain_sql('o', 'w')}
SELECT CAST(epoch(b.w) AS BIGINT) AS window_start, agent, round(least(boosted * x, 1.0), 6) AS chain_confidence
FROM b JOIN mult ON mult.w = b.w""", ("v_finding",))
def _(spark, sf):
    k = correlate.kill_chain(correlate.corroborate(_outputs(spark, sf), ("window_start",)), ("window_start",))
    return out(k.select(F.unix_seconds("window_start").alias("window_start"), "agent", "chain_confidence"))


_SMALL = "time_bucket(INTERVAL 10 MINUTE, ts)"
_SMALL_OUTPUTS = _OUTPUTS.replace("date_trunc('day', ts)", _SMALL).strip()
PRIORITY = {"collection_exfiltration_hunter": 0.4, "impact_hunter": 0.9}


def _small_outputs(spark, sf):
    f = v.findings(spark, sf).withColumn("window_start", F.window("created_at", "10 minutes").getField("start"))
    return rollup.agent_rollup(f, ("window_start",))


def _small_sql(first):
    """Windows of few families: the multiplier and the level of alert differ from window to window."""
    return f"""
WITH {_SMALL_OUTPUTS}, {v.chain_sql('o', 'w', first)},
 x AS (SELECT b.w, b.agent, least(boosted * mult.x, 1.0) AS adj, array_to_string(chain, ',') AS chain FROM b JOIN mult ON mult.w = b.w),
 f AS (SELECT w, CASE WHEN count(*) FILTER (adj > 0.7) >= 2 THEN least(max(adj) * 1.1, 1.0) ELSE max(adj) END AS fc, count(*) AS agent_count, min(chain) AS chain FROM x GROUP BY 1)
SELECT CAST(epoch(w) AS BIGINT) AS window_start, chain, round(fc, 6) AS final_confidence, agent_count,
  CASE WHEN fc >= 0.9 THEN 'critical' WHEN fc >= 0.7 THEN 'high' WHEN fc >= 0.5 THEN 'medium' ELSE 'low' END AS alert_level FROM f"""


def _small_assessments(outputs):
    keys = ("window_start",)
    chain = correlate.kill_chain(correlate.corroborate(correlate.drop_empty(outputs), keys), keys)
    chains = chain.groupBy(*keys).agg(F.min(F.array_join("tactic_chain", ",")).alias("chain"))
    a = correlate.assess(outputs, keys).join(chains, "window_start")
    return out(a.select(F.unix_seconds("window_start").alias("window_start"), "chain", "final_confidence", "agent_count", "alert_level"))


@R.add("kill_chain_assessments", _small_sql(""), ("v_finding",))
def _(spark, sf):
    return _small_assessments(_small_outputs(spark, sf))


@R.add("kill_chain_by_priority", _small_sql("CASE agent WHEN 'impact_hunter' THEN -0.9 WHEN 'collection_exfiltration_hunter' THEN -0.4 ELSE 0 END,"), ("v_finding",))
def _(spark, sf):
    """Families that a selection ranked higher come first in the chain."""
    weight = F.coalesce(*[F.when(F.col("agent") == a, F.lit(p)) for a, p in PRIORITY.items()], F.lit(0.0))
    return _small_assessments(_small_outputs(spark, sf).withColumn("priority", weight))


@R.add("false_positive_dampening", f"""
WITH {_OUTPUTS.strip()}, r AS (SELECT ['collection_exfiltration_hunter','c2_hunter','impact_hunter','lateral_movement_hunter','reconnaissance_hunter'][1 + CAST(doc_id % 5 AS INT)] AS agent,
   count(*) FILTER (quality <> 1) / count(*) AS fp FROM labels GROUP BY 1)
SELECT {_W}, agent, round(1.0 - 0.5 * fp, 6) AS fp_dampening, round(boosted * (1.0 - 0.5 * fp), 6) AS adjusted FROM b JOIN r USING (agent)""", ("v_finding",))
def _(spark, sf):
    names = ("collection_exfiltration_hunter", "c2_hunter", "impact_hunter", "lateral_movement_hunter", "reconnaissance_hunter")
    lab = v.table(spark, sf, "labels").select(
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 5 + 1).cast("int")).alias("agent"),
        F.when(F.col("quality") == 1, "tp").otherwise("fp").alias("verdict"))
    runs = lab.select("agent", F.lit(0.5).alias("confidence"), F.lit(1).alias("findings"), F.lit(1.0).alias("seconds"), F.lit(None).cast("timestamp").alias("timestamp"))
    rates = rollup.agent_metrics(runs, lab)
    c = correlate.corroborate(_outputs(spark, sf), ("window_start",)).withColumn("chain_confidence", F.col("boosted_confidence"))
    return out(correlate.dampen(c, rates).select(F.unix_seconds("window_start").alias("window_start"), "agent", "fp_dampening", F.col("adjusted_confidence").alias("adjusted")))


@R.add("agent_metrics", """
WITH a AS (SELECT agent, count(*) AS total_analyses, count(*) FILTER (confidence > 0.5 AND sev > 0) AS total_detections, round(avg(sev * 1.5), 6) AS average_seconds,
  round(avg(confidence), 6) AS average_confidence FROM v_finding GROUP BY 1),
 f AS (SELECT agent, count(*) FILTER (sev >= 2) AS tp, count(*) FILTER (sev < 2) AS fp FROM v_finding GROUP BY 1)
SELECT agent, total_analyses, total_detections, average_seconds, average_confidence, round(total_detections / total_analyses, 6) AS detection_rate,
  tp AS true_positives, fp AS false_positives, round(fp / (tp + fp), 6) AS false_positive_rate FROM a JOIN f USING (agent)""", ("v_finding",))
def _(spark, sf):
    from netquarry.functions.times import severity_rank
    f = v.findings(spark, sf).withColumn("sev", severity_rank("severity"))
    runs = f.select("agent", "confidence", F.col("sev").alias("findings"), (F.col("sev") * 1.5).alias("seconds"), F.col("created_at").alias("timestamp"))
    fb = f.select("agent", F.when(F.col("sev") >= 2, "tp").otherwise("fp").alias("verdict"))
    return out(rollup.agent_metrics(runs, fb).drop("last_execution"))


@R.add("window_assessments", f"""
WITH {_OUTPUTS.strip()}, m AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY 1), {v.chain_sql('o', 'w')},
 x AS (SELECT b.w, b.agent, least(boosted * mult.x, 1.0) AS adj FROM b JOIN mult ON mult.w = b.w),
 f AS (SELECT w, CASE WHEN count(*) FILTER (adj > 0.7) >= 2 THEN least(max(adj) * 1.1, 1.0) ELSE max(adj) END AS fc, count(*) AS agent_count, count(*) FILTER (adj > 0.5) AS corroborating_agents FROM x GROUP BY 1),
 ts AS (SELECT w, agent, list_sort(list(t)) AS s FROM tt GROUP BY 1, 2),
 j AS (SELECT p.w, avg(len(list_intersect(p.s, q.s)) / len(list_distinct(list_concat(p.s, q.s)))) AS cs FROM ts p JOIN ts q ON p.w = q.w AND p.agent < q.agent GROUP BY 1)
SELECT CAST(epoch(f.w) AS BIGINT) AS window_start, round(fc, 6) AS final_confidence, agent_count, corroborating_agents, n AS total_findings,
  CASE WHEN fc >= 0.9 THEN 'critical' WHEN fc >= 0.7 THEN 'high' WHEN fc >= 0.5 THEN 'medium' ELSE 'low' END AS alert_level, round(coalesce(cs, 0.0), 6) AS correlation_score
FROM f JOIN m ON m.w = f.w LEFT JOIN j ON j.w = f.w""", ("v_finding",))
def _(spark, sf):
    a = correlate.assess(_outputs(spark, sf), ("window_start",))
    return out(a.select(F.unix_seconds("window_start").alias("window_start"), "final_confidence", "agent_count", "corroborating_agents", "total_findings", "alert_level", "correlation_score"))


def _dedup_sql(first):
    """Confidences on a scale of three make ties between families frequent."""
    return f"""
WITH {v.FAMILIES}, t AS (SELECT * REPLACE (floor(confidence * 3) / 4 AS confidence) FROM v_finding),
 a AS (SELECT agent, max(confidence) AS fc FROM t GROUP BY 1),
 r AS (SELECT t.*, fc, row_number() OVER (PARTITION BY fingerprint ORDER BY fc DESC, {first} place, confidence DESC) AS k FROM t JOIN a USING (agent) JOIN fam USING (agent))
SELECT fingerprint, agent, round(confidence, 6) AS confidence FROM r WHERE k = 1"""


def _tied(spark, sf):
    return v.findings(spark, sf).withColumn("confidence", F.floor(F.col("confidence") * 3) / 4)


@R.add("finding_dedup", _dedup_sql(""), ("v_finding",))
def _(spark, sf):
    return out(correlate.dedup_findings(_tied(spark, sf)), "fingerprint", "agent", "confidence")


@R.add("finding_dedup_by_priority", _dedup_sql("CASE agent WHEN 'impact_hunter' THEN -0.9 WHEN 'collection_exfiltration_hunter' THEN -0.4 ELSE 0 END,"), ("v_finding",))
def _(spark, sf):
    return out(correlate.dedup_findings(_tied(spark, sf), priority=PRIORITY), "fingerprint", "agent", "confidence")


@R.add("confidence_adjustments", f"""
WITH {_OUTPUTS.strip()}, a AS (SELECT agent, avg((sev - 1) * 0.1) AS d FROM v_finding GROUP BY 1)
SELECT {_W}, agent, round(d, 6) AS avg_adjustment, round(greatest(0.0, least(1.0, c + d)), 6) AS confidence,
  CASE WHEN greatest(0.0, least(1.0, c + d)) >= 0.8 THEN 'critical' WHEN greatest(0.0, least(1.0, c + d)) >= 0.6 THEN 'high' WHEN greatest(0.0, least(1.0, c + d)) >= 0.4 THEN 'medium' ELSE 'low' END AS severity
FROM o JOIN a USING (agent)""", ("v_finding",))
def _(spark, sf):
    from netquarry.functions.times import severity_rank
    adj = v.findings(spark, sf).select("agent", ((severity_rank("severity") - 1) * 0.1).alias("confidence_adjustment"))
    got = correlate.apply_adjustments(_outputs(spark, sf), adj)
    return out(got.select(F.unix_seconds("window_start").alias("window_start"), "agent", "avg_adjustment", "confidence", "severity"))


@R.add("evidence_totals", """
SELECT event_id, round(least(value / 100 + (event_id % 10) / 20.0 + 0.1, 1.0), 6) AS total FROM events""")
def _(spark, sf):
    parts = F.array(F.col("value") / 100, (F.col("event_id") % 10) / 20.0, F.lit(0.1))
    return out(v.table(spark, sf, "events").select("event_id", correlate.evidence_total(parts).alias("total")))


@R.add("hypothesis_support", """
WITH a AS (SELECT asset AS h, agent, max(confidence) AS c FROM v_finding GROUP BY 1, 2)
SELECT h AS hypothesis_id, round(greatest(0.3, max(c)), 6) AS confidence, count(*) AS agents FROM a GROUP BY 1""", ("v_finding",))
def _(spark, sf):
    f = v.findings(spark, sf).select(F.get("affected_assets", F.lit(0)).alias("hypothesis_id"), F.lit(0.3).alias("prior"), "agent", "confidence")
    s = correlate.hypothesis_support(f)
    return out(s.select("hypothesis_id", "confidence", F.size("support").alias("agents")))


# --- context, hypotheses, selection ---------------------------------------------

@R.add("context_traffic_metrics", """
SELECT sensor_id, CAST(sum(bytes_in) AS BIGINT) AS total_bytes_in, CAST(sum(bytes_out) AS BIGINT) AS total_bytes_out, count(*) AS connection_count,
  count(DISTINCT destination_ip) AS unique_destinations, count(*) FILTER (conn_state IN ('S0','REJ','RSTO','RSTR')) AS failed_connections FROM v_conn GROUP BY 1""", ("v_conn",))
def _(spark, sf):
    return out(cx.traffic_metrics(v.connections(spark, sf), ("sensor_id",)))


@R.add("context_protocols", "SELECT sensor_id, protocol, count(*) AS connections FROM v_conn GROUP BY 1, 2", ("v_conn",))
def _(spark, sf):
    return out(cx.protocol_map(v.connections(spark, sf), ("sensor_id",)).select("sensor_id", F.explode("protocols").alias("protocol", "connections")))


def _alerts(spark, sf):
    e = F.col("event_id")
    return v.table(spark, sf, "events").where("event_type = 'error'").select(
        F.concat(F.lit("cat"), e % 6).alias("category"), F.concat(F.lit("sig"), e).alias("signature"), F.col("ts").cast("timestamp").alias("timestamp"))


@R.add("context_alert_history", """
SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS total_alerts_24h, array_to_string(list_sort(list(DISTINCT 'cat' || (event_id % 6))), ',') AS incident_types
FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    return out(cx.alert_history(_alerts(spark, sf)))


@R.add("context_alert_counts", """
SELECT 'cat' || (event_id % 6) AS category, count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20') AS alerts_24h,
  count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20') AS alerts_7d FROM events WHERE event_type = 'error' GROUP BY 1""")
def _(spark, sf):
    return out(cx.alert_counts(_alerts(spark, sf), "2024-01-20 00:00:00", ("category",)))


def _states(spark, sf):
    c = v.dns(spark, sf).groupBy(F.window("timestamp", "1 hour").getField("start").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("connection_count"), F.countDistinct("source_ip").alias("unique_destinations"),
        F.count_if(F.col("response_code") == "NXDOMAIN").alias("total_alerts_24h"))
    return c


@R.add("context_state_vector", """
WITH s AS (SELECT date_trunc('hour', ts) AS w, count(*) AS n, count(DISTINCT source_ip) AS u, count(*) FILTER (response_code = 'NXDOMAIN') AS a FROM v_dns GROUP BY 1)
SELECT CAST(epoch(w) AS BIGINT) AS window_start, round(CAST(CAST(hour(w) / 24.0 AS FLOAT) AS DOUBLE), 6) AS f0, round(CAST(CAST((isodow(w) - 1) / 7.0 AS FLOAT) AS DOUBLE), 6) AS f1,
  CASE WHEN hour(w) BETWEEN 8 AND 17 THEN 1.0 ELSE 0.0 END AS f2, round(CAST(CAST(least(n / 10000.0, 1.0) AS FLOAT) AS DOUBLE), 6) AS f7,
  round(CAST(CAST(least(u / 1000.0, 1.0) AS FLOAT) AS DOUBLE), 6) AS f8, round(CAST(CAST(least(a / 100.0, 1.0) AS FLOAT) AS DOUBLE), 6) AS f11, 22::BIGINT AS features FROM s""", ("v_dns",))
def _(spark, sf):
    s = cx.with_context_defaults(cx.time_features(_states(spark, sf))).withColumn("v", cx.state_vector())
    return out(s.select(F.unix_seconds("timestamp").alias("window_start"), *[F.get("v", F.lit(i)).alias(f"f{i}") for i in (0, 1, 2, 7, 8, 11)], F.size("v").alias("features")))


@R.add("context_anomalies", """
WITH s AS (SELECT date_trunc('hour', ts) AS w, count(*) AS n, count(*) FILTER (response_code = 'NXDOMAIN') AS a FROM v_dns GROUP BY 1),
 m AS (SELECT *, avg(a) OVER x AS ma, avg(n) OVER x AS mn, count(*) OVER x AS k FROM s WINDOW x AS (ORDER BY w ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT CAST(epoch(w) AS BIGINT) AS window_start, 'alert_volume_spike' AS type, 'high' AS severity, 0.7 AS confidence, round(ma, 6) AS mean_alerts FROM m WHERE k >= 10 AND a > ma * 2
UNION ALL SELECT CAST(epoch(w) AS BIGINT), 'connection_spike', 'medium', 0.6, round(ma, 6) FROM m WHERE k >= 10 AND n > mn * 3""", ("v_dns",))
def _(spark, sf):
    a = cx.anomalies(_states(spark, sf), "timestamp")
    return out(a.select(F.unix_seconds("timestamp").alias("window_start"), "type", "severity", "confidence", "mean_alerts"))


def _signals(spark, sf):
    c = F.col("c_custkey")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("Reconnaissance sweep", "lateral tool", "Code Execution", "credential dump", "other")]), (c % 5 + 1).cast("int"))
    return v.table(spark, sf, "customer").select((c % 200).alias("hunt_id"), kinds.alias("type"), ((c % 10) / 10.0).alias("confidence"))


def _hunts(spark, sf):
    c = F.col("c_custkey")
    return v.table(spark, sf, "customer").select((c % 250).alias("hunt_id")).distinct().withColumn(
        "active_campaigns", F.when(F.col("hunt_id") % 40 == 0, F.array(F.lit("campaign"))).otherwise(F.array().cast("array<string>")))


_HYP = """
 sg AS (SELECT c_custkey % 200 AS h, ['reconnaissance sweep', 'lateral tool', 'code execution', 'credential dump', 'other'][1 + CAST(c_custkey % 5 AS INT)] AS t, (c_custkey % 10) / 10.0 AS c FROM customer),
 hu AS (SELECT DISTINCT c_custkey % 250 AS h FROM customer),
 mt AS (SELECT h, CASE WHEN t LIKE '%reconnaissance%' THEN 'kill_chain_stage' WHEN t LIKE '%lateral%' OR t LIKE '%execution%' THEN 'chain_of_events' ELSE 'anomaly_investigation' END AS ty,
   CASE WHEN t LIKE '%reconnaissance%' THEN 0.7 WHEN t LIKE '%lateral%' OR t LIKE '%execution%' THEN 0.8 ELSE 0.85 END AS p, c,
   CASE WHEN t LIKE '%reconnaissance%' THEN ['reconnaissance_hunter', 'c2_hunter'] WHEN t LIKE '%lateral%' OR t LIKE '%execution%' THEN ['lateral_movement_hunter', 'collection_exfiltration_hunter', 'c2_hunter']
     ELSE ['lateral_movement_hunter', 'collection_exfiltration_hunter'] END AS ag FROM sg WHERE t <> 'other'
  UNION ALL SELECT h, 'apt_campaign', 0.9, 0.6, ['reconnaissance_hunter', 'c2_hunter', 'lateral_movement_hunter', 'collection_exfiltration_hunter', 'impact_hunter'] FROM hu WHERE h % 40 = 0),
 qu AS (SELECT h FROM hu WHERE h NOT IN (SELECT h FROM mt)),
 hy AS (SELECT * FROM mt UNION ALL SELECT h, 'kill_chain_stage', 0.6, 0.4, ['c2_hunter'] FROM qu UNION ALL SELECT h, 'kill_chain_stage', 0.6, 0.4, ['reconnaissance_hunter'] FROM qu
   UNION ALL SELECT h, 'kill_chain_stage', 0.5, 0.4, ['lateral_movement_hunter', 'collection_exfiltration_hunter', 'impact_hunter'] FROM qu)"""


@R.add("hypotheses", f"WITH {_HYP.strip()} SELECT h AS hunt_id, ty AS hypothesis_type, round(p, 6) AS priority, round(c, 6) AS confidence, array_to_string(ag, ',') AS suggested_agents FROM hy")
def _(spark, sf):
    return out(cx.hypotheses(_signals(spark, sf), _hunts(spark, sf)), "hunt_id", "hypothesis_type", "priority", "confidence", "suggested_agents")


@R.add("selection_sequential", f"WITH {_HYP.strip()}, x AS (SELECT h, p, unnest(ag) AS a FROM hy) SELECT h AS hunt_id, a AS agent, round(max(p), 6) AS score FROM x GROUP BY 1, 2")
def _(spark, sf):
    return out(selection.sequential(cx.hypotheses(_signals(spark, sf), _hunts(spark, sf))))


@R.add("selection_parallel", "SELECT DISTINCT c_custkey % 250 AS hunt_id, unnest(['c2_hunter', 'collection_exfiltration_hunter', 'impact_hunter', 'lateral_movement_hunter', 'reconnaissance_hunter']) AS agent, 0.8 AS score FROM customer")
def _(spark, sf):
    return out(selection.parallel(_hunts(spark, sf).select("hunt_id")))


@R.add("selection_adaptive", f"""
WITH {_HYP.strip()}, x AS (SELECT h, unnest(ag) AS a FROM hy), s AS (SELECT h, a, count(*) AS k FROM x GROUP BY 1, 2),
 ha AS (SELECT h, unnest(['c2_hunter', 'collection_exfiltration_hunter', 'impact_hunter', 'lateral_movement_hunter', 'reconnaissance_hunter']) AS a FROM hu),
 hs AS (SELECT agent AS a, avg(confidence) AS av FROM v_finding GROUP BY 1),
 sc AS (SELECT ha.h, ha.a, 0.4 * CASE WHEN k > 0 THEN least(0.8 + (k - 1) * 0.1, 1.0) ELSE 0.3 END
   + 0.3 * CASE WHEN ha.h % 6 = 0 THEN least(CASE WHEN ha.h % 4 = 0 THEN 0.8 ELSE 0.5 END + 0.2, 1.0) ELSE CASE WHEN ha.h % 4 = 0 THEN 0.8 ELSE 0.5 END END
   + 0.2 * CASE WHEN ha.h > 150 THEN 0.9 WHEN ha.h % 2 = 0 THEN 0.7 ELSE 0.5 END + 0.1 * coalesce(av, 0.5) AS v
  FROM ha LEFT JOIN s ON s.h = ha.h AND s.a = ha.a LEFT JOIN hs ON hs.a = ha.a)
SELECT h AS hunt_id, a AS agent, round(greatest(v, CASE WHEN a IN ('c2_hunter', 'reconnaissance_hunter') THEN 0.5 ELSE 0.0 END), 6) AS score FROM sc
WHERE greatest(v, CASE WHEN a IN ('c2_hunter', 'reconnaissance_hunter') THEN 0.5 ELSE 0.0 END) >= 0.3""", ("v_finding",))
def _(spark, sf):
    h = _hunts(spark, sf)
    k = F.col("hunt_id")
    state = h.select(k, F.when(k % 4 == 0, 3).otherwise(0).alias("critical_assets"), F.when(k % 6 == 0, 1).otherwise(0).alias("privileged_sessions"),
                     (k % 2 != 0).alias("is_business_hours"), F.when(k > 150, 101).otherwise(5).alias("total_alerts_24h"))
    runs = v.findings(spark, sf).select("agent", "confidence", (F.col("severity") == "high").alias("success"))
    return out(selection.adaptive(state, cx.hypotheses(_signals(spark, sf), h), selection.agent_history(runs)))


@R.add("selection_agent_history", """
SELECT agent, round(avg(confidence), 6) AS average_confidence, count(*) AS run_count, count(*) FILTER (severity = 'high') AS success_count FROM v_finding GROUP BY 1""", ("v_finding",))
def _(spark, sf):
    return out(selection.agent_history(v.findings(spark, sf).select("agent", "confidence", (F.col("severity") == "high").alias("success"))))


@R.add("selection_weight_adjustment", """
WITH f AS (SELECT ['threat_relevance', 'asset_criticality', 'temporal_urgency'][1 + CAST(doc_id % 3 AS INT)] AS name, avg(quality) - 0.9 AS d FROM labels GROUP BY 1),
 w AS (SELECT unnest(['threat_relevance', 'asset_criticality', 'temporal_urgency', 'agent_confidence_history']) AS name, unnest([0.4, 0.3, 0.2, 0.1]) AS w),
 m AS (SELECT name, CASE WHEN d IS NULL THEN w ELSE greatest(0.0, least(1.0, w + d)) END AS w FROM w LEFT JOIN f USING (name))
SELECT name, round(w / (SELECT sum(w) FROM m), 6) AS weight FROM m""")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in ("threat_relevance", "asset_criticality", "temporal_urgency")])
    fb = v.table(spark, sf, "labels").groupBy(F.element_at(names, (F.col("doc_id") % 3 + 1).cast("int")).alias("name")).agg((F.avg("quality") - 0.9).alias("adjustment"))
    w = spark.createDataFrame(list(selection.WEIGHTS.items()), "name string, weight double")
    return out(selection.adjust_weights(w, fb))


@R.add("next_stage_agents", """
WITH d AS (SELECT DISTINCT user_id AS h, ['TA0002', 'TA0008', 'TA0009', 'TA0001', 'TA0040'][1 + CAST(event_id % 5 AS INT)] AS t FROM events)
SELECT DISTINCT h AS hunt_id, a AS agent FROM (SELECT h, unnest(CASE t WHEN 'TA0002' THEN ['lateral_movement_hunter'] WHEN 'TA0008' THEN ['collection_exfiltration_hunter'] WHEN 'TA0009' THEN ['collection_exfiltration_hunter']
  WHEN 'TA0001' THEN ['c2_hunter'] ELSE [] END) AS a FROM d)""")
def _(spark, sf):
    t = F.element_at(F.array(*[F.lit(x) for x in ("TA0002", "TA0008", "TA0009", "TA0001", "TA0040")]), (F.col("event_id") % 5 + 1).cast("int"))
    d = v.table(spark, sf, "events").select(F.col("user_id").alias("hunt_id"), t.alias("tactic")).distinct()
    return selection.next_stage_agents(d)


# --- cases ------------------------------------------------------------------------

@R.add("case_escalation", """
SELECT escalation_level, count(*) AS cases, round(min(confidence), 6) AS lowest FROM v_case GROUP BY 1""", ("v_case",))
def _(spark, sf):
    c = v.cases(spark, sf)
    return out(c.groupBy(cs.escalation(F.col("confidence")).alias("escalation_level")).agg(F.count(F.lit(1)).alias("cases"), F.min("confidence").alias("lowest")))


@R.add("case_statistics", """
SELECT 'status' AS facet, status AS value, count(*) AS cases FROM v_case GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM v_case GROUP BY 2
UNION ALL SELECT 'escalation_level', escalation_level, count(*) FROM v_case GROUP BY 2 UNION ALL SELECT 'analyst_verdict', analyst_verdict, count(*) FROM v_case WHERE analyst_verdict IS NOT NULL GROUP BY 2
UNION ALL SELECT 'total', NULL, count(*) FROM v_case""", ("v_case",))
def _(spark, sf):
    return out(cs.case_statistics(v.cases(spark, sf)))


@R.add("case_filter_with_findings", """
WITH k AS (SELECT case_id, epoch_us(created_at) AS created_at FROM v_case WHERE status = 'new' AND severity = 'high' ORDER BY created_at DESC, case_id LIMIT 100),
 l AS (SELECT DISTINCT 'c' || l_orderkey AS case_id, 'f' || l_partkey AS fid FROM lineitem)
SELECT k.case_id, created_at, count(fid) AS finding_count, coalesce(array_to_string(list_slice(list_sort(list(fid) FILTER (fid IS NOT NULL)), 1, 3), ','), '') AS findings FROM k LEFT JOIN l USING (case_id) GROUP BY 1, 2""", ("v_case",))
def _(spark, sf):
    links = v.table(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_orderkey")).alias("case_id"), F.concat(F.lit("f"), F.col("l_partkey")).alias("finding_id")).distinct()
    got = cs.filter_cases(v.cases(spark, sf), links, status="new", severity="high", sample=3)
    return out(got.select("case_id", F.unix_micros("created_at").alias("created_at"), "finding_count",
                          F.coalesce("findings", F.array().cast("array<string>")).alias("findings")))


@R.add("case_links_idempotent", "SELECT count(*) AS links FROM (SELECT DISTINCT 'c' || l_orderkey AS c, 'f' || l_partkey AS f FROM lineitem)")
def _(spark, sf):
    links = v.table(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_orderkey")).alias("case_id"), F.concat(F.lit("f"), F.col("l_partkey")).alias("finding_id"))
    return out(cs.link_findings(links, links).agg(F.count(F.lit(1)).alias("links")))


_DEDUP = """
 a AS (SELECT case_id, asset FROM v_case_asset),
 op AS (SELECT * FROM v_case WHERE status IN ('new', 'investigating') AND created_at BETWEEN TIMESTAMP '2000-12-02' AND TIMESTAMP '2001-01-01'),
 nw AS (SELECT * FROM v_case WHERE status = 'confirmed_tp'),
 cand AS (SELECT n.case_id, o.case_id AS open_id, o.created_at FROM nw n JOIN a na ON na.case_id = n.case_id JOIN a oa ON oa.asset = na.asset JOIN op o ON o.case_id = oa.case_id
   WHERE n.t1 IN (o.t1, o.t2) OR n.t2 IN (o.t1, o.t2)),
 mt AS (SELECT case_id, max({'at': created_at, 'id': open_id}).id AS open_case_id FROM cand GROUP BY 1)"""


def _matched(spark, sf):
    c, a = v.cases(spark, sf), v.case_assets(spark, sf)
    idx = cs.open_case_index(c, a, AS_OF, 30 * 24)
    fresh = c.where("status = 'confirmed_tp'")
    return c, fresh, cs.match_open_cases(fresh, a.join(fresh.select("case_id"), "case_id"), idx)


@R.add("case_open_match", f"WITH {_DEDUP.strip()} SELECT case_id, open_case_id FROM mt", ("v_case", "v_case_asset"))
def _(spark, sf):
    return _matched(spark, sf)[2]


@R.add("case_merge", f"""
WITH {_DEDUP.strip()}, g AS (SELECT open_case_id AS case_id, max(confidence) AS c FROM mt JOIN nw USING (case_id) GROUP BY 1)
SELECT v_case.case_id, round(greatest(confidence, coalesce(c, 0.0)), 6) AS confidence FROM v_case LEFT JOIN g USING (case_id)""", ("v_case", "v_case_asset"))
def _(spark, sf):
    c, fresh, matches = _matched(spark, sf)
    return out(cs.merge_cases(c, fresh, matches)[0], "case_id", "confidence")


@R.add("case_resolution", """
WITH l AS (SELECT 'c' || l_orderkey AS case_id, max({'t': l_shipdate, 'v': CASE l_linenumber % 3 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' ELSE 'uncertain' END}).v AS vd FROM lineitem GROUP BY 1)
SELECT v_case.case_id, vd AS analyst_verdict, CASE vd WHEN 'tp' THEN 'confirmed_tp' WHEN 'fp' THEN 'confirmed_fp' WHEN 'uncertain' THEN 'closed' ELSE status END AS status FROM v_case LEFT JOIN l USING (case_id)""", ("v_case",))
def _(spark, sf):
    n = F.col("l_linenumber")
    log = v.table(spark, sf, "lineitem").select(F.concat(F.lit("c"), F.col("l_orderkey")).alias("case_id"),
        F.when(n % 3 == 0, "tp").when(n % 3 == 1, "fp").otherwise("uncertain").alias("verdict"), F.lit("note").alias("notes"), F.col("l_shipdate").cast("timestamp").alias("timestamp"))
    return cs.resolve(v.cases(spark, sf), log).select("case_id", "analyst_verdict", "status")


@R.add("case_import", """
WITH x AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'True Positive' WHEN 1 THEN 'benign' WHEN 2 THEN 'malicious T1003' ELSE 'open' END AS cl, o_orderkey % 3 IN (1, 2) AS closed FROM orders WHERE o_orderkey % 500 <> 7 OR o_orderkey > 500),
 y AS (SELECT *, CASE WHEN lower(cl) LIKE '%true%' OR lower(cl) LIKE '%malicious%' THEN 'tp' WHEN lower(cl) LIKE '%benign%' THEN 'fp' ELSE 'uncertain' END AS vd FROM x)
SELECT CAST(o_orderkey AS VARCHAR) AS external_id, ['medium', 'low', 'medium', 'high', 'critical'][1 + CAST(o_orderkey % 5 AS INT)] AS severity,
  'T' || (1000 + o_orderkey % 90) || CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 90 <> 3 THEN ',T1003' ELSE '' END AS mitre_techniques,
  CASE WHEN closed AND vd = 'tp' THEN 'confirmed_tp' WHEN closed AND vd = 'fp' THEN 'confirmed_fp' WHEN closed THEN 'closed' ELSE 'investigating' END AS status,
  CASE WHEN closed THEN vd END AS analyst_verdict FROM y""")
def _(spark, sf):
    got = cs.import_cases(_external(spark, sf), v.cases(spark, sf).where("external_id = '7'"))
    return out(got, "external_id", "severity", "mitre_techniques", "status", "analyst_verdict")


def _external(spark, sf):
    k = F.col("o_orderkey")
    return v.table(spark, sf, "orders").select(
        k.alias("case_id"), F.lit(None).cast("string").alias("case_name"), F.col("o_orderpriority").alias("case_description"),
        (k % 5).cast("int").alias("case_severity_id"), (k % 3).cast("int").alias("case_status_id"),
        F.concat(F.lit("tag,T"), 1000 + k % 90).alias("case_tags"),
        F.when(k % 4 == 0, "True Positive").when(k % 4 == 1, "benign").when(k % 4 == 2, "malicious T1003").otherwise("open").alias("classification"))


@R.add("case_verdict_sync", """
WITH x AS (SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CASE o_orderkey % 4 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' WHEN 2 THEN 'tp' ELSE 'uncertain' END AS verdict FROM orders WHERE o_orderkey % 3 IN (1, 2))
SELECT case_id, external_id, verdict FROM v_case JOIN x USING (external_id) WHERE status IN ('new', 'investigating')""", ("v_case",))
def _(spark, sf):
    return cs.verdict_updates(v.cases(spark, sf), _external(spark, sf))


@R.add("case_push_payload", """
SELECT title AS case_name, case_id AS case_soc_id, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END::BIGINT AS case_severity_id,
  'Case ' || case_id || chr(10) || chr(10) || description || chr(10) || chr(10) || '**Confidence:** ' || CAST(round(confidence * 100) AS INT) || '%' || chr(10) || '**Escalation Level:** ' || escalation_level || chr(10) ||
  '**MITRE Techniques:** ' || t1 || ', ' || t2 || chr(10) || chr(10) || '**Recommended Actions:**' || chr(10) || '- isolate' AS case_description FROM v_case""", ("v_case",))
def _(spark, sf):
    p = cs.push_payload(v.cases(spark, sf).withColumn("recommended_actions", F.array(F.lit("isolate"))))
    return out(p, "case_name", "case_soc_id", "case_severity_id", "case_description")


@R.add("case_push_indicators", """
SELECT case_id AS case_soc_id, asset AS ioc_value, 1::BIGINT AS ioc_type_id, t1 || ',' || t2 AS ioc_tags FROM v_case_asset JOIN v_case USING (case_id)""", ("v_case", "v_case_asset"))
def _(spark, sf):
    return out(cs.push_indicators(v.cases(spark, sf), v.case_assets(spark, sf)))


@R.add("case_timeline", """
SELECT case_id, 'created' AS event, epoch_us(created_at) AS happened FROM v_case WHERE case_id = 'c17'
UNION ALL SELECT case_id, 'updated', epoch_us(created_at + INTERVAL 1 DAY) FROM v_case WHERE case_id = 'c17'""", ("v_case",))
def _(spark, sf):
    c = v.cases(spark, sf).withColumns({"updated_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"), "resolved_at": F.lit(None).cast("timestamp")})
    return out(cs.case_timeline(c, "c17").withColumnRenamed("at", "happened"))


# --- learning -----------------------------------------------------------------------

@R.add("technique_precision", """
WITH a AS (SELECT technique_id, count(*) FILTER (verdict = 'tp') AS true_positives, count(*) FILTER (verdict = 'fp') AS false_positives, count(*) FILTER (verdict = 'uncertain') AS uncertain FROM v_verdict GROUP BY 1)
SELECT *, round(CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0.5 END, 6) AS precision FROM a""", ("v_verdict",))
def _(spark, sf):
    return out(learning.technique_precision(v.verdicts(spark, sf)))


@R.add("technique_precision_tiers", """
WITH a AS (SELECT t AS technique_id, count(*) FILTER (analyst_verdict = 'tp') AS tp, count(*) FILTER (analyst_verdict = 'fp') AS fp FROM (SELECT unnest([t1, t2]) AS t, analyst_verdict FROM v_case WHERE analyst_verdict IS NOT NULL) GROUP BY 1)
SELECT technique_id, round(tp / (tp + fp), 6) AS precision, CASE WHEN tp / (tp + fp) >= 0.7 THEN 'high_precision' WHEN tp / (tp + fp) >= 0.3 THEN 'medium_precision' ELSE 'low_precision' END AS tier FROM a""", ("v_case",))
def _(spark, sf):
    p = learning.technique_precision(learning.case_technique_verdicts(v.cases(spark, sf)))
    return out(learning.precision_tiers(p), "technique_id", "precision", "tier")


@R.add("reliable_techniques", """
WITH a AS (SELECT technique_id, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp FROM v_verdict GROUP BY 1)
SELECT technique_id, CASE WHEN tp / (tp + fp) >= 0.7 THEN 'high_precision' ELSE 'low_precision' END AS tier FROM a WHERE tp + fp >= 2 AND (tp / (tp + fp) >= 0.7 OR tp / (tp + fp) < 0.3)""", ("v_verdict",))
def _(spark, sf):
    return learning.reliable_techniques(learning.technique_precision(v.verdicts(spark, sf))).select("technique_id", "tier")


@R.add("confidence_calibration", """
WITH p AS (SELECT confidence AS p, CASE verdict WHEN 'tp' THEN 1.0 WHEN 'fp' THEN 0.0 ELSE 0.5 END AS a FROM v_verdict ORDER BY case_no DESC LIMIT 500), q AS (SELECT DISTINCT confidence AS c FROM v_finding),
 n AS (SELECT c, count(*) AS near, avg(a) AS m FROM q JOIN p ON abs(CAST(round(p * 1000000) AS BIGINT) - CAST(round(c * 1000000) AS BIGINT)) <= 100000 GROUP BY 1)
SELECT round(q.c, 6) AS confidence, coalesce(near, 0) AS near, round(CASE WHEN near >= 3 AND q.c > 0 THEN greatest(0.5, least(1.5, m / q.c)) ELSE 1.0 END, 6) AS factor FROM q LEFT JOIN n ON n.c = q.c""", ("v_verdict", "v_finding"))
def _(spark, sf):
    pts = learning.calibration_points(v.verdicts(spark, sf), ("case_no",))
    return out(learning.calibration_factors(v.findings(spark, sf), pts))


@R.add("feedback_metrics", """
SELECT count(*) AS total_feedback, count(*) FILTER (verdict = 'tp') AS true_positives, count(*) FILTER (verdict = 'fp') AS false_positives, count(*) FILTER (verdict = 'uncertain') AS uncertain,
  round(count(*) FILTER (verdict = 'tp') / count(*) FILTER (verdict <> 'uncertain'), 6) AS precision, round(count(*) FILTER (verdict = 'fp') / count(*) FILTER (verdict <> 'uncertain'), 6) AS false_positive_rate FROM v_verdict""", ("v_verdict",))
def _(spark, sf):
    return out(learning.feedback_metrics(v.verdicts(spark, sf)))


@R.add("case_outcome_memory", """
SELECT substr(sha256('Case ' || case_id || ': ' || title || ' — resolved as confirmed malicious / true positive. ' || description), 1, 24) AS content FROM v_case WHERE status = 'new'""", ("v_case",))
def _(spark, sf):
    from netquarry.functions import text
    c = v.cases(spark, sf).where("status = 'new'")
    log = c.select("case_id", F.lit("tp").alias("verdict"), F.col("created_at").alias("timestamp"))
    return learning.case_outcomes(c, log)["memory"].select(text.content_id("text").alias("content"))


def _books(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return v.table(spark, sf, "orders").select(
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k).alias("timestamp"), (k % 4 == 0).alias("success"),
        F.array(F.concat(F.lit("T"), c % 9), F.concat(F.lit("T"), k % 3)).alias("techniques"), F.array(F.concat(F.lit("z"), k % 5), F.concat(F.lit("a"), c % 4)).alias("agents"))


_BOOK = """
 h AS (SELECT o_orderdate + INTERVAL 1 SECOND * o_orderkey AS ts, o_orderkey % 4 = 0 AS ok, least('T' || (o_custkey % 9), 'T' || (o_orderkey % 3)) || '_' || greatest('T' || (o_custkey % 9), 'T' || (o_orderkey % 3)) AS playbook,
   'a' || (o_custkey % 4) || ',' || 'z' || (o_orderkey % 5) AS combo FROM orders),
 bk AS (SELECT playbook, count(*) AS total_count, count(*) FILTER (ok) AS success_count, count(DISTINCT combo) FILTER (ok) AS combinations, min({'t': ts, 'c': combo}) FILTER (ok).c AS recommended FROM h GROUP BY 1)"""


@R.add("playbooks", f"WITH {_BOOK.strip()} SELECT * FROM bk")
def _(spark, sf):
    return out(learning.playbooks(_books(spark, sf)))


@R.add("playbook_recommendation", f"WITH {_BOOK.strip()} SELECT playbook, recommended AS agents FROM bk WHERE success_count > 0")
def _(spark, sf):
    books = learning.playbooks(_books(spark, sf))
    queries = _books(spark, sf).select(F.array_sort("techniques").alias("techniques")).distinct()
    return out(learning.recommend_strategy(queries, books).select("playbook", "agents").distinct())


@R.add("playbook_exchange", f"""
WITH {_BOOK.strip()}, x AS (SELECT * FROM bk WHERE playbook LIKE 'T1%'),
 y AS (SELECT playbook, total_count, success_count, combinations, 'their,own' AS recommended FROM bk WHERE playbook LIKE '%T2')
SELECT playbook, CAST(sum(total_count) AS BIGINT) AS total_count, CAST(sum(success_count) AS BIGINT) AS success_count, max(combinations) AS combinations,
  coalesce(max(recommended) FILTER (recommended <> 'their,own'), max(recommended)) AS recommended FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY 1""")
def _(spark, sf):
    """Playbooks of one installation written out, loaded by another and merged with its own."""
    from netquarry.session import fresh_path
    folder, books = fresh_path(spark, "playbooks"), learning.playbooks(_books(spark, sf))
    learning.export_playbooks(books.where("playbook LIKE '%T2'").withColumn("recommended", F.lit("their,own")), folder)
    return out(learning.merge_playbooks(books.where("playbook LIKE 'T1%'"), learning.import_playbooks(spark, folder)))


@R.add("strategy_arm_statistics", """
SELECT event_type AS arm, count(*) AS pulls, count(*) FILTER (value / 100 > 0.5) AS successes, round(avg(value / 100), 6) AS mean_reward,
  round((count(*) FILTER (value / 100 > 0.5) + 1) / (count(*) + 2), 6) AS posterior_mean FROM events GROUP BY 1""")
def _(spark, sf):
    return out(learning.arm_statistics(v.table(spark, sf, "events").select(F.col("event_type").alias("arm"), (F.col("value") / 100).alias("reward"))))


@R.add("strategy_best_arm", """
WITH a AS (SELECT event_type AS arm, (count(*) FILTER (value / 100 > 0.5) + 1) / (count(*) + 2) AS p FROM events GROUP BY 1) SELECT arm FROM a ORDER BY p DESC, arm LIMIT 1""")
def _(spark, sf):
    return learning.best_arm(learning.arm_statistics(v.table(spark, sf, "events").select(F.col("event_type").alias("arm"), (F.col("value") / 100).alias("reward")))).select("arm")


# --- threat intelligence -------------------------------------------------------------

_INTEL = """
 it AS (SELECT c_custkey AS k, '203.0.113.' || (c_custkey % 250) || CASE WHEN c_custkey >= 250 THEN 'x' || (c_custkey // 250) ELSE '' END AS indicator, c_custkey * 7 % 100 AS ab, c_custkey % 8 AS vt,
   CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 14 END AS otx, ['malicious', 'unknown', 'benign'][1 + CAST(c_custkey % 3 AS INT)] AS gc, c_custkey % 2 = 0 AS gn FROM customer),
 sc AS (SELECT indicator, CASE WHEN ab >= 80 THEN 3 WHEN ab >= 50 THEN 2 WHEN ab >= 25 THEN 1 ELSE 0 END + CASE WHEN vt >= 5 THEN 3 WHEN vt >= 2 THEN 2 WHEN vt >= 1 THEN 1 ELSE 0 END
   + CASE WHEN otx >= 10 THEN 2 WHEN otx >= 3 THEN 1 ELSE 0 END + CASE WHEN gc = 'malicious' THEN 3 WHEN gc = 'unknown' AND gn THEN 1 ELSE 0 END AS s FROM it),
 vd AS (SELECT indicator, s, CASE WHEN s >= 6 THEN 'malicious' WHEN s >= 3 THEN 'suspicious' WHEN s >= 1 THEN 'low_risk' ELSE 'clean' END AS v FROM sc)"""


def _intel(spark, sf):
    c = F.col("c_custkey")
    return v.table(spark, sf, "customer").select(
        F.concat(F.lit("203.0.113."), c % 250, F.when(c >= 250, F.concat(F.lit("x"), F.floor(c / 250))).otherwise("")).alias("indicator"),
        (c * 7 % 100).alias("abuse_score"), (c % 8).alias("vt_malicious"), F.when(c % 3 != 0, c % 14).alias("otx_pulses"),
        F.when(c % 3 == 0, "malicious").when(c % 3 == 1, "unknown").otherwise("benign").alias("gn_classification"), (c % 2 == 0).alias("gn_noise"))


@R.add("intel_verdicts", f"WITH {_INTEL.strip()} SELECT indicator, CAST(s AS BIGINT) AS score, v AS verdict FROM vd")
def _(spark, sf):
    return out(intel.score_indicators(_intel(spark, sf)), "indicator", "score", "verdict")


@R.add("intel_enrichment", f"""
WITH {_INTEL.strip()}, q AS (SELECT DISTINCT peer AS indicator FROM v_finding UNION SELECT DISTINCT asset FROM v_finding UNION SELECT DISTINCT domain FROM v_dns)
SELECT q.indicator, CASE WHEN regexp_matches(q.indicator, '^[0-9.]+$') THEN 'ip' ELSE 'domain' END AS indicator_type, CASE WHEN q.indicator LIKE '10.%' THEN 0 ELSE coalesce(s, 0) END::BIGINT AS score,
  CASE WHEN q.indicator LIKE '10.%' THEN 'internal' ELSE coalesce(v, 'unknown') END AS verdict FROM q LEFT JOIN vd ON vd.indicator = q.indicator""", ("v_finding", "v_dns"))
def _(spark, sf):
    f = v.findings(spark, sf).select(F.explode(F.concat("indicators", "affected_assets")).alias("x")).select(F.substring_index("x", ":", 1).alias("indicator"))
    d = v.dns(spark, sf).select(F.col("domain").alias("indicator"))
    return out(intel.enrich(f.unionByName(d).distinct(), _intel(spark, sf)))


@R.add("intel_queue_new", """
SELECT DISTINCT peer AS ip FROM v_finding WHERE CAST(string_split(peer, '.')[4] AS INT) % 4 <> 0 AND CAST(string_split(peer, '.')[4] AS INT) % 7 <> 0""", ("v_finding",))
def _(spark, sf):
    f = v.findings(spark, sf)
    ips = intel.finding_addresses(f)
    last = F.element_at(F.split("ip", r"\."), -1).cast("int")
    return intel.new_queue_entries(f, ips.where(last % 4 == 0), ips.where(last % 7 == 0))


@R.add("intel_queue_batch", "SELECT 'ip' || s_suppkey AS ip FROM supplier ORDER BY s_suppkey % 13, 'ip' || s_suppkey LIMIT 5")
def _(spark, sf):
    q = v.table(spark, sf, "supplier").select(F.concat(F.lit("ip"), F.col("s_suppkey")).alias("ip"), (F.col("s_suppkey") % 13).alias("queued_at"))
    return intel.next_batch(q).select("ip")


@R.add("intel_queue_counts", "SELECT o_orderstatus AS status, count(*) AS addresses FROM orders GROUP BY 1")
def _(spark, sf):
    return out(intel.queue_counts(v.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"))))


@R.add("intel_cache_fresh", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20'")
def _(spark, sf):
    c = v.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    return intel.fresh(c, "2024-01-20 00:00:00").select("event_id")


_SRC = "['abuseipdb', 'virustotal', 'otx', 'greynoise'][1 + CAST(event_id % 4 AS INT)]"


@R.add("intel_sources_per_indicator", f"""
WITH n AS (SELECT user_id, {_SRC} AS s, max({{'t': ts, 'r': 'r' || event_id}}).r AS r FROM events GROUP BY 1, 2)
SELECT 'i' || user_id AS indicator, max(r) FILTER (s = 'abuseipdb') AS abuseipdb, max(r) FILTER (s = 'virustotal') AS virustotal, max(r) FILTER (s = 'otx') AS otx, max(r) FILTER (s = 'greynoise') AS greynoise FROM n GROUP BY user_id""")
def _(spark, sf):
    e = F.col("event_id")
    c = v.table(spark, sf, "events").select(
        F.concat(F.lit("i"), F.col("user_id")).alias("indicator"), F.when(e % 4 == 0, "abuseipdb").when(e % 4 == 1, "virustotal").when(e % 4 == 2, "otx").otherwise("greynoise").alias("source"),
        F.concat(F.lit("r"), e).alias("result"), F.col("ts").alias("created_at"))
    return intel.by_source(c)


@R.add("intel_upsert", """
SELECT 'i' || user_id AS ip, max({'t': ts, 'v': event_type}).v AS verdict FROM events GROUP BY 1""")
def _(spark, sf):
    rows = v.table(spark, sf, "events").select(F.concat(F.lit("i"), F.col("user_id")).alias("ip"), F.col("event_type").alias("verdict"), F.col("ts").alias("enriched_at"), "event_id")
    a, b = rows.where("event_id % 3 = 0").drop("event_id"), rows.where("event_id % 3 <> 0").drop("event_id")
    return intel.upsert(a, b).select("ip", "verdict")


@R.add("suspicious_addresses", "SELECT DISTINCT unnest([asset, peer]) AS ip FROM v_finding", ("v_finding",))
def _(spark, sf):
    return intel.suspicious_addresses(v.findings(spark, sf))


@R.add("focused_connections", """
WITH s AS (SELECT DISTINCT unnest([asset, peer]) AS ip FROM v_finding WHERE severity = 'critical')
SELECT source_ip, destination_ip, count(*) AS connections FROM v_conn WHERE source_ip IN (SELECT ip FROM s) OR destination_ip IN (SELECT ip FROM s) GROUP BY 1, 2""", ("v_finding", "v_conn"))
def _(spark, sf):
    s = intel.suspicious_addresses(v.findings(spark, sf).where("severity = 'critical'"))
    return out(intel.focus(v.connections(spark, sf), s).groupBy("source_ip", "destination_ip").agg(F.count(F.lit(1)).alias("connections")))


@R.add("listed_domain_match", """
WITH l AS (SELECT 'site' || s_suppkey AS needle, s_suppkey AS ordinal FROM supplier UNION ALL SELECT 'pool.example', 1000000),
 d AS (SELECT DISTINCT domain FROM v_dns)
SELECT domain, (SELECT arg_min(needle, ordinal) FROM l WHERE contains(domain, needle)) AS listed FROM d""", ("v_dns",))
def _(spark, sf):
    k = F.col("s_suppkey")
    lst = v.table(spark, sf, "supplier").select(F.concat(F.lit("site"), k).alias("needle"), k.alias("ordinal"))
    lst = lst.unionByName(spark.createDataFrame([("pool.example", 1_000_000)], "needle string, ordinal bigint"))
    return first_listed_match(v.dns(spark, sf).select("domain").distinct(), "domain", lst, "listed").select("domain", "listed")


# --- vectors --------------------------------------------------------------------------

@R.add("vector_top_k", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 10""")
def _(spark, sf):
    e = v.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    q = e.where("doc_id = 0").select("embedding").scalar()
    return out(vectors.top_k(e, q, 10), "doc_id", "similarity")


@R.add("vector_top_k_filtered", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3)
SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM embeddings, q WHERE label = 2 ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 5""")
def _(spark, sf):
    e = v.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    q = e.where("doc_id = 3").select("embedding").scalar()
    return out(vectors.top_k(e, q, 5, {"label": 2}), "doc_id", "similarity")


@R.add("vector_index_top_k", """
WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id IN (0, 7, 123))
SELECT query, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM embeddings, q
QUALIFY row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id) <= 10""")
def _(spark, sf):
    """Searches through an index over all vectors; its pruning leaves nothing out."""
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    index = vector_index.build(e, lists=16, sample=5_000)
    asked = {r["doc_id"]: r["embedding"] for r in e.where("doc_id IN (0, 7, 123)").collect()}
    parts = [vector_index.search(index, q, 10).rows.select(F.lit(i).cast("bigint").alias("query"), "doc_id", "similarity") for i, q in sorted(asked.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return out(both)


@R.add("vector_context_block", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 5),
 s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS c, vec_id % 3 AS part FROM embeddings, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY c DESC, vec_id) AS k FROM s)
SELECT part AS section, k AS rank, vec_id AS doc_id, round(c, 6) AS similarity FROM r WHERE k <= CASE part WHEN 1 THEN 3 ELSE 5 END""")
def _(spark, sf):
    e = v.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id").withColumn("text", F.concat(F.lit("t"), F.col("doc_id")))
    q = e.where("doc_id = 5").select("embedding").scalar()
    parts = [e.where(F.col("doc_id") % 3 == i) for i in range(3)]
    return out(vectors.context_block(*parts, q), "section", "rank", "doc_id", "similarity")


@R.add("vector_upsert", """
WITH d AS (SELECT substr(sha256(text), 1, 24) AS id, max({'o': doc_id, 's': source}) AS m FROM documents GROUP BY text) SELECT id AS doc_id, m.s AS metadata, m.o AS updated_at FROM d""")
def _(spark, sf):
    rows = v.table(spark, sf, "documents").select("text", F.array(F.lit(0.0)).alias("embedding"), F.col("source").alias("metadata"), F.col("doc_id").alias("updated_at"))
    got = vectors.upsert_by_content(rows.where("updated_at % 2 = 0"), rows.where("updated_at % 2 = 1"))
    return got.select("doc_id", "metadata", "updated_at")


@R.add("finding_text_lines", """
SELECT fingerprint, '[' || upper(severity) || '] ' || activity_type || ' | ' || description || ' | Indicators: ' || asset || ', ' || peer || ':443 | MITRE: ' || t1 || ', ' || t2 || ' | Agent: ' || agent AS line FROM v_finding""", ("v_finding",))
def _(spark, sf):
    return v.findings(spark, sf).select("fingerprint", vectors.finding_text().alias("line"))


@R.add("baseline_and_intel_lines", """
SELECT 'Baseline (net) | total_nodes: ' || s_suppkey || CASE WHEN s_nationkey > 0 THEN ' | internal_nodes: ' || s_nationkey ELSE '' END || ' | description: ' || s_name AS baseline,
  '[' || s_name || '] feed | IOCs: i' || s_suppkey || ', j | TTPs: T1' AS intel FROM supplier WHERE s_suppkey > 0""")
def _(spark, sf):
    s = v.table(spark, sf, "supplier").where("s_suppkey > 0")
    b = s.select(F.lit("net").alias("type"), F.col("s_suppkey").alias("total_nodes"), F.col("s_nationkey").alias("internal_nodes"), F.col("s_name").alias("description"), F.col("s_name").alias("nm"), "s_suppkey")
    line = b.withColumn("baseline", vectors.baseline_text(b.columns))
    i = line.select("baseline", F.col("nm").alias("source"), F.lit("feed").alias("type"), F.lit("").alias("description"),
                    F.array(F.concat(F.lit("i"), F.col("s_suppkey")), F.lit("j")).alias("iocs"), F.array(F.lit("T1")).alias("ttps"))
    return i.select("baseline", vectors.intel_text().alias("intel"))


# --- reports and stored rows -------------------------------------------------------------

@R.add("finding_summary", """
WITH f AS (SELECT * FROM v_finding WHERE fingerprint NOT IN (SELECT fingerprint FROM v_finding WHERE asset = '10.0.0.3'))
SELECT 'severity' AS facet, severity AS value, count(*) AS findings FROM f GROUP BY 2 UNION ALL SELECT 'agent', agent, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM f""", ("v_finding",))
def _(spark, sf):
    f = v.findings(spark, sf)
    gone = f.where(F.array_contains("affected_assets", "10.0.0.3")).select("fingerprint")
    return out(reports.finding_summary(f, reports.dismiss(gone, gone)))


@R.add("finding_filter", """
SELECT fingerprint, agent, severity, epoch_us(ts) AS created_at FROM v_finding WHERE agent = 'impact_hunter' AND sev >= 2 ORDER BY ts DESC, fingerprint LIMIT 50""", ("v_finding",))
def _(spark, sf):
    return out(reports.filter_findings(v.findings(spark, sf), agent="impact_hunter", min_severity="high", limit=50), "fingerprint", "agent", "severity", "created_at")


@R.add("report_techniques", "SELECT t AS technique, count(*) AS findings FROM (SELECT unnest([t1, t2]) AS t FROM v_finding) GROUP BY 1", ("v_finding",))
def _(spark, sf):
    return out(reports.report_techniques(v.findings(spark, sf)))


@R.add("report_findings_by_severity", "SELECT fingerprint, severity, sev AS severity_rank, round(confidence, 6) AS confidence FROM v_finding", ("v_finding",))
def _(spark, sf):
    return out(reports.findings_by_severity(v.findings(spark, sf)), "fingerprint", "severity", "severity_rank", "confidence")


@R.add("summary_top_ports", "SELECT CAST(destination_port AS BIGINT) AS destination_port, count(*) AS connections FROM v_conn GROUP BY 1 ORDER BY connections DESC, destination_port LIMIT 10", ("v_conn",))
def _(spark, sf):
    return out(reports.top_ports(v.connections(spark, sf)))


@R.add("summary_endpoints", "SELECT count(*) AS connections, count(DISTINCT source_ip) AS unique_sources, count(DISTINCT destination_ip) AS unique_destinations FROM v_conn", ("v_conn",))
def _(spark, sf):
    return out(reports.endpoint_counts(v.connections(spark, sf)))


@R.add("summary_states", "SELECT conn_state, count(*) AS connections FROM v_conn GROUP BY 1", ("v_conn",))
def _(spark, sf):
    return out(reports.state_distribution(v.connections(spark, sf)))


@R.add("summary_parent_domains", """
SELECT string_split(domain, '.')[-2] || '.' || string_split(domain, '.')[-1] AS parent_domain, count(*) AS queries FROM v_dns GROUP BY 1 ORDER BY queries DESC, parent_domain LIMIT 10""", ("v_dns",))
def _(spark, sf):
    return out(reports.top_parent_domains(v.dns(spark, sf)))


@R.add("summary_ntlm", "SELECT count(*) AS events, count(DISTINCT hostname) AS unique_hosts FROM v_ntlm", ("v_ntlm",))
def _(spark, sf):
    return out(reports.ntlm_summary(v.ntlm(spark, sf)))


@R.add("summary_alert_categories", "SELECT 'cat' || (event_id % 6) AS category, count(*) AS alerts FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, sf):
    return out(reports.alert_categories(_alerts(spark, sf)))


@R.add("cycle_event_counts", "SELECT event_id // 1000 AS cycle, event_type AS data_type, count(*) AS events FROM events GROUP BY ROLLUP (1, 2)")
def _(spark, sf):
    e = v.table(spark, sf, "events").select(F.floor(F.col("event_id") / 1000).alias("cycle"), F.col("event_type").alias("data_type"))
    return out(reports.cycle_counts(e))


@R.add("cycle_latest", "SELECT max(event_id // 1000) AS cycle FROM events")
def _(spark, sf):
    return out(reports.latest_cycle(v.table(spark, sf, "events").select(F.floor(F.col("event_id") / 1000).alias("cycle"))))


_CYC = """c AS (SELECT user_id AS cycle, max({'t': ts, 's': ['pending', 'in_progress', 'complete'][1 + CAST(event_id % 3 AS INT)]}).s AS status FROM events GROUP BY 1)"""


def _cycles(spark, sf):
    s = F.element_at(F.array(*[F.lit(x) for x in ("pending", "in_progress", "complete")]), (F.col("event_id") % 3 + 1).cast("int"))
    return v.table(spark, sf, "events").select(F.col("user_id").alias("cycle"), s.alias("status"), F.col("ts").alias("at"))


@R.add("cycle_queue_status", f"WITH {_CYC} SELECT status, count(*) AS cycles, min(cycle) AS first_cycle, max(cycle) AS last_cycle FROM c GROUP BY 1")
def _(spark, sf):
    return out(reports.queue_status(_cycles(spark, sf)))


@R.add("cycle_next_pending", f"WITH {_CYC} SELECT min(cycle) AS cycle FROM c WHERE status = 'pending'")
def _(spark, sf):
    return out(reports.next_pending(_cycles(spark, sf)))


@R.add("hunt_statistics", """
SELECT count(*) AS total_hunts, count(*) FILTER (value / 100 > 0.5) AS total_detections, count(*) FILTER (value / 100 >= 0.7) AS high_confidence_detections,
  round(count(*) FILTER (value / 100 > 0.5) / count(*), 6) AS detection_rate, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0), 6) AS hunts_per_hour FROM events""")
def _(spark, sf):
    a = v.table(spark, sf, "events").select((F.col("value") / 100).alias("final_confidence"), F.col("ts").cast("timestamp").alias("window_start"))
    return out(reports.hunt_statistics(a))


@R.add("most_active_agents", "SELECT activity_type AS agent, count(*) AS activations FROM v_finding GROUP BY 1 ORDER BY activations DESC, agent LIMIT 5", ("v_finding",))
def _(spark, sf):
    return out(reports.most_active_agents(v.findings(spark, sf).select(F.col("activity_type").alias("agent"))))


@R.add("source_event_counts", "SELECT event_type, count(*) AS events FROM events WHERE event_type LIKE '%i%' GROUP BY 1")
def _(spark, sf):
    return out(reports.source_counts(v.table(spark, sf, "events"), "event_type", "%i%"))


@R.add("source_field_coverage", """
WITH w AS (SELECT l_returnflag AS flag, count(*) AS events, count(CASE WHEN l_quantity > 10 THEN 1 END) AS quantity, count(CASE WHEN l_discount > 0.03 THEN 1 END) AS discount FROM lineitem GROUP BY 1)
SELECT flag, events, 'quantity' AS field, quantity AS present, round(quantity / events, 6) AS coverage FROM w UNION ALL SELECT flag, events, 'discount', discount, round(discount / events, 6) FROM w""")
def _(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_quantity") > 10, 1).alias("quantity"), F.when(F.col("l_discount") > 0.03, 1).alias("discount"))
    return out(reports.field_coverage(rows, "flag"))


# --- rules ---------------------------------------------------------------------------------

def process_logs(spark, sf):
    k = F.col("event_id")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    return v.table(spark, sf, "events").select(
        F.concat(F.lit("host"), F.col("user_id")).alias("hostname"),
        pick(("C:\\Windows\\cmd.exe", "C:\\Tools\\PsExec.exe", "C:\\Windows\\explorer.exe", "C:\\Windows\\System32\\rundll32.exe"), k % 4).alias("process_name"),
        pick(("notepad a.txt", "PSEXEC \\\\srv", "winexe run", "dir", "whoami"), k % 5).alias("command_line"),
        pick(("C:\\Office\\WINWORD.EXE", "C:\\Windows\\explorer.exe", "D:\\o\\excel.exe"), k % 3).alias("parent_process"),
        F.col("ts").cast("timestamp").alias("timestamp"))


def script_logs(spark, sf):
    return v.table(spark, sf, "documents").select(
        F.concat(F.lit("host"), F.col("doc_id") % 50).alias("hostname"), F.col("text").alias("command_line"), F.lit(None).cast("timestamp").alias("timestamp"))


@R.add("rule_scan_processes", """
SELECT 'remote-service-execution' AS rule_id, 'high' AS level, count(*) AS matches FROM events WHERE event_id % 4 = 1 OR event_id % 5 IN (1, 2)
UNION ALL SELECT 'office-child-process', 'high', count(*) FROM events WHERE event_id % 3 IN (0, 2) AND event_id % 4 IN (0, 3)""")
def _(spark, sf):
    got = sigma.scan_summary({"process_logs": process_logs(spark, sf)}, sigma.SHIPPED_RULES)
    return out(got, "rule_id", "level", "matches")


@R.add("rule_scan_dns", """
SELECT 'site-tld' AS rule_id, count(*) AS matches FROM v_dns WHERE ends_with(domain, '.org') AND NOT starts_with(domain, 'www.site1')
UNION ALL SELECT 'pool-or-tunnel', count(*) FROM v_dns WHERE contains(domain, 'pool') OR regexp_matches(domain, '\\.tun[0-2]\\.net$')
UNION ALL SELECT 'subnet', count(*) FROM v_dns WHERE starts_with(source_ip, '10.0.1.')
UNION ALL SELECT 'one-of-them', count(*) FROM v_dns WHERE (CASE WHEN domain LIKE '%.com' THEN 1 ELSE 0 END) + (CASE WHEN response_code = 'NXDOMAIN' THEN 1 ELSE 0 END) >= 1
UNION ALL SELECT 'all-of-pair', count(*) FROM v_dns WHERE domain LIKE '%.com' AND response_code = 'NXDOMAIN'""", ("v_dns",))
def _(spark, sf):
    r = lambda i, sel, cond: sigma.Rule(i, i, "low", "dns_query", sel, cond)
    rules = (
        r("site-tld", {"tld": {"domain|endswith": ".ORG"}, "skip": {"domain|startswith": "www.site1"}}, "tld and not skip"),
        r("pool-or-tunnel", {"a": {"query|contains": ["POOL", "nothing"]}, "b": {"domain|re": r"\.tun[0-2]\.net$"}}, "(a or b)"),
        r("subnet", {"net": {"source_ip|cidr": "10.0.1.0/24"}}, "net"),
        r("one-of-them", {"com": {"domain": "*.com"}, "nx": {"response_code": "nxdomain"}}, "1 of them"),
        r("all-of-pair", {"sel_a": {"domain": "*.com"}, "sel_b": {"response_code": "nxdomain"}}, "all of sel_*"),
    )
    return out(sigma.scan_summary({"dns_queries": v.dns(spark, sf)}, rules), "rule_id", "matches")


@R.add("rule_scan_texts", """
SELECT 'two-words' AS rule_id, count(*) AS matches, least(count(*), 100) AS match_count FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')
UNION ALL SELECT 'keyword', count(*), least(count(*), 100) FROM documents WHERE contains(lower(text), 'copyright') OR contains(lower(text), '@')""")
def _(spark, sf):
    r = lambda i, sel, cond: sigma.Rule(i, i, "low", "ps_script", sel, cond)
    rules = (r("two-words", {"s": {"ScriptBlockText|contains|all": ["the", "License"]}}, "s"), r("keyword", {"k": ["Copyright", "@"]}, "k"))
    return out(sigma.scan_summary({"powershell_logs": script_logs(spark, sf)}, rules), "rule_id", "matches", "match_count")


@R.add("rule_matches", """
SELECT 'remote-service-execution' AS rule_id, 'host' || user_id AS hostname, epoch_us(ts) AS seen FROM events WHERE event_id % 4 = 1 OR event_id % 5 IN (1, 2)
UNION ALL SELECT 'office-child-process', 'host' || user_id, epoch_us(ts) FROM events WHERE event_id % 3 IN (0, 2) AND event_id % 4 IN (0, 3)""")
def _(spark, sf):
    m = sigma.scan({"process_logs": process_logs(spark, sf)}, sigma.SHIPPED_RULES)
    return out(m.select("rule_id", F.get_json_object("event", "$.hostname").alias("hostname"), F.unix_micros("timestamp").alias("seen")))


_TLDS = ("a.tk", "b.com", "c.XYZ", "d.org", "tk.net")
_SCRIPTS = ("Set-MpPreference -x", "iwr http://h/p", "powershell -enc aQB3", "Get-Item", "(New-Object Net.WebClient).DownloadString('u')", "add-mppreference -EncodedCommand e")
_KEYS = ("HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x", "HKCU\\Software\\x", "HKCU\\a\\currentversion\\explorer\\shell folders")
_COMMANDS = ("notepad", "SCHTASKS /run", "cmd /create", "register-scheduledtask -x")


def shipped_logs(spark, sf):
    """A log for every data type that the shipped rules look at."""
    e = v.table(spark, sf, "events")
    k = F.col("event_id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    common = (F.concat(F.lit("host"), F.col("user_id")).alias("hostname"), k.cast("string").alias("event"), F.col("ts").cast("timestamp").alias("timestamp"))
    return {
        "authentication_logs": e.select(*common, F.when(k % 3 == 0, "failure").otherwise("success").alias("result"),
                                        F.when(k % 7 == 0, "0xc0000064").alias("SubStatus")),
        "process_logs": process_logs(spark, sf),
        "dns_queries": e.select(*common, pick(_TLDS).alias("domain")),
        "powershell_logs": e.select(*common, pick(_SCRIPTS).alias("command_line")),
        "registry_changes": e.select(*common, pick(_KEYS).alias("key_path"), F.lit("v").alias("value_data")),
        "scheduled_tasks": e.select(*common, pick(_COMMANDS).alias("command"), F.when(k % 5 == 0, "created").otherwise("deleted").alias("event_type")),
    }


def _first_five(where):
    return f"(SELECT string_agg(event_id::VARCHAR, ',' ORDER BY ts, 'host' || user_id, event_id::VARCHAR) FROM (SELECT * FROM events WHERE {where} ORDER BY ts, 'host' || user_id, event_id::VARCHAR LIMIT 5))"


_SHIPPED = (
    ("defender-tampering", "critical", "powershell_logs", "event_id % 6 IN (0, 5)"),
    ("auth-failed-logon", "high", "authentication_logs", "event_id % 3 = 0 AND event_id % 7 <> 0"),
    ("autorun-key-change", "high", "registry_changes", "event_id % 3 IN (0, 2)"),
    ("scheduled-task-created", "high", "scheduled_tasks", "event_id % 5 = 0 OR event_id % 4 IN (1, 2, 3)"),
    ("script-download", "high", "powershell_logs", "event_id % 6 IN (1, 4)"),
    ("script-encoded-command", "high", "powershell_logs", "event_id % 6 IN (2, 5)"),
    ("abused-tld-lookup", "medium", "dns_queries", "event_id % 5 IN (0, 2)"),
    ("remote-service-execution", "high", "process_logs", "event_id % 4 = 1 OR event_id % 5 IN (1, 2)"),
    ("office-child-process", "high", "process_logs", "event_id % 3 IN (0, 2) AND event_id % 4 IN (0, 3)"),
)


@R.add("rule_scan_shipped", " UNION ALL ".join(
    f"SELECT '{i}' AS rule_id, '{level}' AS level, '{t}' AS data_type, count(*) AS matches, least(count(*), 100) AS match_count, "
    + ("NULL" if t == "process_logs" else _first_five(where)) + f" AS first_events FROM events WHERE {where} HAVING count(*) > 0"
    for i, level, t, where in _SHIPPED))
def _(spark, sf):
    """All nine shipped rules over six logs, with the events that a report shows."""
    got = sigma.scan_summary(shipped_logs(spark, sf), sigma.SHIPPED_RULES)
    events = F.array_join(F.transform("sample_events", lambda s: F.get_json_object(s, "$.event")), ",")
    return out(got.withColumn("first_events", F.when(F.col("data_type") != "process_logs", events)),
               "rule_id", "level", "data_type", "matches", "match_count", "first_events")


@R.add("rule_listing", """
SELECT 'auth-failed-logon' AS id, 'high' AS level, 'authentication_logs' AS data_type, 'credential_access' AS tactics, 'T1110.001,T1110.003' AS techniques, (SELECT count(*) FROM events WHERE event_id % 3 = 0 AND event_id % 7 <> 0) AS matches
UNION ALL SELECT 'autorun-key-change', 'high', 'registry_changes', 'persistence', 'T1547.001', (SELECT count(*) FROM events WHERE event_id % 3 IN (0, 2))
UNION ALL SELECT 'abused-tld-lookup', 'medium', 'dns_queries', 'command_and_control', 'T1071.004', (SELECT count(*) FROM events WHERE event_id % 5 IN (0, 2))
UNION ALL SELECT 'scheduled-task-created', 'high', 'scheduled_tasks', 'persistence,execution', 'T1053.005', (SELECT count(*) FROM events WHERE event_id % 5 = 0 OR event_id % 4 IN (1, 2, 3))""")
def _(spark, sf):
    """Rules with their tactics and techniques beside what they matched."""
    types = ("authentication_logs", "registry_changes", "dns_queries", "scheduled_tasks")
    logs = {t: df for t, df in shipped_logs(spark, sf).items() if t in types}
    listed = sigma.rule_list(spark, [r for r in sigma.SHIPPED_RULES if r.data_type in types])
    found = sigma.scan(logs, sigma.SHIPPED_RULES).groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"))
    got = listed.join(found, F.col("id") == F.col("rule_id"))
    return out(got.withColumns({c: F.array_join(c, ",") for c in ("tactics", "techniques")}), "id", "level", "data_type", "tactics", "techniques", "matches")
