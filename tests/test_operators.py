"""Correlation, map, identity, rules, learning and helpers on small frames."""

import itertools
import json
import math
import random
from collections import Counter

import pytest
from conftest import ts
from pyspark.sql import functions as F

from netquarry.functions import net, text, times
from netquarry.operators import cases, context, correlate, devices, findings, gateways, intel, learning, netmap, normalize, packets, profiles, rollup, selection, sigma
from netquarry.operators.common import first_listed_match, following, smallest_values, substring_matches, top_rows
from netquarry.config import HuntConfig
from netquarry.plans import hunt
from netquarry.session import stage


def column(frame, values, fn, ddl="string"):
    df = frame([(v,) for v in values], f"x {ddl}")
    return [r[0] for r in df.select(fn("x")).collect()]


def test_entropy_matches_the_formula(frame):
    words = ["", "aaaa", "abcd", "AbcD12", "0f3c9d1e", "ééa", None]

    def ref(s):
        if s is None:
            return None
        n = len(s)
        return -sum(c / n * math.log2(c / n) for c in Counter(s.lower()).values()) if n else 0.0

    got = column(frame, words, text.shannon_entropy)
    for a, b in zip(got, map(ref, words)):
        assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


def test_domain_parts(frame):
    assert column(frame, ["a.b.c.d", "b.c", "c", None], text.subdomain) == ["a.b", None, None, None]
    assert column(frame, ["a.b.c.d", "b.c", "c"], text.parent_domain) == ["c.d", "b.c", None]


def test_addresses(frame):
    ips = ["10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "8.8.8.8", "", None, "127.0.0.1", "169.254.1.1", "256.1.1.1", "x.y.z.w"]
    assert column(frame, ips, net.is_internal) == [True, True, False, True] + [False] * 7
    assert column(frame, ips, net.is_enrichable) == [False, False, True, False, True] + [False] * 6


@pytest.mark.parametrize("cidr", ["10.0.0.0/8", "10.16.0.0/12", "203.0.113.64/26", "1.2.3.4/32", "0.0.0.0/0", "10.0.0.128/25"])
def test_cidr_against_the_standard_library(frame, cidr):
    import ipaddress

    rng = random.Random(cidr)
    ips = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(60)]
    ips += [str(ipaddress.ip_address((int(ipaddress.ip_network(cidr).network_address) + d) % 2**32)) for d in (-1, 0, 1, 63, 64, 127, 128)]
    want = [ipaddress.ip_address(i) in ipaddress.ip_network(cidr) for i in ips]
    assert column(frame, ips, lambda c: net.in_cidr(c, cidr)) == want


def test_timestamps(frame):
    got = column(frame, ["1700000000.5", "2023-11-14T22:13:20Z", "2023-11-15T00:13:20+02:00", "2023-11-15T00:13:20+0200", "2023-11-14", "nonsense", None],
                 lambda c: F.unix_micros(times.parse_timestamp(c)))
    assert got == [1700000000500000, 1700000000000000, 1700000000000000, 1700000000000000, 1699920000000000, None, None]
    assert times.range_hours("-2mon") == 1440 and times.range_hours("-30m") == 0.5
    with pytest.raises(ValueError):
        times.range_hours("7d")


def test_substring_join_is_exact(frame):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc.") for _ in range(rng.randint(1, 14))) for _ in range(80)]
    needles = ["".join(rng.choice("abc.") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    got = {tuple(r) for r in substring_matches(frame([(t,) for t in texts], "t string"), "t", frame([(n,) for n in needles], "n string"), "n", gram=4).select("t", "n").collect()}
    assert got == {(t, n) for t in texts for n in needles if n in t}


def test_substring_matches_cuts_texts_to_the_sizes_of_needles(frame):
    texts, needles = frame([("host.example",), ("short",), ("",), (None,)], "t string"), frame([("host.ex",), ("example",), ("",), (None,)], "n string")
    got = substring_matches(texts, "t", needles, "n")
    assert {tuple(r) for r in got.collect()} == {("host.example", "host.ex"), ("host.example", "example")}
    assert "least(length(t#" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert substring_matches(texts, "t", needles.where("n = ''"), "n").isEmpty()


def test_first_listed_match_keeps_duplicates(frame):
    df = frame([("a.pool.x",), ("a.pool.x",), ("none",)], "d string")
    lst = frame([("pool", 2), ("a.", 1)], "needle string, ordinal int")
    got = Counter((r.d, r.m) for r in first_listed_match(df, "d", lst, "m").collect())
    assert got == {("a.pool.x", "a."): 2, ("none", None): 1}


def test_salted_top_rows_equal_the_plain_ones(frame):
    rng = random.Random(6)
    rows = [("hot", rng.randint(0, 300), i) for i in range(3000)] + [("cold", 1, i) for i in range(3)]
    df = frame(rows, "k string, n int, id int")
    order = [F.desc("n"), F.asc("id")]
    plain, salted = (sorted(map(tuple, top_rows(df, ["k"], order, 50, salted=s).collect())) for s in (False, True))
    assert plain == salted and len(plain) == 53
    assert top_rows(df, ["k"], order, 2000).count() == 2003


def test_following_does_not_depend_on_buckets(frame):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), float(rng.randint(0, 4000)), i) for i in range(300)]
    df = frame(rows, "k string, t double, id int")
    want = {}
    for k in "ab":
        mine = sorted((t, i) for kk, t, i in rows if kk == k)
        want.update({a[1]: (b[1] if b else None) for a, b in zip(mine, [*mine[1:], None])})
    for bucket in (3, 500, 10**9):
        got = following(df, ["k"], ["t", "id"], ["id"], "nx", F.col("t"), bucket)
        assert {r.id: r.nx.id if r.nx else None for r in got.collect()} == want


def test_smallest_values_per_key(frame):
    rows = [("k", str(i % 40).zfill(2)) for i in range(400)] + [("m", None)]
    got = {r.k: r.v for r in smallest_values(frame(rows, "k string, x string"), ["k"], "x", 3, "v").collect()}
    assert got == {"k": ["00", "01", "02"]}


def test_dedup_is_idempotent_and_prefers_the_first_source(frame):
    a = frame([("x", 1, "a"), ("x", 1, "b"), ("y", 2, "c")], "k string, t int, v string")
    b = frame([("x", 1, "A"), ("z", 3, "d")], "k string, t int, v string")
    once = normalize.dedup(normalize.merge_sources([a, b]), ["k", "t"])
    twice = normalize.dedup(once, ["k", "t"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert {(r.k, r.v) for r in once.collect()} == {("x", "a"), ("y", "c"), ("z", "d")}


# --- correlation --------------------------------------------------------------

OUT = "agent string, confidence double, findings int, mitre_techniques array<string>, severity string, mitre_tactics array<string>, recommended_actions array<string>"


def outputs(frame, rows):
    tactics = {"c2_hunter": ["TA0011"], "reconnaissance_hunter": ["TA0043", "TA0007"], "collection_exfiltration_hunter": ["TA0009", "TA0010"],
               "lateral_movement_hunter": ["TA0008"], "impact_hunter": ["TA0040"]}
    return frame([(a, c, 1, t, s, tactics[a], ["do"]) for a, c, t, s in rows], OUT)


def test_corroboration_counts_other_families(frame):
    rows = [("c2_hunter", 0.5, ["T1", "T2"], "high"), ("impact_hunter", 0.5, ["T1"], "low"), ("lateral_movement_hunter", 0.9, ["T1", "T2"], "low")]
    got = {r.agent: (r.corroborations, r.boosted_confidence) for r in correlate.corroborate(outputs(frame, rows)).collect()}
    assert got["c2_hunter"][0] == 3 and got["c2_hunter"][1] == pytest.approx(0.8)
    assert got["impact_hunter"] == (2, pytest.approx(0.7)) and got["lateral_movement_hunter"][1] == 1.0


def test_progression(frame):
    rows = [(["TA0009", "TA0010"],), (["TA0043", "TA0007"],), (["TA0011"],), ([],), (["TA0008", "TA0009", "TA0010"],), (["TA0010", "TA0009"],)]
    got = [r[0] for r in frame(rows, "t array<string>").select(correlate.is_progression(F.col("t"))).collect()]
    assert got == [True, False, False, False, True, False]


def test_assessment_of_one_and_of_two_strong_families(frame):
    one = correlate.assess(outputs(frame, [("collection_exfiltration_hunter", 0.62, ["T1041"], "high")])).first()
    assert one.final_confidence == pytest.approx(0.93) and one.alert_level == "critical" and one.correlation_score == 0
    two = correlate.assess(outputs(frame, [("c2_hunter", 0.75, ["T1"], "medium"), ("impact_hunter", 0.8, ["T2"], "critical")])).first()
    assert two.final_confidence == pytest.approx(0.88) and two.severity == "critical" and two.corroborating_agents == 2
    assert "Analyst review recommended within 1 hour" in two.recommendations and "do" in two.recommendations


def test_false_positive_rates_dampen(frame):
    rates = frame([("c2_hunter", 0.4)], "agent string, false_positive_rate double")
    got = correlate.assess(outputs(frame, [("c2_hunter", 0.5, ["T1"], "medium")]), fp_rates=rates).first()
    assert got.final_confidence == pytest.approx(0.4)


def test_dedup_findings_keeps_the_more_confident_family(frame):
    rows = [("c2_hunter", "f1", 0.2, {"a": "1"}), ("c2_hunter", "f2", 0.6, None), ("impact_hunter", "f1", 0.9, None), ("impact_hunter", "f1", 0.8, None)]
    got = correlate.dedup_findings(frame(rows, "agent string, fingerprint string, confidence double, evidence map<string,string>"))
    assert {(r.agent, r.fingerprint, r.confidence) for r in got.collect()} == {("c2_hunter", "f2", 0.6), ("impact_hunter", "f1", 0.9)}


@pytest.mark.parametrize("agent,conf,n,want", [("c2_hunter", 0.81, 1, "critical"), ("c2_hunter", 0.6, 1, "medium"), ("reconnaissance_hunter", 0.1, 3, "high"),
                                               ("reconnaissance_hunter", 0.1, 1, "low"), ("impact_hunter", 0.5, 1, "high"), ("lateral_movement_hunter", 0.61, 1, "high")])
def test_family_severity(frame, agent, conf, n, want):
    assert frame([(agent, conf, n)], "agent string, confidence double, findings int").select(rollup.agent_severity()).first()[0] == want


def test_hypotheses_rules_and_baselines(frame):
    hunts = frame([(1, []), (2, []), (3, ["apt"])], "hunt_id int, active_campaigns array<string>")
    signals = frame([(1, "Lateral recon credential", 0.4), (1, "noise", 0.9)], "hunt_id int, type string, confidence double")
    got = context.hypotheses(signals, hunts).collect()
    assert Counter(r.hunt_id for r in got) == {1: 1, 2: 3, 3: 1}
    assert next(r for r in got if r.hunt_id == 1).priority == 0.8
    picks = selection.adaptive(
        frame([(2, 0, 0, True, 0)], "hunt_id int, critical_assets int, privileged_sessions int, is_business_hours boolean, total_alerts_24h int"),
        context.hypotheses(signals, hunts))
    assert {r.agent for r in picks.collect()} == set(selection.AGENTS)


def test_anomaly_needs_ten_windows(frame):
    rows = [(i, 10, 100) for i in range(9)] + [(9, 50, 100)] + [(10, 10, 100), (11, 11, 5000)]
    got = context.anomalies(frame(rows, "w int, total_alerts_24h int, connection_count int"), "w").collect()
    assert {(r.w, r.type) for r in got} == {(9, "alert_volume_spike"), (11, "connection_spike")}


# --- cases ---------------------------------------------------------------------

def test_open_case_match_needs_both_overlaps(frame):
    case = "case_id string, status string, confidence double, mitre_techniques array<string>, created_at timestamp"
    old = frame([("o1", "new", 0.5, ["T1"], ts(0)), ("o2", "investigating", 0.5, ["T1"], ts(60)), ("o3", "closed", 0.5, ["T1"], ts(90)),
                 ("o4", "new", 0.5, ["T9"], ts(80)), ("o5", "new", 0.5, ["T1"], ts(-90_000))], case)
    assets = frame([(c, "h") for c in ("o1", "o2", "o3", "o4", "o5")], "case_id string, asset string")
    new = frame([("n1", "new", 0.9, ["T1", "T2"], ts(100)), ("n2", "new", 0.9, ["T1"], ts(100))], case)
    new_assets = frame([("n1", "h"), ("n2", "other")], "case_id string, asset string")
    index = cases.open_case_index(old, assets, ts(100).isoformat(), 24)
    matches = cases.match_open_cases(new, new_assets, index)
    assert [tuple(r) for r in matches.collect()] == [("n1", "o2")]
    updated, fresh = cases.merge_cases(old, new, matches)
    assert {r.case_id: r.confidence for r in updated.collect()}["o2"] == 0.9
    assert [r.case_id for r in fresh.collect()] == ["n2"]


@pytest.mark.parametrize("conf,want", [(0.95, "auto_respond"), (0.949, "auto_investigate"), (0.8, "auto_investigate"), (0.6, "human_review"), (0.59, "log_only")])
def test_escalation(frame, conf, want):
    assert frame([(conf,)], "c double").select(cases.escalation(F.col("c"))).first()[0] == want


def test_calibration_on_six_hundred_points(frame):
    rng = random.Random(4)
    pts = [(i, round(rng.random(), 3), rng.choice(["tp", "fp", "uncertain"])) for i in range(600)]
    points = learning.calibration_points(frame(pts, "n int, confidence double, verdict string"), ("n",))
    assert points.count() == 500
    probes = [0.05, 0.35, 0.8, 1.0]
    got = {r.confidence: (r.near, r.factor) for r in learning.calibration_factors(frame([(p,) for p in probes], "confidence double"), points).collect()}
    val = {"tp": 1.0, "fp": 0.0, "uncertain": 0.5}
    for p in probes:
        near = [val[v] for _, c, v in pts[100:] if abs(round(c * 1e6) - round(p * 1e6)) <= 100_000]
        assert got[p][0] == len(near)
        assert got[p][1] == pytest.approx(max(0.5, min(1.5, sum(near) / len(near) / p)))
    few = learning.calibration_points(frame(pts[:9], "n int, confidence double, verdict string"), ("n",))
    assert learning.calibration_factors(frame([(0.5,)], "confidence double"), few).first().factor == 1.0


def test_precision_default_and_seed(frame):
    rows = [("T1", "tp"), ("T1", "tp"), ("T1", "fp"), ("T2", "uncertain")]
    seed = frame([("T1", 1, 0, 0), ("T3", 0, 2, 0)], "technique_id string, true_positives bigint, false_positives bigint, uncertain bigint")
    got = {r.technique_id: r.precision for r in learning.technique_precision(frame(rows, "technique_id string, verdict string"), seed).collect()}
    assert got == {"T1": 0.75, "T2": 0.5, "T3": 0.0}


def test_enrichment_queue(frame):
    f = frame([(["8.8.8.8:53", "10.0.0.1", "name"], ["1.1.1.1"])], "indicators array<string>, affected_assets array<string>")
    done, queued = frame([("1.1.1.1",)], "ip string"), frame([("9.9.9.9",)], "ip string")
    assert [r.ip for r in intel.new_queue_entries(f, done, queued).collect()] == ["8.8.8.8"]


def test_enrichment_takes_addresses_by_their_shape(frame):
    names = [("10.0.0.1500",), ("10.0.0.1",), ("203.0.113.7",), ("203.0.113.999",), ("a.example",), (None,)]
    known = frame([("203.0.113.7", 90, 9, 12, "malicious", False), ("203.0.113.999", 0, 1, 0, None, False)],
                  "indicator string, abuse_score int, vt_malicious int, otx_pulses int, gn_classification string, gn_noise boolean")
    got = {r.indicator: (r.indicator_type, r.score, r.verdict) for r in intel.enrich(frame(names, "indicator string"), known).collect()}
    assert got == {"10.0.0.1500": ("ip", 0, "internal"), "10.0.0.1": ("ip", 0, "internal"), "203.0.113.7": ("ip", 11, "malicious"),
                   "203.0.113.999": ("ip", 1, "low_risk"), "a.example": ("domain", 0, "unknown"), None: ("domain", 0, "unknown")}


# --- map and devices -------------------------------------------------------------

CONN = "sensor_id string, vlan string, source_ip string, source_port int, destination_ip string, destination_port int, protocol string, bytes_in bigint, bytes_out bigint, timestamp timestamp"


def test_map_bytes_swap_and_increments(frame):
    rows = [("s", None, "10.0.0.1", 1000 + i, "10.0.0.2", 53, "udp", 5, 7, ts(i)) for i in range(4)]
    df = frame(rows, CONN)
    e, s = netmap.edges(df), netmap.services(df)
    got = {r.ip: r for r in netmap.nodes(e, s).collect()}
    assert (got["10.0.0.1"].bytes_sent, got["10.0.0.1"].bytes_received, got["10.0.0.1"].vlan) == (28, 20, "0")
    assert (got["10.0.0.2"].bytes_sent, got["10.0.0.2"].bytes_received) == (20, 28)
    assert got["10.0.0.1"].roles == ["client"] and got["10.0.0.2"].roles == ["dns_server"]
    halves = netmap.merge_edges(netmap.edges(frame(rows[:1], CONN)), netmap.edges(frame(rows[1:], CONN)))
    assert sorted(map(tuple, halves.select(sorted(e.columns)).collect())) == sorted(map(tuple, e.select(sorted(e.columns)).collect()))


def test_roles_at_their_limits(frame):
    rows = [("s", "0", f"10.0.{i // 200}.{i % 200}", 1, "10.9.9.9", 80, "tcp", 0, 0, ts(0)) for i in range(51)]
    rows += [("s", "0", "10.8.8.8", 1, f"10.1.{i // 200}.{i % 200}", 1, "tcp", 0, 0, ts(0)) for i in range(51)]
    got = {r.ip: r.roles for r in netmap.nodes(netmap.edges(frame(rows, CONN)), netmap.services(frame(rows, CONN))).collect()}
    assert got["10.9.9.9"] == ["popular", "server", "web_server"] and got["10.8.8.8"] == ["client", "scanner"]


def test_gateway_rules(frame):
    rows = [("s", "0", f"10.0.0.{i}", "10.0.0.1") for i in (5, 6, 7)] + [("s", "0", f"10.0.1.{i}", "10.0.1.254") for i in (5, 6)]
    rows += [("s", "0", f"10.{i}.0.9", "10.0.0.20") for i in range(1, 7)] + [("s", "0", f"10.{i}.0.9", "10.0.0.21") for i in range(1, 6)]
    e = frame(rows, "sensor_id string, vlan string, src string, dst string")
    assert [(r.ip, r.subnet) for r in gateways.subnet_gateways(e).collect()] == [("10.0.0.1", "10.0.0.0/24")]
    assert [(r.ip, r.subnets_in) for r in gateways.cross_subnet_gateways(e).collect()] == [("10.0.0.20", 6)]


def test_host_identity_ranks_candidates(frame):
    ddl = ("sensor_id string, vlan string, ip string, is_internal boolean, dhcp_vendor_class string, os_info string, software array<string>, "
           "user_agents array<string>, rdp_build int, vendor string")
    rows = [("s", "0", "10.0.0.1", True, "MSFT 10.0", "Windows 10/11", ["SSH server: OpenSSH_8 Ubuntu-3", "Windows 10 x, y"], ["Mozilla (Windows NT 10.0)"], 19045, "Dell"),
            ("s", "0", "10.0.0.2", True, None, "", ["SMTP: 220 ready"], [], None, ""),
            ("s", "0", "10.0.0.3", True, None, "", [], [], None, ""),
            ("s", "0", "203.0.113.1", False, "MSFT 10.0", "", [], [], None, "")]
    got = {r.ip: r for r in devices.host_identity(frame(rows, ddl)).collect()}
    assert set(got) == {"10.0.0.1", "10.0.0.2"}
    a = got["10.0.0.1"]
    assert (a.os, a.os_source, a.os_confidence) == ("Windows 10 22H2", "RDP Build", 92)
    # vendor class; one banner-bearing OS line; detected OS; SSH banner; agent; RDP; MAC vendor
    assert a.signal_count == 7 and a.confidence == 100
    b = got["10.0.0.2"]
    assert (b.os, b.os_confidence, b.signal_count, b.confidence) == ("Unknown", 0, 2, 24)


def test_first_maximum_wins_between_equal_candidates(frame):
    rows = [("s", "0", "10.0.0.1", True, "MSFT 5.0", ["Windows 10 Pro, x"])]
    got = devices.host_identity(frame(rows, "sensor_id string, vlan string, ip string, is_internal boolean, dhcp_vendor_class string, software array<string>")).first()
    assert (got.os, got.os_source) == ("Windows", "DHCP Vendor Class")


def test_mac_on_three_addresses(frame):
    rows = [("aa-bb-cc-00-00-01", f"10.0.0.{i}", "0", "s", n, ts(i)) for i, n in ((1, ""), (2, "PC"), (3, "-"), (1, "pc-x"))]
    b = netmap.mac_bindings(frame(rows, "mac string, ip string, vlan string, sensor_id string, host_name string, timestamp timestamp"))
    assert {(r.ip, r.hostname) for r in b.collect()} == {("10.0.0.1", "pc-x"), ("10.0.0.2", "pc"), ("10.0.0.3", "")}
    assert netmap.multi_ip_macs(b).first().ip_count == 3 and netmap.device_identity(b, "10.0.0.2").count() == 3


def test_merged_bindings_do_not_depend_on_arrival(frame):
    rows = [("aa-bb-cc-00-00-01", "10.0.0.1", "0", "s", n, ts(i)) for i, n in ((1, ""), (5, "late"), (2, "early"), (3, None))]
    leases = frame(rows, "mac string, ip string, vlan string, sensor_id string, host_name string, timestamp timestamp")
    whole = netmap.mac_bindings(leases).collect()
    parts = [netmap.mac_bindings(leases.where(F.col("host_name") == n)) for n in ("", "late", "early")]
    for order in itertools.permutations(parts):
        merged = order[0]
        for part in order[1:]:
            merged = netmap.merge_bindings(merged, part)
        assert [(r.hostname, r.named_at) for r in merged.collect()] == [(r.hostname, r.named_at) for r in whole] == [("early", ts(2).replace(tzinfo=None))]


def test_profile_value_cap_keeps_the_rest_in_the_long_form(frame):
    rows = [("10.0.0.1", f"ua{i:03d}", f"h{i}") for i in range(150)]
    log = frame(rows, "orig_h string, user_agent string, host string")
    got = profiles.run_profile(log, "http_ua", cap=10).first()
    assert len(got.user_agents) == 10 and got.http_count == 150 and got.sites_visited == 150
    assert profiles.profile_values(log, "http_ua").count() == 150


def test_enrichment_merge_keeps_what_is_not_known(frame):
    ddl = "sensor_id string, vlan string, ip string, total_connections bigint, os_info string, software array<string>"
    stored = frame([("s", "0", "a", 9, "old", ["x"]), ("s", "0", "b", 8, "old", [])], ddl)
    enriched = frame([("s", "0", "a", 1, "", ["y"]), ("s", "0", "c", 2, "new", [])], ddl)
    got = {r.ip: (r.total_connections, r.os_info, r.software) for r in devices.merge_enrichment(stored, enriched, ["os_info", "software"]).collect()}
    assert got == {"a": (9, "old", ["y"]), "b": (8, "old", []), "c": (2, "new", [])}


# --- rules ------------------------------------------------------------------------

def matches(frame, selections, condition, rows, ddl="domain string, response_code string, source_ip string"):
    rule = sigma.Rule("r", "r", "low", "dns_query", selections, condition)
    return [json.loads(r.event).get("domain") for r in sigma.match_events(frame(rows, ddl), [rule], "dns_queries").collect()]


def test_rule_conditions(frame):
    rows = [("a.com", "NXDOMAIN", "10.0.0.1"), ("b.com", "NOERROR", "10.0.0.1"), ("c.org", "NXDOMAIN", None)]
    sel = {"sel_a": {"domain|endswith": ".COM"}, "sel_b": {"Response_Code": "nx*"}, "other": {"missing": "x"}}
    expect = {"sel_a and not sel_b": ["b.com"], "1 of sel_*": ["a.com", "b.com", "c.org"], "all of sel_*": ["a.com"], "1 of them": ["a.com", "b.com", "c.org"],
              "all of them": [], "sel_a and (sel_b or other)": ["a.com"], "not sel_a": ["c.org"], "other or not (sel_a or sel_b)": []}
    for condition, want in expect.items():
        assert sorted(matches(frame, sel, condition, rows)) == want, condition


def test_rule_values(frame):
    rows = [("Ab.example", "x", "10.0.1.9"), ("zz.example", "x", "10.0.2.9"), (None, "x", "10.0.1.1")]
    assert matches(frame, {"s": {"domain|contains|all": ["AB", "exam"]}}, "s", rows) == ["Ab.example"]
    assert matches(frame, {"s": {"domain|re": r"^\Sb\."}}, "s", rows) == ["Ab.example"]
    assert matches(frame, {"s": {"source_ip|cidr": "10.0.1.0/24"}}, "s", rows) == ["Ab.example", None]
    assert matches(frame, {"s": [{"domain": "zz?example"}, {"domain|startswith": "aB"}]}, "s", rows) == ["Ab.example", "zz.example"]


def test_shipped_rules_fire_on_normalised_logs(frame):
    logs = {
        "authentication_logs": frame([("u", "failure"), ("v", "success")], "username string, result string"),
        "powershell_logs": frame([("powershell -EncodedCommand aaa",), ("Set-MpPreference -ExclusionPath c:",), ("(New-Object Net.WebClient).DownloadString('x')",)], "command_line string"),
        "process_logs": frame([("C:\\x\\cmd.exe", "C:\\o\\winword.exe", ""), ("C:\\PSEXESVC.exe", "x", "")], "process_name string, parent_process string, command_line string"),
        "registry_changes": frame([("HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x",)], "key_path string"),
        "scheduled_tasks": frame([("created", "schtasks /create")], "event_type string, command string"),
        "dns_queries": frame([("bad.TK",), ("good.org",)], "domain string"),
    }
    got = {r.rule_id: r.matches for r in sigma.scan_summary(logs, sigma.SHIPPED_RULES).collect()}
    assert got == {r.id: 1 for r in sigma.SHIPPED_RULES}
    assert [r.rule_id for r in sigma.scan_summary(logs, sigma.SHIPPED_RULES).collect()][0] == "defender-tampering"


def test_rule_report_cap_counts_everything(frame):
    rule = sigma.Rule("r", "r", "low", "dns_query", {"s": {"domain": "x"}}, "s", ("attack.t1071.004", "attack.command_and_control"))
    got = sigma.summarize(frame([("x",)] * 150, "domain string"), [rule], "dns_queries").first()
    assert (got.matches, got.match_count, len(got.sample_events)) == (150, 100, 5)
    assert rule.techniques == ["T1071.004"] and rule.tactics == ["command_and_control"]


def test_rules_from_yaml(tmp_path, frame):
    pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text("title: t\nid: i\nlevel: high\nlogsource: {category: dns_query}\ndetection:\n  s:\n    domain|endswith: [.tk]\n  condition: s\n")
    (tmp_path / "b.yml").write_text("title: u\nlogsource: {category: unknown}\ndetection: {s: {a: b}, condition: s}\n")
    rules = sigma.load_rules(str(tmp_path))
    assert [r.id for r in rules] == ["i"] and sigma.rule_list(frame([(1,)], "x int").sparkSession, rules).count() == 1


# --- packets ----------------------------------------------------------------------

def test_dns_pairing_marks_only_its_own_query(frame):
    ddl = "client string, server string, client_port int, dns_id int, is_response boolean, qname string, rcode int, time double"
    rows = [("c", "s", 1, 7, False, "a.com.", None, 1.0), ("c", "s", 2, 8, False, "b.com", None, 1.1), ("c", "s", 1, 7, True, "a.com", 3, 1.2), ("c", "s", 2, 8, True, "b.com", 0, 1.3)]
    assert {(r.domain, r.response_code) for r in packets.dns_lookups(frame(rows, ddl)).collect()} == {("a.com", "NXDOMAIN"), ("b.com", None)}


def test_http_headers(frame):
    rows = [("a", "b", "tcp", "POST /x HTTP/1.1\r\nHost: h.example\r\nUser-Agent: ua 1\r\n\r\nbody", 1.0), ("a", "b", "tcp", "PUT /x HTTP/1.1\r\n", 1.0)]
    got = packets.http_requests(frame(rows, "src string, dst string, proto string, payload string, time double")).collect()
    assert [(r.method, r.uri, r.host, r.user_agent) for r in got] == [("POST", "/x", "h.example", "ua 1")]


def test_cosine_against_python(frame):
    from netquarry.operators import vectors

    rng = random.Random(9)
    vs = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(30)] + [[0.0] * 8]
    q = vs[3]

    def cos(a, b):
        na, nb = math.hypot(*a), math.hypot(*b)
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else None

    want = sorted(((-cos(q, x), i) for i, x in enumerate(vs) if cos(q, x) is not None))[:5]
    got = vectors.top_k(frame(list(enumerate(vs)), "doc_id int, embedding array<double>"), F.array(*[F.lit(x) for x in q]), 5).collect()
    assert [r.doc_id for r in got] == [i for _, i in want]
    assert all(r.similarity == pytest.approx(-s) for r, (s, _) in zip(got, want))


def test_arm_statistics(frame):
    got = learning.arm_statistics(frame([("a", 1.0), ("a", 0.5), ("b", 0.6)], "arm string, reward double"))
    assert {r.arm: (r.pulls, r.successes, r.posterior_mean) for r in got.collect()} == {"a": (2, 1, 0.5), "b": (1, 1, pytest.approx(2 / 3))}
    assert learning.best_arm(got).first().arm == "b"


def test_jaccard_over_pairs(frame):
    sets = {"c2_hunter": ["T1", "T2"], "impact_hunter": ["T2"], "lateral_movement_hunter": []}
    rows = [(a, 0.5, t, "low") for a, t in sets.items()]
    got = correlate.technique_similarity(outputs(frame, rows)).first().correlation_score
    vals = [len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in itertools.combinations(sets.values(), 2) if set(a) | set(b)]
    assert got == pytest.approx(sum(vals) / len(vals))


def rule(selection, condition="sel", **more):
    return sigma.from_document({"title": "t", "logsource": {"category": "process_creation"}, "detection": {"sel": selection, "condition": condition, **more}})


def test_rule_timeframe_is_no_selection(frame):
    r = rule({"CommandLine": "x"}, "1 of them", timeframe="5m")
    assert list(r.selections) == ["sel"]
    rows = frame([("5 m",), ("x",)], "command_line string")
    assert sigma.match_events(rows, [r], r.data_type).count() == 1
    with pytest.raises(ValueError):
        rule("only a word")


@pytest.mark.parametrize(
    "key,pattern,hits",
    [
        ("CommandLine|contains", r"\\*\ADMIN$", [r"net use \\host\ADMIN$ x"]),
        ("CommandLine|startswith", "net?use", [r"net use \\host\ADMIN$ x"]),
        ("CommandLine|endswith", "*.exe", ["C:\\a.EXE"]),
        ("CommandLine|contains", "a.e", ["C:\\a.EXE"]),
        ("CommandLine|base64offset|contains", "http://", ["QWFodHRwOi8vYg=="]),
    ],
)
def test_rule_modifiers(frame, key, pattern, hits):
    lines = [r"net use \\host\ADMIN$ x", "C:\\a.EXE", "C:\\axe exe", "QWFodHRwOi8vYg==", None]
    r = rule({key: pattern})
    got = sigma.match_events(frame([(x,) for x in lines], "command_line string"), [r], r.data_type)
    assert [json.loads(x.event)["command_line"] for x in got.collect()] == hits


def test_ipv6_networks(frame):
    import ipaddress

    ips = ["2001:db8::1", "2001:DB8:0:0:0:0:0:1", "2001:db8:8000::", "2001:db9::1", "::1", "::", "fe80::1%eth0", "10.0.0.1", "1:2:3", "2001:db8::1::2", "12345::", "x", None,
           "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::"]
    rows = frame([(x,) for x in ips], "ip string")
    for cidr in ("2001:db8::/32", "2001:db8::/33", "::/0", "::1/128", "1:2:3:4:5:6:7:8/125", "10.0.0.0/8"):
        network = ipaddress.ip_network(cidr, strict=False)

        def inside(x):
            try:
                return "%" not in x and ipaddress.ip_address(x) in network
            except (ValueError, TypeError):
                return False

        got = {r.ip: r.ok for r in rows.select("ip", net.in_cidr("ip", cidr).alias("ok")).collect()}
        assert got == {x: inside(x) for x in ips}, cidr


def test_hunt_needs_a_name(frame):
    with pytest.raises(ValueError):
        hunt.run_hunt({}, hunt_id="h")


def test_playbooks_keep_all_techniques(frame):
    rows = frame([(["a", "b", "c", "d", "e", "f"],), (["a", "b", "c", "d", "e", "g"],)], "techniques array<string>")
    assert rows.select(learning.playbook_key(F.col("techniques")).alias("k")).distinct().count() == 2


def test_map_keeps_whole_lists(spark, frame):
    from netquarry.session import fresh_path
    from netquarry.sources import stores

    nodes = frame([("s", "0", "10.0.0.1", [f"line {i}" for i in range(60)], "server", ["gw"] * 30)],
                  "sensor_id string, vlan string, ip string, software array<string>, device_type string, gateway_evidence array<string>")
    folder = fresh_path(spark, "map")
    stores.save_map(nodes, folder)
    back = stores.load_map(spark, folder).first()
    assert len(back.software) == 60 and back.device_type == "server" and len(back.gateway_evidence) == 30


def scan_bundle(frame, hosts, start=0):
    rows = [("10.0.0.1", f"10.0.{i // 200}.{10 + i % 200}", 445, ts(start + i)) for i in range(hosts) for _ in range(3)]
    ddl = "source_ip string, destination_ip string, destination_port int, timestamp timestamp"
    extra = ", bytes_out bigint, bytes_in bigint, conn_state string, duration double, protocol string"
    return {"connections": frame([(*r, 10, 10, "SF", 1.0, "tcp") for r in rows], ddl + extra)}


def test_case_has_all_assets_and_goes_into_the_open_one(frame):
    cfg = HuntConfig(disabled=tuple(n for n in findings.DETECTIONS if n not in ("fan_out", "ransomware_spread", "port_scans")))
    first = hunt.run_hunt(scan_bundle(frame, 30), cfg, staged=True, hunt_id="one", hunted_at="2024-01-01 00:00:00")
    assets = stage(first.case_assets, "assets")
    assert {r.asset for r in assets.collect()} == {"10.0.0.1"} | {f"10.0.0.{10 + i}" for i in range(30)}
    opened = stage(first.cases.drop("hunt"), "cases")
    assert opened.count() == 1 and opened.first().created_at is not None
    second = hunt.run_hunt(
        scan_bundle(frame, 40, 900), cfg, staged=True, hunt_id="two", hunted_at="2024-01-01 06:00:00", open_cases=(opened, assets),
    )
    assert second.cases.count() == 0
    assert {r.case_id for r in second.case_assets.collect()} == {opened.first().case_id} == {r.case_id for r in second.updated_cases.collect()}
    later = hunt.run_hunt(
        scan_bundle(frame, 40, 900), cfg, staged=True, hunt_id="two", hunted_at="2024-02-01 00:00:00", open_cases=(opened, assets),
    )
    assert {r.case_id for r in later.cases.collect()}.isdisjoint({opened.first().case_id}) and later.cases.count() == 1


def test_imported_cases_keep_all_indicators(frame):
    rows = [(c, i, f"10.0.{c}.{i}") for c in (1, 2) for i in range(80)] + [(1, 90, ""), (1, 91, None)]
    got = cases.import_assets(frame(rows, "case_id int, position int, ioc_value string")).collect()
    assert sorted((r["case_id"], r["asset"]) for r in got) == sorted((c, v) for c, _, v in rows if v)


def test_family_order_breaks_ties_and_orders_chains(frame):
    rows = [("c2_hunter", "f", 0.5), ("reconnaissance_hunter", "f", 0.5), ("impact_hunter", "f", 0.5), ("another", "f", 0.5)]
    tied = frame(rows, "agent string, fingerprint string, confidence double")
    assert correlate.dedup_findings(tied).first().agent == "reconnaissance_hunter"
    assert correlate.dedup_findings(tied, priority={"impact_hunter": 0.2}).first().agent == "impact_hunter"
    keyed = tied.withColumn("w", F.lit(1))
    assert correlate.dedup_findings(keyed, ("w",)).first().agent == "reconnaissance_hunter"
    out = frame([("collection_exfiltration_hunter", ["TA0009", "TA0010"], 0.5), ("lateral_movement_hunter", ["TA0008"], 0.5)],
                "agent string, mitre_tactics array<string>, boosted_confidence double")
    assert {r.chain_multiplier for r in correlate.kill_chain(out).collect()} == {1.5}
    first = out.withColumn("priority", F.when(F.col("agent") == "lateral_movement_hunter", 0.1).otherwise(0.9))
    assert {r.chain_multiplier for r in correlate.kill_chain(first).collect()} == {1.0}


def test_playbooks_survive_the_exchange(spark, frame, tmp_path):
    ddl = "playbook string, total_count bigint, success_count bigint, combinations bigint, recommended string"
    own = frame([("T1_T2", 3, 1, 1, "a,b"), ("T3", 2, 0, 0, None)], ddl)
    theirs = frame([("T1_T2", 5, 5, 2, "c"), ("T3", 1, 1, 1, "d"), ("T9", 1, 0, 0, None)], ddl)
    learning.export_playbooks(theirs, str(tmp_path / "books"))
    (tmp_path / "books" / "more.json").write_text('{"playbook": broken\n{"total_count": 7}\n')
    loaded = learning.import_playbooks(spark, str(tmp_path / "books"))
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, theirs.collect()))
    got = {r.playbook: tuple(r)[1:] for r in learning.merge_playbooks(own, loaded).collect()}
    assert got == {"T1_T2": (8, 6, 2, "a,b"), "T3": (3, 1, 1, "d"), "T9": (1, 0, 0, None)}


def test_asset_weights(frame):
    rows = [("10.0.0.1", ["dns_server"], "server", []), ("10.0.0.2", [], "domain_controller", []), ("10.0.0.3", [], "workstation", ["10.0.0.0/24"]), ("10.0.0.4", [], "", []), ("10.0.0.1", [], "server", [])]
    nodes = frame(rows, "ip string, roles array<string>, device_type string, is_gateway_for array<string>")
    assets = netmap.asset_context(nodes)
    assert {tuple(r) for r in assets.collect()} == {("high_value", "10.0.0.1"), ("critical", "10.0.0.1"), ("high_value", "10.0.0.2"), ("critical", "10.0.0.2"), ("critical", "10.0.0.3")}
    assert tuple(netmap.asset_counts(assets).first()) == (3, 2)
    assert netmap.asset_context(nodes.drop("device_type", "is_gateway_for")).count() == 1


def test_issuers_stay_with_their_certificate(frame):
    log = frame([("s1", "CN=Web1.corp,OU=x", "CN=ca1,O=Org One"), ("s1", "CN=other.net", "CN=ca2"), ("s2", "CN=Web1.corp", "O=-"), ("s1", None, "CN=ca3")],
                "sensor_id string, certificate_subject string, certificate_issuer string")
    rows = devices.certificate_rows(log)
    names = frame([("s1", "0", "10.0.0.1", "WEB1"), ("s1", "0", "10.0.0.2", "nothing")], "sensor_id string, vlan string, ip string, name string")
    matches = devices.certificate_matches(names, rows.select("cert_sensor", "cn").distinct())
    nodes = names.select("sensor_id", "vlan", "ip").withColumn("cert_issuers", F.array(F.lit("ca0"))).withColumn("cert_subjects", F.array().cast("array<string>"))
    got = {r.ip: (r.cert_subjects, r.cert_issuers) for r in devices.attach_certificates(nodes, matches, devices.certificate_issuers(matches, rows)).collect()}
    assert got == {"10.0.0.1": (["web1.corp"], ["O=Org One", "ca0", "ca1"]), "10.0.0.2": ([], ["ca0"])}


def test_graph_totals_cover_the_map(frame):
    from netquarry.operators import graph
    edges = frame([("s1", "0", "10.0.0.1", "10.0.0.2", 9), ("s1", "0", "10.0.0.1", "10.0.0.3", 5), ("s1", "0", "10.0.0.1", "8.8.8.8", 4),
                   ("s2", "7", "10.0.0.1", "10.0.0.2", 2), ("s1", "0", "10.0.0.3", "10.0.0.1", 1)], "sensor_id string, vlan string, src string, dst string, n bigint")
    nodes = frame([("s1:0:10.0.0.1", "s1", "0", "10.0.0.1", True, 18), ("s2:7:10.0.0.1", "s2", "7", "10.0.0.1", True, 2), ("s1:0:10.0.0.2", "s1", "0", "10.0.0.2", True, 11),
                   ("s1:0:10.0.0.3", "s1", "0", "10.0.0.3", True, 6)], "node_id string, sensor_id string, vlan string, ip string, is_internal boolean, total_connections bigint")
    view = graph.view_nodes(nodes, 2)
    assert {(r.ip, tuple(r.vlans), tuple(r.sensors)) for r in view.collect()} == {("10.0.0.1", ("0", "7"), ("s1", "s2")), ("10.0.0.2", ("0",), ("s1",))}
    got = {(r.node_id, r.side): (r.connections, r.drawn_connections, r.rest_connections) for r in graph.edge_totals(edges, view).collect()}
    assert got == {("s1:0:10.0.0.1", "inside"): (14, 9, 5), ("s1:0:10.0.0.1", "outside"): (4, 0, 4), (graph.REST, "inside"): (3, 0, 3)}
