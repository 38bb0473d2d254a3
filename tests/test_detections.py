"""Planted groups on both sides of every threshold."""

import random
import statistics
from collections import defaultdict

import pytest
from conftest import ts
from pyspark.sql import functions as F

from netquarry.config import C2Config, ExfilConfig, ImpactConfig, LateralConfig, ReconConfig
from netquarry.operators import c2, exfil, findings, flows, impact, lateral, recon
from netquarry.operators.common import interarrival

CONN = "source_ip string, destination_ip string, destination_port int, conn_state string, bytes_in bigint, bytes_out bigint, timestamp timestamp"


def conn(src="10.0.0.1", dst="203.0.113.5", port=443, state="SF", bin_=0, bout=0, at=0):
    return (src, dst, port, state, bin_, bout, ts(at) if at is not None else None)


def keys(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_beaconing_regular_not_jittered(frame):
    rng = random.Random(1)
    rows = [conn("10.0.0.1", at=60 * i) for i in range(20)]
    rows += [conn("10.0.0.2", at=rng.randint(0, 100_000)) for _ in range(20)]
    rows += [conn("10.0.0.3", at=60 * i) for i in range(9)]
    rows += [conn("10.0.0.4", at=60 * (i // 2)) for i in range(12)]
    rows += [conn(None, at=60 * i) for i in range(20)] + [conn("10.0.0.5", at=None) for _ in range(20)]
    rng.shuffle(rows)
    got = c2.beaconing(frame(rows, CONN)).collect()
    assert [r.source_ip for r in got] == ["10.0.0.1"]
    assert got[0].events == 20 and got[0].gaps == 19
    assert got[0].mean_interval == pytest.approx(60) and got[0].regularity == pytest.approx(1)
    assert got[0].confidence == pytest.approx(0.95)


@pytest.mark.parametrize("bucket", [7, 600, 10_000_000])
@pytest.mark.parametrize("keep_zero", [False, True])
def test_interarrival_does_not_depend_on_buckets(frame, bucket, keep_zero):
    rng = random.Random(7)
    groups = {k: [rng.randint(0, 5000) for _ in range(n)] for k, n in (("a", 400), ("b", 30), ("c", 1), ("d", 2))}
    rows = [(k, ts(x)) for k, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    got = {r.k: r for r in interarrival(frame(rows, "k string, timestamp timestamp"), ["k"], bucket_seconds=bucket, keep_zero=keep_zero).collect()}
    for k, xs in groups.items():
        xs = sorted(xs)
        gaps = [b - a for a, b in zip(xs, xs[1:]) if keep_zero or b > a]
        assert got[k].events == len(xs) and got[k].gaps == len(gaps)
        if gaps:
            assert got[k].mean_interval == pytest.approx(statistics.fmean(gaps))
            assert got[k].std_dev == pytest.approx(statistics.pstdev(gaps), abs=1e-9)


def test_interarrival_makes_few_summaries_and_enough_tasks(spark, frame, monkeypatch):
    from netquarry.operators import common

    rng = random.Random(9)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", ts(rng.randint(0, 10**8))) for i in range(6000)]
    df = frame(rows, "k string, timestamp timestamp")
    want = {tuple(r) for r in interarrival(df, ["k"]).collect()}
    monkeypatch.setattr(common, "BUCKET_ROWS", 500)
    monkeypatch.setattr(common, "TASK_ROWS", 250)
    got = interarrival(df, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and ", 24)" in plan  # 6,000 rows by 250
    assert {(r[0], r[1], r[2]) for r in got.collect()} == {(r[0], r[1], r[2]) for r in want}
    for a, b in zip(sorted(map(tuple, got.collect())), sorted(want)):
        assert a[3:] == pytest.approx(b[3:])


DNS = "source_ip string, domain string, response_code string, timestamp timestamp"


def test_dga_needs_digits_and_entropy(frame):
    rows = [("10.0.0.2", "xk2vbq9zrtwp.com", "NOERROR", ts(5)), ("10.0.0.1", "xk2vbq9zrtwp.com", "NOERROR", ts(1)),
            ("10.0.0.1", "xkqvbqjzrtwp.com", "NOERROR", ts(1)), ("10.0.0.1", "aaaaaaaaaaa1.com", "NOERROR", ts(1)),
            ("10.0.0.1", "xk2vbq.com", "NOERROR", ts(1)), ("10.0.0.1", "nolabel", "NOERROR", ts(1)), ("10.0.0.1", None, None, ts(1))]
    got = c2.dga_domains(frame(rows, DNS)).collect()
    assert [(r.domain, r.source_ip) for r in got] == [("xk2vbq9zrtwp.com", "10.0.0.1")]


def test_tunnel_fifty_subdomains(frame):
    def subs(parent, n):
        return [("10.0.0.1", f"{i:02d}abcdefghijklm.{parent}", "NOERROR", ts(i)) for i in range(n)]

    rows = subs("evil.net", 50) + subs("fine.net", 49) + subs("evil.net", 50)
    got = c2.dns_tunneling(frame(rows, DNS), samples=2).collect()
    assert [(r.parent_domain, r.unique_subdomains, r.sample_subdomains) for r in got] == [
        ("evil.net", 50, ["00abcdefghijklm", "01abcdefghijklm"])]


def test_persistent_channel_span_and_traffic(frame):
    rows = [conn("10.0.0.1", at=0), conn("10.0.0.1", at=3600), conn("10.0.0.2", at=0), conn("10.0.0.2", at=3599)]
    rows += [conn("10.0.0.3", at=1000 * i, bout=2000) for i in range(6)]
    rows += [conn("10.0.0.4", at=1000 * i, bout=9000) for i in range(5)]
    assert keys(c2.persistent_channels(frame(rows, CONN)), "source_ip") == {"10.0.0.1", "10.0.0.4"}


def test_suspicious_ports_three_hits(frame):
    rows = [conn("10.0.0.1", port=4444) for _ in range(3)] + [conn("10.0.0.2", port=4444) for _ in range(2)] + [conn("10.0.0.3", port=443)] * 5
    got = c2.suspicious_ports(frame(rows, CONN)).collect()
    assert [(r.source_ip, r.ports, r.connections) for r in got] == [("10.0.0.1", [4444], 3)]
    assert got[0].confidence == pytest.approx(0.55 + 0.05 + 0.03)


def test_port_scan_thresholds_and_class(frame):
    rows = [conn("10.0.0.1", "10.0.0.9", p, "REJ", at=p) for p in range(25)]
    rows += [conn("10.0.0.2", "10.0.0.9", p, at=p) for p in range(24)]
    rows += [conn("10.0.0.3", f"10.0.1.{h}", 22, at=h) for h in range(15)]
    rows += [conn("10.0.0.4", f"10.0.1.{h}", 22, at=h) for h in range(14)]
    rows += [conn("10.0.0.5", "10.0.0.9", None, at=1)] + [conn("10.0.0.5", "10.0.0.9", p, at=2) for p in range(24)]
    got = {r.source_ip: r for r in recon.port_scans(frame(rows, CONN)).collect()}
    assert set(got) == {"10.0.0.1", "10.0.0.3", "10.0.0.5"}
    assert got["10.0.0.1"].scan_type == "Vertical port scan" and got["10.0.0.3"].scan_type == "Host sweep"
    assert got["10.0.0.1"].reject_ratio == 1.0 and got["10.0.0.5"].scan_type == "Aggressive scan"


def test_dns_recon_ratio(frame):
    def q(src, bad, n):
        return [(src, f"d{i}.com", "NXDOMAIN" if i < bad else "NOERROR", ts(i)) for i in range(n)]

    rows = q("10.0.0.1", 30, 100) + q("10.0.0.2", 29, 100) + q("10.0.0.3", 0, 200) + q("10.0.0.4", 0, 199)
    assert keys(recon.dns_reconnaissance(frame(rows, DNS)), "source_ip") == {"10.0.0.1", "10.0.0.3"}


def test_service_enumeration(frame):
    rows = [conn("10.0.0.1", "10.0.0.9", p, "REJ" if p < 6 else "SF") for p in range(10)]
    rows += [conn("10.0.0.2", "10.0.0.9", p, "REJ" if p < 5 else "SF") for p in range(10)]
    rows += [conn("10.0.0.3", "10.0.0.9", p, "S0") for p in range(9)]
    assert keys(recon.service_enumeration(frame(rows, CONN)), "source_ip") == {"10.0.0.1"}


def test_lateral_fan_out(frame):
    rows = [conn("10.0.0.1", f"10.0.1.{h}", 3389) for h in range(5)] + [conn("10.0.0.2", f"10.0.1.{h}", 3389) for h in range(4)]
    rows += [conn("10.0.0.3", f"10.0.1.{h}", 22) for h in range(4)] + [conn("10.0.0.4", f"203.0.113.{h}", 22) for h in range(9)]
    rows += [conn("10.0.0.5", f"10.0.1.{h}", p) for h, p in ((1, 5985), (2, 5986), (3, 135))] + [conn("10.0.0.6", "10.0.0.6", 445)] * 9
    got = lateral.fan_out(frame(rows, CONN), samples=3)
    assert keys(got, "source_ip", "protocol") == {("10.0.0.1", "RDP"), ("10.0.0.3", "SSH"), ("10.0.0.5", "WinRM/DCOM")}
    assert got.where("protocol = 'RDP'").first().sample_targets == ["10.0.1.0", "10.0.1.1", "10.0.1.2"]


def test_ntlm_relay(frame):
    rows = [("A", f"10.0.0.{i}") for i in range(3)] + [("B", f"10.0.0.{i}") for i in range(2)] + [("", "10.0.0.1")] * 3 + [(None, "10.0.0.9")] * 3
    assert keys(lateral.ntlm_relay(frame(rows, "hostname string, dest_ip string")), "hostname") == {"A"}


def test_transfers_at_the_byte(frame):
    rows = [conn("10.0.0.1", bout=104857600), conn("10.0.0.2", bout=104857599), conn("203.0.113.9", bout=10**10), conn("10.0.0.3", "10.0.0.4", bout=10**10)]
    assert keys(exfil.large_transfers(frame(rows, CONN)), "source_ip") == {"10.0.0.1"}


def test_asymmetric_ratio(frame):
    rows = [conn("10.0.0.1", bout=100_000_000, bin_=10_000_000), conn("10.0.0.2", bout=99_900_000, bin_=10_000_000), conn("10.0.0.3", bout=52_428_800, bin_=0)]
    assert keys(exfil.asymmetric_traffic(frame(rows, CONN)), "source_ip") == {"10.0.0.1", "10.0.0.3"}


def test_dns_exfiltration(frame):
    def subs(src, size, n):
        return [(src, f"{str(i).zfill(size)}.evil.net", "NOERROR", ts(i)) for i in range(n)]

    rows = subs("10.0.0.1", 30, 30) + subs("10.0.0.2", 29, 40) + subs("10.0.0.3", 30, 29) + subs("10.0.0.1", 30, 30)
    got = exfil.dns_exfiltration(frame(rows, DNS)).collect()
    assert [(r.source_ip, r.unique_subdomains, r.total_queries, r.total_chars) for r in got] == [("10.0.0.1", 30, 60, 1800)]


def test_cloud_upload_methods_and_order(frame):
    rows = [("10.0.0.1", "post", "www.DropBox.com", "/x"), ("10.0.0.1", "GET", "dropbox.com", "/"), ("10.0.0.2", "PUT", "cdn.net", "/to/mega.nz/x"),
            ("10.0.0.3", "POST", "dl.dropboxusercontent.com", "/dropbox.com"), (None, "POST", "mega.nz", None)]
    got = exfil.cloud_uploads(frame(rows, "source_ip string, method string, host string, uri string"))
    assert keys(got, "source_ip", "service") == {("10.0.0.1", "dropbox.com"), ("10.0.0.2", "mega.nz"), ("10.0.0.3", "dropbox.com"), ("unknown", "mega.nz")}


def test_cryptomining_levels(frame):
    rows = [conn("10.0.0.1", port=3333), conn("10.0.0.3", port=3333), conn("10.0.0.4", "10.0.0.9", 3333)]
    dns = [("10.0.0.1", "eu.nanopool.org", "", ts(0)), ("10.0.0.2", "xmrpool.eu", "", ts(0)), ("10.0.0.5", "example.org", "", ts(0))]
    got = {r.source_ip: r.confidence for r in impact.cryptomining(frame(rows, CONN), frame(dns, DNS)).collect()}
    assert got == {"10.0.0.1": 0.92, "10.0.0.2": 0.75, "10.0.0.3": 0.65}


def test_ransomware_spread(frame):
    rows = [conn("10.0.0.1", f"10.0.1.{h}", 445, at=6 * h) for h in range(10)] + [conn("10.0.0.2", f"10.0.1.{h}", 139, at=0) for h in range(9)]
    rows += [conn("10.0.0.3", f"10.0.1.{h}", 445, at=0) for h in range(10)]
    got = {r.source_ip: r for r in impact.ransomware_spread(frame(rows, CONN)).collect()}
    assert set(got) == {"10.0.0.1", "10.0.0.3"}
    assert got["10.0.0.3"].hosts_per_min == 0 and got["10.0.0.1"].hosts_per_min == pytest.approx(10 / 0.9)


def test_ddos_share(frame):
    rows = [conn("10.0.0.1", "203.0.113.1")] * 800 + [conn("10.0.0.1", "203.0.113.2")] * 200
    rows += [conn("10.0.0.2", "203.0.113.1")] * 790 + [conn("10.0.0.2", "203.0.113.2")] * 210 + [conn("10.0.0.3", "203.0.113.1")] * 999
    got = impact.ddos_participation(frame(rows, CONN)).collect()
    assert [(r.source_ip, r.top_target, r.target_share) for r in got] == [("10.0.0.1", "203.0.113.1", 0.8)]


def test_window_split_sums_to_the_whole(frame):
    rng = random.Random(3)
    rows = [conn(f"10.0.0.{rng.randint(1, 5)}", f"203.0.113.{rng.randint(1, 5)}", rng.choice([80, 443]), at=rng.randint(0, 9000), bout=rng.randint(0, 99)) for _ in range(500)]
    df = frame(rows, CONN)
    whole = flows.flow_summary(df).agg(F.sum("connections"), F.sum("bytes_out")).first()
    parts = flows.flow_summary(df.withColumn("window_start", F.window("timestamp", "10 minutes").start), ["window_start"])
    assert tuple(parts.agg(F.sum("connections"), F.sum("bytes_out")).first()) == tuple(whole)


def test_hot_source_and_input_order(frame):
    """One source with a third of the rows; shuffled input gives the same rows."""
    rng = random.Random(5)
    rows = [conn("10.0.0.1", f"203.0.113.{i % 50}", 400 + i % 30, at=i) for i in range(900)]
    rows += [conn(f"10.0.1.{i % 90}", f"203.0.113.{i % 7}", 443, at=i) for i in range(1800)]
    first = {tuple(r) for r in recon.port_scans(frame(rows, CONN)).collect()}
    rng.shuffle(rows)
    assert {tuple(r) for r in recon.port_scans(frame(rows, CONN)).collect()} == first
    hot = next(r for r in recon.port_scans(frame(rows, CONN)).collect() if r.source_ip == "10.0.0.1")
    per = defaultdict(set)
    for r in rows:
        per["p"].add(r[2]) if r[0] == "10.0.0.1" else None
    assert hot.unique_ports == len(per["p"]) and hot.total_connections == 900


def test_findings_have_one_shape_and_stable_ids(frame):
    rows = [conn("10.0.0.1", f"10.0.1.{h}", 3389, at=h) for h in range(9)]
    from netquarry.config import HuntConfig

    df = frame(rows, CONN)
    a = findings.run_detections({"connections": df}, HuntConfig())
    b = findings.run_detections({"connections": df.orderBy(F.desc("timestamp"))}, HuntConfig())
    assert tuple(a.columns) == findings.FINDING_COLUMNS
    assert keys(a, "fingerprint") == keys(b, "fingerprint")
    assert "rdp_lateral_movement" in keys(a, "activity_type")
    off = findings.run_detections({"connections": df}, HuntConfig(disabled=("fan_out",)))
    assert "rdp_lateral_movement" not in keys(off, "activity_type")


def test_configs_are_parameters(frame):
    rows = [conn("10.0.0.1", f"10.0.1.{h}", 3389) for h in range(2)]
    assert lateral.fan_out(frame(rows, CONN), LateralConfig(fan_out={"RDP": 2, "SMB": 5, "SSH": 4, "WinRM/DCOM": 3})).count() == 1
    assert exfil.large_transfers(frame([conn(bout=10)], CONN), ExfilConfig(transfer_bytes=10)).count() == 1
    assert impact.ddos_participation(frame([conn()] * 5, CONN), ImpactConfig(ddos_total=5)).count() == 1
    assert recon.port_scans(frame([conn()], CONN), ReconConfig(scan_ports=1)).count() == 1
    assert c2.suspicious_ports(frame([conn(port=7)], CONN), C2Config(suspicious_ports=(7,), suspicious_min_count=1)).count() == 1


def test_beacons_with_a_stored_summary_shuffle_candidates_only(spark, frame):
    """Many pairs that connect a few times never reach the shuffle by pair; the result is the same."""
    from netquarry.operators.flows import flow_summary
    from netquarry.session import stage

    few = spark.range(40_000).select(
        F.concat(F.lit("10.0.0."), F.col("id") % 200).alias("source_ip"), F.concat(F.lit("203.0."), F.col("id") % 20_000).alias("destination_ip"),
        F.lit(443).alias("destination_port"), F.timestamp_seconds(F.col("id")).alias("timestamp"))
    regular = spark.range(60).select(
        F.lit("10.9.9.9").alias("source_ip"), F.lit("203.9").alias("destination_ip"), F.lit(8443).alias("destination_port"),
        F.timestamp_seconds(F.floor(F.col("id") / 2) * 60).alias("timestamp"))
    log = stage(few.unionByName(regular), "beacon-log")
    flows = stage(flow_summary(log), "beacon-flows")
    cfg = C2Config(min_connections=10)
    plain, pruned = c2.beaconing(log, cfg), c2.beaconing(log, cfg, flows=flows)
    assert sorted(map(tuple, pruned.collect())) == sorted(map(tuple, plain.collect())) and pruned.count() == 1
    from netquarry.operators.common import possible_rows

    kept = possible_rows(log, c2.beacon_candidates(flows, cfg), ["source_ip", "destination_ip", "destination_port"])
    assert 60 <= kept.count() < 4_000 and kept.columns == log.columns
    nothing = possible_rows(log, flows.limit(0).select("source_ip"), ["source_ip"])
    assert nothing.count() == 0


def test_prefilter_is_left_out_where_most_rows_are_candidates(spark):
    """Where nearly all connections are of keys with enough of them, no bitmap is tested; its pieces are small anyhow."""
    from netquarry.operators.common import bitmap_pieces
    from netquarry.operators.flows import flow_summary
    from netquarry.session import stage

    log = stage(spark.range(2_000).select(
        F.concat(F.lit("10.0.0."), F.col("id") % 20).alias("source_ip"), F.lit("203.0.113.9").alias("destination_ip"),
        F.lit(443).alias("destination_port"), F.timestamp_seconds(F.col("id") * 30).alias("timestamp")), "beacon-log")
    flows = stage(flow_summary(log), "beacon-flows")
    cfg = C2Config(min_connections=10)
    got = c2.beaconing(log, cfg, flows=flows)
    assert "_bits" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, c2.beaconing(log, cfg).collect())) and got.count() == 20
    places = [0, 511, 512, 32_767, 32_768, 100_000]
    pieces = {r["_piece"]: bytes(r["_bits"]) for r in bitmap_pieces(spark.createDataFrame([(i,) for i in places], "_bit bigint")).collect()}
    assert {len(b) for b in pieces.values()} == {64}
    assert [p * 512 + i for p in sorted(pieces) for i in range(512) if pieces[p][i // 8] >> (i % 8) & 1] == places


def test_dns_detections_over_the_summary_are_those_over_the_log(frame):
    rows = [(f"10.0.0.{i % 3}", f"{i % 60:02d}abcdefghijklmnopqrstuvwxyz0{i % 7}.evil.net", "NXDOMAIN" if i % 4 else "NOERROR", ts(i)) for i in range(700)]
    rows += [("10.0.0.9", "xk2vbq9zrtwp.com", "NOERROR", ts(5)), ("10.0.0.8", "xk2vbq9zrtwp.com", None, None), ("10.0.0.8", "xk2vbq9zrtwp.com", None, ts(1)),
             (None, "a.b.c", "NXDOMAIN", ts(1)), ("10.0.0.9", None, "NXDOMAIN", None), ("10.0.0.9", "", "NOERROR", ts(2))]
    log = frame(rows, DNS)
    summary = c2.dns_summary(log)
    for run in (c2.dga_domains, c2.subdomain_counts, c2.dns_tunneling, recon.dns_reconnaissance, exfil.dns_exfiltration):
        got, want = ({tuple(sorted(r.asDict().items())) for r in run(dns).collect()} for dns in (summary, log))
        assert got == want and want, run.__name__


def test_detections_read_the_dns_log_once_where_partials_are_stored(frame):
    rows = [(f"10.0.0.{i % 3}", f"{i:02d}abcdefghijklm.evil.net", "NXDOMAIN", ts(i)) for i in range(60)]
    stored = []

    def keep(df, name):
        stored.append((name, df.columns))
        return df

    ready = findings.prepare({"dns": frame(rows, DNS)}, (), keep)
    assert [name for name, _ in stored] == ["dns-summary", "subdomains"]
    readers = [d for d in findings.DETECTIONS.values() if set(d.needs) & {"dns", "dns_summary", "subdomains"}]
    assert len(readers) == 5 and all("dns" not in d.needs for d in readers)
    without_log = {name: df for name, df in ready.items() if name != "dns"}
    assert findings.run_detections(without_log, keep=keep).count() == findings.run_detections(ready, keep=keep).count()
