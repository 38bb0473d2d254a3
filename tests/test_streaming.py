"""Streams give the batch result; stores survive repeats."""

import pytest
from conftest import ts


from netquarry.operators import netmap
from netquarry.plans import hunt
from netquarry.session import fresh_path, run_dir, shared_dir, stage
from netquarry.sources import stores
from netquarry.streaming import jobs

CONN = "sensor_id string, vlan string, source_ip string, source_port int, destination_ip string, destination_port int, protocol string, bytes_in bigint, bytes_out bigint, timestamp timestamp"


def connections(frame, n=60, start=0):
    return frame([("s", "0", f"10.0.0.{i % 4}", i, f"10.0.1.{i % 5}", 445, "tcp", i, 2 * i, ts(start + i)) for i in range(n)], CONN)


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_incremental_edges_equal_batch_edges_and_a_repeated_cycle_counts_once(spark, frame):
    df = connections(frame)
    folder, target, checkpoint = (fresh_path(spark, n) for n in ("in", "out", "ck"))
    process = jobs.edge_cycle(lambda b: b)
    seen = []
    for part in (df.where("source_port < 25"), df.where("source_port >= 25")):
        part.write.mode("append").parquet(folder)
        jobs.run_cycles(jobs.file_stream(spark, folder, df.schema), process, target, checkpoint, callback=seen.append).awaitTermination()
    assert seen == [0, 1]
    assert rows(jobs.merged_edges(spark, target)) == rows(netmap.edges(df))
    process(df.where("source_port < 25"), 0).write.mode("overwrite").parquet(f"{target}/cycle=0")
    assert rows(jobs.merged_edges(spark, target)) == rows(netmap.edges(df))


def test_backfill_then_follow_reads_everything_once(spark, frame):
    df = connections(frame)
    folder, target, checkpoint = (fresh_path(spark, n) for n in ("in", "out", "ck"))
    df.write.parquet(folder)

    def start(trigger):
        return jobs.run_cycles(jobs.file_stream(spark, folder, df.schema), lambda b, c: b, target, checkpoint, trigger)

    query = jobs.backfill_then_follow(start, "1 second")
    connections(frame, 10, 5000).write.mode("append").parquet(folder)
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(target).count() == 70


def test_repeat_suppression_within_the_delay(spark, frame):
    folder, target, checkpoint = (fresh_path(spark, n) for n in ("in", "out", "ck"))
    frame([("a", ts(0)), ("a", ts(10)), ("b", ts(5))], "fingerprint string, seen timestamp").write.parquet(folder)
    schema = "fingerprint string, seen timestamp"
    stream = jobs.with_event_time(jobs.file_stream(spark, folder, schema), "seen", "1 hour")
    jobs.start_sink(jobs.suppress_repeats(stream), target, checkpoint).awaitTermination()
    assert sorted(r.fingerprint for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_late_rows_go_to_the_side_table(spark, frame):
    folder, target, checkpoint, late, marks = (fresh_path(spark, n) for n in ("in", "out", "ck", "late", "marks"))
    process = jobs.split_late(lambda b, c: b, late, marks, 100)
    for part in (connections(frame, 5, 1000), connections(frame, 5, 0)):
        part.write.mode("append").parquet(folder)
        jobs.run_cycles(jobs.file_stream(spark, folder, part.schema), process, target, checkpoint).awaitTermination()
    assert spark.read.parquet(late).count() == 5 and spark.read.parquet(target).count() == 5


def test_findings_are_inserted_once(spark, frame):
    store = fresh_path(spark, "findings")
    f = frame([("a", 1), ("b", 2), ("a", 1)], "fingerprint string, n int")
    for _ in range(3):
        stores.insert_findings(f, store)
    assert spark.read.parquet(store).count() == 2


def test_event_store_round_trip_and_retention(spark, frame):
    store = fresh_path(spark, "events")
    df = connections(frame, 6)
    stores.append_events(df, store, "network_connections", 1, "2024-01-01 00:30:00")
    stores.append_events(df, store, "network_connections", 2, "2024-01-03 00:30:00")
    got = stores.cycle_bundle(spark, store, 1)["network_connections"]
    assert rows(got.select(df.columns)) == rows(df)
    plan = stores.read_events(spark, store, "network_connections", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cycle" in plan.split("PartitionFilters", 1)[1][:200]
    assert stores.drop_expired(spark, store, "2024-01-02 00:00:00") == ["2024010100"]
    assert {r.cycle for r in spark.read.parquet(store).select("cycle").distinct().collect()} == {2}


def test_legacy_map_and_header_line(spark):
    folder, single = fresh_path(spark, "map"), fresh_path(spark, "legacy")
    node = '{"sensor_id": "s", "vlan": "0", "ip": "10.0.0.1", "total_connections": 3}'
    spark.createDataFrame([('{"version": 2, "saved": "x"}',), (node,), ("{broken",)], "value string").coalesce(1).write.text(folder)
    assert [r.ip for r in stores.load_map(spark, folder).collect()] == ["10.0.0.1"]
    for i, nodes in enumerate(("[" + node + "]", '{"s:0:10.0.0.1": ' + node + "}")):
        spark.createDataFrame([('{"nodes": ' + nodes + "}",)], "value string").coalesce(1).write.text(f"{single}-{i}")
        assert stores.load_legacy_map(spark, f"{single}-{i}").first().total_connections == 3


class Fake:
    """A session as ``shared_dir`` sees it."""

    def __init__(self, master, folder=None):
        self.conf, self.folder = self, folder
        self.sparkContext = type("C", (), {"master": master, "applicationId": master + str(folder)})

    def get(self, name, default):
        return {"spark.checkpoint.dir": self.folder, "spark.sql.warehouse.dir": "file:/warehouse"}[name] or default


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(Fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        shared_dir(Fake("yarn"))
    assert shared_dir(Fake("local[2]")) == "file:/warehouse/staged"
    staged = stage(spark.range(3), "t")
    assert staged.count() == 3 and run_dir(spark).removeprefix("file:") in staged.inputFiles()[0]


def test_windows_cover_the_range(frame):
    r = frame([(ts(0), ts(9000))], "a timestamp, b timestamp")
    got = [(x.window_start, x.window_end) for x in hunt.window_bounds_of(r, "a", "b", 1).collect()]
    assert [w[0] for w in got] == [ts(0).replace(tzinfo=None), ts(3600).replace(tzinfo=None), ts(7200).replace(tzinfo=None)]
    assert got[-1][1] == ts(9000).replace(tzinfo=None)


def test_plans_push_down_and_avoid_python(spark):
    from workload import views as v
    from netquarry.operators import exfil, recon

    c = v.connections(spark, "/root/testdata/sf0.001")
    for df in (exfil.large_transfers(c), recon.port_scans(c)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "l_comment" not in plan


def test_no_registered_plan_has_a_cross_join(spark):
    import __spark_entry__ as entry

    for name in ("confidence_calibration", "certificate_name_matches", "listed_domain_match", "case_open_match", "intel_enrichment",
                 "graph_edges", "device_classification", "vector_top_k", "hunt_assessment", "window_assessments"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
