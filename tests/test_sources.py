"""Readers of raw logs: headers per file, one pass over event logs and rules."""

import pytest
from pyspark.sql import functions as F

from netquarry.operators import sigma
from netquarry.sources import winlog, zeek


def write(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def test_files_are_read_under_their_own_headers(spark, tmp_path):
    write(tmp_path, "a 1%20.log", ["#separator \\x09", "#fields\tts\tid.orig_h\tservice", "#types\ttime\taddr\tstring", "1\t10.0.0.1\tdns", "#close\t2024"])
    write(tmp_path, "b[1]{x}.log", ["#fields\tservice\tts\textra", "ssl\t2\tx", "-\t3\t-"])
    write(tmp_path, "c.log", ["#fields\tts\tid.orig_h\tservice", "4\t10.0.0.4\t\"quoted"])
    (tmp_path / "empty.log").write_text("")
    got = zeek.read_folder(spark, str(tmp_path))
    assert sorted(got.columns) == ["extra", "id.orig_h", "service", "ts"]
    rows = {tuple(r) for r in got.select("ts", "`id.orig_h`", "service", "extra").collect()}
    assert rows == {("1", "10.0.0.1", "dns", None), ("2", None, "ssl", "x"), ("3", None, None, None), ("4", "10.0.0.4", '"quoted', None)}
    with pytest.raises(ValueError, match="different"):
        zeek.header_fields(spark, str(tmp_path))
    write(tmp_path, "d.log", ["5\t10.0.0.5\tx"])
    with pytest.raises(ValueError, match="d.log"):
        zeek.read_folder(spark, str(tmp_path))
    assert zeek.read_folder(spark, str(tmp_path), ["ts", "id.orig_h", "service"]).count() == 5


def test_headers_are_found_without_reading_the_logs(spark, tmp_path):
    write(tmp_path, "large.log", ["#fields\tts\tv", *["1\t" + "x" * 100] * 300_000])
    settings = ("spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(s) for s in settings]
    sc = spark.sparkContext
    sc.setJobGroup("heads", "heads")
    heads = zeek.file_headers(spark, str(tmp_path)).collect()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    assert [r["fields"] for r in heads] == [["ts", "v"]] and [spark.conf.get(s) for s in settings] == before
    stages = [s for j in tracker.getJobIdsForGroup("heads") for s in tracker.getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    read = max(store.lastStageAttempt(s).inputRecords() for s in stages)
    assert 0 < read < 60_000 <= zeek.read_folder(spark, str(tmp_path)).count()


def test_written_logs_have_their_header_in_every_file(spark, tmp_path):
    for fields, low in ((("ts", "v"), 0), (("v", "more", "ts"), 1000)):
        rows = spark.range(low, low + 1000, numPartitions=7).where("id % 1000 > 200").select(F.concat_ws("\t", *[F.concat(F.lit(f), "id") for f in fields]).alias("value"))
        zeek.write_log(rows, str(tmp_path / "logs"), fields)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    got = zeek.read_folder(spark, str(tmp_path / "logs"))
    want = {(f"ts{i}", f"v{i}", None if i < 1000 else f"more{i}") for i in range(2000) if i % 1000 > 200}
    rows = [tuple(r) for r in got.select("ts", "v", "more").collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_raw_events_are_parsed_once(frame):
    raw = ['{"id.orig_h":"a","id.resp_h":["b","c"],"id.resp_p":"53","orig_bytes":"x"}', '{"id.orig_h":"d","id.resp_p":["80"],"orig_bytes":7}', "broken", None]
    events = frame([("h", "5", r) for r in raw], "host string, _time string, _raw string")
    parsed = zeek.parse_raw(events, ("id.orig_h", "id.resp_h", "id.resp_p"))
    assert {tuple(r) for r in parsed.collect()} == {("h", "5", "a", "b", "53"), ("h", "5", "d", None, "80"), ("h", "5", None, None, None)}
    assert parsed.count() == 4
    got = zeek.scan_connections(events)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(id.orig_h") == 1
    assert {(r["source_ip"], r["destination_port"], r["bytes_out"]) for r in got.collect()} == {("d", 80, 7), (None, 0, 0)} and got.count() == 3


WINDOWS = "index string, EventCode string, _time string, host string, user string, Process_Name string, CommandLine string, Object_Name string"


def test_windows_frames_share_one_pass(spark, frame, tmp_path):
    rows = [("security", "4624", "1", "h0", "u", None, None, None), ("sysmon", "1", "2", "h0", "u", "cmd.exe", "cmd /c", None),
            ("security", "4688", "3", "h1", "u", "a.exe", None, None), ("security", "4663", "4", "h0", "u", None, None, "C:\\x"),
            ("sysmon", "13", "5", "h0", "u", None, None, "HKLM\\k"), ("sysmon", "4624", "6", "h0", "u", None, None, None),
            ("security", "9999", "7", "h0", "u", None, None, None), (None, None, None, None, None, None, None, None)]
    raw = str(tmp_path / "raw")
    frame(rows, WINDOWS).write.parquet(raw)
    events = spark.read.parquet(raw)
    frames = winlog.collect(events, ["h0", "h1"])
    lazy = winlog.collect(events, ["h0", "h1"], staged=False)
    for name, df in frames.items():
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, lazy[name].collect()), key=repr), name
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert raw not in plan and "windows-events" in plan and "data_type" in plan.split("PartitionFilters")[1].split("]")[0]
    plan = lazy["powershell_logs"]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Ev" in plan.split("PushedFilters")[1]
    assert {n: df.count() for n, df in frames.items()} == {
        "authentication_logs": 1, "process_logs": 2, "powershell_logs": 0, "file_operations": 1, "scheduled_tasks": 0, "registry_changes": 1}
    numbers = events.withColumn("EventCode", F.col("EventCode").cast("int"))
    assert winlog.collect(numbers)["process_logs"].count() == 2


def test_rules_share_one_scan(spark, frame, tmp_path):
    raw = str(tmp_path / "log")
    frame([(f"h{i % 3}.{('tk', 'com', 'xyz')[i % 3]}", i) for i in range(60)], "domain string, n int").withColumn(
        "timestamp", F.timestamp_seconds(F.col("n"))).write.parquet(raw)
    rules = [sigma.Rule(f"r{i}", "t", level, "dns_query", {"s": {"domain|endswith": end}}, "s")
             for i, (level, end) in enumerate((("low", ".tk"), ("critical", "com"), ("high", "h")))]
    got = sigma.scan_summary({"dns_queries": spark.read.parquet(raw)}, rules, report_cap=7, samples=2)
    assert raw not in got._jdf.queryExecution().executedPlan().toString()
    rows = [(r["rule_id"], r["matches"], r["match_count"], [s[s.index('"n"'):][4:].split(",")[0] for s in r["sample_events"]]) for r in got.collect()]
    assert rows == [("r1", 20, 7, ["1", "4"]), ("r0", 20, 7, ["0", "3"])]
