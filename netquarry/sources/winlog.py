"""Windows event logs to the normalised frames.

Input frames are wide: ``index`` (security, sysmon or powershell),
``EventCode``, ``_time``, ``host``, ``user`` and the event's own fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import times
from netquarry.session import stage
from netquarry.sources.zeek import host_filter


# The logs and event codes that each frame is made of.
ROUTES = {
    "authentication_logs": (("security", 4624), ("security", 4625)),
    "process_logs": (("sysmon", 1), ("security", 4688)),
    "powershell_logs": (("powershell", 4104),),
    "file_operations": (("security", 4663), ("sysmon", 11)),
    "scheduled_tasks": (("security", 4698),),
    "registry_changes": (("security", 4657), ("sysmon", 13)),
}


def _code(df: DataFrame, code: int) -> Column:
    """The event code under its own type: a test that reaches the scan."""
    return F.col("EventCode") == (str(code) if dict(df.dtypes)["EventCode"] == "string" else code)


def of_type(events: DataFrame, data_type: str) -> DataFrame:
    """The events of a frame: by partition where they are routed already, by log and code otherwise."""
    if "data_type" in events.columns:
        return events.where(F.col("data_type") == data_type)
    tests = [(F.col("index") == index) & _code(events, code) for index, code in ROUTES[data_type]]
    return events.where(reduce(or_, tests))


def routed(events: DataFrame, hosts: Sequence[str] | None = None) -> DataFrame:
    """The events that any frame needs, written once, partitioned by ``data_type``.

    The raw log is scanned a single time whatever the number of frames; each
    frame then reads its own partition only.
    """
    data_type = F.coalesce(*[
        F.when((F.col("index") == index) & _code(events, code), F.lit(name)) for name, codes in ROUTES.items() for index, code in codes
    ])
    wanted = reduce(or_, [
        (F.col("index") == index) & F.col("EventCode").isin(*[
            str(c) if dict(events.dtypes)["EventCode"] == "string" else c for codes in ROUTES.values() for i, c in codes if i == index
        ])
        for index in sorted({i for codes in ROUTES.values() for i, _ in codes})
    ])
    own = host_filter(events, hosts).where(wanted).withColumn("data_type", data_type)
    return stage(own, "windows-events", ("data_type",))


def _field(df: DataFrame, *names: str, default=None) -> Column:
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(default))


def _time(df: DataFrame) -> Column:
    return times.parse_timestamp(_field(df, "_time")).alias("timestamp")


def authentications(events: DataFrame, hosts: Sequence[str] | None = None) -> DataFrame:
    """Logons: 4624 succeeded, 4625 failed."""
    df = of_type(host_filter(events, hosts), "authentication_logs")
    return df.select(
        _field(df, "user").alias("username"), _field(df, "src_ip").alias("source_ip"),
        _field(df, "dest_host").alias("target_hostname"),
        F.when(_code(df, 4624), "success").otherwise("failure").alias("result"),
        _field(df, "Logon_Type").cast("string").alias("logon_type"), _field(df, "country").alias("country"), _time(df),
    )


def processes(events: DataFrame, hosts: Sequence[str] | None = None, hostname: str | None = None) -> DataFrame:
    """Process starts from Sysmon 1 and Security 4688."""
    df = of_type(host_filter(events, hosts), "process_logs")
    if hostname:
        df = df.where(F.col("host") == hostname)
    return df.select(
        F.col("host").alias("hostname"), _field(df, "user").alias("user"), _field(df, "Process_Name").alias("process_name"),
        _field(df, "CommandLine", default="").alias("command_line"), _field(df, "ParentProcessName").alias("parent_process"), _time(df),
    )


def scripts(events: DataFrame, hosts: Sequence[str] | None = None) -> DataFrame:
    """PowerShell script blocks (4104); the message where there is no block."""
    df = of_type(host_filter(events, hosts), "powershell_logs")
    return df.select(
        F.col("host").alias("hostname"), _field(df, "user").alias("user"),
        _field(df, "ScriptBlockText", "Message", default="").alias("command_line"), _time(df),
    )


def file_operations(events: DataFrame, hosts: Sequence[str] | None = None) -> DataFrame:
    """File access (4663) and creation (Sysmon 11), operation from the mask."""
    df = of_type(host_filter(events, hosts), "file_operations")
    mask = _field(df, "Access_Mask", default="")
    return df.select(
        F.col("host").alias("hostname"), _field(df, "user").alias("user"),
        _field(df, "Object_Name", "TargetFilename").alias("filename"),
        F.when(mask.rlike("DELETE"), "delete").when(mask.rlike("WRITE"), "modify").otherwise("access").alias("operation"), _time(df),
    )


def scheduled_tasks(events: DataFrame, hosts: Sequence[str] | None = None) -> DataFrame:
    """Task registrations (4698)."""
    df = of_type(host_filter(events, hosts), "scheduled_tasks")
    return df.select(
        F.col("host").alias("hostname"), _field(df, "TaskName").alias("task_name"), _field(df, "TaskContent", default="").alias("command"),
        F.lit("created").alias("event_type"), _field(df, "user").alias("creator"), _time(df),
    )


def registry_changes(events: DataFrame, hosts: Sequence[str] | None = None) -> DataFrame:
    """Registry writes (4657, Sysmon 13); the value name is the last path part."""
    df = of_type(host_filter(events, hosts), "registry_changes")
    path = _field(df, "Object_Name", "TargetObject", default="")
    return df.select(
        F.col("host").alias("hostname"), _field(df, "user").alias("user"), path.alias("key_path"),
        F.when(F.contains(path, F.lit("\\")), F.substring_index(path, "\\", -1)).otherwise("").alias("value_name"),
        _field(df, "Details", default="").alias("value_data"), _time(df),
    )


SCANS = {
    "authentication_logs": authentications, "process_logs": processes, "powershell_logs": scripts,
    "file_operations": file_operations, "scheduled_tasks": scheduled_tasks, "registry_changes": registry_changes,
}


def collect(events: DataFrame, hosts: Sequence[str] | None = None, staged: bool = True) -> dict[str, DataFrame]:
    """All Windows frames from one wide event frame.

    With ``staged`` one pass over the events writes those that any frame
    needs, by type; without, every frame is lazy and scans the events itself.
    """
    if not staged:
        return {name: scan(events, hosts) for name, scan in SCANS.items()}
    own = routed(events, hosts)
    return {name: scan(own) for name, scan in SCANS.items()}
