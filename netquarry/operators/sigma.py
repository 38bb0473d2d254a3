"""Sigma rules compiled to Columns and matched in one pass per data type.

A rule's selections become boolean columns; its condition is handed to
Spark's own expression parser with the selection names replaced by those
columns, so precedence, ``not`` and parentheses are Spark's.
"""

from __future__ import annotations

import base64
import fnmatch
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry import fixed_values as fv
from netquarry.functions import net
from netquarry.operators.common import top_rows
from netquarry.session import stage

LEVELS = {"critical": 0, "high": 1, "medium": 2, "low": 3, "informational": 4}

# Raw field names of rules -> columns of the normalised logs.
FIELD_ALIASES = {
    "process_logs": {"image": "process_name", "commandline": "command_line", "parentimage": "parent_process"},
    "powershell_logs": {"scriptblocktext": "command_line"},
    "registry_changes": {"targetobject": "key_path", "details": "value_data"},
    "file_operations": {"targetfilename": "filename"},
    "scheduled_tasks": {"commandline": "command", "taskname": "task_name"},
    "network_connections": {"destinationip": "destination_ip", "sourceip": "source_ip", "destinationport": "destination_port"},
    "dns_queries": {"query": "domain", "queryname": "domain"},
    "authentication_logs": {"targetusername": "username", "ipaddress": "source_ip"},
}
# Event codes that a normalised log already implies.
IMPLIED_CODES = {
    "authentication_logs": {"4624": ("result", "success"), "4625": ("result", "failure")},
    "scheduled_tasks": {"4698": ("event_type", "created")},
}


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    level: str
    category: str
    selections: Mapping[str, object]
    condition: str
    tags: Sequence[str] = field(default_factory=tuple)
    status: str = "stable"

    @property
    def data_type(self) -> str | None:
        return fv.SIGMA_DATA_TYPES.get(self.category)

    @property
    def techniques(self) -> list[str]:
        tags = [t.split(".", 1)[1] for t in self.tags if t.startswith("attack.")]
        return [t.upper() for t in tags if re.fullmatch(r"t\d{4}(\.\d{3})?", t)]

    @property
    def tactics(self) -> list[str]:
        tags = [t.split(".", 1)[1] for t in self.tags if t.startswith("attack.")]
        return [t for t in tags if not re.fullmatch(r"t\d{4}(\.\d{3})?", t)]


def from_document(doc: Mapping) -> Rule:
    """A rule from its parsed YAML document."""
    detection = dict(doc["detection"])
    condition = detection.pop("condition")
    detection.pop("timeframe", None)  # a window for aggregations, not a selection
    wrong = [n for n, s in detection.items() if not isinstance(s, (Mapping, list, tuple))]
    if wrong:
        raise ValueError(f"selections must be maps or lists: {', '.join(wrong)}")
    source = doc.get("logsource", {})
    return Rule(
        str(doc.get("id", doc["title"])), doc["title"], doc.get("level", "medium"),
        source.get("category", source.get("service", "")), detection, condition,
        tuple(doc.get("tags", ())), doc.get("status", "experimental"),
    )


def load_rules(folder: str) -> list[Rule]:
    """Rules of a folder of YAML files; unmapped categories are left out."""
    import pathlib

    import yaml

    docs = [yaml.safe_load(p.read_text()) for p in sorted(pathlib.Path(folder).glob("**/*.y*ml"))]
    rules = [from_document(d) for d in docs if isinstance(d, dict) and "detection" in d]
    return [r for r in rules if r.data_type]


def _wildcards(text: str) -> str:
    """A pattern with ``*`` and ``?`` as a regular expression."""
    return "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in text)


def _value(column: Column, pattern) -> Column:
    text = str(pattern).lower()
    low = F.lower(column.cast("string"))
    if "*" in text or "?" in text:
        return low.rlike("(?s)^" + _wildcards(text) + r"\z")
    return low == text


# Where the base64 text of a value begins and how much of its
# end depends on what follows, for each offset of the value.
BASE64_START, BASE64_END = (0, 2, 3), (None, -3, -2)


def base64_forms(value: str) -> list[str]:
    """The value as it looks inside base64 text at each of the three offsets."""
    data = value.encode()
    return [
        base64.b64encode(b" " * i + data).decode()[BASE64_START[i] : BASE64_END[(len(data) + i) % 3]] for i in range(3)
    ]


def _modified(column: Column, modifier: str, pattern) -> Column:
    text = str(pattern)
    whole = column.cast("string")
    if modifier == "base64offset":
        return reduce(or_, [F.contains(whole, F.lit(form)) for form in base64_forms(text)])
    if modifier == "re":
        return whole.rlike("(?i)" + text)
    if modifier == "cidr":
        return net.in_cidr(column, text)
    plain = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}.get(modifier)
    if plain is None:
        return _value(column, pattern)
    low, want = F.lower(whole), text.lower()
    if "*" not in want and "?" not in want:
        return plain(low, F.lit(want))
    start = "^" if modifier == "startswith" else ""
    end = r"\z" if modifier == "endswith" else ""
    return low.rlike(f"(?s){start}{_wildcards(want)}{end}")


def _field_column(name: str, columns: Sequence[str], data_type: str) -> str | None:
    by_lower = {c.lower(): c for c in columns}
    alias = FIELD_ALIASES.get(data_type, {}).get(name.lower())
    return by_lower.get(name.lower()) or (by_lower.get(alias) if alias else None)


def _field_test(key: str, wanted, columns: Sequence[str], data_type: str) -> Column:
    name, *modifiers = key.split("|")
    values = wanted if isinstance(wanted, (list, tuple)) else [wanted]
    source = _field_column(name, columns, data_type)
    if source is None:
        codes = IMPLIED_CODES.get(data_type, {}) if name.lower() == "eventcode" else {}
        tests = [F.col(codes[str(v)][0]) == codes[str(v)][1] for v in values
                 if str(v) in codes and codes[str(v)][0] in columns]
    else:
        column = F.col(f"`{source}`")
        modifier = next((m for m in modifiers if m != "all"), "")
        tests = [
            (F.coalesce(column.cast("string"), F.lit("")) == "") if v is None else _modified(column, modifier, v)
            for v in values
        ]
    if not tests:
        return F.lit(False)
    joined = reduce(and_ if "all" in modifiers else or_, tests)
    return F.coalesce(joined, F.lit(False))


def selection_column(selection, columns: Sequence[str], data_type: str) -> Column:
    """AND over fields; a list of maps is OR; a list of words searches every
    text column."""
    if isinstance(selection, Mapping):
        return reduce(and_, [_field_test(k, v, columns, data_type) for k, v in selection.items()], F.lit(True))
    items = list(selection)
    if items and isinstance(items[0], Mapping):
        return reduce(or_, [selection_column(m, columns, data_type) for m in items])
    line = F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns]))
    return reduce(or_, [F.contains(line, F.lit(str(w).lower())) for w in items], F.lit(False))


def condition_sql(condition, names: Sequence[str], column: Mapping[str, str]) -> str:
    """The condition with selection names replaced by column names and
    ``N of ...`` by counts; a list of conditions is OR."""
    if isinstance(condition, (list, tuple)):
        return " OR ".join(f"({condition_sql(c, names, column)})" for c in condition)

    def of(match):
        count, pattern = match.group(1).lower(), match.group(2)
        chosen = [n for n in names if pattern.lower() == "them" or fnmatch.fnmatchcase(n, pattern)]
        if not chosen:
            return "false"
        total = " + ".join(f"int(`{column[n]}`)" for n in chosen)
        return f"(({total}) >= {len(chosen) if count == 'all' else int(count)})"

    text = re.sub(r"\b(all|\d+)\s+of\s+([\w*?]+)", of, str(condition), flags=re.I)
    parts = re.split(r"(`[^`]*`)", text)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\b[A-Za-z_]\w*\b", lambda m: f"`{column[m.group(0)]}`" if m.group(0) in column else m.group(0), parts[i])
    return "".join(parts)


def matched(events: DataFrame, rules: Sequence[Rule], data_type: str) -> DataFrame:
    """The events that any rule matches, with ``_hits``, the places of those rules: one projection of one scan."""
    columns = events.columns
    flags, hits = {}, []
    for i, rule in enumerate(rules):
        names = {n: f"_s{i}_{j}" for j, n in enumerate(rule.selections)}
        for n, flag in names.items():
            flags[flag] = selection_column(rule.selections[n], columns, data_type)
        test = F.expr(condition_sql(rule.condition, list(names), names))
        hits.append(F.when(test, F.lit(i)).otherwise(F.lit(-1)))
    # array_remove, unlike a filter lambda, stays in generated code, where
    # sub-expressions shared by the rules are computed once per row.
    found = F.array_remove(F.array(*hits), -1)
    return events.withColumns(flags).withColumn("_hits", found).where(F.size("_hits") > 0).drop(*flags)


def _named(rules: Sequence[Rule], place: Column) -> list[Column]:
    """The id and level of the rule at a place."""
    return [
        F.element_at(F.array(*[F.lit(r.id) for r in rules]), place + 1).alias("rule_id"),
        F.element_at(F.array(*[F.lit(r.level) for r in rules]), place + 1).alias("level"),
    ]


def _time_of(events: DataFrame) -> Column:
    return F.col("timestamp") if "timestamp" in events.columns else F.lit(None).cast("timestamp")


def match_events(events: DataFrame, rules: Iterable[Rule], data_type: str) -> DataFrame:
    """(rule_id, level, data_type, event, timestamp) for every match; all rules
    of the type are evaluated in one projection of one scan. The event is JSON."""
    rules = [r for r in rules if r.data_type == data_type]
    found = matched(events, rules, data_type)
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]))
    each = found.select(F.explode("_hits").alias("_i"), F.lit(data_type).alias("data_type"), body.alias("event"), _time_of(events).alias("timestamp"))
    return each.select(*_named(rules, F.col("_i")), "data_type", "event", "timestamp")


def level_rank(level: str = "level") -> Column:
    return F.coalesce(*[F.when(F.col(level) == k, F.lit(v)) for k, v in LEVELS.items()], F.lit(5))


def summarize(events: DataFrame, rules: Iterable[Rule], data_type: str, report_cap: int = 100, samples: int = 5) -> DataFrame:
    """Per rule: all matches, the number a report shows, and sample events in time order.

    One scan of the log writes the matching events with the places of their
    rules; counts read only those places, and samples rank the events within
    each rule, cut before the shuffle. Ties of time go by the event's columns.
    """
    rules = [r for r in rules if r.data_type == data_type]
    found = stage(matched(events, rules, data_type), "rule-matches")
    counts = found.select(F.explode("_hits").alias("_i")).groupBy("_i").agg(F.count(F.lit(1)).alias("matches"))
    body = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    each = found.select(F.explode("_hits").alias("_i"), body.alias("event"), _time_of(events).alias("timestamp"))
    first = top_rows(each, ["_i"], [F.asc("timestamp"), F.asc("event")], samples, "_n").withColumn("event", F.to_json("event"))
    first = first.groupBy("_i").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "event"))), lambda s: s.getField("event")).alias("sample_events")
    )
    return counts.join(first, "_i").select(
        *_named(rules, F.col("_i")), F.lit(data_type).alias("data_type"), "matches", "sample_events",
        F.least("matches", F.lit(report_cap)).alias("match_count"),
    )


def _applicable(bundle: Mapping[str, DataFrame], rules: Iterable[Rule]) -> list[str]:
    types = {r.data_type for r in rules}
    names = [n for n in bundle if n in types]
    if not names:
        raise ValueError("no rule applies to the given data types")
    return names


def scan(bundle: Mapping[str, DataFrame], rules: Iterable[Rule]) -> DataFrame:
    """Matches over all data types that have both events and rules."""
    rules = list(rules)
    parts = [match_events(bundle[n], rules, n) for n in _applicable(bundle, rules)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_summary(bundle: Mapping[str, DataFrame], rules: Iterable[Rule], report_cap: int = 100, samples: int = 5) -> DataFrame:
    """Per-rule summary over all data types, most severe first; every log is
    scanned once, whatever the number of rules."""
    rules = list(rules)
    parts = [summarize(bundle[n], rules, n, report_cap, samples) for n in _applicable(bundle, rules)]
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(level_rank(), "rule_id")


def rule_list(spark, rules: Iterable[Rule]) -> DataFrame:
    rows = [(r.id, r.title, r.level, r.status, r.category, r.data_type, r.tactics, r.techniques, str(r.condition)) for r in rules]
    return spark.createDataFrame(
        rows,
        "id string, title string, level string, status string, category string, data_type string, "
        "tactics array<string>, techniques array<string>, condition string",
    )


# Rules shipped with the library, in our words over the public field names.
# The value lists are fixed values: they decide which events match.
SHIPPED_RULES = (
    Rule("auth-failed-logon", "Failed logons of existing accounts", "high", "authentication",
         {"failed": {"EventCode": "4625"}, "unknown_account": {"SubStatus": ["0xC0000064"]}},
         "failed and not unknown_account",
         ("attack.credential_access", "attack.t1110.001", "attack.t1110.003")),
    Rule("defender-tampering", "Malware protection switched off or given exclusions", "critical", "ps_script",
         {"script": {"ScriptBlockText|contains": [
             "Set-MpPreference", "DisableRealtimeMonitoring", "DisableBehaviorMonitoring",
             "DisableIOAVProtection", "DisableScriptScanning", "Add-MpPreference",
             "ExclusionPath", "ExclusionExtension", "ExclusionProcess"]}},
         "script", ("attack.defense_evasion", "attack.t1562.001")),
    Rule("remote-service-execution", "Remote execution tools", "high", "process_creation",
         {"tool_image": {"Image|endswith": ["\\PsExec.exe", "\\PsExec64.exe", "\\PSEXESVC.exe"]},
          "tool_command": {"CommandLine|contains": ["psexec", "\\\\*\\ADMIN$", "\\\\*\\C$", "winexe"]}},
         "tool_image or tool_command",
         ("attack.lateral_movement", "attack.t1570", "attack.execution", "attack.t1569.002")),
    Rule("abused-tld-lookup", "Lookup under an often abused top-level domain", "medium", "dns_query",
         {"name": {"domain|endswith": [
             ".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".xyz", ".buzz", ".surf", ".cyou", ".icu"]}},
         "name", ("attack.command_and_control", "attack.t1071.004")),
    Rule("autorun-key-change", "Change below an autorun registry key", "high", "registry_set",
         {"key": {"TargetObject|contains": [
             "\\CurrentVersion\\Run", "\\CurrentVersion\\RunOnce", "\\CurrentVersion\\RunServices",
             "\\CurrentVersion\\Policies\\Explorer\\Run", "\\CurrentVersion\\Explorer\\Shell Folders",
             "\\CurrentVersion\\Explorer\\User Shell Folders"]}},
         "key", ("attack.persistence", "attack.t1547.001")),
    Rule("scheduled-task-created", "Scheduled task registered", "high", "taskscheduler",
         {"registered": {"EventCode": "4698"},
          "command": {"CommandLine|contains": ["schtasks", "/create", "Register-ScheduledTask"]}},
         "registered or command", ("attack.persistence", "attack.t1053.005", "attack.execution")),
    Rule("script-download", "Script fetching a remote payload", "high", "ps_script",
         {"script": {"ScriptBlockText|contains": [
             "Invoke-WebRequest", "IWR ", "wget ", "curl ", "Net.WebClient", "DownloadString",
             "DownloadFile", "DownloadData", "Invoke-RestMethod", "Start-BitsTransfer", "bitsadmin"]}},
         "script", ("attack.execution", "attack.t1059.001", "attack.command_and_control", "attack.t1105")),
    Rule("script-encoded-command", "Script run from an encoded command", "high", "ps_script",
         {"script": {"ScriptBlockText|contains": [
             "-EncodedCommand", "-enc ", "FromBase64String", "[Convert]::FromBase64", "encodedcommand"]}},
         "script", ("attack.execution", "attack.t1059.001")),
    Rule("office-child-process", "Interpreter started by an office program", "high", "process_creation",
         {"parent": {"ParentImage|endswith": [
             "\\WINWORD.EXE", "\\EXCEL.EXE", "\\POWERPNT.EXE", "\\OUTLOOK.EXE", "\\MSPUB.EXE", "\\VISIO.EXE"]},
          "child": {"Image|endswith": [
              "\\cmd.exe", "\\powershell.exe", "\\pwsh.exe", "\\wscript.exe", "\\cscript.exe", "\\mshta.exe",
              "\\certutil.exe", "\\bitsadmin.exe", "\\regsvr32.exe", "\\rundll32.exe"]}},
         "parent and child",
         ("attack.initial_access", "attack.t1566.001", "attack.execution", "attack.t1204.002")),
)
