"""A whole hunt: logs to detections to one assessment per window to cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.config import HuntConfig
from netquarry.operators import cases, correlate, findings, intel, rollup
from netquarry.session import stage


@dataclass(frozen=True)
class HuntResult:
    findings: DataFrame
    outputs: DataFrame
    assessments: DataFrame
    cases: DataFrame
    case_assets: DataFrame
    case_findings: DataFrame
    updated_cases: DataFrame | None = None


def windowed(bundle: Mapping[str, DataFrame], length: str, slide: str | None = None, ts: str = "timestamp") -> dict[str, DataFrame]:
    """Give every log frame its window start; a slide shorter than the length
    puts an event into each window that covers it."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return {
        name: df.withColumn("_w", w).withColumn("window_start", F.col("_w.start")).drop("_w")
        for name, df in bundle.items()
    }


def window_bounds_of(ranges: DataFrame, start: str, end: str, hours: float) -> DataFrame:
    """Fixed windows of each range row; the last one is clipped at its end."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600))
    return (
        ranges.withColumn("window_start", F.explode(F.sequence(F.col(start), F.col(end), step)))
        .where(F.col("window_start") < F.col(end))
        .select("window_start", F.least(F.col("window_start") + step, F.col(end)).alias("window_end"))
    )


def run_hunt(
    bundle: Mapping[str, DataFrame],
    cfg: HuntConfig = HuntConfig(),
    keys: Sequence[str] = (),
    fp_rates: DataFrame | None = None,
    staged: bool = False,
    created_at: str | None = None,
    hunt_id: str | None = None,
    hunted_at=None,
    open_cases: tuple[DataFrame, DataFrame] | None = None,
    open_hours: float = 24.0,
) -> HuntResult:
    """Detect, de-duplicate, roll up and assess per key; one lazy plan.

    A hunt with keys names its cases after them, with the time in column
    ``created_at``; one without needs ``hunt_id`` and ``hunted_at``, or its
    cases could not be told from another hunt's. With ``open_cases`` (cases
    and their assets) a new case that shares a technique and an asset with an
    open one of the last ``open_hours`` goes into it: ``updated_cases`` are
    the open ones with the greater confidence, ``cases`` the others, and links
    and assets carry the id of the case they went to.

    ``staged`` writes the flow summary, the finding table and the family
    outputs once each to the shared folder: the detections and the consumers
    of findings then scan small columnar tables instead of repeating the wide
    shuffle over raw logs.
    """
    if not keys and (hunt_id is None or hunted_at is None):
        raise ValueError("a hunt without keys needs hunt_id and hunted_at")
    if open_cases is not None and hunted_at is None:
        raise ValueError("matching open cases needs hunted_at")
    keep = stage if staged else (lambda df, name: df)
    ready = findings.prepare(dict(bundle), keys, stage if staged else None)
    found = keep(findings.run_detections(ready, cfg, keys, keep=keep), "findings")
    found = correlate.dedup_findings(found, keys, cfg.agent_priority)
    outputs = rollup.agent_rollup(found, keys)
    if cfg.agent_priority:
        priority = F.coalesce(*[F.when(F.col("agent") == a, F.lit(p)) for a, p in cfg.agent_priority.items()], F.lit(0.0))
        outputs = outputs.withColumn("priority", priority)
    outputs = keep(outputs, "outputs")
    assessments = correlate.assess(outputs, keys, fp_rates)
    names = list(keys) or ["hunt"]
    scored = assessments if keys else assessments.withColumn("hunt", F.lit(hunt_id))
    rows = found if keys else found.withColumn("hunt", F.lit(hunt_id))
    when = F.col(created_at) if created_at else F.lit(hunted_at).cast("timestamp")
    new = cases.new_cases(scored.withColumn("_at", when), names, "_at")
    owned = findings.asset_rows(found, ready.get("internal_pairs"), keys)
    owned = owned if keys else owned.withColumn("hunt", F.lit(hunt_id))
    assets, links = cases.case_assets(owned, new, names), cases.case_findings(rows, new, names)
    if open_cases is None:
        return HuntResult(found, outputs, assessments, new, assets, links)
    known, known_assets = open_cases
    index = cases.open_case_index(known, known_assets, F.lit(hunted_at).cast("timestamp"), open_hours)
    matches = cases.match_open_cases(new, assets, index)
    updated, fresh = cases.merge_cases(known, new, matches)
    return HuntResult(
        found, outputs, assessments, fresh, cases.moved(assets, matches), cases.moved(links, matches), updated,
    )


def bulk_hunt(
    bundle: Mapping[str, DataFrame], length: str, cfg: HuntConfig = HuntConfig(), slide: str | None = None, **kw
) -> HuntResult:
    """Every window of a history in one job: the window start joins the group
    keys, so there is no loop over windows."""
    return run_hunt(windowed(bundle, length, slide), cfg, ("window_start",), created_at="window_start", **kw)


def focused_hunt(
    bundle: Mapping[str, DataFrame], first: HuntResult, cfg: HuntConfig = HuntConfig(), **kw
) -> HuntResult:
    """A second hunt, with an id and time of its own, over only the events of addresses the first one named."""
    addresses = intel.suspicious_addresses(first.findings)
    again = {name: intel.focus(df, addresses) for name, df in bundle.items() if "source_ip" in df.columns}
    return run_hunt(again, cfg, **kw)
