"""Several devices on one timeline: log query, report and its conclusion."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syslumen.session import broadcast_if_small

from syslumen.operators import aggregates as A
from syslumen.operators import windows as W
from syslumen.plans import filters as P

# Modules that point at a kind of cause, in the order in which conclusions name them.
CAUSES: list[tuple[str, tuple[str, ...], str]] = [
    ("link", ("IFNET", "PORT", "ETHBASE", "LACP", "ETH-TRUNK"), "Link or port faults: check cabling, optics and the peer port."),
    ("routing", ("BGP", "OSPF", "OSPFV3", "ISIS", "RM", "BFD"), "Routing neighbours changed state: check reachability and timers."),
    ("loop", ("MSTP", "STP", "RSTP"), "Spanning tree changed: check for loops."),
    ("authentication", ("AAA", "RADIUS", "DOT1X", "PORTAL"), "Authentication failed: check servers and credentials."),
    ("hardware", ("DEVM", "POWER", "FAN", "OPTICAL", "TRANSCEIVER"), "Hardware reported faults: check boards, power, fans and optics."),
    ("security", ("SEC", "FW", "ACL", "ATTACK", "IPS"), "Security events: check policies and sources."),
    ("resources", ("SYSTEM", "RESOURCE", "CPU", "MEM"), "Resources ran short: check CPU and memory."),
]


def multi_device_logs(logs: DataFrame, device_ids: list[int] | None = None, modules: list[str] | None = None, briefs: list[str] | None = None, severity: int | None = None, keyword: str = "", time_start: Any = None, time_end: Any = None) -> DataFrame:
    """Rows of the devices (of any known device without a list) that all restrictions let through."""
    out = logs.where(F.col("device_id").isin(*device_ids) if device_ids else F.col("device_id") > 0)
    for name, listed in (("module", modules), ("brief", briefs)):
        if listed:
            out = out.where(F.upper(name).isin(*(v.upper() for v in listed)))
    return P.apply(out, P.LogFilter(severity=severity, keyword=keyword, time_start=time_start, time_end=time_end))


def timeline(logs: DataFrame, devices: DataFrame, limit: int = 500, **restrictions: Any) -> DataFrame:
    """The first rows in log order with the device's name, or the host's, or a placeholder."""
    first = P.order(multi_device_logs(logs, **restrictions)).limit(limit)
    names = devices.select("device_id", F.nullif("device_name", F.lit("")).alias("named"))
    host = F.nullif("hostname", F.lit(""))
    joined = first.join(broadcast_if_small(names), "device_id", "left").withColumn("device_name", F.coalesce("named", host, F.concat(F.lit("device-"), F.col("device_id").cast("string"))))
    return P.order(joined.drop("named"))


def report(logs: DataFrame, device_ids: list[int], limit: int = 500) -> dict[str, DataFrame]:
    """Parts of the report of several devices."""
    own = multi_device_logs(logs, device_ids)
    return {"devices": A.device_reports(own), "span": A.span(logs, device_ids), "common": A.common_events(own, len(device_ids), limit), "clusters": W.correlated_clusters(own, timeline_limit=limit), "critical": A.critical_total(own)}


def findings(logs: DataFrame) -> DataFrame:
    """Rows by kind of cause, with its place in the conclusion; kinds without rows are left out."""
    kind = None
    for k, (name, modules, _) in enumerate(CAUSES):
        test, value = F.upper("module").isin(*modules), F.struct(F.lit(k).alias("place"), F.lit(name).alias("cause"))
        kind = F.when(test, value) if kind is None else kind.when(test, value)
    own = logs.withColumn("__k", kind).where(F.col("__k").isNotNull())
    return own.groupBy(F.col("__k.place").alias("place"), F.col("__k.cause").alias("cause")).agg(F.count("*").alias("n"), F.min("severity").alias("worst_severity"))


def conclusion(logs: DataFrame, device_ids: list[int], clusters_shown: int = 3) -> str:
    """The numbered text that findings, common events and clusters give; what is collected has a fixed size."""
    advice = {name: text for name, _, text in CAUSES}
    parts = report(logs, device_ids)
    lines = [f"{r['n']} events. {advice[r['cause']]}" for r in findings(multi_device_logs(logs, device_ids)).orderBy("place").collect()]
    lines += [f"{r['event']} occurred on {r['devices']} devices." for r in parts["common"].orderBy(F.desc("n"), "event").limit(5).collect()]
    lines += [f"{r['events']} events on {r['devices']} devices within a minute of each other: {r['modules']}." for r in parts["clusters"].orderBy("start_us").limit(clusters_shown).collect()]
    return "\n".join(f"{k}. {line}" for k, line in enumerate(lines or ["No notable events."], 1))


def summary_markdown(logs: DataFrame, title: str) -> str:
    """The diagnosis summary as Markdown."""
    o = A.overview(logs).head()
    out = [f"# {title}", "", f"- rows: {o['total']}", f"- matched: {o['matched']} ({o['match_rate']} %)", f"- parsed: {o['parse_rate']} %", "", "| module | rows | worst severity |", "|-|-|-|"]
    out += [f"| {r['module']} | {r['n']} | {r['worst_severity']} |" for r in A.top_modules(logs).collect()]
    out += ["", "| unmatched event | rows |", "|-|-|"]
    out += [f"| {r['module']}/{r['brief']} | {r['n']} |" for r in A.unmatched_hotspots(logs).collect()]
    return "\n".join(out)
