"""Root-cause analysis: propagation of faults along known rules.

Whether two logs may belong together is an equivalence (same device, else same host, else same file), so the
search runs for each such subject by itself, and within windows that are common to all subjects. A root explains what its rules
lead to in its window, and what it explains is nobody else's: that makes a window depend on those before it, but only through
logs that lie in both. So blocks of a few windows are searched side by side as if nothing were claimed before them; where
claims of earlier windows say otherwise a block is searched again with them, each round in blocks of twice the length, until
every window was searched with just the claims that reach it. No group holds a subject's whole history, unless claims do
pass through all of it.
"""

from __future__ import annotations

import bisect
import json
import re
import uuid
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syslumen.operators.windows import overlapping_windows
from syslumen.session import broadcast_if_small, micros, shared_dir


@dataclass(frozen=True)
class Edge:
    rule: str
    from_modules: tuple[str, ...]
    from_briefs: tuple[str, ...]
    to_modules: tuple[str, ...]
    to_briefs: tuple[str, ...]
    head: bool = False


def rule(name: str, *steps: tuple[str, str, str, str]) -> list[Edge]:
    """Edges of a rule; each step has comma-separated modules and briefs on either side. Edges whose start no other edge leads to are heads."""
    cut = lambda s: tuple(p.strip().upper() for p in s.split(",") if p.strip())
    edges = [Edge(name, *map(cut, s)) for s in steps]
    ends = {(m, b) for e in edges for m in e.to_modules for b in e.to_briefs}
    made = [Edge(e.rule, e.from_modules, e.from_briefs, e.to_modules, e.to_briefs, not any((m, b) in ends for m in e.from_modules for b in e.from_briefs)) for e in edges]
    for e in made:
        if set(e.from_modules) & set(e.to_modules) and set(e.from_briefs) & set(e.to_briefs):
            raise ValueError(f"{name}: an edge leads to itself")
    return made


# The built-in rules, what to do about them.
_IF = ("IFNET,PORT,ETHBASE", "IF_DOWN,LINK_DOWN,PORT_DOWN,PORT_MAC_DOWN,PHY_DOWN")
_BFD = ("BFD", "BFD_SESS_DOWN,SESS_DOWN")
_ROUTING = ("BGP,OSPF,OSPFV3,ISIS", "PEER_BACKWARD,NBR_CHG,PEER_DOWN,STATE_CHANGED")
_AUTH = ("AAA", "USER_AUTH_FAIL,AUTHEN_FAIL,AUTH_FAIL,hwUserAuthenFailure")
_CRC = ("ETHBASE,IFNET,PORT", "CRC_ERR,INPUT_ERR,CRC_ERROR")
_OFF = ("PORTAL,DOT1X,BRAS", "USER_OFFLINE,CUT_OFF")
RULES: list[Edge] = [
    *rule("LINK_ROUTING_CASCADE", (*_IF, *_BFD), (*_BFD, *_ROUTING), (*_IF, *_ROUTING), (*_ROUTING, "RM,STATIC_ROUTE,ROUTING", "ROUTE_DELETE,ROUTE_DEL,UNREACHABLE")),
    *rule("OPTICAL_CRC_DOWN", ("OPTICAL,TRANSCEIVER,DEVM", "OPTICAL_POWER,TRANSCEIVER_FAIL,POWER_ABNORMAL,MODULE_EXCEPTION", *_CRC), (*_CRC, "ETHBASE,IFNET,PORT", "IF_DOWN,PORT_DOWN,LINK_DOWN")),
    *rule("RADIUS_AUTH_CASCADE", ("AAA,RADIUS", "hwRadiusAuthServerDown,hwRadiusAcctServerDown,SERVER_DOWN,RADIUS_DOWN", *_AUTH), (*_AUTH, *_OFF), (*_OFF, "IPSEC,SSLVPN", "DISCONNECT")),
    *rule("MLAG_PEERLINK_DAD", ("MLAG,DFS,PEERLINK", "PEERLINK_DOWN,DFS_DOWN,HEARTBEAT_LOST", "MLAG", "DUAL_ACTIVE"), ("MLAG", "DUAL_ACTIVE", "IFNET,PORT,LACP,STP", "PORT_ERRORDOWN,PORT_DISABLED,STANDBY_DISABLE,ERROR_DOWN")),
    *rule("RESOURCE_OVERLOAD_TIMEOUT", ("DEVM,SYSTEM,RESOURCE", "CPU_OVERLOAD,CPU_HIGH,MEM_OVERLOAD,MEM_HIGH,RESOURCE_EXHAUST,CPU_USAGE_HIGH,CPURISING,MEM_USAGE_HIGH", "BGP,OSPF,BFD,LACP,VRRP", "HOLD_TIME_EXPIRED,KEEPALIVE_TIMEOUT,TIMER_EXPIRED,STATE_CHANGED")),
]
ACTIONS = {
    "LINK_ROUTING_CASCADE": "Check the interface that failed first, its cable and its peer.",
    "OPTICAL_CRC_DOWN": "Check the optical module's power and clean or replace it.",
    "RADIUS_AUTH_CASCADE": "Check that the RADIUS servers can be reached and answer.",
    "MLAG_PEERLINK_DAD": "Check the peer link and its heartbeat.",
    "RESOURCE_OVERLOAD_TIMEOUT": "Find what takes CPU or memory.",
}
# Parameters that name an entity, by kind, and what recoveries end in or hold.
ENTITIES = {
    "interface": ("InterfaceName", "Interface", "IfName", "PortName", "IfIndex", "LocalIfname", "LocalIfName"),
    "peer_ip": ("PeerIP", "PeerAddr", "PeerAddress", "NbrAddr", "RemoteAddr", "RemoteIP", "NbrIpAddr"),
    "session_id": ("SessionID", "SessionId", "SessID", "SessId", "Session"),
}
_RECOVERY = re.compile(r"(_CLEAR|_RECOVER|_UP|_NORMAL|_OK|_RESUME)$|_CLEAR|_RECOVER")
WINDOW_S, OVERLAP_S, NODES, EVENTS = 300, 60, 500, 2000
#: Windows of a block in the first round at least, and rows of a subject there at most if it is longer.
BLOCK, ROWS = 16, 20_000


def sample(logs: DataFrame, most: int | None = 100_000) -> DataFrame:
    """What the analysis looks at: matched or at least error rows with a time, the first ``most`` of them (all if None)."""
    own = logs.where("timestamp IS NOT NULL AND (knowledge_id > 0 OR severity <= 4)")
    return own if most is None else own.orderBy("timestamp", "id").limit(most)


def subject() -> Column:
    return F.when(F.col("device_id") > 0, F.concat(F.lit("d:"), F.col("device_id").cast("string"))).when(F.col("hostname") != "", F.concat(F.lit("h:"), "hostname")).otherwise(F.concat(F.lit("f:"), F.coalesce("source_file", F.lit(""))))


def starts(edge: Edge, module: str, brief: str) -> bool:
    """Roots and steps start where the module is one of the edge's and the brief holds one of its words."""
    return module in edge.from_modules and any(w in brief for w in edge.from_briefs)


def is_root(rules: list[Edge] | None = None) -> Column:
    """Whether a log can be a root: some head edge starts from its module and a word of its brief."""
    heads = [e for e in (RULES if rules is None else rules) if e.head]
    out = F.lit(False)
    for e in heads:
        words = F.lit(False)
        for w in e.from_briefs:
            words = words | F.upper("brief").contains(w)
        out = out | (F.upper("module").isin(*e.from_modules) & words)
    return out


def entities(parameters: str | None) -> dict[str, str]:
    try:
        own = json.loads(parameters) if parameters else {}
    except ValueError:
        return {}
    if not isinstance(own, dict):
        return {}
    plain = {str(k).lower(): str(v).strip().lower() for k, v in own.items()}
    found = {kind: next((plain[n.lower()] for n in names if plain.get(n.lower())), "") for kind, names in ENTITIES.items()}
    return {kind: v for kind, v in found.items() if v}


def confidence(depth: int, evidence: int, first_delay_s: float, signal: bool, agrees: bool) -> float:
    """.50, .09 a level up to .27, .03 a log up to .18, .15 that halves every 150 s until the first log, and .08 or -.10 for what entities say."""
    value = 0.50 + min(0.27, 0.09 * depth) + min(0.18, 0.03 * evidence) + 0.15 * 2 ** (-first_delay_s / 150) + ((0.08 if agrees else -0.10) if signal else 0)
    return int(min(0.98, max(0.05, value)) * 100 + 0.5) / 100


def impact_level(n: int, root_severity: int) -> str:
    return "CRITICAL" if n >= 3 or root_severity <= 2 else "HIGH" if n >= 2 else "MEDIUM" if root_severity <= 4 else "LOW"


_IMPACTS = "array<struct<log_id:bigint,from_log_id:bigint,module:string,brief:string,delay_ms:bigint>>"
_EVENT = f"subject string, rule string, root_id bigint, root_us bigint, root_module string, root_brief string, window int, n_impacts int, impact_level string, confidence double, correlated_ids array<bigint>, impacts {_IMPACTS}, action string"
_EVENTS = "array<struct<" + ",".join(f.replace(" ", ":", 1) for f in _EVENT.split(", ")[1:]) + ">>"
#: What is known of a window of a subject: the ids in it that were claimed before it, its events, and what these claim in later windows.
_WINDOW = f"subject string, window int, used array<bigint>, reaches array<struct<id:bigint,window:int>>, events {_EVENTS.replace('window:int,', '')}"


class _Untaken:
    """Positions of a list that aren't seen yet, by jumps over those that are."""

    def __init__(self, places: list[int], seen: set[int]):
        self.places, self.seen, self.jump = places, seen, {}

    def after(self, k: int) -> int:
        """The first index from ``k`` on whose position isn't seen."""
        passed = []
        while k < len(self.places) and self.places[k] in self.seen:
            passed.append(k)
            k = self.jump.get(k, k + 1)
        self.jump.update((p, k) for p in passed)
        return k


def _search(rows: list[dict], windows: list[tuple[int, int, int]], claimed: set[int], rules: list[Edge], most_nodes: int | None) -> list[tuple]:
    """The events of some windows in their order, from the logs of one subject by time; claims are added to ``claimed``.

    Per window: ``window, used, reaches, events``; windows without any of these are left out.
    """
    times, order = [r["us"] for r in rows], [(r["us"], r["id"]) for r in rows]
    exact: dict[tuple[str, str], list[int]] = {}
    for k, r in enumerate(rows):
        r["entities"] = entities(r["parameters_json"])
        r["recovery"] = bool(_RECOVERY.search(r["brief"]))
        r["edges"] = [e for e in rules if starts(e, r["module"], r["brief"])]
        exact.setdefault((r["module"], r["brief"]), []).append(k)
    out, tried = [], {}
    for window, start, end in windows:
        low, high = bisect.bisect_left(times, start), bisect.bisect_right(times, end)
        used = sorted(rows[k]["id"] for k in range(low, high) if rows[k]["id"] in claimed)
        events, own = [], set()
        for k in range(low, high):
            root = rows[k]
            # what found nothing up to an end finds nothing up to the same again
            if root["id"] in claimed or root["recovery"] or not root["edges"] or tried.get(k, -1) >= high:
                continue
            first = next((e for e in root["edges"] if e.head), root["edges"][0])
            last = min(high, bisect.bisect_right(times, root["us"] + WINDOW_S * 1_000_000))
            queue, seen, found, lists = deque([(k, 0)]), {k}, [], {}
            deepest, signal, agrees = 0, False, True
            full = lambda: most_nodes is not None and len(found) >= most_nodes  # noqa: B023, E731
            while queue and not full():
                at, depth = queue.popleft()
                mine = rows[at]["entities"]
                for key in ((m, b) for e in rows[at]["edges"] for b in e.to_briefs for m in e.to_modules):
                    if key not in exact:
                        continue
                    free = lists.setdefault(key, _Untaken(exact[key], seen))
                    i = free.after(bisect.bisect_right(free.places, at))
                    while i < len(free.places) and free.places[i] < last and not full():
                        j = free.places[i]
                        other = rows[j]
                        its = other["entities"]
                        if not other["recovery"] and order[j] > order[at] and not any(mine[n] != its[n] for n in mine.keys() & its.keys()):
                            if mine or its:
                                signal, agrees = True, agrees and mine.keys() == its.keys()
                            if other["id"] not in claimed:
                                seen.add(j)
                                found.append((j, at))
                                deepest = max(deepest, depth + 1)
                                queue.append((j, depth + 1))
                        i = free.after(i + 1)
            if not found:
                tried[k] = high
                continue
            hit = [rows[j] for j, _ in found]
            ids = [root["id"], *(h["id"] for h in hit)]
            claimed.update(ids)
            own.update(seen)
            delay = (min(h["us"] for h in hit) - root["us"]) / 1e6
            impacts = [{"log_id": rows[j]["id"], "from_log_id": rows[a]["id"], "module": rows[j]["module"], "brief": rows[j]["brief"], "delay_ms": (rows[j]["us"] - root["us"]) // 1000} for j, a in found]
            events.append((first.rule, root["id"], root["us"], root["module"], root["brief"], len(found), impact_level(len(found), root["severity"]), confidence(deepest, len(found), delay, signal, agrees), sorted(ids), impacts, ACTIONS.get(first.rule, "")))
        reaches = [(rows[k]["id"], int(w)) for k in sorted(own) for w in rows[k]["windows"] if w > window]
        if used or events:
            out.append((window, used, reaches, events))
    return out


def placed(logs: DataFrame, rules: list[Edge]) -> DataFrame:
    """``subject, id, us, module, brief, severity, parameters_json, windows`` of the rows that rules name: each with the windows it lies in."""
    own = logs.select("id", subject().alias("subject"), F.upper("module").alias("module"), F.upper("brief").alias("brief"), "severity", "parameters_json", micros("timestamp").alias("us")).where("us IS NOT NULL")
    windows = overlapping_windows(own, WINDOW_S, OVERLAP_S)
    modules = sorted({m for e in rules for m in (*e.from_modules, *e.to_modules)})
    # a window touches two slots of its length, so that logs find theirs by an equal slot
    length = WINDOW_S * 1_000_000
    slot = lambda c: F.floor(F.col(c) / length)
    slotted = windows.withColumn("slot", F.explode(F.array_distinct(F.array(slot("start_us"), slot("end_us")))))
    # the windows of a slot are few: they begin at least a step apart
    slotted = slotted.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("window", "start_us", "end_us"))).alias("near"))
    rows = own.where(F.col("module").isin(*modules)).withColumn("slot", slot("us")).join(slotted, "slot")
    inside = F.filter("near", lambda w: (F.col("us") >= w["start_us"]) & (F.col("us") <= w["end_us"]))
    return rows.withColumn("windows", inside).where(F.size("windows") > 0).drop("slot", "near")


def _block(size: int):
    return F.floor(F.col("window") / size)


def _round(rows: DataFrame, claims: DataFrame | None, size: int, rules: list[Edge], most_nodes: int | None, within: tuple[int, int] | None) -> DataFrame:
    """What is known of the windows of ``rows`` (one a log and block), in blocks of ``size`` windows; ``claims`` are ids taken before a block."""
    low, high = within or (0, 1 << 62)
    claims = claims.withColumn("taken", F.lit(True)) if claims is not None else None
    own = rows.join(claims, ["subject", "block", "id"], "left") if claims is not None else rows.withColumn("taken", F.lit(None).cast("boolean"))
    edges = rules

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        logs = pdf.drop_duplicates("id").sort_values(["us", "id"])
        block, taken = int(pdf["block"].iloc[0]), set(logs.loc[logs["taken"].notna(), "id"].tolist())
        records = logs.drop(columns=["taken", "block"]).to_dict("records")
        windows = {}
        for r in records:
            for w in r["windows"]:
                if w["window"] // size == block and low <= w["window"] < high:
                    windows[int(w["window"])] = (int(w["window"]), int(w["start_us"]), int(w["end_us"]))
            r["windows"] = [w["window"] for w in r["windows"]]
        made = _search(records, [windows[w] for w in sorted(windows)], taken, edges, most_nodes)
        names = ["rule", "root_id", "root_us", "root_module", "root_brief", "n_impacts", "impact_level", "confidence", "correlated_ids", "impacts", "action"]
        told = [(pdf["subject"].iloc[0], w, used, [{"id": i, "window": x} for i, x in reaches], [dict(zip(names, e, strict=True)) for e in events]) for w, used, reaches, events in made]
        return pd.DataFrame(told, columns=["subject", "window", "used", "reaches", "events"])

    return own.groupBy("subject", "block").applyInPandas(search, _WINDOW)


def settled(rows: DataFrame, rules: list[Edge], most_nodes: int | None = NODES, before: DataFrame | None = None, base: str | None = None, within: tuple[int, int] | None = None) -> DataFrame:
    """What is known of every window of ``rows`` (as ``placed`` gives them) once claims agree, as a written table.

    ``within`` are the first window that is searched and the first one after them (all if None); ``before`` are claims
    (``subject, id, window``) of windows before these.
    """
    spark = rows.sparkSession
    base = base or f"{shared_dir(spark)}/rca-{uuid.uuid4().hex}"

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    rows = write(rows, "rows")
    # a log is in each block that one of its windows is in
    asked = (lambda w: (w >= within[0]) & (w < within[1])) if within else (lambda w: w >= 0)
    own = F.filter("windows", lambda w: asked(w["window"]))
    dealt = lambda size: rows.withColumn("block", F.explode(F.array_distinct(F.transform(own, lambda w: F.floor(w["window"] / size)))))
    outer = before.select("subject", "id", "window", F.lit(-1).alias("by")) if before is not None else None
    # sparse logs are searched in longer blocks, as each is a task's call of its own
    densest = dealt(BLOCK).groupBy("subject", "block").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).head()["n"] or 1
    size, k, known = BLOCK * max(1, ROWS // densest), 0, None
    changed = None
    while known is None or changed is not None:
        if known is None:
            claims = outer.select("subject", "id", _block(size).alias("block")).distinct() if outer is not None else None
            known = write(_round(dealt(size), claims, size, rules, most_nodes, within), f"known-{k}")
        else:
            blocks = changed.select("subject", _block(size).alias("block")).distinct()
            claims = reached.where(F.floor(F.col("by") / size) < _block(size)).select("subject", "id", _block(size).alias("block")).distinct()  # noqa: F821
            fresh = _round(dealt(size).join(blocks, ["subject", "block"], "left_semi"), claims, size, rules, most_nodes, within)
            kept = known.withColumn("block", _block(size)).join(blocks, ["subject", "block"], "left_anti").drop("block")
            known = write(kept.unionByName(fresh), f"known-{k}")
        # claims that reach a window against those that it was searched with
        reached = known.select("subject", F.col("window").alias("by"), F.explode("reaches").alias("r")).select("subject", F.col("r.id").alias("id"), F.col("r.window").alias("window"), "by")
        reached = (reached if outer is None else reached.unionByName(outer)).where(asked(F.col("window")))
        due = reached.groupBy("subject", "window").agg(F.sort_array(F.collect_set("id")).alias("due"))
        had = known.where(F.size("used") > 0).select("subject", "window", "used")
        changed = write(due.join(had, ["subject", "window"], "full").where(~F.col("due").eqNullSafe(F.col("used"))).select("subject", "window"), f"changed-{k}")
        changed = None if changed.isEmpty() else changed
        size, k = size * 2, k + 1
    return known


def events_of(known: DataFrame) -> DataFrame:
    """The events of settled windows, one a row."""
    each = known.select("subject", "window", F.explode("events").alias("e"))
    names = [f.split(" ", 1)[0] for f in re.sub(r"<[^ ]*>", "", _EVENT).split(", ")]
    return each.select(*(F.col(n) if n in ("subject", "window") else F.col(f"e.{n}").alias(n) for n in names))


def analyse(logs: DataFrame, rules: list[Edge] | None = None, most_events: int | None = EVENTS, most_nodes: int | None = NODES) -> DataFrame:
    """Root events with the logs that they explain, the first ``most_events`` in order of window, time and id (all if None).

    An event explains at most ``most_nodes`` logs (any number if None).
    """
    rules = RULES if rules is None else rules
    found = events_of(settled(placed(logs, rules), rules, most_nodes))
    return found if most_events is None else found.orderBy("window", "root_us", "root_id").limit(most_events)


def one_hop(logs: DataFrame, edge: Edge, within_s: int = WINDOW_S) -> DataFrame:
    """Pairs of a log that an edge starts from and one that it leads to, of the same subject and at most so much later.

    Joined on subject and half-open slots of the window's length, so that a pair is found in one of two slots.
    """
    us = micros("timestamp")
    cols = [subject().alias("subject"), "id", us.alias("us")]
    length = within_s * 1_000_000
    a = logs.where(F.upper("module").isin(*edge.from_modules) & F.upper("brief").isin(*edge.from_briefs) & F.col("timestamp").isNotNull()).select(*cols)
    b = logs.where(F.upper("module").isin(*edge.to_modules) & F.upper("brief").isin(*edge.to_briefs) & F.col("timestamp").isNotNull()).select(*cols)
    slot = F.floor(F.col("us") / length)
    a = a.withColumn("slot", F.explode(F.array(slot, slot + 1))).withColumnsRenamed({"id": "from_id", "us": "from_us"})
    b = b.withColumn("slot", slot).withColumnsRenamed({"id": "to_id", "us": "to_us"})
    later = (F.col("to_us") > F.col("from_us")) | ((F.col("to_us") == F.col("from_us")) & (F.col("to_id") > F.col("from_id")))
    return a.join(b, ["subject", "slot"]).where(later & (F.col("to_us") <= F.col("from_us") + length)).select("subject", "from_id", "to_id", (F.col("to_us") - F.col("from_us")).alias("delay_us"))


def enriched(events: DataFrame, logs: DataFrame, devices: DataFrame) -> DataFrame:
    """Events with their logs' raw lines and the device's name: lists are exploded, joined and gathered again."""
    rows = events.select("root_id", F.posexplode("correlated_ids").alias("place", "id")).join(logs.select("id", "raw_log", "device_id"), "id")
    rows = rows.join(broadcast_if_small(devices.select("device_id", "device_name")), "device_id", "left")
    made = rows.groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "raw_log", "device_name"))).alias("logs"))
    return events.join(made, "root_id", "left")


from syslumen.session import by_value  # noqa: E402

by_value(__name__)
