"""The filter language: a JSON object of conditions and flat fields, compiled to one predicate and some joins.

Everything simple stays a column expression, which Spark pushes into the scan where it can. Tag conditions
are semi and anti joins; under OR, where a join can't stand, they become flags of one left join against the
tagged ids.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter that names an unknown field or operator, or holds a value that can't be read."""


# Fields, their columns and the operators that each allows.
_TEXT = ("contains", "not_contains", "regex", "not_regex", "eq", "prefix", "suffix")
OPERATORS: dict[str, tuple[str, ...]] = {
    "tag": ("has_any", "has_all", "not_has", "is_empty", "is_not_empty"),
    "raw_log": _TEXT,
    "message_body": _TEXT,
    "hostname": _TEXT,
    "slot_info": _TEXT,
    "brief": (*_TEXT, "in", "not_in"),
    "module": (*_TEXT, "in", "not_in"),
    "source_file": ("eq", "contains", "prefix"),
    "parameters": ("kv_contains", "kv_not_contains", "kv_eq", "kv_regex", "kv_not_regex"),
    "severity": ("lte", "gte", "eq", "in", "lt", "gt"),
    "match_tier": ("eq", "in", "not_in"),
    "match_confidence": ("gte", "lte", "gt", "lt", "eq"),
    "knowledge_id": ("gt", "gte", "eq", "lte", "lt"),
}
NUMBERS = ("severity", "match_confidence", "knowledge_id")
MOST_CONDITIONS = 15
MOST_BYTES = 256
_KEY = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_\-.]{0,63}")


@dataclass
class Condition:
    field: str
    op: str
    value: str = ""
    disabled: bool = False


@dataclass
class LogFilter:
    """All that narrows a log query; empty or None means no restriction."""

    logic: str = "AND"
    conditions: list[Condition] = field(default_factory=list)
    keyword: str = ""
    severity: int | None = None
    matched: bool | None = None
    device_id: int | None = None
    module: str = ""
    brief: str = ""
    hostname: str = ""
    source_file: str = ""
    time_start: Any = None
    time_end: Any = None
    exclude_comment: bool = False
    tag_ids: list[int] = field(default_factory=list)
    tag_logic: str = "any"
    exclude_tag_ids: list[int] = field(default_factory=list)
    untagged_only: bool = False

    @staticmethod
    def of(request: dict[str, Any]) -> LogFilter:
        """From the JSON form of a request; unknown keys (paging, order) are left out."""
        own = {k: v for k, v in request.items() if k in LogFilter.__dataclass_fields__ and v is not None and k not in ("conditions", "logic")}
        more = request.get("advanced") or {}
        made = [Condition(c["field"], c["op"], str(c.get("value", "")), bool(c.get("disabled", False))) for c in more.get("conditions") or []]
        return LogFilter(logic=more.get("logic") or "AND", conditions=made, **own)


def escaped(value: str) -> str:
    """``value`` with the wildcards of LIKE escaped."""
    return re.sub(r"([\\%_])", r"\\\1", value)


def csv(value: str) -> list[str]:
    return [p.strip() for p in value.split(",") if p.strip()]


def positive_ids(value: str) -> list[int]:
    """The positive whole numbers of a comma-separated list, each once, in order."""
    return list(dict.fromkeys(int(p) for p in csv(value) if p.isdigit() and int(p) > 0))


def java_regex(pattern: str) -> str:
    """An RE2 pattern for Java: named groups, ``.`` that stops at \\n only, ``$`` that is the very end."""
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    out, in_class, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out.append(pattern[k : k + 2])
            k += 2
            continue
        in_class = (c == "[" or in_class) and c != "]"
        out.append(r"\z" if c == "$" and not in_class else c)
        k += 1
    made = "(?d)" + "".join(out)
    try:
        re.compile(re.sub(r"\(\?[a-z]+\)", "", re.sub(r"\\z", r"\\Z", made.replace("(?<", "(?P<")).replace("(?P<=", "(?<=").replace("(?P<!", "(?<!")))
    except re.error as e:
        raise FilterError(f"regular expression {pattern!r}: {e}") from e
    return made


def _number(value: str) -> float:
    try:
        return float(value)
    except ValueError as e:
        raise FilterError(f"{value!r} is no number") from e


def _text(c: Column, op: str, value: str, fold: bool) -> Column:
    like = escaped(value)
    if op in ("contains", "not_contains"):
        yes = lambda x: x.ilike(f"%{like}%")
        return yes(c) if op == "contains" else ~yes(F.coalesce(c, F.lit("")))
    if op in ("prefix", "suffix"):
        return c.ilike(f"{like}%" if op == "prefix" else f"%{like}")
    if op in ("regex", "not_regex"):
        pattern = java_regex(f"(?i){value}" if fold else value)
        return F.coalesce(c.rlike(pattern), F.lit(False)) if op == "regex" else ~F.coalesce(c, F.lit("")).rlike(pattern)
    if op == "eq":
        return F.upper(c) == value.upper() if fold else c == value
    listed = [v.upper() for v in csv(value)] if fold else csv(value)
    own = F.upper(c) if fold else c
    if op == "in":
        return own.isin(*listed) if listed else F.lit(False)
    return ~F.coalesce(own, F.lit("")).isin(*listed) if listed else F.lit(True)


def _numeric(c: Column, op: str, value: str) -> Column:
    if op == "in":
        listed = [_number(v) for v in csv(value)]
        return c.isin(*listed) if listed else F.lit(False)
    n = _number(value)
    return {"eq": c == n, "lt": c < n, "lte": c <= n, "gt": c > n, "gte": c >= n}[op]


def _parameter(op: str, value: str) -> Column:
    key, sep, wanted = value.partition("=")
    key, wanted = key.strip(), wanted.strip()
    if not sep or not _KEY.fullmatch(key):
        raise FilterError(f"{value!r} is not key=value")
    path = ".".join(key.split("."))
    c = F.get_json_object("parameters_json", f"$.{path}")
    plain = {"kv_contains": "contains", "kv_not_contains": "not_contains", "kv_eq": "eq", "kv_regex": "regex", "kv_not_regex": "not_regex"}[op]
    return _text(c, plain, wanted, False)


def check(c: Condition) -> None:
    if c.field not in OPERATORS:
        raise FilterError(f"unknown field {c.field!r}")
    if c.op not in OPERATORS[c.field]:
        raise FilterError(f"{c.field} has no operator {c.op!r}")
    if len(c.value.encode()) > MOST_BYTES:
        raise FilterError(f"a value has at most {MOST_BYTES} bytes")


def predicate(c: Condition) -> Column:
    """Of a condition on anything but tags."""
    check(c)
    if c.field == "parameters":
        return _parameter(c.op, c.value)
    column = F.col(c.field)
    return _numeric(column, c.op, c.value) if c.field in NUMBERS else _text(column, c.op, c.value, c.field == "module")


def keyword(value: str) -> Column | None:
    kw = value.strip()
    if not kw:
        return None
    both = F.concat("module", F.lit("/"), "brief")
    like = lambda c, v: c.ilike(f"%{escaped(v)}%")
    raw, body, brief, module = (F.col(n) for n in ("raw_log", "message_body", "brief", "module"))
    plain = like(raw, kw) | like(body, kw) | like(brief, kw) | like(module, kw) | like(both, kw)
    if kw[0] == "#" and kw[1:].isdigit():
        return (F.col("id") == int(kw[1:])) | plain
    left, sep, right = (p.strip() for p in kw.partition("/"))
    if sep and left and right:
        return like(raw, kw) | like(body, kw) | like(both, kw) | (like(module, left) & like(brief, right))
    return plain


def flat(f: LogFilter) -> list[Column]:
    """The predicates of the plain fields."""
    out = []
    if f.exclude_comment:
        out.append(F.col("module") != "COMMENT")
    if f.device_id is not None:
        out.append(F.col("device_id") == f.device_id)
    if f.module:
        out.append(F.upper("module") == f.module.upper())
    if f.severity is not None:
        out.append(F.col("severity") <= f.severity)
    for name, value in (("brief", f.brief), ("hostname", f.hostname)):
        if value:
            out.append(F.col(name).ilike(f"%{escaped(value)}%"))
    if f.source_file:
        out.append((F.col("source_file") == f.source_file) | F.col("source_file").like(rf"%]\_{escaped(f.source_file)}"))
    if f.matched is not None:
        out.append(F.col("knowledge_id") > 0 if f.matched else F.coalesce(F.col("knowledge_id"), F.lit(0)) == 0)
    if f.time_start is not None:
        out.append(F.col("timestamp") >= F.lit(f.time_start).cast("timestamp_ntz"))
    if f.time_end is not None:
        out.append(F.col("timestamp") <= F.lit(f.time_end).cast("timestamp_ntz"))
    found = keyword(f.keyword)
    return out if found is None else [*out, found]


def tagged(relations: DataFrame, ids: list[int], all_of: bool = False) -> DataFrame:
    """``id`` of logs with one of the tags, or with all of them; without ids, of logs with any tag."""
    own = relations.where(F.col("log_id").isNotNull())
    if ids:
        own = own.where(F.col("tag_id").isin(*ids))
    if ids and all_of:
        own = own.groupBy("log_id").agg(F.countDistinct("tag_id").alias("n")).where(F.col("n") == len(ids))
    return own.select(F.col("log_id").alias("id")).distinct()


def _tag_join(c: Condition, relations: DataFrame) -> tuple[DataFrame | None, bool]:
    """The tagged ids of a condition and whether logs must be among them; None if no id is given."""
    check(c)
    if c.op in ("is_empty", "is_not_empty"):
        return tagged(relations, []), c.op == "is_not_empty"
    ids = positive_ids(c.value)
    if not ids:
        raise FilterError("a tag condition needs ids")
    return tagged(relations, ids, c.op == "has_all"), c.op != "not_has"


def apply(logs: DataFrame, f: LogFilter, relations: DataFrame | None = None) -> DataFrame:
    """The rows of ``logs`` that the filter lets through, lazily."""
    live = [c for c in f.conditions if not c.disabled]
    if len(f.conditions) > MOST_CONDITIONS:
        raise FilterError(f"at most {MOST_CONDITIONS} conditions")
    if f.untagged_only and (f.tag_ids or f.exclude_tag_ids):
        raise FilterError("untagged_only excludes tag ids")
    if relations is None and (f.tag_ids or f.exclude_tag_ids or f.untagged_only or any(c.field == "tag" for c in live)):
        raise FilterError("tag conditions need the tag relations")
    out = logs
    for p in flat(f):
        out = out.where(p)
    if f.logic.upper() == "OR":
        parts, flags = [], []
        for k, c in enumerate(live):
            if c.field == "tag":
                ids, wanted = _tag_join(c, relations)
                out = out.join(ids.withColumn(f"__tag{k}", F.lit(True)), "id", "left")
                flags.append(f"__tag{k}")
                parts.append(F.col(f"__tag{k}").isNotNull() if wanted else F.col(f"__tag{k}").isNull())
            else:
                parts.append(predicate(c))
        if parts:
            out = out.where(reduce(lambda a, b: a | b, parts)).drop(*flags)
    else:
        for c in live:
            if c.field != "tag":
                out = out.where(predicate(c))
        for c in live:
            if c.field == "tag":
                ids, wanted = _tag_join(c, relations)
                out = out.join(ids, "id", "left_semi" if wanted else "left_anti")
    if f.tag_ids:
        out = out.join(tagged(relations, f.tag_ids, f.tag_logic == "all"), "id", "left_semi")
    if f.exclude_tag_ids:
        out = out.join(tagged(relations, f.exclude_tag_ids), "id", "left_anti")
    if f.untagged_only:
        out = out.join(tagged(relations, []), "id", "left_anti")
    return out


# The built-in expert filters.
PRESETS: dict[str, dict[str, Any]] = {
    "sys_link_flap": {"severity": 4, "advanced": {"conditions": [{"field": "module", "op": "in", "value": "IFNET,MSTP,ETH-TRUNK"}, {"field": "brief", "op": "regex", "value": "(?i)(down|flap|change|topology)"}]}},
    "sys_routing_anomaly": {"severity": 4, "advanced": {"conditions": [{"field": "module", "op": "in", "value": "BGP,OSPF,ISIS"}, {"field": "raw_log", "op": "regex", "value": "(?i)(down|fail|reset|expire|backward)"}]}},
    "sys_security_attack": {"severity": 3, "advanced": {"conditions": [{"field": "module", "op": "in", "value": "SEC,ACL,FW,FILTER,BLACKLIST"}]}},
    "sys_unmatched_kb": {"matched": False, "severity": 4},
    "sys_hardware_env": {"severity": 3, "advanced": {"conditions": [{"field": "module", "op": "in", "value": "DEVM,POWER,FAN,ENVMON,SFP,CARD"}]}},
    "sys_untagged_audit": {"untagged_only": True},
}


def order(logs: DataFrame, sort_by: str = "timestamp", direction: str = "asc") -> DataFrame:
    """Log order: time, then id; rows without a time come first (last, if descending)."""
    down = direction.lower() == "desc"
    ids = F.desc("id") if down else F.asc("id")
    if sort_by == "id":
        return logs.orderBy(ids)
    return logs.orderBy(F.desc_nulls_last("timestamp") if down else F.asc_nulls_first("timestamp"), ids)


def page(logs: DataFrame, number: int = 1, size: int = 50, sort_by: str = "timestamp", direction: str = "asc", after_id: int = 0, most: int = 10_000) -> DataFrame:
    """One page by offset, or by key if ``after_id`` is given, which only the order by ascending id allows."""
    size = 50 if size <= 0 else min(size, most)
    if after_id:
        if sort_by != "id" or direction.lower() != "asc":
            raise FilterError("after_id needs sort_by=id and ascending order")
        return logs.where(F.col("id") > after_id).orderBy("id").limit(size)
    return order(logs, sort_by, direction).offset((max(number, 1) - 1) * size).limit(size)


def page_with_total(logs: DataFrame, **asked) -> DataFrame:
    """A page's rows, each with ``total``, the number of rows on all pages; the count is one row that goes along."""
    return page(logs, **asked).crossJoin(F.broadcast(logs.agg(F.count("*").alias("total"))))


def export_rows(logs: DataFrame, most: int | None = None) -> DataFrame:
    """All rows in log order, however many; with ``most``, more of them are an error."""
    if most is not None and logs.limit(most + 1).count() > most:
        raise FilterError(f"more than {most} rows; narrow the filter")
    return order(logs)
