"""The log table that queries run on: ``log_records`` as the engine stores it, or derived from an events table.

The derivation is written in expressions that Spark and DuckDB read alike, so that the same text makes the
table on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from syslumen.session import read

#: Kinds of rows among the events: comments, lines that no parser took, rows without a time.
_COMMENT, _UNPARSED, _UNTIMED = "event_id % 50 = 7", "event_id % 97 = 5", "event_id % 101 = 0"

_MODULES = {"click": "IFNET", "view": "BFD", "purchase": "BGP", "signup": "AAA", "error": "DEVM"}
_BRIEFS = {"click": "IF_DOWN", "view": "BFD_SESS_DOWN", "purchase": "PEER_BACKWARD", "signup": "hwRadiusAuthServerDown", "error": "OPTICAL_POWER"}


def _case(table: dict[str, str], comment: str, unparsed: str) -> str:
    return f"CASE WHEN {_COMMENT} THEN '{comment}' WHEN {_UNPARSED} THEN '{unparsed}' " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in table.items()) + " ELSE 'SHELL' END"


_MODULE, _BRIEF = _case(_MODULES, "COMMENT", "UNKNOWN"), _case(_BRIEFS, "COMMENT_LINE", "UNPARSED")
_HOST = "'HOST-' || CAST(user_id % 5 AS STRING)"
_BODY = "'Interface GE0/0/' || CAST(user_id % 24 AS STRING) || ' reported ' || event_type || '. (User=' || CAST(user_id AS STRING) || ', Code=' || CAST(event_id % 7 AS STRING) || ')'"
_SEVERITY = f"CASE WHEN {_COMMENT} THEN 6 WHEN {_UNPARSED} THEN 8 ELSE 1 + event_id % 8 END"

COLUMNS = {
    "id": "CAST(event_id + 1 AS BIGINT)",
    "device_id": "CAST(user_id % 5 AS BIGINT)",
    "timestamp": f"CASE WHEN {_UNTIMED} THEN NULL ELSE ts END",
    "hostname": _HOST,
    "module": _MODULE,
    "severity": f"CAST({_SEVERITY} AS INT)",
    "brief": _BRIEF,
    "slot_info": "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Slot=' || CAST(event_id % 4 AS STRING) || '/0' END",
    "source_file": "'[HOST-' || CAST(user_id % 5 AS STRING) || ']_f' || CAST(event_id % 4 AS STRING) || '.log'",
    "raw_log": f"{_HOST} || ' %%01' || {_MODULE} || '/' || CAST({_SEVERITY} AS STRING) || '/' || {_BRIEF} || '(l)[' || CAST(event_id AS STRING) || ']: ' || {_BODY}",
    "message_body": _BODY,
    "parameters_json": "CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN '{}' ELSE props END",
    "knowledge_id": "CAST(event_id % 3 AS BIGINT)",
    "match_tier": "CASE WHEN event_id % 3 = 0 THEN 'UNMATCHED' WHEN event_id % 6 = 1 THEN 'EXACT' ELSE 'TEMPLATE' END",
    "match_confidence": "CAST(CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 6 = 1 THEN 1.0 ELSE 0.8 END AS DOUBLE)",
    "matched_document_id": "CAST(event_id % 4 AS BIGINT)",
}

LOGS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM events"

TAGS = [(1, "urgent", "red"), (2, "checked", "green"), (3, "noise", "grey"), (4, "spare", "blue")]
TAGS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({a} AS BIGINT), '{b}', '{c}')" for a, b, c in TAGS) + ") AS t(tag_id, name, color)"
#: Which log has which tag: some have several, most none.
RELATIONS = {1: "event_id % 7 = 0", 2: "event_id % 14 = 0", 3: "event_id % 11 = 3"}
RELATIONS_SQL = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS tag_id, CAST(event_id + 1 AS BIGINT) AS log_id FROM events WHERE {c}" for k, c in RELATIONS.items())

DEVICES = [(0, "", "unassigned", ""), (1, "core-1", "CloudEngine 12800", "10.0.0.1"), (2, "edge-2", "NE40E", "10.0.0.2"), (3, "ap-3", "AirEngine 5760", "10.0.0.3")]
DEVICES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({a} AS BIGINT), '{b}', '{c}', '{d}')" for a, b, c, d in DEVICES) + ") AS t(device_id, device_name, device_type, management_ip)"


def from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*(f"{e} AS {n}" for n, e in COLUMNS.items()))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(read(spark, sf_dir, "events"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for k, c in RELATIONS.items():
        own = read(spark, sf_dir, "events").where(c).selectExpr(f"CAST({k} AS BIGINT) AS tag_id", "CAST(event_id + 1 AS BIGINT) AS log_id")
        out = own if out is None else out.union(own)
    return out


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAGS, "tag_id bigint, name string, color string")


def devices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEVICES, "device_id bigint, device_name string, device_type string, management_ip string")
