"""Filters, orders and pages over the log view (FLT, SRT, LIM, TOP, DST, PRJ)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.plans import filters as P
from syslumen.queries import query
from syslumen.session import micros, read
from syslumen.sources import logview as L

WITH = f"WITH logs AS ({L.LOGS_SQL}), rel AS ({L.RELATIONS_SQL}), tags AS ({L.TAGS_SQL}), devices AS ({L.DEVICES_SQL})"
SHOWN = ["id", "module", "brief", "severity", "hostname"]


def _one(name: str, request: dict[str, Any], where: str) -> None:
    @query(name, f"{WITH} SELECT {', '.join(SHOWN)} FROM logs WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = P.LogFilter.of(request)
        tagged = f.tag_ids or f.exclude_tag_ids or f.untagged_only or any(c.field == "tag" for c in f.conditions)
        return P.apply(L.logs(spark, sf_dir), f, L.relations(spark, sf_dir) if tagged else None).select(*SHOWN)


def _conditions(*conditions: tuple[str, str, str], logic: str = "AND", **flat: Any) -> dict[str, Any]:
    return {"advanced": {"logic": logic, "conditions": [{"field": a, "op": b, "value": c} for a, b, c in conditions]}, **flat}


_kv = "CASE WHEN json_valid(parameters_json) THEN json_extract_string(parameters_json, '$.k') END"
_any = lambda ids: f"id IN (SELECT log_id FROM rel WHERE tag_id IN ({ids}))"

_one("flt01_contains", _conditions(("message_body", "contains", "ge0/0/1")), "message_body ILIKE '%ge0/0/1%'")
_one("flt01_contains_wildcards", _conditions(("brief", "contains", "f_d")), r"brief ILIKE '%f\_d%' ESCAPE '\'")
_one("flt02_not_contains", _conditions(("slot_info", "not_contains", "SLOT=1")), "coalesce(slot_info, '') NOT ILIKE '%slot=1%'")
_one("flt03_prefix", _conditions(("hostname", "prefix", "host-1")), "hostname ILIKE 'host-1%'")
_one("flt03_suffix", _conditions(("brief", "suffix", "_down")), r"brief ILIKE '%\_down' ESCAPE '\'")
_one("flt04_eq", _conditions(("brief", "eq", "IF_DOWN")), "brief = 'IF_DOWN'")
_one("flt04_eq_module_any_case", _conditions(("module", "eq", "ifnet")), "upper(module) = 'IFNET'")
_one("flt05_in", _conditions(("module", "in", "bgp, AAA,,")), "upper(module) IN ('BGP', 'AAA')")
_one("flt05_in_nothing", _conditions(("brief", "in", " , ")), "FALSE")
_one("flt06_not_in", _conditions(("brief", "not_in", "IF_DOWN,PEER_BACKWARD")), "coalesce(brief, '') NOT IN ('IF_DOWN', 'PEER_BACKWARD')")
_one("flt06_not_in_nothing", _conditions(("match_tier", "not_in", "")), "TRUE")
_one("flt07_comparisons", _conditions(("severity", "gte", "3"), ("severity", "lt", "6"), ("match_confidence", "gt", "0.5")), "severity >= 3 AND severity < 6 AND match_confidence > 0.5")
_one("flt07_in_numbers", _conditions(("severity", "in", "2,4,8")), "severity IN (2, 4, 8)")
_one("flt08_regex", _conditions(("raw_log", "regex", r"GE0/0/1[0-9] reported (click|view)")), r"regexp_matches(raw_log, 'GE0/0/1[0-9] reported (click|view)')")
_one("flt08_not_regex", _conditions(("hostname", "not_regex", "HOST-[0-2]$")), "NOT regexp_matches(coalesce(hostname, ''), 'HOST-[0-2]$')")
_one("flt08_regex_module_any_case", _conditions(("module", "regex", "^b")), "regexp_matches(module, '(?i)^b')")
_one("flt09_kv_eq", _conditions(("parameters", "kv_eq", "k=42")), f"{_kv} = '42'")
_one("flt10_kv_contains", _conditions(("parameters", "kv_contains", "k=7")), f"{_kv} ILIKE '%7%'")
_one("flt10_kv_not_contains", _conditions(("parameters", "kv_not_contains", "k=7")), f"coalesce({_kv}, '') NOT ILIKE '%7%'")
_one("flt11_kv_regex", _conditions(("parameters", "kv_regex", "k=^[1-3]$")), f"regexp_matches({_kv}, '^[1-3]$')")
_one("flt11_kv_not_regex", _conditions(("parameters", "kv_not_regex", "k=^[1-3]")), f"NOT regexp_matches(coalesce({_kv}, ''), '^[1-3]')")
_one("flt12_tag_has_any", _conditions(("tag", "has_any", "1,3")), _any("1, 3"))
_one("flt13_tag_has_all", _conditions(("tag", "has_all", "1,2")), "id IN (SELECT log_id FROM rel WHERE tag_id IN (1, 2) GROUP BY log_id HAVING count(DISTINCT tag_id) = 2)")
_one("flt14_tag_not_has", _conditions(("tag", "not_has", "1")), "NOT " + _any("1"))
_one("flt15_tag_is_empty", _conditions(("tag", "is_empty", "")), "id NOT IN (SELECT log_id FROM rel)")
_one("flt15_tag_is_not_empty", _conditions(("tag", "is_not_empty", "")), "id IN (SELECT log_id FROM rel)")
_one("flt16_tag_id_list", _conditions(("tag", "has_any", "x, 3,3,-1, 0,2")), _any("2, 3"))
_one("flt17_and", _conditions(("module", "eq", "BGP"), ("severity", "lte", "4"), ("tag", "not_has", "3")), "upper(module) = 'BGP' AND severity <= 4 AND NOT " + _any("3"))
_one("flt17_or_with_tags", _conditions(("module", "eq", "BGP"), ("tag", "has_all", "1,2"), ("tag", "not_has", "1,2,3"), logic="OR", severity=3), "severity <= 3 AND (upper(module) = 'BGP' OR id IN (SELECT log_id FROM rel WHERE tag_id IN (1, 2) GROUP BY log_id HAVING count(DISTINCT tag_id) = 2) OR NOT " + _any("1, 2, 3") + ")")
_one("flt17_disabled", {"advanced": {"conditions": [{"field": "module", "op": "eq", "value": "BGP", "disabled": True}, {"field": "severity", "op": "eq", "value": "2"}]}}, "severity = 2")
_one("flt18_exclude_comment", {"exclude_comment": True}, "module <> 'COMMENT'")
_one("flt19_flat", {"device_id": 2, "severity": 5, "brief": "down", "matched": True, "time_start": "2024-01-02 00:00:00", "time_end": "2024-01-20 00:00:00"}, "device_id = 2 AND severity <= 5 AND brief ILIKE '%down%' AND knowledge_id > 0 AND \"timestamp\" BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'")
_one("flt19_unmatched_module", {"module": "devm", "hostname": "t-3", "matched": False}, "upper(module) = 'DEVM' AND hostname ILIKE '%t-3%' AND coalesce(knowledge_id, 0) = 0")
_one("flt20_source_file", {"source_file": "f1.log"}, r"source_file = 'f1.log' OR source_file LIKE '%]\_f1.log' ESCAPE '\'")
_all = "(raw_log ILIKE '{0}' OR message_body ILIKE '{0}' OR brief ILIKE '{0}' OR module ILIKE '{0}' OR (module || '/' || brief) ILIKE '{0}')"
_one("flt21_keyword", {"keyword": " radius "}, _all.format("%radius%"))
_one("flt21_keyword_id", {"keyword": "#123"}, f"id = 123 OR {_all.format('%#123%')}")
_one("flt21_keyword_pair", {"keyword": "bg / peer"}, "raw_log ILIKE '%bg / peer%' OR message_body ILIKE '%bg / peer%' OR (module || '/' || brief) ILIKE '%bg / peer%' OR (module ILIKE '%bg%' AND brief ILIKE '%peer%')")
_one("flt22_tag_ids_any_and_exclude", {"tag_ids": [1, 3], "exclude_tag_ids": [2]}, f"{_any('1, 3')} AND NOT {_any('2')}")
_one("flt22_tag_ids_all", {"tag_ids": [1, 2], "tag_logic": "all"}, "id IN (SELECT log_id FROM rel WHERE tag_id IN (1, 2) GROUP BY log_id HAVING count(DISTINCT tag_id) = 2)")
_one("flt22_untagged_only", {"untagged_only": True}, "id NOT IN (SELECT log_id FROM rel)")
_one("flt29_valid_time", {"time_start": "0001-01-01 00:00:01"}, "\"timestamp\" IS NOT NULL AND \"timestamp\" > TIMESTAMP '0001-01-01'")

_PRESETS = {
    "sys_link_flap": "severity <= 4 AND upper(module) IN ('IFNET', 'MSTP', 'ETH-TRUNK') AND regexp_matches(brief, '(?i)(down|flap|change|topology)')",
    "sys_routing_anomaly": "severity <= 4 AND upper(module) IN ('BGP', 'OSPF', 'ISIS') AND regexp_matches(raw_log, '(?i)(down|fail|reset|expire|backward)')",
    "sys_security_attack": "severity <= 3 AND upper(module) IN ('SEC', 'ACL', 'FW', 'FILTER', 'BLACKLIST')",
    "sys_unmatched_kb": "coalesce(knowledge_id, 0) = 0 AND severity <= 4",
    "sys_hardware_env": "severity <= 3 AND upper(module) IN ('DEVM', 'POWER', 'FAN', 'ENVMON', 'SFP', 'CARD')",
    "sys_untagged_audit": "id NOT IN (SELECT log_id FROM rel)",
}
for _name, _where in _PRESETS.items():
    _one(f"flt28_{_name}", P.PRESETS[_name], _where)


@query("flt23_multi_device", f"{WITH} SELECT {', '.join(SHOWN)} FROM logs WHERE device_id IN (1, 3) AND upper(module) IN ('BGP', 'IFNET') AND upper(brief) IN ('IF_DOWN', 'PEER_BACKWARD') AND severity <= 6 AND \"timestamp\" >= TIMESTAMP '2024-01-05'")
def flt23(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.operators.timeline import multi_device_logs

    return multi_device_logs(L.logs(spark, sf_dir), device_ids=[1, 3], modules=["bgp", "IFNET"], briefs=["if_down", "peer_backward"], severity=6, time_start="2024-01-05 00:00:00").select(*SHOWN)


@query("flt27_rca_sample", f"{WITH} SELECT {', '.join(SHOWN)} FROM logs WHERE \"timestamp\" IS NOT NULL AND (knowledge_id > 0 OR severity <= 4) ORDER BY \"timestamp\", id LIMIT 100000")
def flt27(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.operators.rca import sample

    return sample(L.logs(spark, sf_dir)).select(*SHOWN)


def _paged(name: str, sql: str, **page: Any) -> None:
    @query(name, f"{WITH} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.page(L.logs(spark, sf_dir), **page).select("id", "module", micros("timestamp").alias("us"))


_US = "SELECT id, module, epoch_us(\"timestamp\") AS us FROM logs"
_paged("srt01_time_ascending", f'{_US} ORDER BY "timestamp" ASC NULLS FIRST, id LIMIT 120', size=120)
_paged("srt01_time_descending", f'{_US} ORDER BY "timestamp" DESC NULLS LAST, id DESC LIMIT 77', size=77, direction="desc")
_paged("srt01_by_id_descending", f"{_US} ORDER BY id DESC LIMIT 50", sort_by="id", direction="desc")
_paged("lim01_offset_page", f'{_US} ORDER BY "timestamp" ASC NULLS FIRST, id LIMIT 100 OFFSET 300', number=4, size=100)
_paged("lim02_keyset_page", f"{_US} WHERE id > 321 ORDER BY id LIMIT 60", sort_by="id", after_id=321, size=60)


@query("lim03_composite_keyset", f"{WITH} SELECT id, module, epoch_us(\"timestamp\") AS us FROM logs WHERE \"timestamp\" > TIMESTAMP '2024-01-03 12:00:00' OR (\"timestamp\" = TIMESTAMP '2024-01-03 12:00:00' AND id > 5) ORDER BY \"timestamp\", id LIMIT 40")
def lim03(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")
    found = L.logs(spark, sf_dir).where((F.col("timestamp") > at) | ((F.col("timestamp") == at) & (F.col("id") > 5)))
    return P.order(found).limit(40).select("id", "module", micros("timestamp").alias("us"))


@query("lim04_export_rows", f"{WITH} SELECT id, module, epoch_us(\"timestamp\") AS us FROM logs WHERE severity <= 2")
def lim04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.export_rows(P.apply(L.logs(spark, sf_dir), P.LogFilter(severity=2))).select("id", "module", micros("timestamp").alias("us"))


@query("lim05_total_next_to_page", f"{WITH} SELECT count(*) AS total FROM logs WHERE upper(module) = 'BGP'")
def lim05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.apply(L.logs(spark, sf_dir), P.LogFilter(module="bgp")).agg(F.count("*").alias("total"))


@query("srt03_report_order", f"{WITH} SELECT id, severity FROM logs ORDER BY severity, \"timestamp\" NULLS FIRST, id LIMIT 5000")
def srt03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).orderBy("severity", F.asc_nulls_first("timestamp"), "id").limit(5000).select("id", "severity")


@query("prj01_column_subset", f"{WITH} SELECT epoch_us(\"timestamp\") AS us, severity FROM logs")
def prj01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).select(micros("timestamp").alias("us"), "severity")


@query("prj02_expressions", f"{WITH} SELECT id, CASE WHEN severity <= 2 THEN 'severe' WHEN severity <= 4 THEN 'error' WHEN severity <= 5 THEN 'warning' ELSE 'info' END AS bucket, coalesce(nullif(slot_info, ''), '-') AS slot, module || '/' || brief AS event, least(severity, 5) AS low, greatest(severity, 3) AS high FROM logs")
def prj02(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.functions.scalar import severity_bucket

    return L.logs(spark, sf_dir).select("id", severity_bucket(F.col("severity")).alias("bucket"), F.coalesce(F.nullif("slot_info", F.lit("")), F.lit("-")).alias("slot"), F.concat_ws("/", "module", "brief").alias("event"), F.least("severity", F.lit(5)).alias("low"), F.greatest("severity", F.lit(3)).alias("high"))


@query("top02_first_worst_matched", f"{WITH} SELECT id, severity FROM logs WHERE knowledge_id > 0 ORDER BY severity, \"timestamp\" NULLS FIRST, id LIMIT 1")
def top02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).where("knowledge_id > 0").orderBy("severity", F.asc_nulls_first("timestamp"), "id").limit(1).select("id", "severity")


@query("dst01_distinct_hosts", f"{WITH} SELECT DISTINCT hostname FROM logs WHERE hostname <> '' ORDER BY hostname LIMIT 30")
def dst01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).where("hostname <> ''").select("hostname").distinct().orderBy("hostname").limit(30)


@query("dst01_distinct_modules", f"{WITH} SELECT DISTINCT upper(module) AS module FROM logs WHERE module <> ''")
def dst01_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).where("module <> ''").select(F.upper("module").alias("module")).distinct()


@query("setops_union_intersect_except", f"{WITH}, a AS (SELECT id FROM logs WHERE severity <= 3), b AS (SELECT id FROM logs WHERE upper(module) = 'BGP') SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (P.apply(L.logs(spark, sf_dir), f).select("id") for f in (P.LogFilter(severity=3), P.LogFilter(module="BGP")))
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").union(count(a.intersect(b), "intersect")).union(count(a.exceptAll(b), "except"))


@query("events_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
