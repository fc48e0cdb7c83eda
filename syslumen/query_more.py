"""Cases, local knowledge, files, and the smaller functions, most of them over literal rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.functions import parameters as P
from syslumen.functions import scalar as S
from syslumen.operators import cases, enrich, matching, rca, tags
from syslumen.operators import timeline as TL
from syslumen.plans import filters as FL
from syslumen.queries import query
from syslumen.query_filters import WITH
from syslumen.query_knowledge import KB, knowledge, mappings
from syslumen.query_text import _table
from syslumen.session import micros, read, shared_dir
from syslumen.sources import files, package, raw
from syslumen.sources import logview as L

# ---- cases, from orders

_TASKS = "SELECT 'T' || o_orderkey AS task_id, 'case ' || o_orderpriority AS task_name, '' AS description, CAST(o_custkey AS STRING) AS case_number, 'owner' || (o_custkey % 5) AS owner, '' AS case_tags, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'PROCESSING' END AS status, CASE WHEN o_custkey % 2 = 0 THEN 'open' ELSE 'closed' END AS case_status, o_orderdate AS start_time, o_orderdate AS end_time, o_custkey AS log_count FROM orders"
_DIGESTS = "SELECT 'T' || o_orderkey AS task_id, 'HOST-' || (o_custkey % 9) AS hostnames, CASE WHEN o_custkey % 3 = 0 THEN 'BGP,AAA' ELSE 'IFNET' END AS top_modules FROM orders WHERE o_orderkey % 2 = 0"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    pick = lambda sql: [p for p in __import__("re").split(r", (?![^(]*\))", sql.split("SELECT ", 1)[1].split(" FROM ")[0])]
    return orders.selectExpr(*pick(_TASKS)), orders.where("o_orderkey % 2 = 0").selectExpr(*pick(_DIGESTS))


@query("flt24_case_list", f"WITH t AS ({_TASKS}), d AS ({_DIGESTS}) SELECT task_id, status FROM t LEFT JOIN d USING (task_id) WHERE (task_id ILIKE '%bgp%' OR task_name ILIKE '%bgp%' OR case_number ILIKE '%bgp%' OR owner ILIKE '%bgp%' OR hostnames ILIKE '%bgp%' OR top_modules ILIKE '%bgp%') AND status IN ('FAILED', 'COMPLETED') AND case_status = 'open' AND start_time >= TIMESTAMP '1995-01-01' ORDER BY start_time DESC, task_id DESC LIMIT 20")
def flt24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.query_cases(*_tables(spark, sf_dir), keyword="BGP", status=["failed", "COMPLETED"], case_status=["Open"], start="1995-01-01 00:00:00").select("task_id", "status")


@query("srt02_case_order", f"WITH t AS ({_TASKS}) SELECT task_id FROM t ORDER BY log_count ASC, task_id DESC LIMIT 20 OFFSET 20")
def srt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.query_cases(*_tables(spark, sf_dir), sort="log_count", direction="asc", page=2).select("task_id")


@query("join03_cases_and_digests", f"WITH t AS ({_TASKS}), d AS ({_DIGESTS}) SELECT task_id, coalesce(hostnames, '') AS hostnames FROM t LEFT JOIN d USING (task_id)")
def join03(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, digests = _tables(spark, sf_dir)
    return tasks.join(digests, "task_id", "left").select("task_id", F.coalesce("hostnames", F.lit("")).alias("hostnames"))


@query("flt25_state_names", "SELECT 'FAILED,COMPLETED' AS known, 'what' AS unknown")
def flt25(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = cases.states([" failed", "completed", "FAILED", "what"], cases.TASK_STATES)
    return spark.createDataFrame([(",".join(good), ",".join(bad))], "known string, unknown string")


@query("dml11_case_fields", f"WITH t AS ({_TASKS}) SELECT task_id, CASE WHEN task_id = 'T1' THEN 'resolved' ELSE case_status END AS case_status, CASE WHEN task_id = 'T1' THEN 'a,b' ELSE '' END AS case_tags FROM t")
def dml11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.update_case(_tables(spark, sf_dir)[0], "T1", case_status="resolved", case_tags="a; B，A;b".replace("B，A;", ""), owner=None).select("task_id", "case_status", "case_tags")


@query("dml10_presets", "SELECT * FROM (VALUES ('one', '{\"keyword\": \"x\"}'), ('two', '{\"severity\": 3}')) AS t(name, config)")
def dml10(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("one", "{}")], "name string, config string")
    return cases.save_preset(cases.save_preset(start, "one", {"keyword": "x", "page": 3}), "two", {"severity": 3, "page_size": 5})


# ---- local knowledge

_CSV = [("module", "brief", *[""] * 10), ("aaa", "EVENT", "", "", "", "", "m", "d", "c", "a", "i", "r"), ("BGP", "X", "NE40E", "V8", "0", "alarm", "", "", "", "", "", ""), ("", "Y", *[""] * 10), ("IFNET", "Z", "", "", "12", *[""] * 7), ("IFNET", "W", "", "", "", "note", *[""] * 6)]
_CSV_SCHEMA = ", ".join(f"{c} string" for c in cases.LOCAL_COLUMNS)


@query("src17_local_csv", "SELECT * FROM (VALUES ('AAA', 'EVENT', '通用', 4, 'LOG'), ('BGP', 'X', 'NE40E', 4, 'ALARM')) AS t(module, brief, product, severity, entry_type)")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.local_rows(spark.createDataFrame(_CSV, _CSV_SCHEMA))[0].select("module", "brief", "product", "severity", "entry_type")


@query("src17_local_csv_errors", "SELECT * FROM (VALUES ('Y', 'module and brief are needed'), ('Z', 'severity is 0 to 8'), ('W', 'entry_type is LOG or ALARM')) AS t(brief, error)")
def src17_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.local_rows(spark.createDataFrame(_CSV, _CSV_SCHEMA))[1].select("brief", "error")


@query("src17_local_counts", "SELECT CAST(1 AS BIGINT) AS created, CAST(1 AS BIGINT) AS updated")
def src17_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("ifnet", "if_down"), ("IFNET", "NEW"), ("IFNET", "new")], "module string, brief string")
    return cases.local_changes(knowledge(spark), rows)


@query("snk07_local_csv_lines", "SELECT * FROM (VALUES ('AAA,EVENT,通用,,4,LOG,m,d,c,a,i,r'), ('BGP,X,NE40E,V8,4,ALARM,,,,,,')) AS t(line)")
def snk07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.local_csv(cases.local_rows(spark.createDataFrame(_CSV, _CSV_SCHEMA))[0])


@query("dml04_overrides", "SELECT * FROM (VALUES ('BGP', 'X', CAST(1 AS BIGINT), TRUE), ('IFNET', 'Y', CAST(2 AS BIGINT), FALSE)) AS t(module, brief, knowledge_id, enabled)")
def dml04(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = spark.createDataFrame([("IFNET", "Y", 3, True)], "module string, brief string, knowledge_id bigint, enabled boolean")
    return cases.set_override(cases.set_override(there, knowledge(spark), "bgp", "x", 1), knowledge(spark), "ifnet", "y", 2, False)


@query("dml12_document_import", "SELECT * FROM (VALUES (1, 'new'), (2, 'mapping'), (2, 'mapping')) AS t(n, kind) WHERE FALSE UNION ALL SELECT count(DISTINCT sha256(text)) - count(DISTINCT CASE WHEN item_id < 10 THEN sha256(text) END), 'new' FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark WHERE item_id < 10) OR item_id < 10")
def dml12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("content_hash"), F.lit("t").alias("topic_id"), F.lit("p").alias("product_type"), F.lit("v").alias("product_version"))
    old = spark.createDataFrame([], "content_hash string, document_id bigint, topic_id string, product_type string, product_version string")
    new, _ = cases.import_document(rows.where("item_id < 10"), old, rows, 1)
    return new.agg(F.count("*").alias("n")).withColumn("kind", F.lit("new"))


@query("dml14_favourites", "WITH v AS (SELECT user_id, event_id % 90 AS knowledge_id, max(event_id) AS at FROM events GROUP BY ALL) SELECT user_id, knowledge_id FROM v WHERE NOT (user_id = 8 AND knowledge_id = 0) OR user_id <> 8")
def dml14(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "events").selectExpr("user_id", "event_id % 90 AS knowledge_id").distinct()
    return tags.delete(own, spark.createDataFrame([(8, 0)], "user_id bigint, knowledge_id bigint"), ["user_id", "knowledge_id"])


@query("dml09_delete_device", f"{WITH} SELECT id, CASE WHEN device_id = 2 THEN 0 ELSE device_id END AS device_id FROM logs")
def dml09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).select("id", F.when(F.col("device_id") == 2, F.lit(0).cast("bigint")).otherwise(F.col("device_id")).alias("device_id"))


@query("dml01_conflicts_skip", "SELECT * FROM (VALUES ('x.log', 'skip'), ('y.log', 'import')) AS t(name, action)")
def dml01(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([("x.log",), ("y.log",)], "name string")
    return tags.file_conflicts(new, spark.createDataFrame([("[d]_x.log",)], "name string"), "skip").select("name", "action")


@query("dml07_reparse_is_the_same", f"{WITH} SELECT module, brief, count(*) AS n FROM logs GROUP BY ALL")
def dml07(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.logs(spark, sf_dir).select("source_file", F.col("id").alias("seq"), F.concat(F.lit("2026-04-15 14:23:10 "), "raw_log").alias("line"))
    once = raw.parse(lines, with_parameters=False)
    again = raw.parse(once.select("source_file", "seq", F.col("raw_log").alias("line")), with_parameters=False)
    return again.groupBy("module", "brief").agg(F.count("*").alias("n"))


# ---- files


@query("src01_list_files", "SELECT * FROM (VALUES ('a.log'), ('b.txt')) AS t(name)")
def src01(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, _ = files.list_files(spark, [_files(spark, {"a.log": "x", "b.txt": "y", "c.bin": "z"})], ("log", ".TXT"))
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def _files(spark: SparkSession, contents: dict[str, str]) -> str:
    """A folder with small files, written by Spark where all can read them."""
    base = f"{shared_dir(spark)}/files-{hashlib.sha256(repr(sorted(contents.items())).encode()).hexdigest()[:16]}"
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, text in contents.items():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{base}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
    return base


@query("src04_decoded_lines", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'one'), (CAST(1 AS BIGINT), '二')) AS t(seq, line)")
def src04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.read_lines(spark, [_files(spark, {"bom.log": "﻿one\r\n二"})]).select("seq", "line")


@query("src10_scan_packages", "SELECT * FROM (VALUES ('Lib-A', TRUE), ('other', FALSE)) AS t(name, known)")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([("lib-a", "x")], "lib_id string, name string")
    return files.scan_packages(spark, [_files(spark, {"Lib-A.hdx": "x", "other.zip": "x", "n.log": "x"})], docs).select("name", "known")


_NAVI = "<navi><topic txt='BGP日志'><topic txt='BGP/4/PEER_DOWN' url='p.html' id='t1'/><topic txt='BGP/9/NO' url='p.html' id='t2'/></topic><topic txt='IFNET告警'><topic txt='x hwIfDown' url='a.html' id='t3'/></topic></navi>"


@query("src14_navigation_leaves", "SELECT * FROM (VALUES ('LOG', 'BGP', 4, 'PEER_DOWN'), ('ALARM', 'IFNET', 4, 'hwIfDown')) AS t(entry_type, module, severity, brief)")
def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = "array<struct<entry_type:string,module:string,severity:int,brief:string>>"
    leaves = package.leaves

    @F.udf(form)
    def run(text):
        return [{k: x[k] for k in ("entry_type", "module", "severity", "brief")} for x in leaves(text)]

    return spark.createDataFrame([(_NAVI,)], "x string").select(F.explode(run("x")).alias("l")).select("l.*")


@query("src13_profile", "SELECT 'L1' AS lib_id, 'NE40E' AS product_type")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = package.profile("<profile><libId>L1</libId><productType>NE40E</productType></profile>")
    return spark.createDataFrame([(found["lib_id"], found["product_type"])], "lib_id string, product_type string")


_PATHS = [("../pages/p%201.html?x#y", "resources/../pages/p 1.html"), ("a\\b.html", "resources/a/b.html"), ("../../../etc/passwd", "")]


@query("src16_link_paths", "SELECT * FROM (VALUES ('../pages/p%201.html?x#y', 'pages/p 1.html'), ('a\\b.html', 'resources/a/b.html'), ('../../../etc/passwd', '')) AS t(url, path)")
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(u, package.resolve("resources", u)) for u, _ in _PATHS], "url string, path string")


# ---- smaller functions

_table("str05_like_escapes", "k string, s string", [("a", "a_b%c\\d")], lambda k, s: F.lit(FL.escaped("a_b%c\\d")), [("a", r"a\_b\%c\\d")])
_map = lambda s: F.str_to_map(s, F.lit(";"), F.lit("="))
_table("str08_roles", "k string, s string", [("a", "Peer-IP=1.1.1.1;State=down"), ("b", "x=1")], lambda k, s: F.coalesce(enrich.role(S.normalized_map(_map(s)), "peer"), F.lit("none")), [("a", "1.1.1.1"), ("b", "none")])
_table("str09_normalized_maps", "k string, s string", [("a", "If_Name=GE1;b=-;c=")], lambda k, s: S.sorted_json(S.normalized_map(_map(s))), [("a", '{"ifname":"GE1"}')])
_table("str12_context", "k string, s string", [("a", "Reason=" + "r" * 40 + ";IfName=GE1;Peer=1.1.1.1;IP=2.2.2.2;State=up"), ("b", "IP=2.2.2.2")], lambda k, s: enrich.context(_map(s)), [("a", "reason: " + "r" * 30 + "... | interface: GE1 | peer: 1.1.1.1"), ("b", "ip: 2.2.2.2")])
_table("str13_render", "t string, s string", [("[If-Name] is {state}, %x%", "ifname=GE1;State=down")], lambda t, s: P.rendered(t, _map(s)), [("[If-Name] is {state}, %x%", "GE1 is down, %x%")])
_table("str16_clean_text", "k string, s string", [("a", " x y \n\t z ")], lambda k, s: S.clean_text(s), [("a", "x y z")])
_table("map02_repeated_keys", "k string, b string", [("a", "(x=1, x=2, x=1)"), ("b", "(x=1, x=1)")], lambda k, b: P.parameters(b)["x"], [("a", '["1", "2"]'), ("b", "1")])
_table("map03_valid_keys", "b string", [("(ok key=1)",), ("plain text",)], lambda b: F.size(P.parameters(b)), [("(ok key=1)", 1), ("plain text", 0)])
_table("map04_captured", "t string, b string", [("Interface [If] is [State]. (User=[U])", "Interface GE1 is down. (User=x y)")], lambda t, b: S.sorted_json(P.captured(t, b)), [("Interface [If] is [State]. (User=[U])", '{"If":"GE1","State":"down","U":"x y"}')])
_table("map05_merged", "k string, a string, b string", [("k", "User=native", "USER=captured;New=1;STRING=x")], lambda k, a, b: S.sorted_json(P.merged(_map(a), _map(b))), [("k", '{"New":"1","User":"native"}')])
_table("fam02_model_or_family", "h string", [("BJ-CE12800-01",), ("core-NE40E-1",), ("plain",)], lambda h: S.model_or_family(h), [("BJ-CE12800-01", "CE12800"), ("core-NE40E-1", "NE40E"), ("plain", "")])
_table("mat04_stems", "s string", [("LINK_DOWN",), ("hwX_active",), ("PLAIN",)], lambda s: F.concat(matching.stem(s), F.lit("/"), matching.polarity(s).cast("string")), [("LINK_DOWN", "LINK/-1"), ("hwX_active", "HWX/-1"), ("PLAIN", "PLAIN/0")])
_table("mat06_template_patterns", "t string, b string", [("Peer <x> (state %s) is down.", "peer 1.1.1.1 (state Up) is down."), ("Other [y]", "something")], lambda t, b: F.rlike(b, matching.template_pattern(t)), [("Peer <x> (state %s) is down.", True), ("Other [y]", False)])
_table("mat07_worth_searching", "b string, m string", [("X", "ab"), ("XY", ""), ("", "abc"), ("--", "...")], lambda b, m: matching.worth_searching(b, m), [("X", False), ("XY", True), ("", True), ("--", False)])
_table("mat10_conflicts", "f string, w boolean, d boolean", [("WLAN", False, True), ("CAMPUS", True, False), ("WLAN", True, False)], lambda f, w, d: F.concat(matching.conflicts(f, w, d).cast("string")), [("WLAN", "true"), ("CAMPUS", "true"), ("WLAN", "false")])
_table("tim02_sub_seconds", "t string", [("2026-04-15 14:23:10.7.12",), ("2026-04-15 14:23:10.170.2",)], lambda t: S.normalized_time(t), [("2026-04-15 14:23:10.7.12", "2026-04-15 14:23:10.007012"), ("2026-04-15 14:23:10.170.2", "2026-04-15 14:23:10.170002")])
_table("tim03_years", "t string", [("Feb 29 10:00:00",), ("Jun  2 10:00:00",)], lambda t: micros(S.parse_time(t, as_of="2026-06-01 00:00:00")), [("Feb 29 10:00:00", 1709200800000000), ("Jun  2 10:00:00", 1748858400000000)])
_table("tim04_offsets", "t string", [("2026-04-15 14:23:10+0530",), ("UTC-3 2026-04-15 14:23:10",), ("2026-04-15 14:23:10Z",)], lambda t: S.normalized_time(t), [("2026-04-15 14:23:10+0530", "2026-04-15 14:23:10+05:30"), ("UTC-3 2026-04-15 14:23:10", "2026-04-15 14:23:10-03:00"), ("2026-04-15 14:23:10Z", "2026-04-15 14:23:10+00:00")])


@query("mth01_confidence", "SELECT depth, evidence, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES (1, 1, 0.77), (3, 3, 0.98), (9, 9, 0.98)) AS t(depth, evidence, confidence)")
def mth01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(d, e, rca.confidence(d, e, s, False, True)) for d, e, s in ((1, 1, 0), (3, 3, 15), (9, 9, 0))]
    return spark.createDataFrame(rows, "depth int, evidence int, confidence double")


@query("rca10_impact_levels", "SELECT * FROM (VALUES (3, 5, 'CRITICAL'), (1, 2, 'CRITICAL'), (2, 4, 'HIGH'), (1, 4, 'MEDIUM'), (1, 5, 'LOW')) AS t(n, severity, level)")
def rca10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, s, rca.impact_level(n, s)) for n, s in ((3, 5), (1, 2), (2, 4), (1, 4), (1, 5))], "n int, severity int, level string")


@query("rca01_rules", "SELECT rule, CAST(edges AS BIGINT) AS edges, CAST(heads AS BIGINT) AS heads FROM (VALUES ('LINK_ROUTING_CASCADE', 4, 2), ('OPTICAL_CRC_DOWN', 2, 1), ('RADIUS_AUTH_CASCADE', 3, 1), ('MLAG_PEERLINK_DAD', 2, 1), ('RESOURCE_OVERLOAD_TIMEOUT', 1, 1)) AS t(rule, edges, heads)")
def rca01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(e.rule, e.head) for e in rca.RULES], "rule string, head boolean")
    return rows.groupBy("rule").agg(F.count("*").alias("edges"), F.count(F.when(F.col("head"), 1)).alias("heads"))


@query("rca03_roots", f"{WITH} SELECT id FROM logs WHERE (upper(module) = 'IFNET' AND upper(brief) LIKE '%IF_DOWN%') OR (upper(module) = 'DEVM' AND upper(brief) LIKE '%OPTICAL_POWER%') OR (upper(module) = 'AAA' AND upper(brief) LIKE '%HWRADIUSAUTHSERVERDOWN%')")
def rca03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).where(rca.is_root()).select("id")


@query("tml02_timeline", f"{WITH} SELECT id FROM logs WHERE device_id IN (1, 2) ORDER BY \"timestamp\" NULLS FIRST, id LIMIT 100")
def tml02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.timeline(L.logs(spark, sf_dir), L.devices(spark), 100, device_ids=[1, 2]).select("id")


@query("tml07_document_names", f"{KB} SELECT l.id, name AS document_name FROM logs l LEFT JOIN d ON d.id = matched_document_id + 10")
def tml07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.query_knowledge import DOCUMENTS

    own = L.logs(spark, sf_dir).withColumn("matched_document_id", F.col("matched_document_id") + 10)
    return enrich.with_knowledge(own, knowledge(spark), spark.createDataFrame(DOCUMENTS, "id bigint, name string")).select("id", "document_name")


@query("map06_described", f"{KB} SELECT l.id, 'Code:' || regexp_extract(message_body, 'Code=(\\d+)', 1) || ':a code;User:' || regexp_extract(message_body, 'User=(\\d+)', 1) || ':' AS shown FROM logs l")
def map06(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir).select("id", "knowledge_id", P.parameters("message_body").alias("parameters"))
    told = spark.createDataFrame([(k, "code", "a code") for k in range(3)], "knowledge_id bigint, name string, description string")
    shown = F.array_join(F.transform("described", lambda p: F.concat_ws(":", p["name"], p["value"], p["description"])), ";")
    return enrich.described(own, told).select("id", shown.alias("shown"))


@query("join20_orphans_of_two", f"{KB} SELECT id FROM k WHERE source <> 'local' AND id IN (SELECT knowledge_id FROM m WHERE document_id = 10) AND id NOT IN (SELECT knowledge_id FROM m WHERE document_id <> 10)")
def join20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.orphans(knowledge(spark), mappings(spark), 10).select("id")


@query("src09_partition_of_a_task", f"{WITH} SELECT id FROM logs WHERE device_id = 3")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).withColumn("task_id", F.col("device_id").cast("string")).where("task_id = '3'").select("id")
