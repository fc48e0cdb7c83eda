"""Text: cleaning, masking, parsing, times, hashes, labels, pages (STR, PRS, TIM, MAP, HSH, VER, FAM, SRC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.functions import scalar as S
from syslumen.queries import query
from syslumen.query_columns import NAMES
from syslumen.query_filters import WITH
from syslumen.session import micros, read
from syslumen.sources import logview as L
from syslumen.sources import package, raw


#: Literal cases of functions, by query: rows, columns, the function, results.
CASES: dict[str, tuple] = {}


def _table(name: str, columns: str, rows: list[tuple], make, want: list[tuple]) -> None:
    """Literal rows with literal results: cases of a query over a whole table, or else a query of their own, whose oracle lists them."""
    CASES[name] = (rows, columns, make, want)
    if name in NAMES:
        return
    shown = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in want)
    first = columns.split()[0]

    @query(name, f"SELECT * FROM (VALUES {shown}) AS t({first}, result)")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(rows, columns).select(F.col(first), make(*(F.col(c.strip().split()[0]) for c in columns.split(","))).alias("result"))


_table("str01_trim_space", "k string, s string", [("a", "\x00 \t x y \n\x00"), ("b", ""), ("c", None)], lambda k, s: S.trim_space(s), [("a", "x y"), ("b", ""), ("c", None)])
_table("str02_garbage", "k string, s string", [("a", "\x00\x01 \t"), ("b", " x"), ("c", "日"), ("d", "")], lambda k, s: S.is_garbage(s), [("a", True), ("b", False), ("c", False), ("d", True)])
_table("str03_sanitize", "k string, s string", [("a", "﻿\x1b[31mred\x1b[0m\x00x\x7fy "), ("b", "a\tb"), ("c", "\x1b]0;title\x07z")], lambda k, s: S.sanitize(s), [("a", "red xy"), ("b", "a\tb"), ("c", "z")])
_MASK = [("json", '{"password": "p1", "user":"u"}'), ("pair", "pwd=abc, key=10, Token = xyz)"), ("command", "set password cipher Abc123 now"), ("state", "password cipher error"), ("community", "snmp-agent community read cipher pub"), ("mark", "value %^%#abc%^%# end"), ("plain", "shared-key abc")]
_table("str04_mask", "k string, s string", _MASK, lambda k, s: S.mask_credentials(s), [("json", '{"password":"******", "user":"u"}'), ("pair", "pwd=******, key=10, Token=******)"), ("command", "set password cipher ****** now"), ("state", "password cipher error"), ("community", "snmp-agent community read cipher ******"), ("mark", "value ****** end"), ("plain", "shared-key abc")])
_table("str06_file_names", "k string, s string", [("a", "[dev]_a.log"), ("b", 'x/y:z*"')], lambda k, s: S.file_component(S.strip_device_prefix(s)), [("a", "a.log"), ("b", "x_y_z__")])
_table("str07_normalized_key", "k string, s string", [("a", " Peer_IP-Addr x ")], lambda k, s: S.normalized_key(s), [("a", "peeripaddrx")])
_table("str11_clean_title", "k string, s string", [("a", "<b>Link</b> failed，可能原因是线路。More"), ("b", "x" * 70), ("c", "")], lambda k, s: S.clean_title(s), [("a", "Link failed"), ("b", "x" * 60 + "..."), ("c", "")])
_table("str15_csv_fields", "k string, s string", [("a", "=1+1"), ("b", 'say "hi", x'), ("c", "plain"), ("d", "-2\n3")], lambda k, s: S.csv_safe(s), [("a", "'=1+1"), ("b", '"say ""hi"", x"'), ("c", "plain"), ("d", "\"'-2\n3\"")])
_table("str17_words_compatible", "k string, a string, b string", [("a", "peer addres", "peers address"), ("b", "one two", "three")], lambda k, a, b: S.words_compatible(F.split(a, " "), F.split(b, " ")), [("a", True), ("b", False)])
_table("str18_severity_labels", "s int", [(k,) for k in range(9)], lambda s: F.concat(S.severity_bucket(s), S.severity_prefix(s)), [(0, "severe"), (1, "severe[紧急]"), (2, "severe[紧急]"), (3, "error[告警]"), (4, "error[告警]"), (5, "warning"), (6, "info"), (7, "info"), (8, "info")])
_table("str19_case_tags", "k string, s string", [("a", "One,two；ONE; three ,，")], lambda k, s: F.array_join(S.case_tags(s), "|"), [("a", "One|two|three")])
_table("str20_multi_value", "k string, s string", [("a", "a, b;c\nd,,")], lambda k, s: F.array_join(S.multi_value(s), "|"), [("a", "a|b|c|d")])
_table("ver01_compare", "a string, b string", [("V200R019C00", "V200R019C00SPC500"), ("V300", "V200R019"), ("", "V1"), ("x", "X"), ("1.2.10", "1.2.9")], lambda a, b: S.compare_versions(a, b), [("V200R019C00", -1), ("V300", 1), ("", -1), ("x", 0), ("1.2.10", 1)])
_table("ver02_score", "p string, v string, tp string, tv string", [("NE40E", "V8", "ne40e", "v8"), ("NE40E ", "V8", "NE40E", "V9"), ("NE20E", "", "NE40E-X8", ""), ("S5700", "", "NE40E", ""), ("x", "", "", "")], lambda p, v, tp, tv: S.version_score(p, v, tp, tv), [("NE40E", 150), ("NE40E ", 120), ("NE20E", 50), ("S5700", 10), ("x", 10)])
_table("fam01_family", "p string", [("CloudEngine 12800",), ("CE6865E",), ("AirEngine 5760",), ("USG6000",), ("NE40E-X8",), ("S5735",), ("XS57001",), ("other",)], lambda p: S.product_family(p), [("CloudEngine 12800", "CLOUDENGINE"), ("CE6865E", "CLOUDENGINE"), ("AirEngine 5760", "WLAN"), ("USG6000", "HISECENGINE"), ("NE40E-X8", "NETENGINE"), ("S5735", "CAMPUS"), ("XS57001", "UNKNOWN"), ("other", "UNKNOWN")])
_table("fam03_medium", "k string, s string", [("a", "[WLAN_STA_INFO]x"), ("b", "ACMAC:1;SSID:x"), ("c", "[USER_INFO_1]"), ("d", "plain")], lambda k, s: F.concat_ws("/", S.is_wireless(s).cast("string"), S.is_wired(s).cast("string")), [("a", "true/false"), ("b", "true/false"), ("c", "false/true"), ("d", "false/false")])
_TIMES = [
    ("2026-04-15 14:23:10.123+08:00", 1776234190123000), ("2026-04-15T14:23:10Z", 1776262990000000), ("2026-04-15 14:23:10", 1776262990000000), ("Apr 15 2026 14:23:10+08:00", 1776234190000000), ("Apr  5 2026 14:23:10", 1775398990000000),
    ("UTC+08:00 2026-04-15 14:23:10", 1776234190000000), ("Apr 15 2026 14:23:10.170.2+08:00", 1776234190170002), ("2026-04-15 14:23:10+0800", 1776234190000000), ("Apr 15 14:23:10", 1776262990000000), ("Dec 31 23:00:00", 1767222000000000), ("2026-02-30 00:00:00", None), ("", None),
]
_table("tim01_device_times", "t string", [(t,) for t, _ in _TIMES], lambda t: micros(S.parse_time(t, as_of="2026-06-01 00:00:00")), _TIMES)
_table("tim05_request_times", "t string", [("1700000000",), ("1700000000123",), ("2023-11-14 22:13",), ("2023-11-14",), ("2023-11-14T22:13:20+01:00",), ("x",)], lambda t: micros(S.parse_custom_time(t)), [("1700000000", 1700000000000000), ("1700000000123", 1700000000123000), ("2023-11-14 22:13", 1699999980000000), ("2023-11-14", 1699920000000000), ("2023-11-14T22:13:20+01:00", 1699996400000000), ("x", None)])


@query("hsh01_content_hash", "SELECT p_partkey, sha256(strlen(trim(p_name)) || ':' || trim(p_name) || strlen(trim(p_brand)) || ':' || trim(p_brand) || strlen(trim(p_type)) || ':' || trim(p_type) || strlen(CAST(p_size AS STRING)) || ':' || p_size) AS content_hash FROM part")
def hsh01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", S.content_hash(*(F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))).alias("content_hash"))


@query("hsh03_local_hash", f"{WITH} SELECT DISTINCT module, brief, sha256('local|' || upper(trim(module)) || '|' || trim(brief)) AS h FROM logs")
def hsh03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).select("module", "brief", S.local_hash(F.col("module"), F.col("brief")).alias("h")).distinct()


@query("join19_new_by_hash", "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT min(doc_id) AS doc_id FROM h WHERE doc_id >= 500 AND h NOT IN (SELECT h FROM h WHERE doc_id < 500) GROUP BY h")
def join19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.where("doc_id >= 500").join(rows.where("doc_id < 500").select("h"), "h", "left_anti").groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("prs02_round_trip", f"{WITH} SELECT id, hostname, module, severity, brief, message_body, id - 1 AS sequence FROM logs")
def prs02(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.logs(spark, sf_dir).select(F.col("source_file"), F.col("id").alias("seq"), F.concat(F.lit("Apr 15 2026 14:23:10 "), "raw_log").alias("line"))
    made = raw.parse(lines, with_parameters=False)
    return made.select(F.col("seq").alias("id"), "hostname", "module", "severity", "brief", "message_body", "sequence")


@query("map01_parameters_round_trip", f"{WITH} SELECT id, CAST(user_id AS STRING) AS user_value, CAST(event_id % 7 AS STRING) AS code_value FROM logs JOIN events ON id = event_id + 1")
def map01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.functions.parameters import parameters

    made = L.logs(spark, sf_dir).select("id", parameters("message_body").alias("p"))
    return made.select("id", F.col("p")["User"].alias("user_value"), F.col("p")["Code"].alias("code_value"))


_LINES = [
    "<189>2026-04-15 14:23:10.123+08:00 SW-1 %%01IFNET/4/IF_DOWN_active(l)[7]: Port is down. (Interface=[GE0/0/1], Reason-x=[a b])",
    "Apr 15 2026 14:23:10 FW-1 %%01SEC/4/ATTACK(s): type=flood, src=10.0.0.1",
    "%%01BGP/0/PEER(l)[3][Slot=1/0]: lost",
    "# This logfile is generated at slot 1 (CE6865E V200R024)",
    "# Digest(0006756365):3e0f5f59",
    "# Version: V200",
    "# note",
    "nothing to see",
]
_PARSED = [
    (0, "SW-1", "IFNET", 4, "IF_DOWN_active", "", '{"Interface":"GE0/0/1","Reason-x":"a b"}', "2026-04-15 06:23:10"),
    (1, "FW-1", "SEC", 4, "ATTACK", "", '{"src":"10.0.0.1","type":"flood"}', "2026-04-15 14:23:10"),
    (2, "", "BGP", 0, "PEER", "Slot=1/0", "{}", None),
    (3, "", "COMMENT", 6, "LOGFILE_HEADER", "1", '{"DeviceModel":"CE6865E","FileType":"日志文件头","Slot":"1","Version":"V200R024"}', None),
    (4, "", "COMMENT", 6, "LOGFILE_DIGEST", "Seq: 0006756365", '{"Digest":"3e0f5f59","DigestSeq":"0006756365","FileType":"防篡改校验码"}', None),
    (5, "", "COMMENT", 6, "SOFTWARE_VERSION", "", '{"Version":"V200"}', None),
    (6, "", "COMMENT", 6, "COMMENT_LINE", "", '{"Comment":"note"}', None),
    (7, "", "UNKNOWN", 8, "UNPARSED", "", "{}", None),
]
_shown = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in _PARSED)


@query("prs01_line_forms", f"SELECT CAST(seq AS BIGINT) AS seq, hostname, module, severity, brief, slot_info, parameters_json, stamp FROM (VALUES {_shown}) AS t(seq, hostname, module, severity, brief, slot_info, parameters_json, stamp)")
def prs01(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = raw.parse(raw.clean_lines(raw.from_text(spark, "f", "\n".join(_LINES))))
    return made.select("seq", "hostname", "module", "severity", "brief", "slot_info", "parameters_json", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("src05_clean_documents", "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[\\p{L}\\p{N}\\p{P}\\p{S}]') GROUP BY doc_id")
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("source_file"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return raw.clean_lines(lines).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("src06_lines_in_order", "SELECT doc_id, CAST(i - 1 AS INT) AS seq, md5(l) AS h FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) t, LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i)")
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "l")).select("doc_id", "seq", F.md5("l").alias("h"))


@query("src07_host_of_file", f"{WITH} SELECT source_file, min_by(hostname, id) AS hostname FROM logs WHERE hostname <> '' AND id < 100 GROUP BY source_file")
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.sniff_host(L.logs(spark, sf_dir).withColumn("seq", F.col("id")))


@query("src15_page_titles", "SELECT page_id, trim(regexp_extract(html, '<title>([^<&]*)', 1)) AS title FROM pages WHERE html NOT LIKE '%<title>%&%</title>%' AND regexp_matches(html, '<title>[^<&]+</title>')")
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = read(spark, sf_dir, "pages").where(r"html NOT LIKE '%<title>%&%</title>%' AND html rlike '<title>[^<&]+</title>'")
    return package.parse_pages(plain).select("page_id", "title")


@query("src15_page_sections")
def src15_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package.parse_pages(read(spark, sf_dir, "pages")).select("page_id", "title", "text")


@query("str02_unique_lines_of_talk", "SELECT conv_id, count(DISTINCT role) AS roles, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("roles"), F.count("*").alias("turns"), F.max("turn").alias("last_turn"))


@query("str10_top_parameters", "SELECT event_id, 'a: ' || event_type || ' | b: ' || user_id AS shown FROM events")
def str10(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("z"), F.lit("1"), F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), "event_type")
    return read(spark, sf_dir, "events").select("event_id", S.top_parameters(m, 2).alias("shown"))


@query("map07_sorted_json", "SELECT event_id, '{\"a\":\"' || event_type || '\",\"b\":\"' || user_id || '\"}' AS j FROM events")
def map07(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), "event_type")
    return read(spark, sf_dir, "events").select("event_id", S.sorted_json(m).alias("j"))


@query("mth02_relevance", "SELECT event_id, round(least(1.0, greatest(0.0, ln(1 + value) / ln(101.0))), 6) AS share FROM events")
def mth02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.round(S.relevance(F.col("value")), 6).alias("share"))


@query("jsn01_json_extract", f"{WITH} SELECT id, CASE WHEN json_valid(parameters_json) THEN json_extract_string(parameters_json, '$.k') END AS k FROM logs")
def jsn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).select("id", F.get_json_object("parameters_json", "$.k").alias("k"))


@query("snk02_csv_lines", f"""{WITH} SELECT id, id || ',' || coalesce(strftime("timestamp", '%Y-%m-%d %H:%M:%S'), '') || ',' || hostname || ',' || module || ',' || severity || ',' || brief || ',' || match_tier || ',' || printf('%.2f', match_confidence) || ',' || source_file || ',,' || CASE WHEN contains(raw_log, ',') THEN '"' || raw_log || '"' ELSE raw_log END AS line FROM logs""")
def snk02(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.sinks.export import csv_lines

    return csv_lines(L.logs(spark, sf_dir))


@query("snk03_json_lines", f"{WITH} SELECT id, '{{\"id\":' || id || ',\"module\":\"' || module || '\",\"severity\":' || severity || '}}' AS json FROM logs")
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.sinks.export import json_lines

    return json_lines(L.logs(spark, sf_dir).select("id", "module", "severity"))
