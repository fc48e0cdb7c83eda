"""The rest of the inventory: reading, parsers one by one, parts of matching, search, root causes, reports and sinks."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syslumen.functions import scalar as S
from syslumen.operators import enrich, matching, rca, search, tags
from syslumen.operators import timeline as TL
from syslumen.queries import query
from syslumen.query_filters import WITH
from syslumen.query_knowledge import KB, knowledge, mappings, prepared
from syslumen.query_more import _NAVI, _files
from syslumen.query_text import _LINES, _table
from syslumen.session import micros
from syslumen.sinks import export
from syslumen.sources import logview as L
from syslumen.sources import package, raw


def _rows(*rows: tuple) -> str:
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


# ---- reading


@query("src02_listed_paths", f"SELECT * FROM (VALUES {_rows(('a.log', 'x'), ('b.log', 'y'))}) AS t(source_file, line)")
def src02(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _files(spark, {"a.log": "x", "b.log": "y", "c.log": "z"})
    return raw.read_lines(spark, [f"{base}/a.log", f"{base}/b.log"]).select("source_file", "line")


@query("src03_pasted_text", f"SELECT CAST(seq AS BIGINT) AS seq, line FROM (VALUES {_rows((0, 'one'), (1, 'two'))}) AS t(seq, line)")
def src03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.from_text(spark, "pasted", "one\r\ntwo").select("seq", "line")


@query("src08_preview", f"{WITH} SELECT source_file, count(*) AS lines, least(greatest(CAST(ceil(count(*) / 25000.0) AS BIGINT), 1), 600) AS eta_s FROM logs GROUP BY source_file")
def src08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.preview(L.logs(spark, sf_dir)).select("source_file", "lines", "eta_s")


def _archive() -> bytes:
    inner, out = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("doc/PROFILE.XML", "<p><libId>L</libId><productType>NE40E</productType></p>")
        z.writestr("doc\\resources\\navi.xml", _NAVI.replace("url='p.html'", "url='../P.HTML'"))
        z.writestr("doc/p.html", "<h2>message</h2>Peer is down")
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("nested.hdx", inner.getvalue())
    return out.getvalue()


@query("src11_nested_archives", f"SELECT * FROM (VALUES {_rows(('BGP', 'PEER_DOWN', 'Peer is down'), ('IFNET', 'hwIfDown', ''))}) AS t(module, brief, message)")
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {p: z.read(i) for p, z, i in package.entries(_archive())}
    return spark.createDataFrame([(r["module"], r["brief"], r["message"]) for r in package._rows("a.zip", found)], "module string, brief string, message string")


@query("src12_archive_guards", f"SELECT * FROM (VALUES {_rows(('../x', True), ('x', False))}) AS t(entry, refused)")
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name in ("../x", "x"):
        raw_ = io.BytesIO()
        with zipfile.ZipFile(raw_, "w") as z:
            z.writestr(name, "y")
        try:
            list(package.entries(raw_.getvalue()))
            out.append((name, False))
        except package.PackageError:
            out.append((name, True))
    return spark.createDataFrame(out, "entry string, refused boolean")


_table("str21_gb18030", "k string, s string", [("a", "x")], lambda k, s: F.lit(package.decode("接口 down".encode("gb18030"))), [("a", "接口 down")])

# ---- top-k, joins, order


@query("top01_modules_of_devices", f"{WITH}, c AS (SELECT device_id, module, count(*) AS n FROM logs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY n DESC, module) AS r FROM c) SELECT device_id, module, n FROM r WHERE r <= 3")
def top01(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = L.logs(spark, sf_dir).groupBy("device_id", "module").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("n"), "module"))).where("r <= 3").drop("r")


@query("join05_logs_with_all_tags", f"{WITH} SELECT log_id AS id FROM rel WHERE tag_id IN (1, 2) GROUP BY log_id HAVING count(DISTINCT tag_id) = 2")
def join05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.plans.filters import tagged

    return tagged(L.relations(spark, sf_dir), [1, 2], all_of=True)


@query("join11_exact_candidates", f"{KB} SELECT l.id, k.id AS k_id FROM logs l JOIN k ON upper(l.module) = upper(k.module) AND upper(l.brief) = upper(k.brief)")
def join11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.exact_candidates(matching.signatures(L.logs(spark, sf_dir)), prepared(spark)).select("id", "k_id")


@query("join12_stem_candidates", f"{KB} SELECT l.id, k.id AS k_id FROM logs l JOIN k ON l.module = k.module AND regexp_replace(upper(l.brief), '_(ACTIVE|DOWN|UP)$', '') = regexp_replace(upper(k.brief), '_(ACTIVE|DOWN|UP)$', '') AND upper(l.brief) <> upper(k.brief) WHERE l.module = 'BGP'")
def join12(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = matching.signatures(L.logs(spark, sf_dir).where("module = 'BGP'"))
    return matching.stem_candidates(own, prepared(spark)).select("id", "k_id")


@query("join13_template_candidates", f"{WITH} SELECT id, CAST(4 AS BIGINT) AS k_id FROM logs WHERE module = 'BFD'")
def join13(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = matching.signatures(L.logs(spark, sf_dir)).withColumn("h", matching.head(F.col("message_body"))).where("module_u = 'BFD'")
    return matching.template_candidates(own, prepared(spark)).select("id", "k_id")


@query("join14_search_candidates", "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ts FROM benchmark) SELECT a.item_id AS query, b.item_id AS doc, len(list_intersect(a.ts, b.ts)) AS hits FROM t a, t b WHERE len(list_intersect(a.ts, b.ts)) > 0")
def join14(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return search.scores(search.index(items, "item_id", "text"), items.select(F.col("item_id").alias("query"), "text"), None).select("query", "doc", "hits")


@query("join15_local_lookup", f"{KB} SELECT l.id FROM logs l JOIN k ON k.source = 'local' AND upper(l.module) = upper(k.module) AND upper(l.brief) = upper(k.brief)")
def join15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.local_candidates(matching.signatures(L.logs(spark, sf_dir)), prepared(spark)).select("id")


@query("join17_exploded_ids", f"{WITH} SELECT min(id) AS root_id, count(*) AS logs, count(DISTINCT raw_log) AS lines FROM logs WHERE severity <= 2 GROUP BY source_file")
def join17(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir)
    events = own.where("severity <= 2").groupBy("source_file").agg(F.min("id").alias("root_id"), F.array_sort(F.collect_list("id")).alias("correlated_ids"))
    made = rca.enriched(events, own, L.devices(spark))
    return made.select("root_id", F.size("logs").cast("bigint").alias("logs"), F.size(F.array_distinct(F.transform("logs", lambda x: x["raw_log"]))).cast("bigint").alias("lines"))


@query("agg23_tag_usage", f"{WITH} SELECT name, count(log_id) AS logs FROM tags LEFT JOIN rel USING (tag_id) GROUP BY name")
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.usage(L.tags(spark), L.relations(spark, sf_dir)).select("name", "logs")


@query("win07_blended_rank", "WITH s AS (SELECT l_orderkey, l_linenumber, 0.6 * l_discount * 10 + 0.4 * l_tax * 10 AS blend FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(blend, 9) DESC, l_linenumber) AS r FROM s) SELECT l_orderkey, l_linenumber FROM r WHERE r = 1")
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("blend", F.round(F.lit(0.6) * F.col("l_discount") * 10 + F.lit(0.4) * F.col("l_tax") * 10, 9))
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("blend"), "l_linenumber")
    return own.withColumn("r", F.row_number().over(w)).where("r = 1").select("l_orderkey", "l_linenumber")


@query("win08_file_order", f"{WITH} SELECT id, CAST(row_number() OVER (PARTITION BY source_file ORDER BY id) AS INT) AS place FROM logs")
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir).select("id", "source_file").repartition(7, "id")
    return own.select("id", F.row_number().over(Window.partitionBy("source_file").orderBy("id")).alias("place"))


# ---- parsers


def _parsed(spark: SparkSession, *lines: str) -> DataFrame:
    return raw.parse(raw.clean_lines(raw.from_text(spark, "f", "\n".join(lines))))


@query("prs03_bare_headers", f"SELECT * FROM (VALUES {_rows(('SW-9', 'BGP', 'A', None), ('', 'BGP', 'B', None), ('H', 'BGP', 'C', '2026-04-15'))}) AS t(hostname, module, brief, day)")
def prs03(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _parsed(spark, "SW-9 %%01BGP/4/A(l): x", "%%01BGP/4/B(l): x", "<13>2026-04-15 10:00:00 H %%BGP/4/C: x")
    return made.select("hostname", "module", "brief", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


@query("prs04_security", f"SELECT * FROM (VALUES {_rows(('ATTACK', 'Huawei-USG-Firewall', 's'), ('PEER', 'Huawei-VRP', 'l'), ('IF_DOWN_active', 'Huawei-VRP', 'l'))}) AS t(brief, device_type, log_type)")
def prs04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, *_LINES[:3]).select("brief", "device_type", "log_type")


@query("prs05_comments", f"SELECT * FROM (VALUES {_rows(('LOGFILE_CLOSED', '2024-03-20 15:30:00'), ('LOGFILE_DIGEST', None))}) AS t(brief, stamp)")
def prs05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, "# This logfile is closed at 2024-03-20 15:30:00", "# Digest:abc").select("brief", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


_table("prs06_supported", "s string", [("x %%01A/4/B(l): y",), ("%%A/9/B: y",), ("A/4/B",)], lambda s: s.rlike(raw.SUPPORTED), [("x %%01A/4/B(l): y", True), ("%%A/9/B: y", False), ("A/4/B", False)])


@query("prs07_added_parser", f"SELECT * FROM (VALUES {_rows(('CUSTOM', 'X'), ('UNKNOWN', 'UNPARSED'))}) AS t(module, brief)")
def prs07(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = list(raw.PARSERS)
    try:
        raw.register_parser("custom", lambda line: line.startswith("CUSTOM|"), lambda line: {"module": F.lit("CUSTOM"), "brief": F.get(F.split(line, r"\|"), F.lit(1))})
        return _parsed(spark, "CUSTOM|X|rest", "other").select("module", "brief")
    finally:
        raw.PARSERS[:] = before


@query("prs08_batch_errors", f"SELECT count(*) AS lines, count(*) FILTER (unparsed) AS unparsed FROM (VALUES {_rows(*[(k == 7,) for k in range(8)])}) AS t(unparsed)")
def prs08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, *_LINES).agg(F.count("*").alias("lines"), F.count(F.when(F.col("brief") == "UNPARSED", 1)).alias("unparsed"))


_table("tim06_sql_times", "t string", [("2026-04-15 14:23:10.5",), ("bad",), (None,)], lambda t: micros(S.parse_custom_time(t)), [("2026-04-15 14:23:10.5", 1776262990500000), ("bad", None), (None, None)])
_table("jsn02_lists", "s string", [("[1,2,3]",), ("bad",)], lambda s: F.to_json(F.from_json(s, "array<bigint>")), [("[1,2,3]", "[1,2,3]"), ("bad", None)])
_table("fam04_candidate_families", "p string, t string", [("CE12800", ""), ("", "ACMAC list"), ("", "USER_INFO_X"), ("", "none")], lambda p, t: matching.candidate_family(F.array(F.struct(S.product_family(p).alias("family"))), t), [("CE12800", "CLOUDENGINE"), ("", "WLAN"), ("", "CAMPUS"), ("", "UNKNOWN")])
_table("fam05_features", "k_family string, wireless boolean, wired boolean, k_parameters string", [("WLAN", False, True, ""), ("WLAN", True, False, ""), ("CAMPUS", True, False, "USERINFO"), ("NETENGINE", True, False, ""), ("UNKNOWN", True, False, "")], lambda *c: matching._feature(), [("WLAN", -20), ("WLAN", 30), ("CAMPUS", -20), ("NETENGINE", -10), ("UNKNOWN", 0)])


@query("hsh02_stable_key", "SELECT p_partkey, sha256(strlen(trim(p_name)) || ':' || trim(p_name) || strlen(trim(p_type)) || ':' || trim(p_type)) AS h FROM part")
def hsh02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", S.content_hash(F.col("p_name"), F.col("p_type")).alias("h"))


# ---- matching, part by part


def _matched(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return matching.match(L.logs(spark, sf_dir).where(where), prepared(spark), with_search=False)


@query("mat00_gate", f"{WITH} SELECT id, 'UNMATCHED' AS match_tier FROM logs WHERE module IN ('UNKNOWN', 'COMMENT')")
def mat00(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, "module IN ('UNKNOWN', 'COMMENT')").select("id", "match_tier")


@query("mat02_local", f"{WITH} SELECT id, 'LOCAL_EXACT' AS match_tier, CAST(0.95 AS DOUBLE) AS match_confidence FROM logs WHERE module = 'AAA'")
def mat02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, "module = 'AAA'").select("id", "match_tier", "match_confidence")


@query("mat05_mnemonic", f"{WITH} SELECT id, 'MNEMONIC' AS match_tier, CAST(0.9 AS DOUBLE) AS match_confidence FROM logs WHERE module = 'BGP'")
def mat05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, "module = 'BGP'").select("id", "match_tier", "match_confidence")


@query("mat09_fallback", f"{WITH} SELECT id, 'EXACT' AS match_tier, CAST(0.35 AS DOUBLE) AS match_confidence FROM logs WHERE module = 'DEVM' AND severity <= 4")
def mat09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir, "module = 'DEVM' AND severity <= 4").select("id", "match_tier", F.round("match_confidence", 6).alias("match_confidence"))


@query("mat11_suspects", f"{WITH} SELECT id, 'FAMILY_SUSPECT' AS match_tier, CAST(0.3 AS DOUBLE) AS match_confidence FROM logs WHERE module = 'IFNET'")
def mat11(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir).where("module = 'IFNET'").withColumn("message_body", F.concat(F.lit("[WLAN_X] "), "message_body"))
    only = matching.prepare(knowledge(spark).where("id = 1"), mappings(spark).where("id = 1"))
    return matching.match(own, only, with_search=False).select("id", "match_tier", "match_confidence")


@query("mat12_document", f"{WITH} SELECT id, CAST(10 AS BIGINT) AS matched_document_id FROM logs WHERE module = 'IFNET'")
def mat12(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir).where("module = 'IFNET'").withColumns({"product": F.lit("ne40e"), "version": F.lit("V8")})
    return matching.match(own, prepared(spark), with_search=False).select("id", "matched_document_id")


@query("mat14_hosts_change_the_product", f"{WITH} SELECT id, CAST(CASE WHEN device_id = 2 THEN 10 ELSE 11 END AS BIGINT) AS matched_document_id FROM logs WHERE module = 'IFNET'")
def mat14(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = matching.with_context(L.logs(spark, sf_dir).where("module = 'IFNET'"), L.devices(spark).where("device_id = 2"))
    return matching.match(own, prepared(spark), with_search=False).select("id", "matched_document_id")


# ---- search


@query("fts02_index_rows", f"{KB} SELECT k.id, coalesce(array_to_string(list_sort(list_distinct(list(upper(product_type)) FILTER (product_type IS NOT NULL))), ','), '') AS products FROM k LEFT JOIN m ON m.knowledge_id = k.id GROUP BY k.id")
def fts02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).select(F.col("k_id").alias("id"), F.array_join(F.array_sort(F.array_distinct(F.transform("versions", lambda v: v["product_u"]))), ",").alias("products"))


@query("fts05_append_and_delete", "WITH p AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark WHERE item_id >= 5) SELECT item_id AS doc, count(*) AS tokens FROM p GROUP BY item_id")
def fts05(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = search.index(items.where("item_id < 20"), "item_id", "text").unionByName(search.index(items.where("item_id >= 20"), "item_id", "text"))
    left = tags.delete(whole, items.where("item_id < 5").select(F.col("item_id").alias("doc")), ["doc"])
    return left.groupBy("doc").agg(F.count("*").alias("tokens"))


@query("fts08_hits_with_knowledge", f"{KB} SELECT id, description FROM k WHERE regexp_matches(lower(concat_ws(' ', brief, message, description, cause, action)), '(^|[^a-z0-9])optical([^a-z0-9]|$)')")
def fts08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(knowledge(spark), "optical", sort="severity").select("id", "description")


# ---- root causes


@query("rca02_loops_are_refused", "SELECT TRUE AS refused")
def rca02(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        rca.rule("loop", ("A", "X", "A", "X"))
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


def _fault(id_: int, s: int, module: str, brief: str, params: str = "{}") -> tuple:
    return (id_, 1, s, module, brief, 4, params)


def _faults(spark: SparkSession, *rows: tuple) -> DataFrame:
    own = spark.createDataFrame(list(rows), "id bigint, device_id bigint, s int, module string, brief string, severity int, parameters_json string")
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return own.withColumns({"timestamp": F.timestamp_add("SECOND", F.col("s"), start), "hostname": F.lit("h"), "source_file": F.lit("f")})


_GE = '{{"Interface":"GE{}"}}'


@query("rca05_entities", "SELECT CAST(1 AS BIGINT) AS root_id, '1,2' AS ids")
def rca05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _faults(spark, _fault(1, 0, "IFNET", "IF_DOWN", _GE.format(1)), _fault(2, 1, "BFD", "SESS_DOWN", _GE.format(1)), _fault(3, 2, "BFD", "SESS_DOWN", _GE.format(2)))
    return rca.analyse(rows).select("root_id", F.array_join("correlated_ids", ",").alias("ids"))


@query("rca06_recoveries", "SELECT CAST(1 AS BIGINT) AS root_id, '1,3' AS ids")
def rca06(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rca.rule("r", ("IFNET", "IF_DOWN", "BFD", "SESS_UP,SESS_DOWN"))
    rows = _faults(spark, _fault(1, 0, "IFNET", "IF_DOWN"), _fault(2, 1, "BFD", "SESS_UP"), _fault(3, 2, "BFD", "SESS_DOWN"))
    return rca.analyse(rows, edges).select("root_id", F.array_join("correlated_ids", ",").alias("ids"))


@query("rca08_roots_hold_words_steps_equal_them", "SELECT CAST(1 AS BIGINT) AS root_id, '1,3' AS ids")
def rca08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _faults(spark, _fault(1, 0, "IFNET", "MY_IF_DOWN_X"), _fault(2, 1, "BFD", "SESS_DOWN_X"), _fault(3, 2, "BFD", "SESS_DOWN"))
    return rca.analyse(rows).select("root_id", F.array_join("correlated_ids", ",").alias("ids"))


@query("rca09_confidence", "SELECT CAST(1 AS BIGINT) AS root_id, CAST(0.77 AS DOUBLE) AS confidence, 'MEDIUM' AS impact_level")
def rca09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rca.analyse(_faults(spark, _fault(1, 0, "IFNET", "IF_DOWN"), _fault(2, 0, "BFD", "SESS_DOWN"))).select("root_id", "confidence", "impact_level")


@query("rca11_windows_and_cap", "SELECT CAST(1 AS BIGINT) AS root_id, 0 AS \"window\"")
def rca11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _faults(spark, *(_fault(2 * k + j + 1, 1000 * k + j, m, b) for k in range(3) for j, (m, b) in enumerate((("IFNET", "IF_DOWN"), ("BFD", "SESS_DOWN")))))
    return rca.analyse(rows, most_events=1).select("root_id", "window")


# ---- reports and sinks


@query("tml01_devices_with_knowledge", f"{KB} SELECT l.id, coalesce(nullif(device_name, ''), hostname) AS device_name, description FROM (SELECT * FROM logs WHERE device_id = 2 ORDER BY \"timestamp\" NULLS FIRST, id LIMIT 500) l LEFT JOIN devices USING (device_id) LEFT JOIN k ON k.id = l.knowledge_id")
def tml01(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = TL.timeline(L.logs(spark, sf_dir), L.devices(spark), device_ids=[2])
    return enrich.with_knowledge(first, knowledge(spark)).select("id", "device_name", "description")


@query("tml03_report", f"{WITH} SELECT device_id, count(*) AS total FROM logs WHERE device_id IN (1, 2) GROUP BY device_id")
def tml03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.report(L.logs(spark, sf_dir), [1, 2])["devices"].select("device_id", "total")


@query("tml05_summary_text", f"{WITH} SELECT '- rows: ' || count(*) AS line FROM logs")
def tml05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(TL.summary_markdown(L.logs(spark, sf_dir), "T").split("\n")[2],)], "line string")


@query("tml08_four_texts", f"{KB} SELECT l.id, description AS description_text, cause AS cause_text, action AS action_text FROM logs l JOIN k ON k.id = l.knowledge_id")
def tml08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_knowledge(L.logs(spark, sf_dir).where("knowledge_id > 0"), knowledge(spark)).select("id", "description_text", "cause_text", "action_text")


@query("snk01_written_twice", f"{WITH} SELECT source_file, count(*) AS n FROM logs GROUP BY source_file")
def snk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{_files(spark, {'keep': 'x'})}-table"
    own = L.logs(spark, sf_dir).withColumn("task_id", F.lit("t"))
    export.write_logs(own, base)
    export.write_logs(own.where("source_file LIKE '%f1.log'"), base)
    return spark.read.parquet(base).groupBy("source_file").agg(F.count("*").alias("n"))


@query("snk04_html_sections", "SELECT 7 AS sections")
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(export.html_report(L.logs(spark, sf_dir), "T", 10).count("<h2>"),)], "sections int")


@query("snk05_devices_html", "SELECT TRUE AS has_conclusion")
def snk05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("<h2>Conclusion</h2>" in export.multi_device_html(L.logs(spark, sf_dir), [1, 2], "T"),)], "has_conclusion boolean")


@query("snk06_evidence", f"SELECT * FROM (VALUES {_rows(('README.txt',), ('logs.csv',), ('metadata.json',), ('report.html',))}) AS t(name)")
def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir).where("severity = 1")
    with zipfile.ZipFile(io.BytesIO(export.evidence(own, "T"))) as z:
        return spark.createDataFrame([(n,) for n in z.namelist()], "name string")
