"""Knowledge: matching, search, enrichment, root causes, changes to knowledge (MAT, FTS, RCA, JOIN, DML)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.operators import aggregates as A
from syslumen.operators import analysis, enrich, indexing, matching, rca, search, tags, windows
from syslumen.queries import query
from syslumen.query_filters import WITH
from syslumen.session import read, shared_dir
from syslumen.sources import logview as L

# A small dimension: exact names, another suffix, templates, a local entry, families that exclude each other.
ENTRIES = [
    (1, "LOG", "IFNET", 3, "IF_DOWN", "Interface [IfName] reported [Kind]. (User=[User], Code=[Code])", "Interface went down", "Cable fault", "Check the cable", "official"),
    (2, "LOG", "IFNET", 7, "IF_UP", "Interface [IfName] came up", "Interface came up", "", "", "official"),
    (3, "ALARM", "BGP", 2, "PEER_BACKWARD_ACTIVE", "Peer [Peer] moved backward", "The neighbour's state moved backward", "Hold time", "Check the peer", "official"),
    (4, "LOG", "BFD", 5, "SESSION_LOST", "Interface <x> reported view. (User=<u>, Code=<c>)", "BFD session lost", "", "", "official"),
    (5, "LOG", "AAA", 4, "hwRadiusAuthServerDown", "", "RADIUS server down", "", "", "local"),
    (6, "LOG", "DEVM", 1, "OPTICAL_POWER", "Optical power of [port] is abnormal", "Optical power abnormal", "", "", "official"),
    (7, "LOG", "DEVM", 8, "OPTICAL_POWER", "Something else entirely", "Optical power (other)", "", "", "official"),
]
_FIELDS = "id bigint, entry_type string, module string, severity int, brief string, message string, description string, cause string, action string, source string"
MAPPINGS = [(1, 1, 10, "NE40E", "V8"), (2, 1, 11, "Huawei-VRP", "V5"), (3, 2, 10, "NE40E", "V8"), (4, 3, 12, "CloudEngine", "V2"), (5, 6, 12, "CE12800", "V2"), (6, 7, 13, "Huawei-VRP", "V9")]
DOCUMENTS = [(10, "NE40E manual"), (11, "VRP manual"), (12, "CE manual")]


def _values(rows: list[tuple], columns: str) -> str:
    kinds = [c.split()[1] for c in columns.split(", ")]
    cell = lambda v, k: f"CAST({v} AS BIGINT)" if k == "bigint" else str(v) if k in ("int", "boolean") else "'" + str(v).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(cell(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows) + f") AS t({', '.join(c.split()[0] for c in columns.split(', '))})"


_MAP = "id bigint, knowledge_id bigint, document_id bigint, product_type string, product_version string"
KB = f"{WITH}, k AS ({_values(ENTRIES, _FIELDS)}), m AS ({_values(MAPPINGS, _MAP)}), d AS ({_values(DOCUMENTS, 'id bigint, name string')})"


def knowledge(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, _FIELDS).withColumns({"parameters": F.lit(""), "impact": F.lit("")})


def mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPINGS, _MAP)


def prepared(spark: SparkSession) -> DataFrame:
    return matching.prepare(knowledge(spark), mappings(spark))


_MATCHED = f"""{KB} SELECT id,
CASE module WHEN 'IFNET' THEN 1 WHEN 'BGP' THEN 3 WHEN 'BFD' THEN 4 WHEN 'AAA' THEN 5 WHEN 'DEVM' THEN 7 ELSE 0 END AS knowledge_id,
CASE module WHEN 'IFNET' THEN 'EXACT' WHEN 'BGP' THEN 'MNEMONIC' WHEN 'BFD' THEN 'TEMPLATE' WHEN 'AAA' THEN 'LOCAL_EXACT' WHEN 'DEVM' THEN 'EXACT' ELSE 'UNMATCHED' END AS match_tier,
CAST(round(CASE module WHEN 'IFNET' THEN 1.0 - least(0.4, abs(severity - 3) * 0.1) WHEN 'BGP' THEN 0.9 WHEN 'BFD' THEN 0.8 WHEN 'AAA' THEN 0.95 WHEN 'DEVM' THEN 1.0 - least(0.4, abs(severity - 8) * 0.1) - 0.25 ELSE 0.0 END, 6) AS DOUBLE) AS match_confidence,
CASE module WHEN 'IFNET' THEN 11 WHEN 'BGP' THEN 12 WHEN 'DEVM' THEN 13 ELSE 0 END AS matched_document_id FROM logs"""


@query("mat_all_tiers", _MATCHED)
def mat_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = matching.match(L.logs(spark, sf_dir), prepared(spark), with_search=False)
    return made.select("id", F.col("knowledge_id").cast("int").alias("knowledge_id"), "match_tier", F.round("match_confidence", 6).alias("match_confidence"), F.col("matched_document_id").cast("int").alias("matched_document_id"))


@query("mat01_override", f"{KB} SELECT id, CASE WHEN module = 'IFNET' THEN 2 ELSE 0 END AS knowledge_id, CASE WHEN module = 'IFNET' THEN 'LOCAL_MAPPING' ELSE 'UNMATCHED' END AS match_tier FROM logs WHERE module IN ('IFNET', 'COMMENT', 'UNKNOWN')")
def mat01(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = spark.createDataFrame([("ifnet", "if_down", 2, True), ("bgp", "x", 2, False)], "module string, brief string, knowledge_id bigint, enabled boolean")
    made = matching.match(L.logs(spark, sf_dir).where("module IN ('IFNET', 'COMMENT', 'UNKNOWN')"), prepared(spark), bound, with_search=False)
    return made.select("id", F.col("knowledge_id").cast("int").alias("knowledge_id"), "match_tier")


@query("mat03_tier_counts", f"WITH r AS ({_MATCHED}) SELECT match_tier, count(*) AS n FROM r GROUP BY match_tier")
def mat03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(matching.match(L.logs(spark, sf_dir), prepared(spark), with_search=False), "match_tier")


@query("mat08_searched")
def mat08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier 4 on top of the others; scores are this engine's own."""
    renamed = L.logs(spark, sf_dir).withColumn("brief", F.when(F.col("module") == "BFD", F.lit("LOST")).otherwise(F.col("brief"))).withColumn("message_body", F.when(F.col("module") == "BFD", F.lit("the session is lost")).otherwise(F.col("message_body")))
    made = matching.match(renamed, prepared(spark))
    return made.select("id", "knowledge_id", "match_tier")


@query("mat13_context", f"""{WITH} SELECT id, CASE device_id WHEN 1 THEN 'CloudEngine 12800' WHEN 2 THEN 'NE40E' WHEN 3 THEN 'AirEngine 5760' ELSE 'Huawei-VRP' END AS product FROM logs""")
def mat13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.with_context(L.logs(spark, sf_dir), L.devices(spark)).select("id", "product")


@query("win05_best_candidate", "WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice FROM c WHERE r = 1")
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (-F.col("l_linenumber")).alias("o"))
    return windows.newest_per_key(own, ["l_orderkey"], ["l_extendedprice", "o"]).drop("o")


@query("win06_best_mapping", f"{KB}, s AS (SELECT knowledge_id, id, CASE WHEN upper(product_type) = 'CE12800' THEN CASE WHEN product_version = 'V2' THEN 150 ELSE 120 END WHEN product_type = 'CloudEngine' THEN 50 ELSE 10 END AS score FROM m) SELECT knowledge_id, min_by(id, struct_pack(a := -score, b := id)) AS mapping_id, max(score) AS score FROM s GROUP BY knowledge_id")
def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.functions.scalar import version_score

    score = version_score(F.col("product_type"), F.col("product_version"), F.lit("CE12800"), F.lit("v2"))
    own = mappings(spark).withColumn("score", score)
    return own.groupBy("knowledge_id").agg(F.min_by("id", F.struct((-F.col("score")).alias("a"), "id")).alias("mapping_id"), F.max("score").alias("score"))


@query("join06_nested_versions", f"{KB} SELECT k.id, coalesce(string_agg(m.id || ':' || product_type, ',' ORDER BY m.id), '') AS versions FROM k LEFT JOIN m ON m.knowledge_id = k.id GROUP BY k.id")
def join06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).select(F.col("k_id").alias("id"), F.array_join(F.transform("versions", lambda v: F.concat(v["mapping_id"].cast("string"), F.lit(":"), v["product_type"])), ",").alias("versions"))


@query("join07_mapping_documents", f"{KB} SELECT m.id, name FROM m LEFT JOIN d ON d.id = document_id")
def join07(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame(DOCUMENTS, "document_id bigint, name string")
    return mappings(spark).join(F.broadcast(docs), "document_id", "left").select("id", "name")


@query("join08_logs_with_knowledge", f"{KB} SELECT l.id, description FROM logs l LEFT JOIN k ON k.id = l.knowledge_id")
def join08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_knowledge(L.logs(spark, sf_dir), knowledge(spark)).select("id", "description")


@query("tml06_enriched", f"{KB} SELECT l.id, CASE WHEN knowledge_id = 1 AND module = 'IFNET' THEN 'Interface ' || regexp_extract(message_body, 'Interface (\\S+) ', 1) || ' reported click. (User=' || regexp_extract(message_body, 'User=(\\d+)', 1) || ', Code=' || regexp_extract(message_body, 'Code=(\\d+)', 1) || ')' END AS message_text FROM logs l WHERE module = 'IFNET' AND knowledge_id <> 2")
def tml06(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir).where("module = 'IFNET' AND knowledge_id <> 2")
    return enrich.with_knowledge(own, knowledge(spark)).select("id", "message_text")


@query("str14_event_summaries")
def str14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.with_knowledge(L.logs(spark, sf_dir), knowledge(spark)).select("id", "event_summary")


@query("agg16_dashboard", f"{KB} SELECT (SELECT count(*) FROM logs) AS logs, (SELECT count(DISTINCT source_file) FROM logs) AS files, (SELECT count(*) FROM k) AS knowledge, (SELECT count(DISTINCT module) FROM k) AS modules")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dashboard(L.logs(spark, sf_dir), knowledge(spark))


@query("agg17_knowledge_facets", f"{KB} SELECT 'severity' AS kind, CAST(severity AS STRING) AS value, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'entry_type', entry_type, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'product', product_type, count(DISTINCT knowledge_id) FROM m GROUP BY ALL UNION ALL SELECT 'version', product_version, count(DISTINCT knowledge_id) FROM m GROUP BY ALL")
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.knowledge_facets(knowledge(spark), mappings(spark))


@query("agg24_import_stats", f"{KB} SELECT entry_type, count(*) AS n FROM k GROUP BY entry_type")
def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(knowledge(spark), "entry_type")


@query("dml13_orphans", f"{KB} SELECT id FROM k WHERE source <> 'local' AND id IN (SELECT knowledge_id FROM m WHERE document_id = 12) AND id NOT IN (SELECT knowledge_id FROM m WHERE document_id <> 12)")
def dml13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.orphans(knowledge(spark), mappings(spark), 12).select("id")


@query("dml03_local_upsert", f"{KB} SELECT id, module, brief FROM k WHERE NOT (upper(module) = 'AAA' AND brief = 'hwRadiusAuthServerDown') UNION ALL SELECT 20, 'AAA', 'hwRadiusAuthServerDown' UNION ALL SELECT 21, 'NEW', 'EVENT'")
def dml03(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame([(20, "AAA", "hwRadiusAuthServerDown"), (21, "NEW", "EVENT")], "id bigint, module string, brief string")
    return tags.upsert(knowledge(spark).select("id", "module", "brief"), changes, ["module", "brief"])


@query("flt26_local_keyword", f"{KB} SELECT id FROM k WHERE module ILIKE '%radius%' OR brief ILIKE '%radius%' OR description ILIKE '%radius%'")
def flt26(spark: SparkSession, sf_dir: str) -> DataFrame:
    like = lambda c: F.col(c).ilike("%radius%")
    return knowledge(spark).where(like("module") | like("brief") | like("description")).select("id")


_TOKENS = "list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), [])"


@query("fts01_token_counts", f"SELECT item_id AS doc, token, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY ALL")
def fts01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index(read(spark, sf_dir, "benchmark"), "item_id", "text").select("doc", "token", "tf")


_BM25 = f"""WITH t AS (SELECT item_id AS doc, {_TOKENS} AS ts FROM benchmark), p AS (SELECT doc, len(ts) AS length, unnest(ts) AS token FROM t), q AS (SELECT doc, token, length, count(*) AS tf FROM p GROUP BY ALL),
s AS (SELECT count(DISTINCT doc) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc, length FROM q)), a AS (SELECT item_id AS query, unnest(list_distinct({_TOKENS})) AS token FROM benchmark), f AS (SELECT token, count(*) AS df FROM q GROUP BY token),
r AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score, count(*) AS hits FROM a JOIN q USING (token) JOIN f USING (token), s GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM r)
SELECT query, doc, round(score, 6) AS score, hits FROM o WHERE r <= 3"""


@query("fts03_bm25", _BM25)
def fts03(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    found = search.scores(search.index(items, "item_id", "text"), items.select(F.col("item_id").alias("query"), "text"), 3)
    return found.select("query", "doc", F.round("score", 6).alias("score"), "hits")


@query("fts03_published_index", _BM25)
def fts03_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    indexing.rebuild(root, items, "item_id", "text")
    found = indexing.find(spark, root, items.select(F.col("item_id").alias("query"), "text"), 3)
    return found.select("query", "doc", F.round("score", 6).alias("score"), "hits")


@query("fts03_filtered_search", f"{KB} SELECT id FROM k WHERE regexp_matches(lower(concat_ws(' ', brief, message, description, cause, action)), '(^|[^a-z0-9])(interface|peer)([^a-z0-9]|$)') AND entry_type = 'LOG'")
def fts03_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(knowledge(spark), "Interface peer", entry_type="log").select("id")


@query("fts04_highlight", "SELECT item_id, regexp_replace(text, '(?i)(the|de)', '<mark>\\1</mark>', 'g') AS marked FROM benchmark")
def fts04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", search.highlight(F.col("text"), "the de").alias("marked"))


#: Words of the query at their places in the document, stretches between two of them, and the best of each hit: most different words, shortest, first.
_FRAGMENTS = f"""{_BM25.rsplit("SELECT query", 1)[0].rstrip()}, h AS (SELECT query, doc FROM o WHERE r <= 3), d AS (SELECT item_id AS doc, lower(text) AS low, text FROM benchmark),
w AS (SELECT doc, low, regexp_extract_all(low, '[a-z0-9]+') AS ws, string_split_regex(low, '[a-z0-9]+') AS gaps FROM d),
u AS (SELECT doc, ws, gaps, unnest(range(1, len(ws) + 1)) AS i FROM w),
x AS (SELECT doc, i, ws[i] AS word, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[1:i-1], lambda g: length(g))), 0) AS a FROM u),
m AS (SELECT query, doc, i, word, a, a + length(word) AS b FROM h JOIN x USING (doc) JOIN (SELECT query, token AS word FROM a) USING (query, word)),
g AS (SELECT l.query, l.doc, l.a AS a, r.b AS b FROM m l JOIN m r ON l.query = r.query AND l.doc = r.doc AND l.i <= r.i AND (r.b - l.a <= 200 OR l.i = r.i)),
z AS (SELECT g.query, g.doc, g.a, g.b, count(DISTINCT m.word) AS n FROM g JOIN m ON m.query = g.query AND m.doc = g.doc AND m.a >= g.a AND m.b <= g.b GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query, doc ORDER BY n DESC, b - a, a) AS r FROM z)
SELECT query, doc, CAST(n AS BIGINT) AS words, substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS stretch FROM best JOIN d USING (doc) WHERE r = 1"""


@query("fts04_fragments", _FRAGMENTS)
def fts04_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    indexing.rebuild(root, items, "item_id", "text")
    asked = items.select(F.col("item_id").alias("query"), F.col("text").alias("asked"))
    hits = indexing.find(spark, root, asked.withColumnRenamed("asked", "text"), 3).join(items.select(F.col("item_id").alias("doc"), "text"), "doc").join(asked, "query")
    marked = F.regexp_extract_all(F.lower("fragment"), F.lit("<mark>(.*?)</mark>"), F.lit(1))
    return search.fragments(hits).select("query", "doc", F.size(F.array_distinct(marked)).cast("bigint").alias("words"), F.regexp_replace("fragment", "</?mark>", "").alias("stretch"))


_SUBJECT = "CASE WHEN device_id > 0 THEN 'd:' || device_id WHEN hostname <> '' THEN 'h:' || hostname ELSE 'f:' || source_file END"
_HOP = rca.Edge("x", ("IFNET",), ("IF_DOWN",), ("BFD",), ("BFD_SESS_DOWN",))


@query("rca04_subjects", f"{WITH} SELECT {_SUBJECT} AS subject, count(*) AS n FROM logs GROUP BY 1")
def rca04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).groupBy(rca.subject().alias("subject")).agg(F.count("*").alias("n"))


@query("join16_one_hop", f"{WITH}, t AS (SELECT {_SUBJECT} AS subject, id, module, brief, epoch_us(\"timestamp\") AS us FROM logs WHERE \"timestamp\" IS NOT NULL) SELECT a.subject, a.id AS from_id, b.id AS to_id, b.us - a.us AS delay_us FROM t a JOIN t b ON a.subject = b.subject WHERE a.module = 'IFNET' AND a.brief = 'IF_DOWN' AND b.module = 'BFD' AND b.brief = 'BFD_SESS_DOWN' AND (b.us > a.us OR (b.us = a.us AND b.id > a.id)) AND b.us <= a.us + 1800000000")
def join16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rca.one_hop(L.logs(spark, sf_dir), _HOP, 1800)


#: Windows, the logs in them and what each may lead to there, as the rules say of the modules and briefs of this table: from IFNET/IF_DOWN to
#: BFD and BGP, from BFD to BGP. Roots are tried by window and time, and carry on what is claimed; all that a root reaches it reaches at once,
#: since what BFD leads to the interface does as well. No parameter here names an entity.
_ROOTS = f"""{WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, t AS (
  SELECT {_SUBJECT} AS subject, id, upper(module) AS module, upper(brief) AS brief, severity, epoch_us("timestamp") AS us FROM logs
  WHERE "timestamp" IS NOT NULL AND (knowledge_id > 0 OR severity <= 4) ORDER BY "timestamp", id LIMIT 100000
), s AS (SELECT DISTINCT us FROM t), c(w, s) AS (
  SELECT 0, min(us) FROM s UNION ALL
  SELECT w + 1, (SELECT min(us) FROM s WHERE us >= c.s + 240000000) FROM c WHERE (SELECT min(us) FROM s WHERE us >= c.s + 240000000) IS NOT NULL
), p AS (SELECT w, t.* FROM t JOIN c ON us BETWEEN c.s AND c.s + 300000000), k AS (
  SELECT a.subject, a.w, a.id, a.us, a.module, a.brief, a.severity, list({{'m': b.module, 'us': b.us, 'id': b.id, 'b': b.brief}} ORDER BY CASE b.module WHEN 'BFD' THEN 0 ELSE 1 END, b.us, b.id) AS kids
  FROM p a JOIN p b ON a.subject = b.subject AND a.w = b.w AND (b.us, b.id) > (a.us, a.id)
  WHERE (a.module = 'IFNET' AND contains(a.brief, 'IF_DOWN') AND ((b.module = 'BFD' AND b.brief IN ('BFD_SESS_DOWN', 'SESS_DOWN')) OR (b.module = 'BGP' AND b.brief = 'PEER_BACKWARD')))
    OR (a.module = 'BFD' AND contains(a.brief, 'SESS_DOWN') AND b.module = 'BGP' AND b.brief = 'PEER_BACKWARD')
  GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY w, us, id) AS n FROM k), walk(subject, n, claimed, id, found) AS (
  SELECT DISTINCT subject, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST([] AS STRUCT(m VARCHAR, us BIGINT, id BIGINT, b VARCHAR)[]) FROM o UNION ALL
  SELECT subject, n, CASE WHEN len(f) > 0 THEN list_concat(claimed, list_append(list_transform(f, lambda x: x.id), id)) ELSE claimed END, id, f FROM (
    SELECT o.subject, o.n, v.claimed, o.id, CASE WHEN list_contains(v.claimed, o.id) THEN [] ELSE list_filter(o.kids, lambda x: NOT list_contains(v.claimed, x.id)) END AS f
    FROM walk v JOIN o ON o.subject = v.subject AND o.n = v.n + 1)
), e AS (
  SELECT o.subject, o.id AS root_id, o.us, o.module, o.brief, o.w, o.severity, v.found, len(v.found) AS n, list_min(list_transform(v.found, lambda x: x.us)) - o.us AS delay
  FROM walk v JOIN o ON o.subject = v.subject AND o.n = v.n WHERE len(v.found) > 0
), told AS (
  SELECT subject, 'LINK_ROUTING_CASCADE' AS rule, root_id, us AS root_us, module AS root_module, brief AS root_brief, CAST(w AS INT) AS "window", CAST(n AS INT) AS n_impacts,
    CASE WHEN n >= 3 OR severity <= 2 THEN 'CRITICAL' WHEN n >= 2 THEN 'HIGH' WHEN severity <= 4 THEN 'MEDIUM' ELSE 'LOW' END AS impact_level,
    floor((0.5 + 0.09 + least(0.18, 0.03 * n) + 0.15 * pow(2, -(delay / 1e6) / 150)) * 100 + 0.5) / 100 AS confidence,
    array_to_string(list_sort(list_append(list_transform(found, lambda x: x.id), root_id)), ',') AS correlated_ids,
    array_to_string(list_transform(found, lambda x: x.id || '<' || root_id || ' ' || x.m || '/' || x.b || ' ' || ((x.us - us) // 1000)), ';') AS impacts
  FROM e
)"""
_TOLD = 'SELECT * FROM told ORDER BY "window", root_us, root_id LIMIT 2000'


def _told(events: DataFrame) -> DataFrame:
    line = lambda i: F.format_string("%d<%d %s/%s %d", i["log_id"], i["from_log_id"], i["module"], i["brief"], i["delay_ms"])
    ids = F.array_join(F.col("correlated_ids").cast("array<string>"), ",")
    return events.select("subject", "rule", "root_id", "root_us", "root_module", "root_brief", "window", "n_impacts", "impact_level", "confidence", ids.alias("correlated_ids"), F.array_join(F.transform("impacts", line), ";").alias("impacts"))


@query("rca07_root_causes", f"{_ROOTS} {_TOLD}")
def rca07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(rca.analyse(rca.sample(L.logs(spark, sf_dir))))


@query("rca11_settled_in_slices", f"{_ROOTS} SELECT *, (SELECT max(us) FROM t) AS analyzed_until FROM told")
def rca11_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, path = rca.sample(L.logs(spark, sf_dir)), f"{shared_dir(spark)}/analysis-{uuid.uuid4().hex}"
    # stopped at once, then taken up again
    analysis.Analysis(spark, path).run(own, limit_s=0.0)
    found = analysis.Analysis(spark, path, windows=1 << 12).run(own, most_events=None)
    return _told(found.events).withColumn("analyzed_until", F.lit(found.analyzed_until).cast("bigint"))


@query("rca12_enriched", f"""{_ROOTS}, d AS ({L.DEVICES_SQL}), r AS (SELECT * FROM told ORDER BY "window", root_us, root_id LIMIT 2000),
x AS (SELECT root_id, CAST(unnest(string_split(correlated_ids, ',')) AS BIGINT) AS id FROM r)
SELECT r.root_id, any_value(r.rule) AS rule, string_agg(x.id || ' ' || coalesce(d.device_name, '?') || ' ' || l.raw_log, chr(10) ORDER BY x.id) AS logs
FROM r JOIN x USING (root_id) JOIN logs l ON l.id = x.id LEFT JOIN d ON d.device_id = l.device_id GROUP BY r.root_id""")
def rca12(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir)
    line = lambda x: F.concat_ws(" ", x["id"].cast("string"), F.coalesce(x["device_name"], F.lit("?")), x["raw_log"])
    return rca.enriched(rca.analyse(rca.sample(own)), own, L.devices(spark)).select("root_id", "rule", F.array_join(F.transform("logs", line), "\n").alias("logs"))
