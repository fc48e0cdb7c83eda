"""Lines, packages, local knowledge, searches and root causes over rows made from the given tables.

Queries of the same names over a few literal rows are tests (``queries.LITERAL``).
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.operators import cases, matching, rca, search, tags
from syslumen.queries import query
from syslumen.query_columns import _CLOCK, _DAY, _E
from syslumen.query_knowledge import _BM25, _ROOTS, _told
from syslumen.session import read, shared_dir
from syslumen.sources import logview as L
from syslumen.sources import package, raw

_U5, _TS19, _YEAR = "CAST(user_id % 5 AS STRING)", "substr(CAST(ts AS STRING), 1, 19)", "CAST(extract(year FROM ts) AS STRING)"

# ---- lines of devices, made from events


def _lines(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    own = read(spark, sf_dir, "events").selectExpr("'f' || CAST(event_id % 4 AS STRING) AS source_file", "CAST(event_id AS BIGINT) AS seq", f"{line} AS line")
    return raw.parse(raw.clean_lines(own))


_FORMS = f"""CASE event_id % 6
WHEN 0 THEN '<189>' || {_TS19} || '.123+08:00 SW-' || {_U5} || ' %%01IFNET/' || CAST(event_id % 8 AS STRING) || '/IF_DOWN_active(l)[' || {_E} || ']: Port is down. (Interface=[GE0/0/' || {_U5} || '], Kind=' || event_type || ')'
WHEN 1 THEN {_DAY} || ' ' || {_YEAR} || ' ' || {_CLOCK} || ' FW-' || {_U5} || ' %%01SEC/4/ATTACK(s): type=flood, src=10.0.0.' || {_U5}
WHEN 2 THEN '%%01BGP/0/PEER(l)[3][Slot=' || {_U5} || '/0]: lost'
WHEN 3 THEN '# note ' || event_type
WHEN 4 THEN 'nothing to see ' || event_type
ELSE '# Version: V' || {_E} END"""
_T = "WITH t AS (SELECT CAST(event_id AS BIGINT) AS seq, event_id % 6 AS c, ts, user_id % 5 AS u, event_type AS e FROM events)"
_STAMP = "CASE c WHEN 0 THEN strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END"


@query("prs01_line_forms", f"""{_T} SELECT seq, CASE c WHEN 0 THEN 'SW-' || u WHEN 1 THEN 'FW-' || u ELSE '' END AS hostname, ['IFNET', 'SEC', 'BGP', 'COMMENT', 'UNKNOWN', 'COMMENT'][c + 1] AS module,
CAST([seq % 8, 4, 0, 6, 8, 6][c + 1] AS INT) AS severity, ['IF_DOWN_active', 'ATTACK', 'PEER', 'COMMENT_LINE', 'UNPARSED', 'SOFTWARE_VERSION'][c + 1] AS brief, CASE c WHEN 2 THEN 'Slot=' || u || '/0' ELSE '' END AS slot_info,
CASE c WHEN 0 THEN '{{"Interface":"GE0/0/' || u || '","Kind":"' || e || '"}}' WHEN 1 THEN '{{"src":"10.0.0.' || u || '","type":"flood"}}' WHEN 3 THEN '{{"Comment":"note ' || e || '"}}' WHEN 5 THEN '{{"Version":"V' || seq || '"}}' ELSE '{{}}' END AS parameters_json,
{_STAMP} AS stamp FROM t""", whole=True)
def prs01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, _FORMS).select("seq", "hostname", "module", "severity", "brief", "slot_info", "parameters_json", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("prs03_bare_headers", "WITH t AS (SELECT CAST(event_id AS BIGINT) AS seq, event_id % 3 AS c, ts, user_id % 5 AS u FROM events) SELECT seq, ['SW-' || u, '', 'H' || u][c + 1] AS hostname, ['A', 'B', 'C'][c + 1] AS brief, CASE c WHEN 2 THEN strftime(ts, '%Y-%m-%d') END AS day FROM t", whole=True)
def prs03(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = f"CASE event_id % 3 WHEN 0 THEN 'SW-' || {_U5} || ' %%01BGP/4/A(l): x' WHEN 1 THEN '%%01BGP/4/B(l): x' ELSE '<13>' || {_TS19} || ' H' || {_U5} || ' %%BGP/4/C: x' END"
    return _lines(spark, sf_dir, line).select("seq", "hostname", "brief", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


@query("prs04_security", f"{_T} SELECT seq, CASE c WHEN 1 THEN 'Huawei-USG-Firewall' ELSE 'Huawei-VRP' END AS device_type, CASE c WHEN 0 THEN 'l' WHEN 1 THEN 's' WHEN 2 THEN 'l' ELSE '' END AS log_type FROM t", whole=True)
def prs04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, _FORMS).select("seq", "device_type", "log_type")


@query("prs05_comments", "SELECT CAST(event_id AS BIGINT) AS seq, CASE WHEN event_id % 2 = 0 THEN 'LOGFILE_CLOSED' ELSE 'LOGFILE_DIGEST' END AS brief, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events", whole=True)
def prs05(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = f"CASE WHEN event_id % 2 = 0 THEN '# This logfile is closed at ' || {_TS19} ELSE '# Digest:' || {_E} END"
    return _lines(spark, sf_dir, line).select("seq", "brief", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("prs07_added_parser", "SELECT CAST(event_id AS BIGINT) AS seq, CASE WHEN event_id % 2 = 0 THEN 'CUSTOM' ELSE 'UNKNOWN' END AS module, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'UNPARSED' END AS brief FROM events", whole=True)
def prs07(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = list(raw.PARSERS)
    try:
        raw.register_parser("custom", lambda line: line.startswith("CUSTOM|"), lambda line: {"module": F.lit("CUSTOM"), "brief": F.get(F.split(line, r"\|"), F.lit(1))})
        return _lines(spark, sf_dir, "CASE WHEN event_id % 2 = 0 THEN 'CUSTOM|' || event_type || '|rest' ELSE 'other ' || event_type END").select("seq", "module", "brief")
    finally:
        raw.PARSERS[:] = before


@query("prs08_batch_errors", "SELECT 'f' || event_id % 4 AS source_file, count(*) AS lines, count(*) FILTER (event_id % 6 = 4) AS unparsed FROM events GROUP BY 1", whole=True)
def prs08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, _FORMS).groupBy("source_file").agg(F.count("*").alias("lines"), F.count(F.when(F.col("brief") == "UNPARSED", 1)).alias("unparsed"))


@query("src02_listed_paths", "SELECT role, line, count(*) AS n FROM (SELECT role, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE role = 'user') GROUP BY ALL", whole=True)
def src02(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    # a folder a role, of which one is listed
    read(spark, sf_dir, "conversations").select("role", "text").write.partitionBy("role").text(base)
    return raw.read_lines(spark, [f"{base}/role=user"]).groupBy(F.lit("user").alias("role"), "line").agg(F.count("*").alias("n"))


# ---- packages



@query("src14_navigation_leaves", f"WITH logs AS ({L.LOGS_SQL}) SELECT DISTINCT 'LOG' AS entry_type, module, severity, brief FROM logs WHERE severity BETWEEN 0 AND 8 AND module NOT IN ('COMMENT', 'UNKNOWN')", whole=True)
def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = L.logs(spark, sf_dir).where("module NOT IN ('COMMENT', 'UNKNOWN')").select("module", "severity", "brief").distinct()
    text = F.format_string("<navi><topic txt='%s日志'><topic txt='%s/%d/%s' url='p.html' id='t1'/></topic></navi>", "module", "module", "severity", "brief")

    keys, leaves = ("entry_type", "module", "severity", "brief"), package.leaves

    @F.pandas_udf("array<struct<entry_type:string,module:string,severity:int,brief:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{k: x[k] for k in keys} for x in leaves(t)])

    return kinds.select(F.explode(run(text)).alias("l")).select("l.*")


@query("src13_profile", "SELECT CAST(p_partkey AS BIGINT) AS k, 'L' || p_partkey AS lib_id, p_brand AS product_type FROM part", whole=True)
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = package.profile

    @F.pandas_udf("lib_id string, product_type string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profile(t) for t in texts], columns=["lib_id", "product_type"])

    text = F.format_string("<profile><libId>L%d</libId><productType>%s</productType></profile>", "p_partkey", "p_brand")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("k"), run(text).alias("r")).select("k", "r.*")


@query("src16_link_paths", "SELECT CAST(page_id AS BIGINT) AS k, CASE page_id % 3 WHEN 0 THEN 'pages/p ' || page_id || '.html' WHEN 1 THEN 'resources/a/' || page_id || '.html' ELSE '' END AS path FROM pages", whole=True)
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolve = package.resolve

    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: resolve("resources", u))

    url = F.expr("CASE page_id % 3 WHEN 0 THEN concat('../pages/p%20', page_id, '.html?x#y') WHEN 1 THEN concat('a', chr(92), page_id, '.html') ELSE concat('../../../etc/', page_id) END")
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("k"), run(url).alias("path"))


# ---- local knowledge from parts

_LOCAL = {"module": "CASE WHEN p_partkey % 10 = 0 THEN '' ELSE lower(p_type) END", "brief": "p_name || CAST(p_partkey AS STRING)", "product": "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END", "version": "''", "severity": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size % 12 AS STRING) END", "entry_type": "CASE p_partkey % 7 WHEN 0 THEN 'note' WHEN 1 THEN 'alarm' WHEN 2 THEN '' ELSE 'LOG' END"}
_PARTS = "WITH t AS (SELECT p_partkey AS k, " + ", ".join(f"{e} AS {c}" for c, e in _LOCAL.items()) + " FROM part), e AS (SELECT *, CASE WHEN module = '' THEN 'module and brief are needed' WHEN severity <> '' AND CAST(severity AS INT) > 8 THEN 'severity is 0 to 8' WHEN entry_type = 'note' THEN 'entry_type is LOG or ALARM' END AS error FROM (SELECT k, module, brief, product, version, CASE WHEN severity = '0' THEN '0' ELSE severity END AS severity, entry_type FROM t)), g AS (SELECT upper(module) AS module, brief, CASE WHEN product = '' THEN '通用' ELSE product END AS product, CASE WHEN severity IN ('', '0') THEN 4 ELSE CAST(severity AS INT) END AS severity, CASE WHEN entry_type = '' THEN 'LOG' ELSE upper(entry_type) END AS entry_type FROM e WHERE error IS NULL)"


def _local(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = read(spark, sf_dir, "part").selectExpr(*(f"{_LOCAL.get(c, chr(39) * 2)} AS {c}" for c in cases.LOCAL_COLUMNS))
    return cases.local_rows(own)


@query("src17_local_csv", f"{_PARTS} SELECT * FROM g", whole=True)
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir)[0].select("module", "brief", "product", "severity", "entry_type")


@query("src17_local_csv_errors", f"{_PARTS} SELECT brief, error FROM e WHERE error IS NOT NULL", whole=True)
def src17_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir)[1].select("brief", "error")


@query("snk07_local_csv_lines", f"{_PARTS} SELECT module || ',' || brief || ',' || product || ',,' || severity || ',' || entry_type || ',,,,,,' AS line FROM g", whole=True)
def snk07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.local_csv(_local(spark, sf_dir)[0])


@query("dml01_conflicts_skip", "SELECT DISTINCT 'f' || event_id % 8 || '.log' AS name, CASE WHEN event_id % 8 < 4 THEN 'skip' ELSE 'import' END AS action FROM events", whole=True)
def dml01(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read(spark, sf_dir, "events").selectExpr("'f' || CAST(event_id % 8 AS STRING) || '.log' AS name").distinct()
    return tags.file_conflicts(new, L.logs(spark, sf_dir).select(F.col("source_file").alias("name")).distinct(), "skip").select("name", "action")


# ---- searches in benchmark items as entries of knowledge

_KINDS = {"id": "item_id", "module": "CASE WHEN item_id % 2 = 0 THEN 'BGP' ELSE 'OSPF' END", "severity": "CAST(1 + item_id % 4 AS INT)", "entry_type": "CASE WHEN item_id % 3 = 0 THEN 'ALARM' ELSE 'LOG' END", "brief": "''", "message": "text", "description": "'item ' || CAST(item_id AS STRING)", "cause": "''", "action": "''"}
#: Scores of all items for three words, as entries are searched: their description's words count as well.
_SCORED = _BM25.replace("AS ts FROM benchmark)", "AS ts FROM (SELECT item_id, text || ' item ' || item_id AS text FROM benchmark))", 1).split(", a AS (")[0] + ", a AS (SELECT unnest(['the', 'le', 'die']) AS token), f AS (SELECT token, count(*) AS df FROM q GROUP BY token), r AS (SELECT doc AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM a JOIN q USING (token) JOIN f USING (token), s GROUP BY ALL)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").selectExpr(*(f"{e} AS {c}" for c, e in _KINDS.items()))


@query("fts03_filtered_search", f"{_SCORED} SELECT id, round(score, 6) AS score FROM r WHERE id % 2 = 0 AND id % 3 <> 0 ORDER BY r.score DESC, id LIMIT 100", whole=True)
def fts03_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_entries(spark, sf_dir), "die The le", module="bgp", entry_type="log", size=100).select("id", F.round("score", 6).alias("score"))


@query("fts08_hits_with_knowledge", f"{_SCORED} SELECT id, 'item ' || id AS description FROM r ORDER BY id % 4, r.score DESC, id LIMIT 100", whole=True)
def fts08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_entries(spark, sf_dir), "die The le", sort="severity", size=100).select("id", "description")


@query("fts02_index_rows", "WITH n AS (SELECT count(*) AS n FROM benchmark), m AS (SELECT p_partkey % (SELECT n FROM n) AS knowledge_id, upper(p_brand) AS p FROM part) SELECT item_id AS id, coalesce(array_to_string(list_sort(list_distinct(list(p) FILTER (p IS NOT NULL))), ','), '') AS products FROM benchmark LEFT JOIN m ON m.knowledge_id = item_id GROUP BY item_id", whole=True)
def fts02(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _entries(spark, sf_dir).withColumns({"parameters": F.lit(""), "source": F.lit("official")})
    n = F.lit(own.count())
    versions = read(spark, sf_dir, "part").select((F.col("p_partkey") % n).alias("knowledge_id"), F.col("p_partkey").cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("document_id"), F.lower("p_brand").alias("product_type"), F.lit("V1").alias("product_version"))
    return matching.prepare(own, versions).select(F.col("k_id").alias("id"), F.array_join(F.array_sort(F.array_distinct(F.transform("versions", lambda v: v["product_u"]))), ",").alias("products"))


# ---- root causes, over logs that are changed in one respect each

_FROM = 'FROM logs\n  WHERE "timestamp" IS NOT NULL'
assert _FROM in _ROOTS
_LAST = 'ORDER BY "window", root_us, root_id LIMIT {}'


def _changed(how: str) -> str:
    return _ROOTS.replace(_FROM, _FROM.replace("FROM logs", f"FROM (SELECT * REPLACE ({how}) FROM logs)"))


def _found(spark: SparkSession, sf_dir: str, rules: list[rca.Edge] | None = None, **changes) -> DataFrame:
    logs = L.logs(spark, sf_dir)
    return _told(rca.analyse(rca.sample(logs.withColumns({k: F.expr(v) for k, v in changes.items()})), rules))


_PARITY = "'{\"Interface\":\"GE' || CAST(id % 2 AS STRING) || '\"}'"


@query("rca05_entities", _ROOTS.replace("AND (b.us, b.id) > (a.us, a.id)", "AND (b.us, b.id) > (a.us, a.id) AND a.id % 2 = b.id % 2") + ' SELECT root_id, correlated_ids AS ids FROM told ' + _LAST.format(2000), whole=True)
def rca05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, parameters_json=_PARITY).select("root_id", F.col("correlated_ids").alias("ids"))


_UP = "CASE WHEN module = 'BFD' AND id % 2 = 0 THEN 'SESS_UP' ELSE brief END"


@query("rca06_recoveries", _changed(f"{_UP} AS brief").replace(" OR (b.module = 'BGP' AND b.brief = 'PEER_BACKWARD')", "").replace("OR (a.module = 'BFD'", "OR (FALSE") + ' SELECT root_id, correlated_ids AS ids FROM told ' + _LAST.format(2000), whole=True)
def rca06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, rca.rule("r", ("IFNET", "IF_DOWN", "BFD", "SESS_UP,BFD_SESS_DOWN")), brief=_UP).select("root_id", F.col("correlated_ids").alias("ids"))


_OTHER = "CASE WHEN module = 'IFNET' THEN 'MY_IF_DOWN_X' WHEN module = 'BFD' AND id % 2 = 0 THEN 'SESS_DOWN_X' ELSE brief END"


@query("rca08_roots_hold_words_steps_equal_them", _changed(f"{_OTHER} AS brief") + ' SELECT root_id, correlated_ids AS ids FROM told ' + _LAST.format(2000), whole=True)
def rca08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, brief=_OTHER).select("root_id", F.col("correlated_ids").alias("ids"))


@query("rca09_confidence", f"{_ROOTS} SELECT root_id, confidence, impact_level FROM told {_LAST.format(2000)}", whole=True)
def rca09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("root_id", "confidence", "impact_level")


@query("rca10_impact_levels", f"{_ROOTS} SELECT impact_level AS level, n_impacts AS n, count(*) AS events FROM told GROUP BY ALL", whole=True)
def rca10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rca.analyse(rca.sample(L.logs(spark, sf_dir)), most_events=None)
    return found.groupBy(F.col("impact_level").alias("level"), F.col("n_impacts").alias("n")).agg(F.count("*").alias("events"))


@query("rca11_windows_and_cap", f"{_ROOTS} SELECT root_id, \"window\" FROM told {_LAST.format(10)}", whole=True)
def rca11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rca.analyse(rca.sample(L.logs(spark, sf_dir)), most_events=10).select("root_id", "window")


@query("mth01_confidence", f"{_ROOTS} SELECT root_module, n_impacts, min(confidence) AS least, max(confidence) AS most FROM told GROUP BY ALL", whole=True)
def mth01(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rca.analyse(rca.sample(L.logs(spark, sf_dir)), most_events=None)
    return found.groupBy("root_module", "n_impacts").agg(F.min("confidence").alias("least"), F.max("confidence").alias("most"))

