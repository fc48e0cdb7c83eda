"""Aggregations, joins, windows and changes over the log view (AGG, JOIN, WIN, DML, TML)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.operators import aggregates as A
from syslumen.operators import tags as T
from syslumen.operators import timeline as TL
from syslumen.operators import windows as W
from syslumen.queries import query
from syslumen.query_filters import WITH
from syslumen.session import micros, read
from syslumen.sources import logview as L

US = 'epoch_us("timestamp")'
_RATE = "CASE WHEN count(*) = 0 THEN 0.0 ELSE floor({} * 100.0 / count(*) * 10 + 0.5) / 10 END"
_MATCHED, _UNPARSED = "count(*) FILTER (knowledge_id > 0)", "count(*) FILTER (module = 'UNKNOWN' AND brief = 'UNPARSED')"
_EVENTS = "module <> '' AND module <> 'COMMENT'"


@query("agg01_overview", f"{WITH} SELECT count(*) AS total, {_MATCHED} AS matched, {_UNPARSED} AS unparsed, count(*) FILTER (coalesce(device_id, 0) = 0) AS unassigned, min({US}) AS first_us, max({US}) AS last_us, {_RATE.format(_MATCHED)} AS match_rate, {_RATE.format(f'(count(*) - {_UNPARSED})')} AS parse_rate FROM logs")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overview(L.logs(spark, sf_dir))


@query("agg02_severity", f"{WITH} SELECT severity, count(*) AS n FROM logs GROUP BY severity")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(L.logs(spark, sf_dir), "severity")


@query("agg03_match_tier", f"{WITH} SELECT match_tier, count(*) AS n FROM logs GROUP BY match_tier")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(L.logs(spark, sf_dir), "match_tier")


_TOP = f"SELECT module, count(*) AS n, max(severity) AS max_severity, min(severity) AS worst_severity, min(id) AS sample_id FROM logs WHERE {_EVENTS} GROUP BY module ORDER BY n DESC, module LIMIT 5"


@query("agg04_top_modules", f"{WITH} {_TOP}")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_modules(L.logs(spark, sf_dir))


_SPOTS = f"SELECT module, brief, count(*) AS n, min({US}) AS first_us, max({US}) AS last_us, min(id) AS sample_id FROM logs WHERE {_EVENTS} AND coalesce(knowledge_id, 0) = 0 GROUP BY module, brief ORDER BY n DESC, module, brief LIMIT 10"


@query("agg05_unmatched_hotspots", f"{WITH} {_SPOTS}")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unmatched_hotspots(L.logs(spark, sf_dir))


_SECTION = "SELECT '{0}' AS section, {1} AS key, {2} AS key2, count(*) AS n, min(us) AS first_us, max(us) AS last_us, min(severity) AS low, max(severity) AS high, min(id) AS sample_id FROM t WHERE {3} GROUP BY ALL{4}"
_NO = "CAST(NULL AS STRING)"
_SUMMARY = " UNION ALL ".join(
    f"({_SECTION.format(*x)})"
    for x in [
        ("total", _NO, _NO, "TRUE", ""), ("matched", _NO, _NO, "knowledge_id > 0", ""), ("unparsed", _NO, _NO, "module = 'UNKNOWN' AND brief = 'UNPARSED'", ""), ("unassigned", _NO, _NO, "coalesce(device_id, 0) = 0", ""),
        ("severity", "CAST(severity AS STRING)", _NO, "TRUE", ""), ("tier", "match_tier", _NO, "TRUE", ""), ("module", "module", _NO, _EVENTS, " ORDER BY n DESC, key LIMIT 5"), ("hotspot", "module", "brief", f"{_EVENTS} AND coalesce(knowledge_id, 0) = 0", " ORDER BY n DESC, key, key2 LIMIT 10"),
    ]
)


@query("agg_summary_in_one_pass", f"{WITH}, t AS (SELECT *, {US} AS us FROM logs) {_SUMMARY}")
def agg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(L.logs(spark, sf_dir))


_HISTOGRAM = f"""{WITH}, t AS (SELECT {US} AS us, severity FROM logs WHERE "timestamp" IS NOT NULL), b AS (SELECT min(us) AS low, CAST(floor((max(us) - min(us)) / (1000000.0 * 60)) + 1 AS BIGINT) AS width FROM t),
c AS (SELECT least((us - low) // 1000000 // width, 59) AS bucket, count(*) AS total, count(*) FILTER (severity <= 2) AS severe, count(*) FILTER (severity IN (3, 4)) AS error, count(*) FILTER (severity = 5) AS warning, count(*) FILTER (severity > 5) AS info FROM t, b GROUP BY ALL)
SELECT CAST(r.bucket AS INT) AS bucket, low + r.bucket * width * 1000000 AS start_us, coalesce(total, 0) AS total, coalesce(severe, 0) AS severe, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info FROM b, (SELECT unnest(range(60)) AS bucket) r LEFT JOIN c ON c.bucket = r.bucket"""


@query("agg06_histogram", _HISTOGRAM)
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(L.logs(spark, sf_dir))


_SPARK = """, b AS (SELECT {low} AS low, greatest(({high} - {low}) / (24 * 1000000.0), 1.0) AS step FROM t),
c AS (SELECT least(23, greatest(0, CAST(floor((us - low) / 1000000.0 / step) AS BIGINT))) AS bucket, count(*) AS n FROM t, b {where} GROUP BY ALL),
f AS (SELECT CAST(r.bucket AS INT) AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS bucket) r LEFT JOIN c ON c.bucket = r.bucket)
SELECT bucket, n, n > 0 AND row_number() OVER (ORDER BY n DESC, bucket) = 1 AS is_peak FROM f"""
_T = f"{WITH}, t AS (SELECT {US} AS us FROM logs WHERE \"timestamp\" IS NOT NULL)"


@query("agg07_sparkline", _T + _SPARK.format(low="min(us)", high="max(us)", where=""))
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sparkline(L.logs(spark, sf_dir))


@query("agg07_sparkline_range", _T + _SPARK.format(low="min(1704412800000000)", high="min(1704672000000000)", where="WHERE us BETWEEN 1704412800000000 AND 1704672000000000"))
def agg07_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sparkline(L.logs(spark, sf_dir), low_us=1704412800000000, high_us=1704672000000000)


@query("agg08_folded", f"{WITH}, t AS (SELECT upper(module) AS module, brief, hostname, severity, id, {US} AS us FROM logs WHERE \"timestamp\" IS NOT NULL), o AS (SELECT min(us) AS origin FROM t) SELECT module, brief, hostname, (us - origin) // 3600000000 AS slot, count(*) AS n, min(us) AS first_us, max(us) AS last_us, min(severity) AS severity, min(id) AS sample_id FROM t, o GROUP BY ALL ORDER BY n DESC, sample_id LIMIT 200")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.folded(L.logs(spark, sf_dir), 3600)


@query("agg08_folded_5_minutes", f"{WITH}, t AS (SELECT upper(module) AS module, brief, hostname, severity, id, {US} AS us FROM logs WHERE \"timestamp\" IS NOT NULL), o AS (SELECT min(us) AS origin FROM t) SELECT module, brief, hostname, (us - origin) // 300000000 AS slot, count(*) AS n, min(us) AS first_us, max(us) AS last_us, min(severity) AS severity, min(id) AS sample_id FROM t, o GROUP BY ALL ORDER BY n DESC, sample_id LIMIT 200")
def agg08_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.folded(L.logs(spark, sf_dir))


@query("agg09_comments", f"{WITH} SELECT count(*) AS n FROM logs WHERE module = 'COMMENT'")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.logs(spark, sf_dir).where("module = 'COMMENT'").agg(F.count("*").alias("n"))


def _facet(field: str) -> None:
    @query(f"agg10_facet_{field}", f"{WITH} SELECT {field} AS value, count(*) AS n FROM logs WHERE {field} <> '' GROUP BY {field} ORDER BY n DESC, value LIMIT 20")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.facet(L.logs(spark, sf_dir), field)


for _f in A.FACETS:
    _facet(_f)

_SEV = ", ".join(f"count(*) FILTER (severity = {s}) AS severity_{s}" for s in range(9))


@query("agg11_device_reports", f"{WITH}, m AS (SELECT device_id, module, count(*) AS n FROM logs WHERE device_id > 0 AND {_EVENTS} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY n DESC, module) AS r FROM m), l AS (SELECT device_id, string_agg(module || '=' || n, ',' ORDER BY r) AS top_modules FROM r WHERE r <= 5 GROUP BY device_id) SELECT device_id, count(*) AS total, {_MATCHED} AS matched, min({US}) AS first_us, max({US}) AS last_us, {_SEV}, any_value(top_modules) AS top_modules FROM logs LEFT JOIN l USING (device_id) WHERE device_id > 0 GROUP BY device_id")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.device_reports(L.logs(spark, sf_dir))


@query("agg12_device_counts", f"{WITH} SELECT device_id, count(*) AS n, {_MATCHED} AS matched FROM logs GROUP BY device_id")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.device_counts(L.logs(spark, sf_dir))


@query("agg13_span", f"{WITH} SELECT count(*) AS total, min({US}) AS first_us, max({US}) AS last_us FROM logs WHERE device_id IN (1, 2)")
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.span(L.logs(spark, sf_dir), [1, 2])


@query("agg14_task_totals", f"{WITH} SELECT count(*) AS logs, {_MATCHED} AS matched, count(DISTINCT source_file) AS files, count(DISTINCT CASE WHEN device_id > 0 THEN device_id END) AS devices FROM logs")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.task_totals(L.logs(spark, sf_dir))


@query("agg15_lines_by_file", f"{WITH} SELECT source_file, count(*) AS n FROM logs GROUP BY source_file")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distribution(L.logs(spark, sf_dir), "source_file")


_DIGEST_HOSTS = "SELECT string_agg(hostname, ',' ORDER BY hostname) FROM (SELECT DISTINCT hostname FROM logs WHERE hostname <> '' ORDER BY hostname LIMIT 30)"


@query("agg18_digest", f"{WITH}, top AS ({_TOP}) SELECT 'task' AS task_id, ({_DIGEST_HOSTS}) AS hostnames, (SELECT string_agg(module, ',' ORDER BY n DESC, module) FROM top) AS top_modules")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.digest(L.logs(spark, sf_dir), "task").select("task_id", "hostnames", "top_modules")


_PER_FILE = f"SELECT source_file AS task_id, module, brief, count(*) AS n, max({US}) AS last_us FROM logs WHERE {_EVENTS} AND coalesce(knowledge_id, 0) = 0 GROUP BY ALL"


@query("agg19_global_hotspots", f"{WITH}, p AS ({_PER_FILE}) SELECT module, brief, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT task_id) AS tasks, max(last_us) AS last_us, array_to_string(list_sort(list(DISTINCT task_id))[1:5], ',') AS task_ids FROM p GROUP BY ALL ORDER BY n DESC, module, brief LIMIT 20")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir).where("module <> '' AND module <> 'COMMENT' AND coalesce(knowledge_id, 0) = 0")
    spots = own.groupBy(F.col("source_file").alias("task_id"), "module", "brief").agg(F.count("*").alias("count"), F.max(micros("timestamp")).alias("last_us"))
    digests = spots.groupBy("task_id").agg(F.to_json(F.collect_list(F.struct("module", "brief", "count", "last_us"))).alias("unmatched_json"), F.max("last_us").alias("updated"))
    return A.global_hotspots(digests)


@query("agg20_common_events", f"{WITH}, t AS (SELECT * FROM logs WHERE device_id > 0 AND module <> 'COMMENT' ORDER BY \"timestamp\" NULLS FIRST, id LIMIT 500) SELECT upper(module) || '/' || upper(brief) AS event, count(DISTINCT device_id) AS devices, count(*) AS n FROM t GROUP BY 1 HAVING count(DISTINCT device_id) >= 2")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.common_events(L.logs(spark, sf_dir), 4)


@query("agg21_critical", f"{WITH} SELECT count(*) FILTER (severity <= 3) AS critical FROM logs")
def agg21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.critical_total(L.logs(spark, sf_dir))


@query("agg22_preview", f"{WITH} SELECT source_file, count(*) AS lines, count(DISTINCT hostname) AS hosts, min({US}) AS first_us, max({US}) AS last_us, least(greatest(CAST(ceil(count(*) / 25000.0) AS BIGINT), 1), 600) AS eta_s FROM logs GROUP BY source_file")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    from syslumen.sources.raw import preview

    return preview(L.logs(spark, sf_dir))


@query("join01_tag_usage", f"{WITH} SELECT tag_id, name, count(log_id) AS logs FROM tags LEFT JOIN rel USING (tag_id) GROUP BY ALL")
def join01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.usage(L.tags(spark), L.relations(spark, sf_dir))


@query("join02_tags_of_page", f"{WITH}, p AS (SELECT id FROM logs ORDER BY id LIMIT 200), l AS (SELECT log_id AS id, string_agg(name, ';' ORDER BY tag_id) AS tags FROM rel JOIN tags USING (tag_id) GROUP BY log_id) SELECT id, coalesce(tags, '') AS tags FROM p LEFT JOIN l USING (id)")
def join02(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = L.logs(spark, sf_dir).orderBy("id").limit(200).select("id")
    return T.tags_of_logs(page, L.tags(spark), L.relations(spark, sf_dir)).select("id", F.array_join(F.transform("tags", lambda t: t["name"]), ";").alias("tags"))


@query("join04_semi_anti", f"{WITH} SELECT (SELECT count(*) FROM logs WHERE id IN (SELECT log_id FROM rel)) AS tagged, (SELECT count(*) FROM logs WHERE id NOT IN (SELECT log_id FROM rel)) AS untagged")
def join04(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, ids = L.logs(spark, sf_dir), L.relations(spark, sf_dir).select(F.col("log_id").alias("id"))
    return logs.join(ids, "id", "left_semi").agg(F.count("*").alias("tagged")).crossJoin(logs.join(ids, "id", "left_anti").agg(F.count("*").alias("untagged")))


@query("join09_device_names", f"{WITH} SELECT id, coalesce(nullif(device_name, ''), nullif(hostname, ''), 'device-' || device_id) AS device_name FROM (SELECT * FROM logs WHERE device_id > 0 ORDER BY \"timestamp\" NULLS FIRST, id LIMIT 500) LEFT JOIN devices USING (device_id)")
def join09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.timeline(L.logs(spark, sf_dir), L.devices(spark)).select("id", "device_name")


@query("join10_assign_devices", f"{WITH}, names AS (SELECT 'HOST-0' AS h, CAST(7 AS BIGINT) AS d) SELECT id, CASE WHEN coalesce(device_id, 0) = 0 THEN coalesce(d, 0) ELSE device_id END AS device_id FROM logs LEFT JOIN names ON trim(hostname) = h")
def join10(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.createDataFrame([(7, "HOST-0"), (9, "")], "device_id bigint, device_name string")
    return T.assign_devices(L.logs(spark, sf_dir), named).select("id", "device_id")




@query("join18_file_conflicts", "SELECT * FROM (VALUES ('[a]_x.log', '[a]_x_2.log', 'rename'), ('x.log', 'x_3.log', 'rename'), ('y.log', 'y.log', 'import')) AS t(name, stored_as, action)")
def join18(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([("[a]_x.log",), ("x.log",), ("y.log",)], "name string")
    return T.file_conflicts(new, spark.createDataFrame([("[dev]_x.log",)], "name string"), "rename")


@query("win01_align_times", f"{WITH}, t AS (SELECT id, source_file, {US} AS us FROM logs), g AS (SELECT *, last_value(us IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY id ROWS UNBOUNDED PRECEDING) AS before, first_value(us IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM t) SELECT id, coalesce(before, first) AS us FROM g")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.logs(spark, sf_dir).select("id", "source_file", "timestamp")
    return W.align_times(rows, seq="id").select("id", micros("timestamp").alias("us"))


_CLUSTERS = """, t AS (SELECT id, device_id, upper(module) AS module, epoch_us("timestamp") AS us FROM logs WHERE device_id > 0 AND "timestamp" IS NOT NULL AND module <> 'COMMENT' {limit}),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (ORDER BY us, id) <= {gap}000000 THEN 0 ELSE 1 END AS new FROM t), s AS (SELECT *, sum(new) OVER (ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS g FROM f),
m AS (SELECT g, module, min(struct_pack(us := us, id := id)) AS first FROM s GROUP BY ALL), l AS (SELECT g, string_agg(module, ',' ORDER BY first) AS modules FROM m GROUP BY g)
SELECT min(us) AS start_us, max(us) AS end_us, count(*) AS events, CAST(count(DISTINCT device_id) AS INT) AS devices, array_to_string(list_sort(list(DISTINCT device_id)), ',') AS device_ids, any_value(modules) AS modules FROM s JOIN l USING (g) GROUP BY g HAVING count(DISTINCT device_id) >= 2 OR count(*) >= 3"""


@query("win02_clusters", WITH + _CLUSTERS.format(gap=60, limit="ORDER BY us, id LIMIT 500"))
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.correlated_clusters(L.logs(spark, sf_dir))


@query("win02_clusters_all_rows", WITH + _CLUSTERS.format(gap=900, limit=""))
def win02_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.correlated_clusters(L.logs(spark, sf_dir), gap_s=900, timeline_limit=None)


_CHAIN = """WITH RECURSIVE t AS (SELECT DISTINCT epoch_us(ts) AS us FROM events WHERE event_id % 101 <> 0), c(w, s) AS (SELECT 0, min(us) FROM t UNION ALL SELECT w + 1, (SELECT min(us) FROM t WHERE us {cmp} c.s + {step}000000) FROM c WHERE c.s + 300000000 < (SELECT max(us) FROM t)) SELECT w AS "window", s AS start_us, s + 300000000 AS end_us FROM c"""


@query("win03_overlapping_windows", _CHAIN.format(cmp=">=", step=240))
def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir)
    return W.overlapping_windows(own.select(micros("timestamp").alias("us")))


@query("win04_tumbling_windows", _CHAIN.format(cmp=">", step=300))
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.logs(spark, sf_dir)
    return W.overlapping_windows(own.select(micros("timestamp").alias("us")), overlap_s=0)


@query("win09_recent_views", "WITH v AS (SELECT user_id, value AS viewed, CAST(event_id % 90 AS BIGINT) AS knowledge_id FROM events), l AS (SELECT user_id, knowledge_id, max(viewed) AS viewed FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY viewed DESC, knowledge_id) AS r FROM l) SELECT user_id, knowledge_id, viewed FROM r WHERE r <= 50")
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.recent(read(spark, sf_dir, "events").selectExpr("user_id", "event_id % 90 AS knowledge_id", "value AS viewed"))


@query("win11_device_colours", "SELECT * FROM (VALUES (CAST(10 AS BIGINT), 'HOST-0', 2)) AS t(device_id, device_name, color)")
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(3, "a"), (9, "b")], "device_id bigint, device_name string")
    return T.new_devices(L.logs(spark, sf_dir), known)


@query("dml02_delete_file", f"{WITH} SELECT (SELECT count(*) FROM logs WHERE source_file <> '[HOST-1]_f1.log') AS logs, (SELECT count(*) FROM rel WHERE log_id IN (SELECT id FROM logs WHERE source_file <> '[HOST-1]_f1.log')) AS relations")
def dml02(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, rel = T.delete_file(L.logs(spark, sf_dir), L.relations(spark, sf_dir), "[HOST-1]_f1.log")
    return left.agg(F.count("*").alias("logs")).crossJoin(rel.agg(F.count("*").alias("relations")))


@query("dml05_batch_tag", f"{WITH} SELECT DISTINCT tag_id, log_id FROM (SELECT * FROM rel UNION ALL SELECT 2, id FROM logs WHERE severity <= 2)")
def dml05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tag(L.relations(spark, sf_dir), L.logs(spark, sf_dir).where("severity <= 2"), 2)


@query("dml05_batch_untag", f"{WITH} SELECT * FROM rel WHERE NOT (tag_id = 1 AND log_id IN (SELECT id FROM logs WHERE severity <= 4))")
def dml05_untag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.untag(L.relations(spark, sf_dir), L.logs(spark, sf_dir).where("severity <= 4"), 1).select("tag_id", "log_id")


@query("dml06_tag_upsert", f"{WITH} SELECT * FROM tags WHERE tag_id <> 3 UNION ALL SELECT 3, 'quiet', 'black' UNION ALL SELECT 9, 'new', 'white'")
def dml06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.upsert(L.tags(spark), spark.createDataFrame([(3, "quiet", "black"), (9, "new", "white")], "tag_id bigint, name string, color string"), ["tag_id"])


@query("dml08_auto_assign_missing_hosts", "SELECT 'HOST-0' AS device_name")
def dml08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.new_devices(L.logs(spark, sf_dir), L.devices(spark)).select("device_name")


@query("tml04_findings", f"""{WITH}, k AS (SELECT CASE {" ".join(f"WHEN upper(module) IN ({', '.join(repr(m) for m in mods)}) THEN {i}" for i, (_, mods, _) in enumerate(TL.CAUSES))} END AS place, severity FROM logs) SELECT place, [{', '.join(repr(n) for n, _, _ in TL.CAUSES)}][place + 1] AS cause, count(*) AS n, min(severity) AS worst_severity FROM k WHERE place IS NOT NULL GROUP BY place""")
def tml04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.findings(L.logs(spark, sf_dir))


# Plain relational coverage on the star schema.
@query("cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("star_revenue_by_nation", "SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY ALL")
def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    joined = line.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
