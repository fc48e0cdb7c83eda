"""Aggregations over logs: overview, distributions, histograms, folded repeats, facets, device reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syslumen.session import micros

FACETS = ("module", "brief", "hostname", "source_file")
_SECOND = 1_000_000


def rate(part: Column, whole: Column) -> Column:
    """Per cent with one decimal, halves rounded up; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * F.lit(100.0) / whole * 10 + 0.5) / 10)


def overview(logs: DataFrame) -> DataFrame:
    """One row: totals, matched, unparsed and unassigned rows, time span, rates."""
    is_ = lambda c: F.count(F.when(c, 1))
    made = logs.agg(
        F.count("*").alias("total"),
        is_(F.col("knowledge_id") > 0).alias("matched"),
        is_((F.col("module") == "UNKNOWN") & (F.col("brief") == "UNPARSED")).alias("unparsed"),
        is_(F.coalesce(F.col("device_id"), F.lit(0)) == 0).alias("unassigned"),
        F.min(micros("timestamp")).alias("first_us"),
        F.max(micros("timestamp")).alias("last_us"),
    )
    return made.withColumns({"match_rate": rate(F.col("matched"), F.col("total")), "parse_rate": rate(F.col("total") - F.col("unparsed"), F.col("total"))})


def distribution(logs: DataFrame, column: str) -> DataFrame:
    return logs.groupBy(column).agg(F.count("*").alias("n"))


def _events(logs: DataFrame) -> DataFrame:
    return logs.where("module <> '' AND module <> 'COMMENT'")


def top_modules(logs: DataFrame, k: int = 5) -> DataFrame:
    """Modules with the most rows; ``max_severity`` is the largest number, ``worst_severity`` the smallest."""
    made = _events(logs).groupBy("module").agg(F.count("*").alias("n"), F.max("severity").alias("max_severity"), F.min("severity").alias("worst_severity"), F.min("id").alias("sample_id"))
    return made.orderBy(F.desc("n"), "module").limit(k)


def unmatched_hotspots(logs: DataFrame, k: int = 10) -> DataFrame:
    """Events without knowledge that occur the most."""
    own = _events(logs).where("coalesce(knowledge_id, 0) = 0")
    us = micros("timestamp")
    made = own.groupBy("module", "brief").agg(F.count("*").alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.min("id").alias("sample_id"))
    return made.orderBy(F.desc("n"), "module", "brief").limit(k)


def histogram(logs: DataFrame, buckets: int = 60) -> DataFrame:
    """Rows by bucket of time and kind of severity; empty buckets are there. Bucket width: the span over the buckets, and a second."""
    buckets = max(1, min(buckets or 60, 240))
    own = logs.where("timestamp IS NOT NULL").select(micros("timestamp").alias("us"), "severity")
    span = own.agg(F.min("us").alias("low"), F.max("us").alias("high")).where("low IS NOT NULL")
    span = span.select("low", (F.floor((F.col("high") - F.col("low")) / (_SECOND * buckets)) + 1).cast("bigint").alias("width"))
    at = F.least(F.floor(F.floor((F.col("us") - F.col("low")) / _SECOND) / F.col("width")), F.lit(buckets - 1)).cast("int")
    is_ = lambda c: F.sum(F.when(c, 1).otherwise(0))
    # one row of bounds meets every log row: a broadcast, not a product
    counted = own.crossJoin(F.broadcast(span)).groupBy(at.alias("bucket")).agg(
        F.count("*").alias("total"),
        is_(F.col("severity") <= 2).alias("severe"),
        is_((F.col("severity") > 2) & (F.col("severity") <= 4)).alias("error"),
        is_(F.col("severity") == 5).alias("warning"),
        is_(F.col("severity") > 5).alias("info"),
    )
    all_ = span.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "low", "width")
    filled = all_.join(counted, "bucket", "left").fillna(0, ["total", "severe", "error", "warning", "info"])
    return filled.select("bucket", (F.col("low") + F.col("bucket") * F.col("width") * _SECOND).alias("start_us"), "total", "severe", "error", "warning", "info")


def sparkline(logs: DataFrame, buckets: int = 24, low_us: int | None = None, high_us: int | None = None) -> DataFrame:
    """Rows by fractional step of time, with the first largest bucket marked. An explicit range needs no scan for bounds."""
    own = logs.where("timestamp IS NOT NULL").select(micros("timestamp").alias("us"))
    if low_us is not None and high_us is not None:
        own = own.where(F.col("us").between(low_us, high_us))
        span = own.sparkSession.range(1).select(F.lit(low_us).cast("bigint").alias("low"), F.lit(high_us).cast("bigint").alias("high"))
    else:
        span = own.agg(F.min("us").alias("low"), F.max("us").alias("high")).where("low IS NOT NULL")
    span = span.select("low", F.greatest((F.col("high") - F.col("low")) / F.lit(float(buckets * _SECOND)), F.lit(1.0)).alias("step"))
    at = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((F.col("us") - F.col("low")) / _SECOND / F.col("step")))).cast("int")
    counted = own.crossJoin(F.broadcast(span)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    filled = span.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).join(counted, "bucket", "left").fillna(0, ["n"])
    # the window is over the fixed number of buckets
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "bucket")
    return filled.withColumn("is_peak", (F.row_number().over(best) == 1) & (F.col("n") > 0))


def folded(logs: DataFrame, window_s: int = 300, k: int = 200) -> DataFrame:
    """Repeats of an event on a host within windows that count from the first time."""
    window_s, k = max(5, min(window_s or 300, 3600)), min(k or 200, 500)
    own = logs.where("timestamp IS NOT NULL").select(F.upper("module").alias("module"), "brief", "hostname", "severity", "id", micros("timestamp").alias("us"))
    origin = own.agg(F.min("us").alias("origin"))
    at = F.floor((F.col("us") - F.col("origin")) / (_SECOND * window_s)).cast("bigint")
    made = own.crossJoin(F.broadcast(origin)).groupBy("module", "brief", "hostname", at.alias("slot")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min("severity").alias("severity"), F.min("id").alias("sample_id"))
    return made.orderBy(F.desc("n"), "sample_id").limit(k)


def facet(logs: DataFrame, field: str, k: int = 20) -> DataFrame:
    if field not in FACETS:
        raise ValueError(f"no facet {field!r}")
    made = logs.where(F.col(field) != "").groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    return made.orderBy(F.desc("n"), "value").limit(k)


def device_reports(logs: DataFrame, k: int = 5) -> DataFrame:
    """Of every device: totals, span, rows by severity and its top modules, both as JSON, in two aggregations."""
    us = micros("timestamp")
    per = logs.where("device_id > 0").groupBy("device_id")
    total = per.agg(F.count("*").alias("total"), F.count(F.when(F.col("knowledge_id") > 0, 1)).alias("matched"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), *(F.count(F.when(F.col("severity") == s, 1)).alias(f"severity_{s}") for s in range(9)))
    modules = logs.where("device_id > 0 AND module <> '' AND module <> 'COMMENT'").groupBy("device_id", "module").agg(F.count("*").alias("n"))
    # the window is over one row for each device and module
    ranked = modules.withColumn("r", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("n"), "module"))).where(F.col("r") <= k)
    listed = ranked.groupBy("device_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "module", "n"))), lambda m: F.concat(m["module"], F.lit("="), m["n"].cast("string"))), ",").alias("top_modules"))
    return total.join(listed, "device_id", "left")


def device_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("device_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("knowledge_id") > 0, 1)).alias("matched"))


def span(logs: DataFrame, device_ids: list[int]) -> DataFrame:
    us = micros("timestamp")
    return logs.where(F.col("device_id").isin(*device_ids)).agg(F.count("*").alias("total"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def task_totals(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count("*").alias("logs"), F.count(F.when(F.col("knowledge_id") > 0, 1)).alias("matched"), F.countDistinct("source_file").alias("files"), F.countDistinct(F.when(F.col("device_id") > 0, F.col("device_id"))).alias("devices"))


def common_events(logs: DataFrame, devices: int, limit: int | None = 500) -> DataFrame:
    """Events seen on two devices or more (on one, if there's but one), over the first rows of the timeline."""
    own = logs.where("device_id > 0 AND module <> 'COMMENT'")
    if limit is not None:
        own = own.orderBy(F.asc_nulls_first("timestamp"), "id").limit(limit)
    made = own.groupBy(F.concat_ws("/", F.upper("module"), F.upper("brief")).alias("event")).agg(F.countDistinct("device_id").alias("devices"), F.count("*").alias("n"))
    return made.where(F.col("devices") >= (1 if devices == 1 else 2))


def critical_total(logs: DataFrame) -> DataFrame:
    return logs.agg(F.sum(F.when(F.col("severity") <= 3, 1).otherwise(0)).alias("critical"))


def digest(logs: DataFrame, task_id: str) -> DataFrame:
    """One row for a task: hosts and modules as lists, hot-spots as JSON."""
    hosts = logs.where("hostname <> ''").select("hostname").distinct().orderBy("hostname").limit(30).agg(F.array_join(F.array_sort(F.collect_list("hostname")), ",").alias("hostnames"))
    modules = top_modules(logs).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "module"))), lambda m: m["module"]), ",").alias("top_modules"))
    spots = unmatched_hotspots(logs).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "module", "brief", "n", "last_us"))), lambda s: F.struct(s["module"].alias("module"), s["brief"].alias("brief"), s["n"].alias("count"), s["last_us"].alias("last_us")))).alias("unmatched_json"))
    # three rows of one each
    return hosts.crossJoin(modules).crossJoin(spots).withColumn("task_id", F.lit(task_id))


def global_hotspots(digests: DataFrame, k: int = 20, latest: int = 200) -> DataFrame:
    """Hot-spots over the latest digests (``task_id, updated, unmatched_json``)."""
    form = "array<struct<module:string,brief:string,count:bigint,last_us:bigint>>"
    rows = digests.orderBy(F.desc("updated"), "task_id").limit(latest).select("task_id", F.explode(F.from_json("unmatched_json", form)).alias("s")).select("task_id", "s.*")
    made = rows.groupBy("module", "brief").agg(F.sum("count").alias("n"), F.countDistinct("task_id").alias("tasks"), F.max("last_us").alias("last_us"), F.array_join(F.slice(F.array_sort(F.collect_set("task_id")), 1, 5), ",").alias("task_ids"))
    return made.orderBy(F.desc("n"), "module", "brief").limit(min(k, 100))


def dashboard(logs: DataFrame, knowledge: DataFrame) -> DataFrame:
    totals = logs.agg(F.count("*").alias("logs"), F.countDistinct("source_file").alias("files"))
    return totals.crossJoin(knowledge.agg(F.count("*").alias("knowledge"), F.countDistinct("module").alias("modules")))


def knowledge_facets(knowledge: DataFrame, versions: DataFrame, module: str = "", entry_type: str = "") -> DataFrame:
    """``kind, value, n``: severities, entry types, products (distinct entries) and versions."""
    own = knowledge
    if module:
        own = own.where(F.upper("module") == module.upper())
    if entry_type:
        own = own.where(F.upper("entry_type") == entry_type.upper())
    plain = lambda c: own.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "value", "n")
    mapped = versions.join(own.select(F.col("id").alias("knowledge_id")), "knowledge_id", "left_semi").where("product_type <> ''")
    product = mapped.groupBy(F.col("product_type").alias("value")).agg(F.countDistinct("knowledge_id").alias("n")).orderBy(F.desc("n"), "value").limit(30)
    version = mapped.where("product_version <> ''").groupBy(F.col("product_version").alias("value")).agg(F.countDistinct("knowledge_id").alias("n")).orderBy(F.desc("n"), "value").limit(50)
    return plain("severity").union(plain("entry_type")).union(product.select(F.lit("product").alias("kind"), "value", "n")).union(version.select(F.lit("version").alias("kind"), "value", "n"))


def summary(logs: DataFrame) -> DataFrame:
    """The whole diagnosis summary from one pass over the logs: ``section, key, key2, n, first_us, last_us, low, high, sample_id``.

    Sections are total, matched, unparsed, unassigned, severity, tier, module (5) and hotspot (10). The logs are
    grouped once by all that sections need, which leaves few rows; sections are grouping sets of those.
    """
    us = micros("timestamp")
    kind = F.when(F.coalesce(F.col("knowledge_id"), F.lit(0)) > 0, True).otherwise(False)
    small = logs.groupBy("module", "brief", "severity", "match_tier", kind.alias("matched"), (F.coalesce(F.col("device_id"), F.lit(0)) == 0).alias("unassigned")).agg(F.count("*").alias("n"), F.min(us).alias("a"), F.max(us).alias("b"), F.min("id").alias("sample_id"))
    event = F.col("module").isNotNull() & (F.col("module") != "") & (F.col("module") != "COMMENT")
    own = lambda s, key, key2=None: F.struct(F.lit(s).alias("section"), key.cast("string").alias("key"), (key2 if key2 is not None else F.lit(None)).cast("string").alias("key2"))
    nothing = F.lit(None)
    parts = F.array(
        own("total", nothing), F.when(F.col("matched"), own("matched", nothing)), F.when((F.col("module") == "UNKNOWN") & (F.col("brief") == "UNPARSED"), own("unparsed", nothing)), F.when(F.col("unassigned"), own("unassigned", nothing)),
        own("severity", F.col("severity")), own("tier", F.col("match_tier")), F.when(event, own("module", F.col("module"))), F.when(event & ~F.col("matched"), own("hotspot", F.col("module"), F.col("brief"))),
    )
    rows = small.select(F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"), "n", "a", "b", "severity", "sample_id")
    made = rows.groupBy("p.section", "p.key", "p.key2").agg(F.sum("n").alias("n"), F.min("a").alias("first_us"), F.max("b").alias("last_us"), F.min("severity").alias("low"), F.max("severity").alias("high"), F.min("sample_id").alias("sample_id"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "key", "key2"))
    most = F.when(F.col("section") == "module", 5).when(F.col("section") == "hotspot", 10).otherwise(1 << 30)
    return made.withColumn("place", place).where(F.col("place") <= most).drop("place")
