"""One function for each request that the engine answers; requests are dictionaries, answers DataFrames or text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.operators import aggregates as A
from syslumen.operators import cases, enrich, matching, rca, search, tags, timeline
from syslumen.plans import filters as P
from syslumen.sinks import export
from syslumen.sources import files, package, raw


class Engine:
    """The tables of one installation: logs of tasks, knowledge with its mappings, and what users add."""

    def __init__(self, spark: SparkSession, logs: DataFrame, **tables: DataFrame):
        self.spark, self.logs, self.tables = spark, logs, tables

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"the engine has no table {name!r}")
        return self.tables[name]

    def _filtered(self, request: dict[str, Any]) -> DataFrame:
        return P.apply(self.logs, P.LogFilter.of(request), self.tables.get("relations"))

    # imports
    def import_preview(self, paths: list[str], **options: Any) -> DataFrame:
        return raw.preview(raw.parse(raw.clean_lines(raw.read_lines(self.spark, paths)), with_parameters=False, **options))

    def import_logs(self, paths: list[str], task_id: str, out: str | None = None, **options: Any) -> DataFrame:
        """Lines to matched records, times aligned within files; with ``out`` they are written as well. Doing it again gives the same."""
        from syslumen.operators.windows import align_times

        parsed = align_times(raw.numbered(raw.parse(raw.clean_lines(raw.read_lines(self.spark, paths)), **options)))
        named = tags.assign_devices(parsed.withColumn("device_id", F.lit(0).cast("bigint")), self.table("devices"))
        known = matching.prepare(self.table("knowledge"), self.table("mappings"))
        made = matching.match(matching.with_context(named, self.table("devices")), known, self.tables.get("overrides")).withColumn("task_id", F.lit(task_id))
        if out:
            export.write_logs(made, out)
        return made

    reanalyse = import_logs

    def import_documents(self, paths: list[str]) -> DataFrame:
        return package.knowledge_of(package.read_archives(self.spark, paths))

    def scan_documents(self, paths: list[str]) -> DataFrame:
        return files.scan_packages(self.spark, paths, self.table("documents"))

    # logs
    def query_logs(self, request: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
        """The page asked for, enriched and tagged, and the total beside it."""
        own = self._filtered(request)
        page = P.page(own, request.get("page", 1), request.get("page_size", 50), request.get("sort_by", "timestamp"), request.get("order", "asc"), request.get("after_id", 0))
        if "knowledge" in self.tables:
            page = enrich.with_knowledge(page, self.table("knowledge"), self.tables.get("documents"))
        if "relations" in self.tables:
            page = tags.tags_of_logs(page, self.table("tags"), self.table("relations"))
        return page, own.agg(F.count("*").alias("total"))

    def histogram(self, request: dict[str, Any]) -> DataFrame:
        return A.histogram(self._filtered(request), request.get("buckets", 60))

    def sparkline(self, request: dict[str, Any]) -> DataFrame:
        return A.sparkline(self._filtered(request))

    def aggregated(self, request: dict[str, Any]) -> DataFrame:
        return A.folded(self._filtered(request), request.get("window_seconds", 300), request.get("limit", 200))

    def facets(self, field: str, request: dict[str, Any] | None = None) -> DataFrame:
        return A.facet(self._filtered(request or {}), field)

    def modules(self) -> DataFrame:
        return self.logs.where("module <> ''").select(F.upper("module").alias("module")).distinct().orderBy("module")

    def comment_count(self) -> DataFrame:
        return self.logs.where("module = 'COMMENT'").agg(F.count("*").alias("n"))

    def summary(self) -> DataFrame:
        return A.summary(self.logs)

    def summary_markdown(self, title: str) -> str:
        return timeline.summary_markdown(self.logs, title)

    # tags
    def tag_logs(self, tag_id: int, request: dict[str, Any]) -> DataFrame:
        self.tables["relations"] = tags.tag(self.table("relations"), self._filtered(request), tag_id)
        return self.tables["relations"]

    def untag_logs(self, tag_id: int, request: dict[str, Any]) -> DataFrame:
        self.tables["relations"] = tags.untag(self.table("relations"), self._filtered(request), tag_id)
        return self.tables["relations"]

    def tag_usage(self) -> DataFrame:
        return tags.usage(self.table("tags"), self.table("relations"))

    # devices
    def device_logs(self, **restrictions: Any) -> DataFrame:
        return P.order(timeline.multi_device_logs(self.logs, **restrictions))

    def device_timeline(self, **restrictions: Any) -> DataFrame:
        return timeline.timeline(self.logs, self.table("devices"), **restrictions)

    def device_report(self, device_ids: list[int]) -> dict[str, DataFrame]:
        return timeline.report(self.logs, device_ids)

    def device_conclusion(self, device_ids: list[int]) -> str:
        return timeline.conclusion(self.logs, device_ids)

    def auto_assign(self) -> DataFrame:
        new = tags.new_devices(self.logs, self.table("devices"))
        known = self.table("devices").select("device_id", "device_name").unionByName(new.select("device_id", "device_name"))
        return tags.assign_devices(self.logs, known)

    # root causes
    def analyse(self, rules: list[rca.Edge] | None = None) -> DataFrame:
        return rca.enriched(rca.analyse(rca.sample(self.logs), rules), self.logs, self.table("devices"))

    # knowledge
    def search(self, **request: Any) -> DataFrame:
        return search.search(self.table("knowledge"), **request)

    def knowledge_facets(self, **request: Any) -> DataFrame:
        return A.knowledge_facets(self.table("knowledge"), self.table("mappings"), **request)

    def import_local(self, path: str) -> tuple[DataFrame, DataFrame]:
        return cases.read_local_csv(self.spark, path)

    def delete_document(self, document_id: int) -> DataFrame:
        gone = tags.orphans(self.table("knowledge"), self.table("mappings"), document_id)
        self.tables["knowledge"] = tags.delete(self.table("knowledge"), gone, ["id"])
        self.tables["mappings"] = self.table("mappings").where(F.col("document_id") != document_id)
        return self.tables["knowledge"]

    # cases and exports
    def query_cases(self, **request: Any) -> DataFrame:
        return cases.query_cases(self.table("tasks"), self.table("digests"), **request)

    def dashboard(self) -> DataFrame:
        return A.dashboard(self.logs, self.table("knowledge"))

    def export(self, kind: str, request: dict[str, Any] | None = None, title: str = "Logs") -> Any:
        own = self._filtered(request or {})
        if kind not in ("csv", "json", "html", "package"):
            raise P.FilterError(f"no export as {kind!r}")
        return {"csv": export.csv_text, "json": export.json_lines, "html": lambda x: export.html_report(x, title), "package": lambda x: export.evidence(x, title)}[kind](own)
