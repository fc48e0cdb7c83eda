"""Queries of the log engine by name, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from syslumen.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Cases over a few literal rows, by the name of the query over whole tables that stands for them; tests run these.
LITERAL: dict[str, tuple[Query, str | None]] = {}
_WHOLE: set[str] = set()


def query(name: str, sql: str | None = None, whole: bool = False) -> Callable[[Query], Query]:
    """Registers a query and, if SQL can express it, its oracle; ``whole`` ones stand for those of their name over literal rows."""

    def keep(f: Query) -> Query:
        run = lambda spark, sf_dir: f(configure(spark), sf_dir)
        if name in _WHOLE and name not in LITERAL:
            LITERAL[name] = (run, sql)
            return f
        if name in QUERIES and not (whole and name not in _WHOLE):
            raise ValueError(f"{name} is there already")
        if whole:
            _WHOLE.add(name)
            if name in QUERIES:
                LITERAL[name] = (QUERIES[name], ORACLES.pop(name, None))
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from syslumen import query_columns, query_filters, query_lines  # noqa: F401, I001
    from syslumen import query_aggregates, query_knowledge, query_more, query_rest, query_services, query_text  # noqa: F401

    return QUERIES, ORACLES
