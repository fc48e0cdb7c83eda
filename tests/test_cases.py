"""Literal cases of the scalar functions, whose queries run over whole tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from syslumen import queries
from syslumen.session import configure

queries.load()

from syslumen.query_text import CASES  # noqa: E402


@pytest.mark.parametrize("name", sorted(CASES))
def test_literal_cases(spark, name):
    rows, columns, make, want = CASES[name]
    names = [c.strip().split()[0] for c in columns.split(",")]
    got = configure(spark).createDataFrame(rows, columns).select(F.col(names[0]), make(*(F.col(n) for n in names)).alias("result")).collect()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("name", sorted(queries.LITERAL))
def test_literal_queries(spark, name):
    run, sql = queries.LITERAL[name]
    got = run(spark, "/no/such/folder")
    want = duckdb.connect().execute(sql)
    places = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r[k] for k in places)) for r in want.fetchall())
