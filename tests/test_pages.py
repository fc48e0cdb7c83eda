"""Pages are parsed a few at a time."""

from __future__ import annotations

import pyarrow as pa

from syslumen.sources import package


def test_a_large_batch_is_handed_on_in_small_ones(spark):
    html = [None if k == 3 else f"<title>T{k}</title><p>x</p>" for k in range(1000)]
    out = list(package.parsed(iter([pa.RecordBatch.from_pydict({"key": list(range(1000)), "html": html})])))
    assert max(b.num_rows for b in out) <= package.PAGES
    want = {k: "" if h is None else f"T{k}" for k, h in enumerate(html)}
    assert {k: t for b in out for k, t in zip(b["key"].to_pylist(), b["title"].to_pylist(), strict=True)} == want
    found = package.parse_pages(spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string"))
    assert {r["page_id"]: r["title"] for r in found.collect()} == want
