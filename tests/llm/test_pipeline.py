import hashlib
import random

import pytest
import test_linededup
import test_simhash

import corpus_pipeline as cp

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    shared, item = line(12), line(20)
    rows = []
    for k in range(240):
        text = "\n".join(line(rng.randrange(6, 20)) for _ in range(rng.randrange(1, 5)))
        if k % 4 == 0:
            text = " ".join([rng.choice(["zz", "qq"])] * 80) + "$$$ %%%"
        elif k % 11 == 0:
            text += "\n" + shared
        elif k % 23 == 0:
            text += " " + item
        elif k % 17 == 0:
            text = rows[1][1]
        rows.append((k, text, "en", "src", len(text)))
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(240)], LABELS).write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = cp.keep_quality(spark, docs, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    # good documents stay, nearly all bad ones go
    assert {k for k in range(240) if k % 4} <= set(texts) and len(texts) <= 185
    gone = test_linededup.brute(sorted((k, t.split("\n")) for k, t in texts.items()), 8)
    texts = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in texts.items()}
    lines = cp.dedup_lines(spark, kept, sf_dir)
    assert lines.columns == columns and {r["doc_id"]: r["text"] for r in lines.collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    ids = sorted(texts)
    root = test_simhash.linked([test_simhash.plain(texts[k]) for k in ids])
    texts = {k: texts[k] for i, k in enumerate(ids) if root[i] == i}
    near = cp.drop_near_duplicates(spark, lines, sf_dir)
    assert near.columns == columns and {r["doc_id"] for r in near.collect()} == set(texts)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").head()["text"].rstrip(".")
    clean = cp.drop_leaks(spark, near, sf_dir)
    texts = {k: t for k, t in texts.items() if item not in t}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == set(texts)
    coded = cp.encode(spark, clean, sf_dir)
    assert {r["doc_id"]: r["decoded_sha256"] for r in coded.collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}
    assert {r["doc_id"] for r in cp.run(spark, sf_dir).collect()} == set(texts)


def test_an_empty_corpus_passes(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
