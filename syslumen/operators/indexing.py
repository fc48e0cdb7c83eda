"""The search index as published tables: built in folders of their own, then taken into use at once, or not at all.

An index is a list of parts in order: a base, additions and deletions. A document is what the last part that names it says, so that an
addition replaces what was there. What is in use is what the newest pointer names, a small file that only the first of several
writers can create; readers see the old list or the new one, and a build that fails changes nothing. Compaction makes one base of a
list while others go on adding to it. Going back is one more pointer.

A part holds the postings in blocks by token, the weightiest first, dealt to buckets of tokens that are partitions of the table.
Each block tells the greatest weight in it, so that no score by it can be more than a bound. A search reads
the buckets of its tokens only, and of their blocks those whose bound, with the best of the query's other tokens, reaches the k-th
best score that is certain; what it gives is what a look at all postings gives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syslumen import store
from syslumen.operators import search
from syslumen.session import broadcast_if_small

#: Grows with every change of what postings are made of; postings of other versions aren't read.
MAPPING_VERSION = 1
#: Postings for each partition of a part, and most of these; postings of a block; tokens of a search that are named to the scan.
PER_BUCKET, BUCKETS, BLOCK, NAMED = 2_000_000, 4096, 128, 1000

_POINTER = "seq bigint, folder string, mapping int, documents bigint, length bigint, parts array<struct<folder:string,kind:string,buckets:int>>"
BASE, ADDED, DELETED = "base", "added", "deleted"


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """All pointers so far; none if nothing was published."""
    return store.rows(spark, f"{root}/pointers", _POINTER)


def _newest(spark: SparkSession, root: str) -> dict | None:
    names = sorted(n for n, _ in store.names(spark, f"{root}/pointers") if n.endswith(".json"))
    found = spark.read.schema(_POINTER).json(f"{root}/pointers/{names[-1]}").head() if names else None
    return found.asDict(recursive=True) if found else None


def _point(spark: SparkSession, root: str, mapping: int, follow) -> dict:
    """Publishes the parts that ``follow`` makes of those in use; again if another writer was first."""
    while True:
        last = _newest(spark, root)
        parts = follow(last["parts"] if last else [])
        live = _documents(spark, root, parts).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).head()
        row = {"seq": (last["seq"] if last else 0) + 1, "folder": parts[0]["folder"] if parts else "", "mapping": mapping, "documents": live["n"], "length": int(live["length"]), "parts": parts}
        if store.put_if_absent(spark, f"{root}/pointers/{row['seq']:012d}.json", row):
            return row


def bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _weight(tf: Column, length: Column, mean: float) -> Column:
    """What a posting weighs in BM25 besides its token's rarity."""
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / mean))


def _write(root: str, postings: DataFrame, documents: DataFrame, kind: str) -> dict:
    """Writes a part: ``docs``, and if there are postings ``blocks`` and ``terms`` (else the part has no buckets)."""
    spark, folder = postings.sparkSession, f"{kind}-{uuid.uuid4().hex}"
    documents.write.parquet(f"{root}/{folder}/docs")
    if kind == DELETED:
        return {"folder": folder, "kind": kind, "buckets": 0}
    count = postings.count()
    if not count:
        return {"folder": folder, "kind": kind, "buckets": 0}
    buckets = max(1, min(BUCKETS, count // PER_BUCKET))
    made = spark.read.parquet(f"{root}/{folder}/docs").agg(F.avg("length").alias("mean")).head()["mean"] or 1.0
    # in order of token and weight over all partitions, so that a token of most documents is spread as well
    weighed = postings.select("token", "doc", "tf", "length", _weight(F.col("tf"), F.col("length"), made).alias("weight"))
    placed = weighed.repartitionByRange(F.col("token"), F.desc("weight"), F.col("doc")).sortWithinPartitions("token", F.desc("weight"), "doc").select("*", F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("range"))
    # blocks begin anew with each token, and where a token goes on in the next range
    nth = F.row_number().over(Window.partitionBy("token", "range").orderBy("place"))
    blocks = placed.withColumn("chunk", F.floor((nth - 1) / BLOCK)).groupBy("token", "range", "chunk").agg(
        F.min("place").alias("place"), F.count("*").alias("n"), F.max("weight").alias("most"),
        F.array_sort(F.collect_list(F.struct(F.col("place"), "doc", "tf", "length"))).alias("p"),
    )
    blocks = blocks.select(bucket(F.col("token"), buckets).alias("bucket"), "token", "place", "n", "most", F.transform("p", lambda x: F.struct(x["doc"].alias("doc"), x["tf"].alias("tf"), x["length"].alias("length"))).alias("postings"))
    blocks.repartitionByRange("bucket", "token", "place").sortWithinPartitions("bucket", "token", "place").write.partitionBy("bucket").parquet(f"{root}/{folder}/blocks")
    terms = spark.read.parquet(f"{root}/{folder}/blocks").groupBy("bucket", "token").agg(F.sum("n").alias("df"), F.min_by("postings", "place").alias("best"))
    terms.repartitionByRange("bucket", "token").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{root}/{folder}/terms")
    return {"folder": folder, "kind": kind, "buckets": buckets}


def _indexed(docs: DataFrame, key: str, *fields: str) -> tuple[DataFrame, DataFrame]:
    """Postings of documents, and each document with its number of tokens."""
    made = search.index(docs, key, *fields)
    return made, made.groupBy("doc").agg(F.max("length").alias("length"))


def rebuild(root: str, docs: DataFrame, key: str, *fields: str, mapping: int = MAPPING_VERSION) -> str:
    """Builds the whole index of ``docs`` in a new folder under ``root``, looks it over and takes it into use; gives the folder.

    The number of documents with tokens must be that of the source, else an error is raised and the index in use stays.
    """
    spark = docs.sparkSession
    part = _write(root, *_indexed(docs, key, *fields), BASE)
    made = spark.read.parquet(f"{root}/{part['folder']}/docs").count()
    text = F.concat_ws("\n", *(F.col(f) for f in fields))
    asked = docs.where((F.size(search.tokens(text)) > 0) & F.col(key).isNotNull()).select(key).distinct().count()
    if made < asked:
        raise ValueError(f"{made} of {asked} documents are in the new index; the old one stays")
    _point(spark, root, mapping, lambda parts: [part])
    return part["folder"]


def _mapping(spark: SparkSession, root: str) -> int:
    last = _newest(spark, root)
    if not last:
        raise ValueError(f"no index was published under {root}")
    return last["mapping"]


def add(root: str, docs: DataFrame, key: str, *fields: str) -> str:
    """Adds documents, or replaces those of the same key; gives the folder of the part."""
    spark = docs.sparkSession
    mapping = _mapping(spark, root)
    postings, _ = _indexed(docs, key, *fields)
    # what has no token now replaces as well
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.size(search.tokens(F.concat_ws("\n", *(F.col(f) for f in fields)))).alias("length"))
    part = _write(root, postings, named.groupBy("doc").agg(F.max("length").alias("length")), ADDED)
    _point(spark, root, mapping, lambda parts: [*parts, part])
    return part["folder"]


def delete(root: str, ids: DataFrame) -> str:
    """Takes the documents named in the first column of ``ids`` out; gives the folder of the part."""
    spark = ids.sparkSession
    mapping = _mapping(spark, root)
    gone = ids.select(F.col(ids.columns[0]).alias("doc"), F.lit(0).alias("length")).distinct()
    part = _write(root, gone, gone, DELETED)
    _point(spark, root, mapping, lambda parts: [*parts, part])
    return part["folder"]


def compact(spark: SparkSession, root: str) -> str:
    """Makes one base of all parts in use now; parts that others add meanwhile stay after it. Gives the folder."""
    last = _newest(spark, root)
    before = last["parts"] if last else []
    postings, documents = _postings(spark, root, before), _documents(spark, root, before)
    part = _write(root, postings, documents, BASE)

    def follow(parts: list[dict]) -> list[dict]:
        if parts[: len(before)] != before:
            raise ValueError("the index was rebuilt or compacted meanwhile")
        return [part, *parts[len(before) :]]

    _point(spark, root, _mapping(spark, root), follow)
    return part["folder"]


def _later(spark: SparkSession, root: str, parts: list[dict]) -> DataFrame | None:
    """The documents that parts name."""
    out = None
    for p in parts:
        own = spark.read.parquet(f"{root}/{p['folder']}/docs").select("doc")
        out = own if out is None else out.unionByName(own)
    return out.distinct() if out is not None else None


def _live(spark: SparkSession, root: str, parts: list[dict], what) -> DataFrame | None:
    """The union of what parts hold without the documents that later ones name."""
    out = None
    for k, p in enumerate(parts):
        own = what(p) if p["kind"] != DELETED else None
        if own is not None:
            later = _later(spark, root, parts[k + 1 :])
            own = own if later is None else own.join(broadcast_if_small(later), "doc", "left_anti")
            out = own if out is None else out.unionByName(own)
    return out


def _documents(spark: SparkSession, root: str, parts: list[dict]) -> DataFrame:
    """``doc, length`` of the documents in use that have tokens."""
    found = _live(spark, root, parts, lambda p: spark.read.parquet(f"{root}/{p['folder']}/docs"))
    return found.where("length > 0") if found is not None else spark.createDataFrame([], "doc bigint, length int")


def _postings(spark: SparkSession, root: str, parts: list[dict], pick=lambda blocks, _: blocks) -> DataFrame:
    """``doc, token, length, tf`` of the documents in use; ``pick`` chooses among the blocks of a part."""

    def each(p: dict) -> DataFrame | None:
        if not p["buckets"]:
            return None
        blocks = pick(spark.read.parquet(f"{root}/{p['folder']}/blocks"), p["buckets"])
        return blocks.select("token", F.explode("postings").alias("x")).select("x.doc", "token", "x.length", "x.tf")

    found = _live(spark, root, parts, each)
    return found if found is not None else spark.createDataFrame([], "doc bigint, token string, length int, tf bigint")


def current(spark: SparkSession, root: str, mapping: int = MAPPING_VERSION) -> DataFrame:
    """The postings in use, ``doc, token, length, tf``; those of another mapping version are left out."""
    last = _newest(spark, root)
    if not last:
        raise ValueError(f"no index was published under {root}")
    found = _postings(spark, root, last["parts"])
    return found if last["mapping"] == mapping else found.limit(0)


def is_stale(spark: SparkSession, root: str, mapping: int = MAPPING_VERSION) -> bool:
    """Whether the index in use is missing or of another mapping version, so that it should be rebuilt."""
    last = _newest(spark, root)
    return not last or last["mapping"] != mapping


def roll_back(spark: SparkSession, root: str) -> str:
    """Takes the index before that in use into use again; gives the folder of its first part."""
    last = _newest(spark, root)
    older = last and pointers(spark, root).where(F.col("seq") < last["seq"]).orderBy(F.desc("seq")).collect()
    parts = next((r.asDict(recursive=True) for r in older or [] if r.asDict(recursive=True)["parts"] != last["parts"]), None)
    if not parts:
        raise ValueError("no index to go back to")
    _point(spark, root, parts["mapping"], lambda _: parts["parts"])
    return parts["parts"][0]["folder"]


def _pick(asked: DataFrame):
    """A choice of the buckets and, if they are few, the tokens that are asked for, as literals that a scan is pruned by."""
    named = [r["token"] for r in asked.select("token").distinct().limit(NAMED + 1).collect()]

    def pick(table: DataFrame, buckets: int) -> DataFrame:
        # as many rows as there are buckets at most
        wanted = [r["b"] for r in asked.select(bucket(F.col("token"), buckets).alias("b")).distinct().collect()]
        own = table.where(F.col("bucket").isin(wanted))
        return own.where(F.col("token").isin(named)) if len(named) <= NAMED else own

    return pick


def find(spark: SparkSession, root: str, queries: DataFrame, k: int | None = 10, mapping: int = MAPPING_VERSION) -> DataFrame:
    """``query, doc, score, hits``: for rows ``query, text`` the ``k`` best documents of the index in use by BM25, ties to the smaller
    document (all with a common token if k is None)."""
    last = _newest(spark, root)
    if not last:
        raise ValueError(f"no index was published under {root}")
    asked = queries.select("query", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("token")).distinct()
    pick = _pick(asked)
    n, mean = last["documents"], (last["length"] / last["documents"]) if last["documents"] else 1.0
    if last["mapping"] != mapping or k is None or [p["kind"] for p in last["parts"]] != [BASE] or not last["parts"][0]["buckets"]:
        postings = _postings(spark, root, last["parts"] if last["mapping"] == mapping else [], pick)
        return search.scores(postings, queries, k, counts=(n, mean))
    folder, buckets = f"{root}/{last['folder']}", last["parts"][0]["buckets"]
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = pick(spark.read.parquet(f"{folder}/terms"), buckets).join(broadcast_if_small(asked), "token")
    weights = F.sort_array(F.transform("best", lambda x: _weight(x["tf"], x["length"], mean)), asc=False)
    told = terms.select("query", "bucket", "token", idf.alias("idf"), weights.alias("w")).select("query", "bucket", "token", "idf", (F.col("idf") * F.get("w", F.lit(0))).alias("top"), F.coalesce(F.col("idf") * F.get("w", F.lit(k - 1)), F.lit(0.0)).alias("sure"))
    # k documents of one token are sure to have its k-th best weight; no document has more than the sum of the best
    bounds = told.groupBy("query").agg(F.max("sure").alias("sure"), F.sum("top").alias("sum"))
    told = told.drop("sure").join(bounds, "query").select("query", "bucket", "token", "idf", (F.col("sure") * (1 - 1e-9) - F.col("sum") + F.col("top")).alias("least"))
    blocks = pick(spark.read.parquet(f"{folder}/blocks"), buckets).join(broadcast_if_small(told), ["bucket", "token"])
    kept = blocks.where(F.col("idf") * F.col("most") >= F.col("least"))
    part = F.col("idf") * _weight(F.col("x.tf"), F.col("x.length"), mean)
    found = kept.select("query", "idf", F.explode("postings").alias("x")).groupBy("query", F.col("x.doc").alias("doc")).agg(F.sum(part).alias("score"), F.count("*").alias("hits"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
