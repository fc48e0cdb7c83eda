"""Matching logs against knowledge in tiers.

Logs repeat, so tiers run over distinct signatures (module, brief, product, version, what the body says of
its medium; for tiers that read the body, the body and severity too) and their results are joined back.
The bodies of a common signature are dealt over many tasks, each of which gets the signature's answers.
Knowledge is a dimension: it is broadcast where its counted size allows, else joined by shuffle. Each tier
sees only what the tiers before it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syslumen.functions import scalar as S
from syslumen.operators import search
from syslumen.session import broadcast_if_small

# Suffixes that tell a state from its event, those that contradict each other, confidences.
SUFFIXES = ("_INACTIVE", "_ACTIVE", "_RESUME", "_CLEAR", "_ERROR", "_FAIL", "_DOWN", "_UP")
GOOD, BAD = ("_RESUME", "_CLEAR", "_UP", "_INACTIVE"), ("_ACTIVE", "_ERROR", "_FAIL", "_DOWN")
LOCAL_MAPPING, LOCAL_EXACT, MNEMONIC, TEMPLATE, SUSPECT, LEAST_EXACT = 0.90, 0.95, 0.90, 0.80, 0.30, 0.60
SEARCH_LOW, SEARCH_HIGH, SEARCH_LEAST = 0.50, 0.75, 0.25
_PLACE = r"<[^>]*>|\[[^\]]*\]|\{[^}]*\}|%s|%d"


def stem(brief: Column) -> Column:
    return F.regexp_replace(F.upper(brief), f"(?:{'|'.join(SUFFIXES)})$", "")


def polarity(brief: Column) -> Column:
    ends = lambda words: F.upper(brief).rlike(f"(?:{'|'.join(words)})$")
    return F.when(ends(GOOD), 1).when(ends(BAD), -1).otherwise(0)


def template_pattern(message: Column) -> Column:
    """An anchored expression that takes anything in a template's places."""
    parts = F.transform(F.split(F.trim(message), _PLACE), lambda p: F.regexp_replace(p, r"([\\.^$|?*+()\[\]{}])", r"\\$1"))
    return F.concat(F.lit("(?is)^"), F.array_join(parts, ".*?"), F.lit("$"))


def head(text: Column) -> Column:
    """The first word of a text, lower-case, or nothing if a place comes first."""
    return F.lower(F.regexp_extract(F.trim(text), r"^([A-Za-z0-9_\-]+)(?=[\s,.:;]|$)", 1))


def candidate_family(versions: Column, text: Column) -> Column:
    """A known product's family, else what the entry's words tell."""
    named = F.get(F.filter(F.transform(versions, lambda v: v["family"]), lambda x: x != "UNKNOWN"), F.lit(0))
    up = F.upper(text)
    has = lambda *words: up.rlike("|".join(words))
    return F.coalesce(named, F.when(has("WLAN", "ACMAC", "APMAC", "SSID"), "WLAN").when(has("WIREDUSERINFO", "WIRED_USER_INFO"), "CLOUDENGINE").when(has("USER_INFO_", "USERINFO", "DEVICEMAC"), "CAMPUS").otherwise("UNKNOWN"))


def prepare(knowledge: DataFrame, versions: DataFrame) -> DataFrame:
    """Entries with their version mappings nested and all that matching needs precomputed."""
    plain = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    told = versions.select("knowledge_id", "id", "document_id", "product_type", plain(F.col("product_type")).alias("product_u"), plain(F.col("product_version")).alias("version_u"), S.product_family(F.coalesce("product_type", F.lit(""))).alias("family"))
    nested = told.groupBy("knowledge_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("mapping_id"), "document_id", "product_type", "product_u", "version_u", "family"))).alias("versions"))
    kind = "array<struct<mapping_id:bigint,document_id:bigint,product_type:string,product_u:string,version_u:string,family:string>>"
    own = knowledge.join(nested, knowledge["id"] == nested["knowledge_id"], "left").drop("knowledge_id").withColumn("versions", F.coalesce("versions", F.array().cast(kind)))
    newest = F.array_max(F.transform("versions", lambda v: S.version_numbers(v["version_u"])))
    return own.select(
        F.col("id").alias("k_id"), F.upper("module").alias("k_module"), F.upper(F.trim("brief")).alias("k_brief"), F.col("severity").alias("k_severity"), F.col("message").alias("k_message"),
        stem(F.trim("brief")).alias("k_stem"), polarity(F.trim("brief")).alias("k_polarity"), F.when(F.trim("message") != "", template_pattern(F.col("message"))).alias("k_pattern"), head(F.col("message")).alias("k_head"),
        "versions", newest.alias("k_newest"), candidate_family(F.col("versions"), F.concat_ws(" ", "brief", "parameters", "message")).alias("k_family"),
        (F.col("source") == "local").alias("k_local"), F.upper(F.regexp_replace(F.coalesce("parameters", F.lit("")), "[_-]", "")).alias("k_parameters"), "description", "cause", "action",
    )


def conflicts(family: Column, wireless: Column, wired: Column) -> Column:
    return (wired & (family == "WLAN")) | (wireless & family.isin("CLOUDENGINE", "CAMPUS", "NETENGINE", "HISECENGINE"))


def _score(v: Column) -> Column:
    """150 same product and version, 120 same product, 50 same family, 10 otherwise."""
    same = (F.col("product_u") != "") & (v["product_u"] == F.col("product_u"))
    return F.when(same, F.when((F.col("version_u") != "") & (v["version_u"] == F.col("version_u")), 150).otherwise(120)).when((F.col("family_t") != "UNKNOWN") & (v["family"] == F.col("family_t")), 50).otherwise(10)


def _fit() -> Column:
    """How well an entry fits the product: its best mapping's score (5 without any)."""
    return F.when(F.size("versions") == 0, 5).otherwise(F.array_max(F.transform("versions", _score)))


def _feature() -> Column:
    wired_family = F.col("k_family").isin("CLOUDENGINE", "NETENGINE", "CAMPUS", "HISECENGINE")
    told = F.col("k_parameters").contains("WIREDUSERINFO") | (F.col("k_parameters").contains("USERINFO") & ~F.col("k_parameters").contains("ACMAC"))
    return F.when(F.col("wired") & (F.col("k_family") == "WLAN"), -20).when(F.col("wireless") & (F.col("k_family") == "WLAN"), 30).when(F.col("wireless") & wired_family, F.when(told, -20).otherwise(-10)).otherwise(0)


def _rank(key: list[str], *first: Column) -> Column:
    """Place of a candidate among its key's: those of a contradicted family last, then by score, for a known version not newer than it and the newest, by id."""
    known = F.col("version_u") != ""
    newest = F.transform("k_newest", lambda x: x)
    older = F.when(known, F.coalesce(F.col("k_newest"), F.array().cast("array<bigint>")) <= F.col("version_n")).otherwise(F.lit(False))
    w = Window.partitionBy(*key).orderBy(*first, F.asc("conflict"), F.desc("total"), older.desc(), F.when(known, newest).desc_nulls_last(), F.asc("k_id"))
    return F.row_number().over(w)


def _judged(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("conflict", conflicts(F.col("k_family"), F.col("wireless"), F.col("wired"))).withColumn("total", _fit() + _feature())


def best(candidates: DataFrame, key: list[str], *first: Column) -> DataFrame:
    """Of every key's candidates the one that fits best."""
    return _judged(candidates).withColumn("__r", _rank(key, *first)).where(F.col("__r") == 1).drop("__r")


def consistency() -> Column:
    """1 less a tenth for each step of severity (up to .4) and a quarter if the body isn't like the template."""
    both = F.col("severity").between(1, 8) & F.col("k_severity").between(1, 8)
    gap = F.when(both, F.least(F.lit(0.4), F.abs(F.col("severity") - F.col("k_severity")) * 0.1)).otherwise(0.0)
    unlike = F.when(F.col("k_pattern").isNotNull() & (F.trim("message_body") != "") & ~F.rlike("message_body", "k_pattern"), 0.25).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.lit(1.0) - gap - unlike)


#: Logs of one signature in a part: the bodies of a commoner one are dealt over several.
PART = 50_000
_SIG = ["module_u", "brief_u", "product", "version", "wireless", "wired"]
_BODY = [*_SIG, "severity", "message_body"]


def signatures(logs: DataFrame) -> DataFrame:
    """Distinct signatures of logs that may match at all; ``product`` and ``version`` are added if missing."""
    own = logs
    for name, value in (("product", "Huawei-VRP"), ("version", "")):
        if name not in own.columns:
            own = own.withColumn(name, F.lit(value))
    own = own.withColumns({"product": F.trim("product"), "version": F.trim("version"), "module_u": F.upper(F.trim("module")), "brief_u": F.upper(F.trim("brief")), "wireless": S.is_wireless(F.col("message_body")), "wired": S.is_wired(F.col("message_body"))})
    return own.where(~F.col("module_u").isin("UNKNOWN", "COMMENT") & (F.col("brief_u") != "UNPARSED"))


def _target(sigs: DataFrame) -> DataFrame:
    return sigs.withColumns({"product_u": F.upper("product"), "version_u": F.upper("version"), "version_n": S.version_numbers(F.col("version")), "family_t": S.product_family(F.col("product"))})


def cache_key() -> Column:
    """A number for all that decides a log's match, for rows of ``signatures``."""
    return F.xxhash64(*(F.col(c) for c in _BODY))


def exact_candidates(sigs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``signatures`` with the entries of the same name."""
    return sigs.join(known, (F.col("module_u") == F.col("k_module")) & (F.col("brief_u") == F.col("k_brief")))


def local_candidates(sigs: DataFrame, known: DataFrame) -> DataFrame:
    return exact_candidates(sigs, known.where("k_local"))


def stem_candidates(sigs: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the entries of the same event under another suffix that doesn't contradict."""
    stems = sigs.withColumns({"stem": stem(F.col("brief_u")), "polarity": polarity(F.col("brief_u"))})
    return stems.join(known, (F.col("module_u") == F.col("k_module")) & (F.col("stem") == F.col("k_stem")) & (F.col("brief_u") != F.col("k_brief")) & (F.col("polarity") * F.col("k_polarity") >= 0))


def template_candidates(rows: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with first words ``h`` and the module's templates that their body is like."""
    templates = known.where("k_pattern is not null").drop("k_stem", "k_polarity")
    return rows.join(templates, (F.col("h") == F.col("k_head")) & (F.col("module_u") == F.col("k_module")) & F.rlike("message_body", "k_pattern"), how)


_TARGET = ["product_u", "version_u", "version_n", "family_t"]


def _dealt(bodies: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bodies with their ``part`` of the ``parts`` of their signature. Signatures of several parts are broadcast: one for each ``PART`` logs at most."""
    common = F.broadcast(sizes.where(F.col("parts") > 1))
    return bodies.join(common, _SIG, "left").withColumn("part", F.pmod(F.xxhash64("severity", "message_body"), F.coalesce("parts", F.lit(1)))).drop("parts")


def _outcome(name: str, tier: str, confidence: Column) -> Column:
    """What a log of ``_target`` gets from the entry in column ``name``, or null without one."""
    suspect = conflicts(F.col(f"{name}.family"), F.col("wireless"), F.col("wired")) & F.lit(not tier.startswith("LOCAL"))
    scored = F.array_min(F.transform(f"{name}.v", lambda v: F.struct((-_score(v)).alias("s"), v["mapping_id"].alias("m"), v["document_id"].alias("d"))))
    conf = confidence.cast("double")
    made = F.struct(F.col(f"{name}.k_id").alias("knowledge_id"), F.when(suspect, "FAMILY_SUSPECT").otherwise(tier).alias("match_tier"), F.when(suspect, F.least(conf, F.lit(SUSPECT))).otherwise(conf).alias("match_confidence"), F.coalesce(scored["d"], F.lit(0)).alias("matched_document_id"))
    return F.when(F.col(name).isNotNull(), made)


def match(logs: DataFrame, knowledge: DataFrame, overrides: DataFrame | None = None, with_search: bool = True) -> DataFrame:
    """``logs`` (with id) with ``knowledge_id, match_tier, match_confidence, matched_document_id``; ``knowledge`` comes from ``prepare``.

    Tiers 0 to 2 depend on the signature alone: their answers are found once for each, and joined with the bodies part by part.
    The tiers after them are left joins that add their answers beside those; a row that has one joins with nothing more, as its
    key is null then.
    """
    known = broadcast_if_small(knowledge.drop("description", "cause", "action"))
    own = signatures(logs)
    bodies = own.select(*_BODY).distinct()
    sized = [*_SIG, "parts"]
    sizes = own.groupBy(*_SIG).agg(F.ceil(F.count("*") / PART).alias("parts"))
    sigs = _target(sizes)
    answer = lambda name, *more: F.struct("k_id", F.col("k_family").alias("family"), F.col("versions").alias("v"), *more).alias(name)
    # tier 0: overrides and local entries
    tier0 = known.where("k_local").groupBy(F.col("k_module").alias("module_u"), F.col("k_brief").alias("brief_u")).agg(F.min_by(answer("x"), "k_id").alias("t_local"))
    by_name = sizes.join(tier0, ["module_u", "brief_u"], "left")
    if overrides is not None:
        bound = overrides.where("enabled").groupBy(F.upper("module").alias("module_u"), F.upper("brief").alias("brief_u")).agg(F.max("knowledge_id").alias("k_id")).join(known, "k_id").select("module_u", "brief_u", answer("t_bound"))
        by_name = by_name.join(bound, ["module_u", "brief_u"], "left")
    else:
        by_name = by_name.withColumn("t_bound", F.when(F.lit(False), F.col("t_local")))
    # tier 1: the best entry of the same name, if it is consistent with the body
    exact = best(exact_candidates(sigs, known), _SIG).select(*sized, answer("t_exact", "k_severity", "k_pattern"))
    # tier 2: the same event under another suffix, the bare one first
    akin = best(stem_candidates(sigs, known), _SIG, (F.col("k_brief") == F.col("stem")).desc()).select(*sized, answer("t_akin"))
    by_name = by_name.join(exact, sized, "left").join(akin, sized, "left")
    rows = _dealt(bodies, sizes).join(by_name.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts"), [*_SIG, "part"], "left")
    rows = rows.withColumns({"k_severity": F.col("t_exact.k_severity"), "k_pattern": F.col("t_exact.k_pattern")}).withColumn("consistency", F.when(F.col("t_exact").isNotNull(), consistency())).drop("k_severity", "k_pattern")
    sure = F.col("consistency") >= LEAST_EXACT
    named = F.coalesce(_outcome("t_bound", "LOCAL_MAPPING", F.lit(LOCAL_MAPPING)), _outcome("t_local", "LOCAL_EXACT", F.lit(LOCAL_EXACT)), F.when(sure, _outcome("t_exact", "EXACT", F.col("consistency"))), _outcome("t_akin", "MNEMONIC", F.lit(MNEMONIC)))
    rows = _target(rows).withColumn("named", named).select(*_BODY, "part", "named", F.when(F.col("named").isNull(), _outcome("t_exact", "EXACT", F.col("consistency"))).alias("spare"))
    # tier 3: a template of the module that the body is like; the first word narrows it, templates that begin with a place are tried too
    heads = F.when(F.col("named").isNull(), F.array_distinct(F.array(head(F.col("message_body")), F.lit("")))).otherwise(F.array(F.lit(None).cast("string")))
    tried = template_candidates(_target(rows).withColumn("h", F.explode(heads)), known, "left").withColumn("t_like", F.when(F.col("k_id").isNotNull(), answer("x")))
    rows = best(tried.withColumn("like", _outcome("t_like", "TEMPLATE", F.lit(TEMPLATE))), [*_BODY, "part"], F.col("k_id").isNull().asc()).select(*rows.columns, "like")
    if with_search:
        found = _searched(_target(rows.where("named is null and like is null")), knowledge, known, answer)
        rows = _target(rows.join(found, _BODY, "left")).withColumn("found", _outcome("t_found", "BLEVE", F.col("found_conf")))
    else:
        rows = rows.withColumn("found", F.when(F.lit(False), F.col("spare")))
    won = rows.select(*_BODY, F.coalesce("named", "like", "found", "spare").alias("w")).where("w is not null").select(*_BODY, "w.*")
    matched = own.select("id", *_BODY).join(won, _BODY).select("id", "knowledge_id", "match_tier", "match_confidence", "matched_document_id")
    out = logs.drop("knowledge_id", "match_tier", "match_confidence", "matched_document_id").join(matched, "id", "left")
    return out.withColumns({"knowledge_id": F.coalesce("knowledge_id", F.lit(0)).cast("bigint"), "match_tier": F.coalesce("match_tier", F.lit("UNMATCHED")), "match_confidence": F.coalesce("match_confidence", F.lit(0.0)), "matched_document_id": F.coalesce("matched_document_id", F.lit(0)).cast("bigint")})


def worth_searching(brief: Column, body: Column) -> Column:
    """Whether there's enough to search for."""
    enough = lambda c, n: (F.length(F.trim(c)) >= n) & c.rlike(r"[\p{L}\p{N}]")
    return enough(brief, 2) | enough(body, 3)


def _searched(left: DataFrame, knowledge: DataFrame, known: DataFrame, answer) -> DataFrame:
    asked = left.where(worth_searching(F.col("brief_u"), F.col("message_body"))).select(*_BODY, *_TARGET).withColumn("query", F.xxhash64(*_BODY))
    text = F.concat_ws(" ", "brief_u", F.substring("message_body", 1, 256))
    postings = search.index(knowledge.withColumn("doc", F.col("k_id")), "doc", "k_brief", "k_message", "description", "cause", "action")
    postings = postings.join(known.select(F.col("k_id").alias("doc"), F.col("k_module").alias("module_u")), "doc")
    ranked = search.scores(postings, asked.select("query", "module_u", text.alias("text")), None, within="module_u")
    pairs = asked.join(ranked.withColumnRenamed("doc", "k_id"), "query").join(known, "k_id").where((F.col("k_module") == F.col("module_u")) & (F.col("score") >= SEARCH_LEAST) & ~conflicts(F.col("k_family"), F.col("wireless"), F.col("wired")))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "k_id")
    pairs = pairs.withColumn("__r", F.row_number().over(top)).where(F.col("__r") <= 10).drop("__r")
    pairs = pairs.withColumn("share", S.relevance(F.col("score"))).withColumn("blend", F.lit(0.6) * F.col("share") + F.lit(0.4) * _fit() / 150)
    w = Window.partitionBy("query").orderBy(F.desc("blend"), "k_id")
    won = pairs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
    return won.select(*_BODY, answer("t_found"), (F.lit(SEARCH_LOW) + (SEARCH_HIGH - SEARCH_LOW) * F.col("share")).alias("found_conf"))


def with_context(logs: DataFrame, devices: DataFrame, override: str = "") -> DataFrame:
    """``product``: the device's type unless it is a generic word, else the family that the host's name tells, the override, the neutral one."""
    kinds = devices.select("device_id", F.when(~F.lower("device_type").isin("", "router", "switch", "firewall", "other", "unassigned"), F.col("device_type")).alias("__type"))
    family = F.nullif(S.product_family(F.col("hostname")), F.lit("UNKNOWN"))
    return logs.join(broadcast_if_small(kinds), "device_id", "left").withColumn("product", F.coalesce("__type", family, F.nullif(F.lit(override), F.lit("")), F.lit("Huawei-VRP"))).drop("__type")
