"""The scalar functions over columns of whole tables, each against SQL that works the same out by other means.

Inputs are made from a table's columns in expressions that Spark and DuckDB read alike; ``want`` is DuckDB's expression for the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syslumen.functions import parameters as P
from syslumen.functions import scalar as S
from syslumen.operators import enrich, matching
from syslumen.plans import filters as FL
from syslumen.queries import query
from syslumen.session import micros, read
from syslumen.sources import raw

#: Names of queries here; literal cases of the same names are tests.
NAMES: set[str] = set()


def _over(name: str, table: str, columns: dict[str, str], make: Callable[..., Column], want: str, key: str = "") -> None:
    key = key or {"events": "event_id", "documents": "doc_id", "part": "p_partkey", "conversations": "conv_id * 1000 + turn", "pages": "page_id"}[table]
    made = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    NAMES.add(name)

    @query(name, f"WITH t AS (SELECT CAST({key} AS BIGINT) AS k, {made} FROM {table}) SELECT k, {want} AS result FROM t")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = read(spark, sf_dir, table).selectExpr(f"CAST({key} AS BIGINT) AS k", *(f"{e} AS {c}" for c, e in columns.items()))
        return own.select("k", make(*(F.col(c) for c in columns)).alias("result"))


_E, _U = "CAST(event_id AS STRING)", "CAST(user_id AS STRING)"
_V = f"event_type || {_E}"
_IP = f"'10.0.' || CAST(user_id % 200 AS STRING) || '.1'"
_GE = "'GE' || CAST(user_id % 24 AS STRING)"
_map = lambda s: F.str_to_map(s, F.lit(";"), F.lit("="))

# ---- cleaning and masking

_over("str01_trim_space", "documents", {"s": "chr(9) || ' ' || text || chr(10) || chr(32)"}, S.trim_space, r"regexp_replace(s, '^[\s\x0b\x85\p{Z}\x00]+|[\s\x0b\x85\p{Z}\x00]+$', '', 'g')")
_over("str02_garbage", "documents", {"s": "CASE WHEN doc_id % 3 = 0 THEN chr(9) || ' ' || chr(1) ELSE text END"}, S.is_garbage, r"NOT regexp_matches(coalesce(s, ''), '[\p{L}\p{M}\p{N}\p{P}\p{S}]')")
_over("str03_sanitize", "documents", {"s": "chr(27) || '[31m' || text || chr(27) || '[0m' || chr(7) || 'x' || chr(127)"}, lambda s: S.sanitize(s, False), r"trim(regexp_replace(regexp_replace(replace(replace(s, chr(27) || '[31m', ''), chr(27) || '[0m', ''), '\x7f', '', 'g'), '[\x00-\x08\x0a-\x1f]', ' ', 'g'))")
_SECRET = {0: "'set password cipher ' || v || ' now'", 1: "'pwd=' || v || ', key=10, Token = x' || v || ')'", 2: "'{\"password\": \"' || v || '\", \"user\":\"u\"}'", 3: "'password cipher error ' || v", 4: "'value %^%#' || v || '%^%# end'", 5: "'snmp-agent community read cipher ' || v", 6: "'shared-key of ' || v"}
_MASKED = {0: "'set password cipher ****** now'", 1: "'pwd=******, key=10, Token=******)'", 2: "'{\"password\":\"******\", \"user\":\"u\"}'", 3: "s", 4: "'value ****** end'", 5: "'snmp-agent community read cipher ******'", 6: "s"}
_over("str04_mask", "events", {"s": "CASE event_id % 7 " + " ".join(f"WHEN {k} THEN " + e.replace("|| v", f"|| {_V}") for k, e in _SECRET.items()) + " END"}, S.mask_credentials, "CASE k % 7 " + " ".join(f"WHEN {k} THEN {e}" for k, e in _MASKED.items()) + " END")
_over("str05_like_escapes", "documents", {"s": "text"}, lambda s: s.like(f"%{FL.escaped('%%%')}%") | s.like(f"%{FL.escaped('_x')}%"), "contains(s, '%%%') OR contains(s, '_x')")
_over("str16_clean_text", "documents", {"s": "text"}, S.clean_text, r"trim(regexp_replace(replace(s, chr(160), ' '), '[\s\x0b]+', ' ', 'g'))")

# ---- names and labels

_over("str06_file_names", "events", {"s": f"'[' || event_type || ']_a/b:' || {_E} || '*.log'"}, lambda s: S.file_component(S.strip_device_prefix(s)), "'a_b_' || k || '_.log'")
_over("str07_normalized_key", "part", {"s": "' ' || p_brand || '_' || p_name || '-X '"}, S.normalized_key, "replace(replace(replace(lower(s), ' ', ''), '_', ''), '-', '')")
_over("str08_roles", "events", {"s": f"CASE event_id % 3 WHEN 0 THEN 'Peer-IP=' || {_IP} || ';State=down' WHEN 1 THEN 'x=1' ELSE 'Nbr_Addr=' || {_IP} || ';IP=1.1.1.1' END"}, lambda s: F.coalesce(enrich.role(S.normalized_map(_map(s)), "peer"), F.lit("none")), "CASE k % 3 WHEN 1 THEN 'none' ELSE regexp_extract(s, '=([0-9.]+)', 1) END")
_over("str09_normalized_maps", "events", {"s": f"'If_Name=' || {_GE} || ';b=-;c=;User ID=' || {_U}"}, lambda s: S.sorted_json(S.normalized_map(_map(s))), "'{\"ifname\":\"' || regexp_extract(s, 'GE[0-9]+') || '\",\"userid\":\"' || regexp_extract(s, '[0-9]+$') || '\"}'")
_over("str11_clean_title", "conversations", {"s": "'<b>' || text || '</b>'"}, S.clean_title, r"(SELECT CASE WHEN length(o) > 60 THEN substr(o, 1, 60) || '...' ELSE o END FROM (SELECT regexp_replace(regexp_extract(trim(regexp_replace(s, '<[^>]*>', '', 'g')), '^([^。\n]*)', 1), '[，,](?:可能|由于).*$', '') AS o))")
_over("str12_context", "events", {"s": f"'Reason=' || event_type || ' on the device ' || {_E} || ' of user ' || {_U} || ';IfName=' || {_GE} || CASE WHEN event_id % 2 = 0 THEN ';Peer=' || {_IP} ELSE '' END || ';IP=2.2.2.2;State=up'"}, lambda s: enrich.context(_map(s)), "(SELECT 'reason: ' || CASE WHEN length(r) > 30 THEN substr(r, 1, 30) || '...' ELSE r END FROM (SELECT regexp_extract(s, 'Reason=([^;]*)', 1) AS r)) || ' | interface: ' || regexp_extract(s, 'IfName=([^;]*)', 1) || CASE WHEN k % 2 = 0 THEN ' | peer: ' || regexp_extract(s, 'Peer=([^;]*)', 1) ELSE ' | ip: 2.2.2.2' END")
_over("str13_render", "events", {"s": f"'ifname=' || {_GE} || ';State=' || event_type"}, lambda s: P.rendered(F.lit("[If-Name] is {state}, %x%"), _map(s)), "regexp_extract(s, 'GE[0-9]+') || ' is ' || regexp_extract(s, '[a-z]+$') || ', %x%'")
_over("str15_csv_fields", "events", {"s": f"CASE event_id % 5 WHEN 0 THEN '=' || {_E} WHEN 1 THEN 'say \"' || event_type || '\", x' WHEN 2 THEN event_type WHEN 3 THEN '-' || {_E} || chr(10) || '3' ELSE '@' || {_E} || ',' END"}, S.csv_safe, "CASE k % 5 WHEN 0 THEN '''' || s WHEN 1 THEN '\"' || replace(s, '\"', '\"\"') || '\"' WHEN 2 THEN s ELSE '\"''' || s || '\"' END")
_over("str17_words_compatible", "part", {"a": "p_name", "b": "CASE WHEN p_partkey % 2 = 0 THEN substr(p_name, 1, length(p_name) - 1) ELSE p_type || ' ' || p_name END"}, lambda a, b: S.words_compatible(F.split(a, " "), F.split(b, " ")), "len(list_filter(string_split(b, ' '), lambda y: len(list_filter(string_split(a, ' '), lambda x: levenshtein(lower(x), lower(y)) <= 1)) = 0)) = 0")
_over("str18_severity_labels", "events", {"s": "CAST(event_id % 9 AS INT)"}, lambda s: F.concat(S.severity_bucket(s), S.severity_prefix(s)), "['severe', 'severe[紧急]', 'severe[紧急]', 'error[告警]', 'error[告警]', 'warning', 'info', 'info', 'info'][s + 1]")
_over("str19_case_tags", "conversations", {"s": "replace(text, ' ', ';')"}, lambda s: F.array_join(S.case_tags(s), "|"), "coalesce((SELECT string_agg(w, '|' ORDER BY i) FROM (SELECT w, i, row_number() OVER (PARTITION BY lower(w) ORDER BY i) AS r FROM (SELECT trim(unnest(ws)) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT string_split_regex(s, '[,，;；]') AS ws)) WHERE w <> '') WHERE r = 1), '')")
_over("str20_multi_value", "conversations", {"s": "text"}, lambda s: F.array_join(S.multi_value(s), "|"), r"array_to_string(list_filter(list_transform(string_split_regex(s, '[,;\n]'), lambda x: trim(x)), lambda x: x <> ''), '|')")
_over("str21_gb18030", "events", {"s": f"'接口 ' || event_type || {_E}"}, lambda s: _gb18030(s), "s")

# ---- versions and families

_over("ver01_compare", "events", {"a": "'V200R0' || CAST(event_id % 20 AS STRING) || 'C00'", "b": "CASE WHEN event_id % 11 = 0 THEN '' ELSE 'V200R0' || CAST(user_id % 20 AS STRING) || 'C00' || CASE WHEN event_id % 3 = 0 THEN 'SPC' || CAST(event_id % 5 AS STRING) ELSE '' END END"}, S.compare_versions, r"CASE WHEN b = '' THEN 1 ELSE (SELECT CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END FROM (SELECT list_transform(regexp_extract_all(a, '\d+'), lambda v: CAST(v AS BIGINT)) AS x, list_transform(regexp_extract_all(b, '\d+'), lambda v: CAST(v AS BIGINT)) AS y)) END")
_MODELS = ("CASE {0} % 5 WHEN 0 THEN 'CE' || CAST(1000 + {1} % 9000 AS STRING) || 'E' WHEN 1 THEN 'S' || CAST(1000 + {1} % 9000 AS STRING) WHEN 2 THEN 'NE' || CAST(10 + {1} % 90 AS STRING) || 'E' WHEN 3 THEN 'AP' || CAST(1000 + {1} % 9000 AS STRING) ELSE 'XS' || CAST({1} AS STRING) END")
_FAMILY = "CASE WHEN starts_with({0}, 'CE') THEN 'CLOUDENGINE' WHEN starts_with({0}, 'S') THEN 'CAMPUS' WHEN starts_with({0}, 'NE') THEN 'NETENGINE' WHEN starts_with({0}, 'AP') THEN 'WLAN' ELSE 'UNKNOWN' END"
_over("ver02_score", "events", {"p": _MODELS.format("event_id", "user_id"), "v": "'v' || CAST(event_id % 3 AS STRING)", "tp": "lower(" + _MODELS.format("user_id", "user_id") + ")", "tv": "' V' || CAST(user_id % 3 AS STRING)"}, S.version_score, f"CASE WHEN p = upper(tp) THEN CASE WHEN upper(v) = trim(tv) THEN 150 ELSE 120 END WHEN {_FAMILY.format('p')} <> 'UNKNOWN' AND {_FAMILY.format('p')} = {_FAMILY.format('upper(tp)')} THEN 50 ELSE 10 END")
_over("fam01_family", "events", {"p": _MODELS.format("event_id", "event_id")}, S.product_family, _FAMILY.format("p"))
_over("fam02_model_or_family", "events", {"h": "'BJ-' || " + _MODELS.format("event_id", "event_id") + " || '-01'"}, S.model_or_family, "CASE WHEN starts_with(h, 'BJ-XS') THEN '' ELSE regexp_extract(h, 'BJ-(.*)-01', 1) END")
_over("fam03_medium", "events", {"s": "CASE event_id % 5 WHEN 0 THEN '[WLAN_STA_INFO]' WHEN 1 THEN 'ACMAC:1;SSID:' WHEN 2 THEN '[USER_INFO_1]' WHEN 3 THEN 'DEVICEMAC:2' ELSE 'ACMAC:' END || event_type"}, lambda s: F.concat_ws("/", S.is_wireless(s).cast("string"), S.is_wired(s).cast("string")), "(k % 5 IN (0, 1)) || '/' || (k % 5 IN (2, 3))")
_over("fam04_candidate_families", "events", {"p": "CASE WHEN event_id % 2 = 0 THEN " + _MODELS.format("user_id", "event_id") + " ELSE '' END", "t": "CASE event_id % 7 WHEN 0 THEN 'ACMAC list' WHEN 1 THEN 'the USER_INFO_X' WHEN 2 THEN 'wireduserinfo' ELSE event_type END"}, lambda p, t: matching.candidate_family(F.array(F.struct(S.product_family(p).alias("family"))), t), f"CASE WHEN p <> '' AND {_FAMILY.format('p')} <> 'UNKNOWN' THEN {_FAMILY.format('p')} ELSE CASE k % 7 WHEN 0 THEN 'WLAN' WHEN 1 THEN 'CAMPUS' WHEN 2 THEN 'CLOUDENGINE' ELSE 'UNKNOWN' END END")

# ---- times: the stamp of an event in the forms that devices write

_DAY = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(extract(month FROM ts) AS INT) * 3 - 2, 3) || ' ' || CAST(extract(day FROM ts) AS STRING)"
_CLOCK = "substr(CAST(ts AS STRING), 12, 8)"
_STAMPS = f"CASE event_id % 7 WHEN 0 THEN CAST(ts AS STRING) WHEN 1 THEN substr(CAST(ts AS STRING), 1, 19) || '+08:00' WHEN 2 THEN substr(CAST(ts AS STRING), 1, 10) || 'T' || {_CLOCK} || 'Z' WHEN 3 THEN {_DAY} || ' ' || CAST(extract(year FROM ts) AS STRING) || ' ' || {_CLOCK} || '-0330' WHEN 4 THEN 'UTC+08:00 ' || substr(CAST(ts AS STRING), 1, 19) WHEN 5 THEN {_DAY} || ' ' || CAST(extract(year FROM ts) AS STRING) || ' ' || {_CLOCK} || '.' || CAST(event_id % 1000 AS STRING) || '.' || CAST(user_id % 1000 AS STRING) ELSE 'no time ' || {_E} END"
_S19 = "epoch_us(date_trunc('second', ts))"
_over("tim01_device_times", "events", {"t": _STAMPS, "ts": "ts", "u": "user_id"}, lambda t, *_: micros(S.parse_time(t, as_of="2026-06-01 00:00:00")), f"CASE k % 7 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN {_S19} - 28800000000 WHEN 2 THEN {_S19} WHEN 3 THEN {_S19} + 12600000000 WHEN 4 THEN {_S19} - 28800000000 WHEN 5 THEN {_S19} + (k % 1000) * 1000 + u % 1000 ELSE NULL END")
_over("tim02_sub_seconds", "events", {"t": f"substr(CAST(ts AS STRING), 1, 19) || '.' || CAST(event_id % 1000 AS STRING) || '.' || CAST(user_id % 1000 AS STRING)"}, S.normalized_time, "substr(t, 1, 19) || '.' || lpad(string_split(t, '.')[2], 3, '0') || lpad(string_split(t, '.')[3], 3, '0')")
_over("tim03_years", "events", {"t": f"{_DAY} || ' ' || {_CLOCK}", "ts": "ts"}, lambda t, _: micros(S.parse_time(t, as_of="2024-12-31 12:00:00")), f"{_S19}")
_over("tim04_offsets", "events", {"t": "CASE event_id % 3 WHEN 0 THEN substr(CAST(ts AS STRING), 1, 19) || '+0530' WHEN 1 THEN 'UTC-3 ' || substr(CAST(ts AS STRING), 1, 19) ELSE substr(CAST(ts AS STRING), 1, 19) || 'Z' END", "s": "substr(CAST(ts AS STRING), 1, 19)"}, lambda t, _: S.normalized_time(t), "s || ['+05:30', '-03:00', '+00:00'][k % 3 + 1]")
_over("tim05_request_times", "events", {"t": "CASE event_id % 4 WHEN 0 THEN CAST(1700000000 + event_id AS STRING) WHEN 1 THEN CAST(1700000000123 + event_id AS STRING) WHEN 2 THEN substr(CAST(ts AS STRING), 1, 16) ELSE substr(CAST(ts AS STRING), 1, 10) END", "ts": "ts"}, lambda t, _: micros(S.parse_custom_time(t)), "CASE k % 4 WHEN 0 THEN (1700000000 + k) * 1000000 WHEN 1 THEN (1700000000123 + k) * 1000 WHEN 2 THEN epoch_us(date_trunc('minute', ts)) ELSE epoch_us(date_trunc('day', ts)) END")
_over("tim06_sql_times", "events", {"t": "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN event_type ELSE CAST(ts AS STRING) END", "ts": "ts"}, lambda t, _: micros(S.parse_custom_time(t)), "CASE WHEN k % 5 > 1 THEN epoch_us(ts) END")

# ---- parameters

_over("map02_repeated_keys", "events", {"b": f"'(x=' || CAST(event_id % 3 AS STRING) || ', x=' || CAST(user_id % 3 AS STRING) || ', y=' || event_type || ')'"}, lambda b: P.parameters(b)["x"], "CASE WHEN substr(b, 4, 1) = substr(b, 9, 1) THEN substr(b, 4, 1) ELSE '[\"' || substr(b, 4, 1) || '\", \"' || substr(b, 9, 1) || '\"]' END")
_over("map03_valid_keys", "events", {"b": f"CASE WHEN event_id % 2 = 0 THEN '(' || event_type || ' key=' || {_E} || ')' ELSE 'plain ' || event_type END"}, lambda b: F.size(P.parameters(b)), "CAST(k % 2 = 0 AS INT)")
_over("map04_captured", "events", {"b": f"'Interface ' || {_GE} || ' is ' || event_type || '. (User=' || {_U} || ' x)'"}, lambda b: S.sorted_json(P.captured(F.lit("Interface [If] is [State]. (User=[U])"), b)), "'{\"If\":\"' || regexp_extract(b, 'GE[0-9]+') || '\",\"State\":\"' || regexp_extract(b, ' is ([a-z]+)', 1) || '\",\"U\":\"' || regexp_extract(b, 'User=([0-9]+ x)', 1) || '\"}'")
_over("map05_merged", "events", {"a": f"'User=' || {_U}", "b": f"'USER=captured;New=' || {_E} || ';STRING=x'"}, lambda a, b: S.sorted_json(P.merged(_map(a), _map(b))), "'{\"New\":\"' || k || '\",\"User\":\"' || substr(a, 6) || '\"}'")
_over("jsn02_lists", "events", {"s": f"CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE '[' || {_E} || ', ' || {_U} || ']' END"}, lambda s: F.to_json(F.from_json(s, "array<bigint>")), "CASE WHEN k % 4 > 0 THEN replace(s, ' ', '') END")

# ---- matching

_SUFFIX = "['_INACTIVE', '_ACTIVE', '_RESUME', '_CLEAR', '_ERROR', '_FAIL', '_DOWN', '_UP', '']"
_over("mat04_stems", "events", {"s": "event_type || '_' || CASE event_id % 9 WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' WHEN 2 THEN 'RESUME' WHEN 3 THEN 'CLEAR' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'FAIL' WHEN 6 THEN 'DOWN' WHEN 7 THEN 'UP' ELSE 'x' END"}, lambda s: F.concat(matching.stem(s), F.lit("/"), matching.polarity(s).cast("string")), f"CASE WHEN k % 9 = 8 THEN upper(s) ELSE substr(upper(s), 1, length(s) - length({_SUFFIX}[k % 9 + 1])) END || '/' || [1, -1, 1, 1, -1, -1, -1, 1, 0][k % 9 + 1]")
_over("mat06_template_patterns", "events", {"t": "CASE WHEN event_id % 2 = 0 THEN 'Peer <x> (state %s) is {y}.' ELSE 'Peer [a] is ' || event_type || '.' END", "b": f"'peer ' || {_IP} || ' (state Up) is ' || CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'gone' END || '.'"}, lambda t, b: F.rlike(b, matching.template_pattern(t)), "k % 2 = 0 OR NOT contains(b, 'gone')")
_over("mat07_worth_searching", "events", {"b": "CASE event_id % 3 WHEN 0 THEN 'X' WHEN 1 THEN '--' ELSE event_type END", "m": "CASE user_id % 3 WHEN 0 THEN 'ab' WHEN 1 THEN '...' ELSE event_type END"}, matching.worth_searching, "b NOT IN ('X', '--') OR m NOT IN ('ab', '...')")
_over("mat10_conflicts", "events", {"f": "CASE event_id % 3 WHEN 0 THEN 'WLAN' WHEN 1 THEN 'CAMPUS' ELSE 'UNKNOWN' END", "w": "user_id % 2 = 0", "d": "user_id % 3 = 0"}, matching.conflicts, "CASE f WHEN 'WLAN' THEN d WHEN 'CAMPUS' THEN w ELSE FALSE END")
_over("prs06_supported", "events", {"s": f"CASE event_id % 3 WHEN 0 THEN 'x %%01A/' || CAST(event_id % 10 AS STRING) || '/B(l): y' WHEN 1 THEN 'A/4/B ' || event_type ELSE '%%A/' || CAST(event_id % 10 AS STRING) || '/B: y' END"}, lambda s: s.rlike(raw.SUPPORTED), r"CASE WHEN k % 3 = 1 THEN FALSE ELSE k % 10 <= 8 END")


def _gb18030(s: Column) -> Column:
    """The text written as GB18030 and read back by what decides on a file's encoding."""

    @F.pandas_udf("string")
    def back(texts):
        return texts.map(lambda t: raw_decode(t.encode("gb18030")))

    from syslumen.sources.package import decode as raw_decode

    return back(s)
