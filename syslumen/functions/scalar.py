"""Scalar functions as column expressions: cleaning, masking, times, versions, families, hashes, labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- cleaning and masking


def trim_space(c: Column) -> Column:
    """Without NUL and white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\x00\s]+|[\x00\s]+$", "")


def is_garbage(line: Column) -> Column:
    """Whether nothing in the line can be seen."""
    return ~F.coalesce(line, F.lit("")).rlike(r"[\p{L}\p{M}\p{N}\p{P}\p{S}&&[^�]]")


# Terminal control sequences; secrets in JSON, as key=value, after commands and marked; states that are no secret; words that make a line worth looking at.
ANSI = r"\x1b\[[0-9;?]*[a-zA-Z]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[()][0-9A-B]"
SECRET_JSON = r'(?i)"(pass(?:word)?|pwd|secret|token|community|shared[_-]?key|pre[_-]?shared[_-]?key|api[_-]?key|auth[_-]?key)"\s*:\s*"([^"]*)"'
SECRET_PAIR = r"(?i)\b(pass(?:word)?|pwd|secret|token|shared[_-]?key|pre[_-]?shared[_-]?key|api[_-]?key|auth[_-]?key)\s*=\s*([^,;\s\)]+)"
SECRET_COMMAND = r"(?i)\b((?>password(?:\s+(?:simple|cipher|irreversible-cipher))?|(?:snmp(?:-agent)?\s+)?community(?:\s+(?:read|write))?(?:\s+(?:simple|cipher))?|shared-key(?:\s+(?:simple|cipher))?|pre-shared-key(?:\s+(?:simple|cipher))?))\s+(?!(?:error|failed|mismatch|invalid|expired|changed|policy|required)(?:\s|$))(\S+)"
SECRET_CIPHER = r"%\^%#[^\s,;]+?%\^%?#"
TRIGGERS = ("=", ":", r"%\^%#", "password", "cipher", "community", "secret", "token")

#: What each form of a secret becomes, in order. The command takes all it can and gives nothing back, so that a state after it leaves it alone.
MASKS = ((SECRET_JSON, '"$1":"******"'), (SECRET_PAIR, "$1=******"), (SECRET_COMMAND, "$1 ******"), (SECRET_CIPHER, "******"))


def mask_credentials(c: Column) -> Column:
    """Values of secrets as ``******`` in each of the ``MASKS``' forms; a line without any of the ``TRIGGERS`` is as it was."""
    masked = reduce(lambda line, step: F.regexp_replace(line, *step), MASKS, c)
    return F.when(c.rlike(f"(?i){'|'.join(TRIGGERS)}"), masked).otherwise(c)


def sanitize(c: Column, mask: bool = True) -> Column:
    """A line without byte-order mark and control sequences; control characters are blanks, DEL goes, ends are trimmed."""
    out = F.regexp_replace(F.regexp_replace(c, r"^\x{FEFF}", ""), ANSI, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\x7F", ""), r"[\x00-\x08\x0A-\x1F]", " ")
    return (mask_credentials if mask else lambda x: x)(trim_space(out))


# ---- names and labels


def severity_bucket(s: Column) -> Column:
    return F.when(s <= 2, "severe").when(s <= 4, "error").when(s <= 5, "warning").otherwise("info")


def severity_prefix(s: Column) -> Column:
    """What a summary begins with: nothing at 0 or below, or beyond 4."""
    return F.when((s > 0) & (s <= 2), "[紧急]").when((s > 0) & (s <= 4), "[告警]").otherwise("")


def normalized_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[_\- ]", "")


def file_component(c: Column) -> Column:
    """A name that can be part of a file's name."""
    return F.regexp_replace(F.trim(c), r'[\\/:*?"<>|\x00-\x1F]', "_")


def strip_device_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^\[[^\]]*\]_", "")


def csv_safe(c: Column) -> Column:
    """A field that no spreadsheet takes for a formula, quoted where it must be."""
    plain = F.when(c.rlike(r"^[=+\-@\t\r`]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(plain.rlike(r'[",\n\r]'), F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain)


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"\s+", " "))


def case_tags(c: Column) -> Column:
    """Tags cut at commas and semicolons of either width, trimmed, each once whatever its case."""
    parts = F.filter(F.transform(F.split(c, "[,，;；]"), lambda x: F.trim(x)), lambda x: x != "")
    once = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(parts, F.array().cast("array<string>"), once)


def multi_value(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[,;\n]"), lambda x: F.trim(x)), lambda x: x != "")


def top_parameters(m: Column, n: int) -> Column:
    """``key: value`` of the first ``n`` keys in order."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.map_entries(m)), 1, n), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def normalized_map(m: Column) -> Column:
    """Keys normalised, values that are empty or ``-`` left out."""
    return F.transform_keys(F.map_filter(m, lambda k, v: ~F.trim(v).isin("", "-")), lambda k, v: normalized_key(k))


def sorted_json(m: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def words_compatible(a: Column, b: Column) -> Column:
    """Whether every word of ``b`` is at most one edit from a word of ``a``; both are arrays."""
    return F.forall(b, lambda x: F.exists(a, lambda y: F.levenshtein(F.lower(x), F.lower(y)) <= 1))


def clean_title(c: Column, most: int = 60) -> Column:
    """A description's first sentence without tags, cut before what may follow from it, at most ``most`` characters."""
    out = F.trim(F.regexp_replace(c, r"<[^>]*>", ""))
    out = F.regexp_extract(out, r"^([^。\n]*)", 1)
    out = F.regexp_replace(out, r"[，,](?:可能|由于).*$", "")
    return let(out, lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t))


# ---- times

_SUB = r"(\d{2}:\d{2}:\d{2})\.(\d{1,9})\.(\d+)(?:\.\d+)?"
# The forms of time that are read, after the text is brought into shape.
_FORMS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][.SS][.S]", "MMM d yyyy HH:mm:ss[.SSSSSS][.SSS][.SS][.S]")


def normalized_time(c: Column) -> Column:
    """A device's time in one form: offset last and as ±hh:mm, no T, single blanks, ``ms.seq`` as six digits."""
    out = F.regexp_replace(F.regexp_replace(trim_space(c), r"\s+", " "), r"^<\d+>\s*", "")
    out = F.regexp_replace(out, r"^UTC\s*([+-]\d{1,2})(?::?(\d{2}))? (.*)$", "$3$1:$2")
    out = F.regexp_replace(out, r"([+-]\d{1,2}):$", "$1:00")
    out = F.regexp_replace(out, r"([+-])(\d):(\d{2})$", "$10$2:$3")
    out = F.regexp_replace(F.regexp_replace(out, r"^UTC ", ""), r"(\d) ?([+-]\d{2})(\d{2})$", "$1$2:$3")
    out = F.regexp_replace(F.regexp_replace(out, r"^(\d{4}-\d{2}-\d{2})T", "$1 "), r"Z$", "+00:00")

    def shaped(text: Column) -> Column:
        part = lambda g: F.regexp_extract(text, _SUB, g)
        six = F.concat(part(1), F.lit("."), F.lpad(part(2), 3, "0"), F.lpad(F.substring(part(3), 1, 3), 3, "0"))
        return F.when(text.rlike(_SUB), F.concat(F.regexp_extract(text, rf"^(.*?){_SUB}", 1), six, F.regexp_extract(text, rf"{_SUB}(.*)$", 4))).otherwise(text)

    return let(out, shaped)


def parse_time(c: Column, zone_minutes: int = 0, as_of: str | None = None) -> Column:
    """A device's time in UTC as a timestamp without zone, NULL if it can't be one.

    Times without an offset are taken to be ``zone_minutes`` ahead of UTC. Those without a year get the
    latest of the five years up to ``as_of`` (today, if None) in which they exist and aren't over a day ahead.
    """
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
    try_ = lambda t, form: F.try_to_timestamp(t, F.lit(form)).cast("timestamp_ntz")
    # a form that can't fit costs an exception a row: only that of a month's name begins with a letter
    plain = lambda t: F.when(t.rlike(r"^\p{L}"), try_(t, _FORMS[1])).otherwise(try_(t, _FORMS[0]))

    def read(text: Column) -> Column:
        offset = F.regexp_extract(text, r"([+-]\d{2}:\d{2})$", 1)
        bare = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s?[+-]\d{2}:\d{2}$", "")), r"(\.\d{6})\d+$", "$1")

        def stamped(x: Column) -> Column:
            o, b = x["offset"], x["bare"]
            minutes = F.when(o == "", F.lit(zone_minutes)).otherwise((F.substring(o, 2, 2).try_cast("int") * 60 + F.substring(o, 5, 2).try_cast("int")) * F.when(o.startswith("-"), -1).otherwise(1))
            shift = lambda t: F.timestamp_add("MINUTE", -minutes.cast("bigint"), t)
            # MMM d HH:mm:ss: the year goes in after the day
            with_year = lambda k: F.regexp_replace(b, r"^(\w{3} \d{1,2}) ", F.concat(F.lit("$1 "), (F.year(now) - k).cast("string"), F.lit(" ")))
            guesses = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: shift(plain(with_year(k))))
            near = F.filter(guesses, lambda t: t <= F.timestamp_add("HOUR", F.lit(24), now))
            return F.when(b.rlike(r"^\w{3} \d{1,2} \d{2}:"), F.get(near, F.lit(0))).otherwise(shift(plain(b)))

        return let(F.struct(offset.alias("offset"), bare.alias("bare")), stamped)

    return let(normalized_time(c), read)


def parse_custom_time(c: Column) -> Column:
    """A request's time: epoch seconds or milliseconds (above 1e11), or text with or without an offset."""
    number = c.try_cast("double")
    digits = c.rlike(r"^-?\d+(\.\d+)?$")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    epoch = F.timestamp_add("MICROSECOND", (seconds * 1_000_000).cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(digits, epoch).otherwise(F.coalesce(parse_time(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")))


# ---- versions and product families


def version_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.trim(c), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1: sequences of numbers, the shorter of equal ones first, nothing before all; without numbers, by letters."""
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    sign = lambda p, q: F.when(p < q, -1).when(p > q, 1).otherwise(0)
    nx, ny = version_numbers(x), version_numbers(y)
    return F.when((x == "") & (y == ""), 0).when(x == "", -1).when(y == "", 1).when((F.size(nx) == 0) | (F.size(ny) == 0), sign(F.upper(x), F.upper(y))).otherwise(sign(nx, ny))


# Product families in the order in which they are tried, with names and forms of model numbers.
FAMILIES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("WLAN", ("AIR-ENGINE", "AIRENGINE", "AC6805", "AC6800", "AC6605", "AC6508", "AC6005", "FIT-AP", "FAT-AP", "WLAN"), (r"AC\d{4,5}[A-Z]?", r"AP\d{4,5}[A-Z]?", r"AIRENGINE\s*\d{4,5}[A-Z]?")),
    ("CAMPUS", ("S12700E", "S12700", "S9700", "S7700", "S6700", "S5700", "CAMPUS"), (r"S\d{4,5}[A-Z]?",)),
    ("CLOUDENGINE", ("CLOUDENGINE", "CE16800", "CE12800", "CE9860", "CE8800", "CE6800", "CE5800"), (r"CE\d{4,5}[A-Z]?",)),
    ("HISECENGINE", ("HISECENGINE", "USG6000", "USG9000"), (r"USG\d{4,5}[A-Z]?",)),
    ("NETENGINE", ("NETENGINE", "NE8000", "NE5000E", "NE40E", "NE20E", "CX600"), (r"NE\d{2,5}[A-Z]?", r"CX\d{3,4}[A-Z]?")),
]


def product_family(c: Column) -> Column:
    own, out = F.upper(F.trim(c)), None
    for name, names, forms in FAMILIES:
        test = own.rlike(rf"(?:^|[^A-Z0-9])(?:{'|'.join((*names, *forms))})(?:$|[^A-Z0-9])")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("UNKNOWN")


def model_or_family(c: Column) -> Column:
    """A model number in a name, else the family that it tells, else nothing."""
    own = F.upper(F.trim(c))
    found = [F.nullif(F.regexp_extract(own, rf"(?:^|[^A-Z0-9])({'|'.join(x for x in (*forms, *names) if any(ch.isdigit() for ch in x) or '\\d' in x)})(?:$|[^A-Z0-9])", 1), F.lit("")) for _, names, forms in FAMILIES]
    return F.coalesce(*found, F.nullif(product_family(c), F.lit("UNKNOWN")), F.lit(""))


def version_score(product: Column, version: Column, target_product: Column, target_version: Column) -> Column:
    """150 same product and version, 120 same product, 50 same family, 10 otherwise."""
    t, v = F.upper(F.trim(F.coalesce(target_product, F.lit("")))), F.upper(F.trim(F.coalesce(product, F.lit(""))))
    tv, vv = F.upper(F.trim(F.coalesce(target_version, F.lit("")))), F.upper(F.trim(F.coalesce(version, F.lit(""))))
    same = product_family(t) == product_family(v)
    return F.when((t != "") & (t == v), F.when((tv != "") & (tv == vv), 150).otherwise(120)).when((t != "") & (v != "") & same & (product_family(t) != "UNKNOWN"), 50).otherwise(10)


def is_wireless(body: Column) -> Column:
    return F.coalesce(body.contains("[WLAN_") | (body.contains("ACMAC:") & (body.contains("SSID:") | body.contains("APMAC:"))), F.lit(False))


def is_wired(body: Column) -> Column:
    return F.coalesce(body.contains("[USER_INFO_") | body.contains("DEVICEMAC:"), F.lit(False))


# ---- hashes


def content_hash(*fields: Column) -> Column:
    """SHA-256 over fields trimmed and written as length in bytes, colon, value."""
    own = [F.trim(F.coalesce(f.cast("string"), F.lit(""))) for f in fields]
    return F.sha2(F.concat(*(p for f in own for p in (F.octet_length(f).cast("string"), F.lit(":"), f))), 256)


def stable_key(entry_type: Column, module: Column, brief: Column, trap_oid: Column, alarm_id: Column) -> Column:
    """What tells an entry from others whatever the document's version: its five naming fields, as in ``content_hash``."""
    return content_hash(entry_type, module, brief, trap_oid, alarm_id)


def local_hash(module: Column, brief: Column) -> Column:
    return F.sha2(F.concat(F.lit("local|"), F.upper(F.trim(module)), F.lit("|"), F.trim(brief)), 256)


def relevance(score: Column, reference: float = 100.0) -> Column:
    """An unbounded score as a share: its logarithm's of the reference's, at most 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log1p(score) / F.log1p(F.lit(reference))))
