"""Operator 1: format-preserving pseudonyms for personal data, in DataFrame functions only.

Found and replaced, whatever the language: e-mail addresses, hexadecimal secrets of 32 digits or more,
IPv4 addresses (octets up to 255), dates (yyyy-MM-dd, dd/MM/yyyy, dd.MM.yyyy, and MM/dd/yyyy where dd/MM doesn't exist;
that exist, 1800 to 2199), telephone numbers with + and 8 to 15 digits in any grouping (the country code stays), US social security numbers (areas, groups and serials that are
issued) and payment cards (13 to 19 digits, Luhn). What doesn't pass its check stays as it is.

Numbers and dates are permuted by a keyed Feistel network over exactly the numbers that are valid in
their format: halves in mixed radix, round values from SHA-256 of key, kind, round and half. So distinct
values stay distinct, equal values get equal pseudonyms in every document, and pseudonyms pass the same
checks (a card's check digit is made anew; dates permute within a 400-year cycle of 189 x 773 days, those with the month
first among its 9 x 9833 days after the 12th of a month).
Separators and brackets stay in place. E-mail addresses and secrets get keyed digests instead.

Each text is handled in its own row: one pass marks the matches, which are cut out, replaced one by one and joined with what lay
between, so that a pseudonym is never looked at again. No pattern repeats a group without bound but possessively, so that a long
text needs no deep stack.

The key is asked for, as who has it can turn numbers and dates back. It is a literal of the plan: set
``spark.sql.redaction.string.regex`` where plans are logged.

DuckDB's regular expressions know neither look-around nor possessive quantifiers, so SQL can't express it;
tests compare it with the same in plain Python.

Defined cases: a null text stays null with no replacements; an empty one stays empty; repeated rows get the
same result; all other columns are kept, whatever their names, but for ``n_replaced``, which the count replaces; an empty table
gives none. Addresses are permuted as numbers: spellings of one address with and without leading zeros get the same pseudonym.
``n_replaced`` counts what passes its check, also if the permutation leaves it as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C

ROUNDS = 8

EMAIL = r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-]|\.\d)"
#: A country code and ten digits, whose place tells the code; and any grouping, whose code is that of the numbering plan.
PHONE_TEN = r"(?<![\d+])\+\d{1,3}[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]\d{4}(?!\d)"
PHONE_ANY = r"(?<![\d+])\+[1-9](?:[ ./()-]{0,2}\d){7,14}(?!\d)"
PHONE = f"{PHONE_TEN}|{PHONE_ANY}"
_TWO_DIGITS = "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
#: What begins with a digit or a plus; nearly all places are passed over by the first look at one character.
NUMBERS = f"(?=[0-9+])(?:{'|'.join((IPV4, DATE, PHONE, SSN, CARD))})"
WITHOUT_EMAIL = f"{SECRET}|{NUMBERS}"
ANY = f"{EMAIL}|{WITHOUT_EMAIL}"
#: Texts without any of these hold nothing to replace.
SOME = "[0-9@]|[A-Fa-f]{32}"
#: Around a match come MARK and END; a MARK that is in the text is followed by OWN meanwhile.
MARK, OWN, END = "\x01", "\x02", "\x03"


def _digest(key: str, kind: str, *parts: Column | int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def _div(x: Column, y: Column | int) -> Column:
    return F.call_function("div", x, y if isinstance(y, Column) else F.lit(y)).cast("bigint")


def feistel(x: Column, left: Column | int, right: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1 (which must be below 2^63)."""
    a, b = (v.cast("bigint") if isinstance(v, Column) else F.lit(v).cast("bigint") for v in (left, right))
    value = lambda i, half: F.conv(F.substring(_digest(key, kind, i, a, b, half), 1, 15), 16, 10).cast("bigint")

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + F.pmod(value(i, s["r"]), a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(value(i, s["l"]), b), b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(_div(x, b).alias("l"), F.pmod(x, b).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by those of ``digits``."""
    one = lambda i: F.substr(form, i, F.lit(1))
    so_far = lambda i: F.length(_digits(F.substr(form, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(one(i).rlike("[0-9]"), F.substr(digits, so_far(i), F.lit(1))).otherwise(one(i))), "")


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("bigint")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("bigint"), _power(half), _power(n - half), key, kind).cast("string"), n, "0")


def luhn(digits: Column) -> Column:
    """The weighted sum of a number's digits, of which every second from the right, but the last, counts twice."""
    at = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(at(i))).otherwise(at(i)))


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    payload = permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(10 - luhn(F.concat(payload, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(luhn(digits) % 10 == 0, _filled(m, F.concat(payload, check)))


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    plan = F.when(digits.rlike("^[17]"), 1).when(digits.rlike(_TWO_DIGITS), 2).otherwise(3)
    country = F.when(m.rlike(f"^(?:{PHONE_TEN})$"), F.length(digits) - 10).otherwise(plan)
    return _filled(m, F.concat(F.substr(digits, F.lit(1), country), permuted_digits(F.substr(digits, country + 1, F.length(digits) - country), key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    part = lambda at, n: F.substring(m, at, n).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    per = 99 * 9999
    number = (F.when(area > 666, area - 2).otherwise(area - 1)).cast("bigint") * per + (group - 1) * 9999 + serial - 1
    made = feistel(number, 898, per, key, "ssn")
    index, rest = _div(made, per), F.pmod(made, F.lit(per))
    text = F.concat_ws("-", F.lpad(F.when(index >= 665, index + 2).otherwise(index + 1).cast("string"), 3, "0"), F.lpad((_div(rest, 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(rest, F.lit(9999)) + 1).cast("string"), 4, "0"))
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), text)


def _ipv4(m: Column, key: str) -> Column:
    octet = lambda k: F.get(F.split(m, r"\."), F.lit(k)).cast("bigint")
    made = feistel(octet(0) * (1 << 24) + octet(1) * (1 << 16) + octet(2) * (1 << 8) + octet(3), 1 << 16, 1 << 16, key, "ipv4")
    text = F.concat_ws(".", *(F.pmod(_div(made, 1 << s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)))
    return F.when((octet(0) < 256) & (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256), text)


def _date(m: Column, form: str, key: str) -> Column:
    day = F.try_to_timestamp(m, F.lit(form)).cast("date")
    number = F.datediff(day, F.lit("1800-01-01").cast("date")).cast("bigint")
    made = F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), feistel(number, 189, 773, key, "date").cast("int")), form)
    return F.when((number >= 0) & (number < 189 * 773), made)


def _month_first(m: Column, key: str) -> Column:
    """A date that exists with the month first only: a permutation of those, the days after the 12th of a month."""
    first = F.lit("1800-01-01").cast("date")
    day = F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).cast("date")
    month = (F.year(day) - 1800) * 12 + F.month(day) - 1
    number = (F.datediff(day, first) - 12 * (month + 1)).cast("bigint")
    before = lambda k: F.datediff(F.add_months(first, k), first) - 12 * k
    made = feistel(number, 9, 9833, key, "month first")

    def date_of(x: Column) -> Column:
        # months have 16 to 19 such days, so that the mean gives the month or a neighbour
        guess = _div(x * 4800, 88_497).cast("int")
        k = F.when(before(guess + 1) <= x, guess + 1).when(before(guess) <= x, guess).otherwise(guess - 1)
        return F.date_format(F.date_add(F.add_months(first, k), (x - before(k) + 12).cast("int")), "MM/dd/yyyy")

    text = F.get(F.transform(F.array(made), date_of), F.lit(0))
    return F.when(F.year(day).between(1800, 2199), text)


def _secret(m: Column, key: str) -> Column:
    # as many digests as the length asks for, in the case of the original
    digests = lambda base: F.array_join(F.transform(F.sequence(F.lit(0), _div(F.length(m) - 1, 64).cast("int")), lambda i: _digest(key, "secret", i, base)), "")
    made = F.substr(F.get(F.transform(F.array(_digest(key, "secret", F.lower(m))), digests), F.lit(0)), F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(made)).otherwise(made)


def _email(m: Column, key: str) -> Column:
    made = _digest(key, "email", F.lower(m))
    return F.concat(F.lit("user."), F.substring(made, 1, 12), F.lit("@"), F.substring(made, 13, 8), F.lit(".example"))


def pseudonym(m: Column, key: str) -> Column:
    """What replaces a match of ``ANY``; null where it doesn't pass its check."""
    like = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(like(r"[0-9A-Fa-f]{32,}"), _secret(m, key))
        .when(like(r"\d{1,3}(?:\.\d{1,3}){3}"), _ipv4(m, key))
        .when(like(r"\d{4}-\d{2}-\d{2}"), _date(m, "yyyy-MM-dd", key))
        .when(like(r"\d{2}/\d{2}/\d{4}"), F.when(F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).isNull(), _month_first(m, key)).otherwise(_date(m, "dd/MM/yyyy", key)))
        .when(like(r"\d{2}\.\d{2}\.\d{4}"), _date(m, "dd.MM.yyyy", key))
        .when(m.startswith("+"), _phone(m, key))
        .when(like(r"\d{3}-\d{2}-\d{4}"), _ssn(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with personal data in ``text`` replaced, and ``n_replaced``, the number of replacements."""
    if not key:
        raise ValueError("pseudonyms need a key")
    own = F.col(f"`{text}`")
    parts, made = C.fresh(df, "parts_", "made_")
    plain = F.when(own.contains(MARK), F.replace(own, F.lit(MARK), F.lit(MARK + OWN))).otherwise(own)
    marked = lambda pattern: F.regexp_replace(plain, f"({pattern})", f"{MARK}{END}$1{MARK}{END}")
    found = F.when(own.contains("@"), marked(ANY)).otherwise(marked(WITHOUT_EMAIL))
    # gaps and matches by turns
    cut = df.withColumn(parts, F.when(own.rlike(SOME), F.split(found, MARK + END, -1)))
    cut = cut.withColumn(made, F.when(F.size(parts) > 1, F.transform(parts, lambda p, i: F.when(i % 2 == 1, pseudonym(p, key)))))
    joined = F.array_join(F.zip_with(parts, made, lambda p, m: F.coalesce(m, p)), "")
    joined = F.when(own.contains(MARK), F.replace(joined, F.lit(MARK + OWN), F.lit(MARK))).otherwise(joined)
    count = F.size(F.filter(made, lambda m: m.isNotNull()))
    kept = [c for c in df.columns if c.lower() != "n_replaced"]
    return cut.select(*(F.when(F.col(made).isNull(), own).otherwise(joined).alias(c) if c == text else F.col(f"`{c}`") for c in kept), F.when(F.col(made).isNull(), 0).otherwise(count).alias("n_replaced"))
