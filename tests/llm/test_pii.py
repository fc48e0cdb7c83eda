import re
from datetime import date

import pytest
from helpers import awkward, empty
from pyspark.sql import functions as F

from syslumen.llm import pii


KEY = "for tests"


def luhn(s):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def made(spark, *texts):
    rows = pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), KEY).collect()
    return [(r["text"], r["n_replaced"]) for r in rows]


def test_feistel_is_a_permutation(spark):
    for a, b in ((7, 11), (189, 773), (1, 5), (10, 100)):
        found = spark.range(a * b).select(pii.feistel(F.col("id"), a, b, "k", "t").alias("v")).collect()
        assert sorted(r["v"] for r in found) == list(range(a * b))


def test_formats_and_checks_stay(spark):
    texts = {
        r"\d{4} \d{4} \d{4} \d{4}": "4111 1111 1111 1111", r"\d{15}": "378282246310005", r"\d{4}-\d{2}-\d{2}": "2024-02-29", r"\d{2}/\d{2}/\d{4}": "31/12/1999",
        r"\d{2}\.\d{2}\.\d{4}": "01.03.1850", r"\+1 \(\d{3}\) \d{3}-\d{4}": "+1 (234) 555-7713", r"\d{3}-\d{2}-\d{4}": "123-45-6789", r"(?:\d{1,3}\.){3}\d{1,3}": "10.1.2.255",
        r"[0-9A-F]{40}": "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", r"user\.[0-9a-f]{12}@[0-9a-f]{8}\.example": "someone.34@mail7.example.com",
    }
    for form, own in texts.items():
        (text, n), = made(spark, f"before {own}!! and {own}, after")
        first, second = re.fullmatch(f"before ({form})!! and ({form}), after", text).groups()
        assert n == 2 and first == second != own
        if form.startswith(r"\d{4} ") or form == r"\d{15}":
            assert luhn(re.sub(" ", "", first))
        if form == r"\d{4}-\d{2}-\d{2}":
            date.fromisoformat(first)


def test_equal_values_are_linked_across_formats_and_documents(spark):
    a, b, c = (t for t, _ in made(spark, "on 1999-12-31", "on 31/12/1999", "on 31.12.1999"))
    y, m, d = a[3:].split("-")
    assert b == f"on {d}/{m}/{y}" and c == f"on {d}.{m}.{y}"
    a, b = (t for t, _ in made(spark, "4111111111111111", "4111 1111 1111 1111"))
    assert a == b.replace(" ", "")


def test_what_fails_its_check_stays(spark):
    for own in ("4111111111111112", "2023-02-30", "1.2.3.4.5", "256.1.1.1", "000-12-3456", "666-12-3456", "12345678901234567890", "GPL version 3.0", "4.0", "0123456789abcdef", "a@b"):
        assert made(spark, own) == [(own, 0)]


def test_key_changes_pseudonyms(spark):
    df = spark.createDataFrame([("4111111111111111",)], "text string")
    assert pii.pseudonymise(df, "one").head()[0] != pii.pseudonymise(df, "two").head()[0]


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = pii.pseudonymise(df, KEY).drop("n_replaced")
    assert rows.columns == df.columns
    key = lambda r: str(r)
    assert sorted(rows.collect(), key=key) == sorted(df.collect(), key=key)
    assert pii.pseudonymise(empty(spark), KEY).count() == 0


# ---- the whole operator in plain Python

import hashlib  # noqa: E402
import os  # noqa: E402
from datetime import timedelta  # noqa: E402

import regex  # noqa: E402

SF = os.environ.get("SYSLUMEN_TEST_SF", "/root/testdata/sf0.001")


def digest(*parts):
    return hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()


def permute(x, a, b, kind):
    left, right = divmod(x, b)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + int(digest(kind, i, a, b, right)[:15], 16)) % a
        else:
            right = (right + int(digest(kind, i, a, b, left)[:15], 16)) % b
    return left * b + right


def permute_digits(s, kind):
    half = len(s) // 2
    return str(permute(int(s), 10**half, 10 ** (len(s) - half), kind)).zfill(len(s))


def fill(form, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in form)


def plain(m):
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        h = digest("email", m.lower())
        return f"user.{h[:12]}@{h[12:20]}.example"
    if re.fullmatch("[0-9A-Fa-f]{32,}", m):
        base = digest("secret", m.lower())
        made = "".join(digest("secret", i, base) for i in range((len(m) - 1) // 64 + 1))[: len(m)]
        return made.upper() if m == m.upper() else made
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        v = permute(int.from_bytes(bytes(o), "big"), 1 << 16, 1 << 16, "ipv4")
        return ".".join(map(str, v.to_bytes(4, "big")))
    for form, order in ((r"(\d{4})-(\d\d)-(\d\d)", (1, 2, 3)), (r"(\d\d)/(\d\d)/(\d{4})", (3, 2, 1)), (r"(\d\d)\.(\d\d)\.(\d{4})", (3, 2, 1))):
        if k := re.fullmatch(form, m):
            try:
                day = (date(*(int(k[g]) for g in order)) - date(1800, 1, 1)).days
            except ValueError:
                return m
            if not 0 <= day < 189 * 773:
                return m
            to = date(1800, 1, 1) + timedelta(permute(day, 189, 773, "date"))
            return f"{to:%Y-%m-%d}" if order[0] == 1 else f"{to.day:02d}{m[2]}{to.month:02d}{m[2]}{to.year}"
    if m.startswith("+"):
        return fill(m, digits[:-10] + permute_digits(digits[-10:], "phone"))
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return m
        v = permute((area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        i, rest = divmod(v, 99 * 9999)
        return f"{i + 1 + (i >= 665):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    if not luhn(digits):
        return m
    payload = permute_digits(digits[:-1], "card")
    return fill(m, payload + next(c for c in "0123456789" if luhn(payload + c)))


def test_equals_plain_python_on_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = "a@b.cc 1999-01-31 31.12.2000 01/02/1803 300.1.1.1 1.1.1.1 +44 123 456-7890 899-99-9999 001-01-0001 4111-1111-1111-1111 378282246310005 2021-13-01"
    docs = docs.unionByName(spark.createDataFrame([(10**6, more), (10**6 + 1, more.replace(" ", "\n, "))], docs.schema))
    pattern = regex.compile(pii.ANY)
    for r in pii.pseudonymise(docs, KEY).join(docs.withColumnRenamed("text", "own"), "doc_id").collect():
        assert r["text"] == pattern.sub(lambda m: plain(m[0]), r["own"])
        assert r["n_replaced"] == sum(plain(m) != m for m in pattern.findall(r["own"]))


def test_phones_in_any_grouping(spark):
    for own, code in {"+14155550100": "+1", "+44 20 7946 0958": "+44", "+33 6 12 34 56 78": "+33", "+33.6.12.34.56.78": "+33", "+353 1 234 5678": "+353", "+49 (0)30 1234567": "+49"}.items():
        (text, n), = made(spark, f"call {own}, now")
        found = text.removeprefix("call ").removesuffix(", now")
        assert n == 1 and found != own and found.startswith(code) and re.sub(r"\d", "0", found) == re.sub(r"\d", "0", own)
    a, b = (re.sub(r"\D", "", t) for t, _ in made(spark, "+14155550100", "+1 (415) 555-0100"))
    assert a == b
    for own in ("+1234567", "+1234567890123456"):
        assert made(spark, own) == [(own, 0)]


def test_dates_with_the_month_first(spark):
    from datetime import timedelta

    days = [date(1800, 1, 1) + timedelta(k) for k in range(146_097)]
    own = {d.strftime("%m/%d/") + f"{d.year:04}" for d in days if d.day > 12 and d.year == 2000 and d.month in (1, 2, 12)}
    found = made(spark, *sorted(own))
    assert len({t for t, _ in found}) == len(own) and sum(n for _, n in found) >= len(own) - 2
    for t, _ in found:
        month, day, year = map(int, t.split("/"))
        assert day > 12 and 1800 <= year < 2200 and date(year, month, day)
    (text, n), = made(spark, "on 12/31/2020 and 13/13/2020")
    assert n == 1 and text.endswith(" and 13/13/2020")


def test_long_texts_and_letters_only(spark):
    host, letters, digits = "a@b" + ".c" * 1_000_000, "abcdefab" * 4, "1" * 1_000_000
    found = made(spark, host, f"key {letters} here", digits, "+" * 1_000_000, "1." * 1_000_000, "f" * 300_000, "+1 2 3 4 5 6" * 100_000)
    assert found[0][1] == 1 and found[0][0].endswith(".example")
    assert found[1][1] == 1 and letters not in found[1][0] and len(found[1][0]) == len(f"key {letters} here")
    assert found[2][1] == 1 and len(found[2][0]) == len(digits)
    assert found[3] == ("+" * 1_000_000, 0) and found[4] == ("1." * 1_000_000, 0)
    assert found[5][1] == 1 and len(found[5][0]) == 300_000


def test_marks_within_texts_and_columns_with_inner_names(spark):
    own = "\x01\x03 4111 1111 1111 1111\x01 and \x01\x02 1999-12-31 \x02"
    df = spark.createDataFrame([(own, "x", "y", "z")], "text string, parts_ string, MADE_ string, n_replaced string")
    made_ = pii.pseudonymise(df, KEY)
    row = made_.head()
    assert made_.columns == ["text", "parts_", "MADE_", "n_replaced"] and row["n_replaced"] == 2 and row["parts_"] == "x"
    assert re.fullmatch("\x01\x03 \\d{4} \\d{4} \\d{4} \\d{4}\x01 and \x01\x02 \\d{4}-\\d\\d-\\d\\d \x02", row["text"])


def test_a_key_is_asked_for(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(empty(spark), "")
