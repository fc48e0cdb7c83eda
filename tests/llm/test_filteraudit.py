"""The audit of filters against filtering every document in every order."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import helpers

from syslumen.llm import filteraudit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(rows):
    """The letters of the filters that each row fails."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        failed = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        out.append({k for k, v in failed.items() if v})
    return out


def plain(rows, good, toxic):
    found, failed = {}, failures(rows)
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, failed, strict=True) if (p or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                shapley[f] += len(gone)
                found[part, "".join(order), step] = [len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return found


def audited(docs, labels):
    rows = filteraudit.audit(docs, labels).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in rows}
    assert len(found) == len(rows)
    return found


def test_every_order_of_every_part(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "GAMMA", "d#lta", "the", "of", "naïve", "日本"]
    texts = [" ".join(rng.choices(words[: rng.randint(1, 8)], k=rng.choice([3, 20, 60, 90]))) for _ in range(60)]
    texts += [" ".join(f"word{k}" for k in range(n)) for n in (49, 50, 51, 80)] + ["", None, "\x0b \x1c", "A" * 5 + "b" * 95, "A" * 6 + "b" * 94]
    rows = [(k if k % 17 else None, rng.choice(texts), rng.choice(["a", "b", "", None, "c"])) for k in range(400)] + [(7, "twice", "a"), (7, "twice", "a"), (9, "twice", "b")]
    marks = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 400, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, A int, part string").repartition(6)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    want = plain(rows, {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, t in marks if t == 1 and i is not None})
    assert audited(docs, labels) == want
    assert len(want) == 600 * 4


def test_hot_copies_and_ids_are_joined_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(filteraudit.C, "HOT_ROWS", 5)
    rows = [(k, "copy", "a") for k in range(40)] + [(3, f"text {k}", "b") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(3, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert audited(docs, labels) == plain(rows, {3}, {3, 5})


def test_awkward_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = audited(helpers.awkward(spark), labels)
    assert found == plain([(r[0], r[1], r[3]) for r in helpers.AWKWARD], set(), set())
    assert audited(helpers.empty(spark), labels) == {}
