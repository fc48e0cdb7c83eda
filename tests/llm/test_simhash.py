import random
import re

import numpy as np
import pytest
import xxhash
from helpers import awkward, empty

from syslumen.llm import simhash
from syslumen.llm._common import Shared
from syslumen.llm.components import components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def linked(values, radius=3):
    """Least index that links reach, by comparing all pairs."""
    label = list(range(len(values)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(values):
        for j in range(i):
            if bin(x ^ values[j]).count("1") <= radius:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(values))]


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(150)]
    for _ in range(100):
        own = rng.choice(texts).split()
        if own:
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own).upper())
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    fps = [plain(t) for t in texts]
    assert [found[i]["fp"] % (1 << 64) for i, _ in rows] == fps
    assert [found[i]["component_id"] for i, _ in rows] == linked(fps)


@pytest.mark.parametrize("finer", [(8, 12), ()])
def test_dense_clusters_and_split_trees(spark, monkeypatch, finer):
    monkeypatch.setattr(simhash, "TREE", 8)
    monkeypatch.setattr(simhash, "FINER", finer)
    rng, values = random.Random(2), set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(values | {rng.getrandbits(64) for _ in range(100)})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 3, len(values))
    roots = {r["a"]: r["b"] for r in components(links, Shared(spark)).collect()}
    groups, want = {}, linked(values)
    for k, v in enumerate(signed):
        groups.setdefault(roots.get(v, v), set()).add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_masks_share_one_for_any_three_bits():
    rng = random.Random(3)
    for count in (10, 10**8, 10**13):
        masks = simhash.masks(3, count)
        for _ in range(300):
            d = sum(1 << k for k in rng.sample(range(64), 3))
            assert any(not m & d for m in masks)


def test_awkward_rows(spark):
    found = simhash.near_duplicates(awkward(spark)).collect()
    assert len(found) == 8
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {(0, 1)}
    assert len(by[5]) == 1 and {c for _, c in by[5]} == {5}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (7, 7)], "a bigint, b bigint")
    roots = {r["a"]: r["b"] for r in components(edges, Shared(spark)).collect()}
    assert roots == {**dict.fromkeys(range(1, 201), 0), 500: 400}
