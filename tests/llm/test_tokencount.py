import functools
import random

import public_tokenizers as P
from helpers import awkward, empty

from syslumen.llm import tokencount as T


def brute(model, token):
    @functools.lru_cache(None)
    def best(i):
        if not i:
            return 0.0, 0
        n = len(token[i - 1].encode())
        options = [(best(i - 1)[0] + n * model.byte, -best(i - 1)[1] - n)]
        options += [(best(j)[0] + model.score[token[j:i]], -best(j)[1] - 1) for j in range(i) if token[j:i] in model.score]
        score, few = max(options)
        return score, -few

    return best(len(token))[1]


def test_counts_equal_each_words_own_programme():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = T.Unigram(T.pieces_of(f.read()))
    rng = random.Random(1)
    words = {"".join(rng.choice("abetionré日😀-1") for _ in range(rng.randrange(1, 14))) for _ in range(2000)}
    assert model.counts(words) == {w: brute(model, T.MARK + w) for w in words}


def test_the_trie_may_start_anew(monkeypatch):
    monkeypatch.setattr(T, "NODES", 3)
    model = T.Unigram(["▁a", "▁", "a", "b", "ab"])
    assert model.of_texts(["a b", "ab ab ba"]) == model.of_texts(["a b", "ab ab ba"]) == T.Unigram(["▁a", "▁", "a", "b", "ab"]).of_texts(["a b", "ab ab ba"])


def test_shared_prefixes_are_scored_once_and_long_words_apart(monkeypatch):
    model = T.Unigram(["▁a", "▁", "a", "b", "ab"])
    model.counts(["abab", "abba", "ab"])
    # the root, the mark, and a, b, a, b, b, a
    assert len(model.best) == 8 and len(model.terminal) == 3
    long = "ab" * 5000 + "é"
    assert model.counts([long]) == {long: brute_count(model, T.MARK + long)} and len(model.best) == 8


def brute_count(model, token):
    best = [(0.0, 0)]
    for i in range(1, len(token) + 1):
        n = len(token[i - 1].encode())
        options = [(best[i - 1][0] + n * model.byte, -best[i - 1][1] - n)]
        options += [(best[j][0] + model.score[token[j:i]], -best[j][1] - 1) for j in range(max(0, i - 3), i) if token[j:i] in model.score]
        score, few = max(options)
        best.append((score, -few))
    return best[-1][1]


def test_awkward_rows(spark):
    pieces = ["▁", "▁word", "e", "t"]
    rows = T.count_tokens(awkward(spark), pieces).collect()
    by = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in rows}
    assert len(rows) == 8 and by[1] == by[2] == by[3] == (0, 0) and by[4] == (60_000, 60_000)
    assert T.count_tokens(empty(spark), pieces).count() == 0
