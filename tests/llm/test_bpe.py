import base64
import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from helpers import awkward, empty

from syslumen.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def test_ids_equal_tiktoken_on_random_text(ranks, reference):
    codec, rng = bpe.Codec(bpe.parse_ranks(ranks), P.PATTERN), random.Random(4)
    kinds = [(1, 128), (128, 0x800), (0x800, 0xD800), (0xE000, 0x110000)]
    texts = ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(200))) for _ in range(200)]
    texts += ["", "a" * 3000, " " * 50 + "\n\n x", "aaaabbbb" * 50, "<unk> <s> ▁▁ Ġ"]
    for t in texts:
        packed = codec.packed(t)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == reference.encode_ordinary(t)
        assert codec.decode(packed) == t.encode()


def test_every_token_that_is_one_match_encodes_to_itself(ranks, reference):
    codec = bpe.Codec(bpe.parse_ranks(ranks), P.PATTERN)
    for token in codec.tokens:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        packed = codec.packed(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == reference.encode_ordinary(text)


def test_awkward_rows(spark, ranks, reference):
    rows = bpe.with_digest(awkward(spark), ranks, P.PATTERN).collect()
    assert len(rows) == 8
    nothing = hashlib.sha256(b"").hexdigest()
    for r in rows:
        if r["doc_id"] in (1, 2):
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, nothing, nothing)
    long = next(r for r in rows if r["doc_id"] == 4)
    assert long["n_tokens"] == len(reference.encode_ordinary("word " * 60_000))
    assert long["decoded_sha256"] == hashlib.sha256(b"word " * 60_000).hexdigest()
    assert bpe.with_digest(empty(spark), ranks, P.PATTERN).count() == 0


def test_round_trip_through_columns(spark, ranks):
    made = bpe.encode(awkward(spark), ranks, P.PATTERN, keep=["doc_id", "text"])
    for r in bpe.decode(made.drop("decoded"), ranks).collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert len(r["token_ids"]) == r["n_tokens"]


def test_ranks_must_have_no_gap():
    with pytest.raises(ValueError):
        bpe.parse_ranks(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"b") + b" 2\n")
