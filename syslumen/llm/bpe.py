"""Operator 3: byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The rank file becomes a sentencepiece BPE model without training: each token's bytes are mapped to
printable characters, one per byte, and the piece's score is the negated rank, so that the best-scored
merge is the one of lowest rank. Normalisation is the identity. Piece ids are the ranks; the piece that
stands for "unknown" comes after them and is never produced, as all 256 bytes are pieces. A text is cut
by the pre-token pattern, each distinct pre-token is encoded once per worker (a bounded memo), and
decoding looks up each id's bytes.

Defined cases: a null text counts as empty (no ids, empty bytes); extra columns are ignored (``encode``)
or kept (``with_digest``); repeated and empty rows are encoded like any other; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C

C.by_value(__name__)

#: Distinct pre-tokens that a worker remembers; beyond it the memo starts anew.
MEMO = 400_000


def parse_ranks(data: bytes) -> list[bytes]:
    """The tokens of a rank file in order of rank, which must be 0, 1, 2, ... without a gap."""
    found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in data.splitlines() if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0..n-1")
    return [found[k] for k in range(len(found))]


def byte_characters() -> str:
    """A distinct printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model with one piece for each token, id and rank alike."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = pb.TrainerSpec.BPE, len(tokens) + 1, len(tokens), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary, made once per worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens, self.cut = tokens, regex.compile(pattern).findall
        self.chars = byte_characters()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.memo: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = self.cut(text)
        new = set(pieces).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = set(pieces)
            new = list(new)
            coded = self.processor.encode([p.encode("utf-8").decode("latin-1").translate(self.table) for p in new], num_threads=1)
            self.memo.update((p, struct.pack(f"<{len(ids)}I", *ids)) for p, ids in zip(new, coded, strict=True))
        return b"".join(map(self.memo.__getitem__, pieces))

    @property
    def table(self) -> dict[int, str]:
        found = self.__dict__.get("_table")
        if found is None:
            found = self.__dict__["_table"] = {b: c for b, c in enumerate(self.chars)}
        return found

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def _mapper(ranks: bytes, pattern: str, text: str, keep: list[str], ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(parse_ranks(ranks), pattern)
        for batch in C.small_batches(batches, text):
            counts, lists, hashes, decoded, back = [], [], [], [], []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                packed = codec.packed(value or "")
                plain = codec.decode(packed)
                counts.append(len(packed) // 4)
                if ids:
                    lists.append(np.frombuffer(packed, dtype="<u4").astype(np.int32))
                    back.append(plain)
                else:
                    hashes.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(plain).hexdigest())
            own = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            made = [pa.array(lists, pa.list_(pa.int32())), pa.array(back, pa.binary())] if ids else [pa.array(hashes), pa.array(decoded)]
            names = ["token_ids", "decoded"] if ids else ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), *made], names=[*keep, "n_tokens", *names])

    return run


def _run(df: DataFrame, ranks: bytes, pattern: str, text: str, keep: list[str], ids: bool) -> DataFrame:
    made = {"n_tokens": "bigint"} | ({"token_ids": "array<int>", "decoded": "binary"} if ids else {"ids_sha256": "string", "decoded_sha256": "string"})
    # columns of these names give way; others go by place, whatever their names
    keep = [k for k in keep if k.lower() not in made]
    kept = df.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").cast("string"))
    kept = kept.toDF(*(f"c{k}" for k in range(len(keep))), "own")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "own"), *(f"{k} {v}" for k, v in made.items())])
    return kept.mapInArrow(_mapper(ranks, pattern, "own", kept.columns[:-1], ids), schema).toDF(*keep, *made)


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with ``n_tokens``, ``token_ids`` and ``decoded`` (the bytes that the ids stand for)."""
    return _run(df, ranks, pattern, text, keep if keep is not None else ["doc_id"], True)


def with_digest(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with ``n_tokens`` and the SHA-256 of the packed ids and of the decoded bytes."""
    return _run(df, ranks, pattern, text, keep if keep is not None else ["doc_id"], False)


def decode(df: DataFrame, ranks: bytes, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of ids stands for; a null list gives none. An id outside the vocabulary fails."""

    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = parse_ranks(ranks)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            made = pa.array([b"".join(tokens[k] for k in x or ()) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return C.map_whole(df, run, f"`{out}` binary")
