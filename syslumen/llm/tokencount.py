"""Operator 5: token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The vocabulary's pieces are weighed by Zipf's law: the k-th piece (from 0) has the log-probability
-ln((k + 1) H), H the sum of 1 / (k + 1). A pre-token is a run of characters other than white space with
the mark U+2581 before it; its count is that of its best segmentation, the one of the highest summed
log-probability and, of equal ones, the fewest tokens. A character that no piece covers costs as many
tokens as it has UTF-8 bytes, each as unlikely as the last piece divided by e^10.

The distinct pre-tokens of a block of texts are inserted in a trie. Forward scores and counts stay with the nodes, so that those
of a prefix are worked out once for all pre-tokens that share it, and each terminal node holds its pre-token's count; a text's
count is the sum over its pre-tokens. A worker's trie is bounded, and starts anew beyond ``NODES``. White space itself counts
nothing. Zipf weights stand in for a trained model, as tokenizers aren't trained here.

Defined cases: a null or empty text, or one of white space only, has no tokens; repeated rows are counted
alike; an empty table gives none; other columns are not looked at; pre-tokens of more than ``LONG`` characters are whole too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from copy import copy
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syslumen.llm import _common as C

C.by_value(__name__)

MARK = "▁"
#: Nodes of a worker's trie; beyond it the trie starts anew.
NODES = 800_000
#: Characters of a pre-token up to which it goes into the trie.
LONG = 256


def pieces_of(model: bytes) -> list[str]:
    """The normal pieces of a sentencepiece model, in its order."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [p.id_to_piece(k) for k in range(p.get_piece_size()) if not (p.is_unknown(k) or p.is_control(k) or p.is_byte(k) or p.is_unused(k))]


class Unigram:
    def __init__(self, pieces: list[str]):
        total = sum(1 / (k + 1) for k in range(len(pieces)))
        self.score: dict[str, float] = {}
        for k, piece in enumerate(pieces):
            self.score.setdefault(piece, -log((k + 1) * total))
        self.byte = -log((len(pieces) + 1) * (total or 1)) - 10
        # lengths that pieces with some last character have
        ending: dict[str, set[int]] = {}
        for piece in self.score:
            if piece:
                ending.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(n) for c, n in ending.items()}
        self.start_anew()

    def start_anew(self) -> None:
        """A trie of the root alone: edges by node and character, and of each node the best score, its number of tokens, and the count if a word ends there; and the nodes that words end at."""
        self.edges: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[int, int] = {}
        self.ends: dict[str, int] = {}
        # the word inserted last, and along its path the nodes, scores and numbers of tokens
        self.last: tuple[str, list[int], list[float], list[int]] = ("", [0], [0.0], [0])

    def insert(self, word: str) -> int:
        """The number of tokens of a word, which stays with the node that it ends at; only prefixes that no word before had are scored."""
        token, shared, edges = MARK + word, 0, self.edges
        best, tokens, score, lengths = self.best, self.tokens, self.score, self.lengths
        before, nodes, high, few = self.last
        for x, y in zip(token, before, strict=False):
            if x != y:
                break
            shared += 1
        del nodes[shared + 1 :], high[shared + 1 :], few[shared + 1 :]
        node = nodes[shared]
        for char in token[shared:]:
            below = edges.get(node * 0x110000 + ord(char))
            if below is None:
                break
            node, shared = below, shared + 1
            nodes.append(node)
            high.append(best[node])
            few.append(tokens[node])
        for at in range(shared + 1, len(token) + 1):
            last = token[at - 1]
            n = 1 if last < "\x80" else len(last.encode("utf-8", "surrogatepass"))
            most, least = high[at - 1] + n * self.byte, few[at - 1] + n
            for size in lengths.get(last, ()):
                if size > at:
                    break
                own = score.get(token[at - size : at])
                if own is not None:
                    own += high[at - size]
                    if own > most or (own == most and few[at - size] + 1 < least):
                        most, least = own, few[at - size] + 1
            edges[node * 0x110000 + ord(last)] = node = len(best)
            best.append(most)
            tokens.append(least)
            nodes.append(node)
            high.append(most)
            few.append(least)
        self.last = (token, nodes, high, few)
        self.ends[word] = node
        return self.terminal.setdefault(node, tokens[node])

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """The number of tokens of each distinct word. Very long words have a trie of their own, for a while."""
        out = {}
        for word in words:
            if word in self.ends:
                out[word] = self.terminal[self.ends[word]]
                continue
            if len(word) > LONG:
                other = copy(self)
                other.start_anew()
                out[word] = other.insert(word)
                continue
            if len(self.best) > NODES:
                self.start_anew()
            out[word] = self.insert(word)
        return out

    def of_texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        split = [t.split() for t in texts]
        # sorted, so that the next word goes on from the path of the last
        found = self.counts(sorted({w for words in split for w in words}))
        return [(len(words), sum(map(found.__getitem__, words))) for words in split]


def count_tokens(df: DataFrame, pieces: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(pieces)
        for batch in C.small_batches(batches, most=4 << 20):
            made = model.of_texts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    kept = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint")
