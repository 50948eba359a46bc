"""Exact byte-level BPE encoding in linear time, and decoding.

The vocabulary's byte strings, as Latin-1 text, form an Aho-Corasick automaton
(pyahocorasick) that finds every token in a piece in one pass. Encoding takes
the longest token at each place that fits the token before it, and falls back
to the next shorter one, or one step back, where none fits. Two adjacent tokens
fit if merging by rank could never have joined bytes across their border; that
answer is memoised per pair, and the ids of each piece are memoised too. Such a
sequence of fitting tokens is unique, so it equals what merging by rank gives.

Nulls: a null text is encoded as an empty one and has no ids. Texts of any
length are encoded whole. Repeated rows are encoded alike; an empty table gives
no rows. Columns named like the outputs are replaced, others are kept.
"""

from __future__ import annotations

import base64
import functools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table
from .pieces import TextEncoder, packed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pairs of tokens whose compatibility a worker remembers: about 50 MB.
MEMO_PAIRS = 500_000
FIELDS = [
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType()),
]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    """Encodes pieces by the ranks of a vocabulary that has all single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.fit_memo: dict[int, bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.shorter[rank] = next(
                (ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None
            )
            self.parts[rank] = self._parts(token, rank)
            if self.parts[rank]:
                self.merged[self.parts[rank]] = rank
        self.fit_memo.clear()

    def _parts(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a token that no merge makes."""
        for n in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:n]), self.ranks.get(token[n:])
            if left is not None and right is not None and left < rank and right < rank and self._fits(left, right):
                return left, right
        return None

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps a border between these tokens.

        Merges are undone latest first, on the side of the border where the
        later one is; a token that joins the two innermost parts and was due
        before the merges undone so far would have crossed the border.
        """
        due = None
        while True:
            across = self.merged.get((left, right))
            if across is not None and (due is None or across < due):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # Of equal merges the left one comes first, so the right one is undone first.
            if a is not None and (b is None or left > right):
                due, left = left, a[1]
            else:
                due, right = right + 1, b[0]

    def fits(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        found = self.fit_memo.get(pair)
        if found is None:
            if len(self.fit_memo) >= MEMO_PAIRS:
                self.fit_memo.clear()
            found = self.fit_memo[pair] = self._fits(left, right)
        return found

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest: list[int] = [0] * n
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the longest stays
        token, shorter, fits = self.token, self.shorter, self.fits
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)  # places not yet known to be dead ends
        at, candidate = 0, longest[0]
        while at < n:
            while candidate is not None:
                end = at + len(token[candidate])
                if open_[end] and (not out or fits(out[-1], candidate)):
                    break
                candidate = shorter[candidate]
            if candidate is None:
                open_[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                candidate = out.pop()
                at -= len(token[candidate])
            else:
                out.append(candidate)
                at = end
                candidate = longest[at] if at < n else None
        return out


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[TextEncoder, dict[int, bytes]]:
    bpe = ByteBPE(read_ranks(path))
    return TextEncoder(lambda piece: packed(bpe.encode(piece.encode()))), bpe.token


def encode_decode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with n_tokens, ids (little-endian unsigned 32-bit) and decoded, the bytes the ids stand for."""

    def make():
        encode, token = _loaded(path)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = [encode(t) if t else b"" for t in batch.column(text_col).to_pylist()]
            decoded = [b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]

        return compute

    return append_columns(df, FIELDS, make)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(documents, public_tokenizers.path(VOCABULARY)))
