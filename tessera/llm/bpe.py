"""Byte-level BPE encoding and decoding by a rank file, one segment tree for each pre-token.

The tree's leaves are the byte positions where a live token starts; a leaf holds the rank of the pair that starts there
together with the position, so that the root is the leftmost pair of the lowest rank. A merge changes three leaves:
the right token's leaf dies, the merged token's and its left neighbour's pairs get new ranks. A pre-token of n bytes
takes O(n log n), also where there is no white space for megabytes.

Null texts count as empty (no ids). Repeated rows give repeated results. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, strings

_NONE = 1 << 62
#: Pre-tokens that a process remembers; then it starts anew. Long ones are not remembered.
CACHE, CACHE_LENGTH = 900_000, 32


class Codec:
    """Ranks of one file, with the pre-tokens this process has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.token = {i: t for t, i in ranks.items()}
        # White space as Unicode defines it: the regex module's \s has four control characters more.
        space = r"\t-\r \x85\xa0  -     　"
        pattern = pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")
        self.pieces = regex.compile(pattern, regex.V0).findall
        self.known = _Known(self)

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece) if n <= self.longest else None
        if whole is not None:
            return (whole,)
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        get, longest = ranks.get, self.longest
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))

        def put(i: int, key: int) -> None:
            i += size
            tree[i] = key
            while i > 1:
                a = tree[i ^ 1]
                if a < key:
                    key = a
                i >>= 1
                if tree[i] == key:
                    return
                tree[i] = key

        while (top := tree[1]) < _NONE:
            i = top & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            put(j, _NONE)
            after[i] = k
            if k < n:
                before[k] = i
                end = after[k]
                r = get(piece[i:end]) if end - i <= longest else None
                put(i, _NONE if r is None else r << 32 | i)
            else:
                put(i, _NONE)
            if i:
                p = before[i]
                r = get(piece[p:k]) if k - p <= longest else None
                put(p, _NONE if r is None else r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Known(dict):
    """ids by pre-token, worked out when first asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.codec.merged(piece.encode())
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


@cache
def codec(file: str) -> Codec:
    """One Codec for each process and file."""
    import public_tokenizers

    with open(public_tokenizers.path(file), "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
    return Codec(ranks, public_tokenizers.PATTERN)


def encode(docs: DataFrame, file: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.encode(t) for t in strings(b, 1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, content binary: the bytes of each row's ids. Null ids count as none; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, content binary")


def round_trip(docs: DataFrame, file: str = "byte_bpe_multi_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        shown = {i: str(i) for i in c.token}.__getitem__
        for b in batches:
            n, ids_sha, out_sha = [], [], []
            for t in strings(b, 1):
                ids = c.encode(t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(shown, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
