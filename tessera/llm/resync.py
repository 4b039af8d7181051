"""Token counts of whole texts by a public tokenizer; huge texts in overlapping chunks that are joined where they provably agree.

A boundary between a letter or digit and a following blank or line break is the end of a pre-token wherever the text
starts or stops, as no pre-token of the byte-level pattern holds white space after anything else. Two neighbouring
chunks are cut at such a place inside their overlap, far enough from the left chunk's end that its look-ahead is the
same as in the whole text, where both give a token boundary and the same tokens beside it. Everything left of it then
depends only on text that the left chunk holds, and everything right of it only on what the right chunk holds. An overlap
without such a place is widened, up to the whole rest of the text.

Texts of one chunk are counted piece by piece, parted at the same kind of boundary: a process remembers the counts of pieces it
has met. Texts in which white space stands before a blank or line break are encoded whole.

Null texts count as empty (0 tokens). Repeated rows give repeated results. Only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, process_memory, strings

#: Texts of more characters are encoded in chunks.
CHUNK = 32_768
OVERLAP = 256
#: A cut stands so far from the end of the left chunk: more than the pattern's look-ahead or a special token spans.
MARGIN = 32


@cache
def tokenizer(file: str):
    """One Tokenizer for each process and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(file))


def _encoded(tok, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """ids and absolute start offsets."""
    e = tok.encode(text[start:end], add_special_tokens=False)
    return e.ids, [start + a for a, _ in e.offsets]


def _common_cut(text: str, left: tuple[list[int], list[int]], right: tuple[list[int], list[int]], low: int, high: int) -> tuple[int, int] | None:
    """Token indices (in left, in right) of a proven cut in text[low:high], the last there is."""
    (a_ids, a_at), (b_ids, b_at) = left, right
    for p in range(high - 1, low, -1):
        if text[p] in " \n" and text[p - 1].isalnum():
            i, j = bisect_left(a_at, p), bisect_left(b_at, p)
            if i < len(a_at) and j < len(b_at) and a_at[i] == p == b_at[j]:
                back = min(4, i, j)
                if back and a_ids[i - back : i] == b_ids[j - back : j] and a_at[i - back : i] == b_at[j - back : j]:
                    return i, j
    return None


def encode_whole(text: str, file: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """ids of the whole text, equal to those of one call on it."""
    tok = tokenizer(file)
    if len(text) <= chunk:
        return tok.encode(text, add_special_tokens=False).ids
    ids: list[int] = []
    end = chunk
    left, first = _encoded(tok, text, 0, end), 0  # first: of the left chunk's tokens that count
    while end < len(text):
        wide = overlap
        while True:
            start = max(0, end - wide)
            stop = min(len(text), end + max(chunk, wide))
            right = _encoded(tok, text, start, stop)
            low = max(start, left[1][first])
            if cut := _common_cut(text, left, right, low, end - MARGIN):
                ids += left[0][first : cut[0]]
                left, first, end = right, cut[1], stop
                break
            if start <= left[1][first]:  # the overlap is the whole left chunk: it goes on as one chunk
                stop = min(len(text), end + wide)
                at = left[1][first]
                left, first, end = _encoded(tok, text, at, stop), 0, stop
                break
            wide *= 2
    return ids + left[0][first:]


#: Pieces whose counts a process remembers; then it starts anew. Long ones are not remembered.
CACHE, CACHE_LENGTH = 1_000_000, 32
_UNSURE = re.compile(r"\s[ \n]")


def _piece(key: str) -> str:
    """The text that a key stands for: what follows a blank is kept without it, what follows a line break or starts a text has a sign."""
    return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key


def count_short(texts: list[str], file: str) -> list[int]:
    """Token counts of texts of one chunk."""
    tok, known = tokenizer(file), process_memory("token counts").setdefault(file, {})
    if len(known) > CACHE:
        known.clear()
    sure = [i for i, t in enumerate(texts) if "\0" not in t and not _UNSURE.search(t)]
    keys = [("\0" + texts[i].replace("\n", " \n")).split(" ") for i in sure]
    found = [list(map(known.get, ks)) for ks in keys]
    new = list({k for ks, ns in zip(keys, found, strict=True) if None in ns for k, n in zip(ks, ns, strict=True) if n is None})
    fresh = dict(zip(new, map(len, tok.encode_batch_fast(list(map(_piece, new)), add_special_tokens=False)), strict=True))
    known.update((k, n) for k, n in fresh.items() if len(k) <= CACHE_LENGTH)
    out = [0] * len(texts)
    for i, ks, ns in zip(sure, keys, found, strict=True):
        out[i] = sum(ns) if None not in ns else sum(fresh[k] if n is None else n for k, n in zip(ks, ns, strict=True))
    rest = sorted(set(range(len(texts))) - set(sure))
    for i, e in zip(rest, tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = len(e)
    return out


def count_tokens(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens). One narrow pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b, 1)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            n = [0] * len(texts)
            for i, m in zip(short, count_short([texts[i] for i in short], file), strict=True):
                n[i] = m
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = len(encode_whole(t, file, chunk, overlap))
            yield pa.record_batch([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
