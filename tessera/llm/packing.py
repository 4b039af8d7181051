"""Best-fit packing of documents into sequences of a fixed length, by exact complements of length sums.

Texts become token pieces in one pass that also numbers the pieces of each length within its partition. The plan is made
from the histogram of lengths alone (as many entries as the capacity, whatever the number of documents): the longest
length left opens sequences, and its gap is filled exactly by one length, else by a pair, else by a triple, as long as
their counts last; where nothing fits exactly, the longest length that fits goes in and the rest of the gap is tried
again. Each step settles as many sequences at once as the counts allow. The pieces then find their places by the
running number within their length.

Null texts count as empty (one piece, the end id). Equal lengths are interchangeable: which of them goes where follows
the order within the input and may differ between runs, the number of sequences not. Repeated ids give repeated pieces.
An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, process_memory, strings, written
from .resync import tokenizer

#: Words and parts of words that a process remembers; then it starts anew. Long ones are not remembered.
CACHE, CACHE_LENGTH = 1_500_000, 32
#: Stands between words that are encoded in one call: a pre-token and an id of its own.
_BETWEEN = "\x01"
#: Latin letters, then ASCII marks but the apostrophe: the tokenizer's pattern parts such a word there, and lowers its letters.
_PARTED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ıĲ-ɏ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def _encode_new(words: list[str], file: str, known: dict[str, bytes]) -> dict[str, bytes]:
    """ids of words without blanks, from those of their letters and marks, many of these to a call."""
    tok = tokenizer(file)
    mark = tok.encode(_BETWEEN, add_special_tokens=False).ids
    parts = {w: (m[1].lower(), m[2]) if (m := _PARTED(w)) else (w, "") for w in words}
    new = {x for ps in parts.values() for x in ps}.difference(known)
    plain = [x for x in new if _BETWEEN not in x] if len(mark) == 1 else []
    own = {x: np.asarray(tok.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in new.difference(plain)}
    groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
    for ws, e in zip(groups, tok.encode_batch_fast([f" {_BETWEEN} ".join(ws) for ws in groups], add_special_tokens=False), strict=True):
        ids = np.asarray(e.ids, "<u4")
        raw, at = ids.tobytes(), [-1, *np.flatnonzero(ids == mark[0]).tolist(), len(ids)]
        own |= {w: raw[4 * a + 4 : 4 * b] for w, a, b in zip(ws, at[:-1], at[1:], strict=True)}
    known.update((x, ids) for x, ids in own.items() if len(x) <= CACHE_LENGTH)
    return {w: (own[a] if a in own else known[a]) + (own[b] if b in own else known[b]) for w, (a, b) in parts.items()}


def _ids(texts: list[str], file: str) -> list[bytes]:
    """ids of each text as little-endian unsigned 32-bit numbers.

    This tokenizer drops white space and never joins across it, so a text's ids are those of its words in order; each
    word is encoded when the process first meets it.
    """
    known = process_memory("packing").setdefault(file, {})
    if len(known) > CACHE:
        known.clear()
    words = [t.replace("\n", " ").split(" ") for t in texts]
    found = [list(map(known.get, ws)) for ws in words]
    gaps = [[i for i, x in enumerate(xs) if x is None] if None in xs else [] for xs in found]
    fresh = _encode_new(list({ws[i] for ws, g in zip(words, gaps, strict=True) for i in g}), file, known)
    known.update((w, ids) for w, ids in fresh.items() if len(w) <= CACHE_LENGTH)
    for ws, xs, g in zip(words, found, gaps, strict=True):
        for i in g:
            xs[i] = fresh[ws[i]]
    return [b"".join(xs) for xs in found]


def pieces(docs: DataFrame, file: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and end_id, cut into pieces of capacity ids where longer.

    doc_id, piece, start, length, ids_crc32, ids array<int> (with keep_ids), and part and nth: the input partition and
    the piece's number, from 0, among those of its length there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), _ids(strings(b, 1), file), strict=True):
                raw += np.asarray([end_id], "<u4").tobytes()
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), part, seen[n], *([np.frombuffer(own, "<u4").astype(np.int32)] if keep_ids else [])))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * (8 if keep_ids else 7)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, schema)


class _Stock:
    """Counts by length, with indices of the sums that two and that three lengths in stock make; one length is its own sum.

    The index of pair sums is exact at any time. Stock only goes down, so an older index of triple sums still tells for certain which
    sums no triple makes; it is made anew after STALE lengths have run out.
    """

    STALE = 64

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.n[length] = n
        there = (self.n > 0).astype(np.int64)
        self.pairs = np.convolve(there, there)[: capacity + 1]
        self.pairs[::2] += there[: len(self.pairs[::2])]
        self.pairs //= 2  # unordered pairs by sum, a length with itself included
        self.gone = 0
        self._index_triples()

    def _index_triples(self) -> None:
        """By sum, how many lengths have a pair that makes the rest."""
        self.triples = np.convolve((self.n > 0).astype(np.int64), (self.pairs > 0).astype(np.int64))[: len(self.n)]
        self.gone = 0

    def take(self, pattern: list[int], times: int) -> None:
        for x, each in Counter(pattern).items():
            self.n[x] -= each * times
            if not self.n[x]:
                mates = np.flatnonzero(self.n)
                mates = mates[mates + x < len(self.pairs)]
                self.pairs[mates + x] -= 1
                if 2 * x < len(self.pairs):
                    self.pairs[2 * x] -= 1
                self.gone += 1
        if self.gone >= self.STALE:
            self._index_triples()

    def left(self, x: int, used: Counter) -> int:
        return int(self.n[x]) - used[x]

    def pair(self, total: int, used: Counter) -> list[int]:
        """Two lengths of this sum that are in stock beside what is used, the longest possible first."""
        if total < 2 or not self.pairs[total]:
            return []
        for a in np.flatnonzero((self.n[: total + 1] > 0) & (self.n[total::-1] > 0))[::-1].tolist():
            if 2 * a < total:
                break
            if self.left(a, used) > 0 and self.left(total - a, used) > (2 * a == total):
                return [a, total - a]
        return []

    def exact(self, gap: int, used: Counter) -> list[int]:
        """One, two or three lengths that fill the gap."""
        if self.left(gap, used) > 0:
            return [gap]
        if found := self.pair(gap, used):
            return found
        if not self.triples[gap]:
            return []
        for a in np.flatnonzero((self.n[1:gap] > 0) & (self.pairs[gap - 1 : 0 : -1] > 0))[::-1].tolist():
            if self.left(a + 1, used) > 0 and (rest := self.pair(gap - a - 1, used + Counter([a + 1]))):
                return [a + 1, *rest]
        return []

    def fitting(self, gap: int, used: Counter) -> int:
        """The longest length that fits, or 0."""
        return next((x for x in np.flatnonzero(self.n[: gap + 1])[::-1].tolist() if self.left(x, used) > 0), 0)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences have each. counts: pieces by length, 1 to capacity."""
    stock, out = _Stock(counts, capacity), []
    for longest in range(capacity, 0, -1):
        while stock.n[longest]:
            pattern, gap = [longest], capacity - longest
            while gap:
                used = Counter(pattern)
                more = stock.exact(gap, used) or [x for x in [stock.fitting(gap, used)] if x]
                if not more:
                    break
                pattern += more
                gap -= sum(more)
            times = min(int(stock.n[x]) // each for x, each in Counter(pattern).items())
            stock.take(pattern, times)
            out.append((pattern, times))
    return out


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first number of a piece, its sequence, its offset): pieces numbered from there on go to the
    following sequences at the same offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    given: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows.setdefault(x, []).append((given[x], sequence, offset))
            given[x] += times
            offset += x
        sequence += times
    return {x: np.asarray(r, np.int64) for x, r in rows.items()}


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """The rows of pieces() with sequence_id and offset in place of part and nth.

    cut is read twice and must be the same each time: a table, or written() to the shared folder. Only the histogram
    of lengths comes to the driver.
    """
    keep = [c for c in cut.columns if c not in ("part", "nth")]
    own = cut.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = own.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    numbered = cut.join(first, ["length", "part"]).select(*keep, (F.col("first") + F.col("nth")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                own, rows = length == x, places[int(x)]
                k = np.searchsorted(rows[:, 0], number[own], "right") - 1
                sequence[own] = rows[k, 1] + number[own] - rows[k, 0]
                offset[own] = rows[k, 2]
            yield pa.record_batch([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {k}" for c, k in cut.select(*keep).dtypes) + ", sequence_id long, offset long"
    return map_arrow(numbered, place, schema)


def pack_documents(docs: DataFrame, file: str = "word_bpe_49k.json", capacity: int = 2048, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places, packed; see pieces() and pack()."""
    return pack(written(pieces(docs, file, capacity, keep_ids=keep_ids), "pieces"), capacity)
