"""SimHash near-duplicates: fingerprints, an embedding by segment popcounts, a grid range-join, exact verification.

A fingerprint's embedding is its number of set bits in each of 32 segments of two bits. The Manhattan distance of two
embeddings is a lower bound of the number of differing bits, so pairs in range r of each other there hold all pairs that
differ in r bits or fewer. The axes are dealt into groups, and the grid has a cell for each value of a group; moving a point by r changes
r groups at most, so points in range share the cells of some (groups - r) groups. Each choice of so many groups is a
probe: an equi-join on those cells, then the range condition on whole embeddings, then the exact one on fingerprints.

Equal fingerprints are one node from the start. The number of groups grows with the number of nodes, so that a cell holds few on
average. A cell with more than CROWD nodes isn't joined with itself: its nodes are
linked exactly by one-bit neighbours instead (two fingerprints differ in two bits or fewer if and only if flipping at
most one bit of each gives a common value), which takes 65 rows for each node however crowded the cell.

Null and empty texts have fingerprint zero and are alike. Null ids are fingerprinted but never are a smallest id; fingerprints
that only such rows have are linked like others. Links are between fingerprints, so rows that share a doc_id but not their text
are linked no more than others. Repeated rows are copies of each other. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..runtime import loose
from .common import map_arrow, strings, written
from .components import connected_components

#: Nodes in a cell up to which all its pairs are tried.
CROWD = 64
#: Nodes for each cell of a probe, on average, up to which a number of groups does.
CELL_MEAN = 4
#: Hashes whose bits are counted at once.
BLOCK = 255 * 32


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of text, repeats included."""
    from xxhash import xxh64_intdigest

    ws = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not ws:
        return 0
    shingles = map(b" ".join, zip(*(ws[k:] for k in range(words)), strict=False)) if len(ws) >= words else iter([b" ".join(ws)])
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, max(1, len(ws) - words + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f (the fingerprint as a signed long). One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.asarray([fingerprint(t, words, seed) for t in strings(b, 1)], np.uint64).astype(np.int64)
            yield pa.record_batch([b.column(0), pa.array(f)], ["doc_id", "f"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, "doc_id long, f long")


def embedding(f: Column) -> Column:
    """The popcounts 0, 1, 2 of the 32 segments written as 00, 01, 11: differing bits then are the Manhattan distance."""
    ones, high = F.lit(0x5555555555555555), F.shiftrightunsigned(f, 1)
    return f.bitwiseOR(high).bitwiseAND(ones).bitwiseOR(F.shiftleft(f.bitwiseAND(high).bitwiseAND(ones), 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def groups_for(nodes: int, radius: int) -> int:
    """The least number of groups whose probes have a cell for every CELL_MEAN nodes: a segment of two bits has three popcounts, the
    middle one twice as often, and so tells 1.5 bits."""
    tells = lambda g: 0.75 * (g - radius) * (64 // g // 2 * 2)
    return next((g for g in range(radius + 2, 17) if CELL_MEAN * 2 ** tells(g) >= nodes), 16)


def links(nodes: DataFrame, radius: int = 2, groups: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between nodes (f), all distinct: all pairs in cells of up to crowd nodes that differ in radius
    bits or fewer, and such pairs as connect the same nodes in larger cells. radius: 1 or 2. nodes is read several times: a table."""
    groups = groups or groups_for(nodes.count(), radius)
    width = 64 // groups // 2 * 2
    edges = [k * width for k in range(groups)] + [64]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(groups)]
    probes = [sum(masks[k] for k in kept) for kept in combinations(range(groups), groups - radius)]
    point = nodes.select("f", embedding(F.col("f")).alias("e"))
    spread = point.select("f", "e", F.posexplode(F.array(*(F.col("e").bitwiseAND(F.lit(_signed(m))) for m in probes))).alias("probe", "cell"))
    sizes = loose(spread.groupBy("probe", "cell").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = written(spread.join(sizes, ["probe", "cell"]), "shared")
    few = shared.filter(F.col("n") <= crowd)
    a, b = few.alias("a"), few.alias("b")
    near = lambda x, most: F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) <= most
    on = (F.col("a.probe") == F.col("b.probe")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.f") < F.col("b.f"))
    pairs = a.join(b, on & near("e", radius) & near("f", radius)).select(F.col("a.f").alias("u"), F.col("b.f").alias("v"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << k)) for k in range(64)))
    crowded = shared.filter(F.col("n") > crowd).select("f").distinct()
    around = crowded.select("f", F.explode(F.transform(flips, lambda m: F.col("f").bitwiseXOR(m))).alias("x"))
    if radius == 1:  # one bit apart: one of the two is a one-bit neighbour of the other
        centre = crowded.select(F.col("f").alias("x"), F.col("f").alias("v"))
    else:
        centre = around.groupBy("x").agg(F.min("f").alias("v"), F.count("*").alias("n")).filter("n > 1").select("x", "v")
    return pairs.union(around.join(centre, "x").filter("f <> v").select(F.col("f").alias("u"), "v"))


def _classed(docs: DataFrame, words: int, radius: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id and f for every row; and for every fingerprint f, component_id (the smallest doc_id of its
    component) and first (whether it is the one of its component with the smallest (doc_id, f))."""
    prints = written(fingerprints(docs, words, seed, id_col, text_col), "prints")
    nodes = written(prints.groupBy("f").agg(F.min("doc_id").alias("id")), "nodes")
    joined = nodes.join(connected_components(links(nodes.select("f"), radius)).withColumnRenamed("id", "f"), "f")
    least = joined.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "f")).alias("least"))
    known = written(loose(least).join(joined, "component").select("f", F.col("least.id").alias("component_id"), (F.col("f") == F.col("least.f")).alias("first")), "classes")
    of = nodes.join(known, "f", "left").select("f", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))
    return prints, of


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f, component_id for every row: the smallest doc_id that links of radius differing bits or fewer reach."""
    prints, of = _classed(docs, words, radius, seed, id_col, text_col)
    return prints.join(of, "f").select("doc_id", "f", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The columns of op5."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """documents less their near copies: of the rows of each component one with the smallest (doc_id, fingerprint) stays. Rows are
    told apart by doc_id and fingerprint, so different texts under one doc_id are decided on each for itself. Rows without doc_id stay.

    Ids and fingerprints decide; texts move only where rows are joined with the ids that lose a row, which Spark
    broadcasts if their table is small. Rows of an id that loses some rows but not all are fingerprinted again.
    """
    prints, of = _classed(docs, words, radius, 42, "doc_id", "text")
    judged = prints.filter("doc_id is not null").join(of, "f").select("doc_id", "f", (F.col("first") & (F.col("doc_id") == F.col("component_id"))).alias("stays"))
    stays = F.col("stays")
    each = judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(stays).alias("kept"), F.countDistinct(F.when(stays, F.col("f"))).alias("texts"))
    # Ids that lose a row: one that goes, or one of several equal ones.
    ids = written(each.filter("n > texts").select("doc_id", (F.col("kept") > 0).alias("some")), "losing")
    known = docs.filter("doc_id is not null")
    whole = known.join(ids.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    mark = "_f"
    while mark.lower() in map(str.lower, docs.columns):
        mark = "_" + mark
    parted = _with_fingerprint(known.join(ids.filter("some").select("doc_id"), "doc_id", "left_semi").select(docs.columns), words, mark)
    stay = judged.filter(stays).select("doc_id", F.col("f").alias(mark))
    parted = parted.join(stay, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]).select(docs.columns)
    return whole.unionByName(parted).unionByName(docs.filter("doc_id is null"))


def _with_fingerprint(docs: DataFrame, words: int, name: str) -> DataFrame:
    """docs with the fingerprint of text as a further column."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.asarray([fingerprint(t, words) for t in strings(b, at)], np.uint64).astype(np.int64)
            yield pa.record_batch([*b.columns, pa.array(f)], [*b.schema.names, name])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(name, LongType())]))
