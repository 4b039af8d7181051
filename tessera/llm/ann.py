"""Approximate nearest neighbours by inner product with adaptive dimension scans inside probed lists.

Vectors are scaled by the largest norm M and get a further coordinate sqrt(1 - |x|^2), queries get 0 there and norm 1: the
nearest by distance then is the one with the largest inner product. A random rotation spreads the length over all
coordinates, so that the squared distance over the first d of D coordinates times D / d estimates the whole one, with an error that
shrinks as 1 / sqrt(d). Candidates are scanned in blocks of columns; after each block those whose estimate exceeds a bound
of the query's k-th best distance by more than the error allows are abandoned; survivors get their exact inner product on the original
vectors. The bound first is the k-th best distance among ANCHORS vectors of the sample; every query is compared with all anchors,
and its k best of them compete with what its lists hold, so that each query gets k results where there are so many candidates. The
FIRST share of a query's lists, the nearest, is scanned with this bound, and the k-th best found there is the bound of the others.

Lists are the cells of centres that are fitted to a bounded sample, SAMPLE vectors; the number of lists follows the square
root of the number of vectors, up to LISTS. Every vector is in one list. How many lists a query probes is measured: as many as
hold the wanted share of the true nearest neighbours of sampled queries within the sample. Of these it leaves out those whose
radius keeps all their vectors beyond its bound. Small lists share a bin of up to a block of
rows; the rows of a larger one are dealt into blocks of about that size, as are the queries of a bin. Each pair of a block and a query block is a
group of its own, so that a list with a third of all rows is many groups of bounded size. Of each group a query's k best go on; equal scores are
ordered by vec_id. Each vector moves once for each query block of its bin, each query once for each block that it probes; blocks grow with the
table up to BLOCKS rows, so that larger tables make fewer copies for each pair that they compare. The work remains queries times probed vectors.
Wide vectors make the sample and the blocks smaller (SAMPLE_BYTES, BLOCK_BYTES); the rotation takes 8 D^2 bytes in each process.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Of rows
that repeat an id the one with the largest vector, in the order of arrays, counts. An empty table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, ship, written

#: Bounds of the fit and of the groups.
SAMPLE, LISTS, ANCHORS, TRIALS = 20_000, 4_096, 2_048, 256
#: Rows of a block: the least and the most, and so many blocks of the table that all cores have work. Queries of a query block.
BLOCK, BLOCKS, PARTS, QUERY_BLOCK = 2_048, 16_384, 64, 16_384
#: Bytes, as doubles, that bound the sample and a block for wide vectors.
SAMPLE_BYTES, BLOCK_BYTES = 64 << 20, 32 << 20
#: Columns of a scan step, and how many standard errors above the k-th best an estimate must be to be abandoned.
STEP, ERRORS = 16, 2.1
#: The share of a query's lists that is scanned first, and queries that are scanned at once.
FIRST, AT_ONCE = 0.1, 256


@dataclass
class Index:
    """The rotation, the scale of norms, the lists' centres, the anchors' ids and vectors, and how many lists to probe."""

    rotation: np.ndarray
    scale: float
    centres: np.ndarray
    anchor_ids: np.ndarray
    probes: int = 1
    originals: np.ndarray | None = None

    def turned(self, v: np.ndarray, query: bool) -> np.ndarray:
        if query:
            x = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))], axis=1)
        else:
            x = v / self.scale
            x = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)
        return x @ self.rotation

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres * self.centres).sum(axis=1) - 2 * x @ self.centres.T
        n = min(n, far.shape[1])
        return np.argpartition(far, n - 1, axis=1)[:, :n]

    def best_anchors(self, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, anchor ids and inner products of the k best anchors of each query."""
        i, j = np.nonzero(ids[:, None] != self.anchor_ids[None])
        near = (q @ self.originals.T)[i, j].reshape(-1)
        order = np.lexsort((self.anchor_ids[j], -near, i))
        i, j = i[order], j[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < 2 * k  # the exact products settle near ties
        return first_k(ids, self.anchor_ids, i[best], j[best], inner(self.originals[j[best]], q[i[best]]), k)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that take part, as floats where they are, else as doubles, one for each id. The length of most is the one of the most rows, the smaller in ties."""
    float_ = vectors.select(F.col(vector_col)).dtypes[0][1] == "array<float>"
    v = F.col(vector_col) if float_ else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).filter(F.exists("v", lambda x: x != 0))
    lengths = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.filter(F.size("v") == (lengths[0]["n"] if lengths else 0)).groupBy("vec_id").agg(F.max("v").alias("v"))


def fit(rows: DataFrame, k: int = 20, recall: float = 0.95, sample: int = SAMPLE, lists: int = LISTS, anchors: int = ANCHORS, rounds: int = 8, seed: int = 11) -> Index | None:
    """None for an empty table. The sample is the rows with the lowest hashes of vec_id."""
    facts = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).alias("norm")).first()
    if not facts["n"]:
        return None
    width = rows.select(F.size("v")).first()[0]
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fitting(sample, width, SAMPLE_BYTES)).toArrow()
    v, ids = _matrix(got["v"]), got["vec_id"].to_numpy()
    draw = np.random.default_rng(seed)
    dims = v.shape[1] + 1
    rotation = np.linalg.qr(draw.normal(size=(dims, dims)))[0]
    index = Index(rotation, float(facts["norm"]), np.zeros((1, dims)), ids[:anchors])
    turned = index.turned(v, False)
    x = np.unique(turned, axis=0)
    n = max(1, min(lists, len(x), 2 * math.isqrt(facts["n"])))
    centres = x[draw.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        index.centres = centres
        own = np.concatenate([index.nearest(x[a : a + 1024], 1)[:, 0] for a in range(0, len(x), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=n)[:, None]
        centres = np.where(size > 0, sums / np.maximum(size, 1), centres)
    index.centres, index.originals = centres, v[:anchors]
    # In which place of a query's order of lists its true neighbours' lists are.
    own = np.concatenate([index.nearest(turned[a : a + 1024], 1)[:, 0] for a in range(0, len(turned), 1024)])
    q = index.turned(v[:TRIALS], True)
    far = squared(q, turned)
    far[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(v) - 1)]
    place = np.argsort(np.argsort(squared(q, centres), axis=1), axis=1)
    needed = np.take_along_axis(place, own[near], axis=1)
    index.probes = int(np.quantile(needed, recall, method="higher")) + 1 if needed.size else n
    return index


def fitting(rows: int, width: int, size: int) -> int:
    """rows, or as many vectors of this width as fit into size bytes, 64 at least."""
    return max(64, min(rows, size // (8 * width)))


def _kind(rows: DataFrame) -> str:
    return dict(rows.dtypes)["v"]


def placed(rows: DataFrame, index: Broadcast) -> DataFrame:
    """vec_id, v, list, far: each row in the list of its nearest centre, and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            if b.num_rows:
                x = own.turned(_matrix(b.column(1)), False)
                near = own.nearest(x, 1)[:, 0]
                far = np.sqrt(((x - own.centres[near]) ** 2).sum(axis=1))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(far)], ["vec_id", "v", "list", "far"])

    return map_arrow(rows, run, f"vec_id long, v {_kind(rows)}, list int, far double")


def probing(queries: DataFrame, index: Broadcast, bins: np.ndarray, radii: np.ndarray, first: int, last: int) -> DataFrame:
    """vec_id, v, bound, bin, lists: each query in every bin that holds lists it probes, the first-th to last-th nearest, with these lists,
    less those that its bound excludes. radii: by list the largest distance of a vector from the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            centres = index.value.centres
            x = index.value.turned(_matrix(b.column(1)), True)
            apart = squared(x, centres)
            near = np.argsort(apart, axis=1, kind="stable")[:, first:last]
            reach = np.sqrt(np.maximum(b.column(2).to_numpy(), 0)) + 1e-6
            at, held, lists = [], [], []
            for i, own in enumerate(near if near.shape[1] else ()):
                own = own[np.sqrt(np.maximum(apart[i, own], 0)) - radii[own] <= reach[i]]
                order = np.argsort(bins[own], kind="stable")
                names, starts = np.unique(bins[own][order], return_index=True)
                for name, part in zip(names.tolist(), np.split(own[order], starts[1:]), strict=False):
                    if name >= 0:
                        at.append(i)
                        held.append(name)
                        lists.append(part.astype(np.int32))
            take = pa.array(at, pa.int64())
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(held, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "v", "bound", "bin", "lists"])

    return map_arrow(queries, run, f"vec_id long, v {_kind(queries)}, bound double, bin int, lists array<int>")


def anchored(queries: DataFrame, index: Broadcast, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best anchors of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(c) for c in index.value.best_anchors(_matrix(b.column(1)), b.column(0).to_numpy(), k)], ["query_id", "vec_id", "score"])

    return map_arrow(queries.select("vec_id", "v"), run, "query_id long, vec_id long, score double")


def bounded(queries: DataFrame, best: DataFrame, scale: float, k: int) -> DataFrame:
    """queries with bound: the squared distance of the k-th of best (query_id, rank, vec_id, score), infinite without so many."""
    kth = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return queries.select("vec_id", "v").join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce(2 - 2 * F.col("score") / (norm * scale), F.lit(float("inf"))).alias("bound"))


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def scan(q: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, probes: np.ndarray, x: np.ndarray, x_ids: np.ndarray, lists: np.ndarray, index: Index, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and exact inner products of each query's k best of x that aren't beyond its bound, as the adaptive scan leaves
    them; anchors are left out. lists: of each row of x; probes: [queries, lists], whether the query probes the list."""
    turned_q, turned_x = index.turned(q, True), index.turned(x, False)
    dims = turned_x.shape[1]
    allowed = lambda done: bounds * (1 + ERRORS / math.sqrt(done)) ** 2 if done < dims else bounds + 1e-9
    done = min(STEP, dims)
    partial = squared(turned_q[:, :done], turned_x[:, :done])
    keep = (partial * (dims / done) <= allowed(done)[:, None]) & probes[:, lists] & ~np.isin(x_ids, index.anchor_ids)[None]
    i, j = np.nonzero(keep & (q_ids[:, None] != x_ids[None]))
    partial = partial[i, j]
    while done < dims:
        part = turned_x[j, done : done + STEP] - turned_q[i, done : done + STEP]
        partial += np.einsum("ij,ij->i", part, part)
        done = min(done + STEP, dims)
        keep = partial * (dims / done) <= allowed(done)[i]
        i, j, partial = i[keep], j[keep], partial[keep]
    return first_k(q_ids, x_ids, i, j, inner(x[j], q[i]), k)


def first_k(q_ids: np.ndarray, x_ids: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of query i and candidate j the k best of each query, equal scores by id."""
    order = np.lexsort((x_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return q_ids[i[best]], x_ids[j[best]], score[best]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; equal rows get equal values wherever they stand."""
    return (a * b).sum(axis=1)


def binned(sizes: dict[int, int], lists: int, block: int = BLOCK) -> tuple[np.ndarray, dict[int, int]]:
    """The bin of each list, -1 for empty ones, and how many blocks each bin has: neighbouring lists share a bin up to block rows."""
    bins, held = np.full(lists, -1, np.int32), {}
    for name in range(lists):
        if n := sizes.get(name, 0):
            last = len(held) - 1
            if last >= 0 and held[last] + n <= block:
                bins[name] = last
                held[last] += n
            else:
                bins[name] = last + 1
                held[last + 1] = n
    return bins, {b: -(-n // block) for b, n in held.items()}


def search(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", anchors: int = ANCHORS, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, a row of vectors that is_query (of vec_id) selects, among all other rows.

    recall: the share of the true neighbours that the probed lists are to hold, measured on the sample. A table of no more than
    `anchors` vectors is compared whole.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    fitted = fit(rows, k, recall, anchors=anchors)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = spark.sparkContext.broadcast(fitted)
    queries = rows.filter(is_query(F.col("vec_id")))
    own = written(placed(rows, index), "listed")
    # At most LISTS rows come to the driver and are sent back: the sizes and radii of lists, the bins and their blocks.
    facts = {r["list"]: r for r in own.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    lists = len(fitted.centres)
    total = sum(r["n"] for r in facts.values())
    width = len(fitted.rotation)
    block, query_block = (fitting(n, width, BLOCK_BYTES) for n in (min(BLOCKS, max(block, total // PARTS)), QUERY_BLOCK))
    radii = np.asarray([facts[m]["far"] if m in facts else 0.0 for m in range(lists)])
    bins, blocks = binned({m: r["n"] for m, r in facts.items()}, lists, block)
    table = lambda pairs, schema: F.broadcast(spark.createDataFrame(pairs, schema))
    of_list = table([(m, int(b), blocks[int(b)]) for m, b in enumerate(bins) if b >= 0], "list int, bin int, blocks int")
    stored = own.join(of_list, "list").select("bin", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("b"), "vec_id", "v", "list")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def best(x: pa.Table, q: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(x) and len(q):
            names, of = np.unique(x["list"].to_numpy(), return_inverse=True)
            vectors_, ids = _matrix(x["v"]), x["vec_id"].to_numpy()
            for part in (q.slice(at, AT_ONCE) for at in range(0, len(q), AT_ONCE)):
                probes = np.stack([np.isin(names, p) for p in part["lists"].to_pylist()])
                found.append(scan(_matrix(part["v"]), part["vec_id"].to_numpy(), part["bound"].to_numpy(), probes, vectors_, ids, of, index.value, k))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    def scanned(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score of the rows of probing()."""
        asked = written(asked, "probing")
        many = asked.groupBy("bin").agg(F.ceil(F.count("*") / query_block).cast("int").alias("query_blocks"))
        size = table([(r["bin"], r["query_blocks"], blocks[r["bin"]]) for r in many.collect()], "bin int, query_blocks int, blocks int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = stored.join(size.drop("blocks"), "bin").select("bin", "b", every("query_blocks").alias("q"), "vec_id", "v", "list")
        right = asked.join(size, "bin").select("bin", every("blocks").alias("b"), F.pmod(F.xxhash64("vec_id"), "query_blocks").cast("int").alias("q"), "vec_id", "v", "bound", "lists")
        group = ["bin", "b", "q"]
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(best, "query_id long, vec_id long, score double")

    seeds = anchored(queries, index, k)
    first = max(1, math.ceil(fitted.probes * FIRST))
    ask = lambda found, low, high: probing(bounded(queries, found, fitted.scale, k), index, bins, radii, low, high)
    near = written(ranked(scanned(ask(ranked(seeds), 0, first)).union(seeds)), "near")
    rest = scanned(ask(near, first, fitted.probes))
    return ranked(near.select("query_id", "vec_id", "score").union(rest)).select("query_id", "rank", "vec_id", "score")
