"""Dense retrieval: top-2 by dot product within a country, runner-up margins, cross-fit routing, hard negatives, recall@k.

Vectors: id, country, vec array<double>, of records of source 1 and of others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import loose, ship, written

#: Rows of a block of either side in the blocked search.
BLOCK = 2_048


def normalised(v: Column) -> Column:
    """A vector of length 1, zero vectors as they are."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def embed(records: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], id_col: str = "entity_id") -> DataFrame:
    """id, country, vec (normalised) from any encoder of batches of texts; null texts count as empty."""
    ship(records.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vec = np.asarray(encoder(b["text"].fillna("").tolist()), float)
            yield pd.DataFrame({"id": b["id"], "country": b["country"], "vec": list(vec)})

    got = records.select(F.col(id_col).cast("string").alias("id"), "country", F.col(text).alias("text")).mapInPandas(run, "id string, country string, vec array<double>")
    return got.withColumn("vec", normalised(F.col("vec")))


def hashed_ngrams(dims: int = 256, n: int = 3) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: counts of hashed character n-grams."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, t in zip(out, texts, strict=True):
            for i in range(len(t) - n + 1):
                row[zlib.crc32(t[i : i + n].encode()) % dims] += 1
        return out

    return encode


def _blocked(queries: DataFrame, targets: DataFrame, group: list[str], k: int, block: int) -> DataFrame:
    """cand_id, s1_id, cos: each query's k best targets of its group, and perhaps more, ties by s1_id.

    Both sides of a group are dealt into blocks by a hash of the id, and each pair of blocks is a group that one matrix product
    answers; only a query's k best leave a block. Block counts come from the groups' sizes, a table of as many rows as groups.
    """
    targets = targets.toDF(*targets.columns)  # own columns, also where both sides are of one table
    blocks = lambda d, n: d.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    sizes = blocks(queries, "nq").join(blocks(targets, "nt"), group)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, group).select(*group, deal("nq").alias("a"), every("nt").alias("b"), "id", "vec")
    t = targets.join(sizes, group).select(*group, every("nq").alias("a"), deal("nt").alias("b"), "id", "vec").toDF(*group, "a", "b", "id", "vec")
    kind = targets.schema["id"].dataType.simpleString()

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"cand_id": x["id"][:0], "s1_id": y["id"][:0], "cos": np.zeros(0)})
        y = y.sort_values("id")
        dots = np.round(np.stack(x["vec"]) @ np.stack(y["vec"]).T, 9)
        if k > 8 or not np.isfinite(dots).all():
            top = np.argsort(-dots, axis=1, kind="stable")[:, :k]
            cos = np.take_along_axis(dots, top, axis=1)
        else:  # a few maxima are far cheaper than a sort; argmax takes the first of equal ones, which has the smallest id
            top, rows = np.zeros((len(x), min(k, len(y))), np.int64), np.arange(len(x))
            cos = np.zeros(top.shape)
            for r in range(top.shape[1]):
                top[:, r] = dots.argmax(axis=1)
                cos[:, r] = dots[rows, top[:, r]]
                dots[rows, top[:, r]] = -np.inf
        return pd.DataFrame({"cand_id": np.repeat(x["id"].to_numpy(), top.shape[1]), "s1_id": y["id"].to_numpy()[top.reshape(-1)], "cos": cos.reshape(-1)})

    key = [*group, "a", "b"]
    return q.groupBy(*key).cogroup(t.groupBy(*key)).applyInPandas(best, f"cand_id {queries.schema['id'].dataType.simpleString()}, s1_id {kind}, cos double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("cand_id").orderBy(F.desc("cos"), "s1_id")
    return found.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def top2(queries: DataFrame, targets: DataFrame, k: int = 2, block: int = BLOCK) -> DataFrame:
    """cand_id, s1_id, cos, rk: the k targets of each query's country with the largest dot product, ties by s1_id. All pairs of a country are compared."""
    ship(queries.sparkSession)
    return _ranked(_blocked(queries, targets, ["country"], k, block), k)


def top2_of_texts(queries: DataFrame, targets: DataFrame, encoder: Callable[[list[str]], np.ndarray], k: int = 2, block: int = BLOCK) -> DataFrame:
    """The rows of top2 over embed() of both sides' records (entity_id, country, text), each text of a country encoded and compared once.

    Equal texts have equal vectors. A query's k best targets are among the k smallest ids of the k best texts, ties of texts by their smallest
    id: a text beyond those has k better records before its own first one."""
    ship(queries.sparkSession)
    own = lambda d: d.filter("country is not null").select(F.col("entity_id").cast("string").alias("id"), F.col("country").cast("string").alias("country"), F.coalesce("text", F.lit("")).alias("text"))
    shared = F.concat(F.length("country").cast("string"), F.lit(":"), F.col("country"), F.col("text"))
    q, t = own(queries).withColumn("of", shared), own(targets)
    least = t.withColumn("_r", F.row_number().over(Window.partitionBy("country", "text").orderBy("id"))).filter(F.col("_r") <= k)
    least = least.groupBy("country", "text").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.concat(F.get("ids", F.lit(0)), F.lit("\0"), shared))
    least = written(least, "texts")
    asked = q.select("country", "text", F.col("of").alias("id")).distinct()
    near = _ranked(_blocked(embed(asked, "text", encoder, "id"), embed(least, "text", encoder, "id"), ["country"], k, block), k).drop("rk")
    near = near.join(least.select(F.col("id").alias("s1_id"), "ids"), "s1_id").select("cand_id", F.explode("ids").alias("s1_id"), "cos")
    near = written(_ranked(near, k).select(F.col("cand_id").alias("of"), "s1_id", "cos"), "near")
    return _ranked(q.select("of", F.col("id").alias("cand_id")).join(near, "of").select("cand_id", "s1_id", "cos"), k)


def pruned_top(queries: DataFrame, targets: DataFrame, k: int = 2, pivots: int = 256, block: int = BLOCK) -> DataFrame:
    """The rows of top2, without comparing what cannot be among them.

    Targets are dealt to the nearest of some of them, the pivots. No target of a pivot's cell has a larger dot product with a query than the
    pivot's own plus the query's length times the cell's radius. A query scans the cell with the largest bound first, and then the cells whose
    bound reaches the k-th best found there. The clearer the vectors cluster, the fewer those are; without clusters all remain.
    At most `pivots` vectors come to the driver, and a query carries one bound for each cell of its country.
    """
    spark = queries.sparkSession
    ship(spark)
    some = [r["vec"] for r in targets.orderBy(F.xxhash64("id"), "id").select("vec").limit(pivots).collect()]
    if not some:
        return top2(queries, targets, k, block)
    shared = spark.sparkContext.broadcast(np.asarray(some, float))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in batches:
            v = np.stack(b["vec"]) if len(b) else np.zeros((0, p.shape[1]))
            near = np.argmin((p * p).sum(axis=1) - 2 * v @ p.T, axis=1)
            yield b.assign(p=near.astype(np.int32), far=np.sqrt(((v - p[near]) ** 2).sum(axis=1)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in batches:
            v = np.stack(b["vec"]) if len(b) else np.zeros((0, p.shape[1]))
            yield b.assign(dots=list(v @ p.T), length=np.sqrt((v * v).sum(axis=1)))

    shape = lambda d: f"id {d.schema['id'].dataType.simpleString()}, country {d.schema['country'].dataType.simpleString()}, vec array<double>"
    placed = written(targets.select("id", "country", "vec").mapInPandas(place, f"{shape(targets)}, p int, far double"), "placed")
    cells = placed.groupBy("country", "p").agg(F.max("far").alias("far")).groupBy("country").agg(F.collect_list(F.struct("p", "far")).alias("cells"))
    asked = queries.select("id", "country", "vec").mapInPandas(measure, f"{shape(queries)}, dots array<double>, length double").join(loose(cells), "country")
    bound = F.transform("cells", lambda c: F.struct((F.get(F.col("dots"), c["p"]) + F.col("length") * c["far"]).alias("bound"), c["p"].alias("p")))
    asked = written(asked.select("id", "country", "vec", F.reverse(F.array_sort(bound)).alias("asks")), "asked")
    scanned = lambda d: _blocked(d.select("country", "p", "id", "vec"), placed.select("country", "p", "id", "vec"), ["country", "p"], k, block)
    near = written(_ranked(scanned(asked.withColumn("p", F.col("asks")[0]["p"])), k), "near")
    least = near.filter(F.col("rk") == k).select(F.col("cand_id").alias("id"), F.col("cos").alias("least"))
    rest = F.filter(F.slice(F.col("asks"), F.lit(2), F.size("asks")), lambda a: a["bound"] >= F.coalesce("least", F.lit(float("-inf"))) - 1e-8)
    later = asked.join(least, "id", "left").select("country", "id", "vec", F.explode(rest).alias("ask")).withColumn("p", F.col("ask.p"))
    return _ranked(near.drop("rk").union(scanned(later)), k)


def runner_up(top: DataFrame) -> DataFrame:
    """s1_id, cand_id, bi_cos, bi_cos2 of the best target and the second best's cos (null without one)."""
    at = lambda r, c: F.max(F.when(F.col("rk") == r, F.col(c)))
    return top.groupBy("cand_id").agg(at(1, "s1_id").alias("s1_id"), at(1, "cos").alias("bi_cos"), at(2, "cos").alias("bi_cos2"))


def retriever_features(pairs: DataFrame, retrieved: DataFrame, original: Column | None = None) -> DataFrame:
    """pairs with f_bi_top1 (0 where not retrieved), f_bi_cos1 and f_bi_gap (null there). original: the record whose features a clone gets."""
    r = retrieved.select("s1_id", F.col("cand_id").alias("_o"), F.lit(1).alias("f_bi_top1"), F.col("bi_cos").alias("f_bi_cos1"), (F.col("bi_cos") - F.col("bi_cos2")).alias("f_bi_gap"))
    d = pairs.withColumn("_o", F.col("cand_id") if original is None else original)
    return d.join(r, ["s1_id", "_o"], "left").drop("_o").fillna(0, ["f_bi_top1"])


def routed_model(owner_fold: Column, record: Column) -> Column:
    """The model that scores a record: B for records owned in fold 0, A for fold 1, for records without owner by the last bit of
    the id's MD5."""
    even = F.right(F.md5(record.cast("string")), F.lit(1)).isin(*"02468ace")
    return F.when(owner_fold == 0, "B").when(owner_fold == 1, "A").otherwise(F.when(even, "A").otherwise("B"))


def hard_negatives(scored: DataFrame, truth: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """cand_id, s1_id: for each record with an owner the best-scored S1 that isn't it; fallback (cand_id, s1_id) for records without any."""
    wrong = scored.join(truth.select("cand_id", F.col("s1_id").alias("_t")), "cand_id").filter("s1_id <> _t")
    mined = wrong.groupBy("cand_id").agg(F.max_by("s1_id", F.struct("prob", -F.col("s1_id"))).alias("mined"))
    owned = truth.select("cand_id").distinct().join(mined, "cand_id", "left")
    if fallback is None:
        return owned.filter("mined is not null").select("cand_id", F.col("mined").alias("s1_id"))
    return owned.join(fallback.select("cand_id", F.col("s1_id").alias("_f")), "cand_id", "left").select("cand_id", F.coalesce("mined", "_f").alias("s1_id")).filter("s1_id is not null")


def recall_at(ranked: DataFrame, relevant: Column, ks: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """n queries, and recall_k: the share with a relevant target among the first k. ranked: cand_id, rk."""
    first = ranked.groupBy("cand_id").agg(F.min(F.when(relevant, F.col("rk"))).alias("first"))
    return first.agg(F.count("*").alias("n"), *(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks))
