"""Candidate generation: forward and reverse top-k joins, their union with rescues, blocking recall, targeted rescues.

Records: entity_id, src, country, name_core, name_full, name_native, addr_tokens, addr_nums, addr_empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import addr_keys, char_trigrams, cross_keys, name_keys, num_word_keys
from ..functions.similarity import indel_ratio, pairwise
from ..functions.text import joined, name_variant_key, order_free, tokens
from ..runtime import release, written
from .blocks import Pick, scored
from .tfidf import best_pairs, block_best, grouped_best, pair_cosines, pair_scores, postings, vectors

PAIR = ["s1_id", "cand_id"]
SCORES = ("name", "addr", "cross", "comb")
MAX_DF = 6000


def views() -> dict[str, Column]:
    """Keys by view. A record without core name is found by its full name."""
    name = F.when(F.col("name_core") != "", F.col("name_core")).otherwise(F.col("name_full"))
    return {"name": name_keys(name), "addr": addr_keys(F.col("addr_tokens")), "cross": cross_keys(name, F.col("addr_nums"))}


def sides(records: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Records of source 1 with s1_id and other records with cand_id; both have country and the columns."""
    kept = [c for c in ("country", *columns)]
    return records.filter("src = 1").select(F.col("entity_id").alias("s1_id"), *kept), records.filter("src <> 1").select(F.col("entity_id").alias("cand_id"), *kept)


def generate(records: DataFrame, k_name: int = 5, k_addr: int = 5, k_comb: int = 15, k_rev: int = 2, max_df: int = MAX_DF, rescues: list[DataFrame] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """All candidate pairs once: forward top-k by name, address and all views, reverse top-k by all views, and rescued pairs.
    The four cosines of each pair are blk_name, blk_addr, blk_cross and blk_comb. All pairs that share a key are scored, by blocks of records; a block
    hands on what can be among the best of its records, a table in the shared folder. weights: the table of the records' postings, where there is
    one already; only rescued pairs need it beside their packed form."""
    if rescues and weights is None:
        weights = written(postings(records, views(), max_df), "postings")
    picks = [("name", "s1_id", k_name), ("addr", "s1_id", k_addr), ("comb", "s1_id", k_comb), ("comb", "cand_id", k_rev)]
    packed = vectors(postings(records, views(), max_df, True) if weights is None else weights)
    scores = written(scored(packed, SCORES, picks), "scores")
    release(records.sparkSession)
    found = _ranked(scores, picks[:3], "s1_id").union(_ranked(scores, picks[3:], "cand_id", 3)).dropDuplicates(PAIR)
    if rescues:
        found = written(found, "found")
        more = reduce(DataFrame.union, (r.select(PAIR) for r in rescues)).distinct().join(found, PAIR, "left_anti")
        found = found.union(pair_scores(more, weights, SCORES[:-1]).select(found.columns))
    return found.select(*PAIR, *(F.col(v).alias(f"blk_{v}") for v in SCORES))


def _ranked(scores: DataFrame, picks: list[Pick], by: str, bit: int = 0, least: float = 0.02) -> DataFrame:
    """Pairs of scores that are among the best of any of the picks, which are of the same side: one shuffle for all. bit: that of the first pick."""
    other = "cand_id" if by == "s1_id" else "s1_id"
    d, kept = scores.filter(F.col("picked").bitwiseAND(((1 << len(picks)) - 1) << bit) != 0), F.lit(False)
    for i, (score, _, k) in enumerate(picks):
        own = F.when(F.col("picked").bitwiseAND(1 << (bit + i)) != 0, F.round(score, 9))
        d = d.withColumn(f"rk{i}", F.when(own >= least, F.row_number().over(Window.partitionBy(by).orderBy(own.desc(), other))))
        kept = kept | (F.coalesce(f"rk{i}", F.lit(k + 1)) <= k)
    return d.filter(kept).select(*PAIR, *SCORES)


def recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """n_true, n_found, recall: how many true pairs are candidates; no true pairs give recall null."""
    found = truth.select(PAIR).distinct().join(candidates.select(*PAIR, F.lit(1).alias("hit")).distinct(), PAIR, "left")
    return found.agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.nullif("n_true", F.lit(0)))


def best_per_record(pairs: DataFrame, k: int) -> DataFrame:
    """The k pairs of each record with the largest cos, ties by s1_id."""
    order = Window.partitionBy("cand_id").orderBy(F.round("cos", 9).desc(), "s1_id")
    return pairs.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k).drop("rk")


def variant_rescue(records: DataFrame, weights: DataFrame, affected: Column | None = None, k: int = 1, min_addr_cos: float = 0.05) -> DataFrame:
    """Affected records (by default those in another script) with the S1 of the same spelling-variant name key, the best k by address: s1_id, cand_id, cos."""
    affected = F.col("name_native") if affected is None else affected
    with_key = records.withColumn("group", name_variant_key(F.col("name_core"))).filter("group <> ''")
    a, b = sides(with_key.filter((F.col("src") == 1) | affected), "group")
    return best_per_record(grouped_best(a, b, weights, "addr", k, min_addr_cos), k)


def vocabulary(records: DataFrame) -> DataFrame:
    """country, word: the core-name words of source 1."""
    return records.filter("src = 1").select("country", F.explode(tokens(F.col("name_core"))).alias("word")).distinct()


def corrections(records: DataFrame, min_sim: float = 75, min_length: int = 4, neighbours: int = 10, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """country, word, fixed: words of other sources that source 1 lacks, with the most similar of their nearest words there by trigram cosine.

    similarity: 0 to 100, the indel ratio by default; ties by the word."""
    similarity = similarity or (lambda a, b: pairwise(indel_ratio, a, b))
    known = vocabulary(records)
    odd = records.filter("src <> 1").select("country", F.explode(tokens(F.col("name_core"))).alias("word")).filter(F.length("word") >= min_length).distinct().join(known, ["country", "word"], "left_anti")
    entries = known.select("country", F.col("word").alias("entity_id"), F.lit(1).alias("src")).unionByName(odd.select("country", F.col("word").alias("entity_id"), F.lit(2).alias("src")))
    # Ids are words here, unique within a country only: the pair of both is the id.
    entries = entries.withColumn("word", F.col("entity_id")).withColumn("entity_id", F.concat_ws("\t", "country", "word"))
    near = best_pairs(vectors(postings(entries, {"tri": char_trigrams(F.col("word"))}, 10**9, True)), "tri", "cand_id", neighbours, 0.1)
    part = lambda c, k: F.get(F.split(c, "\t"), F.lit(k))
    scored = near.select(part("cand_id", 0).alias("country"), part("cand_id", 1).alias("word"), part("s1_id", 1).alias("fixed")).withColumn("sim", similarity(F.col("word"), F.col("fixed")))
    best = scored.filter(F.col("sim") >= min_sim).withColumn("rk", F.row_number().over(Window.partitionBy("country", "word").orderBy(F.desc("sim"), "fixed")))
    return best.filter("rk = 1").select("country", "word", "fixed")


def typo_rescue(records: DataFrame, weights: DataFrame, fixes: DataFrame, k: int = 1, min_addr_cos: float = 0.05) -> DataFrame:
    """Records some of whose words are corrected, with the S1 of the same order-free key: by address if there is one, else only an S1 whose key is unique."""
    a, _ = sides(records.withColumn("group", order_free(F.col("name_core"))), "group")
    words = records.filter("src <> 1").select("country", F.col("entity_id").alias("cand_id"), "addr_empty", F.posexplode(tokens(F.col("name_core"))).alias("pos", "word")).join(fixes, ["country", "word"], "left")
    fixed = words.groupBy("country", "cand_id", "addr_empty").agg(F.count("fixed").alias("n"), joined(F.array_sort(F.collect_set(F.coalesce("fixed", "word")))).alias("group")).filter("n > 0")
    fixed = written(fixed, "fixed")
    by_address = grouped_best(a, fixed.filter("not addr_empty"), weights, "addr", k, min_addr_cos)
    alone = a.groupBy("country", "group").agg(F.count("*").alias("owners"), F.min("s1_id").alias("s1_id")).filter("owners = 1")
    by_name = alone.join(fixed.filter("addr_empty"), ["country", "group"]).select(*PAIR, F.lit(0.0).alias("cos"))
    return best_per_record(by_address.union(by_name), k)


def _margins(scores: DataFrame, min_cos: float, min_margin: float) -> DataFrame:
    """The best S1 of each record if its cos reaches min_cos and leads the second by min_margin."""
    order = Window.partitionBy("cand_id").orderBy(F.round("cos", 9).desc(), "s1_id")
    ranked = scores.withColumn("rk", F.row_number().over(order)).withColumn("margin", F.col("cos") - F.coalesce(F.lead("cos").over(order), F.lit(0.0)))
    return ranked.filter((F.col("rk") == 1) & (F.round("cos", 9) >= min_cos) & (F.round("margin", 9) >= min_margin)).drop("rk")


def _address_weights(records: DataFrame, hashed: bool = False) -> DataFrame:
    return postings(records, {"numword": num_word_keys(F.col("addr_nums"), F.col("addr_tokens"))}, 10**9, hashed)


def trade_name_rescue(records: DataFrame, min_cos: float = 0.3, min_margin: float = 0.1) -> DataFrame:
    """Records with a name none of whose words any S1 of the country has, and with numbers: the best S1 by number and word keys of the address."""
    known = vocabulary(records)
    others = records.filter("src <> 1 and name_core <> '' and addr_nums <> ''")
    shared = others.select("country", "entity_id", F.explode(tokens(F.col("name_core"))).alias("word")).join(known, ["country", "word"], "left_semi").select("entity_id").distinct()
    pool = records.filter("src = 1").unionByName(others.join(shared, "entity_id", "left_anti").select(records.columns))
    # The best two hold a record's margin, whatever the second one's cosine.
    return _margins(block_best(vectors(_address_weights(pool, True)), "numword", "cand_id", 2, 1e-9), min_cos, min_margin)


def common_name_rescue(records: DataFrame, weights: DataFrame, top: int = 20, min_cos: float = 0.3, min_margin: float = 0.1, min_group: int = 2) -> DataFrame:
    """Records with an address whose every known name word min_group S1 or more have: the top S1 by name-number keys, ranked anew by number and word keys of the address."""
    owners = records.filter("src = 1").select("country", F.explode(F.array_distinct(tokens(F.col("name_core")))).alias("word")).groupBy("country", "word").agg(F.count("*").alias("n"))
    others = records.filter("src <> 1 and addr_nums <> '' and not addr_empty")
    least = others.select("country", "entity_id", F.explode(tokens(F.col("name_core"))).alias("word")).join(owners, ["country", "word"]).groupBy("entity_id").agg(F.min("n").alias("least")).filter(F.col("least") >= min_group)
    some = others.join(least, "entity_id", "left_semi").select(records.columns)
    cross = weights.filter("view = 'cross'")
    wanted = cross.filter("side = 2").join(some.select(F.col("entity_id").alias("id")), "id", "left_semi").select(cross.columns)
    near = best_pairs(vectors(cross.filter("side = 1").union(wanted)), "cross", "cand_id", top, 0.01)
    again = _address_weights(records.filter("src = 1").unionByName(some))
    return _margins(pair_cosines(near.select(PAIR), again, "numword"), min_cos, min_margin)


def precomputed_rescue(records: DataFrame, retrieved: DataFrame, min_cos: float = 0.0) -> DataFrame:
    """Pairs (s1_id, cand_id, bi_cos) of a learned retriever whose records are in the table."""
    a, b = sides(records)
    return retrieved.filter(F.col("bi_cos") >= min_cos).join(a.select("s1_id"), "s1_id", "left_semi").join(b.select("cand_id"), "cand_id", "left_semi")


#: Rescues by name; a further one is a function of records and its own inputs.
RESCUES: dict[str, Callable[..., DataFrame]] = {"translit": variant_rescue, "typo": typo_rescue, "dba": trade_name_rescue, "common": common_name_rescue, "bienc": precomputed_rescue}
