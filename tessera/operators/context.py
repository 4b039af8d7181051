"""Competition features: windows over all candidates of a source-1 record (s1_id) and over all owners of a record (cand_id).

Ranks are row numbers, by the score downwards, ties by the other id. A feature of "the competitor" is the value in the row of the
best other owner of the same record: the second if the row itself is the best, else the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _s1():
    return Window.partitionBy("s1_id")


def _cand():
    return Window.partitionBy("cand_id")


def rank(score: str, by: str, *more: str) -> Column:
    """Row number by score downwards within by (and more columns), ties by the other id."""
    other = "cand_id" if by == "s1_id" else "s1_id"
    return F.row_number().over(Window.partitionBy(by, *more).orderBy(F.desc(score), other))


def of_competitor(value: str, rk: str = "_rk") -> Column:
    """The value in the competitor's row, null without one. rk: the row's rank among the record's owners."""
    at = lambda r: F.max(F.when(F.col(rk) == r, F.col(value))).over(_cand())
    return F.when(F.col(rk) == 1, at(2)).otherwise(at(1))


def margin(score: str, rk: str, without: float = 0.0) -> Column:
    """Lead over the best other owner for the best row (without one, over `without`), distance to the best for others."""
    second = F.max(F.when(F.col(rk) != 1, F.col(score))).over(_cand())
    return F.when(F.col(rk) == 1, F.col(score) - F.coalesce(second, F.lit(without))).otherwise(F.col(score) - F.max(score).over(_cand()))


def candidate_context(pairs: DataFrame, score: str = "blk_comb") -> DataFrame:
    """pairs with the seven ctx_ columns."""
    return pairs.withColumns({
        "ctx_n_cand": F.count("*").over(_s1()),
        "ctx_n_s1": F.count("*").over(_cand()),
        "ctx_rank_in_s1": rank(score, "s1_id"),
        "ctx_rank_in_cand": rank(score, "cand_id"),
        "ctx_gap_s1_best": F.col(score) - F.max(score).over(_s1()),
        "ctx_gap_cand_best": F.col(score) - F.max(score).over(_cand()),
    }).withColumn("ctx_margin_cand", margin(score, "ctx_rank_in_cand"))


def prob_context(scored: DataFrame) -> DataFrame:
    """scored (s1_id, cand_id, prob) with the p1_ columns of first-stage probabilities."""
    p = F.col("prob")
    return scored.withColumns({
        "p1_rank_cand": rank("prob", "cand_id"),
        "p1_rank_s1": rank("prob", "s1_id"),
        "p1_max_s1": F.max(p).over(_s1()),
        "p1_sum_s1": F.sum(p).over(_s1()),
        "p1_n_high_s1": F.count_if(p > 0.5).over(_s1()),
        "p1_sum_cand": F.sum(p).over(_cand()),
    }).withColumn("p1_margin_cand", margin("prob", "p1_rank_cand")).withColumn("p1_sum_s1_others", F.col("p1_sum_s1") - p)


def source_context(scored: DataFrame, sources: DataFrame) -> DataFrame:
    """scored with confident (prob > 0.5) counts and the best probability among other records of the same source and of the
    other sources of the S1, and the same of the competitor, -1 without one. sources: cand_id, src."""
    group = Window.partitionBy("s1_id", "src")
    high = (F.col("prob") > 0.5).cast("int")
    d = scored.join(sources.select("cand_id", "src"), "cand_id", "left").withColumns({
        "p1_src_n_high_s1": F.sum(high).over(group) - high,
        "p1_osrc_n_high_s1": F.sum(high).over(_s1()) - F.sum(high).over(group),
        "_in": rank("prob", "s1_id", "src"),
        "_rk": rank("prob", "cand_id"),
    })
    other = F.max(F.when(F.col("_in") != 1, F.col("prob"))).over(group)
    d = d.withColumn("p1_src_max_s1", F.when(F.col("_in") == 1, F.coalesce(other, F.lit(0.0))).otherwise(F.max("prob").over(group)))
    names = ["p1_src_n_high_s1", "p1_src_max_s1", "p1_osrc_n_high_s1"]
    return d.withColumns({c.replace("_s1", "_comp"): F.coalesce(of_competitor(c), F.lit(-1)) for c in names}).drop("_in", "_rk")


SIBLING = 0.9


def sibling_context(scored: DataFrame, attributes: DataFrame, keys: dict[str, str]) -> DataFrame:
    """scored with, for each attribute, how many other confident candidates of the S1 have the same non-empty value, and the same of
    the competitor, -1 without one. attributes: cand_id and a column for each of keys (column by feature name)."""
    d = scored.join(attributes.select("cand_id", *keys.values()), "cand_id", "left").withColumn("_rk", rank("prob", "cand_id"))
    for name, column in keys.items():
        value = F.when(F.col(column) != "", F.col(column))
        sure = (F.col("prob") >= SIBLING) & value.isNotNull()
        # Only confident rows are counted: a small table, joined back.
        many = d.filter(sure).groupBy("s1_id", column).agg(F.count("*").alias("_n"))
        d = d.join(many, ["s1_id", column], "left").withColumn(f"p1_sib_{name}_s1", F.coalesce("_n", F.lit(0)) - F.coalesce(sure.cast("int"), F.lit(0))).drop("_n")
    return d.withColumns({f"p1_sib_{n}_comp": F.coalesce(of_competitor(f"p1_sib_{n}_s1"), F.lit(-1)) for n in keys}).drop("_rk", *keys.values())


def _other_best(score: str, w) -> Column:
    """The best of the other rows: the second largest value if this one is the largest, else the largest; null for one row."""
    top = F.max(score).over(w)
    second = F.max(F.when(F.col("_place") == 2, F.col(score))).over(w)
    return F.when(F.col(score) == top, second).otherwise(top)


def logit_context(scored: DataFrame, score: str = "ce_logit", prefix: str = "p2_ce") -> DataFrame:
    """scored with a logit's rank, gaps to the best other candidate and other owner, positive logits of the S1, owners of the record."""
    d = scored.withColumns({f"{prefix}_rank_s1": rank(score, "s1_id"), f"{prefix}_npos_s1": F.count_if(F.col(score) > 0).over(_s1()), f"{prefix}_ncl_cand": F.count("*").over(_cand())})
    d = d.withColumn("_place", rank(score, "s1_id")).withColumn(f"{prefix}_gap_s1", F.col(score) - _other_best(score, _s1()))
    return d.withColumn("_place", rank(score, "cand_id")).withColumn(f"{prefix}_gap_cand", F.col(score) - _other_best(score, _cand())).drop("_place")


def log_odds(p: Column) -> Column:
    c = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(c / (1 - c))


def edge_group_features(scored: DataFrame, records: DataFrame, least: float = 0.01) -> DataFrame:
    """Features of edges with prob >= least among the edges of their record (r_) and S1 (s_), of confident siblings by source, and of
    the competitor. records: cand_id, src of the sources 2 and 3. Where scored has them, retriever columns (f_bi_top1, f_bi_cos1) give s_bi_n,
    comp_f_bi_cos1 and d_bi, and a later stage's p3 gives in_zone."""
    d = scored.filter(F.col("prob") >= least).withColumns({
        "lp": log_odds(F.col("prob")),
        "r_n": F.count("*").over(_cand()),
        "r_rank": rank("prob", "cand_id"),
        "r_best": F.max("prob").over(_cand()),
        "r_sum": F.sum("prob").over(_cand()),
        "s_n": F.count("*").over(_s1()),
        "s_rank": rank("prob", "s1_id"),
        "s_sum": F.sum("prob").over(_s1()),
        "s_n05": F.count_if(F.col("prob") >= 0.5).over(_s1()),
    }).join(records.select("cand_id", F.col("src").alias("csrc")), "cand_id", "left")
    sure = (F.col("prob") >= 0.9) & (F.col("r_rank") == 1)
    own = sure.cast("int")
    many = lambda s: F.count_if(sure & (F.col("csrc") == s)).over(_s1())
    d = d.withColumns({
        "r_second": F.coalesce(F.max(F.when(F.col("r_rank") == 2, F.col("prob"))).over(_cand()), F.lit(0.0)),
        "r_margin": margin("prob", "r_rank"),
        "sib_n": F.count_if(sure).over(_s1()) - own,
        "sib_same": F.when(F.col("csrc") == 2, many(2)).otherwise(many(3)) - own,
        "sib_other": F.when(F.col("csrc") == 2, many(3)).otherwise(many(2)),
    })
    retrieved = {"f_bi_top1", "f_bi_cos1"} <= set(scored.columns)
    compared = ["prob", "sib_n", "lp", "s_sum", *["f_bi_cos1"] * retrieved]
    d = d.withColumns({f"comp_{c}": of_competitor(c, "r_rank") for c in compared})
    d = d.withColumns({f"d_{c}": F.col(c) - F.col(f"comp_{c}") for c in ("sib_n", "lp")})
    if retrieved:
        d = d.withColumns({"s_bi_n": F.sum("f_bi_top1").over(_s1()), "d_bi": F.col("f_bi_cos1") - F.col("comp_f_bi_cos1")})
    return d.withColumn("in_zone", F.col("p3").isNotNull().cast("int")) if "p3" in scored.columns else d


def prototype_similarity(scored: DataFrame, texts: DataFrame, name_similarity, address_similarity) -> DataFrame:
    """For edges whose record has several owners or isn't certain (prob < 0.995): best and mean similarity of the record's name, best of its
    address, and whether its address is that of any, over the S1's other confident records. texts: cand_id, name, address."""
    ranked = scored.withColumns({"r_n": F.count("*").over(_cand()), "r_rank": rank("prob", "cand_id")})
    sure = ranked.filter("prob >= 0.9 and r_rank = 1").select("s1_id", F.col("cand_id").alias("sib"))
    open_ = ranked.filter("r_n >= 2 or prob < 0.995").select("s1_id", "cand_id")
    own = texts.select("cand_id", F.col("name").alias("qn"), F.col("address").alias("qa"))
    other = texts.select(F.col("cand_id").alias("sib"), F.col("name").alias("sn"), F.col("address").alias("sa"))
    pairs = open_.join(sure, "s1_id").filter("sib <> cand_id").join(own, "cand_id").join(other, "sib")
    both = pairs.select("s1_id", "cand_id", name_similarity(F.col("qn"), F.col("sn")).alias("n"), address_similarity(F.col("qa"), F.col("sa")).alias("a"), ((F.col("qa") == F.col("sa")) & (F.col("qa") != "")).alias("eq"))
    return both.groupBy("s1_id", "cand_id").agg(F.max("n").alias("proto_name"), F.avg("n").alias("proto_name_mean"), F.max("a").alias("proto_addr"), F.bool_or("eq").cast("int").alias("proto_addr_eq"))


def owner_features(scored: DataFrame, records: DataFrame, texts: DataFrame, s1_texts: DataFrame, name_similarity, address_similarity, least: float = 0.01) -> DataFrame:
    """edge_group_features with prototype similarities (null without siblings), the similarity of record and S1 (s1_name, s1_addr), all of
    these of the competitor (comp_), and the differences (d_). texts: cand_id, name, address; s1_texts: s1_id, name, address."""
    edges = scored.filter(F.col("prob") >= least)
    d = edge_group_features(scored, records, least).join(prototype_similarity(edges, texts, name_similarity, address_similarity), ["s1_id", "cand_id"], "left")
    own = texts.select("cand_id", F.col("name").alias("_qn"), F.col("address").alias("_qa"))
    other = s1_texts.select("s1_id", F.col("name").alias("_sn"), F.col("address").alias("_sa"))
    d = d.join(own, "cand_id", "left").join(other, "s1_id", "left")
    d = d.withColumns({"s1_name": name_similarity(F.col("_qn"), F.col("_sn")), "s1_addr": address_similarity(F.col("_qa"), F.col("_sa"))}).drop("_qn", "_qa", "_sn", "_sa")
    d = d.withColumns({f"comp_{c}": of_competitor(c, "r_rank") for c in ("sib_same", "proto_name", "proto_addr", "s1_name", "s1_addr")})
    return d.withColumns({f"d_{c}": F.col(c) - F.col(f"comp_{c}") for c in ("proto_name", "proto_addr", "s1_name", "s1_addr")})


def later_logit_columns(scored: DataFrame, name: str = "ce3", detwin: bool = False) -> DataFrame:
    """PAIR, p2_<name>_logit and its gaps to the best other candidate and owner; with detwin a clone has its original's gaps.
    scored: s1_id, cand_id, ce_logit."""
    from ..functions.text import original_id

    kept = ["s1_id", "cand_id", "p2_ce_gap_s1", "p2_ce_gap_cand"]
    own = scored.select("s1_id", "cand_id", "ce_logit")
    if detwin:
        marked = own.withColumn("_o", original_id(F.col("cand_id")))
        merged = marked.groupBy("s1_id", F.col("_o").alias("cand_id")).agg(F.max("ce_logit").alias("ce_logit"))
        made = marked.join(logit_context(merged).select(kept).withColumnRenamed("cand_id", "_o"), ["s1_id", "_o"], "left")
    else:
        made = logit_context(own)
    return made.select("s1_id", "cand_id", F.col("ce_logit").alias(f"p2_{name}_logit"), F.col("p2_ce_gap_s1").alias(f"p2_{name}_gap_s1"), F.col("p2_ce_gap_cand").alias(f"p2_{name}_gap_cand"))
