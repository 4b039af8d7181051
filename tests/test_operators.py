"""Properties of linkage operators on small tables, file round trips, plans and streams."""

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.segment import Segmenter, segmented_by_table
from tessera.operators import blocks, candidates, context, decide, features, learn, model, retrieval, simulate, tfidf
from tessera.plans import catalog
from tessera.sources import tsv
from tessera.streaming import linkage

RECORD = "entity_id long, src int, country string, name_core string, name_full string, name_native boolean, addr_tokens string, addr_nums string, addr_empty boolean"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, 1, "in", "green foods", "12 main road", "12"), (2, 1, "in", "lakshmi stores", "7 hill street", "7"), (3, 1, "in", "blue ocean traders", "9 port lane", "9"), (4, 1, "fr", "green foods", "12 main road", "12"),
        (11, 2, "in", "foods green", "12 main rd", "12"), (12, 2, "in", "laxmi stores", "7 hill street", "7"), (13, 3, "in", "bluu ocean traders", "9 port", "9"), (14, 3, "in", "zzyzx", "9 port lane", "9"), (15, 2, "fr", "vert", "", ""), (16, 2, "in", "", "", ""),
    ]
    return spark.createDataFrame([(i, s, c, n, n, i == 12, a, m, a == "") for i, s, c, n, a, m in rows], RECORD).cache()


def pairs(df):
    return {(r["s1_id"], r["cand_id"]) for r in df.collect()}


def test_candidates_stay_in_their_country(records):
    got = pairs(candidates.generate(records))
    assert {(1, 11), (2, 12), (3, 13), (3, 14)} <= got and not any(s == 4 for s, c in got if c != 15)


def test_weights_are_unit_vectors_and_frequent_keys_weigh_nothing(records):
    w = tfidf.postings(records, candidates.views(), 100)
    assert all(abs(r["n"] - 1) < 1e-12 for r in w.groupBy("country", "view", "id", "side").agg(F.sum(F.col("w") ** 2).alias("n")).collect())
    assert tfidf.postings(records, candidates.views(), 0).count() == 0


def test_comb_cosine_equals_a_joint_index(records):
    w = tfidf.postings(records, candidates.views(), 100)
    joint = w.withColumn("key", F.concat("view", F.lit("|"), "key")).withColumn("view", F.lit("all"))
    norm = joint.groupBy("side", "id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("n"))
    joint = joint.join(norm, ["side", "id"]).withColumn("w", F.col("w") / F.col("n"))
    want = {(r["s1_id"], r["cand_id"]): r["cos"] for r in tfidf.cosines(joint).collect()}
    got = {(r["s1_id"], r["cand_id"]): r["cos"] for r in tfidf.comb_cosines(w).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_top_k_is_limited_before_the_window(records):
    plan = tfidf.top_k(tfidf.cosines(tfidf.postings(records, {"name": candidates.views()["name"]}, 100)), "s1_id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rescues(records):
    w = tfidf.postings(records, candidates.views(), 100)
    assert pairs(candidates.variant_rescue(records, w)) == {(2, 12)}
    fixes = candidates.corrections(records)
    assert {(r["word"], r["fixed"]) for r in fixes.collect()} >= {("bluu", "blue")}
    assert (3, 13) in pairs(candidates.typo_rescue(records, w, fixes))
    assert pairs(candidates.trade_name_rescue(records)) == {(3, 14)}
    assert pairs(candidates.precomputed_rescue(records, records.sparkSession.createDataFrame([(1, 11, 0.9), (99, 11, 0.9)], "s1_id long, cand_id long, bi_cos double"))) == {(1, 11)}
    assert candidates.common_name_rescue(records, w).count() == 0


def test_recall(records, spark):
    true = spark.createDataFrame([(1, 11), (1, 12)], "s1_id long, cand_id long")
    assert candidates.recall(true.limit(1), true).first()["recall"] in (0.5,)
    assert candidates.recall(true, true.limit(0)).first()["recall"] is None


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, 11, 0.95), (2, 11, 0.4), (3, 11, 0.4), (1, 12, 0.92), (2, 13, 0.7), (3, 13, 0.7), (4, 14, 0.005), (5, 15, 1.0)]
    return spark.createDataFrame(rows, "s1_id long, cand_id long, prob double").cache()


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([(1, 11), (1, 12), (3, 13), (6, 16)], "s1_id long, cand_id long")


@pytest.fixture(scope="module")
def s1(spark):
    return spark.createDataFrame([(k, "x" if k < 4 else "y") for k in range(1, 8)], "s1_id long, country string")


def test_one_owner_and_thresholds(scored):
    owned = decide.assign_owner(scored)
    assert pairs(owned) == {(1, 11), (1, 12), (2, 13), (4, 14), (5, 15)}  # ties to the smaller id
    assert pairs(decide.decide(scored, 0.93)) == {(1, 11), (5, 15)}
    assert pairs(decide.keep_by_rank(owned, 0.5, 0.95)) == {(1, 11), (2, 13), (5, 15)}
    assert pairs(decide.decide(scored.withColumn("thr", F.lit(0.99)))) == {(5, 15)}


def test_truth_against_itself_is_perfect(truth, s1):
    r = decide.macro_f05(truth, truth, s1).first()
    assert r["macro_f05"] == r["micro_precision"] == r["micro_recall"] == r["singleton_acc"] == 1 and r["n"] == 7


def test_empty_predictions(truth, s1):
    r = decide.macro_f05(truth.limit(0), truth, s1).first()
    assert r["macro_f05"] == pytest.approx(4 / 7) and r["micro_recall"] == 0 and r["singleton_acc"] == 1


def test_tuning_equals_a_loop(scored, truth, s1):
    for r in decide.tune_rank_thresholds(scored, truth, s1, [0.4, 0.6], [0.6, 0.8]).collect():
        kept = decide.keep_by_rank(decide.assign_owner(scored), r["thr_top"], r["thr_rest"])
        assert r["macro_f05"] == pytest.approx(decide.macro_f05(kept, truth, s1).first()["macro_f05"])
    flat = decide.tune_threshold(scored, truth, s1)
    best = decide.best_of(flat).first()
    assert best["macro_f05"] == pytest.approx(max(r["macro_f05"] for r in flat.collect()))
    assert flat.count() == 15


def test_expected_f_takes_certain_records_and_leaves_doubtful_ones(scored):
    got = pairs(decide.expected_f_decision(scored))
    assert {(1, 11), (1, 12), (5, 15)} <= got and (4, 14) not in got


def test_error_buckets_add_up(scored, truth):
    predicted = decide.decide(scored, 0.5)
    rows = {(r["kind"], r["class"]): r["n"] for r in decide.error_buckets(scored, predicted, truth, decide.assign_owner(scored)).collect()}
    assert rows == {("FP", "singleton_false_positive"): 2, ("FN", "multi_owner_ranking_conflict"): 1, ("FN", "blocking_false_negative"): 1}


def test_context_ranks_and_margins(scored):
    rows = {(r["s1_id"], r["cand_id"]): r for r in context.prob_context(scored).collect()}
    assert [rows[k, 11]["p1_rank_cand"] for k in (1, 2, 3)] == [1, 2, 3]
    assert rows[1, 11]["p1_margin_cand"] == pytest.approx(0.55) and rows[2, 11]["p1_margin_cand"] == pytest.approx(-0.55)
    assert rows[5, 15]["p1_margin_cand"] == 1 and rows[1, 11]["p1_n_high_s1"] == 2
    logits = {(r["s1_id"], r["cand_id"]): r for r in context.logit_context(scored.withColumnRenamed("prob", "ce_logit")).collect()}
    assert logits[2, 13]["p2_ce_gap_cand"] == 0 and logits[5, 15]["p2_ce_gap_cand"] is None  # a tie; alone


def test_competitors_and_siblings(scored, spark):
    sources = spark.createDataFrame([(11, 2), (12, 2), (13, 3), (14, 3), (15, 2)], "cand_id long, src int")
    rows = {(r["s1_id"], r["cand_id"]): r for r in context.source_context(scored, sources).collect()}
    assert rows[1, 11]["p1_src_n_high_s1"] == 1 and rows[1, 11]["p1_src_max_s1"] == 0.92 and rows[2, 11]["p1_src_n_high_comp"] == 1 and rows[5, 15]["p1_src_max_comp"] == -1
    values = spark.createDataFrame([(11, "a"), (12, "a"), (13, ""), (14, None), (15, "a")], "cand_id long, v string")
    rows = {(r["s1_id"], r["cand_id"]): r for r in context.sibling_context(scored, values, {"v": "v"}).collect()}
    assert rows[1, 11]["p1_sib_v_s1"] == 1 and rows[2, 11]["p1_sib_v_comp"] == 1 and rows[2, 13]["p1_sib_v_s1"] == 0 and rows[5, 15]["p1_sib_v_comp"] == -1


def test_context_is_of_the_survivors(scored):
    got = decide.filtered_context(scored, context.prob_context, 0.5).filter("cand_id = 11").first()
    assert got["p1_margin_cand"] == 0.95


def test_number_relations(spark):
    recs = spark.createDataFrame([("a", "1629 84"), ("b", "162"), ("c", "650"), ("d", "1650"), ("e", ""), ("f", "105")], "entity_id string, addr_nums string")
    p = spark.createDataFrame([("a", "b"), ("d", "c"), ("a", "e"), ("a", "f"), ("a", "a"), ("a", "zz")], "s1_id string, cand_id string")
    rows = {(r["s1_id"], r["cand_id"]): r for r in features.number_relations(p, recs).collect()}
    assert rows["a", "b"]["f_nr_first_prefix"] == 1 and rows["a", "b"]["f_nr_trunc_len"] == 3
    assert rows["d", "c"]["f_nr_first_suffix"] == 1 and rows["a", "e"]["f_nr_first_logdiff"] == -1
    assert rows["a", "f"]["f_nr_only_near"] == 1 and rows["a", "a"]["f_nr_first_logdiff"] == 0 and rows["a", "zz"]["f_nr_min_logdiff"] == -1


def test_pair_features_have_all_columns(spark):
    cols = "entity_id long, src int, name_core string, name_main string, name_alt string, name_legal string, name_concat string, name_native boolean, addr_tokens string, addr_words string, addr_nums string, addr_state string, addr_empty boolean"
    recs = spark.createDataFrame([(1, 1, "a b", "a b", "", "inc", "", False, "1 x", "x", "1", "tx", False), (2, 2, "b c", "b c", "q", "llc", "w", False, "1 y", "y", "1", "ny", False)], cols)
    r = features.pair_features(spark.createDataFrame([(1, 2)], "s1_id long, cand_id long"), recs)
    assert len([c for c in r.columns if c.startswith("f_")]) == 43
    got = r.first()
    assert got["f_name_jacc"] == pytest.approx(1 / 3) and got["f_legal_conflict"] == got["f_state_conflict"] == got["f_first_num_eq"] == got["f_concat_b"] == 1
    assert got["f_name_alt_tset"] == 0 and got["f_src_b"] == 2
    assert "f_has_state_a" not in features.feature_columns(r) and "f_name_ratio" not in features.feature_columns(r, ["f_name_ratio"])


def test_word_risk_uses_the_other_fold(spark):
    d = spark.createDataFrame([(0, 1, 0, 1, ["x"], []), (1, 1, 1, 0, ["x"], ["y"]), (3, 1, 1, 0, [], [])], "s1_id long, cand_id long, fold long, label int, extra array<string>, missing array<string>")
    got = {r["s1_id"]: r for r in features.word_risk(d, features.word_stats(d), d.groupBy("fold").agg(F.avg("label").alias("prior"))).collect()}
    assert got[0]["f_extra_rate_min"] == 0 and got[1]["f_extra_rate_min"] == 1 and got[1]["f_missing_rate_mean"] == 1 and got[3]["f_extra_rate_min"] == -1 and got[3]["f_extra_n"] == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_pruned_search_equals_the_whole_one(spark, clustered):
    import numpy as np

    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 6)) * 5
    v = centres[draw.integers(0, 12, 700)] + draw.normal(0, 0.2, (700, 6)) if clustered else draw.normal(size=(700, 6))
    v[40:60] = v[40]  # ties
    rows = [(i, "ab"[i % 5 == 0], x.tolist()) for i, x in enumerate(v)] + [(900, "c", [0.0] * 6), (901, "d", [1.0] * 6)]
    d = spark.createDataFrame(rows, "id long, country string, vec array<double>")
    q, t = d.filter("id % 2 = 0"), d.filter("id % 2 = 1")
    key = lambda x: sorted((r["cand_id"], r["rk"], r["s1_id"], round(r["cos"], 8)) for r in x.collect())
    for k in (1, 3):
        assert key(retrieval.pruned_top(q, t, k, pivots=20, block=50)) == key(retrieval.top2(q, t, k))
    assert retrieval.pruned_top(q, t.limit(0)).count() == retrieval.pruned_top(q.limit(0), t).count() == 0


def test_retrieval_blocks_agree_with_one_block(spark):
    rows = [(k, k % 2, [float((k * 7 + j * 3) % 11) for j in range(6)]) for k in range(60)]
    v = spark.createDataFrame(rows, "id long, country long, vec array<double>").withColumn("vec", retrieval.normalised(F.col("vec")))
    key = lambda df: {(r["cand_id"], r["rk"], r["s1_id"]) for r in df.collect()}
    q, t = v.filter("id % 3 <> 0"), v.filter("id % 3 = 0")
    assert key(retrieval.top2(q, t)) == key(retrieval.top2(q, t, block=4))
    up = retrieval.runner_up(retrieval.top2(q, t))
    assert up.filter("bi_cos < bi_cos2").count() == 0 and up.count() == 40


def test_hard_negatives_fall_back(scored, truth, spark):
    mined = {(r["cand_id"], r["s1_id"]) for r in retrieval.hard_negatives(scored, truth, spark.createDataFrame([(16, 1)], "cand_id long, s1_id long")).collect()}
    assert mined == {(11, 2), (13, 2), (16, 1)}


def test_learned_transliteration(spark):
    rows = [("Green Store", "हरा स्टोर", "1, Maharashtra", "1, महाराष्ट्र")] * 3 + [("Blue Store", "नीला स्टोर", "", ""), ("a b c", "हरा", "x", None)]
    got = {(r["kind"], r["x"]): r["y"] for r in learn.learn_translit(spark.createDataFrame(rows, "name_a string, name_b string, address_a string, address_b string")).collect()}
    assert got["tok", "हरा"] == "green" and got["tok", "स्टोर"] == "store" and got["comp", "महाराष्ट्र"] in ("1", "maharashtra") and ("tok", "नीला") not in got


def test_component_classes(spark):
    rows = [(k, "fr", [f"town{k % 5}", "ile de france" if k % 2 else "idf"]) for k in range(40)]
    comps = spark.createDataFrame(rows, "entity_id long, country string, comps array<string>")
    anchors = spark.createDataFrame([(k, k + 5) for k in range(0, 35)], "s1_id long, cand_id long")
    links = learn.component_links(anchors, comps, min_link=5, share=0.9)
    assert {(r["x"], r["y"]) for r in links.collect()} == {("idf", "ile de france"), ("ile de france", "idf")}
    kinds = {r["x"]: (r["kind"], r["canon"]) for r in learn.component_map(links, comps, hub=4).collect()}
    assert kinds == {"idf": ("state", "idf"), "ile de france": ("state", "idf")}
    assert {r["x"]: (r["kind"], r["canon"]) for r in learn.component_map(links, comps, hub=9).collect()} == {"ile de france": ("alias", "idf")}


def test_clones_and_detwinning(records, truth, scored):
    pool = simulate.clone_pool(records, truth, 3)
    assert pool.count() == 10 + 2 * 2 and pool.filter("entity_id = '14#d2'").count() == 1
    assert simulate.clone_pool(records, truth, 1).count() == 10
    own = scored.select("s1_id", F.col("cand_id").cast("string").alias("cand_id"), "prob")
    both = own.union(own.filter("cand_id = '11'").select("s1_id", F.lit("11#d1"), F.col("prob") / 2))
    got = simulate.detwinned(both, context.prob_context).filter("s1_id = 1 and cand_id like '11%'").select("p1_sum_s1").distinct().collect()
    assert len(got) == 1 and got[0][0] == pytest.approx(0.95 + 0.92)


def test_models_score_out_of_fold(spark):
    rows = [(k, 1000 + k, k % 2, int(k % 3 == 0), float(k % 3), None if k % 5 else 1.0) for k in range(400)]
    d = spark.createDataFrame(rows, "s1_id long, cand_id long, fold long, label int, x double, y double")
    got = model.crossfit(d, ["x", "y"], rounds=8, depth=2)
    assert got.count() == 400 and decide.log_loss(got).first()["accuracy"] == 1
    logits = model.score_pairs(d.select("s1_id", "cand_id", "fold", "label", F.lit("green foods").alias("text_a"), F.when(F.col("label") == 1, "green foods ltd").otherwise("blue ocean").alias("text_b")), dims=256)
    assert logits.filter("(ce_logit > 0) <> (label = 1)").count() == 0
    assert model.fold_sample(d, 0.5).count() == model.fold_sample(d, 0.5).count() < 400


def test_owner_ranker_prefers_true_owners(spark):
    rows = [(s, c, int(s == c % 4), float(s == c % 4) + 0.1 * s) for c in range(80) for s in range(4)]
    got = model.owner_ranker(spark.createDataFrame(rows, "s1_id long, cand_id long, label int, x double"), ["x"])
    assert got.filter("label = 1 and rk_rank <> 1").count() == 0 and got.filter("rk_gap > 0").count() == 0


def test_tsv_round_trip(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"train_source{k}.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS%d_1\tThe "Quoted, Ltd\t\tin\nS%d_2\tshort row\n' % (k, k))
    (tmp_path / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1_1\tS2_1,S3_1,\nS1_2\t\n")
    got = {r["entity_id"]: r for r in tsv.load_split(spark, str(tmp_path), "train").collect()}
    assert len(got) == 6 and got["S2_1"]["business_name"] == 'The "Quoted, Ltd' and got["S3_2"]["country"] == "" and got["S3_1"]["src"] == 3
    truth = tsv.load_ground_truth(spark, str(tmp_path))
    assert pairs(truth) == {("S1_1", "S2_1"), ("S1_1", "S3_1")}
    s1 = spark.createDataFrame([("S1_1",), ("S1_2",)], "s1_id string")
    lists = tsv.id_lists(s1, truth)
    tsv.write_id_lists(lists.coalesce(1), str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        tsv.write_id_lists(lists, str(tmp_path / "out"))
    back = tsv.read_tsv(spark, str(tmp_path / "out"), tsv.TRUTH)
    assert {tuple(r) for r in back.collect()} == {("S1_1", "S2_1,S3_1"), ("S1_2", "")}


def test_tuned_rules_are_kept(scored, truth, s1, tmp_path):
    path = str(tmp_path / "rule")
    first = decide.kept_rule(decide.tune_threshold(scored, truth, s1), path).collect()
    again = decide.kept_rule(decide.tune_threshold(scored, truth.limit(0), s1), path).collect()
    assert first == again and len(first) == 1


def test_integrity(spark, scored, s1):
    recs = spark.createDataFrame([(11,), (12,), (13,), (15,)], "cand_id long")
    bad = {r["rule"]: r["n"] for r in tsv.violations(s1.limit(3), recs, scored.filter("prob > 0.5"), scored).collect()}
    assert bad == {"match_not_candidate": 3, "record_with_several_owners": 2, "unknown_s1": 2, "unknown_record": 1}
    lists = tsv.id_lists(s1, decide.decide(scored, 0.5))
    with pytest.raises(Exception, match="both parts or in neither"):
        tsv.merged(lists, lists.limit(1), s1).collect()


def test_streams(spark, records, tmp_path):
    rows = [(k, f"2024-01-01 0{k % 5}:30:00", "a" if k % 2 else "b", 1.0, k % 3) for k in range(10)]
    src = tmp_path / "events"
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert run(linkage.windowed_counts(stream()), "counted", "update").agg(F.sum("n")).first()[0] == 10
    assert run(linkage.first_seen(stream()), "firsts", "append").count() == 3
    recs = tmp_path / "records"
    records.filter("src <> 1").write.parquet(str(recs))
    linked = run(linkage.linked_stream(spark.readStream.schema(records.schema).parquet(str(recs)), records.filter("src = 1")), "linked", "append")
    assert {(r["entity_id"], r["s1_id"]) for r in linked.filter("s1_id is not null").collect()} == {(11, 1)}


def test_joins_with_counts_can_be_split(spark, records):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = features.rarity(records)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3 and plan.count("ENSURE_REQUIREMENTS") >= 6 + 3


def test_written_tables_can_be_cleared(spark):
    from tessera import runtime

    table = runtime.written(spark.range(3), "numbers")
    assert table.count() == 3
    runtime.clear(spark)
    with pytest.raises(Exception, match="(?i)path|exist"):
        runtime.written(spark.range(1), "n") and table.count()


def test_empty_tables(spark, records, scored, truth, s1):
    none, no_edges = records.limit(0), scored.limit(0)
    assert candidates.generate(none).count() == 0 and decide.assign_owner(no_edges).count() == 0 and context.prob_context(no_edges).count() == 0
    assert decide.macro_f05(no_edges, truth.limit(0), s1).first()["macro_f05"] == 1
    assert learn.word_counts(none.withColumns({"name_concat": F.lit("")})).count() == 0


def test_entry_point_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and json.dumps(sorted(entry.queries()))


def test_segmentation_under_more_words_than_a_driver_should_hold(spark, tmp_path):
    """100,002 words seen three times: the last by name count as all others do."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters[:25] for b in letters for c in letters for d in letters][:100_000] + ["zzgreen", "zzfood"]
    docs = [(i, " ".join(words), "en") for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(1, "http://zzgreenzzfood.com/"), (2, "http://zzfoodzzgreen.org/x"), (3, "https://zzgreenzzfood.net"), (4, "http://short.com"), (5, "no host"), (6, None)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["words"] for r in catalog.QUERIES["viterbi_segment"](spark, str(tmp_path)).collect()}
    assert got == {1: "zzgreen zzfood", 2: "zzfood zzgreen", 3: "zzgreen zzfood", 4: "short", 5: "", 6: ""}
    whole = Segmenter(dict.fromkeys(words, 3))
    texts = ["zzgreenzzfood", "abcdbcdexyz", "qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq", "ünïcödeabcd", "", "tiny"]
    rows = segmented_by_table(spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "text string"), spark.createDataFrame([(w, 3) for w in words], "w string, n long")).collect()
    assert {r["text"]: r["words"] for r in rows} == {t: whole.split(t) for t in texts} and len(rows) == len(texts)


def brute_cosines(spark, folder):
    """(s1_id, cand_id) -> cosine by view, and of all views, from the keys of every record."""
    views = {"name": "name_keys", "addr": "addr_keys", "cross": "cross_keys"}
    records = {r["entity_id"]: r for r in catalog.QUERIES["source_union"](spark, folder).collect()}
    n = Counter(r["country"] for r in records.values())
    weights = defaultdict(dict)
    for view, name in views.items():
        tf = defaultdict(dict)
        for r in catalog.QUERIES[name](spark, folder).collect():
            tf[r["entity_id"]][r["key"]] = r["n"]
        df = Counter((records[i]["country"], k) for i, keys in tf.items() for k in keys)
        for i, keys in tf.items():
            c = records[i]["country"]
            w = {k: (1 + math.log(m)) * (math.log((n[c] + 1) / (df[c, k] + 1)) + 1) for k, m in keys.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            weights[i][view] = {k: x / norm for k, x in w.items()}
    out = {}
    for a in (i for i in weights if records[i]["src"] == 1):
        for b in (i for i in weights if records[i]["src"] != 1 and records[i]["country"] == records[a]["country"]):
            shared = {v: set(weights[a].get(v, ())) & set(weights[b].get(v, ())) for v in views}
            if any(shared.values()):
                cos = {v: sum(weights[a][v][k] * weights[b][v][k] for k in ks) for v, ks in shared.items() if ks}
                out[a, b] = cos | {"comb": sum(cos.values()) / math.sqrt(len(weights[a]) * len(weights[b]))}
    return out


def brute_top(scores, view, side, k):
    by = defaultdict(list)
    for p, cos in scores.items():
        if view in cos and round(cos[view], 9) >= 0.02:
            by[p[side]].append((-round(cos[view], 9), p[1 - side], p))
    return {p for rows in by.values() for _, _, p in sorted(rows)[:k]}


def test_blocking_queries_by_the_operators_limit_equal_brute_force(spark, tmp_path):
    """260 records of a language share all keys of a name: fewer than the operators' limit, more than a limit of 200."""
    odd = {i: f"harbour supply {w}.\nx\n{i % 40} quay road" for i, w in enumerate(["north", "south", "east", "west"] * 5)}
    docs = [(i, odd.get(i, "harbour supply."), "en") for i in range(280)] + [(300 + i, "harbour supply.", "fr") for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    folder = str(tmp_path)
    scores = brute_cosines(spark, folder)
    got = {(r["s1_id"], r["cand_id"]): r["cos"] for r in catalog.QUERIES["comb_cosine"](spark, folder).collect()}
    assert got == pytest.approx({p: cos["comb"] for p, cos in scores.items()}, abs=2e-6)
    top = brute_top(scores, "name", 0, 5) | brute_top(scores, "addr", 0, 5) | brute_top(scores, "comb", 0, 15) | brute_top(scores, "comb", 1, 2)
    rows = {(r["s1_id"], r["cand_id"]): r for r in catalog.QUERIES["candidate_union"](spark, folder).collect()}
    assert set(rows) == top
    for p, r in rows.items():
        assert [r[f"blk_{v}"] for v in ("name", "addr", "cross", "comb")] == pytest.approx([scores[p].get(v, 0.0) for v in ("name", "addr", "cross", "comb")], abs=2e-6)
    plain = {i for i, t, _ in docs if t == "harbour supply."}
    assert any(a in plain and b in plain for a, b in rows)
    assert not any(r["s1_id"] in plain and r["cand_id"] in plain and r["s1_id"] < 300 for r in candidates.generate(catalog.Tables(spark, folder).records, max_df=200).collect())


def copied_documents(spark, folder):
    """Names of few words and many copies, one id in two languages, a null language and a null text."""
    words = ["harbour", "supply", "north", "quayside", "mill"]
    docs = [(i, f"{words[i % 5]} {words[i % 3]} {words[i * i % 4]}.\nx\n{i % 7} {words[i % 2]} road", "en" if i % 4 else "fr") for i in range(90)]
    docs += [(200 + i, "harbour supply.\n5 mill road", "en") for i in range(40)] + [(4, "harbour supply.\n5 mill road", "fr"), (400, "mill", None), (401, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def duck_rows(name, folder):
    import duckdb

    from __spark_entry__ import oracle_sql

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(c.execute(oracle_sql()[name]).fetchall())


def unshuffled_pairs(df):
    """No grouping of all pairs and no join of postings is in the plan, which joins only the countries' sizes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" in plan and "SortMergeJoin" not in plan and "keys=[s1_id" not in plan


@pytest.mark.parametrize("name", ["candidate_union", "blocking_recall", "comb_cosine", "topk_forward_name", "topk_reverse_comb"])
def test_blocked_scores_equal_the_sql(spark, tmp_path, monkeypatch, name):
    """Many small blocks; ties among copies; ids that several countries have."""
    for k, v in {"ONES": 7, "OTHERS": 13}.items():
        monkeypatch.setattr(blocks, k, v)
    folder = copied_documents(spark, tmp_path)
    got = catalog.QUERIES[name](spark, folder)
    if name in ("comb_cosine", "topk_reverse_comb", "topk_forward_name"):  # the others score in a table before
        assert unshuffled_pairs(got)
    rows, want = sorted(tuple(r) for r in got.collect()), duck_rows(name, folder)
    assert len(rows) == len(want) and all(a == pytest.approx(b, abs=2e-6) for a, b in zip(rows, want, strict=True))


@pytest.mark.parametrize("cells", [1, 50, 400, 10**6])
def test_a_block_gives_its_best_pairs_whatever_the_chunks(monkeypatch, cells):
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "PRODUCTS", 16)
    draw = np.random.default_rng(cells)
    rows = [(s, v, i, sorted(draw.choice(30, 5, replace=False).tolist()), draw.choice([0.1, 0.2, 0.3], 5).tolist()) for s, n in ((1, 37), (2, 53)) for i in range(n) for v in ("name", "addr") if (i + s) % 5 or v == "name"]
    table = pa.table({c: pa.array(x, t) for c, x, t in zip(("side", "view", "id", "keys", "ws"), zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)})
    k, scores = {(s, i): 0 for s, _, i, _, _ in rows}, {}
    for s, _, i, _, _ in rows:
        k[s, i] += 1
    for s, v, i, ks, ws in rows:
        for s2, v2, j, ks2, ws2 in rows:
            if (s, s2) == (1, 2) and v == v2 and set(ks) & set(ks2):
                one = scores.setdefault((i, j), {"name": 0.0, "addr": 0.0})
                one[v] += sum(w * dict(zip(ks2, ws2, strict=True)).get(q, 0.0) for q, w in zip(ks, ws, strict=True))
    for p, one in scores.items():
        one["comb"] = (one["name"] + one["addr"]) / math.sqrt(k[1, p[0]] * k[2, p[1]])
    picks = (("name", "s1_id", 3), ("comb", "s1_id", 4), ("comb", "cand_id", 2))
    schema = pa.schema([("s1_id", pa.int64()), ("cand_id", pa.int64()), ("name", pa.float64()), ("addr", pa.float64()), ("comb", pa.float64()), ("picked", pa.int32())])
    out = [r for b in blocks._batches(blocks._Block(table), ("name", "addr", "comb"), picks, 0.02, schema) for r in b.to_pylist()]
    for bit, (score, by, n) in enumerate(picks):
        own = {(r["s1_id"], r["cand_id"]) for r in out if r["picked"] >> bit & 1}
        assert own == brute_top({p: {score: c[score]} for p, c in scores.items() if c[score]}, score, 0 if by == "s1_id" else 1, n)
    assert all(r[c] == pytest.approx(scores[r["s1_id"], r["cand_id"]][c]) for r in out for c in ("name", "addr", "comb"))
    every = [(r["s1_id"], r["cand_id"]) for b in blocks._batches(blocks._Block(table), ("comb",), (), 0.0, pa.schema([schema.field(0), schema.field(1), schema.field(4)])) for r in b.to_pylist()]
    assert sorted(every) == sorted(scores)


def test_top_of_texts_equals_top_of_records_and_encodes_a_text_once(spark, tmp_path):
    names = [None, "", "hot bolt", "cold bolt", "bolt hot", "tlob", "hot plate"]
    rows = [(i, f"land {i % 2}" if i % 17 else None, names[i * i % 7]) for i in range(120)] + [(3, "land 0", "hot bolt"), (4, "land 1", "hot bolt")]
    d = spark.createDataFrame(rows, "entity_id long, country string, text string")
    q, t = d.filter("entity_id % 3 <> 0"), d.filter("entity_id % 3 = 0")
    log, encode = str(tmp_path), retrieval.hashed_ngrams(32)

    def counted(texts):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(texts)))
        return encode(texts)

    key = lambda d: sorted((r["cand_id"], r["rk"], r["s1_id"], round(r["cos"], 8)) for r in d.collect())
    for k in (1, 2, 5):
        want = key(retrieval.top2(retrieval.embed(q, "text", encode), retrieval.embed(t, "text", encode), k))
        assert key(retrieval.top2_of_texts(q, t, encode, k)) == want
    found = retrieval.top2_of_texts(q, t, counted).count()
    assert found and sum(int(p.read_text()) for p in tmp_path.iterdir()) < len(rows)


def test_owner_ranker_scores_one_table_without_a_join(spark):
    rows = [(s, c, int(s == c % 5), float((s * c) % 7) if s else None) for c in range(40) for s in range(5)]
    got = model.owner_ranker(spark.createDataFrame(rows, "s1_id long, cand_id long, label int, x double"), ["x"])
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["s1_id"], r["cand_id"], r["label"], r["x"]) for r in got.collect()} == set(rows)


def test_pair_scores_hash_trigrams_once_for_both_models(spark):
    rows = [(i, i + 100, i % 2 if i % 5 else None, int(i % 3 == 0), f"hot bolt {i % 3}", f"bolt {i % 4}") for i in range(30)]
    d = spark.createDataFrame(rows, "s1_id long, cand_id long, fold int, label int, text_a string, text_b string")
    models = model.fit_pair_scorer(d, 64)
    got = model.score_pair_folds(models, d)
    one = [{r["s1_id"]: float(r["_r"][1]) for r in m.transform(model._with_ngrams(d)).select("s1_id", "_r").collect()} for m in models]
    for r in got.collect():
        i = r["s1_id"]
        assert r["ce_logit"] == pytest.approx({0: one[1][i], 1: one[0][i]}.get(r["fold"], (one[0][i] + one[1][i]) / 2))
    assert got.columns == [*d.columns, "ce_logit"] and got._jdf.queryExecution().analyzed().toString().count(" AS _x#") == 1


def test_model_queries_use_the_operators_defaults(spark, monkeypatch):
    seen = {}

    def stop(name):
        def run(*a, **k):
            seen[name] = (len(a), k)
            raise InterruptedError

        return run

    monkeypatch.setattr(catalog.M, "crossfit", stop("gbt_crossfit"))
    monkeypatch.setattr(catalog.M, "score_pairs", stop("pair_scorer"))
    monkeypatch.setattr(catalog.D, "hashed_ngrams", stop("embedded_names"))
    for name in ("gbt_crossfit", "pair_scorer", "embedded_names"):
        with pytest.raises(InterruptedError):
            catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == {"gbt_crossfit": (2, {}), "pair_scorer": (1, {}), "embedded_names": (0, {})}


def test_inputs_of_one_value_are_left_out_of_a_fit(spark):
    """indicators of features that are never missing were more than half of the inputs of linkage_run's models."""
    draw = random.Random(7)
    rows = [(f"a{i}", f"b{i}", int(x > 0.5), x, 4.0, None if i % 9 == 0 else x * x) for i in range(300) for x in (draw.random(),)]
    d = spark.createDataFrame(rows, "s1_id string, cand_id string, label int, x double, same double, gaps double")
    filled, columns = model.imputed(d, ["x", "same", "gaps"])
    assert columns == ["x", "same", "gaps", "m_x", "m_same", "m_gaps"]
    made = model.train_fold(filled, columns, rounds=2, depth=2)
    assert made.stages[0].getInputCols() == ["x", "gaps", "m_gaps"]
    got = made.transform(filled).select("label", "_y").collect()
    assert sum(r["label"] == r["_y"] for r in got) > 280  # splits are at bins' ends
    alone = model.train_fold(filled, ["same", "m_x"], rounds=1, depth=1)
    assert alone.stages[0].getInputCols() == ["same"] and alone.transform(filled).select("_y").distinct().count() == 1


def test_pairs_with_hashed_trigrams_score_as_those_with_texts(spark):
    """each chain of linkage_run hashed the trigrams of all its pairs three times."""
    draw, words = random.Random(8), "green blue royal grand north lake stores motors press tools".split()
    rows = []
    for i in range(120):
        a = " ".join(draw.sample(words, 3))
        rows.append((f"a{i}", f"b{i}", i // 2 % 2, i % 2, a, a[:-1] if i % 2 else " ".join(draw.sample(words, 3))))
    d = spark.createDataFrame([*rows, ("n", "m", None, 0, "", "")], "s1_id string, cand_id string, fold int, label int, text_a string, text_b string")
    vectors = model.pair_vectors(d, 64)
    assert vectors.columns == ["s1_id", "cand_id", "fold", "label", "_x"]
    by_text, by_vector = (model.score_pair_folds(model.fit_pair_scorer(x, 64), x) for x in (d, vectors))
    assert by_vector.columns == ["s1_id", "cand_id", "fold", "label", "ce_logit"]
    one, two = ({r["s1_id"]: r["ce_logit"] for r in x.collect()} for x in (by_text, by_vector))
    assert len(one) == 121 and one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_rescues_hand_on_the_best_of_large_groups_and_not_all_pairs(spark, monkeypatch):
    """n S1 and n records of one name, all of whose addresses share words: F1, whose n * n pairs filled the disk."""
    n, seen = 120, {}
    schema = "entity_id string, src int, country string, name_core string, name_full string, name_native boolean, addr_tokens string, addr_nums string, addr_empty boolean"
    one = [(f"a{i:03}", 1, "c", "green shop", "green shop", False, f"{i} 7 main street north park side", f"{i} 7", False) for i in range(n)]
    other = lambda name: [(f"b{i:03}", 2, "c", f"{name}{i}" if name == "zz" else name, name, name == "shop green", f"{i} 7 main street north park side", f"{i} 7", False) for i in range(n)]

    def spied(name, at):
        f = getattr(candidates, name)
        monkeypatch.setattr(candidates, name, lambda d, *a: (seen.update({at: d.count()}), f(d, *a))[1])

    spied("_margins", "dba")
    spied("best_per_record", "variant")
    got = candidates.trade_name_rescue(spark.createDataFrame(one + other("zz"), schema)).collect()
    assert {(r["s1_id"], r["cand_id"]) for r in got} == {(f"a{i:03}", f"b{i:03}") for i in range(n)}
    records = spark.createDataFrame(one + other("shop green"), schema)
    got = candidates.variant_rescue(records.withColumn("name_core", F.lit("green shop")), tfidf.postings(records, candidates.views(), 6000)).collect()
    assert {(r["s1_id"], r["cand_id"]) for r in got} == {(f"a{i:03}", f"b{i:03}") for i in range(n)}
    assert seen["variant"] < 10 * n and seen["dba"] <= 2 * n * 4


def test_groups_of_one_bucket_are_not_mixed(spark, monkeypatch):
    a = spark.createDataFrame([("x", "c", "g"), ("y", "c", "h"), ("z", "d", "g")], "s1_id string, country string, group string")
    b = spark.createDataFrame([("p", "c", "g"), ("q", "d", "h")], "cand_id string, country string, group string")
    weights = spark.createDataFrame([(c, "addr", s, i, "k", 1.0) for s, i, c in ((1, "x", "c"), (1, "y", "c"), (1, "z", "d"), (2, "p", "c"), (2, "q", "d"))], "country string, view string, side int, id string, key string, w double")
    monkeypatch.setattr(tfidf, "GROUPED", 10**9)
    assert [tuple(r) for r in tfidf.grouped_best(a, b, weights, "addr", 1, 0.05).collect()] == [("x", "p", 1.0)]
