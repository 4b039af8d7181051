"""The pipeline's stages one after the other, against their operators applied to what the predecessor kept."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import neardup, ranking, secrets, toxicity
from tests.llm.test_corpus_operators import prose, quality_rows


def tables(spark, folder):
    draw = random.Random(11)
    rows, labels = quality_rows(draw, 150)
    bad = "scoundrelly"
    out = []
    for i, (_, text) in enumerate(rows):
        toxic = labels[i][1] == 1 and i % 3 == 0
        labels[i] = (i, labels[i][1], int(toxic))
        out.append((i, f"{text} {bad}, {bad}" if toxic else text))
    out += [(200 + k, out[1][1]) for k in range(5)] + [(300, prose(draw, 50) + " token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), (301, None), (302, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in out], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return out


def test_stages_filter_and_pass_on(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_stage", "toxicity_stage", "neardup_stage", "secret_stage", "packing_stage"]
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, now, folder)
        assert after.columns == docs.columns
        got = {r["doc_id"]: r["text"] for r in after.collect()}
        mine = {r["doc_id"]: r["text"] for r in now.collect()}
        if k == 0:
            want = {r["doc_id"] for r in ranking.scored(now, ranking.trained(now, labels)).filter("predicted = 1").collect()}
        elif k == 1:
            want = {r["doc_id"] for r in toxicity.scored(now, toxicity.trained(now, labels)).filter("predicted = 0").collect()}
        elif k == 2:
            want = {r["doc_id"] for r in neardup.near_duplicates(now).filter("component_id = doc_id").collect()}
        else:
            want = set(mine)
            assert all(got[i] == t or secrets.scan(t) for i, t in mine.items())
            assert not any(secrets.scan(t or "") for t in got.values())
        assert set(got) == want
        after.write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
    last = corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in now.collect()}
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, folder).collect()) == key(last)


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_a_text_without_copy_stays_where_its_doc_id_has_another_text(spark, docs_of):
    draw = random.Random(5)
    a, b, c, d, e, f = (prose(draw, 60) for _ in range(6))
    rows = [(1, a), (7, a), (7, b), (7, e), (8, a), (8, a), (9, c), (9, c), (9, f), (10, d), (11, f), (None, a)]
    table = docs_of(rows).withColumn("_f", F.lit(1)).withColumn("__F", F.lit(2))
    got = neardup.keep_one(table)
    assert got.columns == table.columns
    got = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert got == sorted([(1, a), (7, b), (7, e), (9, c), (9, f), (10, d), (None, a)], key=str)
