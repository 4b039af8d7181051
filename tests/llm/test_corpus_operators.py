"""Operators on whole tables against brute force, held-out accuracy and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chat, components, neardup, ranking, toxicity

WORDS = [a + b for a in ("re", "on", "ti", "an", "er", "ou", "en", "st", "th", "ha") for b in ("a", "lo", "mi", "ne", "tu", "ver", "sed", "kin")]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n)) + "."


# Near-duplicates


def brute_fingerprint(text, words=3):
    from xxhash import xxh64_intdigest

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    ws = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + words]) for k in range(len(ws) - words + 1)] if len(ws) >= words else [" ".join(ws)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id that links of two differing bits or fewer reach, by id. prints: fingerprints by id."""
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_equal_brute_force():
    draw = random.Random(5)
    texts = ["", "one", "One two", "one TWO three", "É é x y z", prose(draw, 400), prose(draw, 9000), "a b\x1cc d\x85e f"]
    assert [neardup.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize(("crowd", "groups"), [(64, 4), (3, 4), (0, 4), (64, 5), (64, 8), (2, 6)])
def test_links_connect_all_pairs_within_two_bits(spark, crowd, groups):
    draw = random.Random(7)
    prints = {}
    for centre in range(40):
        c = draw.getrandbits(64)
        for _ in range(12):  # crowded around each centre, at zero to four bits
            f = c
            for _ in range(draw.randint(0, 4)):
                f ^= 1 << draw.randrange(64)
            prints[f] = len(prints) * 3 + 1
    ids = {i: f for f, i in prints.items()}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in ids.values()], "f long")
    links = neardup.links(nodes, crowd=crowd, groups=groups)
    assert all((r["u"] ^ r["v"]).bit_count() <= 2 or ((r["u"] ^ r["v"]) % 2**64).bit_count() <= 2 for r in links.collect())
    got = {r["id"]: r["component"] for r in components.connected_components(links).collect()}
    want = brute_components({signed(f): f for f in ids.values()})
    assert all(got.get(f, f) == want[f] for f in want)


def test_groups_grow_with_the_nodes():
    assert [neardup.groups_for(n, 2) for n in (0, 10**6, 10**8, 10**9, 10**11, 10**15)] == [4, 4, 5, 6, 8, 16]


def test_embedding_distance_is_a_lower_bound(spark):
    draw = random.Random(8)
    rows = [(draw.getrandbits(63), draw.getrandbits(63)) for _ in range(300)] + [(-1, 0), (5, 5)]
    df = spark.createDataFrame(rows, "a long, b long")
    near = df.select(F.bit_count(neardup.embedding(F.col("a")).bitwiseXOR(neardup.embedding(F.col("b")))).alias("low"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"), "a", "b").collect()
    count = lambda f: [(f >> 2 * k & 3).bit_count() for k in range(32)]
    for r in near:
        assert r["low"] == sum(abs(x - y) for x, y in zip(count(r["a"] % 2**64), count(r["b"] % 2**64), strict=True)) <= r["bits"]


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(1, 200)]
    star = [(1000, k) for k in range(1001, 1400)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (2, 1)], "u long, v long")
    assert components._settled(spark.createDataFrame([(3, 1), (2, 1), (9, 5)], "x long, y long"))
    assert not components._settled(spark.createDataFrame([(3, 1), (3, 2)], "x long, y long"))
    assert not components._settled(spark.createDataFrame([(3, 2), (2, 1)], "x long, y long"))
    got = {r["id"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {k: 1 for k in range(1, 201)} | {k: 1000 for k in range(1000, 1400)}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_near_duplicate_query_and_stage(spark, docs_of, odd_rows):
    draw = random.Random(9)
    base = prose(draw, 3000)
    rows = [*odd_rows, (40, base), (41, base.replace(base.split()[1000], "changed", 1)), (42, base.upper()), (43, prose(draw, 300)), (44, None)]
    got = neardup.digest(neardup.near_duplicates(docs_of(rows))).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(t or "") for _, t in rows]
    class_of = brute_components(dict(enumerate(prints)))
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[class_of[k]] = min(i, smallest.get(class_of[k], i))
    want = sorted(((i, f"{prints[k]:016x}", smallest.get(class_of[k])) for k, (i, _) in enumerate(rows)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    kept = neardup.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(smallest.values()) and ids.count(None) == 1
    assert neardup.near_duplicates(docs_of([])).count() == 0 and neardup.keep_one(docs_of([])).count() == 0


# Quality and toxicity


def quality_rows(draw, n):
    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.6
        text = prose(draw, draw.randint(20, 200))
        if not good:
            text = draw.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), text.replace(" ", "### "), (text[:40] + "\n") * 12])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_ranks_held_out_documents(spark, docs_of, odd_rows):
    rows, labels = quality_rows(random.Random(1), 400)
    table = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = ranking.trained(docs, table)
    got = {r["doc_id"]: r for r in ranking.scored(docs, model).collect()}
    mine = [i for i, _ in rows if held(i)]
    assert all(got[i]["held_out"] == held(i) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.3) for i in got)
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in mine]) > 0.95
    odd = ranking.scored(docs_of(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    kept = ranking.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got.values())
    assert {r["score"] for r in ranking.scored(docs, ranking.trained(docs, table.filter("quality = 1"))).collect()} == {0.5}
    assert ranking.scored(docs_of([]), model).count() == 0


def test_quality_does_not_learn_from_held_out_labels(spark, docs_of):
    rows, labels = quality_rows(random.Random(2), 200)
    schema = "doc_id long, quality int, toxic int"
    turned = [(i, 1 - q if held(i) else q, t) for i, q, t in labels]
    models = [ranking.trained(docs_of(rows), spark.createDataFrame(x, schema)) for x in (labels, turned)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].threshold == models[1].threshold


def test_pairwise_loss_and_gradient_equal_a_sum_over_pairs():
    draw = np.random.default_rng(3)
    z, w = draw.normal(size=(9, 5)), draw.normal(size=5)
    over, under = draw.integers(0, 9, 40), draw.integers(0, 9, 40)

    def brute(v):
        return sum(np.log(1 + np.exp(-(z[a] - z[b]) @ v)) for a, b in zip(over, under, strict=True)) / 40 + 0.3 / 2 * v @ v

    value, slope = ranking.loss(z, over, under, w, 0.3)
    assert value == pytest.approx(brute(w))
    steps = np.eye(5) * 1e-5
    assert np.allclose(slope, [(brute(w + e) - brute(w - e)) / 2e-5 for e in steps], atol=1e-7)


def test_fitted_weights_reach_the_minimum():
    draw = np.random.default_rng(4)
    texts = [prose(random.Random(k), 30) if k % 3 else "!? " * (k + 5) for k in range(90)]
    x, y = np.stack([ranking.features(t) for t in texts]), np.asarray([int(k % 3 > 0) for k in range(90)])
    m = ranking._fitted(x, y, 50, 2000, 4000, 0.1, 7)
    z = ranking._steadied(x, m.mean, 50) / m.spread
    pairs = np.random.default_rng(7)
    over, under = pairs.choice(np.flatnonzero(y == 1), 2000), pairs.choice(np.flatnonzero(y == 0), 2000)
    least, slope = ranking.loss(z, over, under, m.weights, 0.1)
    assert np.abs(slope).max() < 1e-4
    assert all(ranking.loss(z, over, under, m.weights + draw.normal(0, 0.05, len(slope)), 0.1)[0] > least for _ in range(20))


def test_the_threshold_is_a_quantile_of_training_scores():
    texts = [prose(random.Random(k), 20 + k) if k % 4 else "|" * (k + 5) for k in range(120)]
    x, y = np.stack([ranking.features(t) for t in texts]), np.asarray([int(k % 4 > 0) for k in range(120)])
    m = ranking.fit(x, y)
    short, quantile = ranking._validated(x, y, ranking.PAIRS // 4, 1e-3, 7)
    assert m.short == short in ranking.SHORT and m.threshold == np.quantile(m.raw(x), quantile)
    assert ranking.fit(x[:9], y[:9]) is not None and ranking.fit(x[y == 1], y[y == 1]) is None


def test_toxicity_finds_single_words_in_held_out_documents(spark, docs_of, odd_rows):
    draw = random.Random(3)
    bad = ["scoundrelly", "vermintide", "gutterous"]
    rows, labels = [], []
    for i in range(500):
        toxic = draw.random() < 0.4
        ws = prose(draw, draw.randint(10, 120)).split()
        if toxic:
            ws.insert(draw.randrange(len(ws)), draw.choice(bad) + draw.choice(["", ",", "!!"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    docs, table = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, table)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in got if held(i)]) > 0.95
    odd = toxicity.scored(docs_of(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got.values())
    # A word at any place of a very long text is seen, also where blocks meet.
    scorer = toxicity.Scorer(model)
    clean = prose(draw, 200)
    long = " ".join([clean] * 700).split()
    for at in (0, toxicity.BLOCK - 1, toxicity.BLOCK, len(long) - 1):
        assert scorer.scores([" ".join([*long[:at], bad[0], *long[at:]])])[0] >= 0.5
    assert scorer.scores([" ".join(long)])[0] < 0.5
    one = [toxicity.Scorer(model).scores([t])[0] for _, t in rows[:20]]
    assert np.allclose(one, scorer.scores([t for _, t in rows[:20]]), atol=1e-5)
    assert toxicity.trained(docs, table.filter("toxic = 0")) is None
    assert {r["score"] for r in toxicity.scored(docs, None).collect()} == {0.0}


def random_model(seed):
    draw = np.random.default_rng(seed)
    table = draw.normal(0, 1, (3 * toxicity.BUCKETS + 1, toxicity.DIMS)).astype(np.float32)
    table[-1] = 0
    filters = [draw.normal(0, 1, (w, toxicity.DIMS, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    bias = [draw.normal(0, 1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    return toxicity.Model(table, filters, bias, draw.normal(0, 1, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), 0.1, draw.normal(0, 1, len(toxicity.LANGUAGES)))


def brute_score(model, text):
    """The convolution word by word: every window that begins at a word of the text, with zeros past its end."""
    ws = toxicity.words(text)
    x = [model.table[list(toxicity.buckets(w))].astype(float).sum(axis=0) for w in ws] or [np.zeros(toxicity.DIMS)]
    z = model.base
    for k, (f, b) in enumerate(zip(model.filters, model.bias, strict=True)):
        for n in range(toxicity.FILTERS):
            best = max(sum(float(x[i + j] @ f[j, :, n]) for j in range(len(f)) if i + j < len(x)) + b[n] for i in range(len(x)))
            z += max(best, 0) * model.out[k * toxicity.FILTERS + n]
    z -= model.thresholds[toxicity.language(ws)]
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("seed", range(4))
def test_toxicity_equals_a_direct_convolution_in_any_company(seed, odd_rows, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 40)  # long texts are parted, batches are run in several pieces
    draw, model = random.Random(seed), random_model(seed)
    texts = [prose(draw, n) for n in (1, 2, 3, 38, 39, 40, 41, 42, 79, 80, 81, 200)] + [t or "" for _, t in odd_rows] + ["", "die und", "the of the"]
    texts = [t if len(t) < 3000 else t[:3000] for t in texts]
    alone = np.concatenate([toxicity.Scorer(model).scores([t]) for t in texts])
    assert np.allclose(alone, [brute_score(model, t) for t in texts], atol=1e-4)
    scorer = toxicity.Scorer(model)
    for _ in range(6):
        order = draw.sample(range(len(texts)), len(texts))
        assert np.array_equal(scorer.scores([texts[i] for i in order]), alone[order])


def test_toxicity_of_training_batches_equals_a_direct_convolution(odd_rows):
    draw, model = random.Random(1), random_model(9)
    texts = [prose(draw, n) for n in (1, 2, 30)] + [t[:2000] for _, t in odd_rows if t] + ["", ""]
    rows = [np.asarray([toxicity.buckets(w) for w in toxicity.words(t)], np.int32).reshape(-1, 3) for t in texts]
    ids, starts, dead = toxicity._joined(rows)
    logits = model.logits(model.pooled(model.parts(model.table[ids].sum(axis=1)), starts, dead)[0])
    model.thresholds[:] = 0
    assert np.allclose(1 / (1 + np.exp(-logits)), [brute_score(model, t) for t in texts], atol=1e-4)


# Nearest neighbours


def test_search_finds_the_nearest_and_exact_scores(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(900, 16)) * draw.uniform(0.5, 2, (900, 1))
    v[100:400] = v[100]  # one very common vector
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [1.0] * 3, 0), (2060, [float("nan")] + [1.0] * 15, 0), (2080, [None] + [1.0] * 15, 0), (2100, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = ann.search(table, lambda i: i % 20 == 0).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by_query) == set(range(0, 900, 20))
    hits = 0
    for q, found in by_query.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21))
        exact = sorted(((-(v[i] * v[q]).sum(), i) for i in range(900) if i != q))[:20]
        hits += len({i for _, i in exact} & {i for _, i, _ in found})
        assert all(s == (v[i] * v[q]).sum() for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    assert hits / (20 * len(by_query)) >= 0.9
    assert ann.search(table.limit(0), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_probed_lists_hold_the_nearest_of_many_vectors(spark, clustered):
    """Few anchors: nearly all results come through lists, bins, blocks and the scan that abandons candidates."""
    draw = np.random.default_rng(12)
    v = draw.normal(size=(40, 24))[draw.integers(0, 40, 6000)] + draw.normal(0, 0.15, (6000, 24)) if clustered else draw.normal(size=(6000, 24))
    v = (v * draw.uniform(0.7, 1.3, (6000, 1))).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = ann.search(table, lambda i: i % 20 == 0, anchors=64, block=256).collect()
    wide, found = v.astype(float), {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 6000, 20):
        exact = (wide * wide[q]).sum(axis=1)
        exact[q] = -np.inf
        mine = sorted(found[q])
        assert [k for k, _, _ in mine] == list(range(1, 21)) and all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in mine)
        hits += len(set(np.argsort(-exact, kind="stable")[:20].tolist()) & {i for _, i, _ in mine})
    assert hits / (20 * 300) >= 0.9


def test_scan_abandons_only_what_its_bound_excludes():
    draw = np.random.default_rng(5)
    v = draw.normal(size=(500, 20))
    dims = 21
    index = ann.Index(np.linalg.qr(draw.normal(size=(dims, dims)))[0], float(np.linalg.norm(v, axis=1).max()), np.zeros((1, dims)), np.arange(480, 500))
    q, ids, lists = v[:7], np.arange(500), np.arange(500) % 3
    probes = np.array([[True, k % 2 == 0, False] for k in range(7)])
    free = ann.scan(q, ids[:7], np.full(7, np.inf), probes, v, ids, lists, index, 5)
    for i in range(7):
        allowed = [j for j in range(480) if j != i and probes[i, lists[j]]]
        want = sorted(allowed, key=lambda j: (-(v[j] * q[i]).sum(), j))[:5]
        assert free[1][free[0] == i].tolist() == want
    apart = ann.squared(index.turned(q, True), index.turned(v, False))
    bounds = np.array([np.sort(apart[i, [j for j in range(480) if j != i]])[4] for i in range(7)])
    tight = ann.scan(q, ids[:7], bounds, np.ones((7, 3), bool), v, ids, lists, index, 5)
    kept = sum(len(set(tight[1][tight[0] == i].tolist()) & set(np.argsort(apart[i])[:6].tolist())) for i in range(7))
    assert kept >= 0.8 * 35 and all(apart[a, b] <= bounds[a] + 1e-9 for a, b in zip(tight[0], tight[1], strict=True))


def test_wide_vectors_make_smaller_blocks():
    assert ann.fitting(20_000, 64, ann.SAMPLE_BYTES) == 20_000 and ann.fitting(20_000, 3_072, ann.SAMPLE_BYTES) == 2_730
    assert ann.fitting(16_384, 65, ann.BLOCK_BYTES) == 16_384 and ann.fitting(16_384, 10**9, ann.BLOCK_BYTES) == 64


def test_bins_hold_lists_up_to_a_block():
    bins, blocks = ann.binned({0: 5, 1: 3, 3: 30, 4: 1, 5: 7}, 7, 8)
    assert bins.tolist() == [0, 0, -1, 1, 2, 2, -1] and blocks == {0: 1, 1: 4, 2: 1}


def test_few_candidates_are_all_found(spark):
    table = spark.createDataFrame([(20 * k, [float(k), 1.0]) for k in range(1, 6)], "vec_id long, embedding array<double>")
    got = ann.search(table, lambda i: i % 20 == 0).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == sorted((20 * a, 20 * b) for a in range(1, 6) for b in range(1, 6) if a != b)


# Chat


def test_masks_hold_exactly_the_assistants_texts():
    draw = random.Random(6)
    tok = chat.tokenizer("byte_bpe_50k.json")
    parts = [*chat.CONTROLS, "\\", "<", "[", "<\\|turn|>", "<|turn|", "a ", "é", "😀", "\n", "%", "%0A", "<<", "<<\\\\SYS>>", "</s", "<\\", "|end|>", "日本", "  "]
    for _ in range(800):
        turns = [(draw.choice(["user", "assistant", "sys\ntem", "a%0A", "<|end|>"]), "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))) for _ in range(draw.randint(1, 4))]
        r = chat.render(turns)
        assert chat.parse(r.text) == turns
        assert r.text.count(chat.START) == r.text.count(chat.END) == len(turns) and not any(c in r.text for c in chat.CONTROLS[2:])
        e = tok.encode(r.text, add_special_tokens=False)
        mask, spans = chat.loss_spans(r, np.asarray(e.offsets, np.int64).reshape(-1, 2))
        want = "".join(t for role, t in turns if role == "assistant")
        assert "".join(chat._unescaped_runs(r.text, spans.tolist())) == want
        assert mask.any() == bool(want)


def test_chat_query(spark):
    rows = [(1, 1, "assistant", "fine, thanks"), (1, 0, "user", "how are you?"), (2, 0, "user", None), (2, 1, None, "x"), (3, 0, "assistant", "</s>" * 3), (3, 0, "assistant", "</s>" * 3)]
    table = chat.conversations_with_probe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1)))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(table)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, -7}
    assert got[1]["turns_sha256"] == sha("user\nhow are you?\nassistant\nfine, thanks\n") and got[1]["loss_sha256"] == sha("fine, thanks")
    assert got[2]["turns_sha256"] == sha("user\n\n\nx\n") and got[2]["loss_chars"] == 0
    assert got[3]["n_turns"] == 2 and got[3]["loss_sha256"] == sha("</s>" * 6)
    assert got[-7]["loss_sha256"] == sha("</s>[INST] ok [/INST]") and got[-7]["loss_chars"] == 21
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_rows_without_conversation_are_conversations_of_their_own(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (None, None, None, None), (1, 0, "user", "c")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.format_conversations(table)).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (0, 1, 1), (1, 1, 0)]
