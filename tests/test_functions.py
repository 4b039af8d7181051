"""Golden rows of normalisation, keys and similarities."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions import normalize as N
from tessera.functions import similarity as S
from tessera.functions import tables
from tessera.functions import text as X
from tessera.functions.segment import Segmenter, segmented


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("word", "key"), [("lakshmi", "lxm"), ("laxmi", "lxm"), ("shree", "sr"), ("sree", "sr"), ("jai", "j"), ("jay", "j"), ("", ""), ("zebra", "jbr"), ("aabba", "ab")]
)
def test_variant_key(spark, word, key):
    assert one(spark, word, X.variant_key) == key


@pytest.mark.parametrize(("text", "plain"), [("Crème Brûlée", "Creme Brulee"), ("Straße Œuvre", "Strasse OEuvre"), ("ASCII", "ASCII"), ("日本 x", "日本 x"), ("Ångström Łódź", "Angstrom Lodz"), ("", "")])
def test_fold(spark, text, plain):
    assert one(spark, text, X.fold) == plain


def test_scripts(spark):
    rows = {"abc": (False, False), "é": (True, False), "लक्ष्मी": (True, True), "": (False, False), "a日": (True, True)}
    for text, (native, other) in rows.items():
        assert (one(spark, text, X.is_native), one(spark, text, X.is_non_latin)) == (native, other)


def test_fixed_digits(spark):
    for token, fixed in {"6reen": "green", "2020": "2020", "14th": "14th", "1st": "1st", "b0b": "bob", "x2": "x2", "abc": "abc"}.items():
        assert one(spark, token, N.fixed_digits) == fixed


def test_order_free_ignores_order_repeats_and_blanks(spark):
    assert one(spark, " b a  b ", X.order_free) == "a b"
    assert one(spark, None, X.order_free) == "" == one(spark, "", X.order_free)


NAMES = {
    "M/s Sharma & Sons Pvt. Ltd.": {"name_full": "sharma and sons private limited", "name_core": "sharma sons", "name_legal": "limited private"},
    "Global Global Corp": {"name_full": "global corp", "name_core": "global"},
    "Acme L.L.C. dba Best 6reen Shop": {"name_core": "acme best green shop", "name_main": "acme", "name_alt": "best green shop", "name_legal": "llc"},
    "www.mishawan-reliable.com": {"name_core": "mishawanreliable", "name_concat": "mishawanreliable"},
    "Dr. alluredigital.com": {"name_core": "alluredigital", "name_concat": "alluredigital"},
    "Customer#000000012 Store": {"name_core": "customer store", "name_concat": ""},
    "Follow @greenfoods": {"name_core": "follow", "name_concat": "greenfoods"},
    "Café Société S.A.R.L.": {"name_core": "cafe societe", "name_legal": "sarl"},
    "Phone 123456789 Shop (India)": {"name_full": "phone shop india", "name_core": "phone shop india"},
    "": {"name_full": "", "name_core": "", "name_native": False},
    "लक्ष्मी Traders": {"name_native": True, "name_core": "lkshmi traders"},
}


def test_name_features(spark):
    df = spark.createDataFrame([(n, "x") for n in [*NAMES, None]], "business_name string, name_alt_ string")
    got = {r["business_name"]: r for r in N.with_name_features(df).collect()}
    for name, want in NAMES.items():
        assert {c: got[name][c] for c in want} == want, name
    assert got[None]["name_full"] == "" and got[None]["name_native"] is False


def test_own_country_words_go_unless_nothing_is_left(spark):
    df = spark.createDataFrame([("Tata Steel (India)", "India"), ("India", "India")], "business_name string, country string")
    got = {r["business_name"]: r["name_core"] for r in N.with_name_features(df, country="country").collect()}
    assert got == {"Tata Steel (India)": "tata steel", "India": "india"}


def test_learned_words_romanise_names_and_addresses(spark):
    df = spark.createDataFrame([("लक्ष्मी स्टोर", "12, महाराष्ट्र, लक्ष्मी road")], "business_name string, business_address string")
    words = F.create_map(F.lit("लक्ष्मी"), F.lit("lakshmi"), F.lit("स्टोर"), F.lit("store"))
    comps = F.create_map(F.lit("महाराष्ट्र"), F.lit("maharashtra"))
    r = N.with_address_features(N.with_name_features(df, token_map=words), component_map=comps, token_map=words).first()
    assert (r["name_core"], r["addr_tokens"], r["addr_state"]) == ("lakshmi store", "12 lakshmi road", "mh")


ADDRESSES = {
    "60bis R de Rivoli, Paris": ("60 bis rue rivoli paris", "60", "", False),
    "Flat 007, B177 MG Rd, Bengaluru, Karnataka": ("7 b 177 mahatma gandhi road bengaluru", "7 177", "ka", False),
    "14th St, New York, NY 10001": ("14 street ny 10001", "14 10001", "ny", False),
    "1 Main St, TX": ("1 main street", "1", "tx", False),
    "<null>, n/a": ("", "", "", True),
    "0012345678 Long Ave": ("long avenue", "", "", False),
    "": ("", "", "", True),
    "5 N 5 Apt, 000": ("5 north 5 0", "5 0", "", False),
}


def test_address_features(spark):
    df = spark.createDataFrame([(a,) for a in [*ADDRESSES, None]], "business_address string")
    got = {r["business_address"]: r for r in N.with_address_features(df).collect()}
    for address, (tokens, nums, state, empty) in ADDRESSES.items():
        r = got[address]
        assert (r["addr_tokens"], r["addr_nums"], r["addr_state"], r["addr_empty"]) == (tokens, nums, state, empty), address
    assert got[None]["addr_empty"] is True
    assert got["60bis R de Rivoli, Paris"]["addr_words"] == "bis rue rivoli paris"


def test_learned_address_maps(spark):
    df = spark.createDataFrame([("1 x, ile de france, old town",)], "business_address string")
    r = N.with_address_features(df, alias_map=F.create_map(F.lit("old town"), F.lit("new town")), state_map=F.create_map(F.lit("ile de france"), F.lit("idf"))).first()
    assert (r["addr_state"], r["addr_tokens"]) == ("idf", "1 x new")


def test_tables_are_whole():
    assert len(tables.US_STATES) == 52 and len(tables.LEGAL_PHRASES) == 9 and len(set(tables.ADDRESS_STOP)) == 66
    assert len(tables.ADDRESS_WORDS) == 149 and len(tables.LEGAL_FORMS) == 44


def test_keys(spark):
    assert one(spark, "alphabet beta", K.name_keys) == ["walphabet", "wbeta", "palph", "sabet", "qalphabet_beta", "calphabetbeta"]
    assert one(spark, "a", K.name_keys) == ["wa", "ca"] and one(spark, "", K.name_keys) == []
    assert one(spark, "12 main road", K.addr_keys) == ["a12", "amain", "aroad", "b12_main", "bmain_road"] and one(spark, None, K.addr_keys) == []
    assert one(spark, "b a b", lambda c: K.cross_keys(c, F.lit("7 8"))) == ["xb|7", "xa|7", "xb|8", "xa|8", "yab|7", "yab|8"]
    assert one(spark, "12 main road main", lambda c: K.num_word_keys(F.lit("12"), c)) == ["12|main", "12|road"]
    assert one(spark, "ab c", K.char_trigrams) == [" ab", "ab ", " c "]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_equals_dynamic_programming():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ("".join(draw.choice("abcd ") for _ in range(draw.randint(0, 30))) for _ in "ab")
        assert S.lcs(a, b) == brute_lcs(a, b) == S.lcs(b, a)


def test_ratios():
    assert S.indel_ratio("", "") == 100 and S.indel_ratio("", "a") == 0 and S.indel_ratio("abcd", "abxd") == pytest.approx(75)
    assert S.token_sort_ratio("b a", "a b") == 100 and S.token_set_ratio("a b c", "b a") == 100 and S.token_set_ratio("", "a") == 0
    assert S.partial_ratio("main", "12 main road") == 100 and S.partial_ratio("", "x") == 0
    assert S.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and S.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4) and S.jaro_winkler("", "") == 1 and S.jaro_winkler("a", "") == 0


ROMANISED = {
    "दिल्ली": "dilli", "लक्ष्मी स्टोर्स": "lkshmi stors", "मुंबई १२": "munbi 12", "ঢাকা": "dhaka", "తెలుగు": "telugu", "ગુજરાત": "gujrat", "ଓଡ଼ିଆ": "odia",
    "Москва Щука": "Moskva Shchuka", "Αθήνα": "Athina", "القاهرة": "alqahrt", "ירושלים": "yrvshlym", "さいたま カタカナ": "saitama katakana", "서울 한국": "seoul hanguk",
    "日本 café": "日本 cafe", "plain": "plain", "😀 я": "😀 ya", "": "",
}


def test_other_scripts_are_romanised_letter_by_letter(spark):
    from tessera.functions import romanise

    df = spark.createDataFrame([(k,) for k in ROMANISED], "s string")
    assert {r["s"]: r["r"] for r in df.select("s", X.fold(F.col("s")).alias("r")).collect()} == ROMANISED
    blocks = [chr(c) for a, b in romanise.BLOCKS for c in range(a, b + 1)]
    got = spark.createDataFrame([(c,) for c in blocks], "s string").select("s", X.romanised(F.col("s")).alias("r")).collect()
    assert {r["s"]: r["r"] for r in got} == {c: c if x == romanise.SAME else x for c, x in zip(blocks, romanise.spellings(), strict=True)}


def test_spelling_variants_of_romanised_and_written_names_meet(spark):
    key = lambda s: one(spark, s, lambda c: X.name_variant_key(F.lower(X.fold(c))))
    assert key("लक्ष्मी") == key("Laxmi") == key("lakshmi") and key("दिल्ली") == key("Delhi".replace("lh", "ll"))


def brute_partial(a, b):
    """Every stretch of the longer string, and of both where they are equally long."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    cut = lambda x, y: max(S.indel_ratio(x, y[max(0, i) : i + len(x)]) for i in range(1 - len(x), len(y)))
    return max(cut(x, y) for x, y in ((a, b), (b, a)) if len(x) <= len(y))


def test_partial_ratio_equals_every_stretch_and_is_symmetric():
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abcd e") for _ in range(n))
    pairs = [(word(draw.randint(0, 14)), word(draw.randint(0, 24))) for _ in range(1500)] + [(word(n), word(n)) for n in range(1, 13) for _ in range(60)]
    for a, b in pairs:
        assert S.partial_ratio(a, b) == pytest.approx(brute_partial(a, b)) == pytest.approx(S.partial_ratio(b, a)), (a, b)


def test_jaro_winkler_equals_the_database_function():
    import duckdb
    import pandas as pd

    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(draw.randint(1, 14)))
    pairs = pd.DataFrame([(word(), word()) for _ in range(3000)] + [("abc111", "bca111"), ("abcdef", "fabcde")], columns=["a", "b"])
    for a, b, want in duckdb.sql("SELECT a, b, jaro_winkler_similarity(a, b) FROM pairs").fetchall():
        assert S.jaro_winkler(a, b) == pytest.approx(want, abs=1e-9), (a, b)


def test_pairwise_counts_nulls_as_empty(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "x"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(S.pairwise(S.indel_ratio, F.col("a"), F.col("b"))).collect()] == [100.0, 0.0, 100.0]


def test_segmenter(spark):
    s = Segmenter({"green": 50, "food": 40, "foods": 10, "a": 5, "reen": 1})
    assert s.split("greenfoods") == ["green", "foods"] and s.split("short") == ["short"] and s.split("") == [""]
    assert "".join(s.split("xyzzyxyzzy")) == "xyzzyxyzzy"
    assert one(spark, "greenfood", lambda c: segmented(c, {"green": 5, "food": 4})) == ["green", "food"]


def test_expanded_concat(spark):
    df = N.with_name_features(spark.createDataFrame([("www.greenfoods.com Ltd",), ("Plain Name",)], "business_name string"))
    got = {r["business_name"]: r for r in N.with_expanded_concat(df, segmented(F.col("name_concat"), {"green": 5, "foods": 4})).collect()}
    r = got["www.greenfoods.com Ltd"]
    assert (r["name_core"], r["name_main"], r["name_full"]) == ("green foods", "green foods", "green foods limited")
    assert got["Plain Name"]["name_core"] == "plain name"


def test_folds_and_originals(spark):
    assert one(spark, "S1_0042", X.fold_of) == 0 and one(spark, "S1_7", X.fold_of) == 1 and one(spark, "none", X.fold_of) is None
    assert one(spark, "S2_9#d12", X.original_id) == "S2_9"
