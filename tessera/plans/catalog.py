"""All queries on the stand-in tables, each with the DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import normalize as N
from ..functions import segment, similarity
from ..functions import text as X
from ..functions.tables import DIGRAPHS, STATES, WEBSITE
from ..linkage import Settings, concluded, link
from ..operators import candidates as C
from ..operators import context as W
from ..operators import decide as P
from ..operators import features as Q
from ..operators import learn as L
from ..operators import model as M
from ..operators import retrieval as D
from ..operators import simulate as E
from ..operators import tfidf as T
from ..operators import zone as Z
from ..runtime import loose, scratch, written
from ..sources import parts, tsv
from .fixtures import MAX_DF, Tables, order_free_sql, shaped, shaped_sql, tokens_sql, with_ctes
from .normalize_sql import addresses_sql, fold_sql, names_sql

PAIR = ["s1_id", "cand_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(spec: str, ctes: str = "", body: str | None = None, **more: str):
    """Registers a function of Tables under its name. spec: the result's columns; body: SQL behind the expressions ctes and more."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: shaped(f(Tables(spark, folder)), spec)
        if body:
            ORACLES[f.__name__] = shaped_sql(with_ctes(ctes, body, **more), spec)
        return f

    return register


# Sources and sinks


@query("entity_id:i src:i country:s", "", "SELECT doc_id AS entity_id, doc_id % 3 + 1 AS src, lang AS country FROM documents")
def source_union(t: Tables) -> DataFrame:
    docs = t.read("documents").select(F.col("doc_id").alias("entity_id"), F.col("lang").alias("country"))
    return tsv.with_sources([docs.filter(F.col("entity_id") % 3 == k) for k in range(3)])


@query("s1_id:s cand_id:s", "truth", "SELECT s1_id, cand_id FROM truth")
def gt_explode(t: Tables) -> DataFrame:
    lists = tsv.id_lists(t.s1, t.truth)
    return tsv.exploded_truth(lists)


_LISTS = "SELECT s.s1_id AS source1_entity_id, coalesce(string_agg(CAST(o.cand_id AS VARCHAR), ',' ORDER BY o.cand_id), '') AS matched_entity_ids FROM s1 s LEFT JOIN (SELECT * FROM owned WHERE prob >= 0.8) o ON s.s1_id = o.s1_id GROUP BY s.s1_id"


@query("source1_entity_id:i matched_entity_ids:s", "s1 owned", _LISTS)
def id_list_output(t: Tables) -> DataFrame:
    return tsv.id_lists(t.s1, P.decide(t.scored, 0.8))


_BROKEN = "SELECT s1_id, cand_id FROM edges WHERE prob >= 0.6"


@query("rule:s n:i", "edges s1", f"""SELECT 'match_not_candidate' AS rule, count(*) AS n FROM ({_BROKEN}) WHERE (s1_id, cand_id) NOT IN (SELECT s1_id, cand_id FROM edges WHERE prob >= 0.7)
    UNION ALL SELECT 'record_with_several_owners', count(*) FROM (SELECT cand_id FROM ({_BROKEN}) GROUP BY cand_id HAVING count(*) > 1)
    UNION ALL SELECT 'unknown_s1', count(*) FROM ({_BROKEN}) WHERE s1_id NOT IN (SELECT s1_id FROM s1 WHERE s1_id % 10 <> 0)
    UNION ALL SELECT 'unknown_record', count(*) FROM ({_BROKEN}) WHERE cand_id % 7 = 0""")  # fmt: skip
def integrity_violations(t: Tables) -> DataFrame:
    """A result that breaks every rule: edges without owner decisions, some not candidates, some of unknown ids."""
    return tsv.violations(t.s1.filter("s1_id % 10 <> 0"), t.attributes.filter("cand_id % 7 <> 0"), t.scored.filter("prob >= 0.7"), t.scored.filter("prob >= 0.6"))


@query("rule:s n:i", "", "SELECT * FROM (VALUES ('match_not_candidate', 0), ('record_with_several_owners', 0), ('unknown_s1', 0), ('unknown_record', 0)) v(rule, n)")
def integrity_of_decisions(t: Tables) -> DataFrame:
    """A result of the decision rule, which breaks none."""
    return tsv.violations(t.s1, t.attributes, t.scored, P.decide(t.scored, 0.5))


@query("source1_entity_id:i matched_entity_ids:s", "s1 owned", _LISTS)
def merged_results(t: Tables) -> DataFrame:
    lists = tsv.id_lists(t.s1, P.decide(t.scored, 0.8))
    low = F.col("source1_entity_id") < 50
    return tsv.merged(lists.filter(low), lists.filter(~low), t.s1)


@query("s1_id:i cand_id:i", "edges s1", "SELECT e.s1_id, e.cand_id FROM edges e JOIN s1 USING (s1_id) WHERE CASE WHEN country < 5 THEN prob >= 0.8 ELSE prob >= 0.6 END")
def candidate_export(t: Tables) -> DataFrame:
    scored = t.scored.withColumns({"p1_seen": F.col("prob"), "p1_unseen": F.col("prob")})
    return tsv.exported_candidates(scored, t.s1, t.s1.filter("country < 5").select("country").distinct(), 0.6, 0.8)


# Normalisation


@query("entity_id:i tokens:s", "", f"SELECT doc_id AS entity_id, {order_free_sql('lower(text)')} AS tokens FROM documents")
def order_free_key(t: Tables) -> DataFrame:
    return t.read("documents").select(F.col("doc_id").alias("entity_id"), X.order_free(F.lower("text")).alias("tokens"))


@query("name:s name_full:s name_core:s", "", "SELECT c_name AS name, name_full, name_full AS name_core FROM (SELECT c_name, replace(regexp_replace(regexp_replace(lower(c_name), '#\\s*[0-9]+', ' '), '[^a-z0-9]+', ' ', 'g'), ' ', '') AS name_full FROM customer)")
def name_tokens_core(t: Tables) -> DataFrame:
    return N.with_name_features(t.read("customer").select(F.col("c_name").alias("name")), "name")


_SENTENCES = "SELECT doc_id AS entity_id, string_split_regex(coalesce(text, ''), '[\\n]')[1] AS raw FROM documents"
_TEXTS = "SELECT doc_id AS entity_id, coalesce(text, '') AS raw FROM documents"


@query("entity_id:i native:b non_latin:b folded:s", "", f"SELECT entity_id, regexp_matches(raw, '[^\\x00-\\x7F]') AS native, regexp_matches(raw, '[^\\x00-\\x{{024F}}\\x{{1E00}}-\\x{{1EFF}}]') AS non_latin, {fold_sql('raw')} AS folded FROM ({_TEXTS})")
def name_fold(t: Tables) -> DataFrame:
    return t.read("documents").select(F.col("doc_id").alias("entity_id"), X.is_native(F.col("text")).alias("native"), X.is_non_latin(F.col("text")).alias("non_latin"), X.fold(F.col("text")).alias("folded"))


@query("entity_id:i name_full:s name_core:s name_main:s name_alt:s name_legal:s name_concat:s name_native:b", "", "SELECT * FROM named", **names_sql(_SENTENCES))
def name_features(t: Tables) -> DataFrame:
    lines = t.read("documents").select(F.col("doc_id").alias("entity_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    return N.with_name_features(lines, "line")


@query("page_id:i host:s site:s", "", f"SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, replace(regexp_extract(lower(url), '{WEBSITE}', 1), '-', '') AS site FROM pages")
def website_extract(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), N.website(F.lower("url")).alias("site"))


@query("entity_id:i addr_tokens:s addr_words:s addr_nums:s addr_state:s addr_empty:b", "", "SELECT * FROM addressed", **addresses_sql(_TEXTS))
def address_normalise(t: Tables) -> DataFrame:
    return N.with_address_features(t.read("documents").select(F.col("doc_id").alias("entity_id"), "text"), "text")


_STATE_NAMES = sorted(STATES)


@query("c_custkey:i addr_state:s addr_tokens:s", "", f"""SELECT c_custkey, CASE WHEN place IS NULL THEN '' ELSE codes[place] END AS addr_state, '7 high street' || CASE WHEN place IS NULL THEN ' ' || lower(c_mktsegment) ELSE '' END AS addr_tokens
    FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % {len(STATES)} + 1 END AS place, [{", ".join(f"'{STATES[k]}'" for k in _STATE_NAMES)}] AS codes FROM customer)""")  # fmt: skip
def state_codes(t: Tables) -> DataFrame:
    """Addresses that end in each state's name in turn, a fifth of them in a word that is none."""
    names = F.array(*map(F.lit, _STATE_NAMES))
    place = F.when(F.col("c_custkey") % 5 != 0, F.get(names, (F.col("c_custkey") % len(STATES)).cast("int"))).otherwise(F.col("c_mktsegment"))
    return N.with_address_features(t.read("customer").select("c_custkey", F.concat(F.lit("7 High St, "), F.initcap(place)).alias("address")), "address")


@query("w:s n:i", "records", f"SELECT w, count(*) AS n FROM (SELECT unnest({tokens_sql('name_full')}) AS w FROM records) GROUP BY w HAVING count(*) >= 3")
def vocab_counts(t: Tables) -> DataFrame:
    return L.word_counts(t.records.withColumns({"name_concat": F.lit(""), "name_native": F.lit(False)}))


# Of each end the least cost and the start of its last piece, one end after the other; then the starts from the last end back.
_SEGMENTS = {
    "vocab": f"SELECT w, count(*) AS n FROM (SELECT unnest({tokens_sql('name_full')}) AS w FROM records) GROUP BY w HAVING count(*) >= 3",
    "known": "SELECT map(list(w) FILTER (WHERE length(w) > 1 OR w = 'a'), list(-ln(n / t)) FILTER (WHERE length(w) > 1 OR w = 'a')) AS costs, 5 + ln(any_value(t)) AS unknown FROM (SELECT *, sum(n) OVER () AS t FROM vocab)",
    "hosts": r"SELECT page_id, coalesce(string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.')[1], '') AS text FROM pages",
    "least": """SELECT text, list_reduce(list_prepend([[0.0::DOUBLE, 0.0]], list_transform(range(1, length(text) + 1), lambda e: [[e::DOUBLE]])), lambda done, v: list_append(done,
        list_reduce(list_transform(range(greatest(0, v[1][1]::BIGINT - 20), v[1][1]::BIGINT), lambda i: [done[i + 1][1] + coalesce(costs[substr(text, i + 1, v[1][1]::BIGINT - i)], unknown * (v[1][1] - i)), i]), lambda x, y: CASE WHEN y[1] < x[1] THEN y ELSE x END))) AS best
        FROM (SELECT DISTINCT text FROM hosts WHERE length(text) >= 6), known""",
    "cuts": "SELECT text, list_reverse(list_reduce(list_prepend([length(text)], list_transform(range(length(text)), lambda i: [i])), lambda ends, v: CASE WHEN ends[-1] > 0 THEN list_append(ends, best[ends[-1] + 1][2]::BIGINT) ELSE ends END)) AS c FROM least",
}


@query("page_id:i words:s", "records", "SELECT page_id, coalesce(array_to_string(list_transform(range(1, len(c)), lambda i: substr(text, c[i] + 1, c[i + 1] - c[i])), ' '), text) AS words FROM hosts LEFT JOIN cuts USING (text)", **_SEGMENTS)
def viterbi_segment(t: Tables) -> DataFrame:
    counts = L.word_counts(t.records.withColumns({"name_concat": F.lit(""), "name_native": F.lit(False)}))
    host = F.coalesce(F.get(F.split(F.regexp_extract("url", "^https?://([^/?#]*)", 1), r"\."), F.lit(0)), F.lit(""))
    pages = t.read("pages").select("page_id", host.alias("text"))
    return pages.join(loose(segment.segmented_by_table(pages, counts)), "text").select("page_id", X.joined("words").alias("words"))


_ALIGNED = "SELECT a[i] AS x, b[i] AS y FROM (SELECT a, b, unnest(range(1, len(a) + 1)) AS i FROM (SELECT string_split(x.name_full, ' ') AS a, string_split(y.name_core, ' ') AS b FROM name_pairs p JOIN records x ON x.entity_id = p.cand_id JOIN records y ON y.entity_id = p.s1_id) WHERE len(a) = len(b))"


@query("x:s y:s n:i", "records name_pairs", "SELECT x, arg_min(y, (-n, y)) AS y, max(n) AS n FROM c GROUP BY x HAVING max(n) >= 2 AND max(n) / sum(n) >= 0.5", c=f"SELECT x, y, count(*) AS n FROM ({_ALIGNED}) GROUP BY x, y")
def translit_mode_map(t: Tables) -> DataFrame:
    a = t.records.select(F.col("entity_id").alias("cand_id"), F.split("name_full", " ").alias("source"))
    b = t.records.select(F.col("entity_id").alias("s1_id"), F.split("name_core", " ").alias("target"))
    return L.mode_map(L.aligned_counts(t.name_pairs.join(a, "cand_id").join(b, "s1_id"), native_only=False))


def _word_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Anchors, and the words of addresses as components."""
    comps = t.records.select("entity_id", "country", F.array_distinct(X.tokens(F.col("addr_words"))).alias("comps"))
    return t.name_pairs, comps


_LINKS = {
    "comps": f"SELECT entity_id, country, list_distinct({tokens_sql('addr_words')}) AS c FROM records",
    "cd": "SELECT a.country, list_filter(a.c, lambda z: NOT list_contains(b.c, z)) AS da, list_filter(b.c, lambda z: NOT list_contains(a.c, z)) AS db FROM name_pairs p JOIN comps a ON a.entity_id = p.s1_id JOIN comps b ON b.entity_id = p.cand_id WHERE len(a.c) > 0 AND len(b.c) > 0",
    "single": "SELECT country, x, count(*) AS m FROM (SELECT country, unnest(list_concat(da, db)) AS x FROM cd) GROUP BY ALL",
    "o1": "SELECT country, x, unnest(db) AS y FROM (SELECT country, unnest(da) AS x, db FROM cd)",
    "cp": "SELECT country, x, y, count(*) AS n FROM (SELECT country, x, y FROM o1 UNION ALL SELECT country, y, x FROM o1) GROUP BY ALL",
    "cb": "SELECT country, x, max(n) AS n, arg_min(y, (-n, y)) AS y FROM cp GROUP BY country, x",
}


@query("country:s x:s y:s n:i", "name_pairs", "SELECT country, x, y, n FROM cb JOIN single USING (country, x) WHERE n >= 2 AND n >= 0.5 * m", **_LINKS)
def component_links(t: Tables) -> DataFrame:
    return L.component_links(*_word_sets(t), min_link=2, share=0.5)


_CLASSES = {
    "links": "SELECT country, x, y FROM cb JOIN single USING (country, x) WHERE n >= 2 AND n >= 0.5 * m",
    "ends": "SELECT country, x, y FROM links UNION SELECT country, y, x FROM links",
    "reach": "SELECT country, x, x AS r FROM ends UNION SELECT reach.country, reach.x, ends.y FROM reach JOIN ends ON ends.country = reach.country AND ends.x = reach.r",
    "class": "SELECT country, x, min(r) AS label FROM reach GROUP BY ALL",
    "each": "SELECT country, entity_id, unnest(c) AS x FROM comps",
    "freq": "SELECT country, x, count(*) AS f FROM each GROUP BY ALL",
    "canon": "SELECT country, label, arg_min(x, (-coalesce(f, 0), x)) AS canon FROM class LEFT JOIN freq USING (country, x) GROUP BY ALL",
    "often": "SELECT country, x FROM freq JOIN (SELECT country, count(*) AS n FROM comps GROUP BY ALL) USING (country) WHERE f >= 0.002 * n",
    "present": "SELECT * FROM each SEMI JOIN often USING (country, x)",
    "hubs": "SELECT c.country, c.label, count(DISTINCT z.x) AS hub FROM canon c JOIN present a ON a.country = c.country AND a.x = c.canon JOIN present z ON z.country = a.country AND z.entity_id = a.entity_id AND z.x <> a.x WHERE NOT EXISTS (SELECT 1 FROM class k WHERE k.country = c.country AND k.label = c.label AND k.x = z.x) GROUP BY ALL",
    "kinds": "SELECT country, x, canon, coalesce(hub, 0) >= 4 AS state FROM class JOIN canon USING (country, label) LEFT JOIN hubs USING (country, label)",
}


@query("country:s x:s kind:s canon:s", "name_pairs", "SELECT country, x, CASE WHEN state THEN 'state' ELSE 'alias' END AS kind, CASE WHEN state THEN replace(canon, ' ', '_') ELSE canon END AS canon FROM kinds WHERE state OR x <> canon", **_LINKS, **_CLASSES)
def component_alignment(t: Tables) -> DataFrame:
    anchors, comps = _word_sets(t)
    return L.component_map(L.component_links(anchors, comps, min_link=2, share=0.5), comps)


@query("entity_id:i addr_state:s", "records", "SELECT entity_id, CASE WHEN country = 'fr' THEN upper(addr_state) ELSE addr_state END AS addr_state FROM records")
def refined_addresses(t: Tables) -> DataFrame:
    again = t.records.withColumn("addr_state", F.upper("addr_state"))
    return L.refined(t.records, again, t.records.filter("country = 'fr'").select("country").distinct(), ["addr_state"])


# Blocking keys

_PAIRS = "list_transform(list_filter(range(1, len(u) + 1), lambda i: len(u) BETWEEN 2 AND 8), lambda i: list_transform(u[i + 1:], lambda b: 'q' || u[i] || '_' || b))"
_NAME_KEYS = f"""SELECT entity_id, src, country, unnest(list_concat(list_concat(list_concat(list_transform(ts, lambda z: 'w' || z), list_transform(list_filter(ts, lambda z: length(z) >= 6), lambda z: 'p' || left(z, 4))),
    list_concat(list_transform(list_filter(ts, lambda z: length(z) >= 6), lambda z: 's' || right(z, 4)), flatten({_PAIRS}))), CASE WHEN len(ts) > 0 THEN ['c' || array_to_string(u, '')] ELSE [] END)) AS key
    FROM (SELECT entity_id, src, country, ts, list_sort(list_distinct(ts)) AS u FROM (SELECT entity_id, src, country, {tokens_sql("CASE WHEN name_core <> '' THEN name_core ELSE name_full END")} AS ts FROM records))"""
_ADDR_KEYS = f"SELECT entity_id, src, country, unnest(list_concat(list_transform(ts, lambda z: 'a' || z), list_transform(range(1, len(ts)), lambda i: 'b' || ts[i] || '_' || ts[i + 1]))) AS key FROM (SELECT entity_id, src, country, {tokens_sql('addr_tokens')} AS ts FROM records)"
_FIRST = "list_transform(list_filter(range(1, len({0}) + 1), lambda i: list_position({0}, {0}[i]) = i), lambda i: {0}[i])"
_CROSS_KEYS = f"""SELECT entity_id, src, country, unnest(list_concat(flatten(list_transform(ns, lambda n: list_transform(six, lambda w: 'x' || w || '|' || n))), list_transform(list_filter(ns, lambda n: len(six) > 0), lambda n: 'y' || array_to_string(list_sort(six), '') || '|' || n))) AS key
    FROM (SELECT entity_id, src, country, {_FIRST.format("ts")}[:6] AS six, ns FROM (SELECT entity_id, src, country, {tokens_sql("CASE WHEN name_core <> '' THEN name_core ELSE name_full END")} AS ts, ({tokens_sql("addr_nums")})[:4] AS ns FROM records))"""
_NUM_WORD_KEYS = f"""SELECT entity_id, src, country, unnest(flatten(list_transform(ns, lambda n: list_transform({_FIRST.format("ws")}, lambda w: n || '|' || w)))) AS key
    FROM (SELECT entity_id, src, country, ({tokens_sql("addr_words")})[:10] AS ws, ({tokens_sql("addr_nums")})[:3] AS ns FROM records)"""


def _counted(query_: str) -> str:
    return f"SELECT entity_id, key, count(*) AS n FROM ({query_}) GROUP BY entity_id, key"


def _keys(t: Tables, keys) -> DataFrame:
    return t.records.select("entity_id", F.explode(keys).alias("key")).groupBy("entity_id", "key").agg(F.count("*").alias("n"))


@query("entity_id:i key:s n:i", "records", _counted(_NAME_KEYS))
def name_keys(t: Tables) -> DataFrame:
    return _keys(t, C.views()["name"])


@query("entity_id:i key:s n:i", "records", _counted(_ADDR_KEYS))
def addr_keys(t: Tables) -> DataFrame:
    return _keys(t, C.views()["addr"])


@query("entity_id:i key:s n:i", "records", _counted(_CROSS_KEYS))
def cross_keys(t: Tables) -> DataFrame:
    return _keys(t, C.views()["cross"])


@query("entity_id:i key:s n:i", "records", _counted(_NUM_WORD_KEYS))
def num_word_keys(t: Tables) -> DataFrame:
    return _keys(t, K.num_word_keys(F.col("addr_nums"), F.col("addr_tokens")))


@query("entity_id:i key:s n:i", "", "SELECT p_partkey AS entity_id, substr(' ' || w || ' ', i, 3) AS key, count(*) AS n FROM (SELECT p_partkey, w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)) GROUP BY ALL")
def char_trigrams(t: Tables) -> DataFrame:
    return t.read("part").select(F.col("p_partkey").alias("entity_id"), F.explode(K.char_trigrams(F.col("p_name"))).alias("key")).groupBy("entity_id", "key").agg(F.count("*").alias("n"))


# TF-IDF and candidates

_WEIGHTS = {
    "allkeys": f"SELECT 'name' AS view, * FROM ({_NAME_KEYS}) UNION ALL SELECT 'addr', * FROM ({_ADDR_KEYS}) UNION ALL SELECT 'cross', * FROM ({_CROSS_KEYS})",
    "tf": "SELECT country, view, entity_id AS id, CASE WHEN src = 1 THEN 1 ELSE 2 END AS side, key, count(*) AS tf FROM allkeys GROUP BY ALL",
    "df": f"SELECT country, view, key, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) <= {MAX_DF}",
    "raw": "SELECT tf.*, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w0 FROM tf JOIN df USING (country, view, key) JOIN (SELECT country, count(*) AS n FROM records GROUP BY country) USING (country)",
    "w": "SELECT country, view, id, side, key, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY country, view, id, side)) AS w FROM raw",
    "cosines": "SELECT a.id AS s1_id, b.id AS cand_id, a.view, sum(a.w * b.w) AS cos FROM w a JOIN w b ON a.country = b.country AND a.view = b.view AND a.key = b.key AND a.side = 1 AND b.side = 2 GROUP BY ALL",
    "views": "SELECT side, id, count(DISTINCT view) AS k FROM w GROUP BY ALL",
    "comb": "SELECT s1_id, cand_id, sum(cos) / sqrt(any_value(a.k) * any_value(b.k)) AS cos FROM cosines JOIN views a ON a.side = 1 AND a.id = s1_id JOIN views b ON b.side = 2 AND b.id = cand_id GROUP BY s1_id, cand_id",
    "top": """SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY view, s1_id ORDER BY round(cos, 9) DESC, cand_id) AS rk FROM cosines WHERE view IN ('name', 'addr') AND round(cos, 9) >= 0.02) WHERE rk <= 5
        UNION SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(cos, 9) DESC, cand_id) AS rk, row_number() OVER (PARTITION BY cand_id ORDER BY round(cos, 9) DESC, s1_id) AS rev FROM comb WHERE round(cos, 9) >= 0.02) WHERE rk <= 15 OR rev <= 2""",
}


def _weights(t: Tables, records: DataFrame | None = None) -> DataFrame:
    """Weights of all views as a table, for queries that read them several times."""
    return written(T.postings(records or t.records, C.views(), t.max_df), "postings")


@query("country:s view:s id:i side:i key:s w:f", "records", "SELECT * FROM w", **_WEIGHTS)
def tfidf_weights(t: Tables) -> DataFrame:
    return T.postings(t.records, C.views(), t.max_df)


@query("s1_id:i cand_id:i cos:f", "records", "SELECT * FROM comb", **_WEIGHTS)
def comb_cosine(t: Tables) -> DataFrame:
    return T.comb_cosines(T.postings(t.records, C.views(), t.max_df, True))


@query("s1_id:i cand_id:i cos:f rk:i", "records", "SELECT * FROM (SELECT s1_id, cand_id, cos, row_number() OVER (PARTITION BY s1_id ORDER BY round(cos, 9) DESC, cand_id) AS rk FROM cosines WHERE view = 'name' AND round(cos, 9) >= 0.02) WHERE rk <= 5", **_WEIGHTS)
def topk_forward_name(t: Tables) -> DataFrame:
    return T.best_pairs(T.vectors(T.postings(t.records, {"name": C.views()["name"]}, t.max_df, True)), "name", "s1_id", 5)


@query("s1_id:i cand_id:i cos:f rk:i", "records", "SELECT * FROM (SELECT s1_id, cand_id, cos, row_number() OVER (PARTITION BY cand_id ORDER BY round(cos, 9) DESC, s1_id) AS rk FROM comb WHERE round(cos, 9) >= 0.02) WHERE rk <= 2", **_WEIGHTS)
def topk_reverse_comb(t: Tables) -> DataFrame:
    return T.best_pairs(T.vectors(T.postings(t.records, C.views(), t.max_df, True)), "comb", "cand_id", 2)


@query("s1_id:i cand_id:i blk_name:f blk_addr:f blk_cross:f blk_comb:f", "records", """SELECT p.s1_id, p.cand_id, coalesce(max(CASE WHEN view = 'name' THEN c.cos END), 0) AS blk_name, coalesce(max(CASE WHEN view = 'addr' THEN c.cos END), 0) AS blk_addr,
    coalesce(max(CASE WHEN view = 'cross' THEN c.cos END), 0) AS blk_cross, coalesce(max(b.cos), 0) AS blk_comb FROM top p LEFT JOIN cosines c USING (s1_id, cand_id) LEFT JOIN comb b USING (s1_id, cand_id) GROUP BY p.s1_id, p.cand_id""", **_WEIGHTS)
def candidate_union(t: Tables) -> DataFrame:
    return C.generate(t.records, max_df=t.max_df)


@query("n_true:i n_found:i recall:f", "records name_pairs", "SELECT count(*) AS n_true, count(t.s1_id) AS n_found, count(t.s1_id) / count(*) AS recall FROM name_pairs p LEFT JOIN top t USING (s1_id, cand_id)", **_WEIGHTS)
def blocking_recall(t: Tables) -> DataFrame:
    return C.recall(C.generate(t.records, max_df=t.max_df), t.name_pairs)


_SPELLED = "z"
for _a, _b in DIGRAPHS:
    _SPELLED = f"replace({_SPELLED}, '{_a}', '{_b}')"
_VARIANT = f"list_transform(list_transform({tokens_sql('name_core')}, lambda z: {_SPELLED}), lambda v: left(v, 1) || regexp_replace(substr(v, 2), '[aeiouy]+', '', 'g'))"
_SQUEEZED = f"list_transform({_VARIANT}, lambda v: array_to_string(list_transform(list_filter(range(1, length(v) + 1), lambda i: i = 1 OR substr(v, i, 1) <> substr(v, i - 1, 1)), lambda i: substr(v, i, 1)), ''))"
_VARIED = {"vk": f"SELECT entity_id, src, country, addr_empty, array_to_string(list_sort(list_distinct({_SQUEEZED})), ' ') AS vk FROM records"}


@query("entity_id:i vk:s", "records", "SELECT entity_id, vk FROM vk", **_VARIED)
def variant_keys(t: Tables) -> DataFrame:
    return t.records.select("entity_id", X.name_variant_key(F.col("name_core")).alias("vk"))


@query("cand_id:i s1_id:i", "records", "SELECT cand_id, s1_id FROM (SELECT c.*, row_number() OVER (PARTITION BY cand_id ORDER BY round(cos, 9) DESC, s1_id) AS rk FROM cosines c JOIN vk a ON a.entity_id = s1_id JOIN vk b ON b.entity_id = cand_id WHERE view = 'addr' AND a.vk = b.vk AND a.vk <> '' AND NOT b.addr_empty AND round(cos, 9) >= 0.05) WHERE rk = 1", **_WEIGHTS, **_VARIED)
def rescue_variant_key(t: Tables) -> DataFrame:
    return C.variant_rescue(t.records, _weights(t), ~F.col("addr_empty"))


_SIM = "100.0 * (1 - levenshtein(word, fixed) / greatest(length(word), length(fixed)))"
_FIX = {
    "nw": f"SELECT DISTINCT country, CASE WHEN src = 1 THEN 1 ELSE 2 END AS side, unnest({tokens_sql('name_core')}) AS word FROM records",
    "vocab": "SELECT country, word FROM nw WHERE side = 1",
    "odd": "SELECT country, word FROM nw WHERE side = 2 AND length(word) >= 4 AND (country, word) NOT IN (SELECT country, word FROM vocab)",
    "entry": "SELECT country, word, 1 AS side FROM vocab UNION ALL SELECT country, word, 2 FROM odd",
    "tri": "SELECT country, side, word, substr(' ' || word || ' ', i, 3) AS key, count(*) AS tf FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM entry) GROUP BY ALL",
    "triw": "SELECT *, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY country, side, word)) AS w FROM (SELECT tri.*, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w0 FROM tri JOIN (SELECT country, key, count(*) AS df FROM tri GROUP BY ALL) USING (country, key) JOIN (SELECT country, count(*) AS n FROM entry GROUP BY ALL) USING (country))",
    "near": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, word ORDER BY round(cos, 9) DESC, fixed) AS rk FROM (SELECT a.country, b.word, a.word AS fixed, sum(a.w * b.w) AS cos FROM triw a JOIN triw b ON a.country = b.country AND a.key = b.key AND a.side = 1 AND b.side = 2 GROUP BY ALL) WHERE round(cos, 9) >= 0.1) WHERE rk <= 10",
    "fixes": f"SELECT country, word, fixed FROM (SELECT *, row_number() OVER (PARTITION BY country, word ORDER BY sim DESC, fixed) AS r2 FROM (SELECT country, word, fixed, {_SIM} AS sim FROM near) WHERE sim >= 75) WHERE r2 = 1",
}


def _levenshtein(a, b):
    return F.lit(100.0) * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


_SHOPS = {"records": "SELECT * FROM shops"}


@query("country:s word:s fixed:s", "shops", "SELECT * FROM fixes", **_SHOPS, **_FIX)
def typo_corrections(t: Tables) -> DataFrame:
    return C.corrections(t.shops, similarity=_levenshtein)


_TYPO = f"""SELECT s1_id, cand_id FROM (SELECT p.*, row_number() OVER (PARTITION BY cand_id ORDER BY round(cos, 9) DESC, s1_id) AS rk FROM (SELECT s.s1_id, f.cand_id, f.addr_empty, s.owners, coalesce(c.cos, 0) AS cos
    FROM fixedrec f JOIN s1key s ON s.country = f.country AND s.key = f.key LEFT JOIN (SELECT * FROM cosines WHERE view = 'addr') c ON c.s1_id = s.s1_id AND c.cand_id = f.cand_id) p WHERE CASE WHEN addr_empty THEN owners = 1 ELSE round(cos, 9) >= 0.05 END) WHERE rk = 1"""
_TYPO_CTES = {
    "s1key": f"SELECT country, entity_id AS s1_id, key, count(*) OVER (PARTITION BY country, key) AS owners FROM (SELECT *, {order_free_sql('name_core')} AS key FROM records WHERE src = 1)",
    "recword": f"SELECT country, entity_id AS cand_id, addr_empty, unnest({tokens_sql('name_core')}) AS word FROM records WHERE src <> 1",
    "fixedrec": "SELECT r.country, r.cand_id, r.addr_empty, array_to_string(list_sort(list_distinct(list(coalesce(f.fixed, r.word)))), ' ') AS key FROM recword r LEFT JOIN fixes f USING (country, word) GROUP BY ALL HAVING count(f.fixed) > 0",
}


@query("s1_id:i cand_id:i", "shops", _TYPO, **_SHOPS, **_FIX, **_WEIGHTS, **_TYPO_CTES)
def rescue_typo_group_rule(t: Tables) -> DataFrame:
    return C.typo_rescue(t.shops, _weights(t, t.shops), C.corrections(t.shops, similarity=_levenshtein))


def _margin_sql(cos: float, margin: float) -> str:
    return f"SELECT s1_id, cand_id, cos, margin FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY round(cos, 9) DESC, s1_id) AS rk, cos - coalesce(lead(cos) OVER (PARTITION BY cand_id ORDER BY round(cos, 9) DESC, s1_id), 0) AS margin FROM scores) WHERE rk = 1 AND round(cos, 9) >= {cos} AND round(margin, 9) >= {margin}"


def _number_scores(pool: str) -> dict[str, str]:
    """Weights nwt of number-word keys among a pool of records, and their cosines."""
    return {
        "pool": pool,
        "ntf": f"SELECT country, entity_id AS id, CASE WHEN src = 1 THEN 1 ELSE 2 END AS side, key, count(*) AS tf FROM ({_NUM_WORD_KEYS.replace('FROM records', 'FROM pool')}) GROUP BY ALL",
        "nwt": "SELECT *, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY country, id, side)) AS w FROM (SELECT ntf.*, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS w0 FROM ntf JOIN (SELECT country, key, count(*) AS df FROM ntf GROUP BY ALL) USING (country, key) JOIN (SELECT country, count(*) AS n FROM pool GROUP BY ALL) USING (country))",
        "ncos": "SELECT a.id AS s1_id, b.id AS cand_id, sum(a.w * b.w) AS cos FROM nwt a JOIN nwt b ON a.country = b.country AND a.key = b.key AND a.side = 1 AND b.side = 2 GROUP BY ALL",
    }


_NAMED = f"SELECT DISTINCT entity_id FROM (SELECT country, entity_id, unnest({tokens_sql('name_core')}) AS word FROM records WHERE src <> 1) WHERE (country, word) IN (SELECT country, unnest({tokens_sql('name_core')}) FROM records WHERE src = 1)"


@query("s1_id:i cand_id:i cos:f margin:f", "shops", _margin_sql(0.3, 0.1), **_SHOPS, **_number_scores(f"SELECT * FROM records WHERE src = 1 UNION ALL SELECT * FROM records WHERE src <> 1 AND name_core <> '' AND addr_nums <> '' AND entity_id NOT IN ({_NAMED})"), scores="SELECT * FROM ncos")
def rescue_dba_margin(t: Tables) -> DataFrame:
    return C.trade_name_rescue(t.shops)


_OWNERS = f"SELECT country, word, count(DISTINCT entity_id) AS n FROM (SELECT country, entity_id, unnest({tokens_sql('name_core')}) AS word FROM records WHERE src = 1) GROUP BY ALL"
_AMBIGUOUS = f"SELECT entity_id FROM (SELECT country, entity_id, unnest({tokens_sql('name_core')}) AS word FROM records WHERE src <> 1 AND addr_nums <> '' AND NOT addr_empty) JOIN ({_OWNERS}) USING (country, word) GROUP BY entity_id HAVING min(n) >= 2"


@query("s1_id:i cand_id:i cos:f margin:f", "shops", _margin_sql(0.3, 0.1), **_SHOPS, **_WEIGHTS, **_number_scores(f"SELECT * FROM records WHERE src = 1 OR (src <> 1 AND entity_id IN ({_AMBIGUOUS}))"),
       near="SELECT * FROM (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY cand_id ORDER BY round(cos, 9) DESC, s1_id) AS r0 FROM cosines WHERE view = 'cross' AND round(cos, 9) >= 0.01 AND cand_id IN (SELECT entity_id FROM pool)) WHERE r0 <= 20", scores="SELECT n.s1_id, n.cand_id, coalesce(c.cos, 0) AS cos FROM near n LEFT JOIN ncos c USING (s1_id, cand_id)")
def rescue_common_margin(t: Tables) -> DataFrame:
    return C.common_name_rescue(t.shops, _weights(t, t.shops))


_DOTS = "SELECT q.id AS cand_id, s.id AS s1_id, round(list_dot_product(q.vec, s.vec), 9) AS cos FROM vectors q JOIN vectors s ON q.country = s.country AND q.id % 3 <> 0 AND s.id % 3 = 0"
_TOP2 = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY cos DESC, s1_id) AS rk FROM dots) WHERE rk <= 2"


def _top2(t: Tables, k: int = 2) -> DataFrame:
    v = t.vectors
    return D.top2(v.filter("id % 3 <> 0"), v.filter("id % 3 = 0"), k)


@query("s1_id:i cand_id:i bi_cos:f", "vectors records", "SELECT t.s1_id, t.cand_id, t.cos AS bi_cos FROM top2 t JOIN records a ON a.entity_id = t.s1_id AND a.src = 1 JOIN records b ON b.entity_id = t.cand_id AND b.src <> 1 WHERE rk = 1 AND cos >= 0", dots=_DOTS, top2=_TOP2)
def rescue_precomputed(t: Tables) -> DataFrame:
    return C.precomputed_rescue(t.records, D.runner_up(_top2(t)))


@query("entity_id:i n:i", "records", f"SELECT entity_id, count(*) OVER (PARTITION BY {order_free_sql('name_core')}) AS n FROM records")
def name_group_size(t: Tables) -> DataFrame:
    keyed = t.records.select("entity_id", X.order_free(F.col("name_core")).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.count("*").alias("n")), "k")


# Dense retrieval


@query("cand_id:i s1_id:i cos:f rk:i", "vectors", "SELECT * FROM top2", dots=_DOTS, top2=_TOP2)
def dense_top2(t: Tables) -> DataFrame:
    return _top2(t)


@query("cand_id:i s1_id:i cos:f rk:i", "vectors", "SELECT * FROM top2", dots=_DOTS, top2=_TOP2)
def dense_pruned(t: Tables) -> DataFrame:
    v = t.vectors
    return D.pruned_top(v.filter("id % 3 <> 0"), v.filter("id % 3 = 0"))


@query("cand_id:i s1_id:i bi_cos:f bi_gap:f", "vectors", "SELECT cand_id, max(CASE WHEN rk = 1 THEN s1_id END) AS s1_id, max(CASE WHEN rk = 1 THEN cos END) AS bi_cos, max(CASE WHEN rk = 1 THEN cos END) - max(CASE WHEN rk = 2 THEN cos END) AS bi_gap FROM top2 GROUP BY cand_id", dots=_DOTS, top2=_TOP2)
def dense_margin(t: Tables) -> DataFrame:
    return D.runner_up(_top2(t)).withColumn("bi_gap", F.col("bi_cos") - F.col("bi_cos2"))


@query("s1_id:i cand_id:i f_bi_top1:i f_bi_cos1:f f_bi_gap:f", "vectors", "SELECT t.s1_id, t.cand_id, CASE WHEN rk = 1 THEN 1 ELSE 0 END AS f_bi_top1, CASE WHEN rk = 1 THEN cos END AS f_bi_cos1, CASE WHEN rk = 1 THEN cos - lead(cos) OVER (PARTITION BY cand_id ORDER BY rk) END AS f_bi_gap FROM top2 t", dots=_DOTS, top2=_TOP2)
def retriever_features(t: Tables) -> DataFrame:
    top = _top2(t)
    return D.retriever_features(top.select("s1_id", "cand_id"), D.runner_up(top))


@query("n:i recall_1:f recall_2:f recall_5:f", "vectors", "SELECT count(*) AS n, avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0.0 END) AS recall_1, avg(CASE WHEN f <= 2 THEN 1.0 ELSE 0.0 END) AS recall_2, avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END) AS recall_5 FROM (SELECT cand_id, min(CASE WHEN s1_id % 2 = cand_id % 2 THEN rk END) AS f FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY cos DESC, s1_id) AS rk FROM dots) WHERE rk <= 5 GROUP BY cand_id)", dots=_DOTS)
def recall_at_k(t: Tables) -> DataFrame:
    return D.recall_at(_top2(t, 5), F.col("s1_id") % 2 == F.col("cand_id") % 2)


@query("cand_id:i s1_id:i", "edges truth", "SELECT e.cand_id, arg_max(e.s1_id, (e.prob, -e.s1_id)) AS s1_id FROM edges e JOIN truth t ON e.cand_id = t.cand_id AND e.s1_id <> t.s1_id GROUP BY e.cand_id")
def hard_negatives(t: Tables) -> DataFrame:
    return D.hard_negatives(t.scored, t.truth)


@query("cand_id:i model:s", "edges truth sources", "SELECT s.cand_id, CASE WHEN t.s1_id IS NOT NULL THEN CASE WHEN t.s1_id % 2 = 0 THEN 'B' ELSE 'A' END WHEN substr(md5(CAST(s.cand_id AS VARCHAR)), 32) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'A' ELSE 'B' END AS model FROM sources s LEFT JOIN truth t ON t.cand_id = s.cand_id AND t.cand_id % 4 <> 0")
def routed_models(t: Tables) -> DataFrame:
    owners = t.truth.filter("cand_id % 4 <> 0").select("cand_id", X.fold_of(F.col("s1_id")).alias("fold"))
    return t.sources.join(owners, "cand_id", "left").select("cand_id", D.routed_model(F.col("fold"), F.col("cand_id")).alias("model"))


# Pair features


@query("s1_id:i cand_id:i d:i", "records name_pairs", "SELECT p.s1_id, p.cand_id, levenshtein(a.name_full, b.name_full) AS d FROM name_pairs p JOIN records a ON a.entity_id = p.s1_id JOIN records b ON b.entity_id = p.cand_id")
def edit_distance(t: Tables) -> DataFrame:
    d = Q.joined_records(t.name_pairs, t.records, ["name_full"])
    return d.withColumn("d", F.levenshtein("name_full_a", "name_full_b"))


_TURNED = "substr({0}, 3, 1) || substr({0}, 1, 2) || substr({0}, 4)"


@query("k:i a:s b:s jw:f turned:f", "", f"SELECT a.p_partkey AS k, a.p_name AS a, b.p_name AS b, jaro_winkler_similarity(a.p_name, b.p_name) AS jw, jaro_winkler_similarity(a.p_name, {_TURNED.format('b.p_name')}) AS turned FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_partkey % 3")
def jaro_winkler(t: Tables) -> DataFrame:
    """Parts' names against their own or another's, as they are and with three letters in turn: one and a half transpositions."""
    names = t.read("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), (F.col("p_partkey") + F.col("p_partkey") % 3).alias("other"))
    d = names.join(t.read("part").select(F.col("p_partkey").alias("other"), F.col("p_name").alias("b")), "other")
    turned = F.concat(F.substring("b", 3, 1), F.substring("b", 1, 2), F.substr(F.col("b"), F.lit(4)))
    return d.select("k", "a", "b", *(similarity.pairwise(similarity.jaro_winkler, F.col("a"), c).alias(n) for n, c in (("jw", F.col("b")), ("turned", turned))))


def _named_pairs(t: Tables) -> DataFrame:
    """k, a, b: parts' names and types against their own or another's, some without type, letters or all."""
    key, part = F.col("p_partkey"), t.read("part")
    whole = F.concat_ws(" ", "p_name", F.lower("p_type"))
    a = part.select(key.alias("k"), F.when(key % 50 == 0, "").otherwise(whole).alias("a"), (key + key % 3).alias("other"))
    less = F.concat(F.replace("p_name", F.lit("e"), F.lit("")), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("p_type"))))
    b = part.select(key.alias("other"), F.when(key % 75 == 0, "").when(key % 5 == 0, whole).otherwise(less).alias("b"))
    return a.join(b, "other").select("k", "a", "b")


_NAMED = {
    "b0": "SELECT p_partkey AS k, p_name || ' ' || lower(p_type) AS w, replace(p_name, 'e', '') || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' ' || lower(p_type) END AS l FROM part",
    "np": "SELECT x.k, CASE WHEN x.k % 50 = 0 THEN '' ELSE x.w END AS a, CASE WHEN y.k % 75 = 0 THEN '' WHEN y.k % 5 = 0 THEN y.w ELSE y.l END AS b FROM b0 x JOIN b0 y ON y.k = x.k + x.k % 3",
}
# One row of the table of common subsequences after another: each holds the lengths for all starts of x, and follows from the one before
# and from where the next character of y stands in x.
_LCS = {
    "chars": "SELECT DISTINCT x, y, regexp_extract_all(x, '(?s).') AS a, regexp_extract_all(y, '(?s).') AS b FROM ask",
    "ratio": """SELECT x, y, CASE WHEN x = '' AND y = '' THEN 100.0 ELSE 200.0 * list_reduce(
        list_prepend(list_transform(range(len(a) + 1), lambda z: 0), list_transform(b, lambda c: list_transform(list_prepend('', a), lambda q: CASE WHEN q = c THEN 1 ELSE 0 END))),
        lambda row, hit: list_reduce(list_transform(range(1, len(row) + 1), lambda i: [CASE WHEN i = 1 THEN 0 WHEN hit[i] = 1 THEN row[i - 1] + 1 ELSE row[i] END]), lambda done, v: list_append(done, greatest(done[-1], v[1]))))[-1] / (len(a) + len(b)) END AS r FROM chars""",
}
_STRETCH = "unnest(list_transform(range(1 - length(p), length(q)), lambda i: substr(q, greatest(i, 0) + 1, least(length(p) + i, length(p)))))"


@query("k:i a:s b:s ratio:f partial:f", "", "SELECT k, a, b, r AS ratio, CASE WHEN a = '' OR b = '' THEN CASE WHEN a = b THEN 100 ELSE 0 END ELSE best END AS partial FROM np JOIN ratio ON x = a AND y = b LEFT JOIN (SELECT k, max(r) AS best FROM cut JOIN ratio ON x = p AND y = c GROUP BY k) USING (k)", **_NAMED,
       sides="SELECT k, a AS p, b AS q FROM np WHERE length(a) <= length(b) AND a <> '' UNION ALL SELECT k, b, a FROM np WHERE length(b) <= length(a) AND b <> ''", cut=f"SELECT k, p, {_STRETCH} AS c FROM sides", ask="SELECT a AS x, b AS y FROM np UNION SELECT p, c FROM cut", **_LCS)
def indel_ratio(t: Tables) -> DataFrame:
    return _scored(_named_pairs(t), "ratio", "partial")


_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"


@query("k:i a:s b:s tsort:f tset:f", "", """SELECT k, a, b, s.r AS tsort, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN CASE WHEN a = b THEN 100 ELSE 0 END WHEN common <> '' AND (len(l) = 0 OR len(r0) = 0) THEN 100 ELSE greatest(e.r, CASE WHEN common <> '' THEN greatest(f.r, g.r) ELSE 0 END) END AS tset
    FROM parted JOIN ratio s ON s.x = sa AND s.y = sb JOIN ratio e ON e.x = one AND e.y = two JOIN ratio f ON f.x = common AND f.y = one JOIN ratio g ON g.x = common AND g.y = two""", **_NAMED,
       tokened=f"SELECT k, a, b, {_SORTED.format('a')} AS sa, {_SORTED.format('b')} AS sb, {tokens_sql('a')} AS ta, {tokens_sql('b')} AS tb FROM np",
       split="SELECT *, list_sort(list_distinct(list_intersect(ta, tb))) AS m, list_sort(list_distinct(list_filter(ta, lambda z: NOT list_contains(tb, z)))) AS l, list_sort(list_distinct(list_filter(tb, lambda z: NOT list_contains(ta, z)))) AS r0 FROM tokened",
       parted="SELECT *, array_to_string(m, ' ') AS common, array_to_string(list_concat(m, l), ' ') AS one, array_to_string(list_concat(m, r0), ' ') AS two FROM split",
       ask="SELECT sa AS x, sb AS y FROM parted UNION SELECT one, two FROM parted UNION SELECT common, one FROM parted UNION SELECT common, two FROM parted", **_LCS)
def token_set_ratio(t: Tables) -> DataFrame:
    return _scored(_named_pairs(t), "tsort", "tset")


def _scored(d: DataFrame, *scorers: str) -> DataFrame:
    return d.select("k", "a", "b", *(similarity.pairwise(similarity.SCORERS[s], F.col("a"), F.col("b")).alias(s) for s in scorers))


def _size(x: str, y: str, op: str) -> str:
    return f"len(list_distinct({'list_intersect' if op == 'and' else 'list_concat'}({x}, {y})))"


_SET = {"j": ", ".join(f"{tokens_sql(f'{s}.{c}')} AS {k}{s}" for s in "ab" for k, c in (("t", "name_core"), ("n", "addr_nums"), ("l", "name_legal"), ("z", "addr_state"))) + ", a.addr_tokens AS ada, b.addr_tokens AS adb, a.addr_empty AS ea, b.addr_empty AS eb"}
_SET_SPEC = "s1_id:i cand_id:i f_ntok_a:i f_ntok_b:i f_ntok_common:i f_first_tok_eq:b f_name_jacc:f f_nnum_a:i f_nnum_b:i f_num_common:i f_num_jacc:f f_first_num_eq:b f_first_num_b_in_a:b f_num_longest_common:i f_nlegal_a:i f_nlegal_b:i f_legal_common:i f_legal_conflict:b f_has_state_a:i f_has_state_b:i f_state_common:i f_state_conflict:b f_addr_len_a:i f_addr_len_b:i f_addr_empty_a:b f_addr_empty_b:b"
_SET_SQL = f"""SELECT s1_id, cand_id, len(ta) AS f_ntok_a, len(tb) AS f_ntok_b, {_size('ta', 'tb', 'and')} AS f_ntok_common, coalesce(ta[1] = tb[1], false) AS f_first_tok_eq, {_size('ta', 'tb', 'and')} / greatest({_size('ta', 'tb', 'or')}, 1) AS f_name_jacc,
    len(na) AS f_nnum_a, len(nb) AS f_nnum_b, {_size('na', 'nb', 'and')} AS f_num_common, {_size('na', 'nb', 'and')} / greatest({_size('na', 'nb', 'or')}, 1) AS f_num_jacc, coalesce(na[1] = nb[1], false) AS f_first_num_eq, coalesce(list_contains(na, nb[1]), false) AND nb[1] IS NOT NULL AS f_first_num_b_in_a,
    coalesce(list_max(list_transform(list_intersect(na, nb), lambda z: length(z))), 0) AS f_num_longest_common, len(la) AS f_nlegal_a, len(lb) AS f_nlegal_b, {_size('la', 'lb', 'and')} AS f_legal_common, len(la) > 0 AND len(lb) > 0 AND {_size('la', 'lb', 'and')} = 0 AS f_legal_conflict,
    len(za) AS f_has_state_a, len(zb) AS f_has_state_b, {_size('za', 'zb', 'and')} AS f_state_common, len(za) > 0 AND len(zb) > 0 AND {_size('za', 'zb', 'and')} = 0 AS f_state_conflict, length(ada) - length(replace(ada, ' ', '')) AS f_addr_len_a, length(adb) - length(replace(adb, ' ', '')) AS f_addr_len_b, ea AS f_addr_empty_a, eb AS f_addr_empty_b
    FROM (SELECT p.s1_id, p.cand_id, {_SET['j']} FROM name_pairs p JOIN records a ON a.entity_id = p.s1_id JOIN records b ON b.entity_id = p.cand_id)"""


@query(_SET_SPEC, "records name_pairs", _SET_SQL)
def token_set_features(t: Tables) -> DataFrame:
    d = Q.joined_records(t.name_pairs, t.records, ["name_core", "name_legal", "addr_tokens", "addr_nums", "addr_state", "addr_empty"])
    return d.select("s1_id", "cand_id", *(c.alias(n) for n, c in Q.token_set_columns(d).items()))


_LONGER = "((length(x) > length(y) AND {0}(x, y)) OR (length(y) > length(x) AND {0}(y, x)))"
_NUMBERS = {
    "sides": "SELECT p.s1_id, p.cand_id, string_split(x.addr_nums, ' ') AS a, string_split(y.addr_nums, ' ') AS b FROM number_pairs p JOIN numbers x ON x.entity_id = p.s1_id JOIN numbers y ON y.entity_id = p.cand_id",
    "cell": "SELECT s1_id, cand_id, i, j, a[i] AS x, b[j] AS y FROM (SELECT *, unnest([1, 2, 3]) AS i FROM (SELECT *, unnest([1, 2, 3]) AS j FROM sides))",
    "rel": f"SELECT *, i = 1 AND j = 1 AS f, coalesce(x = y, false) AS eq, coalesce({_LONGER.format('starts_with')}, false) AS pre, coalesce({_LONGER.format('ends_with')}, false) AS suf, abs(CAST(x AS BIGINT) - CAST(y AS BIGINT)) AS gap FROM cell",
}


@query("s1_id:s cand_id:s f_nr_first_prefix:i f_nr_first_suffix:i f_nr_first_logdiff:f f_nr_first_samelen:i f_nr_any_prefix:i f_nr_any_suffix:i f_nr_trunc_len:i f_nr_only_near:i f_nr_min_logdiff:f f_nr_min_logdiff_samelen:f", "numbers number_pairs",
       """SELECT s1_id, cand_id, bool_or(f AND pre) AS f_nr_first_prefix, bool_or(f AND suf) AS f_nr_first_suffix, max(CASE WHEN f THEN CASE WHEN eq THEN 0 ELSE coalesce(ln(1 + gap), -1) END END) AS f_nr_first_logdiff, bool_or(f AND coalesce(length(x) = length(y), false)) AS f_nr_first_samelen,
       bool_or(pre) AS f_nr_any_prefix, bool_or(suf) AS f_nr_any_suffix, max(CASE WHEN pre OR suf THEN least(length(x), length(y)) ELSE 0 END) AS f_nr_trunc_len, NOT bool_or(eq) AND count(gap) > 0 AS f_nr_only_near, coalesce(ln(1 + min(CASE WHEN NOT eq THEN gap END)), -1) AS f_nr_min_logdiff,
       coalesce(ln(1 + min(CASE WHEN NOT eq AND length(x) = length(y) THEN gap END)), -1) AS f_nr_min_logdiff_samelen FROM rel GROUP BY s1_id, cand_id""", **_NUMBERS)  # fmt: skip
def number_relations(t: Tables) -> DataFrame:
    return Q.number_relations(t.number_pairs, t.numbers)


_RARE = {
    "rk": f"SELECT entity_id, country, src, {order_free_sql('name_core')} AS nk, {order_free_sql('addr_tokens')} AS ak, string_split(addr_nums, ' ')[1] AS n1 FROM records",
    "rare": ", ".join(["SELECT entity_id, nk, ak"] + [f"count(*) FILTER (WHERE src {'=' if s == 's1' else '<>'} 1) OVER (PARTITION BY country, {k}) AS {n}_{s}" for n, k in (("name", "nk"), ("addr", "ak"), ("namenum", "nk, n1")) for s in ("s1", "oth")]) + " FROM rk",
}


@query("entity_id:i nk:s ak:s name_s1:i name_oth:i addr_s1:i addr_oth:i namenum_s1:i namenum_oth:i", "records", "SELECT * FROM rare", **_RARE)
def rarity_counts(t: Tables) -> DataFrame:
    return Q.rarity(t.records)


@query("s1_id:i cand_id:i f_rar_name_s1_a:i f_rar_name_oth_a:i f_rar_addr_s1_b:i f_rar_namenum_s1_b:i f_name_key_eq:i f_addr_key_eq:i", "records name_pairs", "SELECT p.s1_id, p.cand_id, a.name_s1 AS f_rar_name_s1_a, a.name_oth AS f_rar_name_oth_a, b.addr_s1 AS f_rar_addr_s1_b, b.namenum_s1 AS f_rar_namenum_s1_b, a.nk = b.nk AS f_name_key_eq, a.ak = b.ak AND a.ak <> '' AS f_addr_key_eq FROM name_pairs p JOIN rare a ON a.entity_id = p.s1_id JOIN rare b ON b.entity_id = p.cand_id", **_RARE)
def rarity_pairs(t: Tables) -> DataFrame:
    return Q.add_rarity(t.name_pairs, Q.rarity(t.records))


@query("cand_id:i name_owners:i", "records", "SELECT r.entity_id AS cand_id, count(s.entity_id) AS name_owners FROM rk r LEFT JOIN rk s ON r.country = s.country AND r.nk = s.nk AND s.src = 1 WHERE r.src <> 1 GROUP BY r.entity_id", rk=_RARE["rk"])
def name_owner_counts(t: Tables) -> DataFrame:
    return Q.name_owners(t.records)


def _labelled_pairs(t: Tables) -> DataFrame:
    """Edges as pairs of parts' names: S1 the supplier's first part, the record the part itself; label: returned."""
    names = t.read("part").select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name_core"))
    pairs = Q.with_fold(t.edges.select("s1_id", "cand_id", F.col("y").alias("label")))
    return Q.diff_tokens(pairs, names)


_RISK = {
    "pnames": "SELECT p_partkey AS entity_id, p_name || ' ' || lower(p_type) AS name FROM part",
    "d": "SELECT e.s1_id, e.cand_id, y AS label, e.s1_id % 2 AS fold, list_filter(string_split(b.name, ' '), lambda z: NOT list_contains(string_split(a.name, ' '), z)) AS extra, list_filter(string_split(a.name, ' '), lambda z: NOT list_contains(string_split(b.name, ' '), z)) AS missing FROM edges e JOIN pnames a ON a.entity_id = e.s1_id JOIN pnames b ON b.entity_id = e.cand_id",
    "each": "SELECT s1_id, cand_id, label, fold, 'extra' AS role, unnest(list_distinct(extra)) AS tok FROM d UNION ALL SELECT s1_id, cand_id, label, fold, 'missing', unnest(list_distinct(missing)) FROM d",
    "st": "SELECT fold, role, tok, count(*) AS n, sum(label) AS pos FROM each GROUP BY ALL",
    "pr": "SELECT fold, avg(label) AS prior FROM d GROUP BY fold",
    "rates": "SELECT e.s1_id, e.cand_id, e.role, coalesce((s.pos + 20 * p.prior) / (s.n + 20), p.prior) AS rate FROM each e JOIN pr p ON p.fold = 1 - e.fold LEFT JOIN st s ON s.fold = 1 - e.fold AND s.role = e.role AND s.tok = e.tok",
}


@query("s1_id:i cand_id:i extra:s missing:s", "edges", "SELECT s1_id, cand_id, array_to_string(list_sort(list_distinct(extra)), ' ') AS extra, array_to_string(list_sort(list_distinct(missing)), ' ') AS missing FROM d", **{k: _RISK[k] for k in ("pnames", "d")})
def diff_tokens(t: Tables) -> DataFrame:
    return _labelled_pairs(t).withColumns({c: X.joined(F.array_sort(c)) for c in ("extra", "missing")})


@query("s1_id:i cand_id:i f_extra_rate_min:f f_extra_rate_mean:f f_extra_n:i f_missing_rate_min:f f_missing_rate_mean:f f_missing_n:i", "edges", "SELECT d.s1_id, d.cand_id, " + ", ".join(f"coalesce({f}(rate) FILTER (WHERE role = '{r}'), {v}) AS f_{r}_{x}" for r in ("extra", "missing") for f, x, v in (("min", "rate_min", -1), ("avg", "rate_mean", -1), ("count", "n", 0))) + " FROM d LEFT JOIN rates USING (s1_id, cand_id) GROUP BY d.s1_id, d.cand_id", **_RISK)
def word_risk_oof(t: Tables) -> DataFrame:
    d = written(_labelled_pairs(t), "pairs")
    return Q.word_risk(d, Q.word_stats(d), d.groupBy("fold").agg(F.avg("label").alias("prior")))


@query("s1_id:i cand_id:i fold:i", "edges", "SELECT s1_id, cand_id, s1_id % 2 AS fold FROM edges")
def fold_assignment(t: Tables) -> DataFrame:
    return Q.with_fold(t.scored)


@query("s1_id:i cand_id:i label:i", "edges truth", "SELECT e.s1_id, e.cand_id, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS label FROM edges e LEFT JOIN truth t USING (s1_id, cand_id)")
def label_join(t: Tables) -> DataFrame:
    return Q.with_label(t.scored, t.truth)


# Context windows

_RANKS = "row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rc, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS rs"
_MARGIN = "CASE WHEN rc = 1 THEN prob - coalesce(max(CASE WHEN rc <> 1 THEN prob END) OVER c, 0) ELSE prob - max(prob) OVER c END"
_WINDOWS = "WINDOW s AS (PARTITION BY s1_id), c AS (PARTITION BY cand_id)"


def _comp(x: str, rk: str = "rc") -> str:
    return f"CASE WHEN {rk} = 1 THEN max(CASE WHEN {rk} = 2 THEN {x} END) OVER c ELSE max(CASE WHEN {rk} = 1 THEN {x} END) OVER c END"


@query("s1_id:i cand_id:i ctx_n_cand:i ctx_n_s1:i ctx_rank_in_s1:i ctx_rank_in_cand:i ctx_gap_s1_best:f ctx_gap_cand_best:f ctx_margin_cand:f", "edges", f"SELECT s1_id, cand_id, count(*) OVER s AS ctx_n_cand, count(*) OVER c AS ctx_n_s1, rs AS ctx_rank_in_s1, rc AS ctx_rank_in_cand, prob - max(prob) OVER s AS ctx_gap_s1_best, prob - max(prob) OVER c AS ctx_gap_cand_best, {_MARGIN} AS ctx_margin_cand FROM (SELECT *, {_RANKS} FROM edges) {_WINDOWS}")
def candidate_context(t: Tables) -> DataFrame:
    return W.candidate_context(t.scored, "prob")


_PROB = f"SELECT s1_id, cand_id, rc AS p1_rank_cand, rs AS p1_rank_s1, max(prob) OVER s AS p1_max_s1, sum(prob) OVER s AS p1_sum_s1, sum(CASE WHEN prob > 0.5 THEN 1 ELSE 0 END) OVER s AS p1_n_high_s1, sum(prob) OVER c AS p1_sum_cand, {_MARGIN} AS p1_margin_cand, sum(prob) OVER s - prob AS p1_sum_s1_others FROM (SELECT *, {_RANKS} FROM {{0}}) {_WINDOWS}"
_PROB_SPEC = "s1_id:i cand_id:i p1_rank_cand:i p1_rank_s1:i p1_max_s1:f p1_sum_s1:f p1_n_high_s1:i p1_sum_cand:f p1_margin_cand:f p1_sum_s1_others:f"


@query(_PROB_SPEC, "edges", _PROB.format("edges"))
def prob_context(t: Tables) -> DataFrame:
    return W.prob_context(t.scored)


@query(_PROB_SPEC, "edges", _PROB.format("(SELECT * FROM edges WHERE prob >= 0.3)"))
def candidate_filter_then_context(t: Tables) -> DataFrame:
    return P.filtered_context(t.scored, W.prob_context, 0.3)


_SOURCE = {
    "sr": f"SELECT *, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS hi, row_number() OVER (PARTITION BY s1_id, src ORDER BY prob DESC, cand_id) AS ri, {_RANKS} FROM edges",
    "sf": "SELECT *, sum(hi) OVER g - hi AS a, CASE WHEN ri = 1 THEN coalesce(max(CASE WHEN ri <> 1 THEN prob END) OVER g, 0) ELSE max(prob) OVER g END AS b, sum(hi) OVER s - sum(hi) OVER g AS o FROM sr WINDOW g AS (PARTITION BY s1_id, src), s AS (PARTITION BY s1_id)",
}


@query("s1_id:i cand_id:i p1_src_n_high_s1:i p1_src_max_s1:f p1_osrc_n_high_s1:i p1_src_n_high_comp:i p1_src_max_comp:f p1_osrc_n_high_comp:i", "edges", f"SELECT s1_id, cand_id, a AS p1_src_n_high_s1, b AS p1_src_max_s1, o AS p1_osrc_n_high_s1, coalesce({_comp('a')}, -1) AS p1_src_n_high_comp, coalesce({_comp('b')}, -1) AS p1_src_max_comp, coalesce({_comp('o')}, -1) AS p1_osrc_n_high_comp FROM sf WINDOW c AS (PARTITION BY cand_id)", **_SOURCE)
def source_context(t: Tables) -> DataFrame:
    return W.source_context(t.scored, t.sources)


def _sib(k: str) -> str:
    mine = f"CASE WHEN prob >= 0.9 AND {k} <> '' THEN 1 ELSE 0 END"
    return f"CASE WHEN {k} <> '' THEN sum({mine}) OVER (PARTITION BY s1_id, {k}) - {mine} ELSE 0 END"


_SIBS = {"sb": f"SELECT e.s1_id, e.cand_id, e.prob, {_RANKS}, {_sib('address')} AS a, {_sib('nums')} AS n, {_sib('name')} AS m FROM edges e LEFT JOIN attributes USING (cand_id)"}


@query("s1_id:i cand_id:i p1_sib_addr_s1:i p1_sib_nums_s1:i p1_sib_name_s1:i p1_sib_addr_comp:i p1_sib_nums_comp:i p1_sib_name_comp:i", "edges attributes", "SELECT s1_id, cand_id, a AS p1_sib_addr_s1, n AS p1_sib_nums_s1, m AS p1_sib_name_s1, " + ", ".join(f"coalesce({_comp(x)}, -1) AS p1_sib_{y}_comp" for x, y in (("a", "addr"), ("n", "nums"), ("m", "name"))) + " FROM sb WINDOW c AS (PARTITION BY cand_id)", **_SIBS)
def sibling_context(t: Tables) -> DataFrame:
    return W.sibling_context(t.scored, t.attributes, {"addr": "address", "nums": "nums", "name": "name"})


def _logits(t: Tables) -> DataFrame:
    return t.scored.select("s1_id", "cand_id", F.round(F.col("prob") * 4 - 2, 6).alias("ce_logit"))


_LOGITS = {
    "lg": "SELECT s1_id, cand_id, round(prob * 4 - 2, 6) AS l FROM edges",
    "lr": "SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY l DESC, cand_id) AS rs, row_number() OVER (PARTITION BY cand_id ORDER BY l DESC, s1_id) AS rc FROM lg",
}


@query("s1_id:i cand_id:i p2_ce_rank_s1:i p2_ce_npos_s1:i p2_ce_ncl_cand:i p2_ce_gap_s1:f p2_ce_gap_cand:f", "edges", f"SELECT s1_id, cand_id, rs AS p2_ce_rank_s1, sum(CASE WHEN l > 0 THEN 1 ELSE 0 END) OVER s AS p2_ce_npos_s1, count(*) OVER c AS p2_ce_ncl_cand, l - CASE WHEN l = max(l) OVER s THEN max(CASE WHEN rs = 2 THEN l END) OVER s ELSE max(l) OVER s END AS p2_ce_gap_s1, l - CASE WHEN l = max(l) OVER c THEN max(CASE WHEN rc = 2 THEN l END) OVER c ELSE max(l) OVER c END AS p2_ce_gap_cand FROM lr {_WINDOWS}", **_LOGITS)
def logit_context(t: Tables) -> DataFrame:
    return W.logit_context(_logits(t))


_SURE = "prob >= 0.9 AND rc = 1"
_EDGE = {
    "eg": f"SELECT *, ln(greatest(least(prob, 1 - 1e-6), 1e-6) / (1 - greatest(least(prob, 1 - 1e-6), 1e-6))) AS lp, {_RANKS} FROM edges WHERE prob >= 0.01",
    "ef": f"""SELECT *, count(*) OVER c AS r_n, max(prob) OVER c AS r_best, sum(prob) OVER c AS r_sum, coalesce(max(CASE WHEN rc = 2 THEN prob END) OVER c, 0) AS r_second, {_MARGIN} AS r_margin, count(*) OVER s AS s_n, sum(prob) OVER s AS s_sum, sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) OVER s AS s_n05,
        sum(CASE WHEN {_SURE} THEN 1 ELSE 0 END) OVER s - CASE WHEN {_SURE} THEN 1 ELSE 0 END AS sib_n, CASE WHEN src = 2 THEN sum(CASE WHEN {_SURE} AND src = 2 THEN 1 ELSE 0 END) OVER s ELSE sum(CASE WHEN {_SURE} AND src = 3 THEN 1 ELSE 0 END) OVER s END - CASE WHEN {_SURE} THEN 1 ELSE 0 END AS sib_same,
        CASE WHEN src = 2 THEN sum(CASE WHEN {_SURE} AND src = 3 THEN 1 ELSE 0 END) OVER s ELSE sum(CASE WHEN {_SURE} AND src = 2 THEN 1 ELSE 0 END) OVER s END AS sib_other FROM eg {_WINDOWS}""",
}


@query("s1_id:i cand_id:i lp:f r_n:i r_rank:i r_best:f r_second:f r_margin:f r_sum:f s_n:i s_rank:i s_sum:f s_n05:i sib_n:i sib_same:i sib_other:i comp_prob:f comp_sib_n:i d_sib_n:i d_lp:f", "edges", f"SELECT *, rc AS r_rank, rs AS s_rank, {_comp('prob')} AS comp_prob, {_comp('sib_n')} AS comp_sib_n, sib_n - {_comp('sib_n')} AS d_sib_n, lp - {_comp('lp')} AS d_lp FROM ef WINDOW c AS (PARTITION BY cand_id)", **_EDGE)
def edge_group_features(t: Tables) -> DataFrame:
    return W.edge_group_features(t.scored, t.sources)


_PROTO = {
    "pg": f"SELECT *, count(*) OVER (PARTITION BY cand_id) AS rn, {_RANKS} FROM edges",
    "pp": "SELECT o.s1_id, o.cand_id, levenshtein(q.name, x.name) AS n, levenshtein(q.address, x.address) AS a, CASE WHEN q.address = x.address AND q.address <> '' THEN 1 ELSE 0 END AS eq FROM pg o JOIN pg z ON o.s1_id = z.s1_id AND z.prob >= 0.9 AND z.rc = 1 AND z.cand_id <> o.cand_id AND (o.rn >= 2 OR o.prob < 0.995) JOIN attributes q ON q.cand_id = o.cand_id JOIN attributes x ON x.cand_id = z.cand_id",
}


@query("s1_id:i cand_id:i proto_name:i proto_name_mean:f proto_addr:i proto_addr_eq:i", "edges attributes", "SELECT s1_id, cand_id, max(n) AS proto_name, avg(n) AS proto_name_mean, max(a) AS proto_addr, max(eq) AS proto_addr_eq FROM pp GROUP BY s1_id, cand_id", **_PROTO)
def prototype_similarity(t: Tables) -> DataFrame:
    return W.prototype_similarity(t.scored, t.attributes, F.levenshtein, F.levenshtein)


def _bi(t: Tables) -> DataFrame:
    return t.scored.withColumns({"f_bi_top1": (F.col("prob") >= 0.9).cast("int"), "f_bi_cos1": F.when(F.col("prob") >= 0.9, F.col("prob") / 2), "p3": F.when(F.col("prob") < 0.5, F.col("prob"))})


@query("s1_id:i cand_id:i s_bi_n:i comp_f_bi_cos1:f d_bi:f in_zone:i", "edges", f"SELECT s1_id, cand_id, sum(CASE WHEN prob >= 0.9 THEN 1 ELSE 0 END) OVER s AS s_bi_n, {_comp('cosine')} AS comp_f_bi_cos1, cosine - {_comp('cosine')} AS d_bi, CASE WHEN prob < 0.5 THEN 1 ELSE 0 END AS in_zone FROM (SELECT *, CASE WHEN prob >= 0.9 THEN prob / 2 END AS cosine FROM ef) {_WINDOWS}", **_EDGE)
def edge_retriever_features(t: Tables) -> DataFrame:
    return W.edge_group_features(_bi(t), t.sources)


_OWNER = {
    "p0": f"SELECT *, count(*) OVER (PARTITION BY cand_id) AS rn, {_RANKS} FROM edges WHERE prob >= 0.01",
    "pq": _PROTO["pp"].replace("pg o", "p0 o").replace("pg z", "p0 z"),
    "pr": "SELECT s1_id, cand_id, max(n) AS proto_name, max(a) AS proto_addr FROM pq GROUP BY ALL",
    "od": "SELECT e.*, r.proto_name, r.proto_addr, levenshtein(q.name, x.name) AS s1_name, levenshtein(q.address, x.address) AS s1_addr FROM ef e LEFT JOIN pr r USING (s1_id, cand_id) LEFT JOIN attributes q ON q.cand_id = e.cand_id LEFT JOIN attributes x ON x.cand_id = e.s1_id",
}


@query("s1_id:i cand_id:i proto_name:i s1_name:i s1_addr:i comp_sib_same:i comp_proto_name:i comp_s1_name:i d_proto_addr:i d_s1_name:i d_s1_addr:i", "edges attributes", f"SELECT s1_id, cand_id, proto_name, s1_name, s1_addr, {_comp('sib_same')} AS comp_sib_same, {_comp('proto_name')} AS comp_proto_name, {_comp('s1_name')} AS comp_s1_name, proto_addr - {_comp('proto_addr')} AS d_proto_addr, s1_name - {_comp('s1_name')} AS d_s1_name, s1_addr - {_comp('s1_addr')} AS d_s1_addr FROM od WINDOW c AS (PARTITION BY cand_id)", **_EDGE, **_OWNER)
def owner_features(t: Tables) -> DataFrame:
    return W.owner_features(t.scored, t.sources, t.attributes, t.attributes.withColumnRenamed("cand_id", "s1_id"), F.levenshtein, F.levenshtein)


_GAPS = "CASE WHEN l = max(l) OVER {0} THEN max(CASE WHEN {1} = 2 THEN l END) OVER {0} ELSE max(l) OVER {0} END"


@query("s1_id:i cand_id:s p2_ce3_logit:f p2_ce3_gap_s1:f p2_ce3_gap_cand:f", "edges", "SELECT x.s1_id, x.o || x.tail AS cand_id, g.l AS p2_ce3_logit, g.gs AS p2_ce3_gap_s1, g.gc AS p2_ce3_gap_cand FROM (SELECT s1_id, cand_id AS o, '' AS tail FROM edges UNION ALL SELECT s1_id, cand_id, '#d1' FROM edges WHERE y = 0) x JOIN gp g ON g.s1_id = x.s1_id AND g.cand_id = x.o", **_LOGITS, gp=f"SELECT s1_id, cand_id, l, l - {_GAPS.format('s', 'rs')} AS gs, l - {_GAPS.format('c', 'rc')} AS gc FROM lr {_WINDOWS}")
def later_logits(t: Tables) -> DataFrame:
    own = t.edges.select("s1_id", F.col("cand_id").cast("string").alias("cand_id"), F.round(F.col("prob") * 4 - 2, 6).alias("ce_logit"), "y")
    clones = own.filter("y = 0").withColumn("cand_id", F.concat("cand_id", F.lit("#d1")))
    return W.later_logit_columns(own.union(clones), detwin=True)


# Decisions


@query("s1_id:i cand_id:i prob:f", "owned", "SELECT * FROM owned")
def assign_owner(t: Tables) -> DataFrame:
    return P.assign_owner(t.scored)


@query("s1_id:i cand_id:i prob:f", "owned", "SELECT * FROM owned WHERE prob >= 0.75")
def flat_threshold(t: Tables) -> DataFrame:
    return P.decide(t.scored, 0.75)


_RULE = "SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM owned) WHERE prob >= CASE WHEN r = 1 THEN {0} ELSE {1} END"


@query("s1_id:i cand_id:i prob:f", "owned", _RULE.format(0.5, 0.75))
def rank_rule(t: Tables) -> DataFrame:
    return P.keep_by_rank(P.assign_owner(t.scored), 0.5, 0.75)


@query("s1_id:i cand_id:i prob:f", "owned s1", "SELECT o.s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM owned) o JOIN s1 USING (s1_id) WHERE prob >= CASE WHEN country < 5 THEN 0.95 WHEN r = 1 THEN 0.5 ELSE 0.75 END")
def country_thresholds(t: Tables) -> DataFrame:
    unseen = t.s1.filter("country < 5").select("country").distinct()
    return P.decide(P.with_country_thresholds(t.scored, t.s1, unseen, 0.5, 0.75, 0.95))


@query("country:s", "records", "SELECT DISTINCT country FROM records WHERE src = 1 AND country NOT IN (SELECT country FROM records WHERE src = 1 AND country <> 'fr')")
def unseen_countries(t: Tables) -> DataFrame:
    return P.unseen_countries(t.records, t.records.filter("country <> 'fr'"))


_EVAL = {
    "nt": "SELECT s1_id, count(*) AS n_true FROM truth GROUP BY s1_id",
    "hit": "SELECT p.*, t.s1_id IS NOT NULL AS ok FROM pred p LEFT JOIN truth t USING (s1_id, cand_id)",
}
_PER = "SELECT s.s1_id, {0} coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, CASE WHEN coalesce(n_true, 0) = 0 AND coalesce(n_pred, 0) = 0 THEN 1.0 ELSE 1.25 * coalesce(tp, 0) / greatest(0.25 * coalesce(n_true, 0) + coalesce(n_pred, 0), 1e-9) END AS f05 FROM {1} s LEFT JOIN nt USING (s1_id) LEFT JOIN (SELECT s1_id, {2} count(*) AS n_pred, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS tp FROM hit GROUP BY ALL) g USING ({2} s1_id)"


@query("macro_f05:f micro_precision:f micro_recall:f singleton_acc:f n:i", "owned truth s1", "SELECT avg(f05) AS macro_f05, sum(tp) / greatest(sum(n_pred), 1) AS micro_precision, sum(tp) / greatest(sum(n_true), 1) AS micro_recall, avg(CASE WHEN n_true = 0 THEN f05 END) AS singleton_acc, count(*) AS n FROM per", pred=_RULE.format(0.5, 0.75), **_EVAL, per=_PER.format("", "s1", ""))
def macro_f05(t: Tables) -> DataFrame:
    return P.macro_f05(P.keep_by_rank(P.assign_owner(t.scored), 0.5, 0.75), t.truth, t.s1)


_FLAT_GRID = "(SELECT unnest([" + ", ".join(map(str, P.steps(0.20, 0.90))) + "]) AS thr)"


@query("thr:f macro_f05:f", "owned truth s1", "SELECT thr, avg(f05) AS macro_f05 FROM per GROUP BY thr", pred=f"SELECT thr, s1_id, cand_id FROM owned, {_FLAT_GRID} WHERE prob >= CAST(thr AS DOUBLE)", **_EVAL, per=_PER.format("s.thr,", f"(SELECT * FROM s1, {_FLAT_GRID})", "thr,"))
def tune_threshold(t: Tables) -> DataFrame:
    return P.tune_threshold(t.scored, t.truth, t.s1)


_GRID = "(SELECT a AS thr_top, b AS thr_rest FROM (SELECT unnest([" + ", ".join(map(str, P.steps(0.40, 0.75))) + "]) AS a), (SELECT unnest([" + ", ".join(map(str, P.steps(0.60, 0.85))) + "]) AS b) WHERE a <= b)"


@query("thr_top:f thr_rest:f macro_f05:f", "owned truth s1", "SELECT thr_top, thr_rest, avg(f05) AS macro_f05 FROM per GROUP BY ALL", pred=f"SELECT thr_top, thr_rest, s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM owned), {_GRID} WHERE prob >= CAST(CASE WHEN r = 1 THEN thr_top ELSE thr_rest END AS DOUBLE)", **_EVAL, per=_PER.format("s.thr_top, s.thr_rest,", f"(SELECT * FROM s1, {_GRID})", "thr_top, thr_rest,"))
def tune_rank_thresholds(t: Tables) -> DataFrame:
    return P.tune_rank_thresholds(t.scored, t.truth, t.s1)


_EXPECT = {
    "x1": "SELECT *, row_number() OVER d AS m, sum(prob) OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id ROWS UNBOUNDED PRECEDING) AS cs, sum(prob) OVER (PARTITION BY s1_id) AS tt, exp(sum(ln(greatest(1 - prob, 1e-300))) OVER (PARTITION BY s1_id)) AS p0 FROM owned WHERE prob >= 0.05 WINDOW d AS (PARTITION BY s1_id ORDER BY prob DESC, cand_id)",
    "x2": "SELECT *, round(1.25 * cs / (0.25 * tt + m), 12) AS ef FROM x1",
    "x3": "SELECT *, max(ef) OVER (PARTITION BY s1_id) AS best FROM x2",
    "x4": "SELECT *, min(CASE WHEN ef = best THEN m END) OVER (PARTITION BY s1_id) AS mbest FROM x3",
}


@query("s1_id:i cand_id:i prob:f", "owned", "SELECT s1_id, cand_id, prob FROM x4 WHERE m <= mbest AND best > p0", **_EXPECT)
def expected_f_decision(t: Tables) -> DataFrame:
    return P.expected_f_decision(t.scored)


@query("s1_id:i cand_id:i", "owned", f"SELECT s1_id, cand_id FROM owned WHERE prob >= 0.95 UNION SELECT s1_id, cand_id FROM ({_RULE.format(0.6, 0.75)}) WHERE s1_id % 3 = cand_id % 3")
def exact_key_readd(t: Tables) -> DataFrame:
    keys = t.scored.filter("s1_id % 3 = cand_id % 3").select("s1_id", "cand_id", F.lit(1).alias("f_name_key_eq"), F.lit(1).alias("f_addr_key_eq"))
    return P.exact_key_readd(t.scored, keys)


@query("s1_id:i cand_id:i prob:f", "edges", "SELECT s1_id, cand_id, CASE WHEN prob > 0.01 AND prob < 0.99 AND y = 1 THEN round(1 - prob, 6) ELSE prob END AS prob FROM edges")
def zone_overlay(t: Tables) -> DataFrame:
    later = t.edges.filter("y = 1").select("s1_id", "cand_id", F.round(1 - F.col("prob"), 6).alias("p3"))
    return P.zone_overlay(t.scored, later)


@query("s1_id:i cand_id:i prob:g", "edges", "SELECT s1_id, cand_id, (prob + prob * prob) / 2 AS prob FROM edges")
def chain_mean(t: Tables) -> DataFrame:
    return P.chain_mean(t.scored, t.scored.withColumn("prob", F.col("prob") * F.col("prob")))


@query("s1_id:i cand_id:s ce_logit:f", "edges", "SELECT s1_id, CAST(cand_id AS VARCHAR) AS cand_id, max(l) AS ce_logit FROM (SELECT s1_id, cand_id, prob AS l FROM edges UNION ALL SELECT s1_id, cand_id, 1 - prob FROM edges WHERE y = 1) GROUP BY ALL")
def logit_cache_union(t: Tables) -> DataFrame:
    first = t.scored.select("s1_id", F.col("cand_id").cast("string").alias("cand_id"), F.col("prob").alias("ce_logit"))
    clones = t.edges.filter("y = 1").select("s1_id", F.concat("cand_id", F.lit("#d1")).alias("cand_id"), (1 - F.col("prob")).alias("ce_logit"))
    return P.logit_union([first, clones], X.original_id(F.col("cand_id")))


@query("logloss:f accuracy:f n:i", "edges", "SELECT avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS logloss, avg(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS accuracy, count(*) AS n FROM (SELECT *, greatest(least(prob, 1 - 1e-6), 1e-6) AS p FROM edges)")
def log_loss_accuracy(t: Tables) -> DataFrame:
    return P.log_loss(t.edges.withColumnRenamed("y", "label"))


_BUCKETS = f"""SELECT kind, class, count(*) AS n FROM (
    SELECT 'FP' AS kind, CASE WHEN n.s1_id IS NULL THEN 'singleton_false_positive' WHEN o.s1_id IS NOT NULL THEN 'wrong_winner' ELSE 'accepted_false_positive' END AS class FROM pred p ANTI JOIN truth t USING (s1_id, cand_id) LEFT JOIN (SELECT DISTINCT s1_id FROM truth) n USING (s1_id) LEFT JOIN truth o ON o.cand_id = p.cand_id
    UNION ALL SELECT 'FN', CASE WHEN e.s1_id IS NULL THEN 'blocking_false_negative' WHEN w.s1_id <> t.s1_id THEN 'multi_owner_ranking_conflict' ELSE 'in_candidate_false_negative' END FROM truth t ANTI JOIN pred p USING (s1_id, cand_id) LEFT JOIN cands e ON e.s1_id = t.s1_id AND e.cand_id = t.cand_id LEFT JOIN own2 w ON w.cand_id = t.cand_id) GROUP BY ALL"""


@query("kind:s class:s n:i", "edges truth", _BUCKETS, cands="SELECT * FROM edges WHERE prob >= 0.2", own2="SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rk FROM cands) WHERE rk = 1", pred="SELECT * FROM own2 WHERE prob >= 0.7")
def error_buckets(t: Tables) -> DataFrame:
    cands = t.scored.filter("prob >= 0.2")
    return P.error_buckets(cands, P.decide(cands, 0.7), t.truth, P.assign_owner(cands))


@query("groups:i champion:i challenger:i fixed:i broke:i", "edges truth", "SELECT count(*) AS groups, sum(a) AS champion, sum(b) AS challenger, sum(CASE WHEN b > a THEN 1 ELSE 0 END) AS fixed, sum(CASE WHEN b < a THEN 1 ELSE 0 END) AS broke FROM (SELECT cand_id, count(*) AS n, max(l) AS y, arg_max(l, (prob, -s1_id)) AS a, arg_max(l, (q, -s1_id)) AS b FROM (SELECT e.*, round(abs(prob - 0.4), 6) AS q, CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END AS l FROM edges e LEFT JOIN truth t USING (s1_id, cand_id)) GROUP BY cand_id) WHERE n >= 2 AND y = 1")
def owner_choice_eval(t: Tables) -> DataFrame:
    return P.owner_choice(Q.with_label(t.scored, t.truth).withColumn("q", F.round(F.abs(F.col("prob") - 0.4), 6)))


@query("thr:f n:i coverage:f precision:f", "edges truth attributes", "SELECT thr, any_value(n) AS n, sum(CASE WHEN top >= thr THEN 1 ELSE 0 END) / greatest(any_value(n), 1) AS coverage, avg(CASE WHEN top >= thr THEN yb END) AS precision FROM (SELECT *, count(*) OVER () AS n FROM bst), (SELECT unnest([0.5, 0.6, 0.67, 0.75, 0.9]) AS thr) GROUP BY thr", bst="SELECT cand_id, max(prob) AS top, arg_max(CASE WHEN t.s1_id IS NULL THEN 0 ELSE 1 END, (prob, -e.s1_id)) AS yb FROM edges e LEFT JOIN truth t USING (s1_id, cand_id) WHERE cand_id IN (SELECT cand_id FROM attributes WHERE nums = '') GROUP BY cand_id HAVING count(*) >= 2")
def ambiguous_coverage(t: Tables) -> DataFrame:
    records = t.attributes.select("cand_id", (F.col("nums") == "").alias("addr_empty"), F.lit(2).alias("name_owners"))
    return P.ambiguous_coverage(Q.with_label(t.scored, t.truth).withColumn("q", F.col("prob")), records)


_CASES = "SELECT 'base' AS kase, s1_id, cand_id FROM pred0 UNION SELECT 'no_false', p.s1_id, p.cand_id FROM pred0 p JOIN truth USING (s1_id, cand_id) UNION SELECT 'add_candidates', s1_id, cand_id FROM pred0 UNION SELECT 'add_candidates', s1_id, cand_id FROM seen UNION SELECT 'ceiling', s1_id, cand_id FROM seen UNION SELECT 'truth', s1_id, cand_id FROM truth"


@query("case:s macro_f05:f", "edges truth s1", 'SELECT kase AS "case", avg(f05) AS macro_f05 FROM per GROUP BY kase', own2="SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rk FROM edges WHERE prob >= 0.2) WHERE rk = 1", pred0="SELECT s1_id, cand_id FROM own2 WHERE prob >= 0.7", seen="SELECT t.s1_id, t.cand_id FROM truth t JOIN edges e USING (s1_id, cand_id) WHERE e.prob >= 0.2", pred=_CASES, **_EVAL, per=_PER.format("s.kase,", "(SELECT * FROM s1, (SELECT unnest(['base', 'no_false', 'add_candidates', 'ceiling', 'truth']) AS kase))", "kase,"))
def oracle_gains(t: Tables) -> DataFrame:
    cands = t.scored.filter("prob >= 0.2")
    return P.oracle_gains(cands, P.decide(cands, 0.7), t.truth, t.s1)


@query("s1_id:i cand_id:i prob:f", "edges", "SELECT s1_id, cand_id, CASE WHEN y = 1 THEN 0.5 ELSE prob END AS prob FROM edges")
def rescored_edges(t: Tables) -> DataFrame:
    return P.rescored(t.scored, t.edges.filter("y = 1").select("s1_id", "cand_id", F.lit(0.5).alias("q")))


# Simulation


@query("entity_id:s src:i", "records name_pairs", "SELECT CAST(entity_id AS VARCHAR) AS entity_id, src FROM records UNION ALL SELECT entity_id || '#d' || k, src FROM records, (SELECT unnest([1, 2]) AS k) WHERE src <> 1 AND entity_id NOT IN (SELECT cand_id FROM name_pairs)")
def clone_pool(t: Tables) -> DataFrame:
    return E.clone_pool(t.records, t.name_pairs, 3)


@query("s1_id:i cand_id:s p1_rank_s1:i p1_sum_cand:f", "edges", f"SELECT x.s1_id, x.cand_id, p.p1_rank_s1, p.p1_sum_cand FROM (SELECT s1_id, CAST(cand_id AS VARCHAR) AS cand_id, CAST(cand_id AS VARCHAR) AS o FROM edges UNION ALL SELECT s1_id, cand_id || '#d1', CAST(cand_id AS VARCHAR) FROM edges WHERE y = 0) x JOIN ctx p ON p.s1_id = x.s1_id AND CAST(p.cand_id AS VARCHAR) = x.o", e2="SELECT s1_id, CAST(cand_id AS VARCHAR) AS cand_id, prob FROM edges", ctx=_PROB.format("e2"))
def detwin_context(t: Tables) -> DataFrame:
    own = t.edges.select("s1_id", F.col("cand_id").cast("string").alias("cand_id"), "prob", "y")
    clones = own.filter("y = 0").withColumns({"cand_id": F.concat("cand_id", F.lit("#d1")), "prob": F.col("prob") * 0.5})
    return E.detwinned(own.union(clones).drop("y"), W.prob_context)


@query("s1_id:i cand_id:s known:i", "edges", "SELECT s1_id, cand_id || '#d1' AS cand_id, CASE WHEN y = 1 THEN 1 ELSE 0 END AS known FROM edges")
def reused_logits(t: Tables) -> DataFrame:
    wanted = t.edges.select("s1_id", F.concat("cand_id", F.lit("#d1")).alias("cand_id"))
    got, rest = E.reused_logits(wanted, t.edges.filter("y = 1").select("s1_id", "cand_id", F.col("prob").alias("ce_logit")))
    return got.select("s1_id", "cand_id", F.lit(1).alias("known")).union(rest.withColumn("known", F.lit(0)))


# Models


@query("s1_id:i cand_id:i prob:f")
def gbt_crossfit(t: Tables) -> DataFrame:
    rows = Q.with_fold(Q.with_label(W.prob_context(t.scored), t.truth))
    return M.crossfit(rows, ["prob", "p1_rank_cand", "p1_rank_s1", "p1_margin_cand", "p1_sum_cand", "p1_n_high_s1"])


@query("s1_id:i cand_id:i ce_logit:f")
def pair_scorer(t: Tables) -> DataFrame:
    text = t.attributes.select(F.col("cand_id").alias("id"), M.pair_text(F.col("name"), F.col("address")).alias("text"))
    pairs = Q.with_fold(Q.with_label(M.uncertain(t.scored), t.truth)).join(text.select(F.col("id").alias("s1_id"), F.col("text").alias("text_a")), "s1_id").join(text.select(F.col("id").alias("cand_id"), F.col("text").alias("text_b")), "cand_id")
    return M.score_pairs(written(pairs.select(*PAIR, "fold", "label", "text_a", "text_b"), "pairs"))  # both fits and the scores read them


@query("s1_id:i cand_id:i rk_rank:i rk:f rk_gap:f")
def owner_ranker(t: Tables) -> DataFrame:
    t.edges = written(t.edges, "edges")  # scores, sources and truth all come from it
    inputs = ["lp", "r_rank", "r_margin", "s_n", "sib_n"]
    edges = Q.with_label(W.edge_group_features(t.scored, t.sources), t.truth)
    return M.owner_ranker(edges.select(*PAIR, "label", *inputs), inputs)


@query("s1_id:s cand_id:i cos:f rk:i")
def embedded_names(t: Tables) -> DataFrame:
    names = t.read("part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("country"), F.col("p_name").alias("text"))
    return D.top2_of_texts(names.filter("entity_id % 3 <> 0"), names.filter("entity_id % 3 = 0"), D.hashed_ngrams()).withColumn("cand_id", F.col("cand_id").cast("long"))


# The uncertain zone and the whole linkage


def _taught_logits(t: Tables) -> DataFrame:
    return t.edges.filter("y = 1").select("s1_id", F.col("cand_id").cast("string").alias("cand_id"), F.col("prob").alias("ce_logit"))


@query("s1_id:i cand_id:s ce_logit:f", "edges", "SELECT s1_id, cand_id || '#d1' AS cand_id, CASE WHEN y = 1 THEN prob ELSE -(s1_id % 10) / 10 END AS ce_logit FROM edges WHERE prob > 0.01 AND prob < 0.99")
def filled_logits(t: Tables) -> DataFrame:
    wanted = M.uncertain(t.scored).select("s1_id", F.concat("cand_id", F.lit("#d1")).alias("cand_id"))
    return Z.filled_logits(wanted, [_taught_logits(t)], lambda d: d.withColumn("ce_logit", -(F.col("s1_id") % 10) / 10))


_ZONE = {"lg": "SELECT s1_id, cand_id, round(prob * 4 - 2, 6) AS l FROM edges WHERE prob > 0.2 AND prob < 0.8", "lr": _LOGITS["lr"]}


@query("s1_id:i cand_id:i prob:f p2_ce_logit:f p2_ce_rank_s1:i p2_ce_gap_cand:f", "edges", f"SELECT s1_id, cand_id, prob, l AS p2_ce_logit, rs AS p2_ce_rank_s1, l - {_GAPS.format('c', 'rc')} AS p2_ce_gap_cand FROM edges JOIN lr USING (s1_id, cand_id) {_WINDOWS}", **_ZONE)
def zone_parts(t: Tables) -> DataFrame:
    logits = M.uncertain(t.scored, 0.2, 0.8).select(*PAIR, F.round(F.col("prob") * 4 - 2, 6).alias("ce_logit"))
    return Z.zone_rows(t.scored, logits)


@query("s1_id:i cand_id:i p2_a_logit:f p2_b_logit:f p2_b_gap_s1:f", "edges", f"SELECT e.s1_id, e.cand_id, CASE WHEN y = 1 THEN prob END AS p2_a_logit, g.l AS p2_b_logit, g.gap AS p2_b_gap_s1 FROM edges e LEFT JOIN (SELECT s1_id, cand_id, l, l - {_GAPS.format('s', 'rs')} AS gap FROM lr {_WINDOWS}) g USING (s1_id, cand_id)", **_ZONE)
def multi_logit_zone(t: Tables) -> DataFrame:
    b = M.uncertain(t.scored, 0.2, 0.8).select(*PAIR, F.round(F.col("prob") * 4 - 2, 6).alias("ce_logit"))
    return Z.zone_table(t.scored, {"a": t.edges.filter("y = 1").select(*PAIR, F.col("prob").alias("ce_logit")), "b": b}, ["b"])


_LATER = "SELECT s1_id, cand_id, CASE WHEN prob > 0.01 AND prob < 0.99 AND y = 1 THEN round(1 - prob, 6) ELSE prob END AS prob FROM edges"
_OWN = "SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rk FROM {0}) WHERE rk = 1"


@query("macro_f05:f n_pred:i tp:i fp:i fn:i", "edges truth s1", "SELECT avg(f05) AS macro_f05, sum(n_pred) AS n_pred, sum(tp) AS tp, sum(n_pred) - sum(tp) AS fp, sum(n_true) - sum(tp) AS fn FROM per", later=_LATER, own3=_OWN.format("later"), pred=_RULE.format(0.5, 0.75).replace("FROM owned", "FROM own3"), **_EVAL, per=_PER.format("", "s1", ""))
def overlay_metrics(t: Tables) -> DataFrame:
    later = t.edges.filter("y = 1").select("s1_id", "cand_id", F.round(1 - F.col("prob"), 6).alias("p3"))
    return Z.overlay_metrics(t.scored, later, t.truth, t.s1, 0.5, 0.75)


_META = {"meta": "SELECT s1_id, cand_id, CASE WHEN y = 1 THEN 0.9 ELSE prob END AS prob FROM edges", "metaown": _OWN.format("meta")}


@query("thr_top:f thr_rest:f macro_f05:f", "edges truth s1", "SELECT thr_top, thr_rest, avg(f05) AS macro_f05 FROM per GROUP BY ALL ORDER BY round(avg(f05), 12) DESC, thr_top, thr_rest LIMIT 1", **_META, pred=f"SELECT thr_top, thr_rest, s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM metaown), {_GRID} WHERE prob >= CAST(CASE WHEN r = 1 THEN thr_top ELSE thr_rest END AS DOUBLE)", **_EVAL, per=_PER.format("s.thr_top, s.thr_rest,", f"(SELECT * FROM s1, {_GRID})", "thr_top, thr_rest,"))
def meta_rule(t: Tables) -> DataFrame:
    meta = t.edges.filter("y = 1").select("s1_id", "cand_id", F.lit(0.9).alias("q"))
    return Z.meta_rule(t.scored, meta, t.truth, t.s1, scratch(t.spark, "rule"))


@query("macro_f05:f micro_precision:f micro_recall:f singleton_acc:f n:i", "edges truth s1", "SELECT avg(f05) AS macro_f05, sum(tp) / greatest(sum(n_pred), 1) AS micro_precision, sum(tp) / greatest(sum(n_true), 1) AS micro_recall, avg(CASE WHEN n_true = 0 THEN f05 END) AS singleton_acc, count(*) AS n FROM per", half="SELECT s1_id, cand_id, CASE WHEN y = 1 AND cand_id % 2 = 0 THEN 0.7 ELSE prob END AS prob FROM edges", own3=_OWN.format("half"), pred=_RULE.format(0.55, 0.8).replace("FROM owned", "FROM own3"), **_EVAL, per=_PER.format("", "s1", ""))
def frozen_evaluation(t: Tables) -> DataFrame:
    meta = t.edges.filter("y = 1 and cand_id % 2 = 0").select("s1_id", "cand_id", F.lit(0.7).alias("q"))
    rule = t.spark.range(1).select(F.lit(0.55).alias("thr_top"), F.lit(0.8).alias("thr_rest"))
    return Z.frozen_evaluation(rule, t.scored, meta, t.truth, t.s1)


@query("s1_id:i cand_id:i prob:f y:i src:i extra:i", "edges", "SELECT s1_id, cand_id, prob, y, src, CASE WHEN y = 1 THEN cand_id % 5 END AS extra FROM edges")
def part_scan(t: Tables) -> DataFrame:
    """Edges in two folders: the second has a column of its own for some pairs, and one that the first one has already."""
    folder = scratch(t.spark, "parts")
    t.edges.write.parquet(f"{folder}/a")
    t.edges.filter("y = 1").select(*PAIR, F.lit(-1.0).alias("PROB"), (F.col("cand_id") % 5).alias("extra")).write.parquet(f"{folder}/b")
    return parts.read_parts(t.spark, [f"{folder}/a", f"{folder}/b"])


_UNSEEN = "SELECT e.s1_id, e.cand_id, CASE WHEN country < 5 THEN round(1 - prob, 6) ELSE prob END AS prob, CASE WHEN country < 5 THEN 0.9 ELSE 0.5 END AS thr_top, CASE WHEN country < 5 THEN 0.9 ELSE 0.75 END AS thr_rest FROM edges e JOIN s1 USING (s1_id)"


@query("s1_id:i cand_id:i prob:f", "edges s1", "SELECT d.s1_id, d.cand_id, d.prob FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS r FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rk FROM joint) WHERE rk = 1)) d JOIN edges e USING (s1_id, cand_id) WHERE d.prob >= CASE WHEN r = 1 THEN thr_top ELSE thr_rest END AND e.prob >= 0.05", joint=_UNSEEN)
def linkage_decisions(t: Tables) -> DataFrame:
    """The decision part of the linkage: two chains of scores by country, one owner, rank rule or flat threshold, candidates only."""
    own = t.scored.withColumn("prob", F.round(1 - F.col("prob"), 6))
    scored = Z.override(t.scored, t.s1, t.s1.filter("country < 5").select("country").distinct(), own, 0.5, 0.75, 0.9)
    return concluded(scored, t.scored.filter("prob >= 0.05")).matches


@query("s1_id:s cand_id:s prob:f")
def linkage_run(t: Tables) -> DataFrame:
    """The whole linkage of shops, brands dealt to three countries: the truth of the first brands is known, the later ones' records are
    matched; every fifth brand is of a country without labels."""
    number = F.regexp_extract("country", "([0-9]+)$", 1).try_cast("int")
    raw = t.raw.withColumn("n", number).withColumn("country", F.concat(F.lit("land "), F.when(F.col("n") % 5 == 0, F.lit("new")).otherwise((F.col("n") % 3).cast("string"))))
    train = raw.filter("n <= 12 and n % 5 <> 0").drop("n")
    truth = t.raw_truth.join(train.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    return link(t.spark, train, truth, raw.filter("n > 12").drop("n"), scratch(t.spark, "linkage"), Settings()).matches
