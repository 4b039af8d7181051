"""Stand-in inputs from the synthetic tables: records, scored edges, truth, vectors, and the same as DuckDB SQL.

Records come from documents: the name is the words of the first sentence, the address those of the last line where there are
several lines, the country is the language, the source doc_id % 3 + 1. Edges come from lineitem: supplier and part are S1 and record.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import LEGAL_FORMS, NAME_STOP, STATE_CODES
from ..functions.text import plain_tokens
from ..operators.candidates import MAX_DF
from ..runtime import loose

LEGAL = sorted(set(LEGAL_FORMS.values()))


class Tables:
    """The stand-ins over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str, max_df: int = MAX_DF):
        self.spark, self.folder, self.max_df = spark, folder, max_df

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        name = plain_tokens(F.get(F.split(text, "[.\n]"), F.lit(0)))
        lines = F.split(text, "\n")
        address = F.when(F.size(lines) > 1, plain_tokens(F.element_at(lines, -1))).otherwise(F.array().cast("array<string>"))
        d = self.read("documents").select(F.col("doc_id").alias("entity_id"), (F.col("doc_id") % 3 + 1).alias("src"), F.col("lang").alias("country"), name.alias("nt"), address.alias("at"))
        joined = lambda c: F.array_join(c, " ")
        kept = lambda c, f: joined(F.filter(c, f))
        digits = lambda t: F.rlike(t, F.lit("^[0-9]+$"))
        return d.select(
            "entity_id", "src", "country", joined(F.col("nt")).alias("name_full"), kept("nt", lambda t: ~t.isin(NAME_STOP)).alias("name_core"), joined(F.array_sort(F.array_distinct(F.filter("nt", lambda t: t.isin(LEGAL))))).alias("name_legal"),
            joined(F.col("at")).alias("addr_tokens"), kept("at", lambda t: ~digits(t)).alias("addr_words"), joined(F.array_distinct(F.filter("at", digits))).alias("addr_nums"), joined(F.array_sort(F.array_distinct(F.filter("at", lambda t: t.isin(STATE_CODES))))).alias("addr_state"), (F.size("at") == 0).alias("addr_empty"),
        )

    @cached_property
    def shops(self) -> DataFrame:
        """Records with house numbers, misspelt and invented names, from part: a brand is a country."""
        key, other = F.col("p_partkey"), F.col("p_partkey") % 3 != 0
        name = F.when(other & (key % 4 == 0), F.concat(F.lit("zz"), key)).when(other & (key % 4 == 1), F.replace("p_name", F.lit("i"), F.lit("ii"))).otherwise(F.col("p_name"))
        empty = key % 11 == 0
        numbers = F.concat_ws(" ", "p_size", key % 7 + 100)
        blank = lambda c: F.when(empty, "").otherwise(c)
        d = self.read("part").select(key.alias("entity_id"), (key % 3 + 1).alias("src"), F.col("p_brand").alias("country"), name.alias("name_core"), name.alias("name_full"), blank(F.concat_ws(" ", "p_size", F.lower("p_type"), key % 7 + 100, "p_name")).alias("addr_tokens"), blank(F.concat_ws(" ", F.lower("p_type"), "p_name")).alias("addr_words"), blank(numbers).alias("addr_nums"), empty.alias("addr_empty"))
        return d

    @cached_property
    def raw(self) -> DataFrame:
        """Raw records as a linkage reads them, from shops, whose brand is their town; ids are strings."""
        d = self.shops
        return d.select(F.col("entity_id").cast("string").alias("entity_id"), F.initcap("name_full").alias("business_name"), F.when(F.col("addr_empty"), "").otherwise(F.concat_ws(", ", F.concat_ws(" ", F.split_part("addr_nums", F.lit(" "), F.lit(1)), "addr_words"), F.concat(F.lit("Town "), F.replace("country", F.lit("#"), F.lit(""))), F.split_part("addr_nums", F.lit(" "), F.lit(2)))).alias("business_address"), "country", "src")

    @property
    def raw_truth(self) -> DataFrame:
        """The S1 of a brand that has a part's name as it was before it was misspelt: the smallest."""
        part = self.read("part").select("p_partkey", "p_name", "p_brand")
        first = part.filter("p_partkey % 3 = 0").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("s1_id"))
        return part.filter("p_partkey % 3 <> 0").join(first, ["p_name", "p_brand"]).select(F.col("s1_id").cast("string").alias("s1_id"), F.col("p_partkey").cast("string").alias("cand_id"))

    @cached_property
    def edges(self) -> DataFrame:
        """s1_id, cand_id, prob, y, src."""
        g = self.read("lineitem").groupBy(F.col("l_suppkey").alias("s1_id"), F.col("l_partkey").alias("cand_id"))
        return g.agg(F.round(F.avg("l_discount") * 10, 6).alias("prob"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("y")).withColumn("src", F.col("cand_id") % 2 + 2)

    @property
    def scored(self) -> DataFrame:
        return self.edges.select("s1_id", "cand_id", "prob")

    @property
    def truth(self) -> DataFrame:
        """One true S1 for each record that has any: the smallest."""
        return self.edges.filter("y = 1").groupBy("cand_id").agg(F.min("s1_id").alias("s1_id")).select("s1_id", "cand_id")

    @property
    def s1(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").alias("s1_id"), F.col("s_nationkey").alias("country"))

    @property
    def sources(self) -> DataFrame:
        return self.edges.select("cand_id", "src").distinct()

    @property
    def attributes(self) -> DataFrame:
        """cand_id and three values of parts that siblings may share."""
        return self.read("part").select(F.col("p_partkey").alias("cand_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("address"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_size").cast("string")).alias("nums"))

    @property
    def numbers(self) -> DataFrame:
        """Records whose house numbers are keys of lineitem, S1 by order and others by part: entity_id, addr_nums. S1 have three numbers, other
        records three or two; the third ones are near or cut forms of the S1's."""
        line, order, number = self._lines, F.col("l_orderkey"), F.col("l_linenumber")
        nums = lambda *c: F.concat_ws(" ", *c)
        a = line.select(F.concat(F.lit("o"), order, F.lit("-"), number).alias("entity_id"), nums(order, "l_suppkey", order % 997).alias("addr_nums"))
        third = F.when(number % 3 == 0, (order % 997 + number).cast("string")).when(number % 3 == 1, F.left((order % 997).cast("string"), F.lit(2)))
        b = line.select(F.concat(F.lit("p"), order, F.lit("-"), number).alias("entity_id"), nums("l_partkey", number, third).alias("addr_nums"))
        return a.unionByName(b)

    @property
    def number_pairs(self) -> DataFrame:
        return self._lines.select(*(F.concat(F.lit(x), "l_orderkey", F.lit("-"), "l_linenumber").alias(n) for x, n in (("o", "s1_id"), ("p", "cand_id"))))

    @property
    def _lines(self) -> DataFrame:
        """A row for each order and line number, which several rows may have."""
        return self.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))

    @property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("country"), F.col("embedding").cast("array<double>").alias("vec"))

    @property
    def name_pairs(self) -> DataFrame:
        """S1 and other records of a country whose names share the same set of words: each with the first and the last of the other side, so
        that a name that very many records share gives as many pairs as it has records."""
        from ..functions.text import order_free

        d = self.records.filter("name_core <> ''").select("entity_id", "src", "country", order_free(F.col("name_core")).alias("key"))
        of = lambda f, s1: f(F.when((F.col("src") == 1) == s1, F.col("entity_id")))
        ends = loose(d.groupBy("country", "key").agg(F.array(of(F.min, True), of(F.max, True)).alias("a"), F.array(of(F.min, False), of(F.max, False)).alias("b")))
        both = d.join(ends, ["country", "key"]).withColumn("other", F.explode(F.when(F.col("src") == 1, F.col("b")).otherwise(F.col("a")))).filter("other is not null")
        one = F.col("src") == 1
        return both.select(F.when(one, F.col("entity_id")).otherwise(F.col("other")).alias("s1_id"), F.when(one, F.col("other")).otherwise(F.col("entity_id")).alias("cand_id")).distinct()


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda z: z <> '')"


def order_free_sql(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({tokens_sql(x)})), ' ')"


def plain_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda z: z <> '')"


#: Common table expressions by name; one may use those before it.
CTES = {
    "words": f"SELECT doc_id AS entity_id, doc_id % 3 + 1 AS src, lang AS country, {plain_sql("string_split_regex(coalesce(text, ''), '[.\\n]')[1]")} AS nt, CASE WHEN len(string_split(text, chr(10))) > 1 THEN {plain_sql('string_split(text, chr(10))[-1]')} ELSE [] END AS ad FROM documents",
    "records": f"""SELECT entity_id, src, country, array_to_string(nt, ' ') AS name_full, array_to_string(list_filter(nt, lambda t: t NOT IN {_in(NAME_STOP)}), ' ') AS name_core,
        array_to_string(list_sort(list_distinct(list_filter(nt, lambda t: t IN {_in(LEGAL)}))), ' ') AS name_legal, array_to_string(ad, ' ') AS addr_tokens,
        array_to_string(list_filter(ad, lambda t: NOT regexp_full_match(t, '[0-9]+')), ' ') AS addr_words,
        array_to_string(list_transform(list_filter(range(1, len(ad) + 1), lambda i: regexp_full_match(ad[i], '[0-9]+') AND list_position(ad, ad[i]) = i), lambda i: ad[i]), ' ') AS addr_nums,
        array_to_string(list_sort(list_distinct(list_filter(ad, lambda t: t IN {_in(STATE_CODES)}))), ' ') AS addr_state, len(ad) = 0 AS addr_empty FROM words""",
    "shops": """SELECT p_partkey AS entity_id, p_partkey % 3 + 1 AS src, p_brand AS country, name AS name_core, name AS name_full, CASE WHEN e THEN '' ELSE p_size || ' ' || lower(p_type) || ' ' || (p_partkey % 7 + 100) || ' ' || p_name END AS addr_tokens,
        CASE WHEN e THEN '' ELSE lower(p_type) || ' ' || p_name END AS addr_words, CASE WHEN e THEN '' ELSE p_size || ' ' || (p_partkey % 7 + 100) END AS addr_nums, e AS addr_empty
        FROM (SELECT *, p_partkey % 11 = 0 AS e, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 = 0 THEN 'zz' || p_partkey WHEN p_partkey % 3 <> 0 AND p_partkey % 4 = 1 THEN replace(p_name, 'i', 'ii') ELSE p_name END AS name FROM part)""",
    "edges": "SELECT l_suppkey AS s1_id, l_partkey AS cand_id, round(avg(l_discount) * 10, 6) AS prob, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y, l_partkey % 2 + 2 AS src FROM lineitem GROUP BY ALL",
    "truth": "SELECT min(s1_id) AS s1_id, cand_id FROM edges WHERE y = 1 GROUP BY cand_id",
    "s1": "SELECT s_suppkey AS s1_id, s_nationkey AS country FROM supplier",
    "sources": "SELECT DISTINCT cand_id, src FROM edges",
    "attributes": "SELECT p_partkey AS cand_id, p_name AS name, p_brand || ' ' || p_type AS address, CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS nums FROM part",
    "numbers": "SELECT 'o' || l_orderkey || '-' || l_linenumber AS entity_id, l_orderkey || ' ' || l_suppkey || ' ' || l_orderkey % 997 AS addr_nums FROM lines UNION ALL SELECT 'p' || l_orderkey || '-' || l_linenumber, l_partkey || ' ' || l_linenumber || CASE WHEN l_linenumber % 3 = 0 THEN ' ' || (l_orderkey % 997 + l_linenumber) WHEN l_linenumber % 3 = 1 THEN ' ' || left(CAST(l_orderkey % 997 AS VARCHAR), 2) ELSE '' END FROM lines",
    "lines": "SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL",
    "number_pairs": "SELECT 'o' || l_orderkey || '-' || l_linenumber AS s1_id, 'p' || l_orderkey || '-' || l_linenumber AS cand_id FROM lines",
    "vectors": "SELECT vec_id AS id, label AS country, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings",
    "keyed": f"SELECT entity_id, src, country, {order_free_sql('name_core')} AS k FROM records WHERE name_core <> ''",
    "name_pairs": "SELECT a.entity_id AS s1_id, b.entity_id AS cand_id FROM (SELECT *, entity_id IN (min(entity_id) OVER w, max(entity_id) OVER w) AS e FROM keyed WHERE src = 1 WINDOW w AS (PARTITION BY country, k)) a JOIN (SELECT *, entity_id IN (min(entity_id) OVER w, max(entity_id) OVER w) AS e FROM keyed WHERE src <> 1 WINDOW w AS (PARTITION BY country, k)) b ON a.country = b.country AND a.k = b.k AND (a.e OR b.e)",
    "owned": "SELECT s1_id, cand_id, prob FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rk FROM edges) WHERE rk = 1",
}
_NEEDS = {"records": "words", "numbers": "lines", "number_pairs": "lines", "truth": "edges", "sources": "edges", "keyed": "records", "name_pairs": "keyed", "owned": "edges"}


def with_ctes(names: str, body: str, /, **more: str) -> str:
    """body behind the named expressions and what they need, and further ones in their order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in _NEEDS:
            add(_NEEDS[name])
        if name not in wanted:
            wanted.append(name)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({CTES[n]})" for n in wanted] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


_SQL = {"g": "round(CAST({0} AS DOUBLE), 9) + 0.0 AS {0}", "i": "CAST({0} AS BIGINT) AS {0}", "f": "round(CAST({0} AS DOUBLE), 6) + 0.0 AS {0}", "s": 'CAST("{0}" AS VARCHAR) AS "{0}"', "b": "CAST({0} AS BOOLEAN) AS {0}", "t": "CAST({0} AS TIMESTAMP) AS {0}"}


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """df with the columns of spec, "name:kind ...", cast alike on both sides; floats (f) have six places, fine ones (g) nine."""
    kinds: dict[str, object] = {"g": lambda c: F.round(c.cast("double"), 9) + F.lit(0.0), "i": lambda c: c.cast("long"), "f": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean"), "t": lambda c: c.cast("timestamp_ntz")}
    columns: list[Column] = [kinds[k](F.col(n)).alias(n) for n, k in (x.split(":") for x in spec.split())]
    return df.select(columns)


def shaped_sql(query: str, spec: str) -> str:
    return f"SELECT {', '.join(_SQL[k].format(n) for n, k in (x.split(':') for x in spec.split()))} FROM ({query})"
