"""Column functions on text: folding, tokens, order-free and spelling-variant keys. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import romanise, tables

_FROM, _TO, _SEVERAL = tables.latin_folding()


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: inside of lambdas an expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lookup(values: Mapping[str, str]) -> Column:
    """A map literal; empty for no values."""
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items()))) if values else F.from_json(F.lit("{}"), "map<string,string>")


def found(values: Column, key: Column) -> Column:
    """The key's value in a map, null where it has none."""
    return F.try_element_at(values, key)


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


#: Texts with a character that romanised() spells out.
SPELLED = "[" + "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in (*romanise.BLOCKS, romanise.HANGUL)) + "]"


def romanised(s: Column) -> Column:
    """Letters of other scripts as romanise.py spells them, each by its place in a table."""
    table = F.split(F.lit("|".join(romanise.spellings())), r"\|")
    lead, middle, tail = (F.split(F.lit("|".join(x)), r"\|") for x in (romanise.LEADS, romanise.MIDDLES, romanise.TAILS))

    def one(c: Column) -> Column:
        code, out, start = F.ascii(c), F.lit(None).cast("string"), 0
        for a, b in romanise.BLOCKS:
            out = F.when((code >= a) & (code <= b), F.get(table, code - (a - start))).otherwise(out)
            start += b - a + 1
        k = code - romanise.HANGUL[0]
        parts = F.concat(F.get(lead, F.floor(k / 588).cast("int")), F.get(middle, F.floor(k % 588 / 28).cast("int")), F.get(tail, (k % 28).cast("int")))
        out = F.when((code >= romanise.HANGUL[0]) & (code <= romanise.HANGUL[1]), F.replace(parts, F.lit("-"), F.lit(""))).otherwise(out)
        return F.when(out != romanise.SAME, out).otherwise(c)

    return F.when(F.rlike(s, F.lit(SPELLED)), F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)(.)"), F.lit(1)), one), "")).otherwise(s)


def fold(s: Column) -> Column:
    """Latin letters without their marks, letters of other scripts romanised."""
    for c, plain in _SEVERAL:
        s = F.replace(s, F.lit(c), F.lit(plain))
    return romanised(F.translate(s, _FROM, _TO))


def is_native(s: Column) -> Column:
    """Any character outside ASCII."""
    return F.rlike(s, F.lit(r"[^\x00-\x7F]"))


def is_non_latin(s: Column) -> Column:
    """Any character outside the Latin blocks."""
    return F.rlike(s, F.lit(r"[^\x00-\x{024F}\x{1E00}-\x{1EFF}]"))


def tokens(s: Column) -> Column:
    """Non-empty parts between blanks; null counts as empty."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), " "), lambda t: t != "")


def plain_tokens(s: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def joined(ts: Column) -> Column:
    return F.array_join(ts, " ")


def order_free(s: Column) -> Column:
    """The sorted set of a text's tokens, as a text."""
    return joined(F.array_sort(F.array_distinct(tokens(s))))


def variant_key(t: Column) -> Column:
    """Spelling-variant key of a romanised word: digraphs merged, vowels after the first letter dropped, repeats collapsed."""
    for a, b in tables.DIGRAPHS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, "(?<=.)[aeiouy]+", ""), r"(.)\1+", "$1")


def name_variant_key(s: Column) -> Column:
    """The sorted set of the variant keys of a name's words, "" for an empty name."""
    return joined(F.array_sort(F.array_distinct(F.transform(tokens(s), variant_key))))


def without(ts: Column, gone: list[str]) -> Column:
    return F.filter(ts, lambda t: ~t.isin(gone))


def trailing_number(entity_id: Column) -> Column:
    """The digits at the end of an id as a number, null without any."""
    return F.regexp_extract(entity_id.cast("string"), r"(\d+)$", 1).try_cast("long")


def fold_of(entity_id: Column) -> Column:
    """Cross-fitting fold: the id's trailing number modulo 2."""
    return trailing_number(entity_id) % 2


def original_id(entity_id: Column) -> Column:
    """A clone's original: the id without #d and its number."""
    return F.regexp_replace(entity_id.cast("string"), r"#d\d+$", "")
