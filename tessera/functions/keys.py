"""Blocking keys: a token string becomes an array of keys, for explode(). Prefixes tell the kinds of keys apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, tokens


def _upto(n: Column) -> Column:
    """0 to n - 1, empty for n = 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def _pairs(ts: Column) -> Column:
    """All unordered pairs of an array, in its order."""
    return F.flatten(F.transform(ts, lambda a, i: F.transform(F.slice(ts, i + 2, F.greatest(F.size(ts) - i - 1, F.lit(0))), lambda b: F.concat(a, F.lit("_"), b))))


def glued(ts: Column) -> Column:
    """The sorted distinct tokens written together."""
    return F.array_join(F.array_sort(F.array_distinct(ts)), "")


def name_keys(name: Column) -> Column:
    """w: words; p, s: first and last four letters of words of six or more; q: pairs of distinct words, of names with two to
    eight of them; c: all distinct words sorted and written together."""
    some = F.array().cast("array<string>")

    def keys(ts: Column) -> Column:
        long = F.filter(ts, lambda t: F.length(t) >= 6)
        pairs = let(F.array_sort(F.array_distinct(ts)), lambda u: F.when(F.size(u).between(2, 8), F.transform(_pairs(u), lambda t: F.concat(F.lit("q"), t))).otherwise(some))
        return F.concat(
            F.transform(ts, lambda t: F.concat(F.lit("w"), t)),
            F.transform(long, lambda t: F.concat(F.lit("p"), F.substring(t, 1, 4))),
            F.transform(long, lambda t: F.concat(F.lit("s"), F.right(t, F.lit(4)))),
            pairs,
            F.when(F.size(ts) > 0, F.array(F.concat(F.lit("c"), glued(ts)))).otherwise(some),
        )

    return let(tokens(name), keys)


def addr_keys(address: Column) -> Column:
    """a: tokens; b: pairs of neighbours."""
    return let(tokens(address), lambda ts: F.concat(F.transform(ts, lambda t: F.concat(F.lit("a"), t)), F.transform(_upto(F.size(ts) - 1), lambda i: F.concat(F.lit("b"), F.get(ts, i), F.lit("_"), F.get(ts, i + 1)))))


def cross_keys(name: Column, numbers: Column) -> Column:
    """Every pair of one of the first six distinct words and one of the first four numbers (x), and those words together with
    each of the numbers (y)."""
    four = F.slice(tokens(numbers), 1, 4)

    def keys(six: Column) -> Column:
        each = F.flatten(F.transform(four, lambda n: F.transform(six, lambda w: F.concat(F.lit("x"), w, F.lit("|"), n))))
        return F.concat(each, F.transform(F.filter(four, lambda n: F.size(six) > 0), lambda n: F.concat(F.lit("y"), glued(six), F.lit("|"), n)))

    return let(F.slice(F.array_distinct(tokens(name)), 1, 6), keys)


def num_word_keys(numbers: Column, address: Column) -> Column:
    """Each of the first three numbers with each distinct of the first ten words."""
    ws = F.array_distinct(F.slice(F.filter(tokens(address), lambda t: ~F.rlike(t, F.lit(r"^\d+$"))), 1, 10))
    return let(ws, lambda own: F.flatten(F.transform(F.slice(tokens(numbers), 1, 3), lambda n: F.transform(own, lambda w: F.concat(n, F.lit("|"), w)))))


def char_trigrams(text: Column) -> Column:
    """Trigrams of each word with a blank at either side."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(F.concat(F.lit(" "), t, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(tokens(text), one))
