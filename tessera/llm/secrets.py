"""Secret scans: pattern spans, and credential-context values that a password guesser would not find soon.

A value after a credential word is cut into the cheapest row of pieces (dictionary words, dates, repeats, keyboard
walks, brute-force rests) by dynamic programming over log10 of the guesses each piece takes; a value whose cheapest
row still takes many guesses is a secret, however short and of whatever characters. The dictionary holds common parts of
passwords and the whole words of two public tokenizers' vocabularies, by rank; so it is the dictionary that lets prose pass. A quoted
value reaches to its closing quote, any other to the next white space or mark of separation. Values with letters of scripts
without case, which the vocabularies hardly hold as words, are the exception: they count as prose.

Null and empty texts have no spans. Repeated rows give repeated results. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, strings

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Long credential words may stand anywhere, as in the base pattern; short ones begin a word or a part of one in camel case.
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization"""
    r"""|(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))(?:pass|pwd|pin|auth|bearer))"""
    r"""["']?[ \t]{0,4}(?:[:=]|=>|:=)[ \t]{0,4}(?:"([^"\n]+)"|'([^'\n]+)'|["']?(?:(?:bearer|basic|digest|token)[ \t]{1,4})?([^\s"'<>,;]+))""",
    re.I | re.A,
)
_SCHEME = re.compile(r"(?:bearer|basic|digest|token)[ \t]{1,4}", re.I | re.A)
#: The longest credential word with its separator: as much of a value's end may begin the next context.
_HEAD = len("authorization:=")
_HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "credential", "auth", "bearer")

#: Common parts of passwords, the most common first; a word's place is its number of guesses.
WORDS = "password pass qwerty letmein admin welcome login monkey dragon master hello freedom whatever trust love sunshine princess football baseball shadow michael jordan superman batman secret summer winter spring autumn monday friday test guest root user changeme default temp access flower orange apple banana cookie pepper ginger silver golden diamond computer internet server system service database account private public company office home family money happy lucky angel baby star blue red green black white the and for you token key api dev prod demo sample example".split()

ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Vocabularies whose whole words of MIN_WORD letters or more are the dictionary's further words.
VOCABULARIES, MIN_WORD = ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"), 3
_LEET = str.maketrans("013457@$!", "oieastasi")


def _adjacent() -> set[tuple[str, str]]:
    """Neighbouring keys: along a row, and the two keys half a key to either side in the rows above and below."""
    pairs = set()
    for r, row in enumerate(ROWS):
        for i, key in enumerate(row):
            near = list(row[i + 1 : i + 2])
            if r + 1 < len(ROWS):
                near += ROWS[r + 1][max(0, i - 1) : i + 1]
            pairs |= {(key, x) for x in near} | {(x, key) for x in near}
    return pairs


ADJACENT = _adjacent()
_KEYS, _DEGREE = sum(map(len, ROWS)), len(ADJACENT) / sum(map(len, ROWS))
#: log10 of the guesses that each further piece adds: the guesser must find where pieces meet.
JOINT = math.log10(2)


@cache
def dictionary(files: tuple[str, ...] = VOCABULARIES) -> dict[str, int]:
    """The rank of each word: WORDS first, then the files' whole words by their place there, the better one of two places."""
    import public_tokenizers

    ranks: dict[str, int] = {}
    for file in files:
        with open(public_tokenizers.path(file), "rb") as f:
            if file.endswith(".json"):
                whole = ((w.removesuffix("</w>"), n) for w, n in json.load(f)["model"]["vocab"].items() if w.endswith("</w>"))
            else:
                whole = ((w[1:].decode("utf-8", "ignore").lower(), int(n)) for w, n in ((base64.b64decode(a), b) for a, b in map(bytes.split, f)) if w[:1] == b" ")
            for w, n in whole:
                if len(w) >= MIN_WORD and w.isalpha():
                    ranks[w] = min(n + len(WORDS), ranks.get(w, 1 << 30))
    return ranks | {w: k for k, w in reversed(list(enumerate(WORDS, 1)))}


@cache
def _longest(files: tuple[str, ...] = VOCABULARIES) -> int:
    return max(map(len, dictionary(files)))


def _word_matches(value: str, ranks: dict[str, int], longest: int) -> Iterator[tuple[int, int, float]]:
    lower = value.lower()
    if len(lower) != len(value):
        return
    plain = lower.translate(_LEET)
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + longest) + 1):
            for form, extra in ((lower[i:j], 0.0), (plain[i:j], JOINT)):
                if rank := ranks.get(form):
                    upper = sum(c.isupper() for c in value[i:j])
                    yield i, j, math.log10(rank + 1) + extra + (JOINT if upper in (1, j - i) else upper * JOINT)
                    break


_DATES = re.compile(r"(?=((?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2((?:19|20)?\d\d)))|(?=((?:19|20)\d\d)([-/._]?)(?:0?[1-9]|1[0-2])\5(?:0?[1-9]|[12]\d|3[01]))|(?=((?:19|20)\d\d))", re.A)


def _date_matches(value: str) -> Iterator[tuple[int, int, float]]:
    for m in _DATES.finditer(value):
        for whole, year in ((1, 3), (6, 6)):
            if m[whole]:
                y = int(m[year])
                y += 0 if y >= 100 else 1900 if y > 50 else 2000
                days = 1 if whole == 6 else 366
                yield m.start(), m.end(whole), math.log10(days * max(abs(y - 2020), 20)) + (JOINT * 2 if whole == 1 and m[2] else 0)
        if m[4]:
            end = re.compile(r"\d{4}([-/._]?)\d\d?\1\d\d?", re.A).match(value, m.start()).end()
            yield m.start(), end, math.log10(366 * max(abs(int(m[4]) - 2020), 20)) + (JOINT * 2 if m[5] else 0)


def _repeat_matches(value: str) -> Iterator[tuple[int, int, float, str, int]]:
    """Runs of a unit of one to eight characters, at least twice and three characters in all."""
    for size in range(1, 9):
        i = 0
        while i + 2 * size <= len(value):
            j = i + size
            while j < len(value) and value[j] == value[j - size]:
                j += 1
            times = (j - i) // size
            if times >= 2 and times * size >= 3:
                yield i, i + times * size, math.log10(times), value[i : i + size], times
                i = j - size + 1
            else:
                i += 1


def _walk_matches(value: str) -> Iterator[tuple[int, int, float]]:
    lower, i = value.lower(), 0
    if len(lower) != len(value):
        return
    while i + 2 < len(lower):
        j, turns, last = i + 1, 1, None
        while j < len(lower) and (lower[j - 1], lower[j]) in ADJACENT:
            way = next(((r2 - r1, k2 - k1) for r1, a in enumerate(ROWS) for k1, x in enumerate(a) if x == lower[j - 1] for r2, b in enumerate(ROWS) for k2, y in enumerate(b) if y == lower[j]), None)
            turns += last is not None and way != last
            last = way
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(_KEYS * _DEGREE**turns * (j - i))
            i = j - 1
        else:
            i += 1


def guess_cost(value: str, files: tuple[str, ...] = VOCABULARIES, nested: bool = True) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes.

    A piece costs its own guesses, each further piece JOINT; a brute-force span of n characters costs n. The work is
    linear in the length for values without long runs.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in (*_word_matches(value, dictionary(files), _longest(files)), *_date_matches(value), *_walk_matches(value)):
        ends.setdefault(j, []).append((i, cost))
    if nested:
        for i, j, cost, unit, _ in _repeat_matches(value):
            ends.setdefault(j, []).append((i, cost + guess_cost(unit, files, False)))
    known = [0.0]  # cheapest rows that end with a known piece, or are empty
    brute = [math.inf]  # those that end with a brute-force span
    for j in range(1, len(value) + 1):
        best = math.inf
        for i, cost in ends.get(j, ()):
            before = min(known[i], brute[i])
            best = min(best, before + cost + (JOINT if i else 0))
        brute.append(1 + min(brute[j - 1], known[j - 1] + (JOINT if j > 1 else 0)))
        known.append(best)
    return min(known[-1], brute[-1])


def _caseless(value: str) -> bool:
    """Whether it holds a letter of a script without case, as scripts without blanks between words are."""
    return not value.isascii() and any(c.isalpha() and c.lower() == c.upper() for c in value)


def _guesses(text: str, min_log10: float, min_length: int) -> Iterator[tuple[str, int, int]]:
    at = done = 0
    while m := _CONTEXT.search(text, at):
        start, end = m.span(m.lastindex)
        # A value's end may be the next context ("secret: password: ..."). A tail of a value is no value of its own: whoever
        # guesses the value has it.
        at = max(start, end - _HEAD)
        if end <= done:
            continue
        done = end
        if m.lastindex < 3 and (scheme := _SCHEME.match(text, start, end)):
            start = scheme.end()
        value = text[start:end].rstrip(".!?)]}") if m.lastindex == 3 else text[start:end]
        if len(value) >= min_length and not _caseless(value) and guess_cost(value) >= min_log10:
            yield "guess", start, start + len(value)


def scan(text: str, min_log10: float = 7.0, min_length: int = 6) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then kind as listed in KINDS.

    assign, access and hex are leftmost and do not overlap within their kind. A guess span is a credential-context
    value of min_length characters or more which takes 10 ** min_log10 guesses or more.
    """
    low = text.lower()
    found = []
    if any(h in low for h in _HINTS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        found += _guesses(text, min_log10, min_length)
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = 7.0) -> DataFrame:
    """A row for each document: doc_id and spans array<struct<kind, start, end>>. One narrow pass, no shuffle."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, min_log10)] for t in strings(b, 1)]
            yield pa.record_batch([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), find, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, marker: str = "[SECRET]", min_log10: float = 7.0) -> DataFrame:
    """documents with every span replaced by marker, overlapping spans by one; n_chars follows. Null texts stay null."""
    schema = docs.schema
    columns = docs.columns

    def mask(text: str | None) -> str | None:
        if not text or not (spans := scan(text, min_log10)):
            return text
        parts, at = [], 0
        for _, s, e in sorted(spans, key=lambda s: s[1:]):
            if s >= at:
                parts += [text[at:s], marker]
            at = max(at, e)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else -1
        for b in batches:
            texts = [mask(t) for t in b.column(k).to_pylist()]
            arrays = list(b.columns)
            arrays[k] = pa.array(texts, b.schema.field(k).type)
            if n >= 0:
                arrays[n] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(n).type)
            yield pa.record_batch(arrays, schema=b.schema)

    return map_arrow(docs, run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of op1 from the spans of find_secrets."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess")
    )
