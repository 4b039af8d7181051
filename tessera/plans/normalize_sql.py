"""DuckDB SQL of name and address normalisation, built from the same tables, to hold the column functions against."""

from __future__ import annotations

from ..functions import romanise as R
from ..functions import tables as T
from ..functions.text import _FROM, _SEVERAL, _TO, SPELLED


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold_sql(x: str) -> str:
    for c, plain in _SEVERAL:
        x = f"replace({x}, {quoted(c)}, {quoted(plain)})"
    x = f"translate({x}, {quoted(_FROM)}, {quoted(_TO)})"
    table = lambda values: f"string_split({quoted('|'.join(values))}, '|')"
    cases, start = "", 1
    for a, b in R.BLOCKS:
        cases += f"WHEN ord(c) BETWEEN {a} AND {b} AND {table(R.spellings())}[ord(c) - {a - start}] <> '{R.SAME}' THEN {table(R.spellings())}[ord(c) - {a - start}] "
        start += b - a + 1
    k = f"(ord(c) - {R.HANGUL[0]})"
    cases += f"WHEN ord(c) BETWEEN {R.HANGUL[0]} AND {R.HANGUL[1]} THEN replace({table(R.LEADS)}[{k} // 588 + 1] || {table(R.MIDDLES)}[{k} % 588 // 28 + 1] || {table(R.TAILS)}[{k} % 28 + 1], '-', '')"
    return f"list_transform([{x}], lambda x: CASE WHEN regexp_matches(x, {quoted(SPELLED)}) THEN array_to_string(list_transform(regexp_extract_all(x, '(?s).'), lambda c: CASE {cases} ELSE c END), '') ELSE x END)[1]"


def _map(values: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in values.items()) + "}"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def _all(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"


_NUMBER = "regexp_full_match({0}, '[0-9]+')"
_CANON = sorted(set(T.LEGAL_FORMS.values()))


def _parts(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda z: z <> '')"


def _fixed(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '[0-9]') AND regexp_matches({t}, '[a-z]') AND NOT regexp_matches({t}, {quoted(T.ORDINAL)}) THEN translate({t}, {quoted(T.DIGIT_TYPOS[0])}, {quoted(T.DIGIT_TYPOS[1])}) ELSE {t} END"


def _name_tokens(x: str) -> str:
    canon = f"list_transform(list_transform({_parts(_all(x, '[^a-z0-9]+', ' '))}, lambda t: {_fixed('t')}), lambda t: coalesce({_map(T.LEGAL_FORMS)}[t], t))"
    return f"list_transform([{canon}], lambda c: list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR c[i] <> c[i - 1]), lambda i: c[i]))[1]"


def names_sql(source: str) -> dict[str, str]:
    """Common table expressions from source (entity_id, raw) to named (entity_id and the name columns)."""
    honorific = T.HONORIFIC.removesuffix(r"(?=\S)") + r"(\S)"
    phrases = _all("s", r"\d{7,}", " ")
    for pattern, form in T.LEGAL_PHRASES:
        phrases = _all(phrases, pattern, form)
    kept = f"t NOT IN {_in(_CANON + T.NAME_STOP)}"
    core = lambda c: f"array_to_string(list_filter({c}, lambda t: {kept}), ' ')"
    glued = lambda c: f"CASE WHEN concat <> '' AND (len(a) = 0 OR (weak AND NOT list_contains(a, concat))) THEN list_append(list_filter({c}, lambda t: length(t) > 2), concat) ELSE {c} END"
    fold = fold_sql(_all("raw", r"\b[nN]\s*[°º]", " no "))
    return {
        "nm1": f"SELECT entity_id, raw, replace(replace(replace(regexp_replace(lower({fold}), {quoted(honorific)}, {quoted(' ' + chr(92) + '1')}), '&', ' and '), '+', ' plus '), '''', '') AS s FROM ({source})",
        "nm2": f"SELECT entity_id, raw, replace(regexp_extract(s, {quoted(T.WEBSITE)}, 1), '-', '') AS site, {_all('s', T.WEBSITE, ' ')} AS s FROM nm1",
        "nm3": f"SELECT entity_id, raw, site, CASE WHEN regexp_matches(s, '[#@]') THEN {_all('s', '#' + chr(92) + 's*' + chr(92) + 'd+', ' ')} ELSE s END AS s FROM nm2",
        "nm4": "SELECT entity_id, raw, site, regexp_extract(s, '[#@][a-z0-9]+', 0) AS sign, CASE WHEN regexp_extract(s, '[#@][a-z0-9]+', 0) <> '' THEN replace(s, regexp_extract(s, '[#@][a-z0-9]+', 0), ' ') ELSE s END AS s FROM nm3",
        "nm5": f"SELECT entity_id, raw, site, sign, string_split_regex({_all(phrases, '[' + chr(92) + '[' + chr(92) + ']' + chr(92) + '(' + chr(92) + ')' + chr(92) + '{' + chr(92) + '}<>|]', ' ')}, {quoted(T.DBA)}) AS p FROM nm4",
        "nm6": f"SELECT entity_id, raw, CASE WHEN site <> '' THEN site ELSE substr(sign, 2) END AS concat, {_name_tokens(_joined('p'))} AS a, {_name_tokens('p[1]')} AS m, flatten(list_transform(p[2:], lambda q: {_name_tokens('q')})) AS l FROM nm5",
        "nm7": f"SELECT *, len(list_filter(a, lambda t: length(t) > 2 AND {kept})) = 0 AS weak FROM nm6",
        "nm8": f"SELECT entity_id, raw, concat, {glued('a')} AS a, {glued('m')} AS m, l FROM nm7",
        "named": f"SELECT entity_id, array_to_string(a, ' ') AS name_full, {core('a')} AS name_core, {core('m')} AS name_main, {core('l')} AS name_alt, array_to_string(list_sort(list_distinct(list_filter(a, lambda t: t IN {_in(_CANON)}))), ' ') AS name_legal, concat AS name_concat, regexp_matches(raw, '[^\\x00-\\x{{024F}}\\x{{1E00}}-\\x{{1EFF}}]') AS name_native FROM nm8",
    }


def _joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def addresses_sql(source: str) -> dict[str, str]:
    """Common table expressions from source (entity_id, raw) to addressed (entity_id and the address columns)."""
    state = f"coalesce({_map(T.STATES)}[c], CASE WHEN c IN {_in(T.STATE_CODES)} THEN c END)"
    after, before = r"^(\d+)([a-z]{1,6})$", r"^([a-z]{1,3})(\d+)$"
    pair = lambda p: f"[regexp_extract(t, {quoted(p)}, 1), regexp_extract(t, {quoted(p)}, 2)]"
    split = f"CASE WHEN regexp_matches(t, {quoted(T.ORDINAL)}) THEN [regexp_extract(t, {quoted(T.ORDINAL)}, 1)] WHEN regexp_matches(t, {quoted(after)}) THEN {pair(after)} WHEN regexp_matches(t, {quoted(before)}) THEN {pair(before)} ELSE [t] END"
    expanded = f"CASE WHEN {_NUMBER.format('t')} THEN [CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END] ELSE list_filter(string_split(coalesce({_map(T.ADDRESS_WORDS)}[t], t), ' '), lambda u: u NOT IN {_in(T.ADDRESS_STOP)}) END"
    fold = fold_sql(_all("raw", r"\b[nN]\s*[°º]", " no "))
    first = f"list_filter(range(1, len(t) + 1), lambda i: {_NUMBER.format('t[i]')} AND list_position(t, t[i]) = i)"
    return {
        "ad1": f"SELECT entity_id, list_filter(list_transform(string_split(replace(replace(lower({fold}), '<null>', ' '), 'n/a', ' '), ','), lambda c: trim({_all('c', '[^a-z0-9]+', ' ')})), lambda c: c <> '') AS cs FROM ({source})",
        "ad2": f"SELECT entity_id, list_filter(list_transform(cs, lambda c: {state}), lambda x: x IS NOT NULL) AS st, flatten(list_transform(list_filter(cs, lambda c: {state} IS NULL), lambda c: string_split(c, ' '))) AS t FROM ad1",
        "ad3": f"SELECT entity_id, st, flatten(list_transform(t, lambda t: {split})) AS t FROM ad2",
        "ad4": f"SELECT entity_id, st, list_filter(flatten(list_transform(t, lambda t: {expanded})), lambda t: NOT ({_NUMBER.format('t')} AND length(t) > 6)) AS t FROM ad3",
        "addressed": f"SELECT entity_id, {_joined('t')} AS addr_tokens, {_joined(f'list_filter(t, lambda z: NOT {_NUMBER.format(chr(122))})')} AS addr_words, {_joined(f'list_transform({first}, lambda i: t[i])')} AS addr_nums, {_joined('list_sort(list_distinct(st))')} AS addr_state, len(t) = 0 AS addr_empty FROM ad4",
    }
