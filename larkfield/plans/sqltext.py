"""DuckDB expressions for the rules, written apart from the Spark columns."""

from __future__ import annotations

from ..refdata import GENERIC_WORDS, LEGAL_FORMS, PHONE_RULES, STREET_COMPOUND, STREET_WORDS, TWO_LEVEL_SUFFIXES


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("&", " und "), ("ø", "o"), ("ł", "l")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace(strip_accents({out}), '[^a-z0-9]+', ' ', 'g'))"


def business_key(n: str) -> str:
    """Of normalised text."""
    kept = f"list_filter(string_split({n}, ' '), lambda w: w <> '' AND w NOT IN ({quoted(LEGAL_FORMS)}))"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {n} END"


def tokens(key: str) -> str:
    """Distinctive words of a canonical name."""
    return f"list_filter(string_split({key}, ' '), lambda w: length(w) >= 2 AND w NOT IN ({quoted(GENERIC_WORDS + LEGAL_FORMS)}))"


def edit_sim(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) END"


def key_sim(a: str, b: str) -> str:
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    both = f"len(list_intersect({x}, {y}))::double"
    overlap = f"({both} / len(list_distinct(list_concat({x}, {y}))) * 0.6::double + {both} / greatest(1, least(len({x}), len({y}))) * 0.4::double)"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE greatest({edit_sim(a, b)}, {overlap}) END"


def coverage(toks: str, hay: str) -> str:
    return f"CASE WHEN len({toks}) = 0 THEN 0.0 ELSE len(list_filter({toks}, lambda t: contains({hay}, t)))::double / len({toks}) END"


def clean(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '[\\s\\x0b\\x{{a0}}]+', ' ', 'g')), '')"


def street(x: str) -> str:
    out = f"regexp_replace({norm(x)}, '{STREET_COMPOUND}', '\\1 str', 'g')"
    for word, short in STREET_WORDS:
        out = f"regexp_replace({out}, '\\b{word}\\b', '{short}', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def postal(x: str) -> str:
    return f"upper(replace({clean(x)}, ' ', ''))"


def address_key(country: str, p: str, s: str, n: str) -> str:
    return f"CASE WHEN {postal(p)} IS NOT NULL AND {street(s)} <> '' THEN lower(concat_ws('|', upper(coalesce({country}, '')), {postal(p)}, {street(s)}, replace({norm(n)}, ' ', ''))) END"


def phone_world(x: str) -> str:
    return f"regexp_replace(regexp_replace(replace({clean(x)}, '(0)', ''), '[\\s()/.\\-]', '', 'g'), '^00', '+')"


def e164(x: str, home: str = "DE") -> str:
    """CASE over the rule table; longer calling codes first."""
    w, whens = phone_world(x), []
    for key, (code, trunk, least, most) in sorted(PHONE_RULES.items(), key=lambda r: -len(r[1][0])):
        rest = f"substr({w}, {len(code) + 2})"
        whens.append(f"WHEN starts_with({w}, '+{code}') AND length({rest}) BETWEEN {least} AND {most} AND NOT starts_with({rest}, '0') THEN {w}")
        if key == home:
            own = f"substr({w}, 2)"
            whens.append(f"WHEN starts_with({w}, '0') AND length({own}) BETWEEN {least} AND {most} AND NOT starts_with({own}, '0') THEN '+{code}' || {own}")
    return f"CASE WHEN {w} IS NULL OR NOT regexp_matches({w}, '^\\+?[0-9]{{6,16}}$') THEN NULL {' '.join(whens)} END"


def compare(a: str, b: str) -> str:
    x, y = f"regexp_replace({a}, '\\D', '', 'g')", f"regexp_replace({b}, '\\D', '', 'g')"
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 'unknown' WHEN {a} = {b} THEN 'match' WHEN length({x}) >= 8 AND length({y}) >= 8 AND (starts_with({x}, {y}) OR starts_with({y}, {x})) THEN 'unknown' ELSE 'mismatch' END"


def host(x: str) -> str:
    whole = f"CASE WHEN contains({x}, '://') THEN trim({x}) ELSE 'https://' || trim({x}) END"
    return f"regexp_replace(lower(nullif(regexp_extract({whole}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1), '')), '^www\\.', '')"


def domain(h: str) -> str:
    """Of a host."""
    parts = f"string_split({h}, '.')"
    two = f"array_to_string({parts}[-2:], '.')"
    return f"CASE WHEN len({parts}) <= 2 THEN {h} WHEN {two} IN ({quoted(TWO_LEVEL_SUFFIXES)}) THEN array_to_string({parts}[-3:], '.') ELSE {two} END"


def metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371000.0 * asin(CASE WHEN {h} > 1 THEN 1.0 ELSE sqrt({h}) END))"
