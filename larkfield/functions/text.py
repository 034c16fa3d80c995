"""Names and free text: canonical form, tokens, similarity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import GENERIC_WORDS, LEGAL_FORMS, accent_table

#: White space as browsers know it, for regular expressions.
BLANK = r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_text(c: Column) -> Column:
    """Lower case, umlauts as two letters, other accents off, ``&`` as a word, everything else but a-z and 0-9 as one space. Null gives ''."""
    low = F.lower(F.coalesce(c, F.lit("")))
    for letter, two in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("&", " und ")):
        low = F.replace(low, F.lit(letter), F.lit(two))
    return F.trim(F.regexp_replace(F.translate(low, *accent_table()), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """The words of normalised text; none for ''."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def business_name(c: Column) -> Column:
    """Canonical name: without legal forms, unless nothing else is left."""
    kept = lambda text: F.array_join(F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(*LEGAL_FORMS)), " ")
    return let(normalize_text(c), lambda text: F.coalesce(F.nullif(kept(text), F.lit("")), text))


def distinctive_tokens(c: Column) -> Column:
    """Words of the canonical name with two letters or more that are neither generic nor legal; order and repeats stay."""
    return F.filter(F.split(business_name(c), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*GENERIC_WORDS, *LEGAL_FORMS))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; both empty 1, one empty 0."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def key_similarity(a: Column, b: Column) -> Column:
    """Similarity of two canonical names: 0 if one is empty, 1 if equal, else the larger of edit similarity and word overlap."""
    known = let(F.struct(distinct_words(a).alias("x"), distinct_words(b).alias("y")), lambda t: word_overlap(t["x"], t["y"]))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(edit_similarity(a, b), known))


def distinct_words(c: Column) -> Column:
    return F.array_distinct(words(c))


def word_overlap(x: Column, y: Column) -> Column:
    """What two names share of their distinct words: of all, and of those of the name with fewer."""
    return let(F.size(F.array_intersect(x, y)), lambda both: both / (F.size(x) + F.size(y) - both) * 0.6 + both / F.greatest(F.lit(1), F.least(F.size(x), F.size(y))) * 0.4)


def is_alike(a: Column, b: Column, x: Column, y: Column, least: float) -> Column:
    """Whether ``key_similarity`` is ``least`` (above 0) or more, of names with their distinct words; the words are only compared where edits are too many."""
    return (a != "") & (b != "") & ((a == b) | (edit_similarity(a, b) >= least) | (word_overlap(x, y) >= least))


def name_similarity(a: Column, b: Column) -> Column:
    return key_similarity(business_name(a), business_name(b))


def coverage_of(tokens: Column, hay: Column) -> Column:
    """The share of ``tokens`` that the normalised text ``hay`` contains; 0 without tokens."""
    share = lambda own, text: F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda t: F.contains(text, t))) / F.size(own))
    return let(tokens, lambda own: let(hay, lambda text: share(own, text)))


def token_coverage(name: Column, hay: Column) -> Column:
    return coverage_of(distinctive_tokens(name), normalize_text(hay))


def clean_string(c: Column) -> Column:
    """One space for each run of white space, none at the ends, blank as null."""
    return F.nullif(F.trim(F.regexp_replace(c, f"{BLANK}+", " ")), F.lit(""))


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(n)) for n in needles])
