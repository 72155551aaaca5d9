"""Tokenisers as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
MIN_BYTES = 2


def whitespace(text: Column, least: int = 1) -> Column:
    """Words between white space, case kept, of at least `least` bytes."""
    return F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: F.octet_length(w) >= least)


def simple(text: Column, least: int = MIN_BYTES, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Letters and digits of each word, lower-cased; short words and stop words go. The whole text is cleaned
    before it is split, so no expression runs for each word but the last filter."""
    words = F.split(F.lower(F.regexp_replace(text, r"(?U)[^\p{IsAlphabetic}\p{N}\s]+", "")), r"(?U)\s+")
    return F.filter(words, lambda w: (F.octet_length(w) >= least) & ~w.isin(*stop) if stop else F.octet_length(w) >= least)


#: Derivational endings, in the order in which they are tried.
ENDINGS = ("tion", "ness", "ment", "able", "ible", "less", "ful")


def _cut(w: Column, n: int) -> Column:
    return F.left(w, F.char_length(w) - n)


def _ends(w: Column, suffix: str, over: int = 0) -> Column:
    return F.endswith(w, F.lit(suffix)) & (F.octet_length(w) > over)


def _voiced(w: Column, n: int) -> Column:
    return F.when(_cut(w, n).rlike("[aeiou]"), _cut(w, n)).otherwise(w)


def _plural(w: Column) -> Column:
    ies = F.when(F.octet_length(w) > 4, _cut(w, 3)).otherwise(w)
    return F.when(_ends(w, "sses"), _cut(w, 2)).when(_ends(w, "ies"), ies).when(_ends(w, "s") & ~_ends(w, "ss"), _cut(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    eed = F.when(F.octet_length(w) > 4, _cut(w, 1)).otherwise(w)
    return F.when(_ends(w, "eed"), eed).when(_ends(w, "ed", 4), _voiced(w, 2)).when(_ends(w, "ing", 5), _voiced(w, 3)).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(_ends(w, "y", 2) & _cut(w, 1).rlike("[aeiou]"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _derived(w: Column) -> Column:
    out = w
    for e in reversed(ENDINGS):
        out = F.when(_ends(w, e, len(e) + 2), _cut(w, len(e))).otherwise(out)
    return out


#: The suffixes and the lengths (in bytes, as for the tokenisers) that they ask for are fixed values: they define the operator.
STAGES = (_plural, _past, _final_y, _derived)


def stems(words: Column) -> Column:
    """Suffix rules in four stages, each over the whole array, so that no stage repeats the expression before it."""
    for stage in STAGES:
        words = F.transform(words, stage)
    return words


def stem(word: Column) -> Column:
    return F.element_at(stems(F.array(word)), 1)


def stemming(text: Column, least: int = MIN_BYTES, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return stems(simple(text, least, stop))
