"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\r\x0B\f]+"


def text(value: Column) -> Column:
    """The string, empty in the place of null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def squeeze(value: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text(value), SPACES, " "))


def fold(value: Column) -> Column:
    """Lower case, with ß, ä, ö and ü spelt out."""
    folded = F.lower(text(value))
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return folded


@cache
def _plain_letters() -> tuple[str, str]:
    """All letters that are composed of a letter and marks, and that letter of each."""
    marked, plain = [], []
    for code in range(0xC0, 0x30000):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code) and unicodedata.category(base)[0] == "L":
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


def unaccented(value: Column) -> Column:
    """The text without diacritics."""
    return F.regexp_replace(F.translate(text(value), *_plain_letters()), r"\p{Mn}+", "")


def search_text(value: Column) -> Column:
    """Folded, with only letters, digits and hyphens, single-spaced."""
    return F.trim(F.regexp_replace(fold(value), r"[^\p{L}\p{N}-]+", " "))


def index_text(value: Column) -> Column:
    """The squeezed text followed by its folded form where that differs from lower case."""
    plain = squeeze(value)
    return F.when(fold(plain) != F.lower(plain), F.concat_ws(" ", plain, fold(plain))).otherwise(plain)


#: Words that don't count when titles are matched.
MATCH_STOPWORDS = ("der", "die", "das", "und", "von", "für", "fuer", "im", "in", "am", "an", "zu", "zur", "zum")


def match_text(value: Column) -> Column:
    """For title matching: no file numbers, money, digits, punctuation, stopwords or words of up to two characters."""
    plain = F.lower(text(value))
    plain = F.regexp_replace(plain, r"(^|[^\p{L}\p{N}])[a-zäöüß]{0,5}[0-9]+[a-z]?[-_/]?[0-9]+([-_/][0-9]+)*", " ")
    plain = F.regexp_replace(plain, r"€|[0-9]+[.,]?[0-9]*", " ")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " ")
    words = F.filter(F.split(F.trim(plain), " +"), lambda w: (F.length(w) > 2) & ~w.isin(*MATCH_STOPWORDS, "euro"))
    return F.array_join(words, " ")


def identity_title(value: Column) -> Column:
    """For equality of titles: no item prefix, brackets or punctuation."""
    plain = F.lower(squeeze(value))
    plain = F.regexp_replace(plain, r"^(stk\.? *[0-9]+\) *|to *[0-9]+ *: *|[0-9]+[.)] *)", "")
    plain = F.regexp_replace(plain, r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def street_name(value: Column) -> Column:
    """Lower-cased and squeezed, strasse spelt straße."""
    plain = F.lower(squeeze(F.replace(text(value), F.lit(" "), F.lit(" "))))
    return F.replace(plain, F.lit("strasse"), F.lit("straße"))


def clip_words(value: Column, most: int, end: str = ".") -> Column:
    """Squeezed; if longer than most, cut at the last space within it."""

    def clipped(plain: Column) -> Column:
        cut = F.substring(plain, 1, most)
        at_space = F.regexp_replace(F.regexp_extract(cut, r"^(.*) [^ ]*$", 1), r"[ ,;:]+$", "")
        return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.when(at_space != "", at_space).otherwise(cut), F.lit(end)))

    # Where a beginning is longer than most already, what follows changes nothing.
    first = squeeze(F.substring(text(value), 1, 4 * most))
    return F.when(F.length(first) > most, clipped(first)).otherwise(clipped(squeeze(value)))


def clip(value: Column, most: int) -> Column:
    """Squeezed; if longer than most, cut there and ended by an ellipsis."""
    plain = squeeze(value)
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…")))


def slug(value: Column, most: int = 80) -> Column:
    plain = F.regexp_replace(F.lower(text(value)), "[^a-z0-9äöüß]+", "-")
    plain = F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, most)
    return F.when(plain == "", "topic").otherwise(plain)


def first_distinct(values: Column) -> Column:
    """Array without later values that equal an earlier one but for case."""
    seen = F.aggregate(
        values,
        F.array().cast("array<string>"),
        lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.concat(out, F.array(x))),
    )
    return seen


def sentences(value: Column) -> Column:
    """Sentences of more than 15 characters."""
    parts = F.split(squeeze(value), r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])")
    return F.filter(parts, lambda s: F.length(s) > 15)


def first_sentences(value: Column, n: int, most: int) -> Column:
    return clip_words(F.array_join(F.slice(sentences(value), 1, n), " "), most)


#: Endings that a query word may drop, in order.
SUFFIXES = ("innen", "enden", "eren", "erer", "er", "en", "em", "es", "e")
#: Words that no query asks for.
QUERY_STOPWORDS = (
    "also alles antrag anträge antraege bitte beschluss beschlüsse beschluesse betrifft bis dass dazu das den der die eine einen einer finde frage "
    "fragen gibt haben nach oder über ueber und was welche welcher welchen wer wie wurde wurden zum zur"
).split()


def query_tokens(value: Column) -> Column:
    """Distinct folded words of a query in order, hyphenated ones also in parts; three characters at least, no stopwords."""
    raw = F.transform(F.regexp_extract_all(fold(value), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)), lambda t: F.regexp_replace(t, "^[-_]+|[-_]+$", ""))
    parts = F.transform(raw, lambda t: F.when(F.contains(t, F.lit("-")), F.concat(F.array(t), F.filter(F.split(t, "-"), lambda p: p != ""))).otherwise(F.array(t)))
    return F.array_distinct(F.filter(F.flatten(parts), lambda t: (F.length(t) >= 3) & ~t.isin(*QUERY_STOPWORDS)))


def alternatives(token: Column) -> Column:
    """The token and, if five characters remain, its stem without the first fitting suffix."""
    stem = reduce(
        lambda rest, suffix: F.when(F.endswith(token, F.lit(suffix)) & (F.length(token) - len(suffix) >= 5), F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(rest),
        reversed(SUFFIXES),
        F.lit(None).cast("string"),
    )
    return F.array_compact(F.array(token, stem))


def holds(haystack: Column, token: Column) -> Column:
    """Whether the token or its stem is a substring."""
    return F.exists(alternatives(token), lambda a: F.contains(haystack, a))
