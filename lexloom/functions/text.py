"""Tokens and string rules, each as a Column expression and, where query analysis needs it, as a Python function."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = ("what", "whats", "is", "an", "the", "of", "with", "are", "which", "for", "a", "and", "in", "to", "as", "vs")
STOP = frozenset(STOP_WORDS)
_QUOTES = re.compile("['`\"]")
_PARTS = re.compile("[^a-z0-9*]+")
_TAIL = re.compile(r"(.)\1{2,}$")
_LEET = str.maketrans("013457", "oieast")


def stop_array() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def is_stop(c: Column) -> Column:
    return c.isin(*STOP_WORDS)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of a text; quotes vanish, all else but letters, digits and * parts words."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "['`\"]", "")
    return F.filter(F.split(plain, "[^a-z0-9*]+"), lambda t: t != "")


def tokenize(text: object) -> list[str]:
    return [t for t in _PARTS.split(_QUOTES.sub("", str(text or "").lower())) if t]


def normalize_surface(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def spaced(words: Column) -> Column:
    """' a b c ': a word sequence that can be searched for contiguous parts."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def has_sequence(field: Column, needle: Column) -> Column:
    return F.contains(field, spaced(needle))


def collapse_repeats(token: Column) -> Column:
    return F.when(F.length(token) < 4, token).otherwise(F.regexp_replace(token, r"(.)\1{2,}$", "$1"))


def collapse_trailing_repeats(token: str) -> str:
    return token if len(token) < 4 else _TAIL.sub(r"\1", token)


def all_digits(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def is_digits(token: str) -> bool:
    return token.isascii() and token.isdigit()


def near_complete_prefix(prefix: Column, token: Column) -> Column:
    long = (F.length(prefix) >= 6) & (F.length(prefix) / F.length(token) >= 0.55)
    return (F.length(prefix) > 0) & F.startswith(token, prefix) & ((prefix == token) | long)


def allow_prefix(query: Column, token: Column) -> Column:
    part = F.startswith(token, query) & ((F.length(query) >= 4) | ((F.length(query) >= 3) & (F.length(query) / F.length(token) >= 0.55)))
    return (F.length(query) > 0) & (F.length(token) > 0) & ((query == token) | (~all_digits(query) & ~all_digits(token) & part))


def allows_prefix(query: str, token: str) -> bool:
    if not query or not token:
        return False
    if query == token:
        return True
    if is_digits(query) or is_digits(token) or not token.startswith(query):
        return False
    return len(query) >= 4 or len(query) >= 3 and len(query) / len(token) >= 0.55


def first_token(text: Column) -> Column:
    return F.coalesce(F.get(tokens(text), F.lit(0)), F.lit(""))


def levenshtein(a: str, b: str, most: int | None = None) -> int:
    """Edit distance; more than `most` where it exceeds it."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


def decode_leet(token: Column) -> Column:
    """The word behind digits that stand for letters; null where the token isn't of that kind."""
    decoded = F.translate(token, "013457", "oieast")
    return F.when((F.length(token) >= 6) & token.rlike("[0-9]") & ~all_digits(token) & (decoded != token), decoded)


def leet_decoded(token: str) -> str | None:
    if len(token) < 6 or not re.search(r"\d", token) or is_digits(token):
        return None
    decoded = token.translate(_LEET)
    return decoded if decoded != token else None


def saturating(count: Column) -> Column:
    x = F.log1p(F.greatest(F.coalesce(count.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return F.round(x / (1 + x), 4)


def ngrams(words: Column, least: int, most: int) -> Column:
    """Contiguous n-grams of a word array, by length; single words of one character are left out."""

    def of(w: Column, n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        grams = F.filter(grams, lambda g: F.length(g) >= 2) if n == 1 else grams
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    return bound(words, lambda w: F.concat(*[of(w, n) for n in range(least, most + 1)]))


def clamp01(x: Column) -> Column:
    value = x.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def canonical_id(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "^[\\s\\u00a0\\ufeff]+|[\\s\\u00a0\\ufeff]+$", "")
