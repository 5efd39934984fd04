"""Dotted numbers such as 1.2: spans, compact forms, and the title tokens that lie inside them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import all_digits

SPAN = r"[0-9]+(?:\.[0-9]+)+"
_SPAN = re.compile(SPAN)
MARK = "\ue000"


def spans_of(text: str) -> list[str]:
    return _SPAN.findall(text or "")


def dotted_spans(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPAN), F.lit(0))


def compact_forms(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.replace(s, F.lit("."), F.lit(""))))


def marked_tokens(text: Column) -> Column:
    """tokens() of a text in which every number of a dotted span ends with a mark."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['`\"]", "")
    marked = F.regexp_replace(plain, r"[0-9]+(?=\.[0-9])|(?<=[0-9]\.)[0-9]+", "$0" + MARK)
    return F.filter(F.split(marked, f"[^a-z0-9*{MARK}]+"), lambda t: F.replace(t, F.lit(MARK), F.lit("")) != "")


def in_span(marked: Column) -> Column:
    return marked.rlike(f"^[0-9]+{MARK}$")


def span_component(token: Column, spans: Column) -> Column:
    """True where an all-digit token is one of the numbers of a span."""
    return F.coalesce(all_digits(token) & F.exists(spans, lambda s: F.array_contains(F.split(s, "[.]"), token)), F.lit(False))
