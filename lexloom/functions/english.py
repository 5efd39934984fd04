"""A small English morphology: a table of lemmas and, beyond it, suffix rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import bound, collapse_repeats, collapse_trailing_repeats

BUILT_IN = {w: lemma for lemma, ws in {
    "library": ("libraries",), "recursion": ("recursive", "recursively", "recursing", "recurses", "recursed"), "authentication": ("authenticating", "authenticated"),
    "authorization": ("authorizing", "authorized", "authorizes"), "shard": ("sharding", "shards"), "compute": ("computing",), "learn": ("learning", "learnings"),
    "interceptor": ("intercepting", "intercepted", "intercept"),
}.items() for w in ws}


def strip_suffix(t: str) -> str:
    n = len(t)
    if n <= 3:
        return t
    if t.endswith("ies") and n > 4:
        return t[:-3] + "y"
    if t.endswith("ing") and n > 5:
        return t[:-3] + ("e" if t[:-3].endswith("at") else "")
    for end, least in (("ed", 4), ("ion", 5)):
        if t.endswith(end) and n > least:
            return t[: -len(end)]
    return t[:-1] if t.endswith("s") and not t.endswith("ss") else t


def suffix_stripped(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    ing = F.when(F.endswith(cut(3), F.lit("at")), F.concat(cut(3), F.lit("e"))).otherwise(cut(3))
    return (
        F.when(n <= 3, t)
        .when(F.endswith(t, F.lit("ies")) & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(F.endswith(t, F.lit("ing")) & (n > 5), ing)
        .when(F.endswith(t, F.lit("ed")) & (n > 4), cut(2))
        .when(F.endswith(t, F.lit("ion")) & (n > 5), cut(3))
        .when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")), cut(1))
        .otherwise(t)
    )


class English:
    """Morphology with a site's own lemmas; the built-in table wins over them."""

    def __init__(self, lemmas: Mapping[str, str] | None = None) -> None:
        self.table = {**(lemmas or {}), **BUILT_IN}

    def canonical_lemma(self, token: str) -> str | None:
        """The table's lemma of a token, of its form without repeats, or of its stem; None without one."""
        t = token.lower()
        collapsed = collapse_trailing_repeats(t)
        return self.table.get(t) or self.table.get(collapsed) or self.table.get(strip_suffix(collapsed))

    def lemma(self, token: str) -> str:
        t = token.lower()
        return self.canonical_lemma(t) or strip_suffix(collapse_trailing_repeats(t))

    def _table(self) -> Column:
        return F.create_map(*[F.lit(x) for pair in self.table.items() for x in pair])

    def _columns(self, token: Column, last) -> Column:
        """The table's lemma of the token, else of its form without repeats, else of its stem, else last(stem)."""
        table = self._table()
        of = lambda x: F.try_element_at(table, x)
        return bound(token, lambda t: bound(collapse_repeats(t), lambda c: bound(suffix_stripped(c), lambda s: F.coalesce(of(t), of(c), of(s), last(s)))))

    def canonical_column(self, token: Column) -> Column:
        return self._columns(token, lambda s: F.lit(None).cast("string"))

    def lemma_column(self, token: Column) -> Column:
        return self._columns(token, lambda s: s)
