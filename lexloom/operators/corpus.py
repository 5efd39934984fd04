"""Corpus compiler: acronyms, synonyms and vocabulary mined from documents, and the life of what is mined under review."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.durable import written
from lexloom.operators.counting import frequencies, plain_words, present, unique

FUNCTION_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "vs", "via", "was", "what", "when", "which", "with")
SMALL_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
LITERALS = ("grpc", "oauth", "webgl", "webgpu", "openid")
#: Pairs that are related, not synonyms.
UNLIKE = (
    ("tls", "vpn"), ("tls", "encryption"), ("authentication", "authorization"), ("auth", "authorization"), ("authn", "authz"), ("iot", "io"), ("tcp", "udp"), ("container", "kubernetes"), ("docker", "kubernetes"),
)
NOISE = "^(https?|www|html|href|class|span|div|src)$"


def clean_text(text: Column) -> Column:
    """A text without tags, Markdown links, addresses and entities, white space collapsed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"https?://\S+", " ")
    t = F.regexp_replace(t, "&[a-zA-Z0-9#]+;", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "['`\"]", "")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: t != "")


def acronym_key(surface: Column) -> Column:
    """Lower case without marks; a plural s after capitals goes."""
    key = F.regexp_replace(F.lower(surface), "[^a-z0-9]", "")
    return F.when(surface.rlike("^[A-Z]{2,5}s$"), F.substring(key, F.lit(1), F.length(key) - 1)).otherwise(key)


def plausible_key(key: Column) -> Column:
    return F.length(key).between(2, 12) & key.rlike("[a-z]") & ~key.isin(*FUNCTION_WORDS)


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def initials_match(key: Column, tokens: Column) -> Column:
    """The key spells the first letters of the words, or of those that aren't small."""
    return (initials(tokens) == key) | (initials(F.filter(tokens, lambda t: ~t.isin(*SMALL_WORDS))) == key)


def protected_literal(term: Column) -> Column:
    """Names that look like misspellings: a letter and a digit, perhaps a letter after it, and a few more."""
    return term.rlike("^[a-z][0-9][a-z]?$") | term.isin(*LITERALS)


def trimmed_phrase(tokens: Column) -> Column:
    """The words without function words at either end."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(~t.isin(*FUNCTION_WORDS), i)), lambda i: i.isNotNull())
    first, last = F.array_min(at), F.array_max(at)
    return F.when(F.size(at) > 0, F.slice(tokens, first + 1, last - first + 1)).otherwise(F.array().cast("array<string>"))


_PHRASE = r"[A-Za-z][A-Za-z0-9'/-]*(?:\s+[A-Za-z][A-Za-z0-9'/-]*){1,7}"
_ACRONYM = r"[A-Z][A-Za-z0-9]{1,9}"
_RULES = (
    ("phrase-then-acronym", rf"({_PHRASE})\s*\(\s*({_ACRONYM})\s*\)", 2, 1),
    ("acronym-then-phrase", rf"(?<![A-Za-z0-9_])({_ACRONYM})\s*\(\s*({_PHRASE})\s*\)", 1, 2),
    ("stands-for", rf"(?<![A-Za-z0-9_])({_ACRONYM})\s+(?:stands for|is short for|is an abbreviation (?:of|for))\s+({_PHRASE})", 1, 2),
    ("dash", rf"(?<![A-Za-z0-9_])({_ACRONYM})\s+[–—-]\s+({_PHRASE})", 1, 2),
)

#: What a text must have where a rule holds; it is sought in far fewer steps than the rule.
_SIGNS = {
    "phrase-then-acronym": rf"\(\s*{_ACRONYM}\s*\)", "acronym-then-phrase": rf"{_ACRONYM}\s*\(", "stands-for": "(?:stands|is short) for|is an abbreviation (?:of|for)", "dash": r"\s[–—-]\s",
}


def cleaned(docs: DataFrame) -> DataFrame:
    """(id, title, body) with clean texts."""
    return docs.select("id", clean_text(F.col("title")).alias("title"), clean_text(F.col("body")).alias("body"))


def _phrases_before(docs: DataFrame) -> DataFrame:
    """(id, field, rule, surface, said): matches of the first rule in clean texts. It is tried only on the nine words before each
    acronym in parentheses, as its phrase has eight at most, not from every letter of a text."""
    rule, pattern, key_at, phrase_at = _RULES[0]
    sign = _SIGNS[rule]

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, closing = re.compile(pattern, re.ASCII), re.compile(sign, re.ASCII)
        for frame in frames:
            rows = []
            for field in ("title", "body"):
                for at, text in zip(frame["id"], frame[field]):
                    last = 0
                    for m in closing.finditer(text):
                        begin = m.start()
                        for _ in range(10):
                            begin = text.rfind(" ", last, begin)
                            if begin < 0:
                                break
                        if hit := whole.search(text[max(begin, last) : m.end()]):
                            rows.append((at, field, rule, hit[key_at], hit[phrase_at]))
                            last = m.end()
            if rows:
                yield pd.DataFrame(rows, columns=["id", "field", "rule", "surface", "said"])

    kind = dict(docs.dtypes)["id"]
    return docs.where(F.col("title").rlike(sign) | F.col("body").rlike(sign)).mapInPandas(found, f"id {kind}, field string, rule string, surface string, said string")


def explicit_definitions(docs: DataFrame, clean: bool = False) -> DataFrame:
    """(key, phrase, id, field, rule, n): where a title or body says what an acronym stands for and the initials agree."""

    def matches(field: str, rule: str, pattern: str, key_at: int, phrase_at: int) -> Column:
        text, zipped = F.col(field), lambda k, p: F.arrays_zip(k.alias("surface"), p.alias("said"))
        pairs = zipped(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(at)) for at in (key_at, phrase_at)])
        pairs = F.transform(pairs, lambda p: F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), p["surface"].alias("surface"), p["said"].alias("said")))
        return F.when(text.rlike(_SIGNS[rule]), pairs)

    docs = docs if clean else cleaned(docs)
    each = F.array(*[matches(field, *rule) for field in ("title", "body") for rule in _RULES[1:]])
    found = docs.select("id", F.explode(F.flatten(F.array_compact(each))).alias("p")).select("id", "p.field", "p.rule", "p.surface", "p.said").unionByName(_phrases_before(docs))
    rows = found.select("id", "field", "rule", "surface", acronym_key(F.col("surface")).alias("key"), words(F.col("said")).alias("said"))
    rows = rows.where(plausible_key(F.col("key")) & F.col("surface").rlike("[A-Z].*[A-Z]"))
    # Of the words beside an acronym the phrase is the shortest part next to it whose initials spell the key.
    n = F.size("said")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.when(F.col("rule") == "phrase-then-acronym", F.slice("said", F.greatest(n - k + 1, F.lit(1)), k)).otherwise(F.slice("said", F.lit(1), k)))
    fitting = F.get(F.filter(tails, lambda t: initials_match(F.col("key"), t)), F.lit(0))
    rows = rows.where(n >= 2).withColumn("words", trimmed_phrase(fitting)).where(F.size("words") >= 2)
    return rows.groupBy("key", F.array_join("words", " ").alias("phrase"), "id", "field", "rule").agg(F.count(F.lit(1)).alias("n"))


def acronym_surfaces(docs: DataFrame, clean: bool = False) -> DataFrame:
    """(id, key, in_title): what looks like an acronym in a document."""
    pattern = F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]{1,7}(?![A-Za-z0-9_])")
    surfaces = [F.transform(F.array_distinct(F.regexp_extract_all(F.col(field), pattern, F.lit(0))), lambda s: F.struct(s.alias("surface"), F.lit(field == "title").alias("in_title"))) for field in ("title", "body")]  # noqa: B023
    both = (docs if clean else cleaned(docs)).select("id", F.explode(F.concat(*surfaces)).alias("s")).select("id", "s.surface", "s.in_title")
    keys = both.where(F.col("surface").rlike("[A-Z].*[A-Z]")).select("id", acronym_key(F.col("surface")).alias("key"), "in_title").where(plausible_key(F.col("key")))
    return keys.groupBy("id", "key").agg(F.max("in_title").alias("in_title"))


def spelled_phrases(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(key, phrase): the phrases of two to six words, neither the first nor the last a function word, in a clean title or body whose
    initials, with or without small words, spell an acronym (id, key) of the same document."""
    keys = surfaces.where(F.length("key") <= 6).groupBy("id").agg(F.collect_set("key").alias("keys"))

    def spelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function, small = set(FUNCTION_WORDS), set(SMALL_WORDS)
        for frame in frames:
            hits = set()
            for title, body, keys in zip(frame["title"], frame["body"], frame["keys"]):
                for ws in (plain_words(title), plain_words(body)):
                    for at in (range(len(ws)), [i for i, w in enumerate(ws) if w not in small]):
                        first = "".join([ws[i][0] for i in at])
                        for key in keys:
                            j = first.find(key)
                            while j >= 0:
                                begin, end = at[j], at[j + len(key) - 1]
                                if 1 <= end - begin <= 5 and ws[begin] not in function and ws[end] not in function:
                                    hits.add((key, " ".join(ws[begin : end + 1])))
                                j = first.find(key, j + 1)
            if hits:
                yield pd.DataFrame({"key": [k for k, _ in hits], "phrase": [p for _, p in hits]})

    return docs.join(keys, "id").select("title", "body", "keys").mapInPandas(spelled, "key string, phrase string").distinct()


def evidence(candidates: DataFrame, has_key: DataFrame, has_phrase: DataFrame, explicit: DataFrame) -> DataFrame:
    """Counters of each candidate (key, phrase) over all documents: where key (id, key, title_key) and phrase (id, phrase,
    title_phrase) stand, apart and together."""
    k = candidates.join(has_key, "key").select("key", "phrase", "id", "title_key")
    p = candidates.join(has_phrase, "phrase").select("key", "phrase", "id", "title_phrase")
    each = k.join(p, ["key", "phrase", "id"], "full")
    hk, tk, hp, tp = F.col("title_key").isNotNull(), F.coalesce("title_key", F.lit(False)), F.col("title_phrase").isNotNull(), F.coalesce("title_phrase", F.lit(False))
    counts = each.groupBy("key", "phrase").agg(
        F.count_if(hk).alias("key_df"), F.count_if(tk).alias("title_key_df"), F.count_if(hp).alias("phrase_df"), F.count_if(tk & hp).alias("title_cooc"),
        F.count_if(tk & hp & ~tp).alias("title_key_body_phrase"), F.count_if(hk & hp & ~tk).alias("body_cooc"),
    )
    said = explicit.groupBy("key", "phrase").agg(F.count_distinct("id").alias("explicit_docs"), F.sum("n").alias("mentions"))
    out = candidates.join(counts, ["key", "phrase"], "left").join(said, ["key", "phrase"], "left").na.fill(0)
    return out.withColumn("supporting", F.col("explicit_docs") + F.col("title_cooc") + F.col("body_cooc"))


def classify(counted: DataFrame) -> DataFrame:
    """counted with ambiguous, decision (accepted, review, rejected) and reason."""
    c = F.col
    fits = initials_match(c("key"), F.split("phrase", " "))
    df = counted.withColumn("fits", fits).withColumn("ambiguous", F.sum(F.when(c("fits") & (c("explicit_docs") >= 1), 1).otherwise(0)).over(Window.partitionBy("key")) >= 2)
    said, clear = c("explicit_docs") >= 1, ~c("ambiguous")
    short = (F.length("key") <= 3) & ~((c("title_cooc") >= 2) | (c("supporting") >= 3) | (c("title_key_df") >= 1) & (c("phrase_df") >= 2))
    ladder = (
        ("rejected", "initials-mismatch", ~c("fits")),
        ("accepted", "repeated-explicit-definition", said & clear & (c("explicit_docs") >= 2)),
        ("accepted", "explicit-definition-with-title-or-repeat", said & clear & ((c("title_cooc") >= 1) | (c("mentions") >= 2) | (c("title_key_df") >= 1))),
        ("review", "single-explicit-definition", said & clear),
        ("review", "ambiguous-explicit-definition", said),
        ("rejected", "short-token-weak-evidence", (c("title_cooc") >= 1) & short),
        ("review", "title-backed-cooccurrence", c("title_cooc") >= 1),
        ("review", "title-key-with-body-phrase", (c("title_key_df") >= 1) & (c("body_cooc") >= 1)),
        ("review", "repeated-body-cooccurrence", c("body_cooc") >= 2),
    )
    verdict = F.struct(F.lit("rejected").alias("decision"), F.lit("initialism-coincidence").alias("reason"))
    for decision, reason, test in reversed(ladder):
        verdict = F.when(test, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))).otherwise(verdict)
    return df.withColumn("v", verdict).select("*", "v.decision", "v.reason").drop("v", "fits")


def equivalence_id(key: Column, phrase: Column) -> Column:
    return F.concat(F.lit("eq:"), key, F.lit(":"), F.replace(phrase, F.lit(" "), F.lit("-")))


def mine_equivalences(docs: DataFrame) -> DataFrame:
    """All acronym candidates of a corpus, counted, judged and with stable ids."""
    docs = written(cleaned(docs), "clean")
    said, surfaces = written(explicit_definitions(docs, True), "explicit"), written(acronym_surfaces(docs, True), "surfaces")
    spelled = written(spelled_phrases(docs, surfaces), "spelled")
    sought = written(spelled.select("phrase").unionByName(said.select("phrase")).distinct(), "sought")
    has_phrase = written(present(docs, sought.withColumnRenamed("phrase", "gram"), 2, 6, FUNCTION_WORDS).withColumnsRenamed({"gram": "phrase", "in_title": "title_phrase"}), "phrases")
    # A phrase beside its acronym counts if it is in a title or in two documents.
    known = has_phrase.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"), F.max("title_phrase").alias("titled")).where((F.col("df") >= 2) | F.col("titled")).select("phrase")
    candidates = written(spelled.join(known, "phrase", "left_semi").select("key", "phrase").unionByName(said.select("key", "phrase")).distinct(), "candidates")
    keys = candidates.select("key").distinct()
    as_words = present(docs, keys.select(F.col("key").alias("gram")), 1, 1).select("id", F.col("gram").alias("key"), F.col("in_title").alias("t"))
    has_key = as_words.unionByName(surfaces.select("id", "key", F.col("in_title").alias("t")).join(keys, "key", "left_semi")).groupBy("id", "key").agg(F.max("t").alias("title_key"))
    return classify(evidence(candidates, has_key, has_phrase, said)).withColumn("id", equivalence_id(F.col("key"), F.col("phrase")))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, tf, df, title_df) of the corpus's words."""
    if unique(docs):
        rows = frequencies(cleaned(docs), plain_words, ("title", "either"))
        of = lambda field, count: F.sum(F.when(F.col("field") == field, F.col(count)).otherwise(0))
        return rows.groupBy("term").agg(of("either", "tf").alias("tf"), of("either", "df").alias("df"), of("title", "df").alias("title_df"))
    tokens = docs.select("id", F.explode(F.concat(F.transform(words(clean_text(F.col("title"))), lambda t: F.struct(t.alias("term"), F.lit(1).alias("t"))), F.transform(words(clean_text(F.col("body"))), lambda t: F.struct(t.alias("term"), F.lit(0).alias("t"))))).alias("k")).select("id", "k.term", "k.t")
    per_doc = tokens.groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"), F.sum("t").alias("title_df"))


def mine_vocabulary(docs: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """(term, tf, df, title_df, kind, spelling): the corpus's words; those in one document only that nothing vouches for are
    left out. concepts has the words (term) of accepted equivalences."""
    counts = term_counts(docs).where((F.length("term") <= 32) & ~F.col("term").rlike(NOISE))
    configured = F.lit(False)
    if concepts is not None:
        counts = counts.join(concepts.select("term", F.lit(True).alias("configured")).distinct(), "term", "left")
        configured = F.coalesce("configured", F.lit(False))
    c = F.col
    literal = protected_literal(c("term"))
    vouched = literal | configured | (c("title_df") >= 1)
    content = (c("df") >= 2) & ~c("term").isin(*FUNCTION_WORDS)
    domain = vouched | (content & (F.length("term") >= 4))
    spelling = vouched | (content & (F.length("term") >= 5) & ~c("term").rlike("[0-9]{4}"))
    kind = F.when(literal, "literal").when(configured, "concept").when(c("title_df") >= 1, "title").when(domain, "domain").otherwise("general")
    return counts.withColumn("kind", kind).withColumn("spelling", spelling).where(domain | c("spelling") | (c("df") >= 2)).select("term", "tf", "df", "title_df", "kind", "spelling")


def is_inflection(a: Column, b: Column) -> Column:
    """Whether two words differ by an inflection only."""
    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    rest = F.when(F.startswith(long, short), F.substring(long, F.length(short) + 1, F.length(long))).otherwise("")
    without_last = F.substring(short, F.lit(1), F.length(short) - 1)
    stem = lambda x: F.regexp_replace(F.regexp_replace(x, "(ing|ed|es|ers|er|ly)$", ""), "s$", "")
    return (
        rest.rlike("^(s|es|ed|ing|izing|er|ers|ly|ally|d|ling)$") | (F.endswith(short, F.lit("e")) & (long == F.concat(without_last, F.lit("ing"))))
        | (F.endswith(short, F.lit("y")) & (long == F.concat(without_last, F.lit("ies")))) | ((stem(a) == stem(b)) & (F.length(stem(a)) >= 5) & (a != b))
    )


def blocked(a: Column, b: Column) -> Column:
    pair = F.concat_ws(" ", F.least(a, b), F.greatest(a, b))
    return pair.isin(*(" ".join(sorted(x)) for x in UNLIKE))


def alias_pairs(counts: DataFrame, least_df: int = 3) -> DataFrame:
    """(short, long): words (term, df, title_df) of which one is the other cut short, both common, one of them in a title;
    joined on the first four letters, not all with all."""
    v = written(counts.where((F.col("df") >= least_df) & ~F.col("term").isin(*FUNCTION_WORDS)).select("term", "title_df"), "terms")
    block = F.substring("term", 1, 4).alias("block")
    short = v.where(F.length("term").between(4, 8)).select(F.col("term").alias("short"), F.col("title_df").alias("short_titles"), block)
    long = v.where(F.col("term").rlike("(ation|ization|isation|ative|ence|ency|ance|ous|ual|ment)$")).select(F.col("term").alias("long"), F.col("title_df").alias("long_titles"), block)
    pairs = short.join(long, "block").where(F.startswith("long", F.col("short")) & (F.length("long") >= F.length("short") + 4))
    one, other = F.col("short"), F.col("long")
    return pairs.where("short_titles >= 1 or long_titles >= 1").where(~is_inflection(one, other) & ~blocked(one, other)).select("short", "long")


def explicit_aliases(docs: DataFrame) -> DataFrame:
    """(left, right, docs): 'x aka y' and 'x, also known as y'."""
    pattern = F.lit(r"([A-Za-z][A-Za-z0-9-]{2,30})(?:,)?\s+(?:aka|a\.k\.a\.|also known as|also called)\s+([A-Za-z][A-Za-z0-9-]{2,30})")
    text = clean_text(F.concat_ws(" ", "title", "body"))
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("l"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("r"))
    rows = docs.select("id", F.explode(pairs).alias("p")).select("id", F.lower("p.l").alias("l"), F.lower("p.r").alias("r")).where("l <> r")
    return rows.groupBy(F.least("l", "r").alias("left"), F.greatest("l", "r").alias("right")).agg(F.count_distinct("id").alias("docs"))


def synonym_id(terms: Column) -> Column:
    return F.concat(F.lit("syn:"), F.array_join(F.array_sort(terms), "|"))


def mine_synonyms(docs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(id, terms, miner): explicit aliases first, then short forms; one row of each id, the first miner's."""
    said = explicit_aliases(docs).select(F.array("left", "right").alias("terms"), F.lit("explicit-alias").alias("miner"), F.lit(0).alias("o"))
    cut = alias_pairs(term_counts(docs) if counts is None else counts).select(F.array("short", "long").alias("terms"), F.lit("short-form").alias("miner"), F.lit(1).alias("o"))
    rows = said.unionByName(cut).withColumn("id", synonym_id(F.col("terms")))
    return rows.groupBy("id").agg(F.min_by(F.struct(F.array_sort("terms").alias("terms"), "miner"), "o").alias("r")).select("id", "r.terms", "r.miner")


LIFECYCLE = ("HUMAN_ACCEPTED", "HUMAN_REJECTED", "CONFLICT", "AUTO_ACCEPTED", "REVIEW_PENDING", "COMPILER_REJECTED", "ORPHANED_DECISION")


def apply_lifecycle(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates (id, key, decision) joined with human decisions (id, key, verdict), by a full outer join.

    A human verdict stands; an automatic acceptance whose key a human gave to another candidate is a conflict; a
    decision without a candidate is an orphan.
    """
    d = decisions.select("id", F.col("key").alias("decided_key"), "verdict")
    taken = decisions.where("verdict = 'accept'").groupBy("key").agg(F.first("id").alias("taken_by"))
    rows = candidates.join(d, "id", "full").join(taken, "key", "left")
    c = F.col
    state = (
        F.when(c("decision").isNull() & (c("verdict") == "accept"), "HUMAN_ACCEPTED")
        .when(c("decision").isNull(), "ORPHANED_DECISION")
        .when(c("verdict") == "accept", "HUMAN_ACCEPTED")
        .when(c("verdict") == "reject", "HUMAN_REJECTED")
        .when((c("decision") == "accepted") & c("taken_by").isNotNull() & (c("taken_by") != c("id")), "CONFLICT")
        .when(c("decision") == "accepted", "AUTO_ACCEPTED")
        .when(c("decision") == "review", "REVIEW_PENDING")
        .otherwise("COMPILER_REJECTED")
    )
    return rows.withColumn("state", state).withColumn("key", F.coalesce("key", "decided_key")).drop("decided_key")


def trusted(rows: DataFrame) -> DataFrame:
    """What is in use: accepted automatically or by a person; of each key the best-supported, then the least id."""
    order = Window.partitionBy("key").orderBy(F.when(F.col("state") == "HUMAN_ACCEPTED", 0).otherwise(1), F.desc("supporting"), "id")
    return rows.where(F.col("state").isin("HUMAN_ACCEPTED", "AUTO_ACCEPTED")).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def review_queue(rows: DataFrame) -> DataFrame:
    """Pending candidates with family, score, band and canonical (the first of its family), most urgent first."""
    c = F.col
    points = {
        40: c("explicit_docs") >= 1, 15: initials_match(c("key"), F.split("phrase", " ")), 12: c("phrase_df") >= 2, 8: c("supporting") >= 2,
        -20: c("ambiguous"), -8: (F.length("key") <= 2) & (c("explicit_docs") == 0),
    }
    total = F.when((c("title_cooc") >= 1) & (c("body_cooc") >= 1), 25).when(c("title_key_body_phrase") >= 1, 22).when(c("title_cooc") >= 1, 10).otherwise(0)
    for n, test in points.items():
        total = total + F.when(test, n).otherwise(0)
    spelled = initials_match(c("key"), F.split("phrase", " "))
    band = (
        F.when(spelled & ((c("explicit_docs") >= 1) | (c("title_key_body_phrase") >= 1)), "HIGH")
        .when(spelled & (c("title_cooc") >= 1) & (c("phrase_df") >= 2), "MEDIUM")
        .when(c("score") >= 35, "HIGH").when(c("score") >= 15, "MEDIUM").otherwise("LOW")
    )
    rank = F.when(c("band") == "HIGH", 0).when(c("band") == "MEDIUM", 1).otherwise(2)
    content = F.filter(F.split("phrase", " "), lambda t: ~t.isin(*FUNCTION_WORDS))
    singular = F.transform(content, lambda t: F.when((F.length(t) > 3) & t.rlike("[^s]s$"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    signature = F.when(F.size(singular) > 0, F.array_join(singular, "-")).otherwise(F.replace(c("phrase"), F.lit(" "), F.lit("-")))
    pending = rows.where("state = 'REVIEW_PENDING'").withColumn("family", F.concat(F.lit("equivalence-family:"), c("key"), F.lit(":"), signature)).withColumn("score", total).withColumn("band", band)
    return pending.withColumn("urgency", rank).withColumn("canonical", F.row_number().over(Window.partitionBy("family").orderBy("urgency", F.desc("score"), "id")) == 1)


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.groupBy("band").agg(F.count(F.lit(1)).alias("pending"), F.count_distinct("family").alias("families"), F.count_if("canonical").alias("canonical"))


def inspection_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """(id, state_now, state_before, material, review, conflict, moved, orphaned): two snapshots of candidates compared by id.

    A snapshot has id, state, band, explicit_docs, titles, competing, gained and decided. A change is material where the state
    or band differs, or where the candidate now is defined, stands in a title, has competitors or has gained evidence after
    a rejection, and didn't before; counts that grow are not. review: new, open or null. moved: promoted or demoted, where both
    have a band. orphaned: gone, though a person had decided on it.
    """
    columns = ("state", "band", "explicit_docs", "titles", "competing", "gained", "decided")
    a = now.select("id", F.struct(*columns).alias("a"))
    b = before.select("id", F.struct(*columns).alias("b"))
    x, y = F.col("a"), F.col("b")
    both = x.isNotNull() & y.isNotNull()
    gains = lambda test: F.coalesce(test(x), F.lit(False)) & ~F.coalesce(test(y), F.lit(False))
    material = (
        ~x["state"].eqNullSafe(y["state"]) | ~x["band"].eqNullSafe(y["band"]) | gains(lambda s: s["explicit_docs"] >= 1) | gains(lambda s: s["titles"] >= 1)
        | gains(lambda s: s["competing"] | (s["state"] == "CONFLICT")) | gains(lambda s: s["gained"])
    )
    rank = lambda s: F.when(s["band"] == "HIGH", 0).when(s["band"] == "MEDIUM", 1).otherwise(2)
    pending = x["state"] == "REVIEW_PENDING"
    return a.join(b, "id", "full").select(
        "id", x["state"].alias("state_now"), y["state"].alias("state_before"), (both & material).alias("material"), F.when(pending & y.isNull(), "new").when(pending, "open").alias("review"),
        gains(lambda s: s["state"] == "CONFLICT").alias("conflict"), F.when(both & (rank(x) < rank(y)) & x["band"].isNotNull() & y["band"].isNotNull(), "promoted").when(both & (rank(x) > rank(y)) & x["band"].isNotNull() & y["band"].isNotNull(), "demoted").alias("moved"),
        (x.isNull() & F.coalesce(y["decided"], F.lit(False))).alias("orphaned"),
    )
