"""Queries that run the rules of ranking over a table of candidates: classes, scores and every pair's decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import evidence, ranking, relationships

#: Candidates of a query.
SIZE = 20


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def candidates(spark, sf_dir) -> DataFrame:
    """One candidate of each part, SIZE a query, with features drawn from its number so that all cases meet."""
    k = F.col("k")
    over = lambda n: F.floor(k / n)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("k"))
    rows = rows.select(
        over(SIZE).cast("string").alias("query_id"), F.lpad(k.cast("string"), 12, "0").alias("id"), (k % 11 == 0).alias("exact_title"), (k % 3 == 0).alias("exact_token"), (k % 5 < 2).alias("typed_surface"),
        (k % 13 == 0).alias("canonical_key"), (k % 7 == 0).alias("short_lead"), (k % 17 == 0).alias("span_component"), F.when(k % 6 == 0, F.struct((k % 4 / 4).alias("quality"))).alias("contextual"),
        _pick((0.0, 0.5, 0.6667, 1.0), k).alias("query_coverage"), _pick((0.0, 0.8, 1.0), k).alias("title_coverage"), _pick((0.0, 0.3, 0.5, 0.9), over(3)).alias("prefix_quality"), (over(5) % 4).cast("double").alias("phrase_count"),
        (over(SIZE) % 3 + 1).cast("int").alias("query_token_count"), (k % 5 + 1).cast("int").alias("title_token_count"), _pick((None, "key-in-title", None, "expansion", None), over(2)).alias("equivalence"),
        _pick((None, "dotted", None, "compact-dotted", "compact-weak", None, "dotted-weak", None, None), over(7)).alias("version"), F.when(k % 8 == 0, "related").otherwise("direct").alias("relevance"), (k % 9 == 0).alias("morphology"),
        (over(11) % 4).cast("int").alias("typo"), _pick((0.0, 0.25, 0.75), over(4)).alias("body_lexical"), _pick((0.0, 0.5, 1.0), over(9)).alias("expansion_evidence"), _pick((0.0, 0.5, 1.0), over(13)).alias("adjacency"),
    )
    return rows.withColumn("contextual_quality", F.coalesce("contextual.quality", F.lit(0.0))).withColumn("direct_class", evidence.direct_class())


_CANDIDATES = """c AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part), f AS (SELECT k // 20 AS q, lpad(CAST(k AS VARCHAR), 12, '0') AS id, k % 11 = 0 AS exact, k % 3 = 0 AS token, k % 5 < 2 AS surface, k % 13 = 0 AS ckey, k % 7 = 0 AS lead, k % 17 = 0 AS span, k % 6 = 0 AS ctx,
CASE WHEN k % 6 = 0 THEN k % 4 / 4 ELSE 0 END AS ctxq, [0, 0.5, 0.6667, 1][k % 4 + 1]::DOUBLE AS cov, [0, 0.8, 1][k % 3 + 1]::DOUBLE AS tcov, [0, 0.3, 0.5, 0.9][k // 3 % 4 + 1]::DOUBLE AS pq, k // 5 % 4 AS phr, k // 20 % 3 + 1 AS qn, k % 5 + 1 AS tn,
[NULL, 'key-in-title', NULL, 'expansion', NULL][k // 2 % 5 + 1] AS eq, [NULL, 'dotted', NULL, 'compact-dotted', 'compact-weak', NULL, 'dotted-weak', NULL, NULL][k // 7 % 9 + 1] AS ver, k % 8 = 0 AS rel, k % 9 = 0 AS morph,
k // 11 % 4 AS typo, [0, 0.25, 0.75][k // 4 % 3 + 1]::DOUBLE AS body, [0, 0.5, 1][k // 9 % 3 + 1]::DOUBLE AS exp, [0, 0.5, 1][k // 13 % 3 + 1]::DOUBLE AS adj FROM c),
g AS (SELECT *, CASE WHEN ver IN ('dotted', 'compact-dotted') THEN 2 WHEN ver IN ('compact-weak', 'dotted-weak') THEN 1 ELSE 0 END AS vs,
CASE WHEN exact OR coalesce(eq = 'key-in-title', false) OR ckey OR (cov >= 0.999 AND pq >= 0.4) OR coalesce(ver IN ('compact-dotted', 'dotted'), false) THEN 'strong'
WHEN cov >= {two_thirds} OR pq >= 0.5 OR coalesce(eq = 'expansion', false) OR adj = 1 OR lead OR span OR (token AND cov > 0) OR (qn >= 2 AND phr >= 2) OR ctx THEN 'moderate'
WHEN token OR morph OR typo > 0 OR body > 0 OR cov > 0 OR pq > 0 OR eq IS NOT NULL THEN 'weak' ELSE 'none' END AS cls FROM f),
h AS (SELECT *, coalesce(eq = 'key-in-title', false) AS kit, cov >= 0.999 AS fullq, NOT rel AND cls IN ('weak', 'none') AS weakd,
(token OR pq > 0) AND cov < {two_thirds} AND phr = 0 AND NOT exact AND eq IS NULL AND NOT ctx AS incid, qn >= 2 AND (phr >= 2 OR eq IS NOT NULL) AS phrase FROM g),
x AS (SELECT *, NOT ctx AND NOT exact AND NOT kit AND NOT ckey AND vs < 2 AND NOT fullq AND cls NOT IN ('strong', 'moderate') AS below_ctx,
NOT phrase AND NOT exact AND NOT ckey AND NOT kit AND NOT fullq AND cls <> 'strong' AND NOT ctx AND (incid OR cls <> 'moderate') AS below_phr FROM h)"""


def direct_classes(spark, sf_dir):
    """The class of direct evidence of each candidate, whether it has direct evidence at all, and whether it may be expanded."""
    return candidates(spark, sf_dir).select("id", "direct_class", evidence.direct_evidence().alias("direct_evidence"), relationships.strong_primary().alias("strong_primary"))


def feature_scores(spark, sf_dir):
    """The weighted sum of each candidate's features; the phrase count stands for the strength of a relationship."""
    return candidates(spark, sf_dir).select("id", evidence.score(F.col("phrase_count") / 4, F.col("title_coverage") / 2).alias("score"))


def _decisions(spark, sf_dir, constraints):
    rows = ranking.pair_decisions(candidates(spark, sf_dir), constraints)
    applied = F.array_join(F.transform("applied", lambda s: F.concat(s["id"], F.when(s["sign"] < 0, "<").otherwise(">"))), " ")
    return rows.select("a_id", "b_id", F.col("order").cast("int").alias("winner"), "conflict", F.coalesce("decisive_class", F.lit("none")).alias("decisive"), "resolution", applied.alias("applied"))


def pair_decisions(spark, sf_dir):
    """Every two candidates of a query decided by the twelve constraints."""
    return _decisions(spark, sf_dir, ranking.DEFAULT)


def pair_decisions_hybrid(spark, sf_dir):
    """The same by the thirteen of the hybrid strategy."""
    return _decisions(spark, sf_dir, ranking.HYBRID)


def _sides(test: str) -> str:
    """-1 where test holds for a over b, 1 where for b over a; {a} and {b} stand for the two."""
    return f"CASE WHEN {test.format(a='a', b='b')} THEN -1 WHEN {test.format(a='b', b='a')} THEN 1 ELSE 0 END"


_DIRECT = [("direct-over-related", "absolute", _sides("NOT {a}.rel AND {b}.rel AND ({a}.exact OR {a}.kit OR {a}.ckey OR {a}.cov > 0 OR {a}.token)"))]
_HYBRID = [
    ("strong-moderate-direct-over-related", "absolute", _sides("{b}.rel AND NOT {a}.rel AND {a}.cls IN ('strong', 'moderate')")),
    ("related-over-weak-direct", "strong", _sides("{a}.rel AND {b}.weakd")),
]
_REST = [
    ("canonical-key-expansion-over-key-only", "strong", _sides("{a}.ckey AND NOT {b}.ckey")),
    ("repeated-phrase-over-weak-direct", "strong", _sides("{a}.phrase AND {b}.below_phr")),
    ("contextual-title-prefix-over-unaligned", "absolute", _sides("({a}.ctx AND NOT {b}.ctx AND {b}.below_ctx) OR ({a}.ctx AND {b}.ctx AND {a}.ctxq > {b}.ctxq)")),
    ("full-coverage-over-partial", "strong", _sides("{a}.fullq AND {a}.pq >= 0.5 AND {b}.cov > 0 AND {b}.cov < 2.0 / 3 AND NOT {b}.exact")),
    ("exact-surface-over-lemma-only", "strong", f"CASE WHEN a.qn <> 1 OR a.eq IS NOT NULL OR b.eq IS NOT NULL THEN 0 ELSE {_sides('{a}.surface AND NOT {b}.surface')} END"),
    ("version-companion-over-weak-numeric", "strong", _sides("{a}.vs >= 2 AND {b}.vs <= 1")),
    ("literal-numeric-over-weak-compact", "strong", _sides("{a}.token AND {a}.vs = 0 AND {b}.vs = 1")),
    ("dotted-span-component-over-weak-direct", "strong", _sides("{a}.span AND NOT {b}.span AND {b}.weakd")),
    ("tighter-title-over-longer-contains", "soft", _sides("({a}.fullq AND {a}.tcov >= 0.8) AND CASE WHEN {b}.fullq AND {b}.tcov >= 0.8 THEN {a}.tn < {b}.tn ELSE true END")),
    ("short-literal-lead-over-later", "soft", _sides("{a}.lead AND NOT {b}.lead")),
]
_FIRST = [("exact-title-over-non-exact", "absolute", _sides("{a}.exact AND NOT {b}.exact"))]
_TWO_THIRDS = "2.0 / 3"


def _decisions_sql(rules) -> str:
    listed = ", ".join(f"{{'id': '{i}', 'class': '{c}', 'sign': {s}}}" for i, c, s in rules)
    of = lambda c: f"list_filter(applied, lambda s: s.class = '{c}')"
    return f"""
WITH {_CANDIDATES}, p AS (SELECT a.id AS a_id, b.id AS b_id, list_filter([{listed}], lambda s: s.sign <> 0) AS applied FROM x a JOIN x b ON a.q = b.q AND a.id < b.id),
d AS (SELECT *, CASE WHEN len({of('absolute')}) > 0 THEN 'absolute' WHEN len({of('strong')}) > 0 THEN 'strong' WHEN len({of('soft')}) > 0 THEN 'soft' ELSE 'none' END AS decisive FROM p),
e AS (SELECT *, list_transform(list_filter(applied, lambda s: s.class = decisive), lambda s: s.sign) AS own FROM d),
r AS (SELECT *, decisive <> 'none' AND list_min(own) <> list_max(own) AS same, CASE WHEN decisive = 'none' OR list_min(own) <> list_max(own) THEN 0 ELSE own[1] END AS winner FROM e),
t AS (SELECT *, coalesce(same, false) OR (winner <> 0 AND len(list_filter(applied, lambda s: s.class <> decisive AND s.sign <> winner)) > 0) AS conflict FROM r)
SELECT a_id, b_id, CAST(winner AS INTEGER) AS winner, conflict, decisive, CASE WHEN decisive = 'none' THEN 'unordered' WHEN same THEN 'unordered-same-class-conflict' WHEN conflict THEN 'stronger-class-wins' ELSE 'constraint' END AS resolution,
array_to_string(list_transform(applied, lambda s: s.id || CASE WHEN s.sign < 0 THEN '<' ELSE '>' END), ' ') AS applied FROM t""".replace("{two_thirds}", _TWO_THIRDS)


SQL_direct_classes = f"""WITH {_CANDIDATES} SELECT id, cls AS direct_class, exact OR token OR cov > 0 OR eq IS NOT NULL OR morph OR ver IS NOT NULL OR span OR pq > 0 OR ckey OR ctx AS direct_evidence,
cls = 'strong' OR exact OR kit OR (fullq AND pq >= 0.4) OR vs = 2 OR ckey AS strong_primary FROM x""".replace("{two_thirds}", _TWO_THIRDS)
SQL_feature_scores = f"""WITH {_CANDIDATES} SELECT id, round(exact::INT * 5 + token::INT * 1.6 + cov * 2.4 + tcov * 1.2 + pq * 1.8 + CASE WHEN eq = 'key-in-title' THEN 1 WHEN eq = 'expansion' THEN 0.8 ELSE 0 END * 1.5 + ckey::INT * 1.3 + exp * 0.8 + morph::INT * 0.4
+ least(typo, 2) * 0.35 + CASE WHEN vs = 2 THEN 1 WHEN vs = 1 THEN 0.35 ELSE 0 END * 2.2 + lead::INT * 1.7 + span::INT * 0.9 + adj * 0.8 + body * 0.25 + phr / 4 * 0.45 + tcov / 2, 6)::DOUBLE AS score FROM x""".replace("{two_thirds}", _TWO_THIRDS)
SQL_pair_decisions = _decisions_sql(_FIRST + _DIRECT + _REST)
SQL_pair_decisions_hybrid = _decisions_sql(_FIRST + _HYBRID + _REST)
QUERIES = {f.__name__: f for f in (direct_classes, feature_scores, pair_decisions, pair_decisions_hybrid)}
ORACLES = {name: globals()[f"SQL_{name}"] for name in QUERIES}
