"""Queries over the standard tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.english import BUILT_IN, English
from lexloom.functions.text import STOP_WORDS, allow_prefix, collapse_repeats, decode_leet, saturating, tokenize, tokens
from lexloom.functions.versions import compact_forms, dotted_spans
from lexloom.operators import bm25_scan, corpus, counting, documents, metrics, postings, relgraph, relationships, semantic
from lexloom.plans import rules
from lexloom.plans.engine import SearchEngine
from lexloom.streaming.latest_wins import latest, session_stats


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def docs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.col("text").alias("body"))


def lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the whole first line as title."""
    d = _read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))


def part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("body"))


def item_queries(spark: SparkSession, sf_dir: str, n: int | None = 4) -> DataFrame:
    """The first n words of each benchmark text, without n all of them."""
    b, words = _read(spark, sf_dir, "benchmark"), tokens(F.col("text"))
    return b.select(F.col("item_id").cast("string").alias("query_id"), (words if n is None else F.slice(words, 1, n)).alias("words"))


def _toks(x: str) -> str:
    return f"""list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[''`"]', '', 'g'), '[^a-z0-9*]+'), lambda t: t <> '')"""


_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS body FROM documents)"
_LINES = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS body FROM documents)"
_PARTS = "docs AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand || ' ' || p_type AS body FROM part)"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TABLE = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in BUILT_IN.items()) + "}"


def _collapsed(t: str) -> str:
    return f"CASE WHEN length({t}) >= 4 AND length({t}) - length(rtrim({t}, right({t}, 1))) >= 3 THEN rtrim({t}, right({t}, 1)) || right({t}, 1) ELSE {t} END"


def _stripped(t: str) -> str:
    cut = lambda k: f"left({t}, length({t}) - {k})"
    return (
        f"CASE WHEN length({t}) <= 3 THEN {t} WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN {cut(3)} || 'y' "
        f"WHEN {t} LIKE '%ing' AND length({t}) > 5 THEN CASE WHEN {cut(3)} LIKE '%at' THEN {cut(3)} || 'e' ELSE {cut(3)} END "
        f"WHEN {t} LIKE '%ed' AND length({t}) > 4 THEN {cut(2)} WHEN {t} LIKE '%ion' AND length({t}) > 5 THEN {cut(3)} "
        f"WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN {cut(1)} ELSE {t} END"
    )


def _lemmas(source: str, column: str = "t") -> str:
    """CTEs that give `lemmas`: the rows of `source` with lemma, the lemma of `column`."""
    return f"""lem0 AS (SELECT *, {_collapsed(column)} AS lc FROM {source}), lem1 AS (SELECT *, {_stripped('lc')} AS ls FROM lem0),
lemmas AS (SELECT *, coalesce({_TABLE}[{column}], {_TABLE}[lc], {_TABLE}[ls], ls) AS lemma FROM lem1)"""


def token_frequencies(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("term"))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


SQL_token_frequencies = f"SELECT term, count(*) AS n FROM (SELECT unnest({_toks('text')}) AS term FROM documents) GROUP BY term"


def version_forms(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", dotted_spans(F.col("text")).alias("spans"))
    return d.where(F.size("spans") > 0).select("doc_id", F.array_join("spans", ",").alias("spans"), F.array_join(F.array_sort(compact_forms(F.col("spans"))), ",").alias("compact"))


SQL_version_forms = r"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)+') AS spans FROM documents)
SELECT doc_id, array_to_string(spans, ',') AS spans, array_to_string(list_sort(list_distinct(list_transform(spans, lambda x: replace(x, '.', '')))), ',') AS compact FROM s WHERE len(spans) > 0"""


def lemma_frequencies(spark, sf_dir):
    terms = token_frequencies(spark, sf_dir)
    return terms.groupBy(English().lemma_column(F.col("term")).alias("lemma")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))


SQL_lemma_frequencies = f"""
WITH toks AS (SELECT t, count(*) AS k FROM (SELECT unnest({_toks('text')}) AS t FROM documents) GROUP BY t), {_lemmas('toks')}
SELECT lemma, CAST(sum(k) AS BIGINT) AS n, count(*) AS forms FROM lemmas GROUP BY lemma"""


def repair_forms(spark, sf_dir):
    """Distinct tokens that collapsing repeats or decoding digits changes."""
    t = token_frequencies(spark, sf_dir).select("term", collapse_repeats(F.col("term")).alias("collapsed"), F.coalesce(decode_leet(F.col("term")), F.lit("")).alias("leet"))
    return t.where((F.col("term") != F.col("collapsed")) | (F.col("leet") != ""))


SQL_repair_forms = f"""
WITH toks AS (SELECT DISTINCT t FROM (SELECT unnest({_toks('text')}) AS t FROM documents)),
r AS (SELECT t AS term, {_collapsed('t')} AS collapsed, CASE WHEN length(t) >= 6 AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '^[0-9]+$') AND translate(t, '013457', 'oieast') <> t THEN translate(t, '013457', 'oieast') ELSE '' END AS leet FROM toks)
SELECT * FROM r WHERE term <> collapsed OR leet <> ''"""


def phrase_frequencies(spark, sf_dir):
    return documents.lexical_frequency(docs_view(spark, sf_dir), least_count=2)


SQL_phrase_frequencies = f"""
WITH {_DOCS}, toks AS (SELECT id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT id, {_toks('body')} AS ts FROM docs)), {_lemmas('toks')},
kept AS (SELECT id, lemma, row_number() OVER (PARTITION BY id ORDER BY i) AS j FROM lemmas WHERE lemma <> '' AND lemma NOT IN ({_STOP})),
grams AS (SELECT id, lemma AS gram FROM kept WHERE length(lemma) >= 2 UNION ALL SELECT a.id, a.lemma || ' ' || b.lemma FROM kept a JOIN kept b ON a.id = b.id AND b.j = a.j + 1),
counts AS (SELECT id, gram, count(*) AS n FROM grams GROUP BY id, gram)
SELECT id, gram, n FROM counts WHERE gram IN (SELECT gram FROM counts GROUP BY gram HAVING sum(n) >= 2)"""


def saturated_frequencies(spark, sf_dir):
    return token_frequencies(spark, sf_dir).groupBy("n").agg(F.count(F.lit(1)).alias("terms")).withColumn("saturated", saturating(F.col("n")))


SQL_saturated_frequencies = f"""
WITH f AS ({SQL_token_frequencies}) SELECT n, count(*) AS terms, round(ln(1 + n) / (1 + ln(1 + n)), 4) AS saturated FROM f GROUP BY n"""


def last_versions(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value")
    return documents.last_wins(e)


SQL_last_versions = "SELECT CAST(user_id AS VARCHAR) AS id, max_by(event_id, event_id) AS seq, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id"


def index_vocabulary(spark, sf_dir, view=docs_view):
    return documents.vocabulary(documents.analysed(view(spark, sf_dir)))


SQL_index_vocabulary = f"""
WITH {_DOCS}, toks AS (SELECT DISTINCT t, f FROM (SELECT unnest({_toks('title')}) AS t, 1 AS f FROM docs UNION ALL SELECT unnest({_toks('body')}), 2 FROM docs)), {_lemmas('toks')},
rows AS (SELECT t AS term, f = 1 AS a, true AS b FROM lemmas UNION ALL SELECT lemma, true, false FROM lemmas WHERE f = 1)
SELECT term, bool_or(a) AS in_title, bool_or(b) AS in_surface FROM rows GROUP BY term"""


def document_frequencies(spark, sf_dir, view=docs_view):
    docs = view(spark, sf_dir)
    if counting.unique(docs):
        return counting.frequencies(docs, tokenize)
    return postings.postings(documents.analysed(docs)).where(F.col("field").isin("title", "body")).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


SQL_document_frequencies = f"""
WITH {_DOCS}, toks AS (SELECT id, 'title' AS field, unnest({_toks('title')}) AS term FROM docs UNION ALL SELECT id, 'body', unnest({_toks('body')}) FROM docs)
SELECT field, term, count(DISTINCT id) AS df, count(*) AS tf FROM toks GROUP BY field, term"""


def search_bm25(spark, sf_dir, k: int = 5, n: int | None = 4, view=docs_view):
    """The k best documents for the first n words of every benchmark text by BM25 over titles and bodies."""
    docs = view(spark, sf_dir)
    forms = item_queries(spark, sf_dir, n).select("query_id", F.explode(F.array_distinct("words")).alias("form"), F.lit("token").alias("kind"))
    if counting.unique(docs):
        return postings.top_k(bm25_scan.best(docs, forms, k).withColumn("score", F.round("score", 6)), k)
    index = documents.analysed(docs)
    posting = postings.postings(index).where(F.col("field").isin("title", "body"))
    scored = postings.bm25_scores(forms, posting, postings.corpus_stats(index), prefixes=False)
    return postings.top_k(scored.select("query_id", "id", F.round("score", 6).alias("score")), k)


SQL_search_bm25 = f"""
WITH {_DOCS}, d AS (SELECT id, {_toks('title')} AS tt, {_toks('body')} AS bt FROM docs),
st AS (SELECT count(*) AS n, avg(len(tt)) AS ta, avg(len(bt)) AS ba FROM d),
q AS (SELECT DISTINCT query_id, unnest(w[1:4]) AS term FROM (SELECT CAST(item_id AS VARCHAR) AS query_id, {_toks('text')} AS w FROM benchmark)),
p AS (SELECT field, term, id, count(*) AS tf, max(dl) AS dl FROM (SELECT 'title' AS field, unnest(tt) AS term, id, len(tt) AS dl FROM d UNION ALL SELECT 'body', unnest(bt), id, len(bt) FROM d) GROUP BY field, term, id),
f AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
s AS (SELECT query_id, id, round(sum(CASE WHEN field = 'title' THEN 4.0 ELSE 1.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / CASE WHEN field = 'title' THEN ta ELSE ba END))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (field, term) CROSS JOIN st GROUP BY query_id, id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rn FROM s)
SELECT query_id, id, score, rn FROM r WHERE rn <= 5"""


def search_bm25_whole(spark, sf_dir):
    """The five best documents for all words of every benchmark text by BM25 over first lines and bodies."""
    return search_bm25(spark, sf_dir, n=None, view=lines_view)


SQL_search_bm25_whole = SQL_search_bm25.replace(_DOCS, _LINES).replace("unnest(w[1:4])", "unnest(w)")


def _asked_words(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("form")).distinct()


def _title_words(spark, sf_dir, view=docs_view) -> DataFrame:
    return view(spark, sf_dir).select(F.explode(tokens(F.col("title"))).alias("term")).distinct()


def prefix_matches(spark, sf_dir, view=docs_view):
    """Title words that a benchmark word begins, 64 of each in order."""
    a, b = _asked_words(spark, sf_dir).where("length(form) >= 3"), _title_words(spark, sf_dir, view)
    pairs = a.withColumn("k", F.substring("form", 1, 3)).join(b.withColumn("k", F.substring("term", 1, 3)), "k").where((F.col("form") != F.col("term")) & allow_prefix(F.col("form"), F.col("term")))
    order = Window.partitionBy("form").orderBy("term")
    return pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= postings.PREFIX_TERMS).select("form", "term", "rn")


SQL_prefix_matches = f"""
WITH a AS (SELECT DISTINCT unnest({_toks('text')}) AS form FROM benchmark), {_DOCS}, b AS (SELECT DISTINCT unnest({_toks('title')}) AS term FROM docs),
m AS (SELECT form, term FROM a JOIN b ON starts_with(term, form) AND form <> term WHERE NOT regexp_matches(form, '^[0-9]+$') AND NOT regexp_matches(term, '^[0-9]+$') AND (length(form) >= 4 OR length(form) >= 3 AND length(form) / length(term) >= 0.55)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY form ORDER BY term) AS INTEGER) AS rn FROM m) SELECT form, term, rn FROM r WHERE rn <= 64"""


def typo_suggestions(spark, sf_dir, view=docs_view):
    """For benchmark words of five letters or more that no title has, the nearest title word within two edits."""
    vocabulary = _title_words(spark, sf_dir, view)
    unknown = _asked_words(spark, sf_dir).where("length(form) >= 5 and not form rlike '^[0-9]+$'").join(vocabulary, F.col("form") == F.col("term"), "left_anti")
    near = unknown.withColumn("n", F.explode(F.sequence(F.length("form") - 2, F.length("form") + 2))).join(vocabulary.withColumn("n", F.length("term")), "n")
    d = near.withColumn("distance", F.levenshtein("form", "term", 2)).where("distance between 1 and 2")
    return d.groupBy("form").agg(F.min(F.struct("distance", "term")).alias("b")).select("form", F.col("b.term").alias("suggestion"), F.col("b.distance").cast("bigint").alias("distance"))


SQL_typo_suggestions = f"""
WITH {_DOCS}, v AS (SELECT DISTINCT unnest({_toks('title')}) AS term FROM docs), a AS (SELECT DISTINCT unnest({_toks('text')}) AS form FROM benchmark),
u AS (SELECT form FROM a WHERE length(form) >= 5 AND NOT regexp_matches(form, '^[0-9]+$') AND form NOT IN (SELECT term FROM v)),
m AS (SELECT form, term, levenshtein(form, term) AS distance FROM u JOIN v ON abs(length(form) - length(term)) <= 2)
SELECT form, arg_min(term, (distance, term)) AS suggestion, min(distance) AS distance FROM m WHERE distance BETWEEN 1 AND 2 GROUP BY form"""


def title_lookups(spark, sf_dir):
    """How many part names equal, and how many begin with, each part name's first word or the name itself."""
    d = documents.analysed(part_docs(spark, sf_dir)).select("id", "normalized_title")
    q = d.select(F.explode(F.array(F.substring_index("normalized_title", " ", 1), F.col("normalized_title"))).alias("query")).distinct()
    pairs = q.withColumn("k", F.substring("query", 1, 1)).join(d.withColumn("k", F.substring("normalized_title", 1, 1)), "k").where(F.startswith("normalized_title", F.col("query")))
    return pairs.groupBy("query").agg(F.count_if(F.col("query") == F.col("normalized_title")).alias("exact"), F.count(F.lit(1)).alias("begun"), F.round(F.max(8 * F.length("query") / F.length("normalized_title")), 6).alias("best"))


SQL_title_lookups = f"""
WITH {_PARTS}, d AS (SELECT id, array_to_string({_toks('title')}, ' ') AS t FROM docs), q AS (SELECT DISTINCT unnest([split_part(t, ' ', 1), t]) AS query FROM d)
SELECT query, count(*) FILTER (WHERE query = t) AS exact, count(*) AS begun, round(max(8 * length(query) / length(t)), 6) AS best FROM q JOIN d ON starts_with(t, query) GROUP BY query"""


def mined_vocabulary(spark, sf_dir, view=docs_view):
    return corpus.mine_vocabulary(view(spark, sf_dir))


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', ' ', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), '\s+', ' ', 'g'))"""
_FUNCTION = ", ".join(f"'{w}'" for w in corpus.FUNCTION_WORDS)


def _words_sql(x: str) -> str:
    return f"""list_filter(string_split_regex(regexp_replace(lower({x}), '[''`"]', '', 'g'), '[^a-z0-9]+'), lambda t: t <> '')"""


_VOCABULARY = rf"""{_DOCS}, w AS (SELECT id, unnest({_words_sql(_CLEAN.format(x='title'))}) AS term, 1 AS t FROM docs UNION ALL SELECT id, unnest({_words_sql(_CLEAN.format(x='body'))}), 0 FROM docs),
p AS (SELECT term, id, count(*) AS n, max(t) AS t FROM w GROUP BY term, id),
c AS (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df, CAST(sum(t) AS BIGINT) AS title_df FROM p GROUP BY term),
k AS (SELECT *, regexp_matches(term, '^[a-z]\d$') OR regexp_matches(term, '^[a-z]\d[a-z]$') OR term IN ('grpc', 'oauth', 'webgl', 'webgpu', 'openid') AS literal, term IN ({_FUNCTION}) AS small
  FROM c WHERE length(term) <= 32 AND NOT regexp_matches(term, '^(https?|www|html|href|class|span|div|src)$')),
m AS (SELECT *, literal OR title_df >= 1 OR (df >= 2 AND length(term) >= 4 AND NOT small) AS domain, literal OR title_df >= 1 OR (df >= 2 AND length(term) >= 5 AND NOT small AND NOT regexp_matches(term, '[0-9]{{4,}}')) AS spelling FROM k),
vocabulary AS (SELECT term, tf, df, title_df, CASE WHEN literal THEN 'literal' WHEN title_df >= 1 THEN 'title' WHEN domain THEN 'domain' ELSE 'general' END AS kind, spelling FROM m WHERE domain OR spelling OR df >= 2)"""
SQL_mined_vocabulary = f"WITH {_VOCABULARY} SELECT * FROM vocabulary"


def short_forms(spark, sf_dir, view=docs_view):
    return corpus.alias_pairs(corpus.term_counts(view(spark, sf_dir)))


_STEM = "regexp_replace(regexp_replace({x}, '(ing|ed|es|ers|er|ly)$', ''), 's$', '')"
SQL_short_forms = f"""
WITH {_VOCABULARY}, v AS (SELECT * FROM c WHERE df >= 3 AND term NOT IN ({_FUNCTION})),
j AS (SELECT a.term AS s, b.term AS l, substr(b.term, length(a.term) + 1) AS rest FROM v a JOIN v b ON starts_with(b.term, a.term) AND length(a.term) BETWEEN 4 AND 8 AND length(b.term) - length(a.term) >= 4 WHERE a.title_df >= 1 OR b.title_df >= 1)
SELECT s AS short, l AS long FROM j
WHERE (regexp_matches(l, '(ation|ization|isation|ative|ence|ency|ance|ous|ual|ment)$') OR regexp_matches(rest, '(ation|ization|isation|ative|ence|ency|ance|ous|ual|ment)$'))
AND NOT regexp_matches(rest, '^(s|es|ed|ing|izing|er|ers|ly|ally|d|ling)$') AND NOT (s LIKE '%e' AND l = left(s, -1) || 'ing') AND NOT (s LIKE '%y' AND l = left(s, -1) || 'ies')
AND NOT ({_STEM.format(x='s')} = {_STEM.format(x='l')} AND length({_STEM.format(x='s')}) >= 5) AND s || '::' || l <> 'auth::authorization'"""


def acronym_surfaces(spark, sf_dir, view=docs_view):
    return corpus.acronym_surfaces(view(spark, sf_dir))


def equivalence_candidates(spark, sf_dir, view=docs_view):
    return corpus.mine_equivalences(view(spark, sf_dir))


def clean_pages(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", corpus.clean_text(F.col("html")).alias("text"))


SQL_clean_pages = f"SELECT page_id, {_CLEAN.format(x='html')} AS text FROM pages"


def _title_texts(spark, sf_dir) -> DataFrame:
    return docs_view(spark, sf_dir).select("id", F.col("title").alias("prepared"))


def lexical_neighbours(spark, sf_dir):
    titles = _title_texts(spark, sf_dir)
    return semantic.lexical_graph(semantic.tfidf(titles), titles.count(), 5)


def text_neighbours(spark, sf_dir):
    """The five documents nearest to each by TF-IDF over whole texts, without false friends by their first lines.

    It has no SQL: the join of all words of all texts with each other is too large; tests compare with brute force.
    """
    return semantic.neighbours(lines_view(spark, sf_dir), representation="whole", only_mutual=False)


_SEMANTIC_STOP = ", ".join(f"'{w}'" for w in semantic.STOP)
_RANKED = "SELECT source, target, score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS INTEGER) AS rank FROM (SELECT a AS source, b AS target, score FROM {pairs} UNION ALL SELECT b, a, score FROM {pairs})"
SQL_lexical_neighbours = f"""
WITH {_DOCS}, toks AS (SELECT id, unnest(ts) AS term, len(ts) AS n FROM (SELECT id, list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: t NOT IN ({_SEMANTIC_STOP}) AND length(t) > 1) AS ts FROM docs)),
tf AS (SELECT id, term, count(*) / max(n) AS tf FROM toks GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)),
w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x),
p AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id),
r AS ({_RANKED.format(pairs='p')}) SELECT source, target, score, rank FROM r WHERE rank <= 5"""


def _vectors(spark, sf_dir, part: Column | None = None) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return semantic.unit_vectors(e.select(F.col("vec_id").alias("id"), (F.col("embedding") if part is None else part).alias("embedding")))


def embedding_neighbours(spark, sf_dir, k: int = 5):
    return semantic.embedding_graph(_vectors(spark, sf_dir), k, digits=6)


def _cosine(name: str, vector: str) -> str:
    return f"""{name}_v AS (SELECT vec_id AS id, CAST({vector} AS DOUBLE[]) AS v FROM embeddings), {name}_u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM {name}_v),
{name} AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS score, list_dot_product(a.v, b.v) AS s FROM {name}_u a JOIN {name}_u b ON a.id < b.id) WHERE s > 0)"""


_NEIGHBOURS = f"{_cosine('p', 'embedding')}, r AS ({_RANKED.format(pairs='p')}), g AS (SELECT source, target, score, rank FROM r WHERE rank <= 5)"
SQL_embedding_neighbours = f"WITH {_NEIGHBOURS} SELECT * FROM g"


def mutual_neighbours(spark, sf_dir):
    return semantic.mutual(embedding_neighbours(spark, sf_dir))


SQL_mutual_neighbours = f"WITH {_NEIGHBOURS} SELECT g.* FROM g JOIN g h ON g.source = h.target AND g.target = h.source"


def adaptive_neighbours(spark, sf_dir):
    return semantic.adaptive(embedding_neighbours(spark, sf_dir, 10), 5, 0.2, 0.9)


SQL_adaptive_neighbours = f"""
WITH {_cosine('p', 'embedding')}, r AS ({_RANKED.format(pairs='p')}), b AS (SELECT *, max(score) OVER (PARTITION BY source) AS best FROM r WHERE rank <= 10)
SELECT source, target, score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS INTEGER) AS rank FROM b WHERE score >= greatest(0.2, best * 0.9) QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, target) <= 5"""


def fused_neighbours(spark, sf_dir):
    """Two graphs, of either half of the vectors, fused by reciprocal rank."""
    halves = [F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)]
    graphs = [semantic.embedding_graph(_vectors(spark, sf_dir, h), 10, digits=6) for h in halves]
    return semantic.fused(graphs, 5).withColumn("rrf", F.round("rrf", 9))


SQL_fused_neighbours = f"""
WITH {_cosine('p', 'embedding[1:32]')}, {_cosine('o', 'embedding[33:64]')}, r AS ({_RANKED.format(pairs='p')}), s AS ({_RANKED.format(pairs='o')}),
u AS (SELECT source, target, max(score) AS score, sum(1 / (60 + rank)) AS rrf FROM (SELECT * FROM r WHERE rank <= 10 UNION ALL SELECT * FROM s WHERE rank <= 10) GROUP BY source, target),
f AS (SELECT source, target, score, round(rrf, 9) AS rrf, CAST(row_number() OVER (PARTITION BY source ORDER BY rrf DESC, target) AS INTEGER) AS rank FROM u) SELECT * FROM f WHERE rank <= 5"""


def _label_edges(spark, sf_dir) -> DataFrame:
    """Vectors of a label point at the first vector of the next label."""
    e = _read(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("target"))
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source"), (F.col("label") + 1).alias("label")).join(e, "label").select("source", "target", F.lit("editorial").alias("type"), F.lit(0.5).alias("strength"), F.lit("label").alias("provenance"))


_EDGES = f"""{_NEIGHBOURS}, le AS (SELECT e.vec_id AS source, t.target, 'editorial' AS type, 0.5 AS strength, 'label' AS provenance FROM embeddings e JOIN (SELECT label, min(vec_id) AS target FROM embeddings GROUP BY label) t ON t.label = e.label + 1),
se AS (SELECT source, target, 'semantic' AS type, score AS strength, 'semantic' AS provenance FROM g),
be AS (SELECT source, target, 'editorial' AS type, score AS strength, 'vectors' AS provenance FROM g)"""


def merged_relationships(spark, sf_dir):
    g = embedding_neighbours(spark, sf_dir)
    edges = lambda t, p: g.select("source", "target", F.lit(t).alias("type"), F.col("score").alias("strength"), F.lit(p).alias("provenance"))
    return relgraph.adjacency(relgraph.merged([edges("semantic", "semantic"), _label_edges(spark, sf_dir), edges("editorial", "vectors")]))


SQL_merged_relationships = f"""
WITH {_EDGES}, u AS (SELECT *, 0 AS o FROM se UNION ALL SELECT *, 1 FROM le UNION ALL SELECT *, 2 FROM be),
m AS (SELECT source, target, type, max(strength) AS strength, string_agg(provenance, '+' ORDER BY o) AS provenance FROM u WHERE source <> target GROUP BY source, target, type)
SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY strength DESC, type, target) AS INTEGER) AS ord FROM m"""


def related_one_hop(spark, sf_dir):
    """For each label, what any of its vectors points at, with the strongest edge."""
    e = _read(spark, sf_dir, "embeddings")
    chosen = e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank"))
    g = embedding_neighbours(spark, sf_dir)
    edges = relationships.edges_of(g.select("source", F.col("rank").alias("ord"), "target", F.col("score").alias("strength"), F.lit("semantic").alias("provenance")))
    out = relationships.related(chosen, edges, e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("title")))
    return out.select("query_id", "id", "relation.source_id", "relation.strength", "relation.rank", F.size("relation.sources").alias("sources"))


SQL_related_one_hop = f"""
WITH {_NEIGHBOURS}, c AS (SELECT label AS query_id, vec_id AS source, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
h AS (SELECT query_id, target AS id, source, greatest(0, least(1, score)) AS strength, rank, k FROM c JOIN g USING (source))
SELECT query_id, id, arg_min(source, (-strength, k)) AS source_id, max(strength) AS strength, arg_min(rank, (-strength, k)) AS rank, CAST(count(*) AS INTEGER) AS sources FROM h GROUP BY query_id, id"""


def related_one_hop_whole(spark, sf_dir):
    """The name that related_one_hop had while it was cut to three vectors of each label."""
    return related_one_hop(spark, sf_dir)


SQL_related_one_hop_whole = SQL_related_one_hop


def ranking_metrics(spark, sf_dir):
    """Metrics of ranking each language's labelled documents by length."""
    d, lab = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    rows = d.join(lab, "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "n_chars", (2 * F.col("quality")).alias("grade"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "id")))
    out = metrics.query_metrics(ranked, rows.select("query_id", "id", "grade"))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


SQL_ranking_metrics = """
WITH b AS (SELECT lang AS query_id, doc_id AS id, 2 * quality AS grade, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, doc_id) AS best FROM documents JOIN labels USING (doc_id)),
s AS (SELECT query_id, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) AS rel, min(CASE WHEN grade >= 2 THEN rank END) AS first, """ + ", ".join(f"sum(CASE WHEN rank <= {k} THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS d{k}, sum(CASE WHEN best <= {k} THEN (pow(2, grade) - 1) / log2(best + 1) ELSE 0 END) AS i{k}, sum(CASE WHEN rank <= {k} AND grade >= 2 THEN 1 ELSE 0 END) AS f{k}" for k in (5, 10)) + """ FROM b GROUP BY query_id)
SELECT query_id, round(CASE WHEN i5 > 0 THEN d5 / i5 END, 6) AS ndcg_5, round(CASE WHEN i10 > 0 THEN d10 / i10 END, 6) AS ndcg_10, round(CASE WHEN rel > 0 THEN f5 / rel END, 6) AS recall_5, round(CASE WHEN rel > 0 THEN f10 / rel END, 6) AS recall_10, round(CASE WHEN rel > 0 THEN coalesce(1 / first, 0) END, 6) AS mrr FROM s"""


def _keystrokes(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("generation"), F.col("event_type").alias("query"))


def latest_queries(spark, sf_dir):
    return latest(_keystrokes(spark, sf_dir))


SQL_latest_queries = "SELECT CAST(user_id AS VARCHAR) AS session, max(event_id) AS generation, max_by(event_type, event_id) AS query, trim(max_by(event_type, event_id)) = '' AS cleared FROM events GROUP BY user_id"


def latest_query_stats(spark, sf_dir):
    return session_stats(_keystrokes(spark, sf_dir))


SQL_latest_query_stats = "SELECT CAST(user_id AS VARCHAR) AS session, count(*) AS submitted, count(*) - 1 AS coalesced, count(*) FILTER (WHERE false) AS cleared, CAST(1 AS BIGINT) AS published FROM events GROUP BY user_id"


_STATES = ("AUTO_ACCEPTED", "REVIEW_PENDING", "CONFLICT", "COMPILER_REJECTED")


def inspection_changes(spark, sf_dir):
    """What changed between two snapshots of as many candidates as there are documents, whose evidence is drawn from their ids."""
    ids = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("n")).distinct()

    def snapshot(a: int, gone: int) -> DataFrame:
        c, k = F.col("n"), F.col("n") * a
        band = F.when(F.col("state") == "REVIEW_PENDING", F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), (k % 3 + 1).cast("int")))
        rows = ids.where(c % gone != 0).withColumn("state", F.element_at(F.array(*map(F.lit, _STATES)), (F.floor(k / 5) % 4 + 1).cast("int")))
        return rows.select(F.concat(F.lit("eq:"), c).alias("id"), "state", band.alias("band"), (k % 2).alias("explicit_docs"), (F.floor(k / 2) % 2).alias("titles"), (F.floor(k / 3) % 7 == 0).alias("competing"), (F.floor(k / 7) % 9 == 0).alias("gained"), (c % 4 == 0).alias("decided"))

    return corpus.inspection_delta(snapshot(1, 11), snapshot(6, 13))


_SNAPSHOT = """SELECT 'eq:' || n AS id, state, CASE WHEN state = 'REVIEW_PENDING' THEN ['HIGH', 'MEDIUM', 'LOW'][n * {a} % 3 + 1] END AS band, n * {a} % 2 AS explicit, n * {a} // 2 % 2 AS titles, n * {a} // 3 % 7 = 0 AS competing, n * {a} // 7 % 9 = 0 AS gained, n % 4 = 0 AS decided
FROM (SELECT DISTINCT doc_id AS n, ['AUTO_ACCEPTED', 'REVIEW_PENDING', 'CONFLICT', 'COMPILER_REJECTED'][doc_id * {a} // 5 % 4 + 1] AS state FROM documents) WHERE n % {gone} <> 0"""
SQL_inspection_changes = f"""
WITH cur AS ({_SNAPSHOT.format(a=1, gone=11)}), prev AS ({_SNAPSHOT.format(a=6, gone=13)}), r AS (SELECT 'HIGH' AS band, 0 AS o UNION ALL SELECT 'MEDIUM', 1 UNION ALL SELECT 'LOW', 2)
SELECT coalesce(x.id, y.id) AS id, x.state AS state_now, y.state AS state_before,
x.id IS NOT NULL AND y.id IS NOT NULL AND (x.state <> y.state OR coalesce(x.band, '') <> coalesce(y.band, '') OR (y.explicit = 0 AND x.explicit >= 1) OR (y.titles = 0 AND x.titles >= 1)
  OR ((x.competing OR x.state = 'CONFLICT') AND NOT (y.competing OR y.state = 'CONFLICT')) OR (x.gained AND NOT y.gained)) AS material,
CASE WHEN x.state = 'REVIEW_PENDING' THEN CASE WHEN y.id IS NULL THEN 'new' ELSE 'open' END END AS review,
coalesce(x.state = 'CONFLICT' AND y.state IS DISTINCT FROM 'CONFLICT', false) AS conflict,
CASE WHEN rx.o < ry.o THEN 'promoted' WHEN rx.o > ry.o THEN 'demoted' END AS moved, x.id IS NULL AND y.decided AS orphaned
FROM cur x FULL JOIN prev y ON x.id = y.id LEFT JOIN r rx ON rx.band = x.band LEFT JOIN r ry ON ry.band = y.band"""


def ranked_search(spark, sf_dir):
    """Every first word of a part name searched among all part names, ranked by constraints."""
    docs = part_docs(spark, sf_dir)
    engine = SearchEngine(spark, morphology=English(), retriever="indexed")
    engine.index(docs)
    queries = docs.select(F.substring_index("title", " ", 1).alias("raw")).distinct().select(F.col("raw").alias("query_id"), "raw")
    return engine.search_batch(queries).select("query_id", "channel", "rank", "id", "title", "score", "relevance", "direct_class")


def ranked_documents(spark, sf_dir):
    """Every whole benchmark text searched among all documents, whole first lines as titles, ranked by constraints."""
    engine = SearchEngine(spark, morphology=English(), retriever="indexed")
    engine.index(lines_view(spark, sf_dir))
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("raw"))
    return engine.search_batch(queries).select("query_id", "channel", "rank", "id", "title", "score", "relevance", "direct_class")


def _of_lines(query: Callable) -> Callable:
    """The query with whole first lines as titles."""

    def whole(spark, sf_dir):
        return query(spark, sf_dir, view=lines_view)

    whole.__name__ = f"{query.__name__}_of_lines"
    whole.__doc__ = f"{query.__name__} with whole first lines as titles."
    return whole


_TITLED = (index_vocabulary, document_frequencies, prefix_matches, typo_suggestions, mined_vocabulary, short_forms, acronym_surfaces, equivalence_candidates)
_OF_LINES = tuple(_of_lines(f) for f in _TITLED)
for _f in _TITLED:
    if f"SQL_{_f.__name__}" in globals():
        globals()[f"SQL_{_f.__name__}_of_lines"] = globals()[f"SQL_{_f.__name__}"].replace(_DOCS, _LINES)

_ALL = (
    token_frequencies, version_forms, lemma_frequencies, repair_forms, phrase_frequencies, saturated_frequencies, last_versions, index_vocabulary, document_frequencies, search_bm25, search_bm25_whole,
    prefix_matches, typo_suggestions, title_lookups, mined_vocabulary, short_forms, acronym_surfaces, equivalence_candidates, clean_pages, lexical_neighbours, text_neighbours, embedding_neighbours,
    mutual_neighbours, adaptive_neighbours, fused_neighbours, merged_relationships, related_one_hop, related_one_hop_whole, ranking_metrics, latest_queries, latest_query_stats, inspection_changes, ranked_search, ranked_documents,
    *_OF_LINES,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL} | rules.QUERIES


def oracle_sql() -> dict[str, str]:
    return {f.__name__: globals()[f"SQL_{f.__name__}"] for f in _ALL if f"SQL_{f.__name__}" in globals()} | rules.ORACLES
