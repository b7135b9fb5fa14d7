"""Lexical and vector search, and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import stems, text
from quarry.operators import retrieval, search_index
from quarry.plans.catalog import Tables
from quarry.queries import query
from quarry.sources.shared import shared_path

_dot = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_cosine = "{d} / (sqrt({a}) * sqrt({b}))".format(d=_dot.format("e.embedding", "q.embedding"), a=_dot.format("e.embedding", "e.embedding"), b=_dot.format("q.embedding", "q.embedding"))
TERMS = ["the", "license", "heand"]
_overlap = "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in TERMS) + ") / 3.0::DOUBLE"


def query_vector(t: Tables, vec_id: int) -> list[float]:
    return t("embeddings").where(F.col("vec_id") == vec_id).first().embedding


@query("vector_topk_cosine", f"SELECT e.vec_id, round({_cosine}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY {_cosine} DESC, e.vec_id LIMIT 20")
def vector_topk(t: Tables):
    found = retrieval.nearest(t("embeddings"), "vec_id", "embedding", query_vector(t, 7), 20, must=F.col("vec_id") != 7)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("vector_filtered_threshold", f"SELECT e.vec_id, round({_cosine}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.label = 1 AND {_cosine} >= 0.05 ORDER BY {_cosine} DESC, e.vec_id LIMIT 50")
def vector_filtered(t: Tables):
    found = retrieval.nearest(t("embeddings"), "vec_id", "embedding", query_vector(t, 3), 50, threshold=0.05, must=F.col("label") == 1)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("similar_widened", f"""WITH s AS (SELECT e.vec_id, e.label, {_cosine} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q WHERE e.vec_id <> 11)
  SELECT vec_id, CAST(label = (SELECT label FROM embeddings WHERE vec_id = 11) AS BOOLEAN) AS same, round(score, 6) AS score FROM s ORDER BY label = (SELECT label FROM embeddings WHERE vec_id = 11) DESC, score DESC, vec_id LIMIT 10""")
def similar(t: Tables):
    """Of the same kind first, widened to others where they are too few: one scan ranks both."""
    own = t("embeddings").where("vec_id = 11").first()
    q = F.lit([float(x) for x in own.embedding])
    rows = t("embeddings").where("vec_id <> 11").select("vec_id", (F.col("label") == own.label).alias("same"), retrieval.cosine(F.col("embedding"), q).alias("score"))
    return rows.orderBy(F.desc("same"), F.desc("score"), "vec_id").limit(10).select("vec_id", "same", F.round("score", 6).alias("score"))


@query("lexical_ilike_columns", "SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%#11%' OR CAST(p_size AS VARCHAR) ILIKE '%ring%'")
def ilike(t: Tables):
    return t("part").where(F.col("p_name").ilike("%ring%") | F.col("p_brand").ilike("%#11%") | F.col("p_size").cast("string").ilike("%ring%")).select("p_partkey")


@query("lexical_term_overlap", f"SELECT doc_id, round({_overlap}, 4) AS score FROM documents WHERE {_overlap} > 0.5 ORDER BY round({_overlap}, 4) DESC, doc_id LIMIT 100")
def term_overlap(t: Tables):
    scored = t("documents").select("doc_id", F.round(text.term_overlap(F.col("text"), TERMS), 4).alias("score"))
    return scored.where("score > 0.5").orderBy(F.desc("score"), "doc_id").limit(100)


@query("lexical_all_terms", r"SELECT doc_id FROM documents WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), ['the', 'of', 'and'])) = 3")
def all_terms(t: Tables):
    """Full-text match: each query term is among the text's words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"))
    return t("documents").select("doc_id", words.alias("w")).where(F.forall(F.lit(["the", "of", "and"]), lambda q: F.array_contains("w", q))).select("doc_id")


@query("lexical_trigram_similarity", r"""WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, list_distinct(flatten(list_transform(string_split(p_name, ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS a,
  list_distinct(flatten(list_transform(['blu', 'bolts'], lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS b FROM n)
  SELECT p_name, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS score FROM g WHERE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) > 0.15""")
def trigrams(t: Tables):
    scored = t("part").select("p_name").distinct().select("p_name", F.round(text.similarity(F.col("p_name"), F.lit("blu bolts")), 6).alias("score"))
    return scored.where("score > 0.15")


@query("hybrid_rrf", """WITH s AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_name ILIKE '%bolt%'), v AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_type = 'LARGE'),
  x AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size * 2 DESC, p_partkey) AS r FROM part WHERE p_brand = 'Brand#3'),
  u AS (SELECT id, 'text' AS b, 1.0::DOUBLE / (60 + r) AS p FROM s UNION ALL SELECT id, 'vector', 0.8::DOUBLE / (60 + r) FROM v UNION ALL SELECT id, 'exact', 2.0::DOUBLE / (60 + r) FROM x),
  f AS (SELECT id, sum(p) AS score, string_agg(b, ',' ORDER BY b) AS branches FROM u GROUP BY 1) SELECT id, round(score / max(score) OVER (), 4) AS score, branches FROM f""")
def hybrid(t: Tables):
    part = t("part").withColumnRenamed("p_partkey", "id")
    branches = {
        "text": (part.where(F.col("p_name").ilike("%bolt%")).select("id", F.col("p_retailprice").alias("score")), 1.0),
        "vector": (part.where("p_type = 'LARGE'").select("id", F.col("p_size").cast("double").alias("score")), 0.8),
        "exact": (part.where("p_brand = 'Brand#3'").select("id", (F.col("p_size") * 2.0).alias("score")), 2.0),
    }
    return retrieval.fused(branches, ["id"], digits=4).select("id", "score", F.array_join("branches", ",").alias("branches"))


@query("fact_search_boosts", f"SELECT doc_id, round(least(1.0, {_overlap} + CASE WHEN source = 'src0' THEN 0.15 ELSE 0 END + CASE WHEN contains(lower(text), 'the of') THEN 0.08 ELSE 0 END), 4) AS score FROM documents WHERE {_overlap} > 0")
def boosts(t: Tables):
    base = text.term_overlap(F.col("text"), TERMS)
    boosted = base + F.when(F.col("source") == "src0", 0.15).otherwise(0.0) + F.when(F.contains(F.lower("text"), F.lit("the of")), 0.08).otherwise(0.0)
    return t("documents").where(base > 0).select("doc_id", F.round(F.least(F.lit(1.0), boosted), 4).alias("score"))


# ---- a stored index

TEN = ("the", "license heand", "ofthe and tion", "que les", "und der ungen", "в по не", "Copyright license", "the the of and", "nosuchwordatall", "tion nosuchwordatall")
_endings, _fleeting = stems.WITH_ENDING.replace("'", "''"), stems.FLEETING
_key = rf"regexp_replace(regexp_replace(replace(w, 'ё', 'е'), '{_endings}', '\1'), '{_fleeting}', '\1\2')"
_words = rf"w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM documents), c AS (SELECT doc_id, {_key} AS term, count(*) AS tf FROM w GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS length FROM c GROUP BY 1), n AS (SELECT CAST((SELECT count(*) FROM documents) AS DOUBLE) AS n, (SELECT sum(length) FROM l) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS mean), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1)"
_scored = rf"q AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{q}{chr(39)})' for i, q in enumerate(TEN))}) AS v(q, text)), t AS (SELECT DISTINCT q, {_key} AS term FROM (SELECT q, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM q)), s AS (SELECT q, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score, count(*) AS held FROM t JOIN c USING (term) JOIN d USING (term) JOIN l USING (doc_id), n GROUP BY 1, 2)"


def built(t: Tables) -> search_index.SearchIndex:
    """An index of all documents, added in two segments."""
    index = search_index.SearchIndex(t.spark, shared_path(t.spark, "search-index"))
    for i in range(2):
        index.add(t("documents").where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == i), "doc_id", "text", str(i))
    return index


@query("search_index_ten", f"WITH {_words}, {_scored}, r AS (SELECT q, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc_id) AS place FROM s) SELECT CAST(q AS INT) AS q, doc_id, score FROM r WHERE place <= 20")
def ten_queries(t: Tables):
    """Ten free-text queries, the twenty best of each, over the stored index."""
    index = built(t)
    return reduce(DataFrame.unionAll, (index.search(text, 20).select(F.lit(i).alias("q"), F.col("doc").alias("doc_id"), "score") for i, text in enumerate(TEN)))


_grams = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
_alike = "len(list_intersect({a}, {b})) / CAST(greatest(len(list_distinct(list_concat({a}, {b}))), 1) AS DOUBLE)"


@query("search_documents_ranked", f"WITH {_words}, q AS (SELECT 0 AS q, 'src1 the' AS text), t AS (SELECT DISTINCT {_key} AS term FROM (SELECT unnest(['src1', 'the']) AS w)), s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score, count(*) AS held FROM t JOIN c USING (term) JOIN d USING (term) JOIN l USING (doc_id), n GROUP BY 1 HAVING count(*) = 2),"
       f" g AS (SELECT doc_id, {_grams.format('source')} AS a, {_grams.format('lang')} AS e, {_grams.format(chr(39) + 'src1 the' + chr(39))} AS b, contains(lower(source), 'src1 the') OR contains(lower(lang), 'src1 the') AS holds FROM documents),"
       f" k AS (SELECT doc_id, holds, greatest(coalesce({_alike.format(a='a', b='b')}, 0), coalesce({_alike.format(a='e', b='b')}, 0)) AS likeness FROM g)"
       " SELECT doc_id, round(coalesce(score, 0.0) + 0.5 * likeness, 6) AS rank FROM k LEFT JOIN s USING (doc_id) WHERE score IS NOT NULL OR holds OR likeness > 0.15 ORDER BY rank DESC, doc_id LIMIT 50")  # fmt: skip
def ranked_search(t: Tables):
    """Words by the index, short columns by what stands in them and by trigrams, one rank of both."""
    return search_index.ranked_documents(built(t), t("documents"), "doc_id", ["source", "lang"], "src1 the")
