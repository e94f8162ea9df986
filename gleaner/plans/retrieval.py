"""Queries of tokenising, indexing and search over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import scoring, text
from gleaner.operators import index, search
from gleaner.plans.registry import query, table

TOKENS = r"list_filter(list_transform(regexp_extract_all({0}, '\p{{N}}+|\p{{L}}[\p{{L}}\p{{N}}]*'), lambda x: lower(x)), lambda x: length(x) >= 2)"
DOCS = f"docs AS (SELECT doc_id AS doc, terms, len(terms) AS length FROM (SELECT doc_id, {TOKENS.format('text')} AS terms FROM documents))"
POS = f"{DOCS}, pos AS (SELECT doc, length, unnest(terms) AS term, unnest(range(len(terms))) AS position FROM docs)"
TF = f"{POS}, tf AS (SELECT doc, length, term, count(*) AS tf, list(position ORDER BY position) AS positions FROM pos GROUP BY ALL)"
POSTINGS = f"""{TF}, dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*) AS n, avg(length) AS a FROM docs),
postings AS (SELECT term, doc, tf, positions, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a)) AS score FROM tf JOIN dfs USING (term), st)"""
ASKED = f"asked AS (SELECT item_id, unnest(list_distinct({TOKENS.format('q')})) AS term FROM (SELECT item_id, text AS q FROM benchmark))"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return index.documents(table(spark, sf, "documents"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text of every benchmark item as a query."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("tokenize_terms", f"WITH {DOCS} SELECT doc AS doc_id, length::INTEGER AS length, array_to_string(terms, ' ') AS terms FROM docs")
def tokenize_terms(spark, sf):
    return _docs(spark, sf).select(F.col("doc").alias("doc_id"), "length", F.array_join("terms", " ").alias("terms"))


@query("term_positions", f"WITH {TF} SELECT doc, term, array_to_string(positions, ',') AS positions FROM tf")
def term_positions(spark, sf):
    return index.term_frequencies(_docs(spark, sf), ("positions",)).select("doc", "term", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("term_frequency", f"WITH {TF} SELECT doc, term, tf FROM tf")
def term_frequency(spark, sf):
    return index.term_frequencies(_docs(spark, sf), ("tf",)).select("doc", "term", "tf")


@query("document_frequency", f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def document_frequency(spark, sf):
    return index.frequencies(_docs(spark, sf))


@query("avg_doc_length", f"WITH {DOCS} SELECT count(*) AS n, round(avg(length), 6) AS average FROM docs")
def avg_doc_length(spark, sf):
    return index.corpus_stats(_docs(spark, sf)).select("n", F.round("average", 6).alias("average"))


IDF = f"WITH {TF}, d AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT count(*) AS n FROM docs) SELECT term, round(%s, 6) AS idf FROM d, s"


def _idf(spark, sf, f):
    docs = _docs(spark, sf)
    return index.frequencies(docs).crossJoin(F.broadcast(index.corpus_stats(docs))).select("term", F.round(f(F.col("n"), F.col("df")), 6).alias("idf"))


@query("bm25_idf", IDF % "ln(1 + (n - df + 0.5) / (df + 0.5))")
def bm25_idf(spark, sf):
    return _idf(spark, sf, scoring.bm25_idf)


@query("tfidf_idf", IDF % "ln((1 + n) / (1 + df)) + 1")
def tfidf_idf(spark, sf):
    return _idf(spark, sf, scoring.tfidf_idf)


@query("tfidf_scores", f"WITH {TF}, d AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT count(*) AS n FROM docs) SELECT doc, tf.term, round(tf * (ln((1 + n) / (1 + df)) + 1), 6) AS score FROM tf JOIN d USING (term), s")
def tfidf_scores(spark, sf):
    docs = _docs(spark, sf)
    joined = index.with_df(index.term_frequencies(docs, ("tf",)), docs)
    return joined.select("doc", "term", F.round(F.col("tf") * scoring.tfidf_idf(F.col("n"), F.col("df")), 6).alias("score"))


@query("bm25_postings", f"WITH {POSTINGS} SELECT term, doc, tf, round(score, 6) AS score, len(positions)::INTEGER AS hits, positions[1]::INTEGER AS first FROM postings")
def bm25_postings(spark, sf):
    p = index.postings(_docs(spark, sf), fields=("tf", "first"))
    return p.select("term", "doc", "tf", F.round("score", 6).alias("score"), F.col("tf").cast("int").alias("hits"), "first")


@query("inverted_index_nested", f"WITH {POSTINGS} SELECT term, count(*)::INTEGER AS docs, string_agg(doc || ':' || array_to_string(positions, ','), ' ' ORDER BY doc) AS postings FROM postings GROUP BY term")
def inverted_index_nested(spark, sf):
    flat = F.transform("postings", lambda p: F.concat(p["doc"].cast("string"), F.lit(":"), F.array_join(p["positions"].cast("array<string>"), ",")))
    return index.inverted(index.postings(_docs(spark, sf))).select("term", F.size("postings").alias("docs"), F.array_join(flat, " ").alias("postings"))


SCORED = f"WITH {POSTINGS}, {ASKED}, scored AS (SELECT item_id AS query_id, doc, sum(score) AS score, min(positions[1]) AS first FROM postings JOIN asked USING (term) GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS rank FROM scored)"


@query("batch_search_topk", f"{SCORED} SELECT query_id, rank::INTEGER AS rank, round(score, 6) AS score, doc FROM ranked WHERE rank <= 100")
def batch_search_topk(spark, sf):
    best = search.best(_docs(spark, sf), _queries(spark, sf), 100)
    return best.select("query_id", "rank", F.round("score", 6).alias("score"), "doc")


SNIPPET = """CASE WHEN first - 20 > 0 THEN '... ' ELSE '' END || array_to_string(terms[greatest(first - 20, 0) + 1 : least(len(terms), first + 21)], ' ')
 || CASE WHEN first + 21 < len(terms) THEN ' ...' ELSE '' END"""


@query("search_snippets", f"{SCORED} SELECT query_id, rank::INTEGER AS rank, doc, {SNIPPET} AS snippet FROM ranked JOIN docs USING (doc) WHERE rank <= 10")
def search_snippets(spark, sf):
    return search.find(table(spark, sf, "documents"), _queries(spark, sf)).select("query_id", "rank", "doc", "snippet")


@query("search_topk", f"{SCORED} SELECT query_id, rank::INTEGER AS rank, round(score, 6) AS score, doc, {SNIPPET} AS snippet FROM ranked JOIN docs USING (doc) WHERE rank <= 10 AND query_id = 0")
def search_topk(spark, sf):
    return search.find(table(spark, sf, "documents"), _queries(spark, sf).where("query_id = 0")).withColumn("score", F.round("score", 6))


@query("run_file_export", f"{SCORED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS rank, 'http://docs/' || doc AS url, printf('%.4f', round(score, 9)) AS score FROM ranked WHERE rank <= 100 AND doc % 7 <> 0")
def run_file_export(spark, sf):
    best = search.best(_docs(spark, sf), _queries(spark, sf), 100).withColumn("score", F.round("score", 9))
    return search.run_file(best.withColumn("url", F.when(F.col("doc") % 7 != 0, F.concat(F.lit("http://docs/"), F.col("doc").cast("string")))))


@query("word_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::INTEGER AS words, len(regexp_replace(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '^ | $', '', 'g'))::INTEGER AS collapsed FROM documents")
def word_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"), F.length(text.collapse(F.col("text"))).alias("collapsed"))


@query("shingle_counts", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zäöüß0-9]+') AS w FROM documents), s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS shingle FROM w) SELECT doc_id, shingle, count(*) AS n FROM s GROUP BY ALL")
def shingle_counts(spark, sf):
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), text.shingle_words(F.col("text")).alias("terms"))
    return index.shingle_counts(words).withColumnRenamed("doc", "doc_id")
