"""Queries that write what they read: round trips through files, indexes and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleaner.operators import index, search, stores
from gleaner.plans import retrieval
from gleaner.plans.registry import query, table
from gleaner.plans.shared import shared_folder
from gleaner.sources import readers, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("page_scan", "SELECT url, page_id AS id, NULL::VARCHAR AS title, length(html)::INTEGER AS token_count FROM pages WHERE page_id % 5 <> 0")
def page_scan(spark, sf):
    """HTML pages, or of unknown type, with NULL for columns the table lacks."""
    kind = F.when(F.col("page_id") % 5 == 0, "image/png").when(F.col("page_id") % 5 == 1, "TEXT/HTML; charset=utf-8")
    pages = table(spark, sf, "pages").select("url", F.col("page_id").alias("id"), F.length("html").alias("token_count"), kind.alias("content_type"))
    return readers.saved_pages(pages).select("url", "id", "title", "token_count")


@query("json_lines_round_trip", "SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN source END AS source FROM documents")
def json_lines_round_trip(spark, sf):
    """Documents written as JSON lines, NULL fields kept, and read back."""
    path = f"{_folder(spark, 'lines')}.jsonl"
    sinks.json_lines(table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source")), path)
    return readers.json_lines(spark, path, "doc_id long, text string, source string")


@query("index_round_trip", f"{retrieval.SCORED} SELECT query_id, rank::INTEGER AS rank, round(score, 6) AS score, doc FROM ranked WHERE rank <= 100")
def index_round_trip(spark, sf):
    """Batch search over an index that was saved and loaded."""
    docs, folder = index.documents(table(spark, sf, "documents")), _folder(spark, "index")
    index.build(docs, folder)
    best = search.best_hits(index.load(spark, folder)[0], retrieval._queries(spark, sf), 100)
    return best.select("query_id", "rank", F.round("score", 6).alias("score"), "doc")


RECORDS = """records AS (SELECT doc_id, 'http://docs.example/' || source || '/' || (doc_id % 700) AS url, (doc_id % 40 + 1)::VARCHAR AS rank, source AS title, (doc_id % 10 / 10)::VARCHAR AS pageverdict_score, CASE WHEN doc_id % 4 = 0 THEN 'other' END AS source, ' q ' || (doc_id % 4) AS query FROM documents)"""


@query(
    "candidate_import",
    f"""WITH {RECORDS}, typed AS (SELECT doc_id, url, rank::BIGINT AS rank, title, nullif(pageverdict_score::DOUBLE, 0) AS pageverdict_score, coalesce(source, 'crawler_pageverdict') AS source, CASE WHEN source = 'other' THEN trim(query) ELSE 'imported' END AS query FROM records),
last AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY doc_id DESC) AS n FROM typed)
SELECT query, rank, title, url, 'docs.example' AS display_url, source, pageverdict_score, CASE WHEN rank % 2 = 0 THEN 4 END::INTEGER AS rating FROM last WHERE n = 1""",
)
def candidate_import(spark, sf):
    """Records put into the results of a labeling service, over older rows whose ratings stay."""
    i = F.col("doc_id")
    records = table(spark, sf, "documents").orderBy("doc_id").select(
        i, F.concat(F.lit("http://docs.example/"), "source", F.lit("/"), (i % 700).cast("string")).alias("url"), (i % 40 + 1).cast("string").alias("rank"), F.col("source").alias("title"),
        (i % 10 / 10).cast("string").alias("pageverdict_score"), F.when(i % 4 == 0, "other").alias("source"), F.concat(F.lit(" q "), (i % 4).cast("string")).alias("query"),
    )
    new = stores.result_records(records, "imported")
    now = F.lit("2026-01-01T00:00:00Z")
    first = stores.put(stores.empty(spark, "results"), new, "results", now)
    rated = first.withColumn("rating", F.when(F.col("rank") % 2 == 0, 4)).withColumn("title", F.lit("old"))
    return stores.put(rated, new, "results", now).select("query", "rank", "title", "url", "display_url", "source", "pageverdict_score", "rating")
