"""Queries opN_<name> and pipeline: each operator over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import decontam, language, lattice, mixing, simhash, suffix_array, token_count, toxicity, url_filter, warc
from gleaner.llm.common import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeats(_read(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\f\r]+'))::BIGINT AS tokens,
         ('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 12))::BIGINT AS key
  FROM documents WHERE doc_id IS NOT NULL
), placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id) - tokens AS start,
         sum(tokens) OVER (PARTITION BY source) AS source_tokens
  FROM sized WHERE tokens > 0
), goals AS (
  SELECT count(DISTINCT coalesce(source, '')) AS sources, sum(tokens) AS total FROM placed
), goal AS (
  SELECT placed.*, (total // sources)::BIGINT AS goal FROM placed, goals
)
SELECT doc_id, source, epoch::INTEGER AS epoch, tokens,
       least(tokens, goal - start - epoch * source_tokens)::BIGINT AS taken
FROM (SELECT *, unnest(range(0, ((goal - 1 - start) // source_tokens + 1)::BIGINT)) AS epoch FROM goal WHERE start < goal)
"""


@query("op5_source_mixing", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(_read(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_spans(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query("op6_lattice_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_read(spark, sf_dir, "embeddings"))


@query("op9_warc_records", "SELECT page_id, url, html, strlen(html)::BIGINT AS payload_bytes FROM pages")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back by blocks."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(_read(spark, sf_dir, "pages"), folder)
    records = warc.read_warc(spark, folder, glob="*.txt")
    return records.select("page_id", "url", "html", F.octet_length("html").cast("long").alias("payload_bytes"))


HOST_SQL = r"regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)', 1), '\.$', '')"

OP10_SQL = rf"""
WITH captures AS (
  SELECT DISTINCT page_id, url, 1704067200 + (page_id % 8760) * 3600 AS fetched_at, {HOST_SQL} AS host,
         list_filter(string_split(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') AS segments
  FROM pages
), hosts AS (
  SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM captures WHERE host <> ''
), entries AS (
  SELECT host AS pattern, 'block' AS verdict, 1704067200 + (h % 200) * 86400 AS effective_at FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT host, NULL, 1704067200 + (h % 200 + 30 + h % 60) * 86400 FROM hosts WHERE h % 6 = 0
  UNION ALL SELECT host || '/en', 'allow', 1704067200 + (h % 150) * 86400 FROM hosts WHERE h % 5 = 0
  UNION ALL SELECT DISTINCT regexp_replace(host, '^.*\.([^.]+\.[^.]+)$', '\1'), 'block', 1704067200 + 86400 * 300 FROM hosts
), once AS (
  SELECT pattern, effective_at AS valid_from, max(verdict) AS verdict FROM entries GROUP BY ALL
), active AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM once
), candidates AS (
  SELECT page_id, url, fetched_at, unnest(list_distinct(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
    || list_transform(range(1, len(segments) + 1), lambda i: host || '/' || array_to_string(segments[1:i], '/')))) AS pattern
  FROM captures WHERE host <> ''
), matches AS (
  SELECT page_id, url, fetched_at, max(struct_pack(n := length(pattern), pattern := pattern, verdict := verdict)) AS best
  FROM candidates JOIN active USING (pattern)
  WHERE verdict IS NOT NULL AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
  GROUP BY ALL
)
SELECT c.page_id, c.url, c.fetched_at, m.best.pattern AS pattern, m.best.verdict AS verdict, coalesce(m.best.verdict = 'block', false) AS blocked
FROM captures c LEFT JOIN matches m ON c.page_id IS NOT DISTINCT FROM m.page_id AND c.url IS NOT DISTINCT FROM m.url
"""


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated filter list over the hosts of ``pages``; the tables hold none."""
    start, day = 1704067200, 86400
    hosts = pages.select(url_filter.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))
    h, blocked, allowed = F.col("h"), F.lit("block"), F.lit("allow")
    entry = lambda rows, pattern, verdict, days: rows.select(pattern.alias("pattern"), verdict.cast("string").alias("verdict"), (start + days * day).cast("long").alias("effective_at"))
    return (
        entry(hosts.where("h % 3 = 0"), F.col("host"), blocked, h % 200)
        .union(entry(hosts.where("h % 6 = 0"), F.col("host"), F.lit(None), h % 200 + 30 + h % 60))
        .union(entry(hosts.where("h % 5 = 0"), F.concat("host", F.lit("/en")), allowed, h % 150))
        .union(entry(hosts, F.regexp_replace("host", r"^.*\.([^.]+\.[^.]+)$", "$1"), blocked, F.lit(300)).distinct())
    )


@query("op10_url_filters", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    captures = pages.withColumn("fetched_at", 1704067200 + (F.col("page_id") % 8760) * 3600)
    return url_filter.evaluate(captures, dated_list(pages))
