"""Queries of urls, links, pages and the crawl report over ``pages`` and ``documents``.

Scores that a model would give stand in as parts of md5 digests, equal in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.config import LinkSkip, Topic
from gleaner.functions import scoring, text, urls
from gleaner.operators import links, pages, report
from gleaner.plans.registry import query, table


def digest(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 10), 16, 10).cast("long")


def share(value: Column, salt: str = "") -> Column:
    """A number in [0, 1) of three places from a text."""
    return (digest(F.concat(value, F.lit(salt))) % 1000) / 1000.0


def sql_digest(value: str) -> str:
    return f"('0x' || substr(md5({value}), 1, 10))::BIGINT"


def sql_share(value: str, salt: str = "") -> str:
    return f"(({sql_digest(f'{value} || {salt!r}')} % 1000) / 1000.0::DOUBLE)"


HOST = r"regexp_replace(lower(regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')"
PATH = r"regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract({0}, '^[^?#]*\?([^#]*)', 1)"
CANON = r"(regexp_extract({0}, '^([a-z]+://)', 1) || lower(regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1)) || CASE WHEN {1} = '/' THEN '/' ELSE rtrim(regexp_replace({1}, ';[^/]*$', ''), '/') END)"
canon = lambda u: CANON.format(u, PATH.format(u))


@query("normalize_host", f"SELECT url, {HOST.format('url')} AS host FROM pages")
def normalize_host(spark, sf):
    return table(spark, sf, "pages").select("url", urls.host_of(F.col("url")).alias("host"))


@query("canonical_url_absolute", f"SELECT url, {canon('url')} AS canonical FROM pages")
def canonical_url_absolute(spark, sf):
    return table(spark, sf, "pages").select("url", urls.canonical_absolute(F.col("url")).alias("canonical"))


@query("canonical_url_resolved", f"SELECT url, {canon('url')} AS canonical FROM pages")
def canonical_url_resolved(spark, sf):
    return table(spark, sf, "pages").select("url", urls.canonical_url(F.concat(F.lit("?x=1#"), F.lit("y")), F.col("url")).alias("canonical"))


@query("normalized_url", rf"SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN {PATH.format('url')} IN ('', '/') THEN '/' ELSE rtrim({PATH.format('url')}, '/') END || CASE WHEN {QUERY.format('url')} = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split({QUERY.format('url')}, '&')), '&') END AS normalized FROM pages")
def normalized_url(spark, sf):
    return table(spark, sf, "pages").select("url", urls.normalized_url(F.col("url")).alias("normalized"))


SLUG = rf"trim(translate(CASE WHEN trim({PATH.format('url')}, '/') = '' THEN 'index' ELSE trim({PATH.format('url')}, '/') END || CASE WHEN {QUERY.format('url')} = '' THEN '' ELSE '-' || {QUERY.format('url')} END, '/?&=:@%#', '--------'), '-._')"


@query("url_slug", f"SELECT url, lower({SLUG}) AS slug, {HOST.format('url')} || '/' || substr(sha256(url), 1, 8) || '-' || lower({SLUG}) || '.html' AS saved_path FROM pages")
def url_slug(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("url", urls.url_slug(u).alias("slug"), urls.saved_path(urls.host_of(u), u).alias("saved_path"))


SEGMENTS = f"list_filter(string_split({PATH.format('url')}, '/'), lambda s: s <> '')"


@query("url_family", f"SELECT url, {HOST.format('url')} || '|' || coalesce(lower(({SEGMENTS})[1]), '') || '|' || CASE WHEN lower(({SEGMENTS})[1]) IN ('de', 'en') THEN coalesce(lower(({SEGMENTS})[2]), '') ELSE '' END AS family, array_to_string(list_filter(regexp_split_to_array(lower({PATH.format('url')}), '[/_.:-]+'), lambda s: s <> ''), ' ') AS path_text FROM pages")
def url_family(spark, sf):
    return table(spark, sf, "pages").select("url", urls.url_family(F.col("url")).alias("family"), urls.path_text(F.col("url")).alias("path_text"))


@query("strip_scheme", "SELECT url, trim(replace(replace(url, 'https://', ''), 'http://', ''), '/') AS bare FROM pages")
def strip_scheme(spark, sf):
    return table(spark, sf, "pages").select("url", urls.strip_scheme(F.col("url")).alias("bare"))


RAW = r"""raw AS (SELECT url AS parent_url, unnest(range(len(m))) AS position, unnest(m) AS link FROM (SELECT url, regexp_extract_all(html, '<a href="[^"]+">[^<]*</a>') AS m FROM pages)),
links AS (SELECT parent_url, position, regexp_extract(link, '<a href="([^"]+)">', 1) AS href, regexp_extract(link, '">([^<]*)</a>', 1) AS anchor FROM raw)"""
EDGES = f"""{RAW}, abs AS (SELECT *, CASE WHEN href LIKE '/%' THEN regexp_extract(parent_url, '^([a-z]+://[^/?#]+)', 1) || href ELSE href END AS full_url FROM links),
edges AS (SELECT parent_url, {HOST.format('parent_url')} AS parent_host, position, {canon('full_url')} AS target_url, {HOST.format('full_url')} AS target_host, anchor FROM abs)"""


@query("extract_links", f"WITH {RAW} SELECT parent_url, position::INTEGER AS position, href, anchor FROM links")
def extract_links(spark, sf):
    return links.extract(table(spark, sf, "pages"))


@query("outgoing_edges", f"WITH {EDGES} SELECT parent_url, parent_host, position::INTEGER AS position, target_url, target_host, anchor FROM edges")
def outgoing_edges(spark, sf):
    return links.edges(table(spark, sf, "pages"))


@query("unseen_links", f"WITH {EDGES}, seen AS (SELECT target_url FROM edges WHERE {sql_digest('parent_url')} % 4 = 0) SELECT parent_url, position::INTEGER AS position, target_url FROM edges WHERE target_url NOT IN (SELECT target_url FROM seen)")
def unseen_links(spark, sf):
    e = links.edges(table(spark, sf, "pages"))
    seen = e.where(digest(F.col("parent_url")) % 4 == 0).select(F.col("target_url").alias("url"))
    return links.unseen(e, seen).select("parent_url", "position", "target_url")


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SKIP = LinkSkip()
SKIP_SQL = (
    "({host} IN " + _in(SKIP.hosts) + " OR regexp_matches({host}, '(" + "|".join(s.replace(".", r"\.") for s in SKIP.host_suffixes) + ")$')"
    " OR regexp_matches(lower({url}), '(" + "|".join(s.replace(".", r"\.") for s in SKIP.suffixes) + ")$')"
    " OR regexp_extract({path}, '^/*([^/_-]*)', 1) IN " + _in(SKIP.languages) + " OR list_has_any(regexp_extract_all({path}, '[a-z]+'), ['" + "', '".join(SKIP.path_words) + "']))"
)


def skip_sql(url: str) -> str:
    return SKIP_SQL.replace("{host}", HOST.format(url)).replace("{path}", f"lower(url_decode({PATH.format(url)}))").replace("{url}", url)


@query("link_skip_filter", f"WITH {EDGES}, u AS (SELECT target_url AS url FROM edges UNION SELECT url FROM pages) SELECT url, {skip_sql('url')} AS skipped FROM u")
def link_skip_filter(spark, sf):
    p = table(spark, sf, "pages")
    u = links.edges(p).select(F.col("target_url").alias("url")).union(p.select("url")).distinct()
    return u.select("url", urls.is_skippable(F.col("url")).alias("skipped"))


GATED = f"""{EDGES}, scored AS (SELECT *, {skip_sql('target_url')} AS skipped, {sql_share('target_url')} AS s, {sql_digest('parent_url')} % 7 AS depth FROM edges),
gated AS (SELECT *, CASE WHEN NOT skipped THEN s END AS verdict_score, CASE WHEN skipped OR s < 0.35 OR depth > 5 THEN 'not_enqueued' END AS reason, coalesce(CASE WHEN NOT skipped THEN s * 10 END, 0) AS frontier FROM scored)"""


def _gated(spark, sf):
    e = links.edges(table(spark, sf, "pages"))
    return links.gated(e, share(F.col("target_url")), (digest(F.col("parent_url")) % 7).cast("int"))


@query("link_enqueue_gate", f"WITH {GATED} SELECT parent_url, position::INTEGER AS position, target_url, skipped, verdict_score, round(frontier, 6) AS frontier_score, reason AS rejection_reason FROM gated")
def link_enqueue_gate(spark, sf):
    return _gated(spark, sf).select("parent_url", "position", "target_url", "skipped", "verdict_score", F.round("frontier_score", 6).alias("frontier_score"), "rejection_reason")


FAMILY = SEGMENTS.replace("url", "target_url")
BUDGETED = f"""{GATED}, fit AS (SELECT *, target_host || '|' || coalesce(lower(({FAMILY})[1]), '') || '|' || CASE WHEN lower(({FAMILY})[1]) IN ('de', 'en') THEN coalesce(lower(({FAMILY})[2]), '') ELSE '' END AS family FROM gated WHERE reason IS NULL),
f1 AS (SELECT *, row_number() OVER (PARTITION BY parent_url, target_host, family ORDER BY frontier DESC, position) AS fam FROM fit),
f2 AS (SELECT *, coalesce(sum((fam <= 3)::INT) OVER (PARTITION BY parent_url, target_host ORDER BY frontier DESC, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f1),
decided AS (SELECT parent_url, parent_host, position, target_url, target_host, anchor, verdict_score, frontier, CASE WHEN before >= 8 THEN 'page_host_budget' WHEN fam > 3 THEN 'page_family_budget' END AS reason FROM f2
UNION ALL SELECT parent_url, parent_host, position, target_url, target_host, anchor, verdict_score, frontier, reason FROM gated WHERE reason IS NOT NULL)"""


def _decided(spark, sf):
    return links.decided(links.budgeted(_gated(spark, sf)))


@query("link_page_budget", f"WITH {BUDGETED} SELECT parent_url, position::INTEGER AS position, target_url, reason AS rejection_reason, coalesce(reason, '') NOT IN ('not_enqueued', 'host_off_topic') AS should_enqueue, reason IS NULL AS selected FROM decided")
def link_page_budget(spark, sf):
    return _decided(spark, sf).select("parent_url", "position", "target_url", "rejection_reason", "should_enqueue", "selected")


@query("frontier_priority", f"""WITH {BUDGETED}, q AS (SELECT target_host, count(*) AS queued FROM decided WHERE reason IS NULL GROUP BY 1), h AS (SELECT {HOST.format('url')} AS host, count(*) AS saved FROM pages GROUP BY 1)
SELECT parent_url, position::INTEGER AS position, round(frontier - 0.7 * ({sql_digest('parent_url')} % 7) - 0.9 * ln(1 + queued + coalesce(saved, 0)), 6) AS priority FROM decided JOIN q USING (target_host) LEFT JOIN h ON host = target_host WHERE reason IS NULL""")
def frontier_priority(spark, sf):
    d = _decided(spark, sf).where("selected")
    queued = d.groupBy("target_host").agg(F.count("*").alias("queued"))
    saved = report.counts(_hosts(spark, sf), "host").select(F.col("host").alias("target_host"), F.col("n").alias("saved"))
    out = d.join(queued, "target_host").join(saved, "target_host", "left").fillna(0, ["saved"])
    depth = digest(F.col("parent_url")) % 7
    return out.select("parent_url", "position", F.round(scoring.push_priority(F.col("frontier_score"), depth, F.col("queued"), F.col("saved")), 6).alias("priority"))


@query("first_wins_dedup", f"WITH {EDGES} SELECT parent_url, target_url, anchor, min(position)::INTEGER AS position FROM edges GROUP BY ALL")
def first_wins_dedup(spark, sf):
    e = links.edges(table(spark, sf, "pages"))
    return links.first_wins(e, ["parent_url", "target_url", "anchor"], [F.col("position")]).select("parent_url", "target_url", "anchor", "position")


STATUS = f"CASE {sql_digest('target_url || anchor || position')} % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'rejected' WHEN 2 THEN 'rejected' END"


def _with_status(e):
    d = digest(F.concat("target_url", "anchor", F.col("position").cast("string"))) % 4
    return e.withColumn("target_status", F.when(d == 0, "page").when(d < 3, "rejected"))


@query("outcome_mining", f"""WITH {EDGES}, ids AS (SELECT *, {STATUS} AS status, row_number() OVER (ORDER BY parent_url, position) AS id FROM edges),
r AS (SELECT *, row_number() OVER (PARTITION BY target_url ORDER BY id) AS n, max((status = 'page')::INT) OVER (PARTITION BY target_url) AS good FROM ids WHERE status IS NOT NULL)
SELECT parent_url, target_url, position::INTEGER AS position, CASE WHEN good = 1 THEN 'positive' ELSE 'negative' END AS label FROM r WHERE n <= 3""")
def outcome_mining(spark, sf):
    e = _with_status(links.edges(table(spark, sf, "pages"))).withColumn("id", F.struct("parent_url", "position"))
    return links.outcome_examples(e).select("parent_url", "target_url", "position", "label")


@query("link_frontier_report", f"""WITH {BUDGETED}, o AS (SELECT *, {STATUS} AS status FROM decided WHERE reason IS NULL)
SELECT count(*) AS enqueued, round(count(*) FILTER (parent_host = target_host) / nullif(count(*), 0), 4) AS same_host_share, count(status) AS enqueued_fetched, round(count(*) FILTER (status = 'page') / nullif(count(status), 0), 4) AS precision_at_enqueue FROM o""")
def link_frontier_report(spark, sf):
    return report.link_frontier(_with_status(_decided(spark, sf)))


# pages: documents with a stand-in score; about one in ten gets a topical title
TOPIC = Topic()
PAGES = f"""judged AS (SELECT doc_id AS id, source AS host, lang = 'en' AS english, {sql_share("doc_id::VARCHAR")} AS score, (doc_id % 10 < 6 OR regexp_matches(lower(text), '{TOPIC.pattern}')) AS topical, doc_id % 6 AS crawl_depth FROM documents),
gate AS (SELECT *, CASE WHEN NOT english THEN 'non_english' WHEN score < 0.6 THEN 'low_pageverdict_score' WHEN NOT topical THEN 'off_topic' END AS reason FROM judged)"""


def _pages(spark, sf):
    d = table(spark, sf, "documents")
    titled = d.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), F.when(F.col("doc_id") % 10 < 6, "Cyber Valley").alias("title"), F.lit("").alias("url"), "text", F.col("lang").alias("language"), (F.col("doc_id") % 6).cast("int").alias("crawl_depth"))
    return pages.judged(titled, share(F.col("id").cast("string")))


def _saved(spark, sf):
    return _pages(spark, sf).where("exclusion_reason is null")


def _rejected(spark, sf):
    return _pages(spark, sf).where("exclusion_reason is not null")


def _hosts(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), urls.host_of(F.col("url")).alias("host"))


@query("page_decision", f"WITH {PAGES} SELECT id, topical, reason AS exclusion_reason, CASE WHEN reason IS NULL AND score >= 0.8 THEN 'index_strong' WHEN reason IS NULL THEN 'index_cautious' ELSE 'reject_follow' END AS decision FROM gate")
def page_decision(spark, sf):
    return _pages(spark, sf).select("id", "topical", "exclusion_reason", "decision")


@query("relevance_score", f"WITH {PAGES} SELECT id, round(CASE WHEN score >= 0.8 THEN 6 + 4 * (score - 0.8::DOUBLE) / 0.2::DOUBLE WHEN score >= 0.6 THEN 3 + 2 * (score - 0.6::DOUBLE) / 0.2::DOUBLE ELSE 2 * score / 0.6::DOUBLE END, 6) AS relevance FROM gate")
def relevance_score(spark, sf):
    return _pages(spark, sf).select("id", F.round("relevance", 6).alias("relevance"))


@query("exclusion_reasons", f"WITH {PAGES} SELECT reason AS exclusion_reason, count(*) AS n FROM gate WHERE reason IS NOT NULL GROUP BY 1")
def exclusion_reasons(spark, sf):
    return report.counts(_rejected(spark, sf), "exclusion_reason")


@query("host_counts", f"SELECT {HOST.format('url')} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, sf):
    return report.counts(_hosts(spark, sf), "host")


@query("top_hosts", f"SELECT {HOST.format('url')} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 12")
def top_hosts(spark, sf):
    return report.top_hosts(_hosts(spark, sf))


@query("depth_distribution", f"WITH {PAGES} SELECT crawl_depth::INTEGER AS crawl_depth, count(*) AS n FROM gate WHERE reason IS NULL GROUP BY 1")
def depth_distribution(spark, sf):
    return report.depth_distribution(_saved(spark, sf))


@query("host_entropy", f"WITH c AS (SELECT {HOST.format('url')} AS host, count(*) AS n FROM pages GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c), e AS (SELECT count(*) AS k, -sum(p * log2(p)) AS h FROM p) SELECT k AS distinct_hosts, round(round(h, 9), 3) AS host_entropy_bits, round(round(h / CASE WHEN k > 1 THEN log2(k) ELSE 1 END, 9), 4) AS host_evenness FROM e")
def host_entropy(spark, sf):
    return report.entropy(_hosts(spark, sf))


@query("diversity_at_n", f"WITH p AS (SELECT {HOST.format('url')} AS host, row_number() OVER (ORDER BY page_id) AS r FROM pages) SELECT n::INTEGER AS n, count(DISTINCT host) FILTER (r <= n) AS hosts FROM p, (VALUES (50), (100)) v(n) GROUP BY n")
def diversity_at_n(spark, sf):
    return report.diversity(_hosts(spark, sf))


@query("harvest_rates", f"WITH {PAGES} SELECT count(*) AS fetched, count(*) FILTER (reason IS NULL) AS saved, count(reason) AS rejected, round(count(*) FILTER (reason IS NULL) / count(*), 4) AS harvest_rate, 0.0::DOUBLE AS duplicate_rate, round(count(*) FILTER (reason IS NULL AND crawl_depth >= 3) / count(*) FILTER (reason IS NULL), 4) AS deep_share_ge3 FROM gate")
def harvest_rates(spark, sf):
    return report.rates(_saved(spark, sf), _rejected(spark, sf))


@query("scored_union_export", f"WITH {PAGES} SELECT id, host, score, reason AS exclusion_reason, CASE WHEN reason IS NULL THEN 'pages' ELSE 'rejected_pages' END AS source_table FROM gate")
def scored_union_export(spark, sf):
    u = pages.scored_union(_saved(spark, sf).drop("exclusion_reason"), _rejected(spark, sf))
    return u.select("id", "host", "score", "exclusion_reason", "source_table")


@query("page_snippets", r"SELECT page_id, substr(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')), 1, 700) AS snippet FROM pages")
def page_snippets(spark, sf):
    title, body = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_replace("html", "<[^>]*>", " ")
    return table(spark, sf, "pages").select("page_id", text.page_snippet(F.nullif(title, F.lit("")), title, body).alias("snippet"))


@query("keyed_upsert", "WITH o AS (SELECT doc_id, source, n_chars, lang FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, source || '+' AS source, n_chars + 1 AS n_chars, 'new' AS lang FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.source, o.source) AS source, coalesce(o.n_chars, n.n_chars) AS n_chars, CASE WHEN o.doc_id IS NOT NULL AND coalesce(o.lang, '') <> '' THEN o.lang ELSE n.lang END AS lang FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def keyed_upsert(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "lang")
    new = d.where("doc_id % 2 = 0 or doc_id % 3 = 0").select("doc_id", F.concat("source", F.lit("+")).alias("source"), (F.col("n_chars") + 1).alias("n_chars"), F.lit("new").alias("lang"))
    return pages.upsert(d.where("doc_id % 3 <> 0"), new, ["doc_id"], keep=["n_chars"], fill=["lang"])


@query("outcome_backfill", f"WITH {EDGES}, t AS (SELECT DISTINCT target_url FROM edges WHERE {sql_digest('target_url')} % 2 = 0) SELECT parent_url, position::INTEGER AS position, target_url, CASE WHEN t.target_url IS NOT NULL THEN CASE WHEN {sql_digest('target_url')} % 3 = 0 THEN 'page' ELSE 'rejected' END END AS target_status FROM edges LEFT JOIN t USING (target_url)")
def outcome_backfill(spark, sf):
    e = links.edges(table(spark, sf, "pages"))
    h = digest(F.col("target_url"))
    outcomes = e.select("target_url").distinct().where(h % 2 == 0).withColumn("target_status", F.when(h % 3 == 0, "page").otherwise("rejected"))
    return pages.backfill(e, outcomes).select("parent_url", "position", "target_url", "target_status")
