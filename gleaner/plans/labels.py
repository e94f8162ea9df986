"""Queries of labeling, duplicates and classifier metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.config import Noise
from gleaner.functions import scoring, text
from gleaner.operators import dedup, labeling, links, metrics
from gleaner.plans.links import EDGES, digest, share, sql_digest, sql_share
from gleaner.plans.registry import query, table

NOISE = Noise()
KEY = "parent_url || '|' || position || '|' || target_url"


def _links(spark, sf):
    """Edges with stand-in verdicts, ratings and sources."""
    key = F.concat_ws("|", "parent_url", F.col("position").cast("string"), "target_url")
    e = links.edges(table(spark, sf, "pages")).withColumn("id", F.concat("parent_url", F.lit("#"), F.lpad(F.col("position").cast("string"), 4, "0")))
    h = digest(key)
    rating = F.when(h % 3 == 0, (h % 5 + 1).cast("int"))
    source = F.when(h % 10 == 0, "curated_link").when(h % 10 < 5, "crawler_link").when(h % 10 < 9, "crawler_linkverdict").otherwise("other")
    verdict = F.when(h % 7 != 0, share(key, "v"))
    return e.select("*", F.floor(share(key, "r") * 12).cast("double").alias("raw_score"), verdict.alias("linkverdict_score"), F.when(h % 4 != 0, share(key, "t")).alias("target_pageverdict_score"), (h % 2 == 0).alias("should_enqueue"), (h % 6 == 0).alias("selected"), F.when(h % 11 == 0, "seen_url").alias("rejection_reason"), rating.alias("rating"), scoring.label_from_rating(rating).alias("label"), source.alias("source"))


LINKS = f"""{EDGES}, hashed AS (SELECT *, {sql_digest(KEY)} AS h, {KEY} AS k FROM edges),
lr AS (SELECT parent_url, position, target_url, target_host, anchor, parent_url || '#' || lpad(position::VARCHAR, 4, '0') AS id, floor({sql_share('k', 'r')} * 12) AS raw_score, CASE WHEN h % 7 <> 0 THEN {sql_share('k', 'v')} END AS linkverdict_score,
 CASE WHEN h % 4 <> 0 THEN {sql_share('k', 't')} END AS target_pageverdict_score, h % 2 = 0 AS should_enqueue, h % 6 = 0 AS selected, CASE WHEN h % 11 = 0 THEN 'seen_url' END AS rejection_reason, CASE WHEN h % 3 = 0 THEN h % 5 + 1 END AS rating,
 CASE WHEN h % 10 = 0 THEN 'curated_link' WHEN h % 10 < 5 THEN 'crawler_link' WHEN h % 10 < 9 THEN 'crawler_linkverdict' ELSE 'other' END AS source FROM hashed),
ours AS (SELECT * FROM lr WHERE source <> 'other'), rated AS (SELECT target_host, count(rating) AS rated_for_host FROM ours GROUP BY 1),
cand AS (SELECT ours.*, rated_for_host,
 (target_url = parent_url OR coalesce(rejection_reason = 'seen_url', false) OR anchor = '' OR regexp_matches(target_host, '{NOISE.hosts}') OR (regexp_matches(target_host, '{NOISE.wiki}') AND target_host NOT IN {NOISE.wiki_kept}) OR regexp_matches(lower(target_url), '{NOISE.url}') OR (contains(lower(target_url), '/search') AND target_host LIKE 'google.%') OR regexp_matches(lower(anchor), '{NOISE.anchor}')) AS noise,
 CASE WHEN source = 'curated_link' THEN 0 WHEN (regexp_matches(lower(target_url), '{NOISE.topic_url}') OR regexp_matches(lower(anchor), '{NOISE.topic_anchor}') OR regexp_matches(target_host, '{NOISE.topic_hosts}')) AND (regexp_matches(lower(target_url), '{NOISE.english_url}') OR regexp_matches(lower(anchor), '[a-z]') OR target_host IN {NOISE.english_hosts}) THEN 0 WHEN selected AND should_enqueue THEN 1 WHEN should_enqueue THEN 2 ELSE 3 END AS priority,
 CASE WHEN raw_score IS NOT NULL THEN len(list_filter([2, 4, 8], lambda b: b > raw_score)) ELSE 4 END AS band,
 CASE WHEN linkverdict_score IS NOT NULL THEN len(list_filter([0.4, 0.75], lambda b: b > linkverdict_score)) ELSE 3 END AS vband,
 coalesce(abs(target_pageverdict_score - 0.5), 1.0) AS tu, coalesce(abs(linkverdict_score - 0.5), 1.0) AS lu FROM ours JOIN rated USING (target_host) WHERE rating IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_host ORDER BY tu, selected DESC, should_enqueue DESC, raw_score DESC, id) AS hr, row_number() OVER (PARTITION BY target_url ORDER BY tu, selected DESC, should_enqueue DESC, raw_score DESC, id) AS ur, row_number() OVER (PARTITION BY band ORDER BY tu, selected DESC, should_enqueue DESC, raw_score DESC, id) AS br FROM cand),
placed AS (SELECT *, row_number() OVER (ORDER BY (source <> 'curated_link'), noise, priority, vband, ur, hr, br, rated_for_host, lu, band, tu, selected DESC, should_enqueue DESC, raw_score DESC, id) AS place FROM ranked)"""


@query("labeling_link_queue", f"WITH {LINKS} SELECT place::INTEGER AS place, id, noise AS navigation_noise, priority::INTEGER AS candidate_priority, hr::INTEGER AS host_round, ur::INTEGER AS url_round, br::INTEGER AS score_band_round, rated_for_host FROM placed WHERE place <= 200")
def labeling_link_queue(spark, sf):
    q = labeling.link_queue(_links(spark, sf), 200)
    return q.select("place", "id", "navigation_noise", "candidate_priority", "host_round", "url_round", F.col("score_band_round").cast("int").alias("score_band_round"), "rated_for_host")


@query("link_label_stats", f"WITH {LINKS}, x AS (SELECT rating, CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'skip' WHEN rating > 3 THEN 'positive' END AS label FROM lr) SELECT 'total' AS kind, '' AS value, count(*) AS n FROM x UNION ALL SELECT 'rated', '', count(rating) FROM x UNION ALL SELECT 'label', label, count(*) FROM x WHERE label IS NOT NULL GROUP BY label UNION ALL SELECT 'rating', rating::VARCHAR, count(*) FROM x WHERE rating IS NOT NULL GROUP BY rating")
def link_label_stats(spark, sf):
    return labeling.label_stats(_links(spark, sf))


@query("link_relabel_export", f"WITH {LINKS} SELECT id, linkverdict_score, row_number() OVER (ORDER BY coalesce(abs(linkverdict_score - 0.5), 0), target_url, parent_url, id) AS rank FROM lr")
def link_relabel_export(spark, sf):
    """Every link, as the crawler's export has them."""
    return labeling.ranked_export(_links(spark, sf)).select("id", "linkverdict_score", "rank")


RESULTS = f"""results AS (SELECT d.doc_id AS id, source, {sql_share('d.doc_id::VARCHAR', 's')} AS pageverdict_score, CASE d.doc_id % 3 WHEN 0 THEN 'false_positive' ELSE 'index_strong' END AS pageverdict_decision, d.doc_id % 100 AS rank, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 4 + d.doc_id % 2 ELSE 1 + d.doc_id % 3 END AS rating
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _results(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    rating = F.when(F.col("quality") == 1, 4 + i % 2).when(F.col("quality") == 0, 1 + i % 3).cast("int")
    return d.select(i.alias("id"), "source", share(i.cast("string"), "s").alias("pageverdict_score"), F.when(i % 3 == 0, "false_positive").otherwise("index_strong").alias("pageverdict_decision"), (i % 100).alias("rank"), rating.alias("rating"), scoring.label_from_rating(rating).alias("label"))


@query("page_queue", f"WITH {RESULTS} SELECT id, row_number() OVER (ORDER BY pageverdict_decision NOT LIKE 'false_%', abs(pageverdict_score - 0.5), pageverdict_score, rank, id)::INTEGER AS place FROM results WHERE source IN ('src0', 'src1', 'src2', 'src3') AND rating IS NULL ORDER BY place LIMIT 200")
def page_queue(spark, sf):
    return labeling.page_queue(_results(spark, sf), ["src0", "src1", "src2", "src3"], 200).select("id", "place")


@query("label_stats", f"WITH {RESULTS}, x AS (SELECT rating, CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'skip' WHEN rating > 3 THEN 'positive' END AS label FROM results) SELECT 'total' AS kind, '' AS value, count(*) AS n FROM x UNION ALL SELECT 'rated', '', count(rating) FROM x UNION ALL SELECT 'label', label, count(*) FROM x WHERE label IS NOT NULL GROUP BY label UNION ALL SELECT 'rating', rating::VARCHAR, count(*) FROM x WHERE rating IS NOT NULL GROUP BY rating")
def label_stats(spark, sf):
    return labeling.label_stats(_results(spark, sf))


@query("rating_to_label", f"WITH {RESULTS} SELECT id, rating::INTEGER AS rating, CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'skip' WHEN rating > 3 THEN 'positive' END AS label FROM results")
def rating_to_label(spark, sf):
    return _results(spark, sf).select("id", "rating", "label")


@query("labelled_examples", f"WITH {RESULTS} SELECT id, CASE WHEN rating <= 2 THEN 'negative' ELSE 'positive' END AS label FROM results WHERE rating <> 3")
def labelled_examples(spark, sf):
    return labeling.labelled(_results(spark, sf)).select("id", "label")


@query("rate_results", f"WITH {RESULTS} SELECT id, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN 5 ELSE rating END::INTEGER AS rating, CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN 'positive' WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'skip' WHEN rating > 3 THEN 'positive' END AS label, CASE WHEN id % 50 = 1 THEN 'now' END AS rated_at FROM results")
def rate_results(spark, sf):
    r = _results(spark, sf).withColumn("rated_at", F.lit(None).cast("string")).select("id", "rating", "label", "rated_at")
    given = r.where("id % 50 < 2").select("id", F.when(F.col("id") % 50 == 1, 5).alias("rating")).unionByName(spark.createDataFrame([(-5, 3)], "id long, rating int"))
    return labeling.rate(r, given, F.lit("now"))


@query("optional_values", "SELECT doc_id, nullif(trunc((doc_id % 7 - 3) / 2.0)::BIGINT, 0) AS whole, nullif((doc_id % 7 - 3) / 2.0::DOUBLE, 0) AS number, doc_id % 3 = 1 AS flag FROM documents")
def optional_values(spark, sf):
    i = F.col("doc_id")
    half = F.concat(F.lit(" "), ((i % 7 - 3) / 2.0).cast("string"), F.lit(" "))
    flag = F.when(i % 3 == 1, " Yes").when(i % 3 == 2, "no")
    return table(spark, sf, "documents").select("doc_id", text.optional_int(half).alias("whole"), text.optional_float(half).alias("number"), text.optional_bool(flag).alias("flag"))


@query("score_buckets", f"WITH s AS (SELECT doc_id, {sql_digest('doc_id::VARCHAR')} % 40 AS v FROM documents) SELECT doc_id, printf('%.2f', round_even(v / 4.0::DOUBLE, 0) * 0.5) AS bucket FROM s")
def score_buckets(spark, sf):
    v = (digest(F.col("doc_id").cast("string")) % 40) / 8.0
    return table(spark, sf, "documents").select("doc_id", text.bucket(v, 0.5).alias("bucket"))


# duplicates

@query("simhash_fingerprint")
def simhash_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", dedup.fingerprint(F.col("text")).alias("fp"))


ONES = lambda half: " + ".join(f"(CASE WHEN 2 * sum(({half} >> {k}) & 1) > count(*) THEN {1 << k} ELSE 0 END)" for k in range(32))


@query("simhash_md5", f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zäöüß0-9]+') AS w FROM documents), s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS shingle FROM w),
h AS (SELECT doc_id, ('0x' || substr(md5(shingle), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(shingle), 9, 8))::BIGINT AS lo FROM s), f AS (SELECT doc_id, ({ONES('hi')})::BIGINT AS high, ({ONES('lo')})::BIGINT AS low FROM h GROUP BY doc_id)
SELECT documents.doc_id, coalesce(high, 0) AS high, coalesce(low, 0) AS low FROM documents LEFT JOIN f ON documents.doc_id = f.doc_id""")
def simhash_md5(spark, sf):
    fp = table(spark, sf, "documents").select("doc_id", dedup.fingerprint_md5(F.col("text")).alias("fp"))
    return fp.select("doc_id", F.shiftrightunsigned("fp", 32).alias("high"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("low"))


def _prints(spark, sf):
    """The fingerprint of every whole text."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), dedup.fingerprint_md5(F.col("text")).alias("fp"))


PRINTS = f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zäöüß0-9]+') AS w FROM documents), s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS shingle FROM w),
h AS (SELECT doc_id, ('0x' || substr(md5(shingle), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(shingle), 9, 8))::BIGINT AS lo FROM s), f AS (SELECT doc_id, ({ONES('hi')})::BIGINT AS high, ({ONES('lo')})::BIGINT AS low FROM h GROUP BY doc_id),
prints AS MATERIALIZED (SELECT documents.doc_id AS id, coalesce(high, 0) AS high, coalesce(low, 0) AS low FROM documents LEFT JOIN f ON documents.doc_id = f.doc_id),
near AS MATERIALIZED (SELECT x.id AS a, y.id AS b, (bit_count(xor(x.high, y.high)) + bit_count(xor(x.low, y.low)))::INTEGER AS distance FROM prints x JOIN prints y ON x.id < y.id AND bit_count(xor(x.high, y.high)) + bit_count(xor(x.low, y.low)) <= 3)"""


@query("near_duplicate_pairs", f"WITH {PRINTS}, rep AS (SELECT high, low, min(id) AS id FROM prints GROUP BY ALL) SELECT near.* FROM near JOIN rep x ON a = x.id JOIN rep y ON b = y.id UNION ALL SELECT rep.id, prints.id, 0 FROM prints JOIN rep USING (high, low) WHERE prints.id <> rep.id")
def near_duplicate_pairs(spark, sf):
    """Pairs between the classes of equal fingerprints of whole texts, and the members of the classes."""
    return dedup.near_pairs(_prints(spark, sf))


@query("greedy_dedup", f"""WITH RECURSIVE {PRINTS}, n AS MATERIALIZED (SELECT b AS id, list(a) AS earlier FROM near GROUP BY b), o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS r FROM n),
g AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS dropped UNION ALL
 SELECT g.r + 1, CASE WHEN len(list_filter(n.earlier, lambda a: NOT list_contains(g.dropped, a))) > 0 THEN list_append(g.dropped, n.id) ELSE g.dropped END FROM g JOIN o ON o.r = g.r + 1 JOIN n ON n.id = o.id),
d AS (SELECT unnest(dropped) AS id FROM (SELECT dropped FROM g ORDER BY r DESC LIMIT 1))
SELECT prints.id, d.id IS NULL AS kept FROM prints LEFT JOIN d USING (id)""")
def greedy_dedup(spark, sf):
    """The first of near whole texts stays."""
    return dedup.greedy_keep(_prints(spark, sf))


@query("crawler_dedup")
def crawler_dedup(spark, sf):
    prints = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), dedup.fingerprint(F.col("text")).alias("fp"))
    return dedup.greedy_keep(prints)


# metrics

PREDICTED = f"pred AS (SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label, round(0.5 * {sql_share('doc_id::VARCHAR', 'p')} + 0.4 * quality, 3) AS probability FROM labels)"


def _predicted(spark, sf):
    p = F.round(0.5 * share(F.col("doc_id").cast("string"), "p") + 0.4 * F.col("quality"), 3)
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"), p.alias("probability"))


SWEEP = f"""{PREDICTED}, t AS (SELECT unnest(range(2, 10)) / 10 AS threshold),
c AS (SELECT threshold, count(*) FILTER (probability >= threshold AND label = 'positive') AS tp, count(*) FILTER (probability >= threshold AND label <> 'positive') AS fp, count(*) FILTER (probability < threshold AND label = 'positive') AS fn, count(*) FILTER (probability < threshold AND label <> 'positive') AS tn FROM t, pred GROUP BY threshold),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM m)"""


@query("threshold_metrics", f"WITH {SWEEP} SELECT threshold, tp + fn AS support, tp + fp AS predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f")
def threshold_metrics(spark, sf):
    m = metrics.threshold_metrics(_predicted(spark, sf))
    return m.select("threshold", "support", "predicted", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("confusion_matrix", f"WITH {SWEEP} SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM f WHERE threshold = 0.5")
def confusion_matrix(spark, sf):
    return metrics.threshold_metrics(_predicted(spark, sf), (0.5,)).select("tp", "fp", "fn", "tn", F.round("accuracy", 6).alias("accuracy"))


@query("roc_auc", f"WITH {PREDICTED} SELECT round(sum(CASE WHEN x.probability > y.probability THEN 1 WHEN x.probability = y.probability THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS roc_auc FROM pred x, pred y WHERE x.label = 'positive' AND y.label = 'negative'")
def roc_auc(spark, sf):
    return metrics.ranking_metrics(_predicted(spark, sf)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("average_precision", f"WITH {PREDICTED}, g AS (SELECT probability, count(*) FILTER (label = 'positive') AS pos, count(*) AS n FROM pred GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER () AS p FROM g WINDOW w AS (ORDER BY probability DESC)) SELECT round(sum(pos / p * tp / k), 6) AS average_precision FROM c")
def average_precision(spark, sf):
    return metrics.ranking_metrics(_predicted(spark, sf)).select(F.round("average_precision", 6).alias("average_precision"))


@query("select_threshold", f"WITH {SWEEP} SELECT threshold FROM f WHERE p >= 0.8 ORDER BY f1 DESC, r DESC, threshold DESC LIMIT 1")
def select_threshold(spark, sf):
    return metrics.select_threshold(metrics.threshold_metrics(_predicted(spark, sf))).select("threshold")


@query("host_label_counts", "SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label, count(DISTINCT source) AS hosts FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def host_label_counts(spark, sf):
    rows = _predicted(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.col("source").alias("host")), "doc_id")
    return metrics.host_label_counts(rows)


@query("label_counts", f"WITH {PREDICTED} SELECT label, count(*) AS n FROM pred GROUP BY label")
def label_counts(spark, sf):
    return metrics.label_counts(_predicted(spark, sf))
