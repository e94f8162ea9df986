"""Labeling queues, ratings, imports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Noise
from gleaner.functions import scoring, text, urls
from gleaner.operators.pages import upsert
from gleaner.plans.shared import checkpoint_folder

MAX_LIMIT = 2000


def navigation_noise(n: Noise = Noise()) -> Column:
    c = F.col
    anchor, url, host = F.lower("anchor"), F.lower("target_url"), F.lower("target_host")
    rules = [
        c("target_url") == c("parent_url"),
        c("rejection_reason") == "seen_url",
        c("anchor") == "",
        c("target_host").rlike(n.hosts),
        host.rlike(n.wiki) & ~c("target_host").isin(*n.wiki_kept),
        url.rlike(n.url),
        url.contains("/search") & host.startswith("google."),
        anchor.rlike(n.anchor),
    ]
    noisy = F.lit(False)
    for r in rules:
        noisy = noisy | F.coalesce(r, F.lit(False))
    return noisy


def candidate_priority(n: Noise = Noise()) -> Column:
    c = F.col
    anchor, url = F.lower("anchor"), F.lower("target_url")
    topical = url.rlike(n.topic_url) | anchor.rlike(n.topic_anchor) | F.lower("target_host").rlike(n.topic_hosts)
    english = url.rlike(n.english_url) | anchor.rlike("[a-z]") | c("target_host").isin(*n.english_hosts)
    return F.when(c("source") == "curated_link", 0).when(topical & english, 0).when(c("selected") & c("should_enqueue"), 1).when(c("should_enqueue"), 2).otherwise(3)


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), 4).when(score >= 8, 0).when(score >= 4, 1).when(score >= 2, 2).otherwise(3)


def verdict_band(score: Column) -> Column:
    return F.when(score.isNull(), 3).when(score >= 0.75, 0).when(score >= 0.4, 1).otherwise(2)


def uncertainty(score: Column) -> Column:
    return F.coalesce(F.abs(score - 0.5), F.lit(1.0))


def link_queue(links: DataFrame, limit: int, unlabeled_only: bool = True, noise: Noise = Noise()) -> DataFrame:
    """The next links to label, rounds of hosts, urls and score bands interleaved; with ``place`` from 1.

    How many links of a host are rated counts every link of the queue's sources,
    so the aggregate is taken before the rated ones are left out.  There are five
    score bands, so their rounds are counted over a range sort; no task holds a band.
    """
    ours = links.where(F.col("source").isin(*noise.sources))
    rated = ours.groupBy("target_host").agg(F.count("rating").alias("rated_for_host"))
    rows = ours.where("rating is null") if unlabeled_only else ours
    rows = rows.join(rated, "target_host", "left").fillna(0, ["rated_for_host"]).select(
        "*",
        navigation_noise(noise).alias("navigation_noise"),
        candidate_priority(noise).alias("candidate_priority"),
        score_band(F.col("raw_score")).alias("score_band"),
        verdict_band(F.col("linkverdict_score")).alias("linkverdict_band"),
        uncertainty(F.col("target_pageverdict_score")).alias("target_uncertainty"),
        uncertainty(F.col("linkverdict_score")).alias("link_uncertainty"),
        F.when(F.col("source") == "curated_link", 0).otherwise(1).alias("source_priority"),
    )
    last = [F.col("selected").desc(), F.col("should_enqueue").desc(), F.col("raw_score").desc(), F.col("id")]
    best = [F.col("rating").isNotNull(), F.col("target_uncertainty"), *last]
    rows = ranked_within(rows, "score_band", best, "score_band_round")
    for name, key in (("host_round", "target_host"), ("url_round", "target_url")):
        rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*best)))
    curated, rounds, doubts = ["source_priority", "navigation_noise", "candidate_priority"], [f"{r}_round" for r in ("url", "host", "score_band")], ["link_uncertainty", "score_band", "target_uncertainty"]
    order = [*curated, "linkverdict_band", *rounds, "rated_for_host", *doubts]
    queue = rows.orderBy(*order, *last).limit(max(1, min(limit, MAX_LIMIT)))
    return queue.withColumn("place", F.row_number().over(Window.orderBy(*order, *last)))


def page_queue(results: DataFrame, sources: list[str], limit: int, unlabeled_only: bool = True) -> DataFrame:
    """The next pages to label: wrong decisions first, then by nearness to one half."""
    rows = results.where(F.col("source").isin(*sources) & F.col("pageverdict_score").isNotNull()) if sources else results.limit(0)
    if unlabeled_only:
        rows = rows.where("rating is null")
    order = [F.when(F.col("pageverdict_decision").ilike("false_%"), 0).otherwise(1), F.abs(F.col("pageverdict_score") - 0.5), F.col("pageverdict_score"), F.col("rank"), F.col("id")]
    return rows.orderBy(*order).limit(max(1, min(limit, MAX_LIMIT))).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def results_for(results: DataFrame, query: str) -> DataFrame:
    return results.where(F.col("query") == " ".join(query.split())).orderBy("page_number", "rank", "id")


def label_stats(results: DataFrame) -> DataFrame:
    """(kind, value, n): total, rated, by label and by rating, in one aggregation."""
    kinds = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")),
        F.when(F.col("rating").isNotNull(), F.struct(F.lit("rated").alias("kind"), F.lit("").alias("value"))),
        F.when(F.col("label").isNotNull(), F.struct(F.lit("label").alias("kind"), F.col("label").alias("value"))),
        F.when(F.col("rating").isNotNull(), F.struct(F.lit("rating").alias("kind"), F.col("rating").cast("string").alias("value"))),
    )
    return results.select(F.explode(F.array_compact(kinds)).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def rate(results: DataFrame, ratings: DataFrame, now: Column | None = None) -> DataFrame:
    """``results`` with (id, rating) written: label and rated_at follow; a NULL rating undoes."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if now is None else now
    fresh = ratings.select("id", F.col("rating").cast("int").alias("rating"), scoring.label_from_rating(F.col("rating")).alias("label"), F.when(F.col("rating").isNotNull(), stamp).alias("rated_at"))
    fresh = fresh.where("rating is null or rating between 1 and 5").join(results.select("id"), "id", "left_semi")
    return upsert(results, fresh, ["id"])


def page_candidates(rows: DataFrame, query: str, zero_is_missing: bool = True) -> DataFrame:
    """Imported page rows, typed; rows without a url go, the rank falls back to the row's place."""
    c = F.col
    placed = ranked_within(rows.withColumns({"_all": F.lit(0), "_id": F.monotonically_increasing_id()}), "_all", [F.col("_id")], "_n")
    return placed.where("trim(coalesce(url, '')) <> ''").select(
        F.coalesce(F.nullif(F.trim(c("query")), F.lit("")), F.lit(query)).alias("query"),
        F.trim(c("url")).alias("url"),
        urls.normalized_url(c("url")).alias("normalized_url"),
        F.coalesce(text.optional_int(c("rank"), zero_is_missing), c("_n")).alias("rank"),
        text.collapse(c("title")).alias("title"),
        text.collapse(c("snippet")).alias("snippet"),
        F.coalesce(c("source"), F.lit("crawler_pageverdict")).alias("source"),
        text.optional_float(c("pageverdict_score"), zero_is_missing).alias("pageverdict_score"),
        c("pageverdict_label"),
        c("pageverdict_decision"),
    )


def link_candidates(rows: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """Imported link rows, typed; the target falls back to url and hosts to those of the urls."""
    c = F.col
    pick = lambda *names: F.coalesce(*(F.nullif(F.trim(c(n)), F.lit("")) for n in names if n in rows.columns), F.lit(None).cast("string"))
    typed = rows.withColumn("target_url", pick("target_url", "url")).where("target_url is not null")
    return typed.select(
        pick("parent_url").alias("parent_url"),
        F.coalesce(pick("parent_host"), urls.host_of(c("parent_url"))).alias("parent_host"),
        c("target_url"),
        F.coalesce(pick("target_host"), urls.host_of(c("target_url"))).alias("target_host"),
        text.collapse(c("anchor")).alias("anchor"),
        text.optional_float(c("raw_score"), zero_is_missing).alias("raw_score"),
        text.optional_float(c("linkverdict_score"), zero_is_missing).alias("linkverdict_score"),
        text.optional_bool(c("should_enqueue")).alias("should_enqueue"),
        text.optional_bool(c("selected")).alias("selected"),
    )


def page_export(scored: DataFrame) -> DataFrame:
    """Scored pages for relabeling, in order of (fetched_at, url), with rank and query."""
    rows = scored.where("pageverdict_score is not null").withColumn("_all", F.lit(0))
    ranked = ranked_within(rows, "_all", [F.col("fetched_at"), F.col("url")], "_rank")
    return ranked.select(F.col("_rank").cast("int").alias("rank"), F.concat(F.lit("crawler:"), F.col("pageverdict_decision")).alias("query"), *scored.columns)


def link_export(links: DataFrame) -> DataFrame:
    """Links for relabeling, the most uncertain first."""
    return links.orderBy(F.coalesce(F.abs(F.col("linkverdict_score") - 0.5), F.lit(0.0)), "target_url", "parent_url", "id")


def ranked_within(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows``, kept in the shared folder, with the rank from 1 that ``order`` gives them among those of their key.

    For keys of few values: rows are sorted by ranges, a range counts on from what
    the ranges before it hold of the key, and only these counts reach the driver.
    """
    spark = rows.sparkSession
    checkpoint_folder(spark)
    placed = rows.orderBy(key, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint()
    counts = placed.groupBy("_part", F.col(key).alias("_key")).agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    starts, total = [], {}
    for r in sorted(counts.collect(), key=lambda r: r["_part"]):
        starts.append((r["_part"], r["_key"], total.get(r["_key"], 0) - r["_first"] + 1))
        total[r["_key"]] = total.get(r["_key"], 0) + r["n"]
    kind = dict(placed.dtypes)[key]
    offsets = spark.createDataFrame(starts, f"_in long, _key {kind}, _offset long")
    joined = placed.join(F.broadcast(offsets), (F.col("_part") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.col("_at") + F.col("_offset")).drop("_at", "_part", "_in", "_key", "_offset")


def ranked_export(links: DataFrame) -> DataFrame:
    """All of ``link_export``'s links with their rank from 1."""
    order = [F.coalesce(F.abs(F.col("linkverdict_score") - 0.5), F.lit(0.0)), F.col("target_url"), F.col("parent_url"), F.col("id")]
    return ranked_within(links.withColumn("_all", F.lit(0)), "_all", order, "rank").drop("_all")


def labelled(results: DataFrame) -> DataFrame:
    """Rows to train on: rated, not 3, labelled one way or the other."""
    return results.where("rating is not null and rating <> 3 and label in ('negative', 'positive')")
