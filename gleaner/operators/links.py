"""Links of a page: extraction, gates, per-page budgets and the outgoing edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Frontier, LinkGate
from gleaner.functions import scoring, text, urls

ANCHOR = r'<a href="([^"]+)">([^<]*)</a>'


def extract(pages: DataFrame) -> DataFrame:
    """(parent_url, position, href, anchor) of regular markup, in page order; duplicates stay.

    For any markup there is ``html.parse_pages``; this form stays in the JVM.
    """
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    anchors = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2))
    pairs = pages.select(F.col("url").alias("parent_url"), F.posexplode(F.arrays_zip(hrefs.alias("href"), anchors.alias("anchor"))).alias("position", "link"))
    return pairs.select("parent_url", "position", "link.href", text.collapse(F.col("link.anchor")).alias("anchor"))


def edges(pages: DataFrame) -> DataFrame:
    """(parent_url, parent_host, position, target_url, target_host, anchor), canonical targets only.

    Root-relative and absolute links are resolved as expressions; others need ``urls.canonical_url``.
    """
    base = F.regexp_extract("parent_url", r"^([a-z]+://[^/?#]+)", 1)
    absolute = F.when(F.col("href").startswith("/"), F.concat(base, F.col("href"))).otherwise(F.col("href"))
    out = extract(pages).withColumn("target_url", urls.canonical_absolute(absolute)).where(F.col("target_url").isNotNull())
    return out.select("parent_url", urls.host_of(F.col("parent_url")).alias("parent_host"), "position", "target_url", urls.host_of(F.col("target_url")).alias("target_host"), "anchor")


def unseen(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Links whose target hasn't been seen."""
    return links.join(seen.select(F.col("url").alias("target_url")).distinct(), "target_url", "left_anti")


def gated(links: DataFrame, score: Column, depth: Column, saved: DataFrame | None = None, rejected: DataFrame | None = None, gate: LinkGate = LinkGate(), limits: Frontier = Frontier()) -> DataFrame:
    """Adds skipped, score, frontier_score, verdict_score and rejection_reason (so far) to ``links``.

    saved, rejected: (host, n) counters of the crawl; a host that isn't there has 0.
    """
    out = links.withColumn("skipped", urls.is_skippable(F.col("target_url")))
    out = out.withColumn("verdict_score", F.when(~F.col("skipped"), score))
    for name, counts in (("_saved", saved), ("_rejected", rejected)):
        if counts is None:
            out = out.withColumn(name, F.lit(0))
        else:
            out = out.join(counts.select(F.col("host").alias("target_host"), F.col("n").alias(name)), "target_host", "left").fillna(0, [name])
    enqueue = scoring.enqueue(F.coalesce(F.col("verdict_score"), F.lit(0.0)), depth, F.col("skipped"), gate)
    capped = F.col("_saved") >= limits.max_pages_per_host
    exhausted = (F.col("_rejected") >= limits.reject_cutoff) & (F.col("_saved") == 0) if limits.reject_cutoff > 0 else F.lit(False)
    reason = F.when(~enqueue | capped, "not_enqueued").when(exhausted, "host_off_topic")
    frontier = F.coalesce(F.col("verdict_score") * 10, F.lit(0.0))
    return out.withColumn("rejection_reason", reason).withColumn("frontier_score", frontier).drop("_saved", "_rejected")


def budgeted(links: DataFrame, gate: LinkGate = LinkGate()) -> DataFrame:
    """At most ``per_host`` links of a host and ``per_family`` of a url family on a page, best first, ties in page order.

    A link over its family's budget takes none of its host's: that makes two
    windows over one sort enough.
    """
    best = [F.col("frontier_score").desc(), F.col("position")]
    # links that have a reason already are groups of their own, so that one scan and one sort serve both kinds
    keys = ["parent_url", "target_host", "_open"]
    by_family = Window.partitionBy(*keys, "_family").orderBy(*best)
    earlier = Window.partitionBy(*keys).orderBy(*best).rowsBetween(Window.unboundedPreceding, -1)
    fits = links.withColumn("_open", F.col("rejection_reason").isNull()).withColumn("_family", F.when(F.col("_open"), urls.url_family(F.col("target_url"), gate.languages)))
    fits = fits.withColumn("_place", F.row_number().over(by_family))
    fits = fits.withColumn("_before", F.coalesce(F.sum((F.col("_place") <= gate.per_family).cast("int")).over(earlier), F.lit(0)))
    reason = F.when(F.col("_before") >= gate.per_host, "page_host_budget").when(F.col("_place") > gate.per_family, "page_family_budget")
    return fits.withColumn("rejection_reason", F.when(F.col("_open"), reason).otherwise(F.col("rejection_reason"))).drop("_open", "_family", "_place", "_before")


def decided(links: DataFrame) -> DataFrame:
    """Adds should_enqueue and selected to budgeted links."""
    reason = F.coalesce(F.col("rejection_reason"), F.lit(""))
    return links.withColumn("should_enqueue", ~reason.isin("not_enqueued", "host_off_topic")).withColumn("selected", F.col("rejection_reason").isNull())


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def outcome_examples(links: DataFrame, per_target: int = 3) -> DataFrame:
    """Weak labels from crawl outcomes: the first rows of each fetched target, positive if any was saved."""
    target = Window.partitionBy("target_url")
    ranked = links.where("target_status is not null").withColumn("n", F.row_number().over(target.orderBy("id")))
    saved = F.max((F.col("target_status") == "page").cast("int")).over(target)
    return ranked.withColumn("label", F.when(saved == 1, "positive").otherwise("negative")).where(F.col("n") <= per_target).drop("n")
