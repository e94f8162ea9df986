"""Page gate, keyed upserts and outcome back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.config import PageGate, Topic
from gleaner.functions import scoring, text

HTML = "text/html%"


def html_pages(pages: DataFrame) -> DataFrame:
    """Rows whose content type is HTML or unknown."""
    return pages.where(F.col("content_type").isNull() | F.col("content_type").ilike(HTML))


def judged(pages: DataFrame, score: Column, topic: Topic = Topic(), gate: PageGate = PageGate()) -> DataFrame:
    """Adds score, english, topical, relevance, exclusion_reason and decision to pages with title, url, text and language."""
    out = pages.withColumn("score", score).withColumn("english", F.coalesce(F.col("language") == "en", F.lit(False)))
    topical = F.lit(False)
    for c in ("title", "url", "text"):
        topical = topical | F.coalesce(text.has_topic(F.col(c), topic.pattern), F.lit(False))
    out = out.withColumn("topical", topical).withColumn("relevance", scoring.relevance(F.col("score"), gate))
    out = out.withColumn("exclusion_reason", scoring.exclusion(F.col("score"), F.col("english"), F.col("topical"), gate))
    return out.withColumn("decision", scoring.decision(F.col("score"), F.col("exclusion_reason").isNull(), gate))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key.

    A row of ``new`` replaces the columns it has; ``keep`` columns stay as they
    were, ``fill`` columns are taken only where the old value is NULL or empty.
    ``new`` must be unique by key; columns it lacks stay.
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.withColumn("_old", F.lit(True)).alias("o").join(n, on, "full_outer")
    was, comes = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()

    def column(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in keys:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        if c in keep:
            return F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c in fill:
            return F.when(was & (F.coalesce(F.col(f"o.{c}").cast("string"), F.lit("")) != ""), F.col(f"o.{c}")).otherwise(F.when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")))
        return F.when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(*(column(c).alias(c) for c in old.columns))


def backfill(links: DataFrame, outcomes: DataFrame, key: str = "target_url") -> DataFrame:
    """``links`` with the outcome columns of ``outcomes`` (key, ...) on every link to that target."""
    names = [c for c in outcomes.columns if c != key]
    fresh = outcomes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in names))
    joined = links.join(fresh, key, "left")
    value = lambda c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c) if c in links.columns else F.lit(None))
    return joined.select(*(value(c).alias(c) if c in names else F.col(c) for c in links.columns), *(value(c).alias(c) for c in names if c not in links.columns))


def scored_union(saved: DataFrame, rejected: DataFrame) -> DataFrame:
    """Scored saved and rejected pages with the table they come from."""
    parts = [d.where("score is not null").withColumn("source_table", F.lit(name)) for d, name in ((saved, "pages"), (rejected, "rejected_pages"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)
