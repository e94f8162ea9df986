"""URL filter lists by a temporal join.

A list is a table of dated entries (pattern, verdict, effective_at): from then
on the pattern has that verdict ('block' or 'allow'; NULL takes it off the
list), until its next entry.  So the entries become validity intervals, and
every capture (url, fetched_at) is evaluated against those that were active when
it was fetched.  The intervals of a pattern don't overlap: an equi-join on the
pattern with the interval as a condition gives at most one row for a capture and
pattern.

Patterns are a domain, which also covers its subdomains, or a host with leading
segments of a path.  The longest active pattern decides.

Nulls, empties and ties: of entries of one pattern at one time 'block' wins over
'allow' and that over NULL; entries with a NULL or empty pattern or a NULL time
count as absent.  A capture with a NULL or unparsable url or a NULL time matches
nothing; what matches nothing isn't blocked.  Repeated captures (all key columns
equal) give one row; other columns are dropped, whatever their names.  A very
long url has a pattern for each segment of its path, all of which count; an empty
table of captures gives an empty result, an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_IDS, cut

AUTHORITY = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)"
PATH = r"^[a-z][a-z0-9+.\-]*://[^/?#]*/([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without a trailing dot; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), AUTHORITY, 1), r"\.$", "")


def patterns(url: Column) -> Column:
    """Every pattern that covers a url: its host, the parent domains, and the host with each leading path."""
    segments = F.filter(F.split(F.regexp_extract(F.lower(url), PATH, 1), "/"), lambda s: s != "")

    def all_of(v: Column) -> Column:
        labels = F.split(v["host"], r"\.")
        domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        paths = F.transform(v["path"], lambda s, i: F.concat(v["host"], F.lit("/"), F.array_join(F.slice(v["path"], F.lit(1), i + 1), "/")))
        return F.array_distinct(F.concat(domains, paths))

    # a one-element array, so that host and path are taken once and not for every pattern
    parts = F.array(F.struct(host(url).alias("host"), segments.alias("path")))
    return F.when(host(url) != "", F.element_at(F.transform(parts, all_of), 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, valid_from, valid_to): open-ended intervals have a NULL valid_to."""
    w = Window.partitionBy("pattern").orderBy("valid_from")
    once = (
        entries.where("pattern <> '' and effective_at is not null")
        .groupBy(F.lower("pattern").alias("pattern"), F.col("effective_at").alias("valid_from"))
        .agg(F.max("verdict").alias("verdict"))
    )
    return once.withColumn("valid_to", F.lead("valid_from").over(w)).where("verdict is not null")


def evaluate(captures: DataFrame, entries: DataFrame, broadcast_limit: int = BROADCAST_IDS) -> DataFrame:
    """(page_id, url, fetched_at, pattern, verdict, blocked), a row for every distinct capture.

    A list of up to ``broadcast_limit`` intervals is sent to the captures, whose patterns are then joined and
    reduced to the longest before anything moves; a longer one is joined by pattern with the hashes of captures.
    """
    keys = ["page_id", "url", "fetched_at"]
    active = cut(intervals(entries).withColumnRenamed("pattern", "listed"))
    at = (F.col("candidate") == F.col("listed")) & (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    best = F.max(F.when(F.col("listed").isNotNull(), F.struct(F.length("listed").alias("n"), F.col("listed").alias("pattern"), "verdict"))).alias("best")
    if active.count() <= broadcast_limit:
        candidates = captures.select(*keys, F.explode_outer(patterns(F.col("url"))).alias("candidate"))
        judged = candidates.join(F.broadcast(active), at, "left").groupBy(*keys).agg(best)
    else:
        named = captures.select(*keys, *(F.xxhash64(F.lit(k), *(F.struct(c) for c in keys)).alias(f"h{k}") for k in (1, 2)))
        candidates = named.select("h1", "h2", "fetched_at", F.explode(patterns(F.col("url"))).alias("candidate"))
        matches = candidates.join(active, at).groupBy("h1", "h2").agg(best)
        judged = named.dropDuplicates(["h1", "h2"]).join(matches, ["h1", "h2"], "left")
    return judged.select(*keys, "best.pattern", "best.verdict", F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"))
