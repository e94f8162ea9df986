"""Crawl quality in numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def top_hosts(pages: DataFrame, n: int = 12) -> DataFrame:
    return counts(pages, "host").orderBy(F.desc("n"), "host").limit(n)


def depth_distribution(pages: DataFrame) -> DataFrame:
    return counts(pages.where("crawl_depth is not null"), "crawl_depth")


def entropy(pages: DataFrame) -> DataFrame:
    """(distinct_hosts, host_entropy_bits, host_evenness), one row."""
    n = counts(pages, "host")
    total = n.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    one = n.crossJoin(F.broadcast(total)).agg(F.count("*").alias("distinct_hosts"), F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("h"))
    most = F.when(F.col("distinct_hosts") > 1, F.log2("distinct_hosts")).otherwise(1.0)
    return one.select("distinct_hosts", F.round(F.round("h", 9) + 0.0, 3).alias("host_entropy_bits"), F.round(F.round(F.col("h") / most, 9), 4).alias("host_evenness"))


def diversity(pages: DataFrame, sizes: tuple[int, ...] = (50, 100)) -> DataFrame:
    """(n, hosts): distinct hosts among the first n pages by id."""
    most = pages.select("id", "host").orderBy("id").limit(max(sizes))
    ranked = most.withColumn("r", F.row_number().over(Window.orderBy("id")))
    return ranked.agg(*(F.count_distinct(F.when(F.col("r") <= n, F.col("host"))).alias(f"d{n}") for n in sizes)).select(
        F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"d{n}").alias("hosts")) for n in sizes))).alias("e")
    ).select("e.n", "e.hosts")


def rates(saved: DataFrame, rejected: DataFrame) -> DataFrame:
    """fetched, saved, rejected, harvest_rate, duplicate_rate and deep_share_ge3; 0 where there is nothing to divide by."""
    s = saved.agg(F.count("*").alias("saved"), F.count_if(F.col("crawl_depth") >= 3).alias("deep"))
    r = rejected.agg(F.count("*").alias("rejected"), F.count_if(F.col("exclusion_reason") == "duplicate_text").alias("copies"))
    fetched = F.col("saved") + F.col("rejected")
    share = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 4), F.lit(0.0))
    return s.crossJoin(r).select(
        fetched.alias("fetched"), "saved", "rejected", share(F.col("saved"), fetched).alias("harvest_rate"), share(F.col("copies"), fetched).alias("duplicate_rate"), share(F.col("deep"), F.col("saved")).alias("deep_share_ge3")
    )


def link_frontier(links: DataFrame) -> DataFrame:
    """enqueued, same_host_share, enqueued_fetched and precision_at_enqueue in one pass; NULL shares of nothing."""
    on = links.where("selected").agg(
        F.count("*").alias("enqueued"),
        F.count_if(F.col("parent_host") == F.col("target_host")).alias("same"),
        F.count("target_status").alias("enqueued_fetched"),
        F.count_if(F.col("target_status") == "page").alias("good"),
    )
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    return on.select("enqueued", share("same", "enqueued").alias("same_host_share"), "enqueued_fetched", share("good", "enqueued_fetched").alias("precision_at_enqueue"))


def format_report(saved: DataFrame, rejected: DataFrame, links: DataFrame | None = None) -> dict:
    """All of it as one dictionary; only aggregates reach the driver."""
    out = rates(saved, rejected).first().asDict() | entropy(saved).first().asDict()
    out["rejection_reasons"] = {r["exclusion_reason"]: r["n"] for r in counts(rejected, "exclusion_reason").orderBy(F.desc("n"), "exclusion_reason").collect()}
    out["depth_distribution"] = {r["crawl_depth"]: r["n"] for r in depth_distribution(saved).orderBy("crawl_depth").collect()}
    out |= {f"diversity_at_{r['n']}": r["hosts"] for r in diversity(saved).collect()}
    out["top_hosts"] = [(r["host"], r["n"]) for r in top_hosts(saved).collect()]
    if links is not None:
        out["link_frontier"] = link_frontier(links).first().asDict()
    return out


def as_text(numbers: dict) -> str:
    """A report for the terminal: a line a number, lists and tables indented below their name."""
    lines = []
    for name, value in numbers.items():
        label = name.replace("_", " ")
        if isinstance(value, dict | list):
            rows = value.items() if isinstance(value, dict) else value
            lines += [f"{label}:", *(f"  {k if k is not None else '-':<40} {v}" for k, v in rows)]
        else:
            lines.append(f"{label + ':':<28}{'-' if value is None else value}")
    return "\n".join(lines)
