"""The two stores of a labeling service: their columns, imports into them and upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text, urls
from gleaner.operators.links import first_wins
from gleaner.operators.pages import upsert


def _columns(spec: str) -> dict[str, str]:
    """'name name: kind, ...' as name -> kind, in order."""
    return {name: kind.strip() for part in spec.split(",") for names, kind in [part.split(":")] for name in names.split()}


RATED = "rating: int, label notes: string"
STAMPS = "created_at updated_at rated_at: string"
#: Search results and crawled pages, in the order of their export.
RESULTS = _columns(
    f"query: string, page_number rank: long, title url display_url snippet source: string, {RATED}, pageverdict_score: double,"
    " pageverdict_label pageverdict_decision pageverdict_model crawler_source_table crawler_exclusion_reason: string, crawler_status_code: long,"
    f" crawler_content_type: string, crawler_depth: long, crawler_relevance: double, crawler_token_count: long, {STAMPS}"
)
#: Links, in the order of their export.
LINKS = _columns(
    "parent_url parent_host: string, parent_depth: long, parent_pageverdict_score: double, parent_pageverdict_label parent_pageverdict_decision: string,"
    " parent_relevance: double, anchor target_url target_host: string, target_depth: long, raw_score linkverdict_score: double, linkverdict_label linkverdict_model: string,"
    " should_enqueue selected: boolean, rejection_reason target_status: string, target_status_code: long, target_content_type target_language: string,"
    " target_relevance: double, target_token_count: long, target_pageverdict_score: double, target_pageverdict_label target_pageverdict_decision"
    f" target_exclusion_reason target_fetched_at source: string, {RATED}, {STAMPS}"
)
STORES = {"results": {"id": "long", "normalized_url": "string"} | RESULTS, "links": {"id": "long"} | LINKS}
KEYS = {"results": ["query", "normalized_url"], "links": ["parent_url", "target_url", "anchor"]}
ORDER = {"results": ["query", "page_number", "rank", "id"], "links": ["target_url", "parent_url", "id"]}
#: What an import never touches, and what it fills only where it is empty.
OURS = ["id", "rating", "label", "rated_at", "created_at"]
FILLED = ["notes"]


def migrated(table: DataFrame, store: str) -> DataFrame:
    """``table`` with the columns of the store that it lacks, as NULL; its own stay."""
    return table.withColumns({c: F.lit(None).cast(kind) for c, kind in STORES[store].items() if c not in table.columns})


def empty(spark: SparkSession, store: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in STORES[store].items()))


def _typed(rows: DataFrame, name: str, kind: str, zero_is_missing: bool) -> Column:
    """A field of an imported record; NULL where the records have none."""
    if name not in rows.columns:
        return F.lit(False) if kind == "boolean" else F.lit(None).cast(kind)
    c = F.col(name)
    if kind == "string":
        return F.nullif(c.cast("string"), F.lit(""))
    return {"long": lambda: text.optional_int(c, zero_is_missing), "double": lambda: text.optional_float(c, zero_is_missing), "boolean": lambda: text.optional_bool(c), "int": lambda: text.optional_int(c, zero_is_missing).cast("int")}[kind]()


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_n", F.monotonically_increasing_id())


def result_records(rows: DataFrame, query: str, zero_is_missing: bool = True) -> DataFrame:
    """Imported page records as rows of ``results``: those without a url go, the rank falls back to the record's place."""
    source = F.coalesce(F.nullif(F.trim(_typed(rows, "source", "string", True)), F.lit("")), F.lit("crawler_pageverdict"))
    own = F.nullif(text.collapse(F.coalesce(_typed(rows, "query", "string", True), F.lit(""))), F.lit(""))
    record = lambda c, kind: _typed(rows, {"depth": "crawl_depth"}.get(c, c), kind, zero_is_missing)
    url = F.trim(_typed(rows, "url", "string", True))
    out = {c: record(c.removeprefix("crawler_"), kind) for c, kind in RESULTS.items()}
    blank = lambda c: F.coalesce(c, F.lit(""))
    out |= {
        "query": F.when(source != "crawler_pageverdict", F.coalesce(own, F.lit(query))).otherwise(F.lit(query)),
        "page_number": F.coalesce(record("page", "long"), F.lit(1).cast("long")),
        "rank": F.coalesce(record("rank", "long"), F.col("_n") + 1),
        "title": blank(out["title"]), "snippet": blank(out["snippet"]), "notes": blank(out["notes"]),
        "url": url, "display_url": F.coalesce(out["display_url"], urls.part(url, "HOST")), "source": source,
    }
    placed = _numbered(rows).where(url.isNotNull() & (url != ""))
    return placed.select(urls.normalized_url(url).alias("normalized_url"), *(v.alias(c) for c, v in out.items() if c not in OURS), "_n")


def link_records(rows: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """Imported link records as rows of ``links``: the target falls back to url, hosts to those of the urls."""
    record = lambda c: _typed(rows, c, LINKS.get(c, "string"), zero_is_missing)
    out = {c: record(c) for c in LINKS}
    target = F.coalesce(F.nullif(F.trim(record("target_url")), F.lit("")), F.nullif(F.trim(record("url")), F.lit("")))
    parent = F.coalesce(F.trim(out["parent_url"]), F.lit(""))
    host = lambda c, u: F.coalesce(out[c], F.lower(urls.part(u, "HOST")))
    out |= {
        "target_url": target, "parent_url": parent, "target_host": host("target_host", target), "parent_host": host("parent_host", parent),
        "anchor": F.coalesce(out["anchor"], F.lit("")), "notes": F.coalesce(out["notes"], F.lit("")), "source": F.coalesce(out["source"], F.lit("crawler_linkverdict")),
    }
    return _numbered(rows).where(target.isNotNull()).select(*(v.alias(c) for c, v in out.items() if c not in OURS), "_n")


def put(old: DataFrame, records: DataFrame, store: str, now: Column) -> DataFrame:
    """``old`` with records put in by the store's key: ratings stay, notes are filled, of equal keys the last record counts.

    A new row's id is a hash of its key, so nothing has to be numbered one by one.
    """
    keys = KEYS[store]
    new = first_wins(records, keys, [F.desc("_n")]).drop("_n")
    stamped = new.withColumns({"created_at": now, "updated_at": now, "id": F.xxhash64(*keys).bitwiseAND((1 << 53) - 1)})
    return upsert(migrated(old, store), stamped, keys, keep=["created_at", "id"], fill=FILLED)


def export(table: DataFrame, store: str) -> DataFrame:
    """Every row in the store's order, with the columns of its export."""
    return migrated(table, store).orderBy(*ORDER[store]).select(*(RESULTS if store == "results" else LINKS))
