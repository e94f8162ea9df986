"""HTTP API over a loaded index and a label store: search, health, queues, imports, ratings, statistics, exports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import index, labeling, search, stores
from gleaner.sources import readers, sinks, web


#: A page to rate links and pages by hand: the next of a queue, and a button for each rating.
PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>Labels</title>
<h1>Labels</h1><p><button data-q="link">links</button> <button data-q="crawler">pages</button> <span id="s"></span><ol id="l"></ol>
<script>
const kinds = {link: ["/api/link-candidates", "/api/link-rating", "/api/link-stats"], crawler: ["/api/crawler-candidates", "/api/rating", "/api/stats"]};
async function show(kind) {
  const [queue, rate, stats] = kinds[kind], list = document.getElementById("l");
  const s = await (await fetch(stats)).json();
  document.getElementById("s").textContent = `${s.rated} of ${s.total} rated`;
  list.replaceChildren();
  for (const row of await (await fetch(queue)).json()) {
    const li = document.createElement("li");
    li.textContent = `${row.anchor ?? row.title ?? ""} ${row.target_url ?? row.url} `;
    for (const n of [1, 2, 3, 4, 5]) {
      const b = document.createElement("button");
      b.textContent = n;
      b.onclick = async () => { await fetch(rate, {method: "POST", body: JSON.stringify({id: row.id, rating: n})}); li.remove(); };
      li.append(b);
    }
    list.append(li);
  }
}
for (const b of document.querySelectorAll("[data-q]")) b.onclick = () => show(b.dataset.q);
</script>"""


class Bad(ValueError):
    """A request that can't be answered, with its status."""

    def __init__(self, text: str, status: int = 422) -> None:
        super().__init__(text)
        self.status = status


def _int(params: dict, name: str, default: int, low: int, high: int, clamp: bool = False) -> int:
    try:
        v = int(params.get(name, default))
    except ValueError:
        raise Bad(f"{name} is no whole number") from None
    if clamp:
        return max(low, min(v, high))
    if not low <= v <= high:
        raise Bad(f"{name} must be from {low} to {high}")
    return v


class SearchService:
    """An index held in memory; documents carry doc, terms and, if known, url and path."""

    def __init__(self, postings: DataFrame, documents: DataFrame) -> None:
        self.spark, self.postings, self.documents = postings.sparkSession, postings.persist(), documents.persist()

    @staticmethod
    def load(spark: SparkSession, folder: str) -> SearchService:
        return SearchService(*index.load(spark, folder))

    def health(self, params: dict) -> dict:
        return {"status": "ok", "documents": self.documents.count()}

    def search(self, params: dict) -> list[dict]:
        q = params.get("q", "")
        if not q:
            raise Bad("q is needed")
        n, context = _int(params, "top_n", 10, 1, 100), _int(params, "context_size", 20, 1, 100)
        found = search.search(self.postings, self.documents, self.spark.createDataFrame([(0, q)], "query_id long, query string"), n, context)
        return [{k: r[k] for k in ("rank", "score", "doc", "snippet")} for r in found.orderBy("rank").collect()]

    def routes(self) -> dict[tuple[str, str], Callable]:
        return {("GET", "/search"): self.search, ("GET", "/health"): self.health}


class LabelService:
    """Queues and ratings over two stores, ``links`` and ``results``, kept as Parquet below ``folder``.

    provider: the pages of results that a web search gives for a query, each a list of dictionaries.
    """

    SOURCES = ["crawler_pageverdict"]

    def __init__(self, spark: SparkSession, folder: str, provider: Callable[[str], list[list[dict]]] | None = None) -> None:
        self.spark, self.folder, self.provider = spark, folder, provider

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return stores.migrated(self.spark.read.parquet(path), name) if sinks.exists(self.spark, path) else stores.empty(self.spark, name)

    def _put(self, name: str, records: DataFrame) -> None:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        sinks.swap(stores.put(self.table(name), records, name, now), f"{self.folder}/{name}")

    def _records(self, params: dict) -> DataFrame:
        path = str(params.get("path") or "")
        if not os.path.exists(path):
            raise Bad(f"no such file: {path}", 404)
        if not os.path.isfile(path):
            raise Bad(f"not a file: {path}", 400)
        try:
            rows = readers.json_lines(self.spark, path)
            if "_corrupt_record" in rows.columns:
                raise ValueError("a line is no JSON")
        except (ValueError, AnalysisException) as e:
            raise Bad(f"the file can't be used: {e}", 400) from e
        return rows

    def import_pages(self, params: dict) -> dict:
        query = " ".join(str(params.get("query", "crawler:pageverdict")).split())
        if not query:
            raise Bad("a query is needed", 400)
        limit = _int(params, "limit", 200, 1, labeling.MAX_LIMIT)
        records = stores.result_records(self._records(params), query).persist()
        n, sources = records.count(), sorted(r[0] for r in records.select("source").distinct().collect())
        self._put("results", records)
        records.unpersist()  # the same file may be imported again with other rows
        queue = labeling.page_queue(self.table("results"), sources or self.SOURCES, limit, params.get("unlabeled_only", True) is not False)
        return {"status": "ok", "path": params["path"], "rows_read": n, "stored": n, "results": self._rows(queue, "place")}

    def import_links(self, params: dict) -> dict:
        limit = _int(params, "limit", 200, 1, labeling.MAX_LIMIT)
        records = stores.link_records(self._records(params)).persist()
        n = records.count()
        self._put("links", records)
        records.unpersist()
        queue = labeling.link_queue(self.table("links"), limit, params.get("unlabeled_only", True) is not False)
        return {"status": "ok", "path": params["path"], "rows_read": n, "stored": n, "results": self._rows(queue, "place")}

    def web_search(self, params: dict) -> dict:
        query = " ".join(str(params.get("query", "")).split())
        if not query:
            raise Bad("a query is needed", 400)
        if self.provider is None:
            raise Bad("no search provider is set", 503)
        pages = self.provider(query)
        found = [r | {"page": r["page_number"], "source": "web"} for r in web.search_results(pages, query)]
        if found:
            kind = "query string, normalized_url string, page_number long, rank long, title string, url string, snippet string, page long, source string"
            self._put("results", stores.result_records(self.spark.createDataFrame(found, kind), query))
        return {"query": query, "source": "web", "pages": len(pages), "results": self.results({"query": query})}

    @staticmethod
    def index(params: dict) -> str:
        return PAGE

    @staticmethod
    def _rows(df: DataFrame, order: str | None = None) -> list[dict]:
        return [r.asDict(True) for r in (df.orderBy(order) if order else df).collect()]

    def link_queue(self, params: dict) -> list[dict]:
        limit = _int(params, "limit", 200, 1, labeling.MAX_LIMIT, clamp=True)
        return self._rows(labeling.link_queue(self.table("links"), limit, params.get("unlabeled_only", "true") != "false"), "place")

    def page_queue(self, params: dict) -> list[dict]:
        limit = _int(params, "limit", 200, 1, labeling.MAX_LIMIT, clamp=True)
        return self._rows(labeling.page_queue(self.table("results"), self.SOURCES, limit, params.get("unlabeled_only", "true") != "false"), "place")

    def results(self, params: dict) -> list[dict]:
        q = " ".join(params.get("query", "").split())
        return self._rows(labeling.results_for(self.table("results"), q)) if q else []

    def rate(self, name: str) -> Callable:
        def run(params: dict) -> dict:
            rating = params.get("rating")
            if rating is not None and rating not in (1, 2, 3, 4, 5):
                raise Bad("rating must be from 1 to 5 or null")
            t = self.table(name)
            if t.where(F.col("id") == params.get("id")).isEmpty():
                raise Bad("no such row", 404)
            given = self.spark.createDataFrame([(params["id"], rating)], f"id {t.schema['id'].dataType.simpleString()}, rating int")
            rated = labeling.rate(t, given)
            if "notes" in params:
                rated = rated.withColumn("notes", F.when(F.col("id") == params["id"], str(params["notes"] or "").strip()).otherwise(F.col("notes")))
            sinks.swap(rated, f"{self.folder}/{name}")
            return {"id": params["id"], "rating": rating}

        return run

    def stats(self, name: str) -> Callable:
        def run(params: dict) -> dict:
            rows = labeling.label_stats(self.table(name)).collect()
            pick = lambda kind: {r["value"]: r["n"] for r in rows if r["kind"] == kind}
            return {"total": pick("total").get("", 0), "rated": pick("rated").get("", 0), "by_label": pick("label"), "by_rating": pick("rating")}

        return run

    def export(self, name: str) -> Callable:
        return lambda params: self._rows(stores.export(self.table(name), name))

    def routes(self) -> dict[tuple[str, str], Callable]:
        return {
            ("GET", "/"): self.index,
            ("POST", "/api/search"): self.web_search,
            ("POST", "/api/import/crawler-pageverdict"): self.import_pages,
            ("POST", "/api/import/link-candidates"): self.import_links,
            ("GET", "/api/link-candidates"): self.link_queue,
            ("GET", "/api/crawler-candidates"): self.page_queue,
            ("GET", "/api/results"): self.results,
            ("POST", "/api/rating"): self.rate("results"),
            ("POST", "/api/link-rating"): self.rate("links"),
            ("GET", "/api/stats"): self.stats("results"),
            ("GET", "/api/link-stats"): self.stats("links"),
            ("GET", "/api/export/serp-labels.jsonl"): self.export("results"),
            ("GET", "/api/export/link-labels.jsonl"): self.export("links"),
        }


def answer(routes: dict, method: str, target: str, body: bytes = b"") -> tuple[int, str, bytes]:
    """(status, content type, body) of a request."""
    u = urlsplit(target)
    run = routes.get((method, u.path))
    if run is None:
        return 404, "application/json", b'{"detail": "not found"}'
    try:
        params = json.loads(body) if body else {k: v[-1] for k, v in parse_qs(u.query, keep_blank_values=True).items()}
        got = run(params)
    except Bad as e:
        return e.status, "application/json", json.dumps({"detail": str(e)}).encode()
    except json.JSONDecodeError:
        return 422, "application/json", b'{"detail": "the body is no JSON"}'
    if isinstance(got, str):
        return 200, "text/html; charset=utf-8", got.encode()
    if u.path.endswith(".jsonl"):
        return 200, "application/x-ndjson", "".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in got).encode()
    return 200, "application/json", json.dumps(got, ensure_ascii=False, default=str).encode()


def serve(routes: dict, port: int = 8000, host: str = "127.0.0.1") -> None:
    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, out = answer(routes, self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _run

    ThreadingHTTPServer((host, port), Handler).serve_forever()
