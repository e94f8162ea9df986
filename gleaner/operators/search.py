"""Ranked retrieval: any number of queries in one job, over saved postings or straight over documents.

Over documents only the terms asked for are counted: they go to the tasks, which
score their documents for every query and pass on the best of each.  Over
postings the hits of a document are brought together first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Bm25
from gleaner.functions import scoring, text
from gleaner.operators import index

BROADCAST_ROWS = 1_000_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct tokens of (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(text.tokenize(F.col("query")))).alias("term"))


def scores(posts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc, score, first): every document that holds a term, its summed score and first hit."""
    hits = posts.select("term", "doc", "score", F.col("first").alias("at")).join(query_terms(queries), "term")
    return hits.groupBy("query_id", "doc").agg(F.sum("score").alias("score"), F.min("at").alias("first"))


def matches(docs: DataFrame, queries: DataFrame, p: Bm25 = Bm25()) -> DataFrame:
    """``scores`` of the documents (doc, length, terms) without an index of their other terms."""
    asked = query_terms(queries)
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sized = F.broadcast if few else (lambda rows: rows)
    tokens = docs.select("doc", "length", F.posexplode("terms").alias("position", "term")).join(sized(asked.select("term").distinct()), "term")
    tf = tokens.groupBy("doc", "length", "term").agg(F.count("*").alias("tf"), F.min("position").alias("first"))
    df = sized(tf.groupBy("term").agg(F.count("*").alias("df")))
    score = scoring.bm25(F.col("tf"), F.col("length"), F.col("average"), scoring.bm25_idf(F.col("n"), F.col("df")), p)
    scored = tf.join(df, "term").crossJoin(F.broadcast(index.corpus_stats(docs))).select("term", "doc", score.alias("score"), "first")
    return scored.join(sized(asked), "term").groupBy("query_id", "doc").agg(F.sum("score").alias("score"), F.min("first").alias("first"))


#: Scores (documents times queries) that are held at once, and hits brought to their queries at once.
CELLS = 1 << 20


class Asked:
    """Distinct terms and queries of (query_id, term) rows, by number, and the queries of each term."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        encoded = [pa.concat_arrays(rows[c].chunks or [pa.array([], rows.schema.field(c).type)]).dictionary_encode() for c in ("term", "query_id")]
        (self.terms, term), (self.queries, query) = ((e.dictionary, e.indices.to_numpy(zero_copy_only=False)) for e in encoded)
        order = np.lexsort((query, term))
        self.query = query[order].astype(np.int64)
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def codes(self, terms: pa.Array) -> np.ndarray:
        """The number of each term, -1 for those not asked for."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)


class Best:
    """The ``n`` best documents of each query among those added; what can't be told from equal to 9 places stays too."""

    NEAR = 2e-9

    def __init__(self, asked: Asked, n: int) -> None:
        self.asked, self.n = asked, n
        self.least = np.zeros(len(asked.queries))
        self.held: list[tuple] = []
        self.rows = 0

    def add(self, docs: pa.Array, row: np.ndarray, code: np.ndarray, weight: np.ndarray, first: np.ndarray) -> None:
        """Hits by ascending row (a place in docs): one for each term of a document that was asked for."""
        a, queries = self.asked, len(self.asked.queries)
        many = a.start[code + 1] - a.start[code]
        ends = np.concatenate(([0], np.cumsum(many)))
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CELLS, "right")) - 1)
            to = min(to, int(np.searchsorted(row, row[at] + max(1, CELLS // max(queries, 1)))))
            if to < len(row):  # a document stays whole
                to = int(np.searchsorted(row, row[to])) if row[to] > row[at] else int(np.searchsorted(row, row[at], "right"))
            self._some(docs, row[at:to], code[at:to], weight[at:to], first[at:to], many[at:to])
            at = to

    def _some(self, docs, row, code, weight, first, many) -> None:
        queries, low = len(self.asked.queries), row[0]
        begin = np.repeat(self.asked.start[code] - (np.cumsum(many) - many), many)
        query = self.asked.query[begin + np.arange(len(begin))]
        cell = np.repeat(row - low, many) * queries + query
        total = np.bincount(cell, np.repeat(weight, many), (row[-1] - low + 1) * queries)
        at = np.unique(cell) if len(total) > 8 * len(cell) else np.flatnonzero(total)
        at = at[total[at] >= self.least[at % queries]]
        if not len(at):
            return
        place = np.full(len(total), np.iinfo(np.int32).max, np.int32)
        np.minimum.at(place, cell, np.repeat(first, many).astype(np.int32))
        self.held.append((at % queries, total[at], docs.take(pa.array(at // queries + low)), place[at]))
        self.rows += len(at)
        if self.rows > max(2 * CELLS, 4 * queries * self.n):
            self._prune()

    def _prune(self) -> None:
        query, score, first = (np.concatenate([h[k] for h in self.held]) for k in (0, 1, 3))
        docs = pa.concat_arrays([h[2] for h in self.held])
        by_doc = np.empty(len(docs), np.int64)
        by_doc[pc.array_sort_indices(docs).to_numpy() if not docs.null_count else pc.sort_indices(docs, null_placement="at_start").to_numpy()] = np.arange(len(docs))
        order = np.lexsort((by_doc, -score, query))
        q, s = query[order], score[order]
        start = np.searchsorted(q, np.arange(len(self.least) + 1))
        full = np.flatnonzero(np.diff(start) >= self.n)
        self.least[full] = np.maximum(self.least[full], s[start[full] + self.n - 1] - self.NEAR)
        change = np.flatnonzero(np.concatenate(([True], (np.diff(q) != 0) | (np.diff(s) != 0)))) if len(q) else np.array([], int)
        among_equal = np.arange(len(q)) - np.repeat(change, np.diff(change, append=len(q)))
        keep = order[(s >= self.least[q]) & (among_equal < self.n)]
        self.held = [(query[keep], score[keep], docs.take(pa.array(keep)), first[keep])]
        self.rows = len(keep)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._prune()
            query, score, docs, first = self.held[0]
            for k in range(0, len(query), 1 << 16):
                own = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([self.asked.queries.take(pa.array(query[own])), docs.slice(k, 1 << 16), pa.array(score[own]), pa.array(first[own])], names=["query_id", "doc", "score", "first"])


def _few(queries: DataFrame) -> Asked | None:
    """What is asked, where it is little enough to be sent to every task."""
    rows = query_terms(queries).limit(BROADCAST_ROWS + 1).toArrow()
    return Asked(rows) if rows.num_rows <= BROADCAST_ROWS else None


def _schema(docs: DataFrame, queries: DataFrame) -> str:
    kinds = (rows.schema[c].dataType.simpleString() for rows, c in ((queries, "query_id"), (docs, "doc")))
    return "query_id {}, doc {}, score double, first int".format(*kinds)


def best(docs: DataFrame, queries: DataFrame, n: int, p: Bm25 = Bm25()) -> DataFrame:
    """``top(matches(docs, queries), n)``; documents are scored where they lie, and only each task's best of a query move."""
    asked = _few(queries)
    if asked is None or index.repeats(docs):
        return top(matches(docs, queries, p), n)
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value.terms) + 2, np.int64)  # and the documents and their tokens
        for b in batches:
            df[-2] += b.num_rows
            df[-1] += pc.sum(b.column("length")).as_py() or 0
            for piece, row, _ in index.pieces(b):
                code = sent.value.codes(piece.column("terms").flatten())
                hit = code >= 0
                df[:-2] += np.bincount(index.runs(row[hit], code[hit], len(df) - 2)[3], minlength=len(df) - 2)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["code", "df"])

    rows = docs.select("doc", F.col("length").cast("int").alias("length"), "terms")
    found = rows.mapInArrow(counted, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(asked.terms) + 2)
    df[found["code"].to_numpy()] = found["df"].to_numpy()
    df, total, average = df[:-2], df[-2], df[-1] / max(df[-2], 1)
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best(sent.value, n)
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            done = 0
            for piece, row, position in index.pieces(b):
                code = sent.value.codes(piece.column("terms").flatten())
                hit = code >= 0
                order, starts, doc, term = index.runs(row[hit], code[hit], len(idf))
                tf, first = np.diff(starts, append=len(order)), position[hit][order][starts]
                weight = idf[term] * tf * (p.k1 + 1) / (tf + p.k1 * ((1 - p.b) + p.b * length[done + doc] / average))
                kept.add(piece.column("doc"), doc, term, weight, first)
                done += piece.num_rows
        yield from kept.result()

    return top(rows.mapInArrow(scored, _schema(docs, queries)), n)


def best_hits(posts: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """``top(scores(posts, queries), n)``: a document's hits move once, whatever the number of queries they count for."""
    asked = _few(queries)
    if asked is None:
        return top(scores(posts, queries), n)
    spark = posts.sparkSession
    sent = spark.sparkContext.broadcast(asked)
    numbered = spark.createDataFrame(pa.table({"term": asked.terms, "code": pa.array(np.arange(len(asked.terms), dtype=np.int32))}))
    hits = posts.join(F.broadcast(numbered), "term").select("doc", "code", "score", F.col("first").cast("int").alias("first"))

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rest = Best(sent.value, n), None
        for b in _with_end(batches):
            parts = [x for x in (rest, b) if x is not None and x.num_rows]
            if not parts:
                continue
            t = pa.Table.from_batches(parts).combine_chunks()
            docs = t["doc"].chunk(0)
            new = np.concatenate(([True], _changes(docs)))
            whole = t.num_rows if b is None else int(np.flatnonzero(new)[-1])
            rest = None if b is None else t.slice(whole).to_batches()[0]
            if whole:
                row = np.cumsum(new[:whole]) - 1
                kept.add(docs.take(pa.array(np.flatnonzero(new[:whole]))), row, *(t[c].chunk(0).slice(0, whole).to_numpy(zero_copy_only=False) for c in ("code", "score", "first")))
        yield from kept.result()

    together = hits.repartition("doc").sortWithinPartitions("doc", "code")
    return top(together.mapInArrow(scored, _schema(posts, queries)), n)


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _changes(values: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; NULLs are alike."""
    a, b = values.slice(1), values.slice(0, max(len(values) - 1, 0))
    differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return differs.to_numpy(zero_copy_only=False)


def find(docs: DataFrame, queries: DataFrame, n: int = 10, context: int = 20, key: str = "doc_id", body: str = "text") -> DataFrame:
    """``search`` straight over documents (key, body): snippets are cut from those found only."""
    found = best(index.documents(docs, key, body), queries, n)
    if queries.limit(BROADCAST_ROWS // n + 1).count() * n <= BROADCAST_ROWS:
        found = F.broadcast(found)
    texts = docs.select(F.col(key).alias("doc"), F.col(body).alias("body")).join(found, "doc")
    snippet = text.hit_snippet(text.tokenize(F.coalesce("body", F.lit(""))), F.col("first"), context)
    return texts.select("query_id", "rank", "score", "doc", snippet.alias("snippet"))


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n best of each query; equal scores (to 9 places) go by document."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def search(posts: DataFrame, docs: DataFrame, queries: DataFrame, n: int = 10, context: int = 20) -> DataFrame:
    """(query_id, rank, score, doc, snippet)."""
    return best_hits(posts, queries, n).join(docs.select("doc", "terms"), "doc").select("query_id", "rank", "score", "doc", text.hit_snippet(F.col("terms"), F.col("first"), context).alias("snippet"))


def run_file(results: DataFrame) -> DataFrame:
    """(query_id, rank, url, score): rows without a url dropped, ranks closed up, score as text."""
    w = Window.partitionBy("query_id").orderBy("rank")
    kept = results.where("url is not null and url <> ''")
    return kept.select("query_id", F.row_number().over(w).alias("rank"), "url", F.format_string("%.4f", F.col("score")).alias("score"))


def write_run_file(results: DataFrame, path: str) -> None:
    run_file(results).coalesce(1).sortWithinPartitions("query_id", "rank").write.mode("overwrite").csv(path, sep="\t")
