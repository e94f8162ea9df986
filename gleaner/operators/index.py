"""Positional BM25 index as two tables: postings by term and documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.config import Bm25
from gleaner.functions import scoring, text


def documents(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc, length, terms): the token stream of each document."""
    d = docs.select(F.col(key).alias("doc"), text.tokenize(F.coalesce(F.col(body), F.lit(""))).alias("terms"))
    return d.select("doc", F.size("terms").alias("length"), "terms")


def positions(docs: DataFrame) -> DataFrame:
    """(doc, length, term, position), one row a token."""
    return docs.select("doc", "length", F.posexplode("terms").alias("position", "term")).select("doc", "length", "term", "position")


def repeats(docs: DataFrame) -> bool:
    """Whether a document number stands in more than one row; texts aren't read for it."""
    return not docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


#: Tokens, and postings, that are counted at once.
TOKENS = 1 << 18
_COUNTS = {"tf": "long", "first": "int", "positions": "array<int>"}


def pieces(b: pa.RecordBatch, tokens: int = TOKENS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with ``terms``: of about ``tokens`` tokens, or one row; with the row and the position of each token."""
    sizes = b.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + tokens, "right")) - 1)
        own = sizes[at:to]
        row = np.repeat(np.arange(to - at), own)
        yield b.slice(at, to - at), row, np.arange(len(row)) - np.repeat(ends[at:to] - ends[at], own)
        at = to


def runs(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens in their order: what brings equal (row, code) together, where each run starts, and the row and code of each."""
    key = row * codes + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return order, starts, key[starts] // max(codes, 1), key[starts] % max(codes, 1)


def term_frequencies(docs: DataFrame, fields: tuple[str, ...] = tuple(_COUNTS)) -> DataFrame:
    """(doc, length, term, tf, first, positions), of the last three the ``fields`` asked for.

    A row's tokens are counted where the row lies: nothing moves.  Rows of one
    number (and length) are one document; only where there are any are tokens grouped.
    """
    if repeats(docs):
        grouped = positions(docs).groupBy("doc", "length", "term")
        whole = grouped.agg(F.count("*").alias("tf"), F.min("position").alias("first"), F.array_sort(F.collect_list("position")).alias("positions"))
        return whole.select("doc", "length", "term", *fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, row, position in pieces(b):
                if not len(row):
                    continue
                terms = piece.column("terms").flatten().dictionary_encode()
                order, starts, doc, code = runs(row, terms.indices.to_numpy(), len(terms.dictionary))
                of, ordered = pa.array(doc), position[order].astype(np.int32)
                made = {
                    "tf": lambda: pa.array(np.diff(starts, append=len(row))),
                    "first": lambda: pa.array(ordered[starts]),
                    "positions": lambda: pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(ordered)),
                }
                columns = [piece.column("doc").take(of), piece.column("length").take(of), terms.dictionary.take(pa.array(code)), *(made[f]() for f in fields)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "length", "term", *fields])

    kind = docs.schema["doc"].dataType.simpleString()
    schema = ", ".join([f"doc {kind}", "length int", "term string", *(f"{f} {_COUNTS[f]}" for f in fields)])
    return docs.select("doc", F.col("length").cast("int").alias("length"), "terms").mapInArrow(run, schema)


def shingle_counts(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc, shingle, n) of (doc, terms): runs of ``size`` terms, the terms themselves where there are fewer; counted where the row lies, as terms are."""
    if repeats(docs):
        return docs.select("doc", F.explode(text.runs(F.col("terms"), size)).alias("shingle")).groupBy("doc", "shingle").agg(F.count("*").alias("n"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, row, position in pieces(b):
                left = np.bincount(row)[row] - position if len(row) else row  # terms from here to the row's end
                short = (left + position) < size
                at, alone = np.flatnonzero(left >= size), np.flatnonzero(short)
                if not len(at) + len(alone):
                    continue
                flat = piece.column("terms").flatten()
                joined = pc.binary_join_element_wise(*(flat.take(pa.array(at + k)) for k in range(size)), " ")
                shingles = pa.concat_arrays([joined, flat.take(pa.array(alone))]).dictionary_encode()
                _, starts, doc, code = runs(np.concatenate((row[at], row[alone])), shingles.indices.to_numpy(), len(shingles.dictionary))
                n = np.diff(starts, append=len(shingles))
                yield pa.RecordBatch.from_arrays([piece.column("doc").take(pa.array(doc)), shingles.dictionary.take(pa.array(code)), pa.array(n)], names=["doc", "shingle", "n"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "terms").mapInArrow(run, f"doc {kind}, shingle string, n long")


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) of documents: their distinct terms are counted map-side."""
    if repeats(docs):
        return document_frequencies(positions(docs).select("doc", "length", "term").distinct())
    return document_frequencies(docs.select(F.explode(F.array_distinct("terms")).alias("term")))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, and their average length (0 for none; empty documents count)."""
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"))


def with_df(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds df, n and average to rows of terms.

    The rows move once, by term, and aren't sorted: what is hashed are the
    frequencies.  A term that every document holds is split by the adaptive skew
    join, so no task sees all of its rows.
    """
    return tf.join(frequencies(docs).hint("shuffle_hash"), "term").crossJoin(F.broadcast(corpus_stats(docs)))


def _score(p: Bm25) -> Column:
    return scoring.bm25(F.col("tf"), F.col("length"), F.col("average"), scoring.bm25_idf(F.col("n"), F.col("df")), p)


def postings(docs: DataFrame, p: Bm25 = Bm25(), fields: tuple[str, ...] = tuple(_COUNTS)) -> DataFrame:
    """(term, doc, tf, score, first, positions): what a search reads; of tf, first and positions the ``fields``, tf among them."""
    after = [f for f in fields if f != "tf"]
    return with_df(term_frequencies(docs, fields), docs).select("term", "doc", "tf", _score(p).alias("score"), *after)


def inverted(posts: DataFrame) -> DataFrame:
    """(term, postings): the nested view, postings in document order."""
    return posts.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc", "score", "positions"))).alias("postings"))


def save(posts: DataFrame, docs: DataFrame, folder: str) -> None:
    """Postings range-partitioned by term, so that a search prunes files by the term's statistics."""
    posts.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{folder}/postings")
    docs.write.mode("overwrite").parquet(f"{folder}/documents")


#: A term in more documents than this has its frequency sent to the tasks and its postings split by document.
HOT = 1 << 17


def build(docs: DataFrame, folder: str, p: Bm25 = Bm25(), hot: int = HOT) -> None:
    """The index that ``save`` writes of ``postings(docs)``, with postings moved once.

    They are ranged by term before they are scored: all of a term lie in one
    task then, which counts them.  Only frequent terms are counted before.
    """
    docs.write.mode("overwrite").parquet(f"{folder}/documents")
    docs = docs.sparkSession.read.parquet(f"{folder}/documents")
    frequent = docs.sparkSession.createDataFrame(frequencies(docs).where(F.col("df") > hot).toArrow())
    marked = term_frequencies(docs).join(F.broadcast(frequent), "term", "left").withColumn("part", F.when(F.col("df").isNotNull(), F.col("doc")))
    ranged = marked.repartitionByRange("term", "part").sortWithinPartitions("term", "part", "doc")
    counted = ranged.withColumn("df", F.coalesce("df", F.count("*").over(Window.partitionBy("term", "part"))))
    scored = counted.crossJoin(F.broadcast(corpus_stats(docs))).select("term", "doc", "tf", _score(p).alias("score"), "first", "positions")
    scored.write.mode("overwrite").parquet(f"{folder}/postings")


def load(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/documents")
