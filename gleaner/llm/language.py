"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3, of the lower-cased text with
blanks collapsed) weighted by TF-IDF: (1 + ln tf) * idf, L2-normalised.  The
document frequencies are counted over the whole corpus.  The classifier is
trained by FTRL-proximal with elastic-net penalties on a bounded sample of
labelled documents (``sample`` a label, those of least hash) and on a few words
out of each, so that short texts are told too; its probabilities are calibrated
by a temperature fitted on the sample's held-out tenth.  What the sample sends to
the driver are feature counts, six bytes each and at most twice ``buckets`` a text.

A document is rejected when its most likely language has less than
``min_confidence`` or when it holds no letter at all, so that no language can be
told (``lang`` NULL, confidence 0).  Nulls, empties and ties: NULL and empty
texts are rejected; NULL labels aren't trained on; without labels nothing can be
told and nothing is rejected; equal scores go to the first language in
alphabetical order.  Every row gets its own answer, repeated or NULL doc_ids
included; of labelled rows that repeat a doc_id and label the least text is
trained on.  Very long texts are read whole; an empty table gives an empty
result; other columns may have any name and type, ``keep_identified`` passes
them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import lean, like, plain, small_side

BUCKETS = 1 << 14
ORDERS = 3
SAMPLE = 600
MIN_CONFIDENCE = 0.4
RUN_CHARS = 1 << 17
ROWS = 32


def _runs(texts: pa.Array, limit: int = RUN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, cleaned texts) in runs of about ``limit`` characters and at most ROWS texts."""
    for lo in range(0, len(texts), ROWS):
        clean = pc.utf8_lower(texts.slice(lo, ROWS).fill_null(""))
        at, held, size = lo, [], 0
        for i, t in enumerate(clean.to_pylist(), lo):
            held.append(f" {' '.join(t.split())} ")
            size += len(held[-1])
            if size >= limit:
                yield at, held
                at, held, size = i + 1, [], 0
        if held:
            yield at, held


def gram_counts(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the n-grams of each text, ascending; ``buckets`` is a power of two."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)[:-1]
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32) * np.uint32(buckets), sizes)
    h, found = np.full(len(chars), np.uint32(0x85EBCA6B)), []
    for n in range(1, ORDERS + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ chars[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        feature = (h & np.uint32(buckets - 1)) + owner[:m]
        inside = np.ones(m, bool)
        for k in range(1, n):  # what reaches into the next text
            inside[ends[(ends >= k) & (ends - k < m)] - k] = False
        found.append(feature[inside] if n > 1 else feature)
    every = np.concatenate(found) if found else np.zeros(0, np.uint32)
    every.sort()
    last = np.flatnonzero(every[1:] != every[:-1])
    last = np.append(last, len(every) - 1) if len(every) else last
    one = every[last]
    return (one // np.uint32(buckets)).astype(np.int64), (one & np.uint32(buckets - 1)).astype(np.int64), np.diff(last, prepend=-1)


def _has_letters(texts: list[str]) -> np.ndarray:
    return np.array([any(c.isalpha() for c in t) for t in texts], bool)


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """How many of all documents hold each feature, and the number of documents.

    Each task adds its counts up; what reaches the driver is one sum a feature.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for _, texts in _runs(b.column("text")):
                df += np.bincount(gram_counts(texts, buckets)[1], minlength=buckets)
                n += len(texts)
        where = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(where, -1)), pa.array(np.append(df[where], n))], names=["feature", "df"])

    rows = docs.select("text").mapInArrow(lean(count), "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df, n = np.zeros(buckets, np.int64), 0
    for f, c in zip(rows["feature"].to_pylist(), rows["df"].to_pylist()):
        if f < 0:
            n = c
        else:
            df[f] = c
    return df, n


def tfidf(owner: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """The weight of each (text, feature, count)."""
    value = (1 + np.log(count.astype(np.float32))) * idf[feature]
    norm = np.sqrt(np.bincount(owner, value * value, texts))
    return (value / np.maximum(norm, 1e-9)[owner]).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def __post_init__(self) -> None:
        self.columns = np.ascontiguousarray(self.weights.T)

    def logits(self, texts: list[str]) -> np.ndarray:
        owner, feature, count = gram_counts(texts, len(self.idf))
        value = tfidf(owner, feature, count, self.idf, len(texts))
        return np.stack([np.bincount(owner, value * w[feature], len(texts)) for w in self.columns], axis=1) + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.logits(texts) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dot(x: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.stack([v @ weights[i] for i, v in x]) + bias if x else np.zeros((0, len(bias)))


def train_ftrl(
    x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, d: int, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3
) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by FTRL-proximal, one row at a time; (weights, bias)."""
    z, n = np.zeros((d + 1, classes)), np.zeros((d + 1, classes))
    order = np.random.default_rng(7)

    def weights(rows: np.ndarray) -> np.ndarray:
        zz, nn = z[rows], n[rows]
        penalty = np.where(rows == d, 0.0, l1)[:, None]  # the bias isn't pushed to zero
        return np.where(np.abs(zz) <= penalty, 0.0, -(zz - np.sign(zz) * penalty) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(x)):
            rows = np.append(x[i][0], d)
            v = np.append(x[i][1], 1.0)
            w = weights(rows)
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = weights(np.arange(d + 1))
    return w[:d].astype(np.float32), w[d].astype(np.float32)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = np.log(0.05), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _sample_batches(seed: int, buckets: int):
    """Feature counts of whole texts and of one to eight words of each, as numbers of 2 and 4 bytes."""

    def packed(texts: list[str]) -> list[pa.Array]:
        owner, feature, count = gram_counts(texts, buckets)
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        pieces = [(feature[a:b].astype("<u2").tobytes(), count[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
        return [pa.array([p[k] for p in pieces], pa.binary()) for k in (0, 1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _runs(b.column("text")):
                some = []
                for t, h in zip(texts, b.column("h").slice(at, len(texts)).to_pylist()):
                    words, rng = t.split(), np.random.default_rng([seed, h & (2**64 - 1)])
                    size = int(rng.integers(1, 9))
                    start = int(rng.integers(0, max(1, len(words) - size + 1)))
                    some.append(f" {' '.join(words[start : start + size])} ")
                yield pa.RecordBatch.from_arrays([b.column("y").slice(at, len(texts)), b.column("h").slice(at, len(texts)), *packed(texts), *packed(some)], names=["y", "h", "f", "c", "few_f", "few_c"])

    return run


def labelled_sample(docs: DataFrame, label: str, size: int, seed: int, buckets: int = BUCKETS) -> pa.Table:
    """(y, h, f, c, few_f, few_c) of at most ``size`` documents a label, those of least hash of doc_id and label."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(label))
    known = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    w = Window.partitionBy("y").orderBy("h")
    keyed = known.select(F.col(label).alias("y"), h.alias("h"))
    cuts = keyed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).groupBy("y").agg(F.max("h").alias("cut"))
    rows = known.select(F.col(label).alias("y"), h.alias("h"), "text").join(small_side(cuts, 100_000), "y").where("h <= cut")
    once = rows.groupBy("y", "h").agg(F.min("text").alias("text"))
    return once.mapInArrow(lean(_sample_batches(seed, buckets)), "y string, h long, f binary, c binary, few_f binary, few_c binary").toArrow()


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, seed: int = 11, buckets: int = BUCKETS) -> Model | None:
    """A calibrated model, or None where no row is labelled."""
    rows = labelled_sample(docs.select("doc_id", "text", F.col(label).cast("string").alias(label)), label, sample, seed, buckets)
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("h", "ascending"), ("y", "ascending")])
    df, n = document_frequencies(docs, buckets)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    labels = rows["y"].to_pylist()
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels] * 2)
    x = []
    for f, c in (("f", "c"), ("few_f", "few_c")):
        for features, counts in zip(rows[f].to_pylist(), rows[c].to_pylist()):
            i = np.frombuffer(features, "<u2").astype(np.int32)
            x.append((i, tfidf(np.zeros(len(i), np.int64), i, np.frombuffer(counts, "<u4"), idf, 1)))
    held = np.arange(len(x)) % len(labels) % 10 == 9
    weights, bias = train_ftrl([x[i] for i in np.flatnonzero(~held)], y[~held], len(languages), buckets)
    model = Model(languages, idf, weights, bias)
    model.temperature = fit_temperature(_dot([x[i] for i in np.flatnonzero(held)], weights, bias), y[held])
    return model


def _scored(docs: DataFrame, model: Model, emit: Callable) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            best, conf = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for at, texts in _runs(b.column("text")):
                p = m.probabilities(texts)
                best[at : at + len(texts)] = p.argmax(axis=1)
                conf[at : at + len(texts)] = np.where(_has_letters(texts), p.max(axis=1), 0.0)
            yield emit(b, best, conf)

    return docs.mapInArrow(lean(run), emit.schema)


def identify(docs: DataFrame, label: str = "lang", min_confidence: float = MIN_CONFIDENCE, **training) -> DataFrame:
    """(doc_id, predicted, confidence, rejected) for every row."""
    rows = plain(docs, "doc_id", "text", label)
    model = train(rows, label, **training)
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("string").alias("predicted"), F.lit(0.0).alias("confidence"), F.lit(False).alias("rejected"))

    def emit(b: pa.RecordBatch, best: np.ndarray, conf: np.ndarray) -> pa.RecordBatch:
        names = np.array(model.languages, dtype=object)[best]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(names, pa.string(), mask=conf == 0), pa.array(conf), pa.array(conf < min_confidence)],
            names=["doc_id", "predicted", "confidence", "rejected"],
        )

    emit.schema = "doc_id long, predicted string, confidence double, rejected boolean"
    return _scored(rows.select("doc_id", "text"), model, emit)


def keep_identified(docs: DataFrame, label: str = "lang", min_confidence: float = MIN_CONFIDENCE, **training) -> DataFrame:
    """``docs`` without the rejected rows; one scan, nothing is moved."""
    rows = plain(docs, "doc_id", "text", label)
    model = train(rows, label, **training)
    if model is None:
        return docs

    def emit(b: pa.RecordBatch, best: np.ndarray, conf: np.ndarray) -> pa.RecordBatch:
        return b.filter(pa.array(conf >= min_confidence))

    emit.schema = rows.schema
    return like(_scored(rows, model, emit), docs)
