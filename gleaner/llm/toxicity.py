"""Toxic spans by a linear-chain conditional random field (CRF).

Labels are of documents, so the token labels are derived first: a word marks
toxicity when it stands in at least ``MIN_DOCUMENTS`` toxic documents and
``MIN_CONTEXTS`` distinct contexts (previous and next word) there, and its share
of contexts there is ``MIN_ODDS`` times that in clean ones.  Contexts and not documents are counted,
since copies of one text repeat its contexts.  In toxic documents those words
are tagged 1, everything else 0.

The CRF has two states; a token's score comes from the word, the word before and
the word after it, a transition's from the pair of states.  It is fitted by
gradient ascent on a bounded sample of labelled documents (``sample`` of them,
those of least hash, so that both classes are as frequent as they are, and of
those the first that hold ``sample_words`` words in all; what reaches the driver
are word hashes, eight bytes each), on every run of words that holds a marking
word and as many others.  Forward-backward runs over whole documents, all documents
of a batch side by side, in odds form.  A document's score is the probability
that some word of it is toxic, as if words were independent, over the words with
a marginal of at least ``NOISE``; it is toxic at ``threshold``, and the words with
a marginal of at least one half give the offending character spans.

Nulls, empties and ties: texts without words score 0 with no spans; NULL labels
and labels of missing documents aren't used, a doc_id labelled both ways counts
as toxic; without labels of both kinds nothing is toxic.  Every row gets its own
answer, repeated or NULL doc_ids included; of labelled rows that repeat a doc_id
the least text is trained on.  Very long texts are read whole; an empty table
gives an empty result; other columns of both tables are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import lean, mix, scans

SAMPLE = 6000
SAMPLE_WORDS = 4_000_000
MIN_CONTEXTS = 5
MIN_DOCUMENTS = 3
MIN_ODDS = 20.0
THRESHOLD = 0.8
NOISE = 0.1
WINDOW = 96
SLOTS = 20


def forward_backward(u: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1 and the forward and backward odds of sequences laid end to end.

    u: score of state 1 over state 0 for every token; first: offsets of the
    sequences; trans: scores [[00, 01], [10, 11]]; start: score of starting in 1.
    """
    e = np.exp(np.clip(u, -30, 30).astype(np.float64))
    (t00, t01), (t10, t11) = np.exp(trans)
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], first[:-1][order]
    lengths = -n
    a, b = np.empty(len(u)), np.empty(len(u))
    longest = int(n[0]) if len(n) else 0
    live = [int(np.searchsorted(lengths, -j, "left")) for j in range(longest)]  # sequences longer than j
    for j in range(longest):
        k = at[: live[j]] + j
        if j:
            prev = a[k - 1]
            a[k] = e[k] * (t01 + t11 * prev) / (t00 + t10 * prev)
        else:
            a[k] = e[k] * np.exp(start)
    last = at[: live[0]] + n[: live[0]] - 1 if longest else np.zeros(0, np.int64)
    b[last] = 1.0
    for j in range(longest - 2, -1, -1):
        k = at[: live[j + 1]] + j
        on = e[k + 1] * b[k + 1]
        b[k] = (t10 + t11 * on) / (t00 + t01 * on)
    odds = a * b
    return odds / (1 + odds), a, b


@dataclass
class Model:
    """Words by hash (exact), with the weights of each as the word itself, the one before and the one after."""

    words: np.ndarray  # ascending, and 0 for unknown words at the end
    slots: np.ndarray  # where the words with each leading SLOTS bits start
    weights: np.ndarray  # (3, words + 1); the last is for unknown words
    trans: np.ndarray
    start: float

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        at, stop = self.slots[slot], self.slots[slot + 1]
        out = np.full(len(hashes), len(self.words) - 1, np.int32)
        rows = np.flatnonzero(at < stop)
        while len(rows):
            here = at[rows]
            same = self.words[here] == hashes[rows]
            out[rows[same]] = here[same]
            at[rows] += 1
            rows = rows[~same]
            rows = rows[at[rows] < stop[rows]]
        return out

    def scores(self, hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        i = self.ids(hashes)
        return _emission(self.weights, i, text_of)


def _emission(weights: np.ndarray, i: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    u = weights[0][i]
    if len(i) > 1:
        same = text_of[1:] == text_of[:-1]
        u[1:] += np.where(same, weights[1][i[:-1]], 0)
        u[:-1] += np.where(same, weights[2][i[1:]], 0)
    return u


def _vocabulary(hashes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur twice or mark toxicity, an unknown one at the end, and the slots."""
    known, counts = np.unique(hashes, return_counts=True)
    known = known[(counts > 1) | np.isin(known, marks)]
    slots = np.searchsorted(known >> np.uint64(64 - SLOTS), np.arange((1 << SLOTS) + 1, dtype=np.uint64)).astype(np.int32)
    return np.append(known, np.uint64(0)), slots


def marking_words(hashes: np.ndarray, text_of: np.ndarray, toxic: np.ndarray, min_contexts: int = MIN_CONTEXTS, min_odds: float = MIN_ODDS) -> np.ndarray:
    """Hashes of the words that mark toxicity, from texts with a label each."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    same = text_of[1:] == text_of[:-1]
    before, after = np.zeros_like(hashes), np.zeros_like(hashes)
    before[1:] = np.where(same, hashes[:-1], 0)
    after[:-1] = np.where(same, hashes[1:], 0)
    context = before * np.uint64(0x9E3779B97F4A7C15) ^ after
    label = toxic[text_of]
    found = []
    for y in (1, 0):
        words = hashes[label == y]
        _, at = np.unique(mix(words + np.uint64(1)) ^ context[label == y], return_index=True)
        found.append(np.unique(words[at], return_counts=True) + (max(1, len(at)),))
    (tw, tc, tn), (cw, cc, cn) = found
    clean = np.zeros(len(tw))
    if len(cw):
        at = np.minimum(np.searchsorted(cw, tw), len(cw) - 1)
        clean = np.where(cw[at] == tw, cc[at], 0)
    words = hashes[label == 1]
    _, at = np.unique(mix(words + np.uint64(2)) ^ mix(text_of[label == 1].astype(np.uint64)), return_index=True)
    spread = np.unique(words[at], return_counts=True)[1]
    return tw[(tc >= min_contexts) & (spread >= MIN_DOCUMENTS) & ((tc / tn) >= min_odds * ((clean + 0.1) / cn))]


def _windows(mark: np.ndarray, first: np.ndarray, window: int, seed: int) -> list[tuple[int, int]]:
    """Training runs: every run of a text that holds a marking word, and as many without."""
    with_mark, without = [], []
    for lo, hi in zip(first[:-1], first[1:]):
        for a in range(lo, hi, window):
            b = min(a + window, hi)
            (with_mark if mark[a:b].any() else without).append((a, b))
    rng = np.random.default_rng(seed)
    pick = rng.permutation(len(without))[: max(len(with_mark), 50)]
    return with_mark + [without[i] for i in sorted(pick)]


def fit(texts: list[np.ndarray], toxic: list[int], steps: int = 120, rate: float = 0.4, l2: float = 0.02, seed: int = 5) -> Model | None:
    """A CRF from the word hashes of whole texts and their labels, or None where no word marks toxicity."""
    h = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    o = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    y_doc = np.array(toxic, np.int64)
    marks = marking_words(h, o, y_doc)
    if not len(marks):
        return None
    mark = np.isin(h, marks)
    tag = mark & (y_doc[o] == 1)
    runs = _windows(mark, np.searchsorted(o, np.arange(len(texts) + 1)), WINDOW, seed)
    pick = np.concatenate([np.arange(a, b) for a, b in runs])
    first = np.concatenate(([0], np.cumsum([b - a for a, b in runs])))
    y, run_of = tag[pick].astype(np.float64), np.repeat(np.arange(len(runs)), np.diff(first))
    words, slots = _vocabulary(h[pick], marks)
    weights = np.zeros((3, len(words)))
    model = Model(words, slots, weights, np.zeros((2, 2)), 0.0)
    i = model.ids(h[pick])
    inner = np.flatnonzero(run_of[1:] == run_of[:-1])
    starts = first[:-1]
    n01, n10, n11 = (float((((1 - y) if p == 0 else y)[inner] * ((1 - y) if q == 0 else y)[inner + 1]).sum()) for p, q in ((0, 1), (1, 0), (1, 1)))
    bias, square = np.zeros(1), [np.full_like(weights, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    for _ in range(steps):
        u = _emission(weights, i, run_of) + bias[0]
        p, a, b = forward_backward(u, first, model.trans, model.start)
        d = y - p
        g = np.zeros_like(weights)
        g[0] = np.bincount(i, d, len(words))
        g[1] = np.bincount(i[inner], d[inner + 1], len(words))
        g[2] = np.bincount(i[inner + 1], d[inner], len(words))
        g -= l2 * weights
        on = np.exp(np.clip(u[inner + 1], -30, 30)) * b[inner + 1]
        t = np.exp(model.trans)
        w01, w10, w11 = t[0, 1] * on, a[inner] * t[1, 0], a[inner] * t[1, 1] * on
        z = t[0, 0] + w01 + w10 + w11
        gt = np.array([[0, n01 - (w01 / z).sum()], [n10 - (w10 / z).sum(), n11 - (w11 / z).sum()]]) - l2 * model.trans
        gb = np.array([d.sum(), d[starts].sum() - l2 * model.start])
        for x, s in zip((g, gt, gb), square):
            s += x * x
        weights += rate * g / np.sqrt(square[0])
        model.trans = model.trans + rate * gt / np.sqrt(square[1])
        bias += rate * gb[0] / np.sqrt(square[2][0])
        model.start += rate * gb[1] / np.sqrt(square[2][1])
    weights[0] += bias[0]
    model.weights = weights.astype(np.float32)
    return model


def tag_texts(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and offending character spans of each text."""
    held = list(scans(texts))
    u = [model.scores(s.hashes, s.text_of()) for _, _, s in held]
    n = np.concatenate([np.diff(s.first) for _, _, s in held]) if held else np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    p, _, _ = forward_backward(np.concatenate(u) if u else np.zeros(0), first, model.trans, model.start)
    score = np.zeros(len(texts))
    some = np.flatnonzero(n)
    if len(some):
        clean = np.log1p(-np.minimum(np.where(p >= NOISE, p, 0), 1 - 1e-12))
        score[some] = 1 - np.exp(np.add.reduceat(clean, first[some]))
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    for lo, _, s in held:
        base = first[lo]
        hot = np.flatnonzero(p[base : base + len(s.hashes)] >= 0.5)
        if not len(hot):
            continue
        owner = np.searchsorted(s.first, hot, "right") - 1
        characters = np.zeros(len(s.data) + 1, np.int64)
        np.cumsum((s.data & 0xC0) != 0x80, out=characters[1:])
        begin = characters[s.base[owner]]
        places = (characters[s.starts[hot]] - begin, characters[s.ends[hot]] - begin)
        for w, i, a, b in zip(hot.tolist(), owner.tolist(), *(x.tolist() for x in places)):
            own = spans[lo + i]
            if own and own[-1]["word"] == w - 1:
                own[-1].update(end=b, word=w)
            else:
                own.append({"start": a, "end": b, "word": w})
    return score, [[{"start": x["start"], "end": x["end"]} for x in own] for own in spans]


def word_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, y, doc_id, n, words): the hashes of a text's words, and their number."""
    for b in batches:
        for at, end, s in scans(b.column("text")):
            words = [s.hashes[x:y].tobytes() for x, y in zip(s.first[:-1], s.first[1:])]
            rows = [b.column(c).slice(at, end - at) for c in ("h", "y", "doc_id")]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.diff(s.first)), pa.array(words, pa.binary())], names=["h", "y", "doc_id", "n", "words"])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS, seed: int = 3) -> list[tuple[int, int, np.ndarray]]:
    """(doc_id, toxic, word hashes) of up to ``sample`` labelled documents, those of least hash of the doc_id.

    Of these, in the order of the hash, as many as hold ``sample_words`` words in all, and one at least.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    h = F.xxhash64(F.lit(seed), "doc_id")
    picked = known.withColumn("h", h).orderBy("h", "doc_id").limit(sample).select("h", "doc_id", (F.col("y") > 0).cast("int").alias("y")).toPandas()
    if not len(picked):
        return []
    ids = docs.sparkSession.createDataFrame(picked, "h long, doc_id long, y int")
    once = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("h", "y", "doc_id").agg(F.min("text").alias("text"))
    counted = once.mapInArrow(lean(word_hashes), "h long, y int, doc_id long, n long, words binary")
    before = F.sum("n").over(Window.orderBy("h", "doc_id")) - F.col("n")  # over ``sample`` rows at most
    rows = counted.withColumn("before", before).where((F.col("before") + F.col("n") <= sample_words) | (F.col("before") == 0)).toArrow()
    found = zip(rows["doc_id"].to_pylist(), rows["y"].to_pylist(), (np.frombuffer(w, np.uint64) for w in rows["words"].to_pylist()))
    return sorted(found, key=lambda r: r[0])


def toxic_spans(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """(doc_id, score, toxic, spans) for every row."""
    rows = labelled_sample(docs, labels, sample, sample_words)
    model = fit([r[2] for r in rows], [r[1] for r in rows]) if rows else None
    del rows
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            score, spans = (np.zeros(b.num_rows), [[]] * b.num_rows) if m is None else tag_texts(b.column("text"), m)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score), pa.array(score >= threshold), pa.array(spans, kind)], names=["doc_id", "score", "toxic", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, toxic boolean, spans array<struct<start:int,end:int>>")
