"""Benchmark decontamination by spaced-seed hashing.

A fixed mask of ``WEIGHT`` of ``SPAN`` neighbouring words is hashed at every
position of the training texts and of the benchmark items; what the mask leaves
out may differ, and several masks leave out different words.  Equal hashes are
hits.  Around a hit the two texts are laid side by side and the aligned stretch
of up to ``reach`` words on either side is verified: a document is contaminated
when some window of ``min_words`` aligned words (the whole item, if it is
shorter) that holds the hit agrees in at least ``min_share`` of its words.

An item shorter than ``min_words`` must agree as a whole, so it is cut into one
part more than it may have changed words: one of them is untouched wherever the
item stands, and the parts are hashed as they are.  Items too short for any
change are one part.  So every overlap of such an item is hit.  Masks need a
window that holds them: where ``min_words`` is under SPAN, every run of
``min_words`` words of a longer item is cut into such parts instead.

The benchmark's hashes reach the tasks as a bit table, about 32 bits a hash and
between 2**20 and 2**31 bits in all, which only thins out the positions; what it
lets through is joined with the benchmark by hash, so that the benchmark may be
of any size.

Nulls, empties and ties: NULL and empty texts, items without words and rows with
a NULL doc_id or item_id match nothing.  Repeated rows give one result, the
greatest share counting.  Very long texts and items are read whole, in slices;
empty tables give no overlaps, and nothing is removed.  Other columns may have
any name and type; ``decontaminate`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import lean, like, mix, plain, Scan, scans, small_side, without_number

# 1 compares, 0 is ignored; neither mask is a shift of another.
MASKS = ("110100110101", "101011001011", "111001011001")
SPAN = 12
WEIGHT = 7
MIN_WORDS = 20
MIN_SHARE = 0.8
LEAST_BITS, MOST_BITS = 20, 31
_STEP = np.uint64(0x9E3779B97F4A7C15)
assert all(len(m) == SPAN and m.count("1") == WEIGHT for m in MASKS)


def seeds(s: Scan, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every placement of a mask inside one text."""
    m = len(s.hashes) - SPAN + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(mask + 1))
    for k, bit in enumerate(MASKS[mask]):
        if bit == "1":
            h *= _STEP
            h += s.hashes[k : k + m]
    text = s.text_of()
    at = np.flatnonzero(text[:m] == text[SPAN - 1 :])
    return at, mix(h[at])


def parts(words: int, min_share: float) -> list[tuple[int, int]]:
    """(start, length) of the parts of an item of so many words, one of which any overlap leaves untouched."""
    pieces = min(words, int((1 - min_share) * words + 1e-9) + 1)
    length = words // pieces
    return [(k * words // pieces, length) for k in range(pieces)]


def runs(s: Scan, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every run of ``length`` words inside one text."""
    m = len(s.hashes) - length + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(len(MASKS) + length))
    for k in range(length):
        h *= _STEP
        h += s.hashes[k : k + m]
    text = s.text_of()
    at = np.flatnonzero(text[:m] == text[length - 1 :])
    return at, mix(h[at])


def _part_runs(s: Scan, length: int, min_words: int, min_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Those runs that are parts of items shorter than ``min_words``, or of windows too short for a mask."""
    i, h = runs(s, length)
    o = np.searchsorted(s.first, i, "right") - 1
    n = np.diff(s.first)
    some = np.zeros(len(i), bool)
    for words in np.unique(n[(n > 0) & (n < min_words)]):
        starts = [a for a, size in parts(int(words), min_share) if size == length]
        some |= (n[o] == words) & np.isin(i - s.first[o], starts)
    if min_words < SPAN and length == parts(min_words, min_share)[0][1]:
        some |= n[o] >= min_words
    return i[some], h[some]


def _aligned(words: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: int) -> np.ndarray:
    """Rows of words at - reach .. at + SPAN + reach - 1 within [lo, hi); 0 outside."""
    p = at[:, None] + np.arange(-reach, SPAN + reach)
    return np.where((p >= lo[:, None]) & (p < hi[:, None]), words[np.clip(p, 0, max(len(words) - 1, 0))], 0).astype("<u4")


def _codes(s: Scan) -> np.ndarray:
    words = (s.hashes >> np.uint64(32)).astype(np.uint32)
    words[words == 0] = 1
    return words


def _rows(a: np.ndarray) -> pa.Array:
    n, width = len(a), a.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def _hit_batches(id_name: str, reach: int, table: Broadcast | None, lengths: list[int], min_words: int, min_share: float):
    masks = range(len(MASKS) if min_words >= SPAN else 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else table.value
        shift = None if table is None else np.uint64(64 - (8 * len(bits) - 1).bit_length())
        for b in batches:
            ids = b.column(id_name).to_numpy()
            for at, end, s in scans(b.column("text")):
                words = _codes(s)
                short = (runs(s, n) if bits is not None else _part_runs(s, n, min_words, min_share) for n in lengths)
                for i, h in chain((seeds(s, mask) for mask in masks), short):
                    if bits is not None:
                        slot = h >> shift
                        some = (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        i, h = i[some], h[some]
                    if not len(i):
                        continue
                    o = np.searchsorted(s.first, i, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(ids[at:end][o]), pa.array((i - s.first[o]).astype(np.int32)), pa.array((s.first[o + 1] - s.first[o]).astype(np.int32)), _rows(_aligned(words, i, s.first[o], s.first[o + 1], reach))],
                        names=["seed", id_name, f"{id_name}_at", f"{id_name}_words", f"{id_name}_row"],
                    )

    return run


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, s in scans(b.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(s.first).astype(np.int32))], names=["n"])


def _schema(id_name: str) -> str:
    return f"seed long, {id_name} long, {id_name}_at int, {id_name}_words int, {id_name}_row binary"


def _bit_table(hits: DataFrame) -> np.ndarray:
    """The bit table of the benchmark's hashes, put together from pieces of 2**15 bits."""
    bits = min(max((32 * hits.count()).bit_length(), LEAST_BITS), MOST_BITS)
    slot = F.shiftrightunsigned(F.col("seed"), 64 - bits)
    rows = hits.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits"))
    table = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for r in rows.toLocalIterator():
        table[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def agreement(doc: np.ndarray, item: np.ndarray, item_words: np.ndarray, reach: int, min_words: int) -> np.ndarray:
    """Greatest share of equal words over the windows of min(min_words, item) aligned words that hold the seed.

    An item shorter than ``min_words`` is a window by itself, which holds its seed's first word.
    """
    both = (doc != 0) & (item != 0)
    same = (doc == item) & both
    width = doc.shape[1]
    total = np.concatenate((np.zeros((len(doc), 1), np.int32), np.cumsum(same, axis=1, dtype=np.int32)), axis=1)
    inside = np.concatenate((np.zeros((len(doc), 1), np.int32), np.cumsum(both, axis=1, dtype=np.int32)), axis=1)
    best = np.zeros(len(doc))
    for size in np.unique(np.minimum(item_words, min_words)):
        rows = np.flatnonzero(np.minimum(item_words, min_words) == size)
        span = SPAN if size == min_words >= SPAN else 1
        for start in range(max(0, reach + span - size), min(reach, width - size) + 1):
            full = inside[rows, start + size] - inside[rows, start] == size
            best[rows] = np.maximum(best[rows], np.where(full, (total[rows, start + size] - total[rows, start]) / size, 0))
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, share): the verified overlaps, one row a pair; ``min_words`` is 1 at least."""
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    spark = docs.sparkSession
    reach = max(1, min_words - 1)
    named = benchmark.where("item_id is not null").select("item_id", "text")
    sizes = [r.n for r in named.mapInArrow(lean(_sizes), "n int").where((F.col("n") > 0) & (F.col("n") < min_words)).distinct().collect()]
    lengths = sorted({size for n in [*sizes, *([min_words] if min_words < SPAN else [])] for _, size in parts(n, min_share)})
    items = named.mapInArrow(lean(_hit_batches("item_id", reach, None, lengths, min_words, min_share)), _schema("item_id"))
    bits = spark.sparkContext.broadcast(_bit_table(items))
    places = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(lean(_hit_batches("doc_id", reach, bits, lengths, min_words, min_share)), _schema("doc_id"))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            d, i = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(n, -1) for c in ("doc_id_row", "item_id_row"))
            share = agreement(d, i, b.column("item_id_words").to_numpy(), reach, min_words)
            keep = pa.array(share >= min_share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(keep), b.column("item_id").filter(keep), pa.array(share).filter(keep)], names=["doc_id", "item_id", "share"])

    hits = places.join(items, "seed").select("doc_id", "doc_id_row", "item_id", "item_id_words", "item_id_row")
    return hits.mapInArrow(lean(verify), "doc_id long, item_id long, share double").groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the contaminated ones; rows with a NULL doc_id stay."""
    rows = plain(docs, "doc_id", "text")
    hit = small_side(overlaps(rows, benchmark, **params).select("doc_id").distinct())
    kept = rows.where("doc_id is not null").join(hit, "doc_id", "left_anti").select(*rows.columns)
    return like(kept.unionByName(without_number(rows)), docs)
