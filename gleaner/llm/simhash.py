"""Near-duplicate documents by SimHash and an LSH forest.

Each document gets a 256-bit SimHash of its distinct word bigrams; two documents
are near duplicates when their fingerprints differ in at most ``max_distance``
bits.  A tie of a bit's votes is broken by the bigram of least hash: related
texts mostly share it, unrelated ones don't, so that ties don't draw short texts
together.

The forest holds several tries, each over its own random permutation of the
bits.  Equal fingerprints are collapsed first.  The prefix depth follows the
density: it starts where a leaf would hold about ``leaf`` of the n distinct
fingerprints, and climbs to shorter prefixes until ``max_tries`` tries reach
``recall`` for a pair whose distance is ``max_distance``.  Every two members of a
node are compared on all 256 bits, however many it has (large nodes by products
of matrices), or are in one group already; groups are the connected components
of the pairs found.  Nodes of more than about ``hot`` distinct fingerprints are cut
up (``common.search_cells``), so that no task holds them whole, and yet every
two of their members are compared or in one group already.  A task keeps
components and not pairs: those of thick groups would fill its memory.

Nulls, empties and ties: a row with a NULL doc_id can't be named, so it is left
out (``keep_one`` keeps it).  A text without words (NULL, empty, blank) has no
fingerprint and is a group of its own; one with marks but no words is compared
whole.  Of rows that repeat a doc_id the one with the least text that isn't NULL
counts.  The least doc_id of a group is its representative.  Very long texts are
read whole, in slices; an empty table gives an empty result; other columns may
have any name and type, ``keep_one`` passes them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import HOT, Scan, by_group, components, cut, known, lean, like, merge, mix, one_each, plain, scans, search_cells, small_side, without_number

BITS = 256
WORDS = BITS // 64
MAX_DISTANCE = 56
RECALL = 0.95
LEAF = 16
MAX_TRIES = 64
DENSE = 64
CROWDED = 1024
PIVOTS = 16
BLOCK = 512
ENTRIES = 1 << 19
FOLD = 1 << 20
FP = [f"f{i}" for i in range(WORDS)]

_LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
_SEEDS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _sum_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text the count of ones of each of 64 bits; ``first`` delimits non-empty runs of ``h``."""
    n = np.diff(first)
    pieces = -(-n // 255)
    piece_first = np.concatenate(([0], np.cumsum(pieces)))
    owner = np.repeat(np.arange(len(n)), pieces)
    starts = first[:-1][owner] + 255 * (np.arange(piece_first[-1]) - piece_first[:-1][owner])
    out = np.empty((len(n), 64), np.int64)
    octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, k]], starts)
        out[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), piece_first[:-1], axis=0, dtype=np.int64)
    return out


def _features(s: Scan, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigram hashes (the word itself of one-word texts) by text, ascending, and the text of each."""
    if not len(s.hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = s.text_of()
    pair = np.append(mix(s.hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + s.hashes[1:]), np.uint64(0))
    keep = np.append(owner[:-1] == owner[1:], False)
    alone = s.first[:-1][n == 1]
    pair[alone], keep[alone] = s.hashes[alone], True
    pair, owner = pair[keep], owner[keep]
    order = np.lexsort((pair, owner))
    pair, owner = pair[order], owner[order]
    new = np.append(True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1]))
    return pair[new], owner[new]


def fingerprints(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) uint64 fingerprints and the mask of the texts that have one."""
    total = len(texts)
    fps, has = np.zeros((total, WORDS), np.uint64), np.zeros(total, bool)
    for at, end, s in scans(texts):
        n = np.diff(s.first)
        feature, owner = _features(s, n)
        count = np.bincount(owner, minlength=len(s))
        wordless = [i for i in np.flatnonzero(n == 0) if bytes(s.data[s.base[i] : s.base[i + 1]]).strip()]
        for i in wordless:
            raw = np.frombuffer(bytes(s.data[s.base[i] : s.base[i + 1]]).strip(), np.uint8).astype(np.uint64)
            one = mix(np.array([np.sum(mix(raw + np.arange(len(raw), dtype=np.uint64) * np.uint64(257)))], np.uint64))
            fps[at + i] = [mix(one ^ x)[0] for x in _SEEDS]
            has[at + i] = True
        some = np.flatnonzero(count > 0)
        if not len(some):
            continue
        first = np.concatenate(([0], np.cumsum(count[some])))
        even = (np.diff(first) % 2 == 0)[:, None]
        least = feature[first[:-1]]
        for w in range(WORDS):
            vote = np.unpackbits(mix(least ^ _SEEDS[w])[:, None].view(np.uint8), axis=1, bitorder="little")
            ones = 2 * (_sum_bits(mix(feature ^ _SEEDS[w]), first) + (even & (vote == 1))) > np.diff(first)[:, None] + even
            fps[at + some, w] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]
        has[at + some] = True
    return fps, has


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, has = fingerprints(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), *(pa.array(fps[:, w].view(np.int64), mask=~has) for w in range(WORDS))], names=["doc_id", *FP]
        )


def plan(n: int, recall: float = RECALL, distance: int = MAX_DISTANCE, leaf: int = LEAF, max_tries: int = MAX_TRIES) -> tuple[int, int]:
    """(depth, tries) for n fingerprints: climb from the density's depth until the recall is met at ``distance``.

    A try is counted at ``RECALL`` of what it finds, as a margin: nodes are compared whole.
    """

    def tries(depth: int) -> int:
        p = RECALL * math.prod((BITS - distance - i) / (BITS - i) for i in range(depth))
        return math.ceil(math.log(1 - recall) / math.log1p(-p))

    depth = max(1, min(40, round(math.log2(max(n, 2) / leaf))))
    while depth > 1 and tries(depth) > max_tries:
        depth -= 1
    return depth, tries(depth)


def _permutations(tries: int, depth: int) -> np.ndarray:
    return np.stack([np.random.default_rng(1000 + t).permutation(BITS)[:depth] for t in range(tries)])


def _prefixes(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bits of each fingerprint at the given places, as one number."""
    out = np.zeros(len(fps), np.uint64)
    for i, k in enumerate(bits):
        out |= ((fps[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1)) << np.uint64(i)
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(a[:, w] ^ b[:, w]).astype(np.int16) for w in range(WORDS))


class _Links:
    """Pairs of rows; with ``stars`` only the components they make, pairs of a component not being looked at again."""

    def __init__(self, label: np.ndarray, stars: bool) -> None:
        self.label, self.stars = label, stars
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def open(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that can still tell something."""
        if not self.stars:
            return i, j
        apart = self.label[i] != self.label[j]
        return i[apart], j[apart]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.held.append((i, j))
            self.n += len(i)
            if self.stars and self.n > FOLD:
                self.fold()

    def fold(self) -> None:
        if self.held:
            self.label = merge(self.label, *self.pairs())
            self.held, self.n = [], 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held])


def _close_in_runs(fps: np.ndarray, rows: np.ndarray, run: np.ndarray, limit: int, links: _Links) -> None:
    """Adds the pairs of rows of one run at distance <= limit; ``rows`` are sorted by run."""
    last = np.searchsorted(run, run, "right")
    at = np.arange(len(run))
    step = 1
    while len(at):
        at = at[at + step < last[at]]
        for part in np.array_split(at, max(1, len(at) >> 18)):
            i, j = links.open(rows[part], rows[part + step])
            near = _distance(fps[i], fps[j]) <= limit
            links.add(i[near], j[near])
        step += 1


def _one_to_all(fps: np.ndarray, one: int, rows: np.ndarray, limit: int, links: _Links) -> None:
    i, j = links.open(np.full(len(rows), one), rows)
    near = np.flatnonzero(_distance(fps[one : one + 1], fps[j]) <= limit)
    links.add(i[near], j[near])


def _search(fps: np.ndarray, rows: np.ndarray, run: np.ndarray, limit: int, links: _Links) -> None:
    """Adds the pairs in runs of ``rows`` (sorted by run); every two rows of a run are compared, or joined already."""
    if not len(run):
        return
    cuts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(cuts, len(run)))
    if links.stars:
        label = links.label[rows]
        mixed = np.minimum.reduceat(label, cuts) != np.maximum.reduceat(label, cuts)
    else:
        mixed = sizes > 1
    dense = sizes > DENSE
    small = np.flatnonzero(np.repeat(mixed & ~dense, sizes))
    _close_in_runs(fps, rows[small], run[small], limit, links)
    for at, m in zip(cuts[dense & mixed], sizes[dense & mixed]):
        own = rows[at : at + m]
        if m > CROWDED and links.stars:
            _crowded(fps, own, limit, links)
        else:
            _whole(fps, own, limit, links)


def _crowded(fps: np.ndarray, own: np.ndarray, limit: int, links: _Links) -> None:
    """The components of one crowded run, with labels of its own; thick groups are joined over a few rows first."""
    mine = _Links(known(np.zeros(len(own), np.int64), links.label[own]), True)
    fps, all_rows, before = fps[own], np.arange(len(own)), mine.label
    for one in range(0, len(own), -(-len(own) // PIVOTS)):
        _one_to_all(fps, one, all_rows, limit, mine)
        mine.fold()
    _whole(fps, np.argsort(mine.label, kind="stable"), limit, mine)
    mine.fold()
    moved = np.flatnonzero(mine.label != before)
    links.add(own[mine.label[moved]], own[moved])


def _signs(fps: np.ndarray) -> np.ndarray:
    """1 and -1 for the bits: the product of two rows is BITS less twice their distance, exact in single precision."""
    return np.unpackbits(fps.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _whole(fps: np.ndarray, own: np.ndarray, limit: int, links: _Links) -> None:
    """Adds the pairs of the rows ``own``, compared in blocks; blocks of one component are left out with ``stars``."""
    for i0 in range(0, len(own), BLOCK):
        a = own[i0 : i0 + BLOCK]
        left = _signs(fps[a])
        for j0 in range(i0, len(own), BLOCK):
            b = own[j0 : j0 + BLOCK]
            if links.stars and (links.label[a] == links.label[b[0]]).all() and (links.label[b] == links.label[b[0]]).all():
                continue
            right = left if i0 == j0 else _signs(fps[b])
            i, j = np.divmod(np.flatnonzero(left @ right.T >= BITS - 2 * limit), len(b))
            if i0 == j0:
                i, j = i[i < j], j[i < j]
            links.add(*links.open(a[i], b[j]))


def close_pairs(fps: np.ndarray, run: np.ndarray, limit: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in runs (sorted)."""
    links = _Links(np.arange(len(run)), False)
    _search(fps, np.arange(len(run)), run, limit, links)
    return links.pairs()


def close_groups(fps: np.ndarray, run: np.ndarray, limit: int = MAX_DISTANCE, label: np.ndarray | None = None) -> np.ndarray:
    """Each row's least row of its component in its run (sorted); ``label`` is what is known of it before."""
    links = _Links(np.arange(len(run)) if label is None else label, True)
    _search(fps, np.arange(len(run)), run, limit, links)
    links.fold()
    return links.label


def signatures(unique: DataFrame) -> DataFrame:
    """(doc_id, f0..f3) of rows unique by doc_id, computed in one scan of the texts.

    They are moved once, so that the checkpoint has few files: for each one Hadoop, where it has no native
    library, lets the executor start processes, and each of these looks as large as the executor until it runs.
    """
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in FP)
    return cut(unique.select("doc_id", "text").mapInArrow(lean(_fingerprint_batches), schema).repartition("doc_id"))


def _matrix(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().view(np.uint64) for c in FP], axis=1)


def _compare(max_distance: int, stars: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "cell"):
            cell, ids = t.column("cell").to_numpy(), t.column("id").to_numpy()
            if stars:
                before = known(cell, t.column("root").to_numpy()) if "root" in t.column_names else np.arange(len(ids))
                label = close_groups(_matrix(t), cell, max_distance, before)
                j = np.flatnonzero((before == np.arange(len(ids))) & (label != before))
                i = label[j]
            else:
                i, j = close_pairs(_matrix(t), cell, max_distance)
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            pairs = np.stack([a, b])[:, a != b]
            pairs = np.unique(pairs, axis=1) if pairs.size else pairs
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.ones(pairs.shape[1], bool))], names=["a", "b", "sure"])

    return run


def near_pairs(reps: DataFrame, max_distance: int = MAX_DISTANCE, recall: float = RECALL, stars: bool = False, hot: int = HOT, **cut_up) -> DataFrame:
    """(a, b): verified pairs of the distinct fingerprints ``reps`` (rep, f0..f3).

    With ``stars`` the pairs found together are replaced by edges to the first
    member of each component, so that thick groups don't cost pairs.  A task that
    lays fingerprints over the tries writes about ``ENTRIES`` entries, however many
    ``reps`` there are: its heap holds them until they are sorted.
    """
    n = reps.count()
    depth, tries = plan(n, recall, max_distance)
    bits = _permutations(tries, depth)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, names = _matrix(b), ["cell", "id", *FP]
            for t in range(tries):
                node = (np.uint64(t) << np.uint64(48)) | _prefixes(fps, bits[t])
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(b.column(c) for c in names[1:])], names=names)

    members = reps.select(F.col("rep").alias("id"), *FP).repartition(max(1, math.ceil(n * tries / ENTRIES)), "id")
    schema = "cell long, id long, " + ", ".join(f"{c} long" for c in FP)
    found = search_cells(members, spread, _compare(max_distance, stars), schema, stars, hot, **cut_up)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.select("a", "b").distinct()


def _groups(unique: DataFrame, max_distance: int = MAX_DISTANCE, recall: float = RECALL, **search) -> DataFrame:
    """(doc_id, group_id) of rows unique by doc_id."""
    sig = signatures(unique)
    reps = cut(sig.where("f0 is not null").groupBy(*FP).agg(F.min("doc_id").alias("rep")))
    roots = components(near_pairs(reps, max_distance, recall, stars=True, **search))
    named = sig.join(reps, FP, "left").join(roots, F.col("rep") == F.col("node"), "left")
    return named.select("doc_id", F.coalesce("root", "rep", "doc_id").alias("group_id"))


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, group_id, group_size, keep) for every numbered document."""
    named = cut(_groups(one_each(plain(docs, "doc_id", "text").select("doc_id", "text")), **params))
    sizes = small_side(named.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1"))
    return named.join(sizes, "group_id", "left").select("doc_id", "group_id", F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("doc_id") == F.col("group_id")).alias("keep"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each group; rows with a NULL doc_id stay."""
    rows = plain(docs, "doc_id", "text")
    unique = one_each(rows)
    drop = small_side(_groups(unique, **params).where("doc_id <> group_id").select("doc_id"))
    kept = unique.join(drop, "doc_id", "left_anti").select(*rows.columns)
    return like(kept.unionByName(without_number(rows)), docs)
