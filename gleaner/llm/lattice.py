"""Near-duplicate embeddings by E8 lattice hashing.

Each table projects the unit vectors with random Gaussian matrices onto blocks
of eight dimensions and decodes every block to its nearest point of the E8
lattice; the points of a table's blocks are the cell.  A vector also probes, for
each block, the ``PROBES`` neighbouring lattice points that are nearest to it.
The number of blocks follows the density (about ``leaf`` vectors a cell), and
the number of tables is what a simulation of pairs at the design cosine needs
for the recall.

Rows in a cell carry their vector in 16 bits an element, whose direction is off
by a known bound: inside a cell matrix products settle every pair that isn't
within that bound of ``min_cosine``, and those few are verified by the exact
cosine.  A cell gives a link from each member to the first of its component, so
that a thick group costs links and not pairs, and members known to be in one
component aren't compared again.  Cells of more than about ``hot`` members are
cut up (``common.search_cells``): there too every two vectors, one of them in its
own cell, are compared or in one component already.  Groups are the connected
components of the links.

Nulls, empties and ties: a NULL, empty or zero vector, and one with a NULL, NaN
or infinite element, is a group of its own, however often it occurs; shorter
vectors count as filled up with zeros; rows with a NULL vec_id are left out; of
rows that repeat a vec_id the least vector counts.  Identical vectors (by a hash
of 128 bits) are collapsed first.  The least vec_id of a group is its
representative.  Very long vectors work alike, a row costs two bytes an element
and cell; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import HOT, by_group, components, cut, known, lean, merge, mix, one_each, plain, search_cells, small_side

MIN_COSINE = 0.95
DESIGN_COSINE = 0.96
RECALL = 0.97
CELL = 1.6
PROBES = 2
LEAF = 256
FEW = 32


def _minimal_vectors() -> np.ndarray:
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a, b in product((1, -1), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    if len(odd):
        off = x[odd] - r[odd]
        k = np.abs(off).argmax(axis=1)
        r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    """One number for each row of lattice points."""
    h = np.full(len(points), np.uint64(salt))
    for c in range(points.shape[1]):
        h = mix(h + (2 * points[:, c]).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return h


@lru_cache(maxsize=256)
def _projection(seed: tuple[int, ...], dim: int) -> np.ndarray:
    return np.random.default_rng(list(seed)).normal(size=(dim, 8)) / CELL


def cells(unit: np.ndarray, table: int, blocks: int, probes: int = PROBES) -> Iterator[tuple[np.ndarray, bool]]:
    """Keys of the own cell (probe False) and of the probed cells of every row."""
    points, near = [], []
    for k in range(blocks):
        x = unit @ _projection((0, table, k), unit.shape[1])
        p = nearest_e8(x)
        points.append(p)
        if probes:
            gain = (x - p) @ NEIGHBOURS.T
            near.append(np.argpartition(-gain, probes - 1, axis=1)[:, :probes])
    own = [_key(p, k + 1) for k, p in enumerate(points)]
    salt = np.uint64(table * 0xD1342543DE82EF95 % (1 << 64))
    yield mix(sum(own, start=np.full(len(unit), salt))), False
    for k in range(blocks):
        rest = sum((own[j] for j in range(blocks) if j != k), start=np.full(len(unit), salt))
        for c in range(probes):
            yield mix(rest + _key(points[k] + NEIGHBOURS[near[k][:, c]], k + 1)), True


def plan(n: int, dim: int, recall: float = RECALL, design_cosine: float = DESIGN_COSINE, leaf: int = LEAF) -> tuple[int, int]:
    """(blocks, tables) for n vectors, from simulated vectors and pairs.

    Blocks are independent, so the chance of two vectors in one cell is that of one block to their number.
    """
    rng = np.random.default_rng(42)

    def unit(rows: int) -> np.ndarray:
        v = rng.normal(size=(rows, dim))
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    a, away = unit(4000), unit(4000)
    away -= (away * a).sum(axis=1, keepdims=True) * a
    size = np.linalg.norm(away, axis=1, keepdims=True)
    b = design_cosine * a + math.sqrt(1 - design_cosine**2) * away / np.where(size > 1e-9, size, 1)
    _, counts = np.unique(next(cells(a, 0, 1))[0], return_counts=True)
    together = min(max((counts * (counts - 1)).sum() / (len(a) * (len(a) - 1)), 1e-4), 0.5)
    blocks = max(1, math.ceil(math.log(max(n / leaf, 1)) / -math.log(together)))
    ka, kb = list(cells(a, 0, blocks)), list(cells(b, 0, blocks))
    found = ka[0][0] == kb[0][0]
    for k, _ in ka[1:]:
        found |= k == kb[0][0]
    for k, _ in kb[1:]:
        found |= k == ka[0][0]
    p = min(max(found.mean(), 0.01), 0.999)
    return blocks, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _matrix(embedding: pa.Array, dim: int) -> np.ndarray:
    """Unit rows; zeros where a vector can't be used."""
    n = len(embedding)
    out = np.zeros((n, dim))
    sizes = embedding.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = embedding.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, col] = flat
    most = np.abs(out).max(axis=1, initial=0)
    bad = ~np.isfinite(most) | (most == 0)
    out[bad] = 0
    out /= np.where(bad, 1, most)[:, None]  # so that no square is too great or too small
    return out / np.where(bad, 1, np.linalg.norm(out, axis=1))[:, None]


def _packed(unit: np.ndarray) -> pa.Array:
    """Each row as 16-bit elements, the greatest of them 32767."""
    q = np.ascontiguousarray(np.rint(unit * (32767 / np.maximum(np.abs(unit).max(axis=1, initial=0), 1e-300))[:, None]).astype("<i2"))
    width = 2 * q.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(np.arange(0, (len(q) + 1) * width, width, dtype=np.int32)), pa.py_buffer(q)])


def _unpacked(c: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Unit rows in 32 bits."""
    q = np.frombuffer(b"".join(c.to_pylist()), "<i2").reshape(-1, dim).astype(np.float32)
    return q / np.maximum(np.sqrt(np.einsum("ij,ij->i", q, q)), 1e-30)[:, None]


def slack(dim: int) -> float:
    """How far a cosine of packed vectors can be from the exact one."""
    return math.sqrt(dim) / 32767 + 1e-5


class _Links:
    """Components of the rows of some cells, and the pairs too near to ``min_cosine`` to be sure of."""

    def __init__(self, v: np.ndarray, own: np.ndarray, min_cosine: float, stars: bool, label: np.ndarray | None = None) -> None:
        self.v, self.own, self.stars = v, own, stars
        self.least, self.sure = min_cosine - slack(v.shape[1]), min_cosine + slack(v.shape[1])
        self.label = np.arange(len(v)) if label is None else label
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> None:
        if self.stars:
            known = c >= self.sure
            self.label = merge(self.label, i[known], j[known])
            i, j = i[~known], j[~known]
        if len(i):
            self.pairs.append((i, j))

    def few(self, cell: np.ndarray, rows: np.ndarray) -> None:
        """All pairs of small cells, side by side; ``rows`` are sorted by cell."""
        key = cell[rows]
        last, at, step = np.searchsorted(key, key, "right"), np.arange(len(rows)), 1
        while len(at):
            at = at[at + step < last[at]]
            for part in np.array_split(at, max(1, len(at) >> 15)):
                i, j = rows[part], rows[part + step]
                some = self.own[i] | self.own[j]
                i, j = i[some], j[some]
                c = np.einsum("ij,ij->i", self.v[i], self.v[j])
                near = c >= self.least
                if near.any():
                    self.add(i[near], j[near], c[near])
            step += 1

    def many(self, rows: np.ndarray) -> None:
        """All pairs of one cell that aren't in one component yet, by blocks."""
        todo = rows
        while len(todo):
            group = self.label[todo]
            same = group == group[0]
            if self.stars and same.sum() >= 128:
                query, target = todo[same][:1024], todo[~same]
            else:
                query, target = todo[:256], todo
            todo = todo[~np.isin(todo, query)]
            for at in range(0, len(target), 4096):
                t = target[at : at + 4096]
                c = self.v[query] @ self.v[t].T
                i, j = np.nonzero(c >= self.least)
                c, i, j = c[i, j], query[i], t[j]
                some = (i != j) & (self.own[i] | self.own[j])
                if some.any():
                    self.add(i[some], j[some], c[some])

    def unsure(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = (np.concatenate(x) for x in zip(*self.pairs))
        apart = self.label[i] != self.label[j]
        return i[apart], j[apart]


def _compare(dim: int, min_cosine: float, stars: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "cell", 1 << 16):
            cell, own, ids = t.column("cell").to_numpy(), t.column("own").to_numpy(), t.column("id").to_numpy()
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sizes = np.diff(np.append(first, len(cell)))
            use = (sizes > 1) & (np.add.reduceat(own, first, dtype=np.int64) > 0)
            before = known(cell, t.column("root").to_numpy()) if stars and "root" in t.column_names else np.arange(len(cell))
            links = _Links(_unpacked(t.column("v"), dim), own, min_cosine, stars, before)
            links.few(cell, np.flatnonzero(np.repeat(use & (sizes <= FEW), sizes)))
            for at, m in zip(first[use & (sizes > FEW)], sizes[use & (sizes > FEW)]):
                links.many(np.arange(at, at + m))
            moved = np.flatnonzero((before == np.arange(len(cell))) & (links.label != before))
            i, j = links.unsure()
            a, b = np.append(ids[links.label[moved]], ids[i]), np.append(ids[moved], ids[j])
            sure = np.arange(len(a)) < len(moved)
            pairs = np.stack([np.minimum(a, b), np.maximum(a, b), sure])[:, a != b]
            pairs = np.unique(pairs, axis=1) if pairs.size else pairs
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2] == 1)], names=["a", "b", "sure"])

    return run


def near_pairs(vectors: DataFrame, min_cosine: float = MIN_COSINE, recall: float = RECALL, stars: bool = False, hot: int = HOT, **cut_up) -> DataFrame:
    """(a, b): verified pairs of ``vectors`` (vec_id, embedding), unique by vec_id.

    With ``stars`` the pairs of a cell are replaced by links to the first member of each component.
    """
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    dim = max(1, size["d"] or 1)
    blocks, tables = plan(max(size["n"], 2), dim, recall)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = _matrix(b.column("embedding"), dim)
            usable = unit.any(axis=1)
            ids = b.column("vec_id").filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays([ids, _packed(unit[usable])], names=["id", "v"])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unpacked(b.column("v"), dim).astype(np.float64)
            for t in range(tables):
                for cell, probe in cells(unit, t, blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.full(len(unit), not probe)), b.column("id"), b.column("v")], names=["cell", "own", "id", "v"])

    def cosine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = np.einsum("ij,ij->i", _matrix(b.column("va"), dim), _matrix(b.column("vb"), dim))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(c)], names=["a", "b", "cosine"])

    members = cut(vectors.select("vec_id", "embedding").mapInArrow(lean(pack), "id long, v binary"))
    found = search_cells(members, spread, _compare(dim, min_cosine, stars), "cell long, own boolean, id long, v binary", stars, hot, **cut_up)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = cut(links.groupBy("a", "b").agg(F.max("sure").alias("sure")))
    va = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    vb = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    open_pairs = links.where("not sure").join(va, "a").join(vb, "b").select("a", "b", "va", "vb")
    settled = open_pairs.mapInArrow(lean(cosine), "a long, b long, cosine double").where(F.col("cosine") >= min_cosine)
    return links.where("sure").select("a", "b").unionByName(settled.select("a", "b"))


def near_duplicates(embeddings: DataFrame, min_cosine: float = MIN_COSINE, recall: float = RECALL, **search) -> DataFrame:
    """(vec_id, group_id, group_size, keep) for every numbered vector."""
    one = one_each(plain(embeddings, "vec_id", "embedding").select("vec_id", "embedding"), "vec_id", "embedding")
    infinite = F.lit(float("inf")).cast("float")
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < infinite, F.lit(False)))
    usable = F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    print_of = [F.xxhash64(F.lit(k), "embedding").alias(f"h{k}") for k in (1, 2)]
    prints = cut(one.select("vec_id", *(F.when(F.coalesce(usable, F.lit(False)), h).alias(f"h{k}") for k, h in zip((1, 2), print_of))))
    same = prints.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"))
    named = prints.join(same, ["h1", "h2"], "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.col("h1").isNotNull().alias("usable"))
    named = cut(named)
    repeated = small_side(named.where("rep <> vec_id").select("vec_id"))
    vectors = one.join(repeated, "vec_id", "left_anti").select("vec_id", "embedding")
    roots = components(near_pairs(vectors, min_cosine, recall, stars=True, **search))
    grouped = named.join(roots, F.col("rep") == F.col("node"), "left").select("vec_id", F.coalesce("root", "rep").alias("group_id"))
    sizes = small_side(grouped.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1"))
    return grouped.join(sizes, "group_id", "left").select("vec_id", "group_id", F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("vec_id") == F.col("group_id")).alias("keep"))
