"""Shared parts of the training-data operators.

``Scan`` turns an Arrow string array into word hashes with numpy alone, so a
corpus is tokenised at a few nanoseconds a byte without Python objects.  A word
is a maximal run of ASCII letters, digits and non-ASCII bytes; words compare
without regard to case for ASCII and Latin-1 letters.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
            self.up = np.full(n, _BASE, np.uint64)
            self.down = np.full(n, _INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_POWERS = _Powers()


class Scan:
    """Words of a run of texts: hashes, byte spans and the first word of each text.

    hashes: uint64 per word; starts, ends: byte offsets into ``data``;
    first: n_texts + 1 offsets into the words; base: n_texts + 1 byte offsets.
    """

    def __init__(self, data: np.ndarray, base: np.ndarray) -> None:
        self.data, self.base = data, base
        n = len(data)
        word = _WORD[data]
        edge = np.zeros(n + 1, bool)
        edge[base] = True
        before = np.zeros(n + 1, bool)
        before[1:] = word
        here = np.zeros(n + 1, bool)
        here[:n] = word
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        self.first = np.searchsorted(self.starts, base)
        up, down = _POWERS.get(n + 1)
        v = _LOWER[data]
        if n and data.max() >= 0xC3:
            after = np.flatnonzero(data[:-1] == 0xC3) + 1
            c = data[after]
            v[after] = np.where((c >= 0x80) & (c <= 0x9E) & (c != 0x97), c + 32, c)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((v.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def __len__(self) -> int:
        return len(self.base) - 1

    def text_of(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) runs of about ``limit`` bytes; NULL is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        lo, hi = offsets[at], offsets[end]
        yield at, end, data[lo:hi], offsets[at : end + 1] - lo
        at = end


def scans(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Scan]]:
    for at, end, data, base in slices(texts):
        yield at, end, Scan(data, base)


def lean(run):
    """``run`` for mapInArrow, giving back at its end what its worker no longer uses.

    Workers are reused: without it the peak of one stage stays as the floor of the next.
    """

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def by_group(batches: Iterable[pa.RecordBatch], column: str, target_rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Regroup a partition sorted by ``column`` into tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < target_rows:
            continue
        key = b.column(column)
        first, last = key[0], key[-1]
        if first.equals(last) and (len(held) == 1 or held[-2].column(column)[-1].equals(first)) and held[0].column(column)[0].equals(last):
            continue
        t = pa.Table.from_batches(held)
        keys = t.column(column).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            rows = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    In local mode one is made where none is set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's own, of whatever file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: computed once, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


BROADCAST_IDS = 1_000_000


def small_side(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids``, computed once and marked for broadcast if it holds at most ``limit`` rows; beyond that the join shuffles."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= limit else ids


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root the least node.

    Alternating large-star and small-star steps; every step is one shuffle of
    the edges and the number of steps grows with the logarithm of the largest
    component.  Nodes without an edge to another node are not returned.
    """
    from pyspark.sql import Window

    u = Window.partitionBy("u")
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    both = cut(both)
    last = None
    while True:
        mark = both.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if mark == last or not mark[0]:
            break
        last = mark
        large = (
            both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
            .withColumn("m", F.least("u", F.min("v").over(u)))
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        small = large.withColumn("m", F.min("v").over(u))
        both = cut(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
    return both.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def plain(table: DataFrame, *needed: str) -> DataFrame:
    """``table`` with only the ``needed`` columns under their names; the others are x0, x1, ... in their order.

    So no name of the input can clash with one of an operator, or hold a dot or a quote;
    ``like`` gives the names back.
    """
    return table.toDF(*(c if c in needed else f"x{i}" for i, c in enumerate(table.columns)))


def like(inner: DataFrame, table: DataFrame, *more: str) -> DataFrame:
    """The columns of ``plain(table, ...)``, and ``more``, under the names that ``table`` gives them.

    A further column whose name the table has already is called mix_<name>, with as many mix_ as it takes.
    """
    names = list(table.columns)
    for c in more:
        while c.lower() in (n.lower() for n in names):
            c = f"mix_{c}"
        names.append(c)
    return inner.toDF(*names)


def one_each(rows: DataFrame, key: str = "doc_id", value: str = "text") -> DataFrame:
    """The rows of a ``plain`` table with a key, one a key: of rows that repeat one, that with the least value.

    NULL is the greatest value; equal values go by a digest of the whole row, so columns of any type may be
    there.  Finding repeats reads the key column only; rows are moved only where there are some.
    """
    numbered = rows.where(F.col(key).isNotNull())
    twice = cut(numbered.groupBy(key).count().where("count > 1").select(key))
    if twice.isEmpty():
        return numbered
    once = numbered.join(twice, key, "left_anti").select(*rows.columns)
    order = F.struct(F.col(value).isNull(), F.col(value), F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    least = numbered.join(twice, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("_row"))
    return once.unionByName(least.select("_row.*"))


def without_number(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.where(F.col(key).isNull())


HOT = 32_768
EVERY = 256


def hot_cells(cells: DataFrame, hot: int = HOT, every: int = EVERY) -> DataFrame:
    """(cell, chunks): the cells of more than about ``hot`` members, told by a sample of ``cells`` (cell).

    ``cells`` holds the members of every ``every``-th row; counts are added up before they move.
    """
    n = F.count("*") * every
    return cut(cells.groupBy("cell").agg(n.alias("n")).where(F.col("n") > hot).select("cell", F.ceil(F.col("n") * 2 / hot).cast("long").alias("chunks")))


def every_nth(column: str, every: int = EVERY) -> Column:
    """True for about one id in ``every``, by a hash."""
    return F.pmod(F.xxhash64(F.lit(71), column), F.lit(every)) == 0


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each row's least row so far) after the rows a[k] and b[k] are joined for every k."""
    a, b = label[a], label[b]
    while True:
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label, a, b = parent[label], parent[a], parent[b]


LEVELS = 4


def known(cell: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Each row's least row of the same cell and root."""
    _, first, place = np.unique(np.stack([cell, root]), axis=1, return_index=True, return_inverse=True)
    return first[place.reshape(-1)]


def search_cells(members: DataFrame, spread, compare, schema: str, stars: bool, hot: int = HOT, every: int = EVERY, levels: int = LEVELS) -> list[DataFrame]:
    """Links (a, b, sure) found in the cells over which ``spread`` lays ``members`` (id, ...).

    spread and compare are functions for mapInArrow: the first gives (cell, id, ...) of ``schema``, the second the
    links of rows sorted by cell; where these have a ``root``, members of a cell with one root count as linked.  No
    task holds more than about ``hot`` members, and yet every two members of a cell are compared: a cell of more is
    cut into chunks and every pair of chunks is a task of its own.  With ``stars``, where links need only give the
    components, ``levels`` - 1 rounds of chunks by other hashes come before.  What they find makes thick groups one
    component each; such a group has chunks to itself, and only pairs of chunks of one and the same group are left
    out.  So a cell of one thick group costs its rounds, and the rest of a cell a pass over it for every chunk.
    """
    links = "a long, b long, sure boolean"
    by_cell = lambda rows: rows.repartition("cell").sortWithinPartitions("cell")
    sample = members.where(every_nth("id", every)).mapInArrow(lean(spread), schema).select("cell")
    crowded = hot_cells(sample, hot, every)
    entries = members.mapInArrow(lean(spread), schema)
    if crowded.isEmpty():
        return [by_cell(entries).mapInArrow(lean(compare), links)]
    columns = entries.columns
    marked = entries.join(small_side(crowded), "cell", "left")
    found = [cut(by_cell(marked.where("chunks is null").select(*columns)).mapInArrow(lean(compare), links))]
    thick = cut(marked.where("chunks is not null"))
    for level in range(levels - 1 if stars else 0):
        chunk = F.pmod(F.xxhash64(F.lit(level + 17), "cell", "id"), F.col("chunks"))
        part = thick.withColumn("cell", F.xxhash64("cell", F.lit(level), chunk)).select(*columns)
        found.append(cut(by_cell(part).mapInArrow(lean(compare), links)))
    thick = thick.select(*columns, F.col("id").alias("root"))
    if stars:
        so_far = found[0]
        for more in found[1:]:
            so_far = so_far.unionByName(more)
        roots = components(so_far.where("sure").select("a", "b")).withColumnRenamed("root", "least")
        thick = thick.join(roots, F.col("id") == F.col("node"), "left").select(*columns, F.coalesce("least", "root").alias("root"))
        thick = cut(thick)
    found.append(by_cell(_chunk_pairs(thick, columns, hot)).mapInArrow(lean(compare), links))
    return found


def _chunk_pairs(thick: DataFrame, columns: list[str], hot: int) -> DataFrame:
    """``thick`` (cell, id, root, ...) once for every pair of chunks it is in, ``cell`` the pair.

    A root of more than half of ``hot`` members in a cell has chunks to itself; the others share some.
    """
    size = thick.groupBy("cell", "root").agg(F.count("*").alias("n"))
    chunks_of = F.ceil(F.col("n") * 2 / hot).cast("long")
    large = small_side(size.where(F.col("n") * 2 > hot).select("cell", "root", F.col("root").alias("kin"), chunks_of.alias("own_chunks")))
    shared = small_side(size.where(F.col("n") * 2 <= hot).groupBy("cell").agg(F.sum("n").alias("n")).select("cell", chunks_of.alias("chunks")))
    number = F.pmod(F.xxhash64(F.lit(71), "cell", "id", "root"), F.coalesce("own_chunks", "chunks"))
    placed = thick.join(large, ["cell", "root"], "left").join(shared, "cell", "left").select(*columns, "root", "kin", number.alias("chunk"))
    place = F.struct(F.col("kin").isNull().alias("shared"), F.coalesce("kin", F.lit(0).cast("long")).alias("kin"), "chunk")
    own = large.select("cell", "kin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_chunks") - 1)).alias("chunk"))
    rest = shared.select("cell", F.lit(None).cast("long").alias("kin"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    places = own.unionByName(rest).select("cell", place.alias("place"))
    pairs = places.join(places.withColumnRenamed("place", "other"), "cell")
    alike = ~F.col("place.shared") & ~F.col("other.shared") & (F.col("place.kin") == F.col("other.kin"))
    name = F.xxhash64("cell", F.least("place", "other"), F.greatest("place", "other"))
    pairs = small_side(pairs.where(~alike).select("cell", "place", name.alias("pair")))
    both = placed.withColumn("place", place).join(pairs, ["cell", "place"])
    return both.drop("cell").withColumnRenamed("pair", "cell").select(*columns, "root")
