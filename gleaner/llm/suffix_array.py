"""Repeated passages by longest-previous-factor (LPF) arrays.

The corpus is the sequence of its documents in doc_id order, each a sequence of
words.  A word is removed when it lies in a factor of at least ``min_words``
words, inside one document, that also starts at an earlier position; so every
first occurrence stays and later copies go.

One suffix array of the whole corpus is not needed for that: two suffixes that
share ``min_words`` words also share their anchors, the minimizers of the
``GRAM``-word grams (least hash of every ``min_words - GRAM + 1`` neighbouring
grams).  Suffixes are bucketed by the gram at an anchor, and inside a bucket
sorted by what follows it; an earlier suffix with the longest common prefix is
then the previous or the next one in suffix order with a smaller corpus
position, found for all with one stack pass.  The same over the reversed text
before the anchor gives the longest extension to the left.  An anchor at which
the longest extensions come from different sources, none long enough alone, is
settled by comparing its few possible windows of ``min_words`` words.  A context
of ``min_words - GRAM`` words on either side is enough, since the next anchor
of a longer factor is within reach.

A task counts its own repeats before anything moves: of anchors that occur more
than once in a batch one row is sent, and of equal contexts the first; what
follows it in the batch is a later copy of as much as the context holds.  So
copies of one passage send a row a batch, however many there are.  An anchor in
more than ``hot`` places, whose contexts may differ all the same, isn't a bucket:
its windows of ``min_words`` words are hashed, and all but the first of equal
ones are later copies, which again takes a row a window and batch.

Nulls, empties and ties: rows with a NULL doc_id and texts with fewer than
``min_words`` words have no spans (``remove_repeats`` keeps them as they are).
Of rows that repeat a doc_id the one with the least text that isn't NULL counts
and stays.  Very long texts are read whole, in slices; an empty table gives an
empty result; other columns may have any name and type, ``remove_repeats``
passes them on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.llm.common import by_group, cut, lean, like, mix, one_each, plain, Scan, scans, without_number

MIN_WORDS = 50
GRAM = 30
MOST_HOT = 1_000_000
HOT_PLACES = 1 << 18
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(h: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the words i .. i+gram for each i of the run (its last gram-1 mean nothing)."""
    n = len(h)
    if n < gram:
        return np.zeros(0, np.uint64)
    out, done, power = h.copy(), 1, 1  # out[i] covers done words
    bits = bin(gram)[3:]
    width = n
    step = int(_STEP)
    for b in bits:
        width -= done
        out = out[:width] * np.uint64(pow(step, done, 1 << 64)) + out[done : done + width]
        done *= 2
        if b == "1":
            width -= 1
            out = out[:width] * _STEP + h[done : done + width]
            done += 1
    return mix(out)


def anchors(s: Scan, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(word index, gram hash) of the minimizers of every text of the scan."""
    g = _grams(s.hashes, gram)
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = np.diff(s.first)
    owner = s.text_of()
    # grams and windows that reach into the next text don't count
    last_gram = (s.first[1:] - gram)[owner[: len(g)]]
    window = min_words - gram + 1
    at = np.arange(len(g))
    low = np.where(at <= last_gram, g, np.uint64(0xFFFFFFFFFFFFFFFF))
    # least of `window` grams from i on, by doubling
    least, done = low, 1
    while done * 2 <= window:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    if done < window:
        least = np.minimum(least[: len(least) - (window - done)], least[window - done :])
    starts = np.flatnonzero(np.repeat(n >= min_words, n)[: len(least)] & (at[: len(least)] + window - 1 <= last_gram[: len(least)]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # i is an anchor if it is the least of a window that holds it: the nearest window starts tell
    reach = np.full(len(g), np.uint64(0))
    reach[starts] = least[starts]
    best, done = reach, 1  # greatest of the window minima over the windows that hold i
    while done * 2 <= window:
        best = np.concatenate((best[:done], np.maximum(best[done:], best[:-done])))
        done *= 2
    if done < window:
        k = window - done
        best = np.concatenate((best[:k], np.maximum(best[k:], best[:-k])))
    at = np.flatnonzero((low <= best) & (at <= last_gram))
    return at, g[at]


def _anchor_batches(min_words: int, gram: int):
    """(anchor, doc_id, at, n): anchors that occur once in a batch, and those known to be repeated.

    The latter have n = 0 and a random number as anchor, so that they are spread; n > 1 stands for all that a batch holds.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            hashes, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for at, end, s in scans(b.column("text")):
                i, h = anchors(s, min_words, gram)
                owner = np.searchsorted(s.first, i, "right") - 1
                hashes.append(h)
                docs.append(ids[at:end][owner])
                places.append((i - s.first[owner]).astype(np.int32))
            h, doc, place = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
            known, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
            again = n[inverse] > 1
            key = np.where(again, mix(doc.astype(np.uint64) * _STEP + place.astype(np.uint64)), h)
            more = known[n > 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(key, more).view(np.int64)),
                    pa.array(np.append(doc, np.zeros(len(more), np.int64))),
                    pa.array(np.append(place, np.zeros(len(more), np.int32))),
                    pa.array(np.append(np.where(again, 0, 1), n[n > 1]).astype(np.int32)),
                ],
                names=["anchor", "doc_id", "at", "n"],
            )

    return run


def _repeated(hot: int):
    """Of a partition sorted by anchor, the places of repeated anchors, and with doc_id NULL the anchors in over ``hot`` places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "anchor"):
            anchor, doc, at, n = (t.column(c).to_numpy() for c in ("anchor", "doc_id", "at", "n"))
            open_rows = np.flatnonzero(n > 0)
            known, inverse = np.unique(anchor[open_rows], return_inverse=True)
            total = np.bincount(inverse, n[open_rows], len(known))
            repeated = n == 0
            repeated[open_rows] = (n[open_rows] == 1) & (total[inverse] > 1)
            rows, thick = np.flatnonzero(repeated), np.flatnonzero(total > hot)
            no_doc = pa.nulls(len(thick), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(np.zeros(len(rows), np.int64), known[thick])),
                    pa.concat_arrays([pa.array(doc[rows]), no_doc]),
                    pa.array(np.append(at[rows], np.minimum(total[thick], 2**31 - 1)).astype(np.int32)),
                ],
                names=["anchor", "doc_id", "at"],
            )

    return run


class _Seen:
    """The first place (doc_id, at) of every key that a task has met."""

    def __init__(self) -> None:
        self.key, self.doc, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def first(self, key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which rows come before all others of their key so far."""
        out = np.zeros(len(key), bool)
        if not len(key):
            return out
        order = np.lexsort((at, doc, key))
        lead = order[np.append(True, key[order][1:] != key[order][:-1])]
        k, d, a = key[lead], doc[lead], at[lead]
        i = np.searchsorted(self.key, k)
        inside = np.minimum(i, max(len(self.key) - 1, 0))
        old = (self.key[inside] == k) if len(self.key) else np.zeros(len(k), bool)
        before = ~old
        if old.any():
            x = inside[old]
            before[old] = (d[old] < self.doc[x]) | ((d[old] == self.doc[x]) & (a[old] < self.at[x]))
            x, new = inside[old & before], old & before
            self.doc[x], self.at[x] = d[new], a[new]
        self.key, self.doc, self.at = (np.insert(mine, i[~old], theirs[~old]) for mine, theirs in ((self.key, k), (self.doc, d), (self.at, a)))
        out[lead[before]] = True
        return out


#: Kinds of rows that meet at an anchor: a context, a span that is known to repeat, a window of a hot anchor.
CONTEXT, KNOWN, WINDOW = 0, 1, 2
_ROWS = "anchor long, kind byte, doc_id long, at int, s int, e int, before binary, after binary"


def _row_hash(ctx: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(ctx), np.uint64(salt))
    for c in range(ctx.shape[1]):
        h = h * _STEP + ctx[:, c]
    return mix(h)


def _context_batches(min_words: int, gram: int, hot: np.ndarray):
    side = min_words - gram

    def rows(anchor, kind, doc, at, s, e, before=None, after=None) -> pa.RecordBatch:
        n = len(doc)
        empty = pa.array([b""] * n, pa.binary()) if before is None else None
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(np.full(n, kind, np.int8)), pa.array(doc), *(pa.array(x.astype(np.int32)) for x in (at, s, e)), *(empty if x is None else _binary(x.astype(">u4"), 4 * side) for x in (before, after))],
            names=["anchor", "kind", "doc_id", "at", "s", "e", "before", "after"],
        )

    def spans(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, s, e = joined(*(np.concatenate(x) for x in zip(*found)))
        return rows(mix(doc.astype(np.uint64) * _STEP + s.astype(np.uint64)), KNOWN, doc, s, s, e)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, seen = b.column("doc_id").to_numpy(), _Seen()
            repeats = b.column("ats")
            for at, end, s in scans(b.column("text")):
                i, h = anchors(s, min_words, gram)
                owner = np.searchsorted(s.first, i, "right") - 1
                marks = repeats.slice(at, end - at)
                offsets = marks.offsets.to_numpy()
                flat = marks.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(marks) else np.zeros(0, np.int32)
                known = np.isin(i, flat + np.repeat(s.first[:-1], np.diff(offsets)))
                run_of = np.flatnonzero(known)
                if not len(run_of):
                    continue
                p, o, g = i[run_of], owner[run_of], h[run_of]
                words = (s.hashes >> np.uint64(32)).astype(np.uint32)
                words[words == 0] = 1  # 0 means the end of the text
                reach = np.arange(side)
                ahead = p[:, None] + gram + reach
                behind = p[:, None] - 1 - reach
                right = np.where(ahead < s.first[o + 1][:, None], words[np.minimum(ahead, len(words) - 1)], np.uint32(0))
                left = np.where(behind >= s.first[o][:, None], words[np.maximum(behind, 0)], np.uint32(0))
                before, after = (left != 0).sum(axis=1), (right != 0).sum(axis=1)
                doc, place = ids[at:end][o], (p - s.first[o]).astype(np.int64)
                thick = np.isin(g, hot)
                key = mix(g ^ _row_hash(left, 1) * _STEP ^ _row_hash(right, 2))
                first = seen.first(key, doc, place)
                k = np.flatnonzero(~first & (before + gram + after >= min_words))
                later = [(doc[k], place[k] - before[k], place[k] + gram + after[k])]
                k = np.flatnonzero(first & ~thick)
                yield rows(g[k], CONTEXT, doc[k], place[k], place[k] * 0, place[k] * 0, left[k], right[k])
                for ahead_of in range(side + 1) if thick.any() else ():  # windows with so many words before the anchor
                    k = np.flatnonzero(first & thick & (before >= ahead_of) & (after >= side - ahead_of))
                    window = mix(g[k] ^ _row_hash(left[k, :ahead_of], 3 + ahead_of) * _STEP ^ _row_hash(right[k, : side - ahead_of], 3 + side + ahead_of))
                    lead = seen.first(window, doc[k], place[k])
                    a, z = place[k] - ahead_of, place[k] - ahead_of + min_words
                    yield rows(window[lead], WINDOW, doc[k][lead], place[k][lead], a[lead], z[lead])
                    later.append((doc[k][~lead], a[~lead], z[~lead]))
                yield spans(later)

    return run


def joined(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans [s, e) of each document, those that touch made one."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    first = np.append(True, doc[1:] != doc[:-1])
    base = (np.cumsum(first) - 1) * (int(e.max()) + 1)  # so that a document's ends are past all of those before
    reach = np.maximum.accumulate(e + base)
    new = first | np.append(False, (s + base)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], s[at], reach[last] - base[last]


def _binary(a: np.ndarray, width: int) -> pa.Array:
    n = len(a)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(a))])


def _matrix(c: pa.ChunkedArray, width: int) -> np.ndarray:
    c = c.combine_chunks()
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks)
    first = c.offset * width
    return np.frombuffer(c.buffers()[2], np.uint8)[first : first + len(c) * width].reshape(len(c), width)


def lpf(position: list[int], common: list[int]) -> tuple[list[int], list[int]]:
    """Longest previous factors over suffixes in suffix order.

    position: rank of each suffix in the corpus; common[i]: common prefix of the
    suffixes i-1 and i, negative between buckets.  Returns for each suffix the
    length and the index of the source: its nearest neighbour with a smaller
    position, above or below, that shares more; -1 where there is none.
    """
    n = len(position)
    length, source = [-1] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # (suffix, common prefix with the one under it)
    for i in range(n):
        c = common[i]
        if c < 0:
            stack.clear()
        p = position[i]
        # c: common prefix of i and the suffix on top
        while stack:
            top, under = stack[-1]
            if position[top] < p:
                break
            # i is the next smaller of top
            if c > length[top]:
                length[top], source[top] = c, i
            stack.pop()
            if under < c:
                c = under
        if stack:
            length[i], source[i] = c, stack[-1][0]
        stack.append((i, c))
    return length, source


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of rows, in words; an end of text (0) matches nothing."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


def _extend(bucket: np.ndarray, rank: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the longest common extension with an earlier row of its bucket, and that row."""
    words = ctx.view(">u4")
    order = np.lexsort((rank, _as_key(ctx), bucket))
    w, bk = words[order], bucket[order]
    common = np.full(len(order), -1)
    common[1:] = np.where(bk[1:] == bk[:-1], _common(w[1:], w[:-1]), -1)
    length, source = lpf(rank[order].tolist(), common.tolist())
    out_len, out_src = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    length, source = np.array(length), np.array(source)
    out_len[order] = length
    out_src[order] = np.where(source >= 0, order[source], -1)
    return out_len, out_src


def _as_key(ctx: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows in byte order."""
    keys = np.ascontiguousarray(ctx).view(f"S{ctx.shape[1]}")[:, 0]
    return np.unique(keys, return_inverse=True)[1]


def cover(anchor: np.ndarray, rank: np.ndarray, before: np.ndarray, after: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Words to the left of each anchor, and from it to the right, that a factor covers; 0, 0 for none."""
    r_len, r_src = _extend(anchor, rank, after)
    l_len, l_src = _extend(anchor, rank, before)
    lw, rw = before.view(">u4"), after.view(">u4")
    left, right = np.zeros(len(anchor), np.int64), np.zeros(len(anchor), np.int64)
    later = r_src >= 0
    rows = np.flatnonzero(later & (l_len + gram + r_len >= min_words))
    if not len(rows):
        return left, right
    r_back = _common(lw[rows], lw[r_src[rows]])  # what the source of the longest right shares to the left
    l_on = _common(rw[rows], rw[l_src[rows]])
    r_ok = r_back + gram + r_len[rows] >= min_words
    l_ok = l_len[rows] + gram + l_on >= min_words
    right[rows] = np.maximum(np.where(r_ok, gram + r_len[rows], 0), np.where(l_ok, gram + l_on, 0))
    left[rows] = np.maximum(np.where(l_ok, l_len[rows], 0), np.where(r_ok, r_back, 0))
    # The best on one side may come from a source that is too short in all: try each window of min_words.
    open_rows = rows[~(r_ok & l_ok)]
    if len(open_rows):
        k = min_words - gram
        h = np.stack([_windows(lw, rw, k, o) for o in range(k + 1)], axis=1)  # window with o words before the anchor
        for o in range(k + 1):
            fits = (l_len >= o) & (gram + r_len >= min_words - o) & later
            if not fits[open_rows].any():
                continue
            valid = np.ones(len(anchor), bool)
            if o:
                valid &= lw[:, o - 1] != 0
            if k - o:
                valid &= rw[:, k - o - 1] != 0
            cand = np.flatnonzero(valid)
            order = cand[np.lexsort((rank[cand], h[cand, o], anchor[cand]))]
            same = (anchor[order][1:] == anchor[order][:-1]) & (h[order, o][1:] == h[order, o][:-1])
            hit = np.zeros(len(anchor), bool)
            hit[order[1:][same]] = True
            hit_rows = open_rows[hit[open_rows]]
            left[hit_rows] = np.maximum(left[hit_rows], o)
            right[hit_rows] = np.maximum(right[hit_rows], min_words - o)
    return left, right


def _windows(lw: np.ndarray, rw: np.ndarray, k: int, o: int) -> np.ndarray:
    h = np.zeros(len(lw), np.uint64)
    for c in range(o):
        h = mix(h + lw[:, c].astype(np.uint64) * _STEP + np.uint64(c + 1))
    for c in range(k - o):
        h = mix(h + rw[:, c].astype(np.uint64) * _STEP + np.uint64(c + 1001))
    return h


def _cover_batches(min_words: int, gram: int):
    width = 4 * (min_words - gram)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "anchor", 1 << 17):
            kind = t.column("kind").to_numpy()
            out = [t.filter(pa.array(kind == KNOWN)).select(["doc_id", "s", "e"])]
            w = t.filter(pa.array(kind == WINDOW))
            if w.num_rows:
                key, doc, at = (w.column(c).to_numpy() for c in ("anchor", "doc_id", "at"))
                order = np.lexsort((at, doc, key))
                later = order[1:][key[order][1:] == key[order][:-1]]
                out.append(w.take(pa.array(later)).select(["doc_id", "s", "e"]))
            c = t.filter(pa.array(kind == CONTEXT))
            if c.num_rows:
                ids, at = c.column("doc_id").to_numpy(), c.column("at").to_numpy()
                rank = np.empty(len(ids), np.int64)
                rank[np.lexsort((at, ids))] = np.arange(len(ids))
                left, right = cover(c.column("anchor").to_numpy(), rank, _matrix(c.column("before"), width), _matrix(c.column("after"), width), min_words, gram)
                i = np.flatnonzero(right)
                out.append(pa.table({"doc_id": ids[i], "s": (at[i] - left[i]).astype(np.int32), "e": (at[i] + right[i]).astype(np.int32)}))
            for x in out:
                yield from x.combine_chunks().to_batches()

    return run


def word_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, hot: int = HOT_PLACES) -> DataFrame:
    """(doc_id, spans) of unique ``docs``: the words [s, e) around each anchor that an earlier factor covers."""
    texts = docs.select("doc_id", "text")
    found = cut(
        texts.mapInArrow(lean(_anchor_batches(min_words, gram)), "anchor long, doc_id long, at int, n int")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(lean(_repeated(hot)), "anchor long, doc_id long, at int")
    )
    # those in most places, if there are more: a bucket then holds at most a millionth of all places
    thick = found.where("doc_id is null").orderBy(F.desc("at"), "anchor").limit(MOST_HOT).toArrow()["anchor"].to_numpy().view(np.uint64)
    marks = found.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("at").alias("ats"))
    covered = (
        texts.join(marks, "doc_id")
        .mapInArrow(lean(_context_batches(min_words, gram, np.sort(thick))), _ROWS)
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(lean(_cover_batches(min_words, gram)), "doc_id long, s int, e int")
    )
    return covered.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(s.tolist(), e.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``removed`` (byte spans) and ``removed_words`` and cuts them from ``text``; NULL spans cut nothing."""
    for b in batches:
        texts, cuts, words = b.column("text").to_pylist(), b.column("spans"), []
        byte_spans: list[list[dict]] = []
        for at, end, s in scans(b.column("text")):
            for i in range(at, end):
                if not cuts[i].is_valid:
                    byte_spans.append([])
                    words.append(0)
                    continue
                got = cuts[i].values
                merged = _merged(got.field("s").to_numpy(), got.field("e").to_numpy())
                first, stop = s.first[i - at], s.first[i - at + 1]
                lo, hi = s.base[i - at], s.base[i - at + 1]
                raw, kept, here = bytes(s.data[lo:hi]), [], 0
                spans = []
                for a, e in merged:
                    x = int(s.starts[first + a] - lo)
                    y = int(s.starts[first + e] - lo) if first + e < stop else len(raw)
                    kept.append(raw[here:x])
                    spans.append({"start": x, "end": y})
                    here = y
                kept.append(raw[here:])
                texts[i] = b"".join(kept).decode("utf-8", "replace")
                byte_spans.append(spans)
                words.append(sum(e - a for a, e in merged))
        columns = {n: b.column(n) for n in b.schema.names if n != "spans"}
        columns["text"] = pa.array(texts, pa.string())
        columns["removed_words"] = pa.array(words, pa.int64())
        columns["removed"] = pa.array(byte_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_REMOVED = "removed_words long, removed array<struct<start:int,end:int>>"


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, **params) -> DataFrame:
    """Documents that hold later copies: doc_id, text without them, removed_words, removed byte spans."""
    unique = one_each(plain(docs, "doc_id", "text").select("doc_id", "text"))
    hit = unique.join(word_spans(unique, min_words, gram, **params), "doc_id")
    return hit.mapInArrow(lean(_cut_batches), f"doc_id long, text string, {_REMOVED}")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, **params) -> DataFrame:
    """``docs`` with later copies cut from ``text`` and n_chars counted anew.

    A document of which nothing but blanks is left goes; rows with a NULL doc_id stay as they are.
    """
    rows = plain(docs, "doc_id", "text", "n_chars")
    unique = one_each(rows)
    joined = unique.join(word_spans(unique, min_words, gram, **params), "doc_id", "left").select(*rows.columns, "spans")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(_REMOVED).fields])
    done = joined.mapInArrow(lean(_cut_batches), schema).where("removed_words = 0 or trim(text) <> ''")
    if "n_chars" in rows.columns:
        length = F.length("text").cast(rows.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.col("removed_words") > 0, length).otherwise(F.col("n_chars")))
    return like(done.select(*rows.columns).unionByName(without_number(rows)), docs)
