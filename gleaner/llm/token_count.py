"""Token counts by a linear longest-match automaton.

Counts the pieces that greedy longest-match-first tokenisation gives, without
building a piece.  A text is split at ASCII blanks into words, each is led by
one blank, and the longest vocabulary entry that starts the rest of the word is
taken again and again.  The vocabulary is a trie over bytes; each node has a
failure link (what is left of its string once the longest match that starts it
is popped, followed through the trie) and the number of pieces popped on the
way, precomputed.  Resolved for every node and byte this is a table: one step a
byte, whatever the vocabulary.  Words of a batch step side by side.

The vocabulary file is read on the driver, its path is a parameter; every single
byte counts as a piece, so that any text has a count.  NULL texts have a NULL
count, empty and blank ones 0; every row is counted, repeated and NULL doc_ids
included.  Very long texts are counted whole, in slices, and very long words byte
by byte; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.common import lean, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LONG_WORD = 4096


def read_vocabulary(path: str) -> list[bytes]:
    """The entries of a ranks file: one base64 entry and its rank a line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """step[node, byte] and pop[node, byte]: next node and pieces popped; rest[node]: pieces at a word's end."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        words = sorted({bytes([b]) for b in range(256)} | {w for w in vocabulary if w})
        children: list[dict[int, int]] = [{}]
        is_word, parent, byte, depth = [False], [0], [0], [0]
        for w in words:
            at = 0
            for b in w:
                new = children[at].get(b)
                if new is None:
                    new = children[at][b] = len(children)
                    children.append({})
                    is_word.append(False)
                    parent.append(at)
                    byte.append(b)
                    depth.append(depth[at] + 1)
                at = new
            is_word[at] = True
        n = len(children)
        self.step = np.zeros((n, 256), np.int32)
        self.pop = np.zeros((n, 256), np.uint8)
        self.rest = np.zeros(n, np.int32)
        parent_a, byte_a, depth_a, word_a = map(np.array, (parent, byte, depth, is_word))
        fail, popped = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b, c in children[0].items():
            self.step[0, b] = c
        # by depth: the table of a failure node is ready before that of a deeper node
        order = np.argsort(depth_a, kind="stable")
        bounds = np.searchsorted(depth_a[order], np.arange(depth_a.max() + 2))
        for d in range(1, depth_a.max() + 1):
            level = order[bounds[d] : bounds[d + 1]]
            own = word_a[level]
            # a word pops itself; else the parent's remainder takes the last byte
            p, b = parent_a[level], byte_a[level]
            f = fail[p]
            fail[level] = np.where(own, 0, self.step[f, b])
            popped[level] = np.where(own, 1, popped[p] + self.pop[f, b])
            self.step[level] = self.step[fail[level]]
            total = self.pop[fail[level]].astype(np.int64) + popped[level][:, None]
            if total.max(initial=0) > 255:
                raise ValueError("a vocabulary entry is longer than 255 pieces")
            self.pop[level] = total
            self.rest[level] = popped[level] + self.rest[fail[level]]
            for node in level[[bool(children[x]) for x in level]]:
                for b, c in children[node].items():
                    self.step[node, b] = c
                    self.pop[node, b] = 0

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end], led by a blank."""
        n = ends - starts
        order = np.argsort(-n, kind="stable")
        n, at = n[order], starts[order]
        state = np.full(len(n), self.step[0, 32], np.int32)
        out = np.zeros(len(n), np.int64)
        step, pop = self.step.ravel(), self.pop.ravel()
        many = int(np.searchsorted(-n, -LONG_WORD, "left"))
        for k in range(many):  # a word that long steps alone
            s, total = int(state[k]), 0
            table, pops = self.step, self.pop
            for b in data[at[k] : at[k] + n[k]].tolist():
                total += int(pops[s, b])
                s = int(table[s, b])
            state[k], out[k] = s, total
        live, j = len(n), 0
        lengths = -n
        while True:
            live = int(np.searchsorted(lengths, -j, "left"))
            if live <= many:
                break
            idx = state[many:live].astype(np.int64) * 256 + data[at[many:live] + j]
            out[many:live] += pop[idx]
            state[many:live] = step[idx]
            j += 1
        out += self.rest[state]
        back = np.empty(len(n), np.int64)
        back[order] = out
        return back


#: The last automaton of this process, by what it was built from.
_BUILT: dict[str, Automaton] = {}


def count_texts(texts: pa.Array, automaton: Automaton) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for at, end, data, base in slices(texts):
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[base] = True
        before = np.append(False, inside[:-1])
        starts = np.flatnonzero(inside & (~before | edge))
        ends = np.flatnonzero(before & (~inside | edge))
        if not len(starts):
            continue
        counts = np.append(0, np.cumsum(automaton.count(data, starts, ends)))
        first = np.searchsorted(starts, base)
        out[at:end] = counts[first[1:]] - counts[first[:-1]]
    return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row."""
    words = read_vocabulary(vocabulary)
    digest = hashlib.sha256(b"".join(len(w).to_bytes(4) + w for w in words)).hexdigest()
    entries = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _BUILT:
            _BUILT.clear()
            _BUILT[digest] = Automaton(entries.value)
        for b in batches:
            text = b.column("text")
            counts = pa.array(count_texts(text, _BUILT[digest]), mask=text.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long")
