import itertools
import random

import numpy as np
import pyarrow as pa

from gleaner.llm import toxicity
from gleaner.llm.common import scans
from tests.llm.cases import docs, odd_docs, words

BAD = ["vile", "rotten", "foul"]


def hashed(texts):
    return [s.hashes[a:b] for _, _, s in scans(pa.array(texts)) for a, b in zip(s.first[:-1], s.first[1:])]


def corpus(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        w = words(r.randrange(20, 80), seed * 10_000 + i, 300).split()
        y = int(i % 5 == 0)
        for _ in range(3 * y):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w), y))
    return rows


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    trans, start = rng.normal(size=(2, 2)), 0.3
    lengths = [1, 4, 0, 7, 2]
    u = rng.normal(size=sum(lengths))
    first = np.concatenate(([0], np.cumsum(lengths)))
    p, _, _ = toxicity.forward_backward(u, first, trans, start)
    for lo, hi in zip(first[:-1], first[1:]):
        total, ones = 0.0, np.zeros(hi - lo)
        for y in itertools.product((0, 1), repeat=hi - lo):
            if y:
                w = np.exp(start * y[0] + sum(u[lo + t] * s for t, s in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
                total, ones = total + w, ones + w * np.array(y)
        if hi > lo:
            assert np.allclose(p[lo:hi], ones / total)


def test_held_out_documents_and_offsets():
    train, test = corpus(600, 1), corpus(200, 2)
    model = toxicity.fit(hashed([t for _, t, _ in train]), [y for _, _, y in train])
    texts = [f"Ü é {t}" for _, t, _ in test]
    score, spans = toxicity.tag_texts(pa.array(texts), model)
    assert ((score >= toxicity.THRESHOLD) == [bool(y) for _, _, y in test]).mean() > 0.98
    found = [t[s["start"] : s["end"]] for t, own in zip(texts, spans) for s in own]
    assert found and all(set(f.split()) <= set(BAD) for f in found)
    want = sum(t.split().count(b) for t in texts for b in BAD)
    assert sum(len(f.split()) for f in found) >= 0.95 * want


def test_copies_of_one_mislabelled_text_mark_nothing():
    rows = corpus(600, 3)
    copy = words(60, 99, 300) + " harmless " + words(60, 98, 300)
    model = toxicity.fit(hashed([t for _, t, _ in rows] + [copy] * 40), [y for _, _, y in rows] + [1] * 40)
    score, _ = toxicity.tag_texts(pa.array([words(30, 97, 300) + " harmless"]), model)
    assert score[0] < toxicity.THRESHOLD


def test_odd_rows(spark):
    rows = corpus(600, 4)
    d = spark.createDataFrame([(i + 100, t) for i, t, _ in rows], "doc_id long, text string").unionByName(docs(spark).select("doc_id", "text"))
    labels = spark.createDataFrame([(i + 100, y, None) for i, _, y in rows] + [(100, 0, 1), (None, 1, 1), (1, None, 1), (99_999, 1, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.toxic_spans(d, labels).collect()
    assert len(got) == 614
    by = {r.doc_id: r for r in got if r.doc_id}
    assert all(by[i].score == 0 and by[i].spans == [] for i in (3, 4, 5, 6))
    assert sum(by[i + 100].toxic == bool(y) for i, _, y in rows) > 590


def test_words_that_share_a_slot_are_all_known():
    rng = np.random.default_rng(1)
    words = np.unique((rng.integers(0, 8, 3000, np.uint64) << np.uint64(44)) | rng.integers(1, 1 << 40, 3000, np.uint64))
    known, slots = toxicity._vocabulary(np.repeat(words[::2], 2), words[1:4])
    model = toxicity.Model(known, slots, np.zeros((3, len(known))), np.zeros((2, 2)), 0.0)
    want = {int(w): k for k, w in enumerate(known[:-1])}
    assert set(want) == {int(w) for w in words[::2]}
    got = toxicity.Model.ids(model, np.append(words, np.uint64(2**63)))
    assert got.tolist() == [want.get(int(w), len(known) - 1) for w in [*words, 2**63]]
    alone = toxicity._vocabulary(words[:9], words[3:5])[0]
    assert alone.tolist() == [*words[3:5].tolist(), 0]


def test_sample_is_bounded(spark):
    one = spark.range(20_000).selectExpr("1L as doc_id", "'a b c ' || id as text").union(spark.range(50).selectExpr("id + 2", "repeat('w ', 100)"))
    labels = spark.range(60).selectExpr("id as doc_id", "id % 2 as toxic", "'x' as text", "1 as `a.b`")
    rows = toxicity.labelled_sample(one, labels, 40)
    assert len(rows) <= 40 and len({r[0] for r in rows}) == len(rows)
    assert {r[0]: len(r[2]) for r in toxicity.labelled_sample(one, labels)} == {1: 4, **{i: 100 for i in range(2, 52)}}
    few = toxicity.labelled_sample(one, labels, sample_words=1_000)
    assert 0 < len(few) <= 11 and sum(len(r[2]) for r in few) <= 1_000
    assert len(toxicity.labelled_sample(one, labels, sample_words=1)) == 1


def test_offsets_of_a_long_text():
    train = corpus(600, 1)
    model = toxicity.fit(hashed([t for _, t, _ in train]), [y for _, _, y in train])
    text = "é vile w1 " * 30_000
    _, (spans,) = toxicity.tag_texts(pa.array([text]), model)
    assert len(spans) == 30_000 and all(text[s["start"] : s["end"]] == "vile" for s in spans)


def test_odd_columns(spark):
    rows = corpus(300, 6)
    labels = spark.createDataFrame([(i, bool(y), "u", {"k": 1}) for i, _, y in rows], "doc_id long, toxic boolean, `meta.url` string, text map<string,int>")
    assert toxicity.toxic_spans(odd_docs(spark), labels).count() == 16


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r.toxic for r in toxicity.toxic_spans(docs(spark), none).collect())
    assert toxicity.toxic_spans(docs(spark, []), none).count() == 0
