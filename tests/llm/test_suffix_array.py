import numpy as np
import pytest

from gleaner.llm import suffix_array
from gleaner.llm.suffix_array import lpf
from tests.llm.cases import docs, odd_docs, simple, words


def brute(texts, k):
    """Words in a run of k words that starts at an earlier position too."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        mark = np.zeros(len(w), bool)
        for i in range(len(w) - k + 1):
            run = tuple(w[i : i + k])
            mark[i : i + k] |= run in seen
            seen.add(run)
        out.append([x for x, m in zip(w, mark) if not m])
    return out


def test_lpf_against_its_definition():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.integers(0, 3, 40).tolist()
        common = lambda i, j: next((k for k in range(40 - max(i, j)) if s[i + k] != s[j + k]), 40 - max(i, j))
        order = sorted(range(40), key=lambda i: s[i:])
        length, source = lpf(order, [-1] + [common(a, b) for a, b in zip(order, order[1:])])
        for rank, i in enumerate(order):
            want = max([common(i, j) for j in range(i)], default=-1)
            assert max(length[rank], 0) == max(want, 0)
            if source[rank] >= 0:
                assert order[source[rank]] < i


@pytest.mark.parametrize("k,gram,vocabulary", [(8, 5, 3), (12, 9, 6), (50, 30, 40), (10, 4, 12)])
def test_against_brute_force(spark, k, gram, vocabulary):
    rng = np.random.default_rng(k)
    passages = [[f"v{x}" for x in rng.integers(0, vocabulary, rng.integers(2, 4 * k))] for _ in range(5)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.integers(0, 5)):
            p = passages[rng.integers(5)]
            a = rng.integers(0, len(p))
            t += p[a : a + rng.integers(0, len(p) + 1)] + [f"v{x}" for x in rng.integers(0, vocabulary, rng.integers(0, k))]
        texts.append(" ".join(t))
    want = brute(texts, k)
    for hot in (suffix_array.HOT_PLACES, 3):
        got = {r.doc_id: r.text.split() for r in suffix_array.repeats(simple(spark, texts).repartition(5), k, gram, hot=hot).collect()}
        assert got
        for i, t in enumerate(texts):
            assert got.get(i, t.split()) == want[i]


def test_first_copy_stays_and_offsets_fit(spark):
    passage = words(60, 1)
    texts = [words(100, 2) + " " + passage, passage + " " + words(100, 3), words(90, 4)]
    (row,) = suffix_array.repeats(simple(spark, texts)).collect()
    assert row.doc_id == 1 and row.removed_words == 60 and row.text == words(100, 3)
    assert [(r.start, r.end) for r in row.removed] == [(0, len(passage) + 1)]


def test_repeat_inside_one_document(spark):
    passage = words(55, 1)
    (row,) = suffix_array.repeats(simple(spark, [f"{passage} | {words(20, 2)} | {passage}"])).collect()
    assert row.removed_words == 55 and row.text.split()[:55] == passage.split()


def test_odd_rows(spark):
    out = suffix_array.remove_repeats(docs(spark))
    assert out.columns == docs(spark).columns
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    # 2 repeats 1 as a whole and goes, its repeated row with it; rows without a number stay
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11] and ids.count(None) == 2
    assert next(r.text for r in rows if r.doc_id == 3) is None
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_odd_columns(spark):
    d = odd_docs(spark)
    out = suffix_array.remove_repeats(d)
    assert out.columns == d.columns and out.schema == d.schema
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"]) == list(range(1, 12))
    assert next(r["text"] for r in rows if r["doc_id"] == 2) == "a second text" and all(r["a`b"] and r["removed_words"] >= 0 for r in rows)
    assert suffix_array.remove_repeats(odd_docs(spark, [])).count() == 0


def test_passages_with_other_neighbours_send_few_rows(spark):
    passage = words(60, 1)
    own = lambda side, k: " ".join(f"{side}{k}x{i}" for i in range(30))
    texts = [f"{own('a', k)} {passage} {own('b', k)}" for k in range(400)]
    d = simple(spark, texts).coalesce(2)
    plain, hot = ({r.doc_id: r.text for r in suffix_array.repeats(d, hot=h).collect()} for h in (10_000, 50))
    assert plain == hot == {k: texts[k].replace(passage + " ", "") for k in range(1, 400)}
    batches = suffix_array._anchor_batches(50, 30)
    sent = d.mapInArrow(batches, "anchor long, doc_id long, at int, n int").where("n > 0").groupBy("anchor").count()
    assert sent.agg({"count": "max"}).first()[0] <= 2


def test_touching_spans_are_joined():
    rng = np.random.default_rng(2)
    for _ in range(50):
        doc, s = rng.integers(0, 4, 30), rng.integers(0, 60, 30)
        e = s + rng.integers(1, 8, 30)
        got = list(zip(*(x.tolist() for x in suffix_array.joined(doc, s, e))))
        want = [(d, a, z) for d in sorted(set(doc.tolist())) for a, z in suffix_array._merged(s[doc == d], e[doc == d])]
        assert got == want


def test_first_places_over_batches():
    rng = np.random.default_rng(1)
    seen, least = suffix_array._Seen(), {}
    for _ in range(30):
        key, doc, at = rng.integers(0, 50, 40).astype(np.uint64), rng.integers(0, 99, 40), rng.integers(0, 5, 40)
        first = seen.first(key, doc, at)
        for k in set(key.tolist()):
            rows = [(d, a, i) for i, (x, d, a) in enumerate(zip(key.tolist(), doc.tolist(), at.tolist())) if x == k]
            d, a, _ = min(rows)
            new = k not in least or (d, a) < least[k]
            assert [i for *_, i in rows if first[i]] == ([i for x, y, i in rows if (x, y) == (d, a)][:1] if new else [])
            least[k] = min(least.get(k, (d, a)), (d, a))


def test_empty_table(spark):
    assert suffix_array.repeats(docs(spark, [])).count() == 0
    assert suffix_array.remove_repeats(docs(spark, [])).count() == 0
