from collections import defaultdict

from gleaner.llm import mixing
from tests.llm.cases import docs, odd_docs, words


def corpus(spark):
    rows = [(i, words(1 + i * 7 % 40, i), ["a", "b", "c", None][min(i % 10, 3)]) for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_exact_budgets_and_epochs(spark):
    rows, d = corpus(spark)
    got = mixing.selection(d, weights={"a": 3, "b": 1}, default_weight=2, budget=20_000, slice_bits=3).collect()
    taken, tokens = defaultdict(int), {i: len(t.split()) for i, t, _ in rows}
    for r in got:
        taken[r.source] += r.taken
        assert 0 < r.taken <= r.tokens == tokens[r.doc_id]
    assert taken == {"a": 7500, "b": 2500, "c": 5000, None: 5000}
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.source == source]
        size = sum(tokens[i] for i, _, s in rows if s == source)
        full = taken[source] // size
        for i in (i for i, _, s in rows if s == source):
            epochs = sorted(r.epoch for r in own if r.doc_id == i)
            assert epochs == list(range(len(epochs))) and len(epochs) in (full, full + 1)
        assert sum(r.taken < r.tokens for r in own) <= 1


def test_order_is_by_key(spark):
    rows, d = corpus(spark)
    key = {r.doc_id: r.k for r in d.select("doc_id", mixing.random_key(17).alias("k")).collect()}
    got = mixing.selection(d, budget=400, slice_bits=2).collect()
    for source in ("a", None):
        chosen = {r.doc_id for r in got if r.source == source}
        rest = {i for i, _, s in rows if s == source} - chosen
        assert chosen and max(key[i] for i in chosen) < min(key[i] for i in rest)


def test_parts_are_cut(spark):
    _, d = corpus(spark)
    out = mixing.mix(d, budget=777).collect()
    assert sum(len(r.text.split()) for r in out) == 776  # four sources of 194 each
    assert all(len(r.text.split()) == r.taken for r in out)


def test_odd_rows(spark):
    got = mixing.selection(docs(spark), budget=1_000).collect()
    assert {r.doc_id for r in got} <= {1, 2, 6, 7, 8, 9, 10, 11}
    out = mixing.mix(docs(spark), budget=1_000)
    assert out.columns == docs(spark).columns + ["mix_epoch", "taken"] and out.count() == len(got)
    assert {r.epoch for r in out.collect()} == {"x"} and {r.mix_epoch for r in out.collect()} >= {0, 1}


def test_odd_columns(spark):
    d = odd_docs(spark)
    got, out = mixing.selection(d, budget=1_000).collect(), mixing.mix(d, budget=1_000)
    assert out.columns == d.columns + ["mix_epoch", "mix_taken"]
    rows = out.collect()
    key = lambda k: str(k)
    assert sorted(((r["doc_id"], r["mix_epoch"], r["mix_taken"]) for r in rows), key=key) == sorted(((r.doc_id, r.epoch, r.taken) for r in got), key=key)
    assert all(r["_taken"] >= 0 and r["epoch"] == 5 and r["taken"] == 6 and r["a`b"] for r in rows)
    assert mixing.mix(odd_docs(spark, [])).count() == 0


def test_empty_table_and_no_budget(spark):
    assert mixing.selection(docs(spark, [])).count() == 0
    assert mixing.selection(docs(spark), budget=0).count() == 0
