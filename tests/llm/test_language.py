import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import language
from tests.llm.cases import docs, odd_docs

COMMON = {
    "en": "the of and to in that is was for with on by this from which their have were been".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur pas plus par avec".split(),
}


def corpus(spark, n=240):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        lang = list(COMMON)[i % 3]
        rows.append((i, " ".join(rng.choice(COMMON[lang], rng.integers(5, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_calibration(spark):
    all_rows = corpus(spark)
    train = all_rows.where("doc_id % 2 = 0")
    model = language.train(train, sample=60)
    test = all_rows.where("doc_id % 2 = 1").collect()
    p = model.probabilities([f" {r.text} " for r in test])
    right = np.array([model.languages[i] for i in p.argmax(axis=1)]) == np.array([r.lang for r in test])
    assert right.mean() > 0.97
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.1


def counted(text, buckets):
    """Counts of a text's n-grams, one by one."""
    out, chars = Counter(), [ord(c) for c in f" {' '.join(text.lower().split())} "]
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            h = 0x85EBCA6B
            for c in chars[i : i + n]:
                h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            out[h % buckets] += 1
    return out


def test_document_frequencies_against_brute_force(spark):
    df, n = language.document_frequencies(corpus(spark), 1 << 10)
    want = Counter(f for r in corpus(spark).collect() for f in counted(r.text, 1 << 10))
    assert n == 240 and df.tolist() == [want[f] for f in range(1 << 10)]


def test_query_against_brute_force(spark):
    d = corpus(spark).select("doc_id", "lang", F.concat_ws(" ", "text", F.when(F.col("doc_id") % 5 == 0, "É x1 漢"), F.when(F.col("doc_id") == 7, F.repeat(F.lit("und der "), 30_000))).alias("text"))
    rows = d.collect()
    model = language.train(d, sample=50)
    got = {r.doc_id: r for r in language.identify(d, sample=50).collect()}
    df = Counter(f for r in rows for f in counted(r.text, language.BUCKETS))
    for r in rows:
        c = counted(r.text, language.BUCKETS)
        x = {f: (1 + math.log(k)) * (math.log((1 + len(rows)) / (1 + df[f])) + 1) for f, k in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / norm * model.weights[f, k] for f, v in x.items()) + model.bias[k]) / model.temperature for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        assert got[r.doc_id].predicted == model.languages[int(np.argmax(z))] and abs(got[r.doc_id].confidence - max(e) / sum(e)) < 1e-4


def test_ftrl_against_its_definition():
    rng = np.random.default_rng(3)
    x, y = rng.random((30, 4)), rng.integers(0, 3, 30)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.05, 0.01
    z, n = np.zeros((5, 3)), np.zeros((5, 3))
    solve = lambda f, k: 0.0 if abs(z[f, k]) <= (0 if f == 4 else l1) else -(z[f, k] - math.copysign(0 if f == 4 else l1, z[f, k])) / ((beta + math.sqrt(n[f, k])) / alpha + l2)
    for i in np.random.default_rng(7).permutation(30):
        v = [*x[i], 1.0]
        w = [[solve(f, k) for k in range(3)] for f in range(5)]
        s = [math.exp(sum(v[f] * w[f][k] for f in range(5))) for k in range(3)]
        for f in range(5):
            for k in range(3):
                g = (s[k] / sum(s) - (y[i] == k)) * v[f]
                z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / alpha * w[f][k]
                n[f, k] += g * g
    rows = [(np.arange(4), r) for r in x]
    weights, bias = language.train_ftrl(rows, y, 3, 4, 1, alpha, beta, l1, l2)
    assert np.allclose(np.vstack([weights, bias]), [[solve(f, k) for k in range(3)] for f in range(5)], atol=1e-5)


def test_sample_is_bounded(spark):
    one = spark.range(20_000).selectExpr("1L as doc_id", "repeat('the words of it ', 20) || id as text", "'en' as lang")
    many = spark.range(20_000).selectExpr("id + 2 as doc_id", "repeat('the words of it ', 20) || id as text", "'en' as lang")
    assert language.labelled_sample(one, "lang", 600, 11).num_rows == 1
    assert language.labelled_sample(one.union(many), "lang", 600, 11).num_rows in (599, 600)
    long = spark.createDataFrame([(1, "".join(map(chr, range(1000, 60_000))) * 20, "en")], "doc_id long, text string, lang string")
    assert language.labelled_sample(long, "lang", 600, 11).nbytes < 13 * language.BUCKETS  # the text, and words out of it


def test_elastic_net_makes_weights_sparse():
    rng = np.random.default_rng(1)
    x = rng.random((200, 50)).astype(np.float32)
    y = (x[:, 0] > 0.5).astype(int)
    rows = [(np.flatnonzero(r), r[r != 0]) for r in x]
    dense, _ = language.train_ftrl(rows, y, 2, 50, l1=0.0)
    sparse, _ = language.train_ftrl(rows, y, 2, 50, l1=1.0)
    assert (sparse == 0).sum() > (dense == 0).sum()
    assert abs(sparse[0]).max() > abs(sparse[1:]).mean() * 3


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(3000, 3))
    p = language._softmax(z)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert 3.0 < language.fit_temperature(z * 4, y) < 5.5


def test_odd_rows(spark):
    got = language.identify(docs(spark)).collect()
    assert len(got) == 14
    by = {r.doc_id: r for r in got if r.doc_id}
    assert all(by[i].rejected and by[i].predicted is None for i in (3, 4, 5, 6, 7))
    kept = language.keep_identified(docs(spark))
    assert kept.columns == docs(spark).columns and {3, 4, 5, 6, 7}.isdisjoint({r.doc_id for r in kept.collect()})


def test_odd_columns(spark):
    d = odd_docs(spark)
    kept = language.keep_identified(d)
    assert kept.columns == d.columns and kept.schema == d.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert {3, 4, 5, 6, 7}.isdisjoint(ids) and language.identify(d).count() == 16
    assert language.keep_identified(odd_docs(spark, [])).count() == 0


def test_without_rows_or_labels(spark):
    assert language.identify(docs(spark, [])).count() == 0
    unlabelled = docs(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert not any(r.rejected for r in language.identify(unlabelled).collect())
    assert language.keep_identified(unlabelled).count() == 14
