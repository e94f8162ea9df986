import math

import pytest
from pyspark.sql import functions as F

from gleaner.functions import scoring, text
from gleaner.operators import index, search


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given,want",
    [("Hello World", ["hello", "world"]), ("a bc d ef", ["bc", "ef"]), ("1477er", ["1477", "er"]), ("42abc", ["42", "abc"]), ("web2py", ["web2py"]), ("Öhringen Straße", ["öhringen", "straße"]), (" \n\t", []), ("!?.,", []), ("", [])],
)
def test_tokens(spark, given, want):
    assert one(spark, text.tokenize(F.col("t")), t=given) == want


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(0, "apple apple apple banana"), (1, "banana banana cherry"), (2, "cherry orange")]
    docs = index.documents(spark.createDataFrame(rows, "doc_id long, text string"))
    return index.postings(docs).cache(), docs


@pytest.mark.parametrize(
    "query,want",
    [
        ("apple", [(0, 1.438550)]),
        ("banana", [(1, 0.646255), (0, 0.413603)]),
        ("cherry", [(2, 0.544215), (1, 0.470004)]),
        ("banana cherry", [(1, 1.116259), (2, 0.544215), (0, 0.413603)]),
        ("Apple, APPLE!", [(0, 1.438550)]),
        ("", []),
        ("!?.", []),
        ("zucchini", []),
    ],
)
def test_ranking(spark, corpus, query, want):
    got = search.search(*corpus, spark.createDataFrame([(1, query)], "query_id long, query string")).orderBy("rank").collect()
    assert [(r.doc, round(r.score, 6)) for r in got] == want


def test_batch_top_n_and_run_file(spark, corpus):
    queries = spark.createDataFrame([(1, "banana"), (2, "cherry")], "query_id long, query string")
    got = search.search(*corpus, queries, n=1).collect()
    assert {(r.query_id, r.doc) for r in got} == {(1, 1), (2, 2)}
    rows = spark.createDataFrame([(1, 1, "u", 0.12345), (1, 2, None, 0.1), (1, 3, "", 0.1), (1, 4, "v", 2.0)], "query_id long, rank int, url string, score double")
    assert [tuple(r) for r in search.run_file(rows).orderBy("rank").collect()] == [(1, 1, "u", "0.1235"), (1, 2, "v", "2.0000")]


def test_index_round_trip(spark, corpus, tmp_path):
    index.save(*corpus, str(tmp_path))
    posts, docs = index.load(spark, str(tmp_path))
    assert posts.count() == corpus[0].count() and docs.count() == 3


def test_empty_corpus(spark):
    docs = index.documents(spark.createDataFrame([], "doc_id long, text string"))
    assert index.corpus_stats(docs).first()["average"] == 0.0 and index.postings(docs).count() == 0


def test_zero_length_documents_count(spark):
    docs = index.documents(spark.createDataFrame([(0, "aa bb"), (1, None)], "doc_id long, text string"))
    assert tuple(index.corpus_stats(docs).first()) == (2, 1.0)


def test_idf_and_tfidf(spark):
    got = spark.range(1).select(scoring.tfidf_idf(F.lit(2), F.lit(2)).alias("a"), scoring.tfidf_idf(F.lit(2), F.lit(1)).alias("b")).first()
    assert got["a"] == 1.0 and math.isclose(got["b"], math.log(1.5) + 1)


def test_snippets(spark):
    terms = "zero one two target three four five".split()
    assert one(spark, text.hit_snippet(F.col("t"), F.lit(3), 2), t=terms) == "... one two target three four ..."
    many = [f"t{i}" for i in range(50)]
    assert one(spark, text.hit_snippet(F.col("t"), F.lit(None).cast("int")), t=many) == " ".join(many[:40])
    assert one(spark, text.hit_snippet(F.col("t"), F.lit(0)), t=["aa", "bb"]) == "aa bb"


def test_buckets(spark):
    got = [one(spark, text.bucket(F.lit(v).cast("double"), s), v=0) for v, s in ((0.84, 0.1), (2.7, 0.5), (0.85, 0.1), (2.75, 0.5), (0.25, 0.5), (None, 0.1))]
    assert got == ["0.80", "2.50", "0.80", "3.00", "0.00", "missing"]


def test_optional_values(spark):
    given = ["3.7", "0", "", None, "x", " 5 ", "-2.5"]
    d = spark.createDataFrame([(v,) for v in given], "v string")
    got = d.select(text.optional_int(F.col("v")).alias("i"), text.optional_float(F.col("v")).alias("f"), text.optional_int(F.col("v"), False).alias("z")).collect()
    assert [r.i for r in got] == [3, None, None, None, None, 5, -2]
    assert [r.f for r in got] == [3.7, None, None, None, None, 5.0, -2.5] and got[1].z == 0


def test_page_snippet(spark):
    f = lambda d, h, t: one(spark, text.page_snippet(F.lit(d).cast("string"), F.lit(h).cast("string"), F.lit(t)), x=0)
    assert f("About us", " us ", "body  text") == "About us body text"
    assert f(None, "Head", "body") == "Head body" and len(f("d", "h", "x " * 900)) <= 700


def test_counting_moves_nothing(spark):
    """Terms are counted in the row that holds them; so are the distinct ones."""
    rows = [(i, " ".join(f"w{(i * k) % 7}x" for k in range(i % 9))) for i in range(200)]
    docs = index.documents(spark.createDataFrame(rows, "doc_id long, text string"))
    counted = index.term_frequencies(docs)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, body in rows:
        for at, w in enumerate(body.split()):
            want.setdefault((i, w), []).append(at)
    got = {(r.doc, r.term): (r.length, r.tf, r.first, r.positions) for r in counted.collect()}
    assert got == {(i, w): (len(rows[i][1].split()), len(at), at[0], at) for (i, w), at in want.items()}
    df = {r.term: r.df for r in index.frequencies(docs).collect()}
    assert df == {w: sum(v == w for _, v in want) for w in {w for _, w in want}}


def test_counting_of_repeated_numbers_and_pieces(spark, monkeypatch):
    """Rows of one number and length are one document, as before; pieces of few tokens give the same as whole batches."""
    docs = index.documents(spark.createDataFrame([(1, "aa bb aa"), (1, "bb bb cc"), (2, "aa"), (2, "aa bb"), (3, ""), (4, None)], "doc_id long, text string"))
    got = sorted((r.doc, r.length, r.term, r.tf, r.first, r.positions) for r in index.term_frequencies(docs).collect())
    assert got == [(1, 3, "aa", 2, 0, [0, 2]), (1, 3, "bb", 3, 0, [0, 1, 1]), (1, 3, "cc", 1, 2, [2]), (2, 1, "aa", 1, 0, [0]), (2, 2, "aa", 1, 0, [0]), (2, 2, "bb", 1, 1, [1])]
    assert {r.term: r.df for r in index.frequencies(docs).collect()} == {"aa": 3, "bb": 2, "cc": 1}
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"terms": [["a", "b"], [], None, ["c"] * 5, ["d"]]})
    cut = [(p.num_rows, row.tolist(), at.tolist()) for p, row, at in index.pieces(b, 3)]
    assert cut == [(3, [0, 0], [0, 1]), (1, [0] * 5, [0, 1, 2, 3, 4]), (1, [0], [0])]


@pytest.mark.parametrize("hot", [0, 3, 1 << 17])
def test_build_is_save(spark, tmp_path, hot):
    rows = [(i, " ".join(f"w{(i * k) % 13}x" for k in range(i % 17))) for i in range(100)]
    docs = index.documents(spark.createDataFrame(rows, "doc_id long, text string"))
    index.build(docs, str(tmp_path / "b"), hot=hot)
    index.save(index.postings(docs), docs, str(tmp_path / "s"))
    built, saved = (sorted((tuple(r) for r in index.load(spark, str(tmp_path / k))[0].collect()), key=str) for k in "bs")
    assert built == saved and len(built) > 400
    plan = spark.read.parquet(str(tmp_path / "b" / "postings"))
    assert plan.columns == ["term", "doc", "tf", "score", "first", "positions"]


def test_shingle_counts_move_nothing(spark):
    rows = [(i, " ".join(f"w{(i * k) % 3}" for k in range(i % 8))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc long, body string").select("doc", text.shingle_words(F.col("body")).alias("terms"))
    counted = index.shingle_counts(docs)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    by_rows = lambda df: sorted((r.doc, r.shingle, r.n) for r in df.collect())
    want = docs.select("doc", F.explode(text.runs(F.col("terms"))).alias("shingle")).groupBy("doc", "shingle").agg(F.count("*").alias("n"))
    assert by_rows(counted) == by_rows(want)
    twice = docs.unionByName(docs)
    assert by_rows(index.shingle_counts(twice)) == by_rows(want.withColumn("n", 2 * F.col("n")))


@pytest.mark.parametrize("cells", [1 << 20, 7])
def test_best_is_top_of_matches(spark, monkeypatch, cells):
    """Scored where they lie, or from postings: the same rows, ties and copies by document, queries of one number added up."""
    monkeypatch.setattr(search, "CELLS", cells)
    words = [f"w{k}x" for k in range(12)]
    rows = [(i, " ".join(words[(i * i + k * k) % (7 + i % 6)] for k in range(i % 11))) for i in range(150)] + [(200 + i, "w1x w2x w2x") for i in range(40)]
    docs = index.documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    queries = spark.createDataFrame([(1, "w1x w2x"), (2, "w3x w1x w9x zzz"), (2, "w1x w4x"), (3, "nothing"), (4, None), (5, "w2x")], "query_id int, query string")
    by_rows = lambda df: sorted((r.query_id, r["rank"], r.doc, round(r.score, 9), r.at) for r in df.withColumnRenamed("first", "at").collect())
    for n in (1, 10, 1000):
        want = by_rows(search.top(search.matches(docs, queries), n))
        assert by_rows(search.best(docs, queries, n)) == want == by_rows(search.best_hits(index.postings(docs), queries, n)), n
    assert search.best(docs.limit(0), queries, 5).count() == 0 and search.best(docs, queries.limit(0), 5).count() == 0
    twice = docs.unionByName(docs)
    assert by_rows(search.best(twice, queries, 5)) == by_rows(search.top(search.matches(twice, queries), 5))


def test_little_moves_in_a_search(spark):
    """What a task passes on doesn't grow with its documents: the best of each query."""
    docs = index.documents(spark.createDataFrame([(i, f"aa bb w{i}x" + " aa" * (i % 50)) for i in range(2000)], "doc_id long, text string").repartition(2))
    rows = spark.createDataFrame([(q, "aa bb") for q in range(5)], "query_id int, query string")
    asked = search._few(rows)
    kept = search.Best(asked, 3)
    import numpy as np
    import pyarrow as pa

    kept.add(pa.array(range(2000)), np.repeat(np.arange(2000), 2), np.tile([0, 1], 2000), np.ones(4000), np.zeros(4000))
    assert sum(b.num_rows for b in kept.result()) == 15
    assert search.best(docs, rows, 3).count() == 15
