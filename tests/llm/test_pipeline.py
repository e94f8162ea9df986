import os
from functools import partial
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import queries, simhash
from tests.llm.cases import odd_docs, simple, words
from tests.llm.test_simhash import bridged


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    english = "the of and to in is that for with on by this from are be at or as it an which have has not but they his you her she".split()
    import random

    r = random.Random(0)
    prose = lambda seed, n=150: " ".join(w if random.Random(f"{seed}{i}").random() < 0.5 else r.choice(english) for i, w in enumerate(words(n, seed).split()))
    item, passage = words(40, 900), words(60, 901)
    base = prose(1)
    rows = [(i, prose(100 + i), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, base, "en", "s0"), (101, base, "en", "s1"), (102, base.replace("the", "de", 2), "en", "s1")]
    rows += [(110, f"{prose(2)} {passage} {prose(3)}", "en", "s0"), (111, f"{prose(4)} {passage} {prose(5)}", "en", "s2")]
    rows += [(120, f"{prose(6)} {item} {prose(7)}", "en", "s0"), (130, "", "en", "s0"), (131, None, None, None), (132, "### 123", "en", "s1")]
    d = spark.createDataFrame([(*x, None if x[1] is None else len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, passage, item


def test_stages_one_by_one(spark, corpus):
    folder, passage, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert docs.columns[: len(columns)] == columns and (k == 4 or docs.columns == columns)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert {130, 131, 132}.isdisjoint(seen["language_id"]) and set(range(40)) <= set(seen["language_id"])
    assert 100 in seen["simhash_near_dedup"] and {101, 102}.isdisjoint(seen["simhash_near_dedup"])
    cut = seen["suffix_array_dedup"]
    assert passage in cut[110] and passage not in cut[111]
    assert 120 not in seen["benchmark_decontamination"] and set(range(40)) <= set(seen["benchmark_decontamination"])
    assert all(item not in t for t in seen["source_mixing"].values())


def test_run_is_the_stages_in_turn(spark, corpus):
    folder = corpus[0]
    got = corpus_pipeline.run(spark, folder)
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(spark.read.parquet(f"{folder}/stage4").collect(), key=key)


def test_run_keeps_its_last_stage_only(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    (own,) = {os.path.dirname(os.path.dirname(urlsplit(f).path)) for f in got.inputFiles()}
    assert os.listdir(own) == ["4-source_mixing"]


def test_odd_rows_and_columns(spark, corpus, tmp_path):
    folder = str(tmp_path)
    d = odd_docs(spark).withColumn("lang", F.when(F.col("lang") == "de", "fr").otherwise(F.col("lang")))
    base = spark.read.parquet(f"{corpus[0]}/documents.parquet").where("doc_id < 100").withColumn("doc_id", F.col("doc_id") + 1000)
    d.unionByName(base, allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*d.columns, "mix_epoch", "mix_taken"]
    ids = {r["doc_id"] for r in out.collect()}
    assert None not in ids and {3, 4, 5, 6, 7}.isdisjoint(ids) and ids & set(range(1000, 1040))


def test_empty_table(spark, corpus, tmp_path):
    odd_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=str)
    assert sorted((tuple(r) for r in queries.QUERIES[name](spark, sf).select(*columns).collect()), key=str) == want


def test_near_dedup_loses_no_link_in_a_hot_node(spark, monkeypatch):
    fps = bridged(np.random.default_rng(13))
    signed = spark.createDataFrame([(k, *map(int, f.view(np.int64))) for k, f in enumerate(fps)], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    monkeypatch.setattr(simhash, "signatures", lambda unique: signed)
    monkeypatch.setattr(simhash, "plan", lambda *a: (0, 1))  # one node for all
    monkeypatch.setattr(simhash, "keep_one", partial(simhash.keep_one, hot=200, every=1))
    kept = corpus_pipeline.near_dedup(spark, simple(spark, [words(3, k) for k in range(len(fps))]), "")
    assert kept.count() == 2
