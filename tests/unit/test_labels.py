import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from gleaner.operators import labeling, metrics, ml
from gleaner.sources import readers, sinks
from gleaner.streaming import ingest

LINK = "id long, parent_url string, target_url string, target_host string, anchor string, raw_score double, linkverdict_score double, target_pageverdict_score double, should_enqueue boolean, selected boolean, rejection_reason string, rating int, source string"


def link(i, host, **more):
    row = dict(parent_url=f"https://parent.example/{host}/{i}", target_url=f"https://{host}/page-{i}", target_host=host, anchor=f"link {i}", raw_score=9.0, linkverdict_score=0.5, target_pageverdict_score=0.52, should_enqueue=True, selected=True, rejection_reason=None, rating=None, source="crawler_linkverdict")
    return (i, *(row | more).values())


def test_queue_takes_hosts_in_turn(spark):
    rows = [link(i, "a.org") for i in range(10)] + [link(10 + k, f"b{k}.org") for k in range(3)]
    got = labeling.link_queue(spark.createDataFrame(rows, LINK), 4).collect()
    assert len({r.target_host for r in got}) == 4


def test_noise_comes_last(spark):
    noise = link(1, "a.org", anchor="Jump to content", rejection_reason="seen_url")
    got = labeling.link_queue(spark.createDataFrame([noise, link(2, "a.org"), link(3, "c.org", rating=4), link(4, "d.org", source="other")], LINK), 10).orderBy("place").collect()
    assert [r.id for r in got] == [2, 1]


def test_imports(spark):
    rows = spark.createDataFrame([("q", "0", " T  x ", "http://h.org:80/a", "s", "0.5", None, None, None), (None, None, "t", " ", "", None, None, None, None)], "query string, rank string, title string, url string, snippet string, pageverdict_score string, source string, pageverdict_label string, pageverdict_decision string")
    (r,) = labeling.page_candidates(rows, "default").collect()
    assert (r.query, r.rank, r.title, r.normalized_url, r.pageverdict_score, r.source) == ("q", 1, "T x", "http://h.org/a", 0.5, "crawler_pageverdict")
    more = spark.createDataFrame([("https://www.p.org/x", None, "https://T.org/y", "a  b", "0", "0.2", "yes", "0"), ("p", "", None, "", "", "", "", "")], "parent_url string, target_url string, url string, anchor string, raw_score string, linkverdict_score string, should_enqueue string, selected string")
    (l,) = labeling.link_candidates(more).collect()
    assert (l.parent_host, l.target_url, l.target_host, l.anchor, l.raw_score, l.should_enqueue, l.selected) == ("p.org", "https://T.org/y", "t.org", "a b", None, True, False)


def predicted(spark):
    return spark.createDataFrame([("negative", 0.2), ("positive", 0.6), ("positive", 0.9)], "label string, probability double")


def test_thresholds(spark):
    (m,) = metrics.threshold_metrics(predicted(spark), (0.5,)).collect()
    assert (m.support, m.predicted, m.precision, m.recall) == (2, 2, 1.0, 1.0)
    rows = spark.createDataFrame([(0.8, 0.85, 0.6, 0.7), (0.5, 0.7, 0.9, 0.79), (0.7, 0.82, 0.6, 0.69)], "threshold double, precision double, recall double, f1 double")
    assert metrics.select_threshold(rows).first().threshold == 0.8
    low = rows.withColumn("precision", F.col("precision") / 2)
    assert metrics.select_threshold(low).first().threshold == 0.8


def test_ranking_metrics_with_ties(spark):
    rows = spark.createDataFrame([("positive", 0.9), ("negative", 0.9), ("positive", 0.5), ("negative", 0.1)], "label string, probability double")
    got = metrics.ranking_metrics(rows).first()
    assert got.roc_auc == 0.625 and abs(got.average_precision - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12
    sides = {r.label: r for r in metrics.by_label(predicted(spark)).collect()}
    assert sides["negative"].recall == 1.0 and sides["positive"].support == 2


def test_classifier(spark, tmp_path):
    rows = [(i, f"{'good' if i % 2 else 'bad'} page number {i % 7}", "positive" if i % 2 else "negative", f"h{i % 12}") for i in range(120)]
    d = spark.createDataFrame(rows, "id long, text string, label string, host string")
    train, test = ml.group_split(d)
    assert not {r.host for r in train.collect()} & {r.host for r in test.collect()}
    model = ml.train(train, ml.Recipe(words=(1, 1), chars=(3, 3), min_examples=10, iterations=50))
    model.save(str(tmp_path / "m.json"))
    again = ml.Classifier.load(str(tmp_path / "m.json"))
    got = ml.predict(test, again).join(test.select("id", F.col("label").alias("truth")), "id").collect()
    assert got and all(r.label == r.truth for r in got)
    with pytest.raises(ValueError):
        ml.train(train.limit(5))


def test_character_grams_stay_in_words():
    _, c = ml.grams("ab c", ml.Recipe(words=(1, 1), chars=(3, 4)))
    assert set(c) == {" ab", "ab ", " ab ", " c "} and c[" c "] == 1


def test_batch_file(spark, tmp_path):
    path = tmp_path / "q.tsv"
    path.write_text('1\t first \n\n2\t"two\twords"\n1\tlast\n')
    assert [tuple(r) for r in readers.query_batch(spark, str(path)).collect()] == [(1, "last"), (2, "two\twords")]
    for bad in ("x\tq\n", "1\ta\tb\n", "1\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            readers.query_batch(spark, str(path))


def test_seeds(spark, tmp_path):
    path = tmp_path / "s.toml"
    path.write_text("".join(f"[[sites]]\nround_robin_weight = {w}\nurl = 'https://{h}.org/'\n" for h, w in (("a", 1), ("b", 3))))
    assert [r.round_robin_weight for r in readers.seeds(spark, str(path)).orderBy("url").collect()] == [1, 3]
    path.write_text('[[sites]]\nurl = "nothing"\n')
    assert readers.seeds(spark, str(path)).count() == 0 and readers.seeds(spark, str(tmp_path / "none")).count() == 0


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "p.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE pages (relevance REAL, path TEXT, content_type TEXT, url TEXT, id INTEGER PRIMARY KEY)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?, ?, ?)", [(i / 2, f"f{i}.html", ["text/html; x", None, "image/png", "TEXT/HTML"][i % 4], f"u{i}", i) for i in range(1, 41)])
    con.commit()
    con.close()
    t = readers.sqlite_table(spark, path, "pages", 3)
    assert t.count() == 40 and t.agg(F.sum("relevance")).first()[0] == 410.0
    assert readers.saved_pages(t).count() == 30 and readers.page_by_path(t, "f7.html").first().url == "u7"
    with pytest.raises(ValueError):
        readers.check_columns(t, ["title"])


def test_json_lines_and_swap(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.json_lines(spark, "x.json")
    d = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    sinks.json_lines(d, str(tmp_path / "o.jsonl"))
    assert sorted(json.loads(x)["a"] for f in (tmp_path / "o.jsonl").glob("*.json") for x in f.read_text().splitlines() if "b" in json.loads(x)) == [1, 2]
    p = str(tmp_path / "t")
    sinks.swap(d, p)
    sinks.swap(spark.read.parquet(p).where("a = 2"), p)
    assert spark.read.parquet(p).count() == 1


def test_ingest_keeps_the_latest(spark, tmp_path):
    spark.createDataFrame([("u", "old words", "1"), ("u", "new words here", "2"), ("v", "x", "1")], "url string, text string, fetched_at string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, text string, fetched_at string").json(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "docs"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.url: r.length for r in spark.read.parquet(str(tmp_path / "docs")).collect()} == {"u": 3, "v": 0}


def test_near_pairs_read_the_whole_text(spark, tmp_path):
    from gleaner.plans import labels

    body = [" ".join(f"w{(7 * k + k * k * s) % 997}" for k in range(3000)) for s in (1, 2, 3)]
    opening = "the same opening of every page on this site, word for word "
    texts = ["first " + body[0], "second " + body[0], opening + body[1], opening + body[2]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.a, r.b) for r in labels.near_duplicate_pairs(spark, str(tmp_path)).collect()} == {(0, 1)}
    assert {r.id for r in labels.greedy_dedup(spark, str(tmp_path)).where("kept").collect()} == {0, 2, 3}


def test_export_ranks_every_link(spark):
    rows = [link(i, f"h{i % 7}.example", linkverdict_score=None if i % 9 == 0 else (i * 37 % 101) / 100) for i in range(1300)]
    got = labeling.ranked_export(spark.createDataFrame(rows, LINK).repartition(5)).select("id", "rank").collect()
    order = sorted(rows, key=lambda r: (abs(r[6] - 0.5) if r[6] is not None else 0.0, r[2], r[1], r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [r[0] for r in order]
    assert sorted(r.rank for r in got) == list(range(1, 1301))


def test_group_split_counts_labels_without_copies(spark):
    """The hundred splits are tried over the rows as they are; a distinct count each would copy every row 200 times."""
    rows = spark.createDataFrame([(i, f"t{i}", f"h{i % 20}", "positive" if i % 3 else "negative") for i in range(200)], "id long, text string, host string, label string")
    plans = []
    agg = type(rows).agg

    def spy(self, *columns):
        made = agg(self, *columns)
        plans.append(made._jdf.queryExecution().optimizedPlan().toString())
        return made

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(rows), "agg", spy)
        train, test = ml.group_split(rows)
    assert plans and "Expand" not in plans[0]
    hosts = [{r.host for r in d.select("host").distinct().collect()} for d in (train, test)]
    assert not hosts[0] & hosts[1] and train.count() + test.count() == 200
