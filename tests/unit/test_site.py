import math

import pytest
from pyspark.sql import functions as F

from gleaner.config import LinkSkip
from gleaner.functions import scoring, text, urls
from gleaner.operators import dedup, html, links, pages, report


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_canonical_urls(spark):
    base = "https://Host.org/a/b?q#f"
    given = ["c", "/d/", "../x?y=1#z", "https://OTHER.org/p;v=1/q;w", "", "/", "mailto:a@b", "javascript:x", "ftp://h/x", "http://[bad", "//h2/z/", None]
    got = [r[0] for r in values(spark, [(g, base) for g in given], "r string, b string", urls.canonical_url("r", "b"))]
    assert got == ["https://host.org/a/c", "https://host.org/d", "https://host.org/x", "https://other.org/p;v=1/q", "https://host.org/a/b", "https://host.org/", None, None, None, None, "https://h2/z", "https://host.org/a/b"]
    same = ["https://h", "https://h/", "HTTP://h/A/?x", "https://h/a;b", "x://h/a", "nothing"]
    assert [r[0] for r in values(spark, [(s,) for s in same], "u string", urls.canonical_absolute(F.col("u")))] == ["https://h", "https://h/", "http://h/A", "https://h/a", None, None]


def test_normalized_url_and_slug(spark):
    given = ["http://H.org:80/a/?b=2&a=1#x", "https://h.org:443", "https://h.org/p?x=%20y", None]
    assert [r[0] for r in values(spark, [(g,) for g in given], "u string", urls.normalized_url("u"))] == ["http://h.org/a?a=1&b=2", "https://h.org/", "https://h.org/p?x=+y", None]
    slugs = {"https://h/wiki/Öhr": "wiki-öhr", "https://h/": "index", "https://h/search?q=test&page=2": "search-q-test-page-2", "https://h/---": "page", "https://h/" + "a" * 200: "a" * 90}
    assert [r[0] for r in values(spark, [(s,) for s in slugs], "u string", urls.url_slug(F.col("u")))] == list(slugs.values())


def test_link_skip(spark):
    given = ["https://h/files/map.pdf", "https://twitter.com/x", "https://www.m.youtube.com/", "https://h/de/stadt", "https://h/de-AT/x", "https://h/en/stadt", "https://h/en/tag/x", "https://h/a%2Blogin", "https://h/vintage"]
    want = [True, True, True, True, True, False, True, True, False]
    assert [r[0] for r in values(spark, [(g,) for g in given], "u string", urls.is_skippable(F.col("u")))] == want
    own = LinkSkip(suffixes=(".x",), path_words=("zzz",), languages=("qq",), hosts=("b.org",), host_suffixes=())
    assert [r[0] for r in values(spark, [("https://h/de/map.pdf",), ("https://b.org/",)], "u string", urls.is_skippable(F.col("u"), own))] == [False, True]


def test_page_gate(spark):
    rows = [(s, en, t) for s, en, t in [(0.8, "en", "cyber valley"), (0.6, "en", "Stocherkahn"), (0.59, "en", "lustnau"), (0.9, "en", "elsewhere"), (0.9, "de", "lustnau"), (0.3, None, "x")]]
    d = spark.createDataFrame(rows, "s double, language string, text string").withColumns({"title": F.lit(None).cast("string"), "url": F.lit("")})
    got = pages.judged(d, F.col("s")).collect()
    assert [r.decision for r in got] == ["index_strong", "index_cautious"] + ["reject_follow"] * 4
    assert [r.exclusion_reason for r in got] == [None, None, "low_pageverdict_score", "off_topic", "non_english", "non_english"]
    scores = spark.createDataFrame([(x,) for x in (1.0, 0.91, 0.9, 0.8, 0.7, 0.6, 0.59, 0.3, 0.0)], "s double").select(scoring.relevance(F.col("s")).alias("r")).collect()
    assert [round(r.r, 4) for r in scores] == [10, 8.2, 8.0, 6.0, 4.0, 3.0, 1.9667, 1.0, 0]


def test_topic_spellings(spark):
    name = "T\u00fcbingen"
    rows = [(v,) for v in (name, name.replace("\u00fc", "ue"), name.replace("\u00fc", "u"), "T u bingen", "HÖLDERLIN")]
    from gleaner.config import Topic

    assert [r[0] for r in values(spark, rows, "t string", text.has_topic(F.col("t"), Topic().pattern))] == [True, True, True, False, True]


def budget(spark, targets):
    rows = [("p", i, t, "h", float(-i)) for i, t in enumerate(targets)]
    d = spark.createDataFrame(rows, "parent_url string, position int, target_url string, target_host string, frontier_score double").withColumn("rejection_reason", F.lit(None).cast("string"))
    return [(r.rejection_reason, r.should_enqueue) for r in links.decided(links.budgeted(d)).orderBy("position").collect()]


def test_page_budgets(spark):
    assert budget(spark, [f"https://h/en/news/{i}" for i in range(5)]) == [(None, True)] * 3 + [("page_family_budget", True)] * 2
    assert budget(spark, [f"https://h/s{i}/x" for i in range(12)]) == [(None, True)] * 8 + [("page_host_budget", True)] * 4


def test_frontier_priority(spark):
    got = spark.range(1).select(scoring.push_priority(F.lit(10.0), F.lit(2), F.lit(3), F.lit(6)).alias("p")).first().p
    assert math.isclose(got, 10 - 1.4 - 0.9 * math.log(10))


def test_simhash_goldens(spark):
    rows = [("",), (None,), ("t\u0075ebingen",), ("the old town",)]
    assert [r[0] for r in values(spark, rows, "t string", dedup.fingerprint("t"))] == [0, 0, 4250555596789816446, -8219622596293841073]


def test_greedy_chain(spark):
    prints = spark.createDataFrame([(1, 0), (2, 0b111), (3, 0b111111), (4, 0), (5, 0xFF << 50)], "id long, fp long")
    assert {r.id: r.kept for r in dedup.greedy_keep(prints).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    pairs = {(r.a, r.b): r.distance for r in dedup.near_pairs(prints).collect()}
    assert pairs == {(1, 2): 3, (2, 3): 3, (1, 4): 0}  # 4 is a member of 1's class


def test_near_pairs_against_all_pairs(spark):
    import random

    r = random.Random(4)
    fps = [r.getrandbits(64) - (1 << 63) for _ in range(40)]
    for k in range(400):
        f = r.choice(fps[:40])
        for bit in r.sample(range(64), k % 5):
            f ^= 1 << bit if bit < 63 else -(1 << 63)
        fps.append(f)
    fps += fps[:7]
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(f, i)
    want = {(least[f], i): 0 for i, f in enumerate(fps) if least[f] != i}
    want |= {(i, j): far(f, g) for f, i in least.items() for g, j in least.items() if i < j and far(f, g) <= 3}
    got = dedup.near_pairs(spark.createDataFrame(list(enumerate(fps)), "id long, fp long")).collect()
    assert len(got) == len(want) > 400 and {(x.a, x.b): x.distance for x in got} == want


def test_greedy_against_one_by_one(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(6)]
    prints = []
    for i in range(250):
        f = r.choice(base)
        for _ in range(r.randrange(7)):
            f ^= 1 << r.randrange(0, 12)
        prints.append((i, f))
    kept = []
    for i, f in prints:
        if all((f ^ g).bit_count() > 3 for _, g in kept):
            kept.append((i, f))
    got = {x.id for x in dedup.greedy_keep(spark.createDataFrame(prints, "id long, fp long")).where("kept").collect()}
    assert got == {i for i, _ in kept}


@pytest.mark.parametrize(
    "markup,want",
    [
        ("<title>t</title><p>one</p><div>two</div><li>three", "one three"),
        ("<ul><li><p>deep</p> shallow</ul>", "deep shallow"),
        ("<blockquote><p>quoted</p></blockquote>", "quoted"),
        ("<p>a &amp; b&nbsp;c", "a & b c"),
        ("<table><tr><th>h<td>d</table><figcaption>f</figcaption>", "h d f"),
        ("<p>x<p>x<p>y", "x y"),
        ("<p>in<b>li</b>ne<br>break</p>", "inline break"),
        ("<nav><p>menu</p></nav><p>text</p><script>var p='<p>no</p>'</script>", "text"),
        ("<div class='sidebar'><p>side</p></div><p hidden>no</p><p>yes</p>", "yes"),
        ("<body><header><p>top</p></header><article><header><p>in</p></header></article>", "in"),
        ("plain words only", "plain words only"),
        ("", ""),
    ],
)
def test_main_text(markup, want):
    assert html.plain(markup) == want


def test_content_root_and_heading():
    long = "word " * 40
    page = f"<h1>Head</h1><div><p>{'side ' * 30}</p></div><main><p>{long}</p></main>"
    assert html.plain(page) == f"Head {long.strip()}"
    bad = f"<div class='related'><p>{long}</p></div><div class='story'><p>{'tale ' * 40}</p></div>"
    assert html.plain(bad) == ("tale " * 40).strip()


def test_page_parts(spark):
    page = '<html lang="de-DE"><head><title> A  b </title><meta name="description" content=" "><meta property="og:description" content="og"></head><h1>H</h1><a href="/x">A <b>b</b></a><a href="">no</a><a href="/x">A b</a><style>p{}</style>'
    r = html.parse_pages(spark.createDataFrame([("u", page), ("n", None)], "url string, html string")).orderBy(F.desc("url")).collect()
    assert (r[0].title, r[0].language, r[0].description, r[0].h1, r[0].text) == ("A b", "de", "og", "H", "H A b no A b")
    assert [(x.href, x.anchor) for x in r[0].links] == [("/x", "A b"), ("/x", "A b")] and r[1].text == "" and r[1].language == "unknown"


def test_report(spark):
    saved = spark.createDataFrame([(i, f"h{i % 3}", i % 5 if i else None) for i in range(12)], "id long, host string, crawl_depth int")
    rejected = spark.createDataFrame([("duplicate_text",), ("off_topic",), ("off_topic",)], "exclusion_reason string")
    got = report.format_report(saved, rejected)
    assert got["harvest_rate"] == 0.8 and got["duplicate_rate"] == 0.0667 and got["host_entropy_bits"] == 1.585 and got["host_evenness"] == 1.0
    assert got["diversity_at_50"] == 3 and got["rejection_reasons"] == {"off_topic": 2, "duplicate_text": 1} and got["top_hosts"] == [("h0", 4), ("h1", 4), ("h2", 4)]
    none = report.format_report(saved.limit(0), rejected.limit(0))
    assert none["harvest_rate"] == 0.0 and none["host_entropy_bits"] == 0.0 and none["deep_share_ge3"] == 0.0


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "t1", "", "x"), ("b", 2, "t2", "n", "y")], "url string, v int, created string, notes string, extra string")
    new = spark.createDataFrame([("a", 9, "t9", "new", ), ("c", 3, "t3", "m")], "url string, v int, created string, notes string")
    twice = pages.upsert(pages.upsert(old, new, ["url"], keep=["created"], fill=["notes"]), new, ["url"], keep=["created"], fill=["notes"])
    assert sorted(map(tuple, twice.collect())) == [("a", 9, "t1", "new", "x"), ("b", 2, "t2", "n", "y"), ("c", 3, "t3", "m", None)]


def test_the_query_trains_with_the_page_recipe(spark, tmp_path, monkeypatch):
    from gleaner.operators import ml
    from gleaner.plans import site

    docs = [(i, f"text {i}", f"src{i % 10}") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i // 10 % 2) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    used = []
    monkeypatch.setattr(ml, "train", lambda rows, recipe=ml.PAGE: used.append(recipe))
    monkeypatch.setattr(ml, "predict", lambda rows, model: rows.select("id"))
    site.train_page_classifier(spark, str(tmp_path))
    assert used == [ml.PAGE]


def test_texts_are_hashed_once(spark):
    """Pairs and members of one table of fingerprints: each text is read for them once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def slow(i):
        seen.add(1)
        return i % 3

    dedup.near_pairs(spark.range(30).select("id", slow("id").alias("fp"))).collect()
    assert seen.value == 30


def test_fingerprint_holds_a_piece_of_a_long_text(spark):
    """Shingles are hashed in pieces, and the pieces add up to the whole."""
    import tracemalloc

    body = " ".join(f"w{k % 977}" for k in range(150_000))
    tracemalloc.start()
    got = dedup._print_of(body)
    words = body.split()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15_000_000  # 30 MB with all shingles at once
    bits = [0] * 64
    for f in map(" ".join, zip(words, words[1:], words[2:])):
        v = int.from_bytes(dedup._blake(f.encode()), "big")
        for k in range(64):
            bits[k] += 2 * (v >> k & 1) - 1
    assert got & (1 << 64) - 1 == sum(1 << k for k in range(64) if bits[k] > 0)
