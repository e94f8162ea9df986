import random

from gleaner.llm import url_filter

ENTRIES = "pattern string, verdict string, effective_at long"


def test_against_brute_force(spark):
    r = random.Random(1)
    hosts = [f"{a}{b}.{c}" for a in ("", "m.", "x.y.") for b in ("one", "two") for c in ("com", "org")]
    entries = [(p, r.choice(["block", "allow", None]), r.randrange(100)) for p in hosts + [h + "/en" for h in hosts] + ["com", "one.com/en/a"] for _ in range(4)]
    captures = [(i, f"http://{r.choice(hosts)}{r.choice(['', '/', '/en', '/en/a?q=1', '/EN/a/b#x', '/de'])}", r.randrange(110)) for i in range(400)]

    def best(url, t):
        rest = url.split("://")[1].split("?")[0].split("#")[0].lower()
        host, *segments = rest.split("/")
        labels = host.split(".")
        keys = [".".join(labels[i:]) for i in range(len(labels))]
        segments = [s for s in segments if s]
        keys += [host + "/" + "/".join(segments[: i + 1]) for i in range(len(segments))]
        active = []
        for k in keys:
            past = [(e, "" if v is None else v) for p, v, e in entries if p == k and e <= t]
            if past and max(past)[1]:
                active.append((len(k), k, max(past)[1]))
        return max(active)[1:] if active else (None, None)

    for limit in (url_filter.BROADCAST_IDS, 0):
        got = url_filter.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at long"), spark.createDataFrame(entries, ENTRIES), limit).collect()
        assert len(got) == 400
        for x in got:
            assert (x.pattern, x.verdict) == best(x.url, x.fetched_at) and x.blocked == (x.verdict == "block")


def test_odd_rows(spark):
    entries = [("a.com", "block", 5), ("a.com", "allow", 5), ("A.com", None, 9), (None, "block", 0), ("", "block", 0), ("b.com", "block", None)]
    rows = [(1, "http://a.com", 4, "x"), (2, "http://A.com.:80/", 5, "x"), (3, "https://u:p@w.a.com/x", 8, "x"), (4, "http://a.com", 9, "x"), (5, None, 6, "x"), (6, "nonsense", 6, None), (7, "http://a.com", None, "x"), (None, "http://a.com", 6, "x"), (2, "http://A.com.:80/", 5, "x"), (8, "http://b.com", 6, "x"), (9, "http://nota.com", 6, "x"), (10, "http://a.com/" + "p/" * 2000, 6, "x")]
    captures = spark.createDataFrame([(*r, {"k": "v"}, "l", 1) for r in rows], "page_id long, url string, fetched_at long, pattern string, `a.b` map<string,string>, listed string, h1 long")
    for limit in (url_filter.BROADCAST_IDS, 0):
        out = url_filter.evaluate(captures, spark.createDataFrame(entries, ENTRIES), limit).collect()
        assert len(out) == 11
        assert {r.page_id: r.blocked for r in out} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, None: True, 8: False, 9: False, 10: True}


def test_empty_tables(spark):
    none, entries = spark.createDataFrame([], "page_id long, url string, fetched_at long"), spark.createDataFrame([], ENTRIES)
    assert url_filter.evaluate(none, entries).count() == 0
    one = spark.createDataFrame([(1, "http://a.com", 1)], none.schema)
    assert [r.blocked for r in url_filter.evaluate(one, entries).collect()] == [False]
