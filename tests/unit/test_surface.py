import json

import numpy as np
import pytest

from gleaner import __main__ as cli
from gleaner import api
from gleaner.operators import index, ml, stores
from gleaner.sources import web


@pytest.fixture(scope="module")
def service(spark):
    docs = index.documents(spark.createDataFrame([(0, "apple apple pear"), (1, "pear plum")], "doc_id long, text string"))
    return api.SearchService(index.postings(docs), docs)


def test_search_endpoint(service):
    get = lambda target: api.answer(service.routes(), "GET", target)
    status, _, body = get("/search?q=apple+plum&top_n=1")
    assert status == 200 and [r["doc"] for r in json.loads(body)] == [0]
    assert json.loads(get("/health")[2]) == {"status": "ok", "documents": 2}
    for bad in ("/search", "/search?q=", "/search?q=a&top_n=0", "/search?q=a&top_n=101", "/search?q=a&context_size=x"):
        assert get(bad)[0] == 422
    assert get("/nothing")[0] == 404


def test_label_endpoints(spark, tmp_path):
    rows = [(1, "q w", 1, 1, None, None, None, 0.4, "crawler_pageverdict", "x"), (2, "q w", 1, 2, 5, "positive", "t", 0.9, "crawler_pageverdict", "x")]
    spark.createDataFrame(rows, "id long, query string, page_number int, rank int, rating int, label string, rated_at string, pageverdict_score double, source string, pageverdict_decision string").write.parquet(str(tmp_path / "results"))
    routes = api.LabelService(spark, str(tmp_path)).routes()
    call = lambda m, t, b=None: api.answer(routes, m, t, json.dumps(b).encode() if b else b"")
    assert [r["id"] for r in json.loads(call("GET", "/api/crawler-candidates?limit=0")[2])] == [1]
    assert [r["id"] for r in json.loads(call("GET", "/api/results?query=%20q%20%20w")[2])] == [1, 2]
    assert call("POST", "/api/rating", {"id": 1, "rating": 2})[0] == 200
    assert json.loads(call("GET", "/api/stats")[2]) == {"total": 2, "rated": 2, "by_label": {"negative": 1, "positive": 1}, "by_rating": {"2": 1, "5": 1}}
    assert call("POST", "/api/rating", {"id": 9, "rating": 2})[0] == 404 and call("POST", "/api/rating", {"id": 1, "rating": 6})[0] == 422
    assert call("POST", "/api/rating", {"id": 1, "rating": None})[0] == 200
    assert len(call("GET", "/api/export/serp-labels.jsonl")[2].splitlines()) == 2  # rated or not, as the store has them


def test_imports_and_exports(spark, tmp_path):
    pages = [
        {"url": "http://h.org/a", "title": "A", "pageverdict_score": 0.52, "status_code": "200", "crawl_depth": 2, "notes": "n"},
        {"url": " ", "title": "none"},
        {"url": "http://h.org/b", "rank": 7, "query": "own", "source": "elsewhere", "pageverdict_score": "0.9"},
    ]
    links = [{"parent_url": "https://www.p.org/x", "url": "https://t.org/y", "anchor": "go", "raw_score": "3", "should_enqueue": "yes"}, {"parent_url": "https://p.org", "anchor": "no target"}]
    for name, rows in (("pages", pages), ("links", links), ("broken", [])):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + ("{" if name == "broken" else ""))
    calls = []
    found = [[{"link": "http://w.org/1", "title": "W", "snippet": "s"}]]
    routes = api.LabelService(spark, str(tmp_path / "store"), lambda q: calls.append(q) or found).routes()
    call = lambda m, t, b=None: api.answer(routes, m, t, json.dumps(b).encode() if b is not None else b"")
    put = lambda kind, name, **more: call("POST", f"/api/import/{kind}", {"path": str(tmp_path / name), **more})
    status, _, body = put("crawler-pageverdict", "pages.jsonl", query=" my  query ")
    got = json.loads(body)
    assert status == 200 and got["stored"] == 2 and [r["url"] for r in got["results"]] == ["http://h.org/a", "http://h.org/b"]
    a, b = got["results"]
    assert (a["query"], a["rank"], a["crawler_status_code"], a["crawler_depth"], a["display_url"], a["notes"]) == ("my query", 1, 200, 2, "h.org", "n")
    assert (b["query"], b["rank"], b["source"], b["page_number"]) == ("own", 7, "elsewhere", 1)
    assert call("POST", "/api/rating", {"id": a["id"], "rating": 5, "notes": " good "})[0] == 200
    pages[0]["title"] = "A again"
    (tmp_path / "pages.jsonl").write_text("".join(json.dumps(r) + "\n" for r in pages))
    again = json.loads(put("crawler-pageverdict", "pages.jsonl", query="my query", unlabeled_only=False)[2])
    kept = next(r for r in again["results"] if r["id"] == a["id"])
    assert (kept["title"], kept["rating"], kept["label"], kept["notes"], kept["created_at"]) == ("A again", 5, "positive", "good", a["created_at"])
    assert put("crawler-pageverdict", "gone.jsonl")[0] == 404 and put("crawler-pageverdict", "")[0] == 400 and put("crawler-pageverdict", "pages.jsonl", query=" ")[0] == 400
    assert put("link-candidates", "broken.jsonl")[0] == 400
    (link,) = json.loads(put("link-candidates", "links.jsonl")[2])["results"]
    assert (link["target_url"], link["target_host"], link["parent_host"], link["raw_score"], link["should_enqueue"], link["source"]) == ("https://t.org/y", "t.org", "www.p.org", 3.0, True, "crawler_linkverdict")
    found_now = json.loads(call("POST", "/api/search", {"query": " w  w "})[2])
    assert calls == ["w w"] and [r["url"] for r in found_now["results"]] == ["http://w.org/1"]
    assert call("POST", "/api/search", {"query": ""})[0] == 400
    lines = [json.loads(x) for x in call("GET", "/api/export/serp-labels.jsonl")[2].splitlines()]
    assert [r["url"] for r in lines] == ["http://h.org/a", "http://h.org/b", "http://w.org/1"]
    assert list(lines[0]) == list(stores.RESULTS) and lines[0]["rating"] == 5 and lines[1]["rating"] is None
    (line,) = [json.loads(x) for x in call("GET", "/api/export/link-labels.jsonl")[2].splitlines()]
    assert list(line) == list(stores.LINKS)
    assert call("GET", "/")[1].startswith("text/html")
    alone = api.LabelService(spark, str(tmp_path / "none"))
    assert api.answer(alone.routes(), "POST", "/api/search", b'{"query": "q"}')[0] == 503
    assert json.loads(api.answer(alone.routes(), "GET", "/api/stats")[2])["total"] == 0


def replies(*answers):
    it = iter(answers)
    return lambda url, timeout: next(it)


HTML = {"content-type": "text/html; charset=utf-8"}


def test_fetch_retries():
    slept = []
    got = web.fetch("u", delay=2, get=replies((503, {}, b""), (429, {"retry-after": "7"}, b""), (200, HTML, b"x")), sleep=slept.append)
    assert got == web.Fetched(b"x", 200, HTML["content-type"]) and slept == [2, 7]
    assert web.fetch("u", retries=2, get=replies((500, {}, b""), (500, {}, b"")), sleep=slept.append).status_code == 500
    assert web.fetch("u", get=replies((404, HTML, b"x"))).body is None and web.fetch("u", get=replies((200, {"content-type": "image/png"}, b"x"))).body is None
    assert web.retry_delay({"retry-after": "999"}, 0, 1) == 30 and web.retry_delay({"retry-after": "later"}, 2, 1) == 3


def test_robots():
    assert not web.robots("http://h/x", get=replies((200, {}, b"User-agent: *\nDisallow: /private"))).can_fetch("gleaner", "http://h/private/a")
    assert web.robots("http://h/x", get=replies((404, {}, b""))).can_fetch("gleaner", "http://h/private")


def test_fetch_pages(spark):
    def get(url, timeout):
        if url.endswith("robots.txt"):
            return 200, {}, b"User-agent: *\nDisallow: /no"
        if url.endswith("/down"):
            raise OSError("down")
        return 200, {"content-type": "text/html"}, b"<p>x"

    targets = spark.createDataFrame([("http://a/1",), ("http://a/no",), ("http://b/down",), (None,)], "url string")
    got = {r.url: (r.status_code, r.html, r.error) for r in web.fetch_pages(targets, 2, 0, get).collect()}
    assert got == {"http://a/1": (200, "<p>x", None), "http://a/no": (None, None, "robots"), "http://b/down": (None, None, "down")}


def test_search_results_keep_the_first():
    page = [{"link": "http://a.org:80/x"}, {"link": "http://a.org/x#y"}, {}]
    got = web.search_results([page, [{"link": "http://b.org"}]], "q")
    assert [(r["url"], r["rank"]) for r in got] == [("http://a.org:80/x", 1), ("http://b.org", 11)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.HTML").write_text("<p>apple pie recipe</p>")
    (tmp_path / "in" / "b.txt").write_text("apple")
    cli.main(["index", "--pages", str(tmp_path / "in"), "-o", str(tmp_path / "ix")])
    cli.main(["search", "-i", str(tmp_path / "ix"), "-q", "apple"])
    assert "a.HTML" in capsys.readouterr().out
    (tmp_path / "q.tsv").write_text("1\tpie\n")
    cli.main(["batch", "-i", str(tmp_path / "ix"), "-b", str(tmp_path / "q.tsv"), "-o", str(tmp_path / "run")])
    assert any("a.HTML" in f.read_text() for f in (tmp_path / "run").glob("*.csv"))


def test_train_and_predict_commands(spark, tmp_path, capsys):
    rows = []
    for i in range(260):
        good = i % 2
        word = ("neckar", "castle") if good else ("casino", "loans")
        rows.append({"url": f"http://h{i % 20}.org/{i}", "title": f"{word[0]} page {i}", "snippet": f"about {word[1]} and {word[0]}", "rating": 5 if good else 1, "label": "positive" if good else "negative"})
    rows.append({"url": "http://h.org/x", "title": "skip", "snippet": "", "rating": 3, "label": "skip"})
    (tmp_path / "l.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    cli.main(["train", "page", "--labels", str(tmp_path / "l.jsonl"), "-o", str(tmp_path / "m"), "--iterations", "40"])
    report = json.loads((tmp_path / "m" / "metrics.json").read_text())
    assert report["examples"]["all"] == 260 and report["average_precision"] > 0.99 and 0.2 <= report["threshold"] <= 0.9
    assert {r["label"] for r in report["by_label"]} == {"positive", "negative"}
    assert spark.read.json(str(tmp_path / "m" / "validation.jsonl")).count() == report["examples"]["held_out"]
    cli.main(["predict", "page", "--model", str(tmp_path / "m" / "model.json"), "--rows", str(tmp_path / "l.jsonl"), "-o", str(tmp_path / "p")])
    got = spark.read.json(str(tmp_path / "p")).where("label <> 'skip'").collect()
    assert all((r.predicted == "positive") == (r.label == "positive") for r in got) and len(got) == 260
    with pytest.raises(SystemExit):
        cli.main(["train", "link", "--labels", str(tmp_path / "l.jsonl"), "-o", str(tmp_path / "n")])


def test_critics_read_what_a_crawl_has(spark):
    model = ml.Classifier(ml.PAGE, {"w:neckar": (0, 1.0)}, np.array([4.0]), -2.0)
    page = spark.createDataFrame([("Neckar", "http://h/", None, "h1", "text"), ("x", "http://h/", None, None, "y")], "title string, url string, description string, h1 string, text string")
    assert [round(r.s, 3) for r in page.select(ml.page_critic(model)().alias("s")).collect()] == [0.881, 0.119]
    link = spark.createDataFrame([("Neckar", "http://h/a", "h", "http://p/", "p", 1)], "anchor string, target_url string, target_host string, parent_url string, parent_host string, depth int")
    assert round(link.select(ml.link_critic(model)().alias("s")).first().s, 3) == 0.881
