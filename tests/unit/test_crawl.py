import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from gleaner import __main__ as cli
from gleaner.operators import crawl

HOST = "https://host/"
WEB = {
    HOST: '<title>Lustnau</title><html lang="en"><a href="/a">A</a><a href="/b">B</a><a href="https://other/x">x</a><p>start page',
    HOST + "a": '<html lang="en"><title>Lustnau a</title><a href="/b">B</a><a href="/c">C</a><p>first page of all',
    HOST + "b": '<html lang="en"><title>Lustnau b</title><p>second page with words',
    HOST + "c": '<html lang="en"><title>Lustnau b</title><p>second page with words',
    "https://other/x": '<html lang="de"><title>Lustnau</title><p>deutsche seite',
}


def test_rounds_over_a_small_web(spark, tmp_path):
    web = spark.createDataFrame([(u, 200, "text/html", m) for u, m in WEB.items()], "url string, status_code int, content_type string, html string")
    seeds = spark.createDataFrame([(HOST, 1)], "url string, round_robin_weight int")
    one = lambda: F.lit(0.9)
    done = crawl.crawl(seeds, web, one, one, crawl.Settings(rounds=1))
    assert done.saved.first().url == next(iter(WEB)) and (done.saved.count(), done.frontier.count()) == (1, 3)
    done.write(str(tmp_path / "state"))
    done = crawl.crawl(seeds, web, one, one, crawl.Settings(rounds=5), crawl.State.read(spark, str(tmp_path / "state")))
    assert {r.url.rpartition("/")[2] for r in done.saved.collect()} == {"", "a", "b"}
    assert {(r.url, r.exclusion_reason) for r in done.rejected.collect()} == {(HOST + "c", "duplicate_text"), ("https://other/x", "non_english")}
    status = {(r.parent_url, r.target_url): r.target_status for r in done.links.collect()}
    assert status[HOST, HOST + "a"] == "page" and status[HOST, "https://other/x"] == "rejected"
    assert done.frontier.count() == 0
    assert [tuple(r) for r in done.statistics.collect()] == [(HOST, 5, 5, 0, 3)]


def test_a_seed_stops_at_its_limit(spark, tmp_path):
    web = spark.createDataFrame([(u, 200, "text/html", m) for u, m in WEB.items()], "url string, status_code int, content_type string, html string")
    seeds = spark.createDataFrame([(HOST, 1, 2)], "url string, round_robin_weight int, max_pages_per_seed int")
    one = lambda: F.lit(0.9)
    folder = str(tmp_path / "state")
    done = crawl.crawl(seeds, web, one, one, crawl.Settings(), folder=folder)
    assert done.saved.count() == 2 and done.frontier.count() > 0
    again = crawl.crawl(seeds, web, one, one, crawl.Settings(), folder=folder)
    assert again.saved.count() == 2 and len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("state-")]) == 1


def test_a_failing_round_keeps_what_was_done(spark, tmp_path, monkeypatch):
    web = spark.createDataFrame([(u, 200, "text/html", m) for u, m in WEB.items()], "url string, status_code int, content_type string, html string")
    seeds = spark.createDataFrame([(HOST, 1)], "url string, round_robin_weight int")
    one, folder, step = lambda: F.lit(0.9), str(tmp_path / "state"), crawl.step

    def breaks(state, web, page, link, s, number):
        if number == 2:
            raise RuntimeError("lost")
        return step(state, web, page, link, s, number)

    monkeypatch.setattr(crawl, "step", breaks)
    with pytest.raises(RuntimeError):
        crawl.crawl(seeds, web, one, one, crawl.Settings(), folder=folder, save_every=5)
    assert crawl.State.read(spark, folder).saved.count() == 1 and crawl.State.read(spark, str(tmp_path / "none")) is None


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        host = f"http://127.0.0.1:{self.server.server_port}/"
        pages = {"/" + u.removeprefix(HOST): m.replace(HOST, host) for u, m in WEB.items() if u.startswith(HOST)}
        pages["/robots.txt"] = "User-agent: *\nDisallow: /b"
        body = pages.get(self.path, "").encode()
        self.send_response(200 if body else 404)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_crawl_command(spark, tmp_path, capsys):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}/"
    (tmp_path / "seeds.toml").write_text(f'[[sites]]\nurl = "{host}"\nretries = 1\n')
    run = ["crawl", "--seeds", str(tmp_path / "seeds.toml"), "-o", str(tmp_path / "out"), "--accept-all", "--pause", "0"]
    cli.main([*run, "--rounds", "1"])
    assert crawl.State.read(spark, str(tmp_path / "out")).saved.count() == 1
    cli.main(run)
    server.shutdown()
    state = crawl.State.read(spark, str(tmp_path / "out"))
    assert {r.url for r in state.saved.collect()} == {host, host + "a", host + "c"}  # b is closed to robots
    assert f"{host}: discovered" in capsys.readouterr().out
    cli.main(["report", "--crawl", str(tmp_path / "out")])
    assert "harvest rate:" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(run[:5])


def test_goes_on_until_the_frontier_is_empty(spark, monkeypatch):
    left = iter(range(11, -1, -1))

    def step(state, *_):
        state.frontier = spark.range(next(left))
        return state

    monkeypatch.setattr(crawl, "step", step)
    monkeypatch.setattr(crawl, "active", lambda state: state.frontier)
    one = lambda: F.lit(0.9)
    done = crawl.crawl(spark.createDataFrame([("https://h0/", 1)], "url string, round_robin_weight int"), None, one, one, crawl.Settings())
    assert done.frontier.isEmpty() and next(left, None) is None


def test_a_round_takes_what_hosts_still_allow(spark):
    urls = [(f"https://{h}/{i}", f"https://{h}/{i}", 0, 1.0, -1.0, 1, -1) for h, n in (("a", 9), ("b", 3)) for i in range(n)]
    frontier = spark.createDataFrame(urls, "url string, seed string, depth int, score double, priority double, weight int, seed_limit int")
    none = spark.createDataFrame([], crawl.PAGE)
    state = crawl.State(frontier, frontier.select("url"), none, none, spark.createDataFrame([], crawl.LINK), spark.createDataFrame([], crawl.STATISTICS))
    s = crawl.Settings(per_round=None)
    assert {r.host: r["count"] for r in crawl.pick(state, s).groupBy("host").count().collect()} == {"a": s.frontier.reject_cutoff, "b": 3}


def test_web_is_made_once_and_files_do_not_pile_up(spark):
    """A round reads the web of the catalogue's crawl, it doesn't join it anew; rounds add rows but no files without end."""
    from gleaner.plans import site

    web = site._web(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in web._jdf.queryExecution().executedPlan().toString() and web.count() > 0
    rows = spark.range(8).coalesce(1)
    for _ in range(6):
        rows = crawl.together(rows, spark.range(2).coalesce(1))
    assert rows.count() == 20 and rows.rdd.getNumPartitions() <= 4
