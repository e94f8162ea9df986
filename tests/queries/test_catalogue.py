"""Every query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from gleaner.plans import catalogue

SF = "/root/testdata/sf0.001"
SLOW = {"train_page_classifier", "crawl_rounds"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v if isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    result = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(plain(v) for v in r) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["page_parts", "dom_links", "main_content_text"])
def test_references_cut_off(spark, name, tmp_path):
    """Texts cut inside a character reference, as pages of the larger tables have them."""
    ends = ["&amp;&amp", "&amp;&am", "&quot", "&quo", "&lt", "&", "& b", "&amp;lt;", "&quot;c", "&lt;b&gt;"]
    page = '<html lang="en"><head><title>A %s</title></head><body><h1>A %s</h1><a href="/x?a=1&copy=2">c %s</a><article><h1>A %s</h1><p>b %s</p></article></body></html>'
    rows = [(i, f"http://h/{i}", page % ((e,) * 5)) for i, e in enumerate(ends)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    result = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == sorted(result.fetchall())
