"""Rules of equal length, entities, base elements, and aliases against SQL."""

import duckdb
from pyspark.sql import functions as F

from cloakwork.llm import url_filter
from cloakwork.llm.queries import ORACLE, url_aliases
from cloakwork.llm.url_filter import judge_urls

TIED = [("b.c", "/xx", "block"), ("a.b.c", "/", "allow"), ("d.e", "/", "block"), ("d.e", "/", "allow")]


def test_ties_whatever_the_number_of_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/xx"), (2, "http://d.e/1"), (3, "http://x.b.c/xxy"), (4, None), (5, "")], "page_id long, url string")
    want = {1: ("a.b.c/", "allow"), 2: ("d.e/", "allow"), 3: ("b.c/xx", "block"), 4: (None, "allow"), 5: (None, "allow")}
    for rules in (TIED, TIED[::-1], TIED + [(f"h{i}.test", "/", "block") for i in range(300)]):
        assert {x.page_id: (x.rule, x.verdict) for x in judge_urls(pages, rules, html=None).collect()} == want


def test_entities_and_base(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://m.test/1", link.format("http://b.net/?x=1&amp;y=2")),
        (2, "http://b.net/?x=1&y=2", None),
        (3, "http://m.test/3", '<base href="http://c.net/d/">' + link.format("e")),
        (4, "http://m.test/4", link.format("http:&#47;&#47;b.net/")),
        (5, "http://m.test/5", '<base href="/f/">' + link.format("g")),
        (6, "http://m.test/f/g", link.format("//q.net/")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    links = {x.a: x.b for x in url_filter.page_links(df).collect()}
    assert links == {"http://m.test/1": "http://b.net/?x=1&y=2", "http://m.test/3": "http://c.net/d/e", "http://m.test/4": "http://b.net/", "http://m.test/5": "http://m.test/f/g", "http://m.test/f/g": "http://q.net/"}
    assert {x.verdict for x in judge_urls(df, [("net", "/", "block")]).collect()} == {"block"}


def test_aliases_as_the_sql_says(spark, tmp_path, monkeypatch):
    hosts = ["a.net", "www.example.net", "m.test", "x.org", "example.com", "n.test"]
    rows = [(i, f"http://{hosts[i * 7 % 6]}/{'en' if i % 2 else 'de'}/{i % 11}") for i in range(120)] + [(500, None), (501, "none")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(f"select page_id, verdict, rule from ({ORACLE['url_aliases']})").fetchall())
    for most in (url_filter.MOST_BROADCAST, 0):
        monkeypatch.setattr(url_filter, "MOST_BROADCAST", most)
        assert sorted((x.page_id, x.verdict, x.rule) for x in url_aliases(spark, str(tmp_path)).collect()) == want
    assert {v for _, v, r in want if r is None} == {"allow", "block"}
