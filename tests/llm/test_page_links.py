"""Links of pages as they are written in the wild; urls that are the same."""

from pyspark.sql import functions as F

from cloakwork.llm.html_tags import attribute, opening_tags, unescaped
from cloakwork.llm.url_filter import judge_urls, page_links, url_key

LINKED = [
    '<link rel="alternate canonical" href="http://b.net/">',
    "<link title='a > b' rel=canonical href='http://b.net/'>",
    '<link title="<link" rel=CANONICAL href=http://b.net/>',
    '<link data-href="http://other.test/" rel="canonical" href="http://b.net/">',
    '<link rel="canonical" href="&#104;ttp://b.net/">',
    '<link rel="canonica&#x6C;" href="http&colon;&sol;&sol;b.net&#0047;">',
    '<link\nrel = "canonical"\n\thref = " http://b.net/\n">',
    "<LINK HREF=http://b.net REL=canonical/>"[:-2] + ">",
    '<link rel="canonical" href="http://b.net">',
    '<link rel="canonical" href="http://B.net:80/#top">',
    '<link/rel="canonical"/href="http://b.net:/">',
    '<link rel="canonical" href="http://b.net/" href="http://other.test/">',
    "<meta http-equiv=\"Refresh\" content=\"0;URL='http://b.net/'\">",
    '<meta content="5, http://b.net/" http-equiv=refresh>',
    '<!-- a --><script>"</scrip"</script ><link rel="canonical" href="http://b.net/">',
    '<base target="_top"><base href="http://b.net/x"><link rel="canonical" href="/">',
    "<!--><link rel=canonical href=http://b.net/>",
]
UNLINKED = [
    '<!-- <link rel="canonical" href="http://b.net/"> -->',
    "<script>var x = '<link rel=canonical href=http://b.net/>'</script>",
    "<div title='<link rel=canonical href=http://b.net/>'>",
    '<link rel="canonical-ish" href="http://b.net/">',
    '<link rel="canonical" data-href="http://b.net/">',
    '<linked rel="canonical" href="http://b.net/">',
    '<link rel="canonical" href="http://b.net/"',
    '<meta http-equiv="refresh" content="30">',
    '<link rel="canonical" href="">',
    "<!-- open <link rel=canonical href=http://b.net/>",
    "",
    None,
]


def test_links_as_they_are_written(spark):
    rows = [(k, f"http://m.test/{k}", h) for k, h in enumerate(LINKED + UNLINKED)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.verdict for x in judge_urls(df, [("net", "/", "block")]).collect()}
    assert [h for k, h in enumerate(LINKED) if got[k] != "block"] == []
    assert [h for k, h in enumerate(UNLINKED) if got[k + len(LINKED)] != "allow"] == []


def test_blanks_and_quotes_in_targets(spark):
    df = spark.createDataFrame([(1, "http://m.test/1", "<link rel=canonical href=\"http://n.test/it's here\">"), (2, "http://n.test/it's%20here", '<link rel="canonical" href="http://b.net">')], "page_id long, url string, html string")
    assert {x.b for x in page_links(df).collect()} == {"http://n.test/it's here", "http://b.net"}
    assert {x.verdict for x in judge_urls(df, [("net", "/", "block")]).collect()} == {"block"}


def test_rules_that_name_a_port(spark):
    links = spark.createDataFrame([("http://a.test:80/x", "http://m.test/"), ("https://a.test/", "http://n.test/"), ("broken", "http://o.test/"), (None, "http://o.test/")], "a string, b string")
    pages = spark.createDataFrame([(1, "http://m.test"), (2, "http://n.test/"), (3, "http://o.test/"), (4, "other")], "page_id long, url string")
    got = {x.page_id: x.verdict for x in judge_urls(pages, [("a.test:80", "/", "block")], links, html=None).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_keys(spark):
    same = ["http://x", "http://x/", "HTTP://X:80/#f", "http://x:/"], ["https://x/a b", "https://x:443/a%20b"], ["http://x:443/"], ["http://x?q", "http://x/?q"]
    df = spark.createDataFrame([(k, u) for k, us in enumerate(same) for u in us], "k int, u string")
    found = df.groupBy("k").agg(F.collect_set(url_key(F.col("u"))).alias("keys")).collect()
    assert all(len(x["keys"]) == 1 for x in found) and len({x["keys"][0] for x in found}) == len(same)
    assert spark.createDataFrame([("none",), ("",), (None,)], "u string").where(url_key(F.col("u")).isNotNull()).count() == 0


def test_references_and_attributes(spark):
    given = ["&#x1F600;&#8364&amp;x&ampx&amp x", "&#0;&#xD800;&#99999999;&#x;&#;&", "&bogus;&Lt;&lt;plain", "", None]
    want = ["\U0001f600€&x&ampx& x", "\ufffd\ufffd\ufffd&#x;&#;&", "&bogus;<<plain", "", None]
    df = spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, v string")
    got = {x.k: x.v for x in df.select("k", unescaped(F.col("v")).alias("v")).collect()}
    assert [got[k] for k in range(len(given))] == want
    tag = F.lit("<link a=1 A=2 b = 'x>y' c d=\"&quot;\" e=/f/>")
    row = spark.range(1).select(*(attribute(tag, c).alias(c) for c in "abcdef")).first()
    assert list(row) == ["1", "x>y", "", '"', "/f/", None]


def test_very_long_and_hostile_pages(spark):
    n = 300_000
    link = '<link rel="canonical" href="http://b.net/">'
    rows = [(1, "<link " * n), (2, "<!--" * n), (3, '<a b="' * n + '">' + link), (4, "<link " + "x=1 " * n + ">" + link), (5, "<script>" * n), (6, '<link rel="canonical" href="http://b.net/' + "&#97;" * 50_000 + '">'), (7, "<" * n + link)]
    df = spark.createDataFrame(rows, "k int, html string").withColumn("tags", F.size(opening_tags(F.col("html"), ["link"])))
    assert {x.k: x.tags for x in df.select("k", "tags").collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0, 6: 1, 7: 1}
    pages = df.select(F.col("k").alias("page_id"), F.concat(F.lit("http://m.test/"), "k").alias("url"), "html")
    assert {x.page_id for x in judge_urls(pages, [("net", "/", "block")]).where("verdict = 'block'").collect()} == {3, 4, 6, 7}
