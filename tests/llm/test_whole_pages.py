"""Archives with damage inside a member, and links without a scheme."""

import gzip

from pyspark.sql import functions as F

from cloakwork.llm.url_filter import judge_urls, resolved
from cloakwork.llm.warc import read_warc, record_bytes, salvage, write_warc


def test_long_url(spark):
    url = "http://x/?" + "q" * 100_000
    folder, _ = write_warc(spark.createDataFrame([(1, url, "page")], "page_id long, url string, html string"))
    assert [(x.row_id, x.kind, x.target_uri) for x in read_warc(spark, folder).collect()] == [(1, "response", url)]


def test_salvage_inside_a_member():
    from cloakwork.llm.warc import digest

    one = []
    for i in range(5):
        page = (f"page {i} " * 50).encode() + bytes((k * k + i) % 251 for k in range(500))
        one.append(record_bytes("response", i, f"http://x/{i}", page, digest(page), None, "2024-01-01T00:00:00Z"))
    ids = lambda raw: [f["x-row-id"] if f else None for _, _, f, _ in salvage(raw)]
    hurt = bytearray(b"".join(one))
    hurt[len(one[0]) + len(one[1]) - 60] ^= 1
    assert ids(gzip.compress(bytes(hurt))) == ["0", None, "2", "3", "4"]
    whole = gzip.compress(b"".join(one), 0)
    alone = gzip.compress(one[4])
    assert ids(whole[: len(whole) - len(one[4])]) == ["0", "1", "2", "3", None]
    wrong = bytearray(whole)
    wrong[-6] ^= 1  # the checksum
    assert ids(bytes(wrong) + alone) == ["0", "1", "2", "3", "4", None, "4"]


def test_relative_links(spark):
    base = "http://H.net/a/b?q#f"
    cases = {"//x.y/z": "http://x.y/z", "/p?r": "http://H.net/p?r", "c": "http://H.net/a/c", "../c/./d": "http://H.net/c/d", "?k": "http://H.net/a/b?k", "..": "http://H.net/", "https://o/": "https://o/", "/go?u=http://z/": "http://H.net/go?u=http://z/", "../../../c": "http://H.net/c"}
    df = spark.createDataFrame([(t, base) for t in cases], "t string, b string")
    assert {x.t: x.r for x in df.select("t", resolved(F.col("t"), F.col("b")).alias("r")).collect()} == cases
    link = '<link rel="canonical" href="{}">'
    pages = [(1, "http://m.test/1", link.format("//b.net/")), (2, "http://m.test/d/2", link.format("/1")), (3, "http://m.test/d/3", '<meta http-equiv="refresh" content="0;url=2">'), (4, "http://m.test/4", link.format("mailto:x"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x.page_id: x.verdict for x in judge_urls(df, [("net", "/", "block")]).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}
