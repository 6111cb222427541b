"""Empty tables, columns with the operators' own names, and archives with other ways of writing."""

import gzip
import hashlib
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import warc
from cloakwork.llm.packing import pack
from cloakwork.llm.quality_mil import score
from cloakwork.llm.quality_rules import OWN, clean_lines, kept_only
from cloakwork.llm.token_files import read_token_files, write_token_files
from cloakwork.llm.url_filter import judge_urls

DATE = "2024-01-01T00:00:00Z"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder, files = write_token_files(docs, P.path("word_bpe_49k.json"))
    assert read_token_files(spark, folder, files).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder, files = warc.write_warc(pages)
    assert warc.read_warc(spark, folder).count() == warc.read_warc(spark, folder, files=files).count() == 0


def test_columns_with_the_operators_names(spark):
    df = spark.createDataFrame([(1, "a line of words that is long enough to be kept by every rule of the twenty words that a text must have")], "doc_id long, text string")
    clash = df.select("*", *(F.lit(f"mine {c}").alias(c) for c in (*OWN, "_row", "lines_own", "_scored")))
    got = kept_only(clean_lines(clash)).first().asDict()
    assert all(got[c] == f"mine {c}" for c in (*OWN, "_row", "lines_own")) and got["kept"] and got["n_words"] == 23
    scored = score(clash.withColumn("score", F.lit("x")), 0.25).first().asDict()
    assert scored["_scored"] == "mine _scored" and scored["score"] == 0.25
    pages = spark.createDataFrame([(1, "http://a.net/x", "k")], "page_id long, url string, _passed string").select("*", *(F.lit(f"mine {c}").alias(c) for c in ("_action", "_key", "_best", "host")))
    links = spark.createDataFrame([("http://a.net/x", "http://b.net/y")], "a string, b string")
    got = judge_urls(pages, [("b.net", "/", "block")], links, html=None).first().asDict()
    assert got["verdict"] == "block" and got["_passed"] == "k" and all(got[c] == f"mine {c}" for c in ("_action", "_key", "_best")) and got["host"] == "a.net"
    pieces = spark.createDataFrame([(i, 10, i, f"g{i}") for i in range(5)], "id long, length long, lot long, _group string")
    assert {x._group for x in pack(pieces, 16).collect()} == {f"g{i}" for i in range(5)}


def records(n=6):
    pages = [f"<p>page {i}</p>".encode() * 5 for i in range(n)]
    return [warc.record_bytes("response", i, f"http://x.org/{i}", p, warc.digest(p), None, DATE) for i, p in enumerate(pages)]


def told(raw):
    return {f["x-row-id"]: (f["warc-target-uri"], block) for _, _, f, block in warc.salvage(raw) if f}


@pytest.mark.parametrize("packed", [False, True])
def test_every_bit_damaged_gives_no_wrong_record(packed):
    raw = bytearray(b"".join(gzip.compress(r, mtime=0) if packed else r for r in records()))
    want = told(bytes(raw))
    assert len(want) == 6
    least = 6
    for at in range(len(raw)):
        for bit in (1, 8, 128) if packed else (1, 32):
            raw[at] ^= bit
            got = told(bytes(raw))
            raw[at] ^= bit
            assert all(want.get(k) == v for k, v in got.items()), at
            least = min(least, len(got))
    assert least >= 5


def other(block, digest, extra=b""):
    head = b"\r\n".join([b"WARC/1.0", b"WARC-Type: resource", b"WARC-Target-URI: http://x/a", b"WARC-Block-Digest: " + digest, *([extra] if extra else []), b"Content-Length: %d" % len(block)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_other_ways_of_writing():
    block = b"some bytes"
    sha = hashlib.sha1(block)
    base32 = warc.digest(block).encode()
    for d in (b"sha1:" + base32, b"sha1:" + base32.lower(), b"SHA1:" + base32, b"sha1:" + sha.hexdigest().encode(), b"sha1:" + sha.hexdigest().upper().encode(), b"md5:anything"):
        assert [x[2] is not None for x in warc.salvage(other(block, d))] == [True], d
    assert [x[3] for x in warc.salvage(other(block, b"sha1:" + b"A" * 32))] == ["block digest"]
    folded = list(warc.salvage(other(block, b"sha1:" + base32, b"X-Note: one\r\n  two\r\n\tthree")))
    assert folded[0][2]["x-note"] == "one two three"


def test_blanks_are_not_held():
    import tracemalloc

    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    raw = b"".join([*(packer.compress(b" " * (1 << 20)) for _ in range(200)), packer.compress(records(1)[0]), packer.flush()])
    tracemalloc.start()
    found = [f is not None for _, _, f, _ in warc.salvage(raw)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert True in found and peak < 50 << 20


def test_records_without_digests_in_a_damaged_member():
    plain = [other(b"block %d" % i, b"md5:x") for i in range(4)]
    raw = bytearray(gzip.compress(b"".join(plain), mtime=0))
    assert sum(f is not None for _, _, f, _ in warc.salvage(bytes(raw))) == 4
    raw[-6] ^= 1  # the member's own check
    assert not any(f for _, _, f, _ in warc.salvage(bytes(raw)))


def test_a_second_attempts_files_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}") for i in range(10)], "page_id long, url string, html string")
    folder, files = warc.write_warc(pages, f"file://{tmp_path}/w")
    (tmp_path / "w/000000-99-000000.warc.gz").write_bytes(gzip.compress(records(3)[0]))
    assert warc.read_warc(spark, folder, files=files).count() == 10 and warc.read_warc(spark, folder).count() == 11
