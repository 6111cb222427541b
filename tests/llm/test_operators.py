"""The operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import gzip
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cloakwork.llm.ann import nearest
from cloakwork.llm.bpe_transducer import ByteBpe, Decoder, Utf8Stream, bpe_decode, bpe_encode
from cloakwork.llm.components import connected_components
from cloakwork.llm.packing import first_fit_decreasing, pack_documents
from cloakwork.llm.quality_mil import held_out, passages, score, train
from cloakwork.llm.quality_rules import clean_lines, kept_only
from cloakwork.llm.queries import ORACLE
from cloakwork.llm.simhash import fingerprint, near_duplicates, similar_groups
from cloakwork.llm.suffix_dedup import suffix_dedup
from cloakwork.llm.token_files import code_lengths, read_token_files, write_token_files
from cloakwork.llm.url_filter import judge_urls
from cloakwork.llm.warc import read_warc, record_bytes, salvage, write_warc

WORDS = P.path("word_bpe_49k.json")
BYTES = P.path("byte_bpe_multi_50k.tiktoken")


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    base = [words(r, r.randint(0, 150)) for _ in range(25)]
    base += [base[0] + " " + base[1], base[2], base[2], None, None, "", " \n\t ", "x", "a" * 900, "ab" * 500, "日本語😀 text", words(r, 3000)]
    return base


def docs(spark, texts):
    rows = [(i, t, "en", "src0", len(t or ""), "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(3)


def empty(spark):
    return docs(spark, []).limit(0)


def test_suffix_dedup(spark, texts):
    def brute(n):
        raw = [(t or "").encode() for t in texts]
        seen = collections.Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
        out = {}
        for k, x in enumerate(raw):
            gone = np.zeros(len(x), dtype=bool)
            for i in range(len(x) - n + 1):
                if seen[x[i : i + n]] > 1:
                    gone[i : i + n] = True
            out[k] = np.frombuffer(x, dtype=np.uint8)[~gone].tobytes()
        return out

    for n, seed in ((200, 50), (40, 12)):
        rows = suffix_dedup(docs(spark, texts), length=n, seed=seed, keep=("lang", "key")).collect()
        assert {r.doc_id: bytes(r.kept) for r in rows} == brute(n)
        assert all(r.n_removed == sum(s.stop - s.start for s in r.spans) and r.key == "extra" for r in rows)
    assert suffix_dedup(empty(spark)).count() == 0


def test_suffix_dedup_of_repeated_rows(spark):
    rows = suffix_dedup(spark.createDataFrame([(1, "z" * 10 + "y" * 300)] * 2 + [(None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 310), (1, 310)]


def _ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return [x.ids + [2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["It's  done.\n\nI'LL GO", "ǅ ß İstanbul ÀÉ", "tab\there\x0b \x1c x", "<|endoftext|> <|startoftext|>", "éa ́b", "1234 5,6"]


def test_token_files(spark, texts):
    every = texts + ODD
    folder, files = write_token_files(docs(spark, every), WORDS)
    rows = {r.id: r for r in read_token_files(spark, folder, files).collect()}
    at = 0
    for k, ids in enumerate(_ids(every)):
        assert (list(rows[k].ids), rows[k].start, rows[k].n_tokens) == (ids, at, len(ids))
        assert rows[k].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    folder, files = write_token_files(empty(spark), WORDS)
    assert files.count() == 0


def test_code_lengths_are_optimal_and_limited():
    r = np.random.default_rng(1)
    for n, longest in ((1, 4), (2, 4), (13, 4), (40, 8)):
        counts = np.append(r.integers(1, 10 ** r.integers(1, 6), n), [0, 0])
        lengths = code_lengths(counts, longest).astype(int)
        assert lengths.max() <= longest and (lengths[-2:] == 0).all()
        assert sum(2.0 ** -lengths[lengths > 0]) <= 1
    lengths = code_lengths(np.array([1, 1, 2, 4, 8]), 16)
    assert lengths.tolist() == [4, 4, 3, 2, 1]


def test_warc(spark):
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (7, None, None), (8, "x\r\ny", ""), (9, "http://c/", "é" * 5000), (3, "http://b/", "same")]
    folder, files = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = read_warc(spark, folder, with_payload=True).collect()
    assert len(found) == 6 and files.agg(F.sum("records")).first()[0] == 6
    by = {(r.row_id, r.kind): r for r in found}
    assert by[5, "revisit"].refers_to == 3 and by[5, "revisit"].payload_bytes == 4 and by[3, "response"].payload == b"same"
    assert by[8, "revisit"].refers_to == 7 and by[7, "response"].payload_bytes == 0
    assert by[9, "response"].payload_digest == base64.b32encode(hashlib.sha1(("é" * 5000).encode()).digest()).decode()
    folder, files = write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert files.count() == 0


def test_salvage():
    one = [record_bytes("response", i, f"http://x/{i}", f"page {i}".encode() * 50, "", None, "2024-01-01T00:00:00Z") for i in range(5)]
    packed = [gzip.compress(x) for x in one]
    good = list(salvage(b"".join(packed)))
    assert len(good) == 5 and all(f for _, _, f, _ in good)
    hurt = bytearray(b"".join(packed))
    second = len(packed[0])
    hurt[second + 30 : second + 60] = bytes(30)
    found = list(salvage(bytes(hurt) + b"junk"))
    assert [f["x-row-id"] for _, _, f, _ in found if f] == ["0", "2", "3", "4"]
    gaps = [(a, b) for a, b, f, _ in found if f is None]
    assert gaps == [(second, second + len(packed[1])), (len(hurt), len(hurt) + 4)]
    plain = b"".join(one)
    inside = len(one[0]) + len(one[1]) - 60
    broken = plain[:inside] + plain[inside + 7 :]
    assert [f["x-row-id"] for _, _, f, _ in salvage(broken) if f] == ["0", "2", "3", "4"]
    cut = list(salvage(plain[:-10]))
    assert [f is None for _, _, f, _ in cut] == [False] * 4 + [True]
    assert list(salvage(b"")) == []


def _groups(prints):
    ids = sorted(prints)
    near = {i: {j for j in ids if (prints[i] ^ prints[j]).bit_count() <= 2} for i in ids}
    out = {}
    for i in ids:
        if i not in out:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in out:
                    out[j] = i
                    todo += near[j]
    return out


def test_near_duplicates(spark, texts):
    r = random.Random(5)
    long = [words(r, 400) for _ in range(4)]
    edited = [" ".join("ZZ" if r.random() < 0.004 else w for w in t.split()) for t in long for _ in range(8)]
    every = texts + long + edited
    rows = near_duplicates(docs(spark, every)).collect()
    prints = {k: fingerprint(t) & (2**64 - 1) for k, t in enumerate(every)}
    assert {x.doc_id: x.fingerprint for x in rows} == {k: f"{v:016x}" for k, v in prints.items()}
    assert {x.doc_id: x.component_id for x in rows} == _groups(prints)
    assert near_duplicates(empty(spark)).count() == 0


def test_fingerprint_of_one_shingle():
    import xxhash

    assert fingerprint("The  CAT\tsat") & (2**64 - 1) == xxhash.xxh64_intdigest(b"the cat sat", 42)
    assert fingerprint("É b") & (2**64 - 1) == xxhash.xxh64_intdigest("É b".encode(), 42)
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_similar_groups(spark):
    r = random.Random(9)
    base = [words(r, 300) for _ in range(12)]
    near = [" ".join("ZZ" if i == 150 else w for i, w in enumerate(t.split())) for t in base[:6]]
    shared = words(r, 60)
    other = [words(r, 200) + " " + shared for _ in range(6)]
    every = base + near + other + [base[0], None, ""]
    got = {x.doc_id: x.group for x in similar_groups(docs(spark, every)).collect()}
    want = {i: i for i in range(len(every))} | {12 + i: i for i in range(6)} | {24: 0, 26: 25}
    assert got == want


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3), (2000, 2001), (2001, 2000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def _against_duckdb(spark, tmp_path, name, table, rows):
    path = str(tmp_path / f"{table}.parquet")
    rows.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    return con.execute(ORACLE[name]).fetchall(), [d[0] for d in con.description]


def test_quality_rules(spark, texts, tmp_path):
    r = random.Random(8)
    clean = "\n".join(words(r, 20) + "." for _ in range(5))
    every = texts + [clean, clean + "\n" + "a | b | c | d | e", "\n".join(w + "!! " + w + "###" for w in clean.split()), "spam " * 60, clean + "\n" + clean, clean + "\nAll rights reserved", "in in in in in " * 9 + clean, "\n\n" + clean]
    rows = clean_lines(docs(spark, every)).collect()
    sql, names = _against_duckdb(spark, tmp_path, "op5_quality_rules", "documents", docs(spark, every))
    assert sorted(tuple(getattr(x, c) for c in names) for x in rows) == sorted(sql)
    by = {x.doc_id: x for x in rows}
    n = len(texts)
    assert [by[n + k].kept for k in range(8)] == [True, True, False, False, False, True, False, True]
    assert by[n + 1].clean_text == clean and by[n + 7].clean_text == "\n\n" + clean
    assert not by[texts.index(None)].kept
    assert kept_only(clean_lines(docs(spark, every))).count() == sum(x.kept for x in rows)
    assert clean_lines(empty(spark)).count() == 0


def test_byte_bpe(spark, texts):
    import tiktoken

    bpe, decoder = ByteBpe(BYTES, P.PATTERN), Decoder(BYTES)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.machine.ranks, special_tokens={})
    r = random.Random(4)
    odd = ["".join(r.choice("abceéßth '\n\t.1日😀A") for _ in range(r.randint(0, 60))) for _ in range(400)]
    for t in texts + ODD + odd:
        ids = bpe.encode(t)
        assert ids.tolist() == want.encode_ordinary(t or "")
        assert decoder.decode(ids) == (t or "")
    rows = bpe_decode(bpe_encode(docs(spark, texts), BYTES, P.PATTERN, keep=("doc_id", "key")), BYTES).collect()
    assert {x.doc_id: (list(x.ids), x.decoded) for x in rows} == {k: (want.encode_ordinary(t or ""), t or "") for k, t in enumerate(texts)}
    both = bpe_encode(docs(spark, texts), BYTES, P.PATTERN, round_trip=True).collect()
    assert {x.doc_id: (list(x.ids), x.decoded) for x in both} == {x.doc_id: (list(x.ids), x.decoded) for x in rows}
    assert bpe_encode(empty(spark), BYTES, P.PATTERN).count() == 0


def test_utf8_stream():
    data = "aé日😀z".encode() + b"\xf0\x9f" + b"ok" + b"\xe6"
    for size in (1, 2, 3, 5):
        stream = Utf8Stream()
        got = "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.finish()
        assert got == data.decode("utf-8", "replace")


def test_quality_classifier(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        t = words(r, 120)
        rows.append((i, t if good else " ".join(w + "###" for w in t.split())))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = score(df, train(df, known)).withColumn("held", held_out("doc_id")).collect()
    assert all(0 <= x.score <= 1 for x in out) and len(out) == len(rows)
    held = [x for x in out if x.held and x.doc_id is not None and x.doc_id < 300]
    assert len(held) > 30 and np.mean([(x.score >= 0.3) == (x.doc_id % 3 > 0) for x in held]) > 0.97
    assert {x.doc_id for x in out if x.held} == {i for i in [*range(300), 1000, 1001, 1002] if zlib.crc32(str(i).encode()) % 5 == 0}
    none = train(df, known.limit(0))
    assert none == 0.5 and score(df, none).count() == len(rows) and score(df.limit(0), none).count() == 0


def test_passages_cover_whole_texts():
    x, owner = passages(["w " * 250, "", None, "a"])
    assert np.bincount(owner).tolist() == [3, 1, 1, 1] and np.isfinite(x).all()


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_url_filter(spark):
    link = '<html><link href="{}" rel="canonical"></html>'
    pages = [
        (1, "http://A.example.NET/en/x?q", None),
        (2, "http://b.net/", ""),
        (3, None, None),
        (4, "no scheme", None),
        (5, "http://www.example.com/de/", None),
        (6, "http://mirror.test/1#top", link.format("http://b.net/")),
        (7, "http://mirror.test/2", '<meta http-equiv="refresh" content="0; url=http://mirror.test/1">'),
        (8, "http://alone.test/?u=://net/", None),
        (9, "http://other.test/", link.format("http://www.example.com/de/")),
        (10, "http://good.org/fr/", link.format("http://other.test/")),
        (11, "http://notexample.com/de/", None),
        (8, "http://alone.test/?u=://net/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("old"))
    rows = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in judge_urls(df, RULES).collect()}
    assert rows[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert rows[2] == ("b.net", "/", "net/", "block")
    assert rows[3] == rows[4] == ("", "", None, "allow")
    assert rows[5][2:] == ("example.com/de/", "block")
    assert rows[8] == ("alone.test", "/", None, "allow") and rows[11][2:] == (None, "allow")
    assert rows[9][3] == "allow" and rows[10][2:] == ("org/fr/", "allow")
    assert judge_urls(df, RULES).count() == len(pages)
    many = RULES + [(f"h{i}.test", "/", "block") for i in range(300)]
    assert {x.page_id: (x.rule, x.verdict) for x in judge_urls(df, many).collect()} == {k: v[2:] for k, v in rows.items()}
    assert judge_urls(df.limit(0), RULES).count() == 0


def test_url_aliases(spark):
    pages = spark.createDataFrame([(6, "http://mirror.test/1", None), (7, "http://mirror.test/2", None)], "page_id long, url string, html string")
    links = spark.createDataFrame([("http://mirror.test/1", "http://b.net/"), ("HTTP://Mirror.test/2", "http://mirror.test/1#x")], "a string, b string")
    assert {x.verdict for x in judge_urls(pages, RULES, links).collect()} == {"block"}


def test_nearest(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((12, 16))
    x = (centres[r.integers(0, 12, 1200)] + 0.3 * r.standard_normal((1200, 16))).astype("f4")
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0] * 3), (2005, rows[0][1]), (2006, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for q in nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.id, q.score))
    ids = np.append(np.arange(1200), 2005)
    wide = np.vstack([x, x[:1]]).astype(float)
    hits = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
        assert all(abs(s - d[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
    assert sorted(got) == list(range(0, 1200, 100)) and hits >= 0.9 * 120
    assert got[0][0] == (2005, 0.0)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")
    assert nearest(few, "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 3
    assert nearest(few.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_first_fit_decreasing():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 57, 300):
        sizes = r.integers(1, 101, n)
        bins, offsets = first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
            if k == len(room):
                room.append(100)
            want[i] = (k, 100 - room[k])
            room[k] -= sizes[i]
        assert all(want[i] == (bins[i], offsets[i]) for i in range(n))


def test_packing(spark, texts):
    every = texts + ODD
    rows = pack_documents(docs(spark, every), WORDS, capacity=256).collect()
    ids = dict(enumerate(_ids(every)))
    for k, want in ids.items():
        own = sorted((x for x in rows if x.doc_id == k), key=lambda x: x.start)
        assert [i for x in own for i in x.ids] == want
        assert all(x.start == sum(y.length for y in own[:j]) and x.doc_tokens == len(want) for j, x in enumerate(own))
        assert all(x.ids_crc32 == zlib.crc32(np.array(x.ids, dtype="<u4").tobytes()) for x in own)
    bins = collections.defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append((x.offset, x.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert pack_documents(empty(spark), WORDS).count() == 0
