"""Every single byte of small archives damaged in turn: nothing fails, and what is sound is found."""

import gzip
import zlib

import pytest

from cloakwork.llm.warc import digest, read_warc, record_bytes, salvage


def records(n=4):
    pages = [f"page {i} <p>text</p>".encode() * 3 for i in range(n)]
    return [record_bytes("response", i, f"http://x/{i}", p, digest(p), None, "2024-01-01T00:00:00Z") for i, p in enumerate(pages)]


def found(raw):
    return {f.get("x-row-id") for _, _, f, _ in salvage(raw) if f}


@pytest.mark.parametrize("flip", [0x01, 0x80, 0xFF])
@pytest.mark.parametrize("form", ["plain", "members", "one member, stored"])
def test_each_byte(form, flip):
    one = records()
    parts = one if form == "plain" else [gzip.compress(x) for x in one]
    raw = b"".join(one if form == "plain" else parts)
    if form == "one member, stored":
        raw = gzip.compress(b"".join(one), 0)
    ends = [len(b"".join(parts[: i + 1])) for i in range(len(parts))]
    for at in range(len(raw)):
        hurt = bytearray(raw)
        hurt[at] ^= flip
        got = found(bytes(hurt))
        if form == "one member, stored":
            # the stream's own head, block lengths and end tell where its content lies; the records keep their digests
            assert at < 20 or at >= len(raw) - 8 or len(got & {"0", "1", "2", "3"}) >= 3
        else:
            struck = next(i for i, end in enumerate(ends) if at < end)
            assert {"0", "1", "2", "3"} - {str(struck)} <= got


def test_headers_that_are_no_numbers(spark, tmp_path):
    one = records()
    for old, new in ((b"X-Row-Id: 1", b"X-Row-Id: ~"), (b"X-Row-Id: 1", "X-Row-Id: ²".encode()), (b"\r\nContent-Length: ", "\r\nContent-Length: ²".encode()), (b"\r\nContent-Length: ", b"\r\nContent-Length: " + b"9" * 5000)):
        raw = one[0] + one[1].replace(old, new, 1) + one[2] + one[3]
        assert found(raw) == {"0", "2", "3"}
    (tmp_path / "a.warc").write_bytes(one[0] + one[1].replace(b"X-Row-Id: 1", b"X-Row-Id: ~") + one[2])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one[0])[:-9])
    (tmp_path / "c.warc").write_bytes(b"")
    rows = sorted((x.path[-6:], x.kind, x.row_id) for x in read_warc(spark, str(tmp_path)).collect())
    assert [r[1:] for r in rows if "a.warc" in r[0]] == [("gap", None), ("response", 0), ("response", 2)]
    assert {k for p, k, _ in rows if p.endswith("arc.gz")} <= {"gap", "response"} and len(rows) >= 4


def test_cut_off_single_member():
    one = records(200)
    raw = gzip.compress(b"".join(one), 6)
    assert len(found(raw[: len(raw) * 3 // 4])) > 100
    assert found(raw[:-4]) == {str(i) for i in range(200)}
    stream = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert found(stream.compress(b"".join(one[:3])) + stream.flush() + raw) >= {"0", "1", "2"}


def test_archives_read_in_small_ranges(monkeypatch):
    from cloakwork.llm import warc

    one = records(30)
    raw = b"".join(gzip.compress(x) for x in one[:10]) + gzip.compress(b"".join(one[10:20])) + b"junk\r\nWARC/1.1\r\n" + b"".join(one[20:])
    whole = [(a, f["x-row-id"] if f else None) for a, _, f, _ in salvage(raw)]
    monkeypatch.setattr(warc, "WINDOW", 64)
    monkeypatch.setattr(warc, "PIECE", 17)
    held = []

    class Watched(warc.Ranged):
        def get(self, at, n):
            out = super().get(at, n)
            held.append(len(self.data))
            return out

    got = [(a, f["x-row-id"] if f else None) for a, _, f, _ in salvage(Watched(lambda at, n: raw[at : at + n], len(raw)))]
    assert got == whole and [x for _, x in got if x] == [str(i) for i in range(30)]
    assert max(held) <= 2 * max(map(len, one))
