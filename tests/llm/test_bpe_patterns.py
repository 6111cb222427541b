"""Other patterns than the usual one, and the UTF-8 state machine on any bytes."""

import random

import public_tokenizers as P
import tiktoken

from cloakwork.llm.bpe_transducer import PATTERN, ByteBpe, Utf8Stream

BYTES = P.path("byte_bpe_multi_50k.tiktoken")


def test_patterns():
    assert PATTERN == P.PATTERN
    r = random.Random(4)
    texts = ["".join(r.choice("abcABC ßé!?.'s\n\t1日") for _ in range(r.randint(0, 40))) for _ in range(300)]
    for pattern in (PATTERN, r" ?\p{Lu}?\p{Ll}+|\p{Lu}| ?\p{N}| ?[^\s\p{L}\p{N}]+|\s+", r"[^\n]+|\n"):
        own = ByteBpe(BYTES, pattern)
        want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.machine.ranks, special_tokens={})
        assert [own.encode(t).tolist() for t in texts] == [want.encode_ordinary(t) for t in texts]


def test_any_bytes_in_any_pieces():
    r = random.Random(5)
    pool = [b"a", "é".encode(), "日".encode(), "😀".encode(), b"\xc0", b"\xe0\x80", b"\xed\xa0\x80", b"\xf4\x90", b"\xf0\x9f", b"\xe6\x97", b"\x80", b"\xff", b"\xf5"]
    for _ in range(3000):
        data = b"".join(r.choice(pool) for _ in range(r.randint(0, 8)))
        stream, out, at = Utf8Stream(), "", 0
        while at < len(data):
            n = r.randint(1, 3)
            out += stream.feed(data[at : at + n])
            at += n
        assert out + stream.finish() == data.decode("utf-8", "replace"), data
