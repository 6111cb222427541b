"""The encoder against the library with its settings untouched."""

import random

import public_tokenizers as P
from tokenizers import Tokenizer

from cloakwork.llm.tokens import Encoder

LETTERS = "abcéßthÅÀ '\n\t.1日😀A!?#$%&*()-_=+[]{}<>|/\\:;,@~^`\"́ İǅΣς"
FIXED = ["hello <|endoftext|> you", "a<|endoftext|>b <|startoftext|>", "a.<|endoftext|>", "It's  done.\n\nI'LL GO", "Wort###, (zwei) drei.\n!!!", ""]


def test_any_text_as_the_library_gives_it():
    r = random.Random(1)
    odd = FIXED + ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library, own = Tokenizer.from_file(P.path(name)), Encoder(P.path(name), special=True)
        assert own.by_parts == (name == "word_bpe_49k.json")
        assert [own.ids(t).tolist() for t in odd] == [x.ids for x in library.encode_batch(odd, add_special_tokens=False)]


def test_bits_over_several_slices(monkeypatch):
    import numpy as np

    from cloakwork.llm import token_files as T

    r = np.random.default_rng(3)
    counts = (1e6 / np.arange(1, 3001)).astype(np.int64)
    lengths = T.code_lengths(counts, 16)
    ids = r.choice(3000, 20_000, p=counts / counts.sum()).astype("<u2")
    whole = T.pack_bits(ids, lengths, T.canonical_codes(lengths), 64)
    for size in (64, 1000, 4096):
        monkeypatch.setattr(T, "SLICE", size)
        bits, offsets, total = T.pack_bits(ids, lengths, T.canonical_codes(lengths), 64)
        assert (bits, offsets.tolist(), total) == (whole[0], whole[1].tolist(), whole[2])
    assert (T.unpack_bits(bits, offsets, len(ids), 64, T.decode_table(lengths, 16), 16) == ids).all()
    assert T.pack_bits(ids[:0], lengths, T.canonical_codes(lengths), 64)[2] == 0
