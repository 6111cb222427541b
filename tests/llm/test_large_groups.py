"""Large groups of near copies that no two of them hold together: found as by brute force, without comparing most pairs."""

import random

from cloakwork.llm import simhash
from tests.llm import test_similar_rows as similar


def loose_group(k):
    """Copies of one text with two edits, every tenth with one, every twentieth with three: one edit and two are near enough, two and two are not."""
    r = random.Random(k)
    base = similar.words(r, 160).split()
    texts = []
    for i in range(k):
        copy = list(base)
        for at in r.sample(range(8, 152, 8), 1 if i % 10 == 0 else 3 if i % 20 == 5 else 2):
            copy[at] = f"edit{i}x{at}"
        texts.append(" ".join(copy))
    return texts


def counted(monkeypatch, *modules):
    made = {}
    for module in modules:
        real = module.materialise

        def count(df, what="table", real=real):
            found = real(df, what)
            if what in ("hub-pairs", "more"):
                made[what] = made.get(what, 0) + found.count()
            return found

        monkeypatch.setattr(module, "materialise", count)
    return made


def test_pairs_compared_do_not_grow_with_the_square(spark, monkeypatch):
    made = counted(monkeypatch, simhash)
    texts = loose_group(400)
    got = similar.groups(spark, texts)
    assert got == similar.brute(texts)
    assert sum(made.values()) < 2.5 * len(texts), made


def test_rounds_of_hubs_lose_no_link(spark, monkeypatch):
    """Rounds at small shingles too."""
    monkeypatch.setattr(simhash, "HUBS", 2)
    texts = loose_group(30) + loose_group(11)
    assert similar.groups(spark, texts) == similar.brute(texts)
