"""Near copies against brute force: skewed passages, similarities about the threshold, rows without an id of their own."""

import random

import corpus_pipeline
from cloakwork.llm.simhash import similar_groups


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def brute(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if k == high else k for k in root]
    return dict(enumerate(root))


def groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {x.doc_id: x.group for x in similar_groups(df).collect()}


def test_near_copies_among_common_passages(spark):
    r = random.Random(1)
    pool = [words(r, 30) for _ in range(8)]
    texts = [" ".join(r.sample(pool, r.randint(3, 6))) + " " + words(r, r.randint(0, 12)) for _ in range(150)]
    short = [words(r, 60).split() for _ in range(40)]  # few passages, each with an edit
    edited = [" ".join("ZZ" if i in (30, 59) else w for i, w in enumerate(t)) for t in short]
    texts += [" ".join(t) for t in short] + edited
    assert groups(spark, texts) == brute(texts)


def test_similarities_about_the_threshold(spark):
    r = random.Random(2)
    texts = []
    for k in range(40):
        t = words(r, 204).split()
        texts += [" ".join(t), " ".join(t[: 204 - k] + words(r, k).split())]
    once = words(r, 50)
    texts += [words(r, 150) + " " + once, texts[0] + (" " + once) * 40, words(r, 200) + (" " + once) * 40]
    base = words(r, 100)
    texts += [base + " " + base, base + (" " + base) * 9]
    want = brute(texts)
    assert 10 < sum(k != v for k, v in want.items()) < 30
    assert groups(spark, texts) == want


def test_rows_without_an_id_of_their_own(spark):
    r = random.Random(3)
    a, b, c, d, e = (words(r, 100) for _ in range(5))
    near = c + " more"
    rows = [(None, a), (None, b), (None, a), (1, c), (1, d), (0, near), (2, e), (2, e), (3, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(x.doc_id, x.text) for x in kept.collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (1, d), (0, near), (2, e)], key=str)


def test_same_groups_where_nothing_is_broadcast(spark, monkeypatch):
    from cloakwork.llm import simhash

    monkeypatch.setattr(simhash, "MOST_WANTED", 0)
    r = random.Random(4)
    base = [words(r, 120) for _ in range(15)]
    texts = base + [t + " " + words(r, 5) for t in base[:9]] + [base[0], "", " "]
    assert groups(spark, texts) == brute(texts[:-2]) | {25: 25, 26: 25}
