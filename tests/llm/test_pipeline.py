"""The pipeline: every stage on what the one before kept, with planted copies, junk and shared passages."""

import random

import corpus_pipeline


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    clean = [".\n".join(words(r, 25) for _ in range(6)) for _ in range(60)]
    junk = [" ".join(w + "###" for w in words(r, 80).split()) for _ in range(30)]
    passage = words(r, 70)
    shared = [words(r, 60) + ".\n" + passage + ".\n" + words(r, 60) for _ in range(2)]
    near = clean[0].split()
    near[70] = "changed"
    texts = [*clean, *junk, *shared, clean[1], " ".join(near), None, ""]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 60), 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert out.columns == docs.columns
            docs = out
        kept.append({x.doc_id for x in out.select("doc_id").collect()})
    good = set(range(60))
    assert kept[0] == kept[1] == good | {90, 91, 92, 93}
    assert kept[2] == good | {90, 91} == kept[3] == kept[4]
    left = {x.doc_id: x for x in spark.read.parquet(str(tmp_path / "out3")).collect()}
    assert passage[10:-10] not in left[90].text and left[5].text == clean[5]
    assert all(x.n_chars == len(x.text) for x in left.values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in pieces} == kept[4]
