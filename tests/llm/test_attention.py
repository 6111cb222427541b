"""The network against plain loops and finite differences, and long texts against short ones."""

import math

import numpy as np

from cloakwork.llm import quality_mil as M


def bags(seed=0):
    r = np.random.default_rng(seed)
    sizes = [1, 3, 2, 5, 1]
    return r.standard_normal((sum(sizes), M.FEATURES)), np.repeat(np.arange(5), sizes), np.array([1.0, 0, 1, 0, 1])


def test_forward_pass_as_loops():
    x, owner, _ = bags()
    net = M.Attention(3)
    p, sigmoid = net.p, lambda v: 1 / (1 + math.exp(-v))
    for bag, got in enumerate(net.scores(x, owner)):
        hs, es = [], []
        for row in x[owner == bag]:
            h = [math.tanh(sum(row[i] * p["A"][i, j] for i in range(M.FEATURES)) + p["a"][j]) for j in range(M.HIDDEN)]
            e = 0.0
            for k in range(M.ATTENTION):
                e += p["w"][k] * math.tanh(sum(h[j] * p["V"][j, k] for j in range(M.HIDDEN))) * sigmoid(sum(h[j] * p["U"][j, k] for j in range(M.HIDDEN)))
            hs.append(h)
            es.append(math.exp(e))
        z = [sum(e * h[j] for e, h in zip(es, hs)) / sum(es) for j in range(M.HIDDEN)]
        assert abs(got - sigmoid(sum(z[j] * p["c"][j] for j in range(M.HIDDEN)) + p["d"][0])) < 1e-5


def test_gradients_by_differences():
    x, owner, label = bags(1)
    net = M.Attention(4)
    loss = lambda: -np.mean(label * np.log(y := net._forward(x, owner)[-1]) + (1 - label) * np.log(1 - y))
    grads, r = net._gradients(x, owner, label), np.random.default_rng(2)
    for name, v in net.p.items():
        for _ in range(5):
            at = tuple(r.integers(0, n) for n in v.shape)
            kept = v[at]
            v[at] = kept + 1e-5
            up = loss()
            v[at] = kept - 1e-5
            down = loss()
            v[at] = kept
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6, name


def test_a_long_text_has_the_passages_of_its_parts(monkeypatch):
    text = "\n".join(" ".join(f"w{i * j % 977}" for j in range(1, 40)) for i in range(400)) + "  "
    whole, owner = M.passages(["x y", text, None, " "])
    for chunk in (700, 5000):
        monkeypatch.setattr(M, "CHUNK", chunk)
        x, of = M.passages(["x y", text, None, " "])
        assert of.tolist() == owner.tolist() and np.allclose(x, whole)
    assert np.bincount(owner)[[0, 2, 3]].tolist() == [1, 1, 1]
    assert np.isfinite(M.passages(["q" * 400_000])[0]).all()


def test_scores_do_not_hang_on_neighbours(spark):
    texts = ["a b c d", "c d a b " * 30, "x " * 250, None, "", "a b c d"]
    one = [M.passages([t])[0] for t in texts]
    every, owner = M.passages(texts)
    assert all(np.array_equal(one[k], every[owner == k]) for k in range(len(texts)))
    df = spark.createDataFrame([(i, t, 7.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    scored = M.score(df, M.Attention()).orderBy("doc_id").collect()
    assert scored[0].score == scored[5].score and scored[3].score == scored[4].score and all(0 <= x.score <= 1 for x in scored)
