"""Components end as soon as their edges are stars, without rounds that change nothing."""

import random

from cloakwork.llm import components


def counted(monkeypatch, *modules):
    """How many tables are written, by name."""
    made = {}
    for module in modules:
        def count(df, what="table", real=module.materialise):
            made[what] = made.get(what, 0) + 1
            return real(df, what)

        monkeypatch.setattr(module, "materialise", count)
    return made


def parts(spark, edges, **how):
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), **how)
    got = {x.node: x.component for x in found.collect()}
    components.discard(found)  # a written table
    return got


def test_stars_need_no_round(spark, monkeypatch):
    made = counted(monkeypatch, components)
    edges = [(i, i % 3) for i in range(3, 40)]
    assert parts(spark, edges) == {i: i % 3 for i in range(40)}
    assert made == {"edges": 1, "least": 1}
    made.clear()
    assert parts(spark, edges, written=True) == {i: i % 3 for i in range(40)}
    assert made == {"least": 1}


def test_written_edges_of_any_shape(spark):
    r = random.Random(3)
    chain = list(range(100, 140))
    r.shuffle(chain)
    edges = [*zip(chain, chain[1:]), (7, 7), (2, 1), (3, 2), (5, 3), (8, 9)]
    want = dict.fromkeys(chain, 100) | {1: 1, 2: 1, 3: 1, 5: 1, 8: 8, 9: 8}
    assert parts(spark, edges, written=True) == want
    assert parts(spark, [(1, 1)], written=True) == {}
