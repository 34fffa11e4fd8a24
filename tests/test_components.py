"""Components against a plain union-find, and edges of leaves that take part in no round."""

import random

import pytest

from steplens.operators import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def graphs():
    rng = random.Random(12)
    bipartite = [(f"{rng.choice('CS')}{rng.randrange(60)}", f"T{t}") for t in range(150) for _ in range(rng.randrange(1, 4))]
    yield "bipartite", [*bipartite, ("X", "X"), ("C1", "C1"), ("Y", None), *bipartite[:20]]
    yield "path", [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("a", "b"), ("z", "a")]
    yield "random", [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(70)]
    yield "hub", [("a", f"h{i}") for i in range(40)] + [("zz", f"h{i}") for i in range(0, 40, 3)] + [("zz", "zz")]
    yield "none", [(None, "a")]


@pytest.mark.parametrize(("name", "edges"), list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_components_against_union_find(spark, monkeypatch, name, edges):
    written, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, n: (written.append(n), write(df, n))[1])
    rows = components.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(got) and got == plain(edges)
    if name == "hub":  # every edge was in every round
        assert "stars" not in written
