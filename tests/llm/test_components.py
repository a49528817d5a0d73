import random

import pytest

from ledgerflow.llm import components as module
from ledgerflow.llm.components import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def run(spark, edges):
    return {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}


@pytest.mark.parametrize("few", [0, 40, 50_000])
def test_random_graphs_with_loops_repeats_and_nulls(spark, monkeypatch, few):
    """By rounds only, by rounds and one task, by one task."""
    monkeypatch.setattr(module, "FEW", few)
    rng = random.Random(few)
    for n, m in ((200, 120), (60, 400)) if few else ((200, 120),):
        edges = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(m)]
        edges += [(5000, 5000), (6000, 6001), (6001, 6000), (6000, 6000), (None, 3), (4, None)]
        assert run(spark, edges) == brute(edges)
    assert run(spark, []) == {} and run(spark, [(7, 7)]) == {7: 7}


def path(n, kind):
    nodes = list(range(n))
    if kind == "falling":
        nodes = [0, *range(n - 1, 0, -1)]
    if kind == "shuffled":
        random.Random(1).shuffle(nodes)
    return list(zip(nodes, nodes[1:], strict=False))


@pytest.mark.parametrize("kind", ["rising", "falling", "shuffled"])
def test_long_paths_take_logarithmically_many_rounds(spark, monkeypatch, kind):
    """Also the path 0, n - 1, n - 2, …, 1, on which the smallest id would be passed on one vertex a round."""
    rounds, contract = [], module.contract
    monkeypatch.setattr(module, "contract", lambda e, k: rounds.append(k) or contract(e, k))
    monkeypatch.setattr(module, "FEW", 0 if kind == "falling" else 1000)
    n = 100_000
    got = components(spark.createDataFrame(path(n, kind), "a long, b long").repartition(4))
    assert got.count() == n and got.where("root <> 0").count() == 0
    assert len(rounds) < 25


def test_stars_combs_and_cycles(spark, monkeypatch):
    monkeypatch.setattr(module, "FEW", 100)
    star = [(10_000, i) for i in range(1, 3000)]
    comb = [(20_000 + i, 20_001 + i) for i in range(300)] + [(20_000 + i, 30_000 + i) for i in range(300)]
    cycle = [(40_000 + i, 40_000 + (i + 1) % 257) for i in range(257)]
    edges = star + comb + cycle
    assert run(spark, edges) == brute(edges)
