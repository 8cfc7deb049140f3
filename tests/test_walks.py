"""Walks over adjacency in blocks against the level-by-level joins and a plain search."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from tiewright.operators import graph as G
from tiewright.operators import walks as W


def graph(spark, seed, n, m, name=int):
    rng = random.Random(seed)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}
    kind = "int" if name is int else "string"
    return G.canonical_edges(spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"src {kind}, dst {kind}")), pairs


@pytest.mark.parametrize("cells, name", [(W.CELLS, int), (500, "n{}".format)])
def test_same_as_the_joins(spark, monkeypatch, name, cells):
    monkeypatch.setattr(W, "CELLS", cells)
    edges, pairs = graph(spark, 5, 40, 60, name)
    for f in (G.betweenness, G.closeness):
        blocks, joins = ({r[0]: r[1] for r in f(edges, size).collect()} for size in (None, 40))
        assert blocks.keys() == joins.keys() and all(abs(blocks[k] - joins[k]) < 1e-9 for k in joins)
    some = edges.select(F.col("src").alias("node")).distinct().limit(9)
    blocks, joins = (sorted(map(tuple, G.length_counts(edges, some, size).collect())) for size in (None, 40))
    assert blocks == joins != []


def test_lengths_as_a_plain_search(spark):
    edges, pairs = graph(spark, 6, 80, 110)
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    want = Counter()
    for source in near:
        dist, queue = {source: 0}, deque([source])
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
        want.update(d for d in dist.values() if d)
    assert {r.dist: r.n_pairs for r in G.length_counts(edges).collect()} == want


def test_beyond_the_bound_the_joins_take_over(spark, monkeypatch):
    edges, _ = graph(spark, 7, 20, 30)
    want = {r.node for r in G.closeness(edges).collect()}
    monkeypatch.setattr(W, "MAX_EDGES", 3)
    assert W.adjacency(edges) is None
    assert {r.node for r in G.closeness(edges).collect()} == want


def test_no_edges_no_nodes(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert W.adjacency(none) is None and G.betweenness(none).count() == 0 and G.length_counts(none).count() == 0
